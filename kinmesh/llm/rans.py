"""Token ids in static range asymmetric numeral system (rANS) files.

All segments share one frequency table, counted over the whole corpus.  A segment holds consecutive documents
in ascending doc_id order; a file is SEGMENTS segments at most, each followed by a line feed:

  header   magic, version, scale bits, table CRC-32, task, segment, documents, blocks, tokens, bytes
           (little-endian throughout; task and segment are its place in the order)
  index    a null flag and doc_id (int64), and n_tokens (uint32), for each document
  blocks   tokens, lanes, checkpoints, words (uint32 each), CRC-32 of the ids, CRC-32 of what follows;
           lane states (uint64); checkpoints (word position uint64, lane states); words (uint32)
  trailer  CRC-32 of all before

Token t of a block belongs to lane t mod lanes; the lanes' 64-bit states are coded in step with each other, so
that both directions are array operations, and share one stream of 32-bit words.  Blocks don't depend on each
other; a checkpoint every CHECK_STEPS steps gives the states and the place in the stream from which decoding
can begin inside a block.  A token that the table lacks makes its block a stored one (no lanes, ids as words).

Order: doc_id ascending, null last; equal ids by a hash of their text.  Null text: as empty, the end id alone.
Repeated rows are written as often as they come.  Empty table: no segment, empty result.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinmesh.llm.shared import drop, keep, kept_path, partitions
from kinmesh.llm.token_ids import encoder, tokenizer_path

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
MAGIC = b"RANSTOK\0"
HEADER = struct.Struct("<8sHHIIIIIQQ")
BLOCK = struct.Struct("<IIIIII")
VERSION = 2
SCALE = 20
LOW = np.uint64(1 << 31)
BLOCK_TOKENS = 1 << 19
LANES = 2048
CHECK_STEPS = 128
SEGMENT_TOKENS = 1 << 20
SEGMENTS = 8
#: Text that is encoded at once.
SLICE_BYTES = 4 << 20


class RansError(ValueError):
    pass


class Table:
    """Frequencies scaled to 2**SCALE; a token that was counted has at least one."""

    def __init__(self, freq: np.ndarray):
        self.freq = np.asarray(freq, dtype=np.uint64)
        if int(self.freq.sum()) not in (0, 1 << SCALE):
            raise RansError("frequencies don't fill the scale")
        self.start = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64) if len(self.freq) else self.freq
        self.symbol = np.repeat(np.arange(len(self.freq), dtype=np.uint16 if len(self.freq) <= 1 << 16 else np.uint32), self.freq.astype(np.int64))
        self.crc = zlib.crc32(self.freq.astype("<u4").tobytes())

    @classmethod
    def of_counts(cls, counts: np.ndarray) -> Table:
        counts = np.asarray(counts, dtype=np.int64)
        seen, total = counts > 0, int(counts.sum())
        if int(seen.sum()) > 1 << SCALE:
            raise RansError("more tokens than the scale holds")
        if not total:
            return cls(np.zeros(len(counts), dtype=np.uint64))
        spare = (1 << SCALE) - int(seen.sum())
        freq = np.array([int(n) * spare // total for n in counts], dtype=np.int64) + seen
        freq[int(np.argmax(counts))] += (1 << SCALE) - int(freq.sum())
        return cls(freq)


# ---------------------------------------------------------------- blocks


def encode_block(ids: np.ndarray, table: Table) -> bytes:
    ids = np.asarray(ids, dtype="<u4")
    n, crc = len(ids), zlib.crc32(ids.tobytes())
    if n and (int(ids.max()) >= len(table.freq) or not table.freq[ids].all()):
        return BLOCK.pack(n, 0, 0, n, crc, zlib.crc32(ids.tobytes())) + ids.tobytes()
    lanes = max(1, min(LANES, n // 64))
    steps = -(-n // lanes)
    freq = np.ones((steps, lanes), dtype=np.uint64)
    start = np.zeros((steps, lanes), dtype=np.uint64)
    freq.ravel()[:n], start.ravel()[:n] = table.freq[ids], table.start[ids]
    most = freq << np.uint64(63 - SCALE)
    x = np.full(lanes, LOW)
    down, scale = np.uint64(32), np.uint64(SCALE)
    words, marks, written = [], [], 0
    for t in range(steps - 1, -1, -1):
        here = min(lanes, n - t * lanes)
        if t and t % CHECK_STEPS == 0:
            marks.append((written, None))
        f, v = freq[t, :here], x[:here]
        if (full := v >= most[t, :here]).any():
            out = (v[full] & np.uint64(0xFFFFFFFF)).astype("<u4")
            words.append(out)
            written += len(out)
            v = np.where(full, v >> down, v)
        q = v // f
        x[:here] = (q << scale) + (v - q * f) + start[t, :here]
        if t and t % CHECK_STEPS == 0:
            marks[-1] = (written, x.copy())  # the states with which the decoder begins step t
    stream = b"".join(w.tobytes() for w in reversed(words))
    points = b"".join(struct.pack("<Q", written - at) + s.astype("<u8").tobytes() for at, s in reversed(marks))
    body = x.astype("<u8").tobytes() + points + stream
    return BLOCK.pack(n, lanes, len(marks), written, crc, zlib.crc32(body)) + body


def _steps(x: np.ndarray, words: np.ndarray, at: int, first: int, stop: int, n: int, lanes: int, table: Table) -> Iterator[np.ndarray]:
    x = x.copy()
    mask, scale, up = np.uint64((1 << SCALE) - 1), np.uint64(SCALE), np.uint64(32)
    for t in range(first, stop):
        here = min(lanes, n - t * lanes)
        v = x[:here]
        slot = v & mask
        ids = table.symbol[slot]
        v = table.freq[ids] * (v >> scale) + slot - table.start[ids]
        if k := int(np.count_nonzero(low := v < LOW)):
            v[low] = v[low] << up | words[at : at + k]
            at += k
        x[:here] = v
        yield ids


def decode_block(data: memoryview, table: Table, first_step: int = 0, last_step: int | None = None) -> tuple[np.ndarray, int]:
    """The ids of a block (or of some of its steps, from the nearest checkpoint on) and the block's length in bytes."""
    n, lanes, points, n_words, crc, body_crc = BLOCK.unpack_from(data)
    size = 4 * n_words + (8 * lanes + points * (8 + 8 * lanes) if lanes else 0)
    body = data[BLOCK.size : BLOCK.size + size]
    if len(body) < size or zlib.crc32(body) != body_crc:
        raise RansError("block checksum")
    if not lanes:
        return np.frombuffer(body, "<u4"), BLOCK.size + size
    words = np.frombuffer(body, "<u4", offset=size - 4 * n_words).astype(np.uint64)
    steps = -(-n // lanes)
    x, at, begin = np.frombuffer(body, "<u8", lanes), 0, 0
    if k := min(first_step // CHECK_STEPS, points):
        where = 8 * lanes + (k - 1) * (8 + 8 * lanes)
        (at,), begin = struct.unpack_from("<Q", body, where), k * CHECK_STEPS
        x = np.frombuffer(body, "<u8", lanes, where + 8)
    stop = steps if last_step is None else min(last_step, steps)
    got = list(_steps(x, words, at, begin, stop, n, lanes, table))
    ids = np.concatenate(got[first_step - begin :]) if got[first_step - begin :] else np.zeros(0, np.uint32)
    if first_step == 0 and stop == steps and zlib.crc32(ids.astype("<u4").tobytes()) != crc:
        raise RansError("ids checksum")
    return ids, BLOCK.size + size


# ---------------------------------------------------------------- segments


def encode_segment(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, table: Table, place: tuple[int, int] = (0, 0)) -> bytes:
    blocks = [encode_block(ids[i : i + BLOCK_TOKENS], table) for i in range(0, len(ids), BLOCK_TOKENS)]
    flags = np.array([x is not None for x in doc_ids], dtype=np.uint8)
    keys = np.array([x or 0 for x in doc_ids], dtype="<i8")
    parts = [flags.tobytes(), keys.tobytes(), np.array(lengths, dtype="<u4").tobytes(), *blocks]
    size = HEADER.size + sum(map(len, parts)) + 4
    out = b"".join([HEADER.pack(MAGIC, VERSION, SCALE, table.crc, *place, len(doc_ids), len(blocks), len(ids), size), *parts])
    return out + struct.pack("<I", zlib.crc32(out))


def segments_of(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """Task, segment and bytes of each segment of a file."""
    at = 0
    while at < len(data):
        if len(data) - at < HEADER.size or data[at : at + len(MAGIC)] != MAGIC:
            raise RansError("no segment begins here")
        *_, task, segment, _, _, _, size = HEADER.unpack_from(data, at)
        if data[at + size : at + size + 1] != b"\n":
            raise RansError("the file is cut short")
        yield task, segment, data[at : at + size]
        at += size + 1


def decode_segment(data: bytes, table: Table) -> tuple[list[int | None], list[int], np.ndarray]:
    view = memoryview(data)
    if len(data) < HEADER.size + 4 or zlib.crc32(view[:-4]) != struct.unpack_from("<I", data, len(data) - 4)[0]:
        raise RansError("segment checksum")
    magic, version, scale, crc, _, _, n_docs, n_blocks, n_tokens, _ = HEADER.unpack_from(data)
    if (magic, version, scale) != (MAGIC, VERSION, SCALE):
        raise RansError("not a segment of this version")
    if crc != table.crc:
        raise RansError("the segment was written with another table")
    at = HEADER.size
    flags, keys, lengths = np.frombuffer(data, np.uint8, n_docs, at), np.frombuffer(data, "<i8", n_docs, at + n_docs), np.frombuffer(data, "<u4", n_docs, at + 9 * n_docs)
    at += 13 * n_docs
    parts = []
    for _ in range(n_blocks):
        ids, size = decode_block(view[at:-4], table)
        parts.append(ids)
        at += size
    ids = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
    if len(ids) != n_tokens or int(lengths.sum()) != n_tokens:
        raise RansError("tokens are missing")
    return [int(k) if f else None for k, f in zip(keys, flags)], lengths.tolist(), ids


# ---------------------------------------------------------------- tables of segments


CHUNK = "task int, segment int, n_tokens long, doc_ids array<bigint>, lengths array<int>, ids binary"


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Consecutive rows with SLICE_BYTES of text or a little more."""
    size, begin = 0, 0
    for at, n in enumerate(pc.binary_length(batch.column(1)).to_pylist()):
        size += n or 0
        if size >= SLICE_BYTES:
            yield batch.slice(begin, at + 1 - begin)
            size, begin = 0, at + 1
    if begin < batch.num_rows:
        yield batch.slice(begin)


def token_chunks(docs: DataFrame, path: str, n_partitions: int) -> DataFrame:
    """Rows of about SEGMENT_TOKENS tokens of consecutive documents in order (task, segment)."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    order = [F.col("doc_id").asc_nulls_last(), F.col("tie")]
    placed = keyed.repartitionByRange(n_partitions, *order).sortWithinPartitions(*order).select("doc_id", "text")

    def run(batches):
        task, segment = TaskContext.get().partitionId(), 0
        encode = encoder(path, False).batch
        keys, lengths, held, size = [], [], [], 0

        def turn():
            ids = np.concatenate(held)
            narrow = ids.astype("<u2") if int(ids.max()) < 1 << 16 else ids.astype("<u4")
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((task, segment, len(ids), keys, lengths, narrow.tobytes()), kinds)], names=[x.split()[0] for x in CHUNK.split(", ")])

        for batch in batches:
            for part in slices(batch):
                ids, n = encode(part.column(1))
                pa.default_memory_pool().release_unused()  # else each worker keeps the most that a slice took
                ids, ends = np.insert(ids, np.cumsum(n), END_ID), np.cumsum(n + 1)
                docs, begin, at = part.column(0).to_pylist(), 0, 0
                while begin < len(docs):
                    stop = min(int(np.searchsorted(ends, at + SEGMENT_TOKENS - size)) + 1, len(docs))
                    held.append(ids[at : ends[stop - 1]])
                    keys += docs[begin:stop]
                    lengths += (n[begin:stop] + 1).tolist()
                    size += len(held[-1])
                    begin, at = stop, int(ends[stop - 1])
                    if size >= SEGMENT_TOKENS:
                        yield turn()
                        keys, lengths, held, size = [], [], [], 0
                        segment += 1
        if keys:
            yield turn()

    return placed.mapInArrow(run, CHUNK)


def _ids(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype(np.uint32)


def frequency_table(chunks: DataFrame) -> Table:
    """Counted over all chunks; a task sends a row a token at most, and the driver gets a row a token of the vocabulary."""

    def run(batches):
        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            for n, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                got = np.bincount(_ids(raw.as_py(), n))
                if len(got) > len(total):
                    total = np.concatenate([total, np.zeros(len(got) - len(total), dtype=np.int64)])
                total[: len(got)] += got
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["token", "n"])

    rows = chunks.select("n_tokens", "ids").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(int(rows.token.max()) + 1 if len(rows) else 0, dtype=np.int64)
    counts[rows.token.to_numpy()] = rows.n.to_numpy()
    return Table.of_counts(counts)


def write_files(docs: DataFrame, path: str | None = None) -> tuple[str, Table, DataFrame]:
    """Write docs' token files to a folder of the shared folder; the folder, the frequency table, and the place (task, segment) and first token of
    each segment.  Spark's text writer takes a row's bytes as they are and ends it with a line feed: so its commit protocol, on any
    file system that it writes to, serves binary files."""
    spark = docs.sparkSession
    chunks = keep(token_chunks(docs, path or tokenizer_path(TOKENIZER), partitions(spark)), "chunks")
    table = frequency_table(chunks)
    shipped = spark.sparkContext.broadcast(table.freq)

    def run(batches):
        own = Table(shipped.value)
        for batch in batches:
            for i in range(batch.num_rows):
                task, segment, n, keys, lengths, raw = (c[i].as_py() for c in batch.columns)
                yield pa.RecordBatch.from_arrays([pa.array([encode_segment(keys, lengths, _ids(raw, n), own, (task, segment))], pa.binary())], names=["data"])

    folder = kept_path(spark, "token-files")
    chunks.mapInArrow(run, "data binary").select(F.col("data").cast("string").alias("value")).write.option("lineSep", "\n").option("maxRecordsPerFile", SEGMENTS).text(folder)
    by = keep(chunks.select("task", "segment", "n_tokens"), "places")
    drop(chunks)
    tasks = by.groupBy("task").agg(F.sum("n_tokens").alias("n"))
    # a row a task under the first window; the segments of a task under the second
    earlier = tasks.select("task", (F.sum("n").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("earlier"))
    inside = F.sum("n_tokens").over(Window.partitionBy("task").orderBy("segment").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens")
    return folder, table, by.withColumn("inside", inside).join(earlier, "task").select("task", "segment", (F.col("earlier") + F.col("inside")).alias("before"))


def read_files(spark: SparkSession, folder: str, table: Table, places: DataFrame) -> DataFrame:
    """doc_id, start (tokens of all documents before), n_tokens, ids_crc32, from the files' bytes."""
    shipped = spark.sparkContext.broadcast(table.freq)

    def run(batches):
        own = Table(shipped.value)
        for batch in batches:
            for data in batch.column(0):
                for task, segment, part in segments_of(data.as_py()):
                    keys, lengths, ids = decode_segment(part, own)
                    raw = ids.astype("<u4").tobytes()
                    starts = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
                    crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), starts[1:].tolist())]
                    n = len(keys)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([task] * n, pa.int32()), pa.array([segment] * n, pa.int32()), pa.array(keys, pa.int64()), pa.array(starts[:-1]), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())],
                        names=["task", "segment", "doc_id", "inside", "n_tokens", "ids_crc32"],
                    )

    files = spark.read.format("binaryFile").load(folder).select("content")
    docs = files.mapInArrow(run, "task int, segment int, doc_id long, inside long, n_tokens long, ids_crc32 long")
    return docs.join(places, ["task", "segment"]).select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def token_file_report(docs: DataFrame, path: str | None = None) -> DataFrame:
    return read_files(docs.sparkSession, *write_files(docs, path))
