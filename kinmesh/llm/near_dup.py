"""SimHash near-duplicate groups by anchor-point covering.

Fingerprint: A-Z lower-cased, words ``[^\\x20\\x09-\\x0D]+``, 4-word shingles (repeats count) hashed with
XXH64 seed 42; a bit is 1 if set in over half of the hashes.  Fingerprints link at ``threshold`` or fewer
differing bits; a group is a connected component of links.

Search: the 64 bits are cut into blocks, and projections onto some blocks are searched with threshold 1.  With three blocks a
projection is one block: four differing bits leave one block with at most one.  With m of six or more blocks a projection is m - 3
blocks: were every one to differ in two bits or more, then so would the m - 3 blocks that differ least; either one of them differs in
two, and the three others in two each, eight in all, or two of them differ, and the three others too, five in all.  The anchors of a
projection are a covering code: the perfect Hamming code of 2^r - 1 bits (covering radius 1) on its first bits, times all
values of the rest.  A fingerprint is at home at its nearest anchor and is replicated to every anchor
within covering radius plus threshold (2); two fingerprints that agree in a projection up to one bit therefore
meet at the home of either.  They are compared per anchor over all 64 bits.  No link can be lost.

More blocks mean longer projections, so more anchors and fewer comparisons, and more replicas.  The code is chosen by the number of
distinct fingerprints (``cover``), so that neither outgrows the other: 42 replicas for millions, 340 for billions, 1400 beyond.

Equal texts, and all documents without a word, share a fingerprint; only distinct fingerprints are
searched, so groups of copies cost one row.  Null text: no words.  Null doc_id: takes part, is never the
smallest id of a group that has another, and a group of only null ids has a null component_id.
Repeated rows and repeated ids keep their rows.  Empty table: empty result.
"""

from __future__ import annotations

from itertools import accumulate, combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinmesh.operators.graph import component_minimum
from kinmesh.llm.shared import keep, partitions

SEED = 42
SHINGLE = 4
THRESHOLD = 4
_CHUNK = 1 << 16


def fingerprint(text: bytes | None) -> int:
    """SimHash of one text, unsigned."""
    words = (text or b"").lower().split()  # bytes: only A-Z and only \x20 \x09-\x0D
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        pieces = [joined]
    else:
        starts = list(accumulate((len(w) + 1 for w in words), initial=0))
        pieces = [joined[a : b - 1] for a, b in zip(starts, starts[SHINGLE:])]
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(pieces), _CHUNK):
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, pieces[at : at + _CHUNK], repeat(SEED)), dtype=">u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(pieces)).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long), a row for each row of docs."""

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(x) for x in batch.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long")


# ---------------------------------------------------------------- anchors


class Cover:
    """Projections onto blocks of bits, and the Hamming code of 2**order - 1 bits on the first bits of each."""

    def __init__(self, blocks: int, order: int):
        edges = [64 * i // blocks for i in range(blocks + 1)]
        cut = [(a, b - a) for a, b in zip(edges, edges[1:])]
        self.projections = [(c,) for c in cut] if blocks == 3 else list(combinations(cut, blocks - 3))
        self.code_bits = (1 << order) - 1
        self.masks = [sum(((1 << w) - 1) << a for a, w in p) for p in self.projections]
        # bit k of a word's syndrome is the parity of its bits at places (from 1) that have bit k
        self.checks = [np.int64(sum(1 << i - 1 for i in range(1, self.code_bits + 1) if i >> k & 1)) for k in range(order)]
        places = range(1, self.code_bits + 1)
        self.nearest = np.array([0] + [1 << s - 1 for s in places], dtype=np.int64)
        #: The errors of weight two with each syndrome; none leads from a codeword to another.
        self.at_two = np.array([[0] * (self.code_bits // 2)] + [[1 << i - 1 | 1 << (i ^ s) - 1 for i in places if i < i ^ s] for s in places], dtype=np.int64)
        free = [sum(w for _, w in p) - self.code_bits for p in self.projections]
        #: Replicas of a fingerprint, at most, and comparisons a pair of them costs on the mean.
        self.replicas = sum(1 + self.code_bits // 2 + f for f in free)
        self.chance = sum((1 + self.code_bits // 2 + f) / 2.0 ** (f + self.code_bits - order) for f in free)

    def syndromes(self, code: np.ndarray) -> np.ndarray:
        return sum((np.bitwise_count(code & c) & 1).astype(np.int64) << k for k, c in enumerate(self.checks))

    def anchors(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Home anchors (n x projections) and all anchors in reach (n x m) of signed-long fingerprints; -1 fills up."""
        homes, reach = [], []
        for number, projection in enumerate(self.projections):
            value, at = np.zeros(len(fps), dtype=np.int64), 0
            for first, width in projection:
                value |= ((fps.view(np.uint64) >> np.uint64(first)).astype(np.int64) & (1 << width) - 1) << at
                at += width
            code, rest = value & self.code_bits_mask, value >> self.code_bits
            syndrome = self.syndromes(code)
            key = lambda c, r: np.int64(number) << PLACE | r << self.code_bits | c  # noqa: B023, E731
            home = code ^ self.nearest[syndrome]
            homes.append(key(home, rest))
            two = np.where((syndrome == 0)[:, None], -1, key(code[:, None] ^ self.at_two[syndrome], rest[:, None]))
            flips = key(home[:, None], rest[:, None] ^ np.int64(1) << np.arange(at - self.code_bits))
            reach += [homes[-1][:, None], two, flips]
        return np.stack(homes, axis=1), np.concatenate(reach, axis=1)

    @property
    def code_bits_mask(self) -> int:
        return (1 << self.code_bits) - 1


#: Bits of an anchor's key below its projection's number; projections have fewer.
PLACE = 56
COVERS = tuple(Cover(*x) for x in ((3, 4), (6, 5), (8, 5)))
#: What a comparison costs, in replicas.
COMPARISON = 0.01


def cover(n: int) -> int:
    """The number of the cover that costs least for n distinct fingerprints."""
    return min(range(len(COVERS)), key=lambda k: COVERS[k].replicas + COMPARISON * COVERS[k].chance * n)


def _replicate(nodes: DataFrame, number: int, home: bool) -> DataFrame:
    def run(batches):
        own = COVERS[number]
        rows = max(64, 170_000 // own.replicas)
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                fps = batch.column(0).to_numpy(zero_copy_only=False)[at : at + rows]
                keys = own.anchors(fps)[0 if home else 1]
                every, flat = np.repeat(fps, keys.shape[1]), keys.ravel()
                yield pa.RecordBatch.from_arrays([pa.array(flat[flat >= 0]), pa.array(every[flat >= 0])], names=["anchor", "fp"])

    return nodes.select("fp").mapInArrow(run, "anchor long, fp long")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def links(nodes: DataFrame, number: int | None = None) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints at THRESHOLD or fewer differing bits, each once:
    at the home anchor of a, in the first projection with at most one difference (anchors reach some pairs with two, too).
    The join is a shuffle by its hint: replicas come from Arrow functions, and Spark takes them for as small as the fingerprints, so it
    would broadcast them through the driver."""
    number = cover(nodes.count()) if number is None else number
    home = _replicate(nodes, number, True).withColumnRenamed("fp", "a")
    near = _replicate(nodes, number, False).withColumnRenamed("fp", "b")
    x = F.col("a").bitwiseXOR(F.col("b"))
    masks = F.array(*(F.lit(_signed(m)).cast("long") for m in COVERS[number].masks))
    here = F.shiftright("anchor", PLACE).cast("int")
    near_in = lambda m: F.bit_count(x.bitwiseAND(m)) <= 1
    first = near_in(F.get(masks, here)) & ~F.exists(F.slice(masks, F.lit(1), here), near_in)
    return home.join(near.hint("merge"), "anchor").where((F.col("a") < F.col("b")) & (F.bit_count(x) <= THRESHOLD)).where(first).select("a", "b")


def near_duplicate_groups(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id (smallest doc_id reachable), n_same, n_links
    (rows with the same fingerprint; other fingerprints linked to it)."""
    spark = docs.sparkSession
    rows = keep(fingerprints(docs), "fingerprints")
    nodes = keep(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n_same")), "nodes")
    pairs = keep(links(nodes.repartition(partitions(spark), "fp")), "links")
    degree = pairs.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").agg(F.count(F.lit(1)).alias("n_links"))
    roots = component_minimum(pairs, nodes.select(F.col("fp").alias("node"), "least"))
    # a table of its own, so that the join below stands alone and its hot fingerprints can be split
    of = keep(nodes.join(roots, nodes.fp == roots.node, "left").join(degree, "fp", "left").select(
        "fp", F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("root_least")).alias("component_id"), "n_same", F.coalesce("n_links", F.lit(0)).alias("n_links")
    ), "groups")
    return rows.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_same", "n_links")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay: of each group the one with the smallest doc_id (null last; rows with equal
    ids by their place).  Only fingerprints and row numbers are shuffled; texts stay where they are, but for the
    join that drops the others."""
    whole = keep(docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("doc")).withColumn("row", F.monotonically_increasing_id()), "rows")

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(x) for x in batch.column(2).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(fps.view(np.int64))], names=["row", "doc_id", "fp"])

    prints = whole.select("row", F.col("doc.doc_id").cast("long").alias("doc_id"), F.col("doc.text").cast("binary").alias("text"))
    rows = keep(prints.mapInArrow(run, "row long, doc_id long, fp long"), "fingerprints")
    # the least of a fingerprint, null ids last; a struct's order is that of its fields
    best = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    nodes = keep(rows.groupBy("fp").agg(F.min(best).alias("least")), "nodes")
    pairs = keep(links(nodes.repartition(partitions(docs.sparkSession), "fp")), "links")
    roots = component_minimum(pairs, nodes.select(F.col("fp").alias("node"), "least"))
    stay = nodes.join(roots, nodes.fp == roots.node, "left").where("root is null or least = root_least").select(F.col("least.row").alias("row"))
    return whole.join(stay, "row", "left_semi").select("doc.*")
