"""TIFF media columns: walk the image directories of a file, decode its strips or tiles and emit a row a page.

Read: both byte orders, classic TIFF; strips and tiles; chunky and planar samples of 1, 2, 4, 8, 16 or 32
bits; no compression, LZW, deflate (both codes) and PackBits; predictors 1, 2 (horizontal differences) and
3 (floating point).  Pixels come out row by row, samples interleaved, 16 and 32 bits little-endian, rows of
less than 8 bits a sample padded to a byte; the padding of edge tiles is cut off.

A page that can't be decoded (no rows a strip, needed tags without values, sizes that the stored bytes can't hold, strips beyond the
file or cut short, damaged codes) gives a row with null pixels and its error; the pages before it and after it stay.
A null or empty value gives no page.  A directory chain that turns back ends there.  Equal bytes, equal rows.
Very long files are read whole.  Extra columns of any name ride along in the struct ``file``.  Empty table: empty result.
"""

from __future__ import annotations

import struct
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the format: tags, types and compression codes.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, PLANAR = 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES, SAMPLE_FORMAT = 317, 322, 323, 324, 325, 339
TYPES = {1: "B", 2: "B", 3: "H", 4: "I", 6: "b", 7: "B", 8: "h", 9: "i", 11: "f", 12: "d"}
NONE, LZW, DEFLATE, DEFLATE_OLD, PACKBITS = 1, 5, 8, 32946, 32773
CLEAR, END = 256, 257

PAGE = "page int, width int, height int, bits int, samples int, compression int, predictor int, tiled boolean, pixels binary, feature string, error string"
#: Bytes of output that are gathered before a batch is handed on.
BATCH_BYTES = 8 << 20


class TiffError(ValueError):
    pass


# ---------------------------------------------------------------- codecs


#: Bytes that one byte of stored data can at most stand for, by compression.
RATIO = {NONE: 1, PACKBITS: 128, LZW: 4096, DEFLATE: 1040, DEFLATE_OLD: 1040}


def packbits_decode(data: bytes, most: int = sys.maxsize) -> bytes:
    out, at, end = bytearray(), 0, len(data)
    while at < end and len(out) < most:
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        else:
            if n > 128:
                out += data[at + 1 : at + 2] * (257 - n)
            at += 2 if n > 128 else 1
    return bytes(out)


def packbits_encode(row: bytes) -> bytes:
    """Runs of two or more as repeats, the rest as literals, 128 at most each."""
    out, at, n = bytearray(), 0, len(row)
    literal = bytearray()

    def flush():
        for i in range(0, len(literal), 128):
            piece = literal[i : i + 128]
            out.append(len(piece) - 1)
            out.extend(piece)
        literal.clear()

    while at < n:
        run = 1
        while run < 128 and at + run < n and row[at + run] == row[at]:
            run += 1
        if run > 1:
            flush()
            out += bytes((257 - run, row[at]))
        else:
            literal.append(row[at])
        at += run
    flush()
    return bytes(out)


def lzw_decode(data: bytes, most: int = sys.maxsize) -> bytes:
    """Codes of 9 to 12 bits, high bit first; the width grows one code early."""
    singles = [bytes((i,)) for i in range(256)] + [b"", b""]
    words, width, last, out = singles[:], 9, None, []
    have = bits = size = 0
    for byte in data:
        if size >= most:
            break
        have = have << 8 | byte
        bits += 8
        if bits < width:
            continue
        bits -= width
        code = have >> bits
        have &= (1 << bits) - 1
        if code == END:
            return b"".join(out)
        if code == CLEAR:
            words, width, last = singles[:], 9, None
            continue
        if last is None:
            if code > 255:
                raise TiffError("LZW: first code isn't a byte")
            word = words[code]
        else:
            if code < len(words):
                word = words[code]
            elif code == len(words):
                word = last + last[:1]
            else:
                raise TiffError("LZW: code beyond the table")
            if len(words) < 4096:
                words.append(last + word[:1])
            if len(words) >= (1 << width) - 1 and width < 12:
                width += 1
        out.append(word)
        size += len(word)
        last = word
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    have, bits, out = 0, 0, bytearray()
    codes, free, width = {bytes((i,)): i for i in range(256)}, 258, 9

    def put(code):
        nonlocal have, bits
        have, bits = have << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(have >> bits)
            have &= (1 << bits) - 1

    put(CLEAR)
    word = b""
    for i in range(len(data)):
        more = word + data[i : i + 1]
        if more in codes:
            word = more
            continue
        put(codes[word])
        codes[more] = free
        free += 1
        if free == (1 << width) and width < 12:
            width += 1
        if free == 4094:
            put(CLEAR)
            codes, free, width = {bytes((i,)): i for i in range(256)}, 258, 9
        word = data[i : i + 1]
    if word:
        put(codes[word])
        free += 1
        if free == (1 << width) and width < 12:
            width += 1
    put(END)
    if bits:
        out.append(have << 8 - bits & 255)
    return bytes(out)


def _unpack(compression: int, data: bytes, size: int) -> bytes:
    """The first size bytes of what was packed, or all there is; no more than that is ever held."""
    if compression == NONE:
        return data[:size]
    if compression == LZW:
        return lzw_decode(data, size)[:size]
    if compression in (DEFLATE, DEFLATE_OLD):
        return zlib.decompressobj().decompress(data, size) if size else b""
    if compression == PACKBITS:
        return packbits_decode(data, size)[:size]
    raise TiffError(f"compression {compression} isn't known")


def _pack(compression: int, data: bytes, row: int) -> bytes:
    if compression == PACKBITS:  # a row at a time, as the format asks
        return b"".join(packbits_encode(data[i : i + row]) for i in range(0, len(data), row))
    return {NONE: lambda x: x, LZW: lzw_encode, DEFLATE: zlib.compress, DEFLATE_OLD: zlib.compress}[compression](data)


def _undo(predictor: int, raw: bytes, rows: int, width: int, samples: int, bits: int, order: str) -> bytes:
    """Predictor and byte order undone; little-endian samples."""
    if bits < 8:
        if predictor != 1:
            raise TiffError("predictor on samples of under 8 bits")
        return raw
    if predictor == 3:
        planes = np.frombuffer(raw, np.uint8).reshape(rows, -1).copy()
        for s in range(samples):
            planes[:, s::samples] = np.cumsum(planes[:, s::samples], axis=1, dtype=np.uint8)
        # the most significant bytes of a row come first
        return planes.reshape(rows, bits // 8, width * samples)[:, ::-1].transpose(0, 2, 1).tobytes()
    kind = np.dtype(f"u{bits // 8}").newbyteorder(order)
    values = np.frombuffer(raw, kind).reshape(rows, width, samples)
    if predictor == 2:
        values = np.cumsum(values, axis=1, dtype=np.dtype(f"u{bits // 8}"))
    elif predictor != 1:
        raise TiffError(f"predictor {predictor} isn't known")
    return values.astype(np.dtype(f"<u{bits // 8}")).tobytes()


# ---------------------------------------------------------------- reading


def directories(data: bytes) -> Iterator[tuple[str, dict[int, tuple]]]:
    """Byte order and tags of each image directory in the chain."""
    if data[:4] not in (b"II*\0", b"MM\0*"):
        raise TiffError("no TIFF header")
    order = "<" if data[:1] == b"I" else ">"
    (at,) = struct.unpack_from(order + "I", data, 4)
    seen: set[int] = set()
    while at and at not in seen:
        seen.add(at)
        if at + 2 > len(data):
            raise TiffError("directory beyond the file")
        (n,) = struct.unpack_from(order + "H", data, at)
        if at + 6 + 12 * n > len(data):
            raise TiffError("directory beyond the file")
        tags = {}
        for i in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
            if kind not in TYPES:
                continue
            size = struct.calcsize(TYPES[kind]) * count
            where = at + 10 + 12 * i
            if size > 4:
                (where,) = struct.unpack_from(order + "I", data, where)
            if count and where + size <= len(data):
                tags[tag] = struct.unpack_from(f"{order}{count}{TYPES[kind]}", data, where)
        yield order, tags
        (at,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)


def decode_page(data: bytes, order: str, tags: dict[int, tuple]) -> dict:
    one = lambda tag, default=None: tags.get(tag, (default,))[0]
    width, height, samples = one(WIDTH), one(HEIGHT), one(SAMPLES, 1)
    bits, compression, predictor = one(BITS, 1), one(COMPRESSION, NONE), one(PREDICTOR, 1)
    tiled = TILE_OFFSETS in tags
    page = {"width": width, "height": height, "bits": bits, "samples": samples, "compression": compression, "predictor": predictor, "tiled": tiled}
    if not width or not height or not samples or bits not in (1, 2, 4, 8, 16, 32) or len(set(tags.get(BITS, (1,)))) > 1:
        raise TiffError("size or sample width isn't supported")
    offsets, lengths = tags.get(TILE_OFFSETS if tiled else STRIP_OFFSETS), tags.get(TILE_BYTES if tiled else STRIP_BYTES)
    if offsets is None or lengths is None or len(offsets) != len(lengths):
        raise TiffError("no strips or tiles")
    planes, each = (samples, 1) if one(PLANAR, 1) == 2 and samples > 1 else (1, samples)
    wide = one(TILE_WIDTH) if tiled else width
    high = one(TILE_HEIGHT) if tiled else min(one(ROWS_PER_STRIP, height), height)
    if not wide or not high:
        raise TiffError("a strip or tile without rows or columns")
    if tiled and wide * each * bits % 8:
        raise TiffError("a tile's row doesn't end with a byte")
    if predictor == 3 and bits < 16:
        raise TiffError("predictor 3 on samples of under 16 bits")
    if compression not in RATIO:
        raise TiffError(f"compression {compression} isn't known")
    across, down = -(-width // wide), -(-height // high)
    if len(offsets) < across * down * planes:
        raise TiffError("strips or tiles are missing")
    row, part_row = -(-width * each * bits // 8), -(-wide * each * bits // 8)
    # what the header claims is allocated only if the stored bytes can hold it
    if planes * height * row > RATIO[compression] * sum(min(n, len(data)) for n in lengths[: planes * across * down]):
        raise TiffError("the image is larger than its strips or tiles can be")
    image = np.zeros((planes, height, row), dtype=np.uint8)
    for n in range(planes * across * down):
        plane, y, x = n // (across * down), n // across % down * high, n % across
        rows = high if tiled else min(high, height - y)
        if offsets[n] + lengths[n] > len(data):
            raise TiffError("strip or tile beyond the file")
        raw = _unpack(compression, data[offsets[n] : offsets[n] + lengths[n]], rows * part_row)
        if len(raw) < rows * part_row:
            raise TiffError("strip or tile is too short")
        part = np.frombuffer(_undo(predictor, raw, rows, wide, each, bits, order), np.uint8).reshape(rows, part_row)
        here = image[plane, y : y + rows, x * part_row : (x + 1) * part_row]
        here[:] = part[: here.shape[0], : here.shape[1]]
    if planes > 1:
        if bits < 8:
            raise TiffError("planar samples of under 8 bits")
        image = image.reshape(planes, height, width, bits // 8).transpose(1, 2, 0, 3)
    return page | {"pixels": image.tobytes()}


def pages(data: bytes | None) -> Iterator[dict]:
    """A row for each page; see the module's text for what is undefined there."""
    if not data:
        return
    n = 0
    try:
        for order, tags in directories(data):
            row = dict.fromkeys(("width", "height", "bits", "samples", "compression", "predictor", "tiled", "pixels", "feature", "error")) | {"page": n}
            n += 1
            try:
                row |= decode_page(data, order, tags)
                row["feature"] = feature(row["pixels"], row["width"], row["height"])
            except (ValueError, TypeError, LookupError, ArithmeticError, MemoryError, zlib.error, struct.error) as e:
                row["error"] = str(e) or type(e).__name__
            yield row
    except (TiffError, struct.error) as e:
        yield dict.fromkeys(("width", "height", "bits", "samples", "compression", "predictor", "tiled", "pixels", "feature")) | {"page": n, "error": str(e)}


def feature(pixels: bytes, width: int, height: int) -> str:
    """Size, mean, deviation and entropy of the bytes, and their counts in 16 equal ranges."""
    counts = np.bincount(np.frombuffer(pixels, np.uint8), minlength=256)
    n, values = len(pixels), np.arange(256)
    mean = int((counts * values).sum()) / n
    spread = max(0.0, int((counts * values * values).sum()) / n - mean * mean) ** 0.5
    p = counts[counts > 0] / n
    return f"{width}x{height} mean={mean:.4f} sd={spread:.4f} entropy={abs(float(-(p * np.log2(p)).sum())):.4f} hist={','.join(map(str, counts.reshape(16, 16).sum(axis=1).tolist()))}"


# ---------------------------------------------------------------- writing


def encode(images: list[dict], order: str = "<") -> bytes:
    """A file of pages: pixels, width, height, and optionally bits, samples, compression, predictor (1 or 2),
    rows (a strip) or tile (width, height)."""
    out = bytearray((b"II*\0" if order == "<" else b"MM\0*") + bytes(4))
    link = 4
    for im in images:
        width, height, bits, samples = im["width"], im["height"], im.get("bits", 8), im.get("samples", 1)
        compression, predictor, tile = im.get("compression", NONE), im.get("predictor", 1), im.get("tile")
        kind = np.dtype(f"<u{bits // 8}")
        values = np.frombuffer(im["pixels"], kind).reshape(height, width, samples)
        wide, high = tile or (width, im.get("rows", height))
        parts = []
        for y in range(0, height, high):
            for x in range(0, width, wide):
                part = values[y : y + high, x : x + wide]
                if tile:
                    part = np.pad(part, ((0, high - part.shape[0]), (0, wide - part.shape[1]), (0, 0)))
                if predictor == 2:
                    part = np.concatenate([part[:, :1], np.diff(part, axis=1)], axis=1)
                parts.append(_pack(compression, part.astype(kind.newbyteorder(order)).tobytes(), wide * samples * bits // 8))
        places = []
        for p in parts:
            places.append(len(out))
            out += p
        tags = [(WIDTH, 4, [width]), (HEIGHT, 4, [height]), (BITS, 3, [bits] * samples), (COMPRESSION, 3, [compression]), (PHOTOMETRIC, 3, [1 if samples < 3 else 2]), (SAMPLES, 3, [samples]), (PREDICTOR, 3, [predictor]), (SAMPLE_FORMAT, 3, [1] * samples)]
        if tile:
            tags += [(TILE_WIDTH, 4, [wide]), (TILE_HEIGHT, 4, [high]), (TILE_OFFSETS, 4, places), (TILE_BYTES, 4, [len(p) for p in parts])]
        else:
            tags += [(STRIP_OFFSETS, 4, places), (ROWS_PER_STRIP, 4, [high]), (STRIP_BYTES, 4, [len(p) for p in parts])]
        entries = b""
        for tag, kind_code, numbers in sorted(tags):
            raw = struct.pack(f"{order}{len(numbers)}{TYPES[kind_code]}", *numbers)
            if len(raw) > 4:
                out += bytes(len(out) % 2)
                value, raw = struct.pack(order + "I", len(out)), raw
                out += raw
            else:
                value = raw.ljust(4, b"\0")
            entries += struct.pack(order + "HHI", tag, kind_code, len(numbers)) + value
        out += bytes(len(out) % 2)
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(tags)) + entries + bytes(4)
        link = len(out) - 4
    return bytes(out)


ROW, ROWS = 64, 1024


def payload_of(text: bytes | None) -> bytes:
    """Bytes 0 appended up to a positive multiple of 64."""
    text = text or b""
    return text + bytes(-len(text) % ROW if text else ROW)


def encode_payload(payload: bytes) -> bytes:
    """One page, 64 samples wide, in deflated strips of differences."""
    return encode([{"pixels": payload, "width": ROW, "height": len(payload) // ROW, "rows": ROWS, "compression": DEFLATE, "predictor": 2}])


# ---------------------------------------------------------------- columns


def _flushed(rows: Iterator[tuple[int, tuple]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """rows: (bytes, row).  Batches of about BATCH_BYTES."""
    held, size = [], 0
    turn = lambda: pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), schema, strict=True)], schema=schema)
    for n, row in rows:
        held.append(row)
        size += n
        if size >= BATCH_BYTES or len(held) >= 4096:
            yield turn()
            held, size = [], 0
    if held:
        yield turn()


def text_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each whole text as a TIFF file."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def run(batches):
        def rows():
            for batch in batches:
                for key, text in zip(batch.column(0), batch.column(1)):
                    text = text.as_py()
                    media = encode_payload(payload_of(text))
                    yield len(media), (key.as_py(), len(text or b""), media)

        yield from _flushed(rows(), schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def tiff_pages(files: DataFrame, media: str = "media") -> DataFrame:
    """All columns of files but media's bytes as a struct column ``file``, and a row a page (see PAGE), with the
    length and SHA-256 of the file."""
    others = [c for c in files.columns if c != media]
    packed = files.select(F.struct(*(files[f"`{c}`"] for c in others)).alias("file"), F.col(media).cast("binary").alias("media"))
    kind = packed.schema["file"].dataType.simpleString()
    names = [x.split()[0] for x in PAGE.split(", ")]
    types = {"int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(), "string": pa.string()}

    def run(batches):
        for batch in batches:
            held: list = []
            size = 0
            for at in range(batch.num_rows):
                data = batch.column(1)[at].as_py()
                for p in pages(data):
                    held.append((at, p))
                    size += len(p["pixels"] or b"")
                if held and (size >= BATCH_BYTES or at == batch.num_rows - 1):
                    own = batch.take(pa.array([i for i, _ in held]))
                    yield pa.RecordBatch.from_arrays(
                        [own.column(0), own.column(1), *(pa.array([p[n] for _, p in held], types[t]) for n, t in (x.split() for x in PAGE.split(", ")))],
                        names=["file", "media", *names],
                    )
                    held, size = [], 0

    read = packed.mapInArrow(run, f"file {kind}, media binary, {PAGE}")
    return read.select("file", F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), *names)


def media_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature of each
    document, from the pixels of its page as read back.  Null text: as empty, a payload of 64 zeros."""
    return tiff_pages(text_media(docs)).select(
        "file.doc_id",
        "file.n_bytes",
        F.length("pixels").cast("long").alias("payload_bytes"),
        F.sha2("pixels", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(pixels, -64, 64)")).alias("tail_crc32"),
        "media_bytes",
        "media_sha256",
        "feature",
    )
