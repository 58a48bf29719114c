import random
import zlib

import pytest

from kinmesh.llm import tiff

CASES = [
    dict(compression=c, predictor=p, bits=b, samples=s, **lay)
    for c in (tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.DEFLATE_OLD, tiff.PACKBITS)
    for p in (1, 2)
    for b, s in ((8, 1), (8, 3), (16, 2), (32, 1))
    for lay in ({"rows": 5}, {"tile": (16, 16)})
]


@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize("order", "<>")
def test_round_trip(case, order):
    rng = random.Random(str(case))
    w, h = 37, 23
    n = w * h * case["samples"] * case["bits"] // 8
    pixels = b"".join(bytes([rng.randrange(256)]) * rng.randrange(1, 9) for _ in range(n))[:n]
    data = tiff.encode([case | {"pixels": pixels, "width": w, "height": h}] * 2, order)
    got = list(tiff.pages(data))
    assert [p["page"] for p in got] == [0, 1] and all(p["error"] is None for p in got)
    assert all(p["pixels"] == pixels and p["tiled"] == ("tile" in case) for p in got)


@pytest.mark.parametrize("n", [0, 1, 2, 300, 5000, 70000])
def test_lzw_and_packbits(n):
    rng = random.Random(n)
    for alphabet in (1, 2, 256):
        data = bytes(rng.randrange(alphabet) for _ in range(n))
        assert tiff.lzw_decode(tiff.lzw_encode(data)) == data
        assert tiff.packbits_decode(tiff.packbits_encode(data)) == data


def test_known_packbits():
    packed = bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA")
    assert tiff.packbits_decode(packed).hex() == "aaaaaa80002aaaaaaaaa80002a22" + "aa" * 10


def test_bad_files():
    assert list(tiff.pages(None)) == [] and list(tiff.pages(b"")) == []
    assert list(tiff.pages(b"no image"))[0]["error"]
    data = tiff.encode([{"pixels": bytes(64), "width": 8, "height": 8, "compression": tiff.DEFLATE}, {"pixels": bytes(64), "width": 8, "height": 8}])
    broken = bytearray(data)
    broken[8] ^= 255
    got = list(tiff.pages(bytes(broken)))
    assert got[0]["error"] and got[0]["pixels"] is None and got[1]["pixels"] == bytes(64)


def test_report(spark):
    import hashlib

    texts = [None, "", "a", "x" * 64, "é" * 33, "word " * 40000, "a"]
    df = spark.createDataFrame([(i, t, "page") for i, t in enumerate(texts)], "doc_id long, text string, file string")
    got = {r.doc_id: r for r in tiff.media_report(df).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + bytes(64 if not raw else -len(raw) % 64)
        assert got[i].n_bytes == len(raw) and got[i].payload_bytes == len(payload)
        assert got[i].payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert got[i].tail_crc32 == zlib.crc32(payload[-64:])
        assert got[i].media_sha256 == hashlib.sha256(tiff.encode_payload(payload)).hexdigest()
    assert got[2][1:] == got[6][1:]
    assert tiff.media_report(df.where("false")).collect() == []


def page(tags, body, order="<"):
    """A file of one page by hand: tags (tag, type, values), each of four bytes at most but for those put behind the body."""
    import struct

    out = bytearray((b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 8 + len(body)) + body)
    entries, more = b"", b""
    after = len(out) + 2 + 12 * len(tags) + 4
    for tag, kind, values in sorted(tags):
        raw = struct.pack(f"{order}{len(values)}{tiff.TYPES[kind]}", *values)
        if len(raw) > 4:
            raw, more = struct.pack(order + "I", after + len(more)), more + raw
        entries += struct.pack(order + "HHI", tag, kind, len(values)) + raw.ljust(4, b"\0")
    return bytes(out + struct.pack(order + "H", len(tags)) + entries + bytes(4) + more)


def gray(width, height, bits, compression, lengths, rows=None, **more):
    tags = {tiff.WIDTH: (3, [width]), tiff.HEIGHT: (3, [height]), tiff.BITS: (3, [bits]), tiff.COMPRESSION: (3, [compression]), tiff.STRIP_OFFSETS: (4, [8 + sum(lengths[:i]) for i in range(len(lengths))]), tiff.STRIP_BYTES: (4, lengths), tiff.ROWS_PER_STRIP: (4, [rows or height])}
    tags |= {getattr(tiff, k): v for k, v in more.items()}
    return [(t, *v) for t, v in tags.items()]


@pytest.mark.parametrize("change", [{"ROWS_PER_STRIP": (4, [0])}, {"WIDTH": (3, [])}, {"STRIP_BYTES": (4, [])}, {"SAMPLES": (3, [0])}, {"WIDTH": (4, [1 << 31]), "HEIGHT": (4, [1 << 31])}, {"PREDICTOR": (3, [3])}, {"PREDICTOR": (3, [9])}, {"COMPRESSION": (3, [7])}, {"TILE_OFFSETS": (4, [8]), "TILE_BYTES": (4, [64])}, {"TILE_OFFSETS": (4, [8]), "TILE_BYTES": (4, [64]), "TILE_WIDTH": (4, [0]), "TILE_HEIGHT": (4, [8])}])
def test_hostile_directories(change):
    got = list(tiff.pages(page(gray(8, 8, 8, tiff.NONE, [64], **change), bytes(64))))
    assert len(got) == 1 and got[0]["error"] and got[0]["pixels"] is None


def test_inflation_is_bounded():
    import zlib

    bomb = zlib.compress(bytes(50 << 20), 9)
    got = list(tiff.pages(page(gray(8, 8, 8, tiff.DEFLATE, [len(bomb)]), bomb)))
    assert got[0]["pixels"] == bytes(64) and len(tiff._unpack(tiff.DEFLATE, bomb, 64)) == 64
    for data, codec in ((tiff.lzw_encode(bytes(1 << 20)), tiff.LZW), (tiff.packbits_encode(bytes(1 << 20)), tiff.PACKBITS)):
        assert tiff._unpack(codec, data, 100) == bytes(100)


def test_lzw_of_another_writer():
    """The worked example of the format's text, its codes put together by hand."""
    codes, bits = [256, 7, 258, 8, 8, 258, 6, 6, 257], ""
    for c in codes:
        bits += f"{c:09b}"
    bits += "0" * (-len(bits) % 8)
    data = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8))
    assert tiff.lzw_decode(data) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])
    assert list(tiff.pages(page(gray(9, 1, 8, tiff.LZW, [len(data)]), data)))[0]["pixels"] == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])


@pytest.mark.parametrize("bits", [1, 2, 4])
def test_small_samples(bits):
    row = -(-5 * bits // 8)
    body = bytes(random.Random(bits).randrange(256) for _ in range(6 * row))
    got = list(tiff.pages(page(gray(5, 6, bits, tiff.NONE, [4 * row, 2 * row], rows=4), body)))[0]
    assert got["error"] is None and got["pixels"] == body and got["bits"] == bits


def test_planar_samples():
    red, green = bytes(range(12)), bytes(range(100, 112))
    tags = gray(4, 3, 8, tiff.NONE, [12, 12], SAMPLES=(3, [2]), BITS=(3, [8, 8]), PLANAR=(3, [2]))
    assert list(tiff.pages(page(tags, red + green)))[0]["pixels"] == bytes(x for p in zip(red, green) for x in p)


def test_floating_point_predictor():
    import struct

    values = [1.5, 1.75, -2.0, 300.25]
    planes = [bytes(struct.pack(">f", v)[k] for v in values) for k in range(4)]
    flat = b"".join(planes)
    stored = bytes([flat[0], *((b - a) % 256 for a, b in zip(flat, flat[1:]))])
    got = list(tiff.pages(page(gray(4, 1, 32, tiff.NONE, [16], PREDICTOR=(3, [3]), SAMPLE_FORMAT=(3, [3])), stored)))[0]
    assert struct.unpack("<4f", got["pixels"]) == tuple(values)


def test_feature_by_brute_force():
    import math
    from collections import Counter

    pixels = bytes(random.Random(1).choices(range(256), k=640))
    n, c = len(pixels), Counter(pixels)
    mean = sum(pixels) / n
    sd = (sum((x - mean) ** 2 for x in pixels) / n) ** 0.5
    hist = [sum(c[x] for x in range(16 * k, 16 * k + 16)) for k in range(16)]
    assert tiff.feature(pixels, 64, 10) == f"64x10 mean={mean:.4f} sd={sd:.4f} entropy={-sum(k / n * math.log2(k / n) for k in c.values()):.4f} hist={','.join(map(str, hist))}"
