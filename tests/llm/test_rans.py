import random
import zlib
from collections import Counter

import numpy as np
import pytest

from kinmesh.llm import rans
from kinmesh.llm.token_ids import Encoder, tokenizer_path


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 1000, 32768, 100_001, 131_072])
@pytest.mark.parametrize("alphabet", [1, 3, 5000])
def test_block_round_trip(n, alphabet):
    rng = np.random.default_rng(n + alphabet)
    ids = np.minimum(rng.geometric(0.01, n) - 1, alphabet - 1).astype(np.uint32)
    table = rans.Table.of_counts(np.bincount(ids, minlength=alphabet))
    data = rans.encode_block(ids, table)
    got, size = rans.decode_block(memoryview(data + b"more"), table)
    assert size == len(data) and (got == ids).all()


def test_checkpoints_give_the_same_steps():
    rng = np.random.default_rng(0)
    ids = rng.integers(0, 900, 400_000).astype(np.uint32)
    table = rans.Table.of_counts(np.bincount(ids))
    data = memoryview(rans.encode_block(ids, table))
    lanes = rans.BLOCK.unpack_from(data)[1]
    for first, last in ((0, 10), (64, 70), (127, 129), (128, None), (130, 131), (50, 500)):
        got, _ = rans.decode_block(data, table, first, last)
        assert (got == ids[first * lanes : None if last is None else last * lanes]).all()


def test_size_is_near_the_entropy():
    rng = np.random.default_rng(1)
    ids = np.minimum(rng.zipf(1.3, 131_072), 40_000).astype(np.uint32)
    counts = np.bincount(ids)
    p = counts[counts > 0] / len(ids)
    assert len(rans.encode_block(ids, rans.Table.of_counts(counts))) < 1.1 * -(p * np.log2(p)).sum() * len(ids) / 8 + 40_000


def test_unknown_tokens_and_damage():
    table = rans.Table.of_counts(np.array([5, 0, 3]))
    ids = np.array([0, 1, 2, 70_000], dtype=np.uint32)
    data = rans.encode_segment([3, None], [1, 3], ids, table)
    keys, lengths, got = rans.decode_segment(data, table)
    assert keys == [3, None] and lengths == [1, 3] and (got == ids).all()
    for at in (9, 30, len(data) // 2, len(data) - 1):
        bad = bytearray(data)
        bad[at] ^= 1
        with pytest.raises(rans.RansError):
            rans.decode_segment(bytes(bad), table)
    with pytest.raises(rans.RansError):
        rans.decode_segment(data, rans.Table.of_counts(np.array([5, 1, 3])))


@pytest.mark.parametrize("segment", [50, 1 << 20])
def test_documents(spark, monkeypatch, segment):
    rng = random.Random(5)
    texts = [None, "", "One two", "Ünïcode\n\nlines İ.", "word " * 3000, "x\x1cy"] + ["".join(rng.choice("ab c.d") for _ in range(rng.randrange(60))) for _ in range(80)]
    rows = [(None if i % 20 == 3 else i * 7 % 60, t, 1, "e") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows + rows[:5], "doc_id long, text string, task int, ids string").repartition(3)
    monkeypatch.setattr(rans, "SEGMENT_TOKENS", segment)
    monkeypatch.setattr(rans, "SLICE_BYTES", segment)
    got = rans.token_file_report(df).collect()
    whole = Encoder(tokenizer_path(rans.TOKENIZER), False).whole
    want = Counter()
    for key, t, *_ in rows + rows[:5]:
        ids = whole(t or "") + b"\1\0\0\0"
        want[key, len(ids) // 4, zlib.crc32(ids)] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    got.sort(key=lambda r: r.start)
    assert [r.start for r in got] == [sum(r.n_tokens for r in got[:i]) for i in range(len(got))]
    keys = [r.doc_id for r in got]
    assert keys == sorted(keys, key=lambda k: (k is None, k or 0))
    assert rans.token_file_report(df.where("false")).collect() == []


def test_files_hold_the_format(spark, monkeypatch):
    """Binary files in the folder, read without Spark: segments in their places, with all documents in ascending order."""
    from pathlib import Path

    monkeypatch.setattr(rans, "SEGMENT_TOKENS", 40)
    monkeypatch.setattr(rans, "SLICE_BYTES", 60)
    df = spark.createDataFrame([(i, "some words and others " * (i % 9)) for i in range(200)], "doc_id long, text string").repartition(5)
    folder, table, _ = rans.write_files(df)
    files = sorted(Path(folder.removeprefix("file:")).glob("part-*"))
    found = {}
    for f in files:
        parts = list(rans.segments_of(f.read_bytes()))
        assert 0 < len(parts) <= rans.SEGMENTS and f.read_bytes()[:8] == rans.MAGIC
        found |= {(t, k): rans.decode_segment(data, table)[0] for t, k, data in parts}
    assert len(files) >= 4 and [x for place in sorted(found) for x in found[place]] == list(range(200))
    with pytest.raises(rans.RansError):
        list(rans.segments_of(files[0].read_bytes()[:-1]))
    with pytest.raises(rans.RansError):
        list(rans.segments_of(b"x" + files[0].read_bytes()))


def test_segments_end_inside_slices(spark, monkeypatch):
    """A slice of many segments' text gives segments that no document overfills: none is longer for being encoded with others."""
    monkeypatch.setattr(rans, "SEGMENT_TOKENS", 40)
    df = spark.createDataFrame([(i, "some words and others " * (i % 9)) for i in range(300)], "doc_id long, text string").repartition(5)
    got = rans.token_chunks(df, tokenizer_path(rans.TOKENIZER), 2).collect()
    longest = max(max(r.lengths) for r in got)
    assert all(sum(r.lengths) == r.n_tokens < 40 + longest and r.n_tokens - r.lengths[-1] < 40 for r in got)
    assert [k for r in sorted(got) for k in r.doc_ids] == list(range(300))
