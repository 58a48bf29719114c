import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kinmesh.llm.token_ids import Encoder, tokenizer_path

ENCODERS = {"byte_bpe_50k.json": True, "word_bpe_49k.json": False}
HARD = ["", "a", " a", "a ", "a\n\nb", "a \n b", "x y z", "don't we'll DON'T I'M", "tab\there", "<|endoftext|> x", "a <|endoftext|>b", "é é", "ΑΣ ΟΔΟΣ Σ", "İI ß İ.", "a\x1cb c", "\x1f", "日本語 テキスト", "á ́b", "😀 😀😀", "1234 5678 '12's", "a\r\nb", "<|startoftext|>", "  ", "A². Ⅷ, x.y. É, HI!! a_b. b_.", "ÀB ǅ ŉ ſt", " a b  c", "fi ﬁ ﬁx."]


@pytest.mark.parametrize("name", ENCODERS)
def test_same_as_whole(name, sf_dir):
    import pyarrow.parquet as pq

    e = Encoder(tokenizer_path(name), ENCODERS[name])
    for t in HARD + pq.read_table(f"{sf_dir}/documents.parquet").column("text").to_pylist():
        assert e.encode(t) == e.whole(t), t[:200]


@pytest.mark.parametrize("name", ENCODERS)
@settings(max_examples=80, deadline=None)
@given(text=st.text(st.one_of(st.sampled_from("ab Zé.,'\n\t!ΣİßſǺ"), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_any_text(name, text):
    e = _ENC.setdefault(name, Encoder(tokenizer_path(name), ENCODERS[name]))
    assert e.encode(text) == e.whole(text)


_ENC = {}


def test_small_cache(monkeypatch):
    from kinmesh.llm import token_ids

    monkeypatch.setattr(token_ids, "CACHED", 3)
    e = Encoder(tokenizer_path("word_bpe_49k.json"), False)
    text = "one Two three. four, five six seven! eight one two"
    assert e.encode(text) == e.whole(text) and len(e.first) <= 5


@settings(max_examples=40, deadline=None)
@given(texts=st.lists(st.one_of(st.none(), st.text(st.one_of(st.sampled_from("ab Zé.,'\n\t!ΣİßſǺ<|endoftxEND>"), st.characters(exclude_categories=["Cs"])), max_size=30)), max_size=6))
def test_batch(texts):
    import pyarrow as pa

    e = _ENC.setdefault("word_bpe_49k.json", Encoder(tokenizer_path("word_bpe_49k.json"), False))
    flat, sizes = e.batch(pa.array(texts, pa.string()))
    want = [e.whole(t or "") for t in texts]
    assert flat.astype("<u4").tobytes() == b"".join(want) and sizes.tolist() == [len(w) // 4 for w in want]


def test_batch_of_hard_texts():
    import pyarrow as pa

    e = _ENC.setdefault("word_bpe_49k.json", Encoder(tokenizer_path("word_bpe_49k.json"), False))
    for t in HARD + ["<|ENDOFTEXT|> A", "Á É ß"]:
        assert e.batch(pa.array(["pre", t]))[0].astype("<u4").tobytes() == e.whole("pre") + e.whole(t), t


@pytest.mark.parametrize("known", [0, 150, 1500, 1 << 20])
def test_batches_with_known_words(monkeypatch, known):
    """Words of earlier batches, kept, dropped for those of the last one, or all dropped."""
    import pyarrow as pa

    from kinmesh.llm import token_ids

    monkeypatch.setattr(token_ids, "KNOWN_BYTES", known)
    e = Encoder(tokenizer_path("word_bpe_49k.json"), False)
    for texts in (["one two. Three", None, "four,, five"], ["two three? six one.", ""], ["..."], [], [None], ["seven eight nine ten two two. élan élan! Öl. слово. 12."], HARD, ["one", " one.", "x" * 3000], HARD[::-1]):
        flat, sizes = e.batch(pa.array(texts, pa.string()))
        want = [e.whole(t or "") for t in texts]
        assert flat.astype("<u4").tobytes() == b"".join(want) and sizes.tolist() == [len(w) // 4 for w in want]
        assert e.known.nbytes() <= max(known, 8)


def test_every_plain_letter_ends_before_stops():
    import pyarrow as pa

    from kinmesh.llm.token_ids import PLAIN

    e = _ENC.setdefault("word_bpe_49k.json", Encoder(tokenizer_path("word_bpe_49k.json"), False))
    texts = [t for c in PLAIN + "\u0130\u00d7\u00f7" for t in (f"{c}.", f"a{c}!?", f"{c}{c}b;")] + ["<| " + PLAIN + "."]
    for some in (texts, texts[:-1]):
        assert e.batch(pa.array(some))[0].astype("<u4").tobytes() == b"".join(map(e.whole, some))


def test_memory_of_distinct_words_is_bounded():
    """300,000 distinct words leave less than the bound of known words and a little: a dictionary of them took 50 MB and more."""
    import random
    import tracemalloc

    import pyarrow as pa

    rng = random.Random(3)
    e = Encoder(tokenizer_path("word_bpe_49k.json"), False)
    e.batch(pa.array(["a word."]))
    held = pa.total_allocated_bytes()
    tracemalloc.start()
    try:
        for _ in range(10):
            e.batch(pa.array([" ".join("".join(rng.choices("abcdefghijklmnop", k=9)) + rng.choice(".,; ").strip() for _ in range(300)) for _ in range(100)]))
        grown = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - held
    finally:
        tracemalloc.stop()
    assert grown < 24e6


@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.one_of(st.none(), st.text(st.one_of(st.sampled_from("ab Zé.,'\n\t!ΣİßſǺ9<|endoftext|>"), st.characters(exclude_categories=["Cs"])), max_size=30)), max_size=6))
def test_spaced_batch(texts):
    import pyarrow as pa

    e = _ENC.setdefault("byte_bpe_50k.json", Encoder(tokenizer_path("byte_bpe_50k.json"), True))
    for some in (pa.array(texts, pa.string()), pa.array(["cut off", *texts, "too"], pa.string()).slice(1, len(texts))):
        flat, sizes = e.batch(some)
        want = [e.whole(t or "") for t in texts]
        assert flat.astype("<u4").tobytes() == b"".join(want) and sizes.tolist() == [len(w) // 4 for w in want]


@pytest.mark.parametrize("known", [0, 150, 1500, 1 << 20])
def test_spaced_batches_with_known_words(monkeypatch, sf_dir, known):
    import pyarrow as pa
    import pyarrow.parquet as pq

    from kinmesh.llm import token_ids
    from kinmesh.llm.token_ids import PLAIN

    monkeypatch.setattr(token_ids, "KNOWN_BYTES", known)
    e = Encoder(tokenizer_path("byte_bpe_50k.json"), True)
    docs = pq.read_table(f"{sf_dir}/documents.parquet").column("text").to_pylist()[:60]
    odd = ["one. two\n... three, ...\n. one.", "...", ". .", "\r", "\na", "a\n", "a\x85b", "a\u3000b", "a\n.b\nc.", "слово. 12.\nélan!", "x" * 3000, " ".join(f"{c}. a{c}!?\n{c}" for c in PLAIN + "\u0130")]
    for texts in (docs, HARD, odd, [], [None], [None, "", "one"], HARD[::-1], odd[::-1], docs):
        flat, sizes = e.batch(pa.array(texts, pa.string()))
        want = [e.whole(t or "") for t in texts]
        assert flat.astype("<u4").tobytes() == b"".join(want) and sizes.tolist() == [len(w) // 4 for w in want]
        assert e.known.nbytes() <= max(known, 8)
