"""Token ids by the public tokenizer files, with a bounded cache of words.

Byte-pair merges never cross a pre-token, and in both files a single space (or line break) between two other
characters always begins a pre-token or is dropped.  So a text is cut there, and each distinct word goes to
the tokenizers library once while it is in the cache.  Texts with other white space, or runs of it, go to
the library whole where the cut would not be safe.  Ids come as bytes, little-endian unsigned 32-bit.
Batches keep their words in Arrow (Known), at some 40 bytes a word; a Python dictionary takes 240.
"""

from __future__ import annotations

import os
import re
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Words of either generation of a cache; when the young one is full, it becomes the old one.
CACHED = 1 << 19
#: Letters or numbers, then stops: a pre-token ends between the two.
STOPS = ".,!?;:"
STOPPED = re.compile(rf"([^\W_]+)([{STOPS}]+)")
#: Those that Arrow tells from their stops: of ASCII and the Latin letters up to U+017E, but U+0130, whose lower case has a mark after the i.
PLAIN = "".join(c for c in map(chr, range(0x17F)) if c.isalpha() and c != "\u0130" or c.isascii() and c.isdigit())
#: Bytes of words and ids that a batch leaves for the next one.
KNOWN_BYTES = 16 << 20
#: White space but spaces and line breaks.
OTHER_SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n")
#: Texts, after a mark, that go to the library whole where white space has tokens.
UNSAFE = rf"\A.[ \n]|[ \n]\z|[ \n][ \n]|(?s:.)[{OTHER_SPACES}]"


def _byte_letters() -> dict[int, str]:
    """The letter by which byte-level vocabularies name each byte: itself where it is printable, else from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in set(shown))}


BYTE_LETTERS = _byte_letters()


class _Words(dict):
    """word -> bytes of the ids of before + word.  stops: where the ids of stops alone are found."""

    def __init__(self, encode, before: str, fold: bool, stops: dict | None = None):
        super().__init__()
        self.encode, self.before, self.fold, self.old = encode, before, fold, {}
        self.stops = self if stops is None else stops

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHED * (3 if self.fold else 2) // 2:  # one cache where white space is dropped, two where it has tokens
            self.old = dict(self)
            self.clear()
        ids = self.old.get(word)
        if ids is None:
            if self.fold and word.isascii() and "<|" not in word and (low := word.lower()) != word:
                ids = self[low]
            elif (m := STOPPED.fullmatch(word)) and (not self.fold or m[1].lower().isalnum()):
                ids = self[m[1]] + self.stops[m[2]]
            else:
                ids = self.encode(word, self.before)
        self[word] = ids
        return ids


class Encoder:
    """path: a tokenizers file.  spaces: whether white space has tokens (byte-level) or is dropped."""

    OTHER_SPACE = re.compile(r"[^\S \n]")
    CONTROL_SPACE = re.compile("[\x1c-\x1f]")  # white space to Python's split, not to the tokenizer

    def __init__(self, path: str, spaces: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merge, self.lower, self.spaces = self.tokenizer.model.tokenize, not spaces, spaces
        self.first = _Words(self.word, "", fold=not spaces)  # the file that drops white space also lower-cases
        self.rest = _Words(self.word, " ", False, self.first)
        self.known = Known()
        self.encode = self._spaced if spaces else self._dropped
        self.line = self.whole("\n") if spaces else b""

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def word(self, word: str, before: str) -> bytes:
        """Letters alone are one pre-token and go to the model as its byte letters; all else goes through the whole tokenizer."""
        if word.isalpha() and unicodedata.is_normalized("NFC", word):
            low = word.lower() if self.lower and "\u03a3" not in word else word  # a last sigma is lower-cased by its place
            if not self.lower or low.isalpha() and (low != word or low == low.lower()):
                letters = (before + low).encode().decode("latin-1").translate(BYTE_LETTERS)
                return array("I", [t.id for t in self.merge(letters)]).tobytes()
        return self.whole(before + word)

    def _spaced(self, text: str) -> bytes:
        if not text:
            return b""
        if text[0] in " \n" or text[-1] in " \n" or "  " in text or "\n\n" in text or " \n" in text or "\n " in text or self.OTHER_SPACE.search(text):
            return self.whole(text)
        parts = []
        rest = self.rest.__getitem__
        for line in text.split("\n"):
            words = line.split(" ")
            parts += (self.line, self.first[words[0]], *map(rest, words[1:]))
        return b"".join(parts[1:])

    def _dropped(self, text: str) -> bytes:
        if self.CONTROL_SPACE.search(text):
            return self.whole(text)
        return b"".join(map(self.first.__getitem__, text.split()))

    def fresh(self, word: str) -> bytes:
        """Ids of a word, kept by nothing but the model.  Where white space has tokens, the word follows a space, or begins with
        a mark: \\r at the begin of a text, \\n for a line break before it."""
        if self.spaces:
            mark, bare = word[: word[:1] in ("\r", "\n")], word.lstrip("\r\n")
            m, before = STOPPED.fullmatch(bare), "" if mark else " "
            return (self.line if mark == "\n" else b"") + (self.word(m[1], before) + self.first[m[2]] if m else self.word(bare, before))
        if word.isascii() and word.isalpha():  # its letters name themselves
            return array("I", [t.id for t in self.merge(word.lower())]).tobytes()
        m = STOPPED.fullmatch(word)
        return self.word(m[1], "") + self.first[m[2]] if m and m[1].lower().isalnum() else self.word(word, "")

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array and the number of each text's.  Texts are cut at single spaces and line breaks alone,
        which is safe everywhere where white space is dropped; where it has tokens, texts with other white space go whole."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if self.spaces:
            return self._batch_spaced(texts)
        # replacing comes first: it makes an array of its own, and lower-casing a slice of another reads wrong offsets
        texts = pc.replace_substring(texts, "\n", " ")
        if not pc.any(pc.match_substring(texts, "<|")).as_py():
            texts = pc.ascii_lower(texts)  # unless that could spell a special token
        flat, ends = self._words_of(pc.split_pattern(texts, " "))
        return flat, np.diff(ends)

    def _batch_spaced(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        mark, end = (pa.scalar(x, pa.large_string()) for x in ("\r", ""))
        texts = pc.binary_join_element_wise(mark, texts, end)
        hard = pc.match_substring_regex(texts, UNSAFE)
        safe = pc.replace_substring(pc.if_else(hard, mark, texts), "\n", " \n")
        pieces = Pieces(*self._words_of(pc.split_pattern(safe, " ")))
        which, hard = np.arange(len(texts)), pc.indices_nonzero(hard).to_numpy()
        if len(hard):
            which[hard] = len(texts) + np.arange(len(hard))
            pieces = Pieces(*pieces.and_more([self.whole(t[1:]) for t in texts.take(pa.array(hard)).to_pylist()]).spread(which))
        return pieces.flat, np.diff(pieces.ends)

    def _words_of(self, cut: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all lists of words, and where each list's end.  Words are told apart by Arrow, without the stops after them:
        only those that aren't known from the batches before become Python's."""
        coded = cut.flatten().dictionary_encode()
        words = coded.dictionary
        tails = pc.utf8_ltrim(words, characters="\r\n" * self.spaces + PLAIN)
        stems = pc.ascii_rtrim(words, characters=STOPS)
        stopped = pc.equal(pc.ascii_rtrim(tails, characters=STOPS), "")
        if self.spaces:  # stops alone are one pre-token with the space before them
            stopped = pc.and_(stopped, pc.not_equal(stems, ""))
        stems = pc.if_else(stopped, stems, words).dictionary_encode()
        tails = pc.if_else(stopped, tails, "").dictionary_encode()
        at, pieces = self.known.look_up(stems.dictionary, self.fresh)
        which = np.empty(2 * len(words), np.int64)
        which[::2] = at[stems.indices.to_numpy(zero_copy_only=False)]
        which[1::2] = len(pieces) + tails.indices.to_numpy(zero_copy_only=False)
        pieces = pieces.and_more([self.first[w] for w in tails.dictionary.to_pylist()])
        flat, ends = pieces.spread(which)
        flat, ends = Pieces(flat, ends[::2]).spread(coded.indices.to_numpy(zero_copy_only=False))
        return flat, ends[cut.offsets.to_numpy()]


class Pieces:
    """Runs of ids in one array; run k is flat[ends[k] : ends[k + 1]]."""

    def __init__(self, flat: np.ndarray, ends: np.ndarray):
        self.flat, self.ends = flat, ends

    def __len__(self) -> int:
        return len(self.ends) - 1

    def and_more(self, ids: list[bytes]) -> Pieces:
        ends = self.ends[-1] + np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)) // 4)
        return Pieces(np.concatenate([self.flat, np.frombuffer(b"".join(ids), "<u4")]), np.concatenate([self.ends, ends]))

    def spread(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The runs named by which, one after the other, and their ends."""
        starts = self.ends[which]
        ends = np.concatenate([[0], np.cumsum(self.ends[which + 1] - starts)])
        kind = np.int32 if max(len(self.flat), ends[-1]) < 1 << 31 else np.int64
        place = np.repeat((starts - ends[:-1]).astype(kind), np.diff(ends))
        place += np.arange(ends[-1], dtype=kind)
        return self.flat[place], ends


class Known:
    """Distinct words and their ids, of KNOWN_BYTES at most between two batches."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.words, self.pieces = pa.array([], pa.large_string()), Pieces(np.zeros(0, "<u4"), np.zeros(1, np.int64))

    def nbytes(self) -> int:
        return self.words.nbytes + self.pieces.flat.nbytes + self.pieces.ends.nbytes

    def look_up(self, words: pa.Array, encode) -> tuple[np.ndarray, Pieces]:
        """Where each of the distinct words stands in the pieces.  When all are too many, the words of this batch stay; when these are, none."""
        found = pc.index_in(words, value_set=self.words)
        new = words.filter(pc.is_null(found))
        at = pc.fill_null(found, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        at[at < 0] = len(self.words) + np.arange(len(new))
        self.words, self.pieces = pa.concat_arrays([self.words, new]), self.pieces.and_more([encode(w) for w in new.to_pylist()])
        pieces = self.pieces
        if self.nbytes() > KNOWN_BYTES:
            self.words, self.pieces = words, Pieces(*pieces.spread(at))
            if self.nbytes() > KNOWN_BYTES:
                self.clear()
        return at, pieces


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, spaces: bool) -> Encoder:
    """One for each worker process and file."""
    if (path, spaces) not in _ENCODERS:
        _ENCODERS[path, spaces] = Encoder(path, spaces)
    return _ENCODERS[path, spaces]
