"""Token ids of whole texts with a public tokenizer, inside Spark tasks."""

from __future__ import annotations

import json
import os
import string
from array import array
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc

# The tokenizer file is a parameter everywhere; this is its public default.
TOKENIZER = "byte_bpe_50k.json"
END_ID = 0
# Words in each of the two generations that a worker remembers: when the younger is full it takes the place of
# the older, and words met again move back, so frequent words stay and the memory is bounded (some 400 bytes a word).
REMEMBERED = 375_000
# Texts of a batch that are looked at together, so that a batch is not held twice.
SLICE = 512
# Longer words are not remembered.
LONG = 64
# Where the tokenizer may join white space over a cut between words: two in a row, or a blank at the end.
DOUBLED = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]{2}| \z"

# Signs that end a word as one pre-token, whatever letters come before: ASCII but for the apostrophe, which contractions begin with.
SIGNS = string.punctuation.replace("'", "")
# Different runs of signs that a worker remembers.
RUNS = 10_000

_ENCODERS: dict[tuple[str, int], "Encoder"] = {}


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[int, str]:
    """Byte-level alphabet: printable Latin-1 bytes are themselves, the rest follow from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class _Words(dict):
    """Ids, as little-endian bytes, of a word with a blank before it, or of one that begins with a line end."""

    def __init__(self, tokenizer, code: str, remembered: int):
        super().__init__()
        self.older, self.remembered = {}, remembered
        self.tokenizer, self.model, self.code = tokenizer, tokenizer.model, code
        self.letters = byte_letters()
        self.runs: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _letters(self, word: str) -> bytes:
        """Ids of a word of letters, which is one pre-token, straight from the model."""
        return array(self.code, [t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(self.letters))]).tobytes()

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word) or self._new(word)
        if len(word) < LONG:
            if len(self) >= self.remembered:
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids

    def _run(self, signs: str) -> bytes:
        """Ids of a run of signs, or of a line end, which is one pre-token behind letters."""
        ids = self.runs.get(signs)
        if ids is None:
            ids = self.whole(signs)
            if len(self.runs) < RUNS and len(signs) < LONG:
                self.runs[signs] = ids
        return ids

    def _new(self, word: str) -> bytes:
        bare = word.rstrip(SIGNS)
        if bare.isalpha():
            return self._letters(" " + word) if bare == word else self[bare] + self._run(word[len(bare) :])
        if bare[:1] == "\n" and bare[1:].isalpha():
            return self._run("\n") + self._letters(bare[1:]) if bare == word else self[bare] + self._run(word[len(bare) :])
        return self.whole(word if word[:1] == "\n" else " " + word)


class Encoder:
    """Ids of a text as the tokenizer gives them, with ``add_special_tokens=False``.

    A byte-level BPE without normaliser never merges over a word's first blank or line end, so each word
    has the same ids in every text, and words are looked up before they are tokenised. Texts with two white
    spaces in a row, which may merge, and any other kind of tokenizer take the whole text at once.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.code = "H" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "I"
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        split = spec.get("pre_tokenizer") or {}
        self.by_word = (
            split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
            and not spec.get("normalizer") and spec["model"]["type"] == "BPE" and not spec["model"].get("dropout")
            and not spec["model"].get("ignore_merges")
        )
        self.words = _Words(self.tokenizer, self.code, remembered)

    def batch(self, texts: pa.Array) -> Iterator[array]:
        """Ids of each text in order, as an ``array``; null is empty text."""
        for at in range(0, len(texts), SLICE):
            some = pc.fill_null(texts[at : at + SLICE], "")
            joined = pc.match_substring_regex(some, DOUBLED).to_pylist() if self.by_word else [True] * len(some)
            for text, whole in zip(some, joined):
                text, out = text.as_py(), array(self.code)
                if whole:
                    out.frombytes(self.words.whole(text))
                else:
                    first, *words = text.replace("\n", " \n").split(" ")
                    out.frombytes(self.words.whole(first))
                    out.frombytes(b"".join(map(self.words.__getitem__, words)))
                yield out

    def ids(self, text: str | None) -> array:
        return next(self.batch(pa.array([text], pa.string())))


def encoder(path: str, remembered: int = REMEMBERED) -> Encoder:
    """The worker's encoder for a tokenizer file."""
    if (path, remembered) not in _ENCODERS:
        _ENCODERS[path, remembered] = Encoder(path, remembered)
    return _ENCODERS[path, remembered]


def forget(path: str, remembered: int = REMEMBERED) -> None:
    """The worker drops its encoder and the words it remembers."""
    _ENCODERS.pop((path, remembered), None)
