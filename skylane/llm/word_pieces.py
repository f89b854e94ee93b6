"""Token ids of whole texts under a tokenizer file of the tokenizers library, with repeated words encoded once.

The files meant here drop white space and never merge across it, so a text's ids are those of its
blank- or line-separated chunks one after another. A chunk that is a run of Latin letters with an
optional tail of marks is put to the file's merge model directly; every other chunk goes through the
whole tokenizer. ``tests/llm`` compares both with the library's own answer for whole texts.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator

import pyarrow as pa

# Chunks that one worker remembers in each of two generations; when the young one is full it becomes the old one.
REMEMBERED = 700_000
# Characters of the longest chunk that is remembered; a text without blanks is one chunk, and is not kept.
LONGEST_REMEMBERED = 64
_TAILS = ".,;:!?%*$#&|"
_loaded: dict[str, WordPieces] = {}


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordPieces(dict):
    """Maps a chunk to its ids as little-endian unsigned 32-bit bytes, filling itself on demand."""

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        with open(path, encoding="utf-8") as f:
            settings = json.load(f)
        kinds = [n["type"] for n in settings["normalizer"]["normalizers"]]
        if kinds != ["NFC", "Replace", "Lowercase"] or settings["pre_tokenizer"]["pretokenizers"][0]["behavior"] != "Removed":
            raise ValueError("this file does not drop white space, so its texts cannot be encoded by chunks")
        self.letters = byte_letters()
        self.old: dict[str, bytes] = {}

    def __missing__(self, chunk: str) -> bytes:
        if len(chunk) > LONGEST_REMEMBERED:
            return self.encoded(chunk)
        if len(self) >= REMEMBERED:
            self.old = dict(self)
            self.clear()
        ids = self.old.get(chunk)
        if ids is None:
            ids = self.encoded(chunk)
        self[chunk] = ids
        return ids

    def encoded(self, chunk: str) -> bytes:
        word = chunk.rstrip(_TAILS)
        plain = word.lower()
        # Letters below U+0250 are composed; those whose lower case is not one letter fail the second test.
        if not word.isalpha() or not plain.isalpha() or not (word.isascii() or max(word) < "ɐ"):
            return array("I", self.whole.encode(chunk, add_special_tokens=False).ids).tobytes()
        if plain != chunk:
            return self[plain] + (self[chunk[len(word):]] if len(word) < len(chunk) else b"")
        mapped = word if word.isascii() else "".join(map(self.letters.__getitem__, word.encode()))
        return array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()

    def ids(self, text: str | None) -> bytes:
        """The whole text's ids as little-endian unsigned 32-bit bytes."""
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" "))) if text else b""


def load(path: str) -> WordPieces:
    """One instance per worker process and file."""
    if path not in _loaded:
        _loaded[path] = WordPieces(path)
    return _loaded[path]


def default_file() -> str:
    """The word-piece file among the installed public vocabularies."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def arrow_batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)


def id_and_text(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    for batch in batches:
        yield batch.column(0).to_pylist(), batch.column(1).to_pylist()
