"""Token ids of texts by a tokenizer file, through a cache of the ids of text pieces.

For a tokenizer whose normaliser is NFC, white-space folding and lower-casing, and whose words are runs of letters,
single numbers or runs of other signs, a text can be cut at white space and between an ASCII letter, digit or sign and
an ASCII character of another of these kinds without changing its ids; apostrophes and non-ASCII characters stay with
what is before them. Ids of such pieces are encoded once by the library and kept. Other tokenizers, and texts with the
strings of special tokens, go to the library whole.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

from recallgrid.llm.textscan import slices

_SIGN = re.escape("!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")
_NEUTRAL = r"'\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\U0010ffff"
_KIND = rf"(?:[a-z]+|[0-9]+|[{_SIGN}]+)"
_piece = re.compile(rf"{_KIND}(?:[{_NEUTRAL}]+{_KIND}?)*|[{_NEUTRAL}]+{_KIND}?(?:[{_NEUTRAL}]+{_KIND}?)*")
_CUTTABLE = ["NFC", "Replace", "Lowercase"]
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class Encoder:
    """Ids as arrays of ``dtype`` (two bytes where the vocabulary allows). most_bytes: of words, and pieces of words, kept."""

    def __init__(self, path: str, most_bytes: int = 192 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kinds = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        words = [p.get("pattern", {}).get("Regex") for p in (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        self.cuttable = kinds == _CUTTABLE and words[:1] == [_WORDS] and spec.get("post_processor") is None
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if size <= 0x10000 else "<u4")
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.most_bytes, self.held = most_bytes, 0

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [array(self.dtype.char, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def many(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each whole text, without special tokens. Give about a megabyte of text at a time."""
        cut: list[list[str] | None] = []
        for text in texts:
            if self.cuttable and not any(s in text for s in self.special):
                lowered = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
                cut.append(lowered.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" "))
            else:
                cut.append(None)
        new = set().union(*(c for c in cut if c is not None)).difference(self.words)
        if self.held > self.most_bytes:  # a slice adds at most what its own text needs
            self.words, self.pieces, self.held = {}, {}, 0
            new = set().union(*(c for c in cut if c is not None))
        self._learn(list(new))
        known = self.words
        return [np.frombuffer(b"".join([known[w] for w in c]) if c is not None else self._whole([t])[0], self.dtype) for t, c in zip(texts, cut, strict=True)]

    def ids(self, text: str) -> np.ndarray:
        return self.many([text])[0]

    def _learn(self, new: list[str]) -> None:
        """Add ids of new words, from the ids of their pieces; the library sees each new piece once."""
        cut = [_piece.findall(w) for w in new]
        unseen = list({p for ps in cut for p in ps}.difference(self.pieces))
        pieces, tokenize, code = self.pieces, self.tokenizer.model.tokenize, self.dtype.char
        plain = [p for p in unseen if p.isascii() and p.isalpha()]  # normaliser and pre-tokenizer leave these as they are
        pieces.update((p, array(code, [t.id for t in tokenize(p)]).tobytes()) for p in plain)
        other = list(set(unseen).difference(plain))
        pieces.update(zip(other, self._whole(other), strict=True))
        self.words.update((w, pieces[ps[0]] if len(ps) == 1 else b"".join([pieces[p] for p in ps])) for w, ps in zip(new, cut, strict=True))
        # About 150 bytes of a word beside its letters and ids: two objects and the place in the table.
        self.held += 3 * (sum(map(len, new)) + sum(map(len, unseen))) + 150 * (len(new) + len(unseen))


def text_slices(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of consecutive rows with about ``limit`` bytes; a null is an empty text."""
    for low, high, _, _ in slices(column, limit):
        yield low, [t or "" for t in column.slice(low, high - low).to_pylist()]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each file in a Python worker, kept over its tasks."""
    return Encoder(path)
