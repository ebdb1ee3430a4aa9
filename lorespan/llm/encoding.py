"""Token ids of whole texts by the tokenizers library, with a bounded memory of words.

Both pre-tokenisers in use never join what a single space parts, so the ids of a text are
those of its space-bounded chunks, one after the other. A worker asks the library once for
each chunk it has not met; a text with anything unusual between its words, or with a special
token's string in it, goes to the library whole.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from array import array

from lorespan.llm.common import remembered

#: White space other than space and newline; texts with it go to the library whole.
_ODD_SPACE = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f"
_ODD_WIDE = frozenset("\x85\xa0\u1680\u180e\u2028\u2029\u202f\u205f\u2060\u3000\ufeff") | frozenset(map(chr, range(0x2000, 0x2010)))
#: Byte symbols, by the rule of byte-level vocabularies: printable bytes stand for themselves, the others for characters from 256 on, in order.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_OTHERS = [b for b in range(256) if b not in _PRINTABLE]
_SYMBOLS = {b: chr(b) for b in _PRINTABLE} | {b: chr(256 + i) for i, b in enumerate(_OTHERS)}
#: What the pre-tokeniser that drops white space makes of lower-cased characters below U+0100: runs of letters, single digits, runs of others.
_PIECES = re.compile("[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^0-9a-zªµºß-öø-ÿ²³¹¼½¾]+")
#: Distinct chunks that a worker remembers before it starts anew.
CACHE_ENTRIES = 700_000


def _packed(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    data = array("I", ids)
    if sys.byteorder == "big":
        data.byteswap()
    return data.tobytes()


class _Ids(dict):
    """chunk -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, make, entries: int):
        super().__init__()
        self.make, self.entries = make, entries

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= self.entries:
            self.clear()
        value = self.make(chunk)
        if len(chunk) <= 64:
            self[chunk] = value
        return value


class Encoder:
    """``encode(text)`` gives the ids of a text as the library does, without added special tokens."""

    def __init__(self, tokenizer_json: bytes, entries: int = CACHE_ENTRIES):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_buffer(tokenizer_json)
        spec = json.loads(tokenizer_json)
        self.special = [a["content"] for a in spec.get("added_tokens") or []]
        self.marks = [s[:2] for s in self.special]
        normalizer, pre = spec.get("normalizer"), spec.get("pre_tokenizer") or {}
        steps = [n["type"] for n in (normalizer or {}).get("normalizers", [])]
        self.spaced = normalizer is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
        self.worded = steps == ["NFC", "Replace", "Lowercase"] and (pre.get("pretokenizers") or [{}])[0].get("behavior") == "Removed"
        self.lead = "Ġ" if self.spaced else ""
        self.bare = _Ids(self._bare, entries)
        self.after_space = _Ids(lambda w: self._split(w, " "), entries)
        self.newline = self._library("\n")

    def _library(self, text: str) -> bytes:
        return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _bare(self, word: str) -> bytes:
        return self._split(word, "")

    def _pre_token(self, word: str, lead: str) -> bytes:
        """Ids of what is one pre-token, such as letters only: its byte symbols go to the model."""
        symbols = word if word.isascii() and word.isprintable() else "".join(map(_SYMBOLS.__getitem__, word.encode()))
        return _packed([t.id for t in self.tokenizer.model.tokenize((self.lead if lead else "") + symbols)])

    def _split(self, word: str, lead: str) -> bytes:
        # beyond ASCII only letters that the normaliser leaves as they are
        plain = word.isascii() or (unicodedata.is_normalized("NFC", word) and word.lower() == word)
        if plain and word.isalpha():
            return self._pre_token(word, lead)
        if plain and word[-1:] in (",", ".") and word[:-1].isalpha():
            return (self.after_space if lead else self.bare)[word[:-1]] + self.bare[word[-1]]
        if self.worded and "'" not in word and max(word) < "\u0100":
            return b"".join([self.bare[p] if p.isalpha() else self._pre_token(p, "") for p in _PIECES.findall(word.lower())])
        return self._library(lead + word)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if any(m in text for m in self.marks) or any(c in text for c in _ODD_SPACE) or not (text.isascii() or _ODD_WIDE.isdisjoint(text)):
            return self._library(text)
        if self.worded:
            # lower-casing A to Z at first halves the number of distinct words
            return b"".join(map(self.bare.__getitem__, text.encode().lower().decode().split()))
        if self.spaced and len(text.split()) == text.count(" ") + text.count("\n") + 1:
            bare, spaced, lines = self.bare.__getitem__, self.after_space.__getitem__, []
            for line in text.split("\n"):
                chunks = line.split(" ")
                lines.append(bare(chunks[0]) + b"".join(map(spaced, chunks[1:])))
            return self.newline.join(lines)
        return self._library(text)


def encoder(tokenizer_json: bytes, entries: int = CACHE_ENTRIES) -> Encoder:
    """The worker's encoder for a tokenizer file, with so many chunks remembered at most; one is kept at a time."""
    return remembered(("encoder", hash(tokenizer_json), entries), lambda: Encoder(tokenizer_json, entries))
