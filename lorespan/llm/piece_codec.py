"""SentencePiece encoding and decoding by vectorised merge rounds.

Characters of many words lie in one flat numpy array of symbols. Each round finds the least pair rank of
every word (a segmented minimum), merges that pair at its leftmost places in all words at once, and compacts
the array; a word without a pair leaves. Merging several places of one word in one round is the same as one
after the other unless a merge makes a pair that would have come first, so a word's places after such a
merge wait for the next round. Decoding gathers the bytes of pieces from one flat table.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespan.llm.common import map_texts, read_bytes, table

MARK = "▁"
#: Distinct words that a worker remembers before it starts anew; characters of new words that are merged together; characters of texts that are cut into words together.
CACHE_ENTRIES, FLAT_CHARS, RUN_CHARS = 400_000, 1 << 17, 1 << 20
_SEGMENT = re.compile(f"{MARK}+[^{MARK}]*")
#: Words beyond this many characters are cut where no piece joins them, and aren't remembered.
LONG_WORD = 64
#: Symbols of characters without a piece start here; a pair of symbols is one whole number.
_CHAR, _SHIFT = 1 << 21, 22
_NONE = np.int32(np.iinfo(np.int32).max)
#: An odd multiplier near 2**64 divided by the golden ratio.
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _one_by_one(error: UnicodeError) -> tuple[str, int]:
    return "�", error.start + 1


codecs.register_error("lorespan-byte", _one_by_one)


class PieceCodec:
    """Ids of words, and texts of ids, under a byte-fallback BPE model without normalisation rules."""

    def __init__(self, model: bytes, cache_entries: int = CACHE_ENTRIES):
        import sentencepiece

        read = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = read.vocab_size()
        names = [read.id_to_piece(i) for i in range(size)]
        in_bytes = [i for i in range(size) if read.is_byte(i)]
        if len(in_bytes) != 256:
            raise ValueError("the model has no byte fallback")
        plain = [i for i in range(size) if not (read.is_control(i) or read.is_unknown(i) or read.is_byte(i) or read.is_unused(i))]
        if read.normalize("a  b ") != f"{MARK}a{MARK}{MARK}b{MARK}":
            raise ValueError("the model changes white space")
        pieces = {names[i]: i for i in plain}
        self.byte_ids = np.array(sorted(in_bytes, key=lambda i: int(names[i][3:5], 16)), dtype=np.int64)
        self.symbol = np.arange(0x110000, dtype=np.int64) + _CHAR
        for p, i in pieces.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i
        scores = np.array([read.get_score(i) for i in plain])
        rank_of = dict(zip(plain, np.unique(-scores, return_inverse=True)[1].tolist(), strict=True))
        made, near = {}, set()
        for p, i in pieces.items():
            for k in range(1, len(p)):
                near.add(ord(p[k - 1]) << 21 | ord(p[k]))
                left, right = self._known(p[:k], pieces), self._known(p[k:], pieces)
                if left is not None and right is not None:
                    made[left << _SHIFT | right] = i
        self._keep_pairs(made, rank_of)
        #: pairs of characters that lie next to each other in some piece: no merge crosses any other pair
        self.near = np.array(sorted(near), dtype=np.int64)
        texts = [b"" if read.is_control(i) else " ⁇ ".encode() if read.is_unknown(i) else bytes([int(names[i][3:5], 16)]) if read.is_byte(i) else names[i].replace(MARK, " ").encode() for i in range(size)]
        self.lengths = np.array([len(t) for t in texts], dtype=np.int64)
        self.offsets = np.cumsum(self.lengths) - self.lengths
        self.blob = np.frombuffer(b"".join(texts), dtype=np.uint8)
        self.leads = np.array([i in rank_of and names[i].startswith(MARK) for i in range(size)])
        self.controls = np.array([read.is_control(i) for i in range(size)])
        self.cache: dict[str, bytes] = {}
        self.cache_entries = cache_entries

    def _known(self, part: str, pieces: dict[str, int]) -> int | None:
        return pieces.get(part, int(self.symbol[ord(part)]) if len(part) == 1 else None)

    def _keep_pairs(self, made: dict[int, int], rank_of: dict[int, int]) -> None:
        """A hash table of pairs with open places: at most an eighth of it is full, so most look-ups see one place."""
        self.bits = max(4, (8 * len(made)).bit_length())
        size = 1 << self.bits
        self.pairs = np.full(size + 1, -1, dtype=np.int64)
        self.merged = np.zeros(size + 1, dtype=np.int64)
        self.ranks = np.full(size + 1, _NONE, dtype=np.int32)
        keys = np.array(sorted(made), dtype=np.int64)
        for key, at in zip(keys.tolist(), self._place(keys).tolist(), strict=True):
            while self.pairs[at] >= 0:
                at = (at + 1) & (size - 1)
            self.pairs[at], self.merged[at], self.ranks[at] = key, made[key], rank_of[made[key]]

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Place of each pair in the table, or the place behind it, which has no rank."""
        key = left << _SHIFT | right
        at = self._place(key)
        there = self.pairs[at]
        other = np.flatnonzero((there != key) & (there >= 0))
        while len(other):
            at[other] = (at[other] + 1) & ((1 << self.bits) - 1)
            there[other] = self.pairs[at[other]]
            other = other[(there[other] != key[other]) & (there[other] >= 0)]
        at[there != key] = 1 << self.bits
        return at

    def merge(self, words: list[str]) -> list[bytes]:
        """Ids of each word as little-endian signed 32-bit integers; words are merged apart from one another."""
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
        cut = np.ones(len(chars), dtype=bool)
        cut[1:] = owner[1:] != owner[:-1]
        if any(len(w) > LONG_WORD for w in words) and len(self.near):  # parts of long words that no piece joins need fewer rounds
            at = np.searchsorted(self.near, key := chars[:-1] << 21 | chars[1:])
            at[at == len(self.near)] = 0
            cut[1:] |= self.near[at] != key
        segment = np.cumsum(cut) - 1
        symbols, segments = self._rounds(self.symbol[chars], segment)
        owners = owner[np.flatnonzero(cut)][segments]
        ids, counts = self._bytes(symbols)
        ends = np.cumsum(np.bincount(owners, weights=counts, minlength=len(words)).astype(np.int64)) * 4
        flat = ids.astype("<i4").tobytes()
        return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)] if words else []

    def _rounds(self, sym: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge until no word has a pair; symbols and words in the order of words."""
        done: list[tuple[np.ndarray, np.ndarray]] = []
        none = len(self.pairs) - 1
        pair = np.full(len(sym), none)
        if len(sym):
            pair[:-1] = np.where(word[1:] == word[:-1], self._pair(sym[:-1], sym[1:]), none)
        while len(sym):
            rank = self.ranks[pair]
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            least = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.r_[starts, len(sym)]))
            open_ = least != _NONE
            if not open_.all():
                done.append((sym[~open_], word[~open_]))
                sym, word, pair, rank, least = (x[open_] for x in (sym, word, pair, rank, least))
                if not len(sym):
                    break
            at = np.flatnonzero(rank == least)
            # of places that overlap, every other one from the left
            begins = np.r_[True, np.diff(at) != 1]
            first = np.maximum.accumulate(np.where(begins, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - first) % 2 == 0]
            new = self.merged[pair[at]]
            at = at[self._until_overtaken(sym, word, least, at, new)]
            sym[at] = self.merged[pair[at]]
            stay = np.ones(len(sym), dtype=bool)
            stay[at + 1] = False
            # pairs that a merged symbol is the left or the right half of
            changed = np.zeros(len(sym), dtype=bool)
            changed[at] = True
            sym, word, pair, changed = sym[stay], word[stay], pair[stay], changed[stay]
            changed[:-1] |= changed[1:]
            again = np.flatnonzero(changed)
            pair[again] = none
            again = again[again + 1 < len(sym)]
            again = again[word[again] == word[again + 1]]
            pair[again] = self._pair(sym[again], sym[again + 1])
        if not done:
            return sym, word
        sym, word = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(word, kind="stable")
        return sym[order], word[order]

    def _until_overtaken(self, sym: np.ndarray, word: np.ndarray, least: np.ndarray, at: np.ndarray, new: np.ndarray) -> np.ndarray:
        """Which merges to make now: in each word those up to the first that makes a pair of no higher rank."""
        before, after = np.maximum(at - 1, 0), np.minimum(at + 2, len(sym) - 1)
        left = sym[before]
        joined = np.flatnonzero(np.diff(at) == 2) + 1
        left[joined] = new[joined - 1]
        overtaken = (at > 0) & (word[before] == word[at]) & (self.ranks[self._pair(left, new)] <= least[at])
        overtaken |= (at + 2 < len(sym)) & (word[after] == word[at]) & (self.ranks[self._pair(new, sym[after])] <= least[at])
        if not overtaken.any():
            return overtaken == overtaken
        words, firsts = np.unique(word[at[overtaken]], return_index=True)
        last = at[overtaken][firsts]
        k = np.minimum(np.searchsorted(words, word[at]), len(words) - 1)
        return (words[k] != word[at]) | (at <= last[k])

    def _bytes(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of symbols, characters without a piece as their bytes, and how many each symbol became."""
        counts = np.ones(len(symbols), dtype=np.int64)
        odd = np.flatnonzero(symbols >= _CHAR)
        if not len(odd):
            return symbols, counts
        spelled = [chr(int(c) - _CHAR).encode("utf-8", "surrogatepass") for c in symbols[odd]]
        counts[odd] = [len(b) for b in spelled]
        ids = np.repeat(symbols, counts)
        ids[ids >= _CHAR] = self.byte_ids[np.frombuffer(b"".join(spelled), dtype=np.uint8)]
        return ids, counts

    def _words(self, text: str) -> list[str]:
        """Words of a text, each without the mark that it starts with."""
        if not text:
            return []
        if text[0] != " " and "  " not in text and MARK not in text:
            return text.split(" ")
        return [w[1:] for w in _SEGMENT.findall(MARK + text.replace(" ", MARK))]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian signed 32-bit integers, without begin and end; the words of all texts that the worker has not met are merged together."""
        cut = [self._words(t) for t in texts]
        known, words = self.cache, set(chain.from_iterable(cut))
        fresh = list(words.difference(known))
        if len(known) + len(fresh) > self.cache_entries:
            known.clear()
            fresh = list(words)
        held, chars, long = [], 0, []
        for k, w in enumerate(fresh):
            held.append(w)
            chars += len(w)
            if len(w) > LONG_WORD:
                long.append(w)
            if chars >= FLAT_CHARS or k + 1 == len(fresh):
                known.update(zip(held, self.merge([MARK + w for w in held]), strict=True))
                held, chars = [], 0
        ids = [b"".join(map(known.__getitem__, words)) for words in cut]
        for w in long:
            del known[w]
        return ids

    def decode(self, ids: np.ndarray, starts: np.ndarray) -> list[str]:
        """Texts of rows of ids; ``starts`` has the place of each row's first id, and the end."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.lengths)):
            raise ValueError("an id is not in the vocabulary")
        lengths = self.lengths[ids]
        ends = np.r_[0, np.cumsum(lengths)]
        # a byte of text takes some 20 here, so callers pass runs
        places = np.repeat((self.offsets[ids] - ends[:-1]).astype(np.int32), lengths)
        places += np.arange(ends[-1], dtype=np.int32)
        data = self.blob[places].tobytes()
        controls, texts = np.flatnonzero(self.controls[ids]), []
        for i, j in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            # a control has no text, but bytes on its two sides are no one character
            inside = controls[np.searchsorted(controls, i) : np.searchsorted(controls, j)].tolist() if len(controls) else []
            runs = [data[ends[a] : ends[b]].decode("utf-8", "lorespan-byte") for a, b in zip([i, *inside], [*inside, j], strict=True)]
            while i < j and self.controls[ids[i]]:
                i += 1
            texts.append("".join(runs)[int(i < j and bool(self.leads[ids[i]])) :])
        return texts


_codecs: dict[int, PieceCodec] = {}


def codec(model: bytes) -> PieceCodec:
    """The worker's codec for a model file; one is kept at a time."""
    key = hash(model)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = PieceCodec(model)
    return _codecs[key]


def _runs(texts: list[str]) -> Iterator[list[str]]:
    """Texts in runs of about RUN_CHARS characters, at least one text each."""
    held, chars = [], 0
    for t in texts:
        held.append(t)
        chars += len(t)
        if chars >= RUN_CHARS:
            yield held
            held, chars = [], 0
    if held:
        yield held


def encode_pieces(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", decoded_col: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>): the model's ids of every whole text, without begin and end, one row per row of ``docs``.

    Null and empty texts have no ids. With ``decoded_col`` a further column of that name has the text that the ids decode to,
    made in the same worker. The model file is read on the driver and shipped with the tasks (its size is that of a vocabulary).
    Words are remembered up to ``CACHE_ENTRIES`` a worker; a very long word is merged whole.
    """
    model = read_bytes(model_path)

    def compute(texts: list[str]) -> list:
        use, flat, starts, decoded = codec(model), [], [np.zeros(1, dtype=np.int64)], []
        for run in _runs(texts):
            found = use.encode(run)
            flat.append(np.frombuffer(b"".join(found), dtype="<i4").astype(np.int32))
            ends = np.cumsum([len(x) // 4 for x in found])
            if decoded_col:
                decoded += use.decode(flat[-1].astype(np.int64), np.r_[0, ends])
            starts.append(starts[-1][-1] + ends)
        ids = pa.ListArray.from_arrays(pa.array(np.concatenate(starts).astype(np.int32)), pa.array(np.concatenate(flat)))
        return [ids, decoded] if decoded_col else [ids]

    return map_texts(docs, compute, [("ids", "array<int>")] + ([(decoded_col, "string")] if decoded_col else []), id_col, text_col)


def decode_pieces(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids", carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, carried columns, text): the texts of rows of ids, as the library's ``decode`` gives them.

    Null and empty arrays, and null ids in an array, add nothing; bytes that are no UTF-8 become U+FFFD one by one; an id outside the
    vocabulary is an error.
    """
    model = read_bytes(model_path)
    ids = F.array_compact(F.coalesce(F.col(ids_col).cast("array<int>"), F.array().cast("array<int>")))
    picked = encoded.select(F.col(id_col).alias("doc_id"), *carry, ids.alias("_ids"))
    kept = [f for f in picked.schema.fields if f.name != "_ids"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["`text` string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            starts = np.asarray(lists.offsets, dtype=np.int64)
            values = np.asarray(lists.values, dtype=np.int64)[starts[0] : starts[-1]] if batch.num_rows else np.zeros(0, dtype=np.int64)
            texts = codec(model).decode(values, starts - starts[0]) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[f.name for f in kept] + ["text"])

    return picked.mapInArrow(run, schema)


def _digest(ids: Column) -> Column:
    return F.sha2(F.array_join(ids.cast("array<string>"), ","), 256)


def op12_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    coded = encode_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), decoded_col="decoded")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), _digest(F.col("ids")).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
