"""A Kneser-Ney model that one process holds whole, with back-off by look-up: what the operator's sums are held against."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespan.llm.quality_rules import _END, _START, CACHE_ENTRIES, ORDER, level_probabilities

#: Names in the hash arrays are known by so many bits of their hash.
SLOT_BITS = 64


def kneser_ney(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """(name, value, weight): log probabilities 'p<order>:lang:gram' and log back-off weights 'b<order>:lang:context'."""
    named = None
    for k, (here, back) in enumerate(level_probabilities(counts, order), 1):
        both = here.select(F.concat_ws(":", F.lit(f"p{k}"), "lang", "g").alias("name"), F.log("p").alias("value"), F.col("c").cast("double").alias("weight")).unionByName(
            back.select(F.concat_ws(":", F.lit(f"b{k}"), "lang", "ctx").alias("name"), F.log("value").alias("value"), F.col("total").cast("double").alias("weight"))
        )
        named = both if named is None else named.unionByName(both)
    return named


def hash_arrays(named: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and their values, of a model that one process holds whole."""
    got = named.select(F.xxhash64("name").alias("slot"), F.col("value").cast("float").alias("value")).toArrow()
    slots, values = got.column("slot").to_numpy().view(np.uint64), got.column("value").to_numpy().astype(np.float32)
    at = np.argsort(slots)
    return slots[at], values[at]


class NgramScorer:
    """Log probability of words from the hash arrays, with back-off; remembers n-grams and words."""

    def __init__(self, slots: np.ndarray, values: np.ndarray, order: int, slot_bits: int):
        import xxhash

        self.slots, self.values, self.order, self.mask = slots, values, order, (1 << slot_bits) - 1
        self.digest = xxhash.xxh64_intdigest
        self.grams: dict[str, dict[str, float]] = {}
        self.words: dict[str, dict[bytes, tuple[float, int]]] = {}

    def look(self, name: str) -> float | None:
        slot = self.digest(name.encode(), seed=42) & self.mask
        i = int(np.searchsorted(self.slots, np.uint64(slot)))
        return float(self.values[i]) if i < len(self.slots) and self.slots[i] == slot else None

    def gram(self, lang: str, gram: str) -> float:
        """Log probability of the last character after those before it."""
        total = 0.0
        for k in range(len(gram), 0, -1):
            part = gram[len(gram) - k :]
            p = self.look(f"p{k}:{lang}:{part}")
            if p is not None:
                return total + p
            b = self.look(f"b{k}:{lang}:{part[:-1]}")
            total += b if b is not None else 0.0
        return total if total < 0 else -20.0

    def word(self, lang: str, word: bytes) -> tuple[float, int]:
        memo, n = self.grams.setdefault(lang, {}), self.order
        marked = _START * (n - 1) + word.decode("utf-8", "replace") + _END
        total = 0.0
        for i in range(len(marked) - n + 1):
            g = marked[i : i + n]
            p = memo.get(g)
            if p is None:
                if len(memo) >= CACHE_ENTRIES:
                    memo.clear()
                p = memo[g] = self.gram(lang, g)
            total += p
        return total, len(marked) - n + 1

    def log_perplexity(self, lang: str, words: list[bytes]) -> float:
        """Mean negative log probability of a word, over words of two characters or more, or of all if none is so long; 0 without words."""
        memo = self.words.setdefault(lang, {})
        total, n = 0.0, 0
        for w in [w for w in words if len(w.decode("utf-8", "replace")) > 1] or words:
            got = memo.get(w)
            if got is None:
                if len(memo) >= CACHE_ENTRIES:
                    memo.clear()
                got = self.word(lang, w)
                if len(w) <= 64:
                    memo[w] = got
            total += got[0]
            n += 1
        return -total / n if n else 0.0
