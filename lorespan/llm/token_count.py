"""Token counts by heap-and-linked-list byte-pair merging.

A text is cut at word marks that no vocabulary piece crosses; each distinct segment
starts as a linked list of characters and a heap of adjacent pairs that form a piece.
The pair of lowest rank is popped again and again and its two symbols become one. The
count is initial symbols minus merges, plus the bytes of characters the vocabulary
does not have. No identifiers are made.
"""

from __future__ import annotations

import heapq
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespan.llm.common import map_texts, read_bytes, table

MARK = "▁"
#: Distinct segments that a worker remembers before it starts anew.
CACHE_ENTRIES = 1_000_000
_SEGMENT = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


class PieceCounter:
    """Counts the pieces of a byte-fallback BPE model without making them."""

    def __init__(self, model: bytes, cache_entries: int = CACHE_ENTRIES):
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = processor.vocab_size()
        plain = [i for i in range(size) if not (processor.is_control(i) or processor.is_unknown(i) or processor.is_byte(i) or processor.is_unused(i))]
        #: piece -> rank; a higher score merges earlier
        self.rank = {processor.id_to_piece(i): -processor.get_score(i) for i in plain}
        if any(MARK in p.lstrip(MARK) for p in self.rank):
            raise ValueError("a piece crosses a word mark: segments cannot be counted apart")
        self.cache: dict[str, int] = _Memo(self.merge, cache_entries)

    def merge(self, segment: str) -> int:
        """Initial symbols minus merges of one segment, unknown characters as their bytes."""
        rank, n = self.rank, len(segment)
        symbols, before, after = list(segment), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = []
        for i in range(n - 1):
            pair = segment[i : i + 2]
            r = rank.get(pair)
            if r is not None:
                heap.append((r, i, pair))
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, left, pair = heapq.heappop(heap)
            here = symbols[left]
            if here is None or after[left] >= n:
                continue
            right = after[left]
            if len(here) + len(symbols[right]) != len(pair) or here + symbols[right] != pair:
                continue  # one of the two has changed since
            symbols[left], symbols[right] = pair, None
            merges += 1
            nxt = after[left] = after[right]
            if nxt < n:
                before[nxt] = left
                r = rank.get(joined := pair + symbols[nxt])
                if r is not None:
                    heapq.heappush(heap, (r, left, joined))
            prev = before[left]
            if prev >= 0:
                r = rank.get(joined := symbols[prev] + pair)
                if r is not None:
                    heapq.heappush(heap, (r, prev, joined))
        extra = sum(len(s.encode()) - 1 for s in symbols if s is not None and len(s) == 1 and s not in rank)
        return n - merges + extra

    def count(self, text: str) -> int:
        """Tokens of a text, with the model's leading mark and without begin and end."""
        if not text:
            return 0
        marked = text.replace(" ", MARK)
        memo = self.cache
        if MARK * 2 in marked or marked[0] == MARK:
            return sum(map(memo.__getitem__, _SEGMENT.findall(MARK + marked)))
        # every mark starts a segment of its own: cutting there is the same and cheaper
        total = sum(map(memo.__getitem__, [MARK + s for s in marked.split(MARK)])) if marked[-1] != MARK else None
        return total if total is not None else sum(map(memo.__getitem__, _SEGMENT.findall(MARK + marked)))


class _Memo(dict):
    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self.make(key)
        if len(key) <= 64:
            self[key] = value
        return value


_counters: dict[int, PieceCounter] = {}


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Bytes and tokens of every text under a sentencepiece BPE model.

    Returns doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit), one row per row of ``docs``.
    Null and empty texts have no bytes and no tokens. The model file is read on the driver and
    shipped with the tasks (its size is that of a vocabulary). Very long texts are whole.
    """
    model = read_bytes(model_path)

    def compute(texts: list[str]) -> list:
        key = hash(model)
        if key not in _counters:
            _counters.clear()
            _counters[key] = PieceCounter(model)
        count = _counters[key].count
        return [[len(t.encode()) for t in texts], [count(t) for t in texts]]

    counted = map_texts(docs, compute, [("n_bytes", "long"), ("n_tokens", "long")], id_col, text_col)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
