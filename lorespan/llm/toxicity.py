"""Toxicity by averaged subword embeddings and a linear softmax.

A word is the bag of its character n-grams and itself, each hashed to a row of an embedding
table; a text is the average over its words, and a softmax over two classes reads it. Table
and softmax are trained jointly in numpy on a bounded labelled sample. A misspelling shares
most n-grams, so most vectors, with the word it stands for. As everything up to the softmax
is linear, a word adds a fixed amount to the class difference, which scoring remembers.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespan.llm.common import ROW_BATCH_BYTES, bounded_batches, discard, forget, map_texts, materialize, remembered, table
from lorespan.llm.learning import fold, labelled_sample, sigmoid

BUCKETS = 1 << 18
DIM = 16
SMALLEST, LARGEST = 3, 6
#: Labelled documents used at most, by class.
SAMPLE = {1: 2000, 0: 4000}
EPOCHS = 30
RATE = 1.0
#: Standard errors by which a row must differ between the classes, and the rows kept at least.
LEAST_Z, FEWEST_ROWS = 5.0, 200
#: Words that a worker remembers while it scores, about.
CACHE_ENTRIES = 400_000
#: Words whose rows a worker remembers while it makes bags.
BAG_ENTRIES = 100_000
_WORDS = re.compile(r"\w+")


def subwords(word: str) -> list[int]:
    """Rows of the table that a word averages."""
    marked = f"<{word}>"
    n = len(marked)
    grams = {marked} | {marked[i : i + k] for k in range(SMALLEST, LARGEST + 1) for i in range(n - k + 1)}
    return [zlib.crc32(g.encode()) % BUCKETS for g in grams]


class _Bags(dict):
    def __missing__(self, word: str) -> np.ndarray:
        if len(self) >= BAG_ENTRIES:
            self.clear()
        rows = np.array(subwords(word), dtype=np.int32)
        self[word] = rows
        return rows


def document_bag(text: str, bags: dict) -> tuple[np.ndarray, np.ndarray]:
    """(rows, weights) of a text: each word's share, spread over its rows."""
    words = _WORDS.findall(text.lower())
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    parts = [bags[w] for w in counts]
    rows = np.concatenate(parts)
    weights = np.concatenate([np.full(len(p), c / (len(p) * len(words))) for p, c in zip(parts, counts.values(), strict=True)])
    return tuple(x.astype(t) for x, t in zip(_grouped(rows, weights), (np.int32, np.float32), strict=True))


def _grouped(rows: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distinct, at = np.unique(rows, return_inverse=True)
    return distinct, np.bincount(at, weights=weights, minlength=len(distinct))


def informative(in_all: np.ndarray, in_1: np.ndarray, n: int, n1: int) -> np.ndarray:
    """Rows whose presence in documents differs between the classes by LEAST_Z standard errors or more.

    ``in_all`` and ``in_1``: documents, and documents of class 1, that have the row. Where fewer than
    FEWEST_ROWS differ so, the FEWEST_ROWS with the largest differences.
    """
    share = in_all / n
    z = np.abs(in_1 / n1 - (in_all - in_1) / (n - n1)) / np.sqrt(np.maximum(share * (1 - share), 1e-9) * (1 / n1 + 1 / (n - n1)))
    kept = (z >= LEAST_Z) & (in_all > 0)
    if kept.sum() < FEWEST_ROWS:
        kept = np.zeros(BUCKETS, dtype=bool)
        kept[np.argsort(-z, kind="stable")[:FEWEST_ROWS]] = True
    return kept


def gradients(table: np.ndarray, out: np.ndarray, bias: float, doc: np.ndarray, rows: np.ndarray, weights: np.ndarray, y: np.ndarray) -> tuple[float, tuple]:
    """Softmax loss of the documents and its gradients by table, class vectors and bias; (doc, row, weight) are the entries of the bags."""
    n = len(y)
    direction = out[:, 1] - out[:, 0]
    z = np.bincount(doc, weights=weights * (table @ direction)[rows], minlength=n) + bias
    loss = float((np.logaddexp(0, z) - y * z).mean())
    error = (sigmoid(z) - y) / n
    by_row = np.bincount(rows, weights=weights * error[doc], minlength=len(table))
    pull = table.T @ by_row
    return loss, (by_row[:, None] * direction[None, :], np.stack((-pull, pull), axis=1), error.sum())


def train(bags: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> tuple[np.ndarray, float]:
    """Train table, softmax and bias; returns each row's amount in the class difference, and the bias.

    Bags hold informative rows only; the others stay zero vectors. Weights are scaled to a common
    spread, so that rare n-grams can't be learnt by heart. The gradient of the softmax loss by a table
    row is the row's weighted sum of errors times the difference of the two class vectors.
    """
    rng = np.random.default_rng(seed)
    y = np.asarray(y, dtype=np.float64)
    if len(set(y.tolist())) < 2:  # nothing to tell apart
        return np.zeros(BUCKETS, np.float32), 4.0 * (2 * float(y[0]) - 1) if len(y) else 0.0
    n = len(bags)
    # the table holds the rows that bags have, so memory follows the rows kept and not the buckets
    used, rows = np.unique(np.concatenate([b[0] for b in bags]), return_inverse=True)
    size = len(used)
    weights = np.concatenate([b[1] for b in bags]).astype(np.float64)
    doc = np.repeat(np.arange(n), [len(b[0]) for b in bags]).astype(np.int32)
    spread = np.sqrt(np.bincount(rows, weights=weights**2, minlength=size) / n)
    scale = np.divide(1.0, spread * np.sqrt(max(1.0, len(rows) / n)), out=np.zeros(size), where=spread > 0)
    weights = weights * scale[rows]
    table, out, bias = rng.normal(0, 0.01, (size, DIM)), rng.normal(0, 0.3, (DIM, 2)), np.log(y.mean() / (1 - y.mean()))
    speed = [np.zeros_like(table), np.zeros_like(out), 0.0]
    for _ in range(epochs):
        for i, g in enumerate(gradients(table, out, bias, doc, rows, weights, y)[1]):
            speed[i] = 0.9 * speed[i] + g
        table -= RATE * speed[0]
        out -= RATE * speed[1]
        bias -= RATE * speed[2]
    amounts = np.zeros(BUCKETS, np.float32)
    amounts[used] = table @ (out[:, 1] - out[:, 0]) * scale
    return amounts, float(bias)


class ToxicityModel:
    """Scores texts; picklable, one megabyte."""

    def __init__(self, amounts: np.ndarray, bias: float):
        self.amounts, self.bias = amounts, bias
        self.key = zlib.crc32(amounts.tobytes())

    def word(self, word: str) -> float:
        return float(self.amounts[subwords(word)].mean())

    def score(self, text: str, memo) -> float:
        words = _WORDS.findall(text.lower())
        z = self.bias + (sum(map(memo.__getitem__, words)) / len(words) if words else 0.0)
        return float(sigmoid(z))


class _Memo(dict):
    """word -> its amount. When half of ``entries`` (CACHE_ENTRIES) are held they are set aside, and those met again come back."""

    def __init__(self, model: ToxicityModel, entries: int | None = None):
        super().__init__()
        self.model, self.entries, self.aside = model, entries, {}

    def __missing__(self, word: str) -> float:
        value = self.aside.get(word)
        if value is None:
            value = self.model.word(word)
        if len(word) <= 64:
            if len(self) >= (self.entries or CACHE_ENTRIES) // 2:
                self.aside = dict(self)
                self.clear()
            self[word] = value
        return value


def _memo(model: ToxicityModel, entries: int | None = None) -> _Memo:
    return remembered(("toxicity", model.key, *([entries] if entries else [])), lambda: _Memo(model, entries))


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", modulus: int = 5, held_out: int = 0, sample: dict[int, int] | None = None, id_col: str = "doc_id", text_col: str = "text") -> ToxicityModel:
    """Fit on at most ``sample[y]`` labelled documents of class y outside the held-out fold.

    Bags are made on the executors. Spark counts documents by row and class; the driver gets these counts (one
    line a row of the table at most) and then, of each document, the informative rows only. Without labelled
    rows every text scores 0.5, with one class only it gets that class.
    """
    picked = materialize(labelled_sample(docs, labels, label, modulus, held_out, SAMPLE if sample is None else sample, id_col, text_col), "sample")

    def present(texts: list[str]) -> list:
        forget()
        bags = _Bags()
        return [[document_bag(t, bags)[0] for t in texts]]

    rows = map_texts(picked, present, [("rows", "array<int>")], carry=("y",), most=ROW_BATCH_BYTES).select("y", F.explode("rows").alias("row"))
    counts = rows.groupBy("row").agg(F.count("*").alias("n"), F.sum("y").alias("n1")).toArrow()
    classes = {r["y"]: r["n"] for r in picked.groupBy("y").agg(F.count("*").alias("n")).collect()}
    in_all, in_1 = np.zeros(BUCKETS), np.zeros(BUCKETS)
    at = counts.column("row").to_numpy()
    in_all[at], in_1[at] = counts.column("n").to_numpy(), counts.column("n1").to_numpy()
    n, n1 = sum(classes.values()), classes.get(1, 0)
    kept = informative(in_all, in_1, n, n1) if 0 < n1 < n else np.zeros(BUCKETS, dtype=bool)

    def compute(texts: list[str]) -> list:
        bags = _Bags()
        made = [document_bag(t, bags) for t in texts]
        return [[m[0][kept[m[0]]].tobytes() for m in made], [m[1][kept[m[0]]].tobytes() for m in made]]

    got = map_texts(picked, compute, [("rows", "binary"), ("weights", "binary")], carry=("y",), most=ROW_BATCH_BYTES).orderBy("doc_id").toArrow()
    bags = [(np.frombuffer(r, np.int32), np.frombuffer(w, np.float32)) for r, w in zip(got.column("rows").to_pylist(), got.column("weights").to_pylist(), strict=True)]
    y = got.column("y").to_numpy()
    amounts, bias = train(bags, y)
    discard(picked)
    # the sample holds more of the rarer class than the labels do: shift the bias to their shares
    n = {r["y"]: r["n"] for r in labels.filter(fold(id_col, modulus) != held_out).groupBy(F.col(label).cast("int").alias("y")).agg(F.count("*").alias("n")).collect()}
    if 0 < y.sum() < len(y):
        bias += float(np.log(n[1] / n[0]) - np.log(y.sum() / (len(y) - y.sum())))
    return ToxicityModel(amounts, bias)


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1) of every whole text; null, empty and wordless texts score the bias alone."""

    def compute(texts: list[str]) -> list:
        memo = _memo(model)
        return [[model.score(t, memo) for t in texts]]

    return map_texts(docs, compute, [("score", "double")], id_col, text_col)


def remove_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5, text_col: str = "text", entries: int | None = None) -> DataFrame:
    """``docs`` without those that score ``threshold`` or more; all columns kept as they are. ``entries``: words that a worker remembers."""
    from pyspark.sql.functions import pandas_udf

    bounded_batches(docs.sparkSession, ROW_BATCH_BYTES)

    @pandas_udf("double")
    def score(texts):
        memo = _memo(model, entries)
        return texts.map(lambda t: model.score(t or "", memo)).astype(float)

    return docs.filter(score(F.col(f"`{text_col}`").cast("string")) < threshold)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    scored = score_toxicity(docs, model)
    return scored.select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
