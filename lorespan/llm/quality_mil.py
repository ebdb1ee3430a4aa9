"""Quality by attention-based multiple-instance learning.

A document is a bag of passages. Each passage is encoded by a small network over its words and
pairs of neighbouring words, hashed with signs into a vector, and over measures of its characters,
words and lines; gated attention weighs the passages; the weighted sum is scored. Labels are known
for documents only, and encoder, attention and score are learnt together from them, in numpy, on a
bounded sample.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespan.llm.common import map_texts, table
from lorespan.llm.learning import Adam, fold, labelled_sample, sigmoid

PASSAGE_WORDS = 100
HIDDEN, GATE = 16, 8
SAMPLE = {0: 3000, 1: 3000}
EPOCHS = 150
#: Weight decay of the encoder, which has most of the parameters.
DECAY = 1e-3
N_MEASURES = 17
#: Places of the vector that words and pairs of words are hashed into.
HASHED = 128
N_FEATURES = N_MEASURES + HASHED
CACHE_ENTRIES = 500_000

_CLASS = np.full(256, 7, dtype=np.uint8)  # 0 lower, 1 upper, 2 digit, 3 white space, 4 symbols, 5 ! and ?, 6 other ASCII, 7 beyond ASCII
_CLASS[:128] = 6
for _chars, _kind in (("abcdefghijklmnopqrstuvwxyz", 0), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), ("0123456789", 2), (" \t\n\r\x0b\x0c", 3), ("#*$%&|<>", 4), ("!?", 5)):
    for _c in _chars:
        _CLASS[ord(_c)] = _kind


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        value = zlib.crc32(word.encode())
        if len(word) <= 64:
            self[word] = value
        return value


_hashes = _Hashes()


def hashed_words(words: list[str], n: int) -> np.ndarray:
    """Of each of n passages, the words and neighbouring pairs in it: a signed count at the place of each one's hash, over the root of their number."""
    one = np.fromiter(map(_hashes.__getitem__, words), np.int64, len(words))
    two = (one[:-1] * 0x9E3779B1 + one[1:] * 0x85EBCA77) & 0xFFFFFFFF
    two = (two ^ (two >> 15)) * 0x2C1B3C6D & 0xFFFFFFFF
    at = np.arange(len(words)) // PASSAGE_WORDS
    hashes, rows = np.concatenate((one, two)), np.concatenate((at, at[:-1]))
    places = rows * HASHED + (hashes >> 8) % HASHED
    signed = np.bincount(places, weights=1.0 - 2.0 * ((hashes >> 28) & 1), minlength=n * HASHED).reshape(n, HASHED)
    return signed / np.sqrt(np.bincount(rows, minlength=n))[:, None]


def passages(text: str) -> np.ndarray:
    """Vector of each passage of PASSAGE_WORDS words, one row each; one row of zeros for a text without words.

    The last passage may be shorter. First the measures: shares of eight character classes, mean word length, distinct,
    immediately repeated and often repeated words, size, one-letter words, words already seen in
    earlier passages, repeated lines of the text, upper-case words. Then the hashed words and pairs.
    """
    words = text.split()
    if not words:
        return np.zeros((1, N_FEATURES))
    lines = [s for s in (x.strip() for x in text.split("\n")) if s]
    repeated_lines = 1.0 - len(set(lines)) / len(lines)
    n = -(-len(words) // PASSAGE_WORDS)
    out = np.zeros((n, N_FEATURES))
    out[:, N_MEASURES:] = hashed_words(words, n)
    seen: set[str] = set()
    for k in range(n):
        part = words[k * PASSAGE_WORDS : (k + 1) * PASSAGE_WORDS]
        data = np.frombuffer(" ".join(part).encode(), dtype=np.uint8)
        m, row = len(part), out[k]
        row[:8] = np.bincount(_CLASS[data], minlength=8) / len(data)
        distinct = set(part)
        row[8] = min(len(data) / m / 10, 5.0)
        row[9] = len(distinct) / m
        row[10] = sum(map(str.__eq__, part, part[1:])) / m
        row[11] = max(map(part.count, {part[0], part[m // 2], part[-1]})) / m
        row[12] = np.log1p(m) / 5
        row[13] = sum(len(w) == 1 for w in part) / m
        row[14] = len(distinct & seen) / len(distinct)
        row[15] = repeated_lines
        row[16] = sum(map(str.isupper, part)) / m
        seen |= distinct
    return out


class MilModel:
    """Encoder, gated attention and score; picklable, a few kilobytes."""

    def __init__(self, params: dict[str, np.ndarray], mean: np.ndarray, spread: np.ndarray):
        self.params, self.mean, self.spread = params, mean, spread

    def forward(self, x: np.ndarray, doc: np.ndarray, n: int) -> tuple:
        """x: measures of all passages, doc: their documents in ascending order, n: documents."""
        p = self.params
        xs = np.clip((x - self.mean) / self.spread, -6, 6)
        h = np.tanh(xs @ p["we"] + p["be"])
        t, s = np.tanh(h @ p["v"]), sigmoid(h @ p["u"])
        e = (t * s) @ p["a"]
        starts = np.searchsorted(doc, np.arange(n))
        w = np.exp(e - np.maximum.reduceat(e, starts)[doc])
        w /= np.add.reduceat(w, starts)[doc]
        z = np.add.reduceat(w[:, None] * h, starts, axis=0)
        return xs, h, t, s, w, z, z @ p["c"] + p["b"], starts

    def gradients(self, x: np.ndarray, doc: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Weighted logistic loss of the documents and its gradient by every parameter."""
        p = self.params
        xs, h, t, s, w, z, score, starts = self.forward(x, doc, len(y))
        loss = float((weight * (np.logaddexp(0, score) - y * score)).sum())
        d = (sigmoid(score) - y) * weight
        dz = d[:, None] * p["c"]
        dw = (h * dz[doc]).sum(axis=1)
        de = w * (dw - np.add.reduceat(w * dw, starts)[doc])
        dt, ds = de[:, None] * p["a"] * s * (1 - t * t), de[:, None] * p["a"] * t * s * (1 - s)
        dh = w[:, None] * dz[doc] + dt @ p["v"].T + ds @ p["u"].T
        dpre = dh * (1 - h * h)
        return loss, {"we": xs.T @ dpre, "be": dpre.sum(axis=0), "v": h.T @ dt, "u": h.T @ ds, "a": (t * s).T @ de, "c": z.T @ d, "b": np.array([d.sum()])}

    def scores(self, bags: list[np.ndarray]) -> np.ndarray:
        doc = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
        return sigmoid(self.forward(np.concatenate(bags), doc, len(bags))[6]) if bags else np.zeros(0)


def train(bags: list[np.ndarray], y: np.ndarray, epochs: int = EPOCHS, seed: int = 11, rate: float = 0.02) -> MilModel:
    """Learn from document labels, by full-batch Adam; classes weigh the same.

    With one class, or none, the model gives that class (or 0.5) whatever the text.
    """
    rng = np.random.default_rng(seed)
    y = np.asarray(y, dtype=np.float64)
    shapes = {"we": (N_FEATURES, HIDDEN), "be": (HIDDEN,), "v": (HIDDEN, GATE), "u": (HIDDEN, GATE), "a": (GATE,), "c": (HIDDEN,), "b": (1,)}
    params = {k: rng.normal(0, 1 / np.sqrt(s[0]), s) if k not in ("be", "b") else np.zeros(s) for k, s in shapes.items()}
    if len(set(y.tolist())) < 2:
        params["c"][:] = 0
        params["b"][:] = 4.0 * (2 * y[0] - 1) if len(y) else 0.0
        return MilModel(params, np.zeros(N_FEATURES), np.ones(N_FEATURES))
    x = np.concatenate(bags)
    doc = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    model = MilModel(params, x.mean(axis=0), x.std(axis=0) + 1e-3)
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    adam = Adam(params, rate)
    for _ in range(epochs):
        _, grads = model.gradients(x, doc, y, weight)
        adam.step({k: g + (DECAY if k == "we" else 1e-4) * params[k] for k, g in grads.items()})
    return model


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 4, held_out: int = 2, sample: dict[int, int] | None = None, id_col: str = "doc_id", text_col: str = "text") -> MilModel:
    """Fit on at most ``sample[y]`` labelled documents of class y outside the held-out fold; passages are measured on the executors."""
    picked = labelled_sample(docs, labels, label, modulus, held_out, SAMPLE if sample is None else sample, id_col, text_col)

    def compute(texts: list[str]) -> list:
        return [[passages(t).astype(np.float32).tobytes() for t in texts]]

    got = map_texts(picked, compute, [("bag", "binary")], carry=("y",)).orderBy("doc_id").toArrow()
    bags = [np.frombuffer(b, np.float32).reshape(-1, N_FEATURES) for b in got.column("bag").to_pylist()]
    return train(bags, got.column("y").to_numpy())


def score_quality(docs: DataFrame, model: MilModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1) of every whole text; null, empty and wordless texts are one passage of zeros."""

    def compute(texts: list[str]) -> list:
        return [model.scores([passages(t) for t in texts]).tolist()]

    return map_texts(docs, compute, [("score", "double")], id_col, text_col)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
