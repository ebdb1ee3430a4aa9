"""Product-quantisation codes of vectors in whole numbers.

Vectors become whole numbers, are cut into equal parts, and every part position learns a codebook by rounds of
nearest-entry assignment. Codebooks are small (parts x entries x width) and broadcast; Arrow batches compute all
distances of a batch by norm expansion and exact int64 matrix products and take the first least one. Each task
sends its sums by entry once, a grouped shuffle merges them, and the driver divides parts x entries rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespan.llm.common import materialize, table

SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
#: Magnitude of a component beyond which squared distances might not fit a long.
LARGEST = 2**18
#: Vectors that are compared with the codebooks at once.
BLOCK = 2048


def kept_vectors(vectors: DataFrame, parts: int = PARTS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, label, vector array<double>) of the rows that can be cut: all components there and finite, and as many as the first such row has.

    The first row is that of the smallest vec_id whose length is a positive multiple of ``parts``; rows of other lengths are left out like broken ones.
    """
    v = F.col("vector")
    # NaN counts as the largest number
    finite = v.isNotNull() & (F.array_max(v) < float("inf")) & (F.array_min(v) > float("-inf")) & ~F.exists(v, lambda x: x.isNull())
    named = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    whole = named.filter(finite & (F.size(v) % parts == 0))
    first = whole.orderBy(F.col("vec_id").asc_nulls_last(), "vector").select(F.size("vector").alias("n")).limit(1).collect()
    return whole.filter(F.size(v) == (first[0]["n"] if first else 0))


def _integers(batch: pa.RecordBatch, scale: int) -> np.ndarray:
    """floor(scale * x) of a batch whose last column is the vectors."""
    lists = batch.column(batch.num_columns - 1)
    values = np.floor(lists.flatten().to_numpy(zero_copy_only=False) * scale)
    if len(values) and np.abs(values).max() > LARGEST * SCALE:
        raise ValueError(f"a component is beyond {LARGEST * SCALE // scale}: its squared distances may not fit a long")
    return values.astype(np.int64).reshape(batch.num_rows, len(values) // max(1, batch.num_rows))


def _nearest(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of the nearest entry of each part: (n, parts) each; ties go to the lower index."""
    parts, _, width = books.shape
    norms = (books * books).sum(axis=2)
    codes, errors = np.empty((len(x), parts), dtype=np.int64), np.empty((len(x), parts), dtype=np.int64)
    for p in range(parts):
        part = np.ascontiguousarray(x[:, p * width : (p + 1) * width])
        far = norms[p] - 2 * (part @ books[p].T)
        codes[:, p] = at = far.argmin(axis=1)
        errors[:, p] = np.take_along_axis(far, at[:, None], axis=1)[:, 0] + (part * part).sum(axis=1)
    return codes, errors


def train_codebooks(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> np.ndarray:
    """Codebooks (parts, entries, width) of ``kept_vectors``: the parts of the smallest vec_ids, then ``rounds`` of assignment and mean.

    Fewer rows than ``entries`` give as many entries as rows; rows of one vec_id are ordered by their vectors, null ids come last.
    An entry becomes floor(sum / count) of its parts, by component; an entry without parts stays.
    """
    spark = kept.sparkSession
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()
    if not first:
        return np.zeros((parts, 0, 0), dtype=np.int64)
    x = np.floor(np.array([r["vector"] for r in first], dtype=np.float64) * scale).astype(np.int64)
    books = np.ascontiguousarray(x.reshape(len(first), parts, -1).transpose(1, 0, 2))
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(books)

        def sums(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            books = shared.value
            parts, n, width = books.shape
            total, count = np.zeros((parts * n, width), dtype=np.int64), np.zeros(parts * n, dtype=np.int64)
            for batch in batches:
                rows = _integers(batch, scale)
                for at in range(0, len(rows), BLOCK):
                    block = rows[at : at + BLOCK]
                    cells = (_nearest(block, books)[0] + np.arange(parts) * n).ravel()
                    count += np.bincount(cells, minlength=parts * n)
                    for k in range(width):  # sums of a block stay below 2**53, so float sums are exact
                        total[:, k] += np.bincount(cells, weights=block[:, k::width].ravel(), minlength=parts * n).astype(np.int64)
            used = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(count[used]), pa.array(list(total[used]), pa.list_(pa.int64()))], names=["cell", "n", "total"])

        width = books.shape[2]
        wide = [F.sum(F.get("total", F.lit(k)).cast("decimal(20,0)")).alias(f"s{k}") for k in range(width)]
        merged = kept.select("vector").mapInArrow(sums, "cell long, n long, total array<bigint>").groupBy("cell").agg(F.sum("n").alias("n"), *wide).collect()  # parts x entries rows
        books = books.copy()
        for r in merged:
            books[r["cell"] // books.shape[1], r["cell"] % books.shape[1]] = [int(r[f"s{k}"]) // r["n"] for k in range(width)]
        shared.unpersist()
    return books


def encode_vectors(kept: DataFrame, books: np.ndarray, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, code, error): the nearest entry of every part, two hex digits each (more if there are over 256 entries), and the sum of squared distances."""
    spark = kept.sparkSession
    shared = spark.sparkContext.broadcast(books)
    picked = kept.select("vec_id", "label", "vector")
    fields = picked.schema.fields[:2]
    digits = max(2, len(f"{max(0, books.shape[1] - 1):x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        spelled = np.array([f"{i:0{digits}x}".encode() for i in range(books.shape[1])])
        for batch in batches:
            rows = _integers(batch, scale)
            for at in range(0, len(rows), BLOCK):
                codes, errors = _nearest(rows[at : at + BLOCK], books)
                text = spelled[codes].view(f"S{digits * books.shape[0]}").ravel().astype(str)
                part = batch.slice(at, len(text))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(text, pa.string()), pa.array(errors.sum(axis=1), pa.int64())], names=["vec_id", "label", "code", "error"])

    return picked.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", code string, error long")


def compress_vectors(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """Codes and errors of every vector that can be cut (``kept_vectors``), with the error of its label and a digest of the codebooks.

    Returns vec_id, code, error, label_error (error summed over rows of the same label, nulls together), codebooks_sha256; one row per kept
    row, repeated rows each their own. An empty table, or one without a kept row, gives no rows. Columns of other names are not read. A
    component whose whole number is beyond 2**26 in magnitude is an error, as squares might not fit a long.
    """
    kept = kept_vectors(vectors, parts, id_col, vector_col, label_col)
    books = train_codebooks(kept, parts, entries, rounds, scale)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    coded = materialize(encode_vectors(kept, books, scale), "codes")
    by_label = coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(20,0)")).cast("long").alias("label_error")).withColumnRenamed("label", "of")
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress_vectors(table(spark, sf_dir, "embeddings"))


def _assigned(book: str) -> str:
    """SQL of each row's nearest entry by part under a codebook relation (part, entry, pos, c)."""
    return f"(SELECT r, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (SELECT x.r, x.part, b.entry, sum((x.v - b.c) * (x.v - b.c)) AS d FROM x JOIN {book} b ON b.part = x.part AND b.pos = x.pos GROUP BY ALL) GROUP BY r, part)"


def _learned(book: str) -> str:
    mean = "SELECT a.part, a.entry, x.pos, CAST(sum(x.v) AS HUGEINT) AS s, count(*) AS n FROM {a} a JOIN x ON x.r = a.r AND x.part = a.part GROUP BY ALL".format(a=_assigned(book))
    # // cuts towards zero
    return f"SELECT b.part, b.entry, b.pos, CAST(coalesce(m.s // m.n - CASE WHEN m.s < 0 AND m.s % m.n <> 0 THEN 1 ELSE 0 END, b.c) AS BIGINT) AS c FROM {book} b LEFT JOIN ({mean}) m USING (part, entry, pos)"


OP13_SQL = f"""
WITH e AS (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label, embedding FROM embeddings
           WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
x AS MATERIALIZED (SELECT r, (i - 1) // 4 AS part, (i - 1) % 4 AS pos, CAST(floor(256 * CAST(embedding[i] AS DOUBLE)) AS BIGINT) AS v FROM (SELECT r, embedding, unnest(range(1, 65)) AS i FROM e)),
b0 AS MATERIALIZED (SELECT part, r - 1 AS entry, pos, v AS c FROM x WHERE r <= 64),
b1 AS MATERIALIZED ({_learned("b0")}),
b2 AS MATERIALIZED ({_learned("b1")}),
a AS MATERIALIZED {_assigned("b2")},
coded AS (SELECT r, string_agg(lpad(hex(entry), 2, '0'), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a GROUP BY r),
sha AS (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY part, entry, pos)) AS h FROM b2)
SELECT vec_id, lower(code) AS code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM coded JOIN e USING (r), sha
"""
