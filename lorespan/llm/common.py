"""Shared pieces of the training-data operators.

Every operator reads an id column and a text column of the frame it is given and
nothing else, so further columns of any name cannot clash with its own. Unless an
operator says otherwise a null text counts as empty, ids are carried through
untouched (null ids too) and repeated rows each get their own result row.
"""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespan.shared import discard, materialize, shared_dir

__all__ = ["BATCH_BYTES", "ROW_BATCH_BYTES", "bounded_batches", "discard", "forget", "map_texts", "materialize", "read_bytes", "remembered", "shared_dir", "slices", "table"]

#: Bytes of text that one call of a per-batch function gets to see, unless one text alone is larger.
BATCH_BYTES = 16 << 20
#: Bytes of an Arrow batch beside which whole rows wait for what a function of their texts returns.
ROW_BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_remembered: dict = {}


def remembered(key: Hashable, make: Callable[[], object]):
    """What this worker remembers under ``key``, made if it isn't there.

    One thing is kept at a time: workers outlive a stage, so the words of several operators would add up.
    """
    if key not in _remembered:
        _remembered.clear()
        _remembered[key] = make()
    return _remembered[key]


def forget() -> None:
    """Let go of what this worker remembers: for work that remembers nothing itself, but would run beside it."""
    if _remembered:
        _remembered.clear()
        pa.default_memory_pool().release_unused()


def bounded_batches(spark: SparkSession, most: int = 2 * BATCH_BYTES) -> None:
    """Limit Arrow batches to ``most`` bytes, so that very long texts do not share one batch with thousands of rows.

    Spark reads this setting when the plan runs, after the operator has returned, so it stays set in the session.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most))


def slices(batches: Iterable[pa.RecordBatch], text_index: int = 1) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Cut Arrow batches into runs of rows with about BATCH_BYTES of text; null texts come as ''."""
    for batch in batches:
        rows = batch.num_rows
        if not rows:
            continue
        step = max(1, int(rows * BATCH_BYTES / max(1, batch.nbytes)))
        for at in range(0, rows, step):
            part = batch.slice(at, step)
            yield part, [t if t is not None else "" for t in part.column(text_index).to_pylist()]


def map_texts(
    docs: DataFrame,
    compute: Callable[[list[str]], list],
    fields: list[tuple[str, str]],
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: tuple[str, ...] = (),
    most: int = 2 * BATCH_BYTES,
) -> DataFrame:
    """One result row per row: the id, carried columns, then the columns that ``compute`` returns.

    ``compute`` gets a list of texts and returns one Python list (or Arrow array) per field; fields
    are (name, Spark type) pairs. Arrow batches are of ``most`` bytes.
    """
    bounded_batches(docs.sparkSession, most)
    picked = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(text_col).cast("string").alias("text"),
        *[F.col(c) for c in carry],
    )
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}
    kinds |= {f"array<{k}>": pa.list_(v) for k, v in list(kinds.items())}
    kept = [f for f in picked.schema.fields if f.name != "text"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"`{n}` {t}" for n, t in fields])
    names = [f.name for f in kept] + [n for n, _ in fields]
    types = [kinds[t] for _, t in fields]
    kept_at = [i for i, f in enumerate(picked.schema.fields) if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            columns = compute(texts)
            made = [c if isinstance(c, pa.Array) else pa.array(c, type=t) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(i) for i in kept_at] + made, names=names)

    return picked.mapInArrow(run, schema)


def read_bytes(path: str) -> bytes:
    """A small model file, read once on the driver and shipped inside the tasks."""
    with open(path, "rb") as f:
        return f.read()
