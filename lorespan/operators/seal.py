"""K7: one digest a document over all rows of its package, made as sorted rows pass; and what a stored digest says about them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _part(value: Column, kind: str) -> Column:
    """A value as its length in bytes, a colon and its text; a hyphen for null. So no two rows of values read alike."""
    text = F.to_json(F.struct(value.alias("v"))) if kind.startswith(("array", "struct", "map")) else F.hex(value) if kind == "binary" else value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def sealed(sections: list[tuple[DataFrame, list[str]]], doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, digest): SHA-256 over a document's rows, section by section.

    Each section is a frame with the document's id and the columns that put a document's rows in order; all columns count, by name, and where
    rows tie in order the whole row decides. After each section comes its number of rows, so what moves between sections or is lost shows. A
    document's rows pass through one running digest, whatever their number, and the digest does not depend on partitions. Null ids are
    left out; a document in no section has no digest.
    """
    coded = []
    for n, (df, order) in enumerate(sections):
        columns = sorted(c for c in df.columns if c != doc_id)
        kinds = dict(df.dtypes)
        row = F.concat(*[_part(F.col(c), kinds[c]) for c in columns], F.lit(";"))
        # orders of sections differ in kind: numbers and texts are brought into one by their own sort inside the section
        place = F.struct(*[F.col(c) for c in order]) if order else F.struct(F.lit(0))
        coded.append(df.select(F.col(doc_id).alias("doc_id"), F.lit(n).alias("section"), *[(place if k == n else F.lit(None).cast(_struct(sections[k]))).alias(f"place{k}") for k in range(len(sections))], row.alias("row")))
    rows = reduce(DataFrame.unionByName, coded).filter("doc_id IS NOT NULL")
    kind = rows.schema["doc_id"].dataType.simpleString()
    laid = rows.repartition("doc_id").sortWithinPartitions("doc_id", "section", *[f"place{k}" for k in range(len(sections))], "row").select("doc_id", "section", "row")
    total = len(sections)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, section, count = None, None, 0, 0

        def ended() -> str:
            digest.update(b"".join(f"#{count if k == section else 0};".encode() for k in range(section, total)))
            return digest.hexdigest()

        for batch in batches:
            ids, out = batch.column(0).to_pylist(), []
            for doc, part, row in zip(ids, batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if digest is None or doc != now:
                    if digest is not None:
                        out.append((now, ended()))
                    now, digest, section, count = doc, hashlib.sha256(), 0, 0
                while section < part:
                    digest.update(f"#{count};".encode())
                    section, count = section + 1, 0
                digest.update(row.encode())
                count += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], batch.schema.field(0).type), pa.array([o[1] for o in out])], names=["doc_id", "digest"])
            last = batch.schema.field(0).type
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], last), pa.array([ended()])], names=["doc_id", "digest"])

    return laid.mapInArrow(run, f"doc_id {kind}, digest string")


def _struct(section: tuple[DataFrame, list[str]]) -> str:
    kinds = dict(section[0].dtypes)
    return "struct<" + ", ".join(f"`{c}`:{kinds[c]}" for c in section[1]) + ">" if section[1] else "struct<col1:int>"


def broken_seals(seals: DataFrame, stored: DataFrame) -> DataFrame:
    """(doc_id, fault): stored digests (doc_id, digest) that differ (CHANGED) or whose rows are gone (LOST), and rows that none was stored for (UNSEALED)."""
    both = stored.select("doc_id", F.col("digest").alias("was"), F.lit(True).alias("known")).join(seals.select("doc_id", "digest", F.lit(True).alias("there")), "doc_id", "full")
    fault = F.when(F.col("there").isNull(), "LOST").when(F.col("known").isNull(), "UNSEALED").when(~F.col("was").eqNullSafe(F.col("digest")), "CHANGED")
    return both.select("doc_id", fault.alias("fault")).filter("fault IS NOT NULL")
