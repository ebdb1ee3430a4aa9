"""Uploaded files: which formats there are, whether a file is what it says, and delimited files of unknown encoding."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespan.sources.office import decode_text, detect_delimiter, inspect_package

# Fixed values: (format, endings, media types, bytes at most, kinds of places).
FORMATS = (
    ("PDF", (".pdf",), ("application/pdf",), 50 << 20, ("PAGE",)),
    ("TXT", (".txt",), ("text/plain",), 10 << 20, ("LINE_RANGE", "HEADING_BLOCK")),
    ("MARKDOWN", (".md", ".markdown"), ("text/markdown", "text/x-markdown", "text/plain"), 10 << 20, ("LINE_RANGE", "HEADING_BLOCK")),
    ("HTML", (".html", ".htm"), ("text/html", "application/xhtml+xml"), 10 << 20, ("DOM_PATH", "HEADING_BLOCK")),
    ("DOCX", (".docx",), ("application/vnd.openxmlformats-officedocument.wordprocessingml.document",), 50 << 20, ("PARAGRAPH", "TABLE_CELL")),
    ("PPTX", (".pptx",), ("application/vnd.openxmlformats-officedocument.presentationml.presentation",), 50 << 20, ("SLIDE_SHAPE", "TABLE_CELL")),
    ("XLSX", (".xlsx",), ("application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",), 50 << 20, ("CELL_RANGE",)),
    ("CSV", (".csv",), ("text/csv", "application/csv", "text/plain"), 10 << 20, ("CELL_RANGE",)),
)
# The main part of each office package, and limits of delimited files.
MAIN_PARTS = {"DOCX": "word/document.xml", "PPTX": "ppt/presentation.xml", "XLSX": "xl/workbook.xml"}
MOST_ROWS, MOST_COLUMNS, MOST_CELLS = 20_000, 128, 100_000


def format_registry(spark: SparkSession) -> DataFrame:
    """A3: (format, endings, media_types, most_bytes, places) of every format."""
    return spark.createDataFrame([(f, list(e), list(m), n, list(p)) for f, e, m, n, p in FORMATS], "format string, endings array<string>, media_types array<string>, most_bytes long, places array<string>")


def validate_uploads(files: DataFrame, registry: DataFrame) -> DataFrame:
    """A1: (path, format, sha256, fault): the format of each file, and what is wrong with it, null if nothing is.

    ``files``: (path, length, content, declared), declared being the media type that came with it. The ending names the format, the declared type
    (null and application/octet-stream tell nothing, but a PDF needs one) must be one of its types, the size within its limit, and the first bytes what the format has.
    Faults are fixed values.
    """
    from pyspark.sql.types import StringType

    ending = F.lower(F.regexp_extract("path", r"(\.[A-Za-z]+)$", 1))
    known = registry.select("format", F.explode("endings").alias("ending"), "media_types", "most_bytes")
    j = files.withColumn("ending", ending).join(F.broadcast(known), "ending", "left")  # one row an ending

    @F.pandas_udf(StringType())
    def inside(kinds: pd.Series, contents: pd.Series) -> pd.Series:
        def one(kind, data):
            if kind == "PDF":
                return None if data[:5] == b"%PDF-" else "FILE_SIGNATURE_INVALID"
            if kind not in MAIN_PARTS:
                return None
            fault = inspect_package(data)
            if fault:
                return fault
            import zipfile

            return None if MAIN_PARTS[kind] in zipfile.ZipFile(io.BytesIO(data)).namelist() else "FILE_SIGNATURE_INVALID"

        return pd.Series([one(k, bytes(c)) for k, c in zip(kinds, contents, strict=True)])

    silent = F.col("declared").isNull() | (F.trim("declared") == "") | (F.lower("declared") == "application/octet-stream")
    typed = F.when(silent, F.col("format") != "PDF").otherwise(F.array_contains("media_types", F.lower(F.trim(F.split_part("declared", F.lit(";"), F.lit(1))))))
    sniffed = F.when(F.hex(F.substring("content", 1, 4)) == "25504446", "PDF").when(F.hex(F.substring("content", 1, 4)) == "504B0304", "ZIP").otherwise("TEXT")
    wanted = F.when(F.col("format") == "PDF", "PDF").when(F.col("format").isin(*MAIN_PARTS), "ZIP").otherwise("TEXT")
    fault = (
        F.when(F.col("format").isNull(), F.lit("FILE_EXTENSION_INVALID"))
        .when(~typed, F.lit("FILE_MEDIA_TYPE_INVALID"))
        .when((F.col("length") == 0) | (F.col("length") > F.col("most_bytes")), F.lit("FILE_SIZE_INVALID"))
        .when(F.col("within").isNotNull(), F.col("within"))
        .when(sniffed != wanted, F.lit("FILE_CONTENT_TYPE_INVALID"))
    )
    return j.withColumn("within", inside("format", "content")).select("path", "format", F.sha2("content", 256).alias("sha256"), fault.alias("fault"))


def read_delimited(spark: SparkSession, path: str) -> DataFrame:
    """(path, row, cells, encoding, delimiter) of delimited files, each decoded and cut as its own bytes ask for.

    A file of more than 20,000 rows, 128 columns or 100,000 cells, or of no known encoding, gives one row numbered -1 whose cell tells why.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            made = []
            for name, data in zip(f["path"].tolist(), f["content"].tolist(), strict=True):
                text, encoding = decode_text(bytes(data))
                if not encoding and len(data):
                    made.append((name, -1, ["ENCODING_UNKNOWN"], "", ""))
                    continue
                delimiter = detect_delimiter(text)
                rows = [r for r in csv.reader(io.StringIO(text, newline=""), delimiter=delimiter) if any(c.strip() for c in r)]
                cells = sum(map(len, rows))
                if len(rows) > MOST_ROWS or cells > MOST_CELLS or max(map(len, rows), default=0) > MOST_COLUMNS:
                    made.append((name, -1, ["LIMIT_EXCEEDED"], encoding, delimiter))
                else:
                    made += [(name, i, r, encoding, delimiter) for i, r in enumerate(rows)]
            yield pd.DataFrame(made, columns=["path", "row", "cells", "encoding", "delimiter"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, row int, cells array<string>, encoding string, delimiter string")
