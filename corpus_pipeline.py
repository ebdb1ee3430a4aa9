"""A training corpus from raw documents: stages that each work on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lorespan.llm import decontaminate, jaccard_join, packing, pii, toxicity
from lorespan.llm.common import ROW_BATCH_BYTES, materialize, table

#: Score from which a document is rejected.
TOXIC_AT = 0.5
#: Words that a worker remembers in a stage: fewer than the operators by themselves, as executors keep memory of earlier stages.
WORDS = 100_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the toxicity model rejects; the others stay as they are."""
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return toxicity.remove_toxic(docs, model, TOXIC_AT, entries=WORDS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group that a shingle similarity of 0.8 or more links."""
    return jaccard_join.deduplicate(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that benchmark passages contaminate; the others stay as they are."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def redact_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data in the texts; every document stays."""
    return pii.redact_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents into sequences: one row per piece."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), 0, entries=WORDS, most=ROW_BATCH_BYTES)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_copies),
    ("decontamination", drop_contaminated),
    ("pii", redact_personal),
    ("packing", pack),
]

#: A learnt classifier and a tokenizer are among the stages; SQL expresses neither.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
