"""A training corpus from raw documents, as operators of ``tallyforge.llm`` in order.

Each stage takes (spark, docs, sf_dir), docs being what the stage before kept, and returns a
DataFrame; ``run`` writes each as Parquet in the shared folder and rereads it for the next.
All but the last return the columns of ``documents``, and any others that came with them, whatever
their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from tallyforge.llm import near_dup, packing, quality_model, quality_rules, secret_scan
from tallyforge.llm.shared import save, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the model scores below 0.7. It learns from the labelled rows of its input. Null and
    empty texts get the intercept's score; rows are judged one by one, repeated ones each."""
    return quality_model.good(docs, quality_model.train(docs, table(spark, sf_dir, "labels")))


def repetition_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts that are short or repeat themselves, null and empty ones too; repeated rows are
    judged each, and texts of any length whole."""
    return quality_rules.passing(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: five words, a similarity of 0.8. Of repeated
    rows one stays; rows that repeat an id with other texts are judged each; rows without an id or
    without words all stay."""
    return near_dup.deduplicated(docs, size=5, percent=80)


def secret_masking(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets in the texts; each row stays, and null texts stay null."""
    return secret_scan.redacted(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids packed into sequences of at most 1024: a row for each piece. A null or empty text is
    its end id; repeated rows are packed each."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=True)


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", repetition_rules),
    ("near dedup", near_dedup),
    ("secret scan", secret_masking),
    ("best-fit packing", best_fit_packing),
]
#: No stage but the secret scan could be put in SQL; the tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
