"""The training-corpus pipeline: five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame over Parquet that
it has written to the shared folder, so a stage depends on no shuffle file or
executor of the one before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lamina.llm import decontaminate, jaccard_join, langid, mixing, pii
from lamina.llm.storage import cut, remove, scratch, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or near no learned language, go."""
    with scratch(spark) as keep:
        return keep(cut(langid.keep_known(docs), "language_id"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that link at a Jaccard similarity of 0.8, the one with the least id stays."""
    with scratch(spark) as keep:
        return keep(cut(jaccard_join.deduplicate(docs), "near_duplicates"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    with scratch(spark) as keep:
        return keep(cut(decontaminate.clean(docs, table(spark, sf_dir, "benchmark")), "decontamination"))


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced in the text, and n_chars follows it."""
    with scratch(spark) as keep:
        return keep(cut(pii.redact(docs), "private_data"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often each document's words are taken into the mix."""
    with scratch(spark) as keep:
        return keep(cut(mixing.mix(docs)[0], "source_mix"))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("private_data", private_data),
    ("source_mix", source_mix),
]

#: No SQL expresses the stages; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        before, docs = getattr(docs, "cut_path", None), stage(spark, docs, sf_dir)
        if before:
            remove(spark, before)
    return docs
