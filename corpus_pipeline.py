"""A corpus pipeline: language ID, near-dedup, decontamination, secret redaction and mixing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir), works on
all that the stage before kept, and is written as Parquet before the next one reads it.
All stages but the last return the columns of ``documents``.

Rejected: by language ID, texts that are null or have no letter, and those whose likeliest
language has a probability below ``LEAST_SCORE`` (with no labelled rows no language is
learned, and all texts with a letter pass); by near-dedup, all but
the smallest doc_id of each group; by decontamination, documents of which more than half
is benchmark text (from others the passages are cut). Secrets are masked, never a
reason to drop a document. Mixing keeps every row and adds its place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvine.llm import decontaminate, language_id, mixing, near_dup, secret_scan
from corvine.llm.common import dropped, shared_dir, table, written


#: Below it the other languages together are likelier than the predicted one.
LEAST_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language_id.learn(docs)
    if not model.languages:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    # Under other names, so that columns of the documents named like the results stay theirs.
    renamed = docs.toDF(*[c if c == "text" else f"c{i}" for i, c in enumerate(docs.columns)])
    kept = language_id.predicted(renamed, model).filter((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return kept.drop("lang_pred", "score").toDF(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.deduplicated(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.cleaned(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redacted(docs, secret_scan.trained(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", remove_benchmark),
    ("secret_scan", mask_secrets),
    ("mixing", mix_sources),
]

#: Language scores, minwise tokens and Markov models have no SQL; the tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder, before = table(spark, sf_dir, "documents"), shared_dir(spark), None
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), folder, name)
        if before:
            dropped(spark, folder, before)
        before = name
    return docs
