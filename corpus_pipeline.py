"""Corpus pipeline over ``documents``: quality rules, near-dedup, decontamination, secrets, mixing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each stage's rows as
Parquet in the shared folder and rereads them as the next one's input, so a lost executor costs at most
one stage. Stages 1 to 3 drop rows, stage 4 rewrites texts, stage 5 adds what the mix takes of every
row (``mixed_text``, null where nothing); ``mixing.mixture`` of its rows is the training corpus. All
stages take null texts (empty), null sources, repeated rows, empty tables and extra columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lingotally import session
from lingotally.llm import common, decontaminate, mixing, secrets, simhash, weak_rules


def ready(spark: SparkSession) -> SparkSession:
    return session.checkpoints(common.arrow(session.tune(spark)))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the weak-supervision rules keep."""
    ready(spark)
    return weak_rules.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every SimHash class."""
    ready(spark)
    return simhash.one_per_class(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no window of a benchmark item."""
    ready(spark)
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, secrets replaced in their texts."""
    ready(spark)
    return secrets.redact(docs)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with the words the mix takes of each: how many, where, and written out in ``mixed_text``."""
    ready(spark)
    return mixing.mix_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scans),
    ("mixing sources to target weights", mixing_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; every stage's rows are stored in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        folder = session.work_dir(ready(spark), f"stage{i}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs


# The label model of stage 1 iterates, and XXH64 of stage 2 is no SQL function.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
