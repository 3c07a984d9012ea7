"""Physical plans: what must and must not appear, and skew handling at run time."""

import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lingotally.operators import infer, intervals, langid, rules
from lingotally.plans.catalogue import QUERIES
from lingotally.session import tune

NARROW = ["text_metrics", "sentences", "rule_hits", "rule_offsets", "script_profile", "dialect_verdict",
          "route", "code_switch", "epoch_convert", "epoch_detect", "kind_robust", "html_escape",
          "labelled_values", "marker_segments", "html_fragments", "csv_rows"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cartesian_or_nested_loop(spark, sf, name):
    text = plan(QUERIES[name](spark, sf))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("name", NARROW)
def test_row_local_queries_do_not_shuffle(spark, sf, name):
    """Only the spread of the small single-split file may be there."""
    text = plan(QUERIES[name](spark, sf))
    exchanges = [x for x in re.findall(r"Exchange [^\n]*", text) if "REPARTITION_BY_NUM" not in x]
    assert exchanges == [] and "Python" not in text


def test_columns_and_filters_reach_the_scan(spark, sf):
    text = plan(QUERIES["foreign_only"](spark, sf))
    assert "PushedFilters: [IsNotNull(lang), Not(EqualTo(lang,)), Not(EqualTo(lang,en))]" in text
    assert "ReadSchema: struct<doc_id:bigint,lang:string>" in text
    text = plan(QUERIES["dominant_source"](spark, sf))
    assert "ReadSchema: struct<source:string>" in text


def test_profile_ranking_is_limited_before_the_shuffle(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    text = plan(langid.train_profile(docs))
    assert text.count("WindowGroupLimit") == 2 and "partial_sum" in text


@pytest.fixture
def tiny_skew(spark):
    """Skew thresholds small enough for test data, and no broadcast."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "200KB",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100KB"}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_hot_text_join_is_split_at_run_time(spark, tiny_skew):
    """A text with most of the rows: the join back to its translation splits into several tasks."""
    n = 60_000
    df = spark.range(n, numPartitions=8).select(
        "id", F.when(F.col("id") % 3 > 0, "the hot text").otherwise(F.concat(F.lit("t"), F.col("id"))).alias("text"))
    out = infer.infer_distinct(df, infer.tagging_model("en"), F.col("id"))
    assert out.agg(F.count("output"), F.count("*")).first() == (n, n)
    done = out.groupBy((F.col("id") % 3).alias("g")).agg(F.count("output"))
    done.collect()
    assert "skew=true" in plan(done)


def test_hot_bucket_is_split_at_run_time(spark, tiny_skew):
    """Most segments fall into one time bucket of one document."""
    n = 60_000
    i = F.col("id")
    hot = i % 10 < 8
    segs = spark.range(n, numPartitions=8).select(
        F.when(hot, "hot").otherwise(F.concat(F.lit("d"), i)).alias("doc_id"), i.alias("seg_idx"),
        (i % 997).alias("start_ms"), (i % 997 + 2).alias("end_ms"))
    turns = spark.createDataFrame(
        [("hot", k, k * 100, k * 100 + 100, f"S{k}") for k in range(9)],
        "doc_id string, turn_idx int, start_ms bigint, end_ms bigint, speaker_id string")
    out = intervals.attach_speaker(segs, turns)
    got = {r.speaker_id: r["count"] for r in out.groupBy("speaker_id").count().collect()}
    want = {}
    for k in range(n):
        s = k % 997
        best = "UNKNOWN"
        if k % 10 < 8 and s < 900:
            # a segment over a border has 1 ms on each side: the earlier turn wins
            best = f"S{s // 100}"
        want[best] = want.get(best, 0) + 1
    assert got == want
    done = out.groupBy("speaker_id").agg(F.count("*"))
    done.collect()
    assert "skew=true" in plan(done)


def test_interval_join_is_an_equi_join_on_buckets(spark):
    s = spark.createDataFrame([("d", 0, 0, 10)], "doc_id string, seg_idx int, start_ms bigint, end_ms bigint")
    t = spark.createDataFrame([("d", 0, 0, 10, "S")],
                              "doc_id string, turn_idx int, start_ms bigint, end_ms bigint, speaker_id string")
    text = plan(intervals.attach_speaker(s, t))
    assert re.search(r"(SortMergeJoin|BroadcastHashJoin|ShuffledHashJoin) \[doc_id[^\]]*, _b", text)


def test_rule_scan_is_one_pass(spark):
    df = spark.createDataFrame([(1, "x")], "id int, t string")
    many = [dict(r, rule=f"r{i}", string_id=f"s{i}") for i in range(25) for r in rules.default_rules()[:1]]
    text = plan(rules.rule_hits(df, {"source": "t"}, ["id"], many))
    assert text.count("Scan") == 1 and "Join" not in text


def test_first_segments_are_grouped_before_they_move(spark, sf):
    """Segment numbers are few: texts dealt by number alone would meet in a task per number."""
    df = QUERIES["flags_to_results"](spark, sf)
    joins = re.findall(r"Join [^\n]*", df._jdf.queryExecution().optimizedPlan().toString())
    by_number = [j for j in joins if "segment_index" in j and "file_path" not in j]
    assert len(by_number) == 1 and "LeftOuter" in by_number[0]


def test_python_batches_are_bounded_by_bytes(spark):
    """Long texts come to Python in batches of a few MB, whatever the number of rows that a batch may have."""
    @F.pandas_udf("long")
    def batch_chars(texts: pd.Series) -> pd.Series:
        return pd.Series([texts.str.len().sum()] * len(texts))

    df = tune(spark).range(0, 3000, 1, 1).select(F.repeat(F.lit("x"), 20_000).alias("text"))
    assert df.agg(F.max(batch_chars("text"))).first()[0] <= 5 << 20
