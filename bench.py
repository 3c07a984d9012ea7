"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

Every query runs once to warm up and then ``$BENCH_RUNS`` times; the best time counts. Results go to
the noop sink, so all rows and columns are computed and nothing is collected.

The given tables are files of one row group, which one task reads. ``split`` repeats the queries on copies
of the tables in several files, made once outside the timing: what remains there is the work itself.
"""

from __future__ import annotations

import json
import os
import time

from lingotally.session import build_session, drop_work

HEADLINE = [
    "language_groups", "text_metrics", "sentence_stats", "unique_char_ratio", "rule_hits",
    "rule_summary", "epoch_convert", "epoch_detect", "geo_lookup", "script_profile", "code_switch",
    "dialect_verdict", "ngram_profile", "langid", "classify", "speaker_attach", "srt_roundtrip",
    "marker_segments", "distinct_infer", "review_fold", "running_counters", "rolling_recent",
    "manifest", "html_fragments", "live_chunks", "run_batch",
]


def detector_rates(spark, sf_dir: str, cpus: int) -> dict[str, int]:
    """Words per second of the detector alone by number of tasks: texts up to 5 kB, read whole."""
    from pyspark.sql import functions as F

    from lingotally.functions.text import word_count
    from lingotally.operators import langid
    from lingotally.plans.catalogue.langid import profile_of

    detect = langid.detector(profile_of(spark, sf_dir))
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").filter(
        F.octet_length("text") <= 5000)
    rates = {}
    for tasks in [n for n in (1, 2, 4, 8) if n <= cpus]:
        dealt = texts.repartition(tasks).persist()
        words = dealt.agg(F.sum(word_count(F.col("text")))).first()[0]
        best = None
        for _ in range(3):
            start = time.perf_counter()
            dealt.select(detect(F.col("text"))).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        rates[str(tasks)] = round(words / best)
        dealt.unpersist()
    return rates


TABLES = ["documents", "events", "conversations", "pages", "nation", "region", "customer", "supplier", "part",
          "orders", "lineitem", "labels", "benchmark", "embeddings"]


def split_copies(spark, sf_dir: str, cpus: int) -> str:
    """The same tables in four files per core."""
    from lingotally.session import work_dir

    folder = work_dir(spark, "bench")
    for t in TABLES:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").repartition(4 * cpus).write.parquet(f"{folder}/{t}.parquet")
    return folder


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g",
           "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    from lingotally.plans.catalogue import QUERIES

    def run(name: str, folder: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    times, split = {}, {}
    for name in HEADLINE:
        run(name, sf_dir)
        times[name] = round(min(run(name, sf_dir) for _ in range(runs)), 3)
    copies = split_copies(spark, sf_dir, int(cpus))
    for name in HEADLINE:
        split[name] = round(min(run(name, copies) for _ in range(runs)), 3)
    n_docs = QUERIES["text_metrics"](spark, sf_dir).count()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": int(cpus),
        "split_total": round(sum(split.values()), 3), "split_queries": split,
        "langid_words_per_sec": detector_rates(spark, sf_dir, int(cpus)),
        "batch_docs_per_sec": round(n_docs / times["run_batch"]),
        "split_batch_docs_per_sec": round(n_docs / split["run_batch"]),
    }))
    drop_work(spark)
    spark.stop()


if __name__ == "__main__":
    main()
