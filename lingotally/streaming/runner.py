"""Run a streaming query to the end of its input and read what it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lingotally.session import work_dir


def file_stream(spark: SparkSession, folder: str, name: str, files_per_trigger: int = 64) -> DataFrame:
    """Parquet files of a folder whose names match ``name``, as a stream."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    return (
        spark.readStream.schema(schema).option("pathGlobFilter", name)
        .option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    )


def run_available(stream: DataFrame, mode: str, name: str, keys: list[str] | None = None) -> DataFrame:
    """Process all input now and return the written result.

    Batches go to one folder each, so a repeated batch replaces itself. Append output is the union
    of all batches, update output the newest row per key. In complete mode a batch replaces the one
    before, so only the newest state is stored.
    """
    spark = stream.sparkSession
    base = work_dir(spark, name)

    def write(batch: DataFrame, batch_id: int) -> None:
        name = "last" if mode == "complete" else f"batch={batch_id}"
        batch.write.mode("overwrite").parquet(f"{base}/out/{name}")

    query = (
        stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint")
        .trigger(availableNow=True).foreachBatch(write).start()
    )
    query.awaitTermination()
    if mode == "complete":
        return spark.read.parquet(f"{base}/out/last")
    out = spark.read.parquet(f"{base}/out")
    if mode == "append":
        return out.drop("batch")
    rest = [c for c in out.columns if c not in (*keys, "batch")]
    newest = out.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r"))
    return newest.select(*keys, "_r.*")
