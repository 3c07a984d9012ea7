"""Session settings and durability helpers shared by every operator."""

from __future__ import annotations

import uuid
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings the operators rely on. Offsets and calendar text are computed without the
# session zone, but windows over event time are not, hence UTC. Skew splitting is left to AQE for
# plain equi-joins; the operators salt on their own only where AQE cannot see the hot group. Whole texts
# go to Python, so its batches end by bytes: 10 000 rows of any length would have no bound.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
}

_MADE: dict[str, list[str]] = {}  # application -> folders of ``work_dir``


def build_session(app: str = "lingotally", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else created."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, else a folder in the warehouse.

    Outside local mode a warehouse on a local file system is no such folder, hence an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        warehouse = spark.conf.get("spark.sql.warehouse.dir")
        if not is_shared(spark.sparkContext.master, warehouse):
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        named = f"{warehouse}/_work"
    return named.rstrip("/")


def is_shared(master: str, folder: str) -> bool:
    """Whether all executors see the folder: any does in local mode, else it needs a scheme that is not ``file``."""
    return master == "local" or master.startswith("local[") or urlsplit(folder).scheme not in ("", "file")


def drop_work(spark: SparkSession) -> int:
    """Remove the folders that ``work_dir`` made in this session, and say how many; call it once the results that
    were read from them are written."""
    made = _MADE.pop(spark.sparkContext.applicationId, [])
    for folder in made:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return len(made)


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder for written intermediates below the shared one."""
    folder = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(folder)
    return folder


def checkpoints(spark: SparkSession) -> SparkSession:
    """Make sure that checkpoints go to the shared folder."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return spark


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint that survives the loss of executors."""
    checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write the rows to the shared folder and read them back: later steps branch from the table."""
    folder = work_dir(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
