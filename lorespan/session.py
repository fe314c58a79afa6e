"""Spark session helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


SPREAD_BYTES = 16 * 1024 * 1024
#: Measured bytes up to which a table travels to all tasks.
SMALL_BYTES = 32 * 1024 * 1024


def build_session(app: str = "lorespan", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the operators expect.

    Cluster settings win: ``master`` is set only when given, and the shuffle
    width is left to Spark unless the caller names one.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Long texts: bound an Arrow batch by rows as well as by bytes.
        "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, for checkpoints and snapshots.

    A cluster names it in ``spark.checkpoint.dir``; only where that is unset and
    all tasks run on this machine (a local test) is a temporary folder taken.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="lorespan-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows once to the shared folder and go on from there.

    Unlike a checkpoint this computes ``df`` a single time, and its row count and
    columns can be read on their own afterwards.
    """
    spark = df.sparkSession
    path = work_dir(spark, "rows")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def is_small(df: DataFrame, limit: int = SMALL_BYTES) -> bool:
    """Whether the rows, measured as text with 64 bytes more for each, stay within the limit.

    One aggregate, summed up in each task first.
    """
    row = F.octet_length(F.to_json(F.struct(*df.columns))) + 64
    return (df.agg(F.sum(row)).first()[0] or 0) <= limit


def spread(df: DataFrame) -> DataFrame:
    """Share out a small input before work that is heavy per row.

    A scan cannot split below a row group, so an input of few groups leaves cores
    idle.  Only an input of less than 16 MB a core is moved; larger ones are left
    as they are read.
    """
    if df.isStreaming:
        return df
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return df.repartition(cores) if int(str(size)) < cores * SPREAD_BYTES else df


def run_once(batch_function):
    """Keep the optimizer from copying a costly batch function.

    A filter on its result (``explode`` adds one too) would be pushed below other
    steps together with a second run of the function; an expression that is not
    marked deterministic stays where it is.
    """
    return batch_function.asNondeterministic()


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def load_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
