"""Session defaults and the shared folder that cuts lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_STAGED: list[str] = []


def build_session(app: str = "spanloom", **conf: str) -> SparkSession:
    """A session with the defaults the engine assumes: UTC, AQE and skew-join handling."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, from ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own; on a cluster the
    missing setting is an error, since a machine-local folder would lose data with its node.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        configured = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not configured:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            configured = tempfile.mkdtemp(prefix="spanloom-")
        context.setCheckpointDir(configured)
    return context.getCheckpointDir()


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it back: lineage ends here.

    Survives the loss of any executor, and every later reader sees the same rows, also when
    ``df`` holds partition ids or samples that a second run could draw differently.
    """
    spark = df.sparkSession
    path = _staged_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _staged_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _STAGED:
        atexit.register(_drop_at_exit, spark)
    _STAGED.append(path)
    return path


def stage_counting(df: DataFrame, name: str, which: Column | None = None) -> tuple[DataFrame, int]:
    """``stage`` with the number of rows, or of those ``which`` holds for, counted by the same job."""
    seen = Observation()
    staged = stage(df.observe(seen, F.count_if(F.lit(True) if which is None else which).alias("n")), name)
    return staged, seen.get["n"]


def drop_stages(spark: SparkSession) -> int:
    """Delete all staged tables of this driver; returns how many there were."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    path_class = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    n = len(_STAGED)
    while _STAGED:
        path = path_class(_STAGED.pop())
        path.getFileSystem(hadoop).delete(path, True)
    return n


def _drop_at_exit(spark: SparkSession) -> None:
    try:
        drop_stages(spark)
    except Exception:  # the session ended first; its folder goes with it or stays
        pass


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def partitions_for(df: DataFrame, size: int = 64 << 20) -> int:
    """Partitions for a shuffle of ``df``: the session's number, more if its sources need more at ``size`` bytes each."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    known = [b for i in range(leaves.size()) if (b := int(str(leaves.apply(i).stats().sizeInBytes()))) < 1 << 60]
    return max(shuffle_partitions(df.sparkSession), -(-sum(known) // size))


def spread(df: DataFrame) -> DataFrame:
    """``df`` on at least as many partitions as there are cores, for work heavy on each row.

    Only scans with fewer partitions than that, such as one small file, are shuffled; a plan
    that shuffles already is left to itself, as asking for its partitions would run it.
    """
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
