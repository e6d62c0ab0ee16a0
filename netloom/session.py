"""Session helpers shared by all operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, a file or a folder of files."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it.

    Where it names none, a session that runs on this machine alone gets one of its own; on a cluster that is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        sc.setCheckpointDir(named or f"file://{sc._jvm.java.lang.System.getProperty('java.io.tmpdir')}/netloom-{sc.applicationId}")
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Evaluate once and cut lineage through the shared checkpoint folder, so that a lost executor costs nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Bytes (as JSON) up to which a table is broadcast.
BROADCAST_BYTES = 10 << 20


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if its rows, measured as JSON, stay within BROADCAST_BYTES; df is best one that cut has stored."""
    size = df.agg(F.sum(F.octet_length(F.to_json(F.struct("*")))).alias("n")).first()["n"] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def release(df: DataFrame) -> None:
    """Delete what cut wrote for df, which nothing may read any more; loops call it for the round they have replaced."""
    plan = df._jdf.queryExecution().logical()
    if plan.getClass().getSimpleName() == "LogicalRDD" and plan.rdd().getCheckpointFile().isDefined():
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(plan.rdd().getCheckpointFile().get())
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in whatever store the path names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def spread(df: DataFrame, parts: int | None = None) -> DataFrame:
    """df over at least `parts` partitions (the session's shuffle partitions by default), for work that is dear by the row; a table of enough splits is left as it is."""
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n)
