"""Session and scratch-folder helpers shared by the bench, the tests and the entry module."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


TASKS_PER_CORE, TASKS_PER_SPLIT = 4, 8


def local_session(cores: str = "8", memory: str = "12g", name: str = "cilake") -> SparkSession:
    """A single-JVM session for tests and the bench; a cluster brings its own session."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.driver.memory", memory)
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder under the cluster's checkpoint folder (``spark.checkpoint.dir``).

    Only where the session names none and runs in one process (tests) does this fall back to a temporary folder. All
    folders of an application lie together under its id, to be removed when it has ended.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not in_one_process(spark):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        root = tempfile.mkdtemp(prefix="cilake-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/cilake/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def in_one_process(spark: SparkSession) -> bool:
    return re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master) is not None


def is_folder(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getFileStatus(at).isDirectory()


def spread(df: DataFrame) -> DataFrame:
    """In a one-process session, deal a test table of one row group over all cores before row-wise parsing.

    On a cluster scans are left to `spark.sql.files.*`; see `dealt`.
    """
    spark = df.sparkSession
    return df.repartition(spark.sparkContext.defaultParallelism) if in_one_process(spark) else df


def dealt(df: DataFrame) -> DataFrame:
    """Deal rows whose parsing costs far more than their bytes: some tasks for each core, and more as the scan has more.

    A scan is cut by bytes and row groups, so a compact table of documents can be a single task for minutes.
    """
    spark = df.sparkSession
    if in_one_process(spark):
        return spread(df)
    return df.repartition(max(TASKS_PER_CORE * spark.sparkContext.defaultParallelism, TASKS_PER_SPLIT * df.rdd.getNumPartitions()))


def written(df: DataFrame, label: str, codec: str | None = None) -> DataFrame:
    """Cut the lineage: write the rows to the shared folder and read them back.

    Used where a result feeds several later joins, so it is computed once, survives the loss of
    executors, and carries a real size for the choice of join strategies. `codec`: of the files, by default the session's.
    """
    path = shared_dir(df.sparkSession, label)
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)
