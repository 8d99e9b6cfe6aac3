"""Session settings and the shared scratch folder used for written intermediate tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_PACKED = "spark.sql.sources.fileCompressionFactor"
_BROADCASTS = "spark.sql.autoBroadcastJoinThreshold"
_SHUFFLES, _ADVISORY = "spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes"


def build_session(app: str = "framewright", cores: int | str = 8, **conf) -> SparkSession:
    """Local session for tests and benchmarks. A cluster brings its own session."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder for written intermediates: ``spark.checkpoint.dir`` of the session.

    Only a local master may fall back to a temporary folder; on a cluster an
    unset folder is an error, because a machine-local one dies with its machine.
    """
    sc = spark.sparkContext
    folder = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir")
    if folder is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="framewright-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.setCheckpointDir(folder)
    return folder


def _delete_on_exit(spark: SparkSession, path: str) -> None:
    """Let the file system drop a written intermediate when the driver ends."""
    sc = spark.sparkContext
    target = sc._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(target)


def remove_table(spark: SparkSession, path: str) -> None:
    """Delete a written intermediate that nothing reads any more."""
    sc = spark.sparkContext
    target = sc._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the scratch folder and read it back.

    Cuts the lineage and pins values that depend on the physical layout (range
    partition numbers). Parquet keeps column pruning and real size statistics
    for the readers, which an RDD checkpoint does not. Narrow rows of keys and numbers are
    packed many times over, so file sizes count more before a join broadcasts them. As rows
    of a hash table they take several times their bytes, and the driver holds all tables of a plan that
    joins broadcast at once, so the size up to which they do is lowered too, if it is at its default.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _delete_on_exit(spark, path)
    if spark.conf.get(_PACKED) == "1.0":
        spark.conf.set(_PACKED, "20.0")
    if spark.conf.get(_BROADCASTS) == "10485760b":
        spark.conf.set(_BROADCASTS, "2m")
    return spark.read.schema(df.schema).parquet(path)


def widen_shuffles(spark: SparkSession, parts: int) -> int:
    """Shuffle into at least ``parts`` partitions from now on; returns how many.

    What a task sorts then stays the same as the tables grow. Sorted keys and numbers are packed to a few
    bytes a row, so the size to which adaptive execution joins partitions is lowered too, if it is at its default.
    """
    now = int(spark.conf.get(_SHUFFLES))
    if parts <= now:
        return now
    spark.conf.set(_SHUFFLES, str(parts))
    if spark.conf.get(_ADVISORY) == "67108864b":
        spark.conf.set(_ADVISORY, "2m")
    return parts
