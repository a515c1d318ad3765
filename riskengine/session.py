"""Session construction and the shared working folder.

Intermediate tables and checkpoints go to the folder the cluster names in
``spark.checkpoint.dir``; only where that setting is absent on a local master (tests)
is a folder of our own created.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dirs: dict[str, str] = {}
#: The JVM does not compile methods over 8,000 bytes; long projections in one take several times as long.
_LIMIT, _COMPILED = "spark.sql.codegen.hugeMethodLimit", 8000


def build_session(app: str = "riskengine", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """A session with the settings all operators assume: UTC, ANSI, adaptive execution."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        b = b.master(master)
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a fresh local one only where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="riskengine-")
        spark.sparkContext.setCheckpointDir(_own_dirs[app])
    return _own_dirs[app]


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back; this cuts lineage.

    The rows survive the loss of any executor, as no executor's disk holds them. While it
    writes, generated code with a method over ``_COMPILED`` bytes is left for smaller methods.
    """
    spark, path = df.sparkSession, shared_path(df.sparkSession, name)
    before = spark.conf.get(_LIMIT)
    spark.conf.set(_LIMIT, str(min(int(before), _COMPILED)))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_LIMIT, before)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df``, which is a table, in as many partitions as there are cores at least: a small file may hold many records, and each costs a long projection."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
