"""Tables of micro-batches: a folder for each batch, merged from time to time into a base by key.

A batch replaces itself when it is run again. The base is written whole under the number
of the last batch in it and counts once Spark has marked it finished; batches up to that
number are then not read any more. A merge deletes what the merge before it had replaced,
so that readers which began before still find their files.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from py4j.java_gateway import JavaObject
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

Merge = Callable[[DataFrame], DataFrame]


def hadoop_path(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    """The file system of a path, and the path, as Hadoop has them."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """What a folder holds; nothing if it is not there."""
    fs, p = hadoop_path(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = hadoop_path(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    fs, p = hadoop_path(spark, path)
    fs.delete(p, True)


def write_once(spark: SparkSession, path: str, value: dict) -> bool:
    """A small JSON file, put in place as a whole; False if it is there already."""
    fs, p = hadoop_path(spark, path)
    if fs.exists(p):
        return False
    _, part = hadoop_path(spark, str(p.getParent().getParent()) + f"/_{p.getName()}.part")
    out = fs.create(part, True)
    out.write(bytearray(json.dumps(value).encode()))
    out.close()
    fs.mkdirs(p.getParent())
    return fs.rename(part, p)


# What merges keep. Each takes all rows, with ``batch``, and gives those that stay.


def newest_of_key(key: str, seconds: int | None = None, now: Column | None = None, written: str = "written") -> Merge:
    """The newest row of each key, if it is within its time to live."""

    def merge(rows: DataFrame) -> DataFrame:
        if seconds is not None:
            rows = rows.filter(F.unix_seconds(now if now is not None else F.current_timestamp()) - F.unix_seconds(written) < seconds)
        return rows.groupBy(key).agg(F.max_by(F.struct("*"), F.struct("batch", F.xxhash64(F.to_json(F.struct("*"))))).alias("_r")).select("_r.*")

    return merge


def newest_rows(n: int, order: list[str], keys: tuple[str, ...] = ()) -> Merge:
    """The newest ``n`` rows, of each of ``keys`` if there are any; these are features or the like."""

    def merge(rows: DataFrame) -> DataFrame:
        last = [F.col(c).desc() for c in ("batch", *order)]
        if not keys:
            return rows.orderBy(*last).limit(n)
        return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*last))).filter(F.col("_n") <= n).drop("_n")

    return merge


def last_batch(rows: DataFrame) -> DataFrame:
    return rows.join(F.broadcast(rows.agg(F.max("batch").alias("batch"))), "batch", "left_semi")


def summed(columns: tuple[str, ...]) -> Merge:
    """One row with the sums of all batches."""
    return lambda rows: rows.agg(*[F.sum(c).alias(c) for c in columns], F.max("batch").alias("batch"))


@dataclass(frozen=True)
class BatchTable:
    """A table of batches under ``folder``; with ``key`` the base is split into ``buckets`` by it."""

    folder: str
    key: str | None = None
    buckets: int = 32
    columns: tuple[str, ...] = field(default=(), repr=False)

    def put(self, df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.folder}/batch={number}")

    def bases(self, spark: SparkSession) -> list[int]:
        """The finished bases' last batches, ascending."""
        found = [n for n in folder_names(spark, f"{self.folder}/base") if n.startswith("upto=")]
        return sorted(int(n[5:]) for n in found if exists(spark, f"{self.folder}/base/{n}/_SUCCESS"))

    def batches(self, spark: SparkSession, after: int = -1) -> list[int]:
        """The finished batches after a number, ascending."""
        found = sorted(int(n[6:]) for n in folder_names(spark, self.folder) if n.startswith("batch="))
        return [n for n in found if n > after and exists(spark, f"{self.folder}/batch={n}/_SUCCESS")]

    def bucket(self, value: Column) -> Column:
        return F.pmod(F.xxhash64(value), F.lit(self.buckets)).cast("int")

    def _base(self, spark: SparkSession, upto: int) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/base/upto={upto}")

    def _fresh(self, spark: SparkSession, numbers: list[int]) -> DataFrame | None:
        if not numbers:
            return None
        paths = [f"{self.folder}/batch={n}" for n in numbers]
        return spark.read.option("basePath", self.folder).parquet(*paths).withColumn("batch", F.col("batch").cast("long"))

    def read(self, spark: SparkSession, key_value=None) -> DataFrame | None:
        """All rows with ``batch``, or those of one key: of the base only its bucket is read. None if there is no batch."""
        upto = max(self.bases(spark), default=None)
        parts = [] if upto is None else [self._base(spark, upto)]
        if parts and "bucket" in parts[0].columns:
            if key_value is not None:  # as the key's type, by which the hash goes
                parts[0] = parts[0].filter(F.col("bucket") == self.bucket(F.lit(key_value).cast(parts[0].schema[self.key].dataType)))
            parts[0] = parts[0].drop("bucket")
        fresh = self._fresh(spark, self.batches(spark, -1 if upto is None else upto))
        parts += [] if fresh is None else [fresh]
        if not parts:
            return None
        out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)
        return out if key_value is None else out.filter(F.col(self.key) == key_value)

    def compact(self, spark: SparkSession, merge: Merge, upto: int | None = None) -> int | None:
        """Merge the base and the batches (up to a number) into a new base, and delete what the last merge replaced.

        The number of files is then at most ``buckets`` for each of two bases, and those of
        the batches since the merge before this one.
        """
        had = self.bases(spark)
        old = had[-1] if had else None
        new = [n for n in self.batches(spark, -1 if old is None else old) if upto is None or n <= upto]
        if not new:
            return old
        rows = self._fresh(spark, new)
        if old is not None:
            rows = self._base(spark, old).drop("bucket").unionByName(rows, allowMissingColumns=True)
        kept, path = merge(rows), f"{self.folder}/base/upto={new[-1]}"
        if self.key:
            kept = kept.withColumn("bucket", self.bucket(F.col(self.key)))
            kept.repartition(self.buckets, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
        else:
            kept.coalesce(1).write.mode("overwrite").parquet(path)
        for n in had[:-1]:
            delete(spark, f"{self.folder}/base/upto={n}")
        for n in self.batches(spark):
            if old is not None and n <= old:
                delete(spark, f"{self.folder}/batch={n}")
        return new[-1]

    def files(self, spark: SparkSession) -> int:
        fs, p = hadoop_path(spark, self.folder)
        if not fs.exists(p):
            return 0
        found, n = fs.listFiles(p, True), 0
        while found.hasNext():
            n += found.next().getPath().getName().endswith(".parquet")
        return n
