"""File, message and row sources and sinks."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskengine.operators.ordering import number_rows

#: The columns of a raw record and their kinds; numeric families are added by pattern.
RAW_SCHEMA = T.StructType(
    [T.StructField("TransactionID", T.LongType()), T.StructField("isFraud", T.IntegerType()), T.StructField("TransactionDT", T.LongType()), T.StructField("TransactionAmt", T.DoubleType()), T.StructField("ProductCD", T.StringType())]
    + [T.StructField(f"card{k}", T.StringType() if k in (4, 6) else T.DoubleType()) for k in range(1, 7)]
    + [T.StructField(c, T.DoubleType()) for c in ("addr1", "addr2", "dist1", "dist2")]
    + [T.StructField(c, T.StringType()) for c in ("P_emaildomain", "R_emaildomain", *[f"M{k}" for k in range(1, 10)], "DeviceType", "DeviceInfo")]
)
_MISSING = ("nan", "NaN", "Nan", "")


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A CSV scan with a header and a declared schema; fields that do not parse are null."""
    return spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path)


def stream_csv(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 1) -> DataFrame:
    """New CSV files of a folder as a stream; a file counts once, whatever its name or time."""
    return spark.readStream.schema(schema).option("header", True).option("maxFilesPerTrigger", files_per_batch).csv(path)


def kafka_limits(batch_rows: int | None, batch_seconds: float | None) -> dict[str, str]:
    """Options by which a batch waits for ``batch_rows`` messages, or ``batch_seconds`` at most, and has no more than that many."""
    if not batch_rows:
        return {}
    waits = {"minOffsetsPerTrigger": str(batch_rows), "maxTriggerDelay": f"{round(batch_seconds * 1000)}ms"} if batch_seconds else {}
    return {"maxOffsetsPerTrigger": str(batch_rows)} | waits


def stream_kafka(spark: SparkSession, servers: str, topic: str, offsets: str = "latest", batch_rows: int | None = None, batch_seconds: float | None = None) -> DataFrame:
    """A topic as a stream of ``value`` texts, in batches of ``batch_rows`` or of what there is after ``batch_seconds``.

    The checkpoint keeps the offsets; a connector package has to be installed.
    """
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", offsets)
    raw = raw.options(**kafka_limits(batch_rows, batch_seconds)).load()
    return raw.select(F.col("value").cast("string").alias("value"), "topic", "partition", "offset", "timestamp")


def write_kafka(df: DataFrame, servers: str, topic: str, key: str, checkpoint: str):
    """Rows as JSON messages by key, acknowledged by all replicas and compressed."""
    out = df.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct("*")).alias("value")).writeStream.format("kafka")
    return out.option("kafka.bootstrap.servers", servers).option("topic", topic).option("kafka.acks", "all").option("kafka.compression.type", "lz4").option("checkpointLocation", checkpoint).start()


def missing_to_null(df: DataFrame) -> DataFrame:
    """Texts that spell a missing value become null."""
    return df.select(*[F.when(F.col(f.name).isin(*_MISSING), None).otherwise(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name) for f in df.schema])


def with_replay_id(df: DataFrame, order: list[str], bucket: Column) -> DataFrame:
    """``transaction_id``, ``tx_`` and the row's number from 0; ``bucket`` grows with the order."""
    numbered = number_rows(df, order, bucket)
    return numbered.withColumn("transaction_id", F.concat(F.lit("tx_"), F.col("_at").cast("string"))).drop("_at")


def parse_messages(df: DataFrame, schema: T.StructType, value_col: str = "value") -> tuple[DataFrame, DataFrame]:
    """Messages as records, and the dead letters: what is no JSON object of the schema, with the reason."""
    wide = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    parsed = df.withColumn("_m", F.from_json(value_col, wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    bad = F.col("_m").isNull() | F.col("_m._corrupt_record").isNotNull()
    good = parsed.filter(~bad).select(*[F.col(f"_m.{f.name}") for f in schema])
    return good, dead_letters(parsed.filter(bad).select(F.col(value_col).alias("original_message")), "parse error", F.lit("not a record of the schema"))


def dead_letters(df: DataFrame, reason: str, error: Column) -> DataFrame:
    return df.select("original_message", F.lit(reason).alias("error_reason"), error.alias("exception"), F.current_timestamp().alias("timestamp"))


def rows_to_frame(spark: SparkSession, rows: list[dict] | dict, schema: T.StructType) -> DataFrame:
    """One record or several with any subset of the columns; what is absent is null."""
    rows = [rows] if isinstance(rows, dict) else rows
    return spark.createDataFrame([tuple(r.get(f.name) for f in schema) for r in rows], schema)


def mock_transactions(df: DataFrame, seed: int = 42, fraud_share: float = 0.1) -> DataFrame:
    """Rows with an id (of a range or a rate stream's ``value``) as generated transactions.

    One in ten is fraudulent, with larger amounts, other products and card numbers.
    """
    key = df.columns[-1] if "value" in df.columns else df.columns[0]
    r = lambda k: F.pmod(F.xxhash64(key, F.lit(seed + k)), F.lit(1 << 30)) / float(1 << 30)
    bad = r(0) < fraud_share
    pick = lambda k, *of: F.element_at(F.array(*map(F.lit, of)), (F.floor(r(k) * len(of)) + 1).cast("int"))
    return df.select(
        F.concat(F.lit("mock_"), F.col(key).cast("string")).alias("transaction_id"), F.col(key).cast("long").alias("TransactionDT"), bad.cast("int").alias("isFraud"),
        F.round(F.when(bad, 200 + r(1) * 1800).otherwise(5 + r(1) * 295), 2).alias("TransactionAmt"), F.when(bad, pick(2, "C", "R", "H")).otherwise(pick(2, "W", "S")).alias("ProductCD"),
        F.when(bad, 9000 + F.floor(r(3) * 1000)).otherwise(1000 + F.floor(r(3) * 8000)).cast("double").alias("card1"), pick(4, "visa", "mastercard").alias("card4"), pick(5, "debit", "credit").alias("card6"),
    )


def read_after(df: DataFrame, seq_col: str, last: int | None) -> DataFrame:
    """Rows of an append-only table that came after a sequence number."""
    return df if last is None else df.filter(F.col(seq_col) > last)


def newest(df: DataFrame, n: int, seq_col: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """The newest ``n`` rows, of each key if there are keys."""
    if not keys:
        return df.orderBy(F.col(seq_col).desc()).limit(n)
    w = Window.partitionBy(*keys).orderBy(F.col(seq_col).desc())
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def latest_by_key(df: DataFrame, key: str, seq_col: str, now: Column | None = None, ttl_seconds: int | None = None) -> DataFrame:
    """The last row of each key, dropped if older than the time to live; ``seq_col`` is a time then."""
    rows = df.filter(F.unix_seconds(now) - F.unix_seconds(F.col(seq_col)) < ttl_seconds) if ttl_seconds is not None else df
    return rows.groupBy(key).agg(F.max_by(F.struct("*"), F.col(seq_col)).alias("_r")).select("_r.*")


@dataclass(frozen=True)
class Settings:
    """Parameters of the engine, with the defaults used in production."""

    fee_fraud: float = 30.0
    fee_false_alarm: float = 12.5
    false_alarm_share: float = 0.15
    soft_threshold: float = 0.15
    hard_threshold: float = 0.75
    max_fpr: float = 0.02
    batch_rows: int = 100
    batch_seconds: int = 5
    importance_alpha: float = 0.1
    extra: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        if not self.soft_threshold < self.hard_threshold:
            raise ValueError("the soft threshold has to lie below the hard one")

    @classmethod
    def load(cls, path: str) -> Settings:
        """From a JSON object or a flat YAML mapping of names to numbers; unknown names go to ``extra``."""
        import json

        text = Path(path).read_text(encoding="utf-8")
        if path.endswith(".json"):
            found = json.loads(text)
        else:
            lines = [x.split("#")[0].rstrip() for x in text.splitlines()]
            found = {k.strip(): json.loads(v.strip()) for k, _, v in (x.partition(":") for x in lines) if v.strip()}
        own = {k: v for k, v in found.items() if k in cls.__dataclass_fields__ and k != "extra"}
        return cls(**own, extra={k: v for k, v in found.items() if k not in own})


def write_table(df: DataFrame, path: str, mode: str = "overwrite", fmt: str = "parquet") -> None:
    """A table of a file format; CSV gets a header."""
    writer = df.write.mode(mode)
    (writer.option("header", True).csv(path) if fmt == "csv" else writer.format(fmt).save(path))
