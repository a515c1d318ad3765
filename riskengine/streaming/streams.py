"""Streaming forms of the operators: windows, keyed state, and the scoring stream with its sinks.

Every sink writes a micro-batch under its own number and overwrites it, so a batch that is
run again after a failure replaces itself; the checkpoint keeps offsets and state.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import (
    AnalysisException, ArithmeticException, ArrayIndexOutOfBoundsException, DateTimeException, IllegalArgumentException, NumberFormatException, ParseException, PythonException, SparkRuntimeException,
)
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from riskengine.functions.clean import tier
from riskengine.plans.views import mean_impacts, merge_importance
from riskengine.session import shared_path
from riskengine.sources.readers import Settings, dead_letters
from riskengine.streaming.state import ThrottleState, VelocityState, throttle_points, use_rocksdb  # noqa: F401
from riskengine.streaming.tables import BatchTable, delete, exists, folder_names, last_batch, newest_of_key, newest_rows, summed, write_once


def tumbling(df: DataFrame, ts: str, length: str, late: str, keys: tuple[str, ...], amount: str, slide: str | None = None) -> DataFrame:
    """``n`` and ``amount`` of event-time windows (sliding ones with ``slide``); rows later than ``late`` are left out."""
    w = F.window(ts, length, slide) if slide else F.window(ts, length)
    out = df.withWatermark(ts, late).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(amount).alias("amount"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "amount")


def sessions(df: DataFrame, ts: str, gap: str, late: str | None, keys: tuple[str, ...]) -> DataFrame:
    """Runs of a key's rows without a pause of ``gap``: rows just ``gap`` apart are of two runs.

    Spark's windows take in a row at their very end, so they are one microsecond shorter,
    which is what times are counted in. Without ``late`` no row is left out.
    """
    df = df.withWatermark(ts, late) if late else df
    out = df.groupBy(F.session_window(ts, f"{gap} -1 microseconds").alias("w"), *keys).agg(F.count("*").alias("n"))
    return out.select(*keys, F.col("w.start").alias("start"), (F.col("w.end") + F.expr("INTERVAL 1 MICROSECOND")).alias("end"), "n")


def _ids_as_text(df: DataFrame, row: str, event_time: str | None, late: str) -> DataFrame:
    """Ids as text, as pandas would turn long ids beside a null into doubles; with a watermark if there is an event time."""
    df = df.withColumn(row, F.col(row).cast("string"))
    return df.withWatermark(event_time, late) if event_time else df


def _seconds(spark: SparkSession, length: str) -> int:
    """How many seconds a span like ``1 day`` has."""
    return spark.range(1).select(F.unix_seconds(F.timestamp_seconds(F.lit(0)) + F.expr(f"INTERVAL '{length}'"))).first()[0]


def keyed_velocity(df: DataFrame, hours: int, user: str = "UID", time_col: str = "TransactionDT", amount: str = "TransactionAmt", row: str = "TransactionID", event_time: str | None = None, late: str = "1 day", epoch: int = 0) -> DataFrame:
    """Count and sum of the user's amounts in the hours before each record, over all micro-batches.

    A user's state is the records of the last ``hours`` in a piece for each hour (see
    ``VelocityState``), so a batch of a user with many records reads and writes few of them.
    Records of a batch see each other in time order; one that comes later than a batch with
    newer records sees what the state still holds. With ``event_time`` (the column of
    ``time_col`` plus ``epoch`` as a timestamp) an hour goes by a timer when the watermark is
    ``hours`` past it, and one that is so by the user's own records is not kept. Records without a time have no counts and sums.
    """
    use_rocksdb(df.sparkSession)
    out = f"{row} string, {user} string, count_{hours}h long, amt_sum_{hours}h double"
    state = VelocityState(hours, user, time_col, amount, row, epoch, event_time is not None, _seconds(df.sparkSession, late))
    found = _ids_as_text(df, row, event_time, late).groupBy(user).transformWithStateInPandas(state, out, "Append", "EventTime" if event_time else "None")
    return found.withColumn(row, F.col(row).cast(df.schema[row].dataType))


def throttled(df: DataFrame, seconds: float, least: float) -> DataFrame:
    """A running sum of ``delta`` for each ``series``, emitted at most every ``seconds`` unless it moved by ``least``.

    Input: ``series``, ``seq``, ``at``, ``delta``; the state is three numbers a series.
    """
    use_rocksdb(df.sparkSession)
    out = "series string, seq string, at double, total double"
    found = _ids_as_text(df, "seq", None, "").groupBy("series").transformWithStateInPandas(ThrottleState(seconds, least), out, "Append", "None")
    return found.withColumn("seq", F.col("seq").cast(df.schema["seq"].dataType))


def run_to_table(stream: DataFrame, mode: str, name: str) -> DataFrame:
    """Run a stream over what there is now and read its table: all batches, or the last state in complete mode."""
    spark, path = stream.sparkSession, shared_path(stream.sparkSession, name)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{'state' if mode == 'complete' else f'batch={number}'}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/state" if mode == "complete" else f"{path}/batch=*")


#: Errors of the records or of the scoring code. Others (a lost executor, a full disk) fail the batch, which Spark runs again.
_OF_SCORING = (
    AnalysisException, ArithmeticException, ArrayIndexOutOfBoundsException, DateTimeException, IllegalArgumentException, NumberFormatException, ParseException, PythonException, SparkRuntimeException,
    ArithmeticError, AssertionError, AttributeError, LookupError, TypeError, ValueError,
)


@dataclass
class ScoringTables:
    """The scoring stream's tables in one folder, each of batches with a base that ``compact`` merges them into."""

    folder: str
    refresh_seconds: int = 300
    buckets: int = 32
    _monitored: tuple[float, list[str]] = (0.0, [])

    @classmethod
    def under(cls, folder: str) -> ScoringTables:
        return cls(folder)

    def table(self, name: str) -> BatchTable:
        return BatchTable(f"{self.folder}/{name}", "id" if name in ("predictions", "explanations") else None, self.buckets)

    def start(
        self, stream: DataFrame, settings: Settings, demo: bool = True, seconds: int | None = None, score: Callable[[DataFrame], DataFrame] | None = None, log: tuple[str, ...] = (),
        send: Callable[[DataFrame], None] | None = None, message_id: str | None = None, event_time: str | None = None, late: str = "1 hour", jobs: dict[str, tuple[float, Callable[[], object]]] | None = None,
    ) -> StreamingQuery:
        """Score and tier a stream and write each batch to all tables.

        ``score`` turns a batch of raw records into ``id``, ``y``, ``p``, ``amt`` and the
        columns ``log``, whose values are kept for drift; without it the stream has these.
        ``send`` gets each batch of predictions too (a Kafka batch writer, say). The
        thresholds are read anew for each batch from the ``config`` table, so what a
        re-optimisation publishes takes effect. Truth is kept only in demo mode. A batch
        that cannot be scored, for its records or for the code, goes to the dead letters and
        the stream goes on; any other error fails the batch, which is then run again and
        replaces itself. With ``message_id`` a message that is delivered again within
        ``late`` of its ``event_time`` counts once, whatever batch it comes in. ``jobs`` are
        run behind a batch once their seconds have passed since they last ran, also by
        another run of the stream. ``seconds`` triggers by time; without it the stream ends
        with what there is now.
        """
        spark = stream.sparkSession
        if message_id:
            stream = stream.withWatermark(event_time, late).dropDuplicatesWithinWatermark([message_id])

        def write(batch: DataFrame, number: int) -> None:
            if exists(spark, self._mark(number)):  # whole already; only Spark's own note of it was lost
                return
            hard = self.threshold(spark, settings.hard_threshold)
            soft = min(settings.soft_threshold, hard * 0.999)
            truth = F.col("y") if demo else F.lit(None).cast("int")
            out = None
            try:
                rows = score(batch) if score else batch
                out = rows.select("id", truth.alias("y_true"), "p", "amt", tier(F.col("p"), soft, hard).alias("action"), (F.col("p") >= hard).cast("int").alias("is_fraud"), F.current_timestamp().alias("written"), *[F.col(c).cast("double").alias(f"_log_{c}") for c in log]).persist()
                out.count()
            except _OF_SCORING as e:  # nothing has been written yet
                letters = batch.select(F.to_json(F.struct("*")).alias("original_message"))
                self.table("dead_letters").put(dead_letters(letters, "scoring failed", F.lit(str(e)[:500])), number)
                return
            try:
                said = out.drop(*[f"_log_{c}" for c in log])
                self.table("predictions").put(said, number)
                self.table("alerts").put(said.filter("is_fraud = 1"), number)
                if log:
                    self.table("history").put(out.select("id", "written", *[F.col(f"_log_{c}").alias(c) for c in log]).unpivot(["id", "written"], list(log), "feature", "value"), number)
                caught, missed = ((F.col("y_true") == 1) & (F.col("is_fraud") == k) for k in (1, 0))
                figures = out.agg(F.count("*").alias("n"), F.count("y_true").alias("known"), F.count_if(F.col("is_fraud") == 1).alias("fraud"), *[F.coalesce(F.sum(F.when(c, F.col("amt"))), F.lit(0.0)).alias(m) for c, m in ((caught, "savings"), (missed, "loss"))])
                self.table("counters").put(figures, number)
                if send:
                    send(said)
            finally:
                out.unpersist()
            write_once(spark, self._mark(number), {"batch": number})
            self._run_due(spark, jobs or {})

        w = stream.writeStream.option("checkpointLocation", f"{self.folder}/checkpoint").foreachBatch(write)
        return (w.trigger(processingTime=f"{seconds} seconds") if seconds else w.trigger(availableNow=True)).start()

    def _mark(self, number: int) -> str:
        """The file that says that all tables have a batch."""
        return f"{self.folder}/commits/{number:012d}.json"

    def _run_due(self, spark: SparkSession, jobs: dict[str, tuple[float, Callable[[], object]]]) -> None:
        for name, (every, job) in jobs.items():
            now = time.time()
            ran = [int(n.removesuffix(".json")) for n in folder_names(spark, f"{self.folder}/jobs/{name}") if n.endswith(".json")]
            if not ran or now - max(ran) / 1000 >= every:
                job()
                write_once(spark, f"{self.folder}/jobs/{name}/{int(now * 1000)}.json", {"at": now})
                for old in ran:
                    delete(spark, f"{self.folder}/jobs/{name}/{old}.json")

    def predictions(self, spark: SparkSession) -> DataFrame:
        return self.table("predictions").read(spark)

    def recent(self, spark: SparkSession, n: int = 1000) -> DataFrame:
        """The newest predictions."""
        return self.predictions(spark).orderBy(F.col("batch").desc(), F.col("id").desc()).limit(n)

    def alerts(self, spark: SparkSession, n: int = 100) -> DataFrame:
        """The newest alerts."""
        return self.table("alerts").read(spark).orderBy(F.col("batch").desc(), F.col("id").desc()).limit(n)

    def lookup(self, spark: SparkSession, key, now: Column | None = None, ttl_seconds: int = 3600) -> DataFrame:
        """A record's last prediction, with its explanations, if it is within its time to live.

        One bucket of the base and the batches since the last merge are read.
        """
        said = self.enriched(spark, key).filter(F.unix_seconds(now if now is not None else F.current_timestamp()) - F.unix_seconds("written") < ttl_seconds)
        return said.orderBy(F.col("batch").desc()).limit(1)

    def history(self, spark: SparkSession, n: int = 1000) -> DataFrame:
        """The newest ``n`` values of each logged feature."""
        return newest_rows(n, ["id"], ("feature",))(self.table("history").read(spark))

    def compact(self, spark: SparkSession, ttl_seconds: int | None = 3600, alerts: int = 100, points: int = 1000, now: Column | None = None) -> None:
        """Merge all tables' batches into their bases and let go what is no longer asked for.

        Predictions and explanations keep the newest row of each id within its time to live,
        alerts the newest ones, histories the newest points of each feature, importances the
        last batch; counters become one row. Dead letters stay. Where a second stream
        explains predictions, only batches that it has read are merged.
        """
        read = self._explained_upto(spark)
        self.table("predictions").compact(spark, newest_of_key("id", ttl_seconds, now), read)
        explained = self.table("predictions").read(spark)
        if explained is not None:
            ids = explained.select("id").distinct()
            self.table("explanations").compact(spark, lambda rows: newest_of_key("id")(rows.join(ids, "id", "left_semi")))
        self.table("alerts").compact(spark, newest_rows(alerts, ["id"]))
        self.table("history").compact(spark, newest_rows(points, ["id"], ("feature",)))
        self.table("importance").compact(spark, last_batch)
        self.table("counters").compact(spark, summed(_COUNTED))

    def _explained_upto(self, spark: SparkSession) -> int | None:
        """The last batch that the enrichment has finished; None if there is no enrichment."""
        if not exists(spark, f"{self.folder}/checkpoint-enrich"):
            return None
        table = self.table("explanations")
        return max([-1, *table.bases(spark), *table.batches(spark)])

    def enrich(self, spark: SparkSession, explain: Callable[[DataFrame], DataFrame], alpha: float = 0.1, top: int = 50) -> StreamingQuery:
        """A second stream over the finished batches that explains their predictions, and averages what is important.

        It reads the marks of finished batches, one at a time, so a batch that is still
        being written or replaced is never read. ``explain`` gives ``id`` and
        ``explanations`` of a batch. A batch that fails is marked so, with the error, and
        moves no importance.
        """

        def write(marks: DataFrame, _: int) -> None:
            for number in sorted(r.batch for r in marks.collect()):
                rows = self.predictions(spark).filter(F.col("batch") == number).drop("batch")
                try:
                    said = explain(rows).select("id", "explanations", F.lit("ready").alias("status"), F.lit(None).cast("string").alias("error")).persist()
                    said.count()
                except _OF_SCORING as e:
                    self.table("explanations").put(rows.select("id", F.lit(None).cast(_IMPACTS).alias("explanations"), F.lit("failed").alias("status"), F.lit(str(e)[:500]).alias("error")), number)
                    continue
                self.table("explanations").put(said, number)
                self.table("importance").put(self._averaged(spark, said, number, alpha, top), number)
                said.unpersist()

        stream = spark.readStream.schema("batch long").option("maxFilesPerTrigger", 1).json(f"{self.folder}/commits")
        return stream.writeStream.option("checkpointLocation", f"{self.folder}/checkpoint-enrich").trigger(availableNow=True).foreachBatch(write).start()

    def _averaged(self, spark: SparkSession, said: DataFrame, number: int, alpha: float, top: int) -> DataFrame:
        """The moving average of importances after a batch, from the one before it."""
        new = mean_impacts(said)
        old = self.importance(spark, number)
        merged = new if old is None else merge_importance(old, new, alpha)
        return merged.orderBy(F.col("value").desc(), "feature").limit(top)

    def importance(self, spark: SparkSession, before: int | None = None) -> DataFrame | None:
        """The newest importances, or those before a batch; None if there are none yet."""
        all_ = self.table("importance").read(spark)
        if all_ is None:
            return None
        all_ = all_ if before is None else all_.filter(F.col("batch") < before)
        last = all_.agg(F.max("batch").alias("b")).first().b
        return None if last is None else all_.filter(F.col("batch") == last).select("feature", "value")

    def monitored(self, spark: SparkSession, n: int = 50) -> list[str]:
        """The most important features, read anew at most every ``refresh_seconds``."""
        at, names = self._monitored
        if not names or time.monotonic() - at > self.refresh_seconds:
            found = self.importance(spark)
            names = [] if found is None else [r.feature for r in found.orderBy(F.col("value").desc(), "feature").limit(n).collect()]
            self._monitored = (time.monotonic(), names)
        return names

    def enriched(self, spark: SparkSession, key=None) -> DataFrame:
        """Predictions (of one id, or all) with the newest explanations of their batch or a later one, and ``status``: processing, ready or failed."""
        said = self.table("predictions").read(spark, key)
        more = self.table("explanations").read(spark, key)
        if more is None:
            return said.select("*", F.lit(None).cast(_IMPACTS).alias("explanations"), F.lit("processing").alias("status"), F.lit(None).cast("string").alias("error"))
        last = more.groupBy("id").agg(F.max_by(F.struct("explanations", "status", "error"), "batch").alias("_e"), F.max("batch").alias("_at"))
        # an explanation of an earlier prediction of the same id does not explain this one
        both = said.join(last, "id", "left").withColumn("_e", F.when(F.col("_at") >= F.col("batch"), F.col("_e")))
        return both.select(*said.columns, "_e.explanations", F.coalesce("_e.status", F.lit("processing")).alias("status"), "_e.error")

    def totals(self, spark: SparkSession) -> DataFrame:
        """The counters over all batches; a replayed batch counts once."""
        return self.table("counters").read(spark).agg(*[F.sum(c).alias(c) for c in _COUNTED])

    def publish_threshold(self, spark: SparkSession, value: float, seen: int = 0) -> None:
        """Write a new version, with the rows it was found on; readers take the newest whole one."""
        spark.createDataFrame([(float(value), seen)], "hard double, seen long").coalesce(1).write.parquet(f"{self.folder}/config/version={time.time_ns()}")

    def _published(self, spark: SparkSession):
        try:
            return spark.read.schema("hard double, seen long, version long").parquet(f"{self.folder}/config").orderBy(F.col("version").desc()).first()
        except AnalysisException:  # nothing was published yet
            return None

    def threshold(self, spark: SparkSession, default: float) -> float:
        row = self._published(spark)
        return row.hard if row else default

    def reoptimise(self, spark: SparkSession, least_new: int = 1000, seen: int | None = None) -> tuple[float | None, int]:
        """Publish the cheapest threshold if there are ``least_new`` rows more than ``seen``, by default those of the last time."""
        from riskengine.operators.evaluate import best_threshold_cost

        if seen is None:
            last = self._published(spark)
            seen = last.seen if last else 0
        rows = self.predictions(spark).filter("y_true IS NOT NULL").select(F.col("y_true").alias("y"), "p", "amt")
        n = self.totals(spark).first().known or 0
        if n - seen < least_new:
            return None, seen
        best = best_threshold_cost(rows).first().threshold
        self.publish_threshold(spark, best, n)
        return best, n


#: What is counted over all batches; ``known`` are rows with a truth.
_COUNTED = ("n", "known", "fraud", "savings", "loss")
_IMPACTS = "array<struct<feature:string,impact:double>>"


def throughput(query: StreamingQuery) -> dict[str, float]:
    """Rows, rows a second and milliseconds a row over the batches that the query still knows."""
    done = [p for p in query.recentProgress if p.numInputRows]
    rows, ms = sum(p.numInputRows for p in done), sum(p.batchDuration for p in done)
    return {"rows": float(rows), "rows_per_second": 1000 * rows / ms if ms else 0.0, "latency_ms": ms / rows if rows else 0.0}


def retain(spark: SparkSession, table: str, seconds: int, now: float) -> DataFrame:
    """The rows of a prediction table that are younger than its time to live."""
    return spark.read.parquet(table).filter(F.lit(now) - F.unix_timestamp("written") < seconds)
