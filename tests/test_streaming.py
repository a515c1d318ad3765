"""Keyed state, tables of batches, replays and restarts of streams."""

from __future__ import annotations

import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskengine.operators import features as fe
from riskengine.sources import readers as rd
from riskengine.streaming import streams as st
from riskengine.streaming import tables as tb
from riskengine.streaming.replay import _line_end, replay_csv

TX = "TransactionID long, TransactionDT long, TransactionAmt double, UID string"
SCORED = "id long, y int, p double, amt double, ts timestamp"


def batches(path, frames) -> None:
    for k, df in enumerate(frames):
        df.coalesce(1).write.parquet(f"{path}/{k}")
        time.sleep(0.02)


def stream(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")


# --- state


@pytest.mark.parametrize("timed", [False, True])
def test_pieces_by_hour_give_what_the_batch_query_gives(spark, tmp_path, timed):
    draw = np.random.default_rng(1)
    rows = sorted((int(t), None if draw.random() < 0.1 else float(draw.integers(1, 90)), "hot" if draw.random() < 0.8 else f"u{draw.integers(0, 4)}") for t in draw.integers(0, 4 * 86400, 700))
    rows += [(rows[-1][0], 5.0, "hot"), (rows[-1][0], 6.0, "hot")]
    full = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], TX).withColumn("ts", F.timestamp_seconds("TransactionDT"))
    batches(tmp_path / "in", [full.filter(f"TransactionID BETWEEN {a} AND {b}") for a, b in ((0, 99), (100, 101), (102, 480), (481, 999))])
    got = st.run_to_table(st.keyed_velocity(stream(spark, tmp_path / "in", full.schema), 24, event_time="ts" if timed else None, late="2 hours"), "append", "v").collect()
    want = {r.TransactionID: (r.UID_count_24h, r.UID_amt_sum_24h) for r in fe.velocity(full.drop("ts"), (24,), fill_single=True).collect()}
    assert len(got) == len(rows) and all((r.count_24h, pytest.approx(r.amt_sum_24h)) == want[r.TransactionID] for r in got)


def test_hours_that_no_record_needs_are_not_written(monkeypatch):
    """A year of one user in one batch: only the pieces within reach of its newest record go to the state."""
    import pandas as pd

    from riskengine.streaming.state import VelocityState

    class Table(dict):
        updateValue, removeKey, getValue = dict.__setitem__, dict.pop, dict.__getitem__
        iterator = dict.items

    class Handle(dict):
        timers: list = []
        getMapState = lambda self, name, *_: self.setdefault(name, Table())
        registerTimer = lambda self, at: self.timers.append(at)

    class Zero:
        getCurrentWatermarkInMs = lambda self: 0

    draw = np.random.default_rng(4)
    at = np.sort(draw.integers(0, 365 * 86400, 3000))
    amt = np.where(draw.random(3000) < 0.1, np.nan, draw.integers(1, 90)).astype(float)
    amt[10] = 1e18  # does not blur the sums of later days
    state, handle = VelocityState(24, "u", "t", "a", "r", 0, True, 86400), Handle()
    state.init(handle)
    frames = [pd.DataFrame({"r": np.arange(3000).astype(str), "t": at, "a": amt}).iloc[s] for s in (slice(0, 2900), slice(2900, 3000))]
    got = pd.concat(x for f in frames for x in state.handleInputRows(("k",), iter([f]), Zero()))
    for r in got.itertuples():
        mine = amt[(at >= at[int(r.r)] - 86400) & (at < at[int(r.r)])]
        assert (r.count_24h, r.amt_sum_24h) == ((~np.isnan(mine)).sum(), pytest.approx(np.nansum(mine)))
    assert len(handle["pieces"]) < 150 and set(handle["pieces"]) == set(handle["sums"]) and len(handle.timers) < 200


def test_rows_just_a_gap_apart_are_of_two_sessions(spark, tmp_path):
    rows = [(1, 0), (1, 21600), (1, 43199), (2, 500000), (2, 500001)]
    full = spark.createDataFrame(rows, "card1 long, at long").withColumn("ts", F.timestamp_seconds("at"))
    batches(tmp_path / "in", [full.filter("card1 = 2"), full.filter("card1 = 1")])  # the second batch is older by days
    out = st.run_to_table(st.sessions(stream(spark, tmp_path / "in", full.schema), "ts", "6 hours", None, ("card1",)), "complete", "s")
    got = out.select("card1", F.unix_seconds("start").alias("start"), F.unix_seconds("end").alias("end"), "n").collect()
    assert sorted(map(tuple, got)) == [(1, 0, 21600, 1), (1, 21600, 43199 + 21600, 2), (2, 500000, 521601, 2)]


def test_records_without_a_time_and_late_ones(spark, tmp_path):
    a = spark.createDataFrame([(1, 100 * 3600, 1.0, "a"), (2, None, 1.0, "a"), (3, 103 * 3600, None, "a")], TX)
    b = spark.createDataFrame([(4, 101 * 3600, 2.0, "a"), (5, 104 * 3600, 4.0, "a"), (6, 140 * 3600, 4.0, "a"), (7, 164 * 3600, 8.0, "a")], TX)
    batches(tmp_path / "in", [a, b])
    got = {r.TransactionID: (r.count_24h, r.amt_sum_24h) for r in st.run_to_table(st.keyed_velocity(stream(spark, tmp_path / "in", a.schema), 24), "append", "v").collect()}
    assert got == {1: (0, 0.0), 2: (None, None), 3: (1, 1.0), 4: (1, 1.0), 5: (2, 3.0), 6: (0, 0.0), 7: (1, 4.0)}


def throttle_loop(points, seconds, least):
    """(seq, total) of the points that a plain loop emits."""
    out, total, last = [], 0.0, None
    for seq, at, delta in sorted(points, key=lambda p: (p[1], p[0])):
        total += delta
        if last is None or at - last[0] >= seconds or abs(total - last[1]) >= least:
            out.append((seq, pytest.approx(total)))
            last = (at, total)
    return out


def test_a_throttled_series_goes_on_over_batches(spark, tmp_path):
    draw = np.random.default_rng(6)
    rows = [(str(draw.choice(["a", "b"])), k, float(k // 2 * 3), float(draw.normal(0, 20))) for k in range(400)]
    full = spark.createDataFrame(rows, "series string, seq long, at double, delta double")
    batches(tmp_path / "in", [full.filter(f"seq >= {a} AND seq < {b}") for a, b in ((0, 150), (150, 152), (152, 400))])
    got = st.run_to_table(st.throttled(stream(spark, tmp_path / "in", full.schema), 10.0, 50.0), "append", "t").collect()
    for series in "ab":
        mine = sorted((r.seq, r.total) for r in got if r.series == series)
        assert mine == throttle_loop([r[1:] for r in rows if r[0] == series], 10.0, 50.0) and 20 < len(mine) < 200


# --- tables of batches


def test_a_merge_keeps_the_newest_of_each_key_and_bounds_the_files(spark, tmp_path):
    table = tb.BatchTable(str(tmp_path / "t"), "id", buckets=4)
    assert table.read(spark) is None and table.compact(spark, tb.newest_of_key("id")) is None
    for n in range(6):
        table.put(spark.range(10 * n, 10 * n + 30).select("id", F.lit(n).alias("v"), F.current_timestamp().alias("written")), n)
        if n in (2, 3, 5):
            table.compact(spark, tb.newest_of_key("id"))
    got = {r.id: r.v for r in table.read(spark).collect()}
    assert got == {k: min(5, k // 10) if k >= 0 else 0 for k in range(80)}
    assert table.bases(spark) == [3, 5] and table.batches(spark) == [4, 5] and table.files(spark) <= 2 * 4 + 2 * 4
    table.put(spark.createDataFrame([(3, 99)], "id long, v int").withColumn("written", F.current_timestamp()), 6)
    assert {(r.v, r.batch) for r in table.read(spark, 3).collect()} == {(0, 0), (99, 6)}


def test_a_lookup_reads_one_bucket(spark, tmp_path):
    table = tb.BatchTable(str(tmp_path / "t"), "id", buckets=8)
    table.put(spark.range(1000).select("id", F.current_timestamp().alias("written")), 0)
    table.compact(spark, tb.newest_of_key("id"))
    found = table.read(spark, 77)
    assert [r.id for r in found.collect()] == [77] and len(found.inputFiles()) == 8
    scan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in scan
    read = found._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().get("numFiles").get().value()
    assert read == 1


def test_rows_past_their_time_to_live_go(spark, tmp_path):
    table = tb.BatchTable(str(tmp_path / "t"), "id")
    for n, at in enumerate(("2024-01-01 00:00:00", "2024-01-01 00:50:00")):
        table.put(spark.createDataFrame([(n,), (9,)], "id long").withColumn("written", F.lit(at).cast("timestamp")), n)
    table.compact(spark, tb.newest_of_key("id", 3600, F.lit("2024-01-01 01:20:00").cast("timestamp")))
    assert sorted((r.id, r.batch) for r in table.read(spark).collect()) == [(1, 1), (9, 1)]


def test_an_unfinished_merge_or_batch_does_not_count(spark, tmp_path):
    table = tb.BatchTable(str(tmp_path / "t"), "id")
    table.put(spark.range(3).withColumn("written", F.current_timestamp()), 0)
    os.makedirs(tmp_path / "t/base/upto=0")
    os.makedirs(tmp_path / "t/batch=1")
    assert table.read(spark).count() == 3 and table.bases(spark) == [] and table.batches(spark) == [0]
    assert table.compact(spark, tb.newest_of_key("id")) == 0 and table.read(spark).count() == 3


def test_a_small_file_is_written_once(spark, tmp_path):
    assert tb.write_once(spark, str(tmp_path / "a/b/1.json"), {"x": 1}) and not tb.write_once(spark, str(tmp_path / "a/b/1.json"), {"x": 2})
    assert (tmp_path / "a/b/1.json").read_text() == '{"x": 1}' and tb.folder_names(spark, str(tmp_path / "none")) == []


# --- the scoring stream


def scored(spark, ids, batch=0, p=0.5):
    return spark.createDataFrame([(int(i), int(i % 2), float(p), 10.0) for i in ids], "id long, y int, p double, amt double").withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000 + 60 * batch)))


def test_a_message_delivered_again_counts_once(spark, tmp_path):
    batches(tmp_path / "in", [scored(spark, [*range(50), 7, 7], 0), scored(spark, [*range(30, 80)], 1), scored(spark, [3, 79, 99], 2)])
    tables = st.ScoringTables(str(tmp_path / "out"))
    for _ in range(2):  # the second start finds nothing new
        tables.start(stream(spark, tmp_path / "in", SCORED), rd.Settings(), message_id="id", event_time="ts").awaitTermination()
    assert tables.totals(spark).first().n == 81 and sorted(r.id for r in tables.predictions(spark).collect()) == [*range(80), 99]


def test_a_batch_run_again_replaces_itself(spark, tmp_path):
    """A batch that fails half-written is run again by the next start, and one that was whole is left as it was."""
    batches(tmp_path / "in", [scored(spark, range(20), 0), scored(spark, range(20, 40), 1)])
    tables, calls = st.ScoringTables(str(tmp_path / "out")), []

    def send(b):
        calls.append(b.count())
        if len(calls) == 2:
            raise OSError("disk")

    with pytest.raises(Exception, match="disk"):
        tables.start(stream(spark, tmp_path / "in", SCORED), rd.Settings(), send=send).awaitTermination()
    tables.start(stream(spark, tmp_path / "in", SCORED), rd.Settings(), send=send).awaitTermination()
    assert calls == [20, 20, 20] and tables.totals(spark).first().n == 40 and tables.predictions(spark).count() == 40


def test_only_errors_of_scoring_are_dead_letters(spark, tmp_path):
    batches(tmp_path / "in", [scored(spark, range(4))])
    lost = st.ScoringTables(str(tmp_path / "lost"))

    def gone(b):
        raise RuntimeError("executor lost")

    with pytest.raises(Exception, match="executor lost"):
        lost.start(stream(spark, tmp_path / "in", SCORED), rd.Settings(), score=gone).awaitTermination()
    bad = st.ScoringTables(str(tmp_path / "bad"))
    bad.start(stream(spark, tmp_path / "in", SCORED), rd.Settings(), score=lambda b: b.select("no_such_column")).awaitTermination()
    assert not (tmp_path / "lost/dead_letters").exists() and bad.table("dead_letters").read(spark).count() == 4


def test_enrichment_reads_whole_batches_and_the_newest_explanation_counts(spark, tmp_path):
    batches(tmp_path / "in", [scored(spark, range(10), 0), scored(spark, range(5, 15), 1)])
    tables = st.ScoringTables(str(tmp_path / "out"))
    tables.start(stream(spark, tmp_path / "in", SCORED), rd.Settings(), log=("amt",)).awaitTermination()
    seen = []

    def explain(df):
        seen.append(sorted(r.id for r in df.collect()))
        return df.select("id", F.array(F.struct(F.lit("a").alias("feature"), F.lit(float(len(seen))).alias("impact"))).alias("explanations"))

    for _ in range(2):
        tables.enrich(spark, explain).awaitTermination()
    assert seen == [[*range(10)], [*range(5, 15)]]
    found = tables.lookup(spark, 7).first()
    assert (found.batch, found.status, found.explanations[0].impact) == (1, "ready", 2.0)
    tables.compact(spark)
    assert tables.lookup(spark, 7).first().explanations[0].impact == 2.0 and tables.lookup(spark, 2).first().explanations[0].impact == 1.0
    assert tables.predictions(spark).count() == 15 and tables.totals(spark).first().n == 20 and tables.history(spark, 100).count() == 20
    assert {r.feature: r.value for r in tables.importance(spark).collect()} == pytest.approx({"a": 0.9 + 0.2})


def test_merging_waits_for_the_enrichment(spark, tmp_path):
    batches(tmp_path / "in", [scored(spark, range(10), 0)])
    tables = st.ScoringTables(str(tmp_path / "out"))
    run = lambda: tables.start(stream(spark, tmp_path / "in", SCORED), rd.Settings()).awaitTermination()
    explain = lambda df: df.select("id", F.array(F.struct(F.lit("a").alias("feature"), F.lit(1.0).alias("impact"))).alias("explanations"))
    run()
    tables.enrich(spark, explain).awaitTermination()
    scored(spark, range(5, 12), 1).coalesce(1).write.parquet(str(tmp_path / "in/1"))
    run()
    tables.compact(spark)
    assert tables.table("predictions").bases(spark) == [0]  # batch 1 is not explained yet
    tables.enrich(spark, explain).awaitTermination()
    assert tables.table("explanations").read(spark, 11).count() == 1
    tables.compact(spark)
    assert tables.table("predictions").bases(spark) == [0, 1] and tables.predictions(spark).count() == 12


def test_jobs_run_when_they_are_due(spark, tmp_path):
    batches(tmp_path / "in", [scored(spark, range(600 * k, 600 * k + 600), k, 0.2) for k in range(3)])
    tables, ran = st.ScoringTables(str(tmp_path / "out")), []
    jobs = {"often": (0.0, lambda: ran.append("often")), "seldom": (3600.0, lambda: ran.append("seldom")), "threshold": (0.0, lambda: ran.append(tables.reoptimise(spark)[1]))}
    tables.start(stream(spark, tmp_path / "in", SCORED), rd.Settings(), jobs=jobs).awaitTermination()
    # the threshold is found anew for a thousand new rows, and remembers how many there were
    assert ran == ["often", "seldom", 0, "often", 1200, "often", 1200]
    tables.start(stream(spark, tmp_path / "in", SCORED), rd.Settings(), jobs=jobs).awaitTermination()
    assert len(ran) == 7 and len(tb.folder_names(spark, str(tmp_path / "out/jobs/seldom"))) == 1


# --- replay of files


ROW = T.StructType([T.StructField("id", T.LongType()), T.StructField("amt", T.DoubleType()), T.StructField("who", T.StringType()), T.StructField("not_there", T.StringType())])


class Run:
    """A replay that can be started again; ``got`` has the ids of each batch that had rows."""

    def __init__(self, spark, tmp_path, **limits) -> None:
        self.spark, self.folder, self.check, self.limits, self.got = spark, tmp_path / "in", str(tmp_path / "check"), limits, []
        self.folder.mkdir(exist_ok=True)

    def start(self, seconds: float | None = None):
        def keep(b, _):
            ids = sorted(r.id for r in b.collect())
            if ids:
                self.got.append((time.time(), ids))

        position = f"{self.check}-position.json" if self.limits else None
        w = replay_csv(self.spark, str(self.folder), ROW, position=position, **self.limits).writeStream.option("checkpointLocation", self.check).foreachBatch(keep)
        return (w.trigger(processingTime=f"{int(seconds * 1000)} milliseconds") if seconds else w.trigger(availableNow=True)).start()

    def all(self) -> list[list[int]]:
        self.start().awaitTermination()
        out, self.got = [ids for _, ids in self.got], []
        return out

    def write(self, name, ids, mode="w", end="\n") -> None:
        with open(self.folder / name, mode) as f:
            f.write(("id,who,amt\n" if mode == "w" else "") + "\n".join(f"{i},w{i},{i}.5" for i in ids) + (end if ids else ""))


def test_appended_and_replaced_files_are_read_once_each(spark, tmp_path):
    run = Run(spark, tmp_path)
    assert run.all() == []
    run.write("a.csv", range(5))
    run.write("b.csv", range(100, 103))
    assert run.all() == [[0, 1, 2, 3, 4, 100, 101, 102]]
    assert run.all() == []
    run.write("a.csv", range(5, 8), "a")  # appended
    assert run.all() == [[5, 6, 7]]
    run.write("b.csv", range(200, 202))  # replaced, shorter
    assert run.all() == [[200, 201]]
    run.write("b.csv", range(300, 302))  # replaced, as long
    assert run.all() == [[300, 301]]
    run.write("b.csv", range(400, 420))  # replaced, longer
    assert run.all() == [[*range(400, 420)]]
    assert run.all() == []


def test_a_running_replay_sees_changes_and_goes_on_after_a_restart(spark, tmp_path):
    run = Run(spark, tmp_path)
    run.write("a.csv", range(3))
    q = run.start(0.2)
    try:
        for want, change in (([0, 1, 2], None), ([3, 4], lambda: run.write("a.csv", [3, 4], "a")), ([50], lambda: run.write("a.csv", [50]))):
            if change:
                change()
            end = time.time() + 20
            while time.time() < end and not (run.got and run.got[-1][1] == want):
                time.sleep(0.1)
            assert run.got[-1][1] == want
        time.sleep(2)
    finally:
        q.stop()
    assert [ids for _, ids in run.got] == [[0, 1, 2], [3, 4], [50]]
    run.got.clear()
    run.write("a.csv", [51], "a")
    assert run.all() == [[51]]


def test_batches_are_formed_by_size_or_age(spark, tmp_path):
    run = Run(spark, tmp_path, batch_rows=10, batch_seconds=4.0)
    run.write("a.csv", range(25))
    began = time.time()
    q = run.start(0.1)
    try:
        end = began + 30
        while time.time() < end and len(run.got) < 3:
            time.sleep(0.1)
        time.sleep(2)  # else the third batch is not noted as done, and run again
    finally:
        q.stop()
    (first, a), (second, b), (third, c) = run.got
    assert (a, b, c) == ([*range(10)], [*range(10, 20)], [*range(20, 25)])
    assert third - second > 3.0 and second - first < 3.0  # two by size, and what is left by age
    run.write("a.csv", range(30, 55), "a")
    run.got.clear()
    q = run.start(0.1)  # started again, batches have the same size
    try:
        end = time.time() + 30
        while time.time() < end and len(run.got) < 3:
            time.sleep(0.1)
    finally:
        q.stop()
    assert [ids for _, ids in run.got] == [[*range(30, 40)], [*range(40, 50)], [*range(50, 55)]]
    with pytest.raises(ValueError, match="position"):
        replay_csv(spark, str(tmp_path / "in"), ROW, batch_rows=10)


def test_what_a_line_is(spark, tmp_path):
    run = Run(spark, tmp_path, batch_seconds=0.0)
    run.write("a.csv", [1, 2], end="")  # a last line without an end, and the file is quiet
    assert run.all() == [[1, 2]]
    (tmp_path / "in/b.csv").write_text("id,who,amt\n7,,nan\n")
    (tmp_path / "in/empty.csv").write_text("")
    (tmp_path / "in/other.txt").write_text("id\n9\n")
    rows = []
    replay_csv(spark, str(tmp_path / "in"), ROW).writeStream.option("checkpointLocation", run.check).trigger(availableNow=True).foreachBatch(lambda b, _: rows.extend(b.collect())).start().awaitTermination()
    assert [tuple(r) for r in rows] == [(7, None, None, None)]


def test_line_ends_are_found_across_blocks(tmp_path, monkeypatch):
    import pyarrow as pa

    from riskengine.streaming import replay

    monkeypatch.setattr(replay, "_LOOK", 7)
    text = b"".join(b"x" * k + b"\n" for k in range(30)) + b"tail"
    (tmp_path / "f").write_bytes(text)
    with pa.OSFile(str(tmp_path / "f")) as f:
        for n in (1, 2, 3, 10, 29, 30):
            at, seen = _line_end(f, 0, len(text), n)
            assert seen == n and text[:at].count(b"\n") == n and text[at - 1 : at] == b"\n"
        assert _line_end(f, 0, len(text), 99) == (len(text) - 4, 30) and _line_end(f, len(text) - 2, len(text), 5) == (len(text) - 2, 0)


def test_kafka_batches_have_the_same_limits():
    assert rd.kafka_limits(100, 5.0) == {"maxOffsetsPerTrigger": "100", "minOffsetsPerTrigger": "100", "maxTriggerDelay": "5000ms"}
    assert rd.kafka_limits(100, None) == {"maxOffsetsPerTrigger": "100"} and rd.kafka_limits(None, 5.0) == {}
