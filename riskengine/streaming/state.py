"""Keyed state with pieces and timers: what a batch touches is read and written, not all that a key has."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HOUR = 3600


def use_rocksdb(spark: SparkSession) -> None:
    """State variables and timers need this store; another one that a session names is left alone and Spark says so."""
    if "HDFSBacked" in (spark.conf.get(_PROVIDER, None) or "HDFSBacked"):
        spark.conf.set(_PROVIDER, _ROCKSDB)


def sums_before(at: np.ndarray, amt: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Count and sum of known amounts in the ``span`` before each of some sorted times.

    A window is the end of one stretch of ``span`` and the beginning of the next, so two
    running sums, one from either end of each stretch, give it without a difference.
    """
    known = ~np.isnan(amt)
    upto_n, value, stretch = np.concatenate([[0], np.cumsum(known)]), np.where(known, amt, 0.0), np.floor(at / span)
    begin = np.searchsorted(stretch, stretch, "left")
    parts = np.split(value, np.flatnonzero(np.diff(stretch)) + 1)
    from_start, to_end = np.concatenate([np.cumsum(x) for x in parts]), np.concatenate([np.cumsum(x[::-1])[::-1] for x in parts])
    lo, hi = np.searchsorted(at, at - span, "left"), np.searchsorted(at, at, "left")
    total = np.where(hi > begin, from_start[hi - 1], 0.0) + np.where(lo < begin, to_end[lo], 0.0)
    return upto_n[hi] - upto_n[lo], total


class VelocityState(StatefulProcessor):
    """A user's amounts as one sorted piece for each hour, and the pieces' counts and sums.

    A batch's records see each other by running sums, and what earlier batches left by its
    pieces: the end of one, whole hours by their sums, and the beginning of another. A batch
    reads the pieces its records and their windows begin in, and writes those it adds to, but
    for hours that no record within ``late`` of the user's newest one needs. A piece goes by
    its own timer, or without timers once it is older than any window of the newest record.
    """

    def __init__(self, hours: int, user: str, time_col: str, amount: str, row: str, epoch: int, timers: bool, late: int = 0) -> None:
        self.hours, self.user, self.time_col, self.amount, self.row, self.epoch, self.timers, self.late = hours, user, time_col, amount, row, epoch, timers, late

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._pieces = handle.getMapState("pieces", "hour long", "times array<double>, amounts array<double>")
        self._sums = handle.getMapState("sums", "hour long", "n long, total double")

    def _gone(self, hour: int) -> int:
        """The event time in milliseconds after which no window needs an hour."""
        return ((hour + 1 + self.hours) * HOUR + self.epoch) * 1000

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(rows).sort_values([self.time_col, self.row], kind="stable")
        timed = new[new[self.time_col].notna()]
        at, amt = timed[self.time_col].to_numpy(float), timed[self.amount].to_numpy(float)
        hour, span = np.floor(at / HOUR).astype(int), self.hours * HOUR
        sums = {k[0]: (v[0], v[1]) for k, v in self._sums.iterator()}
        n, total = sums_before(at, amt, span) if len(at) else (np.zeros(0, np.int64), np.zeros(0))
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def piece(h: int) -> tuple[np.ndarray, np.ndarray]:
            if h not in held:
                held[h] = tuple(np.array(x, float) for x in self._pieces.getValue((h,))) if h in sums else (np.zeros(0), np.zeros(0))
            return held[h]

        begin, old = np.floor((at - span) / HOUR).astype(int), np.array(sorted(sums), int)
        seen = np.flatnonzero(np.searchsorted(old, hour, "right") > np.searchsorted(old, begin, "left"))
        for first, last in set(zip(begin[seen].tolist(), hour[seen].tolist(), strict=True)):
            mine = seen[(hour[seen] == last) & (begin[seen] == first)]
            whole = [sums[h] for h in range(first + 1, last) if h in sums]
            for h, ends, edge in ((first, True, at[mine] - span), (last, False, at[mine])):
                times, amounts = piece(h)
                known = ~np.isnan(amounts)
                upto_n, value = np.concatenate([[0], np.cumsum(known)]), np.where(known, amounts, 0.0)
                k = np.searchsorted(times, edge, "left")
                n[mine] += upto_n[-1] - upto_n[k] if ends else upto_n[k]
                total[mine] += np.append(np.cumsum(value[::-1])[::-1], 0.0)[k] if ends else np.concatenate([[0.0], np.cumsum(value)])[k]
            n[mine] += sum(c for c, _ in whole)
            total[mine] += sum(s for _, s in whole)
        if len(at):
            self._keep(at, amt, hour, sums, piece, timerValues)
        names = [f"count_{self.hours}h", f"amt_sum_{self.hours}h"]
        yield pd.DataFrame({self.row: timed[self.row], self.user: key[0], names[0]: n, names[1]: total})
        if len(timed) < len(new):  # records without a time have no window
            rest = new[new[self.time_col].isna()]
            yield pd.DataFrame({self.row: rest[self.row], self.user: key[0], names[0]: pd.array([None] * len(rest), "Int64"), names[1]: None})

    def _keep(self, at: np.ndarray, amt: np.ndarray, hour: np.ndarray, sums: dict, piece: Callable, timerValues: TimerValues) -> None:
        """Adds a batch to the pieces that later windows may need."""
        newest = max(int(hour[-1]), *sums) if sums else int(hour[-1])
        needed = (lambda h: self._gone(h) > (at[-1] + self.epoch - self.late) * 1000) if self.timers else (lambda h: h > newest - self.hours - 1)
        for h in np.unique(hour).tolist():
            if needed(h):
                times, amounts = (np.concatenate([a, b]) for a, b in zip(piece(h), (at[hour == h], amt[hour == h]), strict=True))
                order = np.argsort(times, kind="stable")
                times, amounts = times[order], amounts[order]
                self._pieces.updateValue((h,), (times.tolist(), amounts.tolist()))
                self._sums.updateValue((h,), (int((~np.isnan(amounts)).sum()), float(np.nansum(amounts))))
                if self.timers:
                    self._handle.registerTimer(max(self._gone(h), timerValues.getCurrentWatermarkInMs() + 1))
        if not self.timers:
            self._drop(sums, newest - self.hours - 1)

    def _drop(self, hours: list[int] | dict, upto: int) -> None:
        for h in [h for h in hours if h <= upto]:
            self._pieces.removeKey((h,))
            self._sums.removeKey((h,))

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        for k in [k[0] for k in self._sums.keys()]:
            if self._gone(k) <= passed:
                self._drop([k], k)
        return iter([])

    def close(self) -> None:
        pass


def throttle_points(at: np.ndarray, delta: np.ndarray, seconds: float, least: float, last_at: float | None, last_total: float, total: float) -> tuple[list[tuple[int, float]], float | None, float, float]:
    """Which points of a running sum are emitted: the first, and those ``seconds`` after the last or ``least`` away from it."""
    out = []
    for k in range(len(at)):
        total += float(delta[k])
        if last_at is None or at[k] - last_at >= seconds or abs(total - last_total) >= least:
            out.append((k, total))
            last_at, last_total = float(at[k]), total
    return out, last_at, last_total, total


class ThrottleState(StatefulProcessor):
    """The last emitted point of a series and its sum so far: three numbers."""

    def __init__(self, seconds: float, least: float) -> None:
        self.seconds, self.least = seconds, least

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._last = handle.getValueState("last", "last_at double, last_total double, total double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        last_at, last_total, total = self._last.get() if self._last.exists() else (None, 0.0, 0.0)
        new = pd.concat(rows).assign(_n=lambda x: x["seq"].str.len()).sort_values(["at", "_n", "seq"], kind="stable").reset_index(drop=True)
        out, last_at, last_total, total = throttle_points(new["at"].to_numpy(), new["delta"].to_numpy(), self.seconds, self.least, last_at, last_total, total)
        self._last.update((last_at, last_total, total))
        kept = new.iloc[[k for k, _ in out]]
        yield pd.DataFrame({"series": key[0], "seq": kept["seq"].to_numpy(), "at": kept["at"].to_numpy(), "total": [t for _, t in out]})

    def close(self) -> None:
        pass
