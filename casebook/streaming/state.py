"""Keyed streaming state: adaptive sharding, attempt numbers, stuck timers, silence alarms.

Each is a stateful processor with a value state of a few numbers per key, kept
by the RocksDB state store (see `session.SETTINGS`), with event-time timers
where the rule asks for them.  Batch twins live next to each
operator's batch module.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from casebook import fixed
from casebook.operators.ranking import running_sum
from casebook.streaming.ingest import WATERMARK, event_time

OUT_ROWS = 10_000  # rows a processor hands on at once
ATTEMPTS_KEPT_DAYS = 90
ATTEMPTS_WATERMARK = "7 days"


def _micros(times: pd.Series) -> np.ndarray:
    return times.to_numpy().astype("datetime64[us]").astype(np.int64)


def _time(micros: int) -> pd.Timestamp:
    return pd.Timestamp(micros, unit="us")


class _Keyed(StatefulProcessor):
    """A processor with one value state, of which STATE is the schema, and at most one timer a key."""

    STATE = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.STATE)

    def wake_at(self, due_ms: int | None, timers: TimerValues) -> None:
        """Replace the key's timer (none: drop it); one that is due already fires with the next watermark."""
        for earlier in list(self.handle.listTimers()):
            self.handle.deleteTimer(earlier)
        if due_ms is not None:
            self.handle.registerTimer(max(due_ms, timers.getCurrentWatermarkInMs() + 1))

    def close(self) -> None:
        pass


# --- adaptive sharding -------------------------------------------------------------------
class ShardingFlag(_Keyed):
    """Per city: sticky flag, how often it was switched on, last count and its time."""

    STATE = "needs_sharding boolean, hits int, last_count long, last_at long"
    OUT = "city string, needs_sharding boolean, hit_limit_count int, last_result_count long, last_fetch_at timestamp"

    def __init__(self, threshold: int) -> None:
        self.threshold = threshold

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        sharded, hits, last_count, last_at = self.state.get() if self.state.exists() else (False, 0, 0, None)
        for batch in rows:
            if not sharded and (batch["results"] >= self.threshold).any():
                sharded, hits = True, hits + 1
            times = _micros(batch["fetched_at"])
            newest = int(times.argmax())
            if last_at is None or times[newest] >= last_at:
                last_count, last_at = int(batch["results"].iloc[newest]), int(times[newest])
        self.state.update((sharded, hits, last_count, last_at))
        yield pd.DataFrame({
            "city": [key[0]], "needs_sharding": [sharded], "hit_limit_count": [hits],
            "last_result_count": [last_count], "last_fetch_at": [_time(last_at)],
        })


def sharding_flags(runs: DataFrame, threshold: int = fixed.SHARDING_THRESHOLD) -> DataFrame:
    """Stream of fetch runs (city, fetched_at, results) to the city's current state."""
    return runs.groupBy("city").transformWithStateInPandas(ShardingFlag(threshold), ShardingFlag.OUT, "update", "none")


def sharding_batch(runs: DataFrame, threshold: int = fixed.SHARDING_THRESHOLD) -> DataFrame:
    """Batch twin of the sharding state over all runs so far."""
    reached = F.max((F.col("results") >= threshold).cast("int")) == 1
    return runs.groupBy("city").agg(
        reached.alias("needs_sharding"),
        F.max((F.col("results") >= threshold).cast("int")).alias("hit_limit_count"),
        F.max_by("results", "fetched_at").alias("last_result_count"),
        F.max("fetched_at").alias("last_fetch_at"),
    )


def sharding_history(runs: DataFrame, tie: str, threshold: int = fixed.SHARDING_THRESHOLD) -> DataFrame:
    """Flag as it stood after each run: sticky once a run reached the threshold."""
    reached = (F.col("results") >= threshold).cast("int")
    day = F.date_trunc("day", F.col("fetched_at"))
    hits = running_sum(runs, ["city"], ["fetched_at", tie], day, reached, "_hits")
    return hits.withColumn("needs_sharding", F.col("_hits") > 0).drop("_hits")


# --- attempt numbers -------------------------------------------------------------------------
class AttemptNumbers(_Keyed):
    """Per (source, stage): how many attempts were seen; forgotten when none came for `days` of event time.

    A key's rows of one batch come in any order and in several portions; their
    times and ids (16 bytes a row) are put in order before they are numbered.
    """

    STATE = "attempts long"
    OUT = "id long, source_google_news_id long, stage string, attempt_no long, can_retry boolean"

    def __init__(self, max_attempts: int, days: int) -> None:
        self.max_attempts = max_attempts
        self.kept_ms = days * 86_400_000

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        parts = [(_micros(batch["created_at"]), batch["id"].to_numpy(np.int64)) for batch in rows]
        times, ids = (np.concatenate(column) for column in zip(*parts, strict=True))
        ids = ids[np.lexsort((ids, times))]
        before = self.state.get()[0] if self.state.exists() else 0
        self.state.update((before + len(ids),))
        self.wake_at(int(times.max()) // 1000 + self.kept_ms, timerValues)
        for at in range(0, len(ids), OUT_ROWS):
            part = ids[at : at + OUT_ROWS]
            numbers = before + at + 1 + np.arange(len(part))
            yield pd.DataFrame({
                "id": part, "source_google_news_id": key[0], "stage": key[1], "attempt_no": numbers, "can_retry": numbers < self.max_attempts,
            })

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter(())


def attempt_numbers(
    attempts: DataFrame, max_attempts: int = fixed.RETRY_MAX_ATTEMPTS, days: int = ATTEMPTS_KEPT_DAYS, watermark: str = ATTEMPTS_WATERMARK,
) -> DataFrame:
    """Stream of attempts (id, source_google_news_id, stage, created_at) with their number per
    (source, stage) and whether another one is allowed.

    A batch costs what its own keys cost.  Attempts later than the watermark are not numbered.
    """
    slim = attempts.select("id", "source_google_news_id", "stage", "created_at")
    return event_time(slim, "created_at").withWatermark("created_at", watermark).groupBy(
        "source_google_news_id", "stage").transformWithStateInPandas(
            AttemptNumbers(max_attempts, days), AttemptNumbers.OUT, "append", "eventTime")


# --- stuck timers ---------------------------------------------------------------------------
class StuckTimer(_Keyed):
    """Per row: its transient status and since when; a timer reports it when nothing else came in time."""

    STATE = "status string, since long"
    OUT = "id long, status string, since timestamp, return_to string"

    def __init__(self, minutes: int) -> None:
        self.minutes = minutes

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        status, since = self.state.get() if self.state.exists() else (None, None)
        for batch in rows:
            times = _micros(batch["updated_at"])
            newest = int(times.argmax())
            if since is None or times[newest] >= since:
                status, since = batch["status"].iloc[newest], int(times[newest])
        if status in fixed.STUCK_RETURNS:
            self.state.update((status, since))
            self.wake_at(since // 1000 + self.minutes * 60_000, timerValues)
        else:
            self.state.clear()
            self.wake_at(None, timerValues)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            status, since = self.state.get()
            self.state.clear()
            yield pd.DataFrame({"id": [key[0]], "status": [status], "since": [_time(since)], "return_to": [fixed.STUCK_RETURNS[status]]})


def stuck_alerts(changes: DataFrame, minutes: int = fixed.STUCK_MINUTES, watermark: str = WATERMARK) -> DataFrame:
    """Stream of status changes (id, status, updated_at) to rows that stayed in a
    transient status past the timeout, by an event-time timer."""
    return (
        event_time(changes, "updated_at").withWatermark("updated_at", watermark)
        .groupBy("id").transformWithStateInPandas(StuckTimer(minutes), StuckTimer.OUT, "append", "eventTime")
    )


# --- silence alarms ---------------------------------------------------------------------------
class SilenceAlarm(_Keyed):
    """Per worker: its last sign of life, and whether its silence since then was reported.

    A timer reports a silence while it lasts; a silence that began and ended
    within the rows of one batch is reported from their times.  Rows older than
    the last sign change nothing.
    """

    STATE = "last_at long, reported boolean"
    OUT = "worker long, silent_from timestamp"

    def __init__(self, minutes: int) -> None:
        self.span = minutes * 60_000_000

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        last, reported = self.state.get() if self.state.exists() else (None, False)
        times = np.unique(np.concatenate([_micros(batch["seen_at"]) for batch in rows]))
        times = times if last is None else times[times > last]
        if not len(times):
            return
        line = times if last is None else np.concatenate(([last], times))
        silent = line[:-1][np.diff(line) > self.span]
        if reported and len(silent) and silent[0] == last:
            silent = silent[1:]
        self.state.update((int(line[-1]), False))
        self.wake_at((int(line[-1]) + self.span) // 1000, timerValues)
        if len(silent):
            yield pd.DataFrame({"worker": key[0], "silent_from": [_time(int(t)) for t in silent]})

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            last, reported = self.state.get()
            if not reported:
                self.state.update((last, True))
                yield pd.DataFrame({"worker": [key[0]], "silent_from": [_time(last)]})


def silence_alarms(signs: DataFrame, minutes: int, watermark: str = WATERMARK) -> DataFrame:
    """Stream of signs of life (worker, seen_at) to one row per silence of more than `minutes`."""
    return (
        event_time(signs, "seen_at").withWatermark("seen_at", watermark)
        .groupBy("worker").transformWithStateInPandas(SilenceAlarm(minutes), SilenceAlarm.OUT, "append", "eventTime")
    )
