"""Live operators that work in event time, whatever order rows and files come in: state with timers.

A row waits in state until the watermark has passed its second. Then everything before it is known, so what is written is
exact and final: each row once, and no stored table is read. Rows behind the watermark are dropped, as by any stateful
operator.

State is kept in RocksDB on the executors, by user or series. A user's state holds their rows between the watermark and the
newest one, ten amounts, and the counted seconds of an hour; a timer takes out what is due and leaves the rest, a series
holds one record.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from spendlens import domain
from spendlens.operators import fraud, timeline
from spendlens.session import use_rocksdb
from spendlens.streaming.fraud_state import FEATURES, featured

ROWS_PER_PIECE = 10_000


def _micros(times: pd.Series) -> pd.Series:
    return times.astype("datetime64[us]").astype("int64")


# --- fraud features, each row once ----------------------------------------------------------------------

#: All columns of a transaction but the time.
OTHERS = [f.name for f in domain.TRANSACTION_SCHEMA.fields if f.name != "timestamp"]


def _joined(blocks: list[tuple[np.ndarray, list]]) -> tuple[np.ndarray, list]:
    """Times in microseconds, and an array of each other column, of several blocks of rows."""
    return np.concatenate([b[0] for b in blocks]), [np.concatenate(c) for c in zip(*[b[1] for b in blocks])]


def _taken(block: tuple[np.ndarray, list], which: np.ndarray) -> tuple[np.ndarray, list]:
    return block[0][which], [c[which] for c in block[1]]


class OrderedFeatures(StatefulProcessor):
    """Features of a user's rows in time order, when the watermark has passed them."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # Blocks of rows as one value each: single rows would be converted column by column on their way in and out.
        self.waiting = handle.getListState("waiting", "rows binary")
        self.past = handle.getValueState("past", "amounts binary")
        self.timer = handle.getValueState("timer", "at long")

    def wake(self, second: int) -> None:
        """Sets the timer of the user to the end of a second, unless it is set to an earlier one."""
        at = 1000 * (second + 1)
        known = self.timer.get() if self.timer.exists() else None
        if known is None or at < known[0]:
            if known is not None:
                self.handle.deleteTimer(known[0])
            self.handle.registerTimer(at)
            self.timer.update((at,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for piece in rows:
            micros = _micros(piece["timestamp"]).to_numpy()
            columns = [c if c.dtype == object else c.astype(object).where(c.notna(), None) for c in (piece[n] for n in OTHERS)]
            self.waiting.appendValue((pickle.dumps((micros, [c.to_numpy() for c in columns])),))
            first = int(micros.min()) if first is None else min(first, int(micros.min()))
        if first is not None:
            self.wake(first // 1_000_000)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.timer.clear()
        watermark = 1000 * timerValues.getCurrentWatermarkInMs()
        waiting = _joined([pickle.loads(value[0]) for value in self.waiting.get()])
        passed = (waiting[0] // 1_000_000 + 1) * 1_000_000 <= watermark
        self.waiting.clear()
        if not passed.all():
            later = _taken(waiting, ~passed)
            for start in range(0, len(later[0]), ROWS_PER_PIECE):
                self.waiting.appendValue((pickle.dumps(_taken(later, slice(start, start + ROWS_PER_PIECE))),))
            self.wake(int(later[0].min()) // 1_000_000)
        if not passed.any():
            return
        micros, columns = _taken(waiting, passed)
        ids, times = columns[OTHERS.index("transaction_id")].tolist(), micros.tolist()
        order = np.array(sorted(range(len(times)), key=lambda i: (times[i], ids[i] is None, ids[i] or "")))
        micros, columns = _taken((micros, columns), order)
        rows = pd.DataFrame(dict(zip(OTHERS, columns)), copy=False)
        rows["amount"] = rows["amount"].astype(float)
        rows["timestamp"] = micros.view("datetime64[us]")
        past = pickle.loads(self.past.get()[0]) if self.past.exists() else ([], [], [])
        out, *past = featured(rows, *past)
        self.past.update((pickle.dumps(past),))
        out = out[[f.name for f in FEATURES.fields]]
        for start in range(0, len(out), ROWS_PER_PIECE):
            yield out.iloc[start:start + ROWS_PER_PIECE]

    def close(self) -> None:
        pass


def ordered_features(tx: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Fraud features of a transaction stream (append mode): those of ``timeline.recent_history`` over all rows in time.

    Rows without a user or a time have no history and pass at once.
    """
    use_rocksdb(tx.sparkSession)
    rows = tx.select(*[f.name for f in domain.TRANSACTION_SCHEMA.fields])
    recent = timeline.placed(rows).withWatermark("timestamp", watermark).groupBy("user_id").transformWithStateInPandas(
        statefulProcessor=OrderedFeatures(), outputStructType=FEATURES, outputMode="Append", timeMode="EventTime")
    history = FEATURES.fields[len(domain.TRANSACTION_SCHEMA.fields):]
    others = rows.filter("user_id IS NULL OR timestamp IS NULL").withColumns(
        {f.name: F.lit(None).cast(f.dataType) for f in history})
    return recent.unionByName(others).withColumns(fraud.row_features())


# --- rules that must hold for a while ---------------------------------------------------------------------

CHANGES = "state string, at timestamp, pending_since timestamp, firing_since timestamp, last_true timestamp, peak double"
PENDING, FIRING, RESOLVED = "pending", "firing", "resolved"


class HeldRule(StatefulProcessor):
    """A rule's state per series: inactive, pending since its condition became true, firing once it has held long enough.

    Every change is a row. An evaluation that is false, or that does not come before the watermark passes the next step,
    ends an episode: a firing one is resolved, a pending one is forgotten.
    """

    def __init__(self, keys: Sequence[str], hold_seconds: int, step_seconds: int):
        self.keys, self.hold, self.step = list(keys), hold_seconds, step_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.episode = handle.getValueState("episode", "since long, last long, peak double")

    def change(self, key, state: str, at: int, episode: tuple) -> tuple:
        since, last, peak = episode
        firing = since + self.hold if state != PENDING else None
        return (*key, state, at, since, firing, last, peak)

    def advanced(self, key, episode: tuple | None, evaluations) -> tuple[tuple | None, list]:
        """The episode after evaluations (second, condition, value) in time order, and the changes on the way."""
        out = []
        for at, true, value in evaluations:
            if episode and (not true or at > episode[1] + self.step):
                out += self.ended(key, episode)
                episode = None
            if not true:
                continue
            if episode is None:
                episode = (at, at, value)
                out.append(self.change(key, PENDING, at, episode))
            else:
                was, episode = episode, (episode[0], at, max(episode[2], value))
            if at - episode[0] >= self.hold and (at == episode[0] or was[1] - was[0] < self.hold):
                out.append(self.change(key, FIRING, at, episode))
        return episode, out

    def ended(self, key, episode: tuple) -> list:
        """A firing episode is resolved at the first step that is not true any more."""
        held = episode[1] - episode[0] >= self.hold
        return [self.change(key, RESOLVED, episode[1] + self.step, episode)] if held else []

    def frame(self, rows: list) -> Iterator[pd.DataFrame]:
        if rows:
            out = pd.DataFrame(rows, columns=[*self.keys, "state", "at", "pending_since", "firing_since", "last_true", "peak"])
            for c in ("at", "pending_since", "firing_since", "last_true"):
                out[c] = pd.to_datetime(out[c], unit="s")
            yield out

    def known(self) -> tuple | None:
        return tuple(self.episode.get()) if self.episode.exists() else None

    def keep(self, before: tuple | None, after: tuple | None) -> None:
        """Stores the episode; its timer is the end of the step in which its next evaluation is due."""
        if before == after:
            return
        if before:
            self.handle.deleteTimer(self.due(before))
        if after:
            self.episode.update(after)
            self.handle.registerTimer(self.due(after))
        else:
            self.episode.clear()

    def due(self, episode: tuple) -> int:
        return 1000 * (episode[1] + self.step) + 1

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        found = pd.concat(list(rows), ignore_index=True).sort_values("evaluated_at")
        seconds = (-(-_micros(found["evaluated_at"]) // 1_000_000)).tolist()  # a window's time is a microsecond before its end
        before = self.known()
        after, out = self.advanced(key, before, zip(seconds, found["condition"].tolist(), found["value"].tolist()))
        self.keep(before, after)
        yield from self.frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        episode = self.known()
        if episode and self.due(episode) <= expiredTimerInfo.getExpiryTimeInMs():
            self.episode.clear()
            yield from self.frame(self.ended(key, episode))

    def close(self) -> None:
        pass


def live_hold(evaluations: DataFrame, condition: Column, hold_minutes: int, value: Column, keys: Sequence[str] = (),
              step_minutes: int = 1) -> DataFrame:
    """Changes of a rule's state on a stream of evaluations with a watermark on ``evaluated_at`` (append mode).

    The rows with state ``resolved`` are the episodes of ``metrics.held``; ``pending`` and ``firing`` come as soon as the
    evaluation does.
    """
    use_rocksdb(evaluations.sparkSession)
    names = list(keys) or ["_series"]
    rows = evaluations if keys else evaluations.withColumn("_series", F.lit("all"))
    rows = rows.select(*names, "evaluated_at", F.coalesce(condition, F.lit(False)).alias("condition"), value.cast("double").alias("value"))
    fields = ", ".join(f"`{n}` {rows.schema[n].dataType.simpleString()}" for n in names)
    out = rows.groupBy(*names).transformWithStateInPandas(
        statefulProcessor=HeldRule(names, 60 * hold_minutes, 60 * step_minutes), outputStructType=f"{fields}, {CHANGES}",
        outputMode="Append", timeMode="EventTime")
    return out if keys else out.drop("_series")


def live_sliding(events: DataFrame, measures: dict[str, Column], minutes: int, keys: Sequence[str] = (), ts: str = "timestamp",
                 watermark: str = "5 minutes") -> DataFrame:
    """``metrics.sliding_sums`` on a stream: a row for every minute that has an event in its window, once it is complete."""
    window = F.window(ts, f"{minutes} minutes", "1 minute")
    sums = events.withWatermark(ts, watermark).groupBy(window.alias("window"), *keys).agg(*[c.alias(n) for n, c in measures.items()])
    return sums.select(*keys, F.window_time("window").alias("evaluated_at"), *measures)
