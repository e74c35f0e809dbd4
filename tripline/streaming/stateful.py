"""A counting rule with its window kept as stream state.

``microbatch`` evaluates rules over stored history and is the usual choice.
Here nothing is stored but the last window of each key, and findings come out
as soon as a micro-batch has been read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tripline.functions.scoring import threshold_score
from tripline.operators.selection import group_value, resolve, selection
from tripline.rules.model import ThresholdRule
from tripline.session import STATE_STORE

_ROWS = "group_key string, ts_us long, value string, n long"
_OUT = "group_key string, window_end_us long, observed long"
#: A window's times are kept in so many slices; a late or old time rewrites one of them.
SLICES = 64
#: A window of at most so many values or times is kept in one piece.
SMALL = 512
#: A task holds about so many summed rows before it hands them on.
HELD_ROWS = 50_000


def stateful_threshold(
    events: DataFrame,
    rule: ThresholdRule,
    forget_after: timedelta | None = None,
    late_by: timedelta | None = None,
) -> DataFrame:
    """Keys whose latest window reaches the rule's threshold, per micro-batch.

    A key's state is its newest time and a map: for counts, slices of the window with the number
    of events at each time; for distinct counts, the newest time of each value.  Events that fell
    out of the window are dropped, and a late event counts only if it falls inside.

    Before rows are dealt by key, each task sums up all it reads (``HELD_ROWS`` summed rows at a
    time) and leaves out what the key's newest event there puts outside its window.  The task of
    a hot key holds as much at a time, and otherwise one slice or value of the state.

    With ``late_by``, which must be the rule's window or longer, the stream has a watermark:
    events more than ``late_by`` older than the newest of earlier micro-batches are ignored, and
    a key's state goes when no event that still counts could meet it.  Events without a key move
    the watermark, too.  With ``forget_after``, the state of a key that is not seen for so long
    by the clock is dropped; such a stream has no end, so not with an ``availableNow`` trigger.

    The stream's session needs the state store that ``build_session`` sets.
    """
    if forget_after is not None and late_by is not None:
        raise ValueError("state ends by the clock or by the watermark, not by both")
    if late_by is not None and late_by < timedelta(seconds=rule.window_seconds):
        raise ValueError("late_by must not be shorter than the rule's window")
    setting, store = STATE_STORE
    if events.sparkSession.conf.get(setting, None) != store:
        raise ValueError(f"set {setting} to {store}")
    key, _ = resolve(events.schema, rule.group_by)
    value = F.lit(None)
    if rule.distinct_field is not None:
        value = group_value(*resolve(events.schema, rule.distinct_field))
    width, distinct = rule.window_seconds * 1_000_000, rule.distinct_field is not None
    counted = key.isNotNull() & selection(events.schema, rule.selection)
    if distinct:
        counted &= value.isNotNull()
    rows = (events if late_by is not None else events.where(key.isNotNull())).select(
        key.cast("string").alias("group_key"),
        F.unix_micros("ts").alias("ts_us"),
        (value.cast("string") if distinct else F.lit(None).cast("string")).alias("value"),
        F.coalesce(counted, F.lit(False)).cast("long").alias("n"),
    )
    sums = rows.where(F.col("ts_us").isNotNull()).mapInPandas(_summing(width, distinct), _ROWS)
    mode = "none" if forget_after is None else "processingTime"
    if late_by is not None:
        delay = f"{late_by // timedelta(milliseconds=1)} milliseconds"
        sums, mode = sums.withColumn("ts", F.timestamp_micros("ts_us")).withWatermark("ts", delay), "eventTime"
    keeper = _Window(width, rule.threshold, distinct, mode, forget_after and forget_after // timedelta(milliseconds=1))
    reached = sums.groupBy("group_key").transformWithState(keeper, _OUT, "Append", mode)
    return reached.select(
        F.lit(rule.key).alias("rule_key"),
        "group_key",
        F.timestamp_micros("window_end_us").alias("window_end"),
        "observed",
        threshold_score(F.col("observed"), rule.threshold).alias("score"),
    )


def _summing(width: int, distinct: bool) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def shorten(rows: pd.DataFrame) -> pd.DataFrame:
        newest = rows.groupby("group_key", dropna=False)["ts_us"].transform("max")
        # The newest event of a key always goes on: it moves the window even if it does not count.
        ends = rows[(rows["ts_us"] == newest) & (rows["n"] == 0)].drop_duplicates("group_key")
        inside = rows[(rows["n"] > 0) & (rows["ts_us"] >= newest - width)]
        if distinct:
            inside = inside.groupby(["group_key", "value"], as_index=False)["ts_us"].max().assign(n=1)
        else:
            inside = inside.groupby(["group_key", "ts_us"], as_index=False)["n"].sum().assign(value=None)
        columns = ["group_key", "ts_us", "value", "n"]
        return pd.concat([inside[columns], ends[columns].assign(value=None)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            held.append(shorten(batch))
            if sum(map(len, held)) > HELD_ROWS:
                held = [shorten(pd.concat(held))]
                if len(held[0]) > HELD_ROWS // 2:
                    yield held.pop()
        if held:
            yield shorten(pd.concat(held))

    return run


class _Window(StatefulProcessor):
    """The last window of one key, in its head while it is small, else in a map.

    Every call to the state store costs a task far more than the few rows that most keys have, so
    a small window takes one to read it and one to write it.
    """

    def __init__(self, width: int, threshold: int, distinct: bool, mode: str, forget_ms: int | None):
        self.width, self.threshold, self.distinct, self.mode, self.forget_ms = width, threshold, distinct, mode, forget_ms
        self.step = max(1, width // SLICES)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # Names are values or times; numbers the newest time of each, or the events at each.
        names = "array<string>" if self.distinct else "array<long>"
        self.head = handle.getValueState("head", f"end_us long, timer_ms long, large boolean, names {names}, numbers array<long>")
        if self.distinct:
            self.map = handle.getMapState("values", "value string", "seen_us long")
        else:
            self.map = handle.getMapState("slices", "slice long", "times array<long>, counts array<long>, total long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        if key[0] is None:
            return
        end, timer, large, names, numbers = self.head.get() or (None, None, False, (), ())
        oldest = timerValues.getCurrentWatermarkInMs() * 1000 if self.mode == "eventTime" else None
        held: dict = dict(zip(names, numbers))
        seen = False
        for row in rows:
            at = row.ts_us
            if oldest is not None and at < oldest:
                continue
            seen = True
            end = at if end is None or at > end else end
            if row.n > 0 and at >= end - self.width:
                self._hold(held, at, row.value, row.n)
                if len(held) > HELD_ROWS:
                    self._add(held)
                    held, large = {}, True
        if not seen:
            return
        start = end - self.width
        held = {name: number for name, number in held.items() if (number if self.distinct else name) >= start}
        if large or len(held) > SMALL:
            self._add(held)
            observed, held, large = self._observed(start), {}, True
        else:
            observed = len(held) if self.distinct else sum(held.values())
        timer = self._set_timer(end, timer, timerValues)
        self.head.update((end, timer, large, list(held), list(held.values())))
        if observed >= self.threshold:
            yield Row(group_key=key[0], window_end_us=end, observed=observed)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        head = self.head.get()
        if head is None or head[2]:
            self.map.clear()
        self.head.clear()
        return iter(())

    def close(self) -> None:
        pass

    def _hold(self, held: dict, at: int, value: str, n: int) -> None:
        if not self.distinct:
            held[at] = held.get(at, 0) + n
        elif value not in held or held[value] < at:
            held[value] = at

    def _set_timer(self, end: int, timer: int | None, now) -> int | None:
        """The time at which the key's state goes, in place of the one that was set before."""
        if self.mode == "none":
            return None
        if self.mode == "eventTime":
            # An event that still counts, at the watermark or later, reaches back no further than the window.
            due = (end + self.width) // 1000 + 1
        else:
            due = now.getCurrentProcessingTimeInMs() + self.forget_ms
        if due != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
        return due

    def _add(self, held: dict) -> None:
        if self.distinct:
            for value, seen in held.items():
                known = self.map.getValue((value,))
                if known is None or known[0] < seen:
                    self.map.updateValue((value,), (seen,))
            return
        slices: dict[int, list] = {}
        for at, n in held.items():
            slices.setdefault(at // self.step, []).append((at, n))
        for number, pairs in slices.items():
            times, counts = np.array(pairs, np.int64).T
            old = self.map.getValue((number,))
            if old is not None:
                times, counts = np.concatenate([old[0], times]), np.concatenate([old[1], counts])
            self._put((number,), times, counts)

    def _put(self, at: tuple, times: np.ndarray, counts: np.ndarray) -> int:
        each, place = np.unique(times.astype(np.int64), return_inverse=True)
        sums = np.zeros(len(each), np.int64)
        np.add.at(sums, place, counts.astype(np.int64))
        self.map.updateValue(at, (each.tolist(), sums.tolist(), int(sums.sum())))
        return int(sums.sum())

    def _observed(self, start: int) -> int:
        """What the window from ``start`` holds; what is older goes."""
        if self.distinct:
            gone, observed = [], 0
            for value, seen in self.map.iterator():
                if seen[0] < start:
                    gone.append(value)
                else:
                    observed += 1
            for value in gone:
                self.map.removeKey(tuple(value))
            return observed
        observed, first = 0, start // self.step
        totals = [(tuple(at), row[2]) for at, row in self.map.iterator()]
        for at, total in totals:
            if at[0] < first:
                self.map.removeKey(at)
            elif at[0] == first:
                times, counts = (np.array(a, np.int64) for a in self.map.getValue(at)[:2])
                if (times >= start).any():
                    observed += self._put(at, times[times >= start], counts[times >= start])
                else:
                    self.map.removeKey(at)
            else:
                observed += total
        return observed
