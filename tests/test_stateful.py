from datetime import timedelta

import pandas as pd
import pytest
from builders import BASE, event, events
from pyspark.sql import Row
from pyspark.sql import functions as F

from tripline.rules import load_rules
from tripline.schemas import EVENT, RAW
from tripline.session import STATE_STORE
from tripline.streaming import stateful
from tripline.streaming.stateful import stateful_threshold

RULES = {rule.key: rule for rule in load_rules()}
SLIM = ["event_id", "ts", "source_ip", "protocol", "raw"]


def failed(*seconds):
    return [event(s, "1.1.1.1", "ssh", outcome="failed") for s in seconds]


@pytest.mark.parametrize(
    ("rule", "batches", "observed"),
    [
        ("brute_force_ssh", [failed(0, 1, 2), failed(3, 4), failed(200)], [5]),
        ("brute_force_ssh", [failed(100, 101, 102, 103), failed(20), failed(50)], [5]),
        ("brute_force_ssh", [failed(0, 1, 2, 3), [event(61, "1.1.1.1", "http")], failed(61)], []),
        ("brute_force_ssh", [failed(0, 0, 0, 0, 0), [event(60, "1.1.1.1", "http")]], [5, 5]),
        (
            "port_scan",
            [[event(i, "2.2.2.2", dest_port=i % 6) for i in range(12)], [event(12 + i, "2.2.2.2", dest_port=5 + i) for i in range(6)]],
            [11],
        ),
    ],
)
def test_window_in_state(spark, tmp_path, rule, batches, observed):
    source, found = str(tmp_path / "in"), str(tmp_path / "found")
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(spark.createDataFrame([], EVENT).select(SLIM).schema).parquet(source)
    result = stateful_threshold(stream, RULES[rule])
    seen = []
    for n, batch in enumerate(batches):
        events(spark, batch).select(SLIM).coalesce(1).write.mode("append").parquet(source)
        job = result.writeStream.format("parquet").option("path", found).option("checkpointLocation", str(tmp_path / "state"))
        job.trigger(availableNow=True).start().awaitTermination()
        rows = spark.read.schema(result.schema).parquet(found).orderBy("window_end").collect()
        seen += [r.observed for r in rows[len(seen) :]]
    assert seen == observed
    ends = {r.window_end for r in spark.read.schema(result.schema).parquet(found).collect()}
    assert all(end >= BASE for end in ends)


def test_hot_key_with_times_of_its_own(spark, tmp_path):
    """A third of all rows on one key, no two at the same time: counted rightly, and summed in bounded pieces."""
    rows = spark.range(30_000).select(
        F.col("id").cast("string").alias("event_id"),
        F.timestamp_micros(F.lit(1_704_067_200_000_000) + F.col("id") * 3_000).alias("ts"),
        F.when(F.col("id") % 3 == 0, "9.9.9.9").otherwise(F.concat(F.lit("1.0."), (F.col("id") % 200).cast("string"))).alias("source_ip"),
        F.lit("ssh").alias("protocol"),
        F.struct(*[F.lit("failed" if f.name == "outcome" else None).cast(f.dataType).alias(f.name) for f in RAW.fields]).alias("raw"),
    )
    source, found = str(tmp_path / "in"), str(tmp_path / "found")
    rows.write.parquet(source)
    result = stateful_threshold(spark.readStream.schema(rows.schema).parquet(source), RULES["brute_force_ssh"])
    job = result.writeStream.format("parquet").option("path", found).option("checkpointLocation", str(tmp_path / "state"))
    job.trigger(availableNow=True).start().awaitTermination()
    hot = spark.read.schema(result.schema).parquet(found).where("group_key = '9.9.9.9'").collect()
    # Sixty seconds hold 20,001 events, of which every third is the key's.
    assert [r.observed for r in hot] == [6_667]


def test_summing_holds_no_more_than_it_may(monkeypatch):
    monkeypatch.setattr(stateful, "HELD_ROWS", 100)
    batches = [pd.DataFrame({"group_key": "k", "ts_us": range(n, n + 50), "value": None, "n": 1}) for n in range(0, 1_000, 50)]
    pieces = list(stateful._summing(10_000, False)(iter(batches)))
    assert max(map(len, pieces)) <= 150 and sum(p["n"].sum() for p in pieces) == 1_000
    assert [len(p) for p in stateful._summing(10, False)(iter(batches))] == [11]


def test_watermark_drops_late_events_and_closes_keys(spark, tmp_path):
    source, found = str(tmp_path / "in"), str(tmp_path / "found")
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(spark.createDataFrame([], EVENT).select(SLIM).schema).parquet(source)
    result = stateful_threshold(stream, RULES["brute_force_ssh"], late_by=timedelta(seconds=100))
    nobody = [event(5_000, None, "ssh", outcome="failed")]
    # The fifth of the first key comes in time; that of the second key comes when the watermark has passed it.
    batches = [
        failed(0, 10, 20, 30) + [event(s, "2.2.2.2", "ssh", outcome="failed") for s in (0, 1, 2, 3)],
        failed(25) + [event(150, "3.3.3.3", "ssh", outcome="failed")],
        [event(4, "2.2.2.2", "ssh", outcome="failed")],
        nobody,
    ]
    for batch in batches:
        events(spark, batch).select(SLIM).coalesce(1).write.mode("append").parquet(source)
        job = result.writeStream.format("parquet").option("path", found).option("checkpointLocation", str(tmp_path / "state"))
        run = job.trigger(availableNow=True).start()
        run.awaitTermination()
    assert [(r.group_key, r.observed) for r in spark.read.schema(result.schema).parquet(found).collect()] == [("1.1.1.1", 5)]
    assert sum(s.numRowsTotal for s in run.lastProgress.stateOperators) == 0


def test_stateful_settings_are_checked(spark):
    stream = spark.createDataFrame([], EVENT).select(SLIM)
    with pytest.raises(ValueError, match="window"):
        stateful_threshold(stream, RULES["brute_force_ssh"], late_by=timedelta(seconds=1))
    with pytest.raises(ValueError, match="both"):
        stateful_threshold(stream, RULES["brute_force_ssh"], timedelta(hours=1), timedelta(hours=1))
    setting, store = STATE_STORE
    beside = spark.newSession()
    beside.conf.set(setting, "other")
    with pytest.raises(ValueError, match=store):
        stateful_threshold(beside.createDataFrame([], stream.schema), RULES["brute_force_ssh"])


class _Kept:
    """State of one key in memory, counting the calls that go to it."""

    def __init__(self):
        self.calls, self.cell, self.entries = 0, None, {}

    def _called(self, result=None):
        self.calls += 1
        return result

    def getValueState(self, *_):
        return self

    getMapState = getValueState

    def get(self):
        return self._called(self.cell)

    def update(self, value):
        self.cell = self._called(value)

    def getValue(self, key):
        return self._called(self.entries.get(key))

    def updateValue(self, key, value):
        self.entries[key] = self._called(value)

    def iterator(self):
        return iter(list(self._called(self.entries).items()))

    def removeKey(self, key):
        self._called(self.entries.pop(key, None))


def _observed(kept, distinct, batches, width=100):
    window = stateful._Window(width, 1, distinct, "none", None)
    window.init(kept)
    found = []
    for batch in batches:
        rows = iter([Row(group_key="k", ts_us=at, value=value, n=n) for at, value, n in batch])
        found += [(r.window_end_us, r.observed) for r in window.handleInputRows(("k",), rows, None)]
    return found


def test_small_window_is_read_once_and_written_once():
    for distinct in (False, True):
        kept = _Kept()
        batches = [[(at, str(at % 30), 1) for at in range(60)], [(at, str(at % 40), 1) for at in range(60, 150)]]
        assert _observed(kept, distinct, batches) == [(59, 30 if distinct else 60), (149, 40 if distinct else 101)]
        assert kept.calls == 4


def test_window_in_one_piece_equals_window_in_a_map(monkeypatch):
    # Late events, events that do not count, equal times, and windows that pass over all that was there.
    steps = [(0, 90), (20, 60), (95, 130), (10, 40), (301, 302), (250, 420)]
    batches = [[(at, str(at * 7 % 23), 2 * (at % 5 > 0)) for at in range(*step) for _ in range(1 + at % 2)] for step in steps]
    for distinct in (False, True):
        pieces = {}
        for small, held in ((10_000, 200_000), (25, 200_000), (0, 200_000), (10, 7)):
            monkeypatch.setattr(stateful, "SMALL", small)
            monkeypatch.setattr(stateful, "HELD_ROWS", held)
            pieces[small, held] = _observed(_Kept(), distinct, batches)
        assert len(pieces[0, 200_000]) == len(steps)
        assert all(piece == pieces[0, 200_000] for piece in pieces.values())


def test_a_task_hands_on_its_sums_early():
    batches = [pd.DataFrame({"group_key": [str(i % 9_000) for i in range(n, n + 10_000)], "ts_us": range(n, n + 10_000), "value": None, "n": 1}) for n in range(0, 250_000, 10_000)]
    pieces = list(stateful._summing(10**9, False)(iter(batches)))
    assert max(map(len, pieces)) <= 70_000 and sum(p["n"].sum() for p in pieces) == 250_000
