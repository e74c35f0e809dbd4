from datetime import datetime

import pytest
from builders import lines
from pyspark.sql import functions as F

from tripline.operators.parsing import ParseOptions
from tripline.plans.ingest import Providers, analyze, ingest, run_anomaly_scan, sync_rules
from tripline.rules import load_rules
from tripline.sources.lines import read_lines
from tripline.sources.store import Store
from tripline.streaming.microbatch import alert_feed, batch_name, detect_stream, line_stream

RULES = load_rules()
OPTIONS = ParseOptions(datetime(2024, 11, 1), year=2024)


def ssh(second, ip="198.51.100.61", what="Failed password for invalid user backup"):
    return f"Jun 10 06:11:{second:02d} web-01 sshd[2010]: {what} from {ip} port 54001 ssh2"


BRUTE_FORCE = [ssh(1 + 2 * i) for i in range(6)]


@pytest.fixture
def store(spark, tmp_path):
    made = Store(spark, str(tmp_path / "store"))
    assert sync_rules(made, RULES) == (6, 0)
    return made


def test_ingest_counts(spark, store):
    text = lines(spark, BRUTE_FORCE[0], "sudo: noise", BRUTE_FORCE[1])
    result = ingest(store, text, "auth_log", RULES, batch="1", options=OPTIONS, source_name="up")
    assert (result.received, result.parsed, result.skipped, result.alerts) == (3, 2, 1, 0)
    assert store.read("log_sources").first().source_id == result.source_id
    assert {r.source_id for r in store.read("events").collect()} == {result.source_id}
    with pytest.raises(ValueError):
        ingest(store, text, "other", RULES, batch="2", options=OPTIONS)


def test_rejects_are_kept_with_their_reason(spark, store):
    timeless = BRUTE_FORCE[0].replace("Jun 10", "Feb 30")
    take = lambda batch, *text: ingest(
        store, lines(spark, *text), "auth_log", RULES, batch=batch, options=OPTIONS, source_name="up"
    )
    result = take("1", BRUTE_FORCE[0], timeless, "sudo: noise", "", BRUTE_FORCE[1], timeless)
    assert (result.parsed, result.rejected) == (2, 2)
    row = store.read("rejects").first()
    assert (row.line, row.reason, row.source_type) == (timeless, "unreadable timestamp", "auth_log")
    assert (row.source_id, str(row.event_date)) == (result.source_id, "2024-11-01")
    assert store.read("events").where("ts IS NULL OR event_date <> '2024-06-10'").count() == 0
    # The batch again, with other rejects and with none, replaces them; other batches' stay.
    take("2", timeless)
    take("1", BRUTE_FORCE[0], timeless)
    assert (store.read("events").count(), store.read("rejects").count()) == (1, 2)
    take("1", BRUTE_FORCE[0])
    assert (store.read("events").count(), store.read("rejects").count()) == (1, 1)
    assert store.clear(confirm=True)["rejects"] == 1


def test_analyze_detects_format_and_threat_once(spark, store):
    feed = spark.createDataFrame([("198.51.100.61", 95)], "ip string, abuse_score int")
    job = lambda batch: analyze(
        store, lines(spark, *BRUTE_FORCE), RULES, batch=batch, options=OPTIONS, providers=Providers(reputation=feed)
    )
    result, alerts = job("1")
    (row,) = alerts.collect()
    assert (result.source_type, result.parsed, result.alerts) == ("auth_log", 6, 1)
    assert (row.mitre_technique, row.technique_name, row.source_ip) == ("T1110", "Brute Force", "198.51.100.61")
    assert (row.severity, row.enrichment.abuse_score) == ("critical", 95)
    # The same batch again replaces its own output; new lines while open raise nothing.
    assert job("1")[0].alerts == 1
    assert job("2")[0].alerts == 0
    assert (store.read("events").count(), store.read("alerts").count()) == (12, 1)
    assert store.read("enrichment").count() == 1


def test_analyze_falls_back_to_generic(spark, store):
    result, alerts = analyze(store, lines(spark, "this is not a standard log line"), RULES, batch="1", options=OPTIONS)
    assert (result.source_type, result.parsed, alerts.count()) == ("custom", 1, 0)
    text = [f"2026-06-10T06:11:{1 + 2 * i:02d}Z host sshd: authentication failure for root from 198.51.100.77 port 5" for i in range(6)]
    result, alerts = analyze(store, lines(spark, *text), RULES, batch="2", options=OPTIONS, source_type="custom")
    assert [r.source_ip for r in alerts.collect()] == ["198.51.100.77"]


def test_history_counts_across_batches(spark, store):
    for batch, part in (("1", BRUTE_FORCE[:3]), ("2", BRUTE_FORCE[3:5])):
        result = ingest(store, lines(spark, *part), "auth_log", RULES, batch=batch, options=OPTIONS)
    assert result.alerts == 1


def test_files(spark, store, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "auth.log").write_text("\n".join(BRUTE_FORCE))
    result, alerts = analyze(store, read_lines(spark, str(tmp_path / "in")), RULES, batch="1", options=OPTIONS)
    assert (result.source_type, alerts.count()) == ("auth_log", 1)


def test_clear_keeps_rules(spark, store):
    ingest(store, lines(spark, *BRUTE_FORCE), "auth_log", RULES, batch="1", options=OPTIONS, source_name="up")
    with pytest.raises(ValueError):
        store.clear()
    removed = store.clear(confirm=True)
    assert (removed["events"], removed["alerts"], removed["log_sources"]) == (6, 1, 1)
    assert (store.read("events").count(), store.read("alerts").count(), store.read("rules").count()) == (0, 0, 6)
    assert ingest(store, lines(spark, *BRUTE_FORCE), "auth_log", RULES, batch="1", options=OPTIONS).alerts == 1


def run(writer):
    writer.trigger(availableNow=True).start().awaitTermination()


def test_streamed_batches_equal_one_batch(spark, store, tmp_path):
    inbox, seen = tmp_path / "in", {}
    inbox.mkdir()
    source = line_stream(spark, str(inbox), maxFilesPerTrigger="1")
    writer = lambda: detect_stream(
        source, store, "auth_log", RULES, name="auth", checkpoint=str(tmp_path / "ckpt"), options=lambda: OPTIONS
    )
    for n, part in enumerate((BRUTE_FORCE[:3], BRUTE_FORCE[3:], [ssh(20)])):
        (inbox / f"{n}.log").write_text("\n".join(part))
        run(writer())
        seen[n] = store.read("alerts").count()
    assert seen == {0: 0, 1: 1, 2: 1}
    assert store.read("events").count() == 7

    whole = Store(spark, str(tmp_path / "whole"))
    sync_rules(whole, RULES)
    ingest(whole, lines(spark, *BRUTE_FORCE), "auth_log", RULES, batch="1", options=OPTIONS)
    same = ["alert_id", "title", "score", "severity"]
    assert whole.read("alerts").select(same).collect() == store.read("alerts").select(same).collect()

    delivered = str(tmp_path / "feed")
    feed = alert_feed(spark, store).writeStream.format("parquet").option("path", delivered)
    run(feed.option("checkpointLocation", str(tmp_path / "feed-ckpt")))
    assert spark.read.parquet(delivered).count() == 1


def test_streams_and_checkpoints_never_write_over_each_other(spark, store, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("\n".join(BRUTE_FORCE))
    for name, checkpoint in (("one", "c0"), ("two", "c1"), ("one", "c2"), ("one", "c0")):
        source = line_stream(spark, str(tmp_path / "in"))
        checkpoint = str(tmp_path / checkpoint)
        run(detect_stream(source, store, "auth_log", RULES, name=name, checkpoint=checkpoint, options=lambda: OPTIONS))
    events = store.read("events")
    assert (events.count(), events.select("event_id").distinct().count()) == (18, 18)
    assert sorted(r.name for r in store.read("log_sources").collect()) == ["one", "two"]
    assert {r.source_id for r in events.collect()} == {r.source_id for r in store.read("log_sources").collect()}
    assert store.read("alerts").count() == 1
    with pytest.raises(ValueError, match="name"):
        batch_name(spark, "a/b", 0)


def test_repeated_micro_batch_stores_nothing_twice(spark, store):
    for _ in range(2):
        ingest(store, lines(spark, *BRUTE_FORCE), "auth_log", RULES, batch="s.q.0", options=OPTIONS)
        assert (store.read("events").count(), store.read("alerts").count()) == (6, 1)


def test_empty_batch_reads_no_history(spark, store, monkeypatch):
    ingest(store, lines(spark, *BRUTE_FORCE), "auth_log", RULES, batch="1", options=OPTIONS)
    read = Store.read

    def guarded(self, table, **kwargs):
        assert table != "events"
        return read(self, table, **kwargs)

    monkeypatch.setattr(Store, "read", guarded)
    assert ingest(store, lines(spark, "noise"), "auth_log", RULES, batch="2", options=OPTIONS).alerts == 0


def test_history_lists_only_the_dates_a_window_reaches(spark, store, monkeypatch):
    for day in range(1, 6):
        text = [ssh(1).replace("Jun 10", f"Jun {day}")]
        ingest(store, lines(spark, *text), "auth_log", RULES, batch=f"b{day}", options=OPTIONS)
    paths = store._paths("events", datetime(2024, 6, 4).date())
    assert [p.rsplit("/", 1)[1] for p in sorted(paths)] == ["event_date=2024-06-04", "event_date=2024-06-05"]
    assert store.read("events", since=datetime(2024, 6, 4).date()).count() == 2
    assert store.read_batch("events", "b2").count() == 1


def test_compaction_keeps_rows_and_leaves_one_folder(spark, store):
    for batch in ("1", "2", "3"):
        ingest(store, lines(spark, *BRUTE_FORCE[:2]), "auth_log", RULES, batch=batch, options=OPTIONS)
    before = sorted(r.event_id for r in store.read("events").collect())
    assert store.compact("events", datetime(2024, 6, 10).date()) == 0
    assert store.compact("events", datetime(2024, 6, 11).date()) == 1
    assert sorted(r.event_id for r in store.read("events").collect()) == before
    store.purge("events")
    assert sorted(r.event_id for r in store.read("events").collect()) == before and len(before) == 6
    assert len(store._children(f"{store.root}/events/event_date=2024-06-10")) == 1


def test_rule_table_is_replaced_whole(spark, store):
    assert sync_rules(store, RULES[:1]) == (0, 3)
    assert store.read("rules").count() == 6
    unfinished = f"{store.root}/rules/version-99999999999999999999"
    store.read("rules").limit(0).write.parquet(unfinished)
    store._delete(f"{unfinished}/_SUCCESS")
    assert store.read("rules").count() == 6


def test_enrichment_held_twice_gives_one_alert(spark, store):
    feed = spark.createDataFrame([("198.51.100.61", 20)], "ip string, abuse_score int")
    providers = Providers(reputation=feed)
    ingest(store, lines(spark, BRUTE_FORCE[0]), "auth_log", RULES, batch="1", options=OPTIONS, providers=providers)
    store.write_batch("enrichment", store.read("enrichment").withColumn("abuse_score", F.lit(95)).withColumn(
        "updated_at", F.lit(datetime(2025, 1, 1)).cast("timestamp")), "other")
    _, alerts = analyze(store, lines(spark, *BRUTE_FORCE), RULES, batch="2", options=OPTIONS, providers=providers)
    assert [r.enrichment.abuse_score for r in alerts.collect()] == [95]


def test_anomaly_scan_job(spark, store):
    text = [f"2026-06-10T06:11:{i % 60:02d}Z host app: request from 198.51.100.{i % 9}" for i in range(90)]
    text += [f"2026-06-10T06:11:{i % 60:02d}Z host app: request from 203.0.113.5" for i in range(200)]
    ingest(store, lines(spark, *text), "custom", [], batch="1", options=OPTIONS)
    first = run_anomaly_scan(store, 300, batch="scan1", options=OPTIONS)
    assert ("rate_anomaly", "203.0.113.5") in {(r.rule_key, r.source_ip) for r in first.collect()}
    assert run_anomaly_scan(store, 300, batch="scan2", options=OPTIONS).count() == 0
    empty = Store(spark, f"{store.root}-empty")
    assert run_anomaly_scan(empty, 300, batch="scan", options=OPTIONS).count() == 0


def test_triage_reopens_detection(spark, store):
    ingest(store, lines(spark, *BRUTE_FORCE), "auth_log", RULES, batch="1", options=OPTIONS)
    from tripline.operators.alerts import status_change

    alert = store.read("alerts").first()
    store.write_batch("status_log", status_change(store.read("alerts"), alert.alert_id, "resolved", datetime(2024, 11, 2)), "t1")
    later = ingest(store, lines(spark, ssh(59)), "auth_log", RULES, batch="2", options=OPTIONS)
    assert later.alerts == 1
    assert store.read("alerts").select(F.count_distinct("alert_id")).first()[0] == 2


def test_sources_of_files_cost_one_pass_over_the_lines(spark, store):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(name):
        seen.add(1)
        return name

    rows = [(BRUTE_FORCE[i % 6], f"f{i % 3}", "auth_log") for i in range(12)]
    made = spark.createDataFrame(rows, "line string, name string, source_type string")
    text = made.withColumn("file_name", counted("name")).drop("name")
    ingest(store, text, "mixed", [], batch="1", options=OPTIONS)
    assert store.read("events").count() == 12 and store.read("log_sources").count() == 3
    # Once for the sources, and once to be parsed.
    assert seen.value == 24
