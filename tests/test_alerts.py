from datetime import datetime, timedelta

import pytest
from builders import BASE, burst, enrichment, event, events
from pyspark.sql import functions as F

from tripline.functions.attack import tactic, technique_name, technique_url
from tripline.functions.scoring import escalated_severity, risk_score
from tripline.functions.text import is_ipv4, url_decode
from tripline.operators import reports
from tripline.operators.alerts import alert_view, findings_to_alerts, status_change, with_current_status
from tripline.operators.enrich import build_enrichment, locate, new_addresses
from tripline.plans.detection import detect
from tripline.rules import load_rules
from tripline.schemas import ALERT, ENRICHMENT, STATUS_CHANGE
from tripline.sources.registry import new_sources
from tripline.sources.rule_table import change_counts, rule_rows, upsert_rules

RULES = load_rules()


@pytest.mark.parametrize(
    ("severity", "score", "abuse", "expected"),
    [
        ("medium", 0.5, None, ("medium", 55.0)),
        ("high", 1.0, 90, ("critical", 100.0)),
        ("medium", 0.0, 20, ("medium", 56.0)),
        ("critical", 1.0, 100, ("critical", 100.0)),
        ("info", 0.0, 80, ("low", 34.0)),
        ("low", 0.33, 79, ("low", 57.0)),
    ],
)
def test_scoring(spark, severity, score, abuse, expected):
    s, d, a = F.lit(severity), F.lit(score), F.lit(abuse).cast("int")
    assert tuple(spark.range(1).select(escalated_severity(s, a), risk_score(s, d, a)).first()) == expected


@pytest.mark.parametrize(
    ("technique", "name", "where", "url"),
    [
        ("T1110", "Brute Force", "Credential Access", "T1110/"),
        ("T1110.001", "Brute Force: Password Guessing", "Credential Access", "T1110/001/"),
        ("T1110.999", "Brute Force", "Credential Access", "T1110/999/"),
        ("T9999", None, None, "T9999/"),
    ],
)
def test_techniques(spark, technique, name, where, url):
    t = F.lit(technique)
    row = spark.range(1).select(technique_name(t), tactic(t), technique_url(t)).first()
    assert tuple(row) == (name, where, f"https://attack.mitre.org/techniques/{url}")


@pytest.mark.parametrize(
    ("text", "expected"),
    [("a%20b+c", "a b+c"), ("100%", "100%"), ("%zz%41", "%zzA"), ("%c3%a9", "é"), ("%ff", "�"), ("%2520", "%20"), ("", "")],
)
def test_url_decoding(spark, text, expected):
    assert spark.createDataFrame([(text,)], "t string").select(url_decode(F.col("t"))).first()[0] == expected


@pytest.mark.parametrize(
    ("text", "expected"),
    [("1.2.3.4", True), ("001.2.3.4", True), ("256.1.1.1", False), ("1.2.3", False), ("1.2.3.4.5", False), ("1..2.3", False), ("0.0.0.0", True), ("a.1.1.1", False)],
)
def test_ipv4(spark, text, expected):
    assert spark.createDataFrame([(text,)], "t string").select(is_ipv4(F.col("t"))).first()[0] is expected


def alerts(spark, *specs):
    rows = []
    for n, spec in enumerate(specs):
        base = {
            "alert_id": f"a{n}",
            "title": "t",
            "severity": "high",
            "score": 80.0,
            "status": "open",
            "created_at": BASE + timedelta(minutes=n),
            "updated_at": BASE + timedelta(minutes=n),
        }
        rows.append([{**base, **spec}.get(name) for name in ALERT.fieldNames()])
    return spark.createDataFrame(rows, ALERT)


def make(spark, data, known=None, enriched=None):
    rules = rule_rows(spark, RULES)
    return findings_to_alerts(detect(data, RULES), rules, enriched, known, created_at=BASE)


def test_alert_is_linked_scored_and_raised_once(spark):
    data = events(spark, burst(6, "203.0.113.5", "ssh", outcome="failed"))
    first = make(spark, data, enriched=enrichment(spark, **{"203_0_113_5": 90}))
    (row,) = first.collect()
    assert (row.severity, row.score, row.status, row.rule_key) == ("critical", 100.0, "open", "brute_force_ssh")
    assert row.rule_id is not None
    assert make(spark, data, known=first).count() == 0


def test_closed_window_alerts_come_back_but_event_alerts_do_not(spark):
    data = events(
        spark, [*burst(6, "1.1.1.1", "ssh", outcome="failed"), event(9, "2.2.2.2", "http", id=77, path="/?a=union+select union%20select")]
    )
    closed = make(spark, data).withColumn("status", F.lit("resolved"))
    assert {r.rule_key for r in make(spark, data).collect()} == {"brute_force_ssh", "sqli_probe"}
    assert {r.rule_key for r in make(spark, data, known=closed).collect()} == {"brute_force_ssh"}


def test_suppression_is_per_rule_and_key(spark):
    data = events(spark, [e for ip in ("1.1.1.1", "2.2.2.2") for e in burst(6, ip, "ssh", outcome="failed")])
    known = alerts(
        spark,
        {"rule_key": "brute_force_ssh", "group_key": "1.1.1.1", "source_ip": "1.1.1.1"},
        {"rule_key": "http_dos", "group_key": "2.2.2.2", "source_ip": "2.2.2.2"},
    )
    assert [r.group_key for r in make(spark, data, known=known).collect()] == ["2.2.2.2"]


def test_ids_do_not_depend_on_when_detection_ran(spark):
    data = events(spark, burst(6, "1.1.1.1", "ssh", outcome="failed"))
    later = findings_to_alerts(detect(data, RULES), rule_rows(spark, RULES), created_at=datetime(2030, 1, 1))
    assert make(spark, data).first().alert_id == later.first().alert_id


def test_triage(spark):
    stored = alerts(spark, {}, {}, {"status": "acknowledged"})
    log = status_change(stored, "a0", "resolved", BASE + timedelta(days=1))
    log = log.unionByName(status_change(stored, "a0", "false_positive", BASE + timedelta(days=2)))
    log = log.unionByName(status_change(stored, "nobody", "resolved", BASE))
    current = {r.alert_id: r for r in with_current_status(stored, log).collect()}
    assert {k: r.status for k, r in current.items()} == {"a0": "false_positive", "a1": "open", "a2": "acknowledged"}
    assert current["a0"].updated_at == BASE + timedelta(days=2)
    with pytest.raises(ValueError):
        status_change(stored, "a0", "closed", BASE)
    assert with_current_status(stored, spark.createDataFrame([], STATUS_CHANGE)).columns == stored.columns


def test_view(spark):
    stored = alerts(spark, {"source_ip": "1.1.1.1", "mitre_technique": "T1190"}, {"source_ip": None}, {"source_ip": "2.2.2.2"})
    rows = {r.alert_id: r for r in alert_view(stored, enrichment(spark, **{"1_1_1_1": 42})).collect()}
    assert rows["a0"].technique_name == "Exploit Public-Facing Application"
    assert rows["a0"].enrichment.abuse_score == 42 and rows["a0"].enrichment.country == "Testland"
    assert rows["a1"].enrichment is None and rows["a2"].enrichment is None and rows["a1"].tactic is None


def test_listing(spark):
    stored = alerts(spark, *[{"severity": "low" if n % 2 else "high"} for n in range(10)])
    page = reports.alert_page(stored, limit=2, offset=1, severity="low")
    assert [r.alert_id for r in page.collect()] == ["a7", "a5"]
    for limit, offset in ((0, 0), (501, 0), (1, -1)):
        with pytest.raises(ValueError):
            reports.alert_page(stored, limit=limit, offset=offset)


def test_live_feed_shows_each_alert_once(spark):
    stored = alerts(spark, *[{} for _ in range(20)])
    renewed = stored.withColumn("status", F.lit("resolved")).withColumn("updated_at", F.lit(BASE + timedelta(days=1)))
    rows = reports.live_feed(stored.unionByName(renewed)).collect()
    assert [r.alert_id for r in rows] == [f"a{n}" for n in range(19, 4, -1)]
    assert {r.status for r in rows} == {"resolved"}


def test_dashboard_numbers(spark):
    stored = alerts(
        spark,
        {"severity": "critical", "source_ip": "1.1.1.1"},
        {"severity": "low", "source_ip": "1.1.1.1", "status": "resolved"},
        {"severity": "high", "source_ip": ""},
        {"severity": "low", "source_ip": None, "created_at": BASE + timedelta(hours=5)},
    )
    assert tuple(reports.kpi_cards(stored).first()) == (4, 3, 2, 1)
    histogram = [(r.severity, r.alerts) for r in reports.severity_histogram(stored).orderBy("position").collect()]
    assert histogram == [("critical", 1), ("high", 1), ("medium", 0), ("low", 2), ("info", 0)]
    assert [(r.hour.hour, r.alerts) for r in reports.hourly_timeline(stored).collect()] == [(13, 3), (18, 1)]
    (point,) = reports.geo_points(stored, enrichment(spark, **{"1_1_1_1": 1})).collect()
    assert (point.alerts, point.severity, point.latitude) == (2, "critical", 1.5)


def test_coverage(spark):
    stored = alerts(spark, {"mitre_technique": "T1110"}, {"mitre_technique": "T9999"}, {"mitre_technique": None})
    rows = reports.coverage(rule_rows(spark, RULES), stored).collect()
    assert [(r.technique, r.rule_count, r.alert_count) for r in rows] == [
        ("T1110", 1, 1),
        ("T1046", 1, 0),
        ("T1498", 2, 0),
        ("T1190", 1, 0),
    ]
    grouped = {r.tactic: r.techniques for r in reports.coverage_by_tactic(reports.coverage(rule_rows(spark, RULES), stored)).collect()}
    assert grouped["Credential Access"][0].name == "Brute Force"


def test_rule_sync_is_idempotent(spark):
    none = rule_rows(spark, []).where(F.lit(False))
    first = upsert_rules(none, rule_rows(spark, RULES))
    assert tuple(change_counts(first).first()) == (6, 0)
    stored = first.drop("change")
    assert tuple(change_counts(upsert_rules(stored, rule_rows(spark, RULES))).first()) == (0, 6)
    kept = upsert_rules(stored, rule_rows(spark, RULES[:1])).where("change = 'kept'")
    assert kept.count() == 3


def test_sources_are_registered_once(spark):
    named = spark.createDataFrame([("a", "nginx"), ("b", "apache"), (None, "custom"), ("a", "nginx")], "name string, type string")
    first = new_sources(named, named.where("false"))
    assert {r.name for r in first.collect()} == {"a", "b"}
    assert new_sources(named, first).count() == 0


def test_longest_prefix_wins(spark):
    networks = spark.createDataFrame(
        [("10.0.0.0/8", "wide"), ("10.1.0.0/16", "mid"), ("10.1.2.99/24", "narrow"), ("10.1.2.3/32", "one"), ("0.0.0.0/0", "any")],
        "cidr string, country string",
    ).withColumns({"city": F.lit("c"), "latitude": F.lit(1.0), "longitude": F.lit(2.0)})
    ips = spark.createDataFrame(
        [(ip,) for ip in ("10.9.9.9", "10.1.9.9", "10.1.2.4", "10.1.2.3", "192.0.2.1", "2001:db8::1", "host")], "ip string"
    )
    found = {r.ip: r.country for r in locate(ips, networks).collect()}
    assert found == {
        "10.9.9.9": "wide",
        "10.1.9.9": "mid",
        "10.1.2.4": "narrow",
        "10.1.2.3": "one",
        "192.0.2.1": "any",
        "2001:db8::1": None,
        "host": None,
    }


def test_location_by_either_family(spark):
    blocks = ["2001:db8::/32", "2001:db8:8::/45", "2001:DB8:a:0::/48", "2001:db8:a::1/128", "::ffff:10.0.0.0/104", "9.0.0.0/8"]
    networks = spark.createDataFrame(
        [(c, str(i), "", 0.0, 0.0) for i, c in enumerate(blocks)],
        "cidr string, country string, city string, latitude double, longitude double",
    )
    wanted = {
        "2001:db8::": "0", "2001:0DB8:ffff:0:0:0:0:1": "0", "2001:db8:f::": "1", "2001:db8:10::": "0",
        "2001:db8:a::2": "2", "2001:db8:a:0:0:0:0:1": "3", "::ffff:10.1.2.3": "4", "::FFFF:a01:203": "4",
        "9.1.1.1": "5", "2001:db9::": None, "::": None, "2001:db8:::1": None, "2001:db8": None, "2001:db8:1:2:3:4:5:6:7": None,
        "1::2::3": None, "2001:db8:1:2:3:4:5:6::": None, "2001:db8::g": None, "2001:db8::12345": None, "": None, "::1.2.3.256": None,
    }
    ips = spark.createDataFrame([(ip,) for ip in wanted], "ip string")
    assert {r.ip: r.country for r in locate(ips, networks).collect()} == wanted
    assert locate(ips, networks.limit(0)).where("country IS NOT NULL").count() == 0


def test_enrichment_is_cached(spark):
    data = events(spark, [event(0, "1.1.1.1"), event(1, "1.1.1.1"), event(2, None), event(3, "2.2.2.2"), event(4, "")])
    cache = spark.createDataFrame([], ENRICHMENT)
    feed = spark.createDataFrame([("1.1.1.1", 42)], "ip string, abuse_score int")
    assert build_enrichment(data, cache, now=BASE).count() == 0
    built = build_enrichment(data, cache, feed=feed, now=BASE)
    assert {r.ip: r.abuse_score for r in built.collect()} == {"1.1.1.1": 42, "2.2.2.2": None}
    assert new_addresses(data, built).count() == 0


def test_submission_profiles(spark):
    rows = [("a", t) for t in "123456"] + [("b", "1"), ("b", " 1 ")] + [("c", t) for t in "1123"] + [("d", "1"), ("d", "")]
    df = spark.createDataFrame(rows, "who string, line string")
    labels = {r.who: set(r.attack_types) for r in reports.submission_profile(df, "who").collect()}
    assert labels == {
        "a": {reports.FLOOD},
        "b": {reports.REPEAT},
        "c": {reports.REPEAT, reports.SCAN},
        "d": {reports.QUIET},
    }
    older = {r.who: set(r.attack_types) for r in reports.submission_profile(df, "who", trim=False, scans=False).collect()}
    assert older["b"] == {reports.QUIET} and older["c"] == {reports.REPEAT}
    tally = {r.attack_type: r.submissions for r in reports.attack_tally(reports.submission_profile(df, "who")).collect()}
    assert tally == {reports.FLOOD: 1, reports.REPEAT: 2, reports.SCAN: 1, reports.QUIET: 1}
