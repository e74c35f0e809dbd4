from datetime import timedelta

import pytest
from builders import BASE, burst, event, events
from conftest import SF_DIR
from pyspark.sql import functions as F

from tripline.operators.features import feature_vector, ip_features
from tripline.operators.forest import average_path, draw_samples, forest_findings, forest_scores, grow
from tripline.operators.joins import join_per_key, lookup
from tripline.operators.match import match_findings
from tripline.operators.quantiles import exact_percentile
from tripline.operators.threshold import threshold_findings
from tripline.operators.zscore import leave_one_out, zscore_findings
from tripline.plans.detection import anomaly_scan, detect, register_detector
from tripline.rules import load_rules, parse_rule
from tripline.workload import QUERIES

RULES = {rule.key: rule for rule in load_rules()}
def end():
    return F.lit(BASE)



def found(findings):
    return {row.group_key: row for row in findings.collect()}


@pytest.mark.parametrize(
    ("count", "outcome", "expected"), [(6, "failed", 1), (6, "invalid_user", 1), (4, "failed", 0), (6, "accepted", 0)]
)
def test_brute_force(spark, count, outcome, expected):
    data = events(spark, burst(count, "203.0.113.5", "ssh", outcome=outcome))
    rows = threshold_findings(data, [RULES["brute_force_ssh"]]).collect()
    assert len(rows) == expected
    for row in rows:
        assert (row.severity, row.mitre_technique, row.source_ip) == ("high", "T1110", "203.0.113.5")
        assert row.title == "SSH Brute-Force Attempt from 203.0.113.5"
        assert row.description == "6 events in 60s (threshold 5)"
        assert row.score == 0.6


def test_port_scan_counts_distinct_ports(spark):
    data = events(spark, [event(i, "203.0.113.66", "tcp", dest_port=1000 + i // 2) for i in range(24)])
    (row,) = threshold_findings(data, [RULES["port_scan"]]).collect()
    assert row.description == "12 distinct dest_port in 60s (threshold 10)"


def test_window_ends_at_any_event_and_includes_both_ends(spark):
    failed = [event(s, "1.1.1.1", "ssh", outcome="failed") for s in (0, 10, 20, 30, 40)]
    rule = [RULES["brute_force_ssh"]]
    at_edge = events(spark, [*failed, event(60, "1.1.1.1", "http")])
    beyond = events(spark, [*failed, event(61, "1.1.1.1", "http")])
    assert threshold_findings(at_edge, rule).count() == 1
    assert threshold_findings(beyond, rule).count() == 0


def test_only_keys_of_the_batch_over_all_history(spark):
    history = [event(i, ip, "ssh", outcome="failed") for ip in ("1.1.1.1", "2.2.2.2") for i in range(4)]
    old_burst = [event(i - 5000, "3.3.3.3", "ssh", outcome="failed") for i in range(6)]
    new = [event(5, "1.1.1.1", "ssh", outcome="failed"), event(6, "3.3.3.3", "ssh", outcome="failed")]
    batch, rule = events(spark, new), [RULES["brute_force_ssh"]]
    everything = events(spark, history + old_burst + new)
    for rows in (0, 1000):
        assert set(found(threshold_findings(everything, rule, batch, broadcast_rows=rows))) == {"1.1.1.1"}


def test_late_event_does_not_move_the_window(spark):
    stored = [event(i, "1.1.1.1", "ssh", outcome="failed") for i in range(100, 104)]
    late = [event(-500, "1.1.1.1", "ssh", outcome="failed"), event(90, "1.1.1.1", "ssh", outcome="failed")]
    rule = [RULES["brute_force_ssh"]]
    for lateness, fires in ((late[:1], 0), (late[1:], 1)):
        assert threshold_findings(events(spark, stored + lateness), rule, events(spark, lateness)).count() == fires


def test_other_group_keys_carry_no_source_ip(spark):
    rule = parse_rule(
        {"type": "threshold", "key": "k", "name": "Busy", "window_seconds": 60, "threshold": 3, "group_by": "dest_ip"}
    )
    data = events(spark, [event(i, f"1.1.1.{i}", dest_ip="9.9.9.9") for i in range(4)] + [event(0, "1.1.1.1")])
    (row,) = threshold_findings(data, [rule]).collect()
    assert (row.source_ip, row.group_key, row.title) == (None, "9.9.9.9", "Busy from 9.9.9.9")


def test_sqli_match(spark):
    paths = [
        "/shop/list?sort=2%20union%20select%20card%20from%20orders--",
        "/p?id=1%27%20OR%20%271%27%3D%271",
        "/p?id=1+or+1=1",
        "/p?q=100%",
        "/p?q=%zz;%20drop%09table",
        "/plain",
        None,
    ]
    data = events(spark, [event(i, "1.1.1.1", "http", path=p) for i, p in enumerate(paths)] + [event(0, "2.2.2.2", "ssh", path=paths[0])])
    rows = match_findings(data, [RULES["sqli_probe"]]).collect()
    assert {r.event_id for r in rows} == {"0", "1", "4"}
    (first,) = [r for r in rows if r.event_id == "0"]
    assert first.description == "Matched raw.path: /shop/list?sort=2 union select card from orders--"
    assert (first.score, first.mitre_technique, first.title) == (0.9, "T1190", "SQL Injection Probe from 1.1.1.1")


def test_one_event_can_match_several_rules(spark):
    again = parse_rule({"type": "match", "key": "k", "name": "n", "field": "raw.path", "patterns": ["(?i)select", "x"]})
    data = events(spark, [event(0, None, "http", path="/?union%20select%20x")])
    rows = detect(data, [RULES["sqli_probe"], again]).collect()
    assert sorted(r.rule_key for r in rows) == ["k", "sqli_probe"]
    assert rows[0].title.endswith("from None")


def test_disabled_rules_find_nothing(spark):
    rule = parse_rule({"type": "match", "key": "k", "name": "n", "field": "raw.path", "patterns": ["."], "enabled": False})
    assert detect(events(spark, [event(0, "1.1.1.1", path="/")]), [rule]).count() == 0


def test_features(spark):
    data = events(
        spark,
        [event(0, "1.1.1.1", outcome="failed"), event(30, "1.1.1.1", outcome="failed"), event(60, "1.1.1.1", outcome="accepted")]
        + [event(i, "3.3.3.3", dest_port=1000 + i, status=500) for i in range(5)]
        + [event(0, None), event(0, "")],
    )
    rows = {r.source_ip: r for r in ip_features(data).collect()}
    assert set(rows) == {"1.1.1.1", "3.3.3.3"}
    one, three = rows["1.1.1.1"], rows["3.3.3.3"]
    assert (one.event_count, one.failed_count, one.duration_seconds, one.rate_per_min) == (3, 2, 60.0, 3.0)
    assert (three.distinct_dest_ports, three.error_count) == (5, 5)


def quiet(peers, count, **raw):
    return [e for n in range(peers) for e in burst(count, f"10.0.0.{n}", **raw)]


def test_volume_outlier(spark):
    features = ip_features(events(spark, quiet(8, 4) + burst(40, "203.0.113.9")))
    (row,) = zscore_findings(features, end()).collect()
    assert (row.source_ip, row.score) == ("203.0.113.9", 0.8)
    assert row.description == "40 events vs peer mean 4.0 (z-score 3.0) — statistical outlier"


@pytest.mark.parametrize("data", [quiet(6, 5), quiet(6, 25), burst(40, "1.1.1.1") + burst(1, "2.2.2.2"), quiet(3, 20) + burst(29, "9.9.9.9")])
def test_quiet_populations(spark, data):
    assert zscore_findings(ip_features(events(spark, data)), end()).count() == 0


def test_leave_one_out_by_definition(spark):
    import statistics

    counts = {f"10.0.0.{n}": c for n, c in enumerate([3, 9, 27, 4, 4, 80])}
    rows = leave_one_out(ip_features(events(spark, [e for ip, c in counts.items() for e in burst(c, ip)]))).collect()
    for row in rows:
        others = [c for ip, c in counts.items() if ip != row.source_ip]
        assert row.peer_mean == pytest.approx(statistics.mean(others))
        assert row.peer_spread == pytest.approx(statistics.pstdev(others))


def scanner():
    return [event(i, "203.0.113.50", dest_port=p) for i, p in enumerate(range(40))]


def test_forest_isolates_the_scanner_whatever_the_partitioning(spark):
    data = quiet(10, 5, path="/", status=200) + scanner()
    features = ip_features(events(spark, data))
    one = {(r.source_ip, r.score) for r in forest_findings(features, end()).collect()}
    other = {(r.source_ip, r.score) for r in forest_findings(features.repartition(5, "event_count"), end()).collect()}
    assert "203.0.113.50" in {ip for ip, _ in one}
    assert one == other


def test_forest_equals_a_plain_walk(spark):
    """Scores by walking every tree by hand, and findings by numpy's percentile."""
    import numpy as np

    features = ip_features(events(spark, quiet(30, 3, path="/") + quiet(9, 7, path="/y") + scanner()))
    vectors = features.select("source_ip", feature_vector().alias("vector"))
    nodes = grow(draw_samples(vectors, vectors.count())).toPandas()
    size = min(256, vectors.count())
    trees = {t: {r.node: r for r in g.itertuples()} for t, g in nodes.groupby("tree")}

    def plain(point):
        depths = []
        for tree in trees.values():
            at = tree[0]
            while at.left >= 0:
                at = tree[at.left if point[at.feature] <= at.cut else at.right]
            depths.append(at.depth)
        return 2.0 ** (-sum(depths) / len(depths) / float(average_path(size)))

    expected = {r.source_ip: plain(r.vector) for r in vectors.collect()}
    got = {r.source_ip: r.anomaly for r in forest_scores(vectors, nodes, size).collect()}
    assert got == pytest.approx(expected)
    cutoff = np.percentile([-s for s in got.values()], 10)
    found = {r.source_ip for r in forest_findings(features, end()).collect()}
    assert found == {ip for ip, s in got.items() if -s < cutoff}


def test_forest_on_a_larger_population(spark):
    odd = [event(i, f"203.0.113.{n}", dest_port=i, outcome="failed") for n in range(5) for i in range(60)]
    features = ip_features(events(spark, quiet(200, 3, path="/") + quiet(100, 4, path="/x") + odd))
    flagged = {r.source_ip for r in forest_findings(features, end()).collect()}
    assert {f"203.0.113.{n}" for n in range(5)} <= flagged
    assert len(flagged) < 0.2 * 300


def test_small_population_has_no_forest(spark):
    assert forest_findings(ip_features(events(spark, burst(5, "1.1.1.1"))), end()).count() == 0


def test_anomaly_scan_looks_at_the_latest_window_only(spark):
    old = [event(i - 4000, "198.51.100.1") for i in range(60)]
    rows = anomaly_scan(events(spark, old + quiet(10, 5, path="/") + scanner())).collect()
    assert {r.rule_key for r in rows if r.source_ip == "203.0.113.50"} == {"rate_anomaly", "ml_outlier"}
    assert "198.51.100.1" not in {r.source_ip for r in rows}
    assert {r.window_end for r in rows} == {BASE + timedelta(seconds=39)}
    with pytest.raises(ValueError):
        anomaly_scan(events(spark, old), 5)


def test_detectors_can_be_added(spark):
    from tripline.plans import detection

    register_detector("loud", lambda features, end: zscore_findings(features, end, min_count=4).withColumn("rule_key", F.lit("loud")))
    try:
        rows = anomaly_scan(events(spark, quiet(3, 2) + burst(8, "9.9.9.9"))).collect()
    finally:
        del detection._DETECTORS["loud"]
    assert [r.rule_key for r in rows] == ["loud"]


@pytest.mark.parametrize("q", [0.0, 0.1, 0.25, 0.5, 0.99, 1.0])
def test_exact_percentile(spark, q):
    import numpy as np

    values = [float((i * 7919) % 1000) for i in range(3000)] + [13.0] * 2000
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert exact_percentile(df, "v", q, accuracy=20) == pytest.approx(np.percentile(values, q * 100))


def test_exact_percentile_of_uneven_values(spark):
    import numpy as np

    values = [1e-300, 2e-300, 5e-324, 0.0, -1e300, 1e300, 7.0, np.nextafter(7.0, 8.0)] + [7.0] * 50
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "v double")
    for q in (0.0, 0.03, 0.05, 0.07, 0.5, 0.96, 1.0):
        assert exact_percentile(df, "v", q, accuracy=2) == pytest.approx(np.percentile(values, q * 100), rel=1e-12, abs=0)
    assert exact_percentile(df.where("v = 7"), "v", 0.3) == 7.0
    assert exact_percentile(df.limit(0), "v", 0.3) is None


def test_joins_under_skew_keep_every_row(spark):
    rows = spark.range(20_000).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, "lost").when(F.col("id") % 50 == 0, None)
        .otherwise(F.concat(F.lit("k"), (F.col("id") % 900).cast("string"))).alias("key"),
        "id",
    )
    table = rows.where("key is not null and key <> 'lost'").groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    plain = sorted(map(repr, rows.join(table.drop("n"), "key", "left").select("key", "id", "first").collect()))
    for limit in (0, 10**6):
        joined = lookup(rows, table.drop("n"), "key", broadcast_rows=limit).select("key", "id", "first")
        assert sorted(map(repr, joined.collect())) == plain
    inner = rows.join(table, "key").count()
    for small in (True, False):
        assert join_per_key(rows, table, "key", "n", small).count() == inner


def test_trees_draw_from_the_whole_population(spark):
    many = spark.range(200_000).select(F.concat(F.lit("a"), "id").alias("source_ip"))
    drawn = draw_samples(many, 200_000)
    per_tree = drawn.groupBy("tree").count().collect()
    assert {r["count"] for r in per_tree} == {256} and len(per_tree) == 100
    assert drawn.select("source_ip").distinct().count() > 23_000


@pytest.mark.parametrize("name", ["rule_threshold_new_batch", "rule_threshold_skewed"])
def test_events_are_scanned_few_times(spark, name):
    plan = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert 1 <= plan.count("Relation [event_id") <= 3
