"""Scoring, de-duplication, triage and the dashboard's numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tripline.functions.attack import technique_url
from tripline.operators import reports
from tripline.operators.alerts import (
    alert_view,
    findings_to_alerts,
    link_rules,
    score_findings,
    suppress_known,
    with_current_status,
)
from tripline.operators.threshold import threshold_findings
from tripline.rules import load_rules
from tripline.schemas import ALERT, STATUS_CHANGE
from tripline.sources.registry import new_sources
from tripline.sources.rule_table import change_counts, rule_rows, upsert_rules
from tripline.workload.adapters import (
    ALERTS_SQL,
    BASE,
    ENRICHMENT_SQL,
    OPTIONS,
    TECHNIQUES_SQL,
    alerts,
    base,
    enrichment,
    micros,
    security_events,
    security_sql,
    table,
)
from tripline.workload.catalog import query
from tripline.workload.detection import _FAILED, FAILED_LOGINS, PORT_SPREAD, RULES, threshold_sql

RULE_SET = [*load_rules(), *RULES]


def _findings(spark, sf_dir):
    return threshold_findings(security_events(spark, sf_dir), [FAILED_LOGINS, PORT_SPREAD])


_FINDINGS = f"found AS ({threshold_sql(FAILED_LOGINS, _FAILED)} UNION ALL {threshold_sql(PORT_SPREAD, 'true')})"

_RISK = """round_even(greatest(0.0, least(100.0, CASE f.severity WHEN 'high' THEN 70.0 ELSE 50.0 END
    + f.score * 10.0 + coalesce(e.abuse_score * 0.3, 0.0))) * 10, 0) / 10"""
_ESCALATED = """CASE WHEN e.abuse_score >= 80 THEN CASE f.severity WHEN 'high' THEN 'critical' ELSE 'high' END
    ELSE f.severity END"""


@query(
    "alerts_scored",
    f"""WITH {security_sql()}, {_FINDINGS}, {ENRICHMENT_SQL}
    SELECT f.rule_key, f.source_ip, {_ESCALATED} AS severity, CAST({_RISK} AS DOUBLE) AS score
    FROM found f LEFT JOIN enr e ON f.source_ip = e.ip""",
)
def alerts_scored(spark, sf_dir):
    scored = score_findings(_findings(spark, sf_dir), enrichment(spark, sf_dir))
    return scored.select("rule_key", "source_ip", "severity", "score")


def _known(spark, sf_dir):
    """Alerts of earlier days: an open one per third user, closed ones for others."""
    status = F.when(F.col("user_id") % 3 == 0, "open").otherwise("resolved")
    values = {
        "alert_id": F.col("ip"),
        "rule_key": F.when(F.col("user_id") % 2 == 0, FAILED_LOGINS.key).otherwise(PORT_SPREAD.key),
        "group_key": F.col("ip"),
        "source_ip": F.col("ip"),
        "status": status,
    }
    rows = base(spark, sf_dir).select("user_id", "ip").distinct()
    return rows.select(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in ALERT.fields])


@query(
    "alerts_deduped",
    f"""WITH {security_sql()}, {_FINDINGS},
    known AS (SELECT DISTINCT ip, CASE WHEN user_id % 2 = 0 THEN 'failed_logins' ELSE 'port_spread' END AS rule_key
              FROM base WHERE user_id % 3 = 0)
    SELECT rule_key, group_key, title FROM found f
    WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.ip = f.group_key AND k.rule_key = f.rule_key)""",
)
def alerts_deduped(spark, sf_dir):
    return suppress_known(_findings(spark, sf_dir), _known(spark, sf_dir)).select("rule_key", "group_key", "title")


@query(
    "alerts_linked",
    f"""WITH {security_sql()}, {_FINDINGS} SELECT rule_key, group_key, rule_key = 'failed_logins' AS linked FROM found""",
)
def alerts_linked(spark, sf_dir):
    """Only one of the two rules is in the rule table."""
    linked = link_rules(_findings(spark, sf_dir), rule_rows(spark, [FAILED_LOGINS]))
    return linked.select("rule_key", "group_key", F.col("rule_id").isNotNull().alias("linked"))


@query(
    "alerts_new",
    f"""WITH {security_sql()}, {_FINDINGS}, {ENRICHMENT_SQL},
    known AS (SELECT DISTINCT ip, CASE WHEN user_id % 2 = 0 THEN 'failed_logins' ELSE 'port_spread' END AS rule_key
              FROM base WHERE user_id % 3 = 0)
    SELECT sha256(f.rule_key || '|g:' || f.group_key || '|' || CAST(f.window_end_us AS VARCHAR)) AS alert_id, f.rule_key,
           f.source_ip, f.title, f.description, {_ESCALATED} AS severity, f.mitre_technique,
           CAST({_RISK} AS DOUBLE) AS score, 'open' AS status
    FROM found f LEFT JOIN enr e ON f.source_ip = e.ip
    WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.ip = f.group_key AND k.rule_key = f.rule_key)""",
)
def alerts_new(spark, sf_dir):
    """The whole path from events to rows of the alert table."""
    made = findings_to_alerts(
        _findings(spark, sf_dir),
        rule_rows(spark, RULE_SET),
        enrichment(spark, sf_dir),
        _known(spark, sf_dir),
        created_at=OPTIONS.stamp,
    )
    return made.select(
        "alert_id", "rule_key", "source_ip", "title", "description", "severity", "mitre_technique", "score", "status"
    )


_PARENT = "coalesce(c.{0}, p.{0})"
_CATALOG_JOIN = """LEFT JOIN catalog c ON c.technique = a.mitre_technique
    LEFT JOIN catalog p ON p.technique = split_part(a.mitre_technique, '.', 1)"""


@query(
    "alerts_enriched",
    f"""WITH {ALERTS_SQL}, {ENRICHMENT_SQL}, {TECHNIQUES_SQL}
    SELECT a.alert_id, a.source_ip, a.severity, a.mitre_technique, {_PARENT.format('name')} AS technique_name,
      {_PARENT.format('tactic')} AS tactic, e.country, e.latitude, e.abuse_score
    FROM alerts a {_CATALOG_JOIN} LEFT JOIN enr e ON a.source_ip = e.ip""",
)
def alerts_enriched(spark, sf_dir):
    shown = alert_view(alerts(spark, sf_dir), enrichment(spark, sf_dir))
    return shown.select(
        "alert_id", "source_ip", "severity", "mitre_technique", "technique_name", "tactic",
        "enrichment.country", "enrichment.latitude", "enrichment.abuse_score",
    )


@query(
    "alert_filter",
    f"""WITH {ALERTS_SQL} SELECT alert_id, score FROM alerts
    WHERE status = 'open' AND severity = 'high' AND source_ip = '10.0.0.7'""",
)
def alert_filter(spark, sf_dir):
    wanted = {"status": "open", "severity": "high", "source_ip": "10.0.0.7"}
    return reports.filter_alerts(alerts(spark, sf_dir), **wanted).select("alert_id", "score")


@query(
    "alert_page",
    f"""WITH {ALERTS_SQL} SELECT alert_id, severity, epoch_us(created_at) AS created_at_us FROM alerts
    WHERE severity = 'high' ORDER BY created_at DESC, alert_id DESC LIMIT 200 OFFSET 40""",
)
def alert_page(spark, sf_dir):
    page = reports.alert_page(alerts(spark, sf_dir), 200, 40, severity="high")
    return page.select("alert_id", "severity", micros("created_at"))


@query(
    "alert_by_id",
    f"WITH {ALERTS_SQL} SELECT alert_id, severity, status, source_ip FROM alerts WHERE alert_id = 'a17'",
)
def alert_by_id(spark, sf_dir):
    return reports.alert_by_id(alerts(spark, sf_dir), "a17").select("alert_id", "severity", "status", "source_ip")


@query(
    "live_feed",
    f"""WITH {ALERTS_SQL} SELECT alert_id, 'later' AS title, epoch_us(created_at) AS created_at_us FROM alerts
    ORDER BY created_at DESC, alert_id DESC LIMIT 15""",
)
def live_feed(spark, sf_dir):
    """Every alert arrives twice; the later version is the one shown."""
    once = alerts(spark, sf_dir)
    again = once.withColumn("updated_at", F.col("updated_at") + F.expr("INTERVAL 1 SECOND")).withColumn("title", F.lit("later"))
    return reports.live_feed(again.unionByName(once)).select("alert_id", "title", micros("created_at"))


def _triage(spark, sf_dir):
    """Three changes per customer order number, some for alerts that do not exist."""
    orders = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "resolved").when(F.col("o_orderstatus") == "O", "acknowledged").otherwise("open")
    return orders.select(
        F.concat(F.lit("a"), F.col("o_custkey").cast("string")).alias("alert_id"),
        status.alias("status"),
        F.col("o_orderdate").cast("timestamp").alias("ts"),
    ).select(*[F.col(f.name).cast(f.dataType) for f in STATUS_CHANGE.fields])


@query(
    "latest_status",
    f"""WITH {ALERTS_SQL}, log AS (
      SELECT 'a' || CAST(o_custkey AS VARCHAR) AS alert_id, CASE o_orderstatus WHEN 'F' THEN 'resolved' WHEN 'O' THEN
        'acknowledged' ELSE 'open' END AS status, CAST(o_orderdate AS TIMESTAMP) AS ts FROM orders),
    latest AS (SELECT alert_id, status, ts, row_number() OVER (PARTITION BY alert_id ORDER BY ts DESC, status DESC) AS n FROM log)
    SELECT a.alert_id, coalesce(l.status, a.status) AS status, epoch_us(coalesce(l.ts, a.created_at)) AS updated_at_us
    FROM alerts a LEFT JOIN latest l ON a.alert_id = l.alert_id AND l.n = 1""",
)
def latest_status(spark, sf_dir):
    current = with_current_status(alerts(spark, sf_dir), _triage(spark, sf_dir))
    return current.select("alert_id", "status", micros("updated_at"))


@query(
    "kpi_cards",
    f"""WITH {ALERTS_SQL} SELECT count(*) AS total, count(*) FILTER (WHERE status = 'open') AS open,
    count(*) FILTER (WHERE severity IN ('critical', 'high')) AS high_critical,
    count(DISTINCT source_ip) AS source_ips FROM alerts""",
)
def kpi_cards(spark, sf_dir):
    return reports.kpi_cards(alerts(spark, sf_dir))


@query(
    "severity_histogram",
    f"""WITH {ALERTS_SQL}, ladder(position, severity) AS (VALUES (0, 'critical'), (1, 'high'), (2, 'medium'), (3, 'low'),
      (4, 'info'))
    SELECT l.position, l.severity, count(a.alert_id) AS alerts
    FROM ladder l LEFT JOIN alerts a ON a.severity = l.severity
    GROUP BY l.position, l.severity""",
)
def severity_histogram(spark, sf_dir):
    return reports.severity_histogram(alerts(spark, sf_dir))


@query(
    "alert_timeline",
    f"""WITH {ALERTS_SQL} SELECT epoch_us(date_trunc('hour', created_at)) AS hour_us, count(*) AS alerts
    FROM alerts GROUP BY 1""",
)
def alert_timeline(spark, sf_dir):
    return reports.hourly_timeline(alerts(spark, sf_dir)).select(micros("hour"), "alerts")


_RANK = "CASE a.severity WHEN 'critical' THEN 5 WHEN 'high' THEN 4 WHEN 'medium' THEN 3 WHEN 'low' THEN 2 ELSE 1 END"


@query(
    "geo_points",
    f"""WITH {ALERTS_SQL}, {ENRICHMENT_SQL}
    SELECT e.latitude, e.longitude, count(*) AS alerts, arg_max(a.severity, {_RANK}) AS severity
    FROM alerts a JOIN enr e ON a.source_ip = e.ip WHERE e.latitude IS NOT NULL AND e.longitude IS NOT NULL
    GROUP BY e.latitude, e.longitude""",
)
def geo_points(spark, sf_dir):
    return reports.geo_points(alerts(spark, sf_dir), enrichment(spark, sf_dir))


_COVERED = """rules(technique, rule_count) AS (VALUES ('T1110', 2), ('T1498', 2), ('T1046', 2), ('T1190', 1)),
    hits AS (SELECT mitre_technique, count(*) AS n FROM alerts GROUP BY 1),
    covered AS (SELECT r.technique, c.name, c.tactic, CAST(r.rule_count AS BIGINT) AS rule_count,
      coalesce(h.n, 0) AS alert_count FROM rules r LEFT JOIN hits h ON h.mitre_technique = r.technique
      LEFT JOIN catalog c ON c.technique = r.technique)"""


@query("mitre_coverage", f"WITH {ALERTS_SQL}, {TECHNIQUES_SQL}, {_COVERED} SELECT * FROM covered")
def mitre_coverage(spark, sf_dir):
    return reports.coverage(rule_rows(spark, RULE_SET), alerts(spark, sf_dir))


@query(
    "coverage_by_tactic",
    f"""WITH {ALERTS_SQL}, {TECHNIQUES_SQL}, {_COVERED} SELECT coalesce(tactic, 'Other') AS tactic,
    string_agg(technique, ',' ORDER BY technique) AS techniques, CAST(sum(alert_count) AS BIGINT) AS alerts
    FROM covered GROUP BY 1""",
)
def coverage_by_tactic(spark, sf_dir):
    grouped = reports.coverage_by_tactic(reports.coverage(rule_rows(spark, RULE_SET), alerts(spark, sf_dir)))
    total = F.aggregate("techniques", F.lit(0).cast("bigint"), lambda sum_, t: sum_ + t.alert_count)
    return grouped.select("tactic", F.concat_ws(",", F.col("techniques.technique")).alias("techniques"), total.alias("alerts"))


@query(
    "technique_links",
    f"""WITH {ALERTS_SQL} SELECT mitre_technique, 'https://attack.mitre.org/techniques/' ||
    replace(mitre_technique, '.', '/') || '/' AS url, count(*) AS alerts FROM alerts
    WHERE mitre_technique IS NOT NULL GROUP BY 1, 2""",
)
def technique_links(spark, sf_dir):
    counts = reports.alerts_per_technique(alerts(spark, sf_dir))
    return counts.select("mitre_technique", technique_url(F.col("mitre_technique")).alias("url"), F.col("alert_count").alias("alerts"))


@query(
    "rule_upsert",
    """SELECT 'rule-' || CAST(c_custkey AS VARCHAR) AS key,
    CASE c_custkey % 3 WHEN 2 THEN c_name ELSE 'new ' || c_name END AS name,
    CASE c_custkey % 3 WHEN 0 THEN 'created' WHEN 1 THEN 'updated' ELSE 'kept' END AS change FROM customer""",
)
def rule_upsert(spark, sf_dir):
    """A rule per customer: a third is new, a third changes, a third stays."""
    old, new = _customer_rules(spark, sf_dir)
    return upsert_rules(old, new).select("key", "name", "change")


def _customer_rules(spark, sf_dir):
    n = F.col("c_custkey")
    row = {
        "rule_id": F.xxhash64("key"), "description": F.lit(None).cast("string"), "severity": F.lit("low"),
        "mitre_technique": F.lit(None).cast("string"), "enabled": F.lit(True), "definition": F.lit("{}"),
    }
    named = table(spark, sf_dir, "customer").withColumn("key", F.concat(F.lit("rule-"), n.cast("string"))).withColumns(row)
    old = named.where(n % 3 != 0).withColumn("name", F.col("c_name"))
    new = named.where(n % 3 != 2).withColumn("name", F.concat(F.lit("new "), "c_name"))
    return old, new


@query(
    "rule_sync_counts",
    f"""SELECT count(*) FILTER (WHERE c_custkey % 3 = 0) + {len(RULE_SET) + 2} AS created,
    count(*) FILTER (WHERE c_custkey % 3 = 1) AS updated FROM customer""",
)
def rule_sync_counts(spark, sf_dir):
    """The customers' rules and the shipped ones, with the two detectors, synced into a table of the customers' rules."""
    shipped = rule_rows(spark, RULE_SET)
    old, new = _customer_rules(spark, sf_dir)
    return change_counts(upsert_rules(old, new.select(*shipped.columns).unionByName(shipped)))


@query(
    "source_registry",
    """SELECT source || '-' || lang AS name, min(lang) AS type FROM documents
    WHERE lang <> 'de' AND source IS NOT NULL GROUP BY 1""",
)
def source_registry(spark, sf_dir):
    """A source per collection and language; the German ones are registered already."""
    documents = table(spark, sf_dir, "documents")
    named = documents.select(F.concat_ws("-", "source", "lang").alias("name"), F.col("lang").alias("type"))
    known = new_sources(named.where(F.col("type") == "de"), named.where(F.lit(False)))
    return new_sources(named, known).select("name", "type")


@query(
    "row_counts",
    """SELECT 'alerts' AS "table", count(*) AS rows FROM events UNION ALL SELECT 'events', count(*) FROM events
    UNION ALL SELECT 'enrichment', count(*) FROM customer UNION ALL SELECT 'log_sources', count(*) FROM supplier""",
)
def row_counts(spark, sf_dir):
    return reports.row_counts(
        alerts=alerts(spark, sf_dir),
        events=security_events(spark, sf_dir),
        enrichment=enrichment(spark, sf_dir),
        log_sources=table(spark, sf_dir, "supplier"),
    )


_PROFILE = f"""{BASE}, counted AS (
      SELECT user_id, count(*) AS lines, count(DISTINCT hour(ts) * 60 + minute(ts)) AS distinct_lines FROM base GROUP BY user_id),
    profiles AS (SELECT user_id, lines, distinct_lines, CASE WHEN lines > 5 THEN 1 ELSE 0 END AS flood,
      CASE WHEN distinct_lines < lines THEN 1 ELSE 0 END AS repeat,
      CASE WHEN distinct_lines < lines AND lines > 3 THEN 1 ELSE 0 END AS scan FROM counted)"""


def _submissions(spark, sf_dir):
    rows = base(spark, sf_dir).select("user_id", F.date_format("ts", " HH:mm ").alias("line"))
    return reports.submission_profile(rows, "user_id")


@query(
    "submission_profile",
    f"WITH {_PROFILE} SELECT user_id, lines, distinct_lines, flood + repeat + scan AS labels FROM profiles",
)
def submission_profile(spark, sf_dir):
    threats = F.size(F.filter("attack_types", lambda a: a != reports.QUIET))
    return _submissions(spark, sf_dir).select("user_id", "lines", "distinct_lines", threats.alias("labels"))


@query(
    "attack_tally",
    f"""WITH {_PROFILE} SELECT attack_type, submissions FROM (
      SELECT 'Denial of Service (DoS) Attack' AS attack_type, count(*) FILTER (WHERE flood = 1) AS submissions FROM profiles
      UNION ALL SELECT 'Brute Force Attack', count(*) FILTER (WHERE repeat = 1) FROM profiles
      UNION ALL SELECT 'Port Scanning', count(*) FILTER (WHERE scan = 1) FROM profiles
      UNION ALL SELECT 'No significant threat detected', count(*) FILTER (WHERE flood + repeat + scan = 0) FROM profiles) t
    WHERE submissions > 0""",
)
def attack_tally(spark, sf_dir):
    return reports.attack_tally(_submissions(spark, sf_dir))
