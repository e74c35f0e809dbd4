"""Files, stored tables and extension points."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tripline.operators.alerts import suppress_known
from tripline.operators.features import ip_features
from tripline.operators.match import match_findings
from tripline.operators.parsing import dispatch, parse_lines
from tripline.operators.parsing.access import parse_access
from tripline.operators.parsing.sniff import sniff_paths
from tripline.operators.zscore import zscore_findings
from tripline.plans import detection
from tripline.plans.detection import detect, detect_anomalies
from tripline.plans.ingest import ingest, read_any, run_anomaly_scan
from tripline.rules import parse_rule
from tripline.rules.model import definition
from tripline.schemas import ALERT
from tripline.session import materialize, scratch_dir
from tripline.sources.lines import read_lines
from tripline.sources.store import Store
from tripline.workload.adapters import BASE, OPTIONS, base, security_events, security_sql, spread
from tripline.workload.catalog import query
from tripline.workload.detection import _FAILED, _FEATURES, _OUTLIERS, _PEERS, DAY, FAILED_LOGINS, SHIPPED, threshold_sql
from tripline.workload.parsing import access_line, auth_line, eve_line


def _folder(spark) -> str:
    return f"{scratch_dir(spark)}/tripline-job-{uuid.uuid4().hex}"


USERS_A_FILE = 150
#: Which format an event's line has in the files.
_FORMAT = "CASE user_id % 3 WHEN 0 THEN 'auth_log' WHEN 1 THEN 'nginx' ELSE 'suricata' END"


def _files(spark, sf_dir) -> str:
    """Folders of logs in three formats, a file for so many users, and blank lines between."""
    folder, user = _folder(spark), F.col("user_id")
    line = F.when(user % 3 == 0, auth_line()).when(user % 3 == 1, access_line()).otherwise(eve_line())
    part = F.expr(f"user_id div {USERS_A_FILE}").alias("part")
    made = spread(base(spark, sf_dir)).select(F.expr(_FORMAT).alias("format"), part, line.alias("line"))
    rows = materialize(made.where("line IS NOT NULL"), "made-lines")
    for format_ in ("auth_log", "nginx", "suricata"):
        text = rows.where(F.col("format") == format_).select("part", F.concat("line", F.lit("\n\n")).alias("value"))
        text.repartition("part").write.partitionBy("part").text(f"{folder}/{format_}")
    return f"{folder}/*/*"


_WRITTEN = f"written AS (SELECT {_FORMAT} AS format, event_type, event_id, user_id FROM base)"
_FOLDER = "/([a-z_]+)/part=[^/]*/[^/]+$"
#: Whether the line is an event of its format, with a time that can be read.
_EVENT = """event_type <> 'purchase' AND (format <> 'auth_log' OR event_id % 50 <> 1) AND (format <> 'suricata' OR event_type <> 'view')"""


@query(
    "file_lines",
    f"""WITH {BASE}, {_WRITTEN} SELECT format, count(*) AS lines, count(DISTINCT user_id // {USERS_A_FILE}) AS files
    FROM written GROUP BY format""",
)
def file_lines(spark, sf_dir):
    """Lines of a folder of files, with the file that each came from."""
    rows = read_lines(spark, _files(spark, sf_dir))
    format_ = F.regexp_extract("file_path", _FOLDER, 1)
    return rows.groupBy(format_.alias("format")).agg(
        F.count(F.lit(1)).alias("lines"), F.count_distinct("file_path").alias("files")
    )


@query("file_formats", f"WITH {BASE}, {_WRITTEN} SELECT DISTINCT format, format AS told FROM written")
def file_formats(spark, sf_dir):
    """The format of each file of a folder, from its head."""
    told = sniff_paths(spark, _files(spark, sf_dir))
    return told.select(
        F.regexp_extract("file_path", _FOLDER, 1).alias("format"), F.col("source_type").alias("told")
    ).distinct()


@query(
    "file_sources",
    f"""WITH {BASE}, {_WRITTEN} SELECT format AS type, count(*) AS events FROM written WHERE {_EVENT} GROUP BY format""",
)
def file_sources(spark, sf_dir):
    """Files of several formats taken in by one job: each file is a source, and events name theirs."""
    store = Store(spark, _folder(spark))
    lines = read_any(spark, _files(spark, sf_dir))
    ingest(store, lines, "mixed", [], batch="first", options=OPTIONS)
    events, sources = store.read("events"), store.read("log_sources")
    per_source = events.groupBy("source_id").agg(F.count(F.lit(1)).alias("events"))
    return per_source.join(sources, "source_id").groupBy("type").agg(F.sum("events").alias("events"))


@query(
    "file_rejects",
    f"""WITH {BASE}, {_WRITTEN} SELECT format AS type, 'unreadable timestamp' AS reason, count(*) AS rejected FROM written
    WHERE event_type <> 'purchase' AND format = 'auth_log' AND event_id % 50 = 1 GROUP BY format""",
)
def file_rejects(spark, sf_dir):
    """What a job had to refuse, per source and reason; the batch is run twice and replaces its own rows."""
    store = Store(spark, _folder(spark))
    lines = read_any(spark, _files(spark, sf_dir))
    for _ in range(2):
        ingest(store, lines, "mixed", [], batch="first", options=OPTIONS)
    refused, sources = store.read("rejects"), store.read("log_sources")
    per_source = refused.groupBy("source_id", "reason").agg(F.count(F.lit(1)).alias("rejected"))
    per_type = per_source.join(sources, "source_id").groupBy("type", "reason")
    return per_type.agg(F.sum("rejected").alias("rejected"))


@query(
    "alerts_per_event_known",
    f"""WITH {security_sql()} SELECT event_id FROM sec WHERE path IS NOT NULL
      AND (CAST(event_id AS BIGINT) % 7 = 0 OR CAST(event_id AS BIGINT) % 11 = 0) AND CAST(event_id AS BIGINT) % 2 = 1""",
)
def alerts_per_event_known(spark, sf_dir):
    """An event that ever had an alert of a rule gets no second one, whatever became of the first."""
    found = match_findings(security_events(spark, sf_dir), [SHIPPED["sqli_probe"]])
    row = {"event_id": F.col("event_id"), "rule_key": F.lit("sqli_probe"), "status": F.lit("resolved")}
    earlier = base(spark, sf_dir).where(F.col("event_id") % 2 == 0)
    known = earlier.select(*[row.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in ALERT.fields])
    return suppress_known(found, known).select("event_id")


@query(
    "features_without_address",
    f"""WITH {security_sql()} SELECT source_ip, count(*) AS event_count FROM sec
    WHERE CAST(event_id AS BIGINT) % 5 > 1 GROUP BY source_ip""",
)
def features_without_address(spark, sf_dir):
    """Events whose address is null or empty are in no address's features."""
    n = F.col("event_id").cast("bigint")
    ip = F.when(n % 5 == 0, F.lit(None).cast("string")).when(n % 5 == 1, "").otherwise(F.col("source_ip"))
    return ip_features(security_events(spark, sf_dir).withColumn("source_ip", ip)).select("source_ip", "event_count")


@query("rules_enabled_only", f"WITH {security_sql()} SELECT * EXCLUDE (window_end_us) FROM ({threshold_sql(FAILED_LOGINS, _FAILED)})")
def rules_enabled_only(spark, sf_dir):
    """A rule that is switched off finds nothing."""
    off = parse_rule({**definition(FAILED_LOGINS), "key": "off", "name": "Off", "severity": "low", "enabled": False})
    found = detect(security_events(spark, sf_dir), [FAILED_LOGINS, off])
    return found.select("rule_key", "title", "description", "severity", "mitre_technique", "score", "source_ip", "group_key")


@query("store_clear", "SELECT count(*) AS before, count(*) AS removed, CAST(0 AS BIGINT) AS left FROM events")
def store_clear(spark, sf_dir):
    """All events stored, then cleared."""
    store = Store(spark, _folder(spark))
    store.write_batch("events", security_events(spark, sf_dir), "all")
    before = store.read("events").count()
    removed = store.clear(confirm=True)["events"]
    rest = store.read("events").agg(F.count(F.lit(1)).alias("left"))
    return rest.select(F.lit(before).cast("bigint").alias("before"), F.lit(removed).cast("bigint").alias("removed"), "left")


@query(
    "zscore_uniform_peers",
    """SELECT '10.0.0.' || CAST(user_id AS VARCHAR) AS source_ip, CAST(0.8 AS DOUBLE) AS score FROM events
    GROUP BY user_id HAVING user_id = (SELECT min(user_id) FROM events)""",
)
def zscore_uniform_peers(spark, sf_dir):
    """Peers that are all alike have no spread; one address with more events than half as many again stands out."""
    events = security_events(spark, sf_dir)
    addresses = events.groupBy("source_ip").agg(F.min_by(F.struct(*events.columns), "event_id").alias("e")).select("e.*")
    least = base(spark, sf_dir).agg(F.min(F.struct("user_id", "ip"))["ip"]).scalar()
    copies = F.when(F.col("source_ip") == least, 40).otherwise(10)
    alike = addresses.withColumn("copy", F.explode(F.sequence(F.lit(1), copies))).drop("copy")
    return zscore_findings(ip_features(alike), F.lit(None)).select("source_ip", "score")


@query(
    "custom_parser",
    f"""WITH {BASE} SELECT 'access-v2' AS format, count(*) AS lines FROM base WHERE event_type <> 'purchase'""",
)
def custom_parser(spark, sf_dir):
    """A format that is added to the registry is parsed like those shipped."""
    before = dict(dispatch._PARSERS)
    try:
        dispatch.register_format("access-v2", lambda df, line, options: parse_access(df, F.expr("substr(line, 4)"), options))
        lines = base(spark, sf_dir).select(F.concat(F.lit("v2 "), access_line()).alias("line")).where("line IS NOT NULL")
        parsed = parse_lines(lines, "access-v2", OPTIONS)
        return parsed.where("recognized").groupBy(F.lit("access-v2").alias("format")).agg(F.count(F.lit(1)).alias("lines"))
    finally:
        dispatch._PARSERS.clear()
        dispatch._PARSERS.update(before)


@query(
    "custom_detector",
    f"WITH {security_sql(loud=True)}, {_FEATURES.format(source='sec')} SELECT source_ip FROM features WHERE error_count * 4 > event_count",
)
def custom_detector(spark, sf_dir):
    """A detector that is added to the registry runs with those shipped."""

    def mostly_errors(features, window_end):
        chosen = features.where(F.col("error_count") * 4 > F.col("event_count"))
        template = zscore_findings(features, window_end).limit(0)
        return template.unionByName(
            chosen.select(F.lit("mostly_errors").alias("rule_key"), "source_ip"), allowMissingColumns=True
        )

    before = dict(detection._DETECTORS)
    try:
        detection._DETECTORS.clear()
        detection.register_detector("rate_anomaly", zscore_findings)
        detection.register_detector("mostly_errors", mostly_errors)
        found = detect_anomalies(security_events(spark, sf_dir, loud=True), F.lit(None).cast("timestamp"))
        return found.where("rule_key = 'mostly_errors'").select("source_ip")
    finally:
        detection._DETECTORS.clear()
        detection._DETECTORS.update(before)


@query(
    "anomaly_alerts",
    f"WITH {security_sql(loud=True)}, recent AS (SELECT * FROM sec WHERE ts >= (SELECT max(ts) FROM sec) "
    f"- INTERVAL {DAY} SECOND), {_FEATURES.format(source='recent')}, {_PEERS}, outliers AS ({_OUTLIERS}) "
    "SELECT rule_key, title, source_ip, least(100.0, round_even((50.0 + score * 10.0) * 10, 0) / 10) AS score, "
    "CAST(0 AS BIGINT) AS again FROM outliers",
)
def anomaly_alerts(spark, sf_dir):
    """The anomaly scan as a job over stored events; a second scan raises nothing again."""
    store = Store(spark, _folder(spark))
    store.write_batch("events", security_events(spark, sf_dir, loud=True), "all")
    alerts = run_anomaly_scan(store, DAY, batch="scan-1", options=OPTIONS)
    again = run_anomaly_scan(store, DAY, batch="scan-2", options=OPTIONS).count()
    volume = alerts.where("rule_key = 'rate_anomaly'")
    return volume.select("rule_key", "title", "source_ip", "score", F.lit(again).cast("bigint").alias("again"))
