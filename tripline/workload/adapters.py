"""Security tables derived from the test tables, in Spark and in SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripline.operators.parsing import ParseOptions
from tripline.schemas import ALERT, EVENT, RAW

OPTIONS = ParseOptions(ingest_time=datetime(2024, 2, 1), year=2024)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A task parses about so many rows; Parquet packs millions into one split.
ROWS_A_TASK = 100_000


def spread(df: DataFrame) -> DataFrame:
    """Uses all cores, and tasks of no more than ``ROWS_A_TASK`` rows, on an input with fewer splits than that.

    The rows are counted from the files' footers.
    """
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // ROWS_A_TASK))
    return df.repartition(parts) if df.rdd.getNumPartitions() < parts else df


TEN, PRIVATE = 10 << 24, (192 << 24) + (168 << 16)


def address(number: Column, first: int = TEN) -> Column:
    """The address ``number`` places after ``first``."""
    whole = number.cast("bigint") + first
    return F.concat_ws(".", *[((whole / F.lit(256**k)).cast("bigint") % 256).cast("string") for k in (3, 2, 1, 0)])


def address_sql(number: str, first: int = TEN) -> str:
    return " || '.' || ".join(f"CAST(({number} + {first}) // {256**k} % 256 AS VARCHAR)" for k in (3, 2, 1, 0))


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table with the pieces every adapter uses."""
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        "user_id",
        "event_type",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        address(F.col("user_id")).alias("ip"),
    )


BASE = f"""base AS (
  SELECT event_id, ts, user_id, event_type, CAST(props->>'$.k' AS INTEGER) AS k, {address_sql('user_id')} AS ip
  FROM events)"""


def security_events(spark: SparkSession, sf_dir: str, *, squeeze: int = 1, loud: bool = False) -> DataFrame:
    """Events with protocol, outcome, port, path and status.

    ``squeeze`` divides all time spans, which brings a month of events into
    windows of seconds.  ``loud`` gives a third of all rows to one address.
    """
    rows = base(spark, sf_dir)
    kind = F.col("event_type")
    if squeeze > 1:
        start = 1704067200000000
        rows = rows.withColumn("ts", F.timestamp_micros(F.lit(start) + F.expr(f"(unix_micros(ts) - {start}) div {squeeze}")))
    if loud:
        rows = rows.withColumn("ip", F.when(F.col("event_id") % 3 == 0, "203.0.113.9").otherwise(F.col("ip")))
    web = kind.isin("click", "view")
    raw = {
        "outcome": F.when(kind == "error", "failed").when(kind == "signup", "accepted"),
        "dest_port": F.col("k"),
        "path": F.when(web, F.concat(F.lit("/item?id="), F.col("k").cast("string"), _injection(F.col("event_id")))),
        "user_agent": F.when(web, F.concat(F.lit("agent/"), (F.col("k") % 7).cast("string"))),
        "status": F.when(kind == "error", F.lit(500)).when(web, F.lit(200)),
    }
    values = {
        "event_id": F.col("event_id"),
        "ts": F.col("ts"),
        "source_ip": F.col("ip"),
        "dest_ip": address(F.col("k"), PRIVATE),
        "protocol": F.when(kind.isin("error", "signup"), "ssh").when(web, "http").otherwise("tcp"),
        "raw": F.struct(*[raw.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in RAW.fields]),
        "ingest_ts": OPTIONS.stamp,
        "event_date": F.to_date("ts"),
    }
    return rows.select(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in EVENT.fields])


def _injection(n: Column) -> Column:
    return F.when(n % 7 == 0, "%20UNION%20SELECT%20pw").when(n % 11 == 0, "+or+1=1;%20DROP%20TABLE%20x%").otherwise("")


def security_sql(squeeze: int = 1, loud: bool = False, name: str = "sec") -> str:
    """The same rows as a list of common table expressions."""
    time = "ts"
    if squeeze > 1:
        time = f"make_timestamp(1704067200000000 + (epoch_us(ts) - 1704067200000000) // {squeeze})"
    ip = "CASE WHEN event_id % 3 = 0 THEN '203.0.113.9' ELSE ip END" if loud else "ip"
    return f"""{BASE},
{name} AS (
  SELECT CAST(event_id AS VARCHAR) AS event_id, {time} AS ts, {ip} AS source_ip,
         CASE WHEN event_type IN ('error', 'signup') THEN 'ssh' WHEN event_type IN ('click', 'view') THEN 'http'
              ELSE 'tcp' END AS protocol,
         {address_sql('k', PRIVATE)} AS dest_ip,
         CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'accepted' END AS outcome,
         k AS dest_port,
         CASE WHEN event_type IN ('click', 'view') THEN '/item?id=' || CAST(k AS VARCHAR) ||
           CASE WHEN event_id % 7 = 0 THEN '%20UNION%20SELECT%20pw'
                WHEN event_id % 11 = 0 THEN '+or+1=1;%20DROP%20TABLE%20x%' ELSE '' END END AS path,
         CASE WHEN event_type IN ('click', 'view') THEN 'agent/' || CAST(k % 7 AS VARCHAR) END AS user_agent,
         CASE WHEN event_type = 'error' THEN 500 WHEN event_type IN ('click', 'view') THEN 200 END AS status
  FROM base)"""


def enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One enrichment row per customer number, reputation unknown for some."""
    customers, nations = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    key = F.col("c_custkey")
    return customers.join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey")).select(
        address(key).alias("ip"),
        F.col("n_name").alias("country"),
        F.concat(F.lit("City "), F.col("n_nationkey").cast("string")).alias("city"),
        F.when(key % 9 != 0, F.col("n_nationkey").cast("double") * 2.5 - 30.0).alias("latitude"),
        F.when(key % 9 != 0, F.col("n_nationkey").cast("double") * 5.0 - 60.0).alias("longitude"),
        F.when(key % 7 != 0, (key % 101).cast("int")).alias("abuse_score"),
    )


ENRICHMENT_SQL = f"""enr AS (
  SELECT {address_sql('c_custkey')} AS ip,
         n_name AS country, 'City ' || CAST(n_nationkey AS VARCHAR) AS city,
         CASE WHEN c_custkey % 9 <> 0 THEN CAST(n_nationkey AS DOUBLE) * 2.5 - 30.0 END AS latitude,
         CASE WHEN c_custkey % 9 <> 0 THEN CAST(n_nationkey AS DOUBLE) * 5.0 - 60.0 END AS longitude,
         CASE WHEN c_custkey % 7 <> 0 THEN CAST(c_custkey % 101 AS INTEGER) END AS abuse_score
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One alert per event, over all severities, states and techniques."""
    rows = base(spark, sf_dir)
    kind, user, n = F.col("event_type"), F.col("user_id"), F.col("event_id")
    severity = (
        F.when(kind == "error", "critical").when(kind == "signup", "high").when(kind == "click", "medium")
        .when(kind == "view", "low").otherwise("info")
    )
    status = F.when(n % 4 == 0, "open").when(n % 4 == 1, "acknowledged").when(n % 4 == 2, "resolved").otherwise("false_positive")
    technique = F.when(user % 5 == 0, "T1110").when(user % 5 == 1, "T1190").when(user % 5 == 3, "T1110.999").when(user % 5 == 4, "T9999")
    values = {
        "alert_id": F.concat(F.lit("a"), n.cast("string")),
        "event_id": n.cast("string"),
        "rule_key": F.lit("sqli_probe"),
        "source_ip": F.when(n % 11 != 0, F.col("ip")),
        "title": F.concat(F.lit("Alert "), n.cast("string")),
        "severity": severity,
        "mitre_technique": technique,
        "score": F.col("k").cast("double"),
        "status": status,
        "created_at": F.col("ts"),
        "updated_at": F.col("ts"),
    }
    return rows.select(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in ALERT.fields])


ALERTS_SQL = f"""{BASE},
alerts AS (
  SELECT 'a' || CAST(event_id AS VARCHAR) AS alert_id,
         CASE WHEN event_id % 11 <> 0 THEN ip END AS source_ip,
         CASE event_type WHEN 'error' THEN 'critical' WHEN 'signup' THEN 'high' WHEN 'click' THEN 'medium'
              WHEN 'view' THEN 'low' ELSE 'info' END AS severity,
         CASE user_id % 5 WHEN 0 THEN 'T1110' WHEN 1 THEN 'T1190' WHEN 3 THEN 'T1110.999' WHEN 4 THEN 'T9999' END
           AS mitre_technique,
         CAST(k AS DOUBLE) AS score,
         CASE event_id % 4 WHEN 0 THEN 'open' WHEN 1 THEN 'acknowledged' WHEN 2 THEN 'resolved'
              ELSE 'false_positive' END AS status,
         ts AS created_at
  FROM base)"""

TECHNIQUES_SQL = """catalog(technique, name, tactic) AS (VALUES
  ('T1110', 'Brute Force', 'Credential Access'),
  ('T1190', 'Exploit Public-Facing Application', 'Initial Access'),
  ('T1498', 'Network Denial of Service', 'Impact'),
  ('T1046', 'Network Service Discovery', 'Discovery'))"""


def micros(name: str) -> Column:
    """Timestamps leave as epoch microseconds, the same number in every engine."""
    return F.unix_micros(name).alias(f"{name}_us")
