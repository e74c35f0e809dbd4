"""Stream jobs, run over the events table to the end of their input."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tripline.plans.ingest import Providers, analyze, sync_rules
from tripline.session import scratch_dir, state_session
from tripline.sources.store import Store
from tripline.streaming.microbatch import alert_feed, event_stream
from tripline.streaming.stateful import stateful_threshold
from tripline.workload.adapters import BASE, OPTIONS, security_events, security_sql
from tripline.workload.catalog import query
from tripline.workload.detection import _FAILED, FAILED_LOGINS, PORT_SPREAD, score_sql, threshold_sql
from tripline.workload.parsing import auth_line, lines


def _scratch(spark: SparkSession) -> str:
    return f"{scratch_dir(spark)}/tripline-stream-{uuid.uuid4().hex}"


class _Streaming:
    """Reads the events table as a file stream where a session is expected."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
        self.read = self
        self._reader = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet")
        self._folder = sf_dir

    def parquet(self, _path: str) -> DataFrame:
        return self._reader.parquet(self._folder)


def _stream_of_events(spark, sf_dir) -> DataFrame:
    return security_events(_Streaming(spark, sf_dir), sf_dir)


@query(
    "stream_detection",
    f"""WITH {security_sql()}, found AS ({threshold_sql(FAILED_LOGINS, _FAILED)} UNION ALL {threshold_sql(PORT_SPREAD, 'true')})
    SELECT rule_key, source_ip, title, status, least(100.0, round_even((CASE severity WHEN 'high' THEN 70.0 ELSE 50.0 END
      + score * 10.0) * 10, 0) / 10) AS score FROM (SELECT *, 'open' AS status FROM found)""",
)
def stream_detection(spark, sf_dir):
    """Events stream in, are stored, and raise alerts read back from the feed's table."""
    store = Store(spark, _scratch(spark))
    job = event_stream(
        _stream_of_events(spark, sf_dir),
        store,
        [FAILED_LOGINS, PORT_SPREAD],
        name="events",
        checkpoint=f"{store.root}/checkpoint",
        options=lambda: OPTIONS,
    )
    job.trigger(availableNow=True).start().awaitTermination()
    return store.read("alerts").select("rule_key", "source_ip", "title", "status", "score")


@query(
    "stream_alert_feed",
    f"""WITH {security_sql()}, found AS ({threshold_sql(FAILED_LOGINS, _FAILED)})
    SELECT severity, count(*) AS alerts FROM found GROUP BY severity""",
)
def stream_alert_feed(spark, sf_dir):
    """Alerts stored by one stream are delivered by another."""
    store = Store(spark, _scratch(spark))
    job = event_stream(
        _stream_of_events(spark, sf_dir), store, [FAILED_LOGINS], name="events", checkpoint=f"{store.root}/in", options=lambda: OPTIONS
    )
    job.trigger(availableNow=True).start().awaitTermination()
    out = f"{store.root}/delivered"
    sink = alert_feed(spark, store).writeStream.option("checkpointLocation", f"{store.root}/out").format("parquet")
    sink.option("path", out).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).groupBy("severity").agg(F.count(F.lit(1)).alias("alerts"))


def _stateful_sql(rule, condition: str, observed: str) -> str:
    return f"""WITH {security_sql()}, counted AS (
      SELECT s.source_ip AS group_key, epoch_us(w.window_end) AS window_end_us, {observed} AS observed
      FROM sec s JOIN (SELECT source_ip, max(ts) AS window_end FROM sec GROUP BY source_ip) w ON s.source_ip = w.source_ip
      WHERE s.ts >= w.window_end - INTERVAL {rule.window_seconds} SECOND AND {condition} GROUP BY 1, 2)
    SELECT '{rule.key}' AS rule_key, *, {score_sql('observed', rule.threshold)} AS score
    FROM counted WHERE observed >= {rule.threshold}"""


def _run_stateful(spark, sf_dir, rule) -> DataFrame:
    beside, out = state_session(spark), _scratch(spark)
    found = stateful_threshold(_stream_of_events(beside, sf_dir), rule)
    _finding_job(found, out).start().awaitTermination()
    return _found(spark, found, out)


def _finding_job(found: DataFrame, out: str) -> DataStreamWriter:
    job = found.writeStream.format("parquet").option("path", f"{out}/found").option("checkpointLocation", f"{out}/state")
    return job.trigger(availableNow=True)


def _found(spark, found: DataFrame, out: str) -> DataFrame:
    rows = spark.read.schema(found.schema).parquet(f"{out}/found")
    return rows.select("rule_key", "group_key", F.unix_micros("window_end").alias("window_end_us"), "observed", "score")


@query("stream_stateful_count", _stateful_sql(FAILED_LOGINS, _FAILED, "count(*)"))
def stream_stateful_count(spark, sf_dir):
    return _run_stateful(spark, sf_dir, FAILED_LOGINS)


@query("stream_stateful_distinct", _stateful_sql(PORT_SPREAD, "true", "count(DISTINCT s.dest_port)"))
def stream_stateful_distinct(spark, sf_dir):
    return _run_stateful(spark, sf_dir, PORT_SPREAD)


PARTS = 4
#: Which of the parts an event comes in: by its week, but some of the first week's come with the last part.
_PART = "CASE WHEN event_id % 10 = 3 AND ts < TIMESTAMP '2024-01-08' THEN 3 ELSE least((epoch_us(ts) - 1704067200000000) // 604800000000, 3) END"


def _part() -> Column:
    week = F.least(F.expr("(unix_micros(ts) - 1704067200000000) div 604800000000"), F.lit(PARTS - 1))
    late = (F.col("event_id") % 10 == 3) & (F.col("ts") < F.lit("2024-01-08").cast("timestamp"))
    return F.when(late, PARTS - 1).otherwise(week)


class _Arriving(_Streaming):
    """The same, part by part, each in as many files as Spark writes; a run of a job reads one part as one micro-batch."""

    def __init__(self, spark: SparkSession, sf_dir: str, part: Column):
        self.read = self
        self._events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
        self._part = part
        self._folder = _scratch(spark)
        self._reader = spark.readStream.schema(self._events.schema)
        self._events.limit(0).write.parquet(self._folder)

    def parts(self) -> Iterator[int]:
        for k in range(PARTS):
            self.arrive(self._events.where(self._part == k))
            yield k

    def arrive(self, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(self._folder)

    def closing(self) -> DataFrame:
        """One event of nobody, long after all others."""
        last = self._events.agg(F.max("ts").alias("ts"))
        fields = {"event_id": F.lit(-1), "ts": F.col("ts") + F.expr("INTERVAL 30 DAYS"), "event_type": F.lit("end"), "props": F.lit("{}")}
        return last.select(*[fields.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in self._events.schema])


#: For every key and part with events of it: the newest time so far, and what its window holds so far.
_SO_FAR = f"""arrived AS (SELECT s.*, part FROM sec s JOIN (SELECT CAST(event_id AS VARCHAR) AS event_id, {_PART} AS part FROM base)
      USING (event_id)),
    ends AS (SELECT k.source_ip, k.part, max(a.ts) AS window_end FROM (SELECT DISTINCT source_ip, part FROM arrived) k
      JOIN arrived a ON a.source_ip = k.source_ip AND a.part <= k.part GROUP BY 1, 2)"""


def _in_parts_sql(rule, condition: str, observed: str) -> str:
    return f"""WITH {security_sql()}, {_SO_FAR}, counted AS (
      SELECT e.source_ip AS group_key, e.part, epoch_us(e.window_end) AS window_end_us, {observed} AS observed
      FROM ends e JOIN arrived s ON s.source_ip = e.source_ip AND s.part <= e.part
      WHERE s.ts >= e.window_end - INTERVAL {rule.window_seconds} SECOND AND {condition} GROUP BY 1, 2, 3)
    SELECT '{rule.key}' AS rule_key, group_key, window_end_us, observed, {score_sql('observed', rule.threshold)} AS score
    FROM counted WHERE observed >= {rule.threshold}"""


def _stateful_in_parts(spark, sf_dir, rule) -> DataFrame:
    arriving, out = _Arriving(state_session(spark), sf_dir, _part()), _scratch(spark)
    found = stateful_threshold(security_events(arriving, sf_dir), rule)
    for _ in arriving.parts():
        _finding_job(found, out).start().awaitTermination()
    return _found(spark, found, out)


@query("stream_stateful_parts_count", _in_parts_sql(FAILED_LOGINS, _FAILED, "count(*)"))
def stream_stateful_parts_count(spark, sf_dir):
    """State that is read back in later micro-batches, late events among them."""
    return _stateful_in_parts(spark, sf_dir, FAILED_LOGINS)


@query("stream_stateful_parts_distinct", _in_parts_sql(PORT_SPREAD, "true", "count(DISTINCT s.dest_port)"))
def stream_stateful_parts_distinct(spark, sf_dir):
    return _stateful_in_parts(spark, sf_dir, PORT_SPREAD)


#: How much older than the newest of earlier parts an event may be.
LATE_BY = timedelta(days=5, hours=12)
#: Every event comes with its week, but one in ten a week later: some of them in time, the others too late.
_LATE_PART = "least((epoch_us(ts) - 1704067200000000) // 604800000000 + CAST(event_id % 10 = 4 AS INTEGER), 3)"


@query(
    "stream_stateful_watermark",
    f"""WITH {security_sql()},
    arrived AS (SELECT s.*, part FROM sec s
      JOIN (SELECT CAST(event_id AS VARCHAR) AS event_id, {_LATE_PART} AS part FROM base) USING (event_id)),
    newest AS (SELECT part, max(ts) AS ts FROM arrived GROUP BY 1),
    marks AS (SELECT p.part, max(epoch_ms(b.ts)) * 1000 - {LATE_BY // timedelta(microseconds=1)} AS oldest
      FROM newest p LEFT JOIN newest b ON b.part < p.part GROUP BY 1),
    inside AS (SELECT a.* FROM arrived a JOIN marks USING (part) WHERE oldest IS NULL OR epoch_us(ts) >= oldest),
    ends AS (SELECT k.source_ip, k.part, max(a.ts) AS window_end FROM (SELECT DISTINCT source_ip, part FROM inside) k
      JOIN inside a ON a.source_ip = k.source_ip AND a.part <= k.part GROUP BY 1, 2),
    counted AS (
      SELECT e.source_ip AS group_key, e.part, epoch_us(e.window_end) AS window_end_us, count(DISTINCT s.dest_port) AS observed
      FROM ends e JOIN inside s ON s.source_ip = e.source_ip AND s.part <= e.part
      WHERE s.ts >= e.window_end - INTERVAL {PORT_SPREAD.window_seconds} SECOND GROUP BY 1, 2, 3)
    SELECT '{PORT_SPREAD.key}' AS rule_key, group_key, window_end_us, observed, {score_sql('observed', PORT_SPREAD.threshold)} AS score,
      CAST(0 AS BIGINT) AS left_in_state FROM counted WHERE observed >= {PORT_SPREAD.threshold}""",
)
def stream_stateful_watermark(spark, sf_dir):
    """Late events within the watermark count, later ones don't, and no state is left when time has passed."""
    week = F.expr("(unix_micros(ts) - 1704067200000000) div 604800000000")
    part = F.least(week + (F.col("event_id") % 10 == 4).cast("int"), F.lit(PARTS - 1))
    arriving, out = _Arriving(state_session(spark), sf_dir, part), _scratch(spark)
    events = security_events(arriving, sf_dir)
    events = events.withColumn("source_ip", F.nullif("source_ip", F.lit("")))
    found = stateful_threshold(events, PORT_SPREAD, late_by=LATE_BY)
    for _ in arriving.parts():
        _finding_job(found, out).start().awaitTermination()
    arriving.arrive(arriving.closing())
    job = _finding_job(found, out).start()
    job.awaitTermination()
    left = sum(state.numRowsTotal for state in job.lastProgress.stateOperators)
    return _found(spark, found, out).withColumn("left_in_state", F.lit(left).cast("bigint"))


@query(
    "stream_detection_parts",
    f"""WITH {security_sql()}, {_SO_FAR}, counted AS (
      SELECT e.source_ip, e.part, e.window_end, count(*) AS observed FROM ends e
      JOIN arrived s ON s.source_ip = e.source_ip AND s.part <= e.part
      WHERE s.ts >= e.window_end - INTERVAL {FAILED_LOGINS.window_seconds} SECOND AND {_FAILED} GROUP BY 1, 2, 3),
    first AS (SELECT source_ip, arg_min(observed, part) AS observed
      FROM counted WHERE observed >= {FAILED_LOGINS.threshold} GROUP BY 1)
    SELECT source_ip, least(100.0, round_even((70.0 + {score_sql('observed', FAILED_LOGINS.threshold)} * 10.0) * 10, 0)
      / 10) AS score, (SELECT count(*) FROM events) AS stored FROM first""",
)
def stream_detection_parts(spark, sf_dir):
    """Several micro-batches over one store: an address raises one alert while its first is open."""
    store = Store(spark, _scratch(spark))
    arriving = _Arriving(spark, sf_dir, _part())
    job = event_stream(
        security_events(arriving, sf_dir), store, [FAILED_LOGINS], name="parts", checkpoint=f"{store.root}/in", options=lambda: OPTIONS
    ).trigger(availableNow=True)
    for _ in arriving.parts():
        job.start().awaitTermination()
    stored = store.read("events").agg(F.count(F.lit(1))).scalar()
    return store.read("alerts").select("source_ip", "score", stored.alias("stored"))


@query(
    "analyze_job",
    f"""WITH {BASE}, auth AS (
      SELECT ip AS source_ip, date_trunc('second', ts) AS ts, 'ssh' AS protocol, CASE event_type WHEN 'error' THEN 'failed'
        WHEN 'click' THEN 'accepted' ELSE 'invalid_user' END AS outcome
      FROM base WHERE event_type <> 'purchase' AND event_id % 50 <> 1),
    found AS ({threshold_sql(FAILED_LOGINS, _FAILED, source='auth')})
    SELECT rule_key, source_ip, severity, 'Brute Force' AS technique_name, 'auth_log' AS source_type,
      least(100.0, round_even((70.0 + score * 10.0) * 10, 0) / 10) AS score,
      (SELECT count(*) FROM base) AS received, (SELECT count(*) FROM auth) AS parsed FROM found""",
)
def analyze_job(spark, sf_dir):
    """Lines of an unnamed format in, events stored, alerts out."""
    store = Store(spark, _scratch(spark))
    sync_rules(store, [FAILED_LOGINS])
    logs = lines(spark, sf_dir, auth_line()).select("line")
    result, alerts = analyze(
        store, logs, [FAILED_LOGINS], batch="first", options=OPTIONS, source_name="upload", providers=Providers()
    )
    return alerts.select(
        "rule_key",
        "source_ip",
        "severity",
        "technique_name",
        F.lit(result.source_type).alias("source_type"),
        "score",
        F.lit(result.received).cast("bigint").alias("received"),
        F.lit(result.parsed).cast("bigint").alias("parsed"),
    )
