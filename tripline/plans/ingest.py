"""From raw lines to stored events and new alerts."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tripline.operators.alerts import alert_view, findings_to_alerts, subject, with_current_status
from tripline.operators.enrich import build_enrichment, newest_enrichment
from tripline.operators.joins import lookup
from tripline.operators.parsing import ParseOptions, accepted, parse_lines, parse_mixed, sort_out
from tripline.operators.parsing.sniff import HEAD, sniff_groups, sniff_paths
from tripline.operators.threshold import newest_times, window_dates
from tripline.plans.detection import anomaly_scan, detect
from tripline.rules.model import Rule, ThresholdRule
from tripline.schemas import ALERT, FINDING
from tripline.session import materialize
from tripline.sources.lines import read_lines
from tripline.sources.registry import new_sources, source_id
from tripline.sources.rule_table import change_counts, rule_rows, upsert_rules
from tripline.sources.store import Store, buckets


MIXED = "mixed"


@dataclass(frozen=True)
class IngestResult:
    source_type: str
    source_id: int | None
    received: int
    parsed: int
    skipped: int
    rejected: int
    alerts: int


@dataclass(frozen=True)
class Providers:
    """Lookup tables for new addresses; without any, nothing is enriched."""

    networks: DataFrame | None = None
    reputation: DataFrame | None = None


def sync_rules(store: Store, rules: Iterable[Rule]) -> tuple[int, int]:
    """Writes the rules into the rule table; returns (created, updated)."""
    merged = upsert_rules(store.read("rules"), rule_rows(store.spark, list(rules)))
    created, updated = change_counts(merged).first()
    store.replace("rules", merged)
    return created, updated


def ingest(
    store: Store,
    lines: DataFrame,
    source_type: str,
    rules: Iterable[Rule],
    *,
    batch: str,
    options: ParseOptions,
    source_name: str | None = None,
    providers: Providers = Providers(),
) -> IngestResult:
    """Parses ``line``s, stores the events, enriches their addresses, runs the
    rules and stores new alerts.  ``batch`` names this unit of work; running
    the same batch again replaces its own output and nothing else.  Without
    ``source_name``, lines read from files have their file's name as source.

    ``source_type`` may be "mixed" for lines with a ``source_type`` of their own."""
    by_file = source_name is None and "file_name" in lines.columns
    mixed = source_type == MIXED
    if by_file:
        kind = F.col("source_type") if mixed else F.lit(source_type)
        # Kept, as it is needed twice: the lines are read once for it, and once to be parsed.
        named = materialize(lines.groupBy(F.col("file_name").alias("name")).agg(F.min(kind).alias("type")), "sources")
    else:
        named = store.spark.createDataFrame([(source_name, source_type)], "name string, type string")
    store.write_batch("log_sources", new_sources(named, store.read("log_sources", before_batch=batch)), batch)

    # Counted while the events are written, not in a pass of its own.
    seen = Observation("lines")
    is_event = accepted()
    parsed = (parse_mixed(lines, options) if mixed else parse_lines(lines, source_type, options)).observe(
        seen,
        F.count(F.lit(1)).alias("received"),
        F.count_if(is_event).alias("parsed"),
        F.count_if(F.col("reject_reason").isNotNull()).alias("rejected"),
    )
    own_source = source_id(F.col("file_name") if by_file else F.lit(source_name).cast("string"))
    store_parsed(store, parsed, options, batch=batch, source_id=own_source, source_type=F.col("source_type") if mixed else F.lit(source_type))
    counts = seen.get

    alerts = process_batch(store, rules, batch=batch, options=options, providers=providers)
    # Several files are several sources: then there is no single number.
    numbers = named.select(source_id(F.col("name"))).distinct().take(2)
    number = numbers[0][0] if len(numbers) == 1 else None
    return IngestResult(
        source_type=source_type,
        source_id=number,
        received=counts["received"],
        parsed=counts["parsed"],
        skipped=counts["received"] - counts["parsed"],
        rejected=counts["rejected"],
        alerts=alerts.count(),
    )


def store_parsed(
    store: Store, parsed: DataFrame, options: ParseOptions, *, batch: str, source_id: Column, source_type: Column
) -> None:
    """Stores parsed lines in one pass: events, and rejected lines with their reason."""
    rows = sort_out(parsed, options, batch=batch, source_id=source_id, source_type=source_type)
    refused = F.col("reason").isNotNull()
    store.write_split(rows, {"events": ~refused, "rejects": refused}, batch)


def analyze(
    store: Store,
    lines: DataFrame,
    rules: Iterable[Rule],
    *,
    batch: str,
    options: ParseOptions,
    source_type: str | None = None,
    source_name: str | None = None,
    providers: Providers = Providers(),
) -> tuple[IngestResult, DataFrame]:
    """Like :func:`ingest`, guessing the format when none is given (one format
    for the whole input), and also returns the new alerts as a view."""
    if source_type is None:
        source_type = guess_format(lines) or "custom"
    result = ingest(
        store,
        lines,
        source_type,
        rules,
        batch=batch,
        options=options,
        source_name=source_name,
        providers=providers,
    )
    alerts = store.read_batch("alerts", batch)
    return result, alert_view(alerts, _enrichment(store, alerts))


def guess_format(lines: DataFrame) -> str | None:
    """The format the first 25 lines give away; reads no further."""
    head = [(0, place, row.line) for place, row in enumerate(lines.select("line").take(HEAD))]
    spark = lines.sparkSession
    first = sniff_groups(spark.createDataFrame(head, "input int, place int, line string"), "input", "place").first()
    return first.source_type if first else None


def read_any(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Lines of files of several formats with each file's guessed
    ``source_type`` (custom when nothing is told), ready for ``parse_mixed``."""
    told = sniff_paths(spark, paths)
    return lookup(read_lines(spark, paths), told, "file_path").fillna("custom", ["source_type"])


def process_batch(
    store: Store,
    rules: Iterable[Rule],
    *,
    batch: str,
    options: ParseOptions,
    providers: Providers = Providers(),
) -> DataFrame:
    """Enriches and runs detection over a batch whose events are stored; returns
    the new alerts, stored too."""
    rules = list(rules)
    events = store.read_batch("events", batch)
    if events.isEmpty():
        store.write_batch("alerts", store.spark.createDataFrame([], ALERT), batch)
        return store.read_batch("alerts", batch)
    cached = store.read("enrichment", before_batch=batch, buckets=buckets(events, F.col("source_ip")))
    fresh = build_enrichment(events, cached, providers.networks, providers.reputation, now=options.stamp)
    store.write_batch("enrichment", fresh, batch)
    return _raise(store, detect(_history(store, events, rules, batch), rules, events), batch, options.stamp)


def run_anomaly_scan(
    store: Store, window_seconds: int = 300, *, batch: str, options: ParseOptions
) -> DataFrame:
    """Runs the population detectors over the newest stored window; returns the
    new alerts, stored under ``batch``.  Only the window's dates are read."""
    newest = newest_date(store)
    if newest is None:
        findings = store.spark.createDataFrame([], FINDING)
    else:
        # The newest event is of the newest date, and its window reaches back less than two dates more.
        recent = store.read("events", since=newest - timedelta(seconds=window_seconds + 86_400))
        findings = anomaly_scan(recent, window_seconds)
    return _raise(store, findings, batch, options.stamp)


def newest_date(store: Store) -> date | None:
    """The newest date of stored events; dates are tried from the newest folder on, which may hold none."""
    for day in store.dates("events"):
        if not store.read("events", dates=[day]).isEmpty():
            return day
    return None


def _raise(store: Store, findings: DataFrame, batch: str, moment) -> DataFrame:
    """Stores alerts for those findings that have none yet, and returns them."""
    findings = materialize(findings, "findings")
    # Only alerts about the findings' own rules and subjects can suppress them: their buckets are read, no others.
    about = findings.select("rule_key", subject().alias("_subject")).distinct()
    near = buckets(findings, F.col("rule_key"), subject())
    known = store.read("alerts", before_batch=batch, buckets=near).withColumn("_subject", subject())
    known = known.join(about, ["rule_key", "_subject"], "left_semi").drop("_subject").select(*ALERT.fieldNames())
    known = materialize(known, "known-alerts")
    triage = store.read("status_log", buckets=buckets(known, F.col("alert_id")))
    alerts = findings_to_alerts(
        findings,
        store.read("rules"),
        _enrichment(store, findings),
        with_current_status(known, triage),
        created_at=moment,
    )
    store.write_batch("alerts", alerts, batch)
    return store.read_batch("alerts", batch)


def _enrichment(store: Store, rows: DataFrame) -> DataFrame:
    """What is known of the addresses of ``rows``, one row each; of other addresses perhaps, too."""
    return newest_enrichment(store.read("enrichment", buckets=buckets(rows, F.col("source_ip"))))


def _history(store: Store, events: DataFrame, rules: list[Rule], batch: str) -> DataFrame:
    """Stored events that can still matter to the batch's windows, and notes the batch's newest times.

    A key's window ends at its newest event, stored or of the batch.  The newest times are kept
    by key, so only the dates of those windows are read: a line of last year reads that day of
    last year, and only if nothing newer of its key is known.
    """
    counting = [rule for rule in rules if rule.enabled and isinstance(rule, ThresholdRule)]
    if not counting:
        return events
    fields = sorted({rule.group_by for rule in counting})
    keep_newest(store, fields, before_batch=batch)
    store.write_batch("newest", newest_times(events, fields), batch)
    own = store.read_batch("newest", batch)
    key = ["key_field", "group_key"]
    stored = store.read("newest", buckets=buckets(own, *map(F.col, key))).join(own.select(*key), key, "left_semi")
    ends = stored.groupBy(*key).agg(F.max("newest").alias("newest"))
    days = window_dates(ends, max(rule.window_seconds for rule in counting)).collect()
    return store.read("events", dates=[r.day for r in days]) if days else events


def keep_newest(store: Store, fields: list[str], before_batch: str | None = None) -> None:
    """From now on the newest time of each value of ``fields`` is kept; what is stored already is read once.

    Batches that ``process_batch`` did not see are known only if they were stored before that.
    """
    for field in fields:
        if not store.has_batch("newest", f"all.{field}"):
            past = newest_times(store.read("events", before_batch=before_batch), [field])
            store.write_batch("newest", past, f"all.{field}")
