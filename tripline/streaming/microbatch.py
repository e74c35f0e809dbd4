"""Detection on a stream, one micro-batch at a time.

A micro-batch's events are stored first, then the rules run over them with
the stored history, exactly as for a batch job.  Windows end at the data's own
newest time, so a late event counts where it belongs and moves nothing.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tripline.operators.parsing import ParseOptions, parse_lines
from tripline.plans.ingest import Providers, process_batch, store_parsed
from tripline.rules.model import Rule
from tripline.schemas import ALERT
from tripline.sources.lines import to_lines
from tripline.sources.registry import new_sources, source_id
from tripline.sources.store import Store


def line_stream(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """New text files of a folder, as lines."""
    return to_lines(spark.readStream.options(**options).text(path), "value")


def detect_stream(
    lines: DataFrame,
    store: Store,
    source_type: str,
    rules: Iterable[Rule],
    *,
    name: str,
    checkpoint: str,
    options: Callable[[], ParseOptions] = ParseOptions.now,
    providers: Providers = Providers(),
) -> DataStreamWriter:
    """A writer (call ``start()``) that stores events and alerts per micro-batch.

    ``name`` registers the stream as a source.  A micro-batch that is run again
    after a failure overwrites its own folder and ignores its own earlier
    alerts, so nothing is stored or raised twice.  Another stream, or a new
    checkpoint, never writes over what is there.
    """
    rules = list(rules)

    def handle(batch_lines: DataFrame, batch_id: int) -> None:
        batch, moment = batch_name(batch_lines.sparkSession, name, batch_id), options()
        named = store.spark.createDataFrame([(name, source_type)], "name string, type string")
        store.write_batch("log_sources", new_sources(named, store.read("log_sources", before_batch=batch)), batch)
        parsed = parse_lines(batch_lines, source_type, moment)
        store_parsed(store, parsed, moment, batch=batch, source_id=source_id(F.lit(name)), source_type=F.lit(source_type))
        process_batch(store, rules, batch=batch, options=moment, providers=providers)

    return lines.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)


def event_stream(
    events: DataFrame,
    store: Store,
    rules: Iterable[Rule],
    *,
    name: str,
    checkpoint: str,
    options: Callable[[], ParseOptions] = ParseOptions.now,
    providers: Providers = Providers(),
) -> DataStreamWriter:
    """Like :func:`detect_stream` for a stream that already has event columns."""
    rules = list(rules)

    def handle(batch_events: DataFrame, batch_id: int) -> None:
        batch = batch_name(batch_events.sparkSession, name, batch_id)
        store.write_batch("events", batch_events, batch)
        process_batch(store, rules, batch=batch, options=options(), providers=providers)

    return events.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)


def batch_name(spark: SparkSession, name: str, batch_id: int) -> str:
    """Stream name, identity of the checkpoint's query, and number of the micro-batch."""
    if not re.fullmatch(r"[A-Za-z0-9_-]+", name):
        raise ValueError(f"a stream's name is letters, digits, '_' and '-', got {name!r}")
    query = spark.sparkContext.getLocalProperty("sql.streaming.queryId")
    if not query:
        raise RuntimeError("a micro-batch is named by its streaming query, and there is none")
    return f"{name}.{query}.{batch_id:010d}"


def alert_feed(spark: SparkSession, store: Store) -> DataFrame:
    """New alerts, as a stream over the append-only alert table."""
    return spark.readStream.schema(ALERT).option("recursiveFileLookup", "true").parquet(store.watch("alerts"))
