"""Choosing the parser, and turning parsed lines into stored events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripline.operators.parsing.access import parse_access
from tripline.operators.parsing.auth import parse_auth
from tripline.operators.parsing.common import ParseOptions
from tripline.operators.parsing.eve import parse_eve
from tripline.operators.parsing.generic import parse_generic
from tripline.schemas import EVENT, PARSED, REJECT

# A parser adds ``recognized`` and the parsed columns (null when the line is not
# its own), computed from a text column; that column may be null.
Parser = Callable[[DataFrame, Column, ParseOptions], DataFrame]

_PARSERS: dict[str, Parser] = {
    "auth_log": parse_auth,
    "nginx": parse_access,
    "apache": parse_access,
    "suricata": parse_eve,
    "custom": parse_generic,
}


def register_format(name: str, parser: Parser) -> None:
    """Adds a log format, or replaces one."""
    _PARSERS[name] = parser


def supported_formats() -> list[str]:
    return sorted(_PARSERS)


def parse_lines(lines: DataFrame, source_type: str, options: ParseOptions) -> DataFrame:
    """Adds ``recognized``, the parsed columns and ``reject_reason``.

    ``recognized`` is null for lines that are not of the format.  A recognized
    line whose time cannot be read gets a reason, and does not affect others.
    """
    return _with_rejects(_parser(source_type)(lines, F.col("line"), options))


def parse_mixed(lines: DataFrame, options: ParseOptions) -> DataFrame:
    """Like :func:`parse_lines`, each line by its own ``source_type`` column.

    One pass: a parser sees null instead of other formats' lines.
    """
    names = ["recognized", *PARSED.fieldNames()]
    parsers = list(dict.fromkeys(_PARSERS.values()))
    for i, parser in enumerate(parsers):
        formats = [name for name, candidate in _PARSERS.items() if candidate is parser]
        own = F.when(F.col("source_type").isin(*formats), F.col("line"))
        lines = parser(lines, own, options).withColumnsRenamed({name: f"_{name}{i}" for name in names})
    merged = {name: F.coalesce(*[F.col(f"_{name}{i}") for i in range(len(parsers))]) for name in names}
    spent = [f"_{name}{i}" for name in names for i in range(len(parsers))]
    return _with_rejects(lines.withColumns(merged).drop(*spent))


def to_events(
    parsed: DataFrame, options: ParseOptions, *, batch: str = "", event_id: Column | None = None, source_id=None
) -> DataFrame:
    """The event table rows of parsed lines, rejected and skipped ones left out.

    Identical lines are different events, so an id names the batch and the
    line's place in it unless ``event_id`` is given.  Places follow the input
    split, so write the result before using it twice.
    """
    if event_id is None:
        event_id = F.concat(F.lit(f"{batch}-"), F.lower(F.hex(F.monotonically_increasing_id())))
    return (
        parsed.where(accepted())
        .withColumns(
            {
                "event_id": event_id,
                "source_id": source_id if isinstance(source_id, Column) else F.lit(source_id),
                "ingest_ts": options.stamp,
                "event_date": F.to_date("ts"),
            }
        )
        .select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in EVENT.fields])
    )


def sort_out(
    parsed: DataFrame, options: ParseOptions, *, batch: str, source_id: Column, source_type: Column
) -> DataFrame:
    """The rows of the event table, and those of the rejects table with a ``reason``, in one pass.

    Lines that are not of their format are in neither.  Event columns of rejects are null, and the reverse.
    """
    refused = F.coalesce(F.col("recognized"), F.lit(False)) & F.col("reject_reason").isNotNull()
    event_id = F.concat(F.lit(f"{batch}-"), F.lower(F.hex(F.monotonically_increasing_id())))
    columns = {
        **{f.name: F.when(~refused, F.col(f.name)) for f in PARSED.fields},
        "event_id": F.when(~refused, event_id),
        "line": F.when(refused, F.col("line")),
        "reason": F.col("reject_reason"),
        "source_type": F.when(refused, source_type),
        "source_id": source_id,
        "ingest_ts": options.stamp,
        "event_date": F.to_date(F.when(refused, options.stamp).otherwise(F.col("ts"))),
    }
    fields = {f.name: f for f in [*EVENT.fields, *REJECT.fields]}
    kept = parsed.where(accepted() | refused).select(*[c.alias(name) for name, c in columns.items()])
    return kept.select(*[F.col(name).cast(f.dataType).alias(name) for name, f in fields.items()])


def accepted() -> Column:
    """Holds for parsed lines that become events."""
    return F.coalesce(F.col("recognized"), F.lit(False)) & F.col("reject_reason").isNull()


def _parser(source_type: str) -> Parser:
    if source_type not in _PARSERS:
        raise ValueError(f"no parser for source type {source_type!r}; supported: {', '.join(supported_formats())}")
    return _PARSERS[source_type]


def _with_rejects(parsed: DataFrame) -> DataFrame:
    timeless = F.col("recognized") & F.col("ts").isNull()
    return parsed.withColumn("reject_reason", F.when(timeless, F.lit("unreadable timestamp")))
