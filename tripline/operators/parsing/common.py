"""Pieces shared by the line parsers."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripline.schemas import PARSED, RAW


@dataclass(frozen=True)
class ParseOptions:
    """What a batch fixes once for all of its lines.

    ``ingest_time`` stamps lines that carry no time; ``year`` completes syslog
    times and defaults to the year of ``ingest_time``.
    """

    ingest_time: datetime | None = None
    year: int | None = None

    @property
    def stamp(self) -> Column:
        return F.lit(self._moment()).cast("timestamp")

    @property
    def syslog_year(self) -> Column:
        return F.lit(self.year if self.year is not None else self._moment().year)

    def _moment(self) -> datetime:
        moment = self.ingest_time
        if moment is None:
            raise ValueError("ParseOptions needs an ingest_time (or use ParseOptions.now())")
        return moment if moment.tzinfo else moment.replace(tzinfo=timezone.utc)

    @classmethod
    def now(cls, year: int | None = None) -> ParseOptions:
        return cls(datetime.now(timezone.utc), year)


def stage(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that later steps read as plain values.

    Going through a one-element generator keeps the optimizer from copying
    these (costly) expressions into every place that uses them.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def add_event(
    df: DataFrame,
    recognized: Column,
    ts: Column,
    source_ip: Column,
    protocol: Column,
    dest_ip: Column | None = None,
    **raw: Column,
) -> DataFrame:
    """Adds ``recognized`` and the parsed columns, null where not recognized."""
    fields = F.struct(*[raw.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in RAW.fields])
    values = {
        "ts": ts,
        "source_ip": source_ip,
        "dest_ip": F.lit(None) if dest_ip is None else dest_ip,
        "protocol": protocol,
        "raw": fields,
    }
    event = F.struct(
        F.lit(True).alias("recognized"), *[values[f.name].cast(f.dataType).alias(f.name) for f in PARSED.fields]
    )
    return df.select("*", F.inline_outer(F.when(recognized, F.array(event))))
