"""Timestamp parsing.  Offsets are honoured; a missing offset means UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tripline.functions.text import FLAGS, SPACE, strip

_OFFSET = r"(?:[+-][0-9]{2}:?[0-9]{2}(?::?[0-9]{2})?|Z)"
_USUAL = rf"\A[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}[T ][0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}(?:\.[0-9]+)?{_OFFSET}?\z"
# Any separator before the clock, compact forms, minutes and seconds optional.
_ANY = (
    r"\A\?([0-9]{4})-?([0-9]{2})-?([0-9]{2})"
    rf"(?:.([0-9]{{2}})(?::?([0-9]{{2}})(?::?([0-9]{{2}})(?:[.,]([0-9]+))?)?)?({_OFFSET}?))?\z"
)


def iso8601(col: Column) -> Column:
    """ISO-8601 text with ``Z``, ``+00:00``, ``+0000`` or no offset, else null."""
    # The mark stays on text that is no timestamp, and then the cast fails.
    text = F.regexp_replace(F.concat(F.lit("?"), strip(col)), _ANY, "$1-$2-$3T$4:$5:$6.$7$8")
    for missing, default in ((r"T::\.\z", "T00:00:00"), (r"::\.", ":00:00"), (r":\.", ":00."), (r"\.(?![0-9])", "")):
        text = F.regexp_replace(text, missing, default)
    return F.when(col.rlike(_USUAL), col.try_cast("timestamp")).otherwise(text.try_cast("timestamp"))


def ncsa(col: Column) -> Column:
    """``10/Oct/2024:13:55:36 +0000``, else null."""
    offset = F.regexp_replace(
        F.regexp_replace(col, f"{FLAGS}{SPACE}*([+-])([0-9]{{2}}):?([0-9]{{2}})\\z", " $1$2$3"),
        r"\s*Z\z",
        " +0000",
    )
    layout = F.lit("d/MMM/yyyy:H:m:s Z")
    return F.coalesce(F.try_to_timestamp(col, layout), F.try_to_timestamp(offset, layout))


def syslog(col: Column, year: Column) -> Column:
    """``Oct  1 13:55:36`` in the given year, else null."""
    compact = F.regexp_replace(col, f"{FLAGS}{SPACE}+", " ")
    return F.try_to_timestamp(F.concat_ws(" ", year.cast("string"), compact), F.lit("yyyy MMM d H:m:s"))


def epoch(col: Column) -> Column:
    """Epoch seconds, or milliseconds when the number exceeds 1e12."""
    seconds = F.when(col > 1e12, col / 1000.0).otherwise(col)
    # Beyond year 9999 (or NaN) no calendar time exists.
    in_range = seconds.between(-62135596800.0, 253402300799.0)
    return F.when(in_range, F.timestamp_micros(F.rint(seconds * 1000000.0).cast("bigint")))
