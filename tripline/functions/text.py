"""Text helpers: trimming, percent-decoding, address and integer checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode-aware classes with '.' excluding only '\n', which is how log patterns
# written for Python read.  JVM '\s' leaves out the C0 separators 1C-1F.
FLAGS = "(?Ud)"
SPACE = r"[\s\x1c-\x1f]"
NONSPACE = r"[^\s\x1c-\x1f]"

# Every character that counts as white space at a line's ends.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Characters beyond CR and LF that also end a line; the text reader keeps them.
EXTRA_LINE_BREAKS = "[\\x0b\\x0c\\x1c\\x1d\\x1e\\x85\\u2028\\u2029]"

# Never inside a line, because it is one of the line breaks above.
UNIT = "\x1e"


def strip(col: Column) -> Column:
    """Drop leading and trailing white space of any kind."""
    return F.btrim(col, F.lit(WHITE_SPACE))


def blank_to_null(col: Column) -> Column:
    return F.when(col != "", col)


def clean_ip(col: Column) -> Column:
    """Trimmed address text, null when nothing is left."""
    return blank_to_null(strip(col))


def url_decode(col: Column) -> Column:
    """Percent-decode only: '+' stays, a '%' without two hex digits stays."""
    guarded = F.regexp_replace(col, "%(?![0-9A-Fa-f]{2})", "%25")
    decoded = F.try_url_decode(F.replace(guarded, F.lit("+"), F.lit("%2B")))
    return F.when(F.contains(col, F.lit("%")), decoded).otherwise(col)


def is_ipv4(col: Column) -> Column:
    """Four dot-separated decimal parts, each 0..255 (leading zeros allowed)."""
    part = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
    return col.rlike(rf"\A(?=[0-9])(?:{part}(?:\.(?=[0-9])|\z)){{4}}\z")


def to_int(col: Column) -> Column:
    """Integer text to bigint; fractions, booleans and other text give null."""
    text = strip(col)
    return F.when(text.rlike(r"\A[+-]?[0-9]+(?:_[0-9]+)*\z"), F.replace(text, F.lit("_"), F.lit(""))).try_cast("bigint")


def capture(col: Column, pattern: str, groups: int) -> Column:
    """All groups of the first match of a whole-line ``pattern`` in one regex run.

    Gives an array whose element ``i`` is group ``i`` ('' when the group took no
    part), or a one-element array when the line does not match.  ``pattern``
    must consume the line from start to end.
    """
    template = "".join(f"{UNIT}${i}" for i in range(1, groups + 1))
    return F.split(F.regexp_replace(col, pattern, template), UNIT)


def captured(parts: Column) -> Column:
    return F.size(parts) > 1
