"""IPv4 arithmetic on bigint columns, IPv6 on strings of 32 hex digits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tripline.functions.text import is_ipv4


def ipv4_to_long(ip: Column) -> Column:
    """Address as a number, null when it is not a valid IPv4 address."""
    part = F.split(ip, r"\.")
    weighted = [part[i].cast("bigint") * (1 << (8 * (3 - i))) for i in range(4)]
    return F.when(is_ipv4(ip), weighted[0] + weighted[1] + weighted[2] + weighted[3])


def cidr_prefix(cidr: Column) -> Column:
    return F.split(cidr, "/")[1].cast("int")


_DOTTED_END = r"^(.*:)([0-9]+\.[0-9]+\.[0-9]+\.[0-9]+)$"


def ipv6_to_hex(ip: Column) -> Column:
    """Address as 32 hex digits, null when it is not a valid IPv6 address (its last two groups may be dotted)."""
    dotted = F.regexp_extract(ip, _DOTTED_END, 2)
    end = F.lpad(F.lower(F.hex(ipv4_to_long(dotted))), 8, "0")
    groups = F.concat(
        F.regexp_extract(ip, _DOTTED_END, 1), F.substring(end, 1, 4), F.lit(":"), F.substring(end, 5, 4)
    )
    halves = F.split(F.lower(F.when(dotted != "", groups).otherwise(ip)), "::", -1)
    none = F.array().cast("array<string>")

    def half(i: int) -> Column:
        part = F.get(halves, i)
        return F.when(F.coalesce(part, F.lit("")) == "", none).otherwise(F.split(part, ":", -1))

    missing = F.lit(8) - F.size(half(0)) - F.size(half(1))
    whole = F.concat(half(0), F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), half(1))
    counted = F.when(F.size(halves) == 1, missing == 0).otherwise((F.size(halves) == 2) & (missing >= 1))
    good = counted & F.forall(whole, lambda g: g.rlike("^[0-9a-f]{1,4}$"))
    return F.when(good, F.array_join(F.transform(whole, lambda g: F.lpad(g, 4, "0")), ""))


def hex_prefix(digits: Column, bits: Column) -> Column:
    """The first ``bits`` bits of a string of hex digits; a digit that is cut has its lower bits cleared."""
    whole, rest = F.floor(bits / 4).cast("int"), bits % 4
    cut = F.conv(F.substring(digits, whole + 1, F.lit(1)), 16, 10).cast("int")
    cleared = cut - cut % F.pow(F.lit(2), F.lit(4) - rest).cast("int")
    last = F.when(rest > 0, F.lower(F.hex(cleared))).otherwise("")
    return F.concat(F.substring(digits, F.lit(1), whole), last)
