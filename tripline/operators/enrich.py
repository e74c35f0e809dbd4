"""Geolocation and reputation of source addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripline.functions.addresses import cidr_prefix, hex_prefix, ipv4_to_long, ipv6_to_hex
from tripline.functions.text import blank_to_null
from tripline.operators.joins import lookup
from tripline.schemas import ENRICHMENT


def new_addresses(events: DataFrame, cache: DataFrame) -> DataFrame:
    """Distinct non-empty source addresses that are not in the cache yet."""
    ips = events.select(blank_to_null(F.col("source_ip")).alias("ip")).where(F.col("ip").isNotNull()).distinct()
    return ips.join(cache.select("ip"), "ip", "left_anti")


def locate(ips: DataFrame, networks: DataFrame) -> DataFrame:
    """Adds ``network`` and the location columns of the longest matching block.

    ``networks`` has ``cidr`` (unique IPv4 and IPv6 blocks), ``country``, ``city``,
    ``latitude`` and ``longitude``.  Each address is tried at the prefix lengths that occur in
    its family (33 or 129 at most), which turns the range join into an equi-join on the block.
    """
    blocks = networks.withColumns(
        {"block_bits": cidr_prefix(F.col("cidr")), "_digits": _hex_digits(F.split("cidr", "/")[0])}
    )
    blocks = blocks.withColumn("block", _block(F.col("_digits"), F.col("block_bits")))
    four = F.length("_digits") == 8
    lengths = blocks.agg(
        F.collect_set(F.when(four, F.col("block_bits"))).alias("four"),
        F.collect_set(F.when(~four, F.col("block_bits"))).alias("six"),
    ).first()
    tried = F.when(F.length("digits") == 8, _literal(lengths.four)).otherwise(_literal(lengths.six))
    tried = (
        ips.select("ip", _hex_digits(F.col("ip")).alias("digits"))
        .where(F.col("digits").isNotNull())
        .select("ip", "digits", F.explode(tried).alias("bits"))
        .select("ip", _block(F.col("digits"), F.col("bits")).alias("block"))
    )
    blocks = blocks.drop("_digits")
    found = lookup(tried, blocks, "block").where(F.col("cidr").isNotNull())
    best = found.groupBy("ip").agg(
        F.max_by(F.struct("cidr", "country", "city", "latitude", "longitude"), "block_bits").alias("hit")
    )
    return ips.join(best, "ip", "left").select(*[ips[c] for c in ips.columns], "hit.*")


def _hex_digits(ip: Column) -> Column:
    """8 hex digits of an IPv4 address, 32 of an IPv6 one, null for others."""
    return F.coalesce(F.lpad(F.lower(F.hex(ipv4_to_long(ip))), 8, "0"), ipv6_to_hex(ip))


def _block(digits: Column, bits: Column) -> Column:
    """A key of the block of ``bits`` bits that holds the address; families differ in their digits' number."""
    return F.concat_ws("/", F.length(digits).cast("string"), hex_prefix(digits, bits), bits.cast("string"))


def _literal(lengths: list[int]) -> Column:
    return F.array(*map(F.lit, sorted(lengths))).cast("array<int>")


def reputation(ips: DataFrame, feed: DataFrame) -> DataFrame:
    """Adds ``abuse_score`` from a feed with one row per ``ip``."""
    return ips.join(feed.select("ip", F.col("abuse_score").cast("int").alias("abuse_score")), "ip", "left")


def build_enrichment(
    events: DataFrame, cache: DataFrame, networks: DataFrame | None = None, feed: DataFrame | None = None, *, now
) -> DataFrame:
    """Rows to append to the enrichment cache for addresses seen for the first
    time; nothing when neither provider table is given.  Addresses that no
    provider knows are cached too, so that they are tried only once."""
    rows = new_addresses(events, cache)
    if networks is None and feed is None:
        return rows.sparkSession.createDataFrame([], ENRICHMENT)
    if networks is not None:
        rows = locate(rows, networks).drop("cidr")
    if feed is not None:
        rows = reputation(rows, feed)
    known = set(rows.columns)
    return rows.select(
        "ip",
        *[
            (F.col(f.name) if f.name in known else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in ENRICHMENT.fields[1:6]
        ],
        F.lit(False).alias("is_tor"),
        (now if isinstance(now, Column) else F.lit(now)).cast("timestamp").alias("updated_at"),
    )


def newest_enrichment(enrichment: DataFrame) -> DataFrame:
    """One row an address, the newest: two jobs may both have added it."""
    columns = enrichment.columns
    newest = enrichment.groupBy("ip").agg(F.max(F.struct("updated_at", *[c for c in columns if c not in ("ip", "updated_at")])).alias("row"))
    return newest.select("ip", "row.*").select(*columns)
