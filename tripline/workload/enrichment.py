"""Where addresses are, and what is known about them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tripline.operators.enrich import build_enrichment, locate, new_addresses
from tripline.workload.adapters import TEN, BASE, ENRICHMENT_SQL, OPTIONS, address, base, enrichment, security_events, security_sql, table
from tripline.workload.catalog import query


def networks(spark, sf_dir):
    """Nested blocks, one a part: a /8, a /16, a /24 while there are any, and single addresses."""
    n = F.col("p_partkey")
    wide = (n > 1) & (n % 5 != 2) & (n < 65_536)
    cidr = F.when(n == 0, "10.0.0.0/8").when(n == 1, "10.0.0.0/16").when(wide, F.concat(address(n * 256 + 77), F.lit("/24")))
    return table(spark, sf_dir, "part").select(
        cidr.otherwise(F.concat(address(n), F.lit("/32"))).alias("cidr"),
        F.concat(F.lit("Land "), F.col("p_brand")).alias("country"),
        F.col("p_name").alias("city"),
        n.cast("double").alias("latitude"),
        (-n.cast("double")).alias("longitude"),
    )


NETWORKS_SQL = f"""blocks AS (
      SELECT {TEN} + CASE WHEN p_partkey < 2 THEN 0 WHEN wide THEN p_partkey * 256 ELSE p_partkey END AS low,
             CASE WHEN p_partkey = 0 THEN 8 WHEN p_partkey = 1 THEN 16 WHEN wide THEN 24 ELSE 32 END AS bits,
             'Land ' || p_brand AS country, p_name AS city, CAST(p_partkey AS DOUBLE) AS latitude
      FROM (SELECT *, p_partkey % 5 <> 2 AND p_partkey < 65536 AS wide FROM part)),
    addresses AS (SELECT DISTINCT ip, {TEN} + user_id AS address FROM base),
    located AS (SELECT ip, arg_max(country, bits) AS country, arg_max(city, bits) AS city,
                       arg_max(latitude, bits) AS latitude, max(bits) AS bits
                FROM addresses JOIN blocks ON address >= low AND address < low + (CAST(1 AS BIGINT) << (32 - bits)) GROUP BY ip)"""


@query(
    "geo_cidr_join",
    f"""WITH {BASE}, {NETWORKS_SQL} SELECT ip, country, city, latitude, bits FROM located""",
)
def geo_cidr_join(spark, sf_dir):
    ips = base(spark, sf_dir).select("ip").distinct()
    bits = F.split("cidr", "/")[1].cast("int").alias("bits")
    return locate(ips, networks(spark, sf_dir)).select("ip", "country", "city", "latitude", bits)


def networks_v6(spark, sf_dir):
    """One block a part: a /32 around all, /45 over eight third groups, and /48."""
    n = F.col("p_partkey")
    wide = F.concat(F.lit("2001:DB8:"), F.hex(n % 8192 * 8), F.lit("::/45"))
    narrow = F.concat(F.lit("2001:db8:"), F.lower(F.hex(n)), F.lit(":0:0::/48"))
    cidr = F.when(n == 1, "2001:db8::/32").when((n % 8 == 3) & (n < 8192), wide).when((n % 8 != 3) & (n < 65_536), narrow)
    blocks = table(spark, sf_dir, "part").withColumn("cidr", cidr).where(F.col("cidr").isNotNull())
    return blocks.select(
        "cidr",
        F.concat(F.lit("Land "), F.col("p_brand")).alias("country"),
        F.col("p_name").alias("city"),
        n.cast("double").alias("latitude"),
        (-n.cast("double")).alias("longitude"),
    ).unionByName(networks(spark, sf_dir))


@query(
    "geo_cidr_join_v6",
    """WITH blocks AS (
      SELECT CASE WHEN p_partkey = 1 THEN 0 WHEN p_partkey % 8 = 3 THEN p_partkey * 8 ELSE p_partkey END AS low,
             CASE WHEN p_partkey = 1 THEN 32 WHEN p_partkey % 8 = 3 THEN 45 ELSE 48 END AS bits,
             'Land ' || p_brand AS country, p_name AS city, CAST(p_partkey AS DOUBLE) AS latitude
      FROM part WHERE p_partkey = 1 OR p_partkey < 8192 OR (p_partkey % 8 <> 3 AND p_partkey < 65536)),
    addresses AS (SELECT DISTINCT user_id % 65536 AS grp FROM events WHERE user_id >= 0)
    SELECT '2001:db8:' || lower(to_hex(grp)) || '::' || lower(to_hex(grp)) AS ip,
           arg_max(country, bits) AS country, arg_max(city, bits) AS city, arg_max(latitude, bits) AS latitude, max(bits) AS bits
    FROM addresses JOIN blocks ON grp >= low AND grp < low + (1 << (48 - bits)) GROUP BY 1""",
)
def geo_cidr_join_v6(spark, sf_dir):
    """IPv6 addresses of users among blocks of both families; those outside all blocks are left out."""
    group = F.lower(F.hex(F.col("user_id") % 65_536))
    ip = F.concat(F.lit("2001:db8:"), group, F.lit("::"), group).alias("ip")
    ips = table(spark, sf_dir, "events").where("user_id >= 0").select(ip).distinct()
    bits = F.split("cidr", "/")[1].cast("int").alias("bits")
    return locate(ips, networks_v6(spark, sf_dir)).where("cidr IS NOT NULL").select("ip", "country", "city", "latitude", bits)


@query(
    "enrichment_misses",
    f"""WITH {security_sql()}, {ENRICHMENT_SQL} SELECT DISTINCT dest_ip AS ip FROM sec UNION
    SELECT DISTINCT source_ip FROM sec WHERE source_ip NOT IN (SELECT ip FROM enr WHERE abuse_score > 50)""",
)
def enrichment_misses(spark, sf_dir):
    """Addresses of both ends that the cache does not hold."""
    events = security_events(spark, sf_dir)
    both = events.select("source_ip").unionByName(events.select(F.col("dest_ip").alias("source_ip")))
    return new_addresses(both, enrichment(spark, sf_dir).where(F.col("abuse_score") > 50))


@query(
    "enrichment_build",
    f"""WITH {BASE}, {NETWORKS_SQL}, {ENRICHMENT_SQL}
    SELECT a.ip, l.country, l.latitude, e.abuse_score, epoch_us(TIMESTAMP '2024-02-01') AS updated_at_us
    FROM addresses a LEFT JOIN located l ON a.ip = l.ip LEFT JOIN enr e ON a.ip = e.ip""",
)
def enrichment_build(spark, sf_dir):
    """Location and reputation of every address, starting from an empty cache."""
    known = enrichment(spark, sf_dir)
    built = build_enrichment(
        security_events(spark, sf_dir), known.where(F.lit(False)), networks(spark, sf_dir), known, now=OPTIONS.stamp
    )
    return built.select("ip", "country", "latitude", "abuse_score", F.unix_micros("updated_at").alias("updated_at_us"))
