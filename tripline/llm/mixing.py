"""Mixing sources to target weights by Sainte-Laguë apportionment (DataFrame functions only).

1. Sizes are words.  Sources share ``share`` times all words by weight; a target stops at
   ``cap`` times its source's size and the excess goes to the others by weight, until no
   target is above its cap.
2. A source's documents are dealt over shards by a seeded hash, about ``shard_words`` each.
   A shard's votes are its part of its source's target.  Blocks of ``block_words`` are
   allotted by highest quotients votes / (j - 1/2), down to one block's size: with that
   divisor, a shard gets the whole number nearest to votes / block_words.
3. In each shard, documents lie end to end in seeded order; it takes its quota of blocks
   from the beginning, and once more from the beginning after the last, so a document is
   taken whole, twice, not at all, or (at an end of the quota) in part.

Nulls: text has size 0, source is a source of its own (last), doc_id is ordered as an
empty id.  Repeated rows are rows of their own.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripline.session import materialize

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2
BLOCK_WORDS = 16
SHARD_WORDS = 2_000_000
SEED = "mix-1"


def words(text: Column) -> Column:
    """Words of a text: runs of anything but ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target from rows of source and size; one row a source."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(WEIGHTS)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), place + 1)
    sources = sources.withColumn("weight", weight)
    # In ascending order of cap/weight, sources stop at their caps until the rest can share what is left.
    ratio = F.col("source_size") / F.col("weight")
    before = Window.orderBy(ratio, F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    left = SHARE * F.sum("source_size").over(everything) - CAP * F.coalesce(
        F.sum("source_size").over(before), F.lit(0)
    )
    weights_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    level = F.max(F.when(left <= CAP * ratio * weights_left, left / weights_left)).over(everything)
    return (
        sources.withColumns({"left": left, "weights_left": weights_left})
        .withColumn("level", level)
        .select(
            "source",
            "source_size",
            F.least(F.col("weight") * F.col("level"), CAP * F.col("source_size").cast("double")).alias("target"),
        )
    )


def mix(docs: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, source, size, source_size, target and taken (words that the mix takes) of every row."""
    rows = materialize(
        docs.select(F.col(id_column).alias("doc_id"), F.col(source).alias("source"), words(F.col(text)).alias("size")),
        "mix-sizes",
    )
    shares = materialize(targets(rows), "mix-targets").withColumn(
        "shards", F.ceil(F.greatest(F.col("source_size"), F.lit(1)) / SHARD_WORDS)
    )
    key = F.md5(F.concat(F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    spread = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    rows = (
        rows.join(shares, rows.source.eqNullSafe(shares.source))
        .select("doc_id", rows.source, "size", "source_size", "target", "shards", key.alias("key"))
        .withColumn("shard", spread % F.col("shards"))
    )
    shard = Window.partitionBy("source", "shard")
    ahead = shard.orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({"shard_size": F.sum("size").over(shard), "end": F.sum("size").over(ahead)})
    votes = F.col("target") * F.col("shard_size") / F.greatest(F.col("source_size"), F.lit(1))
    quota = F.floor(votes / BLOCK_WORDS + 0.5) * BLOCK_WORDS
    start = F.col("end") - F.col("size")

    def within(limit: Column) -> Column:
        return F.greatest(F.least(limit - start, F.col("size")), F.lit(0))

    return rows.withColumn("quota", quota).select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        (within(F.col("quota")) + within(F.col("quota") - F.col("shard_size"))).cast("long").alias("taken"),
    )


def take(docs: DataFrame) -> DataFrame:
    """The mix itself: rows of ``docs`` (doc_id, text, source, n_chars, ...) as often as they are taken.

    A document taken in part gives its first words; one not taken is left out.
    Rows of one doc_id and source are taken as their sum; ``n_chars`` follows the text.
    """
    taken = (
        mix(docs)
        .groupBy("doc_id", "source")
        .agg(F.sum("taken").alias("taken"), F.count("*").alias("rows"))
        .where("taken > 0")
        .withColumnsRenamed({"doc_id": "taken_id", "source": "taken_source"})
    )
    # Columns go by number meanwhile, so none can clash with those made here.
    carried = {c: f"_in_{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select(*[F.col(f"`{c}`").alias(name) for c, name in carried.items()], words(F.col("text")).alias("size"))
    same = F.col(carried["doc_id"]).eqNullSafe(F.col("taken_id"))
    same &= F.col(carried["source"]).eqNullSafe(F.col("taken_source"))
    rows = rows.join(taken, same)
    wanted = F.ceil(F.col("taken") / F.col("rows")).cast("long")
    parts = F.transform(
        F.sequence(F.lit(0), F.lit(CAP - 1)),
        lambda k: F.greatest(F.least(wanted - k * F.col("size"), F.col("size")), F.lit(0)),
    )
    rows = rows.withColumn("part", F.explode(F.filter(parts, lambda n: n > 0)))
    # A possessive repetition needs no stack, however many words it takes.
    head = F.concat(F.lit(r"^(?:[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++){"), F.col("part").cast("string"), F.lit("}+"))
    text = F.col(carried["text"])
    text = F.when(F.col("part") < F.col("size"), F.call_function("regexp_extract", text, head, F.lit(0))).otherwise(text)
    made = {"text": text, "n_chars": F.length(text).cast("long")}
    return rows.select(*[made.get(c, F.col(carried[c])).alias(c) for c in docs.columns])


#: ``mix`` in SQL, where every source fits one shard.
SQL = rf"""
WITH rows AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                md5('{SEED}' || coalesce(doc_id::VARCHAR, '')) AS key FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size,
              [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight
            FROM rows GROUP BY source),
ordered AS (SELECT *, {SHARE} * sum(source_size) OVER () - {CAP} * coalesce(sum(source_size) OVER before, 0) AS rest,
              sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS weights_left
            FROM sources WINDOW before AS (ORDER BY source_size / weight, source NULLS LAST
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT max(rest::DOUBLE / weights_left) AS level FROM ordered
          WHERE rest <= {CAP} * (source_size / weight) * weights_left),
shares AS (SELECT source, source_size, least(weight * level, {CAP} * source_size::DOUBLE) AS target
           FROM sources, level),
laid AS (SELECT doc_id, rows.source, size, source_size, target, ceil(greatest(source_size, 1) / {SHARD_WORDS})::BIGINT AS shards,
           key, ('0x' || substr(key, 1, 8))::BIGINT AS spread FROM rows JOIN shares ON rows.source IS NOT DISTINCT FROM shares.source),
ends AS (SELECT *, sum(size) OVER (PARTITION BY source, spread % shards) AS shard_size,
           sum(size) OVER (PARTITION BY source, spread % shards ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto FROM laid),
quotas AS (SELECT *, floor(target * shard_size / greatest(source_size, 1) / {BLOCK_WORDS} + 0.5)::BIGINT * {BLOCK_WORDS} AS quota FROM ends)
SELECT doc_id, size, source_size, target,
  (greatest(least(quota - (upto - size), size), 0) + greatest(least(quota - shard_size - (upto - size), size), 0))::BIGINT AS taken
FROM quotas
"""
