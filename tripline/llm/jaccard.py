"""An exact Jaccard join of documents' word runs as a metric-space join.

A document is the set of its runs of five words (ASCII letters lowered), as 64-bit hashes;
a shorter text is one run.  Documents of equal sets are one class, which goes on alone.
1 - |intersection| / |union| is a metric, and two sets link if it is at most r = 1 -
``percent`` / 100.

* Blocks: sets that link share many of the runs that come first by hash.  A set's head is
  its first |set| - ceil(percent% of |set|) + extra runs; linked sets share at least extra - 1
  (and one) runs of their heads.  Sets with fewer head runs that any other set has are alone
  and leave: most of them by a shorter head, whose runs are shuffled once, the others
  ``PEELS`` times, as counts fall when others leave.  Of the runs left, the extra
  - 2 that most sets hold are dropped: a pair still shares one.  A block is what such runs
  connect, so no pair is lost between blocks.  Most blocks are a few copies of one text.
* Regions: a block of over ``REGION`` sets (or ``REGION_RUNS`` runs) is split by ``PIVOTS`` of
  its sets.  Every set of the block measures its distance to all pivots, exactly; its region
  is that of the nearest one (a Voronoi cell).  Half of the pivots are those whose runs most
  sets hold, so copies of one text join through its middle even if they are not near one
  another.  A set visits another region if, for each pivot, its distance lies within r of the
  distances there: by the triangle inequality it links with no set of any region that it
  doesn't visit.  Regions that are still large split again by pivots of their own; one that
  its parent's pivots did not halve, or that is only a little too large, is cut by hash.
* Join: a region's sets are indexed in one task, and compared with one another and with
  its visitors, which are dealt over several tasks if they are many.

Sets in one component already are not compared again: links with pivots come first, and sets
of a region's largest component visit nothing, as the others visit them.  So a group of
thousands of alike copies costs one round, and what is counted is linked components, not
links.  The result equals that of all pairs, but for different runs with equal 64-bit
hashes (two of one comparison: about 1e-12).

Null and empty texts (no words) have no set and are linked with nothing; they and rows
without doc_id are kept.  Rows that repeat a doc_id and text are one document; a doc_id with
several texts is linked by each of them.  An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripline.llm.arrow import slices, small_batches, text_bytes
from tripline.llm.components import connected
from tripline.llm.neardup import class_key, sets
from tripline.operators.joins import HOT_SHARE, SALTS, at_most, join_per_key
from tripline.session import materialize

PEELS = 2
#: Sets whose runs are no more than about this are all head; larger ones have so many runs, or a tenth, above the least.
EXTRA = 64
#: As ``EXTRA``, for the heads that tell apart most sets.
FIRST_EXTRA = 16
#: Of so many sets one is asked which runs are hot; a hot run is in over 1/HOT_SHARE of the sets asked, and in HOT_LEAST.
ASKED = 64
HOT_LEAST = 8
#: Keys of sets that a task remembers, so that it gives the head of copies once.
REMEMBERED = 200_000
PIVOTS = 32
REGION = 1_024
REGION_RUNS = 2_000_000
#: A region that is only so many times too large is cut by hash at once.
FEW = 4
#: Visitors of a region that one task compares, and sets of a block that one task measures.
VISITORS = 1_024
MEASURED = 2_048
#: Tables of counted size go to every task up to so many rows.
SMALL_ROWS = 200_000
SLICE_BYTES = 1 << 20
_ROUNDING = 1e-9


def _least_shared(n, percent: int):
    """The runs that a set of ``n`` shares at least with one that it links with."""
    return -(-n * percent // 100)


def head_length(n: int, percent: int) -> int:
    least = _least_shared(n, percent)
    return n - least + max(n // 10, min(least, EXTRA))


def _need(percent: int) -> Column:
    """The head runs that linked sets share at least, from the size n of either."""
    extra = F.greatest(F.expr("n div 10"), F.least(F.expr(f"(n * {percent} + 99) div 100"), F.lit(EXTRA)))
    return F.greatest(F.lit(1), extra - 1).cast("int")


def sketch(docs: DataFrame, percent: int) -> DataFrame:
    """doc_id, n, cls (of the set; null if empty), head (its first runs by hash) of every row.

    Of the equal sets of a task one at least has its head; rows without doc_id have none.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                found = sets(*text_bytes(part["text"]))
                keys = [class_key(s) if len(s) else None for s in found]
                heads = []
                for doc_id, key, own in zip(part["doc_id"].to_pylist(), keys, found, strict=True):
                    new = key is not None and doc_id is not None and key not in seen
                    heads.append(own[: head_length(len(own), percent)].view(np.int64) if new else None)
                    if new:
                        if len(seen) >= REMEMBERED:
                            seen.clear()
                        seen.add(key)
                yield pa.RecordBatch.from_arrays(
                    [
                        part["doc_id"],
                        pa.array([len(s) for s in found], pa.int64()),
                        pa.array(keys, pa.binary()),
                        pa.array(heads, pa.list_(pa.int64())),
                    ],
                    ["doc_id", "n", "cls", "head"],
                )

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, n long, cls binary, head array<long>")


def _first_told(heads: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The rows of ``classes`` (id, n, ...) that may link, by the first runs of ``heads`` (id, n, head).

    A linked set shares as many of them as ``extra`` with another one.  Runs meet by one shuffle: those that no
    other set has leave there.  Runs that a sample finds in very many sets are dealt over several tasks.
    """
    extra = F.least(F.expr(f"(n * {percent} + 99) div 100"), F.lit(min(FIRST_EXTRA, EXTRA))).cast("int")
    length = (F.col("n") - F.expr(f"(n * {percent} + 99) div 100")).cast("int") + extra
    first = F.slice("head", F.lit(1), length)
    asked = heads.where(F.pmod(F.xxhash64("id", F.lit(9)), F.lit(ASKED)) == 0)
    runs = asked.select("id", F.explode(first).alias("run")).distinct().groupBy("run").agg(F.count("*").alias("sets"))
    most = F.greatest(F.lit(HOT_LEAST), F.lit(asked.count() / HOT_SHARE))
    hot = F.broadcast(materialize(runs.where(F.col("sets") >= most).select("run"), "hot-runs").withColumn("_hot", F.lit(True)))
    rows = heads.select("id", F.explode(first).alias("run")).join(hot, "run", "left")
    salt = F.when(F.col("_hot"), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    of_run = Window.partitionBy("run", "salt")
    rows = rows.withColumn("salt", salt).select("id", "run", "salt")
    rows = rows.withColumns({"least": F.min("id").over(of_run), "most": F.max("id").over(of_run)})
    rows = rows.where(F.col("salt").isNotNull() | (F.col("least") != F.col("most")))
    held = rows.groupBy("id").agg(F.count("*").alias("held"))
    return classes.join(held, "id").where(F.col("held") >= extra).drop("held")


def _shared(rows: DataFrame, least: int = 2) -> DataFrame:
    """``rows`` (..., run) with df, the number of rows of their run, where that is at least ``least``."""
    counts = materialize(rows.groupBy("run").agg(F.count("*").alias("df")).where(F.col("df") >= least), "runs")
    small = at_most(counts, SMALL_ROWS)
    return join_per_key(rows, counts.withColumn("rows", F.col("df")), "run", "rows", small)


def blocks(classes: DataFrame, percent: int) -> DataFrame:
    """id, block for the classes (id, n, head) that may link with another; linked ones have one block.

    And centre, the mean number of sets that hold a run of the class's: it is highest amid many copies.
    """
    rows = classes.select("id", "n", F.explode("head").alias("run"))
    for _ in range(PEELS):
        kept = _shared(rows).groupBy("id").agg(
            F.first("n").alias("n"), F.collect_list(F.struct("df", "run")).alias("held")
        )
        kept = materialize(kept.where(F.size("held") >= _need(percent)), "shared-heads")
        rows = kept.select("id", "n", F.explode("held.run").alias("run"))
    # Runs in order of df: the least common that a pair shares is not among the last need - 1.
    rare = F.slice(F.array_sort("held"), F.lit(1), F.size("held") - _need(percent) + 1)
    centre = F.aggregate("held", F.lit(0.0), lambda all_, one: all_ + one["df"]) / F.size("held")
    centres = kept.select("id", centre.alias("centre"))
    rows = kept.select("id", F.explode(rare).alias("at")).select("id", F.col("at.run").alias("run"))
    first = rows.groupBy("run").agg(F.min("id").alias("least"), F.count("*").alias("rows")).where("rows > 1")
    first = materialize(first, "first-of-runs")
    edges = join_per_key(rows, first, "run", "rows", at_most(first, SMALL_ROWS))
    edges = edges.where("id <> least").select(F.col("id").alias("a"), F.col("least").alias("b")).distinct()
    found = materialize(connected(edges).select(F.col("node").alias("id"), F.col("root").alias("block")), "block-members")
    return found.unionByName(found.select(F.col("block").alias("id"), "block").distinct()).join(centres, "id")


def _fetch(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """id, centre, n, runs (sorted, as bytes) of the wanted classes (doc, id, cls, centre), from whole texts."""
    if at_most(wanted, SMALL_ROWS):
        wanted = F.broadcast(wanted)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string")).join(wanted, "doc")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                found = sets(*text_bytes(part["text"]))
                mine = [i for i, c in enumerate(part["cls"].to_pylist()) if len(found[i]) and class_key(found[i]) == c]
                yield pa.RecordBatch.from_arrays(
                    [
                        part["id"].take(pa.array(mine, pa.int64())),
                        part["centre"].take(pa.array(mine, pa.int64())),
                        pa.array([len(found[i]) for i in mine], pa.int64()),
                        pa.array([found[i].tobytes() for i in mine], pa.binary()),
                    ],
                    ["id", "centre", "n", "runs"],
                )

    return rows.mapInArrow(run, "id long, centre double, n long, runs binary").dropDuplicates(["id"])


class Index:
    """Sorted sets, asked how many runs each shares with another set."""

    def __init__(self, members: list[np.ndarray]):
        self.sizes = np.array([len(m) for m in members])
        runs = np.concatenate(members)
        owners = np.repeat(np.arange(len(members)), self.sizes)
        order = np.argsort(runs, kind="stable")
        self.runs, self.owners = runs[order], owners[order]

    def both(self, runs: np.ndarray) -> np.ndarray:
        low = np.searchsorted(self.runs, runs)
        count = np.searchsorted(self.runs, runs, side="right") - low
        at = np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())
        return np.bincount(self.owners[at], minlength=len(self.sizes))


def _measure(percent: int):
    """Rows (unit, kind, region, id, core, homes, runs), pivots first, to each set's distances and links.

    Its home is the nearest of the first ``homes`` pivots.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, pivots, index = None, [], None
        for batch in batches:
            out: list[list] = [[], [], [], [], [], [], []]
            for name, kind, region, id_, core, homes, runs in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if name != unit:
                    unit, pivots, index = name, [], None
                own = np.frombuffer(runs, "<u8")
                if kind == 0:
                    pivots.append((id_, own))
                    continue
                index = index or Index([p for _, p in pivots])
                both = index.both(own)
                union = index.sizes + len(own) - both
                apart = 1 - both / union
                linked = [pivots[i][0] for i in np.flatnonzero(100 * both >= percent * union) if pivots[i][0] != id_]
                for column, value in zip(
                    out, (region, id_, core, len(own), int(apart[:homes].argmin()), apart.tolist(), linked), strict=True
                ):
                    column.append(value)
            types = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.int64())]
            arrays = [pa.array(c, t) for c, t in zip(out, types, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, ["region", "id", "core", "n", "home", "apart", "linked"])

    return run


_MEASURED = "region long, id long, core boolean, n long, home int, apart array<double>, linked array<long>"


def _compare(percent: int):
    """Rows (unit, kind, first, id, component, runs), the region's own sets first, to links that join what links."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held, index, parts = None, [], None, {}
        links: list[tuple[int, int]] = []

        def root(part: int) -> int:
            while parts.setdefault(part, part) != part:
                part = parts[part]
            return part

        def meet(id_: int, part: int, runs: np.ndarray, below: int) -> None:
            both = index.both(runs)[:below]
            size = index.sizes[:below] + len(runs)
            for i in np.flatnonzero(100 * both >= percent * (size - both)).tolist():
                one, other = root(part), root(held[i][1])
                if one != other:
                    parts[max(one, other)] = min(one, other)
                    links.append((id_, held[i][0]))

        def start() -> None:
            nonlocal index
            if index is None and held:
                index = Index([runs for *_, runs in held])
                if first_of_unit:
                    for i, (id_, part, runs) in enumerate(held[1:], 1):
                        meet(id_, part, runs, i)

        def out() -> pa.RecordBatch:
            ends = [pa.array([link[k] for link in links], pa.int64()) for k in (0, 1)]
            links.clear()
            return pa.RecordBatch.from_arrays(ends, ["a", "b"])

        first_of_unit = False
        for batch in batches:
            for name, kind, first, id_, part, runs in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if name != unit:
                    start()
                    unit, held, index, parts, first_of_unit = name, [], None, {}, first
                runs = np.frombuffer(runs, "<u8")
                if kind == 0:
                    held.append((id_, part, runs))
                elif held:
                    start()
                    meet(id_, part, runs, len(held))
            yield out()
        start()
        yield out()

    return run


def _dealt(rows: DataFrame, units: DataFrame, first: Column, deal: str) -> DataFrame:
    """Rows (region, id, ...) dealt by hash of the id over the ``deal`` units of their region, and ``first`` ones to all."""
    salt = F.pmod(F.xxhash64("id", F.lit(3)), F.col(deal).cast("long"))
    every = F.sequence(F.lit(0).cast("long"), F.col(deal).cast("long") - 1)
    rows = join_per_key(rows, units, "region", "members", at_most(units, SMALL_ROWS))
    rows = rows.withColumn("salt", F.explode(F.when(first, every).otherwise(F.array(salt))))
    return rows.withColumn("unit", F.xxhash64("region", "salt"))


def _split(rows: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """region, id, core, n, home, apart, linked of rows (region, id, core) by the pivots of their regions."""
    region = Window.partitionBy("region")
    own = rows.where("core").join(members.select("id", "n", "centre"), "id")
    # Half of them amid the region's copies, which join these at once, and half anywhere.
    some = [
        own.withColumn("place", F.row_number().over(region.orderBy(*order))).where(F.col("place") <= PIVOTS // 2)
        for order in ([F.desc("centre"), "id"], [F.xxhash64("id"), "id"])
    ]
    pivots = some[0].unionByName(some[1]).groupBy("region", "id", "core", "n").agg(F.min("place").alias("place"))
    order = region.orderBy("place", "id")
    pivots = pivots.withColumn("held", F.sum("n").over(order)).withColumn("place", F.row_number().over(order))
    pivots = pivots.where((F.col("place") == 1) | (F.col("held") <= REGION_RUNS))
    both = rows.withColumn("kind", F.lit(1)).unionByName(
        pivots.select("region", "id", "core").withColumn("kind", F.lit(0))
    )
    units = rows.groupBy("region").agg(F.count("*").alias("members"))
    # So many regions that they hold somewhat fewer than REGION sets; all pivots narrow what visits them.
    homes = F.least(F.lit(PIVOTS), F.greatest(F.lit(2), F.ceil(1.5 * F.col("members") / REGION)))
    units = units.withColumn("deal", F.ceil(F.col("members") / MEASURED)).withColumn("homes", homes.cast("int"))
    units = materialize(units, "measuring-units")
    dealt = _dealt(both, units, F.col("kind") == 0, "deal").join(members.select("id", "runs"), "id")
    dealt = dealt.select("unit", "kind", "region", "id", "core", "homes", "runs").repartition("unit")
    return dealt.sortWithinPartitions("unit", "kind", "id").mapInArrow(_measure(percent), _MEASURED)


def _regions(told: DataFrame, placed: DataFrame, percent: int) -> DataFrame:
    """Rows (region, id, core, n, component) of the Voronoi regions of measured rows, with the visitors of each.

    ``placed`` gives the component of ids.
    """
    told = materialize(told.join(placed, "id"), "told")
    own = told.where("core")
    most = own.groupBy("region", "component").agg(F.count("*").alias("held")).groupBy("region")
    most = most.agg(F.max_by("component", F.struct("held", "component")).alias("main"), F.sum("held").alias("of_parent"))
    bounds = [f(F.get("apart", F.lit(i))).alias(f"{n}{i}") for i in range(PIVOTS) for n, f in (("low", F.min), ("top", F.max))]
    cells = own.groupBy("region", "home").agg(
        F.count("*").alias("sets"), F.sum("n").alias("runs"), F.min("component").alias("one"),
        F.max("component").alias("other"), *bounds,
    ).join(most, "region")
    cut = F.ceil(F.greatest(F.col("sets") / REGION, F.col("runs") / REGION_RUNS)).cast("long")
    low, top = (F.array(*[F.col(f"{n}{i}") for i in range(PIVOTS)]) for n in ("low", "top"))
    alike = (2 * F.col("sets") > F.col("of_parent")) | (cut <= FEW)
    cells = cells.withColumn("cuts", F.when(alike, cut).otherwise(1))
    cells = cells.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1)).alias("cut"))
    cells = cells.select("region", "main", "of_parent", F.struct(
        F.xxhash64("region", "home", "cut").alias("name"), "home", "cut", "cuts", low.alias("low"), top.alias("top"),
        ((F.col("one") == F.col("main")) & (F.col("other") == F.col("main"))).alias("all_main"),
    ).alias("cell"))
    lists = cells.groupBy("region").agg(
        F.first("main").alias("main"), F.first("of_parent").alias("members"), F.collect_list("cell").alias("cells")
    )
    lists = materialize(lists, "cells")
    rows = join_per_key(told, lists, "region", "members", False)
    r = (100 - percent) / 100 + _ROUNDING
    is_main = F.col("component") == F.col("main")

    def is_own(cell: Column) -> Column:
        mine = F.pmod(F.xxhash64("id", F.lit(5)), cell["cuts"]) == cell["cut"]
        return F.col("core") & (cell["home"] == F.col("home")) & mine

    def visits(cell: Column) -> Column:
        ends = F.arrays_zip(F.col("apart").alias("at"), cell["low"].alias("low"), cell["top"].alias("top"))
        near = F.forall(ends, lambda e: e["at"].isNull() | e["at"].between(e["low"] - r, e["top"] + r))
        return near & F.when(F.col("core"), ~is_main).otherwise(~(is_main & cell["all_main"]))

    chosen = F.filter("cells", lambda cell: is_own(cell) | visits(cell))
    rows = rows.select("id", "n", "component", F.explode(F.transform(chosen, lambda c: F.struct(
        c["name"].alias("region"), is_own(c).alias("core")))).alias("to"))
    return rows.select("to.region", "id", "to.core", "n", "component")


def _components(links: DataFrame, members: DataFrame) -> DataFrame:
    """id, component (the least id that can be reached) of all members."""
    found = members.select("id").join(connected(links), F.col("id") == F.col("node"), "left")
    return found.select("id", F.coalesce("root", "id").alias("component"))


def join(rows: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join all members (id, n, runs) of each block, rows (block, id), that can be reached by links."""
    rows = rows.select(F.col("block").alias("region"), "id", F.lit(True).alias("core"), F.col("id").alias("component"))
    rows = rows.join(members.select("id", "n"), "id")
    small, links = [], None
    while True:
        sizes = rows.groupBy("region").agg(
            F.count_if("core").alias("sets"), F.sum(F.when(F.col("core"), F.col("n"))).alias("runs"), F.count("*").alias("members")
        )
        sizes = materialize(sizes, "region-sizes")
        is_large = ((F.col("sets") > REGION) | (F.col("runs") > REGION_RUNS)) & (F.col("sets") > 1)
        large = sizes.where(is_large).select("region", "members")
        if large.isEmpty():
            small.append(rows)
            break
        small.append(rows.join(large.select("region"), "region", "left_anti"))
        rows = join_per_key(rows, large, "region", "members", at_most(large, SMALL_ROWS))
        told = materialize(_split(rows.select("region", "id", "core"), members, percent), "measured")
        more = told.select(F.col("id").alias("a"), F.explode("linked").alias("b"))
        links = materialize(more if links is None else links.unionByName(more), "links")
        placed = materialize(_components(links, members), "placed")
        rows = materialize(_regions(told, placed, percent), "regions")
        # A region that is of one component, visitors included, has nothing to find.
        ends = rows.groupBy("region").agg(F.min("component").alias("one"), F.max("component").alias("other"))
        rows = rows.join(ends.where("one <> other").select("region"), "region", "left_semi")
        rows = materialize(rows, "open-regions")
    leaves = small[0]
    for more in small[1:]:
        leaves = leaves.unionByName(more)
    found = _joined(leaves, members, percent)
    return found if links is None else links.unionByName(found)


def _joined(rows: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Links of regions' own sets with one another and with visitors."""
    units = rows.groupBy("region").agg(F.count("*").alias("members"), F.count_if(~F.col("core")).alias("visitors"))
    units = materialize(units.select("region", "members", F.greatest(F.ceil(F.col("visitors") / VISITORS), F.lit(1)).alias("deal")), "units")
    dealt = _dealt(rows, units, F.col("core"), "deal").join(members.select("id", "runs"), "id")
    dealt = dealt.select(
        "unit", (~F.col("core")).cast("int").alias("kind"), (F.col("salt") == 0).alias("first"), "id", "component", "runs"
    )
    dealt = dealt.repartition("unit").sortWithinPartitions("unit", "kind", "id")
    return dealt.mapInArrow(_compare(percent), "a long, b long")


def components(docs: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs`` (doc_id, text).

    Documents are linked where 100 * |intersection| >= ``percent`` * |union|; component_id is
    the least doc_id that can be reached by links, the document's own included.
    """
    sketches = materialize(sketch(small_batches(docs), percent), "sketches")
    known = sketches.where("cls IS NOT NULL AND doc_id IS NOT NULL")
    # Ids of classes are their least doc_id; of several texts of one doc_id each needs an id of its own.
    classes = known.groupBy("cls").agg(F.min("doc_id").alias("doc"), F.min("n").alias("n"))
    classes = materialize(classes.withColumn("id", F.xxhash64("cls")), "classes")
    heads = known.where("head IS NOT NULL").select(F.xxhash64("cls").alias("id"), "n", "head")
    told = materialize(_first_told(heads, classes.select("id", "n"), percent), "first-told").select("id")
    told = F.broadcast(told) if at_most(told, SMALL_ROWS) else told
    told = materialize(heads.join(told, "id").dropDuplicates(["id"]), "heads")
    inside = materialize(blocks(told, percent), "blocks")
    wanted = inside.select("id", "centre").join(classes.select("id", "doc", "cls"), "id")
    members = materialize(_fetch(docs, materialize(wanted, "wanted")), "members")
    links = materialize(join(inside, members, percent), "links")
    # Classes and documents, so that several texts of one doc_id hang together, and so do copies.
    same = known.select("doc_id", "cls").distinct().join(classes.select("cls", "id"), "cls")
    roots = connected(links).select(F.col("node").alias("id"), F.col("root").alias("group"))
    named = same.join(roots, "id", "left").select("doc_id", F.coalesce("group", "id").alias("group"))
    several = named.groupBy("doc_id").agg(F.min("group").alias("group"), F.max("group").alias("other"))
    merged = several.where("group <> other").select("doc_id")
    found = materialize(named, "named")
    if not merged.isEmpty():
        least = found.groupBy("doc_id").agg(F.min("group").alias("b"))
        pairs = found.join(least, "doc_id").select(F.col("group").alias("a"), "b").distinct()
        joined = connected(pairs).select(F.col("node").alias("group"), "root")
        found = found.join(joined, "group", "left").select("doc_id", F.coalesce("root", "group").alias("group")).distinct()
    least = found.groupBy("group").agg(F.min("doc_id").alias("component"), F.count("*").alias("members"))
    least = materialize(least, "groups")
    of_doc = join_per_key(found, least, "group", "members", at_most(least, SMALL_ROWS)).select("doc_id", "component")
    out = sketches.select("doc_id", F.col("n").alias("n_shingles")).join(of_doc, "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


SQL = r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM words),
runs AS (SELECT doc_id, len(s) AS n, unnest(s) AS run FROM sets),
links AS (SELECT a.doc_id AS x, b.doc_id AS y FROM runs a JOIN runs b ON a.run = b.run AND a.doc_id <> b.doc_id
  GROUP BY 1, 2 HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
reach AS (SELECT doc_id, doc_id AS other FROM sets UNION SELECT l.y, r.other FROM reach r JOIN links l ON l.x = r.doc_id)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id
FROM sets JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY 1) USING (doc_id)
"""
