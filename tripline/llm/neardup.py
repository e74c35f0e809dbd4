"""Near-duplicate documents by a chosen-path set similarity join.

A document is the set of its runs of five words (ASCII letters lowered), as 64-bit
hashes; a shorter text is one run.  Documents of equal sets are one class, which goes on
alone.  A class carries ``TOKENS`` minwise tokens.

* First trees: classes with the same chosen token form a node.  In the first ``FIRST_TREES`` of
  ``TREES`` independent trees they are compared at once, large nodes in hashed parts, so most
  of a large group of near copies is one component before anything else is done.
* Branch: of all trees, only nodes that hold classes of different components go on.  A node
  of more than ``WHOLE`` * ``LIMIT`` classes is compared in pairs of parts, one of more than ``DIRECT`` *
  ``LIMIT`` is branched by the next token, and so on.
* Compare: a node's classes of different components are compared exhaustively, first by tokens
  (with a margin of ``MARGIN`` standard errors), then on full sets; classes already joined in
  the node aren't compared again, so a node of n classes yields fewer than n links.
* Long sets: what is compared together is one task's up to ``LIMIT_RUNS`` runs.  Above that
  the runs are dealt by their hash over tasks, which count what pairs share; counts are added up.
* Crowds: nodes of more than ``DIRECT`` * ``LIMIT`` classes at depth ``DEEPEST`` are branched no more,
  as that would tear large groups apart.  Their classes are compared in hashed parts, then
  the middle classes of the largest components with all that are not joined to them yet
  (which only saves work), then all pairs of the crowd that are still apart.

Two classes of similarity s agree in about s * TOKENS tokens, and share a node at depth d
of a tree if they agree in its first d + 1 tokens.  Trees take tokens in orders of their
own.  ``TREES`` or more trees are made, until a pair at the threshold is missed by all with
probability ``MISS`` at most at the depth that was reached; below 1e-9 where first nodes
are small.  Pairs in large parts of crowds cost the square of what is apart there.

Null and empty texts have no set and are linked with nothing.  Rows without doc_id are
kept and belong to no component.  Rows that repeat a doc_id are one document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from hashlib import blake2b
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripline.llm.arrow import release, slices, small_batches, text_bytes
from tripline.llm.components import connected
from tripline.llm.textscore import lower, sums
from tripline.session import materialize

WORDS = 5
TOKENS = 64
TREES = 12
DEEPEST = 3
MISS = 0.001
#: First nodes of up to so many classes are compared in all trees; of larger ones, as many trees as ``MISS`` asks for.
LIMIT = 1_024
#: One task compares up to so many times LIMIT classes with one another.
WHOLE = 4
#: All pairs that are apart are compared in nodes of up to so many times LIMIT classes, in parts.
DIRECT = 8
#: Classes joined by the first trees' first nodes need not meet again.
FIRST_TREES = 3
#: Sets that are compared with one another are held by one task if they have no more runs than this.
LIMIT_RUNS = 4_000_000
#: A set goes from task to task in pieces of about so many runs.
PIECE = 65_536
MARGIN = 4.5
#: Components of a crowd whose middle meets the rest before all pairs apart do.
PIVOTS = 4
#: So many documents to fetch again are sent to every task; more are joined by shuffle.
FETCH_BY_BROADCAST = 500_000
SLICE_BYTES = 1 << 20

_rng = np.random.default_rng(20)
_PLACES = _rng.integers(0, 1 << 64, 4_096, np.uint64) | np.uint64(1)
_STEP, _SHORT = (_rng.integers(0, 1 << 64, 2, np.uint64) | np.uint64(1)).tolist()
_ORDER = _rng.integers(0, 1 << 64, WORDS, np.uint64) | np.uint64(1)
_TIMES = _rng.integers(0, 1 << 32, TOKENS, np.uint32) | np.uint32(1)
_PLUS = _rng.integers(0, 1 << 32, TOKENS, np.uint32)
#: The tokens that each tree takes, one row a tree; more trees than any similarity from 0.3 on needs.
_TURNS = np.array([_rng.permutation(TOKENS)[: DEEPEST + 1] for _ in range(2_000)])
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct run hashes of each text."""
    word = ~_SPACE[data]
    border = np.zeros(len(data) + 1, bool)
    border[offsets] = True
    starts = np.flatnonzero(word & (~np.append([False], word[:-1]) | border[:-1]))
    ends = np.flatnonzero(word & (~np.append(word[1:], [False]) | border[1:])) + 1
    if not len(starts):
        return [np.zeros(0, np.uint64)] * (len(offsets) - 1)
    place = np.zeros(len(data), np.int64)
    place[starts[0] :] = np.arange(starts[0], len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))
    code = (lower(data).astype(np.uint64) + np.uint64(1)) * _PLACES[place & 4_095]
    if place.max() >= 4_096:  # very long words
        code = _mix(code + (place >> 12).astype(np.uint64) * np.uint64(_STEP))
    words = _mix(sums(np.append(code, np.uint64(0)), starts, ends))
    first = np.searchsorted(starts, offsets)
    runs = np.zeros(max(len(words) - WORDS + 1, 0), np.uint64)
    for k in range(WORDS):
        runs += words[k : k + len(runs)] * _ORDER[k]
    runs = _mix(runs)
    out = []
    for low, high in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if high - low >= WORDS:
            out.append(np.unique(runs[low : high - WORDS + 1]))
        else:
            few = (words[low:high] * _ORDER[: high - low]).sum(dtype=np.uint64) ^ np.uint64((high - low) * _SHORT % 2**64)
            out.append(_mix(np.array([few], np.uint64)) if high > low else np.zeros(0, np.uint64))
    return out


def tokens_of(runs: np.ndarray) -> np.ndarray:
    """The minwise tokens of a set that is not empty."""
    least = np.full(TOKENS, 0xFFFFFFFF, np.uint32)
    short = (runs >> np.uint64(32)).astype(np.uint32)
    for low in range(0, len(short), 16_384):
        part = short[low : low + 16_384]
        np.minimum(least, (part[None, :] * _TIMES[:, None] + _PLUS[:, None]).min(1), out=least)
    return least.view(np.int32)


def class_key(runs: np.ndarray) -> bytes:
    """128 bits that tell sets apart."""
    other = _mix(runs * np.uint64(_STEP))
    return np.array([runs.sum(dtype=np.uint64), other.sum(dtype=np.uint64) + np.uint64(len(runs))], np.uint64).tobytes()


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, n, cls (of the set; null if empty), tokens of every row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                found = sets(*text_bytes(part["text"]))
                yield pa.RecordBatch.from_arrays(
                    [
                        part["doc_id"],
                        pa.array([len(s) for s in found], pa.int64()),
                        pa.array([class_key(s) if len(s) else None for s in found], pa.binary()),
                        pa.array([tokens_of(s) if len(s) else None for s in found], pa.list_(pa.int32())),
                    ],
                    ["doc_id", "n", "cls", "tokens"],
                )
        release()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, n long, cls binary, tokens array<int>")


def by_key(key: str, make: Callable[[pa.Table], list[pa.RecordBatch]]):
    """A mapInArrow function that hands ``make`` whole runs of equal ``key`` of sorted rows, many at a time."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            values = batch[key].to_numpy(zero_copy_only=False)
            last = int(np.flatnonzero(values != values[-1])[-1]) + 1 if values[0] != values[-1] else 0
            if held and held[0][key][0].as_py() != values[0]:
                yield from make(pa.Table.from_batches(held))
                held = []
            if last:
                yield from make(pa.Table.from_batches([*held, batch.slice(0, last)]))
                held = []
            held.append(batch.slice(last))
        if held:
            yield from make(pa.Table.from_batches(held))
        held = []
        release()

    return run


def _groups(values: np.ndarray) -> list[tuple[int, int]]:
    cuts = np.flatnonzero(values[1:] != values[:-1]) + 1
    return list(zip([0, *cuts.tolist()], [*cuts.tolist(), len(values)], strict=True))


def _parts(linked: np.ndarray) -> np.ndarray:
    """The component number of each row of a boolean matrix."""
    label = np.full(len(linked), -1)
    for seed in range(len(linked)):
        if label[seed] >= 0:
            continue
        label[seed] = seed
        open_ = [seed]
        while open_:
            new = np.flatnonzero(linked[open_.pop()] & (label < 0))
            label[new] = seed
            open_ += new.tolist()
    return label


def _likeness(tokens: np.ndarray, n: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The number of equal tokens of all pairs of sets, and which pairs may be similar enough by tokens and sizes."""
    share = percent / 100
    border = share - MARGIN * np.sqrt(share * (1 - share) / TOKENS)
    like = np.zeros((len(n), len(n)), np.uint8)
    for column in np.ascontiguousarray(tokens.T):
        like += (column[:, None] == column[None, :]).view(np.uint8)
    linked = like >= int(np.ceil(border * TOKENS))
    linked &= n[:, None] >= share * n[None, :]
    linked &= n[None, :] >= share * n[:, None]
    np.fill_diagonal(linked, False)
    return like, linked


def _leaf_blocks(percent: int):
    """Leaf rows (path, root, tree, cls, n, tokens) to blocks (block, cls, n, leaf, tree) of classes that may be linked.

    And if there is a root, the middle class of each block.  Classes of one ``component``, if given, are not linked,
    nor are those that share a first node of the trees before number ``met``, if given.
    """

    def make(table: pa.Table) -> list[pa.RecordBatch]:
        table = table.combine_chunks()
        cls = table["cls"].to_pylist()
        runs = table["n"].to_numpy()
        size = runs.astype(float)
        tokens = table["tokens"].combine_chunks().flatten().to_numpy().reshape(-1, TOKENS)
        roots, trees = table["root"].to_pylist(), table["tree"].to_numpy()
        placed = table["component"].to_numpy() if "component" in table.schema.names else None
        met = table["met"].to_numpy() if "met" in table.schema.names else None
        blocks, members, sizes, kinds, sources = [], [], [], [], []
        for low, high in _groups(table["path"].to_numpy()):
            like, linked = _likeness(tokens[low:high], size[low:high], percent)
            if placed is not None:
                linked &= placed[low:high, None] != placed[None, low:high]
            for turn in _TURNS[: met[low], 0] if met is not None else []:
                linked &= tokens[low:high, None, turn] != tokens[None, low:high, turn]
            if not linked.any():
                continue
            label = _parts(linked)
            for part in np.flatnonzero(np.bincount(label) > 1).tolist():
                chosen = np.flatnonzero(label == part)
                names, held = zip(*sorted((cls[low + i], int(runs[low + i])) for i in chosen), strict=True)
                name = int.from_bytes(blake2b(b"".join(names), digest_size=8).digest(), "little", signed=True)
                blocks += [name] * len(names)
                members += names
                sizes += held
                kinds += [0] * len(names)
                sources += [trees[low]] * len(names)
                # The class most like the others of its part is near the middle of a group.
                if roots[low] is not None:
                    blocks.append(roots[low])
                    middle = low + int(chosen[like[np.ix_(chosen, chosen)].mean(1).argmax()])
                    members.append(cls[middle])
                    sizes.append(int(runs[middle]))
                    kinds.append(len(names))
                    sources.append(trees[low])
        columns = {"block": pa.int64(), "cls": pa.binary(), "n": pa.int64(), "leaf": pa.int32(), "tree": pa.int32()}
        values = [blocks, members, sizes, kinds, sources]
        arrays = [pa.array(v, t) for v, t in zip(values, columns.values(), strict=True)]
        return [pa.RecordBatch.from_arrays(arrays, list(columns))]

    return by_key("path", make)


def _links(percent: int):
    """Block rows (block, rep, part, runs) to links (a, b) confirmed on full sets that join whatever is linked in the block."""

    def make(table: pa.Table) -> list[pa.RecordBatch]:
        table = table.combine_chunks()
        block, reps, runs = _whole(table, "block")
        left, right = [], []
        for low, high in _groups(block):
            rest = np.arange(low, high)
            while len(rest):
                open_, rest = [rest[0]], rest[1:]
                while open_ and len(rest):
                    at = open_.pop()
                    linked = _linked(runs[at], [runs[i] for i in rest], percent)
                    left += [reps[at]] * int(linked.sum())
                    right += reps[rest[linked]].tolist()
                    open_ += rest[linked].tolist()
                    rest = rest[~linked]
        return [pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])]

    return by_key("block", make)


def _whole(table: pa.Table, key: str) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """``key``, rep and sorted runs of each set of rows (key, rep, part, runs) sorted by the first three."""
    names, reps = table[key].to_numpy(), table["rep"].to_numpy()
    pieces = [np.frombuffer(r, "<u8") for r in table["runs"].to_pylist()]
    first = np.flatnonzero(np.append([True], (names[1:] != names[:-1]) | (reps[1:] != reps[:-1])))
    ends = [*first[1:].tolist(), len(pieces)]
    runs = [
        pieces[low] if high - low == 1 else np.concatenate(pieces[low:high])
        for low, high in zip(first.tolist(), ends, strict=True)
    ]
    return names[first], reps[first], runs


def _cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces (block, deal, rep, bits, part, runs, others) to rows (share, block, rep, part, runs, others) of 2^deal shares.

    Every set of a block has a row in every share, if only an empty one.
    """
    for batch in batches:
        shares, rows, cuts = [], [], []
        names = ["block", "deal", "bits", "part", "runs"]
        for row, (block, deal, bits, part, runs) in enumerate(zip(*[batch[c].to_pylist() for c in names], strict=True)):
            runs = np.frombuffer(runs, "<u8")
            low = (part << deal) >> bits
            high = max(((part + 1) << deal) >> bits, low + 1)
            at = np.searchsorted(runs, np.arange(low + 1, high).astype(np.uint64) << np.uint64(64 - deal)) if deal else []
            for share, piece in zip(range(low, high), np.split(runs, at), strict=True):
                name = blake2b(f"{block} {share}".encode(), digest_size=8).digest()
                shares.append(int.from_bytes(name, "little", signed=True))
                rows.append(row)
                cuts.append(piece.tobytes())
        rest = [batch[c].take(pa.array(rows, pa.int64())) for c in ("block", "rep", "part", "others")]
        yield pa.RecordBatch.from_arrays(
            [pa.array(shares, pa.int64()), *rest, pa.array(cuts, pa.binary())],
            ["share", "block", "rep", "part", "others", "runs"],
        )


def _forest(like: np.ndarray, linked: np.ndarray) -> np.ndarray:
    """The pairs of a spanning forest of ``linked`` whose likeness is greatest."""
    weight = np.where(linked, like, -1).astype(np.float32)
    out = np.zeros_like(linked)
    left, best, by = np.ones(len(like), bool), np.full(len(like), -1.0), np.full(len(like), -1)
    for _ in range(len(like)):
        at = int(np.where(left, best, -2.0).argmax())
        left[at] = False
        if by[at] >= 0:
            out[at, by[at]] = out[by[at], at] = True
        better = left & (weight[at] > best)
        best[better], by[better] = weight[at][better], at
    return out


def _candidates(percent: int, forest: bool):
    """Members (block, rep, n, tokens, component) of blocks to pairs (block, a, b, total) that may be linked and are apart.

    With ``forest`` only as many as can join them all, the likeliest.
    """

    def make(table: pa.Table) -> list[pa.RecordBatch]:
        table = table.combine_chunks()
        reps, size, placed = table["rep"].to_numpy(), table["n"].to_numpy(), table["component"].to_numpy()
        tokens = table["tokens"].combine_chunks().flatten().to_numpy().reshape(-1, TOKENS)
        blocks = table["block"].to_numpy()
        out = [[], [], [], []]
        for low, high in _groups(blocks):
            like, linked = _likeness(tokens[low:high], size[low:high].astype(float), percent)
            linked &= placed[low:high, None] != placed[None, low:high]
            one, other = np.nonzero(np.triu(_forest(like, linked) if forest else linked))
            one, other = one + low, other + low
            for column, values in zip(out, [blocks[one], reps[one], reps[other], size[one] + size[other]], strict=True):
                column.append(values)
        arrays = [pa.array(np.concatenate(c), pa.int64()) for c in out]
        return [pa.RecordBatch.from_arrays(arrays, ["block", "a", "b", "total"])]

    return by_key("block", make)


def _shared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shares (share, block, rep, part, others, runs) to the number of runs that each set has in common with its others."""

    def make(table: pa.Table) -> list[pa.RecordBatch]:
        table = table.combine_chunks()
        share, reps, runs = _whole(table, "share")
        pairs = {}
        for name, block, rep, others in zip(
            *[table[c].to_pylist() for c in ("share", "block", "rep", "others")], strict=True
        ):
            pairs[name, rep] = block, others or []
        out = [[], [], [], []]
        for low, high in _groups(share):
            place = {rep: low + i for i, rep in enumerate(reps[low:high].tolist())}
            for rep, at in place.items():
                block, others = pairs[int(share[low]), rep]
                for other in others:
                    for column, value in zip(out, (block, rep, other, _common(runs[at], runs[place[other]])), strict=True):
                        column.append(value)
        arrays = [pa.array(c, pa.int64()) for c in out]
        return [pa.RecordBatch.from_arrays(arrays, ["block", "a", "b", "both"])]

    return by_key("share", make)(batches)


def _common(one: np.ndarray, other: np.ndarray) -> int:
    if not len(one) or not len(other):
        return 0
    return int((one[np.minimum(np.searchsorted(one, other), len(one) - 1)] == other).sum())


def _linked(one: np.ndarray, others: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of the other sets are similar enough to ``one``; all sets are sorted."""
    size = np.array([len(o) for o in others])
    fit = 100 * np.minimum(size, len(one)) >= percent * np.maximum(size, len(one))
    out = np.zeros(len(others), bool)
    if fit.any():
        chosen = np.flatnonzero(fit)
        all_runs = np.concatenate([others[i] for i in chosen])
        at = np.minimum(np.searchsorted(one, all_runs), len(one) - 1)
        both = np.add.reduceat((one[at] == all_runs).astype(np.int64), np.cumsum(size[chosen]) - size[chosen])
        out[chosen] = 100 * both >= percent * (size[chosen] + len(one) - both)
    return out


def trees_for(depth: int, percent: int, least: int = TREES) -> int:
    """So many trees miss a pair at the threshold with probability ``MISS`` at most, if nodes are ``depth`` deep."""
    share, most = percent / 100, len(_TURNS)
    agree = np.array([comb(TOKENS, m) * share**m * (1 - share) ** (TOKENS - m) for m in range(TOKENS + 1)])
    meet = np.array([comb(m, depth + 1) / comb(TOKENS, depth + 1) for m in range(TOKENS + 1)])
    enough = [t for t in range(least, most) if (agree * (1 - meet) ** t).sum() <= MISS]
    return enough[0] if enough else most


def _turned(depth: int, low: int, high: int, path: Column | None = None) -> Column:
    """The node at ``depth`` of column ``tree`` below ``path`` (null: the tree's root)."""
    turn = F.array(*[F.lit(int(t)) for t in _TURNS[low:high, depth]])
    token = F.element_at("tokens", F.element_at(turn, F.col("tree") - low + 1) + 1)
    return F.xxhash64(F.col("tree") if path is None else path, token)


def _planted(classes: DataFrame, low: int, high: int) -> DataFrame:
    """``classes`` in the first nodes of trees ``low`` to ``high``: tree, path and all columns but the tokens."""
    rows = classes.withColumn("tree", F.explode(F.sequence(F.lit(low), F.lit(high - 1))))
    return rows.withColumn("path", _turned(0, low, high)).drop("tokens")


def _sizes(rows: DataFrame, *more: Column) -> DataFrame:
    """path, members, runs and marks of the members of nodes of several classes, written."""
    sizes = rows.groupBy("path").agg(
        F.min("tree").alias("tree"),
        F.count("*").alias("members"),
        F.sum("n").alias("runs"),
        F.bit_xor(F.xxhash64("cls")).alias("who"),
        F.bit_xor(F.xxhash64("cls", F.lit(1))).alias("whose"),
        *more,
    )
    return materialize(sizes.where("members > 1"), "node-sizes")


def _once(sizes: DataFrame) -> DataFrame:
    """path, members: the same classes often meet in several trees; one of those nodes is enough."""
    once = sizes.groupBy("members", "runs", "who", "whose").agg(F.min(F.struct("tree", "path")).alias("at"))
    return once.select("at.path", "members")


def _first_leaves(classes: DataFrame) -> DataFrame:
    """path, cls of the first trees' small first nodes, and of parts of the large ones, dealt otherwise in each tree."""
    rows = _planted(classes.select("cls", "n", "tokens"), 0, FIRST_TREES)
    rows = rows.join(_once(_sizes(rows)), "path")
    parts = F.when(F.col("members") > LIMIT, F.ceil(F.col("members") / (LIMIT // 2))).otherwise(1).cast("long")
    return rows.select(F.xxhash64("path", F.pmod(F.xxhash64("cls", "tree"), parts)).alias("path"), "tree", "cls")


def _leaves(classes: DataFrame, percent: int) -> tuple[DataFrame, DataFrame, bool]:
    """Nodes of classes of several components that have not met yet, from ``classes`` (cls, n, tokens, component).

    Leaves as (path, root, tree, cls, component): small nodes, pairs of parts of larger ones, and hashed parts of crowds;
    root null or the crowd.  Crowds as (root, cls), and whether there are any.
    """
    leaves, crowds, large, depth = _branched(classes, classes, 0, TREES, trees_for(0, percent, 1))
    need = trees_for(depth, percent)
    deep = depth == DEEPEST
    if need > TREES:  # classes whose first nodes were all small have met already
        chosen = large.distinct().join(classes, "cls")
        more, other, _, reached = _branched(chosen, classes, TREES, need, need)
        leaves, crowds, deep = leaves.unionByName(more), crowds.unionByName(other), deep or reached == DEEPEST
    return leaves, materialize(crowds, "crowds") if deep else crowds, deep


def _branched(
    chosen: DataFrame, classes: DataFrame, low: int, high: int, direct: int
) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Leaves and crowds of trees ``low`` to ``high``, classes in large first nodes (cls), and the depth reached.

    Large first nodes that are compared without branching are those of the trees before number ``direct``.
    """
    rows = _planted(chosen.select("cls", "n", "component", "tokens"), low, high)
    none = F.lit(None).cast("long")
    found, large_first, depth = [], None, 0
    crowds = classes.select(none.alias("root"), "cls").limit(0)

    def leaves_of(rows: DataFrame, met: bool) -> DataFrame:
        number = F.least(F.col("tree"), F.lit(direct)) if met else F.lit(0)
        return rows.select("path", "root", "tree", "cls", "component", number.cast("int").alias("met"))

    while True:
        sizes = _sizes(rows, F.min("component").alias("one"), F.max("component").alias("other")).where("one <> other")
        once = _once(sizes)
        small = once.where(F.col("members") <= WHOLE * LIMIT)
        if depth == 0 and low == 0:  # those of the first trees have met
            met_before = sizes.where((F.col("tree") < FIRST_TREES) & (F.col("members") <= LIMIT))
            small = small.join(met_before.select("path"), "path", "left_anti")
        large = sizes.where(F.col("members") > DIRECT * LIMIT).select("path")
        is_last = large.isEmpty()
        met = is_last and depth == 0 and low == 0  # every first node is compared whole, so each pair once is enough
        alone = rows.join(small, "path").withColumn("root", none)
        if depth == 0:
            alone = alone.where((F.col("members") <= LIMIT) | (F.col("tree") < direct))
        found.append(leaves_of(alone, met))
        if sizes.where(F.col("members") > WHOLE * LIMIT).isEmpty():
            break
        whole = rows.join(once.where((F.col("members") > WHOLE * LIMIT) & (F.col("members") <= DIRECT * LIMIT)), "path")
        if depth == 0:
            whole = whole.where(F.col("tree") < direct)
        found.append(leaves_of(_parts_apart(whole.withColumn("root", F.col("path"))), met))
        if is_last:
            break
        if depth == DEEPEST:
            crowd = rows.join(once.where(F.col("members") > DIRECT * LIMIT), "path")
            part = F.pmod(F.xxhash64("cls"), F.ceil(F.col("members") / (WHOLE * LIMIT // 2)).cast("long"))
            crowd = crowd.withColumn("root", F.col("path"))
            found.append(leaves_of(crowd.withColumn("path", F.xxhash64("root", part)), False))
            crowds = crowd.select("root", "cls")
            break
        rows = rows.join(large, "path")
        if large_first is None:
            rows = large_first = materialize(rows, "large-nodes")
        depth += 1
        rows = rows.join(classes.select("cls", "tokens"), "cls")
        rows = rows.withColumn("path", _turned(depth, low, high, F.col("path"))).drop("tokens")
        rows = materialize(rows, "large-nodes")
    leaves = found[0]
    for more in found[1:]:
        leaves = leaves.unionByName(more)
    return leaves, crowds, (large_first if large_first is not None else rows).select("cls"), depth


def _fetch(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """cls, rep, bits, part, runs of the wanted classes (cls, rep), from the whole texts.

    A set is in 2^bits rows: ``part`` has the runs whose first bits it names.
    """
    wanted = materialize(wanted, "wanted")  # counted and joined; finding them takes several shuffles
    if wanted.count() <= FETCH_BY_BROADCAST:
        wanted = F.broadcast(wanted)
    rows = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(wanted, "rep")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                found = sets(*text_bytes(part["text"]))
                which, bits, parts, pieces = [], [], [], []
                for i, (s, c) in enumerate(zip(found, part["cls"].to_pylist(), strict=True)):
                    if class_key(s) == c:
                        some = (max(len(s) - 1, 0) // PIECE).bit_length()
                        cuts = np.arange(1, 1 << some).astype(np.uint64) << np.uint64(64 - some) if some else []
                        which += [i] * (1 << some)
                        bits += [some] * (1 << some)
                        parts += range(1 << some)
                        pieces += [piece.tobytes() for piece in np.split(s, np.searchsorted(s, cuts) if some else [])]
                which = pa.array(which, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        part["cls"].take(which),
                        part["rep"].take(which),
                        pa.array(bits, pa.int32()),
                        pa.array(parts, pa.int32()),
                        pa.array(pieces, pa.binary()),
                    ],
                    ["cls", "rep", "bits", "part", "runs"],
                )

    return rows.mapInArrow(run, "cls binary, rep long, bits int, part int, runs binary").dropDuplicates(["cls", "part"])


def _confirm(blocks: DataFrame, classes: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join whatever is linked in the blocks (block, cls, n)."""
    held = blocks.groupBy("block").agg(F.sum("n").alias("held"))
    deal = F.length(F.bin(F.expr(f"(held - 1) div {LIMIT_RUNS}")))
    long = materialize(held.where(F.col("held") > LIMIT_RUNS).select("block", deal.alias("deal")), "long-blocks")
    if long.isEmpty():
        return _in_one_task(blocks, full, percent)
    links = _in_one_task(blocks.join(long, "block", "left_anti"), full, percent)
    return links.unionByName(_over_tasks(blocks.join(long, "block"), classes, full, percent))


def _in_one_task(blocks: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    rows = blocks.join(full, "cls").select("block", "rep", "part", "runs").repartition("block")
    return rows.sortWithinPartitions("block", "rep", "part").mapInArrow(_links(percent), "a long, b long")


def _over_tasks(blocks: DataFrame, classes: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """``_confirm`` for blocks (block, deal, cls), whose runs are dealt over 2^deal tasks.

    First the likeliest pairs that could join all of a block, then all pairs still apart.
    """
    members = blocks.select("block", "deal", "cls").join(classes, "cls")
    found = None
    for forest in (True, False):
        rows = members.withColumn("component", F.col("rep"))
        if found is not None:
            rows = members.join(_placed(classes.select("cls", "rep"), connected(found)), "cls")
        rows = rows.select("block", "rep", "n", "tokens", "component").repartition("block").sortWithinPartitions("block")
        pairs = rows.mapInArrow(_candidates(percent, forest), "block long, a long, b long, total long")
        pairs = materialize(pairs, "long-pairs")
        if pairs.isEmpty():
            break
        others = pairs.groupBy("block", F.col("a").alias("rep")).agg(F.collect_list("b").alias("others"))
        ends = pairs.select("block", F.explode(F.array("a", "b")).alias("rep")).distinct()
        sets = members.select("block", "deal", "cls", "rep").join(ends.join(others, ["block", "rep"], "left"), ["block", "rep"])
        sets = sets.join(full.drop("rep"), "cls").select("block", "deal", "rep", "bits", "part", "others", "runs")
        shares = sets.mapInArrow(
            _cut, "share long, block long, rep long, part int, others array<long>, runs binary"
        )
        shares = shares.repartition("share").sortWithinPartitions("share", "rep", "part")
        both = shares.mapInArrow(_shared, "block long, a long, b long, both long")
        sums = both.groupBy("block", "a", "b").agg(F.sum("both").alias("both")).join(pairs, ["block", "a", "b"])
        enough = 100 * F.col("both") >= percent * (F.col("total") - F.col("both"))
        more = sums.where(enough).select("a", "b")
        found = materialize(more if found is None else found.unionByName(more), "long-links")
    return found if found is not None else classes.select(F.col("rep").alias("a"), F.col("rep").alias("b")).limit(0)


def components(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of ``docs`` (doc_id, text).

    Documents are linked where 100 * |intersection| >= ``percent`` * |union|.  kept is true
    for one document of each component, and for rows without a set or doc_id.
    """
    sketches = materialize(sketch(small_batches(docs)), "sketches")
    classes = (
        sketches.where("cls IS NOT NULL AND doc_id IS NOT NULL")
        .groupBy("cls")
        .agg(F.min("doc_id").alias("rep"), F.min("n").alias("n"), F.min("tokens").alias("tokens"))
    )
    classes = materialize(classes, "classes")
    names = classes.select("cls", "rep")
    made = _blocks(_first_leaves(classes), classes, percent)
    full = materialize(_fetch(docs, made.select("cls").distinct().join(names, "cls")), "full-sets")
    links = materialize(_confirm(made.select("block", "cls", "n").distinct(), classes, full, percent), "links")
    # What is in one component by now need not meet again.
    placed = classes.join(connected(links), F.col("rep") == F.col("node"), "left")
    placed = placed.select("cls", "n", "tokens", F.coalesce("root", "rep").alias("component"))
    leaves, crowds, deep = _leaves(materialize(placed, "placed"), percent)
    made = _blocks(leaves, classes, percent)
    wanted = made.select("cls").unionByName(crowds.select("cls")).distinct().join(names, "cls")
    wanted = wanted.join(full.select("cls").distinct(), "cls", "left_anti")
    full = full.unionByName(materialize(_fetch(docs, wanted), "full-sets"))
    blocks = made.where("leaf = 0").select("block", "cls", "n").distinct()
    links = links.unionByName(_confirm(blocks, classes, full, percent))
    if deep:
        links = materialize(links, "links")
        links = links.unionByName(_around_pivots(made, crowds, classes, connected(links), full, percent))
        links = materialize(links, "links")
        links = links.unionByName(_apart(crowds, classes, connected(links), full, percent))
    named = _placed(names, connected(links))
    out = sketches.select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.col("cls")).alias("cls"))
    out = out.join(named, "cls", "left").withColumn("component_id", F.coalesce("component", "doc_id"))
    return out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        "component_id",
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"),
    )


def _placed(names: DataFrame, roots: DataFrame) -> DataFrame:
    """cls and component (the least document that can be reached, itself included)."""
    found = names.join(roots, F.col("rep") == F.col("node"), "left")
    return found.select("cls", F.coalesce("root", "rep").alias("component"))


def _around_pivots(made, crowds, classes, roots, full, percent: int) -> DataFrame:
    """Links of the middle class of each crowd's largest components with its classes not joined to them yet."""
    placed = _placed(classes.select("cls", "rep"), roots)
    held = crowds.join(placed, "cls").groupBy("root", "component").agg(F.count("*").alias("held"))
    order = Window.partitionBy("root").orderBy(F.desc("held"), "component")
    pivots = (
        made.where("leaf > 0")
        .join(placed, "cls")
        .groupBy(F.col("block").alias("root"), "component")
        .agg(F.max(F.struct("leaf", "cls")).alias("best"))
        .join(held, ["root", "component"])
        .withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= PIVOTS)
        .select("root", F.col("best.cls").alias("pivot"), F.col("component").alias("of_pivot"))
    )
    apart = (
        crowds.join(placed, "cls")
        .join(materialize(pivots, "pivots"), "root")
        .where(F.col("component") != F.col("of_pivot"))
        .select("cls", "pivot")
        .distinct()
    )
    # Each block is a pivot and some of the classes to meet it, dealt by hash.
    counts = apart.groupBy("pivot").agg(F.ceil(F.count("*") / (LIMIT // 2)).cast("int").alias("blocks"))
    counts = materialize(counts, "pivot-blocks")
    block = F.xxhash64("pivot", F.pmod(F.xxhash64("cls"), F.col("blocks").cast("long")))
    members = apart.join(counts, "pivot").select(block.alias("block"), "cls")
    centres = counts.select("pivot", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("k")).select(
        F.xxhash64("pivot", F.col("k").cast("long")).alias("block"), F.col("pivot").alias("cls")
    )
    return _confirm(members.unionByName(centres).join(classes.select("cls", "n"), "cls"), classes, full, percent)


def _apart(crowds, classes, roots, full, percent: int) -> DataFrame:
    """Links of all pairs of each crowd that are in different components."""
    rows = crowds.withColumn("tree", F.lit(0)).join(_placed(classes.select("cls", "rep"), roots), "cls")
    rows = _parts_apart(rows)
    made = _blocks(rows, classes, percent)
    return _confirm(made.select("block", "cls", "n").distinct(), classes, full, percent)


def _parts_apart(rows: DataFrame) -> DataFrame:
    """Leaves of small parts of nodes (root, tree, cls, component) in which all pairs of different components meet.

    What is outside the largest component of a node meets all.
    """
    rows = materialize(rows.select("root", "tree", "cls", "component"), "crowds")
    held = rows.groupBy("root", "component").agg(F.count("*").alias("held"))
    sizes = held.groupBy("root").agg(
        F.sum("held").alias("members"), F.max(F.struct("held", "component")).alias("most")
    )
    sizes = sizes.where(F.col("members") > F.col("most.held")).select(
        "root",
        F.col("most.component").alias("main"),
        F.ceil(F.col("members") / (WHOLE * LIMIT // 2)).alias("parts"),
        F.ceil((F.col("members") - F.col("most.held")) / (WHOLE * LIMIT // 2)).alias("rest"),
    )
    rows = rows.join(materialize(sizes, "crowd-sizes"), "root")

    def dealt(out, own: str, other: str):
        mine = F.pmod(F.xxhash64("cls", F.lit(7)), F.col(own))
        return out.select("root", "tree", "cls", "component", mine.alias(own), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other))

    outside = dealt(rows.where(F.col("component") != F.col("main")), "rest", "parts")
    both = outside.unionByName(dealt(rows, "parts", "rest"))
    both = both.select(F.xxhash64("root", "rest", "parts").alias("path"), "tree", "cls", "component").distinct()
    return both.withColumn("root", F.lit(None).cast("long"))


def _blocks(leaves: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """``_leaf_blocks`` of leaves (path, tree, cls, and if known root and component), written."""
    if "root" not in leaves.columns:
        leaves = leaves.withColumn("root", F.lit(None).cast("long"))
    rows = leaves.join(classes.select("cls", "n", "tokens"), "cls").repartition("path").sortWithinPartitions("path")
    made = rows.mapInArrow(_leaf_blocks(percent), "block long, cls binary, n long, leaf int, tree int")
    return materialize(made, "blocks")


def deduplicate(docs: DataFrame, percent: int = 80) -> DataFrame:
    """``docs`` without the rows that are near copies of a document that stays."""
    gone = components(docs.select("doc_id", "text"), percent).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(materialize(gone, "copies"), "doc_id", "left_anti").select(*docs.columns)
