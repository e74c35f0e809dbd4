"""Personal data: fixed patterns, and terms that corpus statistics show to reveal them (DataFrame functions only).

Base spans are leftmost matches of four kinds that do not overlap within a kind; a match
that fails its kind's test is dropped without another try.  Offsets are code points.

Information-theoretic sanitisation adds spans of kind ``term``.  A term is a word of letters
(hyphens may join its parts) that is not joined to digits, to a mark of addresses or, by a
full stop, to more of them; so it never overlaps a base span.  Over all different texts,

    disclosure(t, e) = PMI(t, e) / IC(e) = log2(n(t, e) N / (n(t) n(e))) / log2(N / n(e))

is the part of entity e's information that term t gives away; n counts texts that hold t, e
or both, copies of a text once, N all texts.  Chance is ruled out by significance, not by a
fixed number of texts: were t and e independent, n(t, e) or more joint texts would have a
probability of at most lambda^n / n! with lambda = n(t) n(e) / N.  That must not exceed
``ERROR`` divided by the number of pairs of entities and terms that occur twice or more.
Every occurrence of a disclosing term is marked, in every text, with an entity or without:
from ``GENERALISE`` on a general word takes its place, from ``REMOVE`` on nothing does.

Null text is empty.  Repeated rows get the same spans.  Empty tables give empty results;
other columns are carried along whatever their names, and columns named like results are
replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripline.operators.joins import at_most, join_per_key, lookup
from tripline.session import materialize

GENERALISE = 0.6
REMOVE = 0.9
ERROR = 0.01
#: Tables of counts are broadcast up to so many rows, and shuffled beyond.
BROADCAST_ROWS = 100_000
#: Numbers of rows whose text another row has are broadcast up to so many.
BROADCAST_COPIES = 2_000_000

#: Kind, what a text must hold for the pattern to be tried, pattern.  Each repetition is
#: possessive and may start only where no earlier start is possible, so matching is linear
#: in the text and needs no stack; the matches are those of the plain patterns.
KINDS = [
    (
        "email",
        "@",
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    ),
    ("ip", r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    ("card", r"[0-9](?:[\x20-]?[0-9]){15}", r"(?:\G|(?<![0-9]))[0-9](?:[\x20-]?[0-9])++"),
    ("phone", r"\+[0-9][\x20().0-9-]", r"\+[0-9][\x20().0-9-]+[0-9]"),
]
_PART = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
_IP = rf"^{_PART}(?:\.{_PART}){{3}}$"
_TERM = (
    r"(?<![\p{L}\p{N}_@.%+-])\p{L}++(?:-\p{L}++)*+"
    r"(?![\p{L}\p{N}_@%+-]|\.[\p{L}\p{N}._%+@-])"
)
_TERMS_IN_BLOCK = 256

_SPAN = "array<struct<kind:string,start:bigint,end:bigint,value:string>>"


def staged(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with ``columns``, each computed once however often it is used afterwards."""
    return df.drop(*columns).select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))


def running_sums(lengths: Column) -> Column:
    """Sums up to each element.  In blocks, as an array that grows by one is copied each time."""
    size = F.size(lengths)
    starts = F.when(size > 0, F.sequence(F.lit(0), F.floor((size - 1) / _TERMS_IN_BLOCK).cast("int"))).otherwise(
        F.array().cast("array<int>")
    )

    def sums(numbers: Column) -> Column:
        return F.aggregate(
            numbers,
            F.array().cast("array<bigint>"),
            lambda acc, x: F.array_append(acc, F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + x),
        )

    blocks = F.transform(starts, lambda b: sums(F.slice(lengths, b * _TERMS_IN_BLOCK + 1, _TERMS_IN_BLOCK)))
    ends = sums(F.transform(blocks, lambda b: F.element_at(b, -1)))
    return F.flatten(
        F.zip_with(blocks, ends, lambda b, end: F.transform(b, lambda x: x + end - F.element_at(b, -1)))
    )


def find(text: Column, pattern: str) -> Column:
    """start, end and value of every match, from the texts between matches."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    lengths = F.zip_with(
        F.slice(between, 1, F.size(matches)), matches, lambda a, b: (F.length(a) + F.length(b)).cast("bigint")
    )
    return F.zip_with(
        running_sums(lengths),
        matches,
        lambda end, m: F.struct((end - F.length(m)).alias("start"), end.alias("end"), m.alias("value")),
    )


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True if the check digit fits."""

    def worth(i: Column) -> Column:
        digit = F.substring(digits, i, F.lit(1)).cast("int")
        twice = digit * 2
        return F.when((F.length(digits) - i) % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(digit)

    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda acc, i: acc + worth(i))
    return total % 10 == 0


def _holds(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return value.rlike(_IP)
    size = F.length(_digits(value))
    if kind == "card":
        return F.when(size.between(16, 19), luhn(_digits(value))).otherwise(False)
    return size.between(8, 15)


def _kept(kind: str, found: Column) -> Column:
    """The matches of a kind that pass its test."""
    good = F.filter(found, lambda s: _holds(kind, s["value"]))
    return F.transform(
        good, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"], s["end"], s["value"])
    ).cast(_SPAN)


def _of_kind(kind: str) -> Column:
    return F.filter("base_spans", lambda s: s["kind"] == kind)


def base_spans(df: DataFrame, text: str = "text", spans: str = "base_spans") -> DataFrame:
    """``df`` with its base spans: kind, start, end, value; by kind, then start."""
    content = F.coalesce(F.col(text), F.lit(""))
    none = F.array().cast("array<struct<start:bigint,end:bigint,value:string>>")
    found = {}
    for kind, gate, pattern in KINDS:
        maybe = F.contains(content, F.lit(gate)) if gate == "@" else content.rlike(gate)
        found[f"_{kind}"] = F.when(maybe, find(content, pattern)).otherwise(none)
    df = staged(df, **found)
    parts = [_kept(kind, F.col(f"_{kind}")) for kind, _, _ in KINDS]
    return staged(df, **{spans: F.concat(*parts)}).drop(*found)


def _entities() -> Column:
    """The entities of a row's base spans, numbers without their marks."""

    def name(span: Column) -> Column:
        value = F.when(span["kind"].isin("card", "phone"), _digits(span["value"])).otherwise(F.lower(span["value"]))
        return F.concat_ws(":", span["kind"], value)

    return F.array_distinct(F.transform("base_spans", name))


def prepared(rows: DataFrame) -> DataFrame:
    """base_spans, key of the text, its distinct terms and a number of each of ``rows`` (text); to be written once."""
    content = F.coalesce(F.col("text"), F.lit(""))
    terms = F.transform(F.regexp_extract_all(content, F.lit(_TERM), F.lit(0)), F.lower)
    made = {"key": F.md5(content), "words": F.array_distinct(terms), "row": F.monotonically_increasing_id()}
    return base_spans(rows.select("text")).withColumns(made).drop("text")


def firsts(rows: DataFrame) -> DataFrame:
    """``rows`` of ``prepared``, written, without those whose text an earlier one has.

    Only the numbers of rows that go are sent to the others, so rows with their terms stay where they are.
    """
    repeated = rows.groupBy("key").agg(F.min("row").alias("first"), F.count("*").alias("copies")).where("copies > 1")
    repeated = materialize(repeated, "pii-repeated")
    copies = join_per_key(rows.select("key", "row"), repeated, "key", "copies", at_most(repeated, BROADCAST_ROWS))
    copies = materialize(copies.where(F.col("row") > F.col("first")).select("row"), "pii-copies")
    return rows.join(F.broadcast(copies) if at_most(copies, BROADCAST_COPIES) else copies, "row", "left_anti")


def disclosures(texts: DataFrame) -> DataFrame:
    """entity, term, joint, disclosure of the pairs that reach ``GENERALISE`` and are no chance.

    ``texts`` are those of ``firsts``.  Terms and entities are counted before they
    meet; a pair is made only where its counts can reach the threshold, which leaves out
    frequent words, and where both occur twice or more, without which no pair is significant.
    """
    holding = texts.where(F.size("base_spans") > 0)
    total = texts.select("row").count()
    entities = holding.select(F.explode(_entities()).alias("entity")).groupBy("entity")
    entities = entities.agg(F.count("*").alias("n_entity")).where(F.col("n_entity") >= 2)
    entities = materialize(entities, "pii-entities")
    n_entities, widest = entities.agg(F.count("*"), F.max(F.when(F.col("n_entity") < total, F.col("n_entity")))).first()
    if widest is None:
        return texts.sparkSession.createDataFrame([], "entity string, term string, joint bigint, disclosure double")
    terms = texts.select(F.explode("words").alias("term")).groupBy("term").agg(F.count("*").alias("n_term"))
    terms = materialize(terms.where("n_term >= 2"), "pii-terms")
    n_terms = terms.count()

    def most(n_entity: Column) -> Column:
        """A term in more texts cannot give away so much of the entity (with room for rounding)."""
        return F.pow(n_entity / F.lit(float(total)), F.lit(GENERALISE)) * F.lit(total * (1 + 1e-9))

    held = holding.select("row", F.explode(_entities()).alias("entity"))
    told = entities.where(F.col("n_entity") < total)
    held = join_per_key(held, _weighed(told, "n_entity"), "entity", "weight", at_most(told, BROADCAST_ROWS))
    held = materialize(held, "pii-held")
    beside = holding.join(held.select("row").distinct(), "row", "left_semi")
    beside = beside.select("row", F.explode("words").alias("term"))
    able = terms.where(F.col("n_term") <= most(F.lit(widest)))
    beside = join_per_key(beside, _weighed(able, "n_term"), "term", "weight", at_most(able, BROADCAST_ROWS))
    pairs = (
        held.join(beside, "row")
        .where(F.col("n_term") <= most(F.col("n_entity")))
        .groupBy("entity", "term")
        .agg(F.count("*").alias("joint"), F.first("n_entity").alias("n_entity"), F.first("n_term").alias("n_term"))
    )
    chance = F.col("n_term") * F.col("n_entity") / F.lit(float(total))
    joint = F.col("joint").cast("double")
    # Stirling's formula is below n!, so the bound holds.
    factorial = joint * F.log(joint) - joint + 0.5 * F.log(2 * F.pi() * joint)
    allowed = F.log(F.lit(ERROR)) - F.log(F.lit(float(max(n_entities * n_terms, 1))))
    known = F.log2(F.lit(float(total)) / F.col("n_entity"))
    return (
        pairs.where(F.col("joint") >= 2)
        .where(joint * F.log(chance) - factorial <= allowed)
        .select("entity", "term", "joint", (F.log2(joint / chance) / known).alias("disclosure"))
        .where(F.col("disclosure") >= GENERALISE)
    )


def _weighed(counts: DataFrame, count: str) -> DataFrame:
    return counts.withColumn("weight", F.col(count))


def marks(rows: DataFrame) -> DataFrame:
    """key (md5 of a text), its ``base_spans`` and ``disclosed`` (term to disclosure, null if none), where there are any.

    ``rows`` are those of ``prepared``, written.
    """
    texts = firsts(rows)
    worst = disclosures(texts).groupBy("term").agg(F.max("disclosure").alias("d"))
    worst = materialize(worst, "pii-revealing")
    hit = lookup(texts.select("row", F.explode("words").alias("term")), worst, "term", BROADCAST_ROWS)
    hit = hit.where("d IS NOT NULL").groupBy("row")
    hit = hit.agg(F.map_from_entries(F.collect_list(F.struct("term", "d"))).alias("disclosed"))
    some = texts.select("key", "row", "base_spans").join(hit, "row", "left")
    return some.where((F.size("base_spans") > 0) | F.col("disclosed").isNotNull()).drop("row")


def term_spans(rows: DataFrame) -> DataFrame:
    """``rows`` with ``terms`` (kind, start, end, value: the disclosure) instead of ``disclosed``, sought in their text."""
    none = F.array().cast("array<string>")
    has = F.col("disclosed").isNotNull()
    # As ``find``, but step by step: of so many matches, none may be sought again for each block of sums.
    rows = staged(
        rows,
        found=F.when(has, F.regexp_extract_all("text", F.lit(_TERM), F.lit(0))).otherwise(none),
        between=F.when(has, F.split("text", _TERM, -1)).otherwise(none),
    )
    rows = staged(
        rows,
        sizes=F.zip_with(
            F.slice("between", 1, F.size("found")), "found", lambda a, b: (F.length(a) + F.length(b)).cast("bigint")
        ),
        worth=F.transform("found", lambda m: F.try_element_at("disclosed", F.lower(m))),
    ).drop("between")
    every = F.when(F.size("worth") > 0, F.sequence(F.lit(1), F.size("worth"))).otherwise(F.array().cast("array<int>"))
    rows = staged(rows, at=F.filter(every, lambda i: F.element_at("worth", i).isNotNull())).drop("disclosed")
    # What lies between the disclosing matches is added up first, as there are few of these.
    before = F.concat(F.array(F.lit(0)), F.col("at"))
    gaps = F.zip_with(
        F.slice(before, 1, F.size("at")),
        "at",
        lambda a, b: F.aggregate(F.slice("sizes", a + 1, b - a), F.lit(0).cast("bigint"), lambda x, y: x + y),
    )
    rows = staged(staged(rows, gaps=gaps).drop("sizes"), ends=running_sums(F.col("gaps"))).drop("gaps")
    place = F.zip_with(
        "at",
        "ends",
        lambda i, e: F.struct(
            F.lit("term").alias("kind"),
            (e - F.length(F.element_at("found", i))).alias("start"),
            e.alias("end"),
            F.element_at("worth", i).cast("string").alias("value"),
        ),
    )
    return staged(rows, terms=place.cast(_SPAN)).drop("found", "worth", "at", "ends")


def _numbered(docs: DataFrame, text: str) -> tuple[dict[str, str], DataFrame]:
    """Other columns go by number meanwhile, so none can clash with those made here."""
    carried = {c: f"_in_{i}" for i, c in enumerate(docs.columns) if c != text}
    renamed = [F.col(f"`{c}`").alias(name) for c, name in carried.items()]
    return carried, docs.select(*renamed, F.col(f"`{text}`").alias("text"))


def _marked(rows: DataFrame) -> DataFrame:
    """``rows`` (text, ...) with ``base_spans`` and ``terms``; they meet what was found in their texts by a key of it."""
    found = marks(materialize(prepared(rows), "pii-rows", compression="zstd"))
    key = F.md5(F.coalesce(F.col("text"), F.lit("")))
    rows = rows.withColumn("key", key).join(found, "key", "left").drop("key")
    base = F.coalesce("base_spans", F.array().cast(_SPAN))
    return term_spans(rows.withColumn("base_spans", base))


def find_all(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without its text, with ``base_spans`` and ``terms`` (kind, start, end, value)."""
    carried, rows = _numbered(docs, text)
    kept = [F.col(name).alias(c) for c, name in carried.items() if c not in ("base_spans", "terms")]
    return _marked(rows).select(*kept, "base_spans", "terms")


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span of its text replaced: base spans by their kind, terms by a general word or nothing."""
    carried, rows = _numbered(docs, text)
    rows = _marked(rows)
    spans = F.array_sort(
        F.transform(
            F.concat("base_spans", "terms"),
            lambda s: F.struct(s["start"], (-s["end"]).alias("back"), s["end"], s["kind"], s["value"]),
        )
    )
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def replaced(acc: Column, s: Column) -> Column:
        word = F.when(s["kind"] != "term", F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
        word = word.when(s["value"].cast("double") >= REMOVE, "").otherwise("[TERM]")
        before = F.substring("text", (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        fresh = F.concat(acc["out"], before, word)
        # Of spans with one start the longest is first.  A span that overlaps an earlier one is covered by that one's word.
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(s["start"] >= acc["at"], fresh).otherwise(acc["out"]).alias("out"),
        )

    cleaned = F.aggregate(
        spans, start, replaced, lambda acc: F.concat(acc["out"], F.substring("text", (acc["at"] + 1).cast("int"), F.length("text")))
    )
    cleaned = F.when(F.size(spans) > 0, cleaned).otherwise(F.col("text"))
    return rows.select(*[cleaned.alias(c) if c == text else F.col(carried[c]).alias(c) for c in docs.columns])


def digest(found: DataFrame) -> DataFrame:
    """doc_id, counts of each base kind, base_sha256 and spans of ``find_all``'s rows."""

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    counts = [
        F.size(_of_kind(kind)).cast("long").alias(f"n_{kind}") for kind, _, _ in KINDS
    ]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(listed(F.col("base_spans")), 256).alias("base_sha256"),
        listed(F.concat("base_spans", "terms")).alias("spans"),
    )
