"""Best-effort extraction from lines of no known format.

Structured data (a JSON object, or ``key=value`` pairs) is trusted first and
free text fills the gaps.  A non-blank line is never dropped.
"""

from __future__ import annotations

import json
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripline.functions.text import FLAGS, NONSPACE, SPACE, blank_to_null, clean_ip, is_ipv4, to_int
from tripline.functions.times import epoch, iso8601, ncsa, syslog
from tripline.operators.parsing.common import ParseOptions, add_event, stage
from tripline.operators.parsing.eve import one_json_value

# Key names (lower case, '_' for '-' and ' ') that carry a field.
ALIASES = {
    "source_ip": (
        "src_ip", "source_ip", "sourceip", "client_ip", "clientip", "remote_addr", "remote_ip", "c_ip",
        "cip", "ip", "src", "source", "client", "remote",
    ),
    "dest_ip": ("dest_ip", "dst_ip", "destip", "destination_ip", "server_ip", "dst", "destination"),
    "dest_port": ("dest_port", "dst_port", "dstport", "destination_port", "port", "dport"),
    "timestamp": ("timestamp", "@timestamp", "time", "datetime", "date", "eventtime", "event_time", "_time", "ts"),
    "protocol": ("proto", "protocol", "transport", "app_proto"),
    "path": ("path", "url", "uri", "request", "request_uri", "uri_stem", "cs_uri_stem"),
    "method": ("method", "verb", "request_method", "cs_method"),
    "status": ("status", "status_code", "statuscode", "response", "sc_status", "response_code"),
    "username": ("user", "username", "user_name", "account", "userid", "uid", "cs_username"),
    "outcome": ("outcome", "result", "action", "event_outcome", "auth_result"),
}
# Protocol tokens in order of preference, and words of failure.
PROTOCOLS = ("http", "ssh", "tcp", "udp", "dns", "ftp", "smtp")
FAILURE = r"\b(?:fail|failed|failure|invalid|denied|deny|unauthor\w*|reject\w*|error)\b"
# Upper-case text of which one occurs wherever FAILURE matches.
_FAILURE_HINTS = ("FAIL", "INVALID", "DEN", "UNAUTHOR", "REJECT", "ERROR")

# What the entities of a line look like.
_IP = r"(?:\d{1,3}\.){3}\d{1,3}"
_REQUEST = rf'{FLAGS}"([A-Z]+){SPACE}+({NONSPACE}+){SPACE}+HTTP/[0-9.]+"'
_STATUS = rf'{FLAGS}"{SPACE}+(\d{{3}})\b'
_PAIR = rf'{FLAGS}[A-Za-z_][\w.\-]*=(?:"[^"\\]*+(?:\\.[^"\\]*+)*+"|{NONSPACE}+)'
_ISO = rf"{FLAGS}\b(\d{{4}}-\d{{2}}-\d{{2}}[ T]\d{{2}}:\d{{2}}:\d{{2}}(?:\.\d+)?(?:Z|[+-]\d{{2}}:?\d{{2}})?)\b"
_NCSA = rf"{FLAGS}\[(\d{{2}}/[A-Za-z]{{3}}/\d{{4}}:\d{{2}}:\d{{2}}:\d{{2}}{SPACE}*[+-]\d{{4}})\]"
_SYSLOG = rf"{FLAGS}\b([A-Z][a-z]{{2}}{SPACE}+\d{{1,2}}{SPACE}+\d{{2}}:\d{{2}}:\d{{2}})\b"


@F.pandas_udf(T.StringType())
def flatten_json(lines: pd.Series) -> pd.Series:
    """The JSON object with its nested scalars moved to the top, under dotted
    keys in document order; null for lines that are not one JSON object.

    Variants sort the keys of nested objects, and picking the first alias needs
    document order, so nested lines (only) are flattened here.
    """
    return lines.map(_flatten_line, na_action="ignore")


def parse_generic(df: DataFrame, line: Column, options: ParseOptions) -> DataFrame:
    df = _structured(df, line)
    df = _freetext(df, line, options)
    pick = lambda name: F.col(f"_pick_{name}")
    text = lambda name: F.col(f"_text_{name}")
    kind = lambda name: F.col(f"_kind_{name}")
    value = lambda name: F.coalesce(pick(name), text(name))

    def only_text(name: str) -> Column:
        # A non-text value is not used, yet keeps free text from being used.
        return F.when(pick(name).isNull(), text(name)).when(kind(name) == "STRING", pick(name))

    def whole(name: str) -> Column:
        return F.when(kind(name).isin("STRING", "BIGINT"), to_int(pick(name))).try_cast("int")

    has_fields = F.coalesce(F.size("_fields") > 0, F.lit(False))
    temporary = [c for c in df.columns if c.startswith(("_pick_", "_kind_", "_text_"))]
    return add_event(
        df,
        recognized=line.isNotNull(),
        ts=F.coalesce(_structured_time(pick("timestamp"), kind("timestamp")), text("timestamp"), options.stamp),
        source_ip=clean_ip(only_text("source_ip")),
        dest_ip=clean_ip(only_text("dest_ip")),
        protocol=F.lower(only_text("protocol")),
        outcome=value("outcome"),
        dest_port=whole("dest_port"),
        path=value("path"),
        method=value("method"),
        status=F.when(pick("status").isNull(), text("status").try_cast("int")).otherwise(whole("status")),
        username=pick("username"),
        fields=F.when(has_fields, F.col("_fields")),
        message=F.when(~has_fields, line),
    ).drop("_fields", *temporary)


def _structured(df: DataFrame, line: Column) -> DataFrame:
    """``_fields``: a map of variants in document order; ``_pick_*`` and
    ``_kind_*``: the first usable value of each known field and its type."""
    fields = "map<string,variant>"
    df = df.withColumn("_shallow", F.when(line.rlike(r"\A\{[^\[{]*\z"), one_json_value(line, fields)))
    keys = F.map_keys("_shallow")
    clean = F.col("_shallow").isNotNull() & (F.size(F.array_distinct(keys)) == F.size(keys))
    df = df.withColumn("_deep", flatten_json(F.when(F.startswith(line, F.lit("{")) & ~clean, line)))
    df = df.withColumn("_pairs", F.when(~clean & F.col("_deep").isNull(), _pairs(line)))
    df = stage(df, _keys=F.col("_pairs.key"), _late_keys=F.reverse("_pairs.key"), _late_values=F.reverse("_pairs.value"))
    df = stage(
        df,
        _fields=F.coalesce(
            F.when(clean, F.col("_shallow")),
            F.from_json("_deep", fields),
            F.when(F.size("_pairs") >= 2, _last_of_each()),
        ),
    )
    df = df.drop("_shallow", "_deep", "_pairs", "_keys", "_late_keys", "_late_values")
    df = stage(df, _usable=_usable(F.map_entries("_fields")))
    # Looked up by place: a filter for each field would run by the entry and keep the step from being compiled.
    first = lambda name: F.get("_usable", (F.array_position("_usable.field", name) - 1).cast("int"))
    picked = {f"_pick_{name}": first(name).text for name in ALIASES}
    return stage(df, **picked, **{f"_kind_{name}": first(name).kind for name in ALIASES}).drop("_usable")


def _pairs(line: Column) -> Column:
    """All ``key=value`` pairs of the line, quotes around a value removed."""
    found = F.when(F.contains(line, F.lit("=")), F.regexp_extract_all(line, F.lit(_PAIR), F.lit(0)))

    def split(pair: Column) -> Column:
        key = F.substring_index(pair, "=", 1)
        value = F.substr(pair, F.length(key) + 2)
        quoted = value.rlike(r'\A"[\s\S]*"\z')
        return F.struct(
            key.alias("key"), F.when(quoted, F.substr(value, F.lit(2), F.length(value) - 2)).otherwise(value).alias("value")
        )

    return F.transform(found, split)


def _last_of_each() -> Column:
    """The pairs as a map: a repeated key keeps its first place and takes its last value."""
    keys = F.array_distinct("_keys")
    newest = F.transform(
        keys, lambda k: F.get("_late_values", (F.array_position("_late_keys", k) - 1).cast("int")).cast("variant")
    )
    values = F.transform("_pairs", lambda e: e.value.cast("variant"))
    return F.map_from_arrays(keys, F.when(F.size(keys) == F.size("_pairs"), values).otherwise(newest))


def _usable(fields: Column) -> Column:
    """The entries that carry a known field and are not empty."""
    leaf = lambda e: F.translate(F.lower(F.substring_index(e.key, ".", -1)), "- ", "__")
    leaves = F.transform(fields, lambda e: F.struct(leaf(e).alias("leaf"), e.value.alias("value")))
    every = [key for keys in ALIASES.values() for key in keys]
    known = F.filter(leaves, lambda e: e.leaf.isin(*every))

    def named(entry: Column) -> Column:
        name = F.coalesce(*[F.when(entry.leaf.isin(*keys), F.lit(name)) for name, keys in ALIASES.items()])
        return F.struct(
            name.alias("field"),
            entry.value.cast("string").alias("text"),
            F.schema_of_variant(entry.value).alias("kind"),
        )

    return F.filter(F.transform(known, named), lambda e: e.text != "")


def _structured_time(text: Column, kind: Column) -> Column:
    truth = text.try_cast("boolean").cast("double")
    number = F.when(kind == "BOOLEAN", truth).otherwise(text.try_cast("double"))
    return F.when(kind == "STRING", iso8601(text)).otherwise(epoch(number))


def _freetext(df: DataFrame, line: Column, options: ParseOptions) -> DataFrame:
    """``_text_*``: what plain text says about fields that were not picked.

    Cheap substring tests come before each pattern: most lines lack most of
    the entities.
    """
    lacks = lambda *names: reduce(or_, [F.col(f"_pick_{name}").isNull() for name in names])
    seek_address = lacks("source_ip", "dest_ip") & line.rlike(r"(?U)\d\.\d{1,3}\.\d")
    seek_request = lacks("protocol", "path", "method", "status") & F.contains(line, F.lit("HTTP/"))
    seek_time = F.col("_pick_timestamp").isNull() | (F.col("_kind_timestamp") == "STRING")
    df = stage(
        df,
        _address=seek_address,
        _from=F.when(seek_address, _first(line, rf"(?Udi)\bfrom{SPACE}+({_IP})\b")),
        _method=F.when(seek_request, _first(line, _REQUEST)),
        _lowered=F.when(lacks("protocol"), F.lower(line)),
        # Upper case folds everything the ignore-case pattern would.
        _upper=F.when(lacks("outcome"), F.upper(line)),
        _clock=seek_time & line.rlike(r"(?U)\d\d:\d\d:\d\d"),
    )
    addresses = F.filter(F.regexp_extract_all(line, F.lit(rf"{FLAGS}\b{_IP}\b"), F.lit(0)), is_ipv4)
    df = stage(
        df,
        _ips=F.when(F.col("_address") & F.col("_from").isNull(), addresses),
        _iso=F.when(F.col("_clock"), _first(line, _ISO)),
        _ncsa=F.when(F.col("_clock") & F.contains(line, F.lit("[")), _first(line, _NCSA)),
    )
    request = F.col("_method").isNotNull()
    protocol = F.when(request, F.lit("http"))
    for token in PROTOCOLS:
        named = F.contains("_lowered", F.lit(token)) & F.col("_lowered").rlike(rf"{FLAGS}\b{token}")
        protocol = protocol.when(named, F.lit(token))
    to_address = F.when(F.col("_address"), _first(line, rf"(?Udi)\bto{SPACE}+({_IP})\b"))
    hinted = reduce(or_, [F.contains("_upper", F.lit(hint)) for hint in _FAILURE_HINTS])
    embedded = F.coalesce(
        iso8601(F.col("_iso")),
        ncsa(F.col("_ncsa")),
        F.when(F.col("_clock"), syslog(_first(line, _SYSLOG), options.syslog_year)),
    )
    return stage(
        df,
        _text_source_ip=F.coalesce("_from", F.get("_ips", F.lit(0))),
        _text_dest_ip=F.coalesce(to_address, F.get("_ips", F.lit(1))),
        _text_protocol=protocol,
        _text_method=F.col("_method"),
        _text_path=F.when(request, F.regexp_extract(line, _REQUEST, 2)),
        _text_status=F.when(request, _first(line, _STATUS)),
        _text_outcome=F.when(hinted & line.rlike(f"(?Udi){FAILURE}"), F.lit("failed")),
        _text_timestamp=embedded,
    ).drop("_address", "_from", "_method", "_lowered", "_upper", "_clock", "_iso", "_ncsa", "_ips")


def _first(line: Column, pattern: str) -> Column:
    return blank_to_null(F.regexp_extract(line, pattern, 1))


def _flatten_line(line: str) -> str | None:
    try:
        document = json.loads(line)
    except (ValueError, RecursionError):  # no JSON, or nested too deeply: the line is text
        return None
    if not isinstance(document, dict):
        return None
    leaves: dict[str, object] = {}
    pending = [("", "", document)]
    while pending:
        path, prefix, node = pending.pop()
        if isinstance(node, (dict, list)):
            children = list(node.items() if isinstance(node, dict) else enumerate(node))
            pending.extend((f"{prefix}{name}", f"{prefix}{name}.", child) for name, child in reversed(children))
        else:
            leaves[path] = node
    return json.dumps(leaves)
