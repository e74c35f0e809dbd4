"""Suricata EVE records, one JSON object per line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripline.functions.text import blank_to_null
from tripline.functions.times import iso8601
from tripline.operators.parsing.common import ParseOptions, add_event

# Everything is read as text first, so one odd value does not void the record.
_RECORD = (
    "struct<timestamp:string,event_type:string,src_ip:string,src_port:string,dest_ip:string,dest_port:string,"
    "proto:string,app_proto:string,"
    "alert:struct<signature:string,signature_id:string,category:string,severity:string>>"
)


def one_json_value(line: Column, schema: str) -> Column:
    """The line parsed as ``schema``, null unless it is exactly one JSON value.

    A bare parse accepts trailing text; as the only element of an array it
    cannot.
    """
    wrapped = F.from_json(F.concat(F.lit("["), line, F.lit("]")), f"array<{schema}>")
    return F.when(F.size(wrapped) == 1, wrapped[0])


def parse_eve(df: DataFrame, line: Column, options: ParseOptions) -> DataFrame:
    record = F.when(F.startswith(line, F.lit("{")), one_json_value(line, _RECORD))
    df = df.withColumn("_eve", record)
    get = lambda name: F.col(f"_eve.{name}")
    alert = F.when(
        get("alert").isNotNull(),
        F.struct(
            get("alert.signature").alias("signature"),
            get("alert.signature_id").try_cast("bigint").alias("signature_id"),
            get("alert.category").alias("category"),
            get("alert.severity").try_cast("int").alias("severity"),
        ),
    )
    return add_event(
        df,
        recognized=F.col("_eve.timestamp").isNotNull(),
        ts=iso8601(get("timestamp")),
        source_ip=get("src_ip"),
        dest_ip=get("dest_ip"),
        protocol=blank_to_null(F.lower(get("proto"))),
        event_type=get("event_type"),
        src_port=get("src_port").try_cast("int"),
        dest_port=get("dest_port").try_cast("int"),
        app_proto=get("app_proto"),
        alert=alert,
    ).drop("_eve")
