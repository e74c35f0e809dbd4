"""Web access lines in the NCSA common or combined format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripline.functions.text import FLAGS, NONSPACE, capture, captured
from tripline.functions.times import ncsa
from tripline.operators.parsing.common import ParseOptions, add_event

_WORD = f"{NONSPACE}+"
# 1 ip 2 time 3 method 4 path 5 version 6 status 7 size 8 trailer 9 referer 10 agent
_LINE = (
    rf"{FLAGS}\A({_WORD}) {_WORD} {_WORD} \[([^\]]+)\] "
    rf'"([A-Z]+) ({_WORD}) ([^"]+)" (\d{{3}}) (\d+|-)'
    r'( "([^"]*)" "([^"]*)")?[\s\S]*\z'
)


def parse_access(df: DataFrame, line: Column, options: ParseOptions) -> DataFrame:
    df = df.withColumn("_web", capture(line, _LINE, 10))
    part = lambda i: F.col("_web")[i]
    combined = part(8) != ""
    return add_event(
        df,
        recognized=captured(F.col("_web")),
        ts=ncsa(part(2)),
        source_ip=part(1),
        protocol=F.lit("http"),
        method=part(3),
        path=part(4),
        http_version=part(5),
        status=part(6).try_cast("int"),
        size=part(7).try_cast("bigint"),
        referer=F.when(combined, part(9)),
        user_agent=F.when(combined, part(10)),
    ).drop("_web")
