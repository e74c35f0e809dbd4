"""SSH authentication lines of a syslog file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripline.functions.text import FLAGS, NONSPACE, SPACE, blank_to_null, capture, captured
from tripline.functions.times import syslog
from tripline.operators.parsing.common import ParseOptions, add_event

_WORD = f"({NONSPACE}+)"
_PEER = rf"{_WORD} from {_WORD} port (\d+)"
# 1 time; failed: 2 marker 3 user 4 ip 5 port; accepted: 6 7 8; invalid: 9 user 10 ip
_LINE = (
    rf"{FLAGS}\A(\w{{3}}{SPACE}+\d+{SPACE}+\d{{2}}:\d{{2}}:\d{{2}}){SPACE}+{NONSPACE}+{SPACE}+sshd\[\d+\]:{SPACE}+"
    rf"(?:Failed password for (invalid user )?{_PEER}"
    rf"|Accepted password for {_PEER}"
    rf"|Invalid user {_WORD} from {_WORD})[\s\S]*\z"
)


def parse_auth(df: DataFrame, line: Column, options: ParseOptions) -> DataFrame:
    df = df.withColumn("_auth", capture(line, _LINE, 10))
    part = lambda i: blank_to_null(F.col("_auth")[i])
    failed = F.when(part(2).isNotNull(), "invalid_user").otherwise("failed")
    return add_event(
        df,
        recognized=captured(F.col("_auth")),
        ts=syslog(part(1), options.syslog_year),
        source_ip=F.coalesce(part(4), part(7), part(10)),
        protocol=F.lit("ssh"),
        outcome=F.when(part(3).isNotNull(), failed).when(part(6).isNotNull(), "accepted").otherwise("invalid_user"),
        username=F.coalesce(part(3), part(6), part(9)),
        source_port=F.coalesce(part(5), part(8)).try_cast("int"),
        # A bare "Invalid user" line names neither port nor service.
        service=F.when(part(9).isNull(), "sshd"),
    ).drop("_auth")
