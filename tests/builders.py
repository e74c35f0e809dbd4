"""Small event tables for unit tests."""

from datetime import datetime, timedelta

from pyspark.sql import Row
from pyspark.sql import functions as F

from tripline.schemas import EVENT, RAW

BASE = datetime(2024, 10, 10, 13, 55, 0)


def event(second, source_ip=None, protocol=None, *, id=None, dest_ip=None, **raw):
    return {"second": second, "source_ip": source_ip, "protocol": protocol, "id": id, "dest_ip": dest_ip, "raw": raw}


def burst(count, source_ip, protocol=None, **raw):
    return [event(i, source_ip, protocol, **raw) for i in range(count)]


def events(spark, specs):
    rows = [
        Row(
            event_id=str(spec["id"] if spec["id"] is not None else n),
            source_id=None,
            ts=BASE + timedelta(seconds=spec["second"]),
            source_ip=spec["source_ip"],
            dest_ip=spec["dest_ip"],
            protocol=spec["protocol"],
            raw=Row(*RAW.fieldNames())(*[spec["raw"].get(name) for name in RAW.fieldNames()]),
            ingest_ts=BASE,
            event_date=(BASE + timedelta(seconds=spec["second"])).date(),
        )
        for n, spec in enumerate(specs)
    ]
    return spark.createDataFrame(rows, EVENT)


def lines(spark, *texts):
    return spark.createDataFrame([(text,) for text in texts], "line string")


def enrichment(spark, **scores):
    rows = [(ip.replace("_", "."), score) for ip, score in scores.items()]
    return spark.createDataFrame(rows, "ip string, abuse_score int").withColumns(
        {
            "country": F.lit("Testland"),
            "city": F.lit("Test City"),
            "latitude": F.lit(1.5),
            "longitude": F.lit(2.5),
        }
    )
