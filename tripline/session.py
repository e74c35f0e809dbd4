"""Session helpers and lineage cuts."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: The state store that streams with maps and timers need.
STATE_STORE = (
    "spark.sql.streaming.stateStore.providerClass",
    "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
)
#: Where a session on one machine notes its folder.
_LOCAL_SCRATCH = "tripline.scratch.dir"


def build_session(app_name: str = "tripline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators rely on.

    Timestamps are handled in UTC throughout.  Shuffle partitioning is left to
    adaptive execution, which coalesces small partitions and splits skewed ones.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        STATE_STORE[0]: STATE_STORE[1],
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def state_session(spark: SparkSession) -> SparkSession:
    """A session beside ``spark`` with its settings and the state store that ``build_session`` sets.

    The settings of ``spark`` stay as they are.
    """
    scratch_dir(spark)
    beside = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(key) or key == _LOCAL_SCRATCH:
            beside.conf.set(key, value)
    beside.conf.set(*STATE_STORE)
    return beside


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    A session on one machine that names none gets a local folder, recorded in
    the session.  On a cluster that would scatter files over executors' disks.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(_LOCAL_SCRATCH, None)
    if not configured:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="tripline-")
        spark.conf.set(_LOCAL_SCRATCH, configured)  # Spark does not let its own setting be changed
    return configured.rstrip("/")


def materialize(df: DataFrame, label: str = "stage", compression: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared scratch folder and read it back.

    Used where a result feeds several jobs: later jobs start from files that
    outlive any executor, and the planner sees their true size.  Large ones
    may be written with a closer ``compression``.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/tripline-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)
