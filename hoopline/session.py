"""Session helpers: a default local builder and the shared scratch folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL_SCRATCH: dict[str, str] = {}

#: How tables of documents are written. A document may have megabytes, and readers hold the text of up to 4,096 rows of a row group at once, so
#: row groups are small (a megabyte as compressed, some seven of text) and their size is looked at every few rows.
DOCUMENT_WRITES = {"parquet.block.size": 1 << 20, "parquet.block.size.row.check.min": 4, "parquet.page.size.row.check.min": 4}
#: Lists as large as documents that a task holds while it gathers them, before it sorts its rows instead.
GATHERED_AT_ONCE = 16


def build_session(app: str = "hoopline", master: str = "local[8]", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the bench. On a cluster, pass in your own session instead."""
    return (
        SparkSession.builder.appName(app)
        .master(master)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.sources.partitionColumnTypeInference.enabled", "false")
        .config("spark.driver.memory", "8g")
        # Small local tables still spread over all cores; a cluster keeps Spark's own sizes.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128k")
        .config("spark.sql.files.openCostInBytes", "128k")
        # Recording the Python line of every expression costs more than building the plan.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; where it is unset, a temp folder in local mode and an error on a cluster."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if configured:
        return configured.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("Set spark.checkpoint.dir to a folder that the driver and all executors share")
    application = spark.sparkContext.applicationId
    if application not in _LOCAL_SCRATCH:
        _LOCAL_SCRATCH[application] = tempfile.mkdtemp(prefix="hoopline-")
    return _LOCAL_SCRATCH[application]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the scratch folder; nothing is ever written over."""
    return f"{scratch_root(spark)}/hoopline/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written below the scratch folder and read back: read often, worked out once, and not again when an executor is lost."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def gathering_documents(spark: SparkSession) -> Iterator[None]:
    """Within it, tasks that gather lists hold ``GATHERED_AT_ONCE`` of them, whose memory Spark does not count, and not 128."""
    key = "spark.sql.objectHashAggregate.sortBased.fallbackThreshold"
    before = spark.conf.getAll.get(key)
    spark.conf.set(key, str(GATHERED_AT_ONCE))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)
