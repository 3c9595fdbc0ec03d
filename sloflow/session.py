"""Session settings and the shared row types."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession
from pyspark.sql import types as T

STRING_MAP = T.MapType(T.StringType(), T.StringType())

CLASSIFICATION = T.StructType(
    [T.StructField(name, T.StringType()) for name in ("domain", "app", "class")]
)

RAW_EVENT = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("event_time", T.TimestampType()),
        T.StructField("metadata", STRING_MAP),
        T.StructField("classification", CLASSIFICATION),
        T.StructField("quantity", T.DoubleType()),
    ]
)

SAMPLE = T.StructType(
    [
        T.StructField("labels", STRING_MAP),
        T.StructField("ts", T.TimestampType()),
        T.StructField("value", T.DoubleType()),
    ]
)


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the operators rely on and return the session.

    Merging string maps means "the right side wins", and all times are UTC.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    # A month of minutes of one series stays in memory during window functions (a few MB per task).
    spark.conf.set("spark.sql.windowExec.buffer.in.memory.threshold", "65536")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named in ``spark.checkpoint.dir``.

    A local folder is made only where the setting is absent and Spark runs in one process.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    created = tempfile.mkdtemp(prefix="sloflow-")
    spark.conf.set("spark.checkpoint.dir", created)
    return created


def small_table(spark: SparkSession, rows: list, schema, limit: int = 8_000_000):
    """A DataFrame from configuration, marked for broadcast if its text has at most ``limit`` characters.

    Spark does not know the size of a table made from Python rows and would shuffle the events to
    join it.  Here the rows are known, so their size is.
    """
    from pyspark.sql import functions as F

    table = spark.createDataFrame(rows, schema)
    return F.broadcast(table) if sum(len(repr(row)) for row in rows) <= limit else table


def materialize(df, name: str):
    """Write a reused intermediate result to the shared folder and read it back.

    Unlike ``cache`` the copy survives lost executors, and the lineage behind it is cut.
    """
    import uuid

    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
