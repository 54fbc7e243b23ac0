"""Session settings, the shared work folder and the broadcast check."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


# Most bytes of column values that a broadcast side may have.
MAX_BROADCAST_BYTES = 64 << 20


def local_session(app: str = "murmur", cores: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and for the benchmark; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder for one job's tables, on a file system all executors share.

    The cluster names its folder in ``spark.checkpoint.dir``; without one, the
    folder is made under ``spark.sql.warehouse.dir``, which must not be a
    machine's own unless the session is local. It goes when the driver ends, as
    results may be read from it until then.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir") + "/_work"
        if base.startswith("file:") and not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir: the warehouse is a local folder that executors don't share")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(path)
    return path.toString()


def fits_broadcast(df: DataFrame, max_rows: int = 500_000, max_bytes: int = MAX_BROADCAST_BYTES) -> bool:
    """Whether ``df`` is proven small enough to broadcast.

    Reads at most ``max_rows + 1`` rows of the small side and measures them;
    the answer is exact, not an estimate.
    """
    width = F.lit(0)
    for field in df.schema.fields:
        width = width + F.coalesce(F.octet_length(F.col(field.name).cast("string")), F.lit(0))
    seen = df.limit(max_rows + 1).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(width), F.lit(0)).alias("bytes"))
    row = seen.first()
    return row["n"] <= max_rows and row["bytes"] <= max_bytes
