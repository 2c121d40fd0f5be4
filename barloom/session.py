"""Session defaults and the shared folder that survives executor loss."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Runtime settings every job of this library expects. All of them are per-session SQL settings, so
# they can also be applied to a session that somebody else built.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # The JVM never compiles a method beyond this many bytes: a stage of many columns would be interpreted for every row.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}

#: A table is broadcast by hint only if its proven size stays below this many bytes.
BROADCAST_LIMIT_BYTES = 64 * 1024 * 1024


#: Folder of each local application whose session names none; the setting is read-only at run time.
_LOCAL_FOLDERS: dict[str, str] = {}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("barloom")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.showConsoleProgress", "false")
        # Each window frame is a generated class of its own; a wide build has more than the default cache holds.
        .config("spark.sql.codegen.cache.maxEntries", "10000")
        # Call sites of single column expressions cost more than the plans of wide feature sets.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in RUNTIME_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder: on a cluster a machine-local path
    would be lost with the machine, so there the setting is required.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[app] = tempfile.mkdtemp(prefix="barloom-")
    return _LOCAL_FOLDERS[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    return os.path.join(shared_folder(spark), f"{name}-{uuid.uuid4().hex}")


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write a derived table to the shared folder and read it back.

    Cuts the lineage in a way that survives executor loss and gives Catalyst exact file sizes, so
    its own broadcast threshold decides on real numbers.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_within(df: DataFrame, max_rows: int, row_bytes: int) -> DataFrame:
    """Broadcast hint only when ``max_rows * row_bytes`` is a proven bound below the limit.

    Beyond it the frame is returned untouched: the join is then a shuffle join under AQE, which
    still splits skewed partitions.
    """
    if max_rows * row_bytes <= BROADCAST_LIMIT_BYTES:
        return F.broadcast(df)
    return df


def calendar_days(df: DataFrame, date: str = "date") -> int:
    """Upper bound for the number of distinct dates: the span of the date column in days.

    One aggregate over a single pruned column; the result is two scalars.
    """
    lo, hi = df.agg(F.min(date), F.max(date)).first()
    return 0 if lo is None else (hi - lo).days + 1
