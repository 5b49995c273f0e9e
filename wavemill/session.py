"""Session helpers: scratch tables in shared storage, and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_SETTING = "spark.checkpoint.dir"
#: A side is broadcast only after a count has shown it to be at most this long.
BROADCAST_ROWS = 50_000


def local_session(cores: int = 8, memory: str = "8g", app: str = "wavemill") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


_made: dict[str, list[str]] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder the session names in ``spark.checkpoint.dir``. Where it names none, a new local one is set if all work is on this machine; on a cluster that is an error."""
    at = spark.conf.get(CHECKPOINT_SETTING, None)
    if not at:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError(f"set {CHECKPOINT_SETTING} to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="spark-wavemill-", dir="/tmp")
        spark.conf.set(CHECKPOINT_SETTING, at)
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the scratch folder, which :func:`clear_scratch` removes."""
    at = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(at)
    return at


def clear_scratch(spark: SparkSession) -> int:
    """Delete what this application has written to the scratch folder. Results that haven't been read or stored yet need it, so call it after that. Returns the number of tables."""
    paths = _made.pop(spark.sparkContext.applicationId, [])
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for at in paths:
        p = jvm.org.apache.hadoop.fs.Path(at)
        p.getFileSystem(conf).delete(p, True)
    return len(paths)


def written(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` to a new table in the scratch folder and read it back: lineage ends there, and a lost executor costs no recomputation."""
    at = scratch_path(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def within(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``rows`` rows; reads no further than needed."""
    return df.limit(rows + 1).count() <= rows


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if a count shows it to be short, else as it is (the join then shuffles)."""
    return F.broadcast(df) if within(df, rows) else df
