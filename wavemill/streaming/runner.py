"""Run a streaming plan over what is there now, and read its result as a table.

Sources are file streams with a bounded number of files per trigger; each
micro-batch is written under its own number, so a batch that is run again
replaces itself. In update mode the latest batch that tells a key is its result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavemill.session import scratch_path


def file_stream(spark: SparkSession, folder: str, name: str, files_per_trigger: int = 8) -> DataFrame:
    """A table of parquet files as a stream."""
    # A pattern, so that a table may be one file or a folder of files.
    return spark.readStream.schema(spark.read.parquet(f"{folder}/{name}.parquet").schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{folder}/{name}.parque[t]")


def run_available(stream: DataFrame, mode: str, keys: list[str] | None = None, progress: list | None = None) -> DataFrame:
    """The result of a stream over all that is available. ``keys``: in update mode, what the last update of counts. ``progress`` is filled with what Spark tells of each micro-batch."""
    spark = stream.sparkSession
    base = scratch_path(spark, "stream")
    out = f"{base}/out"

    def store(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{out}/part={number}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").foreachBatch(store).trigger(availableNow=True).start()
    try:
        q.awaitTermination()
        if progress is not None:
            progress += q.recentProgress
    finally:
        q.stop()
    got = spark.read.schema(f"{_ddl(stream)}, _batch long").option("recursiveFileLookup", "true").parquet(out)
    if mode == "complete":  # every batch tells all
        got = got.join(F.broadcast(got.agg(F.max("_batch").alias("_batch"))), "_batch")
    if keys:
        rest = [c for c in got.columns if c not in keys and c != "_batch"]
        got = got.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("r")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])
    return got.select(*stream.columns)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
