"""Streaming forms: deduplicated observations and the append-only cost log."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def observations(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stream over a folder of Parquet observations; `ts` becomes a timestamp with a zone."""
    rows = spark.readStream.schema(schema).parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def deduplicated(rows: DataFrame, keys: list[str], late: str = "30 days") -> DataFrame:
    """The first row of each key; state is dropped `late` after an event's time."""
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def daily_counts(rows: DataFrame, late: str = "7 days") -> DataFrame:
    """Rows and greatest value by day and type, as late data allow."""
    return rows.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"), F.max("value").alias("top"))


def run_once(rows: DataFrame, to: str, checkpoint: str, mode: str = "append") -> None:
    """Take in all there is, write Parquet, and end; a later call goes on from the checkpoint."""
    query = rows.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).option("path", to).trigger(availableNow=True).start()
    query.awaitTermination()


def log_costs(verdicts: DataFrame, log: str, checkpoint: str) -> None:
    """Append verdicts that the log doesn't have yet, batch by batch.

    A batch writes a folder of its own, named by its stream (the checkpoint) and number, and replaces it if it
    runs again, so a batch that failed half-way leaves nothing behind.
    """
    from ..operators.cost import new_entries

    stream = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]

    def append(batch: DataFrame, number: int) -> None:
        spark, name = batch.sparkSession, f"{stream}-{number}"
        old = cost_log(spark, log).filter(F.col("batch") != name).drop("batch")
        new_entries(batch.select(*old.columns), old).write.mode("overwrite").parquet(f"{log}/batch={name}")

    verdicts.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def cost_log(spark: SparkSession, log: str) -> DataFrame:
    """The entries of a log that log_costs() writes, with the batch of each; no folder is no entry."""
    from ..schemas import COST_LOG

    path = spark._jvm.org.apache.hadoop.fs.Path(log)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], f"{COST_LOG}, batch string")
    return spark.read.schema(f"{COST_LOG}, batch string").parquet(log)
