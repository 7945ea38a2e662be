"""The ledger as a stream: entries once each, counted by hour of the call, with a bound on lateness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.loading import missing


def hourly_usage(stream: DataFrame, late: str = "3 days") -> DataFrame:
    """``stage, hour, calls, output_tokens`` of a stream of ledger rows; repeated entries within the bound count once."""
    once = stream.withWatermark("called_at", late).dropDuplicatesWithinWatermark(["entry_id"])
    by = once.groupBy("stage", F.window("called_at", "1 hour").alias("w"))
    return by.agg(F.count("*").alias("calls"), F.sum("output_tokens").alias("output_tokens")).select("stage", F.col("w.start").alias("hour"), "calls", "output_tokens")


def ingest(stream: DataFrame, path: str, checkpoint: str, key: str = "id") -> StreamingQuery:
    """Append each micro-batch's rows whose key the table at ``path`` lacks; safe to run again after a failure."""

    def load(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        batch = batch.dropDuplicates([key])
        try:
            batch = missing(spark.read.parquet(path), batch, key)
        except Exception as e:  # the first batch finds no table
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        batch.write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
