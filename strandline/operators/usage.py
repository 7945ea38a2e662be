"""The ledger of metered calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..common import first_rows, materialize

COUNTS = ("input_tokens", "cached_input_tokens", "output_tokens", "request_units")


def entries(ledger: DataFrame) -> DataFrame:
    """Each entry once, as it was first recorded."""
    return first_rows(ledger, "entry_id", [F.col("recorded_at").asc_nulls_last()])


def totals(ledger: DataFrame, *by: str) -> DataFrame:
    """Calls, sums of the counts that are known, and calls whose counts are missing; nothing is estimated."""
    sums = [F.coalesce(F.sum(c), F.lit(0).cast("bigint")).alias(c) for c in COUNTS]
    return entries(ledger).groupBy(*by).agg(F.count("*").alias("calls"), *sums, F.count_if(F.col("usage_missing")).alias("missing"))


def hourly(ledger: DataFrame) -> DataFrame:
    """``stage, hour, calls, late, output_tokens`` by the hour of the call; late: recorded more than an hour after it."""
    late = F.unix_micros("recorded_at") - F.unix_micros("called_at") > 3_600_000_000
    rows = entries(ledger).where("called_at is not null").groupBy("stage", F.date_trunc("hour", "called_at").alias("hour"))
    return rows.agg(F.count("*").alias("calls"), F.count_if(late).alias("late"), F.coalesce(F.sum("output_tokens"), F.lit(0).cast("bigint")).alias("output_tokens"))


def structs(ledger: DataFrame) -> DataFrame:
    """``entry_id, entry``: each entry as a JSON object with names in camel case; counts that aren't known are 0."""
    zero = F.lit(0).cast("bigint")
    camel = lambda c: "".join(w.title() if i else w for i, w in enumerate(c.split("_")))
    fields = [F.col("entry_id").alias("entryId"), F.coalesce("stage", F.lit("")).alias("stage"), *(F.coalesce(c, zero).alias(camel(c)) for c in COUNTS)]
    return entries(ledger).select("entry_id", F.to_json(F.struct(*fields)).alias("entry"))


def sessions(events: DataFrame, user: str, time: str, gap_s: int = 1800) -> DataFrame:
    """``user, session_no, started, ended, events``: a session ends where nothing follows for ``gap_s`` seconds.

    Rows are cut by range of user and time, so that a user with very many events is many tasks: within a range only the
    events that come after a gap stay, and the gaps between ranges are found among the ranges' first and last events.
    """
    rows = events.where(F.col(time).isNotNull()).select(F.coalesce(F.concat(F.lit("u"), F.col(user).cast("string")), F.lit("")).alias("key"), F.col(user).alias("user"), F.col(time).alias("t"))
    ranged = materialize(rows.repartitionByRange("key", "t").withColumn("range_", F.spark_partition_id()))
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    within = Window.partitionBy("key", "range_").orderBy("t")
    late = micros(F.col("t")) - micros(F.lag("t").over(within)) > gap_s * 1_000_000
    runs = ranged.withColumn("no", F.sum(F.coalesce(late.cast("int"), F.lit(0))).over(within.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    runs = materialize(runs.groupBy("key", "range_", "no").agg(F.first("user").alias("user"), F.min("t").alias("started"), F.max("t").alias("ended"), F.count("*").alias("events")))
    order = Window.partitionBy("key").orderBy("started", "ended")
    fresh = F.coalesce((micros(F.col("started")) - micros(F.lag("ended").over(order)) > gap_s * 1_000_000).cast("int"), F.lit(1))
    joined = runs.withColumn("fresh", fresh).withColumn("session_no", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return joined.groupBy("key", "session_no").agg(F.first("user").alias("user"), F.min("started").alias("started"), F.max("ended").alias("ended"), F.sum("events").alias("events")).drop("key")
