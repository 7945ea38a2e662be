"""Mixing sources to target shares of the total size (problem 7).

Weighted sampling without replacement after Efraimidis and Spirakis: each document draws an exponential key whose rate
is its quality weight, and the documents of a source are taken in the order of their keys. A source gives as many whole
epochs as its budget holds, then the first documents by key until the rest of the budget is used up.

The prefix sums that cut a source at its budget run in two steps, so that a source with a third of all documents is no
single task: the keys fall into ``BUCKETS`` ranges for each source, the ranges' totals are summed up (a small table), and the
documents are summed up within their range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..common import join_checked, materialize, spread
from .tokens import _encoded

#: Ranges of keys for each source.
BUCKETS = 1024


def text_quality(text: Column) -> Column:
    """A weight in [0.1, 1]: the share of letters, digits and single spaces in a text."""
    good = F.length(F.regexp_replace(text, r"[^\p{L}\p{N} ]|(?<= ) ", ""))
    return F.coalesce(F.when(F.length(text) > 0, 0.1 + 0.9 * good / F.length(text)), F.lit(0.1))


def uniform(seed: int, *cols: Column) -> Column:
    """A number in (0, 1) that only depends on ``cols`` and ``seed``."""
    return ((F.xxhash64(F.lit(seed), *cols).bitwiseAND(F.lit((1 << 53) - 1))).cast("double") + 0.5) / float(1 << 53)


def mixture(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", quality: Column | None = None, seed: int = 42, buckets: int = BUCKETS) -> DataFrame:
    """``id_col, source, n_tokens, copies``: how often each document of a listed source is used.

    ``targets`` has ``source, target_share, max_repeats``; a source listed twice counts by its first row in order of share. The total
    size is the number of tokens of all documents of listed sources, each once. A document of the last, partial epoch is taken if at
    least half of it lies within the budget; ties of keys go by id. Documents of other or null sources give nothing;
    null and empty texts have no tokens, and are used as often as the epochs say. A null share or repeat count is 0.
    Repeated ids are documents of their own; an empty table gives an empty result.
    """
    rank = Window.partitionBy("source").orderBy(F.col("target_share").desc_nulls_last(), F.col("max_repeats").desc_nulls_last())
    want = targets.where("source is not null").withColumn("r_", F.row_number().over(rank)).where("r_ = 1").select("source", F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("max_repeats", F.lit(0)).alias("max_repeats"))
    want = materialize(want)
    weight = quality if quality is not None else text_quality(F.col(text_col))
    rows = spread(docs).select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col(text_col).alias("text"), weight.cast("double").alias("weight"))
    rows = join_checked(rows, want, ["source"], "left_semi", 64)
    keyed = rows.select(F.struct("id", "source", F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(1e-6)).alias("weight")).alias("k"), "text")
    sized = _encoded(keyed, "k", "text", counts_only=True).select("k.id", "k.source", "k.weight", "n_tokens")
    sized = materialize(sized.withColumn("key", -F.log(uniform(seed, F.col("id").cast("string"), F.col("source"))) / F.col("weight")))

    totals = sized.groupBy("source").agg(F.sum("n_tokens").alias("size"), F.avg("weight").alias("rate"))
    totals = totals.join(F.broadcast(sized.agg(F.sum("n_tokens").alias("total"))))  # one row
    plan = want.join(totals, "source").withColumn("budget", F.col("target_share") * F.col("total"))
    epochs = F.when(F.col("size") > 0, F.least(F.floor(F.col("budget") / F.col("size")), F.col("max_repeats").cast("bigint"))).otherwise(F.col("max_repeats").cast("bigint"))
    plan = plan.withColumn("epochs", F.greatest(epochs, F.lit(0).cast("bigint")))
    rest = F.when(F.col("epochs") < F.col("max_repeats"), F.col("budget") - F.col("epochs") * F.col("size")).otherwise(0.0)
    plan = materialize(plan.select("source", "rate", "epochs", rest.alias("rest")))  # one row for each source

    ranged = join_checked(sized, plan, ["source"], "inner", 64)
    ranged = ranged.withColumn("bucket", F.floor((1 - F.exp(-F.col("key") * F.col("rate"))) * buckets).cast("int"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("n"))
    sums = materialize(sums.select("source", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")))
    within = Window.partitionBy("source", "bucket").orderBy("key", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = join_checked(ranged, sums, ["source", "bucket"], "inner", 64).withColumn("end", F.col("base") + F.sum("n_tokens").over(within))
    taken = (F.col("end") - F.col("n_tokens") / 2 <= F.col("rest")) & (F.col("rest") > 0)
    return placed.select(F.col("id").alias(id_col), "source", "n_tokens", (F.col("epochs") + taken.cast("bigint")).alias("copies"))


def mixture_report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """``source, target_share, actual_share, tokens, documents, uses, short`` for every listed source.

    ``short``: each of its documents is used ``max_repeats`` times and its tokens still don't make up the target.
    """
    per = mixed.groupBy("source").agg(F.sum("n_tokens").alias("size"), F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("documents"), F.sum("copies").alias("uses"), F.min("copies").alias("least"))
    per = materialize(per)  # one row for each source
    overall = per.agg(F.sum("size").alias("total"), F.sum("tokens").alias("used"))
    rows = targets.where("source is not null").join(per, "source", "left").join(F.broadcast(overall))
    budget = F.coalesce("target_share", F.lit(0.0)) * F.coalesce("total", F.lit(0))
    full = F.coalesce(F.col("least") >= F.coalesce("max_repeats", F.lit(0)), F.lit(True))
    zero = F.lit(0).cast("bigint")
    return rows.select(
        "source",
        "target_share",
        F.coalesce(F.col("tokens") / F.nullif(F.col("used"), zero), F.lit(0.0)).alias("actual_share"),
        F.coalesce("tokens", zero).alias("tokens"),
        F.coalesce("documents", zero).alias("documents"),
        F.coalesce("uses", zero).alias("uses"),
        (full & (F.coalesce("tokens", zero) < budget)).alias("short"),
    )
