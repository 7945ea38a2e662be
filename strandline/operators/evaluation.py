"""Retrieval metrics, their aggregation, intervals and tests, threshold calibration, drift.

Metrics are a long table ``mode, item_id, metric, value``; null and NaN both mean missing.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..common import is_finite
from .prompts import stage_order

RESAMPLES, SEED, CONFIDENCE = 10_000, 20260616, 0.95
#: Numbers that a resampling holds at once.
DRAWN = 4_000_000


def hit_metrics(hits: DataFrame, gold: DataFrame, k: int = 5) -> DataFrame:
    """``item_id, metric, value``: recall of the gold urls among the first ``k`` hits, and reciprocal rank of the first.

    ``hits`` has ``query_id, rank, url``; ``gold`` has ``query_id, url``; both urls in normal form. Items without gold
    give no metric.
    """
    wanted = gold.where("coalesce(url, '') != ''").select("query_id", "url").distinct()
    got = hits.where(F.col("rank") < k).groupBy("query_id", "url").agg(F.min("rank").alias("rank"))
    per = wanted.join(got, ["query_id", "url"], "left").groupBy("query_id").agg(F.count("rank").alias("n"), F.count("*").alias("of"), F.min("rank").alias("first"))
    pairs = F.array(F.struct(F.lit("hit_rate").alias("metric"), (F.col("n") / F.col("of")).alias("value")), F.struct(F.lit("mrr").alias("metric"), F.coalesce(1 / (F.col("first") + 1), F.lit(0.0)).alias("value")))
    return per.select(F.col("query_id").alias("item_id"), F.explode(pairs).alias("m")).select("item_id", "m.metric", "m.value")


def means(rows: DataFrame, *by: str) -> DataFrame:
    """``by..., metric, mean, valid, total``: means over the valid values; a metric without any has no row."""
    ok = is_finite(F.col("value"))
    out = rows.groupBy(*by, "metric").agg(F.avg(F.when(ok, F.col("value"))).alias("mean"), F.count_if(ok).alias("valid"), F.count("*").alias("total"))
    return out.where("valid > 0").withColumn("mean", F.round("mean", 6))


def by_tag(rows: DataFrame) -> DataFrame:
    """Rows once for each of their ``tags``; rows without any under ``original``."""
    tags = F.when(F.size(F.coalesce("tags", F.array())) == 0, F.array(F.lit("original"))).otherwise(F.array_distinct("tags"))
    return rows.withColumn("tag", F.explode(tags)).drop("tags")


def _drawn(draw: Callable[[int], np.ndarray], values: np.ndarray, resamples: int) -> np.ndarray:
    """Of ``resamples`` drawn counts of the values the sums, a bounded number of counts at once."""
    step = max(1, DRAWN // max(1, len(values)))
    return np.concatenate([draw(min(step, resamples - a)) @ values for a in range(0, resamples, step)])


def _interval(values: np.ndarray, counts: np.ndarray, resamples: int, confidence: float, seed: int) -> np.ndarray:
    """Ends of the percentile bootstrap interval of the mean of values that come ``counts`` times."""
    n, rng = int(counts.sum()), np.random.default_rng(seed)
    means = _drawn(lambda b: rng.multinomial(n, counts / n, size=b), values, resamples) / n
    return np.quantile(means, [(1 - confidence) / 2, (1 + confidence) / 2])


def bootstrap_means(rows: DataFrame, *by: str, resamples: int = RESAMPLES, confidence: float = CONFIDENCE, seed: int = SEED) -> DataFrame:
    """``by..., metric, mean, low, high, n``: percentile bootstrap of each mean.

    The values of a group are first counted by value; a resample is then one multinomial draw over the distinct values,
    so a group costs its distinct values, not its rows.
    """
    keys = [*by, "metric"]
    counted = rows.where(is_finite(F.col("value"))).groupBy(*keys, F.round("value", 6).alias("value")).agg(F.count("*").alias("c"))

    def interval(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("value")
        v, c = pdf["value"].to_numpy(), pdf["c"].to_numpy()
        n, mean = int(c.sum()), float((v * c).sum() / c.sum())
        low = high = mean
        if n > 1:
            low, high = _interval(v, c, resamples, confidence, seed)
        return pd.DataFrame([[*key, mean, low, high, n]], columns=[*keys, "mean", "low", "high", "n"])

    schema = ", ".join(f"{k} string" for k in keys) + ", mean double, low double, high double, n bigint"
    return counted.groupBy(*keys).applyInPandas(interval, schema)


def paired_tests(rows: DataFrame, baseline: str, resamples: int = RESAMPLES, confidence: float = CONFIDENCE, seed: int = SEED) -> DataFrame:
    """``mode, metric, n, mean_diff, ci_low, ci_high, p_value, significant``: sign-flip test of every mode against ``baseline``.

    The interval is the percentile bootstrap of the mean difference. Pairs need both values; fewer than two pairs give no
    row. Differences are counted by value first, so that flipping the signs of a size's pairs is one binomial draw and a
    resample one multinomial draw.
    """
    ok = rows.where(is_finite(F.col("value")))
    base = ok.where(F.col("mode") == baseline).select("item_id", "metric", F.col("value").alias("base"))
    pairs = ok.where(F.col("mode") != baseline).join(base, ["item_id", "metric"]).withColumn("d", F.round(F.col("value") - F.col("base"), 6))
    counted = pairs.groupBy("mode", "metric", "d").agg(F.count("*").alias("c"))

    def test(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("d")
        d, each, n = pdf["d"].to_numpy(), pdf["c"].to_numpy(), int(pdf["c"].sum())
        cols = ["mode", "metric", "n", "mean_diff", "ci_low", "ci_high", "p_value", "significant"]
        if n < 2:
            return pd.DataFrame(columns=cols)
        observed = float((d * each).sum()) / n
        size, at = np.unique(np.abs(d), return_inverse=True)
        c, rng = np.bincount(at, weights=each).astype(np.int64), np.random.default_rng(seed)
        drawn = np.abs(_drawn(lambda b: 2 * rng.binomial(c, 0.5, size=(b, len(c))) - c, size, resamples) / n)
        p = (int((drawn >= abs(observed) - 1e-12).sum()) + 1) / (resamples + 1)
        low, high = _interval(d, each, resamples, confidence, seed + 1)
        return pd.DataFrame([[*key, n, observed, low, high, p, p < 1 - confidence]], columns=cols)

    return counted.groupBy("mode", "metric").applyInPandas(test, "mode string, metric string, n bigint, mean_diff double, ci_low double, ci_high double, p_value double, significant boolean")


def threshold_sweep(labeled: DataFrame) -> DataFrame:
    """Confusion and rates at every threshold worth a look, from ``score, faithful``.

    Thresholds are 0, the midpoints between adjacent distinct scores (these rounded to 6 digits) and a little above the
    largest. Scores are counted by value first; running sums over the distinct values give every confusion at once.
    """
    by = labeled.where(is_finite(F.col("score"))).groupBy(F.round("score", 6).alias("s")).agg(F.count_if("faithful").alias("good"), F.count_if(~F.col("faithful")).alias("bad"))
    order = Window.orderBy("s")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    zero = F.lit(0).cast("bigint")
    at = by.select(F.coalesce(F.round((F.col("s") + F.lead("s").over(order)) / 2, 7), F.round(F.col("s") + 1e-6, 7)).alias("threshold"), F.sum("good").over(upto).alias("fa"), F.sum("bad").over(upto).alias("ta"))
    at = at.unionByName(labeled.agg(F.lit(0.0).alias("threshold"), zero.alias("fa"), zero.alias("ta")))
    total = by.agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    out = at.crossJoin(F.broadcast(total))
    rate = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    fp = F.col("bad") - F.col("ta")
    out = out.select("threshold", (F.col("good") - F.col("fa")).alias("true_pass"), F.col("fa").alias("false_abstain"), fp.alias("false_pass"), F.col("ta").alias("true_abstain"), rate(fp, F.col("bad")).alias("false_pass_rate"), rate(F.col("fa"), F.col("good")).alias("false_abstain_rate"))
    return out.withColumn("youden_j", F.round(1 - F.col("false_abstain_rate") - F.col("false_pass_rate"), 9))


def recommended_threshold(sweep: DataFrame, max_false_pass_rate: float | None = None) -> DataFrame:
    """The best row of a sweep: the highest J, then threshold; or within a budget of false passes the fewest false abstentions."""
    if max_false_pass_rate is None:
        return sweep.orderBy(F.col("youden_j").desc(), F.col("threshold").desc()).limit(1)
    return sweep.where(F.col("false_pass_rate") <= max_false_pass_rate).orderBy("false_abstain_rate", F.col("threshold").desc()).limit(1)


def canary(items: DataFrame, threshold: float, tolerance: float = 0.25) -> DataFrame:
    """One row of drift figures from ``id, expected_pass, online, offline`` (a missing score is null or NaN)."""
    on, off = (F.when(is_finite(F.col(c)), F.col(c)) for c in ("online", "offline"))
    gap = F.abs(on - off)
    wrong = lambda c: F.count_if((c >= threshold) != F.col("expected_pass"))
    out = items.agg(
        F.count("*").alias("items"),
        wrong(on).alias("online_wrong"),
        wrong(off).alias("offline_wrong"),
        F.count_if((on >= threshold) != (off >= threshold)).alias("verdicts_differ"),
        F.count_if(on.isNull()).alias("online_missing"),
        F.count_if(off.isNull()).alias("offline_missing"),
        F.round(F.avg(gap), 6).alias("mean_gap"),
        F.round(F.max(gap), 6).alias("max_gap"),
    )
    return out.withColumn("drifted", (F.col("online_missing") + F.col("offline_missing") + F.col("online_wrong") > 0) | (F.coalesce("max_gap", F.lit(0.0)) > tolerance))


def joined_scores(items: DataFrame, online: DataFrame, offline: DataFrame) -> DataFrame:
    """``items`` (``id, ...``) with the scores of two judges (``id, score`` each) as ``online`` and ``offline``; a missing one is null."""
    for name, scores in (("online", online), ("offline", offline)):
        items = items.join(scores.select("id", F.col("score").alias(name)), "id", "left")
    return items


def stage_key(metric: Column, stage: Column) -> Column:
    """``metric@stage``; the metric alone without a stage."""
    return F.concat_ws("@", metric, stage)


def stage_means(means: DataFrame) -> DataFrame:
    """``stage, position`` and one column for each metric, from means under keys ``metric@stage`` (``key, mean``): plain keys are
    left out; stages in retrieval order."""
    rows = means.where(F.contains("key", F.lit("@"))).select(F.split_part("key", F.lit("@"), F.lit(1)).alias("metric"), F.regexp_extract("key", "@(.*)", 1).alias("stage"), F.round("mean", 4).alias("mean"))
    wide = rows.groupBy("stage").pivot("metric").agg(F.first("mean"))
    return wide.withColumn("position", F.row_number().over(Window.orderBy(stage_order(F.col("stage")))) - 1)  # one row for each stage


def overall(means: DataFrame) -> DataFrame:
    """``metric, mean_score, coverage`` of the plain keys (``key, mean, valid, total``); coverage as ``valid/total``."""
    rows = means.where(~F.contains("key", F.lit("@")))
    return rows.select(F.col("key").alias("metric"), F.round("mean", 4).alias("mean_score"), F.concat_ws("/", F.col("valid"), F.col("total")).alias("coverage"))


def against_baseline(means: DataFrame, baseline: str) -> DataFrame:
    """``mode, metric, mean, base, diff`` of every other mode for the metrics that the baseline has as well."""
    base = means.where(F.col("mode") == baseline).select("metric", F.col("mean").alias("base"))
    rows = means.where(F.col("mode") != baseline).join(base, "metric")
    return rows.select("mode", "metric", "mean", "base", F.round(F.col("mean") - F.col("base"), 6).alias("diff"))


def stages_seen(rows: DataFrame) -> DataFrame:
    """``stage, position``: distinct stages in the order first seen, from ``item, place, stage``."""
    first = rows.groupBy("stage").agg(F.min(F.struct("item", "place")).alias("seen"))
    return first.select("stage", (F.row_number().over(Window.orderBy("seen")) - 1).alias("position"))  # one row for each stage


def json_report(means: DataFrame) -> DataFrame:
    """``mode, report``: the metrics of each mode as one JSON object; values that are not finite as null."""
    value = F.when(is_finite(F.col("mean")), F.col("mean"))
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", value.alias("mean")))))
    return means.groupBy("mode").agg(F.to_json(entries, {"ignoreNullFields": "false"}).alias("report"))
