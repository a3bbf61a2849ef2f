"""Grouped measures: distributions, fits, weighted means, stability, gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def nearest_ranks(df: DataFrame, by: Sequence[str], value: str, shares: dict[str, float], cuts: int = 64) -> DataFrame:
    """Exact nearest-rank percentiles of groups of any size: the key, n, and a column for each share.

    `percentile_disc` holds a whole group's distinct values in one task. Here a
    sketch cuts each group's range into buckets, counts tell which bucket holds
    the wanted rank, and only that bucket's values are ranked. The sketch decides
    where to cut, never the answer. Null values take no part.
    """
    keys = list(by)
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("__v"))
    marks = F.array(*[F.lit((k + 1) / (cuts + 1)) for k in range(cuts)])
    sketch = rows.groupBy(*keys).agg(F.array_distinct(F.percentile_approx("__v", marks, F.lit(1000))).alias("__cuts"))
    counted = rows.groupBy(*keys, "__v").agg(F.count(F.lit(1)).alias("__n"))
    placed = _same(counted, sketch, keys).withColumn("__b", F.size(F.filter("__cuts", lambda c: c < F.col("__v")))).drop("__cuts")
    per_bucket = placed.groupBy(*keys, "__b").agg(F.sum("__n").alias("__in"))
    totals = per_bucket.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("__b", "__in"))).alias("__all"), F.sum("__in").alias("n"))  # at most cuts + 1 entries
    asked = F.array(*[F.struct(F.lit(name).alias("name"), F.ceil(F.lit(share) * F.col("n") - 1e-9).cast("bigint").alias("rank")) for name, share in shares.items()])
    spot = totals.select(*keys, "n", "__all", F.explode(asked).alias("__q"))
    before = lambda b: F.aggregate(F.filter("__all", lambda x: x["__b"] < b), F.lit(0).cast("bigint"), lambda a, x: a + x["__in"])
    held = F.get(F.filter("__all", lambda x: (before(x["__b"]) < F.col("__q.rank")) & (before(x["__b"]) + x["__in"] >= F.col("__q.rank"))), F.lit(0))["__b"]
    spot = spot.select(*keys, "n", F.col("__q.name").alias("__name"), held.alias("__b"), F.col("__q.rank").alias("__rank"), before(held).alias("__before"))
    near = _same(placed, spot, [*keys, "__b"])
    w = Window.partitionBy(*keys, "__name").orderBy("__v")
    ranked = near.withColumn("__upto", F.col("__before") + F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    hit = ranked.where((F.col("__upto") >= F.col("__rank")) & (F.col("__upto") - F.col("__n") < F.col("__rank")))
    return hit.groupBy(*keys, "n").agg(*[F.max(F.when(F.col("__name") == name, F.col("__v"))).alias(name) for name in shares])


def _same(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join in which null keys are equal."""
    right = b.select(*[F.col(k).alias(f"__r_{i}") for i, k in enumerate(keys)], *[c for c in b.columns if c not in keys])
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__r_{i}"))
    return a.join(right, on).drop(*[f"__r_{i}" for i in range(len(keys))])


def distribution(df: DataFrame, by: Sequence[str], value: str, digits: int = 6) -> DataFrame:
    """count, min, p50, p95, max and mean of a value; nulls take no part."""
    ranks = nearest_ranks(df, by, value, {"p50": 0.5, "p95": 0.95})
    rest = df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.min(value).alias("min"), F.max(value).alias("max"), F.round(F.avg(value), digits).alias("mean"))
    return _same(rest, ranks, list(by)).select(*by, "n", "min", "p50", "p95", "max", "mean")


def weighted_confidence(confidence: Column, text: Column) -> Column:
    """Mean confidence weighted by text length (at least 1), over rows that have one; null if none has."""
    weight = F.when(confidence.isNotNull(), F.greatest(F.coalesce(F.length(text), F.lit(0)), F.lit(1)))
    return F.round(F.sum(confidence * weight) / F.sum(weight), 4)


def linear_fit(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """Least squares per group: slope, intercept, largest absolute residual, n.

    Groups with fewer than two distinct x or a slope below 1e-12 have no fit.
    """
    fit = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.count(F.lit(1)).alias("n"))
    good = fit.where(F.abs("slope") >= 1e-12)
    residual = F.abs(F.col(y) - (F.col("slope") * F.col(x) + F.col("intercept")))
    return df.join(good, list(by)).groupBy(*by, "slope", "intercept", "n").agg(F.max(residual).alias("residual"))


def stack_totals(df: DataFrame, stack: Sequence[str], series: str, value: str, tolerance: str, lowest: float, highest: float) -> DataFrame:
    """Totals of stacked values and whether each stack is sound.

    A stack needs two members, distinct series and a total within the axis range
    widened by the members' tolerances.
    """
    total, slack = F.sum(value), F.sum(tolerance)
    g = df.groupBy(*stack).agg(F.count(F.lit(1)).alias("members"), F.count_distinct(series).alias("series"), total.alias("total"), slack.alias("slack"))
    ok = (F.col("members") >= 2) & (F.col("series") == F.col("members")) & F.col("total").between(F.lit(lowest) - F.col("slack"), F.lit(highest) + F.col("slack"))
    return g.withColumn("valid", F.coalesce(ok, F.lit(False)))


def stability(df: DataFrame, by: Sequence[str], digest: str) -> DataFrame:
    """Whether every run of a case gave one digest."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("runs"), F.count_distinct(digest).alias("digests")).withColumn("stable", F.col("digests") == 1)


def attempt_gate(attempts: DataFrame, case: str, ok: str, latency: str, limits: DataFrame) -> DataFrame:
    """Per case: failures, p50 and p95 (null after any failure), and the verdict against limit_p50 and limit_p95."""
    ranks = nearest_ranks(attempts, [case], latency, {"p50": 0.5, "p95": 0.95}).drop("n")
    counts = attempts.groupBy(case).agg(F.count(F.lit(1)).alias("attempts"), F.count_if(~F.col(ok)).alias("failures"))
    g = counts.join(ranks, case, "left")
    clean = F.col("failures") == 0
    g = g.withColumns({"p50": F.when(clean, F.col("p50")), "p95": F.when(clean, F.col("p95"))}).join(limits, case, "left")
    passes = clean & (F.col("p50") <= F.col("limit_p50")) & (F.col("p95") <= F.col("limit_p95"))
    return g.withColumn("passes", F.coalesce(passes, F.lit(False)))
