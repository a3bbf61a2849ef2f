"""Ordered scans per partition: islands, occurrences, margins, repetition, style runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from pagelore.operators.folds import fold_groups


def contiguous(df: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """Whether the order values of each group are exactly 0..n-1, each once."""
    g = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(order).alias("__d"), F.min(order).alias("__lo"), F.max(order).alias("__hi"))
    return g.select(*by, "n", F.coalesce((F.col("__d") == F.col("n")) & (F.col("__lo") == 0) & (F.col("__hi") == F.col("n") - 1), F.lit(False)).alias("contiguous"))


def occurrence_index(df: DataFrame, by: Sequence[str], order: Sequence[str], into: str = "occurrence") -> DataFrame:
    """How many equal rows (by `by`) came before, in `order`."""
    return df.withColumn(into, F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)


def interval_islands(df: DataFrame, by: Sequence[str], start: str, end: str, order: Sequence[str], gap: float = 0.5, into: str = "island") -> DataFrame:
    """Numbers the groups of intervals that chain together with gaps of at most `gap`."""
    w = Window.partitionBy(*by).orderBy(start, *order)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(reach.isNull() | (F.col(start) > reach + gap), 1).otherwise(0)
    return df.withColumn("__opens", opens).withColumn(into, (F.sum("__opens").over(w) - 1).cast("int")).drop("__opens")


def style_runs(df: DataFrame, by: Sequence[str], order: Sequence[str], style: Column, into: str = "run") -> DataFrame:
    """Numbers the runs of equal style in order; a null style equals a null style."""
    w = Window.partitionBy(*by).orderBy(*order)
    marked = df.withColumn("__style", style)
    change = F.when(F.row_number().over(w) == 1, 0).when(F.col("__style").eqNullSafe(F.lag("__style").over(w)), 0).otherwise(1)
    return marked.withColumn("__change", change).withColumn(into, F.sum("__change").over(w).cast("int")).drop("__change", "__style")


def margin_choice(df: DataFrame, by: Sequence[str], score: str, answer: str, margin: float) -> DataFrame:
    """The answer of the best score if it leads the best other answer by `margin`; else unresolved (null)."""
    best = df.groupBy(*by, answer).agg(F.max(score).alias("__s"))
    ranked = best.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(F.col("__s").alias("s"), F.col(answer).alias("a"))), asc=False).alias("r"))
    first, second = F.get("r", F.lit(0)), F.get("r", F.lit(1))
    lead = first["s"] - F.coalesce(second["s"], F.lit(0.0))
    return ranked.select(*by, F.when(lead >= margin - 1e-12, first["a"]).alias(answer), first["s"].alias("best"), F.round(lead, 6).alias("lead"))


def repeated_regions(df: DataFrame, group: str, page: str, signature: Sequence[str], least: int = 2) -> DataFrame:
    """Signatures that stand on at least `least` pages of a group and never twice on one."""
    per_page = df.groupBy(group, *signature, page).agg(F.count(F.lit(1)).alias("__n"))
    g = per_page.groupBy(group, *signature).agg(F.count(F.lit(1)).alias("pages"), F.max("__n").alias("__most"), F.min(page).alias("first_page"), F.max(page).alias("last_page"))
    return g.where((F.col("pages") >= least) & (F.col("__most") == 1)).drop("__most")


def median_clusters(df: DataFrame, by: Sequence[str], value: str, tolerance: float, into: str = "cluster") -> DataFrame:
    """1-D clusters: sorted values join the open cluster while within `tolerance` of its running median.

    The median of an open cluster depends on the order of arrival, which no
    window can express, hence a fold.
    """
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("__v"))

    def fold(group: list[dict]) -> list[tuple]:
        held: list[float] = []
        number, out = -1, []
        for v in (g["__v"] for g in group):
            k = len(held)
            median = None if not k else held[k // 2] if k % 2 else (held[k // 2 - 1] + held[k // 2]) / 2
            if median is None or v - median > tolerance:
                number, held = number + 1, []
            held.append(v)  # values come sorted, so the list stays sorted
            out.append((v, number))
        return out

    return fold_groups(rows, by, ["__v"], fold, T.StructType([*df.select(*by).schema.fields, T.StructField(value, T.DoubleType()), T.StructField(into, T.IntegerType())]))
