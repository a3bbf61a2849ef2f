"""Caps and greedy budgets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from pagelore.operators.folds import fold_groups


def cap(df: DataFrame, by: Sequence[str], order: Sequence[str], most: int) -> DataFrame:
    """At most `most` rows of each group, each with whether the group was truncated."""
    w = Window.partitionBy(*by)
    ranked = df.withColumn("__r", F.row_number().over(w.orderBy(*order))).withColumn("truncated", F.count(F.lit(1)).over(w) > most)
    return ranked.where(F.col("__r") <= most).drop("__r")


def greedy_budget(df: DataFrame, by: Sequence[str], order: Sequence[str], costs: dict[str, float], most: int) -> DataFrame:
    """Rows of each group that fit its budgets, in order; what does not fit is skipped, later rows may still fit.

    Adds taken and exhausted (some row of the group was skipped). The fold is
    sequential by definition. A null cost counts as 0.
    """
    rest = [c for c in df.columns if c not in by]
    ranked = [*order, *[c for c in rest if c not in order]]

    def fold(group: list[dict]) -> list[tuple]:
        spent, count, taken = dict.fromkeys(costs, 0.0), 0, []
        for g in group:
            fits = count < most and all(spent[c] + g[c] <= limit for c, limit in costs.items())
            if fits:
                count += 1
                for c in costs:
                    spent[c] += g[c]
            taken.append(fits)
        return [(*[g[c] for c in ranked], t, not all(taken)) for g, t in zip(group, taken, strict=True)]

    fields = df.select(*by, *ranked).schema.fields
    return fold_groups(df.fillna(0.0, list(costs)), by, order, fold, T.StructType([*fields, T.StructField("taken", T.BooleanType()), T.StructField("exhausted", T.BooleanType())]))
