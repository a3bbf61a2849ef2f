"""Distinct by content or geometry, best observation, merge of recognition passes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelore.operators.folds import fold_groups


def first_of_each(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each group in order, by one combined aggregate."""
    rest = [c for c in df.columns if c not in by]
    return df.groupBy(*by).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__r")).select(*by, *[F.col(f"__r.{c}").alias(c) for c in rest])


def best_observation(df: DataFrame, by: Sequence[str], score: str, tie: Sequence[str]) -> DataFrame:
    """The highest-scoring row of each group; a null score counts as -1, ties go to the greatest `tie`."""
    rest = [c for c in df.columns if c not in by]
    return df.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(F.coalesce(score, F.lit(-1.0)), *tie)).alias("__r")).select(*by, *[F.col(f"__r.{c}").alias(c) for c in rest])


def coalesce_relations(edges: DataFrame, keys: Sequence[str], member: str) -> DataFrame:
    """Edges of equal ends as one, with their number and least member."""
    return edges.groupBy(*keys).agg(F.count(F.lit(1)).alias("edges"), F.min(member).alias(f"first_{member}"))


def geometry_distinct(df: DataFrame, by: Sequence[str], text: str, order: str, box: str, key: str, threshold: float = 0.80) -> DataFrame:
    """Rows that stay when repeated words at one place are dropped, in order.

    A row with a box is dropped if an earlier retained one of equal text overlaps
    it reciprocally by the threshold. A row without stays if its text has not
    been seen; it then drops every later row of that text. Only retained rows
    suppress, hence a fold over the rows of each text of a page and no anti join.
    Rows with a null text are left out.
    """
    flat = df.where(F.col(text).isNotNull()).select(*by, F.col(text).alias("__t"), F.col(order).alias("__o"), F.col(key).alias("__k"), *[F.col(f"{box}.{c}").alias(f"__{c}") for c in ("x", "y", "width", "height")])

    def fold(group: list[dict]) -> list[tuple]:
        kept: dict[str, list[tuple]] = {}
        closed: set[str] = set()
        out = []
        for g in group:
            t, (x, y, w, h) = g["__t"], (g["__x"], g["__y"], g["__width"], g["__height"])
            if t in closed:
                continue
            if None not in (x, y, w, h) and w > 0 and h > 0:
                held = kept.setdefault(t, [])
                if any(max(0.0, min(x + w, a + c) - max(x, a)) * max(0.0, min(y + h, b + d) - max(y, b)) >= threshold * max(w * h, c * d) for a, b, c, d in held):
                    continue
                held.append((x, y, w, h))
            else:
                if t in kept:
                    continue
                closed.add(t)
            out.append((g["__k"],))
        return out

    return fold_groups(flat, by, ["__o", "__k"], fold, df.select(*by, key).schema)
