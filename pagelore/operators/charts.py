"""Chart points: explicit values, measured values, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def points_from_grid(grids: DataFrame) -> DataFrame:
    """Long points of tables with a header: category (first column), series (header), printed text.

    A blank category becomes "Category n", a repeated series name gets its column's number.
    """
    body = grids.where(F.size("rows") > 1).select("item_key", F.get("rows", F.lit(0)).alias("head"), F.posexplode(F.slice("rows", F.lit(2), F.size("rows"))).alias("category_no", "row"))
    cells = body.select("item_key", "head", "category_no", F.get("row", F.lit(0)).alias("category"), F.posexplode(F.slice("row", F.lit(2), F.greatest(F.size("row"), F.lit(0)))).alias("series_no", "printed"))
    name = F.get("head", F.col("series_no") + 1)
    twice = F.size(F.filter("head", lambda h: h == name)) > 1
    series = F.when(twice, F.concat(name, F.lit(" ("), (F.col("series_no") + 1).cast("string"), F.lit(")"))).otherwise(name)
    category = F.when(F.coalesce(F.trim("category"), F.lit("")) == "", F.concat(F.lit("Category "), (F.col("category_no") + 1).cast("string"))).otherwise(F.col("category"))
    return cells.select("item_key", "category_no", category.alias("category"), "series_no", series.alias("series"), "printed")


def point_issues(value: Column, printed: Column, tolerance: Column, lowest: Column, highest: Column) -> Column:
    """Sorted issue codes of a point; an empty array is a valid point."""
    return F.array_sort(
        F.array_compact(
            F.array(
                F.when(value.isNotNull() & ~value.between(lowest, highest), "axis_range"),
                F.when(F.coalesce(F.trim(printed), F.lit("")) == "", "evidence_incomplete"),
                F.when(value.isNull() & (F.trim(printed) != ""), "method"),
                F.when(tolerance.isNull() | (tolerance < 0), "tolerance"),
            )
        )
    )


def bar_values(bars: DataFrame, fits: DataFrame, by: list[str], tip: str, base: str, geometry_tolerance: float) -> DataFrame:
    """Values of bars from their pixels: |value(tip) - value(base)| with the axis fit of their panel.

    The tolerance adds the geometry's on both ends and the fit's residual twice;
    a value not above its tolerance is withheld (null).
    """
    at = lambda c: F.col("slope") * F.col(c) + F.col("intercept")
    size = F.abs(at(tip) - at(base))
    slack = 2 * F.abs("slope") * geometry_tolerance + 2 * F.col("residual")
    joined = bars.join(fits, by)
    return joined.withColumns({"tolerance": slack, "value": F.when(size > slack, size)}).drop("slope", "intercept", "residual", "n")
