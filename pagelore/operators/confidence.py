"""Confidence dimensions of documents: levels from counts, decisions from levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The decision that each level leads to.
DECISIONS = (("supported", "accept"), ("guarded", "concern"), ("unsupported", "fallback"), ("unavailable", "withhold"))


def decision(level: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, what in DECISIONS:
        out = F.when(level == name, what).otherwise(out)
    return out


def dimensions(items: DataFrame, pages: DataFrame, grids: DataFrame) -> DataFrame:
    """parse_id with text, layout and table levels and the worst decision.

    Conditional aggregates per document; a page failure or a concern weighs more
    than a warning, a warning more than mixed sources.
    """
    page = pages.groupBy("parse_id").agg(F.bool_or(~F.coalesce("success", F.lit(True))).alias("failed"), F.bool_or(F.coalesce(F.size("warnings"), F.lit(0)) > 0).alias("warned"))
    texty = F.col("type").isin("text", "heading", "list")
    order = items.groupBy("parse_id", "page_index").agg(F.count_distinct("reading_order").alias("d"), F.count(F.lit(1)).alias("n"), F.max("reading_order").alias("hi")).groupBy("parse_id").agg(F.bool_and((F.col("d") == F.col("n")) & (F.col("hi") == F.col("n") - 1)).alias("in_order"))
    g = items.groupBy("parse_id").agg(
        F.count_if(texty).alias("texts"), F.count_if(texty & (F.coalesce(F.trim("value"), F.lit("")) == "")).alias("blank"), F.count_if(F.array_contains("parse_concerns", "low_confidence")).alias("concerns"),
        F.count_if(texty & ~F.col("source").eqNullSafe("native")).alias("foreign"), F.count_if(F.col("bbox").isNull()).alias("boxless"), F.count_if(F.col("type") == "table").alias("tables"),
    )
    t = items.where("type = 'table'").select("parse_id", "item_key", "source").join(grids.select("item_key", "rectangular"), "item_key", "left").groupBy("parse_id").agg(F.bool_and(F.coalesce("rectangular", F.lit(False))).alias("regular"), F.bool_and(F.coalesce(F.col("source") == "native", F.lit(False))).alias("native_tables"))
    j = g.join(page, "parse_id", "left").join(order, "parse_id", "left").join(t, "parse_id", "left")
    failed, warned = F.coalesce("failed", F.lit(False)), F.coalesce("warned", F.lit(False))
    text = F.when((F.col("texts") == 0) | (F.col("blank") > 0), "unavailable").when(failed | (F.col("concerns") > 0), "unsupported").when(warned | (F.col("foreign") > 0), "guarded").otherwise("supported")
    layout = F.when(failed | ~F.coalesce("in_order", F.lit(False)), "unsupported").when((F.col("boxless") > 0) | warned, "guarded").otherwise("supported")
    table = F.when(F.col("tables") == 0, "not_applicable").when(~F.coalesce("regular", F.lit(False)), "unsupported").when(F.coalesce("native_tables", F.lit(False)), "supported").otherwise("guarded")
    out = j.select("parse_id", text.alias("text"), layout.alias("layout"), table.alias("tables"))
    return out.withColumn("decision", decision(F.col("text")))
