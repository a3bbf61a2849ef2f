"""Markdown, plain text and JSON of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def item_markdown(kind: Column, value: Column, level: Column, ordered: Column) -> Column:
    """Markdown of one item; null or blank values give null."""
    depth = F.least(F.greatest(F.coalesce(level, F.lit(1)), F.lit(1)), F.lit(6))
    lines = F.filter(F.transform(F.split(value, "\n"), lambda x, i: F.when(F.trim(x) != "", F.when(F.coalesce(ordered, F.lit(False)), F.concat((i + 1).cast("string"), F.lit(". "), F.trim(x))).otherwise(F.concat(F.lit("- "), F.trim(x))))), lambda x: x.isNotNull())
    body = (
        F.when(kind == "heading", F.concat(F.repeat(F.lit("#"), depth), F.lit(" "), F.trim(value)))
        .when(kind == "list", F.array_join(lines, "\n"))
        .when(kind == "code", F.concat(F.lit("```\n"), value, F.lit("\n```")))
        .otherwise(F.trim(value))
    )
    return F.when(F.coalesce(F.trim(value), F.lit("")) != "", body)


def documents(items: DataFrame, block: Column, by: str = "parse_id") -> DataFrame:
    """One text per document: its blocks in page and reading order, joined by a blank line, one newline at the end.

    A document is assembled in one row, which its own size bounds.
    """
    rows = items.withColumn("__b", block).where(F.trim("__b") != "")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_index", "reading_order", "item_key", "__b"))), lambda b: b["__b"]), "\n\n")
    done = rows.groupBy(by).agg(F.concat(text, F.lit("\n")).alias("rendered"))
    return items.select(by).distinct().join(done, by, "left").select(by, F.coalesce("rendered", F.lit("\n")).alias("rendered"))


def document_json(items: DataFrame, by: str = "parse_id") -> DataFrame:
    """One JSON per document: pages with their items, fields without value left out."""
    item = F.struct("reading_order", "id", "type", "value", "source", "confidence")
    pages = items.groupBy(by, "page_index").agg(F.array_sort(F.collect_list(item)).alias("items"))
    docs = pages.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("page_index", "items"))).alias("pages"))
    return docs.select(by, F.to_json(F.struct(F.lit("1.0").alias("schema_version"), "pages"), {"ignoreNullFields": "true"}).alias("json"))
