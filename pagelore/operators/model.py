"""The relational model: current rows of each table, repeated deliveries once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, *keys: str, by: str = "loaded_at") -> DataFrame:
    """The last delivery of each key, by one combined aggregate instead of a window over the group."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(by)).alias("__r")).select(*keys, *[F.col(f"__r.{c}").alias(c) for c in rest])


def current_items(items: DataFrame) -> DataFrame:
    return latest(items, "item_key")


def current_pages(pages: DataFrame) -> DataFrame:
    return latest(pages, "parse_id", "page_index")


def current_parses(parses: DataFrame) -> DataFrame:
    return latest(parses, "parse_id")


def distinct_items(items: DataFrame, *columns: str) -> DataFrame:
    """The wanted columns of each item once; deliveries repeat the content, so any of them serves."""
    return items.groupBy("item_key").agg(*[F.first(c).alias(c) for c in columns if c != "item_key"])
