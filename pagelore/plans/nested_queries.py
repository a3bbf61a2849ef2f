"""Parse results as received: nested JSON to related flat tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelore.operators import nested
from pagelore.session import table


def _items(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    results = table(spark, d, "parse_results")
    bodies = nested.latest_bodies(results)
    return bodies, nested.items(bodies, nested.item_depth(results))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _items(spark, d)[1].select("result_id", "page_index", "item_id", "parent_id").distinct()


def p5_results(spark: SparkSession, d: str) -> DataFrame:
    return nested.result_rows(nested.latest_bodies(table(spark, d, "parse_results")))


def p5_pages(spark: SparkSession, d: str) -> DataFrame:
    return nested.page_rows(nested.latest_bodies(table(spark, d, "parse_results")))


def p5_items(spark: SparkSession, d: str) -> DataFrame:
    return _items(spark, d)[1].drop("node")


def p5_boxes(spark: SparkSession, d: str) -> DataFrame:
    return nested.boxes(_items(spark, d)[1])


def p5_warnings(spark: SparkSession, d: str) -> DataFrame:
    return nested.warnings(*_items(spark, d))


def p5_schema(spark: SparkSession, d: str) -> DataFrame:
    return nested.merged_schema(table(spark, d, "parse_results")).groupBy("path", "kind").agg(F.sum("n").alias("n"))


QUERIES = {f.__name__: f for f in (p5_found, p5_results, p5_pages, p5_items, p5_boxes, p5_warnings, p5_schema)}

_LATEST = """
    bodies AS (
        SELECT result_id, arg_max(doc, received_at) AS doc
        FROM (SELECT result_id, received_at, TRY_CAST(body AS JSON) AS doc FROM parse_results) t
        WHERE doc IS NOT NULL GROUP BY result_id
    ),
    pages AS (
        SELECT result_id, CAST(p.key AS INTEGER) + 1 AS page_index, p.value AS page
        FROM bodies, json_each(CASE WHEN json_type(doc, '$.pages') IS NOT NULL AND json_type(doc, '$.pages') <> 'NULL' THEN json_extract(doc, '$.pages') ELSE json_extract(doc, '$.document.pages') END) p
    )
"""

ORACLE = {
    "p5_found": f"""
        WITH RECURSIVE {_LATEST},
        kids AS (
            SELECT result_id, page_index, '' AS parent_id, json_extract(page, '$.items') AS held FROM pages
        ),
        tree AS (
            SELECT result_id, page_index, parent_id, unnest(CASE json_type(held) WHEN 'ARRAY' THEN json_extract(held, '$[*]') WHEN 'OBJECT' THEN [held] ELSE [] END) AS node FROM kids
            UNION ALL
            SELECT result_id, page_index, id, unnest(CASE json_type(held) WHEN 'ARRAY' THEN json_extract(held, '$[*]') WHEN 'OBJECT' THEN [held] ELSE [] END)
            FROM (
                SELECT result_id, page_index, coalesce(json_extract_string(node, '$.id'), '') AS id, unnest([json_extract(node, '$.items'), json_extract(node, '$.contained_items')]) AS held
                FROM tree
            ) deeper
        )
        SELECT DISTINCT result_id, page_index, json_extract_string(node, '$.id') AS item_id, parent_id FROM tree WHERE json_type(node) = 'OBJECT'
    """,
    "p5_pages": f"""
        WITH {_LATEST}
        SELECT result_id, page_index, json_extract_string(page, '$.page_number') AS page_number, json_extract_string(page, '$.page_label') AS page_label,
            TRY_CAST(json_extract_string(page, '$.page_width') AS DOUBLE) AS page_width, TRY_CAST(json_extract_string(page, '$.page_height') AS DOUBLE) AS page_height,
            json_extract_string(page, '$.unit') AS unit, TRY_CAST(json_extract_string(page, '$.success') AS BOOLEAN) AS success
        FROM pages
    """,
}
