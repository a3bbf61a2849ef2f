"""Rule lines, glyph health, grounding, precedence, merges, forms and plans over the model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelore.operators import evidence as V
from pagelore.operators import geometry as G
from pagelore.operators.model import distinct_items
from pagelore.operators.tables import distinct_cells
from pagelore.plans.structure_queries import outline_tree
from pagelore.session import table

PAGE = ["parse_id", "page_index"]


def rule_bands(spark: SparkSession, d: str) -> DataFrame:
    """Lower edges of tables and images as rules, texts and headings of the page as runs."""
    rows = distinct_items(table(spark, d, "items"), *PAGE, "type", "bbox").where("bbox.width > 0 and bbox.height > 0")
    runs = rows.where("type in ('text', 'heading')").select(*PAGE, F.col("item_key").alias("run_key"), "bbox.x", "bbox.y", "bbox.width", "bbox.height")
    rules = rows.where("type in ('table', 'image')").select(*PAGE, F.col("item_key").alias("rule_key"), F.col("bbox.x").alias("x1"), G.right(F.col("bbox")).alias("x2"), G.bottom(F.col("bbox")).alias("at"))
    return V.rule_bands(runs, rules, PAGE).select("run_key", "rule_key", "role")


def glyph_health(spark: SparkSession, d: str) -> DataFrame:
    return V.glyph_health(distinct_items(table(spark, d, "items"), "parse_id", "value"), ["parse_id"], "value")


def cell_grounding(spark: SparkSession, d: str) -> DataFrame:
    """Cells as claims about their table item."""
    cells = distinct_cells(table(spark, d, "cells"))
    items = distinct_items(table(spark, d, "items"), "page_index", "value")
    pages = items.select("item_key", F.col("page_index"))
    claims = cells.join(pages, "item_key", "left").select(F.concat_ws("-", F.col("item_key").cast("string"), F.col("row_no").cast("string"), F.col("col_no").cast("string")).alias("claim"), F.col("item_key").alias("region"), F.col("page_index").alias("page"), F.col("text").alias("cited"))
    regions = items.select(F.col("item_key").alias("region"), F.col("page_index").alias("page"), F.col("value").alias("text"))
    return V.grounding(claims, regions)


def cell_precedence(spark: SparkSession, d: str) -> DataFrame:
    """Cell texts first, the printed grid of the item's value second, with their conflicts."""
    cells = distinct_cells(table(spark, d, "cells")).select("item_key", "row_no", "col_no", "text")
    grid = distinct_items(table(spark, d, "items").where("type = 'table'"), "value").select("item_key", F.posexplode(F.split("value", "\n")).alias("row_no", "line")).select("item_key", "row_no", F.posexplode(F.split("line", r" \| ")).alias("col_no", "printed"))
    both = cells.join(grid, ["item_key", "row_no", "col_no"], "left")
    return both.select("item_key", "row_no", "col_no", V.precedence(F.col("text"), F.col("printed")).alias("p")).select("item_key", "row_no", "col_no", "p.value", "p.conflict")


def atomic_merge(spark: SparkSession, d: str) -> DataFrame:
    """Upper-cased headings of a page, taken only if every heading of the page has text and a box."""
    heads = distinct_items(table(spark, d, "items").where("type = 'heading'"), *PAGE, "value", "bbox")
    ok = (F.trim("value") != "") & F.col("bbox").isNotNull()
    return V.atomic(heads, PAGE, ok, F.col("value"), F.trim("value"), "final").select("item_key", "merged", "final")


def form_fields(spark: SparkSession, d: str) -> DataFrame:
    forms = distinct_items(table(spark, d, "items").where("type in ('form', 'key_value')"), "value")
    return V.form_fields(forms, "item_key", "value")


def attempt_plan(spark: SparkSession, d: str) -> DataFrame:
    return V.interleaved(table(spark, d, "collections"), ["candidate", "reference"], 3, "collection_id")


def raster_gate(spark: SparkSession, d: str) -> DataFrame:
    images = distinct_items(table(spark, d, "items").where("type = 'image'"), "bbox", "confidence", "value")
    gate = V.raster_gate(F.col("bbox.width"), F.col("bbox.height"), F.col("confidence"), F.col("value").isNotNull(), 60000.0)
    return images.select("item_key", gate.alias("outcome"))


def outline_paths(spark: SparkSession, d: str) -> DataFrame:
    return V.outline_paths(outline_tree(spark, d).select("item_key", "parent"))


QUERIES = {f.__name__: f for f in (rule_bands, glyph_health, cell_grounding, cell_precedence, atomic_merge, form_fields, attempt_plan, raster_gate, outline_paths)}

_ITEMS = "i AS (SELECT DISTINCT item_key, parse_id, page_index, type, reading_order, level, value, confidence, bbox FROM items)"
_CELLS = "c AS (SELECT item_key, row_no, col_no, text FROM cells QUALIFY row_number() OVER (PARTITION BY item_key, row_no, col_no ORDER BY text DESC NULLS LAST) = 1)"

ORACLE = {
    "rule_bands": f"""
        WITH {_ITEMS}, b AS (SELECT item_key, parse_id, page_index, type, bbox.x AS x, bbox.y AS y, bbox.width AS w, bbox.height AS h FROM i WHERE bbox.width > 0 AND bbox.height > 0),
        m AS (SELECT a.item_key AS run_key, r.item_key AS rule_key, (r.y + r.h - a.y) / a.h AS place FROM b a JOIN b r ON a.parse_id = r.parse_id AND a.page_index = r.page_index AND a.type IN ('text', 'heading') AND r.type IN ('table', 'image')
            WHERE least(r.x + r.w, a.x + a.w) - greatest(r.x, a.x) >= 0.5 * a.w)
        SELECT run_key, rule_key, CASE WHEN place BETWEEN 0.35 AND 0.7 THEN 'strikethrough' ELSE 'underline' END AS role FROM m WHERE place BETWEEN 0.35 AND 0.7 OR place BETWEEN 0.75 AND 1.1
    """,
    "cell_grounding": f"""
        WITH {_CELLS}, {_ITEMS} SELECT concat_ws('-', c.item_key, row_no, col_no) AS claim, c.item_key AS region,
            CASE WHEN i.page_index IS NULL THEN 'unknown_region' WHEN coalesce(trim(text), '') = '' THEN 'nothing_cited' WHEN NOT coalesce(contains(lower(value), lower(trim(text))), false) THEN 'unknown_evidence' ELSE 'grounded' END AS reason
        FROM c LEFT JOIN i ON i.item_key = c.item_key
    """,
    "cell_precedence": f"""
        WITH {_CELLS}, {_ITEMS}, l AS (SELECT item_key, unnest(string_split(value, chr(10))) AS line, unnest(range(len(string_split(value, chr(10))))) AS row_no FROM i WHERE type = 'table' AND value IS NOT NULL),
        g AS (SELECT item_key, row_no, unnest(string_split(line, ' | ')) AS printed, unnest(range(len(string_split(line, ' | ')))) AS col_no FROM l),
        j AS (SELECT c.item_key, c.row_no, c.col_no, CASE WHEN trim(text) <> '' THEN trim(text) END AS a, CASE WHEN trim(printed) <> '' THEN trim(printed) END AS b FROM c LEFT JOIN g ON g.item_key = c.item_key AND g.row_no = c.row_no AND g.col_no = c.col_no)
        SELECT item_key, row_no, col_no, coalesce(a, b) AS value, coalesce(a <> b, false) AS conflict FROM j
    """,
    "atomic_merge": f"""
        WITH {_ITEMS}, h AS (SELECT *, bool_and(coalesce(trim(value) <> '', false) AND bbox IS NOT NULL) OVER (PARTITION BY parse_id, page_index) AS merged FROM i WHERE type = 'heading')
        SELECT item_key, merged, CASE WHEN merged THEN trim(value) ELSE value END AS final FROM h
    """,
    "form_fields": r"""
        WITH f AS (SELECT DISTINCT item_key, value FROM items WHERE type IN ('form', 'key_value') AND value IS NOT NULL), p AS (SELECT item_key, regexp_split_to_array(value, '[ \t\n\x0B\f\r]*;[ \t\n\x0B\f\r]*') AS ps FROM f),
        x AS (SELECT item_key, CAST(unnest(range(len(ps))) AS INTEGER) AS field_no, unnest(ps) AS part FROM p), y AS (SELECT item_key, field_no, trim(regexp_extract(part, '(?s)^([^=:]*)', 1), ' ') AS label, trim(regexp_extract(part, '(?s)^[^=:]*[=:](.*)$', 1), ' ') AS v FROM x WHERE trim(part, ' ') <> '')
        SELECT item_key, field_no, label, CASE WHEN v <> '' THEN v END AS value, CASE WHEN v <> '' THEN 'filled' ELSE 'unfilled' END AS state FROM y
    """,
    "attempt_plan": """
        SELECT collection_id, CAST(pair AS INTEGER) AS pair, system, CAST(row_number() OVER (PARTITION BY pair ORDER BY system, collection_id) AS INTEGER) AS position
        FROM (SELECT DISTINCT collection_id FROM collections) c, (SELECT unnest([1, 2, 3]) AS pair) p, (SELECT unnest(['candidate', 'reference']) AS system) s
    """,
    "raster_gate": f"""
        WITH {_ITEMS} SELECT item_key, CASE WHEN bbox.width IS NULL OR bbox.height IS NULL THEN 'evidence_missing' WHEN bbox.width <= 0 OR bbox.height <= 0 THEN 'crop_empty' WHEN bbox.width * bbox.height > 60000 THEN 'pixel_limit'
            WHEN coalesce(confidence, 0) < 0.6 THEN 'quality' WHEN value IS NULL THEN 'incomplete' ELSE 'admitted' END AS outcome FROM i WHERE type = 'image'
    """,
    "outline_paths": f"""
        WITH RECURSIVE {_ITEMS}, h AS (SELECT item_key, parse_id, level, row_number() OVER (PARTITION BY parse_id ORDER BY page_index, reading_order, item_key) AS k FROM i WHERE type = 'heading' AND level IS NOT NULL),
        t AS (SELECT a.item_key, arg_max(b.item_key, b.k) AS parent FROM h a LEFT JOIN h b ON a.parse_id = b.parse_id AND b.k < a.k AND b.level < a.level GROUP BY a.item_key),
        w AS (SELECT item_key, item_key::VARCHAR AS path, 0 AS depth FROM t WHERE parent IS NULL UNION ALL SELECT t.item_key, w.path || '/' || t.item_key, w.depth + 1 FROM w JOIN t ON t.parent = w.item_key)
        SELECT item_key, path, depth FROM w
    """,
}
