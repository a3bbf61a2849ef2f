"""Graphs, tables, charts, reconciliation, confidence and rendering over the model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelore.operators import aggregates as A
from pagelore.operators import charts as C
from pagelore.operators import confidence as K
from pagelore.operators import geometry as G
from pagelore.operators import graph as R
from pagelore.operators import reconcile as Q
from pagelore.operators import render as D
from pagelore.operators import tables as T
from pagelore.operators.model import current_items, current_pages, distinct_items
from pagelore.plans.join_queries import asof_prior_block, box_overlap_pairs
from pagelore.session import table

PAGE = ["parse_id", "page_index"]


def _grids(spark: SparkSession, d: str) -> DataFrame:
    return T.dense_grids(T.grid_rows(T.distinct_cells(table(spark, d, "cells"))))


def overlap_components(spark: SparkSession, d: str) -> DataFrame:
    """Groups of items whose boxes overlap, however indirectly."""
    return R.components(box_overlap_pairs(spark, d), "item_a", "item_b")


def flag_closure(spark: SparkSession, d: str) -> DataFrame:
    """Nations as flags: each needs the one four keys on; every eleventh is switched off."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("flag"))
    flags = n.withColumn("enabled", F.col("flag") % 11 != 3)
    needs = n.where("flag % 3 <> 0").select("flag", (F.col("flag") + 4).alias("needs")).where("needs < 25")
    return R.closure_of_disabled(flags, needs)


def outline_tree(spark: SparkSession, d: str) -> DataFrame:
    heads = distinct_items(table(spark, d, "items").where("type = 'heading'"), *PAGE, "reading_order", "level").where("level is not null")
    return R.outline_parents(heads, ["parse_id"], ["page_index", "reading_order", "item_key"], "level", "item_key").select("item_key", "level", "parent")


def page_order(spark: SparkSession, d: str) -> DataFrame:
    """Items of each page in a stable order that keeps a block after the block above it."""
    nodes = distinct_items(table(spark, d, "items"), *PAGE, "reading_order").select(*PAGE, "item_key", F.coalesce("reading_order", F.lit(2_147_483_647)).alias("reading_order"))
    edges = asof_prior_block(spark, d).join(nodes.select("item_key", *PAGE), "item_key").select(*PAGE, F.col("prior_key").alias("source"), F.col("item_key").alias("target"))
    return R.stable_order(nodes, edges, PAGE, "item_key", "reading_order", "source", "target").select("item_key", "position", "accepted")


def xy_cut(spark: SparkSession, d: str) -> DataFrame:
    rows = distinct_items(table(spark, d, "items"), *PAGE, "reading_order", "bbox")
    return R.xy_cut(rows, PAGE, "bbox", "reading_order", "item_key").select("item_key", "position")


def claim_allocation(spark: SparkSession, d: str) -> DataFrame:
    """Texts claimed by the tables and images next to them in order; the nearest, then the earlier owner gets it."""
    rows = distinct_items(table(spark, d, "items"), *PAGE, "type", "reading_order")
    texts = rows.where("type = 'text'").select(*PAGE, F.col("item_key").alias("source_key"), F.col("reading_order").alias("at"))
    owners = rows.where("type in ('table', 'image')").select(*PAGE, F.col("item_key").alias("owner_key"), F.col("reading_order"), F.explode(F.sequence(F.col("reading_order") - 2, F.col("reading_order") + 2)).alias("at"))
    claims = texts.join(owners, [*PAGE, "at"]).withColumn("distance", F.abs(F.col("at") - F.col("reading_order")))
    return R.allocate_claims(claims, "source_key", "owner_key", ["distance", "reading_order"])


def span_slots(spark: SparkSession, d: str) -> DataFrame:
    return T.span_slots(T.distinct_cells(table(spark, d, "cells")))


def grid_assemble(spark: SparkSession, d: str) -> DataFrame:
    rows = T.grid_rows(T.distinct_cells(table(spark, d, "cells")))
    return rows.select("item_key", "row_no", F.array_join("texts", " | ").alias("line"), "header")


def rectangular_tables(spark: SparkSession, d: str) -> DataFrame:
    return _grids(spark, d).select("item_key", F.size("rows").alias("n_rows"), "header_rows", "rectangular")


def table_gate(spark: SparkSession, d: str) -> DataFrame:
    return T.table_gate(_grids(spark, d)).select("item_key", "outcome")


def pipe_tables(spark: SparkSession, d: str) -> DataFrame:
    return _grids(spark, d).select("item_key", T.pipe_table(F.col("rows")).alias("markdown"))


def html_tables(spark: SparkSession, d: str) -> DataFrame:
    return _grids(spark, d).select("item_key", T.html_table(F.col("rows"), F.col("header_rows")).alias("html"))


def running_columns(spark: SparkSession, d: str) -> DataFrame:
    return T.running_columns(T.distinct_cells(table(spark, d, "cells")))


def continued_tables(spark: SparkSession, d: str) -> DataFrame:
    items = distinct_items(table(spark, d, "items"), *PAGE, "type", "reading_order", "bbox")
    ends = items.groupBy(*PAGE).agg(F.min("reading_order").alias("lo"), F.max("reading_order").alias("hi"))
    placed = items.where("type = 'table'").join(ends, PAGE).select("item_key", *PAGE, F.col("bbox.x").alias("left"), F.col("bbox.width").alias("width"), (F.col("reading_order") == F.col("lo")).alias("first"), (F.col("reading_order") == F.col("hi")).alias("last"))
    tables = placed.join(T.table_gate(_grids(spark, d)), "item_key")
    return T.continued_tables(tables).select("first_key", "next_key", "signals", F.size("rows").alias("n_rows"))


def chart_points(spark: SparkSession, d: str) -> DataFrame:
    from pagelore.functions.scalars import number

    points = C.points_from_grid(_grids(spark, d)).withColumn("value", number(F.col("printed")))
    issues = C.point_issues(F.col("value"), F.col("printed"), F.lit(0.0), F.lit(0.0), F.lit(900000.0))
    return points.select("item_key", "category_no", "series_no", "series", "category", F.array_join(issues, ",").alias("issues"))


def bar_values(spark: SparkSession, d: str) -> DataFrame:
    """Values read off bars by each brand's axis fit of part prices over sizes."""
    part = table(spark, d, "part").select("p_partkey", "p_brand", F.col("p_size").cast("double").alias("tip"), F.lit(0.0).alias("base"), "p_retailprice")
    fits = A.linear_fit(part, ["p_brand"], "tip", "p_retailprice")
    return C.bar_values(part.select("p_partkey", "p_brand", "tip", "base"), fits, ["p_brand"], "tip", "base", 0.5).select("p_partkey", F.round("tolerance", 4).alias("tolerance"), F.round("value", 4).alias("value"))


def text_reconcile(spark: SparkSession, d: str) -> DataFrame:
    """Headings of one page and level as readings of each other, by source, with boxes and scripts as evidence."""
    rows = distinct_items(table(spark, d, "items").where("type in ('heading', 'key_value')"), *PAGE, "type", "value", "source", "confidence", "bbox", "reading_order").where("value <> ''")
    kind = F.when(F.col("source") == "mixed", "font").when(F.col("source") == "ocr", "ocr").otherwise("native")
    ready = rows.select(
        *PAGE, "type", F.trim(F.regexp_replace(F.lower("value"), r"\s+", " ")).alias("text"), kind.alias("kind"), F.coalesce("source", F.lit("none")).alias("lineage"), (F.col("reading_order") <= 1).alias("primary"), "confidence",
        F.lit(True).alias("source_ok"), (~F.col("value").contains("�")).alias("unicode_ok"), F.when(F.col("bbox.width") > 0, 1.0).otherwise(0.0).alias("overlap"), F.lit(True).alias("script_ok"),
    )
    return Q.reconcile(Q.eligible(ready), [*PAGE, "type"])


def confidence_dimensions(spark: SparkSession, d: str) -> DataFrame:
    items = distinct_items(table(spark, d, "items"), *PAGE, "type", "value", "source", "bbox", "reading_order", "parse_concerns")
    return K.dimensions(items, current_pages(table(spark, d, "pages")), _grids(spark, d))


def to_markdown(spark: SparkSession, d: str) -> DataFrame:
    items = distinct_items(table(spark, d, "items"), *PAGE, "reading_order", "type", "value", "level", "ordered")
    return D.documents(items, D.item_markdown(F.col("type"), F.col("value"), F.col("level"), F.col("ordered")))


def to_text(spark: SparkSession, d: str) -> DataFrame:
    items = distinct_items(table(spark, d, "items"), *PAGE, "reading_order", "type", "value")
    return D.documents(items, F.trim("value"))


def to_json(spark: SparkSession, d: str) -> DataFrame:
    return D.document_json(current_items(table(spark, d, "items")))


def body_views(spark: SparkSession, d: str) -> DataFrame:
    """Items of the body, header and footer views of each page."""
    items = distinct_items(table(spark, d, "items"), *PAGE, "type", "value").where("value <> ''")
    view = F.when(F.col("type") == "header", "header").when(F.col("type") == "footer", "footer").otherwise("body")
    return items.groupBy(*PAGE, view.alias("view")).agg(F.count(F.lit(1)).alias("items"), F.sum(F.length("value")).alias("chars"))


def nearest_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Children of tables: their contained items with the share of the child inside."""
    rows = distinct_items(table(spark, d, "items"), *PAGE, "type", "bbox").where("bbox.width > 0")
    pairs = box_overlap_pairs(spark, d)
    both = pairs.join(rows.select(F.col("item_key").alias("item_a"), F.col("bbox").alias("a")), "item_a").join(rows.select(F.col("item_key").alias("item_b"), F.col("bbox").alias("b")), "item_b")
    return both.select("item_a", "item_b", F.round(G.of_first(F.col("a"), F.col("b")), 6).alias("a_in_b"), F.round(G.iou(F.col("a"), F.col("b")), 6).alias("iou"))


QUERIES = {
    f.__name__: f
    for f in (
        overlap_components, flag_closure, outline_tree, page_order, xy_cut, claim_allocation, span_slots, grid_assemble, rectangular_tables, table_gate, pipe_tables, html_tables, running_columns,
        continued_tables, chart_points, bar_values, text_reconcile, confidence_dimensions, to_markdown, to_text, to_json, body_views, nearest_neighbours,
    )
}

_ITEMS = "i AS (SELECT DISTINCT item_key, parse_id, page_index, type, source, reading_order, value, confidence, level, ordered, bbox FROM items)"
_CELLS = """c AS (SELECT item_key, row_no, col_no, text, row_span, col_span, column_header FROM cells
    QUALIFY row_number() OVER (PARTITION BY item_key, row_no, col_no ORDER BY text DESC NULLS LAST, row_span DESC, col_span DESC) = 1)"""
_ROWS = f"{_CELLS}, r AS (SELECT item_key, row_no, list(coalesce(text, '') ORDER BY col_no) AS texts, bool_and(coalesce(column_header, false)) AS header FROM c GROUP BY ALL)"
_GRIDS = f"{_ROWS}, g AS (SELECT item_key, list(texts ORDER BY row_no) AS rows, CAST(count(*) FILTER (header) AS INTEGER) AS header_rows, count(DISTINCT len(texts)) = 1 AS rectangular, sum(len(texts)) AS total, sum(len(list_filter(texts, lambda t: trim(t) <> ''))) AS filled FROM r GROUP BY 1)"
_GATE = """CASE WHEN filled = 0 THEN 'structural_failure' WHEN NOT rectangular THEN 'unresolved'
    WHEN len(rows) < 2 OR len(rows[1]) < 2 THEN CASE WHEN len(rows[1]) = 2 OR len(rows) = 1 THEN 'key_value' ELSE 'unresolved' END WHEN filled < 0.25 * total THEN 'form' ELSE 'canonical_table' END"""
_BOXED = "b AS (SELECT DISTINCT item_key, parse_id, page_index, bbox.x AS x, bbox.y AS y, bbox.width AS w, bbox.height AS h FROM items WHERE bbox.width > 0 AND bbox.height > 0)"
_INTER = "greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y))"
_PAIRS = f"{_BOXED}, p AS (SELECT a.item_key AS item_a, b.item_key AS item_b, a.w * a.h AS area_a, b.w * b.h AS area_b, {_INTER} AS inter FROM b a JOIN b ON a.parse_id = b.parse_id AND a.page_index = b.page_index AND a.item_key < b.item_key WHERE round({_INTER} / least(a.w * a.h, b.w * b.h), 6) >= 0.3)"

ORACLE = {
    "overlap_components": f"""
        WITH RECURSIVE {_PAIRS}, e AS (SELECT item_a AS u, item_b AS v FROM p UNION SELECT item_b, item_a FROM p),
        reach AS (SELECT u AS node, u AS other FROM e UNION SELECT r.node, e.v FROM reach r JOIN e ON e.u = r.other)
        SELECT node, min(other) AS component FROM reach GROUP BY 1
    """,
    "flag_closure": """
        WITH RECURSIVE f AS (SELECT n_nationkey AS flag, n_nationkey % 11 <> 3 AS enabled FROM nation), n AS (SELECT n_nationkey AS flag, n_nationkey + 4 AS needs FROM nation WHERE n_nationkey % 3 <> 0 AND n_nationkey + 4 < 25),
        o AS (SELECT flag FROM f WHERE NOT enabled UNION SELECT n.flag FROM o JOIN n ON n.needs = o.flag)
        SELECT flag, flag NOT IN (SELECT flag FROM o) AS effective FROM f
    """,
    "outline_tree": f"""
        WITH {_ITEMS}, h AS (SELECT item_key, parse_id, level, row_number() OVER (PARTITION BY parse_id ORDER BY page_index, reading_order, item_key) AS k FROM i WHERE type = 'heading' AND level IS NOT NULL)
        SELECT a.item_key, a.level, arg_max(b.item_key, b.k) AS parent FROM h a LEFT JOIN h b ON a.parse_id = b.parse_id AND b.k < a.k AND b.level < a.level GROUP BY a.item_key, a.level
    """,
    "claim_allocation": f"""
        WITH {_ITEMS} SELECT t.item_key AS source_key, arg_min(o.item_key, (abs(t.reading_order - o.reading_order), o.reading_order, o.item_key)) AS owner_key
        FROM i t JOIN i o ON t.parse_id = o.parse_id AND t.page_index = o.page_index AND t.type = 'text' AND o.type IN ('table', 'image') AND abs(t.reading_order - o.reading_order) <= 2 GROUP BY 1
    """,
    "span_slots": f"""
        WITH {_CELLS}, s AS (SELECT *, unnest(range(row_no, row_no + greatest(coalesce(row_span, 1), 1))) AS sr FROM c), t AS (SELECT *, unnest(range(col_no, col_no + greatest(coalesce(col_span, 1), 1))) AS sc FROM s)
        SELECT item_key, CAST(sr AS INTEGER) AS slot_row, CAST(sc AS INTEGER) AS slot_col, CASE WHEN sr <> row_no OR sc <> col_no THEN 'covered' WHEN coalesce(trim(text), '') = '' THEN 'explicit_blank' ELSE 'anchor' END AS kind FROM t
    """,
    "grid_assemble": f"WITH {_ROWS} SELECT item_key, row_no, array_to_string(texts, ' | ') AS line, header FROM r",
    "rectangular_tables": f"WITH {_GRIDS} SELECT item_key, CAST(len(rows) AS INTEGER) AS n_rows, header_rows, rectangular FROM g",
    "table_gate": f"WITH {_GRIDS} SELECT item_key, {_GATE} AS outcome FROM g",
    "pipe_tables": rf"""
        WITH {_ROWS}, l AS (SELECT item_key, row_no, row_number() OVER (PARTITION BY item_key ORDER BY row_no) AS k, len(texts) AS n, '| ' || array_to_string(list_transform(texts, lambda t: regexp_replace(replace(t, '|', '\|'), '\s*\n\s*', '<br>', 'g')), ' | ') || ' |' AS line FROM r)
        SELECT item_key, string_agg(CASE WHEN k = 1 THEN line || chr(10) || '| ' || array_to_string(list_transform(range(n), lambda z: '---'), ' | ') || ' |' ELSE line END, chr(10) ORDER BY row_no) AS markdown FROM l GROUP BY 1
    """,
    "html_tables": f"""
        WITH {_GRIDS}, l AS (SELECT r.item_key, r.row_no, row_number() OVER (PARTITION BY r.item_key ORDER BY r.row_no) AS k, g.header_rows AS hr, texts FROM r JOIN g USING (item_key)),
        t AS (SELECT *, CASE WHEN k <= hr THEN 'th' ELSE 'td' END AS tag FROM l)
        SELECT item_key, '<table>' || string_agg('<tr>' || array_to_string(list_transform(texts, lambda x: '<' || tag || '>' || replace(replace(replace(replace(x, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') || '</' || tag || '>'), '') || '</tr>', '' ORDER BY row_no) || '</table>' AS html FROM t GROUP BY 1
    """,
    "running_columns": f"WITH {_CELLS} SELECT item_key, row_no, col_no, CAST(sum(greatest(coalesce(col_span, 1), 1)) OVER (PARTITION BY item_key, row_no ORDER BY col_no) - greatest(coalesce(col_span, 1), 1) AS INTEGER) AS grid_column FROM c",
    "continued_tables": f"""
        WITH {_GRIDS}, {_ITEMS}, e AS (SELECT parse_id, page_index, min(reading_order) AS lo, max(reading_order) AS hi FROM i GROUP BY ALL),
        t AS (SELECT i.item_key, i.parse_id, i.page_index, i.bbox.x AS l, i.bbox.width AS w, reading_order = lo AS f, reading_order = hi AS z, rows FROM i JOIN e ON e.parse_id = i.parse_id AND e.page_index = i.page_index JOIN g ON g.item_key = i.item_key WHERE i.type = 'table' AND {_GATE} = 'canonical_table'),
        p AS (SELECT a.item_key AS first_key, b.item_key AS next_key, CAST(coalesce(abs(a.l - b.l) <= 2 AND abs(a.w - b.w) <= 2, false) AS INTEGER) + CAST(a.rows[1] = b.rows[1] AS INTEGER) + CAST(a.z AND b.f AS INTEGER) + CAST(len(a.rows[1]) = len(b.rows[1]) AS INTEGER) AS signals,
            CAST(len(a.rows) + len(b.rows) - CASE WHEN a.rows[1] = b.rows[1] THEN 1 ELSE 0 END AS INTEGER) AS n_rows FROM t a JOIN t b ON a.parse_id = b.parse_id AND a.page_index + 1 = b.page_index)
        SELECT * FROM p WHERE signals >= 2
    """,
    "chart_points": rf"""
        WITH {_ROWS}, k AS (SELECT *, row_number() OVER (PARTITION BY item_key ORDER BY row_no) AS k FROM r), hd AS (SELECT item_key, texts AS head FROM k WHERE k = 1),
        b AS (SELECT item_key, k - 2 AS cno, texts, head FROM k JOIN hd USING (item_key) WHERE k > 1),
        x AS (SELECT item_key, cno, texts[1] AS cat, head, texts, unnest(range(len(texts) - 1)) AS sno FROM b),
        y AS (SELECT item_key, CAST(cno AS INTEGER) AS category_no, CAST(sno AS INTEGER) AS series_no, CASE WHEN len(list_filter(head, lambda q: q = head[sno + 2])) > 1 THEN head[sno + 2] || ' (' || (sno + 1) || ')' ELSE head[sno + 2] END AS series,
            CASE WHEN trim(cat) = '' THEN 'Category ' || (cno + 1) ELSE cat END AS category, texts[sno + 2] AS printed, regexp_replace(trim(texts[sno + 2]), '(?i)^(?:us)?[$€£¥]|^chf\s*|,|\s*(?:%|per cent)$', '', 'g') AS body FROM x),
        z AS (SELECT *, CASE WHEN body LIKE '(%)' THEN -try_cast(body[2:-2] AS DOUBLE) ELSE try_cast(body AS DOUBLE) END AS value FROM y)
        SELECT item_key, category_no, series_no, series, category, concat_ws(',', CASE WHEN value IS NOT NULL AND NOT value BETWEEN 0 AND 900000 THEN 'axis_range' END, CASE WHEN trim(printed) = '' THEN 'evidence_incomplete' END, CASE WHEN value IS NULL AND trim(printed) <> '' THEN 'method' END) AS issues FROM z
    """,
    "bar_values": """
        WITH f AS (SELECT p_brand, regr_slope(p_retailprice, p_size) AS s, regr_intercept(p_retailprice, p_size) AS c FROM part GROUP BY 1),
        r AS (SELECT p_brand, s, c, max(abs(p_retailprice - (s * p_size + c))) AS res FROM part JOIN f USING (p_brand) WHERE abs(s) >= 1e-12 GROUP BY ALL)
        SELECT p_partkey, round(2 * abs(s) * 0.5 + 2 * res, 4) AS tolerance, CASE WHEN abs(s * p_size + c - c) > 2 * abs(s) * 0.5 + 2 * res THEN round(abs(s * p_size + c - c), 4) END AS value FROM part JOIN r USING (p_brand)
    """,
    "text_reconcile": r"""
        WITH k AS (SELECT DISTINCT item_key, parse_id, page_index, type, trim(regexp_replace(lower(value), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS text, CASE source WHEN 'mixed' THEN 'font' WHEN 'ocr' THEN 'ocr' ELSE 'native' END AS kind, coalesce(source, 'none') AS lineage, reading_order <= 1 AS prim, confidence,
            contains(value, '�') AS bad, coalesce(bbox.width > 0, false) AS boxed FROM items WHERE type IN ('heading', 'key_value') AND value <> ''),
        e AS (SELECT * FROM k WHERE NOT bad AND boxed),
        t AS (SELECT parse_id, page_index, type, text, count(DISTINCT lineage) AS lin, max(confidence) FILTER (kind = 'ocr') AS conf FROM e GROUP BY ALL),
        o AS (SELECT *, row_number() OVER (PARTITION BY parse_id, page_index, type ORDER BY conf DESC, text DESC) AS r FROM t WHERE conf IS NOT NULL),
        a AS (SELECT parse_id, page_index, type, count(*) FILTER (lin >= 2) AS agreed, min(text) FILTER (lin >= 2) AS agreed_text FROM t GROUP BY ALL),
        s AS (SELECT parse_id, page_index, type, max(n) > 1 AS self FROM (SELECT parse_id, page_index, type, lineage, count(DISTINCT text) AS n FROM e GROUP BY ALL) q GROUP BY ALL),
        g AS (SELECT parse_id, page_index, type, count(DISTINCT text) FILTER (kind = 'font' AND NOT bad AND boxed) AS fonts, min(text) FILTER (kind = 'font' AND NOT bad AND boxed) AS font_text,
            count(DISTINCT text) FILTER (kind = 'native' AND prim AND NOT bad AND boxed) AS natives, min(text) FILTER (kind = 'native' AND prim AND NOT bad AND boxed) AS native_text, bool_or(NOT boxed) AS no_box, bool_or(bad) AS any_bad FROM k GROUP BY ALL),
        j AS (SELECT g.*, coalesce(agreed, 0) AS agreed, agreed_text, coalesce(self, false) AS self, o1.conf AS c1, o1.text AS t1, coalesce(o2.conf, 0) AS c2 FROM g
            LEFT JOIN a ON a.parse_id = g.parse_id AND a.page_index = g.page_index AND a.type = g.type LEFT JOIN s ON s.parse_id = g.parse_id AND s.page_index = g.page_index AND s.type = g.type
            LEFT JOIN o o1 ON o1.r = 1 AND o1.parse_id = g.parse_id AND o1.page_index = g.page_index AND o1.type = g.type LEFT JOIN o o2 ON o2.r = 2 AND o2.parse_id = g.parse_id AND o2.page_index = g.page_index AND o2.type = g.type)
        SELECT parse_id, page_index, type,
            CASE WHEN fonts = 1 THEN 'selected' WHEN fonts > 1 THEN 'unresolved' WHEN natives = 1 THEN 'unchanged' WHEN self THEN 'unresolved' WHEN agreed = 1 THEN 'selected' WHEN c1 >= 0.9 AND c1 - c2 >= 0.1 - 1e-12 THEN 'selected' ELSE 'unresolved' END AS decision,
            CASE WHEN fonts = 1 THEN 'deterministic_font_evidence' WHEN fonts > 1 THEN 'ambiguous_conflict' WHEN natives = 1 THEN 'healthy_native_authoritative' WHEN self THEN 'dependent_source_agreement' WHEN agreed = 1 THEN 'independent_exact_agreement'
                WHEN c1 >= 0.9 AND c1 - c2 >= 0.1 - 1e-12 THEN 'independent_high_confidence_ocr' WHEN c1 IS NOT NULL THEN 'low_margin_conflict' WHEN no_box THEN 'overlap' WHEN any_bad THEN 'unicode' ELSE 'no_candidate' END AS reason,
            CASE WHEN fonts = 1 THEN font_text WHEN fonts > 1 THEN NULL WHEN natives = 1 THEN native_text WHEN self THEN NULL WHEN agreed = 1 THEN agreed_text WHEN c1 >= 0.9 AND c1 - c2 >= 0.1 - 1e-12 THEN t1 END AS text
        FROM j
    """,
    "confidence_dimensions": f"""
        WITH {_GRIDS}, i AS (SELECT DISTINCT item_key, parse_id, page_index, type, source, reading_order, value, bbox, parse_concerns FROM items),
        pg AS (SELECT * FROM pages QUALIFY row_number() OVER (PARTITION BY parse_id, page_index ORDER BY loaded_at DESC) = 1),
        p AS (SELECT parse_id, bool_or(NOT coalesce(success, true)) AS failed, bool_or(coalesce(len(warnings), 0) > 0) AS warned FROM pg GROUP BY 1),
        o AS (SELECT parse_id, bool_and(ok) AS in_order FROM (SELECT parse_id, count(DISTINCT reading_order) = count(*) AND max(reading_order) = count(*) - 1 AS ok FROM i GROUP BY parse_id, page_index) q GROUP BY 1),
        m AS (SELECT parse_id, count(*) FILTER (type IN ('text', 'heading', 'list')) AS texts, count(*) FILTER (type IN ('text', 'heading', 'list') AND coalesce(trim(value), '') = '') AS blank, count(*) FILTER (list_contains(parse_concerns, 'low_confidence')) AS concerns,
            count(*) FILTER (type IN ('text', 'heading', 'list') AND source IS DISTINCT FROM 'native') AS foreign_, count(*) FILTER (bbox IS NULL) AS boxless, count(*) FILTER (type = 'table') AS tables FROM i GROUP BY 1),
        t AS (SELECT parse_id, bool_and(coalesce(rectangular, false)) AS regular, bool_and(coalesce(source = 'native', false)) AS native_tables FROM i LEFT JOIN g USING (item_key) WHERE type = 'table' GROUP BY 1),
        j AS (SELECT m.parse_id, CASE WHEN texts = 0 OR blank > 0 THEN 'unavailable' WHEN coalesce(failed, false) OR concerns > 0 THEN 'unsupported' WHEN coalesce(warned, false) OR foreign_ > 0 THEN 'guarded' ELSE 'supported' END AS text,
            CASE WHEN coalesce(failed, false) OR NOT coalesce(in_order, false) THEN 'unsupported' WHEN boxless > 0 OR coalesce(warned, false) THEN 'guarded' ELSE 'supported' END AS layout,
            CASE WHEN tables = 0 THEN 'not_applicable' WHEN NOT coalesce(regular, false) THEN 'unsupported' WHEN coalesce(native_tables, false) THEN 'supported' ELSE 'guarded' END AS tables
            FROM m LEFT JOIN p USING (parse_id) LEFT JOIN o USING (parse_id) LEFT JOIN t USING (parse_id))
        SELECT *, CASE text WHEN 'supported' THEN 'accept' WHEN 'guarded' THEN 'concern' WHEN 'unsupported' THEN 'fallback' ELSE 'withhold' END AS decision FROM j
    """,
    "to_markdown": f"""
        WITH {_ITEMS}, l AS (SELECT *, string_split(value, chr(10)) AS ls FROM i WHERE coalesce(trim(value, ' '), '') <> ''),
        b AS (SELECT parse_id, page_index, reading_order, item_key, CASE type WHEN 'heading' THEN repeat('#', least(greatest(coalesce(level, 1), 1), 6)::INTEGER) || ' ' || trim(value, ' ')
            WHEN 'list' THEN array_to_string(list_filter(list_transform(ls, lambda x, k: CASE WHEN trim(x, ' ') <> '' THEN CASE WHEN coalesce(ordered, false) THEN k || '. ' ELSE '- ' END || trim(x, ' ') END), lambda q: q IS NOT NULL), chr(10))
            WHEN 'code' THEN '```' || chr(10) || value || chr(10) || '```' ELSE trim(value, ' ') END AS md FROM l)
        SELECT p.parse_id, coalesce((string_agg(md, chr(10) || chr(10) ORDER BY page_index NULLS FIRST, reading_order NULLS FIRST, item_key) FILTER (trim(md, ' ') <> '')) || chr(10), chr(10)) AS rendered FROM (SELECT DISTINCT parse_id FROM i) p LEFT JOIN b ON b.parse_id = p.parse_id GROUP BY 1
    """,
    "to_text": f"""
        WITH {_ITEMS} SELECT parse_id, coalesce((string_agg(trim(value, ' '), chr(10) || chr(10) ORDER BY page_index NULLS FIRST, reading_order NULLS FIRST, item_key) FILTER (trim(value, ' ') <> '')) || chr(10), chr(10)) AS rendered FROM i GROUP BY 1
    """,
    "body_views": f"WITH {_ITEMS} SELECT parse_id, page_index, CASE type WHEN 'header' THEN 'header' WHEN 'footer' THEN 'footer' ELSE 'body' END AS view, count(*) AS items, CAST(sum(length(value)) AS BIGINT) AS chars FROM i WHERE value <> '' GROUP BY ALL",
    "nearest_neighbours": f"WITH {_PAIRS} SELECT item_a, item_b, round(inter / area_a, 6) AS a_in_b, round(inter / (area_a + area_b - inter), 6) AS iou FROM p",
}
