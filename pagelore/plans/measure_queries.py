"""Aggregates, windows, distinct and budgets over the model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelore.operators import aggregates as A
from pagelore.operators import budgets as B
from pagelore.operators import sets as S
from pagelore.operators import windows as W
from pagelore.operators.model import current_parses, distinct_items
from pagelore.session import table

PAGE = ["parse_id", "page_index"]


def document_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Per parse: pages, items, tables, images, characters and mean confidence."""
    items = distinct_items(table(spark, d, "items"), *PAGE, "type", "value", "confidence")
    g = items.groupBy("parse_id").agg(
        F.count_distinct("page_index").alias("pages"), F.count(F.lit(1)).alias("items"), F.count_if(F.col("type") == "table").alias("tables"), F.count_if(F.col("type") == "image").alias("images"),
        F.sum(F.length("value")).alias("chars"), (F.sum(F.round(F.col("confidence") * 10000).cast("bigint")) / F.count("confidence") / 10000).alias("confidence"),
    )
    return g.withColumn("chars", F.coalesce("chars", F.lit(0)))


def latency_nearest_rank(spark: SparkSession, d: str) -> DataFrame:
    return A.distribution(table(spark, d, "events"), ["event_type"], "value")


def parse_durations(spark: SparkSession, d: str) -> DataFrame:
    parses = current_parses(table(spark, d, "parses")).select(F.col("processing.engine").alias("engine"), F.col("processing.duration_ms").alias("duration_ms"))
    return A.distribution(parses, ["engine"], "duration_ms")


def weighted_confidence(spark: SparkSession, d: str) -> DataFrame:
    items = distinct_items(table(spark, d, "items"), *PAGE, "value", "confidence")
    return items.groupBy(*PAGE).agg(A.weighted_confidence(F.col("confidence"), F.col("value")).alias("confidence"))


def axis_fit(spark: SparkSession, d: str) -> DataFrame:
    fit = A.linear_fit(table(spark, d, "part").select("p_brand", F.col("p_size").cast("double").alias("size"), "p_retailprice"), ["p_brand"], "size", "p_retailprice")
    return fit.select("p_brand", *[F.round(c, 6).alias(c) for c in ("slope", "intercept", "residual")], "n")


def stack_totals(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    points = orders.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("category"), F.col("o_orderpriority").alias("series")).agg(F.sum("o_totalprice").alias("value"))
    points = points.withColumn("tolerance", F.col("value") * 0.01)
    return A.stack_totals(points, ["category"], "series", "value", "tolerance", 0.0, 1e7).select("category", "members", "series", F.round("total", 2).alias("total"), "valid")


def digest_stability(spark: SparkSession, d: str) -> DataFrame:
    parses = table(spark, d, "parses").select(F.col("document.sha256").alias("sha256"), F.sha2(F.to_json("document"), 256).alias("digest"))
    return A.stability(parses, ["sha256"], "digest").where("runs > 1")


def attempt_gate(spark: SparkSession, d: str) -> DataFrame:
    parses = current_parses(table(spark, d, "parses"))
    attempts = parses.select(F.col("document.mime_type").alias("mime_type"), F.col("processing.duration_ms").alias("duration_ms"), (F.col("document.page_count") > 0).alias("ok"))
    limits = attempts.groupBy("mime_type").agg(F.lit(20000).cast("bigint").alias("limit_p50"), F.lit(60000).cast("bigint").alias("limit_p95"))
    return A.attempt_gate(attempts, "mime_type", "ok", "duration_ms", limits).select("mime_type", "attempts", "failures", "p50", "p95", "passes")


def telemetry_counts(spark: SparkSession, d: str) -> DataFrame:
    items = distinct_items(table(spark, d, "items"), "type", "source")
    return items.groupBy("type", "source").agg(F.count(F.lit(1)).alias("n"))


def item_type_rollup(spark: SparkSession, d: str) -> DataFrame:
    """An addition: totals by type and source, by type, and of all."""
    items = distinct_items(table(spark, d, "items"), "type", "source").withColumn("source", F.coalesce("source", F.lit("none")))
    return items.rollup("type", "source").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("int").alias("level"))


def used_range(spark: SparkSession, d: str) -> DataFrame:
    cells = table(spark, d, "cells").where(F.trim("text") != "")
    return cells.groupBy("item_key").agg(F.min("row_no").alias("first_row"), F.max("row_no").alias("last_row"), F.min("col_no").alias("first_col"), F.max("col_no").alias("last_col"), F.count_distinct("row_no", "col_no").alias("cells"))


def reading_order_contiguous(spark: SparkSession, d: str) -> DataFrame:
    return W.contiguous(distinct_items(table(spark, d, "items"), *PAGE, "reading_order"), PAGE, "reading_order")


def occurrence_index(spark: SparkSession, d: str) -> DataFrame:
    items = distinct_items(table(spark, d, "items"), "parse_id", "page_index", "reading_order", "type", "value").where("value <> ''")
    return W.occurrence_index(items, ["parse_id", "type", "value"], ["page_index", "reading_order", "item_key"]).select("item_key", "occurrence")


def row_islands(spark: SparkSession, d: str) -> DataFrame:
    """Horizontal bands of a page: boxes that chain together vertically."""
    rows = distinct_items(table(spark, d, "items"), *PAGE, "bbox").where("bbox.height > 0").select("item_key", *PAGE, F.col("bbox.y").alias("start"), (F.col("bbox.y") + F.col("bbox.height")).alias("end"))
    return W.interval_islands(rows, PAGE, "start", "end", ["item_key"]).select("item_key", "island")


def source_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of equal source along the reading order of each page."""
    rows = distinct_items(table(spark, d, "items"), *PAGE, "reading_order", "source")
    return W.style_runs(rows, PAGE, ["reading_order", "item_key"], F.col("source")).select("item_key", "run")


def source_margin(spark: SparkSession, d: str) -> DataFrame:
    """The source that leads each parse by 10 % of its items, or none."""
    rows = distinct_items(table(spark, d, "items"), "parse_id", "source").where("source is not null")
    total = rows.groupBy("parse_id").agg(F.count(F.lit(1)).alias("total"))
    share = rows.groupBy("parse_id", "source").agg(F.count(F.lit(1)).alias("n")).join(total, "parse_id").select("parse_id", "source", (F.col("n") / F.col("total")).alias("share"))
    return W.margin_choice(share, ["parse_id"], "share", "source", 0.10).select("parse_id", "source", F.round("best", 6).alias("best"), "lead")


def running_regions(spark: SparkSession, d: str) -> DataFrame:
    """Header and footer texts on at least two pages of a parse, once a page; the page's label stands for {page}."""
    pages = table(spark, d, "pages").groupBy(*PAGE).agg(F.max("page_label").alias("label"))
    rows = distinct_items(table(spark, d, "items").where("type in ('header', 'footer')"), *PAGE, "type", "value").where("value <> ''").join(pages, PAGE, "left")
    text = F.trim(F.regexp_replace(F.lower("value"), r"\s+", " "))
    text = F.when(F.col("label").isNotNull(), F.replace(text, F.lower("label"), F.lit("{page}"))).otherwise(text)
    return W.repeated_regions(rows.withColumn("signature", text), "parse_id", "page_index", ["type", "signature"])


def left_edge_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Columns of a page: clusters of left edges about their running median."""
    rows = distinct_items(table(spark, d, "items"), *PAGE, "bbox").where("bbox.width > 0").select(*PAGE, F.col("bbox.x").alias("x"))
    return W.median_clusters(rows, PAGE, "x", 12.0).groupBy(*PAGE, "cluster").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("x"), 4).alias("left"))


def fingerprint_distinct(spark: SparkSession, d: str) -> DataFrame:
    """The first parse of each uploaded file."""
    parses = current_parses(table(spark, d, "parses")).select("parse_id", "parsed_at", F.col("document.sha256").alias("sha256"), F.col("document.filename").alias("filename"))
    return S.first_of_each(parses, ["sha256"], ["parsed_at", "parse_id"]).select("sha256", "parse_id", "filename")


def line_distinct(spark: SparkSession, d: str) -> DataFrame:
    """Distinct normalised lines of the documents with the number of documents and sources that hold them."""
    lines = table(spark, d, "documents").select("doc_id", "source", F.explode(F.split("text", "\n")).alias("line")).select("doc_id", "source", F.trim(F.regexp_replace(F.lower("line"), "[^0-9a-z]+", " ")).alias("line")).where("line <> ''")
    return lines.groupBy("line").agg(F.count_distinct("doc_id").alias("documents"), F.count_distinct("source").alias("sources")).where("documents > 1")


def observation_best(spark: SparkSession, d: str) -> DataFrame:
    """Of equal texts in a parse, the item of the highest confidence."""
    rows = distinct_items(table(spark, d, "items"), "parse_id", "value", "confidence", "source").where("value <> ''")
    return S.best_observation(rows, ["parse_id", "value"], "confidence", ["item_key"]).select("parse_id", "item_key", "confidence")


def coalesced_relations(spark: SparkSession, d: str) -> DataFrame:
    """Next-in-order edges between item types, each kind once."""
    rows = distinct_items(table(spark, d, "items"), *PAGE, "type", "reading_order")
    after = rows.select(*PAGE, (F.col("reading_order") - 1).alias("reading_order"), F.col("type").alias("next_type"))
    return S.coalesce_relations(rows.join(after, [*PAGE, "reading_order"]), ["type", "next_type"], "item_key")


def geometry_distinct(spark: SparkSession, d: str) -> DataFrame:
    """Items left when repeated words at one place of a page are dropped."""
    rows = distinct_items(table(spark, d, "items"), *PAGE, "value", "reading_order", "bbox").where("value <> ''").withColumn("value", F.trim(F.regexp_replace("value", r"\s+", " ")))
    return S.geometry_distinct(rows, PAGE, "value", "reading_order", "bbox", "item_key").select("item_key")


def anchor_cap(spark: SparkSession, d: str) -> DataFrame:
    """At most 12 items of a page, in reading order."""
    rows = distinct_items(table(spark, d, "items"), *PAGE, "reading_order")
    return B.cap(rows, PAGE, ["reading_order", "item_key"], 12).select("item_key", "truncated")


def review_budget(spark: SparkSession, d: str) -> DataFrame:
    """Items with concerns that fit a parse's budget of 8 packets and 1,500 bytes, in page order."""
    rows = distinct_items(table(spark, d, "items"), *PAGE, "value", "parse_concerns").where("size(parse_concerns) > 0").select("parse_id", "page_index", "item_key", F.coalesce(F.octet_length("value"), F.lit(0)).cast("double").alias("bytes"))
    return B.greedy_budget(rows, ["parse_id"], ["page_index", "item_key"], {"bytes": 1500.0}, 8).select("item_key", "taken", "exhausted")


QUERIES = {
    f.__name__: f
    for f in (
        document_metrics, latency_nearest_rank, parse_durations, weighted_confidence, axis_fit, stack_totals, digest_stability, attempt_gate, telemetry_counts, item_type_rollup, used_range,
        reading_order_contiguous, occurrence_index, row_islands, source_runs, source_margin, running_regions, left_edge_clusters, fingerprint_distinct, line_distinct, observation_best,
        coalesced_relations, geometry_distinct, anchor_cap, review_budget,
    )
}

_PARSES = "p AS (SELECT * FROM parses QUALIFY row_number() OVER (PARTITION BY parse_id ORDER BY loaded_at DESC) = 1)"
_ITEMS = "i AS (SELECT DISTINCT item_key, parse_id, page_index, type, source, reading_order, value, confidence, bbox FROM items)"
_DIST = "count({v}) AS n, min({v}) AS min, quantile_disc({v}, 0.5) AS p50, quantile_disc({v}, 0.95) AS p95, max({v}) AS max, round(avg({v}), 6) AS mean"

ORACLE = {
    "document_metrics": f"""
        WITH {_ITEMS} SELECT parse_id, count(DISTINCT page_index) AS pages, count(*) AS items, count(*) FILTER (type = 'table') AS tables, count(*) FILTER (type = 'image') AS images,
            CAST(coalesce(sum(length(value)), 0) AS BIGINT) AS chars, sum(CAST(round(confidence * 10000) AS BIGINT)) / count(confidence) / 10000 AS confidence FROM i GROUP BY 1
    """,
    "latency_nearest_rank": f"SELECT event_type, {_DIST.format(v='value')} FROM events WHERE value IS NOT NULL GROUP BY 1",
    "parse_durations": f"WITH {_PARSES} SELECT processing.engine AS engine, {_DIST.format(v='processing.duration_ms')} FROM p WHERE processing.duration_ms IS NOT NULL GROUP BY 1",
    "weighted_confidence": f"""
        WITH {_ITEMS} SELECT parse_id, page_index, round(sum(confidence * greatest(coalesce(length(value), 0), 1)) / sum(greatest(coalesce(length(value), 0), 1)) FILTER (confidence IS NOT NULL), 4) AS confidence FROM i GROUP BY ALL
    """,
    "axis_fit": """
        WITH f AS (SELECT p_brand, regr_slope(p_retailprice, p_size) AS s, regr_intercept(p_retailprice, p_size) AS c, count(*) AS n FROM part GROUP BY 1)
        SELECT p_brand, round(s, 6) AS slope, round(c, 6) AS intercept, round(max(abs(p_retailprice - (s * p_size + c))), 6) AS residual, n FROM part JOIN f USING (p_brand) WHERE abs(s) >= 1e-12 GROUP BY p_brand, s, c, n
    """,
    "stack_totals": """
        WITH v AS (SELECT strftime(o_orderdate, '%Y-%m') AS category, o_orderpriority AS series, sum(o_totalprice) AS value FROM orders GROUP BY ALL)
        SELECT category, count(*) AS members, count(DISTINCT series) AS series, round(sum(value), 2) AS total,
            count(*) >= 2 AND count(DISTINCT series) = count(*) AND sum(value) BETWEEN -sum(value * 0.01) AND 1e7 + sum(value * 0.01) AS valid
        FROM v GROUP BY 1
    """,
    "digest_stability": """
        SELECT document.sha256 AS sha256, count(*) AS runs, count(DISTINCT document) AS digests, count(DISTINCT document) = 1 AS stable FROM parses GROUP BY 1 HAVING count(*) > 1
    """,
    "attempt_gate": f"""
        WITH {_PARSES}, a AS (SELECT document.mime_type AS mime_type, count(*) AS attempts, count(*) FILTER (NOT document.page_count > 0) AS failures, quantile_disc(processing.duration_ms, 0.5) AS p50, quantile_disc(processing.duration_ms, 0.95) AS p95 FROM p GROUP BY 1)
        SELECT mime_type, attempts, failures, CASE WHEN failures = 0 THEN p50 END AS p50, CASE WHEN failures = 0 THEN p95 END AS p95, coalesce(failures = 0 AND p50 <= 20000 AND p95 <= 60000, false) AS passes FROM a
    """,
    "telemetry_counts": f"WITH {_ITEMS} SELECT type, source, count(*) AS n FROM i GROUP BY ALL",
    "item_type_rollup": f"WITH {_ITEMS} SELECT type, coalesce(source, 'none') AS source, count(*) AS n, 0 AS level FROM i GROUP BY ALL UNION ALL SELECT type, NULL, count(*), 1 FROM i GROUP BY ALL UNION ALL SELECT NULL, NULL, count(*), 3 FROM i",
    "used_range": "SELECT item_key, min(row_no) AS first_row, max(row_no) AS last_row, min(col_no) AS first_col, max(col_no) AS last_col, count(DISTINCT (row_no, col_no)) AS cells FROM cells WHERE trim(text) <> '' GROUP BY 1",
    "reading_order_contiguous": f"WITH {_ITEMS} SELECT parse_id, page_index, count(*) AS n, coalesce(count(DISTINCT reading_order) = count(*) AND min(reading_order) = 0 AND max(reading_order) = count(*) - 1, false) AS contiguous FROM i GROUP BY ALL",
    "occurrence_index": f"WITH {_ITEMS} SELECT item_key, CAST(row_number() OVER (PARTITION BY parse_id, type, value ORDER BY page_index, reading_order, item_key) - 1 AS INTEGER) AS occurrence FROM i WHERE value <> ''",
    "row_islands": f"""
        WITH {_ITEMS}, b AS (SELECT item_key, parse_id, page_index, bbox.y AS s, bbox.y + bbox.height AS e FROM i WHERE bbox.height > 0),
        r AS (SELECT *, max(e) OVER (PARTITION BY parse_id, page_index ORDER BY s, item_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM b)
        SELECT item_key, CAST(sum(CASE WHEN reach IS NULL OR s > reach + 0.5 THEN 1 ELSE 0 END) OVER (PARTITION BY parse_id, page_index ORDER BY s, item_key) - 1 AS INTEGER) AS island FROM r
    """,
    "source_runs": f"""
        WITH {_ITEMS}, c AS (SELECT item_key, parse_id, page_index, reading_order, CASE WHEN row_number() OVER w = 1 OR source IS NOT DISTINCT FROM lag(source) OVER w THEN 0 ELSE 1 END AS ch FROM i WINDOW w AS (PARTITION BY parse_id, page_index ORDER BY reading_order, item_key))
        SELECT item_key, CAST(sum(ch) OVER (PARTITION BY parse_id, page_index ORDER BY reading_order, item_key) AS INTEGER) AS run FROM c
    """,
    "source_margin": f"""
        WITH {_ITEMS}, n AS (SELECT parse_id, source, count(*) AS n FROM i WHERE source IS NOT NULL GROUP BY parse_id, source),
        s AS (SELECT parse_id, source, n / sum(n) OVER (PARTITION BY parse_id) AS share FROM n),
        r AS (SELECT *, row_number() OVER (PARTITION BY parse_id ORDER BY share DESC, source DESC) AS k, lead(share, 1, 0) OVER (PARTITION BY parse_id ORDER BY share DESC, source DESC) AS next FROM s)
        SELECT parse_id, CASE WHEN share - next >= 0.1 - 1e-12 THEN source END AS source, round(share, 6) AS best, round(share - next, 6) AS lead FROM r WHERE k = 1
    """,
    "running_regions": f"""
        WITH {_ITEMS}, l AS (SELECT parse_id, page_index, max(page_label) AS label FROM pages GROUP BY ALL),
        t AS (SELECT i.parse_id, i.page_index, type, trim(regexp_replace(lower(value), '\\s+', ' ', 'g')) AS s, lower(label) AS label FROM i LEFT JOIN l ON l.parse_id = i.parse_id AND l.page_index = i.page_index WHERE type IN ('header', 'footer') AND value <> ''),
        n AS (SELECT parse_id, page_index, type, CASE WHEN label IS NULL THEN s ELSE replace(s, label, '{{page}}') END AS signature, count(*) AS n FROM t GROUP BY ALL)
        SELECT parse_id, type, signature, count(*) AS pages, min(page_index) AS first_page, max(page_index) AS last_page FROM n GROUP BY ALL HAVING count(*) >= 2 AND max(n) = 1
    """,
    "fingerprint_distinct": f"WITH {_PARSES} SELECT document.sha256 AS sha256, parse_id, document.filename AS filename FROM p QUALIFY row_number() OVER (PARTITION BY document.sha256 ORDER BY parsed_at, parse_id) = 1",
    "line_distinct": """
        WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM documents), n AS (SELECT doc_id, source, trim(regexp_replace(lower(line), '[^0-9a-z]+', ' ', 'g')) AS line FROM l)
        SELECT line, count(DISTINCT doc_id) AS documents, count(DISTINCT source) AS sources FROM n WHERE line <> '' GROUP BY 1 HAVING count(DISTINCT doc_id) > 1
    """,
    "observation_best": f"WITH {_ITEMS} SELECT parse_id, item_key, confidence FROM i WHERE value <> '' QUALIFY row_number() OVER (PARTITION BY parse_id, value ORDER BY coalesce(confidence, -1) DESC, item_key DESC) = 1",
    "coalesced_relations": f"WITH {_ITEMS} SELECT a.type, b.type AS next_type, count(*) AS edges, min(a.item_key) AS first_item_key FROM i a JOIN i b ON a.parse_id = b.parse_id AND a.page_index = b.page_index AND a.reading_order + 1 = b.reading_order GROUP BY ALL",
    "anchor_cap": f"WITH {_ITEMS} SELECT item_key, count(*) OVER (PARTITION BY parse_id, page_index) > 12 AS truncated FROM i QUALIFY row_number() OVER (PARTITION BY parse_id, page_index ORDER BY reading_order, item_key) <= 12",
    "review_budget": """
        WITH RECURSIVE v AS (SELECT DISTINCT item_key, parse_id, page_index, coalesce(octet_length(encode(value)), 0) AS b FROM items WHERE len(parse_concerns) > 0),
        o AS (SELECT *, row_number() OVER (PARTITION BY parse_id ORDER BY page_index, item_key) AS k FROM v),
        f AS (
            SELECT parse_id, item_key, k, b <= 1500 AS taken, CASE WHEN b <= 1500 THEN b ELSE 0 END AS spent, CASE WHEN b <= 1500 THEN 1 ELSE 0 END AS cnt FROM o WHERE k = 1
            UNION ALL
            SELECT o.parse_id, o.item_key, o.k, f.cnt < 8 AND f.spent + o.b <= 1500, f.spent + CASE WHEN f.cnt < 8 AND f.spent + o.b <= 1500 THEN o.b ELSE 0 END, f.cnt + CASE WHEN f.cnt < 8 AND f.spent + o.b <= 1500 THEN 1 ELSE 0 END
            FROM f JOIN o ON o.parse_id = f.parse_id AND o.k = f.k + 1
        )
        SELECT item_key, taken, NOT bool_and(taken) OVER (PARTITION BY parse_id) AS exhausted FROM f
    """,
}
