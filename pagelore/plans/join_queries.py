"""Equi, semi, anti, range, spatial, nearest and as-of joins over the model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelore.operators import geometry as G
from pagelore.operators import joins as J
from pagelore.operators.model import current_pages, distinct_items
from pagelore.session import table

PAGE = ["parse_id", "page_index"]


def _boxed(spark: SparkSession, d: str, *more: str) -> DataFrame:
    return distinct_items(table(spark, d, "items"), "parse_id", "page_index", "type", "bbox", "reading_order", *more).where("bbox.width > 0 and bbox.height > 0")


def box_overlap_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Items of one page whose boxes overlap by 30 % of the smaller: y bands meet in bins, then the exact test."""
    rows = _boxed(spark, d)
    a = rows.select(*PAGE, F.col("item_key").alias("item_a"), F.col("bbox").alias("a"), F.col("bbox.y").alias("ay"), G.bottom(F.col("bbox")).alias("ae"))
    b = rows.select(*PAGE, F.col("item_key").alias("item_b"), F.col("bbox").alias("b"), F.col("bbox.y").alias("by"), G.bottom(F.col("bbox")).alias("be"))
    pairs = J.interval_join(a, b, PAGE, ("ay", "ae"), ("by", "be"), 200.0).where("item_a < item_b")
    return pairs.withColumn("overlap", F.round(G.of_smaller(F.col("a"), F.col("b")), 6)).where("overlap >= 0.3").select("item_a", "item_b", "overlap")


def similar_boxes(spark: SparkSession, d: str) -> DataFrame:
    rows = _boxed(spark, d)
    return J.similar_box_pairs(rows, PAGE, "item_key", "bbox", 0.5).select("item_key_a", "item_key_b", F.round("overlap", 6).alias("overlap"))


def type_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Items of one type and page of which one repeats the other, tables among them."""
    return J.duplicate_boxes(_boxed(spark, d), [*PAGE, "type"], "item_key", "bbox").select("type", "item_key_a", "item_key_b")


def containment_join(spark: SparkSession, d: str) -> DataFrame:
    """Items whose centre lies in the box of a table, image or form of the same page."""
    rows = _boxed(spark, d)
    inner = rows.select(*PAGE, "item_key", "bbox").where("type not in ('table', 'image', 'form')")
    outer = rows.where("type in ('table', 'image', 'form')").select(*PAGE, F.col("item_key").alias("owner_key"), F.col("bbox").alias("owner_box"))
    return J.centre_in_box_join(inner, outer, PAGE, "bbox", "owner_box").select("item_key", "owner_key")


def interval_stab(spark: SparkSession, d: str) -> DataFrame:
    """Horizontal centres of items within the width of the headings of their page."""
    rows = _boxed(spark, d)
    points = rows.where("type <> 'heading'").select(*PAGE, "item_key", (F.col("bbox.x") + F.col("bbox.width") / 2).alias("cx"))
    spans = rows.where("type = 'heading'").select(*PAGE, F.col("item_key").alias("heading_key"), F.col("bbox.x").alias("lo"), G.right(F.col("bbox")).alias("hi"))
    return J.stabbing_join(points, spans, PAGE, "cx", ("lo", "hi"), 150.0).select("item_key", "heading_key")


def interval_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Half-open line ranges that overlap: orders that claim the same stretch of a supplier's part conflict."""
    rows = table(spark, d, "lineitem").groupBy("l_suppkey", "l_partkey", "l_orderkey").agg(F.min("l_linenumber").alias("start"), F.max(F.col("l_linenumber") + F.col("l_quantity") / 10).alias("end"))
    a = rows.select("l_suppkey", "l_partkey", F.col("l_orderkey").alias("order_a"), F.col("start").cast("double").alias("as_"), F.col("end").alias("ae"))
    b = rows.select("l_suppkey", "l_partkey", F.col("l_orderkey").alias("order_b"), F.col("start").cast("double").alias("bs"), F.col("end").alias("be"))
    pairs = J.interval_join(a, b, ["l_suppkey", "l_partkey"], ("as_", "ae"), ("bs", "be"), 4.0, closed=False).where("order_a < order_b")
    return pairs.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("conflicts"))


def supplier_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """interval_conflicts over the whole supplier, whatever the part: pairs of its orders whose half-open line ranges overlap."""
    rows = table(spark, d, "lineitem").where("l_orderkey is not null").groupBy("l_suppkey", "l_orderkey").agg(F.min("l_linenumber").alias("start"), F.max(F.col("l_linenumber") + F.col("l_quantity") / 10).alias("end"))
    return J.overlap_counts(rows, ["l_suppkey"], ("start", "end"), 4.0).withColumnRenamed("pairs", "conflicts")


def nearest_tick(spark: SparkSession, d: str) -> DataFrame:
    """Each table item's left edge with its unique nearest heading edge on the page, within 60 points."""
    rows = _boxed(spark, d)
    points = rows.where("type in ('table', 'text')").select(*PAGE, "item_key", F.col("bbox.x").alias("at"))
    marks = rows.where("type = 'heading'").select(*PAGE, F.col("item_key").alias("tick_key"), F.col("bbox.x").alias("tick"))
    return J.nearest_join(points, marks, PAGE, "at", "tick", "tick_key", "item_key", 60.0).select("item_key", "tick_key", F.round("gap", 6).alias("gap"))


def asof_prior_event(spark: SparkSession, d: str) -> DataFrame:
    """Each purchase with the last page view of the same user at or before it."""
    events = table(spark, d, "events")
    kinds = events.select("event_id", "user_id", "ts", "event_type")
    left = kinds.where("event_type = 'purchase'").select("user_id", "event_id", "ts")
    right = kinds.where("event_type = 'view'").select("user_id", F.col("ts").alias("seen_at"), F.col("event_id").alias("view_id"))
    return J.as_of_join(left, right, ["user_id"], "ts", "seen_at", ["view_id"]).select("event_id", "prior_view_id")


def asof_prior_block(spark: SparkSession, d: str) -> DataFrame:
    """The block above each block: lowest bottom among those above it that overlap it horizontally by 20 %.

    Ties go to the nearest preceding in reading order. Blocks of a page meet in
    bins of x, as only overlapping columns count.
    """
    rows = _boxed(spark, d)
    a = rows.select(*PAGE, "item_key", F.col("bbox").alias("box"), F.col("bbox.x").alias("x1"), G.right(F.col("bbox")).alias("x2"))
    b = rows.select(*PAGE, F.col("item_key").alias("prior_key"), F.col("bbox").alias("prior"), F.col("reading_order").alias("prior_order"), F.col("bbox.x").alias("p1"), G.right(F.col("bbox")).alias("p2"))
    met = J.interval_join(a, b, PAGE, ("x1", "x2"), ("p1", "p2"), 150.0)
    above = met.where((F.col("item_key") != F.col("prior_key")) & (G.bottom(F.col("prior")) <= F.col("box.y") + 0.5) & (G.horizontal_overlap(F.col("box"), F.col("prior")) >= 0.2))
    return above.groupBy("item_key").agg(F.max_by("prior_key", F.struct(G.bottom(F.col("prior")), "prior_order", "prior_key")).alias("prior_key"))


def page_adjacency(spark: SparkSession, d: str) -> DataFrame:
    """The last item of each page with the first of the next."""
    items = distinct_items(table(spark, d, "items"), *PAGE, "type", "reading_order")
    order = F.struct("reading_order", "item_key")
    ends = items.groupBy(*PAGE).agg(F.max_by(F.struct("item_key", "type"), order).alias("last"), F.min_by(F.struct("item_key", "type"), order).alias("first"))
    after = ends.select("parse_id", (F.col("page_index") - 1).alias("page_index"), F.col("first").alias("next"))
    return ends.join(after, PAGE).select(*PAGE, F.col("last.item_key").alias("last_key"), F.col("last.type").alias("last_type"), F.col("next.item_key").alias("next_key"), F.col("next.type").alias("next_type"))


def listed_items(spark: SparkSession, d: str) -> DataFrame:
    """Edge to vertex, twice: items that a page lists and items there are, outer joined: what is missing on either side."""
    pages = current_pages(table(spark, d, "pages"))
    listed = pages.select(*PAGE, F.explode("items").alias("i")).select(*PAGE, F.col("i.id").alias("id"))
    there = distinct_items(table(spark, d, "items"), *PAGE, "id").select(*PAGE, "id", "item_key")
    both = listed.withColumn("listed", F.lit(True)).join(there, [*PAGE, "id"], "full_outer")
    kind = F.when(F.col("item_key").isNull(), "listed_only").when(F.col("listed").isNull(), "item_only").otherwise("both")
    return both.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def failed_page_items(spark: SparkSession, d: str) -> DataFrame:
    """Left semi: items on pages that failed."""
    failed = table(spark, d, "pages").where("not success").select(*PAGE).distinct()
    return distinct_items(table(spark, d, "items"), *PAGE).join(failed, PAGE, "left_semi").select("item_key")


def pages_without_items(spark: SparkSession, d: str) -> DataFrame:
    """Left anti: pages that hold no item."""
    return table(spark, d, "pages").select(*PAGE).distinct().join(table(spark, d, "items").select(*PAGE), PAGE, "left_anti")


def parity_diff(spark: SparkSession, d: str) -> DataFrame:
    """Multiset difference of the page's own list and its items, by page and type."""
    pages = current_pages(table(spark, d, "pages"))
    expected = pages.select("parse_id", F.explode("items").alias("i")).select("parse_id", F.col("i.type").alias("type"))
    actual = distinct_items(table(spark, d, "items"), "parse_id", "type").select("parse_id", "type")
    return J.multiset_difference(expected, actual, ["parse_id", "type"])


def caption_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Each text next to a table or image in reading order, with the first reason against its being the caption."""
    rows = distinct_items(table(spark, d, "items"), *PAGE, "type", "bbox", "reading_order")
    owners = rows.where("type in ('table', 'image')").select(*PAGE, F.col("item_key").alias("owner_key"), F.col("bbox").alias("owner"), F.explode(F.array(F.col("reading_order") - 1, F.col("reading_order") + 1)).alias("reading_order"))
    near = rows.where("type in ('text', 'heading')").select(*PAGE, "reading_order", "item_key", "bbox").join(owners, [*PAGE, "reading_order"])
    return near.select("item_key", "owner_key", G.caption_verdict(F.col("bbox"), F.col("owner")).alias("caption"), G.note_verdict(F.col("bbox"), F.col("owner")).alias("note"), G.child_verdict(F.col("bbox"), F.col("owner")).alias("child"))


QUERIES = {
    f.__name__: f
    for f in (
        box_overlap_pairs, similar_boxes, type_duplicates, containment_join, interval_stab, interval_conflicts, supplier_conflicts, nearest_tick, asof_prior_event, asof_prior_block,
        page_adjacency, listed_items, failed_page_items, pages_without_items, parity_diff, caption_verdicts,
    )
}

_BOXED = "b AS (SELECT DISTINCT item_key, parse_id, page_index, type, reading_order, bbox.x AS x, bbox.y AS y, bbox.width AS w, bbox.height AS h, bbox.unit AS unit FROM items WHERE bbox.width > 0 AND bbox.height > 0)"
_INTER = "greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y))"
_PAIR = "a.parse_id = b.parse_id AND a.page_index = b.page_index"

ORACLE = {
    "box_overlap_pairs": f"""
        WITH {_BOXED} SELECT a.item_key AS item_a, b.item_key AS item_b, round({_INTER} / least(a.w * a.h, b.w * b.h), 6) AS overlap
        FROM b a JOIN b ON {_PAIR} AND a.item_key < b.item_key WHERE round({_INTER} / least(a.w * a.h, b.w * b.h), 6) >= 0.3
    """,
    "similar_boxes": f"""
        WITH {_BOXED} SELECT a.item_key AS item_key_a, b.item_key AS item_key_b, round({_INTER} / greatest(a.w * a.h, b.w * b.h), 6) AS overlap
        FROM b a JOIN b ON {_PAIR} AND a.item_key < b.item_key WHERE {_INTER} / greatest(a.w * a.h, b.w * b.h) >= 0.5
    """,
    "type_duplicates": f"""
        WITH {_BOXED} SELECT a.type, a.item_key AS item_key_a, b.item_key AS item_key_b
        FROM b a JOIN b ON {_PAIR} AND a.type = b.type AND a.item_key < b.item_key
        WHERE {_INTER} / least(a.w * a.h, b.w * b.h) >= 0.82 OR {_INTER} / (a.w * a.h + b.w * b.h - {_INTER}) >= 0.55
    """,
    "containment_join": f"""
        WITH {_BOXED} SELECT a.item_key, b.item_key AS owner_key FROM b a JOIN b ON {_PAIR} AND a.type NOT IN ('table', 'image', 'form') AND b.type IN ('table', 'image', 'form')
        WHERE a.x + a.w / 2 BETWEEN b.x AND b.x + b.w AND a.y + a.h / 2 BETWEEN b.y AND b.y + b.h
    """,
    "interval_stab": f"""
        WITH {_BOXED} SELECT a.item_key, b.item_key AS heading_key FROM b a JOIN b ON {_PAIR} AND a.type <> 'heading' AND b.type = 'heading' WHERE a.x + a.w / 2 BETWEEN b.x AND b.x + b.w
    """,
    "interval_conflicts": """
        WITH r AS (SELECT l_suppkey, l_partkey, l_orderkey, CAST(min(l_linenumber) AS DOUBLE) AS s, max(l_linenumber + l_quantity / 10) AS e FROM lineitem GROUP BY ALL)
        SELECT a.l_suppkey, count(*) AS conflicts FROM r a JOIN r b ON a.l_suppkey = b.l_suppkey AND a.l_partkey = b.l_partkey AND a.l_orderkey < b.l_orderkey AND a.s < b.e AND b.s < a.e GROUP BY 1
    """,
    "supplier_conflicts": """
        WITH r AS (SELECT l_suppkey, l_orderkey, CAST(min(l_linenumber) AS DOUBLE) AS s, max(l_linenumber + l_quantity / 10) AS e FROM lineitem GROUP BY ALL)
        SELECT a.l_suppkey, count(*) AS conflicts FROM r a JOIN r b ON a.l_suppkey = b.l_suppkey AND a.l_orderkey < b.l_orderkey AND a.s < b.e AND b.s < a.e GROUP BY 1
    """,
    "nearest_tick": f"""
        WITH {_BOXED}, m AS (SELECT a.item_key, b.item_key AS tick_key, abs(a.x - b.x) AS gap FROM b a JOIN b ON {_PAIR} AND a.type IN ('table', 'text') AND b.type = 'heading' WHERE abs(a.x - b.x) <= 60),
        n AS (SELECT *, rank() OVER (PARTITION BY item_key ORDER BY gap) AS r FROM m)
        SELECT item_key, min(tick_key) AS tick_key, round(min(gap), 6) AS gap FROM n WHERE r = 1 GROUP BY 1 HAVING count(*) = 1
    """,
    "asof_prior_event": """
        WITH v AS (SELECT user_id, ts, max(event_id) AS view_id FROM events WHERE event_type = 'view' GROUP BY ALL)
        SELECT p.event_id, v.view_id AS prior_view_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts >= v.ts
    """,
    "asof_prior_block": f"""
        WITH {_BOXED}, m AS (
            SELECT a.item_key, b.item_key AS prior_key, row_number() OVER (PARTITION BY a.item_key ORDER BY b.y + b.h DESC, b.reading_order DESC, b.item_key DESC) AS r
            FROM b a JOIN b ON {_PAIR} AND a.item_key <> b.item_key AND b.y + b.h <= a.y + 0.5
            WHERE greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) / least(a.w, b.w) >= 0.2)
        SELECT item_key, prior_key FROM m WHERE r = 1
    """,
    "page_adjacency": """
        WITH i AS (SELECT DISTINCT item_key, parse_id, page_index, type, reading_order FROM items),
        e AS (SELECT *, row_number() OVER (PARTITION BY parse_id, page_index ORDER BY reading_order, item_key) AS f, row_number() OVER (PARTITION BY parse_id, page_index ORDER BY reading_order DESC, item_key DESC) AS l FROM i)
        SELECT a.parse_id, a.page_index, a.item_key AS last_key, a.type AS last_type, b.item_key AS next_key, b.type AS next_type
        FROM e a JOIN e b ON a.parse_id = b.parse_id AND a.page_index + 1 = b.page_index AND a.l = 1 AND b.f = 1
    """,
    "listed_items": """
        WITH p AS (SELECT parse_id, page_index, items FROM pages QUALIFY row_number() OVER (PARTITION BY parse_id, page_index ORDER BY loaded_at DESC) = 1),
        l AS (SELECT parse_id, page_index, unnest(items).id AS id FROM p), i AS (SELECT DISTINCT parse_id, page_index, id, item_key FROM items)
        SELECT CASE WHEN i.item_key IS NULL THEN 'listed_only' WHEN l.id IS NULL THEN 'item_only' ELSE 'both' END AS kind, count(*) AS n
        FROM l FULL JOIN i ON l.parse_id = i.parse_id AND l.page_index = i.page_index AND l.id = i.id GROUP BY 1
    """,
    "failed_page_items": "SELECT DISTINCT item_key FROM items i WHERE EXISTS (SELECT 1 FROM pages p WHERE NOT p.success AND p.parse_id = i.parse_id AND p.page_index = i.page_index)",
    "pages_without_items": "SELECT DISTINCT parse_id, page_index FROM pages p WHERE NOT EXISTS (SELECT 1 FROM items i WHERE p.parse_id = i.parse_id AND p.page_index = i.page_index)",
    "parity_diff": """
        WITH p AS (SELECT parse_id, page_index, items FROM pages QUALIFY row_number() OVER (PARTITION BY parse_id, page_index ORDER BY loaded_at DESC) = 1),
        e AS (SELECT parse_id, t AS type, count(*) AS n FROM (SELECT parse_id, unnest(items).type AS t FROM p) x GROUP BY ALL),
        a AS (SELECT parse_id, type, count(DISTINCT item_key) AS n FROM items GROUP BY ALL)
        SELECT coalesce(e.parse_id, a.parse_id) AS parse_id, coalesce(e.type, a.type) AS type, coalesce(e.n, 0) AS expected, coalesce(a.n, 0) AS actual
        FROM e FULL JOIN a ON e.parse_id = a.parse_id AND e.type IS NOT DISTINCT FROM a.type WHERE coalesce(e.n, 0) <> coalesce(a.n, 0)
    """,
    "caption_verdicts": f"""
        WITH i AS (SELECT DISTINCT item_key, parse_id, page_index, type, reading_order, bbox.x AS x, bbox.y AS y, bbox.width AS w, bbox.height AS h, bbox.unit AS unit FROM items),
        m AS (SELECT a.item_key, b.item_key AS owner_key, a.x, a.y, a.w, a.h, a.unit, b.x AS bx, b.y AS byy, b.w AS bw, b.h AS bh, b.unit AS bunit, {_INTER} AS inter,
                greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) / least(a.w, b.w) AS hor
              FROM i a JOIN i b ON {_PAIR} AND a.type IN ('text', 'heading') AND b.type IN ('table', 'image') AND abs(a.reading_order - b.reading_order) = 1)
        SELECT item_key, owner_key,
            CASE WHEN x IS NULL THEN 'caption_geometry_unavailable' WHEN bx IS NULL THEN 'owner_geometry_unavailable' WHEN w * h <= 0 THEN 'caption_empty' WHEN bw * bh <= 0 THEN 'owner_empty'
                WHEN inter / least(w * h, bw * bh) > 0.2 THEN 'overlap' WHEN hor < 0.2 THEN 'not_aligned' WHEN greatest(0, greatest(y, byy) - least(y + h, byy + bh)) > 72 THEN 'too_far' ELSE 'accepted' END AS caption,
            CASE WHEN x IS NULL OR bx IS NULL THEN 'geometry_unavailable' WHEN unit IS DISTINCT FROM bunit THEN 'unit_mismatch' WHEN inter > 0 THEN 'overlap' WHEN y < byy + bh THEN 'not_below'
                WHEN hor < 0.2 THEN 'not_aligned' WHEN y - (byy + bh) > 72 THEN 'too_far' ELSE 'accepted' END AS note,
            CASE WHEN x IS NULL OR bx IS NULL THEN 'geometry_unavailable' WHEN CASE WHEN w * h > 0 THEN inter / (w * h) ELSE 0 END < 0.8 THEN 'not_contained' ELSE 'accepted' END AS child
        FROM m
    """,
}
