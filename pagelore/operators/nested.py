"""Deeply nested records to flat tables with parent-child links.

The merged schema is inferred over all bodies: each path with the kinds of value
seen there. It tells how deep items nest. Bodies become VARIANT values, and every
array level is exploded in turn: pages, then items level by level, each row with
the path of ordinals that is its surrogate key and with its parent's. All levels
are built in one projection per result, so a body is parsed once and nothing is
shuffled but the deliveries' keys.

Defined results: a body that is null or does not parse gives no rows; of several
deliveries of one result the latest that parses counts (a tie: the greater text);
an absent, null or scalar level has no children; one object in place of an array
is an array of one; an item without an id has a null id, its children the parent
''. Unknown fields stay in the schema and take no part elsewhere.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHILD_FIELDS = ("items", "contained_items")


def _as_array(node: Column, path: str) -> Column:
    """The array at a path; one object is an array of one, else null."""
    many = F.try_variant_get(node, path, "array<variant>")
    one = F.try_variant_get(node, path, "map<string,variant>")
    return F.coalesce(many, F.when(one.isNotNull(), F.array(F.try_variant_get(node, path, "variant"))))


def _is_object(node: Column) -> Column:
    return F.try_variant_get(node, "$", "map<string,variant>").isNotNull()


def latest_bodies(results: DataFrame) -> DataFrame:
    """result_id, sha256, received_at and doc (VARIANT) of the latest delivery that parses."""
    parsed = results.where(F.col("body").isNotNull()).where(F.try_parse_json("body").isNotNull())
    latest = parsed.groupBy("result_id").agg(F.max(F.struct("received_at", "body", "sha256")).alias("r"))
    return latest.select("result_id", "r.sha256", "r.received_at", F.try_parse_json("r.body").alias("doc"))


def _kind(value: object) -> str:
    return {dict: "object", list: "array", str: "string", bool: "boolean", int: "integer", float: "number", type(None): "null"}[type(value)]


def _walk(value: object, path: str, depth: int, counts: Counter) -> None:
    stack = [(value, path, depth)]
    while stack:
        value, path, depth = stack.pop()
        counts[(path, _kind(value), depth)] += 1
        if isinstance(value, dict):
            stack += [(v, f"{path}.{k}", depth + (k in CHILD_FIELDS)) for k, v in value.items()]
        elif isinstance(value, list):
            stack += [(v, f"{path}[]", depth) for v in value]


def merged_schema(results: DataFrame, body: str = "body") -> DataFrame:
    """path, kind, item_depth and n: every path of the bodies with the kinds of value found there."""

    def infer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()
        for b in batches:
            for text in b["body"]:
                try:
                    _walk(json.loads(text), "$", 0, counts)
                except (ValueError, RecursionError):
                    continue
            if len(counts) > 100_000:  # partial results; the shuffle combines them
                yield _frame(counts)
                counts = Counter()
        yield _frame(counts)

    def _frame(counts: Counter) -> pd.DataFrame:
        return pd.DataFrame([(*k, n) for k, n in counts.items()], columns=["path", "kind", "item_depth", "n"]).astype({"item_depth": "int32", "n": "int64"})

    rows = results.select(F.col(body).alias("body")).where(F.col("body").isNotNull())
    return rows.mapInPandas(infer, "path string, kind string, item_depth int, n bigint").groupBy("path", "kind", "item_depth").agg(F.sum("n").alias("n"))


def item_depth(results: DataFrame) -> int:
    """How deep items nest, from the merged schema (one number reaches the driver)."""
    return int(merged_schema(results).agg(F.max("item_depth")).first()[0] or 0)


def pages(bodies: DataFrame) -> DataFrame:
    """One row per page: result_id, page_index (position), page (VARIANT)."""
    found = F.coalesce(_as_array(F.col("doc"), "$.pages"), _as_array(F.col("doc"), "$.document.pages"))
    return bodies.select("result_id", F.posexplode(found).alias("at", "page")).select("result_id", (F.col("at") + 1).cast("int").alias("page_index"), "page")


def _text(node: Column, path: str) -> Column:
    return F.try_variant_get(node, path, "string")


def items(bodies: DataFrame, depth: int) -> DataFrame:
    """One row per item of any depth.

    result_id, page_index, item_path, parent_path, ordinal, depth, item_id,
    parent_id, type, reading_order, source, confidence, value, node.
    """
    rows = pages(bodies)

    def child(field: str, path: Column, parent_id: Column, at: int):
        mark = "/" if field == "items" else "/c"
        return lambda v, i: F.struct(
            v.alias("node"), F.concat(path, F.lit(mark), i.cast("string")).alias("item_path"), path.alias("parent_path"),
            i.cast("int").alias("ordinal"), F.lit(at).alias("depth"), parent_id.alias("parent_id"),
        )

    def level(node: Column, path: Column, parent_id: Column, fields: tuple[str, ...], at: int) -> Column:
        none = F.array().cast("array<variant>")
        return F.concat(*[F.transform(F.coalesce(_as_array(node, f"$.{f}"), none), child(f, path, parent_id, at)) for f in fields])

    def deeper(at: int):
        return lambda n: level(n["node"], n["item_path"], F.coalesce(_text(n["node"], "$.id"), F.lit("")), CHILD_FIELDS, at)

    rows = rows.withColumn("__0", level(F.col("page"), F.col("page_index").cast("string"), F.lit(""), ("items",), 0))
    for d in range(1, depth + 1):
        rows = rows.withColumn(f"__{d}", F.flatten(F.transform(F.col(f"__{d - 1}"), deeper(d))))
    every = rows.select("result_id", "page_index", F.explode(F.concat(*[F.col(f"__{d}") for d in range(depth + 1)])).alias("n")).select("result_id", "page_index", "n.*").where(_is_object(F.col("node")))
    node = F.col("node")
    return every.select(
        "result_id", "page_index", "item_path", "parent_path", "ordinal", "depth", _text(node, "$.id").alias("item_id"), "parent_id", _text(node, "$.type").alias("type"),
        F.try_variant_get(node, "$.reading_order", "int").alias("reading_order"), _text(node, "$.source").alias("source"), F.try_variant_get(node, "$.confidence", "double").alias("confidence"),
        _text(node, "$.value").alias("value"), "node",
    )


def boxes(item_rows: DataFrame) -> DataFrame:
    """One row per item box, whatever its shape: result_id, page_index, item_path, x, y, width, height, unit."""
    node = F.col("node")
    listed = F.try_variant_get(node, "$.bbox", "array<double>")

    def number(i: int, *names: str) -> Column:
        return F.coalesce(F.get(listed, F.lit(i)), *[F.try_variant_get(node, f"$.bbox.{n}", "double") for n in names])

    shaped = item_rows.select("result_id", "page_index", "item_path", number(0, "x").alias("x"), number(1, "y").alias("y"), number(2, "width", "w").alias("width"), number(3, "height", "h").alias("height"), _text(node, "$.bbox.unit").alias("unit"))
    return shaped.where("x is not null or y is not null or width is not null or height is not null")


def warnings(bodies: DataFrame, item_rows: DataFrame) -> DataFrame:
    """One row per warning of a result, page or item: result_id, page_index, item_path, ordinal, code, message."""
    none = F.lit(None)

    def listed(node: Column, path: str) -> Column:
        one = F.try_variant_get(node, path, "string")
        return F.coalesce(_as_array(node, path), F.when(one.isNotNull(), F.array(F.try_variant_get(node, path, "variant"))))

    whole = bodies.select("result_id", none.cast("int").alias("page_index"), none.cast("string").alias("item_path"), F.posexplode(listed(F.col("doc"), "$.warnings")).alias("ordinal", "w"))
    paged = pages(bodies).select("result_id", "page_index", none.cast("string").alias("item_path"), F.posexplode(listed(F.col("page"), "$.warnings")).alias("ordinal", "w"))
    inner = item_rows.select("result_id", "page_index", "item_path", F.posexplode(listed(F.col("node"), "$.warnings")).alias("ordinal", "w"))
    rows = whole.unionByName(paged).unionByName(inner)
    w = F.col("w")
    return rows.select("result_id", "page_index", "item_path", "ordinal", _text(w, "$.code").alias("code"), F.coalesce(_text(w, "$.message"), F.when(~_is_object(w), _text(w, "$"))).alias("message"))


def result_rows(bodies: DataFrame) -> DataFrame:
    doc = F.col("doc")
    count = F.coalesce(F.size(F.coalesce(_as_array(doc, "$.pages"), _as_array(doc, "$.document.pages"))), F.lit(0))
    return bodies.select("result_id", "sha256", "received_at", _text(doc, "$.schema_version").alias("schema_version"), _text(doc, "$.document.filename").alias("filename"), _text(doc, "$.document.mime_type").alias("mime_type"), F.try_variant_get(doc, "$.document.page_count", "int").alias("page_count"), F.greatest(count, F.lit(0)).alias("pages"), _text(doc, "$.processing.engine").alias("engine"))


def page_rows(bodies: DataFrame) -> DataFrame:
    p = F.col("page")
    return pages(bodies).select("result_id", "page_index", _text(p, "$.page_number").alias("page_number"), _text(p, "$.page_label").alias("page_label"), F.try_variant_get(p, "$.page_width", "double").alias("page_width"), F.try_variant_get(p, "$.page_height", "double").alias("page_height"), _text(p, "$.unit").alias("unit"), F.try_variant_get(p, "$.success", "boolean").alias("success"))
