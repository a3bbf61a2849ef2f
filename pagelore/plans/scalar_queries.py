"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelore.functions import scalars as S
from pagelore.operators.model import distinct_items
from pagelore.session import table


def text_normalise(spark: SparkSession, d: str) -> DataFrame:
    items = distinct_items(table(spark, d, "items"), "value")
    return items.select("item_key", S.collapse(F.col("value")).alias("collapsed"), S.squeeze(F.col("value")).alias("squeezed"))


def marker_parse(spark: SparkSession, d: str) -> DataFrame:
    items = distinct_items(table(spark, d, "items").where("type = 'list'"), "value")
    lines = items.select("item_key", F.posexplode(F.split("value", "\n")).alias("line_no", "line")).withColumn("m", S.marker(F.col("line")))
    return lines.where("m is not null").select("item_key", "line_no", F.col("m.style").alias("style"), F.col("m.ordinal").alias("ordinal"))


def number_parse(spark: SparkSession, d: str) -> DataFrame:
    cells = table(spark, d, "cells").select("item_key", "row_no", "col_no", "text").distinct()
    return cells.withColumn("number", F.round(S.number(F.col("text")), 6)).where("number is not null").drop("text")


def excel_serial_date(spark: SparkSession, d: str) -> DataFrame:
    serial = (F.col("l_orderkey") % 45000 + F.col("l_linenumber") * 0.25 - 0.25).cast("double")
    rows = table(spark, d, "lineitem").select(serial.alias("serial"), (F.col("l_linenumber") > 5).alias("old")).distinct()
    return rows.select("serial", "old", S.excel_date(F.col("serial"), F.col("old")).alias("iso"))


def column_labels(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("n"), S.column_label(F.col("p_partkey")).alias("label")).where("n between 1 and 18278")
    return rows.withColumn("back", S.column_index(F.col("label")).cast("int"))


def part_labels(spark: SparkSession, d: str) -> DataFrame:
    """column_labels over every part: labels of any length, null below 1."""
    rows = table(spark, d, "part").select(F.col("p_partkey").cast("bigint").alias("n"), S.column_label(F.col("p_partkey")).alias("label"))
    return rows.withColumn("back", S.column_index(F.col("label")))


def markdown_escape(spark: SparkSession, d: str) -> DataFrame:
    cells = table(spark, d, "cells").select("item_key", "row_no", "col_no", "text").distinct()
    return cells.select("item_key", "row_no", "col_no", S.escape_markdown(F.col("text")).alias("markdown"), S.escape_html(F.col("text")).alias("html"))


def stable_ids(spark: SparkSession, d: str) -> DataFrame:
    cells = table(spark, d, "cells").select("item_key", "row_no", "col_no", "text").distinct()
    return cells.select("item_key", "row_no", "col_no", S.stable_id(F.col("item_key"), F.col("row_no"), F.col("col_no"), F.col("text")).alias("stable_id"))


def script_detect(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.array_join(S.scripts(F.col("text")), ",").alias("scripts"))
    return docs.groupBy("scripts").agg(F.count(F.lit(1)).alias("documents"))


def unsafe_text(spark: SparkSession, d: str) -> DataFrame:
    items = distinct_items(table(spark, d, "items"), "value", "source")
    return items.where(S.has_unsafe_characters(F.col("value"))).groupBy("source").agg(F.count(F.lit(1)).alias("items"))


def box_to_pixels(spark: SparkSession, d: str) -> DataFrame:
    """Boxes in points mapped to 200-dpi pixels by a composed matrix: scale, then a margin of 10."""
    items = distinct_items(table(spark, d, "items"), "bbox").where("bbox.unit = 'pt'")
    scale = F.array(*[F.lit(v) for v in (200 / 72, 0.0, 0.0, 200 / 72, 0.0, 0.0)])
    shift = F.array(*[F.lit(v) for v in (1.0, 0.0, 0.0, 1.0, 10.0, 10.0)])
    p = S.affine(S.compose(shift, scale), F.col("bbox.x"), F.col("bbox.y"))
    return items.select("item_key", F.round(p["x"], 4).alias("px"), F.round(p["y"], 4).alias("py"))


def split_hex_join(spark: SparkSession, d: str) -> DataFrame:
    """Digests printed in fragments after their label, put together again."""
    parses = table(spark, d, "parses").select("parse_id", F.upper("document.sha256").alias("h")).distinct()
    printed = F.concat(F.lit("SHA-256: "), F.substring("h", 1, 20), F.lit(" "), F.substring("h", 21, 30), F.lit(" "), F.substring("h", 51, 14))
    return parses.select("parse_id", S.join_split_hex(printed).alias("line"))


def safe_urls(spark: SparkSession, d: str) -> DataFrame:
    scheme = F.element_at(F.array(F.lit("https://"), F.lit("javascript:"), F.lit("HTTP://"), F.lit("ftp://")), (F.col("s_suppkey") % 4 + 1).cast("int"))
    url = F.concat(scheme, F.lower(F.regexp_replace("s_name", "[^0-9A-Za-z]+", "-")), F.lit("/notes"))
    return table(spark, d, "supplier").select("s_suppkey", S.safe_url(url).alias("url"))


QUERIES = {f.__name__: f for f in (text_normalise, marker_parse, number_parse, excel_serial_date, column_labels, part_labels, markdown_escape, stable_ids, script_detect, unsafe_text, box_to_pixels, split_hex_join, safe_urls)}

_CELLS = "(SELECT DISTINCT item_key, row_no, col_no, text FROM cells) c"

ORACLE = {
    "text_normalise": """
        SELECT DISTINCT item_key, trim(regexp_replace(value, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS collapsed, trim(regexp_replace(lower(value), '[^0-9a-z]+', ' ', 'g')) AS squeezed FROM items
    """,
    "marker_parse": r"""
        WITH v AS (SELECT DISTINCT item_key, value FROM items WHERE type = 'list' AND value IS NOT NULL),
        n AS (SELECT item_key, string_split(value, chr(10)) AS ls FROM v),
        l AS (SELECT item_key, unnest(range(len(ls)))::INTEGER AS line_no, unnest(ls) AS line FROM n)
        SELECT item_key, line_no,
            CASE WHEN regexp_matches(line, '^\s*[•*–·-]\s') THEN 'bullet' WHEN regexp_matches(line, '^\s*\(?\d{1,3}[.)]\s') THEN 'decimal' ELSE 'alpha' END AS style,
            CASE WHEN regexp_matches(line, '^\s*[•*–·-]\s') THEN NULL WHEN regexp_matches(line, '^\s*\(?\d{1,3}[.)]\s') THEN regexp_extract(line, '^\s*\(?(\d{1,3})[.)]\s', 1)::INTEGER
                ELSE ascii(lower(regexp_extract(line, '^\s*\(?([a-zA-Z])[.)]\s', 1))) - 96 END AS ordinal
        FROM l WHERE regexp_matches(line, '^\s*[•*–·-]\s') OR regexp_matches(line, '^\s*\(?\d{1,3}[.)]\s') OR regexp_matches(line, '^\s*\(?[a-zA-Z][.)]\s')
    """,
    "number_parse": rf"""
        SELECT item_key, row_no, col_no, round(CASE WHEN body LIKE '(%)' THEN -try_cast(body[2:-2] AS DOUBLE) ELSE try_cast(body AS DOUBLE) END, 6) AS number
        FROM (SELECT item_key, row_no, col_no, regexp_replace(trim(text), '(?i)^(?:us)?[$€£¥]|^chf\s*|,|\s*(?:%|per cent)$', '', 'g') AS body FROM {_CELLS}) b
        WHERE try_cast(replace(replace(body, '(', ''), ')', '') AS DOUBLE) IS NOT NULL
    """,
    "excel_serial_date": """
        WITH s AS (SELECT DISTINCT CAST(l_orderkey % 45000 + l_linenumber * 0.25 - 0.25 AS DOUBLE) AS serial, l_linenumber > 5 AS old FROM lineitem),
        p AS (SELECT serial, old, CAST(floor(serial) AS INTEGER) AS days, CAST(round((serial - floor(serial)) * 86400) AS BIGINT) AS secs FROM s)
        SELECT serial, old,
            CASE WHEN NOT old AND days = 60 THEN '1900-02-29'
                ELSE strftime(CASE WHEN old THEN DATE '1904-01-01' + days WHEN days > 60 THEN DATE '1899-12-31' + (days - 1) ELSE DATE '1899-12-31' + days END, '%Y-%m-%d') END
            || CASE WHEN secs = 0 THEN '' ELSE 'T' || lpad((secs // 3600)::VARCHAR, 2, '0') || ':' || lpad((secs // 60 % 60)::VARCHAR, 2, '0') || ':' || lpad((secs % 60)::VARCHAR, 2, '0') END AS iso
        FROM p
    """,
    "column_labels": """
        SELECT p_partkey AS n,
            CASE WHEN p_partkey <= 26 THEN chr((64 + p_partkey)::INTEGER)
                WHEN p_partkey <= 702 THEN chr((65 + (p_partkey - 27) // 26)::INTEGER) || chr((65 + (p_partkey - 1) % 26)::INTEGER)
                ELSE chr((65 + (p_partkey - 703) // 676)::INTEGER) || chr((65 + (p_partkey - 27) // 26 % 26)::INTEGER) || chr((65 + (p_partkey - 1) % 26)::INTEGER) END AS label,
            CAST(p_partkey AS INTEGER) AS back
        FROM part WHERE p_partkey BETWEEN 1 AND 18278
    """,
    "part_labels": """
        WITH RECURSIVE l AS (SELECT p_partkey AS n, p_partkey AS k, '' AS label FROM part
            UNION ALL SELECT n, (k - 1) // 26, chr((65 + (k - 1) % 26)::INTEGER) || label FROM l WHERE k > 0)
        SELECT n, CASE WHEN n > 0 THEN label END AS label, CASE WHEN n > 0 THEN n END AS back FROM l WHERE k <= 0
    """,
    "markdown_escape": rf"""
        SELECT item_key, row_no, col_no, regexp_replace(text, '([\\`*_\[\]<>|])', '\\\1', 'g') AS markdown,
            replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS html
        FROM {_CELLS}
    """,
    "stable_ids": f"""
        SELECT item_key, row_no, col_no, sha256(concat_ws(chr(31), item_key::VARCHAR, row_no::VARCHAR, col_no::VARCHAR, coalesce(text, chr(0))))[1:24] AS stable_id FROM {_CELLS}
    """,
    "script_detect": r"""
        SELECT concat_ws(',', CASE WHEN regexp_matches(text, '\p{Arabic}') THEN 'arabic' END, CASE WHEN regexp_matches(text, '\p{Cyrillic}') THEN 'cyrillic' END, CASE WHEN regexp_matches(text, '\p{Greek}') THEN 'greek' END,
            CASE WHEN regexp_matches(text, '\p{Han}') THEN 'han' END, CASE WHEN regexp_matches(text, '\p{Hiragana}') THEN 'hiragana' END, CASE WHEN regexp_matches(text, '\p{Katakana}') THEN 'katakana' END, CASE WHEN regexp_matches(text, '\p{Latin}') THEN 'latin' END) AS scripts,
            count(*) AS documents
        FROM documents GROUP BY 1
    """,
    "box_to_pixels": """
        SELECT DISTINCT item_key, round(bbox.x * (200.0 / 72) + 10, 4) AS px, round(bbox.y * (200.0 / 72) + 10, 4) AS py FROM items WHERE bbox.unit = 'pt'
    """,
    "split_hex_join": "SELECT DISTINCT parse_id, CASE WHEN regexp_matches(upper(document.sha256), '[A-F]') THEN 'SHA-256: ' || upper(document.sha256) END AS line FROM parses",
    "safe_urls": """
        SELECT s_suppkey, CASE WHEN s_suppkey % 4 IN (0, 2) THEN CASE s_suppkey % 4 WHEN 0 THEN 'https://' ELSE 'HTTP://' END || lower(regexp_replace(s_name, '[^0-9A-Za-z]+', '-', 'g')) || '/notes' END AS url FROM supplier
    """,
}
