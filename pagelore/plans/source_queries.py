"""Declared types, words and recognition passes from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelore.operators import ocr as O
from pagelore.operators.model import current_parses, distinct_items
from pagelore.session import table
from pagelore.sources import intake as I

PAGE = ["parse_id", "page_index"]


def declared_types(spark: SparkSession, d: str) -> DataFrame:
    files = current_parses(table(spark, d, "parses")).select("parse_id", F.col("document.filename").alias("filename"), F.col("document.mime_type").alias("mime_type"))
    return I.declared_kind(files, "filename", "mime_type").select("parse_id", "kind", "declared")


def _words(spark: SparkSession, d: str) -> DataFrame:
    """Words of recognised items with places by line and position: twelve units a line, six a character slot."""
    rows = distinct_items(table(spark, d, "items").where("source = 'ocr' and type = 'text'"), *PAGE, "value", "confidence").where("value <> ''")
    lines = rows.select("item_key", *PAGE, "confidence", F.posexplode(F.split("value", "\n")).alias("line_num", "line"))
    words = lines.select("item_key", *PAGE, "line_num", F.posexplode(F.split("line", " ")).alias("word_num", "text"), F.col("confidence").alias("conf"))
    return words.select("item_key", *PAGE, "line_num", F.lit(5).alias("level"), (F.col("word_num") * 60).alias("left"), (F.col("line_num") * 12).alias("top"), (F.length("text") * 6).alias("width"), F.lit(10).alias("height"), (F.col("conf") * 100).alias("conf"), "text")


def ocr_line_build(spark: SparkSession, d: str) -> DataFrame:
    lines = O.build_lines(O.usable_words(_words(spark, d)), ["item_key", "line_num"])
    return lines.select("item_key", "line_num", "text", "x", "y", "width", "height", "words", O.retained(F.col("confidence"), F.col("text")).alias("retained"))


def ocr_occurrences(spark: SparkSession, d: str) -> DataFrame:
    """Items of equal text at one place of a page: which stays, best confidence first."""
    rows = distinct_items(table(spark, d, "items"), *PAGE, "type", "value", "confidence", "bbox").withColumn("text", F.col("type"))
    return O.occurrences(rows, PAGE, "text", "bbox", "item_key", [-F.coalesce("confidence", F.lit(-1.0))], 0.5)


def ocr_pass_merge(spark: SparkSession, d: str) -> DataFrame:
    """Recognised items as the dense pass, mixed ones as the sparse pass, merged by page."""
    rows = distinct_items(table(spark, d, "items").where("source in ('ocr', 'mixed')"), *PAGE, "value", "confidence", "source", "bbox").where("value <> '' and bbox.width > 0")
    lines = rows.select(*PAGE, "item_key", F.when(F.col("source") == "ocr", 0).otherwise(1).alias("pass"), F.col("value").alias("text"), "bbox.x", "bbox.y", "bbox.width", "bbox.height", "confidence")
    return O.merge_passes(lines, PAGE, "pass", "item_key").select("item_key", "accepted")


QUERIES = {f.__name__: f for f in (declared_types, ocr_line_build, ocr_occurrences, ocr_pass_merge)}

_VALUES = ", ".join(f"('{e}', '{m}', '{k}')" for e, m, k, _ in I.MEDIA_TYPES)

ORACLE = {
    "declared_types": f"""
        WITH p AS (SELECT parse_id, document.filename AS f, document.mime_type AS m FROM parses QUALIFY row_number() OVER (PARTITION BY parse_id ORDER BY loaded_at DESC) = 1), k (ext, media, kind) AS (VALUES {_VALUES})
        SELECT parse_id, kind, CASE WHEN kind IS NULL THEN 'unknown_extension' WHEN m IS NULL OR lower(trim(split_part(m, ';', 1))) IN ('', 'application/octet-stream') OR lower(trim(split_part(m, ';', 1))) = media THEN 'accepted' ELSE 'type_mismatch' END AS declared
        FROM p LEFT JOIN k ON k.ext = lower(regexp_extract(f, '\\.([0-9A-Za-z]+)$', 1))
    """,
    "ocr_line_build": """
        WITH v AS (SELECT DISTINCT item_key, value, confidence FROM items WHERE source = 'ocr' AND type = 'text' AND value <> ''), l AS (SELECT item_key, confidence, unnest(string_split(value, chr(10))) AS line, unnest(range(len(string_split(value, chr(10))))) AS ln FROM v),
        w AS (SELECT item_key, confidence AS c, ln, unnest(string_split(line, ' ')) AS t, unnest(range(len(string_split(line, ' ')))) AS wn FROM l), k AS (SELECT * FROM w WHERE trim(t) <> ''),
        g AS (SELECT item_key, CAST(ln AS INTEGER) AS line_num, string_agg(t, ' ' ORDER BY wn) AS text, CAST(min(wn) * 60 AS INTEGER) AS x, CAST(ln * 12 AS INTEGER) AS y, CAST(max(wn * 60 + length(t) * 6) - min(wn) * 60 AS INTEGER) AS width, 10 AS height, count(*) AS words, max(c) AS c FROM k GROUP BY ALL)
        SELECT item_key, line_num, text, x, y, width, height, words, coalesce(c, -1) >= 0.45 OR length(regexp_replace(text, '[^0-9A-Za-z]', '', 'g')) >= 8 AS retained FROM g
    """,
    "ocr_pass_merge": r"""
        WITH i AS (SELECT item_key, any_value(parse_id) AS p, any_value(page_index) AS g, any_value(value) AS t, coalesce(any_value(confidence), -1) AS c, any_value(source) AS src, any_value(bbox) AS b FROM items WHERE source IN ('ocr', 'mixed') GROUP BY 1),
        l AS (SELECT item_key AS k, p, g, src, t, c, b.x AS x, b.y AS y, b.width AS w, b.height AS h, trim(regexp_replace(lower(t), '[^0-9a-z]+', ' ', 'g')) AS a FROM i WHERE t <> '' AND b.width > 0),
        q AS (SELECT *, list_distinct(string_split(a, ' ')) AS ws, replace(a, ' ', '') AS z FROM l),
        m AS (SELECT d.k AS dk, s.k AS sk, d.y AS dy, d.x AS dx, d.c AS dc, s.c AS sc, length(d.t) AS dl, length(s.t) AS sl, d.a AS da, s.a AS sa, d.ws AS dw, s.ws AS sw, d.z AS dz, s.z AS sz,
                greatest(0, least(d.x + d.w, s.x + s.w) - greatest(d.x, s.x)) * greatest(0, least(d.y + d.h, s.y + s.h) - greatest(d.y, s.y)) / least(d.w * d.h, s.w * s.h) AS share
            FROM q d JOIN q s ON d.p = s.p AND d.g = s.g AND d.src = 'ocr' AND s.src = 'mixed' AND d.h > 0 AND s.h > 0),
        f AS (SELECT *, greatest(length(da), length(sa)) > 0 AND levenshtein(da, sa) <= 0.14 * greatest(length(da), length(sa)) AS alike FROM m WHERE share >= 0.3),
        one AS (SELECT * FROM f WHERE (dz = sz AND length(dz) >= 4) OR (dz <> '' AND sz <> '' AND (list_has_all(dw, sw) OR list_has_all(sw, dw))) OR (share >= 0.6 AND alike) QUALIFY row_number() OVER (PARTITION BY sk ORDER BY dy, dx, dk) = 1),
        j AS (SELECT *, alike AND abs(dc - sc) >= 0.03 AS clear, list_has_all(sw, dw) AND NOT list_has_all(dw, sw) AS smore, list_has_all(dw, sw) AND NOT list_has_all(sw, dw) AS dmore FROM one),
        r AS (SELECT *, {'a': CASE WHEN clear THEN sc ELSE 0 END, 'b': smore::INT, 'c': sc, 'd': sl} AS sp, {'a': CASE WHEN clear THEN dc ELSE 0 END, 'b': dmore::INT, 'c': dc, 'd': dl} AS dp FROM j),
        best AS (SELECT dk, sk FROM r WHERE sp > dp QUALIFY row_number() OVER (PARTITION BY dk ORDER BY sp DESC, sk DESC) = 1),
        lost AS (SELECT dk AS k FROM best UNION SELECT r.sk FROM r LEFT JOIN best USING (dk) WHERE r.sk IS DISTINCT FROM best.sk)
        SELECT k AS item_key, k NOT IN (SELECT k FROM lost) AS accepted FROM l
    """,
    "ocr_occurrences": """
        WITH RECURSIVE b AS (SELECT DISTINCT item_key, parse_id, page_index, type, confidence, bbox.x AS x, bbox.y AS y, bbox.width AS w, bbox.height AS h FROM items),
        p AS (SELECT a.item_key AS u, b.item_key AS v FROM b a JOIN b ON a.parse_id = b.parse_id AND a.page_index = b.page_index AND a.type = b.type AND a.item_key <> b.item_key AND a.w > 0 AND a.h > 0 AND b.w > 0 AND b.h > 0
            WHERE greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) / greatest(a.w * a.h, b.w * b.h) >= 0.5),
        r AS (SELECT u AS node, u AS other FROM p UNION SELECT r.node, p.v FROM r JOIN p ON p.u = r.other),
        m AS (SELECT node, arg_min(other, (-coalesce(confidence, -1), other)) AS winner FROM r JOIN b ON b.item_key = r.other GROUP BY 1)
        SELECT DISTINCT b.item_key, CASE WHEN winner <> b.item_key THEN winner END AS duplicate_of FROM b LEFT JOIN m ON m.node = b.item_key
    """,
}
