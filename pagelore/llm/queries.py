"""Queries of the text problems, each over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelore.llm import corpus_tokens, encoding_repair, lookalike, packing, scan_repair, splitting, toxicity
from pagelore.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return scan_repair.ScanNoise(table(spark, d, "items"), table(spark, d, "pages")).defects()


def p1_repaired(spark: SparkSession, d: str) -> DataFrame:
    return scan_repair.ScanNoise(table(spark, d, "items"), table(spark, d, "pages")).repaired()


def p1_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return scan_repair.paragraphs(p1_repaired(spark, d))


def p1_corrections(spark: SparkSession, d: str) -> DataFrame:
    return scan_repair.ScanNoise(table(spark, d, "items"), table(spark, d, "pages")).fixes


def _garbled(spark: SparkSession, d: str) -> DataFrame:
    models, alphabet = encoding_repair.train_models(table(spark, d, "documents"))
    items = table(spark, d, "items").select("item_key", "source", "value")
    return encoding_repair.garbled_rows(items, models, alphabet)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _garbled(spark, d).select("item_key").distinct()


def p2_restored(spark: SparkSession, d: str) -> DataFrame:
    return _garbled(spark, d).select("item_key", "source", "chain", "restorable", "restored").distinct()


def p2_by_source(spark: SparkSession, d: str) -> DataFrame:
    rows = _garbled(spark, d).select("item_key", "source", "restorable").distinct()
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("garbled"), F.count_if("restorable").alias("restorable"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.equal_looking_pairs(table(spark, d, "items").select("item_key", "parse_id", "value"))


def p3_classes(spark: SparkSession, d: str) -> DataFrame:
    """The classes behind p3_found, without pairs: each item with the number of spellings and items of its class."""
    rows = lookalike.spelling_classes(table(spark, d, "items").select("item_key", "parse_id", "value"))
    sizes = rows.groupBy("parse_id", "form").agg(F.count_distinct("exact").alias("spellings"), F.count_distinct("item_key").alias("items"))
    return rows.join(sizes, ["parse_id", "form"]).select("parse_id", F.lower(F.hex("form")).alias("form"), "item_key", "spellings", "items")


def p3_unified(spark: SparkSession, d: str) -> DataFrame:
    once = table(spark, d, "items").groupBy("item_key").agg(F.max("value").alias("value"))
    return lookalike.unify(once).select("item_key", "unified")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    pieces = splitting.split_oversized(table(spark, d, "items"), table(spark, d, "collections"))
    return pieces.where("piece_no = 1").select("item_key")


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.ordered_pieces(table(spark, d, "items"), table(spark, d, "pages"), table(spark, d, "collections"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return corpus_tokens.encode_corpus(table(spark, d, "documents").select("doc_id", "text"))


def _placed(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents").select("doc_id", "text")
    # the kinds of containers are a fixed table of three rows
    packs = [(r["pack_id"], r["capacity_tokens"]) for r in table(spark, d, "pack_sizes").collect()]
    return packing.pack_texts(packing.token_counts(documents), packs, documents.count())


def p7_placed(spark: SparkSession, d: str) -> DataFrame:
    return _placed(spark, d)


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_rates(_placed(spark, d))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.score_corpus(table(spark, d, "documents").select("doc_id", "source", "text"), table(spark, d, "labels"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).where("offensive").select("doc_id")


def p8_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d)


def p8_rates(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.rates_by_source(_scored(spark, d))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (p1_found, p1_repaired, p1_paragraphs, p1_corrections, p2_found, p2_restored, p2_by_source, p3_found, p3_classes, p3_unified, p4_found, p4_pieces, p6_ids, p7_placed, p7_fill, p8_found, p8_scores, p8_rates)
    return {f.__name__: f for f in found}


#: Queries that SQL can express over whole tables; the others are tested against
#: brute force, exact round trips or held-out labels in tests/llm.
ORACLE = {
    "p4_found": """
        SELECT DISTINCT i.item_key
        FROM items i JOIN collections c ON c.collection_id = i.collection_id
        WHERE c.max_chars > 0 AND length(i.value) > c.max_chars
    """,
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
