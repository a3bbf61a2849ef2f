"""Which of several readings of a text to believe: the reconciliation ladder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OCR_FLOOR = 0.90
MARGIN = 0.10


def eligible(df: DataFrame) -> DataFrame:
    """Adds `reasons` (why not) and `eligible` from the columns source_ok, unicode_ok, overlap, script_ok."""
    reasons = F.array_compact(
        F.array(
            F.when(~F.coalesce("source_ok", F.lit(False)), "source_mismatch"),
            F.when(~F.coalesce("unicode_ok", F.lit(False)), "unicode"),
            F.when(F.coalesce("overlap", F.lit(0.0)) < 0.80 - 1e-12, "overlap"),
            F.when(~F.coalesce("script_ok", F.lit(False)), "script"),
        )
    )
    return df.withColumn("reasons", F.array_sort(reasons)).withColumn("eligible", F.size("reasons") == 0)


def reconcile(candidates: DataFrame, group: list[str]) -> DataFrame:
    """One verdict per group: decision (selected, unchanged, unresolved), reason and text.

    Candidates have text, kind (font, native, ocr), lineage, primary, confidence
    and eligible with its reasons. Aggregates of each group feed one ladder of
    conditions; nothing is decided row by row. Equal scores of different texts
    decide nothing.
    """
    ok = F.col("eligible")
    text = lambda kind: F.collect_set(F.when(ok & (F.col("kind") == kind), F.col("text")))
    by_text = candidates.where("eligible").groupBy(*group, "text").agg(F.count_distinct("lineage").alias("lineages"), F.max(F.when(F.col("kind") == "ocr", F.col("confidence"))).alias("confidence"))
    texts = by_text.groupBy(*group).agg(
        F.sort_array(F.collect_list(F.when(F.col("lineages") >= 2, F.col("text")))).alias("agreed"),
        F.sort_array(F.collect_list(F.when(F.col("confidence").isNotNull(), F.struct("confidence", "text"))), asc=False).alias("ocr"),
    )
    lineages = candidates.where("eligible").groupBy(*group, "lineage").agg(F.count_distinct("text").alias("n")).groupBy(*group).agg((F.max("n") > 1).alias("self_contradiction"))
    g = candidates.groupBy(*group).agg(
        F.bool_or(F.array_contains("reasons", "source_mismatch")).alias("mismatch"), text("font").alias("font"),
        F.collect_set(F.when(ok & (F.col("kind") == "native") & F.col("primary"), F.col("text"))).alias("native"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("reasons")))).alias("why"),
    )
    g = g.join(texts, group, "left").join(lineages, group, "left")
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    first, second = F.get("ocr", F.lit(0)), F.get("ocr", F.lit(1))
    lead = first["confidence"] - F.coalesce(second["confidence"], F.lit(0.0))
    good_ocr = (size("ocr") > 0) & (first["confidence"] >= OCR_FLOOR) & (lead >= MARGIN - 1e-12)
    ladder = [
        (F.col("mismatch"), "unresolved", "source_mismatch", None),
        (size("font") == 1, "selected", "deterministic_font_evidence", F.get("font", F.lit(0))),
        (size("font") > 1, "unresolved", "ambiguous_conflict", None),
        (size("native") == 1, "unchanged", "healthy_native_authoritative", F.get("native", F.lit(0))),
        (F.coalesce("self_contradiction", F.lit(False)), "unresolved", "dependent_source_agreement", None),
        (size("agreed") == 1, "selected", "independent_exact_agreement", F.get("agreed", F.lit(0))),
        (good_ocr, "selected", "independent_high_confidence_ocr", first["text"]),
        (size("ocr") > 0, "unresolved", "low_margin_conflict", None),
    ]
    decision, reason, chosen = F.lit("unresolved"), F.coalesce(F.get("why", F.lit(0)), F.lit("no_candidate")), F.lit(None).cast("string")
    for holds, d, r, t in reversed(ladder):
        decision, reason = F.when(holds, d).otherwise(decision), F.when(holds, r).otherwise(reason)
        chosen = F.when(holds, t if t is not None else F.lit(None).cast("string")).otherwise(chosen)
    return g.select(*group, decision.alias("decision"), reason.alias("reason"), chosen.alias("text"))
