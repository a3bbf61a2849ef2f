"""Words to lines, the merge of two recognition passes, repeated occurrences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelore.operators import geometry as G
from pagelore.operators.aggregates import weighted_confidence
from pagelore.operators.graph import components
from pagelore.operators.joins import interval_join, similar_box_pairs

WORDS = "level int, page_num int, block_num int, par_num int, line_num int, word_num int, left int, top int, width int, height int, conf double, text string"


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """Recognition output in tab-separated form: words only, confidence scaled to 0..1, negative as null."""
    rows = spark.read.csv(path, sep="\t", header=True, schema=WORDS, quote="", mode="PERMISSIVE")
    return usable_words(rows)


def usable_words(rows: DataFrame) -> DataFrame:
    keep = (F.col("level") == 5) & (F.trim("text") != "") & (F.col("width") > 0) & (F.col("height") > 0)
    return rows.where(keep).withColumn("conf", F.when(F.col("conf") >= 0, F.least(F.col("conf"), F.lit(100.0)) / 100))


def build_lines(words: DataFrame, by: Sequence[str]) -> DataFrame:
    """One row per line: text in (left, top) order, box union, length-weighted confidence."""
    ordered = F.array_sort(F.collect_list(F.struct("left", "top", "text")))
    g = words.groupBy(*by).agg(
        F.array_join(F.transform(ordered, lambda w: w["text"]), " ").alias("text"), F.min("left").alias("x"), F.min("top").alias("y"), F.max(F.col("left") + F.col("width")).alias("__r"), F.max(F.col("top") + F.col("height")).alias("__b"),
        weighted_confidence(F.col("conf"), F.col("text")).alias("confidence"), F.count(F.lit(1)).alias("words"),
    )
    return g.withColumns({"width": F.col("__r") - F.col("x"), "height": F.col("__b") - F.col("y")}).drop("__r", "__b").where(F.trim("text") != "")


def retained(confidence: Column, text: Column) -> Column:
    """Low-confidence lines stay only if they hold eight letters or digits."""
    return (F.coalesce(confidence, F.lit(-1.0)) >= 0.45) | (F.length(F.regexp_replace(text, "[^0-9A-Za-z]", "")) >= 8)


def _plain(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^0-9a-z]+", " "))


def same_place(share: Column, a: Column, b: Column) -> Column:
    """Whether two plain texts whose boxes overlap by `share` of the smaller read one line.

    They do if they are equal but for spaces (four characters at least), if the
    words of one are all in the other, or, from an overlap of 0.60 on, if at most
    14 % of the longer one's characters are edited.
    """
    x, y = (F.replace(t, F.lit(" "), F.lit("")) for t in (a, b))
    words = [F.array_distinct(F.split(t, " ")) for t in (a, b)]
    within = F.least(F.size(F.array_except(*words)), F.size(F.array_except(*words[::-1]))) == 0
    return (share >= 0.30) & (((x == y) & (F.length(x) >= 4)) | ((x != "") & (y != "") & within) | ((share >= 0.60) & _alike(a, b)))


def _alike(a: Column, b: Column) -> Column:
    longer = F.greatest(F.length(a), F.length(b))
    return (longer > 0) & (F.levenshtein(a, b) <= 0.14 * longer)


def merge_passes(lines: DataFrame, by: Sequence[str], rank: str, key: str) -> DataFrame:
    """Lines of a dense pass (rank 0) and a sparse pass (rank 1) as one set: key columns and accepted.

    A sparse line belongs to the first dense line (from the top, then the left, then
    by key) that reads the same place; without one it is accepted. Of a dense line
    and the sparse ones that belong to it the reading of the greatest preference is
    accepted: of alike texts whose confidences lie 0.03 apart the surer one, then
    the one whose words hold the other's and more, then confidence, then length,
    then the dense pass. Null confidences count as -1; lines without a box or text
    belong to no line.
    """
    fields = ["text", "x", "y", "width", "height", "confidence"]
    ready = lines.select(*by, rank, key, *fields).withColumns({"plain": _plain(F.col("text")), "sure": F.coalesce("confidence", F.lit(-1.0)), "low": F.col("y") + F.col("height")})
    side = lambda k, p: ready.where(F.col(rank) == k).select(*by, *[F.col(c).alias(f"{p}_{c}") for c in (key, *fields, "plain", "sure", "low")])
    met = interval_join(side(0, "d"), side(1, "s"), by, ("d_y", "d_low"), ("s_y", "s_low"), 100.0)
    box = lambda p: F.struct(*[F.col(f"{p}_{c}").alias(c) for c in ("x", "y", "width", "height")])
    met = met.where(F.coalesce(same_place(G.of_smaller(box("d"), box("s")), F.col("d_plain"), F.col("s_plain")), F.lit(False)))
    held = [c for c in met.columns if c not in (*by, f"s_{key}")]
    first = met.groupBy(*by, f"s_{key}").agg(F.min_by(F.struct(*held), F.struct("d_y", "d_x", f"d_{key}")).alias("m")).select(*by, f"s_{key}", "m.*")
    clear = _alike(F.col("d_plain"), F.col("s_plain")) & (F.abs(F.col("d_sure") - F.col("s_sure")) >= 0.03)

    def preference(own: str, other: str) -> Column:
        mine, theirs = (F.array_distinct(F.split(f"{p}_plain", " ")) for p in (own, other))
        more = (F.size(F.array_except(theirs, mine)) == 0) & (F.size(F.array_except(mine, theirs)) > 0)
        return F.struct(F.when(clear, F.col(f"{own}_sure")).otherwise(0.0).alias("clear"), more.cast("int").alias("more"), F.col(f"{own}_sure").alias("sure"), F.length(f"{own}_text").alias("length"))

    judged = first.select(*by, f"d_{key}", f"s_{key}", preference("s", "d").alias("__p"), (preference("s", "d") > preference("d", "s")).alias("wins"))
    best = judged.where("wins").groupBy(*by, f"d_{key}").agg(F.max_by(f"s_{key}", F.struct("__p", f"s_{key}")).alias("__best"))
    lost = judged.join(best, [*by, f"d_{key}"], "left").where(~F.col(f"s_{key}").eqNullSafe(F.col("__best"))).select(*by, F.col(f"s_{key}").alias(key))
    lost = lost.unionByName(best.select(*by, F.col(f"d_{key}").alias(key))).withColumn("accepted", F.lit(False))
    return lines.select(*by, key).join(lost, [*by, key], "left").withColumn("accepted", F.coalesce("accepted", F.lit(True)))


def occurrences(rows: DataFrame, by: Sequence[str], text: str, box: str, key: str, order: Sequence[Column], threshold: float = 0.80) -> DataFrame:
    """key and duplicate_of: rows of equal text at one place form components; the first by `order` stays (null)."""
    pairs = similar_box_pairs(rows, [*by, text], key, box, threshold)
    groups = components(pairs, f"{key}_a", f"{key}_b").select(F.col("node").alias(key), "component")
    ranked = rows.join(groups, key)
    winner = ranked.groupBy("component").agg(F.min_by(key, F.struct(*order, F.col(key))).alias("winner"))
    named = groups.join(winner, "component").select(key, "winner")
    return rows.select(key).join(named, key, "left").select(key, F.when(F.col("winner") != F.col(key), F.col("winner")).alias("duplicate_of"))


