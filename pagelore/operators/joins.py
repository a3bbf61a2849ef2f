"""Range, containment, nearest and as-of joins that stay equi joins at scale.

Spark runs an inequality join as a nested loop unless an equality narrows it.
Every join here gets one: a group key (page, parse, axis), and where a group can
be large also a bin of the coordinate, so no task sees a whole hot group. Pairs
that meet in several bins are kept only in the first bin they share, which needs
no distinct afterwards.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _bins(lo: Column, hi: Column, width: float) -> Column:
    first, last = F.floor(lo / width).cast("bigint"), F.floor(hi / width).cast("bigint")
    return F.when(lo.isNotNull() & hi.isNotNull() & (hi >= lo), F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))


def interval_join(left: DataFrame, right: DataFrame, on: Sequence[str], left_span: tuple[str, str], right_span: tuple[str, str], width: float, closed: bool = True) -> DataFrame:
    """Pairs of rows of equal keys whose intervals overlap.

    Columns of both sides must not clash, apart from the keys. Closed intervals
    touch at their ends; half-open ones do not. Null ends match nothing.
    """
    (ls, le), (rs, re) = left_span, right_span
    a = left.withColumn("__bin", F.explode(_bins(F.col(ls), F.col(le), width)))
    b = right.withColumn("__bin", F.explode(_bins(F.col(rs), F.col(re), width)))
    pairs = a.join(b, [*on, "__bin"])
    meet = (F.col(ls) <= F.col(re)) & (F.col(rs) <= F.col(le)) if closed else (F.col(ls) < F.col(re)) & (F.col(rs) < F.col(le))
    first_shared = F.floor(F.greatest(F.col(ls), F.col(rs)) / width).cast("bigint")
    return pairs.where(meet & (F.col("__bin") == first_shared)).drop("__bin")


def overlap_counts(rows: DataFrame, on: Sequence[str], span: tuple[str, str], width: float) -> DataFrame:
    """The number of pairs of rows of equal keys whose half-open intervals overlap, as `pairs`; keys without one are left out.

    No pair is formed: all pairs, less those where one interval ends at or before
    the other's start. Those come from running counts of ends over the distinct
    values of a key, first within bins of `width`, then over the bins, so no task
    sees a whole hot key. Null keys or ends match nothing; an end before its start
    is an error.
    """
    lo, hi = F.col(span[0]).cast("double"), F.col(span[1]).cast("double")
    wrong = F.raise_error(F.lit("an interval ends before it starts"))
    known = rows.dropna(subset=[*on, *span]).select(*on, lo.alias("__lo"), F.when(hi < lo, wrong.cast("double")).otherwise(hi).alias("__hi"))
    one, none, empty = F.lit(1).cast("bigint"), F.lit(0).cast("bigint"), (F.col("__lo") == F.col("__hi")).cast("bigint")
    ends = F.array(F.struct(F.col("__lo").alias("at"), one.alias("starts"), none.alias("ends"), empty.alias("points")), F.struct(F.col("__hi").alias("at"), none.alias("starts"), one.alias("ends"), none.alias("points")))
    at = known.select(*on, F.explode(ends).alias("__e")).select(*on, "__e.*").groupBy(*on, "at").agg(*[F.sum(c).alias(c) for c in ("starts", "ends", "points")])
    at = at.withColumn("__bin", F.floor(F.col("at") / width).cast("bigint"))
    inner = Window.partitionBy(*on, "__bin").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    # of empty intervals at one place each comes before itself, and each two come before each other
    counted = at.withColumn("__seen", F.sum("ends").over(inner)).groupBy(*on, "__bin").agg(
        F.sum("starts").alias("n"), F.sum("ends").alias("ends"), F.sum(F.col("starts") * F.col("__seen") - F.expr("points * (points + 1) div 2")).alias("apart"),
    )
    outer = Window.partitionBy(*on).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    whole = counted.withColumn("__before", F.coalesce(F.sum("ends").over(outer), none)).groupBy(*on).agg(F.sum("n").alias("n"), F.sum(F.col("apart") + F.col("n") * F.col("__before")).alias("apart"))
    return whole.select(*on, (F.expr("n * (n - 1) div 2") - F.col("apart")).alias("pairs")).where("pairs > 0")


def stabbing_join(points: DataFrame, spans: DataFrame, on: Sequence[str], at: str, span: tuple[str, str], width: float) -> DataFrame:
    """Points with the intervals that contain them (ends included)."""
    a = points.withColumn("__bin", F.floor(F.col(at) / width).cast("bigint"))
    b = spans.withColumn("__bin", F.explode(_bins(F.col(span[0]), F.col(span[1]), width)))
    return a.join(b, [*on, "__bin"]).where(F.col(at).between(F.col(span[0]), F.col(span[1]))).drop("__bin")


def centre_in_box_join(inner: DataFrame, outer: DataFrame, on: Sequence[str], inner_box: str, outer_box: str, cell: float = 200.0) -> DataFrame:
    """Rows of `inner` with the boxes of `outer` that hold their centre point; a grid of cells is the equality."""
    cx, cy = F.col(f"{inner_box}.x") + F.col(f"{inner_box}.width") / 2, F.col(f"{inner_box}.y") + F.col(f"{inner_box}.height") / 2
    a = inner.withColumns({"__cx": cx, "__cy": cy}).withColumns({"__gx": F.floor(cx / cell).cast("bigint"), "__gy": F.floor(cy / cell).cast("bigint")})
    x, y = F.col(f"{outer_box}.x"), F.col(f"{outer_box}.y")
    xe, ye = x + F.col(f"{outer_box}.width"), y + F.col(f"{outer_box}.height")
    b = outer.withColumn("__gx", F.explode(_bins(x, xe, cell))).withColumn("__gy", F.explode(_bins(y, ye, cell)))
    inside = F.col("__cx").between(x, xe) & F.col("__cy").between(y, ye)
    return a.join(b, [*on, "__gx", "__gy"]).where(inside).drop("__cx", "__cy", "__gx", "__gy")


def similar_box_pairs(rows: DataFrame, on: Sequence[str], key: str, box: str, threshold: float = 0.80, overlap=None) -> DataFrame:
    """Pairs (key_a < key_b) of equal keys whose boxes overlap by `threshold` of the larger one.

    Boxes that overlap that much have nearly equal size and place: sizes fall in
    neighbouring powers of two and centres in neighbouring cells of that size, so
    each box is looked up in at most 3 x 3 x 3 x 3 buckets by equality. That holds for
    a share of at least half of the larger box, or a measure that is never above it
    (intersection over union); other thresholds and measures are refused.
    """
    from pagelore.operators import geometry as G

    if threshold < 0.5 or overlap not in (None, G.reciprocal, G.iou):
        raise ValueError("similar boxes need a reciprocal overlap or IoU of at least 0.5; use interval_join for other measures")

    overlap = overlap or G.reciprocal
    b = F.col(box)
    level = lambda v: F.floor(F.log2(v)).cast("int")
    valid = rows.where(G.is_valid(b)).withColumns({"__w": level(b["width"]), "__h": level(b["height"])})
    cx, cy = b["x"] + b["width"] / 2, b["y"] + b["height"] / 2
    near = F.array(F.lit(-1), F.lit(0), F.lit(1))
    placed = valid.withColumns({"__gx": F.floor(cx / F.pow(F.lit(2.0), F.col("__w"))).cast("bigint"), "__gy": F.floor(cy / F.pow(F.lit(2.0), F.col("__h"))).cast("bigint")})
    asked = valid.withColumn("__w", F.explode(F.transform(near, lambda d: F.col("__w") + d))).withColumn("__h", F.explode(F.transform(near, lambda d: F.col("__h") + d)))
    asked = asked.withColumns({"__gx": F.explode(F.transform(near, lambda d: F.floor(cx / F.pow(F.lit(2.0), F.col("__w"))).cast("bigint") + d))})
    asked = asked.withColumns({"__gy": F.explode(F.transform(near, lambda d: F.floor(cy / F.pow(F.lit(2.0), F.col("__h"))).cast("bigint") + d))})
    bucket = [*on, "__w", "__h", "__gx", "__gy"]
    a = asked.select(*bucket, F.col(key).alias(f"{key}_a"), b.alias("__a"))
    z = placed.select(*bucket, F.col(key).alias(f"{key}_b"), b.alias("__b"))
    pairs = a.join(z, bucket).where(F.col(f"{key}_a") < F.col(f"{key}_b"))
    scored = pairs.withColumn("overlap", overlap(F.col("__a"), F.col("__b"))).where(F.col("overlap") >= threshold)
    return scored.select(*on, f"{key}_a", f"{key}_b", "overlap")


def duplicate_boxes(rows: DataFrame, on: Sequence[str], key: str, box: str, of_smaller: float = 0.82, iou: float = 0.55, band: float = 200.0) -> DataFrame:
    """Pairs (key_a < key_b) of equal keys of which one repeats the other: an overlap of
    `of_smaller` of the smaller box, or an intersection over union of `iou`.

    A small box inside a large one counts, so sizes tell nothing: y bands meet in
    bins and the exact tests follow. Rows without a valid box repeat nothing.
    """
    from pagelore.operators import geometry as G

    valid = rows.where(G.is_valid(F.col(box)))
    side = lambda p: valid.select(*on, F.col(key).alias(f"{key}_{p}"), F.col(box).alias(f"__{p}"), F.col(f"{box}.y").alias(f"__{p}y"), G.bottom(F.col(box)).alias(f"__{p}e"))
    pairs = interval_join(side("a"), side("b"), on, ("__ay", "__ae"), ("__by", "__be"), band).where(F.col(f"{key}_a") < F.col(f"{key}_b"))
    a, b = F.col("__a"), F.col("__b")
    return pairs.where((G.of_smaller(a, b) >= of_smaller) | (G.iou(a, b) >= iou)).select(*on, f"{key}_a", f"{key}_b")


def nearest_join(points: DataFrame, marks: DataFrame, on: Sequence[str], at: str, mark: str, mark_id: str, key: str, tolerance: float) -> DataFrame:
    """Each point with its nearest mark within a tolerance, if exactly one is nearest.

    A tie is no answer: the point is left out. Points and marks meet in bins as
    wide as the tolerance.
    """
    a = points.withColumn("__bin", F.explode(_bins(F.col(at) - tolerance, F.col(at) + tolerance, tolerance)))
    b = marks.withColumn("__bin", F.floor(F.col(mark) / tolerance).cast("bigint"))
    gap = F.abs(F.col(at) - F.col(mark))
    met = a.join(b, [*on, "__bin"]).withColumn("__gap", gap).where(F.col("__gap") <= tolerance)
    best = met.groupBy(*on, key).agg(F.min(F.struct("__gap", mark_id, mark)).alias("__best"), F.min("__gap").alias("__least"), F.sort_array(F.collect_set(F.struct("__gap", mark_id))).alias("__all"))
    unique = F.size(F.filter("__all", lambda m: m["__gap"] == F.col("__least"))) == 1
    return best.where(unique).select(*on, key, F.col(f"__best.{mark_id}").alias(mark_id), F.col(f"__best.{mark}").alias(mark), F.col("__least").alias("gap"))


def as_of_join(left: DataFrame, right: DataFrame, on: Sequence[str], left_at: str, right_at: str, keep: Sequence[str]) -> DataFrame:
    """Each left row with the `keep` columns of the last right row at or before it (nulls if none).

    One sort per key over the union of both sides: no inequality join. Of right
    rows at one instant the greatest by the `keep` columns counts.
    """
    held = F.struct(*[F.col(c) for c in keep])
    r = right.groupBy(*on, F.col(right_at).alias("__at")).agg(F.max(held).alias("__held"))
    payload = [c for c in left.columns if c not in on]
    a = left.select(*on, F.col(left_at).alias("__at"), F.lit(1).alias("__side"), F.struct(*payload).alias("__left"))
    both = a.unionByName(r.withColumn("__side", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy(*on).orderBy("__at", "__side").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("__held", F.last("__held", ignorenulls=True).over(w)).where("__side = 1")
    return seen.select(*on, *[F.col(f"__left.{c}").alias(c) for c in payload], *[F.col(f"__held.{c}").alias(f"prior_{c}") for c in keep])


def multiset_difference(expected: DataFrame, actual: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys whose number of occurrences differs: expected, actual. Nulls equal nulls."""
    a, b = expected.groupBy(*keys).agg(F.count(F.lit(1)).alias("expected")), actual.groupBy(*keys).agg(F.count(F.lit(1)).alias("actual"))
    both = a.select(*keys, "expected", F.lit(0).cast("bigint").alias("actual")).unionByName(b.select(*keys, F.lit(0).cast("bigint").alias("expected"), "actual"))
    return both.groupBy(*keys).agg(F.sum("expected").alias("expected"), F.sum("actual").alias("actual")).where("expected <> actual")
