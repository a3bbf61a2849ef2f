"""Evidence about text: rule lines, glyph health, grounding, precedence, atomic merges, forms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagelore.operators.joins import stabbing_join
from pagelore.session import cut_lineage

#: Bands of a run's height, from its top, in which a rule strikes out or underlines.
STRIKE, UNDERLINE = (0.35, 0.70), (0.75, 1.10)


def rule_bands(runs: DataFrame, rules: DataFrame, on: Sequence[str], cell: float = 200.0) -> DataFrame:
    """Runs with the rules that strike them out or underline them.

    Runs have run_key, x, y, width and height; rules have rule_key, x1, x2 and at.
    A rule counts if it covers half of the run's width.
    """
    tall = runs.withColumns({"__top": F.col("y") + STRIKE[0] * F.col("height"), "__end": F.col("y") + UNDERLINE[1] * F.col("height")})
    met = stabbing_join(rules, tall, on, "at", ("__top", "__end"), cell)
    place = (F.col("at") - F.col("y")) / F.col("height")
    cover = F.least(F.col("x2"), F.col("x") + F.col("width")) - F.greatest(F.col("x1"), F.col("x"))
    role = F.when(place.between(*STRIKE), "strikethrough").when(place.between(*UNDERLINE), "underline")
    return met.where((F.col("width") > 0) & (F.col("height") > 0) & (cover >= 0.5 * F.col("width"))).select(*on, "run_key", "rule_key", role.alias("role")).where("role is not null")


def glyph_health(df: DataFrame, by: Sequence[str], text: str) -> DataFrame:
    """How text decoded: counts of suspicious characters per group and the class they lead to.

    Replacement or control characters from max(2, 10 %) on, or private-use ones
    from max(3, 25 %) on, are suspicious; no characters at all is unused.
    """
    t = F.coalesce(text, F.lit(""))
    count = lambda pattern: F.sum(F.length(t) - F.length(F.regexp_replace(t, pattern, "")))
    g = df.groupBy(*by).agg(F.sum(F.length(t)).alias("chars"), count(r"[�\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\u009F]").alias("broken"), count(r"[\uE000-\uF8FF]").alias("private_use"))
    suspicious = (F.col("broken") >= F.greatest(F.lit(2), F.ceil(F.col("chars") * 0.10))) | (F.col("private_use") >= F.greatest(F.lit(3), F.ceil(F.col("chars") * 0.25)))
    return g.withColumn("health", F.when(F.col("chars") == 0, "unused").when(suspicious, "suspicious").otherwise("healthy"))


def grounding(claims: DataFrame, regions: DataFrame) -> DataFrame:
    """The first reason against each claim's evidence, or grounded.

    Claims have claim, region, page and cited; regions have region, page and text. A
    claim must name a region that exists, on its page, whose text holds what it cites.
    """
    r = regions.select(F.col("region"), F.col("page").alias("__page"), F.col("text").alias("__text"))
    j = claims.join(r, "region", "left")
    reason = (
        F.when(F.col("__page").isNull(), "unknown_region")
        .when(F.col("__page") != F.col("page"), "cross_page_reference")
        .when(F.coalesce(F.trim("cited"), F.lit("")) == "", "nothing_cited")
        .when(~F.coalesce(F.contains(F.lower("__text"), F.lower(F.trim("cited"))), F.lit(False)), "unknown_evidence")
        .otherwise("grounded")
    )
    return j.select("claim", "region", reason.alias("reason"))


def precedence(first: Column, second: Column) -> Column:
    """struct(value, conflict): the first source's value, else the second's; conflict if both differ."""
    a, b = F.when(F.trim(first) != "", F.trim(first)), F.when(F.trim(second) != "", F.trim(second))
    return F.struct(F.coalesce(a, b).alias("value"), F.coalesce(a != b, F.lit(False)).alias("conflict"))


def atomic(df: DataFrame, by: Sequence[str], ok: Column, old: Column, new: Column, into: str) -> DataFrame:
    """One transaction per group: the new value everywhere if every row is ok, else the old everywhere."""
    every = df.groupBy(*by).agg(F.bool_and(F.coalesce(ok, F.lit(False))).alias("merged"))
    return df.join(every, list(by)).withColumn(into, F.when(F.col("merged"), new).otherwise(old))


def form_fields(df: DataFrame, key: str, text: str) -> DataFrame:
    """Label and value pairs of form text: parts split at semicolons, cut at the first = or colon; no value is unfilled."""
    parts = df.select(key, F.posexplode(F.split(text, r"\s*;\s*")).alias("field_no", "part")).where(F.trim("part") != "")
    label = F.trim(F.regexp_extract("part", r"(?s)^([^=:]*)", 1))
    value = F.trim(F.regexp_extract("part", r"(?s)^[^=:]*[=:](.*)$", 1))
    return parts.select(key, "field_no", label.alias("label"), F.when(value != "", value).alias("value"), F.when(value != "", "filled").otherwise("unfilled").alias("state"))


def interleaved(df: DataFrame, systems: Sequence[str], pairs: int, case: str) -> DataFrame:
    """Every case on every system `pairs` times, pair by pair and system by system: position, pair, system, case."""
    plan = df.select(case).distinct().withColumn("pair", F.explode(F.sequence(F.lit(1), F.lit(pairs)))).withColumn("system", F.explode(F.array(*[F.lit(s) for s in systems])))
    return plan.withColumn("position", F.row_number().over(Window.partitionBy("pair").orderBy("system", case)))


def raster_gate(width: Column, height: Column, quality: Column, complete: Column, most_pixels: float = 4e6) -> Column:
    """The first reason to keep a region from pixel measurement, or admitted."""
    return (
        F.when(width.isNull() | height.isNull(), "evidence_missing")
        .when((width <= 0) | (height <= 0), "crop_empty")
        .when(width * height > most_pixels, "pixel_limit")
        .when(F.coalesce(quality, F.lit(0.0)) < 0.6, "quality")
        .when(~F.coalesce(complete, F.lit(False)), "incomplete")
        .otherwise("admitted")
    )


def outline_paths(tree: DataFrame, key: str = "item_key", parent: str = "parent", most_rounds: int = 40) -> DataFrame:
    """Each node with its depth and the path of keys from its root, of trees of any depth.

    Pointer doubling: every node knows a stretch of its path and the node above it;
    each round puts the stretch of that node before its own, so a chain of n nodes
    takes log n rounds. Rounds are written to the checkpoint folder. A cycle is an
    error, a parent that is not there starts a path as a root does.
    """
    nodes = tree.select(F.col(key).alias("k"), F.col(parent).alias("p"))
    there = nodes.select(F.col("k").alias("p"), F.lit(True).alias("__there")).distinct()
    walk = cut_lineage(nodes.join(there, "p", "left").select("k", F.when(F.col("__there"), F.col("p")).alias("up"), F.col("k").cast("string").alias("path"), F.lit(1).alias("steps")))
    for _ in range(most_rounds):
        if walk.where("up is not null").isEmpty():
            return walk.select(F.col("k").alias(key), "path", (F.col("steps") - 1).alias("depth"))
        above = walk.select(F.col("k").alias("up"), F.col("up").alias("__up"), F.col("path").alias("__path"), F.col("steps").alias("__steps"))
        longer = walk.join(above, "up", "left")
        walk = cut_lineage(longer.select("k", F.col("__up").alias("up"), F.when(F.col("__path").isNull(), F.col("path")).otherwise(F.concat_ws("/", "__path", "path")).alias("path"), (F.col("steps") + F.coalesce("__steps", F.lit(0))).alias("steps")))
        # a path on a cycle doubles for ever: it is longer than there are nodes
        if walk.where(F.col("up").isNotNull() & (F.col("steps") > F.lit(walk.count()))).count():
            raise ValueError("the parents form a cycle")
    raise ValueError("the parents form a cycle")
