"""Components, closures, trees, stable orders and claims."""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from pagelore.operators.folds import fold_groups
from pagelore.session import cut_lineage


def components(edges: DataFrame, a: str, b: str, most_rounds: int = 40) -> DataFrame:
    """node and component (its least node) of every node that has an edge.

    Alternating large-star and small-star rounds: each moves neighbours to the
    least node around, so a chain of n nodes takes about log n rounds and no
    node ever gathers more than its own neighbourhood. Each round is written to
    the checkpoint folder; only a count of changed edges reaches the driver.
    """
    u, v = F.col(a).alias("u"), F.col(b).alias("v")
    links = edges.where(F.col(a) != F.col(b)).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct()
    links = cut_lineage(links)
    for _ in range(most_rounds):
        both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        small = cut_lineage(small)
        changed = small.join(links, ["u", "v"], "left_anti").limit(1).count() + links.join(small, ["u", "v"], "left_anti").limit(1).count()
        links = small
        if not changed:
            break
    else:
        raise RuntimeError("the components did not settle; raise most_rounds")
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()


def closure_of_disabled(flags: DataFrame, needs: DataFrame, name: str = "flag", needed: str = "needs", enabled: str = "enabled") -> DataFrame:
    """flag and effective: a flag is off if it is disabled or needs, however indirectly, one that is off.

    A missing needed flag counts as off. Each round adds the flags that need one
    found in the last, until there are none; rounds are written to the checkpoint
    folder.
    """
    f = flags.select(F.col(name).alias("flag"), F.coalesce(F.col(enabled), F.lit(False)).alias("enabled"))
    n = needs.select(F.col(name).alias("flag"), F.col(needed).alias("needs"))
    missing = n.join(f.select(F.col("flag").alias("needs")), "needs", "left_anti").select("flag")
    off = new = cut_lineage(f.where("not enabled").select("flag").unionByName(missing).distinct())
    while not new.isEmpty():
        new = cut_lineage(n.join(new.select(F.col("flag").alias("needs")), "needs").select("flag").distinct().join(off, "flag", "left_anti"))
        off = cut_lineage(off.unionByName(new))
    return f.join(off.withColumn("off", F.lit(True)), "flag", "left").select(F.col("flag").alias(name), F.col("off").isNull().alias("effective"))


def outline_parents(df: DataFrame, by: Sequence[str], order: Sequence[str], level: str, key: str) -> DataFrame:
    """Each heading with its parent: the last one before it of a smaller level (null at the top).

    One window per level that the data hold keeps the last heading of that level;
    the parent is the latest of those with a smaller level. Levels are few by
    nature, headings are not. A heading with a null level has no parent and is none.
    """
    levels = [r[0] for r in df.select(level).where(F.col(level).isNotNull()).distinct().orderBy(level).collect()]
    if len(levels) > 1_000:
        raise ValueError("levels are not levels: more than a thousand of them")
    before = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    at = F.struct(F.row_number().over(Window.partitionBy(*by).orderBy(*order)).alias("at"), F.col(key).alias("key"))
    rows = df.withColumn("__at", at)
    lasts = [F.when(F.col(level) > k, F.last(F.when(F.col(level) == k, F.col("__at")), ignorenulls=True).over(before)) for k in levels[:-1]]
    none = F.lit(None).cast(df.schema[key].dataType)
    above = F.array_max(F.array_compact(F.array(*lasts)))["key"] if lasts else none
    return rows.withColumn("parent", above).drop("__at")


def _kahn(nodes: list, rank: dict, after: dict) -> list | None:
    """Stable topological order by rank; None if there is a cycle."""
    waiting = dict.fromkeys(nodes, 0)
    for targets in after.values():
        for t in targets:
            waiting[t] += 1
    ready = [(rank[n], n) for n in nodes if not waiting[n]]
    heapq.heapify(ready)
    out = []
    while ready:
        _, n = heapq.heappop(ready)
        out.append(n)
        for t in after.get(n, ()):
            waiting[t] -= 1
            if not waiting[t]:
                heapq.heappush(ready, (rank[t], t))
    return out if len(out) == len(nodes) else None


def stable_order(nodes: DataFrame, edges: DataFrame, by: Sequence[str], key: str, rank: str, source: str, target: str) -> DataFrame:
    """Nodes of each group in an order that respects the edges, as close to rank as can be.

    A heap takes the least rank among the free nodes. A group whose edges form a
    cycle keeps its ranks (accepted is false). Edges to nodes that are not there
    and self edges are ignored.
    """
    # edges ride along as rows of their group without a node
    ends = edges.select(*by, F.col(source).alias("__s"), F.col(target).alias("__t")).distinct()
    rows = nodes.select(*by, F.col(key).alias("__k"), F.col(rank).alias("__r")).unionByName(ends, allowMissingColumns=True)
    fields = nodes.select(*by, key).schema

    def order(group: list[dict]) -> list[tuple]:
        ranks = {g["__k"]: (g["__r"], g["__k"]) for g in group if g["__k"] is not None}
        after: dict = {}
        for g in group:
            if g["__s"] in ranks and g["__t"] in ranks and g["__s"] != g["__t"]:
                after.setdefault(g["__s"], []).append(g["__t"])
        found = _kahn(list(ranks), ranks, after)
        return [(k, i, found is not None) for i, k in enumerate(found if found is not None else sorted(ranks, key=ranks.get))]

    out = T.StructType([*fields.fields, T.StructField("position", T.IntegerType()), T.StructField("accepted", T.BooleanType())])
    return fold_groups(rows, by, ["__r", "__k"], order, out)


def _islands(spans: list[tuple[float, float, int]], gap: float) -> list[list[int]]:
    out: list[list[int]] = []
    reach = None
    for start, end, i in sorted(spans):
        if reach is None or start > reach + gap:
            out.append([])
            reach = end
        out[-1].append(i)
        reach = max(reach, end)
    return out


def cut_order(boxes: list[tuple[float, float, float, float]], ranks: list, gap: float = 0.5) -> list[int]:
    """Recursive X-Y cut: rows first, then columns, then rank; indexes in reading order."""

    def cut(of: list[int]) -> list[int]:
        if len(of) < 2:
            return of
        for axis in (1, 0):
            parts = _islands([(boxes[i][axis], boxes[i][axis] + boxes[i][axis + 2], i) for i in of], gap)
            if len(parts) > 1:
                return [i for p in parts for i in cut(p)]
        return sorted(of, key=lambda i: ranks[i])

    return cut(list(range(len(boxes))))


def xy_cut(df: DataFrame, by: Sequence[str], box: str, rank: str, key: str) -> DataFrame:
    """position of each box of a page by recursive X-Y cuts; rows without a box are left out."""
    flat = df.where(F.col(f"{box}.width").isNotNull()).select(*by, F.col(rank).alias("__r"), F.col(key).alias("__k"), *[F.col(f"{box}.{c}").alias(f"__{c}") for c in ("x", "y", "width", "height")])

    def order(group: list[dict]) -> list[tuple]:
        found = cut_order([(g["__x"], g["__y"], g["__width"], g["__height"]) for g in group], list(range(len(group))))
        return [(group[i]["__k"], at) for at, i in enumerate(found)]

    return fold_groups(flat, by, ["__r", "__k"], order, T.StructType([*df.select(*by, key).schema.fields, T.StructField("position", T.IntegerType())]))


def allocate_claims(claims: DataFrame, source: str, owner: str, order: Sequence[str]) -> DataFrame:
    """Each source to the first owner that claims it, in order; owners that are sources themselves do not claim."""
    hosts = claims.join(claims.select(F.col(source).alias(owner)).distinct(), owner, "left_anti")
    return hosts.groupBy(source).agg(F.min_by(owner, F.struct(*order, owner)).alias(owner))
