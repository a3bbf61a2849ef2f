"""Filling containers of fixed capacity with texts of varying token length.

Sum-of-squares packing: N(g) is the number of open containers with g tokens
unused. A text goes where the sum of N(g)^2 over the open gaps becomes smallest:
into a container of gap g, or into a new one; ties go to the tightest. Open
containers so stay spread over all gaps and nearly every text meets one that it
fills well. The stream is divided by a hash of the document into groups of some
ten thousand texts that are packed independently; the loss is what the last open
containers of each group leave unused, and those are packed once more by best
fit decreasing, kept if that takes fewer containers.

Defined results: a text longer than the capacity is cut into full containers
and a rest, which is packed like a text; an empty or null text (no tokens) takes
no room and gets no container (null); a null or non-positive capacity packs
nothing. Equal sizes are taken in the order of the document's hash.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelore.llm.corpus_tokens import encoder, slices, tokenizer_path

GROUP_TEXTS = 10_000

PLACED = "pack_id int, group_no int, container_no int, doc_id bigint, part int, start_token int, n_tokens int, capacity int"


def token_counts(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """doc_id and n_tokens of every document; null and empty texts have 0."""
    path = path or tokenizer_path()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in slices(batches):
            sizes = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int32())], ["doc_id", "n_tokens"])

    return documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(count, "doc_id bigint, n_tokens int")


def sum_of_squares(sizes: list[int], capacity: int) -> list[int]:
    """Container number of each size, in order; sizes are 1..capacity."""
    open_by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    n = np.zeros(capacity + 1, dtype=np.int64)  # n[0] stays 0: full containers are closed
    out, containers = [], 0
    for size in sizes:
        if size == capacity:
            out.append(containers)
            containers += 1
            continue
        gaps = n[size:capacity]
        change = 2 * (n[: capacity - size] - gaps) + 2  # a container of gap g becomes one of gap g - size
        change[0] = 1 - 2 * gaps[0]  # and is full
        change[gaps == 0] = np.iinfo(np.int64).max
        best = int(change.argmin()) if len(change) else 0
        if len(change) and change[best] <= 2 * n[capacity - size] + 1:
            gap = best + size
            c = open_by_gap[gap].pop()
            n[gap] -= 1
        else:
            gap, c = capacity, containers
            containers += 1
        left = gap - size
        if left:
            open_by_gap[left].append(c)
            n[left] += 1
        out.append(c)
    return out


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    out = [0] * len(sizes)
    gaps: list[tuple[int, int]] = []
    containers = 0
    for i in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        at = bisect_left(gaps, (sizes[i], -1))
        if at < len(gaps):
            gap, c = gaps.pop(at)
        else:
            gap, c = capacity, containers
            containers += 1
        out[i] = c
        insort(gaps, (gap - sizes[i], c))
    return out


def pack(sizes: list[int], capacity: int) -> list[int]:
    """Sum of squares, then best fit decreasing over what its unfilled containers hold."""
    chosen = sum_of_squares(sizes, capacity)
    fill: dict[int, int] = {}
    for c, s in zip(chosen, sizes, strict=True):
        fill[c] = fill.get(c, 0) + s
    loose = {c for c, f in fill.items() if f < capacity - capacity // 64}
    again = [i for i, c in enumerate(chosen) if c in loose]
    other = best_fit_decreasing([sizes[i] for i in again], capacity)
    if len(set(other)) < len(loose):
        names = sorted(loose)
        for i, c in zip(again, other, strict=True):
            chosen[i] = names[c]
    number = {c: k for k, c in enumerate(dict.fromkeys(chosen))}
    return [number[c] for c in chosen]


def _pack_group(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["h", "doc_id", "part"], kind="stable")
    capacity = int(rows["capacity"].iloc[0])
    sizes = rows["n_tokens"].astype(int).tolist()
    out = rows[["pack_id", "group_no", "doc_id", "part", "start_token", "n_tokens", "capacity"]].copy()
    out.insert(2, "container_no", pack(sizes, capacity))
    return out


def pack_texts(counts: DataFrame, packs: list[tuple[int, int]], texts: int, group_texts: int = GROUP_TEXTS) -> DataFrame:
    """Assign every text (or its parts) to a container, for each (pack_id, capacity).

    `counts` has doc_id and n_tokens; `texts` is its number of rows (or near it)
    and only sets the number of groups. Result: pack_id, group_no, container_no,
    doc_id, part, start_token, n_tokens, capacity; a container is named by
    (pack_id, group_no, container_no).
    """
    groups = max(1, math.ceil(texts / group_texts))
    kinds = [F.struct(F.lit(int(i)).alias("pack_id"), F.lit(int(c)).alias("capacity")) for i, c in packs if c is not None and c > 0]
    if not kinds:
        return counts.sparkSession.createDataFrame([], PLACED)
    h = F.xxhash64("doc_id")
    # each text once for each kind of container, and for each part that the capacity makes of it
    each = counts.select("doc_id", "n_tokens", h.alias("h"), F.explode(F.array(*kinds)).alias("k")).select("doc_id", "n_tokens", "h", "k.*")
    last = F.greatest(F.ceil(F.col("n_tokens") / F.col("capacity")) - 1, F.lit(0)).cast("int")
    parts = each.withColumn("part", F.explode(F.sequence(F.lit(0), last)))
    start = (F.col("part") * F.col("capacity")).cast("int")
    parts = parts.withColumn("start_token", start).withColumn("n_tokens", F.least(F.col("capacity"), F.col("n_tokens") - F.col("start_token")).cast("int")).withColumn("group_no", F.pmod("h", F.lit(groups)).cast("int"))
    # full parts need no company, they are containers by themselves
    packed = parts.where("n_tokens > 0").groupBy("pack_id", "group_no").applyInPandas(_pack_group, PLACED)
    nothing = parts.where("n_tokens = 0").select("pack_id", "group_no", F.lit(None).cast("int").alias("container_no"), "doc_id", "part", "start_token", "n_tokens", "capacity")
    return packed.unionByName(nothing)


def fill_rates(placed: DataFrame) -> DataFrame:
    """For each pack: texts, containers, tokens and the share of the capacity in use."""
    each = placed.where("container_no is not null").groupBy("pack_id", "capacity", "group_no", "container_no").agg(F.sum("n_tokens").alias("used"))
    return each.groupBy("pack_id", "capacity").agg(F.count(F.lit(1)).alias("containers"), F.sum("used").alias("tokens")).withColumn("fill", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity")), 4))
