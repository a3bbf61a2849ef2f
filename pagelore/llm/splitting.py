"""Cutting long items at natural boundaries, with overlap.

Each gap between two code points has a boundary strength. A sparse table of
range maxima answers, for every permissible window of piece lengths, which cut
is strongest; the rightmost one wins a tie. The next piece starts `overlap`
code points before the cut.

Defined results: null and empty values and values within the limit are one
piece, the value itself; a null or non-positive limit means no limit; the
overlap is at most half the limit, a null or negative one counts as 0; a value
without any boundary is cut at the limit, but not between a base and its
combining marks, unless nothing else is left. Pieces joined without their
overlaps give the value back exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Strengths of the boundary after a character, weakest to strongest.
INSIDE_CLUSTER, INSIDE_WORD, AFTER_WIDE, AFTER_SPACE, AFTER_CLAUSE, AFTER_SENTENCE, AFTER_LINE, AFTER_PARAGRAPH = range(8)
SENTENCE_MARKS = ".!?…。！？"
CLAUSE_MARKS = ",;:–—、；："


def strengths(text: str) -> np.ndarray:
    """Strength of the boundary before each position 0..len(text)."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    n = len(c)
    s = np.full(n + 1, INSIDE_WORD, dtype=np.int64)
    if n == 0:
        return s
    codes = lambda marks: np.isin(c, [ord(m) for m in marks])
    space = codes(" \t\r\f  　") | codes("\n")
    newline, sentence, clause = codes("\n"), codes(SENTENCE_MARKS), codes(CLAUSE_MARKS)
    wide = (c >= 0x3000) & (c <= 0x9FFF)
    s[1:][wide] = AFTER_WIDE
    s[1:][space] = AFTER_SPACE
    s[1:][wide & clause] = AFTER_CLAUSE
    s[1:][wide & sentence] = AFTER_SENTENCE
    if n > 1:
        before, after_space = c[:-1], space[1:]
        s[2:][clause[:-1] & after_space] = AFTER_CLAUSE
        s[2:][sentence[:-1] & after_space] = AFTER_SENTENCE
        s[1:][newline] = np.maximum(s[1:][newline], AFTER_LINE)
        s[2:][newline[1:] & (before == 10)] = AFTER_PARAGRAPH
        mark = (c >= 0x300) & (c <= 0x36F) | (c >= 0x3099) & (c <= 0x309A) | (c >= 0xFE00) & (c <= 0xFE0F) | (c == 0x200D)
        s[:-1][mark] = INSIDE_CLUSTER
        s[1:-1][(c == 0x200D)[:-1]] = INSIDE_CLUSTER
    else:
        s[1:][newline] = AFTER_LINE
    return s


class RangeMaximum:
    """Sparse table: the greatest value in any range in two look-ups."""

    def __init__(self, values: np.ndarray, longest: int) -> None:
        self.levels = [values]
        width = 1
        while 2 * width <= longest and 2 * width <= len(values):
            last = self.levels[-1]
            self.levels.append(np.maximum(last[:-width], last[width:]))
            width *= 2

    def query(self, first: int, last: int) -> int:
        """Over first..last, both included; the range is at most `longest` long."""
        k = min((last - first + 1).bit_length() - 1, len(self.levels) - 1)
        return int(max(self.levels[k][first], self.levels[k][last - (1 << k) + 1]))


def cuts(text: str, limit: int | None, overlap: int | None) -> list[tuple[int, int]]:
    """(start, end) of the pieces of a text, in code points."""
    n = len(text)
    if limit is None or limit <= 0 or n <= limit:
        return [(0, n)]
    back = min(max(overlap or 0, 0), limit // 2)
    s = strengths(text)
    # strength first, position second: the maximum is the rightmost of the strongest
    index = RangeMaximum(s * (n + 1) + np.arange(n + 1), limit)
    out, start = [], 0
    while n - start > limit:
        first, last = start + max(back + 1, limit // 2), start + limit
        end = index.query(first, last) % (n + 1)
        out.append((start, end))
        start = end - back
    out.append((start, n))
    return out


PIECE = T.StructType([T.StructField("item_key", T.LongType()), T.StructField("piece_no", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("piece", T.StringType())])


def _split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for key, value, limit, overlap in zip(b["item_key"], b["value"], b["max_chars"], b["overlap_chars"], strict=True):
            bounds = cuts(value, None if pd.isna(limit) else int(limit), None if pd.isna(overlap) else int(overlap))
            rows += [(key, i, a, z, value[a:z]) for i, (a, z) in enumerate(bounds)]
        yield pd.DataFrame(rows, columns=PIECE.names)


def oversized(items: DataFrame, collections: DataFrame) -> DataFrame:
    """Items longer than their collection's limit, once each, with the limits.

    The collections are a fixed table; Catalyst broadcasts it by its measured
    size and joins by shuffle if it ever outgrows the threshold.
    """
    limits = collections.select("collection_id", "max_chars", "overlap_chars").where(F.col("max_chars") > 0)
    rows = items.select("item_key", "parse_id", "page_index", "id", "collection_id", "value").join(limits, "collection_id")
    return rows.where(F.length("value") > F.col("max_chars")).dropDuplicates(["item_key"])


def split_oversized(items: DataFrame, collections: DataFrame) -> DataFrame:
    """Pieces of every oversized item: item_key, piece_no, start, end, piece."""
    return oversized(items, collections).select("item_key", "value", "max_chars", "overlap_chars").mapInPandas(_split, PIECE)


def ordered_pieces(items: DataFrame, pages: DataFrame, collections: DataFrame) -> DataFrame:
    """The pieces with their place in the document: parse_id, page_index and the
    reading order that the page's own list gives (the item's, if not listed)."""
    long = oversized(items, collections)
    listed = pages.select("parse_id", "page_index", F.explode("items").alias("i")).select("parse_id", "page_index", F.col("i.id").alias("id"), F.col("i.reading_order").alias("listed_order")).groupBy("parse_id", "page_index", "id").agg(F.min("listed_order").alias("listed_order"))
    place = long.select("item_key", "parse_id", "page_index", "id").join(listed, ["parse_id", "page_index", "id"], "left")
    pieces = long.select("item_key", "value", "max_chars", "overlap_chars").mapInPandas(_split, PIECE)
    return pieces.join(place.select("item_key", "parse_id", "page_index", "listed_order"), "item_key")
