"""Boxes: overlap measures and placement verdicts as column expressions.

A box is a struct (x, y, width, height) with the origin at the top left. A null
or empty box overlaps nothing: every measure is 0.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def right(b: Column) -> Column:
    return b["x"] + b["width"]


def bottom(b: Column) -> Column:
    return b["y"] + b["height"]


def area(b: Column) -> Column:
    return F.coalesce(b["width"] * b["height"], F.lit(0.0))


def _span(lo1: Column, hi1: Column, lo2: Column, hi2: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(hi1, hi2) - F.greatest(lo1, lo2))


def intersection(a: Column, b: Column) -> Column:
    both = _span(a["x"], right(a), b["x"], right(b)) * _span(a["y"], bottom(a), b["y"], bottom(b))
    return F.when(a["x"].isNull() | b["x"].isNull(), F.lit(0.0)).otherwise(both)


def _over(share: Column, whole: Column) -> Column:
    return F.when(whole > 0, share / whole).otherwise(F.lit(0.0))


def of_smaller(a: Column, b: Column) -> Column:
    return _over(intersection(a, b), F.least(area(a), area(b)))


def of_first(a: Column, b: Column) -> Column:
    return _over(intersection(a, b), area(a))


def reciprocal(a: Column, b: Column) -> Column:
    return _over(intersection(a, b), F.greatest(area(a), area(b)))


def iou(a: Column, b: Column) -> Column:
    return _over(intersection(a, b), area(a) + area(b) - intersection(a, b))


def horizontal_overlap(a: Column, b: Column) -> Column:
    return _over(_span(a["x"], right(a), b["x"], right(b)), F.least(a["width"], b["width"]))


def vertical_gap(a: Column, b: Column) -> Column:
    """Distance between the bands, 0 where they overlap."""
    return F.greatest(F.lit(0.0), F.greatest(a["y"], b["y"]) - F.least(bottom(a), bottom(b)))


def is_valid(b: Column) -> Column:
    finite = [~F.isnan(b[k]) & (F.abs(b[k]) < 1e12) for k in ("x", "y", "width", "height")]
    return F.coalesce(finite[0] & finite[1] & finite[2] & finite[3] & (b["width"] > 0) & (b["height"] > 0), F.lit(False))


def caption_verdict(caption: Column, owner: Column, max_gap: float = 72.0) -> Column:
    """The first failing reason of a caption's place beside its owner, or 'accepted'."""
    return (
        F.when(caption["x"].isNull(), "caption_geometry_unavailable")
        .when(owner["x"].isNull(), "owner_geometry_unavailable")
        .when(area(caption) <= 0, "caption_empty")
        .when(area(owner) <= 0, "owner_empty")
        .when(of_smaller(caption, owner) > 0.20, "overlap")
        .when(horizontal_overlap(caption, owner) < 0.20, "not_aligned")
        .when(vertical_gap(caption, owner) > max_gap, "too_far")
        .otherwise("accepted")
    )


def note_verdict(note: Column, owner: Column, max_gap: float = 72.0) -> Column:
    """The first failing reason of a source note below its owner, or 'accepted'."""
    return (
        F.when(note["x"].isNull() | owner["x"].isNull(), "geometry_unavailable")
        .when(~note["unit"].eqNullSafe(owner["unit"]), "unit_mismatch")
        .when(intersection(note, owner) > 0, "overlap")
        .when(note["y"] < bottom(owner), "not_below")
        .when(horizontal_overlap(note, owner) < 0.20, "not_aligned")
        .when(note["y"] - bottom(owner) > max_gap, "too_far")
        .otherwise("accepted")
    )


def child_verdict(child: Column, owner: Column) -> Column:
    return F.when(child["x"].isNull() | owner["x"].isNull(), "geometry_unavailable").when(of_first(child, owner) < 0.80, "not_contained").otherwise("accepted")
