"""One form for text that looks the same: widths, accents, spaces, look-alikes.

A longest-match transducer over grapheme clusters, compiled once. Its tables hold
what each character expands to, and a tree of every cluster of a base and marks
that has a form of its own: full-width forms, canonical composition (Hangul
included), ligatures, invisible characters, kinds of space and hyphen, letters
of other scripts that look like Latin ones. All of it is checked for conflicts: no
source has two targets, and every target is its own form, so one pass reaches the
final form and a second pass changes nothing. Case, accents, wording, line
breaks, raised digits and letters against digits stay as they are.

Defined results: null stays null, empty stays empty, ASCII text only has its
tabs turned into spaces; a combining mark without a base stays; marks that no
form takes up follow in canonical order; unknown characters map to themselves.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelore.session import cut_lineage

#: Cyrillic and Greek letters and the Latin letters they look like.
CYRILLIC_LATIN = ("АВЕЅІЈКМНОРСТУХаеѕіјорсухԁԛԝһӏҮүԌ", "ABESIJKMHOPCTYXaesijopcyxdqwhlYvG")
GREEK_LATIN = ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονϲϳ", "ABEZHIKMNOPTYXovcj")
#: Symbols and letters with a twin elsewhere in Unicode.
TWINS = ("μΩÅKℓɑɡı", "µΩÅKlagi")
#: Characters without width or ink.
INVISIBLE = "­͏؜ᅟᅠ឴឵᠎​‌‍‎‏‪‫‬‭‮⁠⁡⁢⁣⁤⁦⁧⁨⁩﻿︎️"
#: Spaces other than U+0020, and hyphens other than U+002D.
SPACES = "\t               　"
HYPHENS = "‐‑﹣－⁃"
#: Blocks whose members map to their compatibility form: width variants and ligatures.
WIDTH_BLOCKS = ((0xFF01, 0xFFEE), (0xFB00, 0xFB06))
#: Half-width sound marks and the marks they stand for.
HALF_MARKS = {"ﾞ": "\u3099", "ﾟ": "\u309a"}


def _letters() -> dict[str, str]:
    out: dict[str, str] = {}
    for sources, targets in (CYRILLIC_LATIN, GREEK_LATIN, TWINS):
        for a, b in zip(sources, targets, strict=True):
            _put(out, a, b)
    return out


def _put(mapping: dict[str, str], source: str, target: str) -> None:
    if source == target:
        return
    if mapping.get(source, target) != target:
        raise ValueError(f"two targets for {source!r}: {mapping[source]!r} and {target!r}")
    mapping[source] = target


def _compose(text: str, letters: dict[str, str]) -> str:
    """Decompose, map each base, compose again."""
    return unicodedata.normalize("NFC", "".join(letters.get(c, c) for c in unicodedata.normalize("NFD", text)))


@lru_cache(maxsize=1)
def compile_mapping() -> dict[str, str]:
    """Cluster -> its one form. Raises ValueError on a conflict."""
    letters = _letters()
    out: dict[str, str] = {}
    for a, b in letters.items():
        _put(out, a, b)
    for c in INVISIBLE:
        _put(out, c, "")
    for c in SPACES:
        _put(out, c, " ")
    for c in HYPHENS:
        _put(out, c, "-")
    for first, last in WIDTH_BLOCKS:
        for code in range(first, last + 1):
            c = chr(code)
            if c in out or unicodedata.category(c) == "Cn":
                continue
            plain = unicodedata.normalize("NFKC", c)
            if plain != c and not unicodedata.combining(plain[0]):
                _put(out, c, _compose("".join(p for p in plain if p not in INVISIBLE), letters))
    for code in (*range(0xA0, 0x2000), *range(0x3041, 0x3100), *range(0x2126, 0x212C)):
        c = chr(code)
        if c in out:
            continue
        form = _compose(c, letters)
        if form != c:
            _put(out, c, form)
    for source, target in out.items():
        again = "".join(out.get(c, c) for c in target)
        if again != target:
            raise ValueError(f"{source!r} maps to {target!r}, which maps on to {again!r}")
    return out


@dataclass(frozen=True)
class Tables:
    """The compiled transducer."""

    single: dict[int, str]  # a character alone -> its form, where that is another
    expand: dict[str, str]  # a character -> base and marks of its form
    order: dict[str, int]  # each mark -> its canonical class
    tree: dict  # base -> mark -> ... -> {"": form}


def _code_points() -> Iterator[str]:
    return (chr(c) for c in (*range(0xA0, 0xD800), *range(0xE000, 0x1_F000)))


@lru_cache(maxsize=1)
def compile_tables() -> Tables:
    """Every character and cluster that has a form; raises ValueError on a conflict."""
    letters, single = _letters(), compile_mapping()
    order = {c: unicodedata.combining(c) for c in _code_points() if unicodedata.combining(c)}
    clusters: dict[str, str] = {}
    expand: dict[str, str] = {}
    for c in _code_points():
        form = single.get(c, c)
        if form is c and c not in letters and unicodedata.is_normalized("NFD", c):
            continue
        parts = "".join(letters.get(x, x) for x in unicodedata.normalize("NFD", form))
        if parts != c:
            expand[c] = parts
        if len(parts) > 1 and len(form) == 1:
            _put(clusters, parts, unicodedata.normalize("NFC", parts))
        canonical = unicodedata.decomposition(c).split()
        if len(canonical) == 2 and not canonical[0].startswith("<"):
            order.setdefault(chr(int(canonical[1], 16)), 0)  # joins the one before it without a class
    for c in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)):  # medial and final jamo
        order.setdefault(chr(c), 0)
    for c, mark in HALF_MARKS.items():
        order[c] = order[mark]
    for c, parts in expand.items():
        if parts and parts[0] in order:
            order.setdefault(c, order[parts[0]])
    tree: dict = {}
    for parts, form in clusters.items():
        if len(form) == 1 and parts[0] not in order:
            node = tree.setdefault(parts[0], {})
            for mark in parts[1:]:
                node = node.setdefault(mark, {})
            if node.setdefault("", form) != form:
                raise ValueError(f"two forms for {parts!r}: {node['']!r} and {form!r}")
    tables = Tables({ord(c): f for c, f in single.items()}, expand, order, tree)
    final = Transducer(tables)
    for source, form in (*single.items(), *clusters.items()):
        if final(form) != form:
            raise ValueError(f"{source!r} maps to {form!r}, which maps on to {final(form)!r}")
        if final(source) != form:
            raise ValueError(f"{source!r} reads as {final(source)!r} and not as {form!r}")
    return tables


class Transducer:
    """Applies the tables in one pass: of each cluster the longest match wins.

    Where a text holds no mark, each character is a cluster and the table of
    single characters is all there is to apply.
    """

    def __init__(self, tables: Tables | None = None) -> None:
        self.tables = t = tables or compile_tables()
        # beyond the basic plane any character may be a mark: a set of both would be searched range by range
        self.marks = re.compile("[" + "".join(re.escape(c) for c in sorted(t.order) if c < "\U00010000") + "]")
        self.beyond = re.compile("[\U00010000-\U0010ffff]")
        self.plain_runs = re.compile("\t|[^\x00-\x7f]+")
        self.marked_runs = re.compile("\t|[\x00-\x7f]?[^\x00-\x7f]+")
        self.plain_memo: dict[str, str] = {}
        self.marked_memo: dict[str, str] = {}

    def _walk(self, run: str) -> str:
        """The form of a run: expand its characters, then match each base with its marks."""
        expand, order, tree = self.tables.expand, self.tables.order, self.tables.tree
        seq: list[str] = []
        for c in run:
            if c in HALF_MARKS:
                seq += HALF_MARKS[c] if seq else c  # a half mark alone stays
            elif c == "\t":
                seq.append(" ")
            else:
                seq += expand.get(c, c)
        out: list[str] = []
        i = 0
        while i < len(seq):
            base, i = seq[i], i + 1
            first = i
            while i < len(seq) and seq[i] in order:
                i += 1
            if i == first:
                out.append(base)
                continue
            node, form, rest = tree.get(base, {}), base, []
            for m in _in_order(seq[first:i], order):
                free = not rest or order[rest[-1]] < order[m]
                if m in node and free:
                    node = node[m]
                    form = node[""]
                else:
                    rest.append(m)
            out.append(form)
            out += rest
        return "".join(out)

    def __call__(self, text: str | None) -> str | None:
        if text is None or (text.isascii() and "\t" not in text):
            return text
        if self.marks.search(text) or self.beyond.search(text):
            return self.marked_runs.sub(self._marked, text)
        return self.plain_runs.sub(self._plain, text)

    def _plain(self, m: re.Match[str]) -> str:
        run = m.group()
        known = self.plain_memo.get(run)
        if known is None:
            known = run.translate(self.tables.single)
            if len(self.plain_memo) < 65_536 and len(run) < 64:
                self.plain_memo[run] = known
        return known

    def _marked(self, m: re.Match[str]) -> str:
        run = m.group()
        known = self.marked_memo.get(run)
        if known is None:
            known = self._walk(run)
            if len(self.marked_memo) < 65_536 and len(run) < 64:
                self.marked_memo[run] = known
        return known


def _in_order(marks: list[str], order: dict[str, int]) -> list[str]:
    """Marks in canonical order: by class between those without one."""
    if len(marks) < 2:
        return marks
    out: list[str] = []
    held: list[str] = []
    for m in marks:
        if order[m]:
            held.append(m)
        else:
            out += [*sorted(held, key=order.__getitem__), m]
            held = []
    return out + sorted(held, key=order.__getitem__)


@F.pandas_udf(T.StringType())
def one_form(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    transducer = Transducer()
    for values in batches:
        yield values.map(transducer, na_action="ignore")


def unify(df: DataFrame, value: str = "value", into: str = "unified") -> DataFrame:
    """`df` with the unified form of a text column; rows and other columns stay."""
    return df.withColumn(into, one_form(F.col(value)))


def spelling_classes(df: DataFrame, key: str = "item_key", group: str = "parse_id", value: str = "value") -> DataFrame:
    """Rows of one group that look alike in several spellings: group, form (a digest), exact (a digest) and key, each once.

    Rows repeated under one key count once; null and empty values take no part.
    The forms are computed once, as digests in the checkpoint folder; from there
    on only digests are shuffled. Groups in which every row has the same code
    points are dropped by a map-side combined aggregate.
    """
    named = df.select(F.col(key).alias("__key"), F.col(group).alias("__group"), F.col(value).alias("__value")).where(F.col("__value") != "")
    digest = lambda c: F.unhex(F.md5(c))
    forms = cut_lineage(named.select("__key", "__group", digest(F.col("__value")).alias("exact"), digest(one_form(F.col("__value"))).alias("form")))
    several = forms.groupBy("__group", "form").agg(F.min("exact").alias("__low"), F.max("exact").alias("__high")).where("__low <> __high").select("__group", "form")
    rows = forms.join(several, ["__group", "form"], "left_semi").distinct()
    return rows.select(F.col("__group").alias(group), "form", "exact", F.col("__key").alias(key))


def equal_looking_pairs(df: DataFrame, key: str = "item_key", group: str = "parse_id", value: str = "value") -> DataFrame:
    """Pairs of rows of one group that look alike but differ in code points.

    The pairs themselves are the result; `spelling_classes` gives the same without them.
    """
    rows = cut_lineage(spelling_classes(df, key, group, value).select(F.col(group).alias("__group"), "form", "exact", F.col(key).alias("__key")))
    a, b = rows.alias("a"), rows.alias("b")
    same = (F.col("a.__group") == F.col("b.__group")) & (F.col("a.form") == F.col("b.form"))
    pairs = a.join(b, same & (F.col("a.exact") != F.col("b.exact")) & (F.col("a.__key") < F.col("b.__key")))
    return pairs.select(F.col("a.__key").alias(f"{key}_a"), F.col("b.__key").alias(f"{key}_b")).distinct()
