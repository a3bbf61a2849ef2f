"""Noise of scanned pages: hyphens at line ends, misread characters, running
headers and page labels.

All evidence is relational and corpus-wide. A lexicon counts every word of every
item, apart for trusted sources (text that was not recognised from an image) and
the rest. Rare words are joined with frequent ones by anagram hash: the hash of
a word is the sum of the fifth powers of its code points, so replacing "m" by
"rn" changes it by a constant whatever the word is. Each known confusion is one
difference; a rare word whose hash plus a difference meets a frequent word's
hash is a candidate, which the actual substitution then proves. Candidates are
ranked by frequency. Confusions of ordinary vowels, and of u and n, lead from many
a rare word to a frequent one: those are believed only of words that trusted text
never holds, and only where the frequent word stands beside the same neighbour
elsewhere in scanned text. Hyphens are judged by how often the joined and the
hyphenated spelling occur. Edge lines go by the page's label and by the parse's
header and footer items, compared in a form in which confusable characters are
equal.

Defined results: null and empty values have no defects and stay as they are;
a page without a label falls back to its page number; ties between corrections
go to the alphabetically last; words of one or two letters and words without a
character of the table of confusions (Japanese, Arabic) are never misreadings;
repeated deliveries of an item count once; an empty table gives an empty result; very long
values are processed whole.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from pagelore.session import cut_lineage

#: Fixed values: (as printed, as misread) character confusions of text recognition.
CONFUSIONS = (
    ("e", "c"), ("c", "e"), ("t", "f"), ("f", "t"), ("n", "ri"), ("ri", "n"), ("i", "l"), ("l", "i"),
    ("o", "0"), ("l", "1"), ("i", "1"), ("d", "cl"), ("cl", "d"), ("u", "ii"), ("ii", "u"), ("g", "9"),
    ("m", "rn"), ("rn", "m"), ("h", "b"), ("b", "h"), ("li", "h"), ("h", "li"), ("s", "5"), ("i", "|"),
    ("l", "|"), ("w", "vv"), ("vv", "w"), ("b", "8"), ("a", "@"), ("in", "m"), ("m", "in"), ("z", "2"),
    ("q", "9"), ("s", "$"), ("nn", "m"),
)
#: Confusions that need a neighbour's support.
WEAK_CONFUSIONS = (("a", "o"), ("o", "a"), ("u", "n"), ("n", "u"))
SOURCES = ("ocr", "mixed")
TYPES = ("text", "list")

MIN_FREQUENT = 5  # occurrences of a word that corrects another
MIN_RATIO = 10  # times that the frequent word occurs more often
BROADCAST_ROWS = 100_000  # corrections are broadcast up to so many, of at most BROADCAST_CHARS letters, else joined by shuffle
BROADCAST_CHARS = 40
BROADCAST_KEYS = 1_000_000  # keys of items delivered several times, of sixteen bytes each
HASH_MODULUS = (1 << 61) - 1

#: What lies between words of lower-cased text; the plain range comes first as most characters are in it.
_TOKEN_GAP = r"[^a-z\p{L}0-9@|$\p{M}]+"
_LETTER = "[a-zA-Z\u00c0-\u024f\u0370-\u04ff]"
_COMPOUND = f"(?<!{_LETTER})({_LETTER}++(?:-{_LETTER}++)++)"
_BREAK = r"[\p{L}\p{M}\p{N}@|$-]*[\p{L}\p{M}\p{N}@|$][-‐¬­][ \t]*\n[ \t]*[\p{L}@|][\p{L}\p{M}\p{N}@|$]*(?:-[\p{L}\p{M}]+)*"
_BROKEN = r"[-‐¬­][ \t]*\n"
_BREAK_PARTS = r"(?s)^(.*)([-‐¬­])[ \t]*\n[ \t]*(.*)$"
_LABEL_LINE = r"^(?:(?:page|p\.|pag\.|pág\.|seite|s\.|стр\.)\s*)?[\[(\-–—|\s]*([0-9a-z][0-9a-z.\-]*?)[\])\-–—|\s]*$"


def anagram_hash(word: Column) -> Column:
    """Sum of the fifth powers of the code points modulo a prime, as a bigint; words of any length stay in range."""
    return F.aggregate(F.filter(F.split(word, ""), lambda c: c != ""), F.lit(0).cast("bigint"), lambda a, c: F.pmod(a + F.ascii(c).cast("bigint") * F.ascii(c) * F.ascii(c) * F.ascii(c) * F.ascii(c), F.lit(HASH_MODULUS)))


def _hash(text: str) -> int:
    return sum(ord(c) ** 5 for c in text)


def confusable_form(text: Column) -> Column:
    """A form in which characters that are taken for each other are equal."""
    t = F.regexp_replace(F.lower(F.trim(text)), r"\s+", " ")
    t = F.when(F.contains(t, F.lit("8")), F.regexp_replace(t, r"(?<=\p{L})8|8(?=\p{L})", "h")).otherwise(t)
    t = F.translate(t, "0i1|!59@$", "olllls9as")
    for shape, letter in (("rn", "m"), ("rl", "n"), ("ln", "m"), ("nn", "m"), ("cl", "d"), ("vv", "w"), ("ll", "h")):
        t = F.replace(t, F.lit(shape), F.lit(letter))
    return F.translate(t, "cfbuq2", "ethh9z")


def _words(text: Column) -> Column:
    return F.split(F.lower(text), _TOKEN_GAP)


def _is_word(word: Column) -> Column:
    """Something that may be a word: not a code, not a number, of a script with spaces.

    The tests are cheap ones, as every token of the corpus passes here; string
    comparison keeps scripts from U+0600 on out of the lexicon.
    """
    return (F.length(word) >= 3) & (word < "\u0600") & ~word.rlike("[0-9]{2}")


def _scanned() -> Column:
    return F.coalesce(F.col("source").isin(*SOURCES), F.lit(False))


def _targets(items: DataFrame) -> DataFrame:
    return items.where(_scanned() & F.col("type").isin(*TYPES) & F.col("value").isNotNull()).select("item_key", "parse_id", "page_index", "reading_order", "value")


def edge_lines(items: DataFrame, pages: DataFrame) -> DataFrame:
    """Lines of scanned values that hold the page's label or the parse's running text.

    Columns: item_key, line_no, is_label, is_running, is_misread.
    """
    labels = pages.groupBy("parse_id", "page_index").agg(F.lower(F.trim(F.max(F.coalesce("page_label", "page_number")))).alias("label"))
    texts = items.where(F.col("type").isin("header", "footer") & F.col("value").rlike(r"\p{L}")).select("parse_id", "page_index", F.lower(F.trim("value")).alias("exact"), confusable_form(F.col("value")).alias("form"))
    texts = texts.withColumn("short", ~F.col("exact").rlike(r"(?:\p{L}[^\p{L}]*){5}"))
    spellings = cut_lineage(texts.groupBy("parse_id", "form", "exact", "short", "page_index").agg(F.count(F.lit(1)).alias("n")))
    # a text of few letters is a running one only where two pages of the parse show it
    running = spellings.groupBy("parse_id", "form").agg(F.bool_or(~F.col("short")).alias("__long"), F.count_distinct("page_index").alias("__pages")).where("__long or __pages > 1").select("parse_id", "form", F.lit(True).alias("own"))
    # the usual spelling of each text over all parses; a parse may show its text only inside values
    anywhere = spellings.groupBy("form", "exact").agg(F.sum("n").alias("n"), F.count_distinct(F.when(~F.col("short"), F.col("parse_id"))).alias("parses")).groupBy("form").agg(F.max_by("exact", F.struct("n", "exact")).alias("usual"), F.sum("parses").alias("parses"))
    # lines much longer than any label and running text are wrapped text; a confusion at most doubles a letter
    longest = 2 * (spellings.agg(F.max(F.length("exact"))).first()[0] or 0) + 2 * (labels.agg(F.max(F.length("label"))).first()[0] or 0) + 40
    lines = _targets(items).join(labels, ["parse_id", "page_index"], "left").select("item_key", "parse_id", "label", F.posexplode(F.split("value", "\n")).alias("line_no", "line"))
    short = lines.withColumn("line", F.lower(F.trim("line"))).where((F.col("line") != "") & (F.length("line") <= longest))
    label, line = F.col("label"), F.col("line")
    head, tail = F.expr("substring(line, 1, length(line) - length(label))"), F.expr("substring(line, length(label) + 1)")
    gap_before, gap_after = head.rlike(r"(?:\s\s|\|\s*)$"), tail.rlike(r"^(?:\s\s|\s*\|)")
    beside = (
        F.when(F.endswith(line, label) & gap_before, F.regexp_replace(head, r"[\s|]+$", ""))
        .when(F.startswith(line, label) & gap_after, F.regexp_replace(tail, r"^[\s|]+", ""))
        .otherwise(F.lit(None))
    )
    # around a label stand one short word, brackets and space only: what else is as long as that cannot match
    bare = lambda c: F.length(F.translate(c, "[]()-–—| \t\x0b\f\r", ""))
    alone = F.coalesce(F.contains(line, label) & (bare(line) <= bare(label) + 6) & (label != "") & (F.regexp_extract(line, _LABEL_LINE, 1) == label), F.lit(False))
    seen = short.withColumns({"alone": alone, "beside": beside}).withColumn("body", F.coalesce("beside", "line"))
    form = F.when(~F.col("alone") & F.col("body").rlike(r"\p{L}.*\p{L}"), confusable_form(F.col("body")))
    # one pass over the lines: where the running texts are few, nothing but the lines' keys to their labels is shuffled
    met = seen.select("item_key", "parse_id", "line_no", "alone", "body", F.col("beside").isNotNull().alias("beside"), form.alias("form"))
    met = met.join(_small(cut_lineage(anywhere), "usual", 400), "form", "left").join(_small(cut_lineage(running), "form", 400), ["parse_id", "form"], "left")
    runs = F.coalesce(F.col("own") | (F.col("parses") > 1), F.lit(False))
    hits = met.where(F.col("alone") | runs)
    return hits.groupBy("item_key", "line_no").agg(F.max(F.col("alone") | F.col("beside")).alias("is_label"), F.max(runs).alias("is_running"), F.max(runs & (F.col("usual") != F.col("body"))).alias("is_misread"))


def _cleaned(items: DataFrame, edges: DataFrame) -> DataFrame:
    """Scanned values without their edge lines: the targets' columns and text."""
    drop = edges.groupBy("item_key").agg(F.collect_set("line_no").alias("__drop"))
    rows = _targets(items).join(drop, "item_key", "left")
    text = F.when(F.col("__drop").isNull(), F.col("value")).otherwise(F.expr("array_join(filter(split(value, '\n'), (x, i) -> not array_contains(__drop, i)), '\n')"))
    return rows.withColumn("text", text).drop("__drop")


def line_breaks(cleaned: DataFrame) -> DataFrame:
    """Words cut by a mark at a line end: item_key, left, mark, right, joined, compound, piece."""
    found = cleaned.where(F.col("text").rlike(_BROKEN)).select("item_key", F.explode(F.regexp_extract_all("text", F.lit(f"({_BREAK})"), F.lit(1))).alias("piece"))
    parts = [F.lower(F.regexp_extract("piece", _BREAK_PARTS, k)) for k in (1, 2, 3)]
    rows = found.select("item_key", "piece", parts[0].alias("left"), parts[1].alias("mark"), parts[2].alias("right"))
    return rows.withColumns({"joined": F.concat("left", "right"), "compound": F.concat_ws("-", "left", "right")})


def each_once(items: DataFrame) -> DataFrame:
    """The first delivery of each item.

    Only keys are shuffled to find the items that came several times; these are
    few, so their first times are broadcast if that is checked, and joined by
    shuffle otherwise. Without times, or where two deliveries have one time, rows
    are ranked instead.
    """
    if "loaded_at" in items.columns:
        several = cut_lineage(items.groupBy("item_key").agg(F.count(F.lit(1)).alias("__n"), F.min("loaded_at").alias("__first")).where("__n > 1").select("item_key", "__first"))
        several = F.broadcast(several) if several.count() <= BROADCAST_KEYS else several
        marked = items.join(several, "item_key", "left")
        if marked.where("__first is not null").groupBy("item_key", "loaded_at").count().where("count > 1 or loaded_at is null").isEmpty():
            return marked.where("__first is null or loaded_at = __first").drop("__first")
    first = F.row_number().over(Window.partitionBy("item_key").orderBy(*[c for c in ("loaded_at",) if c in items.columns], "value"))
    return items.withColumn("__first", first).where("__first = 1").drop("__first")


def counted_words(items: DataFrame) -> DataFrame:
    """word, trusted and seen of every word and, with its hyphens, every compound: one pass over the texts."""
    compounds = F.when(F.contains("value", F.lit("-")), F.regexp_extract_all(F.lower("value"), F.lit(_COMPOUND), F.lit(1))).otherwise(F.array().cast("array<string>"))
    rows = items.select((~_scanned()).cast("bigint").alias("t"), F.explode(F.concat(_words(F.col("value")), compounds)).alias("word"))
    return rows.where(_is_word(F.col("word"))).groupBy("word").agg(F.sum("t").alias("trusted"), F.count(F.lit(1)).alias("seen"))


def lexicon(counted: DataFrame, extra: DataFrame) -> DataFrame:
    """word, trusted and seen: occurrences in trusted sources, and in all.

    `extra` (column word) adds words joined across lines; they are in the lexicon
    with whatever counts their whole spelling has elsewhere.
    """
    none = F.lit(0).cast("bigint")
    every = counted.where(~F.contains("word", F.lit("-"))).unionByName(extra.where(_is_word(F.col("word"))).select("word", none.alias("trusted"), none.alias("seen")))
    words = every.groupBy("word").agg(F.sum("trusted").alias("trusted"), F.sum("seen").alias("seen"))
    return words.where(F.col("word").rlike(r"\p{L}") & ~F.col("word").rlike(r"\p{N}.*\p{N}.*\p{N}|[\u0600-\uFFFF]"))


def _explained(rare: DataFrame, frequent: DataFrame, confusions: tuple[tuple[str, str], ...]) -> DataFrame:
    """word, correction and often: every frequent word that one of the confusions leads to.

    The join key is the anagram hash: of a rare word, once for each confusion that
    it contains, moved by that confusion's difference. No pair of words meets
    unless it differs by exactly one known confusion.
    """
    table = F.array(*[F.struct(F.lit(wrong).alias("wrong"), F.lit(right).alias("right"), F.lit(_hash(right) - _hash(wrong)).cast("bigint").alias("difference")) for right, wrong in confusions])
    moved = rare.select("word", "seen", anagram_hash(F.col("word")).alias("h"), F.explode(F.filter(table, lambda c: F.contains(F.col("word"), c["wrong"]))).alias("c"))
    moved = moved.select("word", "seen", "c.wrong", "c.right", F.pmod(F.col("h") + F.col("c.difference"), F.lit(HASH_MODULUS)).alias("h"))
    targets = frequent.select(F.col("word").alias("correction"), F.col("seen").alias("often"), anagram_hash(F.col("word")).alias("h"))
    proof = F.expr("exists(sequence(1, length(word)), i -> substring(word, i, length(wrong)) = wrong and concat(substring(word, 1, i - 1), right, substring(word, i + length(wrong))) = correction)")
    return moved.join(targets, "h").where((F.col("often") >= MIN_RATIO * F.greatest(F.col("seen"), F.lit(1))) & proof).select("word", "correction", "often")


def _frequent(words: DataFrame) -> DataFrame:
    return words.where((F.col("seen") >= MIN_FREQUENT) & (F.col("trusted") > 0) & F.col("word").rlike(r"^[\p{L}\p{M}]+$"))


def corrections(words: DataFrame) -> DataFrame:
    """misread, correction and often: the most frequent of the words that explain a rare one."""
    met = _explained(words.where((F.col("trusted") * 10 <= F.col("seen"))), _frequent(words), CONFUSIONS)
    best = F.max_by("correction", F.struct("often", F.col("correction"))).alias("correction")
    return met.groupBy("word").agg(best, F.max("often").alias("often")).withColumnRenamed("word", "misread")


def weak_candidates(words: DataFrame, fixes: DataFrame) -> DataFrame:
    """misread, correction and often by the weak confusions, of words that trusted text never holds and no other confusion explains."""
    unheard = words.where("trusted = 0").join(fixes.select(F.col("misread").alias("word")), "word", "left_anti")
    return _explained(unheard, _frequent(words), WEAK_CONFUSIONS).distinct().withColumnRenamed("word", "misread")


def _small(df: DataFrame, word: str, chars: int = BROADCAST_CHARS) -> DataFrame:
    """`df` with a broadcast hint if its size is checked to be small."""
    size = df.agg(F.count(F.lit(1)).alias("n"), F.max(F.length(word)).alias("longest")).first()
    return F.broadcast(df) if size["n"] <= BROADCAST_ROWS and (size["longest"] or 0) <= chars else df


def _beside(words: Column, at: Column) -> Column:
    """The neighbours of a word, as an array of (side, near)."""
    near = lambda side, i: F.struct(F.lit(side).alias("side"), F.get(words, i).alias("near"))
    return F.array(F.when(at > 0, near("l", at - 1)), near("r", at + 1))


def supported(placed: DataFrame, candidates: DataFrame) -> DataFrame:
    """item_key, misread and correction of the occurrences whose correction has a neighbour's support.

    `placed` (item_key, word, side, near) are the neighbours, in scanned text, of the
    candidates' rare and frequent words. A candidate is believed where its frequent
    word stands beside the same left or right neighbour elsewhere.
    """
    asked = placed.join(_small(candidates, "misread").withColumnRenamed("misread", "word"), "word").select("item_key", F.col("word").alias("misread"), "correction", "often", "side", "near")
    known = placed.select(F.col("word").alias("correction"), "side", "near").distinct()
    met = asked.join(known, ["correction", "side", "near"], "left_semi")
    return met.groupBy("item_key", "misread").agg(F.max_by("correction", F.struct("often", "correction")).alias("correction"))


def judge_breaks(breaks: DataFrame, words: DataFrame, fixes: DataFrame, counted: DataFrame) -> DataFrame:
    """`breaks` with is_hyphen: the mark is not part of the word's spelling.

    Soft hyphens and the not sign never are. A hyphen is one where the joined
    spelling occurs more often than the hyphenated one; with neither known, where
    the joined word is a known misreading or a part is no word of its own.
    """
    compounds = counted.where(F.contains("word", F.lit("-"))).select(F.col("word").alias("compound"), F.col("seen").alias("hyphenated"))
    known = words.where("trusted > 0").select("word", "trusted")
    asked = breaks.select("left", "right", "joined", "compound").distinct()
    judged = (
        asked.join(words.select(F.col("word").alias("joined"), F.col("seen").alias("whole")), "joined", "left")
        .join(compounds, "compound", "left")
        .join(fixes.select(F.col("misread").alias("joined"), F.lit(True).alias("fixable")), "joined", "left")
        .join(known.select(F.col("word").alias("left"), F.lit(True).alias("left_known")), "left", "left")
        .join(known.select(F.col("word").alias("right"), F.lit(True).alias("right_known")), "right", "left")
    )
    whole, hyphenated = F.coalesce("whole", F.lit(0)), F.coalesce("hyphenated", F.lit(0))
    code = F.col("joined").rlike(r"\p{N}.*\p{N}")
    unknown = F.coalesce("fixable", F.lit(False)) | ~(F.coalesce("left_known", F.lit(False)) & F.coalesce("right_known", F.lit(False)))
    is_word = F.when(whole > hyphenated, True).when(hyphenated > 0, False).when(code, False).otherwise(unknown)
    verdicts = judged.select("left", "right", "joined", "compound", is_word.alias("__word"))
    soft = F.col("mark").isin("¬", "­")
    return breaks.join(verdicts, ["left", "right", "joined", "compound"]).withColumn("is_hyphen", soft | F.col("__word")).drop("__word")


class ScanNoise:
    """The parts of the repair, each a DataFrame over all items.

    Of each item the first delivery counts. Edge lines, line breaks, the lexicon and the corrections are small
    against the text and used several times: each is computed once and
    checkpointed, instead of planned again in every branch.
    """

    def __init__(self, items: DataFrame, pages: DataFrame) -> None:
        keep = [c for c in ("item_key", "parse_id", "page_index", "type", "source", "reading_order", "value", "loaded_at") if c in items.columns]
        self.items = each_once(items.select(*keep).where(F.col("value").isNotNull()))
        self.edges = cut_lineage(edge_lines(self.items, pages))
        self.cleaned = _cleaned(self.items, self.edges)
        self.breaks = cut_lineage(line_breaks(self.cleaned))
        counted = cut_lineage(counted_words(self.items))
        self.words = cut_lineage(lexicon(counted, self.breaks.select(F.col("joined").alias("word"))))
        self.fixes = cut_lineage(corrections(self.words))
        self.judged = judge_breaks(self.breaks, self.words, self.fixes, counted)

    def misread_words(self) -> DataFrame:
        """item_key, misread, correction of every misread word, cut words included."""
        whole = F.when(F.col("text").rlike(_BROKEN), F.regexp_replace("text", _BREAK, " ")).otherwise(F.col("text"))
        weak = cut_lineage(weak_candidates(self.words, self.fixes))
        either = weak.select("misread").unionByName(weak.select(F.col("correction").alias("misread"))).distinct()
        listed = self.fixes.select("misread", F.lit(False).alias("weak")).unionByName(either.withColumn("weak", F.lit(True)))
        listed = _small(cut_lineage(listed), "misread")
        inner = self.cleaned.select("item_key", _words(whole).alias("words")).select("item_key", "words", F.posexplode("words").alias("at", "misread")).join(listed, "misread")
        hits = cut_lineage(inner.select("item_key", "misread", "weak", F.when(F.col("weak"), _beside(F.col("words"), F.col("at"))).alias("beside")))
        cut = self.judged.select("item_key", F.explode(F.when(F.col("is_hyphen"), F.array("joined")).otherwise(F.split("compound", "-"))).alias("misread"))
        certain = hits.where("not weak").select("item_key", "misread").unionByName(cut).join(_small(self.fixes, "misread"), "misread").select("item_key", "misread", "correction").distinct()
        placed = hits.where("weak").select("item_key", F.col("misread").alias("word"), F.explode("beside").alias("n")).select("item_key", "word", "n.side", "n.near").where("near <> ''")
        return certain.unionByName(supported(placed, weak))

    def defects(self) -> DataFrame:
        """item_key and defect: hyphen, misread, running or page_no; each once."""
        flags = self.edges.select("item_key", F.explode(F.array_compact(F.array(F.when(F.col("is_label"), "page_no"), F.when(F.col("is_running"), "running"), F.when(F.col("is_misread"), "misread")))).alias("defect"))
        hyphens = self.judged.where("is_hyphen").select("item_key", F.lit("hyphen").alias("defect"))
        misread = self.misread_words().select("item_key", F.lit("misread").alias("defect"))
        return flags.unionByName(hyphens).unionByName(misread).distinct()

    def repaired(self) -> DataFrame:
        """One row per scanned item: item_key, parse_id, page_index, reading_order, repaired."""
        fixes = self.misread_words().groupBy("item_key").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("misread", "correction")))).alias("fixes"))
        joins = self.judged.groupBy("item_key").agg(F.array_sort(F.collect_set(F.struct("piece", "is_hyphen"))).alias("joins"))
        full = self.cleaned.join(fixes, "item_key", "left").join(joins, "item_key", "left")
        return full.select("item_key", "parse_id", "page_index", "reading_order", rewrite("text", "fixes", "joins").alias("repaired"))


_WORD = re.compile(r"[^\W_]+(?:[@|$][^\W_]*)*|[@|$][^\W_]+")
_WRAP = re.compile(r"[ \t]*\n(?!\s*(?:[•*\-–]\s|\d+[.)]\s))[ \t]*")


def _like(word: str, correction: str) -> str:
    """The correction in the case of the word it replaces."""
    letters = [c for c in word if c.isalpha()]
    if len(letters) > 1 and all(c.isupper() for c in letters):
        return correction.upper()
    return correction[:1].upper() + correction[1:] if word[:1].isupper() or not word[:1].isalpha() and letters[:1] and letters[0].isupper() else correction


def rewrite_text(text: str | None, fixes: dict[str, str] | None, joins: list[dict] | None) -> str | None:
    if text is None:
        return None
    for j in joins if joins is not None else ():
        left, _, right = j["piece"].partition("\n")
        left = left.rstrip()
        text = text.replace(j["piece"], (left[:-1] if j["is_hyphen"] else left) + right.lstrip())
    known = dict(fixes) if fixes is not None else {}
    if known:
        text = _WORD.sub(lambda m: _like(m.group(), known[m.group().lower()]) if m.group().lower() in known else m.group(), text)
    return _WRAP.sub(" ", text)


@F.pandas_udf(T.StringType())
def rewrite(text: pd.Series, fixes: pd.Series, joins: pd.Series) -> pd.Series:
    return pd.Series([rewrite_text(*r) for r in zip(text, fixes, joins, strict=True)], dtype=object)


def paragraphs(repaired: DataFrame, most_rounds: int = 40) -> DataFrame:
    """Paragraphs that run on over page ends put together: item_key (of the first part), parts, paragraph.

    The last scanned item of a page continues in the first of the next page if it
    does not end a sentence and the next does not begin one in capitals or with a
    bullet. Chains are followed by pointer doubling until no pointer moves;
    one over more than 2 ** most_rounds pages is an error. Only the two border items
    of each page take part.
    """
    repaired = cut_lineage(repaired)  # read twice: for the borders and for the parts
    border = repaired.groupBy("parse_id", "page_index").agg(F.min_by(F.struct("item_key", "repaired"), F.struct("reading_order", "item_key")).alias("first"), F.max_by(F.struct("item_key", "repaired"), F.struct("reading_order", "item_key")).alias("last"))
    after = border.select("parse_id", (F.col("page_index") - 1).alias("page_index"), F.col("first").alias("next"))
    runs_on = ~F.rtrim(F.col("last.repaired")).rlike(r"[.!?。:;)\]]$") & (F.col("last.repaired") != "") & ~F.col("next.repaired").rlike(r"^\s*(?:[•*–-]|\d+[.)])\s")
    links = border.join(after, ["parse_id", "page_index"]).where(runs_on & (F.col("last.item_key") != F.col("next.item_key"))).select(F.col("next.item_key").alias("item_key"), F.col("last.item_key").alias("root"), F.lit(1).alias("depth"))
    up = cut_lineage(links)
    for done in range(most_rounds + 1):
        # each round would otherwise hold the plan of the last twice
        if up.join(up.select(F.col("item_key").alias("root")), "root", "left_semi").isEmpty():
            break
        if done == most_rounds:
            raise RuntimeError("the paragraphs did not settle; raise most_rounds")
        parent = up.select(F.col("item_key").alias("root"), F.col("root").alias("__root"), F.col("depth").alias("__depth"))
        up = cut_lineage(up.join(parent, "root", "left").select("item_key", F.coalesce("__root", "root").alias("root"), (F.col("depth") + F.coalesce("__depth", F.lit(0))).alias("depth")))
    parts = repaired.join(up, "item_key", "left").select(F.coalesce("root", "item_key").alias("item_key"), F.coalesce("depth", F.lit(0)).alias("depth"), "parse_id", "repaired")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("depth", "repaired"))), lambda p: p["repaired"]), " ")
    return parts.groupBy("item_key").agg(F.min("parse_id").alias("parse_id"), F.count(F.lit(1)).alias("parts"), text.alias("paragraph"))
