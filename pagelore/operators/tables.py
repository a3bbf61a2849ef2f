"""Table grids: slots, spans, rows, gates, continuation over pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def distinct_cells(cells: DataFrame) -> DataFrame:
    """Each cell once; of repeated cells at one place the greatest text stays."""
    return cells.groupBy("item_key", "row_no", "col_no").agg(F.max(F.struct("text", "row_span", "col_span", "column_header", "row_header")).alias("c")).select("item_key", "row_no", "col_no", "c.*")


def span_slots(cells: DataFrame) -> DataFrame:
    """Every slot that a cell fills: its anchor (or explicit blank), and those it covers by spanning."""
    rows = F.sequence(F.col("row_no"), F.col("row_no") + F.greatest(F.coalesce("row_span", F.lit(1)), F.lit(1)) - 1)
    cols = F.sequence(F.col("col_no"), F.col("col_no") + F.greatest(F.coalesce("col_span", F.lit(1)), F.lit(1)) - 1)
    slots = cells.withColumn("slot_row", F.explode(rows)).withColumn("slot_col", F.explode(cols))
    anchor = (F.col("slot_row") == F.col("row_no")) & (F.col("slot_col") == F.col("col_no"))
    blank = F.coalesce(F.trim("text"), F.lit("")) == ""
    kind = F.when(~anchor, "covered").when(blank, "explicit_blank").otherwise("anchor")
    return slots.select("item_key", "slot_row", "slot_col", kind.alias("kind"))


def grid_rows(cells: DataFrame) -> DataFrame:
    """One row per table row: its cells' texts in column order, nulls as ''."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("col_no", F.coalesce("text", F.lit("")).alias("text")))), lambda c: c["text"])
    header = F.bool_and(F.coalesce("column_header", F.lit(False)))
    return cells.groupBy("item_key", "row_no").agg(ordered.alias("texts"), header.alias("header"))


def dense_grids(rows: DataFrame) -> DataFrame:
    """One row per table: rows as an array of arrays, header depth, rectangular or not."""
    g = rows.groupBy("item_key").agg(F.array_sort(F.collect_list(F.struct("row_no", "texts", "header"))).alias("r"))
    widths = F.array_distinct(F.transform("r", lambda x: F.size(x["texts"])))
    return g.select("item_key", F.transform("r", lambda x: x["texts"]).alias("rows"), F.size(F.filter("r", lambda x: x["header"])).alias("header_rows"), (F.size(widths) == 1).alias("rectangular"))


def table_gate(grids: DataFrame) -> DataFrame:
    """What a candidate is: the first of the ladder's rungs that holds."""
    n = F.size("rows")
    width = F.size(F.get("rows", F.lit(0)))
    filled = F.size(F.filter(F.flatten("rows"), lambda t: F.trim(t) != ""))
    total = F.size(F.flatten("rows"))
    outcome = (
        F.when(filled == 0, "structural_failure")
        .when(~F.col("rectangular"), "unresolved")
        .when((n < 2) | (width < 2), F.when((width == 2) | (n == 1), "key_value").otherwise("unresolved"))
        .when(filled < 0.25 * total, "form")
        .otherwise("canonical_table")
    )
    return grids.withColumn("outcome", outcome)


def pipe_table(rows: Column) -> Column:
    """Markdown of a dense grid: the first row is the header; pipes and line ends are escaped."""
    clean = lambda t: F.regexp_replace(F.replace(t, F.lit("|"), F.lit("\\|")), r"\s*\n\s*", "<br>")
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, clean), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.transform(F.get(rows, F.lit(0)), lambda _: F.lit("---")), " | "), F.lit(" |"))
    body = F.transform(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(1))), line)
    return F.when(F.size(rows) > 0, F.array_join(F.concat(F.array(line(F.get(rows, F.lit(0))), rule), F.when(F.size(rows) > 1, body).otherwise(F.array().cast("array<string>"))), "\n"))


def html_table(rows: Column, header_rows: Column) -> Column:
    from pagelore.functions.scalars import escape_html

    def line(r: Column, i: Column) -> Column:
        tag = F.when(i < header_rows, "th").otherwise("td")
        return F.concat(F.lit("<tr>"), F.array_join(F.transform(r, lambda t: F.concat(F.lit("<"), tag, F.lit(">"), escape_html(t), F.lit("</"), tag, F.lit(">"))), ""), F.lit("</tr>"))

    return F.concat(F.lit("<table>"), F.array_join(F.transform(rows, line), ""), F.lit("</table>"))


def continued_tables(tables: DataFrame) -> DataFrame:
    """Pairs of tables on neighbouring pages where the second goes on the first.

    `tables` has item_key, parse_id, page_index, rows, outcome, left, width, first
    and last (place on its page). Both must be canonical and two of four signals
    agree: equal column number and edges, equal header row, last and first item of
    their pages, equal number of columns as the header. Result: the pair, the
    signals and the joined rows, without the second's repeated header.
    """
    gated = tables.where("outcome = 'canonical_table'")
    a = gated.select("parse_id", F.col("page_index"), F.col("item_key").alias("first_key"), F.col("rows").alias("a"), F.col("left").alias("al"), F.col("width").alias("aw"), F.col("last").alias("a_last"))
    b = gated.select("parse_id", (F.col("page_index") - 1).alias("page_index"), F.col("item_key").alias("next_key"), F.col("rows").alias("b"), F.col("left").alias("bl"), F.col("width").alias("bw"), F.col("first").alias("b_first"))
    one = lambda c: F.when(F.coalesce(c, F.lit(False)), 1).otherwise(0)
    head_a, head_b = F.get("a", F.lit(0)), F.get("b", F.lit(0))
    same_head = head_a == head_b
    signals = one((F.abs(F.col("al") - F.col("bl")) <= 2.0) & (F.abs(F.col("aw") - F.col("bw")) <= 2.0)) + one(same_head) + one(F.col("a_last") & F.col("b_first")) + one(F.size(head_a) == F.size(head_b))
    pairs = a.join(b, ["parse_id", "page_index"]).withColumn("signals", signals).where("signals >= 2")
    rest = F.when(same_head, F.slice("b", 2, F.greatest(F.size("b") - 1, F.lit(1)))).otherwise(F.col("b"))
    rest = F.when(same_head & (F.size("b") == 1), F.array().cast("array<array<string>>")).otherwise(rest)
    return pairs.select("first_key", "next_key", "signals", F.concat("a", rest).alias("rows"))


def running_columns(cells: DataFrame) -> DataFrame:
    """Column of each cell as the running sum of the spans before it in its row."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("item_key", "row_no").orderBy("col_no")
    span = F.greatest(F.coalesce("col_span", F.lit(1)), F.lit(1))
    return cells.select("item_key", "row_no", "col_no", (F.sum(span).over(w) - span).cast("int").alias("grid_column"))
