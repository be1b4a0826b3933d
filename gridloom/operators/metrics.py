"""Evaluation: token coverage, grids, text reconstruction, run summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.exprs import normalize, ratio, tokens, trim
from .layout import PAGE


def token_multiset(df: DataFrame, text: str, keys: list[str] | None = None) -> DataFrame:
    """(keys, token, n)."""
    return df.select(*(keys or []), F.explode(tokens(F.col(text))).alias("token")).groupBy(*(keys or []), "token").agg(F.count("*").alias("n"))


def coverage(reference: DataFrame, output: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, matched, reference, output, recall, precision, f1) of two token multisets."""
    on = [*(keys or []), "token"]
    both = reference.withColumnRenamed("n", "a").join(output.withColumnRenamed("n", "b"), on, "full_outer")
    s = both.groupBy(*(keys or [])).agg(F.sum(F.least(F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0)))).alias("matched"), F.coalesce(F.sum("a"), F.lit(0)).alias("reference"), F.coalesce(F.sum("b"), F.lit(0)).alias("output"))
    s = s.withColumn("recall", ratio(F.col("matched"), F.col("reference"))).withColumn("precision", ratio(F.col("matched"), F.col("output")))
    return s.withColumn("f1", ratio(2 * F.col("recall") * F.col("precision"), F.col("recall") + F.col("precision")))


def reconstruct_text(items: DataFrame) -> DataFrame:
    """(doc_id, page, text): items in stream order, a line break where y moves by over half a height, a blank where x leaves over a fifth.

    The height is the larger of an item's and the one before's, none or 0 counting as 1.
    """
    line = Window.partitionBy(*PAGE).orderBy("seq")
    prev = lambda c: F.lag(c).over(line)
    items = items.withColumn("_h", F.coalesce(F.nullif("height", F.lit(0.0)), F.lit(1.0)))
    high = F.greatest("_h", prev("_h"))
    gap = F.col("x") - (prev("x") + F.coalesce(prev("width"), F.lit(0.0)))
    glue = F.when(prev("seq").isNull(), "").when(F.abs(F.col("y") - prev("y")) > 0.5 * high, "\n").when(gap > 0.2 * high, " ").otherwise("")
    parts = items.select(*PAGE, "seq", F.concat(glue, F.col("text")).alias("t"))
    return parts.groupBy(*PAGE).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "t"))), lambda x: x["t"]), "").alias("text"))


def trim_grid(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Non-blank cells (keys, row_idx, col_idx, text) with rows counted from the first that has one, normalised."""
    filled = cells.withColumn("text", trim(F.col("text"))).where("text != ''")
    return filled.withColumn("row_idx", (F.col("row_idx") - F.min("row_idx").over(Window.partitionBy(*keys))).cast("int"))


def compare_grids(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, cells, different, exact) over both grids (keys, row_idx, col_idx, text)."""
    on = [*keys, "row_idx", "col_idx"]
    both = a.select(*on, normalize(F.col("text")).alias("ta")).join(b.select(*on, normalize(F.col("text")).alias("tb")), on, "full_outer")
    out = both.groupBy(*keys).agg(F.count("*").alias("cells"), F.count_if(~F.col("ta").eqNullSafe(F.col("tb"))).alias("different"))
    return out.withColumn("exact", F.col("different") == 0)


def run_summary(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """(keys, n, least, most, mean, median, stdev): the median of an even count is the middle of two, the deviation that of the population."""
    return df.groupBy(*keys).agg(F.count(value).alias("n"), F.min(value).alias("least"), F.max(value).alias("most"), F.avg(value).alias("mean"), F.median(value).alias("median"), F.stddev_pop(value).alias("stdev"))


def workbook_stats(sheet_rows: DataFrame) -> DataFrame:
    """(doc_id, sheets, rows, max_columns, filled_cells, filled_rows)."""
    filled = F.size(F.filter("values", lambda v: v != ""))
    return sheet_rows.groupBy("doc_id").agg(F.count_distinct("sheet_idx").alias("sheets"), F.count("*").alias("rows"), F.max(F.size("values")).alias("max_columns"), F.sum(filled).cast("long").alias("filled_cells"), F.count_if(filled > 0).alias("filled_rows"))


def content_gate(baseline: DataFrame, candidate: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, expected, missing, accepted): a candidate (keys, text) is taken only if it has every word of the baseline as often."""
    a, b = token_multiset(baseline, "text", keys), token_multiset(candidate, "text", keys).withColumnRenamed("n", "m")
    short = F.greatest(F.col("n") - F.coalesce("m", F.lit(0)), F.lit(0))
    out = a.join(b, [*keys, "token"], "left").groupBy(*keys).agg(F.sum("n").alias("expected"), F.sum(short).alias("missing"))
    return out.withColumn("accepted", F.col("missing") == 0)
