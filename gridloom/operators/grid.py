"""Regions to cells: rows, columns, cells, header rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.exprs import non_numeric, numeric, trim
from ..functions.storage import materialize
from ..functions.folds import cluster_rows, fold_groups, start_clusters
from .layout import PAGE, REGION, discover_regions, item_bbox

#: Header spans this close are one column.
TOUCH = 3


def rows(regions: DataFrame) -> DataFrame:
    """Items with row_idx and row_y (the running mean at the row's end)."""
    return fold_groups(regions, PAGE, REGION, ["top_y", "x", "seq"], ["top_y", "height"], cluster_rows, {"row_idx": "int", "row_y": "double"})


def column_bounds(rows: DataFrame) -> DataFrame:
    """(doc_id, page, region_idx, bounds): midpoints between the merged spans of the leading rows without numbers; at least one."""
    region = Window.partitionBy(*REGION)
    number = F.when(~non_numeric(F.col("text")), F.col("row_idx"))
    head = rows.withColumn("_stop", F.min(number).over(region)).where(F.col("_stop").isNull() | (F.col("row_idx") < F.col("_stop")))
    line = region.orderBy("x", F.col("x") + F.col("width"), "seq")
    reach = F.max(F.col("x") + F.col("width")).over(line.rowsBetween(Window.unboundedPreceding, -1))
    head = head.withColumn("_new", F.when(reach.isNull() | (F.col("x") > reach + TOUCH), 1).otherwise(0))
    head = head.withColumn("_span", F.sum("_new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    spans = head.groupBy(*REGION, "_span").agg(F.min("x").alias("l"), F.max(F.col("x") + F.col("width")).alias("r"))
    mid = (F.col("r") + F.lead("l").over(region.orderBy("l"))) / 2
    return spans.withColumn("_mid", mid).where(F.col("_mid").isNotNull()).groupBy(*REGION).agg(F.sort_array(F.collect_list("_mid")).alias("bounds"))


def fallback_starts(rows: DataFrame) -> DataFrame:
    """Items with starts: running means of clustered left edges of the region."""
    return fold_groups(rows, PAGE, REGION, ["x", "top_y", "seq"], ["x", "row_idx"], start_clusters, {"starts": "array<double>"})


def assign_columns(rows: DataFrame) -> DataFrame:
    """Items with col_idx and confidence: by header ranges (0.9), or by the fallback starts (0.7)."""
    ranged = rows.join(column_bounds(rows), REGION, "left")
    centre = F.col("x") + F.col("width") / 2
    by_range = ranged.where(F.col("bounds").isNotNull()).withColumn("col_idx", F.size(F.filter("bounds", lambda b: b <= centre))).withColumn("confidence", F.lit(0.9)).drop("bounds")
    rest = fallback_starts(ranged.where(F.col("bounds").isNull()).drop("bounds"))
    return by_range.unionByName(assign_by_starts(rest).withColumn("confidence", F.lit(0.7)).drop("starts"))


def assign_by_starts(items: DataFrame) -> DataFrame:
    """col_idx by the midpoints of neighbouring starts; up to the first start 0, from the last on the last."""
    mids = F.transform(F.sequence(F.lit(1), F.size("starts") - 1), lambda i: (F.element_at("starts", i) + F.element_at("starts", i + 1)) / 2)
    inner = F.when(F.size("starts") > 1, F.size(F.filter(mids, lambda m: m <= F.col("x")))).otherwise(0)
    return items.withColumn("col_idx", F.when(F.col("x") <= F.element_at("starts", 1), 0).when(F.col("x") >= F.element_at("starts", -1), F.size("starts") - 1).otherwise(inner))


def cells(items: DataFrame) -> DataFrame:
    """One row a cell: the texts of a row and column as they are, joined by single blanks and trimmed as a whole; the union of the boxes."""
    b = item_bbox()
    part = F.struct("x", "top_y", "seq", F.col("text").alias("t"))
    out = items.withColumn("b", b).groupBy(*REGION, "row_idx", "col_idx").agg(
        F.sort_array(F.collect_list(part)).alias("parts"), F.min("b.x1").alias("x1"), F.min("b.y1").alias("y1"), F.max("b.x2").alias("x2"), F.max("b.y2").alias("y2"), F.max("confidence").alias("confidence"))
    return out.withColumn("text", trim(F.array_join(F.transform("parts", lambda p: p["t"]), " "))).drop("parts")


def header_rows(cells: DataFrame) -> DataFrame:
    """(doc_id, page, region_idx, row_idx, is_header): the first row if it has no numbers, and up to two more that look like it."""
    by_row = cells.groupBy(*REGION, "row_idx").agg(F.count("*").alias("n"), F.bool_and(non_numeric(F.col("text"))).alias("words"), F.max(numeric(F.col("text")).cast("int")).alias("num"))
    region = Window.partitionBy(*REGION)
    line = region.orderBy("row_idx")
    by_row = by_row.withColumn("rows", F.count("*").over(region)).withColumn("ahead", F.coalesce(F.max("num").over(line.rowsBetween(1, 4)), F.lit(0)))
    by_row = by_row.withColumn("n0", F.first("n").over(line)).withColumn("w0", F.first("words").over(line))
    more = F.col("w0") & (F.col("row_idx") < F.least(F.col("rows") - 1, F.lit(3))) & F.col("words") & ((F.col("ahead") == 1) | (F.col("n") < F.col("n0")))
    ok = F.when(F.col("row_idx") == 0, F.col("w0")).otherwise(more)
    stop = F.min(F.when(~ok, F.col("row_idx"))).over(region)
    return by_row.withColumn("_stop", stop).select(*REGION, "row_idx", (F.col("_stop").isNull() | (F.col("row_idx") < F.col("_stop"))).alias("is_header"))


def region_rows(items: DataFrame) -> DataFrame:
    """Items of positioned text with region_idx and row_idx."""
    return materialize(rows(discover_regions(items)))


def tables(placed: DataFrame) -> DataFrame:
    """Cells of all regions with is_header: the rest of the path from `region_rows`."""
    c = materialize(cells(assign_columns(placed)))
    return materialize(c.join(header_rows(c), [*REGION, "row_idx"]))


def expected_columns(placed: DataFrame) -> DataFrame:
    """(doc_id, page, region_idx, expected): the larger of a region's own column ranges and what the regions up to it make the document expect."""
    own = column_bounds(placed).select(*REGION, (F.size("bounds") + 1).alias("n"))
    own = placed.select(*REGION).distinct().join(own, REGION, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    seen = own.withColumn("ord", F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "region_idx")))
    return seen.join(column_counts_model(seen), ["doc_id", "ord"]).select(*REGION, F.greatest("n", "expected").alias("expected"))


def column_counts_model(observed: DataFrame) -> DataFrame:
    """(doc_id, ord, n) to expected: the mode of the counts so far (2 or more), the wider on ties, 0 before three observations.

    Counts only grow, so the running maximum of (times this count has been seen, count) is the mode.
    """
    own = Window.partitionBy("doc_id", "n").orderBy("ord")
    so_far = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    vote = F.when(F.col("n") >= 2, F.struct(F.row_number().over(own).alias("c"), F.col("n").alias("n")))
    out = observed.withColumn("_v", vote)
    out = out.withColumn("_seen", F.count("_v").over(so_far)).withColumn("_best", F.max("_v").over(so_far))
    return out.select("doc_id", "ord", F.when(F.col("_seen") >= 3, F.col("_best")["n"]).otherwise(0).cast("int").alias("expected"))
