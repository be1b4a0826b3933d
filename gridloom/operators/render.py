"""Sheet rows: per-region, stacked and plain layouts of a document.

A sheet row: doc_id, sheet_idx, row_no (from 1 within its sheet), kind (row, title, separator), is_header, page_no,
entry, values. Cells are those of headers.py, region_id being the sheet under the per-region policy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .headers import ROW, header_block_signature, plain_header_signature


def row_values(cells: DataFrame) -> DataFrame:
    """One row a row: values up to its last column, blanks empty; texts in cell order."""
    held = cells.groupBy(*ROW, "is_header").agg(F.sort_array(F.collect_list(F.struct("col_idx", "text"))).alias("c"))
    m = F.map_from_entries("c")
    dense = F.transform(F.sequence(F.lit(0), F.array_max(F.map_keys("m"))), lambda i: F.coalesce(F.element_at("m", i), F.lit("")))
    return held.withColumn("m", m).select(*ROW, "is_header", dense.alias("values"), F.transform("c", lambda x: x["text"]).alias("texts"))


def _numbered(rows: DataFrame, keys: list[str], order: list, condition: Column, name: str) -> DataFrame:
    """A running count by document where `condition` holds: page offsets first, then within pages."""
    own = rows.groupBy(*keys, "page").agg(F.count_if(condition).alias("_n"))
    offset = own.withColumn("_o", F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("page").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    line = Window.partitionBy(*keys, "page").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_i", F.sum(F.when(condition, 1).otherwise(0)).over(line)).join(offset, [*keys, "page"]).withColumn(name, (F.col("_o") + F.col("_i")).cast("long")).drop("_o", "_i")


ORDER = ["kind_rank", "region_id", "row_idx"]


def _finish(rows: DataFrame, sheet: Column) -> DataFrame:
    out = rows.withColumn("sheet_idx", sheet.cast("int"))
    out = _numbered(out, ["doc_id"], ORDER, (F.col("kind") == "row") & ~F.col("is_header"), "_entry")
    out = _numbered(out, ["doc_id", "sheet_idx"], ORDER, F.lit(True), "row_no")
    entry = F.when(F.col("kind") != "row", None).when(F.col("is_header"), "#").otherwise(F.col("_entry").cast("string"))
    page_no = F.when(F.col("kind") != "separator", F.col("page") + 1)
    return out.select("doc_id", "sheet_idx", "row_no", "kind", "is_header", page_no.cast("int").alias("page_no"), entry.alias("entry"), "values")


def _titles(titles: DataFrame | None, like: DataFrame) -> DataFrame:
    t = like.limit(0) if titles is None else titles.select("doc_id", "page", F.lit(0).alias("region_id"), F.col("rank").alias("row_idx"), F.lit(False).alias("is_header"), F.array("text").alias("values"), F.lit("title").alias("kind"), F.lit(0).alias("kind_rank"))
    return t.select(*like.columns)


def stacked(cells: DataFrame, regions: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """One sheet: titles of a page, then its regions, with an empty row before every region but the document's first.

    regions: doc_id, page, region_id of all regions, also of those left without rows.
    """
    rows = row_values(cells).select(*ROW, "is_header", "values", F.lit("row").alias("kind"), F.lit(1).alias("kind_rank"))
    first = regions.groupBy("doc_id").agg(F.min(F.struct("page", "region_id")).alias("f"))
    sep = regions.select("doc_id", "page", "region_id").distinct().join(first, "doc_id").where(F.struct("page", "region_id") != F.col("f"))
    sep = sep.select("doc_id", "page", "region_id", F.lit(-1).alias("row_idx"), F.lit(False).alias("is_header"), F.array().cast("array<string>").alias("values"), F.lit("separator").alias("kind"), F.lit(1).alias("kind_rank"))
    return _finish(rows.unionByName(sep).unionByName(_titles(titles, rows)), F.lit(0))


def per_region(cells: DataFrame, titles: DataFrame | None = None, keep_repeated: bool = False) -> DataFrame:
    """A sheet for each region id; titles go to the first. On a sheet, header blocks and header rows seen before go."""
    rows = row_values(cells)
    if not keep_repeated:
        sheet = Window.partitionBy("doc_id", "region_id")
        block = header_block_signature(cells).withColumn("again", (F.col("header_sig") != "") & (F.row_number().over(Window.partitionBy("doc_id", "region_id", "header_sig").orderBy("page")) > 1))
        rows = rows.join(block.select("doc_id", "page", "region_id", "again"), ["doc_id", "page", "region_id"], "left").where(~F.col("is_header") | ~F.coalesce("again", F.lit(False)))
        rows = rows.withColumn("sig", plain_header_signature(F.col("texts")))
        seen = F.row_number().over(Window.partitionBy("doc_id", "region_id", "is_header", "sig").orderBy("page", "row_idx"))
        heads = rows.where("is_header").withColumn("again", seen > 1).where("NOT again")
        rows = rows.where("NOT is_header").unionByName(heads.select(*rows.columns))
        del sheet
    rows = rows.select(*ROW, "is_header", "values", F.lit("row").alias("kind"), F.lit(1).alias("kind_rank"))
    return _finish(rows.unionByName(_titles(titles, rows)), F.when(F.col("kind") == "title", 0).otherwise(F.col("region_id")))


def plain(pages: DataFrame, include_page: bool = False) -> DataFrame:
    """Rows of pages (doc_id, page, rows array<array<string>>) as they are; no policy, no header rules, no entry column."""
    out = pages.select("doc_id", "page", F.posexplode("rows").alias("row_idx", "values")).withColumn("kind", F.lit("row")).withColumn("is_header", F.lit(False)).withColumn("region_id", F.lit(0)).withColumn("kind_rank", F.lit(1))
    out = _finish(out, F.lit(0)).withColumn("entry", F.lit(None).cast("string"))
    return out if include_page else out.withColumn("page_no", F.lit(None).cast("int"))


def page_rows_layout(pages: DataFrame) -> DataFrame:
    """Cells of plain pages as one region each whose first row is its header."""
    rows = pages.select("doc_id", "page", F.lit(0).alias("region_id"), F.posexplode("rows").alias("row_idx", "v"))
    return rows.select("doc_id", "page", "region_id", "row_idx", (F.col("row_idx") == 0).alias("is_header"), F.posexplode("v").alias("col_idx", "text"))


def full_values(include_page: bool, include_entry: bool) -> Column:
    """What a sheet row writes: page and entry in front of the values; titles have no entry, separators nothing."""
    page = F.when(F.col("kind") != "separator", F.array(F.col("page_no").cast("string"))).otherwise(F.array().cast("array<string>"))
    entry = F.when(F.col("kind") == "row", F.array("entry")).otherwise(F.array().cast("array<string>"))
    return F.concat(*([page] if include_page else []), *([entry] if include_entry else []), F.col("values"))


def cells_per_row(sheet_rows: DataFrame) -> DataFrame:
    """(doc_id, filled, rows): how many rows have so many non-empty cells."""
    return sheet_rows.where("kind = 'row'").groupBy("doc_id", F.size(F.filter("values", lambda v: v != "")).alias("filled")).agg(F.count("*").alias("rows"))
