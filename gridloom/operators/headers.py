"""Header rows of regions and documents: joining lines, signatures, removal of repeats, numbering.

Cells: doc_id, page, region_id, row_idx, is_header, col_idx, text. Document order is (page, region_id, row_idx).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.exprs import normalize, trim

REGION = ["doc_id", "page", "region_id"]
ROW = [*REGION, "row_idx"]


def leading_headers(cells: DataFrame) -> DataFrame:
    """Cells of the header rows before the first data row of their region."""
    first = F.min(F.when(~F.col("is_header"), F.col("row_idx"))).over(Window.partitionBy(*REGION))
    return cells.withColumn("_d", first).where(F.col("is_header") & (F.col("_d").isNull() | (F.col("row_idx") < F.col("_d")))).drop("_d")


def joined_labels(cells: DataFrame) -> DataFrame:
    """(region, labels): the texts of the leading header rows joined by a blank, column by column; blanks stay as empty labels."""
    text = trim(F.col("text"))
    by_col = leading_headers(cells).groupBy(*REGION, "col_idx").agg(F.sort_array(F.collect_list(F.struct("row_idx", text.alias("t")))).alias("p"))
    label = F.array_join(F.filter(F.transform("p", lambda x: x["t"]), lambda t: t != ""), " ")
    by_col = by_col.select(*REGION, "col_idx", label.alias("label"))
    by_region = by_col.groupBy(*REGION).agg(F.map_from_entries(F.collect_list(F.struct("col_idx", "label"))).alias("m"), F.max("col_idx").alias("w"))
    return by_region.select(*REGION, F.transform(F.sequence(F.lit(0), F.col("w")), lambda c: F.coalesce(F.element_at("m", c), F.lit(""))).alias("labels"))


def reconstruct_headers(cells: DataFrame) -> DataFrame:
    """Regions with one header row: leading header rows become row 0 without blank columns, other rows follow from 1."""
    labels = joined_labels(cells)
    head = labels.select(*REGION, F.posexplode("labels").alias("col_idx", "text")).where("text != ''").select(*REGION, F.lit(0).alias("row_idx"), F.lit(True).alias("is_header"), "col_idx", "text")
    lead = leading_headers(cells).select(*ROW).distinct()
    body = cells.join(lead, ROW, "left_anti").join(labels.select(*REGION, F.lit(1).alias("shift")), REGION, "left")
    number = F.dense_rank().over(Window.partitionBy(*REGION).orderBy("row_idx")) - 1 + F.coalesce("shift", F.lit(0))
    return head.unionByName(body.withColumn("row_idx", number).select(*ROW, "is_header", "col_idx", "text"))


def canonical_labels(cells: DataFrame) -> DataFrame:
    """(doc_id, canonical): labels of the first region with header rows."""
    return joined_labels(cells).groupBy("doc_id").agg(F.min_by("labels", F.struct("page", "region_id")).alias("canonical"))


def row_parts(cells: DataFrame) -> DataFrame:
    """One row a row: parts (normalised texts by column, blanks removed), sig, labels (distinct parts)."""
    p = cells.groupBy(*ROW, "is_header").agg(F.sort_array(F.collect_list(F.struct("col_idx", normalize(F.col("text")).alias("t")))).alias("p"))
    parts = F.filter(F.transform("p", lambda x: x["t"]), lambda t: t != "")
    return p.select(*ROW, "is_header", parts.alias("parts"), F.array_join(parts, "|").alias("sig"), F.array_distinct(parts).alias("labels"))


def signature(labels: Column) -> Column:
    return F.array_join(F.filter(F.transform(labels, normalize), lambda t: t != ""), "|")


def header_block_signature(cells: DataFrame) -> DataFrame:
    """(region, header_sig): per column the non-blank normalised texts of the leading header rows, columns joined by a bar."""
    return joined_labels(cells).select(*REGION, signature(F.col("labels")).alias("header_sig"))


def plain_header_signature(texts: Column) -> Column:
    """Lowered, trimmed texts joined by a bar: blanks and inner white space stay."""
    return F.array_join(F.transform(texts, lambda t: F.lower(trim(t))), "|")


def filter_headers(cells: DataFrame, keep: bool = False) -> DataFrame:
    """Cells without the rows that repeat a header of their document.

    A header row goes if its labels lie within a header emitted before, or, once any has been emitted, within the
    canonical one. A data row goes if it equals the canonical header or a header of its region, or lies within a
    header emitted before it, or within the canonical one after the first emission.

    Only the first of equal header label sets can be emitted, so the sets a document has are folded by themselves,
    a short list; the rows are then a left anti join with what was emitted, by document.
    """
    if keep:
        return cells
    rows = row_parts(cells).withColumn("pos", F.struct("page", "region_id", "row_idx"))
    canon = canonical_labels(cells).select("doc_id", signature(F.col("canonical")).alias("canon_sig"), F.array_distinct(F.filter(F.transform("canonical", normalize), lambda t: t != "")).alias("canon"))
    # emitted: in order, a set stays unless it lies within one that stayed, or within the canonical one after the first
    sets = rows.where("is_header").groupBy("doc_id", F.array_sort("labels").alias("labels")).agg(F.min("pos").alias("pos"))
    lists = sets.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "labels"))).alias("s")).join(canon, "doc_id")
    within = lambda a, b: F.size(F.array_except(a, b)) == 0
    kind = sets.select(F.array(F.struct("pos", "labels")).alias("x")).schema["x"].dataType.simpleString()
    fold = F.aggregate(
        "s", F.array().cast(kind),
        lambda out, x: F.when((F.size(x["labels"]) > 0) & (F.exists(out, lambda e: within(x["labels"], e["labels"])) | ((F.size(out) > 0) & within(x["labels"], F.col("canon")))), out).otherwise(F.concat(out, F.array(x))),
    )
    state = lists.where("canon_sig != ''").select("doc_id", "canon_sig", "canon", fold.alias("emitted"))
    local = rows.where("is_header").groupBy(*REGION).agg(F.collect_set("sig").alias("local"))
    r = rows.join(state, "doc_id", "left").join(local, REGION, "left")
    kept_first = F.exists("emitted", lambda e: e["pos"] == F.col("pos"))
    before = F.filter("emitted", lambda e: e["pos"] < F.col("pos"))
    # a header without labels is always kept and counts as an emission, so "covered by an emitted set" needs labels
    repeated = (F.col("sig") == F.col("canon_sig")) | F.coalesce(F.array_contains("local", F.col("sig")), F.lit(False)) | (
        (F.size("labels") > 0) & (F.exists(before, lambda e: (F.size(e["labels"]) > 0) & within(F.col("labels"), e["labels"])) | ((F.size(before) > 0) & within(F.col("labels"), F.col("canon"))))
    )
    gone = F.when(F.col("canon_sig").isNull(), F.lit(False)).when(F.col("is_header"), (F.size("labels") > 0) & ~kept_first).otherwise(repeated)
    return cells.join(r.where(F.coalesce(gone, F.lit(False))).select(*ROW), ROW, "left_anti")


def renumber(cells: DataFrame) -> DataFrame:
    """(row keys, serial): data rows of a document from 1, pages counted first so that no document is one task's sort."""
    rows = cells.select(*ROW, "is_header").distinct()
    per_page = rows.where("NOT is_header").groupBy("doc_id", "page").agg(F.count("*").alias("n"))
    offset = F.coalesce(F.sum("n").over(Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    local = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("region_id", "row_idx"))
    return rows.where("NOT is_header").withColumn("local", local).join(per_page.withColumn("offset", offset), ["doc_id", "page"]).select(*ROW, (F.col("offset") + F.col("local")).cast("long").alias("serial"))
