"""Worksheet policy, sheet counts and diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import SOURCES


def resolve_policy(pages: DataFrame, policy: str = "auto") -> DataFrame:
    """(doc_id, policy, warning) from pages (doc_id, ord, n_regions): per-region where all pages with regions have as many.

    The warning lists the distinct counts in the order of their first page.
    """
    with_regions = pages.where("n_regions > 0")
    docs = pages.select("doc_id").distinct()
    first = with_regions.groupBy("doc_id", "n_regions").agg(F.min("ord").alias("ord"))
    counts = first.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("ord", "n_regions"))).alias("c"))
    text = F.array_join(F.transform("c", lambda x: x["n_regions"].cast("string")), ", ")
    unstable = F.size("c") > 1
    auto = F.when(F.col("c").isNull() | unstable, "stacked").otherwise("per-region")
    message = F.when(unstable, F.concat(F.lit("region-count-unstable: "), text))
    out = docs.join(counts, "doc_id", "left")
    if policy != "auto":
        return out.select("doc_id", F.lit(policy).alias("policy"), F.lit(None).cast("string").alias("warning"))
    return out.select("doc_id", auto.alias("policy"), message.alias("warning"))


def sheet_counts(ids: DataFrame) -> DataFrame:
    """(doc_id, sheets): the largest region id and one; ids: doc_id, base, n_regions of pages with regions."""
    return ids.groupBy("doc_id").agg(F.max(F.col("base") + F.col("n_regions")).cast("int").alias("sheets"))


def diagnostics(pages: DataFrame, regions: DataFrame, sheet_rows: DataFrame, outside: DataFrame | None = None) -> DataFrame:
    """One row a document: pages, OCR pages, regions, rows written (not titles or separators), unassigned texts, regions by source."""
    p = pages.groupBy("doc_id").agg(F.count("*").alias("total_pages"), F.count_if("needs_ocr").alias("ocr_pages"))
    by_source = regions.groupBy("doc_id", "source").agg(F.count("*").alias("n"))
    r = by_source.groupBy("doc_id").agg(F.sum("n").alias("total_regions"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("source", "n")))).alias("tier_counts"))
    w = sheet_rows.where("kind = 'row'").groupBy("doc_id").agg(F.count("*").alias("total_rows"))
    out = p.join(r, "doc_id", "left").join(w, "doc_id", "left")
    if outside is not None:
        out = out.join(outside.where("NOT assigned").groupBy("doc_id").agg(F.count("*").alias("unassigned_text_items")), "doc_id", "left")
    else:
        out = out.withColumn("unassigned_text_items", F.lit(0).cast("long"))
    zero = ["total_regions", "total_rows", "unassigned_text_items"]
    tiers = F.create_map(*(x for s in SOURCES for x in (F.lit(s), F.coalesce(F.try_element_at("tier_counts", F.lit(s)), F.lit(0).cast("long")))))
    return out.select("doc_id", "total_pages", "ocr_pages", *(F.coalesce(c, F.lit(0)).alias(c) for c in zero), tiers.alias("tier_counts"), F.lit(0).cast("long").alias("ambiguous_cells"))


def without_sheets(diagnostics: DataFrame) -> DataFrame:
    """Diagnostics where each region has its sheet: a document without regions has no sheet, so none of its pages is written or counted."""
    return diagnostics.select(*(F.when(F.col("total_regions") > 0, F.col(c)).otherwise(0).alias(c) if c not in ("doc_id", "tier_counts") else F.col(c) for c in diagnostics.columns))
