"""Pages: text filter, dimensions, coordinates, region discovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.exprs import trim

PAGE = ["doc_id", "page"]
REGION = [*PAGE, "region_idx"]
#: A gap splits a page only if it is wider than this share of the page, and this much wider than the next smaller gap.
FLOOR, JUMP = 0.04, 1.5


def text_items(items: DataFrame) -> DataFrame:
    """Items of type Text whose trimmed text isn't empty."""
    return items.where((F.col("item_type") == "Text") & (trim(F.col("text")) != ""))


def page_dimensions(items: DataFrame) -> DataFrame:
    """(doc_id, page, page_width, page_height) inferred from all items with a margin of 36."""
    return items.groupBy(*PAGE).agg((F.greatest(F.lit(0.0), F.max(F.col("x") + F.col("width"))) + 36).alias("page_width"), (F.greatest(F.lit(0.0), F.max(F.col("y") + F.col("height"))) + 36).alias("page_height"))


def page_list(pages: DataFrame, numbers: tuple[int, ...] = ()) -> DataFrame:
    """(doc_id, page, ord): all pages in order, or those asked for in the order given, repeats included."""
    every = pages.select(*PAGE).distinct()
    if not numbers:
        return every.withColumn("ord", F.row_number().over(Window.partitionBy("doc_id").orderBy("page")) - 1)
    asked = F.explode(F.array(*[F.struct(F.lit(o).alias("ord"), F.lit(p).alias("page")) for o, p in enumerate(numbers)]))
    return every.select("doc_id").distinct().select("doc_id", asked.alias("a")).select("doc_id", F.col("a.page").alias("page"), F.col("a.ord").alias("ord"))


def scan_layout_pages(items: DataFrame, pages: DataFrame) -> DataFrame:
    """Requested pages with their items; a page without items keeps a row of nulls and the default size."""
    return pages.join(items, PAGE, "left").join(page_dimensions(items), PAGE, "left").withColumn("page_width", F.coalesce("page_width", F.lit(612.0))).withColumn("page_height", F.coalesce("page_height", F.lit(792.0)))


def ocr_flags(pages: DataFrame, needing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages with needs_ocr, and the warnings for those."""
    flagged = pages.join(needing.select(*PAGE).distinct().withColumn("needs_ocr", F.lit(True)), PAGE, "left").withColumn("needs_ocr", F.coalesce("needs_ocr", F.lit(False)))
    return flagged, flagged.where("needs_ocr").select("doc_id", F.lit("needs-ocr").alias("kind"), "page", F.lit("page needs OCR").alias("message"))


def with_page_size(items: DataFrame) -> DataFrame:
    """Items with page_width, page_height and top_y, by a window: the later windows share its shuffle."""
    page = Window.partitionBy(*PAGE)
    out = items.withColumn("page_width", F.greatest(F.lit(0.0), F.max(F.col("x") + F.col("width")).over(page)) + 36).withColumn("page_height", F.greatest(F.lit(0.0), F.max(F.col("y") + F.col("height")).over(page)) + 36)
    return out.withColumn("top_y", F.col("page_height") - F.col("y"))


def item_bbox() -> Column:
    """Box of an item with a top-left origin."""
    return F.struct(F.col("x").alias("x1"), (F.col("page_height") - F.col("y") - F.col("height")).alias("y1"), (F.col("x") + F.col("width")).alias("x2"), (F.col("page_height") - F.col("y")).alias("y2"))


def region_gaps(items: DataFrame) -> DataFrame:
    """Text items with `gap`: the distance from the end of the item before it in x order; null for the first."""
    line = Window.partitionBy(*PAGE).orderBy("x", "seq")
    return text_items(with_page_size(items)).withColumn("gap", F.col("x") - F.lag(F.col("x") + F.col("width")).over(line))


def region_threshold(gaps: DataFrame) -> DataFrame:
    """Adds `threshold`: midway in the largest relative jump between gaps of the page, infinite without a jump."""
    by_size = Window.partitionBy(*PAGE).orderBy("_g")
    out = gaps.withColumn("_g", F.when(F.col("gap") > 0, F.col("gap"))).withColumn("_up", F.lead("_g").over(by_size))
    floor = F.col("page_width") * FLOOR
    jump = F.when((F.col("_up") > floor) & (F.col("_up") / F.col("_g") >= JUMP), F.struct((F.col("_up") / F.col("_g")).alias("r"), (-F.col("_g")).alias("g"), F.greatest((F.col("_g") + F.col("_up")) / 2, floor).alias("t")))
    return out.withColumn("threshold", F.coalesce(F.max(jump).over(Window.partitionBy(*PAGE))["t"], F.lit(float("inf")))).drop("_g", "_up")


def discover_regions(items: DataFrame) -> DataFrame:
    """Text items with region_idx: the page is cut where a gap passes the threshold."""
    line = Window.partitionBy(*PAGE).orderBy("x", "seq").rowsBetween(Window.unboundedPreceding, 0)
    cut = F.when(F.col("gap") > F.col("threshold"), 1).otherwise(0)
    return region_threshold(region_gaps(items)).withColumn("region_idx", F.sum(cut).over(line).cast("int"))


def region_extents(regions: DataFrame) -> DataFrame:
    return regions.groupBy(*REGION).agg(F.count("*").alias("items"), F.min("x").alias("x_min"), F.max(F.col("x") + F.col("width")).alias("x_max"), F.min(F.col("top_y") - F.col("height")).alias("y_min"), F.max("top_y").alias("y_max"))


def titles(items: DataFrame, region_tops: DataFrame) -> DataFrame:
    """Text items whose baseline lies above the top region edge of the page: (doc_id, page, rank, text)."""
    top = region_tops.groupBy(*PAGE).agg(F.min("y_top").alias("top"))
    above = text_items(items).join(top, PAGE).where(F.col("y") > F.col("top"))
    return above.withColumn("rank", F.row_number().over(Window.partitionBy(*PAGE).orderBy(F.desc("y"), "x", "seq")) - 1)


def outside_text(items: DataFrame, members: DataFrame, ranges: DataFrame) -> DataFrame:
    """Text items in no region, with `assigned`: whether the centre lies in a region's x range.

    members: (doc_id, page, seq) of items in regions; ranges: (doc_id, page, x_min, x_max), a few a page.
    """
    out = text_items(items).join(members, [*PAGE, "seq"], "left_anti")
    spans = ranges.groupBy(*PAGE).agg(F.collect_list(F.struct("x_min", "x_max")).alias("spans"))
    centre = F.col("x") + F.col("width") / 2
    return out.join(spans, PAGE, "left").withColumn("assigned", F.coalesce(F.exists("spans", lambda s: (s["x_min"] <= centre) & (centre <= s["x_max"])), F.lit(False))).drop("spans")
