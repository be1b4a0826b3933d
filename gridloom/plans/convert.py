"""Whole conversions: positioned text, markdown or plain pages to sheet rows, warnings and diagnostics."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.storage import materialize
from ..model import Options
from ..operators import grid, headers, layout, merge, policy, render, tiers
from ..operators.layout import PAGE, REGION
from ..sources import xlsx


#: Characters of a text of no region that its warning shows.
UNASSIGNED = 50


@dataclass
class Conversion:
    sheet_rows: DataFrame
    regions: DataFrame
    decisions: DataFrame | None
    warnings: DataFrame | None
    diagnostics: DataFrame


def region_cells(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cells, boxes) of all regions of positioned text, with region_id the region's number on its page."""
    return _cells(grid.region_rows(items))


def _cells(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    cells = grid.tables(placed).withColumnRenamed("region_idx", "region_id")
    boxes = cells.groupBy(*headers.REGION).agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"))
    return cells.select(*headers.ROW, "is_header", "col_idx", "text", "confidence"), boxes


def continued_ids(cells: DataFrame, pages: DataFrame, boxes: DataFrame | None = None, page_text: DataFrame | None = None, numbers: tuple[int, ...] = ()) -> DataFrame:
    """Cells whose region_id carries over pages; pages: doc_id, page, which with `numbers` is a place in that list.

    Text outside the regions (page_text), above those of a page or below those of the one before, starts new ids.
    """
    counts = cells.groupBy(*PAGE).agg(F.count_distinct("region_id").cast("int").alias("n_regions"))
    p = pages.join(counts, PAGE, "left").withColumn("n_regions", F.coalesce("n_regions", F.lit(0)))
    if boxes is None or page_text is None:  # on positioned text all text belongs to regions, so none stands above or below
        p = p.withColumn("text_top", F.lit(False)).withColumn("text_bottom", F.lit(False))
    else:
        edges = boxes.groupBy(*PAGE).agg(F.min("y1").alias("top"), F.max("y2").alias("low"))
        beside = page_text.select(*PAGE, F.col("y1").alias("a"), F.col("y2").alias("b")).join(edges, PAGE)
        flags = beside.groupBy(*PAGE).agg(F.bool_or(F.col("b") <= F.col("top")).alias("text_top"), F.bool_or(F.col("a") >= F.col("low")).alias("text_bottom"))
        p = p.join(flags, PAGE, "left").withColumn("text_top", F.coalesce("text_top", F.lit(False))).withColumn("text_bottom", F.coalesce("text_bottom", F.lit(False)))
    if numbers:  # whether a page follows another is a matter of their numbers, not of their places
        p = p.withColumn("ord", F.col("page")).withColumn("page", number_at(numbers, F.col("page")))
        base = merge.region_ids(p).select("doc_id", F.col("ord").alias("page"), "base")
    else:
        base = merge.region_ids(p).select(*PAGE, "base")
    return cells.join(base, PAGE).withColumn("region_id", (F.col("region_id") + F.col("base")).cast("int")).drop("base")


def number_at(numbers: tuple[int, ...], place: Column) -> Column:
    """The page number at a place of a list."""
    return F.element_at(F.array(*map(F.lit, numbers)), place + 1)


@dataclass
class Supplied:
    """What other tools found in the documents, as tables; each may be missing.

    structured: grid cells (doc_id, page, region_id, row, col, text, is_header), region_id being the region's number on its page.
    markdown: tables of regions (doc_id, page, region_id, text, needs_ocr). failed: (doc_id, page, region_id, tier) of failed detections.
    titles: (doc_id, page, rank, text). outside: text of no region (doc_id, page, text, assigned).
    plain: pages that are rows already (doc_id, page, rows), of documents whose other pages are positioned text.
    """

    structured: DataFrame | None = None
    markdown: DataFrame | None = None
    failed: DataFrame | None = None
    titles: DataFrame | None = None
    outside: DataFrame | None = None
    plain: DataFrame | None = None


def tiered_cells(items: DataFrame, given: Supplied) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(cells, boxes, sources, warnings): positioned text where no supplied table is complete."""
    placed = grid.region_rows(items)
    cells, boxes = _cells(placed)
    none = cells.select(*tiers.PLACE).limit(0)
    structured = none.select("*", F.lit(0).alias("row"), F.lit(0).alias("col"), F.lit("").alias("text"), F.lit(False).alias("is_header")) if given.structured is None else given.structured
    markdown = none.select("*", F.lit("").alias("text"), F.lit(False).alias("needs_ocr")) if given.markdown is None else given.markdown
    expected = grid.expected_columns(placed).withColumnRenamed("region_idx", "region_id")
    picked, sources, warnings = tiers.choose_tier(cells, structured, markdown, expected, given.failed)
    return picked, boxes, sources, warnings


def convert_items(items: DataFrame, options: Options = Options(), ocr_pages: DataFrame | None = None, page_text: DataFrame | None = None, given: Supplied = Supplied()) -> Conversion:
    """The main path: items of the columns of model.TEXT_ITEMS to the rows of workbooks.

    Supplied tables of regions are looked at where `extraction` is auto; clustered and positions read the text alone.
    All window and join keys begin with the document, and everything a document decides (pattern, canonical header, policy)
    is one small row of it. Pages asked for by number come in the order given, repeats as pages of their own.
    """
    if options.extraction not in ("clustered", "positions", "auto"):
        raise ValueError(f"extraction {options.extraction!r} isn't one of positioned text")
    numbers = options.page_numbers
    every = items.select(*PAGE) if given.plain is None else items.select(*PAGE).unionByName(given.plain.select(*PAGE))
    pages = layout.page_list(every, numbers)
    if numbers:  # inside, a page is its place in the list, which is as long as the option
        asked = items.sparkSession.createDataFrame(list(enumerate(numbers)), "ord int, page int")
        at = lambda df: df if df is None else df.join(F.broadcast(asked), "page").drop("page").withColumnRenamed("ord", "page")
        pages = pages.select("doc_id", F.col("ord").alias("page"), "ord")
        items, ocr_pages, page_text = at(items), at(ocr_pages), at(page_text)
        given = Supplied(**{f.name: at(getattr(given, f.name)) for f in fields(Supplied)})
    tier_warnings = None
    if options.extraction == "auto":
        cells, boxes, sources, tier_warnings = tiered_cells(items, given)
        cells = headers.reconstruct_headers(cells).join(sources, headers.REGION)
    else:
        cells, boxes = region_cells(items)
        cells = headers.reconstruct_headers(cells).withColumn("source", F.lit("clustered"))
    if given.plain is not None:
        rows = render.page_rows_layout(given.plain).select(*headers.ROW, "is_header", "col_idx", "text")
        boxes = boxes.unionByName(rows.select(*headers.REGION).distinct().select("*", *(F.lit(0.0).alias(c) for c in ("x1", "y1", "x2", "y2"))))
        cells = cells.unionByName(headers.reconstruct_headers(rows).withColumn("source", F.lit("clustered")))
    cells = materialize(cells)
    decisions = None
    if options.merge_continuations:
        cells, decisions = merge.merge_side_by_side(cells, boxes, page_text)
        cells = materialize(cells)
    counts = cells.groupBy(*PAGE).agg(F.count_distinct("region_id").cast("int").alias("n_regions"))
    chosen = policy.resolve_policy(pages.join(counts, PAGE, "left").withColumn("n_regions", F.coalesce("n_regions", F.lit(0))), options.worksheet_policy)
    if options.merge_continuations:
        cells = materialize(continued_ids(cells, pages, boxes, page_text, numbers))
    # a region that others were merged into keeps its source, and its own rows come first
    regions = cells.groupBy(*headers.REGION).agg(F.min_by("source", "row_idx").alias("source"))
    cells = cells.drop("source")
    kept = materialize(headers.filter_headers(cells, options.keep_repeated_headers))
    chosen = materialize(chosen)
    split = kept.join(chosen.select("doc_id", "policy"), "doc_id")
    cols = kept.columns
    title = {p: given.titles if given.titles is None else given.titles.join(chosen.where(F.col("policy") == p).select("doc_id"), "doc_id", "left_semi") for p in ("per-region", "stacked")}
    one = render.per_region(split.where("policy = 'per-region'").select(*cols), title["per-region"], options.keep_repeated_headers)
    stacked_regions = regions.join(chosen.where("policy = 'stacked'").select("doc_id"), "doc_id", "left_semi")
    rows = one.unionByName(render.stacked(split.where("policy = 'stacked'").select(*cols), stacked_regions, title["stacked"]))
    warnings = chosen.where("warning IS NOT NULL").select("doc_id", F.lit("region-count-unstable").alias("kind"), F.lit(-1).alias("page"), F.col("warning").alias("message"))
    if decisions is not None:
        warnings = warnings.unionByName(merge.merge_warnings(decisions))
    if tier_warnings is not None:
        warnings = warnings.unionByName(tier_warnings.select("doc_id", "kind", "page", "message"))
    if given.outside is not None:
        text = F.concat(F.lit("text of no region: "), F.substring("text", 1, UNASSIGNED))
        warnings = warnings.unionByName(given.outside.where("NOT assigned").select("doc_id", F.lit("unassigned-text").alias("kind"), "page", text.alias("message")))
    flagged = pages.withColumn("needs_ocr", F.lit(False))
    if ocr_pages is not None:
        flagged, ocr = layout.ocr_flags(pages, ocr_pages)
        warnings = warnings.unionByName(ocr.select("doc_id", "kind", "page", "message"))
    rows = materialize(rows)
    counted = policy.diagnostics(flagged, regions, rows, given.outside)
    if options.worksheet_policy == "per-region":
        counted = policy.without_sheets(counted)
    if numbers:
        real = lambda c: F.when(F.col(c) >= 0, number_at(numbers, F.col(c))).otherwise(F.col(c))
        warnings = warnings.withColumn("page", real("page"))
        rows = rows.withColumn("page_no", number_at(numbers, F.col("page_no") - 1) + 1)
        regions = regions.withColumn("page", real("page"))
        decisions = decisions if decisions is None else decisions.withColumn("page", real("page"))
    return Conversion(rows, regions, decisions, warnings, counted)


def write_conversion(conversion: Conversion, path: str, options: Options = Options()) -> None:
    """A workbook for each document, with the sheet name and the extra columns that the options ask for."""
    xlsx.write_workbooks(conversion.sheet_rows, path, options.sheet_name, options.include_page_column, options.include_entry_column)


def convert_pages(pages: DataFrame, include_page: bool = False) -> DataFrame:
    """Plain pages (doc_id, ord, rows array<array<string>>), numbered from 0 in the order of arrival."""
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("ord")) - 1
    return render.plain(pages.withColumn("page", number), include_page)


def convert_markdown(pages: DataFrame, include_page: bool = False) -> DataFrame:
    """Pages of markdown (doc_id, ord, markdown) to the rows of their pipe tables."""
    return convert_pages(pages.withColumn("rows", tiers.markdown_rows(F.col("markdown"))), include_page)


def convert(pages: DataFrame, options: Options = Options(), given: Supplied = Supplied()) -> Conversion | DataFrame:
    """By what the pages are: positioned text to a Conversion; pages of markdown (extraction markdown-legacy) or of rows to sheet rows."""
    if options.extraction == "markdown-legacy" or "markdown" in pages.columns:
        return convert_markdown(pages, options.include_page_column)
    if "rows" in pages.columns:
        return convert_pages(pages, options.include_page_column)
    return convert_items(pages, options, given=given)


__all__ = ["REGION", "Conversion", "Supplied", "continued_ids", "convert", "convert_items", "convert_markdown", "convert_pages", "region_cells", "tiered_cells", "write_conversion"]


def postprocess(cells: DataFrame, keep_repeated_headers: bool = False) -> tuple[DataFrame, DataFrame]:
    """(cells without repeated headers, serial numbers of their data rows): the header steps by themselves."""
    kept = materialize(headers.filter_headers(cells, keep_repeated_headers))
    return kept, headers.renumber(kept)
