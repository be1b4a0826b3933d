"""Markdown tables and the choice between supplied tables and clustered text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import trim
from ..functions.storage import materialize
from .metrics import content_gate

PLACE = ["doc_id", "page", "region_id"]
GRID, TABLES = "vector-grid-cells", "region-tables"


def markdown_rows(markdown: Column) -> Column:
    """array<array<string>>: pipe-table rows of a text without separator rows. A pipe splits even behind a backslash."""
    lines = F.filter(F.transform(F.split(markdown, r"\r\n|\r|\n"), trim), lambda s: s.startswith("|") & s.endswith("|"))
    inner = lambda s: F.when(F.length(s) < 2, F.lit("")).otherwise(F.substring(s, F.lit(2), F.length(s) - 2))
    rows = F.transform(lines, lambda s: F.transform(F.split(inner(s), r"\|"), trim))
    return F.filter(rows, lambda r: ~F.forall(r, lambda c: c.rlike("^:?-{3,}:?$")))


def structured_rows(cells: DataFrame) -> DataFrame:
    """Supplied grid cells (place, row, col, text, is_header) as cells: a row is a header if any of its cells is."""
    head = cells.groupBy(*PLACE, "row").agg(F.max("is_header").alias("is_header"))
    return cells.drop("is_header").join(head, [*PLACE, "row"]).select(*PLACE, F.col("row").alias("row_idx"), F.col("col").alias("col_idx"), trim(F.col("text")).alias("text"), "is_header", F.lit(1.0).alias("confidence"))


def region_markdown_rows(regions: DataFrame) -> DataFrame:
    """Supplied markdown of regions (place, text, needs_ocr) as cells; OCR pages and blank texts give none."""
    rows = regions.where(~F.col("needs_ocr") & (trim(F.col("text")) != "")).select(*PLACE, F.posexplode(markdown_rows(F.col("text"))).alias("row_idx", "v"))
    return rows.select(*PLACE, "row_idx", F.posexplode("v").alias("col_idx", "text"), (F.col("row_idx") == 0).alias("is_header"), F.lit(0.85).alias("confidence"))


def grid_boxes(cells: DataFrame, boxes: DataFrame) -> DataFrame:
    """Cells with boxes of an even grid over their region (x1, y1, x2, y2)."""
    size = cells.groupBy(*PLACE).agg((F.max("row_idx") + 1).alias("r"), (F.max("col_idx") + 1).alias("c"))
    w, h = (F.col("x2") - F.col("x1")) / F.col("c"), (F.col("y2") - F.col("y1")) / F.col("r")
    out = cells.join(size, PLACE).join(boxes.select(*PLACE, "x1", "y1", "x2", "y2"), PLACE)
    return out.select(*cells.columns, (F.col("x1") + F.col("col_idx") * w).alias("x1"), (F.col("y1") + F.col("row_idx") * h).alias("y1"), (F.col("x1") + (F.col("col_idx") + 1) * w).alias("x2"), (F.col("y1") + (F.col("row_idx") + 1) * h).alias("y2"))


def lacking(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """(place, expected, missing): the words of the clustered text, and how many of them each candidate lacks; none where that has no words."""
    gate = content_gate(baseline, candidate, PLACE).select(*PLACE, "expected", "missing")
    return candidate.select(*PLACE).distinct().join(gate, PLACE, "left").select(*PLACE, *(F.coalesce(c, F.lit(0)).alias(c) for c in ("expected", "missing")))


def choose_tier(baseline: DataFrame, structured: DataFrame, markdown: DataFrame, expected: DataFrame, failed: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cells, sources, warnings): supplied grid cells if they lack no word of the clustered text, else markdown
    rows wide enough (expected: place, expected columns) that lack none, else the clustered text.

    failed: place and tier of detections that failed. Markdown is one detection a page, so all its regions without grid cells do without.
    """
    base = baseline.select(*PLACE, "row_idx", "col_idx", "text", "is_header", "confidence")
    places = base.select(*PLACE).distinct()
    if failed is None:
        failed = places.limit(0).withColumn("tier", F.lit(""))
    no_a = failed.where(F.col("tier") == GRID).select(*PLACE).distinct()
    no_b = failed.where(F.col("tier") == TABLES).select("doc_id", "page").distinct()
    a = materialize(structured_rows(structured).join(places, PLACE, "left_semi").join(no_a, PLACE, "left_anti"))
    gate_a = materialize(lacking(base, a))
    pending = places.join(gate_a.where("missing = 0"), PLACE, "left_anti")
    b = materialize(region_markdown_rows(markdown).join(pending, PLACE, "left_semi").join(no_b, ["doc_id", "page"], "left_anti"))
    wide = b.where("row_idx = 0").groupBy(*PLACE).agg((F.max("col_idx") + 1).alias("w")).join(expected, PLACE, "left").where(F.col("w") >= F.coalesce("expected", F.lit(0)))
    gate_b = materialize(lacking(base, b.join(wide.select(*PLACE), PLACE, "left_semi")))
    gates = gate_a.withColumn("tier", F.lit(GRID)).unionByName(gate_b.withColumn("tier", F.lit(TABLES)))
    source = F.coalesce("tier", F.lit("clustered"))
    sources = materialize(places.join(gates.where("missing = 0").select(*PLACE, "tier"), PLACE, "left").select(*PLACE, source.alias("source")))
    share = F.format_number(100 * F.col("missing") / F.col("expected"), 1)
    refused = F.concat("tier", F.lit(" lacks "), F.col("missing").cast("string"), F.lit(" words ("), share, F.lit("%)"))
    fallen = places.join(no_a, PLACE, "left_semi").withColumn("tier", F.lit(GRID)).unionByName(pending.join(no_b, ["doc_id", "page"], "left_semi").withColumn("tier", F.lit(TABLES)))
    warn = lambda df, kind, message: df.select("doc_id", F.lit(kind).alias("kind"), "page", "region_id", message.alias("message"))
    warnings = warn(gates.where("missing > 0"), "tier-incomplete", refused).unionByName(warn(fallen, "tier-fallback", F.concat("tier", F.lit(" failed"))))
    of = lambda cells, name: cells.join(sources.where(F.col("source") == name).select(*PLACE), PLACE, "left_semi").select(*base.columns)
    return of(a, GRID).unionByName(of(b, TABLES)).unionByName(of(base, "clustered")), sources, warnings
