"""Joining regions: sequence columns, side-by-side decisions, ids that carry over pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.exprs import integer_text, normalize, trim
from ..functions.folds import fold_groups
from ..functions.storage import materialize
from .headers import REGION, header_block_signature

SHARE, NEAR, FAR = 0.8, 3, 10
#: How far above a region a text may end and still be its caption.
CAPTION = 40
# fixed values: the tiers and directions of a decision
SEQUENCE, HEURISTIC, AMBIGUOUS = "sequence-confirmed", "heuristic", "flagged-ambiguous"
STACKED, PARALLEL, NONE = "stack-right-under-left", "parallel-end-to-end", "none"


def column_runs(cells: DataFrame) -> DataFrame:
    """(region, col_idx, n, k, ones, steps, first, last): of the data of each column the filled rows, those with whole
    numbers, the steps between those that go up by one, all steps, and the first and the last number."""
    d = cells.where(~F.col("is_header") & (trim(F.col("text")) != "")).withColumn("v", F.when(integer_text(F.col("text")), F.replace(trim(F.col("text")), F.lit(","), F.lit("")).try_cast("decimal(38,0)")))
    line = Window.partitionBy(*REGION, "col_idx").orderBy("row_idx")
    before = F.last("v", ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, -1))
    d = d.withColumn("step", F.col("v") - before)
    number = F.when(F.col("v").isNotNull(), F.col("row_idx"))
    return d.groupBy(*REGION, "col_idx").agg(
        F.count("*").alias("n"), F.count("v").alias("k"), F.count_if(F.col("step") == 1).alias("ones"), F.count("step").alias("steps"), F.min_by("v", number).alias("first"), F.max_by("v", number).alias("last"))


def sequence_columns(cells: DataFrame) -> DataFrame:
    """(region, col_idx, first, last): the first column whose data is mostly whole numbers, mostly going up by one."""
    rows = cells.where("NOT is_header").groupBy(*REGION).agg(F.count_distinct("row_idx").alias("rows")).where("rows >= 3")
    good = column_runs(cells).where((F.col("n") >= 3) & (F.col("k") >= SHARE * F.col("n")) & (F.col("steps") > 0) & (F.col("ones") >= SHARE * F.col("steps")))
    return good.join(rows.select(*REGION), REGION, "left_semi").groupBy(*REGION).agg(F.min_by(F.struct("col_idx", "first", "last"), "col_idx").alias("s")).select(*REGION, "s.*")


def side_by_side_pages(regions: DataFrame) -> DataFrame:
    """(doc_id, page, match) of pages with more than one region; regions: doc_id, page, region_id, x1, y1, y2, header_sig, n_cols."""
    line = Window.partitionBy("doc_id", "page").orderBy("x1", "region_id")
    nxt = lambda c: F.lead(c).over(line)
    overlap = F.least("y2", nxt("y2")) > F.greatest("y1", nxt("y1"))
    alike = ((F.col("header_sig") != "") & (F.col("header_sig") == nxt("header_sig"))) | ((F.col("header_sig") != "") & (nxt("header_sig") == "") & (F.col("n_cols") == nxt("n_cols")))
    pairs = regions.withColumn("hit", F.coalesce(overlap & alike, F.lit(False)))
    return pairs.groupBy("doc_id", "page").agg(F.bool_or("hit").alias("match"), F.count("*").alias("n")).where("n > 1").select("doc_id", "page", "match")


def side_by_side_pattern(pages: DataFrame) -> DataFrame:
    """(doc_id, pattern): whether half of the multi-region pages match."""
    return pages.groupBy("doc_id").agg((F.avg(F.col("match").cast("double")) >= 0.5).alias("pattern"))


def page_texts(page_text: DataFrame) -> DataFrame:
    """(doc_id, page, texts) of titles and other texts outside regions: doc_id, page, x1, y1, x2, y2, text and, to say their order, ord (else from the top)."""
    order = F.col("ord") if "ord" in page_text.columns else F.lit(0)
    entry = F.struct(order.cast("int").alias("ord"), "y1", "x1", "x2", "y2", normalize(F.col("text")).alias("text"))
    return page_text.groupBy("doc_id", "page").agg(F.sort_array(F.collect_list(entry)).alias("texts"))


def region_features(cells: DataFrame, boxes: DataFrame) -> DataFrame:
    """One row a region: box, header_sig, n_cols, data_cols, n_rows (of data), runs (what `column_runs` says of each column)."""
    data = F.when(~F.col("is_header"), F.col("col_idx") + 1)
    size = cells.groupBy(*REGION).agg((F.max("col_idx") + 1).alias("n_cols"), F.coalesce(F.max(data), F.lit(0)).alias("data_cols"), F.count_distinct(F.when(~F.col("is_header"), F.col("row_idx"))).alias("n_rows"))
    runs = column_runs(cells).groupBy(*REGION).agg(F.sort_array(F.collect_list(F.struct("col_idx", "n", "k", "ones", "steps", "first", "last"))).alias("runs"))
    out = boxes.select(*REGION, "x1", "y1", "x2", "y2").join(size, REGION).join(header_block_signature(cells), REGION, "left").withColumn("header_sig", F.coalesce("header_sig", F.lit("")))
    return out.join(runs, REGION, "left")


def _sequence(region: dict) -> dict | None:
    """The first column that runs mostly by ones."""
    if region["n_rows"] < 3:
        return None
    return next((c for c in region["runs"].values() if c["n"] >= 3 and c["k"] >= SHARE * c["n"] and c["steps"] and c["ones"] >= SHARE * c["steps"]), None)


def _caption(region: dict, texts: list[dict]) -> str:
    near = (t for t in texts if region["y1"] - CAPTION <= t["y2"] <= region["y1"] and t["x1"] < region["x2"] and t["x2"] > region["x1"])
    return " ".join(t["text"] for t in near)


def decide(left: dict, right: dict, texts: list[dict], pattern: bool) -> tuple[str, bool, str, str]:
    """(tier, merged, direction, reason) of a region, grown by those merged into it before, and the next one to the right."""
    top, low = max(left["y1"], right["y1"]), min(left["y2"], right["y2"])
    if low <= top:
        return AMBIGUOUS, False, NONE, "no-vertical-overlap"
    if any(t["x1"] < right["x1"] and t["x2"] > left["x2"] and t["y1"] < low and t["y2"] > top for t in texts):
        return AMBIGUOUS, False, NONE, "intervening-text"
    same = left["header_sig"] == right["header_sig"] if right["header_sig"] else left["n_cols"] == right["n_cols"]
    if not (left["header_sig"] and same):
        return AMBIGUOUS, False, NONE, "header-mismatch"
    a, b = _sequence(left), _sequence(right)
    if a and b and a["col_idx"] == b["col_idx"]:
        ahead = b["first"] - a["last"]
        if 0 <= ahead <= NEAR:
            return SEQUENCE, True, STACKED, "sequence-continues"
        if ahead > FAR:
            return SEQUENCE, False, PARALLEL, "parallel-sequence"
    one, other = _caption(left, texts), _caption(right, texts)
    if one and other and one != other:
        return AMBIGUOUS, False, NONE, "captions-differ"
    return (HEURISTIC, True, STACKED, "pattern") if pattern else (AMBIGUOUS, False, NONE, "no-pattern")


def grow(left: dict, right: dict) -> dict:
    """A region with the data rows of another below its own; header and place stay."""
    runs = dict(left["runs"])
    for col, r in right["runs"].items():
        own = runs.get(col)
        if own is None:
            runs[col] = r
            continue
        both = own["last"] is not None and r["first"] is not None
        sums = {c: own[c] + r[c] for c in ("n", "k", "ones", "steps")}
        runs[col] = sums | {
            "col_idx": col, "ones": sums["ones"] + (both and r["first"] - own["last"] == 1), "steps": sums["steps"] + both,
            "first": own["first"] if own["first"] is not None else r["first"], "last": r["last"] if r["last"] is not None else own["last"]}
    return left | {
        "x1": min(left["x1"], right["x1"]), "y1": min(left["y1"], right["y1"]), "x2": max(left["x2"], right["x2"]), "y2": max(left["y2"], right["y2"]),
        "n_cols": max(left["n_cols"], right["data_cols"]), "n_rows": left["n_rows"] + right["n_rows"], "runs": dict(sorted(runs.items()))}


FEATURES = ["region_id", "x1", "y1", "x2", "y2", "n_cols", "data_cols", "header_sig", "n_rows", "runs"]
DECISION = {"slot": "int", "place": "int", "left_id": "int", "tier": "string", "merged": "boolean", "direction": "string", "reason": "string"}


def join_page(group: dict[str, list]) -> dict[str, list]:
    """Regions of a page from left to right, each judged against the region that has grown so far."""
    out: dict[str, list] = {c: [] for c in DECISION}
    grown, slot, place = None, 0, 1
    for k in range(len(group["region_id"])):
        own = {c: group[c][k] for c in FEATURES} | {"runs": {r["col_idx"]: r for r in group["runs"][k] or ()}}
        if grown is None:
            grown, made = own, (None,) * 5
        else:
            decision = decide(grown, own, group["texts"][k] or [], group["pattern"][k])
            made = (grown["region_id"], *decision)
            if decision[1]:
                grown, place = grow(grown, own), place + 1
            else:
                grown, slot, place = own, slot + 1, 1
        for c, v in zip(DECISION, (slot, place, *made), strict=True):
            out[c].append(v)
    return out


def decide_regions(features: DataFrame, page_text: DataFrame | None = None) -> DataFrame:
    """(doc_id, page, region_id, slot, place, left_id, tier, merged, direction, reason): which region of its page each joins, and why.

    features: as `region_features` makes them. The first region of a page has no decision.
    """
    pattern = side_by_side_pattern(side_by_side_pages(features))
    f = features.join(pattern, "doc_id", "left").withColumn("pattern", F.coalesce("pattern", F.lit(True)))
    if page_text is None:
        f = f.withColumn("texts", F.lit(None).cast("array<struct<ord:int,y1:double,x1:double,x2:double,y2:double,text:string>>"))
    else:
        f = f.join(page_texts(page_text), ["doc_id", "page"], "left")
    page = ["doc_id", "page"]
    return fold_groups(f, page, page, ["x1", "region_id"], [*FEATURES, "texts", "pattern"], join_page, DECISION).select(*REGION, *DECISION)


def merge_side_by_side(cells: DataFrame, boxes: DataFrame, page_text: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Cells with side-by-side regions joined, and the decisions (doc_id, page, left_id, right_id, ord, tier, merged, direction, reason), page by page from left to right.

    A region joined to the one on its left gives it its data rows, and the next is judged against the region so grown:
    its header, its columns with those rows, its box and its numbers.
    """
    groups = materialize(decide_regions(materialize(region_features(cells, boxes)), page_text))
    body = cells.join(groups.select(*REGION, "slot", "place"), REGION).where("place = 1 OR NOT is_header")
    number = F.dense_rank().over(Window.partitionBy("doc_id", "page", "slot").orderBy("place", "row_idx")) - 1
    out = body.withColumn("row_idx", number).drop("region_id", "place").withColumnRenamed("slot", "region_id")
    line = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("slot", "place"))
    decided = groups.withColumn("ord", line - 1).where("left_id IS NOT NULL")
    return out, decided.select("doc_id", "page", "left_id", F.col("region_id").alias("right_id"), "ord", "tier", "merged", "direction", "reason")


def merge_report(decisions: DataFrame) -> DataFrame:
    """Totals of the decisions by document; confirmed_direction is that of its last merge."""
    last = F.max_by("direction", F.when(F.col("merged"), F.struct("page", "ord")))
    return decisions.groupBy("doc_id").agg(
        F.count("*").alias("decisions"), F.count_if("merged").alias("merged"), F.count_if(F.col("tier") == SEQUENCE).alias("sequence_confirmed"), F.count_if(F.col("tier") == HEURISTIC).alias("heuristic"),
        F.count_if(F.col("tier") == AMBIGUOUS).alias("flagged_ambiguous"), F.when(F.bool_or("merged"), last).otherwise(NONE).alias("confirmed_direction"))


def merge_warnings(decisions: DataFrame) -> DataFrame:
    """(doc_id, kind, page, message) of pairs that may be one table and were left apart."""
    return decisions.where(F.col("tier") == AMBIGUOUS).select("doc_id", F.lit("table-merge-ambiguous").alias("kind"), "page", F.concat(F.lit("possible split table, not auto-merged: "), "reason").alias("message"))


def region_ids(pages: DataFrame) -> DataFrame:
    """(doc_id, page, n_regions, base) of pages with regions, ascending or by `ord` where pages have one: region k of a page has id base + k.

    pages: doc_id, page, n_regions, text_top, text_bottom. A page carries on the ids of the page just before unless text
    stands between; otherwise ids move on by that page's regions.
    """
    line = Window.partitionBy("doc_id").orderBy("ord" if "ord" in pages.columns else "page")
    p = pages.where("n_regions > 0").withColumn("_page", F.lag("page").over(line)).withColumn("_n", F.lag("n_regions").over(line)).withColumn("_low", F.lag("text_bottom").over(line))
    bump = F.when(F.col("_page").isNull(), 0).when((F.col("page") > F.col("_page") + 1) | F.col("text_top") | F.col("_low"), F.col("_n")).otherwise(0)
    return p.withColumn("base", F.sum(bump).over(line.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_page", "_n", "_low")
