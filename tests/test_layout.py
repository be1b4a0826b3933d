"""Layout operators on the cases of the fixtures list."""

import io
import math

import pytest
from pyspark.sql import functions as F

from gridloom.functions.folds import cluster_rows, start_clusters
from gridloom.model import TEXT_ITEMS, Options
from gridloom.operators import grid, headers, layout, merge, metrics, policy, render, tiers
from gridloom.plans.convert import Supplied, convert, convert_items, convert_pages
from gridloom.sources import xlsx


def items(spark, rows, page=0):
    """(x, y, width, text) items on one page of the default test size."""
    full = [(0, page, i, "Text", r[3] if len(r) > 3 else f"t{i}", float(r[0]), float(r[1]), float(r[2]), 12.0, False) for i, r in enumerate(rows)]
    frame = (0, page, len(full), "Frame", "", 0.0, 0.0, 551.7 - 36, 792.0 - 36, False)
    return spark.createDataFrame([*full, frame], TEXT_ITEMS)


def sizes(df):
    return [r["items"] for r in layout.region_extents(layout.discover_regions(df)).orderBy("region_idx").collect()]


def test_coordinates(spark):
    df = layout.with_page_size(items(spark, [(100, 700, 50)])).where("item_type = 'Text'").withColumn("page_height", F.lit(792.0)).withColumn("b", layout.item_bbox())
    assert tuple(df.first()["b"]) == (100.0, 80.0, 150.0, 92.0)


def test_even_columns_are_one_region(spark):
    assert sizes(items(spark, [(x, y, 60) for y in (700, 680) for x in (50, 200, 350)])) == [6]
    assert sizes(items(spark, [(25 * i, 700, 20) for i in range(20)])) == [20]
    assert sizes(items(spark, [(10, 700, 20)])) == [1]


def test_wide_gutters_split(spark):
    x, row = 20.0, []
    for gap in (14, 14.45, 10.92, 23.93, 37.95, 13.76, 21.96, 10.92, 22.14):
        row.append((x, 700, 2))
        x += 2 + gap
    assert sizes(items(spark, [*row, (x, 700, 2)])) == [5, 5]


def test_rows():
    fold = lambda ys: cluster_rows({"top_y": ys, "height": [12.0] * len(ys)})["row_idx"]
    assert fold([91, 92, 93]) == [0, 0, 0]
    assert fold([92, 122, 152]) == [0, 1, 2]


def test_fallback_starts():
    fold = lambda xs, rows: start_clusters({"x": sorted(xs), "row_idx": list(range(rows)) * (len(xs) // rows)})["starts"][0]
    assert fold([50, 150, 250] * 3, 3) == [50, 150, 250]
    assert fold([350, 354] * 2, 2) == [350, 354]


@pytest.mark.parametrize("starts,cases", [([50.0, 150.0, 250.0], {55: 0, 160: 1, 260: 2}), ([350.0, 400.0], {365: 0, 380: 1})])
def test_assign_by_starts(spark, starts, cases):
    df = spark.createDataFrame([(float(x), starts) for x in cases], "x double, starts array<double>")
    assert [r["col_idx"] for r in grid.assign_by_starts(df).collect()] == list(cases.values())


@pytest.mark.parametrize("seen,want", [([5, 5], 0), ([5, 5, 5, 5, 3], 5), ([1, 0, 4, 4, 4], 4), ([3, 3, 5, 5], 5)])
def test_column_count_model(spark, seen, want):
    df = spark.createDataFrame([(0, i, n) for i, n in enumerate(seen)], "doc_id int, ord int, n int")
    assert grid.column_counts_model(df).orderBy("ord").collect()[-1]["expected"] == want


def cells(spark, rows):
    """(page, region, row, is_header, texts)."""
    return spark.createDataFrame([(0, p, r, i, h, c, t) for p, r, i, h, texts in rows for c, t in enumerate(texts)], "doc_id int, page int, region_id int, row_idx int, is_header boolean, col_idx int, text string")


def lines(df):
    return [(r["page"], r["region_id"], r["values"]) for r in render.row_values(df).orderBy("page", "region_id", "row_idx").collect()]


def test_two_line_header(spark):
    c = cells(spark, [(0, 0, 0, True, ["Contract", "Outstanding Dues", ""]), (0, 0, 1, True, ["No", "(April-26)", ""]), (0, 0, 2, False, ["1", "2", "3"])])
    assert lines(headers.reconstruct_headers(c)) == [(0, 0, ["Contract No", "Outstanding Dues (April-26)"]), (0, 0, ["1", "2", "3"])]
    assert headers.joined_labels(c).first()["labels"] == ["Contract No", "Outstanding Dues (April-26)", ""]


def literal_filter(rows):
    """The stateful rule, row by row in document order."""
    norm = lambda t: " ".join(t.lower().split())
    canon, emitted, out = None, [], []
    sig = lambda r: "|".join(p for p in map(norm, r[4]) if p)
    for r in rows:
        if canon is None and r[3]:
            canon = r
    if canon is None or not sig(canon):
        return rows
    canon_parts = {p for p in map(norm, canon[4]) if p}
    for r in rows:
        parts = {p for p in map(norm, r[4]) if p}
        local = {sig(x) for x in rows if x[3] and x[:2] == r[:2]}
        repeat = bool(parts) and any(parts <= e for e in emitted) or bool(emitted) and bool(parts) and parts <= canon_parts
        if not (sig(r) == sig(canon) or sig(r) in local or repeat):
            out.append(r)
        elif r[3] and not repeat:
            emitted.append(parts or {""})
            out.append(r)
    return out


def test_header_filter_is_the_stateful_rule(spark):
    import random

    rng = random.Random(1)
    for _ in range(6):
        rows = [(p, g, i, i == 0 and rng.random() < 0.8, [rng.choice(["A", "b ", "C", "", "x"]) for _ in range(3)]) for p in range(4) for g in range(2) for i in range(4)]
        got = lines(headers.filter_headers(cells(spark, rows)))
        assert [x[:2] for x in got] == [r[:2] for r in literal_filter(rows)]


def test_sequences(spark):
    c = cells(spark, [(0, 0, i, False, ["x", str(i + 1)]) for i in range(3)] + [(0, 1, i, False, [f"{4 + i},000", "y"]) for i in range(3)])
    assert [tuple(r)[2:] for r in merge.sequence_columns(c).collect()] == [(0, 1, 1, 3)]


def region(k, first=None, sig="x|y", col=0, box=None, n_cols=2):
    """A region of three data rows whose numbers start at `first`."""
    x1, y1, x2, y2 = box or (100.0 * k, 0.0, 100.0 * k + 80, 90.0)
    runs = [] if first is None else [{"col_idx": col, "n": 3, "k": 3, "ones": 2, "steps": 2, "first": first, "last": first + 2}]
    return {"region_id": k, "x1": x1, "y1": y1, "x2": x2, "y2": y2, "n_cols": n_cols, "data_cols": n_cols, "header_sig": sig, "n_rows": 3, "runs": runs}


def joined(regions, texts=(), pattern=True):
    group = {c: [r[c] for r in regions] for c in merge.FEATURES} | {"texts": [list(texts)] * len(regions), "pattern": [pattern] * len(regions)}
    out = merge.join_page(group)
    return list(zip(out["slot"], out["tier"], out["reason"], strict=True))[1:]


def test_decisions():
    seq, rule, unsure = merge.SEQUENCE, merge.HEURISTIC, merge.AMBIGUOUS
    assert joined([region(0, 1), region(1, 4)]) == [(0, seq, "sequence-continues")]
    assert joined([region(0, 1), region(1, 14)]) == [(1, seq, "parallel-sequence")]
    assert joined([region(0, 1), region(1, 9)]) == [(0, rule, "pattern")]
    assert joined([region(0, 1), region(1, 9)], pattern=False) == [(1, unsure, "no-pattern")]
    # numbers in different columns say nothing
    assert joined([region(0, 1), region(1, 400, col=1)]) == [(0, rule, "pattern")]
    # without a header on the left nothing is joined
    assert joined([region(0, 1, sig=""), region(1, 4, sig="")]) == [(1, unsure, "header-mismatch")]
    assert joined([region(0, 1), region(1, 4, sig="", n_cols=3)]) == [(1, unsure, "header-mismatch")]
    assert joined([region(0, 1), region(1, 4, box=(100.0, 90.0, 180.0, 120.0))]) == [(1, unsure, "no-vertical-overlap")]


def test_decisions_look_at_the_grown_region():
    """Its header is the first's, its numbers go on in the second, its box is that of both."""
    assert [r for *_, r in joined([region(0, 1), region(1, 4, sig=""), region(2, 7)])] == ["sequence-continues"] * 2
    assert [r for *_, r in joined([region(0, 1), region(1, 4, box=(100.0, 0.0, 180.0, 20.0)), region(2, 7, box=(200.0, 30.0, 280.0, 60.0))])] == ["sequence-continues"] * 2
    assert [s for s, *_ in joined([region(0, 1), region(1, 50), region(2, 53)])] == [1, 1]


def test_text_and_captions():
    text = lambda x, y, t: {"x1": x, "y1": y, "x2": x + 10.0, "y2": y + 8.0, "text": t}
    assert joined([region(0, 1), region(1, 4)], [text(85.0, 40.0, "note")]) == [(1, merge.AMBIGUOUS, "intervening-text")]
    heads = [text(10.0, -20.0, "north"), text(120.0, -20.0, "south")]
    assert joined([region(0), region(1)], heads) == [(1, merge.AMBIGUOUS, "captions-differ")]
    assert joined([region(0), region(1)], [heads[0]]) == [(0, merge.HEURISTIC, "pattern")]
    assert joined([region(0), region(1)], [text(10.0, -60.0, "north"), heads[1]]) == [(0, merge.HEURISTIC, "pattern")]


def test_merge_of_cells(spark):
    """Data rows go below the first region's; the report and the warnings tell of it."""
    head = lambda g: (0, g, 0, True, ["No", "Who"])
    c = cells(spark, [head(0), *((0, 0, i, False, [str(i), "a"]) for i in (1, 2, 3)), *((0, 1, i - 4, False, [str(i), "b"]) for i in (4, 5, 6)), head(2), *((0, 2, i, False, ["x", str(i)]) for i in (1, 2, 3))])
    boxes = spark.createDataFrame([(0, 0, g, 100.0 * g, 0.0, 100.0 * g + 80, 90.0 if g < 2 else 40.0) for g in range(3)], "doc_id int, page int, region_id int, x1 double, y1 double, x2 double, y2 double")
    between = spark.createDataFrame([(0, 0, 185.0, 10.0, 190.0, 20.0, "A note")], "doc_id int, page int, x1 double, y1 double, x2 double, y2 double, text string")
    out, decided = merge.merge_side_by_side(c, boxes, between)
    got = {}
    for r in out.orderBy("region_id", "row_idx", "col_idx").collect():
        got.setdefault(r["region_id"], []).append(r["text"])
    assert got[0] == ["No", "Who", "1", "a", "2", "a", "3", "a", "4", "b", "5", "b", "6", "b"] and got[1][:2] == ["No", "Who"]
    assert [(r["left_id"], r["right_id"], r["reason"]) for r in decided.orderBy("ord").collect()] == [(0, 1, "sequence-continues"), (0, 2, "intervening-text")]
    assert tuple(merge.merge_report(decided).first()) == (0, 2, 1, 1, 0, 1, merge.STACKED)
    assert [tuple(r) for r in merge.merge_warnings(decided).collect()] == [(0, "table-merge-ambiguous", 0, "possible split table, not auto-merged: intervening-text")]


def test_page_order_and_repeats(spark):
    parts = [items(spark, [(40 + 150 * c, 700 - 20 * i, 60, t) for i, r in enumerate([("Name", "Amount"), (f"p{p}", str(p)), (f"q{p}", str(p))]) for c, t in enumerate(r)], page=p) for p in (0, 1)]
    out = convert_items(parts[0].unionByName(parts[1]), Options(page_numbers=(1, 0, 1), worksheet_policy="stacked", keep_repeated_headers=True))
    rows = out.sheet_rows.where("kind = 'row' AND NOT is_header").orderBy("row_no").collect()
    assert [(r["page_no"], r["values"][0]) for r in rows] == [(2, "p1"), (2, "q1"), (1, "p0"), (1, "q0"), (2, "p1"), (2, "q1")]


def test_rows_without_height():
    assert cluster_rows({"top_y": [0.0, 3.0, 5.0], "height": [0.0] * 3})["row_idx"] == [0, 1, 2]


def test_text_of_mixed_heights(spark):
    rows = [(0, 0, 0, "a", 0.0, 0.0, 10.0, 20.0), (0, 0, 1, "b", 13.0, 9.0, 5.0, 2.0), (0, 0, 2, "c", 18.9, 9.0, 5.0, 0.0), (0, 0, 3, "d", 24.0, 9.0, 5.0, 0.0), (0, 0, 4, "e", 40.0, 10.0, 5.0, 0.0)]
    df = spark.createDataFrame(rows, "doc_id int, page int, seq int, text string, x double, y double, width double, height double")
    assert metrics.reconstruct_text(df).first()["text"] == "ab cd\ne"


def test_layout_pages_ocr_and_size(spark):
    df = items(spark, [(10, 700, 20)])
    pages = layout.page_list(df, (0, 3))
    scanned = {r["page"]: r for r in layout.scan_layout_pages(df.where("item_type = 'Text'"), pages).collect()}
    assert (scanned[0]["text"], scanned[3]["text"], scanned[3]["page_width"], scanned[3]["page_height"]) == ("t0", None, 612.0, 792.0)
    flagged, warnings = layout.ocr_flags(pages, spark.createDataFrame([(0, 3)], "doc_id int, page int"))
    assert sorted((r["page"], r["needs_ocr"]) for r in flagged.collect()) == [(0, False), (3, True)] and [(r["kind"], r["page"]) for r in warnings.collect()] == [("needs-ocr", 3)]


def test_grid_boxes(spark):
    c = spark.createDataFrame([(0, 0, 0, r, k) for r in range(2) for k in range(4)], "doc_id int, page int, region_id int, row_idx int, col_idx int")
    b = spark.createDataFrame([(0, 0, 0, 10.0, 20.0, 50.0, 60.0)], "doc_id int, page int, region_id int, x1 double, y1 double, x2 double, y2 double")
    got = {(r["row_idx"], r["col_idx"]): (r["x1"], r["y1"], r["x2"], r["y2"]) for r in tiers.grid_boxes(c, b).collect()}
    assert got[1, 2] == (30.0, 40.0, 40.0, 60.0) and len(got) == 8


def test_region_ids(spark):
    pages = lambda rows: spark.createDataFrame([(0, *r) for r in rows], "doc_id int, page int, n_regions int, text_top boolean, text_bottom boolean")
    ids = lambda rows: [r["base"] for r in merge.region_ids(pages(rows)).orderBy("page").collect()]
    assert ids([(0, 1, False, False), (1, 1, False, False)]) == [0, 0]
    assert ids([(0, 1, False, False), (1, 0, True, True), (2, 1, False, False)]) == [0, 1]


@pytest.mark.parametrize("counts,want", [([2, 2], "per-region"), ([2, 1], "stacked"), ([0], "stacked")])
def test_policy(spark, counts, want):
    df = spark.createDataFrame([(0, i, n) for i, n in enumerate(counts)], "doc_id int, ord int, n_regions int")
    r = policy.resolve_policy(df).first()
    assert r["policy"] == want and (r["warning"] is not None) == (counts == [2, 1])


def test_stacked_has_a_blank_row_between_regions(spark):
    c = cells(spark, [(0, 0, 0, False, ["a"]), (0, 1, 0, False, ["b"])])
    rows = render.stacked(c, c.select(*headers.REGION).distinct()).orderBy("row_no").collect()
    assert [(r["row_no"], r["kind"], r["values"]) for r in rows] == [(1, "row", ["a"]), (2, "separator", []), (3, "row", ["b"])]


def test_markdown(spark):
    text = "# t\n| A | B |\n|---|:---:|\r\n  | 1 | 2 |  \nprose\n|"
    got = spark.createDataFrame([(text,)], "m string").select(tiers.markdown_rows(F.col("m")).alias("r")).first()["r"]
    assert got == [["A", "B"], ["1", "2"], [""]]


def test_plain_pages_keep_their_rows(spark):
    df = convert_pages(spark.createDataFrame([(0, 5, [["A", "B"], ["1"]])], "doc_id int, ord int, rows array<array<string>>"), include_page=True)
    assert [r["v"] for r in df.orderBy("row_no").select(render.full_values(True, False).alias("v")).collect()] == [["1", "A", "B"], ["1", "1"]]


def test_workbooks_read_back(spark, tmp_path):
    odd = ["<&>\"'", " lead", "", "é漢", "bad\x01char", "line\nbreak"]
    rows = spark.createDataFrame([(d, 0, i + 1, "row", False, 1, str(i + 1), odd) for d in (3, 4) for i in range(2)], "doc_id int, sheet_idx int, row_no long, kind string, is_header boolean, page_no int, entry string, values array<string>")
    xlsx.write_workbooks(rows, str(tmp_path / "books"), include_page=True, include_entry=True)
    data = (tmp_path / "books/3.xlsx").read_bytes()
    assert data[:2] == b"PK"
    back = spark.read.format("xlsx").load(str(tmp_path / "books")).collect()
    clean = ["<&>\"'", " lead", "", "é漢", "badchar", "line\nbreak"]
    assert sorted((r["file"], r["row_no"], *r["values"]) for r in back) == sorted((f"{d}.xlsx", i + 1, "1", str(i + 1), *clean) for d in (3, 4) for i in range(2))
    assert xlsx.read_workbook(io.BytesIO(xlsx.to_bytes(rows.where("doc_id = 3"))))[0][1][0] == clean


def test_sheet_names_keep_to_the_format():
    assert xlsx.sheet_names("a/b", 1) == ["a b"]
    assert all(len(n) <= 31 for n in xlsx.sheet_names("x" * 40, 12)) and len(set(xlsx.sheet_names("x" * 40, 12))) == 12


def test_whole_path_ignores_partitions(spark):
    table = [("Name", "Amount"), ("ab", "1"), ("cd", "2"), ("ef", "3"), ("gh", "4")]
    rows = [(40 + 150 * c, 700 - 20 * i, 60, t) for i, r in enumerate(table) for c, t in enumerate(r)]
    df = items(spark, rows)
    want = [list(r) for r in table]
    for d in (df, df.repartition(5)):
        out = convert_items(d, Options(worksheet_policy="stacked"))
        assert [r["values"] for r in out.sheet_rows.orderBy("row_no").collect()] == want
    assert out.diagnostics.first()["total_rows"] == 5


def test_coverage_of_nothing_is_zero(spark):
    none = metrics.token_multiset(spark.createDataFrame([("",)], "text string"), "text")
    r = metrics.coverage(none, none).first()
    assert (r["recall"], r["precision"], r["f1"]) == (0.0, 0.0, 0.0) and not math.isnan(r["f1"])


TABLE = [("Name", "Amount"), ("ab", "1"), ("cd", "2"), ("ef", "3"), ("gh", "4")]


def small_table(spark, pages=1):
    out = None
    for p in range(pages):
        df = items(spark, [(40 + 150 * c, 700 - 20 * i, 60, t) for i, r in enumerate(TABLE) for c, t in enumerate(r)], p)
        out = df if out is None else out.unionByName(df)
    return out


def test_supplied_tables_replace_text_only_if_complete(spark):
    """Page 0: a grid. 1: a grid without a word and whole markdown. 2: narrow markdown. 3: markdown detection failed. 4: a page for OCR."""
    grid_cells = [(0, p, 0, i, c, f" {t} ", i == 0) for p in (0, 1) for i, r in enumerate(TABLE) for c, t in enumerate(r) if (p, i, c) != (1, 2, 0)]
    text = "\n".join("| " + " | ".join(r) + " |" for r in TABLE)
    narrow = "| Name |\n" + text.split("\n", 1)[1] + "\n| Amount | |"
    given = Supplied(
        spark.createDataFrame(grid_cells, "doc_id int, page int, region_id int, row int, col int, text string, is_header boolean"),
        spark.createDataFrame([(0, 1, 0, text, False), (0, 2, 0, narrow, False), (0, 3, 0, text, False), (0, 4, 0, text, True)], "doc_id int, page int, region_id int, text string, needs_ocr boolean"),
        spark.createDataFrame([(0, 3, 0, tiers.TABLES)], "doc_id int, page int, region_id int, tier string"),
    )
    out = convert_items(small_table(spark, 5), Options(extraction="auto", worksheet_policy="stacked", keep_repeated_headers=True), given=given)
    assert {r["page"]: r["source"] for r in out.regions.collect()} == {0: tiers.GRID, 1: tiers.TABLES, 2: "clustered", 3: "clustered", 4: "clustered"}
    assert sorted((r["kind"], r["page"], r["message"]) for r in out.warnings.collect()) == [("tier-fallback", 3, "region-tables failed"), ("tier-incomplete", 1, "vector-grid-cells lacks 1 words (10.0%)")]
    assert [r["values"] for r in out.sheet_rows.where("kind = 'row'").orderBy("row_no").collect()] == [list(r) for r in TABLE] * 5
    assert out.diagnostics.first()["tier_counts"] == {tiers.GRID: 1, tiers.TABLES: 1, "clustered": 3}
    plain = convert_items(small_table(spark, 5), Options(worksheet_policy="stacked"), given=given)
    assert {r["source"] for r in plain.regions.collect()} == {"clustered"} and plain.warnings.count() == 0


def test_candidates_of_regions_without_words_are_complete(spark):
    place = "doc_id int, page int, region_id int"
    base = spark.createDataFrame([(0, 0, 0, 0, 0, "--", False, 0.7)], place + ", row_idx int, col_idx int, text string, is_header boolean, confidence double")
    given = spark.createDataFrame([(0, 0, 0, 0, 0, "- -", False)], place + ", row int, col int, text string, is_header boolean")
    none = spark.createDataFrame([], place + ", text string, needs_ocr boolean")
    cells, sources, warnings = tiers.choose_tier(base, given, none, spark.createDataFrame([(0, 0, 0, 0)], place + ", expected int"))
    assert sources.first()["source"] == tiers.GRID and cells.first()["text"] == "- -" and warnings.count() == 0


def test_expected_columns(spark):
    """Three regions of two columns teach the document two; its last, of one column, is expected to have two as well."""
    last = items(spark, [(40, 700 - 20 * i, 60, t) for i, t in enumerate(("Name", "ab", "1"))], 3)
    got = grid.expected_columns(grid.region_rows(small_table(spark, 3).unionByName(last))).collect()
    assert {r["page"]: r["expected"] for r in got} == {0: 2, 1: 2, 2: 2, 3: 2}


def test_titles_outside_text_and_plain_pages(spark):
    given = Supplied(
        titles=spark.createDataFrame([(0, 0, 0, "A title")], "doc_id int, page int, rank int, text string"),
        outside=spark.createDataFrame([(0, 0, "n" * 60, False), (0, 0, "near", True)], "doc_id int, page int, text string, assigned boolean"),
        plain=spark.createDataFrame([(0, 1, [["Name", "Amount"], ["ij", "5"]])], "doc_id int, page int, rows array<array<string>>"),
    )
    for policy_name in ("stacked", "per-region"):
        out = convert_items(small_table(spark), Options(worksheet_policy=policy_name), given=given)
        got = [(r["kind"], r["values"]) for r in out.sheet_rows.where("kind != 'separator'").orderBy("sheet_idx", "row_no").collect()]
        assert got == [("title", ["A title"]), *(("row", list(r)) for r in TABLE), ("row", ["ij", "5"])]
        assert [(r["kind"], r["message"][-50:]) for r in out.warnings.collect()] == [("unassigned-text", "n" * 50)]
        d = out.diagnostics.first()
        assert (d["total_pages"], d["total_regions"], d["unassigned_text_items"]) == (2, 2, 1)


def test_sheets_by_region_without_regions_count_nothing(spark):
    blank = items(spark, [])
    assert convert_items(blank, Options(worksheet_policy="per-region")).diagnostics.first()["total_pages"] == 0
    assert convert_items(blank).diagnostics.first()["total_pages"] == 1


def test_path_by_what_pages_are(spark):
    rows = spark.createDataFrame([(0, 0, [["a", "b"]])], "doc_id int, ord int, rows array<array<string>>")
    text = spark.createDataFrame([(0, 0, "| a | b |")], "doc_id int, ord int, markdown string")
    assert convert(rows).first()["values"] == convert(text, Options(extraction="markdown-legacy")).first()["values"] == ["a", "b"]
    assert [r["values"] for r in convert(small_table(spark), Options(extraction="positions")).sheet_rows.orderBy("row_no").collect()] == [list(r) for r in TABLE]
    with pytest.raises(ValueError):
        convert_items(small_table(spark), Options(extraction="markdown-legacy"))
