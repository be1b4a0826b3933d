"""Registered queries of the layout operators, each with DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions.exprs import numeric
from .model import Options
from .operators import evaluation, grid, headers, layout, merge, metrics, policy, render, tiers
from .plans.convert import Supplied, convert_items, convert_markdown, region_cells
from .sources import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
P = layout.PAGE


def query(sql: str) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A fixture over the tables of `sf_dir`."""
    for name in ("orders", "events", "part"):
        sql = sql.replace(f"FROM {name}", f"FROM parquet.`{sf_dir}/{name}.parquet`")
    return spark.sql(sql)


# Building blocks of the SQL. Gaps, thresholds, regions and rows of a fixture of items.
def gaps_sql(items: str) -> str:
    return f"""i AS ({items}), d AS (SELECT *, greatest(0, max(x+width) OVER (PARTITION BY doc_id,page))+36 AS page_width, greatest(0, max(y+height) OVER (PARTITION BY doc_id,page))+36 AS page_height FROM i),
 g AS (SELECT *, page_height-y AS top_y, x - lag(x+width) OVER (PARTITION BY doc_id,page ORDER BY x,seq) AS gap FROM d WHERE item_type='Text' AND trim(text)<>'')"""


def regions_sql(items: str) -> str:
    return f"""{gaps_sql(items)},
 s AS (SELECT doc_id,page,page_width,gap AS lo, lead(gap) OVER (PARTITION BY doc_id,page ORDER BY gap) AS up FROM g WHERE gap>0),
 c AS (SELECT doc_id,page, greatest((lo+up)/2, page_width*0.04) AS t, row_number() OVER (PARTITION BY doc_id,page ORDER BY up/lo DESC, lo) AS n FROM s WHERE up > page_width*0.04 AND up/lo >= 1.5),
 r AS (SELECT g.*, coalesce(c.t, CAST('Infinity' AS DOUBLE)) AS threshold, CAST(sum(CASE WHEN gap > coalesce(c.t, CAST('Infinity' AS DOUBLE)) THEN 1 ELSE 0 END) OVER (PARTITION BY g.doc_id,g.page ORDER BY x,seq ROWS UNBOUNDED PRECEDING) AS INT) AS region_idx
  FROM g LEFT JOIN c ON c.doc_id=g.doc_id AND c.page=g.page AND c.n=1)"""


def rows_sql(items: str) -> str:
    """The running-mean fold, by a recursion over items in order."""
    return f"""{regions_sql(items)},
 m AS (SELECT doc_id,page,region_idx, 0.6*list_sort(list(height))[CAST(floor(count(*)/2) AS INT)+1] AS tol, list(struct_pack(y:=top_y, x:=x, seq:=seq) ORDER BY top_y,x,seq) AS its FROM r GROUP BY ALL),
 f AS (SELECT doc_id,page,region_idx, its, list_reduce(list_prepend(struct_pack(row_no:=-1, mean:=CAST(0 AS DOUBLE), n:=0, y:=CAST(0 AS DOUBLE), tol:=tol, trace:=CAST([] AS INT[])), list_transform(its, lambda q: struct_pack(row_no:=0, mean:=CAST(0 AS DOUBLE), n:=0, y:=q.y, tol:=CAST(0 AS DOUBLE), trace:=CAST([] AS INT[])))),
  lambda a, b: CASE WHEN a.row_no<0 OR abs(b.y-a.mean)>a.tol THEN struct_pack(row_no:=a.row_no+1, mean:=b.y, n:=1, y:=b.y, tol:=a.tol, trace:=list_append(a.trace, a.row_no+1))
   ELSE struct_pack(row_no:=a.row_no, mean:=(a.mean*a.n+b.y)/(a.n+1), n:=a.n+1, y:=b.y, tol:=a.tol, trace:=list_append(a.trace, a.row_no)) END).trace AS tr FROM m),
 w AS (SELECT doc_id,page,region_idx, unnest(its).seq AS seq, unnest(tr) AS row_idx FROM f)"""


@query("SELECT o_orderkey AS order_key, CAST(o_custkey AS VARCHAR) AS customer, o_orderstatus AS status, o_orderpriority AS priority, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date FROM orders")
def roundtrip_orders_grid(spark, sf_dir):
    """Orders drawn as positioned text and read back by the whole path give the orders."""
    rows = convert_items(table(spark, sf_dir, fx.GRID)).sheet_rows.where("NOT is_header AND kind = 'row'")
    return rows.select(F.col("values")[0].cast("long").alias("order_key"), *(F.col("values")[k + 1].alias(n) for k, n in enumerate(("customer", "status", "priority", "date"))))


@query("SELECT CAST(floor(o_orderkey/600.0) AS INT) AS doc_id, CAST(o_orderkey AS VARCHAR) AS order_key, CAST(o_custkey AS VARCHAR) AS customer, o_orderpriority AS priority, row_number() OVER (PARTITION BY floor(o_orderkey/600.0) ORDER BY o_orderkey) AS entry FROM orders")
def roundtrip_side_by_side_merge(spark, sf_dir):
    """Orders in two blocks side by side are merged by their running numbers, in order."""
    rows = convert_items(table(spark, sf_dir, fx.SIDE_BY_SIDE)).sheet_rows.where("NOT is_header AND kind = 'row'")
    return rows.select("doc_id", F.col("values")[0].alias("order_key"), F.col("values")[1].alias("customer"), F.col("values")[2].alias("priority"), F.col("entry").cast("long").alias("entry"))


@query(f"WITH {gaps_sql(fx.CENTRED)} SELECT doc_id, page, seq, round(gap,6) AS gap FROM g")
def region_gaps(spark, sf_dir):
    return layout.region_gaps(table(spark, sf_dir, fx.CENTRED)).select(*P, "seq", F.round("gap", 6).alias("gap"))


@query(f"WITH {regions_sql(fx.CENTRED)} SELECT DISTINCT doc_id, page, round(threshold,6) AS threshold FROM r")
def region_threshold(spark, sf_dir):
    return layout.region_threshold(layout.region_gaps(table(spark, sf_dir, fx.CENTRED))).select(*P, F.round("threshold", 6).alias("threshold")).distinct()


@query(f"WITH {regions_sql(fx.CENTRED)} SELECT doc_id, page, seq, region_idx FROM r")
def region_assign(spark, sf_dir):
    return layout.discover_regions(table(spark, sf_dir, fx.CENTRED)).select(*P, "seq", "region_idx")


@query(f"WITH {regions_sql(fx.SIDE_BY_SIDE)} SELECT doc_id, page, region_idx, count(*) AS items, min(x) AS x_min, max(x+width) AS x_max, min(top_y-height) AS y_min, max(top_y) AS y_max FROM r GROUP BY ALL")
def region_extents(spark, sf_dir):
    return layout.region_extents(layout.discover_regions(table(spark, sf_dir, fx.SIDE_BY_SIDE)))


@query(f"WITH i AS ({fx.CENTRED}) SELECT doc_id, page, round(greatest(0,max(x+width))+36,6) AS page_width, round(greatest(0,max(y+height))+36,6) AS page_height FROM i GROUP BY ALL")
def page_dimensions(spark, sf_dir):
    return layout.page_dimensions(table(spark, sf_dir, fx.CENTRED)).select(*P, F.round("page_width", 6).alias("page_width"), F.round("page_height", 6).alias("page_height"))


@query(f"WITH {rows_sql(fx.CENTRED)} SELECT doc_id, page, region_idx, seq, row_idx FROM w")
def row_cluster_jitter(spark, sf_dir):
    return grid.rows(layout.discover_regions(table(spark, sf_dir, fx.CENTRED))).select(*P, "region_idx", "seq", "row_idx")


@query(f"WITH {rows_sql(fx.FLAT)} SELECT doc_id, page, region_idx, seq, row_idx FROM w")
def row_cluster_flat(spark, sf_dir):
    """Without heights nothing is tolerated."""
    return grid.rows(layout.discover_regions(table(spark, sf_dir, fx.FLAT))).select(*P, "region_idx", "seq", "row_idx")


@query(f"WITH {rows_sql(fx.DRIFT)} SELECT doc_id, page, region_idx, seq, row_idx FROM w")
def row_cluster_drift(spark, sf_dir):
    """The running mean splits drifting rows that a comparison with the item before would join."""
    return grid.rows(layout.discover_regions(table(spark, sf_dir, fx.DRIFT))).select(*P, "region_idx", "seq", "row_idx")


_RANGES = f"""{rows_sql(fx.GRID)},
 a AS (SELECT r.*, w.row_idx FROM r JOIN w USING (doc_id,page,region_idx,seq)),
 n AS (SELECT *, NOT (regexp_replace(text,'[,.\\s]','','g')<>'' AND NOT regexp_matches(regexp_replace(text,'[,.\\s]','','g'),'^[0-9]+$')) AS num FROM a),
 h AS (SELECT * FROM (SELECT *, min(CASE WHEN num THEN row_idx END) OVER (PARTITION BY doc_id,page,region_idx) AS stop FROM n) WHERE stop IS NULL OR row_idx<stop),
 b AS (SELECT *, CASE WHEN x > max(x+width) OVER (PARTITION BY doc_id,page,region_idx ORDER BY x,x+width,seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)+3 THEN 1 ELSE 0 END AS cut FROM h),
 e AS (SELECT *, sum(cut) OVER (PARTITION BY doc_id,page,region_idx ORDER BY x,x+width,seq ROWS UNBOUNDED PRECEDING) AS span FROM b),
 sp AS (SELECT doc_id,page,region_idx,span,min(x) AS l,max(x+width) AS rr FROM e GROUP BY ALL),
 mid AS (SELECT doc_id,page,region_idx,(rr+lead(l) OVER (PARTITION BY doc_id,page,region_idx ORDER BY l))/2 AS bound FROM sp)"""


@query(f"WITH {_RANGES} SELECT doc_id, page, region_idx, round(bound,6) AS bound FROM mid WHERE bound IS NOT NULL")
def column_ranges(spark, sf_dir):
    rows = grid.rows(layout.discover_regions(table(spark, sf_dir, fx.GRID)))
    return grid.column_bounds(rows).select(*P, "region_idx", F.explode("bounds").alias("bound")).withColumn("bound", F.round("bound", 6))


@query(f"WITH {_RANGES} SELECT a.doc_id, a.page, a.region_idx, a.seq, CAST((SELECT count(*) FROM mid WHERE mid.doc_id=a.doc_id AND mid.page=a.page AND mid.region_idx=a.region_idx AND bound <= a.x+a.width/2) AS INT) AS col_idx FROM a")
def column_assign(spark, sf_dir):
    rows = grid.rows(layout.discover_regions(table(spark, sf_dir, fx.GRID)))
    return grid.assign_columns(rows).select(*P, "region_idx", "seq", F.col("col_idx").cast("int").alias("col_idx"))


@query(f"WITH i AS ({fx.GRID}), c AS (SELECT doc_id, page, CAST(floor(seq/5) AS INT) AS row_idx, text FROM i) SELECT doc_id, page, 0 AS region_idx, row_idx, row_idx=0 AS is_header FROM c GROUP BY ALL")
def header_detect(spark, sf_dir):
    return grid.header_rows(grid.cells(grid.assign_columns(grid.rows(layout.discover_regions(table(spark, sf_dir, fx.GRID))))))


@query(f"""WITH {regions_sql(fx.HEADERLESS)}, o AS (SELECT *, row_number() OVER (PARTITION BY doc_id,page,region_idx ORDER BY x,top_y,seq) AS k FROM r),
 l AS (SELECT doc_id,page,region_idx, list(x ORDER BY k) AS xs FROM o GROUP BY ALL),
 f AS (SELECT doc_id,page,region_idx, list_reduce(list_prepend(struct_pack(mean:=CAST(-1e300 AS DOUBLE), n:=0, done:=CAST([] AS STRUCT(m DOUBLE, n INT)[])), list_transform(list_append(xs, CAST(1e300 AS DOUBLE)), lambda v: struct_pack(mean:=v, n:=1, done:=CAST([] AS STRUCT(m DOUBLE, n INT)[])))),
  lambda a, b: CASE WHEN b.mean-a.mean <= 3 THEN struct_pack(mean:=(a.mean*a.n+b.mean)/(a.n+1), n:=a.n+1, done:=a.done) ELSE struct_pack(mean:=b.mean, n:=1, done:=CASE WHEN a.n=0 THEN a.done ELSE list_append(a.done, struct_pack(m:=a.mean, n:=a.n)) END) END).done AS cl FROM l),
 q AS (SELECT f.doc_id,f.page,f.region_idx, unnest(cl).m AS m, unnest(cl).n AS n FROM f)
 SELECT doc_id, page, region_idx, round(m,6) AS start, n AS members FROM q""")
def fallback_columns(spark, sf_dir):
    """Clusters of left edges of regions without a header, with their sizes: the fold by itself."""
    items = layout.discover_regions(table(spark, sf_dir, fx.HEADERLESS)).withColumn("row_idx", F.lit(0))
    from .functions.folds import fold_groups

    def all_clusters(g):
        found = []
        for x in g["x"]:
            if found and x - found[-1][0] <= 3:
                found[-1] = [(found[-1][0] * found[-1][1] + x) / (found[-1][1] + 1), found[-1][1] + 1]
            else:
                found.append([x, 1])
        return {"starts": [[m for m, _ in found]] * len(g["x"]), "sizes": [[float(n) for _, n in found]] * len(g["x"])}

    kept = fold_groups(items, P, layout.REGION, ["x", "top_y", "seq"], ["x"], all_clusters, {"starts": "array<double>", "sizes": "array<double>"})
    one = kept.groupBy(*layout.REGION).agg(F.first("starts").alias("s"), F.first("sizes").alias("n"))
    pairs = one.select(*layout.REGION, F.explode(F.arrays_zip("s", "n")).alias("z"))
    return pairs.select(*P, "region_idx", F.round("z.s", 6).alias("start"), F.col("z.n").cast("int").alias("members"))


@query(f"""WITH p AS ({fx.PAGES}), c AS (SELECT a.doc_id, a.ord, b.observed AS n, count(*) AS k FROM p a JOIN p b ON a.doc_id=b.doc_id AND b.ord<=a.ord AND b.observed>=2 GROUP BY ALL),
 t AS (SELECT doc_id, ord, sum(k) AS seen, arg_max(n, k*100+n) AS mode FROM c GROUP BY ALL)
 SELECT p.doc_id, p.ord, CAST(CASE WHEN coalesce(t.seen,0)>=3 THEN t.mode ELSE 0 END AS INT) AS expected FROM p LEFT JOIN t USING (doc_id, ord)""")
def column_count_mode(spark, sf_dir):
    return grid.column_counts_model(table(spark, sf_dir, fx.PAGES).select("doc_id", "ord", F.col("observed").alias("n")))


def _norm(c: str) -> str:
    return f"lower(trim(regexp_replace({c},'\\s+',' ','g')))"


@query(f"SELECT doc_id, page, region_id, array_to_string(list_filter([{_norm('t0')},{_norm('t1')},{_norm('t2')}], lambda t: t<>''),'|') AS header_sig FROM ({fx.HEADER_ROWS}) e WHERE is_header")
def header_block_signature(spark, sf_dir):
    return headers.header_block_signature(table(spark, sf_dir, fx.HEADER_CELLS))


@query(f"SELECT doc_id, page, row_idx, array_to_string(list_filter([{_norm('t0')},{_norm('t1')},{_norm('t2')}], lambda t: t<>''),'|') AS sig FROM ({fx.HEADER_ROWS}) e")
def row_signature(spark, sf_dir):
    return headers.row_parts(table(spark, sf_dir, fx.HEADER_CELLS)).select(*P, "row_idx", "sig")


@query(f"SELECT doc_id, list_aggregate([t0,t1,t2],'string_agg','|') AS canonical FROM ({fx.HEADER_ROWS}) e WHERE is_header AND page=0")
def header_canonical(spark, sf_dir):
    return headers.canonical_labels(table(spark, sf_dir, fx.HEADER_CELLS)).select("doc_id", F.array_join("canonical", "|").alias("canonical"))


@query(f"""SELECT doc_id, page, row_idx, is_header, col_idx, trim(text) AS text FROM ({fx.HEADER_CELLS}) e WHERE NOT (is_header AND trim(text)='')""")
def header_multiline_join(spark, sf_dir):
    return headers.reconstruct_headers(table(spark, sf_dir, fx.HEADER_CELLS)).select(*P, "row_idx", "is_header", "col_idx", F.trim("text").alias("text"))


# The stateful rule as a recursion over the header rows of a document; a page's data rows see what stood before them.
_FILTER = f"""WITH RECURSIVE e AS (SELECT doc_id, page, row_idx, is_header, list_filter([{_norm('t0')},{_norm('t1')},{_norm('t2')}], lambda t: t<>'') AS parts, page*1000+row_idx AS pos FROM ({fx.HEADER_ROWS}) x),
 hd AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM e WHERE is_header),
 cn AS (SELECT doc_id, parts AS canon FROM hd WHERE k=1),
 st AS (SELECT hd.doc_id, hd.k, hd.pos, [struct_pack(pos:=hd.pos, parts:=hd.parts)] AS emitted, true AS kept FROM hd WHERE k=1
  UNION ALL SELECT hd.doc_id, hd.k, hd.pos, CASE WHEN cov THEN st_emitted ELSE list_append(st_emitted, struct_pack(pos:=hd.pos, parts:=hd.parts)) END, NOT cov FROM (
   SELECT hd.*, st.emitted AS st_emitted, list_has_all(cn.canon, hd.parts) OR len(list_filter(st.emitted, lambda q: list_has_all(q.parts, hd.parts)))>0 AS cov FROM st JOIN hd ON hd.doc_id=st.doc_id AND hd.k=st.k+1 JOIN cn ON cn.doc_id=hd.doc_id) hd),
 fin AS (SELECT doc_id, arg_max(emitted, k) AS emitted FROM st GROUP BY doc_id)
 SELECT e.doc_id, e.page, e.row_idx, e.is_header FROM e JOIN fin USING (doc_id) JOIN cn USING (doc_id) LEFT JOIN hd l ON l.doc_id=e.doc_id AND l.page=e.page
 WHERE CASE WHEN e.is_header THEN len(list_filter(emitted, lambda q: q.pos=e.pos))>0
  ELSE NOT (e.parts=cn.canon OR e.parts=l.parts OR (len(e.parts)>0 AND (len(list_filter(emitted, lambda q: q.pos<e.pos AND list_has_all(q.parts, e.parts)))>0 OR (len(list_filter(emitted, lambda q: q.pos<e.pos))>0 AND list_has_all(cn.canon, e.parts))))) END"""


@query(_FILTER)
def header_filter_document(spark, sf_dir):
    return headers.filter_headers(table(spark, sf_dir, fx.HEADER_CELLS)).select(*P, "row_idx", "is_header").distinct()


@query(f"SELECT doc_id, page, row_idx, row_number() OVER (PARTITION BY doc_id ORDER BY page,row_idx) AS serial FROM ({fx.HEADER_ROWS}) e WHERE NOT is_header")
def serial_renumber(spark, sf_dir):
    return headers.renumber(table(spark, sf_dir, fx.HEADER_CELLS)).select(*P, "row_idx", "serial")


@query("""WITH o AS (SELECT CAST(floor(o_orderkey/600.0) AS INT) AS doc_id, CAST(floor((o_orderkey%600)/24.0) AS INT) AS page, CAST(floor((o_orderkey%24)/12.0) AS INT) AS region_id, o_orderkey FROM orders)
 SELECT doc_id, page, region_id, 0 AS col_idx, min(o_orderkey) AS first, max(o_orderkey) AS last FROM o GROUP BY ALL HAVING count(*)>=3""")
def sequence_column(spark, sf_dir):
    s = merge.sequence_columns(region_cells(table(spark, sf_dir, fx.SIDE_BY_SIDE))[0])
    return s.select(*headers.REGION, F.col("col_idx").cast("int").alias("col_idx"), F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"))


@query(f"""SELECT doc_id, avg(CASE WHEN sig_equal AND vertical_overlap THEN 1.0 ELSE 0.0 END)>=0.5 AS pattern FROM ({fx.PAIRS}) p GROUP BY doc_id""")
def side_by_side_pattern(spark, sf_dir):
    p = table(spark, sf_dir, fx.PAIRS)
    side = lambda n: p.select("doc_id", F.col("pair_id").alias("page"), F.lit(n).alias("region_id"), F.lit(100.0 * n).alias("x1"), F.when(F.lit(n == 0) | F.col("vertical_overlap"), 0.0).otherwise(200.0).alias("y1"), F.when(F.lit(n == 0) | F.col("vertical_overlap"), 100.0).otherwise(300.0).alias("y2"), F.when(F.lit(n == 0) | F.col("sig_equal"), "a|b").otherwise("c").alias("header_sig"), F.lit(2).alias("n_cols"))
    return merge.side_by_side_pattern(merge.side_by_side_pages(side(0).unionByName(side(1))))


_DECIDED = f"""WITH p AS (SELECT *, pair_id%17<>0 AS same_col, first_right-last_left AS ahead, avg(CASE WHEN vertical_overlap AND sig_equal THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY doc_id)>=0.5 AS pattern FROM ({fx.PAIRS}) q),
 r AS (SELECT *, CASE WHEN NOT vertical_overlap THEN 'no-vertical-overlap' WHEN text_between THEN 'intervening-text' WHEN NOT sig_equal THEN 'header-mismatch' WHEN same_col AND ahead<=3 THEN 'sequence-continues'
  WHEN same_col AND ahead>10 THEN 'parallel-sequence' WHEN cap_left<>cap_right THEN 'captions-differ' WHEN pattern THEN 'pattern' ELSE 'no-pattern' END AS reason FROM p),
 d AS (SELECT doc_id, pair_id, reason, CASE WHEN reason IN ('sequence-continues','parallel-sequence') THEN 'sequence-confirmed' WHEN reason='pattern' THEN 'heuristic' ELSE 'flagged-ambiguous' END AS tier, reason IN ('sequence-continues','pattern') AS merged,
  CASE WHEN reason IN ('sequence-continues','pattern') THEN 'stack-right-under-left' WHEN reason='parallel-sequence' THEN 'parallel-end-to-end' ELSE 'none' END AS direction FROM r)"""


def _decided_pairs(spark, sf_dir) -> DataFrame:
    """Two regions for each pair of the fixture, with boxes, numbers, captions and texts between, and what is decided of them."""
    p = table(spark, sf_dir, fx.PAIRS).withColumn("page", F.col("pair_id"))
    num = lambda c: F.col(c).cast("decimal(38,0)")
    run = lambda col, rows, first, last: F.array(F.struct(col.cast("int").alias("col_idx"), *((rows - less).cast("bigint").alias(c) for c, less in (("n", 0), ("k", 0), ("ones", 1), ("steps", 1))), first.cast("decimal(38,0)").alias("first"), last.cast("decimal(38,0)").alias("last")))
    box = lambda x, low: [F.lit(x).alias("x1"), F.when(low, 0.0).otherwise(200.0).alias("y1"), F.lit(x + 100).alias("x2"), F.when(low, 100.0).otherwise(300.0).alias("y2")]
    size = [F.lit(2).alias("n_cols"), F.lit(2).alias("data_cols")]
    left = p.select("doc_id", "page", F.lit(0).alias("region_id"), *box(0.0, F.lit(True)), *size, F.col("n_left").cast("bigint").alias("n_rows"), F.lit("a|b").alias("header_sig"), run(F.lit(0), F.col("n_left"), num("last_left") - F.col("n_left") + 1, num("last_left")).alias("runs"))
    right = p.select("doc_id", "page", F.lit(1).alias("region_id"), *box(200.0, F.col("vertical_overlap")), *size, F.lit(3).cast("bigint").alias("n_rows"), F.when(F.col("sig_equal"), "a|b").otherwise("c").alias("header_sig"), run(F.when(F.col("pair_id") % 17 == 0, 1).otherwise(0), F.lit(3), num("first_right"), num("first_right") + 2).alias("runs"))
    text = lambda x, y, t: F.struct(F.lit(x).alias("x1"), F.lit(y).alias("y1"), F.lit(x + 40).alias("x2"), F.lit(y + 10).alias("y2"), t.alias("text"))
    texts = F.array(F.when(F.col("text_between"), text(130.0, 40.0, F.lit("note"))), F.when(F.col("cap_left") != "", text(10.0, -20.0, F.col("cap_left"))), F.when(F.col("cap_right") != "", text(210.0, -20.0, F.col("cap_right"))))
    beside = p.select("doc_id", "page", F.explode(F.filter(texts, lambda t: t.isNotNull())).alias("t")).select("doc_id", "page", "t.*")
    return merge.decide_regions(left.unionByName(right), beside).where("left_id IS NOT NULL").withColumn("ord", F.col("region_id") - 1)


@query(f"{_DECIDED} SELECT pair_id, tier, merged, direction, reason FROM d")
def merge_decisions(spark, sf_dir):
    return _decided_pairs(spark, sf_dir).select(F.col("page").alias("pair_id"), "tier", "merged", "direction", "reason")


@query(f"""{_DECIDED} SELECT doc_id, count(*) AS decisions, CAST(count_if(merged) AS BIGINT) AS merged, CAST(count_if(tier='sequence-confirmed') AS BIGINT) AS sequence_confirmed, CAST(count_if(tier='heuristic') AS BIGINT) AS heuristic, CAST(count_if(tier='flagged-ambiguous') AS BIGINT) AS flagged_ambiguous,
 coalesce(arg_max(direction, pair_id) FILTER (merged), 'none') AS confirmed_direction FROM d GROUP BY doc_id""")
def merge_report(spark, sf_dir):
    return merge.merge_report(_decided_pairs(spark, sf_dir))


_CHAINS = "SELECT DISTINCT CAST(floor(o_orderkey/300.0) AS INT) AS doc_id, CAST(floor((o_orderkey%300)/3.0) AS INT) AS page FROM orders"


@query(f"""WITH p AS (SELECT *, page%5<>0 AS head, CASE WHEN page%4=0 THEN 3 ELSE 2 END AS n1, CASE WHEN page%7=0 THEN 24 ELSE 4 END AS b1, CASE page%3 WHEN 0 THEN 'a|b' WHEN 1 THEN '' ELSE 'c' END AS sig2, CASE WHEN page%2=0 THEN 1 ELSE 6 END AS ahead2 FROM ({_CHAINS}) c),
 q AS (SELECT *, avg(CASE WHEN head AND n1=2 THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY doc_id)>=0.5 AS pattern, CASE WHEN NOT head OR n1<>2 THEN 'header-mismatch' WHEN b1=4 THEN 'sequence-continues' ELSE 'parallel-sequence' END AS r1 FROM p),
 d AS (SELECT *, CASE WHEN r1<>'sequence-continues' THEN 'no-vertical-overlap' WHEN sig2='c' THEN 'header-mismatch' WHEN ahead2=1 THEN 'sequence-continues' WHEN pattern THEN 'pattern' ELSE 'no-pattern' END AS r2 FROM q),
 u AS (SELECT doc_id, page, 1 AS region_id, r1 AS reason, CASE WHEN r1='sequence-continues' THEN 0 ELSE 1 END AS slot FROM d
  UNION ALL SELECT doc_id, page, 2, r2, (CASE WHEN r1='sequence-continues' THEN 0 ELSE 1 END) + (CASE WHEN r2 IN ('sequence-continues','pattern') THEN 0 ELSE 1 END) FROM d)
 SELECT doc_id, page, region_id, CAST(slot AS INT) AS slot, reason, reason IN ('sequence-continues','pattern') AS merged FROM u""")
def side_by_side_chain(spark, sf_dir):
    """Three regions a page, of which the second has no header and the third meets only what the first two have grown to."""
    p = table(spark, sf_dir, _CHAINS)
    base1 = F.when(F.col("page") % 7 == 0, 24).otherwise(4)
    base2 = base1 + 2 + F.when(F.col("page") % 2 == 0, 1).otherwise(6)
    sig2 = F.when(F.col("page") % 3 == 0, "a|b").when(F.col("page") % 3 == 1, "").otherwise("c")
    parts = [
        (0, 0.0, 100.0, F.lit(2), F.when(F.col("page") % 5 != 0, "a|b").otherwise(""), F.lit(1)),
        (1, 0.0, 30.0, F.when(F.col("page") % 4 == 0, 3).otherwise(2), F.lit(""), base1),
        (2, 40.0, 100.0, F.lit(2), sig2, base2),
    ]
    out = None
    for k, y1, y2, n, sig, first in parts:
        run = F.array(F.struct(F.lit(0).alias("col_idx"), *(F.lit(v).cast("bigint").alias(c) for c, v in (("n", 3), ("k", 3), ("ones", 2), ("steps", 2))), first.cast("decimal(38,0)").alias("first"), (first + 2).cast("decimal(38,0)").alias("last")))
        r = p.select("doc_id", "page", F.lit(k).alias("region_id"), F.lit(100.0 * k).alias("x1"), F.lit(y1).alias("y1"), F.lit(100.0 * k + 90).alias("x2"), F.lit(y2).alias("y2"), n.alias("n_cols"), n.alias("data_cols"), F.lit(3).cast("bigint").alias("n_rows"), sig.alias("header_sig"), run.alias("runs"))
        out = r if out is None else out.unionByName(r)
    return merge.decide_regions(out).where("left_id IS NOT NULL").select("doc_id", "page", "region_id", "slot", "reason", "merged")


@query("""WITH n(ord, page) AS (VALUES (0,1),(1,0),(2,1)), k AS (SELECT o_orderkey AS k, CAST(floor(o_orderkey/500.0) AS INT) AS doc_id, CAST(floor((o_orderkey%500)/25.0) AS INT) AS page FROM orders)
 SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n.ord, k) AS INT) AS place, page+1 AS page_no, k AS order_key FROM k JOIN n USING (page)""")
def page_selection(spark, sf_dir):
    """Pages 1, 0 and 1 again of each document, in that order."""
    rows = convert_items(table(spark, sf_dir, fx.GRID), Options(page_numbers=(1, 0, 1))).sheet_rows.where("NOT is_header AND kind = 'row'")
    return rows.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("sheet_idx", "row_no")).alias("place"), "page_no", F.col("values")[0].cast("long").alias("order_key"))


_PIECES = """SELECT CAST(o_orderkey AS INT) AS doc_id, 0 AS page, 0 AS region_idx, CAST(k AS INT) AS seq, 0 AS row_idx, CAST(k%2 AS INT) AS col_idx, CASE WHEN k<2 THEN '  ' ELSE '' END || o_orderstatus || CAST(k AS STRING) || CASE WHEN k%3=0 THEN '   ' ELSE ' ' END AS text,
 CAST(100-10*k AS DOUBLE) AS x, CAST(50 AS DOUBLE) AS y, CAST(8 AS DOUBLE) AS width, CAST(10 AS DOUBLE) AS height, CAST(100 AS DOUBLE) AS page_height, CAST(50 AS DOUBLE) AS top_y, CAST(0.9 AS DOUBLE) AS confidence FROM orders CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) five"""


@query(f"SELECT doc_id, col_idx, trim(string_agg(text, ' ' ORDER BY x, seq)) AS text FROM ({_PIECES}) p GROUP BY ALL")
def cell_inner_blanks(spark, sf_dir):
    """Blanks at the ends of items stay inside a cell."""
    return grid.cells(table(spark, sf_dir, _PIECES)).select("doc_id", "col_idx", "text")


@query(f"""WITH RECURSIVE p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page) AS k FROM ({fx.PAGES}) q WHERE n_regions>0),
 t AS (SELECT doc_id, page, n_regions, text_bottom, k, 0 AS base FROM p WHERE k=1
  UNION ALL SELECT p.doc_id, p.page, p.n_regions, p.text_bottom, p.k, t.base + CASE WHEN p.page>t.page+1 OR p.text_top OR t.text_bottom THEN t.n_regions ELSE 0 END FROM t JOIN p ON p.doc_id=t.doc_id AND p.k=t.k+1)
 SELECT doc_id, page, n_regions, CAST(base AS INT) AS base FROM t""")
def region_id_continuity(spark, sf_dir):
    return merge.region_ids(table(spark, sf_dir, fx.PAGES)).select(*P, "n_regions", "base")


@query(f"""WITH p AS ({fx.PAGES}), f AS (SELECT doc_id, n_regions, min(ord) AS o FROM p WHERE n_regions>0 GROUP BY ALL), c AS (SELECT doc_id, list(CAST(n_regions AS VARCHAR) ORDER BY o) AS c FROM f GROUP BY doc_id)
 SELECT doc_id, CASE WHEN len(c)>1 THEN 'stacked' ELSE 'per-region' END AS policy, CASE WHEN len(c)>1 THEN 'region-count-unstable: ' || array_to_string(c,', ') END AS warning FROM c""")
def policy_resolve(spark, sf_dir):
    return policy.resolve_policy(table(spark, sf_dir, fx.PAGES))


@query(f"""WITH RECURSIVE p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page) AS k FROM ({fx.PAGES}) q WHERE n_regions>0),
 t AS (SELECT doc_id, page, n_regions, text_bottom, k, 0 AS base FROM p WHERE k=1
  UNION ALL SELECT p.doc_id, p.page, p.n_regions, p.text_bottom, p.k, t.base + CASE WHEN p.page>t.page+1 OR p.text_top OR t.text_bottom THEN t.n_regions ELSE 0 END FROM t JOIN p ON p.doc_id=t.doc_id AND p.k=t.k+1)
 SELECT doc_id, CAST(max(base+n_regions) AS INT) AS sheets FROM t GROUP BY doc_id""")
def sheet_count(spark, sf_dir):
    return policy.sheet_counts(merge.region_ids(table(spark, sf_dir, fx.PAGES)))


def _regions(cells):
    return cells.select(*headers.REGION).distinct()


_VALUES = "t0 || '|' || t1 || '|' || t2"


@query(f"""WITH e AS (SELECT doc_id, page, row_idx, is_header, {_VALUES} AS line FROM ({fx.HEADER_ROWS}) x UNION ALL SELECT DISTINCT doc_id, page, -1, false, NULL FROM ({fx.HEADER_ROWS}) y WHERE page>0)
 SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page,row_idx) AS row_no, CASE WHEN line IS NULL THEN 'separator' ELSE 'row' END AS kind, coalesce(line,'') AS line,
 CASE WHEN line IS NULL THEN NULL WHEN is_header THEN '#' ELSE CAST(count(*) FILTER (line IS NOT NULL AND NOT is_header) OVER (PARTITION BY doc_id ORDER BY page,row_idx) AS VARCHAR) END AS entry FROM e""")
def render_stacked(spark, sf_dir):
    cells = table(spark, sf_dir, fx.HEADER_CELLS)
    return render.stacked(cells, _regions(cells)).select("doc_id", "row_no", "kind", F.array_join("values", "|").alias("line"), "entry")


@query(f"""WITH e AS (SELECT doc_id, page, row_idx, is_header, {_VALUES} AS line, CASE WHEN is_header THEN row_number() OVER (PARTITION BY doc_id, is_header, {_VALUES} ORDER BY page,row_idx) ELSE 1 END AS again FROM ({fx.HEADER_ROWS}) x)
 SELECT doc_id, 0 AS sheet_idx, row_number() OVER (PARTITION BY doc_id ORDER BY page,row_idx) AS row_no, line, is_header FROM e WHERE again=1""")
def render_per_region(spark, sf_dir):
    return render.per_region(table(spark, sf_dir, fx.HEADER_CELLS)).select("doc_id", "sheet_idx", "row_no", F.array_join("values", "|").alias("line"), "is_header")


@query(f"""SELECT doc_id, page+1 AS page_no, row_idx, CASE WHEN is_header THEN '#' ELSE CAST(sum(CASE WHEN is_header THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY page,row_idx) AS VARCHAR) END AS entry FROM ({fx.HEADER_ROWS}) x""")
def entry_numbers(spark, sf_dir):
    cells = table(spark, sf_dir, fx.HEADER_CELLS)
    rows = render.stacked(cells, _regions(cells)).where("kind = 'row'")
    return rows.select("doc_id", "page_no", (F.row_number().over(Window.partitionBy("doc_id", "page_no").orderBy("row_no")) - 1).alias("row_idx"), "entry")


@query(f"""SELECT doc_id, count(DISTINCT page) AS total_pages, count(DISTINCT CASE WHEN page%5=0 THEN page END) AS ocr_pages, count(DISTINCT page) AS total_regions, count(*) AS total_rows, 0 AS unassigned_text_items FROM ({fx.HEADER_ROWS}) x GROUP BY doc_id""")
def diagnostics(spark, sf_dir):
    cells = table(spark, sf_dir, fx.HEADER_CELLS)
    pages = cells.select(*P).distinct().withColumn("needs_ocr", F.col("page") % 5 == 0)
    return policy.diagnostics(pages, _regions(cells).withColumn("source", F.lit("clustered")), render.stacked(cells, _regions(cells))).select("doc_id", "total_pages", "ocr_pages", "total_regions", "total_rows", "unassigned_text_items")


@query("SELECT CAST(p_partkey AS BIGINT) AS doc_id, 1 AS row_no, 'Part|Brand|Size' AS line FROM part UNION ALL SELECT p_partkey, 2, CAST(p_partkey AS VARCHAR) || '|' || trim(p_brand) || '|' || CAST(p_size AS VARCHAR) FROM part")
def markdown_rows(spark, sf_dir):
    pages = table(spark, sf_dir, fx.MARKDOWN).withColumn("ord", F.lit(0))
    return convert_markdown(pages).select("doc_id", F.col("row_no").cast("int").alias("row_no"), F.array_join("values", "|").alias("line"))


_TOKENS = r"SELECT {k} unnest(list_filter(regexp_split_to_array(lower(text),'[^\p{{L}}\p{{N}}]+'), lambda t: t<>'')) AS token FROM {t}"


@query(f"SELECT lang, token, count(*) AS n FROM ({_TOKENS.format(k='lang,', t='documents')}) x GROUP BY ALL")
def token_multiset(spark, sf_dir):
    return metrics.token_multiset(spark.read.parquet(f"{sf_dir}/documents.parquet"), "text", ["lang"])


@query(f"""WITH a AS (SELECT token, count(*) AS n FROM ({_TOKENS.format(k='', t='benchmark')}) x GROUP BY token), b AS (SELECT token, count(*) AS m FROM ({_TOKENS.format(k='', t='documents')}) x GROUP BY token),
 s AS (SELECT CAST(sum(least(coalesce(n,0),coalesce(m,0))) AS BIGINT) AS matched, CAST(sum(n) AS BIGINT) AS reference, CAST(sum(m) AS BIGINT) AS output FROM a FULL JOIN b USING (token))
 SELECT matched, reference, output, round(matched/reference,9) AS recall, round(matched/output,9) AS precision, round(2*(matched/reference)*(matched/output)/((matched/reference)+(matched/output)),9) AS f1 FROM s""")
def coverage_prf(spark, sf_dir):
    read = lambda n: metrics.token_multiset(spark.read.parquet(f"{sf_dir}/{n}.parquet"), "text")
    c = metrics.coverage(read("benchmark"), read("documents"))
    return c.select("matched", "reference", "output", *(F.round(x, 9).alias(x) for x in ("recall", "precision", "f1")))


@query(f"""WITH b AS ({fx.GRID}), w AS (SELECT doc_id, page, token, count(*) AS n, count(*) FILTER (seq%61<>7) AS m FROM (SELECT doc_id, page, seq, unnest(list_filter(regexp_split_to_array(lower(text),'[^\\p{{L}}\\p{{N}}]+'), lambda t: t<>'')) AS token FROM b) x GROUP BY ALL)
 SELECT doc_id, page, CAST(sum(n) AS BIGINT) AS expected, CAST(sum(n-m) AS BIGINT) AS missing, sum(n-m)=0 AS accepted FROM w GROUP BY ALL""")
def content_coverage_gate(spark, sf_dir):
    items = table(spark, sf_dir, fx.GRID)
    return metrics.content_gate(items, items.where("seq % 61 <> 7"), P)


@query(f"""WITH i AS (SELECT *, CASE WHEN height=0 THEN 1 ELSE height END AS h FROM ({fx.MIXED}) m), l AS (SELECT *, lag(seq) OVER w AS ps, y-lag(y) OVER w AS dy, x-lag(x+width) OVER w AS gap, greatest(h, lag(h) OVER w) AS high FROM i WINDOW w AS (PARTITION BY doc_id,page ORDER BY seq))
 SELECT doc_id, page, md5(string_agg(CASE WHEN ps IS NULL THEN '' WHEN abs(dy)>0.5*high THEN chr(10) WHEN gap>0.2*high THEN ' ' ELSE '' END || text, '' ORDER BY seq)) AS digest FROM l GROUP BY ALL""")
def text_reconstruct(spark, sf_dir):
    return metrics.reconstruct_text(table(spark, sf_dir, fx.MIXED)).select(*P, F.md5("text").alias("digest"))


@query(f"""WITH c AS ({fx.HEADER_CELLS}), f AS (SELECT *, trim(text) AS t FROM c WHERE trim(text)<>'') SELECT doc_id, page, CAST(row_idx-min(row_idx) OVER (PARTITION BY doc_id,page) AS INT) AS row_idx, col_idx, t AS text FROM f""")
def grid_trim(spark, sf_dir):
    return metrics.trim_grid(table(spark, sf_dir, fx.HEADER_CELLS), P).select(*P, "row_idx", "col_idx", "text")


@query(f"""WITH g AS ({fx.GRID}) SELECT doc_id, page, count(*) AS cells, count_if(doc_id%3=0 AND seq%50=11) AS different, count_if(doc_id%3=0 AND seq%50=11)=0 AS exact FROM g GROUP BY ALL""")
def grid_compare(spark, sf_dir):
    """The grid read back against one with some cells changed."""
    c = region_cells(table(spark, sf_dir, fx.GRID))[0]
    changed = table(spark, sf_dir, fx.GRID).select(*P, F.floor(F.col("seq") / 5).cast("int").alias("row_idx"), (F.col("seq") % 5).alias("col_idx"), F.when((F.col("doc_id") % 3 == 0) & (F.col("seq") % 50 == 11), F.concat("text", F.lit("?"))).otherwise(F.col("text")).alias("text"))
    return metrics.compare_grids(c.select(*P, "row_idx", "col_idx", "text"), changed, P)


@query("SELECT event_type, count(value) AS n, min(value) AS least, max(value) AS most, round(avg(value),6) AS mean, round(median(value),6) AS median, round(stddev_pop(value),6) AS stdev FROM events GROUP BY event_type")
def run_summary(spark, sf_dir):
    s = metrics.run_summary(spark.read.parquet(f"{sf_dir}/events.parquet"), "value", ["event_type"])
    return s.select("event_type", "n", "least", "most", *(F.round(c, 6).alias(c) for c in ("mean", "median", "stdev")))


@query(f"SELECT doc_id, 5 AS filled, count(*)/5 - count(DISTINCT page) + 1 AS rows FROM ({fx.GRID}) g GROUP BY doc_id")
def cells_per_row_hist(spark, sf_dir):
    return render.cells_per_row(convert_items(table(spark, sf_dir, fx.GRID)).sheet_rows).withColumn("rows", F.col("rows").cast("double"))


_OUTSIDE = f"WITH i AS ({fx.CENTRED})"


@query(f"{_OUTSIDE} SELECT doc_id, page, seq, x+width/2 BETWEEN 0 AND 260 OR x+width/2 BETWEEN 400 AND 480 AS assigned FROM i WHERE x>=260")
def outside_text_assign(spark, sf_dir):
    i = table(spark, sf_dir, fx.CENTRED)
    pages = i.select(*P).distinct()
    ranges = pages.withColumn("x_min", F.lit(0.0)).withColumn("x_max", F.lit(260.0)).unionByName(pages.withColumn("x_min", F.lit(400.0)).withColumn("x_max", F.lit(480.0)))
    return layout.outside_text(i, i.where("x < 260").select(*P, "seq"), ranges).select(*P, "seq", "assigned")


@query(f"{_OUTSIDE} SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id,page ORDER BY y DESC,x,seq)-1 AS rank, text FROM i WHERE x>=260 AND y>300")
def titles(spark, sf_dir):
    i = table(spark, sf_dir, fx.CENTRED).where("x >= 260")
    return layout.titles(i, i.select(*P).distinct().withColumn("y_top", F.lit(300.0))).select(*P, "rank", "text")


@query(f"SELECT doc_id, page, seq, CAST(regexp_matches(regexp_replace(text,'[,.\\s]','','g'),'^[0-9]+$') AS BOOLEAN) AS numeric FROM ({fx.GRID}) g")
def numeric_predicate(spark, sf_dir):
    return table(spark, sf_dir, fx.GRID).select(*P, "seq", numeric(F.col("text")).alias("numeric"))


@query("SELECT CAST(p_partkey AS BIGINT) AS doc_id, p_partkey%4<>0 AS from_grid FROM part")
def tier_choice(spark, sf_dir):
    """Supplied grid cells are taken unless they lack a word (here: of every fourth document)."""
    md = table(spark, sf_dir, fx.MARKDOWN).select("doc_id", F.posexplode(tiers.markdown_rows(F.col("markdown"))).alias("row_idx", "v"))
    cells = md.select("doc_id", F.lit(0).alias("page"), F.lit(0).alias("region_id"), "row_idx", (F.col("row_idx") == 0).alias("is_header"), F.posexplode("v").alias("col_idx", "text")).withColumn("confidence", F.lit(0.9))
    given = cells.where("NOT (doc_id % 4 = 0 AND row_idx = 1 AND col_idx = 1)").select(*tiers.PLACE, F.col("row_idx").alias("row"), F.col("col_idx").alias("col"), "text", "is_header")
    none = cells.limit(0).select(*tiers.PLACE, "text", F.lit(False).alias("needs_ocr"))
    return tiers.choose_tier(cells, given, none, cells.select(*tiers.PLACE, F.lit(3).alias("expected")).distinct())[1].select("doc_id", (F.col("source") == "vector-grid-cells").alias("from_grid"))


def _supplied(items: DataFrame) -> Supplied:
    """Tables of the grid fixture: on every third page cells of a grid, without a word on every sixth; markdown where pages aren't 2 by 3, without a column on some; failures."""
    row, col = F.floor(F.col("seq") / 5).cast("int"), (F.col("seq") % 5).cast("int")
    cells = items.select(*P, F.lit(0).alias("region_id"), "seq", row.alias("row"), col.alias("col"), "text", (row == 0).alias("is_header"))
    narrow = (F.col("page") % 9 == 1) & (F.col("seq") == 4)
    line = cells.where((F.col("page") % 3 != 2) & ~narrow).groupBy(*P, "region_id", "row").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("col", "text"))), lambda c: c["text"]), " | ").alias("t"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row", "t"))), lambda r: F.concat(F.lit("| "), r["t"], F.lit(" |"))), "\n")
    failed = cells.where("page % 6 = 2").select(*P, "region_id").distinct().withColumn("tier", F.lit(tiers.GRID))
    return Supplied(cells.where("page % 3 = 0 AND NOT (page % 6 = 3 AND seq = 4)").drop("seq"), line.groupBy(*P, "region_id").agg(text.alias("text")).withColumn("needs_ocr", F.lit(False)), failed)


@query(f"""SELECT DISTINCT doc_id, page, CASE WHEN page%6=0 THEN 'vector-grid-cells' WHEN page%3=0 OR page%3=1 AND page%9<>1 THEN 'region-tables' ELSE 'clustered' END AS source,
 CASE WHEN page%6=3 THEN 'tier-incomplete: vector-grid-cells lacks 1 words' WHEN page%6=2 THEN 'tier-fallback: vector-grid-cells failed' ELSE '' END AS warned FROM ({fx.GRID}) g""")
def tier_modes(spark, sf_dir):
    """The source of each region of a conversion that looks at supplied tables, and what it warns of."""
    items = table(spark, sf_dir, fx.GRID)
    out = convert_items(items, Options(extraction="auto"), given=_supplied(items))
    warned = out.warnings.where("kind LIKE 'tier-%'").select(*P, F.concat("kind", F.lit(": "), F.split("message", r" \(")[0]).alias("warned"))
    return out.regions.join(warned, P, "left").select(*P, "source", F.coalesce("warned", F.lit("")).alias("warned"))


@query("SELECT o_orderkey AS order_key, CAST(o_custkey AS VARCHAR) AS customer, o_orderstatus AS status, o_orderpriority AS priority, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date FROM orders")
def roundtrip_tiers(spark, sf_dir):
    """Whatever source each page has, its rows are the orders."""
    items = table(spark, sf_dir, fx.GRID)
    rows = convert_items(items, Options(extraction="auto"), given=_supplied(items)).sheet_rows.where("NOT is_header AND kind = 'row'")
    return rows.select(F.col("values")[0].cast("long").alias("order_key"), *(F.col("values")[i].alias(c) for i, c in enumerate(("customer", "status", "priority", "date"), 1)))


@query("SELECT CAST(floor(o_orderkey/500.0) AS INT) AS doc_id, count(*)+1 AS rows, 5 AS max_columns, 5*(count(*)+1) AS filled_cells FROM orders GROUP BY ALL")
def workbook_stats(spark, sf_dir):
    return metrics.workbook_stats(convert_items(table(spark, sf_dir, fx.GRID), Options(worksheet_policy="per-region")).sheet_rows).select("doc_id", "rows", "max_columns", "filled_cells")


@query("SELECT CAST(doc_id AS VARCHAR) AS name, CAST(octet_length(encode(text)) AS BIGINT) AS bytes, sha256(text) AS sha256 FROM documents")
def corpus_manifest(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return evaluation.manifest(d.select(F.col("doc_id").cast("string").alias("name"), F.col("text").alias("content")))


@query("SELECT event_type AS tool, count(*) AS documents, round(sum(value),4) AS total_time, round(avg(user_id%10/10.0),6) AS mean_f1, count_if(event_id%3=0) AS exact FROM events GROUP BY event_type")
def aggregate_runs(spark, sf_dir):
    runs = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("tool"), F.col("value").alias("median_time"), ((F.col("user_id") % 10) / 10.0).alias("f1"), (F.col("event_id") % 3 == 0).alias("exact"))
    return evaluation.aggregate_runs(runs).withColumn("total_time", F.round("total_time", 4)).withColumn("mean_f1", F.round("mean_f1", 6))
