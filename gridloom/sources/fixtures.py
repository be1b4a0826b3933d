"""Positioned-text inputs derived from the TPC-H-like tables, as SQL that Spark and DuckDB both run."""

from __future__ import annotations

GRID = """SELECT doc_id, page, slot*5+col AS seq, 'Text' AS item_type, text, CAST(40+110*col AS DOUBLE) AS x, CAST(720-20*slot AS DOUBLE) AS y,
 CAST(80 AS DOUBLE) AS width, CAST(10 AS DOUBLE) AS height, slot=0 AS is_bold FROM (
 WITH k AS (SELECT CAST(o_orderkey AS BIGINT) AS k, CAST(FLOOR(o_orderkey/500.0) AS INT) AS doc_id,
 CAST(FLOOR((o_orderkey % 500)/25.0) AS INT) AS page, CAST(o_orderkey % 25 AS INT) AS r,
 CAST(o_orderkey AS STRING) AS c0, CAST(o_custkey AS STRING) AS c1, o_orderstatus AS c2, o_orderpriority AS c3,
 CAST(CAST(o_orderdate AS DATE) AS STRING) AS c4 FROM orders),
p AS (SELECT DISTINCT doc_id, page FROM k)
 SELECT doc_id,page,0 AS slot,0 AS col,'Order' AS text FROM p UNION ALL SELECT doc_id,page,0,1,'Customer' FROM p
 UNION ALL SELECT doc_id,page,0,2,'Status' FROM p UNION ALL SELECT doc_id,page,0,3,'Priority' FROM p UNION ALL SELECT doc_id,page,0,4,'Date' FROM p
 UNION ALL SELECT doc_id,page,r+1,0,c0 FROM k UNION ALL SELECT doc_id,page,r+1,1,c1 FROM k UNION ALL SELECT doc_id,page,r+1,2,c2 FROM k
 UNION ALL SELECT doc_id,page,r+1,3,c3 FROM k UNION ALL SELECT doc_id,page,r+1,4,c4 FROM k) g"""

SIDE_BY_SIDE = """SELECT doc_id, page, (side*13+slot)*3+col AS seq, 'Text' AS item_type, text, CAST(40+530*side+110*col AS DOUBLE) AS x, CAST(720-20*slot AS DOUBLE) AS y,
 CAST(80 AS DOUBLE) AS width, CAST(10 AS DOUBLE) AS height, slot=0 AS is_bold FROM (
 WITH k AS (SELECT CAST(o_orderkey AS BIGINT) AS k, CAST(FLOOR(o_orderkey/600.0) AS INT) AS doc_id,
 CAST(FLOOR((o_orderkey % 600)/24.0) AS INT) AS page, CAST(FLOOR((o_orderkey % 24)/12.0) AS INT) AS side, CAST(o_orderkey % 12 AS INT) AS r,
 CAST(o_orderkey AS STRING) AS c0, CAST(o_custkey AS STRING) AS c1, o_orderpriority AS c2 FROM orders),
 p AS (SELECT DISTINCT doc_id, page, side FROM k)
 SELECT doc_id,page,side,0 AS slot,0 AS col,'Order' AS text FROM p UNION ALL SELECT doc_id,page,side,0,1,'Customer' FROM p UNION ALL SELECT doc_id,page,side,0,2,'Priority' FROM p
 UNION ALL SELECT doc_id,page,side,r+1,0,c0 FROM k UNION ALL SELECT doc_id,page,side,r+1,1,c1 FROM k UNION ALL SELECT doc_id,page,side,r+1,2,c2 FROM k) g"""

CENTRED = f"""SELECT doc_id, page, seq, item_type, text, x + (80-5*length(text))/2.0 AS x, y + (seq % 3) - 1 AS y, CAST(5*length(text) AS DOUBLE) AS width, height, is_bold
 FROM ({GRID}) ga"""

#: Heights of 0 and more, steps of y and gaps that only the larger of two heights bridges.
MIXED = f"""SELECT doc_id, page, seq, item_type, text, x, y + CASE WHEN seq % 3 = 0 THEN 4 ELSE 0 END AS y, width + seq % 29 AS width, CASE WHEN seq % 4 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(4 + seq % 5 * 30 AS DOUBLE) END AS height, is_bold
 FROM ({GRID}) ga"""

#: Text without height: every step of y is a row of its own.
FLAT = f"SELECT doc_id, page, seq, item_type, text, x, y + seq % 2 AS y, width, CAST(0 AS DOUBLE) AS height, is_bold FROM ({GRID}) ga"

DRIFT = f"""SELECT doc_id, page, seq, item_type, text, x + (80-5*length(text))/2.0 AS x, y + 3.5*CAST((x-40)/110 AS INT) AS y, CAST(5*length(text) AS DOUBLE) AS width, height, is_bold
 FROM ({GRID}) ga"""

HEADERLESS = f"SELECT * FROM ({CENTRED}) gc WHERE NOT is_bold"

HEADER_ROWS = """SELECT doc_id, page, 0 AS region_id, row_idx, is_header, t0, t1, t2 FROM (
 SELECT DISTINCT CAST(FLOOR(o_orderkey/500.0) AS INT) AS doc_id, CAST(FLOOR((o_orderkey%500)/25.0) AS INT) AS page, 0 AS row_idx, true AS is_header,
  CASE WHEN FLOOR((o_orderkey%500)/25.0)%4=3 THEN 'Date' ELSE 'Order' END AS t0, CASE WHEN FLOOR((o_orderkey%500)/25.0)%4=3 THEN 'Amount' ELSE 'Customer' END AS t1,
  CASE WHEN FLOOR((o_orderkey%500)/25.0)%4=3 THEN 'Status' WHEN FLOOR((o_orderkey%500)/25.0)%4=2 THEN '' ELSE 'Priority' END AS t2 FROM orders
 UNION ALL SELECT CAST(FLOOR(o_orderkey/500.0) AS INT), CAST(FLOOR((o_orderkey%500)/25.0) AS INT), CAST(o_orderkey%25+1 AS INT), false,
  CASE WHEN o_orderkey%97=0 THEN '  order ' WHEN o_orderkey%89=0 THEN 'Customer' ELSE CAST(o_orderkey AS STRING) END,
  CASE WHEN o_orderkey%97=0 THEN 'CUSTOMER' WHEN o_orderkey%89=0 THEN '' ELSE CAST(o_custkey AS STRING) END,
  CASE WHEN o_orderkey%97=0 THEN 'Priority' WHEN o_orderkey%89=0 THEN '' ELSE o_orderpriority END FROM orders) u"""

#: Header rows as cells, blank ones included.
HEADER_CELLS = f"""SELECT doc_id, page, region_id, row_idx, is_header, 0 AS col_idx, t0 AS text FROM ({HEADER_ROWS}) e0
 UNION ALL SELECT doc_id, page, region_id, row_idx, is_header, 1, t1 FROM ({HEADER_ROWS}) e1
 UNION ALL SELECT doc_id, page, region_id, row_idx, is_header, 2, t2 FROM ({HEADER_ROWS}) e2"""

PAGES = """SELECT doc_id, ord, CAST(ord + FLOOR(ord/7.0) AS INT) AS page, CASE WHEN event_id % 6 = 0 THEN 0 ELSE CAST(1 + event_id % 2 AS INT) END AS n_regions,
 event_type = 'error' AS text_top, event_id % 11 = 0 AS text_bottom, CAST(event_id % 6 AS INT) AS observed FROM (
 SELECT CAST(user_id % 20 AS INT) AS doc_id, event_id, event_type, CAST(row_number() OVER (PARTITION BY user_id % 20 ORDER BY event_id)-1 AS INT) AS ord FROM events) e"""

PAIRS = """SELECT CAST(event_id AS BIGINT) AS pair_id, CAST(user_id % 20 AS INT) AS doc_id, CAST(3 + event_id % 2 AS INT) AS n_left, CAST(event_id % 50 AS INT) AS last_left,
 CAST(event_id % 50 + CASE event_id % 6 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 3 WHEN 3 THEN 4 WHEN 4 THEN 10 ELSE 11 END AS INT) AS first_right,
 event_id % 5 <> 0 AS sig_equal, event_id % 7 <> 0 AS vertical_overlap, event_id % 13 = 0 AS text_between,
 CASE WHEN event_type='error' THEN 'north' ELSE '' END AS cap_left, CASE WHEN event_type='error' THEN 'south' ELSE '' END AS cap_right FROM events"""

MARKDOWN = """SELECT CAST(p_partkey AS BIGINT) AS doc_id, '# heading' || chr(10) || '| Part | Brand | Size |' || chr(10) || '|---|:---:|---|' || chr(10) || '  | ' || CAST(p_partkey AS STRING) || ' | ' || p_brand || ' |' || CAST(p_size AS STRING) || '|' || chr(13) || chr(10) || 'trailing prose' AS markdown FROM part"""
