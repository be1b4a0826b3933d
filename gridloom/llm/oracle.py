"""DuckDB SQL for the text queries that SQL can express."""

WORD = r"[^\x20\x09-\x0D]+"

#: Exact shingle sets, all links by an inverted list, components by recursion.
NEAR_DUPLICATES = rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS ws FROM documents),
 s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws)>=5 THEN array_to_string(ws[i:i+4],' ') ELSE array_to_string(ws,' ') END AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws)-4,1)+1)) AS i FROM w WHERE len(ws)>0) x),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
 p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g=b.g AND a.doc_id<>b.doc_id GROUP BY ALL),
 l AS (SELECT x, y FROM p JOIN n a ON a.doc_id=x JOIN n b ON b.doc_id=y WHERE 100*c >= 75*(a.n+b.n-c)),
 r AS (SELECT doc_id, doc_id AS o FROM w UNION SELECT r.doc_id, l.y FROM r JOIN l ON l.x=r.o),
 m AS (SELECT doc_id, min(o) AS component_id FROM r GROUP BY doc_id)
 SELECT w.doc_id, coalesce(n.n,0) AS n_shingles, m.component_id, w.doc_id=m.component_id AS kept FROM w JOIN m USING (doc_id) LEFT JOIN n USING (doc_id)"""

# The same rule as the operator's, step by step: targets, quotas of sources, groups and shards, blocks.
_HASH = "CAST('0x' || substr(md5('mix-1:' || {0}),1,8) AS BIGINT) % 2147483648"


def _apportion(table: str, parent: str, order: str) -> str:
    """Highest quotients: rows of `table` (claim, cap, seats) with quota."""
    p = parent
    return f"""(SELECT t.* EXCLUDE (claim, cap, seats, ssum, k, lo, hi), CAST(lo + (SELECT count(*) FROM (SELECT {p}, {order}, row_number() OVER (PARTITION BY {p} ORDER BY claim/(2*s+1) DESC, {order}) AS rn, free FROM (SELECT {p}, {order}, claim, seats-sum(lo) OVER (PARTITION BY {p}) AS free, lo, hi FROM __{table}) q, LATERAL (SELECT unnest(range(lo, hi)) AS s) u) v WHERE rn<=free AND v.{order}=t.{order} {' '.join(f'AND v.{c.strip()}=t.{c.strip()}' for c in p.split(','))}) AS BIGINT) AS quota FROM __{table} t)"""


def _bounds(table: str, parent: str) -> str:
    return f"""__{table} AS (SELECT *, greatest(lo, least(cap, CAST(floor((CASE WHEN ssum>0 THEN claim*(seats+k)/ssum ELSE 0 END)+0.5) AS BIGINT))) AS hi FROM (SELECT *, least(cap, greatest(0, CAST(ceil((CASE WHEN ssum>0 THEN claim*(seats-k)/ssum ELSE 0 END)-0.5) AS BIGINT))) AS lo FROM (SELECT *, sum(claim) OVER (PARTITION BY {parent}) AS ssum, count(*) OVER (PARTITION BY {parent}) AS k FROM {table}) a) b)"""


def mixing(block: int, shard: int, group: int, stride: int) -> str:
    return rf"""WITH sized AS (SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS src, CAST(len(regexp_extract_all(coalesce(text,''), '{WORD}')) AS BIGINT) AS size FROM documents),
 s0 AS (SELECT src, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY src),
 s1 AS (SELECT *, CAST([3,1,2][CAST((row_number() OVER (ORDER BY src)-1)%3+1 AS INT)] AS DOUBLE) AS weight, 2.0::DOUBLE*source_size AS cap, 1.5::DOUBLE*sum(source_size) OVER () AS budget FROM s0),
 s2 AS (SELECT *, row_number() OVER (ORDER BY cap/weight, src) AS n, (budget-coalesce(sum(cap) OVER (ORDER BY cap/weight, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0))/sum(weight) OVER (ORDER BY cap/weight, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM s1),
 s3 AS (SELECT src, source_size, budget, coalesce(least(cap, (SELECT arg_min(lev, n) FROM s2 WHERE lev*weight<=cap)*weight), cap) AS target FROM s2),
 a AS (SELECT src, source_size, target, target AS claim, CAST(2*ceil(source_size/{block}.0) AS BIGINT) AS cap, CAST(floor(budget/{block}+0.5) AS BIGINT) AS seats, 0 AS one FROM s3),
 {_bounds('a', 'one')}, qa AS {_apportion('a', 'one', 'src')},
 d AS (SELECT z.*, q.source_size, q.target, q.quota AS source_quota, ({_HASH.format("'shard:' || coalesce(CAST(doc_id AS VARCHAR),'')")}) % CAST(greatest(1, ceil(q.source_size/{shard}.0)) AS BIGINT) AS shard FROM sized z JOIN qa q USING (src)),
 e AS (SELECT *, shard // {group} AS grp FROM d),
 sh AS (SELECT src, grp, shard, CAST(sum(size) AS BIGINT) AS words, any_value(source_quota) AS source_quota FROM e GROUP BY ALL),
 b AS (SELECT src, grp, sum(words)::DOUBLE AS claim, CAST(sum(2*ceil(words/{block}.0)) AS BIGINT) AS cap, any_value(source_quota) AS seats FROM sh GROUP BY ALL),
 {_bounds('b', 'src')}, qb AS {_apportion('b', 'src', 'grp')},
 c AS (SELECT sh.src, sh.grp, shard, words, words::DOUBLE AS claim, CAST(2*ceil(words/{block}.0) AS BIGINT) AS cap, qb.quota AS seats FROM sh JOIN qb USING (src, grp)),
 {_bounds('c', 'src, grp')}, qc AS {_apportion('c', 'src, grp', 'shard')},
 f AS (SELECT e.*, sum(size) OVER (PARTITION BY e.src, e.grp, e.shard ORDER BY md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR),'')), doc_id, size ROWS UNBOUNDED PRECEDING)-size AS start, qc.quota, greatest(1, CAST(ceil(qc.words/{block}.0) AS BIGINT)) AS blocks, {_HASH.format("'blocks:' || e.src || ':' || CAST(e.shard AS VARCHAR)")} AS shift FROM e JOIN qc USING (src, grp, shard))
 SELECT doc_id, size, source_size, target, CAST(CASE WHEN size=0 THEN 0 ELSE (quota//blocks)*size + coalesce(list_sum(list_transform(range(CAST(start//{block} AS BIGINT), CAST((start+size-1)//{block}+1 AS BIGINT)), lambda x: CASE WHEN (x*{stride}+shift)%blocks < quota%blocks THEN least(start+size,(x+1)*{block})-greatest(start,x*{block}) ELSE 0 END)),0) END AS BIGINT) AS taken FROM f"""
