"""Removal of repeated passages by suffix arrays over shards.

A byte goes if a string of SPAN bytes covers it that also starts in a document with a smaller id.
Every such string holds an anchor, its substring of GRAM bytes with the least hash, and equal
strings have equal anchors. So the strings of a document fall into segments by anchor, and
all segments of an anchor form a shard's input: no shard has to meet another. Anchors that stand in one
document alone can't repeat and are left out first. In a shard the distinct segments are one string
whose suffix array is induced (suffix_array.py); neighbours with a common prefix of SPAN bytes or
more are one string of the corpus, and the least id of each such run decides. The segments of an anchor
with too many different ones for one array fall apart into their strings, each its own anchor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, buffers, dropped, mix64, powers, prefix_hash, read_documents, span_hash, stashed, sub_batches, worker_cache
from .suffix_array import permuted_common_prefixes, suffix_array

SPAN, GRAM = 50, 12
#: Ways in which a string may lie about its anchor, by the bytes in front of it. The more, the longer the text that all strings of a way have.
WAYS = 3
#: Text behind one shard of the anchors' keys; segment bytes that one suffix array takes (so few that it stays in cache),
#: and those of an anchor above which its strings go their own ways.
KEY_SHARD, ARRAY_BYTES, HOT_BYTES = 4 << 20, 1 << 16, 1 << 20
#: Of how many different segments one, by hash, is counted to find such anchors. Every segment goes on either way.
COUNTED = 64
#: Bytes of text whose anchors are found at a time, so that the work stays in cache.
CACHED = 1 << 15
#: The bytes of an anchor's hash that are passed on.
LOW = np.uint64((1 << 32) - 1)


def segments(data: np.ndarray, offsets: np.ndarray, pre: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every text: where each segment's first string starts, how many strings it has, its anchor's hash, its text,
    where its anchor starts; pre: the data's prefix hashes."""
    width = SPAN - GRAM + 1
    none = np.zeros(0, np.int64)
    if len(data) < SPAN:
        return none, none, np.zeros(0, np.uint64), none, none
    n = len(data) - GRAM + 1
    h = mix64((pre[GRAM:] - pre[:n]) * powers(n, inverse=True) + np.uint64(GRAM))
    # least hash, then leftmost: the place in the low bits decides between equal high bits
    bits = np.uint64(max(24, len(data).bit_length()))
    low = h >> bits << bits
    low |= np.arange(n, dtype=np.uint64)
    size = 1
    while 2 * size <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < width:
        low = np.minimum(low[: size - width], low[width - size :])
    at = (low & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    new = np.ones(len(at) + 1, bool)
    np.not_equal(at[1:], at[:-1], out=new[1:-1])
    new[offsets[offsets < len(at)]] = True
    first = np.flatnonzero(new)
    first, after = first[:-1], first[1:]
    doc = np.searchsorted(offsets, first, side="right") - 1
    # the strings of a document that are whole stand in front of those that aren't
    whole = offsets[doc + 1] - (SPAN - 1)
    keep = first < whole
    first, after, doc, whole = first[keep], after[keep], doc[keep], whole[keep]
    return first, np.minimum(after, whole) - first, h[at[first]], doc, at[first]


def surroundings(pre: np.ndarray, offsets: np.ndarray, at: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the anchors at `at` with what all strings of a way have about them, 38 bytes for three ways; and which there
    are (WAYS, n). Strings agree only if their anchors do in one of them."""
    most = SPAN - GRAM
    edge = [k * (most + 1) // WAYS for k in range(WAYS + 1)]
    keys, there = [], []
    for k, (left, end) in enumerate(zip(edge, edge[1:], strict=False)):
        right = GRAM + most - (end - 1)
        inside = (at - left >= offsets[doc]) & (at + right <= offsets[doc + 1])
        keys.append(mix64(span_hash(pre, np.where(inside, at - left, at), np.where(inside, at + right, at + GRAM)) + np.uint64(k + 1)))
        there.append(inside)
    return np.stack(keys), np.stack(there)


def _pack(x: np.ndarray) -> bytes:
    """Numbers byte by place, which packs well; nothing if all are 0."""
    return x.view(np.uint8).reshape(len(x), -1).T.tobytes() if x.any() else b""


def _unpack(parts: list[bytes], kind: str, counts: list[int]) -> np.ndarray:
    """Numbers of a kind, so many of each part."""
    width = np.dtype(kind).itemsize
    return np.concatenate([np.frombuffer(p, np.uint8).reshape(width, n).T.copy().view(kind).ravel() if p else np.zeros(n, kind) for p, n in zip(parts, counts, strict=True)])


def _shard(h: np.ndarray, shards: int) -> np.ndarray:
    return ((h >> np.uint64(40)) % np.uint64(shards)).astype(np.int64)


def in_order(h: np.ndarray, doc: np.ndarray, ids: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Low bits of the hashes, documents and shards, each three once, by shard, low bits and id; and where a hash of a shard is the first of its kind."""
    by_id = np.argsort(ids, kind="stable")
    rank = np.empty(len(ids), np.uint64)
    rank[by_id] = np.arange(len(ids), dtype=np.uint64)
    bits = max(1, (len(ids) - 1).bit_length())
    if bits + 32 + (shards - 1).bit_length() <= 64:  # all in one number, which sorts much faster
        b = np.uint64(bits)
        key = np.sort(((_shard(h, shards).astype(np.uint64) << np.uint64(32) | h & LOW) << b) | rank[doc])
        key = key[np.r_[True, key[1:] != key[:-1]]]
        group = key >> b
        h, place, shard = group & LOW, key & ((np.uint64(1) << b) - np.uint64(1)), group >> np.uint64(32)
    else:
        h, place, shard = h & LOW, rank[doc], _shard(h, shards).astype(np.uint64)
        order = np.lexsort((place, h, shard))
        h, place, shard = h[order], place[order], shard[order]
        new = np.r_[True, (place[1:] != place[:-1]) | (h[1:] != h[:-1]) | (shard[1:] != shard[:-1])]
        h, place, shard = h[new], place[new], shard[new]
    first = np.r_[True, (h[1:] != h[:-1]) | (shard[1:] != shard[:-1])]
    return h, by_id[place.astype(np.int64)], shard.astype(np.int64), first


def shared_anchors(docs: DataFrame, shards: int) -> DataFrame:
    """(id, x, key): of each document the anchors with one of their surroundings, a shard and four bytes in one number, that stand in some other document too.

    What two documents of a batch have is known there; its least and its largest id go to the shard, however many have it.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("passages")
        for batch in (s for b in batches for s in sub_batches(b, 2)):
            ids, x = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
            hashes, docs, done = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
            for part in sub_batches(batch, 2, CACHED):
                data, off = buffers(part.column(2))
                pre = prefix_hash(data)
                _, _, _, doc, at = segments(data, off, pre)
                both, there = surroundings(pre, off, at, doc)
                for k in range(WAYS):
                    hashes.append(both[k][there[k]])
                    docs.append(doc[there[k]] + done)
                done += part.num_rows
            h, doc = np.concatenate(hashes), np.concatenate(docs)
            if not len(h):
                continue
            h, doc, shard, first = in_order(h, doc, ids, shards)
            group = np.cumsum(first) - 1
            last = np.r_[first[1:], True]
            known = (ids[doc[first]] != ids[doc[last]])[group] & ~first & ~last
            # numbers below 0 are answers already
            for pick, sign in ((~known, 1), (known, -1)):
                k, d, own = h[pick], doc[pick], shard[pick]
                edge = np.flatnonzero(np.r_[True, own[1:] != own[:-1], True]) if len(own) else np.zeros(1, np.int64)
                columns = k.astype("<u4"), ids[d], x[d]
                cut = list(zip(edge, edge[1:], strict=False))
                number = own[edge[:-1]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(number), pa.array(number if sign > 0 else -1 - mix64((number + ids[0]).astype(np.uint64)).astype(np.int64) % shards), pa.array(np.diff(edge)), *(pa.array([_pack(y[a:b]) for a, b in cut], pa.binary()) for y in columns)],
                    names=["shard", "part", "n", "keys", "ids", "x"],
                )

    def meet(shard: int, part: int, n: list[int], keys: list[bytes], ids: list[bytes], x: list[bytes]) -> pa.RecordBatch:
        key, owner, other = _unpack(keys, "<u4", n).astype(np.uint64), _unpack(ids, "<i8", n), _unpack(x, "<i8", n)
        if part >= 0:
            order = np.argsort(key)
            key, owner, other = key[order], owner[order], other[order]
            new = np.r_[True, key[1:] != key[:-1]]
            edge = np.flatnonzero(new)
            shared = (np.minimum.reduceat(owner, edge) != np.maximum.reduceat(owner, edge))[np.cumsum(new) - 1]
            key, owner, other = key[shared], owner[shared], other[shared]
        return pa.RecordBatch.from_arrays([pa.array(owner), pa.array(other), pa.array((key + (np.uint64(shard + 1) << np.uint64(32))).view(np.int64))], names=["id", "x", "key"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = None, []
        for batch in batches:
            for s, p, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (s, p) != held and rows:
                    yield meet(*held, *zip(*rows, strict=True))
                    rows = []
                held = (s, p)
                rows.append(row)
        if rows:
            yield meet(*held, *zip(*rows, strict=True))

    parts = docs.select("id", "x", "text").mapInArrow(emit, "shard long, part long, n long, keys binary, ids binary, x binary")
    return parts.repartition(shards, "part").sortWithinPartitions("part", "shard").mapInArrow(gather, "id long, x long, key long")


def packed_texts(docs: DataFrame) -> DataFrame:
    """(id, x, keep, packed): compressed texts dealt out by id. What joins by id reuses this one exchange."""
    kinds = {c: docs.schema[c].dataType.simpleString() for c in docs.columns if c != "text"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in (s for b in batches for s in sub_batches(b, 0, 1 << 17)):
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array([pack((t or "").encode()) for t in batch.column(0).to_pylist()], pa.binary())], names=[*kinds, "packed"])

    n = max(8, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ddl = ", ".join(f"`{c}` {t}" for c, t in kinds.items())
    return docs.select("text", *kinds).mapInArrow(run, f"{ddl}, packed binary").repartition(n, "id", "x")


def _texts(packed: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    unpack = zstandard.ZstdDecompressor().decompress
    texts = [unpack(p) for p in packed]
    return np.frombuffer(b"".join(texts), np.uint8), np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64)


def shared_segments(texts: DataFrame, anchors: DataFrame, shards: int) -> DataFrame:
    """(id, x, start, strings, mark, h): segments of shared anchors; mark: 64-bit hash of the content, h: of the anchor."""

    def find(ids: np.ndarray, x: np.ndarray, packed: list[bytes], keys: pa.ListArray) -> pa.RecordBatch:
        data, off = _texts(packed)
        pre = prefix_hash(data)
        start, strings, h, doc, at = segments(data, off, pre)
        both, there = surroundings(pre, off, at, doc)
        # the document's number among these tells equal anchors apart
        tag = lambda d, key: mix64(mix64(d.astype(np.uint64)) + key)
        want = tag(np.repeat(np.arange(len(keys)), keys.value_lengths().to_numpy(zero_copy_only=False)), keys.flatten().to_numpy(zero_copy_only=False).view(np.uint64))
        keep = np.zeros(len(h), bool)
        want.sort()
        for k in range(WAYS):
            tags = tag(doc, (both[k] & LOW) + (_shard(both[k], shards).astype(np.uint64) + np.uint64(1) << np.uint64(32)))
            keep |= there[k] & (want[np.minimum(np.searchsorted(want, tags), len(want) - 1)] == tags)
        start, strings, h, doc = start[keep], strings[keep], h[keep], doc[keep]
        mark = span_hash(pre, start, start + strings + SPAN - 1)
        return pa.RecordBatch.from_arrays([pa.array(ids[doc]), pa.array(x[doc]), pa.array((start - off[doc]).astype(np.int32)), pa.array(strings.astype(np.int32)), pa.array(mark.view(np.int64)), pa.array(h.view(np.int64))], names=PLACE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in sub_batches(b, 2, CACHED)):
            yield find(batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_pylist(), batch.column(3))

    flags = anchors.groupBy("id", "x").agg(F.collect_list("key").alias("keys"))
    return texts.join(flags.hint("merge"), ["id", "x"]).select("id", "x", "packed", "keys").mapInArrow(run, PLACES)


PLACE = ["id", "x", "start", "strings", "mark", "h"]
PLACES = "id long, x long, start int, strings int, mark long, h long"


def distinct(places: DataFrame) -> DataFrame:
    """(mark, first): each distinct segment where it stands first."""
    return places.groupBy("mark").agg(F.min(F.struct("id", "x", "start", "strings", "h")).alias("first"))


def split_hot(texts: DataFrame, places: DataFrame) -> DataFrame:
    """The same places, a stash in place of theirs, with segments of anchors that have more than HOT_BYTES of different ones taken apart into strings.

    A string that most documents have is then one row of a group by its content, as any other, and no anchor fills one task.
    """
    counted = places.where(F.pmod("mark", F.lit(COUNTED)) == 0).groupBy("h", "mark").agg((F.first("strings") + (SPAN - 1)).alias("size"))
    found = stashed(counted.groupBy("h").agg((COUNTED * F.sum("size")).alias("bytes")).where(F.col("bytes") > HOT_BYTES).select("h"))
    if found.isEmpty():
        dropped(found)
        return places
    hot = bounded(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in sub_batches(b, 2, 1 << 17)):
            ids, x = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            data, off = _texts(batch.column(2).to_pylist())
            segs = batch.column(3)
            doc = np.repeat(np.arange(len(ids)), segs.value_lengths().to_numpy(zero_copy_only=False))
            at, strings = (segs.flatten().field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("start", "strings"))
            doc, first = np.repeat(doc, strings), np.repeat(at, strings)
            at = first + np.arange(len(first)) - np.repeat(np.cumsum(strings) - strings, strings)
            mark = pa.array(span_hash(prefix_hash(data), off[doc] + at, off[doc] + at + SPAN).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(ids[doc]), pa.array(x[doc]), pa.array(at.astype(np.int32)), pa.array(np.ones(len(at), np.int32)), mark, mark], names=PLACE)

    apart = places.join(hot, "h", "left_semi").groupBy("id", "x").agg(F.collect_list(F.struct("start", "strings")).alias("segs"))
    strings = texts.join(apart.hint("merge"), ["id", "x"]).select("id", "x", "packed", "segs").mapInArrow(run, PLACES)
    out = stashed(places.join(hot, "h", "left_anti").select(PLACE).unionByName(strings))
    dropped(found, places)
    return out


def contents(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(h, mark, content, least) of segments wanted: (mark, first: struct(id, x, start, strings, h))."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in sub_batches(b, 1, 1 << 17)):
            segs = batch.column(2)
            many = segs.value_lengths().to_numpy(zero_copy_only=False)
            flat = segs.flatten()
            start, strings = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("start", "strings"))
            data, off = _texts(batch.column(1).to_pylist())
            size = strings + SPAN - 1
            ends = np.cumsum(size)
            from_ = start + np.repeat(off[:-1], many) - (ends - size)
            content = data[np.arange(ends[-1] if len(ends) else 0) + np.repeat(from_, size)]
            cut = pa.py_buffer(np.r_[0, ends].astype(np.int32))
            yield pa.RecordBatch.from_arrays([flat.field("h"), flat.field("mark"), pa.Array.from_buffers(pa.binary(), len(size), [None, cut, pa.py_buffer(content)]), pa.array(np.repeat(batch.column(0).to_numpy(), many))], names=["h", "mark", "content", "least"])

    by_id = wanted.groupBy("first.id", "first.x").agg(F.collect_list(F.struct("mark", F.col("first.start").alias("start"), F.col("first.strings").alias("strings"), F.col("first.h").alias("h"))).alias("segs"))
    return texts.join(by_id.hint("merge"), ["id", "x"]).select("id", "packed", "segs").mapInArrow(run, "h long, mark long, content binary, least long")


def least_ids(contents: pa.Array, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For distinct segments with the least id of each: runs of strings with one least id, where each segment's begin (n+1
    numbers), the first string of each run in its segment, and the least id of its strings."""
    raw, off = buffers(contents)
    size = np.diff(off)
    # end to end, each behind a separator that is less than all bytes
    start = off[:-1] + np.arange(len(size))
    data = np.zeros(len(raw) + len(size), np.uint8)
    text = np.zeros(len(data), np.int32)
    place = np.arange(len(raw)) + np.repeat(np.arange(len(size)), size)
    data[place] = raw
    text[place] = raw.astype(np.int32) + 1
    order = suffix_array(text)
    strings = size - SPAN + 1
    owner = np.repeat(np.arange(len(size)), strings)
    first = np.cumsum(strings) - strings
    place = np.arange(len(owner)) + (start - first)[owner]
    seg_at = np.full(len(data), -1, np.int32)
    seg_at[place] = owner
    order = order[seg_at[order] >= 0]  # whole strings only
    common = permuted_common_prefixes(data, order, SPAN)
    new = common[order] < SPAN
    new[0] = True
    least = np.minimum.reduceat(ids[seg_at[order]], np.flatnonzero(new))[np.cumsum(new) - 1]
    by_place = np.zeros(len(data), np.int64)
    by_place[order] = least
    value = by_place[place]
    change = np.r_[True, (value[1:] != value[:-1])]
    change[first] = True
    runs = np.flatnonzero(change)
    return np.searchsorted(runs, np.r_[first, len(value)]), place[runs] - start[owner[runs]], value[runs]


def repeated_strings(segs: DataFrame) -> DataFrame:
    """segs: distinct segments (h, mark, content, least). (mark, size, at, least, low, high): runs of strings of each distinct segment with the least id in which they start, and the bounds of those."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("passages")
        held: list[pa.RecordBatch] = []
        size, last = 0, None

        def flush() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            marks, content, ids = t.column(1).chunk(0), t.column(2).chunk(0), t.column(3).to_numpy()
            cut, at, least = least_ids(content, ids)
            ends = [pa.array(f.reduceat(least, cut[:-1])) for f in (np.minimum, np.maximum)]
            cut = pa.array(cut.astype(np.int32))
            lists = [pa.ListArray.from_arrays(cut, pa.array(at.astype(np.int32))), pa.ListArray.from_arrays(cut, pa.array(least))]
            return pa.RecordBatch.from_arrays([marks, pc.binary_length(content).cast(pa.int64()), *lists, *ends], names=["mark", "size", "at", "least", "low", "high"])

        for batch in batches:
            if not batch.num_rows:
                continue
            h = batch.column(0).to_numpy()
            ends = np.cumsum(pc.binary_length(batch.column(2)).to_numpy(zero_copy_only=False).astype(np.int64))
            # an anchor's segments, HOT_BYTES at most, stay together
            edges = np.r_[0, np.flatnonzero(h[1:] != h[:-1]) + 1, len(h)]
            lo = 0
            for a, b in zip(edges, edges[1:], strict=False):
                if size >= ARRAY_BYTES and h[a] != last:
                    if a > lo:
                        held.append(batch.slice(lo, a - lo))
                    yield flush()
                    held, size, lo = [], 0, int(a)
                size += int(ends[b - 1] - (ends[a - 1] if a else 0))
                last = h[a]
            held.append(batch.slice(lo))
        if held:
            yield flush()

    n = max(8, int(segs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return segs.select("h", "mark", "content", "least").repartition(n, "h").sortWithinPartitions("h", "mark").mapInArrow(run, "mark long, size long, at array<int>, least array<long>, low long, high long")


def earlier_copies(docs: DataFrame) -> DataFrame:
    """(id, x) of texts of SPAN bytes or more that a smaller id has too: they go as a whole, and have no string that it lacks."""
    marked = docs.where((F.octet_length("text") >= SPAN) & F.col("id").isNotNull()).select("id", "x", F.xxhash64("text").alias("t"), F.xxhash64(F.lit(1), "text").alias("u"), F.octet_length("text").alias("bytes"))
    first = stashed(marked.groupBy("t", "u", "bytes").agg(F.min("id").alias("first"), F.count("*").alias("m")).where("m > 1").drop("m"))
    return marked.join(first, ["t", "u", "bytes"]).where("id > first").select("id", "x").distinct()


def repeated_spans(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, x, cuts), a stash: of each document with bytes to remove, array of (from, to) byte ranges, sorted; docs: (id, x, text), texts: the same packed."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(total // KEY_SHARD) + 1)
    long = docs.where((F.octet_length("text") >= SPAN) & F.col("id").isNotNull())
    # every step is a stash, so that the disk holds the exchanges of one
    anchors = stashed(shared_anchors(long, shards))
    places = stashed(shared_segments(texts, anchors, shards))
    dropped(anchors)
    places = split_hot(texts, places)
    first = stashed(distinct(places))
    segs = stashed(contents(texts, first))
    dropped(first)
    known = stashed(repeated_strings(segs))
    dropped(segs)
    hit = places.join(known, "mark").where("low < id")
    ends = F.concat(F.slice("at", 2, F.size("at") - 1), F.array((F.col("size") - (SPAN - 1)).cast("int")))
    runs = F.filter(F.arrays_zip(F.col("at").alias("a"), ends.alias("e"), F.col("least").alias("l")), lambda r: r["l"] < F.col("id"))
    spans = F.transform(runs, lambda r: F.struct((F.col("start") + r["a"]).alias("from"), (F.col("start") + r["e"] + (SPAN - 1)).alias("to")))
    # a segment whose strings all start earlier goes as one
    whole = F.array(F.struct(F.col("start").alias("from"), (F.col("start") + F.col("size").cast("int")).alias("to")))
    spans = F.when(F.col("high") < F.col("id"), whole).otherwise(spans)
    cuts = stashed(hit.select("id", "x", spans.alias("spans")).groupBy("id", "x").agg(F.sort_array(F.flatten(F.collect_list("spans"))).alias("cuts")))
    dropped(places, known)
    return cuts


def cut_texts(rows: DataFrame, as_text: bool) -> DataFrame:
    """(id, keep, n_bytes, n_removed, n_spans, kept) of rows with packed (compressed bytes) and cuts."""
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ["id", "keep"]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in (s for b in batches for s in sub_batches(b, 0, 1 << 17)):
            out = []
            for packed, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = unpack(packed)
                parts, at, done, n, removed = [], 0, -1, 0, 0
                for s in spans:
                    lo, hi = s["from"], s["to"]
                    n += lo > done
                    if hi > done:
                        if lo > at:
                            parts.append(raw[at:lo])
                        removed += hi - max(lo, done)
                        at = done = hi
                kept = b"".join([*parts, raw[at:]])
                # a cut may pass through a character; what is left of it goes
                out.append((len(raw), removed, n, kept.decode("utf-8", "ignore") if as_text else kept))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string() if as_text else pa.binary()]
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True))], names=[*kinds, *RESULTS, "kept"])

    ddl = ", ".join(f"`{c}` {t}" for c, t in kinds.items())
    return rows.select("packed", "cuts", *kinds).mapInArrow(run, f"{ddl}, n_bytes long, n_removed long, n_spans long, kept {'string' if as_text else 'binary'}")


RESULTS = ["n_bytes", "n_removed", "n_spans"]


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, as_text: bool = False) -> DataFrame:
    """One row per row: the id, the columns in `keep`, n_bytes, n_removed, n_spans and kept_bytes (the remaining bytes),
    or kept_text with `as_text`, where characters that a cut passes through go.

    Ids are integers; a ValueError says so of others. A null or empty text, or one under SPAN bytes, loses nothing, and
    a text may be as long as a row. Rows with the same id are one document, whose strings remove nothing from each
    other; each is cut by its own text. A row with a null id is returned whole and removes nothing. An empty
    table gives an empty result. Columns not in `keep` are not read; one in `keep` that is named like a column of the
    result comes back with an underscore in front.
    """
    if docs.schema[id_col].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise ValueError(f"suffix_dedup needs integer ids, and {id_col} is {docs.schema[id_col].dataType.simpleString()}")
    keep = keep or []
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.struct(F.lit(0).alias("n"), *(F.col(c).alias(f"k{i}") for i, c in enumerate(keep))).alias("keep"))
    # x tells rows of one id apart
    shared = stashed(own.where("id IS NOT NULL").groupBy("id").agg(F.count("*").alias("m")).where("m > 1"))
    own = own.join(bounded(shared), "id", "left").withColumn("x", F.when(F.col("m").isNotNull(), F.xxhash64("text")).otherwise(F.lit(0).cast("long"))).drop("m")
    copies = stashed(earlier_copies(own))
    rest = own.join(bounded(copies), ["id", "x"], "left_anti")
    texts = packed_texts(rest)
    cuts = repeated_spans(rest.select("id", "x", "text"), texts)
    # three kinds of rows: without cuts, copies as a whole, and those to cut, which reuse the packed exchange
    kind, empty = ("string", "") if as_text else ("binary", b"")
    n = F.octet_length("text").cast("long")
    zero = F.lit(0).cast("long")
    whole = rest.join(bounded(cuts.select("id", "x")), ["id", "x"], "left_anti").select("id", "keep", n.alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.col("text").cast(kind).alias("kept"))
    gone = own.join(bounded(copies), ["id", "x"], "left_semi").select("id", "keep", n.alias("n_bytes"), n.alias("n_removed"), F.when(n > 0, 1).otherwise(0).cast("long").alias("n_spans"), F.lit(empty).cast(kind).alias("kept"))
    cut = cut_texts(texts.join(cuts.hint("merge"), ["id", "x"]), as_text)
    last = "kept_text" if as_text else "kept_bytes"
    name = lambda c: f"_{c}" if c in (id_col, *RESULTS, last) else c
    return whole.unionByName(gone).unionByName(cut).select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), *(F.col("keep")[f"k{i}"].alias(name(c)) for i, c in enumerate(keep)), *RESULTS, F.col("kept").alias(last))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup(read_documents(spark, sf_dir))
    return out.select("doc_id", *RESULTS, F.sha2("kept_bytes", 256).alias("kept_sha256"))
