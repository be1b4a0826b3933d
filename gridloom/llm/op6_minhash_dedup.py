"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

Two permutations make the whole signature: sigma scatters the shingles over 2**32 positions, pi
orders positions, and coordinate k is the least pi of the positions shifted circularly by k.
Documents that agree in a band are candidates. Equal shingle sets are one class from the start.
In each bucket the class with the most bucket mates is compared with the others (a star, not all
pairs). Members that this joins need no more comparisons; what is still apart in a bucket is dealt
into blocks, and a task compares the full shingle sets of two blocks by a matrix product and puts
out the links that join components, never a row a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, buffers, connected_components, dropped, lower_ascii, mix64, prefix_hash, read_documents, span_hash, stashed, sub_batches, word_spans, worker_cache

WORDS = 5
#: Bands and coordinates of each: a pair at similarity 0.75 shares no band with probability 5e-6.
BANDS, ROWS = 32, 4
#: Least similarity in hundredths.
SIMILAR = 75
#: Shingles whose coordinates are made at a time, so that the work stays in cache.
BLOCK = 40_000
#: Members that one comparison task takes for one leader.
MEMBERS = 64
#: Documents and shingles of a block of a mixed bucket (a larger document is a block of its own), and shingles of a matrix product.
BLOCK_DOCS, BLOCK_SHINGLES, COLUMNS = 512, 1 << 16, 2048

_SIGMA = np.uint64(0x9E6C63D0876A9A47)
_PI1, _PI2 = 0x85EBCA6B, np.uint32(0xC2B2AE35)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text end to end, and n+1 offsets."""
    n = len(offsets) - 1
    data = lower_ascii(data)
    start, end, doc = word_spans(data, offsets)
    h = span_hash(prefix_hash(data), start, end)
    count = np.bincount(doc, minlength=n)
    first = np.r_[0, np.cumsum(count)]
    parts: list[np.ndarray] = []
    sizes = np.zeros(n + 1, np.int64)
    if len(h) >= words:
        rolled = np.zeros(len(h) - words + 1, np.uint64)
        for k in range(words):
            rolled = mix64(rolled + h[k : k + len(rolled)])
    for i in range(n):
        lo, hi = first[i], first[i + 1]
        if hi - lo >= words:
            s = np.sort(rolled[lo : hi - words + 1])
            s = s[np.r_[True, s[1:] != s[:-1]]]
        elif hi > lo:
            s = np.array([hi - lo], np.uint64)
            for k in range(lo, hi):
                s = mix64(s + h[k : k + 1])
        else:
            continue
        parts.append(s)
        sizes[i + 1] = len(s)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.cumsum(sizes)


def circulant_minhash(sets: np.ndarray, offsets: np.ndarray, coordinates: int = BANDS * ROWS) -> np.ndarray:
    """Signatures [set, coordinate] of sets that aren't empty (an empty one gets the largest values)."""
    n = len(offsets) - 1
    out = np.full((n, coordinates), 0xFFFFFFFF, np.uint32)
    place = (mix64(sets ^ _SIGMA) >> np.uint64(32)).astype(np.uint32) * np.uint32(_PI1)
    full = np.flatnonzero(np.diff(offsets))
    lo = 0
    while lo < len(full):
        hi = max(lo + 1, int(np.searchsorted(offsets[full + 1], offsets[full[lo]] + BLOCK, side="right")))
        rows = full[lo:hi]
        part = place[offsets[rows[0]] : offsets[rows[-1] + 1]]
        at = offsets[rows] - offsets[rows[0]]
        a, b = np.empty_like(part), np.empty_like(part)
        for k in range(coordinates):
            np.add(part, np.uint32(k * _PI1 & 0xFFFFFFFF), out=a)  # pi's first step at position + k
            np.right_shift(a, np.uint32(15), out=b)
            np.bitwise_xor(a, b, out=a)
            np.multiply(a, _PI2, out=a)
            out[rows, k] = np.minimum.reduceat(a, at)
        lo = hi
    return out


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, d1, d2, bands): set size, a 128-bit digest of the set, band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("near copies")
        for batch in (s for b in batches for s in sub_batches(b, 1, 1 << 19)):
            sets, off = shingle_sets(*buffers(batch.column(1)))
            size = np.diff(off)
            sig = circulant_minhash(sets, off).reshape(len(size), BANDS, ROWS)
            key = np.arange(BANDS, dtype=np.uint64)[None, :].repeat(len(size), 0)
            for r in range(ROWS):
                key = mix64((key << np.uint64(32) ^ key) + sig[:, :, r])
            digest = []
            for salt in (1, 2):
                x = np.r_[np.uint64(0), np.cumsum(mix64(sets + np.uint64(salt * 0x632BE59BD9B4E019 & (1 << 64) - 1)))]
                digest.append((x[off[1:]] - x[off[:-1]]).view(np.int64))
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1, dtype=np.int32) * BANDS), pa.array(key.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), *map(pa.array, digest), bands], names=["doc_id", "n", "d1", "d2", "bands"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, n long, d1 long, d2 long, bands array<long>")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough; texts: (id, text) of every document in them.

    The pairs of a first document are dealt out in shares, and each share meets a copy of its text.
    """
    kind = texts.schema["id"].dataType.simpleString()
    shares = pairs.groupBy("a").agg(F.ceil(F.count("*") / MEMBERS).alias("shares"))
    dealt = pairs.join(shares, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("shares")).alias("share"))
    firsts = dealt.select("a", "share").distinct().join(texts, F.col("a") == F.col("id")).select("a", "share", F.lit(0).alias("later"), "id", "text")
    others = dealt.join(texts, F.col("b") == F.col("id")).select("a", "share", F.lit(1).alias("later"), "id", "text")
    n = max(8, int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("near copies")
        held = (None, None, np.zeros(0, np.uint64))
        for batch in (s for b in batches for s in sub_batches(b, 4, 1 << 19)):
            sets, off = shingle_sets(*buffers(batch.column(4)))
            a, share, later, ids = (batch.column(i).to_pylist() for i in range(4))
            found = []
            for i in range(len(a)):
                own = sets[off[i] : off[i + 1]]
                if not later[i]:
                    held = (a[i], share[i], own)
                    continue
                assert held[:2] == (a[i], share[i])
                other = held[2]
                if min(len(own), len(other)) * 100 < SIMILAR * max(len(own), len(other)):
                    continue
                at = np.searchsorted(other, own)
                at[at == len(other)] = 0
                both = int((other[at] == own).sum())
                if 100 * both >= SIMILAR * (len(own) + len(other) - both):
                    found.append((a[i], ids[i]))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], batch.schema.field(0).type) for k in (0, 1)], names=["u", "v"])

    rows = firsts.unionByName(others).repartition(n, "a", "share").sortWithinPartitions("a", "share", "later")
    return rows.mapInArrow(run, f"u {kind}, v {kind}")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, n_shingles, component_id, kept.

    Words are the runs of characters other than white space (20, 09-0D hex), A-Z lowered. A text of fewer
    than five words is one shingle; a null text or one without words has none and is linked with nothing. Rows
    with the same id are one node of the links, and one of their texts stands for it; a row with a null id
    stands alone, with a null component, and is kept. An empty table gives an empty result. Whole texts count
    whatever their length. A component's least id is kept, so ties don't arise. Other columns are not read.
    """
    # stashes, since much starts from them, and since only a join of two plain exchanges can split a hot key
    rows = stashed(signatures(docs, id_col, text_col))
    classes = rows.where("n > 0 AND doc_id IS NOT NULL").groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("m"))
    classes = stashed(classes.where("m > 1").drop("m"))
    own = rows.join(bounded(classes), ["d1", "d2", "n"], "left").withColumn("rep", F.coalesce("rep", "doc_id"))
    keyed = own.where("n > 0 AND doc_id = rep").select(F.col("doc_id").alias("id"), "n", F.explode("bands").alias("key"))
    buckets = stashed(keyed.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"))
    # members of shared buckets only
    shared = stashed(keyed.join(buckets, "key"))
    own = stashed(own.select("doc_id", "n", "rep"))
    dropped(buckets, rows, classes)
    weights = shared.groupBy("id").agg(F.sum("m").alias("w"))
    leaders = stashed(shared.join(weights, "id").groupBy("key").agg(F.min(F.struct((-F.col("w")).alias("w"), "id")).alias("first")))
    led = stashed(shared.join(leaders, "key").select("key", "id", "n", "first").where("id != first.id"))
    ids = stashed(shared.select("id").distinct())
    texts = stashed(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(bounded(ids), "id", "left_semi"))
    dropped(shared, leaders, ids)
    nearest = led.groupBy("id").agg(F.min("first").alias("first")).select(F.col("first.id").alias("a"), F.col("id").alias("b"))
    nearest = stashed(nearest)
    first = stashed(verified(nearest, texts))
    labels = connected_components(first)
    # the other leaders of those that are still apart from them
    member = with_component(led.select("key", "id", "n", F.col("first.id").alias("leader")), labels)
    heads = labels.select(F.col("node").alias("leader"), F.col("component").alias("c_leader"))
    apart = member.join(heads, "leader", "left").where(F.col("c") != F.coalesce("c_leader", "leader"))
    others = stashed(apart.select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct())
    more = stashed(first.unionByName(verified(others, texts)))
    labels = connected_components(more)
    member = stashed(with_component(led.select("key", "id", "n"), labels))
    links = stashed(more.unionByName(across(member, texts)))
    labels = connected_components(links)
    dropped(led, texts, nearest, first, others, more, member, links)
    out = own.join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def with_component(shared: DataFrame, labels: DataFrame) -> DataFrame:
    return shared.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component")


def across(member: DataFrame, texts: DataFrame) -> DataFrame:
    """(u, v): links that join the components c of members (key, id, n, c; a stash) of a bucket, which their leader has left apart.

    Members are dealt into blocks, and each two blocks of a bucket meet in a task. Buckets with the same members are one.
    """
    digest = [F.sum(F.xxhash64(F.lit(k), "id").cast("decimal(38,0)")).alias(f"x{k}") for k in (1, 2)]
    mixed = member.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("m"), F.sum("n").alias("size"), *digest).where("lo != hi")
    blocks = F.greatest(F.ceil(F.col("m") / BLOCK_DOCS), F.ceil(F.col("size") / BLOCK_SHINGLES))
    mixed = stashed(mixed.groupBy("m", "size", "x1", "x2").agg(F.min("key").alias("key")).select("key", blocks.alias("blocks")))
    dealt = member.join(mixed, "key").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    paired = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    paired = paired.select("key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "id", "c")
    kind = texts.schema["id"].dataType.simpleString()
    n = max(8, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = None, []
        types = [pa.int64(), pa.int64()]

        def flush() -> pa.RecordBatch:
            found = spanning_links([r[1] for r in rows], [r[2] for r in rows], np.array([r[0] for r in rows]), [r[3] for r in rows])
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], types[0]) for k in (0, 1)], names=["u", "v"])

        for batch in (s for b in batches for s in sub_batches(b, 6, 1 << 19)):
            types = [batch.schema.field(4).type] * 2
            sets, off = shingle_sets(*buffers(batch.column(6)))
            for i, row in enumerate(zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True)):
                if row[:3] != held and rows:
                    yield flush()
                    rows = []
                held = row[:3]
                rows.append((row[3] == row[2], *row[4:], sets[off[i] : off[i + 1]].copy()))
        if rows:
            yield flush()

    meeting = paired.join(texts, "id").select("key", "lo", "hi", "block", "id", "c", "text").repartition(n, "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    return meeting.mapInArrow(run, f"u {kind}, v {kind}")


def spanning_links(ids: list, components: list, side: np.ndarray, sets: list[np.ndarray]) -> list[tuple]:
    """Links (u, v) of similar sets that together join all components that similar sets of the two sides join; of one side, any two sets."""
    first, second = np.flatnonzero(side), np.flatnonzero(~side)
    if not len(first) or not len(second):
        first = second = np.arange(len(ids))
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    known, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # only what two sets have matters; the columns of a product are so many of those
    column = np.cumsum(times > 1) - 1
    use = np.flatnonzero(times[place] > 1)
    place, owner = column[place[use]], owner[use]
    order = np.argsort(place, kind="stable")
    place, owner = place[order], owner[order]
    both = np.zeros((len(first), len(second)), np.float32)
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(place, [lo, lo + COLUMNS])
        x = np.zeros((len(sets), COLUMNS), np.float32)
        x[owner[a:b], place[a:b] - lo] = 1
        both += x[first] @ x[second].T
    both = both.astype(np.int64)
    near = 100 * both >= SIMILAR * (size[first][:, None] + size[second][None, :] - both)
    label = np.unique(np.array(components, object), return_inverse=True)[1]
    out = []
    for i in np.flatnonzero(near.any(1)):
        mates = second[near[i]]
        u = first[i]
        for v in mates[np.unique(label[mates], return_index=True)[1]]:
            if label[u] != label[v]:
                out.append((ids[u], ids[v]))
                label[label == label[v]] = label[u]
    return out


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_documents(spark, sf_dir))
