"""Quality by an interpolated modified Kneser-Ney model of word trigrams over byte 4-grams.

A text is cut into words, each with the one whitespace byte behind it, and ends with a line break. Word
trigrams, bigrams and single words are interpolated down to the spelling of the word, which a model of byte
4-grams gives, so that every text has a probability. The counts come from all trusted text. They are summed by
n-gram, lower orders count the distinct words or bytes in front, and contexts get their totals and their
numbers of n-grams seen once, twice and more.
Words are counted and asked for in passes over the texts, each for the n-grams with certain middle words. A pass
sends what trusted documents count and what batches of documents ask for to shards by pairs of words, as packed
arrays; a shard counts, answers in the order of the questions, and nothing else of the pass stays on the disk. The
batches then meet their answers and score their documents, a part of the batches at a time. A
trusted document is scored by the word counts that the others leave, since its own would make it look better
than any other. A document is kept if its perplexity is at most a quantile of those of the trusted documents
of its language.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _SPACE, bounded, dropped, prefix_hash, read_documents, span_hash, stashed, sub_batches

ORDER = 4
#: Text of a batch: it asks for each n-gram once.
BATCH = 2 << 20
#: Bytes whose words are hashed at a time, so that all steps stay in cache.
HASHED = 1 << 17
#: Trigrams that a counting task holds before it passes them on.
HELD = 1 << 20
#: Passes over the texts at most, and the bytes of text of each below that.
PASSES = 10
PASS_BYTES = 8 << 20
QUANTILE = 0.99
START = b"\n" * (ORDER - 1)
#: What stands behind every text, and the hash of what stands twice in front of its words.
END = b"\n"
BEFORE = np.uint64(0x9E3779B97F4A7C15)
#: Stands behind the last word of a text.
NOTHING = np.uint64(0xC2B2AE3D27D4EB4F)


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """4-grams, first byte highest, of each text behind a start of line breaks, end to end; and the n+1 offsets."""
    data = np.frombuffer(b"".join(START + t for t in texts), np.uint8).astype(np.uint32)
    size = np.array([len(t) for t in texts], np.int64)
    if not len(data):
        return np.zeros(0, np.uint32), np.zeros(1, np.int64)
    key = np.zeros(len(data), np.uint32)
    for k in range(ORDER):
        key[ORDER - 1 :] |= data[ORDER - 1 - k : len(data) - k] << np.uint32(8 * k)
    ends = np.cumsum(size + ORDER - 1)
    real = np.ones(len(data), bool)
    for k in range(ORDER - 1):
        real[ends - size - 1 - k] = False
    return key[real], np.r_[0, np.cumsum(size)]


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """[3, n] 64-bit hashes: each word and the two in front, oldest first; the n+1 starts in the joined bytes; and the word offsets of the texts.

    The texts, which end with whitespace, stand end to end. A word ends with the first whitespace byte, so that no word is the start of another.
    """
    data = np.frombuffer(b"".join(texts), np.uint8)
    if not len(data):
        return np.zeros((3, 0), np.uint64), np.zeros(1, np.int64), np.zeros(len(texts) + 1, np.int64)
    ends = np.flatnonzero(_SPACE[data]) + 1
    starts = np.r_[0, ends]
    off = np.searchsorted(ends, np.cumsum([0, *map(len, texts)]), side="right")
    out = np.full((3, len(ends)), BEFORE, np.uint64)
    lo = 0
    while lo < len(ends):
        at = starts[lo]
        hi = max(lo + 1, int(np.searchsorted(ends, at + HASHED, side="right")))
        out[2, lo:hi] = span_hash(prefix_hash(data[at : ends[hi - 1]]), starts[lo:hi] - at, ends[lo:hi] - at)
        lo = hi
    first = off[:-1][np.diff(off) > 0]
    second = first + 1
    out[1, 1:], out[0, 2:] = out[2, :-1], out[2, :-2]
    out[1, first] = out[0, first] = out[0, second[second < len(ends)]] = BEFORE
    return out, starts, off


def _turn(x: np.ndarray, bits: int) -> np.ndarray:
    return x << np.uint64(bits) | x >> np.uint64(64 - bits)


def _pack(cols: np.ndarray, rising: int = 0) -> bytes:
    """[c, n] 64-bit numbers: of the first `rising` columns the differences; then the bytes that the greatest needs by their places, compressed."""
    cols = np.ascontiguousarray(cols).view(np.uint64).copy()
    cols[:rising, 1:] -= cols[:rising, :-1].copy()
    wide = max(1, (int(cols.max(initial=0)).bit_length() + 7) // 8)
    return bytes([wide]) + zstandard.ZstdCompressor(level=1).compress(cols.view(np.uint8).reshape(-1, 8)[:, :wide].T.tobytes())


def _unpack(data: bytes, cols: int, rising: int = 0) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8).reshape(data[0], -1)
    out = np.zeros((raw.shape[1], 8), np.uint8)
    out[:, : data[0]] = raw.T
    out = out.view(np.uint64).reshape(cols, -1)
    np.cumsum(out[:rising], axis=1, out=out[:rising])
    return out


def _rising(key: np.ndarray) -> np.ndarray:
    """The distinct keys, rising."""
    key = np.sort(key)
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    return key[new]


def _distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys, rising; a place of each; and which of them each key is."""
    order = np.argsort(key)
    key = key[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    number = np.empty(len(key), np.int64)
    number[order] = np.cumsum(new) - 1
    return key[new], order[new], number


def _places(known: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Where each key stands among the known ones, which rise; their number if it doesn't."""
    at = np.searchsorted(known, key)
    inside = np.flatnonzero(at < len(known))
    at[inside[known[at[inside]] != key[inside]]] = len(known)
    return at


def _class(a: np.ndarray) -> np.ndarray:
    return np.minimum(a, 3)


# Kinds of the rows that are dealt out. A pass handles the n-grams with certain middle words: trigrams x y z, their contexts x y, the
# bigrams y z, and y, both as a context and as a word. Values: a is the count of an n-gram, s the sum of the counts of what follows a
# context, and n1, n2, n3 how many n-grams of it are seen once, twice and more.
TRIGRAM, CONTEXT, BIGRAM, WORD = range(4)  # asked: keys that rise; answered by as many columns of values, in the same order
VALUES = (1, 4, 1, 5)
FRONT, BACK, PARTIAL, SUMS = range(4, 8)  # counted: by x y, by y z; what a shard knows of y; numbers of n-grams by count
ROW = "pass int, shard int, kind int, batch long, data binary"


@dataclass(frozen=True)
class Deal:
    """Which pass and shard of it handles a key. Shards go by pairs of words, so that a frequent word is spread over them."""

    passes: int
    shards: int

    def turn(self, middle: np.ndarray) -> np.ndarray:
        return ((middle >> np.uint64(44)) * np.uint64(self.passes) >> np.uint64(20)).view(np.int64)

    def shard(self, pair: np.ndarray) -> np.ndarray:
        return ((pair & np.uint64(0xFFFFFFFF)) * np.uint64(self.shards) >> np.uint64(32)).view(np.int64)

    def questions(self, w: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """By kind: the pass and the shard of each distinct key, rising, and which key each word has; last of single words, with BEFORE behind the last."""
        front, back, out = _turn(w[0], 21) ^ w[1], _turn(w[1], 21) ^ w[2], []
        for key, pair, middle in ((_turn(w[0], 42) ^ back, front, w[1]), (front, front, w[1]), (back, back, w[1])):
            _, first, number = _distinct(key)
            out.append((self.turn(middle[first]), self.shard(pair[first]), number))
        key, _, number = _distinct(np.r_[w[2], BEFORE])
        return [*out, (self.turn(key), self.shard(key), number)]


def _rows(turn: int, kind: int, batch: int, shard: np.ndarray, cols: np.ndarray, rising: int) -> list[tuple]:
    """A row for each shard that has any; cols [c, n] stand in rising order."""
    if not len(shard):
        return []
    order = np.argsort(shard, kind="stable")
    cols, shard = cols[:, order], shard[order]
    at = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
    return [(turn, int(shard[lo]), kind, batch, _pack(cols[:, lo:hi], rising)) for lo, hi in zip(at, [*at[1:], len(shard)], strict=True)]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=["pass", "shard", "kind", "batch", "data"])


def asked_and_counted(docs: DataFrame, turn: int, deal: Deal) -> DataFrame:
    """What the batches ask in a pass, and the n-grams of the documents that the model learns from, both by shard."""

    def counted(held: list[np.ndarray]) -> list[tuple]:
        w = np.concatenate([np.zeros((4, 0), np.uint64), *held], 1)
        front, back = _turn(w[0], 21) ^ w[1], _turn(w[1], 21) ^ w[2]
        _, first, inverse = _distinct(_turn(w[0], 42) ^ back)
        count = np.bincount(inverse, w[3].astype(np.int64), len(first)).astype(np.uint64)
        w, front, back = w[:, first], front[first], back[first]
        a = np.lexsort((front, w[1]))
        rows = _rows(turn, FRONT, 0, deal.shard(front[a]), np.stack([w[1], front, w[2], count])[:, a], 2)
        b = np.lexsort((back, w[1]))
        b = b[count[b] > 0]
        return rows + _rows(turn, BACK, 0, deal.shard(back[b]), np.stack([w[1], back, w[0]])[:, b], 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        before = np.full(1, BEFORE)
        before = before[deal.turn(before) == turn]
        for number, rows in _batches(batches):
            w, _, off = words([r[1] for r in rows])
            mine = deal.turn(w[1]) == turn
            part, out = w[:, mine], []
            last = deal.turn(w[2]) == turn
            front, back = _turn(part[0], 21) ^ part[1], _turn(part[1], 21) ^ part[2]
            key, first, _ = _distinct(_turn(part[0], 42) ^ back)
            out += _rows(turn, TRIGRAM, number, deal.shard(front[first]), key[None], 1)
            alone = np.r_[w[2, last], before] if w.shape[1] else before[:0]
            for kind, key in ((CONTEXT, front), (BIGRAM, back), (WORD, alone)):
                key = _rising(key)
                out += _rows(turn, kind, number, deal.shard(key), key[None], 1)
            if out:
                yield _batch(out)
            own = np.repeat(np.array([r[3] for r in rows], bool), np.diff(off))
            if own.any():
                part = w[:, mine & own]
                # the last word of a text, which nothing follows, still counts as following the one before: a trigram seen 0 times
                ends = off[1:][np.diff(off) > 0] - 1
                ends = ends[own[ends] & last[ends]]
                over = np.stack([w[1, ends], w[2, ends], np.full(len(ends), NOTHING)])
                held.append(np.concatenate([np.r_[part, np.ones((1, part.shape[1]), np.uint64)], np.r_[over, np.zeros((1, len(ends)), np.uint64)]], 1))
                size += held[-1].shape[1]
                if size > HELD:
                    yield _batch(counted(held))
                    held, size = [], 0
        if size:
            yield _batch(counted(held))

    return docs.select("id", "text", "lang", "own").mapInArrow(run, ROW)


def _seen(a: np.ndarray) -> bytes:
    """The numbers of n-grams seen one to four times, their sum, and how many are seen three times or more."""
    return np.array([*((a == i).sum() for i in range(1, 5)), a.sum(), (a > 2).sum()], np.int64).tobytes()


def _follows(group: np.ndarray, a: np.ndarray, n: int) -> np.ndarray:
    """[4, n]: s, n1, n2, n3 of each context; group: the context of each n-gram."""
    return np.stack([np.bincount(group, a, n), *(np.bincount(group, _class(a) == i, n) for i in (1, 2, 3))]).astype(np.int64)


def _answers(rows: list[tuple], kind: int, known: np.ndarray, values: np.ndarray) -> list[tuple]:
    values = np.concatenate([values, np.zeros((len(values), 1), np.int64)], 1)
    return [(*r[:4], _pack(values[:, _places(known, _unpack(r[4], 1, 1)[0])])) for r in rows if r[2] == kind]


def _by_kind(table: pa.Table) -> tuple[list[tuple], dict[int, list[bytes]]]:
    rows = list(zip(*(c.to_pylist() for c in table.columns), strict=True))
    return rows, {k: [r[4] for r in rows if r[2] == k] for k in (FRONT, BACK, PARTIAL)}


def answered_pairs(rows: DataFrame, deal: Deal) -> DataFrame:
    """Trigrams, contexts and bigrams answered; what is asked about words goes on to the shards of words with what each shard here knows of them."""

    def run(table: pa.Table) -> pa.Table:
        rows, found = _by_kind(table.select(["pass", "shard", "kind", "batch", "data"]))
        turn, shard = rows[0][:2]
        middle, front, last, count = np.concatenate([np.zeros((4, 0), np.uint64), *(_unpack(d, 4, 2) for d in found[FRONT])], 1)
        key, first, inverse = _distinct(_turn(front, 21) ^ last)
        a = np.bincount(inverse, count.astype(np.int64), len(key)).astype(np.int64)
        out = _answers(rows, TRIGRAM, key, a[None]) + [(turn, shard, SUMS, 3, _seen(a))]
        pair, at, group = _distinct(front[first])
        out += _answers(rows, CONTEXT, pair, _follows(group, a, len(pair)))
        before = middle[first][at]  # of each bigram x y that occurs, y

        middle, back, head = np.concatenate([np.zeros((3, 0), np.uint64), *(_unpack(d, 3, 2) for d in found[BACK])], 1)
        _, first, _ = _distinct(_turn(back, 21) ^ head)
        pair, at, group = _distinct(back[first])
        a = np.bincount(group, minlength=len(pair))
        out += _answers(rows, BIGRAM, pair, a[None]) + [(turn, shard, SUMS, 2, _seen(a))]
        word, group = np.unique(np.r_[before, middle[first][at]], return_inverse=True)
        values = np.concatenate([np.bincount(group[: len(before)], minlength=len(word))[None] * (word != BEFORE), _follows(group[len(before) :], a, len(word))])
        out += _rows(turn, PARTIAL, 0, deal.shard(word), np.concatenate([word[None], values.astype(np.uint64)]), 1)
        return pa.Table.from_batches([_batch(out)])

    pairs = rows.where(F.col("kind") != WORD).groupBy("shard").applyInArrow(run, ROW)
    return pairs.unionByName(rows.where(F.col("kind") == WORD))


def answered_words(rows: DataFrame) -> DataFrame:
    """The questions about words answered; the other rows as they are."""

    def run(table: pa.Table) -> pa.Table:
        rows, found = _by_kind(table.select(["pass", "shard", "kind", "batch", "data"]))
        parts = np.concatenate([np.zeros((6, 0), np.uint64), *(_unpack(d, 6, 1) for d in found[PARTIAL])], 1)
        word, group = np.unique(parts[0], return_inverse=True)
        values = np.stack([np.bincount(group, c.astype(np.int64), len(word)).astype(np.int64) for c in parts[1:]])
        return pa.Table.from_batches([_batch(_answers(rows, WORD, word, values) + [(*rows[0][:2], SUMS, 1, _seen(values[0]))])])

    lone = F.col("kind").isin(WORD, PARTIAL)
    return rows.where(lone).groupBy("shard").applyInArrow(run, ROW).unionByName(rows.where(~lone))


def word_answers(docs: DataFrame, deal: Deal) -> DataFrame:
    """Answers to all questions of the batches, and the sums. Each pass over the texts counts and answers the n-grams of its own
    middle words, so that neither all counts nor all questions are on the disk at once."""
    out = None
    for turn in range(deal.passes):
        asked = asked_and_counted(docs, turn, deal).repartition(deal.shards, "shard")
        pairs = stashed(answered_pairs(asked, deal))
        done = stashed(answered_words(pairs))
        dropped(pairs)
        out = done if out is None else out.unionByName(done)
    return out


class WordModel:
    """Log probabilities of the words of a batch."""

    def __init__(self, deal: Deal, answers: list[tuple[int, int, int, bytes]], cuts: list[tuple[float, float, float]], everything: tuple[int, int, int, int]):
        """answers: pass, shard, kind and data of what the batch has asked."""
        self.deal, self.answers, self.cuts, self.everything = deal, sorted(answers, key=lambda r: r[:3]), cuts, np.array(everything, np.int64)

    def _values(self, w: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """By kind: the values of the distinct keys, and which key each word has."""
        out = []
        for kind, (turn, shard, number) in enumerate(self.deal.questions(w)):
            found = [_unpack(r[3], VALUES[kind]).view(np.int64) for r in self.answers if r[2] == kind]
            found = np.concatenate([np.zeros((VALUES[kind], 0), np.int64), *found], 1)
            if w.shape[1] and found.shape[1] != len(turn):
                raise RuntimeError("a batch has other answers than it asked for: the rows of the documents don't come in the same order again")
            values = np.zeros((len(turn), VALUES[kind]), np.int64)
            if w.shape[1]:
                values[np.argsort(turn * self.deal.shards + shard, kind="stable")] = found.T
            out.append((values, number))
        return out

    def __call__(self, w: np.ndarray, doc: np.ndarray, own: np.ndarray, spelling: np.ndarray) -> np.ndarray:
        """doc: the document of each word; own: whether the counts hold that document, whose words are then taken out; spelling: log probabilities."""
        three, pairs, two, (one, word) = self._values(w)
        word, none = word[:-1], word[-1]
        ahead = np.r_[none, word[:-1]][: len(word)]
        ahead[w[1] == BEFORE] = none
        levels, mine = [], np.flatnonzero(own)
        where = doc[mine] << 32  # a batch has fewer keys than that
        drop = np.ones(len(mine), np.int64)  # of each word: what its document gave to the count of its n-gram there
        nothing = (self.everything[None], np.zeros(len(doc), np.int64))
        for known, ctx in ((three, pairs), (two, (one[:, 1:], ahead)), ((one, word), nothing)):
            a, total = known[0][known[1], 0], ctx[0][ctx[1]]
            if len(mine):
                _, first, back = _distinct(known[1][mine] + where)
                had = a[mine[first]]
                left = np.maximum(0, had - np.bincount(back, drop, len(first)).astype(np.int64))
                _, place, group = _distinct(ctx[1][mine[first]] + where[first])
                changed = total[mine[first[place]]] - _follows(group, had, len(place)).T + _follows(group, left, len(place)).T
                a[mine], total[mine] = left[back], changed[group[back]]
                drop = np.zeros(len(mine), np.int64)
                drop[first[(left == 0) & (had > 0)]] = 1
            levels.append((a, total.astype(np.float64)))
        p = np.exp(spelling)
        for (a, total), d in zip(reversed(levels), self.cuts, strict=True):
            taken = np.r_[0.0, d][_class(a)]
            s, spare = total[:, 0], total[:, 1:] @ np.array(d)
            p = np.where(s > 0, (a - taken + spare * p) / np.maximum(1, s), p)
        # a long unknown word has less than the least number; only its spelling is left then, behind the spare mass of each order
        with np.errstate(divide="ignore"):
            rest = spelling.copy()
            for (_, total), d in zip(reversed(levels), self.cuts, strict=True):
                rest += np.where(total[:, 0] > 0, np.log(np.maximum(total[:, 1:] @ np.array(d), 1e-300) / np.maximum(1, total[:, 0])), 0.0)
            return np.where(p > 1e-290, np.log(np.maximum(p, 1e-300)), rest)


def trusted_counts(docs: DataFrame) -> DataFrame:
    """(k, a) of the texts, trusted ones: each task sums its own before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        held, size = [], 0

        def add() -> None:
            nonlocal keys, counts, held, size
            k, n = np.unique(grams(held)[0], return_counts=True)
            keys, back = np.unique(np.r_[keys, k], return_inverse=True)
            counts = np.bincount(back, np.r_[counts, n], len(keys)).astype(np.int64)
            held, size = [], 0

        for batch in batches:
            for t in batch.column(0).to_pylist():
                held.append(t.encode() + END if t else b"")
                size += len(held[-1])
                if size > 2 << 20:
                    add()
        add()
        yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(counts)], names=["k", "a"])

    return docs.select("text").mapInArrow(run, "k long, a long").groupBy("k").agg(F.sum("a").alias("a"))


def discounts(counts: DataFrame) -> tuple[float, float, float]:
    """D1, D2, D3+ from the numbers of n-grams seen one to four times; each lies between 0 and its count."""
    return _cuts(*counts.agg(*(F.count_if(F.col("a") == i) for i in range(1, 5))).first())


def _cuts(*seen: int) -> tuple[float, float, float]:
    n = {f"n{i}": x for i, x in enumerate(seen, 1)}
    y = n["n1"] / (n["n1"] + 2 * n["n2"]) if n["n1"] else 0.0
    out = []
    for i in (1, 2, 3):
        d = i - (i + 1) * y * n[f"n{i + 1}"] / n[f"n{i}"] if n[f"n{i}"] else 0.5
        out.append(min(max(d, 0.1), i - 0.05))
    return tuple(out)


def probabilities(counts: DataFrame, asked: DataFrame) -> DataFrame:
    """(k, p) for the asked 4-grams (k); counts: (k, a) of the trusted text."""
    tables = [counts]
    for order in range(ORDER - 1, 0, -1):  # continuation counts: distinct bytes in front
        tables.append(tables[-1].groupBy((F.col("k") % (1 << 8 * order)).alias("k")).agg(F.count("*").alias("a")))
    tables = tables[::-1]
    questions = [asked]
    for order in range(ORDER - 1, 0, -1):
        questions.append(questions[-1].select((F.col("k") % (1 << 8 * order)).alias("k")).distinct())
    questions = questions[::-1]
    lower = None
    for n in range(1, ORDER + 1):
        table, d = tables[n - 1], discounts(tables[n - 1])
        ctx = table.groupBy(F.floor(F.col("k") / 256).alias("c")).agg(F.sum("a").alias("s"), *(F.count_if(F.col("a") == i).alias(f"n{i}") for i in (1, 2)), F.count_if(F.col("a") > 2).alias("n3"))
        q = questions[n - 1].withColumn("c", F.floor(F.col("k") / 256)).join(table, "k", "left").join(ctx, "c", "left")
        if lower is None:
            q = q.withColumn("low", F.lit(1 / 256))
        else:
            q = q.withColumn("r", F.col("k") % (1 << 8 * (n - 1))).join(lower.select(F.col("k").alias("r"), F.col("p").alias("low")), "r")
        a = F.coalesce("a", F.lit(0))
        own = a - F.when(a > 2, d[2]).when(a == 2, d[1]).when(a == 1, d[0]).otherwise(0.0)
        spare = d[0] * F.col("n1") + d[1] * F.col("n2") + d[2] * F.col("n3")
        lower = q.select("k", F.coalesce((own + spare * F.col("low")) / F.col("s"), "low").alias("p"))
        if n < ORDER:
            lower = stashed(lower)
    return lower


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """Numbers and rows (id, bytes, lang, own) of batches of about BATCH bytes. A batch is named by its content, and a scan that runs again makes the same batches."""
    rows, size = [], 0

    def name() -> int:
        content = hashlib.sha256(repr([(r[0], len(r[1])) for r in rows]).encode())
        for r in rows:
            content.update(r[1])
        return int.from_bytes(content.digest()[:8], "little", signed=True)

    for batch in batches:
        for i, text, lang, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            rows.append((i, text.encode() + END if text else b"", lang, own))
            size += len(rows[-1][1])
            if size > BATCH:
                yield name(), rows
                rows, size = [], 0
    if rows:
        yield name(), rows


def packed_batches(docs: DataFrame, turn: int, rounds: int) -> DataFrame:
    """(batch, ids, langs, owns, sizes, packed), one row a batch of this round, dealt out by batch; all later steps of a round reuse the exchange."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        types = None

        def typed() -> Iterator[pa.RecordBatch]:
            nonlocal types
            for batch in batches:
                types = [pa.int64(), pa.list_(batch.schema.field(0).type), pa.list_(pa.string()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary()]
                yield batch

        for number, rows in _batches(typed()):
            if number % rounds == turn:
                cols = [[number], [[r[0] for r in rows]], [[r[2] for r in rows]], [[r[3] for r in rows]], [[len(r[1]) for r in rows]], [pack(b"".join(r[1] for r in rows))]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["batch", "ids", "langs", "owns", "sizes", "packed"])

    n = max(8, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return docs.select("id", "text", "lang", "own").mapInArrow(run, f"batch long, ids array<{kind}>, langs array<string>, owns array<boolean>, sizes array<long>, packed binary").repartition(n, "batch")


def _texts(packed: bytes, sizes: list[int]) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(packed, max_output_size=max(1, sum(sizes)))
    ends = np.cumsum(sizes).tolist()
    return [raw[e - s : e] for s, e in zip(sizes, ends, strict=True)]


def all_grams(docs: DataFrame) -> DataFrame:
    """(k): the distinct 4-grams of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, np.uint32)
        for batch in batches:
            for part in sub_batches(batch, 0):
                seen = _rising(np.r_[seen, _rising(grams([t.encode() + END if t else b"" for t in part.column(0).to_pylist()])[0])])
                if len(seen) > HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int64))], names=["k"])
                    seen = seen[:0]
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int64))], names=["k"])

    return docs.select("text").mapInArrow(run, "k long").distinct()


def asked_grams(batches: DataFrame) -> DataFrame:
    """(batch, k): the distinct 4-grams of each batch."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows:
            for batch, packed, sizes in zip(*(c.to_pylist() for c in row.columns), strict=True):
                texts = _texts(packed, sizes)
                k = [np.zeros(0, np.uint32), *(_rising(grams(texts[lo:hi])[0]) for lo, hi in _parts(sizes))]
                k = _rising(np.concatenate(k))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), batch)), pa.array(k.astype(np.int64))], names=["batch", "k"])

    return batches.select("batch", "packed", "sizes").mapInArrow(run, "batch long, k long")


def _parts(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about 1 MB."""
    lo = 0
    while lo < len(sizes):
        hi = lo + max(1, int(np.searchsorted(np.cumsum(sizes[lo:]), 1 << 20)))
        yield lo, min(hi, len(sizes))
        lo = hi


def perplexities(docs: DataFrame, counts: DataFrame, passes: int | None = None) -> DataFrame:
    """(id, lang, n_bytes, perplexity) of every row; an empty text has perplexity 1. docs: id, text, lang, own (whether the model learns from it); counts: its 4-grams."""
    kind = docs.schema["id"].dataType.simpleString()
    if passes is None:
        passes = min(PASSES, 1 + (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // PASS_BYTES)
    deal = Deal(passes, max(8, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 4))
    p = stashed(probabilities(counts, stashed(all_grams(docs))))
    answered = word_answers(docs, deal)
    seen = np.zeros((4, 6), np.int64)
    for order, data in answered.where(F.col("kind") == SUMS).select("batch", "data").collect():
        seen[order] += np.frombuffer(data, np.int64)
    cuts, everything = [_cuts(*map(int, x[:4])) for x in seen[1:]], tuple(int(seen[1, i]) for i in (4, 0, 1, 5))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows:
            for r in range(row.num_rows):
                ids, langs, owns, sizes, packed = (row.column(c)[r].as_py() for c in range(5))
                found = row.column(5)[r].values
                if sum(sizes) and not len(found):
                    raise RuntimeError("a batch has no answers: it isn't the one that asked")
                texts, look, total = _texts(packed, sizes), Lookup(found), [np.zeros(1)]
                for lo, hi in _parts(sizes):
                    total.append(total[-1][-1] + np.cumsum(look(grams(texts[lo:hi])[0])))
                w, starts, off = words(texts)
                doc = np.repeat(np.arange(len(sizes)), np.diff(off))
                model = WordModel(deal, [tuple(x.values()) for x in row.column(6)[r].as_py()], cuts, everything)
                each = model(w, doc, np.array(owns, bool)[doc], np.diff(np.concatenate(total)[starts]))
                score = np.bincount(doc, each, len(sizes)) / np.maximum(1, sizes)
                sizes = np.maximum(0, np.array(sizes, np.int64) - len(END))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, row.schema.field(0).type.value_type), pa.array(langs, pa.string()), pa.array(sizes), pa.array(np.exp(-score))],
                    names=["id", "lang", "n_bytes", "perplexity"],
                )

    out, rounds = None, (passes + 1) // 2
    empty = lambda c, t: F.coalesce(c, F.array().cast(f"array<{t}>")).alias(c)
    answer = "struct<pass:int,shard:int,kind:int,data:binary>"
    for turn in range(rounds):
        batches = packed_batches(docs, turn, rounds)
        spelt = asked_grams(batches).join(bounded(p), "k").groupBy("batch").agg(F.collect_list(F.struct("k", F.log("p").cast("float").alias("p"))).alias("answers"))
        mine = answered.where((F.col("kind") <= WORD) & (F.pmod("batch", F.lit(rounds)) == turn))
        known = mine.groupBy("batch").agg(F.collect_list(F.struct("pass", "shard", "kind", "data")).alias("known"))
        joined = batches.join(spelt.hint("merge"), "batch", "left").join(known.hint("merge"), "batch", "left")
        joined = joined.select("ids", "langs", "owns", "sizes", "packed", empty("answers", "struct<k:bigint,p:float>"), empty("known", answer))
        done = stashed(joined.mapInArrow(run, f"id {kind}, lang string, n_bytes long, perplexity double"))
        out = done if out is None else out.unionByName(done)
    return out


class Lookup:
    """Log probabilities by 4-gram: a dense table over the pairs of bytes that occur."""

    def __init__(self, found: pa.StructArray):
        k, p = found.field("k").to_numpy(zero_copy_only=False).astype(np.int64), found.field("p").to_numpy(zero_copy_only=False)
        front, back = np.unique(k >> 16), np.unique(k & 0xFFFF)
        self.front, self.back = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.front[front], self.back[back] = np.arange(len(front)), np.arange(len(back))
        self.width = max(1, len(back))
        self.table = np.zeros(max(1, len(front)) * self.width, np.float32)
        self.table[self.front[k >> 16] * self.width + self.back[k & 0xFFFF]] = p

    def __call__(self, key: np.ndarray) -> np.ndarray:
        return self.table[self.front[key >> np.uint32(16)] * self.width + self.back[key & np.uint32(0xFFFF)]].astype(np.float64)


def quality(docs: DataFrame, trusted_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quantile: float = QUANTILE) -> DataFrame:
    """One row per row: doc_id, lang, n_bytes, perplexity, threshold, kept.

    trusted_ids: a column of ids. The threshold is the quantile over the trusted documents of the language (a null
    language is one of its own); a language without any has none and keeps all. A null text is empty and kept.
    Rows with one id are each scored; other columns are not read.
    """
    trusted = trusted_ids.toDF("id").where("id IS NOT NULL").distinct()
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    trusted = stashed(trusted)
    marked = own.join(bounded(trusted.withColumn("own", F.lit(True))), "id", "left").withColumn("own", F.coalesce("own", F.lit(False)))
    scored = perplexities(marked, stashed(trusted_counts(marked.where("own"))))
    known = scored.join(bounded(trusted), "id", "left_semi")
    lang = F.coalesce(F.concat(F.lit("="), "lang"), F.lit("-"))
    limit = known.where("n_bytes > 0").groupBy(lang.alias("l")).agg(F.percentile_approx("perplexity", quantile, 10000).alias("threshold"))
    out = scored.withColumn("l", lang).join(bounded(limit, 10_000), "l", "left")
    return out.select(F.col("id").alias("doc_id"), "lang", "n_bytes", "perplexity", "threshold", F.coalesce((F.col("perplexity") <= F.col("threshold")) | (F.col("n_bytes") == 0), F.lit(True)).alias("kept"))


def op7_quality_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality(read_documents(spark, sf_dir), labels.where("quality = 1").select("doc_id"))
