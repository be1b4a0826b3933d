"""Toxicity by subword-bag embeddings.

A word is the mean of the embeddings of its hashed character n-grams, a window of words the mean
of its words, and a linear softmax over that mean gives the probability that the window is toxic.
Embeddings and softmax are trained jointly in numpy, so a misspelling that was never seen still
shares most of its n-grams with the word it was made from. A document is as toxic as its worst window.

Labels hold for whole documents, so training alternates: fit the windows, then keep of each toxic
document only the windows that look toxic (its best one at least) and go on.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import crc32_mod, prefix_hash, read_documents, span_hash, stashed, strings, sub_batches

#: The bound of the training sample: documents of each label, taken whole.
DOCS = 1200
BUCKETS, DIM, WINDOW = 1 << 18, 4, 8
GRAMS = (3, 4, 5)
#: Chi-squared between an n-gram's documents and the labels, from which it is learned.
CONTRAST = 20.0
THRESHOLD = 0.7
#: Distinct words that a worker remembers.
REMEMBERED = 300_000


def gram_buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of `<word>`, and of the whole, end to end; and where each word's start."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    raw = [f"<{w}>".encode() for w in words]
    size = np.array([len(x) for x in raw])
    data = np.frombuffer(b"".join(raw), np.uint8)
    pre = prefix_hash(data)
    stop = np.cumsum(size)
    start = stop - size
    owner = np.repeat(np.arange(len(words)), size)
    at = np.arange(len(data))
    parts, owners = [span_hash(pre, start, stop)], [np.arange(len(words))]
    for n in GRAMS:
        ok = at + n <= stop[owner]
        parts.append(span_hash(pre, at[ok], at[ok] + n))
        owners.append(owner[ok])
    ids, who = np.concatenate(parts), np.concatenate(owners)
    order = np.argsort(who, kind="stable")
    return (ids[order] % np.uint64(BUCKETS)).astype(np.int64), np.searchsorted(who[order], np.arange(len(words)))


def words_of(text: str) -> list[str]:
    return text.lower().split()


def core(word: str) -> str:
    """A word without the signs around it."""
    lo, hi = 0, len(word)
    while lo < hi and not word[lo].isalnum():
        lo += 1
    while hi > lo and not word[hi - 1].isalnum():
        hi -= 1
    return word[lo:hi] or word


class ToxicityModel:
    def __init__(self, bucket_scores: np.ndarray, bias: float):
        #: By linearity the embeddings matter only through their logit.
        self.scores, self.bias = bucket_scores, bias
        self.known: dict[str, float] = {}

    def __getstate__(self):
        return {"scores": self.scores, "bias": self.bias, "known": {}}

    def word_scores(self, words: list[str]) -> list[float]:
        ids, start = gram_buckets([core(w) for w in words])
        if not words:
            return []
        return (np.add.reduceat(self.scores[ids], start) / np.diff(np.r_[start, len(ids)])).tolist()

    def score(self, texts: list[str]) -> list[float]:
        """0 to 1; a text without words has the probability of an empty window."""
        split = [words_of(t) for t in texts]
        distinct = set().union(*split)
        if len(self.known) + len(distinct) > REMEMBERED:
            self.known = {}
        new = sorted(distinct - self.known.keys())
        self.known.update(zip(new, self.word_scores(new), strict=True))
        out = []
        for words in split:
            x = np.fromiter(map(self.known.__getitem__, words), np.float64, len(words))
            out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, self.bias + worst_window(x))))))
        return out

    def logit(self, text: str) -> float:
        return self.bias + worst_window(np.array(self.word_scores(words_of(text))))


def worst_window(x: np.ndarray) -> float:
    """The largest mean of WINDOW words in a row, or of all where there are fewer."""
    if len(x) <= WINDOW:
        return float(x.mean()) if len(x) else 0.0
    total = np.r_[0.0, np.cumsum(x)]
    return float((total[WINDOW:] - total[:-WINDOW]).max() / WINDOW)


def fit(texts: list[str], labels: list[int], rounds: int = 4, steps: int = 10, seed: int = 7) -> ToxicityModel:
    """Train on labelled texts; without both labels every score is the prior.

    Every fourth text of each label is kept from the embeddings and sets the scale of the scores.
    """
    y_doc = np.array(labels, np.int64)
    if not len(y_doc) or y_doc.min() == y_doc.max():
        return ToxicityModel(np.zeros(BUCKETS), 3.0 if len(y_doc) and y_doc[0] == 1 else -3.0)
    rank = np.zeros(len(y_doc), np.int64)
    for v in (0, 1):
        rank[y_doc == v] = np.arange((y_doc == v).sum())
    fitted = np.flatnonzero((rank % 4 != 3) | (np.bincount(y_doc)[y_doc] < 8))
    model = ToxicityModel(_embed([texts[i] for i in fitted], y_doc[fitted], rounds, steps, seed), 0.0)
    rest = np.setdiff1d(np.arange(len(y_doc)), fitted)
    rest = rest if len(set(y_doc[rest].tolist())) == 2 else fitted
    scale, model.bias = _scale(np.array([model.logit(texts[i]) for i in rest]), y_doc[rest])
    model.scores = model.scores * scale
    model.known = {}
    return model


def _contrast(clean: np.ndarray, toxic: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Chi-squared with one degree of freedom of each bucket's document counts by label."""
    n1, n0 = max(1, int(y.sum())), max(1, int(len(y) - y.sum()))
    total, n = clean + toxic, n0 + n1
    spread = total * (n - total) * (n0 * n1)
    return np.where(spread > 0, n * (toxic * n0 - clean * n1) ** 2 / np.maximum(1, spread), 0.0)


def _scale(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept that put THRESHOLD a little above the clean texts, below the toxic ones above them.

    Some texts are labelled toxic for no word of theirs, so those that stay among the clean don't count.
    """
    clean = float(np.quantile(x[y == 0], 0.995))
    above = x[(y == 1) & (x > clean)]
    toxic = float(np.quantile(above, 0.05)) if len(above) else clean + (x.std() or 1.0)
    slope = 6.0 / max(toxic - clean, 1e-9)
    return slope, math.log(THRESHOLD / (1 - THRESHOLD)) - slope * (clean + 0.15 * (toxic - clean))


def _embed(texts: list[str], y_doc: np.ndarray, rounds: int, steps: int, seed: int) -> np.ndarray:
    """Logit of each bucket after joint training of the embeddings and the softmax."""
    rows, owner, seen = [], [], []
    vocab: dict[str, int] = {}
    for d, text in enumerate(texts):
        ids = [vocab.setdefault(core(w), len(vocab)) for w in words_of(text)]
        seen.append(np.unique(np.array(ids, np.int64)))
        for i in range(0, max(1, len(ids) - WINDOW // 2), WINDOW // 2):
            if part := ids[i : i + WINDOW]:
                rows.append(part + [-1] * (WINDOW - len(part)))
                owner.append(d)
    if not rows:
        return np.zeros(BUCKETS)
    win, owner = np.array(rows), np.array(owner)
    size = np.maximum(1, (win >= 0).sum(1))
    grams, start = gram_buckets(list(vocab))
    count = np.diff(np.r_[start, len(grams)])
    word_of_gram = np.repeat(np.arange(len(vocab)), count)
    # an n-gram whose share of documents hardly differs between the labels only tells documents apart: it stays 0
    per_doc = [np.unique(np.concatenate([grams[start[w] : start[w] + count[w]] for w in ids])) if len(ids) else ids for ids in seen]
    common = np.flatnonzero(_contrast(*(np.bincount(np.concatenate([x for x, v in zip(per_doc, y_doc, strict=True) if v == label]), minlength=BUCKETS) for label in (0, 1)), y_doc) >= CONTRAST)
    place = np.full(BUCKETS, -1)
    place[common] = np.arange(len(common))
    use = place[grams] >= 0
    grams, word_of_gram = place[grams[use]], word_of_gram[use]
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.05, (len(common), DIM))
    soft = rng.normal(0, 0.5, (DIM, 2))
    shift = np.zeros(2)
    params = [emb, soft, shift]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    t = 0
    y = y_doc[owner]
    active = np.ones(len(win), bool)

    def words() -> np.ndarray:
        vec = np.empty((len(vocab) + 1, DIM))
        for k in range(DIM):
            vec[:-1, k] = np.bincount(word_of_gram, emb[grams, k], len(vocab)) / count
        vec[-1] = 0
        return vec

    for r in range(rounds):
        rows = np.flatnonzero(active)
        yy = y[rows]
        weight = np.where(yy == 1, 0.3 / max(1, (yy == 1).sum()), 0.7 / max(1, (yy == 0).sum()))
        flat = win[rows].ravel()
        for _ in range(steps):
            bag = words()[win[rows]].sum(1) / size[rows, None]
            logit = bag @ soft + shift
            p = np.exp(logit - logit.max(1, keepdims=True))
            g = p / p.sum(1, keepdims=True)
            g[np.arange(len(rows)), yy] -= 1
            g *= weight[:, None]
            d_bag = g @ soft.T / size[rows, None]
            d_emb = np.empty_like(emb)
            for k in range(DIM):
                d_word = np.bincount(flat + 1, np.repeat(d_bag[:, k], WINDOW), len(vocab) + 1)[1:] / count
                d_emb[:, k] = np.bincount(grams, d_word[word_of_gram], len(common))
            t += 1
            for q, d, (m, v) in zip(params, (d_emb + 1e-5 * emb, bag.T @ g + 1e-4 * soft, g.sum(0)), moments, strict=True):
                m *= 0.9
                m += 0.1 * d
                v *= 0.98
                v += 0.02 * d * d
                q -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.98**t)) + 1e-6)
        if r + 1 < rounds:  # toxic documents keep the windows that look toxic, their best one at least
            logit = (words() @ soft)[win].sum(1) / size[:, None] + shift
            p = 1 / (1 + np.exp(np.clip(logit[:, 0] - logit[:, 1], -50, 50)))
            best = np.zeros(len(texts))
            np.maximum.at(best, owner, p)
            active = (y == 0) | (p >= np.minimum(best[owner], 0.9))
    out = np.zeros(BUCKETS)
    out[common] = emb @ (soft[:, 1] - soft[:, 0])
    return out


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = DOCS) -> ToxicityModel:
    """Fit on at most `most` documents of each label, whole: those of the least hashes of id.

    Rows with a null id or label, or without text, are left out; an id with both labels counts as toxic, and of texts
    with one id the least stands for it. Without labelled text all score alike. Other columns are not read.
    """
    label = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    text = docs.where(F.length(text_col) > 0).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    both = stashed(label.join(text.select("id").distinct(), "id", "left_semi").withColumn("h", F.xxhash64("id")))
    # of hashes spread evenly, these hold about four times as many as are taken, so that no window sees a whole label
    count = {r["y"]: r["count"] for r in both.groupBy("y").count().collect()}  # a row a label
    reach = F.lit(False)
    for y, n in count.items():
        reach |= (F.col("y") == y) & (F.col("h") <= -(1 << 63) + min((1 << 64) - 1, 4 * most * (1 << 64) // n))
    order = Window.partitionBy("y").orderBy("h", "id")
    picked = both.where(reach).withColumn("r", F.row_number().over(order)).where(F.col("r") <= most).select("id", "y")
    rows = text.join(F.broadcast(picked), "id").groupBy("id", "y").agg(F.min("text").alias("text")).collect()  # `most` rows a label
    rows.sort(key=lambda r: r["id"])
    return fit([r["text"] for r in rows], [r["y"] for r in rows])


def toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row: the id, score (0 to 1), predicted (1 from `threshold`). A null text scores as an empty one.

    Whole texts are scored whatever their length, equal ones alike. Null and repeated ids keep their rows; an empty table
    gives an empty result. Other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in sub_batches(b, 1)):
            found = model.score(strings(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64()), pa.array([int(x >= threshold) for x in found], pa.int32())], names=[id_col, "score", "predicted"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, score double, predicted int")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = F.coalesce(crc32_mod("doc_id", 3) == 1, F.lit(False))
    model = train(docs, labels.where(~held_out))
    return toxicity(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")
