"""Language identification by cross-parsing entropy.

A suffix automaton of labelled text per language accepts exactly the substrings of that text. A
document is parsed against each automaton into phrases, each the longest match from where the one
before ended; phrases times log2(training length) a symbol estimate the cross entropy, and the
language with the least wins. Automata stand in numpy tables, dense or, for large alphabets, sorted by
state and symbol. All blocks of a batch are parsed side by side, each from its start; then the phrase that
leaves a block is followed into the next until it meets a place where that block's own parse begins a phrase too,
from where both are the same. So the phrases counted are those of the whole text, parsed from its beginning.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded, crc32_mod, read_documents, strings, sub_batches, worker_cache

#: The bound of the training sample: documents a language, taken whole; those whose length is nearest to TYPICAL characters.
DOCS, TYPICAL = 24, 1500
#: Cells of a dense table; an automaton that needs more holds its transitions alone.
DENSE = 1 << 22
#: Symbols of a block.
BLOCK = 256
#: How fast the score falls with a rival's entropy, in bits a symbol.
SHARPNESS = 8.0
UNDETERMINED = "und"


@cache
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


class Sparse:
    """Transitions sorted by state and symbol."""

    def __init__(self, follow: list[dict[int, int]], symbols: int):
        key = np.array([s * symbols + c for s, t in enumerate(follow) for c in t], np.int64)
        target = np.array([x for t in follow for x in t.values()], np.int64)
        order = np.argsort(key)
        # the last key, which no state has, ends each search
        self.symbols, self.key, self.target = symbols, np.r_[key[order], np.iinfo(np.int64).max], np.r_[target[order], 0]

    def step(self, state: np.ndarray | int, symbol: np.ndarray) -> np.ndarray:
        key = state * self.symbols + symbol.astype(np.int64)
        at = np.searchsorted(self.key, key)
        return np.where(self.key[at] == key, self.target[at], 0)


def suffix_automaton(text: np.ndarray, symbols: int) -> np.ndarray | Sparse:
    """Transitions [state, symbol]; state 0 is the root, and 0 as a target means no transition."""
    follow: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in text.tolist():
        cur = len(follow)
        follow.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in follow[p]:
            follow[p][c] = cur
            p = link[p]
        if p >= 0:
            q = follow[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                twin = len(follow)
                follow.append(dict(follow[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and follow[p].get(c) == q:
                    follow[p][c] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        last = cur
    if len(follow) * symbols > DENSE:
        return Sparse(follow, symbols)
    out = np.zeros((len(follow), symbols), np.uint16 if len(follow) < 1 << 16 else np.int32)
    for s, t in enumerate(follow):
        if t:
            out[s, list(t)] = list(t.values())
    return out


class Alphabet:
    """Symbols of characters: one each for the letters of the training text, lowered; 0 for any other letter, 1 for a run of non-letters."""

    def __init__(self, texts: list[str]):
        codes = np.concatenate([_codes(t) for t in texts] or [np.zeros(0, np.uint32)])
        self.chars = np.unique(codes[_letters()[codes]])
        self.size = len(self.chars) + 2

    def symbols(self, codes: np.ndarray) -> np.ndarray:
        letter = _letters()[codes]
        at = np.searchsorted(self.chars, codes)
        at[at == len(self.chars)] = 0
        known = letter & (self.chars[at] == codes) if len(self.chars) else np.zeros(len(codes), bool)
        return np.where(known, at + 2, np.where(letter, 0, 1)).astype(np.uint8 if self.size <= 256 else np.int32)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


def phrases(table: np.ndarray | Sparse, sym: np.ndarray, ends: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Phrases of each text; `sym` holds the symbols of all texts end to end, `ends` where they end."""
    if isinstance(table, Sparse):
        step, root = table.step, None
    else:
        flat, width = table.ravel(), table.shape[1]
        step, root = (lambda state, c: flat[state * width + c]), table[0]
    size = np.diff(ends, prepend=0)
    per = -(-size // block)
    owner = np.repeat(np.arange(len(ends)), per)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
    begin = (ends - size)[owner] + block * number
    end = np.minimum(begin + block, ends[owner])
    starts = np.zeros(len(sym) + 1, bool)
    sym = np.r_[sym, sym[:1]]

    def parse(pos: np.ndarray, limit: np.ndarray, halt: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """From `pos` on: the first start of a phrase at which `halt` is true (or that stands at `limit` or behind), and the phrases up to there."""
        stop, many, final = limit.copy(), np.zeros(len(pos), np.int64), ends[owner]
        lane, state = np.arange(len(pos)), np.zeros(len(pos), np.int32)
        while len(lane):
            over = pos >= final
            c = sym[pos]
            now = step(state, c)
            fresh = (state == 0) | (now == 0)
            done = over | fresh & (pos >= limit if halt is None else halt[pos])
            if done.any():
                stop[lane[done]] = pos[done]
                go = ~done
                lane, pos, c, now, fresh, final, limit = lane[go], pos[go], c[go], now[go], fresh[go], final[go], limit[go]
            if halt is None:
                starts[pos[fresh]] = True
            else:
                many[lane[fresh]] += 1
            state = np.where(now == 0, step(np.zeros_like(pos), c) if root is None else root[c], now).astype(np.int32)
            pos = pos + 1
        return stop, many

    leave, _ = parse(begin, end, None)
    meet, between = parse(leave, leave, starts)
    before = np.r_[0, np.cumsum(starts)]
    out = np.zeros(len(ends), np.int64)
    # along the blocks in which the parse of a text meets those of its blocks
    first = np.cumsum(per) - per
    text = np.flatnonzero(per)
    at, place = first[text], (ends - size)[text]
    while len(text):
        out[text] += before[end[at]] - before[place] + between[at]
        place = meet[at]
        go = place < ends[text]
        text, place = text[go], place[go]
        at = first[text] + (place - (ends - size)[text]) // block
    return out


class LanguageModel:
    """Automata by language, learned from (language, text) samples. The samples travel to the workers, which build the automata themselves."""

    def __init__(self, samples: dict[str, list[str]]):
        self.samples, self.langs = samples, sorted(samples)
        self.alphabet = Alphabet([t for x in samples.values() for t in x])
        self.tables, self.bits = [], []
        for lang in self.langs:
            text = _squeeze(self.alphabet.symbols(np.concatenate([_codes(t + "\n") for t in samples[lang]])))
            self.tables.append(suffix_automaton(text, self.alphabet.size))
            self.bits.append(np.log2(max(2, len(text))))

    def __reduce__(self):
        return _known_model, (self.samples,)

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        """(language, score) of each text; ties go to the first language by code point."""
        codes = [_codes(t) for t in texts]
        lengths = np.array([len(c) for c in codes], np.int64)
        joined = np.concatenate([*codes, np.zeros(0, np.uint32)])
        doc = np.repeat(np.arange(len(texts)), lengths)
        has = np.zeros(len(texts), bool)
        has[doc[_letters()[joined]]] = True
        if not self.langs:
            return [(UNDETERMINED, 0.0)] * len(texts)
        sym = self.alphabet.symbols(joined)
        keep = np.ones(len(sym), bool)
        keep[1:] = (sym[1:] != 1) | (sym[:-1] != 1) | (doc[1:] != doc[:-1])
        sym, doc = sym[keep], doc[keep]
        size = np.bincount(doc, minlength=len(texts))
        ends = np.cumsum(size)
        need = np.stack([phrases(t, sym, ends) * b for t, b in zip(self.tables, self.bits, strict=True)], 1)
        need /= np.maximum(1, size)[:, None]
        best = need.argmin(1)
        share = np.exp2(SHARPNESS * (need.min(1)[:, None] - need))
        score = 1 / share.sum(1)
        return [(self.langs[b], float(s)) if h else (UNDETERMINED, 0.0) for b, s, h in zip(best, score, has, strict=True)]


def _known_model(samples: dict[str, list[str]]) -> LanguageModel:
    """The model of a worker's last task, if it is the same."""
    held = worker_cache("language")
    if "model" not in held or held["model"].samples != samples:
        held["model"] = LanguageModel(samples)
    return held["model"]


def _squeeze(sym: np.ndarray) -> np.ndarray:
    keep = np.ones(len(sym), bool)
    keep[1:] = (sym[1:] != 1) | (sym[:-1] != 1)
    return sym[keep]


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs: int = DOCS, typical: int = TYPICAL) -> LanguageModel:
    """Fit on at most `docs` different texts a language, whole: those whose length is nearest to `typical` characters by powers of 2, then least by hash.

    Rows without language or without text are left out; equal texts of a language are one, whatever their ids. An empty
    table gives a model without languages. Other columns are not read.
    """
    text = F.col(text_col)
    rows = labelled.where(F.col(lang_col).isNotNull() & (F.length(F.trim(text)) > 0)).select(F.col(lang_col).alias("lang"), text.alias("text"), F.xxhash64(text).alias("h"))
    far = F.floor(F.abs(F.log2(F.length("text") / typical))).alias("far")
    different = rows.select("lang", "h", far).distinct()
    ranked = different.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("far", "h")))
    picked = bounded(ranked.where(F.col("r") <= docs).select("lang", "h"), 100_000)
    sample = rows.join(picked, ["lang", "h"], "left_semi").groupBy("lang", "h").agg(F.min("text").alias("text"))
    samples: dict[str, list[str]] = {}
    for r in sorted(sample.collect(), key=lambda r: (r["lang"], r["h"])):  # `docs` rows a language
        samples.setdefault(r["lang"], []).append(r["text"])
    return LanguageModel(samples)


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row per row: the id, the columns in `keep`, lang_pred, score. `und` and score 0 for a text that is null or has no letter.

    Texts are parsed whole whatever their length, and equal texts have equal results; ties go to the first language by code
    point. Null and repeated ids keep their rows; an empty table gives an empty result. Columns not in `keep` are not read.
    """
    schema = {c: docs.schema[c].dataType.simpleString() for c in [id_col, *(keep or [])]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in sub_batches(b, 0)):
            found = model.predict(strings(batch.column(0)))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=[*schema, "lang_pred", "score"])

    ddl = ", ".join(f"`{c}` {t}" for c, t in schema.items())
    return docs.select(F.col(text_col).alias("_text"), *schema).mapInArrow(run, f"{ddl}, lang_pred string, score double")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    held_out = F.coalesce(crc32_mod("doc_id", 4) == 2, F.lit(False))
    model = train(docs.where(~held_out))
    return identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
