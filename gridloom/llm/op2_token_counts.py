"""Token counts: rank-synchronous merging over ragged arrays.

Distinct pre-tokens of a batch are held end to end in one numpy array, cut into sequences where no
piece of the vocabulary can reach across. In each round every sequence applies its own lowest-rank
(highest-score) pair, wherever it stands, at the same time, and sequences without a pair leave. Where
a merge makes a pair that goes before those further right, these wait for the next round, so that the
order is that of merging one by one from the left. The surviving symbols are the token count.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import read_documents, strings, sub_batches, worker_cache

NONE = np.int32(2**31 - 1)
BLANK = "▁"
#: Distinct pre-tokens that a worker remembers.
REMEMBERED = 200_000


def _blank_tokens(n: int, lengths: set[int]) -> int:
    """Tokens of n blanks, where two neighbours merge, the leftmost first, if a piece has the length of both."""
    runs = [1] * n
    while (k := next((k for k in range(len(runs) - 1) if runs[k] + runs[k + 1] in lengths), None)) is not None:
        runs[k : k + 2] = [runs[k] + runs[k + 1]]
    return len(runs)


class PieceMerges:
    """Merge tables of a piece model with byte fallback and identity normalisation."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm = model.normalizer_spec
        if len(norm.precompiled_charsmap) or norm.remove_extra_whitespaces or not norm.add_dummy_prefix:
            raise ValueError("only models without text normalisation are supported")
        pieces = {p.piece: p.score for p in model.pieces if p.type == 1}
        #: Equal scores share a rank, so that the leftmost of them goes first.
        order = {s: i for i, s in enumerate(sorted(set(pieces.values()), reverse=True))}
        ids = {p: i for i, p in enumerate(pieces)}
        self.cost = [1] * len(ids)
        joined = {c for p in pieces if len(p) > 1 for c in p}
        for c in sorted(joined - ids.keys()):
            ids[c] = len(ids)
            self.cost.append(len(c.encode()))
        self.cost = np.array(self.cost, np.int32)
        self.char = {c: i for c, i in ids.items() if len(c) == 1 and c in joined}
        self.single = {c for c in pieces if len(c) == 1}
        self.width = len(ids)
        # runs of blanks have one score, the least, so they merge after all else, from the left
        runs = {p for p in pieces if len(p) > 1 and not p.strip(BLANK)}
        if any(order[pieces[p]] < max(order[s] for p, s in pieces.items() if len(p) > 1) for p in runs):
            raise ValueError("only models whose runs of blanks come last are supported")
        self.longest = max(map(len, runs), default=1)
        tokens = [_blank_tokens(n, set(map(len, runs))) for n in range(4 * self.longest)]
        if any(tokens[n] != n // self.longest + tokens[n % self.longest] for n in range(len(tokens))):
            raise ValueError("runs of blanks that don't fall into the longest ones are not supported")
        self.blank_rest = np.array(tokens[: self.longest], np.int64)
        self.blank = ids[BLANK]
        scores = [s for p, s in pieces.items() if len(p) > 1 and p not in runs]
        if len(set(scores)) < len(scores) or any(p.startswith(BLANK * 2) for p in pieces.keys() - runs):
            raise ValueError("pieces of equal scores and words behind several blanks are not supported")
        keys, ranks, made, inside = [], [], [], set()
        for p, score in pieces.items():
            if p in runs:
                continue
            inside.update(self.char[a] * self.width + self.char[b] for a, b in zip(p, p[1:], strict=False) if a in self.char and b in self.char)
            for k in range(1, len(p)):
                a, b = ids.get(p[:k]), ids.get(p[k:])
                if a is not None and b is not None:
                    keys.append(a * self.width + b)
                    ranks.append(order[score])
                    made.append(ids[p])
        by = np.argsort(np.array(keys, np.int64))
        self.keys = np.array(keys, np.int64)[by]
        self.ranks = np.array(ranks, np.int32)[by]
        self.made = np.array(made, np.int32)[by]
        #: Pairs of characters that stand in a piece; no merge reaches across any other.
        self.inside = np.array(sorted(inside), np.int64)
        inside = "".join(re.escape(c) for c in sorted(joined - {"▁"}))
        # a piece holds the blank only in front, so no merge crosses from another character to a blank
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("pieces with inner blanks are not supported")
        self.split = re.compile(f"▁*[{inside}]+|▁+|.", re.DOTALL).findall

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Places of pairs in the tables, -1 where they don't merge."""
        key = left.astype(np.int64) * self.width + right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, at, -1)

    def pretokens(self, text: str) -> list[str]:
        return self.split("▁" + text.replace(" ", "▁")) if text else []

    def count(self, words: list[str]) -> list[int]:
        """Token counts of distinct pre-tokens."""
        out = np.zeros(len(words), np.int64)
        many: list[int] = []
        for i, w in enumerate(words):
            if len(w) == 1:
                out[i] = 1 if w in self.single else len(w.encode())
            else:
                many.append(i)
        if many:
            out[many] = self._rounds([words[i] for i in many])
        return out.tolist()

    def _rounds(self, words: list[str]) -> np.ndarray:
        length = np.array([len(w) for w in words])
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        seen, back = np.unique(codes, return_inverse=True)
        sym = np.array([self.char[chr(c)] for c in seen], np.int32)[back]
        word = np.repeat(np.arange(len(words)), length)
        pair = sym[:-1].astype(np.int64) * self.width + sym[1:]
        place = np.minimum(np.searchsorted(self.inside, pair), len(self.inside) - 1)
        new = np.r_[True, (word[1:] != word[:-1]) | (self.inside[place] != pair)]
        seq = np.cumsum(new) - 1
        word = word[new]
        out, blanks = np.zeros((2, len(words)), np.int64)
        at = np.full(len(sym), -1, np.int64)
        same = seq[:-1] == seq[1:]
        at[:-1][same] = self.find(sym[:-1][same], sym[1:][same])
        rank = np.where(at >= 0, self.ranks[at], NONE)
        while len(sym):
            first = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            size = np.diff(np.r_[first, len(seq)])
            least = np.minimum.reduceat(rank, first)
            done = least == NONE
            if done.any():
                leaving = np.repeat(done, size)
                blank = sym[leaving] == self.blank
                np.add.at(blanks, word[seq[leaving]][blank], 1)
                np.add.at(out, word[seq[leaving]][~blank], self.cost[sym[leaving]][~blank])
                sym, seq, at, rank = sym[~leaving], seq[~leaving], at[~leaving], rank[~leaving]
                least, size = least[~done], size[~done]
                if not len(sym):
                    break
            hit = self._together(np.flatnonzero(rank == np.repeat(least, size)), sym, seq, at, rank)
            sym[hit] = self.made[at[hit]]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            place = np.cumsum(keep)[hit] - 1
            sym, seq, at, rank = sym[keep], seq[keep], at[keep], rank[keep]
            at[place], rank[place] = -1, NONE
            for left in (place, place - 1):
                left = left[(left >= 0) & (left + 1 < len(sym))]
                left = left[seq[left] == seq[left + 1]]
                found = self.find(sym[left], sym[left + 1])
                at[left], rank[left] = found, np.where(found >= 0, self.ranks[found], NONE)
        return out + blanks // self.longest + self.blank_rest[blanks % self.longest]

    def _together(self, hit: np.ndarray, sym: np.ndarray, seq: np.ndarray, at: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Of places of lowest-rank pairs those that merge in one round."""
        new = np.r_[True, (hit[1:] != hit[:-1] + 1) | (seq[hit[1:]] != seq[hit[:-1]])]
        start = np.flatnonzero(new)
        # of pairs that overlap every other one, from the left
        hit = hit[(np.arange(len(hit)) - start[np.cumsum(new) - 1]) % 2 == 0]
        owner = seq[hit]
        new = np.r_[True, owner[1:] != owner[:-1]]
        if new.all():
            return hit
        made = self.made[at[hit]]
        # the pairs that a merge makes: with what stands in front, merged already, and with what follows, not yet
        n, before, after = len(sym), sym[hit - 1].copy(), sym[np.minimum(hit + 2, len(sym) - 1)]
        touching = np.flatnonzero(~new & np.r_[False, hit[1:] == hit[:-1] + 2])
        before[touching] = made[touching - 1]
        bad = np.zeros(len(hit), bool)
        for ok, left, right in (((hit > 0) & (seq[hit - 1] == owner), before, made), ((hit + 2 < n) & (seq[np.minimum(hit + 2, n - 1)] == owner), made, after)):
            found = self.find(left, right)
            bad |= ok & (found >= 0) & (self.ranks[found] <= rank[hit])
        passed = np.cumsum(bad) - bad
        first = passed[np.flatnonzero(new)][np.cumsum(new) - 1]
        return hit[passed == first]


def _model(path: str) -> PieceMerges:
    held = worker_cache("token counts")
    if path not in held:
        held[path] = PieceMerges(path)
    return held[path]


def token_counts(docs: DataFrame, model_path: str | Callable[[], str], id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """One row per row of `docs`: the id, n_bytes, n_tokens, over_limit.

    A null text counts as empty: 0 bytes, 0 tokens. Null and repeated ids keep their own rows, and equal
    texts have equal counts. A text of any length is counted as a whole. An empty table gives an empty result.
    Other columns are not read, so clashing names don't matter. `model_path` is a path that every
    executor has, or a function that names it there.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(model_path() if callable(model_path) else model_path)
        known: dict[str, int] = {}
        for batch in (s for b in batches for s in sub_batches(b, 1)):
            texts = strings(batch.column(1))
            words = [model.pretokens(t) for t in texts]
            new = list(set().union(*words) - known.keys())
            if len(known) + len(new) > REMEMBERED:
                known.clear()
                new = list(set().union(*words))
            known.update(zip(new, model.count(new), strict=True))
            n = [sum(map(known.__getitem__, w)) for w in words]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=[id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {id_type}, n_bytes long, n_tokens long, over_limit boolean")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read_documents(spark, sf_dir), tokenizer_path)
