"""BPE encoding and decoding by a prefix-sharing trie.

Distinct words stand in a trie. Each node keeps one number, the last token of the encoding of its
prefix, found from the states of its ancestors: token t ends the encoding of prefix p exactly if
p without t ends in a token that stays apart from t under the merge order. Words with a common
prefix share those states, and an encoding is read off by walking back token by token.
The tokens that may end a prefix come from its longest ending that begins some token: all others are shorter.
"""

from __future__ import annotations

import hashlib
import json
import struct
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import read_documents, strings, sub_batches, worker_cache

#: Trie nodes, remembered words, tested pairs and endings after which a worker starts afresh; symbols of the prefixes kept with their nodes.
NODES, WORDS, PAIRS, ENDINGS, FRONT = 100_000, 60_000, 150_000, 60_000, 4
#: Symbols of a word above which all its prefixes get their states in order.
DEEP = 100
#: What stands for the end of a word among its symbols.
STOP = "\0"
#: Bytes of text that stand in memory as words, ten times their size, at a time.
PIECES = 1 << 18


def _byte_chars() -> list[str]:
    """The printable stand-in of each byte: itself where printable, else 256 and up in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


class WordBpe:
    """Vocabulary of a byte-level BPE with word ends: NFC, lower case, white space dropped."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        vocab: dict[str, int] = model["vocab"]
        self.surface = {i: t for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.surface |= {i: t for t, i in self.special.items()}
        self.alphabet = _byte_chars()
        self.tokens = {t[: -len(self.end)] + STOP if t.endswith(self.end) else t: i for t, i in vocab.items()}
        self.begins = {t[:k] for t in self.tokens for k in range(1, len(t) + 1)}
        #: By pair (left << 20 | right) the merge's rank; by token its own merge's rank (-1: a byte) and its two parts.
        self.rank: dict[int, int] = {}
        self.level, self.left, self.right = ([-1] * (max(self.surface) + 1) for _ in range(3))
        for r, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            x, y, made = vocab[a], vocab[b], vocab[a + b]
            self.rank[x << 20 | y] = r
            self.level[made], self.left[made], self.right[made] = r, x, y
        #: All special strings first, then the words; other characters are white space.
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.words = regex.compile(PATTERN).findall
        self.apart_known: dict[int, bool] = {}
        #: Of the words remembered their ids and the text decoded from them.
        self.known: dict[str, tuple[bytes, str]] = {}
        self.older: dict[str, tuple[bytes, str]] = {}
        self.size = {i: len(t.removesuffix(self.end)) for t, i in vocab.items()}
        #: By such an ending and what comes behind it, a symbol or the last one and STOP, the next ending, with the tokens that end it: sizes and ids, longest first.
        self.follows: dict[str, tuple[str, list[tuple[int, int]]]] = {}
        self.endings: dict[str, tuple[str, list[tuple[int, int]]]] = {}
        self.clear()

    def clear(self) -> None:
        #: Child by node << 21 | character; the state (-1: not asked for yet) and the ending of each node.
        self.next: dict[int, int] = {}
        self.state: list[int] = [-1]
        self.ending: list[tuple[str, list[tuple[int, int]]]] = [("", [])]
        #: The nodes up to that of a prefix of FRONT symbols.
        self.front: dict[str, list[int]] = {}

    def _apart(self, a: int, b: int) -> bool:
        """Whether tokens a and b, side by side, are what the merges make of their joined symbols."""
        # Undo the later of the two tokens' own merges again and again: the tokens meet only by
        # their inner edges. A merge across, if earlier than what it would have to forestall, joins them.
        rank, level, bar = self.rank, self.level, len(self.rank)
        while True:
            across = rank.get(a << 20 | b)
            if across is not None and across < bar:
                return False
            la, lb = level[a], level[b]
            if la > lb:
                a, bar = self.right[a], la
            elif lb < 0:
                return True
            else:  # a merge across of the same rank stands further left, so it comes first
                b, bar = self.left[b], lb + 1

    def _follow(self, joined: str) -> tuple[str, list[tuple[int, int]]]:
        """The longest ending of an ending with more behind it that begins some token, and the tokens that end it."""
        if len(self.follows) > ENDINGS:
            self.follows.clear()
            self.endings.clear()
        end = next((joined[k:] for k in range(len(joined)) if joined[k:] in self.begins), "")
        found = self.endings.get(end)
        if found is None:
            ids = (self.tokens.get(end[k:]) for k in range(len(end)))
            found = self.endings[end] = end, [(self.size[t], t) for t in ids if t is not None and self.size[t]]
        self.follows[joined] = found
        return found

    def _choose(self, path: list[int], ends: list[tuple[int, int]], d: int) -> int:
        """The last token of the encoding of a prefix of d symbols, one of `ends`; path: the nodes from the root on."""
        known, state, ending = self.apart_known, self.state, self.ending
        for size, t in ends:
            if size == d:
                return t
            node = path[d - size]
            before = state[node]
            if before < 0:  # states are found when a longer prefix asks for them
                before = state[node] = self._choose(path, ending[node][1], d - size)
            key = before << 20 | t
            apart = known.get(key)
            if apart is None:
                if len(known) > PAIRS:
                    known.clear()
                apart = known[key] = self._apart(before, t)
            if apart:
                return t
        raise ValueError("the vocabulary lacks a byte")

    def encode_word(self, word: str) -> list[int]:
        """Ids of one word, given in stand-in characters."""
        follow, state, ending, follows, size = self.next, self.state, self.ending, self.follows, self.size
        path = self.front.get(word[:FRONT]) if len(word) > FRONT else None
        path = path.copy() if path else [0]
        node = path[-1]
        for c in word[len(path) - 1 : -1]:
            key = node << 21 | ord(c)
            child = follow.get(key)
            if child is None:
                joined = ending[node][0] + c
                child = follow[key] = len(state)
                state.append(-1)
                ending.append(follows.get(joined) or self._follow(joined))
            node = child
            path.append(node)
            if len(path) == FRONT + 1:
                self.front[word[:FRONT]] = path.copy()
        if len(word) > DEEP:  # from the front on, so that no state waits for many others
            for d in range(1, len(word)):
                if state[path[d]] < 0:
                    state[path[d]] = self._choose(path, ending[path[d]][1], d)
        joined = ending[node][0] + word[-1] + STOP
        t = self._choose(path, (follows.get(joined) or self._follow(joined))[1], len(word))
        at = len(word) - size[t]
        out = [t]
        while at:
            t = state[path[at]]
            out.append(t)
            at -= size[t]
        return out[::-1]

    def learn(self, words: set[str]) -> tuple[dict[str, bytes], dict[str, str]]:
        """The ids of distinct words and the text decoded from them; what isn't known yet is encoded in sorted order, depth first through the trie."""
        if len(self.known) > WORDS:  # what is still in use moves on from the older half
            self.older, self.known = self.known, {}
        known, older, surface = self.known, self.older, self.surface.__getitem__
        # only what a word splits into is remembered
        single, parts = set(), {}
        for w in words:
            if w.isascii() and w.isalpha():
                single.add(w)
            else:
                # most are letters with one other character behind
                parts[w] = own = [w[:-1], w[-1]] if w.isascii() and w[:-1].isalpha() else self.words(w)
                single.update(own)
        coded, shown, new = {}, {}, []
        for w in single:
            both = known.get(w)
            if both is None:
                both = older.get(w)
                if both is None:
                    new.append(w)
                    continue
                known[w] = both
            coded[w], shown[w] = both
        new.sort()
        for w in new:
            if len(self.state) > NODES:
                self.clear()
            ids = self.encode_word(w if w.isascii() and w.isprintable() else "".join(map(self.alphabet.__getitem__, w.encode())))
            known[w] = coded[w], shown[w] = struct.pack(f"<{len(ids)}I", *ids), " ".join(map(surface, ids))
        for w, own in parts.items():
            if w not in coded:
                coded[w], shown[w] = b"".join(map(coded.__getitem__, own)), " ".join(map(shown.__getitem__, own))
        return coded, shown

    def pieces(self, text: str) -> list[str]:
        """Runs between white space, lowered, and special strings, in order."""
        if "<|" in text:
            out = []
            for k, part in enumerate(self.cut.split(text)):
                out += [part] if k % 2 else self._plain(part)
            return out
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if not text.isascii():
            # characters are lowered one by one: no final form of sigma
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return SPLIT(text.lower()) if CONTROL(text) else text.lower().split()

    def coder(self, texts: list[list[str]]) -> tuple[Callable[[str], bytes], Callable[[str], str]]:
        """The ids of each piece of the texts, and what they decode to."""
        ids, shown = self.learn(set().union(*texts) - self.special.keys())
        ids |= {s: struct.pack("<I", i) for s, i in self.special.items()}
        shown |= {s: s for s in self.special}
        return ids.__getitem__, shown.__getitem__

    def encode(self, text: str) -> list[int]:
        pieces = self.pieces(text)
        ids = b"".join(map(self.coder([pieces])[0], pieces))
        return list(struct.unpack(f"<{len(ids) // 4}I", ids))

    def decode(self, ids: list[int]) -> str:
        """Token strings joined by single blanks: the vocabulary file names no decoder."""
        return " ".join(self.surface[i] for i in ids)


# fixed values: the split pattern of the vocabulary file, white space as its library sees it
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\p{L}\p{N}]+"

#: Characters that Python takes for white space and the library doesn't; the split for texts with them.
CONTROL = regex.compile("[\x1c-\x1f]").search
SPLIT = regex.compile(r"[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+").findall

def _model(path: str | Callable[[], str]) -> WordBpe:
    path, held = path() if callable(path) else path, worker_cache("bpe")
    if path not in held:
        held[path] = WordBpe(path)
    return held[path]


def _map(docs: DataFrame, id_col: str, text_col: str, names: list[str], types: list, make: Callable, path) -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()
    ddl = {pa.int64(): "long", pa.string(): "string", pa.list_(pa.int32()): "array<int>"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(path)
        for batch in (s for b in batches for s in sub_batches(b, 1, PIECES)):
            texts = [model.pieces(t) for t in strings(batch.column(1))]
            code, show = model.coder(texts)
            rows = [make(b"".join(map(code, t)), map(show, t)) for t in texts]
            cols = zip(*rows, strict=True) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=[id_col, *names])

    return docs.select(id_col, text_col).mapInArrow(run, ", ".join([f"`{id_col}` {kind}", *(f"{n} {ddl[t]}" for n, t in zip(names, types, strict=True))]))


def bpe_encode(docs: DataFrame, path: str | Callable[[], str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: the id and ids (array<int>), with a null text as the empty one: no ids.

    Repeated ids keep their rows; other columns are not read.
    """

    def make(ids, text):
        return (list(struct.unpack(f"<{len(ids) // 4}I", ids)),)

    return _map(docs, id_col, text_col, ["ids"], [pa.list_(pa.int32())], make, path)


def bpe_decode(encoded: DataFrame, path: str | Callable[[], str], id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per row: the id and decoded (string); null ids give null, no ids the empty text."""
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array((None if x is None else model.decode(x) for x in batch.column(1).to_pylist()), pa.string())], names=[id_col, "decoded"])

    return encoded.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, decoded string")


def bpe_digest(docs: DataFrame, path: str | Callable[[], str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode in one pass: the id, n_tokens, ids_sha256, decoded_sha256 of each row.

    A null text is the empty one: no ids, an empty text. Texts are encoded whole whatever their length, equal ones alike.
    Null and repeated ids keep their rows; an empty table gives an empty result. Other columns are not read.
    """

    def make(ids, text):
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(" ".join(text).encode()).hexdigest()

    return _map(docs, id_col, text_col, ["n_tokens", "ids_sha256", "decoded_sha256"], [pa.int64(), pa.string(), pa.string()], make, path)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digest(read_documents(spark, sf_dir), tokenizer_path)
