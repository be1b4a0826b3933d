"""Text operators against brute force, on small tables with nulls, empty texts, repeats and odd columns."""

import hashlib
import math
import random
import re
import struct
import time
import zlib
from collections import Counter

import numpy as np
import pytest

from gridloom.llm import common, op1_mixing, op2_token_counts, op3_media_columns, op4_bpe_codec, op5_imatch, op6_minhash_dedup, op7_quality_lm, op8_language_id, op9_suffix_dedup, op10_toxicity
from gridloom.llm.suffix_array import permuted_common_prefixes, suffix_array

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, start string"


def corpus() -> list[tuple]:
    rng = random.Random(3)
    words = ["".join(rng.choice("abdegilnorstu") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = [text(rng.randint(8, 120)) for _ in range(24)]
    shared = text(30)
    texts = base + base[:4] + [b + " tail" for b in base[4:8]] + [text(20) + " " + shared + " " + text(20) for _ in range(4)]
    texts += [None, "", "   ", "one", "One  ONE", "é😀 ß x", text(3000), "\n\t", "ab " * 400]
    return [(i * 3 + 1, t, ["en", "de", None][i % 3], [None, "b", "a", "é"][i % 4], 0, 7, "x") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_mixing(docs, nothing):
    rows = {r["doc_id"]: r for r in op1_mixing.mix(docs).collect()}
    by = {}
    for i, t, _, source, *_ in corpus():
        assert rows[i]["size"] == len(words(t)) and 0 <= rows[i]["taken"] <= 2 * rows[i]["size"]
        by.setdefault(source, []).append(rows[i])
    total = sum(r["size"] for r in rows.values())
    sources = sorted((s for s in by if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sources)}
    cap = {s: 2 * sum(r["size"] for r in by[s]) for s in sources}
    target, free = {}, set(sources)
    while True:
        left = 1.5 * total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > cap[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = cap[s]
            free.discard(s)
    for s in sources:
        assert all(abs(r["target"] - target[s]) < 1e-6 and r["source_size"] * 2 == cap[s] for r in by[s])
        assert abs(sum(r["taken"] for r in by[s]) - target[s]) <= 3 * op1_mixing.BLOCK
    again = {r["doc_id"]: r["taken"] for r in op1_mixing.mix(docs.repartition(7)).collect()}
    assert again == {i: r["taken"] for i, r in rows.items()}
    assert op1_mixing.mix(nothing).count() == 0


def test_sainte_lague(spark):
    claims = [(0, k, float(c), 99, 17) for k, c in enumerate([40, 13, 7, 0, 5.5, 5.5])]
    got = {r["p"]: r["quota"] for r in op1_mixing.apportion(spark.createDataFrame(claims, "g int, p int, claim double, cap long, seats long"), ["g"], "p").collect()}
    want = [0] * 6
    for _ in range(17):
        want[max(range(6), key=lambda k: (claims[k][2] / (2 * want[k] + 1), -k))] += 1
    assert [got[k] for k in range(6)] == want


def test_token_counts(docs, nothing):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=op2_token_counts.tokenizer_path())
    rows = {r["doc_id"]: r for r in op2_token_counts.token_counts(docs, op2_token_counts.tokenizer_path, limit=50).collect()}
    for i, t, *_ in corpus():
        n = len(lib.encode(t or ""))
        assert (rows[i]["n_tokens"], rows[i]["n_bytes"], rows[i]["over_limit"]) == (n, len((t or "").encode()), n > 50)
    assert op2_token_counts.token_counts(nothing, op2_token_counts.tokenizer_path).count() == 0


@pytest.mark.parametrize("text", ["  a   b ", " " * 40 + "x\n\n\t y", "東京 タワー́ é €5 🎉 123456 <s> </s>", "ab" * 3000, "▁x▁▁y", "\x00", "   " * 7, "-" * 3000, " " * 15 + "x" + " " * 5001, "unbrokenlettersofanykind" * 90, "aB3/" * 700])
def test_token_counts_of_odd_texts(text):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=op2_token_counts.tokenizer_path())
    model = op2_token_counts.PieceMerges(op2_token_counts.tokenizer_path())
    assert sum(model.count(model.pretokens(text))) == len(lib.encode(text))


def test_media(docs, nothing):
    stored = op3_media_columns.encode_media(docs)
    rows = {r["doc_id"]: r for r in op3_media_columns.media_features(stored).collect()}
    for i, t, *_ in corpus():
        data = (t or "").encode()
        payload = op3_media_columns.pad(data)
        assert len(payload) % 576 == 0 and len(payload) > 0
        r = rows[i]
        assert (r["n_bytes"], r["payload_bytes"], r["tail_crc32"]) == (len(data), len(payload), zlib.crc32(payload[-32:]))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and len(r["feature"]) == 16
    assert op3_media_columns.media_features(op3_media_columns.encode_media(nothing)).count() == 0


def test_media_feature():
    """The hash against means and cosine sums taken one by one, and filtered rows in what the query stores."""
    rng = random.Random(5)
    for t in ("", "short", " ".join(rng.choice(["re", "lina", "os"]) for _ in range(900)), "x" * 5000):
        payload = op3_media_columns.pad(t.encode())
        png = op3_media_columns.to_png(payload)
        pixels = [list(payload[k : k + 24]) for k in range(0, len(payload), 24)]
        assert op3_media_columns.from_png(png).tolist() == pixels
        h = len(pixels)
        small = [[0.0] * 24 for _ in range(24)]
        for y in range(24):
            part = pixels[y * h // 24 : (y + 1) * h // 24]
            for x in range(24):
                small[y][x] = sum(r[x] for r in part) / len(part)
        low = []
        for u in range(8):
            for v in range(8):
                low.append(round(sum(small[y][x] * math.cos(math.pi / 24 * (y + 0.5) * u) * math.cos(math.pi / 24 * (x + 0.5) * v) for y in range(24) for x in range(24)), 6))
        middle = sorted(low[1:])[31]
        bits = "".join(str(int(x > middle)) for x in low)
        assert op3_media_columns.cosine_hash(op3_media_columns.from_png(png)) == f"{int(bits, 2):016x}"
    raw = zlib.decompress(op3_media_columns.to_png(op3_media_columns.pad(bytes(range(97, 123)) * 100))[41:-16])
    assert len(set(raw[::25])) > 1


def test_png_of_all_filters():
    """Every filter after every other, also in the first row."""
    rng = np.random.default_rng(8)
    for order in (range(5), (4, 4, 3, 2, 2, 0, 2, 1, 2, 3), (2, 2, 1), (3,)):
        pixels = rng.integers(0, 256, (30, 24)).astype(np.uint8)
        raw, kinds = np.zeros((30, 24), np.uint8), np.array([order[k % len(order)] for k in range(30)])
        for i in range(30):
            for j in range(24):
                left, up = int(pixels[i, j - 1]) if j else 0, int(pixels[i - 1, j]) if i else 0
                corner = int(pixels[i - 1, j - 1]) if i and j else 0
                p = left + up - corner
                guess = (0, left, up, (left + up) // 2, min((left, up, corner), key=lambda v, p=p: abs(p - v)))[kinds[i]]
                raw[i, j] = (int(pixels[i, j]) - guess) % 256
        assert (op3_media_columns._unfilter(kinds, raw) == pixels).all()


def test_png_filters_and_damage():
    rng = np.random.default_rng(1)
    pixels = rng.integers(0, 256, (12, 9)).astype(np.uint8)
    raw = b""
    for i, row in enumerate(pixels.astype(int)):
        kind = i % 5
        up = pixels[i - 1].astype(int) if i else np.zeros(9, int)
        left, corner = np.r_[0, row[:-1]], np.r_[0, up[:-1]]
        p = left + up - corner
        paeth = np.array([min((a, b, c), key=lambda v, q=q: abs(q - v)) for a, b, c, q in zip(left, up, corner, p, strict=True)])
        guess = [0 * row, left, up, (left + up) // 2, paeth][kind]
        raw += bytes([kind]) + ((row - guess) % 256).astype(np.uint8).tobytes()
    m = op3_media_columns
    png = m.SIGNATURE + m._chunk(b"IHDR", struct.pack(">IIBBBBB", 9, 12, 8, 0, 0, 0, 0)) + m._chunk(b"IDAT", zlib.compress(raw)) + m._chunk(b"IEND", b"")
    assert (m.from_png(png) == pixels).all()
    for at in (0, 20, 45, len(png) - 3):
        with pytest.raises(ValueError):
            m.from_png(png[:at] + bytes([png[at] ^ 1]) + png[at + 1 :])
    with pytest.raises(ValueError):
        m.from_png(png[:-12])


ODD = ["", "x<|endoftext|>Y <|startoftext|>", "東京 タワー́ é 🎉 123 <s>", "a" * 777, "ΑΣ ΣΑΣ İstanbul", "\x00 \x1c\x85x", "It's we'll I'D 'S", "---!!!...", "²½ⅷ", "ȩ́ ẛ̣", "ﬁ Å"]


def test_bpe(docs, nothing):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(op4_bpe_codec.tokenizer_path())
    digests = {r["doc_id"]: r for r in op4_bpe_codec.bpe_digest(docs, op4_bpe_codec.tokenizer_path).collect()}
    encoded = op4_bpe_codec.bpe_encode(docs, op4_bpe_codec.tokenizer_path)
    ids = {r["doc_id"]: r["ids"] for r in encoded.collect()}
    decoded = {r["doc_id"]: r["decoded"] for r in op4_bpe_codec.bpe_decode(encoded, op4_bpe_codec.tokenizer_path).collect()}
    for i, t, *_ in corpus():
        want = lib.encode(t or "", add_special_tokens=False).ids
        back = lib.decode(want, skip_special_tokens=False)
        assert ids[i] == want and decoded[i] == back
        assert digests[i]["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(want)}I", *want)).hexdigest()
        assert digests[i]["decoded_sha256"] == hashlib.sha256(back.encode()).hexdigest()
    model = op4_bpe_codec.WordBpe(op4_bpe_codec.tokenizer_path())
    for t in ODD:
        assert model.encode(t) == lib.encode(t, add_special_tokens=False).ids
    assert op4_bpe_codec.bpe_digest(nothing, op4_bpe_codec.tokenizer_path).count() == 0


def test_bpe_words_once(monkeypatch):
    import random

    from tokenizers import Tokenizer

    lib, model = Tokenizer.from_file(op4_bpe_codec.tokenizer_path()), op4_bpe_codec.WordBpe(op4_bpe_codec.tokenizer_path())
    done, encode = [], model.encode_word
    monkeypatch.setattr(model, "encode_word", lambda w: done.append(w) or encode(w))
    for t in ("gridloom", "gridloom, gridloom.", "(gridloom) gridloom's"):
        assert model.encode(t) == lib.encode(t, add_special_tokens=False).ids
    # a word inside others is encoded once, whatever stands about it
    assert done.count("gridloom") == 1 and "," in done
    # what is forgotten in between changes nothing
    monkeypatch.setattr(op4_bpe_codec, "NODES", 50)
    monkeypatch.setattr(op4_bpe_codec, "WORDS", 20)
    monkeypatch.setattr(op4_bpe_codec, "ENDINGS", 30)
    monkeypatch.setattr(op4_bpe_codec, "DEEP", 25)
    rng = random.Random(4)
    for _ in range(200):
        t = " ".join("".join(rng.choices(rng.choice(["etaoinshr", "theing,.'s", "aé日1ßñ🙂", "ab"]), k=rng.randint(1, 40))) for _ in range(8))
        assert model.encode(t) == lib.encode(t, add_special_tokens=False).ids, t
    t = "".join(rng.choices("abeint", k=20_000))
    assert model.encode(t) == lib.encode(t, add_special_tokens=False).ids


def test_fingerprints(docs, nothing):
    rows = {r["doc_id"]: r for r in op5_imatch.fingerprints(docs).collect()}
    table = sorted((i, t or "") for i, t, *_ in corpus())
    prints = {}
    for k, (i, t) in enumerate(table):
        nxt, q = table[(k + 1) % len(table)][1], len(t) // 4
        assert rows[i]["n_chars"] == len(t)
        assert rows[i]["edited_sha256"] == hashlib.sha256((t[: len(t) - q] + nxt[:q]).encode()).hexdigest()
        assert prints.setdefault(t, rows[i]["fingerprint"]) == rows[i]["fingerprint"]
        assert 0 <= rows[i]["near_next"] <= 1 and 0 <= rows[i]["near_edited"] <= 1
    long = [rows[i] for i, t in table if len(t) > 200 and len(set(words(t))) > 20]
    assert np.mean([r["near_edited"] for r in long]) > np.mean([r["near_next"] for r in long]) + 0.2
    assert op5_imatch.fingerprints(nothing).count() == 0


def test_likeness_of_distant_levels(spark):
    """A text and the same with many other terms: levels far apart, alike where the coarser rate reads the terms of both."""
    few, many = [f"a{k}" for k in range(60)], [f"b{k}" for k in range(340)]
    # 400 terms are read at level 3; a few of the 60 are among those
    rows = [(0, " ".join(few), " ".join(few + many)), (1, " ".join(few), " ".join(f"c{k}" for k in range(400)))]
    df = spark.createDataFrame(rows, "id int, s string, t string")
    df = op5_imatch.with_fingerprint(op5_imatch.with_fingerprint(df, "s", "x", []), "t", "y", [])
    got = {r["id"]: r for r in df.select("id", df["x.level"].alias("p"), df["y.level"].alias("q"), op5_imatch.likeness(df["x"], df["y"]).alias("xy"), op5_imatch.likeness(df["y"], df["x"]).alias("yx"), df["x.terms"].alias("xt"), df["y.terms"].alias("yt")).collect()}
    for r in got.values():
        assert (r["p"], r["q"]) == (0, 3) and r["xy"] == r["yx"]
        sets = [{}, {}]
        for s, terms in zip(sets, (r["xt"], r["yt"]), strict=True):
            for h in terms:
                if h % 8 == 0:
                    s.setdefault((h % (1 << 64) >> 3) % 32, set()).add(h)
        keys = set(sets[0]) | set(sets[1])
        assert r["xy"] == pytest.approx(sum(sets[0].get(k) == sets[1].get(k) for k in keys) / len(keys))
    assert got[0]["xy"] > 0 == got[1]["xy"]


def brute_components(rows):
    sets = {}
    for i, t, *_ in rows:
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    comp = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 75 * len(sets[a] | sets[b]) and comp[a] > comp[b]:
                    comp[a], changed = comp[b], True
    return sets, comp


def test_near_duplicates(docs, nothing):
    sets, comp = brute_components(corpus())
    for r in op6_minhash_dedup.near_duplicates(docs).collect():
        i = r["doc_id"]
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[i]), comp[i], comp[i] == i)
    assert op6_minhash_dedup.near_duplicates(nothing).count() == 0


def test_near_duplicates_of_a_chain(spark):
    """Links reach over texts that aren't alike themselves; no bucket's leader hides a link."""
    rng = random.Random(5)
    w = [f"w{k}" for k in range(400)]
    rows = []
    for g in range(6):
        t = [rng.choice(w) for _ in range(60)]
        for k in range(12):
            rows.append((g * 100 + k, " ".join(t)))
            t = t[:]
            t[(7 * k) % 60] = f"n{g}-{k}"
    sets, comp = brute_components(rows)
    got = {r["doc_id"]: r["component_id"] for r in op6_minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == comp


def test_near_duplicates_of_a_mixed_bucket(spark, monkeypatch):
    """Copies of one text whose likeness among each other lies on both sides of the limit; small blocks, so that many meet."""
    rng = random.Random(12)
    w = [f"w{k}" for k in range(900)]
    base = [rng.choice(w) for _ in range(120)]
    rows = [(1000, " ".join(base))]
    for k in range(90):
        t = base[:]
        for _ in range(rng.randint(1, 7)):
            t[rng.randrange(120)] = f"n{rng.randrange(40)}"
        rows.append((k, " ".join(t)))
    sets, comp = brute_components(rows)
    for docs, columns in ((512, 2048), (7, 16)):
        monkeypatch.setattr(op6_minhash_dedup, "BLOCK_DOCS", docs)
        monkeypatch.setattr(op6_minhash_dedup, "COLUMNS", columns)
        got = {r["doc_id"]: r["component_id"] for r in op6_minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert got == comp
    # without leaders every link comes from the blocks
    ids, texts = [i for i, _ in rows], spark.createDataFrame(rows, "id long, text string")
    member = spark.createDataFrame([(key, i, len(sets[i]), i) for key in (5, 6) for i in ids], "key long, id long, n long, c long")
    links = {(r["u"], r["v"]) for r in op6_minhash_dedup.across(member, texts).collect()}
    label = {i: i for i in ids}
    for u, v in links:
        assert 100 * len(sets[u] & sets[v]) >= 75 * len(sets[u] | sets[v])
        a, b = label[u], label[v]
        label = {i: min(a, b) if x in (a, b) else x for i, x in label.items()}
    assert label == comp


def test_near_duplicates_of_odd_rows(spark):
    """Null and repeated ids, ids that are strings, columns with clashing names, a very long text twice."""
    long = " ".join(f"w{k % 977}x{k % 31}" for k in range(60_000))
    rows = [("b", long, 1), ("a", long + " end", 2), (None, long, 3), ("c", "x y", 4), ("c", "x y", 5), ("d", None, 6)]
    got = sorted(op6_minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id string, text string, key int")).collect(), key=str)
    by = {r["doc_id"]: (r["component_id"], r["kept"]) for r in got}
    assert by == {"a": ("a", True), "b": ("a", False), None: (None, True), "c": ("c", True), "d": ("d", True)} and len(got) == 6


def test_circulant_minhash_estimates_similarity():
    rng = np.random.default_rng(2)
    for j in (0.5, 0.75, 0.9):
        n = 1000
        both = int(2 * n * j / (1 + j))
        pool = rng.integers(0, 1 << 62, 2 * n).astype(np.uint64)
        a, b = pool[:n], np.r_[pool[:both], pool[n : 2 * n - both]]
        sig = op6_minhash_dedup.circulant_minhash(np.r_[a, b], np.array([0, n, 2 * n]), 512)
        assert abs((sig[0] == sig[1]).mean() - j) < 0.08


def test_quality(docs, spark, nothing):
    trusted = spark.createDataFrame([(i,) for i, *_ in corpus()[:20]], "doc_id long")
    rows = {r["doc_id"]: r for r in op7_quality_lm.quality(docs, trusted).collect()}
    assert len(rows) == len(corpus())
    p = np.array([rows[i]["perplexity"] for i, t, *_ in corpus()[:20]])
    assert rows[next(i for i, t, *_ in corpus() if t and t.startswith("é😀"))]["perplexity"] > p.max()
    assert all(rows[i]["kept"] for i, t, *_ in corpus() if not t)
    assert op7_quality_lm.quality(nothing, trusted).count() == 0
    # no trusted text: the even distribution over bytes
    bare = op7_quality_lm.quality(docs, trusted.limit(0)).where("n_bytes > 0").collect()
    assert all(abs(r["perplexity"] - 256) < 0.01 and r["kept"] for r in bare)


def test_quality_of_words(docs, spark):
    """Every row against a brute-force model of word trigrams that leaves the document itself out."""
    m, rows = op7_quality_lm, [(i, (t or "").encode()) for i, t, *_ in corpus()]
    known = dict(rows[:20])
    split = lambda t: re.findall(rb"[^\x20\x09-\x0d]*[\x20\x09-\x0d]", t + b"\n")
    before = lambda t: [None, None, *split(t)]
    grams = {i: [tuple(before(t)[k : k + 3]) for k in range(len(split(t)))] for i, t in rows if t}

    def tables(ids):
        three = Counter(g for i in ids for g in grams.get(i, []))
        two = Counter(g[1:] for g in three)
        return [Counter(g[1:] for g in two), two, three]

    def cuts(table):
        n = [sum(a == i for a in table.values()) for i in range(5)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0
        return [0, *(min(max(i - (i + 1) * y * n[i + 1] / n[i] if n[i] else 0.5, 0.1), i - 0.05) for i in (1, 2, 3))]

    d = [cuts(t) for t in tables(known)]
    key, n = np.unique(m.grams([t + b"\n" for t in known.values() if t])[0], return_counts=True)
    counts = spark.createDataFrame([(int(k), int(c)) for k, c in zip(key, n, strict=True)], "k long, a long")
    asked = np.unique(m.grams([t + b"\n" for _, t in rows if t])[0])
    spell = {r["k"]: r["p"] for r in m.probabilities(counts, spark.createDataFrame([(int(k),) for k in asked], "k long")).collect()}
    got = {r["doc_id"]: r["perplexity"] for r in m.quality(docs, spark.createDataFrame([(i,) for i in known], "doc_id long")).collect()}
    for i, t in rows:
        if not t:
            assert got[i] == 1
            continue
        model, total, at = tables([x for x in known if x != i]), 0.0, 0
        sums = [{}, {}, {}]
        for k, table in enumerate(model):
            for g, a in table.items():
                s = sums[k].setdefault(g[:-1], [0, 0.0])
                s[0], s[1] = s[0] + a, s[1] + d[k][min(a, 3)]
        b = [spell[int(k)] for k in m.grams([t + b"\n"])[0]]
        for g, w in zip(grams[i], split(t), strict=True):
            p = math.prod(b[at : at + len(w)])
            at += len(w)
            for k in range(3):
                h = g[2 - k :]
                if h[:-1] in sums[k]:
                    a, (s, spare) = model[k][h], sums[k][h[:-1]]
                    p = (a - d[k][min(a, 3)] + spare * p) / s
            total += math.log(p)
        assert got[i] == pytest.approx(math.exp(-total / (len(t) + 1)), rel=1e-5)


def test_quality_in_passes(docs, spark, monkeypatch):
    """Passes change no result, and each deals out a part of the questions and counts."""
    m, trusted = op7_quality_lm, spark.createDataFrame([(i,) for i, *_ in corpus()[:20]], "doc_id long")
    rows = lambda: {r["doc_id"]: r["perplexity"] for r in m.quality(docs, trusted).collect()}
    whole = rows()
    monkeypatch.setattr(m, "PASS_BYTES", 1 << 13)
    split = rows()
    assert split.keys() == whole.keys() and all(split[i] == pytest.approx(whole[i], rel=1e-9) for i in whole)
    marked = docs.selectExpr("doc_id AS id", "text", "lang", "doc_id <= 58 AS own")
    sent = lambda turn, passes: m.asked_and_counted(marked, turn, m.Deal(passes, 8)).selectExpr("sum(length(data))").first()[0]
    assert max(sent(k, 4) for k in range(4)) < 0.6 * sent(0, 1)


def test_kneser_ney_sums_to_one(spark):
    texts = [b"abracadabra", b"abcabc", b"banana"]
    key, n = np.unique(op7_quality_lm.grams(texts)[0], return_counts=True)
    counts = spark.createDataFrame([(int(k), int(c)) for k, c in zip(key, n, strict=True)], "k long, a long")
    for history in (b"abr", b"zzz", b"\n\n\n"):
        front = int.from_bytes(history, "big") << 8
        asked = spark.createDataFrame([(front + b,) for b in range(256)], "k long")
        assert abs(sum(r["p"] for r in op7_quality_lm.probabilities(counts, asked).collect()) - 1) < 1e-9


def test_language():
    rng = random.Random(9)
    make = lambda syl, n: " ".join("".join(rng.choice(syl) for _ in range(3)) for _ in range(n))
    kinds = {"aa": ["the", "ing", "ou"], "bb": ["sch", "ein", "ü"]}
    model = op8_language_id.LanguageModel({k: [make(s, 60) for _ in range(5)] for k, s in kinds.items()})
    for k, s in kinds.items():
        assert all(x[0] == k and 0 < x[1] <= 1 for x in model.predict([make(s, n) for n in (5, 40, 900)]))
    assert model.predict(["", " 12 !"]) == [("und", 0.0)] * 2
    assert op8_language_id.LanguageModel({}).predict(["abc"]) == [("und", 0.0)]


def test_cross_parsing_counts_longest_matches():
    """Phrases of several texts over many blocks against a plain parse; also of texts that the automaton knows in whole."""
    rng = np.random.default_rng(4)
    text = rng.integers(1, 5, 80)
    known = {tuple(text[i:j]) for i in range(80) for j in range(i + 1, 81)}
    others = [rng.integers(1, 6, n).astype(np.uint8) for n in (60, 0, 1, 300)] + [text[10:70].astype(np.uint8), np.tile(text[5:45], 4).astype(np.uint8), np.full(90, 5, np.uint8)]
    want = []
    for other in others:
        n = at = 0
        while at < len(other):
            size = 0
            while at + size < len(other) and tuple(other[at : at + size + 1]) in known:
                size += 1
            at += max(1, size)
            n += 1
        want.append(n)
    for cells in (op8_language_id.suffix_automaton(text, 6), op8_language_id.Sparse([{int(c): int(s) for c, s in enumerate(row) if s} for row in op8_language_id.suffix_automaton(text, 6)], 6)):
        for block in (1, 3, 7, 64, 512):
            assert op8_language_id.phrases(cells, np.concatenate(others), np.cumsum([len(x) for x in others]), block).tolist() == want


def test_languages_of_many_letters(monkeypatch):
    """Two scripts of 400 letters each and Latin; the same from dense and from sparse automata."""
    rng = random.Random(6)
    kinds = {"en": "abcdefghijklmnopqrstuvwxyz", "ko": [chr(0xAC00 + k) for k in range(400)], "zh": [chr(0x4E00 + k) for k in range(400)]}
    make = lambda s: " ".join("".join(rng.choice(s) for _ in range(3)) for _ in range(60))
    samples = {k: [make(s) for _ in range(12)] for k, s in kinds.items()}
    asked = [(k, make(s)) for k, s in kinds.items() for _ in range(20)]
    got = []
    for cells in (1 << 30, 0):
        monkeypatch.setattr(op8_language_id, "DENSE", cells)
        model = op8_language_id.LanguageModel(samples)
        got.append(model.predict([t for _, t in asked]))
        assert [x[0] for x in got[-1]] == [k for k, _ in asked]
    assert got[0] == got[1] and isinstance(model.tables[0], op8_language_id.Sparse)


def test_language_table(docs, nothing):
    model = op8_language_id.train(docs)
    rows = {r["doc_id"]: r for r in op8_language_id.identify(docs, model).collect()}
    assert len(rows) == len(corpus())
    # every row against the plain parse of its whole text
    alphabet = model.alphabet
    symbols = lambda t: op8_language_id._squeeze(alphabet.symbols(op8_language_id._codes(t)))
    learned = {lang: "".join(map(chr, symbols("".join(t + "\n" for t in model.samples[lang])))) for lang in model.langs}
    assert model.langs == ["de", "en"] and all(len(x) <= op8_language_id.DOCS for x in model.samples.values())
    for i, t, *_ in corpus():
        if not any(c.isalpha() for c in t or ""):
            assert (rows[i]["lang_pred"], rows[i]["score"]) == ("und", 0)
            continue
        other, need = "".join(map(chr, symbols(t))), []
        for lang in model.langs:
            n = at = 0
            while at < len(other):
                size = 0
                while at + size < len(other) and other[at : at + size + 1] in learned[lang]:
                    size += 1
                at, n = at + max(1, size), n + 1
            need.append(n * math.log2(len(learned[lang])) / len(other))
        assert rows[i]["lang_pred"] == model.langs[need.index(min(need))]
        assert rows[i]["score"] == pytest.approx(1 / sum(2 ** (8 * (min(need) - x)) for x in need))
    assert op8_language_id.identify(nothing, op8_language_id.train(nothing)).count() == 0
    odd = [(None, "abc def", "en"), (None, "abc def", "en"), (5, None, "en"), (5, "ghi", None), (6, "  ", "de")]
    odd = docs.sparkSession.createDataFrame(odd, "doc_id long, text string, lang string")
    assert op8_language_id.train(odd).samples == {"en": ["abc def"]} and op8_language_id.identify(odd, model, keep=["lang"]).count() == 5


def test_language_query(spark, tmp_path):
    """held_out by the remainder; only labelled rows outside are learned from."""
    rng = random.Random(31)
    make = lambda a: " ".join("".join(rng.choice(a) for _ in range(4)) for _ in range(80))
    rows = [(i, make("abcde" if i % 2 else "vwxyz"), ("one" if i % 2 else "two")) for i in range(60)]
    held = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i, *_ in rows}
    rows = [(i, t, "wrong" if held[i] else x) for i, t, x in rows] + [(None, make("abcde"), "one")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = op8_language_id.op8_language_id(spark, str(tmp_path)).collect()
    assert len(got) == 61 and all(r["held_out"] == held.get(r["doc_id"], False) for r in got)
    assert all(r["lang_pred"] == ("one" if r["doc_id"] is None or r["doc_id"] % 2 else "two") for r in got)


def test_suffix_array():
    rng = np.random.default_rng(0)
    for _ in range(300):
        t = rng.integers(0, int(rng.integers(1, 6)), int(rng.integers(0, 60)))
        assert suffix_array(t).tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())
    # repeats, so that names recur over several levels, and more symbols than 16 bits hold
    for most in (2, 70_000, 1 << 20):
        t = rng.integers(0, most, 3000)
        t[700:1500] = t[1600:2400]
        t[100:200] = 1
        assert suffix_array(t).tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())
    data = rng.integers(97, 99, 300).astype(np.uint8)
    order = suffix_array(data.astype(np.int64) + 1)
    plcp = permuted_common_prefixes(data, order, 16)
    for i, j in zip(order[:-1], order[1:], strict=True):
        k = 0
        while k < 16 and max(i, j) + k < 300 and data[i + k] == data[j + k]:
            k += 1
        assert plcp[j] == k or max(i, j) + 16 > 300


def brute_passages(rows):
    """By row (id, text): n_bytes, n_removed, n_spans and what is left."""
    first, want = {}, []
    for i, t in sorted(((i, t) for i, t in rows if i is not None), key=lambda r: r[0]):
        b = (t or "").encode()
        for k in range(len(b) - 49):
            first.setdefault(b[k : k + 50], i)
    for i, t in rows:
        b = (t or "").encode()
        covered = bytearray(len(b))
        for k in range(len(b) - 49):
            if i is not None and first[b[k : k + 50]] < i:
                covered[k : k + 50] = b"\1" * 50
        runs = len(re.findall(b"\1+", bytes(covered)))
        want.append((i, len(b), sum(covered), runs, bytes(c for c, v in zip(b, covered, strict=True) if not v)))
    return sorted(want, key=repr)


def passages_of(df):
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept_bytes"])) for r in op9_suffix_dedup.suffix_dedup(df).collect()), key=repr)


def test_repeated_passages(docs, nothing):
    want = brute_passages([(r[0], r[1]) for r in corpus()])
    assert sum(w[2] for w in want) > 1000 and passages_of(docs) == want
    assert op9_suffix_dedup.suffix_dedup(nothing).count() == 0


def test_passage_in_every_document(spark, monkeypatch):
    """One line that all documents have between texts of their own: its anchors are hot, and fall apart into strings."""
    rng = random.Random(21)
    line = "all rights reserved by the makers of this invented text, wherever"
    own = lambda: "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(30, 90)))
    rows = [(i, own() + line + own()) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute_passages(rows)
    assert sum(w[2] > 0 for w in want) == 119
    for most in (1 << 20, 2000, 0):
        monkeypatch.setattr(op9_suffix_dedup, "HOT_BYTES", most)
        monkeypatch.setattr(op9_suffix_dedup, "COUNTED", 1)
        assert passages_of(df) == want


def test_passages_of_odd_rows(spark):
    """Repeated, null and string ids, a very long text, columns with the operator's own names."""
    rng = random.Random(22)
    own = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    shared, long = own(80), own(200_000)
    rows = [(1, own(40) + shared), (2, own(60) + shared + own(60)), (2, own(300)), (None, shared), (3, shared), (3, shared), (4, long), (5, own(30) + long[5000:90_000]), (6, None), (7, ""), (8, "ü" * 60), (9, "ü" * 60)]
    assert passages_of(spark.createDataFrame(rows, "doc_id long, text string")) == brute_passages(rows)
    names = ["id", "x", "keep", "packed", "n_bytes", "kept_bytes"]
    df = spark.createDataFrame([(i, t, *range(6)) for i, t in rows], f"doc_id int, text string, {', '.join(f'{c} int' for c in names)}")
    out = op9_suffix_dedup.suffix_dedup(df, keep=[*names, "text"])
    assert out.columns == ["doc_id", "id", "x", "keep", "packed", "_n_bytes", "_kept_bytes", "text", "n_bytes", "n_removed", "n_spans", "kept_bytes"]
    assert all((r["id"], r["x"], r["_n_bytes"], len((r["text"] or "").encode())) == (0, 1, 4, r["n_bytes"]) for r in out.collect()) and out.count() == len(rows)
    with pytest.raises(ValueError):
        op9_suffix_dedup.suffix_dedup(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def shuffled(spark):
    """Names of the shuffle files that are on the disk."""
    files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().iterator()
    names = set()
    while files.hasNext():
        names.add(files.next().getName())
    return {n for n in names if n.startswith("shuffle_")}


def test_passages_leave_the_disk(spark, docs, tmp_path, monkeypatch):
    """What was shuffled for a stash goes with its job, and of the stashes those stay that the result reads."""
    monkeypatch.setattr(common, "shared_folder", lambda spark: str(tmp_path))
    was = shuffled(spark)
    kept = common.stashed(docs.repartition(2, "doc_id"))
    until = time.time() + 10
    while shuffled(spark) - was and time.time() < until:  # they go in the background
        time.sleep(0.1)
    assert not shuffled(spark) - was and kept.count() == len(corpus())
    out = op9_suffix_dedup.suffix_dedup(docs)
    left = [spark.read.parquet(str(p)).columns for p in tmp_path.glob("stash-*")]
    assert ["id", "x", "cuts"] in left and not any({"key", "mark", "h"} & set(c) for c in left)
    want = brute_passages([(r[0], r[1]) for r in corpus()])
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept_bytes"])) for r in out.collect()), key=repr) == want


def test_toxicity(spark, nothing):
    rng = random.Random(11)
    clean = ["".join(rng.choice(["ta", "re", "lin", "os", "mu"]) for _ in range(3)) for _ in range(150)]
    bad = ["vexgrub", "zorknib", "plufwat"]
    make = lambda toxic: " ".join([rng.choice(clean) for _ in range(rng.randint(10, 60))] + ([rng.choice(bad) for _ in range(3)] if toxic else []))
    rows = [(i, make(i % 4 == 0), int(i % 4 == 0)) for i in range(400)]
    model = op10_toxicity.fit([r[1] for r in rows[:300]], [r[2] for r in rows[:300]])
    predicted = [x >= 0.7 for x in model.score([r[1] for r in rows[300:]])]
    assert sum(p == bool(r[2]) for p, r in zip(predicted, rows[300:], strict=True)) >= 97
    assert model.score(["mutare linos vexgrubb mutaos"])[0] > model.score(["mutare linos mutaos"])[0]
    assert all(0 <= x <= 1 for x in model.score(["", "!!!"]))
    assert all(0 <= x <= 1 for x in op10_toxicity.fit([], []).score(["a"]))
    table = spark.createDataFrame([*rows, (None, None, 1), (5, "", 0)], "doc_id long, text string, score int")
    assert op10_toxicity.toxicity(table, model).count() == 402
    assert op10_toxicity.toxicity(nothing, model).count() == 0


def test_toxicity_training(spark, tmp_path, monkeypatch):
    """The sample against a plain choice of the least hashes; null, repeated and unlabelled ids; the query's held_out."""
    rng = random.Random(13)
    words_ = ["".join(rng.choice(["ta", "re", "lin", "os", "mu"]) for _ in range(3)) for _ in range(60)]
    text = lambda toxic, n=20: " ".join([rng.choice(words_) for _ in range(n)] + (["vexgrub", "zorknib"] if toxic else []))
    rows = [(i, text(i % 3 == 0, 9000 if i == 9 else 20)) for i in range(300)] + [(7, "again"), (None, "x"), (301, ""), (302, None)]
    labels = [(i, int(i % 3 == 0)) for i in range(310)] + [(10, 1), (None, 1), (11, None)]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(op10_toxicity, "fit", lambda texts, y: seen.append(list(zip(texts, y, strict=True))))
    text_of = dict(reversed(rows))
    text_of[7] = min(t for i, t in rows if i == 7)
    y = {i: int(i % 3 == 0 or i == 10) for i in range(300)}
    hashes = {r["id"]: r["h"] for r in spark.range(300).selectExpr("id", "xxhash64(id) as h").collect()}
    for most in (5, 40, 1000):
        op10_toxicity.train(docs, marks, most=most)
        want = sorted(i for v in (0, 1) for i in sorted((i for i in y if y[i] == v), key=hashes.get)[:most])
        assert seen.pop() == [(text_of[i], y[i]) for i in want]
    monkeypatch.undo()
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    marks.write.parquet(f"{tmp_path}/labels.parquet")
    got = op10_toxicity.op10_toxicity(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert all(r["predicted"] == (r["score"] >= 0.7) for r in got)
    assert np.mean([r["predicted"] == (r["doc_id"] % 3 == 0) for r in got if r["doc_id"] is not None and r["doc_id"] < 300 and r["doc_id"] != 7]) > 0.97


def test_mixture_of_null_and_shared_ids(spark, tmp_path):
    """Every row has the copies that its own words give, whatever its id."""
    import corpus_pipeline

    rng = random.Random(8)
    text = lambda n: " ".join(rng.choice("abcdefgh") * rng.randint(1, 5) for _ in range(n))
    rows = [(None if k % 3 == 0 else k % 7, text(8 * rng.randint(1, 9)), "en", "ab"[k % 2], k) for k in range(90)]
    rows += [(5, "same words here", None, None, 1)] * 6
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    got = Counter(map(tuple, corpus_pipeline.mixture(spark, docs, str(tmp_path)).collect()))
    taken = {}
    for r in op1_mixing.mix(docs.withColumn("row", docs["n_chars"]), keep=["row", "text"]).collect():
        taken.setdefault((r["doc_id"], r["text"], r["row"]), []).append((r["taken"], r["size"]))
    assert set(got) <= set(rows)
    for row in set(rows):
        own = taken[(row[0], row[1], row[4])]
        assert sum(t // n for t, n in own) <= got[row] <= sum(-(-t // n) for t, n in own)
    assert sum(n for r, n in got.items() if r[0] is None) > 20


def test_short_texts_of_shared_words_stay(spark, tmp_path):
    """A license line that all languages have ties at 1/n; it stays where it is short, whatever n."""
    import corpus_pipeline

    rng = random.Random(4)
    line, schema = "All rights reserved.", "doc_id long, text string, lang string, source string, n_chars long"
    for n in (1, 5):
        rows = []
        for k in range(n):
            own = ["".join(rng.choice("bcdfghjklmnpqrstvwxz"[4 * k : 4 * k + 4]) + "aeiou"[k] for _ in range(3)) for _ in range(40)]
            rows += [(100 * k + j, " ".join(rng.choice(own) for _ in range(60)) + "\n" + line, f"l{k}", "s", 0) for j in range(12)]
        rows += [(1000, line, "l0", "s", 0), (1001, "A.", "l0", "s", 0), (1002, "12 !", "l0", "s", 0)]
        kept = {r["doc_id"] for r in corpus_pipeline.language(spark, spark.createDataFrame(rows, schema), str(tmp_path)).collect()}
        assert kept == {r[0] for r in rows} - {1002}
    assert corpus_pipeline.least_score(4) == pytest.approx(0.3) and corpus_pipeline.least_score(1) == 1


def test_pipeline_stages(spark, docs, tmp_path):
    import corpus_pipeline

    d = docs.drop("size", "start").withColumn("n_chars", docs["n_chars"])
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = d
        d = stage(spark, d, str(tmp_path))
        d.write.parquet(f"{tmp_path}/{k}")
        d = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert sorted(d.columns) == sorted(corpus_pipeline.COLUMNS)
        if k < 3:
            assert d.count() <= before.count() and d.count() > 0
    assert {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(d.columns)


def test_passage_anchors_in_order():
    rng = np.random.default_rng(9)
    h = rng.integers(0, 1 << 62, 60, dtype=np.uint64)[rng.integers(0, 60, 500)]
    ids = rng.permutation(np.r_[np.arange(-9, 10), np.arange(-9, 10), 1 << 60])  # rows of one id, and negative ones
    doc = rng.integers(0, len(ids), 500)
    for shards in (1, 7, 1 << 40):  # the last doesn't fit into one number with the rest
        shard = op9_suffix_dedup._shard(h, shards)
        want = {(int(s), int(k & op9_suffix_dedup.LOW), int(d)) for s, k, d in zip(shard, h, doc, strict=True)}
        low, d, own, first = op9_suffix_dedup.in_order(h, doc, ids, shards)
        rows = list(zip(own.tolist(), low.tolist(), d.tolist(), strict=True))
        assert len(rows) == len(want) and set(rows) == want
        order = [(s, k, int(ids[i])) for s, k, i in rows]
        assert order == sorted(order)
        assert first.tolist() == [j == 0 or rows[j][:2] != rows[j - 1][:2] for j in range(len(rows))]


def test_passage_segments_of_short_texts():
    rng = np.random.default_rng(3)
    texts = [rng.integers(97, 99, n).astype(np.uint8).tobytes() for n in (0, 49, 50, 51, 0, 3, 400, 0, 50, 12, 200, 0)]
    for some in (texts, texts[::-1], texts[:2], texts[6:7]):
        data, off = np.frombuffer(b"".join(some), np.uint8), np.r_[0, np.cumsum([len(t) for t in some])].astype(np.int64)
        pre = common.prefix_hash(data)
        first, count, _, doc, at = op9_suffix_dedup.segments(data, off, pre)
        found = [(int(d), int(f + k - off[d])) for f, n, d in zip(first, count, doc, strict=True) for k in range(n)]
        assert found == [(i, k) for i, t in enumerate(some) for k in range(len(t) - 49)]
        # a segment's strings hold its anchor
        assert all(f + n - 1 <= a and a + 12 <= f + 50 for f, n, a in zip(first, count, at, strict=True))


def test_passages_gone_as_one(spark):
    """Segments whose strings all start earlier are one range, whatever their runs."""
    rng = np.random.default_rng(5)
    a, b = ("".join(map(chr, rng.integers(97, 123, 300))) for _ in range(2))
    rows = [(1, a[:200]), (2, a[100:]), (3, a), (4, a + b), (5, a[50:] + b[:90]), (6, None)]
    got = {r["doc_id"]: r for r in op9_suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        t, gone = t or "", set()
        for k in range(len(t) - 49):
            if any(t[k : k + 50] in (u or "") for j, u in rows if j < i):
                gone |= set(range(k, k + 50))
        assert got[i]["n_removed"] == len(gone) and got[i]["n_spans"] == sum(k - 1 not in gone for k in gone)
        assert got[i]["kept_bytes"].decode() == "".join(c for k, c in enumerate(t) if k not in gone)
