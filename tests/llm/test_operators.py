from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cardloom.llm import common, embedding_dedup, kdtree_search, language_id, minhash_dedup, packing, quality, sentencepiece_lattice, substring_dedup, token_files, toxicity
from cardloom.llm.encoders import Encoder
from cardloom.llm.queries import tokenizer_path


def closure(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {n: find(n) for n in nodes}


def plain(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


# ---- words ----
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB \n\t\x0bé　\x1c", max_size=30)), max_size=8))
@settings(max_examples=150, deadline=None)
def test_words(texts):
    b = pa.record_batch({"text": pa.array(texts, pa.string())})
    w = common.words_of(b)
    want = [(i, x) for i, t in enumerate(texts) for x in (t or "").encode().split()]
    assert [(int(d), w.buf[s:e].tobytes()) for d, s, e in zip(w.doc, w.starts, w.ends, strict=True)] == want
    names = {}
    for (_, x), h in zip(want, w.hashes(), strict=True):
        assert names.setdefault(x, h) == h
    assert len(set(names.values())) == len(names)
    g, d, at = common.shingles(w.hashes(), w.first, 3, True)
    for i, t in enumerate(texts):
        n = len((t or "").encode().split())
        assert (d == i).sum() == (0 if not n else max(1, n - 2))


# ---- 1 ----
def vectors(rng):
    rows = []
    for c in range(6):
        centre = rng.normal(size=16)
        rows += [(centre + rng.normal(size=16) * 0.08 * (i % 3), c % 2) for i in range(12)]
    rows += [(rows[0][0], 0)] * 20
    data = [(i * 7, [float(np.float32(x)) for x in v], int(c)) for i, (v, c) in enumerate(rows)]
    n = 7 * len(data)
    odd = [(n, None, 0), (n + 1, [], 0), (n + 2, [0.0] * 16, 0), (n + 3, [float("nan")] + [1.0] * 15, 0), (n + 4, [None] + [1.0] * 15, 1), (n + 5, data[0][1], None), (n + 6, [1.0, 2.0], 0), (n + 7, [2.0, 4.0], 0), (None, data[0][1], 0), data[3]]
    return data + odd


def test_embedding_dedup(spark):
    data = vectors(np.random.default_rng(2))
    df = spark.createDataFrame([(*r, "extra") for r in data], "vec_id long, embedding array<float>, label int, tile string")
    got = {r["vec_id"]: tuple(r)[1:] for r in embedding_dedup.embedding_near_dedup(df, 0.98).collect()}
    ids = {r[0]: r for r in data if r[0] is not None}
    ok = {i: np.array(v, float) for i, v, c in ids.values() if c is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    links = [(a, b) for a in ok for b in ok if a < b and ids[a][2] == ids[b][2] and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] / np.sqrt((ok[a] @ ok[a]) * (ok[b] @ ok[b])) >= 0.98]
    n, comp = Counter(x for p in links for x in p), closure(ids, links)
    assert got == {i: (n[i], comp[i], comp[i] == i) for i in ids}
    assert embedding_dedup.embedding_near_dedup(df.where("vec_id < 0")).collect() == []


@pytest.mark.parametrize("kind", ["bigint", "string", "double"])
def test_embedding_dedup_labels_of_any_type(spark, kind):
    rows = [(1, [1.0, 0.0], 1), (2, [1.0, 0.01], 1), (3, [1.0, 0.0], 2), (4, [1.0, 0.0], None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("label", F.col("label").cast(kind))
    got = sorted(tuple(r) for r in embedding_dedup.embedding_near_dedup(df).collect())
    assert got == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True), (4, 0, 4, True)]


def test_embedding_dedup_in_many_tiles(spark):
    """Many small tiles, a crowd of equal vectors and a common direction, against all pairs."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=12) * 3
    x = np.array([base + rng.normal(size=12) for _ in range(400)] + [base + 1] * 300)
    x[50:200] = x[rng.integers(0, 50, 150)] + rng.normal(size=(150, 12)) * 0.12
    label = [int(i % 7 == 0) for i in range(len(x))]
    df = spark.createDataFrame([(i, v.tolist(), c) for i, (v, c) in enumerate(zip(x, label, strict=True))], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: tuple(r)[1:] for r in embedding_dedup.embedding_near_dedup(df, 0.98, tile=16).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = (u @ u.T >= 0.98) & (np.array(label)[:, None] == label) & ~np.eye(len(x), dtype=bool)
    comp = closure(range(len(x)), list(zip(*np.nonzero(link), strict=True)))
    assert got == {i: (int(link[i].sum()), comp[i], comp[i] == i) for i in range(len(x))}


def test_near_tiles_leave_far_ones_out(spark):
    rng = np.random.default_rng(3)
    boxes = [(str(i % 2), i, sorted_lo.tolist(), (sorted_lo + rng.random(4) * 0.1).tolist()) for i, sorted_lo in enumerate(rng.random((60, 4)) - 0.5)]
    df = spark.createDataFrame(boxes, "grp string, tile long, lo array<double>, hi array<double>")
    got = {tuple(r) for r in embedding_dedup.near_tiles(df, 0.98).collect()}
    gap = np.sqrt(0.04) + 1e-6
    away = lambda a, b: np.sqrt(sum(max(0, l1 - h2, l2 - h1) ** 2 for l1, h1, l2, h2 in zip(a[2], a[3], b[2], b[3], strict=True)))
    assert got == {(a[1], b[1]) for a in boxes for b in boxes if a[0] == b[0] and a[1] <= b[1] and away(a, b) <= gap}
    assert 60 < len(got) < 900


def test_tiles_find_all():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 12)) * np.linspace(3, 0.1, 12)
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    i, j = embedding_dedup.compare_tiles(x, x, x, x, 0.9, True)
    want = {(a, b) for a in range(300) for b in range(a + 1, 300) if x[a] @ x[b] >= 0.9}
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == want


# ---- 2, 10: encoders and files ----
@pytest.mark.parametrize("file, kind", [("word_bpe_49k.json", "word"), ("byte_bpe_50k.json", "byte")])
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("aBéÉß '’s\n\t12!… \x85\x1cİςΣ日́<|>_²ª😀"), st.characters(max_codepoint=0x2FFF, exclude_categories=["Cs"])), max_size=25), max_size=5))
@settings(max_examples=60, deadline=None)
def test_encoders(file, kind, texts):
    key = (file, kind)
    if key not in ENCODERS:
        ENCODERS[key] = Encoder(tokenizer_path(file), kind)
    e = ENCODERS[key]
    texts = [*texts, "Don't  stop\n\nnow , it's 2024!", "", " x ", "<|endoftext|>"]
    want = [x.ids for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in e.encode(texts)] == want


@pytest.mark.parametrize("file, kind", [("word_bpe_49k.json", "word"), ("byte_bpe_50k.json", "byte")])
def test_added_tokens_are_those_of_the_library(file, kind):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path(file))
    texts = ["a <|endoftext|> b", "a  <|startoftext|>\n\nB", "<|endoftext|><|endoftext|>x", "é日<|endoftext|>\u00a0 y", "a <|ENDOFTEXT|> b", "<| endoftext |> <|endoftext|", "a b"]
    got = [np.frombuffer(x, "<u4").tolist() for x in Encoder(tokenizer_path(file), kind).encode(texts + texts)]
    assert got == 2 * [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert library.token_to_id("<|endoftext|>") in got[0]


ENCODERS: dict = {}


def test_token_files(spark, docs, no_docs, tmp_path):
    path = str(tmp_path / "tokens")
    data = token_files.write_tokens(docs, tokenizer_path("word_bpe_49k.json"), path, shards=3)
    got = token_files.read_tokens(spark, token_files.open_dataset(path), with_ids=True).orderBy("doc_id", "start").collect()
    e = Encoder(tokenizer_path("word_bpe_49k.json"), "word")
    want, at = [], 0
    for r in docs.orderBy("doc_id").collect():
        ids = [*e.tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        want.append((r["doc_id"], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        at += len(ids)
    assert [tuple(r) for r in got] == want
    assert sum(s[1] for s in data.shards) == len(want) and len(data.shards) > 1
    empty = token_files.write_tokens(no_docs, tokenizer_path("word_bpe_49k.json"), str(tmp_path / "none"), shards=2)
    assert token_files.read_tokens(spark, empty).collect() == []


def test_packing(spark, docs, no_docs):
    cut = packing.cut_pieces(docs, tokenizer_path("byte_bpe_50k.json"), capacity=512, with_ids=True)
    got = packing.pack(cut, 512, group=20).collect()
    e = Encoder(tokenizer_path("byte_bpe_50k.json"), "byte")
    want = []
    for r in docs.collect():
        ids = [*e.tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        at, size, k = 0, len(ids) % 512 or min(len(ids), 512), 0
        while at < len(ids):
            want.append((r["doc_id"], k, at, size, zlib.crc32(np.array(ids[at : at + size], "<u4").tobytes())))
            at, k, size = at + size, k + 1, 512
    assert sorted(tuple(r)[:5] for r in got) == sorted(want)
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in by.values():
        s.sort()
        assert s[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(s, s[1:], strict=False)) and s[-1][0] + s[-1][1] <= 512
    total = sum(r["length"] for r in got)
    assert len(by) <= -(-total // 512) + 2
    clash = packing.pack(cut.withColumnsRenamed({"ids": "before"}).withColumn("salt", F.lit(1)).withColumn("rank", F.lit("x")).withColumn("n", F.lit(2)).withColumn("c0", F.lit(3)), 512, group=20)
    assert clash.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "before", "salt", "rank", "n", "c0", "sequence_id", "offset"]
    assert clash.select("salt", "rank", "n", "c0").distinct().collect() == [(1, "x", 2, 3)]
    assert sorted(tuple(r)[:5] for r in clash.collect()) == sorted(want)
    whole = packing.sequences(packing.pack(cut, 512)).agg(F.sum("n_tokens"), F.sum(F.length("ids"))).first()
    assert tuple(whole) == (total, 4 * total)
    assert packing.pack(packing.cut_pieces(no_docs, tokenizer_path("byte_bpe_50k.json"))).collect() == []


@given(st.dictionaries(st.integers(1, 60), st.integers(0, 50), max_size=25))
@settings(max_examples=40, deadline=None)
def test_plan_holds_every_piece_once(h):
    held = Counter()
    for c, m in packing.plan(h, 60):
        assert m > 0 and sum(x * t for x, t in c) <= 60
        for x, t in c:
            held[x] += t * m
    assert held == Counter({x: n for x, n in h.items() if n})


def test_knapsack():
    lengths, price = np.array([3, 5, 7]), np.array([3.0, 5.5, 7.1])
    best, last = packing.knapsack(lengths, price, 20)
    brute = max(3 * a + 5.5 * b + 7.1 * c for a in range(7) for b in range(5) for c in range(3) if 3 * a + 5 * b + 7 * c <= 20)
    assert best[20] == pytest.approx(brute) and sum(price[i] for i in packing.trace(lengths, last, 20)) == pytest.approx(brute)


# ---- 3 ----
def test_kth_largest(spark):
    rng = np.random.default_rng(1)
    values = [int(x) for x in rng.integers(-(2**62), 2**62, 200)] + [0, 0, 0, -1, 5, 5]
    df = spark.createDataFrame([(v,) for v in values], "key long")
    order = sorted(values, reverse=True)
    for k in (1, 100, 206):
        kth, ties = quality.kth_largest(df, k)
        assert kth == order[k - 1] and ties == order[:k].count(kth)


def test_gumbel_top_k(spark):
    df = spark.createDataFrame([(i, float(i % 10), 5) for i in range(300)] + [(None, 1.0, 5)], "doc_id long, log_weight double, n_grams long")
    got = quality.resample(df, 40).collect()
    assert sum(r["selected"] for r in got) == 40
    assert min(r["gumbel_key"] for r in got if r["selected"]) >= max(r["gumbel_key"] for r in got if not r["selected"])
    assert all(r["selected"] for r in quality.resample(df, 999).collect()) and not any(r["selected"] for r in quality.resample(df, 0).collect())


def test_ties_at_the_cut(spark):
    rows = [(i, float(i // 5)) for i in range(20)] + [(None, 2.0), (7, 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, gumbel_key double")
    for k in (3, 5, 7, 9, 13):
        got = [tuple(r) for r in df.where(quality.top_k(df, k)).collect()]
        want = sorted(rows, key=lambda r: (-r[1], r[0] is None, r[0] or 0))[:k]
        assert sorted(got, key=str) == sorted(want, key=str)


def test_quality_of_odd_rows(spark):
    """Labelled tables with null, empty, long and repeated texts, and rows without doc_id."""
    good, bad = [" ".join(f"{a}{i % 7} and the" for a in "xyz") for i in range(60)], ["%%% $$$ %%%$ " * (1 + i % 5) for i in range(60)]
    rows = [(i, t) for i, t in enumerate(good + bad)] + [(200, None), (201, ""), (202, " ".join(good) * 50), (203, bad[0] * 900), (5, good[5]), (None, good[0]), (None, bad[0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, log_weight string")
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(120)] + [(3, 1)], "doc_id long, quality int")
    got = quality.classify(df, labels).collect()
    assert len(got) == len(rows)
    chosen = Counter((r["doc_id"], r["selected"]) for r in got)
    assert all(chosen[i, True] >= 1 for i in (200, 201, 202)) and chosen[203, False] == 1 and chosen[5, True] == 2
    assert chosen[None, True] == 1 == chosen[None, False]
    kept = quality.keep_selected(df, labels)
    assert kept.columns == df.columns and kept.count() == sum(r["selected"] for r in got)


def test_quality(spark, docs, no_docs):
    good = [(i, " ".join(f"{a} and {a}s of the" for a in ("tree", "house", "river", "stone")[: 1 + i % 4]) + f" w{i}", int(i % 2)) for i in range(150)]
    rows = [(i, t if q else " ".join(w + "%%%" for w in t.split()), q) for i, t, q in good]
    df = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows if i % 3] + [(9999, 1), (None, 1), (7, None)], "doc_id long, quality int")
    got = {r["doc_id"]: r["selected"] for r in quality.classify(df, labels).collect()}
    assert sum(got[i] == bool(q) for i, _, q in rows) >= 148
    kept = quality.keep_selected(df, labels)
    assert {r["doc_id"] for r in kept.collect()} == {i for i, s in got.items() if s} and kept.columns == df.columns
    none = labels.where("false")
    assert quality.classify(docs, none).where("selected").count() == docs.count()
    assert quality.classify(no_docs, labels).collect() == []


def test_importance_weights_match_brute_force(spark, docs):
    """Counts of hashed words, pairs and word ends, log ratios and weights, one n-gram at a time."""
    bits = 10

    def grams(text):
        w = [x.lower() for x in (text or "").encode().split()]
        one = [common.words_of(pa.record_batch({"text": pa.array([x.decode()])})) for x in w]
        h = [x.hashes()[0] for x in one]
        with np.errstate(over="ignore"):
            keys = [common.fmix(x) for x in h] + [common.fmix(a * common._GOLD + b) for a, b in zip(h, h[1:], strict=False)] + [common.fmix(x.suffix_hashes(3)[0] ^ common._GOLD) for x in one]
        return [int(k >> np.uint64(64 - bits)) for k in keys]

    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    raw, target = Counter(g for _, t in rows for g in grams(t)), Counter(g for i, t in rows if i % 2 for g in grams(t))
    count = lambda c: np.array([c[i] for i in range(1 << bits)], float)
    assert (quality.bucket_counts(docs, bits) == count(raw)).all()
    table = quality.log_ratio(count(target), count(raw))
    q = (count(raw) + 0.01) / (count(raw) + 0.01).sum()
    extra = min(1 << bits, max(1, sum(target.values())))
    assert table == pytest.approx([np.log((target[i] + extra * q[i]) / (sum(target.values()) + extra) / q[i]) for i in range(1 << bits)])
    got = {r["doc_id"]: (r["log_weight"], r["n_grams"]) for r in quality.weights(docs, table, bits).collect()}
    for i, t in rows:
        assert got[i][1] == len(grams(t)) and got[i][0] == pytest.approx(sum(table[g] for g in grams(t)), abs=1e-9)


# ---- 4 ----
def shingle_set(text, k=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}


@pytest.mark.parametrize("percent", [85, 80])
def test_minhash(docs, no_docs, percent):
    got = {r["doc_id"]: tuple(r)[1:] for r in minhash_dedup.minhash_near_dedup(docs, 5, percent, tile=4).collect()}
    sets = {i: shingle_set(t) for i, t in plain(docs).items()}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    comp = closure(sets, links)
    assert got == {i: (len(sets[i]), comp[i], comp[i] == i) for i in sets}
    assert len(set(comp.values())) < len(sets) - 15
    if percent == 80:
        assert minhash_dedup.minhash_near_dedup(no_docs).collect() == []


def test_minhash_two_texts_of_a_doc_id(spark):
    x, y = (" ".join(f"{c}{i}" for i in range(60)) for c in "xy")
    rows = [(1, x), (10, x), (10, y), (20, y), (5, y + " more"), (30, "alone of its kind and far away")]
    got = minhash_dedup.minhash_near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80).collect()
    assert sorted(tuple(r) for r in got) == [(1, 56, 1, True), (5, 57, 1, False), (10, 56, 1, False), (10, 56, 1, False), (20, 56, 1, False), (30, 3, 30, True)]


def test_minhash_crowded_bucket(spark):
    """Many near copies of several bases in shared buckets, long texts among them, in small tiles; a row without doc_id."""
    rng = np.random.default_rng(6)
    base = [f"w{i}" for i in range(90)]
    rows = []
    for i in range(70):
        w = list(base)
        for _ in range(int(rng.integers(0, 5))):
            w[int(rng.integers(0, 90))] = f"x{rng.integers(0, 9)}"
        rows.append((i * 2, " ".join(w)))
    rows += [(1000 + i, " ".join(f"long{j}" for j in range(3000 + i))) for i in range(4)] + [(500 + i, rows[i % 3][1]) for i in range(40)]
    df = spark.createDataFrame([*rows, (None, rows[0][1]), (None, None)], "doc_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:] for r in minhash_dedup.minhash_near_dedup(df, 5, 85, tile=4).collect()}
    assert got.pop(None)[1:] == (None, False)
    sets = {i: shingle_set(t) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    comp = closure(sets, links)
    assert got == {i: (len(sets[i]), comp[i], comp[i] == i) for i in sets}


def test_copies_are_confirmed(spark, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "COPIES", 3)
    text = [" ".join(f"{c}{i}" for i in range(20)) for c in "ab"]
    docs = spark.createDataFrame([(i, text[i % 2]) for i in range(30)], "doc_id long, text string")
    sk = minhash_dedup.sketch(docs)
    members = sk.withColumn("size", F.lit(15).cast("long"))
    links = [tuple(r) for r in minhash_dedup.confirmed_copies(docs, members, 5).collect()]
    assert closure(range(30), links) == {i: i % 2 for i in range(30)}
    one = members.first()
    wrong = members.select("doc_id", F.lit(one["f1"]).alias("f1"), F.lit(one["f2"]).alias("f2"), "n_shingles", "size")
    monkeypatch.setattr(minhash_dedup, "set_names", lambda g, first: np.full((2, len(first) - 1), [[one["f1"]], [one["f2"]]]))
    with pytest.raises(Exception, match="different sets of one name"):
        minhash_dedup.confirmed_copies(docs, wrong, 5).collect()


def test_estimate():
    rng = np.random.default_rng(3)
    core = rng.integers(0, 2**63, 850, np.uint64)
    a, b = (np.concatenate([core, rng.integers(0, 2**63, 75, np.uint64)]) for _ in range(2))
    m = minhash_dedup.minima(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
    sig = minhash_dedup.pack_bits(m)
    assert abs(minhash_dedup.estimate(minhash_dedup.equal_groups(sig[0], sig[1])) - 0.85) < 0.12
    assert minhash_dedup.equal_groups(sig[0], sig[0]) == minhash_dedup.HASHES
    assert (minhash_dedup.intersections([a, b, a[:3]]) == [[925, 850, 3], [850, 925, 3], [3, 3, 3]]).sum() >= 6


# ---- 5 ----
def test_toxicity(spark, docs, no_docs):
    rng = np.random.default_rng(1)
    say = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 300, n))
    rows = [(i, say(30) + (" grumbly" + "xyz"[i % 3] + " snarl" if i % 6 == 0 else "")) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 6 == 0)) for i in range(0, 400)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.train(df.where("doc_id < 400"), labels)
    got = {r["doc_id"]: r["toxic_score"] for r in toxicity.score(df, model).collect()}
    held = range(400, 600)
    assert sum((got[i] >= 0.5) == (i % 6 == 0) for i in held) >= 195
    s = toxicity.score(docs, model).collect()
    assert len(s) == docs.count() and all(0 <= r["toxic_score"] <= 1 for r in s) and "component_id" in s[0]
    assert toxicity.score(no_docs, model).collect() == []
    nothing = toxicity.train(df, labels.where("false"))
    assert toxicity.score(df, nothing).agg(F.max("toxic_score")).first()[0] < 0.5


def test_risk_and_its_slopes():
    rng = np.random.default_rng(4)
    zp, zu, prior = rng.normal(size=7), rng.normal(size=11), 0.2
    loss = lambda z, y: float(np.mean([np.log(1 + np.exp(-y * x)) for x in z]))
    assert toxicity.risk(zp, zu, prior) == pytest.approx((prior * loss(zp, 1), loss(zu, -1) - prior * loss(zp, -1)))
    for shift in (0.0, -6.0):  # with very low logits of unlabelled texts the second part is negative, and is climbed
        low = zu + shift
        a, b = toxicity.risk(zp, low, prior)
        assert (b < 0) == (shift < 0)
        f = (lambda p, u: -toxicity.risk(p, u, prior)[1]) if b < 0 else (lambda p, u: sum(toxicity.risk(p, u, prior)))
        step = 1e-6
        for z, got, which in ((zp, toxicity.slopes(zp, low, prior)[0], 0), (low, toxicity.slopes(zp, low, prior)[1], 1)):
            for i in range(len(z)):
                up, down = z.copy(), z.copy()
                up[i], down[i] = up[i] + step, down[i] - step
                d = (f(up, low) - f(down, low)) if which == 0 else (f(zp, up) - f(zp, down))
                assert got[i] == pytest.approx(d / (2 * step), abs=1e-6)


def test_toxic_scores_match_brute_force(spark, docs):
    rng = np.random.default_rng(1)
    model = rng.normal(size=1 << toxicity.BITS).astype(np.float32), -0.3
    for r in toxicity.score(docs, model).join(docs.select("doc_id", "text").distinct(), "doc_id").collect():
        seen = set()
        for w in (r["text"] or "").encode().split():
            one = common.words_of(pa.record_batch({"text": pa.array([w.decode()])}), lower=True)
            for h in (one.hashes(), *(one.hashes(p) for p in toxicity.PREFIXES)):
                seen.add(int(common.fmix(h)[0] >> np.uint64(64 - toxicity.BITS)))
        z = sum(float(model[0][i]) for i in seen) + model[1]
        assert r["toxic_score"] == pytest.approx(1 / (1 + np.exp(-np.clip(z, -40, 40))), abs=1e-6)


def test_fit_is_bounded(spark):
    same = spark.createDataFrame([(5, f"a{i} b c d e f g h") for i in range(50)], "h long, text string")
    assert len(toxicity.collect_features(same, 8)) == 8
    assert [len(x) for x in toxicity.collect_features(same, 2, longest=3)] == [3, 3]


# ---- 6 ----
def test_language_id(spark, docs, no_docs):
    rng = np.random.default_rng(1)
    syllables = {"en": ["the", "ing", "on", "sh"], "de": ["sch", "ung", "ei", "ß"], "fr": ["eau", "é", "ou", "que"]}
    say = lambda lang: " ".join("".join(rng.choice(syllables[lang], 3)) for _ in range(12))
    rows = [(i, say(x := ["en", "de", "fr"][i % 3]), x) for i in range(150)]
    train = spark.createDataFrame([*rows[:90], (900, None, "en"), (901, "zzz", None), (902, "123", "de")], "doc_id long, text string, lang string")
    proto = language_id.fit_prototypes(train)
    assert sorted(proto) == ["de", "en", "fr"]
    test = spark.createDataFrame([*rows[90:], (1000, None, "x"), (1001, " 12 !", "x"), (1002, "", "x"), (1003, "日本 𝒜𝒷", "x")], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in language_id.identify(test, proto).collect()}
    assert sum(got[i]["lang_pred"] == x for i, _, x in rows[90:]) >= 59
    assert [got[i]["lang_pred"] for i in (1000, 1001, 1002)] == ["und"] * 3 and got[1003]["lang_pred"] in proto
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert {r["lang_pred"] for r in language_id.identify(docs, {}).collect()} == {"und"}
    assert language_id.identify(no_docs, proto).collect() == [] and language_id.fit_prototypes(no_docs) == {}


def naive_vector(text, dim=64):
    """Trigrams one by one, over letters and single gaps."""
    v = {}
    get = lambda c: v.setdefault(c, language_id.letter_vector(c, dim).astype(int))
    s = [0]
    for ch in text or "":
        c = language_id.lower_letter(ch)
        if c or s[-1]:
            s.append(c)
    s += [0] * (s[-1] != 0)
    out = np.zeros(dim)
    for a, b, c in zip(s, s[1:], s[2:], strict=False):
        out += np.roll(get(a), 2) * np.roll(get(b), 1) * get(c)
    return out / np.linalg.norm(out) if out.any() else None


@given(st.text(alphabet=st.one_of(st.sampled_from("aBzéÉßþÿ  .1жΩ日𝒜"), st.characters(max_codepoint=0x2FFF, exclude_categories=["Cs"])), max_size=40))
@settings(max_examples=80, deadline=None)
def test_document_vector_matches_brute_force(text):
    got, want = language_id.document_vector(text, 64), naive_vector(text)
    if want is None:
        assert got is None or not got.any()
    else:
        assert np.abs(got - want).max() < 1e-5


def test_language_id_matches_brute_force(spark, docs):
    train = [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect() if r["text"] and r["lang"]]
    proto = language_id.fit_prototypes(docs.select("doc_id", "text", "lang"), 64)
    want = {}
    for _, t, lang in train:
        if (v := naive_vector(t)) is not None:
            want[lang] = want.get(lang, 0) + v
    want = {x: v / np.linalg.norm(v) for x, v in want.items()}
    assert sorted(want) == list(proto) and all(np.abs(want[x] - proto[x]).max() < 1e-5 for x in want)
    for r in language_id.identify(docs, proto, 64).collect():
        v = naive_vector(r["text"])
        c = {x: float(want[x] @ v) for x in sorted(want)} if v is not None else {}
        assert (r["lang_pred"] == "und") == (not c)
        assert not c or (c[r["lang_pred"]] >= max(c.values()) - 1e-5 and r["score"] == pytest.approx(min(1, max(0, c[r["lang_pred"]])), abs=1e-5))


def test_other_scripts(spark):
    words = {"ru": "быстрая коричневая лиса прыгает через ленивую собаку", "uk": "швидка бура лисиця стрибає через ледачого пса їжак", "el": "η γρήγορη καφέ αλεπού πηδάει πάνω από το τεμπέλικο σκυλί", "ja": "素早い茶色の狐がのろまな犬を飛び越える"}
    words = {x: " ".join([w] * 3) for x, w in words.items()}
    rng = np.random.default_rng(1)
    say = lambda x: " ".join(rng.choice(words[x].split(), 9))
    rows = [(i, say(x := list(words)[i % 4]), x) for i in range(120)]
    proto = language_id.fit_prototypes(spark.createDataFrame(rows[:80], "doc_id long, text string, lang string"))
    got = language_id.identify(spark.createDataFrame(rows[80:], "doc_id long, text string, lang string"), proto).collect()
    assert sum(r["lang_pred"] == r["lang"] for r in got) >= 39


# ---- 7 ----
def test_sentencepiece(spark, docs, no_docs):
    import sentencepiece

    model = tokenizer_path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    small = docs.where("length(text) < 700 or text is null")
    extra = spark.createDataFrame([(-1, "  a  b "), (-2, "日本語x😀 \n\t é"), (-3, "ab" * 400), (-4, "▁x ▁"), (-5, " "), (-6, "x" * 300)], "doc_id long, text string")
    df = small.select("doc_id", "text").distinct().unionAll(extra)
    enc = common.save(sentencepiece_lattice.encode(df, model, with_ids=True, with_text=True))
    texts = plain(df)
    got = {r["doc_id"]: r for r in enc.collect()}
    for i, t in texts.items():
        ids = sp.encode(t or "")
        assert (got[i]["ids"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (ids, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    back = {r["doc_id"]: r["text"] for r in sentencepiece_lattice.decode(enc, model).collect()}
    assert back == {i: sp.decode(r["ids"]) for i, r in got.items()} == {i: r["text"] for i, r in got.items()}
    rows = spark.createDataFrame([(1, None, "t", 5), (2, [], None, 6)], "k int, ids array<int>, text string, piece int")
    assert sorted(tuple(r) for r in sentencepiece_lattice.decode(rows, model).collect()) == [(1, 5, ""), (2, 6, "")]
    assert sentencepiece_lattice.encode(no_docs, model).collect() == []


def test_units_and_model_type():
    model = tokenizer_path("piece_bpe_32k.model")
    assert sentencepiece_lattice.read_model_type(model) == "bpe"
    cut = sentencepiece_lattice.unit_pattern(["ab", "bc", "▁a", "..", "▁▁", "d"])
    assert sentencepiece_lattice.units_of("abcab..d1 a  \nx", cut) == ["▁abcab", "..", "d", "1", "▁a", "▁▁\n", "x"]
    assert "".join(sentencepiece_lattice.units_of(" Aé日 \t", cut)) == "▁▁Aé日▁\t"
    with pytest.raises(ValueError):
        sentencepiece_lattice.unit_pattern(["a▁b"])


def test_merge_fold_and_heap_agree(spark):
    """Pieces made of earlier ones, with ties, and some whose parts come later: the fold over bits against merges with a heap."""
    rng = np.random.default_rng(7)
    cost = {"a": (0.0, 1), "b": (0.0, 2)}
    for i in range(3, 70):
        p = "".join(rng.choice([*cost, "c"], 2))
        if len(p) < 9:
            cost.setdefault(p, (float(i // 2), i))
    late = sentencepiece_lattice.late_pieces(cost)
    assert sentencepiece_lattice.late_pieces({"ab": (2.0, 1), "bc": (9.0, 2), "abc": (5.0, 3), "bcd": (3.0, 4), "xyz": (1.0, 5)}) == ["bcd", "xyz"]
    assert 0 < len(late) < len(cost) / 2
    table = spark.createDataFrame([(i, p, -c, "piece") for p, (c, i) in cost.items()] + [(0, "<unk>", 0.0, "control")], "id int, piece string, score double, kind string")
    units = sorted({"".join(rng.choice(list("abc"), n)) for n in (1, 2, 3, 4, 5, 7, 9, 20, 61, 62) for _ in range(40)})
    assert sum(not any(p in u for p in late) for u in units) > 100
    got = {r["unit"]: r["ids"] for r in sentencepiece_lattice.encode_units(spark.createDataFrame([(u,) for u in units], "unit string"), table, "bpe").collect()}
    for u in units:
        assert got[u] == [cost[p][1] if p in cost else 0 for p in sentencepiece_lattice.heap_merge(u, cost)], u


def test_viterbi_fold(spark):
    score = {"a": -2.0, "b": -2.5, "ab": -3.0, "ba": -3.1, "aba": -4.4, "bb": -5.5}
    table = spark.createDataFrame([(i + 1, p, s, "piece") for i, (p, s) in enumerate(score.items())] + [(0, "<unk>", 0.0, "control")], "id int, piece string, score double, kind string")
    rng = np.random.default_rng(1)
    units = sorted({"".join(rng.choice(list("abc"), rng.integers(1, 9))) for _ in range(60)})
    got = {r["unit"]: r["ids"] for r in sentencepiece_lattice.encode_units(spark.createDataFrame([(u,) for u in units], "unit string"), table, "unigram").collect()}
    ids = {p: i + 1 for i, p in enumerate(score)}

    def best(u):
        b = [0.0]
        for j in range(1, len(u) + 1):
            b.append(max([b[j - 1] - 1e6] + [b[i] + score[u[i:j]] for i in range(j) if u[i:j] in score]))
        return b[-1]

    names = {i: p for p, i in ids.items()}
    for u, x in got.items():
        total = sum(score[names[i]] if i else -1e6 for i in x)
        assert total == pytest.approx(best(u)), u


def test_long_unigram_units(spark, monkeypatch):
    score = {"a": -2.0, "b": -2.5, "ab": -3.0, "ba": -3.1, "aba": -4.4, "bb": -5.5, "é": -1.5, "éa": -3.5}
    table = spark.createDataFrame([(i + 1, p, s, "piece") for i, (p, s) in enumerate(score.items())] + [(0, "<unk>", 0.0, "control")], "id int, piece string, score double, kind string")
    rng = np.random.default_rng(2)
    units = ["".join(rng.choice(list("abcé"), n)) for n in (61, 62, 63, 300, 5000)]
    df = spark.createDataFrame([(u,) for u in units], "unit string")
    got = {r["unit"]: r["ids"] for r in sentencepiece_lattice.encode_units(df, table, "unigram").collect()}
    assert set(got) == set(units)
    names = {i + 1: p for i, p in enumerate(score)}
    for u, x in got.items():
        best = [0.0]
        for j in range(1, len(u) + 1):
            best.append(max([best[j - 1] - 1e6] + [best[i] + score[u[i:j]] for i in range(max(0, j - 3), j) if u[i:j] in score]))
        assert sum(score[names[i]] if i else -1e6 for i in x) == pytest.approx(best[-1], rel=1e-12)
        assert "".join(names.get(i, "c") for i in x) == u
    # the same ids as the fold, ties included
    short = sorted({"".join(rng.choice(list("abcé"), rng.integers(2, 12))) for _ in range(80)})
    df = spark.createDataFrame([(u,) for u in short], "unit string")
    folded = {r["unit"]: r["ids"] for r in sentencepiece_lattice.encode_units(df, table, "unigram").collect()}
    monkeypatch.setattr(sentencepiece_lattice, "LONG", 1)
    assert {r["unit"]: r["ids"] for r in sentencepiece_lattice.encode_units(df, table, "unigram").collect()} == folded
    # whole texts; the given model's pieces and scores serve as a unigram model here
    text = spark.createDataFrame([(1, "a " + "ab" * 2000 + " b")], "doc_id long, text string")
    monkeypatch.setattr(sentencepiece_lattice, "LONG", 62)
    row = sentencepiece_lattice.encode(text, tokenizer_path("piece_bpe_32k.model"), with_ids=True, model_type="unigram").first()
    assert row["n_tokens"] == len(row["ids"]) > 100


# ---- 8 ----
def test_exact_top_k(spark):
    rng = np.random.default_rng(4)
    data = [(i * 3, [float(np.float32(x)) for x in rng.normal(size=8) * (1 + i % 5)]) for i in range(180)]
    data += [(1000 + i, data[5][1]) for i in range(30)]
    odd = [(2000, None), (2001, [None] + [1.0] * 7), (2002, [float("inf")] * 8), (2010, [1.0, 2.0]), (2020, []), (None, data[0][1]), data[4]]
    df = spark.createDataFrame([(*r, "x") for r in data + odd], "vec_id long, embedding array<float>, shard string")
    v = kdtree_search.integer_vectors(df)
    got = sorted(tuple(r) for r in kdtree_search.exact_top_k(v, v.where("vec_id % 10 = 0"), 10, shard=40, block=7).collect())
    x = {i: np.floor(1024 * np.array(e, float)).astype(np.int64) for i, e in data}
    x[2010] = np.array([1024, 2048])
    want = []
    for q in (i for i in x if i % 10 == 0):
        s = sorted((-int(x[q] @ x[c]), c) for c in x if c != q and len(x[c]) == len(x[q]))[:10]
        want += [(q, k + 1, c, -n) for k, (n, c) in enumerate(s)]
    assert got == sorted(want)
    assert kdtree_search.exact_top_k(v.where("false"), v, 3).collect() == []


def test_search_leaves_shards_out(spark):
    """Clustered vectors in small shards: the same results as all products, and few pairs of query and shard searched."""
    rng = np.random.default_rng(9)
    centres = rng.integers(-900, 900, (12, 6))
    x = np.concatenate([c + rng.integers(-40, 40, (120, 6)) for c in centres] + [np.repeat(centres[:1], 200, 0)])
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, x array<bigint>")
    q = v.where("vec_id % 20 = 0")
    got = sorted(tuple(r) for r in kdtree_search.exact_top_k(v, q, 5, shard=60, block=16).collect())
    want = []
    for i in range(0, len(x), 20):
        s = sorted((-int(x[i] @ x[j]), j) for j in range(len(x)) if j != i)[:5]
        want += [(i, k + 1, j, -n) for k, (n, j) in enumerate(s)]
    assert got == sorted(want)
    run = kdtree_search.Search(v, q, 6, len(x), q.count(), 5, 60, 16)
    found, top = run.first()
    shards = run.trees.count()
    assert shards >= 20
    assert run.rest(found, top).count() < 0.1 * shards * q.count()


def test_tree_and_cells():
    rng = np.random.default_rng(1)
    x = rng.integers(-99, 99, (1000, 3))
    order, cuts, low, high = kdtree_search.build_tree(x, 64)
    assert sorted(order.tolist()) == list(range(1000)) and len(low) == 2 * (len(cuts) - 1) - 1 == 31
    for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        part = x[order[a:b]]
        assert (part.min(0) == low[15 + i]).all() and (part.max(0) == high[15 + i]).all()
    assert all((low[i] == np.minimum(low[2 * i + 1], low[2 * i + 2])).all() for i in range(15))
    axes, values = kdtree_search.split_space(x, 3)
    counts = np.bincount(kdtree_search.cell_of(x, axes, values), minlength=8)
    assert counts.sum() == 1000 and counts.min() > 80
    assert (kdtree_search.cell_of(x, *kdtree_search.split_space(x, 0)) == 0).all()


def test_products_stay_exact():
    big = np.array([[2**40, -(2**41)]])
    assert kdtree_search.product(big, big)[0, 0] == 2**63 - 1 and kdtree_search.product(big, -big)[0, 0] == -(2**63)
    assert kdtree_search.product(big, np.array([[2**20 + 1, -3]]))[0, 0] == 2**40 * (2**20 + 1) + 3 * 2**41


# ---- 9 ----
def brute_repeats(texts, window):
    words = {i: (t or "").encode().split() for i, t in texts.items()}
    first = {}
    for i in sorted(words):
        for p in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][p : p + window]), i)
    out = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] < i:
                gone[p : p + window] = [True] * window
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out[i] = (len(w), sum(gone), sha256(b" ".join(kept)).hexdigest(), kept)
    return out


@pytest.mark.parametrize("window, fan", [(13, 12), (3, 3)])  # with 3 bits a shuffle, windows are dealt twice
def test_substring_dedup(docs, window, fan):
    got = substring_dedup.remove_repeated(docs, window, with_text=True, fan=fan).collect()
    want = brute_repeats(plain(docs), window)
    assert len(got) == docs.count()
    texts = plain(docs)
    for r in got:
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == want[r["doc_id"]][:3], r["doc_id"]
        assert r["text"].encode().split() == want[r["doc_id"]][3]
        if not r["n_removed"]:
            assert r["text"] == (texts[r["doc_id"]] or "")
        assert r["rest"]["component_id"] == "x" and r["rest"]["h"] == 7
    assert any(r["n_removed"] for r in got)


def test_substring_dedup_edges(spark, no_docs):
    t = " ".join(f"w{i}" for i in range(20))
    df = spark.createDataFrame([(-5, t), (2**40, t), (None, t), (7, "a b")], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["n_removed"]) for r in substring_dedup.remove_repeated(df).collect())
    assert got == sorted([("-5", 0), (str(2**40), 20), ("None", 0), ("7", 0)])
    assert substring_dedup.remove_repeated(no_docs).collect() == []


def test_settle_matches_brute_force():
    rng = np.random.default_rng(0)
    h, doc, at = rng.integers(0, 30, 200).astype(np.uint64), rng.integers(0, 20, 200), rng.integers(0, 50, 200)
    keep, hits, (owner, place, grp) = substring_dedup.settle(h, doc, at, 16)
    low = {x: doc[h == x].min() for x in np.unique(h)}
    assert (keep == [doc[i] == low[h[i]] for i in range(200)]).all()
    assert set(hits.tolist()) == {int(doc[i]) for i in range(200) if doc[i] != low[h[i]]}
    assert len(owner) == (~keep).sum() and len(place) == len(grp)
    got = {(o, p, g) for o, b, g, m in zip(*(x.tolist() for x in substring_dedup.needs(owner, place, grp)), strict=True) for p in substring_dedup.places_of(b, m)}
    assert got == set(zip(owner.tolist(), place.tolist(), grp.tolist(), strict=True))


def test_packed_windows_come_back():
    rng = np.random.default_rng(1)
    h, doc, at = rng.integers(0, 2**63, 500, np.uint64), np.sort(rng.integers(-9, 2**40, 500)), rng.integers(0, 2**20, 500)
    rows = substring_dedup._pack((h >> np.uint64(60)).astype(np.int32), h, doc, at)
    back = [substring_dedup._unpack(*r) for r in zip(rows["n"], rows["docs"], rows["at"], rows["h"], strict=True)]
    want = sorted(zip((h & np.uint64(2**48 - 1)).tolist(), doc.tolist(), at.tolist(), strict=True))
    assert sorted(zip(*(np.concatenate(x).tolist() for x in zip(*back, strict=True)), strict=True)) == want


def test_automata_in_several_parts():
    rng = np.random.default_rng(2)
    words = [b"%d" % x for x in rng.integers(0, 6, 300)]
    passages = [(i % 7, 64 * i, list(range(64 * i, 64 * i + 60)), words[4 * i : 4 * i + 64]) for i in range(20)]
    text = [b"%d" % x for x in rng.integers(0, 6, 400)]
    want = np.zeros(400, bool)
    low = {}
    for doc, _, places, w in passages:
        for j in range(len(places)):
            if len(k := tuple(w[j : j + 5])) == 5:
                low[k] = min(doc, low.get(k, doc))
    for p in range(396):
        if low.get(tuple(text[p : p + 5]), 9) < 3:
            want[p : p + 5] = True
    for most in (10, 60_000):
        automata = substring_dedup.build_automata(passages, 5, most)
        assert (len(automata) > 5) == (most == 10)
        assert (substring_dedup.covered(text, 3, automata, 5) == want).all()
