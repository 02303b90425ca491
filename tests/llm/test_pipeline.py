from __future__ import annotations

import random

import pytest

import corpus_pipeline
from cardloom.llm import minhash_dedup, queries
from cardloom.llm.common import save
from tests.llm.test_operators import brute_repeats, closure, plain, shingle_set


@pytest.fixture(scope="module")
def stages(spark):
    """Each stage's rows over the smallest tables."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        docs = save(stage(spark, docs, sf))
        out.append(docs)
    return out


def test_columns(stages):
    assert all(d.dtypes == stages[0].dtypes for d in stages[1:-1])


def test_filters_keep_rows_as_they_are(stages):
    for before, after in zip(stages[:3], stages[1:4], strict=True):
        assert after.exceptAll(before).isEmpty()
        assert after.count() > 0.5 * before.count()


def test_language_stage_rejects_wrong_claims_of_any_length(spark):
    """Planted: texts cut to 200-2,000 characters under a wrong language, and half-and-half ones under either."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rng = random.Random(3)
    whole = {x: [] for x in ("de", "en", "es", "fr")}
    for r in docs.orderBy("doc_id").collect():
        if r["lang"] in whole and len(set((r["text"] or "").split())) > 400:
            whole[r["lang"]].append(r["text"])

    def cut(lang, n):
        t = rng.choice([t for t in whole[lang] if len(t) > n])
        at = rng.randrange(len(t) - n)
        return t[at : at + n]

    wrong, right, mixed = [], [], []
    for i in range(120):
        a, b = rng.sample(sorted(whole), 2)
        n = (200, 300, 500, 1000, 2000)[i % 5]
        wrong.append((cut(a, n), b))
        right.append((cut(a, n), a))
        mixed.append((cut(a, n // 2) + " " + cut(b, n // 2), (a, b)[i % 2]))
    rows = [(1_000_000 + i, t, lang, "planted", len(t)) for i, (t, lang) in enumerate([*wrong, *right, *mixed, (wrong[0][0], None)])]
    out = corpus_pipeline.check_language(spark, docs.unionByName(spark.createDataFrame(rows, docs.schema)), "")
    kept = {r["doc_id"] for r in out.select("doc_id").collect()}
    n_kept = [sum(1_000_000 + 120 * k + i in kept for i in range(120)) for k in range(3)]
    assert n_kept[0] <= 6 and n_kept[1] == 120 and n_kept[2] >= 119
    assert 1_000_360 in kept  # claims nothing
    assert len([i for i in kept if i < 1_000_000]) >= 0.99 * docs.count()


def test_near_copies_share_a_band(spark, stages, monkeypatch):
    """The stage's bands, counted as it makes them, leave out a link at its threshold less than once in a million."""
    seen = []
    real = minhash_dedup.sketch
    monkeypatch.setattr(minhash_dedup, "sketch", lambda docs, k, hashes, rows: seen.append((hashes, rows)) or real(docs, k, hashes, rows))
    corpus_pipeline.drop_near_copies(spark, stages[2].limit(20), "")
    hashes, rows = seen[0]
    assert {len(r["bands"]) for r in real(stages[2].limit(20), 5, hashes, rows).where("n_shingles > 0").collect()} == {hashes // rows}
    assert (1 - 0.8**rows) ** (hashes // rows) < 1e-6


def test_near_copies(stages):
    sets = {i: shingle_set(t) for i, t in plain(stages[2]).items()}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    comp = closure(sets, links)
    assert {r["doc_id"] for r in stages[3].collect()} == {i for i in sets if comp[i] == i}


def test_repeats(stages):
    want = brute_repeats(plain(stages[3]), 13)
    got = {r["doc_id"]: r for r in stages[4].collect()}
    assert set(got) == {i for i, w in want.items() if w[3]}
    assert all(r["text"].encode().split() == want[i][3] and r["n_chars"] == len(r["text"]) for i, r in got.items())


def test_sequences_hold_every_document(stages):
    rows = stages[5].collect()
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in stages[4].collect()}
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows)


def test_empty_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = save(stage(spark, docs, "/root/testdata/sf0.001"))
        assert docs.count() == 0
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(docs.columns)


def test_rows_without_ids_texts_or_languages(spark):
    """Two rows without doc_id and one each without text, language or letters pass all stages that have no reason to reject them."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    good = docs.where("lang = 'en' and length(text) between 600 and 5000").orderBy("doc_id").limit(3).collect()
    rows = [(None, good[0]["text"], "en", "s", 5), (None, good[1]["text"], None, None, None), (900_001, None, "en", "s", 0), (900_002, good[2]["text"], None, "s", 5), (900_003, "12 34", "en", "s", 5)]
    docs = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    counts = []
    for name, stage in corpus_pipeline.STAGES:
        docs = save(stage(spark, docs, "/root/testdata/sf0.001"))
        counts.append((name, docs.where("doc_id is null").count(), docs.where("doc_id > 900000").count()))
    assert [c[1] for c in counts[:4]] == [2] * 4 and counts[4][1] >= 2
    assert counts[1][2] <= 2  # neither a text without letters nor one without any is in a language


def test_registered():
    names = [n.split("_")[0] for n in queries.QUERIES]
    assert sorted(names, key=lambda n: int(n[2:])) == [f"op{i}" for i in range(1, 11)]
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)
