from __future__ import annotations

import io
import itertools
import json
import random
import types

import pytest
from pyspark.sql import functions as F

from cardloom import cli
from cardloom.config import DEDUPE, NORMALIZE, DedupeConfig, EmailConfig, NameConfig
from cardloom.functions.similarity import jaro_winkler_bytes
from cardloom.operators import resolve
from cardloom.operators.components import connected_components
from cardloom.operators.normalize import normalize_contacts, normalize_records
from cardloom.operators.resolve import BLOCKS, candidate_pairs, clusters, needed_blocks, score_pairs, with_keys
from cardloom.plans.pipelines import convert, deduplicate, normalize_and_convert, union_sources
from cardloom.schema import conform
from cardloom.sources import sinks
from cardloom.sources.csv import ends_quoted, read_contacts_csv, read_rows, records
from cardloom.sources.vcf import parse_vcf, read_vcf
from cardloom.streaming.contacts import normalize_stream

DUPLICATES = """name,phone,email,org
Priya Nair,+91-98200-11223,priya@nair.example,Nair Studio
Mara Quill,+1-303-555-0142,mara.quill@lumen.example,Lumen Works
Tomas Reyes,+34-600-123-456,tomas@reyes.example,Reyes SL
Mara Quill,+1-303-555-0142,mara.quill@lumen.example,Lumen Works
Olaf Berg,+47-22-33-44-55,olaf@berg.example,Berg AS
Mara Quill,+1-303-555-0142,mquill@lumen.example,Lumen Works
Tomas Reyes,+34-600-123-456,treyes@reyes.example,Reyes SL
Ines Costa,+351-21-000-1111,ines@costa.example,Costa Lda
"""


def put(tmp_path, text, name="in.csv"):
    p = tmp_path / name
    p.write_bytes(text.encode())
    return str(p)


def rows(df, *cols):
    return [tuple(r) for r in df.orderBy("idx").select(*cols).collect()]


def make(spark, *people):
    """Contacts of (name, phones, emails, org)."""
    data = [(i, n, p, e, o) for i, (n, p, e, o) in enumerate(people)]
    return conform(spark.createDataFrame(data, "idx long, name string, phones array<string>, emails array<string>, organization string"))


def test_records():
    assert list(records('a,b\n\n x , "y ""z"" ",\n')) == [["a", "b"], ["x ", 'y "z" ', ""]]
    assert list(records('Alice,"123\nBob,456\n')) == [["Alice", "123\nBob,456\n"]]
    assert list(records('"1"2,3\r\nq')) == [['1"2,3\nq']]
    assert list(records('a"b,c')) == [['a"b', "c"]]
    assert list(records("﻿a\n")) == [["a"]]
    assert list(records("")) == []


def test_csv_rows_and_errors(spark, tmp_path):
    p = put(tmp_path, "name,phone,email,org\nAda,1,a@b.co,X\nBob,,\n,,\nCy,2\n,,,\n,,e@f.gh,\n,,,OnlyOrg\n")
    r = read_contacts_csv(spark, p)
    assert rows(r.contacts, "idx", "source.row", "name") == [(0, 2, "Ada"), (1, 3, "Bob"), (2, 5, "Cy"), (3, 7, ""), (4, 8, "")]
    assert sorted(tuple(x) for x in r.errors.select("row", "field").collect()) == [(4, "row"), (6, "row")]
    assert rows(read_contacts_csv(spark, p, DEDUPE).contacts, "source.row") == [(2,), (3,), (5,), (7,)]


def test_csv_fast_path_agrees(spark, tmp_path):
    p = put(tmp_path, DUPLICATES)
    a, b = read_contacts_csv(spark, p).contacts, read_contacts_csv(spark, p, exact=False).contacts
    assert rows(a, "idx", "source.row", "name", "phones", "emails", "organization") == rows(b, "idx", "source.row", "name", "phones", "emails", "organization")


def test_csv_name_policy(spark, tmp_path):
    p = put(tmp_path, "First Name,Last Name,Mobile Phone,E-mail Address,Company\nAda,Lovelace,1,x@y.zz,Engines\n")
    assert rows(read_contacts_csv(spark, p).contacts, "name", "phones", "organization") == [("Ada", [], "Engines")]
    assert rows(read_contacts_csv(spark, p, NORMALIZE).contacts, "name") == [("Lovelace",)]


def test_csv_without_header(spark, tmp_path):
    with pytest.raises(ValueError, match="reading CSV headers"):
        read_contacts_csv(spark, put(tmp_path, ""))


def test_dedupe_sample(spark, tmp_path):
    r = deduplicate(read_contacts_csv(spark, put(tmp_path, DUPLICATES), DEDUPE).contacts)
    assert rows(r.clusters, "cluster_id") == [(0,), (1,), (2,), (1,), (4,), (1,), (2,), (7,)]
    assert tuple(r.report.first()) == (8, 3, 5)
    assert rows(r.merged, "name", "phones", "emails", "confidence", "source.row", "merge_reason") == [
        ("Mara Quill", ["+1-303-555-0142"], ["mara.quill@lumen.example", "mquill@lumen.example"], 0.75, 3, ["merged_duplicate_cluster"]),
        ("Tomas Reyes", ["+34-600-123-456"], ["tomas@reyes.example", "treyes@reyes.example"], 0.67, 4, ["merged_duplicate_cluster"]),
    ]
    assert rows(r.resolved, "idx") == [(0,), (1,), (2,), (4,), (7,)]


TRUTH = [
    (("", [], ["a@x.yz"], ""), ("", [], ["A+t@x.yz"], ""), 0.40, False),
    (("", [], ["a@x.yz"], "Acme"), ("", [], ["a@x.yz"], "acme "), 0.45, False),
    (("alice", [], ["a@x.yz"], ""), ("alice smith", [], ["a@x.yz"], ""), 0.40 + 0.2 * 0.890909, True),
    (("", ["1234567890"], [], ""), ("", ["(123) 456-7890"], [], ""), 0.35, False),
    (("", ["123"], ["a@x.yz"], ""), ("", ["0123"], ["a@x.yz"], ""), 0.75, True),
    (("bob", [], [], "Acme"), ("bob", [], [], "Acme"), 0.25, False),
    (("abcxyz", ["1"], [], ""), ("abcpqrstuv", ["1"], [], ""), 0.35 + 0.2 * 0.72, False),
]


@pytest.mark.parametrize("a, b, score, linked", TRUTH)
def test_scores(spark, a, b, score, linked):
    c = make(spark, a, b)
    got = score_pairs(spark.createDataFrame([(0, 1)], "a long, b long"), with_keys(c)).first()["score"]
    assert got == pytest.approx(score, abs=1e-6)
    assert (got >= DedupeConfig().threshold) is linked


def test_linked_clusters(spark):
    people = [p for a, b, _, _ in TRUTH for p in (a, b)]
    tag = lambda k, p: (p[0], [f"{x}{k}" for x in p[1]], [f"{k}{x}" for x in p[2]], p[3] and f"{p[3].strip()}{k}")
    c = make(spark, *(tag(i // 2 + 1, p) for i, p in enumerate(people)))
    got = rows(clusters(c), "cluster_id")
    assert [got[2 * i] == got[2 * i + 1] for i in range(len(TRUTH))] == [t[3] for t in TRUTH]


def test_pruned_blocks_change_nothing(spark):
    people = [(f"ann lee{i % 3}", [f"55501{i % 4}"], [f"u{i % 5}@x.yz"] if i % 2 else [], "Org" if i % 3 else "") for i in range(24)]
    c = make(spark, *people)
    for cfg in (DedupeConfig(), DedupeConfig(threshold=0.2), DedupeConfig(email_weight=0.1)):
        keyed = with_keys(c)
        scored = score_pairs(candidate_pairs(keyed), keyed, cfg).where(F.col("score") >= cfg.threshold)
        want = {r["node"]: r["component_id"] for r in connected_components(scored.select("a", "b")).collect()}
        assert {r["idx"]: r["cluster_id"] for r in clusters(c, cfg).collect()} == {i: want.get(i, i) for i in range(24)}, cfg


def test_needed_blocks():
    assert needed_blocks(DedupeConfig()) == ("email", "phone")
    assert needed_blocks(DedupeConfig(threshold=0.2)) == needed_blocks(DedupeConfig(threshold=0)) == needed_blocks(DedupeConfig(org_weight=-1)) == BLOCKS
    assert needed_blocks(DedupeConfig(threshold=1.5)) == () and needed_blocks(DedupeConfig(email_weight=0.1)) == ("phone",)


def test_buckets_of_several_keys(spark):
    """A key is in the same bucket wherever it stands among a contact's keys."""
    keyed = with_keys(make(spark, ("", ["111", "222"], ["a@x.yz"], ""), ("", ["222"], [], ""), ("", [], ["0@x.yz", "a@x.yz"], "")))
    assert sorted(map(tuple, candidate_pairs(keyed).collect())) == [(0, 1), (0, 2)]
    assert {r["block"] for r in resolve.block_keys(keyed).collect()} == {"email", "phone"}


def test_components(spark):
    import random

    rng = random.Random(4)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)] + [(5, 5), (None, 3)]
    parent = list(range(400))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    got = {r["node"]: r["component_id"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in edges if a is not None and a != b for x in (a, b)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_merge_drops_values_without_keys(spark):
    c = make(spark, ("", ["abc", "123"], ["none", "a@x.yz"], ""), ("Ann", ["0123", "9"], ["A+1@x.yz"], "Org"))
    r = deduplicate(c)
    assert rows(r.merged, "name", "phones", "emails", "organization") == [("Ann", ["123", "9"], ["a@x.yz"], "Org")]


def test_empty_contacts(spark):
    none = conform(spark.createDataFrame([], "idx long, name string"))
    r = deduplicate(none)
    assert tuple(r.report.first()) == (0, 0, 0) and r.resolved.collect() == []


def test_vcf(spark, tmp_path):
    text = "junk\r\nBEGIN:VCARD\r\nVERSION:3.0\r\nFN:Ann\r\n \tLee\r\nTEL;TYPE=cell:tel:+1 2\r\nTEL:\r\nEMAIL:a\\,b@x.yz\r\nORG:Acme\\;Co\r\nend:vcard\r\nBEGIN:VCARD\r\nTEL:\r\nEND:VCARD\r\nBEGIN:VCARD\nN:Doe;Jo;;Dr;\nitem1.TEL:5\nORG:\nORG:Second\n"
    r = read_vcf(spark, put(tmp_path, text, "a.vcf"))
    assert rows(r.contacts, "idx", "name", "phones", "emails", "organization") == [(0, "AnnLee", ["+1 2"], ["a,b@x.yz"], "Acme;Co"), (1, "Dr Jo Doe", [], [], "Second")]
    assert sorted(tuple(x) for x in r.errors.collect()) == [(1, "TEL", "empty tel value"), (2, "TEL", "empty tel value")]
    assert parse_vcf(spark.createDataFrame([(0, "")], "file_ord long, value string")).contacts.collect() == []


def test_vcard_round_trip(spark):
    c = make(spark, ("Ann; Lee, Jr", ["+14155550199", "555-0100", "none"], ["U+t@X.yz", "bad,"], "A;B"), ("", ["(415) 555-0199"], [], ""))
    text = "".join(r[0] for r in sinks.vcards(c).orderBy("idx").select("vcard").collect())
    assert text.startswith("BEGIN:VCARD\r\nVERSION:4.0\r\nPRODID:-//cardloom//EN\r\nFN:Ann\\; Lee\\, Jr\r\nN:Jr;Ann\\;;Lee\\,;;\r\nORG:A\\;B\r\nTEL;VALUE=uri:tel:+14155550199\r\nTEL;VALUE=uri:tel:+5550100\r\nTEL:none\r\nEMAIL:u@x.yz\r\nEMAIL:bad\\,\r\nEND:VCARD\r\n")
    assert "FN:Unknown\r\nN:;;;;\r\nTEL;VALUE=uri:tel:+4155550199\r\n" in text
    back = parse_vcf(spark.createDataFrame([(0, text)], "file_ord long, value string")).contacts
    assert rows(back, "name", "organization") == [("Ann; Lee, Jr", "A;B"), ("Unknown", "")]


def test_normalize_contacts(spark):
    c = make(spark, (" Ann Lee Inc. ", ["+1 415 555 0199", " 12 ", " "], ["A@B.co", " bad "], ""), ("", [], [], "Org"))
    cfg = NameConfig(True, ("Inc.",))
    assert rows(normalize_contacts(c, cfg), "name", "phones", "emails", "organization") == [("Ann Lee", ["+14155550199", "12"], ["a@b.co", "bad"], "Inc."), ("", [], [], "Org")]
    assert rows(normalize_contacts(c, cfg, email=EmailConfig(strict=True)), "emails") == [(["a@b.co", "bad"],), ([],)]
    assert rows(normalize_records(c), "name", "phones", "emails", "org")[1] == ("", [], [], "Org")


def test_conversions(spark, tmp_path):
    parsed = read_contacts_csv(spark, put(tmp_path, DUPLICATES))
    assert tuple(convert(parsed, True).summary.first()) == (8, 5, 3, 0, True)
    assert tuple(convert(parsed).summary.first()) == (8, 8, 0, 0, False)
    assert normalize_and_convert(parsed, dedupe=True).contacts.count() == 5


def test_union_sources(spark):
    a = make(spark, ("A", [], [], ""), ("B", [], [], ""))
    assert rows(union_sources(a, a, a), "idx") == [(i,) for i in range(6)]


def test_csv_cells(spark):
    c = make(spark, ('say "hi"', ["1", "2"], [], " lead"), ("\\.", [], [], "a,b"))
    assert rows(sinks.csv_lines(c), "line") == [('"say ""hi""",1; 2,," lead"',), ('"\\.",,,"a,b"',)]


def test_cli(spark, tmp_path, capsys):
    src = put(tmp_path, DUPLICATES)
    assert cli.main(["dedupe", src], spark) == 0
    assert capsys.readouterr().out.splitlines()[2] == "Mara Quill,+1-303-555-0142,mara.quill@lumen.example; mquill@lumen.example,Lumen Works"
    assert cli.main(["dedupe", src, "--json"], spark) == 0
    doc = json.loads(capsys.readouterr().out)
    assert doc["report"] == {"TotalInput": 8, "DuplicatesFound": 3, "ClustersFormed": 5} and [len(c) for c in doc["clusters"]] == [3, 2] and doc["clusters"][0][0]["source"] == ":3"
    assert cli.main(["dedupe", src, "--dry-run"], spark) == 0
    assert "Cluster 2 (3 contacts):\n  - Mara Quill | mara.quill@lumen.example | +1-303-555-0142" in capsys.readouterr().err
    out = tmp_path / "sub" / "o.vcf"
    assert cli.main(["-o", str(out), "-v", "convert", src, "-d"], spark) == 0
    assert out.read_bytes().count(b"BEGIN:VCARD\r\n") == 5 and "Duplicates removed:  3" in capsys.readouterr().err
    assert cli.main(["vcf-to-csv", str(out)], spark) == 0
    assert capsys.readouterr().out.count("\n") == 6
    assert cli.main(["normalize", src, "--json"], spark) == 0
    assert json.loads(capsys.readouterr().out)[0]["phones"] == ["+919820011223"]
    assert cli.main(["normalize", src, "--vcf", "-d"], spark) == 0
    assert capsys.readouterr().out.count("END:VCARD") == 5


def test_json_document():
    assert sinks.dumps({"a": "<&>"}) == '{\n  "a": "\\u003c\\u0026\\u003e"\n}'


def test_stream(spark, tmp_path):
    make(spark, ("Ann", ["+1 415 555 0199"], [], "")).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    q = normalize_stream(s).writeStream.format("memory").queryName("cleaned").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("cleaned").first()["phones"] == ["+14155550199"]


def test_sinks_write(spark, tmp_path):
    c = make(spark, ("Ann", ["1", "2"], [], ""), ("Bo", [], [], "Org"))
    sinks.write_vcf(c, str(tmp_path / "vcf"))
    assert rows(read_vcf(spark, str(tmp_path / "vcf")).contacts, "name") == [("Ann",), ("Bo",)]
    sinks.write_csv(c, str(tmp_path / "csv"))
    assert sorted(r["name"] for r in spark.read.csv(str(tmp_path / "csv"), header=True).collect()) == ["Ann", "Bo"]
    out = io.StringIO()
    sinks.stream_csv(c, out)
    assert out.getvalue() == "name,phone,email,org\nAnn,1; 2,,\nBo,,,Org\n"


@pytest.fixture
def small_splits(spark):
    """Files are cut every few bytes."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    spark.conf.set(names[0], "173")
    spark.conf.set(names[1], "0")
    yield
    for n, v in zip(names, before, strict=True):
        spark.conf.set(n, v)


def test_ends_quoted():
    rng = random.Random(1)
    for _ in range(3000):
        line = "".join(rng.choices('a," x', k=rng.randrange(9)))
        for quoted in (False, True):
            text = ('"' + line) if quoted else line
            last = list(records(text + "\n\x00end,\x00end"))
            assert ends_quoted(line, quoted) == (not last or last[-1][0] != "\x00end"), (line, quoted)


def test_csv_in_blocks(spark, tmp_path, small_splits):
    rng = random.Random(2)
    cell = lambda: rng.choice(["a", "", 'say "x"', '"q"', '"two\nlines, ""x"""', '"long\n' + "y" * 150 + '\n\n,z"', " lead", 'mid"dle', "é" * 9])
    want = []
    for name in ("a.csv", "b.csv"):
        text = "h1,h2\r\n" + "".join(",".join(cell() for _ in range(rng.randrange(1, 4))) + rng.choice(["\n", "\r\n", "\n\n"]) for _ in range(40))
        text += rng.choice(['"open,\nto the end\n' + "w" * 200, "last"])
        put(tmp_path, text, name)
        want += list(enumerate((r for r in records(text)), 1))[1:]
    first, rows_ = read_rows(spark, str(tmp_path))
    assert first == ["h1", "h2"]
    got = rows_.orderBy("ord").collect()
    assert [(r["row"], r["cells"]) for r in got] == want
    assert rows_.rdd.getNumPartitions() >= 1 and len({r["ord"] >> 33 for r in got}) > 8


def test_vcf_in_blocks(spark, tmp_path, small_splits):
    rng = random.Random(3)
    cards = ["BEGIN:VCARD", "FN:A{0}", "FN:Long\n  name {0}", "TEL:{0}", "TEL:", "EMAIL:x{0}@y.zz", "ORG:" + "o" * 90, "junk", "END:VCA\n RD", "NOTE:END:VCARD"]
    for name in ("a.vcf", "b.vcf"):
        text = "".join("\n".join(rng.sample(cards, rng.randrange(1, 6))).format(i) + rng.choice(["\nEND:VCARD\n", "\r\nend:vcard \r\n", "\nEND:VCARD\n  X\nEND:VCARD\n"]) for i in range(25))
        put(tmp_path, " " + text + "FN:Tail", name)
    texts = [(i, (tmp_path / n).read_bytes().decode()) for i, n in enumerate(("a.vcf", "b.vcf"))]
    want, got = parse_vcf(spark.createDataFrame(texts, "file_ord long, value string")), read_vcf(spark, str(tmp_path))
    cols = ("idx", "name", "phones", "emails", "organization")
    assert rows(got.contacts, *cols) == rows(want.contacts, *cols) and got.contacts.count() > 25
    assert sorted(map(tuple, got.errors.collect())) == sorted(map(tuple, want.errors.collect())) != []


def test_no_file_goes_through_one_task(spark, tmp_path):
    for i in range(3):
        put(tmp_path, DUPLICATES, f"{i}.csv")
    plan = read_contacts_csv(spark, str(tmp_path)).contacts._jdf.queryExecution().toString()
    lines = [x for x in plan.splitlines() if "SinglePartition" in x]
    assert not any("value" in x or "cells" in x for x in lines)


def test_hot_buckets_in_tiles(spark, monkeypatch):
    rng = random.Random(5)
    people = [(rng.choice(["ann lee", "ann leigh", "bob", "", "annabel lee"]) + str(i % 7), ["555010203040"] if i % 3 else [f"55501020{i:04}"], ["shared@x.yz"] if i % 5 == 0 else [f"u{i % 9}@x.yz"], rng.choice(["Org", "Org Inc", ""])) for i in range(90)]
    c = make(spark, *people)
    for cfg in (DedupeConfig(threshold=0.62), DedupeConfig(threshold=0.2)):
        want = {r["idx"]: r["cluster_id"] for r in clusters(c, cfg).collect()}
        with monkeypatch.context() as m:
            m.setattr(resolve, "PAIRED", 5)
            assert {r["idx"]: r["cluster_id"] for r in clusters(c, cfg).collect()} == want, cfg
        keyed = with_keys(c)
        scored = score_pairs(candidate_pairs(keyed), keyed, cfg).where(F.col("score") >= cfg.threshold)
        comp = {r["node"]: r["component_id"] for r in connected_components(scored.select("a", "b")).collect()}
        assert want == {i: comp.get(i, i) for i in range(90)}, cfg


def brute_clusters(keyed, cfg):
    """idx -> cluster_id by the definition: every pair that shares a bucket is scored."""
    root = {r["idx"]: r["idx"] for r in keyed}
    org = lambda x, y: 0.0 if not x or not y else 1.0 if x == y else 0.8 if x in y or y in x else 0.0
    for a, b in itertools.combinations(sorted(keyed, key=lambda r: r["idx"]), 2):
        x, y = a["name_key"].encode(), b["name_key"].encode()
        e, p = (float(bool(set(a[c]) & set(b[c]))) for c in ("email_keys", "phone_keys"))
        s, o = jaro_winkler_bytes(x, y) if x and y else 0.0, org(a["org_key"], b["org_key"])
        if e or p or o == 1 or (x and x[:6] == y[:6]):
            name = s * cfg.name_weight if s > cfg.min_name_similarity else 0.0
            if cfg.email_weight * e + cfg.phone_weight * p + name + cfg.org_weight * o >= cfg.threshold:
                i, j = sorted((root[a["idx"]], root[b["idx"]]))
                root = {k: i if v == j else v for k, v in root.items()}
    return root


#: Weights of email, phone, name and organization, threshold and gate; each case links by other sets of keys, equal or like parts.
LINKS = [
    (0.4, 0.35, 0.2, 0.05, 0.25, 0.6),
    (0.4, 0.35, 0.2, 0.05, 0.0, 0.6),
    (0.4, 0.35, 0.2, 0.05, 0.05, 0.6),
    (0.4, 0.35, 0.2, 0.05, 0.24, 0.6),
    (0.1, 0.1, 0.2, 0.0, 0.2, 0.6),
    (0.3, 0.3, 0.2, 0.05, 0.6, 0.6),
    (0.3, 0.3, 0.2, 0.1, 0.8, 0.6),
    (0.3, 0.3, 0.2, 0.05, 0.84, 0.6),
    (0.4, 0.35, 0.2, 0.05, 0.04, 1.0),
    (0.4, 0.35, 0.2, -0.05, 0.3, 0.6),
]


def crowd(spark, seed, n=70):
    rng = random.Random(seed)
    names = ["ann lee", "Ann Lee", "ann leigh", "annabel lee", "bob ray", "bob rays", "", "", "x", "zoë k", "zoe k"]
    some = lambda make, top: [make(rng.randrange(top)) for _ in range(rng.choice([0, 0, 1, 1, 2]))]
    return make(spark, *((rng.choice(names) + rng.choice(["", "", " 1", " 12"]), some(lambda i: f"55501020{i:04}", 40), some(lambda i: f"u{i}@x.yz", 40), rng.choice(["Org", "Org Inc", "org inc ltd", "Zed", "", ""])) for _ in range(n)))


@pytest.mark.parametrize("weights", LINKS)
def test_links_by_the_definition(spark, monkeypatch, weights):
    cfg = DedupeConfig(*weights)
    monkeypatch.setattr(resolve, "PAIRED", 6)
    c = crowd(spark, str(weights))
    assert {r["idx"]: r["cluster_id"] for r in clusters(c, cfg).collect()} == brute_clusters(with_keys(c).collect(), cfg)


def test_no_pairs_where_equal_keys_decide(spark, monkeypatch):
    """At 0.25 an equal email, phone, or name with organization links, and nothing else does: no pair is scored."""

    def fail(*_, **__):
        raise AssertionError("pairs are scored")

    c, cfg = crowd(spark, 1), DedupeConfig(threshold=0.25)
    want = brute_clusters(with_keys(c).collect(), cfg)
    for f in ("score_pairs", "_scored", "_block_links"):
        monkeypatch.setattr(resolve, f, fail, raising=False)
    assert {r["idx"]: r["cluster_id"] for r in clusters(c, cfg).collect()} == want and 1 < len(set(want.values())) < len(want)


def test_spool_reads_standard_input(spark, monkeypatch, capsys):
    monkeypatch.setattr("sys.stdin", types.SimpleNamespace(buffer=io.BytesIO(DUPLICATES.encode())))
    assert cli.main(["normalize"], spark) == 0
    assert capsys.readouterr().out.count("\n") == 9


def test_shared_folder_is_asked_for():
    from cardloom.storage import shared_dir

    sc = types.SimpleNamespace(getCheckpointDir=lambda: None, master="spark://x:7077")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(types.SimpleNamespace(conf=types.SimpleNamespace(get=lambda *_: None), sparkContext=sc))
