"""Finding duplicates: block keys, candidate pairs, scores, clusters."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardloom.config import DedupeConfig
from cardloom.functions.email import email_key
from cardloom.functions.name import name_block, name_key
from cardloom.functions.phone import phone_digits
from cardloom.functions.similarity import jaro_winkler_many, name_similarity, org_key, org_match
from cardloom.operators.components import connected_components, spanning_links
from cardloom.storage import save

BLOCKS = ("email", "phone", "org", "name")
FORMS = ("email_keys", "phone_keys", "name_key", "org_key")
PAIRED = 256  # members up to which a bucket's pairs are listed; larger buckets are compared in tiles of about so many


def with_keys(contacts: DataFrame) -> DataFrame:
    """idx and the comparable forms: email_keys, phone_keys (distinct, sorted, no empty ones), name_key, org_key."""
    keys = lambda c, f: F.array_sort(F.array_distinct(F.filter(F.transform(F.col(c), f), lambda x: x != "")))
    return contacts.select("idx", keys("emails", email_key).alias("email_keys"), keys("phones", phone_digits).alias("phone_keys"), name_key(F.col("name")).alias("name_key"), org_key(F.col("organization")).alias("org_key"))


def block_keys(keyed: DataFrame, blocks: tuple[str, ...] = BLOCKS) -> DataFrame:
    """(block, key, idx): one row for each bucket a contact is in."""
    one = lambda c: F.when(c != "", F.array(c)).otherwise(F.array().cast("array<string>"))
    keys = {"email": F.col("email_keys"), "phone": F.col("phone_keys"), "org": one(F.col("org_key")), "name": one(name_block(F.col("name_key")))}
    tag = lambda b: lambda k: F.struct(F.lit(b).alias("block"), k.alias("key"))  # noqa: E731  (F.transform gives a second parameter the index)
    tagged = [F.transform(keys[b], tag(b)) for b in blocks]
    return keyed.select("idx", F.explode(F.concat(*tagged)).alias("k")).select("k.block", "k.key", "idx")


def needed_blocks(cfg: DedupeConfig) -> tuple[str, ...]:
    """Blocks without which a linked pair could be missed.

    A pair that shares neither email nor phone scores at most name + org; if that is below the threshold the
    org and name blocks find nothing. With them left out, a block of emails or phones is not needed either if
    no pair can reach the threshold without the other. Nothing is left out with negative weights or thresholds <= 0.
    """
    e, p, n, o, t = cfg.email_weight, cfg.phone_weight, cfg.name_weight, cfg.org_weight, cfg.threshold
    if min(e, p, n, o) < 0 or t <= 0 or n + o >= t:
        return BLOCKS
    if e + p + n + o < t:
        return ()
    if e + n + o < t:  # a linked pair shares a phone
        return ("phone",)
    if p + n + o < t:
        return ("email",)
    return ("email", "phone")


def candidate_pairs(keyed: DataFrame, blocks: tuple[str, ...] = BLOCKS) -> DataFrame:
    """(a, b), a < b: pairs that share a bucket, each once. Their number grows with the square of a bucket's size."""
    return _pairs(block_keys(keyed, blocks))


def _pairs(k: DataFrame) -> DataFrame:
    other = k.withColumnRenamed("idx", "b")
    return k.withColumnRenamed("idx", "a").join(other, ["block", "key"]).where("a < b").select("a", "b").distinct()


def _overlap(x: str, y: str) -> Column:
    return F.arrays_overlap(x, y).cast("double")


def score_pairs(pairs: DataFrame, keyed: DataFrame, cfg: DedupeConfig = DedupeConfig(), only_linked: bool = False) -> DataFrame:
    """(a, b, score): weighted email, phone, name and organization, added in this order.

    Names count if they are more alike than the gate. only_linked: pairs whose exact parts and a perfect name stay
    below the threshold leave before names are compared, and only scores that reach it are returned.
    """
    return _scored(pairs.select("a", "b").join(_side(keyed, "a"), "a").join(_side(keyed, "b"), "b"), cfg, only_linked)


def _side(rows: DataFrame, n: str, *by: str) -> DataFrame:
    return rows.select(*by, F.col("idx").alias(n), *(F.col(c).alias(f"{c}_{n}") for c in FORMS))


def _scored(p: DataFrame, cfg: DedupeConfig, only_linked: bool) -> DataFrame:
    """``score_pairs`` of pairs that come with the comparable forms of both sides."""
    email = F.lit(cfg.email_weight) * _overlap("email_keys_a", "email_keys_b")
    phone = F.lit(cfg.phone_weight) * _overlap("phone_keys_a", "phone_keys_b")
    org = F.lit(cfg.org_weight) * org_match(F.col("org_key_a"), F.col("org_key_b"))
    p = p.select("a", "b", "name_key_a", "name_key_b", email.alias("e"), phone.alias("p"), org.alias("o"))
    if only_linked and cfg.name_weight >= 0:
        p = p.where(F.col("e") + F.col("p") + F.col("o") + cfg.name_weight >= cfg.threshold - 1e-9)
    sim = name_similarity(F.col("name_key_a"), F.col("name_key_b"))
    p = p.withColumn("s", sim)
    name = F.when(F.col("s") > cfg.min_name_similarity, F.col("s") * F.lit(cfg.name_weight)).otherwise(F.lit(0.0))
    scored = p.select("a", "b", (F.col("e") + F.col("p") + name + F.col("o")).alias("score"))
    return scored.where(F.col("score") >= cfg.threshold) if only_linked else scored


def linked_pairs(keyed: DataFrame, cfg: DedupeConfig = DedupeConfig()) -> DataFrame:
    """(a, b, score) of all pairs that share a bucket and reach the threshold."""
    blocks = needed_blocks(cfg)
    if not blocks:
        return keyed.sparkSession.createDataFrame([], "a long, b long, score double")
    return score_pairs(candidate_pairs(keyed, blocks), keyed, cfg, only_linked=True)


def _org_matches(orgs: list[str]) -> np.ndarray:
    """``org_match`` of all pairs."""
    names, code = np.unique(orgs, return_inverse=True)
    one = lambda x, y: 0.0 if not x or not y else 1.0 if x == y else 0.8 if x in y or y in x else 0.0
    return np.array([[one(x, y) for y in names] for x in names])[code][:, code]


def _shared(lists: list[list[str]]) -> np.ndarray:
    """Whether two rows have a key in common."""
    keys: dict[str, int] = {}
    at = [(i, keys.setdefault(k, len(keys))) for i, x in enumerate(lists) for k in x]
    m = np.zeros((len(lists), max(1, len(keys))), np.float32)
    if at:
        m[tuple(np.array(at).T)] = 1
    return m @ m.T > 0


def _block_links(t: pa.Table, cfg: DedupeConfig) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of a block that reach the threshold: the scores of ``score_pairs``."""
    name, rows = t.column("name_key").to_pylist(), t.num_rows
    e, p = (w * _shared(t.column(c).to_pylist()) for w, c in ((cfg.email_weight, "email_keys"), (cfg.phone_weight, "phone_keys")))
    o = cfg.org_weight * _org_matches(t.column("org_key").to_pylist())
    able = np.triu(np.ones((rows, rows), bool), 1)
    if cfg.name_weight >= 0:
        able &= e + p + o + cfg.name_weight >= cfg.threshold - 1e-9
    i, j = np.nonzero(able)
    names, code = np.unique(name, return_inverse=True)
    raw = [x.encode() for x in names]
    pairs, which = np.unique(code[i] * len(raw) + code[j], return_inverse=True)
    sim = np.zeros(len(pairs))
    for s in range(0, len(pairs), 4096):
        x, y = np.divmod(pairs[s : s + 4096], max(1, len(raw)))
        some = np.flatnonzero((x != (code[name.index("")] if "" in name else -1)) & (y != (code[name.index("")] if "" in name else -1)))
        sim[s + some] = jaro_winkler_many([raw[k] for k in x[some]], [raw[k] for k in y[some]])
    sim = sim[which]
    score = e[i, j] + p[i, j] + np.where(sim > cfg.min_name_similarity, sim * cfg.name_weight, 0.0) + o[i, j]
    ok = score >= cfg.threshold
    return i[ok], j[ok]


def _compared(rows: DataFrame, by: list[str], cfg: DedupeConfig) -> DataFrame:
    """(a, b): links that connect what the pairs of a bucket (``by``) of ``rows`` (by, idx, comparable forms) that reach the threshold connect.

    Pairs of buckets of up to PAIRED members are listed and scored. A larger bucket is dealt by hash to tiles, and each pair of
    tiles is a block of at most about two tiles that scores its pairs inside; what leaves it is one link a row at most.
    """
    size = rows.groupBy(*by).agg(F.count("*").alias("n")).where("n > 1")
    few = rows.join(size.where(F.col("n") <= PAIRED).select(*by), by, "left_semi")
    listed = _scored(_side(few, "a", *by).join(_side(few, "b", *by), by).where("a < b"), cfg, True).select("a", "b")
    many = rows.join(size.where(F.col("n") > PAIRED), by).withColumn("tiles", F.ceil(F.col("n") / PAIRED))
    many = many.withColumn("t", F.pmod(F.xxhash64("idx"), F.col("tiles"))).withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    many = many.select(*by, F.least("t", "o").alias("lo"), F.greatest("t", "o").alias("hi"), "idx", *FORMS)

    def run(_: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by("idx")
        ids = t.column("idx").to_numpy()
        a, b = spanning_links(*_block_links(t, cfg), len(ids))
        return pa.table({"a": pa.array(ids[a]), "b": pa.array(ids[b])})

    return listed.unionAll(many.groupBy(*by, "lo", "hi").applyInArrow(run, "a long, b long"))


def _stars(rows: DataFrame, by: list[str]) -> DataFrame:
    """(a, b): the members of each bucket, each with the smallest."""
    first = rows.groupBy(*by).agg(F.min("idx").alias("b"), F.count("*").alias("n")).where("n > 1").drop("n")
    return rows.join(first, by).where("idx <> b").select(F.col("idx").alias("a"), "b")


def _reach(base: float, org: float, cfg: DedupeConfig) -> str:
    """Of pairs with these parts of the score, those linked: "any", those of "like" names, only those of the "same" name, or "none".

    Names of up to L bytes that differ are alike by 1 - 0.2 / L at most, so 1 - 1e-9 lies above them all.
    """
    score = lambda s: base + (s * cfg.name_weight if s > cfg.min_name_similarity else 0.0) + org
    if base + 0.0 + org >= cfg.threshold:
        return "any"
    if score(1.0) < cfg.threshold:
        return "none"
    return "same" if score(1 - 1e-9) < cfg.threshold else "like"


def shared_sets(cfg: DedupeConfig) -> list[tuple[tuple[str, ...], float, tuple[str, str, str]]]:
    """Sets of keys that linked pairs share, their part of the score, and ``_reach`` with equal, partly equal and other organizations.

    A set is left out if it reaches nothing, or if one of its keys alone links all contacts that share it. Weights are 0 or more.
    """
    found: list[tuple[tuple[str, ...], float, tuple[str, str, str]]] = []
    for shared in ((), ("email",), ("phone",), ("email", "phone")):
        base = (cfg.email_weight if "email" in shared else 0.0) + (cfg.phone_weight if "phone" in shared else 0.0)
        equal, part, other = (_reach(base, o * cfg.org_weight, cfg) for o in (1.0, 0.8, 0.0))
        if equal != "none" and not any(s and set(s) < set(shared) and r[2] == "any" for s, _, r in found):
            found.append((shared, base, (equal, part, other)))
    return found


def spanning_pairs(classes: DataFrame, cfg: DedupeConfig = DedupeConfig()) -> DataFrame:
    """(a, b): links that connect what all pairs that share a bucket and reach the threshold connect.

    With weights of 0 or more a pair is linked if some set of keys that it shares (none, an email, a phone, both) reaches the
    threshold with its names and organizations, so each set is taken alone. In a bucket of equal keys only name and organization
    count: contacts equal in both are a unit. If the members of a unit are not linked with each other, they are linked
    with nothing else in the bucket; otherwise each is linked with the first, and only firsts go on. Where any names reach the
    threshold, or only equal ones, equal keys decide and no pair is made; firsts are compared only where like names
    count, or organizations that hold one another. With a negative weight all pairs of all buckets are compared.
    """
    if not needed_blocks(cfg):
        return classes.sparkSession.createDataFrame([], "a long, b long")
    if min(cfg.email_weight, cfg.phone_weight, cfg.name_weight, cfg.org_weight) < 0:
        return _compared(save(block_keys(classes).join(classes.select("idx", *FORMS), "idx")), ["block", "key"], cfg)
    name, org, none = F.col("name_key"), F.col("org_key"), F.lit("")
    by, members, starred, paired = ["set", "k", "l", "name_key", "org_key"], [], [], []
    sets = shared_sets(cfg)
    for shared, base, (_, _, other) in sets:
        r = classes.select(F.lit("+".join(shared)).alias("set"), "idx", *FORMS)
        r = r.withColumn("k", F.explode("email_keys") if "email" in shared else none).withColumn("l", F.explode("phone_keys") if "phone" in shared else none)
        own = F.lit(base) + F.when((name != "") & F.lit(1.0 > cfg.min_name_similarity), cfg.name_weight).otherwise(0.0) + F.when(org != "", cfg.org_weight).otherwise(0.0)
        if other == "any" and shared:
            members.append(r.select("set", "k", "l", none.alias("name_key"), none.alias("org_key"), "idx"))
        else:
            members.append(r.where((F.lit(bool(shared)) | (name != "") | (org != "")) & (own >= cfg.threshold)).select(*by, "idx"))
    rows = reduce(DataFrame.unionAll, members)
    first = save(rows.groupBy(*by).agg(F.min("idx").alias("idx"), F.count("*").alias("n")))
    links = [rows.join(first.where("n > 1").select(*by, F.col("idx").alias("b")), by).where("idx <> b").select(F.col("idx").alias("a"), "b")]
    for shared, _, (equal, part, other) in sets:
        if other == "any" and shared:
            continue
        forms = [(F.array(none) if b in shared else F.array().cast("array<string>")).alias(f"{b}_keys") for b in ("email", "phone")]
        block = F.lit(True) if shared else name != ""
        unit = lambda to, kind, c, k=F.col("k"), m=none: to.append(first.where((F.col("set") == "+".join(shared)) & c).select(F.concat("set", F.lit(f" {kind}")).alias("set"), k.alias("k"), "l", m.alias("m"), "idx", *forms, name, org))  # noqa: E731, B023
        whole = part in ("any", "like") or other in ("any", "like")
        if equal == "any":
            unit(starred, "org", org != "", m=org)
        elif equal == "like" and not (whole and shared):
            unit(paired, "org", org != "", m=org)
        if other == "any":
            unit(starred, "block", block, name_block(name))
        elif whole:
            unit(paired, "block", block, F.col("k") if shared else name_block(name))
        elif other == "same":
            unit(starred, "name", name != "", m=name)
        elif part == "same":
            unit(paired, "name", name != "", m=name)
    if starred:
        links.append(_stars(reduce(DataFrame.unionAll, starred), ["set", "k", "l", "m"]))
    if paired:
        links.append(_compared(save(reduce(DataFrame.unionAll, paired)), ["set", "k", "l", "m"], cfg))
    return reduce(DataFrame.unionAll, links)


def clusters(contacts: DataFrame, cfg: DedupeConfig = DedupeConfig()) -> DataFrame:
    """(idx, cluster_id): contacts linked by pairs, over any number of steps, share the smallest idx among them.

    Contacts with equal comparable forms are one class: they score alike with all others, so pairs are
    made between classes only, and a bucket that thousands of copies share costs one row. Copies
    link with each other if their score with themselves reaches the threshold, or if their class links elsewhere.
    """
    keyed = with_keys(contacts)
    sig = ["email_keys", "phone_keys", "name_key", "org_key"]
    classes = save(keyed.groupBy(*sig).agg(F.min("idx").alias("idx"), F.count("*").alias("n")))
    links = save(spanning_pairs(classes, cfg))
    comp = save(connected_components(links))
    blocks = needed_blocks(cfg)
    own = F.when(F.size("email_keys") > 0, cfg.email_weight).otherwise(0.0) + F.when(F.size("phone_keys") > 0, cfg.phone_weight).otherwise(0.0)
    own = own + F.when((F.col("name_key") != "") & (F.lit(1.0) > cfg.min_name_similarity), cfg.name_weight).otherwise(0.0)
    own = own + F.when(F.col("org_key") != "", cfg.org_weight).otherwise(0.0)
    shares = F.lit(False)
    for b, c in (("email", F.size("email_keys") > 0), ("phone", F.size("phone_keys") > 0), ("org", F.col("org_key") != ""), ("name", F.col("name_key") != "")):
        if b in blocks:
            shares = shares | c
    alike = shares & (own >= cfg.threshold)
    found = classes.join(comp.withColumnRenamed("node", "idx"), "idx", "left").select(*sig, F.when(F.col("component_id").isNotNull() | alike, F.coalesce("component_id", "idx")).alias("cluster_id"))
    return keyed.join(found, sig, "left").select("idx", F.coalesce("cluster_id", "idx").alias("cluster_id"))
