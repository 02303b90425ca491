"""MinHash near-dedup with b-bit signatures.

Every document's distinct shingles are hashed to 64 bits; ``hashes`` permutations give minima, bands of
``rows`` minima are the candidate keys, and of each minimum only ``BITS`` low bits (after mixing) stay,
packed. Candidates are first estimated from the packed bits: a share m of equal groups means a similarity
of about (m - c) / (1 - c), where c = 2 ** -BITS is how often unequal minima collide. What passes a margin
far below the threshold is confirmed on the full sets.

Documents with equal sets are one class, and only its first document goes on; the classes are confirmed on the full sets
as well. Within a bucket each member meets the first one (a star); only buckets whose members are then still in different
components are compared in full, in tiles bounded by rows and bytes and inside numpy: first by their packed bits, then, for the rows
that have a likely partner, by their full sets. A pair is looked at in the first band that it shares, and not if it is in
one component. No pairs leave such a block, but at most one link for each of its rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardloom.llm.common import _GOLD, fmix, join_groups, pieces, save, shingles, ship, words_of
from cardloom.operators.components import connected_components, spanning_links

BITS = 2
HASHES, ROWS = 192, 6
TILE, TILE_BYTES = 256, 4 << 20  # of a bucket: rows, and bytes of full sets
COPIES = 4096  # documents of a class that one task confirms
_PACK = np.uint64(0x5555555555555555)


def permutations(n: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(1, 1 << 32, n, np.uint64).astype(np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, n, np.uint64).astype(np.uint32)


def _mix32(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return h ^ (h >> np.uint32(16))


def minima(sets: np.ndarray, first: np.ndarray, hashes: int = HASHES) -> np.ndarray:
    """(documents, hashes) minima of mixed permutations; every set must have an element."""
    a, b = permutations(hashes)
    x = (sets >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(first) - 1, hashes), np.uint32)
    tmp = np.empty(len(x), np.uint32)
    for i in range(hashes):
        np.multiply(x, a[i], out=tmp)
        tmp += b[i]
        tmp ^= tmp >> np.uint32(15)
        tmp *= np.uint32(0x9E3779B1)
        out[:, i] = np.minimum.reduceat(tmp, first[:-1])
    return out


def pack_bits(m: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Low bits of the mixed minima as uint64 words, 64 / bits minima each."""
    low = (_mix32(m) & np.uint32((1 << bits) - 1)).astype(np.uint64)
    per = 64 // bits
    padded = np.zeros((len(m), -(-m.shape[1] // per) * per), np.uint64)
    padded[:, : m.shape[1]] = low
    return (padded.reshape(len(m), -1, per) << (np.arange(per, dtype=np.uint64) * np.uint64(bits))).sum(2, dtype=np.uint64)


def equal_groups(a: np.ndarray, b: np.ndarray, hashes: int = HASHES) -> np.ndarray:
    """How many of the packed groups of two bits are equal; a, b broadcast, words on the last axis."""
    x = a ^ b
    x = (x | (x >> np.uint64(1))) & _PACK
    return hashes - np.bitwise_count(x).sum(-1, dtype=np.int64)


def estimate(equal: np.ndarray, hashes: int = HASHES, bits: int = BITS) -> np.ndarray:
    c = 2.0**-bits
    return (equal / hashes - c) / (1 - c)


def band_keys(m: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """(documents, bands) keys of the bands; the number of the band is part of a key."""
    g = m.reshape(len(m), -1, rows).astype(np.uint64)
    h = np.broadcast_to(np.arange(g.shape[1], dtype=np.uint64) * _GOLD, g.shape[:2]).copy()
    for j in range(rows):
        h = fmix(h ^ g[:, :, j]) * _GOLD
    return fmix(h)


def document_sets(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document, one after another, and where each begins."""
    w = words_of(batch, lower=True)
    g, d, _ = shingles(w.hashes(), w.first, k, True)
    if len(g):
        o = np.lexsort((g, d))
        g, d = g[o], d[o]
        keep = np.r_[True, (g[1:] != g[:-1]) | (d[1:] != d[:-1])]
        g, d = g[keep], d[keep]
    return g, np.searchsorted(d, np.arange(batch.num_rows + 1))


def set_names(g: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(2, documents) numbers, 128 bits that name each set; 0 for empty ones."""
    f = np.zeros((2, len(first) - 1), np.uint64)
    full = np.flatnonzero(np.diff(first))
    if len(full):
        f[0, full] = np.add.reduceat(fmix(g ^ _GOLD), first[full])
        f[1, full] = np.add.reduceat(fmix(g * _GOLD + np.uint64(1)), first[full])
    return f.view(np.int64)


def sketch(docs: DataFrame, k: int = 5, hashes: int = HASHES, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, and for nonempty sets f1, f2 (128 bits that name the set), bands (keys) and sig (packed bits)."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            g, first = document_sets(b, k)
            n = np.diff(first)
            full = np.flatnonzero(n)
            f = set_names(g, first)
            bands, sig = [None] * b.num_rows, [None] * b.num_rows
            if len(full):
                starts = first[full]
                m = minima(g, np.r_[starts, len(g)], hashes)
                for i, x, y in zip(full, band_keys(m, rows).view(np.int64), pack_bits(m), strict=True):
                    bands[i], sig[i] = x, y.tobytes()
            yield pa.record_batch({"doc_id": b.column("doc_id"), "n_shingles": pa.array(n, pa.int64()), "f1": pa.array(f[0]), "f2": pa.array(f[1]), "bands": pa.array(bands, pa.list_(pa.int64())), "sig": pa.array(sig, pa.binary())})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_shingles long, f1 long, f2 long, bands array<long>, sig binary")


def _estimated(pairs: DataFrame, floor: float, hashes: int) -> DataFrame:
    """a, b of pairs (a, b, sig_a, sig_b) whose packed bits let the similarity reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            if not t.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(t.column(c).to_pylist()), np.uint64).reshape(t.num_rows, -1) for c in ("sig_a", "sig_b"))
            ok = pa.array(estimate(equal_groups(x, y, hashes), hashes) >= floor)
            yield pa.record_batch([t.column("a").filter(ok), t.column("b").filter(ok)], ["a", "b"])

    return pairs.mapInArrow(run, "a long, b long")


def full_sets(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """doc_id, s (sorted shingle hashes) of the documents that ``ids`` names.

    The ids grow with the input, so they are never broadcast: the join is by shuffle at every size.
    """

    def to_set(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            g, first = document_sets(b, k)
            yield pa.record_batch({"doc_id": b.column("doc_id"), "s": pa.array([g[i:j].tobytes() for i, j in zip(first[:-1], first[1:], strict=True)], pa.binary())})

    wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ids.distinct().hint("merge"), "doc_id", "left_semi")
    return save(wanted.mapInArrow(to_set, "doc_id long, s binary"))


def _confirmed(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union of their full sets."""
    sets = full_sets(docs, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")), k)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            ok = []
            for x, y in zip(t.column("s1"), t.column("s2"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([x, y])
                both.sort(kind="stable")  # two sorted runs
                same = int((both[1:] == both[:-1]).sum())
                ok.append(100 * same >= percent * (len(x) + len(y) - same))
            ok = pa.array(ok, pa.bool_())
            yield pa.record_batch([t.column("a").filter(ok), t.column("b").filter(ok)], ["a", "b"])

    one = pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("s").alias("s2")), "b")
    two = one.join(sets.select(F.col("doc_id").alias("a"), F.col("s").alias("s1")), "a")
    return two.select("a", "b", "s1", "s2").mapInArrow(check, "a long, b long")


def intersections(sets: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """How many hashes each pair of sets shares, exactly: products of 0/1 matrices, some columns at a time."""
    who = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    names, inv, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.flatnonzero(n > 1)
    place = np.full(len(names), -1)
    place[shared] = np.arange(len(shared))
    col = place[inv]
    who, col = who[col >= 0], col[col >= 0]
    o = np.argsort(col, kind="stable")
    who, col = who[o], col[o]
    out = np.zeros((len(sets), len(sets)), np.int64)
    for s in range(0, len(shared), columns):
        i, j = np.searchsorted(col, [s, s + columns])
        m = np.zeros((len(sets), columns), np.float32)
        m[who[i:j], col[i:j] - s] = 1
        out += (m @ m.T).astype(np.int64)
    return out


def confirmed_copies(docs: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """Links (a, b) that join the members (doc_id, f1, f2, n_shingles, size) of each class, found equal on their full sets.

    Members of a class are compared in runs of about COPIES, each with the first of its run; the first ones meet in a
    second pass. A task holds the sets of one document and of a batch. Different sets of one 128-bit name stop the job.
    """
    name = ["f1", "f2", "n_shingles"]
    own = members.select("doc_id", *name, F.ceil(F.col("size") / COPIES).alias("salts")).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(own.hint("merge"), "doc_id")

    def to_set(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            g, first = document_sets(b, k)
            f, n = set_names(g, first), np.diff(first)
            mine = np.flatnonzero((f[0] == b.column("f1").to_numpy()) & (f[1] == b.column("f2").to_numpy()) & (n == b.column("n_shingles").to_numpy()))
            rows = b.take(pa.array(mine))
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in ("doc_id", *name, "salts")), pa.array([g[first[i] : first[i + 1]].tobytes() for i in mine], pa.binary())], ["doc_id", *name, "salts", "s"])

    def chain(batches: Iterator[pa.RecordBatch], again: bool) -> Iterator[pa.RecordBatch]:
        head, known = None, b""
        for b in batches:
            out: list[tuple] = []
            for r in b.to_pylist():
                key = r["f1"], r["f2"], r["n_shingles"], r["salt"]
                if head is None or key != head[0]:
                    head, known = (key, r["doc_id"]), r["s"]
                    out.append((r["doc_id"], r["doc_id"], *key[:3], known if again and r["salts"] > 1 else None))
                elif r["s"] != known:
                    raise ValueError(f"documents {head[1]} and {r['doc_id']} have different sets of one name")
                else:
                    out.append((r["doc_id"], head[1], *key[:3], None))
            yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out, strict=True), [pa.int64()] * 5 + [pa.binary()], strict=True)] if out else [pa.array([], t) for t in [pa.int64()] * 5 + [pa.binary()]], ["a", "b", *name, "s"])

    schema = "a long, b long, f1 long, f2 long, n_shingles long, s binary"
    sets = texts.mapInArrow(to_set, "doc_id long, f1 long, f2 long, n_shingles long, salts long, s binary").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.col("salts")))
    one = sets.repartition(*name, "salt").sortWithinPartitions(*name, "salt", "doc_id").mapInArrow(lambda x: chain(x, True), schema)
    one = save(one)
    heads = one.where("s is not null").select(F.col("a").alias("doc_id"), *name, F.lit(1).cast("long").alias("salts"), "s", F.lit(0).cast("long").alias("salt"))
    two = heads.repartition(*name).sortWithinPartitions(*name, "doc_id").mapInArrow(lambda x: chain(x, False), schema)
    return one.unionAll(two).where("a <> b").select("a", "b")


def _likely(t: pa.Table, floor: float, hashes: int) -> np.ndarray:
    """Pairs of a block that are worth comparing: likely by their packed bits, in different components, and in no band of theirs before this one."""
    comp, bands = t.column("comp").to_numpy(), np.array(t.column("bands").combine_chunks().flatten()).reshape(t.num_rows, -1)
    sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint64).reshape(t.num_rows, -1)
    key, out = t.column("key")[0].as_py(), np.zeros((t.num_rows, t.num_rows), bool)
    for s in range(0, t.num_rows, 64):
        out[s : s + 64] = (estimate(equal_groups(sig[s : s + 64, None], sig[None, :], hashes), hashes) >= floor) & (comp[s : s + 64, None] != comp[None, :])
        i, j = np.nonzero(out[s : s + 64])
        for a in range(0, len(i), 8192):
            x, y = i[a : a + 8192] + s, j[a : a + 8192]
            first = bands[x, (bands[x] == bands[y]).argmax(1)]
            out[x, y] = first == key
    return out


def _tiled(members: DataFrame, sets: DataFrame, floor: float, percent: int, hashes: int, tile: int) -> DataFrame:
    """Links (a, b) that connect what all links between members (key, doc_id, comp, sig, bands, n_shingles) of one bucket but different components connect.

    A bucket of up to ``tile`` members and TILE_BYTES bytes of sets is one block; a larger one is dealt by hash to tiles, and each
    pair of tiles is a block of its own, so that a block holds about two tiles. A block estimates all its pairs from
    the packed bits; the sets of rows with a likely partner are then brought there and compared. What leaves it is no more than one link a row.
    """
    size = members.groupBy("key").agg(F.greatest(F.ceil(F.count("*") / tile), F.ceil(F.sum(8 * F.col("n_shingles")) / TILE_BYTES)).alias("tiles"))
    size = size.join(members.groupBy("key").agg(F.count("*").alias("rows")), "key").select("key", F.least("tiles", "rows").cast("int").alias("tiles"))
    m = members.join(size, "key").withColumn("t", F.pmod(F.xxhash64("doc_id"), F.col("tiles")).cast("int"))
    # block (low, high) of tiles; a tile takes part in `tiles` blocks
    m = m.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    m = m.select("key", F.least("t", "o").alias("lo"), F.greatest("t", "o").alias("hi"), "doc_id", "comp", "sig", "bands")
    types = "key long, lo int, hi int, doc_id long, comp long, sig binary, bands array<long>"

    def sift(_: tuple, t: pa.Table) -> pa.Table:
        return t.filter(pa.array(_likely(t, floor, hashes).any(1)))

    live = save(m.groupBy("key", "lo", "hi").applyInArrow(sift, types)).join(sets.hint("merge"), "doc_id")

    def run(_: tuple, t: pa.Table) -> pa.Table:
        ids = t.column("doc_id").to_numpy()
        each = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("s")]
        n = np.array([len(x) for x in each])
        same = intersections(each)
        i, j = np.nonzero(_likely(t, floor, hashes) & (100 * same >= percent * (n[:, None] + n[None, :] - same)))
        order = np.argsort(ids, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        a, b = spanning_links(rank[i], rank[j], len(ids))
        named = ids[order]
        return pa.table({"a": pa.array(named[a]), "b": pa.array(named[b])})

    return live.groupBy("key", "lo", "hi").applyInArrow(run, "a long, b long")


def minhash_near_dedup(docs: DataFrame, k: int = 5, percent: int = 80, hashes: int = HASHES, rows: int = ROWS, tile: int = TILE, margin: float = 0.18) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs`` (doc_id, text; other columns are ignored).

    Documents link if 100 * intersection >= percent * union of their sets of ``k``-word shingles (words
    lower-cased for A-Z). Fewer words than k make one shingle. Null, empty and wordless texts have no
    shingles and link with nothing. component_id is the smallest doc_id reachable. Rows repeated under
    a doc_id count as one document if their texts agree; if not, each text links for the doc_id. Rows without doc_id
    have no component and are not kept. An empty table gives an empty result.

    Nothing catches a link without a common band: with the default 32 bands of 6 that has probability 3e-7 at similarity 0.85
    but 6e-5 at 0.80; 50 bands (300 hashes) have 2.5e-7 at 0.80. A true link at 0.85 falls below the estimate's margin (almost 6
    standard deviations of the two-bit estimate) with about 1e-8; more hashes make that rarer.
    """
    floor = percent / 100 - margin
    sk = save(sketch(docs, k, hashes, rows))
    full = sk.where("n_shingles > 0 and doc_id is not null")
    # one class for each set: its first document goes on
    name = ["f1", "f2", "n_shingles"]
    classes = save(full.groupBy(*name).agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")))
    many = classes.where("n > 1").withColumn("size", F.col("n"))
    copies = confirmed_copies(docs, save(join_groups(full.select("doc_id", *name), many, name)), k)
    # a set goes on, not a doc_id: that may have other texts
    reps = full.join(classes.select(F.col("rep").alias("doc_id"), *name).hint("merge"), ["doc_id", *name], "left_semi").select("doc_id", "bands", "sig", "n_shingles")

    keys = reps.select("doc_id", F.explode("bands").alias("key"))
    buckets = keys.groupBy("key").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("key", "first")
    members = save(keys.join(buckets, "key"))  # only buckets with company
    sigs = reps.select("doc_id", "sig")

    def with_sigs(pairs: DataFrame) -> DataFrame:
        return pairs.join(sigs.select(F.col("doc_id").alias("b"), F.col("sig").alias("sig_b")), "b").join(sigs.select(F.col("doc_id").alias("a"), F.col("sig").alias("sig_a")), "a").select("a", "b", "sig_a", "sig_b")

    star = members.where("doc_id <> first").select(F.col("first").alias("a"), F.col("doc_id").alias("b")).distinct()
    links = save(_confirmed(save(_estimated(with_sigs(star), floor, hashes)), docs, k, percent))
    comp = save(connected_components(links))

    # buckets that still hold several components
    labelled = members.join(comp.select(F.col("node").alias("doc_id"), "component_id"), "doc_id", "left").select("key", "doc_id", F.coalesce("component_id", "doc_id").alias("comp"))
    mixed = labelled.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("n")).where("x <> y and n > 2").select("key")
    rest = save(labelled.join(mixed, "key", "left_semi").join(reps, "doc_id"))
    more_links = save(_tiled(rest, full_sets(docs, rest.select("doc_id"), k), floor, percent, hashes, tile))
    edges = links.unionAll(more_links).unionAll(copies)
    final = connected_components(edges)
    component = F.coalesce("component_id", "doc_id")
    return sk.select("doc_id", "n_shingles").join(final.select(F.col("node").alias("doc_id"), "component_id"), "doc_id", "left").select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(False)).alias("kept")
    )
