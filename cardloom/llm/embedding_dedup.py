"""Embedding near-dedup: PCA-ordered tiled comparison.

Equal vectors of a label are one class. Classes are turned into the principal axes of the whole table, so that the first dimensions
hold most of each product. Within a label they are ordered by the cells of a tree of median splits over the axes along which they
vary most, and cut into tiles with bounding boxes on these axes. Two tiles are compared only if their boxes are near enough for the
threshold; within a pair of tiles the product grows by blocks of dimensions, and pairs leave as soon as the sum so far plus the
product of the suffix norms cannot reach the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardloom.llm.common import join_groups, save, ship
from cardloom.llm.kdtree_search import cell_of, split_space
from cardloom.operators.components import connected_components, spanning_links

TILE = 1024
SLACK = 1e-9  # rounding of the turned coordinates; what passes is compared again as given
BOX, KEYS = 8, 3  # axes of the tiles' boxes, and those of them by which tiles are dealt to buckets
SAMPLE = 65_536  # vectors that the order of the tiles is fitted on; it bears on speed alone


def _matrix(col: pa.Array) -> np.ndarray:
    return np.array(col.values if isinstance(col, pa.ListArray | pa.LargeListArray) else col).reshape(len(col), -1)


def clean_vectors(df: DataFrame, group: str | None) -> DataFrame:
    """vec_id, grp (string), v (array<double>) of the rows that can link; one row for each vec_id."""
    v = F.col("embedding").cast("array<double>")
    ok = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    grp = F.col(group).cast("string") if group else F.lit("")
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), grp.alias("grp"), v.alias("v")).where("vec_id is not null").groupBy("vec_id").agg(F.min(F.struct("grp", "v")).alias("s"))
    return rows.select("vec_id", "s.grp", "s.v").where(F.col("v").isNotNull() & (F.size("v") > 0)).where(ok)


def principal_axes(vectors: DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Axes (columns) by falling second moment of the unit vectors, and the variance along each; each partition sends one dim x dim sum."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, m, n = np.zeros((dim, dim)), np.zeros(dim), 0
        for b in batches:
            if b.num_rows:
                x = _unit(_matrix(b.column("v")))
                c, m, n = c + x.T @ x, m + x.sum(0), n + len(x)
        i, j = np.triu_indices(dim)
        yield pa.record_batch({"k": pa.array(np.r_[i * dim + j, dim * dim + np.arange(dim + 1)]), "s": pa.array(np.r_[c[i, j], m, n])})

    c, mean = np.zeros((dim, dim)), np.zeros(dim + 1)
    for k, s in vectors.select("v").mapInArrow(sums, "k long, s double").groupBy("k").agg(F.sum("s")).collect():  # about dim * dim / 2 rows
        if k >= dim * dim:
            mean[k - dim * dim] = s
        else:
            c[k // dim, k % dim] = c[k % dim, k // dim] = s
    n = max(1.0, mean[dim])
    moment, axes = np.linalg.eigh(c / n)
    moment, axes = moment[::-1], axes[:, ::-1]
    return axes, moment - (mean[:dim] / n @ axes) ** 2


def _unit(x: np.ndarray) -> np.ndarray:
    top = np.abs(x).max(1, keepdims=True)
    x = x / np.where(top > 0, top, 1)  # else squares of very large or small components leave the range
    n = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.where(n > 0, n, 1)


def compare_tiles(a: np.ndarray, b: np.ndarray, ua: np.ndarray, ub: np.ndarray, threshold: float, same: bool, rows: int = 128) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of pairs with cosine >= threshold; a, b turned unit vectors, ua, ub unit vectors as given. Some rows of a at a time."""
    d = a.shape[1]
    steps = list(dict.fromkeys(min(d, s) for s in (8, 16, 32, d)))
    norms = [(np.sqrt((a[:, to:] ** 2).sum(1)), np.sqrt((b[:, to:] ** 2).sum(1))) for to in steps]
    out: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    for s in range(0, len(a), rows):
        first = a[s : s + rows, : steps[0]] @ b[:, : steps[0]].T
        ok = first + np.outer(norms[0][0][s : s + rows], norms[0][1]) >= threshold - SLACK
        if same:
            ok &= np.arange(s, s + len(ok))[:, None] < np.arange(len(b))
        i, j = np.nonzero(ok)
        part = first[i, j]
        i += s
        for done, to, (sa, sb) in zip(steps, steps[1:], norms[1:], strict=False):
            part = part + np.einsum("ij,ij->i", a[i, done:to], b[j, done:to])
            ok = part + sa[i] * sb[j] >= threshold - SLACK
            i, j, part = i[ok], j[ok], part[ok]
        ok = np.einsum("ij,ij->i", ua[i], ub[j]) >= threshold
        out.append((i[ok], j[ok]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def embedding_links(classes: DataFrame, threshold: float = 0.98, tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """(rep, links: vectors in the classes that a class links with), and edges (a, b) that span the components of all links.

    classes: rep (smallest vec_id), n (its vectors), grp and v, distinct as a pair.
    """
    dims = [r[0] for r in classes.groupBy(F.size("v").alias("d")).count().collect()]  # the lengths of vectors that occur
    found = None
    for dim in dims:
        one = _links_of(classes.where(F.size("v") == dim), dim, threshold, tile)
        found = one if found is None else found.unionAll(one)
    if found is None:
        found = classes.sparkSession.createDataFrame([], "kind int, a long, b long")
    found = save(found)
    return found.where("kind = 0").groupBy(F.col("a").alias("rep")).agg(F.sum("b").alias("links")), found.where("kind = 1").select("a", "b")


def _links_of(classes: DataFrame, dim: int, threshold: float, tile: int) -> DataFrame:
    spark = classes.sparkSession
    axes, variance = principal_axes(classes, dim)
    box = np.argsort(-variance, kind="stable")[:BOX]  # a direction in which all vectors are alike tells none apart
    total = classes.count()
    share = int(min(1.0, SAMPLE / max(1, total)) * (1 << 20)) + 1
    sample = classes.where(F.pmod(F.xxhash64("rep"), F.lit(1 << 20)) < share).orderBy("rep").limit(2 * SAMPLE).select("v").toArrow()  # bounded by SAMPLE
    known = _unit(_matrix(sample.column("v").combine_chunks())) @ axes[:, box] if sample.num_rows else np.empty((0, len(box)))
    depth = max(0, min(int(np.ceil(np.log2(max(1, total / tile)))), int(np.log2(max(1, len(known) / 8)))))
    splits = split_space(known, depth)

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                u = _unit(_matrix(b.column("v")))
                x = u @ axes[:, box]
                yield pa.record_batch([b.column("rep"), b.column("n"), b.column("grp"), pa.array(cell_of(x, *splits)), pa.array(x[:, 0]), pa.array([r.tobytes() for r in u.astype("<f8")], pa.binary())], ["rep", "n", "grp", "cell", "x", "u"])

    turned = classes.select("rep", "n", "grp", "v").mapInArrow(turn, "rep long, n long, grp string, cell long, x double, u binary")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = ["grp", "cell", "x", "rep"]
    ordered = turned.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def out(t: pa.Table) -> pa.RecordBatch:
            ids, n = t.column("rep").to_numpy(), t.column("n").to_numpy()
            us = b"".join(t.column("u").to_pylist())
            x = np.frombuffer(us, "<f8").reshape(-1, dim) @ axes[:, box]
            lists = [pa.array([v.tolist()], pa.list_(pa.float64())) for v in (x.min(0), x.max(0))]
            blobs = [pa.array([v], pa.binary()) for v in (ids.astype("<i8").tobytes(), n.astype("<i8").tobytes(), us)]
            return pa.RecordBatch.from_arrays([pa.array([t.column("grp")[0].as_py()], pa.string()), pa.array([int(ids.min())], pa.int64()), *lists, *blobs], ["grp", "tile", "lo", "hi", "ids", "ns", "us"])

        for b in batches:
            if not b.num_rows:
                continue
            held.append(pa.Table.from_batches([b]))
            if sum(t.num_rows for t in held) < tile:
                continue
            t = pa.concat_tables(held).combine_chunks()
            ends = np.r_[np.flatnonzero(_changes(t.column("grp"))) + 1, t.num_rows]
            at = 0
            while at < t.num_rows:
                end = int(ends[np.searchsorted(ends, at, "right")])
                if end == t.num_rows and end - at < tile:
                    break
                yield out(t.slice(at, min(tile, end - at)))
                at += min(tile, end - at)
            held = [t.slice(at)] if at < t.num_rows else []
        if held:
            t = pa.concat_tables(held).combine_chunks()
            ends = np.r_[np.flatnonzero(_changes(t.column("grp"))) + 1, t.num_rows]
            for a, e in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist(), strict=True):
                for at in range(a, e, tile):
                    yield out(t.slice(at, min(tile, e - at)))

    tiles = save(ordered.mapInArrow(cut, "grp string, tile long, lo array<double>, hi array<double>, ids binary, ns binary, us binary"))
    pairs = near_tiles(tiles, threshold)
    blobs = tiles.select("tile", "ids", "ns", "us")
    other = blobs.select(*(F.col(c).alias(f"{c}2") for c in blobs.columns))
    joined = pairs.repartition(parts, "tile", "tile2").join(blobs, "tile").join(other, "tile2")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                get = lambda c, t="<i8": np.frombuffer(b.column(c)[r].as_buffer(), t)  # noqa: B023, E731
                ids, ids2, ns, ns2 = get("ids"), get("ids2"), get("ns"), get("ns2")
                ua, ub = get("us", "<f8").reshape(-1, dim), get("us2", "<f8").reshape(-1, dim)
                same = b.column("tile")[r].as_py() == b.column("tile2")[r].as_py()
                i, j = compare_tiles(ua @ axes, ub @ axes, ua, ub, threshold, same)
                if not len(i):
                    continue
                all_ids, all_n = (ids, ns) if same else (np.r_[ids, ids2], np.r_[ns, ns2])
                j = j if same else j + len(ids)
                order = np.argsort(all_ids, kind="stable")
                rank = np.empty(len(order), np.int64)
                rank[order] = np.arange(len(order))
                links = np.zeros(len(all_ids), np.int64)
                np.add.at(links, i, all_n[j])
                np.add.at(links, j, all_n[i])
                has = np.flatnonzero(links)
                e1, e2 = spanning_links(rank[i], rank[j], len(all_ids))
                sorted_ids = all_ids[order]
                yield pa.record_batch({"kind": pa.array([0] * len(has) + [1] * len(e1), pa.int32()), "a": pa.array(np.r_[all_ids[has], sorted_ids[e1]]), "b": pa.array(np.r_[links[has], sorted_ids[e2]])})

    return joined.select("tile", "tile2", "ids", "ns", "us", "ids2", "ns2", "us2").mapInArrow(compare, "kind int, a long, b long")


def _changes(col: pa.ChunkedArray) -> np.ndarray:
    """Where a value differs from the one after it."""
    return np.asarray(pc.not_equal(col.slice(1), col.slice(0, max(0, len(col) - 1))).to_numpy(zero_copy_only=False), bool)


def near_tiles(tiles: DataFrame, threshold: float) -> DataFrame:
    """tile, tile2 (tile <= tile2): tiles of a label whose boxes (lo, hi) are near enough for the threshold; names only, a few bytes each.

    |x - y|^2 = 2 - 2 cos for unit vectors, and the boxes' distance is no more. Tiles meet in an equi-join, in buckets as wide as that
    distance on the first axes of the boxes.
    """
    gap = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-6
    names = tiles.select("grp", "tile", "lo", "hi")
    axes = min(KEYS, len(names.first()["lo"])) if not names.isEmpty() else 0

    def buckets(df: DataFrame, lo: str, hi: str, more: float) -> DataFrame:
        for i in range(axes):
            at = lambda c, m, i=i: F.floor((F.get(F.col(c), F.lit(i)) + m) / gap).cast("long")
            df = df.withColumn(f"k{i}", F.explode(F.sequence(at(lo, -more), at(hi, more))))
        return df

    left = buckets(names, "lo", "hi", 0.0)
    right = buckets(names.select("grp", *(F.col(c).alias(f"{c}2") for c in ("tile", "lo", "hi"))), "lo2", "hi2", gap)
    apart = F.zip_with(F.zip_with("lo", "hi2", lambda x, y: F.greatest(x - y, F.lit(0.0))), F.zip_with("lo2", "hi", lambda x, y: F.greatest(x - y, F.lit(0.0))), lambda x, y: (x + y) * (x + y))
    met = left.join(right, ["grp", *(f"k{i}" for i in range(axes))]).where("tile <= tile2")
    return met.where(F.aggregate(apart, F.lit(0.0), lambda x, y: x + y) <= gap * gap).select("tile", "tile2").distinct()


def embedding_near_dedup(df: DataFrame, threshold: float = 0.98, tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id, kept for each vector of ``df`` (vec_id, embedding, label; other columns are ignored).

    Vectors link if their labels (of any type, compared as strings) are equal and not null and their cosine is at least
    ``threshold``, which must be above 0. Null, empty and zero vectors, and those with null or non-finite components, link with nothing, as
    do vectors of different lengths. Rows that repeat a vec_id count once (the smallest label and
    vector); rows without vec_id are left out. An empty table gives an empty result.
    """
    ship(df.sparkSession)
    rows = save(clean_vectors(df, "label").where("grp is not null").where(F.exists("v", lambda x: x != 0)))
    classes = save(rows.groupBy("grp", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")))
    links, edges = embedding_links(classes, threshold, tile)
    comp = connected_components(edges).select(F.col("node").alias("rep"), "component_id")
    done = classes.join(links, "rep", "left").join(comp, "rep", "left").select("grp", "v", "n", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    linked = join_groups(rows, save(done), ["grp", "v"]).select("vec_id", "n_links", "component_id")
    ids = df.select(F.col("vec_id").cast("long").alias("vec_id")).where("vec_id is not null").distinct()
    out = ids.join(linked, "vec_id", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
