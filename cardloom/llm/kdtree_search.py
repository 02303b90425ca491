"""Exact top-k by inner product over integer vectors: KD-trees per shard.

A global tree, cut at medians of a bounded sample, deals the vectors to cells of space; a cell is one shard, or several
if it holds too many. Each shard is a KD-tree of its own: median splits along the widest axis, with tight bounding boxes at
every node. A query's largest possible product with a box is sum(max(q * low, q * high)); children never exceed their parent.

1. Each query is bounded against the boxes of all shards (packed in chunks; no vectors move) and visits its best one.
2. The kth score found there goes with it to its next best shards, and from these to all others whose box still reaches it.
3. Within a shard, nodes that cannot reach a query's kth score are left level by level, and the leaves that remain are visited best
   bound first, until none reaches the kth score.

So a shard meets only the queries that may find something there, and is loaded once for a few thousand of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cardloom.llm.common import join_groups, save, ship

LEAF = 256
EXACT = 2.0**53
#: The global tree is cut by at most so many vectors, and so many bytes of them; it has an eighth as many cells at most. All rows are indexed.
SAMPLE, SAMPLE_BYTES = 131_072, 64 << 20
CHUNK = 4096  # boxes in a row of the table of boxes
AHEAD = 4  # shards that a query visits, best bound first, before it looks at all others
TOGETHER = 4096  # queries for which a shard is loaded once
LOWEST = np.iinfo(np.int64).min


def _halves(x: np.ndarray, order: np.ndarray, cuts: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """Split each run of ``order`` at its median along its widest axis; (begin, middle, end, axis) of each."""
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        part = x[order[a:b]]
        axis = int((part.max(0).astype(float) - part.min(0)).argmax())
        mid = (b - a) // 2
        order[a:b] = order[a:b][np.argpartition(part[:, axis], mid)]
        yield a, a + mid, b, axis


def build_tree(x: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order of the rows, leaf bounds in that order, and the lowest and highest coordinates of all nodes: the root, its children, and so on."""
    order, cuts = np.arange(len(x)), np.array([0, len(x)])
    for _ in range(max(0, int(np.ceil(np.log2(max(1, len(x) / leaf)))))):
        cuts = np.r_[[a for part in _halves(x, order, cuts) for a in part[:2]], len(x)].astype(np.int64)
    xs = x[order]
    low, high = [np.minimum.reduceat(xs, cuts[:-1])], [np.maximum.reduceat(xs, cuts[:-1])]
    while len(low[0]) > 1:
        low.insert(0, np.minimum(low[0][::2], low[0][1::2]))
        high.insert(0, np.maximum(high[0][::2], high[0][1::2]))
    return order, cuts, np.concatenate(low), np.concatenate(high)


def split_space(x: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Axis and value of the nodes of a tree of ``depth`` levels over the sample ``x``: the root, its children, and so on."""
    order, cuts, axes, values = np.arange(len(x)), np.array([0, len(x)]), [], []
    for _ in range(depth):
        new = []
        for a, m, b, axis in _halves(x, order, cuts):
            axes.append(axis)
            values.append(x[order[m], axis])
            new += [a, m]
        cuts = np.array([*new, len(x)])
    return np.array(axes, np.int64), np.array(values, x.dtype)


def cell_of(x: np.ndarray, axes: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The cell of each row: down the tree, to the right where a coordinate is not below the node's value."""
    at = np.zeros(len(x), np.int64)
    while len(axes) and len(at) and at[0] < len(axes):
        at = 2 * at + 1 + (x[np.arange(len(x)), axes[at]] >= values[at])
    return at - len(axes)


def product(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer products as 64-bit numbers, exact: by floats where every partial sum fits 53 bits, else by integers. Products beyond 64 bits count as the nearest 64-bit number."""
    most = float(np.abs(q.astype(float)).max(initial=0)) * float(np.abs(x.astype(float)).max(initial=0)) * x.shape[1]
    if most < EXACT:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    if most < 2.0**62:
        return q @ x.T
    return np.clip(q.astype(object) @ x.astype(object).T, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def box_bounds(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """No product of a query (row) with a vector in a box (column) is above this."""
    q = q.astype(np.float64)
    limit = np.maximum(q, 0) @ high.T.astype(np.float64) + np.minimum(q, 0) @ low.T.astype(np.float64)
    size = np.abs(q) @ np.maximum(np.abs(low.astype(np.float64)), np.abs(high.astype(np.float64))).T  # rounding is relative to this
    return limit + size * 1e-12 + 1


def search(q: np.ndarray, qid: np.ndarray, kth: np.ndarray, x: np.ndarray, ids: np.ndarray, tree: tuple, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query (place, ids, scores) of what can be among its k best in this shard; x and ids in the order of the tree."""
    cuts, low, high = tree
    leaves, kth = len(cuts) - 1, kth.copy()
    # down the tree: only children of nodes that some query still needs are bounded
    live, at, width = np.ones((len(q), 1), bool), 0, 1
    while True:
        need = np.flatnonzero(live.any(0))
        limit = np.full((len(q), width), -np.inf)
        limit[:, need] = box_bounds(q, low[at + need], high[at + need])
        live &= limit >= kth[:, None].astype(np.float64)
        if width == leaves:
            break
        live, at, width = np.repeat(live, 2, 1), at + width, 2 * width
    limit[~live] = -np.inf
    best_first = np.argsort(-limit, axis=1, kind="stable")
    top: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(q)
    left = np.arange(len(q))
    for turn in range(leaves):
        left = left[limit[left, best_first[left, turn]] >= kth[left].astype(np.float64)]
        left = left[limit[left, best_first[left, turn]] > -np.inf]
        if not len(left):
            break
        mine = best_first[left, turn]
        for leaf in np.unique(mine):
            who = left[mine == leaf]
            a, b = cuts[leaf], cuts[leaf + 1]
            scores = product(q[who], x[a:b])
            for w, s in zip(who, scores, strict=True):
                ok = np.flatnonzero((s >= kth[w]) & (ids[a:b] != qid[w]))
                if not len(ok):
                    continue
                i, s2 = np.r_[top[w][0], ids[a:b][ok]], np.r_[top[w][1], s[ok]]
                o = np.lexsort((i, -1 - s2))[:k]  # -1 - s: falls as s rises, without leaving 64 bits
                top[w] = i[o], s2[o]
                if len(o) == k:
                    kth[w] = max(kth[w], s2[o[-1]])
    for w, (i, s) in enumerate(top):
        if len(i):
            yield w, i, s


def _blob(x: np.ndarray) -> bytes:
    return x.astype("<i8").tobytes()


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, shard: int = 16384, block: int = 512) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` largest integer inner products of each query with all vectors but its own.

    vectors and queries hold (vec_id long, x array<long>). Ties go to the smaller vec_id; with fewer
    than k others all of them are returned. Only vectors as long as the query are compared. Shards
    hold about ``shard`` vectors, query blocks about ``block``; a score beyond 64 bits counts as the nearest 64-bit number.
    Empty vectors or queries give an empty result. vec_ids must be unique (``integer_vectors`` sees to it).
    """
    spark = vectors.sparkSession
    ship(spark)
    vectors = save(vectors.select("vec_id", "x", F.size("x").alias("dim")))
    queries = save(queries.select("vec_id", "x", F.size("x").alias("dim")))
    sizes = {r["dim"]: r["n"] for r in vectors.groupBy("dim").agg(F.count("*").alias("n")).collect()}  # the lengths of vectors that occur
    wanted = {r["dim"]: r["n"] for r in queries.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    found = None
    for dim in sorted(sizes.keys() & wanted.keys()):
        own = Search(vectors.where(F.col("dim") == dim).drop("dim"), queries.where(F.col("dim") == dim).drop("dim"), dim, sizes[dim], wanted[dim], k, shard, block)
        found = own.run() if found is None else found.unionAll(own.run())
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _matrix(col: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return col.flatten().to_numpy().reshape(-1, dim)


class Search:
    """One search over vectors of one length."""

    def __init__(self, vectors: DataFrame, queries: DataFrame, dim: int, n: int, wanted: int, k: int, shard: int, block: int):
        self.dim, self.k = dim, k
        self.queries = queries.withColumnRenamed("vec_id", "query_id")
        self.trees = save(self._trees(vectors, n, shard))
        shards = self.trees.count()
        self.chunks = -(-shards // CHUNK)
        self.boxes = save(self._boxes())
        self.blocks = save(self._blocks(-(-wanted // block)))

    def _trees(self, vectors: DataFrame, n: int, shard: int) -> DataFrame:
        """shard, ids, x, cuts, low, high: a KD-tree for each shard."""
        dim = self.dim
        most = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * dim)))
        share = int(min(1.0, most / n) * (1 << 20)) + 1
        sample = vectors.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < share).orderBy("vec_id").limit(2 * most).select("x").toArrow()  # bounded by SAMPLE
        depth = max(0, min(int(np.ceil(np.log2(max(1, n / shard)))), int(np.log2(max(1, sample.num_rows / 8)))))
        axes, values = split_space(_matrix(sample.column("x"), dim), depth)

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell_of(_matrix(b.column("x"), dim), axes, values))], ["vec_id", "x", "cell"])

        placed = save(vectors.select("vec_id", "x").mapInArrow(route, "vec_id long, x array<long>, cell long"))
        sizes = placed.groupBy("cell").agg(F.ceil(F.count("*") / shard).alias("salts"))  # at most SAMPLE / 8 rows
        salted = placed.join(F.broadcast(sizes), "cell").withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.col("salts")))

        def pack(key: tuple, t: pa.Table) -> pa.Table:
            t = t.sort_by("vec_id").combine_chunks()
            ids, x = t.column("vec_id").to_numpy(), _matrix(t.column("x"), dim)
            order, cuts, low, high = build_tree(x)
            row = {"ids": _blob(ids[order]), "x": _blob(x[order]), "cuts": _blob(cuts), "low": _blob(low), "high": _blob(high)}
            return pa.table({"shard": pa.array([key[0].as_py() << 32 | key[1].as_py()], pa.int64())} | {c: pa.array([v], pa.binary()) for c, v in row.items()})

        return salted.select("cell", "salt", "vec_id", "x").groupBy("cell", "salt").applyInArrow(pack, "shard long, ids binary, x binary, cuts binary, low binary, high binary")

    def _boxes(self) -> DataFrame:
        """chunk, shards, low, high: the roots' boxes, packed."""
        n = 8 * self.dim
        root = self.trees.select("shard", F.substring("low", 1, n).alias("low"), F.substring("high", 1, n).alias("high")).withColumn("chunk", F.pmod(F.xxhash64("shard"), F.lit(self.chunks)))

        def pack(key: tuple, t: pa.Table) -> pa.Table:
            return pa.table({"chunk": pa.array([key[0].as_py()], pa.int64()), "shards": [_blob(t.column("shard").to_numpy())], "low": [b"".join(t.column("low").to_pylist())], "high": [b"".join(t.column("high").to_pylist())]})

        return root.groupBy("chunk").applyInArrow(pack, "chunk long, shards binary, low binary, high binary")

    def _blocks(self, blocks: int) -> DataFrame:
        """block, ids, x: the queries, packed."""
        dim = self.dim

        def pack(key: tuple, t: pa.Table) -> pa.Table:
            t = t.sort_by("query_id").combine_chunks()
            return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "ids": [_blob(t.column("query_id").to_numpy())], "x": [_blob(_matrix(t.column("x"), dim))]})

        self.block_of = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
        return self.queries.groupBy(self.block_of.alias("block")).applyInArrow(pack, "block long, ids binary, x binary")

    def _bounded(self, blocks: DataFrame, most: int | None) -> DataFrame:
        """query_id, shard, bound of each block against each chunk of boxes: the ``most`` best of a chunk, or all that reach the kth score (known, per block)."""
        dim = self.dim

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for r in range(b.num_rows):
                    get = lambda c: np.frombuffer(b.column(c)[r].as_buffer(), "<i8")  # noqa: B023, E731
                    qid, shards = get("ids"), get("shards")
                    limit = box_bounds(get("x").reshape(-1, dim), get("low").reshape(-1, dim), get("high").reshape(-1, dim))
                    if most:
                        j = np.argsort(-limit, axis=1, kind="stable")[:, :most]
                        i = np.repeat(np.arange(len(qid)), j.shape[1])
                        j = j.ravel()
                    else:
                        kth = np.full(len(qid), LOWEST)
                        known = b.column("known")[r].as_py() or []
                        kth[np.searchsorted(qid, [e["query_id"] for e in known])] = [e["kth"] for e in known]
                        i, j = np.nonzero(limit >= kth[:, None].astype(np.float64))
                    yield pa.record_batch({"query_id": pa.array(qid[i]), "shard": pa.array(shards[j]), "bound": pa.array(limit[i, j])})

        grid = blocks.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(self.chunks - 1).cast("long")))).join(self.boxes.hint("merge"), "chunk")
        return grid.drop("chunk", "block").mapInArrow(run, "query_id long, shard long, bound double")

    def _kth(self, found: DataFrame) -> DataFrame:
        """query_id, kth: the score that counts, of queries with k results."""
        w = Window.partitionBy("query_id").orderBy(F.desc("score"))
        return found.withColumn("r", F.row_number().over(w)).where(F.col("r") == self.k).select("query_id", F.col("score").alias("kth"))

    def _visit(self, pairs: DataFrame, kth: DataFrame | None) -> DataFrame:
        """query_id, vec_id, score of what each query finds in its shards; pairs (query_id, shard)."""
        dim, k, pairs = self.dim, self.k, save(pairs)
        load = save(pairs.groupBy("shard").agg(F.count("*").alias("n"), F.ceil(F.count("*") / TOGETHER).alias("salts")))
        asked = join_groups(pairs, load, ["shard"]).withColumn("salt", F.pmod(F.xxhash64("query_id"), F.col("salts"))).select("shard", "salt", "query_id").join(self.queries, "query_id")
        asked = asked.join(kth, "query_id", "left") if kth is not None else asked.withColumn("kth", F.lit(None).cast("long"))
        held = self.trees.join(load.drop("n"), "shard").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).drop("salts")

        def look(key: tuple, q: pa.Table, s: pa.Table) -> pa.Table:
            empty = np.empty(0, np.int64)
            out: list[list[np.ndarray]] = [[empty], [empty], [empty]]
            if q.num_rows and s.num_rows:
                get = lambda c: np.frombuffer(s.column(c)[0].as_buffer(), "<i8")
                qid, bound = q.column("query_id").to_numpy(), q.column("kth").fill_null(LOWEST).to_numpy()
                tree = get("cuts"), get("low").reshape(-1, dim), get("high").reshape(-1, dim)
                for a in range(0, len(qid), 512):
                    part = slice(a, a + 512)
                    for w, i, sc in search(_matrix(q.column("x").slice(a, 512), dim), qid[part], bound[part], get("x").reshape(-1, dim), get("ids"), tree, k):
                        for o, v in zip(out, (np.full(len(i), qid[a + w]), i, sc), strict=True):
                            o.append(v)
            return pa.table({c: np.concatenate(v) for c, v in zip(("query_id", "vec_id", "score"), out, strict=True)})

        q = asked.select("shard", "salt", "query_id", "x", "kth").groupBy("shard", "salt")
        return q.cogroup(held.groupBy("shard", "salt")).applyInArrow(look, "query_id long, vec_id long, score long")

    def rest(self, found: DataFrame, top: DataFrame) -> DataFrame:
        """(query_id, shard) whose box reaches the kth score and that were not visited."""
        known = self._kth(found).groupBy(self.block_of.alias("block")).agg(F.array_sort(F.collect_list(F.struct("query_id", "kth"))).alias("known"))  # a block of rows each
        return self._bounded(self.blocks.join(known, "block", "left"), None).select("query_id", "shard").join(top.select("query_id", "shard"), ["query_id", "shard"], "left_anti")

    def first(self) -> tuple[DataFrame, DataFrame]:
        """What the queries find in their AHEAD best shards, and (query_id, shard, rank) of these."""
        w = Window.partitionBy("query_id").orderBy(F.desc("bound"), "shard")
        top = save(self._bounded(self.blocks, AHEAD).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= AHEAD))
        one = save(self._visit(top.where("rank = 1").select("query_id", "shard"), None))
        kth = self._kth(one)
        more = top.where("rank > 1").join(kth, "query_id", "left").where("kth is null or bound >= kth").select("query_id", "shard")
        return one.unionAll(save(self._visit(more, kth))), top

    def run(self) -> DataFrame:
        found, top = self.first()
        return found.unionAll(self._visit(self.rest(found, top), self._kth(found)))


def integer_vectors(df: DataFrame, scale: float = 1024.0) -> DataFrame:
    """(vec_id, x): floor(scale * component) of the vectors without null or non-finite components.

    Rows that repeat a vec_id count once (the smallest vector); rows without vec_id, null and
    empty vectors take no part.
    """
    v = F.col("embedding").cast("array<double>")
    ok = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null").where(F.col("v").isNotNull() & (F.size("v") > 0)).where(ok)
    return rows.groupBy("vec_id").agg(F.min("v").alias("v")).select("vec_id", F.transform("v", lambda x: F.floor(x * F.lit(scale)).cast("long")).alias("x"))
