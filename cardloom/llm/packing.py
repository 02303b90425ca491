"""Best-fit packing by a configuration linear program over the histogram of lengths.

A configuration is a multiset of lengths that fits one sequence. The program asks for the fewest
configurations that cover every length as often as it occurs. It is solved by multiplicative weights:
each length has a price that falls as the length gets covered, a knapsack by dynamic programming finds
the dearest configurations, and these are used a little more. The fractional solution is rounded down,
and what is left is packed by best fit, each sequence filled as far as a subset-sum over the remaining
lengths allows. All this works on the histogram, at most ``capacity`` numbers, so it runs on the driver;
pieces get their places by their rank within their length.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cardloom.llm.common import pieces, save, ship
from cardloom.llm.encoders import encode_column

CAPACITY = 2048
Config = tuple[tuple[int, int], ...]


def knapsack(lengths: np.ndarray, price: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """best[c]: the highest total price within c; last[c]: the place of a length that reaches it, -1 if c - 1 does as well."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for c in range(int(lengths[0]), capacity + 1):
        v = best[c - lengths[: fits[c]]] + price[: fits[c]]
        i = int(v.argmax())
        if v[i] > best[c - 1]:
            best[c], last[c] = v[i], i
        else:
            best[c] = best[c - 1]
    return best, last


def trace(lengths: np.ndarray, last: np.ndarray, c: int) -> list[int]:
    out = []
    while c > 0:
        if last[c] < 0:
            c -= 1
        else:
            out.append(int(last[c]))
            c -= int(lengths[last[c]])
    return out


def fractional(lengths: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = 60, each: int = 96) -> dict[Config, float]:
    """How often to use each configuration, nearly optimal; lengths ascend."""
    need = counts.astype(float)
    covered = np.zeros(len(need))
    use: dict[Config, float] = {}
    eta = np.log(len(need) + 1) + 2
    for r in range(rounds):
        # the price of a length is about its share of a sequence, higher while it lags behind
        lag = (r + 1) / rounds - covered / need
        price = lengths / capacity * np.exp(np.clip(eta * lag, -3, 3))
        best, last = knapsack(lengths, price, capacity)
        forced = price + best[capacity - lengths]  # the best that a configuration with this length reaches
        order = np.lexsort((-forced, -np.round(lag, 3)))[:each]  # those that lag most come first
        step = 1.0 / rounds
        for i in order:
            if covered[i] >= need[i] * min(1.0, (r + 1.5) / rounds):
                continue
            places, times = np.unique([int(i), *trace(lengths, last, int(capacity - lengths[i]))], return_counts=True)
            much = max(0.0, float(((need[places] * min(1.0, (r + 2) / rounds) - covered[places]) / times).min()))
            much = max(much, 0.02 * step * float((need[places] / times).min()))
            much = min(much, float(((need[places] - covered[places]) / times).clip(0).min()))
            if much <= 0:
                continue
            covered[places] += much * times
            c = tuple((int(lengths[p]), int(t)) for p, t in zip(places, times, strict=True))
            use[c] = use.get(c, 0.0) + much
    return use


def fill(left: dict[int, int], capacity: int) -> Config:
    """The largest length that is left, and what fills the rest best; larger lengths are preferred."""
    first = max(left)
    room = capacity - first
    names = sorted((x for x in left if x <= room), reverse=True)
    reach, steps = 1, []
    mask = (1 << (room + 1)) - 1
    for x in names:
        before = reach
        for _ in range(min(left[x] - (x == first), room // x)):
            more = (reach | reach << x) & mask
            if more == reach:
                break
            reach = more
        steps.append((x, before))
        if reach >> room & 1:
            break
    at, got = reach.bit_length() - 1, {first: 1}
    for x, before in reversed(steps):
        while not before >> at & 1:
            got[x] = got.get(x, 0) + 1
            at -= x
    return tuple(sorted(got.items()))


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[Config, int]]:
    """Configurations and how many sequences have each; together they hold each length exactly as often as it occurs."""
    left = {x: n for x, n in histogram.items() if n > 0}
    if any(not 0 < x <= capacity for x in left):
        raise ValueError("a length is outside 1 to the capacity")
    out: dict[Config, int] = {}
    if capacity in left:
        out[((capacity, 1),)] = left.pop(capacity)
    if left:
        lengths = np.array(sorted(left))
        use = fractional(lengths, np.array([left[x] for x in lengths]), capacity)
        waste = lambda c: capacity - sum(x * t for x, t in c)
        for c, much in sorted(use.items(), key=lambda e: (waste(e[0]), -e[1], e[0])):
            if waste(c) > capacity // 256:
                continue
            m = min(int(much), *(left.get(x, 0) // t for x, t in c))
            if m > 0:
                out[c] = out.get(c, 0) + m
                for x, t in c:
                    left[x] -= m * t
        left = {x: n for x, n in left.items() if n}
    while left:
        c = fill(left, capacity)
        m = min(left[x] // t for x, t in c)
        out[c] = out.get(c, 0) + m
        for x, t in c:
            left[x] -= m * t
            if not left[x]:
                del left[x]
    return list(out.items())


def lanes(configs: list[tuple[Config, int]]) -> dict[str, np.ndarray]:
    """For each length in turn the runs of ranks that share a place: sequence = base + rank - first, offset."""
    rows, base = [], 0
    for c, m in configs:
        offset = 0
        for x, t in sorted(c, reverse=True):
            for _ in range(t):
                rows.append((x, m, base, offset))
                offset += x
        base += m
    rows.sort(key=lambda r: r[0])
    length, many, base_, offset_ = (np.array([r[i] for r in rows], np.int64) for i in range(4))
    total = np.cumsum(many) - many
    head = np.r_[True, length[1:] != length[:-1]] if len(rows) else np.empty(0, bool)
    first = total - np.repeat(total[head], np.diff(np.r_[np.flatnonzero(head), len(rows)])) if len(rows) else total
    return {"length": length, "first": first, "base": base_, "offset": offset_}


def cut_pieces(docs: DataFrame, tokenizer: str, kind: str = "byte", end: int = 0, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and the ids as little-endian unsigned 32-bit bytes) of the pieces of each text.

    A null text counts as empty: its only id is ``end``. A document longer than ``capacity`` is cut so that
    all its pieces but the first are full.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            rows, who = [], []
            for i, x in enumerate(encode_column(b.column("text"), tokenizer, kind, end)):
                n, at, piece = len(x) // 4, 0, 0
                size = n % capacity or min(n, capacity)
                while at < n:
                    part = x[4 * at : 4 * (at + size)]
                    rows.append((piece, at, size, crc32(part), part if with_ids else None))
                    who.append(i)
                    at, piece, size = at + size, piece + 1, capacity
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(who)), pa.array(cols[0], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[1:4]), *([pa.array(cols[4], pa.binary())] if with_ids else [])], ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def pack(rows: DataFrame, capacity: int = CAPACITY, group: int = 20_000) -> DataFrame:
    """``rows`` (doc_id, piece, start, length, ids_crc32, and any other columns) with sequence_id and offset, which replace columns of these names.

    Ranks within a length are counted in salted groups of about ``group`` rows, so that a length that a
    third of all pieces share is no single task. Equal rows are interchangeable. No rows, no sequences.
    """
    spark = rows.sparkSession
    ship(spark)
    cols = [c for c in rows.columns if c not in ("sequence_id", "offset")]
    # names of its own for all columns, so that no further column of the caller's clashes
    own = {c: f"c{i}" for i, c in enumerate(cols)}
    kept = save(rows.select(*(F.col(f"`{c}`").alias(n) for c, n in own.items())))
    length, order = own["length"], [own[c] for c in ("doc_id", "piece", "start", "ids_crc32")]
    counts = {r[0]: r[1] for r in kept.groupBy(length).agg(F.count("*")).collect()}  # at most `capacity` rows
    table = lanes(plan(counts, capacity))
    salts = max(1, sum(counts.values()) // group)
    salted = kept.withColumn("salt", F.pmod(F.xxhash64(order[0], order[1]), F.lit(salts)))
    size = salted.groupBy(length, "salt").agg(F.count("*").alias("n"))
    before = size.select(length, "salt", (F.sum("n").over(Window.partitionBy(length).orderBy("salt")) - F.col("n")).alias("before"))
    rank = F.row_number().over(Window.partitionBy(length, "salt").orderBy(*order)) - 1
    ranked = salted.withColumn("rank", rank).join(before, [length, "salt"]).withColumn("rank", (F.col("rank") + F.col("before")).cast("long"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = np.int64(1) << 48
        keys = table["length"] * step + table["first"]
        for b in batches:
            long, rank = b.column(length).to_numpy(), b.column("rank").to_numpy()
            at = np.searchsorted(keys, long * step + rank, "right") - 1
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in own.values()), pa.array(table["base"][at] + rank - table["first"][at]), pa.array(table["offset"][at])], [*own.values(), "sequence_id", "offset"])

    schema = StructType([kept.schema[n] for n in own.values()]).add("sequence_id", "long").add("offset", "long")
    done = ranked.select(*own.values(), "rank").mapInArrow(place, schema)
    return done.select(*(F.col(n).alias(c) for c, n in own.items()), "sequence_id", "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, n_tokens, ids (bytes) and doc_ids of each sequence, from pieces packed with their ids."""
    s = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "length", "doc_id", "ids"))).alias("p"))  # at most `capacity` ids each
    return s.select("sequence_id", F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x["length"]).alias("n_tokens"), F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"), F.transform("p", lambda x: x["doc_id"]).alias("doc_ids"))
