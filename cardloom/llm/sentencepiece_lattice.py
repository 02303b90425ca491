"""SentencePiece encoding and decoding over a relational lattice, folded by merges for BPE models and by Viterbi for unigram models.

A text is '_' (U+2581) before it and in place of its blanks, cut into units where no piece crosses: before each
run of '_', and between characters of different classes (characters that follow each other in some piece are of one
class). Each different unit is encoded once: its substrings of at most the longest piece's length are exploded and
equi-joined to the piece table; the matching edges are grouped by unit and folded with ``aggregate``.

A unigram model folds Viterbi: the best score up to each place. A BPE model is not a best path but a sequence of
merges, so its fold takes the edges by falling score, from left to right, and keeps an edge that joins exactly
two symbols of what is there (see the README). One pass over the edges is enough if each piece comes of pieces of higher
scores; units with a piece that does not (``late_pieces``) are merged with a heap in Python. Characters that no piece holds become byte pieces.

The dictionary of units goes to flat files, sorted by hash, that the workers map into memory to encode the texts.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from cardloom.llm.common import local_path, open_fs, pieces, save, shared_dir, ship, size_bytes, worker_cache
from cardloom.llm.encoders import Learned

SPACE = "▁"
LONG = 62  # characters: a fold keeps the boundaries of a unit in 63 bits; longer units are cut in Python, by the same rules
LATIN = 0x180  # characters below it are looked up by code point where they are symbols of their own; others have an edge
UNKNOWN = 1e6  # cost of a character without a piece on a best path
_GROUPS = "spark.sql.objectHashAggregate.sortBased.fallbackThreshold"


class _Generations(dict):
    """A cache of two generations: what was used lately stays, the rest goes."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.old = most, {}

    def missing(self, keys: set) -> set:
        """Those of ``keys`` that are not held; what the older generation holds of them comes into the younger one."""
        new = keys.difference(self)
        if self.old:
            for x in [x for x in new if x in self.old]:
                self[x] = self.old[x]
                new.discard(x)
        return new

    def turn(self) -> None:
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()

    def fresh(self, keys: set) -> set:
        """Those of ``keys`` that were not met lately; now they were."""
        self.turn()
        new = self.missing(keys)
        self.update(dict.fromkeys(new))
        return new


def units_of(text: str | None, cut: re.Pattern) -> list[str]:
    return cut.findall(SPACE + text.replace(" ", SPACE)) if text else []


def unit_pattern(names: list[str]) -> re.Pattern:
    """How texts are cut for the pieces ``names``: no piece holds characters of two units.

    Classes are the connected characters of the graph of neighbours within pieces; a character of a class of its own
    is a unit of its own. Blanks go with what follows them. Pieces with a blank after another character are refused.
    """
    parent: dict[str, str] = {}

    def root(x: str) -> str:
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for name in names:
        for a, b in zip(name, name[1:], strict=False):
            if b == SPACE and a != SPACE:
                raise ValueError(f"piece {name!r} crosses words")
            if a != SPACE:
                parent[root(a)] = root(b)
    classes: dict[str, list[str]] = {}
    for x in sorted(parent):
        classes.setdefault(root(x), []).append(x)
    runs = [f"[{''.join(map(re.escape, c))}]+" for c in sorted(classes.values(), key=lambda c: (-len(c), c))]
    return re.compile(f"{SPACE}*(?:{'|'.join([*runs, f'[^{SPACE}]'])})|{SPACE}+")


def piece_names(model: str) -> list[str]:
    """Pieces that texts can match: neither bytes nor control pieces."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=model)
    return [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]


def piece_table(spark: SparkSession, model: str) -> DataFrame:
    """id, piece, score, kind (piece, byte or control) of a model file: a few ten thousand rows whatever the corpus."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=model)
    kind = lambda i: "byte" if sp.is_byte(i) else "control" if sp.is_control(i) or sp.is_unknown(i) else "piece"
    rows = [(i, sp.id_to_piece(i), float(sp.get_score(i)), kind(i)) for i in range(sp.get_piece_size())]
    return spark.createDataFrame(rows, "id int, piece string, score double, kind string")


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        x = shift = 0
        while True:
            x |= (data[at] & 127) << shift
            at, shift = at + 1, shift + 7
            if data[at - 1] < 128:
                return x

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, data[at : at + n]
            at += n


def read_model_type(model: str) -> str:
    """unigram or bpe, from the training settings in a model file; other kinds are refused."""
    with open(model, "rb") as f:
        settings = [v for k, v in _fields(f.read()) if k == 2]
    number = next((v for s in settings for k, v in _fields(s) if k == 3), 1)
    if number not in (1, 2):
        raise ValueError("only unigram and BPE models are supported")
    return ("unigram", "bpe")[number - 1]


_ID = (1 << 22) - 1  # an edge's id field: an id below 2 ** 21, or 2 ** 21 and the code point of a character without a piece


def _right(c: Column, n: int) -> Column:
    return F.call_function("shiftrightunsigned", c, F.lit(n))


def _bit(c: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), c.cast("int"))


def _start(k: Column) -> Column:
    return _right(k, 28).bitwiseAND(F.lit(63))


def _end(k: Column) -> Column:
    return _start(k) + _right(k, 22).bitwiseAND(F.lit(63))


def lattice(units: DataFrame, table: DataFrame, costs: bool = False) -> DataFrame:
    """unit, edges ARRAY<STRUCT<k, ends, inner>> (and cost, if asked for) in order of k: all pieces in each distinct unit.

    k holds from its highest bits on the rank of an edge's cost, its start, its length and its id; ends and inner have the bits of
    its two boundaries and of those between them. Units must be distinct and of 1 to LONG characters; partitioned by unit as well, nothing is shuffled: the piece table is bounded and broadcast. Substrings meet
    it by a 64-bit hash, which makes the join a look-up of numbers, and are then compared as they are. Without costs, single characters
    below LATIN have an edge at the start of a unit only.
    """
    usable = table.where("kind = 'piece'")
    longest = min(LONG, usable.agg(F.max(F.length("piece"))).first()[0] or 1)
    held = usable.select(F.col("piece").alias("p"), F.xxhash64("piece").alias("h"), F.col("id").alias("pid"), (-F.col("score")).alias("cost"), F.dense_rank().over(Window.orderBy(F.desc("score"))).alias("rank"))  # the piece table: bounded
    starts = units.select("unit", F.explode(F.sequence(F.lit(0), F.length("unit") - 1)).alias("s"))
    subs = starts.select("unit", "s", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("unit") - F.col("s")))).alias("len"))
    if not costs:
        subs = subs.where((F.col("len") > 1) | (F.col("s") == 0) | (F.ascii(F.substring(F.col("unit"), F.col("s") + 1, F.lit(1))) >= LATIN))
    subs = subs.withColumn("piece", F.substring(F.col("unit"), F.col("s") + 1, F.col("len")))
    same = (F.xxhash64("piece") == F.col("h")) & F.startswith("piece", "p") & F.startswith("p", "piece")
    found = subs.join(F.broadcast(held), same, "left").where("pid IS NOT NULL OR len = 1")
    name = F.coalesce(F.col("pid"), F.ascii("piece") + F.lit(1 << 21)).cast("long")
    k = F.coalesce("rank", F.lit(0)).cast("long") * (1 << 34) + F.col("s").cast("long") * (1 << 28) + F.col("len").cast("long") * (1 << 22) + name
    low, high = _bit(F.col("s")), _bit(F.col("s") + F.col("len"))
    edge = F.struct(k.alias("k"), (low + high).alias("ends"), (high - low - low).alias("inner"), *([F.coalesce("cost", F.lit(UNKNOWN)).alias("cost")] if costs else []))
    return found.select("unit", edge.alias("x")).groupBy("unit").agg(F.sort_array(F.collect_list("x")).alias("edges"))  # at most LONG * longest edges


def merge_fold(edges: Column, n: Column) -> Column:
    """Boundaries (bits) of the symbols after all merges, cheapest first, leftmost first."""

    def step(acc: Column, x: Column) -> Column:
        inside = acc.bitwiseAND(x["inner"])
        one = (inside != 0) & (inside.bitwiseAND(inside - 1) == 0)
        return F.when(one & (acc.bitwiseAND(x["ends"]) == x["ends"]), acc - inside).otherwise(acc)

    all_places = F.call_function("shiftrightunsigned", F.lit((1 << 63) - 1), (62 - n).cast("int"))  # bits 0 to n
    return F.aggregate(F.filter(edges, lambda x: x["inner"] != 0), all_places, step)


def viterbi_fold(edges: Column, n: Column) -> Column:
    """Boundaries (bits) of the path of least cost over edges with costs. Ties: the longer last piece.

    The state holds for each place so far its least cost and the boundaries of its path. Each place is reached, if only by
    the edge of its last character.
    """
    zero = F.struct(F.lit(0.0).alias("c"), F.lit(1).cast("long").alias("b"))

    def step(acc: Column, j: Column) -> Column:
        options = F.transform(F.filter(edges, lambda x: _end(x["k"]) == j), lambda x: F.struct((F.element_at(acc, (_start(x["k"]) + 1).cast("int"))["c"] + x["cost"]).alias("c"), _start(x["k"]).alias("s")))
        best = F.array(F.array_min(options))
        return F.concat(acc, F.transform(best, lambda y: F.struct(y["c"].alias("c"), F.element_at(acc, (y["s"] + 1).cast("int"))["b"].bitwiseOR(_bit(j)).alias("b"))))

    state = "array<struct<c:double,b:bigint>>"
    return F.element_at(F.aggregate(F.sequence(F.lit(1), n), F.array(zero).cast(state), step), -1)["b"]


def _utf8(code: Column) -> Column:
    """The bytes of a code point, as an array of numbers."""
    top = lambda k: F.call_function("shiftright", code, F.lit(6 * k))
    tail = lambda k: top(k).bitwiseAND(F.lit(63)) + 128
    return F.when(code < 0x80, F.array(code)).when(code < 0x800, F.array(top(1) + 0xC0, tail(0))).when(code < 0x10000, F.array(top(2) + 0xE0, tail(1), tail(0))).otherwise(F.array(top(3) + 0xF0, tail(2), tail(1), tail(0)))


def encode_units(units: DataFrame, table: DataFrame, model_type: str = "bpe") -> DataFrame:
    """unit, ids of each distinct unit of ``units`` (unit); units without characters must not come."""
    costs = model_type == "unigram"
    cost = {r["piece"]: (-r["score"], r["id"]) for r in table.where("kind = 'piece'").collect()}  # the piece table: bounded
    apart = F.length("unit") > LONG
    if not costs and (late := late_pieces(cost)):
        apart |= F.exists(F.array(*map(F.lit, late)), lambda p: F.contains(F.col("unit"), p))
    short = lattice(units.where(~apart), table, costs)
    byte_ids = {int(r["piece"][3:5], 16): r["id"] for r in table.where("kind = 'byte'").collect()}  # 256 rows
    unk = (table.where("kind = 'control'").orderBy("id").first() or {"id": 0})["id"]
    known = F.array(*(F.lit(byte_ids.get(i, unk)) for i in range(256)))

    n = F.length("unit")
    latin = F.array(*(F.lit(cost[chr(c)][1] if chr(c) in cost else c + (1 << 21)) for c in range(LATIN)))
    code = lambda i: F.ascii(F.substring(F.col("unit"), i + 1, F.lit(1)))

    def singles(places: Column) -> Column:
        """Start and id of the characters below LATIN, but the first, that are symbols of their own."""
        at = F.filter(F.sequence(F.lit(1), n - 1), lambda i: (F.call_function("shiftrightunsigned", places, i).bitwiseAND(F.lit(3)) == 3) & (code(i) < LATIN))
        return F.when(n > 1, F.transform(at, lambda i: i.cast("long") * (1 << 22) + F.element_at(latin, code(i) + 1))).otherwise(F.array().cast("array<bigint>"))

    def path(places: Column) -> Column:
        """Start and id of each edge on the path, from left to right."""

        on = lambda x: places.bitwiseAND(x["ends"].bitwiseOR(x["inner"])) == x["ends"]  # noqa: E731  both ends and nothing between
        edges = F.transform(F.filter("edges", on), lambda x: _start(x["k"]) * (1 << 22) + x["k"].bitwiseAND(F.lit(_ID)))
        return F.sort_array(edges if costs else F.concat(edges, singles(places)))

    fold = (viterbi_fold if costs else merge_fold)(F.col("edges"), n)
    # places as a variable: as a column the fold would be taken into the filter, and run for each edge
    found = F.element_at(F.transform(F.array(fold), path), 1)
    done = short.select("unit", F.transform(found, lambda x: x.bitwiseAND(F.lit(_ID)).cast("int")).alias("path"))

    def ids(x: Column) -> Column:
        some = F.transform(_utf8(x - (1 << 21)), lambda b: F.element_at(known, b + 1)) if byte_ids else F.array(F.lit(unk))
        return F.when(x >= 1 << 21, some).otherwise(F.array(x))

    done = done.select("unit", F.when(F.exists("path", lambda x: x >= 1 << 21), F.flatten(F.transform("path", ids))).otherwise(F.col("path")).alias("ids"))
    by = viterbi_path if costs else heap_merge
    return done.unionByName(_cut_in_python(units.where(apart), cost, byte_ids, unk, by))


def late_pieces(cost: dict[str, tuple[float, int]]) -> list[str]:
    """Pieces that merges of strictly cheaper pieces do not lead to.

    Up to a merge the part of a text between its ends evolves as if it were alone. So any other piece is there, if it ever is, when
    its turn comes in order of cost.
    """
    late = []
    for p, c in cost.items():
        if len(p) > 1:
            inner = (p[i:j] for i in range(len(p)) for j in range(i + 1, len(p) + 1))
            if heap_merge(p, {x: cost[x] for x in inner if x == p or (x in cost and cost[x][0] < c[0])}) != [p]:
                late.append(p)
    return late


def heap_merge(unit: str, cost: dict[str, tuple[float, int]]) -> list[str]:
    """The symbols after all merges, with a heap: n log n."""
    part, nxt, prev = list(unit), list(range(1, len(unit) + 1)), list(range(-1, len(unit) - 1))
    heap: list[tuple[float, int, int, str]] = []

    def offer(i: int) -> None:
        j = nxt[i]
        if j < len(part) and (c := cost.get(part[i] + part[j])):
            heapq.heappush(heap, (c[0], i, j, part[i] + part[j]))

    for i in range(len(unit) - 1):
        offer(i)
    while heap:
        _, i, j, text = heapq.heappop(heap)
        if part[i] and nxt[i] == j and part[i] + part[j] == text and part[j]:
            part[i], part[j], nxt[i] = text, "", nxt[j]
            if nxt[j] < len(part):
                prev[nxt[j]] = i
            if prev[i] >= 0:
                offer(prev[i])
            offer(i)
    return [p for p in part if p]


def viterbi_path(unit: str, cost: dict[str, tuple[float, int]], unknown: float = UNKNOWN) -> list[str]:
    """The path of ``viterbi_fold``, for long units: the same costs, order of additions and ties."""
    longest = max(map(len, cost), default=1)
    least, back = [0.0], [0]
    for j in range(1, len(unit) + 1):
        options = [(least[j - 1] + unknown, j - 1)]
        options += [(least[i] + c[0], i) for i in range(max(0, j - longest), j) if (c := cost.get(unit[i:j]))]
        x, i = min(options)
        least.append(x)
        back.append(i)
    out, j = [], len(unit)
    while j:
        out.append(unit[back[j] : j])
        j = back[j]
    return out[::-1]


def _cut_in_python(units: DataFrame, cost: dict[str, tuple[float, int]], byte_ids: dict[int, int], unk: int, cut: Callable[[str, dict[str, tuple[float, int]]], list[str]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for u in b.column("unit").to_pylist():
                ids: list[int] = []
                for p in cut(u, cost):
                    ids += [cost[p][1]] if p in cost else [byte_ids.get(x, unk) for x in p.encode()] if byte_ids else [unk]
                out.append(ids)
            yield pa.record_batch([b.column("unit"), pa.array(out, pa.list_(pa.int32()))], ["unit", "ids"])

    return units.mapInArrow(run, "unit string, ids array<int>")


def distinct_units(docs: DataFrame, cut: re.Pattern) -> DataFrame:
    """Each unit of all texts once, partitioned by unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = _Generations(200_000)  # units that were sent lately
        for b in pieces(batches):
            seen: set[str] = set()
            for t in b.column("text").to_pylist():
                seen.update(units_of(t, cut))
            if new := met.fresh(seen):
                yield pa.record_batch([pa.array(list(new), pa.string())], ["unit"])

    return docs.select("text").mapInArrow(run, "unit string").distinct()


def write_dictionary(words: DataFrame, path: str, shards: int) -> None:
    """``words`` (unit, ids) as files NAME.h (sorted 64-bit hashes), NAME.o (64-bit offsets), NAME.i (32-bit ids), one set a shard.

    A task writes under a name of its own attempt and then moves the files in place.
    """
    fs, folder = open_fs(path)
    fs.create_dir(folder, recursive=True)
    keyed = words.select(F.xxhash64("unit").alias("h"), "ids").withColumn("shard", F.pmod("h", F.lit(shards)).cast("int"))

    def put(key: tuple, t: pa.Table) -> pa.Table:
        import uuid

        fs, folder = open_fs(path)
        t = t.sort_by("h").combine_chunks()
        ids = t.column("ids").combine_chunks()
        lengths = np.r_[0, np.cumsum(np.diff(ids.offsets.to_numpy()))].astype("<i8")
        flat, own = ids.flatten().to_numpy().astype("<u4"), uuid.uuid4().hex
        for e, x in (("h", t.column("h").to_numpy().astype("<i8")), ("o", lengths), ("i", flat)):
            with fs.open_output_stream(f"{folder}/{own}.{e}") as f:
                f.write(x.tobytes())
            fs.move(f"{folder}/{own}.{e}", f"{folder}/{key[0].as_py()}.{e}")
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "n": pa.array([t.num_rows], pa.int64())})

    keyed.groupBy("shard").applyInArrow(put, "shard int, n long").agg(F.sum("n")).collect()


class Dictionary:
    """Ids of texts, from the files of ``write_dictionary`` for their units."""

    def __init__(self, path: str, shards: int, cut: re.Pattern):
        self.path, self.shards, self.cut, self.open = path, shards, cut, {}
        self.units = Learned(300_000, self.learn)

    def shard(self, i: int) -> tuple[np.ndarray, memoryview, memoryview]:
        """Hashes, offsets, and the bytes of the ids."""
        if i not in self.open:
            p = local_path(self.path)
            parts = []
            for e, t in (("h", "<i8"), ("o", "<i8"), ("i", "u1")):
                if p is not None:
                    parts.append(np.memmap(f"{p}/{i}.{e}", t, "r").view(np.ndarray))
                else:
                    fs, folder = open_fs(self.path)
                    parts.append(np.frombuffer(fs.open_input_file(f"{folder}/{i}.{e}").read(), t))
            self.open[i] = parts[0], memoryview(parts[1]), memoryview(parts[2])
        return self.open[i]

    def learn(self, unit: str) -> bytes:
        h = xxh64_intdigest(unit.encode(), 42)
        h -= (h >> 63) << 64
        keys, offsets, ids = self.shard(h % self.shards)
        at = int(keys.searchsorted(h))
        if at == len(keys) or keys[at] != h:
            raise KeyError(f"unit {unit!r} is missing from the dictionary")
        return bytes(ids[4 * offsets[at] : 4 * offsets[at + 1]])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        get = self.units.__getitem__
        return [b"".join(map(get, units_of(t, self.cut))) for t in texts]


@contextmanager
def _many_groups(spark: SparkSession, groups: int):
    """A task groups up to so many units in memory before it sorts them."""
    before = spark.conf.get(_GROUPS)
    spark.conf.set(_GROUPS, str(groups))
    try:
        yield
    finally:
        spark.conf.set(_GROUPS, before)


def encode(docs: DataFrame, model: str, with_ids: bool = False, with_text: bool = False, model_type: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (unsigned 32-bit ids) and, if asked for, the ids and the text that these decode to, of each row of ``docs`` (doc_id, text).

    model_type: unigram or bpe, by default what the model file says. Null and empty texts have no ids. Rows are independent,
    so repeated ones repeat; rows without doc_id are encoded too; an empty table gives an empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    table, cut = piece_table(spark, model), unit_pattern(piece_names(model))
    shards = max(8, size_bytes(docs) // (64 << 20))
    path = shared_dir(spark) + "-units"
    units = save(distinct_units(docs, cut))
    n = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), size_bytes(units) // (512 << 10))
    with _many_groups(spark, 50_000):
        write_dictionary(encode_units(units.repartition(n, "unit"), table, model_type or read_model_type(model)), path, shards)
    return _encode_texts(docs, path, shards, cut, with_ids, spelling(table) if with_text else None)


def _encode_texts(docs: DataFrame, path: str, shards: int, cut: re.Pattern, with_ids: bool, spells: dict[int, bytes] | None) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = worker_cache()
        if "pieces" not in cache or cache["pieces"].path != path:  # a worker holds one dictionary, that of the latest run
            cache["pieces"] = Dictionary(path, shards, cut)
        known = cache["pieces"]
        for b in pieces(batches):
            ids = known.encode(b.column("text").to_pylist())
            cols = [b.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([crc32(x) for x in ids], pa.int64())]
            if with_ids:
                offsets = np.r_[0, np.cumsum([len(x) // 4 for x in ids])].astype(np.int32)
                cols.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), "<i4"))))
            if spells:
                cols.append(pa.array([spell(np.frombuffer(x, "<i4").tolist(), spells) for x in ids], pa.string()))
            yield pa.record_batch(cols, ["doc_id", "n_tokens", "ids_crc32", *["ids"] * with_ids, *["text"] * bool(spells)])

    schema = T.StructType([docs.schema["doc_id"]]).add("n_tokens", "long").add("ids_crc32", "long")
    if with_ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType()))
    if spells:
        schema = schema.add("text", "string")
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def spelling(table: DataFrame) -> dict[int, bytes]:
    """The bytes that each id stands for; none for control pieces."""
    one = lambda r: bytes([int(r["piece"][3:5], 16)]) if r["kind"] == "byte" else b"" if r["kind"] == "control" else r["piece"].replace(SPACE, " ").encode()
    return {r["id"]: one(r) for r in table.collect()}  # the piece table: bounded


def spell(ids: list[int], spells: dict[int, bytes]) -> str:
    """The text of ids: broken UTF-8 becomes U+FFFD, and the leading blank goes."""
    t = b"".join(map(spells.__getitem__, ids))
    return (t[1:] if t.startswith(b" ") else t).decode("utf-8", "replace")


def decode(rows: DataFrame, model: str) -> DataFrame:
    """The columns of ``rows`` but ids and text, then text: what the ids of each row spell.

    Byte pieces give their bytes, control pieces nothing. No or null ids give ''. Nothing is shuffled: the piece table is
    bounded and goes to the workers.
    """
    ship(rows.sparkSession)
    keep = [c for c in rows.columns if c not in ("ids", "text")]
    spells = spelling(piece_table(rows.sparkSession, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [spell(x.values.to_pylist() if x.is_valid else [], spells) for x in b.column("ids")]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(texts, pa.string())], [*keep, "text"])

    return rows.select(*keep, "ids").mapInArrow(run, T.StructType([rows.schema[c] for c in keep]).add("text", "string"))
