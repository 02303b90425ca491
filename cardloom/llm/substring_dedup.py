"""Substring dedup with repeated-phrase automata.

1. Every window of ``window`` words is hashed. Within a stretch of the input all copies of a window but
   those in its first document are settled at once; the rest goes, packed, to the bin of its hash. Bins are ranges of the
   top bits: one shuffle deals to at most 2 ** FAN of them, and where more are needed a second one deals each of these again.
2. A bin sorts its hashes. A window that several documents hold is a recurring passage; the smallest
   doc_id owns it. (owner, block of 64 places, group of documents, places) rows say which group needs what.
3. Owners cut these blocks out of their texts, once each; rows of (block, group) bring them to the groups. Documents with candidates
   go to their own group; all others are finished.
4. Each group is a shard: an Aho-Corasick automaton over parts of its passages, through which its documents are
   streamed; what it finds is extended word by word. Only windows found so are removed.

A group holds a fixed share of the documents by hash, so no passage, however common, makes a group large:
a passage in a third of all documents is one pattern in each group, and no row holds a list of groups.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType, _parse_datatype_string

from cardloom.llm.common import _GOLD, fmix, pieces, save, shingles, ship, size_bytes, words_of

WINDOW = 13
PATTERNS = 60_000  # in one automaton
FAN = 12  # bits that one shuffle deals by
BIN_BYTES, GROUP_BYTES = 8 << 20, 1 << 20  # of the input, for each bin and for each group
_LOW = 48  # bits of a hash that travel; with the bin's they tell windows apart, and automata confirm what is found
_WORD = re.compile(rb"[\x20\x09-\x0d]*[^\x20\x09-\x0d]+")


def group_of(ids: np.ndarray, groups: int) -> np.ndarray:
    return (fmix(ids.astype(np.int64).view(np.uint64) ^ _GOLD) % np.uint64(groups)).astype(np.int32)


def _zip(b: bytes) -> bytes:
    """A text for a shuffle: the length and the text by zstd, which halves it once more than Spark's codec."""
    return len(b).to_bytes(4, "little") + pa.compress(b, codec="zstd", asbytes=True)


def _unzip(b: bytes) -> bytes:
    return pa.decompress(b[4:], int.from_bytes(b[:4], "little"), codec="zstd", asbytes=True)


def _squeeze(x: np.ndarray) -> bytes:
    return pa.compress(x.tobytes(), codec="zstd", asbytes=True)


def _expand(b: bytes, n: int, dtype: str) -> np.ndarray:
    return np.frombuffer(pa.decompress(b, n * np.dtype(dtype).itemsize, codec="zstd", asbytes=True), dtype)


def needs(owner: np.ndarray, at: np.ndarray, grp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """owner, block, group and the places needed, as bits of the block's 64, each once."""
    block = at >> 6
    o = np.lexsort((grp, block, owner))
    owner, block, grp = owner[o], block[o], grp[o]
    heads = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (block[1:] != block[:-1]) | (grp[1:] != grp[:-1])]) if len(o) else o
    bits = np.left_shift(np.uint64(1), (at[o] & 63).astype(np.uint64))
    mask = np.bitwise_or.reduceat(bits, heads) if len(o) else bits
    return owner[heads], block[heads].astype(np.int32), grp[heads], mask.view(np.int64)


def settle(h: np.ndarray, doc: np.ndarray, at: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places (among the windows given) that belong to the smallest document of their hash; doc_ids with other places; and
    (owner, place, group) of the passages that those need."""
    o = np.argsort(h)
    hs = h[o]
    head = np.r_[True, hs[1:] != hs[:-1]] if len(hs) else np.empty(0, bool)
    starts = np.flatnonzero(head)
    n = np.diff(np.r_[starts, len(hs)])
    if (n > 1).any():
        many = np.repeat(n > 1, n)
        sub = o[many]  # only windows that occur again
        run = np.repeat(np.arange(int((n > 1).sum())), n[n > 1])
        s2 = np.r_[0, np.cumsum(n[n > 1])[:-1]]
        low = np.minimum.reduceat(doc[sub], s2)
        mine = doc[sub] == low[run]
        # the first place in the smallest document stands for the passage
        place = np.full(len(low), np.iinfo(np.int64).max)
        np.minimum.at(place, run[mine], at[sub][mine])
        other = ~mine
        settled = sub[other]
        keep = np.ones(len(h), bool)
        keep[settled] = False
        r = run[other]
        return keep, np.unique(doc[settled]), (low[r], place[r], group_of(doc[settled], groups))
    return np.ones(len(h), bool), np.empty(0, np.int64), (np.empty(0, np.int64),) * 2 + (np.empty(0, np.int32),)


_FOUND = {"doc_id": pa.int64(), "block": pa.int32(), "grp": pa.int32(), "mask": pa.int64()}
_PACKED = {"bin": pa.int32(), "n": pa.int32(), "docs": pa.binary(), "at": pa.binary(), "h": pa.binary()}


def _answers(hits: np.ndarray, owned: tuple[np.ndarray, np.ndarray, np.ndarray]) -> dict[str, pa.Array]:
    """Rows of what was settled: a hit document has block and group -1."""
    none = np.full(len(hits), -1, np.int32)
    owner, block, grp, mask = needs(*owned)
    cols = (hits, owner), (none, block), (none, grp), (np.zeros(len(hits), np.int64), mask)
    return {c: pa.array(np.concatenate(v), t) for (c, t), v in zip(_FOUND.items(), cols, strict=True)}


def _batch(cols: dict[str, pa.Array | list], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    n = len(next(iter(cols.values())))
    return pa.record_batch({c: v if isinstance(v := cols.get(c, [None] * n), pa.Array) else pa.array(v, t) for c, t in types.items()})


def _pack(where: np.ndarray, h: np.ndarray, doc: np.ndarray, at: np.ndarray) -> dict[str, list]:
    """A row for each bin that occurs: its windows in order of document and place, as differences."""
    out: dict[str, list] = {c: [] for c in _PACKED}
    o = np.lexsort((at, doc, where))
    where, h, doc, at = where[o], h[o], doc[o], at[o]
    cuts = np.r_[np.flatnonzero(np.r_[True, where[1:] != where[:-1]]), len(where)] if len(where) else np.zeros(1, np.int64)
    low = h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : _LOW // 8]
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        x, y = doc[a:b], at[a:b]
        new = np.r_[True, x[1:] != x[:-1]]
        gap = np.where(new, y, np.r_[0, y[1:] - y[:-1]])
        heads = np.flatnonzero(new)
        size = np.diff(np.r_[heads, len(x)])
        table = np.concatenate([np.r_[x[heads][:1], np.diff(x[heads])].astype("<i8"), size.astype("<i8")])
        row = int(where[a]), b - a, np.array([len(heads)], "<i4").tobytes() + _squeeze(table), _squeeze(gap.astype("<i4")), low[a:b].tobytes()
        for c, v in zip(_PACKED, row, strict=True):
            out[c].append(v)
    return out


def _unpack(n: int, docs: bytes, at: bytes, h: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Low bits of the hashes, documents and places of a packed row."""
    k = int(np.frombuffer(docs[:4], "<i4")[0])
    table = _expand(docs[4:], 2 * k, "<i8")
    doc = np.repeat(np.cumsum(table[:k]), table[k:])
    gap = _expand(at, n, "<i4").astype(np.int64)
    total = np.cumsum(gap)
    heads = np.r_[0, np.cumsum(table[k:])[:-1]]
    low = np.zeros((n, 8), np.uint8)
    low[:, : _LOW // 8] = np.frombuffer(h, np.uint8).reshape(-1, _LOW // 8)
    return low.view("<u8").ravel(), doc, total - np.repeat(total[heads] - gap[heads], table[k:])


def _by_bin(batches: Iterator[pa.RecordBatch], most: int | None = None) -> Iterator[pa.RecordBatch | tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Batches of settled rows as they are, and (bin, hashes, documents, places) of each bin in turn, or of at most about ``most`` windows of it."""
    now, held, size = None, [], 0
    whole = lambda: (now, *(np.concatenate(x) for x in zip(*held, strict=True)))
    for b in batches:
        packed = b.column("n").is_valid()
        if (settled := b.filter(pc.invert(packed))).num_rows:
            yield settled.select(list(_FOUND))
        for r in b.filter(packed).select(list(_PACKED)).to_pylist():
            if held and (r["bin"] != now or (most and size >= most)):
                yield whole()
                held, size = [], 0
            now = r["bin"]
            held.append(_unpack(r["n"], r["docs"], r["at"], r["h"]))
            size += r["n"]
    if held:
        yield whole()


def find_recurring(docs: DataFrame, window: int, size: int, groups: int, fan: int = FAN) -> DataFrame:
    """doc_id, block, grp, mask: documents with a recurring window of a smaller document (block and grp -1), and the places in
    blocks of 64 that groups need of the documents that own them."""
    bits = max(6, int(np.ceil(np.log2(max(1, size // BIN_BYTES)))))
    first = min(bits, fan)
    second = min(bits - first, fan)
    types = _PACKED | _FOUND
    schema = "bin int, n int, docs binary, at binary, h binary, doc_id long, block int, grp int, mask long"

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, most=8 << 20):
            w = words_of(b)
            h, d, start = shingles(w.hashes(), w.first, window, False)
            at = start - w.first[d]
            doc = b.column("doc_id").to_numpy()[d]
            keep, hits, owned = settle(h, doc, at, groups)
            mine = _answers(hits, owned)
            if len(mine["doc_id"]):
                yield _batch({"bin": pa.array(np.arange(len(mine["doc_id"]), dtype=np.int32) % (1 << first)), **mine}, types)
            h, doc, at = h[keep], doc[keep], at[keep]
            if len(h):
                yield _batch(_pack((h >> np.uint64(64 - first)).astype(np.int32), h, doc, at), types)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _by_bin(batches, 4 << 20):
            if isinstance(x, pa.RecordBatch):
                yield _batch({"bin": pa.array(np.arange(x.num_rows, dtype=np.int32) % (1 << (first + second))), **{c: x.column(c) for c in _FOUND}}, types)
            else:
                now, h, doc, at = x
                yield _batch(_pack((now << second) + (h >> np.uint64(_LOW - second)).astype(np.int32), h, doc, at), types)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _by_bin(batches):
            yield x if isinstance(x, pa.RecordBatch) else _batch(_answers(*settle(*x[1:], groups)[1:]), _FOUND)

    sent = docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(send, schema)
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = min(200_000, max(least, (1 << (first + second)) // 4))
    if second:
        salts = max(1, (2 * size >> first) // (64 << 20))  # a bin of the first shuffle is no single task
        sent = sent.repartition(n, F.col("bin"), F.pmod(F.xxhash64("h"), F.lit(salts))).sortWithinPartitions("bin").mapInArrow(split, schema)
    met = sent.repartition(n, "bin").sortWithinPartitions("bin").mapInArrow(meet, "doc_id long, block int, grp int, mask long")
    return met.groupBy("doc_id", "block", "grp").agg(F.bit_or("mask").alias("mask"))


def places_of(block: int, mask: int) -> list[int]:
    """The places that the bits of a block's mask stand for."""
    return [64 * block + i for i in range(64) if mask >> i & 1]


def build_automata(passages: list[tuple[int, int, list[int], list[bytes]]], window: int, most: int = PATTERNS) -> list[tuple[dict[bytes, str], list[tuple[int, str]], object]]:
    """Letters for words, runs (doc_id, letters) and an automaton over parts of these runs; of at most about ``most`` patterns each.

    passages: doc_id, place of the first word, places of windows, words. A run is the text of windows that follow each other. Its
    patterns are the words that begin every (window + 1) / 2 words: any window holds one of them whole. A pattern's value is the list of
    its (run, place). Each automaton has letters of its own, so that they stay few.
    """
    import ahocorasick

    part = (window + 1) // 2
    out: list = []
    ids: dict[bytes, str] = {}
    runs: list[tuple[int, str]] = []
    patterns: dict[str, list[tuple[int, int]]] = {}

    def close() -> None:
        a = ahocorasick.Automaton(ahocorasick.STORE_ANY)
        for k, places in patterns.items():
            a.add_word(k, places)
        a.make_automaton()
        out.append((ids, runs, a))

    for doc, first, places, words in passages:
        if len(patterns) >= most:
            close()
            ids, runs, patterns = {}, [], {}
        for w in words:
            if w not in ids:
                n = len(ids) + 1
                ids[w] = chr(n if n < 0xD800 else n + 0x800)  # surrogates are no letters
        seq = "".join([ids[w] for w in words])
        cuts = [0, *(i for i in range(1, len(places)) if places[i] != places[i - 1] + 1), len(places)]
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            text = seq[places[x] - first : places[y - 1] - first + window]
            if len(text) >= window:
                for o in range(0, len(text) - part + 1, part):
                    patterns.setdefault(text[o : o + part], []).append((len(runs), o))
                runs.append((doc, text))
    if patterns:
        close()
    return out


def covered(words: list[bytes], doc: int, automata: list, window: int) -> np.ndarray:
    """Which words lie in a window that starts in a smaller document.

    Each pattern found is extended to both sides, word by word, as far as the text and the run agree.
    """
    n, part = len(words), (window + 1) // 2
    edge = np.zeros(n + 1, np.int32)
    for ids, runs, a in automata:
        letter = ids.get
        seq = "".join([letter(w, "\0") for w in words])
        done: dict[tuple[int, int], int] = {}  # run and where it would begin here: up to where they were compared
        for end, places in a.iter(seq):
            for r, o in places:
                owner, text = runs[r]
                begin = end - part + 1 - o
                if owner >= doc or done.get((r, begin), -1) >= end:
                    continue
                k = min(end - part + 1, o)
                if seq[end - part + 1 - k : end - part + 1] != text[o - k : o]:
                    k = 0
                    while k < min(end - part + 1, o) and seq[end - part - k] == text[o - 1 - k]:
                        k += 1
                to, m = o + part, min(n - end - 1, len(text) - o - part)
                if seq[end + 1 : end + 1 + m] != text[to : to + m]:
                    m = 0
                    while seq[end + 1 + m] == text[to + m]:
                        m += 1
                done[r, begin] = end + m
                if k + part + m >= window:
                    edge[end - part + 1 - k] += 1
                    edge[end + 1 + m] -= 1
    return np.cumsum(edge[:-1]) > 0


def without(text: bytes, gone: np.ndarray) -> bytes:
    """The text less the words that are gone and the white space before them."""
    parts = _WORD.findall(text)
    tail = text[sum(map(len, parts)) :]
    return (b"".join([p for p, g in zip(parts, gone.tolist(), strict=True) if not g]) + tail).strip()


def _table(rows: list[dict], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in types.items()], list(types))


def locate(batches: Iterator[pa.RecordBatch], types: dict[str, pa.DataType], window: int, with_text: bool) -> Iterator[pa.RecordBatch]:
    """Rows in order of group and kind: passages (0) make the group's automata, through which its documents (1) go; finished ones (2) pass."""
    now, passages, built = None, [], None
    for b in batches:
        rows = []
        for r in b.to_pylist():
            if r["kind"] == 2:
                rows.append(r | {"text": _unzip(r["text"]) if r["text"] else None})
                continue
            if r["grp"] != now:
                now, passages, built = r["grp"], [], None
            if r["kind"] == 0:
                passages.append((r["doc_id"], r["first"], places_of(r["block"], r["mask"]), r["text"].split()))
                continue
            if built is None:
                built, passages = build_automata(passages, window), []
            raw = _unzip(r["text"]) if r["text"] else b""
            words = raw.split()
            gone = covered(words, r["doc_id"], built, window)
            kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])
            text = (without(raw, gone) if gone.any() else raw) if with_text else None
            rows.append(r | {"n_words": len(words), "n_removed": int(gone.sum()), "kept_sha256": sha256(kept).hexdigest(), "text": text})
        if rows:
            yield _table(rows, types)


def remove_repeated(docs: DataFrame, window: int = WINDOW, with_text: bool = False, fan: int = FAN) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space) for each row of ``docs`` (doc_id, text).

    A word goes if a window of ``window`` words that covers it also starts in a document with a smaller
    doc_id. Null texts have no words. Rows repeated under a doc_id do not remove each other's words. Rows
    without doc_id stay whole and remove nothing. An empty table gives an empty result.

    with_text: also text, where the kept words have the white space that stood before them (untouched if no
    word went), and rest, a struct of all other columns of ``docs``.
    """
    spark = docs.sparkSession
    ship(spark)
    size = size_bytes(docs)
    groups = int(min(max(64, size // GROUP_BYTES), (1 << 31) - 1))
    other = [c for c in docs.columns if c not in ("doc_id", "text")] if with_text else []
    rest = F.struct(*(F.col(f"`{c}`") for c in other)) if other else F.lit(None).cast("string")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", rest.alias("rest"))
    found = save(find_recurring(docs, window, size, groups, fan))
    wanted = found.groupBy("doc_id", "block").agg(F.bit_or("mask").alias("mask"))
    owned = F.col("block") >= 0
    wanted = wanted.groupBy("doc_id").agg(F.max(~owned).alias("hit"), F.collect_list(F.when(owned, F.struct("block", "mask"))).alias("blocks"))  # a document's own blocks
    plain = "grp int, kind int, doc_id long, block int, mask long, first int, n_words int, n_removed int, kept_sha256 string, text binary"
    schema = StructType(list(_parse_datatype_string(plain))).add("rest", docs.schema["rest"].dataType, True)
    names = [f.name for f in schema]
    types = {f.name: to_arrow_type(f.dataType) for f in schema}

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            z = pa.array([None if t is None else _zip(t.encode()) for t in b.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), z, b.column("rest")], ["doc_id", "z", "rest"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, held = [], 0
            own = group_of(b.column("doc_id").fill_null(0).to_numpy(), groups).tolist()
            for i, r in enumerate(b.to_pylist()):
                doc, raw = r["doc_id"], _unzip(r["z"]) if r["z"] else b""
                held += len(raw)
                words = raw.split()
                for x in r["blocks"] or ():
                    places = places_of(x["block"], x["mask"])
                    text = b" ".join(words[places[0] : places[-1] + window])
                    if text:
                        rows.append({"kind": 0, "doc_id": doc, "block": x["block"], "first": places[0], "text": text})
                if r["hit"]:
                    rows.append({"grp": own[i], "kind": 1, "doc_id": doc, "text": r["z"], "rest": r["rest"]})
                else:
                    rows.append({"grp": own[i], "kind": 2, "doc_id": doc, "n_words": len(words), "n_removed": 0, "kept_sha256": sha256(b" ".join(words)).hexdigest(), "text": (r["z"] or _zip(b"")) if with_text else None, "rest": r["rest"]})
                if len(rows) >= 512 or held > 4 << 20:
                    yield _table(rows, types)
                    rows, held = [], 0
            if rows:
                yield _table(rows, types)

    n = min(200_000, max(int(spark.conf.get("spark.sql.shuffle.partitions")), groups // 16))
    small = docs.mapInArrow(shrink, StructType([docs.schema["doc_id"]]).add("z", "binary").add("rest", docs.schema["rest"].dataType, True))
    dealt = save(small.join(wanted.hint("merge"), "doc_id", "left").select("doc_id", "z", "rest", "hit", "blocks").mapInArrow(deal, schema))
    # a block goes to each group that needs it; a block that all groups need is split between tasks by adaptive execution
    cut = dealt.where("kind = 0").select("doc_id", "block", "first", "text")
    sent = found.where(owned).join(cut.hint("merge"), ["doc_id", "block"]).withColumn("kind", F.lit(0))
    sent = sent.select(*(F.col(c) if c in (*_FOUND, "kind", "first", "text") else F.lit(None).cast(schema[c].dataType).alias(c) for c in names))

    done = dealt.where("kind > 0").unionByName(sent).repartition(n, "grp").sortWithinPartitions("grp", "kind").mapInArrow(lambda x: locate(x, types, window, with_text), schema)
    return done.select("doc_id", F.col("n_words").cast("long").alias("n_words"), F.col("n_removed").cast("long").alias("n_removed"), "kept_sha256", *([F.decode("text", "UTF-8").alias("text"), "rest"] if with_text else []))
