"""What the operators share: the shared folder, shipped code, and word hashing with numpy.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D, which is how ``bytes.split`` cuts.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cardloom.storage import save, shared_dir  # noqa: F401  the operators take these from here

PIECE_BYTES = 2 << 20
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_GOLD, _S33 = np.uint64(0x9E3779B97F4A7C15), np.uint64(33)


#: Session settings that bound memory whatever the length of texts: bytes of an Arrow batch, rows that a Parquet reader decodes at once.
BOUNDS = {"spark.sql.execution.arrow.maxBytesPerBatch": "8388608", "spark.sql.parquet.columnarReaderBatchSize": "256"}


def ship(spark: SparkSession) -> None:
    """Let functions of this package travel to the executors by value, and set BOUNDS for the session.

    The executors then need no copy of the package. Batches of long texts or of packed blobs stay small
    whatever the number of rows.
    """
    cloudpickle.register_pickle_by_value(sys.modules[__name__.partition(".")[0]])
    for k, v in BOUNDS.items():
        if spark.conf.get(k, None) != v:
            spark.conf.set(k, v)


def worker_cache() -> dict:
    """A dictionary that lives as long as the Python process of an executor."""
    return sys.__dict__.setdefault("_cardloom_cache", {})


#: A group is hot if it has more than this share of all rows: there are at most as many hot groups as its inverse.
HOT = 1 / 256


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` joined with the row of their group in ``groups`` (keys, n: its number of rows, ...), n left out.

    Rows of hot groups meet a broadcast of these groups, at most 1 / HOT rows, and are not shuffled; only the others are joined by
    shuffle. So no task gets more than a hot group's share. ``rows`` and ``groups`` should be saved tables; keys without nulls.
    """
    total = groups.agg(F.sum("n")).first()[0] or 0
    hot = groups.where(F.col("n") > F.lit(total * HOT))
    cold = groups.where(F.col("n") <= F.lit(total * HOT)).drop("n")
    one = rows.join(F.broadcast(hot.drop("n")), keys)
    other = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold.hint("merge"), keys)
    return one.unionByName(other)


def crc_mod(col: str, n: int) -> Column:
    return F.crc32(F.col(col).cast("string").cast("binary")) % n


def fmix(h: np.ndarray) -> np.ndarray:
    """Finalizer of 64-bit Murmur3; a bijection."""
    h = (h ^ (h >> _S33)) * _M1
    h = (h ^ (h >> _S33)) * _M2
    return h ^ (h >> _S33)


_SPACE = np.zeros(256, np.bool_)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASKS = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [2**64 - 1], np.uint64)


class Words:
    """The words of some documents as flat arrays.

    starts, ends: byte places in buf; doc: ordinal of the document of each word; first: for each
    document the ordinal of its first word, and at the end the number of words.
    """

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, lower: bool):
        if lower:
            buf = _LOWER[buf]
        n = len(buf)
        space = np.ones(n + 1, np.bool_)
        space[:n] = _SPACE[buf]
        before = np.empty(n + 1, np.bool_)
        before[0], before[1:] = True, space[:-1]
        cut = offsets[:-1][offsets[:-1] < n]
        before[cut] = True  # a document starts afresh even where the one before has no space at its end
        starts = np.flatnonzero(before[:n] & ~space[:n])
        ends_mask = space[1:].copy()
        inner = offsets[1:-1]
        ends_mask[inner[(inner > 0) & (inner <= n)] - 1] = True
        ends = np.flatnonzero(ends_mask & ~space[:n]) + 1
        self.buf, self.starts, self.ends = buf, starts, ends
        self.first = np.searchsorted(starts, offsets)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self, prefix: int | None = None) -> np.ndarray:
        """A 64-bit hash of each word, or of its first ``prefix`` (at most 8) bytes."""
        padded = np.zeros(len(self.buf) + 8, np.uint8)
        padded[: len(self.buf)] = self.buf
        eight = np.lib.stride_tricks.as_strided(padded, (len(self.buf) + 1, 8), (1, 1))
        length = self.ends - self.starts
        if prefix:
            length = np.minimum(length, prefix)
        load = lambda at, left: np.ascontiguousarray(eight[at]).view(np.uint64).ravel() & _MASKS[np.minimum(left, 8)]
        h = length.astype(np.uint64) * _GOLD + np.uint64(prefix or 0)
        if len(h):
            h = fmix(h ^ load(self.starts, length) * _M2)
            more, at = np.flatnonzero(length > 8), 8
            while len(more):
                left = length[more] - at
                h[more] = fmix((h[more] + _GOLD) ^ load(self.starts[more] + at, left) * _M2)
                more, at = more[left > 8], at + 8
        return h

    def suffix_hashes(self, n: int) -> np.ndarray:
        """A 64-bit hash of the last ``n`` (at most 8) bytes of each word."""
        short = np.minimum(self.ends - self.starts, n)
        own = Words.__new__(Words)
        own.buf, own.starts, own.ends = self.buf, self.ends - short, self.ends
        return own.hashes(8)

    def text(self, a: int, b: int) -> bytes:
        """Words a to b, with what stands between them."""
        return self.buf[self.starts[a] : self.ends[b - 1]].tobytes()


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string array, nulls as empty."""
    if not len(col):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    if col.null_count:
        col = col.fill_null("")
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    _, offsets, data = col.buffers()
    offsets = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1]
    bytes_ = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    return bytes_, offsets - offsets[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``most`` bytes of text, or one document."""
    for b in batches:
        if not b.num_rows:
            continue
        _, offsets = buffers(b.column(column))
        at = 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
            yield b.slice(at, to - at)
            at = to


def words_of(batch: pa.RecordBatch, lower: bool = False, column: str = "text") -> Words:
    return Words(*buffers(batch.column(column)), lower)


def shingles(h: np.ndarray, first: np.ndarray, k: int, short: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of k words that lie in one document, the document of each, and the ordinal of its first word.

    short: a document of 1 to k - 1 words gives one hash, of all its words.
    """
    n = np.diff(first)
    doc = np.repeat(np.arange(len(n)), n)
    if len(h) >= k:
        g = np.full(len(h) - k + 1, np.uint64(k))
        for j in range(k):
            g = g * _GOLD + h[j : j + len(g)]
        at = np.flatnonzero(doc[: len(g)] == doc[k - 1 :])
        g, d = fmix(g[at]), doc[at]
    else:
        g, d, at = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    if short and len(few := np.flatnonzero((n > 0) & (n < k))):
        s = []
        for i in few:
            x = np.full(1, np.uint64(n[i]))
            for w in h[first[i] : first[i + 1]]:
                x = x * _GOLD + w
            s.append(fmix(x)[0])
        g, d, at = np.r_[g, np.array(s, np.uint64)], np.r_[d, few], np.r_[at, first[few]]
        o = np.argsort(d, kind="stable")
        g, d, at = g[o], d[o], at[o]
    return g, d, at


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def size_bytes(df: DataFrame) -> int:
    """About the bytes of ``df`` in compressed files; the only use is to choose numbers of partitions.

    The optimizer knows it for scans. Where it does not (rows from the driver, joins), the texts are measured.
    """
    n = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if n < 1 << 50:
        return n
    return int(df.agg(F.sum(F.length("text"))).first()[0] or 0) // 2


def parts(df: DataFrame, per: int = 16 << 20) -> int:
    """Partitions for a shuffle of the texts of ``df``: one for each ``per`` bytes of its files."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(n, min(200_000, -(-size_bytes(df) // per)))


def local_path(uri: str) -> str | None:
    """The path of a file: URI or plain path; None for other file systems."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return uri if "://" not in uri else None


def open_fs(uri: str):
    """pyarrow file system and path of a URI, for the flat files."""
    from pyarrow import fs

    if (p := local_path(uri)) is not None:
        return fs.LocalFileSystem(), p
    return fs.FileSystem.from_uri(uri)

