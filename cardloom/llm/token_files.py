"""Token ids as flat binary files.

A dataset is a folder of shards in ascending doc_id order. For each shard there are ``NAME.bin``, the ids
of its documents one after another (unsigned, 16 bits if every id of the vocabulary fits, else 32, little-endian), and ``NAME.idx``, unsigned
64-bit little-endian numbers: n documents, then their n + 1 offsets into the ids, then their n doc_ids (two's
complement). ``manifest`` lists the shards with the number of ids before each: the prefix sums of the
shards' sizes, so that every shard is written without knowing the others.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardloom.llm.common import local_path, open_fs, parts, pieces, shared_dir, ship
from cardloom.llm.encoders import encode_column


@dataclass
class TokenDataset:
    """path: the folder; shards: (name, documents, ids, ids before, id bytes) in order of doc_id."""

    path: str
    shards: list[tuple[str, int, int, int, int]]


def write_tokens(docs: DataFrame, tokenizer: str, path: str, kind: str = "word", end: int = 2, width: int = 2, shards: int | None = None) -> TokenDataset:
    """Encode every whole text of ``docs`` (doc_id, text) in ascending doc_id order into files below ``path``.

    Null texts count as empty; each document ends with the id ``end``. Rows without doc_id come first.
    Rows repeated under a doc_id give one document each, in any order of equals; an empty table gives a
    dataset without shards. Each task writes its files under a name of its own attempt and reports them
    when they are complete, so that a task that runs again or twice does no harm.
    """
    spark = docs.sparkSession
    ship(spark)
    n = shards or parts(docs)
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id")
    fs, folder = open_fs(path)
    fs.create_dir(folder, recursive=True)
    dtype = f"<u{width}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = open_fs(path)
        name = f"{TaskContext.get().partitionId():08d}-{uuid.uuid4().hex}"
        lengths, ids, out = [], [], None
        for b in pieces(batches):
            out = out or fs.open_output_stream(f"{folder}/{name}.bin")
            for x in encode_column(b.column("text"), tokenizer, kind, end):
                a = np.frombuffer(x, "<u4")
                if width < 4 and a.max() >= 1 << (8 * width):
                    raise ValueError(f"an id does not fit {width} bytes")
                out.write(a.astype(dtype).tobytes())
                lengths.append(len(a))
            ids.append(b.column("doc_id").fill_null(-(1 << 63)).to_numpy())
        if out is None:
            return
        out.close()
        offsets = np.r_[0, np.cumsum(lengths)].astype("<u8")
        with fs.open_output_stream(f"{folder}/{name}.idx") as f:
            f.write(np.array([len(lengths)], "<u8").tobytes() + offsets.tobytes() + np.concatenate(ids).astype("<i8").tobytes())
        yield pa.record_batch({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "name": [name], "docs": [len(lengths)], "ids": pa.array([int(offsets[-1])], pa.int64())})

    rows = sorted(ordered.mapInArrow(run, "part int, name string, docs long, ids long").collect())  # one row for each shard
    base, found = 0, []
    for r in rows:
        found.append((r["name"], r["docs"], r["ids"], base, width))
        base += r["ids"]
    with fs.open_output_stream(f"{folder}/manifest") as f:
        f.write("".join("\t".join(map(str, s)) + "\n" for s in found).encode())
    return TokenDataset(path, found)


def open_dataset(path: str) -> TokenDataset:
    fs, folder = open_fs(path)
    with fs.open_input_stream(f"{folder}/manifest") as f:
        rows = [x.split("\t") for x in f.read().decode().splitlines()]
    return TokenDataset(path, [(r[0], *map(int, r[1:])) for r in rows])


def open_shard(path: str, name: str, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids (memory-mapped where the file is local), offsets and doc_ids of a shard."""
    if (p := local_path(path)) is not None:
        ids, idx = np.memmap(f"{p}/{name}.bin", f"<u{width}", "r"), np.memmap(f"{p}/{name}.idx", "<u8", "r")
    else:
        fs, folder = open_fs(path)
        ids, idx = (np.frombuffer(fs.open_input_file(f"{folder}/{name}.{e}").read(), t) for e, t in (("bin", f"<u{width}"), ("idx", "<u8")))
    n = int(idx[0])
    return ids, idx[1 : n + 2], idx[n + 2 :].view("<i8")


def read_tokens(spark: SparkSession, data: TokenDataset, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (of the ids as unsigned 32 bits) and, if asked for, the ids, from the files."""
    ship(spark)
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    if not data.shards:
        return spark.createDataFrame([], schema)
    path = data.path
    rows = spark.createDataFrame(data.shards, "name string, docs long, n long, base long, width int").repartition(max(1, len(data.shards)), "name")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                ids, offsets, doc_ids = open_shard(path, r["name"], r["width"])
                offsets = offsets.astype(np.int64)
                for s in range(0, len(doc_ids), 1024):
                    o = offsets[s : s + 1025]
                    each = [ids[i:j].astype("<u4") for i, j in zip(o[:-1], o[1:], strict=True)]
                    d = np.array(doc_ids[s : s + 1024])
                    cols = {"doc_id": pa.array(d, mask=d == -(1 << 63)), "start": pa.array(r["base"] + o[:-1]), "n_tokens": pa.array(np.diff(o)), "ids_crc32": pa.array([crc32(x) for x in each], pa.int64())}
                    if with_ids:
                        cols["ids"] = pa.array(each, pa.list_(pa.uint32())).cast(pa.list_(pa.int32()))
                    yield pa.record_batch(cols)

    return rows.mapInArrow(run, schema)


def default_path(spark: SparkSession) -> str:
    return shared_dir(spark) + "-tokens"
