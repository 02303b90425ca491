"""Text files as lines that Spark deals out by blocks, and what each block means for its neighbours.

A record may span lines, and so blocks. Each reader passes over the files twice: the first pass describes every block in a few
numbers, which the driver puts in order, one row for each block of the scan; the second cuts the blocks into records.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Block = tuple[str, int]


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, block (where it begins in the file) and value: the lines, in order within a block; only LF ends a line."""
    raw = spark.read.option("lineSep", "\n").text(path)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Block, bool, list[str]]]:
    """(block, whether it begins here, lines) of the batches of a partition: a batch at a time, cut where a block ends.

    A CR before the line end goes, and the mark that some files begin with.
    """
    last: Block | None = None
    for b in batches:
        files, blocks, values = (b.column(c).to_pylist() for c in ("file", "block", "value"))
        at = 0
        while at < len(values):
            now = files[at], blocks[at]
            end = at + 1
            while end < len(values) and blocks[end] == now[1] and files[end] == now[0]:
                end += 1
            lines = [v[:-1] if v.endswith("\r") else v for v in values[at:end]]
            if now != last and now[1] == 0:
                lines[0] = lines[0].removeprefix("\ufeff")
            yield now, now != last, lines
            last, at = now, end


def ordered_blocks(described: DataFrame) -> list[tuple]:
    """The rows of ``described`` (file, block, ...) in order: one row for each block that Spark reads, as its own plan of the scan has."""
    return sorted(tuple(r) for r in described.collect())
