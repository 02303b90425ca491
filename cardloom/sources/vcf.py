"""Contacts from vCard files."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cardloom.functions.vcard import card_fields
from cardloom.schema import conform, has_fields
from cardloom.sources.csv import ParseResult, with_index
from cardloom.sources.lines import Block, ordered_blocks, read_lines, runs
from cardloom.storage import save

LINE = 2 * 1024 * 1024  # bytes
CHUNK = 1 << 20  # characters of the cards that are handed on together
_END = r"(?im)^[ \t\x0B\f\r\u0085\u00A0\u2000-\u200A\u3000]*END:VCARD[ \t\x0B\f\r\u0085\u00A0\u2000-\u200A\u3000]*$"
_END_LINE = re.compile(r"[\x0B\f\r\u0085\u00A0\u2000-\u200A\u3000]*END:VCARD[ \t\x0B\f\r\u0085\u00A0\u2000-\u200A\u3000]*", re.I)


def card_lines(text: Column) -> Column:
    """ARRAY<ARRAY<line>> of the cards of a text: lines that begin with blanks continue the one before, all their blanks gone.

    A card ends at END:VCARD; lines after the last end are a card too. A line over 2 MiB is an error.
    """
    lines = F.split(F.regexp_replace(F.regexp_replace(text, r"\r?\n[ \t]+", ""), r"\A[ \t]+", ""), r"\r?\n")
    joined = F.array_join(F.filter(lines, lambda x: x != ""), "\n")
    long = F.exists(F.split(text, "\n"), lambda x: F.octet_length(x) > LINE)
    whole = F.when(long, F.raise_error(F.lit("reading vcf: line too long"))).otherwise(joined)
    cards = F.transform(F.split(whole, _END), lambda c: F.filter(F.split(c, "\n"), lambda x: x != ""))
    return F.filter(cards, lambda c: F.size(c) > 0)


def parse_vcf(texts: DataFrame) -> ParseResult:
    """Contacts of ``texts`` (file_ord: place of the file, value: its text, and part: place of the text in the file, if there are several).

    The row of an error is one more than the contacts accepted before its card in the file; errors of cards
    without any field stay.
    """
    part = F.col("part") if "part" in texts.columns else F.lit(0)
    cards = texts.select("file_ord", part.cast("long").alias("part"), F.posexplode(card_lines(F.col("value"))).alias("pos", "lines"))
    made = cards.select("file_ord", "part", "pos", card_fields(F.col("lines")).alias("f")).select("file_ord", "part", "pos", "f.*")
    made = save(made.withColumn("kept", has_fields(True).cast("int")))
    # contacts before each text: sums over a row for each text; before each card: within its text
    texts_ = made.groupBy("file_ord", "part").agg(F.sum("kept").alias("n"))
    in_file, all_files = Window.partitionBy("file_ord").orderBy("part"), Window.orderBy("file_ord", "part")
    texts_ = save(texts_.withColumn("in_file", F.sum("n").over(in_file) - F.col("n")).withColumn("in_all", F.sum("n").over(all_files) - F.col("n")).drop("n"))
    in_text = F.sum("kept").over(Window.partitionBy("file_ord", "part").orderBy("pos")) - F.col("kept")
    placed = made.withColumn("before", in_text).join(texts_, ["file_ord", "part"])
    errors = placed.select((F.col("in_file") + F.col("before") + 1).cast("int").alias("row"), F.explode("errors").alias("field"))
    contacts = placed.where("kept = 1").withColumn("idx", (F.col("in_all") + F.col("before")).cast("long"))
    return ParseResult(conform(contacts), errors.select("row", "field", F.concat(F.lit("empty "), F.lower("field"), F.lit(" value")).alias("message")))


def _ends(lines: list[str]) -> list[int]:
    """Places of lines that surely end a card: what comes after them does not continue them."""
    return [i for i, x in enumerate(lines[:-1]) if _END_LINE.fullmatch(x) and not lines[i + 1].startswith((" ", "\t"))]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Block, int, list[str]]]:
    """(block, number, lines): lines up to the last sure end of a card so far, some CHUNK of characters at a time, and number -1 with the rest of the block."""
    now, number, held, size = None, 0, [], 0
    for block, begins, lines in runs(batches):
        if begins:
            if now is not None:
                yield now, -1, held
            now, number, held, size = block, 0, [], 0
        held += lines
        size += sum(map(len, lines))
        if size > CHUNK and (ends := _ends(held)):
            yield now, number, held[: ends[-1] + 1]
            number, held = number + 1, held[ends[-1] + 1 :]
            size = sum(map(len, held))
    if now is not None:
        yield now, -1, held


def read_vcf(spark: SparkSession, path: str) -> ParseResult:
    """Contacts of one vCard file, or of several in the order of their paths, which Spark splits between tasks."""
    lines = read_lines(spark, path)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[Block, bool] = {}
        for block, number, part in _blocks(batches):
            found[block] = found.get(block, False) or number >= 0 or bool(_ends(part))
        yield pa.record_batch([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.int64()), pa.array(list(found.values()), pa.bool_())], ["file", "block", "cut"])

    # of each block: place of its file, its number, and the chain that its beginning belongs to: 2 * number for the first block
    # of a file, else 2 * number + 1 of the last block before it in which a card ended
    plan: dict[Block, tuple[int, int, int]] = {}
    file, place, chain = None, -1, 0
    for i, (name, block, cut) in enumerate(ordered_blocks(lines.mapInArrow(describe, "file string, block long, cut boolean"))):
        if name != file:
            file, place, chain = name, place + 1, 2 * i
        plan[name, block] = place, i, chain
        if cut:
            chain = 2 * i + 1

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole cards; and, with their chain, a block's lines before its first and after its last sure end."""
        seen: set[Block] = set()
        for block, number, part in _blocks(batches):
            place, i, before = plan[block]
            ends = _ends(part) if number < 0 else [*_ends(part), len(part) - 1]
            rows: list[tuple] = []
            if block not in seen and part:
                seen.add(block)
                to = ends[0] + 1 if ends else len(part)
                rows.append((place, None, before, i, part[:to]))
                part, ends = part[to:], [e - to for e in ends[1:]]
            if ends:
                rows.append((place, (i << 32) + (1 + number if number >= 0 else 1 << 30), None, None, part[: ends[-1] + 1]))
            if part[ends[-1] + 1 if ends else 0 :]:
                rows.append((place, None, 2 * i + 1, i, part[ends[-1] + 1 if ends else 0 :]))
            types = [pa.int64()] * 4
            yield pa.record_batch([*(pa.array([r[k] for r in rows], t) for k, t in enumerate(types)), pa.array(["\n".join(r[4]) for r in rows], pa.string())], ["file_ord", "part", "chain", "piece", "value"])

    texts = save(lines.mapInArrow(split, "file_ord long, part long, chain long, piece long, value string"))
    # a chain is put together from a block's end and the beginnings of the blocks that follow: one card, or few
    joined = texts.where("chain is not null").groupBy("file_ord", "chain").agg(F.array_sort(F.collect_list(F.struct("piece", "value"))).alias("p"))
    at = F.shiftleft(F.floor(F.col("chain") / 2), 32) + F.when(F.col("chain") % 2 == 1, 1 << 31).otherwise(0)
    joined = joined.select("file_ord", at.alias("part"), F.array_join(F.transform("p", lambda x: x["value"]), "\n").alias("value"))
    return parse_vcf(texts.where("chain is null").select("file_ord", "part", "value").unionByName(joined))
