"""Contacts from CSV."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cardloom.config import CONVERT, CsvDialect
from cardloom.functions.text import utrim
from cardloom.schema import STRINGS, conform, has_fields
from cardloom.sources.headers import EMAIL, NAME, ORG, PHONE, resolve
from cardloom.sources.lines import Block, ordered_blocks, read_lines, runs
from cardloom.storage import save

NO_FIELDS = "no recognizable contact fields in row"
#: White space of Unicode, which str.strip() exceeds by U+001C to U+001F.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


@dataclass
class ParseResult:
    """contacts (schema CONTACT) and errors (row, field, message), both lazy."""

    contacts: DataFrame
    errors: DataFrame


def records(text: str) -> Iterator[list[str]]:
    """Records of a CSV text with lazy quotes: white space before a field goes; a field that begins with a quote ends at a quote
    before a comma or a line end, and any other quote in it is literal; an open quote runs to the end.

    Empty lines are no records. Line ends in fields become LF.
    """
    text = text.removeprefix("\ufeff").replace("\r\n", "\n")
    at, n = 0, len(text)
    while at < n:
        if text[at] == "\n":
            at += 1
            continue
        row: list[str] = []
        while True:
            while at < n and text[at] in SPACE and text[at] != "\n":
                at += 1
            if at < n and text[at] == '"':
                at, part = at + 1, []
                while True:
                    q = text.find('"', at)
                    if q < 0:
                        part.append(text[at:])
                        at = n
                        break
                    part.append(text[at:q])
                    after = text[q + 1 : q + 2]
                    at = q + 1
                    if after == '"':
                        part.append('"')
                        at += 1
                    elif after in ("", ",", "\n"):
                        break
                    else:
                        part.append('"')
                row.append("".join(part))
            else:
                ends = [e for e in (text.find(",", at), text.find("\n", at)) if e >= 0]
                end = min(ends, default=n)
                row.append(text[at:end])
                at = end
            if at < n and text[at] == ",":
                at += 1
                continue
            at += 1
            break
        yield row


def _pick(cells: Column, places: list[int]) -> Column:
    """The nonempty trimmed cells at these places, in their order; rows may be short."""
    return F.filter(F.transform(F.array(*(F.coalesce(F.get(cells, i), F.lit("")) for i in places)), utrim), lambda x: x != "") if places else F.array().cast(STRINGS)


def contacts_from_cells(rows: DataFrame, places: dict[str, list[int]], dialect: CsvDialect) -> ParseResult:
    """Contacts of ``rows`` (ord: unique and ascending, row: number of the record, cells), with their place as idx."""
    names, orgs = _pick(F.col("cells"), places[NAME]), _pick(F.col("cells"), places[ORG])
    first = lambda a, i: F.coalesce(F.try_element_at(a, F.lit(i)), F.lit(""))
    made = rows.select(
        "ord",
        first(names, 1 if dialect.name_policy == "first" else -1).alias("name"),
        _pick(F.col("cells"), places[PHONE]).alias("phones"),
        _pick(F.col("cells"), places[EMAIL]).alias("emails"),
        first(orgs, 1).alias("organization"),
        F.struct(F.lit(None).cast("string").alias("file"), F.col("row").cast("int").alias("row")).alias("source"),
    )
    made = save(made)
    kept = with_index(made.where(has_fields(dialect.keep_org_only)), "ord")
    errors = made.where(~has_fields(True)).select(F.col("source.row").alias("row"), F.lit("row").alias("field"), F.lit(NO_FIELDS).alias("message"))
    return ParseResult(conform(kept), errors)


def with_index(df: DataFrame, order: str) -> DataFrame:
    """idx = 0, 1, ... by ``order`` (group << 33 | place in the group): counts of the groups are summed, rows are not moved to one task."""
    group = F.shiftright(F.col(order), 33)
    place = F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1
    sizes = df.groupBy(group.alias("g")).agg(F.count("*").alias("n"))
    before = sizes.select("g", (F.sum("n").over(Window.orderBy("g")) - F.col("n")).alias("before"))  # a row for each partition of the scan
    return df.withColumn("g", group).withColumn("place", place).join(before, "g").withColumn("idx", (F.col("place") + F.col("before")).cast("long")).drop("g", "place", "before")


def ends_quoted(line: str, quoted: bool) -> bool:
    """Whether a quoted field is open after ``line``, which begins in one or (not quoted) a record or field."""
    at, n = 0, len(line)
    while True:
        if not quoted:
            while at < n and line[at] in SPACE:
                at += 1
            if at >= n or line[at] != '"':
                at = line.find(",", at) + 1
                if not at:
                    return False
                continue
            at += 1
        at = line.find('"', at)
        if at < 0:
            return True
        after = line[at + 1 : at + 2]
        if not after:
            return False
        quoted, at = after != ",", at + (1 if after not in '",' else 2)


def _fields(record: str) -> list[str]:
    """The fields of one record; a quote that stays open runs to its end."""
    return next(records(record)) if '"' in record else [x.lstrip(SPACE) for x in record.split(",")]


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """file, block and, for a block that begins outside and inside a quoted field: whether it ends in one, and the records that begin in it."""
    found: dict[Block, list] = {}
    for block, _, lines in runs(batches):
        state = found.setdefault(block, [False, 0, True, 0])
        for line in lines:
            for i in (0, 2):
                if not state[i] and line:
                    state[i + 1] += 1
                if '"' in line and (state[i] or line):
                    state[i] = ends_quoted(line, state[i])
    rows = [(*k, *v) for k, v in found.items()]
    types = [pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.bool_(), pa.int64()]
    yield pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["file", "block", "out_quoted", "out_n", "in_quoted", "in_n"])


def read_rows(spark: SparkSession, path: str) -> tuple[list[str] | None, DataFrame]:
    """The fields of the first header, and (ord, row, cells) of all other records of the files at ``path``, in the order of their paths.

    Quotes are read as in ``records``, wherever Spark cuts the files: whether a block begins in a quoted field follows from the blocks before
    it. A record over several blocks is put together from its parts. ord ascends over all files, in groups of 2 ** 33 by block.
    """
    lines = read_lines(spark, path)
    plan: dict[Block, tuple[int, bool, int, int]] = {}  # number of the block, whether it begins quoted, records before it in its file, where its open record began
    quoted, n, file, owner = False, 0, None, 0
    for i, (name, block, out_quoted, out_n, in_quoted, in_n) in enumerate(ordered_blocks(lines.mapInArrow(_describe, "file string, block long, out_quoted boolean, out_n long, in_quoted boolean, in_n long"))):
        if name != file:
            file, quoted, n = name, False, 0
        plan[name, block] = i, quoted, n, owner
        quoted, more = (in_quoted, in_n) if quoted else (out_quoted, out_n)
        n += more
        if more:
            owner = i
    if not plan:
        return None, spark.createDataFrame([], "ord long, row int, cells array<string>")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole records as cells; parts of records that cross blocks as text."""
        now, held, n, crosses, place = None, [], 0, False, 0

        def close(out: list, open_end: bool) -> None:
            nonlocal held, n, crosses, place
            if held:
                number, _, _, began = plan[now]
                text = "\n".join(held)
                if crosses:  # the record began in an earlier block
                    out.append((None, n, None, began, number, text))
                elif open_end:
                    out.append(((number << 33) + place, n, None, number, number, text))
                else:
                    out.append(((number << 33) + place, n, _fields(text), number, None, None))
                place += not crosses
            held, crosses = [], False

        quoted = False
        for block, begins, lines in runs(batches):
            out: list[tuple] = []
            if begins:
                if now is not None:
                    close(out, quoted)
                now, place = block, 0
                _, quoted, n, _ = plan[block]
                crosses = quoted
            for line in lines:
                if not quoted:
                    if not line:
                        continue
                    n += 1
                held.append(line)
                if '"' in line:
                    quoted = ends_quoted(line, quoted)
                if not quoted:
                    close(out, False)
            yield _rows(out)
        if now is not None:
            out = []
            close(out, quoted)
            yield _rows(out)

    def _rows(out: list[tuple]) -> pa.RecordBatch:
        types = [pa.int64(), pa.int32(), pa.list_(pa.string()), pa.int32(), pa.int32(), pa.string()]
        return pa.record_batch([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], ["ord", "row", "cells", "began", "part", "text"])

    cut_rows = save(lines.mapInArrow(cut, "ord long, row int, cells array<string>, began int, part int, text string"))
    # the parts of one record: a block's first and last lines
    crossing = cut_rows.where("part is not null").groupBy("began").agg(F.max("ord").alias("ord"), F.max("row").alias("row"), F.array_sort(F.collect_list(F.struct("part", "text"))).alias("p"))
    crossing = crossing.select("ord", "row", F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("text"))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column("ord"), b.column("row"), pa.array([_fields(t) for t in b.column("text").to_pylist()], pa.list_(pa.string()))], ["ord", "row", "cells"])

    rows = cut_rows.where("part is null").select("ord", "row", "cells").unionAll(crossing.mapInArrow(parse, "ord long, row int, cells array<string>"))
    head = rows.where("row = 1").orderBy("ord").first()
    return (head["cells"] if head else None), rows.where("row > 1")


def read_contacts_csv(spark: SparkSession, path: str, dialect: CsvDialect = CONVERT, exact: bool = True) -> ParseResult:
    """Contacts of a CSV file, or of files with the same header, which Spark splits between tasks. Files come in the order of their paths.

    exact: quotes are read as in ``records``, in fields over several lines too. Otherwise Spark's own CSV reader is used, and quoted
    fields must not hold line ends.
    """
    if exact:
        first, rows = read_rows(spark, path)
    else:
        top = spark.read.text(path).limit(1).first()
        first = next(records(top["value"]), None) if top else None
    if first is None:
        raise ValueError("reading CSV headers: no header row")
    places = resolve([h.strip(SPACE) for h in first], dialect.headers, dialect.mapping)
    if not exact:
        names = [f"c{i}" for i in range(len(first))]
        raw = spark.read.csv(path, schema=", ".join(f"{c} string" for c in names), escape='"', ignoreLeadingWhiteSpace=True, header=True, enforceSchema=True)
        rows = save(raw.select(F.monotonically_increasing_id().alias("ord"), F.array(*names).alias("cells")))
        rows = with_index(rows, "ord").withColumn("row", (F.col("idx") + 2).cast("int")).drop("idx")
    return contacts_from_cells(rows, places, dialect)
