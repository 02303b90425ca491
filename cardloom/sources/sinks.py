"""Contacts as CSV, vCard, JSON and text reports. Documents for people are ordered; tables stay distributed."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from typing import TextIO

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardloom.functions.vcard import PRODID, to_vcard

HEADER = "name,phone,email,org"
SEPARATOR = "; "


def csv_cell(c: Column) -> Column:
    """Quoted only if needed: a comma, quote, line end, leading white space, or the two characters of an end of data."""
    need = F.rlike(c, F.lit(r'(?U)[",\r\n]|\A\s|\A\\\.\z'))
    return F.when(need, F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def csv_line(name: str = "name", phones: str = "phones", emails: str = "emails", org: str = "organization", separator: str = SEPARATOR) -> Column:
    """One CSV line; several values of a field are joined."""
    return F.concat_ws(",", csv_cell(F.col(name)), csv_cell(F.array_join(phones, separator)), csv_cell(F.array_join(emails, separator)), csv_cell(F.col(org)))


def csv_lines(contacts: DataFrame, org: str = "organization", separator: str = SEPARATOR) -> DataFrame:
    """(idx, line)"""
    return contacts.select("idx", csv_line(org=org, separator=separator).alias("line"))


def vcards(contacts: DataFrame, prodid: str = PRODID) -> DataFrame:
    """(idx, vcard)"""
    return contacts.select("idx", to_vcard(F.col("name"), F.col("phones"), F.col("emails"), F.col("organization"), prodid).alias("vcard"))


def write_vcf(contacts: DataFrame, path: str, prodid: str = PRODID) -> None:
    """A folder of vCard files in the order of idx."""
    cards = vcards(contacts, prodid).orderBy("idx").select(F.regexp_replace("vcard", r"\r\n\z", "").alias("value"))
    cards.write.option("lineSep", "\r\n").text(path)


def write_csv(contacts: DataFrame, path: str, org: str = "organization") -> None:
    """A folder of CSV files in the order of idx; each file begins with the header."""
    contacts.orderBy("idx").select("name", F.array_join("phones", SEPARATOR).alias("phone"), F.array_join("emails", SEPARATOR).alias("email"), F.col(org).alias("org")).write.csv(path, header=True, escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def _ordered(df: DataFrame, column: str) -> Iterator[str]:
    """Values in the order of idx, a partition at a time."""
    return (r[0] for r in df.orderBy("idx").select(column).toLocalIterator())


def stream_vcf(contacts: DataFrame, out: TextIO, prodid: str = PRODID) -> None:
    for v in _ordered(vcards(contacts, prodid), "vcard"):
        out.write(v)


def stream_csv(contacts: DataFrame, out: TextIO, org: str = "organization", separator: str = SEPARATOR) -> None:
    out.write(HEADER + "\n")
    for v in _ordered(csv_lines(contacts, org, separator), "line"):
        out.write(v + "\n")


def json_record(org: str = "org") -> Column:
    """{name, phones, emails, org}; a list without values is null."""
    some = lambda c: F.when(F.size(c) > 0, F.col(c))
    return F.to_json(F.struct("name", some("phones").alias("phones"), some("emails").alias("emails"), F.col(org).alias("org")), {"ignoreNullFields": "false"})


def dumps(x: object) -> str:
    """Indented JSON with <, > and & escaped."""
    s = json.dumps(x, indent=2, ensure_ascii=False)
    for ch in "<>&  ":
        s = s.replace(ch, f"\\u{ord(ch):04x}")
    return s


def stream_json(records: DataFrame, out: TextIO) -> None:
    """The records of ``normalize_records`` as one document; null without any."""
    rows = [json.loads(v) for v in _ordered(records.select("idx", json_record().alias("j")), "j")]
    out.write(dumps(rows or None) + "\n")


def cluster_json(contacts: DataFrame, clusters: DataFrame) -> DataFrame:
    """(cluster_id, members): the members of each cluster of two or more as a JSON array; empty fields are left out."""
    none = lambda c: F.when(c != "", c)
    some = lambda c: F.when(F.size(c) > 0, F.col(c))
    at = F.concat(F.coalesce("source.file", F.lit("")), F.lit(":"), F.coalesce("source.row", F.lit(0)).cast("string"))
    one = F.struct("name", some("phones").alias("phones"), some("emails").alias("emails"), none(F.col("organization")).alias("org"), F.when(at != ":0", at).alias("source"))
    g = contacts.join(clusters, "idx").select("cluster_id", F.struct("idx", one.alias("c")).alias("s")).groupBy("cluster_id").agg(F.array_sort(F.collect_list("s")).alias("m")).where(F.size("m") > 1)
    return g.select("cluster_id", F.to_json(F.transform("m", lambda x: x["c"])).alias("members"))


def stream_dedupe_json(report: DataFrame, clusters: DataFrame, merged: DataFrame, out: TextIO) -> None:
    """{report, clusters, merged}: ``clusters`` from cluster_json."""
    r = report.first()
    doc: dict = {"report": {"TotalInput": r["total_input"], "DuplicatesFound": r["duplicates_found"], "ClustersFormed": r["clusters_formed"]}}
    found = [json.loads(x["members"]) for x in clusters.orderBy("cluster_id").toLocalIterator()]
    if found:
        doc["clusters"] = found
    rows = []
    for m in merged.orderBy("idx").toLocalIterator():
        s = m["source"]
        rows.append({"ID": m["id"] or "", "Name": m["name"], "Phones": m["phones"] or None, "Emails": m["emails"] or None, "Organization": m["organization"], "Metadata": m["metadata"], "Source": {"File": (s and s["file"]) or "", "Row": (s and s["row"]) or 0}, "MergedFrom": m["merged_from"] or None, "Confidence": m["confidence"], "MergeReason": m["merge_reason"]})
    if rows:
        doc["merged"] = rows
    out.write(dumps(doc) + "\n")


def dry_run_lines(contacts: DataFrame, clusters: DataFrame) -> DataFrame:
    """(cluster_number, idx, line) of the members of clusters of two or more; numbers count all clusters in order.

    The number is the place of the cluster's smallest idx among all of them: counts of ranges of ids are summed, so that no
    window holds more than one range.
    """
    sizes = clusters.groupBy("cluster_id").agg(F.count("*").alias("size"))
    part = F.floor(F.col("cluster_id") / 65536)
    ranges = sizes.groupBy(part.alias("r")).agg(F.count("*").alias("n"))
    before = ranges.select("r", (F.sum("n").over(Window.orderBy("r")) - F.col("n")).alias("before"))
    numbered = sizes.withColumn("r", part).withColumn("k", F.row_number().over(Window.partitionBy("r").orderBy("cluster_id"))).join(before, "r").select("cluster_id", "size", (F.col("k") + F.col("before")).cast("long").alias("cluster_number"))
    line = F.concat(F.lit("  - "), F.col("name"), F.lit(" | "), F.array_join("emails", ", "), F.lit(" | "), F.array_join("phones", SEPARATOR))
    return contacts.join(clusters, "idx").join(numbered.where("size > 1"), "cluster_id").select("cluster_number", "size", "idx", line.alias("line"))


def stream_dry_run(report: DataFrame, lines: DataFrame, out: TextIO) -> None:
    r = report.first()
    out.write(f"\nDeduplication Report:\n  Total input contacts:  {r['total_input']}\n  Duplicates found:      {r['duplicates_found']}\n  Clusters formed:       {r['clusters_formed']}\n\n")
    now = None
    for x in lines.orderBy("cluster_number", "idx").toLocalIterator():
        if x["cluster_number"] != now:
            out.write("\n" * (now is not None) + f"Cluster {x['cluster_number']} ({x['size']} contacts):\n")
            now = x["cluster_number"]
        out.write(x["line"] + "\n")
    out.write("\n" * (now is not None))


def open_out(path: str | None, default: TextIO) -> TextIO:
    if not path or path == "-":
        return default
    if os.path.dirname(path):
        os.makedirs(os.path.dirname(path), exist_ok=True)
    return open(path, "w", encoding="utf-8", newline="")
