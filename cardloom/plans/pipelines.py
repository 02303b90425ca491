"""The conversions from end to end. Results are lazy tables; a summary is one more aggregate."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardloom.config import DedupeConfig, EmailConfig, NameConfig, PhoneConfig
from cardloom.operators.merge import dedupe_report, merge_clusters, resolved
from cardloom.operators.normalize import normalize_contacts
from cardloom.operators.resolve import clusters
from cardloom.sources.csv import ParseResult
from cardloom.storage import save


@dataclass
class DedupeResult:
    """contacts, clusters (idx, cluster_id), merged (schema MERGED), resolved (contacts after merging), report (one row)."""

    contacts: DataFrame
    clusters: DataFrame
    merged: DataFrame
    resolved: DataFrame
    report: DataFrame


@dataclass
class Conversion:
    """contacts in their output form, errors, and a one-row summary."""

    contacts: DataFrame
    errors: DataFrame
    summary: DataFrame


def deduplicate(contacts: DataFrame, cfg: DedupeConfig = DedupeConfig()) -> DedupeResult:
    contacts = save(contacts)  # a file is parsed and cleaned once, however many results are asked for
    found = save(clusters(contacts, cfg))
    merged = merge_clusters(contacts, found)
    return DedupeResult(contacts, found, merged, resolved(contacts, found, merged), dedupe_report(found))


def summarize(before: DataFrame, after: DataFrame, errors: DataFrame, deduplicated: bool) -> DataFrame:
    """input_contacts (those accepted), output_vcards, duplicates_removed, parse_errors, deduplicated."""
    n = before.agg(F.count("*").alias("input_contacts")).crossJoin(after.agg(F.count("*").alias("output_vcards"))).crossJoin(errors.agg(F.count("*").alias("parse_errors")))  # one row each
    return n.select("input_contacts", "output_vcards", (F.col("input_contacts") - F.col("output_vcards")).alias("duplicates_removed"), "parse_errors", F.lit(deduplicated).alias("deduplicated"))


def convert(parsed: ParseResult, dedupe: bool = False) -> Conversion:
    """CSV to vCard: contacts as they are, or with duplicates merged under default settings."""
    out = deduplicate(parsed.contacts).resolved if dedupe else parsed.contacts
    return Conversion(out, parsed.errors, summarize(parsed.contacts, out, parsed.errors, dedupe))


def normalize_and_convert(parsed: ParseResult, name: NameConfig = NameConfig(), phone: PhoneConfig = PhoneConfig(), email: EmailConfig = EmailConfig(), dedupe: bool = False) -> Conversion:
    """CSV to vCard with normalized contacts; duplicates are looked for after that."""
    clean = normalize_contacts(parsed.contacts, name, phone, email)
    out = deduplicate(clean).resolved if dedupe else clean
    return Conversion(out, parsed.errors, summarize(clean, out, parsed.errors, dedupe))


def union_sources(*sources: DataFrame) -> DataFrame:
    """Contacts of several sources as one list, in the order of the arguments: idx counts on."""
    out, base = None, 0
    for s in sources:
        part = s.withColumn("idx", (F.col("idx") + F.lit(base)).cast("long"))
        base += (s.agg(F.max("idx")).first()[0] or 0) + 1
        out = part if out is None else out.unionByName(part)
    return out
