"""One record for each cluster, and the reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardloom.functions.email import email_key
from cardloom.functions.phone import phone_digits
from cardloom.schema import COLUMNS, MERGED


def confidence(n: Column) -> Column:
    return F.floor((1 - 1 / (n + 1)) * 100 + 0.5) / 100


def merge_clusters(contacts: DataFrame, clusters: DataFrame) -> DataFrame:
    """A merged contact (schema MERGED, cluster_id as idx) for each cluster of two or more.

    The first member gives id, metadata and source; name and organization are the first nonempty ones;
    phones and emails are distinct by comparable form, in order, without those that have none. A cluster's
    members are gathered in a row: their distinct values are what the merged record holds.
    """
    joined = contacts.join(clusters, "idx")
    sizes = joined.groupBy("cluster_id").agg(F.count("*").alias("n")).where("n > 1")
    many = joined.join(sizes, "cluster_id")
    nonempty = lambda c: F.min_by(F.when(F.col(c) != "", F.col(c)), F.when(F.col(c) != "", F.col("idx")))
    heads = many.groupBy("cluster_id").agg(
        F.min_by(F.struct("id", "metadata", "source"), "idx").alias("first"),
        F.coalesce(nonempty("name"), F.lit("")).alias("name"),
        F.coalesce(nonempty("organization"), F.lit("")).alias("organization"),
        F.array_sort(F.collect_list(F.when((F.col("source.file") != "") & (F.col("source.row") > 0), F.struct("idx", F.col("source.file").alias("f"))))).alias("files"),
        F.first("n").alias("n"),
    )

    def distinct(column: str, key) -> DataFrame:
        # distinct by key before gathering: partial minima keep hot clusters small
        one = many.select("cluster_id", "idx", F.posexplode(column).alias("p", "v")).withColumn("k", key(F.col("v"))).where("k <> ''")
        firsts = one.groupBy("cluster_id", "k").agg(F.min(F.struct("idx", "p", "v")).alias("s"))
        return firsts.groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list("s")), lambda x: x["v"]).alias(column))

    empty = F.array().cast("array<string>")
    merged = heads.join(distinct("phones", phone_digits), "cluster_id", "left").join(distinct("emails", email_key), "cluster_id", "left")
    cols = {
        "idx": F.col("cluster_id"), "id": F.col("first.id"), "name": F.col("name"), "phones": F.coalesce("phones", empty), "emails": F.coalesce("emails", empty),
        "organization": F.col("organization"), "metadata": F.col("first.metadata"), "source": F.col("first.source"),
        "merged_from": F.transform("files", lambda x: x["f"]), "confidence": confidence(F.col("n")), "merge_reason": F.array(F.lit("merged_duplicate_cluster")),
    }
    return merged.select(*(cols[f.name].cast(f.dataType).alias(f.name) for f in MERGED))


def resolved(contacts: DataFrame, clusters: DataFrame, merged: DataFrame) -> DataFrame:
    """Contacts with each cluster of two or more replaced by its merged record; idx is the cluster's smallest."""
    alone = clusters.groupBy("cluster_id").agg(F.count("*").alias("n")).where("n = 1").select(F.col("cluster_id").alias("idx"))
    return contacts.join(alone, "idx", "left_semi").select(*COLUMNS).unionByName(merged.select(*COLUMNS))


def dedupe_report(clusters: DataFrame) -> DataFrame:
    """total_input, duplicates_found, clusters_formed (single contacts included)."""
    n, k = F.count("*"), F.count_distinct("cluster_id")
    return clusters.agg(n.alias("total_input"), (n - k).alias("duplicates_found"), k.alias("clusters_formed"))
