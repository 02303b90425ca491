"""Names."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardloom.config import NameConfig
from cardloom.functions.text import squeeze, utrim, words


def normalize_name(raw: Column, cfg: NameConfig = NameConfig()) -> Column:
    """STRUCT<full_name, first_name, last_name, organization, normalized> by rules.

    With strip_suffix the first pattern, in the order given, that ends the name becomes the organization.
    Inner white space of full_name stays.
    """
    t = utrim(raw)
    org, full = F.lit(""), t
    if cfg.strip_suffix:
        for p in reversed(cfg.org_patterns):
            hit = F.endswith(t, F.lit(p))
            org = F.when(hit, F.lit(p)).otherwise(org)
            full = F.when(hit, utrim(F.substring(t, F.lit(1), F.length(t) - len(p)))).otherwise(full)
    blank = t == ""
    org, w = F.when(blank, "").otherwise(org), words(full)
    return F.struct(
        F.when(blank, "").otherwise(full).alias("full_name"),
        F.coalesce(F.try_element_at(w, F.lit(1)), F.lit("")).alias("first_name"),
        F.when(F.size(w) >= 2, F.try_element_at(w, F.lit(-1))).otherwise("").alias("last_name"),
        org.alias("organization"),
        (F.size(w) > 0).alias("normalized"),
    )


def name_key(c: Column) -> Column:
    return squeeze(c)


def name_block(c: Column) -> Column:
    """The first six bytes of the comparable name, as hex digits."""
    return F.hex(F.substring(F.encode(name_key(c), "UTF-8"), 1, 6))


def with_llm_names(df: DataFrame, cfg: NameConfig, column: str = "name", to: str = "normalized_name") -> DataFrame:
    """``df`` and the normalized name: the client's answer where it is usable, else the rules'.

    The client is called once for each different name of a batch. Any error, a missing full_name or a
    null answer falls back to the rules.
    """
    ruled = df.withColumn(to, normalize_name(F.col(column), cfg))
    if not (cfg.use_llm and cfg.llm):
        return ruled
    client = cfg.llm

    @F.pandas_udf("struct<full_name:string,first_name:string,last_name:string,organization:string,normalized:boolean>")
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for names in batches:
            known = {n: _answer(client, n) for n in names.dropna().unique()}
            yield pd.DataFrame([known.get(n) or dict.fromkeys(("full_name", "first_name", "last_name", "organization", "normalized")) for n in names], columns=["full_name", "first_name", "last_name", "organization", "normalized"])

    said = F.col("_said")
    return ruled.withColumn("_said", ask(utrim(F.col(column)))).withColumn(to, F.when(said["full_name"] != "", said).otherwise(F.col(to))).drop("_said")


def _answer(client, name: str) -> dict | None:
    if not name:
        return None
    try:
        found = client(name)
    except Exception:  # the service is optional: any failure means the rules
        return None
    if not found or not found.get("full_name"):
        return None
    return {k: found.get(k) or "" for k in ("full_name", "first_name", "last_name", "organization")} | {"normalized": True}
