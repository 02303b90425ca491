"""Row types of the engine. Absent values are '' and empty arrays inside; nulls become these at ingest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

STRINGS = T.ArrayType(T.StringType())
SOURCE = T.StructType([T.StructField("file", T.StringType()), T.StructField("row", T.IntegerType())])
#: idx is the place of a contact in its list: order decides what a merge keeps and how clusters are sorted.
CONTACT = T.StructType([
    T.StructField("idx", T.LongType()),
    T.StructField("id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("phones", STRINGS),
    T.StructField("emails", STRINGS),
    T.StructField("organization", T.StringType()),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    T.StructField("source", SOURCE),
])
MERGED = T.StructType([*CONTACT, T.StructField("merged_from", STRINGS), T.StructField("confidence", T.DoubleType()), T.StructField("merge_reason", STRINGS)])
PARSE_ERROR = T.StructType([T.StructField("row", T.IntegerType()), T.StructField("field", T.StringType()), T.StructField("message", T.StringType())])
COLUMNS = [f.name for f in CONTACT]


def text(c: Column | str) -> Column:
    """A string without null."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def strings(c: Column | str) -> Column:
    """An array of strings without null, in it or for it."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.filter(c, lambda x: x.isNotNull()), F.array().cast(STRINGS))


def conform(df: DataFrame) -> DataFrame:
    """``df`` with exactly the columns of CONTACT; what it lacks is empty, and other columns go."""
    have = set(df.columns)
    make = {"name": text, "organization": text, "id": text, "phones": strings, "emails": strings}
    cols = []
    for f in CONTACT:
        if f.name in have:
            c = make[f.name](f.name) if f.name in make else F.col(f.name)
        else:
            c = F.array() if f.dataType == STRINGS else F.lit("") if f.name in make else F.lit(None)
        cols.append(c.cast(f.dataType).alias(f.name))
    return df.select(*cols)


def has_fields(with_org: bool = True) -> Column:
    """A row is a contact if it has a name, a phone, an email or (with_org) an organization."""
    c = (F.col("name") != "") | (F.size("phones") > 0) | (F.size("emails") > 0)
    return c | (F.col("organization") != "") if with_org else c
