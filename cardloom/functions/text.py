"""Trimming and splitting by Unicode white space."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def utrim(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\A\s+|\s+\z", "")


def words(c: Column) -> Column:
    """The runs without white space."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda x: x != "")


def squeeze(c: Column) -> Column:
    """Trimmed, lower case, inner white space as single blanks."""
    return F.array_join(words(F.lower(c)), " ")
