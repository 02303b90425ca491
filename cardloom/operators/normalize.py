"""Row-wise cleaning of contacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardloom.config import EmailConfig, NameConfig, PhoneConfig
from cardloom.functions.email import normalize_email
from cardloom.functions.name import with_llm_names
from cardloom.functions.phone import normalize_phone
from cardloom.functions.text import utrim
from cardloom.schema import COLUMNS


def clean_phones(c: Column, cfg: PhoneConfig = PhoneConfig(), keep_raw: bool = False) -> Column:
    """Valid numbers normalized, others trimmed (or as they were: keep_raw); blank ones go."""
    return F.filter(F.transform(c, lambda p: F.when(normalize_phone(p, cfg)["valid"], normalize_phone(p, cfg)["normalized"]).otherwise(p if keep_raw else utrim(p))), lambda x: x != "")


def clean_emails(c: Column, cfg: EmailConfig = EmailConfig(), keep_raw: bool = False) -> Column:
    """Valid addresses normalized, others trimmed (or as they were: keep_raw); blank ones go. Lax checks only: a lambda cannot call Python."""
    one = lambda e: normalize_email(e, cfg)
    return F.filter(F.transform(c, lambda e: F.when(one(e)["valid"], one(e)["normalized"]).otherwise(e if keep_raw else utrim(e))), lambda x: x != "")


def _strict_emails(df: DataFrame, cfg: EmailConfig) -> DataFrame:
    """Strict checks run over exploded addresses and come back in their order."""
    one = df.select("idx", F.posexplode_outer("emails").alias("_p", "_e")).withColumn("_n", normalize_email(F.col("_e"), cfg))
    value = F.when(F.col("_n.valid"), F.col("_n.normalized")).otherwise(utrim(F.col("_e")))
    back = one.where(value != "").groupBy("idx").agg(F.array_sort(F.collect_list(F.struct("_p", value.alias("v")))).alias("_a"))  # addresses of one contact
    return df.drop("emails").join(back.select("idx", F.transform("_a", lambda x: x["v"]).alias("emails")), "idx", "left").withColumn("emails", F.coalesce("emails", F.array().cast("array<string>")))


def normalize_contacts(contacts: DataFrame, name: NameConfig = NameConfig(), phone: PhoneConfig = PhoneConfig(), email: EmailConfig = EmailConfig()) -> DataFrame:
    """Contacts with clean fields; a name's suffix fills an empty organization. One narrow stage without strict emails."""
    df = with_llm_names(contacts, name, "name", "_n")
    n = F.col("_n")
    blank = utrim(F.col("name")) == ""
    df = df.withColumn("organization", F.when((F.col("organization") == "") & ~blank, n["organization"]).otherwise(F.col("organization")))
    df = df.withColumn("name", F.when(~blank & n["normalized"] & (n["full_name"] != ""), n["full_name"]).otherwise(F.col("name"))).drop("_n")
    df = df.withColumn("phones", clean_phones(F.col("phones"), phone))
    df = _strict_emails(df, email) if email.strict else df.withColumn("emails", clean_emails(F.col("emails"), email))
    return df.select(*COLUMNS)


def normalize_records(contacts: DataFrame) -> DataFrame:
    """idx, name, phones, emails, org of the normalize command: default settings, plus aliases stripped, invalid values as they were."""
    df = normalize_contacts_names(contacts)
    return df.select("idx", "name", clean_phones(F.col("phones"), keep_raw=True).alias("phones"), clean_emails(F.col("emails"), EmailConfig(strip_aliases=True), keep_raw=True).alias("emails"), F.col("organization").alias("org"))


def normalize_contacts_names(contacts: DataFrame) -> DataFrame:
    return contacts.withColumn("name", utrim(F.col("name")))
