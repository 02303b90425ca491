"""Contacts out of the test tables: a view over customer and supplier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cardloom.schema import conform

#: Runs in Spark and in DuckDB alike. Duplicate pairs and triples, tagged and upper-case emails, two phone spellings, missing values.
CONTACTS_SQL = """
WITH p AS (
  SELECT CAST(c_custkey AS BIGINT) AS rid, c_mktsegment AS seg,
         CAST(CASE WHEN c_custkey >= 8 AND c_custkey % 5 = 0 THEN c_custkey - 7
              WHEN c_custkey >= 9 AND c_custkey % 5 = 1 THEN c_custkey - 8
              ELSE c_custkey END AS BIGINT) AS person
  FROM customer)
SELECT rid,
  concat(trim(substring('Alice   Robert  Charlie Diana   Edward  Frances Gregory Helena  ', CAST(1 + 8 * (person % 8) AS INT), 8)), ' ',
         trim(substring('Johnson SmithsonBrown   WilliamsPrince  OrtegaVoGarcia  ', CAST(1 + 8 * (person % 7) AS INT), 8)),
         CASE WHEN rid % 5 = 1 THEN ' Inc.' ELSE '' END) AS name,
  CASE WHEN rid % 6 = 0 THEN CAST(NULL AS STRING)
       WHEN rid % 4 = 0 THEN concat('User', CAST(person AS STRING), '+tag@Example.com')
       ELSE concat('user', CAST(person AS STRING), '@example.com') END AS email,
  CASE WHEN rid % 7 = 0 THEN CAST(NULL AS STRING)
       WHEN rid % 3 = 0 THEN concat('+1 (', CAST(200 + person % 700 AS STRING), ') 555-', lpad(CAST(person % 10000 AS STRING), 4, '0'))
       ELSE concat('+1', CAST(200 + person % 700 AS STRING), '555', lpad(CAST(person % 10000 AS STRING), 4, '0')) END AS phone,
  seg AS org
FROM p
"""


def raw_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rid, name, email, phone, org"""
    return spark.sql(CONTACTS_SQL.replace("FROM customer", "FROM {customer}"), customer=spark.read.parquet(f"{sf_dir}/customer.parquet"))


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = raw_contacts(spark, sf_dir)
    return conform(rows.selectExpr("rid AS idx", "name", "CASE WHEN phone IS NULL THEN array() ELSE array(phone) END AS phones", "CASE WHEN email IS NULL THEN array() ELSE array(email) END AS emails", "org AS organization"))
