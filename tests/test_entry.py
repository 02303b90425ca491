from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
#: A query of each kind; all of them are checked by the driver at a larger size.
NAMES = ["normalize_phones", "normalize_emails", "normalize_names", "candidates_email", "duplicate_pairs", "clusters_all_blocks", "merged_contacts", "to_vcard", "parse_vcards", "csv_rows_dedupe", "csv_rows_mapped", "csv_files_convert", "csv_files_dedupe", "csv_files_normalize", "vcf_files", "vcf_names", "cluster_json", "names_by_service", "strict_emails"]


def test_entry(spark):
    assert entry.entry(spark).columns == ["idx", "cluster_id"]


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("customer", "supplier", "part", "orders", "documents"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in cols)) for r in df.collect())
    cur = con.execute(entry.oracle_sql()[name])
    have = [d[0] for d in cur.description]
    assert sorted(have) == cols
    assert got == sorted(repr(tuple(r[have.index(c)] for c in cols)) for r in cur.fetchall())
