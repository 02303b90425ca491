"""Queries of the contact operators over the test tables, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardloom.config import CONVERT, DEDUPE, NORMALIZE, CsvDialect, DedupeConfig, EmailConfig, NameConfig, PhoneConfig
from cardloom.functions.email import email_key, normalize_email
from cardloom.functions.name import name_key, normalize_name, with_llm_names
from cardloom.functions.phone import calling_codes, normalize_phone, phone_country, phone_digits
from cardloom.functions.similarity import jaro_winkler, org_key, org_match
from cardloom.functions.text import squeeze
from cardloom.functions.vcard import escape, structured_name
from cardloom.operators import merge, normalize, resolve
from cardloom.plans.pipelines import convert, deduplicate, normalize_and_convert
from cardloom.plans.views import CONTACTS_SQL, contacts, raw_contacts
from cardloom.sources import sinks
from cardloom.sources.csv import ParseResult, contacts_from_cells, read_contacts_csv
from cardloom.sources.headers import resolve as resolve_headers
from cardloom.sources.vcf import parse_vcf, read_vcf
from cardloom.storage import save, shared_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _with(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"


# ---- SQL pieces ----
_V = f"v AS ({CONTACTS_SQL})"
_DIGITS = "ltrim(regexp_replace({0}, '[^0-9]', '', 'g'), '0')"
_EMAIL_KEY = "(CASE WHEN instr(lower(trim({0})), '@') = 0 THEN '' ELSE split_part(split_part(lower(trim({0})), '@', 1), '+', 1) || substr(lower(trim({0})), instr(lower(trim({0})), '@')) END)"
_CODES = ", ".join(f"'{c}'" for c in calling_codes())
_COUNTRY = f"(CASE WHEN substr({{0}}, 2, 3) IN ({_CODES}) AND length({{0}}) > 3 THEN '+' || substr({{0}}, 2, 3) WHEN substr({{0}}, 2, 2) IN ({_CODES}) AND length({{0}}) > 2 THEN '+' || substr({{0}}, 2, 2) WHEN substr({{0}}, 2, 1) IN ({_CODES}) THEN '+' || substr({{0}}, 2, 1) ELSE '' END)"
_LAX = "regexp_full_match({0}, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{{2,}}')"
_KEYS = f"""k AS (
  SELECT rid AS idx, name, email, phone, org,
    {_EMAIL_KEY.format("coalesce(email, '')")} AS ek, {_DIGITS.format("coalesce(phone, '')")} AS pk,
    lower(trim(name)) AS nk, lower(trim(org)) AS ok FROM v)"""
_JW = """(CASE WHEN {a} = {b} THEN CAST(1 AS DOUBLE) WHEN {a} = '' OR {b} = '' THEN CAST(0 AS DOUBLE) ELSE (
  WITH m AS (SELECT list_reduce(range(1, CAST(length({a}) + 1 AS BIGINT)), lambda acc, i: CASE WHEN len(list_filter(range(greatest(1, i - greatest(0, greatest(length({a}), length({b})) // 2 - 1)), least(length({b}), i + greatest(0, greatest(length({a}), length({b})) // 2 - 1)) + 1), lambda j: {b}[j] = {a}[i] AND NOT list_contains(acc.u, j))) > 0
    THEN {{'u': list_append(acc.u, list_filter(range(greatest(1, i - greatest(0, greatest(length({a}), length({b})) // 2 - 1)), least(length({b}), i + greatest(0, greatest(length({a}), length({b})) // 2 - 1)) + 1), lambda j: {b}[j] = {a}[i] AND NOT list_contains(acc.u, j))[1]), 'm': list_append(acc.m, i)}} ELSE acc END,
    {{'u': CAST([] AS BIGINT[]), 'm': CAST([] AS BIGINT[])}}) AS s)
  SELECT CASE WHEN len(s.m) = 0 THEN CAST(0 AS DOUBLE) ELSE j + CAST(0.1 AS DOUBLE) * pre * (1 - j) END FROM (
    SELECT s, (CAST(len(s.m) AS DOUBLE) / length({a}) + CAST(len(s.m) AS DOUBLE) / length({b}) + (len(s.m) - CAST(len(list_filter(list_zip(list_transform(s.m, lambda i: {a}[i]), list_transform(list_sort(s.u), lambda j: {b}[j])), lambda z: z[1] <> z[2])) AS DOUBLE) / 2) / len(s.m)) / 3 AS j,
      CASE WHEN {a}[1:4] = {b}[1:4] THEN least(4, length({a}), length({b})) WHEN {a}[1:3] = {b}[1:3] THEN 3 WHEN {a}[1:2] = {b}[1:2] THEN 2 WHEN {a}[1:1] = {b}[1:1] THEN 1 ELSE 0 END AS pre FROM m)) END)"""


def _pairs_sql(keys: str) -> str:
    return " UNION ".join(f"SELECT a.idx AS a, b.idx AS b FROM k a JOIN k b ON a.{x} = b.{x} AND a.idx < b.idx WHERE a.{x} <> ''" for x in keys.split())


_MATCH = """mt AS (
  SELECT p.a, p.b, a.nk AS na, b.nk AS nb,
    CAST(CASE WHEN a.ek <> '' AND a.ek = b.ek THEN 1 ELSE 0 END AS DOUBLE) AS e, CAST(CASE WHEN a.pk <> '' AND a.pk = b.pk THEN 1 ELSE 0 END AS DOUBLE) AS p,
    CAST(CASE WHEN a.ok = '' OR b.ok = '' THEN 0 WHEN a.ok = b.ok THEN 1 WHEN contains(a.ok, b.ok) OR contains(b.ok, a.ok) THEN 0.8 ELSE 0 END AS DOUBLE) AS o
  FROM pairs p JOIN k a ON a.idx = p.a JOIN k b ON b.idx = p.b)"""
_SIMS = f"names AS (SELECT DISTINCT na, nb FROM mt), sims AS (SELECT na, nb, {_JW.format(a='na', b='nb')} AS s FROM names)"
_SCORED = """scored AS (
  SELECT a, b, CAST(0.4 AS DOUBLE) * e + CAST(0.35 AS DOUBLE) * p + (CASE WHEN s > CAST(0.6 AS DOUBLE) THEN s * CAST(0.2 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) + CAST(0.05 AS DOUBLE) * o AS score
  FROM mt JOIN sims USING (na, nb))"""
_LINKS = [_V, _KEYS, f"pairs AS ({_pairs_sql('ek pk')})", _MATCH, *[_SIMS], _SCORED, "links AS (SELECT a, b FROM scored WHERE score >= CAST(0.5 AS DOUBLE))"]
_COMP = [*_LINKS, "both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links)", "reach AS (SELECT idx AS n, idx AS m FROM k UNION SELECT r.n, t.b FROM reach r JOIN both_ways t ON r.m = t.a)", "comp AS (SELECT n AS idx, min(m) AS cluster_id FROM reach GROUP BY n)"]
_MERGED = [
    *_COMP,
    "mem AS (SELECT k.*, cluster_id FROM k JOIN comp USING (idx))",
    "big AS (SELECT cluster_id, count(*) AS n FROM mem GROUP BY cluster_id)",
    "ph AS (SELECT cluster_id, string_agg(phone, '; ' ORDER BY i) AS phones FROM (SELECT cluster_id, pk, min(idx) AS i, min_by(phone, idx) AS phone FROM mem WHERE pk <> '' GROUP BY cluster_id, pk) GROUP BY cluster_id)",
    "em AS (SELECT cluster_id, string_agg(email, '; ' ORDER BY i) AS emails FROM (SELECT cluster_id, ek, min(idx) AS i, min_by(email, idx) AS email FROM mem WHERE ek <> '' GROUP BY cluster_id, ek) GROUP BY cluster_id)",
    "hd AS (SELECT cluster_id, min_by(name, idx) AS name, min_by(org, idx) AS org FROM mem GROUP BY cluster_id)",
]


# ---- scalar functions ----
@query(f"WITH {_V} SELECT rid, CASE WHEN length(d) BETWEEN 10 AND 15 THEN (CASE WHEN starts_with(trim(phone), '+') THEN '+' ELSE '' END) || d ELSE '' END AS normalized, length(d) BETWEEN 10 AND 15 AS valid, CASE WHEN length(d) BETWEEN 10 AND 15 AND starts_with(trim(phone), '+') THEN {_COUNTRY.format("('+' || d)")} ELSE '' END AS country FROM (SELECT rid, coalesce(phone, '') AS phone, {_DIGITS.format("coalesce(phone, '')")} AS d FROM v)")
def normalize_phones(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = raw_contacts(spark, sf_dir).select("rid", normalize_phone(F.coalesce("phone", F.lit(""))).alias("p"))
    return p.select("rid", "p.normalized", "p.valid", "p.country")


@query(f"WITH d AS (SELECT p_partkey, {_DIGITS.format("concat('0', p_partkey * 7919 + 200000000, p_size)")} AS d FROM part) SELECT p_partkey, CASE WHEN length(d) BETWEEN 10 AND 15 THEN '+44' || d ELSE '' END AS normalized, length(d) BETWEEN 10 AND 15 AS valid, CASE WHEN length(d) BETWEEN 10 AND 15 THEN '+44' ELSE '' END AS country FROM d")
def normalize_phones_default_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("0"), (F.col("p_partkey") * 7919 + 200000000).cast("string"), F.col("p_size").cast("string"))
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", normalize_phone(raw, PhoneConfig("+44")).alias("p"))
    return p.select("p_partkey", "p.normalized", "p.valid", "p.country")


@query(f"WITH {_V} SELECT rid, {_DIGITS.format("coalesce(phone, '')")} AS digits FROM v")
def phone_digit_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_contacts(spark, sf_dir).select("rid", phone_digits(F.coalesce("phone", F.lit(""))).alias("digits"))


@query(f"WITH d AS (SELECT DISTINCT '+' || CAST((o_orderkey * 7919) % 99999 AS STRING) || '0000000' AS e FROM orders) SELECT e, {_COUNTRY.format('e')} AS country FROM d")
def phone_countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.concat(F.lit("+"), ((F.col("o_orderkey") * 7919) % 99999).cast("string"), F.lit("0000000"))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(e.alias("e")).distinct().select("e", phone_country(F.col("e")).alias("country"))


@query(f"WITH {_V}, n AS (SELECT rid, {_EMAIL_KEY.format("coalesce(email, '')")} AS n FROM v) SELECT rid, CASE WHEN {_LAX.format('n')} THEN n ELSE '' END AS normalized, {_LAX.format('n')} AS valid FROM n")
def normalize_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = raw_contacts(spark, sf_dir).select("rid", normalize_email(F.coalesce("email", F.lit("")), EmailConfig(strip_aliases=True)).alias("e"))
    return e.select("rid", "e.normalized", "e.valid")


@query(f"WITH {_V} SELECT rid, {_EMAIL_KEY.format("coalesce(email, '')")} AS email_key FROM v")
def email_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_contacts(spark, sf_dir).select("rid", email_key(F.coalesce("email", F.lit(""))).alias("email_key"))


@query(f"WITH {_V}, n AS (SELECT rid, CASE WHEN ends_with(name, 'Inc.') THEN trim(substr(name, 1, length(name) - 4)) ELSE name END AS f, CASE WHEN ends_with(name, 'Inc.') THEN 'Inc.' ELSE '' END AS o FROM v) SELECT rid, f AS full_name, split_part(f, ' ', 1) AS first_name, CASE WHEN contains(f, ' ') THEN split_part(f, ' ', -1) ELSE '' END AS last_name, o AS organization FROM n")
def normalize_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = raw_contacts(spark, sf_dir).select("rid", normalize_name(F.col("name"), NameConfig(True, ("Ltd.", "Inc."))).alias("n"))
    return n.select("rid", "n.full_name", "n.first_name", "n.last_name", "n.organization")


@query(f"WITH {_V} SELECT rid, lower(regexp_replace(trim(name), '\\s+', ' ', 'g')) AS name_key FROM v")
def name_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_contacts(spark, sf_dir).select("rid", name_key(F.col("name")).alias("name_key"))


@query("WITH p AS (SELECT p_partkey, lower(trim(p_brand)) AS a, lower(trim(p_type)) AS b, lower(substr(p_type, 1, 8)) AS c FROM part) SELECT p_partkey, CAST(CASE WHEN a = b THEN 1 WHEN contains(a, b) OR contains(b, a) THEN 0.8 ELSE 0 END AS DOUBLE) AS brand_type, CAST(CASE WHEN b = trim(c) THEN 1 WHEN contains(b, trim(c)) THEN 0.8 ELSE 0 END AS DOUBLE) AS type_prefix FROM p")
def organization_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    b = org_key(F.col("p_type"))
    return p.select("p_partkey", org_match(org_key(F.col("p_brand")), b).alias("brand_type"), org_match(b, org_key(F.substring("p_type", 1, 8))).alias("type_prefix"))


@query(f"WITH n AS (SELECT DISTINCT lower(p_name) AS a, lower(p_type) AS b FROM part) SELECT a, b, {_JW.format(a='a', b='b')} AS similarity FROM n")
def jaro_winkler_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.lower("p_name").alias("a"), F.lower("p_type").alias("b")).distinct()
    return n.select("a", "b", jaro_winkler("a", "b").alias("similarity"))


# ---- joins and scores ----
def _candidates(block: str, key: str) -> None:
    sql = _with(_V, _KEYS) + f"SELECT DISTINCT a.idx AS a, b.idx AS b FROM k a JOIN k b ON a.idx < b.idx AND {key.format('a')} = {key.format('b')} WHERE {key.format('a')} <> ''"

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return resolve.candidate_pairs(resolve.with_keys(contacts(spark, sf_dir)), (block,))

    run.__name__ = f"candidates_{block}"
    query(sql)(run)


_candidates("email", "{0}.ek")
_candidates("phone", "{0}.pk")


@query(_with(_V, _KEYS) + "SELECT ok AS key, count(*) AS members FROM k WHERE ok <> '' GROUP BY ok")
def org_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bucket sizes of the organization block: its pairs grow with the square of a segment, so they are counted, not listed."""
    k = resolve.block_keys(resolve.with_keys(contacts(spark, sf_dir)), ("org",))
    return k.groupBy("key").agg(F.count("*").alias("members"))


@query(_with(_V, _KEYS) + "SELECT upper(hex(encode(substr(nk, 1, 6)))) AS key, count(*) AS members FROM k WHERE nk <> '' GROUP BY 1")
def name_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = resolve.block_keys(resolve.with_keys(contacts(spark, sf_dir)), ("name",))
    return k.groupBy("key").agg(F.count("*").alias("members"))


@query(_with(*_LINKS) + "SELECT a, b, round(score, 9) AS score FROM scored")
def score_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = resolve.with_keys(contacts(spark, sf_dir))
    return resolve.score_pairs(resolve.candidate_pairs(keyed, ("email", "phone")), keyed).select("a", "b", F.round("score", 9).alias("score"))


@query(_with(*_LINKS) + "SELECT a, b FROM links")
def duplicate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.linked_pairs(resolve.with_keys(contacts(spark, sf_dir))).select("a", "b")


@query(_with(*_COMP) + "SELECT idx, cluster_id FROM comp")
def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.clusters(contacts(spark, sf_dir))


@query(_with(*_LINKS[:5], _SCORED, "links AS (SELECT a, b FROM scored WHERE score >= CAST(0.7 AS DOUBLE))", *_COMP[len(_LINKS) :]) + "SELECT idx, cluster_id FROM comp")
def clusters_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.clusters(contacts(spark, sf_dir), DedupeConfig(threshold=0.7))


@query(_with(_V, _KEYS, f"pairs AS ({_pairs_sql('ek pk ok')} UNION SELECT a.idx, b.idx FROM k a JOIN k b ON substr(a.nk, 1, 6) = substr(b.nk, 1, 6) AND a.idx < b.idx WHERE a.nk <> '')", _MATCH, _SIMS, _SCORED, "links AS (SELECT a, b FROM scored WHERE score >= CAST(0.25 AS DOUBLE))", *_COMP[len(_LINKS) :]) + "SELECT idx, cluster_id FROM comp")
def clusters_all_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At this threshold an equal name and organization suffice, so all four blocks are needed; organizations are large buckets."""
    return resolve.clusters(contacts(spark, sf_dir), DedupeConfig(threshold=0.25))


@query(_with(*_COMP) + "SELECT count(*) AS total_input, count(*) - count(DISTINCT cluster_id) AS duplicates_found, count(DISTINCT cluster_id) AS clusters_formed FROM comp")
def dedupe_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.dedupe_report(resolve.clusters(contacts(spark, sf_dir)))


@query(_with(*_COMP) + "SELECT n AS members, count(*) AS clusters FROM (SELECT cluster_id, count(*) AS n FROM comp GROUP BY cluster_id HAVING count(*) > 1) GROUP BY n")
def cluster_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = resolve.clusters(contacts(spark, sf_dir)).groupBy("cluster_id").agg(F.count("*").alias("members")).where("members > 1")
    return n.groupBy("members").agg(F.count("*").alias("clusters"))


@query(_with(*_MERGED) + "SELECT cluster_id AS idx, name, org, coalesce(phones, '') AS phones, coalesce(emails, '') AS emails, floor((1 - CAST(1 AS DOUBLE) / (n + 1)) * 100 + CAST(0.5 AS DOUBLE)) / 100 AS confidence FROM big JOIN hd USING (cluster_id) LEFT JOIN ph USING (cluster_id) LEFT JOIN em USING (cluster_id) WHERE n > 1")
def merged_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = deduplicate(contacts(spark, sf_dir)).merged
    return m.select("idx", "name", F.col("organization").alias("org"), F.array_join("phones", "; ").alias("phones"), F.array_join("emails", "; ").alias("emails"), "confidence")


@query(_with(*_MERGED) + "SELECT cluster_id AS idx, concat_ws(',', name, CASE WHEN n > 1 THEN coalesce(phones, '') ELSE coalesce(phone, '') END, CASE WHEN n > 1 THEN coalesce(emails, '') ELSE coalesce(email, '') END, org) AS line FROM (SELECT mem.cluster_id, n, hd.name, hd.org, phone, email, phones, emails FROM mem JOIN big USING (cluster_id) JOIN hd USING (cluster_id) LEFT JOIN ph USING (cluster_id) LEFT JOIN em USING (cluster_id) WHERE mem.idx = mem.cluster_id)")
def deduped_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.csv_lines(deduplicate(contacts(spark, sf_dir)).resolved)


@query(_with(*_COMP, "num AS (SELECT cluster_id, count(*) AS size, row_number() OVER (ORDER BY cluster_id) AS cluster_number FROM comp GROUP BY cluster_id)") + "SELECT cluster_number, size, idx, '  - ' || name || ' | ' || coalesce(email, '') || ' | ' || coalesce(phone, '') AS line FROM comp JOIN num USING (cluster_id) JOIN k USING (idx) WHERE size > 1")
def dry_run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = contacts(spark, sf_dir)
    return sinks.dry_run_lines(c, deduplicate(c).clusters)


@query(_with(*_COMP) + "SELECT count(*) AS input_contacts, count(DISTINCT cluster_id) AS output_vcards, count(*) - count(DISTINCT cluster_id) AS duplicates_removed, CAST(0 AS BIGINT) AS parse_errors, true AS deduplicated FROM comp")
def conversion_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = contacts(spark, sf_dir)
    return convert(ParseResult(c, spark.createDataFrame([], "row int, field string, message string")), True).summary


# ---- rendering and parsing ----
_CARD = """concat('BEGIN:VCARD', chr(13), chr(10), 'VERSION:4.0', chr(13), chr(10), 'PRODID:-//cardloom//EN', chr(13), chr(10), 'FN:', name, chr(13), chr(10),
  'N:', split_part(name, ' ', -1), ';', split_part(name, ' ', 1), ';', CASE WHEN len(string_split(name, ' ')) > 2 THEN split_part(name, ' ', 2) ELSE '' END, ';;', chr(13), chr(10),
  'ORG:', org, chr(13), chr(10), CASE WHEN phone IS NULL THEN '' ELSE concat('TEL;VALUE=uri:tel:+', pk, chr(13), chr(10)) END,
  CASE WHEN email IS NULL THEN '' ELSE concat('EMAIL:', ek, chr(13), chr(10)) END, 'END:VCARD', chr(13), chr(10))"""


@query(_with(_V, _KEYS) + f"SELECT idx, {_CARD} AS vcard FROM k")
def to_vcard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.vcards(contacts(spark, sf_dir))


@query("SELECT p_partkey, replace(replace(replace(replace(concat(p_name, ';', p_brand, ',', chr(92), p_type, chr(10)), chr(92), chr(92) || chr(92)), ';', chr(92) || ';'), ',', chr(92) || ','), chr(10), chr(92) || 'n') AS escaped FROM part")
def vcard_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat("p_name", F.lit(";"), "p_brand", F.lit(",\\"), "p_type", F.lit("\n"))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", escape(raw).alias("escaped"))


@query("WITH p AS (SELECT p_partkey, list_filter(string_split(p_name, ' '), lambda x: x <> '') AS w FROM part) SELECT p_partkey, CASE len(w) WHEN 0 THEN ';;;;' WHEN 1 THEN ';' || w[1] || ';;;' ELSE w[-1] || ';' || w[1] || ';' || array_to_string(w[2:len(w) - 1], ' ') || ';;' END AS n FROM p")
def structured_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", structured_name(F.col("p_name")).alias("n"))


def _vcf_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of vCards: one for each 50 contacts in the order of idx."""
    cards = sinks.vcards(contacts(spark, sf_dir))
    g = cards.groupBy(F.floor(F.col("idx") / 50).alias("file_ord")).agg(F.array_sort(F.collect_list(F.struct("idx", "vcard"))).alias("c"))
    return g.select("file_ord", F.array_join(F.transform("c", lambda x: x["vcard"]), "").alias("value"))


@query(_with(_V, _KEYS) + "SELECT row_number() OVER (ORDER BY idx) - 1 AS idx, name, org, CASE WHEN phone IS NULL THEN '' ELSE '+' || pk END AS phones, ek AS emails FROM k")
def parse_vcards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contacts rendered to files of 50 cards and read again."""
    c = parse_vcf(_vcf_texts(spark, sf_dir)).contacts
    return c.select("idx", "name", F.col("organization").alias("org"), F.array_join("phones", "; ").alias("phones"), F.array_join("emails", "; ").alias("emails"))


@query(_with(_V, _KEYS) + "SELECT row_number() OVER (ORDER BY idx) - 1 AS idx, concat_ws(',', name, CASE WHEN phone IS NULL THEN '' ELSE '+' || pk END, ek, org) AS line FROM k")
def vcf_to_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.csv_lines(parse_vcf(_vcf_texts(spark, sf_dir)).contacts)


@query(_with(_V, _KEYS) + "SELECT idx, name, CASE WHEN phone IS NULL THEN '' ELSE '+' || pk END AS phones, ek AS emails, org FROM k")
def normalized_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = normalize.normalize_records(contacts(spark, sf_dir))
    return r.select("idx", "name", F.array_join("phones", "; ").alias("phones"), F.array_join("emails", "; ").alias("emails"), "org")


@query(_with(_V, _KEYS) + """SELECT idx, concat('{"name":"', name, '","phones":', CASE WHEN phone IS NULL THEN 'null' ELSE '["+' || pk || '"]' END, ',"emails":', CASE WHEN email IS NULL THEN 'null' ELSE '["' || ek || '"]' END, ',"org":"', org, '"}') AS record FROM k""")
def normalize_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.normalize_records(contacts(spark, sf_dir)).select("idx", sinks.json_record().alias("record"))


@query(_with(_V, _KEYS) + "SELECT idx, CASE WHEN ends_with(name, ' Inc.') THEN substr(name, 1, length(name) - 5) ELSE name END AS name, CASE WHEN phone IS NULL THEN '' ELSE '+' || pk END AS phones, lower(coalesce(email, '')) AS emails, org FROM k")
def normalized_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = spark.createDataFrame([], "row int, field string, message string")
    c = normalize_and_convert(ParseResult(contacts(spark, sf_dir), none), NameConfig(True, ("Inc.",))).contacts
    return c.select("idx", "name", F.array_join("phones", "; ").alias("phones"), F.array_join("emails", "; ").alias("emails"), F.col("organization").alias("org"))


# ---- CSV rows ----
_HEADERS = ["First Name", "Last Name", "Phone 1", "mobile", "E-mail", "Company", "Notes"]


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = raw_contacts(spark, sf_dir)
    blank = F.col("rid") % 9 == 0
    cell = lambda x: F.when(blank, "").otherwise(F.coalesce(x, F.lit("")))
    return c.select(F.col("rid").alias("ord"), (F.col("rid") + 1).cast("int").alias("row"), F.array(cell(F.concat(F.lit(" "), F.substring_index("name", " ", 1))), cell(F.substring_index("name", " ", -1)), cell(F.col("phone")), F.lit("  "), cell(F.col("email")), cell(F.col("org")), F.lit("x")).alias("cells"))


def _rows_query(name: str, dialect, which: int) -> None:
    keep = "rid % 9 <> 0"
    cols = f"split_part(name, ' ', {which}) AS name, coalesce({'phone' if dialect.headers == 'fuzzy' else 'NULL'}, '') AS phones, coalesce(email, '') AS emails, org"
    sql = f"WITH {_V} SELECT row_number() OVER (ORDER BY rid) - 1 AS idx, CAST(rid + 1 AS INTEGER) AS row, {cols} FROM v WHERE {keep}"

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = contacts_from_cells(_cells(spark, sf_dir), resolve_headers(_HEADERS, dialect.headers), dialect).contacts
        return c.select("idx", "source.row", "name", F.array_join("phones", "; ").alias("phones"), F.array_join("emails", "; ").alias("emails"), F.col("organization").alias("org"))

    run.__name__ = name
    query(sql)(run)


_rows_query("csv_rows_convert", CONVERT, 1)
_rows_query("csv_rows_dedupe", DEDUPE, 1)
_rows_query("csv_rows_normalize", NORMALIZE, -1)


@query(f"WITH {_V} SELECT CAST(rid + 1 AS INTEGER) AS row, 'row' AS field, 'no recognizable contact fields in row' AS message FROM v WHERE rid % 9 = 0")
def parse_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contacts_from_cells(_cells(spark, sf_dir), resolve_headers(_HEADERS), CONVERT).errors


_MAPPING = {"first name": "org", "Notes": "name", "COMPANY": "none"}


@query(f"WITH {_V} SELECT row_number() OVER (ORDER BY rid) - 1 AS idx, CASE WHEN name = '' THEN 'x' ELSE split_part(name, ' ', -1) END AS name, coalesce(phone, '') AS phones, coalesce(email, '') AS emails, split_part(name, ' ', 1) AS org FROM (SELECT rid, CASE WHEN rid % 9 = 0 THEN '' ELSE name END AS name, CASE WHEN rid % 9 <> 0 THEN phone END AS phone, CASE WHEN rid % 9 <> 0 THEN email END AS email FROM v)")
def csv_rows_mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mapping of headers wins over detection, and a value that is no field hides a column."""
    d = CsvDialect(mapping=_MAPPING)
    return _flat(contacts_from_cells(_cells(spark, sf_dir), resolve_headers(_HEADERS, d.headers, d.mapping), d).contacts)


# ---- files in the shared folder ----
def _flat(c: DataFrame, org: str = "organization") -> DataFrame:
    return c.select("idx", "name", F.array_join("phones", "; ").alias("phones"), F.array_join("emails", "; ").alias("emails"), F.col(org).alias("org"))


def _csv_folder(spark: SparkSession, sf_dir: str) -> str:
    """CSV files of the contacts with quotes, commas and line ends in some names; each ninth has an organization alone, each eleventh nothing."""
    rid = F.col("rid")
    name = F.when(rid % 4 == 0, F.concat("name", F.lit(',\n"x"'))).otherwise(F.col("name"))
    some = lambda c: F.when((rid % 9 == 0) | (rid % 11 == 0), F.lit("")).otherwise(F.coalesce(c, F.lit("")))
    rows = raw_contacts(spark, sf_dir).select(rid.alias("idx"), some(name).alias("name"), F.array(some(F.col("phone"))).alias("phones"), F.array(some(F.col("email"))).alias("emails"), F.when(rid % 11 == 0, "").otherwise(F.col("org")).alias("organization"))
    path = shared_dir(spark) + "-csv"
    sinks.write_csv(rows, path)
    return path


def _files_query(name: str, dialect: CsvDialect, keep: str) -> None:
    sql = f"""WITH {_V} SELECT row_number() OVER (ORDER BY rid) - 1 AS idx, CASE WHEN rid % 9 = 0 THEN '' WHEN rid % 4 = 0 THEN concat(name, ',', chr(10), '"x"') ELSE name END AS name,
      CASE WHEN rid % 9 = 0 THEN '' ELSE coalesce(phone, '') END AS phones, CASE WHEN rid % 9 = 0 THEN '' ELSE coalesce(email, '') END AS emails, org FROM v WHERE {keep}"""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _flat(read_contacts_csv(spark, _csv_folder(spark, sf_dir), dialect).contacts)

    run.__name__ = name
    query(sql)(run)


_files_query("csv_files_convert", CONVERT, "rid % 11 <> 0")
_files_query("csv_files_dedupe", DEDUPE, "rid % 11 <> 0 AND rid % 9 <> 0")
_files_query("csv_files_normalize", NORMALIZE, "rid % 11 <> 0")


@query(_with(_V, _KEYS) + "SELECT row_number() OVER (ORDER BY idx) - 1 AS idx, name, CASE WHEN phone IS NULL THEN '' ELSE '+' || pk END AS phones, ek AS emails, org FROM k")
def vcf_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contacts written to vCard files and read again."""
    path = shared_dir(spark) + "-vcf"
    sinks.write_vcf(contacts(spark, sf_dir), path)
    return _flat(read_vcf(spark, path).contacts)


@query(f"WITH {_V} SELECT row_number() OVER (ORDER BY rid) - 1 AS idx, 'Dr. ' || split_part(name, ' ', 1) || ' ' || split_part(name, ' ', 2) AS name, coalesce(phone, '') AS phones, 'a,b' || rid || '@x.yz' AS emails, org || ', x;y' AS org FROM v")
def vcf_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards without FN, with escaped and folded values."""
    part = lambda i: F.split("name", " ")[i]
    tel = F.when(F.col("phone").isNotNull(), F.concat(F.lit("\r\nTEL;TYPE=home:"), "phone")).otherwise("")
    card = F.concat(F.lit("BEGIN:VCARD\r\nN:"), part(1), F.lit(";"), part(0), F.lit(";;Dr.;"), tel, F.lit("\r\nitem1.EMAIL:no@x.yz\r\nEMAIL:a\\,b\r\n "), F.col("rid").cast("string"), F.lit("@x.yz\r\nORG:"), "org", F.lit("\\, x\\;y\r\nEND:VCARD"))
    path = shared_dir(spark) + "-vcf"
    raw_contacts(spark, sf_dir).orderBy("rid").select(card.alias("value")).write.option("lineSep", "\r\n").text(path)
    return _flat(read_vcf(spark, path).contacts)


@query(_with(*_COMP, """one AS (SELECT cluster_id, idx, concat('{"name":"', name, '"', CASE WHEN phone IS NULL THEN '' ELSE ',"phones":["' || phone || '"]' END, CASE WHEN email IS NULL THEN '' ELSE ',"emails":["' || email || '"]' END, ',"org":"', org, '"}') AS j FROM k JOIN comp USING (idx))""") + "SELECT cluster_id, '[' || string_agg(j, ',' ORDER BY idx) || ']' AS members FROM one GROUP BY cluster_id HAVING count(*) > 1")
def cluster_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = save(contacts(spark, sf_dir))
    return sinks.cluster_json(c, resolve.clusters(c))


def _loud(name: str) -> dict | None:
    """Stands in for a name service: it knows names that begin with A."""
    return {"full_name": name.upper(), "first_name": name[:1]} if name.startswith("A") else None


@query(f"WITH {_V} SELECT rid, CASE WHEN starts_with(name, 'A') THEN upper(name) ELSE name END AS full_name, CASE WHEN starts_with(name, 'A') THEN 'A' ELSE split_part(name, ' ', 1) END AS first_name FROM v")
def names_by_service(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = with_llm_names(raw_contacts(spark, sf_dir), NameConfig(use_llm=True, llm=_loud), "name", "n")
    return n.select("rid", "n.full_name", "n.first_name")


_ADDRESSES = ["{0}@x.yz", "Ann Lee <{0}@x.yz>", '"a {0}"@x.yz', "{0}@@x.yz", "{0}@", "a{0}", "{0}..b@x.yz", "a b{0}@x.yz", "{0}@x"]


@query("SELECT c_custkey, CAST(c_custkey % 9 IN (0, 1, 2, 8) AS BOOLEAN) AS valid FROM customer")
def strict_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.array(*(F.replace(F.lit(a), F.lit("{0}"), F.concat(F.lit("u"), F.col("c_custkey").cast("string"))) for a in _ADDRESSES))
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", normalize_email(F.get(raw, F.col("c_custkey") % 9), EmailConfig(strict=True)).alias("e"))
    return c.select("c_custkey", "e.valid")


# ---- contact data in other tables ----
_MAIL = "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}"
_TEL = "\\+[0-9]{1,3} \\([0-9]{3}\\) [0-9]{3}-[0-9]{4}"


@query(f"WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_MAIL}')) AS raw FROM documents) SELECT doc_id, raw, {_EMAIL_KEY.format('raw')} AS email_key, count(*) AS n FROM m GROUP BY ALL")
def emails_in_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(_MAIL), F.lit(0))).alias("raw"))
    return m.groupBy("doc_id", "raw").agg(F.count("*").alias("n")).select("doc_id", "raw", email_key(F.col("raw")).alias("email_key"), "n")


@query(f"WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_TEL}')) AS raw FROM documents) SELECT doc_id, raw, '+' || {_DIGITS.format('raw')} AS normalized, count(*) AS n FROM m WHERE length({_DIGITS.format('raw')}) >= 10 GROUP BY ALL")
def phones_in_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(_TEL), F.lit(0))).alias("raw"))
    p = m.groupBy("doc_id", "raw").agg(F.count("*").alias("n")).withColumn("p", normalize_phone(F.col("raw")))
    return p.where("p.valid").select("doc_id", "raw", "p.normalized", "n")


@query("SELECT s_suppkey, lower(array_to_string(list_filter(string_split_regex(s_name, '[#0 ]+'), lambda x: x <> ''), ' ')) AS k FROM supplier")
def supplier_name_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", squeeze(F.regexp_replace("s_name", "[#0 ]+", " ")).alias("k"))
