"""The queries of the ten operators, opN_<name>, over their whole tables, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardloom.llm import language_id, packing, quality, sentencepiece_lattice, token_files, toxicity
from cardloom.llm.common import crc_mod, read_table
from cardloom.llm.embedding_dedup import embedding_near_dedup
from cardloom.llm.kdtree_search import exact_top_k, integer_vectors
from cardloom.llm.minhash_dedup import minhash_near_dedup
from cardloom.llm.substring_dedup import remove_repeated

Query = Callable[[SparkSession, str], DataFrame]


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id, kept of each vec_id; see embedding_near_dedup. Rows without vec_id are left out."""
    return embedding_near_dedup(read_table(spark, sf_dir, "embeddings"), 0.98)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each row, read back from the files; see write_tokens. Null texts are empty; null doc_ids come first."""
    data = token_files.write_tokens(read_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), token_files.default_path(spark))
    return token_files.read_tokens(spark, data)


def op3_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, log_weight, n_grams, gumbel_key, selected for each document; only labels and texts are looked at."""
    return quality.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row; see minhash_near_dedup. Rows without doc_id are alone and not kept."""
    return minhash_near_dedup(read_table(spark, sf_dir, "documents"), 5, 85)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of each row; rows without doc_id are not learned from and not held out; null and empty texts get the bias alone."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = crc_mod("doc_id", 5) == 0
    model = toxicity.train(docs.where(~held_out), read_table(spark, sf_dir, "labels").where(~held_out))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row; rows without doc_id are not learned from and not held out; null texts get und."""
    docs = read_table(spark, sf_dir, "documents")
    held_out = crc_mod("doc_id", 4) == 2
    prototypes = language_id.fit_prototypes(docs.where(~held_out).select("doc_id", "text", "lang"))
    found = language_id.identify(docs.select("doc_id", "text"), prototypes)
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (ids as little-endian unsigned 32-bit numbers), and n_chars and text_crc32 (UTF-8) of what the ids decode to, for each document."""
    model = tokenizer_path("piece_bpe_32k.model")
    back = sentencepiece_lattice.encode(read_table(spark, sf_dir, "documents"), model, with_text=True)
    return back.select("doc_id", "n_tokens", "ids_crc32", F.length("text").cast("long").alias("n_chars"), F.crc32(F.encode("text", "UTF-8")).alias("text_crc32"))


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score; see exact_top_k and integer_vectors. A vec_id that repeats counts once; rows without vec_id take no part."""
    vectors = integer_vectors(read_table(spark, sf_dir, "embeddings"))
    return exact_top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0), 10)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each row; see remove_repeated. Null texts have no words; rows without doc_id stay whole."""
    return remove_repeated(read_table(spark, sf_dir, "documents"), 13)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of each piece; see cut_pieces and pack. Null texts are one id."""
    cut = packing.cut_pieces(read_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return packing.pack(cut)


QUERIES: dict[str, Query] = {
    "op1_embedding_dedup": op1_embedding_dedup,
    "op2_token_files": op2_token_files,
    "op3_quality_resampling": op3_quality_resampling,
    "op4_minhash_dedup": op4_minhash_dedup,
    "op5_toxicity": op5_toxicity,
    "op6_language_id": op6_language_id,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_exact_top_k": op8_exact_top_k,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_best_fit_packing": op10_best_fit_packing,
}

ORACLE_SQL: dict[str, str] = {
    "op1_embedding_dedup": """
WITH RECURSIVE e AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id IS NOT NULL
), ok AS (
  SELECT * FROM e WHERE label IS NOT NULL AND v IS NOT NULL AND len(v) > 0
    AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(v, v) > 0
), pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= CAST(0.98 AS DOUBLE)
), reach AS (
  SELECT vec_id AS n, vec_id AS m FROM e
  UNION
  SELECT r.n, p.b FROM reach r JOIN pairs p ON r.m = p.a
), comp AS (SELECT n, min(m) AS c FROM reach GROUP BY n), links AS (SELECT a, count(*) AS k FROM pairs GROUP BY a)
SELECT e.vec_id, CAST(coalesce(k, 0) AS BIGINT) AS n_links, c AS component_id, e.vec_id = c AS kept
FROM e JOIN comp ON comp.n = e.vec_id LEFT JOIN links ON links.a = e.vec_id
""",
    "op4_minhash_dedup": """
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, CAST(len(w) - 3 AS BIGINT)), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g
  FROM d
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
inter AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
pairs AS (
  SELECT a, b FROM inter JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)
), reach AS (
  SELECT doc_id AS n, doc_id AS m FROM documents
  UNION
  SELECT r.n, p.b FROM reach r JOIN pairs p ON r.m = p.a
), comp AS (SELECT n, min(m) AS c FROM reach GROUP BY n)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c AS component_id, d.doc_id = c AS kept
FROM documents d JOIN comp ON comp.n = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
""",
    "op8_exact_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_dot_product(CAST(q.x AS DOUBLE[]), CAST(c.x AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.x) = len(c.x) WHERE q.vec_id % 100 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
""",
    "op9_substring_dedup": """
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), win AS (
  SELECT doc_id, CAST(i AS BIGINT) AS i, array_to_string(w[i:i + 12], ' ') AS g
  FROM d, unnest(range(1, CAST(len(w) - 11 AS BIGINT))) AS t(i) WHERE len(w) >= 13
), low AS (SELECT g, min(doc_id) AS m FROM win GROUP BY g),
gone AS (
  SELECT DISTINCT win.doc_id, win.i + j AS p FROM win JOIN low USING (g), unnest(range(0, 13)) AS t(j) WHERE m < win.doc_id
), lists AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id),
kept AS (
  SELECT d.doc_id, w, coalesce(len(ps), 0) AS n_removed,
         CASE WHEN ps IS NULL THEN w ELSE list_transform(list_filter(list_zip(w, range(1, CAST(len(w) + 1 AS BIGINT))), lambda x: NOT list_contains(ps, x[2])), lambda x: x[1]) END AS k
  FROM d LEFT JOIN lists USING (doc_id)
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256 FROM kept
""",
}
