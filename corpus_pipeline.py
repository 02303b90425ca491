"""A training-data pipeline over the table documents: each stage works on what the one before kept.

STAGES: (name, function); a function takes (spark, docs, sf_dir). All but the last return the columns
of documents; the last returns the pieces of the packed sequences. No SQL can express the learned stages,
so ORACLE_SQL is None; tests/llm checks the stages one by one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardloom.llm import language_id, minhash_dedup, packing, quality, substring_dedup
from cardloom.llm.common import read_table, save
from cardloom.llm.queries import tokenizer_path

ORACLE_SQL = None
NEAR_HASHES = 300  # 50 bands of 6: a link at similarity 0.8 shares none with probability 2.5e-7


def select_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Importance resampling towards the texts labelled good: documents that are not sampled go."""
    return quality.keep_selected(docs, read_table(spark, sf_dir, "labels"))


def check_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Hyperdimensional language ID: texts without letters go, and those that are plainly in another language than they claim.

    Plainly: by what the found and the claimed language explain of the text, the claimed one carries less than a fifth of it; the
    noise of short texts counts for the claim, so texts of two languages and those that tell little stay. A null language
    claims nothing; one without a prototype is wrong if the cosine with another is at least 0.95.
    """
    prototypes = language_id.fit_prototypes(docs.select("doc_id", "text", "lang"))
    found = language_id.identify(docs, prototypes, claim="lang")
    unlearned = F.coalesce(~F.col("lang").isin(*prototypes), F.lit(False)) & (F.col("score") >= 0.95)
    wrong = F.col("refuted") | unlearned
    return found.where((F.col("lang_pred") != "und") & ~wrong).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup, 5-word shingles, similarity 0.8: the first document of each group stays.

    Rows repeated under a doc_id are one document; rows without doc_id are groups of their own.
    """
    kept = minhash_dedup.minhash_near_dedup(docs.select("doc_id", "text"), 5, 80, NEAR_HASHES).where("kept").select("doc_id")
    first = docs.join(save(kept.distinct()), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return first.select(*docs.columns).unionAll(docs.where("doc_id is null"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Substring dedup, windows of 13 words: repeated words go, and documents of which none is left."""
    found = substring_dedup.remove_repeated(docs, 13, with_text=True).where("n_words > n_removed")
    new = {"doc_id": F.col("doc_id"), "text": F.col("text"), "n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)}
    return found.select(*(new.get(c, F.col(f"rest.{c}")).cast(docs.schema[c].dataType).alias(c) for c in docs.columns))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing into sequences of at most 2048 tokens: one row for each piece."""
    return packing.pack(packing.cut_pieces(docs, tokenizer_path("byte_bpe_50k.json")))


STAGES = [
    ("quality_resampling", select_quality),
    ("language_id", check_language),
    ("minhash_near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("best_fit_packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; each stage's rows are written to the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = save(docs)
    return docs
