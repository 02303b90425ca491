"""Quality by importance resampling (Xie et al., 2023): hashed n-gram models of target and raw text.

The log importance weight of a text is the sum over its words, word pairs and word ends of log p_target - log p_raw,
both taken over 2 ** bits hash buckets. Texts are sampled without replacement in proportion to their weights by Gumbel top-k: the k with
the largest log weight plus Gumbel noise, where k is how many texts weigh at least what good texts do (see ``fit``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cardloom.llm.common import _GOLD, fmix, pieces, save, ship, words_of

BITS = 16
#: Most labelled texts that the target model and the choice of k are fitted on.
LABELLED = 20_000


def ngram_buckets(batch: pa.RecordBatch, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(doc, bucket) of each word, each pair of neighbouring words and each word's last three bytes, with repeats."""
    w = words_of(batch, lower=True)
    h, shift = w.hashes(), np.uint64(64 - bits)
    same = np.flatnonzero(w.doc[1:] == w.doc[:-1]) if len(w) else np.empty(0, np.int64)
    pair = fmix(h[same] * _GOLD + h[same + 1]) if len(same) else np.empty(0, np.uint64)
    keys = np.concatenate([fmix(h), pair, fmix(w.suffix_hashes(3) ^ _GOLD)])
    return np.concatenate([w.doc, w.doc[same], w.doc]).astype(np.int64), (keys >> shift).astype(np.int64)


def bucket_counts(docs: DataFrame, bits: int = BITS) -> np.ndarray:
    """Counts over all texts: 2 ** bits sums, added up where the texts are and then by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = np.zeros(1 << bits, np.int64)
        for b in pieces(batches):
            c += np.bincount(ngram_buckets(b, bits)[1], minlength=1 << bits)
        at = np.flatnonzero(c)
        yield pa.record_batch({"k": pa.array(at.astype(np.int32)), "n": pa.array(c[at])})

    out = np.zeros(1 << bits)
    for k, n in docs.select("text").mapInArrow(run, "k int, n long").groupBy("k").agg(F.sum("n")).collect():  # at most 2 ** bits rows
        out[k] = n
    return out


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """log p_target - log p_raw; the target's counts are smoothed by one pseudo-count a bucket (but no more than there are counts), dealt out as the raw text is."""
    q = (raw + 0.01) / (raw + 0.01).sum()
    extra = min(len(raw), max(1.0, target.sum()))
    p = (target + extra * q) / (target.sum() + extra)
    return np.log(p) - np.log(q)


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, bits: int = BITS) -> tuple[np.ndarray, float]:
    """The table of log ratios, and the log weight under which a text is taken for low quality; the texts that reach it are counted for k.

    Target: texts labelled quality = 1. Raw: all texts. At most ``labelled`` labels are used, those with
    the smallest hash of doc_id. Two thirds of the good texts make the target model; the limit is the one
    that gains most on the rest of the labels, which the model has not seen: the share of bad texts under it
    less five times the share of good ones, placed in the middle of the gap. Without labels of both kinds there nothing is rejected.
    Documents are weighed once for each labelled doc_id (the smallest weight, if texts differ).
    """
    ship(docs.sparkSession)
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled)
    texts = save(docs.select("doc_id", "text").join(F.broadcast(known), "doc_id"))  # at most `labelled` ids
    held_out = F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(3)) == 0
    table = log_ratio(bucket_counts(texts.where("quality = 1").where(~held_out), bits), bucket_counts(docs, bits))
    seen = weights(texts.where(held_out), table, bits).groupBy("doc_id", "quality").agg(F.min("log_weight").alias("w")).collect()  # at most `labelled` rows
    x, y = np.array([r["w"] for r in seen]), np.array([r["quality"] for r in seen])
    if not len(y) or not (y == 1).any() or not (y == 0).any():
        return table, -np.inf
    o = np.argsort(x, kind="stable")
    x, y = x[o], y[o]
    bad, good = np.cumsum(y == 0) / (y == 0).sum(), np.cumsum(y == 1) / (y == 1).sum()
    i = int((bad - 5 * good).argmax())  # a good text that goes is worse than a bad one that stays
    limit = (x[i] + x[i + 1]) / 2 if i + 1 < len(x) else x[i] + 1
    return table, float(limit)


def weights(docs: DataFrame, table: np.ndarray, bits: int = BITS, with_text: bool = False) -> DataFrame:
    """The columns of ``docs`` (text only if asked for), then log_weight and n_grams; 0 and 0 for null and empty texts."""
    spark = docs.sparkSession
    ship(spark)
    ratios = spark.sparkContext.broadcast(table.astype(np.float64))  # 2 ** bits numbers whatever the input
    keep = [c for c in docs.columns if c not in ("log_weight", "n_grams") and (c != "text" or with_text)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = ratios.value
        for b in pieces(batches):
            doc, k = ngram_buckets(b, bits)
            s, n = np.bincount(doc, t[k], b.num_rows), np.bincount(doc, minlength=b.num_rows)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(s, pa.float64()), pa.array(n, pa.int64())], [*keep, "log_weight", "n_grams"])

    return docs.select(*keep, *["text"] * ("text" not in keep)).mapInArrow(run, StructType([docs.schema[c] for c in keep]).add("log_weight", "double").add("n_grams", "long"))


def kth_largest(values: DataFrame, k: int) -> tuple[int, int]:
    """The k-th largest of the long column ``key``, and how many of its equals belong to the top k.

    Four passes of 16 bits each: a pass brings at most 65,536 counts to the driver.
    """
    prefix, left = 0, k
    for shift in (48, 32, 16, 0):
        u = F.col("key").bitwiseXOR(F.lit(-(1 << 63)))
        part = values if shift == 48 else values.where(F.shiftrightunsigned(u, shift + 16) == prefix)
        counts = sorted(part.groupBy(F.shiftrightunsigned(u, shift).bitwiseAND(F.lit(0xFFFF)).alias("d")).count().collect(), reverse=True)
        for d, n in counts:
            if left <= n:
                prefix = prefix << 16 | d
                break
            left -= n
    return (prefix ^ (1 << 63)) - (1 << 64) if prefix ^ (1 << 63) >= 1 << 63 else prefix ^ (1 << 63), left


def gumbel_key(log_weight: Column, seed: int, temperature: float) -> Column:
    """log_weight plus Gumbel noise that is a function of doc_id and ``seed``: a task that runs again gives the same."""
    u = (F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    return log_weight - F.lit(temperature) * F.log(-F.log(u))


def top_k(keyed: DataFrame, k: int) -> Column:
    """Whether a row is among the ``k`` with the largest gumbel_key, for ``keyed`` (doc_id, gumbel_key) and rows like it.

    Equal keys (to a millionth) go to the smaller doc_id; rows repeated under a doc_id share one key and may all be chosen.
    """
    n = keyed.count()
    if k >= n or k <= 0:
        return F.lit(k > 0)
    key = F.round(F.col("gumbel_key") * 1e6).cast("long")  # integers in the same order
    kth, ties = kth_largest(keyed.select(key.alias("key")), k)
    same = keyed.where(key == kth)
    if same.count() <= ties:
        return key >= kth
    last = kth_largest(same.where("doc_id is not null").select((-F.col("doc_id")).alias("key")), ties)[0]
    return (key > kth) | ((key == kth) & F.coalesce(-F.col("doc_id") >= F.lit(last), F.lit(False)))


def resample(weighted: DataFrame, k: int, seed: int = 11, temperature: float = 1.0) -> DataFrame:
    """``weighted`` (doc_id, log_weight, ...) with gumbel_key and selected: the k largest keys, exactly."""
    keyed = save(weighted.withColumn("gumbel_key", gumbel_key(F.col("log_weight"), seed, temperature)))
    return keyed.withColumn("selected", top_k(keyed.select("doc_id", "gumbel_key"), k))


def _keyed(docs: DataFrame, table: np.ndarray, limit: float, seed: int) -> tuple[DataFrame, Column]:
    """The weights of ``docs`` with their keys, saved, and whether a row is sampled: k is the number of texts that reach ``limit``."""
    keyed = save(weights(docs.select("doc_id", "text"), table).withColumn("gumbel_key", gumbel_key(F.col("log_weight"), seed, 1.0)))
    return keyed, top_k(keyed.select("doc_id", "gumbel_key"), keyed.where(F.col("log_weight") >= limit).count())


def classify(docs: DataFrame, labels: DataFrame, seed: int = 11) -> DataFrame:
    """doc_id, log_weight, n_grams, gumbel_key, selected for each row of ``docs`` (doc_id, text).

    k is the number of texts whose log weight reaches the learned limit. Texts without words hold no evidence and
    weigh 0; null texts count as empty. Rows repeated under a doc_id share their noise. Labels whose document is missing teach
    nothing; without labels of both kinds all are selected. An empty table gives an empty result.
    """
    keyed, chosen = _keyed(docs, *fit(docs, labels), seed)
    return keyed.withColumn("selected", chosen)


def keep_selected(docs: DataFrame, labels: DataFrame, seed: int = 11) -> DataFrame:
    """The rows of ``docs`` that ``classify`` selects, with all their columns. Texts are weighed twice and never shuffled."""
    table, limit = fit(docs, labels)
    if limit == -np.inf:
        return docs
    chosen = _keyed(docs, table, limit, seed)[1]
    return weights(docs, table, with_text=True).withColumn("gumbel_key", gumbel_key(F.col("log_weight"), seed, 1.0)).where(chosen).select(*docs.columns)
