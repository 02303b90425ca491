"""Toxicity by non-negative positive-unlabelled learning (Kiryo et al., 2017).

A logistic model over hashed features is fitted with numpy from confirmed toxic texts (positive) and
unlabelled ones. With class prior p the risk is p * E_pos[l(+)] + max(0, E_unl[l(-)] - p * E_pos[l(-)]);
where the part in brackets falls below zero in a batch, its gradient is climbed instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cardloom.llm.common import fmix, pieces, ship, words_of

BITS = 18
#: Most positive and most unlabelled texts that a model is fitted on.
POSITIVE, UNLABELLED = 6000, 12_000
#: Most features of one text in the fit (those with the smallest hash): the samples are bounded in bytes too. Scores use all features.
LONGEST = 20_000
PREFIXES = (4, 5, 6)


def features(batch: pa.RecordBatch, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(doc, feature) pairs without repeats: words (lower case) and their first 4, 5 and 6 bytes, hashed."""
    w = words_of(batch, lower=True)
    shift = np.uint64(64 - bits)
    keys = [(fmix(h) >> shift).astype(np.int64) for h in (w.hashes(), *(w.hashes(p) for p in PREFIXES))]
    pairs = np.unique(np.concatenate([w.doc.astype(np.int64) << bits | k for k in keys]) if len(w) else np.empty(0, np.int64))
    return pairs >> bits, pairs & ((1 << bits) - 1)


def collect_features(docs: DataFrame, most: int, bits: int = BITS, longest: int = LONGEST) -> list[np.ndarray]:
    """Feature lists of at most ``most`` of the texts (h, text), those with the smallest h, on the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            doc, f = features(b, bits)
            cuts = np.searchsorted(doc, np.arange(b.num_rows + 1))
            lists = [f[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
            lists = [x if len(x) <= longest else np.sort(x[np.argsort(fmix(x.astype(np.uint64)), kind="stable")[:longest]]) for x in lists]
            yield pa.record_batch({"h": b.column("h"), "f": pa.array([x.astype("<i4").tobytes() for x in lists], pa.binary())})

    rows = docs.select("h", "text").mapInArrow(run, "h long, f binary").orderBy("h", "f").limit(most).collect()
    return [np.frombuffer(r["f"], "<i4") for r in rows]


def informative(pos: list[np.ndarray], unl: list[np.ndarray], ratio: float = 1.0, support: float = 0.005, bits: int = BITS) -> np.ndarray:
    """Log ratio of document frequencies, positive against unlabelled, of the features that mark positives; 0 for others.

    A feature must occur in ``support`` of the positive texts and beyond chance: in 3 texts and 4 standard
    deviations more than the unlabelled texts let expect. What only a few known texts hold is not learned by heart. The fit asks for a ratio that makes 4 of 10 texts with the
    feature positive at the class prior.
    """
    p, u = (np.bincount(np.concatenate([*x, np.empty(0, np.int32)]).astype(np.int64), minlength=1 << bits) for x in (pos, unl))
    r = np.log((p + 1) / (len(pos) + 2)) - np.log((u + 1) / (len(unl) + 2))
    chance = len(pos) * (u + 1) / (len(unl) + 2)
    return np.where((p >= support * len(pos)) & (p >= chance + 4 * np.sqrt(chance) + 3) & (r >= ratio), r, 0.0)


def risk(zp: np.ndarray, zu: np.ndarray, prior: float) -> tuple[float, float]:
    """The two parts of the risk for the logits of positive and unlabelled texts: prior * E_pos[l(+)], and E_unl[l(-)] - prior * E_pos[l(-)]."""
    return prior * float(np.logaddexp(0, -zp).mean()), float(np.logaddexp(0, zu).mean()) - prior * float(np.logaddexp(0, zp).mean())


def slopes(zp: np.ndarray, zu: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """By which the logits are to fall: the gradient of the whole risk or, where its second part is below 0, of minus that part."""
    sp, su = (1 / (1 + np.exp(-np.clip(z, -40, 40))) for z in (zp, zu))
    if risk(zp, zu, prior)[1] >= 0:
        return np.full(len(zp), -prior / len(zp)), su / len(zu)
    return prior * sp / len(zp), -su / len(zu)


def fit_nnpu(pos: list[np.ndarray], unl: list[np.ndarray], prior: float, bits: int = BITS, steps: int = 300, rate: float = 0.1) -> tuple[np.ndarray, float]:
    """Weights and bias by full-batch Adagrad on the non-negative risk with the logistic loss, over features scaled by their log ratios."""
    bias, b2 = float(np.log(prior / (1 - prior))), 1e-8
    scale = informative(pos, unl, float(np.log(0.4 / prior)), bits=bits)
    chosen = np.flatnonzero(scale)
    if not pos or not unl or not len(chosen):
        return scale, bias
    place = np.full(1 << bits, -1)
    place[chosen] = np.arange(len(chosen))
    size = scale[chosen]

    def flat(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        kept = [f[f >= 0] for f in (place[x] for x in lists)]
        return np.concatenate(kept), np.repeat(np.arange(len(kept)), [len(x) for x in kept])

    (fp, rp), (fu, ru) = flat(pos), flat(unl)
    w, g2 = np.full(len(chosen), 0.5), np.full(len(chosen), 1e-8)
    for _ in range(steps):
        ws = w * size
        zp, zu = np.bincount(rp, ws[fp], len(pos)) + bias, np.bincount(ru, ws[fu], len(unl)) + bias
        dp, du = slopes(zp, zu, prior)
        g = (np.bincount(fp, dp[rp], len(w)) + np.bincount(fu, du[ru], len(w))) * size + 1e-4 * w
        g2 += g * g
        w = np.maximum(w - rate * g / np.sqrt(g2), 0)  # these features only ever speak for toxicity
        gb = float(dp.sum() + du.sum())
        b2 += gb * gb
        bias -= rate * gb / np.sqrt(b2)
    out = np.zeros(1 << bits)
    out[chosen] = w * size
    return out, bias


def train(docs: DataFrame, labels: DataFrame, prior: float | None = None, positive: int = POSITIVE, unlabelled: int = UNLABELLED) -> tuple[np.ndarray, float]:
    """A model from (doc_id, text) and (doc_id, toxic): texts with toxic = 1 are positive, any others unlabelled.

    labels must hold only rows that may be learned from, and docs only texts that may be. prior: share of
    toxic texts, by default that among the labels. The bounded samples are those with the smallest hash
    of doc_id; without positives the score is the prior everywhere.
    """
    ship(docs.sparkSession)
    labels = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, toxic = labels.agg(F.count("*"), F.sum("toxic")).first()
    if prior is None:
        prior = min(0.9, max(0.001, (toxic or 0) / n)) if n else 0.01
    h = F.xxhash64("doc_id")
    ids = labels.where("toxic = 1").select("doc_id", h.alias("h")).orderBy("h").limit(positive)  # bounded: at most `positive` ids
    pos = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    total = docs.agg(F.count("*")).first()[0]
    share = min(1.0, unlabelled / max(1, total))
    unl = docs.select("doc_id", "text", F.xxhash64(F.lit(3), "doc_id").alias("h")).where(F.pmod("h", F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    return fit_nnpu(collect_features(pos, positive), collect_features(unl, 2 * unlabelled), prior)


def score(docs: DataFrame, model: tuple[np.ndarray, float], bits: int = BITS) -> DataFrame:
    """doc_id and the other columns of ``docs`` but text, toxic_score (0 to 1); null and empty texts get the bias alone.

    Whole texts are scored; rows are independent, so repeated rows repeat and an empty table stays empty.
    """
    spark = docs.sparkSession
    ship(spark)
    weights = spark.sparkContext.broadcast(model[0].astype(np.float32))  # 2 ** bits numbers whatever the input
    bias = model[1]
    keep = [c for c in docs.columns if c not in ("text", "toxic_score")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value
        for b in pieces(batches):
            doc, f = features(b, bits)
            z = np.bincount(doc, w[f], b.num_rows) + bias
            s = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(s, pa.float64())], [*keep, "toxic_score"])

    schema = StructType([docs.schema[c] for c in keep]).add("toxic_score", "double")
    return docs.select(*keep, "text").mapInArrow(run, schema)

