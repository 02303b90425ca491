"""Language ID by hyperdimensional profiles.

Each letter of any script, lower-cased, and the gap between words has a random vector of +1 and -1. A trigram is the product (binding) of its letters'
vectors, the first rolled by two places and the second by one (permutation); a document is the sum
(bundling) of its trigrams, a language the sum of its documents' unit vectors. A document gets the
language whose prototype has the largest cosine with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cardloom.llm.common import pieces, ship, worker_cache

DIM = 512
SEED = 20_240_607
#: Symbols: 0 the gap between words, 1-26 a-z, 27-58 the letters from U+00DF on; other letters get numbers as a process meets them.
FIRST, SYMBOLS = 59, 64
SAMPLE = 20_000
#: A claimed language is refuted if it carries less than a fifth of a text: this share of what the found language carries, by SURE standard errors.
CLAIMED_SHARE, SURE = 0.25, 2.0


def letter_vector(code: int, dim: int = DIM, seed: int = SEED) -> np.ndarray:
    """The vector of +1 and -1 of a letter, a function of its code point; 0 is the gap between words."""
    return (np.random.default_rng((seed, code)).integers(0, 2, dim) * 2 - 1).astype(np.int8)


def lower_letter(ch: str) -> int:
    """Code point of the lower-case letter; 0 for what is no letter."""
    return ord(ch.lower()[0]) if ch.isalpha() else 0


class Letters:
    """Symbols of code points, and the vectors of symbols. The vectors depend on the letters alone, not on the numbers they get."""

    def __init__(self, dim: int, seed: int):
        self.dim, self.seed = dim, seed
        self.lower = np.array([0 if 0xD800 <= c < 0xE000 else lower_letter(chr(c)) for c in range(65536)], np.int64)
        self.number: dict[int, int] = {0: 0} | {96 + i: i for i in range(1, 27)} | {0xDF + i: 27 + i for i in range(FIRST - 27)}
        self.symbol = np.full(65536, -1, np.int64)
        codes = [0, *range(97, 123), *range(0xDF, 0xDF + FIRST - 27)]
        self.vectors = np.array([letter_vector(c, dim, seed) for c in codes] + [np.ones(dim, np.int8)] * (SYMBOLS - FIRST))
        for c in np.flatnonzero(np.isin(self.lower, codes)):
            self.symbol[c] = self.number[int(self.lower[c])]
        self.two = (np.roll(self.vectors, 2, 1)[:, None, :] * np.roll(self.vectors, 1, 1)[None, :, :]).reshape(-1, dim)
        self.held = len(codes)

    def learn(self, low: int) -> int:
        if low not in self.number:
            if self.held == len(self.vectors):
                self.vectors = np.concatenate([self.vectors, np.ones_like(self.vectors)])
            self.vectors[self.held] = letter_vector(low, self.dim, self.seed)
            self.number[low], self.held = self.held, self.held + 1
        return self.number[low]

    def symbols(self, text: str) -> np.ndarray:
        c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        s = self.symbol[np.minimum(c, 65535)]
        if (far := np.flatnonzero((c > 65535) | (s < 0))).size:
            for code in np.unique(c[far]).tolist():
                low = int(self.lower[code]) if code < 65536 else lower_letter(chr(code))
                n = self.learn(low)
                if code < 65536:
                    self.symbol[code] = n
                s[c == code] = n
        return s

    def sum_of(self, at: np.ndarray, n: np.ndarray, base: int) -> np.ndarray:
        """The bundle of the trigrams numbered ``at`` to ``base``, ``n`` times each."""
        v = np.zeros(self.dim, np.float32)
        for i in range(0, len(at), 4096):
            p = at[i : i + 4096]
            pair = self.two[p // base] if base == SYMBOLS else np.roll(self.vectors[p // base**2], 2, 1) * np.roll(self.vectors[p // base % base], 1, 1)
            v += n[i : i + 4096].astype(np.float32) @ (pair * self.vectors[p % base]).astype(np.float32)
        return v


def letters(dim: int = DIM, seed: int = SEED) -> Letters:
    """Made once per process."""
    cache = worker_cache()
    if ("hd", dim, seed) not in cache:
        cache["hd", dim, seed] = Letters(dim, seed)
    return cache["hd", dim, seed]


def trigram_counts(s: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Numbers and counts of the trigrams of symbols (base SYMBOLS if all have numbers below FIRST), where gaps of any length count as one symbol, and the base of the numbers."""
    if not s.any():
        return np.empty(0, np.int64), np.empty(0, np.int64), SYMBOLS
    s = np.concatenate([[0], s, [0]])
    s = s[np.r_[True, (s[1:] != 0) | (s[:-1] != 0)]]
    top = int(s.max())
    base = SYMBOLS if top < FIRST else max(SYMBOLS, top) + 1
    g = (s[:-2] * base + s[1:-1]) * base + s[2:]
    if base > SYMBOLS:
        return *np.unique(g, return_counts=True), base
    n = np.bincount(g)
    at = np.flatnonzero(n)
    return at, n[at], base


def document_vector(text: str | None, dim: int = DIM, seed: int = SEED) -> np.ndarray | None:
    """Unit vector of a text; None if it has no letters."""
    if not text:
        return None
    known = letters(dim, seed)
    at, n, base = trigram_counts(known.symbols(text))
    if not len(at):
        return None
    v = known.sum_of(at, n, base)
    norm = float(np.sqrt((v.astype(np.float64) ** 2).sum()))
    return v / norm if norm else v


def fit_prototypes(train: DataFrame, dim: int = DIM, seed: int = SEED, sample: int = SAMPLE) -> dict[str, np.ndarray]:
    """Unit prototype of each language from (doc_id, text, lang); texts or languages that are null teach nothing.

    At most ``sample`` rows are used, those with the smallest hash of doc_id; partial sums of a vector
    for each language travel, not texts.
    """
    ship(train.sparkSession)
    rows = train.where("text is not null and lang is not null").select("text", "lang", F.xxhash64("doc_id").alias("h"))
    total = rows.agg(F.count("*")).first()[0]
    if total > sample:
        # a hash threshold that keeps about the sample: no sort of texts
        rows = rows.where(F.pmod("h", F.lit(1 << 20)) < int(sample / total * (1 << 20)) + 1)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for b in batches:
            for text, lang in zip(b.column("text"), b.column("lang").to_pylist(), strict=True):
                if (v := document_vector(text.as_py(), dim, seed)) is not None:
                    held[lang] = held.get(lang, 0) + v.astype(np.float64)
        langs = sorted(held)
        yield pa.record_batch({"lang": pa.array(np.repeat(langs, dim) if langs else [], pa.string()), "k": pa.array(np.tile(np.arange(dim), len(langs)), pa.int32()), "s": pa.array(np.concatenate([held[x] for x in langs]) if langs else [], pa.float64())})

    out: dict[str, np.ndarray] = {}
    for lang, k, s in rows.select("text", "lang").mapInArrow(sums, "lang string, k int, s double").groupBy("lang", "k").agg(F.sum("s")).collect():  # languages x dim rows
        out.setdefault(lang, np.zeros(dim))[k] = s
    return {x: v / (np.sqrt((v * v).sum()) or 1) for x, v in sorted(out.items())}


def refuted(c: np.ndarray, found: int, claimed: int, alike: np.ndarray, dim: int = DIM) -> bool:
    """Whether a text with cosines ``c`` is plainly not in the language claimed; ``alike`` has the prototypes' cosines with each other.

    The text is taken as a * found + b * claimed + noise. A short text has smaller cosines and, by the noise
    left, a larger standard error of b, so the limit on b / a asks for no length.
    """
    rho = float(alike[found, claimed])
    own = 1 - rho * rho
    if found == claimed or own < 1e-6:
        return False
    a, b = (float(c[found]) - rho * float(c[claimed])) / own, (float(c[claimed]) - rho * float(c[found])) / own
    error = np.sqrt(max(0.0, 1 - float(c[found]) ** 2) / (dim * own))
    return b + SURE * error < CLAIMED_SHARE * a


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], dim: int = DIM, seed: int = SEED, claim: str | None = None) -> DataFrame:
    """All columns of ``docs`` but lang_pred and score, then lang_pred and score (the cosine, 0 to 1).

    With ``claim``, a column that names a language, there is a column refuted too: see ``refuted``. A claim that is null or of
    which nothing was learned is not refuted, nor is any of a text that gets ``und``.

    ``und`` and 0 for a text that is null or has no letters, and for every text if nothing was learned.
    Ties go to the language that sorts first. Whole texts are read; rows are independent, so repeated
    rows give repeated results and an empty table an empty one.
    """
    ship(docs.sparkSession)
    docs = docs.drop("lang_pred", "score", *["refuted"] * bool(claim))
    langs = list(prototypes)
    proto = np.array([prototypes[x] for x in langs], np.float32).reshape(len(langs), dim)
    place, alike = {x: i for i, x in enumerate(langs)}, proto @ proto.T

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            best, value, wrong = [], [], []
            claims = b.column(claim).to_pylist() if claim else [None] * b.num_rows
            for text, said in zip(b.column("text"), claims, strict=True):
                v = document_vector(text.as_py(), dim, seed) if langs else None
                if v is None:
                    best.append("und")
                    value.append(0.0)
                    wrong.append(False)
                else:
                    c = proto @ v
                    i = int(c.argmax())
                    best.append(langs[i])
                    value.append(float(min(1.0, max(0.0, c[i]))))
                    wrong.append(said in place and refuted(c, i, place[said], alike, dim))
            more = {"lang_pred": pa.array(best, pa.string()), "score": pa.array(value, pa.float64())} | ({"refuted": pa.array(wrong, pa.bool_())} if claim else {})
            yield pa.RecordBatch.from_arrays([*b.columns, *more.values()], [*b.schema.names, *more])

    schema = StructType(list(docs.schema)).add("lang_pred", "string").add("score", "double")
    if claim:
        schema = schema.add("refuted", "boolean")
    return docs.mapInArrow(score, schema)
