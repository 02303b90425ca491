"""Similarity of names and organizations."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardloom.functions.text import utrim


def jaro_winkler_bytes(a: bytes, b: bytes) -> float:
    """Jaro-Winkler over bytes: half transpositions count as fractions, and the prefix always counts (4 bytes, 0.1 each)."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    free, mine = [True] * len(b), []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if free[j] and b[j] == x:
                free[j] = False
                mine.append(x)
                break
    if not mine:
        return 0.0
    theirs = [y for y, f in zip(b, free, strict=True) if not f]
    m, moved = float(len(mine)), sum(x != y for x, y in zip(mine, theirs, strict=True)) / 2
    jaro = (m / len(a) + m / len(b) + (m - moved) / m) / 3
    same = 0
    while same < min(4, len(a), len(b)) and a[same] == b[same]:
        same += 1
    return jaro + same * 0.1 * (1 - jaro)


def _bytes_matrix(names: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of each name in a row, padded with -1, and the lengths."""
    n = np.array([len(x) for x in names], np.int64)
    out = np.full((len(names), int(n.max(initial=0))), -1, np.int16)
    out[np.arange(out.shape[1]) < n[:, None]] = np.frombuffer(b"".join(names), np.uint8)
    return out, n


def jaro_winkler_many(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """``jaro_winkler_bytes`` of many pairs at once: one step for each byte of the longest name, over all pairs."""
    (x, n), (y, m) = _bytes_matrix(a), _bytes_matrix(b)
    reach = np.maximum(0, np.maximum(n, m) // 2 - 1)
    free, hit = y >= 0, np.zeros(x.shape, bool)
    rows, place = np.arange(len(n)), np.arange(y.shape[1])
    for i in range(x.shape[1] if y.shape[1] else 0):
        can = free & (y == x[:, i, None]) & (np.abs(place - i) <= reach[:, None]) & (i < n)[:, None]
        at = can.argmax(1)
        some = can[rows, at]
        hit[some, i] = True
        free[rows[some], at[some]] = False
    taken = (y >= 0) & ~free
    found = hit.sum(1)
    # the k-th match of one side against the k-th of the other
    moved = np.zeros(len(n))
    if found.any():
        pair = np.repeat(rows, found)
        np.add.at(moved, pair, x[hit] != y[taken])
    with np.errstate(divide="ignore", invalid="ignore"):
        jaro = (found / n + found / m + (found - moved / 2) / found) / 3
    w = min(4, x.shape[1], y.shape[1])
    same = np.cumprod((x[:, :w] == y[:, :w]) & (x[:, :w] >= 0), 1).sum(1) if w else np.zeros(len(n))
    out = np.where(found > 0, jaro + same * 0.1 * (1 - jaro), 0.0)
    equal = np.fromiter((p == q for p, q in zip(a, b, strict=True)), bool, len(a))
    return np.where(equal, 1.0, out)


@F.pandas_udf(T.DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    """Each different pair of a batch is compared once, some thousand pairs of like length at a time; null with null."""
    pairs = pd.DataFrame({"a": a, "b": b})
    both = pairs.dropna().drop_duplicates()
    x, y = ([v.encode() for v in both[c]] for c in ("a", "b"))
    order = np.argsort([max(len(p), len(q)) for p, q in zip(x, y, strict=True)], kind="stable")
    score = np.empty(len(both))
    for s in range(0, len(order), 4096):
        part = order[s : s + 4096]
        score[part] = jaro_winkler_many([x[i] for i in part], [y[i] for i in part])
    return pairs.merge(both.assign(score=score), "left", ["a", "b"])["score"].astype("float64")


def name_similarity(a: Column, b: Column) -> Column:
    """0 if a comparable name is empty, else Jaro-Winkler."""
    return F.when((a == "") | (b == ""), F.lit(0.0)).otherwise(jaro_winkler(a, b))


def org_key(c: Column) -> Column:
    return utrim(F.lower(c))


def org_match(a: Column, b: Column) -> Column:
    """Of comparable organizations: 1 if equal, 0.8 if one holds the other, 0 otherwise or if one is empty."""
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).when(F.contains(a, b) | F.contains(b, a), 0.8).otherwise(0.0)
