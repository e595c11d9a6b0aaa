"""Similarity of short texts: set overlaps and signatures as column expressions, edit distance in Arrow batches."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import phonetic

PRIME = 2_147_483_647

# Factors and offsets of the 64 hash functions of a signature; 32 bands of 2 rows.
FACTORS = (
    982451653, 472882027, 920419823, 715827883, 553105243, 393342743, 261534853, 180143327, 104729587, 86028121,
    73856093, 64439929, 52361161, 43112609, 37139213, 32452843, 27644437, 24036583, 20396989, 17624813, 15485863,
    13686517, 12105877, 10711523, 9576891, 8495693, 7594753, 6776221, 5994983, 5346277, 4759123, 4256233, 3796879,
    3393491, 3037000499, 2717084437, 2434612897, 2180083753, 1951356377, 1746262553, 1562504947, 1398101329,
    1250264587, 1117291457, 998632621, 893871739, 799497659, 714954853, 639001891, 570908947, 510067913, 455978177,
    407556403, 364093697, 325324643, 290633987, 259789721, 232124903, 207474013, 185362447, 165580141, 148035889,
    132387563, 118370887,
)
OFFSETS = (
    314159265, 271828182, 141421356, 173205080, 223606797, 244948974, 264575131, 282842712, 300000000, 316227766,
    331662479, 346410161, 360555127, 374165738, 387298334, 400000000, 412310562, 424264068, 435889894, 447213595,
    458257569, 469041575, 479583152, 489897948, 500000000, 509901951, 519615242, 529150262, 538516480, 547722557,
    556776435, 565685424, 574456264, 583095189, 591607978, 600000000, 608276252, 616441400, 624499799, 632455532,
    640312423, 648074069, 655743852, 663324958, 670820393, 678232998, 685565460, 692820323, 700000000, 707106781,
    714142842, 721110255, 728010988, 734846922, 741619848, 748331477, 754983443, 761577310, 768114574, 774596669,
    781024967, 787400787, 793725393, 800000000,
)
BANDS, ROWS = 32, 2

# -- column expressions ----------------------------------------------------------------------------------------------


def trigram_set(text: Column) -> Column:
    """Distinct trigrams; a shorter text is its own only one; an empty text has none."""
    many = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - 2, F.lit(1))), lambda i: text.substr(i, F.lit(3))))
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).when(F.length(text) < 3, F.array(text)).otherwise(many)


def token_set(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), r"\s+", -1), lambda t: t != ""))


def set_jaccard(a: Column, b: Column) -> Column:
    """Two empty sets are equal; one empty set is like nothing."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def trigram_jaccard(a: Column, b: Column) -> Column:
    return set_jaccard(trigram_set(F.lower(a)), trigram_set(F.lower(b)))


def token_jaccard(a: Column, b: Column) -> Column:
    return set_jaccard(token_set(a), token_set(b))


def hash_mod_prime(text: Column) -> Column:
    """MD5 as a 128-bit number modulo PRIME: 2**32 is 2 modulo PRIME, so four limbs weigh 8, 4, 2 and 1."""
    limb = lambda k: F.conv(F.substring(F.md5(text), 8 * k + 1, 8), 16, 10).cast("bigint")
    return F.pmod(limb(0) * 8 + limb(1) * 4 + limb(2) * 2 + limb(3), F.lit(PRIME))


def signature(text: Column) -> Column:
    """array<bigint> of 64 minima over the trigrams of the lower-cased text; PRIME throughout for an empty text."""
    hashed = F.transform(trigram_set(F.lower(text)), hash_mod_prime)
    pairs = F.array(*[F.struct(F.lit(a % PRIME).cast("bigint").alias("a"), F.lit(b).cast("bigint").alias("b")) for a, b in zip(FACTORS, OFFSETS, strict=True)])
    return F.transform(pairs, lambda p: F.coalesce(F.array_min(F.transform(hashed, lambda h: F.pmod(p["a"] * h + p["b"], F.lit(PRIME)))), F.lit(PRIME).cast("bigint")))


def bands(sig: Column) -> Column:
    """array<string>: a key for each band of a signature."""
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.concat_ws(":", k, *[F.element_at(sig, k * ROWS + r + 1) for r in range(ROWS)]))


# -- the same on plain values, for the session fold ------------------------------------------------------------------

_A, _B = np.array([a % PRIME for a in FACTORS], np.int64), np.array(OFFSETS, np.int64)


@lru_cache(maxsize=100_000)
def _md5_mod(text: str) -> int:
    return int.from_bytes(hashlib.md5(text.encode()).digest(), "big") % PRIME


def trigrams_of(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(max(1, len(text) - 2))) if text else frozenset()


def signature_of(text: str) -> list[int]:
    grams = trigrams_of(text.lower())
    if not grams:
        return [PRIME] * len(FACTORS)
    h = np.array([_md5_mod(g) for g in grams], np.int64)
    return ((_A[:, None] * h[None, :] + _B[:, None]) % PRIME).min(axis=1).tolist()


def jaccard_of(a: frozenset, b: frozenset) -> float:
    return len(a & b) / len(a | b) if a or b else 1.0


# -- edit distance -----------------------------------------------------------------------------------------------------


def alignment_distances(left: list[str], right: list[str]) -> np.ndarray:
    """Optimal string alignment distances of many pairs at once (insert, delete, replace, swap of neighbours; no
    stretch edited twice). Cell (i, j) of all pairs' tables is one vector operation."""
    n, a_len, b_len = len(left), np.array([len(s) for s in left], int), np.array([len(s) for s in right], int)
    rows, cols = int(a_len.max(initial=0)), int(b_len.max(initial=0))
    grid = lambda texts, width: np.array([[*map(ord, s), *[0] * (width - len(s))] for s in texts], np.int32).reshape(n, width)
    a, b = grid(left, rows), grid(right, cols)
    table = np.zeros((rows + 1, cols + 1, n), np.int32)
    table[:, 0] = np.arange(rows + 1)[:, None]
    table[0, :] = np.arange(cols + 1)[:, None]
    for i in range(1, rows + 1):
        for j in range(1, cols + 1):
            best = np.minimum(np.minimum(table[i - 1, j], table[i, j - 1]) + 1, table[i - 1, j - 1] + (a[:, i - 1] != b[:, j - 1]))
            if i > 1 and j > 1:
                swap = (a[:, i - 1] == b[:, j - 2]) & (a[:, i - 2] == b[:, j - 1])
                best = np.where(swap, np.minimum(best, table[i - 2, j - 2] + 1), best)
            table[i, j] = best
    return table[a_len, b_len, np.arange(n)]


def alignment_similarities(left: list[str], right: list[str]) -> np.ndarray:
    longest = np.array([max(len(a), len(b), 1) for a, b in zip(left, right, strict=True)])
    return 1 - alignment_distances(left, right) / longest


def _by_length(f, left: pd.Series, right: pd.Series) -> pd.Series:
    """Pairs of like length share a table, so one long text does not widen the tables of all."""
    a, b = left.fillna("").tolist(), right.fillna("").tolist()
    order = sorted(range(len(a)), key=lambda i: (len(a[i]), len(b[i])))
    out = np.zeros(len(a))
    for k in range(0, len(order), 512):
        some = order[k : k + 512]
        out[some] = f([a[i] for i in some], [b[i] for i in some])
    return pd.Series(out)


@F.pandas_udf(T.DoubleType())
def osa_distance(left: pd.Series, right: pd.Series) -> pd.Series:
    return _by_length(alignment_distances, left, right)


@F.pandas_udf(T.DoubleType())
def osa_similarity(left: pd.Series, right: pd.Series) -> pd.Series:
    return _by_length(alignment_similarities, left, right)


@F.pandas_udf(T.StructType([T.StructField("primary", T.StringType()), T.StructField("secondary", T.StringType())]))
def phonetic_codes(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([phonetic.codes(t or "") for t in text], columns=["primary", "secondary"])


@F.pandas_udf(T.DoubleType())
def phonetic_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([phonetic.code_similarity(x or "", y or "") for x, y in zip(a, b, strict=True)])
