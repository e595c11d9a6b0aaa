"""Linking of mentions: fingerprints, blocking, and the five-signal score of pairs."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import product
from statistics import fmean

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import phonetic
from ..functions import similarity as sim

MERGE, DEFERRED, NEW_ENTITY = "MERGE", "DEFERRED", "NEW_ENTITY"
SIGNALS = ("phonetic", "damerau_levenshtein", "trigram_jaccard", "token_jaccard", "cooccurrence")


@dataclass(frozen=True)
class Config:
    """Fixed values of the scorer: (m, u) of the signals, the prior, thresholds by type and their bounds."""

    m_u: dict = field(default_factory=lambda: {"phonetic": (0.80, 0.15), "damerau_levenshtein": (0.85, 0.10), "trigram_jaccard": (0.75, 0.20), "token_jaccard": (0.90, 0.08), "cooccurrence": (0.60, 0.40)})
    prior: float = 0.3
    types: dict = field(default_factory=lambda: {"PERSON": (0.65, 0.03), "EMAIL_ADDRESS": (0.90, 0.01), "PHONE_NUMBER": (0.85, 0.01), "IP_ADDRESS": (0.90, 0.01)})
    other_type: tuple = (0.75, 0.02)
    ceiling: float = 0.95
    gap: float = 0.35
    floor: float = 0.30
    least: float = 1e-10

    def thresholds(self, entity_type: str, same_type: int) -> tuple[float, float]:
        """(merge, defer): they rise with the number of entities of the type already known."""
        base, penalty = self.types.get(entity_type, self.other_type)
        merge = min(base + penalty * math.log2(1 + same_type), self.ceiling)
        return merge, max(merge - self.gap, self.floor)


DEFAULT = Config()


def likelihood_ratio(value: float, m: float, u: float, least: float) -> float:
    chance = lambda p: max(p * value + (1 - p) * (1 - value), least)
    return math.log2(chance(m) / chance(u))


@lru_cache(maxsize=50_000)
def features(text: str) -> tuple:
    """What comparing needs of a text: codes, tokens and their codes, sorted tokens, trigrams."""
    tokens = text.lower().split()
    return phonetic.codes(text), [phonetic.codes(t) for t in tokens], frozenset(tokens), " ".join(sorted(tokens)), sim.trigrams_of(text.lower())


#: Which code of a query may meet which of a candidate (0 first, 1 second): a second code never meets a second one.
ADMITTED = ((0, 0), (0, 1), (1, 0))


def sounds_like(codes: tuple[str, str], others: list[tuple[str, str]]) -> float:
    """How well one text's codes agree with the best of some others."""
    return max(phonetic.code_similarity(codes[i], other[j]) for other, (i, j) in product(others, ADMITTED))


def phonetic_signal(query: str, candidate: str) -> float:
    """The better of two views: the texts as wholes, and the query's tokens each beside their best candidate token."""
    (whole_q, tokens_q, *_), (whole_c, tokens_c, *_) = features(query), features(candidate)
    views = [sounds_like(whole_q, [whole_c])]
    if tokens_q and tokens_c:
        views.append(fmean(sounds_like(codes, tokens_c) for codes in tokens_q))
    return max(views)


def signal_values(queries: list[str], candidates: list[str]) -> list[list[float]]:
    """[phonetic, edit, trigram, token] for each pair."""
    plain = sim.alignment_similarities([q.lower() for q in queries], [c.lower() for c in candidates])
    by_token = sim.alignment_similarities([features(q)[3] for q in queries], [features(c)[3] for c in candidates])
    out = []
    for k, (q, c) in enumerate(zip(queries, candidates, strict=True)):
        fq, fc = features(q), features(c)
        out.append([phonetic_signal(q, c), float(max(plain[k], by_token[k])), sim.jaccard_of(fq[4], fc[4]), sim.jaccard_of(fq[2], fc[2])])
    return out


def weigh(values: list[float], config: Config = DEFAULT) -> tuple[float, float, list[float]]:
    """(posterior, total weight, log-likelihood ratios) of five signal values; no co-occurrence weighs nothing."""
    ratios = [0.0 if name == "cooccurrence" and v == 0 else likelihood_ratio(v, *config.m_u[name], config.least) for name, v in zip(SIGNALS, values, strict=True)]
    total = sum(ratios)
    odds = config.prior / (1 - config.prior) * 2**total
    return odds / (1 + odds), total, ratios


# -- pairs as frames ---------------------------------------------------------------------------------------------------


@F.pandas_udf(T.DoubleType())
def phonetic_signals(query: pd.Series, candidate: pd.Series) -> pd.Series:
    return pd.Series([phonetic_signal(q or "", c or "") for q, c in zip(query, candidate, strict=True)])


def _sorted_tokens(text: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(F.lower(text), r"\s+", -1), lambda t: t != "")), " ")


def score_pairs(df: DataFrame, query: str = "query", candidate: str = "candidate", cooccurrence: str | None = None, config: Config = DEFAULT) -> DataFrame:
    """Add the five signals (name, value, log_lr), total_weight and posterior. Edit distance and phonetic codes run in
    Arrow batches, everything else as expressions."""
    q, c = F.coalesce(F.col(query), F.lit("")), F.coalesce(F.col(candidate), F.lit(""))
    df = (
        df.withColumn("_phonetic", phonetic_signals(q, c))
        .withColumn("_edit", F.greatest(sim.osa_similarity(F.lower(q), F.lower(c)), sim.osa_similarity(_sorted_tokens(q), _sorted_tokens(c))))
        .withColumn("_trigram", sim.trigram_jaccard(q, c))
        .withColumn("_token", sim.token_jaccard(q, c))
        .withColumn("_together", F.col(cooccurrence).cast("double") if cooccurrence else F.lit(0.0))
    )
    signals = []
    for name, col in zip(SIGNALS, ("_phonetic", "_edit", "_trigram", "_token", "_together"), strict=True):
        m, u = config.m_u[name]
        v = F.col(col)
        chance = lambda p, v=v: F.greatest(v * p + (1 - v) * (1 - p), F.lit(config.least))
        ratio = F.log2(chance(m) / chance(u))
        signals.append(F.struct(F.lit(name).alias("name"), v.alias("value"), (F.when(v == 0, 0.0).otherwise(ratio) if name == "cooccurrence" else ratio).alias("log_lr")))
    df = df.withColumn("signals", F.array(*signals)).withColumn("total_weight", F.aggregate("signals", F.lit(0.0), lambda a, s: a + s["log_lr"]))
    odds = F.pow(F.lit(2.0), F.col("total_weight")) * (config.prior / (1 - config.prior))
    return df.withColumn("posterior", odds / (1 + odds)).drop("_phonetic", "_edit", "_trigram", "_token", "_together")


def decide(posterior: Column, merge: Column | float, defer: Column | float) -> Column:
    return F.when(posterior >= merge, MERGE).when(posterior >= defer, DEFERRED).otherwise(NEW_ENTITY)


def thresholds(entity_type: Column, same_type: Column, config: Config = DEFAULT) -> tuple[Column, Column]:
    """(merge, defer) as columns."""
    base, penalty = F.lit(config.other_type[0]), F.lit(config.other_type[1])
    for kind, (b, p) in config.types.items():
        base, penalty = F.when(entity_type == kind, b).otherwise(base), F.when(entity_type == kind, p).otherwise(penalty)
    merge = F.least(base + penalty * F.log2(same_type + F.lit(1.0)), F.lit(config.ceiling))
    return merge, F.greatest(merge - config.gap, F.lit(config.floor))


def fingerprints(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Add codes, signature, bands and tokens of a text column, each computed once."""
    return (
        df.withColumn("_codes", sim.phonetic_codes(F.col(text_col)))
        .withColumns({"phonetic_primary": F.col("_codes.primary"), "phonetic_secondary": F.col("_codes.secondary"), "signature": sim.signature(F.col(text_col)), "tokens": sim.token_set(F.col(text_col))})
        .withColumn("bands", sim.bands(F.col("signature")))
        .drop("_codes")
    )


def blocking_keys(df: DataFrame, kinds: tuple[str, ...] = ("phonetic", "band", "token")) -> Column:
    """All keys under which a fingerprint is found, in one array: tagged codes, bands and tokens."""
    parts = {
        "phonetic": F.transform(F.filter(F.array_distinct(F.array("phonetic_primary", "phonetic_secondary")), lambda c: c != ""), lambda c: F.concat(F.lit("P:"), c)),
        "band": F.transform("bands", lambda b: F.concat(F.lit("B:"), b)),
        "token": F.transform("tokens", lambda t: F.concat(F.lit("T:"), t)),
    }
    return F.concat(*[parts[k] for k in kinds])


def candidate_pairs(df: DataFrame, id_col: str, type_col: str, text_col: str, kinds: tuple[str, ...] = ("phonetic", "band", "token")) -> DataFrame:
    """(id_a, id_b) with id_a < id_b, of equal type and with a key in common: one equi-join on (type, key).

    Adaptive execution splits the partitions of frequent keys. No key is dropped."""
    keyed = fingerprints(df, text_col)
    keyed = keyed.select(F.col(id_col).alias("id"), F.col(type_col).alias("kind"), F.explode(blocking_keys(keyed, kinds)).alias("key")).distinct()
    a, b = keyed.alias("a"), keyed.alias("b")
    return a.join(b, (F.col("a.kind") == F.col("b.kind")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.id") < F.col("b.id"))).select(F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b")).distinct()


def evaluate(pairs: DataFrame, cuts: list[float], config: Config = DEFAULT) -> DataFrame:
    """Confusion counts, precision, recall and F1 for each merge threshold, overall and by category.

    pairs: canonical, variant, category, expected. A deferred pair counts as linked. The thresholds are exploded from
    a literal inside each row, and one grouping-sets aggregate does the rest."""
    scored = score_pairs(pairs, "canonical", "variant", config=config).select("category", "posterior", (F.col("expected") == MERGE).alias("match"), F.explode(F.array(*map(F.lit, cuts))).alias("threshold"))
    linked = F.col("posterior") >= F.greatest(F.col("threshold") - config.gap, F.lit(config.floor))
    flagged = scored.withColumn("linked", linked)
    counted = flagged.rollup("threshold", "category").agg(
        F.count_if(F.col("match") & F.col("linked")).alias("tp"), F.count_if(~F.col("match") & F.col("linked")).alias("fp"), F.count_if(~F.col("match") & ~F.col("linked")).alias("tn"), F.count_if(F.col("match") & ~F.col("linked")).alias("fn"), F.grouping("category").alias("overall"), F.grouping("threshold").alias("_all")
    ).where("_all = 0")
    ratio = lambda a, b: F.when(b == 0, 0.0).otherwise(a / b)
    rated = counted.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    f1 = ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return rated.select("threshold", F.when(F.col("overall") == 1, "ALL").otherwise(F.col("category")).alias("category"), "tp", "fp", "tn", "fn", "precision", "recall", f1.alias("f1"))
