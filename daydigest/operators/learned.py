"""A pair scorer learned from judgements: least squares over pairs of a good and a bad candidate.

A candidate is described by how its text and the query meet. The weights make the good candidates of a request score
one more than its bad ones, as nearly as squares tell, over all pairs of both. No pair is formed: what the pairs add
up to follows from the sums over the good and over the bad ones of each request, so a request of any size is a row
of sums.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daydigest.functions import text as T
from daydigest.operators.ranking import SCORE_DIGITS
from daydigest.session import cut_lineage

FEATURES = ("coverage", "share", "pairs", "length")
# Weight of small weights, as a share of the number of pairs, and digits of a weight.
RIDGE = 0.001
WEIGHT_DIGITS = 6
LENGTH_UNIT = 16


def term_pairs(terms: Column) -> Column:
    """The distinct pairs of neighbouring terms."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(terms) - 1), lambda i: F.concat_ws(" ", F.get(terms, i - 1), F.get(terms, i))))


def share_of(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(F.size(part).cast("double"), F.size(whole)), F.lit(0.0))


def with_features(candidates: DataFrame, text: str = "text") -> DataFrame:
    """``candidates`` (query, text, ...) with ``features``: the share of the query's distinct terms in the text, what they
    make up of the text's, the share of the query's neighbouring pairs, and the logarithm of the text's length. Null
    or empty texts have no terms."""
    none = F.array().cast("array<string>")
    made = candidates.withColumns({"_q": F.coalesce(T.tokens("query"), none), "_t": F.coalesce(T.tokens(text), none)})

    def pairs(c: str) -> Column:
        return F.when(F.size(c) > 1, term_pairs(F.col(c))).otherwise(none)

    sets = {"_qs": F.array_distinct("_q"), "_ts": F.array_distinct("_t"), "_qp": pairs("_q"), "_tp": pairs("_t")}
    made = made.withColumns(sets).withColumns({"_shared": F.array_intersect("_qs", "_ts"), "_both": F.array_intersect("_qp", "_tp")})
    features = F.array(
        share_of(F.col("_shared"), F.col("_qs")),
        share_of(F.col("_shared"), F.col("_ts")),
        share_of(F.col("_both"), F.col("_qp")),
        F.log2(1.0 + F.size("_ts")) / LENGTH_UNIT,
    )
    return made.withColumn("features", features).drop("_q", "_t", *sets, "_shared", "_both")


def fit(described: DataFrame, judged: DataFrame, request: list[str]) -> list[float]:
    """Weights of the features from candidates (``request``, docno, features) and judgements (docno, good: boolean).

    Requests without a good or without a bad candidate tell nothing; without any pair all weights are 0. A docno judged
    twice counts twice; a null judgement does not count.
    """
    size = len(FEATURES)
    at = [(i, j) for i in range(size) for j in range(i, size)]
    x = [F.element_at("features", i + 1) for i in range(size)]
    rows = described.join(judged.filter("good IS NOT NULL"), "docno")
    sums = {}
    for side, here in (("g", F.col("good")), ("b", ~F.col("good"))):
        sums[f"{side}_n"] = F.sum(here.cast("double"))
        sums |= {f"{side}_{i}": F.sum(F.when(here, x[i]).otherwise(0.0)) for i in range(size)}
        sums |= {f"{side}_{i}_{j}": F.sum(F.when(here, x[i] * x[j]).otherwise(0.0)) for i, j in at}
    groups = rows.groupBy(*request).agg(*[c.alias(k) for k, c in sums.items()])
    c = F.col
    totals = {"n": c("g_n") * c("b_n")}
    totals |= {f"y_{i}": c("b_n") * c(f"g_{i}") - c("g_n") * c(f"b_{i}") for i in range(size)}
    totals |= {
        f"a_{i}_{j}": c("b_n") * c(f"g_{i}_{j}") + c("g_n") * c(f"b_{i}_{j}") - c(f"g_{i}") * c(f"b_{j}") - c(f"b_{i}") * c(f"g_{j}")
        for i, j in at
    }
    total = groups.agg(*[F.sum(v).alias(k) for k, v in totals.items()]).first()
    if not total["n"]:
        return [0.0] * size
    a = np.zeros((size, size))
    for i, j in at:
        a[i, j] = a[j, i] = total[f"a_{i}_{j}"]
    a += RIDGE * total["n"] * np.eye(size)
    weights = np.linalg.solve(a, np.array([total[f"y_{i}"] for i in range(size)]))
    return [round(float(w), WEIGHT_DIGITS) for w in weights]


def with_learned_score(described: DataFrame, weights: list[float]) -> DataFrame:
    """``rerank_score``: the weighted sum of the features, inside the plan; ``features`` go."""
    total = sum((F.lit(w) * F.element_at("features", i + 1) for i, w in enumerate(weights)), F.lit(0.0))
    return described.withColumn("rerank_score", F.round(total, SCORE_DIGITS)).drop("features")


def learned_scorer(judged: DataFrame, request: list[str]):
    """A function that scores candidates by weights fitted on those of them that are judged. The features are made
    once, as a written table."""
    def scored(candidates: DataFrame) -> DataFrame:
        described = cut_lineage(with_features(candidates), "described")
        return with_learned_score(described, fit(described, judged, request))

    return scored
