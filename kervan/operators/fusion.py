"""Joining candidate lists of several retrievers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kervan.functions.providers import late_interaction, sparse_score
from kervan.operators.lexical import min_max_candidates, top


def linear(dense: DataFrame, lexical: DataFrame, alpha: float = 0.5, k: int = 10) -> DataFrame:
    """(query, doc, score, rank) by alpha x dense + (1 - alpha) x lexical; a side that lacks a document counts 0."""
    both = dense.select("query", "doc", (alpha * F.col("score")).alias("part")).unionAll(lexical.select("query", "doc", ((1 - alpha) * F.col("norm")).alias("part")))
    return top(both.groupBy("query", "doc").agg(F.round(F.sum("part"), 12).alias("score")), ["query"], k)


def reciprocal_rank(lists: list[DataFrame], k: int = 10, constant: int = 60) -> DataFrame:
    """(query, doc, score, rank) by the sum of 1 / (constant + rank) over ranked lists (query, doc, rank)."""
    both = reduce(DataFrame.unionAll, [x.select("query", "doc", (1.0 / (constant + F.col("rank"))).alias("part")) for x in lists])
    return top(both.groupBy("query", "doc").agg(F.round(F.sum("part"), 9).alias("score")), ["query"], k)


def weighted_min_max(cands: DataFrame, weights: dict[str, float], k: int = 10) -> DataFrame:
    """(query, doc, score, rank) by the weighted sum of score columns, each moved to [0, 1] within the query's candidates."""
    total = F.lit(0.0)
    for c, w in weights.items():
        cands = min_max_candidates(cands, ["query"], c, f"{c}_norm")
        total = total + F.lit(float(w)) * F.col(f"{c}_norm")
    return top(cands.withColumn("score", F.round(total / sum(weights.values()), 9)), ["query"], k)


def rerank(cands: DataFrame, scorer, k: int = 10) -> DataFrame:
    """(query, doc, score, rank): candidates with texts (query_text, doc_text) in the order of scorer(query_text, doc_text)."""
    return top(cands.withColumn("score", F.round(scorer(F.col("query_text"), F.col("doc_text")), 9)), ["query"], k)


def multi_vector(cands: DataFrame, weights: tuple[float, float, float] = (1.0, 1.0, 1.0), k: int = 10) -> DataFrame:
    """(query, doc, score, rank) of candidates (query, doc, score, q_sparse, d_sparse, q_words, d_words) by their dense score, the sparse one and
    that of late interaction, each moved to [0, 1] within a query's candidates. An error of a scorer is an error."""
    scored = cands.select("query", "doc", F.col("score").alias("dense"), F.round(sparse_score(F.col("q_sparse"), F.col("d_sparse")), 9).alias("sparse"), F.round(late_interaction("q_words", "d_words"), 9).alias("late"))
    return weighted_min_max(scored, dict(zip(("dense", "sparse", "late"), weights)), k)
