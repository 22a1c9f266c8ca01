"""Interfaces behind which models stand, with deterministic defaults that need none. All work on columns or on batches."""

from __future__ import annotations

import functools
import hashlib
from collections import Counter
from collections.abc import Callable
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kervan.functions import text as T


# Embedders --------------------------------------------------------------------------------------------------------------
class Embedder(Protocol):
    def column(self, text: Column, is_query: bool = False) -> Column: ...


@functools.lru_cache(maxsize=200_000)
def _place(word: str) -> int:
    """A number of 32 bits for a word, the same everywhere."""
    return int(hashlib.md5(word.encode()).hexdigest()[:8], 16)


def prefixed(text: Column, model: str, is_query: bool) -> Column:
    """Models of the e5 family want to be told what a text is."""
    return F.concat(F.lit("query: " if is_query else "passage: "), text) if "e5" in model.lower() else text


class HashEmbedder:
    """Counts of hashed words, of length one; 64 dimensions by default. Null and empty text give a zero vector."""

    def __init__(self, dim: int = 64, model: str = ""):
        self.dim, self.model = dim, model

    def column(self, text: Column, is_query: bool = False) -> Column:
        dim = self.dim

        @F.pandas_udf("array<float>")
        def embed(words: pd.Series) -> pd.Series:
            def one(w):
                v = np.bincount([_place(x) % dim for x in w], minlength=dim).astype(np.float64)
                return (v / max(np.linalg.norm(v), 1e-12)).astype(np.float32)

            return words.map(one)

        return embed(T.index_tokens(F.coalesce(prefixed(text, self.model, is_query), F.lit(""))))


class HashMultiVector(HashEmbedder):
    """Three kinds of vectors of a text: the dense one, weights of its words (sparse), and a short vector for each word."""

    WORD_DIM = 8

    def sparse(self, text: Column) -> Column:
        """map of word -> its share of the text's words."""

        @F.pandas_udf("map<string,double>")
        def weigh(words: pd.Series) -> pd.Series:
            return words.map(lambda w: {x: n / len(w) for x, n in Counter(w).items()})

        return weigh(T.index_tokens(F.coalesce(text, F.lit(""))))

    def words(self, text: Column) -> Column:
        """Array of unit vectors, one for each word."""

        @F.pandas_udf("array<array<double>>")
        def embed(words: pd.Series) -> pd.Series:
            return words.map(lambda w: [list(word_vector(x)) for x in w])

        return embed(T.index_tokens(F.coalesce(text, F.lit(""))))


@functools.lru_cache(maxsize=200_000)
def word_vector(word: str) -> tuple[float, ...]:
    """Unit vector of a word from the first digits of its MD5."""
    v = np.array([int(c, 16) - 7.5 for c in hashlib.md5(word.encode()).hexdigest()[: HashMultiVector.WORD_DIM]])
    return tuple((v / np.linalg.norm(v)).tolist())


def sparse_score(query: Column, doc: Column) -> Column:
    """Sum of the products of the weights of common words."""
    return F.aggregate(F.map_keys(query), F.lit(0.0), lambda acc, w: acc + F.element_at(query, w) * F.coalesce(F.try_element_at(doc, w), F.lit(0.0)))


def late_interaction(query, doc) -> Column:
    """Mean over the query's words of the highest product with a word of the document; 0 where either has none."""

    @F.pandas_udf("double")
    def score(queries: pd.Series, docs: pd.Series) -> pd.Series:
        return pd.Series([float((np.stack(q) @ np.stack(d).T).max(axis=1).mean()) if len(q) and len(d) else 0.0 for q, d in zip(queries, docs)], dtype="float64")

    return score(query, doc)


# Rerankers and entailment -------------------------------------------------------------------------------------------------
def pair_score(query: Column, doc: Column) -> Column:
    """Default reranker: overlap coefficient of the words."""
    words = lambda c: T.index_tokens(F.coalesce(c, F.lit("")))
    return T.overlap_coefficient(words(query), words(doc))


def entailment_logits(premise: Column, hypothesis: Column) -> Column:
    """Default entailment scorer: logits (contradiction, entailment, neutral) from the share of the hypothesis' words in the premise."""
    p, h = F.array_distinct(T.index_tokens(F.coalesce(premise, F.lit("")))), F.array_distinct(T.index_tokens(F.coalesce(hypothesis, F.lit(""))))
    share = F.when(F.size(h) == 0, 0.0).otherwise(F.size(F.array_intersect(p, h)) / F.size(h))
    return F.array(1 - share, 4 * share, F.lit(1.0))


# Generators -----------------------------------------------------------------------------------------------------------------
#: What a generator is told, by mode; the citation form is that of contexts.
PROMPTS = {
    "long": "Sen bir hukuk asistanısın. Soruyu yalnızca verilen kaynaklara dayanarak, Türkçe ve tam cümlelerle yanıtla. Dayandığın kaynağı cümlenin sonunda [Kaynak n] biçiminde göster. Kaynaklarda yanıt yoksa bunu açıkça söyle.",
    "short": "Sen bir hukuk sınavı asistanısın. Soruyu verilen kaynaklara göre, açıklama yapmadan, birkaç sözcükle yanıtla.",
}
#: Most tokens of an answer, by mode.
MOST_TOKENS = {"long": 512, "finetuned": 256, "short": 64}


def prompt(question: Column, context: Column, mode: str = "long") -> Column:
    """What a chat model is sent: the instructions of the mode, the context and the question."""
    return F.concat(F.lit(PROMPTS[mode] + "\n\n"), F.coalesce(context, F.lit("")), F.lit("\n\nSoru: "), F.coalesce(question, F.lit("")))


def extractive_answer(question: Column, context: Column) -> Column:
    """Default generator: the sentence of the context that overlaps the question most; null where there is no context."""
    sents = F.filter(F.split(F.coalesce(context, F.lit("")), r"(?<=[.!?])\s+"), lambda s: F.length(F.trim(s)) > 0)
    q = T.qa_tokens(F.coalesce(question, F.lit("")))
    best = F.array_max(F.transform(sents, lambda s, i: F.struct(T.overlap_coefficient(T.qa_tokens(s), q).alias("score"), (-i).alias("neg"), s.alias("s"))))
    return F.when(F.size(sents) > 0, best["s"])


def generator(fn: Callable[[pd.Series, pd.Series], list]):
    """A vectorized UDF of any batch function (questions, contexts) -> answers; what fails gives an empty answer and the error."""

    @F.pandas_udf("answer string, error string")
    def run(q: pd.Series, c: pd.Series) -> pd.DataFrame:
        try:
            return pd.DataFrame({"answer": list(fn(q, c)), "error": None})
        except Exception as e:  # noqa: BLE001
            return pd.DataFrame({"answer": [""] * len(q), "error": [f"{type(e).__name__}: {e}"] * len(q)})

    return run


# Judges ---------------------------------------------------------------------------------------------------------------------
#: What a judge is asked for, by kind; every kind is answered by a number from 0 to 1.
JUDGES = {
    "answer": "Yanıt, beklenen yanıtla aynı şeyi söylüyor mu?",
    "faithfulness": "Yanıttaki her bilgi kaynaklarda geçiyor mu?",
    "relevancy": "Yanıt soruyu karşılıyor mu?",
    "coherence": "Yanıt kendi içinde tutarlı ve anlaşılır mı?",
}


def judge_reply(kind: str, question: Column, answer: Column, expected: Column, context: Column) -> Column:
    """Default judges, as text; null (not one half) where there is no answer, or nothing to compare it with.

    answer: the share of the expected answer's words that the answer has; faithfulness: the share of its words that the context has; relevancy:
    the share of the question's words that it has; coherence: the share of its words that are different.
    """
    words = lambda c: T.index_tokens(F.coalesce(c, F.lit("")))
    a = words(answer)
    share = lambda of, within: F.size(F.array_intersect(of, within)) / F.nullif(F.size(F.array_distinct(of)), F.lit(0))
    score = {
        "answer": lambda: share(words(expected), a),
        "faithfulness": lambda: F.when(F.coalesce(context, F.lit("")) != "", share(a, words(context))),
        "relevancy": lambda: share(words(question), a),
        "coherence": lambda: F.size(F.array_distinct(a)) / F.nullif(F.size(a), F.lit(0)),
    }[kind]()
    return F.when((F.size(a) > 0) & score.isNotNull(), F.format_string("%.2f", F.floor(score * 100) / 100))


# Language models ----------------------------------------------------------------------------------------------------------
def unigram_costs(corpus: DataFrame, text: str = "text") -> DataFrame:
    """(token, cost): negative log probability of each word of a corpus; the row of token null is that of words it does not have (one is added to all)."""
    n = corpus.select(F.explode(T.index_tokens(F.coalesce(F.col(text), F.lit("")))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    total = n.agg((F.coalesce(F.sum("n"), F.lit(0)) + F.count("*") + 1).alias("total"))  # one row
    both = n.unionAll(total.select(F.lit(None).cast("string").alias("token"), F.lit(0).cast("bigint").alias("n")))
    return both.crossJoin(F.broadcast(total)).select("token", (F.log("total") - F.log(F.col("n") + 1)).alias("cost"))


def perplexities(answers: DataFrame, costs: DataFrame) -> DataFrame:
    """(query_id, perplexity) of rows (query_id, predicted): exp of the mean cost of the answer's words; answers without words have none."""
    w = answers.select("query_id", F.explode(T.index_tokens(F.coalesce("predicted", F.lit("")))).alias("token"))
    known = costs.where("token IS NOT NULL")
    other = costs.where("token IS NULL").select(F.col("cost").alias("other"))  # one row
    each = w.groupBy("query_id", "token").agg(F.count("*").alias("n")).join(known, "token", "left").crossJoin(F.broadcast(other))
    return each.groupBy("query_id").agg(F.exp(F.sum(F.col("n") * F.coalesce("cost", "other")) / F.sum("n")).alias("perplexity"))


# A suite of context metrics -------------------------------------------------------------------------------------------------
#: Names of the metrics that a suite gives.
RAG_METRICS = ("faithfulness", "answer_relevancy", "context_precision", "context_recall", "answer_correctness")


def lexical_suite(question: Column, answer: Column, contexts: Column, truth: Column) -> dict[str, Column]:
    """Default suite: shares of common words; a metric without a base is NaN. contexts: an array of texts in order of rank."""
    words = lambda c: F.array_distinct(T.index_tokens(F.coalesce(c, F.lit(""))))
    nan = F.lit(float("nan"))
    share = lambda of, within: F.when(F.size(of) == 0, nan).otherwise(F.size(F.array_intersect(of, within)) / F.size(of))
    q, a, t, c = words(question), words(answer), words(truth), words(F.array_join(contexts, " "))
    useful = F.transform(contexts, lambda x: F.when(share(t, words(x)) >= 0.5, 1.0).otherwise(0.0))
    hits, at = share(t, a), share(a, t)
    return {
        "faithfulness": share(a, c), "answer_relevancy": share(q, a), "context_recall": share(t, c),
        "context_precision": F.when((F.size(contexts) == 0) | (F.size(t) == 0), nan).otherwise(F.aggregate(useful, F.lit(0.0), lambda acc, x: acc + x) / F.size(contexts)),
        "answer_correctness": F.when(F.isnan(hits) | F.isnan(at), nan).when(hits + at == 0, 0.0).otherwise(2 * hits * at / (hits + at)),
    }
