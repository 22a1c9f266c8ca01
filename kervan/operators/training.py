"""Rows for training embedders, rerankers and generators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kervan.functions.text import split_words

NEGATIVES, START, POOL, LEAST = 7, 5, 30, 0.3
HARD, NOISY = 3, 15


def best_by_jaccard(contexts: DataFrame, chunks: DataFrame, least: float = LEAST) -> DataFrame:
    """(query, doc, score): the chunk of the highest Jaccard likeness of words with each context (query, text), `least` or more; the earliest (ord)
    wins ties.

    Two sets of n words of that likeness share ceil(least n) words at least. In one order of words for both sides, rare ones first, a shared word is
    then among the first n - ceil(least n) + 1 of either: only those are joined, frequent words hardly ever. A chunk's words
    that no context has come first, so most chunks drop out. What meets is compared on the whole sets.
    """
    words = lambda c: F.array_distinct(split_words(c))
    front = lambda n: n - F.ceil(n * least - 1e-9) + 1
    c = contexts.select("query", words("text").alias("w")).withColumn("nq", F.size("w"))
    d = chunks.select("doc", "ord", words("text").alias("w")).withColumn("nd", F.size("w"))
    asked = c.select("query", "nq", F.explode("w").alias("word"))
    each = d.select("doc", "nd", F.explode("w").alias("word")).join(asked.select("word").distinct(), "word", "left_semi")
    counts = each.groupBy("word").agg(F.count("*").alias("n"))
    own = Window.partitionBy("query").orderBy(F.coalesce("n", F.lit(0)), "word")
    of_query = asked.join(counts, "word", "left").withColumn("place", F.row_number().over(own)).where(F.col("place") <= front(F.col("nq")))
    by_doc = Window.partitionBy("doc")
    of_doc = each.join(counts, "word").withColumn("place", F.row_number().over(by_doc.orderBy("n", "word")) + F.col("nd") - F.count("*").over(by_doc)).where(F.col("place") <= front(F.col("nd")))
    fits = (F.col("nd") >= least * F.col("nq") - 1e-9) & (F.col("nq") >= least * F.col("nd") - 1e-9)
    met = of_doc.select("doc", "nd", "word").join(of_query.select("query", "nq", "word"), "word").where(fits).select("query", "doc").distinct()
    both = met.join(c.select("query", "nq", F.col("w").alias("wq")), "query").join(d.select("doc", "ord", "nd", "w"), "doc").withColumn("hits", F.size(F.array_intersect("wq", "w")))
    s = both.select("query", "doc", "ord", F.round(F.col("hits") / (F.col("nq") + F.col("nd") - F.col("hits")), 9).alias("score")).where(F.col("score") >= least)
    return s.groupBy("query").agg(F.min_by(F.struct("doc", "score"), F.struct(-F.col("score"), "ord")).alias("b")).select("query", "b.doc", "b.score")


def hard_negatives(ranked: DataFrame, positives: DataFrame, n: int = NEGATIVES, start: int = START, stop: int = POOL) -> DataFrame:
    """(query, doc, place) of the first n results from rank `start` to `stop` whose source is not the positive's.

    ranked: query, doc, rank, source; positives: query, positive, positive_source. A result without a source is taken.
    """
    pool = ranked.where(F.col("rank").between(start, stop)).join(positives, "query")
    ok = pool.where((F.col("doc") != F.col("positive")) & (F.coalesce("source", F.lit("")).eqNullSafe("") | (F.col("source") != F.coalesce("positive_source", F.lit("")))))
    return ok.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy("rank"))).where(F.col("place") <= n).select("query", "doc", "place")


def reranker_pairs(ranked: DataFrame, qrels: DataFrame, hard: int = HARD, noisy: int = NOISY) -> DataFrame:
    """(query, doc, label): relevant documents with 1, the first unrelated results with 0; queries with more than `noisy` are left out."""
    n = qrels.groupBy("query").agg(F.count("*").alias("n")).where(F.col("n") <= noisy)
    pos = qrels.join(n.select("query"), "query", "left_semi").select("query", "doc", F.lit(1.0).alias("label"))
    neg = ranked.join(n.select("query"), "query", "left_semi").join(qrels, ["query", "doc"], "left_anti")
    neg = neg.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy("rank"))).where(F.col("place") <= hard)
    return pos.unionAll(neg.select("query", "doc", F.lit(0.0).alias("label")))


def bucket_split(df: DataFrame, key: str, share: int = 10) -> DataFrame:
    """df with `part`: eval for a tenth (1 / share) of the keys by MD5, else train; it does not depend on order or seed."""
    return df.withColumn("part", F.when(F.pmod(F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint"), F.lit(share)) == 0, "eval").otherwise("train"))


def chat_rows(df: DataFrame, system: str, most: int = 4_000) -> DataFrame:
    """(id, messages) of rows (id, question, answer, context): system, user and assistant turns, the context cut to `most` characters."""
    ctx = F.coalesce(F.substring("context", 1, most), F.lit(""))
    user = F.when(ctx == "", F.col("question")).otherwise(F.concat(F.lit("Bağlam:\n"), ctx, F.lit("\n\nSoru: "), F.col("question")))
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return df.select("id", F.array(turn("system", F.lit(system)), turn("user", user), turn("assistant", F.col("answer"))).alias("messages"))


def positives(ranked: DataFrame, grounded: DataFrame, least: float = LEAST) -> DataFrame:
    """(query, positive): the chunk that a question's context is (query, doc), else its best result, if that scores `least` or more."""
    best = ranked.where((F.col("rank") == 1) & (F.col("score") >= least)).select("query", F.col("doc").alias("best"))
    own = grounded.select("query", F.col("doc").alias("own"))
    return own.join(best, "query", "full_outer").select("query", F.coalesce("own", "best").alias("positive"))


#: Texts of which missing negatives are taken.
POOL_TEXTS = 64


def triplets(questions: DataFrame, ranked: DataFrame, grounded: DataFrame, chunks: DataFrame, n: int = NEGATIVES) -> DataFrame:
    """(query, question, pos, neg): a question with its positive text and n others, hard negatives first.

    questions (query, question); ranked (query, doc, score, rank); grounded (query, doc) as best_by_jaccard gives it; chunks
    (doc, text, source). What is missing is filled from POOL_TEXTS different texts, in an order by hash of question and text; a
    text is never twice in a row. A question without a positive is left out; a corpus of few texts gives fewer negatives.
    """
    about = chunks.select("doc", "text", "source")
    pos = positives(ranked, grounded).join(about.select(F.col("doc").alias("positive"), F.col("text").alias("own_text"), F.col("source").alias("positive_source")), "positive")
    hard = hard_negatives(ranked.join(about.select("doc", "source"), "doc"), pos.select("query", "positive", "positive_source"), n)
    texts = hard.join(about.select("doc", "text"), "doc").groupBy("query").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"])).alias("hard"))
    pool = about.groupBy("text").agg(F.min("doc").alias("doc")).orderBy(F.xxhash64("text")).limit(POOL_TEXTS).agg(F.collect_list("text").alias("pool"))  # one row
    rows = questions.select("query", "question").join(pos, "query").join(texts, "query", "left").crossJoin(F.broadcast(pool))
    first = F.filter(F.coalesce("hard", F.array().cast("array<string>")), lambda t: t != F.col("own_text"))
    order = F.array_sort(F.transform("pool", lambda t: F.struct(F.xxhash64("query", t).alias("h"), t.alias("text"))))
    more = F.filter(F.transform(order, lambda x: x["text"]), lambda t: (t != F.col("own_text")) & ~F.array_contains(F.col("first"), t))
    rows = rows.withColumn("first", first)
    return rows.select("query", "question", F.array("own_text").alias("pos"), F.slice(F.concat("first", more), 1, n).alias("neg"))


def embedder_columns(rows: DataFrame) -> DataFrame:
    """(anchor, positive, negative, negative_1, …) of triplets, in either of the shapes in which they are written: lists pos and neg, or one
    positive_passage and negative_passage."""
    anchor = F.col("query" if "question" not in rows.columns else "question").alias("anchor")
    if "positive_passage" in rows.columns:
        return rows.select(anchor, F.col("positive_passage").alias("positive"), F.col("negative_passage").alias("negative"))
    return rows.select(anchor, F.try_element_at("pos", F.lit(1)).alias("positive"), *[F.try_element_at("neg", F.lit(i + 1)).alias(f"negative_{i}" if i else "negative") for i in range(NEGATIVES)])


def pair_counts(pairs: DataFrame) -> DataFrame:
    """One row: pairs with label 1 and 0, and how many of the latter there are for one of the former (infinity if there is none)."""
    n = pairs.agg(F.count_if(F.col("label") == 1.0).alias("n_positive"), F.count_if(F.col("label") == 0.0).alias("n_negative"))
    return n.withColumn("ratio", F.when(F.col("n_positive") > 0, F.col("n_negative") / F.col("n_positive")).otherwise(float("inf")))
