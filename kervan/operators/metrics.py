"""Metrics of retrieval, of answers, of faithfulness, and scores made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kervan.functions import text as T


def retrieval_per_query(runs: DataFrame, qrels: DataFrame, ks: tuple[int, ...] = (5, 10)) -> DataFrame:
    """One row for each query of qrels (query, doc): recall, capped recall, precision, hit and nDCG at each k, and reciprocal rank.

    runs: (query, doc, rank). A document that a run has twice counts at its best rank. A query without a run scores 0.
    """
    best = runs.groupBy("query", "doc").agg(F.min("rank").alias("rank"))
    rel = qrels.select("query", "doc").distinct()
    n_rel = rel.groupBy("query").agg(F.count("*").alias("n_rel"))
    hits = rel.join(best, ["query", "doc"]).groupBy("query").agg(
        F.min("rank").alias("first"),
        *[F.count_if(F.col("rank") <= k).alias(f"hits_{k}") for k in ks],
        *[F.sum(F.when(F.col("rank") <= k, 1 / F.log2(F.col("rank") + 1))).alias(f"dcg_{k}") for k in ks],
    )
    q = n_rel.join(hits, "query", "left")
    out = [F.col("query"), F.col("n_rel"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("rr")]
    for k in ks:
        h = F.coalesce(F.col(f"hits_{k}"), F.lit(0))
        ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k), F.col("n_rel")).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
        out += [
            (h / F.col("n_rel")).alias(f"recall_at_{k}"), (h / F.least(F.lit(k), F.col("n_rel"))).alias(f"capped_recall_at_{k}"), (h / F.lit(k)).alias(f"precision_at_{k}"),
            F.when(h > 0, 1.0).otherwise(0.0).alias(f"hit_at_{k}"), (F.coalesce(F.col(f"dcg_{k}"), F.lit(0.0)) / ideal).alias(f"ndcg_at_{k}"),
        ]
    return q.select(*out)


RETRIEVAL = ("recall_at_5", "recall_at_10", "mrr", "ndcg_at_10", "hit_at_5", "hit_at_10", "capped_recall_at_5", "capped_recall_at_10", "precision_at_5", "precision_at_10")


def retrieval_metrics(runs: DataFrame, qrels: DataFrame, total: DataFrame) -> DataFrame:
    """One row of means over the queries with relevant documents; total_queries counts those of `total` (query)."""
    per = retrieval_per_query(runs, qrels).withColumnRenamed("rr", "mrr")
    means = per.agg(*[F.round(F.coalesce(F.avg(m), F.lit(0.0)), 6).alias(m) for m in RETRIEVAL], F.count("*").alias("num_queries"))
    return means.crossJoin(total.agg(F.countDistinct("query").alias("total_queries")))


def average_precision(labelled: DataFrame) -> DataFrame:
    """(query, ap) of ranked labels (query, rank, label); queries without a positive label are left out."""
    w = Window.partitionBy("query").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return labelled.withColumn("hits", F.sum("label").over(w)).groupBy("query").agg(F.sum(F.when(F.col("label") == 1, F.col("hits") / F.col("rank"))).alias("s"), F.sum("label").alias("n")).where("n > 0").select("query", (F.col("s") / F.col("n")).alias("ap"))


def exact_match(pred: Column, exp: Column) -> Column:
    """1 if the expected answer stands in the predicted one, letters folded."""
    p, e = F.trim(T.turkish_lower(pred)), F.trim(T.turkish_lower(exp))
    return F.when(e == "", 0.0).when(F.contains(p, e), 1.0).otherwise(0.0)


def f1_of(hits: Column, n_pred: Column, n_exp: Column) -> Column:
    return F.when((n_pred == 0) & (n_exp == 0), 1.0).when((n_pred == 0) | (n_exp == 0) | (hits == 0), 0.0).otherwise(2 * hits / (n_pred + n_exp))


def bleu_counts(pred: str, exp: str) -> list[Column]:
    """Clipped matches and totals of n-grams of one to four tokens."""
    out = []
    for n in range(1, 5):
        a, b = T.ngrams(pred, n), T.ngrams(exp, n)
        out += [T.multiset_overlap(a, b).alias(f"match_{n}"), F.size(a).alias(f"total_{n}")]
    return out


def bleu_of(n_pred: Column, n_exp: Column, floor: float = 1e-9) -> Column:
    """BLEU of the counts in match_n and total_n; a precision of zero is replaced by the floor (0: the score is then 0)."""
    logs = F.lit(0.0)
    for n in range(1, 5):
        p = F.when(F.col(f"total_{n}") > 0, F.col(f"match_{n}") / F.col(f"total_{n}")).otherwise(0.0)
        logs = logs + F.log(F.when(p > 0, p).otherwise(floor if floor else None)) / 4
    short = F.when(n_pred > n_exp, 1.0).otherwise(F.exp(1 - n_exp / n_pred))
    return F.when(n_pred == 0, 0.0).otherwise(F.coalesce(short * F.exp(logs), F.lit(0.0)))


def answer_scores(rows: DataFrame) -> DataFrame:
    """rows (query_id, predicted, expected) with em, f1, rouge_l and bleu of each; null counts as empty, citations are taken out first."""
    clean = rows.select("query_id", T.strip_citations(F.coalesce("predicted", F.lit(""))).alias("p"), F.coalesce("expected", F.lit("")).alias("e"))
    tok = clean.withColumn("pt", T.qa_tokens("p")).withColumn("et", T.qa_tokens("e")).withColumn("np", F.size("pt")).withColumn("ne", F.size("et"))
    hits, lcs = T.multiset_overlap("pt", "et"), T.lcs_length("pt", "et")
    scored = tok.select("query_id", "np", "ne", exact_match(F.col("p"), F.col("e")).alias("em"), f1_of(hits, F.col("np"), F.col("ne")).alias("f1"), f1_of(lcs, F.col("np"), F.col("ne")).alias("rouge_l"), *bleu_counts("pt", "et"))
    return scored.withColumn("bleu", bleu_of(F.col("np"), F.col("ne")))


def corpus_bleu(scored: DataFrame) -> DataFrame:
    """One row: BLEU of pooled counts."""
    pooled = scored.agg(*[F.sum(c).alias(c) for n in range(1, 5) for c in (f"match_{n}", f"total_{n}")], F.sum("np").alias("np"), F.sum("ne").alias("ne"))
    return pooled.select(F.round(bleu_of(F.col("np"), F.col("ne")), 6).alias("bleu"))


def answer_summary(rows: DataFrame) -> DataFrame:
    """One row: means of em, f1 and rouge_l, BLEU of pooled counts, citation rates and the number of answers; rows as predictions has them.

    Without answers all are 0.
    """
    scored = answer_scores(rows.select("query_id", "predicted", "expected"))
    sums = [F.sum(c).alias(c) for n in range(1, 5) for c in (f"match_{n}", f"total_{n}")]
    means = [F.round(F.coalesce(F.avg(m), F.lit(0.0)), 6).alias(m) for m in ("em", "f1", "rouge_l")]
    own = scored.agg(*means, *sums, F.coalesce(F.sum("np"), F.lit(0)).alias("np"), F.coalesce(F.sum("ne"), F.lit(0)).alias("ne"), F.count("*").alias("num_samples"))
    own = own.select("em", "f1", "rouge_l", F.round(bleu_of(F.col("np"), F.col("ne")), 6).alias("bleu"), "num_samples")
    names = {"citation_accuracy": "citation_accuracy", "source_in_context": "source_in_context_rate", "citation_presence": "citation_presence_rate"}
    return own.crossJoin(citation_flags(rows).agg(*[F.round(F.coalesce(F.avg(a), F.lit(0.0)), 6).alias(b) for a, b in names.items()]))  # one row each


def mean_average_precision(labelled: DataFrame) -> DataFrame:
    return average_precision(labelled).agg(F.round(F.coalesce(F.avg("ap"), F.lit(0.0)), 6).alias("map"), F.count("*").alias("num_queries"))


def questions_of(rows: DataFrame, questions: DataFrame) -> DataFrame:
    """rows (query_id, …) with `question`: the first of questions (query_id, question) by the question itself, else the id."""
    first = questions.groupBy("query_id").agg(F.min("question").alias("question"))
    return rows.join(first, "query_id", "left").withColumn("question", F.coalesce("question", "query_id"))


def citation_flags(rows: DataFrame) -> DataFrame:
    """query_id with citation_accuracy, source_in_context and citation_presence, 0 or 1; see the columns of predictions."""
    same = lambda a, b: F.trim(T.turkish_lower(F.coalesce(a, F.lit("")))) == F.trim(T.turkish_lower(F.coalesce(b, F.lit(""))))
    numbers = T.citation_numbers(F.coalesce("predicted", F.lit("")))
    sources = F.coalesce("retrieved_sources", F.array().cast("array<string>"))
    exp = F.trim(F.coalesce("expected_source", F.lit("")))
    cited = F.transform(F.filter(numbers, lambda i: (i >= 1) & (i <= F.size(sources))), lambda i: F.element_at(sources, i))
    return rows.select(
        "query_id", F.when(exp == "", 0).when(F.exists(cited, lambda s: same(s, exp)), 1).otherwise(0).alias("citation_accuracy"),
        F.when(exp == "", 0).when(F.exists(sources, lambda s: same(s, exp)), 1).otherwise(0).alias("source_in_context"), F.when(F.size(numbers) > 0, 1).otherwise(0).alias("citation_presence"),
    )


def faithfulness_class(score: Column) -> Column:
    return F.when(score.isNull(), "miss").when(score > 0.7, "hit").when(score >= 0.4, "partial").otherwise("miss")


def softmax_at(logits: Column, place: int) -> Column:
    """Probability of one class (from 0) of an array of logits."""
    top = F.array_max(logits)
    e = lambda x: F.exp(x - top)
    return e(F.element_at(logits, place + 1)) / F.aggregate(logits, F.lit(0.0), lambda a, x: a + e(x))


def faithfulness_summary(rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row of counts, rates and spread of rows (score, context_score, gold_score); gold_score null: no gold answer."""
    grounded, gold = F.col("context_score") >= threshold, F.col("gold_score").isNotNull()
    return rows.withColumn("class", faithfulness_class(F.col("score"))).agg(
        F.count("*").alias("total"), *[F.count_if(F.col("class") == c).alias(f"n_{c}") for c in ("hit", "partial", "miss")], F.count_if(grounded).alias("context_grounded"), F.count_if(gold).alias("gold_total"),
        F.round(F.count_if(grounded) / F.nullif(F.count("*"), F.lit(0)), 6).alias("context_rate"), F.round(F.count_if(gold & (F.col("gold_score") >= threshold)) / F.nullif(F.count_if(gold), F.lit(0)), 6).alias("gold_rate"),
        F.round(F.avg("context_score"), 6).alias("mean"), F.round(F.min("context_score"), 6).alias("low"), F.round(F.max("context_score"), 6).alias("high"), F.round(F.stddev_pop("context_score"), 6).alias("std"),
    )


def stratified_sample(rows: DataFrame, key: str, score: str, n: int = 150) -> DataFrame:
    """(key, class, bucket): n // 3 of each class in the order of MD5 of the key, what a class lacks is filled from the rest in turn.

    A filled row keeps its class; its bucket is the one it fills. An order by hash takes the place of a random draw.
    """
    third = n // 3
    classes = ["hit", "partial", "miss"]
    r = rows.select(F.col(key).cast("string").alias("key"), faithfulness_class(F.col(score)).alias("class")).withColumn("h", F.md5("key"))
    first = Window.partitionBy("class").orderBy("h", "key")
    own = r.withColumn("rn", F.row_number().over(first)).where(F.col("rn") <= third)  # each task keeps a third only
    short = own.agg((F.lit(3 * third) - F.count("*")).alias("short"))
    rest = r.join(F.broadcast(own.select("key", "class")), ["key", "class"], "left_anti").orderBy("h", "key").limit(3 * third)  # n rows at most on both sides
    rest = rest.withColumn("i", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("h", "key")))
    fill = rest.crossJoin(F.broadcast(short)).where("i <= short").select("key", "class", F.element_at(F.array(*map(F.lit, classes)), (F.pmod(F.col("i") - 1, F.lit(3)) + 1).cast("int")).alias("bucket"))
    return own.select("key", "class", F.col("class").alias("bucket")).unionAll(fill)


def geometric_mean(c: Column, least: int = 3) -> Column:
    return F.when(F.count(c) >= least, F.round(F.exp(F.avg(F.log(c))), 4))


def scenario_scores(rows: DataFrame) -> DataFrame:
    """Adds scenario1..3 to rows (mrr, f1, faithfulness, similarity, relevancy, coherence), each of which may be null."""
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    three = F.filter(F.array("relevancy", "faithfulness", "coherence"), lambda x: x.isNotNull())
    return rows.withColumns({
        "scenario1_score": F.bround(0.35 * z("mrr") + 0.40 * z("f1") + 0.25 * z("faithfulness"), 6),
        "scenario2_score": F.bround(F.when(F.col("similarity").isNull(), z("f1")).otherwise(0.70 * z("f1") + 0.30 * F.col("similarity")), 6),
        "scenario2_fallback": F.col("similarity").isNull(),
        "scenario3_score": F.bround(F.when(F.size(three) > 0, F.aggregate(three, F.lit(0.0), lambda a, x: a + x) / F.size(three)), 6),
    })


def suite_means(rows: DataFrame, suite, n: int = 50) -> DataFrame:
    """One row: means of a suite's metrics over n answers that have contexts, in the order of MD5 of the id; NaN is left out, a metric without a value is null."""
    contexts = F.filter(F.transform(F.slice("retrieved_chunks", 1, 5), lambda c: c["text"]), lambda t: F.coalesce(t, F.lit("")) != "")
    some = rows.where("coalesce(predicted, '') <> ''").withColumn("contexts", contexts).where(F.size("contexts") > 0).orderBy(F.md5("query_id"), "query_id").limit(n)
    got = some.select(*[c.alias(f"ragas_{m}") for m, c in suite(F.col("question"), F.col("predicted"), F.col("contexts"), F.col("expected")).items()])
    return got.agg(*[F.round(F.avg(F.nanvl(c, F.lit(None).cast("double"))), 4).alias(c) for c in got.columns])


def judge_means(rows: DataFrame, reply, kinds, n: int = 20) -> DataFrame:
    """One row: for each kind of judge the mean score llm_<kind>_score of n answers, in the order of MD5 of the id (0.5 without any), and how many failed."""
    context = F.array_join(F.transform(F.slice("retrieved_chunks", 1, 5), lambda c: F.coalesce(c["text"], F.lit(""))), "\n\n")
    some = rows.where("coalesce(predicted, '') <> ''").orderBy(F.md5("query_id"), "query_id").limit(n)
    got = some.select(*[reply(k, F.col("question"), F.col("predicted"), F.col("expected"), context).alias(k) for k in kinds])
    out = []
    for k in kinds:
        score = F.when(F.col(k).isNotNull(), T.judge_score(F.col(k)))
        out += [F.round(F.coalesce(F.avg(score), F.lit(0.5)), 6).alias(f"llm_{k}_score"), F.count_if(F.col(k).isNull()).alias(f"llm_{k}_failed")]
    return got.agg(*out)
