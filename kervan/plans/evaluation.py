"""Evaluation of a retrieval stage from question to metrics document."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kervan.functions import providers
from kervan.functions import text as T
from kervan.functions.storage import written
from kervan.operators import context, dense, metrics
from kervan.plans import stages


@dataclass
class Models:
    """What stands in for the models of a run; generator: columns (question, context) -> answer, null where it fails."""

    embedder: object = field(default_factory=providers.HashEmbedder)
    generator: object = providers.extractive_answer
    entailment: object = providers.entailment_logits
    judge: object = providers.judge_reply
    suite: object = providers.lexical_suite


def candidates(chunks: DataFrame, questions: DataFrame, embedder) -> tuple[DataFrame, DataFrame]:
    """(dense, lexical) candidates of questions (query_id, question), which all stages share; chunks (chunk_id, text)."""
    vectors = dense.as_vectors(dense.build_index(chunks.select("chunk_id", "text"), embedder))
    found = dense.dense_top(dense.as_queries(questions, embedder, text="question"), vectors, stages.CANDIDATES)
    lexical = stages.lexical_candidates(chunks, questions, doc="chunk_id", query_text="question")
    return written(found, "dense"), written(lexical, "lexical")


def retrieved(stage: stages.Stage, chunks: DataFrame, questions: DataFrame, found: tuple[DataFrame, DataFrame], edges: DataFrame | None = None) -> DataFrame:
    """(query, doc, score, rank) of a stage; a document that comes twice counts at its best rank."""
    texts = chunks.select(F.col("chunk_id").alias("doc"), F.col("text").alias("doc_text"))
    asked = questions.select(F.col("query_id").alias("query"), F.col("question").alias("query_text"))
    run = stages.retrieve(stage, *found, texts, asked, edges)
    return run.groupBy("query", "doc").agg(F.min_by("score", "rank").alias("score"), F.min("rank").alias("rank"))


def predictions(run: DataFrame, chunks: DataFrame, questions: DataFrame, generator, cite: bool = True) -> DataFrame:
    """Answers to questions (query_id, question, expected, expected_source) from a run's first results, in the columns of predictions.

    An answer that cannot be given is empty and has an error; its row stays.
    """
    about = chunks.select(F.col("chunk_id").alias("doc"), "text", "source", "doc_id")
    ranked = run.join(about, "doc")
    ctx = context.assemble(ranked.select("query", "rank", "source", "text")).select(F.col("query").alias("query_id"), "context")
    row = F.struct("rank", "text", "doc_id", "source", F.col("doc").alias("chunk_id"), F.col("score").cast("double").alias("score"))
    held = ranked.where(F.col("rank") <= context.PARTS).groupBy(F.col("query").alias("query_id")).agg(F.array_sort(F.collect_list(row)).alias("c"))
    chunk = lambda c: F.struct(c["text"].alias("text"), c["doc_id"].alias("doc_id"), c["source"].alias("source"), c["chunk_id"].alias("chunk_id"), c["score"].alias("score"))
    held = held.select("query_id", F.transform("c", chunk).alias("retrieved_chunks"), F.transform("c", lambda c: c["source"]).alias("retrieved_sources"))
    rows = questions.select("query_id", "question", "expected", "expected_source").join(ctx, "query_id", "left").join(held, "query_id", "left")
    raw = T.truncate_answer(F.coalesce(generator(F.col("question"), F.col("context")), F.lit("")))
    rows = rows.withColumn("predicted", raw).withColumn("error", F.when(F.col("predicted") == "", "no answer"))
    if cite:
        rows = rows.drop("context").join(context.inject_citations(rows.select("query_id", "predicted", "retrieved_chunks")), "query_id").drop("predicted").withColumnRenamed("answer", "predicted")
    return rows.select("query_id", "question", "predicted", "expected", "retrieved_sources", "expected_source", "retrieved_chunks", "error")


def faithfulness(rows: DataFrame, entailment, parts: int = context.PARTS) -> DataFrame:
    """(query_id, context_score, gold_score, score) of answered rows: entailment from the retrieved texts and from the expected answer, and the best result's score."""
    ctx = F.coalesce(F.array_join(F.transform(F.slice("retrieved_chunks", 1, parts), lambda c: c["text"]), "\n\n"), F.lit(""))
    exp = F.coalesce("expected", F.lit(""))
    share = metrics.softmax_at(entailment(ctx, F.col("predicted")), 1)
    gold = F.when(exp != "", metrics.softmax_at(entailment(exp, F.col("predicted")), 1))
    best = F.array_max(F.transform("retrieved_chunks", lambda c: c["score"]))
    return rows.where("coalesce(predicted, '') <> ''").select("query_id", F.round(share, 9).alias("context_score"), F.round(gold, 9).alias("gold_score"), F.round(best, 9).alias("score"))


def sampled_faithfulness(rows: DataFrame, entailment, n: int = 150) -> DataFrame:
    """faithfulness of a stratified sample of n answers."""
    scored = faithfulness(rows, entailment)
    return scored.join(metrics.stratified_sample(scored, "query_id", "score", n).select(F.col("key").alias("query_id")), "query_id", "left_semi")


def similarity(rows: DataFrame, embedder) -> DataFrame:
    """One row: mean inner product of the vectors of answers and expected answers; null without any."""
    pair = rows.select(embedder.column(F.coalesce("predicted", F.lit(""))).alias("a"), embedder.column(F.coalesce("expected", F.lit(""))).alias("b"))
    return pair.agg(F.round(F.avg(T.dot("a", "b")), 6).alias("semantic_similarity"))


def evaluate_predictions(rows: DataFrame, corpus: DataFrame, models: Models) -> DataFrame:
    """One row: answer metrics, faithfulness, judges, similarity, perplexity and the suite's metrics of predictions; failed ones are left out."""
    answered = rows.where("error IS NULL AND coalesce(predicted, '') <> ''")
    faith = metrics.faithfulness_summary(sampled_faithfulness(answered, models.entailment)).withColumn("faithfulness_rate", F.col("context_rate"))
    cost = providers.perplexities(answered, providers.unigram_costs(corpus)).agg(metrics.geometric_mean(F.col("perplexity")).alias("perplexity"))
    out = metrics.answer_summary(answered)
    for one in (faith, metrics.judge_means(answered, models.judge, list(providers.JUDGES)), similarity(answered, models.embedder), cost, metrics.suite_means(answered, models.suite)):
        out = out.crossJoin(one)  # one row each
    return out


def metrics_document(stage: stages.Stage, retrieval: DataFrame, answers: DataFrame) -> DataFrame:
    """One row: the stage, all metrics, and the scenario scores made of them; a judge's faithfulness goes before that of entailment."""
    both = retrieval.crossJoin(answers)
    faith = F.coalesce(F.when(F.col("llm_faithfulness_failed") < F.col("num_samples"), F.col("llm_faithfulness_score")), "faithfulness_rate")
    inputs = {"faithfulness": faith, "similarity": F.col("semantic_similarity"), "relevancy": F.col("llm_relevancy_score"), "coherence": F.col("llm_coherence_score")}
    scored = metrics.scenario_scores(both.withColumns(inputs)).drop(*inputs)
    mode = stage.retrieval + ("_rerank" if stage.rerank else "")
    return scored.select(F.lit(stage.name).alias("stage"), F.lit(mode).alias("retrieval_mode"), F.lit(stage.embedding).alias("embedding_model"), F.lit(stage.generator).alias("llm_model"), "*")


def run_stage(stage: stages.Stage, chunks: DataFrame, questions: DataFrame, relevant: DataFrame, models: Models | None = None, edges: DataFrame | None = None, found=None, limit: int | None = None) -> dict[str, DataFrame]:
    """The run, predictions and metrics of a stage.

    chunks (chunk_id, doc_id, text, source); questions (query_id, question, expected, expected_source); relevant (query, doc); edges: the graph,
    for stages that have one; found: candidates that several stages share; limit: the first questions by id only.
    """
    models = models or Models()
    if limit is not None:
        questions = questions.orderBy("query_id").limit(limit)
        relevant = relevant.join(questions.select(F.col("query_id").alias("query")), "query", "left_semi")
    found = found or candidates(chunks, questions, models.embedder)
    run = written(retrieved(stage, chunks, questions, found, edges), "run")
    rows = written(predictions(run, chunks, questions, models.generator), "predictions")
    retrieval = metrics.retrieval_metrics(run, relevant, questions.select(F.col("query_id").alias("query")))
    return {"run": run, "predictions": rows, "metrics": metrics_document(stage, retrieval, evaluate_predictions(rows, chunks, models))}


def run_stages(names: list[str], chunks: DataFrame, questions: DataFrame, relevant: DataFrame, models: dict[str, Models] | None = None, edges: DataFrame | None = None, limit: int | None = None) -> tuple[dict[str, dict[str, DataFrame]], list[str]]:
    """({stage: its results}, messages about stages that cannot run). models: by name of embedding or generator; "base" is there by default.

    Stages of one embedding share their candidates. A stage that fails is told of, and the others go on.
    """
    models = {"base": Models()} | (models or {})
    todo, said = stages.eligible(names, edges is not None, tuple(models))
    if limit is not None:
        questions = questions.orderBy("query_id").limit(limit)
        relevant = relevant.join(questions.select(F.col("query_id").alias("query")), "query", "left_semi")
    out, shared = {}, {}
    for stage in todo:
        try:
            own = Models(**{**vars(models[stage.embedding]), "generator": models[stage.generator].generator})
            if stage.embedding not in shared:
                shared[stage.embedding] = candidates(chunks, questions, own.embedder)
            out[stage.name] = run_stage(stage, chunks, questions, relevant, own, edges, shared[stage.embedding])
        except Exception as e:  # noqa: BLE001
            said.append(f"{stage.name}: {type(e).__name__}: {str(e)[:200]}")
    return out, said
