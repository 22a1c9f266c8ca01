"""Retrieval stages: a configuration each, and the plan it stands for."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kervan.functions.providers import pair_score
from kervan.operators import dense, fusion, graph, lexical

CANDIDATES, TOP = 50, 10


@dataclass(frozen=True)
class Stage:
    name: str
    retrieval: str  # dense, lexical, hybrid or rrf
    rerank: bool = False
    graph: bool = False
    alpha: float = 0.5
    generator: str = "base"
    embedding: str = "base"


# The stages of the evaluation in their order, and what each is made of.
STAGES = {s.name: s for s in (
    Stage("base", "dense"), Stage("hybrid", "hybrid"), Stage("rrf", "rrf"), Stage("rrf_rerank", "rrf", rerank=True), Stage("graph", "rrf", rerank=True, graph=True),
    Stage("llm_ft", "dense", generator="finetuned"), Stage("emb_ft", "rrf", rerank=True, embedding="finetuned"), Stage("full", "rrf", rerank=True, embedding="finetuned", generator="finetuned"),
)}


def eligible(names: list[str], has_graph: bool, models: tuple[str, ...] = ("base",)) -> tuple[list[Stage], list[str]]:
    """(stages to run, messages about those that cannot). models: the embeddings and generators at hand."""
    run, said = [], []
    for n in names:
        if n not in STAGES:
            said.append(f"unknown stage: {n}")
        elif STAGES[n].graph and not has_graph:
            said.append(f"no graph for stage: {n}")
        elif missing := sorted({STAGES[n].embedding, STAGES[n].generator} - set(models)):
            said.append(f"no {', '.join(missing)} model for stage: {n}")
        else:
            run.append(STAGES[n])
    return run, said


def retrieve(stage: Stage, dense_run: DataFrame, lexical_run: DataFrame, texts: DataFrame, questions: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """(query, doc, score, rank) of a stage.

    dense_run (query, doc, score, rank) and lexical_run (… and norm) have CANDIDATES results a query; texts (doc, doc_text),
    questions (query, query_text), edges (src, dst, kind).
    """
    k = CANDIDATES if stage.rerank else TOP
    if stage.retrieval == "dense":
        got = dense_run.where(F.col("rank") <= k).select("query", "doc", "score", "rank")
    elif stage.retrieval == "lexical":
        got = lexical_run.where(F.col("rank") <= k).select("query", "doc", "score", "rank")
    elif stage.retrieval == "hybrid":
        got = fusion.linear(dense_run, lexical_run, stage.alpha, k)
    elif stage.retrieval == "rrf":
        got = fusion.reciprocal_rank([dense_run, lexical_run], k)
    else:
        raise ValueError(stage.retrieval)
    if stage.rerank:
        got = fusion.rerank(got.select("query", "doc").join(texts, "doc").join(questions, "query"), pair_score, TOP).select("query", "doc", "score", "rank")
    if stage.graph:
        if edges is None:
            raise ValueError("this stage needs a graph")
        got = graph.expand(got, edges, texts)
    return got


def lexical_candidates(docs: DataFrame, queries: DataFrame, **columns) -> DataFrame:
    """(query, doc, score, norm, rank): BM25 candidates with scores moved to [0, 1] over all documents."""
    return lexical.bm25_top_normed(docs, queries, CANDIDATES, **columns)


def dense_candidates(queries: DataFrame, vectors: DataFrame) -> DataFrame:
    return dense.dense_top(queries, vectors, CANDIDATES)
