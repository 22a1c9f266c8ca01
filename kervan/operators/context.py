"""Context for a generator, neighbours of chunks, and citations in answers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kervan.functions import text as T

PARTS, CHARS = 5, 14_000


def assemble(ranked: DataFrame, parts: int = PARTS, chars: int = CHARS, strict: bool = False) -> DataFrame:
    """(query, n_included, context): the first parts whose running length stays within chars; ranked (query, rank, source, text).

    The first part is always taken, unless strict. Lengths are positive, so the first overflow ends the context.
    """
    body = F.concat(F.lit("[Kaynak "), F.col("rank").cast("string"), F.lit("] ("), F.coalesce("source", F.lit("")), F.lit(")\n"), F.coalesce("text", F.lit("")), F.lit("\n\n"))
    w = Window.partitionBy("query").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    part = ranked.where(F.col("rank") <= parts).select("query", "rank", body.alias("part")).withColumn("run", F.sum(F.length("part")).over(w))
    keep = part.withColumn("ok", (F.col("run") <= chars) | ((F.col("rank") == 1) & F.lit(not strict)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("ok"), F.struct("rank", "part")))), lambda x: x["part"]), "")
    return keep.groupBy("query").agg(F.count_if("ok").alias("n_included"), text.alias("context"))


def neighbours(chunks: DataFrame, window: int = 1) -> DataFrame:
    """chunks (chunk_id, …) with the ids of the chunks before and after within the document, by index; gaps are bridged."""
    idx = F.regexp_extract("chunk_id", r"_(\d+)$", 1).cast("int")
    prefix = F.regexp_replace("chunk_id", r"_\d+$", "")
    w = Window.partitionBy("prefix").orderBy("idx", "chunk_id")
    c = chunks.where(F.col("chunk_id").rlike(r"_\d+$")).withColumn("prefix", prefix).withColumn("idx", idx)
    return c.withColumns({"before": F.lag("chunk_id", window).over(w), "after": F.lead("chunk_id", window).over(w)})


def joined(a: str, b: str, most: int = 360) -> str:
    """a and b as one text: the longest end of a that begins b is written once; without one they stand on two lines."""
    n = next((n for n in range(min(most, len(a), len(b)), 0, -1) if a.endswith(b[:n])), 0)
    return a + b[n:] if n else f"{a}\n{b}"


def overlap_join(a: Column, b: Column) -> Column:
    """`joined` of two columns, null where either is."""

    @F.pandas_udf("string")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else joined(p, q) for p, q in zip(x, y)], dtype=object)

    return run(a, b)


def expand_chunk(chunks: DataFrame) -> DataFrame:
    """(chunk_id, expanded): a chunk's text with its neighbours' before and after it."""
    w = Window.partitionBy("prefix").orderBy("idx", "chunk_id")
    n = neighbours(chunks).withColumns({"tb": F.lag("text").over(w), "ta": F.lead("text").over(w)})
    left = n.withColumn("left", F.coalesce(overlap_join(F.col("tb"), F.col("text")), "text"))
    return left.select("chunk_id", F.coalesce(overlap_join(F.col("left"), F.col("ta")), "left").alias("expanded"))


def inject_citations(rows: DataFrame, least: float = 0.15) -> DataFrame:
    """(query_id, answer): answers with [Kaynak n] after the sentence that each retrieved chunk overlaps most.

    rows: query_id, predicted, retrieved_chunks. Overlap is the overlap coefficient of folded words; below `least` a chunk is not
    cited, and an answer without any citation comes back unchanged. All within the row: no join, no shuffle.
    """
    sents = F.split(F.coalesce("predicted", F.lit("")), r"(?<=[.!?])\s+")
    chunks = F.coalesce(F.transform("retrieved_chunks", lambda c: c["text"]), F.array().cast("array<string>"))
    words = lambda c: T.qa_tokens(F.coalesce(c, F.lit("")))
    base = rows.select("query_id", "predicted", sents.alias("sents"), F.transform(sents, lambda s: words(s)).alias("sw"), F.transform(chunks, lambda c: words(c)).alias("cw"))
    scored = base.withColumn("best", F.transform("cw", lambda c: F.array_max(F.transform(F.col("sw"), lambda s, i: F.struct(T.overlap_coefficient(s, c).alias("score"), (-i).alias("neg"))))))
    place = F.transform("best", lambda b, i: F.struct((-b["neg"]).alias("s"), (i + 1).alias("n"), b["score"].alias("score")))
    ok = scored.withColumn("cites", F.filter(place, lambda p: p["score"] >= least))
    tagged = F.transform("sents", lambda s, i: F.concat(s, F.array_join(F.transform(F.filter(F.col("cites"), lambda p: p["s"] == i), lambda p: F.concat(F.lit(" [Kaynak "), p["n"].cast("string"), F.lit("]"))), "")))
    return ok.select("query_id", F.when(F.size("cites") == 0, F.col("predicted")).otherwise(F.array_join(tagged, " ")).alias("answer"))
