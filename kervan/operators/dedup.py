"""First-wins de-duplication, hold-out splits and merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kervan.functions.text import merge_key


def first_rows(df: DataFrame, keys: list[str | Column], *order) -> DataFrame:
    """The first row, in the given order, of each key. A key is aggregated map-side, so a hot one costs no long group."""
    ordered = F.struct(*order)
    named = [k if isinstance(k, Column) else F.col(k) for k in keys]
    cols = [f"k{i}" for i in range(len(named))]
    packed = df.select(*[k.alias(c) for k, c in zip(named, cols)], ordered.alias("o"), F.struct("*").alias("r"))
    return packed.groupBy(*cols).agg(F.min_by("r", "o").alias("r")).select("r.*")


def first_of_few(df: DataFrame, key: str, *order) -> DataFrame:
    """first_rows for a table in which few keys repeat: only keys are shuffled to find those, and only their rows to choose among them."""
    again = df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key)
    return df.join(again, key, "left_anti").unionByName(first_rows(df.join(again, key, "left_semi"), [key], *order))


def chunk_table(raw: DataFrame) -> DataFrame:
    """Chunks once each: of rows with one chunk_id the first by ord; null text counts as empty."""
    return first_of_few(raw.where("chunk_id IS NOT NULL"), "chunk_id", F.col("ord")).withColumn("text", F.coalesce("text", F.lit("")))


def text_dedup(chunks: DataFrame) -> DataFrame:
    """Chunks of different text (by MD5), the first by ord."""
    return first_rows(chunks, [F.md5("text")], F.col("ord"))


def holdout(rows: DataFrame, context: str, n: int = 300) -> tuple[DataFrame, DataFrame]:
    """(held out, rest): rows whose context's MD5 is among the last n different ones; rows without a context are never held out."""
    h = rows.withColumn("context_md5", F.when(F.coalesce(F.col(context), F.lit("")) != "", F.md5(context)))
    last = h.where("context_md5 IS NOT NULL").select("context_md5").distinct().orderBy(F.desc("context_md5")).limit(n)
    return h.join(last, "context_md5", "left_semi"), h.join(last, "context_md5", "left_anti")


def merge_rows(first: DataFrame, more: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of `first`, then those of `more` whose question (see merge_key) is new; column `src` is 0 or 1. Rows with an empty question
    or answer are left out."""
    both = first.withColumn("src", F.lit(0)).unionByName(more.withColumn("src", F.lit(1)))
    both = both.where("coalesce(question, '') <> '' AND coalesce(answer, '') <> ''")
    return first_rows(both.withColumn("key", merge_key(key)), ["key"], F.col("src"), F.col(order))


def unseen(new: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows that a run that was broken off has still to do."""
    return new.join(done.select(key), key, "left_anti")
