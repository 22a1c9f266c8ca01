"""The corpus and the question sets, made from raw rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kervan.functions.storage import Files
from kervan.operators.chunking import chunk
from kervan.operators.dedup import holdout, text_dedup
from kervan.sources import readers, sinks

HELD_OUT = 300


def build_corpus(rows: DataFrame, extra: DataFrame | None = None, held_out: int = HELD_OUT) -> DataFrame:
    """(chunk_id, doc_id, text, source, char_len, ord) of the rows (id, context, source, ord) that are not held out, then of further texts.

    Rows without a context have no chunks. extra: (doc_id, text, source, ord), for example laws beside the rows. Of chunks of one
    text the first by ord stays, over both. Chunks come in the order of the rows, the further texts' after them.
    """
    _, rest = holdout(rows, "context", held_out)
    texts = rest.where("coalesce(context, '') <> ''").select(F.col("id").cast("string").alias("doc_id"), "source", F.col("context").alias("text"), F.col("ord").cast("bigint").alias("ord"), F.lit(0).alias("kind"))
    if extra is not None:
        texts = texts.unionByName(extra.select(F.col("doc_id").cast("string").alias("doc_id"), "source", "text", F.col("ord").cast("bigint").alias("ord"), F.lit(1).alias("kind")))
    at = texts.select("doc_id", "kind", "ord").groupBy("doc_id").agg(F.min(F.struct("kind", "ord")).alias("of"))
    got = chunk(texts).join(at, "doc_id").select("chunk_id", "doc_id", "text", "source", "char_len", F.struct("of.kind", "of.ord", "idx").alias("ord"))
    return text_dedup(got)


def evaluation_rows(rows: DataFrame, held_out: int = HELD_OUT) -> DataFrame:
    """The held-out rows as questions."""
    held, _ = holdout(rows, "context", held_out)
    return readers.as_examples(held)


def prepare(spark: SparkSession, rows: DataFrame, folder: str, exam: DataFrame | None = None, source_map: DataFrame | None = None, extra_laws: str | None = None) -> dict[str, int]:
    """Writes corpus_chunks, qa_eval, qa_train and, with exam rows, qa_hmgs as JSON lines into the folder; gives their numbers of records.

    rows: raw rows with ord; those of split kaggle make the corpus and its questions, those of split train are for training. extra_laws: a
    file of JSON lines (text, source, doc_id), taken if it is there.
    """
    extra = None
    if extra_laws and Files(spark).exists(extra_laws):
        extra = readers.read_jsonl(spark, extra_laws, "doc_id string, source string, text string").withColumn("ord", F.monotonically_increasing_id())
    own = rows.where("split = 'kaggle'")
    out = {"corpus_chunks": build_corpus(own, extra).drop("ord"), "qa_eval": evaluation_rows(own), "qa_train": readers.as_examples(rows.where("split = 'train'"))}
    if exam is not None:
        out["qa_hmgs"] = readers.exam_questions(exam, source_map)
    return {name: sinks.save_jsonl(df, f"{folder}/{name}") for name, df in out.items()}
