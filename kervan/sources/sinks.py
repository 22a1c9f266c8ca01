"""Sinks: indexes, graphs, predictions and reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from kervan.functions.storage import Files
from kervan.functions.text import bar, percent
from kervan.operators.dedup import unseen


def save_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> int:
    """Writes one record a line and returns their number, counted on the way."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode(mode).json(path)
    return seen.get["n"]


def save_index(chunks: DataFrame, path: str, dim: int) -> None:
    """Chunks with their vectors as a table; a missing vector or another dimension stops the write."""
    ok = F.assert_true(F.col("embedding").isNotNull() & (F.size("embedding") == dim), F.lit(f"a vector of {dim} numbers is needed"))
    chunks.where(F.coalesce(ok.isNull(), F.lit(True))).write.parquet(path)


def load_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_graph(edges: DataFrame, path: str) -> None:
    edges.select("src", "dst", "kind").write.parquet(path)


def load_graph(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).where(~F.startswith("src", F.lit("_")))


def append_missing(new: DataFrame, path: str, key: str = "query_id") -> None:
    """Appends the rows whose key is not in the table yet: a broken run goes on where it stopped."""
    spark = new.sparkSession
    todo = unseen(new, spark.read.parquet(path), key) if Files(spark).exists(path) else new
    todo.write.mode("append").parquet(path)


def resume_jsonl(spark: SparkSession, path: str, schema: str, key: str = "query_id") -> DataFrame:
    """The records of a JSON-lines file that was being appended to when a run broke off, up to its first line that is no record."""
    lines = spark.read.text(path).withColumn("at", F.monotonically_increasing_id()).where("trim(value) <> ''")
    read = lines.withColumn("r", F.from_json("value", schema, {"mode": "PERMISSIVE"})).withColumn("ok", F.col(f"r.{key}").isNotNull() & F.try_parse_json("value").isNotNull())
    end = read.where("NOT ok").agg(F.min("at").alias("end"))  # one row
    return read.crossJoin(F.broadcast(end)).where("end IS NULL OR at < end").select("r.*")


def save_metrics(metrics: DataFrame, path: str, extra: dict | None = None, limit: int | None = None) -> None:
    """A one-row metrics document as indented JSON; a limit on the questions is told in it."""
    row = json.loads(metrics.toJSON().first() or "{}") | (extra or {})
    if limit is not None:
        row |= {"limit_applied": True, "limit_value": limit}
    Files(metrics.sparkSession).write_text(path, json.dumps(row, ensure_ascii=False, indent=2))


def report_lines(metrics: DataFrame) -> DataFrame:
    """(metric, share, line) of rows (metric, share): a bar of 24 places and a percentage; N/A where the share is null."""
    return metrics.select("metric", "share", F.concat_ws(" ", F.coalesce(bar("share"), F.lit("")), percent("share")).alias("line"))


def ablation_table(runs: DataFrame, order: list[str]) -> DataFrame:
    """(place, line): a Markdown row for each stage of rows (stage, recall_at_5, …) in the order of the stages; N/A where a value is null."""
    place = F.array_position(F.lit(order), F.col("stage")).cast("int")
    four = lambda c: F.coalesce(F.format_string("%.4f", F.bround(c, 4)), F.lit("N/A"))
    share = lambda c: F.coalesce(F.format_string("%.1f%%", F.bround(F.col(c) * 100, 1)), F.lit("N/A"))
    cells = ["stage", *[four(c) for c in ("recall_at_5", "recall_at_10", "mrr", "ndcg_at_10")], *[share(c) for c in ("f1", "rouge_l", "citation_accuracy", "faithfulness_rate")], *[four(c) for c in ("scenario1_score", "scenario2_score", "scenario3_score")]]
    return runs.where(place > 0).select(place.alias("place"), F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


#: Sections of the report: heading, and by metric its label and column.
REPORT = {
    "Retrieval": {"Recall@5": "recall_at_5", "Recall@10": "recall_at_10", "MRR": "mrr", "nDCG@10": "ndcg_at_10"},
    "Answers": {"EM": "em", "F1": "f1", "ROUGE-L": "rouge_l", "BLEU": "bleu", "Citation": "citation_accuracy"},
    "Faithfulness": {"Grounded": "faithfulness_rate"},
}


def markdown_report(metrics: DataFrame, title: str) -> str:
    """A report of a one-row metrics document: what was run, and a table with bars for each section. Columns that it lacks are N/A."""
    row = metrics.first()
    have = row.asDict() if row else {}
    spark = metrics.sparkSession
    out = [f"# {title}", "", *[f"- {c.replace('_', ' ')}: {have.get(c, 'N/A')}" for c in ("stage", "retrieval_mode", "num_queries", "num_samples")]]
    for heading, names in REPORT.items():
        lines = report_lines(spark.createDataFrame([(k, have.get(c)) for k, c in names.items()], "metric string, share double")).collect()
        out += ["", f"## {heading}", "", "| metric | value |", "|-|-|", *[f"| {r.metric} | {r.line} |" for r in lines]]
    return "\n".join(out) + "\n"
