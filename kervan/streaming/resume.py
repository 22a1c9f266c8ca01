"""Incremental answering: question files that arrive in a folder are answered once each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def answer_new(spark: SparkSession, questions: str, schema: str, answer: Callable[[DataFrame], DataFrame], out: str, checkpoint: str):
    """Reads the files that are new since the last call, answers them and appends to a Parquet table; returns when all are done."""
    stream = answer(spark.readStream.schema(schema).json(questions))
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query.lastProgress
