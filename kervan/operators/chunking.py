"""Cutting documents into chunks."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE, OVERLAP, LEAST = 1_400, 180, 180
SEPARATORS = ("\n\n", "\n", ". ", " ", "")
ARTICLE = re.compile(r"(?im)(?=^\s*MADDE\s+\d)")


def recursive_split(text: str, size: int = SIZE, overlap: int = OVERLAP, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most `size`, cut at the first separator that occurs, else at finer ones; whole parts of up to `overlap` are repeated."""
    here = next((i for i, s in enumerate(separators) if not s or s in text), len(separators) - 1)
    sep, finer = separators[here], separators[here + 1 :]
    if sep:
        head, *tail = text.split(sep)
        parts = [head, *(sep + x for x in tail)]
    else:
        parts = list(text)
    out: list[str] = []
    buffer: list[str] = []
    for part in filter(None, parts):
        if len(part) < size:
            buffer.append(part)
            continue
        out += merged(buffer, size, overlap)
        buffer = []
        out += recursive_split(part, size, overlap, finer) if finer else [part]
    return out + merged(buffer, size, overlap)


def merged(parts: list[str], size: int, overlap: int) -> list[str]:
    """Neighbouring parts joined up to `size`."""
    out, window, total = [], [], 0
    for part in parts:
        if window and total + len(part) > size:
            if joined := "".join(window).strip():
                out.append(joined)
            while total > overlap or (total and total + len(part) > size):
                total -= len(window.pop(0))
        window.append(part)
        total += len(part)
    if joined := "".join(window).strip():
        out.append(joined)
    return out


def chunks_of(text: str, articles: bool = True, size: int = SIZE, overlap: int = OVERLAP, least: int = LEAST) -> list[tuple[int, str]]:
    """(index, piece) of a text. By articles, pieces kept are counted; otherwise the index is the place among all pieces, so it has gaps."""
    if len(text) < least:
        return []
    if not articles:
        return [(i, p) for i, p in enumerate(recursive_split(text, size, overlap)) if len(p) >= least]
    kept: list[str] = []
    for part in map(str.strip, ARTICLE.split(text)):
        if len(part) >= least:
            kept += [part] if len(part) <= size else [p for p in recursive_split(part, size, overlap) if len(p) >= least]
    return list(enumerate(kept))


def chunk(df: DataFrame, articles: bool = True, doc: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """(chunk_id, doc_id, idx, text, source, char_len) of documents; null and short texts give none."""

    def apply(batches):
        for b in batches:
            rows = [(d, s, i, p) for d, s, t in zip(*(b.column(k).to_pylist() for k in range(3))) for i, p in chunks_of(t, articles)]
            cols = list(zip(*rows)) if rows else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), ty) for c, ty in zip(cols, (pa.string(), pa.string(), pa.int32(), pa.string()))], names=["doc_id", "source", "idx", "text"])

    src = df.where(F.length(text) >= LEAST).select(F.col(doc).cast("string"), F.col(source).cast("string"), text)
    got = src.mapInArrow(apply, "doc_id string, source string, idx int, text string")
    return got.select(F.concat_ws("_", F.coalesce("source", F.lit("")), "doc_id", "idx").alias("chunk_id"), "doc_id", "idx", "text", "source", F.length("text").alias("char_len"))


def fixed_windows(df: DataFrame, size: int = SIZE, overlap: int = OVERLAP, least: int = LEAST) -> DataFrame:
    """(doc_id, idx, start, text): windows of fixed size and step, as an expression; a window under `least` is left out."""
    step = size - overlap
    at = F.explode(F.sequence(F.lit(0), F.greatest(F.length("text") - 1, F.lit(0)), F.lit(step)))
    w = df.where(F.length("text") >= least).select("doc_id", "text", at.alias("start"))
    return w.select("doc_id", (F.col("start") / step).cast("int").alias("idx"), "start", F.substring("text", F.col("start") + 1, F.lit(size)).alias("text")).where(F.length("text") >= least)
