"""Problem 8: evaluation texts inside corpus documents.

Method: prefix-filtered set join. An item's text is cut into windows of 14 words. Shingles of three words are ordered by rarity over
all documents, and of each window only its rarest shingle (the prefix that an exact containment needs) is joined with
the documents' shingles. A hit at a place gives one possible position of the window, which is discarded if it does not fit into the document or
if the 14 words there, as a hash of 64 bits, are not the window's.

Items are a table like the documents: nothing of theirs goes to the driver or to every task but bitmaps of bounded size, which only spare
the join what it would drop anyway. The documents are read twice, however many items there are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kervan.llm.common_form import sql_form
from kervan.llm.overlap import seen, seen_filter
from kervan.llm.util import cut_lineage, written
from kervan.llm.words import BASE, each, mix

WINDOW = 14
SHINGLE = 3
SHIFTS = WINDOW - SHINGLE + 1
#: log2 of the places of a bitmap: some for each entry, within these bounds (8 KB to 16 MB).
LEAST_BITS, MOST_BITS, PLACES = 16, 27, 32
#: Keys up to this many are sent to every task, some 24 bytes each; more are joined by a shuffle.
BROADCAST_KEYS = 200_000


def run_hash(h: np.ndarray, start: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each start on."""
    out = np.zeros(len(start), dtype=np.uint64)
    for i in range(n):
        out = mix(out * BASE + h[start + i])
    return out


def bitmap(ids: DataFrame, n: int) -> np.ndarray:
    return seen_filter(ids, min(MOST_BITS, max(LEAST_BITS, (PLACES * max(1, n)).bit_length())))


def item_windows(items: DataFrame) -> DataFrame:
    """(query_id, w, s, h) of rows (query_id, text): hash w of each window of WINDOW words, and hash h of its shingle at place s."""

    def apply(batches):
        for b in batches:
            ids = b.column("query_id")
            for lo, x in each(b.column("text")):
                doc, at, w = x.sequences(WINDOW)
                if not len(at):
                    continue
                at, s = np.repeat(at, SHIFTS), np.tile(np.arange(SHIFTS), len(at))
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(lo + np.repeat(doc, SHIFTS))), pa.array(np.repeat(w, SHIFTS).view(np.int64)), pa.array(s.astype(np.int32)), pa.array(run_hash(x.hash, at + s, SHINGLE).view(np.int64))],
                    names=["query_id", "w", "s", "h"],
                )

    held = items.where("query_id IS NOT NULL AND text IS NOT NULL").select(F.col("query_id").cast("string").alias("query_id"), "text").distinct()
    return held.mapInArrow(apply, "query_id string, w bigint, s int, h bigint")


def shingle_counts(docs: DataFrame, on: np.ndarray) -> DataFrame:
    """(h, n): in how many documents each shingle stands that the bitmap does not rule out; a task adds up a batch's."""

    def apply(batches):
        for b in batches:
            for _, x in each(b.column("text")):
                doc, _, h = x.sequences(SHINGLE)
                ok = seen(on, h)
                order = np.lexsort((doc[ok], h[ok]))
                doc, h = doc[ok][order], h[ok][order]
                once = np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))[: len(h)]
                values, n = np.unique(h[once], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(n)], names=["h", "n"])

    return docs.select("text").mapInArrow(apply, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))


def leaked_items(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, query_id) of documents (doc_id, text) in which WINDOW consecutive words of an item's text stand consecutively.

    items: rows (query_id, text), any number for an item. Null texts and texts of fewer words never occur; repeated
    rows count once; no documents or no items give no rows.
    """
    docs = docs.where("text IS NOT NULL").select("doc_id", "text")
    windows = written(item_windows(items), "windows")
    places = windows.count()
    parts = windows.select("w", "s", "h").distinct()
    counts = shingle_counts(docs, bitmap(windows.select("h"), places))
    rarest = parts.join(counts, "h", "left").groupBy("w").agg(F.min_by(F.struct("h", "s", F.coalesce("n", F.lit(0)).alias("n")), F.struct(F.coalesce("n", F.lit(0)), "s")).alias("k"))
    keys = cut_lineage(rarest.where("k.n > 0").select("w", "k.h", "k.s"))  # a window with a shingle that no document has is in none
    n_keys = keys.count()
    on_h, on_w = bitmap(keys.select("h"), n_keys), bitmap(keys.select("w"), n_keys)

    def find(batches):
        for b in batches:
            ids = b.column("doc_id")
            for lo, x in each(b.column("text")):
                doc, at, h = x.sequences(SHINGLE)
                ok = seen(on_h, h)
                doc, at, h = (np.repeat(v[ok], SHIFTS) for v in (doc, at, h))
                s = np.tile(np.arange(SHIFTS), int(ok.sum()))
                start = at - s
                fits = (start >= x.first[doc]) & (start + WINDOW <= x.first[doc + 1])
                doc, s, h, start = doc[fits], s[fits], h[fits], start[fits]
                w = run_hash(x.hash, start, WINDOW)
                ok = seen(on_w, w)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(lo + doc[ok])), pa.array(w[ok].view(np.int64)), pa.array(s[ok].astype(np.int32)), pa.array(h[ok].view(np.int64))], names=["doc_id", "w", "s", "h"])

    key = docs.schema["doc_id"].dataType.simpleString()
    hits = docs.mapInArrow(find, f"doc_id {key}, w bigint, s int, h bigint")
    small = places <= BROADCAST_KEYS
    hits = hits.join(F.broadcast(keys) if small else keys, ["h", "s", "w"], "left_semi").select("doc_id", "w").distinct()
    owners = windows.where("s = 0").select("w", "query_id").distinct()
    return hits.join(F.broadcast(owners) if small else owners, "w").select("doc_id", "query_id").distinct()


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = spark.read.parquet(f"{sf_dir}/rag_eval.parquet")
    return ev.select("query_id", F.explode(F.array("query", "gold_answer_extract")).alias("text"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_items(spark.read.parquet(f"{sf_dir}/documents.parquet"), _items(spark, sf_dir))


def p8_found_sql() -> str:
    words = lambda c: f"regexp_extract_all(lower(translate({sql_form(c)}, 'İI', 'iı')), '[\\p{{L}}\\p{{N}}]+')"
    runs = lambda key, table: f"""(SELECT DISTINCT {key}, g FROM (
            SELECT {key}, string_agg(word, ' ') OVER x AS g, count(*) OVER x AS n FROM (SELECT {key}, no, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM {table})
            WINDOW x AS (PARTITION BY {key}, no ORDER BY pos ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING)) WHERE n = {WINDOW})"""  # noqa: E731
    return f"""
        WITH i AS (SELECT query_id, row_number() OVER () AS no, {words("text")} AS w FROM (SELECT query_id, query AS text FROM rag_eval UNION SELECT query_id, gold_answer_extract FROM rag_eval) WHERE text IS NOT NULL),
             d AS (SELECT doc_id, row_number() OVER () AS no, {words("text")} AS w FROM documents WHERE text IS NOT NULL)
        SELECT DISTINCT doc_id, query_id FROM {runs("doc_id", "d")} JOIN {runs("query_id", "i")} USING (g)"""


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By source of the documents: how many documents hold an item, and how many items they hold."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = p8_found(spark, sf_dir).join(docs.select("doc_id", "source"), "doc_id")
    return found.groupBy("source").agg(F.countDistinct("doc_id").alias("n_docs"), F.countDistinct("query_id").alias("n_items"))


def p8_report_sql() -> str:
    return f"SELECT source, count(DISTINCT doc_id) AS n_docs, count(DISTINCT query_id) AS n_items FROM ({p8_found_sql()}) JOIN documents USING (doc_id) GROUP BY source"
