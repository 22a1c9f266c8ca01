"""Lexical retrieval: BM25 with an inverted index of ordinary tables."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kervan.functions.storage import cut_lineage, new_path, spread, written
from kervan.functions.text import Tokenizer, index_tokens

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Queries and documents that are scored at a time; their product is the cells that a task holds (9 bytes each).
BLOCK_QUERIES, TILE_DOCS = 512, 8_192


def tokenized(docs: DataFrame, doc: str, text: str, stopwords: tuple[str, ...] = ()) -> DataFrame:
    """(doc, tokens) of every row; null text has no tokens."""
    return docs.select(F.col(doc).alias("doc"), index_tokens(F.coalesce(F.col(text), F.lit("")), stopwords).alias("tokens"))


def index(docs: DataFrame, doc: str = "doc_id", text: str = "text", stopwords: tuple[str, ...] = (), stem: Callable[[str], str] | None = None) -> DataFrame:
    """The index (doc, tokens, tf, dl) of documents: a row for each, with its different words, how often each occurs, and its length.

    Null and empty texts have no words but count as documents. Building it shuffles nothing.
    """
    kind = docs.schema[doc].dataType.simpleString()
    words_of = Tokenizer(stopwords, stem=stem)

    def apply(batches):
        for b in batches:
            counts = [Counter(words_of(t)) for t in b.column(1).to_pylist()]
            at = np.concatenate([[0], np.cumsum([len(n) for n in counts])]).astype(np.int32)
            words, tf = pa.array([w for n in counts for w in n], pa.string()), pa.array([x for n in counts for x in n.values()], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(at, words), pa.ListArray.from_arrays(at, tf), pa.array([n.total() for n in counts], pa.int32())], names=["doc", "tokens", "tf", "dl"])

    return spread(docs.select(F.col(doc).alias("doc"), F.col(text).alias("text"))).mapInArrow(apply, f"doc {kind}, tokens array<string>, tf array<int>, dl int")


def build_index(docs: DataFrame, **columns) -> DataFrame:
    """The index of documents, written once: document frequencies, lengths and term frequencies are all read from it."""
    return written(index(docs, **columns), "lexical")


def token_idf(indexed: DataFrame) -> DataFrame:
    """(token, df, idf, n_docs, avgdl) of an index: negative values are replaced by a share of the mean over all tokens.

    One aggregation gives all: each document adds its words and the empty word, which no document has, so that the empty
    word's row holds the number of documents (those without words too) and their length. Counts are combined before the shuffle.
    """
    counts = indexed.select("dl", F.explode(F.concat(F.array(F.lit("")), "tokens")).alias("token")).groupBy("token").agg(F.count("*").alias("df"), F.sum("dl").alias("length"))
    stats = counts.where("token = ''").select(F.col("df").alias("n_docs"), (F.col("length") / F.col("df")).alias("avgdl"))
    df = counts.where("token <> ''").select("token", "df").crossJoin(F.broadcast(stats))  # one row
    raw = df.withColumn("raw", F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw").alias("mean"))
    return raw.crossJoin(F.broadcast(mean)).select("token", "df", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"), "n_docs", "avgdl")


def query_terms(queries: DataFrame, query: str, text: str, stopwords: tuple[str, ...] = (), stem=None) -> DataFrame:
    """(query, token, times): repeated words count as often as they occur."""
    terms = index(queries.select(query, text), query, text, stopwords, stem).select("doc", F.explode(F.arrays_zip("tokens", "tf")).alias("x"))
    return terms.groupBy(F.col("doc").alias("query"), F.col("x.tokens").alias("token")).agg(F.sum("x.tf").alias("times"))


def matches(indexed: DataFrame, terms: DataFrame, k: int | None) -> DataFrame:
    """What queries (query, token, times) find in an index, as rows (query, doc, score, n_docs, n, low, high).

    A row with a doc is a match: of each task's tile of documents the k best of a query (and all that tie with the last), or all of them
    if k is None. A row without one has the number n of a tile's matches and their least and highest score. A document's
    words are in one row, so it is scored where it is read: matches of lower rank are never shuffled. The queries are a
    table in the shared folder, read in blocks of bounded size. Scores are rounded to nine digits, so that ties are ties.
    """
    spark = indexed.sparkSession
    path = new_path(spark, "terms")
    weighted = terms.join(token_idf(indexed), "token").groupBy("query", "n_docs", "avgdl").agg(F.collect_list(F.struct("token", (F.col("times") * F.col("idf")).alias("weight"))).alias("terms"))
    weighted.select("query", "n_docs", "avgdl", F.col("terms.token").alias("tokens"), F.col("terms.weight").alias("weights")).write.parquet(path)
    qt, dt = terms.schema["query"].dataType.simpleString(), indexed.schema["doc"].dataType.simpleString()

    def blocks():
        import pyarrow.parquet as pq
        from pyarrow import fs

        at, p = fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1)) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
        for name in sorted(x.path for x in at.get_file_info(fs.FileSelector(p)) if x.path.endswith(".parquet")):
            yield from pq.ParquetFile(at.open_input_file(name)).iter_batches(batch_size=BLOCK_QUERIES)

    def search(batches):
        held, n = [], 0
        for b in batches:
            for lo in range(0, b.num_rows, TILE_DOCS):
                held.append(b.slice(lo, TILE_DOCS))
                n += held[-1].num_rows
                if n >= TILE_DOCS:
                    yield from tile(held)
                    held, n = [], 0
        if n:
            yield from tile(held)

    def tile(held):
        t = pa.Table.from_batches(held).combine_chunks()
        docs, lists = t.column("doc").combine_chunks(), t.column("tokens").combine_chunks()
        words = lists.flatten()
        doc = np.repeat(np.arange(len(docs)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        tf, dl = t.column("tf").combine_chunks().flatten().to_numpy(zero_copy_only=False), t.column("dl").to_numpy()
        for b in blocks():
            asked, weight = b.column("tokens").flatten(), b.column("weights").flatten().to_numpy(zero_copy_only=False)
            of = np.repeat(np.arange(b.num_rows), pc.list_value_length(b.column("tokens")).to_numpy(zero_copy_only=False))
            vocabulary = pc.unique(asked)
            term = pc.index_in(asked, vocabulary).to_numpy(zero_copy_only=False)
            place = pc.fill_null(pc.index_in(words, vocabulary), -1).to_numpy(zero_copy_only=False)
            on = np.flatnonzero(place >= 0)
            on = on[np.argsort(place[on], kind="stable")]
            avgdl = float(b.column("avgdl")[0].as_py())
            impact = tf[on] * (K1 + 1) / (tf[on] + K1 * (1 - B + B * dl[doc[on]] / avgdl))
            first = np.searchsorted(place[on], np.arange(len(vocabulary) + 1))
            by_term = np.argsort(term, kind="stable")
            whose = np.searchsorted(term[by_term], np.arange(len(vocabulary) + 1))
            score, seen = np.zeros((b.num_rows, len(docs))), np.zeros((b.num_rows, len(docs)), dtype=bool)
            for v in range(len(vocabulary)):
                x, q = slice(first[v], first[v + 1]), by_term[whose[v] : whose[v + 1]]
                if first[v] < first[v + 1]:
                    cells = np.ix_(of[q], doc[on[x]])
                    score[cells] += weight[q][:, None] * impact[x][None, :]
                    seen[cells] = True
            score = np.round(score, 9)
            n = seen.sum(axis=1)
            low, high = np.where(seen, score, np.inf).min(axis=1), np.where(seen, score, -np.inf).max(axis=1)
            if k is None:
                i, j = np.nonzero(seen)
            else:
                kept = np.where(seen & (score > 0), score, -np.inf)
                least = np.partition(kept, len(docs) - k, axis=1)[:, len(docs) - k] if len(docs) > k else np.full(b.num_rows, -np.inf)
                i, j = np.nonzero((kept >= least[:, None]) & (kept > -np.inf))
            r = np.flatnonzero(n)
            null = pa.nulls(len(i), pa.int64()), pa.nulls(len(i), pa.float64()), pa.nulls(len(i), pa.float64())
            names = ["query", "doc", "score", "n_docs", "n", "low", "high"]
            yield pa.RecordBatch.from_arrays([b.column("query").take(pa.array(i)), docs.take(pa.array(j)), pa.array(score[i, j]), b.column("n_docs").take(pa.array(i)), *null], names=names)
            yield pa.RecordBatch.from_arrays([b.column("query").take(pa.array(r)), pa.nulls(len(r), docs.type), pa.nulls(len(r), pa.float64()), b.column("n_docs").take(pa.array(r)), pa.array(n[r]), pa.array(low[r]), pa.array(high[r])], names=names)

    return indexed.mapInArrow(search, f"query {qt}, doc {dt}, score double, n_docs bigint, n bigint, low double, high double")


def _found(docs, queries, k, doc="doc_id", text="text", query="query_id", query_text="query", stopwords=(), stem=None) -> DataFrame:
    return matches(build_index(docs, doc=doc, text=text, stopwords=stopwords, stem=stem), query_terms(queries, query, query_text, stopwords, stem), k)


def bm25_scores(docs: DataFrame, queries: DataFrame, **columns) -> DataFrame:
    """(query, doc, score, n_docs) of every document that shares a word with the query."""
    return _found(docs, queries, None, **columns).where("doc IS NOT NULL").select("query", "doc", "score", "n_docs")


def top(df: DataFrame, by: list[str], k: int, score: str = "score", tie: str | Column = "doc") -> DataFrame:
    """The k best rows of each group with their rank from 1; equal scores go by `tie`."""
    w = Window.partitionBy(*by).orderBy(F.col(score).desc(), tie)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def bm25_top(docs: DataFrame, queries: DataFrame, k: int = 10, **columns) -> DataFrame:
    """(query, doc, score, rank): the k best documents of each query with a positive score."""
    return top(_found(docs, queries, k, **columns).where("doc IS NOT NULL"), ["query"], k).select("query", "doc", "score", "rank")


def bm25_top_normed(docs: DataFrame, queries: DataFrame, k: int, **columns) -> DataFrame:
    """bm25_top with `norm`, the score moved to [0, 1] over all documents, those without a match (0) too; a flat query gives zeros."""
    found = cut_lineage(_found(docs, queries, k, **columns))  # k rows for each tile and query
    spread = found.where("doc IS NULL").groupBy("query").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.first("n_docs").alias("of"))
    rest = F.when(F.col("n") < F.col("of"), F.lit(0.0))
    spread = spread.select("query", F.least("low", rest).alias("low"), F.greatest("high", rest).alias("high"))
    norm = F.when(F.col("high") > F.col("low"), (F.col("score") - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(0.0)
    best = top(found.where("doc IS NOT NULL").select("query", "doc", "score"), ["query"], k)
    return best.join(spread, "query").select("query", "doc", "score", norm.alias("norm"), "rank")


def min_max_candidates(df: DataFrame, by: list[str], score: str, out: str) -> DataFrame:
    """Scores of a candidate list moved to [0, 1]; a flat list gives ones."""
    w = Window.partitionBy(*by)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return df.withColumn(out, F.when(high - low < 1e-9, 1.0).otherwise((F.col(score) - low) / (high - low)))
