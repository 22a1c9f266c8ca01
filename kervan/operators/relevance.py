"""Which chunks are relevant to a question: a cascade of joins; the first strategy that finds any wins."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kervan.functions.storage import new_path
from kervan.operators.chunking import chunk

SOURCE_CAP, NEEDLE, LEAST_ANSWER = 20, 80, 40


def by_gold(qa: DataFrame, chunks: DataFrame) -> DataFrame:
    """0: gold ids that are chunks, in gold order, each once."""
    gold = qa.select("query_id", F.posexplode(F.array_distinct("gold_ids")).alias("pos", "chunk_id"))
    return gold.join(chunks.select("chunk_id"), "chunk_id").select("query_id", "chunk_id", F.lit(0).alias("strategy"), F.col("pos").cast("bigint"))


def by_hash(pieces: DataFrame, chunks: DataFrame) -> DataFrame:
    """1: chunks whose text is that of a piece of the question's context; pieces (query_id, piece)."""
    p = pieces.select("query_id", F.md5("piece").alias("h")).distinct()
    return p.join(chunks.select("chunk_id", "ord", F.md5("text").alias("h")), "h").select("query_id", "chunk_id", F.lit(1).alias("strategy"), F.col("ord").alias("pos"))


def context_pieces(rows: DataFrame) -> DataFrame:
    """(query_id, piece) of rows (query_id, context): contexts cut as the corpus was, so that a piece's hash can meet a chunk's."""
    return chunk(rows.select(F.col("query_id").alias("doc_id"), F.lit("").alias("source"), F.col("context").alias("text"))).select(F.col("doc_id").alias("query_id"), F.col("text").alias("piece"))


def by_document(qa: DataFrame, chunks: DataFrame) -> DataFrame:
    """2: chunks of the document with the question's id."""
    return qa.select("query_id").join(chunks.select("chunk_id", "ord", F.col("doc_id").alias("query_id")), "query_id").select("query_id", "chunk_id", F.lit(2).alias("strategy"), F.col("ord").alias("pos"))


#: Needles that an automaton holds at a time, and bytes of text that a task looks through at a time.
NEEDLES, TILE = 100_000, 64 << 20


def holding(docs: DataFrame, needles: DataFrame, text: str = "text") -> DataFrame:
    """docs (without the text) with `needle`, a row for each of the needles (needle) that the text holds.

    The needles are a table in the shared folder. Each task reads them in blocks of bounded size, and goes through its texts
    once for each block with an automaton of the block's needles: the time does not grow with the number of needles in a block.
    """
    spark = docs.sparkSession
    path = new_path(spark, "needles")
    needles.where("coalesce(needle, '') <> ''").select("needle").distinct().write.parquet(path)
    kept = [c for c in docs.columns if c != text]

    def blocks():
        import pyarrow.parquet as pq
        from pyarrow import fs

        at, p = fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1)) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
        for name in sorted(x.path for x in at.get_file_info(fs.FileSelector(p)) if x.path.endswith(".parquet")):
            for b in pq.ParquetFile(at.open_input_file(name)).iter_batches(batch_size=NEEDLES):
                yield finder(b.column(0).to_pylist())

    def search(batches):
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.nbytes
            if size >= TILE:
                yield from tile(held)
                held, size = [], 0
        if held:
            yield from tile(held)

    def tile(held):
        for find in blocks():
            for b in held:
                rows, words = [], []
                for i, t in enumerate(b.column(text).to_pylist()):
                    got = find(t) if t else ()
                    rows += [i] * len(got)
                    words += got
                at = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(at) for c in kept), pa.array(words, pa.string())], names=[*kept, "needle"])

    schema = docs.select(*kept, F.lit("").alias("needle")).schema
    return docs.select(*kept, text).mapInArrow(search, schema)


def finder(needles: list[str]):
    """A function that gives the needles that a text holds: an automaton, or, without its package, one needle after another."""
    try:
        import ahocorasick
    except ImportError:
        return lambda t: [n for n in needles if n in t]
    a = ahocorasick.Automaton()
    for n in needles:
        a.add_word(n, n)
    a.make_automaton()
    return lambda t: list({n for _, n in a.iter(t)})


def by_substring(qa: DataFrame, chunks: DataFrame) -> DataFrame:
    """3: chunks that hold the answer's first characters, of the question's source; of all sources if that is empty or unknown."""
    known = chunks.select("source").where("source IS NOT NULL").distinct().withColumn("known", F.lit(True))
    q = qa.where(F.length("answer") >= LEAST_ANSWER).select("query_id", F.coalesce("source", F.lit("")).alias("source"), F.substring(F.trim(F.lower("answer")), 1, NEEDLE).alias("needle"))
    q = q.join(known, "source", "left").withColumnRenamed("source", "own")
    hits = holding(chunks.select("chunk_id", "ord", "source", F.lower("text").alias("low")), q.select("needle"), "low")
    near = q.join(hits, "needle").where("known IS NULL OR own = source")
    return near.select("query_id", "chunk_id", F.lit(3).alias("strategy"), F.col("ord").alias("pos"))


def by_source(qa: DataFrame, chunks: DataFrame, cap: int = SOURCE_CAP) -> DataFrame:
    """4: the first chunks of the question's source."""
    w = Window.partitionBy("source").orderBy("ord")
    first = chunks.where("source IS NOT NULL").select("chunk_id", "source", "ord").withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= cap)
    return qa.select("query_id", "source").join(first, "source").select("query_id", "chunk_id", F.lit(4).alias("strategy"), F.col("ord").alias("pos"))


def cascade(qa: DataFrame, chunks: DataFrame, pieces: DataFrame) -> DataFrame:
    """(query_id, chunk_id, strategy, pos) of the first strategy that finds any chunk; questions without one have no row.

    qa: query_id, answer, source, gold_ids. A strategy only looks at the questions that the ones before left without a chunk.
    """
    found = None
    left = qa
    for step in (lambda q: by_gold(q, chunks), lambda q: by_hash(pieces.join(q.select("query_id"), "query_id", "left_semi"), chunks), lambda q: by_document(q, chunks), lambda q: by_substring(q, chunks), lambda q: by_source(q, chunks)):
        got = step(left)
        left = left.join(got.select("query_id"), "query_id", "left_anti")
        found = got if found is None else found.unionAll(got)
    return found
