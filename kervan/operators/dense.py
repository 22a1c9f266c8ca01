"""Dense retrieval: exact inner-product search over a table of vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kervan.functions.storage import Files, new_path
from kervan.operators.lexical import top

#: Numbers of a block of query vectors (8 bytes each in a task).
BLOCK_NUMBERS = 1_000_000
#: Vectors of a task that are multiplied at a time, and scores that a multiplication makes at most (8 bytes each).
TILE_ROWS, TILE_SCORES = 65_536, 4_000_000


def query_blocks(queries: DataFrame, numbers: int = BLOCK_NUMBERS) -> DataFrame:
    """(ids, matrix) of queries (query, qv): blocks of vectors, of bounded size."""
    kind = queries.schema["query"].dataType.simpleString()

    def apply(batches):
        for b in batches:
            if not b.num_rows:
                continue
            v = b.column(1).flatten().to_numpy(zero_copy_only=False).astype("<f8").reshape(b.num_rows, -1)
            step = max(1, numbers // v.shape[1])
            for lo in range(0, b.num_rows, step):
                part = v[lo : lo + step]
                yield pa.RecordBatch.from_arrays([pa.array([b.column(0).slice(lo, step).to_pylist()], pa.list_(b.column(0).type)), pa.array([part.tobytes()], pa.binary())], names=["ids", "matrix"])

    return queries.where("qv IS NOT NULL").select("query", "qv").mapInArrow(apply, f"ids array<{kind}>, matrix binary")


def best_of_tile(q: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, score) of each query's k best vectors of a tile, and all that tie with the last."""
    found = []
    step = max(1, TILE_SCORES // len(v))
    for lo in range(0, len(q), step):
        s = np.round(q[lo : lo + step] @ v.T, 9)
        if len(v) > k:
            least = np.partition(s, len(v) - k, axis=1)[:, len(v) - k]
            i, j = np.nonzero(s >= least[:, None])
        else:
            i, j = np.nonzero(s > -np.inf)
        found.append((i + lo, j, s[i, j]))
    return tuple(np.concatenate(x) for x in zip(*found))


def dense_top(queries: DataFrame, vectors: DataFrame, k: int = 10, same: bool = True) -> DataFrame:
    """(query, doc, score, rank): the k vectors of the highest inner product with each query vector, ties by doc.

    The queries are laid out as a table of blocks of bounded size in the shared folder. Each task goes through its vectors in
    tiles, reads block after block, multiplies the two and keeps each query's k best of the tile (and all that tie with the
    last), so one scan of the vectors serves any number of queries, and the shuffle moves k rows for each tile and query.
    Neither side is on the driver. Null vectors take no part. same=False leaves out the pair of a query and the
    document of the same id.
    """
    spark = vectors.sparkSession
    path = new_path(spark, "queries")
    query_blocks(queries).write.parquet(path)
    qt, dt = queries.schema["query"].dataType.simpleString(), vectors.schema["doc"].dataType.simpleString()
    want = k if same else k + 1

    def blocks():
        import pyarrow.parquet as pq
        from pyarrow import fs

        at, p = fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1)) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
        for name in sorted(x.path for x in at.get_file_info(fs.FileSelector(p)) if x.path.endswith(".parquet")):
            for b in pq.ParquetFile(at.open_input_file(name)).iter_batches(batch_size=1):
                for ids, m in zip(b.column("ids"), b.column("matrix").to_pylist()):
                    yield ids.values, np.frombuffer(m, dtype="<f8").reshape(len(ids), -1)

    def search(batches):
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= TILE_ROWS:
                yield from tile(held)
                held, n = [], 0
        if n:
            yield from tile(held)

    def tile(held):
        t = pa.Table.from_batches(held).combine_chunks()
        docs = t.column("doc").combine_chunks()
        v = t.column("dv").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(t.num_rows, -1)
        for ids, q in blocks():
            i, j, s = best_of_tile(q, v, want)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(i)), docs.take(pa.array(j)), pa.array(s)], names=["query", "doc", "score"])

    found = vectors.where("dv IS NOT NULL").select("doc", "dv").mapInArrow(search, f"query {qt}, doc {dt}, score double")
    return top(found if same else found.where(F.col("query") != F.col("doc")), ["query"], k)


def build_index(chunks: DataFrame, embedder, doc: str = "chunk_id", text: str = "text") -> DataFrame:
    """Chunks with `embedding`, the vector of their text as a passage."""
    return chunks.withColumn("embedding", embedder.column(F.coalesce(F.col(text), F.lit("")), is_query=False))


def as_vectors(index: DataFrame, doc: str = "chunk_id") -> DataFrame:
    return index.select(F.col(doc).alias("doc"), F.col("embedding").alias("dv"))


def as_queries(questions: DataFrame, embedder, query: str = "query_id", text: str = "query") -> DataFrame:
    return questions.select(F.col(query).alias("query"), embedder.column(F.coalesce(F.col(text), F.lit("")), is_query=True).alias("qv"))


def checked_index(vectors: DataFrame, dim: int) -> DataFrame:
    """The vectors, failing at run time on a null or one of another dimension."""
    return vectors.where(F.coalesce(F.assert_true((F.size("dv") == dim) & F.col("dv").isNotNull(), F.lit("vector of a wrong dimension")).isNull(), F.lit(True)))


def same_documents(lexical: DataFrame, dense: DataFrame) -> None:
    """An error unless both indexes (doc, …) cover the same documents."""
    only = lexical.select("doc").exceptAll(dense.select("doc")).unionAll(dense.select("doc").exceptAll(lexical.select("doc")))
    if first := only.first():
        raise ValueError(f"the lexical and the dense index differ, at {first.doc}")


def load_or_build(chunks: DataFrame, embedder, path: str, dim: int) -> tuple[DataFrame, float]:
    """(index, seconds it took to build it): the index table at the path, built and written first where there is none."""
    import time

    from kervan.sources import sinks

    spark, began = chunks.sparkSession, time.time()
    if not Files(spark).exists(path):
        sinks.save_index(build_index(chunks, embedder), path, dim)
    return sinks.load_index(spark, path), time.time() - began
