"""Problem 3: passages that share most of their content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kervan.llm.common_form import sql_form
from kervan.llm.overlap import similar
from kervan.llm.util import cut_lineage

#: Texts of more copies than this are linked through their first key only (star), not by all pairs of copies.
FULL_PAIRS = 256


def near_duplicates(df: DataFrame, key: str, text: str, k: int = 5, t: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(members, links): each key with its class of equal sequence sets, and pairs of classes of a likeness of at least t.

    Likeness: common different k-word sequences divided by those of either text. Null, empty and shorter texts
    have none and are no members; other columns are ignored; rows repeated under a key count once.
    """
    rows = df.select(F.col(f"`{key}`").cast("string").alias("key"), F.lit(0).cast("byte").alias("side"), F.lit(0).alias("field"), F.col(f"`{text}`").alias("text"))
    return similar(rows, k, t)


def key_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """(key_a, key_b), smaller first: all pairs of keys of linked classes and of one class. A stored text of more than FULL_PAIRS
    keys is replaced by its first key, to which each of its keys is paired: no link is lost, nor do its copies make a quadratic
    group. Different texts of one class are paired in full."""
    size = members.groupBy("cls", "txt").agg(F.count("*").alias("m"), F.min("key").alias("head"))
    of_text = members.select("key", "cls", "txt").join(size, ["cls", "txt"])
    star = of_text.where(f"m > {FULL_PAIRS} AND key <> head").select(F.col("head").alias("x"), F.col("key").alias("y"))
    full = of_text.where(f"m <= {FULL_PAIRS} OR key = head").select("key", "cls")
    a, b = full.alias("a"), full.alias("b")
    inner = a.join(b, F.expr("a.cls = b.cls AND a.key < b.key")).select(F.col("a.key").alias("x"), F.col("b.key").alias("y"))
    across = links.select("a", "b").join(full.select(F.col("cls").alias("a"), F.col("key").alias("x")), "a").join(full.select(F.col("cls").alias("b"), F.col("key").alias("y")), "b").select("x", "y")
    return inner.unionAll(star).unionAll(across).where("x <> y").select(F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b")).distinct()


def sets_sql(column: str, k: int) -> str:
    """The different sequences of k words of a text, as a DuckDB list."""
    words = f"regexp_extract_all(lower(translate({sql_form(column)}, 'İI', 'iı')), '[\\p{{L}}\\p{{N}}]+')"
    return f"(SELECT CASE WHEN len(w) >= {k} THEN list_distinct(list_transform(range(1, len(w) - {k - 2}), lambda i: array_to_string(w[i:i + {k - 1}], ' '))) ELSE [] END FROM (SELECT {words} AS w))"


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    cc = spark.read.parquet(f"{sf_dir}/corpus_chunks.parquet")
    members, links = near_duplicates(cc, "chunk_id", "text", k=3, t=0.6)
    return key_pairs(members, links).select(F.col("key_a").alias("chunk_a"), F.col("key_b").alias("chunk_b"))


def p3_found_sql() -> str:
    return f"""
        WITH t AS (SELECT chunk_id, {sets_sql("text", 3)} AS g FROM (SELECT DISTINCT chunk_id, text FROM corpus_chunks WHERE text IS NOT NULL)),
             s AS (SELECT chunk_id, len(g) AS n, unnest(g) AS g FROM t),
             p AS (SELECT a.chunk_id AS chunk_a, b.chunk_id AS chunk_b, count(*) AS hits, any_value(a.n + b.n) AS n FROM s a JOIN s b ON a.g = b.g AND a.chunk_id < b.chunk_id GROUP BY ALL)
        SELECT chunk_a, chunk_b FROM p WHERE hits >= 0.6 * (n - hits)"""


def p3_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each passage with its class at five words and 0.8, the number of copies and of other classes it is linked to."""
    cc = spark.read.parquet(f"{sf_dir}/corpus_chunks.parquet")
    members, links = near_duplicates(cc, "chunk_id", "text")
    links = cut_lineage(links)
    degree = links.select(F.explode(F.array("a", "b")).alias("cls")).groupBy("cls").agg(F.count("*").alias("n_links"))
    size = members.groupBy("cls").agg(F.count("*").alias("n_copies"), F.min("key").alias("class_id"))
    return members.join(size.join(degree, "cls", "left"), "cls").select(F.col("key").alias("chunk_id"), "class_id", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"))
