"""Problem 5: records of the evaluation splits that are also, exactly or almost, in the training split.

Method: word n-gram hashes of evaluation and training records are partitioned together; hits of evaluation hashes
in training records give candidate pairs, for which the containment of the evaluation record in the training record and
their likeness are computed. The matching of hashes is that of overlap.py with two sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kervan.llm.near_duplicates import sets_sql
from kervan.llm.overlap import similar
from kervan.llm.util import cut_lineage

EVALUATION, TRAINING = ("kaggle", "test"), "train"
#: Pairs of copies of one text are all returned up to this many; beyond, each copy is paired with the other side's first.
FULL_PAIRS = 65_536


def split_of(column: str):
    """The split a value means: outer blanks and letter case do not count."""
    return F.lower(F.trim(F.regexp_replace(F.col(column), r"^[\s\x{A0}]+|[\s\x{A0}]+$", "")))


def cross_split(df: DataFrame, k: int = 5, t: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(members, links) of rows (query_id, question, context, split); see overlap.similar. Side 0 is evaluation, side 1 training.

    Questions are compared with questions, contexts with contexts. Null, empty and shorter texts and rows of other
    or null splits take no part; rows repeated under a query_id count once; empty tables give empty results.
    """
    sp = split_of("split")
    side = F.when(sp.isin(*EVALUATION), 0).when(sp == TRAINING, 1).cast("byte")
    rows = df.select(F.col("query_id").cast("string").alias("key"), side.alias("side"), F.explode(F.array(F.struct(F.lit(1).alias("field"), F.col("question").alias("text")), F.struct(F.lit(2).alias("field"), F.col("context").alias("text")))).alias("x"))
    return similar(rows.where("side IS NOT NULL AND x.text IS NOT NULL").select("key", "side", "x.field", "x.text"), k, t, two_sided=True)


def record_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """(eval_id, train_id, containment, likeness) of all linked records, each pair once with its best field.

    Where many copies of one stored text are on both sides, more than FULL_PAIRS pairs, each of them is paired with the first key
    of the other side's text only, so that no copies grow quadratically and no record is lost.
    """
    count = members.groupBy("cls", "txt", "side").agg(F.count("*").alias("m"), F.min("key").alias("head"))
    ev = members.where("side = 0").join(count.where("side = 0").drop("side"), ["cls", "txt"]).select(F.col("cls").alias("a"), F.col("txt").alias("txt_a"), F.col("key").alias("eval_id"), F.col("m").alias("m_a"), F.col("head").alias("head_a"))
    tr = members.where("side = 1").join(count.where("side = 1").drop("side"), ["cls", "txt"]).select(F.col("cls").alias("b"), F.col("txt").alias("txt_b"), F.col("key").alias("train_id"), F.col("m").alias("m_b"), F.col("head").alias("head_b"))
    small = f"m_a * m_b <= {FULL_PAIRS}"
    heads_a = ev.where("eval_id = head_a").select("a", "txt_a", F.col("eval_id").alias("only_a"), F.col("m_a"))
    heads_b = tr.where("train_id = head_b").select("b", "txt_b", F.col("train_id").alias("only_b"), F.col("m_b"))
    same = heads_a.join(heads_b, F.col("a") == F.col("b")).select("a", "txt_a", "b", "txt_b", "m_a", "m_b", "only_a", "only_b", F.lit(1.0).alias("containment"), F.lit(1.0).alias("likeness"))
    near = links.select("a", "b", (F.col("hits") / F.col("n_a")).alias("containment"), "likeness").join(heads_a, "a").join(heads_b, "b").select(*same.columns)
    linked = same.unionAll(near)
    e, r = ev.select("a", "txt_a", "eval_id"), tr.select("b", "txt_b", "train_id")
    out = ["eval_id", "train_id", "containment", "likeness"]
    full = linked.where(small).join(e, ["a", "txt_a"]).join(r, ["b", "txt_b"]).select(*out)
    star_a = linked.where(f"NOT ({small})").join(e, ["a", "txt_a"]).select("eval_id", F.col("only_b").alias("train_id"), "containment", "likeness")
    star_b = linked.where(f"NOT ({small})").join(r, ["b", "txt_b"]).select(F.col("only_a").alias("eval_id"), "train_id", "containment", "likeness")
    return full.unionAll(star_a).unionAll(star_b).where("eval_id <> train_id").groupBy("eval_id", "train_id").agg(F.max("containment").alias("containment"), F.max("likeness").alias("likeness"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    qa = spark.read.parquet(f"{sf_dir}/qa_examples.parquet")
    pairs = record_pairs(*cross_split(qa, k=3, t=0.5))
    return pairs.select(F.least("eval_id", "train_id").alias("query_a"), F.greatest("eval_id", "train_id").alias("query_b")).distinct()


def p5_found_sql() -> str:
    return f"""
        WITH q AS (SELECT DISTINCT query_id, lower(trim(split, chr(9) || chr(10) || chr(13) || ' ' || chr(160))) AS split, question, context FROM qa_examples),
             f AS (SELECT query_id, split, 1 AS field, {sets_sql("question", 3)} AS g FROM q WHERE question IS NOT NULL UNION ALL SELECT query_id, split, 2, {sets_sql("context", 3)} FROM q WHERE context IS NOT NULL),
             s AS (SELECT query_id, split, field, len(g) AS n, unnest(g) AS g FROM f),
             e AS (SELECT * FROM s WHERE split IN ('kaggle', 'test')), t AS (SELECT * FROM s WHERE split = 'train'),
             p AS (SELECT e.query_id AS a, t.query_id AS b, field, count(*) AS hits, any_value(e.n + t.n) AS n FROM e JOIN t USING (field, g) GROUP BY ALL)
        SELECT DISTINCT least(a, b) AS query_a, greatest(a, b) AS query_b FROM p WHERE hits >= 0.5 * (n - hits) AND a <> b"""


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By split and source of the evaluation record, at five words and 0.8: overlapping records, pairs, and how many are exact."""
    qa = spark.read.parquet(f"{sf_dir}/qa_examples.parquet")
    pairs = cut_lineage(record_pairs(*cross_split(qa)))
    about = qa.select("query_id", split_of("split").alias("split"), "source").groupBy("query_id").agg(F.min("split").alias("split"), F.min("source").alias("source"))
    return (
        pairs.join(about, F.col("eval_id") == F.col("query_id")).groupBy("split", "source")
        .agg(F.countDistinct("eval_id").alias("n_records"), F.count("*").alias("n_pairs"), F.count_if(F.col("likeness") == 1.0).alias("n_exact"))
    )
