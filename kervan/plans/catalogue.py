"""All queries of the engine's own operators over the test tables, with the SQL that gives the same rows.

Roles: corpus_chunks is the corpus, rag_eval the questions of retrieval, predictions the answers to be measured, qa_examples the
raw question-answer rows, embeddings the dense index (label is the relevance group), source_map the exam map.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kervan.functions import providers
from kervan.functions import text as T
from kervan.functions.storage import written
from kervan.operators import chunking, context, dedup, dense, fusion, graph, lexical, metrics, relevance, training
from kervan.plans import corpus, evaluation, stages
from kervan.sources import readers, sinks

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        _QUERIES[fn.__name__] = fn
        if sql:
            _SQL[fn.__name__] = sql
        return fn

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def r6(c) -> F.Column:
    return F.round(c, 6)


# Parts of SQL ------------------------------------------------------------------------------------------------------
LOW = "nfc_normalize(lower(translate({0}, 'İI', 'iı')))".format
TOK = lambda x: r"list_filter(string_split_regex(trim(regexp_replace(" + LOW(x) + r", '[^\p{L}\p{N}_\s]', ' ', 'g'), ' '), '\s+'), lambda t: length(t) >= 2)"
WORDS = lambda x: r"list_filter(string_split_regex(trim(" + LOW(x) + r", ' '), '\s+'), lambda t: t <> '')"
UNCITED = lambda x: rf"trim(regexp_replace({x}, '\[\s*[Kk][Aa][Yy][Nn][Aa][Kk]\s+\d+\s*\]', '', 'g'), ' ')"
CH = "ch AS (SELECT chunk_id, doc_id, coalesce(text, '') AS text, source, ord FROM corpus_chunks QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY ord) = 1)"
BM = f"""{CH},
    tok AS (SELECT chunk_id AS doc, {TOK("text")} AS w FROM ch),
    st AS (SELECT count(*) AS n_docs, avg(len(w)) AS avgdl FROM tok),
    post AS (SELECT doc, token, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc, unnest(w) AS token, len(w) AS dl FROM tok) GROUP BY doc, token),
    raw AS (SELECT token, count(*) AS df, ln(any_value(n_docs) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM post, st GROUP BY token),
    idf AS (SELECT token, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
    qt AS (SELECT query, token, count(*) AS times FROM (SELECT query_id AS query, unnest({TOK("query")}) AS token FROM rag_eval) GROUP BY query, token),
    bm AS (SELECT query, doc, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9) AS score FROM qt JOIN idf USING (token) JOIN post USING (token), st GROUP BY query, doc),
    bmtop AS (SELECT query, doc, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM bm WHERE score > 0 QUALIFY rank <= 50)"""
DQ = "(SELECT vec_id AS query, embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id % 50 = 0)"
DENSE = f"""dn AS (SELECT q.query, e.vec_id AS doc, e.label, round(list_dot_product(q.qv, e.embedding::DOUBLE[]), 9) AS score FROM {DQ} q, embeddings e),
    dntop AS (SELECT query, doc, label, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM dn QUALIFY rank <= 50)"""


def _chunks(spark, d):
    return dedup.chunk_table(_t(spark, d, "corpus_chunks"))


def _questions(spark, d):
    return _t(spark, d, "rag_eval")


def _lexical(spark, d):
    return stages.lexical_candidates(_chunks(spark, d), _questions(spark, d), doc="chunk_id")


def _vectors(spark, d):
    e = _t(spark, d, "embeddings")
    return e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("qv")), e.select(F.col("vec_id").alias("doc"), F.col("embedding").alias("dv"))


def _qa(spark, d):
    """Examples once each: of rows delivered twice the first by added_at."""
    q = _t(spark, d, "qa_examples")
    return dedup.first_rows(q, ["query_id"], F.coalesce("added_at", F.lit("1900-01-01").cast("timestamp")), F.col("split")).withColumn("split", F.lower(F.trim("split")))


QA = "qa AS (SELECT * REPLACE (lower(trim(split, ' ')) AS split) FROM qa_examples QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY coalesce(added_at, TIMESTAMP '1900-01-01'), qa_examples.split) = 1)"


# Sources, filters, de-duplication -----------------------------------------------------------------------------------
@query("""SELECT lower(trim(split, ' ')) AS split, count(*) AS n_rows, count(CASE WHEN context IS NULL THEN 1 END) AS n_null_context, count(CASE WHEN coalesce(answer, '') = '' THEN 1 END) AS n_empty_answer
          FROM qa_examples GROUP BY 1""")
def q_validate_summary(spark, d):
    return readers.validate(_t(spark, d, "qa_examples").withColumn("split", F.lower(F.trim("split"))))


@query("""SELECT count(*) AS n, round(avg(l), 6) AS mean, round(stddev_samp(l), 6) AS std, min(l) AS low, round(quantile_cont(l::DOUBLE, 0.25), 6) AS q25,
          round(quantile_cont(l::DOUBLE, 0.5), 6) AS q50, round(quantile_cont(l::DOUBLE, 0.75), 6) AS q75, max(l) AS high FROM (SELECT length(context) AS l FROM qa_examples WHERE context IS NOT NULL)""")
def q_length_describe(spark, d):
    n = _t(spark, d, "qa_examples").where("context IS NOT NULL").select(F.length("context").cast("bigint").alias("l"))
    return n.agg(F.count("*").alias("n"), r6(F.avg("l")).alias("mean"), r6(F.stddev_samp("l")).alias("std"), F.min("l").alias("low"), *[r6(F.percentile("l", F.lit(p))).alias(c) for c, p in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75))], F.max("l").alias("high"))


@query("""SELECT chunk_id, regexp_replace(chunk_id, '_\\d+$', '') AS doc_id, coalesce(nullif(source, ''), '') AS source, coalesce(nullif(char_len::VARCHAR, '')::DOUBLE::INT, length(text))::INT AS char_len
          FROM (SELECT chunk_id, source, char_len, coalesce(text, '') AS text FROM corpus_chunks)""")
def q_corpus_normalize(spark, d):
    """The corpus in a foreign shape (id, text, metadata) read as chunks again."""
    c = _t(spark, d, "corpus_chunks")
    foreign = c.select(F.col("chunk_id").alias("id"), "text", F.struct("source", F.col("char_len").alias("chunk_char_count")).alias("metadata"), "ord")
    return readers.normalized_corpus(foreign).select("chunk_id", "doc_id", "source", F.coalesce("char_len", F.length("text")).alias("char_len"))


@query(f"""WITH {QA}, n AS (SELECT *, row_number() OVER (ORDER BY query_id) - 1 AS i FROM qa WHERE split = 'test'),
           m AS (SELECT source, min(kaynak) AS kaynak FROM source_map WHERE source IS NOT NULL GROUP BY source),
           k AS (SELECT kaynak, min(source) AS source FROM source_map WHERE source IS NOT NULL GROUP BY kaynak)
           SELECT printf('hmgs_%04d', i) AS query_id, question, answer, k.source FROM (SELECT n.i, n.question, n.answer, m.kaynak FROM n LEFT JOIN m USING (source)) x JOIN k USING (kaynak)
           WHERE NOT regexp_matches(trim(answer, ' '), '^((Yalnız|Sadece)\\s+(III|II|IV|I|V)\\b|(III|II|IV|I|V)(\\s*,\\s*(III|II|IV|I|V))+|(III|II|IV|I|V)\\s+ve\\s+(III|II|IV|I|V))')""")
def q_source_map_filter(spark, d):
    """Test examples as exam rows: numbered first, then without option answers and without rows of no source."""
    m = _t(spark, d, "source_map")
    by_source = m.where("source IS NOT NULL").groupBy("source").agg(F.min("kaynak").alias("kaynak"))
    rows = _qa(spark, d).where("split = 'test'").join(by_source, "source", "left").select(F.col("question").alias("soru"), F.col("answer").alias("cevap"), "kaynak", F.col("query_id").alias("ord"))
    rows = rows.withColumn("kaynak", F.coalesce("kaynak", F.lit("")))
    return readers.exam_questions(rows, m)


@query(f"WITH {CH} SELECT chunk_id, len(w) AS n_tokens, md5(array_to_string(w, ' ')) AS tokens_md5 FROM (SELECT chunk_id, {TOK('text')} AS w FROM ch)")
def q_normalize_tokens(spark, d):
    t = lexical.tokenized(_chunks(spark, d), "chunk_id", "text")
    return t.select(F.col("doc").alias("chunk_id"), F.size("tokens").cast("bigint").alias("n_tokens"), F.md5(F.array_join("tokens", " ")).alias("tokens_md5"))


@query(f"WITH {CH} SELECT chunk_id, md5(text) AS text_md5 FROM ch QUALIFY row_number() OVER (PARTITION BY md5(text) ORDER BY ord) = 1")
def q_text_dedup(spark, d):
    return dedup.text_dedup(_chunks(spark, d)).select("chunk_id", F.md5("text").alias("text_md5"))


@query(f"""WITH {QA}, b AS (SELECT *, CASE WHEN split = 'train' THEN 0 ELSE 1 END AS src, trim(regexp_replace(lower(nfc_normalize(question)), '\\s+', ' ', 'g'), ' ') AS key FROM qa
             WHERE coalesce(question, '') <> '' AND coalesce(answer, '') <> ''),
           k AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY key ORDER BY src, query_id) = 1)
           SELECT (SELECT count(*) FROM b WHERE src = 0) AS n_first, (SELECT count(*) FROM b WHERE src = 1) AS n_more, count(CASE WHEN src = 1 THEN 1 END) AS n_added, (SELECT count(*) FROM b) - count(*) AS n_duplicates, count(*) AS n_final FROM k""")
def q_question_merge_dedup(spark, d):
    qa = _qa(spark, d)
    a, b = qa.where("split = 'train'"), qa.where("split <> 'train'")
    kept = dedup.merge_rows(a, b, "question", "query_id").agg(F.count_if(F.col("src") == 1).alias("n_added"), F.count("*").alias("n_final"))
    full = "coalesce(question, '') <> '' AND coalesce(answer, '') <> ''"
    n = a.where(full).agg(F.count("*").alias("n_first")).crossJoin(b.where(full).agg(F.count("*").alias("n_more")))
    return n.crossJoin(kept).select("n_first", "n_more", "n_added", (F.col("n_first") + F.col("n_more") - F.col("n_final")).alias("n_duplicates"), "n_final")


@query(f"""WITH {QA}, h AS (SELECT *, CASE WHEN coalesce(context, '') <> '' THEN md5(context) END AS m FROM qa WHERE split = 'kaggle'),
           l AS (SELECT DISTINCT m FROM h WHERE m IS NOT NULL ORDER BY m DESC LIMIT 300)
           SELECT query_id, CASE WHEN m IN (SELECT m FROM l) THEN 'eval' ELSE 'corpus' END AS part FROM h""")
def q_holdout_split(spark, d):
    held, rest = dedup.holdout(_qa(spark, d).where("split = 'kaggle'"), "context")
    return held.select("query_id", F.lit("eval").alias("part")).unionAll(rest.select("query_id", F.lit("corpus").alias("part")))


@query("""SELECT doc_id, (s / 1220)::INT AS idx, s::INT AS start, md5(substr(text, s + 1, 1400)) AS text_md5, length(substr(text, s + 1, 1400)) AS n
          FROM (SELECT doc_id, text, unnest(range(0, length(text), 1220)) AS s FROM documents WHERE length(text) >= 180) WHERE length(substr(text, s + 1, 1400)) >= 180""")
def q_chunk_fixed(spark, d):
    w = chunking.fixed_windows(_t(spark, d, "documents"))
    return w.select("doc_id", "idx", "start", F.md5("text").alias("text_md5"), F.length("text").cast("bigint").alias("n"))


@query()
def q_chunk_recursive(spark, d):
    return chunking.chunk(_t(spark, d, "documents"), articles=False)


@query()
def q_chunk_articles(spark, d):
    return chunking.chunk(_t(spark, d, "documents"))


@query(f"""WITH {QA}, done AS (SELECT query_id FROM predictions WHERE error IS NULL)
           SELECT query_id, question FROM qa WHERE split = 'test' AND query_id NOT IN (SELECT query_id FROM done)""")
def q_resume_anti(spark, d):
    valid, _ = readers.split_errors(_t(spark, d, "predictions"))
    return dedup.unseen(_qa(spark, d).where("split = 'test'"), valid, "query_id").select("query_id", "question")


# Lexical and dense retrieval, fusion ----------------------------------------------------------------------------------
@query(f"WITH {BM} SELECT token, df, round(idf, 6) AS idf FROM idf")
def q_bm25_stats(spark, d):
    postings = lexical.index(_chunks(spark, d), "chunk_id")
    return lexical.token_idf(postings).select("token", "df", r6("idf").alias("idf"))


@query(f"WITH {BM} SELECT query AS query_id, doc AS chunk_id, score, rank FROM bmtop WHERE rank <= 10")
def q_bm25_topk(spark, d):
    got = lexical.bm25_top(_chunks(spark, d), _questions(spark, d), doc="chunk_id")
    return got.select(F.col("query").alias("query_id"), F.col("doc").alias("chunk_id"), "score", F.col("rank").cast("bigint").alias("rank"))


@query(f"""WITH {BM}, x AS (SELECT query, doc, score, CASE WHEN count(*) OVER p < n_docs THEN 0 END AS z, min(score) OVER p AS lo, max(score) OVER p AS hi FROM bm, st WINDOW p AS (PARTITION BY query)),
           y AS (SELECT query, doc, score, least(lo, z) AS lo, greatest(hi, z) AS hi FROM x),
           n AS (SELECT query, doc, CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 0 END AS norm, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM y WHERE score > 0 QUALIFY rank <= 50)
           SELECT query AS query_id, doc AS chunk_id, round(norm, 6) AS norm, rank FROM n""")
def q_bm25_minmax(spark, d):
    return _lexical(spark, d).select(F.col("query").alias("query_id"), F.col("doc").alias("chunk_id"), r6("norm").alias("norm"), F.col("rank").cast("bigint").alias("rank"))


@query(f"WITH {DENSE} SELECT query, doc, score, rank FROM dntop WHERE rank <= 10")
def q_dense_topk(spark, d):
    got = dense.dense_top(*_vectors(spark, d))
    return got.select("query", "doc", "score", F.col("rank").cast("bigint").alias("rank"))


def _joined(spark, d):
    """All documents and all questions, with vectors of the default embedder: lexical and dense candidates of one corpus."""
    embedder = providers.HashEmbedder()
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text")
    qs = _questions(spark, d).select("query_id", "query")
    lex = stages.lexical_candidates(docs, qs, doc="doc")
    den = stages.dense_candidates(dense.as_queries(qs, embedder), dense.as_vectors(dense.build_index(docs, embedder, "doc"), "doc"))
    return docs, qs, lex, den


EMBED = lambda w: f"(SELECT list_transform(v, lambda x: (CASE WHEN n > 0 THEN x / sqrt(n) ELSE 0 END)::FLOAT::DOUBLE) FROM (SELECT v, list_sum(list_transform(v, lambda x: x * x))::DOUBLE AS n FROM (SELECT list_transform(range(0, 64), lambda p: len(list_filter(h, lambda x: x = p))) AS v FROM (SELECT list_transform({w}, lambda t: ('0x' || left(md5(t), 8))::BIGINT % 64) AS h))))"
LEXICAL = """st AS (SELECT count(*) AS n_docs, avg(len(w)) AS avgdl FROM tok),
    post AS (SELECT doc, token, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc, unnest(w) AS token, len(w) AS dl FROM tok) GROUP BY doc, token),
    raw AS (SELECT token, ln(any_value(n_docs) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM post, st GROUP BY token),
    idf AS (SELECT token, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
    qt AS (SELECT query, token, count(*) AS times FROM (SELECT query_id AS query, unnest(qw) AS token FROM jq) GROUP BY query, token),
    bm AS (SELECT query, doc, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9) AS score FROM qt JOIN idf USING (token) JOIN post USING (token), st GROUP BY query, doc),
    x AS (SELECT query, doc, score, CASE WHEN count(*) OVER p < n_docs THEN 0 END AS z, min(score) OVER p AS lo, max(score) OVER p AS hi FROM bm, st WINDOW p AS (PARTITION BY query)),
    lex AS (SELECT query, doc, score, CASE WHEN greatest(hi, z) > least(lo, z) THEN (score - least(lo, z)) / (greatest(hi, z) - least(lo, z)) ELSE 0 END AS norm, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank
            FROM x WHERE score > 0 QUALIFY rank <= 50),
    den AS (SELECT query_id AS query, doc, round(list_dot_product(qv, dv), 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(list_dot_product(qv, dv), 9) DESC, doc) AS rank FROM jq, jd QUALIFY rank <= 50),
    rrf AS (SELECT query, doc, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM
            (SELECT query, doc, round(sum(1.0 / (60 + rank)::DOUBLE), 9) AS score FROM (SELECT query, doc, rank FROM den UNION ALL SELECT query, doc, rank FROM lex) GROUP BY query, doc) QUALIFY rank <= 50)"""
JOINED = f"""tok AS MATERIALIZED (SELECT doc_id AS doc, {TOK("coalesce(text, '')")} AS w FROM documents),
    jd AS MATERIALIZED (SELECT doc, {EMBED("w")} AS dv FROM tok),
    jq AS MATERIALIZED (SELECT query_id, qw, {EMBED("qw")} AS qv FROM (SELECT query_id, {TOK("coalesce(query, '')")} AS qw FROM rag_eval)),
    {LEXICAL}"""
HYBRID = "(SELECT query, doc, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM (SELECT query, doc, round(sum(part), 12) AS score FROM (SELECT query, doc, {a} * score AS part FROM den UNION ALL SELECT query, doc, {b} * norm FROM lex) GROUP BY query, doc) QUALIFY rank <= {k})".format


def _run(df: DataFrame) -> DataFrame:
    return df.select(F.col("query").alias("query_id"), "doc", "score", F.col("rank").cast("bigint").alias("rank"))


@query(f"WITH {JOINED} SELECT query AS query_id, doc, score, rank FROM {HYBRID(a='0.5::DOUBLE', b='0.5::DOUBLE', k=10)}")
def q_hybrid_topk(spark, d):
    _, _, lex, den = _joined(spark, d)
    return _run(fusion.linear(den, lex))


@query(f"WITH {JOINED} SELECT query AS query_id, doc, score, rank FROM rrf WHERE rank <= 10")
def q_rrf_topk(spark, d):
    _, _, lex, den = _joined(spark, d)
    return _run(fusion.reciprocal_rank([den, lex]))


@query(f"""WITH {DENSE}, c AS (SELECT t.query, t.doc, list_dot_product(q.qv[1:32], e.embedding[1:32]::DOUBLE[]) AS a, list_dot_product(q.qv[33:48], e.embedding[33:48]::DOUBLE[]) AS b, list_dot_product(q.qv[49:64], e.embedding[49:64]::DOUBLE[]) AS c
             FROM dntop t JOIN {DQ} q ON q.query = t.query JOIN embeddings e ON e.vec_id = t.doc),
           n AS (SELECT query, doc, {", ".join(f"CASE WHEN max({x}) OVER p - min({x}) OVER p < 1e-9 THEN 1 ELSE ({x} - min({x}) OVER p) / (max({x}) OVER p - min({x}) OVER p) END AS {x}" for x in "abc")} FROM c WINDOW p AS (PARTITION BY query)),
           s AS (SELECT query, doc, round((a + b + c) / 3, 9) AS score FROM n)
           SELECT query, doc, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM s QUALIFY rank <= 10""")
def q_multivector_minmax(spark, d):
    """Three parts of the vectors as three kinds of score, each moved to [0, 1] within the 50 dense candidates."""
    qs, vs = _vectors(spark, d)
    c = dense.dense_top(qs, vs, 50).select("query", "doc").join(qs, "query").join(vs, "doc")
    part = lambda a, n: T.dot(F.slice("qv", a, n), F.slice("dv", a, n))
    got = fusion.weighted_min_max(c.select("query", "doc", part(1, 32).alias("a"), part(33, 16).alias("b"), part(49, 16).alias("c")), {"a": 1, "b": 1, "c": 1})
    return got.select("query", "doc", "score", F.col("rank").cast("bigint").alias("rank"))


OVERLAP = lambda a, b: f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0 ELSE len(list_intersect(list_distinct({a}), list_distinct({b})))::DOUBLE / least(len(list_distinct({a})), len(list_distinct({b}))) END"


@query(f"""WITH {BM}, c AS (SELECT b.query, b.doc, {TOK("r.query")} AS qw, t.w FROM bmtop b JOIN rag_eval r ON r.query_id = b.query JOIN tok t ON t.doc = b.doc),
           s AS (SELECT query, doc, round({OVERLAP("qw", "w")}, 9) AS score FROM c)
           SELECT query AS query_id, doc, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM s QUALIFY rank <= 10""")
def q_rerank_overlap(spark, d):
    c = _lexical(spark, d).select("query", "doc").join(_chunks(spark, d).select(F.col("chunk_id").alias("doc"), F.col("text").alias("doc_text")), "doc")
    return _run(fusion.rerank(c.join(_questions(spark, d).select(F.col("query_id").alias("query"), F.col("query").alias("query_text")), "query"), providers.pair_score))


RERANKED = lambda src: f"(SELECT query, doc, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM (SELECT c.query, c.doc, round({OVERLAP('qw', 't.w')}, 9) AS score FROM {src} c JOIN jq q ON q.query_id = c.query JOIN tok t ON t.doc = c.doc) QUALIFY rank <= 10)"


@query(f"""WITH {JOINED}, m AS (
           SELECT 'dense' AS mode, query, doc, score, rank FROM den WHERE rank <= 10
           UNION ALL SELECT 'hybrid', * FROM {HYBRID(a='0.7::DOUBLE', b='0.3::DOUBLE', k=10)}
           UNION ALL SELECT 'rrf', * FROM rrf WHERE rank <= 10
           UNION ALL SELECT 'dense_rerank', * FROM {RERANKED("den")}
           UNION ALL SELECT 'hybrid_rerank', * FROM {RERANKED(HYBRID(a='0.5::DOUBLE', b='0.5::DOUBLE', k=50))}
           UNION ALL SELECT 'rrf_rerank', * FROM {RERANKED("rrf")})
           SELECT mode, query AS query_id, doc, score, rank FROM m""")
def q_modes_long(spark, d):
    docs, qs, lex, den = _joined(spark, d)
    lex, den = written(lex, "lexical"), written(den, "dense")  # six modes read them
    texts, questions = docs.select("doc", F.col("text").alias("doc_text")), qs.select(F.col("query_id").alias("query"), F.col("query").alias("query_text"))
    modes = {"dense": ("dense", False, 0.5), "hybrid": ("hybrid", False, 0.7), "rrf": ("rrf", False, 0.5), "dense_rerank": ("dense", True, 0.5), "hybrid_rerank": ("hybrid", True, 0.5), "rrf_rerank": ("rrf", True, 0.5)}
    out = None
    for name, (how, again, alpha) in modes.items():
        got = stages.retrieve(stages.Stage(name, how, rerank=again, alpha=alpha), den, lex, texts, questions)
        got = _run(got).withColumn("mode", F.lit(name))
        out = got if out is None else out.unionByName(got)
    return out


# Relevance and retrieval metrics --------------------------------------------------------------------------------------
def _relevance_inputs(spark, d):
    qa = _questions(spark, d).select("query_id", F.col("gold_answer_extract").alias("answer"), "source", F.coalesce("gold_chunk_ids", F.array().cast("array<string>")).alias("gold_ids"))
    return qa, _chunks(spark, d)


REL = f"""{CH}, q AS (SELECT query_id, query AS question, gold_answer_extract AS answer, source, coalesce(gold_chunk_ids, []) AS gold FROM rag_eval),
    g0 AS (SELECT query_id, chunk_id, 0 AS strategy FROM (SELECT DISTINCT query_id, unnest(gold) AS chunk_id FROM q) JOIN ch USING (chunk_id)),
    g3 AS (SELECT query_id, chunk_id, 3 AS strategy FROM q JOIN ch ON contains(lower(ch.text), left(trim(lower(q.answer), ' '), 80)) AND (q.source = ch.source OR coalesce(q.source, '') NOT IN (SELECT source FROM ch WHERE source IS NOT NULL)) WHERE length(q.answer) >= 40),
    g4 AS (SELECT query_id, chunk_id, 4 AS strategy FROM q JOIN (SELECT chunk_id, source FROM ch WHERE source IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source ORDER BY ord) <= 20) c ON c.source = q.source)"""
#: Contexts of the test tables have no more characters than a chunk may have, so each is one piece, or, cut by articles, several.
PIECES = """pc AS (SELECT query_id, trim(unnest(string_split_regex(regexp_replace(context, '(?im)^(\\s*MADDE\\s+\\d)', chr(1) || '\\1', 'g'), chr(1))), ' ' || chr(9) || chr(10) || chr(13)) AS piece FROM qa WHERE length(context) BETWEEN 180 AND 1400)"""
HASHED = f"SELECT DISTINCT query_id, chunk_id FROM (SELECT query_id, md5(piece) AS h FROM pc WHERE length(piece) >= 180) JOIN (SELECT chunk_id, md5(text) AS h FROM ch) USING (h)"


@query(f"WITH {REL} SELECT query_id, chunk_id FROM g0")
def q_relevance_gold(spark, d):
    return relevance.by_gold(*_relevance_inputs(spark, d)).select("query_id", "chunk_id")


@query(f"WITH {CH}, {QA}, {PIECES} {HASHED}")
def q_relevance_hash(spark, d):
    """Contexts, cut as the corpus is, against the chunks' texts."""
    pieces = relevance.context_pieces(_qa(spark, d).where("coalesce(context, '') <> ''").select("query_id", "context"))
    return relevance.by_hash(pieces, _chunks(spark, d)).select("query_id", "chunk_id").distinct()


@query(f"WITH {CH}, dc AS (SELECT DISTINCT regexp_extract(g, '_([a-z]+\\d+)_\\d+$', 1) AS doc_id FROM (SELECT unnest(gold_chunk_ids) AS g FROM rag_eval)) SELECT doc_id AS query_id, chunk_id FROM dc JOIN ch USING (doc_id)")
def q_relevance_docid(spark, d):
    """Document ids taken as question ids."""
    ids = _questions(spark, d).select(F.explode("gold_chunk_ids").alias("g")).select(F.regexp_extract("g", r"_([a-z]+\d+)_\d+$", 1).alias("query_id")).distinct()
    return relevance.by_document(ids, _chunks(spark, d)).select("query_id", "chunk_id")


@query(f"WITH {REL} SELECT query_id, chunk_id FROM g3")
def q_relevance_substring(spark, d):
    return relevance.by_substring(*_relevance_inputs(spark, d)).select("query_id", "chunk_id")


@query(f"WITH {REL} SELECT query_id, chunk_id FROM g4")
def q_relevance_source20(spark, d):
    return relevance.by_source(*_relevance_inputs(spark, d)).select("query_id", "chunk_id")


@query(f"""WITH {CH}, {QA}, {PIECES}, q AS (SELECT query_id, coalesce(answer, '') AS answer, source FROM qa WHERE split = 'kaggle'),
           g1 AS (SELECT query_id, chunk_id, 1 AS strategy FROM ({HASHED}) JOIN q USING (query_id)),
           g2 AS (SELECT query_id, chunk_id, 2 AS strategy FROM q JOIN ch ON ch.doc_id = q.query_id),
           k AS (SELECT DISTINCT source FROM ch WHERE source IS NOT NULL),
           n AS (SELECT query_id, coalesce(source, '') AS source, left(trim(lower(answer), ' '), 80) AS needle FROM q WHERE length(answer) >= 40 AND query_id NOT IN (SELECT query_id FROM g1)),
           g3 AS (SELECT query_id, chunk_id, 3 AS strategy FROM n JOIN ch ON contains(lower(ch.text), needle) AND (n.source = ch.source OR n.source NOT IN (SELECT source FROM k))),
           g4 AS (SELECT query_id, chunk_id, 4 AS strategy FROM q JOIN (SELECT chunk_id, source FROM ch WHERE source IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source ORDER BY ord) <= 20) c ON c.source = q.source),
           u AS (SELECT * FROM g1 UNION ALL SELECT * FROM g2 UNION ALL SELECT * FROM g3 UNION ALL SELECT * FROM g4)
           SELECT query_id, chunk_id, strategy FROM u QUALIFY strategy = min(strategy) OVER (PARTITION BY query_id)""")
def q_relevance_cascade(spark, d):
    """All strategies for the examples of split kaggle: by their contexts, their ids, their answers and their sources."""
    qa = _qa(spark, d).where("split = 'kaggle'")
    rows = qa.select("query_id", F.coalesce("answer", F.lit("")).alias("answer"), "source", F.array().cast("array<string>").alias("gold_ids"))
    pieces = relevance.context_pieces(qa.where("coalesce(context, '') <> ''").select("query_id", "context"))
    return relevance.cascade(rows, _chunks(spark, d), pieces).select("query_id", "chunk_id", "strategy")


@query(f"""WITH {REL}, u AS (SELECT * FROM g0 UNION ALL SELECT * FROM g3 UNION ALL SELECT * FROM g4)
           SELECT query_id, chunk_id, strategy FROM u QUALIFY strategy = min(strategy) OVER (PARTITION BY query_id)""")
def q_relevance_gold_cascade(spark, d):
    """The cascade for questions with gold ids and without contexts."""
    qa, ch = _relevance_inputs(spark, d)
    return relevance.cascade(qa, ch, spark.createDataFrame([], "query_id string, piece string")).select("query_id", "chunk_id", "strategy")


METRIC = """
    per AS (SELECT r.query, count(*) AS n_rel, min(b.rank) AS first, count(CASE WHEN b.rank <= 5 THEN 1 END) AS h5, count(CASE WHEN b.rank <= 10 THEN 1 END) AS h10, coalesce(sum(CASE WHEN b.rank <= 10 THEN 1 / log2(b.rank + 1) END), 0) AS dcg
            FROM rel r LEFT JOIN run b ON b.query = r.query AND b.doc = r.doc GROUP BY r.query),
    m AS (SELECT *, (SELECT sum(1 / log2(i + 1)) FROM range(1, 11) t(i) WHERE i <= n_rel) AS ideal FROM per)
    SELECT round(avg(h5 / n_rel), 6) AS recall_at_5, round(avg(h10 / n_rel), 6) AS recall_at_10, round(avg(coalesce(1 / first, 0)), 6) AS mrr, round(avg(dcg / ideal), 6) AS ndcg_at_10, round(avg((h5 > 0)::INT), 6) AS hit_at_5,
           round(avg((h10 > 0)::INT), 6) AS hit_at_10, round(avg(h5 / least(5, n_rel)), 6) AS capped_recall_at_5, round(avg(h10 / least(10, n_rel)), 6) AS capped_recall_at_10, round(avg(h5 / 5), 6) AS precision_at_5, round(avg(h10 / 10), 6) AS precision_at_10,
           count(*) AS num_queries, {total} AS total_queries FROM m"""


@query(f"WITH {BM}, rel AS (SELECT DISTINCT query_id AS query, g AS doc FROM (SELECT query_id, unnest(gold_chunk_ids) AS g FROM rag_eval) WHERE g IN (SELECT chunk_id FROM ch)), run AS (SELECT query, doc, rank FROM bmtop WHERE rank <= 10), {METRIC.format(total='(SELECT count(DISTINCT query_id) FROM rag_eval)')}")
def q_retrieval_metrics(spark, d):
    qa, ch = _relevance_inputs(spark, d)
    run = lexical.bm25_top(ch, _questions(spark, d), doc="chunk_id")
    rel = relevance.by_gold(qa, ch).select(F.col("query_id").alias("query"), F.col("chunk_id").alias("doc"))
    return metrics.retrieval_metrics(run, rel, qa.select(F.col("query_id").alias("query")))


@query(f"WITH {DENSE}, rel AS (SELECT q.vec_id AS query, e.vec_id AS doc FROM embeddings q JOIN embeddings e ON e.label = q.label WHERE q.vec_id % 50 = 0), run AS (SELECT query, doc, rank FROM dntop WHERE rank <= 10), {METRIC.format(total='(SELECT count(*) FROM embeddings WHERE vec_id % 50 = 0)')}")
def q_dense_label_metrics(spark, d):
    e = _t(spark, d, "embeddings")
    rel = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), "label").join(e.select(F.col("vec_id").alias("doc"), "label"), "label").select("query", "doc")
    qs, vs = _vectors(spark, d)
    return metrics.retrieval_metrics(dense.dense_top(qs, vs), rel, qs)


@query(f"""WITH {DENSE}, l AS (SELECT t.query, t.rank, (t.label = q.label)::INT AS label FROM dntop t JOIN embeddings q ON q.vec_id = t.query),
           h AS (SELECT *, sum(label) OVER (PARTITION BY query ORDER BY rank) AS hits FROM l)
           SELECT query, round(sum(CASE WHEN label = 1 THEN hits / rank END) / sum(label), 6) AS ap FROM h GROUP BY query HAVING sum(label) > 0""")
def q_average_precision(spark, d):
    e = _t(spark, d, "embeddings").select("vec_id", "label")
    top = dense.dense_top(*_vectors(spark, d), k=50).join(e.select(F.col("vec_id").alias("doc"), F.col("label").alias("ld")), "doc").join(e.select(F.col("vec_id").alias("query"), F.col("label").alias("lq")), "query")
    return metrics.average_precision(top.select("query", "rank", (F.col("ld") == F.col("lq")).cast("int").alias("label"))).select("query", r6("ap").alias("ap"))


# Answers -----------------------------------------------------------------------------------------------------------------
PAIRS = f"p AS (SELECT query_id, {UNCITED(chr(39) * 0 + 'coalesce(predicted, ' + chr(39) * 2 + ')')} AS p, coalesce(expected, '') AS e FROM predictions), w AS (SELECT *, {WORDS('p')} AS pt, {WORDS('e')} AS et FROM p)"
COMMON = lambda a, b: f"coalesce(list_sum(list_transform(list_distinct(list_intersect({a}, {b})), lambda x: least(len(list_filter({a}, lambda y: y = x)), len(list_filter({b}, lambda y: y = x))))), 0)::INT"
GRAMS = lambda t, n: f"CASE WHEN len({t}) >= {n} THEN list_transform(range(1, (len({t}) - {n} + 2)::BIGINT), lambda i: array_to_string({t}[i:i + {n} - 1], ' ')) ELSE [] END"


def _scored(spark, d):
    return metrics.answer_scores(_t(spark, d, "predictions").select("query_id", "predicted", "expected"))


@query(f"WITH {PAIRS} SELECT query_id, CASE WHEN trim({LOW('e')}, ' ') = '' THEN 0 WHEN contains(trim({LOW('p')}, ' '), trim({LOW('e')}, ' ')) THEN 1 ELSE 0 END::DOUBLE AS em FROM w")
def q_exact_match(spark, d):
    return _scored(spark, d).select("query_id", "em")


@query(f"""WITH {PAIRS}, h AS (SELECT query_id, len(pt) AS np, len(et) AS ne, {COMMON("pt", "et")} AS hits FROM w)
           SELECT query_id, round(CASE WHEN np = 0 AND ne = 0 THEN 1 WHEN np = 0 OR ne = 0 OR hits = 0 THEN 0 ELSE 2 * hits / (np + ne) END::DOUBLE, 6) AS f1 FROM h""")
def q_token_f1(spark, d):
    return _scored(spark, d).select("query_id", r6("f1").alias("f1"))


BLEU_COUNTS = f"""{PAIRS}, g AS (SELECT query_id, len(pt) AS np, len(et) AS ne, {", ".join(f"{GRAMS('pt', n)} AS a{n}, {GRAMS('et', n)} AS b{n}" for n in range(1, 5))} FROM w),
    c AS (SELECT query_id, np, ne, {", ".join(f"{COMMON(f'a{n}', f'b{n}')} AS m{n}, len(a{n}) AS t{n}" for n in range(1, 5))} FROM g)"""
BLEU = f"CASE WHEN np = 0 THEN 0 ELSE (CASE WHEN np > ne THEN 1 ELSE exp(1 - ne / np) END) * exp({' + '.join(f'ln(CASE WHEN t{n} > 0 AND m{n} > 0 THEN m{n} / t{n} ELSE 1e-9 END) / 4' for n in range(1, 5))}) END"


@query(f"WITH {BLEU_COUNTS} SELECT query_id, round({BLEU}, 6) AS bleu FROM c")
def q_bleu_sentence(spark, d):
    return _scored(spark, d).select("query_id", r6("bleu").alias("bleu"))


@query(f"WITH {BLEU_COUNTS}, s AS (SELECT sum(np)::DOUBLE AS np, sum(ne)::DOUBLE AS ne, {', '.join(f'sum(m{n})::DOUBLE AS m{n}, sum(t{n})::DOUBLE AS t{n}' for n in range(1, 5))} FROM c) SELECT round({BLEU}, 6) AS bleu FROM s")
def q_bleu_corpus(spark, d):
    return metrics.corpus_bleu(_scored(spark, d))


LCS = """lcs(query_id, i, row) AS (SELECT query_id, 0, list_transform(et, lambda x: 0) FROM w UNION ALL
        SELECT query_id, i + 1, list_transform(range(1, len(et) + 1), lambda j: list_max(step[1:j])) FROM
            (SELECT l.query_id, i, et, list_transform(range(1, len(et) + 1), lambda j: CASE WHEN et[j] = pt[i + 1] THEN greatest(row[j], coalesce(row[j - 1], 0) + 1) ELSE row[j] END) AS step FROM lcs l JOIN w USING (query_id) WHERE i < len(pt) AND len(et) > 0)),
    rl AS (SELECT query_id, (CASE WHEN len(pt) = 0 AND len(et) = 0 THEN 1 WHEN len(pt) = 0 OR len(et) = 0 THEN 0 ELSE 2 * row[len(et)] / (len(pt) + len(et)) END)::DOUBLE AS rouge FROM w JOIN lcs USING (query_id) WHERE i = len(pt) OR len(et) = 0 AND i = 0)"""


@query(f"WITH RECURSIVE {PAIRS}, {LCS} SELECT query_id, round(rouge, 6) AS rouge_l FROM rl")
def q_rouge_l(spark, d):
    return _scored(spark, d).select("query_id", r6("rouge_l").alias("rouge_l"))


@query(f"""WITH {PAIRS}, a AS (SELECT query_id, list_filter(string_split_regex(lower(replace(p, 'İ', 'i' || chr(775))), '[^a-z0-9]+'), lambda t: t <> '') AS pt, list_filter(string_split_regex(lower(replace(e, 'İ', 'i' || chr(775))), '[^a-z0-9]+'), lambda t: t <> '') AS et FROM p)
           SELECT query_id, round(CASE WHEN len(pt) = 0 AND len(et) = 0 THEN 1 WHEN len(pt) = 0 OR len(et) = 0 THEN 0 ELSE 2 * {COMMON("pt", "et")} / (len(pt) + len(et)) END::DOUBLE, 6) AS f1_ascii FROM a""")
def q_f1_ascii(spark, d):
    """Token F1 with the tokens of the ASCII variant of ROUGE: other letters separate words."""
    p = _t(spark, d, "predictions").select("query_id", T.strip_citations(F.coalesce("predicted", F.lit(""))).alias("p"), F.coalesce("expected", F.lit("")).alias("e"))
    w = lambda c: F.filter(F.split(F.lower(F.col(c)), "[^a-z0-9]+"), lambda x: x != "")
    t = p.select("query_id", w("p").alias("pt"), w("e").alias("et"))
    return t.select("query_id", r6(metrics.f1_of(T.multiset_overlap("pt", "et"), F.size("pt"), F.size("et"))).alias("f1_ascii"))


ASCII_PAIRS = f"""{PAIRS.split(", w AS")[0]}, w AS (SELECT query_id, {", ".join(f"list_filter(string_split_regex(lower(replace({c}, 'İ', 'i' || chr(775))), '[^a-z0-9]+'), lambda t: t <> '') AS {c}t" for c in "pe")} FROM p)"""


@query(f"WITH RECURSIVE {ASCII_PAIRS}, {LCS} SELECT query_id, round(rouge, 6) AS rouge_l_ascii FROM rl")
def q_rouge_l_ascii(spark, d):
    p = _t(spark, d, "predictions").select("query_id", T.strip_citations(F.coalesce("predicted", F.lit(""))).alias("p"), F.coalesce("expected", F.lit("")).alias("e"))
    w = lambda c: F.filter(F.split(F.lower(F.col(c)), "[^a-z0-9]+"), lambda x: x != "")
    t = p.select("query_id", w("p").alias("pt"), w("e").alias("et"))
    return t.select("query_id", r6(metrics.f1_of(T.lcs_length("pt", "et"), F.size("pt"), F.size("et"))).alias("rouge_l_ascii"))


APART = lambda c: rf"list_filter(string_split_regex(regexp_replace(regexp_replace(regexp_replace({c}, '([\{{-\~\[-\` -\&\(-\+\:-\@\/])', ' \1 ', 'g'), '([^0-9])([\.,])', '\1 \2 ', 'g'), '([\.,])([^0-9])', ' \1 \2', 'g'), '\s+'), lambda t: t <> '')"
PAIRS_13A = f"{PAIRS.split(', w AS')[0]}, w AS (SELECT query_id, {APART('p')} AS pt, {APART('e')} AS et FROM p)"
COUNTS_13A = BLEU_COUNTS.replace(PAIRS, PAIRS_13A)
BLEU_13A = BLEU.replace("ELSE 1e-9 END", "END")


@query(f"WITH {COUNTS_13A}, s AS (SELECT sum(np)::DOUBLE AS np, sum(ne)::DOUBLE AS ne, {', '.join(f'sum(m{n})::DOUBLE AS m{n}, sum(t{n})::DOUBLE AS t{n}' for n in range(1, 5))} FROM c) SELECT round(coalesce({BLEU_13A}, 0), 6) AS bleu_13a FROM s")
def q_bleu_13a(spark, d):
    """Corpus BLEU on tokens that have punctuation of their own; no floor under a precision of zero."""
    p = _t(spark, d, "predictions").select(T.strip_citations(F.coalesce("predicted", F.lit(""))).alias("p"), F.coalesce("expected", F.lit("")).alias("e"))
    cut = lambda c: T.split_words(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col(c), r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", " $1 "), r"([^0-9])([\.,])", "$1 $2 "), r"([\.,])([^0-9])", " $1 $2"))
    t = p.select(cut("p").alias("pt"), cut("e").alias("et"))
    s = t.select(F.size("pt").alias("np"), F.size("et").alias("ne"), *metrics.bleu_counts("pt", "et"))
    pooled = s.agg(*[F.sum(c).alias(c) for c in s.columns])
    return pooled.select(r6(metrics.bleu_of(F.col("np"), F.col("ne"), floor=0)).alias("bleu_13a"))


@query(f"""WITH x AS (SELECT query_id, list_distinct(list_transform(regexp_extract_all(coalesce(predicted, ''), '\\[\\s*[Kk][Aa][Yy][Nn][Aa][Kk]\\s+(\\d+)\\s*\\]', 1), lambda s: s::INT)) AS n, coalesce(retrieved_sources, []) AS s, trim(coalesce(expected_source, ''), ' ') AS e FROM predictions),
           y AS (SELECT query_id, e, n, list_transform(s, lambda v: trim({LOW("coalesce(v, '')")}, ' ')) AS s, {LOW("e")} AS el FROM x)
           SELECT query_id, CASE WHEN e = '' THEN 0 ELSE list_contains(list_transform(list_filter(n, lambda i: i BETWEEN 1 AND len(s)), lambda i: s[i]), el)::INT END AS citation_accuracy, CASE WHEN e = '' THEN 0 ELSE list_contains(s, el)::INT END AS source_in_context, (len(n) > 0)::INT AS citation_presence FROM y""")
def q_citation_metrics(spark, d):
    return metrics.citation_flags(_t(spark, d, "predictions"))


@query(f"""WITH s AS (SELECT query_id, predicted, string_split(regexp_replace(coalesce(predicted, ''), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS sents, list_transform(coalesce(retrieved_chunks, []), lambda c: c.text) AS texts FROM predictions),
           w AS (SELECT *, list_transform(sents, lambda s: list_distinct({WORDS("s")})) AS sw, list_transform(texts, lambda c: list_distinct({WORDS("coalesce(c, '')")})) AS cw FROM s),
           o AS (SELECT *, list_transform(cw, lambda c: list_transform(sw, lambda x: CASE WHEN len(x) = 0 OR len(c) = 0 THEN 0::DOUBLE ELSE len(list_intersect(x, c))::DOUBLE / least(len(x), len(c)) END)) AS scores FROM w),
           b AS (SELECT *, list_transform(scores, lambda x: CASE WHEN list_max(x) >= 0.15 THEN list_position(x, list_max(x)) END) AS best FROM o)
           SELECT query_id, CASE WHEN len(list_filter(best, lambda x: x IS NOT NULL)) = 0 THEN predicted ELSE
               array_to_string(list_transform(range(1, len(sents) + 1), lambda i: sents[i] || array_to_string(list_transform(list_filter(range(1, len(best) + 1), lambda n: best[n] = i), lambda n: ' [Kaynak ' || n || ']'), '')), ' ') END AS answer FROM b""")
def q_citation_inject(spark, d):
    return context.inject_citations(_t(spark, d, "predictions"))


def _ranked_texts(spark, d):
    ch = _chunks(spark, d).select(F.col("chunk_id").alias("doc"), "text", "source")
    return lexical.bm25_top(_chunks(spark, d), _questions(spark, d), k=5, doc="chunk_id").join(ch, "doc")


CONTEXT = lambda limit, first: f"""WITH {BM}, t AS (SELECT query, rank, '[Kaynak ' || rank || '] (' || coalesce(source, '') || ')' || chr(10) || text || chr(10) || chr(10) AS part FROM bmtop JOIN ch ON chunk_id = doc WHERE rank <= 5),
           c AS (SELECT *, sum(length(part)) OVER (PARTITION BY query ORDER BY rank) AS run FROM t)
           SELECT query AS query_id, count(CASE WHEN {first} run <= {limit} THEN 1 END) AS n_included, md5(coalesce(string_agg(part, '' ORDER BY rank) FILTER ({first} run <= {limit}), '')) AS context_md5 FROM c GROUP BY query"""  # noqa: E731


@query(CONTEXT(3000, "rank = 1 OR"))
def q_context_assemble(spark, d):
    got = context.assemble(_ranked_texts(spark, d), chars=3000)
    return got.select(F.col("query").alias("query_id"), "n_included", F.md5("context").alias("context_md5"))


@query(CONTEXT(1000, ""))
def q_context_strict(spark, d):
    got = context.assemble(_ranked_texts(spark, d), chars=1000, strict=True)
    return got.select(F.col("query").alias("query_id"), "n_included", F.md5("context").alias("context_md5"))


@query(f"""WITH {QA}, a AS (SELECT query_id, coalesce(answer, '') || CASE WHEN length(question) % 2 = 0 THEN ' Soru: ' || question ELSE '' END AS t FROM qa),
           b AS (SELECT query_id, t, list_min(list_filter([instr(t, 'Soru:'), instr(t, 'Bağlam:'), instr(t, 'Question:'), instr(t, chr(10) || 'Q:')], lambda i: i > 10)) AS cut FROM a)
           SELECT query_id, md5(trim(CASE WHEN cut IS NULL THEN t ELSE left(t, cut - 1) END, ' ')) AS answer_md5 FROM b""")
def q_answer_truncate(spark, d):
    qa = _qa(spark, d)
    text = F.concat(F.coalesce("answer", F.lit("")), F.when(F.length("question") % 2 == 0, F.concat(F.lit(" Soru: "), "question")).otherwise(""))
    return qa.select("query_id", text.alias("t")).select("query_id", F.md5(T.truncate_answer("t")).alias("answer_md5"))


@query(f"""WITH {CH}, x AS (SELECT chunk_id, regexp_replace(chunk_id, '_\\d+$', '') AS prefix, regexp_extract(chunk_id, '_(\\d+)$', 1)::INT AS idx FROM ch)
           SELECT chunk_id, lag(chunk_id) OVER w AS before, lead(chunk_id) OVER w AS after FROM x WINDOW w AS (PARTITION BY prefix ORDER BY idx, chunk_id)""")
def q_chunk_neighbors(spark, d):
    return context.neighbours(_chunks(spark, d)).select("chunk_id", "before", "after")


JOINED_AT = lambda a, b: f"CASE WHEN coalesce(list_max(list_filter(range(1, least(360, length({a}), length({b})) + 1), lambda n: right({a}, n) = left({b}, n))), 0) > 0 THEN {a} || substr({b}, list_max(list_filter(range(1, least(360, length({a}), length({b})) + 1), lambda n: right({a}, n) = left({b}, n))) + 1) ELSE {a} || chr(10) || {b} END"


@query(f"""WITH {CH}, x AS (SELECT chunk_id, text, lag(text) OVER w AS tb, lead(text) OVER w AS ta FROM ch WINDOW w AS (PARTITION BY regexp_replace(chunk_id, '_\\d+$', '') ORDER BY regexp_extract(chunk_id, '_(\\d+)$', 1)::INT, chunk_id)),
           y AS (SELECT chunk_id, ta, CASE WHEN tb IS NULL THEN text ELSE {JOINED_AT("tb", "text")} END AS l FROM x), z AS (SELECT chunk_id, CASE WHEN ta IS NULL THEN l ELSE {JOINED_AT("l", "ta")} END AS e FROM y)
           SELECT chunk_id, length(e)::INT AS n_chars, md5(e) AS expanded_md5 FROM z""")
def q_chunk_expand(spark, d):
    return context.expand_chunk(_chunks(spark, d)).select("chunk_id", F.length("expanded").alias("n_chars"), F.md5("expanded").alias("expanded_md5"))


# The graph ---------------------------------------------------------------------------------------------------------------
def _nodes(spark, d):
    """lineitem as documents (orders) of articles (line numbers) of parts (repeated lines, by their other columns)."""
    li = _t(spark, d, "lineitem")
    w = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    n = li.select("l_orderkey", "l_linenumber", F.row_number().over(w).alias("part"))
    return n.select(F.concat_ws("_", F.lit("tpch"), "l_orderkey", F.concat(F.lit("m"), F.col("l_linenumber").cast("string")), "part").alias("id"), F.lit("tpch").alias("source"), F.col("l_orderkey").cast("string").alias("doc_id"), F.col("part").cast("bigint").alias("ord"))


def _adjacency(spark, d):
    n = _nodes(spark, d)
    article, part = graph.article_of(F.col("id"), F.col("source"), F.col("doc_id"))
    return graph.adjacency(n.withColumn("article", article).withColumn("part", part))


ADJ = """n AS (SELECT l_orderkey AS o, l_linenumber AS a, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS p FROM lineitem),
    i AS (SELECT o, a, p, 'tpch_' || o || '_m' || a || '_' || p AS id FROM n),
    e1 AS (SELECT x.id AS src, y.id AS dst FROM i x JOIN i y ON x.o = y.o AND y.a = x.a + 1 UNION ALL SELECT x.id, y.id FROM i x JOIN i y ON x.o = y.o AND x.a = y.a AND y.p = x.p + 1),
    e AS (SELECT DISTINCT src, dst FROM (SELECT * FROM e1 UNION ALL SELECT dst, src FROM e1))"""


@query(f"WITH {ADJ} SELECT 'adj' AS kind, count(*) AS n_edges FROM e UNION ALL SELECT 'nodes', count(DISTINCT src) FROM e")
def q_graph_adjacency(spark, d):
    return graph.stats(_adjacency(spark, d))


@query()
def q_graph_refs(spark, d):
    ch = _chunks(spark, d)
    return graph.references(ch.select(F.col("chunk_id").alias("id"), "text"))


@query()
def q_graph_edges(spark, d):
    """The whole graph of the chunks; an article's number is what a chunk's text begins with."""
    ch = _chunks(spark, d)
    nodes = ch.select(F.col("chunk_id").alias("id"), "source", "doc_id", "text", "ord", F.nullif(F.regexp_extract("text", r"(?i)^\s*madde\s+(\d+)", 1), F.lit("")).cast("int").alias("article"))
    return graph.build_graph(nodes, _t(spark, d, "source_map").select("law_no", "source")).groupBy("kind").agg(F.count("*").alias("n_edges"), F.countDistinct("src").alias("n_src"))


@query(f"""WITH {ADJ}, s AS (SELECT o AS query, id AS doc, p AS rank, (1.0 / a)::DOUBLE AS score FROM i WHERE p = 1 AND a = 1),
           c AS (SELECT s.query, e.dst AS doc, s.score * 0.85::DOUBLE AS score, s.rank AS seed FROM s JOIN e ON e.src = s.doc WHERE NOT EXISTS (SELECT 1 FROM s t WHERE t.query = s.query AND t.doc = e.dst)),
           k AS (SELECT *, 1 + row_number() OVER (PARTITION BY query ORDER BY seed, doc) AS rank FROM c)
           SELECT query, doc, score, rank FROM s UNION ALL SELECT query, doc, score, rank FROM k WHERE rank <= 4""")
def q_graph_expand(spark, d):
    """The first part of each order's first line as the only result of the order, expanded along adjacency."""
    n = _nodes(spark, d)
    seeds = n.where(F.col("id").rlike("_m1_1$")).select(F.col("doc_id").cast("bigint").alias("query"), F.col("id").alias("doc"), F.lit(1.0).alias("score"), F.lit(1).alias("rank"))
    got = graph.expand(seeds, _adjacency(spark, d), n.select(F.col("id").alias("doc")))
    return got.select("query", "doc", "score", F.col("rank").cast("bigint").alias("rank"))


# Faithfulness, judges, scores ----------------------------------------------------------------------------------------------
def _faith(spark, d):
    """Predictions with entailment scores of the default scorer, from the retrieved chunks and from the expected answer."""
    p = _t(spark, d, "predictions").where("coalesce(predicted, '') <> ''")
    ctx = F.coalesce(F.array_join(F.transform(F.slice("retrieved_chunks", 1, 5), lambda c: c["text"]), "\n\n"), F.lit(""))
    exp = F.coalesce("expected", F.lit(""))
    share = metrics.softmax_at(providers.entailment_logits(ctx, F.col("predicted")), 1)
    gold = F.when(exp != "", metrics.softmax_at(providers.entailment_logits(exp, F.col("predicted")), 1))
    best = F.array_max(F.transform("retrieved_chunks", lambda c: c["score"]))
    return p.select("query_id", F.round(share, 9).alias("context_score"), F.round(gold, 9).alias("gold_score"), F.round(best, 9).alias("score"))


ENT = lambda a, b: f"(SELECT exp(4 * s - m) / (exp(1 - s - m) + exp(4 * s - m) + exp(1 - m)) FROM (SELECT s, greatest(1 - s, 4 * s, 1) AS m FROM (SELECT CASE WHEN len({b}) = 0 THEN 0 ELSE len(list_intersect(list_distinct({a}), list_distinct({b})))::DOUBLE / len(list_distinct({b})) END AS s)))"
FAITH = f"""p AS (SELECT query_id, {TOK("predicted")} AS h, {TOK("coalesce(array_to_string(list_transform(retrieved_chunks[1:5], lambda c: c.text), chr(10) || chr(10)), '')")} AS c, {TOK("coalesce(expected, '')")} AS g, coalesce(expected, '') <> '' AS has,
            round(list_max(list_transform(retrieved_chunks, lambda c: c.score)), 9) AS score FROM predictions WHERE coalesce(predicted, '') <> ''),
    f AS (SELECT query_id, score, round({ENT("c", "h")}, 9) AS context_score, CASE WHEN has THEN round({ENT("g", "h")}, 9) END AS gold_score, CASE WHEN score > 0.7 THEN 'hit' WHEN score >= 0.4 THEN 'partial' ELSE 'miss' END AS class FROM p)"""


@query(f"""WITH {FAITH} SELECT count(*) AS total, count(CASE WHEN class = 'hit' THEN 1 END) AS n_hit, count(CASE WHEN class = 'partial' THEN 1 END) AS n_partial, count(CASE WHEN class = 'miss' THEN 1 END) AS n_miss, count(CASE WHEN context_score >= 0.5 THEN 1 END) AS context_grounded, count(gold_score) AS gold_total,
           round(count(CASE WHEN context_score >= 0.5 THEN 1 END) / count(*), 6) AS context_rate, round(count(CASE WHEN gold_score >= 0.5 THEN 1 END) / nullif(count(gold_score), 0), 6) AS gold_rate, round(avg(context_score), 6) AS mean, round(min(context_score), 6) AS low, round(max(context_score), 6) AS high, round(stddev_pop(context_score), 6) AS std FROM f""")
def q_faithfulness_summary(spark, d):
    return metrics.faithfulness_summary(_faith(spark, d))


@query(f"""WITH {FAITH}, r AS (SELECT query_id AS key, class, md5(query_id) AS h, row_number() OVER (PARTITION BY class ORDER BY md5(query_id), query_id) AS rn FROM f),
           own AS (SELECT key, class, class AS bucket FROM r WHERE rn <= 20),
           rest AS (SELECT key, class, row_number() OVER (ORDER BY h, key) AS i FROM r WHERE rn > 20)
           SELECT * FROM own UNION ALL SELECT key, class, ['hit', 'partial', 'miss'][(i - 1) % 3 + 1] FROM rest WHERE i <= 60 - (SELECT count(*) FROM own)""")
def q_stratified_sample(spark, d):
    return metrics.stratified_sample(_faith(spark, d), "query_id", "score", n=60)


@query(f"""WITH a AS MATERIALIZED (SELECT query_id, {TOK("predicted")} AS p, {TOK("coalesce(expected, '')")} AS e FROM predictions WHERE error IS NULL AND coalesce(predicted, '') <> ''),
           v AS (SELECT {EMBED("p")} AS p, {EMBED("e")} AS e FROM a) SELECT round(avg(list_dot_product(p, e)), 6) AS semantic_similarity FROM v""")
def q_semantic_similarity(spark, d):
    """Mean similarity of predicted and expected answers by the default embedder."""
    return evaluation.similarity(_answered(spark, d), providers.HashEmbedder())


def _answered(spark, d):
    return _t(spark, d, "predictions").where("error IS NULL AND coalesce(predicted, '') <> ''")


@query(f"""WITH {CH}, t AS (SELECT unnest({TOK("text")}) AS token FROM ch), n AS (SELECT token, count(*) AS n FROM t GROUP BY token), z AS (SELECT sum(n) + count(*) + 1 AS total FROM n),
           a AS (SELECT query_id, unnest({TOK("predicted")}) AS token FROM predictions WHERE error IS NULL AND coalesce(predicted, '') <> ''),
           p AS (SELECT query_id, exp(avg(ln(total) - ln(coalesce(n, 0) + 1))) AS p FROM a LEFT JOIN n USING (token), z GROUP BY query_id)
           SELECT count(*) AS n_answers, CASE WHEN count(*) >= 3 THEN round(exp(avg(ln(p))), 4) END AS perplexity FROM p""")
def q_perplexity_geomean(spark, d):
    """Geometric mean of the answers' perplexities under a unigram model of the corpus."""
    each = providers.perplexities(_answered(spark, d), providers.unigram_costs(_chunks(spark, d)))
    return each.agg(F.count("*").alias("n_answers"), metrics.geometric_mean(F.col("perplexity")).alias("perplexity"))


SHARE = lambda of, within: f"CASE WHEN len({of}) = 0 THEN NULL ELSE len(list_intersect({of}, {within}))::DOUBLE / len({of}) END"
SAMPLED = lambda n, more="": f"""s AS (SELECT * FROM (SELECT query_id, question, predicted, expected, list_filter(list_transform(retrieved_chunks[1:5], lambda c: c.text), lambda t: coalesce(t, '') <> '') AS ctx FROM predictions WHERE error IS NULL AND coalesce(predicted, '') <> '') {more} ORDER BY md5(query_id), query_id LIMIT {n}),
    k AS (SELECT list_distinct({TOK("coalesce(question, '')")}) AS q, {TOK("predicted")} AS al, list_distinct({TOK("predicted")}) AS a, list_distinct({TOK("coalesce(expected, '')")}) AS t, list_distinct({TOK("coalesce(array_to_string(ctx, ' '), '')")}) AS c, list_transform(ctx, lambda x: list_distinct({TOK("x")})) AS cs, len(ctx) AS nc FROM s)"""  # noqa: E731


@query(f"""WITH {SAMPLED(50, "WHERE len(ctx) > 0")}, m AS (SELECT {SHARE("a", "c")} AS f, {SHARE("q", "a")} AS r, {SHARE("t", "c")} AS cr, {SHARE("t", "a")} AS h, {SHARE("a", "t")} AS g,
             CASE WHEN len(t) = 0 THEN NULL ELSE list_sum(list_transform(cs, lambda x: CASE WHEN len(list_intersect(t, x))::DOUBLE / len(t) >= 0.5 THEN 1.0 ELSE 0.0 END))::DOUBLE / nc END AS cp FROM k)
           SELECT round(avg(f), 4) AS ragas_faithfulness, round(avg(r), 4) AS ragas_answer_relevancy, round(avg(cr), 4) AS ragas_context_recall, round(avg(cp), 4) AS ragas_context_precision, round(avg(CASE WHEN h IS NULL OR g IS NULL THEN NULL WHEN h + g = 0 THEN 0 ELSE 2 * h * g / (h + g) END), 4) AS ragas_answer_correctness FROM m""")
def q_nan_mean(spark, d):
    """Means of the suite of context metrics that leave out answers for which a metric has no base."""
    return metrics.suite_means(_answered(spark, d), providers.lexical_suite)


@query(f"""WITH {SAMPLED(20)}, j AS (SELECT {SHARE("t", "a")} AS j1, CASE WHEN nc > 0 THEN {SHARE("a", "c")} END AS j2, {SHARE("q", "a")} AS j3, CASE WHEN len(al) > 0 THEN len(a)::DOUBLE / len(al) END AS j4, len(al) > 0 AS ok FROM k)
           SELECT {", ".join(f"round(coalesce(avg(CASE WHEN ok THEN floor(j{i} * 100) / 100 END), 0.5), 6) AS llm_{k}_score, count(*) - count(CASE WHEN ok THEN j{i} END) AS llm_{k}_failed" for i, k in enumerate(providers.JUDGES, 1))} FROM j""")
def q_judge_scores(spark, d):
    """Mean scores of the four default judges over 20 answers; failures are counted, not taken for one half."""
    return metrics.judge_means(_answered(spark, d), providers.judge_reply, list(providers.JUDGES))


CITED = """cf AS (SELECT avg(CASE WHEN e = '' THEN 0 ELSE list_contains(list_transform(list_filter(n, lambda i: i BETWEEN 1 AND len(s)), lambda i: s[i]), el)::INT END) AS citation_accuracy, avg(CASE WHEN e = '' THEN 0 ELSE list_contains(s, el)::INT END) AS source_in_context_rate, avg((len(n) > 0)::INT) AS citation_presence_rate FROM
        (SELECT e, n, list_transform(s, lambda v: trim({low_v}, ' ')) AS s, {low_e} AS el FROM (SELECT list_distinct(list_transform(regexp_extract_all(coalesce(predicted, ''), '\\[\\s*[Kk][Aa][Yy][Nn][Aa][Kk]\\s+(\\d+)\\s*\\]', 1), lambda s: s::INT)) AS n, coalesce(retrieved_sources, []) AS s, trim(coalesce(expected_source, ''), ' ') AS e FROM predictions)))""".format(low_v=LOW("coalesce(v, '')"), low_e=LOW("e"))


@query(f"""WITH RECURSIVE {BLEU_COUNTS}, {LCS}, {CITED}, pooled AS (SELECT sum(np)::DOUBLE AS np, sum(ne)::DOUBLE AS ne, {', '.join(f'sum(m{n})::DOUBLE AS m{n}, sum(t{n})::DOUBLE AS t{n}' for n in range(1, 5))} FROM c),
           em AS (SELECT avg(CASE WHEN trim({LOW('e')}, ' ') = '' THEN 0 WHEN contains(trim({LOW('p')}, ' '), trim({LOW('e')}, ' ')) THEN 1 ELSE 0 END) AS em, count(*) AS num_samples FROM w),
           ff AS (SELECT avg((CASE WHEN np = 0 AND ne = 0 THEN 1 WHEN np = 0 OR ne = 0 OR m1 = 0 THEN 0 ELSE 2 * m1 / (np + ne) END)::DOUBLE) AS f1 FROM c), rr AS (SELECT avg(rouge) AS rouge_l FROM rl)
           SELECT round(em, 6) AS em, round(f1, 6) AS f1, round(rouge_l, 6) AS rouge_l, round({BLEU}, 6) AS bleu, num_samples, round(citation_accuracy, 6) AS citation_accuracy, round(source_in_context_rate, 6) AS source_in_context_rate, round(citation_presence_rate, 6) AS citation_presence_rate FROM em, ff, rr, pooled, cf""")
def q_answer_summary(spark, d):
    """All answer metrics of the predictions in one row."""
    return metrics.answer_summary(_t(spark, d, "predictions"))


@query(f"""WITH {DENSE}, l AS (SELECT t.query, t.rank, (t.label = q.label)::INT AS label FROM dntop t JOIN embeddings q ON q.vec_id = t.query),
           h AS (SELECT *, sum(label) OVER (PARTITION BY query ORDER BY rank) AS hits FROM l), a AS (SELECT query, sum(CASE WHEN label = 1 THEN hits / rank END) / sum(label) AS ap FROM h GROUP BY query HAVING sum(label) > 0)
           SELECT round(avg(ap), 6) AS map, count(*) AS num_queries FROM a""")
def q_mean_average_precision(spark, d):
    e = _t(spark, d, "embeddings").select("vec_id", "label")
    top = dense.dense_top(*_vectors(spark, d), k=50).join(e.select(F.col("vec_id").alias("doc"), F.col("label").alias("ld")), "doc").join(e.select(F.col("vec_id").alias("query"), F.col("label").alias("lq")), "query")
    return metrics.mean_average_precision(top.select("query", "rank", (F.col("ld") == F.col("lq")).cast("int").alias("label")))


@query(f"WITH {QA} SELECT p.query_id, coalesce(qa.question, p.query_id) AS question FROM predictions p LEFT JOIN (SELECT query_id, min(question) AS question FROM qa WHERE split = 'test' GROUP BY query_id) qa USING (query_id)")
def q_question_lookup(spark, d):
    """Predictions with their questions of split test, or their id where there is none."""
    return metrics.questions_of(_t(spark, d, "predictions").select("query_id"), _qa(spark, d).where("split = 'test'"))


# Stages and the corpus --------------------------------------------------------------------------------------------------------
def _stage_inputs(spark, d):
    ch = _chunks(spark, d).select("chunk_id", "doc_id", "text", "source")
    r = _questions(spark, d)
    qs = r.select("query_id", F.col("query").alias("question"), F.col("gold_answer_extract").alias("expected"), F.col("source").alias("expected_source"))
    rel = r.select(F.col("query_id").alias("query"), F.explode("gold_chunk_ids").alias("doc")).distinct().join(ch.select(F.col("chunk_id").alias("doc")), "doc", "left_semi")
    return ch, qs, rel


STAGED = f"""{CH}, tok AS MATERIALIZED (SELECT chunk_id AS doc, {TOK("text")} AS w FROM ch), jd AS MATERIALIZED (SELECT doc, {EMBED("w")} AS dv FROM tok),
    jq AS MATERIALIZED (SELECT query_id, qw, {EMBED("qw")} AS qv FROM (SELECT query_id, {TOK("coalesce(query, '')")} AS qw FROM rag_eval)), {LEXICAL},
    rel AS (SELECT DISTINCT query_id AS query, g AS doc FROM (SELECT query_id, unnest(gold_chunk_ids) AS g FROM rag_eval) WHERE g IN (SELECT chunk_id FROM ch)),
    run AS (SELECT 'base' AS stage, query, doc, rank FROM den WHERE rank <= 10 UNION ALL SELECT 'hybrid', query, doc, rank FROM {HYBRID(a='0.5::DOUBLE', b='0.5::DOUBLE', k=10)}
            UNION ALL SELECT 'rrf', query, doc, rank FROM rrf WHERE rank <= 10 UNION ALL SELECT 'rrf_rerank', query, doc, rank FROM {RERANKED("rrf")}),
    per AS (SELECT s.stage, r.query, count(*) AS n_rel, min(b.rank) AS first, count(CASE WHEN b.rank <= 5 THEN 1 END) AS h5, count(CASE WHEN b.rank <= 10 THEN 1 END) AS h10, coalesce(sum(CASE WHEN b.rank <= 10 THEN 1 / log2(b.rank + 1) END), 0) AS dcg
            FROM (SELECT DISTINCT stage FROM run) s, rel r LEFT JOIN run b ON b.stage = s.stage AND b.query = r.query AND b.doc = r.doc GROUP BY s.stage, r.query),
    m AS (SELECT *, (SELECT sum(1 / log2(i + 1)) FROM range(1, 11) t(i) WHERE i <= n_rel) AS ideal FROM per)"""


@query(f"""WITH {STAGED} SELECT stage, round(avg(h5 / n_rel), 6) AS recall_at_5, round(avg(h10 / n_rel), 6) AS recall_at_10, round(avg(coalesce(1 / first, 0)), 6) AS mrr, round(avg(dcg / ideal), 6) AS ndcg_at_10, count(*) AS num_queries FROM m GROUP BY stage""")
def q_stage_retrieval(spark, d):
    """Retrieval metrics of the stages that need no graph and no other model, side by side."""
    ch, qs, rel = _stage_inputs(spark, d)
    found = evaluation.candidates(ch, qs, providers.HashEmbedder())
    out = None
    for name in ("base", "hybrid", "rrf", "rrf_rerank"):
        run = evaluation.retrieved(stages.STAGES[name], ch, qs, found)
        got = metrics.retrieval_metrics(run, rel, qs.select(F.col("query_id").alias("query"))).select(F.lit(name).alias("stage"), "recall_at_5", "recall_at_10", "mrr", "ndcg_at_10", "num_queries")
        out = got if out is None else out.unionByName(got)
    return out


@query()
def q_stage_documents(spark, d):
    """The metrics document of the stage with fusion, reranking and the graph, by the default models."""
    ch, qs, rel = _stage_inputs(spark, d)
    raw = _chunks(spark, d)
    nodes = raw.select(F.col("chunk_id").alias("id"), "source", "doc_id", "text", "ord", F.nullif(F.regexp_extract("text", r"(?i)^\s*madde\s+(\d+)", 1), F.lit("")).cast("int").alias("article"))
    edges = written(graph.build_graph(nodes, _t(spark, d, "source_map").select("law_no", "source")), "edges")
    done, said = evaluation.run_stages(["graph"], ch, qs, rel, edges=edges)
    if said:
        raise RuntimeError("; ".join(said))
    out = None
    for got in done.values():
        out = got["metrics"] if out is None else out.unionByName(got["metrics"])
    return out


@query(f"""WITH {QA}, h AS (SELECT query_id, context, CASE WHEN coalesce(context, '') <> '' THEN md5(context) END AS m FROM qa WHERE split = 'kaggle'),
           l AS (SELECT DISTINCT m FROM h WHERE m IS NOT NULL ORDER BY m DESC LIMIT 300), qb AS (SELECT query_id, context FROM h WHERE m IS NULL OR m NOT IN (SELECT m FROM l)),
           {PIECES.replace("FROM qa WHERE", "FROM qb WHERE")}, u AS (SELECT DISTINCT md5(piece) AS h, length(piece) AS n FROM pc WHERE length(piece) >= 180)
           SELECT count(*) AS n_chunks, sum(n)::BIGINT AS n_chars FROM u""")
def q_corpus_build(spark, d):
    """The corpus of the contexts that are not held out: its chunks and their characters."""
    rows = _qa(spark, d).where("split = 'kaggle'").select(F.col("query_id").alias("id"), "context", "source", F.xxhash64("query_id").alias("ord"))
    return corpus.build_corpus(rows).agg(F.count("*").alias("n_chunks"), F.sum("char_len").alias("n_chars"))


SCENARIO = f"""{PAIRS}, h AS (SELECT query_id, len(pt) AS np, len(et) AS ne, {COMMON("pt", "et")} AS hits FROM w),
    f AS (SELECT query_id, CASE WHEN np = 0 AND ne = 0 THEN 1 WHEN np = 0 OR ne = 0 OR hits = 0 THEN 0 ELSE 2 * hits / (np + ne) END::DOUBLE AS f1 FROM h),
    s AS (SELECT coalesce(expected_source, '') AS source, avg(f1) AS f1, avg((error IS NULL)::INT) AS faithfulness, avg(CASE WHEN len(retrieved_chunks) > 0 THEN 1.0::DOUBLE / len(retrieved_chunks) END) AS mrr FROM predictions JOIN f USING (query_id) GROUP BY 1)"""


def _by_source(spark, d):
    p = _t(spark, d, "predictions").join(_scored(spark, d).select("query_id", "f1"), "query_id")
    n = F.size("retrieved_chunks")
    return p.groupBy(F.coalesce("expected_source", F.lit("")).alias("source")).agg(F.avg("f1").alias("f1"), F.avg(F.when(F.col("error").isNull(), 1.0).otherwise(0.0)).alias("faithfulness"), F.avg(F.when(n > 0, 1.0 / n)).alias("mrr"))


@query(f"""WITH {SCENARIO} SELECT source, round_even(0.35 * coalesce(mrr, 0) + 0.40 * f1 + 0.25 * faithfulness, 6) AS scenario1_score, round_even(f1, 6) AS scenario2_score, true AS scenario2_fallback, round_even(faithfulness, 6) AS scenario3_score FROM s""")
def q_scenario_scores(spark, d):
    rows = _by_source(spark, d).withColumns({c: F.lit(None).cast("double") for c in ("similarity", "relevancy", "coherence")})
    return metrics.scenario_scores(rows).select("source", "scenario1_score", "scenario2_score", "scenario2_fallback", "scenario3_score")


@query(f"""WITH {SCENARIO}, m AS (SELECT source, 'f1' AS metric, f1 AS share FROM s UNION ALL SELECT source, 'faithfulness', faithfulness FROM s UNION ALL SELECT source, 'mrr', mrr FROM s)
           SELECT source, metric, round(share, 6) AS share, greatest(0, least(24, round_even(share * 24, 0)))::INT AS filled FROM m""")
def q_ablation_table(spark, d):
    """The scores by source in long form, with the filled places of their bars."""
    s = _by_source(spark, d)
    long = s.select("source", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("share")) for m in ("f1", "faithfulness", "mrr")])).alias("x")).select("source", "x.*")
    lines = sinks.report_lines(long.withColumn("metric", F.concat_ws("|", "source", "metric")))
    return lines.select(F.substring_index("metric", "|", 1).alias("source"), F.substring_index("metric", "|", -1).alias("metric"), r6("share").alias("share"), F.when(F.col("share").isNotNull(), F.length(F.regexp_replace(F.substring("line", 1, 24), r"[^#]", ""))).cast("int").alias("filled"))


# Training rows -------------------------------------------------------------------------------------------------------------
@query(f"""WITH {DENSE}, p AS (SELECT t.query, t.doc AS positive, t.label AS ps FROM dntop t WHERE t.rank = 1 AND t.score >= 0.3),
           c AS (SELECT t.query, t.doc, row_number() OVER (PARTITION BY t.query ORDER BY t.rank) AS place FROM dntop t JOIN p USING (query) WHERE t.rank BETWEEN 5 AND 30 AND t.doc <> p.positive AND t.label <> p.ps)
           SELECT query, doc, place FROM c WHERE place <= 7""")
def q_triplets(spark, d):
    """Hard negatives of each query vector: results from rank 5 on with another label than the best result."""
    lab = _t(spark, d, "embeddings").select(F.col("vec_id").alias("doc"), F.col("label").cast("string").alias("source"))
    ranked = dense.dense_top(*_vectors(spark, d), k=50).join(lab, "doc")
    pos = ranked.where(f"rank = 1 AND score >= {training.LEAST}").select("query", F.col("doc").alias("positive"), F.col("source").alias("positive_source"))
    return training.hard_negatives(ranked, pos).withColumn("place", F.col("place").cast("bigint"))


@query(f"""WITH {CH}, c AS (SELECT query_id, list_distinct(list_filter(string_split_regex(gold_answer_extract, '\\s+'), lambda t: t <> '')) AS w FROM rag_eval),
           k AS (SELECT chunk_id, ord, list_distinct(list_filter(string_split_regex(text, '\\s+'), lambda t: t <> '')) AS w FROM ch),
           s AS (SELECT query_id, chunk_id, ord, round(len(list_intersect(c.w, k.w))::DOUBLE / (len(c.w) + len(k.w) - len(list_intersect(c.w, k.w))), 9) AS score FROM c, k)
           SELECT query_id, chunk_id, score FROM s WHERE score >= 0.3 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ord) = 1""")
def q_jaccard_positives(spark, d):
    got = training.best_by_jaccard(_questions(spark, d).select(F.col("query_id").alias("query"), F.col("gold_answer_extract").alias("text")), _chunks(spark, d).select(F.col("chunk_id").alias("doc"), "ord", "text"))
    return got.select(F.col("query").alias("query_id"), F.col("doc").alias("chunk_id"), "score")


@query(f"""WITH {BM}, rel AS (SELECT DISTINCT query_id AS query, g AS doc FROM (SELECT query_id, unnest(gold_chunk_ids) AS g FROM rag_eval) WHERE g IN (SELECT chunk_id FROM ch)),
           n AS (SELECT query FROM rel GROUP BY query HAVING count(*) <= 15),
           neg AS (SELECT b.query, b.doc, row_number() OVER (PARTITION BY b.query ORDER BY b.rank) AS place FROM bmtop b WHERE b.rank <= 20 AND b.query IN (SELECT query FROM n) AND NOT EXISTS (SELECT 1 FROM rel WHERE rel.query = b.query AND rel.doc = b.doc))
           SELECT query AS query_id, doc AS chunk_id, 1.0::DOUBLE AS label FROM rel WHERE query IN (SELECT query FROM n) UNION ALL SELECT query, doc, 0.0::DOUBLE FROM neg WHERE place <= 3""")
def q_reranker_pairs(spark, d):
    qa, ch = _relevance_inputs(spark, d)
    rel = relevance.by_gold(qa, ch).select(F.col("query_id").alias("query"), F.col("chunk_id").alias("doc"))
    got = training.reranker_pairs(lexical.bm25_top(ch, _questions(spark, d), k=20, doc="chunk_id"), rel)
    return got.select(F.col("query").alias("query_id"), F.col("doc").alias("chunk_id"), "label")


@query(f"""WITH {BM}, rel AS (SELECT DISTINCT query_id AS query, g AS doc FROM (SELECT query_id, unnest(gold_chunk_ids) AS g FROM rag_eval) WHERE g IN (SELECT chunk_id FROM ch)),
           n AS (SELECT query FROM rel GROUP BY query HAVING count(*) <= 15),
           neg AS (SELECT b.query, b.doc, row_number() OVER (PARTITION BY b.query ORDER BY b.rank) AS place FROM bmtop b WHERE b.rank <= 20 AND b.query IN (SELECT query FROM n) AND NOT EXISTS (SELECT 1 FROM rel WHERE rel.query = b.query AND rel.doc = b.doc)),
           c AS (SELECT (SELECT count(*) FROM rel WHERE query IN (SELECT query FROM n)) AS p, (SELECT count(*) FROM neg WHERE place <= 3) AS q)
           SELECT p AS n_positive, q AS n_negative, q / p AS ratio FROM c""")
def q_pair_counts(spark, d):
    qa, ch = _relevance_inputs(spark, d)
    rel = relevance.by_gold(qa, ch).select(F.col("query_id").alias("query"), F.col("chunk_id").alias("doc"))
    return training.pair_counts(training.reranker_pairs(lexical.bm25_top(ch, _questions(spark, d), k=20, doc="chunk_id"), rel))


@query()
def q_training_triplets(spark, d):
    """Triplets of the questions of rag_eval: by their extracts, else by the default embedder, filled up to seven negatives."""
    ch, qs, _ = _stage_inputs(spark, d)
    embedder = providers.HashEmbedder()
    ranked = written(dense.dense_top(dense.as_queries(qs, embedder, text="question"), dense.as_vectors(dense.build_index(ch, embedder)), training.POOL), "ranked")
    grounded = training.best_by_jaccard(qs.select(F.col("query_id").alias("query"), F.col("expected").alias("text")), _chunks(spark, d).select(F.col("chunk_id").alias("doc"), "ord", "text"))
    got = training.triplets(qs.select(F.col("query_id").alias("query"), "question"), ranked, grounded, ch.withColumnRenamed("chunk_id", "doc"))
    return training.bucket_split(training.embedder_columns(got), "anchor", 20)


@query()
def q_multi_vector(spark, d):
    """The 50 dense candidates of each question, ranked by dense, sparse and word-by-word scores together."""
    m = providers.HashMultiVector()
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text")
    qs = _questions(spark, d).select(F.col("query_id").alias("query"), F.col("query").alias("question"))
    found = dense.dense_top(dense.as_queries(qs, m, "query", "question"), dense.as_vectors(dense.build_index(docs, m, "doc"), "doc"), stages.CANDIDATES)
    texts = docs.join(found.select("doc").distinct(), "doc", "left_semi").select("doc", m.sparse(F.col("text")).alias("d_sparse"), m.words(F.col("text")).alias("d_words"))
    asked = qs.select("query", m.sparse(F.col("question")).alias("q_sparse"), m.words(F.col("question")).alias("q_words"))
    return _run(fusion.multi_vector(found.join(texts, "doc").join(asked, "query")))


@query(f"WITH {QA} SELECT part, count(*) AS n FROM (SELECT CASE WHEN ('0x' || left(md5(question), 8))::BIGINT % 10 = 0 THEN 'eval' ELSE 'train' END AS part FROM qa) GROUP BY part")
def q_query_split(spark, d):
    return training.bucket_split(_qa(spark, d), "question").groupBy("part").agg(F.count("*").alias("n"))


@query(f"""WITH {BM}, t AS (SELECT query, rank, length('[Kaynak ' || rank || '] (' || coalesce(source, '') || ')' || chr(10) || text || chr(10) || chr(10)) AS l FROM bmtop JOIN ch ON chunk_id = doc WHERE rank <= 5),
           c AS (SELECT query, rank, sum(l) OVER (PARTITION BY query ORDER BY rank) AS run FROM t), q AS (SELECT query, coalesce(max(CASE WHEN run <= 3000 THEN run END), 0) AS n, count(CASE WHEN run > 3000 THEN 1 END) > 0 AS hit FROM c GROUP BY query)
           SELECT count(*) AS n_rows, round(avg(n), 6) AS mean_context, count(CASE WHEN hit THEN 1 END) AS n_limited FROM q""")
def q_rag_train(spark, d):
    """Statistics of training rows with assembled contexts."""
    ranked = _ranked_texts(spark, d)
    ctx = context.assemble(ranked, chars=3000, strict=True).join(ranked.groupBy("query").agg(F.count("*").alias("n")), "query")
    return ctx.agg(F.count("*").alias("n_rows"), r6(F.avg(F.length("context"))).alias("mean_context"), F.count_if(F.col("n_included") < F.col("n")).alias("n_limited"))


@query(f"""WITH {QA}, x AS (SELECT query_id, coalesce(left(context, 4000), '') AS c, question, answer FROM qa WHERE split = 'train' OR split = 'kaggle')
           SELECT query_id AS id, 3::BIGINT AS n_messages, md5('Hukuk asistanısın.' || chr(31) || CASE WHEN c = '' THEN question ELSE 'Bağlam:' || chr(10) || c || chr(10) || chr(10) || 'Soru: ' || question END || chr(31) || coalesce(answer, '')) AS messages_md5 FROM x""")
def q_chat_format(spark, d):
    rows = _qa(spark, d).where("split IN ('train', 'kaggle')").select(F.col("query_id").alias("id"), "question", "answer", "context")
    chat = training.chat_rows(rows, "Hukuk asistanısın.")
    joined = F.array_join(F.transform("messages", lambda m: F.coalesce(m["content"], F.lit(""))), chr(31))
    return chat.select("id", F.size("messages").cast("bigint").alias("n_messages"), F.md5(joined).alias("messages_md5"))


@query()
def q_generated_answers(spark, d):
    """Answers of the default generator from assembled contexts, cut at markers, with citations put in."""
    ranked = _ranked_texts(spark, d)
    ctx = context.assemble(ranked).join(_questions(spark, d).select(F.col("query_id").alias("query"), F.col("query").alias("question")), "query")
    answers = ctx.select(F.col("query").alias("query_id"), T.truncate_answer(F.coalesce(providers.extractive_answer(F.col("question"), F.col("context")), F.lit(""))).alias("predicted"))
    chunks = ranked.groupBy(F.col("query").alias("query_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: F.struct(x["text"].alias("text"))).alias("retrieved_chunks"))
    return context.inject_citations(answers.join(chunks, "query_id"))
