import math
import random

import numpy as np
import pytest

from kervan.operators import chunking, context, dedup, dense, fusion, graph, lexical, metrics, relevance, training


def test_chunk_articles():
    body = lambda n: "x" * n
    text = "BAŞLIK\n\nMADDE 1 " + body(192) + "\nMADDE 2 " + body(80)
    got = chunking.chunks_of(text)
    assert [i for i, _ in got] == [0] and got[0][1].startswith("MADDE 1")
    assert chunking.chunks_of("x" * 179) == []
    assert len(chunking.ARTICLE.split("giris\n\n\n  Madde 1 aa\n\nmadde 2 bb\rMADDE 3 cc")) >= 2


def test_recursive_split_bounds():
    r = random.Random(1)
    text = "\n\n".join(". ".join("kelime" * r.randint(1, 4) for _ in range(r.randint(1, 60))) for _ in range(30))
    pieces = chunking.recursive_split(text)
    assert all(0 < len(p) <= 1400 and p in text for p in pieces)
    assert max(len(p) for p in chunking.recursive_split("y" * 5000)) <= 1400


def test_chunk_gaps(spark):
    text = ("a" * 1300) + "\n\n" + ("b" * 100) + "\n\n" + ("c" * 1395)
    got = chunking.chunk(spark.createDataFrame([("d", "s", text), ("e", "s", None)], "doc_id string, source string, text string"), articles=False).collect()
    assert [x.idx for x in sorted(got, key=lambda x: x.idx)] == [i for i, p in enumerate(chunking.recursive_split(text)) if len(p) >= 180]


def test_bm25_against_formula(spark):
    docs = [("d1", "hukuk kanun madde"), ("d2", "hukuk hukuk dava"), ("d3", ""), ("d4", None), ("d5", "mahkeme kanun dava dava")]
    d = spark.createDataFrame(docs, "doc_id string, text string")
    q = spark.createDataFrame([("q", "hukuk dava dava")], "query_id string, query string")
    toks = {i: (t or "").split() for i, t in docs}
    n, avg = len(docs), sum(map(len, toks.values())) / len(docs)
    vocab = {w for t in toks.values() for w in t}
    raw = {w: math.log(n - (df := sum(w in t for t in toks.values())) + 0.5) - math.log(df + 0.5) for w in vocab}
    mean = sum(raw.values()) / len(raw)
    idf = {w: x if x >= 0 else 0.25 * mean for w, x in raw.items()}
    want = {i: sum(idf[w] * (tf := t.count(w)) * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(t) / avg)) for w in "hukuk dava dava".split() if w in t) for i, t in toks.items()}
    got = {r.doc: r.score for r in lexical.bm25_scores(d, q).collect()}
    assert got == pytest.approx({i: s for i, s in want.items() if s})


def test_min_max(spark):
    d = spark.createDataFrame([("a", "kanun"), ("b", "dava"), ("c", None)], "doc_id string, text string")
    q = spark.createDataFrame([("q", "kanun"), ("r", "yok"), ("s", None)], "query_id string, query string")
    assert [(r["query"], r.doc, r.norm) for r in lexical.bm25_top_normed(d, q, 5).collect()] == [("q", "a", 1.0)]
    assert lexical.bm25_top(d.limit(0), q).count() == 0 and lexical.bm25_top(d, q.limit(0)).count() == 0
    flat = spark.createDataFrame([("q", "a", 2.0), ("q", "b", 2.0)], "query string, doc string, s double")
    assert {r.x for r in lexical.min_max_candidates(flat, ["query"], "s", "x").collect()} == {1.0}


def test_dense_top_against_numpy(spark):
    r = np.random.default_rng(0)
    v = r.standard_normal((300, 8))
    v[5] = v[4]
    rows = [(i, [float(x) for x in row]) for i, row in enumerate(v)] + [(999, None)]
    vs = spark.createDataFrame(rows, "doc long, dv array<float>").repartition(4)
    qs = spark.createDataFrame(rows[:7], "query long, qv array<float>")
    got = {(x.query, x["rank"]): x.doc for x in dense.dense_top(qs, vs, 5).collect()}
    f = v.astype(np.float32).astype(np.float64)
    for q in range(7):
        s = np.round(f @ f[q], 9)
        assert [got[q, k] for k in range(1, 6)] == sorted(range(300), key=lambda i: (-s[i], i))[:5]
    assert dense.dense_top(qs.limit(0), vs, 5).count() == 0
    with pytest.raises(Exception):
        dense.checked_index(vs, 8).count()


def test_reciprocal_rank(spark):
    a = spark.createDataFrame([("q", "A", 1)], "query string, doc string, rank int")
    b = spark.createDataFrame([("q", "B", 1), ("q", "A", 2)], "query string, doc string, rank int")
    got = {r.doc: r.score for r in fusion.reciprocal_rank([a, b]).collect()}
    assert got == pytest.approx({"A": 1 / 61 + 1 / 62, "B": 1 / 61})


def test_cascade(spark):
    ch = spark.createDataFrame([(f"s_{i}", "d", f"metin {i}", "s", i) for i in range(25)] + [("t_0", "d2", "B" * 50 + "aranan uzun bir cevap metni burada durur evet", "t", 99)], "chunk_id string, doc_id string, text string, source string, ord long")
    qa = spark.createDataFrame(
        [("q1", "kısa", "s", ["yok"]), ("q2", "x", "s", ["s_3", "s_3", "yok"]), ("d", "x", "zz", []), ("q4", "aranan uzun bir cevap metni burada durur evet", "zz", []), ("q5", "x", "zz", []), ("q6", "x", "s", [])],
        "query_id string, answer string, source string, gold_ids array<string>",
    )
    pieces = spark.createDataFrame([("q1", "metin 7")], "query_id string, piece string")
    got: dict = {}
    for r in relevance.cascade(qa, ch, pieces).collect():
        got.setdefault((r.query_id, r.strategy), set()).add(r.chunk_id)
    assert got["q1", 1] == {"s_7"} and got["q2", 0] == {"s_3"} and len(got["d", 2]) == 25 and got["q4", 3] == {"t_0"}
    assert got["q6", 4] == {f"s_{i}" for i in range(20)} and len(got) == 5


def test_context_limits(spark):
    t = spark.createDataFrame([("q", 1, "s", "x" * 50), ("q", 2, "s", "y" * 5)], "query string, rank int, source string, text string")
    assert context.assemble(t, chars=30).first().n_included == 1
    assert context.assemble(t, chars=30, strict=True).first().n_included == 0
    assert context.assemble(t, chars=30, strict=True).first().context == ""


def test_neighbours_and_overlap(spark):
    ch = spark.createDataFrame([("a_0", "bir iki"), ("a_2", "iki üç"), ("a_5", "dört"), ("b_1", "tek")], "chunk_id string, text string")
    n = {r.chunk_id: (r.before, r.after) for r in context.neighbours(ch).collect()}
    assert n["a_2"] == ("a_0", "a_5") and n["b_1"] == (None, None)
    e = {r.chunk_id: r.expanded for r in context.expand_chunk(ch).collect()}
    assert e["a_2"] == "bir iki üç\ndört" and e["b_1"] == "tek"


def test_inject(spark):
    spec = "query_id string, predicted string, retrieved_chunks array<struct<text:string>>"
    rows = [("a", "Kira ödenir. Dava açılır.", [("dava açılır mahkemede",), ("ilgisiz sözler",)]), ("b", "Hiç  yok", [("ilgisiz",)]), ("c", None, None), ("d", "", [])]
    got = {r.query_id: r.answer for r in context.inject_citations(spark.createDataFrame(rows, spec)).collect()}
    assert got["b"] == "Hiç  yok" and "[Kaynak" not in got["b"] and got["c"] is None and got["d"] == ""


def test_graph(spark):
    ids = [("TMK_d1_m1", 0), ("TMK_d1_m2_0", 1), ("TMK_d1_m2_1", 2), ("TMK_d1_m4", 3), ("TMK_d1_3", 4)]
    from pyspark.sql import functions as F

    n = spark.createDataFrame([(i, "TMK", "d1", o) for i, o in ids], "id string, source string, doc_id string, ord long")
    a, p = graph.article_of(F.col("id"), F.col("source"), F.col("doc_id"))
    n = n.withColumn("article", a).withColumn("part", p)
    assert n.where("id = 'TMK_d1_3'").first().article is None
    e = {(r.src, r.dst) for r in graph.adjacency(n).collect()}
    want = {("TMK_d1_m1", "TMK_d1_m2_0"), ("TMK_d1_m1", "TMK_d1_m2_1"), ("TMK_d1_m2_0", "TMK_d1_m2_1")}
    assert e == want | {(b, a) for a, b in want}
    refs = graph.references(spark.createDataFrame([("x", "4721 sayılı Türk Medeni Kanunu Madde 5 ve m. 7")], "id string, text string")).collect()
    assert {(r.kind, r.law_no, r.article) for r in refs} == {("cross", 4721, 5), ("intra", None, 7)}


def test_expand(spark):
    r = spark.createDataFrame([("q", "a", 1.0, 1), ("q", "b", 0.5, 2)], "query string, doc string, score double, rank int")
    e = spark.createDataFrame([("a", f"n{i}", "adj") for i in range(5)] + [("b", "a", "adj"), ("a", "gone", "adj"), ("n0", "far", "adj")], "src string, dst string, kind string")
    known = spark.createDataFrame([(f"n{i}",) for i in range(5)] + [("far",), ("a",)], "doc string")
    got = {x["rank"]: (x.doc, round(x.score, 4)) for x in graph.expand(r, e, known).collect()}
    assert got == {1: ("a", 1.0), 2: ("b", 0.5), 3: ("n0", 0.85), 4: ("n1", 0.85), 5: ("n2", 0.85)}
    two = {x.doc for x in graph.expand(r, e, known, hops=2, budget=6).collect()}
    assert two == {"a", "b", *(f"n{i}" for i in range(5)), "far"}


def test_metrics(spark):
    runs = spark.createDataFrame([("q", "x", 1), ("q", "a", 2), ("q", "a", 4)], "query string, doc string, rank int")
    rel = spark.createDataFrame([("q", "a"), ("q", "b"), ("r", "z")], "query string, doc string")
    m = metrics.retrieval_metrics(runs, rel, spark.createDataFrame([("q",), ("r",), ("s",)], "query string")).first()
    assert (m.recall_at_5, m.mrr, m.precision_at_10, m.num_queries, m.total_queries) == (0.25, 0.25, 0.05, 2, 3)
    ap = metrics.average_precision(spark.createDataFrame([("q", 1, 1), ("q", 2, 0), ("q", 3, 1), ("n", 1, 0)], "query string, rank int, label int")).collect()
    assert [(r["query"], r.ap) for r in ap] == [("q", (1 + 2 / 3) / 2)]


def test_answer_scores(spark):
    rows = [("a", "18 yaşını dolduran kişi [Kaynak 1]", "18 Yaşını"), ("b", "x", ""), ("c", None, None), ("d", "a b c d", "a c d")]
    got = {r.query_id: r for r in metrics.answer_scores(spark.createDataFrame(rows, "query_id string, predicted string, expected string")).collect()}
    assert got["a"].em == 1.0 and got["b"].em == 0.0 and got["b"].f1 == 0.0 and got["c"].f1 == 1.0 and got["d"].rouge_l == pytest.approx(6 / 7)


def test_scores(spark):
    from pyspark.sql import functions as F

    v = spark.createDataFrame([(2.0,), (8.0,), (4.0,)], "x double")
    assert v.agg(metrics.geometric_mean(F.col("x")).alias("p")).first().p == 4.0
    assert v.limit(2).agg(metrics.geometric_mean(F.col("x")).alias("p")).first().p is None
    s = metrics.scenario_scores(spark.createDataFrame([(0.8, 0.5, 1.0, None, None, 0.5)], "mrr double, f1 double, faithfulness double, similarity double, relevancy double, coherence double")).first()
    assert (s.scenario1_score, s.scenario2_score, s.scenario2_fallback, s.scenario3_score) == (0.73, 0.5, True, 0.75)


def test_dedup_and_training(spark):
    rows = [("1", "Soru  Bir", "c", 1), ("2", "soru bir", "d", 0), ("3", "", "e", 2)]
    q = spark.createDataFrame(rows, "query_id string, question string, answer string, ord int")
    assert {r.query_id for r in dedup.merge_rows(q.where("ord = 1"), q.where("ord <> 1"), "question", "ord").collect()} == {"1"}
    held, rest = dedup.holdout(spark.createDataFrame([("1", "c"), ("2", "c"), ("3", None), ("4", "")], "id string, context string"), "context")
    assert {r.id for r in held.collect()} == {"1", "2"} and {r.id for r in rest.collect()} == {"3", "4"}
    runs = spark.createDataFrame([("q", f"d{i}", i) for i in range(1, 9)], "query string, doc string, rank int")
    rel = spark.createDataFrame([("q", "d2"), ("q", "zz")], "query string, doc string")
    got = {(r.doc, r.label) for r in training.reranker_pairs(runs, rel).collect()}
    assert got == {("d2", 1.0), ("zz", 1.0), ("d1", 0.0), ("d3", 0.0), ("d4", 0.0)}


def test_multiple_choice_filter(spark):
    from pyspark.sql import functions as F

    from kervan.sources.readers import OPTION

    got = {r.a: r.x for r in spark.createDataFrame([(a,) for a in ("Yalnız I", "I, II ve III", "II ve III", "İdare mahkemesi", "Sadece başvuran")], "a string").select("a", F.col("a").rlike(OPTION).alias("x")).collect()}
    assert got == {"Yalnız I": True, "I, II ve III": True, "II ve III": True, "İdare mahkemesi": False, "Sadece başvuran": False}
