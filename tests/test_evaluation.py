"""The stage runner, the corpus builder, providers and what they are made of."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kervan.functions import providers, storage
from kervan.functions import text as T
from kervan.operators import context, dense, fusion, graph, lexical, metrics, relevance, training
from kervan.plans import corpus, evaluation, stages
from kervan.sources import readers, sinks


def test_numbers_in_order(spark):
    r = random.Random(1)
    keys = [r.randrange(500) for _ in range(300)]
    got = storage.numbered(spark.createDataFrame([(k,) for k in keys], "k int").repartition(5), "k").collect()
    assert [x.k for x in sorted(got, key=lambda x: x.i)] == sorted(keys) and sorted(x.i for x in got) == list(range(300))
    assert storage.numbered(spark.createDataFrame([], "k int"), "k").count() == 0


def test_shared_folder_must_be_named_on_a_cluster(spark):
    class Cluster:
        conf = {}
        sparkContext = type("C", (), {"master": "spark://host:7077"})

    with pytest.raises(RuntimeError):
        storage.shared_dir(Cluster())


def test_lcs():
    r = random.Random(2)
    for _ in range(300):
        a, b = ([r.choice("abcd") for _ in range(r.randrange(12))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            row = _next(row, x, b)
        assert T.lcs_of(a, b) == row[-1]


def _next(row, x, b):
    out = [0]
    for j, y in enumerate(b, 1):
        out.append(row[j - 1] + 1 if x == y else max(row[j], out[-1]))
    return out


def test_judge_replies(spark):
    want = {"0.7": 0.7, "8/10": 0.8, "4/5": 0.8, "skor: 0.85.": 0.85, "bilmiyorum": 0.5, "1": 1.0, "puan 1": 1.0, "12/10": 1.0, "0.5/1 ama 9 / 10": 0.9, "": 0.5, "7": 0.5}
    got = {r.a: r.x for r in spark.createDataFrame([(a,) for a in want], "a string").select("a", T.judge_score("a").alias("x")).collect()}
    assert got == pytest.approx(want)


def test_tokenizer_is_the_expression(spark):
    texts = ["Kanun, MADDE 12; a ığ_1", " ;; ", "İSTANBUL IŞIK", "s" + "̧" + "ure x²y ab", None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.w for r in df.select("i", T.index_tokens(F.coalesce("t", F.lit(""))).alias("w")).collect()}
    assert [got[i] for i in range(len(texts))] == [T.Tokenizer()(t) for t in texts]
    assert T.Tokenizer(("kanun",), stem=T.first_letters)("kanun maddelerin") == ["madde"]


def test_stemmed_index(spark):
    d = spark.createDataFrame([("a", "kanunlar"), ("b", "dava"), ("c", "usul")], "doc_id string, text string")
    q = spark.createDataFrame([("q", "kanunu")], "query_id string, query string")
    assert lexical.bm25_top(d, q).count() == 0
    assert [r.doc for r in lexical.bm25_top(d, q, stem=T.first_letters).collect()] == ["a"]


def test_bm25_tiles_and_blocks(spark, monkeypatch):
    r = random.Random(3)
    words = [f"w{i}" for i in range(30)]
    docs = [(f"d{i:03d}", " ".join(r.choice(words) for _ in range(r.randrange(12)))) for i in range(200)]
    qs = [(f"q{i}", " ".join(r.choice(words) for _ in range(4))) for i in range(9)]
    d, q = spark.createDataFrame(docs, "doc_id string, text string").repartition(3), spark.createDataFrame(qs, "query_id string, query string")
    whole = sorted(tuple(x) for x in lexical.bm25_scores(d, q).collect())
    best = {(x["query"], x["rank"]): (x.doc, x.score) for x in lexical.bm25_top(d, q, 5).collect()}
    for i, _ in qs:
        want = sorted(((-s, doc) for qq, doc, s, _ in whole if qq == i and s > 0))[:5]
        assert [best[i, k + 1] for k in range(len(want))] == [(doc, -s) for s, doc in want]


def test_dense_blocks_and_tiles(spark, monkeypatch):
    monkeypatch.setattr(dense, "TILE_ROWS", 40)
    monkeypatch.setattr(dense, "TILE_SCORES", 300)
    v = np.random.default_rng(4).standard_normal((150, 4)).astype(np.float32)
    vs = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "doc long, dv array<float>").repartition(2)
    qs = vs.where("doc < 30").select(F.col("doc").alias("query"), F.col("dv").alias("qv"))
    got = {(x["query"], x["rank"]): x.doc for x in dense.dense_top(qs, vs, 3, same=False).collect()}
    f = v.astype(np.float64)
    for i in range(30):
        s = np.round(f @ f[i], 9)
        assert [got[i, k] for k in (1, 2, 3)] == sorted((j for j in range(150) if j != i), key=lambda j: (-s[j], j))[:3]


def test_indexes_must_cover_the_same_documents(spark):
    a, b = spark.createDataFrame([("x",), ("y",)], "doc string"), spark.createDataFrame([("x",)], "doc string")
    dense.same_documents(a, a)
    with pytest.raises(ValueError):
        dense.same_documents(a, b)


def test_index_is_built_once(spark, tmp_path):
    ch = spark.createDataFrame([("c1", "kanun metni"), ("c2", None)], "chunk_id string, text string")
    e = providers.HashEmbedder(16, model="multilingual-e5")
    first, _ = dense.load_or_build(ch, e, str(tmp_path / "i"), 16)
    again, _ = dense.load_or_build(ch.limit(0), e, str(tmp_path / "i"), 16)
    assert first.count() == again.count() == 2
    v = {r.chunk_id: np.array(r.embedding) for r in again.collect()}
    assert np.linalg.norm(v["c1"]) == pytest.approx(1) and v["c2"].any()  # the prefix is a word too


def test_multi_vector_scores(spark):
    m = providers.HashMultiVector()
    df = spark.createDataFrame([("q", "d1", 0.9, "kanun madde", "kanun madde kanun"), ("q", "d2", 0.9, "kanun madde", "dava"), ("q", "d3", 0.1, "kanun madde", None)], "query string, doc string, score double, a string, b string")
    c = df.select("query", "doc", "score", m.sparse(F.col("a")).alias("q_sparse"), m.sparse(F.col("b")).alias("d_sparse"), m.words(F.col("a")).alias("q_words"), m.words(F.col("b")).alias("d_words"))
    s = {r.doc: r.x for r in c.select("doc", providers.sparse_score(F.col("q_sparse"), F.col("d_sparse")).alias("x")).collect()}
    assert s == pytest.approx({"d1": 0.5 * 2 / 3 + 0.5 / 3, "d2": 0.0, "d3": 0.0})
    late = {r.doc: r.x for r in c.select("doc", providers.late_interaction("q_words", "d_words").alias("x")).collect()}
    dot = lambda a, b: float(np.dot(providers.word_vector(a), providers.word_vector(b)))
    assert late == pytest.approx({"d1": 1.0, "d2": (dot("kanun", "dava") + dot("madde", "dava")) / 2, "d3": 0.0})
    assert [r.doc for r in fusion.multi_vector(c).orderBy("rank").collect()][0] == "d1"


def test_generator_errors_stay_with_their_rows(spark):
    def fails(q, c):
        raise RuntimeError("kapalı")

    r = spark.createDataFrame([("s", "c")], "q string, c string").select(providers.generator(fails)("q", "c").alias("x")).first().x
    assert r.answer == "" and "kapalı" in r.error
    assert spark.range(1).select(providers.prompt(F.lit("Soru?"), F.lit("[Kaynak 1]"), "short").alias("p")).first().p.endswith("Soru: Soru?")


def test_perplexity(spark):
    c = providers.unigram_costs(spark.createDataFrame([("kanun kanun dava",), (None,)], "text string"))
    got = {r.query_id: r.perplexity for r in providers.perplexities(spark.createDataFrame([("a", "kanun yeni"), ("b", "")], "query_id string, predicted string"), c).collect()}
    assert got == pytest.approx({"a": math.exp((math.log(6 / 3) + math.log(6 / 1)) / 2)})


def test_triplets(spark):
    ch = spark.createDataFrame([(f"d{i}", f"metin {i}", "s" if i < 5 else "t") for i in range(40)], "doc string, text string, source string")
    ranked = spark.createDataFrame([("q", f"d{i}", 1.0 - i / 100, i + 1) for i in range(10)] + [("r", "d1", 0.1, 1)], "query string, doc string, score double, rank int")
    got = training.triplets(spark.createDataFrame([("q", "Soru?"), ("r", "Yok?")], "query string, question string"), ranked, spark.createDataFrame([], "query string, doc string"), ch).collect()
    assert len(got) == 1 and got[0].pos == ["metin 0"] and len(got[0].neg) == 7 == len(set(got[0].neg)) and "metin 0" not in got[0].neg
    assert got[0].neg[:5] == [f"metin {i}" for i in range(5, 10)]
    flat = training.embedder_columns(spark.createDataFrame([("q", "p", "n")], "query string, positive_passage string, negative_passage string")).first()
    assert (flat.anchor, flat.positive, flat.negative) == ("q", "p", "n")


def test_jaccard_against_brute_force(spark):
    r = random.Random(5)
    words = [f"w{i}" for i in range(25)]
    texts = [(f"d{i:02d}", i, " ".join(r.choice(words) for _ in range(r.randrange(0, 15)))) for i in range(60)]
    asked = [(f"q{i}", " ".join(r.choice(words) for _ in range(r.randrange(0, 12)))) for i in range(20)]
    got = {x["query"]: (x.doc, x.score) for x in training.best_by_jaccard(spark.createDataFrame(asked, "query string, text string"), spark.createDataFrame(texts, "doc string, ord int, text string")).collect()}
    for q, t in asked:
        a = set(t.split())
        s = sorted((-round(len(a & b) / len(a | b), 9), o, d) for d, o, x in texts if (b := set(x.split())) and a)
        want = (s[0][2], -s[0][0]) if s and -s[0][0] >= 0.3 else None
        assert got.get(q) == want


def test_needles(spark, monkeypatch):
    monkeypatch.setattr(relevance, "NEEDLES", 2)
    docs = spark.createDataFrame([("a", "bir iki üç"), ("b", None), ("c", "iki")], "id string, text string")
    needles = spark.createDataFrame([("iki",), ("ir i",), ("yok",), (None,), ("",), ("iki",)], "needle string")
    assert sorted(tuple(r) for r in relevance.holding(docs, needles).collect()) == [("a", "iki"), ("a", "ir i"), ("c", "iki")]


def test_references_and_laws(spark):
    assert graph.references_of("4721 sayılı Türk Medeni Kanunu Madde 5 ve m. 7") == [("cross", 4721, "Türk Medeni", 5), ("intra", None, None, 7)]
    assert graph.references_of("99 sayılı Uzun Adlı ve Çok Sözcüklü Bir Düzenlemenin Kısa Yasası uyarınca 12 nci madde")[0][:2] == ("cross", 99)
    laws = spark.createDataFrame([(4721, "Türk Medeni Kanunu"), (None, "İş Kanunu"), (None, "Türk Ceza Kanunu")], "law_no int, source string")
    named = spark.createDataFrame([(4721, "x"), (1, "İş"), (2, "Ceza"), (3, "Yok")], "law_no int, law_name string")
    assert {r.law_no: r.law_source for r in graph.law_sources(named, laws).collect()} == {4721: "Türk Medeni Kanunu", 1: "İş Kanunu", 2: "Türk Ceza Kanunu", 3: None}
    ch = spark.createDataFrame(
        [("A_d_m1", "Türk Medeni Kanunu", "d", "Madde 2 uygulanır", 0), ("A_d_m2", "Türk Medeni Kanunu", "d", "x", 1), ("B_e_m2", "İş Kanunu", "e", "4721 sayılı Medeni Kanunu m. 2", 0)],
        "id string, source string, doc_id string, text string, ord long",
    ).withColumn("article", F.regexp_extract("id", r"m(\d+)$", 1).cast("int"))
    got = {(r.src, r.dst, r.kind) for r in graph.build_graph(ch, laws).collect()}
    assert {("A_d_m1", "A_d_m2", "intra"), ("B_e_m2", "A_d_m2", "cross"), ("A_d_m1", "A_d_m2", "adj")} <= got


def test_corpus_and_question_sets(spark, tmp_path):
    body = lambda c: c * 200
    rows = spark.createDataFrame([(str(i), "s?", "c", body(t), "law", None, None, "kaggle", i) for i, t in enumerate(["x", "y", "x", "z"])] + [("9", "s?", "c", None, "law", None, None, "train", 9)], "id string, question string, answer string, context string, source string, data_type string, score double, split string, ord int")
    own = rows.where("split = 'kaggle'")
    assert corpus.build_corpus(own, held_out=0).count() == 3
    held = {r.query_id for r in corpus.evaluation_rows(own, 1).collect()}
    assert len(held) in (1, 2) and corpus.build_corpus(own, held_out=1).count() == 2
    extra = spark.createDataFrame([("k", "law", body("x"), 0), ("l", "law", body("w"), 1)], "doc_id string, source string, text string, ord int")
    assert {r.doc_id for r in corpus.build_corpus(own, extra, 0).collect()} == {"0", "1", "3", "l"}
    (tmp_path / "extra.jsonl").write_text(json.dumps({"text": body("v"), "source": "s", "doc_id": "e"}) + "\n")
    n = corpus.prepare(spark, rows, str(tmp_path / "out"), extra_laws=str(tmp_path / "extra.jsonl"))
    assert n == {"corpus_chunks": 1, "qa_eval": 4, "qa_train": 1}  # all contexts are held out
    qs, short, ending = readers.question_set(spark, "kaggle", str(tmp_path / "out"))
    assert (qs.count(), short, ending) == (4, False, "")
    with pytest.raises(ValueError):
        readers.question_set(spark, "custom", "")
    with pytest.raises(ValueError):
        readers.question_set(spark, "other", "")
    (tmp_path / "gold.json").write_text(json.dumps([{"question_id": "1", "question": "s", "gold_answer_extract": "c", "gold_sources": [{"source_id": "kanun"}]}]))
    got, short = readers.read_external(spark, str(tmp_path / "gold.json"))
    assert short and got.first().source == "kanun"
    both = readers.instruction_splits({"a": spark.createDataFrame([("i", "o")], "instruction string, output string"), "b": spark.createDataFrame([("q", "a")], "question string, answer string")})
    assert {(r.question, r.split) for r in both.collect()} == {("i", "a"), ("q", "b")}


def test_resume_up_to_the_first_broken_line(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text('{"query_id": "1", "x": "a"}\n\n{"query_id": "2", "x": "b"}\n{"query_id": "3", "x"\n{"query_id": "4", "x": "c"}\n')
    assert [r.query_id for r in sinks.resume_jsonl(spark, str(tmp_path / "p.jsonl"), "query_id string, x string").collect()] == ["1", "2"]


def test_run_of_stages(spark, tmp_path):
    r = random.Random(6)
    words = [f"kelime{i}" for i in range(60)]
    texts = [" ".join(r.choice(words) for _ in range(20)) + "." for _ in range(40)]
    ch = spark.createDataFrame([(f"c_{i}", "c", t, "kanun") for i, t in enumerate(texts)], "chunk_id string, doc_id string, text string, source string")
    qs = spark.createDataFrame([(f"q{i}", " ".join(texts[i].split()[:6]), texts[i], "kanun") for i in range(6)] + [("q9", None, None, None)], "query_id string, question string, expected string, expected_source string")
    rel = spark.createDataFrame([(f"q{i}", f"c_{i}") for i in range(6)], "query string, doc string")
    edges = spark.createDataFrame([("c_0", "c_1", "adj")], "src string, dst string, kind string")
    done, said = evaluation.run_stages(["rrf", "graph", "full", "none"], ch, qs, rel, edges=edges, limit=7)
    assert set(done) == {"rrf", "graph"} and len(said) == 2
    m = done["rrf"]["metrics"].first()
    assert m.hit_at_10 == 1.0 and m.total_queries == 7 and m.f1 > 0.8 and m.citation_accuracy > 0 and m.scenario1_score > 0.5 and m.retrieval_mode == "rrf"
    p = {x.query_id: x for x in done["rrf"]["predictions"].collect()}
    assert len(p) == 7 and "[Kaynak 1]" in p["q0"].predicted and p["q0"].error is None
    failed = evaluation.predictions(done["rrf"]["run"], ch, qs, lambda q, c: F.lit(None).cast("string")).collect()
    assert len(failed) == 7 and {(x.predicted, x.error) for x in failed} == {("", "no answer")}
    sinks.save_metrics(done["rrf"]["metrics"], str(tmp_path / "m.json"), limit=7)
    assert json.loads((tmp_path / "m.json").read_text())["limit_value"] == 7
    table = sinks.ablation_table(done["graph"]["metrics"].unionByName(done["rrf"]["metrics"]), list(stages.STAGES)).orderBy("place").collect()
    assert [x.line.split(" | ")[0] for x in table] == ["| rrf", "| graph"]
    assert "| Recall@10 | " in sinks.markdown_report(done["rrf"]["metrics"], "Rapor")


def test_texts_joined_at_their_overlap():
    assert context.joined("bir iki", "iki üç") == "bir iki üç" and context.joined("a", "b") == "a\nb" and context.joined("", "b") == "\nb"


def test_summary_of_no_answers(spark):
    spec = "query_id string, predicted string, expected string, retrieved_sources array<string>, expected_source string"
    r = metrics.answer_summary(spark.createDataFrame([], spec)).first()
    assert (r.em, r.f1, r.bleu, r.citation_accuracy, r.num_samples) == (0.0, 0.0, 0.0, 0.0, 0)
