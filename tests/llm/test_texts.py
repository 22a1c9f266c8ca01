"""Problems 1, 2, 4 and 6."""

import random
import re

import duckdb
import pyarrow as pa
import pytest

from kervan.llm import answer_defects as A
from kervan.llm import common_form as C
from kervan.llm import encoding as E
from kervan.llm import splitting as S


def form(s):
    return C.form_array(pa.array([s], pa.string()))[0].as_py()


@pytest.mark.parametrize(
    "seen, want",
    [
        ("ｍａｄｄｅ　１２", "madde 12"), ("s" + "̧" + "üre", "şüre"), ("ka­r​ar﻿", "karar"), ("a b c", "a b c"), ("kаrаr", "karar"), ("i̇s", "is"), ("İ", "İ"),
        ("menﬁ", "menfi"), ("e‑posta", "e-posta"), ("g‌̆", "ğ"), ("ｓ̧", "ş"), ("Ⅻ. 𝐀𝑏 ｶﾞ", "XII. Ab ガ"), ("a\r\nb\rc", "a\nb\nc"), (None, None), ("", ""), ("düz metin", "düz metin"),
    ],
)
def test_common_form(seen, want):
    assert form(seen) == want


def test_different_looks_stay_different():
    for a, b in (("120 m²", "120 m2"), ("Işık", "ışık"), ("kırk", "kirk"), ("kâr", "kar"), ("MADDE", "madde"), ("–", "-"), ("“a”", '"a"'), ("a\nb", "a b"), ("é", "e"), ("①", "1"), ("½", "1/2")):
        assert form(a) != form(b)


def test_form_is_stable():
    r = random.Random(5)
    marks = "̧̆̇̈​ ­ａＢ１аеоﬁιν"
    for _ in range(200):
        s = "".join(r.choice("ığabIİ s" + marks) for _ in range(r.randint(0, 12)))
        assert form(form(s)) == form(s)


def test_common_form_frame(spark):
    rows = [(1, "a​", "x", "t"), (1, "a​", "x", "t"), (2, None, None, None), (3, "", "", ""), (4, "ｂ" * 300_000, "y", "z")]
    df = spark.createDataFrame(rows, "id int, `te.xt` string, `__text` string, form string")
    got = {r.id: r.form for r in C.common_form(df, "te.xt", "form").collect()}
    assert got == {1: "a", 2: None, 3: "", 4: "b" * 300_000}
    assert C.common_form(df, "te.xt", "form").count() == 5 and C.common_form(df, "te.xt", "form").columns == ["id", "te.xt", "__text", "form"]
    assert {r.form for r in C.common_form(df, "form", "form").collect()} == {"t", None, "", "z"}
    assert C.common_form(df.limit(0), "te.xt").count() == 0


def test_lookalike_pairs(spark):
    rows = [("k1", "kаrar"), ("k2", "karar"), ("k3", "karar"), ("k3", "karar"), ("k4", "KARAR"), ("k5", None), (None, "karar​"), ("k6", "başka"), ("k7", "")]
    h = C.form_hashes(spark.createDataFrame(rows, "key string, t string"), "key", "t", "tbl")
    assert {(r.key_a, r.key_b) for r in C.lookalike_pairs(h).collect()} == {("k1", "k2"), ("k1", "k3")}
    assert C.lookalike_pairs(h.limit(0)).count() == 0
    assert {(r.key_a, r.key_b) for r in C.lookalike_pairs(h, 1).collect()} == {("k1", "k2"), ("k1", "k3")}
    hot = C.form_hashes(spark.createDataFrame([(f"k{i:03d}", "karar" + "\u200b" * (i % 3)) for i in range(300)], "key string, t string"), "key", "t", "tbl")
    star = C.lookalike_pairs(hot, 1000).collect()
    assert len(star) <= 300 and {k for r in star for k in (r.key_a, r.key_b)} == {f"k{i:03d}" for i in range(300)}
    assert C.lookalike_pairs(hot).count() == 3 * 100 * 100


@pytest.mark.parametrize("block", [1024, 37])
def test_all_lookalike_pairs_of_a_hot_form(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(C, "BLOCK", block)
    hot = [(f"k{i:03d}", "karar" + "\u200b" * (i % 4)) for i in range(400)]  # 60,000 pairs out of 79,800
    # records with two texts of one form or of two forms, as the SQL has them
    odd = [("k000", "karar"), ("k001", "karar"), ("x1", "başka"), ("x1", "kаrar"), ("x2", "başka\u200b"), ("x2", "karar"), ("x3", "başka"), ("x3", "karar"), (None, "karar"), ("x4", None)]
    for table, names in (("qa_examples", "query_id string, question string"), ("corpus_chunks", "chunk_id string, text string")):
        spark.createDataFrame(hot + odd, names).repartition(3).write.parquet(f"{tmp_path}/{table}.parquet")
    got = sorted((r.src_table, r.key_a, r.key_b) for r in C.p1_found(spark, str(tmp_path)).collect())
    with duckdb.connect() as con:
        for table in ("qa_examples", "corpus_chunks"):
            con.execute(f"CREATE VIEW {table} AS FROM '{tmp_path}/{table}.parquet/*.parquet'")
        assert got == sorted(con.execute(C.p1_found_sql()).fetchall()) and len(got) > 120_000


def plain_kind(text, limit):
    pats = [r"\n\s*\n", r"\n", r"(?<=[.!?])\s|\n", r"\s"]
    for n, p in zip(["paragraph", "line", "sentence", "word"], pats):
        if max(len(q.strip()) for q in re.split(p, text)) <= limit:
            return n
    return "none"


def table_of(text):
    codes = S._codes(text)
    return S.boundary_table(codes, 0, len(codes), True, True)


def mixed(r, n, words):
    return "".join(r.choice(words) for _ in range(n))


def test_boundaries_against_brute_force():
    r = random.Random(2)
    for _ in range(300):
        text = mixed(r, r.randint(1, 40), ["kelime", "x" * 30, " ", " ", ". ", "\n", "\n\n", "\n \n", "!", "  "])
        assert S.sufficient([table_of(text)], 40) == plain_kind(text, 40)


def test_boundaries_by_ranges(spark, monkeypatch):
    monkeypatch.setattr(S, "TASKS", 3)
    r = random.Random(7)
    words = ["kelimeğ", "x" * 30, " ", " ", ". ", "\n", "\n\n", "\n \n", "!", "  ", "ş" * 25, " " * 700, "€ "]
    texts = [mixed(r, r.randint(30, 400), words) for _ in range(40)] + [" " * 3000, "y" * 2500]
    df = spark.createDataFrame([(f"k{i}", t) for i, t in enumerate(texts)] + [("k0", texts[0]), (None, texts[0]), ("n", None)], "key string, text string").repartition(2)
    want = {f"k{i}": plain_kind(t, 40) for i, t in enumerate(texts) if len(t) > 40}
    for size in (64, 1000, 1 << 20):
        rows = S.boundary_kinds(df, "key", "text", 40, size).collect()
        assert {x.key: x.boundary for x in rows} == want and len(rows) == len(want), size


def test_pieces_cover_the_text():
    r = random.Random(3)
    for _ in range(200):
        text = "".join(r.choice(["kelime", "x" * 70, " ", " ", ". ", "\n", "\n\n", "a"]) for _ in range(r.randint(1, 120)))
        got = S.pieces(S._codes(text), 60, 12)
        covered = "".join(text[a:b] if i == 0 else text[max(a, got[i - 1][1]) : b] for i, (a, b, _) in enumerate(got))
        assert re.sub(r"\s", "", covered) == re.sub(r"\s", "", text)
        for (a, b, _), (a2, b2, _) in zip(got, got[1:]):
            assert b - a <= 60 and a < a2 and b < b2 and b - a2 <= 12


def test_split_frames(spark):
    rows = [("a", "x " * 1000), ("a", "x " * 1000), ("b", None), ("c", ""), ("d", "z" * 1401), (None, "y " * 900), ("e", " " * 2000), ("f", "kısa")]
    df = spark.createDataFrame(rows, "key string, text string")
    assert {(r.key, r.boundary) for r in S.boundary_kinds(df, "key", "text").collect()} == {("a", "word"), ("d", "none"), ("e", "paragraph")}
    got = S.split_texts(df, "key", "text").collect()
    assert {r.key for r in got} == {"a", "d"} and all(len(r.piece) <= 1400 for r in got)
    assert S.split_texts(df.limit(0), "key", "text").count() == 0


def test_split_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "TASKS", 3)
    r = random.Random(4)
    text = "  " + mixed(r, 3000, ["kelimeğ", "ş" * 90, " ", " ", ". ", "\n", "\n\n", "€ "]) + " \n"
    odd = mixed(r, 400, ["kelime", "z" * 900, " ", " " * 2500, "\n" * 4000, ". "]) + " " * 20_000
    for name, t in (("a", text), ("b", "kısa"), ("c", ""), ("d", odd)):
        (tmp_path / f"{name}.txt").write_text(t, encoding="utf-8")
    for fan in (256, 4):  # with 4, the tables are composed in several rounds
        monkeypatch.setattr(S.entries_of, "__defaults__", (fan,))
        got = S.split_files(spark, [str(tmp_path / f"{x}.txt") for x in "abcd"], 80, 15, 1).orderBy("path", "piece_no").collect()
        for name, t in (("a", text), ("d", odd)):
            mine = [(x.piece_no, x.start, x.end, x.piece) for x in got if x.path.endswith(f"{name}.txt")]
            assert mine == [(i, a, b, t[a:b]) for i, (a, b, _) in enumerate(S.pieces(S._codes(t), 80, 15))]
        assert [x.piece for x in got if x.path.endswith("b.txt")] == ["kısa"] and not [x for x in got if x.path.endswith("c.txt")]


def test_texts_are_split_as_files_are(spark, monkeypatch):
    monkeypatch.setattr(S, "TASKS", 3)
    r = random.Random(5)
    texts = {f"k{i}": mixed(r, r.randint(20, 3000), ["kelimeğ", "ş" * 90, " ", " ", ". ", "\n", "\n\n"]) for i in range(12)}
    df = spark.createDataFrame([*texts.items(), ("k0", texts["k0"])], "key string, text string").repartition(3)
    got = S.split_texts(df, "key", "text", 80, 15, 1).collect()
    assert sorted((x.key, x.piece_no, x.start, x.end, x.piece) for x in got) == sorted((k, i, a, b, t[a:b]) for k, t in texts.items() if len(t) > 80 for i, (a, b, _) in enumerate(S.pieces(S._codes(t), 80, 15)))


Q = "9627 sayılı Kanun kapsamında kiracının bağışı 138 gün geciktirmesi hâlinde açık rızanın bulut hizmetine etkisi nedir ve ek veri aktarımı sona erer mi?"


@pytest.mark.parametrize(
    "answer, want",
    [
        (None, "empty"), ("", "empty"), (" ​\n", "empty"), ("N/A", "empty"), ("<p></p>", "empty"), ("Cevap:", "empty"), ("...", "empty"), ("Bilmiyorum.", "refusal"), ("Üzgünüm, bu soruya yardımcı olamıyorum.", "refusal"),
        ("I'm sorry, but I can't help with that request.", "refusal"), ("Vekil yardımcı olamayacağını bildirirse dosya başkasına verilir.", None), (Q, "copy"), ("Soru: " + Q.upper(), "copy"),
        ("“" + Q + "” sorusuna gelince; kiracının itirazı süresinde yapılmış sayılır ve bu karar ilgili kurumca yazıyla bildirilir, ayrıca masraflar paylaşılır, dosya da üst makama gönderilir.", None),
        ("Der Anspruch erlischt nach 61 Tagen, wenn die Stelle den Antrag nicht geprüft hat.", "language"), ("Çeviri metninde “The court weighs the objection of the party” denilmektedir; itiraz süresinde yapılmış sayılır.", None),
        ("Bu itirazın ispatı kiracıya düşer; belge sunulmamışsa 10 günlük kesin sürenin (", "truncated"), ("Yönetim kurulu", None), ("346 gün", None), ("27 yıl; kısmi lisans bedeli varsa 33 yıl", None), ("Kira bedeli ve teminat iade edilir [Kaynak 2].", None),
        ("GeÃ§ici kira bedeli iÃ§in itiraz sÃ¼resi 10 gÃ¼n olup sonradan uzatÄ±lmaz.", None),
    ],
)
def test_defects(answer, want):
    assert A.defect(Q, answer)[0] == want


def test_copy_coverage():
    assert A.SuffixAutomaton("a b c d e".split()).walk("x a b c y d e".split(), 2) == (5, {0, 1, 2, 3, 4})
    r = random.Random(6)
    for _ in range(200):
        q, a = ([r.choice("abc") for _ in range(r.randint(0, 12))] for _ in range(2))
        inside = set()
        for i in range(len(a)):
            for j in range(i + 3, len(a) + 1):
                if any(q[k : k + j - i] == a[i:j] for k in range(len(q))):
                    inside |= set(range(i, j))
        assert A.SuffixAutomaton(q).walk(a, 3)[0] == len(inside)


def test_truncation_by_endings(spark):
    full = [(f"f{i}", "Soru nedir?", f"Kurul {i} sayılı itirazı inceler ve sonucu ilgili kişiye yazıyla bildirir.") for i in range(30)]
    rows = full + [("cut", "Soru nedir?", "Kurul 7 sayılı itirazı inceler ve sonucu ilgili kişiye yaz"), ("nodot", "Soru nedir?", "Kurul 8 sayılı itirazı inceler ve sonucu ilgili kişiye yazıyla bildirir"), ("none", None, None), ("none", None, None)]
    df = spark.createDataFrame(rows, "query_id string, question string, answer string")
    assert {(r.query_id, r.defect) for r in A.defects(df).collect()} == {("cut", "truncated"), ("none", "empty")}
    assert A.defects(df.limit(0)).count() == 0


@pytest.mark.parametrize("right, wrong", E.PAIRS[:2] + E.PAIRS[6:13])
def test_round_trip(right, wrong):
    text = "Kesin sürenin ardından mahkeme, iş güvenliği eğitiminin ücretini öngörülen çağrıyla bildirir; Şirket İdaresi itiraz eder."
    seen = E.decoded(text.encode(right), wrong) if right == "cp1254" else "".join(E.decoded(c.encode(right), wrong) if ord(c) > 127 else c for c in text)
    assert seen != text and E.restored(seen, E.label(seen)) == text


def test_clean_texts_have_no_label():
    for t in ("Þorvík Ýmisfélag unvanı aynen geçirilir.", "“Θαλασσίς ΑΕ” ibaresi", "Ðalvegur þing", "São Brandelão Lda", "Äänelä Oy", "Грузовик-Т", "Łękowiak", "kişiуi aşan", "120 m² ve 5 °C – § 3", "", "abc", "لا يجوز"):
        assert E.label(t) == [], t
    assert E.label("enc�menin")[0][2] == -1


def test_garbled_frame(spark):
    bad = "gÃ¶revini devreder "
    df = spark.createDataFrame([("a", bad), ("a", bad), ("b", None), ("c", ""), ("d", bad * 6000), (None, bad)], "key string, text string")
    got = {r.rec_key: r for r in E.garbled(df, "key", "text").collect()}
    assert set(got) == {"a", "d"} and got["a"].restored == "görevini devreder " and got["d"].restored == "görevini devreder " * 6000 and got["a"].encodings == ["utf-8>cp1252"]
    assert E.garbled(df.limit(0), "key", "text").count() == 0


def test_only_a_stray_lead_byte(spark):
    bad = {"a": ("maddeÂ\xa05", "madde\xa05"), "b": ("5Â°C", "5°C"), "c": ("Â§ 12", "§ 12"), "d": ("12 mÂ², Â«asılÂ» 3Â½", "12 m², «asıl» 3½")}
    good = {"x": "madde\xa05", "y": "5 °C ve § 12", "z": "«SEVDÂ» ile «Â» harfi, hâkim, Âli Â. 3", "v": "В\xa0Москве"}
    df = spark.createDataFrame([(k, v[0]) for k, v in bad.items()] + list(good.items()), "key string, text string")
    assert {r.rec_key: r.restored for r in E.garbled(df, "key", "text").collect()} == {k: v[1] for k, v in bad.items()}


def test_long_refusals_and_long_answers():
    sorry = "Üzgünüm, bu konuda size özel bir hukuki tavsiye veremem çünkü dosyanın içeriğini ve ilgili belgeleri görmeden sağlıklı bir değerlendirme yapmak mümkün değil. "
    refer = "Somut olayın bütün ayrıntıları bilinmeden bu soruya yanıt veremem, bu nedenle en yakın baroya veya bir avukata başvurmanız daha doğru olur."
    answer = "Dava süresi tebliğden itibaren otuz gündür. Süre hak düşürücüdür ve hâkim tarafından kendiliğinden gözetilir. Dilekçe yetkili mahkemeye verilir ve harç aynı gün yatırılır. Ayrıntı hakkında bilgim yok."
    q = "Dava açma süresi ne kadardır?"
    assert A.defect(q, sorry + refer)[0] == "refusal" and A.defect(q, answer + " İtiraz da aynı süreye bağlıdır ve üst mahkeme tarafından incelenir.")[0] != "refusal"


def test_a_long_text_is_one_path(monkeypatch):
    r = random.Random(8)
    t = "".join(r.choice(["hÃ¼kmÃ¼ ", "sÃ¼re ", "şöyle ", "kararı\xa0", "ÅŸirket ", "iş ", "x" * 40 + " "]) for _ in range(15_000))
    whole = E.label(t)
    monkeypatch.setattr(E, "SETTLE", 50)
    assert E.label(t) == whole and len(t) > 100_000 and E.restored(t, whole) == t.replace("Ã¼", "ü").replace("ÅŸ", "ş")
