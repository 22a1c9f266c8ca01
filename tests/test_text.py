from pyspark.sql import functions as F

from kervan.functions import text as T


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) if not isinstance(v, list) else F.array(*map(F.lit, v)).cast("array<string>").alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first().x


def test_turkish_lower(spark):
    assert one(spark, T.turkish_lower("s"), s="İSTANBUL IŞIK") == "istanbul ışık"
    assert one(spark, T.turkish_lower("s"), s="ğÜ") == "ğü"


def test_index_tokens(spark):
    assert one(spark, T.index_tokens("s"), s="Kanun, MADDE 12; a ığ_1") == ["kanun", "madde", "12", "ığ_1"]
    assert one(spark, T.index_tokens("s"), s=" ;; ") == []
    assert one(spark, T.index_tokens("s", ("ve",)), s="ve bir") == ["bir"]


def test_citations(spark):
    assert one(spark, T.citation_numbers("s"), s="x [Kaynak 2] y [ kaynak 1 ] [Kaynak 2]") == [2, 1]
    assert one(spark, T.strip_citations("s"), s="x [KAYNAK 2]") == "x"


def test_overlaps(spark):
    assert one(spark, T.multiset_overlap("a", "b"), a=["a", "a", "b"], b=["a", "b", "c"]) == 2
    assert one(spark, T.jaccard("a", "b"), a=["a"], b=[]) == 0
    assert one(spark, T.ngrams("a", 2), a=["x", "y", "z"]) == ["x y", "y z"]
    assert one(spark, T.ngrams("a", 4), a=["x"]) == []


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_lcs(spark):
    import random

    r = random.Random(3)
    rows = [([r.choice("abcd") for _ in range(r.randint(0, 9))], [r.choice("abcd") for _ in range(r.randint(0, 9))]) for _ in range(60)]
    got = spark.createDataFrame(rows, "a array<string>, b array<string>").select("a", "b", T.lcs_length("a", "b").alias("n")).collect()
    assert all(x.n == lcs(x.a, x.b) for x in got)


def test_judge_score(spark):
    for reply, want in (("0.7", 0.7), ("8/10", 0.8), ("4/5", 0.8), ("skor: 0.85.", 0.85), ("bilmiyorum", 0.5), ("1", 1.0), ("", 0.5)):
        assert one(spark, T.judge_score("s"), s=reply) == want, reply


def test_truncate(spark):
    assert one(spark, T.truncate_answer("s"), s="Soru: x") == "Soru: x"
    assert one(spark, T.truncate_answer("s"), s="Uzun yanıt metni. Soru: x") == "Uzun yanıt metni."


def test_falsy_and_bar(spark):
    assert one(spark, T.falsy("a", "b"), a="", b="v") == "v"
    assert one(spark, T.bar("s"), s=0.5) == "#" * 12 + "." * 12
    assert one(spark, T.percent("s"), s=0.12345) in ("12.34%", "12.35%")
    assert one(spark, T.document_of("s"), s="oricon_anayasa_000001") == "oricon_anayasa"
