"""Problem 1: one form for texts that look the same.

The rules live in one SQL expression that DuckDB evaluates inside Arrow partitions:
invisible characters go, blanks become the ordinary space, full-width forms, ligatures and
look-alike letters become the ordinary ones, accents are composed (NFC). Letter case, visible
accents and dots and raised digits stay as they are.
"""

from __future__ import annotations

import functools
import unicodedata

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kervan.llm.util import cut_lineage, first_of_key

# Letters of other scripts that are drawn like a Latin letter.
LOOKALIKES = {
    # Cyrillic
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s",
    "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "ҫ": "ç", "ӧ": "ö", "ё": "ë", "ї": "ï",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T",
    "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S", "У": "Y", "Ү": "Y", "Ӧ": "Ö", "Ё": "Ë", "Ї": "Ï", "Ҫ": "Ç",
    # Greek
    "ν": "v", "ο": "o", "ρ": "p", "ι": "ı", "ϲ": "c", "ϳ": "j", "ό": "ó",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O",
    "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    # Armenian
    "ո": "n", "ս": "u", "օ": "o", "հ": "h", "ց": "g", "զ": "q", "յ": "j", "Օ": "O", "Տ": "S", "Ս": "U",
    # Latin variants and hyphens
    "ɑ": "a", "ɡ": "g", "‐": "-", "‑": "-",
}
#: Kinds of compatibility forms that look like what they stand for: wide, narrow and styled letters. Raised, circled, squared ones and fractions look different.
ALIKE = ("<wide>", "<narrow>", "<font>")


@functools.cache
def compatible() -> tuple[dict[str, str], dict[str, str]]:
    """(one character -> one, one character -> several) of the compatibility forms of Unicode that look like what they stand for:
    those of the kinds ALIKE, Roman numerals, and Latin letters drawn joined."""
    one, more = {}, {}
    for c in range(0x110000):
        ch = chr(c)
        kind = unicodedata.decomposition(ch).split(" ")[0]
        if kind in ALIKE or kind == "<compat>" and (0x2160 <= c < 0x2180 or 0xFB00 <= c < 0xFB07):
            to = unicodedata.normalize("NFKC", ch)
            (one if len(to) == 1 else more)[ch] = to
    return one, more


# Ranges of characters without ink, as RE2 writes them.
INVISIBLE = (
    r"\x{0}-\x{8}\x{E}-\x{1F}\x{7F}-\x{84}\x{86}-\x{9F}\x{AD}\x{34F}\x{61C}\x{115F}\x{1160}\x{17B4}\x{17B5}"
    r"\x{180B}-\x{180F}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{FE00}-\x{FE0F}\x{FEFF}"
    r"\x{FFF9}-\x{FFFB}\x{1D173}-\x{1D17A}\x{E0000}-\x{E0FFF}"
)
BLANKS = "\t  " + "".join(map(chr, range(0x2000, 0x200B))) + "  ⠀　ㅤﾠ"
BREAKS = "\x0b\x0c\x85  "


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


@functools.cache
def _one_to_one() -> tuple[str, str]:
    named = {b: " " for b in BLANKS} | {b: "\n" for b in BREAKS} | LOOKALIKES
    pairs = [*named.items(), *((a, LOOKALIKES.get(b, b)) for a, b in compatible()[0].items() if a not in named)]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def sql_form(column: str) -> str:
    """The common form of a column as a DuckDB expression; null stays null, and text of plain characters is not touched."""
    a, b = _one_to_one()
    x = f"regexp_replace(replace({column}, chr(13) || chr(10), chr(10)), '[{INVISIBLE}]', '', 'g')"
    x = f"translate(replace({x}, chr(13), chr(10)), {_q(a)}, {_q(b)})"
    for sign, letters in compatible()[1].items():
        x = f"replace({x}, {_q(sign)}, {_q(letters)})"
    # the letters' own dot hides further ones; what is left may compose with the next mark
    x = f"regexp_replace(regexp_replace(nfc_normalize({x}), 'ı\\x{{307}}+', 'i', 'g'), '([ij])\\x{{307}}+', '\\1', 'g')"
    x = f"nfc_normalize({x})"
    return f"CASE WHEN regexp_full_match({column}, '[{PLAIN}]*') THEN {column} ELSE {x} END"


# Characters that stand for themselves: ASCII with line feed, the Latin letters and signs, and usual punctuation.
PLAIN = r"\x{A}\x{20}-\x{7E}\x{A1}-\x{AC}\x{AE}-\x{24F}\x{2012}-\x{2027}"


@functools.cache
def plain_table() -> np.ndarray:
    """plain_table()[c]: the character stands for itself, as PLAIN says. The last entry is for all higher ones."""
    t = np.zeros(0x3001, dtype=bool)
    for lo, hi in ((0xA, 0xA), (0x20, 0x7E), (0xA1, 0xAC), (0xAE, 0x24F), (0x2012, 0x2027)):
        t[lo : hi + 1] = True
    return t


@functools.cache
def connection() -> duckdb.DuckDBPyConnection:
    """One single-threaded DuckDB per Python worker."""
    return duckdb.connect(config={"threads": 1, "memory_limit": "1GB", "temp_directory": ""})


def run_sql(sql: str, **tables: pa.Table) -> pa.Table:
    con = connection()
    for name, t in tables.items():
        con.register(name, t)
    try:
        got = con.sql(sql).arrow()
        return got.read_all() if isinstance(got, pa.RecordBatchReader) else got
    finally:
        for name in tables:
            con.unregister(name)


def byte_slices(texts: pa.Array, most: int = 8_000_000):
    """(from, to) of runs of texts of at most so many bytes; a longer text goes alone."""
    size = pc.binary_length(texts.fill_null("")).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.concatenate([[0], np.cumsum(size)])
    lo = 0
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + most, side="right")) - 1)
        yield lo, hi
        lo = hi


def form_array(texts: pa.Array) -> pa.Array:
    """Common form of a string array, in its order."""
    parts = []
    for lo, hi in byte_slices(texts):
        t = pa.table({"i": pa.array(np.arange(hi - lo, dtype=np.int32)), "t": texts.slice(lo, hi - lo)})
        parts += run_sql(f"SELECT {sql_form('t')} AS t FROM x ORDER BY i", x=t).column("t").cast(pa.string()).chunks
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


def common_form(df: DataFrame, column: str, out: str = "common_form") -> DataFrame:
    """df with the common form of a text column added (replaced, if `out` exists).

    Null gives null, empty text gives empty text, texts of any length are taken whole. Rows are neither
    dropped nor merged, ties and repeated rows stay, other columns pass through whatever their names.
    """
    kept = [c for c in df.columns if c != out]
    schema = df.select(*[F.col(f"`{c}`") for c in kept], F.lit("").cast("string").alias(out)).schema
    schema[out].nullable = True
    at = kept.index(column) if column in kept else len(kept)
    src = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept if at < len(kept) else [*kept, column])])

    def apply(batches):
        for b in batches:
            arrays = b.columns
            form = form_array(arrays[at])
            yield pa.RecordBatch.from_arrays([*arrays[: len(kept)], form], names=[*kept, out])

    return src.mapInArrow(apply, schema)


HASHED = "src_table string, key string, form_hi bigint, form_lo bigint, raw_hi bigint"


def form_hashes(df: DataFrame, key: str, column: str, name: str) -> DataFrame:
    """(src_table, key, form hash of 128 bits, hash of the text as stored); rows with null text or key are left out."""
    sql = f"""
        SELECT {_q(name)} AS src_table, k AS key, md5_number_upper(f)::BIT::BIGINT AS form_hi,
               md5_number_lower(f)::BIT::BIGINT AS form_lo, md5_number_upper(t)::BIT::BIGINT AS raw_hi
        FROM (SELECT k, t, {sql_form("t")} AS f FROM x)"""

    def apply(batches):
        for b in batches:
            t = pa.table({"k": b.column(0), "t": b.column(1)})
            for lo, hi in byte_slices(b.column(1)):
                yield from run_sql(sql, x=t.slice(lo, hi - lo)).to_batches()

    src = df.where(F.col(f"`{column}`").isNotNull() & F.col(f"`{key}`").isNotNull())
    return src.select(F.col(f"`{key}`").cast("string").alias("k"), F.col(f"`{column}`").alias("t")).mapInArrow(apply, HASHED)


#: Records of one form that meet as many others in a task at a time; it decides how pairs are spread, not which ones are given.
BLOCK = 1024


def lookalike_pairs(hashed: DataFrame, full_pairs: int | None = None) -> DataFrame:
    """Pairs of records of one table whose texts have one common form but are different strings.

    hashed: rows of form_hashes. A form with a single stored string is dropped after a pre-aggregated group-by, so
    copies, however many, cost nothing. Each pair is returned once, smaller key first; a record delivered twice
    is one record; an empty input gives no rows. All pairs are given, however many records have a form: its records are dealt into
    blocks of about BLOCK, and each two blocks meet by themselves. A caller who wants links only may set full_pairs: to look alike is an
    equivalence, so of a form with more pairs of records each record is then paired with the first one of another string only.
    """
    group = ["src_table", "form_hi", "form_lo"]
    mixed = hashed.groupBy(*group).agg(F.min("raw_hi").alias("lo"), F.max("raw_hi").alias("hi"), F.count("*").alias("n")).where("lo < hi").select(*group, "lo", "hi", "n")
    rows = hashed.join(mixed, group).select(*group, "key", "raw_hi", "lo", "hi", "n").distinct()
    few = "true" if full_pairs is None else f"n * (n - 1) <= {2 * full_pairs}"
    # one row for each record of a form, with the least and greatest of its strings, and whether it has other forms too
    forms = F.count("*").over(Window.partitionBy("src_table", "key"))
    records = rows.where(few).groupBy(*group, "key", "n").agg(F.min("raw_hi").alias("least"), F.max("raw_hi").alias("most")).withColumn("more", forms > 1)
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = records.withColumn("own", F.pmod(F.xxhash64("key"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1))).drop("n")
    # so many tasks whatever the size: few rows may have many pairs
    tasks = int(hashed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    a, b = dealt.repartition(tasks, *group, "own", "other").alias("a"), dealt.repartition(tasks, *group, "other", "own").alias("b")
    on = [*(F.col(f"a.{c}") == F.col(f"b.{c}") for c in group), F.col("a.own") == F.col("b.other"), F.col("a.other") == F.col("b.own")]
    differ = F.least("a.least", "b.least") < F.greatest("a.most", "b.most")
    apart = [*on, F.col("a.key") < F.col("b.key"), differ]
    pair = ["a.src_table", F.col("a.key").alias("key_a"), F.col("b.key").alias("key_b")]
    # only two records that both have several forms can meet more than once
    once = a.join(b, [*apart, ~(F.col("a.more") & F.col("b.more"))]).select(*pair)
    pairs = once.unionAll(a.where("more").join(b.where("more"), apart).select(*pair).distinct())
    if full_pairs is None:
        return pairs
    many = rows.where(f"NOT ({few})")
    heads = many.groupBy(*group).agg(F.min(F.when(F.col("raw_hi") == F.col("lo"), F.col("key"))).alias("first"), F.min(F.when(F.col("raw_hi") == F.col("hi"), F.col("key"))).alias("second"))
    star = many.join(heads, group).select("src_table", F.col("key").alias("x"), F.when(F.col("raw_hi") == F.col("lo"), F.col("second")).otherwise(F.col("first")).alias("y")).where("x <> y")
    return pairs.unionAll(star.select("src_table", F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b"))).distinct()


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    qa = spark.read.parquet(f"{sf_dir}/qa_examples.parquet")
    cc = spark.read.parquet(f"{sf_dir}/corpus_chunks.parquet")
    both = form_hashes(qa, "query_id", "question", "qa_examples").unionAll(form_hashes(cc, "chunk_id", "text", "corpus_chunks"))
    return lookalike_pairs(cut_lineage(both))


def p1_found_sql() -> str:
    return f"""
        WITH t AS (SELECT DISTINCT 'qa_examples' AS src_table, query_id AS key, question AS text FROM qa_examples
                   UNION ALL SELECT DISTINCT 'corpus_chunks', chunk_id, text FROM corpus_chunks),
             f AS (SELECT *, {sql_form("text")} AS form FROM t)
        SELECT DISTINCT a.src_table, a.key AS key_a, b.key AS key_b FROM f a JOIN f b ON a.src_table = b.src_table AND a.form = b.form AND a.key < b.key AND a.text <> b.text"""


def p1_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every question and passage whose common form differs from what is stored, with both lengths."""
    qa = first_of_key(spark.read.parquet(f"{sf_dir}/qa_examples.parquet").select(F.col("query_id").alias("key"), F.col("question").alias("text")), "key")
    cc = first_of_key(spark.read.parquet(f"{sf_dir}/corpus_chunks.parquet").select(F.col("chunk_id").alias("key"), "text"), "key")
    both = qa.withColumn("src_table", F.lit("qa_examples")).unionByName(cc.withColumn("src_table", F.lit("corpus_chunks")))
    formed = common_form(both, "text", "form").where("text <> form")
    return formed.select("src_table", "key", F.md5("form").alias("form_md5"), F.length("text").alias("n_stored"), F.length("form").alias("n_form"))


def p1_changed_sql() -> str:
    return f"""
        WITH t AS (SELECT DISTINCT 'qa_examples' AS src_table, query_id AS key, question AS text FROM qa_examples
                   UNION ALL SELECT DISTINCT 'corpus_chunks', chunk_id, text FROM corpus_chunks),
             f AS (SELECT *, {sql_form("text")} AS form FROM t)
        SELECT src_table, key, md5(form) AS form_md5, length(text)::INT AS n_stored, length(form)::INT AS n_form
        FROM f WHERE text <> form"""
