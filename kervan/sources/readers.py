"""Sources: question sets and corpora in the shapes in which they come, as DataFrames of one schema."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kervan.functions.storage import Files, numbered
from kervan.functions.text import document_of, falsy

RAW = ("id", "question", "answer", "context", "source", "data_type", "score", "split")
CHUNK = "chunk_id string, doc_id string, text string, source string, char_len int, ord bigint"
QA = "query_id string, question string, answer string, context string, source string, data_type string, gold_ids array<string>"
EXAM = ("soru", "cevap", "kaynak")
# Fixed value: the law that the exam set leaves out.
DROPPED_SOURCE = "213 sayılı Vergi Usul Kanunu"
# Fixed value: answers that only point to the options of a multiple-choice question.
OPTION = r"(?iu)^(?:(?:Yalnız|Sadece)\s+(?:III|II|IV|I|V)\b|(?:III|II|IV|I|V)(?:\s*,\s*(?:III|II|IV|I|V))+|(?:III|II|IV|I|V)\s+ve\s+(?:III|II|IV|I|V))"


class EmptyInput(ValueError):
    pass


def required(df: DataFrame, names) -> DataFrame:
    if missing := sorted(set(names) - set(df.columns)):
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def read_csv(spark: SparkSession, path: str, names=RAW) -> DataFrame:
    """Raw rows of a CSV file with quoted line breaks; a byte-order mark is taken off; no rows or a missing column is an error."""
    df = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', encoding="UTF-8")
    df = df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])
    required(df, names)
    if df.isEmpty():
        raise EmptyInput(f"no rows in {path}")
    return df.withColumn("score", F.col("score").cast("double")) if "score" in names else df


def validate(raw: DataFrame) -> DataFrame:
    """(split, n_rows, n_null_context, n_empty_answer) of every split."""
    return raw.groupBy("split").agg(F.count("*").alias("n_rows"), F.count_if(F.col("context").isNull()).alias("n_null_context"), F.count_if(F.coalesce("answer", F.lit("")) == "").alias("n_empty_answer"))


def as_examples(raw: DataFrame) -> DataFrame:
    """Raw rows as QA examples: null counts as empty, the id is text."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return raw.select(F.coalesce(F.col("id").cast("string"), F.lit("")).alias("query_id"), *[text(c) for c in RAW[1:6]], F.array().cast("array<string>").alias("gold_ids"))


def read_jsonl(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """One record a line; blank lines are skipped."""
    r = spark.read.schema(schema) if schema else spark.read
    return r.json(path)


def _field(df: DataFrame, *names: str) -> Column:
    """The first non-empty of fields that the schema has; dots go into structs."""
    have = []
    for n in names:
        top, _, rest = n.partition(".")
        if top in df.columns and (not rest or rest in getattr(df.schema[top].dataType, "names", [])):
            have.append(F.col(n))
    return falsy(*have) if have else F.lit(None).cast("string")


def normalized_corpus(df: DataFrame) -> DataFrame:
    """Chunks of any known shape: native (chunk_id), with an id and metadata, or id/_id with a title. The input is never rewritten."""
    own = _field(df, "chunk_id")
    ident = F.coalesce(own, _field(df, "metadata.chunk_id"), _field(df, "id", "_id"))
    doc = F.coalesce(_field(df, "doc_id"), _field(df, "metadata.doc_id"), document_of(_field(df, "id", "_id")))
    source = F.coalesce(_field(df, "source"), _field(df, "metadata.source"), _field(df, "title"), F.lit(""))
    size = F.coalesce(_field(df, "char_len").cast("int"), _field(df, "metadata.chunk_char_count").cast("int"), F.length("text"))
    ord_ = F.col("ord") if "ord" in df.columns else F.monotonically_increasing_id()
    return df.select(ident.alias("chunk_id"), doc.alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), source.alias("source"), size.alias("char_len"), ord_.alias("ord"))


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    return normalized_corpus(read_jsonl(spark, path))


def read_directory(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, source, text, ord) of the .txt files of a folder, then of its .pdf files, by name; the name without its ending is id and source."""
    none = spark.createDataFrame([], "doc_id string, source string, text string, ord string")
    files = Files(spark)
    if files.any_match(f"{path}/*.txt"):
        texts = spark.read.text(f"{path}/*.txt", wholetext=True).withColumn("file", F.input_file_name())
        stem = F.url_decode(F.regexp_extract("file", r"([^/]+)\.txt$", 1))
        none = none.unionAll(texts.select(stem.alias("doc_id"), stem.alias("source"), F.col("value").alias("text"), F.concat(F.lit("0"), "file").alias("ord")))
    if files.any_match(f"{path}/*.pdf"):
        none = none.unionAll(read_pdf(spark, path).select("doc_id", F.col("doc_id").alias("source"), "text", F.concat(F.lit("1"), "doc_id").alias("ord")))
    return none.where("trim(coalesce(text, '')) <> ''")


def read_pdf(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text) of the .pdf files of a folder: their pages' texts between blank lines. Needs pypdf on the workers."""
    try:
        import pypdf  # noqa: F401
    except ImportError as e:
        raise ImportError("reading PDF files needs pypdf") from e

    @F.pandas_udf("string")
    def pages(raw):
        import io

        import pypdf

        def text(b: bytes) -> str:
            got = (p.extract_text() or "" for p in pypdf.PdfReader(io.BytesIO(b)).pages)
            return "\n\n".join(t for t in got if t.strip())

        return raw.map(text)

    df = spark.read.format("binaryFile").load(f"{path}/*.pdf")
    return df.select(F.regexp_extract("path", r"([^/]+)\.pdf$", 1).alias("doc_id"), pages("content").alias("text"))


def resolve_corpus(spark: SparkSession, corpus: str | None = None, docs: str | None = None, default: str | None = None) -> DataFrame:
    """Chunks of a corpus file or of a folder of documents, but not of both."""
    from kervan.operators.chunking import chunk
    from kervan.operators.dedup import text_dedup

    if corpus and docs:
        raise ValueError("give a corpus or a folder of documents, not both")
    if docs:
        if not Files(spark).is_folder(docs):
            raise ValueError(f"no folder: {docs}")
        files = read_directory(spark, docs)
        got = chunk(files).join(files.select("doc_id", F.col("ord").alias("file")), "doc_id")
        got = text_dedup(numbered(got.withColumn("at", F.struct("file", "idx")), "at", "ord")).drop("idx", "file", "at")
        if got.isEmpty():
            raise ValueError(f"no chunk in {docs}")
        return got
    path = corpus or default
    if not path or not Files(spark).exists(path):
        raise FileNotFoundError(str(path))
    return read_corpus(spark, path)


def normalized_questions(df: DataFrame) -> DataFrame:
    """Questions of any known shape; empty fields count as missing, and a missing id becomes custom_0000 and so on in input order."""
    answer = _field(df, "answer", "verified_answer", "expected_response", "expected_answer", "ground_truth", "gold_answer_extract")
    gold = F.array().cast("array<string>")
    if "gold_sources" in df.columns:
        gold = F.filter(F.transform("gold_sources", lambda s: s["source_id"]), lambda x: F.coalesce(x, F.lit("")) != "")
    elif "gold_chunk_ids" in df.columns:
        gold = F.col("gold_chunk_ids").cast("array<string>")
    ident = _field(df, "query_id", "question_id", "id", "_id")
    df = numbered(df.withColumn("__line", F.monotonically_increasing_id()), "__line", "__number")
    return df.select(
        F.coalesce(ident, F.format_string("custom_%04d", "__number")).alias("query_id"), F.coalesce(_field(df, "question", "query", "text"), F.lit("")).alias("question"), F.coalesce(answer, F.lit("")).alias("answer"),
        F.coalesce(_field(df, "context"), F.lit("")).alias("context"), F.coalesce(_field(df, "source"), F.lit("")).alias("source"), F.coalesce(_field(df, "data_type", "answer_type"), F.lit("")).alias("data_type"),
        F.coalesce(gold, F.array().cast("array<string>")).alias("gold_ids"),
    )


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Questions of a .csv file, of a JSON array or of JSON lines; a row without a question or an answer is an error."""
    files = Files(spark)
    if not files.exists(path):
        raise FileNotFoundError(path)
    if path.endswith(".csv"):
        df = read_csv(spark, path, names=())
        if not {"question", "query"} & set(df.columns) or not {"answer", "expected_answer", "ground_truth"} & set(df.columns):
            raise ValueError("no column of questions or answers")
    else:
        array = files.head(path, 256).decode("utf-8", "ignore").lstrip("\ufeff \r\n\t").startswith("[")
        df = spark.read.json(path, multiLine=array)
    got = normalized_questions(df)
    if bad := got.where("question = '' OR answer = ''").select("query_id").first():
        raise ValueError(f"no question or answer in {bad.query_id}")
    return got


def question_mode(df: DataFrame) -> bool:
    """True for a short-answer set (question_id), False for a long-answer one (query_id); others are an error."""
    names = set(df.columns)
    if {"query_id", "query"} <= names:
        return False
    if {"question_id", "question"} <= names:
        return True
    raise ValueError("a question set needs query_id and query, or question_id and question")


def read_external(spark: SparkSession, path: str) -> tuple[DataFrame, bool]:
    """(questions, whether answers are short) of a foreign file; the shape of its records tells which. A short-answer set takes its first gold source as source."""
    files = Files(spark)
    if not files.exists(path):
        raise FileNotFoundError(path)
    head = files.head(path, 256).decode("utf-8", "ignore").lstrip("\ufeff \r\n\t")
    df = spark.read.json(path, multiLine=head.startswith("["))
    short = question_mode(df)
    got = normalized_questions(df)
    return (got.withColumn("source", F.coalesce(F.try_element_at("gold_ids", F.lit(1)), "source")) if short else got), short


def question_set(spark: SparkSession, dataset: str, folder: str, file: str | None = None) -> tuple[DataFrame, bool, str]:
    """(questions, whether answers are short, ending of the results' names) of the data set custom (a file of one's own), hmgs or kaggle (as prepare writes
    them into the folder)."""
    if file or dataset == "custom":
        if not file:
            raise ValueError("the data set custom needs a file")
        return read_questions(spark, file), False, "_custom"
    if dataset not in ("hmgs", "kaggle"):
        raise ValueError(f"unknown data set: {dataset}")
    return normalized_questions(read_jsonl(spark, f"{folder}/{'qa_hmgs' if dataset == 'hmgs' else 'qa_eval'}")), dataset == "hmgs", "_hmgs" if dataset == "hmgs" else ""


def exam_questions(rows: DataFrame, source_map: DataFrame) -> DataFrame:
    """Exam rows (soru, cevap, kaynak, ord) as questions hmgs_0000…, numbered before the rows without a source and those that only
    point to options are left out."""
    known = source_map.where("source IS NOT NULL").groupBy("kaynak").agg(F.min("source").alias("source"))
    kept = numbered(required(rows, EXAM), "ord").where((F.col("kaynak") != DROPPED_SOURCE) & ~F.trim("cevap").rlike(OPTION))
    return kept.join(known, "kaynak").select(F.format_string("hmgs_%04d", "i").alias("query_id"), F.col("soru").alias("question"), F.col("cevap").alias("answer"), "source")


def instruction_splits(splits: dict[str, DataFrame]) -> DataFrame:
    """All splits of an instruction data set, one after another, with the split's name; each is mapped by its own columns."""
    rows = [instruction_rows(df).withColumn("split", F.lit(name)) for name, df in splits.items()]
    return functools.reduce(DataFrame.unionByName, rows)


def instruction_rows(df: DataFrame) -> DataFrame:
    """(question, answer, context) of instruction/input/output rows, of question/answer rows, else of the first and last column."""
    names = set(df.columns)
    if {"instruction", "output"} <= names:
        return df.select(F.col("instruction").alias("question"), F.col("output").alias("answer"), (F.col("input") if "input" in names else F.lit("")).alias("context"))
    if {"question", "answer"} <= names:
        return df.select("question", "answer", (F.col("context") if "context" in names else F.lit("")).alias("context"))
    return df.select(F.col(df.columns[0]).alias("question"), F.col(df.columns[-1]).alias("answer"), F.lit("").alias("context"))


def split_errors(predictions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, failed) predictions."""
    bad = F.col("error").isNotNull()
    return predictions.where(~bad), predictions.where(bad)
