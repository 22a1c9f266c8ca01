"""The cross-reference graph of chunks: building it by joins, and expanding results along it."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DECAY = {"adj": 0.85, "intra": 0.70, "cross": 0.60}
OTHER_DECAY = 0.7
BUDGET = 3
#: Places after a law's name within which the number of its article is looked for.
REACH = 200
# How a law is named with its number, an article is named after it, and an article of the same law.
_LAW = re.compile(r"(\d{2,5})\s*sayılı\s+([A-Za-zÇĞİÖŞÜçğıöşü .'’\-]+?)\s+(?:Kanunu?|Yasası?)\b")
_OF_LAW = re.compile(r"(?:Madde|m\.)\s*(\d{1,4})|(\d{1,4})\s*\.?\s*(?:inci|ıncı|nci|ncı|üncü|uncu)?\s*\.?\s*madde", re.I)
_OWN = re.compile(r"(?:^|[\s(,;.])(?:Madde|MADDE|m\.)\s*(\d{1,4})(?:/\d+[a-zçğıöşü]?)?", re.M)
#: Laws that a name is looked for in at most; they are reference data and go to every task.
LAWS = 100_000


def article_of(chunk_id: Column, source: Column, doc_id: Column) -> tuple[Column, Column]:
    """(article, part) of ids like <source>_<doc>_m<article>[_<part>]; null for others."""
    prefix = F.concat(source, F.lit("_"), doc_id, F.lit("_"))
    rest = F.when(F.startswith(chunk_id, prefix), F.substring(chunk_id, F.length(prefix) + 1, F.length(chunk_id)))
    part = lambda i: F.nullif(F.regexp_extract(rest, r"^m(\d+)(?:_(\d+))?$", i), F.lit("")).cast("int")
    return part(1), part(2)


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "kind"))


def adjacency(nodes: DataFrame) -> DataFrame:
    """Edges (src, dst, kind=adj) of nodes (id, source, doc_id, article, part, ord).

    All chunks of an article are linked with those of the next article of the document, if its number is one higher; the
    parts of an article are linked in their order (no part comes first).
    """
    n = nodes.where("article IS NOT NULL")
    a, b = n.alias("a"), n.withColumn("article", F.col("article") - 1).alias("b")
    near = a.join(b, ["source", "doc_id", "article"]).select(F.col("a.id").alias("src"), F.col("b.id").alias("dst"), F.lit("adj").alias("kind"))
    w = Window.partitionBy("source", "doc_id", "article").orderBy(F.coalesce("part", F.lit(-1)), "ord")
    inside = n.withColumn("dst", F.lead("id").over(w)).where("dst IS NOT NULL").select(F.col("id").alias("src"), "dst", F.lit("adj").alias("kind"))
    return both_ways(near.unionAll(inside)).distinct()


def references_of(text: str) -> list[tuple[str, int | None, str | None, int]]:
    """(kind, law number, law name, article) of a text, each once: articles named soon after another law (cross), and all others (intra)."""
    found, taken = [], []
    for law in _LAW.finditer(text):
        if article := _OF_LAW.search(text[law.end() : law.end() + REACH]):
            found.append(("cross", int(law[1]), law[2], int(article[1] or article[2])))
            taken.append((law.end() + article.start(), law.end() + article.end()))
    for article in _OWN.finditer(text):
        if all(article.end() <= a or b <= article.start() for a, b in taken):
            found.append(("intra", None, None, int(article[1])))
    return list(dict.fromkeys(found))


def references(texts: DataFrame) -> DataFrame:
    """(id, kind, law_no, law_name, article) of rows (id, text): articles of other laws (cross) and of the same (intra)."""

    def apply(batches):
        for b in batches:
            rows = [(i, *r) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for r in references_of(t)]
            cols = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), ty) for c, ty in zip(cols, (pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32()))], names=["id", "kind", "law_no", "law_name", "article"])

    return texts.where("text IS NOT NULL").select(F.col("id").cast("string"), "text").mapInArrow(apply, "id string, kind string, law_no int, law_name string, article int")


def law_sources(named: DataFrame, laws: DataFrame) -> DataFrame:
    """named (law_no, law_name) with the source of each law, or null: by number, else by the whole name, else by the first source (in plain order)
    that holds the name or is held by it. laws: (law_no, source), LAWS rows at most; more are an error."""
    known = laws.where("source IS NOT NULL").select("law_no", "source", F.lower("source").alias("low")).distinct()
    if known.limit(LAWS + 1).count() > LAWS:
        raise ValueError(f"more than {LAWS} laws")
    by_no = known.where("law_no IS NOT NULL").groupBy("law_no").agg(F.min("source").alias("by_no"))
    by_name = known.groupBy("low").agg(F.min("source").alias("by_name"))
    every = known.agg(F.array_sort(F.collect_set(F.struct("source", "low"))).alias("every"))  # one row
    low = F.trim(F.lower("law_name"))
    each = named.select("law_no", "law_name").distinct().withColumn("low", low).join(F.broadcast(by_no), "law_no", "left")
    each = each.join(F.broadcast(by_name.withColumnRenamed("low", "full")), F.concat("low", F.lit(" kanunu")) == F.col("full"), "left").withColumnRenamed("by_name", "by_full").drop("full")
    each = each.join(F.broadcast(by_name), "low", "left").crossJoin(F.broadcast(every))
    part = F.try_element_at(F.filter("every", lambda x: F.contains(x["low"], F.col("low")) | F.contains(F.col("low"), x["low"])), F.lit(1))["source"]
    return each.select("law_no", "law_name", F.coalesce("by_no", "by_full", "by_name", part).alias("law_source"))


def reference_edges(refs: DataFrame, nodes: DataFrame, laws: DataFrame) -> DataFrame:
    """Edges of references: intra within a source, cross to the source of the law; laws (law_no, source)."""
    at = nodes.select(F.col("id").alias("dst"), "source", "article").where("article IS NOT NULL")
    own = refs.join(nodes.select("id", "source"), "id")
    intra = own.where("kind = 'intra'").join(at, ["source", "article"]).where("id <> dst")
    to = own.where("kind = 'cross'").withColumnRenamed("source", "own_source")
    to = to.join(law_sources(to, laws), ["law_no", "law_name"]).where("law_source IS NOT NULL AND law_source <> own_source").withColumnRenamed("law_source", "source")
    cross = to.join(at, ["source", "article"])
    cols = [F.col("id").alias("src"), "dst", "kind"]
    return intra.select(*cols).unionAll(cross.select(*cols)).distinct()


def build_graph(chunks: DataFrame, laws: DataFrame) -> DataFrame:
    """All edges (src, dst, kind) of chunks (id, source, doc_id, text, ord): neighbours, articles of the same and of other laws.

    An article's number is read from the id, or from a column `article` where there is one.
    """
    article, part = article_of(F.col("id"), F.col("source"), F.col("doc_id"))
    nodes = chunks.withColumn("part", part).withColumn("article", F.coalesce(article, "article") if "article" in chunks.columns else article)
    return adjacency(nodes).unionByName(reference_edges(references(chunks.select("id", "text")), nodes, laws)).distinct()


def expand(ranked: DataFrame, edges: DataFrame, known: DataFrame, hops: int = 1, budget: int = BUDGET, kinds: tuple[str, ...] = ("adj",)) -> DataFrame:
    """ranked (query, doc, score, rank) with up to `budget` neighbours of each query's results appended.

    One hop is a join: seeds in order of score, their edges in order of (dst, kind); a neighbour counts at its first
    occurrence, if it is a known chunk (doc) and no result. Further hops take one query's neighbourhood at a time.
    """
    decay = F.coalesce(F.element_at(F.create_map(*[x for k, v in DECAY.items() for x in (F.lit(k), F.lit(v))]), F.col("kind")), F.lit(OTHER_DECAY))
    use = edges.where(F.col("kind").isin(*kinds)).select("src", F.col("dst").alias("doc"), "kind")
    result, front = ranked.select("query", "doc", "score", "rank"), ranked.select("query", "doc", "score", "rank")
    spent = None
    for hop in range(hops):
        steps = front.join(use.withColumnRenamed("doc", "to"), F.col("doc") == F.col("src")).select("query", F.col("to").alias("doc"), (F.col("score") * decay).alias("new_score"), F.col("rank").alias("seed"), "kind")
        steps = steps.join(known.select("doc"), "doc", "left_semi").join(result.select("query", "doc"), ["query", "doc"], "left_anti")
        once = Window.partitionBy("query", "doc").orderBy("seed", "kind")
        order = Window.partitionBy("query").orderBy("seed", "doc", "kind")
        new = steps.withColumn("o", F.row_number().over(once)).where("o = 1").withColumn("n", F.row_number().over(order))
        left = F.lit(budget) if spent is None else F.lit(budget) - F.coalesce("used", F.lit(0))
        if spent is not None:
            new = new.join(spent, "query", "left")
        new = new.where(F.col("n") <= left)
        last = result.groupBy("query").agg(F.max("rank").alias("last"))
        added = new.join(last, "query").select("query", "doc", F.col("new_score").alias("score"), (F.col("last") + F.col("n")).cast("int").alias("rank"))
        result, front = result.unionByName(added), added
        if hop + 1 < hops:
            got = added.groupBy("query").agg(F.count("*").alias("used"))
            spent = got if spent is None else spent.unionAll(got).groupBy("query").agg(F.sum("used").alias("used"))
    return result


def stats(edges: DataFrame) -> DataFrame:
    """(kind, n_edges) and, as kind 'nodes', the number of chunks with an edge."""
    return edges.groupBy("kind").agg(F.count("*").alias("n_edges")).unionAll(edges.agg(F.lit("nodes").alias("kind"), F.countDistinct("src").alias("n_edges")))
