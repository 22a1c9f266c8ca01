"""Problem 9: the subject areas of documents.

Method: term weighting and truncated singular value decomposition. Words become stems (their first letters, hashed to a fixed
number of terms), terms are weighted by rarity over all documents, and a randomized decomposition of the document-term
matrix gives each term a short vector. The matrix is scaled by its row and column sums first, so that the words of a language with few
documents get dimensions of their own. Documents and sentences are sums of their terms' vectors. Seed centroids of the areas, one for each
language, come from labelled documents and the areas' descriptions, and are refined by turns: every sentence of the collection goes
to the centroid of the highest cosine, if that is clear enough, and a centroid becomes the mean of its sentences.
A document has the areas to which enough of its sentences belong.

Texts are read once, into a table of term numbers; the passes that follow read that table. What goes to the driver or to
every task has a fixed size: TERMS x RANK numbers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kervan.llm.splitting import is_space
from kervan.llm.util import PARTIAL, partial_rows, tasks_of, tree_merged, written
from kervan.llm.words import each

#: Terms, letters of a stem, dimensions kept, further ones that the decomposition works with, refinements of the centroids.
TERMS, STEM, RANK, SPARE, ROUNDS = 8192, 5, 64, 16, 3
#: Power of a term's weight over all documents by which its column is scaled.
SCALE = 0.35
#: A sentence belongs to an area if the next area's cosine is lower by this much.
CLEAR = 0.2
#: … and its own cosine is at least this.
NEAR = 0.3
#: Sentences and share of sentences that give a document an area.
LEAST, SHARE = 2, 0.1
#: Labelled documents the seeds are taken from, at most; those of the least hash.
LABELLED = 20_000
#: Weight of an area's description against a labelled document in its seed.
DESCRIBED = 0.05
NO_TERM = 65_535
#: Words of a sentence or text that are summed up at a time.
STRETCH = 256
_PARTS = 8


def terms_of(texts: pa.Array):
    """Yields (number of the first text, text, term, sentence) of runs of texts, word by word; words of no term have NO_TERM."""
    for lo, w in each(texts):
        codes = np.append(w.codes, [10, 10])
        ends = (np.isin(codes[:-1], (0x2E, 0x21, 0x3F)) & is_space(codes[1:])) | (codes[:-1] == 10)
        inner = w.offset[1:-1]
        ends[inner[inner > 0] - 1] = True
        term = (w.stems(STEM) % np.uint64(TERMS)).astype(np.uint16)
        head = w.folded[w.start]
        term[((head >= 0x30) & (head <= 0x39)) | (w.end - w.start < 2)] = NO_TERM
        yield lo, w, term, np.cumsum(ends)[w.start]


def term_table(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, terms, lengths): the term numbers of a document's words (16 bits each) and the numbers of words of its sentences (32 bits)."""
    key = docs.schema["doc_id"].dataType.simpleString()

    def apply(batches):
        for b in batches:
            ids = b.column(0)
            for lo, w, term, sentence in terms_of(b.column(1)):
                new = np.ones(len(term), dtype=bool)
                new[1:] = (sentence[1:] != sentence[:-1]) | (w.doc[1:] != w.doc[:-1])
                at = np.flatnonzero(new)
                length = np.diff(np.append(at, len(term))).astype(np.uint32)
                cut = np.searchsorted(w.doc[at], np.arange(w.n + 1))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, w.n), b.column(2).slice(lo, w.n), pa.array([term[a:b].tobytes() for a, b in zip(w.first[:-1], w.first[1:])], pa.binary()), pa.array([length[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary())],
                    names=["doc_id", "lang", "terms", "lengths"],
                )

    lang = F.lower(F.trim(F.coalesce(F.col("lang").cast("string"), F.lit("")))) if "lang" in docs.columns else F.lit("")
    return docs.select("doc_id", "text", lang.alias("lang")).mapInArrow(apply, f"doc_id {key}, lang string, terms binary, lengths binary")


def _flat(column: pa.Array, kind=np.uint16) -> tuple[np.ndarray, np.ndarray]:
    blobs = column.to_pylist()
    return np.frombuffer(b"".join(blobs), dtype=kind), np.array([len(x) // np.dtype(kind).itemsize for x in blobs], dtype=np.int64)


def _weights(column: pa.Array, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, weight) of a batch: (1 + log of occurrences) x rarity, documents of length one."""
    term, n = _flat(column)
    doc = np.repeat(np.arange(len(n)), n)
    on = term != NO_TERM
    pair, count = np.unique(doc[on] * TERMS + term[on], return_counts=True)
    doc, term = pair // TERMS, pair % TERMS
    value = (1 + np.log(count)) * idf[term]
    return doc, term, value / np.maximum(np.sqrt(np.bincount(doc, value**2, minlength=len(n))), 1e-9)[doc]


def summed(df: DataFrame, columns: list[str], shape: tuple[int, int], of, tasks: int) -> np.ndarray:
    """Sum over all batches of of(batch) -> array of the shape; tasks (so many) add up their own, the cluster adds the tasks' in slices."""
    parts = _PARTS if shape[0] % _PARTS == 0 else 1

    def apply(batches):
        total = np.zeros(shape)
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                total += of(b.slice(lo, 1000))
        if total.any():
            yield partial_rows([x.astype("<f8").tobytes() for x in np.split(total, parts)])

    def add(blobs):
        return sum(np.frombuffer(x, dtype="<f8") for x in blobs).tobytes()

    got = tree_merged(df.select(*columns).mapInArrow(apply, PARTIAL), tasks, add)
    return np.concatenate([np.frombuffer(got[p], dtype="<f8") if p in got else np.zeros(shape[0] // parts * shape[1]) for p in range(parts)]).reshape(shape)


def term_vectors(table: DataFrame) -> np.ndarray:
    """TERMS x RANK: the vectors of the terms, times their rarity."""
    tasks = tasks_of(table)

    def counted(b):
        term, n = _flat(b.column(0))
        doc = np.repeat(np.arange(len(n)), n)
        on = term != NO_TERM
        out = np.zeros((TERMS + _PARTS, 1))
        out[:TERMS, 0] = np.bincount(np.unique(doc[on] * TERMS + term[on]) % TERMS, minlength=TERMS)
        out[TERMS, 0] = len(n)
        return out

    df = summed(table, ["terms"], (TERMS + _PARTS, 1), counted, tasks)[:, 0]
    idf = np.where(df[:TERMS] > 0, np.log((df[TERMS] + 1) / (df[:TERMS] + 1)), 0.0)

    def weighed(b):
        out = np.zeros((TERMS, 1))
        _, term, value = _weights(b.column(0), idf)
        out[:, 0] = np.bincount(term, weights=value, minlength=TERMS)
        return out

    scale = np.maximum(summed(table, ["terms"], (TERMS, 1), weighed, tasks)[:, 0], 1e-9) ** -SCALE

    def times(q: np.ndarray) -> np.ndarray:
        """A'A q for the scaled document-term matrix A."""
        wide = q.astype(np.float32)

        def of(b):
            out = np.zeros((TERMS, wide.shape[1]), dtype=np.float32)
            for lo in range(0, b.num_rows, 250):
                s = b.slice(lo, 250)
                doc, term, value = _weights(s.column(0), idf)
                a = np.zeros((s.num_rows, TERMS), dtype=np.float32)
                row = np.bincount(doc, weights=value, minlength=s.num_rows)
                a[doc, term] = value * scale[term] / np.sqrt(np.maximum(row, 1e-9))[doc]
                out += a.T @ (a @ wide)
            return out

        return summed(table, ["terms"], q.shape, of, tasks)

    q = np.linalg.qr(np.random.default_rng(7).standard_normal((TERMS, RANK + SPARE)))[0]
    q = np.linalg.qr(times(q))[0]
    z = times(q)
    small = q.T @ z
    _, u = np.linalg.eigh((small + small.T) / 2)
    return (q @ u[:, ::-1][:, :RANK]) * (scale * idf * (df[:TERMS] > 1))[:, None]


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1), 1e-12)[:, None]


def run_sums(vectors: np.ndarray, term: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Sums of the terms' vectors over runs of the given lengths, all at least 1.

    Runs are cut into stretches, and a block of stretches is summed word by word over all of them at once, the longest first:
    reduceat along the runs takes ten times as long.
    """
    padded = np.vstack([vectors, np.zeros((1, vectors.shape[1]), dtype=vectors.dtype)])  # NO_TERM is clipped to the last row
    parts = -(-length // STRETCH)
    size = np.full(parts.sum(), STRETCH, dtype=np.int64)
    last = np.cumsum(parts) - 1
    size[last] = length - (parts - 1) * STRETCH
    start = np.cumsum(size) - size
    order = np.argsort(-size, kind="stable")
    sums = np.empty((len(size), vectors.shape[1]), dtype=vectors.dtype)
    room = np.empty((500, vectors.shape[1]), dtype=vectors.dtype)
    for lo in range(0, len(order), len(room)):
        of = order[lo : lo + len(room)]
        first = start[of]
        total = np.take(padded, term[first], axis=0, mode="clip")
        longer = np.searchsorted(-size[of], -np.arange(size[of[0]]))  # longer[k]: stretches of more than k words
        for k in range(1, len(longer)):
            n = longer[k]
            total[:n] += np.take(padded, term[first[:n] + k], axis=0, out=room[:n], mode="clip")
        sums[of] = total
    out = sums[last]
    if len(many := np.flatnonzero(parts > 1)):
        own = sums[np.repeat(parts > 1, parts)]
        out[many] = np.add.reduceat(own, np.cumsum(parts[many]) - parts[many], axis=0)
    return out


class Model:
    """Term vectors, areas, and centroids with the number of the area of each, in rising order."""

    def __init__(self, vectors: np.ndarray, names: list[str], area: np.ndarray, centroids: np.ndarray):
        self.vectors, self.names, self.area, self.centroids = vectors.astype(np.float32), names, area, centroids.astype(np.float32)
        self.first = np.flatnonzero(np.append(True, area[1:] != area[:-1])) if len(area) else area

    def assign(self, b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(document, unit vector, area or -1, centroid of every sentence; sentences of every document) of a batch (…, terms, lengths)."""
        term, _ = _flat(b.column("terms"))
        length, n = _flat(b.column("lengths"), np.uint32)
        doc = np.repeat(np.arange(len(n)), n)
        if not len(length) or not len(self.area):
            none = np.full(len(doc), -1)
            return doc, np.zeros((len(doc), RANK)), none, none, n
        u = unit(run_sums(self.vectors, term, length.astype(np.int64)))
        cos = u @ self.centroids.T
        by_area = np.maximum.reduceat(cos, self.first, axis=1)
        best = by_area.argmax(axis=1)
        top = by_area[np.arange(len(best)), best]
        next_one = np.partition(by_area, -2, axis=1)[:, -2] if by_area.shape[1] > 1 else np.zeros(len(best))
        return doc, u, np.where((top - next_one >= CLEAR) & (top >= NEAR), self.area[self.first][best], -1), cos.argmax(axis=1), n


def seeds(table: DataFrame, vectors: np.ndarray, areas: DataFrame, labels: DataFrame) -> Model:
    rows = sorted((r.subject, f"{r.title or ''} {r.description or ''}") for r in areas.where("subject IS NOT NULL").select("subject", "title", "description").distinct().collect())
    names = sorted({s for s, _ in rows})
    number = {s: i for i, s in enumerate(names)}
    described = np.zeros((len(names), RANK))
    for lo, w, term, _ in terms_of(pa.array([t for _, t in rows], pa.string())):
        for d in range(w.n):
            own = term[w.first[d] : w.first[d + 1]]
            described[number[rows[lo + d][0]]] += vectors[own[own != NO_TERM]].sum(axis=0)
    known = labels.where(F.col("subject").isin(names)).groupBy("doc_id").agg(F.sort_array(F.collect_set("subject")).alias("areas"))
    sample = known.orderBy(F.xxhash64("doc_id")).limit(LABELLED)
    labelled = table.join(F.broadcast(sample), "doc_id")  # at most LABELLED rows
    pairs = {(r.area, r.lang) for r in labelled.select(F.explode("areas").alias("area"), "lang").distinct().collect()}
    if any(lang for _, lang in pairs):
        pairs = {(a, lang) for a, lang in pairs if lang}  # documents of unknown language are no seeds where others are
    pairs |= {(a, "") for a in names if not any(a == x for x, _ in pairs)}
    groups = sorted((number[a], lang) for a, lang in pairs)
    place = {g: i for i, g in enumerate(groups)}

    def of(b):
        term, n = _flat(b.column("terms"))
        on = np.flatnonzero(n > 0)
        out = np.zeros((len(groups), RANK))
        if len(on):
            u = unit(run_sums(vectors, term, n[on]))
            take = pa.array(on)
            for row, areas, lang in zip(u, b.column("areas").take(take).to_pylist(), b.column("lang").take(take).to_pylist()):
                for a in areas:
                    if (i := place.get((number[a], lang))) is not None:
                        out[i] += row / len(areas)
        return out

    area = np.array([a for a, _ in groups], dtype=np.int64)
    total = summed(labelled, ["terms", "areas", "lang"], (len(groups), RANK), of, tasks_of(table)) if groups else np.zeros((0, RANK))
    return Model(vectors, names, area, unit(total + DESCRIBED * described[area]))


def subject_model(table: DataFrame, areas: DataFrame, labels: DataFrame) -> Model:
    model = seeds(table, term_vectors(table), areas, labels)
    for _ in range(ROUNDS if len(model.area) else 0):

        def of(b, model=model):
            _, u, area, at, _ = model.assign(b)
            out = np.zeros(model.centroids.shape)
            for c in np.unique(at[area >= 0]):
                out[c] = u[(at == c) & (area >= 0)].sum(axis=0)
            return out

        got = summed(table, ["terms", "lengths"], model.centroids.shape, of, tasks_of(table))
        model = Model(model.vectors, model.names, model.area, np.where(np.linalg.norm(got, axis=1)[:, None] > 0, unit(got), model.centroids))
    return model


def document_subjects(docs: DataFrame, areas: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, subject, n_sentences, n_all) of every area of every document (doc_id, text and, if known, lang); a document without an area has one row
    with null subject.

    Null, empty and blank texts have no sentences and no area; texts are taken whole. Labels of unknown areas or
    documents are passed over, repeated ones count once, wrong ones are outvoted. Without areas or documents no area
    is given. Repeated document ids give repeated rows.
    """
    table = written(term_table(docs.where("doc_id IS NOT NULL")), "terms")
    model = subject_model(table, areas, labels)
    key = docs.schema["doc_id"].dataType.simpleString()

    def apply(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                s = b.slice(lo, 1000)
                doc, _, area, _, n = model.assign(s)
                count = np.zeros((s.num_rows, max(1, len(model.names))), dtype=np.int64)
                np.add.at(count, (doc[area >= 0], area[area >= 0]), 1)
                d, a = np.nonzero((count >= LEAST) & (count >= SHARE * n[:, None]))
                none = np.setdiff1d(np.arange(s.num_rows), d)
                at = np.concatenate([d, none])
                subject = [model.names[x] for x in a] + [None] * len(none)
                yield pa.RecordBatch.from_arrays(
                    [s.column("doc_id").take(pa.array(at)), pa.array(subject, pa.string()), pa.array(np.concatenate([count[d, a], np.zeros(len(none), dtype=np.int64)])), pa.array(n[at])],
                    names=["doc_id", "subject", "n_sentences", "n_all"],
                )

    return table.mapInArrow(apply, f"doc_id {key}, subject string, n_sentences bigint, n_all bigint")


def _tables(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "subject_areas", "subject_labels")]


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_subjects(*_tables(spark, sf_dir)).where("subject IS NOT NULL").select("doc_id", "subject").distinct()


def p9_makeup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus by area: documents of each area (null: of none), and the sentences that belong to it."""
    return document_subjects(*_tables(spark, sf_dir)).groupBy("subject").agg(F.count("*").alias("n_docs"), F.sum("n_sentences").alias("n_sentences"))
