"""Problems 3, 5, 7, 8 and 9."""

import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest

from kervan.llm import leaks, near_duplicates, overlap, packing, split_overlap, subjects
from kervan.llm.words import Words, each

VOCABULARY = ["".join(random.Random(i).choice("abcçdefgğhıijklmnoöprsştuüvyz") for _ in range(5)) for i in range(3000)]


def shingles(t, k):
    w = re.findall(r"[^\W_]+", (t or "").replace("I", "ı").replace("İ", "i").lower())
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def edited(r, words, edits):
    w = list(words)
    for _ in range(edits):
        i = r.randrange(len(w))
        kind = r.randrange(3)
        if kind == 0:
            w[i] = r.choice(VOCABULARY)
        elif kind == 1:
            w.insert(i, r.choice(VOCABULARY))
        elif len(w) > 5:
            del w[i]
    return w


def collection(seed, n=60, low=8, high=160):
    r = random.Random(seed)
    texts = []
    for _ in range(n):
        base = [r.choice(VOCABULARY) for _ in range(r.randint(low, high))]
        texts.append(" ".join(base))
        for _ in range(r.randrange(3)):
            texts.append(" ".join(edited(r, base, r.randint(0, max(1, len(base) // 14)))))
    return texts + ["", "tek", texts[0].upper().replace("I", "İ"), texts[0], None]


def test_words_match_a_plain_split():
    texts = ["Işık, İNCİ; a_b 12m² x", "", "son", None, "ｋıｓｍı​ söz"]
    got = []
    for _, w in each(pa.array(texts)):
        got += [["".join(map(chr, w.folded[a:b])) for a, b in zip(w.start[x:y], w.end[x:y])] for x, y in zip(w.first[:-1], w.first[1:])]
    assert got == [["ışık", "inci", "a", "b", "12m²", "x"], [], ["son"], [], ["kısmı", "söz"]]
    a, b = Words(pa.array(["bir iki", "iki"])).hash[[0, 1]], Words(pa.array(["x iki"])).hash[1]
    assert a[1] == b and a[0] != b


@pytest.mark.parametrize("k, t", [(3, 0.6), (5, 0.8)])
def test_near_duplicates_against_brute_force(spark, k, t):
    texts = collection(k)
    df = spark.createDataFrame([(f"c{i:03d}", x, i) for i, x in enumerate(texts)] + [("c000", texts[0], 0)], "id string, text string, cls int").repartition(3)
    sets = {f"c{i:03d}": shingles(x, k) for i, x in enumerate(texts)}
    keys = sorted(x for x in sets if sets[x])
    want = {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]) - 1e-12}
    members, links = near_duplicates.near_duplicates(df, "id", "text", k, t)
    got = {(r.key_a, r.key_b) for r in near_duplicates.key_pairs(members, links).collect()}
    assert got <= want and len(got) >= 0.99 * len(want) and len(want) > 20
    empty = near_duplicates.near_duplicates(df.limit(0), "id", "text", k, t)
    assert near_duplicates.key_pairs(*empty).count() == 0


def pairs_of_orders(seed):
    """Texts of 14 to 30 items of 8 or 9 words, and the same items in another order."""
    r = random.Random(seed)
    out = []
    for _ in range(60):
        items = [[r.choice(VOCABULARY) for _ in range(r.choice([8, 9, 9, 9]))] for _ in range(r.randint(14, 30))]
        other = r.sample(items, len(items))
        out.append((" ".join(sum(items, [])), " ".join(sum(other, []))))
    return out


def pairs_of_even_edits(seed, every, insert):
    """Texts of 140 to 400 words, and the same with a word replaced or put in at equal distances."""
    r = random.Random(seed)
    out = []
    for n in (140, 200, 400) * 8:
        a = [r.choice(VOCABULARY) for _ in range(n)]
        b = []
        for i, w in enumerate(a, 1):
            b += [r.choice(VOCABULARY)] if i % every == 0 and not insert else [w]
            b += [r.choice(VOCABULARY)] if i % every == 0 and insert else []
        out.append((" ".join(a), " ".join(b)))
    return out


def alike(pairs, t, k=3):
    return {i for i, (a, b) in enumerate(pairs) for x, y in [(shingles(a, k), shingles(b, k))] if len(x & y) >= t * len(x | y)}


def test_near_duplicates_of_reordered_items_and_even_edits(spark):
    pairs = pairs_of_orders(21) + pairs_of_even_edits(22, 10, True)
    df = spark.createDataFrame([(f"{i:03d}{s}", x) for i, p in enumerate(pairs) for s, x in zip("ab", p)], "id string, text string")
    got = {(r.key_a, r.key_b) for r in near_duplicates.key_pairs(*near_duplicates.near_duplicates(df, "id", "text", 3, 0.6)).collect()}
    want = alike(pairs, 0.6)
    assert got == {(f"{i:03d}a", f"{i:03d}b") for i in want} and len(want) > 40


def test_hot_copies_become_a_star(spark):
    df = spark.createDataFrame([(f"k{i:04d}", "bu metin çok kez tekrar eden aynı metindir") for i in range(300)], "id string, text string")
    got = near_duplicates.key_pairs(*near_duplicates.near_duplicates(df, "id", "text", 3, 0.6)).collect()
    assert {(r.key_a, r.key_b) for r in got} == {("k0000", f"k{i:04d}") for i in range(1, 300)}


def test_different_texts_of_a_hot_class_are_paired_in_full(spark):
    base = "bu metin çok kez tekrar eden aynı metindir"
    texts = [base] * 260 + [base + "."] * 3 + [base.replace("i", "İ").upper()] + [base.replace(" ", ", ", 1)] * 2
    df = spark.createDataFrame([(f"k{i:04d}", x) for i, x in enumerate(texts)], "id string, text string")
    rows = near_duplicates.key_pairs(*near_duplicates.near_duplicates(df, "id", "text", 3, 0.6)).collect()
    got = {(r.key_a, r.key_b) for r in rows}
    others = [0] + list(range(260, len(texts)))
    want = {("k0000", f"k{i:04d}") for i in range(1, 260)} | {(f"k{i:04d}", f"k{j:04d}") for i in others for j in others if i < j and shingles(texts[i], 3) == shingles(texts[j], 3)}
    assert got == want and len(rows) == len(want) and len(want) > 270


def test_hot_tokens_go_in_blocks(monkeypatch):
    monkeypatch.setattr(overlap, "BLOCK", 8)
    n = 30
    m = overlap.Matrix(np.repeat(np.uint64(7), n), np.arange(n), np.ones(n, dtype=np.uint8), np.zeros(n, dtype=np.uint8), np.arange(n), np.full(n, 50), np.frombuffer(bytes(16 * n), dtype="V16"))
    found = set()
    for kind, got in overlap.join_bucket(overlap.Matrix.from_bytes([m.to_bytes()]), 0.6, False):
        if kind == "pairs":
            assert not len(got)
            continue
        x, y = got
        b = overlap.Matrix.from_bytes([x] if y is None else [x, y])
        k = len(overlap.Matrix.from_bytes([x]).token)
        i, j = np.triu_indices(k, 1) if y is None else (v.ravel() for v in np.meshgrid(np.arange(k), np.arange(k, len(b.token)), indexing="ij"))
        found |= set(map(tuple, overlap.unique_pairs([overlap.open_groups(b, i, j, 0.6, False)], False).tolist()))
    assert found == {(i, j) for i in range(n) for j in range(i + 1, n)}


def test_cross_split_against_brute_force(spark):
    texts = collection(11, n=40, low=12, high=60)
    r = random.Random(1)
    splits = ["train", " TRAIN", "test", "Kaggle ", "other", None]
    rows = [(f"q{i:03d}", x, r.choice([None, "", texts[r.randrange(len(texts))]]), r.choice(splits)) for i, x in enumerate(texts)]
    df = spark.createDataFrame(rows + rows[:5], "query_id string, question string, context string, split string").withColumnRenamed("zz", "key")
    side = lambda s: {"train": 1, "test": 0, "kaggle": 0}.get((s or "").strip().lower())
    want = set()
    for a in rows:
        for b in rows:
            if side(a[3]) == 0 and side(b[3]) == 1:
                for f in (1, 2):
                    x, y = shingles(a[f], 3), shingles(b[f], 3)
                    if x and y and len(x & y) >= 0.5 * len(x | y):
                        want.add((a[0], b[0]))
    got = {(r.eval_id, r.train_id) for r in split_overlap.record_pairs(*split_overlap.cross_split(df, 3, 0.5)).collect()}
    assert got <= want and len(got) >= 0.99 * len(want) and len(want) > 5
    assert split_overlap.record_pairs(*split_overlap.cross_split(df.limit(0), 3, 0.5)).count() == 0


@pytest.mark.parametrize("every, insert", [(10, False), (9, True)])
def test_cross_split_of_even_edits(spark, every, insert):
    pairs = pairs_of_even_edits(23, every, insert)
    rows = [(f"{i:03d}{s}", "", x, {"a": "test", "b": "train"}[s]) for i, p in enumerate(pairs) for s, x in zip("ab", p)]
    df = spark.createDataFrame(rows, "query_id string, question string, context string, split string")
    got = {(r.eval_id, r.train_id) for r in split_overlap.record_pairs(*split_overlap.cross_split(df, 3, 0.5)).collect()}
    want = alike(pairs, 0.5)
    assert got == {(f"{i:03d}a", f"{i:03d}b") for i in want} and len(want) == len(pairs)


def test_cross_split_near_the_threshold(spark):
    r = random.Random(24)
    pairs = []
    while len(pairs) < 60:  # random edits down to a likeness of 0.50 to 0.53
        a = [r.choice(VOCABULARY) for _ in range(r.randint(130, 200))]
        b = list(a)
        like = 1.0
        while like >= 0.53:
            b = edited(r, b, 1)
            x, y = shingles(" ".join(a), 3), shingles(" ".join(b), 3)
            like = len(x & y) / len(x | y)
        if like >= 0.5:
            pairs.append((" ".join(a), " ".join(b)))
    rows = [(f"{i:03d}{s}", "", x, {"a": "test", "b": "train"}[s]) for i, p in enumerate(pairs) for s, x in zip("ab", p)]
    df = spark.createDataFrame(rows, "query_id string, question string, context string, split string")
    got = {(x.eval_id, x.train_id) for x in split_overlap.record_pairs(*split_overlap.cross_split(df, 3, 0.5)).collect()}
    assert got == {(f"{i:03d}a", f"{i:03d}b") for i in range(len(pairs))}


def test_prefixes_of_alike_sets_meet():
    r = np.random.default_rng(25)
    ranks = r.integers(0, 4, 1 << overlap.SKETCH_BITS).astype(np.uint8)
    for t in (0.5, 0.6, 0.8, 1.0):
        for _ in range(200):
            n = int(r.integers(1, 60))
            common = int(np.ceil(t * n - 1e-9))
            pool = r.choice(1 << 32, 2 * n, replace=False).astype(np.uint64)
            ranks[(pool[:common] & np.uint64(len(ranks) - 1)).astype(np.int64)] = 9  # the common tokens are the most frequent
            b = np.concatenate([pool[:common], pool[n : n + int(common / t + 1e-9) - common]])
            token, doc, rest = overlap.prefixes(np.concatenate([pool[:n], b]), np.array([n, len(b)]), ranks, t)
            both = np.intersect1d(token[doc == 0], token[doc == 1])
            assert len(both) or common < t * (n + len(b) - common) - 1e-9


def test_containment(spark):
    e, t = "bir iki üç dört beş altı yedi", "bir iki üç dört beş altı yedi sekiz dokuz on"
    df = spark.createDataFrame([("e", e, None, "test"), ("t", t, None, "train")], "query_id string, question string, context string, split string")
    r = split_overlap.record_pairs(*split_overlap.cross_split(df, 3, 0.5)).first()
    assert (r.containment, r.likeness) == (1.0, 5 / 8)


def test_best_fit_invariants():
    r = np.random.default_rng(2)
    size = np.sort(r.integers(0, 101, 800))[::-1]
    source, cluster = r.integers(0, 6, 800), r.integers(0, 500, 800)
    bins, at = packing.best_fit(size, source, cluster, 100)
    load = np.bincount(bins, weights=size)
    assert load.max() <= 100 and load.sum() == size.sum() and len(load) <= 1.03 * np.ceil(size.sum() / 100)
    assert len(set(zip(bins.tolist(), at.tolist()))) == 800 and len(set(zip(bins.tolist(), cluster.tolist()))) == 800
    hot, _ = packing.best_fit(np.full(300, 10), np.zeros(300, dtype=int), np.zeros(300, dtype=int), 100)
    assert len(set(hot.tolist())) <= 31  # more copies than sequences: they are spread evenly and waste no room


def test_pack(spark):
    rows = [(1, "a", 5, 5000), (2, None, 6, 0), (3, "a", 7, 2048), (4, "b", 8, 1000), (5, "b", 8, 1000), (6, "c", 9, 48)]
    df = spark.createDataFrame(rows, "doc_id long, source string, cluster long, n_tokens long")
    got = packing.pack(df).collect()
    by: dict = {}
    for x in got:
        by.setdefault(x.doc_id, []).append(x)
    assert {d: sum(x.n_tokens for x in v) for d, v in by.items()} == {1: 5000, 2: 0, 3: 2048, 4: 1000, 5: 1000, 6: 48}
    assert {d: len(v) for d, v in by.items()} == {1: 3, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1}
    assert by[4][0].sequence != by[5][0].sequence
    assert packing.pack(df.limit(0)).count() == 0


def test_token_counts(spark):
    pytest.importorskip("tiktoken")
    df = spark.createDataFrame([(1, "merhaba dünya", "s"), (2, None, None), (3, "x" * 60_000, "s"), (4, "", "s")], "doc_id long, text string, source string")
    n = {r.doc_id: r.n_tokens for r in packing.token_counts(df).collect()}
    assert n[1] >= 2 and n[2] == 0 and n[4] == 0 and n[3] > 100


def test_leaks_against_brute_force(spark, monkeypatch):
    r = random.Random(9)
    items = [("i%d" % i, " ".join(r.choice(VOCABULARY[:400]) for _ in range(r.randint(5, 40)))) for i in range(20)] + [("i0", None), ("i1", "kısa"), (None, "x")]
    docs = []
    for i in range(80):
        w = [r.choice(VOCABULARY[:400]) for _ in range(r.randint(0, 60))]
        src = (r.choice(items[:20])[1]).split()
        a = r.randint(0, max(0, len(src) - 12))
        w[len(w) // 2 : len(w) // 2] = src[a : a + r.randint(10, 20)]
        docs.append((i, " ".join(w).upper().replace("I", "I") if i % 7 == 0 else " ".join(w)))
    docs += [(100, None), (101, ""), (0, docs[0][1])]
    grams = lambda t: shingles(t, 14)
    want = {(d, q) for d, t in docs for q, x in items if q and grams(t) & grams(x)}
    dd, ii = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "query_id string, text string")
    assert {(x.doc_id, x.query_id) for x in leaks.leaked_items(dd, ii).collect()} == want and len(want) > 10
    monkeypatch.setattr(leaks, "BROADCAST_KEYS", 0)
    monkeypatch.setattr(leaks, "MOST_BITS", 16)
    monkeypatch.setattr(leaks, "PLACES", 1)
    assert {(x.doc_id, x.query_id) for x in leaks.leaked_items(dd, ii).collect()} == want
    assert leaks.leaked_items(dd.limit(0), ii).count() == 0 and leaks.leaked_items(dd, ii.limit(0)).count() == 0


def test_sums_over_runs():
    r = np.random.default_rng(3)
    vectors = r.standard_normal((subjects.TERMS, 7))
    s = subjects.STRETCH
    for length in ([1], [s], [s + 1], [3 * s, 1, 2 * s + 5, s - 1, 5000], r.integers(1, 40, 1300), r.integers(1, 700, 600)):
        length = np.array(length)
        term = r.integers(0, subjects.TERMS, length.sum()).astype(np.uint16)
        term[r.random(len(term)) < 0.2] = subjects.NO_TERM
        want = [vectors[x[x != subjects.NO_TERM]].sum(axis=0) for x in np.split(term, np.cumsum(length)[:-1])]
        assert np.allclose(subjects.run_sums(vectors, term, length), want)


def test_sums_over_runs_take_few_seconds():
    """No more than a few times as long as reading each word's vector and adding it somewhere."""
    r = np.random.default_rng(4)
    vectors = r.standard_normal((subjects.TERMS, subjects.RANK)).astype(np.float32)
    length = r.integers(1, 45, 10_000)
    term = r.integers(0, subjects.TERMS, length.sum()).astype(np.uint16)

    def seconds(f):
        taken = []
        for _ in range(5):
            began = time.thread_time()
            f()
            taken.append(time.thread_time() - began)
        return min(taken)

    def plain():
        total = np.zeros((500, subjects.RANK), dtype=np.float32)
        for lo in range(0, len(term) - 500, 500):
            total += vectors[term[lo : lo + 500]]

    ratio = seconds(lambda: subjects.run_sums(vectors, term, length)) / seconds(plain)
    assert ratio < 5, ratio


def test_subjects_of_held_out_documents(spark):
    r = random.Random(12)
    own = {a: [r.choice(VOCABULARY) for _ in range(12)] for a in ("x", "y", "z")}
    common = [r.choice(VOCABULARY) for _ in range(25)]
    sentence = lambda a: " ".join(r.choice(own[a]) if a and r.random() < 0.5 else r.choice(common) for _ in range(12)).capitalize() + "."
    docs, truth = [], {}
    for i in range(240):
        areas = r.choice([["x"], ["y"], ["z"], ["x", "z"], []])
        docs.append((i, " ".join(sentence(r.choice(areas) if areas else None) for _ in range(16))))
        truth[i] = set(areas)
    docs += [(900, None), (901, ""), (902, " ")]
    labels = [(i, a, "p") for i in range(60) for a in truth[i]] + [(5, "gone", "p"), (999, "x", "p"), (0, "y", "q")]
    areas = spark.createDataFrame([(a, a, " ".join(own[a][:6])) for a in own], "subject string, title string, description string")
    dd, ll = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(labels, "doc_id long, subject string, annotator string")
    got: dict = {}
    for x in subjects.document_subjects(dd, areas, ll).collect():
        got.setdefault(x.doc_id, set()).update({x.subject} - {None})
    assert set(got) == {d for d, _ in docs}
    held = [i for i in range(60, 240)]
    some = [i for i in held if truth[i]]
    hits, given, due = (sum(len(f(i)) for i in some) for f in (lambda i: got[i] & truth[i], lambda i: got[i], lambda i: truth[i]))
    assert 2 * hits / (given + due) >= 0.8 and not got[900] and not got[901], (hits, given, due)
    assert subjects.document_subjects(dd.limit(0), areas, ll).count() == 0
    assert {x.subject for x in subjects.document_subjects(dd, areas.limit(0), ll).collect()} == {None}


def test_each_query_has_its_function():
    from kervan.llm import queries

    names = queries.queries()
    assert {f"p{n}_found" for n in (1, 2, 3, 4, 5, 6, 8, 9)} <= set(names) and "p7_packed" in names and set(queries.oracle_sql()) <= set(names)


def test_token_counts_are_the_tokenizer_s(monkeypatch):
    pytest.importorskip("tiktoken")
    enc = packing.encoding(packing.VOCABULARY)
    monkeypatch.setattr(packing, "BLANK_RUN", 50)
    monkeypatch.setattr(packing, "_BLANKS", re.compile(packing._BLANKS.pattern.replace("20000", "50")))
    r = random.Random(3)
    for _ in range(500):
        t = "".join(r.choice(["abc", " " * 60, "\n" * 55, "\t \xa0" * 20, "x. ", "12", "'s", " ", "\n", "dı"]) for _ in range(r.randint(1, 9)))
        assert packing.n_tokens(enc, t) == len(enc.encode_ordinary(t))


def test_tree_merge_in_rounds(spark):
    from kervan.llm import util

    def one(batches):
        n = sum(b.num_rows for b in batches)
        yield util.partial_rows([n.to_bytes(8, "little"), b"\x01"])

    df = spark.range(1000).repartition(200)
    merge = lambda xs: sum(int.from_bytes(bytes(x), "little") for x in xs).to_bytes(8, "little")
    got = util.tree_merged(df.mapInArrow(one, util.PARTIAL), 200, merge)
    assert {p: int.from_bytes(x, "little") for p, x in got.items()} == {0: 1000, 1: 200}
