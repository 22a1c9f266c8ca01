"""Similarity join of texts by their sets of word sequences: the engine of problems 3 and 5.

Method: token-group matrix. Texts become sets of hashed k-word sequences; equal sets are one class. Similar classes of
a task form groups. The matrix has, by token, the groups in whose prefix union the token is, with its place there, the
bounds of the group and its members. The prefix of a set of n tokens is its n - ceil(t n) + 1 rarest, in an order by a
sketch of counts over all texts that is the same for all sets: two sets of a likeness of t have ceil(t n) common tokens
or more, so the first of them in that order is in both prefixes, and no pair is lost, whatever the texts hold.
Token buckets of the matrix are joined in numpy: groups whose sizes rule out the threshold are not opened, nor those that
have too few tokens from the shared one on, nor members whose parity bitmaps differ in more places than the threshold
allows. What remains is verified exactly on the whole sets.

Nothing grows on the driver but the sketch, whose size is fixed. Copies are folded into classes before any shuffle
of tokens. A token that many groups share is handed on as pairs of blocks, spread over tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kervan.llm.util import PARTIAL, cut_lineage, partial_rows, tasks_of, tree_merged, written
from kervan.llm.words import each, mix

#: log2 of the counters of the token sketch; its ranks are one byte each, so 4 MB go to every task, at any scale.
SKETCH_BITS = 22
#: Matrix entries in a bucket, about; a bucket is joined in one task's memory (some 50 bytes an entry).
BUCKET_ENTRIES = 2_000_000
#: Groups that may share a token before its row is handed on in blocks of this many.
BLOCK = 4_096
#: Members of one group at most; further similar texts form the next group.
GROUP = 32

#: Bits of the parity bitmap of a set.
BITS = 256

SETS = "key string, side byte, cls bigint, txt bigint, n int, toks binary, bits binary"
_P = "a bigint, b bigint"


def parity(toks: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Bitmap rows: bit x of a text is 1 if an odd number of its tokens fall on x. Bitmaps differ in no more places than the sets."""
    n = len(first) - 1
    doc = np.repeat(np.arange(n), np.diff(first))
    place = (mix(toks ^ np.uint64(0x5555)) % np.uint64(BITS)).astype(np.int64)
    return np.packbits(np.bincount(doc * BITS + place, minlength=n * BITS).reshape(n, BITS) & 1, axis=1)


def token_sets(df: DataFrame, k: int) -> DataFrame:
    """(key, side, cls, txt, n, toks, bits) of rows (key, side, field, text): the set of k-word sequences of each text, its class, a hash of
    the stored text and its bitmap.

    Texts of fewer than k words (null and empty ones too) have no sequences and are left out. A task keeps the
    tokens of a class once; further copies have nulls there.
    """

    def apply(batches):
        seen: set[tuple[int, int]] = set()
        for b in batches:
            keys, sides = b.column("key"), b.column("side").to_numpy(zero_copy_only=False)
            fields, txts = b.column("field").to_numpy(zero_copy_only=False), b.column("txt")
            for lo, w in each(b.column("text")):
                for field in np.unique(fields[lo : lo + w.n]):
                    toks, first = w.sets(k, int(field))
                    n = np.diff(first)
                    bits = parity(toks, first)
                    total = np.zeros(len(toks) + 1, dtype=np.uint64)
                    np.cumsum(mix(toks + np.uint64(1)), out=total[1:])
                    cls = mix((total[first[1:]] - total[first[:-1]]) ^ np.uint64(int(field))).view(np.int64)
                    rows = np.flatnonzero((n > 0) & (fields[lo : lo + w.n] == field))
                    blobs, maps = [], []
                    for d in rows:
                        mark = (int(cls[d]), int(sides[lo + d]))
                        new = mark not in seen
                        blobs.append(pack32(toks[first[d] : first[d + 1]]) if new else None)
                        maps.append(bits[d].tobytes() if new else None)
                        seen.add(mark)
                    yield pa.RecordBatch.from_arrays(
                        [keys.take(pa.array(lo + rows)), pa.array(sides[lo + rows], pa.int8()), pa.array(cls[rows]), txts.take(pa.array(lo + rows)), pa.array(n[rows].astype(np.int32))] + [pa.array(x, pa.binary()) for x in (blobs, maps)],
                        names=["key", "side", "cls", "txt", "n", "toks", "bits"],
                    )

    return df.select("key", "side", "field", "text", F.xxhash64("text").alias("txt")).where("text IS NOT NULL AND key IS NOT NULL").mapInArrow(apply, SETS)


def token_ranks(sets: DataFrame) -> tuple[np.ndarray, int]:
    """(rank by sketch cell: a byte that rises with the logarithm of how often the cell's tokens occur, number of tokens)."""
    cells, parts = 1 << SKETCH_BITS, 16

    def count(batches):
        total, tokens = np.zeros(cells, dtype=np.uint32), 0
        for b in batches:
            toks, _ = unpack32(b.column(0).to_pylist())
            total += np.bincount((toks & np.uint64(cells - 1)).astype(np.int64), minlength=cells).astype(np.uint32)
            tokens += len(toks)
        if tokens:
            yield partial_rows([*(levels(x).tobytes() for x in np.split(total, parts)), np.int64(tokens).tobytes()])

    def levels(x):  # counts as bytes: 8 steps for each doubling keep a sum of many tasks' counts within a few percent
        return np.minimum(255, np.round(8 * np.log2(x + 1.0))).astype(np.uint8)

    def merge(blobs):
        if len(blobs[0]) == 8:
            return np.int64(sum(int(np.frombuffer(x, dtype=np.int64)[0]) for x in blobs)).tobytes()
        return levels(sum(2.0 ** (np.frombuffer(x, dtype=np.uint8) / 8.0) - 1 for x in blobs)).tobytes()

    got = tree_merged(sets.where("toks IS NOT NULL").select("toks").mapInArrow(count, PARTIAL), tasks_of(sets), merge)  # 16 rows of 256 KB and one number
    if not got:
        return np.zeros(cells, dtype=np.uint8), 0
    return np.concatenate([np.frombuffer(got[p], dtype=np.uint8) for p in range(parts)]), int(np.frombuffer(got[parts], dtype=np.int64)[0])


def pack32(t: np.ndarray) -> bytes:
    """The lower halves of tokens: enough to compare two sets, which differ by chance in less than one of 10,000 pairs by one token."""
    return (t & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes()


def unpack32(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(blobs), dtype="<u4").astype(np.uint64), np.array([len(b) // 4 for b in blobs], dtype=np.int64)


class Matrix:
    """Entries (token, group, rest) of one bucket, with the sides and the members (class, size, bitmap) of its groups.

    rest: the tokens of a member from this one on in the order of ranks, as 255ths of the group's largest size, rounded
    up; the most of any member.
    Members of a group are in order of size, so the first and the last have its bounds.
    """

    NAMES = ("token", "group", "count", "side", "cls", "n", "bits", "rest")
    TYPES = ("<u4", "<u4", "u1", "u1", "<i8", "<u4", f"V{BITS // 8}", "u1")

    def __init__(self, token, group, count, side, cls, n, bits, rest=None):
        self.token, self.group, self.count, self.side, self.cls, self.n, self.bits = token, group, count, side, cls, n, bits
        self.rest = np.full(len(token), 255, dtype=np.uint8) if rest is None else rest
        self.first = np.concatenate([[0], np.cumsum(count, dtype=np.int64)])
        self.low, self.high = n[self.first[:-1]], n[self.first[1:] - 1]

    def to_bytes(self) -> bytes:
        arrays = [getattr(self, k).astype(t) for k, t in zip(self.NAMES, self.TYPES)]
        return np.array([len(a) for a in arrays], dtype="<u4").tobytes() + b"".join(a.tobytes() for a in arrays)

    @classmethod
    def from_bytes(cls, blobs: list[bytes]) -> "Matrix":
        parts: dict[str, list] = {k: [] for k in cls.NAMES}
        groups = 0
        for b in blobs:
            sizes = np.frombuffer(b, dtype="<u4", count=len(cls.NAMES))
            at = 4 * len(cls.NAMES)
            for k, t, m in zip(cls.NAMES, cls.TYPES, sizes):
                a = np.frombuffer(b, dtype=t, count=int(m), offset=at)
                at += a.nbytes
                parts[k].append(a.astype(np.int64) + groups if k == "group" else a)
            groups += int(sizes[2])
        return cls(**{k: np.concatenate(v) for k, v in parts.items()})

    def take(self, entries: np.ndarray) -> "Matrix":
        """Only these entries, with only their groups."""
        used, group = np.unique(self.group[entries], return_inverse=True)
        count = self.count[used].astype(np.int64)
        member = np.repeat(self.first[used] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        return Matrix(self.token[entries], group, self.count[used], self.side[used], self.cls[member], self.n[member], self.bits[member], self.rest[entries])


def open_groups(m: Matrix, i: np.ndarray, j: np.ndarray, t: float, two_sided: bool) -> np.ndarray:
    """Candidate member pairs of the entries i and j of one token each, as an array of shape (pairs, 2)."""
    g, h = m.group[i], m.group[j]
    need = t / (1 + t) * (m.low[g].astype(np.float64) + m.low[h]) - 1e-6
    ok = (m.rest[i] * m.high[g] >= 255 * need) & (m.rest[j] * m.high[h] >= 255 * need) & (g != h)
    ok &= (m.high[g] >= t * m.low[h] - 1e-9) & (m.high[h] >= t * m.low[g] - 1e-9)
    if two_sided:
        ok &= m.side[g] != m.side[h]
    g, h = g[ok], h[ok]
    if not len(g):
        return np.zeros((0, 2), dtype=np.int64)
    flip = (m.side[g] > m.side[h]) if two_sided else (g > h)
    g, h = np.where(flip, h, g), np.where(flip, g, h)
    pair = np.unique(g.astype(np.uint64) << np.uint64(32) | h.astype(np.uint64))
    g, h = (pair >> np.uint64(32)).astype(np.int64), (pair & np.uint64(0xFFFFFFFF)).astype(np.int64)
    cg, ch = m.first[g + 1] - m.first[g], m.first[h + 1] - m.first[h]
    size = cg * ch
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    wide = np.repeat(ch, size)
    x, y = np.repeat(m.first[g], size) + at // wide, np.repeat(m.first[h], size) + at % wide
    return members_alike(m.cls, m.n, m.bits, x, y, t)


def members_alike(cls: np.ndarray, n: np.ndarray, bits: np.ndarray, x: np.ndarray, y: np.ndarray, t: float) -> np.ndarray:
    """Those pairs of the members x and y, as classes, that neither sizes nor bitmaps rule out."""
    fits = (np.minimum(n[x], n[y]) >= t * np.maximum(n[x], n[y]) - 1e-9) & (cls[x] != cls[y])
    x, y = x[fits], y[fits]
    words = bits.view("<u8").reshape(-1, BITS // 64)
    differ = np.bitwise_count(words[x] ^ words[y]).sum(axis=1, dtype=np.int64)
    fits = differ <= (1 - t) / (1 + t) * (n[x].astype(np.int64) + n[y]) + 1e-9
    return np.stack([cls[x[fits]], cls[y[fits]]], axis=1)


def unique_pairs(pairs: list[np.ndarray], two_sided: bool) -> np.ndarray:
    p = np.concatenate(pairs) if pairs else np.zeros((0, 2), dtype=np.int64)
    p = p[p[:, 0] != p[:, 1]]  # equal sets need no comparison
    if not two_sided:
        p = np.sort(p, axis=1)
    order = np.lexsort((p[:, 1], p[:, 0]))
    p = p[order]
    keep = np.ones(len(p), dtype=bool)
    keep[1:] = (p[1:] != p[:-1]).any(axis=1)
    return p[keep]


def _batch(pairs: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, 0])), pa.array(np.ascontiguousarray(pairs[:, 1]))], names=["a", "b"])


def prefixes(toks: np.ndarray, n: np.ndarray, ranks: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token, set, tokens of the set from it on) of the tokens by which a set of n meets every set of a likeness of t: all but
    the ceil(t n) - 1 most frequent, since two such sets have ceil(t n) common tokens at least. toks: those of all sets."""
    docs = np.repeat(np.arange(len(n)), n)
    rank = ranks[(toks & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64)]
    packed = np.sort((docs.astype(np.uint64) << np.uint64(40)) | (rank.astype(np.uint64) << np.uint64(32)) | toks)
    rest = n[docs] - (np.arange(len(packed)) - np.repeat(np.cumsum(n) - n, n))
    front = rest >= np.ceil(t * n - 1e-9)[docs]
    return packed[front] & np.uint64(0xFFFFFFFF), docs[front], rest[front]


def matrix_blobs(sets: DataFrame, ranks: np.ndarray, t: float, buckets: int) -> DataFrame:
    """(bucket, blob): the token-group matrix, cut by token; buckets under 0 have pairs within groups. A batch only looks at buckets it has tokens of."""

    def apply(batches):
        seen: set[tuple[int, int]] = set()
        for b in batches:
            cls_all, side_all = (b.column(c).to_numpy() for c in ("cls", "side"))
            new = np.array([(m := (int(x), int(y))) not in seen and not seen.add(m) for x, y in zip(cls_all, side_all)], dtype=bool)
            if not new.any():
                continue
            cls, side = cls_all[new], side_all[new]
            toks, n = unpack32([x for x, y in zip(b.column("toks").to_pylist(), new) if y])
            bits = np.frombuffer(b"".join(x for x, y in zip(b.column("bits").to_pylist(), new) if y), dtype=f"V{BITS // 8}")
            token, docs, rest = prefixes(toks, n, ranks, t)
            # groups: classes with the same least prefix token by hash, of similar size and one side, GROUP at most
            least = np.minimum.reduceat(mix(token), np.flatnonzero(np.append(True, docs[1:] != docs[:-1])))
            near = np.floor(np.log(n) / -np.log(t) + 1e-9).astype(np.int64)
            order = np.lexsort((n, near, side, least))
            same = np.zeros(len(order), dtype=bool)
            same[1:] = (least[order][1:] == least[order][:-1]) & (near[order][1:] == near[order][:-1]) & (side[order][1:] == side[order][:-1])
            run = np.arange(len(order)) - np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
            begins = ~same | (run % GROUP == 0)
            group = np.empty(len(order), dtype=np.int64)
            group[order] = np.cumsum(begins) - 1
            at = np.flatnonzero(begins)
            count = np.diff(np.append(at, len(order)))
            # the union of each group's prefixes
            high = n[order][at + count - 1]
            share = np.ceil(255 * rest / high[group[docs]]).astype(np.uint64)
            packed = np.sort((group[docs].astype(np.uint64) << np.uint64(40)) | (token << np.uint64(8)) | share)
            last = np.append(packed[1:] >> np.uint64(8) != packed[:-1] >> np.uint64(8), True)
            once = packed[last]
            m = Matrix((once >> np.uint64(8)) & np.uint64(0xFFFFFFFF), (once >> np.uint64(40)).astype(np.int64), count, side[order][at], cls[order], n[order], bits[order], (once & np.uint64(255)).astype(np.uint8))
            bucket = (m.token % np.uint64(buckets)).astype(np.int64)
            o = np.argsort(bucket, kind="stable")
            present, begin = np.unique(bucket[o], return_index=True)
            rows = [(int(k), m.take(own).to_bytes()) for k, own in zip(present, np.split(o, begin[1:]))]
            if many := np.flatnonzero(count > 1).tolist():  # members of one group are candidates of each other
                inner = [np.stack(np.triu_indices(count[q], 1)) + at[q] for q in many]
                x, y = np.concatenate(inner, axis=1)
                if len(pairs := members_alike(m.cls, m.n, m.bits, x, y, t)):
                    rows.append((-1 - int(pairs[0, 0]) % buckets, pairs.astype("<i8").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], names=["bucket", "blob"])

    return sets.where("toks IS NOT NULL").select("cls", "side", "toks", "bits").mapInArrow(apply, "bucket int, blob binary")


def join_bucket(m: Matrix, t: float, two_sided: bool):
    """Yields ('pairs', array) and, for a token of more than BLOCK groups, ('blocks', (blob, blob or None))."""
    order = np.argsort(m.token, kind="stable")
    token = m.token[order]
    begins = np.flatnonzero(np.append(True, token[1:] != token[:-1])) if len(token) else np.zeros(0, dtype=np.int64)
    length = np.diff(np.append(begins, len(token)))
    for s in np.flatnonzero(length > BLOCK):
        own = order[begins[s] : begins[s] + length[s]]
        blocks = [m.take(own[i : i + BLOCK]).to_bytes() for i in range(0, len(own), BLOCK)]
        for x in range(len(blocks)):
            for y in range(x, len(blocks)):
                yield "blocks", (blocks[x], blocks[y] if x != y else None)
    todo = (length > 1) & (length <= BLOCK)
    begins, length = begins[todo], length[todo]
    found, held = [], 0
    by_length = np.argsort(length, kind="stable")
    begins, length = begins[by_length], length[by_length]
    lo = 0
    while lo < len(begins):  # as many tokens at a time as make some two million pairs
        hi = lo + max(1, int(np.searchsorted(np.cumsum(length[lo:] * (length[lo:] - 1) // 2), 2_000_000, side="right")))
        L = length[lo:hi]
        i = np.concatenate([np.repeat(begins[lo:hi][L == x], x * (x - 1) // 2) + np.tile(np.triu_indices(x, 1)[0], int((L == x).sum())) for x in np.unique(L)])
        j = np.concatenate([np.repeat(begins[lo:hi][L == x], x * (x - 1) // 2) + np.tile(np.triu_indices(x, 1)[1], int((L == x).sum())) for x in np.unique(L)])
        found.append(open_groups(m, order[i], order[j], t, two_sided))
        held += len(found[-1])
        if held > 2_000_000:
            yield "pairs", unique_pairs(found, two_sided)
            found, held = [], 0
        lo = hi
    yield "pairs", unique_pairs(found, two_sided)


def candidates(blobs: DataFrame, t: float, two_sided: bool) -> DataFrame:
    """Different pairs (a, b) of classes that the matrix does not rule out."""
    kinds = "kind byte, a bigint, b bigint, x binary, y binary"

    def rows(pairs: np.ndarray) -> pa.RecordBatch:
        k = len(pairs)
        return pa.RecordBatch.from_arrays([pa.array(np.zeros(k, dtype=np.int8)), *_batch(pairs).columns, pa.nulls(k, pa.binary()), pa.nulls(k, pa.binary())], names=["kind", "a", "b", "x", "y"])

    def join(table: pa.Table) -> pa.Table:
        out = [rows(np.zeros((0, 2), dtype=np.int64))]
        x = [v for v in table.column("blob").to_pylist()]
        if table.column("bucket")[0].as_py() < 0:
            out.append(rows(unique_pairs([np.frombuffer(v, dtype="<i8").reshape(-1, 2) for v in x], two_sided)))
        else:
            for kind, got in join_bucket(Matrix.from_bytes(x), t, two_sided):
                if kind == "pairs":
                    out.append(rows(got))
                else:
                    out.append(pa.RecordBatch.from_arrays([pa.array([1], pa.int8()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([got[0]], pa.binary()), pa.array([got[1]], pa.binary())], names=["kind", "a", "b", "x", "y"]))
        return pa.Table.from_batches(out)

    def join_blocks(batches):
        for b in batches:
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                m = Matrix.from_bytes([x] if y is None else [x, y])
                k = len(Matrix.from_bytes([x]).token)
                i, j = np.triu_indices(k, 1) if y is None else (v.ravel() for v in np.meshgrid(np.arange(k), np.arange(k, len(m.token)), indexing="ij"))
                for lo in range(0, len(i), 2_000_000):
                    yield _batch(unique_pairs([open_groups(m, i[lo : lo + 2_000_000], j[lo : lo + 2_000_000], t, two_sided)], two_sided))

    if two_sided:
        blobs = blobs.where("bucket >= 0")  # a group is of one side
    joined = cut_lineage(blobs.groupBy("bucket").applyInArrow(join, kinds))
    hot = joined.where("kind = 1").select("x", "y").repartition(F.xxhash64("x", "y")).mapInArrow(join_blocks, _P)
    return joined.where("kind = 0").select("a", "b").unionAll(hot).distinct()


def seen_filter(ids: DataFrame, bits: int = 25) -> np.ndarray:
    """Bitmap of 2 ** bits places (4 MB, at any scale) by hash of the ids: a place that is off rules an id out."""
    parts = 8

    def mark(batches):
        on = np.zeros(1 << bits, dtype=bool)
        for b in batches:
            for c in b.columns:
                on[(mix(c.to_numpy().view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)] = True
        if on.any():
            yield partial_rows([np.packbits(x).tobytes() for x in np.split(on, parts)])

    def merge(blobs):
        return np.bitwise_or.reduce([np.frombuffer(x, dtype=np.uint8) for x in blobs]).tobytes()

    got = tree_merged(ids.mapInArrow(mark, PARTIAL), tasks_of(ids), merge)
    return np.frombuffer(b"".join(got.get(p, bytes((1 << bits) // 8 // parts)) for p in range(parts)), dtype=np.uint8)


def seen(on: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which ids the bitmap does not rule out."""
    place = (mix(ids.view(np.uint64)) >> np.uint64(64 - (8 * len(on)).bit_length() + 1)).astype(np.int64)
    return (on[place >> 3] >> (7 - (place & 7)).astype(np.uint8) & 1).astype(bool)


def verified(cands: DataFrame, sets: DataFrame, t: float, bits: int = 25) -> DataFrame:
    """(a, b, n_a, n_b, hits, likeness) of the candidates that reach t, counted on the whole sets."""
    on = seen_filter(cands, bits)

    def keep(batches):
        for b in batches:
            yield b.filter(pa.array(seen(on, b.column("cls").to_numpy())))

    one = sets.where("toks IS NOT NULL").select("cls", "toks").mapInArrow(keep, "cls bigint, toks binary").groupBy("cls").agg(F.first("toks").alias("toks"))
    both = cands.join(one.select(F.col("cls").alias("a"), F.col("toks").alias("x")), "a").join(one.select(F.col("cls").alias("b"), F.col("toks").alias("y")), "b")

    def count(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 4096):
                s = b.slice(lo, 4096)
                x, nx = unpack32(s.column("x").to_pylist())
                y, ny = unpack32(s.column("y").to_pylist())
                p = np.arange(s.num_rows, dtype=np.uint64)
                z = np.sort(np.concatenate([(np.repeat(p, nx) << np.uint64(40)) | x, (np.repeat(p, ny) << np.uint64(40)) | y]))
                hits = np.bincount((z[1:][z[1:] == z[:-1]] >> np.uint64(40)).astype(np.int64), minlength=s.num_rows)
                like = hits / np.maximum(1, nx + ny - hits)
                ok = pa.array(like >= t - 1e-12)
                yield pa.RecordBatch.from_arrays([s.column("a"), s.column("b"), pa.array(nx.astype(np.int32)), pa.array(ny.astype(np.int32)), pa.array(hits.astype(np.int32)), pa.array(like)], names=["a", "b", "n_a", "n_b", "hits", "likeness"]).filter(ok)

    return both.select("a", "b", "x", "y").mapInArrow(count, "a bigint, b bigint, n_a int, n_b int, hits int, likeness double")


def similar(df: DataFrame, k: int, t: float, two_sided: bool = False) -> tuple[DataFrame, DataFrame]:
    """(members, links) of rows (key, side, field, text): members (key, side, cls, txt, n) and links (a, b, …) between classes.

    Every pair of different classes of a likeness of at least t, 0 < t <= 1, is one link; with two_sided, only those
    between side 0 (a) and side 1 (b), and equal sets on both sides are members of one class. Rows repeated under one
    key count once. Empty inputs give empty results.
    """
    sets = written(token_sets(df, k), "sets")
    ranks, tokens = token_ranks(sets)
    buckets = max(12, int(tokens * (1 - t)) // BUCKET_ENTRIES)
    cands = cut_lineage(candidates(matrix_blobs(sets, ranks, t, buckets), t, two_sided))
    return sets.select("key", "side", "cls", "txt", "n").dropDuplicates(["key", "side", "cls"]), verified(cands, sets, t)
