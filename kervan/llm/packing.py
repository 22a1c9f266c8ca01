"""Problem 7: packing documents into training sequences of a fixed number of tokens.

Method: conflict-constrained best fit. Items go by falling size to the bin of the least residual room that takes them.
Open bins are kept by residual with a bitmap of the residuals that occur; the successor search starts at the item's size and
goes on to the next residual until a compatible bin is found. A bin carries a bitmap of sources and one of duplicate
clusters; a set bit means that the bin has its fill of it. That is one item for every cluster and source that could be spread over
all bins, and evenly more for those with more items than there are bins, so that a hot one wastes no room.

Documents are spread over shards by hash; a shard is packed in one task and has SHARD_ITEMS items, about, at any scale.
"""

from __future__ import annotations

import base64
import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kervan.llm.util import cut_lineage

CAPACITY = 2_048
SHARD_ITEMS = 16_384
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: how byte-level BPE vocabularies of this kind cut text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A longer run of white space is merged apart from the text around it: the pattern's search ahead would not get through it.
BLANK_RUN = 20_000
_BLANKS = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % BLANK_RUN)


@functools.cache
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def n_tokens(enc, t: str) -> int:
    """Tokens of a text. A long run of white space is one piece of the pattern, less its last character where more text follows, so it is cut there."""
    n = at = 0
    if len(t) >= BLANK_RUN:
        for m in _BLANKS.finditer(t):
            a, b = m.span()
            b -= b < len(t)
            n += len(enc.encode_ordinary(t[at:a])) + len(enc._core_bpe.encode_single_piece(t[a:b].encode()))
            at = b
    return n + len(enc.encode_ordinary(t[at:] if at else t))


def token_counts(df: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, cluster, n_tokens) of rows (doc_id, text, source); null texts count as empty. cluster: hash of the text."""
    key = df.schema["doc_id"].dataType.simpleString()

    def apply(batches):
        enc = encoding(path)
        for b in batches:
            n = [n_tokens(enc, t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), b.column("cluster"), pa.array(n, pa.int64())], names=["doc_id", "source", "cluster", "n_tokens"])

    rows = df.select("doc_id", F.col("source").cast("string").alias("source"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("cluster"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(apply, f"doc_id {key}, source string, cluster bigint, n_tokens bigint")


def fills(groups: np.ndarray, bins: int) -> np.ndarray:
    """How many items of each group a bin may take: one, or an even share of a group with more items than bins."""
    return np.maximum(1, np.ceil(np.bincount(groups, minlength=1) * 1.25 / max(1, bins))).astype(np.int64)


def best_fit(size: np.ndarray, source: np.ndarray, cluster: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, place within the bin) of every item; items are in the order in which they are packed, sizes fall."""
    bins = max(1, int(np.ceil(size.sum() / capacity)))
    room_s, room_c = fills(source, bins), fills(cluster, bins)
    lone = np.bincount(cluster, minlength=1) == 1  # a cluster of one item needs no bit
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bitmap of residuals that occur
    full_s: list[int] = []
    full_c: list[int] = []
    held: list[dict] = []
    filled: list[int] = []
    out_bin, out_at = np.empty(len(size), dtype=np.int64), np.empty(len(size), dtype=np.int64)
    for i, (n, s, c) in enumerate(zip(size.tolist(), source.tolist(), cluster.tolist())):
        bit_s, bit_c = 1 << s, 0 if lone[c] else 1 << c
        chosen = second = None
        r = n
        while (ahead := rooms >> r) and chosen is None:
            r += (ahead & -ahead).bit_length() - 1  # the next residual that occurs
            for at, b in enumerate(by_room[r]):
                if not full_c[b] & bit_c:
                    if not full_s[b] & bit_s:
                        chosen = (r, at)
                        break
                    second = second or (r, at)  # fits, but the source has its fill
            r += 1
        chosen = chosen or second
        if chosen is None:
            b, r = len(filled), capacity
            full_s.append(0), full_c.append(0), held.append({}), filled.append(0)
        else:
            r, at = chosen
            row = by_room[r]
            b, row[at] = row[at], row[-1]
            row.pop()
            if not row:
                rooms &= ~(1 << r)
        out_bin[i], out_at[i] = b, filled[b]
        filled[b] += 1
        h = held[b]
        h[s, 0] = h.get((s, 0), 0) + 1
        if h[s, 0] >= room_s[s]:
            full_s[b] |= bit_s
        if bit_c:
            h[c, 1] = h.get((c, 1), 0) + 1
            if h[c, 1] >= room_c[c]:
                full_c[b] |= bit_c
        by_room[r - n].append(b)
        rooms |= 1 << (r - n)
    return out_bin, out_at


def pack(counts: DataFrame, capacity: int = CAPACITY, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """(doc_id, piece_no, sequence, position, first_token, n_tokens) of rows (doc_id, source, cluster, n_tokens).

    Every document comes out: whole, as piece 0, or, if it has more tokens than the capacity, as full pieces and a rest.
    A document without tokens takes a position of no length. Two copies of a text share a sequence only where there are more
    copies than sequences; documents of one source share one only if no other place is left or there are more of them.
    A null source is a source of its own. Repeated doc_ids are packed as often as they occur. Ties go by doc_id.
    """
    counts = cut_lineage(counts)
    total = counts.agg(F.count("*").alias("n"), F.sum(F.col("n_tokens") / capacity).alias("full")).first()
    shards = max(1, round((total.n + (total.full or 0)) / shard_items))
    key = counts.schema["doc_id"].dataType.simpleString()
    spec = f"doc_id {key}, piece_no int, sequence bigint, position int, first_token bigint, n_tokens bigint"

    def apply(t: pa.Table) -> pa.Table:
        shard = t.column("shard")[0].as_py()
        n = t.column("n_tokens").to_numpy()
        pieces = np.maximum(1, -(-n // capacity))
        row = np.repeat(np.arange(len(n)), pieces)
        no = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        size = np.minimum(capacity, n[row] - no * capacity)
        ids = t.column("doc_id").combine_chunks()
        rank = np.argsort(np.argsort(np.array(ids.to_pylist(), dtype=object if key == "string" else None), kind="stable"), kind="stable")
        order = np.lexsort((no, rank[row], -size))
        code = lambda c: np.unique(np.array(["" if v is None else f"{v}=" for v in t.column(c).to_pylist()]), return_inverse=True)[1]
        got, at = best_fit(size[order], code("source")[row[order]], code("cluster")[row[order]], capacity)
        return pa.table({"doc_id": ids.take(pa.array(row[order])), "piece_no": pa.array(no[order].astype(np.int32)), "sequence": pa.array((shard << 32) + got), "position": pa.array(at.astype(np.int32)), "first_token": pa.array(no[order] * capacity), "n_tokens": pa.array(size[order])})

    return counts.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards))).groupBy("shard").applyInArrow(apply, spec)


def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: sequences, tokens, share of the room that is used, and the longest sequence."""
    packed = p7_packed(spark, sf_dir)
    each = packed.groupBy("sequence").agg(F.sum("n_tokens").alias("n"))
    return each.agg(F.count("*").alias("n_sequences"), F.sum("n").alias("n_tokens"), F.round(F.sum("n") / (F.count("*") * CAPACITY), 6).alias("share_used"), F.max("n").alias("longest"))
