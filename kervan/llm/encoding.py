"""Problem 6: text that was decoded with the wrong encoding.

Method: a hidden Markov model over the characters beyond ASCII, with one clean state, one state for characters that are lost
(U+FFFD), and one state for each pair of right and wrong encoding. The most probable path labels every character; what a state
emits is the wrongly decoded form of a character, so each labelled span is restored by the state's inverse mapping.
Costs are negative log probabilities. Only texts with a character outside the clean alphabet are looked at.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kervan.llm.common_form import LOOKALIKES, byte_slices
from kervan.llm.util import first_of_key
from kervan.llm.words import flat_codes

# The right encoding and the one that was used, by Python's names.
PAIRS = [
    ("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "cp1254"), ("utf-8", "cp1251"), ("utf-8", "cp1253"), ("utf-8", "cp1250"),
    ("utf-8", "cp437"), ("utf-8", "cp850"), ("utf-8", "cp857"), ("utf-8", "mac-roman"), ("utf-8", "cp1252+cp1252"),
    ("cp1254", "cp1252"), ("cp1254", "cp1251"), ("cp1254", "cp1253"), ("cp1254", "cp1250"), ("cp1254", "cp437"), ("cp1254", "cp850"),
    ("cp1254", "mac-roman"), ("cp857", "cp1254"), ("cp857", "cp1252"),
]
LETTERS = "çğıöşüÇĞİÖŞÜ"
HATS = "âîûÂÎÛ"
MARKS = "–—‘’“”„…•§°²³«»"
FOREIGN = "áàäãåæèéêëìíïñòóôõøœùúýÿßÁÀÄÃÅÆÈÉÊËÌÍÏÑÒÓÔÕØŒÙÚÝŸðþÐÞ€©®"
CLEAN = LETTERS + HATS + MARKS
#: Cost of entering and leaving a garbled span, and of going on in another one.
ENTER, LEAVE, CHANGE = 5.0, 1.0, 8.0
LOST = "�"
_BEYOND_ASCII = re.compile(r"[^\x00-\x7f]")
#: Characters beyond ASCII after which the common part of all open paths is settled.
SETTLE = 4_096
#: Read only as two bytes, the first of which looks like one of LEADS: blanks and signs that are no letters.
SIGNS = "".join(map(chr, range(0xA0, 0xC0)))
#: What the first bytes of two-byte sequences look like in cp1252.
LEADS = "ÂÃÄÅ"
#: Characters beyond ASCII that are never garbled by themselves, as ranges: invisible ones, blanks, accents, full-width forms, two ligatures, a hyphen.
PASSED = [(0x200B, 0x200F), (0x2060, 0x2064), (0xFEFF, 0xFEFF), (0xAD, 0xAD), (0xFE0F, 0xFE0F), (0x2000, 0x200A), (0x202F, 0x202F), (0xA0, 0xA0), (0x300, 0x36F), (0xFF01, 0xFF5E), (0xFB01, 0xFB02), (0x2011, 0x2011)]


def decoded(raw: bytes, wrong: str) -> str | None:
    """raw as the wrong decoder shows it; bytes that it does not define stay as control characters."""
    for step in wrong.split("+"):
        out = []
        for b in raw:
            try:
                out.append(bytes([b]).decode(step))
            except UnicodeDecodeError:
                out.append(chr(b))
        s = "".join(out)
        raw = s.encode("utf-8")
    return s


@functools.cache
def emissions() -> list[dict[str, tuple[str, float]]]:
    """For each pair of encodings: what is seen -> (the character it stands for, cost)."""
    out = []
    for right, wrong in PAIRS:
        table: dict[str, tuple[str, float]] = {}
        for chars, cost in ((LETTERS, 0.7), (HATS, 1.5), (MARKS, 1.5), (FOREIGN, 5.0)):
            for c in chars:
                try:
                    raw = c.encode(right)
                except UnicodeEncodeError:
                    continue
                seen = decoded(raw, wrong)
                if all(ord(x) > 127 for x in seen):
                    # a character that both encodings show alike is no sign of either
                    table[seen] = (c, cost if seen != c or c in FOREIGN else 1.2)
        if right == "utf-8":
            for c in SIGNS:
                if (seen := decoded(c.encode(right), wrong))[0] in LEADS:
                    table.setdefault(seen, (c, 1.5))
        out.append(table)
    return out


def script(ch: str) -> str:
    o = ord(ch)
    return "latin" if o < 0x250 else "greek" if 0x370 <= o < 0x400 else "cyrillic" if 0x400 <= o < 0x530 else "other"


def foreign_word(t: str, i: int) -> bool:
    """The word around t[i] has another letter that Turkish does not have."""
    a = b = i
    while a and t[a - 1].isalpha():
        a -= 1
    while b + 1 < len(t) and t[b + 1].isalpha():
        b += 1
    return any(ord(x) > 127 and x not in CLEAN and x not in "ðþýÐÞÝ" for x in t[a:i] + t[i + 1 : b + 1])


def stray_lead(t: str, i: int) -> bool:
    """t[i] is an Â before what a second byte looks like, and not the end of a word in capitals or quoted as a letter."""
    if t[i] != "Â" or not "\x80" <= t[i + 1 : i + 2] < "\xc0":
        return False
    before = t[i - 1] if i else " "
    return not before.isupper() and not (before == "«" and t[i + 1] == "»")


def clean_cost(t: str, i: int) -> float:
    """Cost of t[i] in the clean state: high for what does not belong where it stands."""
    ch = t[i]
    if i and stray_lead(t, i - 1):
        return 12.0
    if ch in CLEAN:
        return 0.5
    o = ord(ch)
    if ch in "\xa0\xad":
        return 0.5
    if 0x80 <= o < 0xA0:
        return 12.0
    if i and t[i - 1] in LEADS and t[i - 1 : i + 1] in emissions()[0]:
        return 7.0
    before, after = t[i - 1] if i else " ", t[i + 1] if i + 1 < len(t) else " "
    if not ch.isalpha():
        if not (0xA0 <= o < 0xC0 or 0x2020 <= o < 0x2E00):
            return 0.5
        return 6.0 if before.isalpha() or after.isalpha() else 3.0
    kind = script(ch)
    if kind == "latin":
        if ch.isupper() and before.islower():
            return 10.0  # a capital inside a word: the first byte of a longer sequence
        if ch in "ðþýÐÞÝ":
            return 7.0 if before.isalpha() and not foreign_word(t, i) else 4.0
        return 2.5
    mixed = any(x.isalpha() and script(x) != kind for x in (before, after))
    if not mixed and not before.isalpha() and not after.isalpha():
        mixed = kind == "cyrillic" and ch not in LOOKALIKES
    return (2.0 if ch in LOOKALIKES else 6.0) if mixed else 1.5


@functools.cache
def readings() -> tuple[dict[str, list[tuple[int, str, float]]], dict[str, set[int]], dict[str, list[int]]]:
    """(what is seen -> the states that read it, each with the character and its cost; what is seen -> states of which it is a sign; first character
    -> lengths of what is seen, falling)."""
    reads: dict[str, list[tuple[int, str, float]]] = {}
    signs: dict[str, set[int]] = {}
    for s, table in enumerate(emissions()):
        for seen, (c, cost) in table.items():
            reads.setdefault(seen, []).append((s, c, cost))
            if cost < 5 and seen != c:
                signs.setdefault(seen, set()).add(s)
    sizes: dict[str, set[int]] = {}
    for x in reads:
        sizes.setdefault(x[0], set()).add(len(x))
    return reads, signs, {c: sorted(n, reverse=True) for c, n in sizes.items()}


def label(t: str) -> list[tuple[int, int, int, str]]:
    """(start, end, number of the pair or -1 for lost, what stood there) of every character that is not clean on the best path.

    A text of any length is one path. The part of it that all paths still open have in common is settled from time to time,
    so that only the open part is held.
    """
    at = [m.start() for m in _BEYOND_ASCII.finditer(t)]
    if not at:
        return []
    table, signs, sizes = readings()
    # states that never read a Turkish letter or mark where another character stands are left out
    useful: set[int] = set()
    for i in at:
        if t[i] not in CLEAN or stray_lead(t, i):
            for n in sizes.get(t[i], ()):
                useful |= signs.get(t[i : i + n], set())
    stray = any(t[i] in LEADS and i and t[i - 1].islower() for i in at)
    heads = {seen[0] for s in useful for seen in emissions()[s]}
    if not useful and LOST not in t and not stray:
        return []
    found: list[tuple[int, int, int, str]] = []
    # best[k]: state -> (cost up to before place k, place before, state there, span read from there); state -2 is clean
    best: dict[int, dict[int, tuple[float, int, int, tuple | None]]] = {0: {-2: (0.0, -1, -2, None)}}
    base, due = 0, SETTLE

    def reach(k: int, state: int, cost: float, back: tuple[int, int, tuple | None]) -> None:
        row = best.setdefault(k, {})
        if state not in row or cost < row[state][0]:
            row[state] = (cost, *back)

    def emit(k: int, state: int) -> None:
        """Adds the spans of the path that leads to a state at place k from the last settled place."""
        spans = []
        while k > base:
            _, k, state, span = best[k][state]
            if span:
                spans.append(span)
        found.extend(reversed(spans))

    for k, i in enumerate(at):
        if k not in best:
            continue
        if k >= due:
            open_ = {(q, s) for q, row in best.items() if q >= k for s in row}
            while len(open_) > 1:
                q, s = max(open_)
                open_.remove((q, s))
                open_.add(best[q][s][1:3] if q > base else (base, s))
                if max(open_)[0] == base:
                    break
            q, s = max(open_)
            if len(open_) == 1 and q > base:
                emit(q, s)
                best = {x: row for x, row in best.items() if x >= q}
                best[q] = {s: (best[q][s][0], -1, s, None)}
                base = q
            due = k + SETTLE
        row = best[k]
        if len(row) == 1 and -2 in row and t[i] in CLEAN and t[i] not in heads and t[i] not in LEADS and (not i or t[i - 1] != "Â"):
            reach(k + 1, -2, row[-2][0] + 0.5, (k, -2, None))
            continue
        here: dict[int, tuple[int, str, float]] = {}
        for n in sizes[t[i]] if t[i] in heads else ():
            for s, ch, cost in table.get(t[i : i + n], ()):
                if s in useful and s not in here:
                    here[s] = (n, ch, 8.0 if ch in "ğĞ" and (not i or not t[i - 1].isalpha()) else cost)  # no Turkish word begins with it
        low_state = min(row, key=lambda s: row[s][0])
        low = row[low_state][0]
        clean = row[-2][0] if -2 in row else float("inf")
        cost, frm = (clean, -2) if clean <= low + LEAVE else (low + LEAVE, low_state)
        if t[i] == LOST:
            reach(k + 1, -2, cost + 1.0, (k, frm, None))
        elif t[i] in LEADS and i and t[i - 1].islower():
            reach(k + 1, -2, cost + 10.0, (k, frm, (i, i + 1, -1, LOST)))  # its second byte is lost
        else:
            reach(k + 1, -2, cost + clean_cost(t, i), (k, frm, None))
        for s, (n, ch, own) in here.items():
            c, frm = min((row[s][0] if s in row else float("inf"), s), (clean + ENTER, -2), (low + CHANGE, low_state))
            nxt = k + 1
            while nxt < len(at) and at[nxt] < i + n:
                nxt += 1
            reach(nxt, s, c + own, (k, frm, (i, i + n, s, ch)))
    emit(len(at), min(best[len(at)], key=lambda s: best[len(at)][s][0]))
    # a span in which every character stands for itself says nothing
    return [x for x in found if t[x[0] : x[1]] != x[3]] + [(i, i + 1, -1, LOST) for i in at if t[i] == LOST]


def restored(t: str, spans: list[tuple[int, int, int, str]]) -> str:
    out, at = [], 0
    for a, b, s, ch in sorted(spans):
        out += [t[at:a], ch]
        at = b
    return "".join(out) + t[at:]


@functools.cache
def odd_table() -> np.ndarray:
    """odd_table()[c]: a text with the character is looked at. The last entry is for all higher ones."""
    odd = np.ones(0x10001, dtype=bool)
    odd[:0x80] = False
    odd[[ord(c) for c in CLEAN]] = False
    for lo, hi in PASSED:
        odd[lo : hi + 1] = False
    return odd


def odd_texts(texts: pa.Array) -> np.ndarray:
    """Numbers of the texts with a character outside the clean ones, or with an Â before what a second byte looks like."""
    out = []
    for lo, hi in byte_slices(texts, 600_000):
        codes, offset = flat_codes(texts.slice(lo, hi - lo))
        odd = odd_table()[np.minimum(codes, 0x10000)]
        odd[:-1] |= (codes[:-1] == 0xC2) & (codes[1:] >= 0x80) & (codes[1:] < 0xC0)
        total = np.concatenate([[0], np.cumsum(odd)])
        out.append(lo + np.flatnonzero(total[offset[1:]] > total[offset[:-1]]))
    return np.concatenate(out) if out else np.zeros(0, dtype=np.int64)


def garbled(df: DataFrame, key: str, text: str) -> DataFrame:
    """(rec_key, encodings, n_spans, regained, restored) of every record whose text holds wrongly decoded characters.

    encodings: "right>wrong" pairs found, "lost" for characters that cannot be regained; regained: nothing was lost.
    Null and empty texts are clean, texts of any length are taken whole, rows repeated under a key count once. Texts are
    labelled where they are read; only what was found is shuffled.
    """

    def apply(batches):
        for b in batches:
            which = pa.array(odd_texts(b.column(1)))
            rows = []
            for k, t in zip(b.column(0).take(which).to_pylist(), b.column(1).take(which).to_pylist()):
                if spans := label(t):
                    kinds = sorted({">".join(PAIRS[s]) if s >= 0 else "lost" for _, _, s, _ in spans})
                    rows.append((k, kinds, len(spans), "lost" not in kinds, restored(t, spans)))
            cols = list(zip(*rows)) if rows else [[]] * 5
            types = [pa.string(), pa.list_(pa.string()), pa.int32(), pa.bool_(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), ty) for c, ty in zip(cols, types)], names=["rec_key", "encodings", "n_spans", "regained", "restored"])

    rows = df.where(F.col(f"`{key}`").isNotNull() & F.col(f"`{text}`").isNotNull()).select(F.col(f"`{key}`").cast("string").alias("k"), F.col(f"`{text}`").alias("t"))
    return first_of_key(rows.mapInArrow(apply, "rec_key string, encodings array<string>, n_spans int, regained boolean, restored string"), "rec_key")


def p6_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    cc = spark.read.parquet(f"{sf_dir}/corpus_chunks.parquet")
    qa = spark.read.parquet(f"{sf_dir}/qa_examples.parquet")
    return garbled(cc, "chunk_id", "text").select(F.lit("corpus_chunks").alias("src_table"), "*").unionAll(garbled(qa, "query_id", "answer").select(F.lit("qa_examples").alias("src_table"), "*"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_restored(spark, sf_dir).select("src_table", "rec_key")
