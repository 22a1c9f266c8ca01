"""Problem 2: cutting oversized texts at natural boundaries.

Method: byte ranges. The texts lie one after another in large files: those of a text column are written to the shared folder
first, files are taken as they are. An index says which bytes are whose. Workers take byte ranges of the files, read with
a halo on either side, and make a table of the boundaries of each text's part in their range. The tables of a text's
parts are stitched, prefix sums of their lengths turn local places into offsets, and pieces are emitted by offset. No worker holds
more than its range and the halo: where a piece begins in a part depends on the part before it only through the place of
entry, so each part tabulates entry -> exit for the places at which a piece may begin; tables of neighbouring parts are
composed in a tree, and going down it gives every part its entry.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kervan.llm.util import cut_lineage, first_of_key, new_path, written

LIMIT, OVERLAP = 1_400, 180
#: Bytes in a range of a file.
RANGE_BYTES = 2 << 20
#: Tables of neighbouring parts that are composed at a time.
FAN = 256
#: Tasks that ranges are spread over at most; each takes its ranges one after another.
TASKS = 100_000
#: Place of entry after the last piece.
DONE = 1 << 60
WORD, SENTENCE, LINE, PARAGRAPH, NONE = 0, 1, 2, 3, -1
LEVELS = (PARAGRAPH, LINE, SENTENCE, WORD)
NAMES = ["word", "sentence", "line", "paragraph"]
_WS = np.array(sorted(c for c in range(0x3001) if chr(c).isspace()), dtype=np.uint32)


def is_space(codes: np.ndarray) -> np.ndarray:
    return _space_table()[np.minimum(codes, 0x3001)]


def _space_table(cache: list = []) -> np.ndarray:
    if not cache:
        t = np.zeros(0x3002, dtype=bool)
        t[_WS] = True
        cache.append(t)
    return cache[0]


def boundary_runs(codes: np.ndarray, before: int = 0) -> np.ndarray:
    """Runs of white space of a range as rows (start, end, line feeds, 1 if after . ! or ?). before: the character before the range."""
    ws = is_space(codes)
    edge = np.diff(np.concatenate([[0], ws.view(np.int8), [0]]))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    feeds = np.concatenate([[0], np.cumsum(codes == 10)])
    prev = np.concatenate([[before], codes[:-1]])[start] if len(start) else np.zeros(0, dtype=np.int64)
    return np.stack([start, end, feeds[end] - feeds[start], np.isin(prev, (0x2E, 0x21, 0x3F)).astype(np.int64)], axis=1).astype(np.int64).reshape(-1, 4)


def kinds(runs: np.ndarray) -> np.ndarray:
    """Kind of each run: a blank line ends a paragraph, a line feed a line, a mark and white space a sentence, white space a word."""
    return np.where(runs[:, 2] > 1, PARAGRAPH, np.where(runs[:, 2] == 1, LINE, np.where(runs[:, 3] == 1, SENTENCE, WORD)))


def next_piece(s: int, length: int, runs: np.ndarray, kind: np.ndarray, limit: int, overlap: int) -> tuple[int, int, int]:
    """(end, kind of the boundary there, start of the next piece) of the piece that starts at s; the next start is `length` after the last one.

    The piece ends at the best kind of boundary in the second half of what the limit allows, else at the last boundary
    of any kind, else at the limit. The next one starts at the earliest sentence (else word) within the overlap.
    """
    if length - s <= limit:
        return length, NONE, length
    lo, hi = np.searchsorted(runs[:, 0], [s + 1, s + limit + 1])
    if lo == hi:
        cut, at = s + limit, NONE
        after = cut
    else:
        half = np.searchsorted(runs[lo:hi, 0], s + limit // 2) + lo
        if half < hi:
            k = kind[half:hi].max()
            i = int(half + np.flatnonzero(kind[half:hi] == k)[-1])
        else:
            k, i = kind[hi - 1], int(hi - 1)
        cut, at, after = int(runs[i, 0]), int(k), int(runs[i, 1])
    if after >= length:
        return cut, at, length
    a, b = np.searchsorted(runs[:, 1], [max(s + 1, cut - overlap), cut])
    back = np.flatnonzero(kind[a:b] >= SENTENCE) if b > a else []
    start = int(runs[a + (int(back[0]) if len(back) else 0), 1]) if b > a else after
    if length - start > limit and (last := np.searchsorted(runs[:, 0], start + limit + 1)) and runs[last - 1, 0] <= cut:
        start = after  # from within the overlap the next piece could not get beyond this one's end
    return cut, at, start


def pieces(codes: np.ndarray, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the pieces of a whole text longer than the limit; its outer blanks are in no piece."""
    runs = boundary_runs(codes)
    kind = kinds(runs)
    s, length = 0, len(codes)
    if len(runs) and runs[-1, 1] == length:
        length = int(runs[-1, 0])
    if len(runs) and runs[0, 0] == 0:
        s = int(runs[0, 1])
    out = []
    while s < length:
        end, k, nxt = next_piece(s, length, runs, kind, limit, overlap)
        out.append((s, end, k))
        s = nxt
    return out


def _codes(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


# Files and their ranges -----------------------------------------------------------------------------------------------


def _fs(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path:
        return pafs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
    return pafs.LocalFileSystem(), path.removeprefix("file:")


def laid_out(df: DataFrame, key: str, text: str, limit: int = LIMIT) -> DataFrame:
    """The texts of more than `limit` characters, one after another in a file for each task, as an index (key, path, lo, hi) of bytes.

    Files of tasks that ran twice are in no index. Rows with a null key or text are left out; a key delivered twice is in it twice.
    """
    folder = new_path(df.sparkSession, "texts")

    def write(batches):
        fs, p = _fs(folder)
        fs.create_dir(p, recursive=True)
        task = TaskContext.get()
        name = f"{task.partitionId()}-{task.taskAttemptId()}.txt"
        out, at = None, 0
        try:
            for b in batches:
                if not b.num_rows:
                    continue
                out = out or fs.open_output_stream(f"{p}/{name}")
                end = []
                for x in b.column("text"):
                    buffer = x.as_buffer()
                    out.write(buffer)
                    end.append((end[-1] if end else at) + len(buffer))
                start = [at, *end[:-1]]
                at = end[-1]
                yield pa.RecordBatch.from_arrays([b.column("key"), pa.array([f"{folder}/{name}"] * len(end)), pa.array(start, pa.int64()), pa.array(end, pa.int64())], names=["key", "path", "lo", "hi"])
        finally:
            if out:
                out.close()

    t, k = F.col(f"`{text}`"), F.col(f"`{key}`")
    long = df.where((F.length(t) > limit) & k.isNotNull()).select(k.cast("string").alias("key"), t.alias("text"))
    return written(long.mapInArrow(write, "key string, path string, lo bigint, hi bigint"), "index")


def files_index(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Whole files as an index (key, path, lo, hi); the key is the path."""

    def sizes(batches):
        for b in batches:
            n = []
            for p in b.column(0).to_pylist():
                fs, at = _fs(p)
                n.append(fs.get_file_info(at).size)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(0), pa.array([0] * len(n), pa.int64()), pa.array(n, pa.int64())], names=["key", "path", "lo", "hi"])

    listed = spark.createDataFrame([(p,) for p in sorted(set(paths))], "path string")
    return listed.mapInArrow(sizes, "key string, path string, lo bigint, hi bigint")


PART = "key string, path string, lo bigint, hi bigint, no bigint, r bigint"


def parts_of(index: DataFrame, range_bytes: int) -> DataFrame:
    """(key, path, lo, hi, no, r): one row for each range r of a file that holds a part of a text; no numbers the parts of a text."""
    r = F.explode(F.sequence(F.floor(F.col("lo") / range_bytes), F.floor((F.col("hi") - 1) / range_bytes)))
    return index.where("hi > lo").select("key", "path", "lo", "hi", r.alias("r")).select("key", "path", "lo", "hi", (F.col("r") - F.floor(F.col("lo") / range_bytes)).alias("no"), "r")


def by_range(parts: DataFrame, n_ranges: int) -> DataFrame:
    """The parts of one range in one task, one after another, so that a range is read once; ranges are spread over tasks by number, not by bytes of rows."""
    return parts.repartition(max(1, min(TASKS, n_ranges)), "path", "r").sortWithinPartitions("path", "r", "lo")


class Ranges:
    """Reads ranges with their halos; the last one read is kept."""

    def __init__(self, range_bytes: int, limit: int, overlap: int):
        self.size, self.limit, self.halo = range_bytes, limit, 8 * (limit + overlap)
        self.held: tuple[str, int] | None = None

    def _bytes(self, path: str, r: int, a: int, b: int) -> np.ndarray:
        lo, hi = max(0, r * self.size - self.halo), (r + 1) * self.size + self.halo
        if self.held != (path, r):
            self.raw, self.held = self._read(path, lo, hi), (path, r)
        return self.raw[a - lo : b - lo] if a >= lo and b <= hi else self._read(path, a, b)

    @staticmethod
    def _read(path: str, lo: int, hi: int) -> np.ndarray:
        fs, p = _fs(path)
        with fs.open_input_file(p) as f:
            f.seek(lo)
            return np.frombuffer(f.read(hi - lo), dtype=np.uint8)

    def view(self, row: dict) -> tuple[np.ndarray, int, int, bool]:
        """(code points of a part and its halo, first own one, first one after the own ones, whether the text ends here).

        A code point belongs to the range its first byte is in. A run of white space that meets the own part's edge is always
        seen whole: the halo grows until it is.
        """
        lo, hi, r = row["lo"], row["hi"], row["r"]
        a, b = max(lo, r * self.size), min(hi, (r + 1) * self.size)
        left = right = self.halo
        while True:
            x, y = max(lo, a - left), min(hi, b + right)
            raw = self._bytes(row["path"], r, x, y)
            heads = (raw & 0xC0) != 0x80
            first = int(np.argmax(heads)) if x > lo else 0
            last = len(raw) if y == hi else int(np.flatnonzero(heads)[-1])
            codes = _codes(raw[first:last].tobytes().decode("utf-8", "replace"))
            count = np.concatenate([[0], np.cumsum(heads[first:last])])
            own, after = (int(count[min(max(v - x - first, 0), last - first)]) for v in (a, b))
            ink = np.flatnonzero(~is_space(codes))
            if x > lo and (not len(ink) or ink[0] >= own):
                left *= 4  # nothing but blanks before the own part
            elif y < hi and (not len(ink) or ink[-1] < min(after + self.limit, len(codes) - 1)):
                right *= 4
            else:
                return codes, own, after, y == hi


# The boundaries that suffice --------------------------------------------------------------------------------------------


def boundary_table(codes: np.ndarray, own: int, after: int, begins: bool, ends: bool) -> tuple[int, int | None, int | None, list[int], list[int], list[int]]:
    """(characters, end of the blanks at the text's beginning, start of those at its end, and by level: start of the first boundary, end of the last,
    longest stretch between) of a part; places are counted from the part's first character, -1: none. A boundary is of the part in which it starts."""
    runs = boundary_runs(codes)
    kind = kinds(runs)
    chars = after - own
    lead = tail = None
    mine = (runs[:, 0] >= own) & (runs[:, 0] < after)
    if begins:
        lead = int(runs[0, 1]) if len(runs) and runs[0, 0] == 0 else 0
        mine &= runs[:, 0] > 0
    if ends and len(runs) and runs[-1, 1] == len(codes):
        if own <= runs[-1, 0] < after:
            tail = int(runs[-1, 0]) - own
        mine &= runs[:, 1] < len(codes)
    elif ends and after == len(codes):
        tail = chars
    first, last, inner = [], [], []
    for level in LEVELS:
        r = runs[mine & (kind >= level)]
        first.append(int(r[0, 0]) - own if len(r) else -1)
        last.append(int(r[-1, 1]) - own if len(r) else -1)
        inner.append(int((r[1:, 0] - r[:-1, 1]).max()) if len(r) > 1 else 0)
    return chars, lead, tail, first, last, inner


def sufficient(tables: list[tuple], limit: int = LIMIT) -> str:
    """The first kind of boundary at which (with the earlier kinds) no stretch of a text is longer than the limit, or 'none'; tables: those
    of its parts, in order."""
    base = np.cumsum([0] + [t[0] for t in tables])
    lead = next(t[1] for t in tables if t[1] is not None)
    tail = next((int(b) + t[2] for b, t in zip(base, tables) if t[2] is not None))
    for i, level in enumerate(LEVELS):
        end, longest = lead, 0
        for b, t in zip(base, tables):
            if t[3][i] >= 0:
                longest = max(longest, b + t[3][i] - end, t[5][i])
                end = b + t[4][i]
        if max(longest, tail - end) <= limit:
            return NAMES[level]
    return "none"


def boundary_kinds(df: DataFrame, key: str, text: str, limit: int = LIMIT, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(key, boundary) of every text longer than the limit: the first kind of boundary that suffices for cutting it.

    Null and shorter texts are left out, rows repeated under a key count once, texts of any length are cut into ranges."""
    index = laid_out(df, key, text, limit)
    parts = parts_of(index, range_bytes)
    n = parts.select("path", "r").distinct().count()

    def tabulate(batches):
        ranges = Ranges(range_bytes, limit, 0)
        for b in batches:
            got = []
            for row in b.to_pylist():
                codes, own, after, ends = ranges.view(row)
                t = boundary_table(codes, own, after, row["no"] == 0, ends)
                whole = row["no"] == 0 and own == 0 and after == len(codes) and ends
                got.append((row["key"], row["path"], row["lo"], row["no"], sufficient([t], limit) if whole else None, *t))
            cols = list(zip(*got)) if got else [[]] * 11
            yield pa.RecordBatch.from_arrays([pa.array(list(c), ty) for c, ty in zip(cols, _TABLE.values())], names=list(_TABLE))

    spec = "key string, path string, lo bigint, no bigint, boundary string, chars bigint, lead bigint, tail bigint, first array<bigint>, last array<bigint>, inner array<bigint>"
    tables = written(by_range(parts, n).mapInArrow(tabulate, spec), "boundaries")

    def stitch(t: pa.Table) -> pa.Table:
        rows = sorted(t.to_pylist(), key=lambda r: r["no"])
        return pa.table({"key": pa.array([rows[0]["key"]]), "boundary": pa.array([sufficient([tuple(r[c] for c in ("chars", "lead", "tail", "first", "last", "inner")) for r in rows], limit)])})

    cut = tables.where("boundary IS NULL").groupBy("path", "lo").applyInArrow(stitch, "key string, boundary string")  # a few numbers for each part
    return first_of_key(tables.where("boundary IS NOT NULL").select("key", "boundary").unionAll(cut), "key")


_LIST = pa.list_(pa.int64())
_TABLE = {"key": pa.string(), "path": pa.string(), "lo": pa.int64(), "no": pa.int64(), "boundary": pa.string(), "chars": pa.int64(), "lead": pa.int64(), "tail": pa.int64(), "first": _LIST, "last": _LIST, "inner": _LIST}


# Pieces ---------------------------------------------------------------------------------------------------------------------


class Walk:
    """Pieces of a part, from places of entry on."""

    def __init__(self, codes: np.ndarray, ends: bool, limit: int, overlap: int):
        self.runs = boundary_runs(codes)
        self.kind, self.length, self.limit, self.overlap = kinds(self.runs), len(codes), limit, overlap
        if ends and len(self.runs) and self.runs[-1, 1] == self.length:
            self.length = int(self.runs[-1, 0])
        self.memo: dict[int, tuple[int, int, int]] = {}

    def step(self, s: int) -> tuple[int, int, int]:
        if s not in self.memo:
            self.memo[s] = next_piece(s, self.length, self.runs, self.kind, self.limit, self.overlap)
        return self.memo[s]

    def first(self) -> int:
        """Where the first piece of a text begins."""
        return int(self.runs[0, 1]) if len(self.runs) and self.runs[0, 0] == 0 else 0

    def entries(self, own: int) -> list[int]:
        """The places at which a piece may begin that comes from the part before: ends of white space, and any place behind a whole limit without."""
        runs = self.runs[(self.runs[:, 0] <= own + self.limit) & (self.runs[:, 1] >= own)]
        place = np.arange(own, min(own + self.limit, self.length) + 1)
        before = np.searchsorted(self.runs[:, 0], place, side="right") - 1
        since = np.where(before >= 0, self.runs[np.maximum(before, 0), 1], 0) if len(self.runs) else np.zeros(len(place), dtype=np.int64)
        return np.union1d(runs[:, 1], place[place - since >= self.limit]).tolist()


def split_index(index: DataFrame, limit: int, overlap: int, range_bytes: int) -> DataFrame:
    """(key, path, lo, piece_no, start, end, boundary, piece) of the texts of an index."""
    range_bytes = max(range_bytes, 32 * (limit + overlap))
    parts = parts_of(index, range_bytes)
    n = parts.select("path", "r").distinct().count()
    cut = parts.where(F.floor(F.col("lo") / range_bytes) < F.floor((F.col("hi") - 1) / range_bytes))
    whole = parts.where(F.floor(F.col("lo") / range_bytes) == F.floor((F.col("hi") - 1) / range_bytes))

    def tabulate(batches):
        ranges = Ranges(range_bytes, limit, overlap)
        for b in batches:
            for row in b.to_pylist():
                codes, own, after, ends = ranges.view(row)
                w = Walk(codes, ends, limit, overlap)
                exit_of: dict[int, tuple[int, int]] = {}

                def follow(s):
                    chain = []
                    while s < min(after, w.length) and s not in exit_of:
                        chain.append(s)
                        s = w.step(s)[2]
                    out, n = exit_of.get(s) or (DONE if ends and s >= w.length else s - after, 0)
                    for i, c in enumerate(reversed(chain), 1):
                        exit_of[c] = (out, n + i)
                    return out, n + len(chain)

                entries = w.entries(own) if row["no"] else [w.first()]
                got = [(e - own, *follow(e)) for e in entries]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["path"]]), pa.array([row["lo"]]), pa.array([row["no"]]), pa.array([after - own]), *(pa.array([list(c)], _LIST) for c in zip(*got))],
                    names=["path", "lo", "no", "chars", "entry", "exit", "pieces"],
                )

    table = "path string, lo bigint, no bigint, chars bigint, entry array<bigint>, exit array<bigint>, pieces array<bigint>"
    entered = entries_of(cut_lineage(by_range(cut, n).mapInArrow(tabulate, table)), table)
    todo = cut.join(entered, ["path", "lo", "no"]).select("key", "path", "lo", "hi", "no", "r", "enter", "base", "before")
    todo = todo.unionAll(whole.select("*", F.lit(-1).cast("bigint").alias("enter"), F.lit(0).cast("bigint").alias("base"), F.lit(0).cast("bigint").alias("before")))

    def emit(batches):
        ranges = Ranges(range_bytes, limit, overlap)
        for b in batches:
            for row in b.to_pylist():
                codes, own, after, ends = ranges.view(row)
                w = Walk(codes, ends, limit, overlap)
                s, got = own + row["enter"] if row["enter"] >= 0 else w.first(), []
                while s < min(after, w.length):
                    end, k, nxt = w.step(s)
                    got.append((s, end, k))
                    s = nxt
                m, move, text = len(got), row["base"] - own, codes.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["key"]] * m, pa.string()), pa.array([row["path"]] * m, pa.string()), pa.array([row["lo"]] * m, pa.int64()), pa.array(np.arange(m) + row["before"]), pa.array([x + move for x, _, _ in got], pa.int64()), pa.array([y + move for _, y, _ in got], pa.int64()),
                     pa.array([NAMES[k] if k >= 0 else "none" for _, _, k in got], pa.string()), pa.array([text[4 * x : 4 * y].decode("utf-32-le", "replace") for x, y, _ in got], pa.string())],
                    names=["key", "path", "lo", "piece_no", "start", "end", "boundary", "piece"],
                )

    return by_range(todo, n).mapInArrow(emit, "key string, path string, lo bigint, piece_no bigint, start bigint, end bigint, boundary string, piece string")


def through(rows: list[dict], place: int) -> tuple[int, int]:
    """(exit, pieces) of neighbouring parts entered at a place of the first."""
    n = 0
    for r in rows:
        if place < r["chars"]:
            place, more = r["known"][place]
            n += more
        else:  # the piece before passes over this part
            place -= r["chars"]
    return place, n


def _known(table: pa.Table) -> list[dict]:
    rows = sorted(table.to_pylist(), key=lambda r: r["no"])
    for r in rows:
        r["known"] = dict(zip(r["entry"], zip(r["exit"], r["pieces"])))
    return rows


def entries_of(tables: DataFrame, spec: str, fan: int = FAN) -> DataFrame:
    """(path, lo, no, enter, base, before) of every part: its place of entry, and the characters and pieces of the parts before it.

    Tables of `fan` neighbours are composed, round by round, until a text has one; then the entries go down the same tree.
    """

    def compose(t: pa.Table) -> pa.Table:
        rows = _known(t)
        got = [(e, *through(rows, e)) for e in rows[0]["entry"]]
        one = {"path": rows[0]["path"], "lo": rows[0]["lo"], "no": rows[0]["no"] // fan, "chars": sum(r["chars"] for r in rows)}
        return pa.Table.from_pylist([one | dict(zip(("entry", "exit", "pieces"), map(list, zip(*got))))], schema=pa.schema([("path", pa.string()), *((c, pa.int64()) for c in ("lo", "no", "chars")), *((c, _LIST) for c in ("entry", "exit", "pieces"))]))

    def descend(t: pa.Table) -> pa.Table:
        rows, out = _known(t), []
        place, base, before = rows[0]["up_enter"], rows[0]["up_base"], rows[0]["up_before"]
        for r in rows:
            place = r["entry"][0] if place < 0 else place
            out.append({"path": r["path"], "lo": r["lo"], "no": r["no"], "enter": place, "base": base, "before": before})
            place, more = through([r], place)
            base, before = base + r["chars"], before + more
        return pa.Table.from_pylist(out, schema=pa.schema([("path", pa.string()), *((c, pa.int64()) for c in ("lo", "no", "enter", "base", "before"))]))

    levels = [tables]
    most = tables.agg(F.max("no").alias("m")).first().m or 0
    while most >= fan:
        levels.append(cut_lineage(levels[-1].withColumn("up", F.floor(F.col("no") / fan)).groupBy("path", "lo", "up").applyInArrow(compose, spec)))
        most //= fan
    up = levels[-1].select("path", "lo").distinct().select("path", "lo", F.lit(0).cast("bigint").alias("up"), *[F.lit(v).cast("bigint").alias(c) for c, v in (("up_enter", -1), ("up_base", 0), ("up_before", 0))])
    entered = None
    for level in reversed(levels):
        if entered is not None:
            up = entered.select("path", "lo", F.col("no").alias("up"), F.col("enter").alias("up_enter"), F.col("base").alias("up_base"), F.col("before").alias("up_before"))
        held = level.withColumn("up", F.floor(F.col("no") / fan)).join(up, ["path", "lo", "up"])
        entered = held.groupBy("path", "lo", "up").applyInArrow(descend, "path string, lo bigint, no bigint, enter bigint, base bigint, before bigint")
    return entered


def split_texts(df: DataFrame, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(key, piece_no, start, end, boundary, piece): the pieces of every text longer than the limit.

    start and end are code points of the stored text; consecutive pieces overlap by at most `overlap` characters or
    leave out white space only. boundary is the kind at which the piece ends: none for the last piece and for a cut
    inside a word. Null and shorter texts are left out; blank texts give no pieces; repeated keys count once.
    """
    index = first_of_key(laid_out(df, key, text, limit), "key")
    return split_index(cut_lineage(index), limit, overlap, range_bytes).drop("path", "lo").withColumn("piece_no", F.col("piece_no").cast("int"))


def split_files(spark: SparkSession, paths: list[str], limit: int = LIMIT, overlap: int = OVERLAP, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, piece_no, start, end, boundary, piece) of UTF-8 files of any size, as split_texts gives them for the files' texts.

    A file of up to `limit` characters is one piece, an empty or blank one gives none.
    """
    return split_index(cut_lineage(files_index(spark, paths)), limit, overlap, range_bytes).drop("key", "lo")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    cc = spark.read.parquet(f"{sf_dir}/corpus_chunks.parquet")
    return boundary_kinds(cc, "chunk_id", "text").withColumnRenamed("key", "chunk_id")


def p2_found_sql() -> str:
    blank = r"\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
    marked = f"regexp_replace(t, '([.!?])([{blank}])', '\\1' || chr(1) || '\\2', 'g')"
    longest = lambda text, cut: f"list_max(list_transform(string_split_regex({text}, '{cut}'), lambda s: length(regexp_replace(s, '^[{blank}]+|[{blank}]+$', '', 'g'))))"
    return f"""
        WITH x AS (SELECT DISTINCT chunk_id, text AS t FROM corpus_chunks WHERE length(text) > {LIMIT})
        SELECT chunk_id, CASE WHEN {longest("t", f"[{blank}]*" + chr(92) + "n[" + blank + "]*" + chr(92) + "n[" + blank + "]*")} <= {LIMIT} THEN 'paragraph'
            WHEN {longest("t", chr(92) + "n")} <= {LIMIT} THEN 'line'
            WHEN {longest(marked, "[" + chr(92) + "n" + chr(92) + "x{1}]")} <= {LIMIT} THEN 'sentence'
            WHEN {longest("t", "[" + blank + "]+")} <= {LIMIT} THEN 'word' ELSE 'none' END AS boundary
        FROM x"""


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    cc = spark.read.parquet(f"{sf_dir}/corpus_chunks.parquet")
    return split_texts(cc, "chunk_id", "text").withColumnRenamed("key", "chunk_id")
