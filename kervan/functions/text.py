"""Text functions as column expressions: they stay inside generated code and take no Python."""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters whose decomposed form is composed.
LETTERS = "çğöşüâîûÇĞÖŞÜİÂÎÛéèêëäñáàíóòôúÉÄÑӧёїў"
COMPOSED = [(unicodedata.normalize("NFD", c), c) for c in unicodedata.normalize("NFC", LETTERS)]


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nfc(c) -> Column:
    """Composed form of the letters in COMPOSED; rows without a combining mark are only scanned for one."""
    c = out = _c(c)
    for a, b in COMPOSED:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.when(c.rlike(r"[\u0300-\u036F]"), out).otherwise(c)


def turkish_lower(c) -> Column:
    """Lower case the Turkish way (I with ı, İ with i), composed."""
    return nfc(F.lower(F.replace(F.replace(_c(c), F.lit("İ"), F.lit("i")), F.lit("I"), F.lit("ı"))))


def split_words(c) -> Column:
    """Words between white space; empty text has none."""
    return F.regexp_extract_all(_c(c), F.lit(r"\S+"), F.lit(0))


def index_tokens(c, stopwords: tuple[str, ...] = (), min_length: int = 2) -> Column:
    """Tokens for the lexical index: folded runs of letters, digits and underscores of at least min_length, without stopwords."""
    words = F.regexp_extract_all(turkish_lower(c), F.lit(rf"[\p{{L}}\p{{N}}_]{{{min_length},}}"), F.lit(0))
    return F.filter(words, lambda x: ~x.isin(*stopwords)) if stopwords else words


class Tokenizer:
    """index_tokens for whole batches in Python, with a stemmer of words (a function str -> str), if given. Where tokens are counted row by row this
    is faster than an expression that hands them over as arrays."""

    def __init__(self, stopwords: tuple[str, ...] = (), min_length: int = 2, stem: Callable[[str], str] | None = None):
        self.stopwords, self.stem = frozenset(stopwords), functools.lru_cache(maxsize=200_000)(stem) if stem else None
        self.pattern = re.compile(rf"\w{{{min_length},}}")

    def __reduce__(self):
        return _tokenizer, (tuple(self.stopwords), self.pattern.pattern, self.stem.__wrapped__ if self.stem else None)

    def __call__(self, text: str | None) -> list[str]:
        low = (text or "").replace("İ", "i").replace("I", "ı").lower()
        if not low.isascii() and not unicodedata.is_normalized("NFC", low):
            low = unicodedata.normalize("NFC", low)
        words = self.pattern.findall(low)
        if self.stopwords:
            words = [w for w in words if w not in self.stopwords]
        return [self.stem(w) for w in words] if self.stem else words


def _tokenizer(stopwords, pattern, stem):
    t = Tokenizer(stopwords, 2, stem)
    t.pattern = re.compile(pattern)
    return t


def first_letters(word: str, n: int = 5) -> str:
    """A stemmer that keeps the first letters of a word."""
    return word[:n]


def qa_tokens(c) -> Column:
    """Tokens for answer metrics: folded, cut at white space, punctuation kept."""
    return split_words(turkish_lower(c))


def merge_key(c) -> Column:
    """Key under which questions count as one: lower case, single blanks."""
    return F.trim(F.regexp_replace(F.lower(nfc(c)), r"\s+", " "))


CITATION = r"(?iu)\[\s*kaynak\s+(\d+)\s*\]"


def strip_citations(c) -> Column:
    return F.trim(F.regexp_replace(_c(c), CITATION, ""))


def citation_numbers(c) -> Column:
    """Cited numbers in the order of their first occurrence."""
    return F.array_distinct(F.transform(F.regexp_extract_all(_c(c), F.lit(CITATION), 1), lambda x: x.cast("int")))


def ngrams(tokens, n: int) -> Column:
    t = _c(tokens)
    # sequence() counts down when its end is smaller than its start
    return F.when(F.size(t) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.size(t) - (n - 1), F.lit(1))), lambda i: F.array_join(F.slice(t, i, n), " "))).otherwise(F.array().cast("array<string>"))


def multiset_overlap(a, b) -> Column:
    """Size of the multiset intersection of two arrays."""
    a, b = _c(a), _c(b)
    count = lambda arr, x: F.size(F.filter(arr, lambda y: y == x))
    return F.aggregate(F.array_intersect(a, b), F.lit(0), lambda acc, x: acc + F.least(count(a, x), count(b, x)))


def lcs_of(a, b) -> int:
    """Length of the longest common subsequence of two sequences, a row of the table at a time as the bits of one number."""
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = open_ = (1 << len(a)) - 1
    for x in b:
        hit = open_ & places.get(x, 0)
        open_ = ((open_ + hit) | (open_ - hit)) & full
    return len(a) - open_.bit_count()


def lcs_length(a, b) -> Column:
    """Length of the longest common subsequence of two arrays."""

    @F.pandas_udf("int")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([lcs_of(p, q) for p, q in zip(x, y)], dtype="int32")

    return run(_c(a), _c(b))


def jaccard(a, b) -> Column:
    a, b = F.array_distinct(_c(a)), F.array_distinct(_c(b))
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / F.size(F.array_union(a, b)))


def overlap_coefficient(a, b) -> Column:
    a, b = F.array_distinct(_c(a)), F.array_distinct(_c(b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.least(F.size(a), F.size(b)))


def dot(a, b) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(_c(a).cast("array<double>"), _c(b).cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def falsy(*cs) -> Column:
    """The first of the columns that is neither null nor empty."""
    return F.coalesce(*[F.nullif(_c(c).cast("string"), F.lit("")) for c in cs])


def document_of(chunk_id) -> Column:
    """The document part of a chunk id: without a trailing number."""
    return F.regexp_replace(_c(chunk_id), r"_\d+$", "")


def bar(share, width: int = 24) -> Column:
    n = F.greatest(F.lit(0), F.least(F.lit(width), F.bround(_c(share) * width).cast("int")))
    return F.concat(F.repeat(F.lit("#"), n), F.repeat(F.lit("."), F.lit(width) - n))


def percent(x) -> Column:
    return F.when(_c(x).isNull(), "N/A").otherwise(F.format_string("%.2f%%", F.bround(_c(x) * 100, 2)))


# What an answer that goes on talking begins its next turn with.
MARKERS = ("Soru:", "Bağlam:", "Question:", "\nQ:")


def truncate_answer(c, markers: tuple[str, ...] = MARKERS, least: int = 10) -> Column:
    """The answer up to the earliest marker; only a marker's first occurrence counts, and only from place `least` on."""
    c = _c(c)
    at = [F.when((p := F.locate(m, c)) > least, p) for m in markers]
    cut = F.least(*at)
    return F.trim(F.when(cut.isNull(), c).otherwise(F.substring(c, F.lit(1), cut - 1)))


def judge_score(c) -> Column:
    """A judge's reply as a number in [0, 1]; one half where it has none.

    A reply that is nothing but a number from 0 to 1 counts first, then numbers out of 10, out of 5, decimals of 0 or 1, and a lone 0 or 1;
    of one kind the first in the text.
    """
    c = F.trim(_c(c))
    found = F.regexp_extract_all(c, F.lit(r"\d+(?:\.\d+)?(?:\s*/\s*\d+)?"), F.lit(0))

    def read(x: Column, place: Column) -> Column:
        value, base = F.regexp_extract(x, r"^[\d.]+", 0), F.regexp_extract(x, r"/\s*(\d+)$", 1)
        kind = F.when((base == "") & (x == c) & x.rlike(r"^[01]"), 0).when(base == "10", 1).when(base == "5", 2).when((base == "") & x.rlike(r"^[01]\."), 3).when((base == "") & x.rlike(r"^[01]$"), 4)
        out_of = F.when(base.isin("10", "5"), base.cast("double")).otherwise(1.0)
        return F.when(kind.isNotNull(), F.struct(kind.alias("kind"), place.alias("place"), (value.try_cast("double") / out_of).alias("value")))

    best = F.array_min(F.filter(F.transform(found, read), lambda x: x.isNotNull()))
    return F.least(F.lit(1.0), F.coalesce(best["value"], F.lit(0.5)))
