"""Words and word sequences of whole Arrow batches as flat numpy arrays.

A batch's texts are laid end to end as code points; words, their hashes and the hashes of word sequences come
from a few vector operations over all of them, without a Python loop over texts, words or characters.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from kervan.llm.common_form import form_array, plain_table

TOP = 0x30000
#: Bytes of text in one flat array, small enough for a processor's cache; longer batches are cut between texts.
FLAT = 600_000
TOKEN = np.uint64((1 << 40) - 1)
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


@functools.cache
def tables() -> tuple[np.ndarray, np.ndarray]:
    """(is letter or digit, letter case folded the Turkish way) by code point."""
    word = np.zeros(TOP + 1, dtype=bool)
    fold = np.arange(TOP + 1, dtype=np.uint32)
    for c in range(TOP):
        ch = chr(c)
        if unicodedata.category(ch)[0] in "LN":
            word[c] = True
            low = {"I": "ı", "İ": "i"}.get(ch) or ch.lower()
            if len(low) == 1:
                fold[c] = ord(low)
    return word, fold


@functools.cache
def bare_letters() -> np.ndarray:
    """The fold of tables() that also takes the accents off the Turkish letters."""
    fold = tables()[1].copy()
    for a, b in zip("ışğçöüâîû", "isgcouaiu"):
        fold[fold == ord(a)] = ord(b)
    return fold


@functools.cache
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """(BASE ** i, BASE ** -i) modulo 2 ** 64."""
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    up, down = np.full(n, BASE, dtype=np.uint64), np.full(n, inverse, dtype=np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """The words of texts: word w of text d has hash[w], starts at start[w] and ends before end[w] within the flat code points;
    those of text d are first[d] to first[d + 1]."""

    def __init__(self, texts: pa.Array, formed: bool = False, bare: bool = False):
        texts = texts.fill_null("")
        self.texts = texts if formed else to_form(texts)
        self.n = len(self.texts)
        self.codes, self.offset = flat_codes(self.texts)
        word, fold = tables()
        codes = np.minimum(self.codes, TOP)
        inside = word[codes]
        edge = np.zeros(len(codes) + 1, dtype=np.int8)
        edge[:-1] = inside
        first_char = edge[:-1].astype(bool).copy()
        if len(codes):
            first_char[1:] &= ~inside[:-1]
            at = self.offset[:-1][self.offset[:-1] < len(codes)]  # a text's first character never continues a word
            first_char[at] |= inside[at]
            last_char = inside.copy()
            last_char[:-1] &= ~inside[1:] | first_char[1:]
        else:
            last_char = first_char
        self.start = np.flatnonzero(first_char)
        self.end = np.flatnonzero(last_char) + 1
        self.folded = (bare_letters() if bare else fold)[codes]
        up, down = powers(1 << max(10, int(np.ceil(np.log2(len(codes) + 2)))))
        total = np.zeros(len(codes) + 1, dtype=np.uint64)
        np.cumsum((self.folded.astype(np.uint64) + np.uint64(1)) * up[: len(codes)], out=total[1:])
        self.hash = mix((total[self.end] - total[self.start]) * down[self.start] + (self.end - self.start).astype(np.uint64))
        self._total, self._down = total, down
        self.first = np.searchsorted(self.start, self.offset).astype(np.int64)
        self.doc = np.repeat(np.arange(self.n, dtype=np.int64), np.diff(self.first))

    def stems(self, letters: int) -> np.ndarray:
        """Hash of the first so many letters of every word."""
        end = np.minimum(self.end, self.start + letters)
        return mix((self._total[end] - self._total[self.start]) * self._down[self.start] + (end - self.start).astype(np.uint64))

    def sequences(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, number of the first word, hash) of every sequence of k consecutive words."""
        m = len(self.hash) - k + 1
        if m <= 0:
            z = np.zeros(0, dtype=np.int64)
            return z, z, z.astype(np.uint64)
        at = np.flatnonzero(self.doc[:m] == self.doc[k - 1 :])
        h = np.zeros(len(at), dtype=np.uint64)
        for i in range(k):
            h = mix(h * BASE + self.hash[at + i])
        return self.doc[at], at, h

    def sets(self, k: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, first): the different sequences of k words of text d as 40-bit tokens[first[d]:first[d + 1]], in rising order.

        At most 2 ** 24 texts. Other salts give tokens of another kind, which never meet these by more than chance.
        """
        doc, _, h = self.sequences(k)
        if salt:
            h = mix(h ^ np.uint64(salt))
        packed = np.sort((doc.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24)))
        keep = np.ones(len(packed), dtype=bool)
        keep[1:] = packed[1:] != packed[:-1]
        packed = packed[keep]
        return packed & TOKEN, np.searchsorted(packed >> np.uint64(40), np.arange(self.n + 1, dtype=np.uint64))


def flat_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all texts, where each begins, with the end as a last entry)."""
    offset = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False), out=offset[1:])
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), texts.cast(pa.string())), "")[0].as_py() if len(texts) else ""
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32), offset


def to_form(texts: pa.Array) -> pa.Array:
    """Common form, null as empty text; only texts with a character that does not stand for itself go through SQL."""
    texts = texts.fill_null("")
    codes, offset = flat_codes(texts)
    plain = plain_table()
    odd = ~plain[np.minimum(codes, len(plain) - 1)]
    before = np.zeros(len(odd) + 1, dtype=np.int64)
    np.cumsum(odd, out=before[1:])
    which = np.flatnonzero(before[offset[1:]] > before[offset[:-1]])
    if not len(which):
        return texts
    mask = np.zeros(len(texts), dtype=bool)
    mask[which] = True
    return pc.replace_with_mask(texts.cast(pa.string()), pa.array(mask), form_array(texts.take(pa.array(which))))


def each(texts: pa.Array, bare: bool = False):
    """(number of the first text, Words) for runs of texts of about FLAT bytes; a longer text goes alone."""
    texts = to_form(texts)
    size = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.concatenate([[0], np.cumsum(size)])
    lo = 0
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + FLAT, side="right")) - 1)
        yield lo, Words(texts.slice(lo, hi - lo), formed=True, bare=bare)
        lo = hi
