"""Substring dedup by relative Lempel-Ziv parsing, over words.

Windows of WIDTH consecutive words that may repeat are found and dealt to
blocks (see repeats). Each block indexes its units as the reference: suffix
order by prefix doubling, common prefixes of neighbours, and for each length
the least document of every run of suffixes that share that many words. Units
are then factored greedily, left to right: a factor is the longest stretch
that also starts in a smaller document, or one word. Factors of at least WIDTH
words are duplicate spans; the windows that cross a factor's boundary are
looked up one by one, so none that two factors share is missed.

Edge cases: null and empty texts have no words; rows without id are left out
and of rows that share an id the least text stays; texts shorter than a window
are kept whole; equal texts under different ids keep the smallest id's copy.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from pointloom.llm.common import word_hashes
from pointloom.llm.repeats import Windows, one_text, repeated_spans, with_spans

WIDTH = 13


def rank_levels(symbols: np.ndarray, most: int) -> list[np.ndarray]:
    """Ranks of all places by their next 1, 2, 4, ... symbols, up to at least most; a zero past the end."""
    levels = [np.unique(symbols, return_inverse=True)[1].astype(np.int64) + 1]
    span = 1
    while span < most:
        r = levels[-1]
        nxt = np.zeros_like(r)
        nxt[:-span] = r[span:]
        levels.append(np.unique(r * (r.max() + 2) + nxt, return_inverse=True)[1].astype(np.int64) + 1)
        span *= 2
    return levels


def common_prefix(levels: list[np.ndarray], order: np.ndarray, most: int) -> np.ndarray:
    """Common prefix, in symbols and up to most, of each suffix in order with the one before; 0 for the first."""
    a, b = order[1:].copy(), order[:-1].copy()
    out = np.zeros(len(a), np.int64)
    n = len(levels[0])
    for j in range(len(levels) - 1, -1, -1):
        for _ in range(2 if j == len(levels) - 1 else 1):
            inside = (a < n) & (b < n)
            same = inside & (levels[j][np.minimum(a, n - 1)] == levels[j][np.minimum(b, n - 1)])
            out += same << j
            a += same << j
            b += same << j
    return np.append(0, np.minimum(out, most))


class Reference:
    """An indexed block: for every place, the longest stretch of at least WIDTH words that also starts in a smaller document."""

    def __init__(self, units: list[np.ndarray], docs: np.ndarray):
        size = np.array([len(u) for u in units])
        self.begin = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
        words = np.unique(np.concatenate(units), return_inverse=True)[1].astype(np.int64)
        owner = np.repeat(np.arange(len(units)), size + 1)
        last = self.begin + size
        text = np.zeros(len(owner), np.int64)
        inside = np.ones(len(owner), bool)
        inside[last] = False
        text[inside] = words
        text[last] = words.max() + 1 + np.arange(len(units))  # ends are all different
        longest = int(size.max())
        levels = rank_levels(text, longest + 1)
        order = np.argsort(levels[-1], kind="stable")
        lcp = common_prefix(levels, order, longest)
        own = docs[owner]
        self.longest = np.zeros(len(text), np.int64)
        for length in range(WIDTH, longest + 1):
            starts = np.flatnonzero(lcp < length)
            least = np.minimum.reduceat(own[order], starts)
            run = np.cumsum(lcp < length) - 1
            ok = least[run] < own[order]
            self.longest[order[ok]] = length

    def factor(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy factors (unit, first word in it, length) of all units in step; gives marked (unit, window) pairs."""
        at = np.zeros(len(counts), np.int64)
        units, firsts = [], []
        live = np.arange(len(counts))
        while len(live):
            length = self.longest[self.begin[live] + at[live]]
            hit = length >= WIDTH
            inner = np.where(hit, length - WIDTH + 1, 0)  # windows inside the factor
            units.append(np.repeat(live, inner))
            firsts.append(np.repeat(at[live], inner) + _ramp(inner))
            # windows that start in the factor and cross its end
            edge_from = at[live] + inner
            edge_to = np.minimum(at[live] + np.maximum(length, 1), counts[live])
            k = np.where(hit, np.maximum(edge_to - edge_from, 0), 0)
            unit, window = np.repeat(live, k), np.repeat(edge_from, k) + _ramp(k)
            long = self.longest[self.begin[unit] + window] >= WIDTH
            units.append(unit[long])
            firsts.append(window[long])
            at[live] += np.where(hit, length, 1)
            live = live[at[live] < counts[live]]
        return np.concatenate(units), np.concatenate(firsts)


def _ramp(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... restarting for each count."""
    return np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)


def resolve(contents: list[bytes], docs: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marked word ranges (unit, first, end) of a block's units, in order of document."""
    reference = Reference([np.frombuffer(c, np.uint64) for c in contents], docs)
    unit, window = reference.factor(counts)
    return unit, window, window + WIDTH


def words(text: str) -> np.ndarray:
    return word_hashes(text.encode())[2]


WORDS = Windows(WIDTH, (6, 9, 11, WIDTH), words, lambda w: w, same_document=False)


def _digest(doc_id: int, text: str | None, spans: np.ndarray) -> tuple:
    parts = (text or "").encode().split()
    kept, at = [], 0
    for a, b in spans.tolist():
        kept += parts[at:a]
        at = b
    kept += parts[at:]
    return doc_id, len(parts), len(parts) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()


def duplicate_spans(docs: DataFrame) -> DataFrame:
    """(doc, start, end): word ranges covered by windows that also start in a smaller document; ranges may overlap."""
    return repeated_spans(one_text(docs), WORDS, resolve)


def remove_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256."""
    rows = one_text(docs)
    return with_spans(rows, repeated_spans(rows, WORDS, resolve), _digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")
