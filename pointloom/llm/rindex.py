"""Suffix-array dedup on a run-length index, over bytes.

Windows of WIDTH bytes that may repeat are found and dealt to blocks (see
repeats). Each block builds the Burrows-Wheeler transform of its units, kept
as runs, with the suffix-array samples at the run ends and, for every range of
suffixes that share WIDTH bytes, its earliest text position. Units are
streamed through the index backwards, all in step, with LF-mapping over the
runs; at each place this gives the row of the suffix, and so its thresholded
matching statistic: whether WIDTH bytes from here match an earlier place.
Such matches are marked.

Edge cases: null texts count as empty; rows without id are left out and of
rows that share an id the least text stays; texts shorter than a window are
kept whole; a repeat inside one text counts like one between texts.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from pointloom.llm.common import _BYTE_KEYS
from pointloom.llm.repeats import Windows, one_text, repeated_spans, with_spans

WIDTH = 100


class Marks:
    """A bit vector with rank: how many of the marked places lie at or before a row."""

    def __init__(self, places: np.ndarray, n: int):
        bits = np.zeros(n // 64 * 64 + 64, np.uint8)
        bits[places] = 1
        self.words = np.packbits(bits, bitorder="little").view(np.uint64)
        self.before = np.cumsum(np.bitwise_count(self.words).astype(np.int64)) - np.bitwise_count(self.words)

    def rank(self, rows: np.ndarray) -> np.ndarray:
        word, bit = rows >> 6, (rows & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] << (np.uint64(63) - bit))


class RunIndex:
    """Run-compressed BWT of a list of byte strings, each with an end of its own, in order of the list."""

    def __init__(self, units: list[bytes]):
        size = np.array([len(u) for u in units])
        n = int(size.sum()) + len(units)
        self.end = np.cumsum(size + 1) - 1
        text = np.zeros(n, np.int64)  # 0: an end
        inside = np.ones(n, bool)
        inside[self.end] = False
        text[inside] = np.frombuffer(b"".join(units), np.uint8).astype(np.int64) + 1
        order, same = self._suffixes(text, self.end, int(size.max()))
        before = text[order - 1]
        before[order == 0] = 0
        # runs of the transform, their starts, and the samples at the run ends
        start = np.flatnonzero(np.append(True, before[1:] != before[:-1]))
        self.symbol, self.start, self.runs = before[start], start, Marks(start, n)
        self.sample = order[np.append(start[1:] - 1, n - 1)]
        # LF-mapping of a run's first row: rows of smaller symbols, and of the same symbol in earlier runs
        length = np.diff(np.append(start, n))
        by = np.argsort(self.symbol, kind="stable")
        self.target = np.empty(len(start), np.int64)
        self.target[by] = np.cumsum(length[by]) - length[by]
        # ranges of suffixes that share WIDTH bytes, and the earliest place of each
        lead = np.flatnonzero(~same)
        self.ranges, self.first = Marks(lead, n), np.minimum.reduceat(order, lead)
        self.rows = np.arange(len(units))  # ends sort first, in order of the list: row i is the end of unit i

    @staticmethod
    def _suffixes(text: np.ndarray, ends: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
        """Suffix order (ends differ by place), and whether a suffix shares WIDTH symbols with the one before.

        Ranks by 7 symbols, then by `ways` times as many in each round: three ranks of fewer than 2**21 places fit one key."""
        n = len(text)
        until = np.repeat(ends, np.diff(np.append(-1, ends))) - np.arange(n)  # symbols left before the end
        pad = np.append(text, np.zeros(8, np.int64))
        key = np.zeros(n, np.int64)
        for i in range(7):
            key = (key << 9) | np.where(i < until, pad[i : n + i], 0)
        ways, bits = (3, 21) if n + 1 < 1 << 21 else (2, 31)
        span, levels, order = 7, [], None
        while True:
            last = span > longest
            order = np.argsort(key, kind="stable" if last else None)
            k = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.append(True, k[1:] != k[:-1]))  # from 1: 0 is past the end
            levels.append((span, rank))
            if last:
                break
            key = rank
            for j in range(1, ways):
                at = np.arange(j * span, n + j * span)
                key = (key << bits) | np.where(until > j * span, rank[np.minimum(at, n - 1)], 0)
            span *= ways
        a, b = order[1:], order[:-1]
        same = (until[a] >= WIDTH) & (until[b] >= WIDTH)
        if same.any():
            span, rank = max((lv for lv in levels if lv[0] <= WIDTH), key=lambda lv: lv[0])
            for at in [*range(0, WIDTH - span, span), WIDTH - span]:  # stretches of span symbols that cover WIDTH
                same &= rank[np.minimum(a + at, n - 1)] == rank[np.minimum(b + at, n - 1)]
        return order, np.append(False, same)

    def step(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols before the suffixes at rows, and the rows of the suffixes with them."""
        run = self.runs.rank(rows) - 1
        return self.symbol[run], self.target[run] + rows - self.start[run]

    def earlier(self, rows: np.ndarray) -> np.ndarray:
        """The earliest place whose WIDTH bytes equal those at the suffixes of rows; their own where there is no other."""
        return self.first[self.ranges.rank(rows) - 1]


def resolve(contents: list[bytes], docs: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marked byte ranges (unit, first, end) of a block's units, in order of document and place."""
    index = RunIndex(contents)
    size = np.array([len(c) for c in contents])
    begin = index.end - size
    live, rows = np.arange(len(contents)), index.rows.copy()
    units, firsts = [], []
    at = size.copy()
    while len(live):
        _, rows = index.step(rows)
        at[live] -= 1
        place = at[live]
        early = index.earlier(rows) < begin[live] + place
        units.append(live[early])
        firsts.append(place[early])
        going = place > 0
        live, rows = live[going], rows[going]
    unit, first = np.concatenate(units), np.concatenate(firsts)
    return unit, first, first + WIDTH


def _bytes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode(), np.uint8)


BYTES = Windows(WIDTH, (16, 48, 80, WIDTH), _bytes, lambda b: _BYTE_KEYS[b], same_document=True)


def _digest(doc_id: int, text: str | None, spans: np.ndarray) -> tuple:
    raw = (text or "").encode()
    kept, at = [], 0
    for a, b in spans.tolist():
        kept.append(raw[at:a])
        at = b
    left = b"".join([*kept, raw[at:]])
    return doc_id, len(raw), len(raw) - len(left), len(spans), hashlib.sha256(left).hexdigest()


def repeated_bytes(docs: DataFrame) -> DataFrame:
    """(doc, start, end): byte ranges covered by WIDTH bytes that also start earlier; ranges may overlap."""
    return repeated_spans(one_text(docs), BYTES, resolve)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    rows = one_text(docs)
    return with_spans(rows, repeated_spans(rows, BYTES, resolve), _digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
