"""Benchmark decontamination: pigeonhole pieces, then Myers bit-parallel distance.

Texts and items are normalised (lower case, every run of non-word characters
one space). An item of m characters has an error budget of k = m // 20 edits
and is split into k + 1 pieces of nearly equal length: any text within k edits
of the item holds at least one piece unchanged. An Aho-Corasick pass over the
text finds all pieces; each hit places the item, and Myers' bit-parallel
algorithm finds the least edit distance of the item to any stretch of the text
around that place. A document is contaminated by an item whose distance is at
most k. Items of under SHORT characters are one piece with no errors and must
stand between word boundaries, so that "no" is not found in "note".

The items are a table of bounded size (its bytes are checked before it is
broadcast; a larger table is handled block by block, each within the bound).
Edge cases: null and empty texts, and items without a letter or digit, match
nothing; equal items count once each; repeated rows give repeated results; null
ids pass through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.llm.common import ROWS, short_batches

_GAP = re.compile(r"[\W_]+")


def normalise(text: str) -> str:
    return _GAP.sub(" ", text.lower()).strip()


#: Characters below which an item must be found exactly, as whole words.
SHORT = 40


def budget_of(length: int) -> int:
    return length // 20 if length >= SHORT else 0


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """errors + 1 pieces of nearly equal length, with their offsets."""
    n = errors + 1
    cuts = [i * len(item) // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


class Pattern:
    """An item ready for Myers' algorithm: a bit mask of places for each character."""

    def __init__(self, text: str):
        self.text, self.errors = text, budget_of(len(text))
        self.masks: dict[str, int] = {}
        for i, c in enumerate(text):
            self.masks[c] = self.masks.get(c, 0) | 1 << i
        self.last, self.full = 1 << (len(text) - 1), (1 << len(text)) - 1

    def best(self, text: str) -> tuple[int, int]:
        """Least edit distance of the item to any substring of text, and where the first such substring ends."""
        up, down, score = self.full, 0, len(self.text)
        least, end = score, 0
        masks, full, last = self.masks, self.full, self.last
        for j, c in enumerate(text):
            eq = masks.get(c, 0)
            diagonal = ((((eq & up) + up) ^ up) | eq | down) & full
            right, left = down | ~(diagonal | up) & full, up & diagonal
            if right & last:
                score += 1
            elif left & last:
                score -= 1
            right, left = (right << 1) & full, (left << 1) & full
            up, down = (left | ~(diagonal | right)) & full, right & diagonal
            if score < least:
                least, end = score, j + 1
        return least, end


class Matcher:
    """All pieces of a block of items in one automaton."""

    def __init__(self, items: list[tuple[int, str]]):
        import ahocorasick

        self.items = [(item_id, Pattern(text)) for item_id, text in items]
        hits: dict[str, list[tuple[int, int]]] = {}
        for i, (_, p) in enumerate(self.items):
            if len(p.text) < SHORT:
                hits.setdefault(f" {p.text} ", []).append((i, -1))
                continue
            for at, piece in pieces(p.text, p.errors):
                hits.setdefault(piece, []).append((i, at))
        self.auto = ahocorasick.Automaton()
        for piece, where in hits.items():
            self.auto.add_word(piece, (len(piece), where))
        if hits:
            self.auto.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item id, start of the searched stretch, end of the match, distance) for each item within its budget, by its best place."""
        if not self.items or not text:
            return []
        spots: dict[int, set[int]] = {}
        out = []
        found: set[int] = set()
        for end, (length, where) in self.auto.iter(f" {text} "):  # a place of the text is one less
            for i, at in where:
                if at >= 0:
                    spots.setdefault(i, set()).add(end - length - at)
                elif i not in found:  # a short item, with the spaces around it
                    found.add(i)
                    out.append((self.items[i][0], end - length + 1, end - 1, 0))
        for i, starts in spots.items():
            item_id, p = self.items[i]
            k, best = p.errors, None
            reach = 0
            todo: list[list[int]] = []
            for s in sorted(starts):  # stretches that meet are searched together
                a, b = max(0, s - k), min(len(text), s + len(p.text) + k)
                if todo and a <= reach:
                    todo[-1][1] = max(todo[-1][1], b)
                else:
                    todo.append([a, b])
                reach = todo[-1][1]
            for a, b in todo:
                if b - a < len(p.text) - k:
                    continue
                exact = text.find(p.text, a, b)
                d, e = (0, exact + len(p.text) - a) if exact >= 0 else p.best(text[a:b])
                if d <= k and (best is None or d < best[0]):
                    best = (d, a, a + e)
            if best:
                out.append((item_id, best[1], best[2], best[0]))
        return sorted(out)


def item_blocks(items: DataFrame, most_bytes: int) -> Iterator[list[tuple[int, str]]]:
    """Normalised items in blocks of at most most_bytes bytes (one item at least)."""
    block, size = [], 0
    rows = items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text is not null").orderBy("item_id", "text")
    for item_id, text in rows.toLocalIterator():
        norm = normalise(text)
        if not norm:
            continue
        if block and size + len(norm) > most_bytes:
            yield block
            block, size = [], 0
        block.append((item_id, norm))
        size += len(norm)
    yield block


def contaminated(docs: DataFrame, items: DataFrame, most_bytes: int = 2_000_000) -> DataFrame:
    """(doc_id, item_id, distance, errors, match_end): one row for each document and item found in it within the error budget.

    match_end counts characters of the normalised text."""
    out = None
    for block in item_blocks(items, most_bytes):
        found = _against(docs.select("doc_id", "text"), block)
        out = found if out is None else out.unionByName(found)
    return out


def _against(docs: DataFrame, block: list[tuple[int, str]]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(block)  # at most most_bytes
    state: dict[str, Matcher] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if "m" not in state:
            state["m"] = Matcher(shared.value)
        m = state["m"]
        errors = {item_id: p.errors for item_id, p in m.items}
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                rows = [(d, i, dist, errors[i], end) for d, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) if t for i, _, end, dist in m.find(normalise(t))]
                cols = list(zip(*rows)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()))], names=["doc_id", "item_id", "distance", "errors", "match_end"])

    return short_batches(docs).mapInArrow(run, "doc_id long, item_id long, distance int, errors int, match_end long")


def drop_contaminated(docs: DataFrame, items: DataFrame, most_bytes: int = 2_000_000) -> DataFrame:
    """docs without the rows whose text holds an item within its error budget; other rows and all columns are unchanged."""
    out = docs
    for block in item_blocks(items, most_bytes):
        out = out.where(~_hit(out, block)(F.col("text")))
    return out


def _hit(docs: DataFrame, block: list[tuple[int, str]]):
    import pandas as pd

    shared = docs.sparkSession.sparkContext.broadcast(block)  # at most most_bytes
    state: dict[str, Matcher] = {}

    def hit(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if "m" not in state:
            state["m"] = Matcher(shared.value)
        for texts in batches:
            yield pd.Series([bool(t and state["m"].find(normalise(t))) for t in texts], dtype=bool)

    return F.pandas_udf(hit, "boolean", functionType=F.PandasUDFType.SCALAR_ITER)
