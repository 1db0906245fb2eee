"""Finding repeated windows across a corpus: the part shared by both exact-substring operators.

A window is `width` consecutive symbols (bytes or words) of one document. Each
window is assigned the anchor of least hash among its `q`-grams, so equal
windows always share their anchor; consecutive windows with one anchor form a
unit. Units are dealt by anchor. Equal units but the first are repeats as a
whole; anchors that occur once are done; units that share an anchor but differ
go to an index (the caller's resolver), many anchors to one bounded block.
Anchors with more than HOT differing units are split: their windows are dealt
anew by longer anchors, in units again, as often as needed. The longest anchor
is the window itself, under which no two units differ, so every anchor ends in
a block that fits a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.llm.common import ROWS, BASE, _INVERSE, mix64, short_batches, stored

#: Differing units of one anchor that a block may hold; an anchor with more is split.
HOT = 3000
#: Bytes of unit content in one indexed block.
BLOCK = 1_000_000


class Windows:
    """How to read documents as symbols: width of a window, lengths of an anchor's q-gram, symbols of a text, 64-bit values of symbols.

    q: the usual length first, then those that split hot anchors, the last being width;
    same_document: whether a window may repeat an earlier one of its own document."""

    def __init__(self, width: int, q: tuple[int, ...], symbols: Callable[[str], np.ndarray], values: Callable[[np.ndarray], np.ndarray], same_document: bool):
        if q[-1] != width or list(q) != sorted(set(q)):
            raise ValueError("anchor lengths grow, up to the window's width")
        self.width, self.q, self.symbols, self.values, self.same_document = width, q, symbols, values, same_document


_POW: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW.get("up", ())) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length())
        for name, base in (("up", BASE), ("down", _INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POW[name] = np.cumprod(p, dtype=np.uint64)
    return _POW["up"], _POW["down"]


def units_of(values: np.ndarray, width: int, q: int) -> tuple[np.ndarray, ...]:
    """(anchor hash, content hash, first window, number of windows) of the units of one document."""
    n = len(values) - width + 1
    if n <= 0:
        return tuple(np.zeros(0, np.uint64) for _ in range(4))
    up, down = _powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    grams = mix64((sums[q:] - sums[:-q]) * down[: len(values) - q + 1])
    key = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)  # ties go left
    span, done = width - q + 1, 1
    while done < span:
        step = min(done, span - done)
        key = np.minimum(key[:-step], key[step:])
        done += step
    at = (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    count = np.diff(np.append(first, n))
    end = first + count - 1 + width
    content = mix64((sums[end] - sums[first]) * down[first] + (end - first).astype(np.uint64))
    return grams[at[first]], content, first, count


def _long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64)


def _units(parts: list[list[np.ndarray]], same_document: bool) -> pa.RecordBatch | None:
    """Units of a batch from lists of (anchor, content, document, first window, windows) columns.

    Repeats inside the batch are told at once (kind 1) and dealt by their own hash."""
    if not parts[0] or not sum(map(len, parts[0])):
        return None
    a, u, doc, at, n = (np.concatenate(p) for p in parts)
    order = np.lexsort((at, doc, u))
    a, u, doc, at, n = (x[order] for x in (a, u, doc, at, n))
    run_first = _fill(np.append(True, u[1:] != u[:-1]))
    copy = (doc > doc[run_first]) | ((at != at[run_first]) if same_document else False)
    a = np.where(copy, _long(mix64(u.view(np.uint64) + doc.view(np.uint64))), a)
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (copy.astype(np.int8), a, u, doc, at, n.astype(np.int32))], names=["kind", "a", "u", "doc", "at", "n"])


def _extract(win: Windows):
    """Units of documents, rows (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: list[list[np.ndarray]] = [[] for _ in range(5)]
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for i in range(batch.num_rows):
                text = batch.column(1)[i].as_py()
                if text is None:
                    continue
                a, u, at, n = units_of(win.values(win.symbols(text)), win.width, win.q[0])
                for into, x in zip(parts, (a, u, np.full(len(a), ids[i], np.int64), at, n)):
                    into.append(_long(x))
            found = _units(parts, win.same_document)
            if found is not None:
                yield found

    return run


def _fill(starts: np.ndarray) -> np.ndarray:
    """For each place the last place at or before it where starts holds."""
    return np.maximum.accumulate(np.where(starts, np.arange(len(starts)), 0))


def _sift(same_document: bool):
    """Reads units sorted by anchor, content, document and place; gives repeats (kind 1) and units that need the index (kind 0).

    Between batches only the last unit's state and the units of an anchor's first content are kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None  # rows of the current anchor's first content, in case a second one comes
        state = None  # (anchor, content, document and place of the content's first row, whether the anchor has a second content)
        for batch in batches:
            kind, a, u, doc, at, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(6))
            if not len(a):
                continue
            lead = 0
            if state is not None:  # the state goes first as one more row
                a, u, doc, at = (np.append(s, x) for s, x in zip(state[:4], (a, u, doc, at)))
                kind, n, lead = np.append(0, kind), np.append(0, n), 1
            new_a = np.append(True, a[1:] != a[:-1])
            new_u = new_a | np.append(True, u[1:] != u[:-1])
            first_u, first_a = _fill(new_u), _fill(new_a)
            copy = (doc > doc[first_u]) | ((at != at[first_u]) if same_document else False) | (kind == 1)
            group = np.cumsum(new_a) - 1
            contents = np.bincount(group, weights=new_u)
            if lead and state[4]:
                contents[0] += 1
            many = contents[group] > 1
            real = np.arange(len(a)) >= lead
            rep = ~copy & real
            if held is not None and contents[0] > 1:
                yield _out(held[0], held[1], held[2], held[3], held[4])
                held = None
            last = group == group[-1]
            keep_back = rep & last & ~many
            send = copy & real
            rows = [np.concatenate([x[send], x[rep & many]]) for x in (np.where(copy, 1, 0), a, doc, at, n)]
            if len(rows[0]):
                yield _out(*rows)
            if group[-1] > 0:
                held = None
            if keep_back.any():
                more = [x[keep_back] for x in (np.zeros(len(a), np.int64), a, doc, at, n)]
                held = more if held is None else [np.append(x, y) for x, y in zip(held, more)]
            f = first_u[-1]
            state = (a[-1], u[-1], doc[f], at[f], bool(many[-1]))

    return run


def _out(kind, a, doc, at, n) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(x).astype(t)) for x, t in ((kind, np.int8), (a, np.int64), (doc, np.int64), (at, np.int64), (n, np.int32))], names=["kind", "a", "doc", "at", "n"])


def _finer(win: Windows, q: int, a: int, doc: int, at: int, content: bytes) -> list[tuple]:
    """Rows (a, doc, at, n, content) of one unit's windows dealt by anchors of q symbols; windows of different anchors differ, so the old one counts too."""
    symbols = np.frombuffer(content, win.symbols("").dtype)
    new, _, first, n = units_of(win.values(symbols), win.width, q)
    new = mix64(new + np.array([a], np.int64).view(np.uint64)).view(np.int64)
    return [(x, doc, at + i, k, symbols[i : i + k - 1 + win.width].tobytes()) for x, i, k in zip(new.tolist(), first.tolist(), n.tolist())]


def _contents(win: Windows):
    """Attaches its symbols to each unit of a document, units of hot anchors under longer anchors: rows (a, doc, at, n, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                rows: list[tuple] = []
                for doc, text, units in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist()):
                    symbols = win.symbols(text)
                    for x in units:
                        content = symbols[x["at"] : x["at"] + x["n"] - 1 + win.width].tobytes()
                        rows += _finer(win, win.q[1], x["a"], doc, x["at"], content) if x["hot"] else [(x["a"], doc, x["at"], x["n"], content)]
                cols = list(zip(*rows)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()))], names=["a", "doc", "at", "n", "content"])

    return run


def _settle(win: Windows, resolve, q: int | None):
    """Resolves units (a, u, doc, at, n, content) sorted by anchor, content hash, document and place, whole anchors to a block of BLOCK bytes.

    Gives repeated ranges (kind 1; n symbols from at). Of an anchor with more than HOT differing units only
    HOT are ever held: all are given back under anchors of q symbols (kind 0). q is None after the last length,
    where an anchor is the window and no two units of it differ."""
    types = (pa.int8(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[tuple] = []  # (a, doc, at, n, content)
        out: list[tuple] = []
        size = since = 0  # bytes in the block, where the anchor's units begin in it
        anchor = first = None
        hot = False

        def flush() -> list[tuple]:
            block.sort(key=lambda r: (r[1], r[2]))  # the order in which windows count as earlier
            unit, start, end = resolve([r[4] for r in block], np.array([r[1] for r in block]), np.array([r[3] for r in block]))
            by = np.argsort(unit, kind="stable")
            unit, start, end = unit[by], start[by], end[by]
            found = []
            for lo, hi in zip(*_groups(unit)):
                _, doc, at, _, _ = block[unit[lo]]
                found += [(1, 0, doc, at + x, y - x, b"") for x, y in merge(start[lo:hi], end[lo:hi]).tolist()]
            block.clear()
            return found

        def rows() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["kind", "a", "doc", "at", "n", "content"])
            out.clear()
            return batch

        def split(units: list[tuple]) -> None:
            for a, doc, at, _, content in units:
                out.extend((0, *x) for x in _finer(win, q, a, doc, at, content))

        for batch in batches:
            for a, u, doc, at, n, content in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if a != anchor:
                    if size > BLOCK:
                        out += flush()
                        size = 0
                    anchor, first, since, hot = a, None, len(block), False
                if first is None or first[0] != u or first[3] != content:
                    first = (u, doc, at, content)
                elif doc > first[1] or (win.same_document and at != first[2]):
                    out.append((1, 0, doc, at, n - 1 + win.width, b""))
                    continue
                unit = (a, doc, at, n, content)
                if hot:
                    split([unit])
                elif q is not None:
                    block.append(unit)
                    size += len(content)
                    if len(block) - since > HOT:
                        hot = True
                        size -= sum(len(r[4]) for r in block[since:])
                        split(block[since:])
                        del block[since:]
                if len(out) >= ROWS:
                    yield rows()
        if block:
            out += flush()
        if out:
            yield rows()

    return run


def _groups(sorted_values: np.ndarray) -> tuple[list[int], list[int]]:
    """Where each run of equal values begins and ends."""
    if not len(sorted_values):
        return [], []
    lo = np.flatnonzero(np.append(True, sorted_values[1:] != sorted_values[:-1]))
    return lo.tolist(), np.append(lo[1:], len(sorted_values)).tolist()


def one_text(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with one row an id: rows without id are left out, of rows that share an id the least text stays."""
    rows = short_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    ids = rows.select("doc_id").groupBy("doc_id").count()
    return rows.groupBy("doc_id").agg(F.min("text").alias("text")) if ids.where("count > 1").limit(1).count() else rows


def repeated_spans(docs: DataFrame, win: Windows, resolve) -> DataFrame:
    """(doc, start, end): symbol ranges made of windows that repeat an earlier one; docs has one row an id.

    resolve(contents, docs, counts) gets a block's units in order and returns arrays (unit, first, end) of marked symbols."""
    units = docs.mapInArrow(_extract(win), "kind byte, a long, u long, doc long, at long, n int")
    sifted = stored(
        units.repartition("a").sortWithinPartitions("a", "u", "doc", "at").mapInArrow(_sift(win.same_document), "kind byte, a long, doc long, at long, n int")
    )
    spans = sifted.where("kind = 1").select("doc", F.col("at").alias("start"), (F.col("at") + F.col("n") - 1 + win.width).alias("end"))
    open_ = sifted.where("kind = 0").select("a", "doc", "at", "n")
    hot = stored(open_.groupBy("a").count().where(F.col("count") > HOT).select("a", F.lit(True).alias("hot")))
    dealt = open_.join(hot, "a", "left")  # hot anchors are split where the documents lie, before the shuffle
    by_doc = dealt.groupBy("doc").agg(F.collect_list(F.struct("a", "at", "n", "hot")).alias("units"))  # no more than a document has windows
    joined = docs.join(by_doc, docs["doc_id"] == by_doc["doc"]).select("doc_id", "text", "units")
    held = joined.mapInArrow(_contents(win), "a long, doc long, at long, n int, content binary")
    for q in (*win.q[2:], None):
        ordered = held.repartition("a").select("a", F.xxhash64("content").alias("u"), "doc", "at", "n", "content").sortWithinPartitions("a", "u", "doc", "at")
        settled = stored(ordered.mapInArrow(_settle(win, resolve, q), "kind byte, a long, doc long, at long, n int, content binary"))
        spans = spans.unionByName(settled.where("kind = 1").select("doc", F.col("at").alias("start"), (F.col("at") + F.col("n")).alias("end")))
        held = settled.where("kind = 0").select("a", "doc", "at", "n", "content")
        if not held.limit(1).count():
            break
    return spans


def with_spans(docs: DataFrame, spans: DataFrame, fn, schema: str) -> DataFrame:
    """fn(doc_id, text, merged spans) for every document, spans as a sorted (k, 2) array; fn returns a tuple for schema."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))
    by_doc = spans.groupBy("doc").agg(F.collect_list(F.struct("start", "end")).alias("spans"))  # no more than a document has windows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                lists = part.column(2)
                rows = []
                for i, (doc, text) in enumerate(zip(part.column(0).to_pylist(), part.column(1).to_pylist())):
                    s = lists[i].values
                    rows.append(fn(doc, text, merge(s.field(0).to_numpy(), s.field(1).to_numpy()) if s is not None else np.zeros((0, 2), np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    joined = docs.join(by_doc, docs["doc_id"] == by_doc["doc"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(run, schema)


def merge(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Disjoint maximal ranges covering the given ones; ranges that touch are joined."""
    if not len(start):
        return np.zeros((0, 2), np.int64)
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.flatnonzero(np.append(True, start[1:] > end[:-1]))
    return np.stack([start[new], end[np.append(new[1:] - 1, len(end) - 1)]], axis=1)
