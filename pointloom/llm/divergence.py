"""Audit of how sources of a language diverge in their terms, by sort-based streaming.

1. Each task counts the terms of its documents by (lang, source) and writes
   them as short runs (lang, term, source, first document, documents, count).
2. Runs are repartitioned by (lang, term) and sorted by (lang, term, source,
   document). A scan of the sorted rows joins runs of equal keys: a term's
   document frequency and its count in each source come out as its run ends.
   Terms in too few documents end there.
3. Kept counts meet their group's totals, are sorted by (lang, term, source)
   again, and a second scan emits, for each run of a term, partial sums for
   the pairs of sources that both hold it, and the best terms of each group.

A pair's value is a sum over all kept terms, most of which one or both sources
lack. As those have one and the same share in a group, with f the term's value,
p a count's share and p0 that of count 0,

    sum f(p, q) = sum over terms of both  f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)
                + sum over terms of the one   f(p, q0) - f(p0, q0)
                + sum over terms of the other f(p0, q) - f(p0, q0)
                + number of terms * f(p0, q0)

so only pairs in a run are emitted; the middle sums use how often each count
occurs in a group. All of it is whole-number arithmetic, so the order of sums
does not matter.

Hot terms: a task gives a term once a source and FLUSH entries, whatever its
documents hold, so the largest group has as many rows as there are such tasks
and sources, streamed without being held. A hot source only means larger
counts. A term's run in the second scan holds each of its sources once, and
pairs are made in slices of SLICE.

Edge cases: null text, lang and source are empty strings; every row is a
document, whatever its id, so equal rows count apart and null ids too; a group
without terms has share 0-count terms only; a lang without kept terms has pairs
of value 0 and no terms; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointloom.llm.common import short_batches, stored

TERM = "[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
SCALE = 1_000_000_000
#: Entries a task counts before it writes them; rows scanned at once; pairs made at once.
FLUSH, CHUNK, SLICE = 500_000, 50_000, 1_000_000
_LOWER = {c: c + 32 for c in range(65, 91)}
_SPREAD = 16

_RUNS = pa.schema([("lang", pa.string()), ("term", pa.string()), ("source", pa.string()), ("document", pa.int64()), ("df", pa.int64()), ("count", pa.int64())])
_KEPT = pa.schema([("lang", pa.string()), ("term", pa.string()), ("source", pa.string()), ("count", pa.int64()), ("whole", pa.int64()), ("first", pa.bool_())])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of the documents of a task: for each (lang, source), its terms' documents and counts."""
    find = re.compile(TERM).findall
    groups: dict[tuple[str, str], tuple[int, Counter, Counter]] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), (document, count, df) in groups.items():
            n = len(count)
            cols = [pa.repeat(lang, n), pa.array(list(count), pa.string()), pa.repeat(source, n), pa.repeat(document, n), pa.array([df[t] for t in count], pa.int64()), pa.array(list(count.values()), pa.int64())]
            yield from pa.Table.from_arrays(cols, schema=_RUNS).to_batches(max_chunksize=CHUNK)
        groups.clear()

    for batch in batches:
        for doc_id, text, lang, source in zip(*(batch.column(i).to_pylist() for i in range(4))):
            text = text or ""
            terms = find(text.lower() if text.isascii() else text.translate(_LOWER))
            if terms:
                key = (lang or "", source or "")
                group = groups.get(key) or groups.setdefault(key, (doc_id or 0, Counter(), Counter()))
                group[1].update(terms)
                group[2].update(set(terms))
        if sum(len(g[1]) for g in groups.values()) >= FLUSH:
            yield from flush()
    yield from flush()


def _whole_terms(batches: Iterator[pa.RecordBatch], merge) -> Iterator[pa.Table]:
    """Sorted rows in tables of about CHUNK rows that end where a (lang, term) ends; merge shortens what is held of an unfinished one."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < CHUNK:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        starts = np.flatnonzero(_changes(table, ["lang", "term"]))
        cut = int(starts[-1])
        if cut:
            yield table.slice(0, cut)
        rest = merge(table.slice(cut))
        held = rest.combine_chunks().to_batches()
        rows = rest.num_rows if rest.num_rows < CHUNK // 2 else 0  # a term of very many sources: only merged again after CHUNK more rows
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _changes(table: pa.Table, names: list[str]) -> np.ndarray:
    """True where a row differs from the one before in any of the columns; the first row always."""
    out = np.ones(table.num_rows, bool)
    out[1:] = False
    for name in names:
        col = table.column(name)
        out[1:] |= pc.not_equal(col.slice(1), col.slice(0, table.num_rows - 1)).to_numpy(zero_copy_only=False).astype(bool)
    return out


def _joined_runs(table: pa.Table) -> pa.Table:
    """Runs of equal (lang, term, source) as one each: the first document, the sums of documents and counts."""
    at = np.flatnonzero(_changes(table, ["lang", "term", "source"]))
    first = table.take(pa.array(at))
    for name in ("df", "count"):
        sums = np.add.reduceat(table.column(name).to_numpy(), at) if len(at) else np.zeros(0, np.int64)
        first = first.set_column(first.schema.get_field_index(name), name, pa.array(sums))
    return first


def _kept_terms(least: int):
    """Scan of sorted runs: the counts by source of each term that at least so many documents hold."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_terms(batches, _joined_runs):
            runs = _joined_runs(table)
            if not runs.num_rows:
                continue
            first = _changes(runs, ["lang", "term"])
            at = np.flatnonzero(first)
            size = np.diff(np.append(at, runs.num_rows))
            df = np.repeat(np.add.reduceat(runs.column("df").to_numpy(), at), size)
            whole = np.repeat(np.add.reduceat(runs.column("count").to_numpy(), at), size)
            runs = runs.append_column("whole", pa.array(whole)).append_column("first", pa.array(first)).filter(pa.array(df >= least))
            yield from runs.select(_KEPT.names).combine_chunks().to_batches()

    return scan


def shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (count + 2) / total), three digits at a time: exact for totals below 9e15."""
    out, rest = np.zeros(len(count), np.int64), count + 2
    whole, rest = rest // total, rest % total
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // total, rest % total
    return 1 + whole * SCALE + out


def value(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _pair_slices(starts: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j), i before j, of all pairs inside each run, about SLICE of them at a time."""
    row = np.arange(int(size.sum()))
    partners = np.repeat(starts + size, size) - row - 1  # later rows of the same run
    ends = np.cumsum(partners)
    at = 0
    while at < len(row):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE, side="right")))
        i = np.repeat(row[at:stop], partners[at:stop])
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(partners[at:stop]) - partners[at:stop], partners[at:stop])
        yield i, j
        at = stop


def _partials(top: int):
    """Scan of sorted counts with their shares: partial sums of pairs and each group's best terms so far."""
    schema = pa.schema([("part", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: dict[tuple[str, str, str], int] = {}
        best: dict[tuple[str, str], list[tuple[int, bytes]]] = {}

        def flush(part: str, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            if rows:
                yield from pa.Table.from_arrays([pa.repeat(part, len(rows)), *(pa.array(c, f.type) for c, f in zip(zip(*rows), list(schema)[1:]))], schema=schema).to_batches()

        for table in _whole_terms(batches, lambda t: t):
            lang, source = (table.column(c).dictionary_encode().combine_chunks() for c in ("lang", "source"))
            lang_at, source_at = lang.indices.to_numpy(), source.indices.to_numpy()
            langs, sources = lang.dictionary.to_pylist(), source.dictionary.to_pylist()
            p, p0, q = (table.column(c).to_numpy() for c in ("p", "p0", "q"))
            starts = np.flatnonzero(_changes(table, ["lang", "term"]))
            for i, j in _pair_slices(starts, np.diff(np.append(starts, table.num_rows))):
                if not len(i):
                    continue
                f = value(p[i], p[j]) - value(p[i], p0[j]) - value(p0[i], p[j]) + value(p0[i], p0[j])
                code = (lang_at[i].astype(np.int64) * len(sources) + source_at[i]) * len(sources) + source_at[j]
                order = np.argsort(code, kind="stable")
                at = np.flatnonzero(np.diff(code[order], prepend=-1))
                for c, total in zip(code[order][at].tolist(), np.add.reduceat(f[order], at).tolist()):
                    key = (langs[c // len(sources) ** 2], sources[c // len(sources) % len(sources)], sources[c % len(sources)])
                    pairs[key] = pairs.get(key, 0) + total
                if len(pairs) >= FLUSH:
                    yield from flush("pair", [(*k, v) for k, v in pairs.items()])
                    pairs.clear()
            over = np.flatnonzero(p > q)
            f, group = value(p[over], q[over]), lang_at[over].astype(np.int64) * len(sources) + source_at[over]
            order = np.lexsort((-f, group))  # ties are settled below, among all that reach the last place
            group, f, over = group[order], f[order], over[order]
            at = np.flatnonzero(np.diff(group, prepend=-1))
            last = np.minimum(at + top, np.append(at[1:], len(group))) - 1
            keep = f >= np.repeat(f[last], np.diff(np.append(at, len(group))))
            terms = table.column("term").take(pa.array(over[keep])).to_pylist()
            for g, v, term in zip(group[keep].tolist(), f[keep].tolist(), terms):
                best.setdefault((langs[g // len(sources)], sources[g % len(sources)]), []).append((-v, term.encode()))
            for key, rows in best.items():
                rows.sort()
                del rows[top:]
            if len(best) * top >= FLUSH:
                yield from flush("term", [(*k, t.decode(), -v) for k, rows in best.items() for v, t in rows])
                best.clear()
        yield from flush("pair", [(*k, v) for k, v in pairs.items()])
        yield from flush("term", [(*k, t.decode(), -v) for k, rows in best.items() for v, t in rows])

    return scan, "part string, lang string, source string, item string, value long"


def _share(count: Column, total: Column) -> Column:
    """shares() of columns."""
    return 1 + _floor_share(count + 2, total)


def _floor_share(rest: Column, total: Column) -> Column:
    div = lambda a, b: F.call_function("div", a, b)
    out, rest = div(rest, total) * SCALE, rest % total
    for digits in (1_000_000, 1_000, 1):
        rest = rest * 1000
        out, rest = out + div(rest, total) * digits, rest % total
    return out


def _value(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def divergence(docs: DataFrame, least_documents: int = 10, top: int = 10) -> DataFrame:
    """lang, source, part, item, value, rank: each group's divergence from the other sources of its language, and its most typical terms."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), empty("lang").alias("lang"), empty("source").alias("source"))
    runs = short_batches(rows).mapInArrow(_counted, "lang string, term string, source string, document long, df long, count long")
    sorted_runs = runs.repartition("lang", "term").sortWithinPartitions("lang", "term", "source", "document")
    kept = stored(sorted_runs.mapInArrow(_kept_terms(least_documents), "lang string, term string, source string, count long, whole long, first boolean"))

    sizes = kept.groupBy("lang").agg(F.sum(F.col("first").cast("long")).alias("terms"), F.sum(F.when(F.col("first"), F.col("whole"))).alias("whole_n"))
    group_n = kept.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    groups = rows.select("lang", "source").distinct().join(group_n, ["lang", "source"], "left").join(sizes, "lang", "left").na.fill(0, ["n", "terms", "whole_n"])
    base = F.col("n") + 2 * F.col("terms")
    groups = stored(groups.select("lang", "source", "terms", "n", base.alias("total"), F.coalesce(_share(F.lit(0).cast("long"), F.nullif(base, F.lit(0).cast("long"))), F.lit(1)).cast("long").alias("p0"), (F.col("whole_n") + 2 * F.col("terms")).alias("whole_total")))

    counts = kept.join(groups, ["lang", "source"]).select(
        "lang", "term", "source", "count", "p0", _share(F.col("count"), F.col("total")).alias("p"), _share(F.col("whole"), F.col("whole_total")).alias("q")
    )
    scan, schema = _partials(top)
    partial = stored(counts.repartition("lang", "term").sortWithinPartitions("lang", "term", "source").mapInArrow(scan, schema))

    # every ordered pair of a language's sources: as many rows as the result has
    spread = F.pmod(F.xxhash64("source"), F.lit(_SPREAD))
    left = groups.withColumn("_s", spread)
    right = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0")).withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(_SPREAD - 1))))
    pairs = left.join(right.withColumn("_s", F.col("_s").cast("long")), ["lang", "_s"]).where(F.col("source") != F.col("item"))
    pairs = pairs.select("lang", "source", "item", "terms", "total", "p0", "q0")
    both = partial.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = both.unionByName(both.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    often = kept.groupBy("lang", "source", "count").agg(F.count("*").alias("times"))
    one = pairs.join(often, ["lang", "source"])
    p = _share(F.col("count"), F.col("total"))
    one = one.groupBy("lang", "source", "item").agg(F.sum(F.col("times") * (_value(p, F.col("q0")) - _value(F.col("p0"), F.col("q0")))).alias("value"))
    other = one.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    neither = pairs.select("lang", "source", "item", (F.col("terms") * _value(F.col("p0"), F.col("q0"))).alias("value"))
    total = neither.unionByName(one).unionByName(other).unionByName(both).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")  # as many rows as a language has sources, or top from each task
    ranked = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).cast("int").alias("rank"))
    terms = ranked(partial.where("part = 'term'"), "term").where(F.col("rank") <= top)
    return ranked(total, "pair").unionByName(terms)
