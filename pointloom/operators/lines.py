"""Neighbourhoods by lines: points of equal x and z lie on a line in order of y, and a ball meets a line in one stretch of it.

What is asked of the points in a ball (whether there are any, their number, sums over them, what they hang together with) is read
off the two ends of its stretches. The work grows with the points times the lines that a ball meets, not with the pairs: points
that differ in y only, as those of a raster or a profile do, cost the logarithm of their number. Where no two points share a
line, a stretch is one point, and the work is that of the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.operators.common import stored

CELL = ["_cx", "_cy", "_cz"]
#: Points of a cell, above which smaller cells are taken; they are never smaller than the radius.
MOST = 1_000_000
#: Stretches that a task works out at once.
AT_ONCE = 300_000
#: Places on one line that are worked out together.
LONG = 64


def known(keys: list[str]) -> str:
    """The condition that a point has finite coordinates and all keys."""
    return " and ".join(["coalesce(x - x + y - y + z - z = 0, false)", *[f"{k} is not null" for k in keys]])


class Cells:
    """Cells over the box of the points, up to 16 radii wide: as wide as leaves no cell more points than a task should hold and enough cells for many tasks."""

    def __init__(self, points: DataFrame, radius: float, keys: list[str]):
        self.radius, self.keys = radius, keys
        box = points.agg(*[f(F.col(c).cast("double")).alias(f"{n}{c}") for c in "xyz" for f, n in ((F.min, "lo"), (F.max, "hi"))]).first()
        self.low = {c: box[f"lo{c}"] or 0.0 for c in "xyz"}
        size = {c: (box[f"hi{c}"] or 0.0) - self.low[c] for c in "xyz"}
        by = points.groupBy(*keys, *[F.floor((F.col(c).cast("double") - self.low[c]) / radius).alias(g) for g, c in zip(CELL, "xyz")])
        by = stored(by.agg(F.count("*").alias("n")))
        most = min(MOST, max(50_000, (by.agg(F.sum("n")).first()[0] or 0) // 24))
        for wide in (16, 8, 4, 2, 1):
            self.edge = wide * radius
            if wide == 1 or (by.groupBy(*keys, *[F.floor(F.col(g) / wide).alias(g) for g in CELL]).agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0) <= most:
                break
        self.last = {c: int(size[c] // self.edge) for c in "xyz"}
        wide = self.edge / radius
        self.tasks = min(1000, by.select(*keys, *[F.floor(F.col(g) / wide).alias(g) for g in CELL]).distinct().count())

    def dealt(self, places: DataFrame, own: list[str]) -> DataFrame:
        """A row for each cell that the ball around a place touches; _own marks the cell it lies in, elsewhere the columns own are null."""
        df = places.withColumns({c: F.col(c).cast("double") for c in "xyz"}).withColumn("_own", F.lit(True))
        for g, c in zip(CELL, "xyz"):
            reach = F.lit(self.radius * 1.000001) + F.abs(c) * 1e-15
            at = lambda e, c=c: F.least(F.greatest(F.floor((e - self.low[c]) / self.edge), F.lit(0)), F.lit(self.last[c])).cast("int")
            df = df.withColumn("_at", at(F.col(c))).withColumn(g, F.explode(F.sequence(at(F.col(c) - reach), at(F.col(c) + reach))))
            df = df.withColumn("_own", F.col("_own") & (F.col(g) == F.col("_at"))).drop("_at")
        return df.withColumns({c: F.when(F.col("_own"), F.col(c)) for c in own})

    def applied(self, places: DataFrame, own: list[str], run, schema: str) -> DataFrame:
        """run over each cell's table; a task has few cells, however little they weigh."""
        key = [*self.keys, *CELL]
        return self.dealt(places, own).repartition(max(1, self.tasks), *key).groupBy(*key).applyInArrow(run, schema)


class Lines:
    """Points (arrays x, y, z, and a group that parts them) in order of line and y."""

    def __init__(self, x: np.ndarray, y: np.ndarray, z: np.ndarray, group: np.ndarray | None = None):
        sort = [y, z, x] if group is None else [y, group, z, x]
        self.order = np.lexsort(sort)
        x, y, z = x[self.order], y[self.order], z[self.order]
        new = np.ones(len(x), bool)
        new[1:] = (x[1:] != x[:-1]) | (z[1:] != z[:-1])
        if group is not None:
            group = group[self.order]
            new[1:] |= group[1:] != group[:-1]
        self.start = np.flatnonzero(new)
        self.end = np.append(self.start[1:], len(x))
        self.line = np.cumsum(new) - 1
        self.x, self.z, self.y = x[self.start], z[self.start], y
        self.group = None if group is None else group[self.start]
        self.low, self.high = (y.min(), y.max()) if len(y) else (0.0, 0.0)
        self.span = self.high - self.low + 1.0
        self.key = self.line * self.span + (y - self.low)

    def stretches(self, x: np.ndarray, y: np.ndarray, z: np.ndarray, limit: float) -> Iterator[tuple[slice | np.ndarray, int | np.ndarray, np.ndarray, np.ndarray]]:
        """For the places asked, in order of line and y: row, line, lo and hi, so that the points lo to hi (exclusive) are all those of the
        line with a squared distance under limit; a stretch can be empty. Row is a slice and line a number where many places lie on one line."""
        new = np.ones(len(x), bool)
        new[1:] = (x[1:] != x[:-1]) | (z[1:] != z[:-1])
        first = np.append(np.flatnonzero(new), len(x))
        ux, uz = x[new], z[new]
        step = max(1, AT_ONCE // max(1, len(self.x)))
        for some in range(0, len(ux), step):
            upto = min(some + step, len(ux))
            dx, dz = self.x - ux[some:upto, None], self.z - uz[some:upto, None]
            of, near = np.nonzero(dx * dx + dz * dz < limit * (1 + 1e-12))
            count = np.bincount(of, minlength=upto - some)
            at = np.cumsum(count) - count
            size = np.diff(first[some : upto + 1])
            for u in np.flatnonzero(size >= LONG):
                s = slice(first[some + u], first[some + u + 1])
                for line in near[at[u] : at[u] + count[u]]:
                    yield s, line, *self._between(y[s], line, dx[u, line] * dx[u, line], dz[u, line] * dz[u, line], limit)
            short = np.flatnonzero((size < LONG) & (count > 0))
            mine = np.repeat(short, size[short])  # the line of each place on a short line, and the place
            place = np.repeat(first[some + short] - (np.cumsum(size[short]) - size[short]), size[short]) + np.arange(len(mine))
            total = np.cumsum(count[mine])
            lo = 0
            while lo < len(mine):
                hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + AT_ONCE, "right")))
                n = count[mine[lo:hi]]
                row = np.repeat(place[lo:hi], n)
                line = near[np.repeat(at[mine[lo:hi]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
                yield row, line, *self._ends(x[row], y[row], z[row], line, limit)
                lo = hi

    def _between(self, y, line, dx2, dz2, limit):
        """The stretches of a line about ascending y."""
        start, end = self.start[line], self.end[line]
        most = _farthest(float(dx2), float(dz2), limit)
        if most is None:
            none = np.full(len(y), start)
            return none, none
        on = self.y[start:end]
        lo, hi = np.searchsorted(on, y - most, "left"), np.searchsorted(on, y + most, "right")
        low = (y - on.take(lo - 1, mode="clip") <= most) & (lo > 0) | (y - on.take(lo, mode="clip") > most) & (lo < hi)
        high = (on.take(hi, mode="clip") - y <= most) & (hi < len(on)) | (on.take(hi - 1, mode="clip") - y > most) & (hi > lo)
        lo, hi = lo + start, hi + start
        off = np.flatnonzero(low | high)
        if len(off):
            lo[off], hi[off] = self._exact(lo[off], hi[off], start, end, y[off], dx2, dz2, limit)
        return lo, hi

    def _ends(self, x, y, z, line, limit):
        dx, dz = self.x[line] - x, self.z[line] - z
        dx2, dz2 = dx * dx, dz * dz
        w = np.sqrt(np.maximum(limit - dx2 - dz2, 0))
        base = line * self.span - self.low
        low, high = self.low - 0.25, self.high + 0.25
        start, end = self.start[line], self.end[line]
        lo = np.clip(np.searchsorted(self.key, base + np.clip(y - w, low, high), "left"), start, end)
        hi = np.clip(np.searchsorted(self.key, base + np.clip(y + w, low, high), "right"), lo, end)
        return self._exact(lo, hi, start, end, y, dx2, dz2, limit)

    def _exact(self, lo, hi, start, end, y, dx2, dz2, limit):
        """The ends found are off by rounding only: few move, and hardly more than once."""

        def over(d, at):
            return d if np.ndim(d) == 0 else d[at]

        def hit(i, at=slice(None)):
            dy = self.y[i] - y[at]
            return (over(dx2, at) + dy * dy) + over(dz2, at) < limit

        last = len(self.y) - 1
        for ends, off, by, inside, wanted in ((lo, -1, -1, lambda at: over(start, at) < lo[at], True), (lo, 0, 1, lambda at: lo[at] < hi[at], False), (hi, 0, 1, lambda at: hi[at] < over(end, at), True), (hi, -1, -1, lambda at: lo[at] < hi[at], False)):
            at = np.flatnonzero((hit(np.clip(ends + off, 0, last)) == wanted) & inside(slice(None)))
            while len(at):
                ends[at] += by
                at = at[inside(at)]
                at = at[hit(ends[at] + off, at) == wanted]
        return lo, hi


def _farthest(dx2: float, dz2: float, limit: float) -> float | None:
    """The largest d with dx2 + d * d + dz2 under limit as computed; None if there is none."""

    def hit(d: float) -> bool:
        return (dx2 + d * d) + dz2 < limit

    if not hit(0.0):
        return None
    d = math.sqrt(max(limit - dx2 - dz2, 0.0))
    for _ in range(4):
        if hit(d):
            break
        d = math.nextafter(d, 0.0)
    for _ in range(4):
        if hit(d) and not hit(math.nextafter(d, math.inf)):
            return d
        d = math.nextafter(d, math.inf)
    low, high = 0.0, 2 * math.sqrt(limit)
    while math.nextafter(low, math.inf) < high:
        mid = low + (high - low) / 2 if low > high / 4 else math.sqrt(max(low, 5e-324) * high)
        mid = min(max(mid, math.nextafter(low, math.inf)), math.nextafter(high, 0.0))
        low, high = (mid, high) if hit(mid) else (low, mid)
    return low


def added(to: np.ndarray, row: slice | np.ndarray, e: np.ndarray) -> None:
    """e summed onto its rows, as stretches() names them."""
    if isinstance(row, slice):
        to[row] += e
    elif len(row):
        to[row[0] : row[-1] + 1] += np.bincount(row - row[0], e)


def columns(t: pa.Table, *names: str) -> list[np.ndarray]:
    return [t.column(c).to_numpy() for c in names]


def repeated(t: pa.Table, rows: np.ndarray, ids: str) -> tuple[pa.Array, np.ndarray]:
    """The ids listed at the rows, one after the other, and how many each row has."""
    lists = t.column(ids).combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], lists.type)
    lists = lists.take(pa.array(rows))
    return lists.flatten(), np.asarray(pc.list_value_length(lists), np.int64)


def linked(points: DataFrame, radius: float, keys: list[str], axis: str | None = None) -> DataFrame:
    """Stored rows (pid, label) of points with keys and place, of which those nearer than radius with equal keys hang together:
    within a cell they have one label, the least pid of all that hang together as far as the cell sees. Rows with a pid as
    link, and no others, tell that the label hangs together with that of the link's point.

    Points of a line with less than radius from one to the next are a run; runs are linked where a stretch of another line ends in them.
    With an axis, x or z, only points of equal height on it hang together, and rows with u and v tell the least edge (w, u, v) between
    label and link, both labels then: w is the difference in height, u < v are the pids of points nearer than radius."""
    from pointloom.operators.neighbors import _at_places

    points = points.where(known(keys)).where("pid is not null")
    cells = Cells(points, radius, keys)
    places = _at_places(points, [*keys, "x", "y", "z"], "_ids").withColumn("pid", F.array_min("_ids").cast("long"))
    kind = dict(points.dtypes)["pid"]
    return stored(cells.applied(places, ["_ids"], _linked(radius * radius, cells, axis), f"pid {kind}, label long, link long, w double, u long, v long"))


def _linked(limit: float, cells: Cells, axis: str | None):
    low, edge, last = cells.low, cells.edge, cells.last

    def run(t: pa.Table) -> pa.Table:
        own, x, y, z, pid = columns(t, "_own", "x", "y", "z", "pid")
        kind = t.schema.field("_ids").type.value_type
        if not own.any():
            return _rows(kind, pa.array([], kind), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 5)))
        lines = Lines(x, y, z)
        o = lines.order
        own, pid = own[o], pid[o]
        step = np.diff(lines.y)
        new = np.ones(len(o), bool)
        new[1:] = (lines.line[1:] != lines.line[:-1]) | ~(step * step < limit)
        of = np.cumsum(new) - 1
        n = int(of[-1]) + 1
        found = [np.zeros(0, np.int64)]
        asked = np.flatnonzero(own)
        level = None if axis is None else {"x": x, "z": z}[axis][o]
        least_pid = _Least(pid, lines) if axis else None
        runs, edges = np.append(np.flatnonzero(new), len(o)), {}
        for row, line, lo, hi in lines.stretches(x[o][asked], lines.y[asked], z[o][asked], limit):
            full, q = hi > lo, asked[row]
            if axis:
                w = np.broadcast_to(np.abs(level[lines.start[line]] - level[q]), len(q))
                other = full & (w > 0)
                _least_edges(edges, n, q[other], w[other], lo[other], hi[other], of, runs, pid, least_pid)
                full &= w == 0
            here, a, b = of[q[full]], of[lo[full]], of[hi[full] - 1]
            while len(here):  # the runs a to b, hardly ever more than two
                found.append(np.unique(np.minimum(here, a) * n + np.maximum(here, a)))
                more = a < b
                here, a, b = here[more], a[more] + 1, b[more]
            if len(found) > 1000:
                found = [np.unique(np.concatenate(found))]
        pairs = np.unique(np.concatenate(found))
        part = _parts(n, pairs // n, pairs % n)[of]
        least = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(least, part, pid)
        label = least[part]
        ids, count = repeated(t, o[asked], "_ids")
        # the neighbours' points: one of each run and neighbouring cell says what hangs together
        cell = np.stack([np.clip(np.floor((v[o] - low[c]) / edge), 0, last[c]) for c, v in zip("xyz", (x, y, z))])
        others = np.flatnonzero(~own)
        first = np.ones(len(others), bool)
        c = cell[:, others]
        first[1:] = (of[others[1:]] != of[others[:-1]]) | (c[:, 1:] != c[:, :-1]).any(0) | (np.diff(others) > 1)
        link = others[first]
        least_of = least[_parts(n, pairs // n, pairs % n)]
        between = np.array([(least_of[a], least_of[b], *e) for (a, b), e in edges.items()], object).reshape(-1, 5)
        return _rows(kind, ids, np.concatenate([np.repeat(label[asked], count), label[link]]), pid[link], between)

    return run


def _rows(kind: pa.DataType, ids: pa.Array, label: np.ndarray, link: np.ndarray, edges: np.ndarray) -> pa.Table:
    n, m, k = len(ids), len(link), len(edges)
    a, b, w, u, v = (pa.array(list(e), pa.float64() if i == 2 else pa.int64()) for i, e in enumerate(edges.T))
    return pa.table({
        "pid": pa.concat_arrays([ids, pa.nulls(m + k, kind)]), "label": pa.concat_arrays([pa.array(label), a]), "link": pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(link), b]),
        "w": pa.concat_arrays([pa.nulls(n + m, pa.float64()), w]), "u": pa.concat_arrays([pa.nulls(n + m, pa.int64()), u]), "v": pa.concat_arrays([pa.nulls(n + m, pa.int64()), v]),
    })


class _Least:
    """The least of values between two places of an order, from tables of the least of 1, 2, 4, ... of them."""

    def __init__(self, values: np.ndarray, lines: Lines):
        self.of = [values]
        longest = int((lines.end - lines.start).max())
        while 2 ** len(self.of) <= longest:
            half = 2 ** (len(self.of) - 1)
            last = self.of[-1]
            self.of.append(np.minimum(last[: len(last) - half], last[half:]))

    def __call__(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        out = np.empty(len(lo), np.int64)
        power = np.frexp((hi - lo).astype(float))[1] - 1
        for p in np.unique(power):
            at = power == p
            out[at] = np.minimum(self.of[p][lo[at]], self.of[p][hi[at] - 2**p])
        return out


def _least_edges(edges: dict, n: int, q, w, lo, hi, of, runs, pid, least) -> None:
    """Puts the least edge (w, u, v) between each two runs into edges: one end is asked, the other the least pid of a run in its stretch.

    That is the least of all: if (u, v) is, then no pid under u lies near v, so that v's own answer is u."""
    at = of[lo] if len(lo) else lo
    while len(q):
        end = np.minimum(hi, runs[at + 1])
        m, p = least(lo, end), pid[q]
        a, b = of[q], at
        code = np.minimum(a, b) * n + np.maximum(a, b)
        u, v = np.minimum(p, m), np.maximum(p, m)
        if code[0] == code[-1] and w[0] == w[-1] and (code == code[0]).all() and (w == w[0]).all():
            some = np.flatnonzero(u == u.min())
            first = some[[v[some].argmin()]]
        else:
            order = np.lexsort([v, u, w, code])
            first = order[np.append(True, np.diff(code[order]) != 0)]
        for i in first:
            key, e = divmod(int(code[i]), n), (float(w[i]), int(u[i]), int(v[i]))
            if key not in edges or e < edges[key]:
                edges[key] = e
        more = end < hi
        q, w, lo, hi, at = q[more], w[more], end[more], hi[more], at[more] + 1


def _parts(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least number that each of n numbers hangs together with by the pairs a, b."""
    part = np.arange(n)
    while len(a):
        pa_, pb = part[a], part[b]
        open_ = pa_ != pb
        a, b, pa_, pb = a[open_], b[open_], pa_[open_], pb[open_]
        np.minimum.at(part, np.maximum(pa_, pb), np.minimum(pa_, pb))
        while (part[part] != part).any():
            part = part[part]
    return part


def components_of(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From linked(): (pid, label) of every point, and (label, component) of every label, the least pid of all that hang together."""
    from pointloom.operators.components import components

    points = rows.where("link is null").select("pid", "label")
    links = rows.where("link is not null and u is null").select(F.col("label").alias("u"), F.col("link").alias("pid"))
    edges = points.join(links, "pid").select("u", F.col("label").alias("v")).where("u <> v").distinct()
    joined = components(edges).select(F.col("node").alias("label"), "component")
    labels = rows.select("label").distinct().join(joined, "label", "left").select("label", F.coalesce("component", "label").alias("component"))
    return points, stored(labels)
