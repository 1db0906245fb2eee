"""Point files as DataFrames: PLY, KITTI and nuScenes scans, npy asset folders, npz, text clouds.

Files come through Spark's binaryFile and text readers, so any store Spark can
read works, and each is parsed in the task that reads it. Rows carry `path`
and `ord`, the point's place in its file. A file is at most 2 GB, the limit of
a binary value.
"""

from __future__ import annotations

import io
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: PLY type names by numpy type and Spark type.
PLY_TYPES = {
    "char": ("i1", "tinyint"), "int8": ("i1", "tinyint"), "uchar": ("u1", "smallint"), "uint8": ("u1", "smallint"),
    "short": ("i2", "smallint"), "int16": ("i2", "smallint"), "ushort": ("u2", "int"), "uint16": ("u2", "int"),
    "int": ("i4", "int"), "int32": ("i4", "int"), "uint": ("u4", "bigint"), "uint32": ("u4", "bigint"),
    "float": ("f4", "float"), "float32": ("f4", "float"), "double": ("f8", "double"), "float64": ("f8", "double"),
}
_ARROW = {"tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64(), "float": pa.float32(), "double": pa.float64(), "array<bigint>": pa.list_(pa.int64())}
#: Points in one Arrow batch.
BATCH = 100_000


class PlyHeader:
    """Format, elements and properties of a PLY file; `start` is where the body begins."""

    def __init__(self, data: bytes):
        end = data.find(b"end_header")
        if not data.startswith(b"ply") or end < 0:
            raise ValueError("not a PLY file")
        self.start = data.index(b"\n", end) + 1
        self.format, self.elements = "", []
        for line in data[:end].decode("ascii", "replace").split("\n"):
            w = line.split()
            if not w:
                continue
            if w[0] == "format":
                self.format = w[1]
            elif w[0] == "element":
                self.elements.append((w[1], int(w[2]), []))
            elif w[0] == "property":
                self.elements[-1][2].append(("list", w[2], w[3], w[4]) if w[1] == "list" else ("one", w[1], w[2]))
        if self.format not in ("ascii", "binary_little_endian", "binary_big_endian"):
            raise ValueError(f"unknown PLY format {self.format!r}")
        self.order = ">" if self.format == "binary_big_endian" else "<"

    def names(self, element: str) -> list[tuple[str, str]]:
        """(name, Spark type) of an element's properties."""
        for name, _, props in self.elements:
            if name == element:
                return [(p[3], "array<bigint>") if p[0] == "list" else (p[2], PLY_TYPES[p[1]][1]) for p in props]
        return []

    def read(self, data: bytes, element: str) -> dict[str, np.ndarray | list]:
        """Columns of one element; elements before it are stepped over."""
        if self.format == "ascii":
            lines, at = data[self.start :].decode("ascii", "replace").split("\n"), 0
            for name, count, props in self.elements:
                if name == element:
                    return self._text([line.split() for line in lines[at : at + count]], props)
                at += count
            return {}
        at = self.start
        for name, count, props in self.elements:
            if all(p[0] == "one" for p in props):
                dtype = np.dtype([(p[2], self.order + PLY_TYPES[p[1]][0]) for p in props])
                if name == element:
                    rows = np.frombuffer(data, dtype, count, at)
                    return {p[2]: rows[p[2]] for p in props}
                at += dtype.itemsize * count
            else:
                cols, at = self._lists(data, at, count, props)
                if name == element:
                    return cols
        return {}

    def _lists(self, data: bytes, at: int, count: int, props: list) -> tuple[dict, int]:
        cols: dict[str, list] = {p[-1]: [] for p in props}
        for _ in range(count):
            for p in props:
                n = 1
                if p[0] == "list":
                    size = np.dtype(self.order + PLY_TYPES[p[1]][0])
                    n = int(np.frombuffer(data, size, 1, at)[0])
                    at += size.itemsize
                kind = np.dtype(self.order + PLY_TYPES[p[2] if p[0] == "list" else p[1]][0])
                v = np.frombuffer(data, kind, n, at)
                at += kind.itemsize * n
                cols[p[-1]].append(v.astype(np.int64).tolist() if p[0] == "list" else v[0])
        return cols, at

    @staticmethod
    def _text(rows: list[list[str]], props: list) -> dict[str, list]:
        cols: dict[str, list] = {p[-1]: [] for p in props}
        for w in rows:
            at = 0
            for p in props:
                if p[0] == "list":
                    n = int(w[at])
                    cols[p[3]].append([int(v) for v in w[at + 1 : at + 1 + n]])
                    at += n + 1
                else:
                    cols[p[2]].append(float(w[at]) if p[1] in ("float", "float32", "double", "float64") else int(float(w[at])))
                    at += 1
        return cols


def _files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path", "content")


def _parsed(files: DataFrame, parse: Callable[[bytes], dict], columns: list[tuple[str, str]]) -> DataFrame:
    """Rows (path, ord, columns) of each file's arrays, in batches."""
    schema = pa.schema([("path", pa.string()), ("ord", pa.int64()), *[(n, _ARROW[t]) for n, t in columns]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                got = parse(content.as_py())
                n = len(next(iter(got.values()))) if got else 0
                for lo in range(0, n, BATCH):
                    hi = min(n, lo + BATCH)
                    cols = [pa.array([path] * (hi - lo)), pa.array(np.arange(lo, hi))]
                    for name, kind in columns:
                        v = got.get(name)
                        if v is None:
                            cols.append(pa.nulls(hi - lo, _ARROW[kind]))
                        elif isinstance(v, list):
                            cols.append(pa.array(v[lo:hi], _ARROW[kind]))
                        else:
                            cols.append(pa.array(v[lo:hi].astype(_ARROW[kind].to_pandas_dtype())))
                    yield pa.RecordBatch.from_arrays(cols, schema=schema)

    ddl = ", ".join(["path string", "ord long", *[f"`{n}` {t}" for n, t in columns]])
    return files.mapInArrow(run, ddl)


def read_ply(spark: SparkSession, path: str, element: str = "vertex", glob: str = "*.ply") -> DataFrame:
    """Rows of an element (vertex, face) of PLY files, binary of either byte order or ASCII.

    The columns are those of the first file's header; a file without one of them has nulls there."""
    files = _files(spark, path, glob)
    head = files.select(F.substring("content", 1, 1 << 16).alias("head")).limit(1).collect()
    if not head:
        raise FileNotFoundError(f"no {glob} under {path}")
    columns = PlyHeader(bytes(head[0]["head"])).names(element)
    return _parsed(files, lambda data: PlyHeader(data).read(data, element), columns)


def labelled_points(ply: DataFrame) -> DataFrame:
    """x, y, z, r, g, b, class of PLY vertices: alpha stands in where all colours are 0, class falls back to cla, then 0."""
    c = set(ply.columns)
    rgb = [F.col(n) if n in c else F.lit(0) for n in ("red", "green", "blue")]
    if "alpha" in c:
        none = (rgb[0] == 0) & (rgb[1] == 0) & (rgb[2] == 0)
        rgb = [F.when(none, F.col("alpha")).otherwise(v) for v in rgb]
    label = F.col("class") if "class" in c else F.col("cla") if "cla" in c else F.lit(0)
    keys = [k for k in ("path", "ord") if k in c]
    return ply.select(*keys, "x", "y", "z", *[v.cast("int").alias(n) for v, n in zip(rgb, "rgb")], label.cast("int").alias("class"))


def finite(df: DataFrame) -> DataFrame:
    """Rows whose coordinates are all finite numbers."""
    keep = F.lit(True)
    for c in "xyz":
        keep = keep & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    return df.where(keep)


def _grid(data: bytes, dtype: str, names: list[str]) -> dict[str, np.ndarray]:
    rows = np.frombuffer(data, dtype).reshape(-1, len(names))
    return {n: rows[:, i] for i, n in enumerate(names)}


def read_scans(spark: SparkSession, path: str, columns: tuple[str, ...] = ("x", "y", "z", "strength"), glob: str = "*.bin") -> DataFrame:
    """float32 scans: four columns a point (KITTI), or five (nuScenes: name a fifth)."""
    names = list(columns)
    return _parsed(_files(spark, path, glob), lambda data: _grid(data, "<f4", names), [(n, "float") for n in names])


def read_scan_labels(spark: SparkSession, path: str, bits: int = 32, glob: str = "*.label") -> DataFrame:
    """Label files: 32-bit words (class in the low 16 bits, instance above) or single bytes."""
    if bits == 8:
        return _parsed(_files(spark, path, glob), lambda data: {"segment": np.frombuffer(data, "u1")}, [("segment", "smallint")])

    def words(data: bytes) -> dict[str, np.ndarray]:
        w = np.frombuffer(data, "<u4")
        return {"segment": w & 0xFFFF, "instance": w >> 16}

    return _parsed(_files(spark, path, glob), words, [("segment", "int"), ("instance", "int")])


def stem(path: str = "path"):
    """File name without folder and suffix."""
    return F.regexp_replace(F.element_at(F.split(F.col(path), "/"), -1), r"\.[^.]*$", "")


def read_labelled_scans(spark: SparkSession, scans: str, labels: str, ignore: int = -1) -> DataFrame:
    """KITTI points with their labels by file stem and place; points without a label file get ignore."""
    s = read_scans(spark, scans).withColumn("scene", stem())
    lab = read_scan_labels(spark, labels).select(stem().alias("scene"), "ord", "segment", "instance")
    out = s.join(lab, ["scene", "ord"], "left")
    return out.withColumns({"segment": F.coalesce("segment", F.lit(ignore)), "instance": F.coalesce("instance", F.lit(ignore))})


#: Assets of a scene folder, by columns.
ASSETS = {"coord": ["x", "y", "z"], "color": ["r", "g", "b"], "normal": ["nx", "ny", "nz"], "strength": ["strength"], "segment": ["segment"], "instance": ["instance"]}


def read_scenes(spark: SparkSession, path: str, ignore: int = -1) -> DataFrame:
    """Scene folders of npy arrays as points: scene, ord, one column or more an asset; labels default to ignore."""

    def load(names: list[str]):
        def parse(data: bytes) -> dict[str, np.ndarray]:
            a = np.load(io.BytesIO(data), allow_pickle=False)
            a = a.reshape(len(a), -1).astype(np.float64)
            return {n: a[:, i] for i, n in enumerate(names) if i < a.shape[1]}

        return parse

    scene = F.element_at(F.split("path", "/"), -2).alias("scene")
    out = None
    for asset, names in ASSETS.items():
        files = _files(spark, path, f"{asset}.npy")
        if out is not None and not files.limit(1).count():
            part = None
        else:
            part = _parsed(files, load(names), [(n, "double") for n in names]).select(scene, "ord", *names)
        if out is None:
            out = part
        elif part is not None:
            out = out.join(part, ["scene", "ord"], "left")
        else:
            out = out.withColumns({n: F.lit(None).cast("double") for n in names})
    return out.withColumns({k: F.coalesce(F.col(k).cast("int"), F.lit(ignore)) for k in ("segment", "instance")})


def read_npz(spark: SparkSession, path: str, keys: dict[str, list[str]] | None = None, glob: str = "*.npz") -> DataFrame:
    """npz archives: arrays by key (default coord and color) as columns."""
    keys = keys or {"coord": ["x", "y", "z"], "color": ["r", "g", "b"]}

    def parse(data: bytes) -> dict[str, np.ndarray]:
        z = np.load(io.BytesIO(data), allow_pickle=False)
        out = {}
        for key, names in keys.items():
            if key in z:
                a = z[key].reshape(len(z[key]), -1).astype(np.float64)
                out.update({n: a[:, i] for i, n in enumerate(names)})
        return out

    return _parsed(_files(spark, path, glob), parse, [(n, "double") for names in keys.values() for n in names])


def read_text_points(spark: SparkSession, path: str, columns: list[str], separator: str = r"\s+", glob: str = "*.txt") -> DataFrame:
    """Text clouds, one point a line: whitespace (part files) or comma separated (shape files)."""
    lines = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", "true").text(path).select(F.input_file_name().alias("path"), F.trim("value").alias("value")).where("value <> ''")
    parts = F.split("value", separator)
    return lines.select("path", *[F.get(parts, F.lit(i)).cast("double").alias(c) for i, c in enumerate(columns)])


def read_overlap_pairs(spark: SparkSession, path: str, least: float = 0.3) -> DataFrame:
    """Pairs `a b overlap` with overlap over least."""
    p = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select(F.get(p, F.lit(0)).alias("a"), F.get(p, F.lit(1)).alias("b"), F.get(p, F.lit(2)).cast("double").alias("overlap"))
    return rows.where(F.col("overlap") > least)


def read_splits(spark: SparkSession, path: str, splits: list[str]) -> DataFrame:
    """Points stored as Parquet by split and scene; only the wanted splits' folders are read."""
    return spark.read.parquet(path).where(F.col("split").isin(*splits))


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """Points by the suffix of path: .ply, .bin, .npz, .txt or .xyz; a folder is read as scenes."""
    suffix = re.search(r"\.(\w+)$", path)
    kind = suffix[1].lower() if suffix else ""
    readers = {"ply": lambda: read_ply(spark, path), "bin": lambda: read_scans(spark, path), "npz": lambda: read_npz(spark, path), "txt": lambda: read_text_points(spark, path, ["x", "y", "z"]), "xyz": lambda: read_text_points(spark, path, ["x", "y", "z"], glob="*.xyz")}
    if kind and kind not in readers:
        raise ValueError(f"no reader for .{kind}")
    return readers[kind]() if kind else read_scenes(spark, path)
