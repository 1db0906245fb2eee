"""Sinks: PLY, scan labels, npy scenes, tiles with statistics, run-length masks, vector JSON.

Encoders turn groups of rows into rows (name, content); save_files writes those
into a folder all executors share. Tables go through Spark's own writers.
"""

from __future__ import annotations

import io
import os

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_PLY = {"tinyint": ("char", "i1"), "smallint": ("short", "i2"), "int": ("int", "i4"), "bigint": ("int", "i4"), "float": ("float", "f4"), "double": ("double", "f8"), "uchar": ("uchar", "u1")}


def ply_files(df: DataFrame, name: str, order: str, columns: list[str], uchar: tuple[str, ...] = ()) -> DataFrame:
    """One binary PLY (name, content) for each value of column name, its points by order. A group is one file, so one task's."""
    types = dict(df.dtypes)
    props = [(c, *_PLY["uchar" if c in uchar else types[c]]) for c in columns]

    def encode(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        rows = np.empty(len(pdf), np.dtype([(c, "<" + t) for c, _, t in props]))
        for c, _, t in props:
            rows[c] = pdf[c].to_numpy()
        head = "ply\nformat binary_little_endian 1.0\nelement vertex %d\n%send_header\n" % (len(pdf), "".join(f"property {k} {c}\n" for c, k, _ in props))
        return pd.DataFrame({"name": [f"{pdf[name].iloc[0]}.ply"], "content": [head.encode() + rows.tobytes()]})

    return df.select(*{name, order, *columns}).groupBy(name).applyInPandas(encode, "name string, content binary")


def label_files(df: DataFrame, name: str, order: str, label: str, inverse: dict[int, int] | None = None, bits: int = 32) -> DataFrame:
    """Label words (name, content) of each scene, through an inverse label map."""

    def encode(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.sort_values(order)[label].map(lambda k: (inverse or {}).get(k, k)).to_numpy()
        return pd.DataFrame({"name": [f"{pdf[name].iloc[0]}.{'label' if bits == 32 else 'bin'}"], "content": [v.astype("<u4" if bits == 32 else "u1").tobytes()]})

    return df.select(name, order, label).groupBy(name).applyInPandas(encode, "name string, content binary")


def scene_files(df: DataFrame, name: str, order: str, assets: dict[str, list[str]]) -> DataFrame:
    """npy arrays (name = scene/asset.npy, content) of each scene."""

    def encode(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        out = []
        for asset, cols in assets.items():
            buf = io.BytesIO()
            a = pdf[cols].to_numpy(np.int32 if asset in ("segment", "instance") else np.float32)
            np.save(buf, a[:, 0] if len(cols) == 1 else a)
            out.append((f"{pdf[name].iloc[0]}/{asset}.npy", buf.getvalue()))
        return pd.DataFrame(out, columns=["name", "content"])

    return df.select(*{name, order, *[c for cols in assets.values() for c in cols]}).groupBy(name).applyInPandas(encode, "name string, content binary")


def save_files(files: DataFrame, folder: str) -> None:
    """Writes (name, content) rows into a folder that every executor shares; a file appears whole or not at all."""

    def write(rows):
        for r in rows:
            path = os.path.join(folder, r["name"])
            os.makedirs(os.path.dirname(path), exist_ok=True)
            part = f"{path}.{os.getpid()}.part"
            with open(part, "wb") as f:
                f.write(bytes(r["content"]))
            os.replace(part, path)

    files.foreachPartition(write)


def write_tiles(df: DataFrame, path: str) -> None:
    """Points as Parquet by tile, so that a tile is read by its folder alone."""
    df.repartition("tx", "ty").write.mode("overwrite").partitionBy("tx", "ty").parquet(path)


def write_stats(stats: DataFrame, path: str) -> None:
    stats.write.mode("overwrite").json(path)


def run_length_text(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Runs (start, length) of every mask as the text `start length start length ...`."""
    pairs = F.sort_array(F.collect_list(F.struct("start", "length")))  # one entry a run
    return runs.groupBy(*keys).agg(F.concat_ws(" ", F.transform(pairs, lambda r: F.concat_ws(" ", r["start"], r["length"]))).alias("rle"))


def vector_json(objects: DataFrame, width: int, height: int) -> DataFrame:
    """Objects (class, class_id, id, geometry, anchor, area_px) as one JSON layer a class."""
    layer = F.collect_list(F.struct("id", "geometry", "anchor", "area_px"))
    return objects.groupBy("class", "class_id").agg(F.to_json(F.struct(F.struct(F.lit(width).alias("width"), F.lit(height).alias("height")).alias("canvas"), F.sort_array(layer).alias("objects"))).alias("json"))


def overlap_lines(pairs: DataFrame, path: str, least: float = 0.0) -> None:
    """Text lines `a b overlap` of pairs over least."""
    pairs.where(F.col("share") >= least).select(F.concat_ws(" ", "a", "b", F.format_number("share", 6)).alias("value")).write.mode("overwrite").text(path)
