"""Helpers shared by the text operators: Arrow row batches, hashes, checkpoints."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.operators.common import dropped, shared_folder, stored  # noqa: F401  (what the text operators share with the core)

#: Rows handed to Python code at once; bounds memory when texts are long.
ROWS = 256
#: Rows in an Arrow batch of texts.
BATCH_ROWS = 2000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def short_batches(df: DataFrame) -> DataFrame:
    """df, after its session's Arrow batches are bounded: texts can be long, and a batch is held whole on both sides."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df


def map_rows(df: DataFrame, fn: Callable[[dict[str, list]], dict[str, list]], schema: str) -> DataFrame:
    """Apply fn to column lists of at most ROWS rows; text stays inside Arrow batches."""
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                out = fn({name: part.column(i).to_pylist() for i, name in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return short_batches(df).mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id"):
    """True where crc32 of the id's decimal text leaves 2 modulo 4; null ids are not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the splitmix constants) on uint64 arrays."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BASE = 0x9E3779B97F4A7C17
_INVERSE = pow(BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i below at least n."""
    if len(_POWERS.get("up", ())) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length())
        for name, base in (("up", BASE), ("down", _INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[name] = np.cumprod(p, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


_BYTE_KEYS = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


class Prefix:
    """Prefix sums of a polynomial hash over a byte array; hashes any slices at once."""

    def __init__(self, buf: np.ndarray):
        self.up, self.down = powers(len(buf) + 1)
        self.sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(_BYTE_KEYS[buf] * self.up[: len(buf)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix64((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and 64-bit hashes of the words [^\\x20\\x09-\\x0D]+ of a UTF-8 text."""
    buf = np.frombuffer(text, np.uint8)
    inside = np.zeros(len(buf) + 2, bool)
    inside[1:-1] = ~_SPACE[buf]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return starts, ends, np.zeros(0, np.uint64)
    return starts, ends, Prefix(buf).of(starts, ends)


_SHINGLE = mix64(np.arange(11, 75, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)) | np.uint64(1)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive word hashes."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(m, np.uint64)
    for i in range(n):
        total += words[i : i + m] * _SHINGLE[i]
    return mix64(total)
