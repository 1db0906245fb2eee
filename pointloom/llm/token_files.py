"""Token ids of documents in binary files, by static range asymmetric numeral systems.

write_tokens: documents are ranged and sorted by id, tokenized once where they
then lie and kept as rows of about FRAME ids; the ids of all documents are
counted into one table of frequencies, shared by all files; then each row
becomes a frame (see rans.py) of a file in ascending order of document ids. A
frame is decoded without any other, and a block of it without the frame's
other blocks.

A folder holds `table.bin` (the frequencies), `frames` (a Parquet table of where
each frame lies: the index) and `*.ids` files. A task gives its file a name of
its own and lists it in the index, so a file of a lost or repeated task is
simply not listed. Places in the whole stream of ids follow from the index.

Only whole words go through the tokenizer: no token spans ASCII white space, so
a word has the same ids everywhere, and a worker keeps those of words it has seen,
in two halves: when the newer is full, the older is forgotten.

Edge cases: null and empty texts have the end id only; a null id comes before
all others and stays null; rows of equal id follow each other by their texts'
hash and text; equal rows are separate documents; an empty table gives an empty index;
other columns are not read. A document is never split between frames, so a
frame is as large as its largest document; that text is one row before.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.llm.common import dropped, short_batches, stored
from pointloom.llm.rans import Frame, Table, pack
from pointloom.sources.storage import located

#: Ids of a frame at least, documents it grows by, bytes of texts looked up at once, words and ids a worker keeps, words encoded at once.
FRAME, ROWS, BYTES, WORDS, IDS, JOINED = 1 << 19, 256, 1 << 22, 1_000_000, 8_000_000, 50
INDEX = "file string, part int, first long, at long, size long, n_docs long, n_ids long"


class WordIds:
    """Ids of texts by a tokenizer of the tokenizers library whose tokens never span ASCII white space."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self._clear()
        self.before = self.memo, self.ids, self.start, self.size

    def _clear(self) -> None:
        self.memo: dict[str, int] = {}
        self.ids, self.start, self.size = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.used = 0

    def _add(self, words: list[str], sizes: np.ndarray, ids: np.ndarray) -> None:
        n, known = len(ids), len(self.memo)
        while self.used + n > len(self.ids):
            self.ids = np.append(self.ids, np.zeros_like(self.ids))
        while known + len(words) > len(self.start):
            self.start, self.size = np.append(self.start, np.zeros_like(self.start)), np.append(self.size, np.zeros_like(self.size))
        self.ids[self.used : self.used + n] = ids
        self.size[known : known + len(words)] = sizes
        self.start[known : known + len(words)] = self.used + np.cumsum(sizes) - sizes
        self.memo.update(zip(words, range(known, known + len(words))))
        self.used += n

    def _learn(self, words: list[str]) -> None:
        ids, at, shift, n = [], [], [], 0  # of each token: its id, its place in its join, and where that join begins among all
        for i in range(0, len(words), JOINED):
            text = " ".join(words[i : i + JOINED])
            got = self.tokenizer.encode(text, add_special_tokens=False)
            ids += got.ids
            at += [a for a, _ in got.offsets]
            shift.append((n, len(got.ids)))
            n += len(text) + 1
        begins, known = (np.array(c, np.int64) for c in zip(*shift)) if shift else (np.zeros(0, np.int64),) * 2
        size = np.fromiter(map(len, words), np.int64, len(words)) + 1
        owner = np.searchsorted(np.cumsum(size), np.array(at, np.int64) + np.repeat(begins, known), side="right")
        self._add(words, np.bincount(owner, minlength=len(words)), np.array(ids, np.uint32))

    def _recall(self, words: list[str]) -> list[str]:
        """Takes over what was known of these words before the last forgetting; gives the others."""
        memo, ids, start, size = self.before
        at = list(map(memo.get, words))
        place = np.array([p for p in at if p is not None], np.int64)
        if len(place):
            self._add([w for w, p in zip(words, at) if p is not None], size[place], ids[_ranges(start[place], size[place])])
        return [w for w, p in zip(words, at) if p is None]

    def _places(self, words: list[str]) -> np.ndarray:
        """Where each of these different words is kept, after the new ones are learned."""
        if len(self.memo) > WORDS // 2 or self.used > IDS // 2:  # what is not asked for until the next time is forgotten
            self.before = self.memo, self.ids, self.start, self.size
            self._clear()
        at = list(map(self.memo.get, words))
        if None in at:
            new = [i for i, known in enumerate(at) if known is None]
            self._learn(self._recall([words[i] for i in new]))
            for i in new:
                at[i] = self.memo[words[i]]
        return np.array(at, np.int64)

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of ids of the texts, with the end id, and all their ids. Each different word is looked up once."""
        split = pc.ascii_split_whitespace(texts.fill_null(""))
        words = split.flatten().dictionary_encode()
        place = self._places(words.dictionary.to_numpy(zero_copy_only=False).tolist())[words.indices.to_numpy()]
        size = self.size[place]
        upto = np.concatenate([[0], np.cumsum(size)])
        total = int(upto[-1])
        ids = self.ids[_ranges(self.start[place], size)]
        lengths = np.diff(upto[np.cumsum(pc.list_value_length(split).to_numpy(), dtype=np.int64)], prepend=0)
        out = np.full(total + len(texts), end, np.uint32)
        out[np.arange(total) + np.repeat(np.arange(len(texts)), lengths)] = ids
        return lengths + 1, out


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each range, one range after the other."""
    before = np.cumsum(size) - size
    return np.repeat(start - before, size) + np.arange(int(size.sum()))


_KEPT: dict[str, WordIds] = {}


def _word_ids(path: str) -> WordIds:
    if path not in _KEPT:
        _KEPT[path] = WordIds(path)
    return _KEPT[path]


_ROWS = pa.schema([("part", pa.int32()), ("first", pa.int64()), ("doc_ids", pa.binary()), ("lengths", pa.binary()), ("ids", pa.binary())])


def _tokenized(path: str, end: int, kind: str):
    """Rows (part, first id's place in it, packed ids of documents, lengths and tokens) of sorted documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, held = TaskContext.get().partitionId(), 0, ([], [], [])

        def row() -> pa.RecordBatch:
            nonlocal first
            docs, lengths, ids = held[0], np.concatenate(held[1]), np.concatenate(held[2])
            known = bytes(d is not None for d in docs)
            cols = ([part], [first], [known + np.array([d or 0 for d in docs], "<i8").tobytes()], [lengths.astype("<i8").tobytes()], [ids.astype(kind).tobytes()])
            first += len(ids)
            for c in held:
                c.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _ROWS)], schema=_ROWS)

        words = _word_ids(path)
        n = 0
        for batch in batches:
            upto = np.cumsum(pc.binary_length(batch.column(1).fill_null("")).to_numpy(), dtype=np.int64)
            cuts = [0, *(np.flatnonzero(np.diff(upto // BYTES)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                some = batch.slice(lo, hi - lo)
                docs = some.column(0).to_pylist()
                lengths, ids = words.encode(some.column(1), end)
                upto = np.cumsum(lengths)
                for at in range(0, len(docs), ROWS):
                    held[0].extend(docs[at : at + ROWS])
                    held[1].append(lengths[at : at + ROWS])
                    held[2].append(ids[upto[at] - lengths[at] : upto[at : at + ROWS][-1]])
                    n += len(held[2][-1])
                    if n >= FRAME:
                        yield row()
                        n = 0
        if held[0]:
            yield row()

    return run


def _counted(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(0, np.int64)
        for batch in batches:
            for ids in batch.column(0):
                new = np.bincount(np.frombuffer(ids.as_buffer(), kind), minlength=len(counts))
                new[: len(counts)] += counts
                counts = new
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(counts[found])], names=["id", "n"])

    return run


def _written(folder: str, table, kind: str):
    """Writes the rows as frames of this task's files, a file for each unbroken stretch of a part; gives the index rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = Table.from_bytes(table.value)
        fs, base = located(folder)
        out, name, follows, at, rows = None, "", None, 0, []
        try:
            for batch in batches:
                for part, first, docs, lengths, ids in zip(*(batch.column(i) for i in range(5))):
                    part, first = part.as_py(), first.as_py()
                    lengths, ids = np.frombuffer(lengths.as_buffer(), "<i8"), np.frombuffer(ids.as_buffer(), kind).astype(np.int64)
                    n = len(lengths)
                    raw = docs.as_py()
                    known, docs = np.frombuffer(raw, "u1", n), np.frombuffer(raw, "<i8", n, n)
                    data = pack([d if k else None for d, k in zip(docs.tolist(), known.tolist())], lengths, ids, shared)
                    if follows != (part, first):
                        if out is not None:
                            out.close()
                        name, at = f"{part:07d}-{first:015d}-{uuid.uuid4().hex}.ids", 0
                        out = fs.open_output_stream(f"{base}/{name}")
                    out.write(data)
                    rows.append((name, part, first, at, len(data), n, len(ids)))
                    follows, at = (part, first + len(ids)), at + len(data)
        finally:
            if out is not None:
                out.close()
        names = [c.split()[0] for c in INDEX.split(", ")]
        kinds = [pa.string(), pa.int32(), *[pa.int64()] * 5]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 7, kinds)], names=names)

    return run


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end: int) -> DataFrame:
    """Writes the documents' ids, each document closed by `end`, into a new folder; gives its index.

    tokenizer: path of a tokenizers file; no token may span ASCII white space."""
    spark = docs.sparkSession
    size = max(_word_ids(tokenizer).vocabulary, end + 1)
    kind = "<u2" if size <= 1 << 16 else "<u4"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("_h", F.xxhash64("text"))
    # copies of one row may be many: they are dealt apart, and any order of them is the same
    rows = rows.withColumn("_copy", F.pmod(F.monotonically_increasing_id(), F.lit(1009)))
    rows = short_batches(rows).repartitionByRange("doc_id", "_h", "_copy").sortWithinPartitions("doc_id", "_h", "text").select("doc_id", "text")
    frames = stored(rows.mapInArrow(_tokenized(tokenizer, end, kind), "part int, first long, doc_ids binary, lengths binary, ids binary"), "zstd")

    counts = np.zeros(size, np.int64)
    found = frames.select("ids").mapInArrow(_counted(kind), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()  # at most one row for each id of the vocabulary
    for r in found:
        counts[r["id"]] = r["n"]
    table = Table.fit(counts).to_bytes()
    fs, base = located(folder)
    fs.create_dir(base, recursive=True)
    with fs.open_output_stream(f"{base}/table.bin") as f:
        f.write(table)
    index = frames.mapInArrow(_written(folder, spark.sparkContext.broadcast(table), kind), INDEX)
    index.write.parquet(f"{folder}/frames")
    dropped(frames)
    return read_index(spark, folder)


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """Where each frame of a folder lies, with `start`, the ids of all documents before it."""
    index = spark.read.schema(INDEX).parquet(f"{folder}/frames")
    total, starts = 0, []
    for r in sorted(index.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()):  # one row a file range
        starts.append((r["part"], total))
        total += r["n"]
    starts = spark.createDataFrame(starts or [(0, 0)], "part int, _before long")
    out = index.join(F.broadcast(starts), "part").withColumn("start", F.col("first") + F.col("_before")).drop("_before")
    return out.withColumn("folder", F.lit(folder))


def _opened(batches: Iterator[pa.RecordBatch], table) -> Iterator[tuple[dict, Frame, Table]]:
    shared = Table.from_bytes(table.value)
    handle, at = None, None
    try:
        for batch in batches:
            for row in batch.to_pylist():
                if at != (row["folder"], row["file"]):
                    if handle is not None:
                        handle.close()
                    fs, base = located(row["folder"])
                    at, handle = (row["folder"], row["file"]), fs.open_input_file(f"{base}/{row['file']}")
                yield row, Frame(handle.read_at(row["size"], row["at"])), shared
    finally:
        if handle is not None:
            handle.close()


def _shared_table(index: DataFrame, folder: str):
    fs, base = located(folder)
    with fs.open_input_file(f"{base}/table.bin") as f:
        return index.sparkSession.sparkContext.broadcast(f.read())


def _spread(index: DataFrame) -> DataFrame:
    """Frames dealt to tasks, some to each, neighbours of a file together."""
    tasks = max(index.sparkSession.sparkContext.defaultParallelism, index.count() // 16)
    return index.repartition(tasks, "file", F.floor(F.col("start") / (FRAME * 4)))


def read_tokens(spark: SparkSession, folder: str, ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian 32-bit numbers), and with ids those bytes, of every document in the folder's files."""
    index = read_index(spark, folder)
    table = _shared_table(index, folder)
    kinds = {"doc_id": pa.int64(), "start": pa.int64(), "n_tokens": pa.int64(), "ids_crc32": pa.int64()} | ({"ids": pa.binary()} if ids else {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, frame, shared in _opened(batches, table):
            raw = frame.ids(shared).astype("<u4").tobytes()
            ends = np.cumsum(frame.lengths)
            starts = ends - frame.lengths
            parts = [raw[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist())]
            cols = [frame.doc_ids, starts + row["start"], frame.lengths, [zlib.crc32(p) for p in parts], *([parts] if ids else [])]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds.values())], names=list(kinds))

    return _spread(index).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * ids)


def read_span(spark: SparkSession, folder: str, start: int, stop: int) -> DataFrame:
    """Ids from place start to stop of the whole stream, as rows (start, ids): only the blocks that hold them are decoded."""
    index = read_index(spark, folder)
    table = _shared_table(index, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, frame, shared in _opened(batches, table):
            a, b = max(start - row["start"], 0), min(stop - row["start"], row["n_ids"])
            yield pa.RecordBatch.from_arrays([pa.array([row["start"] + a]), pa.array([frame.ids(shared, a, b).tolist()], pa.list_(pa.int64()))], names=["start", "ids"])

    wanted = index.where((F.col("start") < stop) & (F.col("start") + F.col("n_ids") > start))
    return _spread(wanted).mapInArrow(run, "start long, ids array<long>")


def default_tokenizer(name: str = "word_bpe_49k.json") -> str:
    """Where the installed package of public tokenizers keeps a file."""
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))
