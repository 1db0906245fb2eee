"""Document fingerprints: a Merkle tree over paragraphs and sections.

A text is cut into paragraphs (lines; long lines further at sentence ends and,
past those, after words picked by their hash), paragraphs into sections (after
an empty line or a paragraph picked by its hash), so both cuts depend on the
content alone and an edit stays local. A paragraph's node is the hash of its
bytes, a section's that of its paragraphs' nodes, the root's that of the
sections' nodes and the whole text. The fingerprint writes the tree as

    root|section=paragraph.length,paragraph.length;section=...

Two fingerprints with one root are of equal texts. Otherwise sections with
equal nodes match as wholes, and only differing branches are compared by
paragraph; likeness is the matched share of both texts' characters.

Edge cases: a null text counts as empty; the empty text has a root and no
sections; documents are ordered by descending id, null ids last, equal ids by
text hash, and the one after the last is the first; a lone document is its own
next.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.llm.common import short_batches

#: Characters of a paragraph beyond which it is cut further.
LONG = 120
_SENTENCE = re.compile(r"[^.!?]*(?:[.!?]+\s*|$)")
_WORD = re.compile(r"\S*\s*")
#: One paragraph in so many ends a section.
SECTION = 8


def paragraphs(text: str) -> list[str]:
    """The text cut into paragraphs; joined they are the text."""
    out = []
    for line in re.findall(r"[^\n]*\n|[^\n]+", text):
        if len(line) <= LONG:
            out.append(line)
            continue
        for sentence in _SENTENCE.findall(line):
            if len(sentence) <= LONG:
                out += [sentence] if sentence else []
                continue
            piece: list[str] = []
            for word in _WORD.findall(sentence):
                piece.append(word)
                if word and zlib.crc32(word.encode()) % 8 == 0:
                    out.append("".join(piece))
                    piece = []
            if any(piece):
                out.append("".join(piece))
    return out


def _node(data: bytes, size: int) -> str:
    return hashlib.blake2b(data, digest_size=size).hexdigest()


def fingerprint(text: str) -> str:
    sections, current, inner = [], [], []

    def close():
        sections.append(f"{_node(''.join(inner).encode(), 6)}={','.join(current)}")
        current.clear(), inner.clear()

    for p in paragraphs(text):
        node = _node(p.encode(), 5)
        current.append(f"{node}.{len(p)}")
        inner.append(node)
        if p == "\n" or int(node, 16) % SECTION == 0:
            close()
    if current:
        close()
    body = ";".join(sections)
    return f"{_node(body.encode() + b'|' + text.encode(), 16)}|{body}"


def _branches(fp: str) -> tuple[str, list[tuple[str, list[tuple[str, int]]]]]:
    root, _, body = fp.partition("|")
    out = []
    for section in body.split(";") if body else []:
        node, _, leaves = section.partition("=")
        out.append((node, [(leaf[:10], int(leaf[11:])) for leaf in leaves.split(",")]))
    return root, out


def differing(a: str, b: str) -> tuple[list[tuple[str, int]], list[tuple[str, int]], int]:
    """Paragraphs (node, length) of each fingerprint without a match in the other, and the characters matched."""
    (root_a, left), (root_b, right) = _branches(a), _branches(b)
    if root_a == root_b:
        return [], [], sum(n for _, ps in left for _, n in ps)
    whole = Counter(node for node, _ in left) & Counter(node for node, _ in right)
    matched, rest = 0, []
    for side, sections in enumerate((left, right)):
        todo, open_ = Counter(whole), []
        for node, leaves in sections:
            if todo[node] > 0:
                todo[node] -= 1
                matched += sum(n for _, n in leaves) * (side == 0)
            else:
                open_ += leaves
        rest.append(open_)
    common = Counter(rest[0]) & Counter(rest[1])
    matched += sum(n * k for (_, n), k in common.items())
    return list((Counter(rest[0]) - common).elements()), list((Counter(rest[1]) - common).elements()), matched


def likeness(a: str, b: str) -> float:
    """1 for equal texts; else the share of both texts' characters in matching paragraphs."""
    if a.partition("|")[0] == b.partition("|")[0]:
        return 1.0
    only_a, only_b, matched = differing(a, b)
    total = 2 * matched + sum(n for _, n in only_a) + sum(n for _, n in only_b)
    return 2 * matched / total if total else 0.0


def edited(text: str, following: str) -> str:
    """The last half of the text's characters replaced by the first as many, or all, of the following one."""
    k = len(text) // 2
    return text[: len(text) - k] + following[:k]


def neighbours(docs: DataFrame, rows_per_range: int = 256, most_ranges: int = 65536) -> tuple[DataFrame, int]:
    """docs dealt into ranges of descending ids, each followed by the first row of the next range.

    Columns: part, look (1: only looked at), back (descending order of ids), h, doc_id, text. One shuffle of the texts."""
    rows = short_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").select(
        F.coalesce(F.bitwise_not("doc_id"), F.lit((1 << 63) - 1)).alias("back"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), "doc_id", "text"
    )
    seen = rows.agg(F.count("*").alias("n"), F.min("back").alias("low")).first()
    ranges = int(min(most_ranges, max(1, -(-seen["n"] // rows_per_range))))
    starts = np.zeros(0, np.int64)
    if seen["n"]:
        share = [i / ranges for i in range(1, ranges)]
        cuts = rows.agg(F.percentile_approx("back", share or [0.5], max(10_000, 20 * ranges)).alias("c")).first()["c"] if ranges > 1 else []
        starts = np.unique(np.array([seen["low"], *cuts], np.int64))  # each range starts at a row's value: at most most_ranges numbers
    shared = docs.sparkSession.sparkContext.broadcast(starts)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = shared.value
        for batch in batches:
            back = batch.column(0).to_numpy()
            part = np.searchsorted(first, back, side="right") - 1
            yield _dealt(batch, part, 0)
            ahead = np.flatnonzero(first[part] == back)  # starts a range: the one before looks at it, the last one at the first
            if len(ahead):
                yield _dealt(batch.take(pa.array(ahead)), (part[ahead] - 1) % len(first), 1)

    return rows.mapInArrow(deal, "part int, look byte, back long, h long, doc_id long, text string"), len(starts)


def _dealt(batch: pa.RecordBatch, part: np.ndarray, look: int) -> pa.RecordBatch:
    cols = [pa.array(part.astype(np.int32)), pa.array(np.full(batch.num_rows, look, np.int8)), *(batch.column(i) for i in range(4))]
    return pa.RecordBatch.from_arrays(cols, names=["part", "look", "back", "h", "doc_id", "text"])


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row with the one after it; a row is held until then."""
    held = None  # (part, doc_id, text, fingerprint)
    out: list[tuple] = []

    def emit():
        cols = list(zip(*out)) or [[]] * 7
        out.clear()
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    for batch in batches:
        for part, look, doc_id, text in zip(*(batch.column(i) for i in (0, 1, 4, 5))):
            part, look, doc_id, text = part.as_py(), look.as_py(), doc_id.as_py(), text.as_py() or ""
            if held is None or held[0] != part:
                held = None
                if look:
                    continue  # the rest of what is looked at: only its first row is next to anything
            fp = fingerprint(text)
            if held is not None:
                new = edited(held[2], text)
                efp = fingerprint(new)
                out.append((held[1], len(held[2]), hashlib.sha256(new.encode()).hexdigest(), held[3], efp, likeness(held[3], efp), likeness(held[3], fp)))
            held = None if look else (part, doc_id, text, fp)
            if len(out) >= 256:
                yield emit()
    if out:
        yield emit()


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """One row per document: its and its edited text's fingerprint, and likeness to the edited and the next text."""
    rows, _ = neighbours(docs)
    return (
        rows.repartition("part").sortWithinPartitions("part", "look", "back", "h")
        .mapInArrow(_walk, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    )
