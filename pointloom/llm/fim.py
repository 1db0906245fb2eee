"""Fill-in-middle transformation of documents.

The tokenizers library's Split pre-tokenizer, with isolated matches of a
regular expression and without any training, gives the code-point offsets of a
text's units. How many there are is n; two ranked offsets cut prefix, middle
and suffix. A space is a unit of its own, so a text is pre-tokenized word by
word, and a word seen before keeps its offsets: a text's offset array is held
as its words' arrays, shifted by where the words begin.

Cuts and forms depend on the document's id alone (first digest groups of
`epoch:id`), so a rerun after a lost executor gives the same output.

Edge cases: a null or empty text has n = 0 and is plain with empty output; a
text that holds a sentinel is plain; a null id counts as the empty one; equal
rows are separate documents; an empty table gives an empty result; other
columns are not read. Memory: one batch of texts and MEMO words a worker.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.llm.common import map_rows

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNIT = "[A-Za-z]+|[^A-Za-z]"
#: Words whose offsets a worker keeps, and the longest such word.
MEMO, LONGEST = 300_000, 64


class Units:
    """Units of texts by a Split pre-tokenizer; pattern must make every space a unit of its own."""

    def __init__(self, pattern: str = UNIT):
        from tokenizers import Regex, pre_tokenizers

        self.split = pre_tokenizers.Split(Regex(pattern), "isolated").pre_tokenize_str
        self.memo: dict[str, tuple[int, ...]] = {}

    def _offsets(self, word: str) -> tuple[int, ...]:
        found = tuple([span[0] for _, span in self.split(word)])
        if len(word) <= LONGEST:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.memo[word] = found
        return found

    def of(self, text: str) -> Offsets:
        words, get = text.split(" "), self.memo.get
        found = [get(w) for w in words]
        for i, starts in enumerate(found):
            if starts is None:
                found[i] = get(words[i]) or self._offsets(words[i])
        return Offsets(words, found)


class Offsets:
    """The offset array of a text, as its words' arrays: `n` units, and the place where any unit begins."""

    def __init__(self, words: list[str], starts: list[tuple[int, ...]]):
        self.words, self.starts = words, starts
        self.before = list(accumulate((len(s) + 1 for s in starts), initial=0))  # units before each word; a space follows each but the last
        self.n = self.before[-1] - 1

    def at(self, *units: int) -> list[int]:
        """Code points before each of these units; before unit n lies the whole text."""
        places = list(accumulate((len(w) + 1 for w in self.words), initial=0))
        out = []
        for unit in units:
            i = bisect_right(self.before, unit) - 1
            rest = unit - self.before[i]
            out.append(places[i] + (self.starts[i][rest] if rest < len(self.starts[i]) else len(self.words[i])))
        return out


def draws(doc_id: int | None, epoch: int = 1) -> tuple[int, int, int, int]:
    """Four 32-bit numbers of a document, read off the digest of `epoch:id`."""
    digest = hashlib.sha256(f"{epoch}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12))


def fill_in_middle(docs: DataFrame, middle_percent: int = 90, spm_percent: int = 20, epoch: int = 1, pattern: str = UNIT) -> DataFrame:
    """One row per document: doc_id, n, form (plain, psm or spm), prefix_chars, middle_chars (null if plain) and output, the transformed text."""
    made: list[Units] = []

    def run(cols: dict[str, list]) -> dict[str, list]:
        units = made[0] if made else (made.append(Units(pattern)) or made[0])
        out: dict[str, list] = {name: [] for name in ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output")}
        for doc_id, text in zip(cols["doc_id"], cols["text"]):
            text = text or ""
            offsets = units.of(text)
            n = offsets.n
            one, two, kind, order = draws(doc_id, epoch)
            if not text or kind % 100 >= middle_percent or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)):
                row = (doc_id, n, "plain", None, None, text)
            else:
                a, b = offsets.at(*sorted((one % (n + 1), two % (n + 1))))
                if order % 100 < spm_percent:
                    form, whole = "spm", f"{SUFFIX}{text[b:]}{PREFIX}{text[:a]}{MIDDLE}{text[a:b]}"
                else:
                    form, whole = "psm", f"{PREFIX}{text[:a]}{SUFFIX}{text[b:]}{MIDDLE}{text[a:b]}"
                row = (doc_id, n, form, a, b - a, whole)
            for values, value in zip(out.values(), row):
                values.append(value)
        return out

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_rows(rows, run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: str | Column = "output", form: str | Column = "form") -> Column:
    """The text before the transformation. No part holds a sentinel, so the first of each is the one that was put in."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    p, s, m = (F.instr(output, mark) for mark in (PREFIX, SUFFIX, MIDDLE))
    end = F.length(output) + 1
    cut = lambda start, stop: F.substring(output, start + 3, stop - start - 3)  # noqa: E731  what follows the sentinel at start
    psm = F.concat(cut(p, s), cut(m, end), cut(s, m))
    spm = F.concat(cut(p, m), cut(m, end), cut(s, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
