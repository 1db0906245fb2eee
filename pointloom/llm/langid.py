"""Language identification by words first, backing off to shorter character n-grams.

Fit: per language, log relative frequencies of words and of character n-grams
of padded words, from a bounded sample of labelled rows (about per_lang rows of
each language, picked by the hash of id and text; the model keeps the top_words
words and top_grams n-grams of each language). Score: a known word adds its log
frequencies; an unseen word adds the mean of its longest known n-grams. The
best total wins, of equal ones the first language by name; the score is its
softmax share.

Edge cases: null texts and texts without a letter give `und` with score 0;
without any labelled row every text is `und`; rows with null lang or text are
not learned from; rows without id are learned from and predicted like others
and never held out; equal rows give equal results; ids and other columns are
never inputs of a prediction.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointloom.llm.common import ROWS, held_out, map_rows, short_batches

LONGEST = 5
#: Words whose rows a scorer keeps before it starts anew.
_CACHE_MOST = 50_000


def words_of(text: str) -> list[str]:
    return text.lower().split()


def grams_of(word: str, n: int) -> list[str]:
    padded = f"^{word}$" if n > 1 else word
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, n, gram, count) of the words (n = 0) and n-grams of a partition's part of the sample, each once."""
    words: dict[str, Counter] = {}
    for batch in batches:
        for name, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words.setdefault(name, Counter()).update(w for w in words_of(t) if any(c.isalpha() for c in w))
    for name, counts in words.items():
        for n in range(LONGEST + 1):
            grams = counts
            if n:
                grams = Counter()
                for w, k in counts.items():
                    for g in grams_of(w, n):
                        grams[g] += k
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(grams), pa.string()), pa.array([n] * len(grams), pa.int32()), pa.array(list(grams), pa.string()), pa.array(list(grams.values()), pa.int64())], names=["lang", "n", "gram", "k"]
            )


class Model:
    """Log frequencies of words and n-grams: tables of places (n = 0: words) in one matrix of a row each, a column a language."""

    def __init__(self, rows: Sequence[tuple[str, int, str, int]]):
        self.langs = sorted({r[0] for r in rows})
        at = {name: i for i, name in enumerate(self.langs)}
        totals = np.ones((LONGEST + 1, len(self.langs)))
        self.tables: list[dict[str, int]] = [{} for _ in range(LONGEST + 1)]
        kinds: list[int] = []
        for lang, n, gram, k in rows:
            totals[n, at[lang]] += k
            if gram not in self.tables[n]:
                self.tables[n][gram] = len(kinds)
                kinds.append(n)
        self.values = np.full((len(kinds), len(self.langs)), 0.3)
        for lang, n, gram, k in rows:
            self.values[self.tables[n][gram], at[lang]] += k
        self.values = np.log(self.values / totals[kinds]) if kinds else self.values

    def places(self, word: str) -> list[int]:
        """The matrix rows whose mean is the word's: its own, or those of its longest known n-grams."""
        known = self.tables[0].get(word)
        if known is not None:
            return [known]
        padded = f"^{word}$"
        for n in range(min(LONGEST, len(padded)), 0, -1):
            table, text = self.tables[n], padded if n > 1 else word
            hits = [p for i in range(len(text) - n + 1) if (p := table.get(text[i : i + n])) is not None]
            if hits:
                return hits
        return []


def fit(docs: DataFrame, per_lang: int = 1500, top_words: int = 8000, top_grams: int = 3000) -> Model:
    """A model of bounded size from about per_lang labelled rows of each language, all if there are fewer; held-out rows are not used.

    A row is taken if the hash of its id and text falls under its language's share, so no language is one task's work."""
    rows = docs.select("doc_id", "lang", "text").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    shares = rows.groupBy("lang").agg((F.lit(float(per_lang)) / F.count("*")).alias("_share"))  # one row a language
    place = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 11).cast("double") / float(1 << 53)
    chosen = rows.join(F.broadcast(shares), "lang").where(place < F.col("_share")).select("lang", "text")
    counts = chosen.mapInArrow(_counts, "lang string, n int, gram string, k long").groupBy("lang", "n", "gram").agg(F.sum("k").alias("k"))
    best = Window.partitionBy("lang", "n").orderBy(F.desc("k"), "gram")  # over the sample's vocabulary
    top = counts.withColumn("_at", F.row_number().over(best)).where(F.col("_at") <= F.when(F.col("n") == 0, top_words).otherwise(top_grams))
    table = top.select("lang", "n", "gram", "k").orderBy("lang", "n", "gram").toArrow()
    return Model(list(zip(*(column.to_pylist() for column in table.columns))))


class Scorer:
    """Scores texts with a model; keeps the rows of recent words, up to a bound."""

    def __init__(self, model: Model):
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.at: dict[str, int] = {}
        self.rows = np.zeros((1024, len(self.model.langs)))
        self.new: list[list[int]] = []  # places of the words seen last, whose rows are not set yet

    def _add(self, word: str) -> int:
        self.at[word] = i = len(self.at)
        self.new.append(self.model.places(word))
        return i

    def _settle(self) -> None:
        """Sets the rows of new words, all at once."""
        first = len(self.at) - len(self.new)
        while len(self.rows) < len(self.at):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        count = np.array([len(p) for p in self.new])
        self.rows[first : len(self.at)] = 0
        some = np.flatnonzero(count)
        if len(some):
            flat = np.fromiter((p for ps in self.new for p in ps), np.int64, int(count.sum()))
            starts = (np.cumsum(count) - count)[some]
            self.rows[first + some] = np.add.reduceat(self.model.values[flat], starts, axis=0) / count[some, None]
        self.new = []

    def score(self, text: str | None) -> tuple[str, float]:
        if not text or not self.model.langs or not any(map(str.isalpha, text)):
            return "und", 0.0
        if len(self.at) > _CACHE_MOST:
            self._forget()
        get, add = self.at.get, self._add
        ids = [i if (i := get(w)) is not None else add(w) for w in words_of(text)]
        if self.new:
            self._settle()
        total = self.rows[ids].sum(axis=0)
        best = int(total.argmax())
        return self.model.langs[best], float(1.0 / np.exp(np.clip(total - total[best], -700, 0)).sum())


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by fit's parameters
    state: dict[str, Scorer] = {}

    def run(rows: dict[str, list]) -> dict[str, list]:
        if "s" not in state:
            state["s"] = Scorer(shared.value)
        found = [state["s"].score(t) for t in rows["text"]]
        return {"doc_id": rows["doc_id"], "held_out": rows["held_out"], "lang_pred": [f[0] for f in found], "score": [f[1] for f in found]}

    return map_rows(docs.select("doc_id", held_out().alias("held_out"), "text"), run, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """docs without the rows whose language is undetermined or whose score is under least; lang becomes the prediction.

    Rows and other columns are otherwise unchanged. The texts go through Python once."""
    shared = short_batches(docs).sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    text, lang = names.index("text"), names.index("lang")
    state: dict[str, Scorer] = {}

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if "s" not in state:
            state["s"] = Scorer(shared.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                found = [state["s"].score(t) for t in part.column(text).to_pylist()]
                columns = [*part.columns]
                columns[lang] = pa.array([name for name, _ in found], part.column(lang).type)
                yield pa.RecordBatch.from_arrays(columns, schema=part.schema).filter(pa.array([name != "und" and score >= least for name, score in found], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
