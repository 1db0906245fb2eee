"""N-gram Jaccard join by grouped prefixes.

A document's set holds the hashes of its distinct `n`-word shingles. Sets are
ordered by commonness: shingles that few documents share go first, by hash, the
others follow by count, so prefixes hold rare ones. Two sets with Jaccard similarity of at least t share
an element of their prefixes (size - ceil(t * size) + 1 elements).

1. Equal sets collapse to classes, classes with equal prefix and size to
   groups (the join's unit).
2. Group pairs come from the prefix elements' lists. In a first pass every
   group of a list is paired with the list's least group only, and every class
   of a group with the group's least class, which is linear in the lists.
   Verified pairs make provisional components.
3. In further passes only lists that hold several components matter: the
   classes of one component are paired with another component's least class
   there. The last pass takes all pairs across components that pass the size,
   sketch and count filters, so no link that could join components is missed.
4. Pairs also pass two filters before their texts are fetched. Each set has
   BITS parity bits, and two sets differ in at least as many elements as in
   bits, so too many differing bits rule a pair out for certain. In the last
   pass the number of prefix elements that a pair shares bounds its overlap.
5. Verification computes both whole sets from the texts.

Exactness: links inside one component may stay unseen, links between two
components may not, so components equal those of all links.

Edge cases: null and empty texts have empty sets and link with nothing; fewer
words than n make one shingle of all; rows without id are left out and of rows
that share an id the least text stays; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.llm.common import ROWS, dropped, gram_hashes, mix64, stored, word_hashes
from pointloom.operators.components import components
from pointloom.llm.repeats import one_text

#: Ids up to which a table of ids may be broadcast as a filter (4 MB of longs); beyond, it is a shuffled join.
MANY_IDS = 500_000
#: Parity bits of a set's sketch, 64 to a column.
BITS = 512
SKETCH = [f"k{i}" for i in range(BITS // 64)]


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of n words, A-Z in lower case."""
    if not text:
        return np.zeros(0, np.uint64)
    words = word_hashes(text.encode().lower())[2]
    if not len(words):
        return words
    return np.unique(gram_hashes(words, min(n, len(words))))


def _common(n: int, least: int):
    """(hash, count) of the shingles that at least `least` differing sets of a batch hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = {s.tobytes(): s for s in (shingles(t, n) for t in batch.column(0).to_pylist()) if len(s)}
            if not sets:
                continue
            value, count = np.unique(np.concatenate(list(sets.values())), return_counts=True)
            many = count >= least
            yield pa.RecordBatch.from_arrays([pa.array(value[many].view(np.int64)), pa.array(count[many].astype(np.int64))], names=["h", "k"])

    return run


def common_shingles(rows: DataFrame, n: int, least: int = 2, most: int = 200_000) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of largest counts over all documents, as many levels of count as hold `most` at the most; sorted, with their ranks by count.

    This only sets an order, so the bounds cost no links."""
    counts = stored(rows.select("text").mapInArrow(_common(n, least), "h long, k long").groupBy("h").agg(F.sum("k").alias("k")).withColumn("level", F.floor(8 * F.log2("k")).cast("int")))
    lowest, total = None, 0
    for level, size in sorted(counts.groupBy("level").count().collect(), reverse=True):  # a few hundred levels
        total += size
        if total > most:
            break
        lowest = level
    top = counts.where(F.col("level") >= F.lit(lowest)).select("h", "k").toArrow()  # at most `most` numbers
    dropped(counts)
    value, k = top.column(0).to_numpy().view(np.uint64), top.column(1).to_numpy()
    by_count = np.lexsort((value, -k))
    rank = np.empty(len(value), np.int64)
    rank[by_count] = np.arange(len(value), 0, -1)
    order = np.argsort(value)
    return value[order], rank[order]


def prefix_length(size: int, num: int, den: int) -> int:
    return size - -(-num * size // den) + 1


def _sets(shared, n: int, num: int, den: int):
    """Per document: size and signature of its set, and its prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, rank = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                out: list[list] = [[], [], [], [], []]
                for text in part.column(1).to_pylist():
                    s = shingles(text, n)
                    p = prefix_length(len(s), num, den) if len(s) else 0
                    at = np.minimum(np.searchsorted(common, s), max(len(common) - 1, 0))
                    last = common[at] == s if len(common) else np.zeros(len(s), bool)
                    prefix = np.concatenate([s[~last], s[last][np.argsort(rank[at[last]], kind="stable")]])[:p]
                    parity = np.packbits(np.bincount((s >> np.uint64(40)).astype(np.int64) % BITS, minlength=BITS) & 1).view(np.int64)
                    for into, x in zip(out, (len(s), int(mix64(s).sum().view(np.int64)), int((mix64(s ^ np.uint64(0x5851F42D4C957F2D)) | np.uint64(1)).sum().view(np.int64)), prefix.view(np.int64), parity)):
                        into.append(x)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.list_(pa.int64())), pa.array(out[4], pa.list_(pa.int64()))], names=["doc", "size", "s1", "s2", "prefix", "parity"]
                )

    return run


def _verify(n: int, num: int, den: int):
    """Keeps pairs with den * |A & B| >= num * |A | B|; rows come with both texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: tuple = (None, None)
        for batch in batches:
            us, vs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            ok = np.zeros(len(us), bool)
            for i, v in enumerate(vs):
                if memo[0] != v:  # many pairs in a row share their second document
                    memo = (v, shingles(batch.column(3)[i].as_py(), n))
                a, b = shingles(batch.column(2)[i].as_py(), n), memo[1]
                both = len(np.intersect1d(a, b, assume_unique=True))
                ok[i] = both > 0 and den * both >= num * (len(a) + len(b) - both)
            keep = pa.array(ok)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["u", "v"])

    return run


class GroupedPrefixJoin:
    """The join over one table of documents with one row an id: classes, groups, links and components.

    Prefixes are written once, with the sets; what is dealt by element holds only an element and a group."""

    def __init__(self, rows: DataFrame, n: int, num: int, den: int):
        self.rows, self.n, self.num, self.den = rows, n, num, den
        common = rows.sparkSession.sparkContext.broadcast(common_shingles(rows, n))
        sets = rows.mapInArrow(_sets(common, n, num, den), "doc long, size long, s1 long, s2 long, prefix array<long>, parity array<long>")
        self.sets = stored(sets.withColumn("p", F.xxhash64("size", "prefix")))
        common.unpersist()
        self.classes = stored(self.sets.where("size > 0").groupBy("size", "s1", "s2").agg(F.min("doc").alias("cls"), F.min("p").alias("p")))
        groups = self.classes.groupBy("size", "p").agg(F.min("cls").alias("grp"))
        bits = [F.col("parity")[i].alias(k) for i, k in enumerate(SKETCH)]
        placed = self.classes.join(groups, ["size", "p"]).select("cls", "grp", "size")
        self.members = stored(placed.join(self.sets.select(F.col("doc").alias("cls"), *bits), "cls"))
        leaders = self.members.where("cls = grp").select(F.col("grp").alias("doc"))
        lists = self.sets.join(leaders, "doc", "left_semi").select(F.explode("prefix").alias("h"), F.col("doc").alias("grp"))
        least = lists.groupBy("h").agg(F.min("grp").alias("lead"), F.count("*").alias("k")).where("k > 1").select("h", "lead")
        self.lists = stored(lists.join(least, "h").select("h", "grp", "lead"))

    def fits(self, a: str, b: str):
        """Sizes that similarity allows."""
        return (F.col(a) * self.den >= F.col(b) * self.num) & (F.col(b) * self.den >= F.col(a) * self.num)

    def alike(self, a: list, b: list, na, nb):
        """Few enough differing parity bits: at most as many as similar sets of these sizes may differ in elements."""
        differing = sum((F.bit_count(x.bitwiseXOR(y)) for x, y in zip(a[1:], b[1:])), F.bit_count(a[0].bitwiseXOR(b[0])))
        return differing <= na + nb - 2 * F.ceil((na + nb) * self.num / (self.num + self.den))

    def sketched(self, pairs: DataFrame) -> DataFrame:
        """The pairs (u, v) that sizes and sketches allow."""
        side = lambda c: self.members.select(F.col("cls").alias(c), F.col("size").alias(f"n{c}"), *[F.col(k).alias(f"{c}{k}") for k in SKETCH])
        both = pairs.join(side("u"), "u").join(side("v"), "v")
        return both.where(self.fits("nu", "nv") & self.alike([F.col(f"u{k}") for k in SKETCH], [F.col(f"v{k}") for k in SKETCH], F.col("nu"), F.col("nv"))).select("u", "v")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs (u, v) of classes that are linked."""
        ids = pairs.select(F.col("u").alias("doc_id")).union(pairs.select(F.col("v").alias("doc_id"))).distinct()
        ids = stored(ids)
        self.scratch.append(ids)
        texts = self.rows.join(F.broadcast(ids) if ids.count() <= MANY_IDS else ids, "doc_id", "left_semi")
        left = texts.select(F.col("doc_id").alias("u"), F.col("text").alias("tu"))
        right = texts.select(F.col("doc_id").alias("v"), F.col("text").alias("tv"))
        return pairs.join(left, "u").join(right, "v").select("u", "v", "tu", "tv").mapInArrow(_verify(self.n, self.num, self.den), "u long, v long")

    def first_pairs(self) -> DataFrame:
        stars = self.lists.where("grp <> lead").select(F.col("grp").alias("u"), F.col("lead").alias("v")).distinct()
        inner = self.members.where("cls <> grp").select(F.col("cls").alias("u"), F.col("grp").alias("v"))
        return self.sketched(stars.unionByName(inner))

    def mixed_lists(self, found: DataFrame) -> DataFrame:
        """Element lists by class with components, of elements whose list holds more than one; comp of an unlinked class is itself."""
        known = self.members.join(found.withColumnRenamed("node", "cls"), "cls", "left").select("cls", "grp", "size", F.coalesce("component", "cls").alias("comp"))
        by_group = self.lists.select("h", "grp").join(known, "grp")
        many = self.members.groupBy("grp").count().where("count > 1").select("grp")  # a group of several classes is a list of its own
        inside = known.join(many, "grp", "left_semi").withColumn("h", F.xxhash64(F.lit("group"), "grp"))
        by_group = by_group.unionByName(inside.select(*by_group.columns))
        span = by_group.groupBy("h").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("h")
        return by_group.join(span, "h", "left_semi")

    def star_pairs(self, lists: DataFrame) -> DataFrame:
        """Every component's least class in a list against the classes of the list's least component, and the other way round."""
        heads = lists.groupBy("h", "comp").agg(F.min(F.struct("cls", "size")).alias("head"))
        lead = heads.groupBy("h").agg(F.min(F.struct("comp", "head")).alias("lead"))
        a = lists.join(lead, "h").where("comp <> lead.comp").select(F.col("cls").alias("u"), F.col("lead.head.cls").alias("v"), "size", F.col("lead.head.size").alias("other"))
        return self.sketched(a.where(self.fits("size", "other")).select("u", "v").distinct())

    def cross_pairs(self, lists: DataFrame) -> DataFrame:
        """All pairs of classes of different components that share enough elements of their prefixes.

        Of two prefixes, the one that ends first in the order of elements holds all it shares with the other set up to
        there, so the shared elements and its own rest bound the overlap; classes of one group share their prefix."""
        lists = lists.join(self.members.select("cls", *SKETCH), "cls")
        side = lambda c: lists.select("h", F.col("cls").alias(c), F.col("comp").alias(f"c{c}"), F.col("size").alias(f"n{c}"), F.col("grp").alias(f"g{c}"), *[F.col(k).alias(f"{c}{k}") for k in SKETCH])
        near = self.alike([F.col(f"u{k}") for k in SKETCH], [F.col(f"v{k}") for k in SKETCH], F.col("nu"), F.col("nv"))
        met = side("u").join(side("v"), "h").where((F.col("u") > F.col("v")) & (F.col("cu") != F.col("cv")) & self.fits("nu", "nv") & near)
        shared = met.groupBy("u", "v", "nu", "nv").agg(F.count("*").alias("k"), F.max(F.col("gu") == F.col("gv")).alias("one"))
        need = F.ceil((F.col("nu") + F.col("nv")) * self.num / (self.num + self.den))
        rest = F.ceil(F.greatest("nu", "nv") * self.num / self.den) - 1  # of the larger set, past its prefix
        return shared.where(F.col("one") | (F.col("k") + rest >= need)).select("u", "v")

    def run(self, star_passes: int = 1) -> tuple[DataFrame, DataFrame]:
        """(components, links): components of linked classes, and the links found on the way."""
        self.scratch = []
        tried = stored(self.first_pairs())
        links = stored(self.verified(tried))
        found = components(links)
        for k in range(star_passes + 1):
            lists = stored(self.mixed_lists(found))
            pairs = self.star_pairs(lists) if k < star_passes else self.cross_pairs(lists)
            pairs = stored(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).join(tried.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), ["u", "v"], "left_anti"))
            dropped(lists)
            if pairs.isEmpty():
                continue
            more = stored(self.verified(pairs))
            tried = tried.unionByName(pairs)
            if not more.isEmpty():
                links = links.unionByName(more)
                found = components(links)
        dropped(self.lists, self.members, *self.scratch)
        return found, links

    def classified(self) -> DataFrame:
        """(doc_id, n_shingles, component_id) of every document."""
        found, _ = self.run()
        comp = self.classes.select("size", "s1", "s2", "cls").join(found.withColumnRenamed("node", "cls"), "cls", "left").select("size", "s1", "s2", F.coalesce("component", "cls").alias("component"))
        return self.sets.select("doc", "size", "s1", "s2").join(comp, ["size", "s1", "s2"], "left").select(F.col("doc").alias("doc_id"), F.col("size").alias("n_shingles"), F.coalesce("component", "doc").alias("component_id"))


def jaccard_components(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links of similarity num/den or more)."""
    return GroupedPrefixJoin(one_text(docs), n, num, den).classified()


def keep_one_each(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs with only the document of smallest id of every component; rows without id stay, of equal ids one row stays."""
    kept = jaccard_components(docs, n, num, den).where("doc_id = component_id").select("doc_id")
    with_id = docs.where("doc_id is not null")
    ids = with_id.groupBy("doc_id").count().where("count > 1").limit(1).count()
    if ids:
        cols = [F.min(F.struct("text", *[c for c in docs.columns if c not in ("doc_id", "text")])).alias("_row")]
        with_id = with_id.groupBy("doc_id").agg(*cols).select("doc_id", "_row.*").select(*docs.columns)
    return with_id.join(kept, "doc_id", "left_semi").select(*docs.columns).unionByName(docs.where("doc_id is null"))
