"""Mixing sources to target weights by hierarchical budgeting.

The tree is root - domain - language - source. Capacities (available tokens
times most_epochs) are summed upwards; the token budget then flows downwards.
Among the children of one parent it is split by weight, and what a child
cannot use goes to its siblings by weight (water filling in closed form over
the children ordered by capacity per weight), so a shortage leaves a subtree
only when all of it is exhausted. Each leaf is read in seeded epochs: whole
epochs first, then the token-prefix of the next epoch's order. The prefix is
found with running sums inside hash buckets and over the buckets' totals, so
no leaf has to fit in one task.

Only DataFrame operations are used. Edge cases: a null domain, lang or source
is its own child named by `(none)`; null and empty texts have no tokens and
are never selected; a weight missing in `weights` is 1, a null, NaN or negative one
0; shares are rounded down to whole tokens; equal rows are separate documents; the last document of a prefix may be
taken in part (take_tokens < n_tokens); an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointloom.llm.common import stored

NONE = "(none)"


def n_tokens(text: Column) -> Column:
    """Number of runs of characters other than \\x20 and \\x09-\\x0D."""
    flat = F.trim(F.translate(text, "\t\n\x0b\f\r", "     "))
    return F.coalesce(F.when(flat == "", 0).otherwise(F.length(F.regexp_replace(flat, "[^ ]+ *", "x"))), F.lit(0)).cast("long")


def domain_of(source: Column, domains: int = 4) -> Column:
    """The domain of a source where the table has none: its digest's class."""
    return F.concat(F.lit("d"), (F.conv(F.substring(F.md5(source), 1, 4), 16, 10).cast("long") % domains).cast("string"))


def water_fill(children: DataFrame, parent: list[str], budget: str) -> DataFrame:
    """Adds `got`: the whole tokens each child gets of its parent's budget, by weight within its cap.

    With children in order of cap / weight, those before some point get their cap and the others share the rest by weight."""
    order = Window.partitionBy(*parent).orderBy(F.col("_level"), *[c for c in ("domain", "lang", "source") if c in children.columns])
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    c = children.withColumn("_level", F.when(F.col("weight") > 0, F.col("cap") / F.col("weight")).otherwise(F.lit(float("inf"))))
    c = c.withColumn("_left", F.col(budget) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
    c = c.withColumn("_share", F.col("_left") * F.col("weight") / F.sum("weight").over(rest))
    fits = (F.col("weight") > 0) & (F.col("cap") <= F.col("_share"))
    # once one child's share is below its cap, so is that of every later one: all of them share by the same level
    c = c.withColumn("_full", F.min(F.when(fits, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    whole = Window.partitionBy(*parent)
    c = c.withColumn("_spent", F.sum(F.when(F.col("_full") == 1, F.col("cap")).otherwise(0)).over(whole)).withColumn("_open", F.sum(F.when(F.col("_full") == 0, F.col("weight")).otherwise(0.0)).over(whole))
    part = F.floor((F.col(budget) - F.col("_spent")) * F.col("weight") / F.col("_open"))
    got = F.when(F.col("_full") == 1, F.col("cap")).when((F.col("weight") > 0) & (F.col("_open") > 0), F.least(F.col("cap"), part)).otherwise(0)
    return c.withColumn("got", F.coalesce(got, F.lit(0)).cast("long")).drop("_level", "_left", "_share", "_full", "_spent", "_open")


def leaf_budgets(leaves: DataFrame, budget: float, weights: dict[str, float], most_epochs: int = 4) -> DataFrame:
    """leaves (domain, lang, source, tokens, rows) with `got`, the tokens each leaf is to give.

    budget: tokens if over 1, else a share of all tokens. weights: by child name, at any level."""
    given = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v if v is not None and v == v and v > 0 else 0)))]) if weights else None
    weight = lambda name: F.coalesce(given[F.col(name)], F.lit(1.0)) if given is not None else F.lit(1.0)
    open_ = F.lit(True)
    for name in ("domain", "lang", "source"):
        open_ = open_ & (weight(name) > 0)
    caps = leaves.withColumn("cap", F.when(open_, F.col("tokens") * most_epochs).otherwise(0))
    domains = caps.groupBy("domain").agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens"))
    everything = Window.partitionBy(F.lit(0))  # the domains are few: one row each
    want = F.floor(F.sum("tokens").over(everything) * budget) if budget <= 1 else F.lit(int(budget))
    domains = domains.withColumn("budget", want.cast("long")).withColumn("weight", weight("domain")).withColumn("_root", F.lit(0))
    domains = water_fill(domains, ["_root"], "budget").select("domain", F.col("got").alias("budget"))
    langs = caps.groupBy("domain", "lang").agg(F.sum("cap").alias("cap")).join(domains, "domain").withColumn("weight", weight("lang"))
    langs = water_fill(langs, ["domain"], "budget").select("domain", "lang", F.col("got").alias("budget"))
    return water_fill(caps.join(langs, ["domain", "lang"]).withColumn("weight", weight("source")), ["domain", "lang"], "budget").drop("weight", "budget")


def hash_unit(seed: int, epoch: Column, doc_id: Column, text_hash: Column) -> Column:
    """A seeded place of a document in an epoch's order: 52 bits of an MD5, as a number in [0, 1)."""
    key = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("")), text_hash)
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def mix_sources(docs: DataFrame, budget: float = 0.5, weights: dict[str, float] | None = None, most_epochs: int = 4, seed: int = 17, rows_per_bucket: int = 4096, digest: bool = False) -> DataFrame:
    """Selected (doc_id, domain, lang, source, epoch, n_tokens, take_tokens): each leaf's budget, from seeded epochs.

    digest: adds the digest of the text, by which with_texts finds it."""
    domain = F.col("domain") if "domain" in docs.columns else domain_of(F.coalesce(F.col("source"), F.lit(NONE)))
    rows = docs.select(
        "doc_id", *[F.coalesce(c.cast("string"), F.lit(NONE)).alias(n) for n, c in (("domain", domain), ("lang", F.col("lang")), ("source", F.col("source")))],
        n_tokens(F.col("text")).alias("n_tokens"), F.md5(F.coalesce(F.col("text"), F.lit(""))).alias("_text"),
    ).where("n_tokens > 0")
    rows = stored(rows)  # a few dozen bytes a document; the texts are read once
    leaf = ["domain", "lang", "source"]
    leaves = rows.groupBy(*leaf).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows"))
    plan = leaf_budgets(leaves, budget, weights or {}, most_epochs)
    plan = plan.withColumn("_whole", F.floor(F.col("got") / F.col("tokens")).cast("int")).withColumn("_want", F.col("got") % F.col("tokens"))
    plan = stored(plan.withColumn("_buckets", F.ceil(F.col("rows") / rows_per_bucket)))
    rows = rows.join(plan.select(*leaf, "_whole", "_want", "_buckets"), leaf)  # one row a leaf
    whole = rows.where("_whole > 0").withColumn("epoch", F.explode(F.expr("sequence(0, _whole - 1)"))).withColumn("take_tokens", F.col("n_tokens"))
    unit = hash_unit(seed, F.col("_whole"), F.col("doc_id"), F.col("_text"))
    part = rows.where("_want > 0").withColumn("_u", unit).withColumn("_bucket", F.floor(F.col("_u") * F.col("_buckets")))
    totals = part.groupBy(*leaf, "_bucket").agg(F.sum("n_tokens").alias("_sum"))
    earlier = Window.partitionBy(*leaf).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row for thousands of documents
    starts = totals.withColumn("_start", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).drop("_sum")
    part = part.join(starts, [*leaf, "_bucket"]).where("_start < _want")
    inside = Window.partitionBy(*leaf, "_bucket").orderBy("_u", "doc_id", "_text").rowsBetween(Window.unboundedPreceding, -1)
    part = part.withColumn("_before", F.col("_start") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).where("_before < _want")
    part = part.withColumn("epoch", F.col("_whole")).withColumn("take_tokens", F.least(F.col("n_tokens"), F.col("_want") - F.col("_before")))
    out = ["doc_id", *leaf, F.col("epoch").cast("int").alias("epoch"), "n_tokens", F.col("take_tokens").cast("long").alias("take_tokens"), *([F.col("_text").alias("digest")] if digest else [])]
    return whole.select(*out).unionByName(part.select(*out))


def with_texts(chosen: DataFrame, docs: DataFrame) -> DataFrame:
    """chosen (of mix_sources over docs) with each row's text, cut after take_tokens tokens where the document is taken in part.

    Texts are matched by id and digest, rows of equal id and text once; one shuffle of the texts."""
    digest = F.md5(F.coalesce("text", F.lit("")))
    texts = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit(NONE)).alias("_id"), digest.alias("_digest"), "text").dropDuplicates(["_id", "_digest"])
    rows = chosen.withColumn("_id", F.coalesce(F.col("doc_id").cast("string"), F.lit(NONE))).withColumnRenamed("digest", "_digest")
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    cut = F.when(F.col("take_tokens") < F.col("n_tokens"), F.array_join(F.slice(words, 1, F.col("take_tokens").cast("int")), " ")).otherwise(F.col("text"))
    return rows.join(texts, ["_id", "_digest"]).withColumn("text", cut).drop("_id", "_digest")
