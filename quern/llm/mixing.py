"""Mixing sources to target weights, with DataFrame functions only.

Leaves are (domain, language, source).  A token budget goes down the tree: at each
node it is shared among the children by weight, no child taking more than its
subtree can give (its tokens times ``max_epochs``); what a child cannot take goes to
its siblings by weight, and only what a whole subtree cannot take goes to the
siblings of its root.  A leaf's budget is spent on whole epochs over its documents and
on a prefix of one more, each epoch ordered by a seeded hash.  Where that prefix ends
is found from sums over hash ranges, so no leaf's rows are gathered in one task, and
documents are selected by a look at their leaf's cut alone, without a shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import WORD_CLASS, keep

LEVELS = ("domain", "lang", "source")
#: Rows that a hash range of a leaf has at most, about, and hexadecimal digits of the hash that name a range at least.
RANGE_ROWS, RANGE_DIGITS = 4096, 3
#: Rows of weights that are sent to all executors at most.
BROADCAST_ROWS = 100_000


def tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_CLASS)), F.lit(0)).cast("long")


def order_key(epoch: Column, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))


def budgets(leaves: DataFrame, weights: DataFrame, total: float, max_epochs: int) -> DataFrame:
    """The whole tokens that each leaf (``LEVELS``, ``tokens``) shall give.

    ``weights`` has rows (``LEVELS``, ``weight``), null below the node that is meant;
    other nodes weigh 1.  Weights below 1e-9 count as that.
    """
    few = weights.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    out = leaves.withColumn("cap", F.col("tokens").cast("double") * max_epochs)
    out = out.withColumn("_share", F.lit(float(total)))
    for depth in range(1, len(LEVELS) + 1):
        path, above = LEVELS[:depth], LEVELS[: depth - 1]
        given = weights.filter(" AND ".join([f"{c} IS NOT NULL" for c in path] + [f"{c} IS NULL" for c in LEVELS[depth:]])).groupBy(*path).agg(F.max("weight").alias("_w"))
        nodes = out.groupBy(*path).agg(F.sum("cap").alias("_cap"), F.max("_share").alias("_in"))
        nodes = nodes.join(F.broadcast(given) if few else given, list(path), "left").withColumn("_w", F.greatest(F.coalesce("_w", F.lit(1.0)), F.lit(1e-9)))
        nodes = nodes.withColumn("_full_at", F.col("_cap") / F.col("_w"))
        siblings = Window.partitionBy(*above) if above else Window.partitionBy(F.lit(0))
        by = siblings.orderBy("_full_at", LEVELS[depth - 1])
        spent = F.coalesce(F.sum("_cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        left = F.sum("_w").over(by.rowsBetween(0, Window.unboundedFollowing))
        nodes = nodes.withColumn("_level", (F.col("_in") - spent) / left)
        nodes = nodes.withColumn("_open", F.when(F.col("_full_at") > F.col("_level"), F.struct("_full_at", F.col(LEVELS[depth - 1]).alias("name"), "_level")))
        # the first child that is not filled sets the level for all that are not
        level = F.min("_open").over(siblings)
        nodes = nodes.select(*path, F.when(F.col("_open").isNull(), F.col("_cap")).otherwise(level["_level"] * F.col("_w")).alias("_share"))
        out = out.drop("_share").join(nodes, list(path))
    return out.select(*LEVELS, "tokens", F.floor(F.greatest(F.col("_share"), F.lit(0.0)) + 1e-6).alias("budget"))


def sized(docs: DataFrame, domain: Column) -> DataFrame:
    """``doc_id``, the leaf and ``n_tokens`` (words) of every row; a null level is ``(none)``."""
    name = lambda c: F.coalesce(c.cast("string"), F.lit("(none)"))
    return docs.select("doc_id", name(domain).alias("domain"), name(F.col("lang")).alias("lang"), name(F.col("source")).alias("source"), tokens(F.col("text")).alias("n_tokens"))


def cuts(rows: DataFrame, weights: DataFrame, share: float, max_epochs: int, seed: int) -> DataFrame:
    """For each leaf its ``budget``, ``epochs`` (whole ones), and where the prefix ends: ``cut_key`` and ``cut_tokens``."""
    leaves = rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"))
    leaves = keep(leaves, "leaves")
    there = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    total = min(math.floor(there * share), there * max_epochs)
    plan = budgets(leaves, weights, total, max_epochs).withColumn("epochs", F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(0).cast("long"))
    plan = keep(plan.withColumn("rest", F.col("budget") - F.col("epochs") * F.col("tokens")), "budgets")
    keyed = rows.join(plan.filter("rest > 0").select(*LEVELS, "epochs", "rest"), list(LEVELS)).withColumn("key", order_key(F.col("epochs"), seed))
    digits = max(RANGE_DIGITS, math.ceil(math.log(max(1, rows.count()) / RANGE_ROWS, 16)))
    keyed = keyed.withColumn("range", F.substring("key", 1, digits))
    sums = keyed.groupBy(*LEVELS, "rest", "range").agg(F.sum("n_tokens").alias("n"))
    over = Window.partitionBy(*LEVELS).orderBy("range")
    ends = sums.withColumn("end", F.sum("n").over(over)).withColumn("start", F.col("end") - F.col("n"))
    ends = ends.filter("start < rest AND rest <= end").select(*LEVELS, "range", "start")
    units = keyed.join(ends, [*LEVELS, "range"]).groupBy(*LEVELS, "rest", "start", "key").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("copies"))
    units = units.withColumn("end", F.col("start") + F.sum("n").over(Window.partitionBy(*LEVELS).orderBy("key")))
    last = units.filter("end - n < rest AND rest <= end").select(*LEVELS, F.col("key").alias("cut_key"), F.floor((F.col("rest") - (F.col("end") - F.col("n"))) / F.col("copies")).alias("cut_tokens"))
    return keep(plan.join(last, list(LEVELS), "left"), "cuts")


def select(rows: DataFrame, cut: DataFrame, seed: int) -> DataFrame:
    """A row for each epoch that takes a row of ``rows`` (with ``LEVELS``, ``doc_id``, ``n_tokens``), with ``take_tokens``.

    Rows of one leaf with equal ids go together; if the prefix ends in them, each
    gives an equal whole number of tokens.
    """
    key = order_key(F.col("epochs"), seed)
    more = F.when(key < F.col("cut_key"), F.col("n_tokens")).when(key == F.col("cut_key"), F.least("n_tokens", "cut_tokens"))
    whole = F.transform(F.sequence(F.lit(0).cast("long"), F.col("epochs")), lambda e: F.struct(e.alias("epoch"), F.when(e < F.col("epochs"), F.col("n_tokens")).otherwise(more).alias("take_tokens")))
    joined = rows.join(cut.select(*LEVELS, "epochs", "cut_key", "cut_tokens"), list(LEVELS))
    taken = joined.withColumn("_of", F.explode(F.filter(whole, lambda t: t["take_tokens"].isNotNull())))
    return taken.select(*rows.columns, "_of.epoch", "_of.take_tokens")


def mix(docs: DataFrame, weights: DataFrame, domain: Column, share: float, max_epochs: int = 2, seed: int = 1) -> DataFrame:
    """Rows of ``docs`` (``doc_id``, ``text``, ``lang``, ``source``, any others) that fill the target weights.

    ``share`` of all tokens is the budget; above what ``max_epochs`` can give, all of
    that is taken.  Null levels are leaves named ``(none)``, null and empty texts have
    no tokens; a leaf without tokens gives nothing.  Adds ``domain``, ``n_tokens``,
    ``epoch`` (from 0) and ``take_tokens``, replacing columns of these names.
    """
    rows = keep(sized(docs, domain), "sized")
    cut = cuts(rows, weights, share, max_epochs, seed)
    name = lambda c: F.coalesce(c.cast("string"), F.lit("(none)"))
    kept = {"lang": "_lang", "source": "_source"}
    base = docs.drop("domain", "n_tokens", "epoch", "take_tokens", *kept.values())
    named = base.withColumns({b: F.col(a) for a, b in kept.items()}).withColumns({"domain": name(domain), "lang": name(F.col("lang")), "source": name(F.col("source")), "n_tokens": tokens(F.col("text"))})
    out = select(named, cut, seed)
    return out.drop("lang", "source").withColumnsRenamed({b: a for a, b in kept.items()}).select(*base.columns, "domain", "n_tokens", "epoch", "take_tokens")


def text_prefix(text: Column, n_tokens: Column, take: Column) -> Column:
    """The text, or if not all tokens are taken, its first ones joined by one space."""
    return F.when(take >= n_tokens, text).otherwise(F.array_join(F.slice(F.regexp_extract_all(text, F.lit(WORD_CLASS), F.lit(0)), F.lit(1), F.greatest(take, F.lit(0)).cast("int")), " "))
