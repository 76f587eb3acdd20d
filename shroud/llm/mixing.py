"""Mixing sources to target weights by hierarchical budgeting (operator 5).

Native: DataFrame operations only. Leaves are (domain, language, source). Each
level has relative integer weights; a node's budget is shared among its children
by weight. A child takes at most what its subtree can give (its tokens times
``max_epochs``); what it cannot take goes to its siblings, by their weights, and
only what a whole subtree cannot take goes to the siblings of its parent. Per
level this is water-filling, solved in closed form: with children sorted by
capacity over weight, those that fill up are a prefix, and the rest share the
remainder by weight.

Each leaf then reads whole epochs of its documents and a prefix of one more.
Every epoch has its own seeded order (md5 of seed, epoch and doc_id). Prefixes
are found in two steps so that no leaf is ordered in one task: tokens are summed
per (leaf, first digits of the order key), which settles all documents but those
of one bucket per leaf; only that bucket is ordered by a window.

Tokens are runs of non-space characters (ASCII white space).

Defined results: a null text has no tokens and is never taken; null domain,
language or source values are leaves of their own; a value without a weight gets
``default_weight``; repeated rows are documents of their own, side by side in
the order; a row with a null doc_id takes part; a budget over what all leaves
can give is met as far as they can; an empty table gives no rows; other columns
are kept as they are, with clashing names kept out of the way by the ``mx_``
prefix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shroud.llm.common import materialize, small_side

#: Hexadecimal digits of the order key that make a bucket, coarse and fine: 16 ** 4 buckets a leaf.
BUCKET_DIGITS = (2, 4)
LEVELS = ["mx_domain", "mx_language", "mx_source"]
TOKEN = r"[^ \t\n\x0B\f\r]+"


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("long")


def order_key(seed: int, epoch: int | Column, doc_id: Column) -> Column:
    e = F.lit(epoch) if isinstance(epoch, int) else epoch
    return F.md5(F.concat_ws(":", F.lit(str(seed)), e.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("null"))))


def _weight(level: str, weights: dict[str, int], default: int) -> Column:
    if not weights:
        return F.lit(default).cast("long")
    table = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    return F.coalesce(F.element_at(table, F.col(level)), F.lit(default)).cast("long")


def share_level(nodes: DataFrame, parent: list[str], level: str) -> DataFrame:
    """``nodes`` (budget of the parent, own capacity and weight) with ``given``, by water-filling."""
    siblings = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(1))
    before = siblings.orderBy(F.col("capacity") / F.col("weight"), level).rowsBetween(Window.unboundedPreceding, -1)
    filled = (
        nodes.withColumn("c_before", F.coalesce(F.sum("capacity").over(before), F.lit(0)))
        .withColumn("w_before", F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("w_all", F.sum("weight").over(siblings))
        .withColumn("full", F.col("c_before") * F.col("weight") + F.col("capacity") * (F.col("w_all") - F.col("w_before"))
                    <= F.col("budget") * F.col("weight"))
        .withColumn("c_full", F.coalesce(F.sum(F.when(F.col("full"), F.col("capacity"))).over(siblings), F.lit(0)))
        .withColumn("w_full", F.coalesce(F.sum(F.when(F.col("full"), F.col("weight"))).over(siblings), F.lit(0)))
    )
    part = F.expr("(budget - c_full) * weight div (w_all - w_full)")
    return filled.withColumn("given", F.when(F.col("full"), F.col("capacity")).otherwise(part).cast("long")).drop(
        "c_before", "w_before", "w_all", "full", "c_full", "w_full")


def leaf_budgets(leaves: DataFrame, budget: Column, weights: list[dict[str, int]], default_weight: int,
                 max_epochs: int) -> DataFrame:
    """``leaves`` (LEVELS, tokens) with the tokens given to each: (LEVELS, tokens, given)."""
    d, la, s = LEVELS
    held = leaves.withColumn("capacity", F.col("tokens") * F.lit(max_epochs).cast("long"))
    top = held.groupBy(d).agg(F.sum("capacity").alias("capacity")).withColumn(
        "budget", budget).withColumn("weight", _weight(d, weights[0], default_weight))
    top = share_level(top, [], d).select(d, F.col("given").alias("budget"))
    mid = held.groupBy(d, la).agg(F.sum("capacity").alias("capacity")).join(top, d).withColumn(
        "weight", _weight(la, weights[1], default_weight))
    mid = share_level(mid, [d], la).select(d, la, F.col("given").alias("budget"))
    low = held.join(mid, [d, la]).withColumn("weight", _weight(s, weights[2], default_weight))
    return share_level(low, [d, la], s).select(*LEVELS, "tokens", "given")


def mix(docs: DataFrame, domain: Column, language: Column, source: Column, budget_percent: int,
        domain_weights: dict[str, int] | None = None, language_weights: dict[str, int] | None = None,
        source_weights: dict[str, int] | None = None, default_weight: int = 100, max_epochs: int = 4,
        seed: int = 17) -> DataFrame:
    """``docs`` once for every epoch a document is taken in, with mx_domain, mx_language, mx_source, mx_tokens,
    mx_epoch (from 0) and mx_take (tokens taken; less than mx_tokens for the document that the budget cuts).

    ``budget_percent`` is the budget in percent of all tokens; weights are whole numbers from 1 on, by value of
    each level. Shares are rounded down to whole tokens.
    """
    if min([default_weight, max_epochs, *(w for t in (domain_weights, language_weights, source_weights)
                                          for w in (t or {}).values())]) < 1:
        raise ValueError("weights and max_epochs are at least 1")
    null = F.lit("\0null")
    keyed = (
        docs.withColumn("mx_domain", F.coalesce(domain.cast("string"), null))
        .withColumn("mx_language", F.coalesce(language.cast("string"), null))
        .withColumn("mx_source", F.coalesce(source.cast("string"), null))
        .withColumn("mx_tokens", token_count(F.col("text")))
    )
    light = materialize(keyed.select(*LEVELS, "doc_id", "mx_tokens"), "mix-tokens")
    leaves = materialize(
        light.groupBy(*LEVELS).agg(F.sum("mx_tokens").alias("tokens")).filter("tokens > 0"), "mix-leaves")
    total = leaves.agg(F.sum("tokens")).first()[0] or 0
    budgets = leaf_budgets(
        leaves, F.lit(int(total) * budget_percent // 100).cast("long"),
        [domain_weights or {}, language_weights or {}, source_weights or {}], default_weight, max_epochs)
    budgets = materialize(
        budgets.withColumn("mx_whole", F.expr("given div tokens")).withColumn("mx_rest", F.expr("given % tokens")),
        "mix-budgets")

    last = order_key(seed, F.col("mx_whole"), F.col("doc_id"))
    cut = _cuts(light.join(small_side(budgets), LEVELS).withColumn("mx_order", last))
    plan = budgets.select(*LEVELS, "mx_whole").join(cut, LEVELS, "left").select(
        *LEVELS, "mx_whole", "mx_bucket", "mx_left")
    plan = materialize(plan, "mix-plan")

    joined = keyed.join(small_side(plan), LEVELS)
    bucket = F.substring(order_key(seed, F.col("mx_whole"), F.col("doc_id")), 1, BUCKET_DIGITS[-1])
    names = [*docs.columns, *LEVELS, "mx_tokens"]
    epochs = F.col("mx_whole") + F.when(bucket < F.col("mx_bucket"), 1).otherwise(0)
    full = joined.withColumn("mx_epochs", epochs).filter("mx_epochs > 0 and mx_tokens > 0").select(
        *names, F.explode(F.sequence(F.lit(0).cast("long"), F.col("mx_epochs") - 1)).alias("mx_epoch"),
        F.col("mx_tokens").alias("mx_take"))
    inside = joined.filter(bucket == F.col("mx_bucket")).filter("mx_tokens > 0").withColumn(
        "mx_order", order_key(seed, F.col("mx_whole"), F.col("doc_id")))
    ordered = Window.partitionBy(*LEVELS).orderBy("mx_order", F.xxhash64("text")).rowsBetween(
        Window.unboundedPreceding, -1)
    cut_off = inside.withColumn("mx_in", F.coalesce(F.sum("mx_tokens").over(ordered), F.lit(0))).filter(
        "mx_in < mx_left").select(
        *names, F.col("mx_whole").alias("mx_epoch"),
        F.least("mx_tokens", F.col("mx_left") - F.col("mx_in")).alias("mx_take"))
    return full.union(cut_off)


def _cuts(light: DataFrame) -> DataFrame:
    """Per leaf with a partial epoch: the bucket its prefix ends in, and the tokens left for it.

    Buckets are found digits by digits, so a window sees at most 16 ** 2 rows of a leaf.
    """
    at, left = None, F.col("mx_rest")
    for digits in BUCKET_DIGITS:
        rows = light.filter("mx_rest > 0")
        if at is not None:
            rows = rows.join(small_side(at), LEVELS).filter(F.substring("mx_order", 1, before_digits) == F.col("mx_bucket")).drop("mx_bucket")
            left = F.col("mx_left")
        sums = rows.groupBy(*LEVELS, F.substring("mx_order", 1, digits).alias("mx_bucket")).agg(
            F.sum("mx_tokens").alias("t"), F.min(left).alias("rest"))
        upto = Window.partitionBy(*LEVELS).orderBy("mx_bucket").rowsBetween(Window.unboundedPreceding, -1)
        found = sums.withColumn("before", F.coalesce(F.sum("t").over(upto), F.lit(0))).filter(
            "before < rest and rest <= before + t")
        at = materialize(found.select(*LEVELS, "mx_bucket", (F.col("rest") - F.col("before")).alias("mx_left")), "mix-cuts")
        before_digits = digits
    return at
