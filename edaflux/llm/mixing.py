"""Mixing of sources to target weights by a hierarchical token budget.

A tree of levels (domain, language, source) has a weight at every node; siblings share their parent's budget in
proportion. A node can take no more than its supply: the tokens of its documents times the number of epochs. What a node
can't take goes to its siblings, in proportion to their weights, for as long as they can take it, and so reaches the
siblings of an ancestor only when the whole subtree is full: budgets are dealt from the root down, and each node's supply
already is that of its subtree. The division among siblings is solved in closed form: in the order of supply by weight,
the full ones are those whose ratio lies below the level that the others reach.

A leaf's budget is spent on epochs. Each epoch is a seeded order of the leaf's documents, all of them before the last
and a prefix of the last: the documents whose running tokens stay within what is left.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edaflux.llm.frames import stored

EPOCHS = 4
BUCKET_DIGITS = 3


def word_count(text: Column) -> Column:
    """Runs of characters between ASCII white space; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def divided(children: DataFrame, parents: Sequence[str], child: str) -> DataFrame:
    """``budget`` of the parent replaced by the child's own: water-filling among siblings by ``weight`` up to ``supply``.

    A child without weight gets nothing, whatever is left.
    """
    siblings = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
    ratio = F.when(F.col("weight") > 0, F.col("supply") / F.col("weight"))
    order = siblings.orderBy(F.asc_nulls_last("_ratio"), child)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    # The level if the children before this one are full, and this one and those behind it are not.
    level = F.when(
        F.col("_ratio").isNotNull(),
        (F.col("budget") - F.coalesce(F.sum("supply").over(before), F.lit(0.0))) / F.sum("weight").over(after),
    )
    stated = children.withColumn("_ratio", ratio).withColumn("_level", level)
    # The first child whose ratio is not below its level gives the level of all; the levels of those behind it are lower.
    reached = F.max(F.when(F.col("_ratio") >= F.col("_level"), F.col("_level"))).over(siblings)
    share = F.when(F.col("weight") > 0, F.least("supply", F.coalesce(reached * F.col("weight"), F.col("supply")))).otherwise(F.lit(0.0))
    return stated.withColumn("budget", F.greatest(share, F.lit(0.0))).drop("_ratio", "_level")


def leaf_budgets(
    leaves: DataFrame, levels: Sequence[str], budget: float, weights: Mapping[str, Mapping[str, float]], epochs: int
) -> DataFrame:
    """``leaves`` (levels and ``tokens``) with ``budget`` in tokens.

    ``weights`` maps a level to weights of its values; values without one weigh 1. Null values are nodes like any other.
    """
    out = leaves.withColumn("_supply", F.col("tokens") * F.lit(float(epochs))).withColumn("budget", F.lit(float(budget)))
    done: list[str] = []
    for level in levels:
        supply = out.groupBy(*done, level, "budget").agg(F.sum("_supply").alias("supply"))
        given = weights.get(level, {})
        weight = F.lit(1.0)
        for value, w in sorted(given.items()):
            weight = F.when(F.col(level) == value, F.lit(float(w))).otherwise(weight)
        shares = divided(supply.withColumn("weight", weight), done, level).select(*done, level, "budget")
        done = [*done, level]
        renamed = shares.select(*[F.col(c).alias(f"_r_{c}") for c in done], F.col("budget").alias("_given"))
        same = F.lit(True)
        for c in done:
            same = same & out[c].eqNullSafe(renamed[f"_r_{c}"])
        out = out.drop("budget").join(renamed, same).drop(*[f"_r_{c}" for c in done]).withColumnRenamed("_given", "budget")
    return out.drop("_supply")


def mixed(
    docs: DataFrame, levels: Mapping[str, Column], tokens: Column, weights: Mapping[str, Mapping[str, float]],
    budget_share: float = 1.0, epochs: int = EPOCHS, seed: int = 17, key: str = "doc_id", keep: Sequence[str] = (),
) -> DataFrame:
    """Rows (key, levels, epoch, n_tokens, columns of ``keep``), one for each time that a document is taken.

    The whole budget is ``budget_share`` times the tokens of all documents. A leaf whose budget is its supply gives all
    its documents in every epoch. Documents without tokens (null or empty texts) cost nothing and come with the prefix
    they lie in. The order of an epoch is the md5 of seed, epoch and key; rows with one key share a place and are taken
    together or not at all. A null key is ordered as an empty text. An empty table gives an empty result.

    A leaf may hold any share of the rows: its running sum is taken over buckets of the order (the first hex digits),
    and only the bucket in which the budget ends is ordered row by row.
    """
    names = list(levels)
    added = [key, *names, "epoch", "n_tokens"]
    leaf = F.struct(*[c.alias(n) for n, c in levels.items()])
    others = [c for c in keep if c not in added]
    pick = docs.select(
        F.col(key).alias("_key"), leaf.alias("_leaf"), tokens.alias("n_tokens"), F.struct(F.lit(0).alias("_"), *others).alias("kept")
    )
    light = stored(pick.drop("kept"))
    leaves = light.groupBy("_leaf").agg(F.sum("n_tokens").cast("double").alias("tokens")).select("_leaf.*", "tokens")
    whole = light.agg(F.sum("n_tokens")).head()[0] or 0
    shares = leaf_budgets(leaves, names, float(whole) * budget_share, weights, epochs)
    spent = F.least(F.floor(F.col("budget") + 1e-6), (F.col("tokens") * epochs).cast("long"))
    full = F.when(F.col("tokens") > 0, F.floor(spent / F.col("tokens"))).otherwise(F.lit(0)).cast("int")
    plan = stored(shares.select(
        F.struct(*names).alias("_leaf"), full.alias("full"), (spent - full * F.col("tokens").cast("long")).cast("long").alias("left"),
    ))

    def place(epoch: Column, key_: Column) -> Column:
        return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(key_.cast("string"), F.lit(""))))

    # Where each leaf's last epoch ends: buckets that lie inside, and the bucket that holds the end.
    rows = light.join(plan, "_leaf").withColumn("_place", place(F.col("full"), F.col("_key")))
    bucket = F.substring("_place", 1, BUCKET_DIGITS)
    sums = rows.groupBy("_leaf", "left", bucket.alias("_bucket")).agg(F.sum("n_tokens").alias("_in"))
    run = Window.partitionBy("_leaf").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.withColumn("_upto", F.sum("_in").over(run))
    edge = stored(sums.where("_upto > left").groupBy("_leaf").agg(
        F.min(F.struct("_bucket", (F.col("_upto") - F.col("_in")).alias("before"))).alias("edge")
    ).select("_leaf", F.col("edge._bucket").alias("_edge"), F.col("edge.before").alias("_before")))
    near = rows.join(edge, "_leaf").where(bucket == F.col("_edge"))
    inside = Window.partitionBy("_leaf").orderBy("_place").rangeBetween(Window.unboundedPreceding, 0)
    last = near.withColumn("_run", F.col("_before") + F.sum("n_tokens").over(inside)).where("_run > left").groupBy("_leaf").agg(F.min("_place").alias("_stop"))
    ends = stored(plan.join(edge.select("_leaf", "_edge"), "_leaf", "left").join(last, "_leaf", "left"))

    # A document is taken in every full epoch, and in the last one if its place comes before the stop.
    marked = pick.join(F.broadcast(ends) if ends.count() <= 10_000 else ends, "_leaf")
    taken = F.col("_edge").isNull() | F.coalesce(place(F.col("full"), F.col("_key")) < F.col("_stop"), F.lit(False))
    none = F.array().cast("array<int>")
    epochs_ = F.concat(
        F.when(F.col("full") > 0, F.sequence(F.lit(0), F.col("full") - 1)).otherwise(none),
        F.when(taken & (F.col("full") < epochs), F.array(F.col("full"))).otherwise(none),
    )
    out = marked.withColumn("epoch", F.explode(epochs_))
    return out.select(
        F.col("_key").alias(key), *[F.col("_leaf")[n].alias(n) for n in names], "epoch", "n_tokens", *[F.col("kept")[c].alias(c) for c in others]
    )
