"""Mixing sources to target weights.

Sizes are summed by source; sources share the total by weight, but none gets more than ``max_rate`` times its own
size, and what is cut off is shared again by weight among the others. A source's repetition rate is its target
over its size. Each document is emitted floor(rate) times, plus once more if a hash of a seed, its id and its text,
read as a number from 0 to 1, lies below the fraction; so reruns agree and no state is kept.

One draw leaves a source of few or uneven documents far from its target. So every source draws with ``SEEDS`` seeds at
once, in one aggregation of a table of narrow rows, and keeps the seed whose sum comes nearest (the least of equals).
What is left is about half the spread of the sums over ``SEEDS``: on the given tables below 2 % of a target unless a
single document is larger than that (one document that makes up its source can only be taken whole times).

Only one row for each source passes through a single task; documents are never grouped, and their sums for a source
and a seed are partial in every task first. Source rows are joined back from written tables, which Catalyst broadcasts
below its size threshold and joins by shuffle beyond it.

Defined results: a null source is a source of its own and ordered last; a null or blank text has size 0; sources
of size 0 get target and rate 0; rows equal in id and text share their decision; an empty input gives an empty
output; a plan replaces columns named like its own, the mixed
corpus keeps every column of the input.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from melisma.llm.text import hex_long, null_key, set_aside, words
from melisma.session import written

WEIGHTS = (1.0, 2.0, 3.0)
MAX_RATE = 3.0
SEED = "mix-1"
SEEDS = 64
NEW = ["size", "source_size", "target", "rate", "copies"]


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, max_rate: float = MAX_RATE) -> DataFrame:
    """From (source, size) rows: source, source_size, weight, target, rate; one row for each source."""
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    weighed = total.withColumn("weight", F.element_at(cycle, F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1))
    weighed = weighed.withColumn("cap", F.lit(max_rate) * F.col("source_size"))
    # Sources reach their caps in order of cap / weight: one pass over that order finds who is capped.
    order = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    lot = weighed.withColumn("all_size", F.sum("source_size").over(everything)).withColumn("all_weight", F.sum("weight").over(everything))
    lot = lot.withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("weight_before", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    level = (F.col("all_size") - F.col("cap_before")) / (F.col("all_weight") - F.col("weight_before"))
    lot = lot.withColumn("capped", F.col("cap") <= level * F.col("weight"))
    left_size = F.col("all_size") - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0.0)).over(everything)
    left_weight = F.sum(F.when(F.col("capped"), 0.0).otherwise(F.col("weight"))).over(everything)
    lot = lot.withColumn("left_size", left_size).withColumn("left_weight", left_weight)
    share = F.col("left_size") * F.col("weight") / F.col("left_weight")
    target = F.when(F.col("capped"), F.col("cap")).otherwise(share)
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(max_rate), F.col("target") / F.col("source_size"))).otherwise(0.0)
    return lot.withColumn("target", target).withColumn("rate", rate).select("source", "source_size", "weight", "target", "rate")


def identity(doc_id: Column, text: Column) -> Column:
    """What rows share that are drawn alike: id and text."""
    return F.md5(F.concat_ws(":", null_key(doc_id), F.md5(F.coalesce(text, F.lit("")).cast("binary"))).cast("binary"))


def draw(identity: Column, number: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that depends on the seed, its number and the row's identity only."""
    return hex_long(F.md5(F.concat_ws(":", F.lit(seed), number.cast("string"), identity).cast("binary")), 13) / F.lit(float(2**52))


def best_seeds(sizes: DataFrame, targets: DataFrame, seeds: int = SEEDS, seed: str = SEED) -> DataFrame:
    """``targets`` with pick: of each source, the seed's number whose draws come nearest to its target.

    sizes: source, size, who (an identity)."""
    rated = targets.select(null_key(F.col("source")).alias("k"), "rate")
    rows = sizes.select(null_key(F.col("source")).alias("k"), "size", "who").where("size > 0").join(rated, "k")
    drawn = rows.withColumn("number", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))))
    hit = draw(F.col("who"), F.col("number"), seed) < F.col("rate") - F.floor("rate")
    sums = drawn.groupBy("k", "number").agg(F.sum(F.when(hit, F.col("size")).otherwise(0)).alias("extra"))
    keyed = targets.withColumn("k", null_key(F.col("source")))
    away = F.abs(F.floor("rate") * F.col("source_size") + F.col("extra") - F.col("target"))
    picks = sums.join(keyed, "k").groupBy("k").agg(F.min(F.struct(away, "number"))["number"].alias("pick"))
    return keyed.join(picks, "k", "left").withColumn("pick", F.coalesce("pick", F.lit(0))).drop("k")


def plan_mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, max_rate: float = MAX_RATE, seed: str = SEED, seeds: int = SEEDS) -> DataFrame:
    """``docs`` (doc_id, text, source, ...) with size, source_size, target, rate and copies; one row for each document."""
    rows = set_aside(docs, ["doc_id", "text", "source"])
    sized = rows.select("source", F.size(words(F.col("text"))).cast("long").alias("size"), identity(F.col("doc_id"), F.col("text")).alias("who"), "_row")
    narrow = written(sized.select("source", "size", "who"), "mix-sizes")
    targets = written(source_targets(narrow.select("source", "size"), weights, max_rate), "mix-targets")
    picked = written(best_seeds(narrow, targets, seeds, seed), "mix-picks")
    picked = picked.select(null_key(F.col("source")).alias("_k"), "source_size", "target", "rate", "pick")
    planned = sized.withColumn("_k", null_key(F.col("source"))).join(picked, "_k", "left")
    extra = draw(F.col("who"), F.col("pick"), seed) < F.col("rate") - F.floor("rate")
    planned = planned.withColumn("copies", (F.floor("rate") + extra.cast("int")).cast("long"))
    return planned.select(*[F.col(f"_row.`{c}`") for c in docs.columns if c not in NEW], *NEW)


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, max_rate: float = MAX_RATE, seed: str = SEED, seeds: int = SEEDS) -> DataFrame:
    """The mixed corpus: the columns of ``docs``, each document as many times as its plan says."""
    planned = plan_mix(set_aside(docs, ["doc_id", "text", "source"]), weights, max_rate, seed, seeds)
    kept = planned.where(F.col("copies") > 0).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return kept.select("_row.*")
