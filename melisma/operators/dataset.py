"""Trajectory records, evaluation, splits and training samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from melisma.functions import constants as K
from melisma.functions.score import ratio


def anonymous(user: Column, salt: str) -> Column:
    return F.concat(F.lit("user_"), F.substring(F.sha2(F.concat(F.lit(salt + ":"), user.cast("string")), 256), 1, 16))


def redacted(json: Column) -> Column:
    """JSON text without the values of ``user_id`` keys, at any depth."""
    return F.regexp_replace(json, r'("user_id"\s*:\s*)("(?:[^"\\]|\\.)*"|[-+.\w]+)', '$1"redacted"')


def records(trajectories: DataFrame, salt: str = "salt", anonymize: bool = True) -> DataFrame:
    """One flat record for each trajectory (user_id, day, steps)."""
    s = F.col("steps")
    total = F.aggregate(s, F.lit(0).cast("bigint"), lambda a, x: a + x["reward10"])
    count = lambda f: F.size(F.filter(s, f)).cast("bigint")
    artists = F.transform(s, lambda x: x["song_id"] % 10)
    who = anonymous(F.col("user_id"), salt) if anonymize else F.col("user_id").cast("string")
    return trajectories.select(
        F.concat_ws("-", F.col("user_id").cast("string"), "day").alias("trajectory_id"), who.alias("user_key"), "day", F.size(s).cast("bigint").alias("events"),
        count(lambda x: x["reward10"] > 0).alias("positive"), count(lambda x: x["reward10"] < 0).alias("negative"),
        count(lambda x: x["kind"] == "favorite").alias("favorites"), total.alias("reward10"),
        F.size(F.array_distinct(F.transform(s, lambda x: x["song_id"]))).cast("bigint").alias("songs"), F.size(F.array_distinct(artists)).cast("bigint").alias("artists"),
        F.aggregate(s, F.lit(0).cast("bigint"), lambda a, x: a + x["value100"]).alias("latency"),
        F.exists(s, lambda x: x["kind"] == "playlist_add").alias("goal_reached"), F.element_at(s, -1)["kind"].alias("stop_reason"),
    )


def evaluation(recs: DataFrame) -> DataFrame:
    """One row of totals, rates and means over all records."""
    n = F.count(F.lit(1))
    return recs.agg(
        n.alias("trajectories"), F.count_distinct("user_key").alias("users"), F.sum("events").alias("events"), ratio(F.count_if("goal_reached"), n).alias("goal_rate"),
        ratio(F.sum("reward10"), F.sum("events") * 10).alias("average_reward"), ratio(F.sum("positive"), F.sum("events")).alias("positive_rate"),
        ratio(F.sum("negative"), F.sum("events")).alias("negative_rate"), ratio(F.sum("favorites"), F.sum("events")).alias("favorite_rate"),
        ratio(F.sum("artists"), F.sum("songs")).alias("diversity"), ratio(F.sum("latency"), n).alias("mean_latency"),
        F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY latency)").alias("p95_latency"),
    )


def histogram(recs: DataFrame, column: str) -> DataFrame:
    return recs.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("trajectories"))


def rank_analysis(trajectories: DataFrame) -> DataFrame:
    """Mean reward and rates by the rank at which a song was shown, and by score bucket, in one grouping."""
    from melisma.functions.score import score_bucket

    rows = trajectories.select(F.posexplode("steps").alias("i", "s")).select((F.col("i") + 1).cast("string").alias("rank"), score_bucket((F.col("s.song_id") + 1) / 100.0).alias("bucket"), F.col("s.reward10").alias("r"))
    keyed = rows.select(F.inline(F.array(F.struct(F.lit("rank").alias("dim"), F.col("rank").alias("key")), F.struct(F.lit("bucket").alias("dim"), F.col("bucket").alias("key")))), "r")
    n = F.count(F.lit(1))
    return keyed.groupBy("dim", "key").agg(n.alias("events"), F.sum("r").alias("reward10"), ratio(F.count_if(F.col("r") > 0), n).alias("positive_rate"), ratio(F.count_if(F.col("r") < 0), n).alias("negative_rate"))


def ranking_feedback(contexts: DataFrame) -> DataFrame:
    """dim, key, place, events, average_reward, positive_rate, negative_rate: feedback by rank, score bucket and source, and all of it.

    contexts: reward (or null: left out), rank, score, source (null or blank: unknown). One pass with grouping sets. place orders
    the keys of a dim: ranks as numbers with the unknown one last, others by name. Averages and rates have six places.
    """
    from melisma.functions.score import score_bucket

    unknown = lambda c: F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit("unknown"))
    rank = F.when(F.col("rank") == 0, "unknown").otherwise(unknown("rank"))
    rows = contexts.where("reward IS NOT NULL").select("reward", rank.alias("rank"), F.when(F.col("score").isNull(), "unknown").otherwise(score_bucket(F.col("score"))).alias("bucket"), unknown("source").alias("source"))
    n, dims = F.count(F.lit(1)), ("rank", "bucket", "source")
    rate = lambda hits: F.round(F.count_if(hits) / n, 6)
    grouped = rows.groupingSets([[], *[[F.col(d)] for d in dims]], *dims).agg(
        F.grouping_id().alias("set"), n.alias("events"), F.round(F.avg("reward"), 6).alias("average_reward"), rate(F.col("reward") > 0).alias("positive_rate"), rate(F.col("reward") < 0).alias("negative_rate")
    )
    found = grouped.where("events > 0").withColumn("dim", F.when(F.col("set") == 0b011, "rank").when(F.col("set") == 0b101, "bucket").when(F.col("set") == 0b110, "source").otherwise("all"))
    keyed = found.withColumn("key", F.coalesce(*dims, F.lit("all")))
    number = F.when(F.col("dim") == "rank", F.coalesce(F.expr("try_cast(key AS INT)"), F.lit(2**31 - 1))).otherwise(0)
    place = F.row_number().over(Window.partitionBy("dim").orderBy(number, "key"))
    return keyed.select("dim", "key", place.alias("place"), "events", "average_reward", "positive_rate", "negative_rate")


def ranking_totals(contexts: DataFrame, runs: DataFrame) -> DataFrame:
    """One row: runs that feedback came for, feedback events, those with a reward, and collection writes. contexts also: run_id, collects."""
    per = contexts.groupBy("run_id").agg(F.count(F.lit(1)).alias("events"), F.count("reward").alias("rewarded"), F.count_if("collects").alias("writes"))
    met = runs.select("run_id").distinct().join(per, "run_id")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return met.agg(F.count(F.lit(1)).alias("runs"), total("events"), total("rewarded"), total("writes"))


def quality_totals(trajectories: DataFrame) -> DataFrame:
    """Generated, grounded and dropped proposals and thought coverage, by trajectory sums."""
    s = F.col("steps")
    per = trajectories.select(F.size(s).alias("generated"), F.size(F.filter(s, lambda x: x["reward10"] >= 0)).alias("grounded"), F.size(F.filter(s, lambda x: x["value100"] > 500)).alias("thought"))
    n = F.count(F.lit(1))
    return per.agg(
        n.alias("trajectories"), F.sum("generated").alias("generated"), F.sum("grounded").alias("grounded"), F.sum(F.col("generated") - F.col("grounded")).alias("dropped"),
        ratio(F.sum("grounded"), F.sum("generated")).alias("grounding_rate"), ratio(F.sum("thought"), F.sum("generated")).alias("thought_coverage"),
        ratio(F.sum(F.col("generated") - F.col("grounded")), F.sum("generated")).alias("hallucination_rate"),
    )


def quality_gate(totals: DataFrame) -> DataFrame:
    """check, passed: each rule of the gate; rules without a denominator are skipped."""
    some = F.col("generated") > 0
    g = K.QUALITY_GATE
    checks = F.array(
        F.struct(F.lit("hallucination").alias("check"), F.when(some, F.col("hallucination_rate") <= g["hallucination"]).alias("passed")),
        F.struct(F.lit("grounding").alias("check"), F.when(some, F.col("grounding_rate") >= g["grounding"]).alias("passed")),
        F.struct(F.lit("thought").alias("check"), F.when(some, F.col("thought_coverage") >= g["thought"]).alias("passed")),
    )
    return totals.select(F.inline(checks)).where("passed IS NOT NULL")


def ab_deltas(recs: DataFrame, variant: Column) -> DataFrame:
    """metric, a, b, delta: the arms' means and B less A; one pass over the records."""
    rows = recs.withColumn("arm", variant)
    mean = lambda arm, num, den: ratio(F.sum(F.when(F.col("arm") == arm, num)), F.sum(F.when(F.col("arm") == arm, den)))
    metrics = {"goal_rate": (F.col("goal_reached").cast("int"), F.lit(1)), "reward10": (F.col("reward10"), F.col("events")), "diversity": (F.col("artists"), F.col("songs")), "latency": (F.col("latency"), F.lit(1))}
    one = rows.agg(*[mean(a, *metrics[m]).alias(f"{m}_{a}") for m in metrics for a in ("a", "b")])
    table = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"{m}_a").alias("a"), F.col(f"{m}_b").alias("b"), (F.col(f"{m}_b") - F.col(f"{m}_a")).alias("delta")) for m in metrics])
    return one.select(F.inline(table))


def allocation(n: int, ratios: Sequence[tuple[str, float]] = K.SPLIT_RATIOS) -> list[tuple[str, int]]:
    """Largest-remainder shares of n; where n allows, every split gets one."""
    exact = [n * r for _, r in ratios]
    got = [int(x) for x in exact]
    for i in sorted(range(len(got)), key=lambda i: (got[i] - exact[i], i))[: n - sum(got)]:
        got[i] += 1
    if n >= len(got):
        for i in [i for i, g in enumerate(got) if not g]:
            got[max(range(len(got)), key=lambda j: got[j])] -= 1
            got[i] = 1
    return [(name, g) for (name, _), g in zip(ratios, got)]


def user_splits(users: DataFrame, seed: int = K.SPLIT_SEED) -> DataFrame:
    """user_id, split: users in order of a seeded hash, dealt in runs of the allocated sizes.

    The position comes from a range sort and counts by bucket of the hash, so no single task orders all users.
    """
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("user_id").cast("string")), 256)
    hashed = users.select("user_id", h.alias("h")).withColumn("bucket", F.conv(F.substring("h", 1, 3), 16, 10).cast("int"))
    sizes = hashed.groupBy("bucket").agg(F.count(F.lit(1)).alias("c"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("before", F.coalesce(F.sum("c").over(before), F.lit(0))).drop("c")  # 4096 buckets at most
    place = F.row_number().over(Window.partitionBy("bucket").orderBy("h")) + F.col("before")
    placed = hashed.join(F.broadcast(offsets), "bucket").withColumn("place", place)
    upto, split = 0, F.lit(None).cast("string")
    ends = []
    for name, size in allocation(users.count()):
        upto += size
        ends.append((name, upto))
    for name, end in reversed(ends):
        split = F.when(F.col("place") <= end, name).otherwise(split)
    return placed.select("user_id", split.alias("split"))


def split_manifest(recs: DataFrame, splits: DataFrame) -> DataFrame:
    return recs.join(splits, "user_id").groupBy("split").agg(F.count(F.lit(1)).alias("trajectories"), F.count_distinct("user_id").alias("users"))


def reward_table(groups: DataFrame) -> DataFrame:
    pairs = groups.select(F.inline(F.arrays_zip("responses", "rewards")))
    return pairs.groupBy(F.col("responses").alias("response")).agg(F.max("rewards").alias("reward10"))


def latest_messages(messages: DataFrame, n: int = K.MESSAGES_KEPT) -> DataFrame:
    """The last n messages of each session."""
    newest = Window.partitionBy("session_id").orderBy(F.desc("turn"))
    return messages.withColumn("from_end", F.row_number().over(newest)).where(F.col("from_end") <= n)
