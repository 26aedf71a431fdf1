"""The domain's tables over the driver's TPC-H-like tables. Weights are whole ten-thousandths, so sums are exact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from melisma.functions import constants as K


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def songs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("song_id"), F.col("p_name").alias("title"), F.col("p_brand").alias("artist"), F.col("p_type").alias("genre"),
        (F.col("p_size") + 1970).alias("year"), F.round(F.col("p_retailprice") * 100).cast("bigint").alias("duration_ms"), (F.col("p_partkey") % 10).alias("confidence10"),
    )


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """song_id, field, label, w: one row for each label of a song."""
    p = table(spark, sf_dir, "part")
    word = lambda i: F.get(F.split("p_name", " "), F.lit(i))
    rows = F.array(
        F.struct(F.lit("track_tags").alias("field"), word(0).alias("label"), F.lit(7000).cast("bigint").alias("w")),
        F.struct(F.lit("track_tags").alias("field"), word(1).alias("label"), (4000 + F.col("p_size") % 5 * 500).cast("bigint").alias("w")),
        F.struct(F.lit("genres").alias("field"), F.col("p_type").alias("label"), F.lit(10000).cast("bigint").alias("w")),
        F.struct(F.lit("artist_tags").alias("field"), F.col("p_brand").alias("label"), F.lit(10000).cast("bigint").alias("w")),
    )
    flat = p.select(F.col("p_partkey").alias("song_id"), F.inline(rows)).where("label IS NOT NULL")
    return flat.groupBy("song_id", "field", "label").agg(F.max("w").alias("w"))


def song_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """song_id, artist, year and a map of labels for each field; built without a shuffle."""
    p = table(spark, sf_dir, "part")
    w = F.split("p_name", " ")
    second = (4000 + F.col("p_size") % 5 * 500).cast("bigint")
    first = F.lit(7000).cast("bigint")
    track = F.when(F.get(w, F.lit(0)) == F.get(w, F.lit(1)), F.create_map(F.get(w, F.lit(0)), F.greatest(first, second))).otherwise(F.create_map(F.get(w, F.lit(0)), first, F.get(w, F.lit(1)), second))
    full = F.lit(10000).cast("bigint")
    return p.select(
        F.col("p_partkey").alias("song_id"), F.col("p_brand").alias("artist"), (F.col("p_size") + 1970).alias("year"), (F.col("p_partkey") % 10).alias("confidence10"),
        track.alias("track_tags"), F.create_map("p_type", full).alias("genres"), F.create_map("p_brand", full).alias("artist_tags"),
    )


def external_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """song_id, field, value: two kinds of ids, some of which several songs share and some are blank."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    ids = F.array(
        F.struct(F.lit("isrc").alias("field"), F.concat_ws("-", "p_type", F.col("p_size").cast("string")).alias("value")),
        F.struct(F.lit("mbid").alias("field"), F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("mb"), (k % 700).cast("string"))).alias("value")),
    )
    return p.select(k.alias("song_id"), F.inline(ids))


def collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, song_id, first_order: what each customer has ordered, in order of the first time."""
    o, li = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    return o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).groupBy(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("song_id")).agg(F.min("l_orderkey").alias("first_order"))


#: What an event of the driver's table stands for; anything else is a dislike.
EVENT_KINDS = {"view": "play", "click": "like", "purchase": "playlist_add", "signup": "favorite"}


def event_feedback(event: Column) -> tuple[Column, Column]:
    """An event's kind of feedback and its reward in tenths."""
    kind, tenths = F.lit("dislike"), lambda name: F.lit(round(10 * K.REWARDS[name]))
    reward = tenths("dislike")
    for name, means in EVENT_KINDS.items():
        kind, reward = F.when(event == name, means).otherwise(kind), F.when(event == name, tenths(means)).otherwise(reward)
    return kind, reward


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, seq, song_id, kind, reward10 (tenths), ts, value100."""
    kind, reward = event_feedback(F.col("event_type"))
    return table(spark, sf_dir, "events").select(
        "user_id", F.col("event_id").alias("seq"), F.get_json_object("props", "$.k").cast("bigint").alias("song_id"), kind.alias("kind"), reward.cast("bigint").alias("reward10"), "ts", F.round(F.col("value") * 100).cast("bigint").alias("value100")
    )


def trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each user and day of events: steps is array<struct<seq, song_id, kind, reward10, value100>> by seq."""
    f = feedback(spark, sf_dir)
    day = F.date_format("ts", "yyyy-MM-dd")
    return f.groupBy("user_id", day.alias("day")).agg(F.sort_array(F.collect_list(F.struct("seq", "song_id", "kind", "reward10", "value100"))).alias("steps"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), "turn", "role", "text")


def agent_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's day of feedback as an agent's run: user_id, day, query, artists, genres, top_k, decisions, answer, tracks, reward."""
    f = feedback(spark, sf_dir).join(songs(spark, sf_dir).select("song_id", "title", "artist", "genre"), "song_id")
    step = F.struct("seq", F.when(F.col("reward10") > 0, F.concat(F.lit("liked "), "title")).alias("thought"), F.col("kind").alias("tool"), "title", "artist", "genre")
    runs = f.groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.sort_array(F.collect_list(step)).alias("s"), F.avg("reward10").alias("r"))
    first, n = F.get("s", F.lit(0)), F.size("s")
    known = F.col("user_id") % 3 == 0
    return runs.select(
        "user_id", "day", F.concat(F.lit(" find me "), first["tool"], F.lit(" music")).alias("query"),
        F.when(known, F.create_map(F.lit("Zed"), F.lit(1), first["tool"], F.lit(2))).alias("artists"),
        F.when(F.col("user_id") % 2 == 0, F.create_map(F.lit("rock"), F.lit(1))).alias("genres"), F.when(F.col("user_id") % 4 < 2, n).alias("top_k"),
        F.transform("s", lambda x: F.struct(x["thought"].alias("thought"), x["tool"].alias("tool"))).alias("decisions"),
        F.when(n > 1, F.concat(F.lit("enjoy "), n.cast("string"))).alias("answer"), F.transform("s", lambda x: F.struct(x["title"].alias("title"), x["artist"].alias("artist"))).alias("tracks"),
        (F.col("r") / 10).alias("reward"),
    )
