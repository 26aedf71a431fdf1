"""Queries that write to files and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from melisma.operators import dataset as ds
from melisma.plans.evaluate import RECORDS, SPLITS
from melisma.plans.recommend import query
from melisma.session import new_path
from melisma.sources import adapters as ad
from melisma.sources import files


@query(RECORDS + "SELECT * EXCLUDE user_id FROM records")
def src7_snk3_jsonl_round_trip(spark, sf_dir):
    rows, path = ds.records(ad.trajectories(spark, sf_dir)), new_path(spark, "jsonl")
    files.write_lines(rows, path)
    return files.read_lines(spark, path, ", ".join(f"{n} {t}" for n, t in rows.dtypes))


@query(RECORDS + "SELECT trajectory_id, events, CASE WHEN goal_reached THEN 'True' ELSE 'False' END AS goal_reached, stop_reason FROM records")
def snk4_csv_round_trip(spark, sf_dir):
    rows, path = ds.records(ad.trajectories(spark, sf_dir)).select("trajectory_id", "events", "goal_reached", "stop_reason"), new_path(spark, "csv")
    files.write_table(rows, path)
    return spark.read.csv(path, header=True, schema="trajectory_id string, events bigint, goal_reached string, stop_reason string")


@query(RECORDS + "," + SPLITS + "SELECT trajectory_id, split FROM records JOIN splits USING (user_id)")
def snk5_split_writer(spark, sf_dir):
    t, path = ad.trajectories(spark, sf_dir), new_path(spark, "splits")
    splits = ds.user_splits(t.select("user_id").distinct())
    files.write_splits(t.join(splits, "user_id").select(F.concat_ws("-", F.col("user_id").cast("string"), "day").alias("trajectory_id"), "split"), path)
    return spark.read.schema("trajectory_id string, split string").json(path)


@query("""
patched AS (SELECT song_id, CASE WHEN song_id % 3 = 0 THEN 'patched' ELSE title END AS title, artist, CASE WHEN song_id % 3 = 0 THEN 2 ELSE 1 END AS version FROM songs)
SELECT * FROM patched
""")
def snk1_tl13_upsert(spark, sf_dir):
    s = ad.songs(spark, sf_dir).select("song_id", "title", "artist", F.lit(1).alias("version"))
    patch = s.where("song_id % 3 = 0").select("song_id", F.lit("patched").alias("title"), F.lit(None).cast("string").alias("artist"))
    return files.upserted(s, patch, "song_id")


@query("""
contexts AS (SELECT trajectory_id, max(reward10) AS best FROM steps GROUP BY trajectory_id)
SELECT s.seq, s.trajectory_id, s.rank, s.reward10 = c.best AS is_best FROM steps s JOIN contexts c USING (trajectory_id)
""")
def jn15_st5_feedback_context(spark, sf_dir):
    t = ad.trajectories(spark, sf_dir).withColumn("trajectory_id", F.concat_ws("-", F.col("user_id").cast("string"), "day"))
    best = F.array_max(F.transform("steps", lambda s: s["reward10"]))
    rows = t.select("trajectory_id", best.alias("best"), F.posexplode("steps").alias("i", "s"))
    return rows.select(F.col("s.seq").alias("seq"), "trajectory_id", (F.col("i") + 1).cast("bigint").alias("rank"), (F.col("s.reward10") == F.col("best")).alias("is_best"))


@query("SELECT user_id || '-' || strftime(min(ts), '%Y-%m-%d') AS trajectory_id, day, row_number() OVER (PARTITION BY user_id ORDER BY day DESC) AS newest FROM steps GROUP BY user_id, day")
def src8_trajectories_newest_first(spark, sf_dir):
    from pyspark.sql import Window

    t = ad.trajectories(spark, sf_dir)
    return t.select(F.concat_ws("-", F.col("user_id").cast("string"), "day").alias("trajectory_id"), "day", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("day"))).alias("newest"))


@query("""
patched AS (SELECT song_id, CASE WHEN song_id % 3 = 0 THEN 'patched' ELSE title END AS title, artist, CASE WHEN song_id % 3 = 0 THEN 2 ELSE 1 END AS version FROM songs)
SELECT * FROM patched
""")
def snk1_published_upsert(spark, sf_dir):
    """Songs published in buckets, patched there and read back."""
    path = new_path(spark, "published")
    s = ad.songs(spark, sf_dir).select("song_id", "title", "artist", F.lit(1).alias("version"))
    files.publish(s, path, "song_id")
    files.upsert(spark, s.where("song_id % 3 = 0").select("song_id", F.lit("patched").alias("title"), F.lit(None).cast("string").alias("artist")), path, "song_id")
    return spark.read.parquet(path).select("song_id", "title", "artist", "version")


@query(RECORDS + "," + SPLITS + """
SELECT split, count(*) AS runs, count(DISTINCT user_id) AS users FROM records JOIN splits USING (user_id) GROUP BY split
""")
def snk5_split_manifest(spark, sf_dir):
    """The manifest of published splits, read back."""
    t, path = ad.trajectories(spark, sf_dir), new_path(spark, "published-splits")
    runs = t.join(ds.user_splits(t.select("user_id").distinct()), "user_id").select("user_id", F.concat_ws("-", F.col("user_id").cast("string"), "day").alias("trajectory_id"), "split")
    files.publish_splits(runs, path, 20260615)
    read = spark.read.schema("split_runs map<string, bigint>, split_users map<string, bigint>, seed int").json(f"{path}/manifest")
    return read.select(F.explode("split_runs").alias("split", "runs"), "split_users").select("split", "runs", F.element_at("split_users", F.col("split")).alias("users"))


@query("""
patches AS (
    SELECT song_id, CASE WHEN song_id % 9 = 0 THEN ' ' ELSE split_part(title, ' ', 2) END AS second, (year - 1970) / 40.0::DOUBLE AS weight, song_id % 5 = 0 AS odd_kind, song_id % 7 = 0 AS spare, confidence10 FROM songs),
told AS (
    SELECT song_id, concat_ws('; ', CASE WHEN spare THEN 'unknown fields: note' END, CASE WHEN trim(second) = '' THEN 'collection_song_ids: names' END,
        CASE WHEN weight > 1 THEN 'artist_preferences: weights' END, CASE WHEN odd_kind THEN 'feedback_memory: records' END) AS reasons FROM patches)
SELECT song_id, reasons, reasons = '' AS valid FROM told
""")
def flt18_profile_patches(spark, sf_dir):
    """Patches made from songs, some with blank names, weights above 1, unknown kinds of feedback or spare fields."""
    from melisma.operators import validation as va

    k = F.col("song_id")
    record = F.struct(F.when(k % 5 == 0, "played").otherwise("play").alias("feedback_type"), k.cast("string").alias("song_id"), F.lit("2024-01-01").alias("timestamp"), F.lit(0.5).alias("reward_score"))
    patch = F.struct(
        F.array(F.get(F.split("title", " "), F.lit(0)), F.when(k % 9 == 0, " ").otherwise(F.get(F.split("title", " "), F.lit(1)))).alias("collection_song_ids"),
        F.create_map("artist", (F.col("year") - 1970) / F.lit(40.0)).alias("artist_preferences"), F.array(record).alias("feedback_memory"), F.when(k % 7 == 0, "x").alias("note"),
    )
    rows = ad.songs(spark, sf_dir).select("song_id", F.to_json(patch).alias("patch"))
    return va.judged(rows, "patch", va.PROFILE_PATCH).select("song_id", F.array_join("reasons", "; ").alias("reasons"), (F.size("reasons") == 0).alias("valid"))
