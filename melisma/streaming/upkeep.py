"""Preferences kept up to date by micro-batches of favourites, without a rebuild, and feedback joined with its context.

``Preferences`` keeps two tables of folders, one folder for each batch and in it one for each bucket of users: what is
collected, and sums of label weights by user, kind and label. A batch reads the buckets of its users only, writes the
songs that they didn't have, and the sums of those songs' labels; a label's total is the sum over the batches. A batch
looks at earlier batches only and replaces its own folders, so one that runs again, after a restart or a lost driver,
changes nothing. ``compact`` folds finished batches into one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from melisma.functions import constants as K
from melisma.operators.feedback import preference_labels
from melisma.session import written

BUCKETS = 64
COLLECTED = "user_id long, song_id long, first_order long"
SUMS = "user_id long, kind string, key string, s long, first struct<first_order: long, song_id: long, label: string>"
#: Classes (some 200 bytes each) of which the labels may be broadcast.
MOST_CLASSES = 200_000
#: The folder of the tables as they were before the first batch.
BASE = -1


def _bucketed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("bucket", F.pmod(F.xxhash64("user_id"), F.lit(BUCKETS)).cast("int"))


class Preferences:
    def __init__(self, spark: SparkSession, path: str, songs: DataFrame, tags: DataFrame):
        self.spark, self.path = spark, path.rstrip("/")
        labels = preference_labels(songs, tags).groupBy("song_id").agg(F.sort_array(F.collect_list(F.struct("kind", "key", "label", "w"))).alias("labels"))
        classes = written(labels.groupBy("labels").agg(F.min("song_id").alias("class"), F.collect_list("song_id").alias("songs")), "label-classes")
        self.classes, self.labels = classes.select("class", F.explode("songs").alias("song_id")), classes.select("class", "labels")
        self.few = self.labels.count() <= MOST_CLASSES

    def _write(self, rows: DataFrame, table: str, batch: int) -> None:
        _bucketed(rows).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{table}/batch={batch}")

    def _read(self, table: str, schema: str, buckets: list[int] | None = None) -> DataFrame:
        rows = self.spark.read.schema(f"{schema}, batch int, bucket int").parquet(f"{self.path}/{table}")
        return rows if buckets is None else rows.where(F.col("bucket").isin(buckets))

    def _sums(self, collected: DataFrame) -> DataFrame:
        # Songs with equal labels are one class. Its labels are met where a user's songs are together: they are never shuffled.
        mine = collected.join(self.classes, "song_id").repartition("user_id")
        met = mine.join(F.broadcast(self.labels) if self.few else self.labels, "class").select("user_id", "song_id", "first_order", F.inline("labels"))
        return met.groupBy("user_id", "kind", "key").agg(F.sum("w").cast("long").alias("s"), F.min(F.struct("first_order", "song_id", "label")).alias("first"))

    def begin(self, collection: DataFrame) -> None:
        """collection: user_id, song_id, first_order."""
        self._write(collection.select("user_id", "song_id", F.col("first_order").cast("long").alias("first_order")), "collected", BASE)
        self._write(self._sums(self._read("collected", COLLECTED)), "sums", BASE)

    def add(self, favourites: DataFrame, batch: int) -> DataFrame:
        """user_id, kind, label, weight4 of all users that a batch of favourites (user_id, song_id, first_order) gave a new song."""
        rows = _bucketed(favourites.groupBy("user_id", "song_id").agg(F.min("first_order").cast("long").alias("first_order")))
        buckets = [r[0] for r in rows.select("bucket").distinct().collect()]
        had = self._read("collected", COLLECTED, buckets).where(F.col("batch") < batch)
        self._write(rows.drop("bucket").join(had, ["user_id", "song_id"], "left_anti"), "collected", batch)
        new = self._read("collected", COLLECTED, buckets).where(F.col("batch") == batch)
        self._write(self._sums(new), "sums", batch)
        return self.of(new.select("user_id").distinct(), batch, buckets)

    def of(self, users: DataFrame | None = None, batch: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """user_id, kind, label, weight4 as of a batch (the newest unless one is named)."""
        rows = self._read("sums", SUMS, buckets)
        rows = rows if batch is None else rows.where(F.col("batch") <= batch)
        rows = rows if users is None else rows.join(users, "user_id", "left_semi")
        total = rows.groupBy("user_id", "kind", "key").agg(F.sum("s").alias("s"), F.min("first")["label"].alias("label"))
        largest = Window.partitionBy("user_id", "kind")
        return total.select("user_id", "kind", "label", F.floor(F.col("s") / F.max("s").over(largest) * 1e4 + 0.5).cast("bigint").alias("weight4"))

    def compact(self, path: str) -> Preferences:
        """The same tables with one batch, at another path; readers change over when it is whole."""
        out = Preferences.__new__(Preferences)
        out.spark, out.path, out.classes, out.labels, out.few = self.spark, path.rstrip("/"), self.classes, self.labels, self.few
        out._write(self._read("collected", COLLECTED).select("user_id", "song_id", "first_order"), "collected", BASE)
        sums = self._read("sums", SUMS).groupBy("user_id", "kind", "key").agg(F.sum("s").alias("s"), F.min("first").alias("first"))
        out._write(sums, "sums", BASE)
        return out


def feedback_contexts(events: DataFrame, runs: DataFrame, recommended: DataFrame) -> DataFrame:
    """Feedback events, a stream or a table, with the run that they answer: one row for each event.

    events: trajectory_id, user_id, seq, song_id, kind, reward10, ts. runs: trajectory_id, user_id, query, stop_reason.
    recommended: trajectory_id, song_id, rank, score. Events of a run that the user doesn't have have no query and the
    status ``unknown run``; songs that the run didn't recommend have no rank. ``collects``: the event adds the song to
    the collection, which only known runs do.
    """
    known = runs.select("trajectory_id", "user_id", "query", "stop_reason", F.lit(True).alias("_known"))
    met = events.join(known, ["trajectory_id", "user_id"], "left").join(recommended.select("trajectory_id", "song_id", "rank", "score"), ["trajectory_id", "song_id"], "left")
    is_known = F.coalesce("_known", F.lit(False))
    return met.select(
        "trajectory_id", "user_id", "seq", "song_id", F.col("kind").alias("feedback_type"), "reward10", "ts", "query", "stop_reason",
        F.when(is_known, F.col("rank")).alias("recommendation_rank"), F.when(is_known, F.col("score")).alias("recommended_score"),
        F.when(is_known, "written").otherwise("unknown run").alias("status"), (is_known & F.col("kind").isin(*K.COLLECTING_FEEDBACK)).alias("collects"),
    )


#: A song counts as heard at this share, and as skipped when it is left within so many milliseconds.
COMPLETE_SHARE, QUICK_MS = 0.9, 15_000


def player_feedback(events: DataFrame, gap: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Play, play_complete and quick_skip from a player's raw events, once for each listening; for append mode.

    An addition: the reference only describes these. events: user_id, song_id, ts, state (started, progress or closed),
    position_ms, duration_ms. A listening is a session window of one user's events on one song. It was played if it
    started, completed at ``COMPLETE_SHARE`` of the song, and skipped if it closed within ``QUICK_MS`` of its first start
    without being completed. Rows later than the watermark are dropped; a listening is given when the watermark has passed it.
    """
    at = lambda state: F.when(F.col("state") == state, F.col("ts"))
    heard = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id", "song_id").agg(
        F.min(at("started")).alias("started"), F.min(at("closed")).alias("closed"), F.max("position_ms").alias("position_ms"), F.max("duration_ms").alias("duration_ms"), F.count(F.lit(1)).alias("events")
    )
    complete = F.coalesce(F.col("position_ms") >= F.lit(COMPLETE_SHARE) * F.col("duration_ms"), F.lit(False))
    ms = F.unix_millis("closed") - F.unix_millis("started")
    quick = F.coalesce((ms >= 0) & (ms < QUICK_MS), F.lit(False)) & ~complete
    kinds = F.array_compact(F.array(F.lit("play"), F.when(complete, "play_complete"), F.when(quick, "quick_skip")))
    return heard.where("started IS NOT NULL").select("user_id", "song_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), F.explode(kinds).alias("kind"), "position_ms", "duration_ms", "events")
