"""Stream queries: the events as a file stream, run to its end, equal to the batch result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from melisma.plans.recommend import query
from melisma.session import new_path, ship_package
from melisma.sources import adapters as ad
from melisma.streaming import signals


def file_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stream of a table's files, whether the table is one file or a folder of part files."""
    # A pattern matches both; a path without one must be a folder.
    return spark.readStream.schema(ad.table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{{{name}}}.parquet")


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feedback adapter over a file stream of the events."""
    raw = file_stream(spark, sf_dir, "events")
    kind, reward = ad.event_feedback(F.col("event_type"))
    return raw.select("user_id", F.col("event_id").alias("seq"), F.get_json_object("props", "$.k").cast("bigint").alias("song_id"), kind.alias("kind"), reward.cast("bigint").alias("reward10"), F.col("ts").cast("timestamp").alias("ts"))


def run_to_end(stream: DataFrame, mode: str) -> DataFrame:
    """Writes all micro-batches of a stream to the shared folder, with their number as ``batch``."""
    spark = stream.sparkSession
    out, checkpoint = new_path(spark, "stream"), new_path(spark, "stream-checkpoint")

    def keep(batch: DataFrame, number: int) -> None:
        # A folder for each batch, so that a batch that is run again replaces its own rows.
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


@query("SELECT user_id, song_id, arg_max(reward10, seq) AS reward10 FROM feedback WHERE reward10 <> 0 GROUP BY ALL")
def st1_stream_last_reward(spark, sf_dir):
    rows = run_to_end(signals.last_rewards(event_stream(spark, sf_dir)), "update")
    return rows.groupBy("user_id", "song_id").agg(F.max_by("reward10", "seq").alias("reward10"))


@query()
def st2_stream_affinity(spark, sf_dir):
    ship_package(spark)
    events = event_stream(spark, sf_dir).withColumn("label", (F.col("song_id") % 5).cast("string"))
    rows = run_to_end(signals.affinities(events), "update")
    last = rows.groupBy("user_id").agg(F.max("seq").alias("seq"))
    return rows.join(last, ["user_id", "seq"]).select("user_id", "label", "affinity6")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, kind, count(*) AS events, sum(reward10)::BIGINT AS reward10 FROM feedback GROUP BY ALL")
def st8_windowed_plays(spark, sf_dir):
    return run_to_end(signals.windowed_plays(event_stream(spark, sf_dir)), "update").groupBy(F.col("start").cast("timestamp_ntz").alias("start"), "kind").agg(F.max_by("events", "batch").alias("events"), F.max_by("reward10", "batch").alias("reward10"))
