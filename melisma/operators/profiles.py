"""Profiles: imports, replacements, collection edits and inspection, each as a new snapshot of the table.

profiles: user_id, ids (array, in order of collection), feedback (array), affinity (any type), version.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def imported(profiles: DataFrame, patches: DataFrame) -> DataFrame:
    """New ids are appended in their order, feedback is appended whole, and the version rises; users without a patch stay.

    patches: user_id, new_ids, new_feedback, one row for each user.
    """
    met = profiles.join(patches, "user_id", "left")
    more = lambda c: F.coalesce(F.col(c), F.slice(F.col(c.removeprefix("new_")), 1, 0))
    bump = F.col("version") + F.when(F.col("new_ids").isNotNull(), 1).otherwise(0)
    return met.select("user_id", F.array_union("ids", more("new_ids")).alias("ids"), F.concat("feedback", more("new_feedback")).alias("feedback"), "affinity", bump.alias("version"))


def replaced(profiles: DataFrame, patches: DataFrame, keep_feedback: bool) -> DataFrame:
    """All fields of the patched users are replaced; affinity, and feedback if asked for, stay."""
    met = profiles.join(patches, "user_id", "left")
    has = F.col("new_ids").isNotNull()
    ids, feedback = F.when(has, F.col("new_ids")).otherwise(F.col("ids")), F.when(has, F.col("new_feedback")).otherwise(F.col("feedback"))
    return met.select("user_id", ids.alias("ids"), (F.col("feedback") if keep_feedback else feedback).alias("feedback"), "affinity", (F.col("version") + F.when(has, 1).otherwise(0)).alias("version"))


def saved(ids: Column, song: Column) -> Column:
    """The collection with a song, appended if it is absent; the version doesn't change."""
    return F.array_union(ids, F.array(song))


def removed(ids: Column, song: Column) -> Column:
    return F.array_remove(ids, song)


def merged_preferences(current: DataFrame, patch: DataFrame) -> DataFrame:
    """user_id, label, weight: the patch's weight where it has the label."""
    new = patch.select("user_id", "label", F.col("weight").alias("_new"))
    return current.join(new, ["user_id", "label"], "full_outer").select("user_id", "label", F.coalesce("_new", "weight").alias("weight"))


def inspection(n_ids: Column, n_preferences: Column) -> list[Column]:
    """status, diagnostics and suggested tools of a profile."""
    no_ids, no_preferences = n_ids == 0, n_preferences == 0
    texts = lambda a, b: F.array_compact(F.array(F.when(no_ids, a), F.when(no_preferences, b)))
    return [
        F.when(no_ids, "empty").otherwise("ok").alias("status"), texts("collection is empty", "collection preferences are empty").alias("diagnostics"),
        texts("L2.collect_or_import", "L1.rebuild_profile").alias("suggested"),
    ]


def song_inspection(metadata: dict[str, Column], has_track_tags: Column, has_genres: Column) -> list[Column]:
    """status and diagnostics of a song; null and empty metadata are missing."""
    missing = F.array_compact(F.array(*[F.when(F.coalesce(c.cast("string"), F.lit("")) == "", F.lit(n)) for n, c in metadata.items()]))
    said = F.array_compact(F.array(
        F.when(F.size(missing) > 0, F.concat(F.lit("missing metadata fields: "), F.array_join(missing, ", "))),
        F.when(~has_track_tags, "Last.fm track tags are empty"), F.when(~has_genres, "normalized genres are empty"),
    ))
    return [F.when(F.size(said) > 0, "partial").otherwise("ok").alias("status"), said.alias("diagnostics")]


def taste_tracks(collection: DataFrame, songs: DataFrame, order: list[Column], n: int = 25) -> DataFrame:
    """user_id, pos, title, artist: of the first n collected songs those that are known and named."""
    from pyspark.sql import Window

    first = collection.withColumn("pos", F.row_number().over(Window.partitionBy("user_id").orderBy(*order))).where(F.col("pos") <= n)
    named = songs.select("song_id", F.trim("title").alias("title"), F.trim("artist").alias("artist")).where("title != '' AND artist != ''")
    return first.join(named, "song_id").select("user_id", "pos", "title", "artist")
