"""Catalogue records: entity resolution over sources, versions, genres, lineage and confidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from melisma.functions import constants as K
from melisma.functions import text


def genre_aliases() -> Column:
    """The alias table as a map literal."""
    return F.create_map(*[F.lit(x) for pair in K.GENRE_ALIASES.items() for x in pair])


def normalised_tags(tags: DataFrame) -> DataFrame:
    """song_id, field, name, score4 from song_id, field, label, w, pos: weights over the field's largest; of labels that
    become one name the last by position stays."""
    largest = F.max("w").over(Window.partitionBy("song_id", "field"))
    rows = tags.withColumn("score4", F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("w") / F.nullif(largest, F.lit(0)))) * 1e4 + 0.5).cast("bigint"))
    rows = rows.where("score4 IS NOT NULL").withColumn("name", text.tag_name(F.col("label")))
    return rows.groupBy("song_id", "field", "name").agg(F.max_by("score4", "pos").alias("score4"))


def genres(normalised: DataFrame, songs: DataFrame) -> DataFrame:
    """song_id, genre, weight4: known genres of track tags at full and artist tags at reduced weight, the larger one."""
    named = normalised.join(songs.select("song_id", text.tag_name(F.col("artist")).alias("artist_tag")), "song_id")
    track = F.col("field") == "track_tags"
    least = F.when(track, int(K.GENRE_TRACK[1] * 1e4)).otherwise(int(K.GENRE_ARTIST[1] * 1e4))
    weight = F.when(track, F.lit(K.GENRE_TRACK[0])).otherwise(F.lit(K.GENRE_ARTIST[0]))
    noise = (F.col("score4") < least) | F.coalesce(F.col("name") == F.col("artist_tag"), F.lit(False)) | F.col("name").isin(*K.NOT_GENRES) | F.rlike(F.col("name"), F.lit(K.DECADE))
    known = named.where(~noise).withColumn("genre", F.try_element_at(genre_aliases(), F.col("name"))).where("genre IS NOT NULL")
    return known.groupBy("song_id", "genre").agg(F.max(F.floor(F.col("score4") * weight + 0.5).cast("bigint")).alias("weight4"))


def completeness(*fields: Column) -> Column:
    """How many fields are neither null nor blank."""
    return reduce(lambda a, b: a + b, [F.when(F.coalesce(F.trim(f.cast("string")), F.lit("")) != "", 1).otherwise(0) for f in fields])


def preferred_version(records: DataFrame, keys: list[str], kind: Column, filled: Column, score: Column, pos: Column) -> DataFrame:
    """Of each key the record with the best version, then completeness, then score; the first wins a tie."""
    best = Window.partitionBy(*keys).orderBy(text.version_priority(kind).desc(), filled.desc(), score.desc(), pos.asc())
    return records.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")


def merged_records(sources: list[tuple[str, DataFrame]], fields: list[str]) -> DataFrame:
    """One row for each identity (title_key, artist_key): each field from the first source that has it, and its lineage.

    sources: in order of trust, with title_key, artist_key and the fields. All sources meet in one grouping, as a
    full outer join of any number of sources would, with a single shuffle.
    """
    rows = [df.select("title_key", "artist_key", F.lit(i).alias("trust"), F.lit(name).alias("source"), *[F.nullif(F.trim(F.col(f).cast("string")), F.lit("")).alias(f) for f in fields]) for i, (name, df) in enumerate(sources)]
    union = reduce(DataFrame.unionByName, rows).where("title_key != '' AND artist_key != ''")
    first = [F.min_by(f, F.when(F.col(f).isNotNull(), F.col("trust"))).alias(f) for f in fields]
    lineage = [F.array_join(F.transform(F.sort_array(F.collect_set(F.when(F.col(f).isNotNull(), F.struct("trust", "source")))), lambda x: x["source"]), ",").alias(f"{f}_from") for f in fields]
    return union.groupBy("title_key", "artist_key").agg(*first, *lineage, F.array_sort(F.collect_set("source")).alias("sources"))


def confidence(merged: DataFrame, roles: tuple[str, str, str], score: Column, tagged: Column, fields: list[str], with_genres: Column) -> Column:
    """Ten-thousandths: 2000 for a record of the first source, up to 2000 by its score (1 to 100, none is 100) for the
    second, 1500 for tags of the third, 2500 if two sources agree, 1000 by completeness, 1000 for genres; 10000 at most.
    """
    has = lambda role: F.array_contains("sources", role)
    part = F.least(F.lit(100), F.greatest(F.lit(0), F.coalesce(F.nullif(score.cast("int"), F.lit(0)), F.lit(100))))
    flag = lambda c, n: F.when(c, n).otherwise(0)
    full = F.floor(F.lit(1000) * completeness(*[F.col(f) for f in fields]) / len(fields) + 0.5)
    total = flag(has(roles[0]), 2000) + F.when(has(roles[1]), part * 20).otherwise(0) + flag(has(roles[2]) & tagged, 1500) + flag(F.size("sources") > 1, 2500) + full + flag(with_genres, 1000)
    return F.least(F.lit(10000), total).cast("bigint")


def artist_profiles(songs: DataFrame, tags: DataFrame) -> DataFrame:
    """artist, field, label, songs, weight: the greatest weight of each label over an artist's songs."""
    rows = songs.select("song_id", F.lower("artist").alias("artist")).join(tags, "song_id")
    return rows.groupBy("artist", "field", "label").agg(F.count_distinct("song_id").alias("songs"), F.max("w").alias("w"))


def provider_tags(tags: DataFrame) -> DataFrame:
    """A label's largest count over the overall largest."""
    names = tags.groupBy(text.tag_name(F.col("label")).alias("name")).agg(F.max("w").alias("w"))
    top = names.agg(F.max("w").alias("top"))
    return names.join(F.broadcast(top)).select("name", F.floor(F.col("w") / F.col("top") * 1e4 + 0.5).cast("bigint").alias("weight4"))  # one row


def collection_view(collection: DataFrame, songs: DataFrame, tags: DataFrame, favorites: DataFrame) -> DataFrame:
    """A user's collection with song fields, the three strongest genres and the first favourite; unknown songs stay."""
    best = tags.where("field <> 'artist_tags'").groupBy("song_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("w")).alias("n"), "label"))).alias("g"))
    top = best.select("song_id", F.array_join(F.transform(F.slice("g", 1, 3), lambda x: x["label"]), ",").alias("labels"))
    first = favorites.where(F.col("kind").isin(*K.COLLECTING_FEEDBACK)).groupBy("user_id", "song_id").agg(F.min("seq").alias("first_favorite"))
    view = collection.join(songs.select("song_id", "title", "artist"), "song_id", "left").join(top, "song_id", "left").join(first, ["user_id", "song_id"], "left")
    return view.select("user_id", "song_id", F.coalesce("title", F.lit("missing")).alias("title"), "artist", "labels", "first_favorite")


def playback(rows: DataFrame, external: DataFrame) -> DataFrame:
    """Rows with an embed address where the song has a valid external id (22 letters or digits)."""
    valid = external.where(F.rlike("external_id", F.lit("^[A-Za-z0-9]{22}$")))
    return rows.join(valid, "song_id", "left").withColumn("url", F.concat(F.lit("https://open.spotify.com/embed/track/"), F.col("external_id")))
