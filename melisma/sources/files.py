"""JSON, JSONL and CSV sources and sinks with fixed schemas; a bad file or line is set aside, never fatal."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from melisma.session import written

PROFILE = "user_id STRING, collection_song_ids ARRAY<STRING>, artist_preferences MAP<STRING,DOUBLE>, genre_preferences MAP<STRING,DOUBLE>, tag_preferences MAP<STRING,DOUBLE>, conversation_affinity MAP<STRING,DOUBLE>, feedback_memory ARRAY<STRUCT<feedback_type:STRING,song_id:STRING,timestamp:STRING,reward_score:DOUBLE,recommendation_context:STRING>>, version INT, updated_at STRING"
SONG = "song_id STRING, external_ids STRUCT<spotify_track_id:STRING,musicbrainz_recording_id:STRING>, metadata STRUCT<title:STRING,artist:STRING,album:STRING,release_year:INT,duration_ms:INT,version_type:STRING>, source_tags STRUCT<lastfm_track_tags:MAP<STRING,DOUBLE>,lastfm_artist_tags:MAP<STRING,DOUBLE>>, genres MAP<STRING,DOUBLE>, data_source MAP<STRING,ARRAY<STRING>>, confidence_score DOUBLE, version INT, updated_at STRING"
#: Fixed value: what ids may look like.
ID = r"^[A-Za-z0-9_.-]+$"


def read_documents(spark: SparkSession, path: str | list[str], schema: str) -> tuple[DataFrame, DataFrame]:
    """One JSON object a file: (rows, rejected). Rejected are files that don't parse, lack a field or have an unknown one."""
    kind = T.StructType.fromDDL(schema)
    names = [f.name for f in kind]
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value"))
    parsed = raw.withColumn("keys", F.json_object_keys("value")).withColumn("row", F.from_json("value", kind, {"mode": "PERMISSIVE"}))
    known = F.array(*[F.lit(n) for n in names])
    good = F.coalesce((F.size(F.array_except("keys", known)) == 0) & (F.size(F.array_except(known, "keys")) == 0) & F.col("row").isNotNull(), F.lit(False))
    return parsed.where(good).select("file", "row.*"), parsed.where(~good).select("file")


def read_raw(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """JSON files of any fields: (rows, skipped). Rows have the objects as variants; skipped are files that don't parse; other values are left out."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.try_parse_json("value").alias("value"))
    return raw.where(F.startswith(F.schema_of_variant("value"), F.lit("OBJECT"))), raw.where("value IS NULL").select("file")


def read_profile(spark: SparkSession, root: str, user_id: str) -> DataFrame:
    return read_store(spark, root, PROFILE, [user_id])[0].where(F.col("user_id") == user_id)


def read_song(spark: SparkSession, root: str, song_id: str) -> DataFrame:
    return read_store(spark, root, SONG, [song_id])[0].where(F.col("song_id") == song_id)


def read_songs(spark: SparkSession, path: str) -> DataFrame:
    return read_documents(spark, path, SONG)[0].orderBy("song_id")


def _scope(spark: SparkSession, root: str, keys: list[str] | None, below: str) -> list[str]:
    """Paths to read: those of the keys alone, so that no other folder is listed or opened; keys without files are left out."""
    root = root.rstrip("/")
    if keys is None:
        return [f"{root}/*{below}"]
    if bad := [k for k in keys if not re.fullmatch(ID, k) or set(k) == {"."}]:
        raise ValueError(f"not an id: {bad[0]!r}")
    paths = [f"{root}/{k}{below}" for k in dict.fromkeys(keys)]
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return [p for p in paths if store.globStatus(spark._jvm.org.apache.hadoop.fs.Path(p))]


def read_store(spark: SparkSession, root: str, schema: str, keys: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """A folder of ``<key>.json`` files (profiles, songs), or only those of some keys: (rows, rejected)."""
    paths = _scope(spark, root, keys, ".json")
    if not paths:
        kind = T.StructType.fromDDL(f"file STRING, {schema}")
        return spark.createDataFrame([], kind), spark.createDataFrame([], "file STRING")
    return read_documents(spark, paths, schema)


def read_runs(spark: SparkSession, root: str, users: list[str] | None = None, feedback_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """Runs in ``<user>/<run>.json``, of some users or all: (file, created_at, trajectory_id, value as a variant), in that order; skipped files.

    Skipped are files that don't parse or hold no object with those two names. feedback_only: runs with feedback events.
    """
    paths = _scope(spark, root, users, "/*.json")
    if not paths:
        return spark.createDataFrame([], "file STRING, created_at STRING, trajectory_id STRING, value VARIANT"), spark.createDataFrame([], "file STRING")
    raw = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.try_parse_json("value").alias("value"))
    name = lambda field: F.try_variant_get("value", f"$.{field}", "string").alias(field)
    rows = raw.select("file", name("created_at"), name("trajectory_id"), "value")
    good = F.col("created_at").isNotNull() & F.col("trajectory_id").isNotNull()
    events = F.coalesce(F.size(F.try_variant_get("value", "$.feedback_events", "array<variant>")), F.lit(0))
    kept = rows.where(good & (events > 0)) if feedback_only else rows.where(good)
    return kept.orderBy("created_at", "trajectory_id"), rows.where(~good).select("file")


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSONL without blank, broken or non-object lines."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def write_lines(df: DataFrame, path: str) -> None:
    """JSONL with the fields in order of name; refuses an existing target."""
    df.select(*sorted(df.columns)).write.json(path, ignoreNullFields=False)


def write_table(df: DataFrame, path: str) -> None:
    """CSV with a header; booleans as True and False; refuses an existing target."""
    text = [F.initcap(F.col(n).cast("string")).alias(n) if t == "boolean" else F.col(n) for n, t in df.dtypes]
    df.select(*text).write.csv(path, header=True)


def write_splits(df: DataFrame, path: str) -> None:
    """One folder for each split; refuses an existing target."""
    df.write.mode("errorifexists").partitionBy("split").json(path)


def split_manifest(runs: DataFrame, seed: int) -> DataFrame:
    """One row: runs and users of each split, and the seed. runs: user_id, trajectory_id, split."""
    per = runs.groupBy("split").agg(F.count(F.lit(1)).alias("runs"), F.count_distinct("user_id").alias("users"))
    counts = lambda c: F.map_from_entries(F.sort_array(F.collect_list(F.struct("split", c)))).alias(f"split_{c}")
    return per.agg(counts("runs"), counts("users"), F.lit(seed).alias("seed"))


def publish_splits(runs: DataFrame, path: str, seed: int) -> None:
    """One folder for each split, and then ``manifest``, whose presence says that the splits are whole; refuses an existing target."""
    write_splits(runs, f"{path}/splits")
    split_manifest(runs, seed).coalesce(1).write.mode("errorifexists").json(f"{path}/manifest")


#: Folders of a published table, by a hash of the key.
KEY_BUCKETS = 32


def publish(rows: DataFrame, path: str, key: str) -> None:
    """A new table in folders by buckets of its key, to which ``upsert`` can be applied."""
    bucket = F.pmod(F.xxhash64(key), F.lit(KEY_BUCKETS)).cast("int")
    rows.withColumn("bucket", bucket).hint("rebalance", "bucket").write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("bucket").parquet(path)


def upsert(spark: SparkSession, patches: DataFrame, path: str, key: str) -> None:
    """Patches applied to a published table: buckets without a patched key keep their files; the others are replaced as wholes.

    The new buckets are written beside the table first, so what is read is never what is being overwritten.
    """
    bucket = F.pmod(F.xxhash64(key), F.lit(KEY_BUCKETS)).cast("int")
    touched = [r[0] for r in patches.select(bucket.alias("b")).distinct().collect()]
    if touched:
        old = spark.read.parquet(path).where(F.col("bucket").isin(touched)).drop("bucket")
        publish(written(upserted(old, patches, key), "patched-buckets"), path, key)


def valid_ids(df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """Rows with a legal id, and the others."""
    good = F.coalesce(F.rlike(F.col(column), F.lit(ID)), F.lit(False))
    return df.where(good), df.where(~good)


def upserted(current: DataFrame, patches: DataFrame, key: str) -> DataFrame:
    """A new snapshot: a patch's non-null fields replace the old ones, and the version rises by one."""
    fields = [F.coalesce(F.col(f"p.{n}"), F.col(f"c.{n}")).alias(n) for n in current.columns if n not in (key, "version")]
    changed = F.when(F.col("p._patched"), F.coalesce(F.col("c.version"), F.lit(0)) + 1).otherwise(F.col("c.version"))
    marked = patches.withColumn("_patched", F.lit(True))
    both = current.alias("c").join(marked.alias("p"), key, "full_outer")
    return both.select(key, *fields, changed.alias("version"))
