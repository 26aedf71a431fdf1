"""Session memory, agent tools and provider shapes: migrations, patches, inherited constraints, messages and track payloads."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from melisma.functions import constants as K
from melisma.functions import text

SESSION = "schema_version INT, session_id STRING, user_id STRING, turn_count INT, current_intent STRING, last_user_query STRING, preference_terms ARRAY<STRING>, exclude_terms ARRAY<STRING>, seen_track_ids ARRAY<STRING>, seen_song_ids ARRAY<STRING>, seed_track_ids ARRAY<STRING>, active_constraints MAP<STRING,STRING>, last_top_k STRING, last_max_per_artist STRING, last_min_retrieval_score STRING, last_run_id STRING, last_trajectory_id STRING"


def _texts(c: Column) -> Column:
    return F.coalesce(c, F.array().cast("array<string>"))


def string_list(c: Column) -> Column:
    """Trimmed texts once each, in order, without blank ones; null is an empty list."""
    return F.array_distinct(F.filter(F.transform(_texts(c), lambda x: F.trim(x)), lambda x: x != ""))


def optional_text(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def migrated_sessions(raw: DataFrame) -> DataFrame:
    """Sessions of any age (column ``value``, one JSON object a row) in today's fields; rows that don't parse are left out.

    Older limits fill constraints that are absent, older song ids an empty list of seen tracks. Terms that only refer to
    what was shown before are no exclusions. A field of the wrong type is as if absent.
    """
    s = raw.select(F.from_json("value", SESSION).alias("s")).select("s.*").where("session_id IS NOT NULL AND user_id IS NOT NULL")
    known = F.coalesce("active_constraints", F.create_map().cast("map<string,string>"))
    for field, old in (("limit", "last_top_k"), ("max_per_artist", "last_max_per_artist"), ("min_retrieval_score", "last_min_retrieval_score")):
        known = F.when(F.col(old).isNotNull() & ~F.map_contains_key(known, field), F.map_concat(known, F.create_map(F.lit(field), F.col(old)))).otherwise(known)
    reference = lambda x: F.rlike(F.regexp_replace(F.lower(x), r"\s+", " "), F.lit("|".join(K.SEEN_REFERENCES)))
    old_ids = (F.size(_texts(F.col("seen_song_ids"))) > 0) & (F.size(_texts(F.col("seen_track_ids"))) == 0)
    return s.select(
        F.coalesce("schema_version", F.lit(1)).alias("schema_version"), "session_id", "user_id", F.coalesce("turn_count", F.lit(0)).alias("turn_count"),
        F.coalesce("current_intent", F.lit("recommend")).alias("current_intent"), optional_text(F.col("last_user_query")).alias("last_user_query"),
        string_list(F.col("preference_terms")).alias("preference_terms"),
        F.filter(F.transform(_texts(F.col("exclude_terms")), lambda x: F.trim(x)), lambda x: (x != "") & ~reference(x)).alias("exclude_terms"),
        string_list(F.when(old_ids, F.col("seen_song_ids")).otherwise(F.col("seen_track_ids"))).alias("seen_track_ids"),
        string_list(F.col("seed_track_ids")).alias("seed_track_ids"), known.alias("active_constraints"),
        optional_text(F.coalesce("last_run_id", "last_trajectory_id")).alias("last_run_id"),
    )


def opened(wanted: DataFrame, sessions: DataFrame) -> DataFrame:
    """Each wanted session (session_id, user_id) with its stored fields and a status: loaded, created, or refused for another owner."""
    stored = sessions.withColumnRenamed("user_id", "_owner")
    met = wanted.join(stored, "session_id", "left")
    status = F.when(F.col("_owner").isNull(), "created").when(F.col("_owner") == F.col("user_id"), "loaded").otherwise("refused")
    return met.withColumn("status", status).drop("_owner")


def patched_sessions(sessions: DataFrame, patches: DataFrame) -> DataFrame:
    """Sessions with the fields that a patch names (not null there), and ``updated``: these fields' names in order.

    Texts are trimmed, lists normalised, constraints merged key by key; a blank intent is "recommend", a blank query null.
    """
    kinds = dict(sessions.dtypes)
    fields = [c for c in patches.columns if c != "session_id"]
    met = sessions.alias("s").join(patches.alias("p"), "session_id", "left")
    new: dict[str, Column] = {}
    for f in fields:
        old, given = F.col(f"s.{f}"), F.col(f"p.{f}")
        if f == "current_intent":
            value = F.coalesce(optional_text(given), F.lit("recommend"))
        elif kinds[f].startswith("array"):
            value = string_list(given)
        elif kinds[f].startswith("map"):
            value = F.map_concat(_without(old, given), given)
        else:
            value = optional_text(given)
        new[f] = F.when(given.isNotNull(), value).otherwise(old)
    updated = F.array_compact(F.array(*[F.when(F.col(f"p.{f}").isNotNull(), F.lit(f)) for f in fields]))
    return met.select(*[new[c].alias(c) if c in new else F.col(c) for c in sessions.columns], updated.alias("updated"))


def _without(m: Column, other: Column) -> Column:
    return F.map_filter(m, lambda k, _: ~F.map_contains_key(other, k))


def canonical_terms(terms: Column) -> Column:
    """Normal forms and what they stand for, once each, in order."""
    aliases = F.create_map(*[F.lit(x) for p in K.PREFERENCE_ALIASES.items() for x in p])
    named = F.filter(F.transform(_terms_or_none(terms), text.session_text), lambda x: x != "")
    return F.array_distinct(F.transform(named, lambda x: F.coalesce(F.try_element_at(aliases, x), x)))


def _terms_or_none(terms: Column) -> Column:
    return F.filter(_texts(terms), lambda x: x.isNotNull())


def inherited(request: dict[str, Column], session: dict[str, Column]) -> dict[str, Column]:
    """A "more" request with the session's constraints where it has none of its own; other requests as they are.

    request: query, intent, top_k, max_per_artist, min_score, preference_terms, exclude_terms. session: limit,
    max_per_artist, min_score (null or 0: none), preference_terms, exclude_terms.
    """
    more, low = request["intent"] == "more", F.lower(request["query"])
    asked = {"top_k": F.rlike(low, F.lit(K.EXPLICIT_COUNT)), "max_per_artist": F.rlike(low, F.lit("|".join(K.DIVERSITY_MARKERS))), "min_score": request["min_score"] > 0}
    out = dict(request)
    for field, limit in (("top_k", "limit"), ("max_per_artist", "max_per_artist"), ("min_score", "min_score")):
        from_session = F.coalesce(F.when(session[limit] != 0, session[limit]), request[field])
        out[field] = F.when(more & ~asked[field], from_session).otherwise(request[field])
    own = canonical_terms(request["preference_terms"])
    out["preference_terms"] = F.when(~more, request["preference_terms"]).when(F.size(own) > 0, own).otherwise(canonical_terms(session["preference_terms"]))
    out["exclude_terms"] = F.when(more, F.array_distinct(F.concat(session["exclude_terms"], request["exclude_terms"]))).otherwise(request["exclude_terms"])
    return out


def session_memory(turns: DataFrame, kept: int = K.MESSAGES_KEPT) -> DataFrame:
    """A session's memory after each micro-batch of turns (session_id, turn, role, text, ids: what an answer recommended).

    The state of a session is its seen ids, once each in order, its number of answers and its last ``kept`` messages
    that aren't blank. It grows with the recommendations of that one session only.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        answers, seen, at, sizes = state.get if state.exists else (0, [], [], [])
        known, at, sizes, last = dict.fromkeys(seen), list(at), list(sizes), 0
        for row in pd.concat(list(batches)).sort_values("turn").itertuples(index=False):
            said, last = (row.text or "").strip(), int(row.turn)
            if row.role == "assistant":
                answers += 1
                known.update(dict.fromkeys(int(x) for x in row.ids))
            if said:
                at.append(last)
                sizes.append(len(said))
        at, sizes = at[-kept:], sizes[-kept:]
        state.update((answers, list(known), at, sizes))
        yield pd.DataFrame({"session_id": [key[0]], "turn_count": answers, "seen": ",".join(map(str, known)), "messages": len(at), "first_kept": at[0] if at else -1, "chars": sum(sizes), "last_turn": last})

    shape = "session_id long, turn_count long, seen string, messages long, first_kept long, chars long, last_turn long"
    return turns.groupBy("session_id").applyInPandasWithState(fold, shape, "answers long, seen array<long>, at array<long>, sizes array<long>", "update", "NoTimeout")


def stable_json(arguments: Column) -> Column:
    """A JSON text with its keys in order at every depth and no spaces: the fingerprint of a tool's arguments. Broken text is null."""

    @F.pandas_udf("string")
    def dumped(values: pd.Series) -> pd.Series:
        return values.map(lambda v: _rewritten(v, lambda x: x, sort=True), na_action="ignore")

    return dumped(arguments)


def without_keys(value: Column, keys: tuple[str, ...] = ("user_id",)) -> Column:
    """A JSON text without these keys, at any depth. Broken text is null, so that nothing private passes."""

    def dropped(x):
        if isinstance(x, dict):
            return {k: dropped(v) for k, v in x.items() if k not in keys}
        return [dropped(v) for v in x] if isinstance(x, list) else x

    @F.pandas_udf("string")
    def redacted(values: pd.Series) -> pd.Series:
        return values.map(lambda v: _rewritten(v, dropped, sort=False), na_action="ignore")

    return redacted(value)


def _rewritten(value: str, change, sort: bool) -> str | None:
    try:
        return json.dumps(change(json.loads(value)), ensure_ascii=False, sort_keys=sort, separators=(",", ":"))
    except ValueError:
        return None


def label_list(value: Column) -> Column:
    """The keys of a JSON object or the items of a JSON list, without empty ones; of anything else, nothing."""
    listed = F.coalesce(F.json_object_keys(value), F.from_json(value, "array<string>"), F.array().cast("array<string>"))
    return F.filter(listed, lambda x: x != "")


def response_message(intent: Column, songs: Column, stop_reason: Column, attempts: Column, preference_terms: Column, exclude_terms: Column, max_per_artist: Column, searched: Column, from_search: Column) -> Column:
    """What the agent answers. The texts. ``searched``: a search ran; ``from_search``: a song came from one."""
    terms = F.filter(F.transform(exclude_terms, lambda x: F.trim(x)), lambda x: x != "")
    low = F.transform(terms, F.lower)
    punk, repeats = ("punk", "太朋克", "朋克"), ("重复的", "重复")
    named = F.exists(terms, lambda x: ~F.lower(x).isin(*punk, *repeats) & ~F.contains(x, F.lit("这种")))
    details = F.array(
        F.concat(F.lit("根据你的收藏画像和反馈，为你选出 "), songs.cast("string"), F.lit(" 首歌")), F.when(intent == "more", "已避开本次会话中展示过的歌曲"),
        F.when(F.size(preference_terms) > 0, F.concat(F.lit("偏好："), F.array_join(preference_terms, "、"))),
        F.when(F.exists(low, lambda x: x.isin(*punk)), "已避开太朋克的结果"), F.when(F.exists(low, lambda x: F.contains(x, F.lit("重复"))), "已避开重复结果"),
        F.when(F.exists(low, lambda x: F.rlike(x, F.lit("gallagher|noel|liam"))), "已避开 Gallagher 支线结果"), F.when(named, "已避开用户明确排除的艺人"),
        F.when(max_per_artist == 1, "已增强歌手多样性"), F.when(attempts > 1, F.concat(F.lit("经过 "), attempts.cast("string"), F.lit(" 次候选调整"))),
    )
    ending = F.when(from_search, "。每首歌都基于外部搜索结果和用户画像评分。").otherwise("。每首歌都保留了 L4 分数拆解和推荐原因。")
    nothing = F.when(searched, "外部音乐搜索已执行，但没有找到符合当前条件的歌曲。可以放宽年份、风格或数量要求后再试。").otherwise("执行了候选扩展和条件放宽，但当前曲库仍没有符合条件的歌曲。")
    return (
        F.when(stop_reason == "empty_profile", "收藏中还没有可用的种子歌曲，暂时无法生成推荐。")
        .when(stop_reason == "external_search_failed", "外部音乐搜索执行失败，暂时无法拿到候选歌曲。请稍后重试；如果持续失败，检查 Spotify 凭证或网络连接。")
        .when(songs == 0, nothing)
        .otherwise(F.concat(F.array_join(details, "；"), ending))
    )


def recorded_feedback(event: Column, run_id: Column, has_sink: Column) -> list[Column]:
    """feedback_type, reward10, status and suggested of an agent's event; a run without a sink to append to is partial."""
    mapped = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in K.AGENT_EVENTS.items() for x in p]), event), event)
    rewards = F.create_map(*[F.lit(x) for k, v in K.REWARDS.items() for x in (k, round(v * 10))])
    loose = run_id.isNotNull() & ~has_sink
    return [
        mapped.alias("feedback_type"), F.try_element_at(rewards, mapped).cast("bigint").alias("reward10"), F.when(loose, "partial").otherwise("ok").alias("status"),
        F.when(loose, tool_name(F.lit("L5.configure_trajectory_sink"))).alias("suggested"),
    ]


def tool_name(legacy: Column) -> Column:
    """Today's name of a tool; unknown names stay."""
    names = F.create_map(*[F.lit(x) for p in K.TOOL_NAMES.items() for x in p])
    return F.coalesce(F.try_element_at(names, legacy), legacy)


def track_metadata(requests: DataFrame, songs: DataFrame) -> DataFrame:
    """request_id, found, missing, status of requests (request_id, song_id); songs: song_id, status. A missing or partial song makes it partial."""
    met = requests.join(songs.select("song_id", F.col("status").alias("_status")), "song_id", "left")
    lost = F.sort_array(F.collect_list(F.when(F.col("_status").isNull(), F.col("song_id"))))
    whole = F.bool_and(F.coalesce(F.col("_status") == "ok", F.lit(False)))
    return met.groupBy("request_id").agg(F.count("_status").alias("found"), lost.alias("missing"), F.when(whole, "ok").otherwise("partial").alias("status"))


def search_report(queries: DataFrame, found: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """query, tracks, providers ("name=count" by name), status. found: query, provider; diagnostics: query, one row for each complaint."""
    counts = found.groupBy("query", "provider").agg(F.count(F.lit(1)).alias("n"))
    by_query = counts.groupBy("query").agg(F.sum("n").alias("tracks"), F.array_join(F.sort_array(F.collect_list(F.concat("provider", F.lit("="), F.col("n").cast("string")))), ",").alias("providers"))
    said = diagnostics.groupBy("query").agg(F.lit(True).alias("said"))
    met = queries.select("query").distinct().join(by_query, "query", "left").join(said, "query", "left")
    status = F.when(F.col("tracks").isNull(), "empty").when(F.col("said"), "partial").otherwise("ok")
    return met.select("query", F.coalesce("tracks", F.lit(0)).cast("bigint").alias("tracks"), F.coalesce("providers", F.lit("")).alias("providers"), status.alias("status"))


def ranked_shape(discovered: DataFrame) -> DataFrame:
    """Discovered tracks (rank, track_id, title, artist, provider, reason) in the shape of ranked songs."""
    track = F.trim(F.coalesce("track_id", F.lit("")))
    spotify = F.when(F.startswith(track, F.lit("spotify:track:")), F.nullif(F.substring_index(track, ":", -1), F.lit("")))
    given = F.coalesce("reason", F.lit("")) != ""
    return discovered.select(
        "rank", F.when(track != "", track).otherwise(F.concat("artist", F.lit("::"), "title")).alias("song_id"), "title", "artist", F.lit(0.0).alias("final_score"), F.lit(0.0).alias("diversity_penalty"),
        F.when(given, F.array("reason")).otherwise(F.array().cast("array<string>")).alias("ranking_reasons"),
        F.concat(F.coalesce(F.nullif("provider", F.lit("")), F.lit("provider")), F.lit("_discovery")).alias("retrieval_source"), spotify.alias("spotify_track_id"), spotify.isNotNull().alias("preview_available"),
    )


STREAMING = "id STRING, name STRING, duration_ms BIGINT, preview_url STRING, album STRUCT<name STRING, release_date STRING, images ARRAY<STRUCT<url STRING>>>, artists ARRAY<STRUCT<id STRING, name STRING>>"
COLLECTED = "source STRING, spotify_track_id STRING, musicbrainz_recording_id STRING, title STRING, artists ARRAY<STRING>, album STRING, release_year INT, duration_ms BIGINT"


def streaming_track(raw: Column) -> Column:
    """A streaming provider's JSON track as one struct: track_id, provider, title, artist, album, release_year, duration_ms, image_url."""
    t = F.from_json(raw, STREAMING)
    names = F.filter(F.transform(t["artists"], lambda a: a["name"]), lambda n: n != "")
    date = F.coalesce(t["album"]["release_date"], F.lit(""))
    return F.struct(
        F.when(F.coalesce(t["id"], F.lit("")) != "", F.concat(F.lit("spotify:track:"), t["id"])).otherwise("").alias("track_id"), F.lit("spotify").alias("provider"), F.coalesce(t["name"], F.lit("")).alias("title"),
        F.coalesce(F.get(names, F.lit(0)), F.lit("")).alias("artist"), t["album"]["name"].alias("album"), F.nullif(F.regexp_extract(date, r"^(\d{4})", 1), F.lit("")).cast("int").alias("release_year"),
        t["duration_ms"].alias("duration_ms"), F.get(t["album"]["images"], F.lit(0))["url"].alias("image_url"),
    )


def collected_track(raw: Column) -> Column:
    """A collector's JSON track in the same struct; the id names the first catalogue that knows it, else source and title."""
    t = F.from_json(raw, COLLECTED)
    has = lambda f: F.coalesce(t[f], F.lit("")) != ""
    source = F.replace(F.lower(F.coalesce(t["source"], F.lit("collector"))), F.lit("."), F.lit(""))
    provider = F.when(has("spotify_track_id"), "spotify").when(has("musicbrainz_recording_id"), "musicbrainz").otherwise(source)
    ident = F.when(has("spotify_track_id"), F.concat(F.lit("spotify:track:"), t["spotify_track_id"])).when(has("musicbrainz_recording_id"), F.concat(F.lit("musicbrainz:recording:"), t["musicbrainz_recording_id"]))
    title = F.coalesce(t["title"], F.lit(""))
    return F.struct(
        F.coalesce(ident, F.concat(source, F.lit(":track:"), title)).alias("track_id"), provider.alias("provider"), title.alias("title"), F.coalesce(F.get(F.filter(t["artists"], lambda n: n != ""), F.lit(0)), F.lit("")).alias("artist"),
        t["album"].alias("album"), t["release_year"].alias("release_year"), t["duration_ms"].alias("duration_ms"), F.lit(None).cast("string").alias("image_url"),
    )


def album_song_id(album_key: Column, number: Column, title: Column) -> Column:
    """The id of a catalogue's track: album, number of at least two digits and the title's slug, where ? is a word."""
    return F.concat_ws("-", album_key, F.format_string("%02d", number), text.slug(F.replace(title, F.lit("?"), F.lit("-question"))))


def with_feedback(trajectories: DataFrame, feedback: DataFrame) -> DataFrame:
    """Trajectories (trajectory_id, events) with new feedback (trajectory_id, seq, kind, song_id) appended in order, and ``writes``:
    the songs that it adds to the collection."""
    entry = F.struct("seq", "kind", "song_id")
    new = feedback.groupBy("trajectory_id").agg(F.sort_array(F.collect_list(entry)).alias("_new"))
    met = trajectories.join(new, "trajectory_id", "left")
    added = F.coalesce("_new", F.slice("events", 1, 0))
    kept = F.transform(F.filter(added, lambda e: e["kind"].isin(*K.COLLECTING_FEEDBACK)), lambda e: e["song_id"])
    return met.select("trajectory_id", F.concat("events", added).alias("events"), kept.alias("writes"))


def loaded_profiles(users: DataFrame, profiles: DataFrame) -> DataFrame:
    """Each user's profile (ids, feedback, version), or an empty one of version 1; ``created`` tells which."""
    met = users.select("user_id").distinct().join(profiles.select("user_id", "ids", "feedback", "version"), "user_id", "left")
    none = F.array().cast("array<bigint>")
    return met.select("user_id", F.coalesce("ids", none).alias("ids"), F.coalesce("feedback", none).alias("feedback"), F.coalesce("version", F.lit(1)).alias("version"), F.col("version").isNull().alias("created"))
