"""Queries on provider tracks, agent sessions and the whole evaluation, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from melisma.operators import feedback as fb
from melisma.operators import providers as pr
from melisma.plans.recommend import PREFS, query
from melisma.sources import adapters as ad


@query(PREFS + """,
tracks AS (
    SELECT seq, f.user_id, lower(artist) AS artist, CASE WHEN seq % 2 = 0 THEN lower(genre) END AS genre, lower(split_part(title, ' ', 1)) AS tag,
           lower(split_part(title, ' ', 2) || CASE WHEN seq % 3 = 0 THEN ' ' || genre ELSE '' END) AS labels
    FROM feedback f JOIN songs USING (song_id)),
met AS (
    SELECT seq, kind || ':' || label AS reason, least(weight4 / 10000.0, 1)::DOUBLE AS weight FROM tracks t JOIN prefs p USING (user_id)
    WHERE contains(labels, lower(label)) OR (kind = 'artist' AND contains(artist, lower(label))) OR (kind = 'genre' AND genre = lower(label)) OR (kind = 'tag' AND tag = lower(label))),
scores AS (SELECT seq, least(sum(weight), 1) AS score, list(reason ORDER BY reason)[:3] AS reasons FROM met GROUP BY seq)
SELECT seq, round(coalesce(score, 0), 6) AS score, coalesce(array_to_string(reasons, ', '), '') AS reasons FROM tracks LEFT JOIN scores USING (seq)
""")
def sc22_profile_match(spark, sf_dir):
    prefs = fb.rebuilt_preferences(ad.collection(spark, sf_dir), ad.songs(spark, sf_dir), ad.tags(spark, sf_dir))
    of = lambda kind: F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.struct("label", (F.col("weight4") / 10000.0).alias("weight")))))).alias(kind)
    profiles = prefs.groupBy("user_id").agg(of("artist"), of("genre"), of("tag"))
    word = lambda i: F.get(F.split("title", " "), F.lit(i))
    songs = ad.songs(spark, sf_dir).select("song_id", F.col("artist").alias("by"), F.col("genre").alias("style"), word(0).alias("first"), word(1).alias("second"))
    tracks = ad.feedback(spark, sf_dir).select("seq", "user_id", "song_id").join(songs, "song_id").join(profiles, "user_id", "left")
    labels = F.concat_ws(" ", "second", F.when(F.col("seq") % 3 == 0, F.col("style")))
    met = pr.profile_match(F.col("by"), F.when(F.col("seq") % 2 == 0, F.array("style")), F.array("first"), labels, F.col("artist"), F.col("genre"), F.col("tag"))
    return tracks.select("seq", met.alias("m")).select("seq", F.round("m.score", 6).alias("score"), F.array_join("m.reasons", ", ").alias("reasons"))


@query("""
SELECT song_id, CASE WHEN song_id % 5 = 0 THEN song_id::VARCHAR WHEN song_id % 5 = 2 THEN split_part(title, ' ', 1) || song_id WHEN song_id % 5 = 3 THEN song_id || '-' || year END AS track_id,
       CASE WHEN song_id % 3 <> 0 THEN artist WHEN song_id % 2 = 0 THEN split_part(title, ' ', 1) END AS main_artist,
       concat_ws('; ', 'found by external music provider search', CASE WHEN year < 1980 THEN 'matches the requested reference artist' WHEN year < 1990 THEN 'matches an expanded similar-artist seed' END,
           CASE WHEN confidence10 > 5 THEN 'matches the current listening request' END, CASE WHEN duration_ms % 2 = 0 THEN 'matches user music profile' END,
           CASE WHEN confidence10 < 3 THEN 'prefers the main album/studio version' END, CASE WHEN year % 2 = 0 THEN 'has enough metadata for explanation' END) AS reasons FROM songs
""")
def tl15_tl17_provider_tracks(spark, sf_dir):
    k, year, sure, first = F.col("song_id"), F.col("year"), F.col("confidence10"), F.get(F.split("title", " "), F.lit(0))
    text = k.cast("string")
    track = F.when(k % 5 == 0, F.concat(F.lit("spotify:track:"), text)).when(k % 5 == 1, F.lit("spotify:track:"))
    url = F.when(k % 5 == 1, F.lit("https://music.test/track/unused")).when(k % 5 == 2, F.concat(F.lit("https://music.test/track/"), first, text, F.lit("?si=track/1"))).when(k % 5 == 3, F.concat(F.lit("https://music.test/track/"), text, F.lit("-"), year.cast("string"))).otherwise(F.lit("https://music.test/album/1"))
    artists = F.when(k % 2 == 0, F.array(first, F.col("genre"))).otherwise(F.array().cast("array<string>"))
    reasons = pr.provider_reasons(year < 1980, year < 1990, sure > 5, F.col("duration_ms") % 2 == 0, sure < 3, year % 2 == 0)
    return ad.songs(spark, sf_dir).select("song_id", pr.streaming_track_id(track, url).alias("track_id"), pr.primary_artist(F.when(k % 3 != 0, F.col("artist")), artists).alias("main_artist"), F.array_join(reasons, "; ").alias("reasons"))


@query("""
SELECT user_id, song_id, (row_number() OVER (PARTITION BY user_id ORDER BY first_order, song_id) - 1) // 3 AS chunk FROM collection
""")
def top7_chunks(spark, sf_dir):
    return pr.in_chunks(ad.collection(spark, sf_dir).select("user_id", "song_id", "first_order"), "user_id", [F.col("first_order"), F.col("song_id")]).select("user_id", "song_id", "chunk")


@query("""
named AS (SELECT user_id, first_order * 1000000000 + song_id AS pos, CASE WHEN song_id % 2 = 0 THEN upper(title) ELSE '  ' || title END AS term FROM collection JOIN songs USING (song_id)),
firsts AS (SELECT user_id, lower(trim(term)) AS folded, arg_min(trim(term), pos) AS term, min(pos) AS pos FROM named GROUP BY ALL),
placed AS (SELECT *, row_number() OVER w AS n, sum(length(term) + 1) OVER w - 1 AS used FROM firsts WINDOW w AS (PARTITION BY user_id ORDER BY pos, folded ROWS UNBOUNDED PRECEDING))
SELECT user_id, string_agg(term, ' ' ORDER BY n) AS terms, count(*) AS n FROM placed WHERE n = 1 OR used <= 180 GROUP BY user_id
""")
def top7_joined_terms(spark, sf_dir):
    named = ad.collection(spark, sf_dir).join(ad.songs(spark, sf_dir).select("song_id", "title"), "song_id")
    term = F.when(F.col("song_id") % 2 == 0, F.upper("title")).otherwise(F.concat(F.lit("  "), "title"))
    return pr.joined_terms(named.select("user_id", (F.col("first_order") * 1000000000 + F.col("song_id")).alias("pos"), term.alias("term")), "user_id")


@query("""
told AS (SELECT user_id, strftime(ts, '%Y-%m') AS month, seq, kind, song_id, value100 FROM feedback)
SELECT user_id, month, count(*) FILTER (WHERE kind <> 'play') AS decisions,
       NOT bool_or(kind = 'play' AND value100 % 3 = 0) AND bool_or(kind = 'play' AND value100 % 2 = 0) AS search_failed, arg_max(song_id, seq) FILTER (WHERE kind = 'favorite') AS memory FROM told GROUP BY ALL
""")
def flt17_tl19_tl20_session_outcomes(spark, sf_dir):
    kind, v = F.col("kind"), F.col("value100")
    step = F.when(kind == "play", "answer").when(kind == "like", "update").when(kind == "dislike", "finish").otherwise("tool")
    steps = ad.feedback(spark, sf_dir).select(
        "user_id", F.date_format("ts", "yyyy-MM").alias("month"), F.col("seq").alias("step"), step.alias("kind"), (kind == "play").alias("search"),
        (v % 3 == 0).alias("found"), (v % 2 == 0).alias("retryable"), F.when(kind == "favorite", F.col("song_id")).alias("memory"),
    )
    return pr.session_outcomes(steps, ["user_id", "month"])


RUNS = """
runs AS (
    SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, CASE WHEN user_id % 7 <> 0 THEN user_id || '/' || strftime(ts, '%Y-%m') END AS session,
           CASE WHEN bool_or(kind = 'playlist_add') THEN 'goal_satisfied' WHEN min(seq) % 3 = 0 THEN 'step_limit' ELSE 'no_progress' END AS stop_reason, CASE WHEN min(seq) % 4 = 0 THEN 'fallback' ELSE 'agent' END AS mode,
           count(*) >= 2 AS quantity_ok, min(seq) % 4 = 0 AS fallback, CASE WHEN min(seq) % 10 <> 0 THEN sum(value100) END::BIGINT AS latency, count(DISTINCT song_id) AS recs, count(DISTINCT artist) AS artists,
           count(*) AS calls, count(*) FILTER (WHERE value100 % 4 <> 0) AS ok_calls, count(*) FILTER (WHERE kind <> 'play') AS feedback, coalesce(sum(reward10) FILTER (WHERE kind <> 'play'), 0)::BIGINT AS reward10,
           count(*) FILTER (WHERE kind <> 'play' AND reward10 > 0) AS positive, count(*) FILTER (WHERE reward10 < 0) AS negative, count(*) FILTER (WHERE kind = 'dislike' AND value100 % 2 = 0) AS skips,
           count(*) FILTER (WHERE kind IN ('favorite', 'playlist_add')) AS favourites FROM feedback JOIN songs USING (song_id) GROUP BY user_id, strftime(ts, '%Y-%m-%d'), strftime(ts, '%Y-%m'))
"""


def _runs(spark, sf_dir):
    """One row for each user and day, by partial sums; no list of steps is gathered."""
    f = ad.feedback(spark, sf_dir).join(ad.songs(spark, sf_dir).select("song_id", "artist"), "song_id")
    kind, reward, v, first, count = F.col("kind"), F.col("reward10"), F.col("value100"), F.min("seq"), F.count_if
    runs = f.groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.date_format("ts", "yyyy-MM").alias("month")).agg(
        F.when(F.max(kind == "playlist_add"), "goal_satisfied").when(first % 3 == 0, "step_limit").otherwise("no_progress").alias("stop_reason"), F.when(first % 4 == 0, "fallback").otherwise("agent").alias("mode"),
        (F.count(F.lit(1)) >= 2).alias("quantity_ok"), (first % 4 == 0).alias("fallback"), F.when(first % 10 != 0, F.sum("value100")).alias("latency"), F.count_distinct("song_id").alias("recs"), F.count_distinct("artist").alias("artists"),
        F.count(F.lit(1)).alias("calls"), count(v % 4 != 0).alias("ok_calls"), count(kind != "play").alias("feedback"), F.coalesce(F.sum(F.when(kind != "play", reward)), F.lit(0)).alias("reward10"),
        count((kind != "play") & (reward > 0)).alias("positive"), count(reward < 0).alias("negative"), count((kind == "dislike") & (v % 2 == 0)).alias("skips"), count(kind.isin("favorite", "playlist_add")).alias("favourites"),
    )
    return runs.withColumn("session", F.when(F.col("user_id") % 7 != 0, F.concat_ws("/", F.col("user_id").cast("string"), "month")))


def _share(a: str, b: str) -> str:
    return f"coalesce(({a})::DOUBLE / nullif(({b})::DOUBLE, 0), 0)"


REPORT = ", ".join(f"{sql} AS {name}" for name, sql in {
    "trajectories": "count(*)", "users": "count(DISTINCT user_id)", "sessions": "count(DISTINCT session)", "goal_satisfied_rate": _share("count(*) FILTER (WHERE stop_reason = 'goal_satisfied')", "count(*)"),
    "quantity_satisfied_rate": _share("count(*) FILTER (WHERE quantity_ok)", "count(*)"), "feedback_coverage_rate": _share("count(*) FILTER (WHERE feedback > 0)", "count(*)"),
    "average_recommendations": _share("sum(recs)", "count(*)"), "average_tool_calls": _share("sum(calls)", "count(*)"), "tool_call_success_rate": _share("sum(ok_calls)", "sum(calls)"),
    "fallback_rate": _share("count(*) FILTER (WHERE fallback)", "count(*)"), "average_reward": _share("sum(reward10)", "sum(feedback) * 10"), "positive_feedback_rate": _share("sum(positive)", "sum(feedback)"),
    "negative_feedback_rate": _share("sum(negative)", "sum(feedback)"), "skip_rate": _share("sum(skips)", "sum(feedback)"), "favorite_rate": _share("sum(favourites)", "sum(feedback)"),
    "artist_diversity": _share("sum(artists)", "sum(recs)"), "average_latency": _share("sum(latency)", "count(latency)"), "latency_samples": "count(latency)", "p95_latency": "percentile_disc(0.95) WITHIN GROUP (ORDER BY latency)",
}.items())


@query(RUNS + f"SELECT {REPORT} FROM runs")
def agg9_evaluation_report(spark, sf_dir):
    return pr.evaluation_report(_runs(spark, sf_dir))


@query(RUNS + f"SELECT {REPORT} FROM runs WHERE feedback > 0 AND user_id % 2 = 1")
def flt15_scoped_evaluation(spark, sf_dir):
    """Trajectories with feedback alone, of the users asked for (the odd ones)."""
    return pr.evaluation_report(_runs(spark, sf_dir).where("feedback > 0 AND user_id % 2 = 1"))


@query(RUNS + """
SELECT 'stop_reason' AS histogram, stop_reason AS value, count(*) AS n FROM runs GROUP BY ALL UNION ALL SELECT 'agent_mode', mode, count(*) FROM runs GROUP BY ALL
UNION ALL SELECT 'feedback_type', kind, count(*) FROM feedback JOIN songs USING (song_id) WHERE kind <> 'play' GROUP BY ALL
""")
def agg9_histograms(spark, sf_dir):
    pair = lambda name, c: F.struct(F.lit(name).alias("histogram"), F.col(c).alias("value"))
    runs = _runs(spark, sf_dir).select(F.inline(F.array(pair("stop_reason", "stop_reason"), pair("agent_mode", "mode"))))
    told = ad.feedback(spark, sf_dir).where("kind != 'play'").join(ad.songs(spark, sf_dir).select("song_id"), "song_id").select(F.lit("feedback_type").alias("histogram"), F.col("kind").alias("value"))
    return runs.unionByName(told).groupBy("histogram", "value").agg(F.count(F.lit(1)).alias("n"))
