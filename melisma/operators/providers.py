"""Provider tracks and agent steps: profile matches, reasons, ids, bounded search terms, search outcomes and the whole evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from melisma.functions.score import ratio


def _matched(kind: str, preferences: Column, hit) -> Column:
    """array<struct<reason, weight>> of the preferences that hit, in the map's order, weights held within 0 and 1."""
    entries = F.filter(F.coalesce(F.map_entries(preferences), F.array()), lambda e: F.coalesce(hit(F.lower(e["key"])), F.lit(False)))
    return F.transform(entries, lambda e: F.struct(F.concat(F.lit(f"{kind}:"), e["key"]).alias("reason"), F.greatest(F.lit(0.0), F.least(F.coalesce(e["value"], F.lit(0.0)), F.lit(1.0))).alias("weight")))


def profile_match(artist: Column, genres: Column, tags: Column, labels: Column, by_artist: Column, by_genre: Column, by_tag: Column) -> Column:
    """struct<score, reasons>: the matched weights' sum, 1 at most, and the first three matches; no match gives 0 and no reason.

    An artist's name may be part of the track's artist; a genre or tag equals one of the track's; any of them may be part of its labels.
    """
    lower = lambda a: F.transform(F.coalesce(a, F.array().cast("array<string>")), lambda x: F.lower(x))
    said = F.lower(F.coalesce(labels, F.lit("")))
    within = lambda x: F.contains(said, x)
    met = F.concat(
        _matched("artist", by_artist, lambda x: F.contains(F.lower(F.coalesce(artist, F.lit(""))), x) | within(x)),
        _matched("genre", by_genre, lambda x: F.array_contains(lower(genres), x) | within(x)),
        _matched("tag", by_tag, lambda x: F.array_contains(lower(tags), x) | within(x)),
    )
    score = F.least(F.aggregate(met, F.lit(0.0), lambda a, m: a + m["weight"]), F.lit(1.0))
    return F.struct(score.alias("score"), F.slice(met["reason"], 1, 3).alias("reasons"))


def provider_reasons(reference: Column, expanded: Column, query: Column, profile: Column, album_cut: Column, described: Column) -> Column:
    """The texts, in this order; a requested reference artist stands before an expanded one."""
    said = lambda condition, reason: F.when(condition, F.lit(reason))
    return F.array_compact(F.array(
        F.lit("found by external music provider search"),
        F.when(reference, F.lit("matches the requested reference artist")).when(expanded, F.lit("matches an expanded similar-artist seed")),
        said(query, "matches the current listening request"), said(profile, "matches user music profile"),
        said(album_cut, "prefers the main album/studio version"), said(described, "has enough metadata for explanation"),
    ))


def streaming_track_id(track_id: Column, url: Column) -> Column:
    """The last part of a ``spotify:track:`` id, else what stands in the url between ``/track/`` and ``?``; blank is null."""
    tail = F.substr(url, F.locate("/track/", url) + F.lit(7))
    from_url = F.when(F.contains(url, F.lit("/track/")), F.substring_index(tail, "?", 1))
    return F.nullif(F.when(F.startswith(track_id, F.lit("spotify:track:")), F.substring_index(track_id, ":", -1)).otherwise(from_url), F.lit(""))


def primary_artist(artist: Column, artists: Column) -> Column:
    """The artist, else the first of the artists."""
    return F.coalesce(artist, F.get(artists, F.lit(0)))


def in_chunks(rows: DataFrame, key: str, order: list[Column], size: int = 3) -> DataFrame:
    """chunk: the number of a row's batch within its list."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("chunk", F.floor((place - 1) / size))


def joined_terms(terms: DataFrame, key: str, budget: int = 180) -> DataFrame:
    """key, terms, n: distinct terms (case folded, blank ones out) by first place, joined by spaces up to the budget of characters.

    terms: key, pos, term. The first term stays at any length. Copies are aggregated before a list meets in one task.
    """
    named = terms.select(key, "pos", F.trim("term").alias("term")).where("term != ''")
    first = named.groupBy(key, F.lower("term").alias("folded")).agg(F.min_by("term", "pos").alias("term"), F.min("pos").alias("pos"))
    w = Window.partitionBy(key).orderBy("pos", "folded")
    placed = first.withColumn("n", F.row_number().over(w)).withColumn("used", F.sum(F.length("term") + 1).over(w) - 1)
    kept = placed.where((F.col("n") == 1) | (F.col("used") <= budget))
    ordered = F.sort_array(F.collect_list(F.struct("n", "term")))["term"]
    return kept.groupBy(key).agg(F.array_join(ordered, " ").alias("terms"), F.count(F.lit(1)).alias("n"))


def session_outcomes(steps: DataFrame, keys: list[str]) -> DataFrame:
    """decisions, search_failed and memory (its latest value) of each session, by partial aggregates alone.

    steps: keys, step, kind, search, found, retryable (booleans), memory (null where a step has none). A search failed if none
    found anything and one is retryable; without searches it did not fail. Decisions are tool, update and finish steps.
    """
    flag = lambda c: F.coalesce(F.max(c), F.lit(False))
    search = F.coalesce(F.col("search"), F.lit(False))
    return steps.groupBy(*keys).agg(
        F.count_if(F.col("kind").isin("tool", "update", "finish")).alias("decisions"),
        (~flag(search & F.col("found")) & flag(search & F.col("retryable"))).alias("search_failed"),
        F.max_by("memory", F.when(F.col("memory").isNotNull(), F.col("step"))).alias("memory"),
    )


def evaluation_report(runs: DataFrame) -> DataFrame:
    """One row: counts, rates and means over all trajectories; a rate without cases is 0.

    runs: user_id, session, stop_reason, mode, quantity_ok, fallback, latency and the counts recs, artists, calls, ok_calls,
    feedback, reward10, positive, negative, skips, favourites.
    """
    n, total = F.count(F.lit(1)), F.sum
    share = lambda condition: ratio(F.count_if(condition), n)
    of_feedback = lambda c: ratio(total(c), total("feedback"))
    return runs.agg(
        n.alias("trajectories"), F.count_distinct("user_id").alias("users"), F.count_distinct("session").alias("sessions"),
        share(F.col("stop_reason") == "goal_satisfied").alias("goal_satisfied_rate"), share(F.col("quantity_ok")).alias("quantity_satisfied_rate"),
        share(F.col("feedback") > 0).alias("feedback_coverage_rate"), ratio(total("recs"), n).alias("average_recommendations"), ratio(total("calls"), n).alias("average_tool_calls"),
        ratio(total("ok_calls"), total("calls")).alias("tool_call_success_rate"), share(F.col("fallback")).alias("fallback_rate"),
        ratio(total("reward10"), total("feedback") * 10).alias("average_reward"), of_feedback("positive").alias("positive_feedback_rate"), of_feedback("negative").alias("negative_feedback_rate"),
        of_feedback("skips").alias("skip_rate"), of_feedback("favourites").alias("favorite_rate"), ratio(total("artists"), total("recs")).alias("artist_diversity"),
        ratio(total("latency"), F.count("latency")).alias("average_latency"), F.count("latency").alias("latency_samples"),
        F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY latency)").alias("p95_latency"),
    )
