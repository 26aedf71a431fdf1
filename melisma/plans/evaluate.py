"""Queries on ranking, trajectories, splits and samples, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from melisma.operators import dataset as ds
from melisma.operators import feedback as fb
from melisma.operators import ranking as rk
from melisma.operators import retrieval as rt
from melisma.plans.recommend import GRID, PREFS, SIMS, query, scored
from melisma.session import written
from melisma.sources import adapters as ad

POOL = GRID.replace("{k}", "100") + "," + PREFS + "," + SIMS + """,
moved AS (SELECT user_id, r AS song_id, greatest(-1000000, least(1000000, floor(sum(reward10 * sim6)::DOUBLE / 10 + 0.5)))::BIGINT AS score6 FROM feedback f JOIN sims ON l = f.song_id GROUP BY user_id, r),
labelled AS (
    SELECT song_id, 'artist' AS kind, lower(artist) AS key, 10000::BIGINT AS w FROM songs
    UNION ALL SELECT song_id, CASE WHEN field = 'genres' THEN 'genre' ELSE 'tag' END, lower(label), max(w) FROM tags GROUP BY ALL),
wanted AS (SELECT user_id, kind, lower(label) AS key, max(weight4) AS weight4 FROM prefs GROUP BY ALL),
met AS (SELECT t.user_id, t.song_id, kind, sum(least(w, weight4))::BIGINT AS shared, max(weight4) AS top FROM top t JOIN labelled USING (song_id) JOIN wanted USING (user_id, kind, key) GROUP BY ALL),
jac AS (
    SELECT user_id, song_id, kind, top, shared::DOUBLE / (a.n + b.n - shared)::DOUBLE AS j FROM met
    JOIN (SELECT song_id, kind, sum(w) AS n FROM labelled GROUP BY ALL) a USING (song_id, kind) JOIN (SELECT user_id, kind, sum(weight4) AS n FROM wanted GROUP BY ALL) b USING (user_id, kind)),
raws AS (
    SELECT user_id, song_id, similarity / 1e6 AS retrieval_raw, coalesce(max(top) FILTER (WHERE kind = 'artist'), 0) / 10000.0::DOUBLE AS artist_raw,
           coalesce(max(j) FILTER (WHERE kind = 'genre'), 0) AS genre_raw, coalesce(max(j) FILTER (WHERE kind = 'tag'), 0) AS tag_raw,
           any_value(confidence10) / 10.0::DOUBLE AS quality_raw, coalesce(any_value(score6), 0) / 1e6 AS feedback_raw
    FROM top t JOIN songs USING (song_id) LEFT JOIN jac USING (user_id, song_id) LEFT JOIN moved USING (user_id, song_id) GROUP BY user_id, song_id, similarity),
based AS (
    SELECT *, floor(0.5::DOUBLE * retrieval_raw * 1e6 + 0.5)::BIGINT AS retrieval_part, floor(0.08::DOUBLE * artist_raw * 1e6 + 0.5)::BIGINT AS artist_part,
           floor(0.14::DOUBLE * genre_raw * 1e6 + 0.5)::BIGINT AS genre_part, floor(0.18::DOUBLE * tag_raw * 1e6 + 0.5)::BIGINT AS tag_part,
           floor(0.1::DOUBLE * quality_raw * 1e6 + 0.5)::BIGINT AS quality_part, floor(0.15::DOUBLE * feedback_raw * 1e6 + 0.5)::BIGINT AS feedback_part FROM raws)
"""


def ranked_pool(spark, sf_dir):
    """The base scores of each asked user's hundred best candidates."""
    songs, tags, c = ad.songs(spark, sf_dir), ad.tags(spark, sf_dir), ad.collection(spark, sf_dir)
    pool = written(rt.top_candidates(scored(spark, sf_dir, 100, ["user_id", "song_id", "similarity"]), 100), "pool")
    prefs = fb.rebuilt_preferences(c.where("user_id % 20 = 0"), songs, tags)
    return rk.base_scores(pool, prefs, songs, tags, fb.transferred_feedback(ad.feedback(spark, sf_dir), songs, tags, pool))


@query(POOL + "SELECT user_id, song_id, retrieval_part, artist_part, genre_part, tag_part, quality_part, feedback_part, retrieval_part + artist_part + genre_part + tag_part + quality_part + feedback_part AS base FROM based")
def sc16_jn6_jn7_base_score(spark, sf_dir):
    parts = [f"{k}_part" for k in ("retrieval", "artist", "genre", "tag", "quality", "feedback")]
    return ranked_pool(spark, sf_dir).select("user_id", "song_id", *parts, "base")


@query(POOL + """,
said AS (
    SELECT user_id, song_id, 1 AS n, 0.0::DOUBLE AS r, '' AS k, CASE WHEN retrieval_raw >= 0.5 THEN 'strong similarity to the collection seeds' WHEN retrieval_raw > 0 THEN 'retrieved from collection-level song similarity' END AS t FROM based
    UNION ALL SELECT user_id, song_id, 2, 0, '', CASE WHEN feedback_raw >= 0.25 THEN 'promoted by positive feedback' WHEN feedback_raw <= -0.25 THEN 'penalized by negative feedback' END FROM based
    UNION ALL SELECT user_id, song_id, 3, -artist_raw, 'artist', CASE WHEN artist_raw >= 0.1 THEN 'matches a preferred artist' END FROM based
    UNION ALL SELECT user_id, song_id, 3, -genre_raw, 'genre', CASE WHEN genre_raw >= 0.1 THEN 'matches the collection genre profile' END FROM based
    UNION ALL SELECT user_id, song_id, 3, -tag_raw, 'tag', CASE WHEN tag_raw >= 0.1 THEN 'matches the collection tag profile' END FROM based
    UNION ALL SELECT user_id, song_id, 4, 0, '', CASE WHEN quality_raw >= 0.8 THEN 'high-confidence song profile' END FROM based)
SELECT user_id, song_id, coalesce(array_to_string((list(t ORDER BY n, r, k) FILTER (WHERE t IS NOT NULL))[:4], '; '), 'selected from the L3 candidate pool') AS reasons FROM said GROUP BY ALL
""")
def sc30_ranking_reasons(spark, sf_dir):
    return ranked_pool(spark, sf_dir).select("user_id", "song_id", F.array_join(rk.reasons(F.lit(0.0)), "; ").alias("reasons"))


@query()
def win4_win5_diversity_rerank(spark, sf_dir):
    tags = ad.tags(spark, sf_dir)
    labels = lambda wanted, name: tags.where(wanted).groupBy("song_id").agg(F.collect_list(F.struct("label", "w")).alias(name))
    merged = fb.tag_union(tags).groupBy("song_id").agg(F.collect_list(F.struct("label", "w")).alias("tags"))
    pool = ranked_pool(spark, sf_dir).select("user_id", "song_id", "base").join(ad.songs(spark, sf_dir).select("song_id", "artist"), "song_id")
    pool = pool.join(labels("field = 'genres'", "genres"), "song_id").join(merged, "song_id")
    pairs = lambda p: p.assign(genres=p.genres.map(lambda v: [(x["label"], x["w"]) for x in v]), tags=p.tags.map(lambda v: [(x["label"], x["w"]) for x in v]))
    return pool.groupBy("user_id").applyInPandas(lambda p: rk.diversify(pairs(p), 20, 2), "user_id long, rank long, song_id long, final double, penalty double")


RECORDS = """
records AS (
    SELECT trajectory_id, any_value(user_id) AS user_id, 'user_' || substr(sha256('salt:' || any_value(user_id)), 1, 16) AS user_key, any_value(day) AS day, count(*) AS events,
           count(*) FILTER (WHERE reward10 > 0) AS positive, count(*) FILTER (WHERE reward10 < 0) AS negative, count(*) FILTER (WHERE kind = 'favorite') AS favorites,
           sum(reward10)::BIGINT AS reward10, count(DISTINCT song_id) AS songs, count(DISTINCT song_id % 10) AS artists, sum(value100)::BIGINT AS latency,
           bool_or(kind = 'playlist_add') AS goal_reached, arg_max(kind, seq) AS stop_reason FROM steps GROUP BY trajectory_id)
"""


def _records(spark, sf_dir):
    return ds.records(ad.trajectories(spark, sf_dir))


@query(RECORDS + "SELECT * EXCLUDE user_id FROM records")
def prj3_dataset_record(spark, sf_dir):
    return _records(spark, sf_dir)


@query(RECORDS + """
SELECT count(*) AS trajectories, count(DISTINCT user_key) AS users, sum(events)::BIGINT AS events, count(*) FILTER (WHERE goal_reached)::DOUBLE / count(*) AS goal_rate,
       sum(reward10)::DOUBLE / (sum(events) * 10)::DOUBLE AS average_reward, sum(positive)::DOUBLE / sum(events)::DOUBLE AS positive_rate, sum(negative)::DOUBLE / sum(events)::DOUBLE AS negative_rate,
       sum(favorites)::DOUBLE / sum(events)::DOUBLE AS favorite_rate, sum(artists)::DOUBLE / sum(songs)::DOUBLE AS diversity, sum(latency)::DOUBLE / count(*) AS mean_latency,
       quantile_disc(latency, 0.95) AS p95_latency FROM records
""")
def agg9_agg10_agg11_evaluate(spark, sf_dir):
    return ds.evaluation(_records(spark, sf_dir))


@query(RECORDS + "SELECT stop_reason AS value, count(*) AS trajectories FROM records GROUP BY ALL")
def agg9_stop_reasons(spark, sf_dir):
    return ds.histogram(_records(spark, sf_dir), "stop_reason")


@query("""
scores AS (SELECT rank, (song_id + 1) / 100.0::DOUBLE AS x, reward10 FROM steps),
keyed AS (
    SELECT 'rank' AS dim, rank::VARCHAR AS key, reward10 AS r FROM scores
    UNION ALL SELECT 'bucket', CASE WHEN x >= 1 THEN '1.0-1.0' ELSE printf('%.1f-%.1f', floor(x * 5) / 5, floor(x * 5) / 5 + 0.2::DOUBLE) END, reward10 FROM scores)
SELECT dim, key, count(*) AS events, sum(r)::BIGINT AS reward10, count(*) FILTER (WHERE r > 0)::DOUBLE / count(*) AS positive_rate, count(*) FILTER (WHERE r < 0)::DOUBLE / count(*) AS negative_rate FROM keyed GROUP BY ALL
""")
def agg12_agg13_rank_feedback(spark, sf_dir):
    return ds.rank_analysis(ad.trajectories(spark, sf_dir))


TOTALS = """
per AS (SELECT trajectory_id, count(*) AS generated, count(*) FILTER (WHERE reward10 >= 0) AS grounded, count(*) FILTER (WHERE value100 > 500) AS thought FROM steps GROUP BY ALL),
totals AS (
    SELECT count(*) AS trajectories, sum(generated)::BIGINT AS generated, sum(grounded)::BIGINT AS grounded, sum(generated - grounded)::BIGINT AS dropped,
           sum(grounded)::DOUBLE / sum(generated)::DOUBLE AS grounding_rate, sum(thought)::DOUBLE / sum(generated)::DOUBLE AS thought_coverage,
           sum(generated - grounded)::DOUBLE / sum(generated)::DOUBLE AS hallucination_rate FROM per)
"""


@query(TOTALS + "SELECT * FROM totals")
def agg14_trajectory_quality(spark, sf_dir):
    return ds.quality_totals(ad.trajectories(spark, sf_dir))


@query(TOTALS + "SELECT 'hallucination' AS check, hallucination_rate <= 0.5 AS passed FROM totals UNION ALL SELECT 'grounding', grounding_rate >= 0.3 FROM totals UNION ALL SELECT 'thought', thought_coverage >= 0.9 FROM totals")
def ct9_quality_gate(spark, sf_dir):
    return ds.quality_gate(ds.quality_totals(ad.trajectories(spark, sf_dir)))


@query(RECORDS + """,
armed AS (SELECT *, CASE WHEN substr(user_key, 6, 1) < '8' THEN 'a' ELSE 'b' END AS arm FROM records),
means AS (
    SELECT arm, sum(goal_reached::INT)::DOUBLE / count(*) AS goal_rate, sum(reward10)::DOUBLE / sum(events)::DOUBLE AS reward10, sum(artists)::DOUBLE / sum(songs)::DOUBLE AS diversity, sum(latency)::DOUBLE / count(*) AS latency FROM armed GROUP BY arm),
long AS (UNPIVOT means ON goal_rate, reward10, diversity, latency INTO NAME metric VALUE v)
SELECT metric, max(v) FILTER (WHERE arm = 'a') AS a, max(v) FILTER (WHERE arm = 'b') AS b, max(v) FILTER (WHERE arm = 'b') - max(v) FILTER (WHERE arm = 'a') AS delta FROM long GROUP BY metric
""")
def agg15_ab_delta(spark, sf_dir):
    return ds.ab_deltas(_records(spark, sf_dir), F.when(F.substring("user_key", 6, 1) < "8", "a").otherwise("b"))


SPLITS = """
users AS (SELECT DISTINCT user_id FROM feedback),
counted AS (SELECT count(*) AS n FROM users),
exact AS (SELECT n, floor(n * 0.8::DOUBLE) AS a, floor(n * 0.1::DOUBLE) AS b, floor(n * 0.1::DOUBLE) AS c, n * 0.8::DOUBLE AS xa, n * 0.1::DOUBLE AS xb FROM counted),
rems AS (SELECT 0 AS i, a AS got, xa AS x, n FROM exact UNION ALL SELECT 1, b, xb, n FROM exact UNION ALL SELECT 2, c, xb, n FROM exact),
filled AS (SELECT i, got + CASE WHEN row_number() OVER (ORDER BY got - x, i) <= n - sum(got) OVER () THEN 1 ELSE 0 END AS got FROM rems),
ends AS (SELECT i, sum(got) OVER (ORDER BY i) AS upto FROM filled),
placed AS (SELECT user_id, row_number() OVER (ORDER BY sha256('20260615:' || user_id)) AS place FROM users),
splits AS (SELECT user_id, CASE min(i) WHEN 0 THEN 'train' WHEN 1 THEN 'validation' ELSE 'test' END AS split FROM placed JOIN ends ON place <= upto GROUP BY user_id)
"""


@query(SPLITS + "SELECT * FROM splits")
def win12_user_split(spark, sf_dir):
    return ds.user_splits(ad.feedback(spark, sf_dir).select("user_id").distinct())


@query(RECORDS + "," + SPLITS + "SELECT split, count(*) AS trajectories, count(DISTINCT user_id) AS users FROM records JOIN splits USING (user_id) GROUP BY split")
def agg24_jn14_split_manifest(spark, sf_dir):
    splits = ds.user_splits(ad.feedback(spark, sf_dir).select("user_id").distinct())
    return ds.split_manifest(ad.trajectories(spark, sf_dir), splits)


@query(r"""SELECT event_id, regexp_replace('{"user_id": "' || user_id || '", "props": ' || props || '}', '("user_id"\s*:\s*)("[^"]*"|[-+.\w]+)', '\1"redacted"', 'g') AS props FROM events""")
def sc25_redact(spark, sf_dir):
    e = ad.table(spark, sf_dir, "events")
    json = F.concat(F.lit('{"user_id": "'), F.col("user_id").cast("string"), F.lit('", "props": '), F.col("props"), F.lit("}"))
    return e.select("event_id", ds.redacted(json).alias("props"))


@query("SELECT session_id, turn, from_end FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) AS from_end FROM messages) WHERE from_end <= 4")
def win11_latest_messages(spark, sf_dir):
    return ds.latest_messages(ad.messages(spark, sf_dir), 4).select("session_id", "turn", "from_end")


AFFINITY = """
days AS (SELECT user_id, song_id % 5 AS label, day, min(seq) AS seq FROM steps GROUP BY ALL),
turns AS (SELECT user_id, day, row_number() OVER (PARTITION BY user_id ORDER BY day) AS t FROM (SELECT DISTINCT user_id, day FROM steps)),
grid AS (SELECT t.user_id, l.label, t.t, d.seq IS NOT NULL AS hit FROM turns t JOIN (SELECT DISTINCT user_id, label FROM days) l USING (user_id) LEFT JOIN days d ON d.user_id = t.user_id AND d.label = l.label AND d.day = t.day),
fold AS (
    SELECT user_id, label, 0 AS t, 0.0::DOUBLE AS a FROM (SELECT DISTINCT user_id, label FROM grid)
    UNION ALL
    SELECT g.user_id, g.label, g.t, CASE WHEN hit THEN least(1.0::DOUBLE, f.a * 0.9::DOUBLE * 0.9::DOUBLE + 0.34::DOUBLE) ELSE CASE WHEN f.a * 0.9::DOUBLE < 0.05::DOUBLE THEN 0.0::DOUBLE ELSE f.a * 0.9::DOUBLE END END
    FROM fold f JOIN grid g ON g.user_id = f.user_id AND g.label = f.label AND g.t = f.t + 1),
last AS (SELECT user_id, label, arg_max(a, t) AS a FROM fold GROUP BY ALL)
"""


@query(AFFINITY + "SELECT user_id, label, floor(a * 1e6 + 0.5)::BIGINT AS affinity6 FROM last WHERE a > 0", recursive=True)
def sc19_affinity_fold(spark, sf_dir):
    f = ad.feedback(spark, sf_dir).select("user_id", (F.col("song_id") % 5).alias("label"), F.date_format("ts", "yyyy-MM-dd").alias("day"))
    turns = f.groupBy("user_id").agg(F.sort_array(F.collect_set("day")).alias("days"))
    said = f.groupBy("user_id", "label").agg(F.collect_set("day").alias("said")).join(turns, "user_id")
    a = fb.affinity_after(F.transform("days", lambda d: F.array_contains(F.col("said"), d)))
    return said.select("user_id", "label", a.alias("a")).where("a > 0").select("user_id", "label", F.floor(F.col("a") * 1e6 + 0.5).cast("bigint").alias("affinity6"))
