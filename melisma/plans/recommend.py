"""Queries on retrieval, feedback and preferences, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from melisma.operators import feedback as fb
from melisma.operators import retrieval as rt
from melisma.plans.prelude import oracle
from melisma.session import written
from melisma.sources import adapters as ad

TOP_K = 20
QUERIES, ORACLES = {}, {}


def query(sql: str | None = None, recursive: bool = False):
    """Registers a query under its function's name, with its SQL if there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = oracle(sql, recursive)
        return f

    return add


def asked_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set of the searches: users whose id is divisible by 20, against all songs."""
    c = ad.collection(spark, sf_dir).where("user_id % 20 = 0")
    return rt.collection_seeds(c, ad.song_features(spark, sf_dir))


def scored(spark: SparkSession, sf_dir: str, k: int | None = None, columns: list[str] | None = None, per_artist: int | None = None) -> DataFrame:
    return rt.score_candidates(written(asked_users(spark, sf_dir), "asked-users"), ad.song_features(spark, sf_dir), k, columns=columns, per_artist=per_artist)


GRID = """
asked AS (
    SELECT user_id, song_id AS seed, row_number() OVER (PARTITION BY user_id ORDER BY first_order, song_id) AS pos
    FROM collection WHERE user_id % 20 = 0),
totals AS (SELECT song_id, field, sum(w) AS total FROM tags GROUP BY ALL),
overlap AS (
    SELECT a.song_id AS l, b.song_id AS r, a.field, sum(least(a.w, b.w))::BIGINT AS shared
    FROM tags a JOIN tags b USING (field, label) WHERE a.song_id IN (SELECT seed FROM asked) GROUP BY ALL),
jaccards AS (
    SELECT l, r, o.field, shared::DOUBLE / (x.total + y.total - shared)::DOUBLE AS j
    FROM overlap o JOIN totals x ON x.song_id = l AND x.field = o.field JOIN totals y ON y.song_id = r AND y.field = o.field),
parts AS (
    SELECT l, r, max(CASE WHEN field = 'track_tags' THEN floor(0.55::DOUBLE * j * 1e6 + 0.5) END)::BIGINT AS track_tags,
           max(CASE WHEN field = 'genres' THEN floor(0.25::DOUBLE * j * 1e6 + 0.5) END)::BIGINT AS genres,
           max(CASE WHEN field = 'artist_tags' THEN floor(0.15::DOUBLE * j * 1e6 + 0.5) END)::BIGINT AS artist_tags
    FROM jaccards GROUP BY ALL),
pairs AS (
    SELECT user_id, c.song_id, c.artist, seed, pos, coalesce(track_tags, 0) AS track_tags, coalesce(genres, 0) AS genres, coalesce(artist_tags, 0) AS artist_tags,
           floor(0.05::DOUBLE * greatest(0, 1 - least(abs(s.year - c.year), 30) / 30.0::DOUBLE) * 1e6 + 0.5)::BIGINT AS release_year
    FROM asked a JOIN songs s ON s.song_id = seed CROSS JOIN songs c LEFT JOIN parts p ON p.l = seed AND p.r = c.song_id
    WHERE (user_id, c.song_id) NOT IN (SELECT user_id, seed FROM asked)),
scored AS (SELECT *, track_tags + genres + artist_tags + release_year AS score FROM pairs),
ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id, song_id ORDER BY score DESC, seed) AS rn FROM scored),
cand AS (
    SELECT user_id, song_id, artist, max(CASE WHEN rn = 1 THEN seed END) AS best_seed, max(CASE WHEN rn = 1 THEN score END) AS best,
           floor(sum(score)::DOUBLE / count(*) + 0.5)::BIGINT AS average,
           floor(0.7::DOUBLE * max(CASE WHEN rn = 1 THEN track_tags END) + 0.3::DOUBLE * (sum(track_tags)::DOUBLE / count(*)) + 0.5)::BIGINT AS track_tags,
           floor(0.7::DOUBLE * max(CASE WHEN rn = 1 THEN genres END) + 0.3::DOUBLE * (sum(genres)::DOUBLE / count(*)) + 0.5)::BIGINT AS genres,
           floor(0.7::DOUBLE * max(CASE WHEN rn = 1 THEN artist_tags END) + 0.3::DOUBLE * (sum(artist_tags)::DOUBLE / count(*)) + 0.5)::BIGINT AS artist_tags,
           floor(0.7::DOUBLE * max(CASE WHEN rn = 1 THEN release_year END) + 0.3::DOUBLE * (sum(release_year)::DOUBLE / count(*)) + 0.5)::BIGINT AS release_year
    FROM ranked WHERE rn <= 5 GROUP BY ALL),
final AS (SELECT *, track_tags + genres + artist_tags + release_year AS similarity FROM cand),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY similarity DESC, song_id) AS rank FROM final WHERE similarity > 0) WHERE rank <= {k})
"""


@query(GRID.replace("{k}", "20") + "SELECT user_id, rank, song_id, best_seed, similarity FROM top")
def flt1_flt2_top1_retrieve_topk(spark, sf_dir):
    mine = ad.collection(spark, sf_dir).where("user_id % 20 = 0")
    return rt.retrieve(mine, ad.song_features(spark, sf_dir), TOP_K).select("user_id", "rank", "song_id", "best_seed", "similarity")


@query(GRID.replace("{k}", "20").replace("asked AS (", """
walk_ids AS (
    SELECT p_partkey AS song_id, list_filter(['isrc=' || p_type || '-' || p_size, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE 'mbid=mb' || (p_partkey % 700) END], lambda x: x <> '') AS ids FROM part),
info AS (
    SELECT song_id, ids, duration_ms AS d, trim(regexp_replace(lower(artist), '[^a-z0-9]+', ' ', 'g')) AS a, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) AS t FROM songs JOIN walk_ids USING (song_id)),
asked AS (""", 1) + r""",
idrows AS (SELECT song_id, unnest(ids) AS id FROM info),
gone AS (
    SELECT x.user_id, o.song_id FROM asked x JOIN idrows k ON k.song_id = x.seed JOIN idrows o ON o.id = k.id AND o.song_id <> k.song_id
    UNION
    SELECT x.user_id, o.song_id FROM asked x JOIN info k ON k.song_id = x.seed JOIN info o ON o.a = k.a AND o.t = k.t AND o.t <> '' AND o.song_id <> k.song_id AND abs(o.d - k.d) <= 10000),
pool AS MATERIALIZED (
    SELECT user_id, f.song_id, best_seed, similarity, ids, a, t, d, row_number() OVER (PARTITION BY user_id ORDER BY similarity DESC, f.song_id) AS pos
    FROM final f JOIN info USING (song_id) WHERE similarity > 0 AND NOT EXISTS (SELECT 1 FROM gone g WHERE g.user_id = f.user_id AND g.song_id = f.song_id)),
walk(user_id, pos, picked) AS (
    SELECT DISTINCT user_id, 0::BIGINT, []::STRUCT(ids VARCHAR[], a VARCHAR, t VARCHAR, d BIGINT, song_id BIGINT, best_seed BIGINT, similarity BIGINT)[] FROM asked
    UNION ALL
    SELECT w.user_id, p.pos, CASE WHEN len(list_filter(picked, lambda x: list_has_any(x.ids, p.ids) OR (x.a = p.a AND x.t = p.t AND p.t <> '' AND abs(x.d - p.d) <= 10000))) = 0
            AND (p.a = '' OR len(list_filter(picked, lambda x: x.a = p.a)) < 2)
        THEN list_append(picked, {'ids': p.ids, 'a': p.a, 't': p.t, 'd': p.d, 'song_id': p.song_id, 'best_seed': p.best_seed, 'similarity': p.similarity}) ELSE picked END
    FROM walk w JOIN pool p ON p.user_id = w.user_id AND p.pos = w.pos + 1 WHERE len(picked) < 20),
ended AS (SELECT user_id, arg_max(picked, pos) AS picked FROM walk GROUP BY user_id)
SELECT user_id, rank, picked[rank].song_id AS song_id, picked[rank].best_seed AS best_seed, picked[rank].similarity AS similarity
FROM (SELECT user_id, picked, unnest(range(1, len(picked) + 1))::INTEGER AS rank FROM ended)
""", recursive=True)
def jn1_jn3_win3_recommendations(spark, sf_dir):
    """The whole retrieval: bounds on label lists, then the selection without other records, versions and full artists."""
    mine = ad.collection(spark, sf_dir).where("user_id % 20 = 0")
    got = rt.recommend_distinct(mine, ad.song_features(spark, sf_dir), ad.songs(spark, sf_dir), ad.external_ids(spark, sf_dir), TOP_K)
    return got.select("user_id", "rank", "song_id", "best_seed", "similarity")


@query(GRID.replace("{k}", "20") + "SELECT user_id, song_id, best_seed, best FROM final")
def win1_best_seed(spark, sf_dir):
    kept = ["user_id", "song_id", "best_seed", "best"]
    return scored(spark, sf_dir, columns=kept).select(*kept)


@query(GRID.replace("{k}", "20") + "SELECT user_id, song_id, best, average, track_tags, genres, artist_tags, release_year, similarity FROM final")
def agg2_agg3_collection_score(spark, sf_dir):
    kept = ["user_id", "song_id", "best", "average", *rt.PARTS, "similarity"]
    return scored(spark, sf_dir, columns=kept).select(*kept)


@query(GRID.replace("{k}", "20") + "SELECT user_id, song_id, string_agg(seed::VARCHAR, ',' ORDER BY pos) AS matched FROM scored WHERE score > 0 GROUP BY ALL")
def agg4_matched_seeds(spark, sf_dir):
    return rt.matched_seeds(written(asked_users(spark, sf_dir), "asked-users"), ad.song_features(spark, sf_dir))


@query(GRID.replace("{k}", "20") + "SELECT user_id, song_id, seed, track_tags, genres, artist_tags, release_year, score FROM scored")
def sc15_pair_score(spark, sf_dir):
    return rt.score_pairs(written(asked_users(spark, sf_dir), "asked-users"), ad.song_features(spark, sf_dir))


@query("""
totals AS (SELECT song_id, sum(w) AS total FROM tags WHERE field = 'track_tags' GROUP BY ALL),
shared AS (SELECT a.song_id AS l, b.song_id AS r, sum(least(a.w, b.w))::BIGINT AS s FROM tags a JOIN tags b USING (field, label) WHERE a.field = 'track_tags' AND a.song_id % 20 = 0 GROUP BY ALL)
SELECT l, r, floor(s::DOUBLE / (x.total + y.total - s)::DOUBLE * 1e6 + 0.5)::BIGINT AS j6 FROM shared JOIN totals x ON x.song_id = l JOIN totals y ON y.song_id = r
""")
def jn5_sc13_weighted_jaccard(spark, sf_dir):
    t = ad.tags(spark, sf_dir)
    return fb.label_overlaps(t.where("song_id % 20 = 0"), t, ("track_tags",)).select("l", "r", "j6")


@query("""
years AS (SELECT DISTINCT year FROM songs)
SELECT a.year AS l, b.year AS r, greatest(0, 1 - least(abs(a.year - b.year), 30) / 30.0::DOUBLE)::DOUBLE AS similarity FROM years a, years b
""")
def sc14_year_similarity(spark, sf_dir):
    from melisma.functions.score import year_similarity

    years = ad.songs(spark, sf_dir).select("year").distinct()  # the adapter's years are at most 50
    l, r = years.select(F.col("year").alias("l")), years.select(F.col("year").alias("r"))
    return l.join(r, F.lit(True)).select("l", "r", year_similarity(F.col("l"), F.col("r")).alias("similarity"))


@query("SELECT user_id, song_id FROM collection WHERE song_id NOT IN (SELECT song_id FROM songs WHERE confidence10 > 1)")
def jn2_missing_seeds(spark, sf_dir):
    return rt.missing_seeds(ad.collection(spark, sf_dir), ad.songs(spark, sf_dir).where("confidence10 > 1"))


@query("SELECT DISTINCT user_id, song_id FROM feedback WHERE song_id NOT IN (SELECT song_id FROM songs WHERE confidence10 > 1)")
def jn9_missing_feedback(spark, sf_dir):
    return fb.missing_feedback_songs(ad.feedback(spark, sf_dir), ad.songs(spark, sf_dir).where("confidence10 > 1"))


@query(r"""
keyed AS (SELECT song_id, duration_ms, trim(regexp_replace(lower(artist), '[^a-z0-9]+', ' ', 'g')) AS a, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) AS t FROM songs)
SELECT DISTINCT c.user_id, o.song_id FROM collection c JOIN keyed k USING (song_id) JOIN keyed o ON o.a = k.a AND o.t = k.t AND o.song_id <> k.song_id AND abs(o.duration_ms - k.duration_ms) <= 10000
""")
def jn3_jn4_duplicate_versions(spark, sf_dir):
    return rt.duplicate_versions(ad.collection(spark, sf_dir), ad.songs(spark, sf_dir))


@query(GRID.replace("{k}", "20") + "SELECT user_id, artist, song_id, nth FROM (SELECT *, row_number() OVER (PARTITION BY user_id, artist ORDER BY similarity DESC, song_id) AS nth FROM final) WHERE nth <= 3")
def win2_artist_cap(spark, sf_dir):
    return rt.artist_cap(scored(spark, sf_dir, columns=["user_id", "song_id", "artist", "similarity"], per_artist=3), 3).select("user_id", "artist", "song_id", "nth")


@query(GRID.replace("{k}", "20") + r""",
keyed AS (SELECT song_id, duration_ms, trim(regexp_replace(lower(artist), '[^a-z0-9]+', ' ', 'g')) AS a, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) AS t FROM songs),
dup AS (SELECT DISTINCT c.user_id, o.song_id FROM asked c JOIN keyed k ON k.song_id = c.seed JOIN keyed o ON o.a = k.a AND o.t = k.t AND o.song_id <> k.song_id AND abs(o.duration_ms - k.duration_ms) <= 10000),
pool AS (
    SELECT user_id, song_id, similarity, a, t, duration_ms, row_number() OVER (PARTITION BY user_id, a, t ORDER BY similarity DESC, song_id) AS n
    FROM final JOIN keyed USING (song_id) WHERE similarity > 0 AND NOT EXISTS (SELECT 1 FROM dup WHERE dup.user_id = final.user_id AND dup.song_id = final.song_id)),
second AS (
    SELECT p.user_id, p.a, p.t, min(p.n) AS n FROM pool p JOIN pool f ON f.n = 1 AND f.user_id = p.user_id AND f.a = p.a AND f.t = p.t AND abs(f.duration_ms - p.duration_ms) > 10000 GROUP BY ALL),
picked AS (
    SELECT p.*, row_number() OVER (PARTITION BY p.user_id, p.a ORDER BY similarity DESC, song_id) AS nth
    FROM pool p LEFT JOIN second s USING (user_id, a, t) WHERE p.n = 1 OR p.n = s.n)
SELECT user_id, rank, song_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY similarity DESC, song_id) AS rank FROM picked WHERE nth <= 2) WHERE rank <= 20
""")
def jn3_win3_distinct_selection(spark, sf_dir):
    mine = ad.collection(spark, sf_dir).where("user_id % 20 = 0")
    return rt.select_distinct(mine, ad.song_features(spark, sf_dir), ad.songs(spark, sf_dir), TOP_K, 2)


@query("SELECT song_id, label, max(w) AS w FROM tags WHERE field <> 'genres' GROUP BY ALL")
def agg5_tag_union(spark, sf_dir):
    return fb.tag_union(ad.tags(spark, sf_dir))


SIMS = """
merged AS (
    SELECT song_id, 'tags' AS field, label, max(w) AS w FROM tags WHERE field <> 'genres' GROUP BY ALL
    UNION ALL SELECT song_id, field, label, w FROM tags WHERE field = 'genres'
    UNION ALL SELECT song_id, 'artist', artist, 10000 FROM songs),
sizes AS (SELECT song_id, field, sum(w) AS total FROM merged GROUP BY ALL),
common AS (
    SELECT a.song_id AS l, b.song_id AS r, a.field, sum(least(a.w, b.w))::BIGINT AS shared FROM merged a JOIN merged b USING (field, label)
    WHERE a.song_id IN (SELECT song_id FROM feedback) GROUP BY ALL),
fields AS (
    SELECT l, r, c.field, floor(shared::DOUBLE / (x.total + y.total - shared)::DOUBLE * 1e6 + 0.5) AS j6 FROM common c
    JOIN sizes x ON x.song_id = l AND x.field = c.field JOIN sizes y ON y.song_id = r AND y.field = c.field),
sims AS (
    SELECT l, r, sum(floor(CASE field WHEN 'artist' THEN 0.25::DOUBLE WHEN 'genres' THEN 0.35::DOUBLE ELSE 0.40::DOUBLE END * j6 + 0.5))::BIGINT AS sim6
    FROM fields GROUP BY ALL HAVING sim6 >= 300000)
"""


@query(SIMS + """
SELECT user_id, r AS song_id, greatest(-1000000, least(1000000, floor(sum(reward10 * sim6)::DOUBLE / 10 + 0.5)))::BIGINT AS score6
FROM feedback f JOIN sims ON l = f.song_id GROUP BY user_id, r
""")
def agg6_jn8_feedback_transfer(spark, sf_dir):
    return fb.transferred_feedback(ad.feedback(spark, sf_dir), ad.songs(spark, sf_dir), ad.tags(spark, sf_dir))


@query("SELECT user_id, song_id, arg_max(reward10, seq) AS reward10 FROM feedback WHERE reward10 <> 0 GROUP BY ALL")
def agg7_last_direct_reward(spark, sf_dir):
    return fb.last_direct_reward(ad.feedback(spark, sf_dir))


@query("""
SELECT user_id, count(*) AS events, count(*) FILTER (WHERE reward10 > 0) AS positive, count(*) FILTER (WHERE reward10 < 0) AS negative,
       count(*) FILTER (WHERE reward10 = 0) AS neutral, sum(reward10)::BIGINT AS reward10,
       count(DISTINCT CASE WHEN s.song_id IS NULL THEN f.song_id END) AS missing
FROM feedback f LEFT JOIN songs s ON s.song_id = f.song_id AND s.confidence10 > 1 GROUP BY user_id
""")
def agg8_feedback_summary(spark, sf_dir):
    return fb.feedback_summary(ad.feedback(spark, sf_dir), ad.songs(spark, sf_dir).where("confidence10 > 1"))


@query("SELECT user_id, kind, count(*) AS events FROM feedback GROUP BY ALL")
def agg8_counts_by_kind(spark, sf_dir):
    return fb.counts_by_kind(ad.feedback(spark, sf_dir))


PREFS = r"""
tagged AS (
    SELECT song_id, label, w, trim(lower(regexp_replace(regexp_replace(label, '[_/]+', ' ', 'g'), '\s+', ' ', 'g'))) AS name, trim(lower(regexp_replace(regexp_replace(artist, '[_/]+', ' ', 'g'), '\s+', ' ', 'g'))) AS own
    FROM tags JOIN songs USING (song_id) WHERE field <> 'genres'),
told AS (
    SELECT song_id, 'artist' AS kind, lower(trim(regexp_replace(artist, '\s+', ' ', 'g'))) AS key, trim(artist) AS label, 1::BIGINT AS w FROM songs
    UNION ALL SELECT song_id, 'genre', label, label, w FROM tags WHERE field = 'genres'
    UNION ALL SELECT song_id, 'tag', name, name, w FROM tagged
    WHERE name <> '' AND name <> own AND NOT regexp_full_match(name, '(?:19|20)\d{2}|(?:19|20)?\d0s') AND NOT regexp_full_match(name, '\d+(?:\.\d+)?\s+(?:of|out of)\s+\d+\s+stars?')
      AND name NOT IN ('albums i own', 'awesome', 'beautiful', 'best', 'favorites', 'favourite', 'great', 'love', 'seen live', 'wrong track streaming')),
sums AS (SELECT user_id, kind, key, sum(w)::BIGINT AS s, arg_min(label, (first_order, song_id)) AS label FROM collection JOIN told USING (song_id) GROUP BY ALL),
prefs AS (SELECT user_id, kind, label, floor(s::DOUBLE / max(s) OVER (PARTITION BY user_id, kind) * 1e4 + 0.5)::BIGINT AS weight4 FROM sums)
"""


@query(PREFS + "SELECT * FROM prefs")
def agg1_preference_rebuild(spark, sf_dir):
    return fb.rebuilt_preferences(ad.collection(spark, sf_dir), ad.songs(spark, sf_dir), ad.tags(spark, sf_dir))


@query(PREFS + "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, kind ORDER BY weight4 DESC, lower(label), label) AS rank FROM prefs) WHERE rank <= 5")
def prj7_top3_top_preferences(spark, sf_dir):
    return fb.top_preferences(fb.rebuilt_preferences(ad.collection(spark, sf_dir), ad.songs(spark, sf_dir), ad.tags(spark, sf_dir)), 5)
