"""Queries on profiles, external candidates, training samples and run summaries, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from melisma.functions import text as tx
from melisma.operators import dataset as ds
from melisma.operators import external as ex
from melisma.operators import feedback as fb
from melisma.operators import profiles as pf
from melisma.operators import retrieval as rt
from melisma.operators import samples as sa
from melisma.plans.recommend import PREFS, query, scored
from melisma.sources import adapters as ad

PROFILES = """
liked AS (SELECT user_id, list(seq ORDER BY seq) AS feedback FROM feedback GROUP BY user_id),
profiles AS (
    SELECT c.user_id, list(song_id ORDER BY first_order, song_id) AS ids, coalesce(any_value(l.feedback), []) AS feedback, 1 AS version FROM collection c LEFT JOIN liked l ON l.user_id = c.user_id GROUP BY c.user_id),
patches AS (SELECT user_id, list_transform(ids[:3], lambda x: x + 1) AS new_ids, [user_id * 10] AS new_feedback FROM profiles WHERE user_id % 3 <> 0)
"""
SHOWN = "SELECT user_id, array_to_string(ids, ',') AS ids, array_to_string(feedback, ',') AS feedback, version FROM "


def _profiles(spark, sf_dir):
    ids = F.sort_array(F.collect_list(F.struct("first_order", "song_id")))["song_id"]
    mine = ad.collection(spark, sf_dir).groupBy("user_id").agg(ids.alias("ids"))
    liked = ad.feedback(spark, sf_dir).groupBy("user_id").agg(F.sort_array(F.collect_list("seq")).alias("feedback"))
    rows = mine.join(liked, "user_id", "left").withColumn("feedback", F.coalesce("feedback", F.array().cast("array<bigint>")))
    return rows.withColumn("affinity", F.lit(1)).withColumn("version", F.lit(1))


def _patches(profiles):
    return profiles.where("user_id % 3 != 0").select("user_id", F.transform(F.slice("ids", 1, 3), lambda x: x + 1).alias("new_ids"), F.array((F.col("user_id") * 10).cast("bigint")).alias("new_feedback"))


def _shown(profiles):
    joined = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return profiles.select("user_id", joined("ids"), joined("feedback"), "version")


@query(PROFILES + """,
every AS (SELECT user_id, unnest(ids) AS id, unnest(range(len(ids))) AS pos FROM profiles UNION ALL SELECT user_id, unnest(new_ids), 1000000 + unnest(range(len(new_ids))) FROM patches),
united AS (SELECT user_id, list(id ORDER BY pos) AS ids FROM (SELECT user_id, id, min(pos) AS pos FROM every GROUP BY ALL) GROUP BY user_id),
done AS (
    SELECT p.user_id, u.ids, list_concat(p.feedback, coalesce(n.new_feedback, [])) AS feedback, p.version + (n.user_id IS NOT NULL)::INT AS version FROM profiles p JOIN united u USING (user_id) LEFT JOIN patches n ON n.user_id = p.user_id)
""" + SHOWN + "done")
def tl11_import_profile(spark, sf_dir):
    p = _profiles(spark, sf_dir)
    return _shown(pf.imported(p, _patches(p)))


@query(PROFILES + ", done AS (SELECT p.user_id, coalesce(new_ids, ids) AS ids, feedback, version + (n.user_id IS NOT NULL)::INT AS version FROM profiles p LEFT JOIN patches n ON n.user_id = p.user_id)" + SHOWN + "done")
def tl12_replace_profile(spark, sf_dir):
    p = _profiles(spark, sf_dir)
    return _shown(pf.replaced(p, _patches(p), keep_feedback=True))


@query(PROFILES + """
SELECT user_id, array_to_string(CASE WHEN list_contains(ids, user_id % 50) THEN ids ELSE list_append(ids, user_id % 50) END, ',') AS saved, array_to_string(list_filter(ids, lambda x: x <> ids[1]), ',') AS removed, version FROM profiles
""")
def tl8_tl14_collection_edits(spark, sf_dir):
    p = _profiles(spark, sf_dir)
    shown = lambda c: F.array_join(c.cast("array<string>"), ",")
    return p.select("user_id", shown(pf.saved(F.col("ids"), (F.col("user_id") % 50).cast("bigint"))).alias("saved"), shown(pf.removed(F.col("ids"), F.get("ids", F.lit(0)))).alias("removed"), "version")


@query(PREFS + """,
patch AS (SELECT user_id, label, 77::BIGINT AS weight FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY weight4, label) AS n FROM prefs WHERE kind = 'genre') WHERE n = 1 UNION ALL SELECT DISTINCT user_id, 'patched', 5 FROM prefs WHERE user_id % 2 = 0)
SELECT coalesce(g.user_id, p.user_id) AS user_id, coalesce(g.label, p.label) AS label, coalesce(p.weight, g.weight4) AS weight FROM (SELECT * FROM prefs WHERE kind = 'genre') g FULL JOIN patch p ON p.user_id = g.user_id AND p.label = g.label
""")
def sc24_merge_preferences(spark, sf_dir):
    prefs = fb.rebuilt_preferences(ad.collection(spark, sf_dir), ad.songs(spark, sf_dir), ad.tags(spark, sf_dir))
    now = prefs.where("kind = 'genre'").select("user_id", "label", F.col("weight4").alias("weight"))
    least = now.withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy("weight", "label"))).where("n = 1").select("user_id", "label", F.lit(77).cast("bigint").alias("weight"))
    new = prefs.where("user_id % 2 = 0").select("user_id").distinct().select("user_id", F.lit("patched").alias("label"), F.lit(5).cast("bigint").alias("weight"))
    return pf.merged_preferences(now, least.unionByName(new))


@query("""
counted AS (SELECT user_id, count(*) AS n FROM collection GROUP BY user_id),
known AS (SELECT user_id, count(*) AS n FROM collection JOIN songs USING (song_id) WHERE confidence10 > 5 GROUP BY user_id)
SELECT c_custkey AS user_id, CASE WHEN c.n IS NULL THEN 'empty' ELSE 'ok' END AS status, concat_ws('; ', CASE WHEN c.n IS NULL THEN 'collection is empty' END, CASE WHEN k.n IS NULL THEN 'collection preferences are empty' END) AS diagnostics,
       concat_ws('; ', CASE WHEN c.n IS NULL THEN 'L2.collect_or_import' END, CASE WHEN k.n IS NULL THEN 'L1.rebuild_profile' END) AS suggested
FROM customer LEFT JOIN counted c ON c.user_id = c_custkey LEFT JOIN known k ON k.user_id = c_custkey
""")
def prj1_inspect_profile(spark, sf_dir):
    mine = ad.collection(spark, sf_dir).join(ad.songs(spark, sf_dir).select("song_id", "confidence10"), "song_id", "left")
    counts = mine.groupBy("user_id").agg(F.count(F.lit(1)).alias("a"), F.count_if(F.col("confidence10") > 5).alias("b"))
    rows = ad.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id")).join(counts, "user_id", "left").fillna(0, ["a", "b"])
    status, said, tools = pf.inspection(F.col("a"), F.col("b"))
    return rows.select("user_id", status, F.array_join(said, "; ").alias("diagnostics"), F.array_join(tools, "; ").alias("suggested"))


@query("""
seen AS (SELECT song_id, CASE WHEN song_id % 4 = 0 THEN '' ELSE title END AS title, artist, genre AS album, CASE WHEN song_id % 6 <> 0 THEN year END AS release_year, CASE WHEN song_id % 9 <> 0 THEN duration_ms END AS duration_ms, song_id % 5 <> 0 AS tagged, song_id % 7 <> 0 AS with_genres FROM songs),
told AS (
    SELECT song_id, concat_ws(', ', CASE WHEN title = '' THEN 'title' END, CASE WHEN release_year IS NULL THEN 'release_year' END, CASE WHEN duration_ms IS NULL THEN 'duration_ms' END) AS gone, tagged, with_genres FROM seen)
SELECT song_id, CASE WHEN gone = '' AND tagged AND with_genres THEN 'ok' ELSE 'partial' END AS status,
       concat_ws('; ', CASE WHEN gone <> '' THEN 'missing metadata fields: ' || gone END, CASE WHEN NOT tagged THEN 'Last.fm track tags are empty' END, CASE WHEN NOT with_genres THEN 'normalized genres are empty' END) AS diagnostics FROM told
""")
def prj2_inspect_song(spark, sf_dir):
    k = F.col("song_id")
    meta = {"title": F.when(k % 4 == 0, "").otherwise(F.col("title")), "artist": F.col("artist"), "album": F.col("genre"), "release_year": F.when(k % 6 != 0, F.col("year")), "duration_ms": F.when(k % 9 != 0, F.col("duration_ms"))}
    status, said = pf.song_inspection(meta, k % 5 != 0, k % 7 != 0)
    return ad.songs(spark, sf_dir).select("song_id", status, F.array_join(said, "; ").alias("diagnostics"))


@query("""
placed AS (SELECT user_id, song_id, row_number() OVER (PARTITION BY user_id ORDER BY first_order, song_id) AS pos FROM collection)
SELECT user_id, pos, title, artist FROM placed JOIN songs USING (song_id) WHERE pos <= 25 AND confidence10 > 1
""")
def prj11_taste_tracks(spark, sf_dir):
    return pf.taste_tracks(ad.collection(spark, sf_dir), ad.songs(spark, sf_dir).where("confidence10 > 1"), [F.col("first_order"), F.col("song_id")])


@query("SELECT o_orderpriority AS category, count(*) AS cases, count(*) FILTER (WHERE o_orderstatus = 'F') AS passed, count(*) FILTER (WHERE o_orderstatus <> 'F') AS failed FROM orders GROUP BY 1")
def agg16_evaluation_roll_up(spark, sf_dir):
    o = ad.table(spark, sf_dir, "orders")
    ok = F.col("o_orderstatus") == "F"
    return o.groupBy(F.col("o_orderpriority").alias("category")).agg(F.count(F.lit(1)).alias("cases"), F.count_if(ok).alias("passed"), F.count_if(~ok).alias("failed"))


@query("SELECT artist, genre AS album, count(*) AS requested, count(*) FILTER (WHERE confidence10 > 1) AS stored, count(*) FILTER (WHERE confidence10 <= 1) AS failures FROM songs GROUP BY ALL")
def agg25_collection_runs(spark, sf_dir):
    stored = F.col("confidence10") > 1
    return ad.songs(spark, sf_dir).groupBy("artist", F.col("genre").alias("album")).agg(F.count(F.lit(1)).alias("requested"), F.count_if(stored).alias("stored"), F.count_if(~stored).alias("failures"))


@query(r"""
asked AS (SELECT song_id, title, artist, genre, split_part(title, ' ', 2) || '_' || lower(artist) AS term, 'Brand#' || (song_id % 7) AS reference, '  ' || upper(split_part(title, ' ', 2)) || '   ' || artist AS other FROM songs),
clean AS (
    SELECT *, lower(trim(regexp_replace(term, '[\s_]+', ' ', 'g'))) AS t, lower(trim(regexp_replace(title || ' ' || artist || ' ' || genre, '[\s_]+', ' ', 'g'))) AS whole FROM asked)
SELECT song_id, contains(whole, t) OR contains(regexp_replace(whole, '[^\p{L}\p{N}]', '', 'g'), regexp_replace(t, '[^\p{L}\p{N}]', '', 'g')) AS ranked,
       contains(lower(title || ' ' || artist || ' ' || genre), lower(trim(regexp_replace(other, '\s+', ' ', 'g')))) AS external, song_id % 2 = 0 AND lower(artist) = lower(reference) AS is_reference FROM clean
""")
def flt4_flt5_flt11_terms(spark, sf_dir):
    k, labels = F.col("song_id"), (F.col("title"), F.col("artist"), F.col("genre"))
    second = F.get(F.split("title", " "), F.lit(1))
    term, other = F.concat(second, F.lit("_"), F.lower("artist")), F.concat(F.lit("  "), F.upper(second), F.lit("   "), "artist")
    reference = F.array(F.concat(F.lit(" Brand#"), (k % 7).cast("string")))
    return ad.songs(spark, sf_dir).select("song_id", ex.ranked_matches(term, *labels).alias("ranked"), ex.external_matches(other, *labels).alias("external"), ex.is_reference_artist(F.col("artist"), reference, k % 2 == 0).alias("is_reference"))


@query("""
keyed AS (
    SELECT song_id, genre, title, artist, (song_id * 37 % 1000) / 1000.0::DOUBLE AS final, CASE WHEN song_id % 5 = 0 THEN lower(genre) WHEN song_id % 5 = 1 THEN 'anchor ' || song_id % 3 WHEN song_id % 5 = 2 THEN 'fam' ELSE lower(artist) END AS cluster FROM songs)
SELECT song_id, cluster, row_number() OVER (PARTITION BY genre ORDER BY final DESC, lower(artist), lower(title), song_id) AS rank FROM keyed
""")
def sc11_top4_cluster_order(spark, sf_dir):
    k = F.col("song_id")
    cluster = ex.cluster_key(F.when(k % 5 == 0, F.col("genre")), F.when(k % 5 == 1, F.array(F.lit("  "), F.concat(F.lit(" Anchor "), (k % 3).cast("string")))), F.when(k % 5 == 2, "Fam"), F.col("artist"))
    order = Window.partitionBy("genre").orderBy(*ex.external_order((k * 37 % 1000) / 1000.0, F.col("artist"), F.col("title")), "song_id")
    return ad.songs(spark, sf_dir).select("song_id", cluster.alias("cluster"), F.row_number().over(order).alias("rank"))


@query()
def flt9_external_pipeline(spark, sf_dir):
    """Reference artists, the relevance floor and terms as filters, then signatures and caps over each hundred best, then adjacency."""
    from melisma.operators import sessions as se

    songs = ad.songs(spark, sf_dir).select("song_id", "title", "artist", "genre", tx.track_signature(F.col("title"), F.col("artist")).alias("signature"))
    pool = rt.top_candidates(scored(spark, sf_dir, 100), 100).select(F.col("user_id").alias("list_id"), "song_id", "rank", "similarity").join(songs, "song_id")
    pool = pool.where(~ex.is_reference_artist(F.col("artist"), F.array(F.lit("Brand#3")), F.lit(True)) & ~ex.external_matches(F.lit("hot"), F.col("title")) & (F.col("similarity") >= 250000))
    keyed = pool.select("list_id", "song_id", "rank", "artist", "signature", tx.family_key(F.col("artist")).alias("family"), F.lower("genre").alias("cluster"))
    kept = keyed.groupBy("list_id").applyInPandas(lambda p: ex.capped_in_order(p, 2, 2, 4), "list_id long, pos long, song_id long")
    lists = kept.withColumnRenamed("pos", "rank").join(songs.select("song_id", "artist", F.lower("genre").alias("cluster")), "song_id")
    return lists.groupBy("list_id").applyInPandas(se.adjacent_diversity, "list_id long, pos long, song_id long")


RUNS = r"""
joined AS (SELECT f.user_id, strftime(ts, '%Y-%m-%d') AS day, seq, kind, reward10, title, artist FROM feedback f JOIN songs USING (song_id)),
runs AS (
    SELECT user_id, day, arg_min(kind, seq) AS tool, count(*) AS n, avg(reward10) / 10 AS reward,
           string_agg(CASE WHEN reward10 > 0 THEN 'Thought: liked ' || title || chr(10) ELSE '' END || 'Action: ' || kind, chr(10) ORDER BY seq) AS steps, string_agg('- ' || title || ' — ' || artist, chr(10) ORDER BY seq) AS tracks FROM joined GROUP BY user_id, day),
texts AS (
    SELECT user_id, day, reward, 'You are the assistant, a tool-using music recommendation agent.' || chr(10) || 'Reason step by step (ReAct), call tools, then answer.' || chr(10) || chr(10) || 'User request: find me ' || tool || ' music'
        || CASE WHEN user_id % 6 = 0 THEN chr(10) || 'Known listener taste: artists: ' || tool || ', Zed; genres: rock' WHEN user_id % 3 = 0 THEN chr(10) || 'Known listener taste: artists: ' || tool || ', Zed' WHEN user_id % 2 = 0 THEN chr(10) || 'Known listener taste: genres: rock' ELSE '' END
        || CASE WHEN user_id % 4 < 2 THEN chr(10) || 'Requested count: ' || n ELSE '' END AS prompt,
        steps || chr(10) || 'Observation: grounded candidate tracks confirmed.' || CASE WHEN n > 1 THEN chr(10) || 'Final answer: enjoy ' || n ELSE '' END || chr(10) || 'Recommended tracks:' || chr(10) || tracks AS completion FROM runs),
groups AS (
    SELECT prompt, list(completion ORDER BY user_id, day, completion) AS responses, list(round(reward, 6) ORDER BY user_id, day, completion) AS rewards FROM texts GROUP BY prompt HAVING count(*) >= 2 AND min(round(reward, 6)) <> max(round(reward, 6)))
"""


@query(RUNS + "SELECT user_id, day, prompt, completion FROM texts WHERE reward >= 0.3")
def flt16_sc33_sft_samples(spark, sf_dir):
    return sa.supervised(ad.agent_runs(spark, sf_dir), 0.3).select("user_id", "day", "prompt", "completion")


@query(RUNS + "SELECT count(*) AS records, count(*) FILTER (WHERE reward >= 0.3) AS samples, count(*) FILTER (WHERE reward < 0.3) AS skipped FROM texts")
def tl22_sample_counts(spark, sf_dir):
    runs = ad.agent_runs(spark, sf_dir)
    return sa.sample_counts(runs, sa.supervised(runs, 0.3))


@query(RUNS + "SELECT prompt, len(responses) AS n, sha256(array_to_string(responses, '|')) AS responses, list_sum(rewards) AS total, rewards[1] AS first FROM groups")
def agg18_preference_groups(spark, sf_dir):
    g = sa.grouped(ad.agent_runs(spark, sf_dir), ["user_id", "day"])
    total = F.aggregate("rewards", F.lit(0.0), lambda a, x: a + x)
    return g.select("prompt", F.size("responses").cast("bigint").alias("n"), F.sha2(F.array_join("responses", "|"), 256).alias("responses"), total.alias("total"), F.get("rewards", F.lit(0)).alias("first"))


@query(RUNS + "SELECT sha256(response) AS response, max(reward) AS reward FROM (SELECT unnest(responses) AS response, unnest(rewards) AS reward FROM groups) GROUP BY ALL")
def agg19_reward_table(spark, sf_dir):
    table = ds.reward_table(sa.grouped(ad.agent_runs(spark, sf_dir), ["user_id", "day"]))
    return table.select(F.sha2("response", 256).alias("response"), F.col("reward10").alias("reward"))


@query("""
grown AS (
    SELECT user_id, song_id, min(first_order) AS first_order FROM (SELECT * FROM collection UNION ALL SELECT user_id, song_id, 1000000000 + seq FROM feedback WHERE kind IN ('favorite', 'playlist_add')) GROUP BY ALL),
touched AS (SELECT DISTINCT user_id FROM feedback WHERE kind IN ('favorite', 'playlist_add')),""" + PREFS.replace("FROM collection JOIN told", "FROM grown JOIN told") + "SELECT * FROM prefs WHERE user_id IN (SELECT user_id FROM touched)")
def st4_favourites_rebuild(spark, sf_dir):
    """Favourites join the collection, and the preferences of the users concerned are made anew."""
    favourites = ad.feedback(spark, sf_dir).where(F.col("kind").isin("favorite", "playlist_add")).select("user_id", "song_id", (F.lit(1000000000) + F.col("seq")).alias("first_order"))
    mine = ad.collection(spark, sf_dir).join(favourites.select("user_id").distinct(), "user_id", "left_semi").select("user_id", "song_id", "first_order")
    grown = mine.unionByName(favourites).groupBy("user_id", "song_id").agg(F.min("first_order").alias("first_order"))
    return fb.rebuilt_preferences(grown, ad.songs(spark, sf_dir), ad.tags(spark, sf_dir))
