"""Queries on session memory, agent tools and provider shapes, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from melisma.operators import memory as me
from melisma.plans.live import file_stream, run_to_end
from melisma.plans.profiles import PROFILES, SHOWN, _profiles, _shown
from melisma.plans.recommend import query
from melisma.session import ship_package
from melisma.sources import adapters as ad


def _customers(spark, sf_dir):
    return ad.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").cast("string").alias("owner"), F.lower("c_mktsegment").alias("seg"))


CUSTOMERS = "customers AS (SELECT c_custkey AS k, c_nationkey::VARCHAR AS owner, lower(c_mktsegment) AS seg FROM customer)"


def _stored(customers):
    """Stored sessions of several ages, as JSON text."""
    only = lambda c, x: F.when(F.expr(c), x)
    fields = F.struct(
        F.concat(F.lit("s"), "k").alias("session_id"), F.col("owner").alias("user_id"), F.concat(F.lit(" play "), "seg", F.lit(" ")).alias("last_user_query"),
        F.array(F.concat(F.lit(" "), "seg", F.lit(" ")), F.lit("Already  Recommended songs"), F.lit("  "), F.concat(F.lit("x"), F.col("k") % 5)).alias("exclude_terms"),
        only("k % 3 = 0", (F.col("k") % 4 + 5).cast("string")).alias("last_top_k"), only("k % 2 = 0", F.create_map(F.lit("limit"), (F.col("k") % 9).cast("string"))).alias("active_constraints"),
        only("k % 4 = 0", F.array(F.lit("t1 "), F.lit("t1"), F.concat(F.lit("t"), F.col("k") % 6))).alias("seen_track_ids"), only("k % 5 < 2", F.array(F.concat(F.lit("a"), F.col("k") % 3), F.lit("a0"))).alias("seen_song_ids"),
    )
    return customers.select(F.to_json(fields).alias("value"))


@query(CUSTOMERS + r""",
raw AS (
    SELECT 's' || k AS session_id, owner, 'play ' || seg AS q, [' ' || seg || ' ', 'Already  Recommended songs', '  ', 'x' || k % 5] AS terms,
           CASE WHEN k % 2 = 0 THEN (k % 9)::VARCHAR END AS own_limit, CASE WHEN k % 3 = 0 THEN (k % 4 + 5)::VARCHAR END AS old_limit,
           CASE WHEN k % 4 = 0 THEN ['t1 ', 't1', 't' || k % 6] ELSE [] END AS tracks, CASE WHEN k % 5 < 2 THEN ['a' || k % 3, 'a0'] ELSE [] END AS songs FROM customers),
picked AS (SELECT session_id, CASE WHEN len(songs) > 0 AND len(tracks) = 0 THEN songs ELSE tracks END AS l FROM raw),
items AS (SELECT session_id, trim(unnest(l)) AS x, unnest(range(len(l))) AS pos FROM picked),
seen AS (SELECT session_id, string_agg(x, ',' ORDER BY pos) AS seen FROM (SELECT session_id, x, min(pos) AS pos FROM items WHERE x <> '' GROUP BY ALL) GROUP BY session_id),
stored AS (
    SELECT raw.session_id, owner, q, coalesce(own_limit, old_limit) AS "limit", coalesce(seen, '') AS seen,
           array_to_string(list_filter(list_transform(terms, lambda x: trim(x)), lambda x: x <> '' AND NOT regexp_replace(lower(x), '\s+', ' ', 'g') LIKE '%already recommended%'), ',') AS terms
    FROM raw LEFT JOIN seen USING (session_id)),
wanted AS (
    SELECT 's' || k AS session_id, CASE WHEN k % 11 = 0 THEN 'other' ELSE owner END AS user_id FROM customers UNION ALL SELECT 'n' || k, owner FROM customers WHERE k % 10 = 0)
SELECT session_id, user_id, CASE WHEN owner IS NULL THEN 'created' WHEN owner = user_id THEN 'loaded' ELSE 'refused' END AS status, q, "limit", seen, terms FROM wanted LEFT JOIN stored USING (session_id)
""")
def src9_tl21_sessions(spark, sf_dir):
    c = _customers(spark, sf_dir)
    wanted = c.select(F.concat(F.lit("s"), "k").alias("session_id"), F.when(F.expr("k % 11 = 0"), "other").otherwise(F.col("owner")).alias("user_id"))
    wanted = wanted.unionByName(c.where("k % 10 = 0").select(F.concat(F.lit("n"), "k").alias("session_id"), F.col("owner").alias("user_id")))
    met = me.opened(wanted, me.migrated_sessions(_stored(c)))
    return met.select("session_id", "user_id", "status", F.col("last_user_query").alias("q"), F.try_element_at("active_constraints", F.lit("limit")).alias("limit"), F.array_join("seen_track_ids", ",").alias("seen"), F.array_join("exclude_terms", ",").alias("terms"))


@query(CUSTOMERS + r"""
SELECT 's' || k AS session_id, CASE WHEN k % 3 = 0 THEN coalesce(nullif(trim(CASE WHEN k % 2 = 0 THEN ' more ' ELSE '  ' END), ''), 'recommend') ELSE 'recommend' END AS intent,
       CASE WHEN k % 4 = 0 THEN CASE WHEN k % 6 = 2 THEN seg ELSE seg || ',p' || k % 6 END ELSE '' END AS terms,
       CASE WHEN k % 5 = 0 THEN (k % 7)::VARCHAR WHEN k % 2 = 0 THEN (k % 9)::VARCHAR WHEN k % 3 = 0 THEN (k % 4 + 5)::VARCHAR END AS "limit",
       concat_ws(',', CASE WHEN k % 3 = 0 THEN 'current_intent' END, CASE WHEN k % 4 = 0 THEN 'preference_terms' END, CASE WHEN k % 5 = 0 THEN 'active_constraints' END) AS updated FROM customers
""")
def prj12_session_patch(spark, sf_dir):
    c = _customers(spark, sf_dir)
    patches = c.select(
        F.concat(F.lit("s"), "k").alias("session_id"), F.when(F.expr("k % 3 = 0"), F.when(F.expr("k % 2 = 0"), " more ").otherwise("  ")).alias("current_intent"),
        F.when(F.expr("k % 4 = 0"), F.array("seg", F.concat("seg", F.lit(" ")), F.lit(""), F.when(F.expr("k % 6 = 2"), F.col("seg")).otherwise(F.concat(F.lit("p"), F.col("k") % 6)))).alias("preference_terms"),
        F.when(F.expr("k % 5 = 0"), F.create_map(F.lit("limit"), (F.col("k") % 7).cast("string"))).alias("active_constraints"),
    )
    done = me.patched_sessions(me.migrated_sessions(_stored(c)), patches)
    return done.select("session_id", F.col("current_intent").alias("intent"), F.array_join("preference_terms", ",").alias("terms"), F.try_element_at("active_constraints", F.lit("limit")).alias("limit"), F.array_join("updated", ",").alias("updated"))


@query(CUSTOMERS + r""",
requests AS (
    SELECT k, CASE WHEN k % 3 = 0 THEN 'recommend' ELSE 'more' END AS intent, ['give me 5 songs', 'more', 'More DIVERSE please', '再来十首'][k % 4 + 1] AS q, (k % 6) / 10.0::DOUBLE AS own_score,
           CASE WHEN k % 5 = 0 THEN NULL ELSE k % 10 END AS lim, k % 2 AS mpa, CASE WHEN k % 7 < 3 THEN ['UK_Rock ', 'britpop', seg] ELSE ['  '] END AS own, seg FROM customers)
SELECT k, CASE WHEN intent = 'more' AND NOT regexp_matches(lower(q), '\d{1,2}\s*(首|songs?)|十首') THEN coalesce(nullif(lim, 0), 10) ELSE 10 END AS top_k,
       CASE WHEN intent = 'more' AND NOT regexp_matches(lower(q), 'diverse') THEN coalesce(nullif(mpa, 0), 2) ELSE 2 END AS max_per_artist,
       CASE WHEN intent = 'more' AND own_score <= 0 THEN 0.25::DOUBLE ELSE own_score END AS min_score,
       CASE WHEN intent <> 'more' THEN array_to_string(own, ',') WHEN k % 7 < 3 THEN 'british,' || seg ELSE 'jazz' END AS preference_terms,
       CASE WHEN intent <> 'more' THEN seg WHEN seg = 'building' THEN 'building' ELSE 'building,' || seg END AS exclude_terms FROM requests
""")
def sc38_inherited_constraints(spark, sf_dir):
    c = _customers(spark, sf_dir)
    k, seg = F.col("k"), F.col("seg")
    request = {
        "query": F.get(F.array(*[F.lit(x) for x in ("give me 5 songs", "more", "More DIVERSE please", "再来十首")]), (k % 4).cast("int")), "intent": F.when(k % 3 == 0, "recommend").otherwise("more"),
        "top_k": F.lit(10).cast("bigint"), "max_per_artist": F.lit(2).cast("bigint"), "min_score": (k % 6) / F.lit(10.0),
        "preference_terms": F.when(k % 7 < 3, F.array(F.lit("UK_Rock "), F.lit("britpop"), seg)).otherwise(F.array(F.lit("  "))), "exclude_terms": F.array(seg),
    }
    session = {"limit": F.when(k % 5 != 0, k % 10), "max_per_artist": k % 2, "min_score": F.lit(0.25), "preference_terms": F.array(F.lit("Jazz")), "exclude_terms": F.array(F.lit("building"))}
    out = me.inherited(request, session)
    return c.select("k", *[out[n].alias(n) for n in ("top_k", "max_per_artist", "min_score")], *[F.array_join(out[n], ",").alias(n) for n in ("preference_terms", "exclude_terms")])


@query(r"""
turns AS (SELECT session_id, turn, role, trim(coalesce(text, '')) AS said FROM messages),
ids AS (SELECT session_id, turn, unnest([(session_id + turn) % 50, session_id * turn % 7]) AS id, unnest([0, 1]) AS pos FROM turns WHERE role = 'assistant'),
first AS (SELECT session_id, id, min(turn * 2 + pos) AS pos FROM ids GROUP BY ALL),
seen AS (SELECT session_id, string_agg(id::VARCHAR, ',' ORDER BY pos) AS seen FROM first GROUP BY session_id),
kept AS (SELECT * FROM turns WHERE said <> '' QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) <= 100),
rings AS (SELECT session_id, count(*) AS messages, min(turn) AS first_kept, sum(length(said))::BIGINT AS chars FROM kept GROUP BY session_id)
SELECT t.session_id, count(*) FILTER (role = 'assistant') AS turn_count, coalesce(any_value(seen), '') AS seen, coalesce(any_value(messages), 0) AS messages, coalesce(any_value(first_kept), -1) AS first_kept, coalesce(any_value(chars), 0) AS chars
FROM turns t LEFT JOIN seen s ON s.session_id = t.session_id LEFT JOIN rings r ON r.session_id = t.session_id GROUP BY t.session_id
""")
def st3_session_memory(spark, sf_dir):
    ship_package(spark)
    raw = file_stream(spark, sf_dir, "conversations")
    turns = raw.select(F.col("conv_id").alias("session_id"), "turn", "role", "text", F.array((F.col("conv_id") + F.col("turn")) % 50, F.col("conv_id") * F.col("turn") % 7).alias("ids"))
    return run_to_end(me.session_memory(turns), "update").groupBy("session_id").agg(*[F.max_by(c, "batch").alias(c) for c in ("turn_count", "seen", "messages", "first_kept", "chars")])


@query("""SELECT seq, '{"artist":{"id":' || user_id || ',"name":"A' || song_id % 7 || '"},"kind":"' || kind || '","limit":' || song_id || '}' AS arguments FROM feedback""")
def sc27_stable_arguments(spark, sf_dir):
    ship_package(spark)
    f = ad.feedback(spark, sf_dir)
    artist = F.concat(F.lit('{"name": "A'), F.col("song_id") % 7, F.lit('", "id": '), "user_id", F.lit("}"))
    one = F.concat(F.lit('{"limit": '), "song_id", F.lit(', "kind": "'), "kind", F.lit('", "artist": '), artist, F.lit("}"))
    two = F.concat(F.lit('{"kind":"'), "kind", F.lit('","artist":'), artist, F.lit(',"limit":'), "song_id", F.lit("}"))
    return f.select("seq", me.stable_json(F.when(F.col("seq") % 2 == 0, one).otherwise(two)).alias("arguments"))


@query("""SELECT seq, '{"event":{"k":' || song_id || '},"people":[{"name":"u"},' || seq || ']}' AS kept FROM feedback""")
def prj14_private_fields(spark, sf_dir):
    ship_package(spark)
    text = F.concat(F.lit('{"user_id": '), "user_id", F.lit(', "event": {"k": '), "song_id", F.lit(', "user_id": {"a": 1}}, "people": [{"user_id": "x", "name": "u"}, '), "seq", F.lit("]}"))
    return ad.feedback(spark, sf_dir).select("seq", me.without_keys(text).alias("kept"))


@query("""
raw AS (SELECT song_id, CASE WHEN song_id % 2 = 0 THEN '{"' || title || '":1,"":2,"' || genre || '":0}' ELSE '["' || title || '","","' || genre || '"]' END::JSON AS j FROM songs)
SELECT song_id, array_to_string(list_filter(CASE WHEN json_type(j) = 'OBJECT' THEN json_keys(j) ELSE from_json(j, '["VARCHAR"]') END, lambda x: x <> ''), ',') AS labels FROM raw
""")
def sc23_label_lists(spark, sf_dir):
    as_map = F.concat(F.lit('{"'), "title", F.lit('":1,"":2,"'), "genre", F.lit('":0}'))
    as_list = F.concat(F.lit('["'), "title", F.lit('","","'), "genre", F.lit('"]'))
    return ad.songs(spark, sf_dir).select("song_id", F.array_join(me.label_list(F.when(F.col("song_id") % 2 == 0, as_map).otherwise(as_list)), ",").alias("labels"))


@query(CUSTOMERS + """,
asked AS (
    SELECT k, seg, k % 5 AS songs, CASE WHEN k % 2 = 0 THEN 'more' ELSE 'recommend' END AS intent, ['ok', 'empty_profile', 'external_search_failed', 'ok', 'ok', 'ok', 'ok'][k % 7 + 1] AS stop, k % 3 AS attempts, k % 4 = 1 AS searched,
           [' ' || seg, ['太朋克', '重复的', 'Noel', '这种'][k % 4 + 1], ''] AS terms FROM customers),
clean AS (SELECT *, list_filter(list_transform(terms, lambda x: trim(x)), lambda x: x <> '') AS t FROM asked)
SELECT k, CASE WHEN stop = 'empty_profile' THEN '收藏中还没有可用的种子歌曲，暂时无法生成推荐。'
       WHEN stop = 'external_search_failed' THEN '外部音乐搜索执行失败，暂时无法拿到候选歌曲。请稍后重试；如果持续失败，检查 Spotify 凭证或网络连接。'
       WHEN songs = 0 AND searched THEN '外部音乐搜索已执行，但没有找到符合当前条件的歌曲。可以放宽年份、风格或数量要求后再试。'
       WHEN songs = 0 THEN '执行了候选扩展和条件放宽，但当前曲库仍没有符合条件的歌曲。'
       ELSE concat_ws('；', '根据你的收藏画像和反馈，为你选出 ' || songs || ' 首歌', CASE WHEN intent = 'more' THEN '已避开本次会话中展示过的歌曲' END, '偏好：' || seg || '、jazz',
                      CASE WHEN len(list_filter(t, lambda x: lower(x) IN ('punk', '太朋克', '朋克'))) > 0 THEN '已避开太朋克的结果' END, CASE WHEN len(list_filter(t, lambda x: contains(x, '重复'))) > 0 THEN '已避开重复结果' END,
                      CASE WHEN len(list_filter(t, lambda x: regexp_matches(lower(x), 'gallagher|noel|liam'))) > 0 THEN '已避开 Gallagher 支线结果' END,
                      CASE WHEN len(list_filter(t, lambda x: lower(x) NOT IN ('重复的', '重复', 'punk', '太朋克', '朋克') AND NOT contains(x, '这种'))) > 0 THEN '已避开用户明确排除的艺人' END,
                      CASE WHEN k % 6 = 1 THEN '已增强歌手多样性' END, CASE WHEN attempts > 1 THEN '经过 ' || attempts || ' 次候选调整' END)
            || CASE WHEN searched THEN '。每首歌都基于外部搜索结果和用户画像评分。' ELSE '。每首歌都保留了 L4 分数拆解和推荐原因。' END END AS message FROM clean
""")
def sc32_response_message(spark, sf_dir):
    k = F.col("k")
    pick = lambda n, *texts: F.get(F.array(*[F.lit(x) for x in texts]), (k % n).cast("int"))
    terms = F.array(F.concat(F.lit(" "), "seg"), pick(4, "太朋克", "重复的", "Noel", "这种"), F.lit(""))
    message = me.response_message(F.when(k % 2 == 0, "more").otherwise("recommend"), k % 5, pick(7, "ok", "empty_profile", "external_search_failed", "ok", "ok", "ok", "ok"), k % 3, F.array("seg", F.lit("jazz")), terms, k % 6, k % 4 == 1, k % 4 == 1)
    return _customers(spark, sf_dir).select("k", message.alias("message"))


@query("""
raw AS (SELECT seq, ['liked', 'skipped', 'saved', 'playlist_add', 'request_similar', 'hide_artist', 'hide_track', 'play_complete', 'unknown'][seq % 9 + 1] AS event, seq % 3 = 0 AS run, seq % 2 = 0 AS sink FROM feedback),
named AS (SELECT *, CASE event WHEN 'liked' THEN 'like' WHEN 'skipped' THEN 'skip' WHEN 'saved' THEN 'favorite' WHEN 'request_similar' THEN 'like' WHEN 'hide_artist' THEN 'dislike' WHEN 'hide_track' THEN 'dislike' ELSE event END AS feedback_type FROM raw)
SELECT seq, feedback_type, CASE feedback_type WHEN 'like' THEN 6 WHEN 'skip' THEN -4 WHEN 'favorite' THEN 8 WHEN 'playlist_add' THEN 10 WHEN 'dislike' THEN -10 WHEN 'play_complete' THEN 4 END::BIGINT AS reward10,
       CASE WHEN run AND NOT sink THEN 'partial' ELSE 'ok' END AS status, CASE WHEN run AND NOT sink THEN 'record_feedback' END AS suggested FROM named
""")
def tl9_prj13_agent_feedback(spark, sf_dir):
    events = ("liked", "skipped", "saved", "playlist_add", "request_similar", "hide_artist", "hide_track", "play_complete", "unknown")
    event = F.get(F.array(*[F.lit(x) for x in events]), (F.col("seq") % 9).cast("int"))
    return ad.feedback(spark, sf_dir).select("seq", *me.recorded_feedback(event, F.when(F.col("seq") % 3 == 0, "run"), F.col("seq") % 2 == 0))


@query("""
asked AS (SELECT user_id, song_id FROM collection UNION ALL SELECT DISTINCT user_id, -user_id FROM collection WHERE user_id % 3 = 0),
known AS (SELECT song_id, CASE WHEN song_id % 40 = 0 THEN 'partial' ELSE 'ok' END AS status FROM songs)
SELECT user_id AS request_id, count(status) AS found, coalesce(string_agg(CASE WHEN status IS NULL THEN a.song_id END::VARCHAR, ','), '') AS missing,
       CASE WHEN bool_and(coalesce(status = 'ok', false)) THEN 'ok' ELSE 'partial' END AS status
FROM asked a LEFT JOIN known k ON k.song_id = a.song_id GROUP BY user_id
""")
def tl1_track_metadata(spark, sf_dir):
    c = ad.collection(spark, sf_dir).select(F.col("user_id").alias("request_id"), "song_id")
    asked = c.unionByName(c.where("request_id % 3 = 0").select("request_id", (-F.col("request_id")).alias("song_id")).distinct())
    songs = ad.songs(spark, sf_dir).select("song_id", F.when(F.col("song_id") % 40 == 0, "partial").otherwise("ok").alias("status"))
    return me.track_metadata(asked, songs).withColumn("missing", F.array_join(F.transform("missing", lambda x: x.cast("string")), ","))


@query("""
found AS (SELECT genre AS query, 'spotify' AS provider FROM songs WHERE song_id % 2 = 0 UNION ALL SELECT genre, 'musicbrainz' FROM songs WHERE song_id % 3 = 0),
counts AS (SELECT query, provider, count(*) AS n FROM found GROUP BY ALL),
asked AS (SELECT genre AS query FROM songs UNION SELECT artist FROM songs)
SELECT query, coalesce(sum(n), 0)::BIGINT AS tracks, coalesce(string_agg(provider || '=' || n, ',' ORDER BY provider), '') AS providers,
       CASE WHEN count(n) = 0 THEN 'empty' WHEN length(query) % 2 = 0 THEN 'partial' ELSE 'ok' END AS status FROM asked LEFT JOIN counts USING (query) GROUP BY query
""")
def tl2_search_tracks(spark, sf_dir):
    s = ad.songs(spark, sf_dir)
    of = lambda name, n: s.where(F.col("song_id") % n == 0).select(F.col("genre").alias("query"), F.lit(name).alias("provider"))
    queries = s.select(F.col("genre").alias("query")).unionByName(s.select(F.col("artist").alias("query")))
    return me.search_report(queries, of("spotify", 2).unionByName(of("musicbrainz", 3)), queries.where(F.length("query") % 2 == 0))


@query("""
raw AS (SELECT song_id, title, artist, CASE song_id % 3 WHEN 0 THEN ' spotify:track:' || song_id WHEN 1 THEN '' ELSE 'mb:' || song_id END AS t, CASE WHEN song_id % 4 = 0 THEN '' ELSE 'spotify' END AS p, CASE WHEN song_id % 2 = 0 THEN genre END AS reason FROM songs)
SELECT song_id AS rank, CASE WHEN trim(t) <> '' THEN trim(t) ELSE artist || '::' || title END AS song_id, title, artist, 0.0::DOUBLE AS final_score, 0.0::DOUBLE AS diversity_penalty, coalesce(reason, '') AS ranking_reasons,
       CASE WHEN p = '' THEN 'provider' ELSE p END || '_discovery' AS retrieval_source, CASE WHEN trim(t) LIKE 'spotify:track:%' THEN song_id::VARCHAR END AS spotify_track_id, trim(t) LIKE 'spotify:track:%' AS preview_available FROM raw
""")
def prj4_tl3_discovered_tracks(spark, sf_dir):
    n = F.col("song_id")
    found = ad.songs(spark, sf_dir).select(
        n.alias("rank"), F.when(n % 3 == 0, F.concat(F.lit(" spotify:track:"), n)).when(n % 3 == 1, "").otherwise(F.concat(F.lit("mb:"), n)).alias("track_id"), "title", "artist",
        F.when(n % 4 == 0, "").otherwise("spotify").alias("provider"), F.when(n % 2 == 0, F.col("genre")).alias("reason"),
    )
    return me.ranked_shape(found).withColumn("ranking_reasons", F.array_join("ranking_reasons", ","))


@query("""
streamed AS (
    SELECT 's' || song_id AS id, 'spotify:track:' || song_id AS track_id, 'spotify' AS provider, title, artist, 'LP' || song_id % 9 AS album, CASE WHEN song_id % 4 <> 0 THEN year END AS release_year, duration_ms,
           CASE WHEN song_id % 3 = 0 THEN 'http://i/' || song_id END AS image_url FROM songs),
collected AS (
    SELECT 'c' || song_id, CASE song_id % 3 WHEN 0 THEN 'spotify:track:' || song_id WHEN 1 THEN 'musicbrainz:recording:' || song_id ELSE 'lastfm:track:' || title END, CASE song_id % 3 WHEN 0 THEN 'spotify' WHEN 1 THEN 'musicbrainz' ELSE 'lastfm' END,
           title, artist, 'LP' || song_id % 9, year, duration_ms, NULL FROM songs)
SELECT * FROM streamed UNION ALL SELECT * FROM collected
""")
def prj5_provider_tracks(spark, sf_dir):
    s, n = ad.songs(spark, sf_dir), F.col("song_id")
    album = F.concat(F.lit("LP"), n % 9)
    date = F.when(n % 4 == 0, "19").otherwise(F.concat(F.col("year"), F.lit("-05-01")))
    images = F.when(n % 3 == 0, F.array(F.struct(F.concat(F.lit("http://i/"), n).alias("url"))))
    streamed = F.to_json(F.struct(n.cast("string").alias("id"), F.col("title").alias("name"), "duration_ms", F.struct(album.alias("name"), date.alias("release_date"), images.alias("images")).alias("album"), F.array(F.struct(F.lit("").alias("name")), F.struct(F.col("artist").alias("name"))).alias("artists")))
    collected = F.to_json(F.struct(F.lit("Last.fm").alias("source"), F.when(n % 3 == 0, n.cast("string")).alias("spotify_track_id"), F.when(n % 3 == 1, n.cast("string")).alias("musicbrainz_recording_id"), "title", F.array("artist").alias("artists"), album.alias("album"), F.col("year").alias("release_year"), "duration_ms"))
    one, two = s.select(F.concat(F.lit("s"), n).alias("id"), me.streaming_track(streamed).alias("t")), s.select(F.concat(F.lit("c"), n).alias("id"), me.collected_track(collected).alias("t"))
    return one.unionByName(two).select("id", "t.*")


@query(r"""
SELECT song_id AS n, regexp_replace(lower(artist), '[^a-z0-9]+', '-', 'g') || '-' || lpad((song_id % 30)::VARCHAR, 2, '0') || '-' || trim(regexp_replace(replace(lower(title || CASE WHEN song_id % 5 = 0 THEN '?' ELSE ' (Live)' END), '?', '-question'), '[^a-z0-9]+', '-', 'g'), '-') AS song_id FROM songs
""")
def src14_catalogue_ids(spark, sf_dir):
    from melisma.functions import text

    n = F.col("song_id")
    title = F.concat("title", F.when(n % 5 == 0, "?").otherwise(" (Live)"))
    return ad.songs(spark, sf_dir).select(n.alias("n"), me.album_song_id(text.slug(F.col("artist")), (n % 30).cast("int"), title).alias("song_id"))


@query("""
old AS (SELECT trajectory_id, count(*) AS n FROM steps WHERE rank <= 2 GROUP BY trajectory_id),
new AS (SELECT trajectory_id, string_agg(kind || ':' || song_id, ',' ORDER BY seq) AS added, string_agg(song_id::VARCHAR, ',' ORDER BY seq) FILTER (kind IN ('favorite', 'playlist_add')) AS writes, count(*) AS m FROM steps WHERE rank > 2 GROUP BY trajectory_id)
SELECT trajectory_id, n + coalesce(m, 0) AS events, coalesce(added, '') AS added, coalesce(writes, '') AS writes FROM old LEFT JOIN new USING (trajectory_id)
""")
def snk2_append_feedback(spark, sf_dir):
    t = ad.trajectories(spark, sf_dir).withColumn("trajectory_id", F.concat_ws("-", F.col("user_id").cast("string"), "day"))
    entry = lambda s: F.struct(s["seq"].alias("seq"), s["kind"].alias("kind"), s["song_id"].alias("song_id"))
    old = t.select("trajectory_id", F.transform(F.slice("steps", 1, 2), entry).alias("events"))
    new = t.select("trajectory_id", F.posexplode("steps").alias("i", "s")).where("i >= 2").select("trajectory_id", "s.seq", "s.kind", "s.song_id")
    done = me.with_feedback(old, new)
    joined = lambda c, f: F.array_join(F.transform(c, f), ",")
    added = joined(F.slice("events", 3, 1_000_000_000), lambda e: F.concat(e["kind"], F.lit(":"), e["song_id"].cast("string")))
    return done.select("trajectory_id", F.size("events").cast("bigint").alias("events"), added.alias("added"), joined(F.col("writes"), lambda x: x.cast("string")).alias("writes"))


@query(PROFILES + ", done AS (SELECT c_custkey AS user_id, coalesce(ids, []) AS ids, coalesce(feedback, []) AS feedback, coalesce(version, 1) AS version FROM customer LEFT JOIN profiles ON user_id = c_custkey)" + SHOWN + "done")
def src2_load_or_create(spark, sf_dir):
    users = ad.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))
    return _shown(me.loaded_profiles(users, _profiles(spark, sf_dir)))
