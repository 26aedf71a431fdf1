"""Queries on the catalogue, sessions, external candidates and texts, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from melisma.functions import text as tx
from melisma.operators import catalogue as ct
from melisma.operators import feedback as fb
from melisma.operators import sessions as se
from melisma.operators import retrieval as rt
from melisma.plans.recommend import GRID, PREFS, query, scored
from melisma.sources import adapters as ad

#: The patterns of the text rules, as DuckDB's engine writes them.
TITLES = r"""
titled AS (
    SELECT song_id, artist, title, title || [' (Live at ' || genre || ')', ' - Remastered ' || year, ' [Deluxe Edition]', ' (with ' || artist || ')', '', ' - ' || year || ' Mono Mix', ' (Acoustic Demo) [' || genre || ']', ' - Single', ' & Friends Pt. 2'][song_id % 9 + 1] AS full_title FROM songs),
bare AS (SELECT *, regexp_replace(full_title, '(?i)[\[(][^\])]*\b(?:remaster(?:ed)?|live|mono|stereo|acoustic|demo|edit|mix|version)\b[^\])]*[\])]', '', 'g') AS b FROM titled),
canonical AS (
    SELECT *, CASE WHEN regexp_matches(regexp_extract(b, '(?s)^(.*?)\s+-\s+(.*)$', 2), '(?i)\b(?:remaster(?:ed)?|live|mono|stereo|acoustic|demo|edit|mix|version)\b') THEN regexp_extract(b, '(?s)^(.*?)\s+-\s+(.*)$', 1) ELSE b END AS c FROM bare),
kinds AS (
    SELECT *, CASE WHEN regexp_matches(full_title, '(?i)\b(?:re-?master(?:ed)?|remaster)\b') THEN 'remastered' WHEN regexp_matches(full_title, '(?i)\b(?:live|concert|unplugged|session|at\s+\w+\s+(?:arena|stadium|hall))\b') THEN 'live'
        WHEN regexp_matches(full_title, '(?i)\b(?:cover|tribute|karaoke)\b') THEN 'cover' WHEN trim(full_title) <> '' THEN 'original' ELSE 'unknown' END AS kind FROM titled)
"""


def _titled(spark, sf_dir):
    s = ad.songs(spark, sf_dir)
    year = F.col("year").cast("string")
    notes = F.array(
        F.concat(F.lit(" (Live at "), "genre", F.lit(")")), F.concat(F.lit(" - Remastered "), year), F.lit(" [Deluxe Edition]"), F.concat(F.lit(" (with "), "artist", F.lit(")")), F.lit(""),
        F.concat(F.lit(" - "), year, F.lit(" Mono Mix")), F.concat(F.lit(" (Acoustic Demo) ["), "genre", F.lit("]")), F.lit(" - Single"), F.lit(" & Friends Pt. 2"),
    )
    return s.select("song_id", "artist", "title", F.concat("title", F.get(notes, (F.col("song_id") % 9).cast("int"))).alias("full_title"))


@query(TITLES + r"""
SELECT song_id, trim(regexp_replace(lower(artist), '[^a-z0-9]+', ' ', 'g')) AS artist_words, trim(regexp_replace(lower(c), '[^a-z0-9]+', ' ', 'g')) AS title_key,
       lower(trim(regexp_replace(full_title, '\s+', ' ', 'g'))) AS label, regexp_replace(lower(full_title), '[^a-z0-9]', '', 'g') AS compact FROM canonical
""")
def sc1_sc4_text_norms(spark, sf_dir):
    t = F.col("full_title")
    return _titled(spark, sf_dir).select("song_id", tx.alnum_words(F.col("artist")).alias("artist_words"), tx.canonical_title(t).alias("title_key"), tx.label(t).alias("label"), tx.compact(t).alias("compact"))


@query(TITLES + r""",
spelled AS (SELECT *, regexp_replace(replace(replace(lower(strip_accents(full_title)), '&', ' and '), '?', ' questionmark '), '\bpt\.?\s*(\d+)\b', 'part \1', 'g') AS i FROM kinds),
parts AS (
    SELECT *, lower(full_title) AS l, regexp_replace(lower(full_title), '[^a-z0-9]', '', 'g') AS whole FROM spelled),
marked AS (
    SELECT *, concat_ws(' ', CASE WHEN contains(l, ' - ') THEN substr(l, strpos(l, ' - ') + 3) ELSE '' END, CASE WHEN contains(l, '(') THEN substr(l, strpos(l, '(') + 1) ELSE '' END, '') AS m,
        split_part(split_part(split_part(split_part(split_part(split_part(split_part(split_part(split_part(split_part(whole, 'remaster', 1), 'remastered', 1), 'deluxe', 1), 'radio2session', 1), 'session', 1), 'live', 1), 'edit', 1), 'version', 1), 'mono', 1), 'stereo', 1) AS cut FROM parts)
SELECT song_id, regexp_replace(regexp_replace(i, '(?i)\s*[-–—(\[]\s*(?:(?:\d{4}\s+)?re-?master(?:ed)?(?:\s+version)?|live(?:\s+at[^)\]]*)?|concert|unplugged|session|cover|tribute|karaoke|original(?:\s+version)?)[^)\]]*[)\]]?\s*$', ''), '[^a-z0-9]+', '', 'g') AS identity, kind,
       CASE WHEN regexp_matches(m, 'live|session|acoustic|mtv unplugged') THEN 'live_or_session' WHEN regexp_matches(m, 'remaster') THEN 'remastered' WHEN regexp_matches(m, 'deluxe|bonus') THEN 'deluxe' ELSE 'album_cut' END AS label,
       lower(artist) || '::' || CASE WHEN cut = '' THEN whole ELSE cut END AS signature FROM marked
""")
def sc5_sc7_sc8_sc9_versions(spark, sf_dir):
    t, none = F.col("full_title"), F.lit("")
    return _titled(spark, sf_dir).select("song_id", tx.identity(t).alias("identity"), tx.version_class(t, none, none).alias("kind"), tx.external_version(t, none).alias("label"), tx.track_signature(t, F.col("artist")).alias("signature"))


@query(r"""
named AS (SELECT c_custkey AS id, n_name || ' ' || ['Gallagher', 'albarn', 'Ashcroft Band', 'Smith', 'Gallaghers', 'Ashcrofts'][c_custkey % 6 + 1] || CASE WHEN c_custkey % 7 = 0 THEN ' & Sons' ELSE '' END AS artist FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT id, CASE WHEN regexp_matches(lower(artist), '\b[a-z]+ gallagher\b') THEN 'gallagher' WHEN regexp_matches(lower(artist), '\b[a-z]+ ashcroft\b') THEN 'ashcroft' WHEN regexp_matches(lower(artist), '\b[a-z]+ albarn\b') THEN 'albarn'
    WHEN contains(lower(artist), 'gallagher') THEN 'gallagher' ELSE '' END AS family, regexp_replace(regexp_replace(lower(artist), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM named
""")
def sc10_sc12_family_slug(spark, sf_dir):
    k = F.col("c_custkey")
    last = F.get(F.array(*[F.lit(x) for x in ("Gallagher", "albarn", "Ashcroft Band", "Smith", "Gallaghers", "Ashcrofts")]), (k % 6).cast("int"))
    named = ad.table(spark, sf_dir, "customer").join(ad.table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    artist = F.concat("n_name", F.lit(" "), last, F.when(k % 7 == 0, " & Sons").otherwise(""))
    return named.select(k.alias("id"), tx.family_key(artist).alias("family"), tx.slug(artist).alias("slug"))


@query(r"SELECT event_id, strftime(ts, '%Y')::INT AS year, try_cast(strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS TIMESTAMP) IS NOT NULL AS valid FROM events")
def sc28_sc29_dates(spark, sf_dir):
    e = ad.table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"))
    return e.select("event_id", tx.first_year(F.col("iso")).alias("year"), F.try_to_timestamp("iso").isNotNull().alias("valid"))


RAW = """
raw AS (
    SELECT p_partkey AS song_id, 'track_tags' AS field, CASE p_size % 6 WHEN 0 THEN 'Indie_Rock' WHEN 1 THEN 'rock' WHEN 2 THEN '90s' WHEN 3 THEN 'Post-Punk' WHEN 4 THEN 'seen live' ELSE 'hip-hop' END AS label, (p_size * 2)::BIGINT AS w, 1 AS pos FROM part
    UNION ALL SELECT p_partkey, 'track_tags', CASE p_size % 3 WHEN 0 THEN 'indie/rock' WHEN 1 THEN 'ROCK' ELSE 'jazz' END, 40, 2 FROM part
    UNION ALL SELECT p_partkey, 'artist_tags', CASE p_partkey % 4 WHEN 0 THEN 'rock' WHEN 1 THEN 'r&b' WHEN 2 THEN 'british' ELSE 'soul' END, 10, 1 FROM part
    UNION ALL SELECT p_partkey, 'artist_tags', 'jazz', (p_partkey % 9)::BIGINT, 2 FROM part),
scaled AS (SELECT song_id, field, pos, lower(regexp_replace(label, '[_/]+', ' ', 'g')) AS name, floor(w::DOUBLE / nullif(max(w) OVER (PARTITION BY song_id, field), 0) * 1e4 + 0.5)::BIGINT AS score4 FROM raw),
norm AS (SELECT song_id, field, name, arg_max(score4, pos) AS score4 FROM scaled WHERE score4 IS NOT NULL GROUP BY ALL)
"""


def _raw_tags(spark, sf_dir):
    p = ad.table(spark, sf_dir, "part")
    z, k = F.col("p_size"), F.col("p_partkey")
    one = F.when(z % 6 == 0, "Indie_Rock").when(z % 6 == 1, "rock").when(z % 6 == 2, "90s").when(z % 6 == 3, "Post-Punk").when(z % 6 == 4, "seen live").otherwise("hip-hop")
    two = F.when(z % 3 == 0, "indie/rock").when(z % 3 == 1, "ROCK").otherwise("jazz")
    three = F.when(k % 4 == 0, "rock").when(k % 4 == 1, "r&b").when(k % 4 == 2, "british").otherwise("soul")
    row = lambda f, label, w, pos: F.struct(F.lit(f).alias("field"), label.alias("label"), w.cast("bigint").alias("w"), F.lit(pos).alias("pos"))
    rows = F.array(row("track_tags", one, z * 2, 1), row("track_tags", two, F.lit(40), 2), row("artist_tags", three, F.lit(10), 1), row("artist_tags", F.lit("jazz"), k % 9, 2))
    return p.select(k.alias("song_id"), F.inline(rows))


@query(RAW + "SELECT * FROM norm")
def agg20_normalised_tags(spark, sf_dir):
    return ct.normalised_tags(_raw_tags(spark, sf_dir))


@query(RAW + """,
alias(name, genre) AS (VALUES ('indie rock', 'indie_rock'), ('rock', 'rock'), ('post-punk', 'post_punk'), ('hip-hop', 'hip_hop'), ('jazz', 'jazz'), ('r&b', 'r_and_b'), ('soul', 'soul'))
SELECT song_id, genre, max(floor(score4 * CASE WHEN field = 'track_tags' THEN 1.0::DOUBLE ELSE 0.4::DOUBLE END + 0.5)::BIGINT) AS weight4
FROM norm JOIN alias USING (name) WHERE score4 >= CASE WHEN field = 'track_tags' THEN 500 ELSE 2000 END GROUP BY ALL
""")
def agg21_flt14_genres(spark, sf_dir):
    return ct.genres(ct.normalised_tags(_raw_tags(spark, sf_dir)), ad.songs(spark, sf_dir))


@query("SELECT name, floor(w::DOUBLE / max(w) OVER () * 1e4 + 0.5)::BIGINT AS weight4 FROM (SELECT lower(label) AS name, max(w) AS w FROM tags GROUP BY ALL)")
def agg22_provider_tags(spark, sf_dir):
    return ct.provider_tags(ad.tags(spark, sf_dir))


@query("SELECT lower(artist) AS artist, field, label, count(DISTINCT song_id) AS songs, max(w) AS w FROM songs JOIN tags USING (song_id) GROUP BY ALL")
def agg17_artist_profile(spark, sf_dir):
    return ct.artist_profiles(ad.songs(spark, sf_dir), ad.tags(spark, sf_dir))


SOURCES = """
base AS (SELECT song_id, regexp_replace(lower(title || song_id), '[^a-z0-9]+', '', 'g') AS title_key, regexp_replace(lower(artist), '[^a-z0-9]+', '', 'g') AS artist_key, genre, year::VARCHAR AS year, duration_ms::VARCHAR AS duration FROM songs),
one AS (SELECT title_key, artist_key, CASE WHEN song_id % 4 <> 0 THEN genre END AS genre, NULL::VARCHAR AS year, duration, NULL::VARCHAR AS score FROM base WHERE song_id % 3 <> 0),
two AS (SELECT title_key, artist_key, 'b:' || genre AS genre, year, CASE WHEN song_id % 5 = 0 THEN ' ' ELSE '0' END AS duration, (song_id * 7 % 130)::VARCHAR AS score FROM base WHERE song_id % 2 = 0),
three AS (SELECT title_key, artist_key, NULL::VARCHAR AS genre, '1900' AS year, NULL::VARCHAR AS duration, NULL::VARCHAR AS score FROM base WHERE song_id % 5 = 0),
every AS (SELECT 0 AS trust, 'one' AS source, * FROM one UNION ALL SELECT 1, 'two', * FROM two UNION ALL SELECT 2, 'three', * FROM three),
clean AS (SELECT trust, source, title_key, artist_key, nullif(trim(genre), '') AS genre, nullif(trim(year), '') AS year, nullif(trim(duration), '') AS duration, nullif(trim(score), '') AS score FROM every),
merged AS (
    SELECT title_key, artist_key, arg_min(genre, trust) FILTER (WHERE genre IS NOT NULL) AS genre, arg_min(year, trust) FILTER (WHERE year IS NOT NULL) AS year,
           arg_min(duration, trust) FILTER (WHERE duration IS NOT NULL) AS duration, arg_min(score, trust) FILTER (WHERE score IS NOT NULL) AS score,
           coalesce(string_agg(source, ',' ORDER BY trust) FILTER (WHERE genre IS NOT NULL), '') AS genre_from, coalesce(string_agg(source, ',' ORDER BY trust) FILTER (WHERE year IS NOT NULL), '') AS year_from,
           coalesce(string_agg(source, ',' ORDER BY trust) FILTER (WHERE duration IS NOT NULL), '') AS duration_from, list_sort(list(DISTINCT source)) AS sources FROM clean GROUP BY ALL)
"""


def _merged(spark, sf_dir):
    s = ad.songs(spark, sf_dir)
    k = F.col("song_id")
    base = s.select("song_id", tx.identity(F.concat("title", k.cast("string")), accents=False).alias("title_key"), tx.identity(F.col("artist"), accents=False).alias("artist_key"), "genre", "year", "duration_ms")
    keys = ["title_key", "artist_key"]
    one = base.where(k % 3 != 0).select(*keys, F.when(k % 4 != 0, F.col("genre")).alias("genre"), F.lit(None).cast("string").alias("year"), F.col("duration_ms").alias("duration"), F.lit(None).cast("string").alias("score"))
    two = base.where(k % 2 == 0).select(*keys, F.concat(F.lit("b:"), "genre").alias("genre"), "year", F.when(k % 5 == 0, " ").otherwise("0").alias("duration"), (k * 7 % 130).cast("string").alias("score"))
    three = base.where(k % 5 == 0).select(*keys, F.lit(None).cast("string").alias("genre"), F.lit("1900").alias("year"), F.lit(None).cast("string").alias("duration"), F.lit(None).cast("string").alias("score"))
    return ct.merged_records([("one", one), ("two", two), ("three", three)], ["genre", "year", "duration", "score"])


@query(SOURCES + "SELECT * EXCLUDE (score, sources), array_to_string(sources, ',') AS sources FROM merged")
def jn10_sc34_sc35_entity_merge(spark, sf_dir):
    return _merged(spark, sf_dir).drop("score", "score_from").withColumn("sources", F.array_join("sources", ","))


@query(SOURCES + """
SELECT title_key, artist_key, least(10000, (list_contains(sources, 'one'))::INT * 2000 + CASE WHEN list_contains(sources, 'two') THEN 20 * least(100, greatest(0, coalesce(nullif(score::INT, 0), 100))) ELSE 0 END
    + (list_contains(sources, 'three') AND year IS NOT NULL)::INT * 1500 + (len(sources) > 1)::INT * 2500
    + floor(1000 * (2 + (genre IS NOT NULL)::INT + (year IS NOT NULL)::INT + (duration IS NOT NULL)::INT) / 5.0::DOUBLE + 0.5) + (genre IS NOT NULL)::INT * 1000)::BIGINT AS confidence4 FROM merged
""")
def agg23_confidence(spark, sf_dir):
    m = _merged(spark, sf_dir)
    c = ct.confidence(m, ("one", "two", "three"), F.col("score"), F.col("year").isNotNull(), ["title_key", "artist_key", "genre", "year", "duration"], F.col("genre").isNotNull())
    return m.select("title_key", "artist_key", c.alias("confidence4"))


@query(TITLES + """
SELECT artist, title, song_id FROM (
    SELECT *, row_number() OVER (PARTITION BY artist, title ORDER BY CASE kind WHEN 'remastered' THEN 3 WHEN 'original' THEN 2 WHEN 'live' THEN 1 WHEN 'cover' THEN 1 ELSE 0 END DESC, song_id) AS n FROM kinds) WHERE n = 1
""")
def win9_version_pick(spark, sf_dir):
    t = _titled(spark, sf_dir)
    kind = tx.version_class(F.col("full_title"))
    picked = ct.preferred_version(t, ["artist", "title"], kind, ct.completeness(F.col("artist"), F.col("title")), F.lit(0), F.col("song_id"))
    return picked.select("artist", "title", "song_id")


@query("""
best AS (SELECT song_id, string_agg(label, ',' ORDER BY w DESC, label) AS labels FROM (SELECT *, row_number() OVER (PARTITION BY song_id ORDER BY w DESC, label) AS n FROM tags WHERE field <> 'artist_tags') WHERE n <= 3 GROUP BY song_id),
fav AS (SELECT user_id, song_id, min(seq) AS first_favorite FROM feedback WHERE kind IN ('favorite', 'playlist_add') GROUP BY ALL)
SELECT c.user_id, c.song_id, coalesce(title, 'missing') AS title, artist, labels, first_favorite FROM collection c LEFT JOIN songs USING (song_id) LEFT JOIN best USING (song_id) LEFT JOIN fav f ON f.user_id = c.user_id AND f.song_id = c.song_id
""")
def prj6_jn16_collection_view(spark, sf_dir):
    return ct.collection_view(ad.collection(spark, sf_dir).drop("first_order"), ad.songs(spark, sf_dir), ad.tags(spark, sf_dir), ad.feedback(spark, sf_dir))


@query("""
ids AS (SELECT song_id, CASE WHEN song_id % 3 = 0 THEN 'short' ELSE substr(md5(song_id::VARCHAR), 1, 22) END AS external_id FROM songs)
SELECT c.user_id, c.song_id, i.external_id, 'https://open.spotify.com/embed/track/' || i.external_id AS url FROM collection c LEFT JOIN ids i ON i.song_id = c.song_id AND length(i.external_id) = 22
""")
def prj8_flt19_playback(spark, sf_dir):
    ids = ad.songs(spark, sf_dir).select("song_id", F.when(F.col("song_id") % 3 == 0, "short").otherwise(F.substring(F.md5(F.col("song_id").cast("string")), 1, 22)).alias("external_id"))
    return ct.playback(ad.collection(spark, sf_dir).drop("first_order"), ids)


@query("SELECT song_id FROM songs WHERE contains(lower(title), 'ring') OR contains(lower(artist), 'ring') OR contains(lower(genre), 'ring')")
def flt3_term_match(spark, sf_dir):
    return ad.songs(spark, sf_dir).where(se.matches_term(F.lit("Ring"), F.col("title"), F.col("artist"), F.col("genre"))).select("song_id")


RANKED = """
listed AS (SELECT f.user_id, s.song_id, s.artist AS artist_key, lower(s.artist) || '::' || regexp_replace(lower(s.title), '[^a-z0-9]', '', 'g') AS signature, s.title, s.genre, min(seq) AS shown_at FROM feedback f JOIN songs s USING (song_id) WHERE reward10 > 0 GROUP BY ALL),
banned AS (SELECT DISTINCT user_id, song_id FROM feedback WHERE reward10 < 0),
open AS (SELECT * FROM listed l WHERE NOT EXISTS (SELECT 1 FROM banned b WHERE b.user_id = l.user_id AND b.song_id = l.song_id) AND NOT contains(lower(title), 'hot'))
"""


@query(RANKED + """,
once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, signature ORDER BY shown_at) AS s FROM open) WHERE s = 1)
SELECT user_id, song_id, nth FROM (SELECT *, row_number() OVER (PARTITION BY user_id, artist_key ORDER BY shown_at) AS nth FROM once) WHERE nth <= 2
""")
def flt6_flt7_session_filter(spark, sf_dir):
    f, s = ad.feedback(spark, sf_dir), ad.songs(spark, sf_dir)
    songs = s.select("song_id", F.col("artist").alias("artist_key"), tx.track_signature(F.col("title"), F.col("artist")).alias("signature"), "title")
    listed = f.where("reward10 > 0").groupBy("user_id", "song_id").agg(F.min("seq").alias("at")).join(songs, "song_id")
    banned = f.where("reward10 < 0").select("user_id", "song_id").distinct()
    kept = se.unseen(listed, banned, ["user_id", "song_id"]).where(~se.matches_term(F.lit("hot"), F.col("title")))
    return se.first_by_signature_with_cap(kept, ["user_id"], [F.col("at")], 2).select("user_id", "song_id", "nth")


@query("""
given AS (
    SELECT song_id, list_filter(list_transform([genre, split_part(title, ' ', 1), ['UK rock', 'Rock', 'dream  pop', 'Jazz', 'english_rock', '', 'BritPop'][song_id % 7 + 1], ['pop', 'rock', 'soul'][song_id % 3 + 1]],
        lambda x: lower(trim(regexp_replace(x, '[\\s_]+', ' ', 'g')))), lambda x: x <> '') AS terms FROM songs),
placed AS (SELECT song_id, unnest(terms) AS term, unnest(range(len(terms))) AS pos FROM given),
wide AS (
    SELECT song_id, term, pos * 2 AS pos FROM placed
    UNION ALL SELECT song_id, 'british', pos * 2 + 1 FROM placed WHERE term IN ('british rock', 'uk rock', 'english rock', 'britpop')),
once AS (SELECT song_id, term, min(pos) AS pos, term IN ('rock', 'pop', 'jazz', 'electronic', 'folk', 'soul', 'punk', 'metal', 'country', 'blues', 'classical', 'ambient') AS broad FROM wide GROUP BY ALL)
SELECT song_id, string_agg(term, ',' ORDER BY pos) AS terms FROM (SELECT *, bool_and(broad) OVER (PARTITION BY song_id) AS only_broad FROM once) WHERE only_broad OR NOT broad GROUP BY song_id
""")
def flt8_effective_terms(spark, sf_dir):
    pick = lambda names, n: F.get(F.array(*[F.lit(x) for x in names]), (F.col("song_id") % n).cast("int"))
    given = F.array("genre", F.get(F.split("title", " "), F.lit(0)), pick(("UK rock", "Rock", "dream  pop", "Jazz", "english_rock", "", "BritPop"), 7), pick(("pop", "rock", "soul"), 3))
    return ad.songs(spark, sf_dir).select("song_id", F.array_join(se.effective_terms(given), ",").alias("terms"))


@query("""SELECT song_id, CASE WHEN song_id % 2 = 0 THEN song_id % 3 = 1 ELSE (song_id % 3 = 1 OR song_id % 5 = 0 OR year >= 1995) END AS relevant FROM songs""")
def flt10_relevance(spark, sf_dir):
    k = F.col("song_id")
    b = {"reference": (k % 3 == 1).cast("int"), "expanded": F.lit(0), "query": (k % 5 == 0).cast("int"), "profile": F.lit(0)}
    final = F.when(F.col("year") >= 1995, 0.25).otherwise(0.2)
    return ad.songs(spark, sf_dir).select("song_id", se.relevant(b, final, k % 2 == 0, k % 2 == 0).alias("relevant"))


@query("""
requests AS (SELECT song_id, year, 'songs post-' || (1960 + song_id * 13 % 70) || ' please' AS q FROM songs)
SELECT song_id, year FROM requests WHERE year >= regexp_extract(q, 'post-(\\d{4})', 1)::INT
""")
def flt12_minimum_year(spark, sf_dir):
    q = F.concat(F.lit("songs post-"), (F.lit(1960) + F.col("song_id") * 13 % 70).cast("string"), F.lit(" please"))
    return ad.songs(spark, sf_dir).withColumn("least", F.regexp_extract(q, r"post-(\d{4})", 1).try_cast("int")).where("year >= least").select("song_id", "year")


EXTERNAL = """
tracks AS (SELECT genre AS list_id, song_id, artist AS family, artist || (song_id % 2) AS cluster, lower(artist) || '::' || regexp_replace(lower(title), '[^a-z0-9]', '', 'g') AS signature, (song_id * 37) % 1000 AS base3 FROM songs)
"""


def _external(spark, sf_dir):
    k = F.col("song_id")
    return ad.songs(spark, sf_dir).select(F.col("genre").alias("list_id"), "song_id", F.col("artist").alias("family"), F.concat("artist", (k % 2).cast("string")).alias("cluster"), tx.track_signature(F.col("title"), F.col("artist")).alias("signature"), (k * 37 % 1000).alias("base3"))


@query(EXTERNAL + """,
c AS (SELECT *, count(*) OVER (PARTITION BY list_id, family ORDER BY base3 DESC, song_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS f,
      count(*) OVER (PARTITION BY list_id, cluster ORDER BY base3 DESC, song_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS k,
      count(*) OVER (PARTITION BY list_id, signature ORDER BY base3 DESC, song_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s FROM tracks)
SELECT list_id, song_id, 120 * f + 60 * k + 200 * s AS penalty3, greatest(0, base3 - (120 * f + 60 * k + 200 * s)) AS final3 FROM c
""")
def win6_running_penalties(spark, sf_dir):
    return se.running_penalties(_external(spark, sf_dir), ["list_id"], [F.desc("base3"), F.col("song_id")]).select("list_id", "song_id", "penalty3", "final3")


@query()
def win7_adjacency(spark, sf_dir):
    """The hundred best of each asked user, reordered as a whole list."""
    songs = ad.songs(spark, sf_dir).select("song_id", "artist", F.col("genre").alias("cluster"))
    lists = rt.top_candidates(scored(spark, sf_dir, 100), 100).select(F.col("user_id").alias("list_id"), "song_id", "rank").join(songs, "song_id")
    return lists.groupBy("list_id").applyInPandas(se.adjacent_diversity, "list_id long, pos long, song_id long")


@query(EXTERNAL + """,
r AS (SELECT *, row_number() OVER (PARTITION BY list_id ORDER BY base3 DESC, song_id) AS rank, count(*) OVER (PARTITION BY list_id) AS n FROM tracks)
SELECT list_id, song_id, rank, floor(greatest(0.1::DOUBLE, 1 - (rank - 1) / n::DOUBLE) * 1000 + 0.5)::BIGINT AS score3 FROM r
""")
def win8_provider_rank(spark, sf_dir):
    return se.provider_ranks(_external(spark, sf_dir), ["list_id"], [F.desc("base3"), F.col("song_id")]).select("list_id", "song_id", "rank", "score3")


FOUND = "found AS (SELECT seq, CASE WHEN seq % 3 <> 0 THEN 't' || song_id ELSE '' END AS track_id, title, artist, kind AS query FROM feedback JOIN songs USING (song_id))"


@query(FOUND + """,
keyed AS (SELECT *, CASE WHEN track_id <> '' THEN track_id ELSE lower(artist) || '::' || lower(title) END AS key FROM found),
firsts AS (SELECT key, query, min(seq) AS q FROM keyed GROUP BY ALL)
SELECT k.key, arg_min(title, seq) AS title, arg_min(artist, seq) AS artist, any_value(l.queries) AS queries FROM keyed k JOIN (SELECT key, string_agg(query, ',' ORDER BY q) AS queries FROM firsts GROUP BY key) l USING (key) GROUP BY k.key
""")
def jn13_provider_merge(spark, sf_dir):
    f = ad.feedback(spark, sf_dir).join(ad.songs(spark, sf_dir), "song_id")
    return se.merged_searches(f.select("seq", F.when(F.col("seq") % 3 != 0, F.concat(F.lit("t"), F.col("song_id").cast("string"))).otherwise("").alias("track_id"), "title", "artist", F.col("kind").alias("query")))


@query("""
proposals AS (SELECT user_id AS list_id, seq AS pos, coalesce(title, '') || CASE WHEN seq % 7 = 0 THEN '?' ELSE '' END AS title, artist FROM feedback JOIN songs USING (song_id)),
known AS (SELECT lower(title) AS t, lower(artist) AS a, min(song_id) AS song_id FROM songs GROUP BY ALL),
numbered AS (SELECT *, row_number() OVER (PARTITION BY list_id, lower(title), lower(artist) ORDER BY pos) AS n FROM proposals),
met AS (SELECT p.*, k.song_id, CASE WHEN n > 1 THEN 'duplicate' WHEN artist = 'Brand#3' THEN 'excluded' WHEN k.song_id IS NULL THEN 'not_found' ELSE 'grounded' END AS s FROM numbered p LEFT JOIN known k ON k.t = lower(p.title) AND k.a = lower(p.artist)),
run AS (SELECT *, coalesce(sum((s = 'grounded')::INT) OVER (PARTITION BY list_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) >= 8 AS done FROM met)
SELECT list_id, pos, CASE WHEN done THEN 'untested' ELSE s END AS status, CASE WHEN s = 'grounded' AND NOT done THEN song_id END AS song_id FROM run
""")
def jn11_jn12_win10_top5_grounding(spark, sf_dir):
    songs = ad.songs(spark, sf_dir)
    f = ad.feedback(spark, sf_dir).join(songs, "song_id")
    proposals = f.select(F.col("user_id").alias("list_id"), F.col("seq").alias("pos"), F.concat("title", F.when(F.col("seq") % 7 == 0, "?").otherwise("")).alias("title"), "artist")
    return se.grounded(proposals, songs, songs.where("artist = 'Brand#3'").select("artist"), 8)


@query("""
edges AS (SELECT s_name AS source_artist, n_name AS name, max(floor(s_acctbal))::BIGINT AS score FROM supplier JOIN nation ON n_nationkey % 5 = s_nationkey % 5 GROUP BY ALL)
SELECT lower(source_artist) AS source_artist, lower(name) AS name, score, row_number() OVER (PARTITION BY lower(source_artist) ORDER BY score DESC, lower(name)) AS rank FROM edges
""")
def jn17_similar_artists(spark, sf_dir):
    s, n = ad.table(spark, sf_dir, "supplier"), ad.table(spark, sf_dir, "nation")
    e = s.join(n, F.col("n_nationkey") % 5 == F.col("s_nationkey") % 5)
    return se.similar_artists(e.select(F.col("s_name").alias("source_artist"), F.col("n_name").alias("name"), F.floor("s_acctbal").cast("bigint").alias("score")))


@query(GRID.replace("{k}", "20") + "," + PREFS + """,
labels AS (SELECT DISTINCT song_id, CASE WHEN field = 'genres' THEN 'genre' ELSE 'tag' END AS kind, label FROM tags),
met AS (SELECT user_id, song_id, kind, label, row_number() OVER (PARTITION BY user_id, song_id ORDER BY weight4 DESC, kind, label) AS n FROM top JOIN labels USING (song_id) JOIN prefs USING (user_id, kind, label))
SELECT user_id, song_id, string_agg(kind || ':' || label, ',' ORDER BY n) AS evidence FROM met WHERE n <= 3 GROUP BY ALL
""")
def sc31_tl7_tl16_evidence(spark, sf_dir):
    """Evidence for the tracks that each asked user is recommended."""
    songs, tags = ad.songs(spark, sf_dir), ad.tags(spark, sf_dir)
    prefs = fb.rebuilt_preferences(ad.collection(spark, sf_dir).where("user_id % 20 = 0"), songs, tags)
    return se.evidence(rt.top_candidates(scored(spark, sf_dir, 20), 20), prefs, tags)


@query("""
c AS (SELECT user_id, list(DISTINCT song_id % 25) AS s FROM collection GROUP BY user_id)
SELECT a.user_id AS l, b.user_id AS r, len(list_intersect(a.s, b.s))::BIGINT AS both, (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s)))::BIGINT AS either, (len(a.s) - len(list_intersect(a.s, b.s)))::BIGINT AS only_l
FROM c a JOIN c b ON b.user_id = a.user_id + 1
""")
def set1_set4_set_operations(spark, sf_dir):
    c = ad.collection(spark, sf_dir).groupBy("user_id").agg(F.collect_set(F.col("song_id") % 25).alias("s"))
    a, b = c.select(F.col("user_id").alias("l"), F.col("s").alias("x")), c.select(F.col("user_id").alias("r"), F.col("s").alias("y"))
    n = lambda x: F.size(x).cast("bigint")
    return a.join(b, F.col("r") == F.col("l") + 1).select("l", "r", n(F.array_intersect("x", "y")).alias("both"), n(F.array_union("x", "y")).alias("either"), n(F.array_except("x", "y")).alias("only_l"))


@query(r"""
asked AS (
    SELECT song_id, ['give me ', 'more ', 'why ', 'find  ', '再来', '高度相似 ', 'not '][song_id % 7 + 1] || ['12 songs', '3首', '77 Songs', 'diverse music', 'tracks', '类似'][song_id % 6 + 1] || ' like ' || genre || ' ' || ['rock', 'jazz', 'not pop', 'soul', '不要rock', '排除 jazz'][song_id % 5 + 1] AS q FROM songs),
low AS (SELECT song_id, trim(regexp_replace(q, '\s+', ' ', 'g')) AS q, lower(trim(regexp_replace(q, '\s+', ' ', 'g'))) AS l, try_cast(regexp_extract(q, '(?i)(\d{1,2})\s*(?:首歌|首|songs?)', 1) AS INT) AS n FROM asked)
SELECT song_id, CASE WHEN regexp_matches(l, 'why|who is|what is|为什么|是谁|介绍') THEN 'question' WHEN regexp_matches(l, 'more|another batch|换一批|再来|类似|更像') THEN 'more' ELSE 'recommend' END AS intent,
       CASE WHEN n IS NULL THEN 10 ELSE greatest(1, least(50, n)) END AS top_k, CASE WHEN regexp_matches(l, 'diverse|one per artist|多样|不同歌手') THEN 1 ELSE 2 END AS max_per_artist,
       CASE WHEN contains(l, '高度相似') THEN 30 WHEN regexp_matches(l, '相似|差不多|类似') THEN 10 ELSE 0 END AS min_score100,
       array_to_string(list_filter(['rock', 'jazz', 'pop', 'soul', 'folk', 'electronic', 'punk', 'metal', 'funk', 'country', 'blues', 'classical', 'ambient'], lambda g: contains(l, g) AND NOT regexp_matches(l, '(?:not |不要|排除|避开)\s*' || g)), ',') AS genres FROM low
""")
def sc36_sc37_request_fields(spark, sf_dir):
    k = F.col("song_id")
    pick = lambda names, n: F.get(F.array(*[F.lit(x) for x in names]), (k % n).cast("int"))
    q = F.concat(
        pick(("give me ", "more ", "why ", "find  ", "再来", "高度相似 ", "not "), 7), pick(("12 songs", "3首", "77 Songs", "diverse music", "tracks", "类似"), 6),
        F.lit(" like "), "genre", F.lit(" "), pick(("rock", "jazz", "not pop", "soul", "不要rock", "排除 jazz"), 5),
    )
    return ad.songs(spark, sf_dir).select("song_id", *[c.alias(n) for n, c in se.request_fields(q).items()])
