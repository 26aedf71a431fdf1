import pandas as pd
import pytest
from pyspark.sql import functions as F

from melisma.functions import score, text
from melisma.operators import dataset, feedback, ranking, retrieval, sessions
from melisma.plans import registry
from tests.oracle import SF

MAPS = "map<string,bigint>"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_weighted_jaccard(spark):
    m = lambda **w: F.create_map(*[F.lit(v) for k, x in w.items() for v in (k, x)]).cast(MAPS)
    assert one(spark, score.weighted_jaccard(m(rock=10000, britpop=5000), m(rock=5000, pop=5000))) == 0.25
    assert one(spark, score.weighted_jaccard(m(rock=1), m(rock=1))) == 1.0
    assert one(spark, score.weighted_jaccard(F.create_map().cast(MAPS), F.create_map().cast(MAPS))) == 0.0


def features(spark, rows):
    schema = f"song_id long, artist string, year int, track_tags {MAPS}, genres {MAPS}, artist_tags {MAPS}"
    return spark.createDataFrame(rows, schema)


def test_retrieval_goldens(spark):
    songs = features(spark, [
        (1, "Oasis", 1995, {"britpop": 10000, "rock": 8000}, {"rock": 10000}, {"british": 10000}),
        (2, "Oasis", 1996, {"britpop": 8000}, {"rock": 8000}, {"british": 5000}),
        (3, "Blur", 1995, {"britpop": 10000, "rock": 8000}, {"rock": 10000}, {"british": 10000}),
        (4, "None", 2025, {}, {}, {}),
    ])
    owned = spark.createDataFrame([(7, 1, 1), (7, 2, 2), (7, 99, 3)], "user_id long, song_id long, first_order long")
    users = retrieval.collection_seeds(owned, songs)
    got = {r.song_id: r for r in retrieval.score_candidates(users, songs, with_matched=True).collect()}
    assert set(got) == {3, 4}
    assert got[3].best_seed == 1 and got[3].best == 1000000 and got[3].matched == "1,2"
    assert got[4].best_seed == 2 and got[4].best == 1667 and got[4].similarity == round(0.7 * 1667 + 0.3 * 834)
    assert [r.song_id for r in retrieval.missing_seeds(owned, songs).collect()] == [99]
    # A threshold keeps a candidate that just reaches it.
    assert retrieval.top_candidates(retrieval.score_candidates(users, songs), 5, got[4].similarity).count() == 2
    assert retrieval.top_candidates(retrieval.score_candidates(users, songs), 5, got[4].similarity + 1).count() == 1


def test_block_pairs_equal_brute_force(spark):
    rows = registry.QUERIES["sc15_pair_score"](spark, SF)
    part = {r.p_partkey: r for r in spark.read.parquet(f"{SF}/part.parquet").collect()}
    labels = {k: dict([(r.p_name.split()[1], 4000 + r.p_size % 5 * 500)]) for k, r in part.items()}
    for k, r in part.items():
        first = r.p_name.split()[0]
        labels[k][first] = max(7000, labels[k].get(first, 0))
    for r in rows.limit(300).collect():
        a, b = labels[r.seed], labels[r.song_id]
        low = sum(min(a.get(x, 0), b.get(x, 0)) for x in a.keys() | b.keys())
        high = sum(max(a.get(x, 0), b.get(x, 0)) for x in a.keys() | b.keys())
        assert r.track_tags == int(0.55 * (low / high) * 1e6 + 0.5)
        assert r.genres == (250000 if part[r.seed].p_type == part[r.song_id].p_type else 0)


def test_greedy_pick_skips_duplicates_and_full_artists(spark):
    pool = spark.createDataFrame([
        (1, 1, 90, "a", "x", 1000), (1, 2, 80, "a", "x", 5000), (1, 3, 70, "a", "y", 0), (1, 4, 60, "a", "z", 0), (1, 5, 50, "", "", 0), (1, 6, 40, "", "", 0),
    ], "user_id long, song_id long, similarity long, artist_key string, title_key string, duration_ms long")
    assert [r.song_id for r in retrieval.distinct_capped(pool, 10, 2).orderBy("rank").collect()] == [1, 3, 5, 6]


def test_diversity_order():
    row = lambda i, base, artist, genre: (1, i, base, artist, [(genre, 1)], [("t" + genre, 1)])
    pool = pd.DataFrame([row(1, 550000, "a", "rock"), row(2, 545000, "b", "rock"), row(3, 475000, "c", "jazz")], columns=["user_id", "song_id", "base", "artist", "genres", "tags"])
    got = ranking.diversify(pool, 3, 2)
    assert list(got.song_id) == [1, 3, 2]
    assert list(got.penalty) == [0.0, 0.0, 0.12]


def test_adjacent_diversity():
    pool = pd.DataFrame([("l", 1, "a", "a", 1), ("l", 2, "a", "a", 2), ("l", 3, "b", "b", 3)], columns=["list_id", "song_id", "artist", "cluster", "rank"])
    assert list(sessions.adjacent_diversity(pool).song_id) == [1, 3, 2]


@pytest.mark.parametrize(("n", "expected"), [(1, [1, 0, 0]), (3, [1, 1, 1]), (10, [8, 1, 1]), (25, [20, 3, 2])])
def test_allocation(n, expected):
    assert [g for _, g in dataset.allocation(n)] == expected


def test_buckets(spark):
    got = [one(spark, score.score_bucket(F.lit(x))) for x in (0.0, 0.2, 0.55, 0.6, 0.9, 1.0)]
    assert got == ["0.0-0.2", "0.2-0.4", "0.4-0.6", "0.6-0.8", "0.8-1.0", "1.0-1.0"]
    assert one(spark, score.score_bucket(F.lit(None).cast("double"))) == "unknown"


def test_affinity(spark):
    after = lambda *hits: round(one(spark, feedback.affinity_after(F.array(*[F.lit(h) for h in hits]))), 6)
    assert after(True) == 0.34
    assert after(True, True) == 0.6154
    assert after(True, False) == 0.306


def test_feedback_transfer_goldens(spark):
    songs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "a")], "song_id long, artist string")
    tags = spark.createDataFrame([
        (1, "genres", "rock", 10000), (1, "track_tags", "loud", 10000), (2, "genres", "rock", 10000), (3, "track_tags", "loud", 10000), (4, "genres", "jazz", 10000),
    ], "song_id long, field string, label string, w long")
    liked = spark.createDataFrame([(9, 1, 1, 6)], "user_id long, seq long, song_id long, reward10 long")
    got = {r.song_id: r.score6 for r in feedback.transferred_feedback(liked, songs, tags).collect()}
    assert got == {1: 600000, 2: 210000, 3: 240000}


def test_last_reward_goes_by_sequence(spark):
    rows = spark.createDataFrame([(1, 1, 5, 6), (1, 2, 5, -10), (1, 3, 5, 0)], "user_id long, seq long, song_id long, reward10 long")
    assert feedback.last_direct_reward(rows).first().reward10 == -10


def test_texts(spark):
    assert one(spark, text.identity(F.lit("Beyoncé & Jay-Z (Live at Wembley)"))) == "beyonceandjayz"
    assert one(spark, text.canonical_title(F.lit("Song [2011 Remaster] (feat. X)"))) == "song feat x"
    assert one(spark, text.canonical_title(F.lit("Song - Live in Rome"))) == "song"
    assert one(spark, text.canonical_title(F.lit(None).cast("string"))) == ""
    assert one(spark, text.version_class(F.lit("Hey"), F.lit("MTV Unplugged"), F.lit(None).cast("string"))) == "live"
    assert one(spark, text.track_signature(F.lit("Alive"), F.lit("Pearl"))) == "pearl::a"
    assert one(spark, text.nfkc(F.lit("ﬁ"))) == "fi"


def test_closed_schema(spark, tmp_path):
    from melisma.sources import files

    (tmp_path / "a.json").write_text('{"song_id": "a", "title": "x"}')
    (tmp_path / "b.json").write_text('{"song_id": "b", "title": "x", "more": 1}')
    (tmp_path / "c.json").write_text("{broken")
    (tmp_path / "d.json").write_text('{"song_id": "d"}')
    good, bad = files.read_documents(spark, str(tmp_path), "song_id string, title string")
    assert [r.song_id for r in good.collect()] == ["a"]
    assert bad.count() == 3


def test_jsonl_skips_broken_lines(spark, tmp_path):
    from melisma.sources import files

    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\nnot json\n{"a": 2}\n')
    assert sorted(r.a for r in files.read_lines(spark, str(tmp_path), "a long").collect()) == [1, 2]


def test_stream_affinity_equals_fold(spark):
    got = {(r.user_id, r.label): r.affinity6 for r in registry.QUERIES["st2_stream_affinity"](spark, SF).collect()}
    weights: dict = {}
    for r in spark.read.parquet(f"{SF}/events.parquet").orderBy("event_id").collect():
        import json

        label, known = str(json.loads(r.props)["k"] % 5), weights.setdefault(r.user_id, {})
        known = {k: w * 0.9 for k, w in known.items()}
        known = {k: w for k, w in known.items() if w >= 0.05 or k == label}
        known[label] = min(1.0, known.get(label, 0.0) * 0.9 + 0.34)
        weights[r.user_id] = known
    expected = {(u, k): int(w * 1e6 + 0.5) for u, known in weights.items() for k, w in known.items()}
    assert got == expected


def test_greedy_queries_keep_their_bounds(spark):
    order = registry.QUERIES["win4_win5_diversity_rerank"](spark, SF)
    assert order.groupBy("user_id").agg(F.max("rank").alias("m"), F.count("*").alias("n")).where("m != n").isEmpty()
    moved = registry.QUERIES["win7_adjacency"](spark, SF)
    for user, rows in moved.toPandas().sort_values("pos").groupby("list_id"):
        assert list(rows.pos) == list(range(1, len(rows) + 1)) and rows.song_id.is_unique and len(rows) <= 100


def test_preferences_by_normalised_artist_and_noise(spark):
    songs = spark.createDataFrame([(1, "Oasis"), (2, " oasis "), (3, "Blur")], "song_id long, artist string")
    tags = spark.createDataFrame([(1, "track_tags", t, 10) for t in ("british", "1995", "90s", "3 of 5 stars", "Oasis", "Brit_Pop", "seen live", "wrong track streaming")], "song_id long, field string, label string, w long")
    mine = spark.createDataFrame([(7, 2, 1), (7, 1, 2), (7, 3, 3)], "user_id long, song_id long, first_order long")
    got = {(r.kind, r.label): r.weight4 for r in feedback.rebuilt_preferences(mine, songs, tags).collect()}
    assert got == {("artist", "oasis"): 10000, ("artist", "Blur"): 5000, ("tag", "british"): 10000, ("tag", "brit pop"): 10000}


def test_preference_parts_are_weighted_jaccard(spark):
    songs = spark.createDataFrame([(1, "A", 10)], "song_id long, artist string, confidence10 long")
    tags = spark.createDataFrame([(1, "genres", "rock", 10000)], "song_id long, field string, label string, w long")
    prefs = spark.createDataFrame([(7, "genre", "Rock", 10000), (7, "genre", "jazz", 10000), (7, "artist", "a ", 4000)], "user_id long, kind string, label string, weight4 long")
    pool = spark.createDataFrame([(7, 1, 600000)], "user_id long, song_id long, similarity long")
    liked = spark.createDataFrame([(7, 1, -300000)], "user_id long, song_id long, score6 long")
    base = ranking.base_scores(pool, prefs, songs, tags, liked)
    row = base.withColumn("why", ranking.reasons(F.lit(0.06))).first()
    assert (row.artist_raw, row.genre_raw, row.tag_raw) == (0.4, 0.5, 0.0)
    assert row.base == 300000 + 32000 + 70000 + 0 + 100000 - 45000
    assert row.why == ["strong similarity to the collection seeds", "penalized by negative feedback", "matches the collection genre profile", "matches a preferred artist"]


def test_external_caps_and_keys(spark):
    from melisma.operators import external

    row = lambda i, artist, sig, family, cluster: ("l", i, i, artist, sig, family, cluster)
    rows = [row(1, "A", "s1", "", "x"), row(2, "B", "s1", "", "y"), row(3, "a", "s3", "f", "x"), row(4, "A", "s4", "", "z"), row(5, "C", "", "f", "x"), row(6, "D", "", "f", "q")]
    pool = pd.DataFrame(rows, columns=["list_id", "song_id", "rank", "artist", "signature", "family", "cluster"])
    assert list(external.capped_in_order(pool, 2, 1, 2).song_id) == [1, 3]
    assert list(external.capped_in_order(pool, 2, 2, 3).song_id) == [1, 3, 5]
    none = F.lit(None).cast("string")
    assert one(spark, external.cluster_key(none, F.array(F.lit(" "), F.lit(" Mo ")), F.lit("f"), F.lit("A"))) == "mo"
    assert one(spark, external.cluster_key(F.lit(" "), F.lit(None).cast("array<string>"), none, F.lit(" A"))) == "a"
    assert one(spark, text.external_version(F.lit("Song - MTV Unplugged"), none)) == "live_or_session"


def test_replaced_profiles_keep_what_they_must(spark):
    from melisma.operators import profiles

    old = spark.createDataFrame([(1, [5, 6], [1], 0.5, 3), (2, [], [], 0.1, 1)], "user_id long, ids array<long>, feedback array<long>, affinity double, version int")
    patch = spark.createDataFrame([(1, [6, 7], [9])], "user_id long, new_ids array<long>, new_feedback array<long>")
    got = {r.user_id: (r.ids, r.feedback, r.affinity, r.version) for r in profiles.replaced(old, patch, False).collect()}
    assert got == {1: ([6, 7], [9], 0.5, 4), 2: ([], [], 0.1, 1)}
    got = {r.user_id: (r.ids, r.feedback, r.version) for r in profiles.imported(old, patch).collect()}
    assert got == {1: ([5, 6, 7], [1, 9], 4), 2: ([], [], 1)}


def test_ranking_feedback_golden(spark):
    rows = [("r1", 0.6, 1, 0.9, "web", False), ("r1", -0.4, 2, 0.3, "player", True), ("r2", None, 3, 0.5, "web", True), ("r2", 0.5, None, None, "", False), ("r2", 0.0, 10, 1.0, None, False)]
    contexts = spark.createDataFrame(rows, "run_id string, reward double, rank long, score double, source string, collects boolean")
    got = {(r.dim, r.key): r for r in dataset.ranking_feedback(contexts).collect()}
    assert got["rank", "1"].average_reward == 0.6 and got["rank", "2"].average_reward == -0.4
    assert got["source", "web"].events == got["source", "player"].events == 1 and got["source", "unknown"].events == 2
    assert [k for _, k in sorted((r.place, k) for (d, k), r in got.items() if d == "rank")] == ["1", "2", "10", "unknown"]
    assert (got["all", "all"].events, got["all", "all"].positive_rate, got["all", "all"].negative_rate) == (4, 0.5, 0.25)
    totals = dataset.ranking_totals(contexts, spark.createDataFrame([("r1",), ("r3",)], "run_id string")).first()
    assert tuple(totals) == (1, 2, 2, 1)
    assert dataset.ranking_feedback(contexts.where("false")).isEmpty()


def test_adjacent_diversity_equals_a_plain_replay():
    import random

    import pandas as pd

    for seed in range(60):
        rnd = random.Random(seed)
        rows = [(1, i, i * 7, rnd.choice(["a", "A", "b", "C", "", None]), rnd.choice(["x", "X", "y", ""])) for i in range(rnd.randrange(1, 40))]
        pool = pd.DataFrame(rows, columns=["list_id", "rank", "song_id", "artist", "cluster"])
        left, order = list(rows), []
        while left:
            artist, cluster = ((order[-1][3] or "").lower(), order[-1][4].lower()) if order else ("", "")
            fits = [i for i, r in enumerate(left) if (r[3] or "").lower() != artist and r[4].lower() != cluster]
            order.append(left.pop(fits[0] if fits else 0))
        assert sessions.adjacent_diversity(pool).song_id.tolist() == [r[2] for r in order]
