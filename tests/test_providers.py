"""Goldens and edge cases of provider tracks, bounded terms and session outcomes."""

from pyspark.sql import functions as F

from melisma.operators import providers as pr


def test_profile_match_holds_weights_and_keeps_three_reasons(spark):
    one = spark.sql("SELECT 'Oasis' AS artist, array('Britpop', null) AS genres, cast(null AS array<string>) AS tags, 'live ROCK' AS labels, map('oasis', 3D, 'blur', 1D) AS a, map('BRITPOP', -1D, 'rock', 0.25D) AS g, map('live', 0.5D, 'x', null) AS t")
    met = pr.profile_match(*[F.col(c) for c in ("artist", "genres", "tags", "labels", "a", "g", "t")])
    row = one.select(met.alias("m")).first().m
    assert row.score == 1.0
    assert row.reasons == ["artist:oasis", "genre:BRITPOP", "genre:rock"]
    none = [F.lit(None).cast(t) for t in ("string", "array<string>", "array<string>", "string", "map<string,double>", "map<string,double>", "map<string,double>")]
    assert one.select(pr.profile_match(*none).alias("m")).first().m == (0.0, [])


def test_track_ids_and_artists(spark):
    rows = [("spotify:track:abc", None), ("spotify:track:", "https://x/track/no"), (None, "https://x/track/def?si=1"), ("other", "https://x/track/"), (None, None)]
    got = spark.createDataFrame(rows, "id string, url string").select(pr.streaming_track_id(F.col("id"), F.col("url"))).collect()
    assert [r[0] for r in got] == ["abc", None, "def", None, None]
    artists = spark.createDataFrame([("", ["b"]), (None, ["b"]), (None, []), (None, None)], "a string, l array<string>")
    assert [r[0] for r in artists.select(pr.primary_artist(F.col("a"), F.col("l"))).collect()] == ["", "b", None, None]


def test_terms_stop_at_the_budget(spark):
    rows = [(1, 1, "Abc "), (1, 2, "abc"), (1, 3, None), (1, 4, " "), (1, 5, "de"), (1, 6, "f"), (2, 1, "x" * 500), (2, 2, "y"), (3, 1, "")]
    got = {r.k: (r.terms, r.n) for r in pr.joined_terms(spark.createDataFrame(rows, "k int, pos int, term string"), "k", 6).collect()}
    assert got == {1: ("Abc de", 2), 2: ("x" * 500, 1)}


def test_session_outcomes(spark):
    rows = [
        (1, 1, "tool", True, False, True, "m1"), (1, 2, "answer", True, False, False, None),
        (2, 1, "update", True, True, True, "m2"), (2, 3, "finish", True, False, True, "m3"), (2, 4, None, None, None, None, None),
        (3, 1, "answer", False, False, True, None),
    ]
    steps = spark.createDataFrame(rows, "s int, step int, kind string, search boolean, found boolean, retryable boolean, memory string")
    got = {r.s: (r.decisions, r.search_failed, r.memory) for r in pr.session_outcomes(steps, ["s"]).collect()}
    assert got == {1: (1, True, "m1"), 2: (2, False, "m3"), 3: (0, False, None)}


def test_report_of_no_trajectories(spark):
    fields = "user_id int, session string, stop_reason string, mode string, quantity_ok boolean, fallback boolean, latency bigint, " + ", ".join(f"{c} bigint" for c in ("recs", "artists", "calls", "ok_calls", "feedback", "reward10", "positive", "negative", "skips", "favourites"))
    row = pr.evaluation_report(spark.createDataFrame([], fields)).first()
    assert row.trajectories == 0 and row.goal_satisfied_rate == 0 and row.p95_latency is None
