"""Streams that keep state: batches that run again, restarts, late rows and idle sessions."""

import datetime

import pytest
from pyspark.sql import functions as F

from melisma.operators import feedback as fb
from melisma.plans import upkeep as plans
from melisma.session import new_path, ship_package
from melisma.sources import adapters as ad
from melisma.streaming import session_state as ss
from melisma.streaming import upkeep
from tests.oracle import SF, rows_of

T0 = datetime.datetime(2024, 1, 1)


def at(seconds):
    return T0 + datetime.timedelta(seconds=seconds)


def files(spark, path, batches, schema):
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_kept_preferences_equal_a_rebuild_after_each_batch(spark):
    songs, tags = ad.songs(spark, SF).cache(), ad.tags(spark, SF).cache()
    base = ad.collection(spark, SF).where("user_id < 40").cache()
    f = ad.feedback(spark, SF).where("user_id < 40 AND kind IN ('favorite', 'playlist_add')").select("user_id", "song_id", (F.col("seq") + 10**9).alias("first_order"), (F.col("seq") % 3).alias("batch")).cache()
    kept = upkeep.Preferences(spark, new_path(spark, "kept"), songs, tags)
    kept.begin(base)
    for number in range(3):
        batch = f.where(F.col("batch") == number).drop("batch")
        first = rows_of(kept.add(batch, number))
        assert rows_of(kept.add(batch.union(batch), number)) == first  # the batch runs again, with repeated rows
        grown = base.unionByName(f.where(F.col("batch") <= number).drop("batch")).groupBy("user_id", "song_id").agg(F.min("first_order").alias("first_order"))
        assert rows_of(kept.of()) == rows_of(fb.rebuilt_preferences(grown, songs, tags))
    # An earlier batch that runs again, after later ones, changes nothing; neither does folding all batches into one.
    whole = rows_of(kept.of())
    kept.add(f.where("batch = 1").drop("batch"), 1)
    assert rows_of(kept.of()) == whole == rows_of(kept.compact(new_path(spark, "compacted")).of())
    assert kept.add(f.where("false").drop("batch"), 3).isEmpty()


def test_contexts_after_a_restart(spark):
    schema = "trajectory_id string, user_id long, seq long, song_id long, kind string, reward10 long, ts timestamp"
    runs = spark.createDataFrame([("r1", 1, "q", "final_answer")], "trajectory_id string, user_id long, query string, stop_reason string")
    shown = spark.createDataFrame([("r1", 10, 1, 0.9), ("r1", 11, 2, 0.8)], "trajectory_id string, song_id long, rank long, score double")
    batches = [[("r1", 1, 1, 10, "favorite", 8, at(0)), ("r1", 2, 2, 10, "like", 6, at(1))], [("r1", 1, 3, 99, "like", 6, at(2)), ("r2", 1, 4, 10, "favorite", 8, at(3))]]
    path, out, checkpoint = (new_path(spark, n) for n in ("events", "contexts", "checkpoint"))

    def run(stream):
        keep = lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/batch={n}")
        upkeep.feedback_contexts(stream, runs, shown).writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

    run(files(spark, path, batches[:1], schema))
    run(files(spark, path, batches[1:], schema))  # goes on where the first one ended
    got = {r.seq: r for r in spark.read.parquet(out).collect()}
    assert [(got[i].recommendation_rank, got[i].status, got[i].collects, got[i].query) for i in (1, 2, 3, 4)] == [
        (1, "written", True, "q"), (None, "unknown run", False, None), (None, "written", False, "q"), (None, "unknown run", False, None)
    ]
    whole = spark.createDataFrame(batches[0] + batches[1], schema)
    assert rows_of(upkeep.feedback_contexts(whole, runs, shown)) == rows_of(spark.read.parquet(out).drop("batch"))


def test_listenings_and_late_rows(spark):
    schema = "user_id long, song_id long, ts timestamp, state string, position_ms long, duration_ms long"
    song = lambda u, t, state, ms: (u, 1, at(t), state, ms, 100_000)
    first = [song(1, 0, "started", 0), song(1, 95, "progress", 95_000), song(2, 0, "started", 0), song(2, 10, "closed", 10_000), song(3, 0, "started", 0), song(3, 20, "closed", 20_000), song(4, 5, "progress", 50)]
    first += [song(5, 0, "started", 89_000), song(5, 5, "closed", 90_000), song(6, 0, "started", None)]
    later, more = [song(9, 100_000, "started", 0)], [song(9, 110_000, "started", 0)]  # rows are late by the watermark of the batch before
    late = [song(7, 50, "started", 0), song(9, 200_000, "started", 0)]
    stream = files(spark, new_path(spark, "player"), [first, later, more, late, [song(9, 300_000, "started", 0)]], schema)
    rows = plans.run_to_end(upkeep.player_feedback(stream, "5 minutes", "10 minutes"), "append")
    got = sorted((r.user_id, r.kind) for r in rows.where("user_id < 9").collect())
    assert got == [(1, "play"), (1, "play_complete"), (2, "play"), (2, "quick_skip"), (3, "play"), (5, "play"), (5, "play_complete"), (6, "play")]


EVENTS = "session_id long, seq long, ts timestamp, event string, song_id long, artist string, signature string, terms array<string>, avoid array<string>, exclude_seen boolean"


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    ship_package(spark)
    yield
    spark.conf.set(name, before)


def test_session_state_equals_the_fold_of_a_table(spark, rocks):
    event = lambda s, q, e, song=None, artist=None, sig=None, terms=None, avoid=None, seen=None: (s, q, at(q), e, song, artist, sig, terms, avoid, seen)
    batches = [
        [event(1, 1, "request", terms=["Rock", " rock "], avoid=["X_y", None, ""], seen=True), event(1, 2, "shown", 5, "A", "A::x"), event(2, 3, "liked", 7)],
        [event(1, 4, "liked", 9), event(1, 5, "hide_artist", artist="B  b"), event(1, 6, "hide_artist", artist=" "), event(2, 7, "saved", 6), event(2, 8, "request_similar", 7), event(3, 9, "unknown")],
        [event(1, 11, "request", terms=None, avoid=["z", "x y"], seen=False), event(1, 10, "skipped", 8), event(2, 12, "hide_track", 7), event(2, 13, "shown", 7, "C", "")],
    ]
    stream = files(spark, new_path(spark, "events"), batches, EVENTS)
    rows = plans.run_to_end(ss.context_stream(stream), "update").collect()
    for number in range(3):
        table = spark.createDataFrame([r for b in batches[: number + 1] for r in b], EVENTS)
        whole = {r.session_id: r for r in ss.contexts(table).collect()}
        for session in {r[0] for r in batches[number]}:
            found = [r.asDict() for r in rows if r.session_id == session and r.seq == whole[session].seq]
            assert len(found) == 1 and {k: v for k, v in found[0].items() if k != "batch"} == whole[session].asDict()
    last = {r.session_id: r for r in ss.contexts(spark.createDataFrame(sum(batches, []), EVENTS)).collect()}
    assert last[1].exclude_terms == ["x y", "z", "b b"] and last[1].excluded_songs == [8] and last[2].seed_songs == [7, 6]


def test_idle_sessions_are_forgotten(spark, rocks):
    event = lambda s, t, song: (s, t, at(t), "liked", song, None, None, None, None, None)
    batches = [[event(1, 0, 5)], [event(2, 50_000, 6)], [event(2, 50_001, 7)], [event(1, 60_000, 8)]]
    stream = files(spark, new_path(spark, "events"), batches, EVENTS)
    rows = plans.run_to_end(ss.context_stream(stream, "1 second", idle_ms=1000_000), "update").collect()
    assert [r.seed_songs for r in sorted(rows, key=lambda r: r.seq) if r.session_id == 1] == [[5], [8]]
    assert [r.seed_songs for r in sorted(rows, key=lambda r: r.seq) if r.session_id == 2] == [[6], [6, 7]]


def test_filtered_lists_equal_rows(spark):
    """sessions that share a list keep what ``filtered`` keeps row by row; blank names and unknown sessions too."""
    songs = [(i % 2, i, 100 + i, [None, "", "Ann", "bob  Lee", "Cy"][i % 5], ["", "s1", "s2", "S3 x"][i % 4], ["red_Car", "Blue", None][i % 3], ["rock-pop", "jazz"][i % 2]) for i in range(60)]
    lists = spark.createDataFrame(songs, "list_id long, pos long, song_id long, artist string, signature string, title string, genre string")
    contexts = [(s, [[], ["red car"], ["redcar", "rock"], ["jazz", "Blue"]][s % 4], [[], ["bob lee"], ["jazz"], ["xyz", "ann"]][s % 3], [100 + s, 101, 105 + s], ["s3 x"] if s % 2 else [], []) for s in range(12)]
    context = spark.createDataFrame(contexts, "session_id long, preference_terms array<string>, exclude_terms array<string>, excluded_songs array<long>, excluded_signatures array<string>, seed_songs array<long>")
    sessions = spark.createDataFrame([(s, s % 2) for s in range(14)], "session_id long, list_id long")
    want = ss.filtered(sessions.join(lists, "list_id"), context, ["title", "genre", "artist"]).select("session_id", "song_id", "nth")
    got = ss.filtered_lists(sessions, context, lists, ["title", "genre", "artist"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []


def test_state_calls_do_not_grow_with_rows():
    """a session's rows of one batch take one read and one write of its state."""
    calls, Event = [], type("Event", (), {})

    class State:
        value = None

        def get(self):
            calls.append("get")
            return self.value

        def update(self, value):
            calls.append("update")
            self.value = value

    class Handle:
        getValueState = staticmethod(lambda *_: State())  # noqa: N815
        registerTimer = deleteTimer = staticmethod(lambda *_: calls.append("timer"))  # noqa: N815

    session = ss._Session(1000)
    session.init(Handle())
    for batch in range(2):
        rows = []
        for i in range(500):
            row = Event()
            row.__dict__.update(seq=batch * 500 + i, ts=at(i), event=["shown", "liked", "skipped", "hide_artist"][i % 4], song_id=i, artist=f"a{i}", signature=f"s{i}", terms=[], avoid=[], exclude_seen=False)
            rows.append(row)
        (out,) = session.handleInputRows((7,), iter(rows), None)
        assert len(out.seed_songs) == 125 and len(calls) <= 4 * (batch + 1)


def test_labels_are_not_shuffled(spark):
    """sums of labels are made where a user's songs are together, so only songs are shuffled."""
    songs, tags = ad.songs(spark, SF), ad.tags(spark, SF)
    kept = upkeep.Preferences(spark, new_path(spark, "kept"), songs, tags)
    collected = spark.createDataFrame([(u, s, s) for u in range(5) for s in range(u, 40, 3)], "user_id long, song_id long, first_order long")
    sums = kept._sums(collected)
    plan = sums._jdf.queryExecution().executedPlan().toString()
    top = plan[: plan.index("inline")]
    assert "Exchange" not in top
    whole = {(r.user_id, r.kind, r.key): r.s for r in collected.join(fb.preference_labels(songs, tags), "song_id").groupBy("user_id", "kind", "key").agg(F.sum("w").alias("s")).collect()}
    assert {(r.user_id, r.kind, r.key): r.s for r in sums.collect()} == whole
