import json

from pyspark.sql import functions as F

from melisma.operators import memory as me
from melisma.sources import files


def test_migration_fills_old_limits_and_drops_seen_references(spark):
    old = {"session_id": "s", "user_id": "u", "last_top_k": 7, "seen_song_ids": [" a ", "a", "", "b"], "exclude_terms": ["Shown  before ones", "punk "], "last_trajectory_id": " r "}
    new = {"session_id": "t", "user_id": "u", "active_constraints": {"limit": 3}, "last_top_k": 9, "preference_terms": "jazz", "seen_track_ids": ["c"], "seen_song_ids": ["d"]}
    raw = spark.createDataFrame([(json.dumps(old),), (json.dumps(new),), ("{broken",), ("[1]",), (None,)], "value string")
    got = {r.session_id: r for r in me.migrated_sessions(raw).collect()}
    assert set(got) == {"s", "t"}
    s, t = got["s"], got["t"]
    assert (s.active_constraints, s.seen_track_ids, s.exclude_terms, s.last_run_id) == ({"limit": "7"}, ["a", "b"], ["punk"], "r")
    assert (s.turn_count, s.current_intent, s.last_user_query) == (0, "recommend", None)
    assert (t.active_constraints, t.seen_track_ids) == ({"limit": "3"}, ["c"])


def test_patch_keeps_what_it_does_not_name(spark):
    raw = spark.createDataFrame([('{"session_id":"s","user_id":"u","active_constraints":{"limit":"3","x":"1"},"seed_track_ids":["q"]}',)], "value string")
    patch = spark.createDataFrame([("s", "  ", {"limit": "9"}, None)], "session_id string, current_intent string, active_constraints map<string,string>, seed_track_ids array<string>")
    r = me.patched_sessions(me.migrated_sessions(raw), patch).first()
    assert (r.current_intent, r.active_constraints, r.seed_track_ids, r.updated) == ("recommend", {"x": "1", "limit": "9"}, ["q"], ["current_intent", "active_constraints"])


def test_json_helpers(spark):
    df = spark.createDataFrame([('{"b": [1, {"user_id": 2, "z": "é", "a": null}], "a": 1.5, "user_id": {}}',), ("{",), (None,)], "j string")
    got = df.select(me.stable_json(F.col("j")).alias("s"), me.without_keys(F.col("j")).alias("w"), me.label_list(F.col("j")).alias("l")).collect()
    assert got[0].s == '{"a":1.5,"b":[1,{"a":null,"user_id":2,"z":"é"}],"user_id":{}}'
    assert got[0].w == '{"b":[1,{"z":"é","a":null}],"a":1.5}'
    assert [(r.s, r.w, r.l) for r in got[1:]] == [(None, None, []), (None, None, [])]


def test_ring_of_messages_over_several_batches(spark, tmp_path):
    from melisma.plans.live import run_to_end

    source = str(tmp_path / "in")
    turns = [(1, t, "assistant" if t % 2 else "user", " " if t == 4 else f"m{t}", [t % 3]) for t in range(7)]
    schema = "session_id long, turn long, role string, text string, ids array<long>"
    for part in (turns[:3], turns[3:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    last = run_to_end(me.session_memory(stream, kept=3), "update").orderBy(F.desc("batch")).first()
    assert (last.turn_count, last.seen, last.messages, last.first_kept, last.last_turn) == (3, "1,0,2", 3, 3, 6)


def test_raw_files_without_a_schema(spark, tmp_path):
    for name, value in (("a", '{"x": 1, "odd": [2]}'), ("b", "{"), ("c", "[1]")):
        (tmp_path / f"{name}.json").write_text(value)
    rows, skipped = files.read_raw(spark, str(tmp_path))
    assert [r.x for r in rows.select(F.expr("try_variant_get(value, '$.x', 'int')").alias("x")).collect()] == [1]
    assert [r.file.rsplit("/", 1)[1] for r in skipped.collect()] == ["b.json"]


def test_session_memory_of_part_files(spark, tmp_path):
    """a table may be a folder of part files."""
    from melisma.plans import registry
    from tests.oracle import SF, rows_of, sql_rows

    spark.read.parquet(f"{SF}/conversations.parquet").repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    assert rows_of(registry.QUERIES["st3_session_memory"](spark, str(tmp_path))) == sql_rows(registry.ORACLES["st3_session_memory"])
