import json

import pytest

from melisma.operators import validation as va

GOOD = {"feedback_type": "like", "song_id": "s", "timestamp": "t", "reward_score": 0.5}
PROFILES = [
    ({}, []), ({"collection_song_ids": ["a", "b"], "artist_preferences": {"x": 1, "y": 0.5}, "feedback_memory": [GOOD, GOOD | {"recommendation_context": {}}]}, []),
    ({"collection_song_ids": ["a", " "]}, ["collection_song_ids: names"]), ({"collection_song_ids": [1]}, ["collection_song_ids: names"]), ({"collection_song_ids": "a"}, ["collection_song_ids: names"]), ({"collection_song_ids": None}, ["collection_song_ids: names"]), ({"collection_song_ids": []}, []),
    ({"tag_preferences": {"x": 1.5}}, ["tag_preferences: weights"]), ({"tag_preferences": {"x": -0.1}}, ["tag_preferences: weights"]), ({"tag_preferences": {"x": True}}, ["tag_preferences: weights"]), ({"tag_preferences": {" ": 1}}, ["tag_preferences: weights"]), ({"tag_preferences": {"x": "1"}}, ["tag_preferences: weights"]), ({"tag_preferences": []}, ["tag_preferences: weights"]),
    ({"zeta": 1, "alpha": 2, "genre_preferences": 3}, ["unknown fields: alpha, zeta", "genre_preferences: weights"]),
    *[({"feedback_memory": [GOOD, bad]}, ["feedback_memory: records"]) for bad in (
        GOOD | {"feedback_type": "liked"}, GOOD | {"song_id": ""}, GOOD | {"timestamp": 5}, GOOD | {"reward_score": "1"}, GOOD | {"reward_score": False}, GOOD | {"recommendation_context": []}, GOOD | {"more": 1}, {k: v for k, v in GOOD.items() if k != "reward_score"}, 7)],
    ({"feedback_memory": {}}, ["feedback_memory: records"]),
]
SONGS = [
    ({"external_ids": {"spotify_track_id": "x"}, "metadata": {"title": None}, "genres": {"rock": 1.0}, "data_source": {"title": ["a"]}, "confidence_score": None}, []),
    ({"external_ids": {"isrc": "x"}}, ["external_ids: object"]), ({"metadata": []}, ["metadata: object"]), ({"genres": {"rock": 2}}, ["genres: weights"]), ({"data_source": {"title": ["a", ""]}}, ["data_source: lists"]), ({"data_source": {"title": "a"}}, ["data_source: lists"]),
    ({"confidence_score": 1.01}, ["confidence_score: share"]), ({"confidence_score": True}, ["confidence_score: share"]), ({"confidence_score": 0}, []),
]


@pytest.mark.parametrize("rules,cases", [(va.PROFILE_PATCH, PROFILES), (va.SONG_PATCH, SONGS)])
def test_every_rule(spark, rules, cases):
    rows = [(i, json.dumps(x)) for i, (x, _) in enumerate(cases)]
    got = {r.i: r.reasons for r in va.judged(spark.createDataFrame(rows, "i int, patch string"), "patch", rules).collect()}
    assert got == {i: why for i, (_, why) in enumerate(cases)}


def test_what_is_no_object(spark):
    rows = [(1, "{"), (2, None), (3, "[1]"), (4, "null"), (5, "7")]
    got = {r.i: r.reasons for r in va.judged(spark.createDataFrame(rows, "i int, patch string"), "patch", va.SONG_PATCH).collect()}
    assert got == {1: ["not JSON"], 2: ["not JSON"], 3: ["not an object"], 4: ["not an object"], 5: ["not an object"]}
