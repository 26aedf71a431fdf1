"""Rules for JSON objects of any shape, as expressions over VARIANT: every broken rule gives a reason, nothing is fatal.

A rule is (field, kind, detail). Kinds: ``names`` (a list of strings that aren't blank), ``weights`` (an object of numbers from
0 to 1 under names that aren't blank), ``lists`` (an object of such lists), ``object`` (detail: allowed fields), ``share`` (a number
from 0 to 1, or null), ``records`` (a list of objects, detail: rules of their fields as (field, kind, detail, required)).
Absent fields break no rule; fields without a rule are unknown. true and false aren't numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The rules for patches of profiles and songs, and the kinds of feedback.
FEEDBACK_TYPES = ("play", "play_complete", "skip", "quick_skip", "favorite", "like", "dislike", "playlist_add", "replay")
FEEDBACK = (("feedback_type", "one of", FEEDBACK_TYPES, True), ("song_id", "name", None, True), ("timestamp", "name", None, True), ("reward_score", "number", None, True), ("recommendation_context", "any object", None, False))
PROFILE_PATCH = (("collection_song_ids", "names", None), ("artist_preferences", "weights", None), ("genre_preferences", "weights", None), ("tag_preferences", "weights", None), ("feedback_memory", "records", FEEDBACK))
SONG_PATCH = (
    ("external_ids", "object", ("spotify_track_id", "musicbrainz_recording_id")), ("metadata", "object", ("title", "artist", "album", "release_year", "duration_ms", "version_type")),
    ("genres", "weights", None), ("data_source", "lists", None), ("confidence_score", "share", None),
)


def _kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit(""))


def _fields(v: Column) -> Column:
    """The fields of an object; an empty map for anything else."""
    return F.coalesce(F.try_variant_get(v, "$", "map<string, variant>"), F.create_map().cast("map<string, variant>"))


def _items(v: Column) -> Column:
    return F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array().cast("array<variant>"))


def _is(v: Column, kind: str) -> Column:
    return F.startswith(_kind(v), F.lit(kind))


def _number(v: Column) -> Column:
    return F.rlike(_kind(v), F.lit("^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL)"))


def _share(v: Column) -> Column:
    return _number(v) & F.coalesce(F.try_variant_get(v, "$", "double").between(0, 1), F.lit(False))


def _name(v: Column) -> Column:
    return (_kind(v) == "STRING") & F.coalesce(F.trim(F.try_variant_get(v, "$", "string")) != "", F.lit(False))


def _names(v: Column) -> Column:
    return _is(v, "ARRAY") & F.forall(_items(v), _name)


def _keyed(v: Column, check) -> Column:
    return _is(v, "OBJECT") & F.forall(F.map_entries(_fields(v)), lambda e: (F.trim(e["key"]) != "") & check(e["value"]))


def _record(rules) -> Column:
    def good(v: Column) -> Column:
        fields = _fields(v)
        out = _is(v, "OBJECT") & (F.size(F.array_except(F.map_keys(fields), F.array(*[F.lit(r[0]) for r in rules]))) == 0)
        for field, kind, detail, required in rules:
            x = F.try_element_at(fields, F.lit(field))
            check = {"name": lambda y: _name(y), "number": lambda y: _number(y), "any object": lambda y: _is(y, "OBJECT"), "one of": lambda y, d=detail: (_kind(y) == "STRING") & F.coalesce(F.try_variant_get(y, "$", "string").isin(*(d or ())), F.lit(False))}[kind](x)
            out = out & (x.isNotNull() & check if required else x.isNull() | check)
        return out

    return good


def reasons(value: Column, rules: tuple) -> Column:
    """array<string> of a variant's broken rules, in the rules' order; ``not JSON`` for null, ``not an object`` for other values."""
    fields = _fields(value)
    unknown = F.sort_array(F.array_except(F.map_keys(fields), F.array(*[F.lit(r[0]) for r in rules])))
    found = [F.when(F.size(unknown) > 0, F.concat(F.lit("unknown fields: "), F.array_join(unknown, ", ")))]
    for field, kind, detail in rules:
        v = F.try_element_at(fields, F.lit(field))
        good = {
            "names": lambda x: _names(x), "weights": lambda x: _keyed(x, _share), "lists": lambda x: _keyed(x, _names), "share": lambda x: (_kind(x) == "VOID") | _share(x),
            "object": lambda x, d=detail: _is(x, "OBJECT") & (F.size(F.array_except(F.map_keys(_fields(x)), F.array(*[F.lit(n) for n in d or ()]))) == 0),
            "records": lambda x, d=detail: _is(x, "ARRAY") & F.forall(_items(x), _record(d or ())),
        }[kind](v)
        found.append(F.when(v.isNotNull() & ~good, F.lit(f"{field}: {kind}")))
    broken = F.array_compact(F.array(*found))
    return F.when(value.isNull(), F.array(F.lit("not JSON"))).when(~_is(value, "OBJECT"), F.array(F.lit("not an object"))).otherwise(broken)


def judged(rows: DataFrame, column: str, rules: tuple) -> DataFrame:
    """``rows`` with reasons for their JSON text; rows without a reason are valid, the others go to quarantine."""
    return rows.withColumn("reasons", reasons(F.try_parse_json(F.col(column)), rules))
