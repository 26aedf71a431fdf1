"""A session's ranking context, kept as state over a stream of its events, or folded from a table of them.

Events (session_id, seq, ts, event, song_id, artist, signature, terms, avoid, exclude_seen; blank values are none):

- ``request`` sets the preference terms and whether seen songs are left out, and adds terms to avoid;
- ``shown`` adds a seen song and its signature;
- ``liked``, ``saved`` and ``request_similar`` add a seed, in order of first sight;
- ``hide_track`` and ``skipped`` exclude a song, ``hide_artist`` adds an artist to avoid.

``contexts`` folds a table; ``context_stream`` keeps the same in a state variable, which a batch reads and writes once for each
session that it touches, and a timer drops the state of a session that has been idle for ``idle_ms`` of event time. Both give CONTEXT rows; a stream gives one for every touched session.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from melisma.functions import text
from melisma.operators import sessions as se
from melisma.session import ship_package, written

#: What events do.
SEEDS, HIDES = ("liked", "saved", "request_similar"), ("hide_track", "skipped")
CONTEXT = "session_id long, seq long, preference_terms array<string>, exclude_terms array<string>, excluded_songs array<long>, excluded_signatures array<string>, seed_songs array<long>"
EVENTS = ("session_id", "seq", "ts", "event", "song_id", "artist", "signature", "terms", "avoid", "exclude_seen")
IDLE_MS = 7 * 24 * 3600 * 1000


def prepared(events: DataFrame) -> DataFrame:
    """Names in normal form, blank ones as null."""
    name = lambda c: F.nullif(text.session_text(c), F.lit(""))
    names = lambda c: F.array_distinct(F.array_compact(F.transform(F.coalesce(c, F.array().cast("array<string>")), name)))
    made = {"artist": name(F.col("artist")), "signature": name(F.col("signature")), "terms": names(F.col("terms")), "avoid": names(F.col("avoid")), "exclude_seen": F.coalesce("exclude_seen", F.lit(False))}
    return events.select(*[made.get(c, F.col(c)).alias(c) for c in EVENTS])


def contexts(events: DataFrame) -> DataFrame:
    """CONTEXT rows of a table of events; a session is one row by definition."""
    rows = prepared(events)
    is_in = lambda *names: F.col("event").isin(*names)
    ordered = lambda when, value: F.array_distinct(F.transform(F.sort_array(F.collect_list(F.when(when & value.isNotNull(), F.struct("seq", value.alias("v"))))), lambda x: x["v"]))
    found = rows.groupBy("session_id").agg(
        F.max("seq").alias("seq"), F.max_by(F.when(is_in("request"), F.struct("terms", "exclude_seen")), F.when(is_in("request"), F.col("seq"))).alias("last"),
        F.array_distinct(F.flatten(F.transform(F.sort_array(F.collect_list(F.when(is_in("request"), F.struct("seq", "avoid")))), lambda x: x["avoid"]))).alias("avoid"),
        ordered(is_in("hide_artist"), F.col("artist")).alias("artists"), ordered(is_in(*SEEDS), F.col("song_id")).alias("seed_songs"),
        F.collect_set(F.when(is_in("shown"), F.col("song_id"))).alias("seen"), F.collect_set(F.when(is_in("shown"), F.col("signature"))).alias("signatures"), F.collect_set(F.when(is_in(*HIDES), F.col("song_id"))).alias("hidden"),
    )
    none = F.array().cast("array<string>")
    return found.select(
        "session_id", "seq", F.coalesce("last.terms", none).alias("preference_terms"), F.array_union("avoid", "artists").alias("exclude_terms"),
        F.sort_array(F.when(F.coalesce("last.exclude_seen", F.lit(False)), F.array_union("hidden", "seen")).otherwise(F.col("hidden"))).alias("excluded_songs"), F.sort_array("signatures").alias("excluded_signatures"), "seed_songs",
    )


class _Session(StatefulProcessor):
    """A session's state as one value: for each kind of entry the values and the places of their first sight, the last request, the timer.

    Every call of a state variable goes to the JVM and back. A touched session's context is given whole, so all its entries
    are read anyway: one call reads them and one writes them, whatever the number of rows.
    """

    MAPS = {"hidden": "long", "seen": "long", "seeds": "long", "signatures": "string", "avoid": "string", "artists": "string"}
    STATE = "seq long, timer long, request_seq long, terms array<string>, exclude_seen boolean, " + ", ".join(f"{n} array<{kind}>, {n}_seq array<long>, {n}_at array<int>" for n, kind in MAPS.items())

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("session", self.STATE)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N803
        old = self.state.get()
        seq, timer, request_seq, terms, exclude_seen = tuple(old)[:5] if old else (-1, None, None, [], False)
        maps: dict[str, dict] = {n: {} for n in self.MAPS}
        if old:
            for i, n in enumerate(self.MAPS):
                maps[n] = {v: (s, at) for v, s, at in zip(*tuple(old)[5 + 3 * i : 8 + 3 * i])}

        def note(name: str, value, seq: int, at: int = 0) -> None:
            if value is not None and (value not in maps[name] or (seq, at) < maps[name][value]):
                maps[name][value] = (seq, at)

        latest = None
        for r in rows:
            seq, latest = max(seq, r.seq), r.ts if latest is None else max(latest, r.ts)
            if r.event == "request":
                if request_seq is None or request_seq <= r.seq:
                    request_seq, terms, exclude_seen = r.seq, list(r.terms), r.exclude_seen
                for at, term in enumerate(r.avoid):
                    note("avoid", term, r.seq, at)
            elif r.event == "shown":
                note("seen", r.song_id, r.seq)
                note("signatures", r.signature, r.seq)
            elif r.event in SEEDS:
                note("seeds", r.song_id, r.seq)
            elif r.event in HIDES:
                note("hidden", r.song_id, r.seq)
            elif r.event == "hide_artist":
                note("artists", r.artist, r.seq)
        due = int(latest.timestamp() * 1000) + self.idle_ms
        if timer is not None and timer != due:
            self.handle.deleteTimer(timer)
        if timer != due:
            self.handle.registerTimer(due)
        columns = [x for m in maps.values() for x in (list(m), [p[0] for p in m.values()], [p[1] for p in m.values()])]
        self.state.update((seq, due, request_seq, list(terms or []), exclude_seen, *columns))
        ordered = lambda n: sorted(maps[n], key=maps[n].get)
        avoid = ordered("avoid")
        yield Row(
            session_id=key[0], seq=seq, preference_terms=list(terms or []), exclude_terms=avoid + [a for a in ordered("artists") if a not in maps["avoid"]],
            excluded_songs=sorted({*maps["hidden"], *(maps["seen"] if exclude_seen else ())}), excluded_signatures=sorted(maps["signatures"]), seed_songs=ordered("seeds"),
        )

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N803
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def context_stream(events: DataFrame, late: str = "1 hour", idle_ms: int = IDLE_MS) -> DataFrame:
    """CONTEXT rows of the sessions that each micro-batch touches; for update mode, with RocksDB as the state store."""
    rows = prepared(events).withWatermark("ts", late)
    return rows.groupBy("session_id").transformWithState(statefulProcessor=_Session(idle_ms), outputStructType=CONTEXT, outputMode="Update", timeMode="EventTime")


def filtered(ranked: DataFrame, context: DataFrame, labels: list[str], cap: int = 2) -> DataFrame:
    """``ranked`` (session_id, pos, song_id, artist, signature, ...) as a session's context leaves it, with nth and evidence.

    Excluded songs go, songs that match a term to avoid, and, if the request has terms, those that match none of them (what
    ``labels``, columns of ``ranked``, say decides); then signatures that were shown before, later songs of one signature,
    and songs of an artist beyond ``cap``. evidence: the context's terms and seeds, as an explanation quotes them.
    """
    c = context.select("session_id", "preference_terms", "exclude_terms", "excluded_songs", "excluded_signatures", "seed_songs")
    met = ranked.join(c, "session_id", "left")
    hits = lambda terms: F.coalesce(F.exists(terms, lambda t: se.matches_term(t, *[F.coalesce(F.col(x), F.lit("")) for x in labels])), F.lit(False))
    none = F.coalesce(F.size("preference_terms"), F.lit(0)) == 0
    gone = F.coalesce(F.array_contains("excluded_songs", F.col("song_id")), F.lit(False)) | F.coalesce(F.array_contains("excluded_signatures", text.session_text(F.col("signature"))), F.lit(False))
    kept = met.where(~gone & ~hits(F.col("exclude_terms")) & (none | hits(se.effective_terms(F.col("preference_terms")))))
    rows = kept.withColumn("artist_key", text.session_text(F.coalesce("artist", F.lit("")))).withColumn("evidence", F.struct("preference_terms", "exclude_terms", "seed_songs"))
    once = se.first_by_signature_with_cap(rows, ["session_id"], [F.col("pos")], cap)
    return once.select(*ranked.columns, "nth", "evidence")


def filtered_lists(sessions: DataFrame, context: DataFrame, lists: DataFrame, labels: list[str], cap: int = 2) -> DataFrame:
    """session_id, song_id, nth as ``filtered`` gives them, where many sessions share a ranked list.

    sessions: session_id, list_id. lists: list_id, pos, song_id, artist, signature and the labels. A list is packed once, its
    songs with equal labels, signature and artist as one class; a term is looked for once in each distinct label of a list,
    and a session then goes through classes and the few songs that it excludes.
    """
    ship_package(sessions.sparkSession)
    texts = [f"_{i}{form}" for i in range(len(labels)) for form in "tc"]
    made = [f(F.coalesce(F.col(x), F.lit(""))).alias(f"_{i}{form}") for i, x in enumerate(labels) for form, f in (("t", text.session_text), ("c", text.compact))]
    rows = lists.select("list_id", "pos", "song_id", F.coalesce("signature", F.lit("")).alias("signature"), text.session_text(F.col("signature")).alias("shown"), text.session_text(F.coalesce("artist", F.lit(""))).alias("artist"), *made)

    def pack(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("pos")
        columns = {c: rows.column(c).combine_chunks().dictionary_encode() for c in ("signature", "shown", "artist", *texts)}
        code = np.stack([x.indices.to_numpy() for x in columns.values()], axis=1)
        kinds, cls = np.unique(code, axis=0, return_inverse=True)
        cls = cls.ravel()
        order = np.argsort(cls, kind="stable")
        out = {"song_id": rows.column("song_id").to_numpy(), "cls": cls, "places": order, "ends": np.concatenate([[0], np.cumsum(np.bincount(cls, minlength=len(kinds)))])}
        out |= {c: (kinds[:, i], columns[c].dictionary.to_pylist()) for i, c in enumerate(columns)}
        return pa.table({"list_id": rows.column("list_id").slice(0, 1), "songs": pa.array([pickle.dumps(out, 5)], pa.binary())})

    packed = written(rows.groupBy("list_id").applyInArrow(pack, "list_id long, songs binary"), "ranked-lists")
    pair = lambda terms: F.transform(F.coalesce(terms, F.array().cast("array<string>")), lambda t: F.struct(text.session_text(t).alias("t"), text.compact(t).alias("c")))
    c = context.select("session_id", pair(F.col("exclude_terms")).alias("avoid"), F.when(F.size("preference_terms") > 0, pair(se.effective_terms(F.col("preference_terms")))).alias("terms"), "excluded_songs", "excluded_signatures")
    asked = sessions.join(c, "session_id", "left")
    blocks = F.pmod(F.xxhash64("session_id"), F.lit(max(1, sessions.count() // SESSIONS_A_BLOCK)))
    asked = asked.groupBy("list_id", blocks.alias("b")).agg(F.collect_list(F.struct(*c.columns)).alias("sessions"))
    asked = asked.repartition(8 * sessions.sparkSession.sparkContext.defaultParallelism, "list_id", "b")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block, found = pickle.loads(batch.column("songs")[i].as_py()), [[], [], []]
                looked: dict[tuple, np.ndarray] = {}
                for x in batch.column("sessions")[i].as_py():
                    at, nth = _kept(x, block, texts, cap, looked)
                    for to, some in zip(found, (np.full(len(at), x["session_id"]), block["song_id"][at], nth.astype(np.int32))):
                        to.append(some)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in found], ["session_id", "song_id", "nth"])

    return asked.join(packed, "list_id").select("sessions", "songs").mapInArrow(keep, "session_id long, song_id long, nth int")


#: Sessions that meet a list at once, where all have the same one.
SESSIONS_A_BLOCK = 512


def _kept(session: dict, block: dict, texts: list[str], cap: int, looked: dict) -> tuple[np.ndarray, np.ndarray]:
    """Places of the songs of a list that a session's context leaves, and which of their artist's each one is."""
    n, (signature, signatures), (shown, names), (artist, artists) = len(block["ends"]) - 1, block["signature"], block["shown"], block["artist"]

    def hit(term: dict) -> np.ndarray:
        key = (term["t"], term["c"])
        if key not in looked:
            out = np.zeros(n, bool)
            for name in texts:
                code, values = block[name]
                part = key[0] if name.endswith("t") else key[1]
                if part or name.endswith("t"):
                    out |= np.array([part in v for v in values], bool)[code]
            looked[key] = out
        return looked[key]

    open_ = np.ones(n, bool)
    for term in session["avoid"] or ():
        open_ &= ~hit(term)
    if session["terms"] is not None:
        open_ &= np.logical_or.reduce([np.zeros(n, bool), *map(hit, session["terms"])])
    if gone := set(session["excluded_signatures"] or ()):
        open_ &= ~np.array([v in gone for v in names], bool)[shown]
    places, ends, cls = block["places"], block["ends"], block["cls"]
    first = places[ends[:-1]].copy()
    out = np.flatnonzero(np.isin(block["song_id"], session["excluded_songs"] or []))
    for c in np.unique(cls[out]):
        rest = np.setdiff1d(places[ends[c] : ends[c + 1]], out)
        first[c], open_[c] = (rest[0], open_[c]) if len(rest) else (first[c], False)
    nameless = np.array([not v for v in signatures], bool)[signature]
    some = np.flatnonzero(open_ & ~nameless)
    some = some[np.lexsort((first[some], signature[some]))]
    new = np.concatenate([[True], signature[some[1:]] != signature[some[:-1]]])[: len(some)]
    every = [places[ends[c] : ends[c + 1]] for c in np.flatnonzero(open_ & nameless)]  # songs without a signature aren't repeats
    at = np.concatenate([first[some[new]], *[np.setdiff1d(x, out) for x in every]])
    a = artist[cls[at]]
    order = np.lexsort((at, a))
    at, a = at[order], a[order]
    start = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])[: len(a)])
    nth = np.arange(len(a)) - np.repeat(start, np.diff(np.append(start, len(a)))) + 1
    kept = (nth <= cap) | np.array([not v for v in artists], bool)[a]
    return at[kept], nth[kept]


def joined(values: Column) -> Column:
    return F.array_join(values.cast("array<string>"), ",")
