"""Stateful streams over feedback events: last rewards and decayed affinities by user.

Arrival order decides, through a rising ``seq``; events are neither deduplicated nor reordered by time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from melisma.functions import constants as K


def last_rewards(events: DataFrame) -> DataFrame:
    """The running last non-zero reward of each user and song; for update or complete mode."""
    return events.where("reward10 != 0").groupBy("user_id", "song_id").agg(F.max_by("reward10", "seq").alias("reward10"), F.max("seq").alias("seq"))


def affinities(events: DataFrame) -> DataFrame:
    """user_id, label, affinity after each micro-batch: every event is one turn that mentions one label (column label).

    State is a user's label weights, at most the cap of labels, so it stays bounded.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        labels, weights = state.get if state.exists else ([], [])
        known = dict(zip(labels, weights))
        rows = pd.concat(list(batches)).sort_values("seq")
        for mentioned in rows.label:
            known = {k: w * K.AFFINITY_DECAY for k, w in known.items()}
            known = {k: w for k, w in known.items() if w >= K.AFFINITY_FLOOR or k == mentioned}
            known[mentioned] = min(1.0, known.get(mentioned, 0.0) * K.AFFINITY_DECAY + K.AFFINITY_BOOST)
            if len(known) > K.AFFINITY_CAP:
                known = dict(sorted(known.items(), key=lambda x: (-x[1], x[0]))[: K.AFFINITY_CAP])
        state.update((list(known), list(known.values())))
        yield pd.DataFrame({"user_id": key[0], "label": list(known), "affinity6": [int(w * 1e6 + 0.5) for w in known.values()], "seq": int(rows.seq.max())})

    return events.groupBy("user_id").applyInPandasWithState(fold, "user_id long, label string, affinity6 long, seq long", "labels array<string>, weights array<double>", "update", "NoTimeout")


def windowed_plays(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events and rewards by kind and hour, with a watermark that drops late rows and the state of past hours; for append or update mode."""
    hour = events.withWatermark("ts", late).groupBy(F.window("ts", width), "kind")
    return hour.agg(F.count(F.lit(1)).alias("events"), F.sum("reward10").alias("reward10")).select(F.col("window.start").alias("start"), "kind", "events", "reward10")
