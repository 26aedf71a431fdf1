"""Training samples from agent runs: prompts, completions, groups of one prompt, and their counts.

runs: query, artists and genres (maps of preferences, or null), top_k (or null), decisions (array<struct<thought,
tool>>), answer, tracks (array<struct<title, artist>>), reward (or null).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The lines of a rendered sample.
OPENING = ("You are {agent}, a tool-using music recommendation agent.", "Reason step by step (ReAct), call tools, then answer.", "")
GROUNDED = "Observation: grounded candidate tracks confirmed."
#: What prompts call the agent.
AGENT = "the assistant"


def _top_names(preferences: Column, name: str) -> Column:
    """'name: a, b, c', the three strongest, ties by name; null if there are none."""
    ranked = F.array_sort(F.transform(F.map_entries(preferences), lambda e: F.struct((-e["value"]).alias("n"), e["key"].alias("k"))))
    names = F.array_join(F.transform(F.slice(ranked, 1, 3), lambda e: e["k"]), ", ")
    return F.when(F.size(F.map_keys(preferences)) > 0, F.concat(F.lit(f"{name}: "), names))


def prompt(query: Column, artists: Column, genres: Column, top_k: Column, agent: str = AGENT) -> Column:
    """Empty for a blank query."""
    q = F.trim(F.coalesce(query, F.lit("")))
    taste = F.concat_ws("; ", _top_names(artists, "artists"), _top_names(genres, "genres"))
    lines = F.concat_ws("\n", *[F.lit(x.format(agent=agent)) for x in OPENING], F.concat(F.lit("User request: "), q), F.when(taste != "", F.concat(F.lit("Known listener taste: "), taste)), F.concat(F.lit("Requested count: "), top_k.cast("string")))
    return F.when(q == "", "").otherwise(lines)


def completion(decisions: Column, answer: Column, tracks: Column) -> Column:
    said = lambda word, x: F.when(F.trim(F.coalesce(x, F.lit(""))) != "", F.concat(F.lit(f"{word}: "), F.trim(x)))
    steps = F.array_compact(F.flatten(F.transform(decisions, lambda d: F.array(said("Thought", d["thought"]), said("Action", d["tool"])))))
    named = F.filter(tracks, lambda t: (F.trim(F.coalesce(t["title"], F.lit(""))) != "") & (F.trim(F.coalesce(t["artist"], F.lit(""))) != ""))
    lines = F.transform(named, lambda t: F.concat(F.lit("- "), F.trim(t["title"]), F.lit(" — "), F.trim(t["artist"])))
    some = F.size(named) > 0
    return F.concat_ws("\n", steps, F.when(some, GROUNDED), said("Final answer", answer), F.when(some, F.concat(F.lit("Recommended tracks:\n"), F.array_join(lines, "\n"))))


def rendered(runs: DataFrame, agent: str = AGENT) -> DataFrame:
    """``runs`` with prompt and completion."""
    return runs.withColumns({"prompt": prompt(F.col("query"), F.col("artists"), F.col("genres"), F.col("top_k"), agent), "completion": completion(F.col("decisions"), F.col("answer"), F.col("tracks"))})


def supervised(runs: DataFrame, least_reward: float, agent: str = AGENT) -> DataFrame:
    """The rendered runs with both texts whose reward reaches the threshold."""
    return rendered(runs, agent).where((F.col("prompt") != "") & (F.col("completion") != "") & (F.col("reward") >= least_reward))


def grouped(runs: DataFrame, order: list[str], least: int = 2, agent: str = AGENT) -> DataFrame:
    """prompt, responses, rewards (rounded to six places, none is 0) in input order, of prompts with enough responses and two rewards.

    A group is one sample, so it is one row by definition.
    """
    rows = rendered(runs, agent).where("prompt != '' AND completion != ''").withColumn("r", F.round(F.coalesce("reward", F.lit(0.0)), 6))
    groups = rows.groupBy("prompt").agg(F.sort_array(F.collect_list(F.struct(*order, "completion", "r"))).alias("rows"), F.min("r").alias("lo"), F.max("r").alias("hi"))
    return groups.where((F.size("rows") >= least) & (F.col("lo") != F.col("hi"))).select("prompt", F.col("rows.completion").alias("responses"), F.col("rows.r").alias("rewards"))


def sample_counts(records: DataFrame, samples: DataFrame) -> DataFrame:
    """One row: records, samples and skipped."""
    both = records.select(F.lit(0).alias("s")).union(samples.select(F.lit(1).alias("s")))
    n, s = F.count_if(F.col("s") == 0), F.count_if(F.col("s") == 1)
    return both.agg(n.alias("records"), s.alias("samples"), (n - s).alias("skipped"))
