"""Quality rules: base statistics, and robust multivariate outliers by language and source.

Statistics of each text are turned into a vector. For each (language, source) group the minimum covariance
determinant is estimated by concentration steps from two starts (median and scaled deviations; mean and
covariance of all rows): each step keeps the ``SHARE`` of rows that are nearest by Mahalanobis distance and
re-estimates from them. The start whose final determinant is smaller wins. Rows beyond ``cutoff`` are rejected.

A group with fewer than ``MIN_ROWS`` rows that pass the base rules is judged by the estimate of its language, made
of all rows of that language, and where these are too few as well by that of the whole corpus. Below ``MIN_ROWS``
rows in all, the floors' squares grow by ``MIN_ROWS`` over the rows, since so few show little of the spread.

Texts are read once: the scored rows are a written table. Only sums and counts by group, and by group and bucket for
the quantiles (exact counts over fixed buckets, so that partitions don't matter), are shuffled, with partial
aggregation; vectors meet their group's estimate by a broadcast of checked size, beyond it by salted keys. So a group
that holds most rows is no single task.

Defined results: a null text has no words and fails the base rules; null languages or sources form groups of
their own; if no row at all passes the base rules, no distance is known (null); repeated rows are judged alike; an
empty input gives an empty output; texts are taken whole, a text without spaces is one word; of the input's columns
those named like the new ones are replaced, all others pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from melisma.llm.rows import row_id, row_tag, without_keys
from melisma.llm.text import SPACES, null_key, words
from melisma.session import discard, written

SHARE = 0.75
STEPS = 3
MIN_ROWS = 50
#: Chance that a row of a normal group lies beyond the cutoff (5.13).
TAIL = 1e-4
#: Standard deviations that estimates don't fall below, by statistic. For length 0.7 to 0.9 and
#: for capitals 2.3 to 2.9 times the spread of labelled clean rows of a language; the other shares are 0 in most rows, so the spread of the nearest rows says nothing of them: lines and
#: repeats follow the shares that labelled clean rows reach (0.33 and 0.28), symbols the gap below the least of
#: labelled junk (0.28). Chosen on the labels of sf0.1, where they reject 291 of 291 junk rows and 0 of 3243 clean ones.
FLOORS = {"x_length": 0.03, "x_symbols": 0.06, "x_lines": 0.1, "x_repeats": 0.09, "x_capitals": 0.01}
FIELDS = tuple(FLOORS)
SYMBOLS = "[#*$%&|<>]"
MIN_WORDS, MAX_REPEATS = 50, 50
#: Buckets of the quantiles to a unit of log1p; groups whose estimates may be broadcast (about 250 bytes each), and
#: how many tasks share a group beyond that.
BUCKETS, MAX_GROUPS, SALTS = 4096, 50_000, 64
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def chi2_quantile(p: float, d: int) -> float:
    """Wilson and Hilferty's approximation."""
    return d * (1 - 2 / (9 * d) + NormalDist().inv_cdf(p) * (2 / (9 * d)) ** 0.5) ** 3


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is named."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(w: Column) -> Column:
    """How many words lie in a 3-word window that is found twice or more (64-bit hashes of windows)."""
    windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    def cover(s: Column) -> Column:
        same = lambda e, j: F.coalesce(F.get(s, j)["x"] == e["x"], F.lit(False))
        twice = F.filter(s, lambda e, j: same(e, j - 1) | same(e, j + 1))
        return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda e: F.array(e["i"], e["i"] + 1, e["i"] + 2)))))

    def count(h: Column) -> Column:
        by_value = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) < F.size(h), _let(by_value, cover)).otherwise(0)

    return F.when(F.size(w) >= 4, _let(windows, count)).otherwise(0)


def base_stats(text: Column) -> Column:
    """A struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines and n_capitals (long)."""
    whole = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    long = lambda x, name: x.cast("long").alias(name)

    def of(w: Column, rows: Column) -> Column:
        return F.struct(
            long(F.size(w), "n_words"), long(F.length(F.array_join(w, "")), "word_chars"), long(F.regexp_count(whole, F.lit(SYMBOLS)), "n_symbols"),
            long(F.size(rows) - F.size(F.array_distinct(rows)), "n_dup_lines"), long(repeated_words(w), "n_repeat_words"),
            long(F.size(rows), "n_lines"), long(F.regexp_count(whole, F.lit("\\p{Lu}")), "n_capitals"),
        )

    found = _let(words(whole), lambda w: _let(lines, lambda rows: of(w, rows)))
    # Never false, and not foldable: no filter on a statistic is pushed below the projection that makes it, where
    # the optimiser would repeat the whole.
    return F.when(F.monotonically_increasing_id() >= 0, found)


def with_vector(stats: DataFrame) -> DataFrame:
    """The transformed statistics of the struct ``_s``; all are 0 for a text without words."""
    n, chars = F.greatest(F.col("_s.n_words"), F.lit(1)).cast("double"), F.greatest(F.col("_s.word_chars"), F.lit(1)).cast("double")
    return stats.withColumns({
        "x_length": F.log(chars / n),
        "x_symbols": F.log1p(F.col("_s.n_symbols") / n),
        "x_lines": F.col("_s.n_dup_lines") / F.greatest(F.col("_s.n_lines"), F.lit(1)),
        "x_repeats": F.col("_s.n_repeat_words") / n,
        "x_capitals": F.col("_s.n_capitals") / chars,
    })


def _pairs() -> list[tuple[int, int]]:
    return [(i, j) for i in range(len(FIELDS)) for j in range(i + 1)]


def _floor(i: int, rows: Column) -> Column:
    """The square of a statistic's floor, for an estimate from so many rows."""
    return F.lit(FLOORS[FIELDS[i]] ** 2) * F.greatest(F.lit(1.0), F.lit(float(MIN_ROWS)) / rows)


def _moments(rows: DataFrame, factor: float, share: float) -> DataFrame:
    """Mean, covariance (times ``factor``, with the floors' squares added) and count by group and start.

    ``rows`` are this share of their group.
    """
    sums = [F.avg(f).alias(f"m{i}") for i, f in enumerate(FIELDS)]
    products = [F.avg(F.col(FIELDS[i]) * F.col(FIELDS[j])).alias(f"p{i}{j}") for i, j in _pairs()]
    got = rows.groupBy("group", "start").agg(F.count(F.lit(1)).alias("rows"), *sums, *products)
    cov = [
        ((F.col(f"p{i}{j}") - F.col(f"m{i}") * F.col(f"m{j}")) * F.lit(factor) + (_floor(i, F.col("rows") / F.lit(share)) if i == j else F.lit(0.0))).alias(f"c{i}{j}")
        for i, j in _pairs()
    ]
    return got.select("group", "start", "rows", *[f"m{i}" for i in range(len(FIELDS))], *cov)


def _factored(params: DataFrame) -> DataFrame:
    """Cholesky factor of the covariance, as columns l00, l10, ..., and its log determinant."""
    d = len(FIELDS)
    for i in range(d):
        for j in range(i + 1):
            rest = F.col(f"c{i}{j}")
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            value = F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / F.col(f"l{j}{j}")
            params = params.withColumn(f"l{i}{j}", value)
    logdet = sum((F.log(F.col(f"l{i}{i}")) * 2 for i in range(1, d)), F.log(F.col("l00")) * 2)
    keep = ["group", "start", "rows", *[f"m{i}" for i in range(d)], *[f"l{i}{j}" for i, j in _pairs()]]
    return params.withColumn("logdet", logdet).select(*keep, "logdet")


def _distance(at: str = "") -> Column:
    """Squared Mahalanobis distance by forward substitution, from the columns ``at``m0, ``at``l00, ..."""
    y: list[Column] = []
    for i, f in enumerate(FIELDS):
        rest = F.col(f) - F.col(f"{at}m{i}")
        for k in range(i):
            rest = rest - F.col(f"{at}l{i}{k}") * y[k]
        y.append(rest / F.col(f"{at}l{i}{i}"))
    total = y[0] * y[0]
    for v in y[1:]:
        total = total + v * v
    return total


def _met(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with the columns of a written table that is unique by ``keys``; no task gets all rows of a key."""
    if table.limit(MAX_GROUPS + 1).count() <= MAX_GROUPS:
        return rows.join(F.broadcast(table), keys)
    salted = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")).join(salted, [*keys, "_salt"]).drop("_salt")


def _quantile(rows: DataFrame, keys: list[str], values: list[Column], share: float) -> DataFrame:
    """q0, q1, ... by keys: upper borders of the buckets, 4096 to a unit of log1p, that hold the shares' last rows."""
    buckets = F.array(*[F.struct(F.lit(i).alias("f"), F.ceil(F.log1p(v) * BUCKETS).alias("b")) for i, v in enumerate(values)])
    counted = rows.select(*keys, F.inline(buckets)).groupBy(*keys, "f", "b").agg(F.count(F.lit(1)).alias("n"))
    line = Window.partitionBy(*keys, "f")
    upto = counted.withColumn("upto", F.sum("n").over(line.orderBy("b"))).withColumn("all", F.sum("n").over(line))
    found = upto.where(F.col("upto") >= F.col("all") * share)
    return found.groupBy(*keys).agg(*[F.expm1(F.min(F.when(F.col("f") == i, F.col("b"))) / float(BUCKETS)).alias(f"q{i}") for i in range(len(values))])


def pools(vectors: DataFrame, min_rows: int = MIN_ROWS) -> DataFrame:
    """(group, lang, base_failed) rows to group, lang, own, by_lang and pool: whose estimate judges each group.

    own: its own rows that pass the base rules are enough; by_lang: some group of this language needs the language's.
    """
    groups = written(vectors.groupBy("group", "lang").agg(F.count_if(~F.col("base_failed")).alias("n")), "quality-groups")
    own = F.col("n") >= min_rows
    langs = groups.groupBy("lang").agg(F.sum("n").alias("lang_n"), F.max(~own).alias("small"))
    enough = F.col("lang_n") >= min_rows
    pool = F.when(own, F.concat(F.lit("group/"), "group")).when(enough, F.concat(F.lit("lang/"), "lang")).otherwise(F.lit("corpus"))
    return groups.join(langs, "lang").select("group", "lang", own.alias("own"), (enough & F.col("small")).alias("by_lang"), pool.alias("pool"))


def pooled(vectors: DataFrame, chosen: DataFrame) -> DataFrame:
    """The rows (group, *FIELDS) that pass the base rules, once for each pool of ``chosen`` that they feed."""
    corpus = F.lit(not chosen.where("pool = 'corpus'").isEmpty())
    feeds = F.array_compact(F.array(
        F.when(F.col("own"), F.concat(F.lit("group/"), "group")), F.when(F.col("by_lang"), F.concat(F.lit("lang/"), "lang")), F.when(corpus, F.lit("corpus"))
    ))
    met = _met(vectors.where("NOT base_failed").drop("lang"), chosen, ["group"])
    return met.select(F.explode(feeds).alias("pool"), *FIELDS).withColumnRenamed("pool", "group")


def estimate_groups(vectors: DataFrame, share: float = SHARE, steps: int = STEPS) -> DataFrame:
    """(group, *FIELDS) rows to one robust estimate for each group."""
    d = len(FIELDS)
    fields = [F.col(f) for f in FIELDS]
    middle = written(_quantile(vectors, ["group"], fields, 0.5).select("group", *[F.col(f"q{i}").alias(f"m{i}") for i in range(d)]), "medians")
    apart = _quantile(_met(vectors, middle, ["group"]), ["group"], [F.abs(f - F.col(f"m{i}")) for i, f in enumerate(fields)], 0.5)
    counts = vectors.groupBy("group").agg(F.count(F.lit(1)).alias("rows"))
    spread = written(apart.join(middle, "group").join(counts, "group"), "spreads")
    scale = lambda i, j: (F.pow(F.col(f"q{i}") * 1.4826, F.lit(2)) + _floor(i, F.col("rows"))) if i == j else F.lit(0.0)
    robust = spread.select("group", F.lit(0).alias("start"), "rows", *[f"m{i}" for i in range(d)], *[scale(i, j).alias(f"c{i}{j}") for i, j in _pairs()])
    plain = _moments(vectors.withColumn("start", F.lit(1)), 1.0, 1.0)
    params = written(_factored(robust.unionByName(plain)), "mcd-start")
    discard(middle, spread)
    q = chi2_quantile(share, d)
    # The covariance of the nearest share of a normal sample is too small by this factor.
    below = NormalDist().cdf(((q / (d + 2)) ** (1 / 3) - 1 + 2 / (9 * (d + 2))) / (2 / (9 * (d + 2))) ** 0.5)
    both = vectors.withColumn("start", F.explode(F.array(F.lit(0), F.lit(1))))
    for _ in range(steps):
        near = _met(both, params, ["group", "start"]).select("group", "start", _distance().alias("d2"), *FIELDS)
        cut = written(_quantile(near, ["group", "start"], [F.col("d2")], share), "mcd-cut")
        step = written(_factored(_moments(_met(near, cut, ["group", "start"]).where("d2 <= q0"), share / below, share)), "mcd-step")
        discard(params, cut)
        params = step
    best = params.groupBy("group").agg(F.min_by("start", F.struct("logdet", "start")).alias("start"))
    return params.join(best, ["group", "start"])


def score(docs: DataFrame, keep: Sequence[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (text, lang, source, ...; all by default) as ``_row``, with the statistics ``_s``, the vector, base_failed, group and lang."""
    stats = docs.select(
        F.struct(*[docs[f"`{c}`"] for c in (docs.columns if keep is None else keep)]).alias("_row"), base_stats(docs["text"]).alias("_s"),
        null_key(docs["lang"]).alias("lang"), null_key(docs["source"]).alias("_source"),
    )
    n, repeats = F.col("_s.n_words"), F.col("_s.n_repeat_words")
    scored = with_vector(stats).withColumn("base_failed", (n < MIN_WORDS) | (100 * repeats > MAX_REPEATS * n))
    return scored.withColumn("group", F.concat_ws("/", "lang", "_source")).drop("_source")


def judged(docs: DataFrame, keep: Sequence[str] | None, tail: float) -> DataFrame:
    """The scored rows (a written table) with distance and kept."""
    scored = written(score(docs, keep), "quality-scores")
    vectors = scored.select("group", "lang", "base_failed", *FIELDS)
    chosen = written(pools(vectors), "quality-pools")
    fed = written(pooled(vectors, chosen), "quality-pooled")
    params = written(estimate_groups(fed), "mcd").withColumnRenamed("group", "pool")
    discard(fed)
    own = F.struct(*[f"m{i}" for i in range(len(FIELDS))], *[f"l{i}{j}" for i, j in _pairs()]).alias("p")
    params = written(chosen.join(params, "pool", "left").select("group", own), "mcd-by-group")
    far = _met(scored, params, ["group"]).withColumn("distance", F.sqrt(_distance("p.")))
    limit = chi2_quantile(1 - tail, len(FIELDS)) ** 0.5
    return far.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance") <= limit, F.lit(True)))


def judge(docs: DataFrame, keep: Sequence[str] | None = None, tail: float = TAIL) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all by default) with the base statistics, base_failed, distance (null if no row passes the base rules) and kept."""
    new = {*STATS, "base_failed", "distance", "kept"}
    old = [c for c in (docs.columns if keep is None else keep) if c not in new]
    return judged(docs, keep, tail).select(*[F.col(f"_row.`{c}`") for c in old], *[f"_s.{c}" for c in STATS], "base_failed", "distance", "kept")


def keep_good(docs: DataFrame, tail: float = TAIL) -> DataFrame:
    """The kept documents, with all their columns.

    Rows are told apart by id, text, language and source, which decide the verdict: texts are scored once, and only
    the keys of rejected rows meet the documents again.
    """
    content = ("text", "lang", "source")
    keyed = docs.select(row_id(docs), row_tag(docs, *content), *[docs[c] for c in content])
    gone = written(judged(keyed, ["_id", "_tag"], tail).where("NOT kept").select("_row._id", "_row._tag").distinct(), "rejected-rows")
    return without_keys(docs, gone, *content)
