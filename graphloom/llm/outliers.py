"""Quality rules: robust multivariate outliers by minimum covariance determinant, with DataFrame functions only.

A document's statistics are rates and ratios on log scales, told in robust deviations from documents of its own length,
since those of few words vary more. Per language and source, minimum covariance determinant estimates of their mean and
covariance give each document a squared Mahalanobis distance, which for clean text is near chi-square.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

SYMBOLS = "[#*$%&|<>]"
WINDOW = 5
#: The statistic vector. Repeated words are in it where most documents have some: a statistic that is the same for a share
#: of CORE of all documents has no scale, and is left out.
STATISTICS = ["x_word", "x_letter", "x_distinct", "x_symbol", "x_line", "x_repeat"]
#: Most documents have no symbols and no repeated lines at all. These counts are told by a single count's size as the
#: least scale, so that one symbol is never far out, and many are.
COUNTS = ("x_symbol", "x_line")
#: Share of a group's documents that the estimate rests on.
CORE = 0.75
#: Chance that a normal document is rejected, which gives the cutoff of the distance.
CHANCE = 1e-6
#: A group's covariance counts so many documents that vary as its language's do beside its own core; a language's, as all
#: documents do. So it is never singular, and a group of any size has an estimate of its own, by one rule.
PRIOR = 5.0
#: Change of means and log determinants at which the concentration steps end; it doubles with each step after so many, so they always end.
TOLERANCE, PATIENCE = 1e-2, 15
#: Bins per doubling of a squared distance, in which the core's edge is found; the bin at the edge counts in part.
BINS = 16
#: Steps per unit in which medians and scales of the statistics are found.
GRID = 1024
#: Share that odds begin with, so that those of none and of all are finite.
ODDS = 0.01
#: Least conditional variance of a statistic that is no count, against numerical loss.
GUARD = 1e-6


def base_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_letters, n_distinct (long) instead of its text.

    Within a text, 5-word windows are compared as 64-bit hashes of their words' hashes, sorted with their places: equal
    neighbours are windows found twice. All of it is array functions over one row; nothing is exploded or shuffled.
    """
    keep = [c for c in docs.columns if c != text]
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(t, common.SPACE_CLASS), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(common.WORD_CLASS))
    rows = docs.select(
        *keep,
        (F.length(t) - F.length(F.regexp_replace(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace(t, r"\P{L}+", "")).cast("long").alias("n_letters"),
        F.transform(F.array(lines), lambda x: F.size(x) - F.size(F.array_distinct(x)))[0].cast("long").alias("n_dup_lines"),
        F.transform(F.array(words), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), F.size(F.array_distinct(w)).cast("long").alias("n_distinct"), _repeated(w).alias("n_repeat_words")))[0].alias("w"),
    )
    return rows.select(*keep, "w.n_words", "w.word_chars", "n_symbols", "n_dup_lines", F.col("w.n_repeat_words").cast("long").alias("n_repeat_words"), "n_letters", "w.n_distinct")


def _repeated(words: Column) -> Column:
    """Words that stand in a window found twice or more."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    n_windows = F.size(words) - (WINDOW - 1)

    def windows(h: Column) -> Column:
        # The i-th of five arrays, each one word further on, gives a window's i-th word.
        return F.transform(F.arrays_zip(*[F.slice(h, i + 1, n_windows).alias(f"h{i}") for i in range(WINDOW)]), lambda z: F.xxhash64(*[z[f"h{i}"] for i in range(WINDOW)]))

    def covered(starts: Column) -> Column:
        # From one start to the next, at most a window's words are new.
        following = F.concat(F.slice(starts, 2, F.size(starts)), F.array(F.lit(1 << 30)))
        return F.aggregate(F.zip_with(starts, following, lambda a, b: F.least(b - a, F.lit(WINDOW))), F.lit(0), lambda s, x: s + x)

    def found_twice(w: Column) -> Column:
        placed = F.array_sort(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("at"))))
        before = lambda p: F.concat(F.array(F.lit(None).cast("long")), F.slice(p["h"], 1, F.size(p) - 1))
        after = lambda p: F.concat(F.slice(p["h"], 2, F.size(p)), F.array(F.lit(None).cast("long")))
        marked = F.transform(F.array(placed), lambda p: F.filter(F.arrays_zip(p["at"].alias("at"), p["h"].alias("h"), before(p).alias("b"), after(p).alias("a")), lambda z: z["h"].eqNullSafe(z["b"]) | z["h"].eqNullSafe(z["a"])))[0]
        return F.transform(F.array(F.array_sort(F.transform(marked, lambda z: z["at"]))), covered)[0]

    some = F.transform(F.array(F.transform(F.array(hashes), windows)[0]), lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), found_twice(w)).otherwise(F.lit(0)))[0]
    return F.when(n_windows > 1, some).otherwise(F.lit(0))


def transformed() -> list[Column]:
    """The statistics: logs of mean word length, of the odds of letters, of the odds that a word is a repeat; and roots of rates per word, which steady the spread of counts."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    odds = lambda some, of: F.log((some / of + ODDS) / (1 + ODDS - some / of))
    return [
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n).alias("x_word"),
        odds(F.col("n_letters"), F.greatest(F.col("word_chars"), F.lit(1)).cast("double")).alias("x_letter"),
        odds(F.col("n_words") - F.col("n_distinct"), n).alias("x_distinct"),
        F.sqrt(F.col("n_symbols") / n).alias("x_symbol"),
        F.sqrt(F.col("n_dup_lines") / n).alias("x_line"),
        F.sqrt(F.col("n_repeat_words") / n).alias("x_repeat"),
    ]


def chi_square(x: float, p: int) -> float:
    """The chance that a chi-square variable of p degrees is x at most: the series of the incomplete gamma function."""
    if x <= 0:
        return 0.0
    a, h = p / 2, x / 2
    term = total = 1 / a
    k = a
    while term > total * 1e-16:
        k += 1
        term *= h / k
        total += term
    return min(1.0, total * math.exp(a * math.log(h) - h - math.lgamma(a)))


def quantile(share: float, p: int) -> float:
    """Where chi_square reaches a share, by halving."""
    low, high = 0.0, 1.0
    while chi_square(high, p) < share and high < 1e4:
        high *= 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, p) < share else (low, mid)
    return high


def consistency(core: float, p: int) -> float:
    """What a core's covariance is multiplied by to be that of all, for normal data of p statistics."""
    return core / chi_square(quantile(core, p), p + 2) if core < 1 else 1.0


def _at_share(rows: DataFrame, values: dict[str, Column], share: float, by: str) -> dict[tuple[int | None, str], float]:
    """Per value of `by` (a number of few values), and over all rows (None): where each value reaches a share of its rows.

    Values are counted on a grid, so nothing is sorted or gathered, and equal tables give equal results.
    """
    stacked = rows.select(by, F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.round(v * GRID).cast("long").alias("v")) for k, v in values.items()])).alias("s"))
    counted = stacked.groupBy("s.name", "s.v", by).agg(F.count(F.lit(1)).alias("n"))
    counted = counted.select("name", "v", "n", F.explode(F.array(F.col(by), F.lit(None).cast("int"))).alias(by)).groupBy("name", by, "v").agg(F.sum("n").alias("n"))
    group = W.partitionBy("name", by)
    upto = F.sum("n").over(group.orderBy("v"))
    reached = counted.withColumn("upto", upto).withColumn("all", F.sum("n").over(group)).filter(F.col("upto") >= F.col("all") * share)
    return {(r[by], r["name"]): r["v"] / GRID for r in reached.groupBy("name", by).agg(F.min("v").alias("v")).collect()}


def scales(rows: DataFrame, names: list[str], core: float) -> tuple[list[str], list[tuple[int, list[float], list[float]]]]:
    """The statistics that have a scale; and per doubling of length (column `doubling`) their medians and scales.

    A scale is the deviation from the median that a share of `core` stays below, against what that is for a normal
    variable; of a count, not less than a single one makes. One that is nil among documents of a length is taken from all.
    """
    medians = _at_share(rows, {x: F.col(x) for x in names}, 0.5, "doubling")
    lengths = sorted({d for d, _ in medians if d is not None})
    middle = lambda x: F.coalesce(*[F.when(F.col("doubling") == d, F.lit(medians[d, x])) for d in lengths])
    spread = _at_share(rows, {x: F.abs(F.col(x) - middle(x)) for x in names}, core, "doubling") if lengths else {}
    normal = math.sqrt(quantile(core, 1))
    kept = [x for x in names if spread and (x in COUNTS or spread[None, x] > 0)]
    scale = lambda d, x: max(spread[d, x] / normal, 2 ** (-d / 2)) if x in COUNTS else (spread[d, x] or spread[None, x]) / normal
    return kept, [(d, [medians[d, x] for x in kept], [scale(d, x) for x in kept]) for d in lengths]


def standardised(kept: list[str], lengths: list[tuple[int, list[float], list[float]]]) -> list[Column]:
    """Deviations z_i from the median of documents of the same length, in their scale."""

    def pick(values: dict[int, float]) -> Column:
        return reduce(lambda rest, d: F.when(F.col("doubling") == d, F.lit(values[d])).otherwise(rest), values, F.lit(None).cast("double"))

    return [((F.col(x) - pick({d: m[i] for d, m, _ in lengths})) / pick({d: s[i] for d, _, s in lengths})).alias(f"z_{i}") for i, x in enumerate(kept)]


class _Estimate:
    """Mean mu_i and Cholesky factor l_i_j of a covariance as columns, and squared distances under them."""

    def __init__(self, p: int, least: list[float] | None = None):
        self.p = p
        #: The least conditional variance of each statistic.
        self.least = least or [GUARD] * p
        self.pairs = [(i, j) for i in range(p) for j in range(i + 1)]
        self.columns = [f"mu_{i}" for i in range(p)] + [f"l_{i}_{j}" for i, j in self.pairs]

    def measured(self, df: DataFrame, of: str) -> DataFrame:
        """df (z_i, and an estimate in the struct `of`) with o_i, the deviations from its mean, and d, the squared distance.

        Column after column, by forward substitution: each is one step of the plan, so the code made of it stays in methods
        that are small enough to be compiled.
        """
        df = df.select("*", *[(F.col(f"z_{i}") - F.col(f"{of}.mu_{i}")).alias(f"o_{i}") for i in range(self.p)])
        for i in range(self.p):
            rest = F.col(f"o_{i}") - sum((F.col(f"{of}.l_{i}_{k}") * F.col(f"y_{k}") for k in range(i)), F.lit(0.0))
            df = df.withColumn(f"y_{i}", rest / F.col(f"{of}.l_{i}_{i}"))
        return df.withColumn("d", sum((F.col(f"y_{i}") * F.col(f"y_{i}") for i in range(self.p)), F.lit(0.0))).drop(*[f"y_{i}" for i in range(self.p)])

    def moments(self) -> list[Column]:
        """Sums of deviations from an estimate's mean, so that nothing is lost to cancellation."""
        return [F.count(F.lit(1)).cast("double").alias("m_n"), *[F.sum(f"o_{i}").alias(f"m_{i}") for i in range(self.p)], *[F.sum(F.col(f"o_{i}") * F.col(f"o_{j}")).alias(f"m_{i}_{j}") for i, j in self.pairs]]

    def solved(self, prior: float) -> list[Column]:
        """The new estimate's mean and covariance c_i_j, from sums m_*, the last estimate `e` and the parent's `up`.

        The parent's covariance stands for `prior` documents beside those summed; the mean is the group's own.
        """
        out = [(F.col(f"e.mu_{i}") + F.col(f"m_{i}") / F.col("m_n")).alias(f"mu_{i}") for i in range(self.p)]
        for i, j in self.pairs:
            own = F.col(f"m_{i}_{j}") - F.col(f"m_{i}") * F.col(f"m_{j}") / F.col("m_n")
            above = sum((F.col(f"up.l_{i}_{k}") * F.col(f"up.l_{j}_{k}") for k in range(j + 1)), F.lit(0.0))
            out.append(((own + above * prior) / (F.col("m_n") + prior)).alias(f"c_{i}_{j}"))
        return out

    def factored(self, df: DataFrame) -> DataFrame:
        """df with l_i_j instead of the covariance c_i_j, and log_det."""
        for i, j in self.pairs:
            c = F.col(f"c_{i}_{j}") - sum((F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}") for k in range(j)), F.lit(0.0))
            df = df.withColumn(f"l_{i}_{j}", F.sqrt(F.greatest(c, F.lit(self.least[i]))) if i == j else c / F.col(f"l_{j}_{j}"))
        return df.withColumn("log_det", 2 * sum((F.log(F.col(f"l_{i}_{i}")) for i in range(self.p)), F.lit(0.0))).drop(*[f"c_{i}_{j}" for i, j in self.pairs])

    def given(self, mean: float, scale: float) -> Column:
        """The estimate of independent statistics of one mean and spread."""
        return F.struct(*[F.lit(mean).alias(f"mu_{i}") for i in range(self.p)], *[F.lit(scale if i == j else 0.0).alias(f"l_{i}_{j}") for i, j in self.pairs])


#: A group: level 0 are all documents, 1 those of a language, 2 those of a language and source.
_KEY = ["level", "lang", "source"]


def _groups() -> Column:
    none = F.lit(None).cast("string")
    group = lambda level, lang, source: F.struct(F.lit(level).alias("level"), lang.alias("lang"), source.alias("source"))
    return F.array(group(0, none, none), group(1, F.col("lang"), none), group(2, F.col("lang"), F.col("source")))


def _better(state: DataFrame) -> DataFrame:
    """Of each group the estimate `best` of the start whose determinant is less."""
    return state.select(*_KEY, "rows", F.array_min(F.transform("s", lambda x: F.struct(x["log_det"], x["start"], x["e"].alias("e"))))["e"].alias("best"))


def _with_parents(state: DataFrame, top: Column) -> DataFrame:
    """state with the estimate `up` of the group one level up; `top` for all documents."""
    parents = _better(state).filter("level < 2").select(F.col("level").alias("u_level"), F.col("lang").alias("u_lang"), F.col("best").alias("up"))
    above = F.when(F.col("level") == 2, F.col("lang"))
    return state.join(parents, (F.col("u_level") == F.col("level") - 1) & F.col("u_lang").eqNullSafe(above), "left").select(*_KEY, "rows", "s", F.coalesce("up", top).alias("up"))


def estimates(scratch: common.Scratch, points: DataFrame, p: int, core: float = CORE, prior: float = PRIOR, least: list[float] | None = None) -> DataFrame:
    """Per group of points (lang, source, z_i), on all three levels: level, lang, source, rows, best (struct of mu_i and l_i_j, of the core).

    Concentration steps run until nothing moves: the core is the share of rows nearest to the last estimate, and gives
    the next. All groups take a step together, from two starts: the estimate of the group one level up (above all, mean 0
    and scale 1), and mean and covariance of all the group's rows. The core's edge is found in bins of the distance,
    counted per group, so no group is sorted or gathered; and estimates stay in tables, however many groups there are.
    No statistic's conditional variance falls below its value in `least`.
    """
    est = _Estimate(p, least)
    z = [f"z_{i}" for i in range(p)]
    rows = points.select(F.explode(_groups()).alias("g"), *z).select("g.*", *z)
    top = est.given(0.0, 1 / math.sqrt(consistency(core, p)))
    start = lambda k: F.struct(F.lit(k).alias("start"), top.alias("e"), F.lit(0.0).alias("log_det"), F.lit(k == 1).alias("whole"), F.lit(math.inf).alias("moved"))
    state = scratch.write(rows.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("rows")).select("*", F.array(start(0), start(1)).alias("s")), "step0")
    groups = state.count()
    step, tolerance = 0, TOLERANCE
    group = W.partitionBy(*_KEY, "start")
    # The second start's first step takes all rows as its core: they share a bin.
    edge = F.when(F.col("whole"), F.lit(0)).otherwise(F.floor(F.log2(F.col("d") + F.lit(1e-9)) * BINS).cast("int"))
    sums = ["m_n", *[f"m_{i}" for i in range(p)], *[f"m_{i}_{j}" for i, j in est.pairs]]
    before = F.coalesce(F.sum("m_n").over(group.orderBy("bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    wanted = F.when(F.col("whole"), F.col("total")).otherwise(F.ceil(F.col("total") * core))
    share = F.greatest(F.least((wanted - F.col("before")) / F.col("m_n"), F.lit(1.0)), F.lit(0.0))
    moments, solved = est.moments(), est.solved(prior)
    moved = F.when(F.col("whole"), F.lit(math.inf)).otherwise(F.greatest(F.abs(F.col("log_det") - F.col("was")), *[F.abs(F.col(f"mu_{i}") - F.col(f"e.mu_{i}")) for i in range(p)]))
    while groups:
        last = _with_parents(state, top)
        near = common.attach(rows, last, _KEY, "inner", small_rows=groups).select(*_KEY, F.explode("s").alias("s"), *z).select(*_KEY, "s.start", "s.e", "s.whole", *z)
        bins = est.measured(near, "e").withColumn("bin", edge).groupBy(*_KEY, "start", "bin").agg(*moments, F.max("whole").alias("whole"))
        # Bins of a group meet once, and stay so for all that follows.
        part = bins.repartition(*_KEY).withColumn("before", before).withColumn("total", F.sum("m_n").over(group)).withColumn("share", share).filter("share > 0")
        summed = part.groupBy(*_KEY, "start").agg(*[F.sum(F.col(c) * F.col("share")).alias(c) for c in sums])
        flat = last.select(*_KEY, "rows", F.explode("s").alias("s"), "up").select(*_KEY, "rows", "s.start", "s.e", "s.whole", F.col("s.log_det").alias("was"), "up")
        own = common.attach(summed, flat, [*_KEY, "start"], "inner", small_rows=2 * groups)
        new = est.factored(own.select(*_KEY, "rows", "start", "e", "whole", "was", *solved)).withColumn("moved", moved)
        new = new.groupBy(*_KEY).agg(F.max("rows").alias("rows"), F.array_sort(F.collect_list(F.struct("start", F.struct(*est.columns).alias("e"), "log_det", F.lit(False).alias("whole"), "moved"))).alias("s"))
        step += 1
        state = scratch.write(new, f"step{step}")
        if state.agg(F.max(F.array_max(F.transform("s", lambda x: x["moved"])))).first()[0] <= tolerance:
            break
        tolerance *= 2 if step >= PATIENCE else 1
    return _better(state)


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", core: float = CORE, chance: float = CHANCE, prior: float = PRIOR) -> DataFrame:
    """Per row: doc_id, lang, source, the base statistics, base_failed, distance (squared) and kept.

    A row fails the base if it has fewer than 10 words or more than a fifth of them repeated; the estimates rest on rows
    that pass. A row that passes is kept unless its distance under the estimate of its language and source is beyond what
    normal documents have by `chance`. Null languages and sources are groups of their own; null and empty texts fail the
    base; ties share a bin; rows that repeat an id are judged alike. Where no statistic varies, distances are 0. An empty
    table gives no rows; other columns are not carried, so none can clash.
    """
    scratch = common.Scratch(docs.sparkSession)
    rows = base_statistics(common.hidden(docs, doc_id=doc_id, text=text, lang=lang, source=source))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    doubling = F.floor(F.log2(F.greatest(F.col("n_words"), F.lit(1)))).cast("int").alias("doubling")
    rows = scratch.write(rows.withColumn("base_failed", failed).select("*", doubling, *transformed()), "statistics")
    good = rows.filter("not base_failed")
    kept, lengths = scales(good, STATISTICS, core)
    p = len(kept)
    out = rows.withColumn("distance", F.lit(0.0))
    if p:
        points = scratch.write(good.select("lang", "source", *standardised(kept, lengths)), "points")
        one = 1 / consistency(core, p)  # a count's variance in a core is that of a single count at least
        best = estimates(scratch, points, p, core, prior, [one if x in COUNTS else GUARD for x in kept]).filter("level = 2").select("lang", "source", F.col("best").alias("est"))
        scored = common.attach(rows.select("*", *standardised(kept, lengths)), best, ["lang", "source"])
        out = _Estimate(p).measured(scored, "est").withColumn("distance", F.col("d") / consistency(core, p))
    verdict = ~F.col("base_failed") & F.coalesce(F.col("distance") <= quantile(1 - chance, max(p, 1)), F.lit(True))
    return out.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.when(~F.col("base_failed"), F.col("distance")).alias("distance"), verdict.alias("kept"))


def op3_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(common.documents(spark, sf_dir, "doc_id", "text", "lang", "source"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("distance", 4).alias("distance"))
