r"""Quality rules with robust multivariate outliers (operator 10, DataFrame functions only).

Counts of each whole text: words ``[^\x20\x09-\x0D]+``, code points in words, symbols ``[#*$%&|<>]``, lines that repeat an
earlier line, words that lie in an 8-word window found twice or more. Two base rules reject outright: fewer than 20 words, or
over 30 % repeated words. The rest are judged by their transformed statistics (log mean word length; log shares of
symbols, repeated lines and repeated words): per language and source, location and scatter are estimated by minimum
covariance determinant, and a document far from them by Mahalanobis distance is rejected.

Estimation, from all documents that pass the base rules, for the corpus, each language, and each language and source at once:

1. Three deterministic starts: medians with median deviations; means with the covariance of all; medians with the
   covariance of the statistics bent by a hyperbolic tangent.
2. Concentration steps: the ``share`` nearest documents give the next mean and covariance, until no determinant falls any
   more (``MAX_STEPS`` at most; a step that does not lower a determinant is not taken). Of the three the least determinant wins.
3. Rescaled for consistency and reweighted once.
4. Shrinkage: an estimate from n documents counts n to ``PRIOR`` against that of the next wider group (its language, the
   corpus), the distance of their means included, so that groups of any size, one document too, are judged by the same rule.

Variances have a floor (``FLOORS``), without which the many documents with no symbol or repeat at all would make the scatter
singular; what of a variance the earlier statistics do not explain has a hundredth of it as its floor. ``LEVEL`` gives the cutoff, a quantile of chi-square: see the README for what the levels reject.

Statistics are held in whole 1024ths, so their counts, sums and products are exact: medians come from counts by value and
the share that is nearest from counts by step of distance (0.4 % wide; the step in which the share is reached belongs to it).
Estimates and verdicts are the same however the rows are partitioned.

Plan: one scan computes the counts; each step is one partial aggregate per group and step of distance (so a group that holds a
third of all rows is reduced to some thousand sums a task before the shuffle) and a join with three rows per group, broadcast
only after groups were counted. The factorisation of a covariance is written out as column expressions. Repeated windows
are compared by 64-bit hash within a text.

Defined results: null text has no words and fails the base rules; null language or source is a group of its own;
null or repeated identifiers keep a row each and repeated rows count each time; a text of any length is one row of counts,
made by one task; documents at the cutoff are kept; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from .shared import cut, dropped, hinted

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Least standard deviations of the transformed statistics.
FLOORS = (0.12, 0.35, 0.5, 0.6)
#: Documents that the next wider group's estimate is worth.
PRIOR = 50
#: Share of a clean group that the cutoff gives up, if its statistics were normal.
LEVEL = 1e-7
MAX_STEPS = 30
GROUPS_BROADCAST = 50_000
#: Steps of a statistic, and steps of ln(1 + squared distance).
_UNIT, _FINE = 1024, 256
_P = len(FLOORS)
_PAIRS = [(i, j) for i in range(_P) for j in range(i + 1)]


def text_words(text: Column) -> Column:
    return F.coalesce(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+", -1), ""), F.array().cast("array<string>"))


def repeated_words(words: Column, n: int = 8) -> Column:
    """Words in n-word windows that occur twice or more in the array; 0 unless some window repeats."""
    count = F.size(words) - n + 1
    hashes = F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.xxhash64(F.slice(words, i, F.lit(n))))
    return F.when(count > 1, hashes)


def _covered(hashes: Column, n: int = 8) -> Column:
    """Words under windows whose hash repeats: sort (hash, place), keep those with an equal neighbour, join overlaps."""
    placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def twice(placed: Column) -> Column:
        last = F.size(placed) - 1

        def equal(x: Column, j: Column) -> Column:
            before = F.when(j > 0, F.get(placed, j - 1)["h"] == x.h).otherwise(F.lit(False))
            after = F.when(j < last, F.get(placed, j + 1)["h"] == x.h).otherwise(F.lit(False))
            return before | after

        return F.sort_array(F.transform(F.filter(placed, equal), lambda x: x.i))

    start = F.struct(F.lit(-n).alias("at"), F.lit(0).alias("n"))
    places = F.transform(F.array(placed), twice)[0]  # sorted once: a lambda's argument is a value, an expression is not
    return F.aggregate(places, start, lambda a, i: F.struct(i.alias("at"), (a.n + F.least(F.lit(n), i - a.at)).alias("n")), lambda a: a.n)


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of each document."""
    words, lines = text_words(F.col("text")), F.filter(F.split("text", "\n", -1), lambda x: F.length(F.translate(x, BLANKS, "")) > 0)
    rows = docs.select("doc_id", "lang", "source", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("doc_id", "lang", "source", words.alias("words"), lines.alias("lines"), F.length(F.translate("text", BLANKS, "")).alias("word_chars"), (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).alias("n_symbols"))
    rows = rows.withColumn("hashes", repeated_words(F.col("words")))
    repeats = F.when(F.size(F.array_distinct("hashes")) < F.size("hashes"), _covered(F.col("hashes"))).otherwise(F.lit(0))
    out = rows.select(
        "doc_id", "lang", "source", F.size("words").cast("long").alias("n_words"), F.col("word_chars").cast("long"), F.col("n_symbols").cast("long"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), repeats.cast("long").alias("n_repeat_words"),
    )
    return out.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def vector() -> list[Column]:
    """The transformed statistics, in whole 1024ths."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    values = [F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n), *(F.log1p(100 * F.col(c) / n) for c in ("n_symbols", "n_dup_lines", "n_repeat_words"))]
    return [F.floor(v * _UNIT + 0.5).cast("long") for v in values]


def chi2_cdf(x: float, k: int) -> float:
    """Distribution function of chi-square, by the series of the incomplete gamma function."""
    if x <= 0:
        return 0.0
    a, x = k / 2, x / 2
    term = total = 1 / a
    i = a
    while term > total * 1e-16:
        i += 1
        term *= x / i
        total += term
    return min(1.0, math.exp(-x + a * math.log(x) - math.lgamma(a)) * total)


def chi2_quantile(p: float, k: int) -> float:
    low, high = 0.0, 400.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, k) < p else (low, mid)
    return high


def _distance() -> Column:
    """Squared Mahalanobis distance of x* from the group's columns m*, l** (lower factor): forward substitution."""
    ys: list[Column] = []
    for i in range(_P):
        y = F.col(f"x{i}") / _UNIT - F.col(f"m{i}")
        for j in range(i):
            y = y - F.col(f"l{i}{j}") * ys[j]
        ys.append(y / F.col(f"l{i}{i}"))
    return sum((y * y for y in ys), F.lit(0.0))


def _factored(groups: DataFrame) -> DataFrame:
    """``groups`` with covariances c** raised to the floors, their Cholesky factor (l**), and ``det``, the log determinant."""
    for i, j in _PAIRS:
        v = F.greatest(F.col(f"c{i}{j}"), F.lit(FLOORS[i] ** 2)) if i == j else F.col(f"c{i}{j}")
        groups = groups.withColumn(f"c{i}{j}", v)
        for k in range(j):
            v = v - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
        groups = groups.withColumn(f"l{i}{j}", F.sqrt(F.greatest(v, F.lit(FLOORS[i] ** 2 / 100))) if i == j else v / F.col(f"l{j}{j}"))
    return groups.withColumn("det", sum((2 * F.log(f"l{i}{i}") for i in range(_P)), F.lit(0.0)))


def _sums(prefix: str = "x") -> list[Column]:
    """Exact sums of whole numbers and their products, and how many."""
    one = [F.sum(f"{prefix}{i}").alias(f"s{i}") for i in range(_P)]
    return [F.count("*").alias("n"), *one, *(F.sum(F.col(f"{prefix}{i}") * F.col(f"{prefix}{j}")).alias(f"q{i}{j}") for i, j in _PAIRS)]


def _moments(sums: DataFrame, scale: float) -> DataFrame:
    """Means m* and covariances c** (times ``scale``) from sums."""
    mean = lambda i: F.col(f"s{i}") / F.col("n") / _UNIT
    out = sums.withColumns({f"m{i}": mean(i) for i in range(_P)})
    return out.withColumns({f"c{i}{j}": (F.col(f"q{i}{j}") / F.col("n") / _UNIT**2 - F.col(f"m{i}") * F.col(f"m{j}")) * scale for i, j in _PAIRS})


_M, _C, _L = [f"m{i}" for i in range(_P)], [f"c{i}{j}" for i, j in _PAIRS], [f"l{i}{j}" for i, j in _PAIRS]


def _medians(rows: DataFrame, keys: list[str], values: list[Column], names: list[str]) -> DataFrame:
    """Exact lower medians of whole numbers, from counts by value."""
    flat = rows.select(*keys, F.posexplode(F.array(*values)).alias("dim", "v")).groupBy(*keys, "dim", "v").agg(F.count("*").alias("n"))
    whole = Window.partitionBy(*keys, "dim")
    half = flat.withColumns({"upto": F.sum("n").over(whole.orderBy("v")), "all": F.sum("n").over(whole)}).where(2 * F.col("upto") >= F.col("all"))
    mids = half.groupBy(*keys, "dim").agg(F.min("v").alias("v"))
    return mids.groupBy(*keys).agg(*(F.max(F.when(F.col("dim") == i, F.col("v"))).alias(n) for i, n in enumerate(names)))


def _starts(rows: DataFrame, keys: list[str], join) -> DataFrame:
    """(keys, start, m*, l**, det): three estimates to start from."""
    xs = [F.col(f"x{i}") for i in range(_P)]
    mid = cut(_medians(rows, keys, xs, [f"o{i}" for i in range(_P)]), "medians")
    off = join(rows, mid)
    far = cut(_medians(off, keys, [F.abs(x - F.col(f"o{i}")) for i, x in enumerate(xs)], [f"d{i}" for i in range(_P)]), "deviations")
    robust = far.join(mid, keys).select(*keys, *(F.col(f"o{i}") for i in range(_P)), *(F.greatest(F.col(f"d{i}") * 1.4826 / _UNIT, F.lit(FLOORS[i])).alias(f"w{i}") for i in range(_P)))
    robust = cut(robust, "robust")
    bent = [F.floor(F.tanh((x - F.col(f"o{i}")) / _UNIT / F.col(f"w{i}")) * _UNIT + 0.5).cast("long").alias(f"y{i}") for i, x in enumerate(xs)]
    bends = join(rows, robust).select(*keys, *bent).groupBy(*keys).agg(*_sums("y"))
    bends = _moments(bends, 1.0).select(*keys, *(F.col(c).alias(f"b{c}") for c in _C))
    place = [(F.col(f"o{i}") / _UNIT).alias(f"m{i}") for i in range(_P)]
    plain = robust.select(*keys, F.lit(0).alias("start"), *place, *((F.col(f"w{i}") ** 2 if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i, j in _PAIRS))
    means = _moments(rows.groupBy(*keys).agg(*_sums()), 1.0).select(*keys, F.lit(1).alias("start"), *_M, *_C)
    width = lambda i: F.sqrt(F.greatest(F.col(f"bc{i}{i}"), F.lit(1e-9)))
    tanh = robust.join(bends, keys).select(*keys, F.lit(2).alias("start"), *place, *((F.col(f"bc{i}{j}") / width(i) / width(j) * F.col(f"w{i}") * F.col(f"w{j}")).alias(f"c{i}{j}") for i, j in _PAIRS))
    return _factored(plain.unionByName(means).unionByName(tanh)).withColumn("det", F.lit(float("inf"))).select(*keys, "start", *_M, *_C, *_L, "det")


def determinant_estimates(rows: DataFrame, keys: list[str], share: float = 0.75) -> DataFrame:
    """(keys, rows, m*, c**): count, location and scatter of each group (``keys``, not null) of vectors x* (whole 1024ths)."""
    groups = cut(rows.groupBy(*keys).agg(F.count("*").alias("rows")), "groups")
    few = groups.limit(GROUPS_BROADCAST + 1).count() <= GROUPS_BROADCAST
    join = lambda left, right: left.join(F.broadcast(right) if few else right, keys)
    inner = chi2_quantile(share, _P)
    consistent = share / chi2_cdf(inner, _P + 2)
    est = cut(_starts(rows, keys, join), "starts")
    own = [*keys, "start"]
    for _ in range(MAX_STEPS):
        step = F.floor(F.log1p(_distance()) * _FINE).cast("long")
        by_step = join(rows, est).withColumn("step", step).groupBy(*own, "step").agg(*_sums())
        over = Window.partitionBy(*own)
        marked = by_step.withColumns({"upto": F.sum("n").over(over.orderBy("step")), "all": F.sum("n").over(over)})
        nearest = marked.where(F.col("upto") - F.col("n") < F.ceil(share * F.col("all")))
        sums = nearest.groupBy(*own).agg(*(F.sum(c).alias(c) for c in ["n", *(f"s{i}" for i in range(_P)), *(f"q{i}{j}" for i, j in _PAIRS)]))
        new = _factored(_moments(sums, consistent)).select(*own, F.struct(*_M, *_C, *_L, "det").alias("new"))
        fell = F.col("new.det") < F.col("old.det") - 1e-9
        both = est.select(*own, F.struct(*_M, *_C, *_L, "det").alias("old")).join(new, own)
        was, est = est, cut(both.select(*own, F.when(fell, F.col("new")).otherwise(F.col("old")).alias("e"), fell.alias("fell")).select(*own, "e.*", "fell"), "estimates")
        dropped(was)
        if not est.where("fell").limit(1).count():
            break
    best = est.groupBy(*keys).agg(F.min(F.struct("det", "start", *_M, *_L)).alias("b")).select(*keys, "b.*")
    near = join(rows, cut(best, "best")).where(_distance() <= chi2_quantile(0.975, _P))
    last = _moments(near.groupBy(*keys).agg(*_sums()), 0.975 / chi2_cdf(chi2_quantile(0.975, _P), _P + 2))
    return cut(_factored(last.join(groups, keys)).select(*keys, "rows", *_M, *_C), "determinants")


def _shrunk(own: DataFrame, wide: DataFrame | Row | None, on: list[str]) -> DataFrame:
    """``own`` (rows, m*, c**) drawn towards the estimates ``wide`` of the groups that hold them, joined by ``on``, or one for all."""
    if isinstance(wide, DataFrame):
        met = own.join(hinted(wide.select(*on, *(F.col(c).alias(f"w{c}") for c in (*_M, *_C))), GROUPS_BROADCAST), on)
    else:
        met = own.withColumns({f"w{c}": F.lit(wide[c] if wide else None).cast("double") for c in (*_M, *_C)})
    w = F.col("rows") / (F.col("rows") + F.lit(float(PRIOR)))
    mix = lambda c: w * F.col(c) + (1 - w) * F.col(f"w{c}")
    apart = lambda i: F.col(f"m{i}") - F.col(f"wm{i}")
    keep = [c for c in own.columns if c not in (*_M, *_C)]
    return met.select(*keep, *(mix(c).alias(c) for c in _M), *((mix(f"c{i}{j}") + w * (1 - w) * apart(i) * apart(j)).alias(f"c{i}{j}") for i, j in _PAIRS), w.alias("own_weight"))


def judge(docs: DataFrame, level: float = LEVEL) -> DataFrame:
    """doc_id, the counts, base_failed, distance, own_weight (that of the group's own estimate), kept."""
    stats = statistics(docs).withColumns({"g0": F.coalesce("lang", F.lit("\0")), "g1": F.coalesce("source", F.lit("\0"))})
    stats = cut(stats.withColumns({f"x{i}": x for i, x in enumerate(vector())}), "statistics")
    every = F.lit("\1")  # stands for all: the three kinds of group are estimated in the same passes
    kinds = F.array(F.struct(every.alias("g0"), every.alias("g1")), F.struct("g0", every.alias("g1")), F.struct("g0", "g1"))
    sound = stats.where("not base_failed").select(F.explode(kinds).alias("g"), *(f"x{i}" for i in range(_P))).select("g.*", *(f"x{i}" for i in range(_P)))
    est = determinant_estimates(sound, ["g0", "g1"])
    corpus = est.where((F.col("g0") == every) & (F.col("g1") == every)).first()
    langs = cut(_shrunk(est.where((F.col("g0") != every) & (F.col("g1") == every)).drop("g1"), corpus, []), "languages")
    last = _factored(_shrunk(est.where(F.col("g1") != every), langs, ["g0"])).select("g0", "g1", "own_weight", *_M, *_L)
    rows = stats.join(hinted(cut(last, "shrunk"), GROUPS_BROADCAST), ["g0", "g1"], "left").withColumn("distance", _distance())
    kept = ~F.col("base_failed") & (F.col("distance") <= chi2_quantile(1 - level, _P))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", "own_weight", F.coalesce(kept, F.lit(False)).alias("kept"))


def verdicts(docs: DataFrame) -> DataFrame:
    """The counts and the verdict."""
    return judge(docs).drop("distance", "own_weight")
