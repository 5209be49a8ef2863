"""Quality rules: per-document counts, then robust multivariate outliers by language and source.

Only DataFrame functions run here.  Documents that pass the base rule give a vector of four transformed
statistics.  Each pair of language and source, each language, and all documents together are groups.  In each, the
minimum-covariance-determinant estimate is approached from two starts by concentration steps - mean and covariance
of the half of the group's rows that lie nearest - until no determinant falls any more.  The start whose covariance
has the smaller determinant counts, and is reweighted: mean and covariance of the rows within the REWEIGHT quantile.
A pair's estimate is then drawn to its language's, and that to the estimate of all, by the weight of PRIOR rows for
the covariance and of one row for the mean: a pair of many documents stands alone, one of few leans on its language,
and nothing switches at any size.  A document is rejected when its squared Mahalanobis distance exceeds the LEVEL
quantile of the chi-square distribution.  "Nearest" is decided on a histogram of log distances, so every aggregate is
a sum of bounded size that is combined before any shuffle, and repeated runs agree.

Edge cases: a null or empty text has no words and fails the base rule; null languages and sources are groups of
their own; a pair without a document that passes the base rule has its language's estimate; ties at the nearest half
are all in; repeated rows count as often as they stand; an empty table gives an empty result; all columns of apply()'s
documents pass through untouched, whatever their names; a very long text is counted whole.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import kept, let, sized

SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
MIN_WORDS, MOST_REPEATED = 50, 50
#: Share of a group's rows from which it is estimated; steps end when no log determinant falls by more, or after so many.
SHARE, SETTLED, STEPS = 0.5, 1e-3, 10
#: Rows that a coarser group counts for in the covariance of a finer one: five for each dimension.
PRIOR = 20
#: Quantiles of the squared distance: of rows that the last estimate takes, and of documents that are kept (of normal ones one in 100,000 goes).
REWEIGHT, LEVEL = 0.975, 0.99999
#: Smallest standard deviation of each statistic: finer differences between documents mean nothing.
FLOORS = (0.03, 0.03, 0.05, 0.15)
#: Histogram steps: of a statistic, and of a log distance.
STAT_STEP, LOG_STEP = 0.005, 0.05
DIM = len(FLOORS)
_V = [f"_v{i}" for i in range(DIM)]
_PAIRS = [(i, j) for i in range(DIM) for j in range(i + 1)]


def chi_square(x: float, dim: int) -> float:
    """Distribution function of chi-square for an even number of degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(dim // 2))


def quantile(level: float, dim: int = DIM) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi_square(mid, dim) < level else (lo, mid)
    return hi


def consistency(share: float) -> float:
    """What the covariance of the nearest share of normal rows is multiplied by to be that of all."""
    return share / chi_square(quantile(share), DIM + 2)


CUT = quantile(LEVEL)


def _repeat_words(words: Column) -> Column:
    """Words in 3-word windows found twice or more, from the array of words."""

    def windows(w: Column) -> Column:
        return F.transform(F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))

    def covered(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        again = let(placed, lambda s: F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))))
        places = F.flatten(F.transform(again, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))
        return F.size(F.array_distinct(places))

    return let(windows(words), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))


def with_counts(docs: DataFrame) -> DataFrame:
    """docs with _n_words, _word_chars, _n_symbols, _n_dup_lines, _n_repeat_words, _base_failed and the statistics."""
    text = F.coalesce(F.col("text"), F.lit(""))

    def of_words(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n"), F.char_length(F.array_join(w, "")).cast("long").alias("chars"), _repeat_words(w).cast("long").alias("again"))

    def of_lines(lines: Column) -> Column:
        return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")

    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = docs.withColumn("_w", let(F.array_remove(F.split(text, SPACE + "+"), ""), of_words))
    out = out.withColumns({
        "_n_words": F.col("_w.n"), "_word_chars": F.col("_w.chars"), "_n_repeat_words": F.col("_w.again"),
        "_n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
        "_n_upper": F.regexp_count(text, F.lit("[A-Z]")).cast("long"),
        "_n_dup_lines": let(lines, of_lines),
    }).drop("_w")
    chars, words = F.col("_word_chars"), F.greatest(F.col("_n_words"), F.lit(1))

    def angle(count: Column, of: Column) -> Column:
        """A share with its variance made even."""
        return F.asin(F.sqrt(F.least((count + 0.375) / (of + 0.75), F.lit(1.0))))

    return out.withColumns({
        "_base_failed": (F.col("_n_words") < MIN_WORDS) | (100 * F.col("_n_repeat_words") > MOST_REPEATED * F.col("_n_words")),
        "_v0": angle(F.col("_n_symbols"), chars),
        "_v1": angle(F.col("_n_upper"), chars),
        "_v2": F.log((chars + 1) / words),
        "_v3": angle(F.col("_n_repeat_words"), words),
    }).drop("_n_upper")


def _named(level: str, *columns: str) -> Column:
    """The name of a row's group; a null is a value."""
    return F.concat_ws("\1", F.lit(level), *(F.coalesce(F.col(c), F.lit("\0")) for c in columns))


def _members(rows: DataFrame) -> DataFrame:
    """The vectors of each group."""
    return rows.where(~F.col("_base_failed")).select(F.explode(F.array(_named("pair", "lang", "source"), _named("lang", "lang"), F.lit("all"))).alias("_group"), *_V)


def _distance(rows: DataFrame) -> DataFrame:
    """rows with _d2, from the columns of the group's estimate: solves the lower triangle step by step."""
    ys = [f"({_V[i]} - m{i}{''.join(f' - l{i}{j} * _y{j}' for j in range(i))}) / l{i}{i} as _y{i}" for i in range(DIM)]
    d2 = " + ".join(f"_y{i} * _y{i}" for i in range(DIM))
    return rows.selectExpr("*", *ys, f"{d2} as _d2").drop(*(f"_y{i}" for i in range(DIM)))


def _triangle(groups: DataFrame) -> DataFrame:
    """The Cholesky factor l of the covariance c, and its log determinant; each entry is made from those before it."""
    out = []
    for i, j in _PAIRS:
        s = f"c{i}{j}" + "".join(f" - l{i}{k} * l{j}{k}" for k in range(j))
        out.append(f"sqrt(greatest({s}, 1e-12)) as l{i}{i}" if i == j else f"({s}) / l{j}{j} as l{i}{j}")
    logdet = " + ".join(f"ln(l{i}{i})" for i in range(DIM))
    return groups.selectExpr("*", *out, f"{logdet} as logdet")


def _ranked(counts: DataFrame, *keys: str) -> DataFrame:
    """counts (keys, bin, c) with the number of the key's rows up to the bin, and in all."""
    w = Window.partitionBy(*keys)
    return counts.withColumns({"upto": F.sum("c").over(w.orderBy("bin")), "total": F.sum("c").over(w)})


def _starts(vectors: DataFrame) -> DataFrame:
    """Two estimates a group, both at the medians: with the quartile scales, and with the floors as scales."""
    long = vectors.select("_group", F.posexplode(F.array(*_V)).alias("stat", "v"))
    counts = long.groupBy("_group", "stat", F.floor(F.col("v") / STAT_STEP).alias("bin")).agg(F.count("*").alias("c"))
    first = lambda q: (F.min(F.when(F.col("upto") >= F.ceil(F.col("total") * q), F.col("bin"))) + 0.5) * STAT_STEP
    each = _ranked(counts, "_group", "stat").groupBy("_group", "stat").agg(first(0.25).alias("lo"), first(0.5).alias("mid"), first(0.75).alias("hi"))
    wide = each.groupBy("_group").agg(*(F.max(F.when(F.col("stat") == i, F.col("mid"))).alias(f"m{i}") for i in range(DIM)), *(F.max(F.when(F.col("stat") == i, (F.col("hi") - F.col("lo")) / 1.349)).alias(f"s{i}") for i in range(DIM)))
    both = wide.withColumn("start", F.explode(F.array(F.lit(0), F.lit(1))))
    scale = [F.when(F.col("start") == 0, F.greatest(f"s{i}", F.lit(FLOORS[i]))).otherwise(F.lit(FLOORS[i])) for i in range(DIM)]
    both = both.withColumns({f"c{i}{j}": scale[i] * scale[i] if i == j else F.lit(0.0) for i, j in _PAIRS})
    return _triangle(both.select("_group", "start", *(f"m{i}" for i in range(DIM)), *(f"c{i}{j}" for i, j in _PAIRS)))


#: Sums of the deviations from the estimate's mean, and of their products.
_SUMS = ["count(*) as c", *(f"sum({v} - m{i}) as s{i}" for i, v in enumerate(_V)), *(f"sum(({_V[i]} - m{i}) * ({_V[j]} - m{j})) as s{i}{j}" for i, j in _PAIRS), *(f"max(m{i}) as m{i}" for i in range(DIM))]


def _moments(sums: DataFrame, keys: list[str], factor: float, *more: str) -> DataFrame:
    """Number, mean and covariance (times the factor) of each key from _SUMS of its parts."""
    whole = sums.groupBy(*keys).agg(*(F.expr(f"sum({x}) as {x}") for x in ["c", *(f"s{i}" for i in range(DIM)), *(f"s{i}{j}" for i, j in _PAIRS)]), *(F.expr(f"max({x}) as {x}") for x in [*(f"m{i}" for i in range(DIM)), *more]))
    cov = [f"{factor} * greatest(s{i}{j} / c - s{i} / c * s{j} / c, {0.0 if i == j else -1e300}) as c{i}{j}" for i, j in _PAIRS]
    return whole.selectExpr(*keys, "c as n", *(f"m{i} + s{i} / c as m{i}" for i in range(DIM)), *cov, *more)


def _floored(groups: DataFrame) -> DataFrame:
    return _triangle(groups.withColumns({f"c{i}{i}": F.col(f"c{i}{i}") + FLOORS[i] ** 2 for i in range(DIM)}))


def _concentrated(vectors: DataFrame, estimates: DataFrame, groups: int) -> DataFrame:
    """One concentration step: mean and covariance of the nearest share, the floors added.  The vectors are summed by
    distance in one pass, and the nearest bins' sums make the estimate."""
    keys = ["_group", "start"]
    far = _distance(vectors.join(estimates, "_group")).withColumn("bin", F.floor(F.log(F.col("_d2") + 1e-6) / LOG_STEP))
    bins = far.groupBy(*keys, "bin").agg(*map(F.expr, _SUMS), F.max("logdet").alias("before"))
    near = _ranked(bins, *keys).where(F.col("upto") - F.col("c") < F.ceil(F.col("total") * SHARE))
    return kept(sized(_floored(_moments(near, keys, consistency(SHARE), "before")), 2 * groups), "estimates")


def settled(vectors: DataFrame) -> DataFrame:
    """_group, n and the reweighted estimate (m, c) of each group of vectors (_group, statistics)."""
    # A few rows a group are few files too: Spark sends them to the vectors, which are not dealt out by group.
    groups = vectors.groupBy("_group").agg(F.lit(1)).count()
    found = kept(sized(_starts(vectors), 2 * groups), "estimates")
    for step in range(STEPS):
        found = _concentrated(vectors, found, groups)
        # The first step's determinants fall from those of the starts, which are of another kind.
        fall = found.agg(F.max(F.col("before") - F.col("logdet"))).first()[0] if step else SETTLED + 1
        if fall is None or fall <= SETTLED:
            break
    cols = [c for c in found.columns if c[0] in "ml" and c != "logdet"]
    best = found.groupBy("_group").agg(F.min_by(F.struct(*cols), F.struct("logdet", "start")).alias("e")).select("_group", "e.*")
    near = _distance(vectors.join(kept(sized(best, groups), "best"), "_group")).where(F.col("_d2") <= quantile(REWEIGHT))
    return kept(sized(_moments(near.groupBy("_group").agg(*map(F.expr, _SUMS)), ["_group"], consistency(REWEIGHT)), groups), "reweighted")


def _leaning(fine: DataFrame, coarse: DataFrame, key: str) -> DataFrame:
    """The estimates of fine groups (key: the coarse group's name) drawn to those of the coarse ones."""
    above = coarse.select(F.col("_group").alias(key), *(F.col(c).alias(f"u{c}") for c in coarse.columns if c[0] in "mc"))
    n = F.coalesce("n", F.lit(0))
    out = fine.join(above, key, "left").withColumns({f"d{i}": F.coalesce(F.col(f"m{i}"), F.col(f"um{i}")) for i in range(DIM)})
    mean = {f"m{i}": (n * F.col(f"d{i}") + F.coalesce(f"um{i}", f"d{i}")) / (n + 1) for i in range(DIM)}
    cov = {f"c{i}{j}": (n * F.coalesce(f"c{i}{j}", F.lit(0.0)) + PRIOR * F.coalesce(f"uc{i}{j}", f"c{i}{j}")) / (n + PRIOR) for i, j in _PAIRS}
    return out.withColumns(mean | cov).drop(key, *(c for c in out.columns if c[0] in "ud"))


def estimates(rows: DataFrame) -> DataFrame:
    """_group, m, l: the estimate for each pair of language and source of with_counts() rows."""
    found = settled(kept(_members(rows), "vectors"))
    pairs = rows.select("lang", "source").distinct().select(_named("pair", "lang", "source").alias("_group"), _named("lang", "lang").alias("_lang"))
    every = found.where("_group = 'all'")
    langs = pairs.select(F.col("_lang").alias("_group")).distinct().join(found, "_group", "left").withColumn("_up", F.lit("all"))
    langs = _leaning(langs, every, "_up")
    own = _floored(_leaning(pairs.join(found, "_group", "left"), langs, "_lang"))
    return kept(sized(own, pairs.count()).select("_group", *(c for c in own.columns if c[0] in "ml" and c not in ("logdet",))), "by_source")


def judged(rows: DataFrame, found: DataFrame) -> DataFrame:
    """with_counts() rows with _d2 and _kept; Spark sends the table of pairs to all tasks where its size allows, else
    joins by key."""
    out = _distance(rows.withColumn("_group", _named("pair", "lang", "source")).join(found, "_group", "left")).drop(*found.columns)
    return out.withColumn("_kept", ~F.col("_base_failed") & F.coalesce(F.col("_d2") <= CUT, F.lit(True)))


def verdicts(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, kept and the squared distance of every row of docs."""
    rows = kept(with_counts(docs.select("doc_id", "text", "lang", "source")).drop("text"), "counts")
    return judged(rows, estimates(rows)).select("doc_id", *(F.col(f"_{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "d2")))


def apply(docs: DataFrame) -> DataFrame:
    """The rows of docs that are kept, as they were.  The counts are worked out twice, which is less than moving the texts."""
    found = estimates(kept(with_counts(docs.select("text", "lang", "source")).drop("text"), "counts"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), "text", "lang", "source")
    return judged(with_counts(rows), found).where("_kept").select("_row.*")
