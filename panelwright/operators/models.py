"""Expanding fits from sufficient statistics, and scoring.

Training data is reduced on the executors to one row of cross-products per
fold by built-in sums; each row enters the first fold whose start its label
precedes, so all expanding folds cost a single scan and a running sum.  Least
squares and ridge are solved on those rows by elimination inside Spark, so a
model table is a DataFrame like any other and planning one runs no job.  Only
the elastic net, whose path needs many passes over a matrix of features by
features, is solved on the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.scale import Scale


def fold_calendar(dates: DataFrame, horizon: int = 1) -> DataFrame:
    """Per calendar date its year and the first yearly fold that may train on it.

    A label of ``horizon`` steps dated at position p is known at p+horizon+1, so
    a fold starting at position k uses positions below k-(horizon+1).
    """
    d = dates.select("date", "ord").distinct().withColumn("year", F.year("date").cast("long"))
    starts = d.groupBy(F.col("year").alias("_y")).agg(F.min("ord").alias("_k"))
    fold = d.join(F.broadcast(starts), F.col("ord") < F.col("_k") - (horizon + 1), "left")
    return fold.groupBy("date", "year").agg(F.min("_y").alias("fold"))


def with_fold(df: DataFrame, scale: Scale, horizon: int = 1) -> DataFrame:
    return df.join(scale.per_date(fold_calendar(df, horizon)), "date")


def available_until(df: DataFrame, cutoff: str) -> DataFrame:
    """Rows whose one-step label is known by the close of ``cutoff``."""
    last = df.where(F.col("date") <= F.lit(cutoff).cast("date")).agg(F.max("ord").alias("_e"))
    return df.join(F.broadcast(last), F.col("ord") <= F.col("_e") - 2).drop("_e")


def statistics(df: DataFrame, features, label: str, by, k: int) -> DataFrame:
    """One row per group: ``by``, ``v``, the sums that fits need.

    ``features`` is a list of columns, which may miss values, or one array
    column of k present values.  ``v`` holds n, sum y, sum y^2, then per
    feature count, sum, sum with y and sum of y where present, then by pairs
    the products, the sums of one where the other is present and the counts.
    """
    by = [by] if isinstance(by, str) else list(by)
    y, whole = F.col(label).cast("double"), isinstance(features, str)
    x = [F.get(F.col(features), F.lit(i)) for i in range(k)] if whole else [F.col(f).cast("double") for f in features]
    slim = df.where(F.col(label).isNotNull())
    for c in by:
        slim = slim.where(F.col(c).isNotNull())
    slim = slim.select(*by, y.alias("_y"), *[v.alias(f"_{i}") for i, v in enumerate(x)])
    x = [F.col(f"_{i}") for i in range(k)]
    one = F.count(F.lit(1)).cast("double")
    sums: dict[str, Column] = {"n": one, "y": F.sum("_y"), "yy": F.sum(F.col("_y") * F.col("_y"))}
    for i in range(k):
        sums |= {f"x{i}": F.sum(x[i]), f"xy{i}": F.sum(x[i] * F.col("_y"))}
        if not whole:
            sums |= {f"c{i}": F.count(x[i]).cast("double"), f"m{i}": F.sum(F.when(x[i].isNotNull(), F.col("_y")))}
        for j in range(i, k):
            sums[f"p{i}_{j}"] = F.sum(x[i] * x[j])
            if not whole and i != j:
                both = x[i].isNotNull() & x[j].isNotNull()
                sums |= {f"c{i}_{j}": F.count(F.when(both, 1)).cast("double"), f"s{i}_{j}": F.sum(F.when(both, x[i])), f"s{j}_{i}": F.sum(F.when(both, x[j]))}
    g = slim.groupBy(*by).agg(*[v.alias(f"_s_{n}") for n, v in sums.items()])
    at = lambda n: F.coalesce(F.col(f"_s_{n}"), F.lit(0.0))
    low = lambda i, j: f"{min(i, j)}_{max(i, j)}"
    counts = [at("n") if whole else at(f"c{i}") for i in range(k)]
    pairs = [(i, j) for i in range(k) for j in range(k)]
    v = [at("n"), at("y"), at("yy"), *counts, *[at(f"x{i}") for i in range(k)], *[at(f"xy{i}") for i in range(k)],
         *[at("y") if whole else at(f"m{i}") for i in range(k)], *[at(f"p{low(i, j)}") for i, j in pairs],
         *[at(f"x{i}") if whole or i == j else at(f"s{i}_{j}") for i, j in pairs],
         *[at("n") if whole else at(f"c{i}") if i == j else at(f"c{low(i, j)}") for i, j in pairs]]
    return g.select(*by, F.array(*v).alias("v"))


def expanding(stats: DataFrame, group: str, by=()) -> DataFrame:
    """Running sums over the groups: each has all earlier ones' rows as well."""
    long = stats.select(*by, group, F.posexplode("v").alias("_pos", "_v"))
    w = Window.partitionBy(*by, "_pos").orderBy(group).rowsBetween(Window.unboundedPreceding, 0)
    long = long.withColumn("_v", F.sum("_v").over(w))
    return long.groupBy(*by, group).agg(F.array_sort(F.collect_list(F.struct("_pos", "_v"))).alias("_p")).select(*by, group, F.col("_p._v").alias("v"))


def standardised(stats: DataFrame, k: int) -> DataFrame:
    """Adds ``n, y_mean, mean, scale, gram, xy`` of mean-imputed, standardised features to sums ``v``."""
    get = lambda i: F.get("v", i if isinstance(i, Column) else F.lit(i))
    part = lambda first: F.slice("v", first + 1, k)
    p, s, c = 3 + 4 * k, 3 + 4 * k + k * k, 3 + 4 * k + 2 * k * k
    seq = F.sequence(F.lit(0), F.lit(k - 1))
    d = stats.withColumns({"n": get(0), "y_mean": get(1) / get(0), "mean": F.zip_with(part(3 + k), part(3), lambda x, m: F.when(m > 0, x / m).otherwise(0.0))})
    mean = lambda i: F.get("mean", i)
    # products of deviations over rows where both are present; imputed rows add nothing
    centred = lambda i, j: (get(p + i * k + j) - mean(j) * get(s + i * k + j) - mean(i) * get(s + j * k + i)
                            + mean(i) * mean(j) * get(c + i * k + j))
    size = lambda i: F.sqrt(F.greatest(centred(i, i), F.lit(0.0)) / F.col("n"))
    d = d.withColumn("scale", F.transform(seq, lambda i: F.when(size(i) < 1e-8, 1.0).otherwise(size(i))))
    scale = lambda i: F.get("scale", i)
    gram = F.transform(seq, lambda i: F.transform(seq, lambda j: centred(i, j) / (scale(i) * scale(j))))
    xy = F.transform(seq, lambda i: (get(3 + 2 * k + i) - mean(i) * get(3 + 3 * k + i)) / scale(i))
    return d.withColumns({"gram": gram, "xy": xy})


def solve_symmetric(matrix: Column, right: Column, k: int) -> Column:
    """Solution and least pivot of a positive semidefinite system, as a struct ``x, pivot``.

    Elimination over the augmented rows; on such a matrix the pivots in given
    order are stable, and a vanishing one shows a lack of rank.
    """
    rows = F.zip_with(matrix, right, lambda row, b: F.concat(row, F.array(b)))
    start = F.struct(rows.alias("m"), F.lit(float("inf")).alias("pivot"))

    def step(state: Column, at: Column) -> Column:
        own = F.get(state["m"], at)
        pivot = F.get(own, at)
        safe = F.when(F.abs(pivot) > 0, pivot)

        def row(r: Column, i: Column) -> Column:
            factor = F.when(i == at, (pivot - 1) / safe).otherwise(F.get(r, at) / safe)
            return F.zip_with(r, own, lambda a, b: a - factor * b)

        return F.struct(F.transform(state["m"], row).alias("m"), F.least(state["pivot"], pivot).alias("pivot"))

    done = F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), start, step)
    return F.struct(F.transform(done["m"], lambda r: F.get(r, F.lit(k))).alias("x"), done["pivot"].alias("pivot"))


#: Least pivot of a correlation matrix that counts as full rank.
RANK = 1e-10


def solve(stats: DataFrame, k: int, penalty: float | Column = 1.0, per_row: bool = False, min_rows: int = 1, full_rank: bool = False) -> DataFrame:
    """Model columns ``rows, intercept, mean, scale, coef`` of ridge (or least squares) beside each row of sums.

    ``per_row`` scales the penalty by the number of rows; ``full_rank`` drops
    groups whose features depend on each other.
    """
    d = standardised(stats.where(F.get("v", F.lit(0)) >= min_rows), k)
    lam = penalty if isinstance(penalty, Column) else F.lit(float(penalty))
    lam = lam * F.col("n") if per_row else lam
    ridge = F.transform("gram", lambda row, i: F.transform(row, lambda g, j: g + F.when(i == j, lam).otherwise(0.0)))
    if full_rank:
        pivot = solve_symmetric(F.transform("gram", lambda row: F.transform(row, lambda g: g / F.col("n"))), F.col("xy"), k)["pivot"]
        d = d.where(pivot > RANK)
    # the means of standardised features vanish, so the intercept is the label mean
    d = d.withColumn("coef", solve_symmetric(ridge, F.col("xy"), k)["x"])
    return d.withColumns({"rows": F.col("n").cast("long"), "intercept": F.col("y_mean")}).drop("v", "n", "y_mean", "gram", "xy")


def fit_ridge(df: DataFrame, features, label: str, group: str, k: int, cumulative: bool = True, min_days: int = 0, **options) -> DataFrame:
    """Model table: one row per fold (or group) ``grp`` with means, scales and coefficients.

    ``min_days`` drops folds with fewer training dates up to them; a date
    belongs to one fold, so folds add up.
    """
    stats = statistics(df, features, label, group, k)
    if cumulative:
        stats = expanding(stats, group)
    if min_days:
        dates = df.where(F.col(label).isNotNull() & F.col(group).isNotNull()).select(group, "date").distinct().groupBy(group).count()
        seen = dates.select(group, F.sum("count").over(Window.orderBy(group)).alias("_days"))  # a row per fold
        stats = stats.join(seen.where(F.col("_days") >= min_days).drop("_days"), group)
    m = solve(stats, k, **options)
    return m.select(F.col(group).cast("string").alias("grp"), "rows", "intercept", "mean", "scale", "coef")


def score_grid(df: DataFrame, models: DataFrame, options: int, features, key: Column, out: str) -> DataFrame:
    """Predictions of every option's model in one pass: an array column ``out`` by ``option`` 0, 1, ...

    ``models`` is a model table with a column ``option``; rows stand beside one
    small row per key with the coefficients of all options.  NULL where a key
    has no model.
    """
    fit = F.struct("option", F.concat(F.array("intercept"), F.zip_with("coef", "scale", lambda c, s: c / s)).alias("c"))
    wide = models.groupBy("grp").agg(F.map_from_entries(F.collect_list(fit)).alias("fits"), F.first("mean").alias("mean"))
    d = df.withColumn("grp", key.cast("string")).join(F.broadcast(wide), "grp", "left")  # a row per fold
    x = F.array(*[F.coalesce(F.col(n), F.get("mean", F.lit(i))) - F.get("mean", F.lit(i)) for i, n in enumerate(features)])
    one = lambda fit: F.aggregate(F.zip_with(F.slice(fit, 2, len(features)), x, lambda c, v: c * v), F.get(fit, F.lit(0)), lambda a, b: a + b)
    return d.withColumn(out, F.array(*[one(F.try_element_at("fits", F.lit(i))) for i in range(options)])).drop("grp", "fits", "mean")


def score_linear(df: DataFrame, models: DataFrame, features, key: Column, out: str, require: bool = False) -> DataFrame:
    """Apply the model of each row's key in a fixed operation order; NULL without model.

    The table has one row per fold or month, hence the broadcast.
    """
    d = df.withColumn("grp", key.cast("string")).join(F.broadcast(models.drop("rows")), "grp", "left")
    names = [features] if isinstance(features, str) else list(features)
    y = F.col("intercept")
    if isinstance(features, str):
        terms = F.zip_with(F.zip_with(features, "mean", lambda x, m: x - m),
                           F.zip_with("coef", "scale", lambda c, s: c / s), lambda z, c: z * c)
        y = y + F.aggregate(terms, F.lit(0.0), lambda s, t: s + t)
    else:
        for i, name in enumerate(names):
            at = lambda c: F.get(c, F.lit(i))  # noqa: B023, E731 - used immediately
            y = y + at("coef") * ((F.coalesce(F.col(name), at("mean")) - at("mean")) / at("scale"))
    if require:
        y = F.when(F.col("intercept").isNull(), F.raise_error(F.lit("no model for this row"))).otherwise(y)
    return d.withColumn(out, y).drop("grp", "intercept", "mean", "scale", "coef")


def coefficient_rows(models: DataFrame, features) -> DataFrame:
    """Long form of a model table: group, feature, mean, scale, coefficient."""
    names = F.array(*[F.lit(f) for f in features])
    return models.select("grp", "rows", "intercept", F.inline(F.arrays_zip(names.alias("feature"), "mean", "scale", "coef")))


def univariate_fits(df: DataFrame, x: str, y: str, penalty: float = 1.0, by=(), min_dates: int = 60) -> DataFrame:
    """Expanding one-feature ridge per fold in closed form (needs columns ``fold`` and ``date``).

    Yearly sums are accumulated over folds; the day count uses per-fold distinct
    dates, which belong to exactly one fold.
    """
    by = list(by)
    ok = df.where(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col("fold").isNotNull())
    per_date = ok.groupBy(*by, "fold", "date").agg(
        F.count("*").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"),
        F.sum(F.col(x) * F.col(x)).alias("sxx"), F.sum(F.col(x) * F.col(y)).alias("sxy"))
    sums = ("n", "sx", "sy", "sxx", "sxy")
    s = per_date.groupBy(*by, "fold").agg(F.count("*").alias("days"), *[F.sum(c).alias(c) for c in sums])
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy("fold").rowsBetween(Window.unboundedPreceding, 0)
    s = s.select(*by, "fold", *[F.sum(c).over(w).alias(c) for c in ("days", *sums)])
    n, mean = F.col("n"), F.col("sx") / F.col("n")
    var = F.col("sxx") / n - mean * mean
    sd = F.sqrt(F.greatest(var, F.lit(0.0)))
    scale = F.when(sd < 1e-8, 1.0).otherwise(sd)
    coef = ((F.col("sxy") - mean * F.col("sy")) / scale) / (n * F.greatest(var, F.lit(0.0)) / (scale * scale) + penalty)
    return s.where(F.col("days") >= min_dates).select(
        *by, "fold", "n", "days", mean.alias("mean"), scale.alias("scale"), coef.alias("coef"), (F.col("sy") / n).alias("intercept"))


def label_families(df: DataFrame, m: str, rank: str, calibration: str, raw: str) -> dict[str, Column]:
    """Raw label, centered rank, residual of the calibration, agreement with momentum."""
    agree = (F.col(m) * F.col(rank) > 0).cast("double")
    return {"raw": F.col(raw), "rank": F.col(rank), "residual": F.col(rank) - F.col(calibration),
            "agreement": F.when(F.round(F.abs(m), 12) > 0.1, agree)}


def soft_threshold(v: float, t: float) -> float:
    return v - t if v > t else v + t if v < -t else 0.0


def descend(gram: np.ndarray, xy: np.ndarray, l1: float, l2: float, start: np.ndarray, tol: float = 1e-12, max_iter: int = 100_000) -> tuple[np.ndarray, int]:
    """Cyclic coordinate descent on covariances (per row): coefficients and passes until none moves by more than ``tol``."""
    beta = start.copy()
    rest = xy - gram @ beta
    for turn in range(1, max_iter + 1):
        moved = 0.0
        for j in range(len(beta)):
            new = soft_threshold(rest[j] + gram[j, j] * beta[j], l1) / (gram[j, j] + l2) if gram[j, j] + l2 > 0 else 0.0
            if (step := new - beta[j]) != 0.0:
                rest -= gram[:, j] * step
                beta[j], moved = new, max(moved, abs(step))
        if moved <= tol:
            return beta, turn
    raise RuntimeError("coordinate descent did not settle")


NET_DDL = ("grp string, rows long, intercept double, mean array<double>, scale array<double>, coef array<double>, "
           "strength double, alpha double, alpha_max double, nonzero int, iterations int")


def elastic_net_path(df: DataFrame, features, label: str, group: str, k: int, strengths, ratio: float = 0.5, relative: bool = True,
                     cumulative: bool = True, min_rows: int = 2) -> DataFrame:
    """Elastic nets of every fold and strength, from one scan.

    A strength is relative to the fold's all-zero boundary ``alpha_max`` or,
    with ``relative`` off, the penalty itself.  The path runs from the strongest
    penalty down and each fit starts from the one before, that of the last
    fold for the first.  Where no feature covaries with the label the model is
    null: zero coefficients, the label mean.  Groups of fewer than ``min_rows``
    rows have no model; no training rows, no rows.
    """
    if relative and not all(0 < s < 1 for s in strengths) or not all(s > 0 for s in strengths):
        raise ValueError("strengths are positive, and relative ones below the all-zero boundary")
    stats = statistics(df, features, label, group, k)
    stats = standardised(expanding(stats, group) if cumulative else stats, k).where(F.col("n") >= min_rows)
    out, start = [], np.zeros(k)
    for r in stats.orderBy(group).collect():  # one row per fold, features by features numbers each
        gram, xy = np.array(r.gram) / r.n, np.array(r.xy) / r.n
        alpha_max = float(np.abs(xy).max() / ratio)
        beta = start
        for i, s in enumerate(sorted(strengths, reverse=True)):
            alpha, turns = s * alpha_max if relative else s, 0
            if alpha_max > 0:
                beta, turns = descend(gram, xy, alpha * ratio, alpha * (1 - ratio), beta)
            else:
                beta = np.zeros(k)
            if i == 0:
                start = beta
            out.append((str(r[group]), int(r.n), r.y_mean, r.mean, r.scale, beta.tolist(), float(s), float(alpha), alpha_max, int(np.count_nonzero(beta)), turns))
    return df.sparkSession.createDataFrame(out, NET_DDL)


def coefficient_stability(coefs: DataFrame, by=("feature",)) -> DataFrame:
    """Per feature: fits, non-zero fits, sign agreement and size over folds."""
    s = F.signum("coef")
    return coefs.groupBy(*by).agg(
        F.count("*").alias("fits"), F.count(F.when(F.abs("coef") > 0, 1)).alias("nonzero"),
        (F.abs(F.sum(s)) / F.count("*")).alias("sign_agreement"),
        F.sum(F.abs("coef")).alias("l1"), F.sqrt(F.sum(F.col("coef") * F.col("coef"))).alias("l2"))


def fold_pair_correlation(coefs: DataFrame, fold: str = "fold") -> DataFrame:
    """Correlation of the coefficient vectors of each pair of folds (feature-sized join)."""
    from panelwright.operators.aggregates import correlation

    a = coefs.select("feature", F.col(fold).alias("fold_a"), F.col("coef").alias("a"))
    b = coefs.select("feature", F.col(fold).alias("fold_b"), F.col("coef").alias("b"))
    return a.join(b, "feature").where("fold_a < fold_b").groupBy("fold_a", "fold_b").agg(
        correlation("a", "b").alias("corr"), F.count("*").alias("features"))


def block_contributions(df: DataFrame, models: DataFrame, features, blocks: dict[str, list[str]], key: Column) -> DataFrame:
    """Parts of a linear score: ``part_<block>`` sums its features' terms, and with the intercept all parts add up to the score."""
    at = {f: i for i, f in enumerate(features)}
    if sorted(f for own in blocks.values() for f in own) != sorted(features):
        raise ValueError("blocks must part the features")
    d = df.withColumn("grp", key.cast("string")).join(F.broadcast(models.drop("rows")), "grp", "left")  # a row per fold
    get = lambda c, i: F.get(c, F.lit(i))
    term = lambda f: get("coef", at[f]) * ((F.coalesce(F.col(f), get("mean", at[f])) - get("mean", at[f])) / get("scale", at[f]))
    for name, own in blocks.items():
        d = d.withColumn(f"part_{name}", sum((term(f) for f in own), F.lit(0.0)))
    return d.drop("grp", "mean", "scale", "coef")


def grid_choice(df: DataFrame, scores: str, label: str, options: int, xs) -> DataFrame:
    """Per option of an array of scores: ``rows``, ``days``, mean daily rank correlation and mean daily turnover of its book.

    The array is unpivoted once, so all options are ranked in the same pass of
    each date; books hold every scored row, correlations those with a label.
    Scores are rounded like all scores, so that equal ones tie.
    """
    from panelwright.functions.scalar import rounded
    from panelwright.operators import aggregates as agg

    long = df.select("date", "code", F.col(label).alias("_y"), F.posexplode(scores).alias("option", "_p")).where("_p is not null").withColumn("_p", rounded("_p", 10))
    both = long.where("_y is not null")
    for c in ("_p", "_y"):
        both = xs.average_rank(both, c, f"_r{c}", ("date", "option"))
    daily = both.groupBy("option", "date").agg(agg.correlation("_r_p", "_r_y").alias("ic"), F.count(F.lit(1)).alias("n"))
    quality = daily.groupBy("option").agg(F.sum("n").alias("rows"), F.count("ic").alias("days"), F.avg("ic").alias("mean_rankic"))
    book = xs.quintile(long, "_p", by=("date", "option")).where("w is not null")
    before = F.lag("w").over(Window.partitionBy("option", "code").orderBy("date"))
    moved = book.withColumn("_d", F.coalesce(F.abs(F.col("w") - before), F.lit(0.0))).groupBy("option", "date").agg(F.sum("_d").alias("t"))
    return quality.join(moved.groupBy("option").agg(F.avg("t").alias("turnover")), "option")
