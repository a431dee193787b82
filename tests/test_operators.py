"""Operators against brute force on small fixtures."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelwright.operators import account, asof, audit, disclosures, evaluation, features, keys, models, signals
from panelwright.operators import timeseries as ts
from panelwright.operators.xsection import CrossSection, groups_from_rank
from panelwright.scale import Scale

PLAIN, WIDE = CrossSection(Scale(100, 100)), CrossSection(Scale(100, 100, rows_per_task=1))


def panel_frame(dates=60, codes=7, seed=1, drop=0.1, ties=False):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(dates):
        for c in range(codes):
            if rng.random() < drop and 0 < i:
                continue
            x = float(rng.integers(0, 4)) if ties else float(rng.normal())
            rows.append((dt.date(2020, 1, 1) + dt.timedelta(days=i), f"c{c}", i, 0, None if rng.random() < 0.1 else x, float(rng.normal())))
    return pd.DataFrame(rows, columns=["date", "code", "ord", "seg", "x", "y"])


def to_spark(spark, pdf):
    schema = "date date, code string, ord int, seg int, x double, y double"
    rows = [tuple(None if isinstance(v, float) and math.isnan(v) else v for v in r) for r in pdf.itertuples(index=False, name=None)]
    return spark.createDataFrame(rows, schema)


def back(df):
    return df.toPandas().sort_values(["date", "code"]).reset_index(drop=True)


@pytest.mark.parametrize("alpha", [0.01, 0.15, 0.25, 0.5, 0.9999, 1.0])
def test_ewma_equals_recurrence_over_many_blocks(spark, alpha):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"date": pd.date_range("2000-01-01", periods=700).date, "code": "a", "ord": range(700), "seg": 0,
                        "x": rng.normal(size=700), "y": 0.0})
    got = back(ts.ewma(to_spark(spark, pdf), "x", alpha, "s"))["s"].to_numpy()
    want = pdf.x.ewm(alpha=alpha, adjust=False).mean().to_numpy()
    assert np.abs(got - want).max() < 1e-12


def test_decayed_state_is_not_cut_to_zero(spark):
    pdf = pd.DataFrame({"date": pd.date_range("2000-01-01", periods=900).date, "code": "a", "ord": range(900), "seg": 0,
                        "x": [1.0] + [0.0] * 899, "y": 0.0})
    got = back(ts.ewma(to_spark(spark, pdf), "x", 0.5, "s"))["s"].to_numpy()
    assert (got > 0).all() and np.allclose(got, pdf.x.ewm(alpha=0.5, adjust=False).mean(), rtol=1e-9, atol=0)


def test_ewma_with_gaps_equals_pandas(spark):
    pdf = panel_frame(80, 3, drop=0)
    d = to_spark(spark, pdf).withColumn("ok", F.col("x").isNotNull())
    got = back(ts.ewma_with_gaps(d, "x", "ok", 0.25, "s"))
    want = pdf.sort_values(["code", "date"]).groupby("code").x.transform(lambda v: v.ewm(alpha=0.25, adjust=False).mean())
    want = want.where(pdf.x.notna(), 0.0).reindex(pdf.sort_values(["date", "code"]).index)
    assert np.abs(got.s.to_numpy() - want.to_numpy()).max() < 1e-12


@pytest.mark.parametrize("xs", [PLAIN, WIDE], ids=["plain", "split"])
def test_ranks_equal_pandas(spark, xs):
    pdf = panel_frame(ties=True)
    d = xs.pct_rank(xs.first_rank(to_spark(spark, pdf), "x", "first"), "x", "pct")
    d = xs.median(xs.zscore(d, "x", "z"), "x", "med")
    got = back(d)
    pdf = pdf.sort_values(["date", "code"]).reset_index(drop=True)
    g = pdf.groupby("date").x
    assert np.allclose(got.pct, g.rank(pct=True), equal_nan=True)
    assert (got["first"][pdf.x.notna()] == g.rank(method="first")[pdf.x.notna()]).all()
    assert np.allclose(got.med, g.transform("median"), equal_nan=True)
    z = ((pdf.x - g.transform("mean")) / g.transform("std").replace(0, np.nan)).clip(-3, 3)
    assert np.allclose(got.z, z, equal_nan=True)


def test_quintile_equals_quantile_cut(spark):
    rows = [(n, r) for n in [*range(5, 60), 498] for r in range(1, n + 1)]
    got = groups_from_rank(spark.createDataFrame(rows, "n int, r int"), "r", "n").toPandas()
    for n, part in got.groupby("n"):
        part = part.sort_values("r")
        assert (part.q.to_numpy() == pd.qcut(part.r, 5, labels=False).to_numpy()).all()
        assert abs(part.w.sum()) < 1e-9 or n % 5


def test_segments_restart_only_beyond_the_gap(spark):
    days = [0, 1, 21, 42, 43]  # a gap of 20 carries, 21 restarts
    rows = [(dt.date(2020, 1, 1) + dt.timedelta(days=i), "a", i) for i in days]
    got = keys.with_segment(spark.createDataFrame(rows, "date date, code string, ord int"), 20).orderBy("ord").toPandas()
    assert got.seg.tolist() == [0, 0, 0, 1, 1]


@pytest.mark.parametrize("strict", [False, True])
def test_asof_equals_merge_asof(spark, strict):
    rng = np.random.default_rng(5)
    left = panel_frame(40, 4)
    day = lambda k: dt.date(2020, 1, 1) + dt.timedelta(days=int(k))
    ev = pd.DataFrame([(f"c{rng.integers(4)}", day(rng.integers(40)), i, float(i)) for i in range(60)], columns=["code", "day", "number", "v"])
    right = asof.last_per_day(spark.createDataFrame(ev, "code string, day date, number long, v double"), ["code"], "day", "number", ["v"])
    got = back(asof.asof(to_spark(spark, left), right, ["code"], "date", "day", ["v"], strict=strict))
    ev = ev.sort_values("number").groupby(["code", "day"], as_index=False).last()
    a, b = left.copy(), ev.copy()
    a["date"], b["day"] = pd.to_datetime(a.date), pd.to_datetime(b.day)
    want = pd.merge_asof(a.sort_values("date"), b.sort_values("day"), left_on="date", right_on="day", by="code", allow_exact_matches=not strict)
    want = want.sort_values(["date", "code"]).v.to_numpy()
    assert np.allclose(got.v, want, equal_nan=True)


def test_boxes_equal_brute_force(spark):
    rng = np.random.default_rng(7)
    n = 90
    close = 100 + np.cumsum(rng.normal(scale=0.5, size=n))
    high, low = close + rng.random(n), close - rng.random(n)
    high[30] = np.nan
    rows = [(dt.date(2020, 1, 1) + dt.timedelta(days=i), "a", i, 0, None if math.isnan(high[i]) else float(high[i]), float(low[i]), float(close[i]), 1.0) for i in range(n)]
    d = spark.createDataFrame(rows, "date date, code string, ord int, seg int, s_high double, s_low double, s_close double, factor double")
    got = back(features.boxes(features.true_range(d, 5), longest=40, step=5))
    prev = np.r_[np.nan, close[:-1]]
    tr = np.where(np.isnan(high) | np.isnan(prev), np.nan, np.fmax(high - low, np.fmax(abs(high - prev), abs(low - prev))))
    for t in range(n):
        want, atr = 0, tr[t - 5:t].mean() if t >= 5 else np.nan
        for w in range(5, 45, 5):
            if t >= w and not np.isnan(high[t - w:t]).any() and (high[t - w:t].max() - low[t - w:t].min()) / atr < 3:
                want = w
        assert got.box_duration[t] == want, t


def _reports(seed=11, n=120):
    rng, rows = np.random.default_rng(seed), []
    for i in range(n):
        day = dt.date(2015, 2, 1) + dt.timedelta(days=int(rng.integers(0, 1500)))
        q = int(rng.integers(1, 5))
        year = day.year - int(rng.integers(0, 2))
        end = {1: dt.date(year, 3, 31), 2: dt.date(year, 6, 30), 3: dt.date(year, 9, 30), 4: dt.date(year, 12, 31)}[q]
        period = ["1Q", "2Q", "3Q", "FY"][q - 1]
        kind = "Forecast_" if rng.random() < 0.1 else "FinancialStatements_"
        rows.append((f"c{i % 2}", day, i, period + kind + ("JP" if rng.random() < 0.5 else "IFRS"), period, dt.date(year, 1, 1), end,
                     float(rng.normal()) if rng.random() > 0.15 else None, 100.0))
    return pd.DataFrame(rows, columns=["code", "disclosed", "number", "document", "period", "start", "end", "cfo", "assets"])


def test_report_state_equals_version_store(spark):
    """A plain dictionary of versions per code, replayed report by report."""
    fins = _reports()
    days = pd.date_range("2015-01-05", "2019-12-30", freq="7D").date
    pan = pd.DataFrame([(d, f"c{c}", i, 0) for i, d in enumerate(days) for c in range(2)], columns=["date", "code", "ord", "seg"])
    sp = spark.createDataFrame([tuple(None if isinstance(v, float) and math.isnan(v) else v for v in r) for r in fins.itertuples(index=False, name=None)],
                               "code string, disclosed date, number long, document string, period string, start date, end date, cfo double, assets double")
    got = back(disclosures.report_state(spark.createDataFrame(pan, "date date, code string, ord int, seg int"),
                                        disclosures.report_versions(sp), F.col("cfo") / F.col("assets"), "cfo"))
    by = {(r.date, r.code): r for r in got.itertuples()}
    band = disclosures.PERIOD_DAYS
    for code in ("c0", "c1"):
        hist = fins[fins.code == code].sort_values(["disclosed", "number"])
        for d in days:
            store = {}
            for x in hist[hist.disclosed < d].itertuples():
                lo, hi = band[x.period]
                if "FinancialStatements_" not in x.document or not lo <= (x.end - x.start).days <= hi or pd.isna(x.cfo):
                    continue
                store[(x.start, x.end, x.period, x.document.split("Statements_")[1])] = (x.end, x.disclosed, x.period, x.cfo / x.assets)
            row = by[(d, code)]
            if not store:
                assert pd.isna(row.cfo)
                continue
            key, cur = max(store.items(), key=lambda kv: kv[1][:3])
            year_ago = lambda v: v.replace(year=v.year - 1)
            old = [v for k, v in store.items() if k[2:] == key[2:] and abs((k[0] - year_ago(key[0])).days) <= 7 and abs((k[1] - year_ago(key[1])).days) <= 7]
            live = (d - cur[1]).days <= 450
            assert (abs(row.cfo - cur[3]) < 1e-12) if live else pd.isna(row.cfo)
            if live and old:
                assert abs(row.cfo_yoy - (cur[3] - max(old, key=lambda v: v[:2])[3])) < 1e-12
            else:
                assert pd.isna(row.cfo_yoy)


def test_expanding_ridge_equals_dense_solution(spark):
    rng = np.random.default_rng(13)
    x, g = rng.normal(size=(300, 3)), rng.integers(2001, 2004, 300)
    x[rng.random(x.shape) < 0.1] = np.nan
    y = rng.normal(size=300)
    rows = [(int(a), float(b), *[None if math.isnan(v) else float(v) for v in r]) for a, b, r in zip(g, y, x)]
    d = spark.createDataFrame(rows, "fold int, y double, a double, b double, c double").repartition(5)
    got = {m.grp: m for m in models.fit_ridge(d, ["a", "b", "c"], "y", "fold", 3).collect()}
    for fold in (2001, 2002, 2003):
        xx, yy = x[g <= fold], y[g <= fold]
        mean = np.nanmean(xx, 0)
        f = np.where(np.isnan(xx), mean, xx)
        z = np.column_stack([np.ones(len(f)), (f - mean) / f.std(0)])
        pen = np.diag([0.0, 1, 1, 1])
        want = np.linalg.solve(z.T @ z + pen, z.T @ yy)
        m = got[str(fold)]
        assert np.allclose([m.intercept, *m.coef], want, atol=1e-10)
    parts = models.block_contributions(d.withColumn("year", F.col("fold")), models.fit_ridge(d, ["a", "b", "c"], "y", "fold", 3), ["a", "b", "c"], {"p": ["a", "c"], "q": ["b"]}, F.col("year"))
    whole = models.score_linear(d.withColumn("year", F.col("fold")), models.fit_ridge(d, ["a", "b", "c"], "y", "fold", 3), ["a", "b", "c"], F.col("year"), "score")
    added = sorted(r.intercept + r.part_p + r.part_q for r in parts.collect())
    assert np.allclose(added, sorted(r.score for r in whole.collect()), atol=1e-9)


def test_least_squares_without_full_rank_has_no_model(spark):
    rng = np.random.default_rng(14)
    x = rng.normal(size=(60, 2))
    rows = [("good", float(a), float(b), float(a - b)) for a, b in x] + [("bad", float(a), float(2 * a), float(a)) for a, _ in x] + [("few", 1.0, 2.0, 3.0)]
    d = spark.createDataFrame(rows, "month string, a double, b double, y double")
    got = models.fit_ridge(d, ["a", "b"], "y", "month", 2, penalty=0.0, cumulative=False, min_rows=6, full_rank=True).collect()
    assert [m.grp for m in got] == ["good"]
    assert np.allclose(np.array(got[0].coef) / np.array(got[0].scale), [1, -1], atol=1e-10)


@pytest.mark.parametrize("relative", [True, False])
def test_elastic_net_paths_meet_their_optimality_conditions(spark, relative):
    rng = np.random.default_rng(17)
    x, g = rng.normal(size=(400, 4)), rng.integers(2000, 2003, 400)
    y = x @ np.array([1.0, 0.0, -0.5, 0.0]) + rng.normal(size=400)
    d = spark.createDataFrame([([float(v) for v in r], float(t), int(f)) for r, t, f in zip(x, y, g)], "v array<double>, y double, fold int")
    strengths = (0.2, 0.5, 0.9)
    got = models.elastic_net_path(d, "v", "y", "fold", 4, strengths, 0.5, relative).collect()
    assert sorted((m.grp, m.strength) for m in got) == sorted((str(f), s) for f in (2000, 2001, 2002) for s in strengths)
    for m in got:
        own = g <= int(m.grp)
        z, t, b = (x[own] - x[own].mean(0)) / x[own].std(0), y[own], np.array(m.coef)
        assert np.isclose(m.alpha_max, np.abs(z.T @ (t - t.mean())).max() / len(t) / 0.5) and np.isclose(m.alpha, m.strength * m.alpha_max if relative else m.strength)
        grad = z.T @ (t - t.mean() - z @ b) / len(t) - m.alpha * 0.5 * b
        active = np.abs(b) > 0
        assert m.nonzero == active.sum() and np.allclose(grad[active], m.alpha * 0.5 * np.sign(b[active]), atol=1e-9)
        assert (np.abs(grad[~active]) <= m.alpha * 0.5 + 1e-9).all()


def test_elastic_net_without_rows_or_covariance(spark):
    d = spark.createDataFrame([([float(k % 2)], 1.0, 2000) for k in range(20)], "v array<double>, y double, fold int")
    assert models.elastic_net_path(d.where("false"), "v", "y", "fold", 1, (0.5,)).count() == 0
    null = models.elastic_net_path(d, "v", "y", "fold", 1, (0.5,)).first()
    assert (null.alpha_max, null.coef, null.intercept, null.nonzero) == (0.0, [0.0], 1.0, 0)
    with pytest.raises(ValueError):
        models.elastic_net_path(d, "v", "y", "fold", 1, (1.0,))


def test_deflated_sharpe_formula(spark):
    from statistics import NormalDist

    v = np.random.default_rng(19).normal(0.05, 1, 300)
    d = spark.createDataFrame([(float(x),) for x in v], "net double")
    got = evaluation.deflated_sharpe(d, "net", 0.001, 20).first()
    n, s = len(v), pd.Series(v)
    sr, nd, gam = v.mean() / v.std(ddof=1), NormalDist(), 0.5772156649015329
    best = math.sqrt(0.001) * ((1 - gam) * nd.inv_cdf(1 - 1 / 20) + gam * nd.inv_cdf(1 - 1 / (20 * math.e)))
    want = nd.cdf((sr - best) * math.sqrt(n - 1) / math.sqrt(1 - s.skew() * sr + (s.kurt() + 3 - 1) * sr * sr / 4))
    assert abs(got.dsr - want) < 1e-9


@pytest.mark.parametrize("xs", [PLAIN, WIDE], ids=["plain", "split"])
def test_stitching_keeps_longs_and_is_a_permutation(spark, xs):
    pdf = panel_frame(5, 23, drop=0, ties=True).fillna({"x": 0.0})
    d = signals.stitch(to_spark(spark, pdf), xs, "y", "x", "s")
    for _, part in d.toPandas().groupby("date"):
        n = len(part)
        assert sorted(np.rint(part.s * (n - 1)).astype(int)) == list(range(n))
        rank = part.y.rank(method="first")
        top = rank > math.floor(0.6 * (n - 1) + 1)
        assert np.allclose(part.s[top], (rank[top] - 1) / (n - 1))
        k = math.floor(0.4 * (n - 1) + 1)
        shorts = part[part.s * (n - 1) < k - 0.5]
        assert shorts.x.min() >= part[~top & ~part.index.isin(shorts.index)].x.max()


def test_legs_add_up_and_first_row_pays_full_weight(spark):
    pdf = panel_frame(12, 6, drop=0.2)
    d = PLAIN.quintile(to_spark(spark, pdf), "y").where("w is not null").withColumnRenamed("x", "target")
    d = d.withColumn("dw", account.weight_change("w"))
    legs = account.leg_account(account.leg_weights(d)).toPandas().sort_values("date")
    net = account.row_pl(d).groupBy("date").agg(account.zero(F.sum("net")).alias("net")).toPandas().sort_values("date")
    assert np.allclose(legs.long_net + legs.short_net, net.net, atol=1e-12)


def test_causality_audit_detects_a_leak(spark):
    inputs = to_spark(spark, panel_frame(40, 5, drop=0))
    clean = lambda d: d.withColumn("f", ts.roll_sum("y", 5, skip=1))
    leak = lambda d: d.withColumn("f", F.sum("y").over(ts.history().rowsBetween(0, 3)))
    assert audit.future_mutation(inputs, clean, "2020-01-20", ["f"]).agg(F.sum("changed")).first()[0] == 0
    assert audit.future_mutation(inputs, leak, "2020-01-20", ["f"]).agg(F.sum("changed")).first()[0] > 0
    assert audit.truncation(inputs, leak, "2020-01-20", ["f"]).first().changed > 0


def test_prediction_contract_rejects_gaps_and_duplicates(spark):
    labels = to_spark(spark, panel_frame(4, 3, drop=0)).select("date", "code", "y")
    full = labels.withColumnRenamed("y", "score")
    assert account.align_prediction(labels, full).count() == 12
    with pytest.raises(ValueError):
        account.align_prediction(labels, full.limit(5))
    with pytest.raises(ValueError):
        account.align_prediction(labels, full.union(full))


def test_guarded_read_and_manifest(spark, tmp_path):
    from panelwright.sources import io

    with pytest.raises(PermissionError):
        io.read_table(spark, str(tmp_path), "secrets")
    d = spark.range(10).select(F.col("id").cast("string").alias("id"), (F.col("id") % 2).cast("string").alias("part"))
    good, bad = io.content_digest(d, ["id"], ["part"]), io.content_digest(d.where("id <> '3'"), ["id"], ["part"])
    flags = {r.part: r.matches for r in io.check_manifest(good, bad, "part").collect()}
    assert flags == {"0": True, "1": False}
    with pytest.raises(ValueError):
        io.union_history(d, d.limit(1), ["id"])


def plain_forest(x, y, cuts, rounds, rate, l2, min_leaf):
    """Boosted trees of depth two by trying every edge and both sides for missing values on the rows."""
    bins = np.column_stack([np.where(np.isnan(c), 0, np.searchsorted(e, np.nan_to_num(c), side="right") + 1) for c, e in zip(x.T, cuts)])
    pred, base, trees = np.full(len(y), y.mean()), y.mean(), []

    def split(rows, rest):
        n, g, best = len(rows), rest[rows].sum(), None
        for f in range(x.shape[1]):
            for missing in (False, True):
                if missing and not (bins[rows, f] == 0).any():
                    continue
                for e in range(len(cuts[f]) + 1):
                    left = (bins[rows, f] > 0) & (bins[rows, f] <= e + 1) | missing & (bins[rows, f] == 0)
                    k = left.sum()
                    if min(k, n - k) < min_leaf:
                        continue
                    a = rest[rows][left].sum()
                    gain = a * a / (k + l2) + (g - a) ** 2 / (n - k + l2) - g * g / (n + l2)
                    if gain > 1e-12 and (best is None or gain > best[0] * (1 + 1e-9)):
                        best = gain, f, e, missing, left
        return best

    for _ in range(rounds):
        rest, rows = y - pred, np.arange(len(y))
        root = split(rows, rest)
        if root is None:
            break
        gains = [(root[1], root[0])]
        for part in (rows[root[4]], rows[~root[4]]):
            child = split(part, rest)
            for leaf in [part] if child is None else [part[child[4]], part[~child[4]]]:
                pred[leaf] += rate * rest[leaf].sum() / (len(leaf) + l2)
            if child is not None:
                gains.append((child[1], child[0]))
        trees += gains
    return pred, base, trees


def test_forests_of_all_folds_equal_brute_force(spark):
    from panelwright.operators import boosting as B

    rng = np.random.default_rng(3)
    n = 900
    x = np.round(rng.normal(size=(n, 3)), 2)
    x[rng.random(x.shape) < 0.15] = np.nan
    z = np.nan_to_num(x, nan=0.7)
    y = z[:, 0] * (z[:, 1] > 0) - 0.5 * (np.isnan(x[:, 2])) + 0.2 * rng.normal(size=n)
    year, fold = np.repeat([2000, 2001, 2002], 300), np.repeat([2001, 2002, 2003], 300)
    rows = [(int(a), int(b), *[None if math.isnan(v) else float(v) for v in r], float(t), i) for i, (a, b, r, t) in enumerate(zip(year, fold, x, y))]
    df = spark.createDataFrame(rows, "year int, fold int, a double, b double, c double, y double, i int").repartition(4)
    s = B.Settings(rounds=12, rate=0.3, l2=10.0, min_leaf=20, bins=8)
    forests, cuts = B.fit(df, ["a", "b", "c"], "y", min_rows=200, settings=s)
    assert [f.grp for f in forests] == ["2001", "2002"]
    got = {r.i: r.prediction for r in B.score(df.withColumn("g", F.lit(2002)), forests, cuts, ["a", "b", "c"], F.col("g")).collect()}
    assert all(r.prediction is None for r in B.score(df.where("year = 2000"), forests, cuts, ["a", "b", "c"], F.col("year")).collect())
    own = fold <= 2002
    pred, base, gains = plain_forest(x[own], y[own], cuts, 12, 0.3, 10.0, 20)
    assert np.isclose(base, forests[1].base) and np.allclose([got[i] for i in np.flatnonzero(own)], pred, atol=1e-9)
    table = {(r.grp, r.feature): r for r in B.gain_importance(B.tree_table(spark, forests, ["a", "b", "c"])).collect()}
    for k, f in enumerate("abc"):
        want = [g for j, g in gains if j == k]
        assert ("2002", f) in table if want else ("2002", f) not in table
        if want:
            assert table["2002", f].splits == len(want) and np.isclose(table["2002", f].gain, sum(want))
    assert abs(sum(r.share for (g, _), r in table.items() if g == "2001") - 1) < 1e-12


def test_forests_need_enough_rows_and_survive_constant_features(spark):
    from panelwright.operators import boosting as B

    df = spark.createDataFrame([(2001, 2001, 1.0, None, float(k % 3)) for k in range(50)], "year int, fold int, a double, b double, y double")
    assert B.fit(df, ["a", "b"], "y", min_rows=51) == ([], [])
    forests, cuts = B.fit(df, ["a", "b"], "y", min_rows=50, settings=B.Settings(rounds=3, min_leaf=5))
    got = B.score(df, forests, cuts, ["a", "b"], F.col("year")).collect()
    assert len(forests) == 1 and {round(r.prediction, 12) for r in got} == {round(sum(k % 3 for k in range(50)) / 50, 12)}
    assert B.fit(df.where("false"), ["a", "b"], "y") == ([], [])


def test_scan_of_affine_maps_equals_the_recurrence(spark):
    rng = np.random.default_rng(23)
    n = 3000
    a = np.where(rng.random(n) < 0.01, 1e-200, np.where(rng.random(n) < 0.3, 1.0, rng.uniform(0.2, 0.99, n)))
    a[[0, 1500]] = 0.0
    b = np.where(np.arange(n) % 900 > 300, 0.0, rng.normal(size=n))
    pdf = pd.DataFrame({"date": pd.date_range("1990-01-01", periods=n).date, "code": "a", "ord": range(n), "seg": 0, "x": a, "y": b})
    got = back(ts.affine_scan(to_spark(spark, pdf), "x", "y", "s"))["s"].to_numpy()
    want, y = [], 0.0
    for p, q in zip(a, b):
        y = p * y + q
        want.append(y)
    assert np.allclose(got, want, rtol=1e-9, atol=0)


def test_smoothing_with_gaps_is_linear_in_a_long_history(spark):
    import time

    n = 16_000
    rng = np.random.default_rng(29)
    x = rng.normal(size=n)
    ok = (rng.random(n) > 0.2) & ~((np.arange(n) > 5000) & (np.arange(n) < 9000))
    pdf = pd.DataFrame({"date": pd.date_range("1970-01-01", periods=n).date, "code": "a", "ord": range(n), "seg": 0, "x": np.where(ok, x, np.nan), "y": 0.0})
    d = to_spark(spark, pdf).withColumn("ok", F.col("x").isNotNull()).repartition("code").persist()
    d.count()
    ts.ewma(d, "y", 0.25, "s").agg(F.sum("s")).collect()
    t0 = time.time()
    ts.ewma(d, "y", 0.25, "s").agg(F.sum("s")).collect()
    t1 = time.time()
    got = back(ts.ewma_with_gaps(d, "x", "ok", 0.25, "s"))
    t2 = time.time()
    want = pd.Series(pdf.x).ewm(alpha=0.25, adjust=False).mean().where(ok, 0.0)
    assert np.abs(got.s.to_numpy() - want.to_numpy()).max() < 1e-12
    assert t2 - t1 < 10 + 5 * (t1 - t0)  # no list of the history beside every row


def test_mutations_keep_or_erase_what_values_say(spark):
    rows = [(dt.date(2020, 1, k + 1), f"c{k}", k + 0.5, f"t{k}", dt.date(2021, 1, k + 1), k % 2 == 0) for k in range(6)] + [(dt.date(2020, 1, 7), "c6", None, None, None, None)]
    df = spark.createDataFrame(rows, "date date, code string, x double, text string, day date, flag boolean")
    late = F.col("date") > F.lit("2020-01-03").cast("date")
    for kind, distinct in (("affine", 3), ("constant", 1)):
        got = audit.mutate(df, late, kind).orderBy("date").collect()
        assert [tuple(r) for r in got[:3]] == rows[:3] and [r.code for r in got] == [r[1] for r in rows]
        own = got[3:6]
        assert all(len({getattr(r, c) for r in own}) == distinct for c in ("x", "text", "day"))
        assert all(a != b for r, old in zip(own, rows[3:6]) for a, b in zip(r[2:], old[2:]))


@pytest.mark.parametrize("window", [5, 60, 750])
def test_rolling_quantiles_equal_brute_force(spark, window):
    pdf = pd.concat([panel_frame(900, 2, seed=window, drop=0), panel_frame(7, 1, seed=1, drop=0).assign(code="short")])
    pdf.loc[(pdf.ord > 300) & (pdf.ord < 340), "x"] = np.nan
    d = to_spark(spark, pdf)
    need = max(1, window // 2)
    got = ts.rolling_quantile(ts.rolling_quantile(d, "x", window, "m", 0.5, need), "x", window, "u", 0.9, skip=1).toPandas().sort_values(["code", "date"]).reset_index(drop=True)
    for code, part in pdf.sort_values(["code", "date"]).groupby("code"):
        x = part.x.to_numpy()
        own = got[got.code == code]
        for i in range(0, len(x), 7):
            for name, q, skip, least in (("m", 0.5, 0, need), ("u", 0.9, 1, window)):
                frame = x[max(0, i - skip - window + 1):max(0, i - skip + 1)]
                frame = frame[~np.isnan(frame)]
                want = np.quantile(frame, q) if len(frame) >= least else np.nan
                assert np.isclose(own[name].to_numpy()[i], want, equal_nan=True)


def test_normal_distribution_as_columns(spark):
    from statistics import NormalDist

    from panelwright.functions.scalar import normal_cdf, normal_quantile

    nd = NormalDist()
    xs = [-12.0, -8.0, -3.3, -1.0, -1e-9, 0.0, 0.4, 2.0, 5.0, 9.0]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", normal_cdf("x").alias("p")).collect()
    assert all(abs(r.p - nd.cdf(r.x)) < 1e-14 for r in got)
    ps = [1e-6, 0.01, 0.3, 0.5, 0.77, 0.999999]
    got = spark.createDataFrame([(p,) for p in [*ps, 0.0, 1.0, None]], "p double").select("p", normal_quantile("p").alias("x")).collect()
    assert all(r.x is None if r.p in (0.0, 1.0, None) else abs(r.x - nd.inv_cdf(r.p)) < 1e-9 for r in got)


def test_catalog_reads_footers_and_trees_find_changes(spark, tmp_path):
    from panelwright.sources import io

    rows = [(dt.datetime(2020, 1, 1) + dt.timedelta(days=k), k, "ab"[k % 2]) for k in range(400)]
    df = spark.createDataFrame(rows, "day timestamp, id long, part string")
    df.select("part", "id", F.col("day").cast("timestamp_ntz").alias("day")).write.parquet(str(tmp_path / "t"))
    facts = io.footer_facts(spark, str(tmp_path / "t"), "day")
    plan = facts._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [COUNT(*), MIN(day), MAX(day)]" in plan
    assert tuple(facts.first()) == (400, "2020-01-01", "2021-02-03")
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"
    one = io.catalog(spark, {"t": (str(tmp_path / "t"), "part", "day")}, distinct=True).first()
    assert (one["rows"], one["keys"], one["columns"]) == (400, 2, 3)

    d = df.select(F.col("id").cast("string").alias("id"), "part")
    tree = io.digest_tree(d, ["id", "part"], "id", "part")
    place = io.store_tree(tree, str(tmp_path / "trees"))
    assert io.store_tree(io.digest_tree(d.repartition(9), ["id", "part"], "id", "part"), str(tmp_path / "trees")) == place  # same content, same place
    stored = spark.read.parquet(place)
    assert io.changed_parts(stored, tree).count() == 0
    other = d.where("id <> '17'").unionByName(spark.createDataFrame([("900", "c")], "id string, part string"))
    got = {r.path: (r.rows_before, r.rows_after) for r in io.changed_parts(stored, io.digest_tree(other, ["id", "part"], "id", "part")).collect()}
    import hashlib

    leaf = lambda part, i: "./" + "/".join([part, *hashlib.md5(i.encode()).hexdigest()[:2]])
    assert set(got) == {leaf("b", "17"), leaf("c", "900")} and got[leaf("c", "900")] == (0, 1)
    assert got[leaf("b", "17")][0] == got[leaf("b", "17")][1] + 1
