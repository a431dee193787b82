"""Shared pieces of the comparison SQL: the same panel, stated independently."""

from __future__ import annotations

PANEL_CTES = """
li AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS code, CAST(date_trunc('week', l_shipdate) AS DATE) AS date,
         l_extendedprice / l_quantity AS px, l_quantity AS qty, l_extendedprice AS val, l_linenumber AS ln,
         row_number() OVER (PARTITION BY l_suppkey, date_trunc('week', l_shipdate)
                            ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) AS k
  FROM lineitem),
qt AS (
  SELECT date, code, arg_min(px, k) AS open, max(px) AS high, min(px) AS low, arg_max(px, k) AS close,
         sum(qty) AS volume, sum(val) AS turnover,
         arg_min(px, k) FILTER (WHERE ln <= 3) AS am_open, arg_max(px, k) FILTER (WHERE ln <= 3) AS am_close,
         sum(qty) FILTER (WHERE ln <= 3) AS am_volume,
         arg_min(px, k) FILTER (WHERE ln > 3) AS pm_open, arg_max(px, k) FILTER (WHERE ln > 3) AS pm_close,
         sum(qty) FILTER (WHERE ln > 3) AS pm_volume,
         CASE WHEN date = DATE '1998-01-05' AND CAST(code AS BIGINT) % 2 = 0 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS factor
  FROM li GROUP BY date, code),
cal AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS ord FROM (SELECT DISTINCT date FROM qt)),
q1 AS (SELECT qt.*, cal.ord FROM qt JOIN cal USING (date)),
q2 AS (SELECT *, CASE WHEN ord - lag(ord) OVER (PARTITION BY code ORDER BY date) > 3 THEN 1 ELSE 0 END AS jump FROM q1),
q3 AS (SELECT * EXCLUDE (jump), CAST(sum(jump) OVER (PARTITION BY code ORDER BY date) AS INTEGER) AS seg FROM q2),
q4 AS (SELECT *, open / lag(open) OVER (PARTITION BY code, seg ORDER BY date) - 1 AS ret FROM q3),
mk AS (SELECT date, avg(ret) AS mkt FROM q4 GROUP BY date),
q5 AS (SELECT q4.*, mk.mkt FROM q4 LEFT JOIN mk USING (date)),
q6 AS (SELECT *, CASE WHEN count(ret) OVER f >= 26 THEN covar_samp(ret, CASE WHEN ret IS NOT NULL THEN mkt END) OVER f
                      / var_samp(CASE WHEN ret IS NOT NULL THEN mkt END) OVER f END AS beta
       FROM q5 WINDOW f AS (PARTITION BY code, seg ORDER BY date ROWS BETWEEN 25 PRECEDING AND CURRENT ROW)),
q7 AS (SELECT *, ret - beta * mkt AS resid FROM q6),
pan AS (SELECT a.*, b.resid AS target, b.ret AS raw_target
        FROM q7 a LEFT JOIN q7 b ON a.code = b.code AND b.ord = a.ord + 2)
"""

ATTR_CTES = """
attr AS (
  SELECT CAST(s_suppkey AS VARCHAR) AS code, CAST(n_regionkey AS VARCHAR) AS sector17,
         CAST(n_nationkey AS VARCHAR) AS sector33,
         CASE WHEN s_acctbal >= 8000 THEN 'Core' WHEN s_acctbal >= 6000 THEN 'Large'
              WHEN s_acctbal >= 4000 THEN 'Mid' WHEN s_acctbal >= 2000 THEN 'Small1' ELSE 'Small2' END AS size_band
  FROM supplier JOIN nation ON s_nationkey = n_nationkey),
pa AS (SELECT pan.*, attr.sector17, attr.sector33, attr.size_band,
              CAST(CASE attr.size_band WHEN 'Core' THEN 5 WHEN 'Large' THEN 4 WHEN 'Mid' THEN 3
                   WHEN 'Small1' THEN 2 WHEN 'Small2' THEN 1 END AS DOUBLE) AS size
       FROM pan LEFT JOIN attr USING (code))
"""

FINS_CTES = """
f0 AS (
  SELECT *, CAST(o_custkey % (SELECT count(*) FROM supplier) AS VARCHAR) AS code, CAST(o_orderdate AS DATE) AS disclosed,
         CAST(CAST(date_trunc('quarter', o_orderdate) AS DATE) - 1 AS DATE) AS "end",
         CASE WHEN o_orderkey % 11 <> 0 THEN 10 * o_totalprice END AS assets
  FROM orders),
fins AS (
  SELECT code, disclosed, o_orderkey AS number,
         CASE quarter("end") WHEN 1 THEN '1Q' WHEN 2 THEN '2Q' WHEN 3 THEN '3Q' ELSE 'FY' END AS period,
         CASE quarter("end") WHEN 1 THEN '1Q' WHEN 2 THEN '2Q' WHEN 3 THEN '3Q' ELSE 'FY' END
           || CASE WHEN o_orderkey % 17 = 0 THEN 'Forecast_' ELSE 'FinancialStatements_' END
           || CASE o_orderstatus WHEN 'F' THEN 'Consolidated_JP' WHEN 'O' THEN 'NonConsolidated_JP'
                                 WHEN 'P' THEN 'Consolidated_IFRS' END AS document,
         CAST(date_trunc('year', "end") AS DATE) AS "start", "end",
         o_totalprice - 200000 AS cfo, assets,
         assets * CAST(CASE o_orderpriority WHEN '1-URGENT' THEN 0.30 WHEN '2-HIGH' THEN 0.25 WHEN '3-MEDIUM' THEN 0.20
                            WHEN '4-NOT SPECIFIED' THEN 0.15 WHEN '5-LOW' THEN 0.10 END AS DOUBLE) AS cash,
         assets * CAST(CASE o_orderpriority WHEN '1-URGENT' THEN 0.60 WHEN '2-HIGH' THEN 0.50 WHEN '3-MEDIUM' THEN 0.40
                            WHEN '4-NOT SPECIFIED' THEN 0.30 WHEN '5-LOW' THEN 0.20 END AS DOUBLE) AS equity,
         o_totalprice - 150000 AS profit, o_totalprice * 0.5::DOUBLE - 100000 AS op,
         o_totalprice * 0.6::DOUBLE - 120000 AS ordinary,
         CASE WHEN o_orderkey % 7 <> 0 THEN CAST(floor(o_totalprice) + 1000 AS DOUBLE) END AS shares,
         CASE WHEN o_orderkey % 17 = 0 THEN (1.1::DOUBLE * o_totalprice - 150000) / 1000 END AS forecast_eps
  FROM f0)
"""

MACRO_CTES = """
macro AS (
  SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month,
         CAST(CAST(date_trunc('month', o_orderdate) AS DATE) + INTERVAL 1 MONTH AS TIMESTAMP) - INTERVAL 1 SECOND AS available,
         avg(o_totalprice) AS macro
  FROM orders GROUP BY 1, 2)
"""


def r(expr: str, digits: int = 8) -> str:
    """Rounded double without negative zero; exact halves are nudged upwards first."""
    return f"(round(CAST({expr} AS DOUBLE) + 1.37e-{digits + 3}::DOUBLE, {digits}) + 0.0::DOUBLE)"


def day(expr: str = "date") -> str:
    return f"strftime(CAST({expr} AS DATE), '%Y-%m-%d')"


def on_panel(body: str, *more: str) -> str:
    """Statement over the panel; ``more`` are further named subqueries."""
    return "WITH " + ",\n".join([PANEL_CTES, *more]) + "\n" + body


def avg_rank(x: str, by: str = "date") -> str:
    """Average rank among non-missing values, in plain SQL."""
    return (f"CASE WHEN {x} IS NOT NULL THEN rank() OVER (PARTITION BY {by}, {x} IS NULL ORDER BY {x}) "
            f"+ (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2.0::DOUBLE END")


def pct_rank(x: str, by: str = "date") -> str:
    return f"(({avg_rank(x, by)}) / count({x}) OVER (PARTITION BY {by}))"


def centered(x: str, by: str = "date") -> str:
    """Needs no second window: the mean percentile of n ranks is (n+1)/(2n)."""
    n = f"count({x}) OVER (PARTITION BY {by})"
    return f"(2 * (({avg_rank(x, by)}) / {n} - ({n} + 1) / (2.0::DOUBLE * {n})))"


def scorr(a: str, b: str, rows: str = "") -> str:
    """Correlation that is missing when one side is constant."""
    c = f"corr({a}, {b}){rows}"
    return f"CASE WHEN NOT isnan({c}) THEN {c} END"


def ewma(x: str, alpha: float, source: str, out: str = "y", extra: str = "") -> str:
    """Smoothing by explicit geometric weights from the first row of the segment."""
    keep = f", {extra}" if extra else ""
    return f"""(SELECT code, seg, date{keep}, {x} AS x_in, pow({1 - alpha}::DOUBLE, i) * sum(z / pow({1 - alpha}::DOUBLE, i))
        OVER (PARTITION BY code, seg ORDER BY date) AS {out}
      FROM (SELECT *, CASE WHEN i = 0 THEN {x} ELSE {alpha}::DOUBLE * ({x}) END AS z
            FROM (SELECT *, row_number() OVER (PARTITION BY code, seg ORDER BY date) - 1 AS i FROM {source})))"""


QUINTILE = """CASE WHEN count(*) OVER (PARTITION BY date) >= 5 THEN CAST(least(4, greatest(0, ceil(5.0::DOUBLE *
   (row_number() OVER (PARTITION BY date ORDER BY coalesce({s}, 0), code) - 1)
   / (count(*) OVER (PARTITION BY date) - 1)) - 1)) AS INTEGER) END"""


def quintile(score: str) -> str:
    """The published floating-point form of the five groups."""
    return QUINTILE.format(s=score)


SCORED_CTES = ATTR_CTES + f""",
sc1 AS (SELECT *, CASE WHEN count(resid) OVER f >= 4 THEN sum(resid) OVER f END AS mom_sum FROM pa
        WINDOW f AS (PARTITION BY code, seg ORDER BY date ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)),
sc2 AS (SELECT *, coalesce({centered('mom_sum')}, 0) AS mom FROM sc1),
sc3 AS (SELECT date AS d3, code AS c3, y FROM {ewma('mom', 0.25, 'sc2')}),
sc4 AS (SELECT sc2.*, {r('y', 10)} AS score FROM sc2 JOIN sc3 ON d3 = date AND c3 = code),
sc5 AS (SELECT *, {quintile('score')} AS q, count(*) OVER (PARTITION BY date) AS n_day FROM sc4),
sc6 AS (SELECT *, (q - 2) / n_day / 1.2::DOUBLE AS w FROM sc5),
sc AS (SELECT *, coalesce(abs(w - lag(w) OVER (PARTITION BY code ORDER BY date)), abs(w)) AS dw FROM sc6)
"""


def on_scored(body: str, *more: str) -> str:
    return on_panel(body, SCORED_CTES, *more)


# Daily account of the scored panel, by definition.
ACCOUNT_CTES = f"""
ic0 AS (SELECT date, {avg_rank('score')} AS rx, {avg_rank('target')} AS ry FROM sc WHERE target IS NOT NULL AND score IS NOT NULL),
ic AS (SELECT date, {scorr('rx', 'ry')} AS rankic FROM ic0 GROUP BY date),
acc AS (
  SELECT date, coalesce(sum(w * target), 0) AS gross, coalesce(sum(w * target - 0.001::DOUBLE * dw), 0) AS net,
         coalesce(sum(dw), 0) AS turnover, 0.001::DOUBLE * coalesce(sum(dw), 0) AS cost_all,
         coalesce(sum(CASE WHEN w > 0 THEN w * target END), 0) AS long, coalesce(sum(CASE WHEN w < 0 THEN w * target END), 0) AS short,
         avg(CASE WHEN target IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS label_coverage,
         {', '.join(f'avg(CASE WHEN q = {k} THEN target END) AS q{k + 1}' for k in range(5))}
  FROM sc GROUP BY date),
daily AS (SELECT acc.*, ic.rankic, gross - net AS cost, gross - cost_all AS net_all_cost FROM acc LEFT JOIN ic USING (date))
"""


def on_account(body: str, *more: str) -> str:
    return on_scored(body, ACCOUNT_CTES, *more)


_EW = "PARTITION BY code, seg ORDER BY date"
EVENT_CTES = SCORED_CTES + f""",
e1 AS (SELECT *, product(factor) OVER ({_EW} ROWS UNBOUNDED PRECEDING) AS cf FROM sc),
e2 AS (SELECT *, high / cf AS sh, low / cf AS sl, close / cf AS scl, volume * cf AS sv FROM e1),
e3 AS (SELECT *, CASE WHEN count(sh) OVER f >= 8 THEN max(sh) OVER f END AS ph, CASE WHEN count(sl) OVER f >= 8 THEN min(sl) OVER f END AS pl FROM e2
       WINDOW f AS ({_EW} ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING)),
e4 AS (SELECT *, CASE WHEN scl / ph - 1 > 0 THEN scl / ph - 1 END AS hx, CASE WHEN pl / scl - 1 > 0 THEN pl / scl - 1 END AS lx FROM e3),
e5 AS (SELECT *, coalesce(0.5 + 0.5 * {pct_rank('hx')}, 0) AS hp, coalesce(0.5 + 0.5 * {pct_rank('lx')}, 0) AS lp,
       hx IS NOT NULL AS he, lx IS NOT NULL AS le FROM e4),
e6 AS (SELECT *, {r('hp - lp', 10)} AS raw FROM e5),
e7 AS (SELECT *, greatest(raw, 0) AS hr, least(raw, 0) AS lr FROM e6),
e8 AS (SELECT date AS d8, code AS c8, y AS hs FROM {ewma('hr', 0.25, 'e7')}),
e9 AS (SELECT date AS d9, code AS c9, y AS ls FROM {ewma('lr', 0.5, 'e7')}),
e10 AS (SELECT e7.*, hs, ls, ord - max(CASE WHEN hr > 0 THEN ord END) OVER k AS hage, ord - max(CASE WHEN lr < 0 THEN ord END) OVER k AS lage
        FROM e7 JOIN e8 ON d8 = date AND c8 = code JOIN e9 ON d9 = date AND c9 = code WINDOW k AS ({_EW})),
en AS (SELECT *, {r('hs + ls', 10)} AS dsc, {r('CASE WHEN ls < 0 THEN ls WHEN ls = 0 AND hs > 0 THEN hs ELSE hs + ls END', 10)} AS sn FROM e10)
"""


def on_events(body: str, *more: str) -> str:
    return on_panel(body, EVENT_CTES, *more)


def ridge_ctes(name: str, source: str, group: str, features, label: str, penalty: str = "1", cumulative: bool = True,
               min_rows: int = 1, min_days: int = 0, rank: bool = False, extra: str = "") -> str:
    """Named subqueries ending in ``name``: one row per group with rows, intercept, means, scales and coefficients.

    Written from the definition: impute the group's mean, standardise by the
    population deviation, then eliminate the normal equations column by column.
    ``penalty`` may use n; ``extra`` is one more grouping column of the source.
    """
    k = len(features)
    ex = f"{extra}, " if extra else ""
    xs = ", ".join(f"CAST({f} AS DOUBLE) AS x{i}" for i, f in enumerate(features))
    same = f" AND b.{extra} = g.{extra}" if extra else ""
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    rows = f"JOIN {name}_b b ON b.grp {'<=' if cumulative else '='} g.grp{same}"
    parts = [
        f"{name}_b AS MATERIALIZED (SELECT {ex}{group} AS grp, date, CAST({label} AS DOUBLE) AS y, {xs} FROM {source} WHERE {label} IS NOT NULL AND {group} IS NOT NULL)",
        f"{name}_g AS MATERIALIZED (SELECT {', '.join([f'g.{extra}'] * bool(extra) + ['g.grp'])}, count(*) AS n, count(DISTINCT date) AS days, avg(y) AS my, "
        + ", ".join(f"coalesce(avg(x{i}), 0) AS m{i}" for i in range(k))
        + f" FROM (SELECT DISTINCT {ex}grp FROM {name}_b) g {rows} GROUP BY ALL HAVING count(*) >= {min_rows} AND count(DISTINCT date) >= {min_days})",
        f"{name}_p AS MATERIALIZED (SELECT {', '.join([f'g.{extra}'] * bool(extra) + ['g.grp'])}, g.n, g.my, {', '.join(f'g.m{i}' for i in range(k))}, "
        + ", ".join(f"sum(coalesce(x{i} - m{i}, 0) * coalesce(x{j} - m{j}, 0)) AS p{i}_{j}" for i, j in pairs) + ", "
        + ", ".join(f"sum(coalesce(x{i} - m{i}, 0) * y) AS q{i}" for i in range(k))
        + f" FROM {name}_g g {rows} GROUP BY ALL)",
        f"{name}_z AS (SELECT *, " + ", ".join(f"CASE WHEN sqrt(p{i}_{i} / n) < 1e-8 THEN 1 ELSE sqrt(p{i}_{i} / n) END AS s{i}" for i in range(k)) + f" FROM {name}_p)",
    ]
    cell = lambda i, j: f"p{min(i, j)}_{max(i, j)} / (s{i} * s{j})" + (f" + {penalty}" if i == j else "")
    keep = ", ".join([*([extra] if extra else []), "grp", "n", "my", *[f"m{i}" for i in range(k)], *[f"s{i}" for i in range(k)]])
    parts.append(f"{name}_0 AS MATERIALIZED (SELECT {keep}, CAST(1e300 AS DOUBLE) AS least_pivot, " + ", ".join(
        f"CAST({cell(i, j)} AS DOUBLE) AS a{i}_{j}" for i in range(k) for j in range(k)) + ", " + ", ".join(f"q{i} / s{i} AS a{i}_{k}" for i in range(k)) + f" FROM {name}_z)")
    for p in range(k):
        cells = ", ".join((f"a{p}_{j} / nullif(a{p}_{p}, 0)" if i == p else f"a{i}_{j} - a{i}_{p} * a{p}_{j} / nullif(a{p}_{p}, 0)") + f" AS a{i}_{j}"
                          for i in range(k) for j in range(p + 1, k + 1))
        parts.append(f"{name}_{p + 1} AS MATERIALIZED (SELECT {keep}, least(least_pivot, a{p}_{p} / n) AS least_pivot, {cells} FROM {name}_{p})")
    head = ", ".join([*([extra] if extra else []), "grp", "n AS rows", "my AS intercept", *[f"m{i}, s{i}, a{i}_{k} AS c{i}" for i in range(k)]])
    parts.append(f"{name} AS MATERIALIZED (SELECT {head} FROM {name}_{k}" + (" WHERE least_pivot > 1e-10" if rank else "") + ")")
    return ",\n".join(parts)


def ridge_score(model: str, features, row: str = "") -> str:
    """Prediction of a model row standing beside a data row."""
    return f"({model}.intercept" + "".join(
        f" + {model}.c{i} * (coalesce({row}{f}, {model}.m{i}) - {model}.m{i}) / {model}.s{i}" for i, f in enumerate(features)) + ")"


def ridge_rows(model: str, features, columns: str, head: str) -> str:
    """Long form of a model table; ``columns`` are written in terms of mean, scale, coef and intercept."""
    return " UNION ALL ".join(
        f"SELECT {head}, '{f}' AS feature, CAST(rows AS BIGINT) AS rows, {columns} FROM (SELECT *, m{i} AS mean, s{i} AS scale, c{i} AS coef FROM {model})" for i, f in enumerate(features))
