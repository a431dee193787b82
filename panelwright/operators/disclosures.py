"""Financial report states as set operations.

Reports arrive as versions of a report key (start, end, period, basis).  On any
day the current report of a code is the version with the greatest (end,
disclosed, period) among the latest versions of all keys; since a later version
of a key always dominates an earlier one, a running maximum over days gives the
same answer as keeping a store of versions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions.scalar import accounting_basis, col
from panelwright.operators import asof as A

# Accepted length in days of each reporting period.
PERIOD_DAYS = {"1Q": (80, 100), "2Q": (170, 195), "3Q": (260, 285), "FY": (350, 380)}
REPORT = ["start", "end", "period", "basis"]


def report_versions(fins: DataFrame) -> DataFrame:
    """Only statements with a known period of plausible length."""
    days = F.datediff("end", "start")
    valid = F.lit(False)
    for name, (lo, hi) in PERIOD_DAYS.items():
        valid = valid | ((F.col("period") == name) & days.between(lo, hi))
    return fins.withColumn("basis", accounting_basis("document")).withColumn("days", days).where(
        F.col("basis").isNotNull() & valid)


def comparable_pairs(versions: DataFrame, keys) -> DataFrame:
    """Report keys and their prior-year counterparts (start, end, length within 7 days).

    Joined on the month of the report's end, so that the range conditions only
    filter a few candidates per key.
    """
    keys = list(keys)
    k = versions.select(*keys, *REPORT, "days").distinct()
    month = lambda d: F.trunc(d, "month")
    year_ago = F.add_months("end", -12)
    near = F.array_distinct(F.array(month(F.date_sub(year_ago, 7)), month(year_ago), month(F.date_add(year_ago, 7))))
    new = k.withColumn("_m", F.explode(near))
    old = k.select(*keys, "period", "basis", month("end").alias("_m"), F.col("start").alias("old_start"),
                   F.col("end").alias("old_end"), F.col("days").alias("old_days"))
    close = (
        (F.abs(F.datediff("old_start", F.add_months("start", -12))) <= 7)
        & (F.abs(F.datediff("old_end", F.add_months("end", -12))) <= 7)
        & (F.abs(F.col("days") - F.col("old_days")) <= 7)
    )
    return new.join(old, [*keys, "period", "basis", "_m"]).where(close).select(
        *keys, *REPORT, "old_start", "old_end")


def segment_spans(panel: DataFrame) -> DataFrame:
    """First and last date of every listing segment."""
    return panel.groupBy("code", "seg").agg(F.min("date").alias("seg_first"), F.max("date").alias("seg_last"))


def assign_segments(events: DataFrame, panel: DataFrame, day: str = "disclosed") -> DataFrame:
    """Give each disclosure to the segment that may see it.

    The first segment sees all history, a relisted one only what was disclosed
    from its first date on; disclosures from the last date on are never seen.
    """
    spans = segment_spans(panel)
    seen = (F.col(day) < F.col("seg_last")) & ((F.col("seg") == 0) | (F.col(day) >= F.col("seg_first")))
    return events.join(spans, "code").where(seen).drop("seg_first", "seg_last")


def daily_reports(reports: DataFrame, panel: DataFrame, value: Column, keys=("code",), extra=()) -> DataFrame:
    """One row per segment, report and day: the last usable version of that day, NULL without one.

    Reports are reduced to days before they meet the segments, so a code with
    very many reports leaves as many rows as it has reporting days.
    """
    keys = list(keys)
    usable = F.col("_value").isNotNull()
    v = reports.withColumn("_value", value).groupBy(*keys, *REPORT, "disclosed").agg(
        F.max_by(F.when(usable, F.struct(F.col("_value").alias("value"), "days", *extra)), F.when(usable, F.col("number"))).alias("_v"),
        F.min(F.when(usable, F.col("number"))).alias("_n"))
    return assign_segments(v.withColumn("version", F.col("_v")).drop("_v"), panel)


def metric_versions(daily: DataFrame, keys=("code", "seg"), extra=()) -> DataFrame:
    """Usable versions of :func:`daily_reports` with the order ``first_seen`` in which their reports appeared.

    It decides between reports that tie in every dominating field.
    """
    keys = list(keys)
    order = F.min(F.struct("disclosed", "_n")).over(Window.partitionBy(*keys, *REPORT))
    d = daily.where(F.col("version").isNotNull()).withColumn("first_seen", order)
    return d.select(*keys, *REPORT, "disclosed", "first_seen", *[F.col(f"version.{c}").alias(c) for c in ("value", "days", *extra)])


def current_states(daily: DataFrame, keys=("code", "seg"), extra=()) -> DataFrame:
    """State after every reporting day: the current report, by a running maximum.

    Fully tied reports: the one first seen wins, hence the negated arrival.
    """
    keys = list(keys)
    order = F.min(F.when(F.col("version").isNotNull(), F.struct("disclosed", "_n"))).over(Window.partitionBy(*keys, *REPORT))
    d = daily.withColumn("first_seen", order)
    best = F.when(F.col("version").isNotNull(), F.struct(
        "end", "disclosed", "period",
        (-F.datediff("first_seen.disclosed", F.lit("1900-01-01"))).alias("a"),
        (-F.col("first_seen._n")).alias("b"), "start", "basis", F.col("version.days").alias("days"), F.col("version.value").alias("value"),
        *[F.col(f"version.{c}").alias(c) for c in extra]))
    d = d.groupBy(*keys, "disclosed").agg(F.max(best).alias("_best"))
    d = d.withColumn("updated", F.col("_best").isNotNull())
    past = Window.partitionBy(*keys).orderBy("disclosed").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_best", F.max("_best").over(past))
    return d.select(*keys, F.col("disclosed").alias("day"), "updated",
                    F.col("_best.end").alias("end"), F.col("_best.disclosed").alias("state_date"),
                    *[F.col(f"_best.{c}").alias(c) for c in ("period", "start", "basis", "days", "value", *extra)])


def with_previous(states: DataFrame, versions: DataFrame, keys=("code", "seg")) -> DataFrame:
    """Attach the comparable prior-year value known on the state's day."""
    keys = list(keys)
    pairs = comparable_pairs(versions, keys)
    need = states.where(F.col("end").isNotNull()).select(*keys, "day", *REPORT).join(pairs, [*keys, *REPORT])
    old_key = [*keys, "period", "basis", "old_start", "old_end"]
    old = versions.select(*keys, "period", "basis", F.col("start").alias("old_start"), F.col("end").alias("old_end"),
                          F.col("disclosed").alias("old_disclosed"), F.col("value").alias("old_value"), "first_seen")
    found = A.asof(need, old, old_key, "day", "old_disclosed", ["old_value", "first_seen"]).where("old_value is not null")
    rank = F.struct("old_end", "old_disclosed", (-F.datediff("first_seen.disclosed", F.lit("1900-01-01"))).alias("a"),
                    (-F.col("first_seen._n")).alias("b"))
    prev = found.groupBy(*keys, "day").agg(F.max_by("old_value", rank).alias("previous"))
    return states.join(prev, [*keys, "day"], "left").withColumn("yoy", F.col("value") - F.col("previous"))


def onto_panel(panel: DataFrame, states: DataFrame, cols: list[str]) -> DataFrame:
    """Strict as-of of daily states onto panel rows of the same segment."""
    return A.asof(panel, states, ["code", "seg"], "date", "day", cols, strict=True)


def report_days(panel: DataFrame, reports: DataFrame, value: Column, previous: bool = True, extra=()) -> DataFrame:
    """Current value, and change on the comparable report, after every reporting day of a segment."""
    daily = daily_reports(reports, panel, value, extra=extra)
    states = current_states(daily, extra=extra)
    if previous:
        states = with_previous(states, metric_versions(daily, extra=extra))
    return states.select("code", "seg", "day", "value", "state_date", "period", "basis", *extra, *(["yoy"] if previous else []))


def report_state(panel: DataFrame, reports: DataFrame, value: Column, name: str, expiry: int = 450,
                 previous: bool = True, extra=()) -> DataFrame:
    """Current value, change on the comparable report and state date on every panel row."""
    return state_columns(panel, report_days(panel, reports, value, previous, extra), name, expiry, previous, extra)


def state_columns(panel: DataFrame, days: DataFrame, name: str, expiry: int = 450, previous: bool = True, extra=()) -> DataFrame:
    """:func:`report_days` on panel rows; rows and days laid out alike stay where they lie."""
    cols = ["value", "state_date", "period", "basis", *extra] + (["yoy"] if previous else [])
    d = onto_panel(panel, days, cols)
    live = lambda c: A.unexpired(c, "date", "state_date", expiry)
    out = {name: live("value"), f"{name}_date": F.col("state_date"),
           f"{name}_period": F.coalesce("period", F.lit("missing")), f"{name}_basis": F.coalesce("basis", F.lit("missing")),
           **{f"{name}_{c}": live(c) for c in extra}}
    if previous:
        out[f"{name}_yoy"] = live("yoy")
    return d.withColumns(out).drop("value", "state_date", "period", "basis", "yoy", "day", *extra)


def metric_reports(reports: DataFrame, metrics: dict[str, Column]) -> DataFrame:
    """One row per report and day with a struct ``version, _n`` for each metric, as in :func:`daily_reports`."""
    usable = {k: F.when(F.col(f"_{k}").isNotNull(), F.col("number")) for k in metrics}
    best = lambda k: F.max_by(F.when(F.col(f"_{k}").isNotNull(), F.struct(F.col(f"_{k}").alias("value"), "days")), usable[k])
    wide = reports.select("code", *REPORT, "disclosed", "days", "number", *[v.alias(f"_{k}") for k, v in metrics.items()])
    return wide.groupBy("code", *REPORT, "disclosed").agg(*[F.struct(best(k).alias("version"), F.min(usable[k]).alias("_n")).alias(f"_{k}") for k in metrics])


def metric_days(panel: DataFrame, wide: DataFrame, metrics, extra=()) -> DataFrame:
    """One row per segment and reporting day with a struct ``value, yoy, state_date, period`` and ``extra`` state columns for each metric.

    ``wide`` comes from :func:`metric_reports`; laid out by code as the panel is, it travels no further.
    """
    keys = ["code", "seg", "metric"]
    each = F.array(*[F.struct(F.lit(k).alias("metric"), F.col(f"_{k}.version").alias("version"), F.col(f"_{k}._n").alias("_n")) for k in metrics])
    daily = assign_segments(wide.select("code", *REPORT, "disclosed", F.inline(each)), panel)
    states = with_previous(current_states(daily, keys), metric_versions(daily, keys), keys)
    record = F.struct("value", "yoy", "state_date", "period", *extra)
    return states.groupBy("code", "seg", "day").agg(*[F.max(F.when(F.col("metric") == k, record)).alias(f"_s_{k}") for k in metrics])


def metric_columns(rows: DataFrame, days: DataFrame, metrics, expiry: int = 450, extra=()) -> DataFrame:
    """Panel rows with ``<metric>_value, <metric>_yoy, <metric>_date, <metric>_period`` and ``extra`` texts of :func:`metric_days`, not repeated by metric."""
    d = A.asof(rows, days, ["code", "seg"], "date", "day", [f"_s_{k}" for k in metrics], strict=True, per_column=True)
    live = lambda c, k: A.unexpired(F.col(f"_s_{k}.{c}"), "date", F.col(f"_s_{k}.state_date"), expiry)
    return d.select(*rows.columns, *[c for k in metrics for c in (
        live("value", k).alias(f"{k}_value"), live("yoy", k).alias(f"{k}_yoy"), F.col(f"_s_{k}.state_date").alias(f"{k}_date"),
        *[F.coalesce(f"_s_{k}.{c}", F.lit("missing")).alias(f"{k}_{c}") for c in ("period", *extra)])])


def metric_states(rows: DataFrame, days: DataFrame, metrics, expiry: int = 450) -> DataFrame:
    """States of several metrics in one pass; one row per panel key and metric."""
    d = metric_columns(rows.select("date", "code", "seg"), days, metrics, expiry)
    each = F.array(*[F.struct(F.lit(k).alias("metric"), F.col(f"{k}_value").alias("value"), F.col(f"{k}_yoy").alias("yoy"),
                              F.col(f"{k}_date").alias("state_date"), F.col(f"{k}_period").alias("period")) for k in metrics])
    return d.select("date", "code", F.inline(each))


def turn_negative_events(panel: DataFrame, reports: DataFrame, value: Column) -> DataFrame:
    """Date since which the current report has been a first turn below zero.

    Judged on the state at the end of each disclosure day, the first moment a
    panel row can see it.  A usable, comparable update sets the event (dated by
    the first bad day of that report) or clears it; any other leaves it as is.
    """
    daily = daily_reports(reports, panel, value)
    s = with_previous(current_states(daily), metric_versions(daily))
    bad = (F.col("value") < 0) & (F.col("previous") >= 0)
    judged = F.col("updated") & F.col("previous").isNotNull()
    by_report = Window.partitionBy("code", "seg", *REPORT).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumn("_first", F.min(F.when(judged & bad, F.col("day"))).over(by_report))
    change = F.when(judged, F.struct(F.when(bad, F.col("_first")).alias("since")))
    past = Window.partitionBy("code", "seg").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumn("event_date", F.last(change, ignorenulls=True).over(past)["since"])
    return onto_panel(panel, s.select("code", "seg", "day", "event_date"), ["event_date"]).drop("day")


def calendar_age(df: DataFrame, day: str, out: str, dates: DataFrame, days: DataFrame) -> DataFrame:
    """Positions since the first calendar date on which ``day`` was visible.

    ``dates`` holds the calendar (date, ord) and ``days`` every day that may
    occur; both have one row per day.
    """
    cal = dates.select(F.col("date").cast("timestamp").alias("stamp"), F.col("ord").alias("_o"))
    first = A.asof_unkeyed(days, cal, day, "stamp", ["_o"]).select(day, (F.coalesce("_o", F.lit(-1)) + 1).alias("_first"))
    return df.join(first, day, "left").withColumn(out, F.col("ord") - F.col("_first")).drop("_first")


def decay_steps(age) -> Column:
    """Full, half and quarter strength for the first three score of positions."""
    a = col(age)
    return F.when(a.between(0, 20), 1.0).when((a > 20) & (a <= 40), 0.5).when((a > 40) & (a <= 60), 0.25).otherwise(0.0)


def disclosed_shares(panel: DataFrame, fins: DataFrame, expiry: int = 450) -> DataFrame:
    """Latest strictly prior issued-share count of a valid statement."""
    ok = accounting_basis("document").isNotNull() & F.col("period").isin(*PERIOD_DAYS) & (F.col("shares") > 0)
    seen = assign_segments(fins.where(ok), panel)
    daily = A.last_per_day(seen, ["code", "seg"], "disclosed", "number", ["shares"])
    d = A.asof(panel, daily, ["code", "seg"], "date", "disclosed", ["shares"], strict=True)
    return d.withColumn("shares", A.unexpired("shares", "date", "disclosed", expiry)).withColumnRenamed("disclosed", "shares_date")
