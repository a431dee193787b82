"""Headline timings: one JSON line.

The first entry scans and folds the line items from cold; the others run on
the session's stage tables, as a research session would.  Every query is
executed in full into Spark's no-op sink.
"""

from __future__ import annotations

import json
import os
import time

from panelwright.plans import QUERIES
from panelwright.scale import session
from panelwright.sources import panels

HEADLINE = [
    "w_03_rolling_sum", "w_06_rolling_median", "w_10_ewma", "w_22_spells", "cs_02_average_rank", "cs_12_quintile",
    "j_05_asof_strict", "j_09_calendar_offset", "f_02_residual_momentum", "f_12_high_proximity", "f_15_box",
    "f_30_cfo_state", "g_13_side_separation", "m_09_walk_forward", "p_03_daily_account", "e_03_metric_bundle",
    "d_05_source_attribution",
]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("OFF")
    times: dict[str, float] = {}

    def clock(name, fn):
        t = time.time()
        fn()
        times[name] = round(time.time() - t, 3)

    rows = panels.table(spark, folder, "lineitem").count()  # starts the JVM's file readers
    clock("panel_build_cold", lambda: run(panels.panel(spark, folder)))
    clock("score_and_events_cold", lambda: run(panels.events(spark, folder)))
    for name in HEADLINE:
        clock(name, lambda: run(QUERIES[name](spark, folder)))
    panel_rows = panels.panel(spark, folder).count()
    total = round(sum(times.values()), 3)
    print(json.dumps({
        "metric": "headline panel queries, total wall clock", "value": total, "unit": "sec", "queries": times,
        "sf": folder.rsplit("sf", 1)[-1], "lineitem_rows": rows, "panel_rows": panel_rows,
        "momentum_rows_per_sec": round(panel_rows / times["f_02_residual_momentum"]),
    }))
    panels.release(spark)
    spark.stop()


if __name__ == "__main__":
    main()
