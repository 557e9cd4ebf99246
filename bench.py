"""Time the headline queries; prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_REPEATS.
Every query is run to completion by writing all its rows to the no-op sink. ``queries`` holds the
best warm time, ``cold`` the first run, ``exchanges`` the hash exchanges in the plan.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from wavespan.catalog import QUERIES  # noqa: E402
from wavespan.session import local_session  # noqa: E402

HEADLINE = [
    "change_share_by_year", "change_24t", "employer_spells", "code_spells", "employer_tenure",
    "code_experience", "work_experience", "spell_demean_poly", "spell_modal_code",
    "harmonise_codes", "code_right_join", "deflate_by_index", "build_panel_balanced",
    "wealth_left_join", "tenure_by_year", "box_by_year", "descriptive_table", "design_balanced",
    "select_sample", "ols_within_year", "ols_absorbed", "fixed_width_ingest",
    "careers_end_to_end", "wage_quantiles_by_year", "events_value_box",
    "price_quantiles_by_ship_year", "ols_dummies", "careers_wage_model", "careers_long",
    "landed_panel",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "2"))
    spark = local_session("bench", cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    warm, cold, exchanges = {}, {}, {}
    for name in sys.argv[1:] or HEADLINE:
        times = []
        for _ in range(1 + repeats):
            start = time.perf_counter()
            df = QUERIES[name](spark, sf_dir)
            df.write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        cold[name], warm[name] = round(times[0], 3), round(min(times[1:] or times), 3)
        plan = df._jdf.queryExecution().executedPlan().toString()
        exchanges[name] = len(re.findall(r"Exchange hashpartitioning", plan))
    spark.stop()
    print(json.dumps({
        "metric": "total warm time of the headline queries", "value": round(sum(warm.values()), 3),
        "unit": "sec", "queries": warm, "cold": cold, "exchanges": exchanges,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": cpus}))


if __name__ == "__main__":
    main()
