"""Warm wall-clock time of the jobs; prints one JSON line.

BENCH_SF_DIR names the test tables, BENCH_CPUS the local cores, BENCH_RUNS the runs per job (median).
The first run of each job is not counted; it also stores the bound tables, reported as "load".
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from mendgrid.session import local_session  # noqa: E402
from trial.binding import tables  # noqa: E402
from trial.queries import QUERIES  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
LARGE = ("software_vulnerabilities", "asset_software_installs", "scan_findings", "patch_actions", "risk_score_snapshots")

# Measured by default; "all" as argument measures every job, any other argument is a name prefix.
HEADLINE = re.compile(
    r"^(r\d_|v\d_|f\d_|a7_|d5_|p1_record|p2_new_actions|p3_|t1_event|t2_|t3_|m1_inserted|m2_updated|m3_delete|m4_"
    r"|c1_|c4_|c6_|s\d_|a5_labeled_scan_findings)"
)


def shuffles(df) -> int:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return len(re.findall(r"(?<!Broadcast)(?<!Reused)Exchange (?:hash|range|Single)", plan))


def run(spark, name: str):
    df = QUERIES[name](spark, SF_DIR)
    df.write.format("noop").mode("overwrite").save()
    return df


def main() -> None:
    only = sys.argv[1:]
    spark = local_session(CPUS)
    spark.sparkContext.setLogLevel("ERROR")
    started = time.perf_counter()
    bound = tables(spark, SF_DIR)
    for name in LARGE:
        bound[name].count()
    load = time.perf_counter() - started
    times, plans = {}, {}
    for name in QUERIES:
        wanted = HEADLINE.match(name) if not only else only == ["all"] or any(name.startswith(p) for p in only)
        if not wanted:
            continue
        plans[name] = shuffles(run(spark, name))
        taken = []
        for _ in range(RUNS):
            at = time.perf_counter()
            run(spark, name)
            taken.append(time.perf_counter() - at)
        times[name] = round(statistics.median(taken), 3)
        print(name, times[name], plans[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "warm_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "shuffles": plans,
                "load": round(load, 3),
                "sf": Path(SF_DIR).name,
                "cpus": int(CPUS),
                "runs": RUNS,
            }
        )
    )


if __name__ == "__main__":
    main()
