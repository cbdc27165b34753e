"""Times the headline queries and prints one JSON line. Environment: BENCH_SF_DIR, BENCH_CPUS."""

import json
import os
import time

from welltide.plans import load_all
from welltide.plans.registry import QUERIES
from welltide.session import build_session

# The scan of a recording: census, states, profiles, relationships, transition responses, stands, alerts. Tables one
# step writes for the next are timed with the step that first needs them.
SCAN = ["channel_census", "rig_states", "state_timeline", "state_profiles", "relationships", "transition_responses", "stands", "alert_scan"]
OTHER = ["channel_stats", "robust_range", "asof_nearest", "correlation_matrix", "lateral_geomechanics", "pore_pressure_profile", "pressure_window",
         "parameter_optimum", "overbalance_sweep", "zones", "minimum_curvature", "rolling_means", "bin_distances", "betti_curves", "window_coherence"]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = build_session("bench", f"local[{cpus}]", cpus)
    spark.sparkContext.setLogLevel("ERROR")
    load_all()
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in SCAN + OTHER:
        t = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t, 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(sf.rstrip("/")),
                      "scan_pipeline_sec": round(sum(times[n] for n in SCAN), 3), "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
