"""The scan as one job."""

from __future__ import annotations

from welltide.operators.scan import scan, scan_summary
from welltide.plans.d_segments import MIN_SAMPLES, RUNS_SQL, STAND_SQL, STEP_SQL, wide_table
from welltide.plans.e_knowledge import SL, profile_sql, rel_sql, resp_sql
from welltide.plans.registry import query
from welltide.sources.tables import WIDE_CHANNELS

COUNTS = {"census": f"(SELECT DISTINCT well_id, i FROM wide, generate_series(1, {len(WIDE_CHANNELS)}) g(i))", "states": "states", "timeline": "(SELECT DISTINCT well_id, run FROM t2)", "profiles": "profile",
          "relationships": "(SELECT well_id FROM prs UNION ALL SELECT well_id FROM prs)", "transitions": "(SELECT well_id FROM t2 WHERE ct = 1 AND prev_state IS NOT NULL)", "responses": "resp", "stands": "stands"}
STANDS = STAND_SQL[len(STEP_SQL):]


@query("scan", f"WITH {RUNS_SQL}, {SL}, {profile_sql()}, {rel_sql(False)}, {resp_sql()}{STANDS} " + " UNION ALL ".join(f"SELECT well_id, '{n}' AS stage, count(*) AS n_rows FROM {src} GROUP BY 1" for n, src in COUNTS.items()))
def q_scan(spark, sf):
    """Rows of every table of the scan, per well."""
    return scan_summary(scan(wide_table(spark, sf), WIDE_CHANNELS, MIN_SAMPLES))
