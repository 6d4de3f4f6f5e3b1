"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from chronica import session  # noqa: E402
from chronica.plans import catalog, registry  # noqa: E402

# Written tables that several queries read, in the order in which they need each other.
STAGED = ["raw_events", "facts", "examples", "year_states"]

HEADLINE = [
    "b02_time_interval",
    "b09_claim_expansion",
    "b15_founding_events",
    "d06_cross_source_matches",
    "d08_next_event",
    "e01_canonical_birth",
    "e03_canonical_exact",
    "e04_canonical_subject",
    "e06_coverage_thickness",
    "e10_marginal_lift",
    "e25_history_by_domain",
    "f03_year_states",
    "f11_academic_states",
    "f12_output_states",
    "g01_stratified_sample",
    "m01_future_targets",
    "m03_person_age_rows_timed",
    "m14_person_period",
    "m16_matched_histories",
    "n14_cumulative_incidence",
    "n16_horizon_metrics",
    "n17_paired_bootstrap",
    "q05_fingerprint",
    "t05_candidates",
    "x01_chunk_ingest",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session.build(
        f"local[{cpus}]",
        "bench",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executor threads
    names = sys.argv[1:] or HEADLINE
    seconds = {}
    # Shared tables are written under names of their own, so that no query pays for another's.
    tables = registry.Tables(spark, sf_dir)
    for name in STAGED:
        start = time.perf_counter()
        getattr(tables, name)
        seconds[f"stage_{name}"] = round(time.perf_counter() - start, 3)
    for name in names:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
