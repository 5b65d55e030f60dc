"""Time the headline queries: one JSON line on stdout.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS the local cores.
Every query is run to the end through a sink that discards its rows.
"""

from __future__ import annotations

import json
import os
import sys
import time

from unitcal.plans.catalog import CATALOG
from unitcal.session import build_session

HEADLINE = (
    "challenge_loss_by_group",
    "series_structure",
    "tabular_features",
    "sequence_pad",
    "nested_split",
    "promotion_sweep",
    "conformal_quantile",
    "coverage_sweep",
    "pareto_khat",
    "bootstrap_loss_poisson",
    "two_sample_lines",
    "correlations",
    "error_blocks",
    "missing_rates",
    "pc_batch",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS") or str(os.cpu_count() or 4)
    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g",
    })
    spark.sparkContext.setLogLevel("ERROR")
    # start-up and first-use costs of the JVM and the Python workers are not a query's
    CATALOG["challenge_loss"].run(spark, sf).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        CATALOG[name].run(spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
