"""Time the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tagweave.plans import suite  # noqa: E402
from tagweave.session import local_session  # noqa: E402

HEADLINE = [
    "j05_enrichment_chain", "j05_scale_enrichment", "p23_flat_events", "p09_silver_conform", "w01_latest_by_time",
    "w02_keep_first_reading", "d02_excursion_board", "r02_idf", "r03_vectors", "r04_cosine_search", "d09_agent_run",
    "d13_audit_append", "d14_audit_verify", "z03_stream_enrichment",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus, cpus)
    spark.read.parquet(f"{sf_dir}/events.parquet").count()
    times = {}
    for name in HEADLINE:
        start = time.time()
        suite.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    rows = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet").count() for t in ("events", "lineitem", "documents")}
    print(json.dumps({"metric": "headline queries, total time", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": cpus, "rows": rows}))


if __name__ == "__main__":
    main()
