"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from terrasift.plans import catalog
from terrasift.session import local_session

HEADLINE = [
    "zone_board",             # tracks -> coverage -> posterior -> ranked zones
    "w1_consecutive",         # ordered edges of all tracks
    "j4_label_points",        # interval labelling
    "w5_samples",             # sessionize, resample, vectors
    "a9_sweep_effort",        # edges to cells
    "a13_exposure",           # plans against weighted paths
    "a16_reweight",           # Bayes update of path weights
    "a19_profile",            # exact profile of lineitem
    "a26_spatial_holdout",    # held-out distance fits
    "j2_edges8",              # neighbour edges of the cell graph
    "u4_identical_content",   # duplicate contents
    "t5_track_lifecycle",     # event-log fold
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "terrasift-bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("user_id").count().write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        t0 = time.time()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    sf = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
