"""Headline queries, warm, as one JSON line."""

from __future__ import annotations

import json
import os
import time

from codeloom.plans import queries
from codeloom.session import local_session, ship_package

#: The cases of the serving surface (status, capsule, impact, skeleton), and what feeds them.
NAMES = ("index_status", "capsule_budget_prefix", "impact_depth2", "full_skeleton", "bm25_rank_top80", "resolve_relative", "boundary_violations")


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), int(os.environ.get("BENCH_CPUS", "8")), "12g")
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    took = {}
    for name in NAMES:
        run = lambda: queries.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()  # noqa: B023, E731
        run()
        began = time.perf_counter()
        run()
        took[name] = round(time.perf_counter() - began, 3)
        spark.catalog.clearCache()
    print(json.dumps({"metric": "total warm time of headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": folder.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
