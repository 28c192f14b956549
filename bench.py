"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line.

Every query runs once to warm up at the smallest size and is then timed over a `noop` sink, so that all rows are produced. Workload
queries are the generated benchmark geometries at $BENCH_N (256); their rows are `<workload>_<n>` for areas and, at n = 64,
`<workload>_shapes_64` for traced rings with holes. `growth` times workloads over n, each run once and not part of the total, and
`calibration_sec` a fixed job before and after, by which rounds on machines of different speed can be compared.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from quadrille.model import FillRule, OverlayRule
from quadrille.operators.overlay import Overlay
from quadrille.plans.catalogue import BENCH, QUERIES
from quadrille.sources.generators import GENERATORS

HEADLINE = ("merge_segments", "hv_intersections", "winding_slabs", "area_matrix", "boundary_links", "rule_intersect", "rule_union", "rule_xor", "shape_rings")
#: workload, rule, sizes, whether rings are traced
GROWTH = (
    ("checkerboard", OverlayRule.XOR, (64, 512), False), ("nested", OverlayRule.XOR, (64, 256), False),
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    n = int(os.environ.get("BENCH_N", "256"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", str(2 * int(cpus))).config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def timed(make) -> float:
        began = time.time()
        make().write.format("noop").mode("overwrite").save()
        return round(time.time() - began, 3)

    jobs = {name: (lambda d, q=QUERIES[name]: q(spark, d)) for name in HEADLINE}
    for name, _, rule, _ in BENCH:
        size = min(n, 128) if name == "nested" else n
        jobs[f"{name}_{size}"] = lambda d, g=name, k=size, r=rule: Overlay(GENERATORS[g](spark, k)).area(r, FillRule.NON_ZERO)
        if name in ("checkerboard", "windows"):
            jobs[f"{name}_shapes_64"] = lambda d, g=name, r=rule: Overlay(GENERATORS[g](spark, 64)).shapes(OverlayRule(r))

    def calibration() -> float:
        return timed(lambda: spark.range(0, 50_000_000, 1, 16).selectExpr("id % 1000 AS k", "xxhash64(id) AS h").groupBy("k").agg({"h": "max"}))

    calibration()
    before = calibration()
    small = os.path.join(os.path.dirname(sf.rstrip("/")), "sf0.001")
    took = {}
    for name, job in jobs.items():
        timed(lambda: job(small if os.path.isdir(small) else sf))
        took[name] = timed(lambda: job(sf))
    growth: dict[str, dict[str, float]] = {}
    for name, rule, sizes, shapes in GROWTH:
        for k in sizes:
            o = Overlay(GENERATORS[name](spark, k))
            growth.setdefault(f"{name}_shapes" if shapes else name, {})[str(k)] = timed(lambda o=o, r=rule, s=shapes: o.shapes(r) if s else o.area(r, FillRule.NON_ZERO))
    report = {"calibration_sec": [before, calibration()], "growth": growth}
    print(json.dumps({**report, "metric": "total seconds of the headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf.rstrip("/")), "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
