"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Load/normalise, components and traversal + top-k are timed apart (q*_load, q*_components, q*_<strategy>).
"""

import json
import os
import time

from hopgrid.operators import components, normalize
from hopgrid.plans import catalogue
from hopgrid.session import local_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")


def main() -> None:
    spark = local_session("bench")
    times: dict[str, float] = {}

    def timed(name, f):
        began = time.perf_counter()
        out = f()
        times[name] = round(time.perf_counter() - began, 3)
        return out

    catalogue.graph(spark, SF_DIR, "nation_region").top_k().collect()  # starts the JVM, workers and code generation
    for name in ("supp_part_q49", "part_part_q45", "cust_part_q50"):
        g = timed(f"{name}_load", lambda: catalogue.graph(spark, SF_DIR, name))
        timed(f"{name}_components", lambda: g.stats.count())
        timed(f"{name}_components_stars", lambda: components.connected_components(g.edges).count())
        timed(f"{name}_kernel", lambda: g.top_k(strategy="kernel").collect())
    g = catalogue.graph(spark, SF_DIR, "supp_part_q49")
    g.stats.count()
    timed("supp_part_q49_bitmask", lambda: g.top_k(strategy="bitmask").collect())
    timed("supp_part_q49_bitmask_1024", lambda: g.top_k(strategy="bitmask", limit=1024).collect())
    timed("supp_part_q49_pruned", lambda: g.top_k(strategy="pruned").collect())
    line = lambda: catalogue.raw_edges(spark, SF_DIR, "supp_mod")
    timed("normalize_lineitem", lambda: normalize.normalize(line()).count())
    timed("components_lineitem", lambda: components.connected_components(normalize.prepare(line())).count())
    print(json.dumps({"metric": "total seconds, all-source closeness and its parts", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(SF_DIR.rstrip("/"))}))


if __name__ == "__main__":
    main()
