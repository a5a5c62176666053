"""Headline-query benchmark: prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Each query builds its whole plan from the raw test tables (fixture caches are cleared between
queries) and is forced to completion with the ``noop`` sink, so timings include scoring,
normalisation, probe generation and every distributed pass.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "h11_evaluate",            # flagship: documents -> goals -> probe -> judged -> metrics summary
    "h11_evaluate_numeric",    # H11 over four lineitem goals (no text)
    "f3_f4_f5_probe_deltas",   # E1 + F3-F5 probe generation
    "d5_d6_cached_goalspace",  # D1-D4 scoring with the D6 content cache
    "k1_best_of_n",            # best of 4 generations
    "m1_bleu_overlap",         # sentence BLEU per source
    "i7_kendall_tau",          # judge validity
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from tonegauge.plans import fixtures, registry
    from tonegauge.session import get_spark

    spark = get_spark(master=f"local[{cpus}]", shuffle_partitions=int(cpus) * 2)
    registry.load_all()
    times = {}
    for name in HEADLINE:
        fixtures.reset()
        t0 = time.time()
        df = registry.QUERIES[name](spark, sf)
        df.write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        print(f"{name}: {times[name]}s", file=sys.stderr, flush=True)
    fixtures.reset()
    out = {"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
           "sf": os.path.basename(sf.rstrip("/")), "cpus": int(cpus)}
    print(json.dumps(out))


if __name__ == "__main__":
    main()
