"""Command line: python tests/check.py [sf] [name-prefix ...] compares registered queries with DuckDB."""

import sys
import time

sys.path.insert(0, "/root/repo")

import pricelens.registry.all  # noqa: F401
from pricelens.registry import base
from pricelens.session import get_spark
from tests.compare import compare

if __name__ == "__main__":
    sf, wanted = sys.argv[1], [a for a in sys.argv[2:] if a != "-v"]
    spark = get_spark("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    good = 0
    for name in base.REGISTRY:
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            problem = compare(name, spark, f"/root/testdata/sf{sf}")
        except Exception as err:  # noqa: BLE001
            problem = f"{type(err).__name__}: {str(err)[:700]}"
        took = time.time() - start
        good += problem is None
        if problem or took > 6 or "-v" in sys.argv:
            print(f"{'ok ' if problem is None else 'BAD'} {name} {took:.1f}s {problem or ''}", flush=True)
    print("good", good, "of", len([n for n in base.REGISTRY if not wanted or any(n.startswith(w) for w in wanted)]))
    spark.stop()
