"""python tests/check.py [sf] [name-prefix ...] : run queries against their oracles."""

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import harness  # noqa: E402
from netvigil.plans import ORACLES, QUERIES  # noqa: E402
from netvigil.session import build_session  # noqa: E402


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    prefixes = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session("check", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = harness.connect(sf_dir)
    bad = 0
    for name, fn in QUERIES.items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        t0 = time.time()
        try:
            cols, rows = harness.spark_side(fn(spark, sf_dir))
            t1 = time.time()
            if name not in ORACLES:
                print(f"ROWS  {name} {len(rows)} {t1 - t0:.1f}s")
                continue
            ocols, orows = harness.duck_side(con, ORACLES[name])
            ok = cols == ocols and rows == orows
            print(f"{'OK   ' if ok else 'DIFF '} {name} {len(rows)}/{len(orows)} spark {t1 - t0:.1f}s duck {time.time() - t1:.1f}s",
                  flush=True)
            if not ok:
                bad += 1
                if cols != ocols:
                    print("   cols", cols, ocols)
                else:
                    only_a = sorted(set(rows) - set(orows))[:3]
                    only_b = sorted(set(orows) - set(rows))[:3]
                    print("   spark-only", only_a, "\n   duck-only ", only_b)
        except Exception as exc:  # report and go on with the next query
            bad += 1
            print(f"FAIL  {name} {type(exc).__name__}: {str(exc)[:700]}")
            if os.environ.get("TRACE"):
                traceback.print_exc()
    print("bad:", bad)


if __name__ == "__main__":
    main()
