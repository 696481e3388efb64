"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS the local cores.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from netvigil.plans import QUERIES  # noqa: E402
from netvigil.session import build_session, release_scratch, scratch, scratch_path  # noqa: E402

HEADLINE = [
    "u02_layer_union", "f01_whitelist_filter", "a01_dedup", "a02_by_level", "a06_cycle_summary",
    "a28_report_grouping_sets", "w07_top5_per_level", "p20_host_flatten", "p21_eve_flatten", "p09_median_impute",
    "a11_profile", "a16_percentile", "j01_correlate", "a24_chain_daily", "g1xx_static_rules", "w05_frequency_rules",
    "w06_block_cooldown", "w01_sliding_window", "m03_split", "m05_undersample", "a20_pr_auc", "s22_packet_flows",
    "m17_pca_recon",
]


def laid_out(spark, sf_dir: str, cpus: str) -> str:
    """A copy of the tables with the large ones in as many files as cores, made before timing.

    Each supplied table is one file with one row group, which one task would read; tables of any size
    to speak of come in many files.
    """
    out, cores = scratch_path(spark, "bench"), int(cpus) if cpus.isdigit() else 8
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings"):
        rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        files = cores if name in ("lineitem", "events") else 1
        rows.repartition(files).write.parquet(f"{out}/{name}.parquet")
    return out


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": str(cpus) if cpus.isdigit() else "8", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    only = sys.argv[1:]
    tables = laid_out(spark, sf_dir, cpus)
    seconds: dict[str, float] = {}
    QUERIES["a08_labels"](spark, tables).collect()  # start the engine before timing
    for name in HEADLINE:
        if only and name not in only:
            continue
        with scratch(spark):
            began = time.perf_counter()
            QUERIES[name](spark, tables).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({
        "metric": "headline_total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": cpus}))
    release_scratch(spark)
    spark.stop()


if __name__ == "__main__":
    main()
