"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line.

Each query is run once to warm up and then RUNS times; its value is the median. The tree is stored by the first query
that needs it, as loading a database would; `load` has that time.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

from copse import queries as engine
from copse.operators.structural import named, pairs

RUNS = int(os.environ.get("BENCH_RUNS", "3"))
HEADLINE = ["label_tree", "tag_scan", "tag_range", "pc_join_equi", "ad_join_equi", "ad_join_labels", "ad_join_bins", "twig_chain", "twig_branch", "twig_wildcard", "twig_reverse", "twig_stitch", "twig_selective", "nj", "srt", "grp_groups", "grp_members", "cnf_filter", "rel_q1", "rel_q2", "rel_q3", "rel_q4", "rel_q5", "rel_q6", "merge_join", "duplicate_elimination"]


def theta_ad_join(spark: SparkSession, sf_dir: str):
    """The theta join that the rewrites replace: no equality, so all candidates meet. Orders with status P, to keep it short."""
    tree = engine.nodes(spark, sf_dir)
    inside = "doc_1 <= doc_2 AND doc_1 >= doc_2 AND start_1 < start_2 AND end_1 > end_2"
    return named(tree, 1, "customer").join(named(tree, 2, "status=P")).filter(inside)


def rewritten_ad_join(spark: SparkSession, sf_dir: str):
    return pairs(engine.nodes(spark, sf_dir), "customer", "status=P", "AD")


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    began = time.time()
    engine.nodes(spark, sf_dir)
    times["load"] = round(time.time() - began, 3)
    runs = {**{n: engine.QUERIES[n] for n in HEADLINE}, "ad_join_rewritten_small": rewritten_ad_join, "ad_join_theta_small": theta_ad_join}
    for name, run in runs.items():
        taken = []
        for _ in range(1 if name == "ad_join_theta_small" else RUNS + 1):
            began = time.time()
            run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.time() - began)
        times[name] = round(statistics.median(taken[1:] or taken), 3)
    sys.stdout.flush()
    total = sum(v for k, v in times.items() if k != "ad_join_theta_small")
    print(json.dumps({"metric": "total time of headline queries", "value": round(total, 3), "unit": "sec", "queries": times, "sf": sf_dir.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
