"""Times the headline queries: prints one JSON line. BENCH_SF_DIR and BENCH_CPUS set the tables and the cores."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from gridloom.plans.registry import QUERIES

HEADLINE = (
    "nearest_active_point", "observation_means", "locate_points", "mesh_neighbors", "mesh_cut_by_distance", "fem_system", "sparse_product", "normal_equations",
    "matern_general", "nig_by_moments", "nig_log_density", "nearest_on_sphere", "template_match", "empirical_variogram", "spectral_density",
    "mesh_facets", "mesh_refine_everywhere", "simplex_gradients", "fem_system_varying", "extended_mesh_location", "tiled_node_names", "nig_to_gauss", "windowed_nig", "factor_solution", "tiled_location", "metric_distances",
)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    took = {}
    for name in HEADLINE:
        began = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(sf_dir.rstrip("/").rpartition("sf")[2] or 0)}))


if __name__ == "__main__":
    main()
