"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import time

from somagrid.registry import QUERIES, load_all
from somagrid.session import build_session

HEADLINE = [
    "cells_to_regions", "region_counts", "region_density_by_group", "label_intensity", "painted_density", "density_map",
    "cells_within_radius", "nearest_cells", "components_6", "object_table", "object_iou", "detection_scores", "box_clusters",
    "distance_to_background", "smooth_map", "volcano", "mannwhitney", "gene_screen", "track_edges", "tree_paths",
    "streamed_region_counts",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    load_all()
    spark = build_session("bench", f"local[{cpus}]", max(cpus, 8))
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/lineitem.parquet").selectExpr("sum(l_quantity)").collect()  # start-up is not timed
    times = {}
    for name in HEADLINE:
        t = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
