"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import time

from shelf.session import local_session

HEADLINE = (
    "A1_index_scan", "A3_insert_if_absent", "B2_month_moves", "B3_free_destination", "B5_page_manifest",
    "C4_template", "C9_invoice_numbers", "D3_similar_pairs", "D6_nearest_duplicate", "E2_parameter_changes",
    "E4_threshold_fold", "F2_taught_prior", "F7_crop_plan", "G1_window_sum", "G3_otsu", "L5_best_rectangle", "I1_quad_iou",
    "A7_upright_grid", "A11_stored_index", "C12_single_invoices", "D1_perceptual_hashes", "E5_online_parameters", "G14_detections", "L1_cell_features",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus)
    spark.sparkContext.setLogLevel("ERROR")
    from shelf.catalog import QUERIES

    QUERIES["A1_index_scan"](spark, folder).write.format("noop").mode("overwrite").save()  # start the JVM's engines
    seconds = {}
    for name in HEADLINE:
        begin = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begin, 3)
    print(json.dumps({
        "metric": "total seconds of headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
