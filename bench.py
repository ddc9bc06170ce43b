"""Time the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; print one JSON line."""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from modelgov.plans import registry  # noqa: E402
from modelgov.session import build_session  # noqa: E402

HEADLINE = [
    # decisions
    "field_usage_counts", "top_fields", "used_in_report", "unmatched_usage", "column_decisions", "protect_lists",
    "protect_structure", "protect_fixpoint", "table_decisions", "drop_columns",
    # graphs
    "filter_edges", "filter_lineage", "measure_lineage", "measure_closure",
    # text and catalog
    "scan_model_text", "parse_columns", "measure_formulas", "dax_refs", "semantic_links", "catalog_columns", "cleanup_plan",
    "cleanup_text", "not_deletable",
    # reports and layouts
    "page_visuals", "visual_labels", "visual_fields", "field_usage", "validate_refs", "layout_visuals",
    "layout_fields", "layout_filters", "layout_summary",
    # object model and rendering
    "tom_columns", "tom_relations", "render_model_text", "render_relations_text",
    # star schema
    "fact_union", "star_join", "date_join", "visual_bar", "visual_matrix", "visual_share", "date_drill",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS") or str(os.cpu_count() or 4)
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus,
        spark__driver__memory=os.environ.get("BENCH_MEMORY", "5g"), spark__ui__showConsoleProgress="false",
        spark__checkpoint__dir=tempfile.mkdtemp(prefix="modelgov-bench-"),
    )
    spark.sparkContext.setLogLevel("ERROR")
    registry.load_all()
    # Start the JVM's query path and load footers before anything is timed.
    registry.run("slicer_values", spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        times = []
        for _ in range(runs):
            start = time.perf_counter()
            registry.run(name, spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(sorted(times)[len(times) // 2], 3)
    found = re.search(r"sf([0-9.]+)", os.path.basename(os.path.normpath(sf_dir)))
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": float(found.group(1)) if found else None,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
