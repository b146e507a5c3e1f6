"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default all cores),
BENCH_RUNS (timed runs per query after one warm-up, default 3; the median is reported),
BENCH_ONLY (comma-separated query names, or ``all`` for every registered query).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from loomtable import catalog
from loomtable.session import get_session

HEADLINE = """
projection_filter inner_join left_join_zero_spend customers_without_orders orders_with_valid_keys
broadcast_lookup_default item_pairs_cosine similar_items_for_one hero_most_connected subtract_keys top_k
customer_spend_sum count_distincts dedupe_by_keys one_document_per_text mean_impute pivot_status salted_sum
etl_top3_per_city top1_per_group rank_compare top_with_ties running_total lag_lead_diff rolling_7d_avg
sessionize date_functions json_extract word_count_tokens word_count_split access_log_endpoint hashtag_explode
clean_orders retail_sales_enriched overall_performance revenue_by_category top_customers_by_revenue
monthly_sales_trend validation_pass_fail csv_usable partitioned_roundtrip event_stream_counts
""".split()


def timed(run, spark, sf_dir: str) -> float:
    """Seconds to compute every row and column of a query, without keeping them."""
    start = time.perf_counter()
    run(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    catalog.load()
    chosen = [name for name in os.environ.get("BENCH_ONLY", "").split(",") if name] or HEADLINE
    names = list(catalog.QUERIES) if chosen == ["all"] else chosen
    spark = get_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "16g",
    })
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        run = catalog.QUERIES[name]
        timed(run, spark, sf_dir)
        seconds[name] = round(statistics.median(timed(run, spark, sf_dir) for _ in range(runs)), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr)
    spark.stop()
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "cores": int(cpus),
    }))


if __name__ == "__main__":
    main()
