"""Headline queries, warm median of three; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time
from pathlib import Path

from checks.catalog import QUERIES
from checks.session import local_session
from mailsift.sources.scratch import clear, scratch_path

HEADLINE = (
    "clean_funnel",
    "clean_mail",
    "clean_mail_raw",
    "clean_mail_html",
    "dedup_exact",
    "html_to_text",
    "parse_multipart",
    "balance_classes",
    "stratified_split",
    "build_dataset",
    "classify_batch",
    "render_chat",
    "compact_keep_links",
    "quality_by_source",
    "gate_stream",
)
RUNS = 3


def seconds(spark, name: str, sf_dir: str) -> float:
    """Time to compute every row and column of a query, without moving rows to the driver."""
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def evenly_split(spark, sf_dir: str) -> str:
    """A copy of the tables in as many files as there are cores.

    The given ones are a row group each, which one task has to read; tables of a size that
    needs a cluster come in many.
    """
    copy = scratch_path(spark, "bench-tables")
    for file in sorted(Path(sf_dir).glob("*.parquet")):
        parts = spark.sparkContext.defaultParallelism
        spark.read.parquet(str(file)).repartition(parts).write.parquet(f"{copy}/{file.name}")
    return copy


def main() -> None:
    given = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    spark = local_session()
    sf_dir = evenly_split(spark, given)
    times: dict[str, float] = {}
    for name in HEADLINE:
        seconds(spark, name, sf_dir)
        times[name] = round(statistics.median(seconds(spark, name, sf_dir) for _ in range(RUNS)), 3)
    clear(spark)
    print(
        json.dumps(
            {
                "metric": "headline queries, warm median of three, summed",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": given.rsplit("sf", 1)[-1],
            }
        )
    )


if __name__ == "__main__":
    main()
