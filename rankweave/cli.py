"""Command line: rankweave run --expression PATH --cells PATH --gmt PATH --out DIR."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from rankweave.plans.trajectory import run_pipeline
from rankweave.sources import catalog as sources


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="rankweave")
    run = parser.add_subparsers(dest="command", required=True).add_parser("run", help="enrichment along a trajectory")
    run.add_argument("--expression", required=True, help="Parquet or CSV of cell_id, gene, value")
    run.add_argument("--cells", required=True, help="Parquet of cells")
    run.add_argument("--gmt", required=True)
    run.add_argument("--out", required=True)
    run.add_argument("--pseudotime-key", default="pseudotime")
    run.add_argument("--meta", help="CSV of cell metadata")
    run.add_argument("--allow-positional-merge", action="store_true")
    run.add_argument("--window-size", type=int, default=800)
    run.add_argument("--step", type=int, default=50)
    run.add_argument("--min-size", type=int, default=15)
    run.add_argument("--force", action="store_true")
    given = parser.parse_args(argv)
    spark = SparkSession.builder.appName("rankweave").getOrCreate()
    cells = spark.read.parquet(given.cells)
    if given.meta:
        meta = spark.read.option("header", True).option("inferSchema", True).csv(given.meta)
        cells = sources.merge_metadata(cells, meta, positional=given.allow_positional_merge)
    made = run_pipeline(spark, sources.read_expression(spark, given.expression), cells, given.gmt, given.out, given.pseudotime_key, given.force, given.window_size, given.step, given.min_size)
    print(f"{made['core'].count()} rows in {given.out}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
