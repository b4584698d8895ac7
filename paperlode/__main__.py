"""Command line: index a folder and search it."""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import SparkSession

from .engine import Config, Engine
from .functions.text import display
from .operators.extract import plain_text
from .plans.search import MODES
from .schema import DEFAULT_LIMIT


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="paperlode")
    p.add_argument("root")
    p.add_argument("query")
    p.add_argument("--respect-ignore", action="store_true")
    p.add_argument("--follow-symlinks", action="store_true")
    p.add_argument("--jobs", type=int, help="tasks at a time")
    p.add_argument("--debounce-ms", type=int, default=200)
    p.add_argument("--mode", choices=MODES, default="fuzzy")
    p.add_argument("--limit", type=int, default=DEFAULT_LIMIT)
    p.add_argument("--store")
    p.add_argument("--log-file")
    p.add_argument("--print-path", action="store_true", help="print the paths of the hits only")
    p.add_argument("--plain-text", action="store_true", help="the files hold text, pages parted by form feeds")
    a = p.parse_args(argv)
    if a.log_file:
        logging.basicConfig(filename=a.log_file, level=logging.INFO)
    spark = SparkSession.builder.master(f"local[{a.jobs or '*'}]").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    own = {"extractor": plain_text, "extractor_name": "plain"} if a.plain_text else {}
    engine = Engine(spark, Config(a.root, store=a.store, respect_ignore=a.respect_ignore, follow_symlinks=a.follow_symlinks, jobs=a.jobs, debounce_ms=a.debounce_ms, mode=a.mode, limit=a.limit, **own))
    engine.scan()
    for hit in engine.search(a.query).toLocalIterator():
        score = f" {hit['score']:g}" if a.mode == "fuzzy" else ""
        print(hit["path"] if a.print_path else f"{hit['path']}:{hit['page_no']}{score} {display(hit['snippet'])}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
