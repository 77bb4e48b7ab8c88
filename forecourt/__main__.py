"""Command line: listings or captured pages in, validated, deduplicated, filtered listings out.

    python -m forecourt --input cars.csv --as-of-year 2024 --output kept.csv
    python -m forecourt --pages pages/ --dealers dealers.csv --as-of-year 2024 --site some_dealer

``pages`` is a Parquet table (url, html). Options given here win over a settings file,
defaults do not. Fetching and browsers are out of scope, so there are no options for them.
"""

from __future__ import annotations

import argparse
import logging
import sys
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans.pipeline import Result, register_dealers, run_listings, run_sites, sites
from .sources import listings as sources
from .sources import sinks
from .sources.config import RunSpec
from .sources.dealers import find_dealers, read_dealers

#: Settings that are read from the working folder if none are named; miles of a new car without settings.
SETTINGS, NEW_MILES = "forecourt.json", 100
log = logging.getLogger("forecourt")


def arguments(argv: Sequence[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="forecourt", description=__doc__.splitlines()[0])
    source = parser.add_mutually_exclusive_group()
    source.add_argument("--input", help="listings: .csv, .json or .jsonl")
    source.add_argument("--pages", help="captured pages: Parquet (url, html)")
    parser.add_argument("--dealers", help="dealer CSV, in either layout (default: looked for in the usual places)")
    parser.add_argument("--as-of-year", type=int, help="the year that new and plausible vehicles are judged by")
    parser.add_argument("--site", action="append", dest="sites", help="a dealer's slug; may be repeated")
    parser.add_argument("--all-sites", action="store_true", default=None, help="all dealers (the default without --site)")
    parser.add_argument("--output", dest="output_path")
    parser.add_argument("--format", dest="output_format", choices=["csv", "json", "jsonl", "auto"])
    parser.add_argument("--append", action="store_true", help="put the result behind what the output holds")
    parser.add_argument("--max-price", type=float)
    parser.add_argument("--max-mileage", type=int)
    parser.add_argument("--include-used", action="store_false", default=None, dest="new_only")
    parser.add_argument("--include-non-electric", action="store_false", default=None, dest="electric_only")
    parser.add_argument("--log-level", choices=["DEBUG", "INFO", "WARNING", "ERROR"])
    parser.add_argument("--log-file")
    parser.add_argument("--config", help="settings (JSON)")
    parser.add_argument("--create-config", help="write default settings to this path and stop")
    return parser.parse_args(argv)


def settings(args: argparse.Namespace) -> RunSpec:
    """What was asked for, on top of the named (or the usual) settings file."""
    names = ("output_path", "output_format", "max_price", "max_mileage", "new_only", "electric_only", "log_level", "log_file")
    explicit = {n: getattr(args, n) for n in names} | {"sites": tuple(args.sites) if args.sites else None, "all_sites": args.all_sites}
    path = args.config or (SETTINGS if Path(SETTINGS).exists() else None)
    if path:
        return RunSpec.from_file(path, **explicit)
    return RunSpec.from_dict({"max_mileage": NEW_MILES}, **explicit)


def start_logging(level: str = "INFO", file: str | None = None) -> None:
    """Messages to standard output and, if asked for, to a file."""
    handlers: list[logging.Handler] = [logging.StreamHandler(sys.stdout), *([logging.FileHandler(file)] if file else [])]
    shape = logging.Formatter("%(asctime)s - %(name)s - %(levelname)s - %(message)s", "%Y-%m-%d %H:%M:%S")
    for handler in handlers:
        handler.setFormatter(shape)
    log.handlers[:], log.propagate = handlers, False
    log.setLevel(level)


def read(spark: SparkSession, path: str, year: int) -> DataFrame:
    reader = sources.read_csv if path.endswith(".csv") else sources.read_jsonl if path.endswith(".jsonl") else sources.read_json
    return reader(spark, path, as_of_year=year)


def run(spark: SparkSession, args: argparse.Namespace, spec: RunSpec) -> Result:
    if args.input:
        return run_listings(read(spark, args.input, args.as_of_year), ["vehicle_url", "scraped_at", "vin", "stock_number"], spec.filter, as_of_year=args.as_of_year)
    pages = spark.read.parquet(args.pages)
    known = register_dealers(read_dealers(spark, args.dealers or find_dealers(spark)), as_of_year=args.as_of_year, scraped_at=F.current_timestamp())
    wanted = list(spec.sites) if spec.sites and not args.all_sites else known
    log.info("%d of %d dealers", len(wanted), len(sites()))
    return run_sites(pages, wanted, spec.filter, as_of_year=args.as_of_year)


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    args = arguments(argv)
    if args.create_config:
        RunSpec().save(args.create_config)
        print(f"default settings written to {args.create_config}")
        return 0
    if not args.as_of_year or not (args.input or args.pages):
        print("--as-of-year and --input or --pages are needed", file=sys.stderr)
        return 2
    try:
        spec = settings(args)
    except (OSError, ValueError) as error:
        print(f"settings: {error}", file=sys.stderr)
        return 1
    start_logging(spec.log_level, spec.log_file)
    spark = spark or SparkSession.builder.appName("forecourt").getOrCreate()
    found = run(spark, args, spec)
    (sinks.append if args.append else sinks.save)(found.filtered, spec.output_path, spec.output_format)
    counts, summary = found.dedup_stats.first(), found.summary().first()
    log.info("%d listings, %d duplicates by VIN and %d by address", counts.total, counts.duplicates_by_vin, counts.duplicates_by_url)
    log.info("%d kept, prices %s to %s, written to %s", summary.n, summary.min_price, summary.max_price, spec.output_path)
    return 0


if __name__ == "__main__":
    sys.exit(main())
