"""A vehicle-inventory analytics engine on Spark DataFrames."""

from .operators.dedup import dedup_stats, deduplicate, deduplicate_by_url, deduplicate_by_vin
from .operators.filters import FilterSpec, filter_listings
from .operators.quality import top_issues, validate, validation_counts
from .plans.pipeline import register_site, run_listings, run_pages, run_sites, sites
from .schema import LISTING, is_constructible
from .sources.config import RunSpec
from .sources.dealers import read_dealers
from .sources.listings import read_csv, read_json, read_jsonl, read_state
from .sources.sinks import count_saved, save, write_csv, write_json, write_jsonl

__all__ = [
    "LISTING", "FilterSpec", "RunSpec", "count_saved", "dedup_stats", "deduplicate", "deduplicate_by_url", "deduplicate_by_vin", "filter_listings", "is_constructible", "read_csv", "read_dealers", "read_json", "read_jsonl", "read_state", "register_site", "run_listings", "run_pages", "run_sites", "save", "sites", "top_issues", "validate", "validation_counts", "write_csv", "write_json", "write_jsonl",
]
