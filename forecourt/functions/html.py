"""HTML functions as Spark columns and table functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import dom

_S, _A = T.StringType(), T.ArrayType(T.StringType())
FACTS = T.StructType(
    [
        T.StructField("text", _S),
        T.StructField("title", _S),
        T.StructField("heading", _S),
        T.StructField("json_ld", _A),
        T.StructField("values", T.MapType(_S, _S)),
        *[T.StructField(n, _A) for n in ("names", "statuses", "colors", "engines")],
        T.StructField("prices", T.StructType([T.StructField(n, T.DoubleType()) for n in ("msrp", "sale_price", "total_price")])),
        T.StructField("images", _A),
        T.StructField("description", _S),
        T.StructField("features", _A),
        T.StructField("inventory", T.BooleanType()),
        T.StructField("error", _S),
    ]
)
CARDS = T.ArrayType(T.StructType([T.StructField("detail_url", _S), T.StructField("title", _S), T.StructField("price", T.DoubleType())]))
_ARROW_FACTS = pa.struct(
    [("text", pa.string()), ("title", pa.string()), ("heading", pa.string()), ("json_ld", pa.list_(pa.string())), ("values", pa.map_(pa.string(), pa.string()))]
    + [(n, pa.list_(pa.string())) for n in ("names", "statuses", "colors", "engines")]
    + [("prices", pa.struct([(n, pa.float64()) for n in ("msrp", "sale_price", "total_price")])), ("images", pa.list_(pa.string())), ("description", pa.string()), ("features", pa.list_(pa.string())), ("inventory", pa.bool_()), ("error", pa.string())]
)


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def attempt(read: Callable, *page) -> tuple[object, str | None]:
    """What a function finds in a page, and no error; or nothing, and why. One page never fails the others."""
    try:
        return read(*page), None
    except (ValueError, AssertionError, RecursionError, LookupError, TypeError, OverflowError) as error:
        return None, f"{type(error).__name__}: {error}"[:300]


#: Pages of a batch whose trees, facts and results are held at a time.
PAGES_AT_ONCE = 64


def _of_pages(returns: T.DataType, kind: pa.DataType, read: Callable, *columns: str | Column) -> Column:
    """A column of what a function finds in each page; a batch goes a few pages at a time.

    Not deterministic for the optimizer: a condition on the column reads it, instead of
    parsing the pages a second time below it and before they are dealt out.
    """

    @F.arrow_udf(returns)
    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for batch in batches:
            for at in range(0, len(batch[0]), PAGES_AT_ONCE):
                yield pa.array([read(*page) for page in zip(*(c.slice(at, PAGES_AT_ONCE).to_pylist() for c in batch))], kind)

    return run.asNondeterministic()(*map(_c, columns))


def page_facts(html: str | Column, base: str | Column, url: str | Column, profile: str = "generic") -> Column:
    """One struct of all facts that need a document tree; a page is parsed once.

    ``error`` says why a page could not be read; the other facts are null then.
    """

    def read(h, b, u):
        found, error = attempt(dom.facts, h, b or "", u or "", profile)
        return {"error": error} if found is None else found | {"values": list(found["values"].items()), "error": None}

    return _of_pages(FACTS, _ARROW_FACTS, read, html, base, url)


def vehicle_cards(html: str | Column, base: str | Column, profile: str = "generic") -> Column:
    """H4: array of (detail_url, title, price); null if the page cannot be read."""

    def read(h, b):
        cards = attempt(dom.list_cards, h, b or "", profile)[0]
        return None if cards is None else [dict(zip(("detail_url", "title", "price"), c)) for c in cards]

    return _of_pages(CARDS, pa.list_(pa.struct([("detail_url", pa.string()), ("title", pa.string()), ("price", pa.float64())])), read, html, base)


def pagination(html: str | Column, url: str | Column) -> Column:
    """Array of the other pages' addresses; null if the page cannot be read."""
    return _of_pages(_A, pa.list_(pa.string()), lambda h, u: attempt(dom.page_links, h, u or "")[0], html, url)


def next_page(html: str | Column, url: str | Column) -> Column:
    return _of_pages(_S, pa.string(), lambda h, u: attempt(dom.next_link, h, u or "")[0], html, url)


def page_error(html: str | Column, base: str | Column, url: str | Column, profile: str = "generic") -> Column:
    """Why a page cannot be read, by the first of the page functions that fails; null if none does."""

    def all_of(h, b, u):
        root = dom.parse(h)
        dom.facts(root, b, u, profile), dom.list_cards(root, b, profile), dom.page_links(root, u), dom.next_link(root, u)

    return _of_pages(_S, pa.string(), lambda h, b, u: attempt(all_of, h, b or "", u or "")[1], html, base, url)


def page_text(html: str | Column) -> Column:
    """H2 without a tree: tags, comments, scripts and styles go; common entities are replaced."""
    text = F.regexp_replace(_c(html), r"(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>", "")
    text = F.regexp_replace(text, r"(?s)<[^>]*>", "")
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("\u00a0", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(sign))
    return text


def links(html: str | Column) -> Column:
    """All link targets of a page, by pattern."""
    return F.regexp_extract_all(_c(html), F.lit(r'(?i)<a\b[^>]*?\shref="([^"]*)"'), F.lit(1))


def json_ld(bodies: Column) -> Column:
    """H1: the first script body that is, or whose array holds, a vehicle; as VARIANT, else null."""
    one = lambda v: F.try_variant_get(v, '$["@type"]', "string").isin("Vehicle", "Car", "Automotive")
    parsed = F.filter(F.transform(bodies, lambda b: F.try_parse_json(b)), lambda v: v.isNotNull())
    flat = F.flatten(F.transform(parsed, lambda v: F.when(F.schema_of_variant(v).startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>")).otherwise(F.array(v))))
    return F.get(F.filter(flat, lambda v: F.coalesce(one(v), F.lit(False))), F.lit(0))


@F.arrow_udtf(returnType="page_url string, detail_url string, title string, price double, error string")
class CardsOfPages:
    """The cards of a table of pages (url, html, base), a batch of a partition at a time.

    A page that cannot be read gives one row with its error.
    """

    def eval(self, pages: pa.RecordBatch):
        column = lambda name: pages.column(pages.schema.get_field_index(name)).to_pylist()
        rows = []
        for url, html, base in zip(column("url"), column("html"), column("base")):
            cards, error = attempt(dom.list_cards, html, base or "", "generic")
            rows += [(url, *card, None) for card in cards] if error is None else [(url, None, None, None, error)]
        kinds = (pa.string(), pa.string(), pa.string(), pa.float64(), pa.string())
        yield pa.Table.from_arrays([pa.array([row[k] for row in rows], kind) for k, kind in enumerate(kinds)], ["page_url", "detail_url", "title", "price", "error"])


@F.udtf(returnType="page_url: string")
class PageLinks:
    """The other pages of one list page; none if it cannot be read."""

    def eval(self, html: str, url: str):
        yield from ((link,) for link in attempt(dom.page_links, html, url or "")[0] or ())


def register_table_functions(spark: SparkSession) -> None:
    """For SQL, ``cards_of_pages(TABLE(pages) PARTITION BY ...)`` and ``LATERAL page_links(html, url)``."""
    spark.udtf.register("cards_of_pages", CardsOfPages)
    spark.udtf.register("page_links", PageLinks)
