"""Page functions over deep, damaged and hostile pages; the closure of next links."""

from __future__ import annotations

import random
import time

import pytest
from forecourt.functions import dom, html
from forecourt.functions.html import page_error, page_facts, vehicle_cards
from forecourt.plans import page_queries
from forecourt.plans import pages as plan
from forecourt.plans.catalogue import QUERIES
from pyspark.sql import functions as F

GOOD = '<div class="vehicle-card"><a href="/vehicle/1"><h3>2024 Kia</h3></a><span class="price">$41,000</span></div>' * 2


@pytest.mark.parametrize("page", ["<div>{n}Stock # 1 x", "<div class='feature vehicle-card price'>{n}In Stock $4", "<template><b>{n}x</b>", "<table><tr><th>{n}VIN"])
def test_work_is_linear_in_depth(page):
    took = []
    for n in (2000, 20_000):
        tag, rest = page.split("{n}")
        began = time.process_time()
        dom.facts(tag * n + rest + "</p></div>" * n, "https://d", "https://d/x")
        dom.list_cards(tag * n + rest, "https://d")
        took.append(time.process_time() - began)
    assert took[1] < 40 * max(took[0], 0.05)


def by_hand(node):
    """Visible text below an element, walked."""
    return "".join(x if isinstance(x, str) else "" if x.name in ("script", "style", "template") else by_hand(x) for x in node.children)


def test_slices_are_the_texts_of_elements():
    r = random.Random(4)
    tags = "div p ul li table tr th td dt dd script style template h1 title br img a".split()
    for _ in range(300):
        parts, open_tags = [], []
        for _ in range(r.choice([3, 30, 120])):
            if r.random() < 0.4:
                open_tags.append(r.choice(tags))
                parts.append(f"<{open_tags[-1]} class='{r.choice(['', 'price', 'a B'])}'>")
            elif open_tags and r.random() < 0.5:
                parts.append(f"</{open_tags.pop() if r.random() < 0.8 else r.choice(tags)}>")
            else:
                parts.append(r.choice([" VIN: 1 ", "Stock #", "İ", "x", " ", "$3"]))
        root = dom.parse("".join(parts))
        for node in root.walk():
            assert node.text() == by_hand(node)
            below = [x for x in node.walk()]
            assert all(any(p is node for p in _parents(x)) for x in below)
            for field in ("vin", "price", "stock_number"):
                assert node.holds_keyword(field) == dom.has_keyword(node.joined(), field)


def _parents(node):
    while node.parent is not None:
        node = node.parent
        yield node


def test_a_bad_page_is_listed_and_leaves_the_others(spark, monkeypatch):
    rows = [(f"https://d/{i}", GOOD) for i in range(5)] + [("https://d/null", None), ("https://d/bad", "<![if x]><div" + "<a" * 40), ("https://d/deep", "<div class='item'>" * 20_000 + "In Stock")]
    frame = spark.createDataFrame(rows, "url string, html string").repartition(2)
    assert plan.failed_pages(frame).count() == 0
    found = frame.select("url", F.size(vehicle_cards("html", "url")).alias("n"), page_facts("html", "url", "url")["error"].alias("error")).collect()
    assert {r.url: r.n for r in found}["https://d/3"] == 2 and all(r.error is None for r in found)
    real = dom.facts

    def failing(page, *rest):
        if page and "Kia" in page:
            raise dom.PageTooComplex("made up")
        return real(page, *rest)

    monkeypatch.setattr(dom, "facts", failing)
    read = html.attempt(dom.facts, GOOD, "", "")
    assert read == (None, "PageTooComplex: made up") and html.attempt(dom.facts, "<p>x", "", "", "generic")[1] is None


def test_too_much_work_is_an_error_of_that_page(monkeypatch):
    monkeypatch.setattr(dom, "MOST_STEPS", 10)
    monkeypatch.setattr(dom, "STEPS_PER_ELEMENT", 1)
    value, error = html.attempt(dom.facts, GOOD * 5, "https://d", "https://d/x")
    assert value is None and error.startswith("PageTooComplex")


def test_failed_facts_are_null_with_an_error(spark):
    row = spark.range(1).select(page_error(F.lit(GOOD), F.lit("https://d"), F.lit("https://d/x")).alias("e")).first()
    assert row.e is None


def walk(starts, after, most):
    out = []
    for i, at in starts:
        seen = [at]
        while after.get(at) is not None and after[at] not in seen and len(seen) <= most:
            at = after[at]
            seen.append(at)
            out.append((i, len(seen) - 1, at))
    return sorted(out, key=str)


@pytest.mark.parametrize("most", [1, 2, 7, 50])
def test_closure_against_a_walk(spark, most):
    r = random.Random(most)
    after = {f"u{i}": r.choice([None, f"u{r.randrange(90)}", f"u{i + 1}"]) for i in range(80)} | {"s": "s"}
    starts = [(n, f"u{r.randrange(85)}") for n in range(40)] + [(1, "u3"), (1, "u3"), (2, "nowhere"), (3, None), (4, "s")]
    got = plan.follow(spark.createDataFrame(starts, "id long, url string"), spark.createDataFrame(list(after.items()), "url string, next_url string"), most)
    assert sorted(map(tuple, got.collect()), key=str) == walk([s for s in starts if s[1]], after, most)


def test_closure_of_many_cycles(spark):
    """Cycles of 50 pages: 49 steps from each."""
    edges = spark.range(2000).select(F.col("id"), F.concat(F.lit("u"), "id").alias("url"), F.concat(F.lit("u"), F.floor(F.col("id") / 50) * 50 + (F.col("id") + 1) % 50).alias("next_url"))
    assert plan.follow(edges.select("id", "url"), edges).count() == 2000 * 49


def _parses(frame) -> int:
    return frame._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython")


def test_a_condition_on_facts_parses_pages_once(spark, data):
    """Not below the exchange as well, where all pages of a small table are one task's."""
    assert _parses(page_queries.extracted(spark, data).select("vehicle_url", "vin")) == 1


def test_pages_of_more_than_one_slice_keep_their_order(spark):
    n = 2 * html.PAGES_AT_ONCE + 3
    pages = spark.range(0, n, 1, 1).select("id", F.concat(F.lit("<h1>"), "id", F.lit("</h1>")).alias("h"))
    got = pages.select("id", page_facts("h", F.lit(""), F.lit(""))["heading"].alias("heading")).collect()
    assert [(r.id, r.heading) for r in got] == [(i, str(i)) for i in range(n)]


def test_only_candidates_are_parsed_for_inventories(spark):
    """A page that is no dealer's candidate goes away before the parser sees it."""
    dealers = spark.createDataFrame([("a", "https://a", None), ("b", "https://b", "https://b/all")], "id string, website string, new_inventory_url string")
    pages = spark.createDataFrame([("https://a/new", "<p>Browse</p>"), ("https://a/vehicle/1", "<p>Browse</p>")], "url string, html string")
    found = plan.inventory_urls(dealers, pages)
    assert sorted(map(tuple, found.collect())) == [("a", "https://a/new"), ("b", "https://b/all")]
    shown = found._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in shown[shown.index("ArrowEvalPython") :]


def test_pages_are_made_after_suppliers_are_dealt_out(spark, data):
    """No exchange and no one task holds the pages' texts."""
    for made in (page_queries.M.details, page_queries.M.lists):
        shown = made(spark, data)._jdf.queryExecution().optimizedPlan().toString()
        assert "<html>" in shown[: shown.index("Repartition ")] and "<html>" not in shown[shown.index("Repartition ") :]


def test_only_wanted_columns_are_computed(spark, data):
    """A query of images plans no other column's cascade; rows are those of whole listings."""
    patterns = lambda rows: rows._jdf.queryExecution().optimizedPlan().toJSON().count("expressions.RegExpExtract\"")
    whole = page_queries.extracted(spark, data)
    assert 4 * patterns(QUERIES["h6_images"](spark, data)) < patterns(whole.select("vehicle_url", "images"))
    rows = whole.collect()
    for some in (("fuel_type", "vehicle_url"), ("mileage_units", "vin", "year"), ("images", "dealer_location_city")):
        got = page_queries.extracted(spark, data, only=some)
        named = [c for c in whole.columns if c in some]
        assert got.columns == named and sorted(map(tuple, got.collect())) == sorted(tuple(r[c] for c in named) for r in rows)
    with pytest.raises(ValueError, match="vim"):
        page_queries.extracted(spark, data, only=("vim",))


def test_short_ways_lead_to_the_same_end(monkeypatch):
    """Plain tags and labels, found quickly, are those that the parser and the patterns find."""
    r = random.Random(8)
    bits = ['<div class="price" id="">', "<DIV CLASS=x>", '<a href="/vehicle/1?a&amp;b" rel=next>', "</a>", "</div >", "<p", '<img src="a>b.jpg" alt="x">', "<br/>", '<p class="x" class="y">', '<script type="a">', "</script>", "<title>", "</title>", "<noscript>", "VIN: 1", "Sold :\n x", "Sold<", "available\n<", "ſold", "Exterior:", "<dt>", "<dd>", "<", ">", '"']
    pages = ["".join(r.choice(bits) for _ in range(r.choice([3, 12, 60]))) for _ in range(400)]
    tree = lambda root: [(n.name, n.attributes, n.number, n.end, n.enter, n.leave) for n in root.page.order]
    short = [(tree(dom.parse(p)), dom.facts(p, "https://d", "https://d/x")) for p in pages]
    calls = []
    monkeypatch.setattr(dom._Builder, "parse_starttag", lambda self, i: calls.append(i) or dom.HTMLParser.parse_starttag(self, i))
    monkeypatch.setattr(dom._Builder, "parse_endtag", dom.HTMLParser.parse_endtag)
    monkeypatch.setattr(dom, "_written", lambda text, field, low: dom._WRITTEN[field].search(text))
    assert short == [(tree(dom.parse(p)), dom.facts(p, "https://d", "https://d/x")) for p in pages] and calls
