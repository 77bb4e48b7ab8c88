"""Truth tables of the operators, and duplicates against a sequential fold."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from forecourt.functions import columns as P
from forecourt.functions import dom
from forecourt.functions import extract as X
from forecourt.functions import normalize as N
from forecourt.operators import dedup, filters, quality
from forecourt.operators.filters import FilterSpec
from forecourt.schema import COLUMNS, LISTING, is_constructible
from forecourt.sources import dealers, listings, sinks
from forecourt.sources.config import RunSpec
from pyspark.sql import functions as F

BASE = {"dealer_name": "D", "dealer_website": "https://d.net", "vehicle_url": "https://d.net/1", "year": 2024, "make": "Kia", "model": "EV6", "new_used": "new", "currency": "USD", "mileage_units": "mi", "features": [], "images": [], "scraped_at": dt.datetime(2024, 1, 1)}


def rows(spark, *changes):
    return spark.createDataFrame([tuple((BASE | c).get(n) for n in COLUMNS) for c in changes], LISTING)


def column(df, c):
    return [r[0] for r in df.select(c).collect()]


def values(spark, make, *texts):
    return column(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i"), make(F.col("t")))


def test_price(spark):
    df = rows(spark, {"sale_price": 0.0, "total_price": 5.0}, {}, {"sale_price": 0.0, "total_price": 0.0, "msrp": 0.0}, {"msrp": 9.0})
    assert column(df, P.price()) == [5.0, 0.0, 0.0, 9.0]


def test_is_new(spark):
    df = rows(spark, {"year": 2022}, {"year": 2023}, {"mileage": 200}, {"mileage": 201}, {"new_used": "used", "mileage": 0})
    assert column(df, P.is_new(2024)) == [False, True, True, False, False]


@pytest.mark.parametrize(
    ("spec", "changes", "kept"),
    [
        ({"is_electric": True}, [{}, {"fuel_type": "BEV"}, {"fuel_type": "hybrid"}], [False, True, False]),
        ({"is_electric": True, "fuel_types": []}, [{"fuel_type": "ev"}, {"fuel_type": "hybrid"}], [True, False]),
        ({"is_electric": True, "fuel_types": ["Hybrid"]}, [{"fuel_type": "ev"}, {"fuel_type": "hybrid"}, {}], [True, True, False]),
        ({"max_price": 60000}, [{"msrp": 60000.0}, {"msrp": 60000.01}, {}, {"msrp": float("nan")}], [True, False, True, True]),
        ({"min_price": 1}, [{}, {"msrp": 2.0}], [False, True]),
        ({"drivetrains": ["awd"]}, [{}, {"drivetrain": ""}, {"drivetrain": "Awd"}, {"drivetrain": "FWD"}], [True, True, True, False]),
        ({"exclude_drivetrains": ["awd"]}, [{}, {"drivetrain": "AWD"}], [True, False]),
        ({"states": ["OR"]}, [{}, {"dealer_location_state": ""}, {"dealer_location_state": "WA"}], [True, True, False]),
        ({"exclude_status": None}, [{}, {"in_stock_status": "sold"}], [True, False]),
        ({"availability_status": ["available"]}, [{}, {"in_stock_status": ""}, {"in_stock_status": "available"}], [False, False, True]),
        ({"makes": []}, [{}], [False]),
    ],
)
def test_filters(spark, spec, changes, kept):
    df = rows(spark, *[c | {"stock_number": str(i)} for i, c in enumerate(changes)])
    got = {r.stock_number for r in filters.filter_listings(df, FilterSpec.everything(**spec), as_of_year=2024).collect()}
    assert got == {str(i) for i, k in enumerate(kept) if k}


def fold(items, latest):
    """The sequential rule: VINs first, then addresses; the newer one replaces."""
    out, by_vin, by_url, n_vin, n_url = [], {}, {}, 0, 0
    better = lambda new, old: latest and old[3] is not None and new[3] is not None and new[3] > old[3]

    def replace(table, key, new):
        if better(new, table[key]):
            out[:] = [x for x in out if x is not table[key]] + [new]
            table[key] = new

    for item in items:
        vin, url = item[1], item[2].strip().lower()
        key = vin.strip().upper() if vin else None
        if key is not None and key in by_vin:
            n_vin += 1
            replace(by_vin, key, item)
            continue
        if key is not None:
            by_vin[key] = item
        if url in by_url:
            n_url += 1
            replace(by_url, url, item)
            continue
        by_url[url] = item
        out.append(item)
    return out, n_vin, n_url


def test_dedup_special_case(spark):
    """A newer row of a VIN comes back although the VIN's first row lost on its address."""
    t = dt.datetime
    df = rows(
        spark,
        {"vin": "A", "vehicle_url": "https://u/1", "scraped_at": t(2024, 1, 5), "stock_number": "0"},
        {"vin": "B", "vehicle_url": "https://U/1 ", "scraped_at": t(2024, 1, 1), "stock_number": "1"},
        {"vin": "b ", "vehicle_url": "https://u/2", "scraped_at": t(2024, 1, 9), "stock_number": "2"},
    )
    assert {r.stock_number for r in dedup.deduplicate(df, ["stock_number"]).collect()} == {"0", "2"}
    assert dedup.dedup_stats(df, ["stock_number"]).first().asDict() == {"total": 3, "duplicates_by_vin": 1, "duplicates_by_url": 1, "final": 2}


@pytest.mark.parametrize("latest", [True, False])
def test_dedup_counts_against_fold(spark, latest):
    r = random.Random(5)
    items = [(i, r.choice([None, "", "a", "A ", "b", "c", "d"]), r.choice(["u", "U", "v", "w ", "x"]), r.choice([None, *(dt.datetime(2024, 1, k) for k in range(1, 9))])) for i in range(60)]
    df = rows(spark, *[{"stock_number": f"{i:03}", "vin": v, "vehicle_url": u, "scraped_at": s} for i, v, u, s in items])
    stats = dedup.dedup_stats(df, ["stock_number"], latest).first()
    _, n_vin, n_url = fold(items, latest)
    assert (stats.duplicates_by_vin, stats.duplicates_by_url) == (n_vin, n_url)
    if not latest:
        assert {int(x.stock_number) for x in dedup.deduplicate(df, ["stock_number"], False).collect()} == {x[0] for x in fold(items, False)[0]}


def issues(spark, strict=False, **change):
    row = quality.validate(rows(spark, {"fuel_type": "electric", "msrp": 50000.0, "vin": "1HGCM82633A004352"} | change), as_of_year=2024, strict=strict).first()
    return row.is_valid, row.issues


def test_validation(spark):
    assert issues(spark) == (True, [])
    assert issues(spark, year=2014)[1] == ["Year too old for electric vehicle: 2014"]
    assert issues(spark, msrp=4999.0)[1][0] == "Suspiciously low price: $4,999"
    assert issues(spark, msrp=None)[0] and not issues(spark, strict=True, msrp=None)[0]
    assert issues(spark, mileage=501)[1] == ["WARNING: High mileage for new car: 501"]
    assert issues(spark, trim="Demo")[1] == ["Appears to be test/placeholder data"]
    assert issues(spark, msrp=90000.0)[1] == ["WARNING: Price $90,000 seems high for Kia EV6 (typical: $25,200-$84,500)"]
    assert issues(spark, vin="")[1] == [] and issues(spark, strict=True, vin=None)[1] == ["WARNING: Missing VIN (harder to verify uniqueness)"]


def test_constraints(spark):
    df = rows(spark, {}, {"year": 1899}, {"year": 2025}, {"year": 2026}, {"new_used": ""}, {"mileage": -1}, {"make": None}, {"msrp": -1.0})
    assert column(df, is_constructible(2024)) == [True, False, True, False, False, False, False, False]


def test_normalisation(spark):
    assert values(spark, N.drivetrain, "All-Wheel Drive", "has Quattro", "front wheel drive", "x", None) == ["AWD", "AWD", "FWD", None, None]
    assert values(spark, N.fuel, "Plug-In Hybrid", "BEV", "Flex Fuel", "Chevrolet", None) == ["phev", "electric", None, "electric", None]
    assert values(spark, N.condition, "Pre-Owned", "Pre Owned", "Certified", "CPO", None) == ["used", "new", "cpo", "cpo", "new"]
    assert values(spark, N.price_to_int, "32,995.50", "x", None) == [32995, None, None]


def test_titles(spark):
    got = values(spark, X.title_parts, "2025 Hyundai IONIQ 5 SEL", "New 2024 Kia EV6", "2024 Land Rover Defender", "kia soul", "", None)
    assert [(r.year, r.make, r.model) if r else None for r in got] == [(2025, "Hyundai", "IONIQ 5 SEL"), (2024, "Kia", "EV6"), (2024, "Land Rover", "Rover Defender"), (None, None, None), (None, None, None), (None, None, None)]


PAGE = """<html><head><title>Used car</title><script type="application/ld+json">{bad</script>
<script type="application/ld+json">[{"@type": "Car", "fuelType": "Electric"}]</script></head>
<body><h1>2024 Kia EV6 Wind</h1><p class="price">MSRP: $45,000</p><p>Our price is lower than that of all of the other sellers in town: $41,500</p>
<dl><dt>Odometer</dt><dd>120 km</dd></dl><p>Ext. Color: Red</p>
<p>12&nbsp;mi</p>
<div class="vehicle-description">A very nice and quite long description of this electric vehicle.</div>
<ul class="features"><li>Heated seats</li><li>x</li></ul><img src="/vehicle/1.jpg"><img src="/logo.png"></body></html>"""


def test_detail_page(spark):
    pages = spark.createDataFrame([("https://d.net/v/1", PAGE, "D", "https://d.net", "Portland (Beaverton area)")], "url string, html string, dealer_name string, dealer_website string, city string")
    row = X.listings_of_pages(pages, as_of_year=2024, scraped_at=F.lit("2024-01-01 00:00:00")).first()
    assert (row.year, row.make, row.model, row.fuel_type, row.mileage) == (2024, "Kia", "EV6 Wind", "electric", 12)
    assert (row.msrp, row.sale_price, row.total_price) == (45000.0, 41500.0, 41500.0)
    assert row.images == ["https://d.net/vehicle/1.jpg"] and row.features == ["Heated seats"]
    assert (row.exterior_color, row.dealer_location_city, row.dealer_location_state) == ("Red", "Portland", "OR")


def test_list_page_and_pagination():
    html = '<div class="vehicle-card"><a href="/v/1"><h3>2024 Kia</h3></a><span class="price">$10,000</span></div><div class="vehicle-card"><a href="tel:1">x</a></div><a class="next" href="?page=2">next</a>'
    assert dom.list_cards(html, "https://d.net") == [("https://d.net/v/1", "2024 Kia", 10000.0)]
    assert dom.page_links(html, "https://d.net/inventory") == ["https://d.net/inventory?page=2"]
    assert len(dom.page_links("", "https://d.net/i?page=1")) == 196
    assert dom.next_link(html, "https://d.net/i") == "https://d.net/i?page=2"
    assert dom.list_cards(None, "") == []


def test_csv_round_trip_and_config(spark, tmp_path):
    df = rows(spark, {"description": 'a "b"\nc', "features": ["x", "y"], "msrp": 1.5}, {"trim": "SEL", "vehicle_url": "https://d.net/2"})
    sinks.save(df, str(tmp_path / "cars.csv"))
    back = {r.vehicle_url: r for r in listings.read_csv(spark, str(tmp_path / "cars.csv"), as_of_year=2024).collect()}
    assert back["https://d.net/1"].description == 'a "b" c' and back["https://d.net/1"].features == ["x", "y"]
    assert back["https://d.net/2"].trim == "SEL" and back["https://d.net/2"].scraped_at == BASE["scraped_at"]
    sinks.save(df, str(tmp_path / "cars.json"))
    assert listings.read_json(spark, str(tmp_path / "cars.json"), as_of_year=2024).count() == 2
    assert sinks.count_saved(spark, str(tmp_path / "cars.json"), "json") == 2 == sinks.count_saved(spark, str(tmp_path / "cars.csv"), "csv")
    spec = RunSpec.from_dict({"max_price": 5, "electric_only": False, "unknown": 1}, max_price=7)
    assert spec.filter.max_price == 7 and not spec.filter.is_electric
    spec.save(str(tmp_path / "c.json"))
    assert RunSpec.from_file(str(tmp_path / "c.json")).filter.max_price == 7


def test_dealers(spark, tmp_path):
    (tmp_path / "d.csv").write_text("Dealership Name,Website,City\nA (B),https://a.net/,Portland\n,https://b.net,X\nC,ftp://c,X\n")
    assert [tuple(r)[1:] for r in dealers.read_dealers(spark, str(tmp_path / "d.csv")).collect()] == [("a_b", "A (B)", "https://a.net", None, "Portland")]
    (tmp_path / "e.csv").write_text("x,y\n1,2\n")
    with pytest.raises(ValueError, match="header"):
        dealers.read_dealers(spark, str(tmp_path / "e.csv"))


def test_command_line(spark, tmp_path, monkeypatch, capsys):
    """Listings to listings, with settings, an explicit option on top, appending, and what goes wrong."""
    from forecourt.__main__ import main

    monkeypatch.chdir(tmp_path)
    cars = [{"vehicle_url": f"https://d.net/{k}", "vin": f"1HGCM82X00000{k:04}".replace("0000", "4444"), "fuel_type": "electric", "msrp": 20000.0 + 10000 * k, "mileage": 10} for k in range(5)]
    at = lambda name: str(tmp_path / name)  # noqa: E731 - Spark has a working folder of its own
    sinks.save(rows(spark, *cars), at("in.csv"))
    assert main(["--create-config", "c.json"]) == 0
    assert main(["--as-of-year", "2024"]) == 2
    assert main(["--input", at("in.csv"), "--as-of-year", "2024", "--config", "none.json"]) == 1
    args = ["--input", at("in.csv"), "--as-of-year", "2024", "--config", "c.json", "--output", at("out.jsonl"), "--log-file", "run.log"]
    assert main([*args, "--max-price", "35000"], spark) == 0
    assert sinks.count_saved(spark, at("out.jsonl"), "jsonl") == 2
    assert main([*args, "--append"], spark) == 0
    assert sinks.count_saved(spark, at("out.jsonl"), "jsonl") == 2 + 5
    assert "5 kept" in (tmp_path / "run.log").read_text()


def test_command_line_of_pages(spark, tmp_path, monkeypatch):
    from forecourt.__main__ import main

    monkeypatch.chdir(tmp_path)
    at = lambda name: str(tmp_path / name)
    (tmp_path / "d.csv").write_text("id,name,base_url,city\na,A,https://a.net,Portland\nb,B,https://b.net,X\n")
    spark.createDataFrame([("https://a.net/v/1", PAGE), ("https://b.net/v/1", PAGE), ("https://a.network/v/1", PAGE)], "url string, html string").write.parquet(at("pages"))
    args = ["--pages", at("pages"), "--dealers", at("d.csv"), "--as-of-year", "2024", "--output", at("out.csv"), "--include-used"]
    assert main(args, spark) == 0 and sinks.count_saved(spark, at("out.csv"), "csv") == 2
    assert main([*args, "--site", "b"], spark) == 0 and sinks.count_saved(spark, at("out.csv"), "csv") == 1
    with pytest.raises(ValueError, match="unknown sites"):
        main([*args, "--site", "zzz"], spark)


def test_rows_equal_in_their_order(spark):
    """Of rows that the order does not tell apart one stays; a key that holds most rows is no matter."""
    df = rows(spark, *[{"vin": "A", "stock_number": "7"}] * 30, {"vin": None, "vehicle_url": "https://d.net/2", "stock_number": "8"}, {"vin": "", "vehicle_url": "https://d.net/2", "stock_number": "9"})
    assert sorted(r.stock_number for r in dedup.deduplicate(df, ["stock_number"]).collect()) == ["7", "8"]
    assert sorted(r.stock_number for r in dedup.deduplicate_by_vin(df, ["stock_number"]).collect()) == ["7", "8", "9"]
    assert dedup.dedup_stats(df, ["stock_number"]).first().total == 32
    assert dedup.deduplicate(df.limit(0), ["stock_number"]).count() == 0


def test_empty_outputs(spark, tmp_path):
    nothing = rows(spark, {}).limit(0)
    for kind in ("csv", "json", "jsonl"):
        sinks.save(nothing, str(tmp_path / f"x.{kind}"))
        assert sinks.count_saved(spark, str(tmp_path / f"x.{kind}"), kind) == 0
    assert listings.read_csv(spark, str(tmp_path / "x.csv"), as_of_year=2024).count() == 0


def test_title_parts_of_long_names_are_computed_once(spark):
    """A title's steps are not copied into each other: one make search a title, however many parts are read."""
    rows = spark.createDataFrame([(["New 2024 Kia EV6", "Used", None, "Land Rover 2024 Defender 90"],)], "names array<string>")
    parts = rows.select(F.transform("names", X.title_parts).alias("parts"))
    plan = parts._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_extract(") == 1 and plan.count("split(") == 1
    assert [(p.year, p.make, p.model) for p in parts.head().parts] == [(2024, "Kia", "EV6"), (None, None, None), (None, None, None), (2024, "Land Rover", "Rover Defender 90")]


def test_valid_rows_are_judged_without_messages(spark):
    """valid_only composes no message or warning and joins no price range, and keeps what validate calls valid."""
    fields = {c: None for c in COLUMNS} | {"dealer_name": "D", "dealer_website": "https://d", "vehicle_url": "https://d/1", "year": 2024, "make": "Kia", "model": "EV6", "new_used": "new", "fuel_type": "electric", "sale_price": 41000.0}
    odd = [{}, {"trim": "Demo"}, {"make": "te", "model": "st EV"}, {"trim": "te", "vin": "st"}, {"year": 2014}, {"sale_price": None}, {"fuel_type": "gasoline"}, {"fuel_type": None, "model": "Soul"}, {"mileage": 300001}, {"vin": "ABC000000"}, {"model": None}, {"dealer_name": None}]
    rows = spark.createDataFrame([tuple((fields | o)[c] for c in COLUMNS) for o in odd], LISTING).withColumn("n", F.monotonically_increasing_id())
    for strict in (False, True):
        kept = quality.valid_only(rows, as_of_year=2024, strict=strict)
        plan = kept._jdf.queryExecution().analyzed().toString()
        assert "seems low" not in plan and "Join" not in plan
        wanted = quality.validate(rows, as_of_year=2024, strict=strict).where("is_valid")
        assert sorted(r.n for r in kept.select("n").collect()) == sorted(r.n for r in wanted.select("n").collect()) != []
