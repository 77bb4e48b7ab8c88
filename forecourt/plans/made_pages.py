"""Web pages of dealers made from ``supplier``: four detail pages and one list page for each.

As in ``views``, one SQL text serves both engines and only puts columns together; what the
operators must find in a page is known from the columns that it was made of.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .views import table

#: Text without any word that the extraction looks for, longer than a price's surroundings.
FILLER = "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor ut labore et dolore magna aliqua. " * 2

CARS = """
SELECT s_suppkey AS s, s_suppkey * 10 + i AS m, concat('Dealer ', CAST(s_suppkey AS STRING)) AS dealer_name,
  concat('https://d', CAST(s_suppkey AS STRING), '.net') AS dealer_website,
  concat('https://d', CAST(s_suppkey AS STRING), '.net/vehicle/', CAST(s_suppkey * 10 + i AS STRING)) AS url,
  CASE WHEN s_suppkey % 2 = 0 THEN 'Portland (East)' ELSE 'Vancouver Washington' END AS city,
  CAST(s_suppkey * 10 + i AS STRING) AS t, lpad(CAST((s_suppkey * 10 + i) % 1000 AS STRING), 3, '0') AS t3,
  CAST(2015 + (s_suppkey * 10 + i) % 10 AS INT) AS year,
  CASE (s_suppkey * 10 + i) % 4 WHEN 0 THEN 'Kia' WHEN 1 THEN 'Ford' WHEN 2 THEN 'Tesla' ELSE 'Hyundai' END AS make,
  CASE (s_suppkey * 10 + i) % 4 WHEN 0 THEN 'EV6' WHEN 1 THEN 'Escape' WHEN 2 THEN 'Model 3' ELSE 'IONIQ 5' END AS model,
  concat('1HGCM82', lpad(concat('X', CAST(s_suppkey * 10 + i AS STRING)), 10, '7')) AS vin
FROM {supplier} CROSS JOIN (SELECT 1 AS i UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) n
"""

DETAILS = """
SELECT s, m, url, dealer_name, dealer_website, city, concat('<html><head><title>Car page</title>', chr(10),
  CASE m % 5 WHEN 0 THEN '<script type="application/ld+json">{{"@type": "Vehicle", "fuelType": "Electric"}}</script>'
    WHEN 1 THEN '<script type="application/ld+json">[{{"@type": "Thing"}}, {{"@type": "Car", "fuelType": "Plug-In Hybrid"}}]</script>'
    WHEN 2 THEN '<script type="application/ld+json">{{bad</script>'
    WHEN 4 THEN '<script type="application/ld+json">{{"@type": "Other", "fuelType": "Diesel"}}</script>' ELSE '' END, '</head><body>', chr(10),
  '<h1>', CAST(year AS STRING), ' ', make, ' ', model, ' SEL</h1>', chr(10),
  CASE WHEN m % 7 = 0 THEN '' ELSE CASE m % 3 WHEN 0 THEN '<p>Condition: New</p>' WHEN 1 THEN '<p>a Used one</p>' ELSE '<p>Certified Pre-Owned here</p>' END END, chr(10),
  CASE m % 2 WHEN 0 THEN concat('<p>VIN: ', vin, '</p>') ELSE concat('<table><tr><th>VIN</th><td>', substr(vin, 1, 3), '-', substr(vin, 4), '</td></tr></table>') END, chr(10),
  CASE m % 2 WHEN 0 THEN concat('<p>Stock # S', t, '</p>') ELSE concat('<dl><dt>Stk #</dt><dd>S', t, '   b</dd></dl>') END, chr(10),
  CASE m % 3 WHEN 0 THEN concat('<p>1,', t3, ' miles</p>') WHEN 1 THEN concat('<dl><dt>Odometer</dt><dd>12', t3, ' km</dd></dl>') ELSE '' END, chr(10),
  '<p>', '{filler}', '</p>', chr(10), '<p class="price">MSRP: $45,', t3, '</p>', chr(10), '<p>', '{filler}', '</p>', chr(10), '<p>Our Price: $41,', t3, '</p>', chr(10), '<p>', '{filler}', '</p>', chr(10),
  CASE m % 2 WHEN 1 THEN concat('<p>Out the door: $43,', t3, '</p>') ELSE '' END, chr(10), '<p>', '{filler}', '</p>', chr(10),
  CASE m % 5 WHEN 2 THEN '<p>Fuel Type: Gasoline</p>' WHEN 3 THEN '<p>Motor: Battery Electric</p>' ELSE '' END, chr(10),
  CASE m % 2 WHEN 0 THEN '<p>Transmission: 8-Speed Automatic</p>' ELSE '' END, chr(10),
  CASE m % 3 WHEN 0 THEN '<p>Drivetrain: All-Wheel Drive</p>' WHEN 1 THEN '<p>with quattro</p>' ELSE '' END, chr(10),
  CASE m % 2 WHEN 0 THEN '<p>Body Style: SUV</p>' ELSE '<p>a fine Sedan</p>' END, chr(10),
  CASE m % 4 WHEN 0 THEN '<p>In Stock</p>' WHEN 1 THEN '<p>Sold</p>' WHEN 2 THEN '<p>On the Way</p>' ELSE '' END, chr(10),
  CASE m % 4 WHEN 1 THEN '<dl><dt>Exterior:</dt><dd>Blue exterior</dd></dl>' WHEN 3 THEN '' ELSE '<p>Ext. Color: Red</p>' END, chr(10),
  CASE m % 2 WHEN 0 THEN '<p>Interior Color: Black</p>' ELSE '' END, chr(10),
  '<div class="vehicle-description">A quiet and roomy ride with a long list of extras, number ', t, '.</div>', chr(10),
  '<ul class="features"><li class="feature">Heated seats</li><li>x</li><li>Camera ', t, '</li></ul>', chr(10),
  '<img src="/vehicle/', t, '.jpg"><img src="/logo.png">', chr(10), '</body></html>') AS html
FROM ({cars}) c
"""

_CARD = """CASE WHEN s_suppkey % 5 >= {i} THEN concat('<div class="vehicle-card"><a href="/vehicle/', CAST(s_suppkey * 10 + {i} AS STRING), '"><h3>2024 Kia {i}</h3></a><span class="price">MSRP $4{i},', lpad(CAST(s_suppkey % 1000 AS STRING), 3, '0'), '</span></div>') ELSE '' END"""

LISTS = f"""
SELECT s_suppkey AS s, concat('https://d', CAST(s_suppkey AS STRING), '.net/inventory') AS url, concat('https://d', CAST(s_suppkey AS STRING), '.net') AS base,
  concat('<html><body><h2>All vehicles</h2>', {", chr(10), ".join(_CARD.format(i=i) for i in range(1, 5))},
  '<a href="/contact">2024 contact</a><div class="pagination"><a href="?page=2">2</a> <a class="next" href="?page=3">next</a></div></body></html>') AS html
FROM {{supplier}}
"""


def _whole(view: str) -> str:
    return view.replace("{cars}", CARS).replace("{filler}", FILLER)


def duckdb(view: str) -> str:
    return _whole(view).format(supplier="supplier")


def _made(spark: SparkSession, sf_dir: str, view: str, deal: bool = False) -> DataFrame:
    """``deal``: suppliers are dealt out before their pages are made, which then take no exchange and no sort in one task."""
    suppliers = table(spark, sf_dir, "supplier")
    return spark.sql(_whole(view), supplier=suppliers.repartition(spark.sparkContext.defaultParallelism) if deal else suppliers)


def details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dealt out, since many pages come from a small table and each is parsed in Python."""
    return _made(spark, sf_dir, DETAILS, deal=True)


def lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dealt out like ``details``."""
    return _made(spark, sf_dir, LISTS, deal=True)


def dealers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, name, website, new_inventory_url, city); a third knows its inventory's address."""
    return _made(
        spark,
        sf_dir,
        """SELECT s_suppkey AS id, concat('Dealer ', CAST(s_suppkey AS STRING)) AS name, concat('https://d', CAST(s_suppkey AS STRING), '.net') AS website,
        CASE WHEN s_suppkey % 3 = 0 THEN concat('https://d', CAST(s_suppkey AS STRING), '.net/all') END AS new_inventory_url,
        CASE WHEN s_suppkey % 2 = 0 THEN 'Portland (East)' ELSE 'Vancouver Washington' END AS city FROM {supplier}""",
    )
