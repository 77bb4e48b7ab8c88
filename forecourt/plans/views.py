"""Listings and page texts derived from the generic test tables.

One SQL text per view serves Spark and the SQL oracle; {row}, {array} and the tables'
names are filled in for either. It only maps columns: the operators under test are
written twice, as DataFrame code and as SQL, on top of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages")

LISTINGS = """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  {row}(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus) AS ord,
  concat('Dealer ', CAST(s_suppkey AS STRING)) AS dealer_name,
  concat(CASE WHEN s_suppkey % 29 = 0 THEN 'ftp://' ELSE 'https://' END, 'dealer', CAST(s_suppkey AS STRING), '.net') AS dealer_website,
  concat(CASE WHEN l_partkey % 97 = 0 THEN 'www.d/' WHEN l_linenumber = 3 THEN ' https://D/' ELSE 'https://d/' END, CAST(l_suppkey AS STRING), '/', CAST(l_partkey AS STRING)) AS vehicle_url,
  CAST(2014 + l_partkey % 14 AS INT) AS year,
  CASE CAST(substr(p_brand, 7) AS INT) % 6 WHEN 0 THEN 'Tesla' WHEN 1 THEN 'Hyundai' WHEN 2 THEN 'Kia' WHEN 3 THEN 'Ford' WHEN 4 THEN 'Chevrolet' ELSE 'Nissan' END AS make,
  CASE CAST(substr(p_brand, 7) AS INT) % 6
    WHEN 0 THEN CASE p_size % 4 WHEN 0 THEN 'Model 3' WHEN 1 THEN 'Model Y' WHEN 2 THEN 'Cybertruck' ELSE 'Unknown' END
    WHEN 1 THEN CASE p_size % 4 WHEN 0 THEN 'IONIQ 5' WHEN 1 THEN 'Kona Electric' WHEN 2 THEN 'Tucson' ELSE 'Santa Fe' END
    WHEN 2 THEN CASE p_size % 4 WHEN 0 THEN 'EV6' WHEN 1 THEN 'EV9' WHEN 2 THEN 'Sorento' ELSE 'Seltos' END
    WHEN 3 THEN CASE p_size % 4 WHEN 0 THEN 'Mustang Mach-E' WHEN 1 THEN 'F-150 Lightning' WHEN 2 THEN 'Escape' ELSE 'Bronco' END
    WHEN 4 THEN CASE p_size % 4 WHEN 0 THEN 'Bolt' WHEN 1 THEN 'Equinox EV' WHEN 2 THEN 'Malibu' ELSE 'Tahoe' END
    ELSE CASE p_size % 4 WHEN 0 THEN 'Ariya' WHEN 1 THEN 'Leaf' WHEN 2 THEN 'Rogue' ELSE 'Altima' END END AS model,
  CASE WHEN p_size % 5 = 0 THEN NULL WHEN p_size % 5 = 1 THEN 'SEL' WHEN p_size % 25 = 7 THEN 'Demo' ELSE 'GT' END AS trim,
  CASE l_returnflag WHEN 'N' THEN 'new' WHEN 'A' THEN 'used' ELSE 'cpo' END AS new_used,
  CASE p_type WHEN 'ECONOMY' THEN 'electric' WHEN 'SMALL' THEN 'phev' WHEN 'MEDIUM' THEN 'hybrid' WHEN 'LARGE' THEN 'gasoline' WHEN 'PROMO' THEN 'BEV' END AS fuel_type,
  CASE p_size % 6 WHEN 1 THEN 'AWD' WHEN 2 THEN 'fwd' WHEN 3 THEN 'RWD' WHEN 4 THEN '4WD' WHEN 5 THEN '' END AS drivetrain,
  CASE WHEN p_size % 3 = 0 THEN 'Automatic' END AS transmission,
  CASE WHEN p_size % 2 = 0 THEN 'SUV' ELSE 'Sedan' END AS body_style,
  CASE WHEN l_orderkey % 41 = 0 THEN NULL WHEN l_quantity = 50 THEN l_extendedprice * 4 ELSE l_extendedprice END AS msrp,
  CASE WHEN l_orderkey % 41 = 0 OR l_discount = 0 THEN NULL ELSE l_extendedprice * (1 - l_discount) END AS sale_price,
  CASE WHEN l_orderkey % 41 = 0 THEN 0.0E0 WHEN l_tax = 0.08E0 THEN l_extendedprice * 1.05E0 END AS total_price,
  'USD' AS currency, CAST(NULL AS STRING) AS price_note,
  CASE WHEN l_partkey % 10 = 0 THEN CASE WHEN l_linenumber = 5 THEN '' END
    ELSE concat(CASE l_linenumber WHEN 4 THEN ' ' ELSE '' END, CASE WHEN l_partkey % 3 = 0 THEN 'VIN' WHEN l_linenumber = 2 THEN '1hg' ELSE '1HG' END, lpad(CAST(l_partkey * 3 + l_suppkey % 3 AS STRING), 14, CASE WHEN l_partkey % 7 = 0 THEN '0' ELSE '4' END)) END AS vin,
  concat('S', CAST(l_orderkey AS STRING)) AS stock_number,
  CASE WHEN l_quantity < 5 THEN NULL WHEN l_returnflag = 'N' THEN CAST(l_quantity * 5 AS INT) * CASE WHEN l_tax > 0.06E0 THEN 10 ELSE 1 END ELSE CAST(l_quantity * 7000 AS INT) END AS mileage,
  'mi' AS mileage_units,
  CASE WHEN l_linestatus = 'F' AND l_tax < 0.03E0 THEN 'sold' WHEN l_linestatus = 'O' AND l_tax < 0.02E0 THEN 'in_transit' WHEN l_linestatus = 'O' THEN 'available' WHEN l_tax > 0.07E0 THEN '' END AS in_stock_status,
  CASE p_size % 4 WHEN 0 THEN 'Red' WHEN 1 THEN 'Blue' WHEN 2 THEN CASE WHEN l_partkey % 13 = 0 THEN 'Sample Grey' ELSE 'Grey' END END AS exterior_color,
  CASE WHEN p_size % 2 = 0 THEN 'Black' END AS interior_color,
  CASE s_nationkey % 5 WHEN 0 THEN 'Portland' WHEN 1 THEN 'Beaverton' WHEN 2 THEN 'Portland (Beaverton area)' WHEN 3 THEN 'Vancouver Washington' END AS dealer_location_city,
  CASE s_nationkey % 4 WHEN 0 THEN 'OR' WHEN 1 THEN 'WA' WHEN 2 THEN '' END AS dealer_location_state,
  CASE WHEN l_linenumber = 1 THEN concat('First line', chr(10), 'second "line"; ', p_name) END AS description,
  CASE WHEN p_size % 2 = 0 THEN {array}('Heated seats', 'Camera') ELSE {array}('Camera') END AS features,
  {array}(concat('https://d/img/', CAST(l_partkey AS STRING), '.jpg')) AS images,
  l_shipdate AS scraped_at
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey JOIN {supplier} ON l_suppkey = s_suppkey
"""

RENDERED = """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  concat(CAST(year AS STRING), ' ', make, ' ', model, CASE WHEN trim IS NULL THEN '' ELSE concat(' ', trim) END) AS title,
  concat(
    CASE new_used WHEN 'new' THEN 'New ' WHEN 'cpo' THEN 'Certified Pre-Owned ' ELSE 'Pre Owned ' END, CAST(year AS STRING), ' ', make, ' ', model, '. ',
    CASE WHEN vin IS NULL THEN '' ELSE concat('VIN: ', vin, ' ') END, 'Stock # ', stock_number, ', ',
    CASE WHEN mileage IS NULL THEN '' WHEN mileage >= 1000 THEN concat(CAST(mileage // 1000 AS STRING), ',', lpad(CAST(mileage % 1000 AS STRING), 3, '0'), ' miles. ') ELSE concat(CAST(mileage AS STRING), ' mi. ') END,
    CASE WHEN msrp IS NULL THEN 'Call us. ' ELSE concat('MSRP: $', CAST(CAST(floor(msrp) AS BIGINT) AS STRING), '. ') END,
    CASE WHEN fuel_type IS NULL THEN 'Engine: 2.0L Turbo. ' WHEN l_linenumber = 6 THEN concat('Runs on ', fuel_type, ' power. ') ELSE concat('Fuel Type: ', fuel_type, '. ') END,
    CASE p_size_mod WHEN 1 THEN 'Drivetrain: All-Wheel Drive. ' WHEN 2 THEN 'Driveline: front wheel. ' WHEN 3 THEN 'with quattro grip. ' WHEN 4 THEN 'Drive Type: 4x4; ' ELSE '' END,
    CASE WHEN transmission IS NULL THEN '' ELSE 'Transmission: 8-Speed Automatic. ' END,
    CASE WHEN body_style = 'SUV' THEN 'Body Style: SUV. ' ELSE 'A fine sedan. ' END,
    CASE WHEN exterior_color IS NULL THEN '' ELSE concat('Ext. Color: ', exterior_color, '. ') END,
    CASE WHEN interior_color IS NULL THEN '' ELSE concat('Interior Color: ', interior_color, '. ') END,
    CASE in_stock_status WHEN 'sold' THEN 'Sold' WHEN 'available' THEN 'In Stock' WHEN 'in_transit' THEN 'On the Way' ELSE 'Ask us' END) AS body
FROM (SELECT v.*, CASE drivetrain WHEN 'AWD' THEN 1 WHEN 'fwd' THEN 2 WHEN 'RWD' THEN 3 WHEN '4WD' THEN 4 ELSE 0 END AS p_size_mod FROM ({listings}) v) w
"""

#: A literal set of robots rules for the hosts of ``pages``.
ROBOTS = "User-agent: other\nUser-agent: bot, Crawler\nDisallow: /*7\nAllow: /*17\nDisallow:\n# Disallow: /\nUser-agent: *\nDisallow: /page/*3$\nDisallow: /x("


def duckdb_view(sql: str) -> str:
    names = {t: t for t in TABLES}
    return sql.format(row="row", array="list_value", listings=LISTINGS.format(row="row", array="list_value", **names), **names)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {t: f"{{{t}}}" for t in ("lineitem", "part", "supplier")}
    return spark.sql(LISTINGS.format(row="struct", array="array", **names), **{t: table(spark, sf_dir, t) for t in names})


def fixed(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows whose columns leave a generator: what is built on a view's column reads it, instead of making it again."""
    return rows.select(F.inline(F.array(F.struct(*(columns or rows.columns)))))


def rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = listings(spark, sf_dir)
    read = fixed(made, *[c for c in made.columns if c in RENDERED])
    return spark.sql(RENDERED.replace("//", "div").replace("{listings}", "SELECT * FROM {listings}"), listings=read)
