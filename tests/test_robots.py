"""Robots verdicts against the rules said plainly."""

from __future__ import annotations

import random
import re

from forecourt.operators import robots
from pyspark.sql import functions as F


def matches(path, rule):
    body = rule.replace("*", ".*")
    whole = body if body.endswith("$") else body + ".*"
    try:
        return re.match(whole, path) is not None
    except re.error:
        return path.startswith(whole.rstrip("*"))


def verdict(path, rules, agent):
    for name in dict.fromkeys([agent.lower(), "*"]):
        for allow in (True, False):
            if any(a == name and said == allow and matches(path, rule) for a, said, rule in rules):
                return allow
    return True


RULES = ["/", "/a", "/a*", "/a/*/c", "/*.php$", "/x(.", "/x(.)y", "/index.html", "/q?x", "/[ab]c", "/b$", "*", "/a|/b", r"/\d+", "/(?i)A", "/(a)\\1", "/ü*", "/a**", "[", "/w{2}"]
PATHS = ["", "/", "/a", "/a/b/c", "/a/c", "/i.php", "/i.phpx", "/x(.", "/xzy", "/index.html", "/indexxhtml", "/qx", "/q?x", "/ac", "/b", "/bc", "/123", "/A", "/aa", "/ü1", "[", "/ww"]


def test_verdicts_against_plain_rules(spark):
    r = random.Random(3)
    hosts = {f"h{n}": [(r.choice(["bot", "*", "other"]), r.random() < 0.4, r.choice(RULES)) for _ in range(n % 7)] for n in range(60)}
    rules = spark.createDataFrame([(h, n, *rule) for h, own in hosts.items() for n, rule in enumerate(own)], "host string, pos int, agent string, allow boolean, path string")
    urls = [(h, f"https://{h}{p}", p) for h in [*hosts, "unknown"] for p in PATHS]
    frame = spark.createDataFrame(urls, "host string, url string, p string")
    for agent in ("Bot", "*", "nobody"):
        got = robots.verdicts(frame, rules, agent, url="p").collect()
        assert len(got) == len(urls)
        for row in got:
            assert row.allowed == verdict(robots_path(row.p), hosts.get(row.host, []), agent), (row, hosts.get(row.host))


def robots_path(p):
    return p.split("?")[0]


def test_no_pattern_is_compiled_by_row(spark):
    rules = spark.createDataFrame([("h", 0, "*", False, "/a*b"), ("h", 1, "*", False, "/c")], "host string, pos int, agent string, allow boolean, path string")
    frame = spark.range(10).select(F.lit("h").alias("host"), F.concat(F.lit("https://h/a"), "id", F.lit("b")).alias("url"))
    df = robots.verdicts(frame, rules)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE __" not in plan and "rlike(__path" not in plan.lower()
    assert not any(r.allowed for r in df.collect())
    before = robots.host_matcher.cache_info().misses
    packed = '[[1,"/a.*b.*"],[1,"/c.*d.*"]]'
    for _ in range(5):
        assert len(robots.host_matcher(packed)) == 1
    assert robots.host_matcher.cache_info().misses == before + 1


def test_half_of_the_pages_on_one_host_are_spread(spark):
    """With the rules too many for a broadcast, the hot host's partition is split."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "8"}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        hosts = spark.range(4000).select(F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("h"), "id")).alias("host"), F.concat(F.lit("https://x/a"), F.sha2(F.col("id").cast("string"), 512)).alias("url")).repartition(8)
        rules = spark.range(4000).select(F.when(F.col("id") == 0, "hot").otherwise(F.concat(F.lit("h"), "id")).alias("host"), F.lit(0).alias("pos"), F.lit("*").alias("agent"), F.lit(False).alias("allow"), F.lit("/a*f").alias("path"))
        df = robots.verdicts(hosts, rules).select("host", F.spark_partition_id().alias("task"), "allowed")
        rows = df.collect()
        assert len(rows) == 4000 and len({r.task for r in rows if r.host == "hot"}) >= 4
    finally:
        for k in settings:
            spark.conf.unset(k)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
