"""Robots rules (R0-R4, F23): parsing, verdicts and path matching on tables."""

from __future__ import annotations

import json
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import strip


def parse_rules(files: DataFrame, host: str = "host", text: str = "robots") -> DataFrame:
    """(host, pos, agent, allow, path) of every rule.

    A rule belongs to the agents of the nearest agent line before it in its file; several
    agents stand on one line with commas; consecutive agent lines replace each other; rules
    without a path, comments and rules before any agent are left out.
    """
    lines = files.select(host, F.posexplode(F.split(F.col(text), "\n")).alias("pos", "line")).withColumn("line", strip("line")).where(~F.col("line").startswith("#"))
    agent = r"(?i)^User-agent:\s*(.+)"
    rule = r"(?i)^(Allow|Disallow):\s*(.+)"
    agents = F.when(F.col("line").rlike(agent), F.regexp_extract("line", agent, 1))
    nearest = F.last(agents, ignorenulls=True).over(Window.partitionBy(host).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    rules = lines.withColumn("__agents", nearest).where(F.col("line").rlike(rule) & F.col("__agents").isNotNull())
    return rules.select(
        host,
        "pos",
        F.explode(F.transform(F.split("__agents", ","), lambda a: F.lower(strip(a)))).alias("agent"),
        (F.lower(F.regexp_extract("line", rule, 1)) == "allow").alias("allow"),
        strip(F.regexp_extract("line", rule, 2)).alias("path"),
    ).where("path != ''")


#: Fixed: signs with a meaning in a regular expression.
_SIGNS = r"[.^$*+?{}\[\]\\|()]"
#: Hosts whose patterns a worker keeps compiled.
MOST_HOSTS = 4096


def with_pattern(rules: DataFrame) -> DataFrame:
    """Add ``prefix`` for rules that name a plain beginning, or ``regex``, to be matched at the start.

    A star is any text, a final dollar sign the end; other signs keep their meaning as a
    regular expression. A malformed expression is taken as a plain beginning. There are few
    rules, so the test for malformed ones is a UDF.
    """

    @F.arrow_udf(T.BooleanType())
    def well_formed(patterns: pa.Array) -> pa.Array:
        return pa.array([p is None or _compiled(p) is not None for p in patterns.to_pylist()], pa.bool_())

    body = F.replace("path", F.lit("*"), F.lit(".*"))
    whole = F.when(body.endswith("$"), body).otherwise(F.concat(body, F.lit(".*")))
    # Stars at the end of an open beginning say nothing.
    bare = F.regexp_replace("path", r"\*+$", "")
    plain = ~F.rlike(bare, F.lit(_SIGNS))
    known = rules.withColumn("__whole", F.when(~plain, whole))
    rest = F.when(~well_formed("__whole"), F.rtrim(F.col("__whole"), F.lit("*")))
    return known.withColumn("prefix", F.when(plain, bare).otherwise(rest)).withColumn("regex", F.when(F.col("prefix").isNull(), F.col("__whole"))).drop("__whole")


def _compiled(pattern: str) -> re.Pattern | None:
    try:
        return re.compile(pattern)
    except (re.error, OverflowError, RecursionError):
        return None


@lru_cache(maxsize=MOST_HOSTS)
def host_matcher(patterns: str) -> list[tuple[int, re.Pattern]]:
    """A host's patterns, compiled once in a worker: one expression for all of a kind where they can stand together."""
    kinds: dict[int, list[str]] = {}
    for kind, pattern in json.loads(patterns):
        kinds.setdefault(kind, []).append(pattern)
    out = []
    for kind, several in kinds.items():
        # Groups, back references and flags of one pattern would reach into another.
        joined = None if any("(" in p or "\\" in p for p in several) else _compiled("|".join(f"(?:{p})" for p in several))
        out += [(kind, joined)] if joined else [(kind, c) for p in several if (c := _compiled(p))]
    return out


def matched_kinds(path: str | Column, patterns: str | Column) -> Column:
    """Bits of the kinds of a host's patterns that match a path at its start; 0 for a host without patterns."""

    @F.arrow_udf(T.IntegerType())
    def match(paths: pa.Array, hosts: pa.Array) -> pa.Array:
        out = []
        for p, of_host in zip(paths.to_pylist(), hosts.to_pylist()):
            bits = 0
            if p is not None and of_host is not None:
                for kind, pattern in host_matcher(of_host):
                    if not bits >> kind & 1 and pattern.match(p):
                        bits |= 1 << kind
            out.append(bits)
        return pa.array(out, pa.int32())

    return match(path, patterns)


def url_path(url: str | Column) -> Column:
    """The path of an address, without query and fragment."""
    return F.regexp_extract(F.col(url) if isinstance(url, str) else url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def url_host(url: str | Column) -> Column:
    return F.lower(F.regexp_extract(F.col(url) if isinstance(url, str) else url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1))


def verdicts(urls: DataFrame, rules: DataFrame, agent: str = "*", url: str = "url", host: str = "host") -> DataFrame:
    """Add ``allowed`` to rows of (host, url).

    The own agent's rules come first, then those of "*"; within an agent a matching allow
    beats a matching disallow; without a match the next agent is asked; the default, also
    without rules, is to allow.

    A host's rules are gathered into one row: plain beginnings, which are compared in place,
    and patterns, which a worker compiles once per host. Addresses are not multiplied and, as
    they stand on the preserved side of a left join by host, Spark broadcasts the rules if
    they are few and otherwise splits a host with very many pages among tasks.
    """
    agents = list(dict.fromkeys([agent.lower(), "*"]))
    own = with_pattern(rules.where(F.col("agent").isin(*agents)))
    # Kinds in the order in which they are asked: the own agent's allow and disallow, then those of "*".
    kind = 2 * (F.array_position(F.array(*map(F.lit, agents)), F.col("agent")) - 1).cast("int") + F.when(F.col("allow"), 0).otherwise(1)
    kinds = own.withColumn("kind", kind)
    plain = F.array_sort(F.collect_set(F.when(F.col("prefix").isNotNull(), F.struct("kind", "prefix"))))
    patterns = F.array_sort(F.collect_set(F.when(F.col("regex").isNotNull(), F.array(F.to_json(F.array("regex")), F.col("kind").cast("string")))))
    packed = F.concat(F.lit("["), F.array_join(F.transform(patterns, lambda p: F.concat(F.lit("["), p[1], F.lit(","), F.substring(p[0], 2, 1 << 30))), ","), F.lit("]"))
    gathered = kinds.groupBy(F.col(host).alias("__of")).agg(plain.alias("__plain"), F.when(F.size(patterns) > 0, packed).alias("__patterns"))
    # A host by another expression, so that the join exchanges the rules itself: only between
    # two exchanges of its own does Spark split a partition of the other side.
    table = gathered.select(F.concat("__of", F.lit("")).alias("__host"), "__plain", "__patterns")
    joined = urls.join(table, F.col(host) == F.col("__host"), "left").withColumn("__path", url_path(url))
    asked = joined.withColumn("__bits", matched_kinds("__path", "__patterns"))
    hit = lambda k: F.coalesce(F.exists("__plain", lambda r: (r["kind"] == k) & F.startswith(F.col("__path"), r["prefix"])), F.lit(False)) | (F.col("__bits").bitwiseAND(1 << k) != 0)
    out = F.coalesce(*[F.when(hit(k), F.lit(k % 2 == 0)) for k in range(2 * len(agents))], F.lit(True))
    return asked.withColumn("allowed", out).select(*urls.columns, "allowed")


def allowed_pages(pages: DataFrame, rules: DataFrame, agent: str = "*", respect: bool = True) -> DataFrame:
    """the pages whose address the rules allow; all of them if rules are not respected."""
    if not respect:
        return pages
    with_host = pages.withColumn("__h", url_host("url"))
    return verdicts(with_host, rules.withColumnRenamed("host", "__h"), agent, host="__h").where("allowed").select(*pages.columns)


def disallowed_paths(rules: DataFrame, agent: str = "*") -> DataFrame:
    """The distinct disallowed paths of an agent and of "*"."""
    return rules.where(F.col("agent").isin(agent.lower(), "*") & ~F.col("allow")).select("host", "path").distinct()
