"""Quality rules with risk-controlled thresholds (operator 4), native Spark functions only.

Each rule rejects a document whose statistic exceeds a cutoff. Cutoffs are selected per
stratum (band of text length) on labelled holdouts: going from lax to strict, a cutoff is
certified while the exact binomial probability of seeing so few false rejections, were
the true rate RISK / number of rules, stays below the rule's share of LEVEL. Testing in
this fixed order controls the error over all cutoffs, Bonferroni over rules and strata:
with probability 1 - LEVEL no stratum loses more than RISK of its good documents.
Among the certified cutoffs the one with the best balance of bad to good rejections is
used, the laxest among equals; a rule without a certified or useful cutoff rejects nothing.

Defined cases: a null or empty text has no words and fails the base rule; null ids match
no label; several labels of a document count as often as they occur, null labels do not;
repeated rows give repeated results; a value equal to a cutoff is not rejected; very long
texts are measured whole; without enough labels (RISK and LEVEL need about 500 good ones in
a stratum) nothing is certified and only the base rule rejects; an empty table gives no
rows; only the id and the text are read, so further columns may have any name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, durable, in_fold

LEAST_WORDS, MOST_REPEATED_PERCENT, WINDOW = 50, 50, 3
RISK, LEVEL, GOOD_COST = 0.05, 0.1, 20
FOLDS, HELD_OUT = 5, 0
#: First words of the strata; shorter texts fail the base rule.
STRATA = (LEAST_WORDS, 150, 600)
#: Cutoffs from lax to strict: a geometric grid.
GRID = tuple(round(4.0 * 0.8**k, 4) for k in range(24))
RULES = ("symbols", "capitals", "exclamations", "repeats", "lines")
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_capitals", "n_marks", "n_lines")


def _without(text: Column, letters: str) -> Column:
    return F.translate(text, letters, "")


def with_statistics(rows: DataFrame) -> DataFrame:
    """Replace column ``text`` by the columns STATS.

    The columns are built in steps; each array is read more than once in the next step,
    so the optimizer computes it once instead of folding it into a lambda.
    """
    kept = [c for c in rows.columns if c != "text"]
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    first = rows.select(
        *kept,
        F.filter(F.split(text, f"{SPACE_CLASS}+"), lambda w: w != "").alias("w"),
        lines.alias("l"),
        F.length(_without(text, " \t\n\x0b\f\r")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count(text, F.lit("[A-Z]")).cast("long").alias("n_capitals"),
        F.regexp_count(text, F.lit("!")).cast("long").alias("n_marks"),
    )
    sums = ["word_chars", "n_symbols", "n_capitals", "n_marks"]
    second = first.select(
        *kept,
        *sums,
        F.size("w").cast("long").alias("n_words"),
        F.size("l").cast("long").alias("n_lines"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        F.length(F.bin(F.size("w").cast("long"))).alias("bits"),
        "w",
        F.transform("w", lambda x: F.xxhash64(x)).alias("h"),
    )
    counted = [*sums, "n_words", "n_lines", "n_dup_lines"]
    third = second.select(
        *kept,
        *counted,
        "bits",
        "w",
        F.transform(F.slice("h", F.lit(1), F.greatest(F.size("h") - (WINDOW - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *[F.get("h", i + k) for k in range(1, WINDOW)])).alias("windows"),
    )
    # Equal windows stand side by side once hash and place are packed in one sorted number. Long
    # texts leave few bits for the hash, so what it finds is compared by its words.
    packed = F.sort_array(F.transform("windows", lambda x, i: F.call_function("shiftleft", x, F.col("bits")).bitwiseOR(i.cast("long"))))
    fourth = third.select(*kept, *counted, "bits", "w", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), packed).alias("packed"))
    of = lambda x: F.call_function("shiftrightunsigned", x, F.col("bits"))
    at = lambda i: F.coalesce(of(F.get("packed", i)), F.lit(-1))
    likely = F.filter("packed", lambda x, i: (of(x) == at(i - 1)) | (of(x) == at(i + 1)))
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bits")) - 1
    place = lambda x: x.bitwiseAND(mask).cast("int")
    words = lambda p: F.concat_ws(" ", *[F.get("w", p + k) for k in range(WINDOW)])
    fifth = fourth.select(*kept, *counted, F.array_sort(F.transform(likely, lambda x: F.struct(words(place(x)).alias("words"), place(x).alias("place")))).alias("likely"))
    beside = lambda i: F.get("likely", i)["words"]
    places = F.filter("likely", lambda x, i: F.coalesce(x["words"] == beside(i - 1), F.lit(False)) | F.coalesce(x["words"] == beside(i + 1), F.lit(False)))
    covered = F.flatten(F.transform(places, lambda x: F.transform(F.sequence(F.lit(0), F.lit(WINDOW - 1)), lambda k: x["place"] + k)))
    return fifth.select(*kept, *counted, F.coalesce(F.size(F.array_distinct(covered)), F.lit(0)).cast("long").alias("n_repeat_words")).select(
        *kept, *STATS[:-3], *STATS[-3:]
    )


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))


def _share(part: str, whole: str) -> Column:
    return F.coalesce(F.col(part) / F.nullif(F.col(whole), F.lit(0)), F.lit(0.0))


def rule_values() -> dict[str, Column]:
    return dict(zip(RULES, (_share("n_symbols", "n_words"), _share("n_capitals", "word_chars"), _share("n_marks", "n_words"), _share("n_repeat_words", "n_words"), _share("n_dup_lines", "n_lines"))))


def stratum() -> Column:
    return sum((F.col("n_words") >= first).cast("int") for first in STRATA)


def binomial_at_most(k: int, n: int, p: float) -> float:
    """P(X <= k) for n trials of probability p, from the exact terms."""
    if k >= n:
        return 1.0
    log_term = lambda i: math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
    return min(1.0, math.fsum(math.exp(log_term(i)) for i in range(k + 1))) if k <= n * p else 1.0


def select_cutoffs(counts: dict[tuple[int, str], dict[int, list[int]]]) -> dict[tuple[int, str], float]:
    """counts: (stratum, rule) -> index of the laxest exceeded cutoff -> [good, bad] (len(GRID): none)."""
    chosen: dict[tuple[int, str], float] = {}
    level, risk = LEVEL / (len(RULES) * len(STRATA)), RISK / len(RULES)
    for key, cells in counts.items():
        n = sum(good for good, _ in cells.values())
        false = true = 0
        best = 0.0
        for k, cutoff in enumerate(GRID):
            good, bad = cells.get(k, (0, 0))
            false, true = false + good, true + bad
            if binomial_at_most(false, n, risk) > level:
                break
            if true - GOOD_COST * false > best:
                best, chosen[key] = true - GOOD_COST * false, cutoff
    return chosen


def not_exceeded(value: Column) -> Column:
    """How many cutoffs of GRID, from the laxest on, a value does not exceed."""
    return F.size(F.filter(F.array(*map(F.lit, GRID)), lambda cutoff: cutoff >= value))


def cutoffs(stats: DataFrame, labels: DataFrame) -> dict[tuple[int, str], float]:
    """Selected on labelled rows outside the held-out fold that pass the base rule."""
    known = labels.select(F.col("doc_id").alias("__id"), F.col("quality").cast("int").alias("label")).where("label in (0, 1)")
    rows = stats.where(~in_fold("doc_id", FOLDS, HELD_OUT) & ~base_failed()).join(known, F.col("doc_id") == F.col("__id"))
    values = F.array(*[F.struct(F.lit(name).alias("rule"), not_exceeded(value).alias("cell")) for name, value in rule_values().items()])
    cells = rows.select(stratum().alias("s"), "label", F.explode(values).alias("v")).groupBy("s", "v.rule", "v.cell", "label").count()
    counts: dict[tuple[int, str], dict[int, list[int]]] = {}
    for row in cells.collect():  # at most strata x rules x cutoffs x 2
        counts.setdefault((row.s, row.rule), {}).setdefault(row.cell, [0, 0])[0 if row.label == 1 else 1] += row["count"]
    return select_cutoffs(counts)


def rejected(limits: dict[tuple[int, str], float]) -> Column:
    values, out = rule_values(), F.lit(False)
    for (s, rule), limit in sorted(limits.items()):
        out = out | ((F.col("s") == s) & (values[rule] > limit))
    return out


def judged(stats: DataFrame, limits: dict[tuple[int, str], float]) -> DataFrame:
    return stats.withColumn("s", stratum()).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~rejected(limits)).drop("s")


def judge_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, counts, base_failed and kept of every document."""
    stats = durable(with_statistics(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")), "rules")
    out = judged(stats, cutoffs(stats, labels))
    return out.select("doc_id", *STATS[:5], "base_failed", "kept", *STATS[5:])


def keep_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns.

    Two passes over the texts, the first for the cutoffs; no text is shuffled or stored.
    """
    limits = cutoffs(durable(with_statistics(docs.select("doc_id", "text")), "rules"), labels)
    names = [f"__{k}" for k in range(len(docs.columns))]  # clear of the statistics' names
    measured = with_statistics(docs.toDF(*names).withColumn("text", F.col(names[docs.columns.index("text")])))
    # Above a generator the verdict is a plain column, which the filter cannot take apart.
    verdicts = judged(measured, limits).select(*names, F.explode_outer(F.array("kept")).alias("verdict"))
    return verdicts.where("verdict").select(*names).toDF(*docs.columns)
