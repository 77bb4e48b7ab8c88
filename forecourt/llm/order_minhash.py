"""Document fingerprints by order MinHash (operator 10), native Spark functions only.

A k-mer is K neighbouring words; equal k-mers of a text are numbered in text order. Each
numbered k-mer gets a hash, whose first bits assign it to one of LANES lanes. A lane
selects its TUPLE minimal hashes, puts them back in text order and hashes them as one
tuple; a lane that has fewer takes the next hashes of the ring of lanes instead, so every
lane of a text with two k-mers hashes an ordered pair. So a lane agrees between two texts only if the same k-mers are minimal in the same
order: likeness follows edit distance, not just shared content. One sort numbers the
k-mers, one sort selects; both are on primitive arrays inside one row, without a shuffle.
The sorted numbers hold the top bits of a hash and a place; lanes and tuples are made from
the whole hashes, found by place, so they do not depend on the text's length.

Defined cases: a null text is empty; a text of fewer than K words has one k-mer, all its
words; without words the text itself is the k-mer; the next of the last document is the
first, of a single document itself; equal ids follow each other in order of their texts;
null ids come first; repeated rows give repeated rows; very long texts are sorted whole, as
arrays of numbers inside one row; an empty table gives no rows; only the id and the text
are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_CLASS, partitions

#: Bytes of a text that sort it into a range within one much repeated id.
PREFIX = 7
#: Rows of a range, and of a task that orders ranges, on average where there are many.
RANGE_ROWS, TASK_ROWS = 10_000, 40_000

K, LANES, LANE_BITS, TUPLE = 2, 64, 6, 2
#: Powers of two for the search of a k-mer's first place among its equals, largest first.
STEPS = 31


def _right(x: Column, by: Column | int) -> Column:
    return F.call_function("shiftrightunsigned", x, F.lit(by) if isinstance(by, int) else by)


def _left(x: Column, by: Column | int) -> Column:
    return F.call_function("shiftleft", x, F.lit(by) if isinstance(by, int) else by)


def with_signature(rows: DataFrame, text: str, name: str) -> DataFrame:
    """Add ``name``: array<long> of one (lane, tuple hash) for each of LANES lanes.

    Built in steps whose arrays are read more than once by the next one, so that the
    optimizer computes each once.
    """
    kept = rows.columns
    words = F.filter(F.split(F.col(text), f"{SPACE_CLASS}+"), lambda w: w != "")
    a = rows.select(*kept, F.when(F.col(text).rlike(r"[^\x20\x09-\x0D]"), words).otherwise(F.array(text)).alias("__w"))
    b = a.select(*kept, F.transform("__w", lambda x: F.xxhash64(x)).alias("__h"), F.length(F.bin(F.size("__w").cast("long"))).alias("__b"))
    grams = F.transform(F.slice("__h", F.lit(1), F.greatest(F.size("__h") - (K - 1), F.lit(1))), lambda x, i: F.xxhash64(x, *[F.get("__h", i + k) for k in range(1, K)]))
    bits = F.col("__b")
    mask = _left(F.lit(1).cast("long"), bits) - 1
    c = b.select(*kept, "__b", grams.alias("__g"))
    d = c.select(*kept, "__b", "__g", F.sort_array(F.transform("__g", lambda x, i: _left(x, bits).bitwiseOR(i.cast("long")))).alias("__s"))
    same = lambda x, i: F.coalesce(_right(F.get("__s", i), bits) == _right(x, bits), F.lit(False))
    steps = F.transform(F.sequence(F.lit(0), F.least(F.lit(STEPS - 1), bits)), lambda k: _left(F.lit(1), bits - k))
    number = lambda x, i: F.when(same(x, i - 1), F.aggregate(steps, F.lit(0), lambda got, step: F.when(same(x, i - got - step), got + step).otherwise(got))).otherwise(F.lit(0))
    low = lambda x: x.bitwiseAND(mask).cast("int")
    e = d.select(*kept, "__b", "__s", F.transform("__s", lambda x, i: F.xxhash64(F.get("__g", low(x)), number(x, i))).alias("__v"))
    f = e.select(*kept, "__b", "__s", "__v", F.sort_array(F.transform("__v", lambda x, i: x.bitwiseAND(F.bitwise_not(mask)).bitwiseOR(i.cast("long")))).alias("__e"))
    lane = lambda x: _right(x, 64 - LANE_BITS)
    least = F.filter("__e", lambda x, i: F.coalesce(lane(F.get("__e", i - TUPLE)) != lane(x), F.lit(True)))
    g = f.select(*kept, F.transform(least, lambda x: F.struct(F.get("__v", low(x)).alias("v"), low(F.get("__s", low(x))).alias("p"))).alias("__l"))
    size = F.size("__l")
    of = lambda x: F.shiftright(x["v"], 64 - LANE_BITS).cast("int") + LANES // 2
    before = lambda i: F.when(i > 0, of(F.get("__l", i - 1))).otherwise(F.lit(-1))
    pair = lambda x, y: F.when(x["p"] < y["p"], F.xxhash64(x["v"], y["v"])).when(x["p"] > y["p"], F.xxhash64(y["v"], x["v"])).otherwise(F.xxhash64(x["v"]))
    chosen = lambda x, i: pair(x, F.get("__l", F.pmod(i + 1, size)))
    reached = F.transform("__l", lambda x, i: F.when(of(x) > before(i), F.array_repeat(chosen(x, i), of(x) - before(i))).otherwise(F.array().cast("array<long>")))
    h = g.select(*kept, "__l", F.flatten(reached).alias("__t"))
    ring = F.concat("__t", F.array_repeat(F.get("__t", F.lit(0)), LANES - F.size("__t")))
    return h.select(*kept, F.transform(ring, lambda x, i: _left(i.cast("long"), 40).bitwiseOR(_right(x, 24))).alias(name))


def likeness(a: Column, b: Column) -> Column:
    """The share of equal lanes among the lanes that either has."""
    lanes = lambda s: F.transform(s, lambda x: _right(x, 40))
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(lanes(a), lanes(b)))


def as_text(signature: Column) -> Column:
    return F.array_join(F.transform(signature, lambda x: F.lpad(F.hex(x), 12, "0")), "")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def _below(value: Column, marks: list) -> Column:
    """How many of the sorted marks lie below a value, by bisection."""
    if not marks:
        return F.lit(0)
    held = F.array(*map(F.lit, marks))
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(len(marks).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda got, step: F.when(F.coalesce(F.get(held, got + step - 1) < value, F.lit(False)), got + step).otherwise(got))


def with_range(rows: DataFrame) -> DataFrame:
    """Add ``__part``: numbers of ranges of (doc_id, text), in their order; as many as the rows call for.

    Ids are cut by approximate percentiles. An id (or null) that holds two percentiles or
    more, so more than a range's share of the rows, is cut again by the first bytes of its
    texts; there are fewer of these than ranges.
    """
    ids = F.coalesce(F.col("doc_id"), F.lit(-(2**63)))
    ranges = max(8 * partitions(rows.sparkSession), rows.count() // RANGE_ROWS)
    shares, accuracy = [k / ranges for k in range(1, ranges)], max(10_000, 10 * ranges)
    marks = rows.agg(F.percentile_approx(ids, shares, accuracy)).first()[0] or []
    hot = sorted({m for m, n in zip(marks, marks[1:]) if m == n})
    marks = sorted(set(marks))
    if not hot:
        return rows.withColumn("__part", _below(ids, marks).cast("long"))
    start = F.conv(F.rpad(F.hex(F.substring(F.col("text").cast("binary"), 1, PREFIX)), 2 * PREFIX, "0"), 16, 10).cast("long")
    found = rows.where(ids.isin(hot)).groupBy(ids.alias("id")).agg(F.percentile_approx(start, shares, accuracy).alias("m")).collect()  # one row per id in ``hot``
    inner = F.lit(0)
    for row in found:
        inner = F.when(ids == row.id, _below(start, sorted(set(row.m)))).otherwise(inner)
    # A hot id has a range of its own between those of the smaller and of the larger ids.
    outer = 2 * _below(ids, marks) + F.when(ids.isin(hot), 0).otherwise(F.lit(-1))
    return rows.withColumn("__part", (outer + 1).cast("long") * ranges + inner)


def with_next(rows: DataFrame) -> DataFrame:
    """Add ``signature``, and ``next_text`` and ``next_signature`` in order of (doc_id, text), the first after the last.

    Each range is a window of its own; only the first row of each range, found before
    anything is signed, is looked up from the range before it.
    """
    tasks = max(partitions(rows.sparkSession), rows.count() // TASK_ROWS)
    parted = with_range(rows)
    ids = F.coalesce(F.col("doc_id"), F.lit(-(2**63)))
    order = [F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first()]
    heads = parted.groupBy("__part").agg(F.min(ids).alias("__head"))
    chain = heads.withColumn("__before", F.coalesce(F.lag("__part").over(Window.orderBy("__part")), F.max("__part").over(Window.partitionBy())))  # one row per range
    least = parted.join(F.broadcast(chain.withColumnRenamed("__part", "__p")), (F.col("__part") == F.col("__p")) & (ids == F.col("__head")))
    firsts = with_signature(least.groupBy("__before").agg(F.min("text").alias("text")), "text", "signature")
    firsts = firsts.select(F.col("__before").alias("__of"), F.struct("text", "signature").alias("__first"))
    following = F.lead(F.struct("text", "signature")).over(Window.partitionBy("__part").orderBy(*order))
    joined = with_signature(parted, "text", "signature").repartition(tasks, "__part").withColumn("__lead", following).join(firsts, F.col("__part") == F.col("__of"), "left")
    found = F.coalesce("__lead", "__first")
    return joined.select(*rows.columns, "signature", found["text"].alias("next_text"), found["signature"].alias("next_signature"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and ``signature`` of every document."""
    return with_signature(_texts(docs), "text", "signature")


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Every document with its edited text's digest, both fingerprints and their likeness."""
    rows = with_next(_texts(docs))
    n, half = F.length("text"), F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "signature", "next_signature", edited.alias("edited"))
    rows = with_signature(rows, "edited", "edited_signature")
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("signature")).alias("fingerprint"),
        as_text(F.col("edited_signature")).alias("edited_fingerprint"),
        likeness(F.col("signature"), F.col("edited_signature")).alias("near_edited"),
        likeness(F.col("signature"), F.col("next_signature")).alias("near_next"),
    )
