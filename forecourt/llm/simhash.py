"""Near-duplicates by SimHash with pigeonring filtering (operator 7).

Two 64-bit fingerprints within DISTANCE bits differ, over a ring of eight 8-bit segments,
in such a way that some chain of consecutive segments keeps every prefix sum of
differences within the proportional share of the distance: 0, 0, 1, 1, 1, 2, 2, 3. So two
segments in a row agree and of the next three at most one differs. Each fingerprint is
therefore listed under 24 keys of 32 bits (8 chain starts, 3 choices of the segment that
may differ); within a key, pairs must pass the chain's budgets up to the full check.
Buckets of over BLOCK fingerprints get a second key: of the four segments that the first
leaves open at least one agrees as well, since at most three bits differ, so such buckets are
listed again under each of these with its value. What is still over BLOCK then is worked off
in pairs of blocks by several tasks. Links inside one bucket are reduced to a spanning forest
before they leave the task, so no group is ever in one task or emitted as pairs. Distinct
fingerprints only are compared.

Defined cases: a text without words (null, empty, blank) has fingerprint zero and links
like any other; fewer than three words are one shingle; a null doc_id takes part but never
names a component; repeated rows give repeated results; very long texts are hashed STEP
shingles at a time; exactly DISTANCE differing bits link; an empty table gives no rows; only
the id and the text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import durable
from .components import components

SHINGLE, SEED, DISTANCE, SEGMENTS, BLOCK = 3, 42, 3, 8, 1024
BUDGETS = np.array([(k + 1) * DISTANCE // SEGMENTS for k in range(SEGMENTS)])
#: Shingles hashed before their bits are added up.
STEP = 65_536


def fingerprint(text: str | None) -> int:
    """Unsigned 64 bits."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(SHINGLE, len(words))
    starts, ends = starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    ones = np.zeros(64, np.int64)
    for at in range(0, len(starts), STEP):
        hashes = np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[at : at + STEP], ends[at : at + STEP])], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(starts), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint ``f`` (as a signed long) and hash ``h`` of the text of every document."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made), batch.column(2)], ["doc_id", "f", "h"])

    return docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text")).mapInArrow(make, "doc_id long, f long, h long")


def chain_keys(f: Column) -> Column:
    """array<struct<start, key>>: the agreeing segments of each chain, with the chain's start."""
    segment = lambda k: F.shiftrightunsigned(f, 8 * (k % SEGMENTS)).bitwiseAND(255)
    keys = []
    for start in range(SEGMENTS):
        for free in (2, 3, 4):
            key = F.lit(3 * start + free - 2).cast("long")
            for k in (0, 1, 2, 3, 4):
                if k != free:
                    key = F.shiftleft(key, 8).bitwiseOR(segment(start + k))
            keys.append(key)
    return F.array(*keys)


def second_keys(f: Column, key: Column) -> Column:
    """array<long>: a first key with each segment that it leaves open, and that segment's value."""
    which = F.shiftrightunsigned(key, 32).cast("int")
    start, free = F.floor(which / 3).cast("int"), F.pmod(which, F.lit(3)) + 2
    at = lambda k: F.pmod(start + k, F.lit(SEGMENTS)) * 8
    value = lambda k: F.call_function("shiftrightunsigned", f, at(k)).bitwiseAND(255)
    return F.array(*[F.xxhash64(key, F.lit(n), value(k)) for n, k in enumerate((free, F.lit(5), F.lit(6), F.lit(7)))])


def linked(values: np.ndarray, start: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of distinct fingerprints that pass the chain from ``start``."""
    n = len(values)
    a, b = np.triu_indices(n, 1)
    differ = (values[a] ^ values[b]).view(np.uint64)
    shifted = (differ >> np.uint64(8 * start)) | (differ << np.uint64((64 - 8 * start) % 64)) if start else differ
    passed = np.ones(len(a), bool)
    for k in range(3, SEGMENTS + 1):  # segments 1 and 2 agree by the key
        mask = np.uint64((1 << (8 * k)) - 1)
        passed[passed] = np.bitwise_count(shifted[passed] & mask) <= BUDGETS[k - 1]
    a, b = a[passed], b[passed]
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    return [(int(values[k]), int(values[r])) for k, r in enumerate(root) if k != r]


def _counted(listed: DataFrame) -> DataFrame:
    """(f, key, bucket) with the size n of its bucket, for buckets of two or more.

    Neither side is ever broadcast: Spark takes what an explode gives for no larger than what
    goes in, 24 times too small here, and the driver would hold a whole listing.
    """
    counts = listed.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").withColumnRenamed("bucket", "k")
    return listed.hint("merge").join(counts.hint("merge"), F.col("bucket") == F.col("k")).select("f", "key", "bucket", "n")


def links(distinct: DataFrame) -> DataFrame:
    """distinct (f) -> (a, b): enough links to connect all fingerprints within DISTANCE bits."""
    keyed = distinct.select("f", F.explode(chain_keys(F.col("f"))).alias("key"))
    first = durable(_counted(keyed.withColumn("bucket", F.col("key"))), "buckets")
    again = _counted(first.where(F.col("n") > BLOCK).select("f", "key", F.explode(second_keys(F.col("f"), F.col("key"))).alias("bucket")))
    full = first.where(F.col("n") <= BLOCK).unionByName(again).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    mine = F.pmod(F.xxhash64("f"), F.col("blocks")).cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda other: F.struct(F.least(mine, other).alias("x"), F.greatest(mine, other).alias("y")))
    groups = full.select("f", "key", "bucket", F.explode(cells).alias("cell")).groupBy("key", "bucket", "cell").agg(F.collect_list("f").alias("fs"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int]] = []
            keys = batch.column(0).to_pylist()
            lists, offsets = batch.column(1).values.to_numpy(), batch.column(1).offsets.to_numpy()
            for key, begin, stop in zip(keys, offsets[:-1].tolist(), offsets[1:].tolist()):
                if stop - begin > 1:
                    out += linked(np.sort(lists[begin:stop]), (key >> 32) // 3)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], ["a", "b"])

    return groups.select("key", "fs").mapInArrow(compare, "a long, b long").distinct()


def _grouped(docs: DataFrame) -> DataFrame:
    """doc_id, f, h, the root of the component and component_id of every document."""
    marked = durable(fingerprints(docs), "fingerprints")
    classes = marked.groupBy("f").agg(F.min("doc_id").alias("first"))
    roots = components(links(classes.select("f")))
    named = classes.join(roots, F.col("f") == F.col("node"), "left").withColumn("root", F.coalesce("root", "f"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id")).withColumnRenamed("root", "r")
    of_class = named.join(least, F.col("root") == F.col("r")).select(F.col("f").alias("c"), "root", "component_id")
    return marked.join(of_class, F.col("f") == F.col("c"), "left")


def group_documents(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (hex) and component_id of every document."""
    return _grouped(docs).select("doc_id", F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` of each component: the smallest (doc_id, hash of the text), null ids last.

    So rows without an id are copies like any other, and of rows equal in both one stays.
    """
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), "h")
    chosen = _grouped(docs).groupBy("root").agg(F.min(order).alias("o")).select(*[F.col(f"o.{c}").alias(f"__c_{c}") for c in ("none", "id", "h")])
    mine = {"none": F.col("doc_id").isNull(), "id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "h": F.xxhash64("text")}
    marked = docs.withColumns({f"__m_{c}": x for c, x in mine.items()})
    kept = marked.join(chosen, [F.col(f"__m_{c}") == F.col(f"__c_{c}") for c in mine], "left_semi")
    by = [f"__m_{c}" for c in mine]  # the join's keys, so no further exchange
    return kept.withColumn("__one", F.row_number().over(Window.partitionBy(*by).orderBy(*by))).where("__one = 1").select(*docs.columns)
