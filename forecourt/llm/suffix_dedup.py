"""Exact removal of repeated substrings by a distributed merge of suffix runs (operator 9).

A byte goes if it lies in a string of LEAST bytes that starts anywhere else too. All
places would be LEAST times the corpus; but every window of LEAST bytes contains one
well-defined anchor (the leftmost smallest of its hashed K-grams), and equal windows have
equal anchors at equal places. So only the suffixes that start at anchors are sorted.
Neighbouring windows with one anchor are a segment; segments are found in one pass and:

1. anchors whose hash occurs once in the corpus cannot repeat and leave;
2. segments with equal content repeat as a whole: their bytes go, one of them stays as
   the representative;
3. representatives that share an anchor but differ are compared: every task sorts the
   suffixes (from the anchor on) of its segments into runs, one per range of anchors, and
   front-codes them (length of the common prefix with the suffix before, and the rest);
   the runs of a range are merged by a loser tree whose nodes carry common-prefix lengths,
   so known prefixes are never compared again; the merged lengths tell, for each distance
   from the anchor, which windows agree to the right, and hashes of the bytes before the
   anchor which agree to the left.

Anchors with more than HOT different segments are not merged in one task. Their segments are
cut into BANDS of windows by the distance to the anchor. All windows of a band contain one
core of bytes around the anchor, so equal ones have equal cores, and the hash of the core
replaces the anchor's: the parts are segments again and go the same way. The bands get
narrower until no group is larger than HOT; in the last one a part is a single window, and
parts of one core are equal as a whole.

Segments are equal as a whole by two independent 64-bit hashes (of the anchor's gram or the
core, and of all bytes) and their shape.

Frequent keys never meet in one task: in every join with counts, keys that hold more than
one in FREQUENT rows, which are fewer than FREQUENT, are broadcast; the others are shuffled.

Defined cases: a null text is empty; texts under LEAST bytes keep everything; repeated
rows are copies of each other and lose every window; a null doc_id is kept; very long
texts are cut into overlapping stretches of STRETCH windows; an empty table gives no
rows; only the id and the text are read, unless all columns are asked for.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import durable, partitions

LEAST, K, HOT, STRETCH = 200, 50, 4000, 1 << 18
#: Widths of the bands of windows into which the segments of hot anchors are cut, one after the other.
BANDS = (38, 10, 3, 1)
FREQUENT = 1000
#: Low bits of an anchor's sort key that hold its place, the same for texts of every length.
PLACE_BITS = (STRETCH + LEAST).bit_length()
#: Segments that one merging task takes, on average.
MERGED = 50_000
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_SPAN = LEAST - K + 1  # K-grams in a window


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random number per byte; powers of the base and of its inverse."""
    letters = np.random.default_rng(11).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
    inverse, n = pow(_BASE, -1, 1 << 64), STRETCH + 2 * LEAST

    def powers(base: int) -> np.ndarray:
        steps = np.full(n, base, np.uint64)
        steps[0] = 1
        return np.multiply.accumulate(steps)

    return letters, powers(_BASE), powers(inverse)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, from running minima of blocks."""
    n = len(x)
    blocks = -(-n // width)
    laid = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    laid[:n] = x
    laid = laid.reshape(blocks, width)
    ahead = np.minimum.accumulate(laid, axis=1).ravel()
    behind = np.minimum.accumulate(laid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def segments(data: bytes) -> tuple[np.ndarray, ...]:
    """Anchor hash, content hash, first byte, length and anchor offset of every segment."""
    letters, power, inverse = _tables()
    parts = []
    for begin in range(0, max(0, len(data) - LEAST + 1), STRETCH):
        own = np.frombuffer(data, np.uint8, count=min(STRETCH + LEAST - 1, len(data) - begin), offset=begin)
        n = len(own)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(letters[own] * power[:n], out=sums[1:])
        grams = _mixed((sums[K:] - sums[:-K]) * inverse[: n - K + 1])
        low = np.uint64((1 << PLACE_BITS) - 1)
        places = np.arange(len(grams), dtype=np.uint64)
        anchors = (_sliding_minimum((grams & ~low) | places, _SPAN) & low).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], anchors[1:] != anchors[:-1]]))
        last = np.concatenate([first[1:], [len(anchors)]]) - 1
        at = anchors[first]
        length = last - first + LEAST
        whole = memoryview(data)
        content = np.array([xxh3_64_intdigest(whole[a:b]) for a, b in zip((first + begin).tolist(), (first + begin + length).tolist())], np.uint64)
        parts.append((grams[at], _mixed(content ^ _mixed((length * LEAST + at - first).astype(np.uint64))), first + begin, length, at - first))
    if not parts:
        return tuple(np.empty(0, np.int64) for _ in range(5))
    return tuple(np.concatenate(x) for x in zip(*parts))


def _rows(docs: DataFrame) -> DataFrame:
    """rid names a row by id and text: rows equal in both are copies of each other."""
    return docs.select(F.xxhash64("doc_id", "text").alias("rid"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("data"))


def anchored(docs: DataFrame) -> DataFrame:
    """(rid, h, c, at, shape) of every segment; shape packs windows and anchor offset."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rids, found = batch.column(0).to_numpy(), [segments(d) for d in batch.column(1).to_pylist()]
            counts = np.array([len(x[0]) for x in found])
            h, c, at, length, off = (np.concatenate(x) for x in zip(*found))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(rids, counts)), pa.array(h.astype(np.uint64).view(np.int64)), pa.array(c.astype(np.uint64).view(np.int64)), pa.array(at.astype(np.int64)), pa.array(((length - LEAST) * 256 + off).astype(np.int32))],
                ["rid", "h", "c", "at", "shape"],
            )

    return _rows(docs).where(F.length("data") >= LEAST).mapInArrow(cut, "rid long, h long, c long, at long, shape int")


# Runs of suffixes.


def common_prefix(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, of which ``known`` bytes are known."""
    n = min(len(a), len(b))
    if a[known:n] == b[known:n]:
        return n
    step = 16
    while a[known : known + step] == b[known : known + step]:
        known += step
    while a[known] == b[known]:
        known += 1
    return known


def front_coded(suffixes: list[bytes]) -> tuple[list[int], list[bytes]]:
    """Common-prefix lengths and remainders of sorted suffixes."""
    shared = [0, *[common_prefix(a, b, 0) for a, b in zip(suffixes, suffixes[1:])]][: len(suffixes)]
    return shared, [s[k:] for s, k in zip(suffixes, shared)]


class Run:
    """Reads a front-coded run; ``lcp`` is the common prefix with the suffix read before."""

    def __init__(self, number: int, shared: list[int], rests: list[bytes]):
        self.number, self.shared, self.rests, self.at = number, shared, rests, 0
        self.suffix: bytes | None = rests[0] if rests else None
        self.lcp = 0

    def step(self) -> None:
        self.at += 1
        if self.at < len(self.rests):
            self.lcp = self.shared[self.at]
            self.suffix = self.suffix[: self.lcp] + self.rests[self.at]
        else:
            self.suffix = None


def merge(runs: list[Run]) -> Iterator[tuple[int, int, int, bytes]]:
    """(run, place in it, common prefix with the suffix before, suffix), all runs in order.

    A loser tree: each inner node keeps the run that lost there, and every run's ``lcp``
    is its common prefix with the last suffix that won over it. Of two runs the one with
    the longer prefix in common with the last winner is smaller; only if these are equal
    bytes are compared, and only from that length on.
    """
    size = 1
    while size < len(runs):
        size *= 2
    players = [*runs, *[Run(len(runs) + k, [], []) for k in range(size - len(runs))]]

    def play(x: Run, y: Run) -> tuple[Run, Run]:
        if x.suffix is None or y.suffix is None:
            return (y, x) if x.suffix is None else (x, y)
        if x.lcp != y.lcp:
            return (x, y) if x.lcp > y.lcp else (y, x)
        k = common_prefix(x.suffix, y.suffix, x.lcp)
        if x.suffix[k:] < y.suffix[k:] or x.suffix[k:] == y.suffix[k:] and x.number < y.number:
            y.lcp = k
            return x, y
        x.lcp = k
        return y, x

    losers: list[Run] = [None] * size  # type: ignore[list-item]
    level = players
    nodes = list(range(size, 2 * size))
    while len(level) > 1:
        above = []
        for k in range(0, len(level), 2):
            winner, loser = play(level[k], level[k + 1])
            losers[nodes[k] // 2] = loser
            above.append(winner)
        level, nodes = above, [n // 2 for n in nodes[::2]]
    winner = level[0]
    while winner.suffix is not None:
        yield winner.number, winner.at, winner.lcp, winner.suffix
        node = (size + winner.number) // 2
        winner.step()
        while node:
            winner, losers[node] = play(winner, losers[node])
            node //= 2


def repeated_windows(shared: np.ndarray, before: list[bytes], windows: np.ndarray) -> np.ndarray:
    """Which windows of merged segments occur in another one: items x (distance to the anchor).

    ``shared``: common prefix with the suffix before, the anchor's hash (8 bytes) included;
    ``before``: bytes from the segment's first to the anchor; ``windows``: their number.
    """
    letters = _tables()[0]
    n, most = len(before), max(map(len, before), default=0) + 1
    off = np.array([len(b) for b in before])
    left = np.zeros((n, most), np.uint8)
    for k, b in enumerate(before):
        left[k, : len(b)] = np.frombuffer(b, np.uint8)[::-1]
    out = np.zeros((n, most), bool)
    hashes = np.zeros(n, np.uint64)
    for d in range(most):
        if d:
            hashes = hashes * np.uint64(_BASE) + letters[left[:, d - 1]]
        own = np.flatnonzero((off >= d) & (off - d < windows))
        if len(own) < 2:
            continue
        groups = np.cumsum(shared < 8 + LEAST - d)
        keys = _mixed(hashes[own] ^ _mixed(groups[own].astype(np.uint64)))
        order = np.argsort(keys, kind="stable")
        same = keys[order][1:] == keys[order][:-1]
        hit = np.zeros(len(own), bool)
        hit[order[1:][same]] = True
        hit[order[:-1][same]] = True
        out[own[hit], d] = True
    return out


def compared(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """(rid, start, stop) of repeated bytes in segments that share an anchor but differ."""
    parts = max(4 * partitions(docs.sparkSession), wanted.count() // MERGED)
    by_row = wanted.groupBy("rid").agg(F.collect_list(F.struct("h", "at", "shape")).alias("items")).withColumnRenamed("rid", "r")
    cut = _rows(docs).join(by_row, F.col("rid") == F.col("r")).select("rid", "data", "items")
    run_schema = "part int, rids array<long>, ats array<long>, windows array<int>, before array<binary>, shared array<int>, rests array<binary>"
    kinds = [pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.list_(pa.binary())]
    names = ["part", "rids", "ats", "windows", "before", "shared", "rests"]

    def make_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins: dict[int, list[tuple]] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            rows = []
            for part, items in bins.items():
                items.sort(key=lambda x: x[0])
                shared, rests = front_coded([x[0] for x in items])
                rows.append((part, [x[1] for x in items], [x[2] for x in items], [x[3] for x in items], [x[4] for x in items], shared, rests))
            bins.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        for batch in batches:
            for rid, data, items in zip(*(c.to_pylist() for c in batch.columns)):
                for item in items:
                    h, at, windows, off = item["h"], item["at"], (item["shape"] >> 8) + 1, item["shape"] & 255
                    anchor, stop = at + off, at + windows - 1 + LEAST
                    suffix = (h & _MASK).to_bytes(8, "big") + data[anchor:stop]
                    bins.setdefault((h & _MASK) % parts, []).append((suffix, rid, at, windows, data[at:anchor]))
                    size += 400
                if size > 64_000_000:
                    yield flush()
                    size = 0
        if bins:
            yield flush()

    def merge_runs(table: pa.Table) -> pa.Table:
        cols = {n: table.column(n).to_pylist() for n in names[1:]}
        runs = [Run(k, s, r) for k, (s, r) in enumerate(zip(cols["shared"], cols["rests"]))]
        merged = [(run, at, lcp) for run, at, lcp, _ in merge(runs)]
        rids, ats, windows, before = ([cols[n][run][at] for run, at, _ in merged] for n in names[1:5])
        hit = repeated_windows(np.array([x[2] for x in merged]), before, np.array(windows))
        # Window d starts d bytes before the anchor; runs of hit windows become spans.
        padded = np.zeros((len(hit), hit.shape[1] + 2), np.int8)
        padded[:, 1:-1] = hit
        turns = np.diff(padded, axis=1)
        item, low = np.nonzero(turns == 1)
        _, high = np.nonzero(turns == -1)
        anchor = np.array(ats)[item] + np.array([len(b) for b in before])[item] if len(item) else np.empty(0, np.int64)
        return pa.table({"rid": pa.array(np.array(rids, np.int64)[item]), "start": pa.array(anchor - (high - 1)), "stop": pa.array(anchor - low + LEAST)})

    runs = cut.mapInArrow(make_runs, run_schema)
    return runs.groupBy("part").applyInArrow(merge_runs, "rid long, start long, stop long")


def parted(segments: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """(rid, h, c, at, shape) of the parts of segments whose windows lie in one band of ``width`` distances."""
    by_row = segments.groupBy("rid").agg(F.collect_list(F.struct("h", "at", "shape")).alias("items")).withColumnRenamed("rid", "r")
    rows = _rows(docs).join(by_row, F.col("rid") == F.col("r")).select("rid", "data", "items")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int, int, int, int]] = []
            for rid, data, items in zip(*(c.to_pylist() for c in batch.columns)):
                for item in items:
                    windows, off = (item["shape"] >> 8) + 1, item["shape"] & 255
                    anchor = item["at"] + off
                    for band in range((off - windows + 1) // width, off // width + 1):
                        near, far = band * width, band * width + width - 1
                        core = data[anchor - near : anchor - far + LEAST]
                        low, high = max(near, off - windows + 1), min(far, off)
                        part = data[anchor - high : anchor - low + LEAST]
                        name = item["h"].to_bytes(8, "little", signed=True) + bytes([band])
                        out.append((rid, xxh3_64_intdigest(name + core), xxh3_64_intdigest(part, len(part)), anchor - high, (high - low) * 256 + high))
            if out:
                rids, h, c, at, shape = zip(*out)
                signed = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(rids, pa.int64()), signed(h), signed(c), pa.array(at, pa.int64()), pa.array(shape, pa.int32())], ["rid", "h", "c", "at", "shape"])

    return rows.mapInArrow(cut, "rid long, h long, c long, at long, shape int")


def with_count(rows: DataFrame, counts: DataFrame, *keys: str) -> DataFrame:
    """Rows whose keys are in ``counts`` (keys, n), with n; frequent keys are joined without a shuffle.

    A key with n * FREQUENT above the sum of all n is broadcast: fewer than FREQUENT can be.
    """
    total = counts.agg(F.sum("n")).first()[0] or 0
    named = counts.select(*[F.col(k).alias(f"__{k}") for k in keys], "n")
    on = [F.col(k) == F.col(f"__{k}") for k in keys]
    frequent = F.broadcast(named.where(F.col("n") * FREQUENT > total))
    rest = rows.join(frequent, on, "left_anti").join(named.where(F.col("n") * FREQUENT <= total), on)
    return rows.join(frequent, on).unionByName(rest).select(*rows.columns, "n")


def judged(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of segments (rid, h, c, at, shape): the spans of whole repeats, and one of each kind that shares its anchor (h, m: kinds of it)."""
    twice = durable(found.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "twice")
    shared = durable(with_count(found, twice, "h").drop("n"), "shared")
    kinds = durable(shared.groupBy("h", "c", "shape").agg(F.count("*").alias("n"), F.min(F.struct("rid", "at")).alias("one")), "kinds")
    whole = with_count(shared, kinds.where("n > 1").select("h", "c", "shape", "n"), "h", "c", "shape")
    whole = whole.select("rid", F.col("at").alias("start"), (F.col("at") + F.shiftright("shape", 8) + LEAST).alias("stop"))
    several = durable(kinds.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "several")
    return whole, durable(with_count(kinds.select("h", "shape", "one"), several, "h").select("h", F.col("n").alias("m"), "one.*", "shape"), "wanted")


def repeated_spans(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """(rid, spans): byte ranges (start, stop) that cover what repeats, in any order."""
    found, spans = durable(anchored(docs), "segments"), None
    for width in (*BANDS, None):
        whole, wanted = judged(found)
        more = whole.union(compared(wanted.where(F.col("m") <= hot), docs))
        spans = more if spans is None else spans.union(more)
        over = wanted.where(F.col("m") > hot)
        if width is None or over.isEmpty():
            break
        found = durable(parted(over, docs, width), "parts")
    # Rows equal in id and text have one rid: their equal spans are told once.
    return spans.groupBy("rid").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))


def strip(data: bytes, starts: np.ndarray, stops: np.ndarray) -> tuple[bytes, int, int]:
    """The bytes outside the ranges, the number removed, and the number of maximal removed runs."""
    order = np.argsort(starts, kind="stable")
    starts, stops = starts[order], np.maximum.accumulate(stops[order])
    fresh = np.concatenate([[True], starts[1:] > stops[:-1]])
    begin = starts[fresh]
    end = np.concatenate([stops[:-1][fresh[1:]], stops[-1:]])
    keep, at = [], 0
    for b, e in zip(begin.tolist(), end.tolist()):
        keep.append(data[at:b])
        at = e
    keep.append(data[at:])
    kept = b"".join(keep)
    return kept, len(data) - len(kept), len(begin)


def _with_spans(docs: DataFrame, hot: int) -> DataFrame:
    spans = repeated_spans(docs, hot).withColumnRenamed("rid", "r")
    rows = docs.select(F.xxhash64("doc_id", "text").alias("rid"), F.struct("*").alias("row"))
    return rows.join(spans, F.col("rid") == F.col("r"), "left").select("row", "spans")


def _stripped(batch: pa.RecordBatch) -> Iterator[tuple[bytes, bytes, int, int]]:
    lists = batch.column(1)
    starts, stops = (lists.values.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
    offsets = lists.offsets.to_numpy()
    for data, begin, stop in zip(batch.column(0).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist()):
        yield (data, *(strip(data, starts[begin:stop], stops[begin:stop]) if stop > begin else (data, 0, 0)))


def strip_documents(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document."""

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(len(data), removed, n, sha256(kept).hexdigest()) for data, kept, removed, n in _stripped(batch)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.string()))] + [batch.column(2)], ["n_bytes", "n_removed", "n_spans", "kept_sha256", "doc_id"])

    rows = _with_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), hot)
    rows = rows.select(F.coalesce(F.col("row.text"), F.lit("")).cast("binary").alias("data"), "spans", "row.doc_id")
    out = rows.mapInArrow(finish, "n_bytes long, n_removed long, n_spans long, kept_sha256 string, doc_id long")
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def without_repeats(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """The rows of ``docs`` with repeated bytes cut out of the text.

    Remainders of characters that a cut split are dropped; a column n_chars is recounted;
    texts without a cut, null ones included, stay as they are.
    """

    @F.arrow_udf("string")
    def cut(data: pa.Array, spans: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([data, spans], ["data", "spans"])
        return pa.array([kept.decode(errors="ignore") for _, kept, _, _ in _stripped(batch)], pa.string())

    text = F.when(F.col("spans").isNull(), F.col("row.text")).otherwise(cut(F.coalesce(F.col("row.text"), F.lit("")).cast("binary"), "spans"))
    rows = _with_spans(docs, hot).select("row.*", text.alias("__new"))
    rows = rows.select(*[F.col("__new").alias("text") if c == "text" else F.col(c) for c in docs.columns])
    return rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else rows
