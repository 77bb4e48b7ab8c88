"""Hard-negative mining by an orthogonal PCA rotation (operator 12).

Scores are exact integer inner products. The rotation to the principal axes of the second
moments keeps inner products, and puts most of them into the leading components: for a tile
of anchors and rows the products of the leading components are accumulated in steps; what is
missing is at most the product of the norms of both remainders, plus a slack for rounding.
Pairs that this interval keeps from the wanted ranks or scores are discarded, after ever more
components; the survivors get their integer product. The rotation only decides what is
discarded early, so results do not depend on it.

Anchors are a stated part of the rows (every hundredth id), set against all rows in blocks.
Rows are dealt into groups of bounded size, each with a copy of the anchors, which stream
past the group's rows: a task holds one group and one batch of anchors. Best partners of each
group are merged by a window. First the positives of every anchor are found, then, with the
scores that they allow, the negatives of every anchor and positive. A group's rows stand in
the order of their ids, so that of equal scores the first ones stay and a vector with very
many copies is discarded from then on.

Defined cases: a row with a null label, a null vector or a null, NaN or infinite component
takes no part, nor does one without an id, which could not be returned; shorter vectors are
filled with zeros; a positive with a negative score has no negatives; repeated rows are rows
of their own, also repeated anchors, and equal ones are partners of each other; an empty
table gives no rows; other columns are not read. Components times the scale must stay below
2**26 (an error otherwise).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, partitions
from .vectors import from_binary, quantised, to_binary

SCALE, ANCHOR_EVERY, RELABEL_EVERY, LABELS = 256, 100, 7, 10
POSITIVES, NEGATIVES, LEAST, MOST = 5, 10, 30, 90
#: Rows that a task holds; anchors and rows of a tile; pairs whose products are taken at once.
GROUP_ROWS, TILE_ANCHORS, TILE_ROWS, PAIRS = 1 << 19, 256, 8192, 1 << 14
#: Rows of a group's first tile, which sets the ranks to beat; later ones double.
FIRST_ROWS = 256
#: Share of surviving pairs at which the products are taken rather than more components.
FEW = 0.02
ROW = "row long, id long, label long, vec binary"
BEST = "row long, query int, score long, id long, other long"
NONE, ALL = -(1 << 62), 1 << 62


def _quantise(width: int, scale: int) -> Callable:
    def quantise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            usable, vectors = quantised(batch.column(3), scale, width, exact_width=False)
            kept = [batch.column(c).filter(pa.array(usable)) for c in range(3)]
            yield pa.RecordBatch.from_arrays([*kept, to_binary(vectors)], ["row", "id", "label", "vec"])

    return quantise


def second_moments(rows: DataFrame, width: int) -> np.ndarray:
    """Sum of x x' over all rows: one matrix a task, added up by Spark."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            x = from_binary(batch.column(0), width).astype(float)
            total += x.T @ x
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(width), pa.int32()), "x": pa.array(total.tolist(), pa.list_(pa.float64()))})

    parts = rows.select("vec").mapInArrow(moments, "i int, x array<double>").select("i", F.posexplode("x").alias("j", "x"))
    out = np.zeros((width, width))
    for row in parts.groupBy("i", "j").agg(F.sum("x").alias("x")).collect():  # width * width
        out[row.i, row.j] = row.x
    return out


def rotation(moments: np.ndarray) -> np.ndarray:
    """Orthogonal; its columns are the principal axes, the leading one first."""
    return np.linalg.eigh((moments + moments.T) / 2)[1][:, ::-1]


class Rotated:
    """Integer vectors with their rotated components and the norms of what is left after each step."""

    def __init__(self, vectors: np.ndarray, turn: np.ndarray):
        self.exact, (n, width) = vectors, vectors.shape
        self.steps = sorted({max(1, width // 4), max(1, width // 2), width})
        self.turned, self.rest, self.norm = (np.zeros(shape, np.float32) for shape in ((n, width), (n, len(self.steps)), n))
        for at in range(0, n, TILE_ROWS):  # in double precision, a tile at a time
            tile = slice(at, at + TILE_ROWS)
            turned = vectors[tile].astype(float) @ turn
            square = np.cumsum(turned[:, ::-1] ** 2, axis=1)[:, ::-1]
            # Rounded up: no remainder and no norm is larger than it says here.
            for k, step in enumerate(self.steps[:-1]):
                self.rest[tile, k] = np.sqrt(square[:, step]) * (1 + 1e-6)
            self.norm[tile] = np.sqrt(square[:, 0]) * (1 + 1e-6)
            self.turned[tile] = turned


def slack_factor(width: int) -> np.float32:
    """Of the product of two norms: more than single precision can lose over ``width`` terms and the sums with them."""
    return np.float32((width + 16) * 2.0**-22)


def survivors(a: Rotated, of_a: slice, b: Rotated, of_b: slice, low: np.ndarray, high: np.ndarray | None, fit: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (place in of_a, place in of_b) whose score can lie between low and high (one of each per anchor)."""
    width = a.turned.shape[1]
    slack = a.norm[of_a, None] * (b.norm[of_b] * slack_factor(width))
    low = np.nextafter(low.astype(np.float32), np.float32(-np.inf))[:, None]
    high = None if high is None else np.nextafter(high.astype(np.float32), np.float32(np.inf))[:, None]
    products = np.zeros(slack.shape, np.float32)
    begin = 0
    for step, end in enumerate(a.steps):
        products += a.turned[of_a, begin:end] @ b.turned[of_b, begin:end].T
        rest = a.rest[of_a, step, None] * b.rest[of_b, step] + slack
        alive = products + rest >= low
        if high is not None:
            alive &= products - rest <= high
        if fit is not None:
            alive &= fit
        begin = end
        if np.count_nonzero(alive) <= FEW * alive.size:
            break
    return np.nonzero(alive)


def exact_scores(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    out = np.empty(len(i), np.int64)
    for at in range(0, len(i), PAIRS):
        out[at : at + PAIRS] = np.einsum("ij,ij->i", a[i[at : at + PAIRS]].astype(np.int64), b[j[at : at + PAIRS]].astype(np.int64))
    return out


class Best:
    """The best ``most`` partners of each query: higher scores first, then smaller ids, then smaller rows."""

    def __init__(self, queries: int, most: int):
        self.most, self.queries = most, queries
        self.found = np.zeros((0, 4), np.int64)  # query, score, id, row
        #: The score that a further partner must reach; such with larger ids only.
        self.needed = np.full(queries, NONE, np.int64)

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        if not len(query):
            return
        found = np.concatenate([self.found, np.column_stack([query, score, ids, rows])])
        found = found[np.lexsort((found[:, 3], found[:, 2], -found[:, 1], found[:, 0]))]
        first = np.searchsorted(found[:, 0], found[:, 0])
        rank = np.arange(len(found)) - first
        self.found = found[rank < self.most]
        last = found[rank == self.most - 1]
        self.needed[last[:, 0]] = last[:, 1] + 1


def _tiles(n: int) -> Iterator[slice]:
    begin, rows = 0, FIRST_ROWS
    while begin < n:
        yield slice(begin, min(n, begin + rows))
        begin, rows = begin + rows, min(2 * rows, TILE_ROWS)


class Group:
    """The rows of a group that a task holds, in the order of (label, id) or of id."""

    def __init__(self, parts: list[pa.RecordBatch], turn: np.ndarray):
        column = lambda name: np.concatenate([p.column(p.schema.get_field_index(name)).to_numpy(zero_copy_only=False) for p in parts])
        self.rows, self.ids, self.labels = column("row"), column("id"), column("label")
        self.vectors = Rotated(np.concatenate([from_binary(p.column(p.schema.get_field_index("vec")), len(turn)) for p in parts]), turn)

    def positives(self, anchors: Group, most: int) -> Iterator[pa.RecordBatch]:
        """The best rows of the same label, other than the anchor; anchors stand in the order of their labels."""
        for label in np.unique(anchors.labels):
            of_label = slice(*np.searchsorted(self.labels, [label, label + 1]))
            begin, end = np.searchsorted(anchors.labels, [label, label + 1])
            for at in range(begin, end, TILE_ANCHORS):
                own = slice(at, min(end, at + TILE_ANCHORS))
                best = Best(own.stop - own.start, most)
                for tile in _tiles(of_label.stop - of_label.start):
                    tile = slice(of_label.start + tile.start, of_label.start + tile.stop)
                    i, j = survivors(anchors.vectors, own, self.vectors, tile, best.needed, None, None)
                    i, j = (x[anchors.rows[i + own.start] != self.rows[j + tile.start]] for x in (i, j))
                    scores = exact_scores(anchors.vectors.exact[own], self.vectors.exact[tile], i, j)
                    better = scores >= best.needed[i]
                    best.add(i[better], scores[better], self.ids[tile][j[better]], self.rows[tile][j[better]])
                yield found_rows(anchors.rows[own], best, 1)

    def negatives(self, anchors: Group, limits: np.ndarray, most: int) -> Iterator[pa.RecordBatch]:
        """Per anchor and positive the best rows of other labels; limits: per anchor and positive the least and the largest score."""
        several = limits.shape[1]
        for at in range(0, len(anchors.rows), TILE_ANCHORS):
            own = slice(at, min(len(anchors.rows), at + TILE_ANCHORS))
            low, high = limits[own, :, 0], limits[own, :, 1]
            best = Best(low.size, most)
            for tile in _tiles(len(self.rows)):
                need = np.maximum(low, best.needed.reshape(low.shape))
                need = np.where(need > high, ALL, need)  # nothing more can come in
                other = anchors.labels[own, None] != self.labels[tile]
                i, j = survivors(anchors.vectors, own, self.vectors, tile, need.min(1), high.max(1), other)
                scores = exact_scores(anchors.vectors.exact[own], self.vectors.exact[tile], i, j)
                for p in range(several):
                    fit = (scores >= need[i, p]) & (scores <= high[i, p])
                    best.add(i[fit] * several + p, scores[fit], self.ids[tile][j[fit]], self.rows[tile][j[fit]])
            yield found_rows(anchors.rows[own], best, several)


def found_rows(rows: np.ndarray, best: Best, several: int) -> pa.RecordBatch:
    query, score, ids, other = best.found.T
    columns = [rows[query // several], (query % several).astype(np.int32), score, ids, other]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["row", "query", "score", "id", "other"])


def _scan(turn: np.ndarray, most: int, least: int, largest: int, of_positives: bool) -> Callable:
    """Rows of a group come first, then its anchors, batch by batch."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, parts, group = None, [], None
        for batch in batches:
            key = 2 * batch.column(0).to_numpy() + batch.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
            for begin, end in zip(cuts, cuts[1:]):
                part, which = batch.slice(begin, end - begin), int(key[begin]) if end > begin else None
                if which is None:
                    continue
                if which % 2 == 0:
                    if which // 2 != number:
                        number, parts, group = which // 2, [], None
                    parts.append(part)
                elif which // 2 == number:
                    if group is None:
                        group, parts = Group(parts, turn), []
                    anchors = Group([part], turn)
                    if of_positives:
                        yield from group.positives(anchors, most)
                    else:
                        scores = np.array(part.column(part.schema.get_field_index("scores")).to_pylist(), dtype=np.int64)
                        # least * positive <= 100 * negative <= largest * positive
                        limits = np.stack([-((-least * scores) // 100), (largest * scores) // 100], axis=2)
                        yield from group.negatives(anchors, limits, most)

    return scan


def _against_all(rows: DataFrame, anchors: DataFrame, groups: int, order: list[str], scan: Callable) -> DataFrame:
    """Every anchor past every row: the rows in ``groups`` groups, the anchors once for each of them."""
    names = ["group", "kind", "row", "id", "label", "vec", "scores"]
    held = rows.select(F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int").alias("group"), F.lit(0).alias("kind"), "row", "id", "label", "vec", F.lit(None).cast("array<long>").alias("scores"))
    passing = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), F.lit(1).alias("kind"), *names[2:])
    return held.union(passing).repartition(groups, "group").sortWithinPartitions("group", "kind", *order).mapInArrow(scan, BEST)


def _first(found: DataFrame, most: int) -> DataFrame:
    best = Window.partitionBy("row", "query").orderBy(F.desc("score"), "id", "other")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most)


def mine(vectors: DataFrame, id_column: str = "vec_id", label_column: str = "label", vector_column: str = "embedding", anchor_every: int = ANCHOR_EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, most: int = MOST, scale: int = SCALE) -> DataFrame:
    """For each anchor and each of its best ``positives`` rows of its label, the best ``negatives`` of
    the rows of other labels that score between ``least`` and ``most`` percent of the positive:
    anchor_id, positive_id, rank, negative_id, positive_score, negative_score.
    """
    spark = vectors.sparkSession
    named = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(id_column).cast("long").alias("id"), F.col(label_column).cast("long").alias("label"), F.col(vector_column).alias("x")).where("id is not null and label is not null and x is not null")
    width = named.agg(F.max(F.size("x"))).first()[0]
    if not width:  # no rows, or none with a component: all products are zero
        width = 1
    rows = durable(named.mapInArrow(_quantise(width, scale), ROW), "vectors")
    n = rows.count()
    turn = rotation(second_moments(rows, width))
    groups = max(1, -(-n // GROUP_ROWS), min(partitions(spark), n // TILE_ROWS))
    anchors = rows.where(F.pmod("id", F.lit(anchor_every)) == 0)
    passing = anchors.withColumn("scores", F.lit(None).cast("array<long>"))
    nearest = durable(_first(_against_all(rows, passing, groups, ["label", "id", "row"], _scan(turn, positives, least, most, True)), positives), "positives")
    # Windows of scores; an anchor with fewer positives gets ones that nothing fits.
    known = nearest.where("score >= 0").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("rank", "score"))).alias("p"))
    scores = F.transform(F.sequence(F.lit(0), F.lit(positives - 1)), lambda k: F.coalesce(F.get("p.score", k), F.lit(-100)))
    judged = anchors.join(known.select("row", scores.alias("scores")), "row")
    found = _first(_against_all(rows, judged, groups, ["id", "row"], _scan(turn, negatives, least, most, False)), negatives)
    of = nearest.select(F.col("row"), (F.col("rank") - 1).alias("query"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    named_anchors = anchors.select("row", F.col("id").alias("anchor_id"))
    return found.join(of, ["row", "query"]).join(named_anchors, "row").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def hard_negatives(vectors: DataFrame) -> DataFrame:
    """The operator on ``embeddings`` with changed labels: every seventh id has the next one."""
    changed = F.when(F.col("vec_id") % RELABEL_EVERY == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    return mine(vectors.select("vec_id", changed.alias("label"), "embedding"))
