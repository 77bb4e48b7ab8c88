"""Operators 12 and 13 against brute force: awkward rows, ties, many copies, several groups."""

from __future__ import annotations

import math
import random
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest
from forecourt.llm import clustering, hard_negatives, vectors
from forecourt.llm.clustering import Geometry, cluster_vectors
from forecourt.llm.hard_negatives import Best, Rotated, mine, rotation, survivors
from hypothesis import given, settings
from hypothesis import strategies as st

SCHEMA = "vec_id long, embedding array<double>, label int, rank string, cluster string, row int"
WIDTH = 64


def usable(x):
    return x is not None and all(v is not None and math.isfinite(v) for v in x)


def make_rows(n=700, seed=1, hot=150):
    r = random.Random(seed)
    centres = [[r.gauss(0, 0.1) for _ in range(WIDTH)] for _ in range(12)]
    rows = []
    for i in range(n):
        c = r.choice(centres)
        rows.append((i, [v + r.gauss(0, 0.03) for v in c], r.choice([0, 1, 1, 2, 9])))
    rows += [(5000 + i, list(rows[3][1]), i % 2) for i in range(hot)]  # very many copies
    rows += [rows[100], rows[200], rows[200], (7000, rows[100][1], rows[100][2])]  # repeated rows and anchors
    nan, inf = float("nan"), float("inf")
    rows += [(900, None, 1), (901, [0.5] * 63 + [None], 1), (902, [nan] * WIDTH, 1), (903, [inf] + [0.1] * 63, 2), (904, [0.1] * WIDTH, None), (None, [0.1] * WIDTH, 1), (8000, [-0.2] * WIDTH, 1), (8100, [0.0] * WIDTH, 5), (8101, [0.0] * WIDTH, 5), (8102, [0.0] * WIDTH, 6)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, x, label, "clash", "clash", 1) for i, x, label in rows], SCHEMA).repartition(5)


def by_hand_mining(rows, positives=5, negatives=10):
    rows = [(i, [math.floor(256 * v) for v in x], label) for i, x, label in rows if usable(x) and label is not None and i is not None]
    size = max(len(x) for _, x, _ in rows)
    m = np.array([x + [0] * (size - len(x)) for _, x, _ in rows])
    out = []
    for a, (i, _, label) in enumerate(rows):
        if i % 100:
            continue
        scores = (m @ m[a]).tolist()
        order = sorted((k for k in range(len(rows)) if k != a), key=lambda k: (-scores[k], rows[k][0]))
        for p in [k for k in order if rows[k][2] == label][:positives]:
            fit = [k for k in order if rows[k][2] != label and 30 * scores[p] <= 100 * scores[k] <= 90 * scores[p]][:negatives]
            out += [(i, rows[p][0], n + 1, rows[k][0], scores[p], scores[k]) for n, k in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize("group_rows", [1 << 17, 97])
def test_mining_against_brute_force(spark, monkeypatch, group_rows):
    monkeypatch.setattr(hard_negatives, "GROUP_ROWS", group_rows)
    rows = make_rows() + [(9000, [0.3] * 10, 1), (9001, [0.3] * 12, 2)]  # shorter ones
    got = sorted(map(tuple, mine(frame(spark, rows)).collect()))
    assert len(got) > 200 and got == by_hand_mining(rows)


def test_mining_of_little(spark):
    assert mine(frame(spark, [])).collect() == []
    assert mine(frame(spark, [(0, None, 1)])).collect() == []
    assert mine(frame(spark, [(0, [1.0], 1), (1, [1.0], 1)])).collect() == []
    few = [(0, [1.0, 0.5], 1), (1, [1.0, 0.5], 1), (2, [0.5, 0.25], 2), (100, [0.0, 0.0], 3), (101, [0.0, 1.0], 3)]
    assert sorted(map(tuple, mine(frame(spark, few)).collect())) == by_hand_mining(few)
    with pytest.raises(Exception, match="beyond"):
        mine(frame(spark, [(0, [1e9], 1)])).collect()


@given(st.integers(0, 2**32 - 1), st.sampled_from([1, 3, 64, 130]), st.sampled_from([2, 300, 1 << 20]))
@settings(max_examples=40, deadline=None)
def test_no_wanted_pair_is_discarded(seed, width, size):
    r = np.random.default_rng(seed)
    a, b = r.integers(-size, size, (9, width)), r.integers(-size, size, (50, width))
    b[:20] = a[r.integers(0, 9, 20)]
    turn = rotation((b.T @ b).astype(float))
    scores = a @ b.T
    low, high = np.sort(scores[np.arange(9), r.integers(0, 50, (2, 9))], axis=0)
    fit = r.random((9, 50)) < 0.8
    i, j = survivors(Rotated(a, turn), slice(0, 9), Rotated(b, turn), slice(0, 50), low, high, fit)
    wanted = (scores >= low[:, None]) & (scores <= high[:, None]) & fit
    assert set(zip(*np.nonzero(wanted))) <= set(zip(i, j))
    assert np.allclose(turn @ turn.T, np.eye(width), atol=1e-9)


def test_leading_components_discard_most_pairs():
    r = np.random.default_rng(3)
    basis = r.normal(0, 1, (6, 64))
    b = np.floor(40 * (r.normal(0, 1, (4000, 6)) @ basis + r.normal(0, 0.05, (4000, 64)))).astype(int)
    turn = rotation((b.T @ b).astype(float))
    one = Rotated(b, turn)
    one.steps = one.steps[:1]  # only the leading quarter
    scores = b[:50] @ b.T
    low = np.sort(scores, axis=1)[:, -10]
    i, _ = survivors(one, slice(0, 50), one, slice(0, 4000), low, None, None)
    assert len(i) < 0.02 * scores.size


def test_best_of_equal_scores_are_the_first():
    best = Best(2, 2)
    best.add(np.array([0, 0, 1]), np.array([5, 5, 1]), np.array([3, 2, 9]), np.array([1, 0, 2]))
    assert best.needed.tolist() == [6, hard_negatives.NONE]
    best.add(np.array([0, 1]), np.array([6, 1]), np.array([8, 7]), np.array([3, 4]))
    assert best.found[:, :3].tolist() == [[0, 6, 8], [0, 5, 2], [1, 1, 7], [1, 1, 9]]


def test_vectors_as_bytes():
    for size in (100, 1 << 15, 1 << 25):
        v = np.random.default_rng(1).integers(-size, size, (7, 5))
        assert (vectors.from_binary(vectors.to_binary(v), 5) == v).all()
    mixed = pa.concat_arrays([vectors.to_binary(np.array([[1, -2]])), vectors.to_binary(np.array([[1 << 20, 3]]))])
    assert vectors.from_binary(mixed, 2).tolist() == [[1, -2], [1 << 20, 3]]
    assert vectors.from_binary(vectors.to_binary(np.zeros((0, 5), int)), 5).shape == (0, 5)
    taken, out = vectors.quantised(pa.array([[1.0, -0.001], None, [], [float("inf"), 0], [0.5]]), 10, 2, False)
    assert taken.tolist() == [True, False, True, False, True] and out.tolist() == [[10, -1], [0, 0], [5, 0]]


def by_hand_clusters(rows, clusters=8, rounds=10, seed=3):
    rows = [(i, [math.floor(1024 * v) for v in x]) for i, x, _ in rows if usable(x) and len(x) == WIDTH]
    if not rows:
        return []
    first = sorted((sha256(f"{seed}:{i}".encode()).hexdigest(), x) for i, x in rows if i is not None)
    centroids = [x for _, x in first[:clusters]]
    m = np.array([x for _, x in rows])
    for n in range(rounds + 1):
        d = np.stack([((m - np.array(c)) ** 2).sum(1) for c in centroids], axis=1)
        a = d.argmin(1)  # the first of equal ones
        if n < rounds:
            centroids = [[int(s) // int((a == c).sum()) for s in m[a == c].sum(0)] if (a == c).any() else x for c, x in enumerate(centroids)]
    own = d[np.arange(len(m)), a]
    return [(i, int(c), int(x), int(own[a == c].sum()), int(own.sum()), sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for (i, _), c, x in zip(rows, a, own)]


def test_clusters_against_brute_force(spark):
    rows = make_rows(seed=2) + [(9000, [0.3] * 10, 1), (9002, [1000.0] * WIDTH, 1), (9003, [], 1)]
    got = [tuple(r) for r in cluster_vectors(frame(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted(by_hand_clusters(rows), key=str)


def test_clusters_of_little(spark):
    assert cluster_vectors(frame(spark, [])).collect() == []
    assert cluster_vectors(frame(spark, [(1, None, 1), (None, [0.1] * WIDTH, 1)])).collect() == []
    for rows in ([(1, [0.25] * WIDTH, 1)], [(i % 3, [0.5] * WIDTH, 1) for i in range(40)], [(i, [i / 7] * WIDTH, 1) for i in range(5)]):
        got = [tuple(r) for r in cluster_vectors(frame(spark, rows)).collect()]
        assert sorted(got, key=str) == sorted(by_hand_clusters(rows), key=str)


@given(st.integers(0, 2**32 - 1), st.sampled_from([1, 2, 5, 20]), st.sampled_from([2, 50, 100_000]))
@settings(max_examples=40, deadline=None)
def test_exponion_equals_full_search(seed, k, size):
    """Assignments and bounds over several rounds of arbitrary moves; small ranges make ties."""
    r = np.random.default_rng(seed)
    x = r.integers(-size, size + 1, (60, 3))
    centroids, before = r.integers(-size, size + 1, (k, 3)), None
    cluster, upper, lower = np.full(60, -1), np.zeros(60), np.zeros(60)
    for _ in range(5):
        Geometry(centroids, before).assign(x, cluster, upper, lower)
        d = ((x[:, None] - centroids[None]) ** 2).sum(2)
        assert (cluster == d.argmin(1)).all()
        assert (upper**2 >= d.min(1) * (1 - 1e-9)).all()
        others = np.where(np.arange(k) == cluster[:, None], np.inf, d).min(1)
        assert (np.maximum(lower, 0) ** 2 <= others * (1 + 1e-9)).all()
        before, centroids = centroids, centroids + r.integers(-(size // 10) - 1, size // 10 + 2, (k, 3)) * (r.random((k, 1)) < 0.5)


def test_exponion_scans_little():
    r = np.random.default_rng(5)
    centres = r.integers(-500, 500, (40, 8))
    x = centres[r.integers(0, 40, 5000)] + r.integers(-20, 20, (5000, 8))
    cluster, upper, lower, scanned = np.full(5000, -1), np.zeros(5000), np.zeros(5000), []
    Geometry(centres).assign(x, cluster, upper, lower, scanned)
    scanned.clear()
    Geometry(centres + 1, centres).assign(x, cluster, upper, lower, scanned)
    assert sum(scanned) < 0.1 * 5000 * 40


def test_sums_of_the_round_before_are_left_out(spark):
    rows = [(i, [i / 100] * WIDTH, 1) for i in range(30)]
    got = cluster_vectors(frame(spark, rows), rounds=0).collect()
    assert len(got) == 30 and clustering.ROUNDS == 10
    assert sum(r.distance for r in got) == got[0].inertia
