"""Toxic spans by a linear-chain conditional random field (operator 6).

Document labels are turned into token labels first: words and word beginnings whose
document frequency among toxic training documents is significantly above their base
rate (exact binomial tail, false discovery rate controlled over all units tried) mark the
tokens of toxic documents. The frequencies are counted over all labelled training rows. The field
(two states, features of the word: itself, beginnings, ending) is trained on these by
gradient ascent with forward-backward expectations; a marked word whose units the field's
sample lacks has the mean weight of the marked words that it holds.

The field's weights are fitted on a bounded sample of the labelled rows' tokens: texts of
any length are cut into pieces of PIECE tokens, of which a hash chooses about MOST_TOXIC
from toxic and MOST_CLEAN from clean rows, at most twice as many.
Texts are scored in chains of CHAIN tokens, each with up to MARGIN tokens more on either
side, so that messages cross the cuts; the marginals of all
tokens of the whole text are computed, the highest is the document's score, and the
tokens at or above one half are the offending offsets.

Defined cases: a null, empty or wordless text scores 0 and has no spans; a null doc_id
is in no fold and matches no label; repeated rows give repeated results; several labels of
a document count as often as they occur, null labels do not; very long texts count, train
and are scored whole; without significant units every score is 0; a score of exactly one
half is toxic; an empty table gives no rows; only the id and the text are read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from xxhash import xxh64_intdigest

from .common import durable, in_fold

FOLDS, HELD_OUT, CUTOFF = 5, 0, 0.5
MOST_TOXIC, MOST_CLEAN, PIECE = 8000, 16_000, 64
CHAIN, MARGIN, SLOTS, MOST_WORDS = 32, 16, 7, 300_000
MOST_COUNTED = 200_000
_ROW, _SAMPLED = "", "\x01"  # the key that counts rows; what stands before a piece of the sample
SCHEMA = "doc_id long, held_out boolean, score double, predicted int, spans array<struct<start:int,end:int>>"
_WORD = re.compile(r"[^\W\d_]+")


def word_features(word: str) -> list[str]:
    w = word.lower()
    return ["=" + w, *["^" + w[:k] for k in (3, 4, 5, 6) if len(w) > k], "$" + w[-3:]]


def units(words: set[str]) -> set[str]:
    return {f for w in words for f in word_features(w) if f[0] == "=" or f[0] == "^" and len(f) > 4}


def tail(k: int, n: int, p: float) -> float:
    """P(X >= k) for a binomial X of n trials, from the exact terms; 1 if k is not above the mean."""
    if k <= n * p:
        return 1.0
    term = n * math.log(p)
    terms = [term]
    for j in range(n - k):  # j misses become j + 1
        term += math.log((n - j) / (j + 1) * (1 - p) / p)
        terms.append(term)
    return math.fsum(map(math.exp, terms))


def tail_column(k: Column, n: Column, p: float) -> Column:
    """The same as a column; the terms are as many as n - k."""
    log_terms = F.aggregate(
        F.sequence(F.lit(0), (n - k - 1).cast("int")),
        F.struct((n * math.log(p)).alias("term"), F.exp(n * math.log(p)).alias("sum")),
        lambda got, j: F.struct(
            (got["term"] + F.log((n - j) / (j + 1) * ((1 - p) / p))).alias("term"),
            (got["sum"] + F.exp(got["term"] + F.log((n - j) / (j + 1) * ((1 - p) / p)))).alias("sum"),
        ),
    )
    return F.when(k <= n * p, 1.0).when(n == k, F.exp(n * math.log(p))).otherwise(log_terms["sum"])


def significant_units(toxic: list[set[str]], clean: list[set[str]], level: float = 0.01) -> set[str]:
    if not toxic or not clean:
        return set()
    base = len(toxic) / (len(toxic) + len(clean))
    hot, cold = (Counter(u for words in side for u in units(words)) for side in (toxic, clean))
    chances = {u: tail(n, n + cold[u], base) for u, n in hot.items() if n >= 3 and cold[u] <= 0.1 * n}
    most = discovery_limit(Counter(_grade(x) for x in chances.values()), sum(n >= 3 for n in hot.values()), level)
    return {u for u, x in chances.items() if x <= most}


def _grade(chance: float) -> int:
    """Powers of two that a chance lies below one."""
    return min(1000, int(-math.log2(max(chance, 1e-300))))


def discovery_limit(grades: dict[int, int], tried: int, level: float) -> float:
    """The step-up limit of Benjamini and Hochberg for chances, rounded down to a power of two.

    ``grades``: how many of ``tried`` chances have each grade. Of what is below the limit at
    most the share ``level`` is expected to be there by chance.
    """
    below, limit = 0, 0.0
    for grade in sorted(grades, reverse=True):
        below += grades[grade]
        if 2.0**-grade * tried <= below * level:
            limit = 2.0**-grade
    return limit


def read_labelled(rows: DataFrame, shares: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """(unit, hot, cold) from all rows (text, label): document frequencies, and the sample of pieces.

    ``shares``: how much of the pieces of clean and of toxic rows is sampled. A piece is a
    row of its own whose unit is _SAMPLED and its words, so one pass over the texts serves both.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())

        def flush() -> Iterator[pa.RecordBatch]:
            keys = list(counts[0].keys() | counts[1].keys())
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array([counts[1][k] for k in keys], pa.int64()), pa.array([counts[0][k] for k in keys], pa.int64())], ["unit", "hot", "cold"])
            for c in counts:
                c.clear()

        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                of, words = counts[label], _WORD.findall(text or "")
                of.update(units({w.lower() for w in words}))
                of[_ROW] += 1
                most = shares[label] * 2**64
                for k in range(0, len(words), PIECE):
                    piece = " ".join(words[k : k + PIECE])
                    if xxh64_intdigest(piece, k) < most:
                        of[_SAMPLED + piece] += 1
                if len(counts[0]) + len(counts[1]) > MOST_COUNTED:
                    yield from flush()
        yield from flush()

    return rows.select("text", "label").mapInArrow(count, "unit string, hot long, cold long").groupBy("unit").agg(F.sum("hot").alias("hot"), F.sum("cold").alias("cold"))


def corpus_units(counted: DataFrame, level: float = 0.01) -> set[str]:
    """``significant_units`` by document frequencies over all rows, from ``read_labelled``."""
    whole = counted.where(F.col("unit") == _ROW).first()
    if whole is None or not whole.hot or not whole.cold:
        return set()
    base = whole.hot / (whole.hot + whole.cold)
    hot = counted.where((F.col("unit") != _ROW) & ~F.startswith("unit", F.lit(_SAMPLED)) & (F.col("hot") >= 3))
    chances = hot.where(F.col("cold") <= 0.1 * F.col("hot")).select("unit", tail_column(F.col("hot"), F.col("hot") + F.col("cold"), base).alias("chance"))
    grade = F.least(F.lit(1000), (-F.log2(F.greatest("chance", F.lit(1e-300)))).cast("int"))
    grades = {r.grade: r.n for r in chances.groupBy(grade.alias("grade")).agg(F.count("*").alias("n")).collect()}  # at most 1000
    found = chances.where(F.col("chance") <= discovery_limit(grades, hot.count(), level))
    return {r.unit for r in found.select("unit").collect()}  # toxic words only


@dataclass
class Field:
    """Emission weights by feature; ``step[a, b]``: weight of state b after state a."""

    weights: dict[str, float]
    bias: float
    step: np.ndarray
    start: float
    unseen: frozenset[str] = frozenset()  # significant units that the sample lacks
    mean: float = 0.0  # what a marked word's features weigh in the mean

    def emission(self, word: str) -> float:
        features = word_features(word)
        weight = sum(self.weights.get(f, 0.0) for f in features)
        if self.unseen and not self.unseen.isdisjoint(features):
            weight = max(weight, self.mean)
        return self.bias + weight


def marginals(emission: np.ndarray, step: np.ndarray, start: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior log odds of state 1 for padded chains (chains x CHAIN; pad -60), and the two messages.

    With two states a message is one ratio, so forward and backward passes are scalar
    recursions, run over all chains at once. A pad is state 0 with certainty and its
    transitions are common factors of what stands before it.
    """
    t = np.exp(step)
    e = np.exp(emission.clip(-60, 60))
    forward, backward = np.empty_like(e), np.ones_like(e)
    forward[:, 0] = e[:, 0] * np.exp(start)
    for k in range(1, e.shape[1]):
        r = forward[:, k - 1]
        forward[:, k] = e[:, k] * (t[0, 1] + r * t[1, 1]) / (t[0, 0] + r * t[1, 0])
    for k in range(e.shape[1] - 2, -1, -1):
        b = e[:, k + 1] * backward[:, k + 1]
        backward[:, k] = (t[1, 0] + b * t[1, 1]) / (t[0, 0] + b * t[0, 1])
    return np.log(forward * backward + 1e-300), forward, backward


def padded(values: np.ndarray, lengths: np.ndarray, pad: float) -> tuple[np.ndarray, np.ndarray]:
    """Values laid out by chain, one per text, and the flat places that hold them."""
    width = int(lengths.max())
    first = np.repeat(np.arange(len(lengths)) * width, lengths)
    within = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out = np.full(len(lengths) * width, pad)
    out[first + within] = values
    return out.reshape(-1, width), first + within


def overlapped(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chains of texts that stand one after the other: token of each place (-1: none), and which places are a chain's own."""
    chains = -(-tokens // CHAIN)
    text = np.repeat(np.arange(len(tokens)), chains)
    begin = (np.arange(chains.sum()) - np.repeat(np.cumsum(chains) - chains, chains)) * CHAIN
    at = np.maximum(begin - MARGIN, 0)[:, None] + np.arange(CHAIN + 2 * MARGIN)[None, :]
    n = tokens[text][:, None]
    own = (at >= begin[:, None]) & (at < np.minimum(begin[:, None] + CHAIN, n))
    inside = at < np.minimum(begin[:, None] + CHAIN + MARGIN, n)
    return np.where(inside, at + (np.cumsum(tokens) - tokens)[text][:, None], -1), own


def fit(rows: list[tuple[str, int]], marks: set[str] | None = None, rounds: int = 80, rate: float = 0.5, ridge: float = 0.05) -> Field:
    """Train on (text, toxic) rows, each one chain; ``marks``: the significant units, by default those of the rows."""
    toxic = np.array([y == 1 for _, y in rows], bool)
    if marks is None:
        cut = [set(_WORD.findall(t or "")) for t, _ in rows]
        marks = significant_units([w for w, y in zip(cut, toxic) if y], [w for w, y in zip(cut, toxic) if not y])
    if not marks:
        return Field({}, -60.0, np.zeros((2, 2)), 0.0)
    # Words become numbers text by text, and features are made anew where needed, so the sample stands in memory once.
    known: dict[str, int] = {}
    numbered = [np.array([known.setdefault(w, len(known)) for w in map(str.lower, _WORD.findall(t or ""))], np.int32) for t, _ in rows]
    tokens = np.array([len(x) for x in numbered])
    flat = np.concatenate([*numbered, np.empty(0, np.int32)])
    del numbered
    often = Counter(f for w in known for f in word_features(w))
    marked = np.array([not marks.isdisjoint(word_features(w)) for w in known], bool)
    owner = np.repeat(toxic, tokens)
    gold = marked[flat] & owner
    if not gold.any():  # all marked words are as toxic as can be
        return Field({}, -4.0, np.zeros((2, 2)), 0.0, frozenset(marks), 8.0)
    unseen = frozenset(m for m in marks if m not in often)
    names = {f: k for k, f in enumerate(f for f, n in often.items() if n > 1 or f in marks)}
    del often
    pad = len(names)
    slots = np.full((len(known), SLOTS), pad, np.int32)
    for k, w in enumerate(known):
        got = [names[f] for f in word_features(w) if f in names]
        slots[k, : len(got)] = got
    lengths = tokens[tokens > 0]
    _, places = padded(np.zeros(len(flat)), lengths, 0.0)
    width = int(lengths.max())
    real = np.zeros(len(lengths) * width, bool)
    real[places] = True
    real = real.reshape(-1, width)
    y = np.zeros(real.size)
    y[places] = gold
    y = y.reshape(-1, width)
    follows = real[:, 1:]
    want_step = np.array([[((1 - y[:, :-1]) * (1 - y[:, 1:]) * follows).sum(), ((1 - y[:, :-1]) * y[:, 1:] * follows).sum()], [(y[:, :-1] * (1 - y[:, 1:]) * follows).sum(), (y[:, :-1] * y[:, 1:] * follows).sum()]])
    theta = np.zeros(pad + 1 + 1 + 4 + 1)  # features, pad, bias, transitions, start
    theta[pad + 1] = math.log(max(gold.sum(), 1) / len(gold))
    memory = np.full_like(theta, 1.0)
    for _ in range(rounds):
        step, start = theta[pad + 2 : pad + 6].reshape(2, 2), theta[-1]
        by_word = theta[slots].sum(1) + theta[pad + 1]
        e = np.full(real.size, -60.0)
        e[places] = by_word[flat]
        e = e.reshape(-1, width)
        odds, forward, backward = marginals(e, step, start)
        p = 1 / (1 + np.exp(-odds))
        error = (y - p).ravel()[places]
        of_words = np.bincount(flat, error, len(known))
        gradient = np.zeros_like(theta)
        gradient[: pad + 1] = np.bincount(slots.ravel(), np.repeat(of_words, SLOTS), pad + 1)
        gradient[pad] = 0
        gradient[pad + 1] = error.sum()
        right, left = np.exp(e[:, 1:].clip(-60, 60)) * backward[:, 1:], forward[:, :-1]
        t = np.exp(step)
        share = follows / (t[0, 0] + t[0, 1] * right + t[1, 0] * left + t[1, 1] * left * right)
        joint = [t[0, 0] * share.sum(), t[0, 1] * np.vdot(right, share), t[1, 0] * np.vdot(left, share), t[1, 1] * np.vdot(left * right, share)]
        gradient[pad + 2 : pad + 6] = want_step.ravel() - joint
        gradient[-1] = (y[:, 0] - p[:, 0]).sum()
        gradient -= ridge * theta
        memory += gradient**2
        theta += rate * gradient / np.sqrt(memory)
        theta[pad] = 0
    weights = {f: float(theta[k]) for f, k in names.items() if abs(theta[k]) > 1e-3}
    return Field(weights, float(theta[pad + 1]), theta[pad + 2 : pad + 6].reshape(2, 2).copy(), float(theta[-1]), unseen, float(theta[slots].sum(1)[flat[gold]].mean()))


def train(docs: DataFrame, labels: DataFrame) -> Field:
    """The field, from one pass over the labelled texts outside the held-out fold."""
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("label")).where("label in (0, 1)").where(~in_fold("doc_id", FOLDS, HELD_OUT))
    of_label = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    size = docs.agg(F.sum(F.length("text")).alias("chars"), F.count("*").alias("rows")).first()
    per_row = (size.chars or 0) / max(size.rows, 1) / (7 * PIECE)  # pieces of the mean text
    shares = tuple(min(1.0, most / max(of_label.get(y, 0) * per_row, 1e-9)) for y, most in ((0, MOST_CLEAN), (1, MOST_TOXIC)))
    # The same plan at every size: labels are hashed, texts pass by.
    labelled = docs.select(F.col("doc_id").alias("__id"), "text").join(known.hint("shuffle_hash"), F.col("__id") == F.col("doc_id"))
    counted = durable(read_labelled(labelled, shares), "units")
    marks = corpus_units(counted)
    if not marks:
        return fit([])
    sample = counted.where(F.startswith("unit", F.lit(_SAMPLED)))
    found = [r for what, most in (("hot", MOST_TOXIC), ("cold", MOST_CLEAN)) for r in sample.where(F.col(what) > 0).limit(2 * most).select("unit", F.lit(int(what == "hot")).alias("y")).collect()]
    return fit(sorted((r.unit[1:], r.y) for r in found), marks)


def score_texts(texts: list[str], field: Field, memo: dict[str, float]) -> list[tuple[float, list[dict]]]:
    words = [_WORD.findall(t) for t in texts]
    missing = set().union(*words).difference(memo)
    memo.update((w, field.emission(w)) for w in missing)
    out: list[tuple[float, list[dict]]] = [(0.0, [])] * len(texts)
    having = [k for k, ws in enumerate(words) if ws]
    if having:
        flat = np.array([e for k in having for e in map(memo.__getitem__, words[k])])
        per_text = np.array([len(words[k]) for k in having])
        token, own = overlapped(per_text)
        laid = np.where(token >= 0, flat.take(np.maximum(token, 0)), -60.0)
        odds = marginals(laid, field.step, field.start)[0][own]  # in the order of the tokens
        firsts = np.cumsum(per_text) - per_text
        best = np.maximum.reduceat(odds, firsts)
        for k, first, n, top in zip(having, firsts, per_text, best):
            spans = []
            if top >= 0:
                hot = set(np.flatnonzero(odds[first : first + n] >= 0).tolist())
                spans = [{"start": m.start(), "end": m.end()} for i, m in enumerate(_WORD.finditer(texts[k])) if i in hot]
            out[k] = (float(1 / (1 + math.exp(-max(-60.0, min(60.0, top))))), spans)
    if len(memo) > MOST_WORDS:
        for w in missing:
            del memo[w]
    return out


def score_documents(docs: DataFrame, field: Field) -> DataFrame:
    from .packing import _groups

    shared = docs.sparkSession.sparkContext.broadcast(field)  # weights of the sample's words, so bounded by its size

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, memo = shared.value, {}
        for batch in batches:
            ids, held = batch.column(0), batch.column(2)
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for begin, stop in _groups(texts):
                got = score_texts(texts[begin:stop], model, memo)
                scores = [s for s, _ in got]
                yield pa.RecordBatch.from_arrays(
                    [ids[begin:stop], held[begin:stop], pa.array(scores, pa.float64()), pa.array([int(s >= CUTOFF) for s in scores], pa.int32()), pa.array([s for _, s in got], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))],
                    ["doc_id", "held_out", "score", "predicted", "spans"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text", in_fold("doc_id", FOLDS, HELD_OUT).alias("held_out")).mapInArrow(score, SCHEMA)
