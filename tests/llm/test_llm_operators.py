"""The training-data operators against brute force on small fixtures with awkward rows."""

from __future__ import annotations

import base64
import random
import re
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from forecourt.llm import byte_bpe, language_id, language_model, order_minhash, packing, quality_classifier, quality_rules, simhash, suffix_dedup, toxicity
from forecourt.llm.components import components
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, score double"
WORDS = {"en": "the of and thing with ration tion edly er".split(), "de": "der und schaft über groß nicht eine".split(), "fr": "le été français où ça près une".split()}
EMPTY = "doc_id long, text string"


def text_of(lang, r, n=120):
    return " ".join(r.choice(WORDS[lang]) + r.choice(WORDS[lang]) for _ in range(n)) + "."


def make_rows():
    r = random.Random(3)
    rows = []
    for i in range(60):
        lang = ("en", "de", "fr")[i % 3]
        rows.append((i, text_of(lang, r), lang))
    passage = text_of("en", r, 60)
    rows += [(100, passage + " one", "en"), (101, "two " + passage, "en"), (102, rows[0][1], "fr"), (103, rows[0][1], "en")]
    rows += [(104, None, "en"), (105, "", None), (106, " \n\t ", "en"), (107, "ab " * 400, "en"), (108, "x", "en"), (108, "x", "en"), (None, "null id " * 40, "en"), (109, "\x1c  　word's 12 \U0001f600\r\n", "en"), (110, "12 34!", "de")]
    rows.append((111, " ".join(text_of("de", r, 50) for _ in range(60)), "de"))
    return rows


ROWS = make_rows()
#: The smallest doc_id of the fixture goes first, null ids before it, as Spark orders them.
TEXTS = [t or "" for _, t, _ in ROWS]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, lang, "s", None, "clash", 0.5) for i, t, lang in ROWS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, 0 if i == 107 else 1, 0) for i, _, _ in ROWS if i is not None] + [(1, None, None), (None, 1, 1), (999, 0, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def crc(i):
    return zlib.crc32(str(i).encode())


# 1


def test_language_id(docs, empty):
    got = by_id(language_id.identify_documents(docs))
    assert len(got) == len({i for i, _, _ in ROWS})
    right = [got[i].lang_pred == lang for i, t, lang in ROWS if i is not None and i < 60]
    assert np.mean(right) == 1.0
    for i in (104, 105, 106, 110):
        assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
    assert all(r.held_out == (i is not None and crc(i) % 4 == 2) and 0 <= r.score <= 1 for i, r in got.items())
    assert language_id.identify_documents(empty).count() == 0


def brute_profile(text, width=language_id.WIDTH):
    """One trigram at a time: the product of three shifted letter vectors, summed."""
    letters = np.random.default_rng(7).choice(np.array([-1, 1], np.int8), (language_id.LETTERS, width)).astype(int)
    codes = [0, *(int(language_id.letter_table()[ord(c)]) for c in text), 0]
    out = np.zeros(width)
    for k in range(1, len(codes) - 1):
        if codes[k]:
            out += np.roll(letters[codes[k - 1]], 2) * np.roll(letters[codes[k]], 1) * letters[codes[k + 1]]
    return out / (np.linalg.norm(out) or 1)


def test_language_id_against_brute_force(docs):
    sums = {}
    for i, t, lang in ROWS:
        if i is not None and crc(i) % 4 != 2 and lang and any(c.isalpha() for c in t or ""):
            sums[lang] = sums.get(lang, 0) + brute_profile(t)
    unit = lambda v: v / (np.linalg.norm(v) or 1)
    protos = {k: unit(v) for k, v in sorted(sums.items())}
    mean = np.mean(list(protos.values()), axis=0)
    protos = {k: unit(v - mean) for k, v in protos.items()}
    texts = {i: t for i, t, _ in ROWS}
    for r in language_id.identify_documents(docs).collect():
        if r.lang_pred != "und":
            cosines = {k: v @ brute_profile(texts[r.doc_id]) for k, v in protos.items()}
            best = max(cosines, key=cosines.get)
            assert r.lang_pred == best
            assert r.score == pytest.approx(1 / sum(np.exp(language_id.SHARPNESS * (c - cosines[best])) for c in cosines.values()), abs=1e-3)


def test_bounded_trigram_memory():
    """Texts with more trigrams than are kept, and than are bound at a time, have the same vectors."""
    text = "".join(chr(97 + k * k % 26) + chr(0xE0 + k % 23) + chr(97 + k // 7 % 26) for k in range(9000))
    small, whole = language_id.Trigrams(most=100), language_id.Trigrams()
    assert np.allclose(small.profile(text), whole.profile(text), atol=1e-6) and small.known <= 100 and len(small.rows) <= 1024
    assert np.allclose(small.profile(text), brute_profile(text), atol=1e-5)


def test_permutation_tells_order():
    t = language_id.Trigrams()
    assert t.profile("abc") @ t.profile("cba") < 0.9 and t.profile("é").any() and t.profile("12") is None


# 2


def test_language_model(spark, docs, empty, monkeypatch):
    monkeypatch.setattr(language_model, "STEPS", 30)
    monkeypatch.setattr(language_model, "MOST_WORDS", 20)
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").encode().lower().decode())
    counts = Counter(w for i, t, _ in ROWS if i is not None and crc(i) % 7 != 2 for w in [*words(t), None])
    n, v = sum(counts.values()), len(counts)
    got = language_model.score_documents(docs).collect()
    assert len(got) == len(ROWS)
    texts = {i: t for i, t, _ in ROWS}
    for r in got:
        w = [*words(texts[r.doc_id]), None]
        assert r.n_tokens == len(w) and r.train_tokens == n and r.n_known == sum(counts[x] > 0 for x in w)
        assert r.base_score == pytest.approx(sum(np.log10((counts[x] + 1) / (n + v + 1)) for x in w))
        assert r.score < 0
    assert language_model.score_documents(empty).count() == 0


def brute_score(model, text, counts):
    """A text's log10 probability token by token: one query, its own context, no batches, no masks."""
    m, a = language_model, model.attention
    ids, sizes = (x[0] for x in m.token_ids([m.words_of(text)]))
    stream = [m._BLANK, *ids[:-1].tolist()]
    at = lambda i: a.by_class[a.classes[i]] + a.by_id[i]
    logs, starts = [], []
    for t, target in enumerate(ids.tolist()):
        seen = stream[max(0, (t // m.STRIDE - 1) * m.STRIDE) : t + 1]
        x = at(stream[t])
        weights = np.array([x @ a.query @ (at(i) @ a.key) / np.sqrt(m.WIDTH) + a.distance[len(seen) - 1 - k] for k, i in enumerate(seen)])
        weights = np.exp(weights - weights.max())
        context = sum(w * (at(i) @ a.value) for w, i in zip(weights / weights.sum(), seen))
        logits = np.concatenate([context, x]) @ a.out + a.bias
        p = np.exp(logits - logits.max())
        p /= p.sum()
        before = int(a.classes[stream[t]])
        logs.append(np.log10(p[a.classes[target]]) + model.inside[before, target])
        starts.append(np.log10(p @ model.starting[before]))
    total, place = 0.0, 0
    for word, n in [*zip(m.words_of(text), sizes.tolist()), (None, 1)]:
        attended = sum(logs[place : place + n]) - starts[place] + (starts[place + n] if word is not None else 0.0)
        share = (counts[word] + 1) / 10**model.each
        total += np.log10(model.share * share + (1 - model.share) * 10.0**attended)
        place += n
    return total


def test_scores_against_brute_force(docs, monkeypatch):
    monkeypatch.setattr(language_model, "STEPS", 40)
    monkeypatch.setattr(language_model, "MOST_WORDS", 20)
    counts = Counter(w for i, t, _ in ROWS if i is not None and crc(i) % 7 != 2 for w in [*language_model.words_of(t), None])
    models, trained = [], language_model.train
    monkeypatch.setattr(language_model, "train", lambda d: (models.append(trained(d)), models[-1])[1])
    got = language_model.score_documents(docs).collect()
    texts = {i: t for i, t, _ in ROWS}
    for r in got:
        assert r.score == pytest.approx(brute_score(models[0][0], texts[r.doc_id], counts), rel=1e-3, abs=1e-2)


def test_training_helps(spark, monkeypatch):
    """Held-out texts are likelier after training than before."""
    r = random.Random(15)
    rows = [(i, text_of("en", r, 150)) for i in range(150)]
    df = spark.createDataFrame(rows, EMPTY)
    model, _ = language_model.train(df)
    held = [language_model.words_of(t) for i, t in rows if crc(i) % 7 == 2]
    ids, _ = language_model.token_ids(held)
    fresh = language_model.Attention.fresh(model.attention.classes)
    before = language_model.Model(fresh, model.inside, model.starting, model.words, model.tokens, model.distinct, model.ends)
    after, untrained = (language_model.score_ids(ids, m, m.attention.tables())[0].mean() for m in (model, before))
    assert after > untrained + 0.05


def test_words_share_a_probability():
    """The windows score each token once, and class shares add up."""
    ids = [np.arange(5), np.arange(40), np.array([language_model.END])]
    _, targets, owner = language_model.windows(ids)
    for k, x in enumerate(ids):
        got = targets[owner == k]
        assert (got[got >= 0] == x).all()
    classes = language_model.find_classes(ids)
    cells = np.random.default_rng(0).integers(0, 3, (language_model.CLASSES, language_model.VOCABULARY)).astype(float)
    shares = 10.0 ** language_model.log_within(cells, classes)[5]
    sums = np.bincount(classes[: language_model.VOCABULARY].astype(int), shares, language_model.CLASSES)
    assert np.allclose(sums[sums > 0], 1, atol=1e-3)


def test_attention_is_causal():
    classes = language_model.find_classes([np.arange(100, 200)])
    model = language_model.Attention.fresh(classes)
    nearness = language_model._offsets(model.distance) + language_model._CAUSAL
    one = np.full((1, 2 * language_model.STRIDE), 100)
    two = one.copy()
    two[0, -1] = 150
    a, b = (model.weights(x, model.tables(), nearness) for x in (one, two))
    assert np.allclose(a[:-1], b[:-1]) and not np.allclose(a[-1], b[-1])


def test_attention_reaches_back():
    """128 classes, and a token 32 places before still counts at every place."""
    classes = language_model.find_classes([np.arange(100, 400)])
    assert len(set(classes[100:400].tolist())) > 64
    model = language_model.Attention.fresh(classes)
    nearness = language_model._offsets(model.distance) + language_model._CAUSAL
    ids = np.arange(100, 180)
    inputs, targets, _ = language_model.windows([ids])
    changed, _, _ = language_model.windows([np.concatenate([ids[:39], [399], ids[40:]])])
    at = np.flatnonzero(targets.ravel() == ids[39 + 32])
    read = lambda x: np.where(x >= 0, x, language_model._BLANK + 1)
    a, b = (model.weights(read(x), model.tables(), nearness)[at] for x in (inputs, changed))
    assert not np.allclose(a, b)


def test_training_steps_follow_the_loss_of_scoring():
    """Each gradient of a step is the slope of what scoring gives, also when batches of other sizes came before."""
    r = np.random.default_rng(4)
    ids = [r.integers(100, 160, n) for n in (1, 40, 200, 75)]
    inputs, targets, _ = language_model.windows(ids)
    model = language_model.Attention.fresh(language_model.find_classes(ids))
    trainer = language_model.Trainer(model)
    for size in (3, len(inputs), 2, len(inputs)):
        trainer.train(inputs[:size], targets[:size], 0.01, 0.01)
    before = {n: x.copy() for n, x in trainer.one.items()}
    held = {n: getattr(model, n).copy() for n in language_model.DENSE}

    def loss():
        p = model.weights(np.where(inputs >= 0, inputs, language_model._BLANK + 1), model.tables(), language_model._offsets(model.distance) + language_model._CAUSAL)
        real = targets.ravel() >= 0
        return -np.log(p[np.arange(len(p)), model.classes[targets.ravel().clip(0)]] / p.sum(1))[real].mean(dtype=float)

    trainer.train(inputs, targets, 0.0, 0.0)
    for n in language_model.DENSE:
        slope = (trainer.one[n] - 0.9 * before[n]) / 0.1
        size = np.linalg.norm(slope)
        around = []
        for sign in (1, -1):
            setattr(model, n, held[n] + np.float32(sign * 0.01) * slope / size)
            around.append(loss())
        setattr(model, n, held[n])
        assert size > 0 and abs((around[0] - around[1]) / 0.02 / size - 1) < 0.03, n


def test_attention_is_trained_on_all_rows(spark, monkeypatch):
    """Long texts, and ids that no sampled text has, get classes and embeddings."""
    r = random.Random(5)
    rows = [(i, " ".join(r.choice(["zebra", "quartz", "violin", "harbor", "meadow"]) for _ in range(1500))) for i in range(10)]
    df = spark.createDataFrame(rows, EMPTY)
    model, _ = language_model.train(df)
    ids = np.unique(np.concatenate(language_model.token_ids([language_model.words_of(t) for _, t in rows])[0]))
    ids = ids[ids != language_model.END]
    assert (model.attention.classes[ids] < language_model.CLASSES - 1).all()
    assert np.abs(model.attention.by_id[ids]).sum(1).all()
    for shard in (4_000, 10**9):
        monkeypatch.setattr(language_model, "SHARD", shard)
        again = language_model.train(df.repartition(7))[0].attention
        assert np.isfinite(again.by_id).all() and np.abs(again.by_id[ids]).sum(1).all()


# 3


def test_packing(docs, empty):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    marked = [(300, "a <|endoftext|> b"), (301, "<|endoftext|>"), (302, "x<|endoftext|><|endoftext|>  y\n<|endoftext"), (303, "<|endoftext|> " * 700)]
    docs = docs.select("doc_id", "text").union(docs.sparkSession.createDataFrame(marked, EMPTY))
    got = packing.pack_documents(docs, with_ids=True).collect()
    ids = Counter((i, tuple([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2])) for i, t in [*((i, t) for i, t, _ in ROWS), *marked])
    pieces = {}
    for r in got:
        assert r.length == len(r.ids) <= 1024 and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        pieces.setdefault(r.doc_id, []).append(r)
    for (i, seq), n in ids.items():
        mine = sorted((p.piece, p.start, tuple(p.ids)) for p in pieces[i])
        assert mine == sorted([(k, s, tuple(seq[s : s + m])) for k, (s, m) in enumerate(spans(len(seq)))] * n)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack_documents(empty).count() == 0
    total = sum(r.length for r in got)
    assert len(bins) <= -(-total // 1024) + 4 * docs.rdd.getNumPartitions()  # little more than a full one for each


def spans(n):
    first = (n - 1) % 1024 + 1
    return [(0, first), *[(s, 1024) for s in range(first, n, 1024)]]


@given(st.lists(st.integers(1, 50), max_size=80), st.integers(1, 5))
def test_best_fit_takes_the_tightest(lengths, most):
    bins, free = packing.BestFit(50, most), []
    for n in lengths:
        fits = [f for f in free if f >= n]
        if not fits and len(free) >= most:
            free.remove(min(free))  # the fullest closes
        room = min(fits) if fits else 50
        assert bins.place(n)[1] == 50 - room
        if fits:
            free.remove(room)
        if room > n:
            free.append(room - n)
        assert bins.open == len(free)


# 4


def brute_rules(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    counts, covered = Counter(windows), set()
    for i, x in enumerate(windows):
        if counts[x] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(spark, docs, empty, labels):
    more = spark.createDataFrame([(200, "a b c\na b c\n\n \na b c"), (201, "#| é😀 x\r\n")], EMPTY)
    texts = {i: t or "" for i, t, _ in ROWS} | {200: "a b c\na b c\n\n \na b c", 201: "#| é😀 x\r\n"}
    got = quality_rules.judge_documents(docs.select("doc_id", "text").union(more), labels).collect()
    assert len(got) == len(ROWS) + 2
    for r in got:
        want = brute_rules(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and (not r.kept or not r.base_failed)
    assert quality_rules.judge_documents(empty, labels).count() == 0
    kept = quality_rules.keep_documents(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.kept and r.doc_id not in (200, 201)}


def brute_cutoffs(rows):
    """The laxest best certified cutoffs from (statistics, label) rows, one at a time."""
    from fractions import Fraction
    from math import comb

    def at_most(k, n, p):
        return float(sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)))

    risk, level = Fraction(1, 100), quality_rules.LEVEL / 15
    out = {}
    for s, first in enumerate((50, 150, 600), 1):
        own = [(v, y) for n, v, y in rows if n >= first and (s == 3 or n < (50, 150, 600)[s])]
        good = sum(y for _, y in own)
        for rule in quality_rules.RULES:
            best = 0
            for cutoff in quality_rules.GRID:
                false, true = (sum(v[rule] > cutoff for v, y in own if y == kind) for kind in (1, 0))
                if false > good / 100 or at_most(false, good, risk) > level:
                    break
                if true - quality_rules.GOOD_COST * false > best:
                    best, out[s, rule] = true - quality_rules.GOOD_COST * false, cutoff
    return out


def test_rules_are_selected_as_by_brute_force(spark):
    """Cutoffs that reject, equal to a plain selection; few good documents of the held-out fold go."""
    r = random.Random(9)
    rows = []
    for i in range(1700):
        words = [f"{w}{i}" for w in text_of("en", r, 60 if i % 3 else 170).split()]
        bad = i % 9 < 2
        if bad or i == 2:
            words = [w + "#" * (k % 2) for k, w in enumerate(words)]
        rows.append((i, " ".join(words), int(not bad)))
    docs = spark.createDataFrame([r[:2] for r in rows], EMPTY).repartition(3)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    measured = []
    for i, t, y in rows:
        n, chars, symbols, lines, repeats = brute_rules(t)
        if crc(i) % 5 and n >= 50 and 100 * repeats <= 50 * n:
            values = {"symbols": symbols / n, "capitals": len(re.findall("[A-Z]", t)) / chars, "exclamations": t.count("!") / n, "repeats": repeats / n, "lines": lines / max(1, sum(bool(x.split()) for x in t.split("\n")))}
            measured.append((n, values, y))
    want = brute_cutoffs(measured)
    assert (1, "symbols") in want
    stats = quality_rules.durable(quality_rules.with_statistics(docs), "rules")
    assert quality_rules.cutoffs(stats, labels) == want
    got = by_id(quality_rules.judge_documents(docs, labels))
    for i, t, _ in rows:
        n, _, symbols, _, _ = brute_rules(t)
        s = 1 if n < 150 else 2
        assert got[i].kept == (not got[i].base_failed and symbols / n <= want.get((s, "symbols"), 9))
    good = [got[i] for i, _, y in rows if y and crc(i) % 5 == 0 and not got[i].base_failed]
    assert sum(not r.kept for r in good) <= quality_rules.RISK * len(good)
    assert not any(got[i].kept for i, t, y in rows if not y and len(t.split()) < 150)
    kept = quality_rules.keep_documents(docs, labels)
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}


def test_cutoffs_are_certified():
    assert quality_rules.binomial_at_most(0, 3, 0.5) == pytest.approx(0.125)
    assert quality_rules.binomial_at_most(3, 3, 0.5) == 1.0
    none, some = len(quality_rules.GRID), 3
    assert quality_rules.select_cutoffs({(0, "symbols"): {none: [20, 0], some: [0, 9]}}) == {}
    assert quality_rules.select_cutoffs({(0, "symbols"): {none: [2000, 0], some: [0, 9]}}) == {(0, "symbols"): quality_rules.GRID[some]}


# 5

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def reference_coder():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}, special_tokens={})


def test_byte_bpe(docs, empty, reference_coder):
    texts = {i: t or "" for i, t, _ in ROWS}
    got = byte_bpe.encode_documents(docs).collect()
    assert len(got) == len(ROWS)
    for r in got:
        ids = reference_coder.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == sha256(texts[r.doc_id].encode()).hexdigest()
    assert byte_bpe.encode_documents(empty).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \n\t'sabthe1é。 "), st.characters(exclude_categories=["Cs"])), max_size=30))
def test_byte_bpe_is_exact(reference_coder, text):
    coder = byte_bpe.coder(RANKS)
    ids = reference_coder.encode_ordinary(text)
    assert coder.encode(text) == ids and coder.decode(ids) == text.encode()
    assert [i for p in byte_bpe.memo(RANKS).encode([text])[0] for i in map(int, filter(None, p[1].split(",")))] == ids


# 6


def toxic_rows(n=240):
    r = random.Random(1)
    rows = []
    for i in range(n):
        words = text_of("en", r, 60).split()
        toxic = i % 4 == 0
        for _ in range(3 * toxic):
            words.insert(r.randrange(len(words)), r.choice(["vileword", "vilething", "awfulness"]))
        rows.append((" ".join(words), int(toxic)))
    return rows


def test_toxicity(spark, empty, labels):
    rows = toxic_rows()
    docs = spark.createDataFrame([*enumerate(t for t, _ in rows), (900, None), (901, ""), (902, "12 !"), (None, "vileword")], EMPTY)
    known = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)], "doc_id long, toxic int")
    got = by_id(toxicity.score_documents(docs, toxicity.train(docs, known)))
    held = [i for i in range(len(rows)) if got[i].held_out]
    assert held == [i for i in range(len(rows)) if crc(i) % 5 == 0]
    assert all(got[i].predicted == rows[i][1] for i in held)
    spans = [rows[i][0][s.start : s.end] for i in held if rows[i][1] for s in got[i].spans]
    assert spans and all(re.match("vile|awful", s) for s in spans)
    assert [got[i].score for i in (900, 901, 902)] == [0.0] * 3 and got[None].predicted == 1
    model = toxicity.train(empty, labels)
    assert toxicity.score_documents(empty, model).count() == 0


def test_toxic_words_of_long_texts(spark):
    """Units are counted over all labelled rows: words that only long toxic texts hold are marked."""
    rows = toxic_rows()
    filler = " ".join(["thing"] * 3000)
    rows += [(f"{filler} grimword {filler}", 1) for _ in range(25)]
    rows += [(filler, 0) for _ in range(60)] + [("thing grimword thing", 0)]
    docs = spark.createDataFrame(list(enumerate(t for t, _ in rows)), EMPTY)
    assert min(len(t) for t, _ in rows[240:265]) > 12_000
    known = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows[:-1])], "doc_id long, toxic int")
    got = by_id(toxicity.score_documents(docs, toxicity.train(docs, known)))
    last = got[len(rows) - 1]
    assert [rows[-1][0][s.start : s.end] for s in last.spans] == ["grimword"] and last.predicted == 1


def test_units_as_in_memory(spark):
    rows = toxic_rows()
    cut = [{w for w in re.findall(r"[^\W\d_]+", t)} for t, _ in rows]
    want = toxicity.significant_units([w for w, (_, y) in zip(cut, rows) if y], [w for w, (_, y) in zip(cut, rows) if not y])
    counted = toxicity.read_labelled(spark.createDataFrame(rows, "text string, label int"), (1.0, 0.5))
    assert want and toxicity.corpus_units(counted) == want
    pieces = [r for r in counted.collect() if r.unit.startswith(toxicity._SAMPLED)]
    assert sum(r.cold for r in pieces) == sum(-(-len(re.findall(r"[^\W\d_]+", t)) // toxicity.PIECE) for t, y in rows if not y)
    assert 0 < sum(r.hot for r in pieces) < sum(y for _, y in rows)


def test_exact_tails(spark):
    from math import comb

    p = 0.2
    pairs = [(3, 3), (3, 4), (7, 9), (1, 9), (40, 43)]
    want = [sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k, n + 1)) if k > n * p else 1.0 for k, n in pairs]
    assert [toxicity.tail(k, n, p) for k, n in pairs] == pytest.approx(want)
    df = spark.createDataFrame([(i, k, n) for i, (k, n) in enumerate(pairs)], "i int, k long, n long")
    assert [r.x for r in df.select("i", toxicity.tail_column(F.col("k"), F.col("n"), p).alias("x")).orderBy("i").collect()] == pytest.approx(want)
    # Step-up: of 100 tried, two chances under 2^-13 pass at level 0.02, one of 2^-6 does not.
    assert toxicity.discovery_limit({14: 1, 13: 1, 6: 1}, 100, 0.02) == 2.0**-13


def test_toxicity_of_awkward_rows(spark):
    """Repeated rows, clashing columns, null labels and ids, several labels of one document."""
    rows = toxic_rows(120)
    docs = spark.createDataFrame([*((i, t, "x", 0.5) for i, (t, _) in enumerate(rows)), *((1, rows[1][0], "x", 0.5) for _ in range(3)), (None, None, None, None)], "doc_id long, text string, label string, score double")
    known = spark.createDataFrame([*((i, y) for i, (_, y) in enumerate(rows)), (0, None), (None, 1), (2, 0)], "doc_id long, toxic int")
    got = toxicity.score_documents(docs, toxicity.train(docs, known)).collect()
    assert len(got) == len(rows) + 4 and len({(r.score, r.predicted) for r in got if r.doc_id == 1}) == 1
    assert np.mean([r.predicted == rows[r.doc_id][1] for r in got if r.doc_id is not None]) > 0.95


def test_messages_cross_chain_cuts():
    """The odds of long texts are those of one chain."""
    r = np.random.default_rng(2)
    words = [f"w{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10]}" for k in range(100)]
    field = toxicity.Field({"=" + w: x for w, x in zip(words, r.normal(size=100))}, 0.0, np.array([[0.5, -0.5], [-0.5, 0.5]]), 0.3)
    whole = toxicity.marginals(np.array([[field.emission(w) for w in words]]), field.step, field.start)[0][0]
    (score, spans), (one, _) = toxicity.score_texts([" ".join(words), words[0]], field, {})
    hot = {s["start"] for s in spans}
    starts = np.cumsum([0, *(len(w) + 1 for w in words)])[:-1]
    assert hot == {int(starts[k]) for k in np.flatnonzero(whole >= 0)}
    assert score == pytest.approx(1 / (1 + np.exp(-whole.max())), abs=1e-4)


def test_marginals_against_enumeration():
    r = np.random.default_rng(0)
    e, step, start = r.normal(size=4), r.normal(size=(2, 2)), 0.3
    laid, _ = toxicity.padded(e, np.array([4]), -60.0)
    got = toxicity.marginals(laid, step, start)[0][0, :4]
    weight = {}
    for k in range(16):
        y = [k >> j & 1 for j in range(4)]
        weight[tuple(y)] = np.exp(start * y[0] + sum(e[j] * y[j] for j in range(4)) + sum(step[y[j], y[j + 1]] for j in range(3)))
    for j in range(4):
        one = sum(w for y, w in weight.items() if y[j])
        assert got[j] == pytest.approx(np.log(one / (sum(weight.values()) - one)), abs=1e-6)


# 7


def brute_fingerprint(t):
    w = (t or "").encode().lower().split()
    sh = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    return sum(1 << j for j in range(64) if 2 * sum(xxhash.xxh64_intdigest(s, 42) >> j & 1 for s in sh) > len(sh))


def test_simhash(docs, empty):
    got = simhash.group_documents(docs).collect()
    texts = {i: t for i, t, _ in ROWS}
    assert len(got) == len(ROWS)
    for r in got:
        assert r.fingerprint == f"{brute_fingerprint(texts[r.doc_id]):016x}"
    ids = [i for i in texts if i is not None]
    root = {i: i for i in ids}
    prints = {i: brute_fingerprint(texts[i]) for i in ids}
    for _ in ids:
        for a in ids:
            for b in ids:
                if (prints[a] ^ prints[b]).bit_count() <= 3:
                    root[a] = root[b] = min(root[a], root[b])
        break
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == root
    assert simhash.group_documents(empty).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(set(root.values()))


def test_second_keys_of_hot_buckets(spark):
    """Fingerprints within the distance that share a first key share a second one as well."""
    r = random.Random(6)
    pairs = []
    for _ in range(60):
        f = r.getrandbits(64)
        g = f
        for b in r.sample(range(64), 3):
            g ^= 1 << b
        pairs.append(tuple(x - (1 << 64) if x >> 63 else x for x in (f, g)))
    keys = lambda name: F.transform(simhash.chain_keys(F.col(name)), lambda k: F.struct(k.alias("k"), simhash.second_keys(F.col(name), k).alias("s")))
    for row in spark.createDataFrame(pairs, "a long, b long").select(keys("a").alias("a"), keys("b").alias("b")).collect():
        shared = [(x, y) for x in row.a for y in row.b if x.k == y.k]
        assert shared and all(set(x.s) & set(y.s) for x, y in shared)


@pytest.mark.parametrize("block", [1024, 3])
def test_links_lose_nothing(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    r = random.Random(2)
    prints = {r.getrandbits(64) for _ in range(40)}
    for f in list(prints):
        for _ in range(3):
            for b in r.sample(range(64), r.randint(1, 4)):
                f ^= 1 << b
            prints.add(f)
    signed = [f - (1 << 64) if f >> 63 else f for f in sorted(prints)]
    found = components(simhash.links(spark.createDataFrame([(f,) for f in signed], "f long"))).collect()
    root = {f: f for f in signed}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(signed):
        for b in signed[:i]:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert {r.node: r.root for r in found} == {f: find(f) for f in signed if find(f) != f}


def test_listings_of_fingerprints_are_never_broadcast(spark, tmp_path):
    """A table of fingerprints is small enough for the driver, the listing under 24 keys is not, and Spark gives both one size."""
    spark.range(2000).select(F.xxhash64("id").alias("f")).write.parquet(f"{tmp_path}/f")
    keyed = spark.read.parquet(f"{tmp_path}/f").select("f", F.explode(simhash.chain_keys(F.col("f"))).alias("key"))
    counted = simhash._counted(keyed.withColumn("bucket", F.col("key")))
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


# 8


def test_quality_classifier(spark, empty, labels):
    r = random.Random(4)
    good = [text_of("en", r, 80) for _ in range(120)]
    bad = [" ".join(w + "###" for w in text_of("en", r, 60).split()) for _ in range(40)] + [text_of("de", r, 60).upper() + "!!" for _ in range(40)]
    rows = [*((i, t, 1) for i, t in enumerate(good)), *((1000 + i, t, 0) for i, t in enumerate(bad))]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(5000, None), (5001, ""), (None, "x y")], EMPTY)
    known = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    got = by_id(quality_classifier.score_documents(docs, known))
    assert all(got[i].predicted == y and got[i].held_out == (crc(i) % 5 == 0) for i, _, y in rows)
    assert all(0 <= r.score <= 1 for r in got.values())
    kept = quality_classifier.keep_good(docs, known)
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.predicted}
    assert quality_classifier.score_documents(empty, labels).count() == 0
    assert by_id(quality_classifier.score_documents(docs, labels.limit(0)))[0].score == 0.5


def test_quality_classifier_against_brute_force(spark):
    """Scores from plain class moments and densities; repeated rows and clashing columns are no matter."""
    r = random.Random(11)
    rows = [(i, text_of("en", r, 40 + i) + "#!" * (r.random() < 0.7 if i % 3 == 0 else r.random() < 0.2), int(i % 3 > 0)) for i in range(90)]
    docs = spark.createDataFrame([(i, t, "x", 1.0) for i, t, _ in rows] + [(5, rows[5][1], "y", 2.0)] * 3, "doc_id long, text string, features string, score double")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(7, 1), (None, 0), (8, None)], "doc_id long, quality int")
    named = [(i, t, y) for i, t, y in [*rows, *[rows[5]] * 3, rows[7]] if crc(i) % 5]
    x, y = np.array([quality_classifier.features(t) for _, t, _ in named]), np.array([y for *_, y in named])
    width, scale, parts = x.shape[1], x.var(0).clip(1e-6), []
    for k in (0, 1):
        own = x[y == k]
        shrink = max(0.1, width / (width + len(own)))
        cov = (1 - shrink) * np.cov(own.T, bias=True) + shrink * np.diag(scale) + 1e-6 * np.eye(width)
        parts.append((own.mean(0), np.linalg.inv(cov), np.log(len(own) / len(y)) - 0.5 * np.linalg.slogdet(cov)[1]))
    for row in quality_classifier.score_documents(docs, labels).collect():
        v = np.array(quality_classifier.features(rows[row.doc_id][1]))
        bad, good = (c - 0.5 * (v - m) @ inverse @ (v - m) for m, inverse, c in parts)
        assert row.score == pytest.approx(1 / (1 + np.exp((bad - good) / width)), abs=1e-6) and row.predicted == int(row.score >= 0.3)


# 9


def brute_strip(texts):
    data = [t.encode() for t in texts]
    counts = Counter(d[i : i + 200] for d in data for i in range(len(d) - 199))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - 199):
            if counts[d[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        kept = bytes(b for b, g in zip(d, gone) if not g)
        out.append((len(d), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [4000, 2, 0])
def test_suffix_dedup(docs, empty, hot):
    want = Counter(zip((i for i, _, _ in ROWS), brute_strip(TEXTS)))
    got = Counter((r.doc_id, (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in suffix_dedup.strip_documents(docs, hot).collect())
    assert got == want
    assert suffix_dedup.strip_documents(empty).count() == 0
    kept = suffix_dedup.without_repeats(docs)
    assert kept.columns == docs.columns and kept.count() == len(ROWS)


@pytest.mark.parametrize("hot", [3, 10])
def test_hot_anchors_in_parts(spark, hot):
    """One passage of 230 bytes in 25 different surroundings: its anchors are cut into bands; other texts stay."""
    r = random.Random(21)
    fresh = lambda n: "".join(r.choice("mnopqr ") for _ in range(n))
    passage = "".join(r.choice("abcdef ") for _ in range(230))
    rows = [(i, fresh(r.randint(0, 300)) + passage[: 230 - i % 4 * 12] + fresh(r.randint(0, 300))) for i in range(25)] + [(90 + i, fresh(500)) for i in range(3)]
    want = Counter(zip((i for i, _ in rows), brute_strip([t for _, t in rows])))
    got = Counter((x.doc_id, (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256)) for x in suffix_dedup.strip_documents(spark.createDataFrame(rows, EMPTY).repartition(4), hot).collect())
    assert got == want and any(n[1][1] for n in got)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.text("ab", max_size=6).map(str.encode), max_size=9), max_size=6))
def test_loser_tree(lists):
    runs = [suffix_dedup.Run(k, *suffix_dedup.front_coded(sorted(x))) for k, x in enumerate(lists)]
    got = list(suffix_dedup.merge(runs)) if runs else []
    words = [s for *_, s in got]
    assert words == sorted(w for x in lists for w in x)
    assert [n for _, _, n, _ in got[1:]] == [suffix_dedup.common_prefix(a, b, 0) for a, b in zip(words, words[1:])]


@pytest.mark.parametrize("stretch", [1 << 18, 250, 700])
def test_stretches_agree(monkeypatch, stretch):
    """Every window has one anchor, the same in texts of any length and on either side of a cut."""
    monkeypatch.setattr(suffix_dedup, "STRETCH", stretch)
    r = random.Random(8)
    data = bytes(r.choice(b"abc ") for _ in range(1500))
    anchors = {}
    for h, _, at, n, off in zip(*suffix_dedup.segments(data)):
        for p in range(at, at + n - 199):
            assert anchors.setdefault(p, (at + off, h)) == (at + off, h)
    assert set(anchors) == set(range(len(data) - 199))
    for p in range(0, 1300, 53):
        (h,), _, _, (n,), (off,) = suffix_dedup.segments(data[p : p + 200])
        assert anchors[p] == (p + off, h) and n == 200


@pytest.mark.parametrize("stretch,frequent", [(250, 1000), (1 << 18, 2), (1 << 18, 10**9)])
def test_suffix_dedup_of_long_and_repeated_rows(spark, monkeypatch, stretch, frequent):
    """Texts of many stretches, 40 equal rows, and keys that go by broadcast or by shuffle."""
    monkeypatch.setattr(suffix_dedup, "STRETCH", stretch)
    monkeypatch.setattr(suffix_dedup, "FREQUENT", frequent)
    r = random.Random(4)
    passage = "".join(r.choice("abcdef ") for _ in range(900))
    fresh = lambda n: "".join(r.choice("ghijkl ") for _ in range(n))
    texts = [fresh(700) + passage + fresh(300), passage[100:] + fresh(400), fresh(900) + passage[:500] + fresh(100) + passage[300:], "z" * 900, fresh(250), *[fresh(80)] * 2]
    rows = [*enumerate(texts), *[(50, texts[4])] * 40]
    rows = [(i, t) for i, t in rows]
    want = Counter(zip((i for i, _ in rows), brute_strip([t for _, t in rows])))
    got = Counter((x.doc_id, (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256)) for x in suffix_dedup.strip_documents(spark.createDataFrame(rows, EMPTY).repartition(4)).collect())
    assert got == want


# 10


def test_order_minhash(spark, docs, empty):
    rows = sorted(((i, t or "") for i, t, _ in ROWS), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    got = order_minhash.fingerprint_documents(docs).collect()
    want = Counter()
    for k, (i, t) in enumerate(rows):
        half, nxt = len(t) // 2, rows[(k + 1) % len(rows)][1]
        want[i, len(t), sha256((t[: len(t) - half] + nxt[:half]).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    prints = {}
    texts = {i: t or "" for i, t, _ in ROWS}
    for r in got:
        prints.setdefault(texts[r.doc_id], set()).add(r.fingerprint)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert all(len(x) == 1 for x in prints.values())
    assert next(r for r in got if r.doc_id == 102).near_next == 1.0
    assert np.mean([r.near_edited for r in got if r.n_chars > 500]) > np.mean([r.near_next for r in got if r.n_chars > 500 and r.doc_id != 102])
    assert order_minhash.fingerprint_documents(empty).count() == 0


def brute_signature(t):
    """Lane -> hash of its two least numbered 2-grams in text order, with xxHash as Spark computes it."""
    import xxhash

    mask = (1 << 64) - 1
    longs = lambda *xs, seed=42: _fold(xs, seed)

    def _fold(xs, seed):
        for x in xs:
            seed = xxhash.xxh64_intdigest((x & mask).to_bytes(8, "little"), seed)
        return seed

    def with_int(x, n):
        return xxhash.xxh64_intdigest((n & 0xFFFFFFFF).to_bytes(4, "little"), longs(x))

    words = t.encode().split() if re.search(r"[^\x20\x09-\x0D]", t) else [t.encode()]
    h = [xxhash.xxh64_intdigest(w, 42) for w in words]
    grams = [longs(*h[i : i + 2]) for i in range(max(1, len(h) - 1))]
    seen, numbered = Counter(), []
    for place, g in enumerate(grams):
        numbered.append((with_int(g, seen[g]), place))
        seen[g] += 1
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    lanes = {}
    for v, place in sorted(numbered, key=lambda x: signed(x[0])):
        lanes.setdefault(signed(v) >> 58, []).append((v, place))
    ring = [x for lane in sorted(lanes) for x in lanes[lane][:2]]
    firsts = {lane: sum(len(lanes[k][:2]) for k in lanes if k < lane) for lane in lanes}

    def pair(k):
        (v, p), (w, q) = ring[k], ring[(k + 1) % len(ring)]
        return longs(v, w) if p < q else longs(w, v) if p > q else longs(v)

    out = []
    for lane in range(-32, 32):
        at = next((firsts[k] for k in sorted(firsts) if k >= lane), 0)
        out.append((lane + 32) << 40 | pair(at) >> 24)
    return out


def test_order_minhash_against_brute_force(spark, docs):
    """Signatures, fingerprints and both likenesses, for every row of the fixture."""
    rows = sorted(((i, t or "") for i, t, _ in ROWS), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    like = lambda a, b: len(set(a) & set(b)) / len({x >> 40 for x in [*a, *b]})
    as_text = lambda s: "".join(f"{x:012X}" for x in s)
    want = Counter()
    for k, (i, t) in enumerate(rows):
        nxt, half = rows[(k + 1) % len(rows)][1], len(t) // 2
        own, edited, after = (brute_signature(x) for x in (t, t[: len(t) - half] + nxt[:half], nxt))
        want[i, as_text(own), as_text(edited), round(like(own, edited), 9), round(like(own, after), 9)] += 1
    got = Counter((r.doc_id, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in order_minhash.fingerprint_documents(docs).collect())
    assert got == want


def test_next_of_a_much_repeated_id(spark):
    """A third of all rows with one id, and null ids, are cut into ranges by their texts; the order stays."""
    r = random.Random(12)
    rows = [(None if k % 4 == 0 else 7 if k % 4 < 3 else k, "".join(r.choice("abé ") for _ in range(r.randint(0, 12)))) for k in range(400)]
    df = spark.createDataFrame(rows, EMPTY).repartition(5)
    assert order_minhash.with_range(df).groupBy("__part").count().agg(F.max("count")).first()[0] < 60
    order = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode()))
    want = Counter((i, t, order[(k + 1) % len(order)][1]) for k, (i, t) in enumerate(order))
    got = Counter((x.doc_id, x.text, x.next_text) for x in order_minhash.with_next(df).collect())
    assert got == want


def test_order_matters(spark):
    words = [f"w{i}" for i in range(300)]
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[150:] + words[:150])), (3, " ".join([*words[:280], *(f"n{i}" for i in range(20))]))], EMPTY)
    s = {r.doc_id: set(r.signature) for r in order_minhash.fingerprints(df).collect()}
    assert len(s[1] & s[3]) > len(s[1] & s[2])


@pytest.mark.parametrize("short,long", [(127, 128), (250, 260), (255, 257), (1000, 1030)])
def test_order_minhash_ignores_length_class(spark, short, long):
    """Near copies keep their lanes where their word counts lie on both sides of a power of two."""
    words = [f"w{i}" for i in range(long)]
    df = spark.createDataFrame([(1, " ".join(words[:short])), (2, " ".join(words))], EMPTY)
    s = {r.doc_id: set(r.signature) for r in order_minhash.fingerprints(df).collect()}
    assert len(s[1] & s[2]) > 0.7 * max(map(len, s.values()))


@pytest.mark.parametrize("n", [40, 60, 80, 100])
def test_order_minhash_of_short_swapped_texts(spark, n):
    """Every lane hashes an ordered pair, so swapped halves share about half of the lanes."""
    texts = [[f"t{k}w{i}" for i in range(n)] for k in range(12)]
    rows = [(2 * k + swap, " ".join(w[n // 2 :] + w[: n // 2] if swap else w)) for k, w in enumerate(texts) for swap in (0, 1)]
    s = {r.doc_id: r.signature for r in order_minhash.fingerprints(spark.createDataFrame(rows, EMPTY)).collect()}
    assert all(len(x) == order_minhash.LANES for x in s.values())
    assert np.mean([len(set(s[2 * k]) & set(s[2 * k + 1])) / max(len(s[2 * k]), 1) for k in range(12)]) < 0.6


def test_order_minhash_of_two_words(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "a b c"), (3, "b c a"), (4, "")], EMPTY)
    s = {r.doc_id: r.signature for r in order_minhash.fingerprints(df).collect()}
    assert all(len(x) == order_minhash.LANES for x in s.values())
    assert not set(s[2]) & set(s[3])


# The pipeline.


def test_keep_one_tells_equal_ids_apart(spark):
    """Different texts with one id are in different components: both stay; copies go, also those without an id."""
    one, two, three = text_of("en", random.Random(1)), text_of("de", random.Random(2)), text_of("fr", random.Random(3))
    df = spark.createDataFrame([(5, one), (5, two), (5, two), (6, one), (7, two), (None, one), (None, three), (None, three)], EMPTY).repartition(3)
    got = Counter((r.doc_id, r.text) for r in simhash.keep_one(df).collect())
    assert got == Counter([(5, one), (5, two), (None, three)])


def test_pipeline_of_nothing(spark, tmp_path, empty, labels):
    import corpus_pipeline

    empty.write.parquet(str(tmp_path / "documents.parquet"))
    labels.limit(0).write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline(spark, tmp_path, docs, labels):
    import corpus_pipeline

    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    labels.coalesce(1).write.parquet(str(tmp_path / "labels.parquet"))
    frame, columns = docs, docs.columns
    for name, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, str(tmp_path))
        if name != "packing":
            assert frame.columns == columns
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {r.doc_id for r in frame.collect()}
    rules = quality_rules.judge_documents(docs, labels).where("kept").count()
    assert 0 < frame.select("doc_id").distinct().count() <= rules


def test_repeats_in_very_long_texts_are_compared_by_words(spark):
    """Over 3 million words leave 42 bits for a window's hash: some different windows share one."""
    for n in (1_000_007, 3_000_007):
        text = "q r s " + " ".join(map(str, range(n - 6))) + " q r s"
        got = quality_rules.with_statistics(spark.createDataFrame([(text, 1)], "text string, other int")).first()
        assert (got.n_words, got.n_repeat_words, got.other) == (n, 6, 1)


def test_windows_whose_hashes_meet_are_told_apart(spark, monkeypatch):
    """With nearly no bits of the hash left the counts stay exact."""
    r = random.Random(2)
    texts = [" ".join(r.choice("abcdef") for _ in range(n)) for n in (0, 1, 2, 3, 4, 20, 200)]
    monkeypatch.setattr(quality_rules.F, "xxhash64", lambda *c: F.lit(7).cast("long"))
    got = {r.text2: r.n_repeat_words for r in quality_rules.with_statistics(spark.createDataFrame([(t, t) for t in texts], "text string, text2 string")).collect()}
    for text in texts:
        w = text.split()
        windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        assert got[text] == len({i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)})
