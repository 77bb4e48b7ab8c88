"""Language identification by hyperdimensional profiles (operator 1).

Every letter has a random vector of +1 and -1. A trigram is the product of its three
letters' vectors, the earlier ones permuted (cyclically shifted) once more for each
place, so order matters; a text is the sum of its trigrams, a language prototype the sum
of the normalised texts of its training documents, centred by the mean prototype. The
language with the highest cosine wins; the score is the softmax share of that cosine.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; a null
doc_id is in no fold and trains nothing; documents without a language train nothing and
are predicted; ties go to the first language in alphabetical order; without training
documents everything is ``und``; repeated rows train as often as they occur and are
predicted alike; a very long text is summed in blocks of its distinct trigrams, whatever
their number; an empty table gives no rows; a prediction reads only the text. The prototypes are one vector per language: their number is bounded by the
distinct values of ``lang`` and checked (MOST_LANGUAGES).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_fold
from .packing import _groups

FOLDS, HELD_OUT = 4, 2
WIDTH, LETTERS, SHARPNESS, MOST_LANGUAGES = 512, 96, 30.0, 5000
#: Trigrams whose vectors a worker keeps (at most 128 MB), and those bound at a time.
MOST_KEPT, BLOCK = 65_536, 8192
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    """Code point -> letter number: 0 no letter, a-z, the Latin-1 letters, hashed others."""
    table = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        letter = chr(c)
        if letter.isalpha():
            low = ord(letter.lower()[0])
            table[c] = low - 96 if 97 <= low <= 122 else 27 + low - 0xDF if 0xDF <= low <= 0xFF else 60 + low * 2654435761 % 4294967296 % (LETTERS - 60)
    return table


class Trigrams:
    """Vectors of trigrams: the first ``most`` seen are kept, others are bound anew when needed."""

    def __init__(self, width: int = WIDTH, seed: int = 7, most: int = MOST_KEPT):
        self.most = most
        letters = np.random.default_rng(seed).choice(np.array([-1, 1], np.int8), (LETTERS, width))
        self.first, self.second, self.third = np.roll(letters, 2, 1), np.roll(letters, 1, 1), letters
        self.place = np.full(LETTERS**3, -1, np.int32)
        self.rows = np.empty((1024, width), np.float32)
        self.known = 0

    def bound(self, codes: np.ndarray) -> np.ndarray:
        return self.first[codes // LETTERS**2] * self.second[codes // LETTERS % LETTERS] * self.third[codes % LETTERS]

    def vectors(self, codes: np.ndarray) -> np.ndarray:
        at = self.place[codes]
        kept = codes[at < 0][: self.most - self.known]
        if len(kept):
            while self.known + len(kept) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.empty_like(self.rows)])
            self.place[kept] = np.arange(self.known, self.known + len(kept))
            self.rows[self.known : self.known + len(kept)] = self.bound(kept)
            self.known += len(kept)
            at = self.place[codes]
        out = self.rows[at]
        if (missing := at < 0).any():
            out[missing] = self.bound(codes[missing])
        return out

    def profile(self, text: str) -> np.ndarray | None:
        """The normalised vector of a text; None without a letter."""
        a = letter_table()[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
        if not a.any():
            return None
        a = np.concatenate([[0], a, [0]]).astype(np.int64)
        codes = (a[:-2] * LETTERS + a[1:-1]) * LETTERS + a[2:]
        codes, counts = np.unique(codes[a[1:-1] > 0], return_counts=True)
        counts = counts.astype(np.float32)
        vector = counts[:BLOCK] @ self.vectors(codes[:BLOCK])
        for k in range(BLOCK, len(codes), BLOCK):
            vector = vector + counts[k : k + BLOCK] @ self.vectors(codes[k : k + BLOCK])
        size = float(np.sqrt(vector @ vector))
        return vector / size if size else vector


@lru_cache(maxsize=1)
def trigrams() -> Trigrams:
    return Trigrams()


def prototypes(docs: DataFrame) -> dict[str, np.ndarray]:
    """One centred, normalised vector per language, from all rows (text, lang)."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker, by_lang = trigrams(), {}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                profile = maker.profile(text)
                if profile is not None:
                    by_lang[lang] = by_lang.get(lang, 0) + profile.astype(np.float64)
        for lang, total in by_lang.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * WIDTH), pa.array(np.arange(WIDTH)), pa.array(total)], ["lang", "k", "v"])

    parts = docs.select("text", "lang").where("text is not null and lang is not null").mapInArrow(sums, "lang string, k long, v double")
    rows = parts.groupBy("lang", "k").agg(F.sum("v").alias("v")).groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("k", "v"))).alias("c")).limit(MOST_LANGUAGES + 1).collect()
    if len(rows) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    found = {r.lang: np.array([x.v for x in r.c]) for r in sorted(rows, key=lambda r: r.lang)}
    found = {k: v / (np.linalg.norm(v) or 1) for k, v in found.items()}
    if len(found) > 1:
        mean = np.mean(list(found.values()), axis=0)
        found = {k: v - mean for k, v in found.items()}
        found = {k: v / (np.linalg.norm(v) or 1) for k, v in found.items()}
    return found


def identify(docs: DataFrame, protos: dict[str, np.ndarray]) -> DataFrame:
    names = list(protos)
    shared = docs.sparkSession.sparkContext.broadcast(np.array(list(protos.values()), np.float32))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker, known = trigrams(), shared.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for begin, stop in _groups([t or "" for t in texts]):
                langs, scores = [], []
                for text in texts[begin:stop]:
                    profile = maker.profile(text) if text and names else None
                    if profile is None:
                        langs.append("und"), scores.append(0.0)
                        continue
                    cosines = known @ profile
                    best = int(cosines.argmax())
                    langs.append(names[best])
                    scores.append(float(1 / np.exp(SHARPNESS * (cosines - cosines[best])).sum()))
                yield pa.RecordBatch.from_arrays([batch.column(0)[begin:stop], batch.column(2)[begin:stop], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text", in_fold("doc_id", FOLDS, HELD_OUT).alias("held_out")).mapInArrow(predict, SCHEMA)


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("doc_id").isNotNull() & ~in_fold("doc_id", FOLDS, HELD_OUT))


def identify_documents(docs: DataFrame) -> DataFrame:
    return identify(docs, prototypes(training_rows(docs)))
