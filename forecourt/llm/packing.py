"""Best-fit packing of token sequences (operator 3).

``pack_documents`` tokenises every document, cuts the ones that are longer than a
sequence into full pieces (the first takes the remainder) and packs the pieces by
bounded-space online best-fit: a fixed number of bins is open; a bitset keyed by free
space finds the tightest bin that holds a piece with two integer operations, and if
none does while all bins are open, the fullest closes. Every partition packs for
itself in one pass and in constant memory, so nothing is shuffled; the pieces of one
group of texts (GROUP_CHARS) are placed longest first.

Ids are those of the tokenizers library called with add_special_tokens=False: an added
token of the vocabulary (such as the end-of-text mark) that stands in a text is one id.

Defined cases: a null or empty text is the end token alone; a null doc_id is kept;
repeated rows are packed as often as they occur; a very long text becomes pieces of a
whole sequence each; an empty table gives no rows; columns other than the id and the text
are not read.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_pieces import RAW, Memo, chunk

SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
CAPACITY, END_ID, OPEN_BINS = 1024, 2, 2048
#: Texts are tokenised in groups of so many characters, to bound memory.
GROUP_CHARS = 4_000_000


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabulary files."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


@lru_cache(maxsize=2)
def memo(vocabulary: str, most: int = 300_000) -> Memo:
    """Chunk encoder for a byte-level BPE vocabulary in a tokenizers JSON file.

    The merges of such a file stand in the order of their ids, so its tokens with their
    ids are ranks; the ids equal those of the tokenizers library (tested).
    """
    import tiktoken

    with open(vocabulary, encoding="utf-8") as file:
        model = json.load(file)
    special = {x["content"] for x in model.get("added_tokens", [])}
    stands = byte_alphabet()
    ranks = {bytes(stands[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}
    coder = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    newline = coder.encode_ordinary("\n")[0]
    line = np.array([newline], "<u4").tobytes()

    def encode_all(keys: list[str]) -> list[bytes]:
        # Single words are encoded in one call, a newline between them.
        bare = [k[1:] if k[0] == "\n" else " " + k if k[0] != RAW else "" for k in keys]
        plain = [b[1:].split() == [b[1:]] if b[:1] == " " else b.split() == [b] for b in bare]
        ids = np.array(coder.encode_ordinary("\n".join([b for b, p in zip(bare, plain) if p])), "<u4")
        ends = [*np.flatnonzero(ids == newline).tolist(), len(ids)]
        flat, out, at, k = ids.tobytes(), [], 0, 0
        for key, single in zip(keys, plain):
            if single:
                got = flat[4 * at : 4 * ends[k]]
                at, k = ends[k] + 1, k + 1
                out.append(line + got if key[0] == "\n" else got)
            else:
                out.append(np.array(coder.encode_ordinary(chunk(key)), "<u4").tobytes())
        return out

    return Memo(encode_all, most)


@lru_cache(maxsize=2)
def added_tokens(vocabulary: str) -> dict[str, bytes]:
    """The texts of a vocabulary's added tokens that are matched inside other text, with their ids."""
    with open(vocabulary, encoding="utf-8") as file:
        found = json.load(file).get("added_tokens", [])
    if any(x.get("lstrip") or x.get("rstrip") or x.get("single_word") or x.get("normalized") for x in found):
        raise ValueError("added tokens that strip, need word bounds or are normalised are not supported")
    return {x["content"]: np.array([x["id"]], "<u4").tobytes() for x in found}


def encoded(texts: list[str], vocabulary: str) -> list[list[bytes]]:
    """The ids of each text, as pieces of little-endian bytes; texts are cut at added tokens first."""
    added = added_tokens(vocabulary)
    if not any(a in t for t in texts for a in added):
        return memo(vocabulary).encode(texts)
    cut = [re.split("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")", t) for t in texts]
    plain = iter(memo(vocabulary).encode([x for parts in cut for x in parts[::2]]))
    return [[y for k, x in enumerate(parts) for y in ([added[x]] if k % 2 else next(plain))] for parts in cut]


class BestFit:
    """Open bins by free space; ``place`` returns (sequence, offset)."""

    def __init__(self, capacity: int = CAPACITY, most_open: int = OPEN_BINS, first: int = 0):
        self.capacity, self.most_open, self.next = capacity, most_open, first
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bits = self.open = 0

    def place(self, length: int) -> tuple[int, int]:
        fitting = self.bits >> length << length
        if fitting:
            free = (fitting & -fitting).bit_length() - 1
            sequence = self._take(free)
        else:
            if self.open >= self.most_open:
                self._take((self.bits & -self.bits).bit_length() - 1)
            sequence, free = self.next, self.capacity
            self.next += 1
        left = free - length
        if left:
            self.by_free[left].append(sequence)
            self.bits |= 1 << left
            self.open += 1
        return sequence, self.capacity - free

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        sequence = bins.pop()
        self.open -= 1
        if not bins:
            self.bits &= ~(1 << free)
        return sequence


def _groups(texts: list[str], most: int = GROUP_CHARS) -> Iterator[tuple[int, int]]:
    begin = chars = 0
    for k, text in enumerate(texts):
        chars += len(text)
        if chars >= most:
            yield begin, k + 1
            begin, chars = k + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def pack_documents(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, open_bins: int = OPEN_BINS, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids)."""
    vocabulary = vocabulary or public_tokenizers.path("byte_bpe_50k.json")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        end = np.array([end_id], "<u4").tobytes()
        bins = BestFit(capacity, open_bins, TaskContext.get().partitionId() << 40)
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for begin, stop in _groups(texts):
                found: list[list] = []
                for doc_id, parts in zip(doc_ids[begin:stop], encoded(texts[begin:stop], vocabulary)):
                    ids = b"".join(parts) + end
                    total = len(ids) // 4
                    start = piece = 0
                    length = (total - 1) % capacity + 1
                    while start < total:
                        mine = ids[4 * start : 4 * (start + length)]
                        found.append([doc_id, piece, start, length, zlib.crc32(mine), 0, 0, *([np.frombuffer(mine, "<u4").astype("i8").tolist()] if with_ids else [])])
                        start, piece, length = start + length, piece + 1, capacity
                for row in sorted(found, key=lambda r: -r[3]):
                    row[5:7] = bins.place(row[3])
                if found:
                    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if with_ids else [])]
                    kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 5, *([pa.list_(pa.int64())] if with_ids else [])]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(pack, SCHEMA + (", ids array<long>" if with_ids else ""))
