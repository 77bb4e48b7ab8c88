"""Byte-level BPE encoding and decoding in linear time (operator 5).

Bytes are mapped to Latin-1 so that an Aho-Corasick automaton over the vocabulary
yields, for each position of a pre-token, every token that starts there. Encoding
walks from the longest match and backtracks over shorter ones; two tokens may stand
side by side only if merging their joint bytes gives back exactly these two tokens,
and a token sequence is the one that the merges produce if and only if all its
neighbours are compatible. Compatibility is memoised, and a position from which no
continuation was found is never tried again, so the walk is linear.

Defined cases: a null or empty text has no tokens (the digests of nothing); lone
surrogates cannot occur in Spark strings; a null doc_id is kept; repeated rows give
repeated results; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import ahocorasick
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_pieces import Memo, chunk
from .packing import _groups

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
MOST_PAIRS = 1_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, file))}


class ByteBpe:
    """Encoder and decoder for a table of ranks and a pre-tokenisation pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = public_tokenizers.PATTERN):
        self.ranks, self.tokens = ranks, {i: t for t, i in ranks.items()}
        self.find = regex.compile(pattern).findall
        self.pairs: dict[tuple[int, int], bool] = {}
        self.automaton = ahocorasick.Automaton()
        for token, i in ranks.items():
            # A token that its own merges never build stands only for a whole pre-token.
            if self.merge(token) == [i]:
                self.automaton.add_word(token.decode("latin-1"), (len(token), i))
        self.automaton.make_automaton()

    def merge(self, data: bytes) -> list[int]:
        """Lowest rank first, leftmost among equals: the definition, for short inputs."""
        parts, ranks = [data[k : k + 1] for k in range(len(data))], self.ranks
        while len(parts) > 1:
            best, at = min((ranks.get(a + b, 1 << 60), k) for k, (a, b) in enumerate(zip(parts, parts[1:])))
            if best == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def compatible(self, left: int, right: int) -> bool:
        known = self.pairs.get((left, right))
        if known is None:
            known = self.merge(self.tokens[left] + self.tokens[right]) == [left, right]
            if len(self.pairs) >= MOST_PAIRS:
                self.pairs.clear()
            self.pairs[left, right] = known
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        end = len(piece)
        starts: list[list[tuple[int, int]]] = [[] for _ in range(end)]
        for last, (length, token) in self.automaton.iter(piece.decode("latin-1")):
            starts[last + 1 - length].append((last + 1, token))  # shorter ones first
        ids: list[int] = []
        places, untried, dead = [0], [starts[0]], bytearray(end + 1)
        left = [len(starts[0])]
        while places[-1] < end:
            at = left[-1] - 1
            while at >= 0:
                stop, token = untried[-1][at]
                if not dead[stop] and (not ids or self.compatible(ids[-1], token)):
                    break
                at -= 1
            if at < 0:
                dead[places.pop()] = 1
                untried.pop(), left.pop(), ids.pop()
                continue
            left[-1] = at
            ids.append(token)
            places.append(stop)
            untried.append(starts[stop] if stop < end else [])
            left.append(len(untried[-1]))
        return ids

    def encode(self, text: str) -> list[int]:
        return [i for piece in self.find(text) for i in self.encode_piece(piece.encode())]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def coder(path: str) -> ByteBpe:
    return ByteBpe(read_ranks(path))


@lru_cache(maxsize=2)
def memo(path: str) -> Memo:
    """Chunk -> (number of ids, the ids as text, the bytes that the ids decode to)."""
    bpe, pieces = coder(path), {}

    def encode_all(keys: list[str]) -> list[tuple[int, str, bytes]]:
        out = []
        for key in keys:
            ids: list[int] = []
            for piece in bpe.find(chunk(key)):
                got = pieces.get(piece)
                if got is None:
                    got = bpe.encode_piece(piece.encode())
                    if len(pieces) < 300_000 and len(piece) <= 64:
                        pieces[piece] = got
                ids += got
            out.append((len(ids), ",".join(map(str, ids)), bpe.decode(ids)))
        return out

    return Memo(encode_all, most=200_000)


def encode_documents(docs: DataFrame, ranks: str | None = None, with_ids: bool = False) -> DataFrame:
    """Per document: n_tokens, digests of the ids and of the decoded bytes (and the ids)."""
    ranks = ranks or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts_of = memo(ranks)
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for begin, stop in _groups(texts):
                counts, digests, decoded, ids = [], [], [], []
                for parts in texts_of.encode(texts[begin:stop]):
                    counts.append(sum(p[0] for p in parts))
                    joined = ",".join([p[1] for p in parts if p[0]])
                    digests.append(sha256(joined.encode()).hexdigest())
                    decoded.append(sha256(b"".join([p[2] for p in parts])).hexdigest())
                    if with_ids:
                        ids.append([int(x) for x in joined.split(",")] if joined else [])
                columns = [pa.array(doc_ids[begin:stop], pa.int64()), pa.array(counts, pa.int64()), pa.array(digests), pa.array(decoded)]
                yield pa.RecordBatch.from_arrays([*columns, *([pa.array(ids, pa.list_(pa.int64()))] if with_ids else [])], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if with_ids else [])])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(encode, SCHEMA + (", ids array<long>" if with_ids else ""))
