"""BPE encoding and decoding with content-defined chunk reuse (operator 11).

A rolling hash over the last WINDOW characters cuts the normalised text wherever its low
bits are zero, so equal passages are cut alike in all documents. A chunk is encoded by
itself, once for all documents in which a worker meets it. Where two chunks join, the
encodings near the cut are wrong: a word may be cut in two, a contraction may begin. The
join is repaired by encoding a window anew, from a word of the left chunk that its cut
cannot have touched, through ever more words (then chunks, twice as many each time) of the
right one, until the window and the right chunk agree on where a word begins. The
pre-tokenisation pattern reads from left to right and remembers nothing, so from an agreed
beginning on both are the same, and the joined ids are those of the whole text.

Normalisation depends on neighbours (composition), so it runs over whole texts before any
cut; added tokens are looked for in the raw text before that, as the tokenizers library
does. Characters outside plain Latin go through the library's own normaliser and
pre-tokeniser; the ids of every distinct word come from its model.

Defined cases: a null or empty text has no ids (the digests of nothing); a text of white
space alone likewise; one word longer than all chunks is one window; a null doc_id is kept;
repeated rows give repeated results; an empty table gives no rows; other columns are not
read, so they may have any name. Very long texts are hashed in blocks.
"""

from __future__ import annotations

import json
import re
import sys
from array import array
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import accumulate, compress, islice

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .packing import _groups

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Characters that the rolling hash sees, bits that are zero at a cut (one in 256), shortest and longest chunk.
WINDOW, CUT_BITS, SHORTEST, LONGEST = 16, 8, 32, 1024
BLOCK = 1 << 20
#: Chunks and words that a worker keeps.
MOST_CHUNKS, MOST_WORDS, LONGEST_WORD = 100_000, 300_000, 48
#: No word that begins further than this from a chunk's end depends on what follows the chunk.
LOOKAHEAD = 4
#: First words of a chunk whose places are kept.
HEAD = 8
#: Letters, digits and signs up to U+012F mean the same to Python and to the library.
_PLAIN, _PLAIN_RAW = re.compile(r"[ -~\xa1-\u012f]*"), re.compile(r"[\t\n\r -~\xa0-\u012f]*")


def cut_places(text: str) -> list[int]:
    """Ends of the chunks of a text, the last one its length."""
    places: list[int] = []
    last = 0
    for begin in range(0, len(text), BLOCK):
        before = min(begin, WINDOW - 1)
        codes = np.frombuffer(text[begin - before : begin + BLOCK].encode("utf-32-le", "surrogatepass"), np.uint32)
        rolled = codes * np.uint32(0x9E3779B1)
        rolled ^= rolled >> np.uint32(15)
        span = 1
        while span < WINDOW:  # sums of the last 2, 4, 8, 16 terms, each shifted by its distance
            rolled = rolled + np.concatenate([np.zeros(min(span, len(rolled)), np.uint32), rolled[:-span] << np.uint32(span)])
            span *= 2
        # The top bits depend on all characters of the window.
        for end in (np.flatnonzero((rolled * np.uint32(0x85EBCA6B)) >> np.uint32(32 - CUT_BITS) == 0) + (begin - before + 1)).tolist():
            if end <= begin or end - last < SHORTEST:
                continue
            while end - last > LONGEST:
                places.append(last := last + LONGEST)
            if end - last >= SHORTEST:
                places.append(last := end)
    while len(text) - last > LONGEST:
        places.append(last := last + LONGEST)
    if len(text) > last:
        places.append(len(text))
    return places


def packed(ids: list[int]) -> bytes:
    """Little-endian, four bytes each."""
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class Kept(dict):
    """What was computed lately: when it is full, the half that came first goes."""

    def __init__(self, most: int):
        super().__init__()
        self.most = most

    def keep(self, found: dict) -> None:
        self.update(found)
        if len(self) > self.most:
            for old in list(islice(self, len(self) - self.most // 2)):
                del self[old]


class Encoded:
    """A chunk's packed ids and where those of each word begin; where the first words begin."""

    __slots__ = ("chunk", "cut", "ids", "at", "starts", "safe", "safe_at")

    def __init__(self, chunk: str, words: list[str], ids: list[bytes], cut: Callable[[str], list[str]]):
        self.chunk, self.cut = chunk, cut
        self.ids, self.at = b"".join(ids), array("I", accumulate(map(len, ids), initial=0))
        self.starts = self.places(words[:HEAD])
        #: The last word that begins clear of the chunk's end, and where. Only white space lies between words.
        self.safe, self.safe_at = len(words), len(chunk)
        while self.safe and self.safe_at > len(chunk) - LOOKAHEAD:
            self.safe -= 1
            self.safe_at = chunk.rindex(words[self.safe], 0, self.safe_at)
        if self.safe_at > len(chunk) - LOOKAHEAD:
            self.safe = -1

    def __len__(self) -> int:
        return len(self.at) - 1

    def places(self, words: list[str]) -> array:
        out, end = array("I"), 0
        for word in words:
            out.append(self.chunk.index(word, end))
            end = out[-1] + len(word)
        return out

    def start(self, word: int) -> int:
        """Where a word begins; joins ask for the first words, seldom for others."""
        return self.starts[word] if word < len(self.starts) else self.places(self.cut(self.chunk))[word]

    def word_at(self, place: int) -> int | None:
        """The word that begins at a place."""
        starts = self.starts
        if len(starts) < len(self) and place > starts[-1]:
            starts = self.places(self.cut(self.chunk))
        n = bisect_left(starts, place)
        return n if n < len(starts) and starts[n] == place else None

    def between(self, first: int, stop: int) -> bytes:
        return self.ids[self.at[first] : self.at[stop]]


class ChunkedBpe:
    """Encoder and decoder by a tokenizers file: normaliser, splitting pattern, byte-level BPE with word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            said = json.load(file)
        whole = Tokenizer.from_str(json.dumps(said))
        self.normalizer = whole.normalizer
        split, byte_level = said["pre_tokenizer"]["pretokenizers"]
        pattern = split["pattern"]["Regex"]
        # The same for plain characters, their letters and digits written out.
        for name in ("L", "N"):
            kind = regex.compile(rf"\p{{{name}}}")
            pattern = pattern.replace(rf"\p{{{name}}}", "".join(re.escape(c) for c in map(chr, range(0x130)) if kind.match(c)))
        self.split_plain = re.compile(pattern).findall
        bare = dict(said, normalizer=None, added_tokens=[], truncation=None, padding=None)
        self.splitter = Tokenizer.from_str(json.dumps(dict(bare, pre_tokenizer=split))).pre_tokenizer
        self.words = Tokenizer.from_str(json.dumps(dict(bare, pre_tokenizer=byte_level)))
        self.tokens = [""] * (max([*said["model"]["vocab"].values(), *(x["id"] for x in said["added_tokens"])]) + 1)
        for token, i in said["model"]["vocab"].items():
            self.tokens[i] = token
        self.added = {x["content"]: x["id"] for x in said["added_tokens"]}
        self.tokens = [{i: t for t, i in self.added.items()}.get(k, t) for k, t in enumerate(self.tokens)]
        self.cut_added = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.known, self.chunks = Kept(MOST_WORDS), Kept(MOST_CHUNKS)

    def normal(self, text: str) -> str:
        """The library's normalisation; white space at the ends, which is in no word, may be left out."""
        if _PLAIN_RAW.fullmatch(text):
            return " ".join(text.split()).lower()
        return self.normalizer.normalize_str(text)

    def cut(self, text: str) -> list[str]:
        """The words of a normalised text."""
        if _PLAIN.fullmatch(text):
            return self.split_plain(text)
        return [text[a:b] for _, (a, b) in self.splitter.pre_tokenize_str(text)]

    def packed(self, words: list[str]) -> list[bytes]:
        """The ids of each word, packed; a word's ids depend on nothing but the word."""
        known = self.known
        out = list(map(known.get, words))
        if None in out:
            missing = list(dict.fromkeys(compress(words, [ids is None for ids in out])))
            found = {word: packed(encoding.ids) for word, encoding in zip(missing, self.words.encode_batch_fast(missing, add_special_tokens=False))}
            out = [found[word] if ids is None else ids for word, ids in zip(words, out)]
            known.keep({word: ids for word, ids in found.items() if len(word) <= LONGEST_WORD})
        return out

    def learn(self, chunks: set[str]) -> dict[str, Encoded]:
        """Encodings of chunks: those kept and those made now, all words of the latter at once."""
        out = {chunk: self.chunks.get(chunk) for chunk in chunks}
        fresh = [(chunk, self.cut(chunk)) for chunk, found in out.items() if found is None]
        ids = self.packed([word for _, words in fresh for word in words])
        at, made = 0, {}
        for chunk, words in fresh:
            made[chunk] = Encoded(chunk, words, ids[at : at + len(words)], self.cut)
            at += len(words)
        self.chunks.keep(made)
        return out | made

    def join(self, text: str, ends: list[int], encoded: list[Encoded]) -> list[bytes | str]:
        """The ids of a whole normalised text from those of its chunks; words of repaired joins stand as they are."""
        out: list[bytes | str] = []
        begins = [0, *ends[:-1]]
        # Word ``word`` of chunk ``k`` truly begins where the chunk's own encoding says; all before it is written.
        k = word = 0
        while k < len(ends) - 1:
            chunk = encoded[k]
            if chunk.safe > word:
                out.append(chunk.between(word, chunk.safe))
                place = chunk.safe_at
            else:
                place = chunk.start(word) if word < len(chunk) else len(chunk.chunk)
            k, word, fixed = self.repair(text, begins[k] + place, k, begins, ends, encoded)
            out += fixed
            if word is None:
                return out
        return [*out, encoded[k].between(word, len(encoded[k]))]

    def repair(self, text: str, begin: int, k: int, begins: list[int], ends: list[int], encoded: list[Encoded]) -> tuple[int, int | None, list[str]]:
        """Split anew from ``begin`` on until agreement: (chunk, its word, the words before that); no word: the text's end."""
        first = k + 1
        words, reach = 3, 1  # words of the next chunk, then whole chunks
        while True:
            last = min(first + reach - 1, len(ends) - 1)
            whole = last > first or words >= len(encoded[first])
            end = ends[last] if whole else begins[first] + encoded[first].start(words)
            found = self.cut(text[begin:end])
            place, at = begin, first
            for n, word in enumerate(found):
                place = text.index(word, place, end)
                # A word that begins clear of the window's end is no other in the whole text.
                if end < len(text) and place > end - LOOKAHEAD:
                    break
                if place >= ends[k]:
                    while place >= ends[at]:
                        at += 1
                    own = encoded[at].word_at(place - begins[at])
                    if own is not None:
                        return at, own, found[:n]
                place += len(word)
            if end == len(text):
                return last, None, found
            if whole:
                reach *= 2
            words *= 4

    def encode(self, texts: list[str]) -> list[bytes]:
        """The packed ids (little-endian, four bytes each) of each text."""
        plans: list[list] = []
        wanted: set[str] = set()
        for text in texts:
            plan: list = []
            for part in self.cut_added.split(text) if self.cut_added else [text]:
                if part in self.added:
                    plan.append(self.added[part])
                elif part and (normal := self.normal(part)):
                    ends = cut_places(normal)
                    chunks = [normal[a:b] for a, b in zip([0, *ends], ends)]
                    wanted.update(chunks)
                    plan.append((normal, ends, chunks))
            plans.append(plan)
        found = self.learn(wanted)
        joined = [[part for x in plan for part in ([packed([x])] if isinstance(x, int) else self.join(x[0], x[1], [found[c] for c in x[2]]))] for plan in plans]
        anew = iter(self.packed([part for parts in joined for part in parts if type(part) is str]))
        return [b"".join([next(anew) if type(part) is str else part for part in parts]) for parts in joined]

    def decode(self, packed: bytes) -> str:
        """The file has no decoder: tokens stand side by side, a blank between them, word ends and added tokens included."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(packed, "<u4").tolist()))


@lru_cache(maxsize=2)
def coder(path: str) -> ChunkedBpe:
    return ChunkedBpe(path)


def encode_documents(docs: DataFrame, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """Per document: n_tokens, digests of the packed ids and of the decoded text (and the ids and that text)."""
    tokenizer = tokenizer or public_tokenizers.path("word_bpe_49k.json")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(tokenizer)
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for begin, stop in _groups(texts):
                ids = bpe.encode(texts[begin:stop])
                decoded = [bpe.decode(x) for x in ids]
                columns = {
                    "doc_id": pa.array(doc_ids[begin:stop], pa.int64()),
                    "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
                    "ids_sha256": pa.array([sha256(x).hexdigest() for x in ids], pa.string()),
                    "decoded_sha256": pa.array([sha256(x.encode()).hexdigest() for x in decoded], pa.string()),
                }
                if with_ids:
                    columns |= {"ids": pa.array([np.frombuffer(x, "<u4").tolist() for x in ids], pa.list_(pa.int64())), "decoded": pa.array(decoded, pa.string())}
                yield pa.RecordBatch.from_pydict(columns)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(encode, SCHEMA + (", ids array<long>, decoded string" if with_ids else ""))
