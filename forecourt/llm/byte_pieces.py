"""Exact, memoised splitting of texts into independently encodable chunks.

The pre-tokenisation pattern never lets a piece reach over a single blank (or a
single newline) that stands between two characters that are not white space: the
blank opens the next piece, the newline is a piece of its own. A text may therefore
be cut at those places and every chunk encoded by itself. Chunks recur, so their
encodings are memoised; runs of white space stay inside one chunk.
"""

from __future__ import annotations

import re
from collections.abc import Callable

_SAFE = re.compile(r"(?<=\S)(?=[ \n]\S)")
#: Before a chunk's key where the chunk stands in full.
RAW = "\t"


def chunk_keys(text: str) -> list[str]:
    """Keys of chunks whose concatenated encodings encode the text.

    A key is a word that one blank precedes (the blank is left out), or a newline and
    the word after it, or RAW and a whole chunk.
    """
    if not text:
        return []
    if text.replace("\n", " ").split(" ") != text.split():
        return [RAW + x for x in _SAFE.split(text)]
    keys = text.replace("\n", " \n").split(" ")
    keys[0] = RAW + keys[0]
    return keys


def chunk(key: str) -> str:
    return key[1:] if key[0] == RAW else key if key[0] == "\n" else " " + key


class Memo:
    """key -> its chunk's encoding, learned batch by batch; ``most`` are kept.

    Frequent chunks come early, so a full memo keeps those; the rest are encoded anew
    in each batch, so memory stays bounded and results never depend on the memo.
    """

    def __init__(self, encode_all: Callable[[list[str]], list], most: int = 300_000, longest: int = 64):
        self.encode_all, self.most, self.longest = encode_all, most, longest
        self.known: dict[str, object] = {}

    def encode(self, texts: list[str]) -> list[list]:
        """For each text the encodings of its chunks."""
        return self.encode_keys([chunk_keys(text) for text in texts])

    def encode_keys(self, cut: list[list[str]]) -> list[list]:
        """For each list of keys the encodings of their chunks."""
        known = self.known
        missing = list(set().union(*cut).difference(known))
        known.update(zip(missing, self.encode_all(missing), strict=True) if missing else ())
        out = [list(map(known.__getitem__, keys)) for keys in cut]
        room = max(0, self.most - (len(known) - len(missing)))
        for key in missing:
            if room and len(key) <= self.longest:
                room -= 1
            else:
                del known[key]
        return out
