"""Integer vectors from columns of lists, and back from bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Beyond this, products and squared distances of up to 1024 components might not fit a long.
LARGEST = 1 << 26


def quantised(column: pa.Array, scale: int, width: int, exact_width: bool) -> tuple[np.ndarray, np.ndarray]:
    """Which rows take part, and floor(scale * x) of those, x as double, one row each.

    A row takes part if it is no null and holds no null, NaN or infinity, and with
    ``exact_width`` if it has ``width`` components; otherwise missing ones are zero.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    usable = column.is_valid().to_numpy(zero_copy_only=False).astype(bool)
    usable &= np.bincount(row[~np.isfinite(values)], minlength=len(sizes)) == 0
    usable &= sizes == width if exact_width else sizes <= width
    taken = usable[row]
    with np.errstate(over="ignore"):
        floors = np.floor(scale * values[taken])
    if len(floors) and np.abs(floors).max() > LARGEST:
        raise ValueError(f"a component times {scale} is beyond {LARGEST}")
    out = np.zeros((len(sizes), width), np.int64)
    out[row[taken], place[taken]] = floors
    return usable, out[usable]


def to_binary(vectors: np.ndarray) -> pa.Array:
    """One binary value a vector: 16-bit components where all of them fit, else 32-bit ones."""
    small = not len(vectors) or max(vectors.max(initial=0), -vectors.min(initial=0)) < 1 << 15
    data = np.ascontiguousarray(vectors, "<i2" if small else "<i4")
    offsets = np.arange(len(vectors) + 1, dtype=np.int32) * (data.shape[1] * data.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(vectors), [None, pa.py_buffer(offsets), pa.py_buffer(data.tobytes())])


def from_binary(column: pa.Array, width: int) -> np.ndarray:
    """The vectors as int32 (a row each)."""
    values = column.to_pylist()
    if len({len(v) for v in values}) <= 1:
        data = np.frombuffer(b"".join(values), "<i2" if values and len(values[0]) == 2 * width else "<i4")
        return data.astype(np.int32).reshape(len(values), width)
    return np.array([np.frombuffer(v, "<i2" if len(v) == 2 * width else "<i4") for v in values], np.int32).reshape(len(values), width)
