"""Words of a batch of texts as flat numpy arrays, for use inside Arrow tasks.

Nothing here knows Spark. A batch of texts is one UTF-8 buffer with offsets; a word is a pair of
byte positions and a 64-bit hash. Equal words have equal hashes; unlike words differ but for one
chance in about 2**64.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 4 << 20
SEGMENT_BYTES = 1 << 18

_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX_1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX_2 = np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = x + _STEP
    x = (x ^ (x >> np.uint64(30))) * _MIX_1
    x = (x ^ (x >> np.uint64(27))) * _MIX_2
    return x ^ (x >> np.uint64(31))


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of 256 flags with the given inclusive byte ranges set."""
    table = np.zeros(256, dtype=bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: Separators of plain words: blank and the ASCII controls 9 to 13.
BLANKS = byte_set((0x20, 0x20), (0x09, 0x0D))
NEWLINE = byte_set((0x0A, 0x0A))

# One random value per byte, a random odd base and its inverse modulo 2**64.
_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_FOLDED_VALUES = _BYTE_VALUES.copy()
_FOLDED_VALUES[65:91] = _BYTE_VALUES[97:123]
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, np.uint64(base))
    steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


_POWERS = _powers(_BASE, SEGMENT_BYTES + 1)
_INVERSE_POWERS = _powers(_INVERSE, SEGMENT_BYTES + 1)


def hash_spans(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = False) -> np.ndarray:
    """64-bit hashes of buffer[start:end]; ``fold`` hashes A-Z as a-z. Spans are in order and disjoint."""
    values = _FOLDED_VALUES if fold else _BYTE_VALUES
    out = np.empty(len(starts), dtype=np.uint64)
    first = 0
    while first < len(starts):
        base = starts[first]
        last = max(int(np.searchsorted(ends, base + SEGMENT_BYTES, "right")), first + 1)
        part = buffer[base : ends[last - 1]]
        up, down = _POWERS, _INVERSE_POWERS
        if len(part) > SEGMENT_BYTES:  # one span longer than a segment
            up = _powers(_BASE, len(part))
        sums = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(values[part] * up[: len(part)], out=sums[1:])
        a, b = starts[first:last] - base, ends[first:last] - base
        out[first:last] = (sums[b] - sums[a]) * down[a]
        first = last
    return mix(out + (ends - starts).astype(np.uint64))


def hash_word(word: str, fold: bool = False) -> int:
    data = np.frombuffer(word.encode(), dtype=np.uint8)
    return int(hash_spans(data, np.array([0]), np.array([len(data)]), fold)[0])


@dataclass
class Texts:
    """Some consecutive rows: their bytes, and where each row begins and the last one ends."""

    first_row: int
    buffer: np.ndarray
    offsets: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1

    def spans(self, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends, and by row the index of its first span (one more at the end)."""
        if not len(self.buffer):
            empty = np.zeros(0, dtype=np.int64)
            return empty, empty, np.zeros(self.rows + 1, dtype=np.int64)
        inside = ~separators[self.buffer]
        edge = np.zeros(len(inside) + 1, dtype=bool)
        edge[self.offsets] = True
        before = np.empty_like(inside)
        before[0] = False
        before[1:] = inside[:-1]
        starts = np.flatnonzero(inside & (~before | edge[:-1]))
        after = np.empty_like(inside)
        after[-1] = False
        after[:-1] = inside[1:]
        ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        return starts, ends, np.searchsorted(starts, self.offsets)


def texts_of(column: pa.Array, chunk_bytes: int = CHUNK_BYTES) -> Iterator[Texts]:
    """The rows of a string column in chunks of bounded size; a longer row is a chunk of its own.

    A null is an empty text.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = int(np.searchsorted(offsets, offsets[row] + chunk_bytes, "right")) - 1
        end = min(max(end, row + 1), len(column))
        yield Texts(row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row])
        row = end


def row_of(span_offsets: np.ndarray) -> np.ndarray:
    """The row of each span."""
    return np.repeat(np.arange(len(span_offsets) - 1), np.diff(span_offsets))


def sums_by_row(values: np.ndarray, span_offsets: np.ndarray) -> np.ndarray:
    totals = np.concatenate(([0], np.cumsum(values)))
    return totals[span_offsets[1:]] - totals[span_offsets[:-1]]


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that sorts ``values``, and in it a flag at the first of each run of equals."""
    order = np.argsort(values, kind="stable")
    ordered = values[order]
    first = np.ones(len(values), dtype=bool)
    first[1:] = ordered[1:] != ordered[:-1]
    return order, first


def with_columns(batch: pa.RecordBatch, keep: Iterable[str], **more) -> pa.RecordBatch:
    """The kept columns of a batch followed by new ones."""
    columns = {name: batch.column(batch.schema.get_field_index(name)) for name in keep}
    return pa.RecordBatch.from_pydict(columns | {k: pa.array(v) if isinstance(v, np.ndarray) else v for k, v in more.items()})
