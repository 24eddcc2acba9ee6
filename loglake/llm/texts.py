"""Words, windows and hashes of whole Arrow batches of texts.

Texts stay in Arrow's one buffer of bytes; word borders and hashes of all
texts of a piece are found together, without a Python object per word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text handled at a time; a longer text makes a piece of its own.
PIECE_BYTES = 2 << 20
#: Bytes whose words are hashed together, at eight bytes a byte; a longer word is hashed by itself.
_HASHED_BYTES = 1 << 17

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_ODD = 0x9E3779B97F4A7C15
_ODD_INVERSE = pow(_ODD, -1, 1 << 64)


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly, one to one."""
    values = values ^ (values >> np.uint64(30))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    values ^= values >> np.uint64(27)
    values *= np.uint64(0x94D049BB133111EB)
    values ^= values >> np.uint64(31)
    return values


_known_powers: dict[int, np.ndarray] = {}


def _powers(base: int, count: int) -> np.ndarray:
    """base ** 0, 1, 2 ... modulo 2 ** 64; those of usual words are kept."""
    known = _known_powers.get(base)
    if known is None or len(known) < count:
        steps = np.full(max(count, _HASHED_BYTES), base, np.uint64)
        steps[0] = 1
        known = np.multiply.accumulate(steps)
        if len(known) <= 2 * _HASHED_BYTES:
            _known_powers[base] = known
    return known[:count]


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int | None = None) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``most`` (or else ``PIECE_BYTES``) bytes of text."""
    for batch in batches:
        yield from slices(batch, column, most)
    give_back()


def slices(batch: pa.RecordBatch, column: str, most: int | None = None) -> Iterator[pa.RecordBatch]:
    """One batch as ``pieces`` cuts it."""
    most = most or PIECE_BYTES
    sizes = np.diff(_offsets(_strings(batch.column(column))))
    filled = np.cumsum(sizes)
    start = 0
    while start < batch.num_rows:
        done = filled[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(filled, done + most, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def give_back() -> None:
    """Return freed memory to the machine; a worker waits for later tasks beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def _strings(column) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.fill_null("") if column.null_count else column


def _offsets(column: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if not len(column):
        return np.zeros(1, np.int64)
    whole = np.frombuffer(column.buffers()[1], kind)
    return whole[column.offset:column.offset + len(column) + 1].astype(np.int64)


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """All bytes in one array, and where each text starts (and the last ends)."""
    column = _strings(column)
    offsets = _offsets(column)
    buffer = column.buffers()[2] if len(column) else None
    data = np.frombuffer(buffer, np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


@dataclass
class Words:
    """Words of several texts; ``bounds`` has each text's first word."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def hashes(self) -> np.ndarray:
        """64 bits per word, told by its bytes alone."""
        found = np.empty(len(self.starts), np.uint64)
        at = 0
        while at < len(found):
            low = self.starts[at]
            stop = max(at + 1, int(np.searchsorted(self.ends, low + _HASHED_BYTES, "right")))
            starts, ends = self.starts[at:stop] - low, self.ends[at:stop] - low
            weighed = self.data[low:low + ends[-1]].astype(np.uint64)
            weighed += np.uint64(1)
            weighed *= _powers(_ODD, len(weighed))
            sums = np.zeros(len(weighed) + 1, np.uint64)
            np.cumsum(weighed, out=sums[1:])
            found[at:stop] = (sums[ends] - sums[starts]) * _powers(_ODD_INVERSE, len(weighed))[starts]
            at = stop
        return mixed(found)


def words_of(column) -> Words:
    """Words are runs of anything but ASCII white space; null has none."""
    data, offsets = text_bytes(column)
    solid = ~_SPACE[data]
    before, after = np.zeros_like(solid), np.zeros_like(solid)
    before[1:], after[:-1] = solid[:-1], solid[1:]
    filled = offsets[:-1][np.diff(offsets) > 0]
    before[filled] = False
    after[offsets[1:][np.diff(offsets) > 0] - 1] = False
    starts = np.flatnonzero(solid & ~before)
    ends = np.flatnonzero(solid & ~after) + 1
    return Words(data, starts, ends, np.searchsorted(starts, offsets))


def windows(bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """First words of all windows inside one text, and each text's first window."""
    counts = np.maximum(np.diff(bounds) - width + 1, 0)
    ends = np.concatenate([[0], np.cumsum(counts)])
    return np.arange(ends[-1]) + np.repeat(bounds[:-1] - ends[:-1], counts), ends


def window_hashes(hashes: np.ndarray, starts: np.ndarray, width: int, salt: int = 0) -> np.ndarray:
    """64 bits per window of consecutive words."""
    total = np.zeros(len(starts), np.uint64)
    for step in range(width):
        factor = pow(_ODD, 2 * step + 3, 1 << 64)
        total += (hashes[starts + step] + np.uint64(salt)) * np.uint64(factor)
    return mixed(total)


def by_piece(column: str, work: Callable[[pa.RecordBatch], pa.RecordBatch | None]):
    """A function for ``mapInArrow`` that works on one piece after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, column):
            made = work(piece)
            if made is not None and made.num_rows:
                yield made

    return run
