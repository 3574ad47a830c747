"""Word-start pointers over the bytes of an Arrow string column, and their sort.

A pointer is the place of a word's first byte in the column's own buffer; words are never cut out before they are
counted. Pointers are sorted by a multikey quicksort whose keys are slices of eight bytes: what is equal in a slice is
sorted by the next one, until a run of equal words is left.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Beyond so many bytes, the few words that are still equal are compared as a whole.
LONG = 64


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without nulls, and where each row starts in them (one more entry for the end)."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0] if len(column) else np.zeros(1, np.int64)


def row_blocks(offsets: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about size bytes; a larger row is a range of its own."""
    at, rows = 0, len(offsets) - 1
    while at < rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield at, end
        at = end


def runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true bytes in each row, and their rows."""
    starting = mask.copy()
    starting[1:] &= ~mask[:-1]
    edges = offsets[:-1][offsets[:-1] < len(mask)]
    starting[edges] = mask[edges]
    ending = mask.copy()
    ending[:-1] &= ~mask[1:]
    edges = offsets[1:][offsets[1:] > 0] - 1
    ending[edges] = mask[edges]
    starts, ends = np.flatnonzero(starting), np.flatnonzero(ending) + 1
    each = np.diff(np.searchsorted(starts, offsets))
    return starts, ends, np.repeat(np.arange(len(offsets) - 1), each)


def cuts(mask: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of about size bytes of one row that end between runs of true bytes."""
    at = 0
    while len(mask) - at > size:
        end = at + size
        while end < len(mask) and mask[end - 1]:
            gaps = np.flatnonzero(~mask[end : end + size])
            end = end + int(gaps[0]) + 1 if len(gaps) else min(len(mask), end + size)
        yield at, end
        at = end
    yield at, len(mask)


def equal_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, new): the pointers in an order in which equal words are neighbours, those of a run by their places, and
    where a run begins. Words have no zero byte."""
    n = len(starts)
    data = np.concatenate([data, np.zeros(8, np.uint8)])
    slices = np.ndarray(len(data) - 7, ">u8", data, strides=(1,))
    order, new, at, depth = np.arange(n), np.zeros(n, bool), np.arange(n), 0
    new[:1] = True
    while len(at):
        rows = order[at]
        left = ends[rows] - starts[rows] - depth
        if depth < LONG:
            key = slices[starts[rows] + np.minimum(depth, ends[rows] - starts[rows])].astype(np.uint64)
            shift = (8 * np.clip(8 - left, 0, 8)).astype(np.uint64)
            key = np.where(left <= 0, np.uint64(0), key >> np.minimum(shift, np.uint64(63)) << np.minimum(shift, np.uint64(63)))
        else:
            known: dict[bytes, int] = {}
            key = np.array([known.setdefault(data[a:b].tobytes(), len(known)) for a, b in zip(starts[rows] + depth, ends[rows])], np.uint64)
        by = np.lexsort((key, np.cumsum(new[at]))) if depth else np.argsort(key, kind="stable")
        order[at], key, left = rows[by], key[by], left[by]
        new[at[1:]] |= key[1:] != key[:-1]
        if depth >= LONG:
            break
        first = np.flatnonzero(new[at])
        open_ = np.logical_or.reduceat(left > 8, first) & (np.diff(first, append=len(at)) > 1)
        at = at[open_[np.cumsum(new[at]) - 1]]
        depth += 8
    return order, new


def cut_out(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The words at these pointers, as a string column."""
    lengths = ends - starts
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    places = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], lengths)
    taken = np.ascontiguousarray(data[places])
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(taken)).cast(pa.string())
