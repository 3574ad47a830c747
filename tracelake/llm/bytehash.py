"""Vectorised hashes of tokens and of byte windows, modulo 2 ** 64.

A window's raw hash is sum(byte[k] * B ** (length - 1 - k)); it is mixed before use, so that all its bits are fit for
comparing and for picking. Equal bytes give equal hashes everywhere; whatever needs certainty verifies the bytes.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def window_hashes(data: np.ndarray, length: int) -> np.ndarray:
    """The mixed hash of every window of `length` items of data (an array of small integers)."""
    if len(data) < length:
        return np.zeros(0, np.uint64)
    out, done, power = np.zeros(len(data) - length + 1, np.uint64), 0, data.astype(np.uint64) + np.uint64(1)
    size = 1
    while True:  # power holds the hashes of windows of `size` items; length is put together from its binary digits
        if length & size:
            out *= np.uint64(pow(BASE, size, 1 << 64))
            out += power[done : done + len(out)]
            done += size
        if done == length:
            return mix(out)
        power = power[:-size] * np.uint64(pow(BASE, size, 1 << 64)) + power[size:]
        size *= 2


_TOKEN = np.zeros(256, bool)
_TOKEN[[*b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


#: Bytes of texts that are hashed together; a longer text is hashed alone.
TOGETHER = 1 << 18


def token_hashes(text: bytes) -> np.ndarray:
    """The mixed hash of every token of text: a run of ASCII letters, digits and non-ASCII bytes, A-Z lower-cased."""
    return hashes_of_texts(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0]


def hashes_of_texts(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the tokens of all texts that lie between bounds of data, as token_hashes() gives them, one after the
    other, and the number of those before each text and after the last one."""
    data = _LOWER[data]
    inside = _TOKEN[data]
    begins = bounds[:-1][bounds[:-1] < bounds[1:]]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    first[begins] = inside[begins]
    last[:-1] &= ~inside[1:]
    last[begins[1:] - 1] = inside[begins[1:] - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    out = _by_sums(data, starts, ends) if len(data) <= TOGETHER else _by_letter(data, starts, ends)
    return mix(out ^ (ends - starts).astype(np.uint64) << np.uint64(56)), np.searchsorted(starts, bounds)


def _by_sums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The raw hash of data from each start to its end, from sums over all that is before."""
    power, inverse = (np.full(len(data), b, np.uint64) for b in (BASE, pow(BASE, -1, 1 << 64)))
    for p in (power, inverse):  # p[k] is the base to the power k
        p[:1] = 1
        np.multiply.accumulate(p, out=p)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * inverse, out=sums[1:])
    return (sums[ends] - sums[starts]) * power[ends - 1]


def _by_letter(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """As by sums, whatever the size of data."""
    length = ends - starts
    out = np.zeros(len(starts), np.uint64)
    alive = np.arange(len(starts))
    for k in range(min(int(length.max(initial=0)), 24)):  # letter by letter, all tokens at once
        alive = alive[length[alive] > k]
        out[alive] = out[alive] * np.uint64(BASE) + data[starts[alive] + k] + np.uint64(1)
    for i in np.flatnonzero(length > 24):  # the few long ones each on its own
        h = int(out[i])
        for c in data[starts[i] + 24 : ends[i]].tolist():
            h = (h * BASE + c + 1) & _MASK
        out[i] = h
    return out


def hashes_by_text(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """hashes_of_texts() of some texts at a time, after the number of the first of them; texts has no nulls."""
    texts = texts.cast(pa.large_binary())
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data, row = np.frombuffer(texts.buffers()[2] or b"", np.uint8), 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(bounds, bounds[row] + TOGETHER, side="right")) - 1)
        yield row, *hashes_of_texts(data[bounds[row] : bounds[end]], bounds[row : end + 1] - bounds[row])
        row = end
