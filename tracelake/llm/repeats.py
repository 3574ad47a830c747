"""Exact removal of repeated byte strings, by bucket-pointer refinement over all documents.

A string of `length` bytes is removed where it also starts in a document with a smaller id. As in suffix sorting by
bucket pointers, suffixes are first put into buckets by their first q bytes (q is half of length) and a bucket is
refined by the bucket identifiers of its suffixes at later offsets; a bucket identifier is a 64-bit hash of the q bytes,
so that one refinement, by the identifier at offset length - q, tells strings of `length` bytes apart.

Only sampled suffixes enter: those whose identifier is the smallest in some string of `length` bytes that holds it (a
string and its repeats sample the same identifiers, and each string samples at least one). Documents are dealt into
groups of some MB, and buckets answer to the groups. Rounds:

1. Groups send each bucket the different identifiers that they hold, nothing else. An answer has two bits for each: it
   is held elsewhere too; and it is hot, i.e. held by over `hot` groups. What is in one document alone ends here.
2. Groups send the other suffixes with their context c (the identifiers at offsets q - length and length - q). In a
   bucket, a suffix whose (h, c) occurs in a smaller document is settled: all strings round it are repeats. The rest is
   settled as well if the bucket has one context or one document; else it is open. Of hot identifiers the strings that
   sample them are sent at once, each to its own bucket (see 3), so that however many contexts an identifier has, none
   gathers them.
3. For the strings that sample an open suffix and that no settled one covers, (identifier at 0, identifier at length - q)
   is put into buckets again, and a string is a repeat if its pair occurs in a smaller document.

What a round has settled is reused by the next as it is. Before each exchange a group keeps of each pair only what
belongs to its smallest document, as the rest is settled by that; so a string that a third of all documents hold sends
one entry for each group. Entries travel as packed arrays, one bucket for each bucket_bytes and one group for each
group_bytes of text. An entry counts on 96 bits of hashes; the chance of a wrong removal is far below that of a disk error
up to hundreds of terabytes.

Defined results: null texts count as empty; texts shorter than length bytes keep all; documents with one id don't
remove from one another; null ids count as larger than all others; an empty table gives no rows; columns of the input
that aren't named are ignored. Very long texts are cut into overlapping pieces for the search. Repeated rows (one id and
one text) are held by one group.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytehash import BASE, mix

_LAST = np.iinfo(np.int64).max
#: What is sent to buckets, and what comes back to groups. Marks pass through buckets on their way to a later round.
_KNOWN, _ENTRY, _STRING = 0, 1, 2
_ANSWER, _OPEN, _COVERED, _COVERED_STRING = 3, 4, 5, 6
#: What an entry is known by: h and c (48 bits each), document, number of the row in its group, and offset. A suffix's
#: offset carries the strings that sample it (see _with_run()), a string's is its start.
_FIELDS = (("h", np.uint64), ("c", np.uint64), ("doc", np.int64), ("row", np.int64), ("at", np.int64))


def _planes(x: np.ndarray, width: int) -> bytes:
    """Lowest `width` bytes of each number, byte by byte, so that high bytes compress well."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _unplane(data: memoryview, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(data[: n * width], np.uint8).reshape(width, n).T
    return out.view("<u8").ravel()


def _pack_sorted(h: np.ndarray) -> tuple[int, bytes]:
    """(bytes of each number, differences) of numbers in order."""
    delta = np.diff(h, prepend=h[:1])
    most = int(delta.max(initial=0))
    width = next(w for w in (2, 3, 4, 6) if not most >> 8 * w)
    return width, _planes(delta, width)


def _unpack_sorted(view: memoryview, base: int, n: int, width: int) -> np.ndarray:
    return np.cumsum(_unplane(view, n, width), dtype=np.uint64) + np.uint64(base)


def pack_known(h: np.ndarray, several: np.ndarray) -> bytes:
    """Different identifiers in order, and whether each is in several documents of its group."""
    width, data = _pack_sorted(h)
    return np.array([len(h), int(h[0]) if len(h) else 0, width], np.int64).tobytes() + np.packbits(several).tobytes() + data


def unpack_known(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    view = memoryview(blob)
    n, base, width = np.frombuffer(view[:24], np.int64).tolist()
    at = 24 + (n + 7) // 8
    return _unpack_sorted(view[at:], base, n, width), np.unpackbits(np.frombuffer(view[24:at], np.uint8), count=n).view(bool)


def pack(e: dict[str, np.ndarray]) -> bytes:
    """Entries in order of h."""
    rows, first, index = np.unique(e["row"], return_index=True, return_inverse=True)
    width, data = _pack_sorted(e["h"])
    widths = [width, 6, 4 if len(rows) > 1 << 16 else 2, 8 if int(e["at"].max(initial=0)) >> 32 else 4]
    head = np.array([len(e["at"]), len(rows), int(e["h"][0]) if len(e["h"]) else 0, *widths], np.int64).tobytes()
    parts = zip((e["c"], index.ravel(), e["at"]), widths[1:])
    return head + _planes(rows, 4) + _planes(e["doc"][first], 8) + data + b"".join(_planes(x, w) for x, w in parts)


def unpack(blob: bytes) -> dict[str, np.ndarray]:
    view = memoryview(blob)
    n, k, base, *widths = np.frombuffer(view[:56], np.int64).tolist()
    rows, docs = _unplane(view[56:], k, 4).view(np.int64), _unplane(view[56 + 4 * k :], k, 8).view(np.int64)
    at, found = 56 + 12 * k, []
    for w in widths:
        found.append(view[at : at + n * w])
        at += n * w
    c, index, offset = (_unplane(x, n, w).view(np.int64) for x, w in zip(found[1:], widths[1:]))
    return {"h": _unpack_sorted(found[0], base, n, widths[0]), "c": c.view(np.uint64), "doc": docs[index], "row": rows[index], "at": offset}


def pack_marks(row: np.ndarray, at: np.ndarray) -> bytes:
    """(row, offset) pairs."""
    order = np.lexsort((at, row))
    row, at = row[order], at[order]
    wide = 8 if int(at.max(initial=0)) >> 32 else 4
    return np.array([len(at), wide], np.int64).tobytes() + _planes(np.diff(row, prepend=0), 4) + _planes(at, wide)


def unpack_marks(blob: bytes) -> dict[str, np.ndarray]:
    view = memoryview(blob)
    n, wide = np.frombuffer(view[:16], np.int64).tolist()
    return {"row": np.cumsum(_unplane(view[16:], n, 4).view(np.int64)), "at": _unplane(view[16 + 4 * n :], n, wide).view(np.int64)}


def _joined(parts: list[dict]) -> dict[str, np.ndarray]:
    """One set of entries of all parts, which are given up on the way."""
    n = sum(len(p["at"]) for p in parts)
    out = {k: np.empty(n, t) for k, t in _FIELDS if not parts or k in parts[0]}
    while parts:
        part = parts.pop()
        for k, v in part.items():
            out[k][n - len(v) : n] = v
        n -= len(part["at"])
    return out


def _sorted(e: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """e ordered by h, c and document; whether the entry's (h, c) occurs in a smaller document."""
    order = np.lexsort((e["doc"], e["c"], e["h"]))
    for k in e:  # one field at a time, so that there is never a second copy of all
        e[k] = e[k][order]
    new = np.ones(len(order), bool)
    new[1:] = (e["h"][1:] != e["h"][:-1]) | (e["c"][1:] != e["c"][:-1])
    first = np.flatnonzero(new)
    return e, e["doc"] > np.repeat(e["doc"][first], np.diff(first, append=len(order)))


def _open(e: dict[str, np.ndarray]) -> np.ndarray:
    """Whether the entry's bucket has several contexts, and several documents; e holds one document for each (h, c)."""
    if not len(e["h"]):
        return np.zeros(0, bool)
    first = np.flatnonzero(np.concatenate([[True], e["h"][1:] != e["h"][:-1]]))
    sizes = np.diff(first, append=len(e["h"]))
    several = (np.minimum.reduceat(e["c"], first) != np.maximum.reduceat(e["c"], first)) & (
        np.minimum.reduceat(e["doc"], first) != np.maximum.reduceat(e["doc"], first)
    )
    return np.repeat(several, sizes)


def _take(e: dict[str, np.ndarray], which: np.ndarray) -> dict[str, np.ndarray]:
    return {k: v[which] for k, v in e.items()}


def _bounds(h: np.ndarray, buckets: int) -> list[int]:
    """Where each bucket begins in identifiers in order, and their number."""
    edges = [-(-k * (1 << 48) // buckets) for k in range(buckets)]
    return [*np.searchsorted(h, np.array(edges, np.uint64)).tolist(), len(h)]


def _by_group(e: dict[str, np.ndarray], kind: int) -> list[tuple]:
    """Rows (bucket, group, kind, part, packed marks); here the high half of an entry's row is its group."""
    g = e["row"] >> 32
    order = np.argsort(g, kind="stable")
    g, row, at = g[order], e["row"][order] & 0xFFFFFFFF, e["at"][order]
    first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else []
    return [(-1, int(g[a]), kind, 0, pack_marks(row[a:b], at[a:b])) for a, b in zip(first, [*first[1:], len(g)])]


def _by_bucket(e: dict[str, np.ndarray], kind: int, group: int, buckets: int) -> list[tuple]:
    """Rows (bucket, group, kind, part, packed): entries to compare, and marks of what is settled here already."""
    e, covered = _sorted(e)
    mark = _COVERED if kind == _ENTRY else _COVERED_STRING
    out = [(group % buckets, group, mark, 0, pack_marks(e["row"][covered], e["at"][covered]))] if covered.any() else []
    e = _take(e, ~covered)
    bounds = _bounds(e["h"], buckets)
    return out + [(b, group, kind, 0, pack({k: v[x:y] for k, v in e.items()})) for b, (x, y) in enumerate(zip(bounds, bounds[1:])) if y > x]


def _per_row(e: dict[str, np.ndarray]) -> dict[int, np.ndarray]:
    """Offsets by row."""
    order = np.argsort(e["row"], kind="stable")
    row, at = e["row"][order], e["at"][order]
    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, np.int64)
    return {int(row[a]): at[a:b] for a, b in zip(first, [*first[1:], len(row)])}


def _hashes_at(data: np.ndarray, at: np.ndarray, q: int) -> np.ndarray:
    """window_hashes(data, q)[at], without the others."""
    h = np.zeros(len(at), np.uint64)
    for k in range(q):
        h = h * np.uint64(BASE) + data[at + k] + np.uint64(1)
    return mix(h)


def _slide(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` neighbours."""
    out, size = x, 1
    while size * 2 <= width:
        out, size = np.minimum(out[:-size], out[size:]), size * 2
    n = len(x) - width + 1
    return np.minimum(out[:n], out[width - size : width - size + n])


def _with_run(p: np.ndarray, back: np.ndarray, more: np.ndarray, length: int) -> np.ndarray:
    """Offsets p of suffixes, with the strings that sample them: the first starts `back` before p, and `more` follow."""
    bits = length.bit_length()
    return p << 2 * bits | back << bits | more


def _suffixes(at: np.ndarray, length: int) -> np.ndarray:
    """The offsets alone."""
    return at >> 2 * length.bit_length()


def _sampling(at: np.ndarray, length: int) -> np.ndarray:
    """The starts of the strings that sample the suffixes."""
    bits = length.bit_length()
    mask, more = (1 << bits) - 1, at & (1 << bits) - 1
    first = (at >> 2 * bits) - (at >> bits & mask)
    return np.unique(np.repeat(first - np.cumsum(more + 1) + more + 1, more + 1) + np.arange((more + 1).sum()))


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of BASE and of its inverse, n of each at least."""
    if not _POWERS or len(_POWERS[0]) < n:
        _POWERS[:] = [np.multiply.accumulate(np.array([1] + [b] * n, np.uint64)) for b in (BASE, pow(BASE, -1, 1 << 64))]
    return _POWERS[0], _POWERS[1]


def raw_hashes(data: np.ndarray, length: int) -> np.ndarray:
    """The hash of every window of data, before mixing, as differences of one running sum."""
    up, down = _powers(len(data) + length)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data + np.uint64(1)) * down[: len(data)], out=sums[1:])
    return (sums[length:] - sums[:-length]) * up[length - 1 : len(data)]


def sample(pieces: list[tuple], length: int) -> dict[str, np.ndarray]:
    """Entries of the sampled suffixes of pieces: (document, row, bytes, offset of the bytes, first and last string)."""
    q = -(-length // 2)
    side, width = length - q, length - q + 1
    parts, starts, total = [], [], 0
    for _, _, data, *_ in pieces:
        parts += [np.full(side, 256, np.uint64), np.frombuffer(data, np.uint8).astype(np.uint64), np.full(side, 257, np.uint64)]
        starts.append(total + side)
        total += len(data) + 2 * side
    h = raw_hashes(np.concatenate(parts), q)
    # The low bits of what is compared hold the place, so that the least of a window says where it is.
    bits = np.uint64((1 << width.bit_length()) - 1)
    key = h * np.uint64(0xBF58476D1CE4E5B9)
    key ^= key >> np.uint64(29)
    key = key & ~bits | np.arange(len(key), dtype=np.uint64) & bits
    least = _slide(key, width)
    valid = np.zeros(len(least), bool)
    for at, (_, _, _, offset, a, b) in zip(starts, pieces):
        valid[at + a - offset : at + b - offset] = True
    first, last = valid.copy(), valid.copy()
    change = least[1:] != least[:-1]
    first[1:] &= ~valid[:-1] | change
    last[:-1] &= ~valid[1:] | change
    s, end = np.flatnonzero(first), np.flatnonzero(last)
    p = s + ((least[s] - s.astype(np.uint64)) & bits).astype(np.int64)
    piece = np.searchsorted(np.array(starts), p, side="right") - 1
    c = mix(mix(h[p - side]) * np.uint64(0x9E3779B97F4A7C15) + mix(h[p + side]))
    table = np.array([(d, r, offset - at) for at, (d, r, _, offset, _, _) in zip(starts, pieces)], np.int64).reshape(-1, 3)[piece]
    return {
        "h": mix(h[p]) >> np.uint64(16),
        "c": c >> np.uint64(16),
        "doc": table[:, 0].copy(),
        "row": table[:, 1].copy(),
        "at": _with_run(p + table[:, 2], p - s, end - s, length)
    }


def _pieces(doc: int, row: int, data: bytes, length: int, size: int):
    side, n = length // 2, len(data)
    for a in range(0, n - length + 1, size):
        b = min(a + size, n - length + 1)
        lo = max(0, a - side)
        yield doc, row, data[lo : b + length + side], lo, a, b


def _rows(table: pa.Table) -> list[tuple[int, int, bytes]]:
    """The different (hash, document, bytes) of a group, in an order that is the same whenever the group is read."""
    return sorted(set(zip(table["row"].to_pylist(), table["doc"].to_pylist(), table["data"].to_pylist())))


def _parts(rows: list[tuple[int, int, bytes]], length: int, most: int, size: int = 1 << 16) -> Iterator[dict[str, np.ndarray]]:
    """Entries of the sampled suffixes of a group, about `most` at a time."""
    found, n, pieces, held = [], 0, [], 0
    for number, (_, doc, data) in enumerate(rows):
        for piece in _pieces(doc, number, data, length, size):
            pieces.append(piece)
            held += len(piece[2]) + length
            if held >= size:
                found.append(sample(pieces, length))
                n, pieces, held = n + len(found[-1]["h"]), [], 0
                if n >= most:
                    yield _joined(found)
                    found, n = [], 0
    if pieces:
        found.append(sample(pieces, length))
    if found:
        yield _joined(found)


def _strings(rows: list[tuple[int, int, bytes]], wanted: dict[int, np.ndarray], length: int) -> dict[str, np.ndarray] | None:
    """Entries of strings: wanted has their offsets by row."""
    q, found = -(-length // 2), []
    for r, s in wanted.items():
        _, doc, data = rows[r]
        near = np.unique(np.concatenate([s, s + length - q]))
        h = _hashes_at(np.frombuffer(data, np.uint8), near, q)
        first, second = h[np.searchsorted(near, s)], h[np.searchsorted(near, s + length - q)]
        found.append(
            {
                "h": first >> np.uint64(16),
                "c": second >> np.uint64(16),
                "doc": np.full(len(s), doc, np.int64),
                "row": np.full(len(s), r, np.int64),
                "at": s
            }
        )
    return _joined(found) if found else None


_TO_BUCKET = pa.schema([("bucket", pa.int32()), ("group", pa.int32()), ("kind", pa.int32()), ("part", pa.int32()), ("entries", pa.binary())])
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_ROWS = "bucket int, group int, kind int, part int, entries binary"


def _table(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(_TO_BUCKET), _TO_BUCKET)], schema=_TO_BUCKET)


def _sent(table: pa.Table) -> Iterator[tuple[int, int, int, int, bytes]]:
    """The rows of a table, one at a time."""
    for b, g, k, p, blob in zip(*(table[c].to_pylist() for c in ("bucket", "group", "kind", "part")), table["entries"]):
        yield b, g, k, p, blob.as_py()


def _marks(table: pa.Table) -> dict[int, dict[int, np.ndarray]]:
    """Offsets by kind and row."""
    found: dict[int, list] = {_OPEN: [], _COVERED: [], _COVERED_STRING: []}
    for _, _, k, _, blob in _sent(table):
        found[k].append(unpack_marks(blob))
    return {k: _per_row(_joined(x)) for k, x in found.items()}


def _settled(marks: dict[int, dict[int, np.ndarray]], row: int, size: int, length: int) -> np.ndarray:
    """Whether the string at each offset of a text of so many bytes is known to be a repeat."""
    n, side = size - length + 1, length - -(-length // 2)
    depth = np.zeros(n + 1, np.int64)
    if (at := marks[_COVERED].get(row)) is not None:
        at = _suffixes(at, length)
        np.add.at(depth, np.clip(at - side, 0, n), 1)
        np.add.at(depth, np.minimum(at + 1, n), -1)
    settled = np.cumsum(depth)[:-1] > 0
    if (at := marks[_COVERED_STRING].get(row)) is not None:
        settled[at] = True
    return settled


def repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = 50,
    bucket_bytes: int = 8 << 20,
    group_bytes: int = 6 << 20,
    most: int = 500_000,
    hot: int = 256
) -> DataFrame:
    """doc_id, n_bytes, spans (maximal removed runs of bytes, as structs start and end) and kept (the other bytes).

    bucket_bytes, group_bytes and most bound what a task holds at once; hot is how many groups may hold an identifier
    before its contexts are spread over buckets. None of them changes the result.
    """
    data = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    total = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]
    buckets, groups = total // bucket_bytes + 1, total // group_bytes + 1
    doc = F.coalesce(F.col(id_col).cast("long"), F.lit(int(_LAST)))
    rows = docs.select(F.col(id_col).alias("doc_id"), doc.alias("doc"), F.xxhash64(doc, data).alias("row"), data.alias("data"))
    by_group = rows.filter(F.octet_length("data") >= length).withColumn("group", F.pmod("row", F.lit(groups)).cast("int")).groupBy("group")

    def known(table: pa.Table) -> pa.Table:
        """Round 1, from groups."""
        group, out = table["group"][0].as_py(), []
        for part, e in enumerate(_parts(_rows(table), length, most)):
            order = np.lexsort((e["doc"], e["h"]))
            h, docs_of = e["h"][order], e["doc"][order]
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            last = np.append(first[1:], len(h)) - 1
            h, several = h[first], docs_of[first] != docs_of[last]
            bounds = _bounds(h, buckets)
            out += [(b, group, _KNOWN, part, pack_known(h[x:y], several[x:y])) for b, (x, y) in enumerate(zip(bounds, bounds[1:])) if y > x]
        return _table(out)

    def answered(table: pa.Table) -> pa.Table:
        """Round 1, from buckets."""
        sent = list(_sent(table))
        lists = [unpack_known(x[4]) for x in sent]
        h, several = np.concatenate([x for x, _ in lists]), np.concatenate([x for _, x in lists])
        order = np.argsort(h, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], h[order][1:] != h[order][:-1]]))
        times = np.diff(first, append=len(h))
        elsewhere, is_hot = np.empty(len(h), bool), np.empty(len(h), bool)
        elsewhere[order] = np.repeat((times > 1) | np.logical_or.reduceat(several[order], first), times)
        is_hot[order] = np.repeat(times > hot, times)
        ends = np.cumsum([len(x) for x, _ in lists])
        return _table(
            [
                (
                    b,
                    g,
                    _ANSWER,
                    p,
                    np.packbits(np.concatenate([elsewhere[z - len(x) : z], is_hot[z - len(x) : z]])).tobytes()
                ) for (b, g, _, p, _), (x, _), z in zip(sent, lists, ends)
            ]
        )

    def entered(left: pa.Table, right: pa.Table) -> pa.Table:
        """Round 2, from groups."""
        if not left.num_rows:
            return _table([])
        group, rows, out, hot_ones = left["group"][0].as_py(), _rows(left), [], []
        answers = {(p, b): blob for b, _, _, p, blob in _sent(right)}
        for part, e in enumerate(_parts(rows, length, most)):
            h, index = np.unique(e["h"], return_inverse=True)
            elsewhere, is_hot = np.zeros(len(h), bool), np.zeros(len(h), bool)
            bounds = _bounds(h, buckets)
            for b, (x, y) in enumerate(zip(bounds, bounds[1:])):
                if y > x:
                    flags = np.unpackbits(np.frombuffer(answers[part, b], np.uint8), count=2 * (y - x)).view(bool)
                    elsewhere[x:y], is_hot[x:y] = flags[: y - x], flags[y - x :]
            hot_ones.append({k: e[k][is_hot[index]] for k in ("row", "at")})
            out += _by_bucket(_take(e, (elsewhere & ~is_hot)[index]), _ENTRY, group, buckets)
        wanted = {r: _sampling(at, length) for r, at in _per_row(_joined(hot_ones)).items()} if hot_ones else {}
        if (e := _strings(rows, wanted, length)) is not None:
            out += _by_bucket(e, _STRING, group, buckets)
        return _table(out)

    def compared(table: pa.Table) -> pa.Table:
        """Rounds 2 and 3, from buckets."""
        out, parts = [], {_ENTRY: [], _STRING: []}
        for b, g, k, p, blob in _sent(table):
            if k in parts:
                e = unpack(blob)
                e["row"] |= g << 32
                parts[k].append(e)
            else:
                out.append((b, g, k, p, blob))
        for kind, found in parts.items():
            e, covered = _sorted(_joined(found))
            out += _by_group(_take(e, covered), _COVERED if kind == _ENTRY else _COVERED_STRING)
            if kind == _ENTRY:
                e = _take(e, ~covered)
                out += _by_group(_take(e, _open(e)), _OPEN)
        pa.default_memory_pool().release_unused()
        return _table(out)

    def refined(left: pa.Table, right: pa.Table) -> pa.Table:
        """Round 3, from groups."""
        if not left.num_rows:
            return _table([])
        group, rows, marks = left["group"][0].as_py(), _rows(left), _marks(right)
        wanted = {}
        for r, at in marks[_OPEN].items():
            s = _sampling(at, length)
            s = s[~_settled(marks, r, len(rows[r][2]), length)[s]]
            if len(s):
                wanted[r] = s
        out = [(group % buckets, g, k, p, blob) for _, g, k, p, blob in _sent(right) if k != _OPEN]
        if (e := _strings(rows, wanted, length)) is not None:
            out += _by_bucket(e, _STRING, group, buckets)
        return _table(out)

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        numbers, marks = {x: k for k, x in enumerate(_rows(left))}, _marks(right)
        spans, kept = [], []
        for x in zip(left["row"].to_pylist(), left["doc"].to_pylist(), left["data"].to_pylist()):
            r, data = numbers[x], x[2]
            if r not in marks[_COVERED] and r not in marks[_COVERED_STRING]:
                spans.append([])
                kept.append(data)
                continue
            starts = _settled(marks, r, len(data), length).view(np.int8)
            depth = np.zeros(len(data) + 1, np.int64)
            depth[: len(starts)] += starts
            depth[length:] -= starts
            gone = np.cumsum(depth)[:-1] > 0
            edges = np.flatnonzero(np.diff(gone.view(np.int8), prepend=0, append=0)).tolist()
            spans.append([{"start": a, "end": b} for a, b in zip(edges[::2], edges[1::2])])
            kept.append(np.frombuffer(data, np.uint8)[~gone].tobytes())
        sizes = [len(k) + sum(x["end"] - x["start"] for x in s) for k, s in zip(kept, spans)]
        return pa.table(
            [left["doc_id"], pa.array(sizes, pa.int64()), pa.array(spans, _SPANS), pa.array(kept, pa.binary())],
            names=["doc_id", "n_bytes", "spans", "kept"]
        )

    identifiers = by_group.applyInArrow(known, _ROWS).groupBy("bucket").applyInArrow(answered, _ROWS).groupBy("group")
    suffixes = by_group.cogroup(identifiers).applyInArrow(entered, _ROWS).groupBy("bucket").applyInArrow(compared, _ROWS).groupBy("group")
    strings = by_group.cogroup(suffixes).applyInArrow(refined, _ROWS).groupBy("bucket").applyInArrow(compared, _ROWS).groupBy("group")
    id_type = docs.schema[id_col].dataType.simpleString()
    result = f"doc_id {id_type}, n_bytes long, spans array<struct<start: long, end: long>>, kept binary"
    short = rows.filter(F.octet_length("data") < length)
    short = short.select(
        "doc_id",
        F.octet_length("data").cast("long").alias("n_bytes"),
        F.array().cast("array<struct<start: long, end: long>>").alias("spans"),
        F.col("data").alias("kept")
    )
    return by_group.cogroup(strings).applyInArrow(cut, result).unionByName(short)
