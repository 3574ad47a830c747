"""Packing token sequences into windows by Karmarkar-Karp multiway differencing.

A document's ids, and an end mark, are cut into whole windows as far as they reach; what is left of it is packed with
what is left of others. Differencing starts with one partial partition for each piece (all of it in one window) and
merges the two with the largest imbalance, large windows of the one with small windows of the other, until one partition
into nearly equal windows is left. If its largest window exceeds the capacity, there is one window more. The little room
that all windows then have is filled with pieces cut from documents that the block leaves to the next one.

Each task packs what it reads, in blocks of windows, so that nothing is shuffled and a task holds one block. At the end
of a task the rest is cut into windows of a power of two, which aren't padded. A task that is run again reads its part of the table again and packs it in the same way.

The ids are those of the library. The tokenizer encodes each unit of its pre-tokeniser on its own: where a text has only
characters on whose classes all regular-expression libraries agree, and no special token, units are found here and
each different one is encoded once; any other text goes to the library, in parts that end with white space.

Defined results: a null text counts as empty and has the end mark only; repeated rows are packed each on its own; an
empty table gives no rows; columns of the input that aren't named are ignored.
"""

import json
import os
import re
import struct
import sys
import types
import unicodedata
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _ranges(kind: str) -> str:
    """A character class of the code points below U+0250 whose category begins with kind."""
    points = [k for k in range(0x250) if unicodedata.category(chr(k)).startswith(kind)]
    first = [k for k in points if k - 1 not in points]
    last = [k for k in points if k + 1 not in points]
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in zip(first, last))


# The units of word-level pre-tokenisers, and the characters outside the common stock.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_UNIT = f"'s|'t|'re|'ve|'m|'ll|'d|[{_ranges('L')}]+|[{_ranges('N')}]|[^\\s{_ranges('L')}{_ranges('N')}]+"
_UNCOMMON = r"[^\t\n\x0b\x0c\r\x20-\x7e\xa0-ɏ]"


def _byte_letters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself where it can be printed."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b if b in own else next(others)) for b in range(256)]


_BYTE_LETTERS = _byte_letters()


class Units(dict):
    """The ids of units that are normalised already, found when they are first asked for."""

    def __init__(self, model):
        self.model = model

    def __missing__(self, unit: str) -> bytes:
        """The unit's bytes as the characters that stand for them, and merges of these."""
        letters = unit if unit.isascii() else "".join(map(_BYTE_LETTERS.__getitem__, unit.encode()))
        ids = [x.id for x in self.model.tokenize(letters)]
        found = self[unit] = struct.pack(f"<{len(ids)}I", *ids)
        return found


def encoder(definition: str) -> "Encoder":
    """The worker's encoder. Functions come to a worker anew with each task, but it runs many tasks; what it has learned
    is kept in a module of its own."""
    kept = sys.modules.setdefault("tracelake_worker_memory", types.ModuleType("tracelake_worker_memory")).__dict__
    if kept.get("definition") != definition:
        kept |= {"definition": definition, "encoder": Encoder(definition)}
    return kept["encoder"]


class Encoder:
    """Ids of texts as the library gives them, without added special tokens; remembers about `most` units."""

    def __init__(self, definition: str, most: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_str(definition), most
        self.known = Units(self.tokenizer.model)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        about = json.loads(definition)
        normal = [(x["type"], x.get("pattern"), x.get("content")) for x in (about.get("normalizer") or {}).get("normalizers", [])]
        split = (about.get("pre_tokenizer") or {}).get("pretokenizers", [])
        self.by_units = (
            normal == [("NFC", None, None), ("Replace", {"Regex": r"\s+"}, " "), ("Lowercase", None, None)]
            and [x["type"] for x in split] == ["Split", "ByteLevel"]
            and (split[0]["pattern"], split[0]["behavior"], split[0]["invert"]) == ({"Regex": _SPLIT}, "Removed", True)
            and not split[1]["use_regex"]
            and not split[1]["add_prefix_space"]
            and about["model"]["type"] == "BPE"
            and not about["model"].get("dropout")
        )
        self.special = [t["content"] for t in about.get("added_tokens", [])]
        self.unit, self.uncommon = re.compile(_UNIT), re.compile(_UNCOMMON)

    def _library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> np.ndarray:
        if len(self.known) > self.most:
            self.known.clear()
        return np.frombuffer(b"".join(map(self._part, blocks(text))), "<u4")

    def _part(self, text: str) -> bytes:
        if not self.by_units or self.uncommon.search(text) or any(x in text for x in self.special):
            return self._library(text)
        return b"".join(map(self.known.__getitem__, self.unit.findall(text.lower())))


def differencing(sizes: list[int], windows: int) -> tuple[np.ndarray, list[list[int]]]:
    """Sums of the windows, and the numbers of the items in each, by Karmarkar-Karp multiway differencing."""
    n, made, heap, number = len(sizes), len(sizes), [], count()
    for i, x in enumerate(sizes):
        sums, nodes = np.zeros(windows, np.int64), np.full(windows, -1)
        sums[0], nodes[0] = x, i
        heap.append((-x if windows > 1 else 0, next(number), sums, nodes))
    heapify(heap)
    left, right = [], []  # of the nodes that stand for merged windows, from n on
    while len(heap) > 1:
        _, _, a, a_nodes = heappop(heap)
        _, _, b, b_nodes = heappop(heap)
        sums, b_nodes = a + b[::-1], b_nodes[::-1]  # both are in falling order
        both = (a_nodes >= 0) & (b_nodes >= 0)
        nodes = np.where(a_nodes >= 0, a_nodes, b_nodes)
        k = int(both.sum())
        left.append(a_nodes[both])
        right.append(b_nodes[both])
        nodes[both] = np.arange(made, made + k)
        made += k
        by = np.argsort(-sums, kind="stable")
        sums, nodes = sums[by], nodes[by]
        heappush(heap, (int(sums[-1] - sums[0]), next(number), sums, nodes))
    if not heap:
        return np.zeros(windows, np.int64), [[] for _ in range(windows)]
    lefts, rights = (np.concatenate([np.zeros(0, np.int64), *x]).tolist() for x in (left, right))
    filled = []
    for node in heap[0][3].tolist():
        todo, items = [node] if node >= 0 else [], []
        while todo:
            x = todo.pop()
            if x < n:
                items.append(x)
            else:
                todo += [lefts[x - n], rights[x - n]]
        filled.append(sorted(items))
    return heap[0][2], filled


def windows_for(sizes: list[int], capacity: int) -> list[list[int]]:
    """Items by window: as few windows as the sum asks for, and one more whenever the largest exceeds the capacity."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        sums, filled = differencing(sizes, k)
        if sums.max(initial=0) <= capacity:
            return [x for x in filled if x]
        k += 1


class Packer:
    """Packs pieces (row, start, ids) as they come. add() and finish() give (row, start, ids, sequence, offset).

    A block is differenced into windows; those with a room of `least` tokens or more are filled with pieces cut from
    what is carried on to the next block.
    """

    def __init__(self, capacity: int, windows: int, least: int):
        self.capacity, self.windows, self.least = capacity, windows, least
        self.waiting: list[tuple] = []
        self.total = self.made = 0

    def add(self, row, ids: np.ndarray) -> Iterator[tuple]:
        whole = len(ids) // self.capacity * self.capacity
        for at in range(0, whole, self.capacity):
            yield row, at, ids[at : at + self.capacity], self.made, 0
            self.made += 1
        if whole < len(ids):
            self.waiting.append((row, whole, ids[whole:].copy()))
            self.total += len(ids) - whole
        if self.total > (self.windows + 3) * self.capacity:
            carried, total = [], self.total
            while total > (self.windows - 1) * self.capacity:
                carried.append(self.waiting.pop())
                total -= len(carried[-1][2])
            yield from self._placed(self.waiting, windows_for([len(x[2]) for x in self.waiting], self.capacity), carried)
            self.waiting, self.total = carried[::-1], sum(len(x[2]) for x in carried)

    def _placed(self, pieces: list[tuple], filled: list[list[int]], spare: list[tuple]) -> Iterator[tuple]:
        """spare: pieces to fill with, the next one last; what isn't used stays there."""
        for window in filled:
            at = 0
            for i in window:
                yield *pieces[i], self.made, at
                at += len(pieces[i][2])
            while spare and self.capacity - at >= self.least:
                yield *(some := self._cut(spare, self.capacity - at)), self.made, at
                at += len(some[2])
            self.made += 1

    @staticmethod
    def _cut(spare: list[tuple], most: int) -> tuple:
        row, start, ids = spare.pop()
        if len(ids) > most:
            spare.append((row, start + most, ids[most:]))
        return row, start, ids[:most]

    def finish(self) -> Iterator[tuple]:
        """Full windows, as far as they reach, and the rest in windows of powers of two."""
        kept, spare = list(self.waiting), []
        total = self.total
        while total > max(0, self.total // self.capacity - 1) * self.capacity:
            spare.append(kept.pop())
            total -= len(spare[-1][2])
        yield from self._placed(kept, windows_for([len(x[2]) for x in kept], self.capacity) if kept else [], spare)
        self.waiting, self.total = [], 0
        rest = sum(len(x[2]) for x in spare)
        while rest:
            size, at = min(self.capacity, 1 << rest.bit_length() - 1), 0
            while at < size:
                yield *(some := self._cut(spare, size - at)), self.made, at
                at += len(some[2])
            rest, self.made = rest - size, self.made + 1


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    path: str | None = None,
    end: int = 2,
    capacity: int = 4096,
    windows: int = 64,
    least: int = 16,
    most_bytes: int = 16 << 20,
) -> DataFrame:
    """doc_id, start, length, ids, doc_tokens, sequence_id, offset of every piece of every document.

    ids: little-endian unsigned 32-bit numbers. end follows each document's ids and counts as one of them. windows: of a
    block; least: windows with less room than that are padded, others are filled. path: a tokenizer file on the driver, of most_bytes at most, which is sent to every task. docs is packed in the order in
    which its tasks read it, so it should be a table, or sorted.
    """
    with open(path or default_tokenizer(), "rb") as file:
        data = file.read(most_bytes + 1)
    if len(data) > most_bytes:
        raise ValueError(f"the tokenizer is larger than {most_bytes} bytes, which are sent to every task")
    definition = docs.sparkSession.sparkContext.broadcast(data.decode())
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.spark_partition_id().alias("part"))

    def packed(batches):
        known, packer, part, id_type, last = encoder(definition.value), Packer(capacity, windows, least), 0, None, np.array([end], "<u4")

        def pieces():
            nonlocal part, id_type
            for batch in batches:
                id_type = batch["doc_id"].type
                for doc_id, text, part in zip(batch["doc_id"], batch["text"], batch["part"].to_pylist()):
                    ids = np.append(known.encode(text.as_py()), last)
                    yield from packer.add((doc_id.as_py(), len(ids)), ids)
            yield from packer.finish()

        def batch_of(some):
            head, start, ids, sequence, offset = zip(*some)
            doc_id, tokens = zip(*head)
            numbers = [pa.array(x, pa.int64()) for x in (start, [len(x) for x in ids], tokens, [(part << 32) + x for x in sequence], offset)]
            return pa.RecordBatch.from_arrays(
                [pa.array(doc_id, id_type), *numbers[:2], pa.array([x.tobytes() for x in ids], pa.binary()), *numbers[2:]],
                names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
            )

        some, size = [], 0
        for piece in pieces():
            some.append(piece)
            size += len(piece[2]) + 64
            if size > 1 << 18:
                yield batch_of(some)
                some, size = [], 0
        if some:
            yield batch_of(some)

    return rows.mapInArrow(packed, f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def sequences(pieces: DataFrame, capacity: int = 4096, pad: int = 0) -> DataFrame:
    """sequence_id, n_tokens, ids (little-endian unsigned 32-bit numbers, padded to capacity unless n_tokens is a power of
    two) and documents (doc_id, offset, length in order) of packed pieces. A sequence has capacity pieces at most."""
    cell = F.struct("offset", "doc_id", "length", "ids")
    met = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(cell)).alias("cells"), F.sum("length").alias("n_tokens"))
    ids = F.concat(F.lit(b""), F.aggregate("cells", F.lit(b""), lambda a, x: F.concat(a, x.ids)))
    exact = F.bit_count("n_tokens") == 1
    filler = F.repeat(F.lit(f"{pad & 0xFF:02x}{pad >> 8 & 0xFF:02x}{pad >> 16 & 0xFF:02x}{pad >> 24:02x}"), (F.lit(capacity) - F.col("n_tokens")).cast("int"))
    return met.select(
        "sequence_id",
        "n_tokens",
        F.when(exact, ids).otherwise(F.concat(ids, F.unhex(filler))).alias("ids"),
        F.transform("cells", lambda x: F.struct(x.doc_id.alias("doc_id"), x.offset.alias("offset"), x.length.alias("length"))).alias("documents"),
    )
