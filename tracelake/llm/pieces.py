"""SentencePiece encoding and decoding by a weighted finite-state transducer.

Three machines are compiled from a model file. The normaliser writes the dummy prefix and turns spaces into the
model's mark. The piece machine reads characters and writes piece ids; a character that no piece holds takes the
byte-fallback arcs. The third machine weighs paths in the tropical semiring: for a unigram model an arc costs the
negative score of its piece; for a BPE model its states are the pieces, and the arc from piece a to piece b costs
nothing if merging turns the text of a and b into just a and b, and is missing (infinite) otherwise. A sequence is
what BPE gives exactly if all its neighbours are such pairs, so that the shortest path is the library's encoding.
Composition with an input is a lattice over its positions, built and searched from left to right; each position keeps
its cheapest state, which for BPE is the only one of finite cost.

Defined results: a null text counts as empty and has no pieces; an empty table gives no rows; repeated rows are encoded
alike; decoding gives a literal mark back as a space, as the library does; other columns are ignored by encode().
"""

import re
import struct
from array import array
from collections.abc import Iterator
from math import inf

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
# Types of pieces and of models in the file format.
_NORMAL, _UNKNOWN, _USER, _BYTE = 1, 2, 4, 6
_UNIGRAM, _BPE = 1, 2


def _fields(data: bytes):
    """(number, value) of the fields of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(kind) or varint()
            yield key >> 3, data[at : at + n]
            at += n


class Machine:
    """The compiled transducer of a model file, with bounded memories of what it has already worked out."""

    def __init__(self, model: bytes, most_units: int = 250_000, most_pairs: int = 500_000):
        self.ids: dict[str, int] = {}
        self.scores: list[float] = []
        self.texts: list[str] = []
        self.byte_ids, self.byte_of, self.unknown, self.controls = {}, {}, 0, set()
        self.prefix, self.kind = True, _UNIGRAM
        for number, value in _fields(model):
            if number == 1:
                piece = dict(_fields(value))
                text, kind, at = piece[1].decode(), piece.get(3, _NORMAL), len(self.texts)
                self.texts.append(text)
                self.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                if kind in (_NORMAL, _USER):
                    self.ids[text] = at
                elif kind == _BYTE:
                    self.byte_ids[int(text[3:5], 16)], self.byte_of[at] = at, int(text[3:5], 16)
                else:
                    self.controls.add(at)
                    self.unknown = at if kind == _UNKNOWN else self.unknown
            elif number == 2:
                self.kind = dict(_fields(value)).get(3, _UNIGRAM)
            elif number == 3:
                rules = dict(_fields(value))
                self.prefix = bool(rules.get(3, 1))
                if rules.get(2) or rules.get(4, 1) or not rules.get(5, 1):
                    raise ValueError("only models with the identity normaliser, kept and escaped white space are supported")
        if self.kind not in (_UNIGRAM, _BPE):
            raise ValueError("only unigram and BPE models are supported")
        self.n_pieces = len(self.texts)
        joined = {c for t in self.ids if len(t) > 1 for c in t} - {MARK}
        self.joins = {(a, b) for t in self.ids for a, b in zip(t, t[1:])}
        # No piece goes over from another character to the mark or to a character that only stands alone, nor from a
        # letter or digit to a sign unless that is among `after`: units end there, so words come without such signs.
        signs, words = {c for c in joined if not c.isalnum()}, {c for c in joined if c.isalnum()}
        after = {b for a, b in self.joins if a in words and b in signs}
        if not all(re.fullmatch(f"{MARK}*[^{MARK}]*", t) for t in self.ids):
            raise ValueError("a piece has the mark after another character")
        sign, word, follows = ("".join(re.escape(c) for c in sorted(x)) or MARK for x in (signs, words, after))
        self.unit = re.compile(f"(?s){MARK}*[{sign}]*[{word}]+(?:[{follows}][{sign}]*[{word}]*)*|{MARK}*[{sign}]+|{MARK}+|." if joined else "(?s).")
        self.units, self.most_units, self.pairs, self.most_pairs = {}, most_units, {}, most_pairs
        self.written = [
            bytes([self.byte_of[k]]) if k in self.byte_of else b"" if k in self.controls else t.encode() for k, t in enumerate(self.texts)
        ]
        self.arcs = ahocorasick.Automaton()  # at each position it gives the pieces that end there, the longest first
        for text, k in self.ids.items():
            self.arcs.add_word(text, (k, len(text)))
        for c in (joined | {MARK}) - self.ids.keys():  # stand-ins for characters that are pieces only within others
            self.arcs.add_word(c, (len(self.texts), 1))
            self.texts.append(c)
            self.scores.append(-1e6)
        self.arcs.make_automaton()

    def normalise(self, text: str) -> str:
        return ((MARK if self.prefix else "") + text.replace(" ", MARK)) if text else ""

    def merged(self, text: str) -> list[str]:
        """What merging makes of a short text: always the best neighbours, the leftmost of equals."""
        parts, ids, scores = list(text), self.ids, self.scores
        ranks = [scores[k] if (k := ids.get(a + b)) is not None else -inf for a, b in zip(parts, parts[1:])]
        while ranks and (best := max(ranks)) > -inf:
            at = ranks.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            for i in (at - 1, at):
                if 0 <= i < len(ranks):
                    ranks[i] = scores[k] if (k := ids.get(parts[i] + parts[i + 1])) is not None else -inf
        return parts

    def fits(self, before: int, k: int) -> bool:
        """Whether BPE leaves the pieces before and k as they are, side by side; before is -1 at the start."""
        pair = ([self.texts[before]] if before >= 0 else []) + [self.texts[k]]
        if len(self.pairs) >= self.most_pairs:
            self.pairs.clear()
        found = self.pairs[before * len(self.texts) + k] = self.merged("".join(pair)) == pair
        return found

    def path(self, unit: str) -> list[int]:
        """Ids along the shortest path of the lattice of unit."""
        n, size = len(unit), len(self.texts)
        pieces, back = [-1] + [-2] * n, [0] * (n + 1)
        if self.kind == _BPE:
            known = self.pairs.get
            for end, (k, length) in self.arcs.iter(unit):
                if pieces[end + 1] == -2:  # of finite paths to a position there is one
                    before = pieces[end + 1 - length]
                    if (ok := known(before * size + k)) is None:
                        ok = self.fits(before, k)
                    if ok:
                        pieces[end + 1], back[end + 1] = k, length
        else:
            costs = [0.0] + [inf] * n
            for end, (k, length) in self.arcs.iter(unit):
                if (total := costs[end + 1 - length] - self.scores[k]) < costs[end + 1]:
                    costs[end + 1], pieces[end + 1], back[end + 1] = total, k, length
        out: list[int] = []
        while n:
            out.append(pieces[n])
            n -= back[n]
        return out[::-1]

    def fallback(self, text: str) -> list[int]:
        """Ids of a character that is no piece."""
        return [self.byte_ids[b] for b in text.encode()] if self.byte_ids else [self.unknown]

    def ids_of(self, unit: str) -> list[int]:
        if len(unit) == 1 and unit not in self.ids:
            return self.fallback(unit)
        return [i for k in self.path(unit) for i in ((k,) if k < self.n_pieces else self.fallback(self.texts[k]))]

    def encode(self, text: str | None) -> np.ndarray:
        out: list[int] = []
        known = self.units
        for unit in self.unit.findall(self.normalise(text or "")):
            if (ids := known.get(unit)) is None:
                if len(known) >= self.most_units:
                    known.clear()
                ids = self.ids_of(unit)
                if len(unit) <= 64:
                    known[unit] = ids
            out += ids
        return np.frombuffer(array("i", out), np.int32)

    def decode(self, ids: list[int]) -> str:
        """The text that ids stand for; bytes that aren't UTF-8 become U+FFFD."""
        text = b"".join(map(self.written.__getitem__, ids)).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if self.prefix and text[:1] == " " else text


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _shared(docs: DataFrame, path: str | None, most_bytes: int = 16 << 20):
    with open(path or default_model(), "rb") as file:
        model = file.read(most_bytes + 1)
    if len(model) > most_bytes:
        raise ValueError(f"the model is larger than {most_bytes} bytes, which are sent to every task")
    return docs.sparkSession.sparkContext.broadcast(model)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, back: str | None = None, memories: tuple[int, int] = (250_000, 500_000)) -> DataFrame:
    """doc_id, ids (array of int), n_pieces, n_fallback (pieces that are bytes) and n_bytes of every whole text.

    path: a model file on the driver; its bytes are sent to all tasks, each of which compiles them once.
    back: the name of a further column, the text that the ids decode to, for who needs both directions: the task then
    has one machine for the two.
    memories: how many units and pairs of pieces a task remembers, some 100 bytes each; fewer take more time.
    """
    model = _shared(docs, path)

    def encoded(batches):
        machine = Machine(model.value, *memories)
        from_bytes = np.zeros(machine.n_pieces, bool)
        from_bytes[sorted(machine.byte_of)] = True
        for batch in batches:
            for at in range(0, max(1, len(batch)), 512):  # so that what is sent at once stays small
                part = batch.slice(at, 512)
                ids = [machine.encode(x.as_py()) for x in part["text"]]
                ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                arrays = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))
                fallback = [int(from_bytes[x].sum()) for x in ids]
                columns = [part["doc_id"], arrays, pa.array(map(len, ids), pa.int64()), pa.array(fallback, pa.int64()), part["n_bytes"]]
                if back:
                    columns.append(pa.array([machine.decode(x.tolist()) for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(text_col).alias("text"),
        F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes")
    )
    names = ["doc_id", "ids", "n_pieces", "n_fallback", "n_bytes", *[back] * bool(back)]
    types = [docs.schema[id_col].dataType.simpleString(), "array<int>", "long", "long", "long", "string"]
    return rows.mapInArrow(encoded, ", ".join(f"`{n}` {t}" for n, t in zip(names, types)))


def decode(encoded: DataFrame, ids_col: str = "ids", path: str | None = None, to: str = "text") -> DataFrame:
    """encoded with the column `to`: the text of ids_col."""
    model = _shared(encoded, path)

    @F.arrow_udf("string")
    def decoded(lists: Iterator[pa.Array]) -> Iterator[pa.Array]:
        machine = Machine(model.value)
        for ids in lists:
            yield pa.array([None if x is None else machine.decode(x) for x in ids.to_pylist()], pa.string())

    return encoded.withColumn(to, decoded(F.col(ids_col)))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """doc_id, counts, a hash of the ids (XXH64 of the array), and of the text that they decode to (SHA-256)."""
    both = encode(docs, id_col, text_col, path, back="text")
    return both.select(
        "doc_id",
        "n_bytes",
        "n_pieces",
        "n_fallback",
        F.xxhash64("ids").alias("ids_xxh64"),
        F.sha2("text", 256).alias("decoded_sha256")
    )
