"""Spelling variants of a vocabulary, by composing its acceptor with a one-edit transducer and the acceptor again.

The words of the vocabulary make a minimised deterministic acceptor. In the composition acceptor - one edit - acceptor a
state is (p, edits so far, q). Before the edit both sides have read the same, so p is q; the edit replaces, deletes or
inserts one letter; after it both read the same again, down to two final states. Where a letter of a run of equal ones
is deleted, only the last counts, so that each pair is accepted along one path.

The composition is enumerated in partitions by what is read first. Two words of six letters or more that are one edit
apart share their first three letters or, read backwards, their first three. So each word enters two partitions, one in
either direction, and the second leaves out the pairs of the first. A partition with too many words is cut further: its
pairs that share one more letter go to partitions by that letter, its pairs that differ just there are those with the
same rest, which are found by grouping. Pairs never leave a task: it sums them up to a row for each word.

Defined results: null texts have no words, a null id is written as an empty string, rows with the same id are read each
on its own, and an empty table gives no rows; ties between forms go to the first in the order of code points; columns of
the input that aren't named are ignored.
"""

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed
from .pointers import column_bytes, cut_out, cuts, equal_runs, row_blocks, runs

#: Letters that two near words share at one of their ends; words have twice as many at least.
SHARED = 3

_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_CRC = np.array([reduce(lambda x, _: x >> 1 ^ (0xEDB88320 if x & 1 else 0), range(8), k) for k in range(256)], np.uint32)


def _letters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of letters (A-Z, a-z and U+00C0 to U+00FF, which are 0xC3 and one more byte), and those second bytes."""
    second = np.zeros(len(data), bool)
    second[1:] = data[:-1] == 0xC3
    return _ASCII_LETTER[data] | (data == 0xC3) | second, second


def _crc32(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray) -> np.ndarray:
    """CRC-32 of the words at these pointers; before: the CRC-32 of what comes before each."""
    state, length, alive = before.astype(np.uint32) ^ np.uint32(0xFFFFFFFF), ends - starts, np.arange(len(starts))
    for k in range(min(int(length.max(initial=0)), 64)):
        alive = alive[length[alive] > k]
        was = state[alive]
        state[alive] = _CRC[(was ^ data[starts[alive] + k]) & np.uint32(255)] ^ was >> np.uint32(8)
    out = state ^ np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(length > 64):
        out[i] = zlib.crc32(data[starts[i] : ends[i]].tobytes(), int(before[i]))
    return out


def _block(data: np.ndarray, offsets: np.ndarray, ids: list[str], one_in: int, shortest: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    inside, second = _letters(data)
    starts, ends, rows = runs(inside, offsets)
    twice = np.concatenate([[0], np.cumsum(second)])
    points = ends - starts - (twice[ends] - twice[starts])
    some = points >= shortest
    starts, ends, rows, points = starts[some], ends[some], rows[some], points[some]
    data = _LOWER[data]
    heads = np.array([zlib.crc32(f"{x}:".encode()) for x in ids], np.uint32)
    crc = _crc32(data, starts, ends, heads[rows])
    hit = crc % one_in == 0
    changed: dict[str, int] = {}
    for i in np.flatnonzero(hit & (points > shortest)):
        word, at = data[starts[i] : ends[i]].tobytes().decode(), int(crc[i]) % int(points[i])
        word = word[:at] + word[at + 1 :]
        changed[word] = changed.get(word, 0) + 1
    starts, ends = starts[~hit], ends[~hit]
    order, new = equal_runs(data, starts, ends)
    first = np.flatnonzero(new)
    yield cut_out(data, starts[order[first]], ends[order[first]]), np.diff(first, append=len(order))
    yield pa.array(list(changed), pa.string()), np.array(list(changed.values()), np.int64)


def vocabulary(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    one_in: int = 199,
    shortest: int = 2 * SHARED,
    least: int = 5,
    block_bytes: int = 12 << 20,
) -> DataFrame:
    """(word, n): words of at least `shortest` letters that occur at least `least` times.

    A run of letters is lower-cased (A-Z); if one_in divides the CRC-32 of '<id>:<run>', a letter is taken out of it.
    """

    def counted(batches):
        for batch in batches:
            data, offsets = column_bytes(batch["text"])
            ids = batch["id"].to_pylist()
            for at, end in row_blocks(offsets, block_bytes):
                part, places = data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
                ranges = [(0, len(part))] if len(part) <= block_bytes else cuts(_letters(part)[0], block_bytes)
                for a, b in ranges:
                    for words, n in _block(part[a:b], places if len(part) <= block_bytes else np.array([0, b - a]), ids[at:end], one_in, shortest):
                        for k in range(0, len(words), 1 << 16):
                            yield pa.RecordBatch.from_arrays([words[k : k + (1 << 16)], pa.array(n[k : k + (1 << 16)])], names=["word", "n"])

    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


class Acceptor:
    """The minimised deterministic acceptor of sorted, different words.

    arcs: a dictionary for each state; 0 is the start. low: the fewest letters to a final state (not kept for the start).
    """

    def __init__(self, words: list[str]):
        self.arcs, self.final, self.low = [{}], [False], [0]
        known: dict[tuple, int] = {}
        path, before = [0], ""

        def settle(depth: int) -> None:
            """States of the last word below depth won't change: each gives way to an equal one, if there is one."""
            while len(path) - 1 > depth:
                state = path.pop()
                self.low[state] = 0 if self.final[state] else 1 + min(self.low[to] for to in self.arcs[state].values())
                same = known.setdefault((self.final[state], *self.arcs[state].items()), state)
                if same != state:
                    self.arcs[path[-1]][before[len(path) - 1]] = same

        for word in words:
            shared, most = 0, min(len(word), len(before))
            while shared < most and word[shared] == before[shared]:
                shared += 1
            settle(shared)
            for letter in word[shared:]:
                self.arcs.append({})
                self.final.append(False)
                self.low.append(0)
                self.arcs[path[-1]][letter] = len(self.arcs) - 1
                path.append(len(self.arcs) - 1)
            self.final[path[-1]] = True
            before = word
        settle(0)
        self._meet: dict[tuple[int, int], bool] = {}
        self._edits: dict[int, list] = {}

    def meets(self, p: int, q: int) -> bool:
        """Do p and q accept a common rest?"""
        if p == q:
            return True
        if (found := self._meet.get((p, q))) is not None:
            return found
        seen, todo = {(p, q)}, [(p, q)]
        while todo:
            a, b = todo.pop()
            if a == b or self.final[a] and self.final[b] or self._meet.get((a, b)):
                self._meet[p, q] = True
                return True
            other = self.arcs[b]
            for letter, to in self.arcs[a].items():
                if letter in other and (step := (to, other[letter])) not in seen and self._meet.get(step) is not False:
                    seen.add(step)
                    todo.append(step)
        self._meet.update(dict.fromkeys(seen, False))
        return False

    def common(self, p: int, q: int, most: float) -> Iterator[str]:
        """The rests of at most `most` letters that p and q both accept."""
        todo = [(p, q, "")]
        while todo:
            a, b, rest = todo.pop()
            if self.final[a] and self.final[b]:
                yield rest
            if len(rest) == most:
                continue
            other = self.arcs[b]
            todo += [(to, other[c], rest + c) for c, to in self.arcs[a].items() if c in other and self.meets(to, other[c])]

    def edits(self, p: int) -> list[tuple[str, str, int, int]]:
        """Ways to make the edit in p: what one and the other side read at once, and the two states after it."""
        if (found := self._edits.get(p)) is None:
            out = list(self.arcs[p].items())
            found = [(a, b, to, other) for k, (a, to) in enumerate(out) for b, other in out[k + 1 :] if self.meets(to, other)]
            for a, to in out:
                if self.final[p] and self.final[to]:
                    found.append((a, "", -1, -1))
                after = self.arcs[to]
                found += [(a + c, c, after[c], other) for c, other in out if c != a and c in after and self.meets(after[c], other)]
            self._edits[p] = found
        return found

    def pairs(self, depth: int, most: float = float("inf")) -> Iterator[tuple[str, str]]:
        """Accepted pairs whose edit comes after the first depth letters, each once; those with more than `most` letters
        after the edit may be left out."""
        todo, path = [(0, 0, "")], []
        while todo:
            state, at, letter = todo.pop()
            del path[max(0, at - 1) :]
            path += letter
            if at >= depth and self.low[state] <= most + 1 and (found := self.edits(state)):
                head = "".join(path)
                for a, b, p, q in found:
                    for rest in self.common(p, q, most) if p >= 0 else ("",):
                        yield head + a + rest, head + b + rest
            todo += [(to, at + 1, c) for c, to in self.arcs[state].items()]


_NEAR = "word string, n_near long, best_n long, best string"


def _summed(groups: Iterator[tuple[bool, str, list[str], list[int]]]) -> Iterator[pa.RecordBatch]:
    """The near words of each word of a partition, summed up."""
    for backwards, key, words, counts in groups:
        if len(words) < 2:
            continue
        n, near = dict(zip(words, counts)), {}
        for a, b in Acceptor(words).pairs(len(key), SHARED - 1 if backwards else float("inf")):
            if backwards and a[: -SHARED - 1 : -1] == b[: -SHARED - 1 : -1]:
                continue
            for x, y in ((a, b), (b, a)):
                old = near.get(x)
                this = (-n[y], y[::-1] if backwards else y)
                near[x] = (old[0] + 1, min(old[1], this)) if old else (1, this)
        turned = [x[::-1] for x in near] if backwards else list(near)
        columns = [turned, [x[0] for x in near.values()], [-x[1][0] for x in near.values()], [x[1][1] for x in near.values()]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["word", "n_near", "best_n", "best"])


def _accepted(batches) -> Iterator[pa.RecordBatch]:
    """Rows (backwards, key, word, n) in order; partitions are put together from neighbouring rows."""

    def groups():
        at, words, counts = None, [], []
        for batch in batches:
            for *key, word, n in zip(*(batch[c].to_pylist() for c in ("backwards", "key", "word", "n"))):
                if key != at:
                    if at:
                        yield *at, words, counts
                    at, words, counts = key, [], []
                words.append(word)
                counts.append(n)
        if at:
            yield *at, words, counts

    return _summed(groups())


def _just_here(rows: DataFrame, depth: int) -> DataFrame:
    """Near words whose edit comes right after the first depth letters: both have the same rest after it."""
    word = F.col("word")
    cut = rows.filter(F.length(word) > depth).select("backwards", "key", word.substr(F.lit(depth + 2), F.length(word)).alias("rest"), "word", "n", F.lit(True).alias("cut"))
    whole = rows.select("backwards", "key", word.substr(F.lit(depth + 1), F.length(word)).alias("rest"), "word", "n", F.lit(False).alias("cut"))
    # At most one word for each letter, and one without.
    met = cut.unionByName(whole).groupBy("backwards", "key", "rest").agg(F.collect_list(F.struct("word", "n", "cut")).alias("all")).filter(F.size("all") > 1)
    met = met.select("backwards", "all", F.explode("all").alias("one"))

    def last_of_run(x: Column) -> Column:
        return F.substring(x, depth + 1, 1) != F.substring(x, depth + 2, 1)

    def near(x: Column) -> Column:
        one = F.col("one")
        edit = F.when(one.cut & x.cut, one.word != x.word).when(one.cut, last_of_run(one.word)).when(x.cut, last_of_run(x.word)).otherwise(False)
        left_out = F.col("backwards") & (F.substring(F.reverse(one.word), 1, SHARED) == F.substring(F.reverse(x.word), 1, SHARED))
        return edit & ~left_out & (one.word != x.word)

    turned = lambda x: F.when(F.col("backwards"), F.reverse(x)).otherwise(x)
    met = met.withColumn("near", F.filter("all", near)).filter(F.size("near") > 0)
    best = F.array_min(F.transform("near", lambda x: F.struct((-x.n).alias("less"), turned(x.word).alias("word"))))
    return met.select(turned(F.col("one.word")).alias("word"), F.size("near").cast("long").alias("n_near"), best.alias("best")).select("word", "n_near", (-F.col("best.less")).alias("best_n"), F.col("best.word").alias("best"))


def near_words(words: DataFrame, most: int = 50_000, each: int = 20_000) -> DataFrame:
    """(word, n_near, best_n, best) of each word of (word, n) that has near words; best: the most frequent of them.

    words must be cheap to read again (a checkpoint or a table). most: words of a partition of the composition; each:
    words of a task, about.
    """
    tasks = max(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * words.count() // each)
    both = words.withColumn("backwards", F.lit(False)).unionByName(words.select(F.reverse("word").alias("word"), "n", F.lit(True).alias("backwards")))
    done, depth = [], SHARED
    while True:
        both = both.withColumn("key", F.substring("word", 1, depth))
        large = checkpointed(both.groupBy("backwards", "key").agg(F.count("*").alias("_k")).filter(F.col("_k") > most).drop("_k"))
        n_large = large.count()
        sent = F.broadcast(large) if n_large <= 20_000 else large
        small = both.join(sent, ["backwards", "key"], "left_anti") if n_large else both
        dealt = small.select("backwards", "key", "word", "n").repartition(tasks, "backwards", "key").sortWithinPartitions("backwards", "key", "word")
        done.append(dealt.mapInArrow(_accepted, _NEAR))
        if not n_large:
            break
        both = checkpointed(both.join(sent, ["backwards", "key"], "left_semi"))
        done.append(_just_here(both, depth))
        both, depth = both.filter(F.length("word") > depth), depth + 1
    found = reduce(DataFrame.unionByName, done)
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word")))
    found = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    return found.select("word", "n_near", (-F.col("best.less")).alias("best_n"), F.col("best.word").alias("best"))


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", times: int = 5, most: int = 50_000, least: int = 5) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the vocabulary.

    form: the most frequent near word, if it is at least `times` as frequent. root: where the forms lead to.
    """
    words = checkpointed(vocabulary(docs, id_col, text_col, least=least))
    found = words.join(near_words(words, most), "word", "left")
    has = F.col("best_n") >= times * F.col("n")
    found = checkpointed(found.select("word", F.when(has, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has, F.col("best_n")).alias("form_n")))
    # A word's way to its root is halved in each round.
    ways = checkpointed(found.filter("form IS NOT NULL").select("word", F.col("form").alias("root")))
    while True:
        further = ways.join(ways.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left")
        further = checkpointed(further.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        moved = not further.filter("moved").isEmpty()
        ways = further.drop("moved")
        if not moved:
            break
    return found.join(ways, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
