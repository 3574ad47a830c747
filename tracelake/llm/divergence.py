"""How far the sources of a language differ in their words, from a sort of word-start pointers.

Each task sorts the pointers to the word starts of its texts (pointers.py). A run of equal words has its occurrences by
source and, as pointers of a run lie in the order of the rows, its number of documents. So what is shuffled are counts,
a row for each word, source and block of text at most; only counts are ever joined.

A language keeps the words that at least `least_docs` of its documents have. Probabilities, add-one smoothed over these
words, and differences are whole numbers, scaled by 1,000,000,000; divisions round down.

Defined results: null texts, languages and sources count as empty strings; a group whose documents have no kept word has
the smoothed probabilities alone; without kept words all values of a language are 0; equal values are ranked by the
item's bytes; rows with the same id are documents of their own; an empty table gives no rows; columns of the input that
aren't named are ignored.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed
from .pointers import column_bytes, cut_out, cuts, equal_runs, row_blocks, runs

#: What a probability of 1 is.
ONE = 1_000_000_000

# Bytes of words are ASCII letters and everything beyond ASCII; only A-Z are lower-cased.
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*b"abcdefghijklmnopqrstuvwxyz", *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def _counted_rows(data: np.ndarray, offsets: np.ndarray, group: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(word, group, occurrences, documents) of a block of rows; group: a number for each row."""
    by = np.argsort(group, kind="stable")
    starts, ends, rows = runs(_IN_WORD[data], offsets)
    if (by[1:] < by[:-1]).any():  # pointers by group, then by row
        place = np.empty(len(by), np.int64)
        place[by] = np.arange(len(by))
        again = np.argsort(place[rows], kind="stable")
        starts, ends, rows = starts[again], ends[again], rows[again]
    order, new = equal_runs(data, starts, ends)
    rows = rows[order]
    groups = group[rows]
    new[1:] |= groups[1:] != groups[:-1]
    first = np.flatnonzero(new)
    fresh = new.copy()
    fresh[1:] |= rows[1:] != rows[:-1]
    n = np.diff(first, append=len(order))
    docs = np.add.reduceat(fresh.astype(np.int64), first) if len(first) else n
    at = order[first]
    return cut_out(data, starts[at], ends[at]), groups[first], n, docs


def word_counts(docs: DataFrame, text_col: str = "text", by: tuple[str, ...] = ("lang", "source"), block_bytes: int = 12 << 20) -> DataFrame:
    """by columns (strings, null as ''), term, n, docs: the words of every whole text, a row for each block at most.

    Rows of a word and group are to be added up. A text larger than block_bytes is sorted in parts, and counted once.
    """

    def counted(batches):
        for batch in batches:
            row = {}  # of each group, one that has its names
            codes = np.array([row.setdefault(x, k) for k, x in enumerate(zip(*(batch[c].to_pylist() for c in by)))], np.int64)
            data, offsets = column_bytes(batch["text"])
            for at, end in row_blocks(offsets, block_bytes):
                part, group = _LOWER[data[offsets[at] : offsets[end]]], codes[at:end]
                if len(part) <= block_bytes:
                    terms, groups, n, in_docs = _counted_rows(part, offsets[at : end + 1] - offsets[at], group)
                else:
                    sums: dict[str, int] = {}
                    for a, b in cuts(_IN_WORD[part], block_bytes):
                        terms, _, n, _ = _counted_rows(part[a:b], np.array([0, b - a]), group)
                        for term, k in zip(terms.to_pylist(), n.tolist()):
                            sums[term] = sums.get(term, 0) + k
                    terms, n = pa.array(list(sums), pa.string()), np.array(list(sums.values()), np.int64)
                    groups, in_docs = np.full(len(n), group[0]), np.ones(len(n), np.int64)
                for k in range(0, len(terms), 1 << 16):
                    cut = slice(k, k + (1 << 16))
                    yield pa.RecordBatch.from_arrays([*(batch[c].take(pa.array(groups[cut])) for c in by), terms[cut], pa.array(n[cut]), pa.array(in_docs[cut])], names=[*by, "term", "n", "docs"])

    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in by]
    rows = docs.select(*named, F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(counted, ", ".join(f"{c} string" for c in by) + ", term string, n long, docs long")


def probability(count: str, total: str) -> str:
    """SQL for 1 + floor(ONE * count / total), where count <= total: three digits at a time, so that nothing overflows."""
    digits, rest = "0L", count
    for _ in range(3):
        digits, rest = f"({digits}) * 1000 + (({rest}) * 1000) div {total}", f"(({rest}) * 1000) % {total}"
    return f"{digits} + 1"


def _probabilities(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    digits, rest = np.zeros_like(count), count
    for _ in range(3):
        digits, rest = digits * 1000 + rest * 1000 // total, rest * 1000 % total
    return digits + 1


def _pair_sums(batches):
    """Of rows (lang, entries, base: totals of the language's sources), sums of (p - q)^2 / q by pair of sources.

    Sums stay in the task while they have up to 1,048,576 entries; larger matrices are handed on for each batch.
    """
    sums: dict[str, np.ndarray] = {}

    def rows(lang: str, matrix: np.ndarray):
        for a in range(0, len(matrix), max(1, (1 << 16) // len(matrix))):
            s, t = np.nonzero(matrix[a : a + max(1, (1 << 16) // len(matrix))])
            s = s + a
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(s), pa.string()), pa.array(s, pa.int32()), pa.array(t, pa.int32()), pa.array(matrix[s, t])], names=["lang", "s", "t", "value"])

    for batch in batches:
        langs, entries, base = batch["lang"].to_pylist(), batch["entries"], batch["base"]
        at = 0
        while at < len(langs):
            end = at
            while end < len(langs) and langs[end] == langs[at]:
                end += 1
            totals = base[at].values.to_numpy(zero_copy_only=False)
            step = max(1, (1 << 20) // len(totals))
            for a in range(at, end, step):
                some = entries.slice(a, min(step, end - a))
                flat, each = some.flatten(), np.diff(some.offsets.to_numpy())
                counts = np.zeros((len(some), len(totals)), np.int64)
                counts[np.repeat(np.arange(len(some)), each), flat.field("code").to_numpy()] = flat.field("n").to_numpy()
                p = np.ascontiguousarray(_probabilities(counts + 1, totals[None, :]).T)
                matrix = sums.setdefault(langs[at], np.zeros((len(totals), len(totals)), np.int64))
                for s in range(len(totals)):
                    d = p[s] - p
                    matrix[s] += (d * d // p).sum(axis=1)
                if matrix.size > 1 << 20:
                    yield from rows(langs[at], sums.pop(langs[at]))
            at = end
    for lang, matrix in sums.items():
        yield from rows(lang, matrix)


def divergence(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    least_docs: int = 3,
    top: int = 200,
    most_groups: int = 100_000,
) -> DataFrame:
    """lang, source, part, item, value, rank.

    part `pair`: every other source of the language as item, with the sum over kept words of (p - q)^2 / q, q being the
    item's. part `term`: the `top` words of the group that are more frequent there than in the language.
    Totals by group are broadcast if they are of most_groups groups at most, and joined otherwise.
    """
    named = docs.select(F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    counts = word_counts(named).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    occurring = named.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    numbered = Window.partitionBy("lang").orderBy("source")
    codes = checkpointed(occurring.withColumn("code", F.row_number().over(numbered) - 1))
    few = codes.count() <= most_groups
    sent = F.broadcast if few else lambda x: x
    entry = F.struct("code", "n")
    terms = counts.join(sent(codes), ["lang", "source"]).groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.collect_list(entry).alias("entries"))
    terms = checkpointed(terms.filter(F.col("docs") >= least_docs).select("lang", "term", "entries"))

    cells = terms.select("lang", F.explode("entries").alias("e")).select("lang", "e.code", "e.n")
    totals = cells.groupBy("lang", "code").agg(F.sum("n").alias("n"))
    sizes = terms.groupBy("lang").agg(F.count("*").alias("v"))
    groups = codes.join(totals, ["lang", "code"], "left").join(sizes, "lang", "left")
    groups = checkpointed(groups.select("lang", "source", "code", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("v", F.lit(0)).alias("v")))
    # What is divided by in each group, and in the language.
    base = groups.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("code", (F.col("n") + F.col("v")).alias("m")))).alias("g"), (F.sum("n") + F.max("v")).alias("m"))
    base = checkpointed(base.select("lang", F.transform("g", lambda x: x.m).alias("base"), "m"))

    held = terms.join(sent(base), "lang")
    sums = held.select("lang", "entries", "base").mapInArrow(_pair_sums, "lang string, s int, t int, value long").groupBy("lang", "s", "t").agg(F.sum("value").alias("value"))
    one, other = codes.select("lang", "source", F.col("code").alias("s")), codes.select("lang", F.col("source").alias("item"), F.col("code").alias("t"))
    pairs = one.join(other, "lang").filter("s != t").join(sums, ["lang", "s", "t"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("long").alias("value"))

    q = F.expr(probability("count", "m"))
    cells = held.withColumn("count", F.aggregate("entries", F.lit(0).cast("long"), lambda a, x: a + x.n) + 1)
    cells = cells.select("lang", "term", q.alias("q"), "base", F.explode("entries").alias("e"))
    cells = cells.select("lang", "term", "q", "e.code", (F.col("e.n") + 1).alias("count"), F.get("base", F.col("e.code")).alias("m"))
    cells = cells.withColumn("p", F.expr(probability("count", "m"))).filter("p > q")
    cells = cells.select("lang", "code", F.col("term").alias("item"), F.expr("((p - q) * (p - q)) div q").alias("value"))

    def ranked(rows: DataFrame, *group: str) -> DataFrame:
        return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("value"), "item")))

    # The best of each of 64 parts of a group first, so that the last ranking has few rows whatever the number of tasks.
    cells = cells.withColumn("part", F.pmod(F.xxhash64("item"), F.lit(64)))
    best = ranked(cells, "lang", "code", "part").filter(F.col("rank") <= top).drop("part", "rank")
    best = ranked(best, "lang", "code").filter(F.col("rank") <= top).join(sent(codes), ["lang", "code"])
    best = best.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    return ranked(pairs, "lang", "source").select("lang", "source", "part", "item", "value", "rank").unionByName(best)
