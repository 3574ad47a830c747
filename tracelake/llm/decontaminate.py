"""Benchmark decontamination by spaced seeds.

A mask is a row of token positions of which some are ignored ("1" counts, "0" is ignored); a seed is the hash of the
tokens that count. Training and benchmark seeds are joined; each hit fixes an alignment of a document and an item, and
around it the overlap is verified with substitutions: a segment counts if it holds enough equal tokens and is similar
enough, whatever lies around it. The masks are such that no segment that counts is missed (see covers()).

Defined results: null texts count as empty and overlap with nothing; an item of under 2 * least tokens needs its share of
equal tokens, which is a single token for an item of one or two; an item without tokens matches nothing; equal items are
reported each under its own id; repeated document rows give repeated rows; an empty table on either side gives no rows;
a null doc_id stays null in the result; columns of the inputs that aren't named are ignored.
"""

from collections.abc import Iterator
from functools import lru_cache
from math import ceil, floor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytehash import hashes_by_text, mix, token_hashes
from .common import checkpointed

#: Families of masks, the most selective first. A family serves a rule only where covers() proves it.
FAMILIES = (
    ("1111011", "1110100011", "10011111", "111101001"),
    ("111011", "11001011", "11111"),
    ("11101", "1111"),
    ("111", "1101"),
    ("11",),
    ("1",),
)
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Bits of the filter of benchmark seeds, 16 MB whatever the benchmark's size, and pairs that are looked at together.
_FILTER, _PAIRS = 1 << 27, 1 << 20
#: The most bits of a seed that a filter goes by where the benchmark is broadcast; each takes a byte, 4 MB a mask.
_BROADCAST_FILTER = 22


def needed(tokens: int, least: int, share: float) -> int:
    """Equal tokens that an overlap with an item of so many tokens needs."""
    return min(least, max(1, ceil(tokens * share)))


@lru_cache
def covers(masks: tuple[str, ...], enough: int, similar: float, far: int = 60) -> bool:
    """Whether every segment that counts holds a place where one of masks meets equal tokens only.

    The least number of unequal tokens in a segment of n tokens that escapes all masks follows from that of n - 1, for
    each state of the last tokens. It must be over what the rule allows for every n. From `far` on it is enough that it
    is over n * (1 - similar) up to twice as far, as a longer segment is made of such parts.
    """
    states = 1 << max(map(len, masks)) - 1
    windows = np.arange(2 * states)
    hit = np.zeros(2 * states, bool)
    for m in masks:
        hit |= windows & int(m, 2) == int(m, 2)
    never = 1 << 30
    escaping = np.full(states, never)
    escaping[0] = 0
    for n in range(1, 2 * far + 1):
        after = np.full(states, never)
        for equal in (0, 1):
            window = 2 * np.arange(states) + equal
            np.minimum.at(after, window % states, np.where(hit[window], never, np.minimum(escaping + 1 - equal, never)))
        escaping = after
        allowed = min(floor(n * (1 - similar) + 1e-9), n - enough)
        if 0 <= allowed >= escaping.min() or n >= far and escaping.min() <= n * (1 - similar):
            return False
    return True


def family(enough: int, similar: float) -> int:
    """The number of the most selective family that misses nothing; the last one never does."""
    return next((k for k, masks in enumerate(FAMILIES) if covers(masks, enough, similar)), len(FAMILIES) - 1)


def seeds(tokens: np.ndarray, mask: str) -> np.ndarray:
    """The hash under mask at every position of tokens."""
    out = np.full(max(0, len(tokens) - len(mask) + 1), int(mask, 2), np.uint64)
    for k, counts in enumerate(mask):
        if counts == "1":
            out = out * _STEP + tokens[k : k + len(out)]
    return mix(out)


def best_segment(equal: np.ndarray, enough: int, similar: float) -> tuple[int, int, int] | None:
    """(start, end, equal tokens) of a segment that counts, if any: of these the one with most equal tokens, then the
    shortest."""
    matched = np.concatenate([[0], np.cumsum(equal)])
    surplus = matched - similar * np.arange(len(matched))
    lowest = -np.minimum.accumulate(surplus)
    # The first start from which the segment up to each end is similar enough holds most equal tokens.
    first = np.searchsorted(lowest, -(surplus + 1e-9))
    counts = matched - matched[first]
    best = int(counts.max())
    if best < max(1, enough):
        return None
    found = []
    for end in np.flatnonzero(counts == best).tolist():
        inside = np.flatnonzero(equal[first[end] : end])
        found.append((int(inside[-1] - inside[0]) + 1, int(first[end] + inside[0])))
    size, start = min(found)
    return start, start + size, best


def overlaps(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    least: int = 10,
    similar: float = 0.8,
    share: float = 0.5,
    broadcast_items: int = 20_000,
    broadcast_bytes: int = 8 << 20
) -> DataFrame:
    """doc_id, item_id, matched_tokens, overlap_tokens, item_tokens and doc_start of every verified overlap.

    An overlap counts if `similar` of its tokens are equal and at least `least` of them, or at least `share` of the
    item if that is less. A benchmark of at most broadcast_items items and broadcast_bytes bytes is sent to all tasks and
    documents aren't shuffled; a larger one is joined with the seeds of the documents by a shuffle. The rows are the same.
    """
    items = benchmark.select(F.col(item_col).alias("item_id"), F.coalesce(F.col(item_text).cast("string"), F.lit("")).alias("item_text"))
    n, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("item_text")), F.lit(0))).first()
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if n <= broadcast_items and size <= broadcast_bytes:
        return _by_broadcast(texts, items, (least, similar, share))
    return _by_join(texts, items, (least, similar, share))


_COUNTS = ("matched_tokens", "overlap_tokens", "item_tokens", "doc_start")
_Rule = tuple[int, float, float]


def _verified(tokens: np.ndarray, item: np.ndarray, shifts, rule: _Rule) -> tuple[int, ...] | None:
    """matched, overlap and item tokens and start of the best segment that counts, over all shifts (document minus item
    position); None if there is none."""
    least, similar, share = rule
    enough, best = needed(len(item), least, share), None
    for shift in shifts:
        a, b = max(0, -shift), min(len(item), len(tokens) - shift)
        if segment := best_segment(tokens[a + shift : b + shift] == item[a:b], enough, similar):
            start, end, matched = segment
            if best is None or (matched, start - end) > best[:2]:
                best = matched, start - end, len(item), a + shift + start
    return best and (best[0], -best[1], best[2], best[3])


def _kind(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def _inside(at: np.ndarray, first: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """Those of places among the tokens of several documents where mask stays in one document, and their documents; first
    has the place of each document's first token."""
    doc = np.searchsorted(first, at, side="right") - 1
    whole = at + len(mask) <= first[doc + 1]
    return at[whole], doc[whole]


def _alignments(known: np.ndarray, of: np.ndarray, place: np.ndarray, own: np.ndarray, where: np.ndarray) -> Iterator[np.ndarray]:
    """Alignments of a document with the items whose seeds it has, as numbers: the item, then the shift, moved to be
    positive; own are seeds of the document and where are their places. Pairs of equal seeds are looked at some at a time, as a token repeated in both makes very many."""
    if not len(known):
        return
    low = np.searchsorted(known, own)
    at = np.flatnonzero(known[np.minimum(low, len(known) - 1)] == own)
    low = low[at]
    n = np.searchsorted(known, own[at], side="right") - low
    ends = np.cumsum(n)
    begin = 0
    while begin < len(at):
        end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + _PAIRS)))
        size = n[begin:end]
        rows = np.repeat(low[begin:end] - np.cumsum(size) + size, size) + np.arange(size.sum())
        yield np.unique((of[rows] << 33) + (np.repeat(where[at[begin:end]], size) - place[rows] + (1 << 32)))
        begin = end


def _by_broadcast(texts: DataFrame, items: DataFrame, rule: _Rule) -> DataFrame:
    least, similar, share = rule
    rows = items.collect()
    hashed = [token_hashes(r["item_text"].encode()) for r in rows]
    families = [family(needed(len(t), least, share), similar) for t in hashed]
    tables = []  # for each mask: the items' seeds in order, the item and the place of each, and a filter by their last bits
    for f in sorted(set(families)):
        for m in FAMILIES[f]:
            parts = [(i, seeds(t, m)) for i, t in enumerate(hashed) if families[i] == f]
            known = np.concatenate([x for _, x in parts])
            order = np.argsort(known, kind="stable")
            of, place = np.concatenate([np.full(len(x), i) for i, x in parts]), np.concatenate([np.arange(len(x)) for _, x in parts])
            passes = np.zeros(1 << min(max(16 * len(known), 1).bit_length(), _BROADCAST_FILTER), bool)
            passes[known & np.uint64(len(passes) - 1)] = True
            tables.append((m, known[order], of[order], place[order], passes))
    shared = texts.sparkSession.sparkContext.broadcast(([r["item_id"] for r in rows], hashed, tables))

    def search(batches):
        ids, hashed, tables = shared.value
        for batch in batches:
            out = []
            for row, tokens, first in hashes_by_text(batch["text"]):
                hits = []  # for each mask: documents, places and seeds
                for m, known, *_, passes in tables:
                    own = seeds(tokens, m)
                    at = np.flatnonzero(passes[own & np.uint64(len(passes) - 1)])
                    if len(at):
                        at = at[known[np.minimum(np.searchsorted(known, own[at]), len(known) - 1)] == own[at]]
                    at, docs = _inside(at, first, m)
                    hits.append((docs, at, own[at]))
                for doc in np.unique(np.concatenate([h[0] for h in hits])).tolist() if hits else ():
                    begin, found = first[doc], []
                    for (docs, at, own), (_, known, of, place, _) in zip(hits, tables):
                        some = slice(*np.searchsorted(docs, (doc, doc + 1)))
                        found += _alignments(known, of, place, own[some], at[some] - begin)
                    pairs = np.unique(np.concatenate(found))
                    numbers, shifts = pairs >> 33, (pairs & (1 << 33) - 1) - (1 << 32)
                    for i in np.unique(numbers).tolist():
                        if counts := _verified(tokens[begin : first[doc + 1]], hashed[i], shifts[numbers == i].tolist(), rule):
                            out.append((batch["doc_id"][row + doc].as_py(), ids[i], *counts))
            columns = list(zip(*out)) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(columns[0], batch.schema.field("doc_id").type),
                    pa.array(columns[1]) if out else pa.array([], item_type),
                    *(pa.array(c, pa.int64()) for c in columns[2:])
                ],
                names=["doc_id", "item_id", *_COUNTS]
            )

    item_type = items.limit(0).toArrow().schema.field("item_id").type
    return texts.mapInArrow(search, f"doc_id {_kind(texts, 'doc_id')}, item_id {_kind(items, 'item_id')}, " + ", ".join(f"{c} long" for c in _COUNTS))


def _by_join(texts: DataFrame, items: DataFrame, rule: _Rule) -> DataFrame:
    """As by broadcast, by a join of seeds. Only those seeds of documents that pass a filter of fixed size, made of all the
    items' seeds, are shuffled; a seed that many items share is still joined, once for each."""
    least, similar, share = rule
    spark = texts.sparkSession
    families = {e: family(e, similar) for e in range(1, least + 1)}
    items = items.withColumn("_item", F.monotonically_increasing_id())
    items = checkpointed(items)

    def of_items(batches):
        for batch in batches:
            for i, text in zip(batch["_item"].to_pylist(), batch["item_text"]):
                tokens = token_hashes(text.as_py().encode())
                for m in FAMILIES[families[needed(len(tokens), least, share)]]:
                    own = seeds(tokens, m).view(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(own), pa.array(np.full(len(own), i)), pa.array(np.arange(len(own))), pa.array(np.full(len(own), int(m, 2)))],
                        names=["seed", "_item", "place", "mask"]
                    )

    right = checkpointed(items.select("_item", "item_text").mapInArrow(of_items, "seed long, _item long, place long, mask long"))
    used = [f"{r[0]:b}" for r in right.select("mask").distinct().collect()]
    bit = F.expr("shiftleft(1L, CAST(seed & 63 AS INT))")
    word = F.pmod(F.shiftrightunsigned("seed", 6), F.lit(_FILTER // 64))
    words = right.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    bits = np.zeros(_FILTER // 64, np.int64)
    bits[words["word"].to_numpy()] = words["bits"].to_numpy()
    shared = spark.sparkContext.broadcast(bits.view(np.uint64))

    def of_docs(batches):
        bits = shared.value
        for batch in batches:
            rows = batch["_row"].to_numpy()
            for row, tokens, first in hashes_by_text(batch["text"]):
                for m in used:
                    own = seeds(tokens, m)
                    at = np.flatnonzero(bits[(own >> np.uint64(6)) % np.uint64(len(bits))] >> (own & np.uint64(63)) & np.uint64(1))
                    at, docs = _inside(at, first, m)
                    if len(at):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(rows[row + docs]), pa.array(own[at].view(np.int64)), pa.array(at - first[docs])],
                            names=["_row", "seed", "at"]
                        )

    rows = checkpointed(texts.withColumn("_row", F.monotonically_increasing_id()))
    left = rows.select("_row", "text").mapInArrow(of_docs, "_row long, seed long, at long")
    aligned = left.join(right, "seed").select("_row", "_item", (F.col("at") - F.col("place")).alias("shift")).distinct()
    shifts = aligned.groupBy("_row", "_item").agg(F.collect_list("shift").alias("shifts"))

    @F.arrow_udf(", ".join(f"{c} long" for c in _COUNTS))
    def verified(text: pa.Array, item: pa.Array, moved: pa.Array) -> pa.Array:
        out = [
            _verified(
                token_hashes(a.as_py().encode()),
                token_hashes(b.as_py().encode()),
                sorted(c.as_py()),
                rule
            ) or (None,) * 4 for a, b, c in zip(text, item, moved)
        ]
        return pa.StructArray.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(4)], list(_COUNTS))

    found = rows.join(shifts, "_row").join(items, "_item").select("doc_id", "item_id", verified("text", "item_text", "shifts").alias("v"))
    return found.select("doc_id", "item_id", "v.*").filter("matched_tokens IS NOT NULL")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without those that overlap with an item of the benchmark. Documents go by their ids; those without one stay."""
    leaked = checkpointed(overlaps(docs, benchmark, id_col, text_col).select(F.col("doc_id").alias(id_col)).distinct())
    return docs.join(leaked, id_col, "left_anti")
