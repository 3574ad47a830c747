"""Near duplicates by SimHash fingerprints and covering locality-sensitive hashing.

Fingerprints link if they differ in at most `radius` bits. Bit i of a fingerprint carries a vector m(i) of radius + 1
bits; for every non-zero vector v, the mask of v keeps the bits i with an odd number of ones in m(i) & v. For any
`radius` bits there is a v that keeps none of them (fewer equations than unknowns), so that each linked pair agrees
under at least one of the 2 ** (radius + 1) - 1 masks, and no pair is lost.

Defined results: a null text counts as empty; texts without words have fingerprint zero and are linked with one
another; repeated rows are copies of one another; a null doc_id gets the smallest doc_id of its group, if there is one;
an empty table gives no rows; columns of the input that aren't named are ignored.
"""

from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, checkpointed
from .components import components

_digest = partial(xxhash.xxh64_intdigest, seed=42)


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """The 64-bit SimHash of a whole text; see near_duplicates()."""
    counts, total, rest = np.zeros(64, np.int64), 0, []
    for block in blocks(text or ""):
        words = rest + block.encode().lower().split()
        if len(words) >= shingle:
            hashes = np.fromiter(map(_digest, map(b" ".join, zip(*(words[k:] for k in range(shingle))))), np.uint64)
            counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            total += len(hashes)
        rest = words[-(shingle - 1) :] if shingle > 1 else []
    if not total:
        return _digest(b" ".join(rest)) if rest else 0
    return int.from_bytes(np.packbits(2 * counts > total, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, carried: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp): the fingerprint of every whole text, as a signed long; the columns `carried` come along."""

    @F.arrow_udf("long")
    def simhash(texts: pa.Array) -> pa.Array:
        found = np.fromiter((fingerprint(x.as_py(), shingle) for x in texts), np.uint64, len(texts))
        return pa.array(found.view(np.int64))

    return docs.select(F.col(id_col).alias("doc_id"), simhash(F.col(text_col)).alias("fp"), *carried)


def masks(radius: int = 4, bits: int = 64) -> list[int]:
    """The masks of the covering family, as signed longs."""
    n = 2 ** (radius + 1) - 1
    carried = [i % n + 1 for i in range(bits)]
    found = [sum(1 << i for i, m in enumerate(carried) if (m & v).bit_count() % 2) for v in range(1, n + 1)]
    return [x - (1 << 64) if x >> 63 else x for x in found]


def forest(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges that connect what linked pairs of values connect: at most one fewer than there are values."""
    left, edges = np.arange(len(values)), []
    while len(left):  # breadth-first from the first that isn't reached
        reached, left = left[:1], left[1:]
        while len(reached) and len(left):
            near = np.zeros(len(left), bool)
            source = np.zeros(len(left), np.int64)
            for k in reached:
                hit = ~near & (np.bitwise_count(values[left] ^ values[k]) <= radius)
                source[hit] = k
                near |= hit
            edges += zip(source[near].tolist(), left[near].tolist())
            reached, left = left[near], left[~near]
    signed = values.view(np.int64)
    return [(int(signed[a]), int(signed[b])) for a, b in edges]


def links(values: DataFrame, radius: int = 4, most: int = 8192) -> DataFrame:
    """Edges (a, b) that connect the distinct longs in column fp as all pairs within radius do, without all pairs.

    The members of a bucket with at most `most` values are compared in one task. For the values of larger buckets, two
    are within radius exactly if some value is within half the radius of both (for an even radius), so each is joined
    with all values that near, and the ones that meet there are linked with the smallest; this has no quadratic part.
    """
    if radius % 2:
        raise ValueError("radius must be even")
    rows = values.select(
        "fp",
        F.posexplode(F.array(*map(F.lit, masks(radius)))).alias("t", "mask")
    ).select("t", F.col("mask").bitwiseAND(F.col("fp")).alias("key"), "fp")
    sizes = rows.groupBy("t", "key").agg(F.count("*").alias("n")).filter("n > 1")
    shared = checkpointed(rows.join(sizes, ["t", "key"]))

    @F.arrow_udf("array<struct<a: long, b: long>>")
    def compared(lists: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
        found = [forest(np.sort(x.values.to_numpy(zero_copy_only=False)).view(np.uint64), radius) for x in lists]
        return pa.array([[{"a": a, "b": b} for a, b in x] for x in found], kind)

    small = shared.filter(F.col("n") <= most).groupBy("t", "key").agg(F.collect_list("fp").alias("fps"))
    near = small.select(F.explode(compared("fps")).alias("e")).select("e.a", "e.b").distinct()
    flips = [sum(1 << i for i in c) for k in range(radius // 2 + 1) for c in combinations(range(64), k)]
    flips = F.array(*(F.lit(x - (1 << 64) if x >> 63 else x) for x in flips))
    hot = shared.filter(F.col("n") > most).select("fp").distinct()
    if not hot.isEmpty():
        around = hot.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("hub"))
        least = around.groupBy("hub").agg(F.min("fp").alias("b"), F.count("*").alias("n")).filter("n > 1").drop("n")
        near = near.unionByName(around.join(least, "hub").filter("fp != b").select(F.col("fp").alias("a"), "b").distinct())
    return near


def _grouped(fps: DataFrame, radius: int) -> DataFrame:
    """(fp, keeper): every distinct fingerprint of fps and the least row of all that are linked with it.

    fps has fp and the struct `row`, whose order says which row of a group is the least. The result is checkpointed, so
    that a join with it reads a plain exchange on both sides, and Spark can split the copies of a hot fingerprint.
    """
    reps = checkpointed(fps.groupBy("fp").agg(F.min("row").alias("rep")))
    roots = checkpointed(components(links(reps.select("fp"), radius)).withColumnRenamed("node", "fp"))
    least = roots.join(reps, "fp").groupBy("root").agg(F.min("rep").alias("keeper"))
    linked = roots.join(least, "root").select("fp", "keeper")
    return checkpointed(reps.join(linked, "fp", "left").select("fp", F.coalesce("keeper", "rep").alias("keeper")))


def _row(doc_id: str) -> Column:
    """Rows with the smallest id come first, rows without one last."""
    return F.struct(F.col(doc_id).isNull().alias("without"), F.col(doc_id).alias("doc_id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id reachable by links) of each document.

    A-Z are lower-cased; words are runs without ASCII white space; shingles are `shingle` words joined by a space,
    repeats included (a shorter text is one shingle); each is hashed by XXH64 with seed 42, and a bit of the
    fingerprint is set if it is set in over half the hashes. Equal fingerprints are reduced to one before the search.
    """
    fps = checkpointed(fingerprints(docs, id_col, text_col, shingle))
    found = _grouped(fps.select("fp", _row("doc_id").alias("row")), radius)
    return fps.join(found, "fp").select(
        "doc_id",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("keeper.doc_id").alias("component_id")
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group of near duplicates: that with the smallest id; of equal ids, and where no document has
    an id, that with the smallest hash of its text. Repeated rows (id and text) become one.

    Ids and hashes decide; texts are shuffled once, to meet the verdict.
    """
    text_hash = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    marked = docs.select(id_col, text_col, text_hash.alias("_h"))
    fps = checkpointed(fingerprints(marked, id_col, text_col, carried=("_h",)).groupBy("doc_id", "_h", "fp").agg(F.count("*").alias("n")))
    row = _row("doc_id").withField("h", F.col("_h")).withField("n", F.col("n"))
    kept = _grouped(fps.select("fp", row.alias("row")), 4).select("keeper.*").distinct()
    kept = checkpointed(kept.select(F.col("doc_id").alias("_kept"), F.col("h").alias("_kept_h"), (F.col("n") > 1).alias("_again")))
    joined = docs.join(kept, docs[id_col].eqNullSafe(kept["_kept"]) & (text_hash == kept["_kept_h"]))
    once = joined.filter("NOT _again").select(docs.columns)
    return once.unionByName(joined.filter("_again").select(docs.columns).dropDuplicates([id_col, text_col]))
