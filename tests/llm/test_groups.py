"""Near duplicates, repeats and shards against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelake.llm import sharding
from tracelake.llm.components import components
from tracelake.llm.repeats import repeats
from tracelake.llm.sharding import shard
from tracelake.llm.simhash import fingerprint, keep_one, links, masks, near_duplicates

DOCS = "doc_id long, text string, fp string, row int"  # the last two clash with names inside the operators


def rows_of(texts):
    return [(i, t, "x", 1) for i, t in enumerate(texts)]


def union_find(n, pairs):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_masks_cover_all_pairs_within_four_bits():
    kept = [m & (1 << 64) - 1 for m in masks()]
    assert len(kept) == 31
    rnd = random.Random(1)
    for _ in range(3000):
        flips = sum(1 << b for b in rnd.sample(range(64), 4))
        assert any(m & flips == 0 for m in kept)


def near_copies(rnd, n):
    words = ["w%d" % i for i in range(300)]
    base = [[rnd.choice(words) for _ in range(120)] for _ in range(8)]
    out = [None, "", "  ", "one two", "ONE two"]
    for _ in range(n):
        x = list(rnd.choice(base))
        for _ in range(rnd.randint(0, 3)):
            x[rnd.randrange(len(x))] = rnd.choice(words)
        out.append(" ".join(x))
    return out


def test_near_duplicates_match_brute_force(spark):
    texts = near_copies(random.Random(2), 150)
    fps = [fingerprint(t) for t in texts]
    pairs = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4]
    want = union_find(len(fps), pairs)
    df = spark.createDataFrame(rows_of(texts), DOCS)
    got = {r["doc_id"]: r for r in near_duplicates(df).collect()}
    assert [got[i]["component_id"] for i in range(len(fps))] == want
    assert [got[i]["fingerprint"] for i in range(len(fps))] == [f"{x:016x}" for x in fps]
    assert got[0]["fingerprint"] == got[2]["fingerprint"] == "0" * 16
    assert got[3]["component_id"] == got[4]["component_id"] == 3
    kept = keep_one(df.unionByName(df.filter("doc_id = 3")))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want))
    assert kept.columns == df.columns


def test_large_buckets_give_the_same_groups(spark):
    values = np.unique(np.array([fingerprint(t) for t in near_copies(random.Random(3), 80)], np.uint64)).view(np.int64)
    df = spark.createDataFrame([(int(v),) for v in values], "fp long")
    groups = [sorted(map(tuple, components(links(df, 4, most)).collect())) for most in (8192, 1)]
    assert groups[0] == groups[1]


def test_components_of_a_long_chain(spark):
    edges = spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r["root"] for r in components(edges).collect()} == {0}
    assert components(edges.limit(0)).count() == 0


def brute_repeats(rows, n=50):
    first = {}
    for d, t in sorted((d, t) for d, t in rows if d is not None):
        b = (t or "").encode()
        for i in range(len(b) - n + 1):
            first.setdefault(b[i : i + n], d)
    out = Counter()
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - n + 1):
            if first.get(b[i : i + n], 1 << 62) < (1 << 62 if d is None else d):
                gone[i : i + n] = b"\1" * n
        runs = sum(1 for i in range(len(gone)) if gone[i] and (i == 0 or not gone[i - 1]))
        out[d, len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, y in zip(b, gone) if not y)).hexdigest()] += 1
    return out


@pytest.mark.parametrize("seed", [4, 5])
def test_repeats_match_brute_force(spark, seed):
    rnd = random.Random(seed)
    base = ["".join(rnd.choice("ab é") for _ in range(300)) for _ in range(3)] + ["a" * 260, "ab" * 150]
    rows = [(7, None), (8, ""), (None, base[0]), (9, "é" * 24), (10, "é" * 25), (11, "é" * 26)]
    for i in range(12, 50):
        rows.append((i // 2 * 2 if i > 44 else i, "".join(x[(o := rnd.randint(0, 200)) : o + rnd.randint(10, 200)] for x in rnd.choices(base, k=rnd.randint(0, 4)))))
    rows.append(rows[-1])
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, entries string, kind int").repartition(3)
    assert digested(repeats(df, bucket_bytes=4000, group_bytes=3000, most=20, hot=2)) == digested(repeats(df)) == brute_repeats(rows)


def digested(found):
    return Counter((r["doc_id"], r["n_bytes"], sum(s["end"] - s["start"] for s in r["spans"]), len(r["spans"]), hashlib.sha256(r["kept"]).hexdigest()) for r in found.collect())


def test_repeats_of_one_edge_with_many_contexts_and_of_a_long_text(spark):
    rnd = random.Random(14)
    noise = lambda n: "".join(rnd.choice("abcdefghijklmnop") for _ in range(n))
    edge, line = noise(50), noise(70)
    rows = [(i, noise(rnd.randint(20, 60)) + edge + noise(40) + (line if i % 3 else line[:49]) + noise(rnd.randint(0, 60))) for i in range(40)]
    long = noise(150_000)
    rows += [(100, long), (101, noise(10) + long[65_000:66_000] + noise(70_000) + line), (102, " " * 300), (103, " " * 120)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute_repeats(rows)
    assert digested(repeats(df, group_bytes=3000, bucket_bytes=2000, hot=3)) == want
    assert digested(repeats(df, hot=0)) == want


def test_repeats_of_an_empty_table(spark):
    assert repeats(spark.createDataFrame([], DOCS)).count() == 0


def test_shards_are_even_and_slots_gapless(spark):
    rnd = random.Random(6)
    texts = ["x" * rnd.randint(0, 900) + str(i) for i in range(3000)] + ["same"] * 400 + [None, ""]
    rows = shard(spark.createDataFrame(rows_of(texts), DOCS), shards=8).collect()
    assert len(rows) == len(texts)
    sizes, slots = Counter(), {}
    for r in rows:
        sizes[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
        assert r["law"] == "bytes" and r["grown_shard"] is None
    assert set(sizes) == set(range(8))
    assert max(sizes.values()) < 1.06 * min(sizes.values())
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[3400]["size"] == 16 and by_id[3400]["text_crc32"] == 0


def test_shards_without_rows_and_with_too_few(spark):
    assert shard(spark.createDataFrame([], DOCS)).count() == 0
    rows = shard(spark.createDataFrame(rows_of(["a", "a", "b"]), DOCS)).collect()
    assert len(rows) == 3 and all(0 <= r["shard"] < 40 for r in rows)


def test_shards_follow_metadata_and_keep_equal_texts_together(spark):
    rnd = random.Random(15)
    rows = [(i, "x" * rnd.randint(100, 400) + str(i), rnd.choice(["en", "de"]), rnd.choice(["web", "book", "wiki", None])) for i in range(3000)]
    copies = [(10_000 + 10 * g + k, "copy" * 30 + str(g), "en", rnd.choice(["web", "book"])) for g in range(60) for k in range(6)]
    df = spark.createDataFrame(rows + copies, "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r for r in shard(df, shards=8).collect()}
    sizes = Counter()
    for r in got.values():
        sizes[r["shard"]] += r["size"]
    mean = sum(sizes.values()) / 8
    assert all(0.94 * mean < x < 1.06 * mean for x in sizes.values()) and set(sizes) == set(range(8))
    whole = sum(len({got[10_000 + 10 * g + k]["shard"] for k in range(6)}) == 1 for g in range(60))
    assert whole == 60
    kinds = {x: {(r[2], r[3]) for r in rows if got[r[0]]["shard"] == x} for x in range(8)}
    assert sum(map(len, kinds.values())) <= 40  # of 64, were the shards made without regard to the metadata


def test_expressions_of_the_tree_do_not_grow_with_the_shards(spark):
    rnd = random.Random(5)
    df = spark.createDataFrame([(i, rnd.randint(16, 900), rnd.randint(0, 99)) for i in range(500)], "_id long, size long, text_crc32 long")
    for shards in (2, 24):
        nodes = [sharding.Node(i, i, 2) for i in range(shards)]
        for x in nodes:
            x.cut, x.left, x.right = [400, 50], sharding.Node(shards + 2 * x.id, x.first, 1), sharding.Node(shards + 2 * x.id + 1, x.first, 1)
        moved = sharding._moved(df.withColumn("node", F.lit(1)), nodes, shards, sharding._orders(["size"], ["text_crc32", "_id"]))
        assert all((r["node"] == shards + 2) == ((r["size"], r["text_crc32"]) < (400, 50)) for r in moved.collect())
        plan = moved._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("CASE") + plan.count("if (") <= 4
