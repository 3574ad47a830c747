"""Posting lists in blocks against plain lists."""

from pyspark.sql import functions as F

from tracelake.operators import postings


def test_blocks_put_together_are_the_lists(spark):
    hub = spark.range(20_000).select(F.lit("hub").alias("t"), F.format_string("m%05d", F.col("id") % 9000).alias("m"))
    few = spark.createDataFrame([("a", "y"), ("a", "x"), ("a", "x"), (None, "z"), ("none", None)], "t string, m string")
    rows = postings.posting_blocks(hub.unionByName(few), ["t"], "m", 100).collect()
    lists = {}
    for r in sorted(rows, key=lambda r: r.block):
        assert len(r.members) <= 100 and r.block == len(lists.setdefault(r.t, [])) // 100
        lists[r.t] += r.members
    assert all(r.n == len(lists[r.t]) for r in rows)
    assert lists == {"hub": [f"m{k:05}" for k in range(9000)], "a": ["x", "y"], None: ["z"]}


def test_a_member_is_found_in_its_block(spark):
    pairs = spark.range(1000).select(F.lit("t").alias("t"), F.format_string("%04d", "id").alias("m"))
    blocks = postings.posting_blocks(pairs, ["t"], "m", 64)
    assert [(r.block, r.n) for r in postings.blocks_with(blocks, "0500").collect()] == [(7, 1000)]
    assert postings.blocks_with(blocks, "none").count() == 0


def test_long_lists_and_short_ones_are_the_same(spark, monkeypatch):
    monkeypatch.setattr(postings, "MOST", 1000)
    test_blocks_put_together_are_the_lists(spark)
    pairs = spark.createDataFrame([(None, k) for k in range(1500)] + [("a", k) for k in range(1000)], "t string, m int")
    assert {(r.t, r.block, r.n, *r.members[::99]) for r in postings.posting_blocks(pairs, ["t"], "m", 1000).collect()} == {(None, 0, 1500, *range(0, 1000, 99)), (None, 1, 1500, *range(1000, 1500, 99)), ("a", 0, 1000, *range(0, 1000, 99))}


def test_short_lists_are_made_by_one_exchange(spark):
    pairs = spark.range(1000).select(F.col("id").alias("t"), F.lit("m").alias("m"))
    blocks = postings.posting_blocks(pairs, ["t"], "m", 64)
    assert blocks._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
