"""Error blocks and gaps in ranges against a plain reading line by line."""

import random

import pytest
from pyspark.sql import functions as F

from tracelake.operators import logs

LINES = {
    "blank": ["", "  \t"],
    "start": ["ERROR one", "java.io.IOException: disk", "ls: x: No such file"],
    "hard": ["Table x doesn't", "Caused by: nothing known"],
    "soft": ["at a.b(C.java:1)", "File x", "More"],
    "other": ["INFO fine", "12 rows"],
    "late": ["Caused by: an Exception", "Caused by: ERROR"],
}


def plain(kinds, most=30):
    """(first line, lines) of the blocks of a log whose lines are of these kinds."""
    blocks, open_, seen, absorbing = [], False, 0, False
    for no, kind in enumerate(kinds, 1):
        if kind == "start" or kind == "late" and not open_:
            blocks.append([no])
            open_, seen, absorbing = True, 1, False
        elif kind == "blank":
            open_ = absorbing = False
        elif not open_:
            continue
        elif absorbing:
            if kind in ("hard", "late"):
                blocks[-1].append(no)
        elif kind == "other":
            if seen >= most:
                absorbing = True
            else:
                open_ = False
        else:
            seen += 1
            if kind != "soft" or seen <= most:
                blocks[-1].append(no)
    return [(x[0], x) for x in blocks]


@pytest.fixture(scope="module")
def random_logs():
    rng = random.Random(5)
    out = {}
    for k in range(40):
        weights = rng.choice([(1, 1, 2, 9, 1, 1), (1, 3, 3, 3, 1, 2), (0.1, 0.5, 5, 20, 0.7, 1), (1, 1, 1, 1, 1, 1), (0, 0.1, 1, 9, 1, 1)])
        out[f"log{k}"] = rng.choices(list(LINES), weights, k=rng.choice([0, 1, 2, 50, 200]))
    out["giant"] = rng.choices(list(LINES), (0.1, 0.3, 5, 20, 0.4, 1), k=5000)
    return out


@pytest.fixture(scope="module")
def rows(spark, random_logs):
    rng = random.Random(6)
    data = [(log, no, rng.choice(LINES[k])) for log, kinds in random_logs.items() for no, k in enumerate(kinds, 1)]
    rng.shuffle(data)
    return spark.createDataFrame(data, "log_id string, line_no int, line string")


@pytest.mark.parametrize("per_range", [1, 3, 64, 100_000])
def test_blocks_are_those_of_a_plain_reading(rows, random_logs, per_range):
    text = {(r.log_id, r.line_no): r.line for r in rows.collect()}
    want = sorted((log, pos, "\n".join(text[log, n] for n in numbers)) for log, kinds in random_logs.items() for pos, numbers in plain(kinds))
    got = sorted((r.log_id, r.pos, r.block) for r in logs.error_blocks(rows, per_range=per_range).collect())
    assert got == want
    assert any(len(x[2].split("\n")) > 30 for x in want)


def test_no_log_means_no_block(spark):
    empty = spark.createDataFrame([], "log_id string, line_no int, line string")
    assert logs.error_blocks(empty).collect() == []
    one = spark.createDataFrame([(None, 1, "ERROR"), (None, 2, "at x"), ("a", 1, None), ("a", 2, "ERROR")], "log_id string, line_no int, line string")
    assert sorted((str(r.log_id), r.pos, r.block) for r in logs.error_blocks(one, per_range=1).collect()) == [("None", 1, "ERROR\nat x"), ("a", 2, "ERROR")]


def test_a_giant_log_is_spread(spark):
    """One log of a hundred times the lines of all others: no row of ranges is over the bound."""
    from tracelake.operators import segments

    lines = spark.range(60_000).select(
        F.when(F.col("id") < 59_400, F.lit(-1)).otherwise(F.col("id")).cast("string").alias("log_id"), (F.col("id") + 1).alias("line_no"), F.lit(segments.SOFT).alias("kind"), F.lit("at x").alias("line")
    )
    seen = []
    real = segments.checkpointed
    segments.checkpointed = lambda df: seen.append(real(df)) or seen[-1]
    try:
        assert segments.block_lines(lines, 30, 500).count() == 0
    finally:
        segments.checkpointed = real
    sizes = [r[0] for r in seen[0].filter("log_id = '-1'").select(F.size("cells")).collect()]
    assert len(sizes) >= 118 and max(sizes) <= 500
    by_task = [r[0] for r in seen[0].groupBy(F.spark_partition_id()).agg(F.sum(F.size("cells"))).select("sum(size(cells))").collect()]
    assert max(by_task) <= 2 * sorted(by_task)[len(by_task) // 2]


@pytest.mark.parametrize("per_range", [1, 7, 100_000])
def test_gaps_are_those_between_neighbours(spark, per_range):
    rng = random.Random(7)
    data, want = [], []
    for log in "abc":
        t, before = 0, None
        for no in range(1, 120):
            t += rng.choice([10, 60, 400, 900])
            stamp = None if rng.random() < 0.4 else t
            data.append((log, no, stamp))
            if stamp is not None:
                if before is not None and stamp - before > 300:
                    want.append((log, before, stamp))
                before = stamp
    rng.shuffle(data)
    stamped = spark.createDataFrame(data, "log_id string, line_no int, t long").select("log_id", "line_no", F.timestamp_seconds("t").alias("ts"))
    got = [(r.log_id, int(r.a), int(r.b)) for r in logs.silent_periods(stamped, 5, per_range).select("log_id", F.unix_seconds("from_ts").alias("a"), F.unix_seconds("to_ts").alias("b")).collect()]
    assert sorted(got) == sorted(want)
