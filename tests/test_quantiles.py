"""Order statistics from counts, against sorting."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tracelake.operators import quantiles, runs


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    kinds = [lambda: rng.randint(-5, 5), lambda: rng.randint(1, 10**12), lambda: 0, lambda: rng.choice([None, 7, 8]), lambda: -rng.randint(1, 10**6)]
    return [(f"g{k}", kind()) for k, kind in enumerate(kinds) for _ in range(rng.choice([1, 2, 301]))] + [("none", None)] + [("g1", 10**12 + i) for i in range(500)]


def test_quantiles_are_those_of_percentile(spark, rows):
    df = spark.createDataFrame(rows, "g string, v long")
    shares = {"q0": 0.0, "q10": 0.1, "q50": 0.5, "q99": 0.99, "q100": 1.0}
    got = {r.g: r for r in quantiles.quantiles(quantiles.value_counts(df, ["g"], "v"), ["g"], shares).collect()}
    want = df.filter("v IS NOT NULL").groupBy("g").agg(*(F.percentile("v", s).alias(k) for k, s in shares.items())).collect()
    assert sorted(got) == sorted(r.g for r in want)
    for r in want:
        assert [got[r.g][k] for k in shares] == pytest.approx([r[k] for k in shares])


def test_counts_of_days_merge(spark, rows):
    days = [spark.createDataFrame(rows[k::3], "g string, v long") for k in range(3)]
    parts = [quantiles.value_counts(d, ["g"], "v") for d in days]
    whole = quantiles.value_counts(spark.createDataFrame(rows, "g string, v long"), ["g"], "v")
    assert sorted(map(str, quantiles.merged_counts(parts, ["g"]).collect())) == sorted(map(str, whole.collect()))


@pytest.mark.parametrize("most", [0, 5, 10_000])
def test_distribution_is_that_of_sorted_tasks(spark, most):
    rng = random.Random(2)
    tasks = [(f"a{s % 3}", s, rng.choice([None, 0, -1, *range(1, 60), 5000]), rng.choice([None, 0, *range(1, 30), 999])) for s in range(12) for _ in range(rng.choice([1, 2, 9, 80]))]
    tasks += [("b", 1, None, None), ("c", 1, 0, 4)]
    by = defaultdict(list)
    for app, stage, d, i in tasks:
        by[app, stage].append((d, i))
    got = {(r.app, r.stage): r for r in runs.task_distribution(spark.createDataFrame(tasks, "app string, stage int, duration long, input_bytes long"), most=most).collect()}
    assert set(got) == set(by)
    for key, rows in by.items():
        long = sorted(d for d, _ in rows if d is not None and d > 0)
        median = (long[(len(long) - 1) // 2] + long[len(long) // 2]) / 2 if long else None
        inputs = sorted(i for _, i in rows if i is not None)
        upper = inputs[len(rows) // 2] if len(inputs) > len(rows) // 2 else None
        most = max((d for d, _ in rows if d is not None), default=None)
        r = got[key]
        assert (r.n_tasks, r.median_duration, r.median_input, r.max_duration) == (len(rows), median, upper, most)
        assert r.skew_ratio == (most / median if median else None) and r.is_skewed == bool(median and most / median > 3)
        assert r.n_stragglers == sum(bool(median) and d is not None and d > 3 * median for d, _ in rows)
        assert r.n_input_skewed == sum(bool(upper) and upper > 0 and i is not None and i > 3 * upper for _, i in rows)


def test_the_plan_has_no_window_over_a_days_failures_without_a_limit(spark):
    rows = [("p", f"2024-01-0{1 + k % 2} 00:00:00", f"e{k % 3}" if k % 5 else None, f"{k:03}", "SQL") for k in range(60)]
    df = spark.createDataFrame(rows, "project string, start_time string, error_type string, id string, task_type string")
    out = runs.daily_error_metrics(df)
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()
    want = defaultdict(list)
    for _, ts, error, i, _ in rows:
        want[ts[:10], error].append(i)
    assert {(str(r.day), r.error_type): (r.n, r.examples) for r in out.collect()} == {k: (len(v), sorted(v)[:3]) for k, v in want.items()}
