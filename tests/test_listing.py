"""The listing that is planned by date against the one of Spark's own reader, and the order of split event logs."""

import json

import pytest

from tracelake.sources import files
from tracelake.sources.listing import ListingReader, listing_by_date


@pytest.fixture
def tree(tmp_path):
    for dt in ("2024-01-01", "2024-01-02", "2024-01-03"):
        for workflow in ("w1", "w2"):
            for k in range(3):
                at = tmp_path / "t" / f"dt={dt}" / f"workflow_code={workflow}" / f"task{k}"
                at.mkdir(parents=True)
                (at / "a.log").write_text("x" * (k + 1))
    (tmp_path / "t" / "dt=2024-01-03" / "loose.log").write_text("12345")
    (tmp_path / "none").mkdir()
    return tmp_path


def test_rows_are_those_of_the_plain_listing(spark, tree):
    got = {(r.path, r.length) for r in listing_by_date(spark, f"{tree}/t").collect()}
    want = {(r.path.removeprefix("file:"), r.length) for r in files.listing(spark, f"{tree}/t").collect()}
    assert got == want and len(got) == 19
    assert listing_by_date(spark, f"{tree}/none").count() == 0


def test_filters_reach_the_listing(spark, tree):
    found = listing_by_date(spark, f"{tree}/t").filter("dt >= '2024-01-02' AND workflow = 'w2' AND length > 1")
    assert sorted((r.dt, r.workflow, r.length) for r in found.collect()) == [(f"2024-01-0{d}", "w2", n) for d in (2, 3) for n in (2, 3)]
    assert found.rdd.getNumPartitions() == 2
    from pyspark.sql.datasource import GreaterThan, In

    reader = ListingReader(f"file://{tree}/t")
    assert list(reader.pushFilters([In(("dt",), ("2024-01-03",)), GreaterThan(("length",), 1)])) == [GreaterThan(("length",), 1)]
    assert [x.dt for x in reader.partitions()] == ["2024-01-03"]


def test_lines_of_a_split_log_keep_their_order(spark, tmp_path):
    names = [f"e{k:04}" for k in range(3000)]
    (tmp_path / "app1.log").write_text("\n".join(json.dumps({"Event": x}) for x in names))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        events = files.event_log(spark, str(tmp_path))
        assert events.rdd.getNumPartitions() > 4
        assert [r.Event for r in events.orderBy("line_no").collect()] == names
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
