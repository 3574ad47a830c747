"""Listing of files under base/date/workflow/..., planned by date and done by tasks.

The driver lists the dates only; each is a partition of its own, whose task lists the workflows and all below. Filters on dt
and workflow reach the listing, so that what they leave out isn't listed.
Paths are those that pyarrow's file systems reach: local ones, and object stores and HDFS where their clients are set up.
"""

import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

import tracelake

#: Functions travel to executors with their code, so that these need not have the package installed.
cloudpickle.register_pickle_by_value(tracelake)

_TESTS = {
    EqualTo: lambda a, b: a == b,
    In: lambda a, b: a in b,
    GreaterThan: lambda a, b: a > b,
    GreaterThanOrEqual: lambda a, b: a >= b,
    LessThan: lambda a, b: a < b,
    LessThanOrEqual: lambda a, b: a <= b,
}


def _value(name: str, key: str) -> str:
    """A folder's value: what follows key=, or the whole name."""
    return re.sub(rf"^{key}=", "", name)


@dataclass
class Prefix(InputPartition):
    dt: str
    path: str


class ListingReader(DataSourceReader):
    def __init__(self, base: str):
        self.base, self.filters = base, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for x in filters:
            if type(x) in _TESTS and x.attribute in (("dt",), ("workflow",)):
                self.filters.append((x.attribute[0], type(x), x.value))
            else:
                yield x

    def _wanted(self, column: str, value: str) -> bool:
        return all(_TESTS[kind](value, other) for name, kind, other in self.filters if name == column)

    @staticmethod
    def _entries(files, path: str, recursive: bool):
        from pyarrow.fs import FileSelector

        return files.get_file_info(FileSelector(path, recursive=recursive, allow_not_found=True))

    def _files(self):
        from pyarrow.fs import FileSystem

        return FileSystem.from_uri(self.base)

    def partitions(self) -> list[Prefix]:
        files, base = self._files()
        dates = [(x, _value(x.base_name, "dt")) for x in self._entries(files, base, False) if x.type.name == "Directory"]
        return [Prefix(dt, x.path) for x, dt in sorted(dates, key=lambda x: x[1]) if self._wanted("dt", dt)] or [Prefix("", "")]

    def read(self, partition: Prefix) -> Iterator[tuple]:
        if not partition.path:
            return
        files, _ = self._files()
        for x in self._entries(files, partition.path, False):
            workflow = _value(x.base_name, "workflow_code") if x.type.name == "Directory" else ""
            if not self._wanted("workflow", workflow):
                continue
            for y in self._entries(files, x.path, True) if workflow else (x,):
                if y.type.name == "File":
                    yield y.path, y.size, y.mtime, partition.dt, workflow


class ListingSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "listing_by_date"

    def schema(self) -> str:
        return "path string, length long, modified timestamp, dt string, workflow string"

    def reader(self, schema) -> ListingReader:
        path = self.options["path"]
        return ListingReader(path if "://" in path else f"file://{path}")


def listing_by_date(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, modified, dt, workflow) of all files under path/date/workflow; workflow is empty for files that lie
    in a date's folder itself. Folders may be named by value or as key=value (dt, workflow_code)."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # Spark refuses sources that take filters without it
    spark.dataSource.register(ListingSource)
    return spark.read.format("listing_by_date").load(path)
