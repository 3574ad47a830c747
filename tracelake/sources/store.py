"""Tables in a shared folder that survive retries: a journal that is appended to by batches, and keyed tables with history.

Data files are written first and count only once a small file in the log names them; that file is created in one step and
never replaced. So a job that fails between the two, and is run again, leaves its rows once, and readers see whole batches.
The folder may be on any file system that Spark reaches.
"""

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.graph import checkpointed


class Folder:
    """The few operations on files that the log needs."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._files = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, folder: str) -> list[str]:
        at = self._at(folder)
        return sorted(x.getPath().getName() for x in self._files.listStatus(at) if not x.getPath().getName().startswith(".")) if self._files.exists(at) else []

    def read(self, name: str) -> str:
        stream = self._files.open(self._at(name))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Write a new file whole; False if there is one of that name already."""
        staged = self._at(f"_staged/{uuid.uuid4().hex}")
        stream = self._files.create(staged, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        self._files.mkdirs(self._at(name).getParent())
        if not self._files.exists(self._at(name)) and self._files.rename(staged, self._at(name)):
            return True
        self._files.delete(staged, False)
        return False

    def exists(self, name: str) -> bool:
        return self._files.exists(self._at(name))

    def delete(self, name: str) -> None:
        self._files.delete(self._at(name), True)


def _safe(batch: str) -> str:
    if not re.fullmatch(r"[\w.-]+", batch):
        raise ValueError(f"a batch is named by letters, digits, dots and dashes, not {batch!r}")
    return batch


class Journal:
    """Rows that jobs or micro-batches add, each batch once, whatever is run again."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.folder = spark, Folder(spark, path)

    def batches(self) -> list[str]:
        return self.folder.names("_log")

    def append(self, rows: DataFrame, batch: str, partition_by: tuple[str, ...] = ()) -> bool:
        """Add rows as a batch; False if it has been added before. What a failed attempt left is written anew."""
        if self.folder.exists(f"_log/{_safe(batch)}"):
            return False
        self.folder.delete(f"data/batch={batch}")
        rows.write.partitionBy(*partition_by).parquet(f"{self.folder.path}/data/batch={batch}")
        return self.folder.create(f"_log/{batch}", rows.schema.json())

    def read(self, batches: list[str] | None = None) -> DataFrame:
        """The rows of all batches, or of some, that have been added. All must have the same columns."""
        found = [x for x in self.batches() if batches is None or x in batches]
        if not found:
            raise ValueError("nothing has been added yet")
        schema = StructType.fromJson(json.loads(self.folder.read(f"_log/{found[-1]}")))
        base = f"{self.folder.path}/data"
        return self.spark.read.schema(schema).option("basePath", base).parquet(*(f"{base}/batch={x}" for x in found)).select(*schema.names)


class ConcurrentChange(RuntimeError):
    """Another change was made first; read again and repeat."""


class KeyedTable:
    """A row for each key, in buckets by the hash of some of its columns, with all earlier versions.

    A change writes the buckets that it touches, and then a version that names, for each bucket, the folder that holds it;
    other buckets keep their files. Versions are numbered; one that two changes want goes to the first.
    """

    def __init__(self, spark: SparkSession, path: str, key: tuple[str, ...], by: tuple[str, ...] | None = None, buckets: int = 64):
        self.spark, self.folder, self.key, self.by, self.buckets = spark, Folder(spark, path), key, by or key, buckets

    def versions(self) -> list[int]:
        return [int(x) for x in self.folder.names("_log")]

    def _log(self, version: int | None) -> dict:
        found = self.versions()
        if not found:
            return {"version": -1, "schema": None, "buckets": {}, "batches": []}
        return json.loads(self.folder.read(f"_log/{found[-1] if version is None else version:08d}"))

    def read(self, version: int | None = None) -> DataFrame:
        """The rows now, or as they were in a version."""
        log = self._log(version)
        if log["schema"] is None:
            raise ValueError("the table has no version yet")
        return self._rows(log, list(log["buckets"]))

    def _rows(self, log: dict, buckets: list[str]) -> DataFrame:
        schema = StructType.fromJson(log["schema"])
        paths = [f"{self.folder.path}/data/{log['buckets'][b]}/_bucket={b}" for b in buckets if b in log["buckets"]]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _bucket(self):
        return F.pmod(F.xxhash64(*(F.col(c).cast("string") for c in self.by)), F.lit(self.buckets)).cast("int")

    def _touched(self, rows: DataFrame) -> list[str]:
        return sorted(str(r[0]) for r in rows.select(self._bucket()).distinct().collect())

    def _commit(self, log: dict, rows: DataFrame, touched: list[str], batch: str) -> int:
        version, name = log["version"] + 1, uuid.uuid4().hex
        # A bucket that is large is written by several tasks.
        rows.withColumn("_bucket", self._bucket()).hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(f"{self.folder.path}/data/{name}")
        written = {x.split("=")[1] for x in self.folder.names(f"data/{name}") if x.startswith("_bucket=")}
        kept = {b: v for b, v in log["buckets"].items() if b not in touched}
        new = {"version": version, "schema": rows.schema.jsonValue(), "buckets": kept | dict.fromkeys(written, name), "batches": [*log["batches"], batch]}
        if not self.folder.create(f"_log/{version:08d}", json.dumps(new)):
            self.folder.delete(f"data/{name}")
            raise ConcurrentChange(f"version {version} has been written by another change")
        return version

    def merge(self, changes: DataFrame, batch: str, at: str, deleted: str | None = None) -> int | None:
        """Put changes (a row for a key, with all columns of the table) in place; None if the batch has been put before.

        Of several rows of a key the one with the greatest `at` counts, be it stored or new; of equals the greatest row, so
        that the order of changes doesn't matter. Rows with the column `deleted` true stay as marks and aren't to be read.
        """
        log = self._log(None)
        if _safe(batch) in log["batches"]:
            return None
        changes = checkpointed(changes)
        touched = self._touched(changes)
        both = changes if log["schema"] is None else self._rows(log, touched).select(*changes.columns).unionByName(changes)
        rest = [c for c in changes.columns if c not in self.key and c != at]
        last = both.groupBy(*self.key).agg(F.max(F.struct(F.col(at).alias(at), *rest)).alias("_l"))
        return self._commit(log, last.select(*self.key, "_l.*").select(*changes.columns), touched, batch)

    def replace(self, groups: DataFrame, rows: DataFrame, batch: str) -> int | None:
        """Put rows in place of all rows of groups (the columns `by`); None if the batch has been put before."""
        log = self._log(None)
        if _safe(batch) in log["batches"]:
            return None
        if log["schema"] is None:
            return self._commit(log, rows, [], batch)
        groups, rows = checkpointed(groups.select(*self.by).distinct()), checkpointed(rows)
        touched = sorted({*self._touched(groups), *self._touched(rows)})
        new = self._rows(log, touched).select(*rows.columns).join(groups, list(self.by), "left_anti").select(*rows.columns).unionByName(rows)
        return self._commit(log, new, touched, batch)
