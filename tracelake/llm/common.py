"""What several text operators share."""

import re
import tempfile
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import tracelake

#: Functions travel to executors with their code, so that these need not have the package installed.
cloudpickle.register_pickle_by_value(tracelake)

#: A run of ASCII white space; everything else belongs to words.
WHITE_SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that the cluster names. A local session may do without the setting, as in tests."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


def drop(spark: SparkSession, path: str) -> None:
    """Delete what was written to path."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written once to the shared folder; what reads it survives the loss of executors."""
    spark = df.sparkSession
    checkpoint_folder(spark)
    # Constraints that a checkpoint takes over from its plan can name columns that it doesn't have; a later self join
    # then fails to plan ("key not found").
    name = "spark.sql.constraintPropagation.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        return df.checkpoint()
    finally:
        spark.conf.set(name, before)


def scan_partitions(df: DataFrame) -> int:
    """Partitions in which df is read; it follows the size of the input."""
    return max(1, df.rdd.getNumPartitions())


def let(value: Column, body) -> Column:
    """body(value) with value computed once for a row, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


_BREAK = re.compile(r"[\x20\x09-\x0D]")


def blocks(text: str, size: int = 1 << 20) -> Iterator[str]:
    """text in pieces of about size characters that end with white space, so that words stay whole."""
    at = 0
    while len(text) - at > size:
        end = found.end() if (found := _BREAK.search(text, at + size)) else len(text)
        yield text[at:end]
        at = end
    if at < len(text) or not text:
        yield text[at:]


def words(column: Column) -> Column:
    """The words of a text: runs without ASCII white space."""
    return F.filter(F.split(column, WHITE_SPACE), lambda w: w != "")
