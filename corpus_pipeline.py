"""A training corpus from documents, stage by stage: each stage reads what the one before it has written.

All stages take an empty table and give one, and leave out columns that documents doesn't have, whatever their names.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm import pieces
from tracelake.llm.common import checkpoint_folder, drop, table
from tracelake.llm.decontaminate import drop_contaminated
from tracelake.llm.langid import keep_identified
from tracelake.llm.pii import redact
from tracelake.llm.simhash import keep_one

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters or with an uncertain language go; so do null and empty texts, which have no letters.

    The model is learned from the rows that have a lang; where none has one, nothing can be learned and all documents go.
    Repeated rows are judged alike.
    """
    return keep_identified(docs).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the document with the smallest id stays; repeated rows become one.

    Null, empty and wordless texts form one group. A group in which no document has an id keeps the one with the smallest
    hash of its text.
    """
    return keep_one(docs).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with the benchmark go, with all rows of their ids; documents without an id stay, as do null
    and empty texts. An empty benchmark takes nothing away."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to placeholders; n_chars follows the text. A null text stays null, with n_chars null."""
    cleaned = redact(docs)
    return cleaned.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def sentence_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, counts, and the hash of the text that the ids decode to. Null and empty texts have no ids.

    Tasks remember less than they do where they have the executors to themselves.
    """
    encoded = pieces.encode(docs, back="_back", memories=(100_000, 100_000))
    return encoded.select("doc_id", "ids", "n_pieces", "n_fallback", F.sha2("_back", 256).alias("decoded_sha256"))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("sentence_pieces", sentence_pieces),
]

#: Fingerprints, disguises and piece lattices are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What each stage returns is written as Parquet in the cluster's checkpoint folder, and goes
    when the next stage has been written."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            drop(spark, f"{folder}/{k - 1}")
    return docs
