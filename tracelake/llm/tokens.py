"""Token counts of whole texts, in which a huge document is counted in overlapping chunks by many tasks.

A text of up to `chunk` characters is encoded as it is. A longer one is cut into chunks that overlap; each is encoded
on its own, with offsets. Two neighbours are spliced at a boundary that both show in the overlap: the start of a unit
of the pre-tokeniser. From there on both read the same characters from the same state, so that the later chunk's units
are the document's, if the earlier chunk's are up to there. The last units of a chunk are left out, as they may end
where the chunk was cut. If neighbours share no boundary, the document is encoded again with wider overlaps; at last
in one piece.

A byte-level tokenizer encodes each unit of its pre-tokeniser on its own. Where a text has only characters on whose
classes all regular-expression libraries agree, and no special token, its units are found here, and the tokenizer
counts each different one once and is asked no more; any other text it encodes whole.

Defined results: a null text counts as empty and has no tokens; an empty table gives no rows; repeated rows are counted
alike; columns of the input that aren't named are ignored.
"""

import json
import os
from functools import reduce

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, scan_partitions


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _loaded(definition: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    out = Tokenizer.from_str(definition)
    out.no_truncation()
    out.no_padding()
    return out


# The units of byte-level pre-tokenisers, and the characters outside the common stock.
_UNIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_UNCOMMON = r"[^\t\n\x0b\x0c\r\x20-\x7e\xa0-\u024f]"


class Counter:
    """Counts the tokens of texts, remembering up to `most` units."""

    def __init__(self, definition: str, most: int = 400_000):
        self.tokenizer, self.known, self.most = _loaded(definition), {}, most
        about = json.loads(definition)
        before = about.get("pre_tokenizer") or {}
        self.by_units = not about.get("normalizer") and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        special = [regex.escape(t["content"]) for t in about.get("added_tokens", [])]
        self.unit, self.whole = regex.compile(_UNIT), regex.compile("|".join([_UNCOMMON, *special]))

    def encoded(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def count(self, texts: list[str]) -> list[int]:
        units = [self.unit.findall(t) if self.by_units and not self.whole.search(t) else None for t in texts]
        if len(self.known) > self.most:
            self.known.clear()
        new = list(set().union(*(u for u in units if u)) - self.known.keys())
        for at in range(0, len(new), 4096):  # encodings are large beside their texts
            self.known.update(zip(new[at : at + 4096], self.encoded(new[at : at + 4096])))
        whole = iter(self.encoded([t for t, u in zip(texts, units) if u is None]))
        return [next(whole) if u is None else sum(map(self.known.__getitem__, u)) for u in units]


def count_tokens(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    path: str | None = None,
    chunk: int = 1 << 16,
    overlap: int = 1 << 10,
    limit: int = 1024,
    batch_chars: int = 1 << 19,
    most_bytes: int = 16 << 20
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of every whole text, without added special tokens.

    path: a tokenizer file on the driver, of most_bytes at most, which is sent to every task.
    """
    with open(path or default_tokenizer(), "rb") as file:
        data = file.read(most_bytes + 1)
    if len(data) > most_bytes:
        raise ValueError(f"the tokenizer is larger than {most_bytes} bytes, which are sent to every task")
    definition = docs.sparkSession.sparkContext.broadcast(data.decode())
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()

    def counted(batches):
        counter = Counter(definition.value)
        for batch in batches:
            texts, counts, waiting, size = batch["text"], [], [], 0
            for x in texts:
                waiting.append(x.as_py())
                size += len(waiting[-1])
                if size >= batch_chars:
                    counts += counter.count(waiting)
                    waiting, size = [], 0
            counts += counter.count(waiting)
            yield pa.RecordBatch.from_arrays(
                [*(batch[c] for c in batch.schema.names if c != "text"), pa.array(counts, pa.int64())],
                names=[*(c for c in batch.schema.names if c != "text"), "n_tokens"]
            )

    long = F.length("text") > chunk
    small = rows.filter(~long).withColumn("n_bytes", F.octet_length("text").cast("long"))
    done = [small.select("doc_id", "n_bytes", "text").mapInArrow(counted, f"doc_id {kind}, n_bytes long, n_tokens long")]
    huge = rows.filter(long)
    if not huge.isEmpty():
        done += _huge(huge, definition, kind, chunk, overlap, counted)
    return reduce(DataFrame.unionByName, done).withColumn("over_limit", F.col("n_tokens") > limit)


def _huge(huge: DataFrame, definition, kind: str, chunk: int, overlap: int, counted) -> list[DataFrame]:
    """Counts of the huge documents, a table for each width of overlap that was needed."""
    spread = 4 * scan_partitions(huge)
    left = checkpointed(huge.withColumn("row", F.monotonically_increasing_id()))
    done = []
    while True:
        counts = checkpointed(_by_chunks(left, definition, chunk, overlap, spread))
        ids = left.select("row", "doc_id", F.octet_length("text").cast("long").alias("n_bytes"))
        done.append(counts.filter("n_tokens IS NOT NULL").join(ids, "row").select("doc_id", "n_bytes", "n_tokens"))
        failed = counts.filter("n_tokens IS NULL").select("row")
        if failed.isEmpty():
            return done
        left = checkpointed(left.join(failed, "row", "left_semi"))
        overlap, chunk = overlap * 8, max(chunk, overlap * 16)
        whole = F.length("text") <= chunk
        done.append(
            left.filter(whole).select(
                "doc_id",
                F.octet_length("text").cast("long").alias("n_bytes"),
                "text"
            ).mapInArrow(counted, f"doc_id {kind}, n_bytes long, n_tokens long")
        )
        left = left.filter(~whole)
        if left.isEmpty():
            return done


def _by_chunks(left: DataFrame, definition, chunk: int, overlap: int, spread: int) -> DataFrame:
    """(row, n_tokens), with a null where two chunks share no boundary."""

    def cut(batches):
        for batch in batches:
            for row, text in zip(batch["row"], batch["text"]):
                text = text.as_py()
                starts = range(0, max(1, len(text) - overlap), chunk)
                for k, at in enumerate(starts):
                    part = text[at : at + chunk + overlap]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row.as_py()]), pa.array([k]), pa.array([at]), pa.array([at + len(part) >= len(text)]), pa.array([part])],
                        names=["row", "k", "at", "last", "part"]
                    )

    def bounds(batches):
        """Tokens of a chunk, and the starts of units (with the tokens before them) in its two overlaps."""
        tokenizer = _loaded(definition.value)
        for batch in batches:
            for k in range(len(batch)):
                at, last, part = (batch[c][k].as_py() for c in ("at", "last", "part"))
                encoding = tokenizer.encode(part, add_special_tokens=False)
                words = np.array([-1 if w is None else w for w in encoding.word_ids])
                starts = np.array([a for a, _ in encoding.offsets], np.int64)
                first = np.flatnonzero(np.concatenate([[True], (words[1:] != words[:-1]) | (words[1:] < 0)])) if len(words) else np.zeros(0, np.int64)
                safe = first if last else first[:-3]
                head, tail = first[starts[first] < overlap], safe[starts[safe] >= chunk]
                yield pa.RecordBatch.from_arrays(
                    [batch["row"].slice(k, 1), batch["k"].slice(k, 1), pa.array([last]), pa.array([len(words)]), *(pa.array([x.tolist()], pa.list_(pa.int64())) for x in (starts[head] + at, head, starts[tail] + at, tail))],
                    names=["row", "k", "last", "n", "head_at", "head_n", "tail_at", "tail_n"],
                )

    parts = left.select("row", "text").mapInArrow(cut, "row long, k long, at long, last boolean, part string").repartition(spread, "row", "k")
    chunks = parts.mapInArrow(
        bounds,
        "row long, k long, last boolean, n long, head_at array<long>, head_n array<long>, tail_at array<long>, tail_n array<long>"
    )
    chunks = checkpointed(chunks)
    before = chunks.select("row", (F.col("k") + 1).alias("k"), "tail_at", "tail_n")
    both = chunks.select("row", "k", "last", "n", "head_at", "head_n").join(before, ["row", "k"], "left")
    shared = F.get(F.array_intersect("tail_at", "head_at"), F.lit(0))
    cut_at = both.withColumn("shared", F.when(F.col("k") > 0, shared))
    # Tokens up to the splice come from the earlier chunk, those after it from the later one.
    up_to = lambda at, n: F.get(F.col(n), (F.array_position(at, F.col("shared")) - 1).cast("int"))
    part = F.col("n") + F.when(F.col("k") > 0, up_to("tail_at", "tail_n") - up_to("head_at", "head_n")).otherwise(0)
    lost = F.when(~F.col("last"), F.col("n")).otherwise(0)  # an earlier chunk counts up to its splice, which the later one adds
    return cut_at.groupBy("row").agg(
        F.sum(part - lost).alias("n_tokens"),
        F.max((F.col("k") > 0) & F.col("shared").isNull()).alias("failed")
    ).select("row", F.when(~F.col("failed"), F.col("n_tokens")).alias("n_tokens"))
