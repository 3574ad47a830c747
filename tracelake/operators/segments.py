"""Error blocks of logs by a scan in segments, so that one giant log is the work of many tasks.

The segmenter is an automaton with few states: no block is open, one is open and has had n lines (counted up to the limit
from which other lines no longer close it), or one is open and takes in only exception lines and causes. What a range of
lines does to it is a function of the state before; such functions compose, and are determined by a handful of values,
as the start of a block or a blank line leads every state to the same one. So each range of a log is reduced to its
function by a task of its own, the short list of a log's functions is run through in order, and each range is read again
from the state in which it truly begins.
"""

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import tracelake

from .graph import checkpointed

#: Functions travel to executors with their code, so that these need not have the package installed.
cloudpickle.register_pickle_by_value(tracelake)

#: Kinds of lines. A late cause is one that may open a block: only where none is open.
BLANK, START, HARD, SOFT, OTHER, LATE = range(6)

#: States: CLOSED, lines of an open block so far (up to the limit), ABSORBING. Each goes with the place of its block.
CLOSED, ABSORBING = 0, -1

#: Lines after which a task hands on what it has.
PER_BATCH = 4096


def step(state: int, block: int | None, kind: int, line_no: int, most: int) -> tuple[int, int | None, bool]:
    """State and block after a line, and whether the line is part of that block."""
    if kind == START or kind == LATE and state == CLOSED:
        return 1, line_no, True
    if kind == BLANK or state == CLOSED:
        return CLOSED, None, False
    if state == ABSORBING:
        return ABSORBING, block, kind in (HARD, LATE)
    if kind == OTHER:
        return (ABSORBING, block, False) if state >= most else (CLOSED, None, False)
    return min(state + 1, most), block, kind != SOFT or state < most


class Effect(NamedTuple):
    """What a range does. steps: lines before the first other line or reset, by which the count of an open block grows;
    closes: there is such another line; resets: all states end in `closed`, which is where a closed one ends; after: where
    a block ends that the first other line has closed."""

    steps: int
    closes: bool
    resets: bool
    closed: tuple[int, int | None]
    after: tuple[int, int | None]

    def apply(self, state: int, block: int | None, most: int) -> tuple[int, int | None]:
        if self.resets or state == CLOSED:
            return self.closed
        if state == ABSORBING:
            return state, block
        if not self.closes:
            return min(state + self.steps, most), block
        return (ABSORBING, block) if state + self.steps >= most else self.after


def effect(kinds: list[int], numbers: list[int], most: int) -> Effect:
    closed, after, steps, closes, resets = (CLOSED, None), (CLOSED, None), 0, False, False
    for kind, line_no in zip(kinds, numbers):
        closed = step(*closed, kind, line_no, most)[:2]
        if resets:
            continue
        if kind in (START, BLANK):
            resets = True
        elif closes:
            after = step(*after, kind, line_no, most)[:2]
        elif kind == OTHER:
            closes = True
        else:
            steps += 1
    return Effect(steps, closes, resets, closed, after)


def _cells(batch: pa.RecordBatch) -> Iterator[tuple[int, list[int], list[int], pa.Array]]:
    """Of each row of ranges: its number in the batch, the kinds and numbers of its lines, and their texts."""
    cells = batch["cells"]
    flat, ends = cells.flatten(), cells.offsets.to_pylist()
    kinds, numbers, lines = (flat.field(c) for c in ("kind", "line_no", "line"))
    first = ends[0]
    for row, (a, b) in enumerate(zip(ends, ends[1:])):
        a, b = a - first, b - first
        yield row, kinds[a:b].to_pylist(), numbers[a:b].to_pylist(), lines[a:b]


_EFFECT = "steps long, closes boolean, resets boolean, closed_state int, closed_block long, after_state int, after_block long"


def _effects(most: int):
    def run(batches):
        for batch in batches:
            found = [effect(kinds, numbers, most) for _, kinds, numbers, _ in _cells(batch)]
            columns = [[x.steps for x in found], [x.closes for x in found], [x.resets for x in found], *([x[k][i] for x in found] for k in (3, 4) for i in (0, 1))]
            kinds = (pa.int64(), pa.bool_(), pa.bool_(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch["log_id"], batch["part"], *(pa.array(c, k) for c, k in zip(columns, kinds))],
                names=["log_id", "part", *(x.split()[0] for x in _EFFECT.split(", "))],
            )

    return run


def _scan(most: int):
    """Of rows in the order of log and part, the state in which each part begins."""

    def run(batches):
        log, state, first = None, (CLOSED, None), True
        for batch in batches:
            states = []
            for log_id, steps, closes, resets, *ends in zip(*(batch[c].to_pylist() for c in batch.schema.names if c != "part")):
                if first or log_id != log:
                    log, state, first = log_id, (CLOSED, None), False
                states.append(state)
                state = Effect(steps, closes, resets, tuple(ends[:2]), tuple(ends[2:])).apply(*state, most)
            yield pa.RecordBatch.from_arrays(
                [batch["log_id"], batch["part"], pa.array([x for x, _ in states], pa.int32()), pa.array([x for _, x in states], pa.int64())],
                names=["log_id", "part", "state", "block"],
            )

    return run


def _replay(most: int):
    """Of ranges with the state in which they begin, the lines of blocks, those of many short logs together."""

    def run(batches):
        for batch in batches:
            cells = batch["cells"]
            flat, ends = cells.flatten(), cells.offsets.to_pylist()
            kinds, numbers = flat.field("kind").to_pylist(), flat.field("line_no").to_pylist()
            rows, taken, blocks = [], [], []
            for row, (state, block) in enumerate(zip(batch["state"].to_pylist(), batch["block"].to_pylist())):
                for k in range(ends[row] - ends[0], ends[row + 1] - ends[0]):
                    state, block, kept = step(state, block, kinds[k], numbers[k], most)
                    if kept:
                        rows.append(row)
                        taken.append(k)
                        blocks.append(block)
                if len(taken) >= PER_BATCH or taken and row == len(batch) - 1:
                    at = pa.array(taken, pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [batch["log_id"].take(pa.array(rows, pa.int64())), pa.array(blocks, pa.int64()), flat.field("line_no").take(at), flat.field("line").take(at)],
                        names=["log_id", "pos", "line_no", "line"],
                    )
                    rows, taken, blocks = [], [], []

    return run


def block_lines(marked: DataFrame, most: int, per_range: int) -> DataFrame:
    """(log_id, pos, line_no, line): the lines of each block; pos is the number of its first one.

    marked: (log_id, line_no, kind, line); lines that can't be part of a block need no text. A range has per_range lines,
    if they are numbered without gaps, and never more.
    """
    cell = F.struct(F.col("line_no").cast("long").alias("line_no"), F.col("kind").cast("int").alias("kind"), "line")
    part = F.floor(F.col("line_no") / per_range).cast("long").alias("part")
    ranges = marked.groupBy("log_id", part).agg(F.array_sort(F.collect_list(cell)).alias("cells"))
    ranges = checkpointed(ranges)
    log = f"log_id {marked.schema['log_id'].dataType.simpleString()}, "
    # Only ranges that have a line to give are read again; the first of a log begins without a block.
    kept = ranges.filter(F.exists("cells", lambda x: ~x.kind.isin(BLANK, OTHER)))
    long = ranges.groupBy("log_id").agg(F.count("*").alias("_n")).filter("_n > 1").select(F.col("log_id").alias("_long"))
    if ranges.filter("part > 0").isEmpty():
        begun = kept.select("log_id", "cells", F.lit(CLOSED).alias("state"), F.lit(None).cast("long").alias("block"))
    else:
        bare = F.transform("cells", lambda x: F.struct(x.line_no.alias("line_no"), x.kind.alias("kind"), F.lit(None).cast("string").alias("line")))
        several = ranges.select("log_id", "part", bare.alias("cells")).join(long, F.col("log_id").eqNullSafe(F.col("_long")), "left_semi")
        effects = several.mapInArrow(_effects(most), f"{log}part long, {_EFFECT}")
        begins = effects.repartition("log_id").sortWithinPartitions("log_id", "part").mapInArrow(_scan(most), f"{log}part long, state int, block long")
        begins = begins.select(F.col("log_id").alias("_log"), F.col("part").alias("_part"), "state", "block")
        begun = kept.join(begins, F.col("log_id").eqNullSafe(F.col("_log")) & (F.col("part") == F.col("_part")), "left")
        begun = begun.select("log_id", "cells", F.coalesce("state", F.lit(CLOSED)).alias("state"), "block")
    return begun.mapInArrow(_replay(most), f"{log}pos long, line_no long, line string")
