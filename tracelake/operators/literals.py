"""An index over the literals of a catalogue, so that a text meets only those of its rules that can match it.

A rule's regular expression can't match without certain literals; one Aho-Corasick automaton over all of them finds, in a
single pass over a text, the rules whose literal occurs. Only these are then tested by the executors' own regex engine,
besides the rules for which no such literal is known.
"""

import re
import warnings

import ahocorasick
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import tracelake

#: Functions travel to executors with their code, so that these need not have the package installed.
cloudpickle.register_pickle_by_value(tracelake)

#: Shorter literals tell too little.
LEAST = 2


def folded(text: str) -> str:
    """A-Z as lower case and nothing else, as matching without regard to case does."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def _is_plain(pattern: str) -> bool:
    """Whether both regex dialects read the pattern alike: no flags inside, no classes within classes, no odd escapes."""
    if re.search(r"\(\?[a-zA-Z-]|&&", pattern):
        return False
    inside, at = False, 0
    while at < len(pattern):
        c = pattern[at]
        if c == "\\":
            if pattern[at + 1 : at + 2] in set("0123456789QEGXRNupPcexhHvVkKzZ"):
                return False
            at += 2
            continue
        if inside and c == "[":
            return False
        if c == "[":
            inside = True
            at += 1 + (pattern[at + 1 : at + 2] == "^")
            if pattern[at : at + 1] == "]":
                return False
            continue
        if c == "]":
            inside = False
        at += 1
    return not inside


def required(pattern: str) -> set[str] | None:
    """Literals of which one occurs, folded, in every text that the pattern matches without regard to case; None if
    there is no such set."""
    if pattern is None or not _is_plain(pattern):
        return None
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = re._parser.parse(pattern, re.I | re.S)
    except (re.error, OverflowError, RecursionError, ValueError):
        return None
    return _best(tree)


def _best(tree) -> set[str] | None:
    """Of the parts of a sequence, the one whose shortest literal is longest."""
    found, run = [], ""
    for kind, value in [*tree, (None, None)]:
        name = str(kind)
        if name == "LITERAL" and (value < 128 or chr(value).upper() == chr(value).lower()):
            run += chr(value)
            continue
        if run:
            found.append({folded(run)})
            run = ""
        if name == "SUBPATTERN" and not value[1] and not value[2]:
            found.append(_best(value[3]))
        elif name == "ATOMIC_GROUP":
            found.append(_best(value))
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and value[0] >= 1:
            found.append(_best(value[2]))
        elif name == "BRANCH":
            parts = [_best(x) for x in value[1]]
            found.append(None if None in parts else set().union(*parts))
    usable = [x for x in found if x and min(map(len, x)) >= LEAST]
    return max(usable, key=lambda x: (min(map(len, x)), -len(x)), default=None)


class Index:
    """keys: for each rule its task type and literals (None: it is always a candidate)."""

    def __init__(self, keys: list[tuple[str, set[str] | None]], fold: bool):
        self.fold, self.rest, self.automata = fold, {}, {}
        for rule, (kind, literals) in enumerate(keys):
            if literals is None:
                self.rest.setdefault(kind, []).append(rule)
                continue
            automaton = self.automata.setdefault(kind, ahocorasick.Automaton())
            for x in literals:
                if (rules := automaton.get(x, None)) is None:
                    automaton.add_word(x, [rule])
                else:
                    rules.append(rule)
        for x in self.automata.values():
            x.make_automaton()

    def candidates(self, kind: str, text: str) -> list[int]:
        found = set(self.rest.get(kind, ()))
        if (automaton := self.automata.get(kind)) is not None:
            seen = {id(rules): rules for _, rules in automaton.iter(folded(text) if self.fold else text)}
            found.update(*seen.values())
        return sorted(found)


def candidates(logs: DataFrame, keys: list[tuple[str, set[str] | None]], fold: bool) -> DataFrame:
    """logs (log_id, task_type, text) with `rules`: the numbers of the rules that can match a row; rows without any are
    left out. keys is sent to every task, so its size must be bounded."""
    sent = logs.sparkSession.sparkContext.broadcast(keys)
    schema = ", ".join(f"{c} {logs.schema[c].dataType.simpleString()}" for c in ("log_id", "task_type", "text"))

    def run(batches):
        index = Index(sent.value, fold)
        for batch in batches:
            found = [index.candidates(k, t) if k is not None and t is not None else [] for k, t in zip(batch["task_type"].to_pylist(), batch["text"].to_pylist())]
            at = pa.array([i for i, x in enumerate(found) if x], pa.int64())
            rules = pa.array([x for x in found if x], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*(batch[c].take(at) for c in ("log_id", "task_type", "text")), rules], names=["log_id", "task_type", "text", "rules"])

    return logs.select("log_id", "task_type", "text").mapInArrow(run, f"{schema}, rules array<int>")


def rule_pairs(logs: DataFrame, rules: DataFrame, fold: bool, literal_of) -> DataFrame:
    """Pairs of a log and a rule of its task type that can match; rules (task_type, pattern, ...) must be few."""
    rows = rules.collect()
    schema = rules.schema
    keys = [(r["task_type"], literal_of(r["pattern"])) for r in rows]
    numbered = logs.sparkSession.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"_rule int, {', '.join(f'`{x.name}` {x.dataType.simpleString()}' for x in schema)}")
    found = candidates(logs, keys, fold).select("log_id", "text", F.explode("rules").alias("_rule"))
    return found.join(F.broadcast(numbered), "_rule").drop("_rule")
