"""Language identification: words first, then ever shorter character n-grams.

A word that the model knows scores the logarithm of its relative frequency in each language. An unseen word scores the
mean over its known n-grams of the greatest length that has any, from `longest` characters down to one. The sum
over all words of the text gives the language, and its posterior probability under even priors is the score.

Defined results: a null text, or one without letters, has language `und` and score 0; so has every text if nothing
could be learned. Ties go to the language that is first in the alphabet. Repeated rows are treated alike; an empty
table gives no rows; columns of the input that aren't named are ignored.
"""

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, checkpointed

UNDETERMINED = "und"
#: What holds all words: \w without digits and the underscore; numerals that aren't letters are cut out of it later.
_RUN = re.compile(r"[^\W\d_]+")
_digest = partial(xxhash.xxh64_intdigest, seed=42)


def _hashes(keys) -> np.ndarray:
    """As Spark's xxhash64 gives them for strings."""
    return np.fromiter((_digest(k.encode()) for k in keys), np.uint64).view(np.int64)


def _find(known: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The places of keys in known, which is in order; -1 for those that aren't there."""
    if not len(known):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[at] == keys, at, -1)


@dataclass
class Model:
    """words and grams: their hashes in order; the scores have a row for each and a column for each language."""

    languages: list[str]
    words: np.ndarray
    word_scores: np.ndarray
    grams: np.ndarray
    gram_scores: np.ndarray
    longest: int

    def scores(self, words: list[str]) -> np.ndarray:
        """A row for each word: its own scores if it is known, else the mean over its n-grams."""
        out = np.zeros((len(words), len(self.languages)))
        rows = _find(self.words, _hashes(words))
        out[rows >= 0] = self.word_scores[rows[rows >= 0]]
        left = np.flatnonzero(rows < 0)
        for n in range(self.longest, 0, -1):
            sums, counts = np.zeros((len(left), len(self.languages))), np.zeros(len(left))
            grams = ((k, m[i : i + n]) for k, m in enumerate(f"<{words[at]}>" for at in left) for i in range(len(m) - n + 1))
            while part := list(islice(grams, 1 << 17)):  # so that a word of any length takes bounded memory
                rows = _find(self.grams, _hashes(g for _, g in part))
                owner = np.fromiter((k for k, _ in part), np.int64, len(part))[rows >= 0]
                np.add.at(sums, owner, self.gram_scores[rows[rows >= 0]])
                np.add.at(counts, owner, 1)
            some = counts > 0
            out[left[some]] = sums[some] / counts[some, None]
            left = left[~some]
        return out


class Reader:
    """A model with a bounded memory of the words that it has met."""

    def __init__(self, model: Model, most: int = 100_000):
        self.model = model
        self.most = max(1000, min(most, 2_000_000 // max(1, len(model.languages))))
        self.rows: dict[str, int] = {}
        self.characters = 0
        self.table = np.zeros((self.most, len(model.languages)))
        self.letters = np.zeros(self.most, bool)

    def learn(self, runs: list[str]) -> None:
        """Rows for runs that aren't known; a run with numerals counts as the words in it."""
        parts = [[r] if r.isalpha() else "".join(c if c.isalpha() else " " for c in r).split() for r in runs]
        scores = self.model.scores(list(chain.from_iterable(parts)))
        first, at = len(self.rows), np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        self.table[first : first + len(runs)] = 0
        np.add.at(self.table, first + at, scores)
        self.letters[first : first + len(runs)] = [bool(p) for p in parts]
        self.rows.update(zip(runs, range(first, first + len(runs))))
        self.characters += sum(map(len, runs))

    def read(self, text: str | None) -> tuple[str, float]:
        """The language of a whole text and its probability."""
        languages = self.model.languages
        total, letters = np.zeros(len(languages)), False
        for block in blocks(text or ""):
            found = _RUN.findall(block.lower())
            for at in range(0, len(found), self.most // 2):
                part = found[at : at + self.most // 2]
                if new := {w for w in part if w not in self.rows}:
                    if len(self.rows) + len(new) > self.most or self.characters > 1 << 24:
                        self.rows.clear()
                        self.characters, new = 0, set(part)
                    self.learn(list(new))
                rows = np.fromiter(map(self.rows.__getitem__, part), np.int64, len(part))
                letters |= bool(self.letters[rows].any())
                total += self.table[rows].sum(0)
        if not letters or not languages:
            return UNDETERMINED, 0.0
        best = int(total.argmax())
        return languages[best], float(1 / np.exp(np.minimum(total - total[best], 0)).sum())


def _scores(counts: DataFrame, kind: Column, key: str, languages: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes in order and their scores: logarithms of relative frequencies among the keys of a kind. Only numbers come
    to the driver."""
    sums = [F.sum(F.when(F.col("lang") == x, F.col("n")).otherwise(0)).alias(f"n{i}") for i, x in enumerate(languages)]
    found = counts.groupBy(F.xxhash64(key).alias("h")).agg(F.first(kind).alias("kind"), *sums).toArrow()
    order = np.argsort(found["h"].to_numpy())
    kinds = found["kind"].to_numpy()[order]
    out = np.array([found[f"n{i}"].to_numpy()[order] for i in range(len(languages))], float).reshape(len(languages), -1).T
    for k in np.unique(kinds):
        # Counts are taken as of equally large samples: what is unseen weighs the same in rare languages.
        part = out[kinds == k]
        part = part / np.maximum(part.sum(0), 1) * part.sum(0).max() + 0.5
        out[kinds == k] = np.log(part / part.sum(0))
    return found["h"].to_numpy()[order], out


def fit(labelled: DataFrame, id_col: str, text_col: str, lang_col: str, max_rows: int = 5_000, longest: int = 5) -> Model:
    """Learn from the rows of labelled that have a language: of each language all, or about max_rows picked by a hash of
    id and text where it has more.

    max_rows bounds the work and, with it, the model, which is sent to every task as arrays of numbers; it holds for each
    language, so that none is crowded out by others. The picked texts are used whole, and all their words and n-grams
    enter the model. A language whose picked texts hold no word can't be learned.
    """
    none = np.zeros(0, np.int64), np.zeros((0, 0))
    rows = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy(lang_col).count().collect()}
    if not sizes:
        return Model([], *none, *none, longest)
    limits = F.create_map(*(F.lit(x) for lang, n in sizes.items() for x in (lang, int((1 << 20) * min(1.0, max_rows / n)))))
    picked = rows.filter(F.pmod(F.xxhash64(id_col, text_col), F.lit(1 << 20)) < F.element_at(limits, F.col(lang_col)))
    words = picked.select(F.col(lang_col).alias("lang"), F.explode(F.split(F.lower(text_col), r"[^\p{L}]+")).alias("word")).filter("word != ''")
    counts = checkpointed(words.groupBy("lang", "word").agg(F.count("*").alias("n")))
    marked = F.concat(F.lit("<"), "word", F.lit(">"))
    lengths = F.sequence(F.lit(1), F.least(F.lit(longest), F.length(marked)))
    cut = F.flatten(F.transform(lengths, lambda n: F.transform(F.sequence(F.lit(1), F.length(marked) - n + 1), lambda i: F.substring(marked, i, n))))
    grams = counts.select("lang", "n", F.explode(cut).alias("gram")).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    languages = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    if not languages:
        return Model([], *none, *none, longest)
    return Model(languages, *_scores(counts, F.lit(0), "word", languages), *_scores(grams, F.length("gram"), "gram", languages), longest)


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> Column:
    """A struct (lang, score) for every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(tuple(vars(model).values()))

    @F.arrow_udf("lang string, score double")
    def identified(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        reader = Reader(Model(*shared.value))
        for texts in batches:
            found = [reader.read(x.as_py()) for x in texts]
            yield pa.StructArray.from_arrays(
                [pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())],
                ["lang", "score"]
            )

    return identified(F.col(text_col))


def is_held_out(id_col: str = "doc_id") -> Column:
    """A quarter of the ids, for measuring accuracy; a null id isn't held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred and score of each document, by a model of the labelled ones that aren't held out."""
    held = is_held_out(id_col)
    model = fit(docs.filter(~held), id_col, text_col, lang_col)
    return docs.select(
        F.col(id_col).alias("doc_id"),
        held.alias("held_out"),
        predict(docs, model, text_col).alias("_p")
    ).select("doc_id", "held_out", F.col("_p.lang").alias("lang_pred"), F.col("_p.score").alias("score"))


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: float = 0.5) -> DataFrame:
    """docs without those that have no letter or whose language scores under least."""
    model = fit(docs.filter(~is_held_out(id_col)), id_col, text_col, lang_col)
    found = docs.withColumn("_lang_id", predict(docs, model, text_col))
    return found.filter((F.col("_lang_id.lang") != UNDETERMINED) & (F.col("_lang_id.score") >= least)).drop("_lang_id")
