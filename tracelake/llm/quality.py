"""Quality filtering by weak supervision, with DataFrame functions only.

Rules vote good (1), bad (-1) or abstain (0) on a text. Expectation-maximisation over the counts of vote
patterns (at most 3 ** number of rules of them, whatever the number of documents) estimates the share of good
documents and how often each rule votes how on good and on bad ones, and a document is kept if the posterior
probability of good quality is high enough.

Defined results: a null text counts as empty; an empty text has no words, fails the base rule and isn't kept;
repeated rows are judged alike; an empty table gives no rows; columns of the input that aren't named are ignored.
"""

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE_SPACE, checkpointed, let

METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE_METRICS = ("n_lines", "n_ended_lines", "n_letters")


def repeat_words(words: Column) -> Column:
    """Number of words that lie in a 3-word window which occurs twice or more among words.

    Windows are compared by XXH64 of their words. Where few different windows repeat, positions are found by looking
    each window up among them; otherwise (window, position) pairs are sorted, so that long texts take n log n steps.
    """

    def covered(positions: Column) -> Column:
        steps = F.transform(positions, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(positions, k + 1) - p, F.lit(3))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def by_sorting(windows: Column) -> Column:
        def flagged(s: Column) -> Column:
            twice = F.filter(s, lambda x, k: (x.h == F.get(s, k - 1).h) | (x.h == F.get(s, k + 1).h))
            return let(F.sort_array(F.transform(twice, lambda x: x.i)), covered)

        return let(F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), flagged)

    def by_lookup(windows: Column, has) -> Column:
        return let(F.filter(F.sequence(F.lit(0), F.size(windows) - 1), lambda i: has(F.get(windows, i))), covered)

    def by_parts(windows: Column, rep: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda b: F.filter(rep, lambda h: h.bitwiseAND(F.lit(63)) == b))
        return let(parts, lambda ps: by_lookup(windows, lambda h: F.array_contains(F.get(ps, h.bitwiseAND(F.lit(63)).cast("int")), h)))

    def counted(windows: Column) -> Column:
        def with_repeats(rep: Column) -> Column:
            n = F.size(rep)
            few = by_lookup(windows, lambda h: F.array_contains(rep, h))
            return F.when(n == 0, 0).when(n <= 12, few).when(n <= 4096, by_parts(windows, rep)).otherwise(by_sorting(windows))

        return let(F.sort_array(windows), lambda s: let(F.array_distinct(F.filter(s, lambda h, k: h == F.get(s, k - 1))), with_repeats))

    def windows_of(w: Column) -> Column:
        return F.transform(F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))

    return let(words, lambda w: let(windows_of(w), counted))


def text_metrics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, METRICS and MORE_METRICS of every whole text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias(id_col), text.alias("_text"))
    base = base.withColumn("_words", F.filter(F.split("_text", WHITE_SPACE), lambda w: w != ""))
    base = base.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    joined = F.regexp_replace("_text", WHITE_SPACE, "")
    return base.select(
        id_col,
        F.size("_words").cast("long").alias("n_words"),
        F.length(joined).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.regexp_replace("_text", r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("_words")).cast("long").alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.size(F.filter("_lines", lambda x: x.rlike(r"[.!?\x{2026}\"'\x{201d}):]\s*$"))).cast("long").alias("n_ended_lines"),
        (F.length("_text") - F.length(F.regexp_replace("_text", r"\p{L}+", ""))).cast("long").alias("n_letters"),
    )


def rules() -> dict[str, Column]:
    """Votes over the columns of text_metrics(): bad where a metric shows a fault, good where it is clearly fine, and
    nothing in between."""
    c = F.col
    words, chars, lines, symbols = c("n_words"), c("word_chars"), c("n_lines"), c("n_symbols")
    same, windows, ended, letters = c("n_dup_lines"), c("n_repeat_words"), c("n_ended_lines"), c("n_letters")
    prose = (words >= 50) & (200 * symbols <= chars) & (10 * same <= 3 * lines) & (10 * letters >= 8 * chars)
    votes = {
        "word_length": ((words > 0) & ((chars < 2 * words) | (chars > 14 * words)), (chars >= 3 * words) & (chars <= 10 * words)),
        "symbols": (100 * symbols > 3 * chars, 200 * symbols <= chars),
        "same_lines": (10 * same > 3 * lines, (same == 0) & (lines >= 2)),
        "same_windows": (5 * windows > 2 * words, 20 * windows <= words),
        "no_sentences": ((10 * ended < lines) & (lines >= 3), 2 * ended >= lines),
        "few_letters": (2 * letters < chars, 10 * letters >= 8 * chars),
        "prose": (F.lit(False), prose),
    }
    return {k: F.when(bad, -1).when((words > 0) & good, 1).otherwise(0) for k, (bad, good) in votes.items()}


def _posterior(prior: float, weights: dict[str, tuple[float, float, float]]) -> Column:
    """Probability of good, from the votes in _v_ columns; weights are the log odds of voting bad, nothing and good."""
    odds = F.lit(log(prior / (1 - prior)))
    for k, (bad, none, good) in weights.items():
        v = F.col(f"_v_{k}")
        odds = odds + F.when(v < 0, bad).when(v > 0, good).otherwise(none)
    return 1 / (1 + F.exp(-odds))


def estimate(votes: DataFrame, names: list[str], rounds: int = 50, close: float = 1e-4) -> tuple[float, dict[str, tuple[float, float, float]]]:
    """The share of good rows and, for each rule, the log odds (good to bad rows) of voting bad, nothing and good.

    Expectation-maximisation over all rows. Rows with the same votes are counted together first; each round is an
    aggregation of these counts to one row, until no probability moves by `close`. Rows without a bad vote count as good;
    the others start at their share of good votes, and only the data decide whether a rule's bad votes mean bad rows.
    """
    cols = [F.col(f"_v_{k}") for k in names]
    patterns = votes.groupBy(*cols).agg(F.count("*").alias("_n"))
    goods, bads = (sum((F.when(v == x, 1).otherwise(0) for v in cols), F.lit(0)) for x in (1, -1))
    patterns = counted = checkpointed(patterns.withColumn("_clean", bads == 0).withColumn("_p", (goods + 1) / (goods + bads + 2)).coalesce(1))
    n, p = F.col("_n"), F.when(F.col("_clean"), 1.0).otherwise(F.col("_p"))
    sums = [F.sum(n * w * (v == x).cast("int")) for v in cols for x in (-1, 0, 1) for w in (p, 1 - p)]
    before, prior, weights = None, 0.5, dict.fromkeys(names, (0.0, 0.0, 0.0))
    for _ in range(rounds):
        total, good, *parts = patterns.agg(F.sum(n), F.sum(n * p), *sums).first()
        if not total:
            break
        # Two rows of each class are added for a rule, so that what was never seen isn't impossible.
        rates = [(parts[k] + 2 / 3) / ((total - good if k % 2 else good) + 2) for k in range(len(parts))]
        prior = (good + 1) / (total + 2)
        logs = [log(rates[k] / rates[k + 1]) for k in range(0, len(rates), 2)]
        weights = {x: tuple(logs[3 * i : 3 * i + 3]) for i, x in enumerate(names)}
        if before and max(abs(a - b) for a, b in zip(rates, before)) < close:
            break
        before = rates
        patterns = counted.withColumn("_p", _posterior(prior, weights))
    return prior, weights


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """A row for each document: id_col, METRICS, base_failed, kept, p_good and the votes.

    base_failed: under 50 words, or over half of the words in repeated 3-word windows. kept: base didn't fail and
    the posterior probability of good quality is at least `least`. Texts are read once; both the estimate and the
    verdict use their checkpointed metrics.
    """
    by_name = rules()
    names = list(by_name)
    voted = checkpointed(text_metrics(docs, id_col, text_col).select(id_col, *METRICS, *(v.cast("int").alias(f"_v_{k}") for k, v in by_name.items())))
    prior, weights = estimate(voted, names)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    p = _posterior(prior, weights)
    return voted.select(
        id_col,
        *METRICS,
        failed.alias("base_failed"),
        (~failed & (p >= least)).alias("kept"),
        F.round(p, 6).alias("p_good"),
        *(F.col(f"_v_{k}").alias(f"vote_{k}") for k in names)
    )
