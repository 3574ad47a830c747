"""The literal index over rule catalogues, against testing every rule on every log."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tracelake.operators import literals, match


@pytest.mark.parametrize(
    ("pattern", "want"),
    [
        ("OutOfMemoryError.*heap", {"outofmemoryerror"}),
        (r"exception in task \d+", {"exception in task "}),
        ("(?:disk|space) full", {" full"}),
        ("disk|no space", {"disk", "no space"}),
        ("disk|.", None),
        ("(abc)+x?", {"abc"}),
        ("(abc)*", None),
        ("a.b.c", None),
        (r"\d+", None),
        ("^At [xy]est$", {"at "}),
        ("(?i)abc", None),
        ("[a[bc]]def", None),
        (r"\Qabc\E", None),
        ("(", None),
        ("(?=abc)", None),
        ("(?!abc)longer", {"longer"}),
        ("a{2,3}bcd", {"bcd"}),
        ("käse", {"se"}),
    ],
)
def test_required_literals(pattern, want):
    assert literals.required(pattern) == want


WORDS = ["disk", "heap", "error", "Table", "lost", "EXECUTOR", "shuffle", "42", "retry", "ä"]
RULES = ["{a}.*{b}", "{a}|{b}", r"{a} \d+", "(?:{a}|x) {b}", "{a}", r"\b{a}\b.*[a-z]{b}?", "(?i){b}", "[{a}]", "{a} {b}$", "^{a}"]


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(1)
    texts = [(f"l{i}", rng.choice(["SPARK", "SQL", "PYTHON", None]), None if i == 7 else "\n".join(" ".join(rng.choices([*WORDS, *map(str.lower, WORDS)], k=rng.randint(0, 6))) for _ in range(3))) for i in range(400)]
    rules = []
    for i in range(120):
        pattern = rng.choice(RULES).format(a=rng.choice(WORDS), b=rng.choice(WORDS))
        rules.append((rng.choice(["SPARK", "SQL"]), "c", rng.randint(1, 3), i, f"e{i}", pattern, "h"))
    return (
        spark.createDataFrame(texts, "log_id string, task_type string, text string"),
        spark.createDataFrame(rules, "task_type string, category string, category_rank int, ord int, error_type string, pattern string, hint string"),
    )


def test_rules_found_by_the_index_are_those_found_by_all_pairs(data):
    texts, rules = data
    found = [sorted(map(str, match.match_rules(texts, rules, few=few, most_rules=most).collect())) for few, most in ((1000, 5000), (0, 5000), (0, 10))]
    assert found[0] == found[1] == found[2]
    assert sum("UNKNOWN" not in x for x in found[0]) > 100


def test_knowledge_found_by_the_index_is_that_of_all_pairs(spark, data):
    rng = random.Random(2)
    entries = [(f"k{i}", rng.choice(["SPARK", "SQL"]), rng.choice([*WORDS, "", None, "heap\n", "disk 42"]), rng.random() < 0.5, i, rng.choice(["confirmed", "confirmed", "pending"])) for i in range(60)]
    known = spark.createDataFrame(entries, "id string, task_type string, pattern string, has_fix boolean, ord int, status string")
    found = [sorted(map(str, match.match_knowledge(data[0], known, few=few).collect())) for few in (1000, 0)]
    assert found[0] == found[1]
    assert sum("None" not in x for x in found[0]) > 50


def test_many_rules_cost_little_more_than_few(spark):
    rng = random.Random(3)
    name = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=9))
    rules = [("SPARK", "c", 1, i, f"e{i}", rf"{name()}: \d+ {name()}.*lost", "h") for i in range(5000)]
    schema = "task_type string, category string, category_rank int, ord int, error_type string, pattern string, hint string"
    texts = spark.range(20_000).select(
        F.col("id").cast("string").alias("log_id"), F.lit("SPARK").alias("task_type"), F.concat(F.repeat(F.lit("INFO some line of a log, nothing lost\n"), 20), F.md5(F.col("id").cast("string"))).alias("text")
    ).cache()
    texts.count()

    def took(n):
        catalogue = spark.createDataFrame(rules[:n], schema)
        began = time.time()
        assert match.match_rules(texts, catalogue).filter("error_type = 'UNKNOWN'").count() == 20_000
        return time.time() - began

    took(50)
    assert took(5000) < 2 * max(took(50), 1.5)
    texts.unpersist()
