"""The stages of the pipeline, each on what the one before it kept."""

from pathlib import Path

import corpus_pipeline
from pyspark.sql import functions as F

from tracelake.llm import pii
from tracelake.llm.common import checkpoint_folder
from tracelake.llm.simhash import fingerprint

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES:
        kept.append(stage(spark, kept[-1], SF).cache())
    assert all(x.columns == docs.columns for x in kept[:-1])
    counts = [x.count() for x in kept]
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.8 * counts[0]
    assert kept[2].select("doc_id").distinct().count() == counts[2]
    fps = [fingerprint(r["text"]) for r in kept[2].collect()]
    assert all((a ^ b).bit_count() > 4 for i, a in enumerate(fps) for b in fps[:i])
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert not any(i[:80] in r["text"] for r in kept[3].collect() for i in items)
    assert not any(pii.base_spans(r["text"]) for r in kept[4].collect())
    assert kept[4].filter(F.col("n_chars") != F.length("text")).count() == 0
    assert {r["doc_id"] for r in kept[5].collect()} == {r["doc_id"] for r in kept[4].collect()}


ROWS = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank today", "en"),
    (1, "The quick brown fox jumps over the lazy dog near the river bank today", "en"),
    (2, "The quick brown fox jumps over the lazy dog near the river bank today", None),
    (3, "Le renard brun saute par dessus le chien paresseux pres de la riviere", "fr"),
    (4, None, "en"),
    (5, "", "fr"),
    (6, "12 34 !!", "en"),
    (None, "A document without any identifier stays as it is, write to ann@mail.example.com", "en"),
    (None, "A document without any identifier stays as it is, write to ann@mail.example.com", "en"),
    (7, "The same words again and again " + "and again " * 30000, "en"),
]
WITH_CLASHES = "doc_id long, text string, lang string, fp string, _h string, row int, ids string, _back string"


def documents(spark, rows):
    found = spark.createDataFrame([(i, t, x, "a", "b", 1, "c", "d") for i, t, x in rows], WITH_CLASHES)
    return found.withColumn("source", F.lit(None).cast("string")).withColumn("n_chars", F.length("text").cast("long"))


def test_stages_with_nulls_repeats_long_texts_and_clashing_columns(spark):
    docs = documents(spark, ROWS)
    kept = corpus_pipeline.language(spark, docs, SF)
    assert sorted(map(str, (r["doc_id"] for r in kept.collect()))) == sorted(["1", "1", "2", "3", "7", "None", "None"])
    single = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert sorted(map(str, (r["doc_id"] for r in single.collect()))) == sorted(["1", "3", "4", "6", "7", "None"])
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs.filter("doc_id != 4 OR doc_id IS NULL"), SF).collect()} == {1, 3, 5, 6, 7, None}
    assert corpus_pipeline.decontamination(spark, docs, SF).count() == len(ROWS)
    clean = corpus_pipeline.personal_data(spark, docs, SF).collect()
    assert sorted(str(r["n_chars"]) for r in clean) == sorted(str(len(r["text"])) if r["text"] is not None else "None" for r in clean)
    assert [r["text"][-16:] for r in clean if r["doc_id"] is None] == ["write to <EMAIL>"] * 2 and [r["text"] for r in clean if r["doc_id"] == 4] == [None]
    encoded = corpus_pipeline.sentence_pieces(spark, docs, SF)
    assert {r["doc_id"]: len(r["ids"]) for r in encoded.collect() if r["doc_id"] in (4, 5)} == {4: 0, 5: 0}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == list(corpus_pipeline.COLUMNS)


def test_stages_of_an_empty_table(spark):
    docs = documents(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_a_group_without_ids_keeps_one(spark):
    text = "A long sentence that three documents share and none of them has a number to be known by"
    docs = documents(spark, [(None, text, "en"), (None, text + ".", "en"), (None, text, "en"), (None, "Another one that nobody shares at all", "en")])
    kept = [r["text"] for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()]
    assert kept.count(text) <= 1 and "Another one that nobody shares at all" in kept
    assert len(kept) == len({fingerprint(t) for t in kept})


def test_run_leaves_only_the_last_stage(spark):
    before = set(map(str, _folders(spark)))
    assert corpus_pipeline.run(spark, SF).count() > 100
    new = [p for p in _folders(spark) if str(p) not in before]
    assert [p.name for p in new] == [str(len(corpus_pipeline.STAGES) - 1)]


def _folders(spark):
    root = Path(checkpoint_folder(spark).removeprefix("file:"))
    return [p for x in root.glob("pipeline-*") for p in x.iterdir()]
