"""The pipeline and its stages on odd rows: no documents, no benchmark, null ids, repeated rows, columns of any name."""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerloom.llm import decontamination, language_id, similarity_join

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
R = np.random.default_rng(5)
VOCABULARY = [a + b for a in "ba ce di fo gu le".split() for b in "na ro st".split()]


def prose(n: int) -> str:
    return " ".join(R.choice(VOCABULARY, n))


def stored(spark, path, rows: list[tuple], items: list[tuple]) -> str:
    docs = spark.createDataFrame(rows, SCHEMA)
    for name in ("id", "row", "d", "key", "part", "words", "j", "label", "a.b", "x`y", "d.e"):  # names that the stages use themselves, and odd ones
        docs = docs.withColumn(name, F.lit("clash"))
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_pipeline_without_rows(spark, tmp_path) -> None:
    assert corpus_pipeline.run(spark, stored(spark, tmp_path / "a", [], [])).count() == 0
    assert corpus_pipeline.run(spark, stored(spark, tmp_path / "b", [(1, None, None, None, None), (2, "", "en", "s", 0)], [(1, "x")])).count() == 0


def test_pipeline_of_odd_rows(spark, tmp_path) -> None:
    texts = [prose(60) for _ in range(12)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)] + [(0, texts[0], "en", "s", 1)] * 3 + [(None, texts[1], None, None, None), (None, prose(40), None, None, None), (None, None, None, None, None), (50, prose(3000), None, "s", 9)]
    sf = stored(spark, tmp_path, rows, [])
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf)
        assert after.columns == docs.columns and after.where("label <> 'clash' or d <> 'clash'").isEmpty()
        docs = after
    got = Counter(r["doc_id"] for r in corpus_pipeline.run(spark, sf).where("piece = 0").collect())
    assert got == Counter([*range(12), 50, None])


def test_labels_fill_nulls_where_they_are_sure(spark) -> None:
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("j", F.lit("clash"))
    model = language_id.fit(d, ~language_id.held_out("doc_id"))
    blank = d.withColumn("was", F.col("lang")).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, F.col("lang"))).where("length(text) > 300")
    got = language_id.in_learned_languages(blank, model, label_col="lang").collect()
    filled = [r for r in got if r["doc_id"] % 2 and r["was"]]
    assert sum(r["lang"] == r["was"] for r in filled) > 0.9 * len(filled) and all(r["lang"] == r["was"] for r in got if r["doc_id"] % 2 == 0)


def test_equal_and_long_texts_are_judged_alike(spark) -> None:
    rows = [(i, f"the text {i} of many", "en") for i in range(60)] + [(100 + i, f"le texte {i} de tous", "fr") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(docs, F.lit(True))
    odd = spark.createDataFrame([(1, "the text " * 40_000), (2, "the text"), (3, "the text"), (4, "12 34"), (5, "ß")], "doc_id long, text string").withColumn("lang_pred", F.lit("clash")).withColumn("score", F.lit("clash")).withColumn("a.b", F.lit(1))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.predict(odd, model, keep=("doc_id", "a.b")).collect()}
    assert got[1][0] == "en" and got[2] == got[3] and got[4] == ("und", 0.0) and got[5][0] in ("en", "fr")


def test_clashing_names_in_single_stages(spark) -> None:
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (3, "x")], "doc_id long, text string").withColumns({n: F.lit("clash") for n in ("key", "row", "d", "__own", "__md5", "__id", "gone", "own", "mark", "a.b", "x`y")})
    kept = similarity_join.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 3]
    bench = spark.createDataFrame([(1, "b c")], "item_id long, text string").withColumn("w", F.lit("clash"))
    clean = decontamination.decontaminate(docs, bench)
    assert clean.columns == docs.columns and [r["doc_id"] for r in clean.collect()] == [3]
