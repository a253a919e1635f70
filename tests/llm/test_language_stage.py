"""The pipeline's language stage on planted rows: what no learned language has goes, clean texts stay."""

from __future__ import annotations

import base64

import numpy as np

import corpus_pipeline
from ledgerloom.llm import language_id

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
R = np.random.default_rng(11)


def planted() -> tuple[list[str], list[str]]:
    letters = list("abcdefghijklmnopqrstuvwxyz")
    gibberish = " ".join("".join(R.choice(letters, int(n))) for n in R.integers(3, 9, 120))
    markup = "".join(f'<{"".join(R.choice(letters, 6))} q{i}="zx{i}kj"/>' for i in range(60))
    foreign = ["Это предложение написано по русски и повторяется. " * 12, "漢字仮名交じり文で書かれた長い文章。" * 20]
    return [gibberish, gibberish.upper(), base64.b64encode(R.bytes(600)).decode(), markup, *foreign], ["Zq xv jk", "Привет, мир", "a", "The and"]


def test_language_stage_drops_long_foreign_texts(spark) -> None:
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    clean = docs.where("text is not null").count()
    bad, short = planted()
    # held out, so that nothing is learned from them
    ids = [r[0] for r in spark.range(10**6, 10**6 + 200).where(language_id.held_out("id")).collect()]
    rows = [(i, t, "en", "s", len(t)) for i, t in zip(ids, bad + short, strict=False)]
    both = docs.select(*SCHEMA.replace(" long", "").replace(" string", "").split(", ")).unionByName(spark.createDataFrame(rows, SCHEMA))
    got = corpus_pipeline.identify_language(spark, both, SF).collect()
    found = {r["doc_id"] for r in got}
    assert found & set(ids) == set(ids[len(bad) : len(bad) + len(short)])
    assert sum(r["doc_id"] < 10**6 for r in got) == clean - docs.where("text is not null and not text rlike '[a-zA-Zà-ÿÀ-Ý]'").count()


def test_language_stage_without_a_model_keeps_letters(spark) -> None:
    bad, short = planted()
    rows = [(i, t, None, "s", len(t)) for i, t in enumerate(bad + short)] + [(90, "12 !", None, "s", 4), (91, None, None, "s", None)]
    got = corpus_pipeline.identify_language(spark, spark.createDataFrame(rows, SCHEMA), SF).collect()
    assert {r["doc_id"] for r in got} == set(range(len(bad) + len(short)))
