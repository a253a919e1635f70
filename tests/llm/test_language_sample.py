"""The rows that the language model learns from: bounded in number, with and without ids, some of every label."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import language_id

SCHEMA = "doc_id long, text string, lang string"


@pytest.fixture
def learned(monkeypatch) -> list[list]:
    seen: list[list] = []
    train = language_id.train
    monkeypatch.setattr(language_id, "train", lambda rows, idf: seen.append(rows) or train(rows, idf))
    return seen


def test_sample_is_bounded_in_rows_and_has_every_label(spark, learned) -> None:
    rows = [(7 if i % 3 == 0 else i, f"text {i} of many", "en") for i in range(3000)] + [(10_000 + i, f"otro {i}", "es") for i in range(3)] + [(1, "same row", "en")] * 50
    model = language_id.fit(spark.createDataFrame(rows, SCHEMA), F.lit(True), train_rows=60)
    assert Counter(r[2] for r in learned[0]) == {"en": 57, "es": 3}
    assert model.labels == ["en", "es"]


def test_rows_without_id_are_learned_from(spark, learned) -> None:
    rows = [(None, f"the text {i}", "en") for i in range(40)] + [(None, f"le texte {i}", "fr") for i in range(40)]
    docs = spark.createDataFrame(rows, SCHEMA)
    model = language_id.fit(docs, ~language_id.held_out("doc_id"))
    assert len(learned[0]) == 80
    assert {r["lang_pred"] for r in language_id.predict(docs, model).collect()} == {"en", "fr"}
