"""Precedence, metadata of odd texts, and first matches against a search rule by rule."""

from __future__ import annotations

import random
import re

from ledgerloom.operators import rules


def test_precedence(spark) -> None:
    rows = [(1, "a", " x ", "cli"), (1, "a", "y", "text"), (1, "b", " ", "text"), (1, "b", "z", "yaml"), (2, "a", "q", "nobody"), (2, "c", None, "text"), (3, "a", "n", "cli"), (3, "a", "m", "cli")]
    got = {tuple(r) for r in rules.precedence(spark.createDataFrame(rows, "doc_id int, name string, value string, origin string")).collect()}
    assert got == {(1, "a", "y", "text"), (1, "b", "z", "yaml"), (3, "a", "m", "cli")}


def test_metadata_of_odd_texts(spark) -> None:
    texts = [None, "", "no title", "# T\n**版本**：V2｜ May\n**版本**：V3 | June\n**其他**：x\nbody\n**副标题**：late", "# A\n## B\n**副标题**：closed", "# 长" + "长" * 30]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    given = spark.createDataFrame([(0, "title_short", "S", "cli"), (4, "date", "2020", "yaml")], "doc_id int, name string, value string, origin string")
    got = {r["doc_id"]: tuple(r)[1:] for r in rules.metadata(docs, given).collect()}
    none = (None,) * 4
    assert got[0] == (None, "S", *none, None) and got[1] == got[2] == (None, None, *none, None)
    assert got[3] == ("T", "T", None, None, None, "V3", "June") and got[4] == ("A", "A", *none, "2020") and got[5][1] == "长" * 20
    assert [tuple(r) for r in rules.unknown_names(docs).collect()] == [(3, 4, "其他")]


def test_first_match_equals_a_search_rule_by_rule(spark) -> None:
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abAB -") for _ in range(n))
    table = [(i, p, f"r{i}") for i, p in enumerate([word(rng.randint(1, 5)) for _ in range(25)] + ["^b.*a$", "a{3}", "B|aa"])]
    rng.shuffle(table)
    values = [(i, rng.choice([None, "", word(rng.randint(1, 12))])) for i in range(150)] + [(7, "ab"), (7, "ab")]
    got = sorted(map(tuple, rules.first_match(spark.createDataFrame(values, "k int, v string"), spark.createDataFrame(table, "place int, pattern string, rule string"), "k", "v", "none").collect()), key=repr)
    want = sorted(((k, v, next((r for _, p, r in sorted(table) if v is not None and re.search(p, v, re.I)), "none")) for k, v in values), key=repr)
    assert got == want


def test_a_texts_own_lines_are_read_in_its_row(spark) -> None:
    docs = spark.createDataFrame([(1, "# T\n**版本**：V1\n**版本**：V2\n**副标题**：own")], "doc_id int, text string")
    given = spark.createDataFrame([(1, "subtitle", "cli", "cli"), (1, "subtitle", "aaa", "text"), (1, "date", "2020", "yaml")], "doc_id int, name string, value string, origin string")
    got = rules.metadata(docs, given)
    assert [tuple(r) for r in got.collect()] == [(1, "T", "T", "aaa", None, None, "V2", "2020")]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window ") == 0 and plan.count("Join ") == 1 and plan.count("Aggregate ") == 1
