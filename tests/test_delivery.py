"""References of odd texts against a plain search, and the checklist with and without its sources."""

from __future__ import annotations

import random
import re

import pytest

from ledgerloom.operators import delivery


@pytest.fixture(autouse=True)
def shared(spark, tmp_path) -> None:
    spark.sparkContext.setCheckpointDir(str(tmp_path / "shared"))


def plain(text: str | None) -> tuple:
    m = re.search(r"(?m)^#{1,3}\s+参考文献\s*$", text or "")
    body, tail = (text or "", None) if m is None else (text[: m.start()], text[m.end() :])
    cited = {int(x) for b in re.findall(r"\[\d+(?:\s*,\s*\d+)*\]", body) for x in re.findall(r"\d+", b)}
    if tail is None:
        return ("fail" if cited else "pass", [], [], [])
    entries = [int(e[1]) for line in tail.split("\n") if (e := re.match(r"\[(\d+)\]", line.strip()))]
    out = [sorted(cited - {*entries}), sorted({*entries} - cited), sorted({e for e in entries if entries.count(e) > 1})]
    return ("fail" if any(out) else "pass", *[[*map(str, x)] for x in out])


def test_references_equal_a_plain_search(spark) -> None:
    rng = random.Random(5)
    piece = lambda: rng.choice(["[1]", "[2, 10]", "[03]", "[x]", "[ 4]", "\n[2] b", "\n [10] c", "\n[1] a [7]", "\n## 参考文献", "\n# 参考文献 ", "\n#### 参考文献", "\n## 参考文献 x", "\n"])
    texts = [None, "", "## 参考文献"] + ["a" + "".join(piece() for _ in range(rng.randint(1, 12))) for _ in range(150)]
    got = {r["doc_id"]: tuple(r)[1:] for r in delivery.references(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()}
    assert got == {i: plain(t) for i, t in enumerate(texts)}


def test_checklist_of_odd_texts(spark) -> None:
    docs = spark.createDataFrame([(1, None), (2, "# T\n[SRC-1, SRC-2]\n## 作者自声明\n> [阶段9 x]\nbad form"), (3, "# T\ngood form")], "doc_id int, text string")
    got = {(r["doc_id"], r["item"]): r["status"] for r in delivery.checklist(docs).collect()}
    assert len(got) == 3 * len(delivery.ITEMS) and {got[i, "01"] for i in (1, 2, 3)} == {"skipped"}
    assert [i for i in delivery.ITEMS if got[2, i] == "fail"] == ["03", "06", "07"] and got[3, "11"] == got[1, "12"] == delivery.MANUAL and got[1, "13"] == "pass"
    glossary = spark.createDataFrame([("t", ["bad form"])], "term_id string, banned_forms array<string>")
    core = spark.createDataFrame([("t", "good form")], "term_id string, preferred_form string")
    gate, ledger = spark.createDataFrame([(3, True)], "doc_id int, passed boolean"), spark.createDataFrame([(True,)], "blocking boolean")
    full = {(r["doc_id"], r["item"]): r["status"] for r in delivery.checklist(docs, glossary, core, gate, ledger).collect()}
    assert full[2, "01"] == "fail" and full[3, "01"] == "pass" and full[3, "04"] == "pass" and full[2, "04"] == "fail" and {full[i, "13"] for i in (1, 2, 3)} == {"fail"}
    assert delivery.checklist(docs.limit(0)).count() == 0


def test_what_a_text_tells_needs_no_join(spark) -> None:
    plan = delivery.checklist(spark.createDataFrame([(1, "x [SRC-1]")], "doc_id int, text string"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
