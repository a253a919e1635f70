"""Block trees of odd texts, the nearest smaller row before against a plain search, and checks of whole documents."""

from __future__ import annotations

import random
import re

import pytest

from ledgerloom.operators import findings as N
from ledgerloom.operators import tree


@pytest.fixture(autouse=True)
def shared(spark, tmp_path) -> None:
    spark.sparkContext.setCheckpointDir(str(tmp_path / "shared"))


def docs_of(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def nodes(df, doc=0):
    return {r["node"]: (r["parent"], r["kind"], r["text"]) for r in df.where(f"doc_id = {doc}").collect()}


def test_nearest_smaller_row_before(spark) -> None:
    rng = random.Random(4)
    rows = [(g, i, rng.randint(0, 9)) for g in range(20) for i in range(rng.randint(1, 40))]
    got = {(r["g"], r["i"]): r["above"] for r in tree.under(spark.createDataFrame(rows, "g int, i int, v int"), ["g"], "i", "v").collect()}
    for g, i, v in rows:
        assert got[g, i] == max((j for h, j, w in rows if h == g and j < i and w < v), default=None)


def test_lists_quotes_tables_and_headings(spark) -> None:
    text = "# A\n- one\n  - two\n\t\t* four\n  - three\n1. five\n- six\n\n- apart\n### C\n> q\n>> deep\n> r\n## B\n**表1-2 cap**\n\n| a | b |\n|---|---|\n| 1 | 2 |\n*来源：x*\nlast\nlines"
    got = nodes(tree.blocks(docs_of(spark, text)))
    assert got[2] == (None, "heading", "A") and got[20] == (2, "heading", "C") and got[28] == (2, "heading", "B")
    assert got[4] == (2, "list", None) and got[5] == (4, "item", "one") and got[7] == (5, "item", "two") and got[9] == (7, "item", "four") and got[11] == (5, "item", "three")
    assert got[12] == (2, "ordered", None) and got[13] == (12, "ordered_item", "five") and got[14] == (2, "list", None) and got[15] == (14, "item", "six")
    assert got[18] == (2, "list", None)  # a blank line parts lists
    assert got[22] == (20, "quote", "q") and got[24] == (22, "quote", "deep") and got[26] == (20, "quote", "r")
    assert got[34] == (28, "table", None) and got[31] == (34, "caption", "**表1-2 cap**") and got[35] == (34, "row", "| a | b |") and got[39] == (34, "row", "| 1 | 2 |") and got[41] == (34, "source", "*来源：x*")
    assert got[42] == (28, "paragraph", "last\nlines") and len(got) == 23


def test_odd_texts(spark) -> None:
    t = tree.blocks(docs_of(spark, None, "", " \n\n", "```\nopen", "```\na\n```\n```\nb\n```", "#no heading\n####### seven", "- " * 3 + "x", "|\n|"))
    assert t.where("doc_id < 3").count() == 0
    assert {k: v[1] for k, v in nodes(t, 3).items()} == {2: "paragraph"}  # a fence without its partner protects nothing
    assert {k: v[1:] for k, v in nodes(t, 4).items()} == {2: ("fence", "```\na\n```"), 8: ("fence", "```\nb\n```")}
    assert {v[1] for v in nodes(t, 5).values()} == {"paragraph"}
    assert nodes(t, 6)[3] == (2, "item", "- - x")
    assert sorted(v[1] for v in nodes(t, 7).values()) == ["row", "row", "table"]


def test_neighbours_tell_blocks(spark) -> None:
    text = "\t```\n*来源：a*\n|t|\n*来源：b*\nnext\n\n**表1-1 c**\n\n|u|\n|-|\n\n*来源：d*\n```\n\n```\n```\nx\n```\n#### deep\n### up\n> q\n> r\n>> s"
    got = nodes(tree.blocks(docs_of(spark, text)))
    assert got[2] == (None, "paragraph", "```\n*来源：a*")  # a tab makes no fence, and a source stands behind its table
    assert got[6] == (None, "table", None) and got[7] == (6, "row", "|t|") and got[9] == (6, "source", "*来源：b*") and got[10] == (None, "paragraph", "next")
    assert got[15] == (18, "caption", "**表1-1 c**") and got[19] == (18, "row", "|u|") and got[25] == (18, "source", "*来源：d*") and 21 not in got
    assert got[26] == (None, "fence", "```\n\n```") and got[32] == (None, "fence", "```\nx\n```")
    assert got[38] == (None, "heading", "deep") and got[40] == (None, "heading", "up") and got[42] == (40, "quote", "q\nr") and got[46] == (42, "quote", "s")


def operators_of(df) -> list[str]:
    plan = df._jdf.queryExecution().executedPlan()
    return [line.strip(" :+-*()0123456789").split(" ")[0] for line in plan.toString().split("\n")]


def test_lines_are_read_by_three_windows(spark) -> None:
    """Each window passes over all lines; one that looks ahead to the end takes the square of a text's lines."""
    plan = tree._kinds(docs_of(spark, "a"), "doc_id", "text")
    assert operators_of(plan).count("Window") <= 3
    assert "1, unboundedfollowing$()" not in plan._jdf.queryExecution().toString()


def test_checks_stay_in_the_documents_row(spark) -> None:
    """Checks neither shuffle nor sort a document's lines; only faults are shuffled, against the files."""
    docs = docs_of(spark, "## 第2章 A\n![图1-2 x](a.png)")
    count = lambda df, *names: sum(o in names for o in operators_of(df))
    assert count(tree.checked(docs), "Exchange", "Window", "Sort", "SortMergeJoin", "BroadcastHashJoin") == 0
    files = spark.createDataFrame([(1, "a.png")], "doc_id long, path string")
    assert count(tree.checked(docs, files), "SortMergeJoin", "BroadcastHashJoin", "ShuffledHashJoin") == 1


def test_words_are_asked_for_by_their_characters() -> None:
    """A line without any of these characters is not looked at, so each word must have one."""
    words = ["图1-1", "上表", *N.SECRECY_WEAK.replace("(?<!高度)", "").replace("(?<!跨)", "").split("|")]
    assert all(re.search(tree.ASKED, w) for w in words) and all(re.search("[密内]", w) for w in words[2:])


def test_pieces_of_odd_documents(spark) -> None:
    """Blocks give their first line, tabs and quotes' depths part them, captions count by their table, and a caption before no table is prose."""
    text = "## 第1章 A\n\n\tsee 图01-1\nand 图1-1 and 表1-9\n> 上图\n>> 下表\n>> 内部资料\n\n![图1-1 a](x.png)\n\n**表1-1 c**\n\n| 图1-5 |\n*来源：图1-6*\n**表1-2 no table**\n```\n图1-8\n```\n## 附录b\n图1-1：last\nmore\n\n图1-1：x\n## 1、again"
    files = spark.createDataFrame([(0, "x.png")], "doc_id long, path string")
    assert findings(tree.checked(docs_of(spark, text), files)) == sorted([
        ("W-REF-03", 3, "表1-9", "not there"), ("W-REF-04", 5, "上图", "points by place"), ("W-REF-04", 6, "下表", "points by place"), ("W-CLN-01", 6, "内部资料", "mark of secrecy"),
        ("W-REF-01", 13, "表1-1", "never mentioned"), ("W-REF-03", 15, "表1-2", "not there"), ("W-HDR-02", 19, "附录b", "expected 1"), ("W-HDR-01", 24, "1、again", "expected 2"), ("W-HDR-01", 24, "1、again", "again"),
    ])


def findings(df, doc=0):
    return sorted((r["code"], r["line_no"], r["element"], r["detail"]) for r in df.where(f"doc_id = {doc}").collect() if r["code"] != "W-TTL-01")


def test_whole_documents(spark) -> None:
    good = "# T\n**页眉简称**：S\n\n## 第一章 A\n见图1-1与表1-1。\n![图1-1 x](a.png \"t\")\n**表1-1 c**\n| a |\n|---|\n| b |\n## 2、B\n文中图2-1\n![图2-1 y](b.png)\n图2-1：y\n## 附录A x\n图9-9\n## 附录B"
    bad = "## 第2章 A\n![图1-2 x](a.png)\n![图1-2 z](c.png)\n- 内部资料 表3-1\n  - 图1-2\n> 以下图 下图\n\n图1-7 alone\n## 附录B\n机密\n## 附录B"
    files = spark.createDataFrame([(0, "a.png"), (0, "b.png"), (1, "a.png")], "doc_id long, path string")
    got = tree.checked(docs_of(spark, good, bad, None), files)
    assert findings(got) == [] and got.where("doc_id = 0").count() == 0
    assert findings(got, 1) == sorted([
        ("E-IMG-01", 3, "c.png", "no file"), ("W-IMG-06", 2, "图1-2", "expected 1"), ("W-IMG-05", 3, "图1-2", "again"), ("W-IMG-04", 2, "图1-2", "in chapter 2"), ("W-IMG-04", 3, "图1-2", "in chapter 2"),
        ("W-HDR-01", 1, "第2章 A", "expected 1"), ("W-HDR-02", 9, "附录B", "expected 1"), ("W-HDR-02", 11, "附录B", "again"), ("W-REF-02", 2, "图1-2", "first mentioned in line 5"),
        ("W-REF-03", 4, "表3-1", "not there"), ("W-REF-03", 8, "图1-7", "not there"), ("W-REF-03", 8, "图1-7 alone", "no figure next to it"), ("W-REF-04", 6, "下图", "points by place"),
        ("W-CLN-01", 4, "内部资料", "mark of secrecy"), ("W-CLN-01", 10, "机密", "mark of secrecy"),
    ])
    assert [tuple(r) for r in got.where("doc_id = 2").collect()] == [(2, "W-TTL-01", None, "页眉简称", "not given")]
