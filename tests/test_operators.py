"""Operators on small Markdown, CSV, JSON, XML and PNG fixtures of our own; expected findings follow from the rules."""

from __future__ import annotations

import struct

from pyspark.sql import functions as F

from ledgerloom.functions import text as T
from ledgerloom.operators import contract, overlap
from ledgerloom.operators import lines as L
from ledgerloom.operators import references as R
from ledgerloom.sources import readers


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def one(df, expr):
    return df.select(expr.alias("x")).first()["x"]


MD = "# 题\n单位：某\n\n```\n# code\n```\n## 章\n| a | b |\n|---|---|\n| 1 | 2 |\n- x\n- y\n> 引\n正文 \"一\" 与\n![图1-1 x](figures/a.png)\n---\n```\n# open"


def test_line_kinds_and_fences(spark) -> None:
    kinds = [r["kind"] for r in L.classified(docs(spark, MD)).orderBy("line_no").collect()]
    assert kinds[:7] == ["heading", "paragraph", "blank", "fence", "fence", "fence", "heading"]
    assert kinds[7:16] == ["table", "table", "table", "list", "list", "quote", "paragraph", "figure", "rule"]
    assert kinds[-1] == "heading"  # a fence that never closes protects nothing


def test_tables_metadata_blocks_quotes(spark) -> None:
    rows = L.classified(docs(spark, MD))
    cells = {(r["row"], r["col"]): r["cell"] for r in L.table_cells(rows).collect()}
    assert cells == {(1, 1): "a", (1, 2): "b", (2, 1): "1", (2, 2): "2"}
    assert [(r["name"], r["value"]) for r in L.metadata_lines(rows).collect()] == [("单位", "某")]
    turned = [r["text"] for r in L.quotes(rows).orderBy("line_no").collect()]
    assert "正文 “一” 与" in turned
    left = [r["text"] for r in L.without_blocks(rows, "章").orderBy("line_no").collect()]
    assert "- x" not in left and "# 题" in left
    assert [r["text"] for r in L.demoted(rows, 5).where("kind = 'heading'").orderBy("line_no").collect()][:2] == ["###### 题", "###### 章"]


def test_paragraphs(spark) -> None:
    text = "甲甲\n# 标题\n乙\n\n丙丙丙\n\nabc\n"
    got = [(r["paragraph"], r["text"], r["chars"]) for r in L.paragraphs(docs(spark, text, None, "")).orderBy("paragraph").collect()]
    assert got == [(1, "甲甲乙", 3), (2, "丙丙丙", 3)]
    stats = L.paragraph_stats(L.paragraphs(docs(spark, text))).first()
    assert (stats["count"], stats["p25"], stats["longest"], stats["under_150"]) == (2, 3, 3, 2)


def test_text_functions(spark) -> None:
    df = spark.createDataFrame([(7,), (10,), (15,), (20,), (105,), (110,), (111,), (999,)], "n int")
    shown = [r["c"] for r in df.select(T.chinese_numeral(F.col("n")).alias("c")).collect()]
    assert shown == ["七", "十", "十五", "二十", "一百零五", "一百一十", "一百一十一", "九百九十九"]
    back = df.select("n", T.from_chinese_numeral(T.chinese_numeral(F.col("n"))).alias("m")).collect()
    assert all(r["n"] == r["m"] for r in back)
    base = docs(spark, "见[CM021]**某** x\n y")
    assert one(base, T.overlap_clean(F.col("text"))) == "见某xy"
    assert one(base, T.html_text(F.lit("a<br/>b</p>c&lt;<i>d</i>"))) == "a\nb\nc<d"
    assert one(base, T.half_width_cut(F.lit("ab中文"), 4)) == "ab中"
    assert one(base, T.build_date(F.lit("2026年7月"), F.lit(None).cast("string"))) == "2026-07-01"
    assert sorted(one(base, T.tokens(F.lit("Go go x1 中文字")))) == ["go", "x1", "中文", "文字"]
    assert one(base, F.size(T.char_ngrams(F.lit("abcab"), 2))) == 3


def test_contract(spark) -> None:
    good, bad = "### 节\n正文[SRC-001]。", "# a\n## 1. b\n[1] [S12] 绝密 [CL-1]\n**一一一一**\n**二二二二**\n**三三三三**\n### 参考文献"
    found = {(r["doc_id"], r["rule"]): r["passed"] for r in contract.verdicts(docs(spark, good, bad)).collect()}
    assert all(v for (d, _), v in found.items() if d == 0)
    assert {r for (d, r), v in found.items() if d == 1 and not v} == {"C1", "C2", "C5", "C6", "C9", "C12", "C20"}
    merged = "---\na: 1\n---\n# a\n## 第 1 章：绪论\n文[1]\n## 参考文献\n"
    final = {r["rule"]: r["passed"] for r in contract.verdicts(docs(spark, merged), merged=True, stage="stage9").collect()}
    assert all(final.values())
    total = {r["doc_id"]: r["passed"] for r in contract.overall(contract.verdicts(docs(spark, good, bad))).collect()}
    assert total == {0: True, 1: False}
    files = spark.createDataFrame([("a.png",)], "file string")
    assert [r["ref"] for r in contract.missing_images(docs(spark, "![x](figures/a.png) ![y](figures/b.png)"), files).collect()] == ["b.png"]


def test_overlap_is_exact_not_greedy(spark) -> None:
    passage = "".join(chr(0x4E00 + i) for i in range(60))
    report = passage[:12] + "断" + passage + "尾"
    found = overlap.longest(spark.createDataFrame([(1, passage), (2, "短")], "card long, text string"), docs(spark, report), card_id="card", report_id="doc_id").collect()
    assert [(r["card"], r["chars"], r["fragment"], r["kind"]) for r in found] == [(1, 60, passage, None)]
    s = overlap.summary(spark.createDataFrame([(0, 1, 45, None), (0, 2, 46, None), (0, 3, 50, "latin")], "doc_id long, card long, chars long, kind string"), "doc_id").first()
    assert (s["overlaps"], s["hits"], s["own_hits"], s["blocked"]) == (3, 2, 1, False)


def test_references(spark) -> None:
    d = docs(spark, "甲[SRC-2, SRC-1]乙[SRC-2]", "丙[SRC-9] [CL-3]  丁")
    numbers = R.numbers_by_first_use(R.mentions(d), "source_id", "doc_id", "at", "inside")
    assert {r["source_id"]: r["number"] for r in numbers.collect()} == {"SRC-2": 1, "SRC-1": 2, "SRC-9": 3}
    texts = {r["doc_id"]: r["text"] for r in R.with_numbers(d, numbers).collect()}
    assert texts == {0: "甲[1, 2]乙[1]", 1: "丙[3] 丁"}
    src = spark.createDataFrame([("SRC-1", "T", "A", "P", "2020", "book", "")], "source_id string, title string, author_or_org string, publisher string, publish_date string, source_type string, url_or_path string")
    entries = {r["number"]: (r["entry"], r["missing"]) for r in R.bibliography(numbers, src).collect()}
    assert entries[2] == ("[2] A. T[M]. P, 2020.", False) and entries[1][1]


def test_ledger_and_graphs(spark, tmp_path) -> None:
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    ev = spark.createDataFrame([("a", 1, "significant", False), ("a", 2, "significant", False), ("b", 1, "minor", False), ("c", 1, "significant", False)], "event_id string, ts long, level string, acknowledged boolean")
    state = R.ledger_state(ev, spark.createDataFrame([("a",)], "event_id string"))
    s = R.ledger_summary(state).first()
    assert (s["total"], s["significant"], s["open_significant"], s["blocking"]) == (3, 2, 1, True)
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 9)] + [(20, 21), (21, 20)], "source long, target long")
    comp = {r["node"]: r["component"] for r in R.components(edges).collect()}
    assert comp == {**dict.fromkeys(range(1, 10), 1), 20: 20, 21: 20}
    cells = spark.createDataFrame([("d", "a", "b"), ("d", "b", "a"), ("d", "c", "a")], "doc_id string, id string, parent string")
    found = {(r["id"], r["ancestor"]) for r in R.ancestors(cells).collect()}
    assert ("c", "b") in found and ("a", "a") in found  # a cycle of parents ends


def test_scope_and_numbers(spark) -> None:
    df = spark.createDataFrame([("第2-4章", 3), ("第2-4章", 5), ("全报告", 9), ("随意", 1), ("第1章", None)], "scope string, n int")
    assert [r["x"] for r in df.select(R.scope_covers(F.col("scope"), F.col("n")).alias("x")).collect()] == [True, False, True, True, True]
    rows = spark.createDataFrame([(1, i, lv) for i, lv in enumerate([1, 2, 3, 3, 2, 1, 2, 0, 0])], "doc long, pos long, level int")
    assert [r["number"] for r in R.hierarchical_numbers(rows, "doc", ["pos"]).orderBy("pos").collect()] == ["1", "1.1", "1.1.1", "1.1.2", "1.2", "2", "2.1", "A", "B"]


def test_readers(spark, tmp_path) -> None:
    (tmp_path / "a.md").write_bytes(b"\xef\xbb\xbfx\r\ny\xff")
    assert readers.texts(spark, str(tmp_path)).first()["text"] == "x\ny�"
    bad = readers.encoding_report(spark, str(tmp_path), "*.md").first()
    assert (bad["has_bom"], bad["crlf"], bad["lone_cr"], bad["valid"]) == (True, 1, 0, False)
    (tmp_path / "s.csv").write_text("title,source_id\nT1,S1\nT2,S1\nT3,\n")
    rows = readers.source_index(spark, str(tmp_path / "s.csv")).collect()
    assert [(r["source_id"], r["title"], r["publisher"]) for r in rows] == [("S1", "T2", "")]
    (tmp_path / "e.jsonl").write_text('{"event_id":"a","level":"x","acknowledged":false}\n{bad\n\n{"record_type":"acknowledgement","event_id":"a"}\n')
    events, acks = readers.event_log(spark, str(tmp_path / "e.jsonl"))
    assert events.count() == 1 and acks.count() == 1
    (tmp_path / "p.png").write_bytes(bytes.fromhex(readers.PNG_MAGIC) + b"\0\0\0\rIHDR" + struct.pack(">II", 1200, 800) + b"\0" * 9)
    png = readers.png_sizes(spark, str(tmp_path)).first()
    assert (png["valid"], png["width"], png["height"]) == (True, 1200, 800)
    (tmp_path / "d.xml").write_text('<g><root><mxCell id="1" vertex="1" style="group"><mxGeometry x="1" y="2" width="3" height="4"/></mxCell><mxCell id="2" parent="1" edge="1"/></root></g>')
    cells = {r["id"]: r["width"] for r in readers.diagram_cells(spark, str(tmp_path / "d.xml")).collect()}
    assert cells == {"1": "3", "2": None}
    terms = readers.glossary(docs(spark, "x\n```yaml\n- term_id: G1\n  preferred_form: 甲\n  banned_forms: [乙, ab]\n```\n")).collect()
    assert [(r["term_id"], r["banned_forms"]) for r in terms] == [("G1", ["乙", "ab"])]
    hits = R.banned_forms(docs(spark, "有乙 abc", "ab"), spark.createDataFrame([("G1", ["乙", "ab"])], "term_id string, banned_forms array<string>")).collect()
    assert {(r["doc_id"], r["form"]) for r in hits} == {(0, "乙"), (1, "ab")}


def test_yaml_that_cannot_be_read_has_no_entry(spark) -> None:
    good = "exemptions:\n- {file: f, check: G2_overlap, cells: [a], reason: 2024-02-30x}"
    texts = [good, good, good.replace("x}", "}"), "exemptions: [1: 2", "? [a]\n: b", None, "", "[" * 2000, "[" * 100_000]
    found = readers.exemptions(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()
    assert [(r["doc_id"], r["file"], r["reason"]) for r in sorted(found)] == [(0, "f", "2024-02-30x"), (1, "f", "2024-02-30x")]
