"""Diagrams, audits, outlines, figures and the ledger stream, on small fixtures of our own; expected findings follow from the rules."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import audits as A
from ledgerloom.operators import diagrams as D
from ledgerloom.operators import figures as G
from ledgerloom.operators import outlines as O
from ledgerloom.streaming import ledger

CELLS = "doc_id string, id string, value string, style string, vertex string, edge string, parent string, source string, target string, x string, y string, width string, height string, relative string, has_geometry boolean"


def cell(id, doc="1-1-a", value=None, style=None, vertex="1", parent=None, source=None, target=None, at=("0", "0", "10", "10"), edge=None, geometry=True):
    return (doc, id, value, style, vertex, edge, parent, source, target, *at, None, geometry)


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


@pytest.fixture(autouse=True)
def shared(spark, tmp_path) -> None:
    spark.sparkContext.setCheckpointDir(str(tmp_path / "shared"))


def test_geometry(spark) -> None:
    cells = spark.createDataFrame([cell("a", at=(None, "1", "2", "3")), cell("b", at=("x", "nan", None, "1e2")), cell("c", geometry=False), cell("d", vertex=None, at=(None,) * 4)], CELLS)
    assert rows(D.geometry_faults(cells), "id", "attr", "literal") == [("b", "width", None), ("b", "x", "x"), ("b", "y", "nan"), ("c", "mxGeometry", None)]


def test_overlaps_against_all_pairs(spark) -> None:
    pick = random.Random(5)
    put = [(str(i), *(pick.choice([0, 3, 64, pick.randint(-200, 900)]) for _ in "xy"), pick.choice([5, 64, 300, 2000]), pick.choice([5, 40, 128])) for i in range(60)]
    cells = spark.createDataFrame([cell(i, at=tuple(map(str, at))) for i, *at in put] + [cell("s", style="swimlane"), cell("t", parent="s"), cell("e", style="edgeLabel")], CELLS)
    found = D.overlaps(D.boxes(cells), D.in_containers(cells))
    want = set()
    for (a, ax, ay, aw, ah), (b, bx, by, bw, bh) in itertools.combinations(sorted(put), 2):
        ox, oy = min(ax + aw, bx + bw) - max(ax, bx), min(ay + ah, by + bh) - max(ay, by)
        if ox > 0 and oy > 0:
            want.add((a, b, "error" if min(ox, oy) >= 3 else "warning"))
    assert rows(found, "a", "b", "severity") == sorted(want, key=repr) and want


def test_ink(spark) -> None:
    cells = spark.createDataFrame([cell("a", value="甲b<br>c", style="fontSize=10;align=left", at=("0", "0", "100", "100")), cell("b", value="", at=("90", "0", "50", "50"))], CELLS)
    box = {r["id"]: r for r in D.boxes(cells).collect()}
    assert box["a"]["ink_x2"] == pytest.approx(15.5 * 1.15) and box["a"]["ink_y2"] - box["a"]["ink_y"] == pytest.approx(2 * 14 * 1.15)
    assert box["b"]["ink_x"] == 90
    assert rows(D.overlaps(D.boxes(cells)), "a", "b", "severity") == [("a", "b", "warning")]


def test_modes(spark) -> None:
    def graph(doc, n, edges):
        return [cell(f"n{i}", doc) for i in range(n)] + [cell(f"e{k}", doc, vertex=None, edge="1", source=f"n{s}", target=f"n{t}") for k, (s, t) in enumerate(edges)]

    g = graph("f", 4, [(0, 1), (0, 2), (1, 3), (2, 3)]) + graph("s", 5, [(0, 1), (0, 2), (0, 3), (0, 4)]) + graph("w", 4, [(0, 1), (2, 3)]) + graph("g", 6, [(0, 1), (1, 2)]) + graph("h", 6, [(0, 1)]) + graph("o", 3, [(0, 9)])
    cells = spark.createDataFrame(g, CELLS)
    modes = spark.createDataFrame([("f", "flow"), ("s", "star"), ("w", "star"), ("g", "grid"), ("h", "quadrant"), ("o", "star"), ("z", "spiral")], "doc_id string, mode string")
    got = {r["doc_id"]: r["verdict"] for r in D.mode_verdicts(*D.topology(cells), modes).collect()}
    assert got == {"f": "FLOW_RECONVERGENT", "s": None, "w": "STAR_NO_UNIQUE_HUB", "g": "GRID_HAS_CONNECTED_STRUCTURE(3/6)", "h": None, "o": "STAR_NO_EDGES", "z": "UNKNOWN_MODE(spiral)"}


def test_labels(spark) -> None:
    cells = spark.createDataFrame([cell("title"), cell("a", value="图1-2 甲"), cell("b", value="见 图 1 — 1 与图3-4"), cell("c", value="graph TD a --&gt; b"), cell("d", value="[SRC-1] x [CASE-22]"), cell("e", value="见图2-1")], CELLS)
    assert rows(D.label_findings(cells), "id", "rule", "hit") == sorted([("title", "caption", ""), ("a", "caption", "图1-2 甲"), ("a", "figure", "图1-2"), ("c", "notation", "graph TD"), ("c", "notation", "-->"), ("d", "ledger", "[SRC-1]"), ("d", "ledger", "[CASE-22]"), ("e", "figure", "图2-1")], key=repr)


def test_envelopes(spark) -> None:
    ok = "noise\n[AGENT-OUTPUT-START:abcdef] writer\nbody\n\n[AGENT-OUTPUT-END:abcdef] writer\n"
    texts = [ok, ok.replace("END", "START"), ok.replace(":abcdef", ""), ok.replace("body", "█" * 9), None, ok.replace("] writer\nbody", "] other\nbody")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in A.envelopes(docs, F.lit("writer"), F.lit("ABCDEF")).collect()}
    assert (got[0]["passed"], got[0]["payload"], got[0]["nonce_matched"]) == (True, "body", True)
    assert (got[1]["pairing_ok"], got[1]["start_count"], got[1]["payload"]) == (False, 2, None)
    assert (got[2]["passed"], got[2]["degrade_reason"]) == (True, "nonce_missing")
    assert (got[3]["envelope_ok"], got[3]["passed"]) == (True, False)
    assert (got[4]["passed"], got[4]["start_count"]) == (False, 0)
    assert (got[5]["agent_matched"], got[5]["envelope_ok"]) == (False, False)


def test_audit(spark) -> None:
    docs = spark.createDataFrame([("c1", "### d1\nconfirm\n### d2\n\nadjust： more data\n### d3\nadjust:\n### d4\n### d1\nconfirm\n### d5\nwhat"), ("c2", None)], "chapter string, text string")
    e = A.expectations(docs)
    assert rows(e, "dim_id", "mode", "note", "fault") == sorted([("d1", "confirm", None, None), ("d1", "confirm", None, "duplicate"), ("d2", "adjust", "more data", None), ("d3", "adjust", "", "no_note"), ("d4", None, None, "empty"), ("d5", None, None, "unknown")], key=repr)
    sound = e.where("fault is null")
    scores = spark.createDataFrame([("c1", "d1", "block", "no source named"), ("c1", "d2", "warn", "nothing"), ("c1", "d9", "block", "x")], "chapter string, dim_id string, verdict string, evidence string")
    hints = spark.createDataFrame([("d1", "high", "source missing", "weak source"), ("d2", "low", "b", "few data points")], "dim_id string, severity string, block_hint string, warn_hint string")
    assert rows(A.restated(sound, scores, hints), "dim_id", "ratio", "passed") == [("d1", 0.5, True), ("d2", 0.0, False), ("d9", None, False)]
    core = spark.createDataFrame([("d1",), ("d7",)], "dim_id string")
    assert rows(A.dimension_gaps(sound, scores, core), "dim_id", "fault") == [("d7", "missing_core"), ("d9", "extra")]
    v = A.verdict_rule(scores, hints, spark.createDataFrame([("c1", "PASS"), ("c2", "PASS")], "chapter string, verdict string"))
    assert rows(v, "chapter", "expected", "high_blocks", "passed") == [("c1", "REVISE", ["d1"], False), ("c2", "PASS", [], True)]
    checks = spark.createDataFrame([("c1", "schema_b", False), ("c1", "content", False), ("c2", "content", True)], "chapter string, stage string, passed boolean")
    assert rows(A.overall(checks), "chapter", "passed", "failed_at") == [("c1", False, "schema_b"), ("c2", True, None)]
    issues = spark.createDataFrame([("c2", "i", "low", "p"), ("c2", "i", "high", "q"), ("c1", "j", "medium", "p")], "chapter string, issue string, severity string, persona string")
    assert rows(A.merged_issues(issues), "number", "issue", "severity", "personas") == [(1, "i", "high", 2), (2, "j", "medium", 1)]
    marks = spark.createDataFrame([("f", "<!-- linkage-const:a:1 --> <!-- linkage-const:b:2 --> <!-- linkage-const:x:0 -->")], "doc_id string, text string")
    assert rows(A.marker_faults(marks, spark.createDataFrame([("a", "1"), ("b", "3"), ("c", "4")], "key string, value string")), "key", "fault") == [("b", "differs"), ("c", "missing"), ("x", "unknown")]


def test_outlines(spark) -> None:
    new = "---\nstructure:\n  chapters:\n  - chapter_no: 1\n    chapter_title: 第1章：甲\n    sections:\n    - {section_no: '1.1', section_title: 一}\n    - {section_no: '', section_title: 1.2 二}\n  - chapter_no: A\n    chapter_title: 附\n---\n## 甲\n"
    old = "---\nstructure:\n  frontmatter:\n  - {chapter_title: 前}\n  bodymatter:\n  - {chapter_title: ''}\n  appendix:\n  - {appendix_title: 末}\n---\n"
    docs = spark.createDataFrame([("n", new), ("o", old), ("x", None)], "doc_id string, text string")
    chapters, sections = O.read(docs)
    assert rows(chapters, "doc_id", "chapter_no", "title", "is_appendix") == sorted([("n", "1", "第1章：甲", False), ("n", "A", "附", True), ("o", "1", "前", False), ("o", "2", "", False), ("o", "A", "末", True)], key=repr)
    headings = spark.createDataFrame([("n", "甲"), ("n", "附"), ("o", "2. 新")], "doc_id string, title string")
    found = O.gate(docs, chapters, sections, headings)
    assert {(r["doc_id"], r["rule"]): r["hits"] for r in found.where("not passed").collect()} == {("n", "S4"): 1, ("n", "S6"): 1, ("o", "S2"): 1, ("o", "S3"): 2, ("o", "S5"): 3, ("x", "S1"): 1}
    assert rows(O.gate_verdicts(found, "strict"), "doc_id", "passed") == [("n", False), ("o", False), ("x", False)]
    drafts = spark.createDataFrame([("n", "1", "1.1", "ch01-1", "X"), ("n", "1", None, "ch01", "Y")], "doc_id string, chapter_no string, section_no string, name string, text string")
    assert rows(O.merged(chapters, sections, drafts), "doc_id", "text") == [("n", "X\n\nY")]


def test_figures(spark) -> None:
    sized = spark.createDataFrame([(1000, 300.0), (1200, 299.9), (1700, 300.0), (1200, None), (None, 300.0)], "w int, d double")
    assert [tuple(r) for r in sized.select(G.gate_level(F.col("w"), F.col("d")), G.width_band(F.col("w")), G.chart_passes(F.col("w"), F.col("d"), F.col("d"))).collect()] == [("error", "warning", False), ("warning", "info", False), ("ok", "ok", True), ("warning", "info", False), ("error", None, False)]
    docs = spark.createDataFrame([("d", "![图1-1 x](figures/a.png)\n![图1-2 y](figures/z.png)\n![图1-3 w](figures/c2.png)")], "doc_id string, text string")
    manifest = spark.createDataFrame([("d", "1-1", "out/a.png"), ("d", "1-2", "b.png"), ("d", "1-3", "c.png"), ("d", "1-3", "c.svg")], "doc_id string, figure_no string, file string")
    files = spark.createDataFrame([("d", "a.png"), ("d", "c.png"), ("d", "c2.png")], "doc_id string, file string")
    assert rows(G.path_findings(manifest, files, G.image_refs(docs)), "file", "finding", "level") == [("b.png", "declared_missing", "FATAL"), ("c2.png", "ref_undeclared", "WARN"), ("z.png", "ref_missing", "FATAL")]
    lines = spark.createDataFrame([("d", 1, "见图1-1"), ("d", 2, "![图1-1 x](a.png)"), ("d", 3, "**表2-1 y**"), ("d", 4, "如表2-1、表9-9"), ("d", 5, "![图3-1 z](b.png)")], "doc_id string, line_no int, text string")
    assert rows(G.mention_findings(lines), "kind", "no", "finding") == sorted([("表", "2-1", "late"), ("表", "9-9", "no_entity"), ("图", "3-1", "unmentioned")], key=repr)
    e = "figure_no string, seq int, title string, drawio_png string, markdown_ref string"
    new, old = spark.createDataFrame([("1", 1, "a", "f/a.png", "![](x)"), ("1", 2, "b", "", "")], e), spark.createDataFrame([("1", 9, "c", "", ""), ("2", 9, "", "", "")], e)
    assert rows(G.upserted(new, old), "figure_no", "title") == [("1", "b"), ("2", "")]
    assert rows(G.entry_faults(new.union(old), ["title"]), "figure_no", "fault") == [("1", "markdown_ref"), ("2", "title")]
    items = spark.createDataFrame([("d", "01", "pass"), ("d", "11", "manual_required"), ("e", "03", "fail"), ("e", "04", None)], "doc_id string, item string, status string")
    assert rows(G.checklist(items), "doc_id", "passed", "failed", "manual") == [("d", True, [], 1), ("e", False, ["03", "04"], 0)]
    runs = spark.createDataFrame([(["a", "b"],)], "delivery_paths array<string>")
    assert rows(G.unproven(spark.createDataFrame([("a",), ("c",)], "path string"), runs), "path") == [("c",)]


def test_stream(spark, tmp_path) -> None:
    src, out = tmp_path / "in", str(tmp_path / "ledger")
    src.mkdir()
    line = '{{"event_id":"{}","ts":"2026-01-01T00:0{}:00Z","level":"significant","acknowledged":false}}\n'
    (src / "1.jsonl").write_text(line.format("a", 1) + line.format("a", 2) + "{bad\n" + line.format("b", 3))
    ledger.append_once(ledger.read_events(spark, str(src)), out, str(tmp_path / "cp")).awaitTermination(60)
    (src / "2.jsonl").write_text(line.format("b", 4) + line.format("c", 5))
    ledger.append_once(ledger.read_events(spark, str(src)), out, str(tmp_path / "cp")).awaitTermination(60)
    assert rows(spark.read.parquet(out), "event_id") == [("a",), ("b",), ("c",)]
    counted = ledger.counts_by_window(ledger.read_events(spark, str(src))).writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    counted.awaitTermination(60)
    assert rows(spark.table("counted"), "level", "count") == [("significant", 5)]
