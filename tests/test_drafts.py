"""Operators over drafts, structures and figures on small rows, with nulls, empty texts and empty tables."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import text as T
from ledgerloom.operators import audits, contract, drafts, figures, ranks, structure
from ledgerloom.operators import lines as L
from ledgerloom.operators import terms as TERMS
from ledgerloom.operators import references as R
from ledgerloom.sources import readers

DOCS = "doc_id string, text string"


def docs_of(spark, *texts: str | None) -> object:
    return spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], DOCS)


def rows_of(df, *columns: str) -> list[tuple]:
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_cleaning_keeps_null_and_empty(spark) -> None:
    got = {r["doc_id"]: r for r in drafts.cleaned(docs_of(spark, None, "", "> **篇幅预算** 3000 字\nx", "### 参考文献\n[1]")).collect()}
    assert got["d0"]["text"] is None and got["d1"]["text"] == "" and got["d2"]["text"] == "x" and got["d3"]["text"] == "" and got["d3"]["bibliographies"] == 1


def test_transitions_without_sections(spark) -> None:
    got = drafts.transitions(docs_of(spark, "# 第1章 A\n一句。两句。", "no chapter", None, ""))
    assert rows_of(got, "doc_id", "issue") == []
    only = drafts.transitions(docs_of(spark, "# 第1章 A\n### s\n"))
    assert rows_of(only, "issue", "found", "required") == [("thin_closing", 0, 1)]


def test_positional_words_at_the_edges(spark) -> None:
    got = drafts.positional_words(docs_of(spark, "上图上表", None, "以上图"))
    assert rows_of(got, "at", "word", "context") == [(1, "上图", "上图上表"), (3, "上表", "上图上表")]


def test_blocks_are_dropped_with_all_below(spark) -> None:
    text = "# A\nx\n## drop\ny\n### sub\nz\n## keep\nw\n### drop\nv\n# drop\nu\n## drop\nt"
    kept = L.without_blocks(L.classified(docs_of(spark, text)), r"^#+ drop$")
    assert [r["text"] for r in kept.orderBy("line_no").collect()] == ["# A", "x", "## keep", "w"]


def test_terms_are_found_by_their_likes(spark) -> None:
    terms = spark.createDataFrame([("T1", "自主协同闭环（SCL）"), ("T2", "abc"), ("T3", "未见术语")], "term_id string, preferred_form string")
    got = {(r["doc_id"], r["term_id"]): r["near"] for r in TERMS.missing_terms(docs_of(spark, "系统采用自主协同的闭环控制，而自主协同闭很重要", "abc", ""), terms).collect()}
    assert "自主协同" in got["d0", "T1"] and got["d0", "T2"] is None and got["d0", "T3"] is None and ("d1", "T2") not in got and len(got) == 8


def test_banned_forms_by_key(spark) -> None:
    terms = spark.createDataFrame([("T1", ["闭环控制", "环"]), ("T2", ["C++", "100%", "big-data"]), ("T3", ["", None])], "term_id string, banned_forms array<string>")
    got = rows_of(R.banned_forms(docs_of(spark, "一个闭环控制 with C++ and 100% big-data", "xC++ 100 bigdata", None), terms), "doc_id", "form")
    assert got == [("d0", "100%"), ("d0", "C++"), ("d0", "big-data"), ("d0", "环"), ("d0", "闭环控制")]


def test_ancestors_of_deep_trees_and_cycles(spark) -> None:
    rows = [("d", str(i), str(i - 1) if i else None) for i in range(40)] + [("e", "a", "b"), ("e", "b", "a")]
    got = R.ancestors(spark.createDataFrame(rows, "doc_id string, id string, parent string"))
    assert got.where("doc_id = 'd' and id = '39'").count() == 39 and got.agg(F.max("depth")).first()[0] == 39
    assert rows_of(got.where("doc_id = 'e'"), "id", "ancestor", "depth") == [("a", "a", 2), ("a", "b", 1), ("b", "a", 1), ("b", "b", 2)]


def test_numbers_over_ranges(spark) -> None:
    rows = spark.range(5000).select(F.xxhash64("id").alias("v"))
    got = ranks.numbered(rows, [F.col("v")]).orderBy("v").collect()
    assert [r["number"] for r in got] == list(range(1, 5001))
    assert ranks.numbered(rows.limit(0), [F.col("v")]).count() == 0


def test_images_of_the_contract(spark) -> None:
    docs = docs_of(spark, "![图1-1 a](figures/a.png) ![x](figures/b.png)", "none", None)
    lost = contract.missing_images(docs, listed=spark.createDataFrame([("a.png",)], "file string"), on_disk=spark.createDataFrame([("b.png",)], "file string"))
    assert rows_of(lost, "ref", "reason") == [("a.png", "no file"), ("b.png", "not in path map")]
    got = contract.verdicts(docs.where("text is not null"), images=lost)
    assert rows_of(got.where("rule = 'C13'"), "doc_id", "hits", "passed") == [("d0", 2, False), ("d1", 0, True)]
    assert not contract.overall(got).where("doc_id = 'd0'").first()["passed"]


def test_palette_is_judged_on_a_seeded_sample(spark) -> None:
    red, odd, white = bytes([200, 0, 0]), bytes([0, 255, 0]), bytes([255, 255, 255])
    rows = [("a", red * 9000 + white * 1000), ("b", red * 900 + odd * 100), ("c", b""), ("d", None), ("e", red * 4950 + odd * 50)]
    got = {r["doc_id"]: (r["sampled"], r["share"], r["passed"]) for r in figures.off_palette(spark.createDataFrame(rows, "doc_id string, rgb binary"), ["#C80505"]).collect()}
    assert got["a"] == (2000, 0.0, True) and got["b"] == (1000, 0.1, False) and got["c"][0] == 0 and got["d"][2] is False and got["e"][1] < 0.02


def test_plan_from_usual_names_and_phase_chapters(spark) -> None:
    plan = figures.plan_from_list(spark.createDataFrame([("d", "3-1", None, "data"), ("d", None, "x", "architecture")], "doc_id string, figure_id string, title string, type string"))
    assert rows_of(plan, "figure_id", "figure_no", "title", "type", "priority") == [("3-1", "3-1", "", "data", "required"), ("?", "?", "x", "architecture", "required")]
    assert figures.file_checklist(plan, "stage6").select("extension").first()[0] == "drawio"
    a = spark.createDataFrame([("1", ["ch01"]), ("2", ["ch01", "ch02"]), ("3", ["ch03"]), ("4", [])], "doc_id string, chapters array<string>")
    b = spark.createDataFrame([("1", "ch01"), ("3", "ch04")], "doc_id string, chapter_id string")
    assert rows_of(audits.chapter_of(a, b), "doc_id", "fault") == [("2", "not_one"), ("3", "differs"), ("4", "not_one")]


def test_strict_levels_and_manifest(spark) -> None:
    rows = spark.createDataFrame([("ERROR", "E1"), ("ERROR", "E2"), ("WARNING", "W")], "level string, code string")
    assert rows_of(rows.select(structure.strict_levels(F.col("level"), F.col("code"), ["E2"]).alias("l")), "l") == [("ERROR",), ("FATAL",), ("WARNING",)]
    outline = spark.createDataFrame([("d", "chapter"), ("d", "section"), ("d", "section")], "doc_id string, kind string")
    assert rows_of(structure.manifest(outline), "chapters", "sections", "subsections", "appendices") == [(1, 2, 0, 0)]


def test_lenient_reading_replaces_wrong_bytes(spark, tmp_path) -> None:
    cases = {"a.md": b"\xef\xbb\xbfx\r\ny\rz", "b.md": b"a\xff\xfeb\xe6\xb1", "d.md": "漢字".encode()}
    for n, b in cases.items():
        (tmp_path / n).write_bytes(b)
    got = {r["doc_id"]: r["text"] for r in readers.texts(spark, str(tmp_path)).collect()}
    assert got == {n: b.removeprefix(b"\xef\xbb\xbf").decode("utf-8", "replace").replace("\r\n", "\n").replace("\r", "\n") for n, b in cases.items()}


@pytest.mark.parametrize("value,want", [("a&copy;b&#8364;&amp;lt;", "a©b€&lt;"), ("<p>x</p>&nbsp;y", "x\n\xa0y"), (None, ""), ("plain", "plain")])
def test_entities(spark, value, want) -> None:
    assert spark.createDataFrame([(value,)], "v string").select(T.html_text(F.col("v")).alias("t")).first()["t"] == want


def png(rows: list[list[tuple]], kind: int = 2, filters: list[int] | None = None, dpi: int | None = None) -> bytes:
    """A PNG of rows of pixels, each row with its filter."""
    import struct
    import zlib

    n = len(rows[0][0])
    raw, before = b"", [0] * (len(rows[0]) * n)
    for y, row in enumerate(rows):
        flat, f = [v for p in row for v in p], (filters or [0] * len(rows))[y]
        out = []
        for i, v in enumerate(flat):
            a, b, c = (flat[i - n] if i >= n else 0), before[i], (before[i - n] if i >= n else 0)
            p = a + b - c
            paeth = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            out.append((v - [0, a, b, (a + b) >> 1, paeth][f]) & 255)
        raw += bytes([f, *out])
        before = flat
    chunk = lambda t, b: struct.pack(">I", len(b)) + t + b + struct.pack(">I", zlib.crc32(t + b))
    phys = chunk(b"pHYs", struct.pack(">IIB", dpi, dpi, 1)) if dpi else b""
    return bytes.fromhex(readers.PNG_MAGIC) + chunk(b"IHDR", struct.pack(">IIBBBBB", len(rows[0]), len(rows), 8, kind, 0, 0, 0)) + phys + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_png_pixels(spark, tmp_path) -> None:
    rows = [[((x * 37 + y * 11) % 256, (x * y) % 256, 200 - y) for x in range(7)] for y in range(5)]
    (tmp_path / "a.png").write_bytes(png(rows, filters=[0, 1, 2, 3, 4], dpi=11811))
    (tmp_path / "b.png").write_bytes(png([[(9, 128), (7, 0)]], kind=4))
    (tmp_path / "c.png").write_bytes(b"no png")
    (tmp_path / "d.png").write_bytes(png(rows)[:60])
    got = {r["doc_id"]: (r["dpi"], r["rgb"]) for r in readers.png_pixels(spark, str(tmp_path)).collect()}
    assert bytes(got["a.png"][1]) == bytes(v for r in rows for p in r for v in p) and abs(got["a.png"][0] - 300) < 0.01
    assert bytes(got["b.png"][1]) == bytes([9, 9, 9, 7, 7, 7]) and got["c.png"] == (None, None) and got["d.png"][1] is None


def test_json_and_yaml_that_cannot_be_read(spark) -> None:
    docs = docs_of(spark, "{", "[]", '{"a": 1, "b": "x", "layout_mode": "grid"}', None, "")
    assert rows_of(readers.json_constants(docs), "doc_id", "key", "value") == [("d2", "a", "1"), ("d2", "b", "x"), ("d2", "layout_mode", "grid")]
    assert rows_of(readers.layout_modes(docs), "doc_id", "mode") == [("d0", None), ("d1", None), ("d2", "grid"), ("d3", None), ("d4", None)]
    assert readers.exemptions(docs_of(spark, "a: [", "x", None)).count() == 0 and readers.dimensions(docs).count() == 0
    groups = readers.batch_grouping(docs_of(spark, '{"batch_grouping": {"batch1_high": ["d1", "d2"], "batch2_mid": []}}'))
    assert rows_of(groups, "batch", "dim_id") == [(1, "d1"), (1, "d2")]
    terms = spark.createDataFrame([(["SCL", "Scl", "S1"],), (None,)], "aliases array<string>")
    assert rows_of(readers.whitelisted(terms), "alias") == [("SCL",)]


def test_ledger_sinks(spark, tmp_path) -> None:
    from ledgerloom.streaming import ledger

    event = {"event_id": "e1", "ts": "2024-01-01 00:00:00", "level": "significant"}
    (tmp_path / "l").mkdir()
    (tmp_path / "l" / "0.json").write_text(__import__("json").dumps(event) + "\n")
    ledger.acknowledge(spark, ["e1"], str(tmp_path / "l"))
    events, acks = readers.event_log(spark, str(tmp_path / "l"))
    assert rows_of(R.ledger_state(events, acks), "event_id", "acknowledged") == [("e1", True)]
    runs = spark.createDataFrame([("0123456789ab", ["a"]), ("bad", ["b"]), (None, [])], "run_id string, delivery_paths array<string>")
    assert rows_of(ledger.append_provenance(runs, str(tmp_path / "p")), "run_id") == [("bad",), (None,)]
    assert rows_of(figures.unproven(spark.createDataFrame([("a",), ("c",)], "path string"), spark.read.json(str(tmp_path / "p"))), "path") == [("c",)]


def test_section_entries_of_bare_chapters(spark) -> None:
    from ledgerloom.operators import outlines

    chapters = spark.createDataFrame([("d", 1, "1", "A"), ("d", 2, "2", "B")], "doc_id string, ordinal int, chapter_no string, title string")
    sections = spark.createDataFrame([("d", 1, 0, "1.1", "S")], "doc_id string, ordinal int, at int, section_no string, title string")
    assert rows_of(outlines.section_entries(chapters, sections), "ordinal", "section_no", "title") == [(1, "1.1", "S"), (2, "2", "B")]


def test_texts_do_not_travel_with_their_keys(spark) -> None:
    words = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}x" for i in range(5000))
    docs = spark.createDataFrame([(1, words + " bad form"), (1, "bad form"), (1, "form bad"), (None, "a bad form"), (2, "form"), (3, None)], "doc_id int, text string")
    terms = spark.createDataFrame([("t", ["bad form", "--"]), ("u", ["bad form"])], "term_id string, banned_forms array<string>")
    found = R.banned_forms(docs, terms)
    assert rows_of(found, "doc_id", "term_id", "form") == sorted([(i, t, "bad form") for i in (1, 1, None) for t in "tu"], key=str)
    # an exploded key stands beside an id: the plan names the text's column (1) as one that explode drops
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Generate explode\(array_distinct.*\), \[1\], false", plan)


def test_entities_as_the_sql_reads_them(spark) -> None:
    page = lambda v: spark.createDataFrame([(v,)], "html string").select(T.html_text(F.col("html"), {"&lt;": "<", "&amp;": "&"}).alias("t")).first()["t"]
    assert page("a&amp{x&lt;b&amp;lt;&hellip;<br\f/>c") == "a&amp{x<b&lt;&hellip;\nc" and page(None) is None


def test_modes_are_judged_from_one_reading(spark) -> None:
    docs = docs_of(spark, "# A\n## 第1章：x\n## 2. y\n[1] [S1]\n![图1-1 a](figures/b.png)", None, "---\na: b\n---\n### 参考文献\n[SRC-1]", "")
    modes = {"draft": {}, "merged": {"merged": True, "expect_figures": 1}, "final": {"merged": True, "stage": "stage9"}}
    lost = contract.missing_images(docs, on_disk=spark.createDataFrame([("a.png",)], "file string"))
    both = contract.verdicts_by_mode(docs, modes, lost)
    assert both._jdf.queryExecution().optimizedPlan().toString().count("Generate inline") == 1
    columns = ("doc_id", "rule", "severity", "hits", "passed")
    for mode, given in modes.items():
        one = contract.verdicts(docs, **given, images=lost)
        assert rows_of(both.where(F.col("mode") == mode), *columns) == rows_of(one, *columns)
        want = contract.overall(one, **{k: v for k, v in given.items() if k != "expect_figures"})
        assert rows_of(contract.overall_by_mode(both, modes).where(F.col("mode") == mode), "doc_id", "passed", "fatal_rules") == rows_of(want, "doc_id", "passed", "fatal_rules")


def test_a_name_that_many_ask_for_is_split(spark) -> None:
    refs = spark.createDataFrame([(1, "b.svg", "t", "f"), (2, "no.png", "t", "f")], "doc_id int, ref string, text_dir string, figure_dir string")
    got = figures.resolved_images(refs, spark.createDataFrame([("t/b.png",), ("t/b.png",), ("f/b.png",), (None,)], "file string"))
    assert rows_of(got, "doc_id", "file") == [(1, "t/b.png"), (2, None)]
    # both sides of the semi-join come straight from their shuffles, as Spark splits skewed keys only there
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Aggregate ") == 1
