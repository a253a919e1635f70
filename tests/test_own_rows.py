"""What is judged in a text's own row: against plain searches over random texts, and without a shuffle."""

from __future__ import annotations

import random
import re

from ledgerloom.operators import audits, contract, drafts, figures, structure
from ledgerloom.operators import lines as L
from ledgerloom.operators import references as R

PIECES = ["```", " ```py", "# A", "# B", "## c", "", " ", "x", "| a |", "|---|", "**表1-1 t**", "*来源：s*", "# 第1章 A", "## 第二章 B", "## 附录 A", "### s", "> **本章小结与过渡**：p。", "> q。r。", "y。", "图1-1 z", "![图1-1 a](a.png)", "---", "1. o", "- l", "#no"]


def exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange")


def texts_of(seed: int, n: int = 150) -> list[str]:
    rng = random.Random(seed)
    return ["\n".join(rng.choice(PIECES) for _ in range(rng.randint(0, 25))) for _ in range(n)]


def docs_of(spark, texts: list) -> object:
    return spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")


def fences(lines: list[str]) -> list[bool]:
    marks = [i for i, x in enumerate(lines) if x.strip(" ").startswith("```")]
    return [any(a <= i <= b for a, b in zip(marks[::2], marks[1::2])) for i in range(len(lines))]


def is_h1(x: str) -> bool:
    return re.match(r"#\s+\S", x) is not None


def test_fences_and_empty_chapters(spark) -> None:
    texts = [*texts_of(1), "```\n# A", "# A\n```\n\n```\n# B", ""]
    docs = docs_of(spark, [*texts, None])
    got = {(r["doc_id"], r["line_no"]): (r["text"], r["in_fence"]) for r in L.classified(docs).collect()}
    assert got == {(d, i + 1): (x, f) for d, t in enumerate(texts) for i, (x, f) in enumerate(zip(t.split("\n"), fences(t.split("\n"))))}
    want = set()
    for d, t in enumerate(texts):
        lines, heads = t.split("\n"), []
        for x, f in zip(lines, fences(lines)):
            if not f and is_h1(x):
                heads.append([x[2:], True])
            elif heads and x.strip(" ") and (f or not re.match(r"#{1,6}\s+\S", x)):
                heads[-1][1] = False
        want |= {(d, i + 1, h) for i, (h, empty) in enumerate(heads) if empty}
    found = drafts.empty_chapters(docs)
    assert {tuple(r) for r in found.collect()} == want and exchanges(found) == 0


def transitions(t: str) -> set[tuple]:
    chapters, lines = [], None
    for x in t.split("\n"):
        if re.match(r"#{1,2}\s*第\s*[0-9一二三四五六七八九十百]+\s*章", x):
            lines = []
            chapters.append(lines)
        elif re.match(r"#{1,2}\s*附录", x):
            lines = None
        if lines is not None:
            lines.append(x)
    out = set()
    for c, rows in enumerate(chapters, 1):
        block, blocks, sections = None, [], [[""]]
        for x in rows:
            s = x.strip()
            q = re.sub(r"^>+", "", s).strip(" ")
            if x.startswith("> **本章小结与过渡**："):
                block = [q]
                blocks.append(block)
            elif s.startswith(">") and block is not None:
                block.append(q)
            elif not s.startswith(">"):
                block = None
            if re.match(r"###\s+\S", x):
                sections.append([""])
            elif not s:
                sections[-1].append("")
            elif not re.match(r"#|>|\||!\[", s):
                sections[-1][-1] += s
        closing = [next((p for p in reversed(ps) if re.search("[a-z]", p)), None) for ps in sections]
        said = "".join(blocks[-1]) if blocks else closing[-1]
        n = 0 if said is None else len([x for x in re.split("[。！？]", said) if x.strip(" ")])
        need = 1 if c == len(chapters) else 2
        if n < need:
            out.add((c, len(sections) - 1, "thin_block" if blocks else "thin_closing", n, need))
        out |= {(c, i, "no_transition", 0, 1) for i in range(1, len(sections) - 1) if closing[i] is None}
    return out


def test_transitions(spark) -> None:
    texts = texts_of(2, 300)
    found = drafts.transitions(docs_of(spark, [*texts, None]), "[a-z]")
    assert {tuple(r) for r in found.collect()} == {(d, *x) for d, t in enumerate(texts) for x in transitions(t)} and exchanges(found) == 0


def test_tables(spark) -> None:
    texts, want = texts_of(3, 300), set()
    for d, t in enumerate(texts):
        lines = t.split("\n")
        solid = [(i + 1, x.strip(" "), "fence" if f else "table" if x.startswith("|") else "text") for i, (x, f) in enumerate(zip(lines, fences(lines))) if f or x.strip(" ")]
        for i, (n, _, k) in enumerate(solid):
            if k != "table" or (i and solid[i - 1][2] == "table" and solid[i - 1][0] == n - 1):
                continue
            j = i
            while j + 1 < len(solid) and solid[j + 1][2] == "table" and solid[j + 1][0] == solid[j][0] + 1:
                j += 1
            cap = i > 0 and solid[i - 1][1:] == ("**表1-1 t**", "text")
            src = j + 1 < len(solid) and solid[j + 1][1:] == ("*来源：s*", "text")
            want.add((d, n, solid[j][0], "body" if cap else "appendix", "t" if cap else None, "1-1" if cap else None, "来源：s" if src else None))
    found = structure.tables(L.texts(docs_of(spark, [*texts, None])))
    assert {tuple(r) for r in found.collect()} == want and exchanges(found) == 0


def test_validated_meets_numbers_in_one_roll_up(spark) -> None:
    docs = docs_of(spark, ["![图1-2 a](a.png)\n![图1-2 b](b.png)\n见图1-2与图3-1\n表2-1", "如图1-1\n![图1-1 a](a.png)", None])
    got = sorted(tuple(r) for r in structure.validated(docs).collect())
    assert got == sorted([(0, "unmentioned", "表2-1"), (0, "late", "图1-2"), (0, "no_entity", "图3-1"), (0, "number_gap", "图1-2")])
    plan = figures.mention_findings(L.lines(docs))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 0 and plan.count("Aggregate ") == 1


def test_numbers_need_one_sort(spark) -> None:
    rows = spark.createDataFrame([(1, i, x) for i, x in enumerate([None, 3, 2, 3, 1, 3, 2, 3, 3, 0, 2, 1, None, 2])], "doc int, pos int, level int")
    found = R.hierarchical_numbers(rows, "doc", ["pos"])
    assert [r["number"] for r in found.orderBy("pos").collect()][1:12] == ["0.0.1", "0.1", "0.1.1", "1", "1.0.1", "1.1", "1.1.1", "1.1.2", "A", "1.1", "2"]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Window ") == 2 and found._jdf.queryExecution().sparkPlan().toString().count("Window ") == 2


def test_batches_with_odd_ids(spark) -> None:
    mark = "<!-- phase=A batch=1 chapter=ch10 dims=1 -->\n### d1\nconfirm"
    docs = spark.createDataFrame([(1, "ch10", mark), (1, "ch10", mark), (2, "ch10", mark), (None, "ch10", mark), (3, "ch10", mark.replace("### d1", "### d2"))], "doc_id int, chapter string, text string")
    grouping = spark.createDataFrame([(1, "d1"), (2, "d2")], "batch int, dim_id string")
    found = audits.batch_faults(docs, docs.select("chapter").distinct(), grouping)
    got = sorted(((r["doc_id"], r["fault"], r["detail"]) for r in found.collect()), key=str)
    assert got == sorted([(1, "repeated_batch", "1"), (2, "repeated_batch", "1"), (3, "repeated_batch", "1"), (None, "repeated_batch", "1"), (3, "extra_dim", "d2"), (3, "missing_dim", "d1"), (None, "missing_batch", "2"), (None, "missing_batch", "3")], key=str)
    # the rows of a chapter are not sorted for their ranks
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_overall_of_equals_the_roll_up_of_verdicts(spark) -> None:
    docs = docs_of(spark, ["# A\n## 第1章：x\n[1] [S1]\n![图1-1 a](figures/b.png)", None, "---\na: b\n---\n### 参考文献\n[SRC-1]", "", "plain [AB123]"])
    modes = {"draft": {}, "merged": {"merged": True, "expect_figures": 1}, "final": {"merged": True, "stage": "stage9"}}
    lost = contract.missing_images(docs, on_disk=spark.createDataFrame([("a.png",)], "file string"))
    rows = lambda df: sorted((r["doc_id"], r["mode"], r["passed"], r["fatal_rules"]) for r in df.collect())
    for images in (lost, None):
        assert rows(contract.overall_of(docs, modes, images)) == rows(contract.overall_by_mode(contract.verdicts_by_mode(docs, modes, images), modes))
