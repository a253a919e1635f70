"""Queries over report texts that are built from the rows of orders: what the texts hold follows from the order's key, so
the SQL beside each query tells from the key what must be found."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import audits, contract, diagrams, drafts, figures, findings, outlines, ranks, structure
from ledgerloom.operators import lines as L
from ledgerloom.operators import references as R
from ledgerloom.operators import terms as T
from ledgerloom.plans.registry import dealt, query, table
from ledgerloom.sources import readers


def _built(spark: SparkSession, sf_dir: str, *parts: str) -> DataFrame:
    """doc_id, text: a text from each order; parts are SQL over its key k, nl is a line end."""
    rows = dealt(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")), "k").withColumn("nl", F.lit("\n"))
    return rows.select(F.col("k").alias("doc_id"), F.expr(f"concat({', '.join(parts)})").alias("text"))


_D = "WITH d AS (SELECT o_orderkey AS k FROM orders)"


@query(
    _D + """, p AS (SELECT k, CASE WHEN k % 2 = 0 THEN '' ELSE '# T' || chr(10) END AS a, CASE WHEN k % 3 = 0 THEN ' x' WHEN k % 3 = 1 THEN '' ELSE 'plain' END AS b FROM d)
SELECT k AS doc_id, a || b || chr(10) || '**b1**' || chr(10) || ' **b2**' || chr(10) || CASE WHEN k % 5 = 0 THEN '**b3**' ELSE 'text [SRC-1]' END || chr(10) || CASE WHEN k % 7 = 0 THEN '' ELSE 'end' END AS text, (k % 2 = 0)::BIGINT AS markers, (k % 3 < 2)::BIGINT AS residues,
(k % 7 = 0)::BIGINT AS bibliographies, CASE WHEN k % 5 = 0 THEN 3 ELSE 0 END::BIGINT AS bold_lines, CASE WHEN k % 5 = 0 THEN CASE WHEN k % 2 = 0 THEN 2 ELSE 3 END END::INTEGER AS bold_first, CASE WHEN k % 5 = 0 THEN CASE WHEN k % 2 = 0 THEN 4 ELSE 5 END END::INTEGER AS bold_last, (k % 5 <> 0)::BIGINT AS src_refs FROM p"""
)
def clean_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _built(
        spark, sf_dir, "CASE WHEN k % 2 = 0 THEN '  [AGENT-OUTPUT-START:a1b2c3d4] writer' ELSE '# T' END, nl", "CASE WHEN k % 3 = 0 THEN '全文约 900 字 x' WHEN k % 3 = 1 THEN '本章字数：12 y' ELSE 'plain' END, nl",
        "'**b1**', nl, ' **b2**', nl", "CASE WHEN k % 5 = 0 THEN '**b3**' ELSE 'text [SRC-1]' END, nl", "CASE WHEN k % 7 = 0 THEN concat('## 参考文献', nl, 'old [SRC-9]', nl, '### 参考文献x') ELSE 'end' END",
    )
    # a bibliography's head cuts all below it, so the second head is counted and gone
    return drafts.cleaned(docs).withColumn("bibliographies", F.least("bibliographies", F.lit(1).cast("long")))


@query(_D + " SELECT k AS doc_id, CASE WHEN k % 2 = 0 THEN '## A' ELSE '## B' END || chr(10) || '## C' || chr(10) || CASE WHEN k % 3 = 0 THEN '#D' ELSE '## E' END AS text, (1 + (k % 3 <> 0)::INT)::BIGINT AS n FROM d")
def first_level_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _built(spark, sf_dir, "CASE WHEN k % 2 = 0 THEN '# A' ELSE '# B' END, nl, '## C', nl, CASE WHEN k % 3 = 0 THEN '#D' ELSE '# E' END")
    text, n = drafts.first_level_down(F.col("text"))
    return docs.select("doc_id", text.alias("text"), n.alias("n"))


@query(_D + " SELECT k AS doc_id, CASE k % 4 WHEN 0 THEN '前后' WHEN 1 THEN 'a b' WHEN 2 THEN '前b' ELSE 'end' END AS text FROM d")
def seam_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _built(spark, sf_dir, "CASE k % 4 WHEN 0 THEN '前[X1] 后' WHEN 1 THEN 'a[X2]  b' WHEN 2 THEN '前[X3]b' ELSE 'end[X4]' END")
    return docs.select("doc_id", drafts.without(F.col("text"), r"\[X\d\]").alias("text"))


@query(
    _D + """ SELECT k AS doc_id, 'grade_word' AS rule, 2::BIGINT AS hits FROM d WHERE k % 2 = 0 UNION ALL SELECT k, 'evidence_strength', 1 FROM d WHERE k % 3 = 0 UNION ALL SELECT k, 'adopted_or_not', 1 FROM d WHERE k % 5 = 0
UNION ALL SELECT k, 'tier_prefix', 1 FROM d WHERE k % 7 = 0 UNION ALL SELECT k, 'claim_id', 1 FROM d WHERE k % 11 = 0"""
)
def backstage_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drafts.backstage(_built(spark, sf_dir, "CASE WHEN k % 2 = 0 THEN 'A级 与 B 级' ELSE 'E级' END, nl, CASE WHEN k % 3 = 0 THEN '证据强度' ELSE '' END, CASE WHEN k % 5 = 0 THEN '本报告采用甲而不采用乙' ELSE '' END, nl, CASE WHEN k % 7 = 0 THEN ' [A] x' ELSE 'x [A]' END, CASE WHEN k % 11 = 0 THEN '[CM123]' ELSE '[CM12]' END"))


@query(_D + " SELECT k AS doc_id, 2::INTEGER AS line_no, 'self_claim' AS finding, '## 写作者自声明' AS text FROM d WHERE k % 2 = 0 UNION ALL SELECT k, 3, 'annotation', '> [红队 R1 已改写]' FROM d WHERE k % 3 = 0 UNION ALL SELECT k, 3, 'annotation', '> [阶段9]' FROM d WHERE k % 3 = 1")
def leftover_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drafts.leftovers(_built(spark, sf_dir, "'x', nl, CASE WHEN k % 2 = 0 THEN '## 写作者自声明 ' ELSE '## 写作者自声明 x' END, nl, CASE WHEN k % 3 = 0 THEN ' > [红队 R1 已改写]' WHEN k % 3 = 1 THEN '> [阶段9]' ELSE '> [其他]' END"))


@query(_D + " SELECT k AS doc_id, CASE WHEN k % 2 = 0 THEN '*note*' ELSE '_n_' END AS text FROM d WHERE k % 3 <> 0")
def trailing_italics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drafts.trailing_italic(_built(spark, sf_dir, "'*early*', nl, '---', nl, 'a', nl, CASE WHEN k % 3 = 1 THEN concat('---', nl) ELSE '' END, CASE WHEN k % 3 = 0 THEN '**bold**' WHEN k % 2 = 0 THEN ' *note* ' ELSE '_n_' END, nl, 'end', nl, '*later*'").where("doc_id is not null").withColumn("text", F.expr("CASE WHEN doc_id % 3 = 0 THEN replace(text, '*later*', 'later') ELSE text END")))


@query(
    _D + """ SELECT k AS doc_id, 1::INTEGER AS line_no, 4::INTEGER AS at, '上图' AS word, 'ab 上图和以下表，见下表' || CASE WHEN k % 2 = 0 THEN 'xyz' ELSE '' END AS context FROM d UNION ALL SELECT k, 1, 12, '下表', 'ab 上图和以下表，见下表' || CASE WHEN k % 2 = 0 THEN 'xyz' ELSE '' END FROM d"""
)
def positional_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drafts.positional_words(_built(spark, sf_dir, "'ab 上图和以下表，见下表', CASE WHEN k % 2 = 0 THEN 'xyz' ELSE '' END, nl, '以上图'"))


@query(
    _D + """ SELECT k AS doc_id, 1::BIGINT AS chapter, 2::BIGINT AS section, 'thin_closing' AS issue, 1::INTEGER AS found, 2::INTEGER AS required FROM d WHERE k % 3 = 1
UNION ALL SELECT k, 1, 2, 'thin_block', 1, 2 FROM d WHERE k % 3 = 2 AND k % 2 = 1 UNION ALL SELECT k, 2, 1, 'thin_closing', 0, 1 FROM d WHERE k % 5 = 0 UNION ALL SELECT k, 1, 1, 'no_transition', 0, 1 FROM d WHERE k % 2 = 1"""
)
def chapter_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _built(
        spark, sf_dir, "'# 第1章 A', nl, '### s1', nl, CASE WHEN k % 2 = 0 THEN 'abc。' ELSE '' END, nl, '### s2', nl",
        "CASE WHEN k % 3 = 0 THEN concat('first.', nl, nl, 'x。', nl, 'y。') WHEN k % 3 = 1 THEN 'x。' WHEN k % 2 = 0 THEN concat('> **本章小结与过渡**：p。', nl, '> q。') ELSE concat('> **本章小结与过渡**：p。', nl, nl, '> q。') END, nl",
        "'## 第 二 章：B', nl, '### t1', nl, CASE WHEN k % 5 = 0 THEN '' ELSE 'z。' END, nl, '# 附录 A', nl, '### u', nl, '### v'",
    )
    found = drafts.transitions(docs, "[a-z]")
    return found.select("doc_id", F.col("chapter").cast("long").alias("chapter"), F.col("section").cast("long").alias("section"), "issue", "found", "required")


@query(_D + " SELECT k AS doc_id, 1::BIGINT AS chapter, 'A' AS title FROM d WHERE k % 2 = 0 UNION ALL SELECT k, 3, 'C' FROM d WHERE k % 3 = 0")
def empty_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drafts.empty_chapters(_built(spark, sf_dir, "'lead', nl, '# A', nl, CASE WHEN k % 2 = 0 THEN ' ' ELSE 'x' END, nl, '## h', nl, '# B', nl, '```', nl, '# code', nl, '```', nl, '# C', nl, CASE WHEN k % 3 = 0 THEN '### only' ELSE '- item' END"))


@query(_D + " SELECT k AS doc_id, 'a' || chr(10) || CASE WHEN k % 2 = 0 THEN '' ELSE 'b' || chr(10) END || chr(10) || '## 参考文献' || chr(10) || '[1] x' || chr(10) || chr(10) || CASE WHEN k % 2 = 0 THEN '## 附录 A' || chr(10) || 'z' || chr(10) || '## 附录 B' ELSE '' END AS text, CASE WHEN k % 2 = 0 THEN 'before_appendix' ELSE 'end_of_document' END AS place FROM d")
def placed_bibliography(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _built(spark, sf_dir, "'a', nl, CASE WHEN k % 2 = 0 THEN concat(nl, '## 附录 A', nl, 'z', nl, '## 附录 B') ELSE concat('b', nl, nl) END")
    text, place = drafts.with_bibliography(F.col("text"), F.lit("\n## 参考文献\n[1] x\n"))
    return docs.select("doc_id", text.alias("text"), place.alias("place"))


@query("SELECT count(DISTINCT l_partkey) AS cited, count(DISTINCT l_partkey) FILTER (l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 10)) AS missing FROM lineitem")
def source_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drafts.source_totals(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("source_id")), table(spark, sf_dir, "part").where("p_size > 10").select(F.col("p_partkey").alias("source_id")))


#: A text with a table: its caption, its source, and a caption without table.
_TABLE = ("CASE WHEN k % 2 = 0 THEN concat('**表1-', k % 9, ' cap**', nl, nl) WHEN k % 3 = 0 THEN concat('plain', nl) ELSE '' END", "'| a | b |', nl, '|---|---|', nl, '| 1 | 2 |', nl, nl", "CASE WHEN k % 5 = 0 THEN '*来源：s*' ELSE 'x' END", "CASE WHEN k % 7 = 0 THEN concat(nl, nl, '**表2-1：lost**', nl, 'end') ELSE '' END")
_FIRST = "CASE WHEN k % 2 = 0 THEN 3 WHEN k % 3 = 0 THEN 2 ELSE 1 END"


@query(
    _D + f""" SELECT k AS doc_id, ({_FIRST})::INTEGER AS first_line, ({_FIRST} + 2)::INTEGER AS last_line, CASE WHEN k % 2 = 0 THEN 'body' ELSE 'appendix' END AS kind, CASE WHEN k % 2 = 0 THEN 'cap' END AS caption,
CASE WHEN k % 2 = 0 THEN '1-' || (k % 9) END AS number, CASE WHEN k % 5 = 0 THEN '来源：s' END AS source FROM d"""
)
def table_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.tables(L.texts(_built(spark, sf_dir, *_TABLE)))


@query(_D + f" SELECT k AS doc_id, ({_FIRST} + 6)::INTEGER AS line_no, '表2-1：lost' AS caption FROM d WHERE k % 7 = 0")
def orphan_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.orphan_captions(L.texts(_built(spark, sf_dir, *_TABLE)))


@query(_D + " SELECT k AS doc_id, 2::INTEGER AS line_no, '图1-1 说明' AS text FROM d WHERE k % 2 = 1 AND k % 3 <> 0")
def orphan_figure_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _built(spark, sf_dir, "CASE WHEN k % 2 = 0 THEN concat('![图1-1 x](a.png)', nl, nl) ELSE concat('y', nl) END, '图1-1 说明', nl, CASE WHEN k % 3 = 0 THEN '![图1-2 z](b.png)' ELSE 'end' END")
    return structure.orphan_figure_lines(L.texts(docs))


@query(_D + " SELECT k AS doc_id, (CASE WHEN k % 2 = 0 THEN 6 ELSE 4 END)::INTEGER AS line_no, CASE WHEN k % 2 = 0 THEN 'explicit' ELSE 'auto' END AS origin FROM d UNION ALL SELECT k, CASE WHEN k % 2 = 0 THEN 10 ELSE 8 END, 'auto' FROM d UNION ALL SELECT k, 3, 'explicit' FROM d WHERE k % 3 = 0")
def page_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _built(spark, sf_dir, "'# T', nl, CASE WHEN k % 3 = 0 THEN '---' ELSE '' END, nl, '## A', nl, CASE WHEN k % 2 = 0 THEN concat('---', nl, nl) ELSE '' END, '## B', nl, 'x', nl, '---', nl, 'y', nl, '## 附录 C', nl, '---'")
    return structure.page_breaks(L.texts(docs))


@query(
    _D + """ SELECT k AS doc_id, 1::BIGINT AS titles, 1::BIGINT AS chapters, (k % 4)::BIGINT AS sections, 1::BIGINT AS figures, (k % 2 = 0)::BIGINT AS body_tables, (k % 2 = 1)::BIGINT AS appendix_tables,
(2 + (k % 2 = 0 OR k % 3 = 0)::INT + (k % 7 = 0)::INT)::BIGINT AS paragraphs FROM d"""
)
def document_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.statistics(L.texts(_built(spark, sf_dir, "'# T', nl, '## C', nl, repeat(concat('### S', nl), CAST(k % 4 AS INT)), '![f](a.png)', nl, 'p1', nl, 'p2', nl, nl", *_TABLE)))


@query(
    _D + """ SELECT k AS doc_id, 'A' AS title, 'chapter' AS level FROM d UNION ALL SELECT k, 'S', CASE WHEN k % 2 = 0 THEN 'subsection' ELSE 'section' END FROM d UNION ALL SELECT k, 'B' || (k % 5), 'section' FROM d"""
)
def markdown_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.markdown_titles(_built(spark, sf_dir, "'# T', nl, '## 第 2 章：A', nl, '### 1.1 S', nl, '```', nl, '## code', nl, '```', nl, '### 1.2 B', k % 5, nl, CASE WHEN k % 2 = 0 THEN '#### S' ELSE '##### S' END"))


_SUBS = "SELECT o_custkey AS doc_id, 's' || o_orderkey AS title, CASE WHEN o_orderkey % 3 = 0 THEN 'T' || (o_orderkey % 7) ELSE '1.' || (o_orderkey % 7) END AS parent, o_orderkey % 3 = 0 AS by_title FROM orders"


@query(
    f"""WITH u AS ({_SUBS}), s AS (SELECT DISTINCT o_custkey AS doc_id, (o_orderkey % 5)::INTEGER AS at FROM orders)
SELECT u.doc_id, u.title, u.parent, s.at FROM u LEFT JOIN s ON s.doc_id = u.doc_id AND CASE WHEN by_title THEN u.parent = 'T' || s.at ELSE u.parent = '1.' || s.at END"""
)
def subsection_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as documents: their orders as subsections, by number or by title below the sections that they have."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("k"), F.lit(1).alias("ordinal"))
    subs = o.select("doc_id", "ordinal", F.expr("concat('s', k)").alias("title"), F.expr("CASE WHEN k % 3 = 0 THEN concat('T', k % 7) ELSE concat(' 1.', k % 7) END").alias("parent"), F.expr("k % 3 = 0").alias("by_title"))
    sections = o.select("doc_id", "ordinal", F.expr("CAST(k % 5 AS INT)").alias("at")).distinct().select("doc_id", "ordinal", "at", F.expr("concat('1.', at)").alias("section_no"), F.expr("concat('T', at, ' ')").alias("title"))
    return structure.parents(subs, sections).select("doc_id", "title", F.trim("parent").alias("parent"), "at")


_HEADS = "SELECT o_custkey AS doc_id, o_orderkey AS line_no, 'h' || (o_orderkey % 11) AS title, ['chapter', 'section', 'subsection', 'appendix', 'plain'][o_orderkey % 5 + 1] AS kind FROM orders"


def _overlaid(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("line_no"))
    heads = o.select("doc_id", "line_no", F.expr("concat('h', line_no % 11)").alias("title"), F.expr("element_at(array('chapter', 'section', 'subsection', 'appendix', 'plain'), CAST(line_no % 5 + 1 AS INT))").alias("kind"), F.lit("0").alias("number"))
    outline = o.where("line_no % 11 < 4").select("doc_id", F.expr("concat('h', line_no % 11)").alias("title"), F.lit("chapter").alias("kind"), F.expr("cast(line_no % 11 as string)").alias("number")).distinct()
    return structure.overlay(heads, outline)


@query(f"WITH h AS ({_HEADS}) SELECT doc_id, line_no, title, CASE WHEN line_no % 11 < 4 THEN 'chapter' ELSE kind END AS kind, CASE WHEN line_no % 11 < 4 THEN (line_no % 11)::VARCHAR ELSE '0' END AS number, line_no % 11 < 4 AS matched FROM h")
def heading_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings take kind and number of an outline that has four of eleven titles."""
    return _overlaid(spark, sf_dir)


@query(
    f"""WITH h AS ({_HEADS}), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, kind ORDER BY line_no) AS rank FROM h WHERE line_no % 11 >= 4 AND kind <> 'plain')
SELECT doc_id, kind, count(*) AS n, CASE kind WHEN 'subsection' THEN 'INFO' WHEN 'appendix' THEN 'WARNING' ELSE 'ERROR' END AS level, string_agg(title, ',' ORDER BY line_no) FILTER (rank <= 5) AS sample FROM r GROUP BY doc_id, kind"""
)
def unmatched_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.unmatched(_overlaid(spark, sf_dir), strict=True).withColumn("sample", F.array_join("sample", ","))


@query(
    _D + """ SELECT k AS doc_id, 'T1' AS term_id, 'closed loop' AS form, CASE WHEN k % 3 = 0 THEN 'near' ELSE 'none' END AS near FROM d WHERE k % 2 = 0 UNION ALL SELECT k, 'T3', 'abc', 'none' FROM d"""
)
def missing_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preferred forms that texts lack, and whether something near stands in their place."""
    docs = _built(spark, sf_dir, "'we use a ', CASE WHEN k % 2 = 1 THEN 'closed loop' WHEN k % 3 = 0 THEN 'closed loo' ELSE 'wide ring' END, ' of tests'")
    terms = spark.createDataFrame([("T1", "closed loop（CL）"), ("T2", "use a"), ("T3", "abc (x)")], "term_id string, preferred_form string")
    near = F.when(F.contains("near", F.lit("closed loo")), "near").when(F.col("near").isNull(), "none").otherwise(F.col("near"))
    return T.missing_terms(docs, terms).select("doc_id", "term_id", "form", near.alias("near"))


_PLAN = "WITH f AS (SELECT o_custkey AS doc_id, o_orderkey + 1000000 AS n, o_orderkey AS k FROM orders), g AS (SELECT *, k % 4 <> 0 OR k % 8 = 0 AS there, k % 3 <> 0 AS need, k % 5 <> 0 AS fine FROM f)"


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("k"))
    entries = o.select("doc_id", F.expr("concat('fig-', k + 1000000, '-1')").alias("fig_id"), F.expr("CASE WHEN k % 2 = 0 THEN '系统架构' ELSE 'line' END").alias("fig_type"), F.expr("CASE WHEN k % 3 = 0 THEN 'optional' END").alias("priority"), F.lit("t").alias("fig_title"))
    name = F.expr("concat('a', k + 1000000, CASE WHEN k % 4 <> 0 THEN '-1.png' ELSE '_1.PNG' END)")
    files = o.where("k % 4 <> 0 or k % 8 = 0").select("doc_id", F.concat(F.lit("figures/"), name).alias("file"), F.expr("k % 5 = 0").alias("fails"))
    return figures.found_files(figures.file_checklist(figures.plan_from_list(entries), "stage9"), files)


@query(_PLAN + " SELECT doc_id, 'fig-' || n || '-1' AS figure_id, n || '-1' AS figure_no, CASE WHEN k % 2 = 0 THEN 'architecture' ELSE 'data' END AS type, CASE WHEN need THEN 'required' ELSE 'optional' END AS priority, CASE WHEN k % 4 <> 0 THEN 'a' || n || '-1.png' WHEN k % 8 = 0 THEN 'a' || n || '_1.PNG' ELSE '' END AS files, CASE WHEN k % 4 <> 0 THEN 'number' WHEN k % 8 = 0 THEN 'loose' END AS how, there AND fine AS valid FROM g")
def figure_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planned figures and their files, by number or by a looser name."""
    return _found(spark, sf_dir).select("doc_id", "figure_id", "figure_no", "type", "priority", F.array_join("files", ",").alias("files"), "how", "valid")


@query(
    _PLAN + """ SELECT doc_id, count(*) AS total, count(*) FILTER (there) AS found, count(*) FILTER (need AND NOT there) AS missing, count(*) FILTER (need AND there AND NOT fine) AS invalid, count(*) FILTER (NOT need AND NOT there) AS optional_missing,
count(*) FILTER (NOT need AND there AND NOT fine) AS optional_invalid, count(*) FILTER (need AND NOT (there AND fine)) = 0 AS passed FROM g GROUP BY doc_id"""
)
def figure_gate_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return figures.gate_totals(_found(spark, sf_dir))


@query(_D + " SELECT k AS doc_id, '1-1' AS figure_no, '核心架构图 1-1' AS title, 'architecture' AS type FROM d UNION ALL SELECT k, '2-' || (k % 3 + 1), '架构图 2-' || (k % 3 + 1), 'architecture' FROM d UNION ALL SELECT k, NULL, 'sales', 'data' FROM d WHERE k % 2 = 0")
def planned_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return figures.plan_from_text(_built(spark, sf_dir, "'---', nl, 'x: 图 9-9', nl, '---', nl, '🏗️ **核心架构图**', nl, '图 1-1，图 1-1', nl, nl, '**图表规划**：架构图 1-1、架构图 2-', k % 3 + 1, CASE WHEN k % 2 = 0 THEN '，数据图：sales' ELSE '' END"))


@query("SELECT o_orderkey AS doc_id, CASE o_orderkey % 4 WHEN 0 THEN 'img/a ' || o_orderkey || '.png' WHEN 1 THEN 'figs/b.png' WHEN 2 THEN 'c.png' END AS file FROM orders")
def resolved_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image references as they are, below a text's folder, by name in the figure folder, or with their %-signs decoded."""
    k = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"))
    refs = k.select("doc_id", F.expr("CASE doc_id % 4 WHEN 0 THEN concat('a%20', doc_id, '.svg') WHEN 1 THEN 'x/b.SVG' WHEN 2 THEN 'c.png' ELSE 'none.png' END").alias("ref"), F.lit("img").alias("text_dir"), F.lit("figs").alias("figure_dir"))
    files = k.select(F.expr("concat('img/a ', doc_id, '.png')").alias("file")).unionAll(spark.createDataFrame([("figs/b.png",), ("c.png",), ("img/c.png",)], "file string"))
    return figures.resolved_images(refs, files).select("doc_id", "file")


@query("SELECT o_orderkey AS doc_id, CASE o_orderkey % 4 WHEN 0 THEN 'a_b_ c' WHEN 1 THEN 'report' WHEN 2 THEN repeat('报', 60) ELSE repeat('x', 119) END AS stem FROM orders")
def delivery_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.expr("CASE o_orderkey % 4 WHEN 0 THEN ' a/b? \t c..' WHEN 1 THEN ' . ' WHEN 2 THEN repeat('报', 70) ELSE concat(repeat('x', 119), '报') END")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), figures.delivery_stem(title).alias("stem"))


#: Batches of audits: every order hands in one for its customer's chapter.
_BATCHES = """WITH b AS (SELECT o_orderkey AS doc_id, 'ch' || (o_custkey % 90 + 10) AS chapter, o_orderkey % 11 = 0 AS bare, CASE WHEN o_orderkey % 7 = 0 THEN 'B' ELSE 'A' END AS phase, (o_orderkey % 4 + 1) AS batch, o_orderkey % 13 = 0 AS astray, 'd' || (o_orderkey % 4 + 1) AS dim, o_orderkey % 5 = 0 AS odd, CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 1 END AS dims FROM orders),
g AS (SELECT *, row_number() OVER (PARTITION BY chapter, batch ORDER BY doc_id) AS n FROM b WHERE NOT bare AND phase = 'A' AND NOT astray AND batch <= 3), t AS (SELECT *, CASE WHEN odd THEN 'd9' ELSE dim END AS said FROM g)"""


@query(
    _BATCHES + """ SELECT chapter, doc_id, CASE WHEN bare THEN 'no_mark' WHEN phase <> 'A' THEN 'wrong_phase' WHEN astray THEN 'other_chapter' ELSE 'unknown_batch' END AS fault, CASE WHEN NOT bare THEN batch::VARCHAR END AS detail FROM b WHERE bare OR phase <> 'A' OR astray OR batch > 3
UNION ALL SELECT chapter, doc_id, 'repeated_batch', batch::VARCHAR FROM g WHERE n > 1 UNION ALL SELECT chapter, doc_id, 'unknown_dim', said FROM t WHERE odd UNION ALL SELECT chapter, doc_id, 'wrong_count', '1' FROM t WHERE dims <> 1
UNION ALL SELECT chapter, doc_id, 'missing_dim', dim FROM t WHERE odd UNION ALL SELECT chapter, NULL, 'missing_batch', x::VARCHAR FROM (SELECT chapter, x FROM (SELECT DISTINCT chapter FROM b), (SELECT unnest([1, 2, 3]) AS x)) ANTI JOIN (SELECT chapter, batch AS x FROM g) USING (chapter, x)"""
)
def batch_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = dealt(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey").select(F.col("o_orderkey").alias("doc_id"), F.expr("concat('ch', o_custkey % 90 + 10)").alias("chapter"), F.col("o_orderkey").alias("k"))
    mark = "concat('<!-- phase=', CASE WHEN k % 7 = 0 THEN 'B' ELSE 'A' END, ' batch=', k % 4 + 1, ' chapter=', CASE WHEN k % 13 = 0 THEN 'ch999' ELSE chapter END, ' dims=', CASE WHEN k % 3 = 0 THEN 2 ELSE 1 END, ' -->')"
    text = F.expr(f"concat('\n  \n', CASE WHEN k % 11 = 0 THEN '' ELSE {mark} END, '\n### d', CASE WHEN k % 5 = 0 THEN 9 ELSE k % 4 + 1 END, '\nconfirm\n')".replace("\n", "\\n"))
    grouping = spark.createDataFrame([(b, f"d{b}") for b in (1, 2, 3)], "batch int, dim_id string")
    return audits.batch_faults(o.select("doc_id", "chapter", text.alias("text")), o.select("chapter").distinct(), grouping)


@query(_D + " SELECT k AS doc_id, k % 2 = 0 AS has_output, k % 3 = 1 AS one_verdict FROM d")
def report_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.report_shape(_built(spark, sf_dir, "CASE WHEN k % 2 = 0 THEN 'see chapter-reports/ch01-scripts.json: C1_h1' ELSE 'C1_h1' END, nl, CASE WHEN k % 3 = 0 THEN concat('verdict=PASS', nl, 'verdict = REVISE') WHEN k % 3 = 1 THEN ' verdict = PASS ' ELSE 'verdict: PASS' END"))


@query(_D + ", r AS (SELECT 'c' || (k % 9) AS chapter, k AS chars, k % 7 AS card, row_number() OVER (PARTITION BY k % 9 ORDER BY k DESC, k % 7) AS shown FROM d) SELECT chapter, chars, card, shown::INTEGER AS shown FROM r WHERE shown <= 30")
def longest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a report shows of its findings: the longest thirty of each chapter."""
    rows = table(spark, sf_dir, "orders").select(F.expr("concat('c', o_orderkey % 9)").alias("chapter"), F.col("o_orderkey").alias("chars"), (F.col("o_orderkey") % 7).alias("card"))
    return structure.first_of(rows, "chapter", [F.desc("chars"), F.col("card")], 30)


@query(
    """SELECT o_orderkey AS key, 'priority' AS path, 'enum' AS "check" FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM') UNION ALL SELECT o_orderkey, 'price', 'max' FROM orders WHERE o_totalprice > 200000
UNION ALL SELECT o_orderkey, 'status', 'pattern' FROM orders WHERE o_orderstatus <> 'F' UNION ALL SELECT o_orderkey, 'name', 'required' FROM orders WHERE o_orderkey % 5 = 0 UNION ALL SELECT o_orderkey, 'name', 'min_length' FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderkey < 100 UNION ALL SELECT o_orderkey, 'tags', 'not_empty' FROM orders WHERE o_orderkey % 3 = 0"""
)
def rule_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"), F.expr("CASE WHEN o_orderkey % 5 <> 0 THEN cast(o_orderkey AS string) END").alias("name"),
        F.expr("CASE WHEN o_orderkey % 3 = 0 THEN cast(array() AS array<int>) ELSE array(1) END").alias("tags"),
    )
    rules = [("priority", "enum", ["1-URGENT", "2-HIGH", "3-MEDIUM"]), ("price", "max", 200000), ("status", "pattern", "^F$"), ("name", "required", None), ("name", "min_length", 3), ("tags", "not_empty", None)]
    return findings.violations(rows, "key", rules)


_FOUND = "WITH f AS (SELECT o_custkey AS doc_id, CASE o_orderkey % 4 WHEN 0 THEN 'error' WHEN 1 THEN 'warning' END AS severity, o_orderkey AS k FROM orders), d AS (SELECT doc_id, count(*) FILTER (severity = 'error' AND k % 7 = 0) AS errors, count(*) FILTER (severity = 'warning' AND k % 5 = 0) AS warnings FROM f GROUP BY doc_id)"


def _file_verdicts(spark: SparkSession, sf_dir: str, **how: object) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("k"))
    found = o.where("(k % 4 = 0 and k % 7 = 0) or (k % 4 = 1 and k % 5 = 0)").select("doc_id", F.expr("CASE WHEN k % 4 = 0 THEN 'error' ELSE 'warning' END").alias("severity"))
    return findings.file_verdicts(o, found, **how)


@query(_FOUND + " SELECT doc_id, errors, warnings, errors = 0 AND warnings = 0 AS passed FROM d")
def file_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as files, some of their orders as errors and warnings; in strict mode both fail."""
    return _file_verdicts(spark, sf_dir, strict=True)


@query(_FOUND + " SELECT count(*) AS files, count(*) FILTER (errors = 0) AS passed_files, count(*) FILTER (errors > 0) AS failed_files, sum(errors)::BIGINT AS errors, sum(warnings)::BIGINT AS warnings, count(*) FILTER (errors > 0) = 0 AS passed, CASE WHEN count(*) FILTER (errors > 0) = 0 THEN 0 ELSE 1 END AS exit_code FROM d")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.run_summary(_file_verdicts(spark, sf_dir))


@query("SELECT o_custkey AS doc_id, o_orderpriority AS category, count(*) AS n, count(*) FILTER (o_orderkey % 3 = 0) AS high_risk FROM orders GROUP BY CUBE (o_custkey, o_orderpriority)")
def claim_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.claim_totals(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderpriority").alias("category"), (F.col("o_orderkey") % 3 == 0).alias("high_risk")))


@query("SELECT level, code, count(*) AS n, string_agg(line_no, ',' ORDER BY line_no) FILTER (r <= 3) AS first_lines FROM (SELECT *, row_number() OVER (PARTITION BY level, code ORDER BY line_no) AS r FROM (SELECT o_orderstatus AS level, 'W-' || (o_orderkey % 20) AS code, o_orderkey AS line_no FROM orders)) GROUP BY level, code")
def issue_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("level"), F.expr("concat('W-', o_orderkey % 20)").alias("code"), F.col("o_orderkey").alias("line_no"))
    return findings.issue_totals(rows).withColumn("first_lines", F.array_join("first_lines", ","))


@query(
    """WITH a AS (SELECT o_custkey AS k, o_orderkey AS l, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS place FROM orders WHERE o_orderkey % 2 = 0), b AS (SELECT o_custkey AS k, o_orderkey AS r, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS place FROM orders WHERE o_orderkey % 2 = 1)
SELECT coalesce(a.k, b.k) AS k, coalesce(a.place, b.place)::INTEGER AS place, l AS "left", r AS "right" FROM a FULL JOIN b ON a.k = b.k AND a.place = b.place"""
)
def files_by_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's even orders as files and odd ones as descriptions: the first with the first, and so on."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey")
    return findings.zipped(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1"), "k", "o_orderkey")


@query("SELECT o_custkey AS doc_id, no, (row_number() OVER (PARTITION BY o_custkey ORDER BY c, s, no))::INTEGER AS place FROM (SELECT DISTINCT o_custkey, (o_orderkey % 13) || '-' || (o_orderkey % 11) AS no, o_orderkey % 13 AS c, o_orderkey % 11 AS s FROM orders)")
def figures_by_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures N-M in the order of numbers, not of letters."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.expr("concat(o_orderkey % 13, '-', o_orderkey % 11)").alias("no")).distinct()
    return findings.by_number(rows, "doc_id", "no")


@query(
    "WITH d AS (SELECT o_orderkey AS k FROM orders), b AS (SELECT count(*) > 0 AS blocking FROM events WHERE event_type = 'error') SELECT k AS doc_id, 'left_sources' AS item, CASE WHEN k % 2 = 0 THEN 'fail' ELSE 'pass' END AS status FROM d UNION ALL SELECT k, 'figure_numbers', CASE WHEN k % 3 <> 0 AND k % 5 <> 0 THEN 'pass' ELSE 'fail' END FROM d UNION ALL SELECT k, 'ledger', CASE WHEN blocking THEN 'fail' ELSE 'pass' END FROM d, b"
)
def delivery_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _built(spark, sf_dir, "CASE WHEN k % 2 = 0 THEN 'x [SRC-1]' ELSE 'x [1]' END")
    rules = docs.select("doc_id", F.explode(F.array(F.lit("C3"), F.lit("C4"), F.lit("C5"))).alias("rule")).withColumn("passed", F.expr("NOT (rule = 'C3' AND doc_id % 3 = 0) AND rule <> 'C5'"))
    gate = docs.select("doc_id", (F.col("doc_id") % 5 != 0).alias("passed"))
    ledger = table(spark, sf_dir, "events").agg((F.count_if(F.col("event_type") == "error") > 0).alias("blocking"))
    return findings.delivery_items(docs, rules, gate, ledger)


@query(
    _D + " SELECT k AS doc_id, CASE k % 4 WHEN 0 THEN 'a **b|.....|;' WHEN 1 THEN 'x|B....|;y|BI...|; |B....|;u|..C..|;' WHEN 2 THEN 't|.....|http://l;v|B....|http://l;2|...S.|;' ELSE 'lone * star ` and [x]|.....|;' END AS runs FROM d"
)
def inline_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _built(spark, sf_dir, "CASE k % 4 WHEN 0 THEN 'a **b' WHEN 1 THEN '**x*y* **`u`' WHEN 2 THEN '[t**v**](http://l)^2^' ELSE 'lone * star ` and [x]' END")
    mark = lambda r, f, c: F.when(r[f], c).otherwise(".")
    shown = F.transform(findings.inline_runs(F.col("text")), lambda r: F.concat(r["text"], F.lit("|"), mark(r, "bold", "B"), mark(r, "italic", "I"), mark(r, "code", "C"), mark(r, "superscript", "S"), F.lit(".|"), F.coalesce(r["url"], F.lit("")), F.lit(";")))
    return docs.select("doc_id", F.array_join(shown, "").alias("runs"))


@query(
    _D + """ SELECT k AS doc_id, 'f' AS file, 'G2_overlap' AS "check", 'a,b' AS cells, CASE WHEN k % 2 = 0 THEN NULL ELSE 'fields' END AS rejected FROM d UNION ALL SELECT k, 'g', 'G1', 'c', 'check' FROM d WHERE k % 3 <> 0"""
)
def exemption_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _built(spark, sf_dir, "'exemptions:', nl, '- file: f', nl, '  check: G2_overlap', nl, '  cells: [a, b]', nl, CASE WHEN k % 2 = 0 THEN concat('  reason: x', nl) ELSE '' END, CASE WHEN k % 3 <> 0 THEN concat('- {file: g, check: G1, cells: [c], reason: y}', nl) ELSE '' END")
    return readers.exemptions(docs).select("doc_id", "file", "check", F.array_join("cells", ",").alias("cells"), "rejected")


@query(
    _D + """ SELECT k AS doc_id, 'd' || (k % 7) AS dim_id, 'high' AS severity, CASE WHEN k % 2 = 0 THEN 'w' ELSE '' END AS warn_hint, true AS core FROM d UNION ALL SELECT k, 'p1', NULL, '', false FROM d WHERE k % 3 = 0"""
)
def contract_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    quote = lambda x: x.replace("'", '"')
    docs = _built(spark, sf_dir, "'" + quote("{'dimensions': [{'id': 'd") + "', k % 7, '" + quote("', 'severity': 'high'") + "', CASE WHEN k % 2 = 0 THEN '" + quote(", 'what_triggers_warn_hint': 'w'") + "' ELSE '' END, '" + quote("}]") + "', CASE WHEN k % 3 = 0 THEN '" + quote(", 'proposal_extra': [{'id': 'p1'}]") + "' ELSE '' END, '}'")
    return readers.dimensions(docs).select("doc_id", "dim_id", "severity", "warn_hint", "core")


@query(_D + " SELECT k AS doc_id, CASE WHEN k % 3 = 0 THEN (k % 9)::INTEGER ELSE 0 END AS n FROM d")
def declared_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.declared_figures(_built(spark, sf_dir, "'---', nl, CASE WHEN k % 3 = 0 THEN concat('core_architecture_figures: ', k % 9) WHEN k % 3 = 1 THEN 'core_architecture_figures: many' ELSE 'x: 1' END, nl, '---', nl, 'text'"))


_OUTLINES = "WITH c AS (SELECT o_custkey AS doc_id, o_orderkey AS ordinal, o_orderkey % 10 = 9 AS app, o_orderkey % 3 = 0 AS bare FROM orders)"


@query(
    _OUTLINES + """, p AS (SELECT doc_id, app::INT * 2 AS a, ordinal AS o, -1 AS s, CASE WHEN app THEN '## 附录A：t' || ordinal || chr(10) || chr(10) || '> （待写作）' WHEN bare THEN '## t' || ordinal || chr(10) || chr(10) || '> 本章在大纲中未声明任何节。' ELSE '## t' || ordinal END AS text FROM c
UNION ALL SELECT doc_id, app::INT * 2, ordinal, 0, '### s' || ordinal || chr(10) || chr(10) || '> （待写作）' FROM c WHERE NOT bare UNION ALL SELECT DISTINCT doc_id, 1, 0, 0, '## 参考文献' FROM c)
SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY a, o, s) || chr(10) AS text FROM p GROUP BY doc_id"""
)
def outline_skeletons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as outlines, their orders as chapters; every third has no section, every tenth is an appendix."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("ordinal"))
    chapters = o.select("doc_id", "ordinal", F.lit("A").alias("chapter_no"), F.expr("concat('第1章：t', ordinal)").alias("title"), (F.col("ordinal") % 10 == 9).alias("is_appendix"))
    sections = o.where("ordinal % 3 <> 0").select("doc_id", "ordinal", F.lit(0).alias("at"), F.lit("1.1").alias("section_no"), F.expr("concat('1.1 s', ordinal)").alias("title"))
    return outlines.skeleton(chapters, sections)


@query("SELECT o_orderkey AS doc_id, CASE o_orderkey % 4 WHEN 0 THEN '第' || ['一','二','三','四','五','六','七','八','九'][o_orderkey % 9 + 1] || '章' WHEN 1 THEN (o_orderkey % 9 + 1) || '.2' WHEN 2 THEN (o_orderkey % 9 + 1) || '.2.3' ELSE '附录B' END AS shown, (o_orderkey % 9 + 1)::INTEGER AS number FROM orders")
def display_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), (F.col("o_orderkey") % 9 + 1).alias("n"))
    kind = F.expr("element_at(array('chapter', 'section', 'subsection', 'appendix'), CAST(doc_id % 4 + 1 AS INT))")
    shown = outlines.display_number(kind, F.col("n"), F.lit(2), F.lit(3), F.lit("B"))
    return o.select("doc_id", shown.alias("shown"), outlines.chapter_number(F.concat(F.lit(" "), F.col("n"), F.lit(".0"))).alias("number"))


@query(_D + " SELECT k AS doc_id, 'orphan_figure_line' AS \"check\", '图1-1 说明' AS detail FROM d WHERE k % 2 = 0 UNION ALL SELECT k, 'positional', '见上图。' FROM d WHERE k % 3 = 0 UNION ALL SELECT k, 'no_entity', '图9-9' FROM d WHERE k % 5 = 0 UNION ALL SELECT k, 'unmentioned', '图1-1' FROM d WHERE k % 2 = 0 UNION ALL SELECT k, 'unmentioned', '图2-1' FROM d UNION ALL SELECT k, 'unmentioned', '图2-' || (2 + k % 7) FROM d UNION ALL SELECT k, 'number_gap', '图2-' || (2 + k % 7) FROM d WHERE k % 7 <> 0")
def validated_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _built(spark, sf_dir, "CASE WHEN k % 2 = 0 THEN '图1-1 说明' ELSE 'x' END, nl, CASE WHEN k % 3 = 0 THEN '见上图。' ELSE 'y' END, nl, CASE WHEN k % 5 = 0 THEN '如图9-9' ELSE 'z' END, nl, '![图2-1 a](a.png)', nl, nl, '![图2-', 2 + k % 7, ' b](b.png)'")
    return structure.validated(docs)


@query("SELECT o_orderkey AS doc_id, CASE o_orderkey % 6 WHEN 5 THEN '3.4 x' ELSE 'x' END AS title FROM orders")
def heading_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.expr("CASE o_orderkey % 6 WHEN 0 THEN '第三章：x' WHEN 1 THEN '12、x' WHEN 2 THEN '3.4 x' WHEN 3 THEN '3.4.5 x' WHEN 4 THEN '附录B：x' ELSE '3.4 x' END").alias("t"), F.expr("CASE o_orderkey % 6 WHEN 2 THEN 3 WHEN 3 THEN 4 WHEN 5 THEN 5 ELSE 2 END").alias("level"))
    return o.select("doc_id", outlines.without_heading_number(F.col("t"), F.col("level")).alias("title"))


@query("WITH r AS (SELECT o_custkey AS doc_id, 'A' || (o_orderkey % 5) AS title, CASE o_orderkey % 3 WHEN 0 THEN 'chapter' WHEN 1 THEN 'section' ELSE 'subsection' END AS level, o_orderkey AS k FROM orders) SELECT doc_id, title, arg_max(level, k) AS level FROM r GROUP BY doc_id, title")
def outline_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("ordinal"), F.lit(0).alias("at"))
    of = lambda n, lead: o.where(f"ordinal % 3 = {n}").withColumn("title", F.expr(f"concat('{lead}', 'A', ordinal % 5)"))
    return outlines.flat_titles(of(0, "第1章 "), of(1, "1.2 "), of(2, "1.2.3 "))


@query("SELECT doc_id, '| 编号 | 标题 | 类型 | 所属章节 |' || chr(10) || '|---|---|---|---|' || chr(10) || string_agg('| ' || no || ' | t | data |  |', chr(10) ORDER BY c, s) AS text FROM (SELECT DISTINCT o_custkey AS doc_id, (o_orderkey % 13) || '-' || (o_orderkey % 11) AS no, o_orderkey % 13 AS c, o_orderkey % 11 AS s FROM orders) GROUP BY doc_id")
def figure_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.expr("concat(o_orderkey % 13, '-', o_orderkey % 11)").alias("figure_no"), F.lit("t").alias("title"), F.lit("data").alias("type"), F.lit(None).cast("string").alias("chapter")).distinct()
    return figures.index_tables(rows)


@query(
    """WITH g AS (SELECT o_custkey AS doc_id, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
c AS (SELECT doc_id, any_value(n) AS n, count(*) FILTER (r > 1 AND r <= 1 + doc_id % 5) AS e FROM g GROUP BY doc_id)
SELECT doc_id, n AS n_vertex, e AS n_edge, CASE WHEN e > 0 AND (e + 1) * 3 > n THEN 'GRID_HAS_CONNECTED_STRUCTURE(' || (e + 1) || '/' || n || ')' END AS verdict FROM c"""
)
def grid_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as grids of their orders, of which some are tied to the first one."""
    ranks.shared_folder(spark)
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("k"))
    first = o.groupBy("doc_id").agg(F.sort_array(F.collect_list("k")).alias("ks"))
    ties = first.select("doc_id", F.col("ks")[0].alias("source"), F.explode(F.slice("ks", F.lit(2), (F.col("doc_id") % 5).cast("int"))).alias("target"))
    name = lambda c: F.col(c).cast("string").alias(c)
    found = diagrams.mode_verdicts(o.select("doc_id", F.col("k").cast("string").alias("id")), ties.select("doc_id", name("source"), name("target")), o.select("doc_id").distinct().withColumn("mode", F.lit("grid")))
    return found.select("doc_id", "n_vertex", "n_edge", "verdict")


@query(
    """WITH n AS (SELECT p_partkey AS k, row_number() OVER (ORDER BY p_partkey)::INTEGER AS number FROM part)
SELECT number, 'SRC-' || k AS source_id, CASE WHEN k % 4 = 0 THEN '[' || number || '] [source SRC-' || k || ': no metadata]' ELSE '[' || number || ']' || CASE WHEN k % 3 = 0 THEN '' ELSE ' Org' || k || '.' END || ' T' || k || CASE WHEN k % 5 = 0 THEN '[EB/OL].' WHEN k % 5 = 1 THEN '[J].' ELSE '[M].' END || ' Pub, 2020.' || CASE WHEN k % 10 = 0 THEN '  http://x/' || k || '.' ELSE '' END END AS entry, k % 4 = 0 AS missing FROM n"""
)
def bibliographies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as sources: some without title, author, or type."""
    k = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    numbers = ranks.numbered(k.select("k"), [F.col("k")]).select("number", F.expr("concat('SRC-', k)").alias("source_id"))
    sources = k.select(
        F.expr("concat('SRC-', k)").alias("source_id"), F.expr("CASE WHEN k % 4 = 0 THEN ' ' ELSE concat('T', k) END").alias("title"), F.expr("CASE WHEN k % 3 <> 0 THEN concat('Org', k) END").alias("author_or_org"), F.lit("Pub").alias("publisher"), F.lit("2020").alias("publish_date"),
        F.expr("CASE k % 10 WHEN 0 THEN 'EB/OL' WHEN 5 THEN 'official' WHEN 1 THEN 'journal' WHEN 6 THEN 'journal' ELSE 'other' END").alias("source_type"), F.expr("concat('http://x/', k)").alias("url_or_path"),
    )
    return R.bibliography(numbers, sources)


@query(
    """WITH s AS (SELECT o_custkey AS doc_id, o_orderkey AS ordinal, CASE WHEN o_orderkey % 3 = 0 THEN 'own' || o_orderkey WHEN o_orderkey % 3 = 1 THEN 'whole' || o_orderkey ELSE '<!-- missing: s' || o_orderkey || ' -->' END AS text FROM orders)
SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY ordinal) AS text FROM s GROUP BY doc_id"""
)
def merged_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as outlines, their orders as chapters of one section: drafts of the section, of the chapter, or none."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("ordinal"))
    no = F.expr("concat('c', ordinal)").alias("chapter_no")
    section = F.expr("CASE WHEN ordinal % 3 = 0 THEN concat('s', ordinal) END").alias("section_no")
    handed = o.where("ordinal % 3 < 2").select("doc_id", no, section, F.lit("a").alias("name"), F.expr("concat(CASE WHEN ordinal % 3 = 0 THEN 'own' ELSE 'whole' END, ordinal)").alias("text"))
    return outlines.merged(o.select("doc_id", "ordinal", no), o.select("doc_id", "ordinal", F.lit(0).alias("at"), F.expr("concat('s', ordinal)").alias("section_no"), F.lit("t").alias("title")), handed)


@query("SELECT 'C' || o_orderkey AS card_id FROM orders WHERE o_orderkey % 3 = 0")
def cards_without_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contract.cards_without_path(table(spark, sf_dir, "orders").select(F.expr("concat('C', o_orderkey)").alias("card_id"), F.expr("CASE o_orderkey % 6 WHEN 0 THEN NULL WHEN 3 THEN '  ' ELSE 'cards/x.md' END").alias("card_file_path")))


@query("SELECT 'a/selfclaims/' || o_orderkey AS path FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT 'selfclaim/' || o_orderkey FROM orders WHERE o_orderkey % 3 = 1")
def misplaced_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contract.misplaced_paths(table(spark, sf_dir, "orders").select(F.expr("CASE o_orderkey % 3 WHEN 0 THEN concat('a/selfclaims/', o_orderkey) WHEN 1 THEN concat('selfclaim/', o_orderkey) ELSE concat('a/myselfclaim/', o_orderkey) END").alias("path")))
