"""Drafts before they are merged, and what merged texts must not show: cleaning with its report, headings, leftovers of the
process, transitions between chapters and sections, empty chapters.

Texts are rows of (doc_id, text). What concerns one text is a column function; what looks at neighbouring lines is a window
over a document's lines, by (doc_id, line_no). doc_id tells documents apart: rows that share one are one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import text as T
from ledgerloom.operators import contract
from ledgerloom.operators import lines as L

#: What cleaning takes out, and what it only reports.
MARKER_LINE = r"^\s*\[AGENT-OUTPUT-(?:START|END)(?::[0-9a-f]{6,16})?\]"
ABOUT_CHARS, CHAPTER_CHARS, BUDGET_LINE = r"全文约\s*\d+\s*字", r"本章字数[^\n]*", r"(?m)^\s*>\s*\*\*篇幅预算\*\*[^\n]*\n?"
LOCAL_BIBLIOGRAPHY = r"(?m)^#{2,3}\s+参考文献"
SRC_REF = r"\[SRC-\d+"
#: Phrases of the process that a report must not hold.
BACKSTAGE = {
    "grade_word": r"[ABCD]\s*级",
    "evidence_strength": r"证据强度",
    "source_grading": r"信源分级",
    "adopted_or_not": r"本报告采用.{0,6}不采用",
    "no_independent_source": r"尚未见独立信源",
    "within_this_check": r"本次核验范围内",
    "tier_prefix": r"(?m)^[^\S\n]*\[[ABCD]\]",
    "claim_id": r"\[[A-Z]{1,3}\d{3}\]",
}
#: Headings of self-declarations, lines of annotations, words that point by place, lines that look like figure references.
SELF_CLAIM_HEADING = r"^#{1,6}\s+(?:写作者自声明|作者自声明)\s*$"
ANNOTATION_LINE = r"^\s*>\s*\[(?:红队|阶段9)[^\]]*\].*$"
POSITIONAL = r"(?<!以)[上下][图表]"
ITALIC_LINE = r"^(?:\*[^*\n]+\*|_[^_\n]+_)$"
#: Heads of chapters, sections and appendices, and the block that closes a chapter.
CHAPTER_HEAD = r"^#{1,2}\s*第\s*[0-9一二三四五六七八九十百]+\s*章"
SECTION_HEAD, APPENDIX_HEAD = r"^###\s+\S", r"^#{1,2}\s*附录"
CLOSING_BLOCK = r"^>\s*\*\*本章小结与过渡\*\*[：:]"
#: Fixed value: where appendices of a merged text begin.
FIRST_APPENDIX = r"(?m)^##\s+附录"


def cleaned(docs: DataFrame) -> DataFrame:
    """doc_id, text without process marks, and the report: markers, residues, bibliographies (local ones; the text is cut at the first), bold_lines with bold_first and bold_last (if there are three or more; they stay), src_refs (they stay)."""
    text = F.col("text")
    rows = F.split(text, "\n")
    kept = F.filter(rows, lambda r: ~r.rlike(MARKER_LINE))
    one = docs.select("doc_id", (F.size(rows) - F.size(kept)).cast("long").alias("markers"), F.array_join(kept, "\n").alias("text"))
    residues = T.class_count(text, f"{ABOUT_CHARS}|本章字数")
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, ABOUT_CHARS, ""), CHAPTER_CHARS, ""), BUDGET_LINE, "")
    two = one.select("doc_id", "markers", residues.alias("residues"), plain.alias("text"))
    cut = F.regexp_replace(text, "(?s)" + LOCAL_BIBLIOGRAPHY + ".*$(?!\n)", "")
    three = two.select("doc_id", "markers", "residues", T.class_count(text, LOCAL_BIBLIOGRAPHY).alias("bibliographies"), cut.alias("text"))
    bold = F.filter(F.transform(F.split(text, "\n"), lambda r, i: F.when(r.rlike(r"^\s*\*\*[^*]+\*\*\s*$"), i + 1)), lambda i: i.isNotNull())
    four = three.withColumn("bold", bold)
    many = F.size("bold") >= 3
    return four.select(
        "doc_id", "text", "markers", "residues", "bibliographies", F.when(many, F.size("bold")).otherwise(0).cast("long").alias("bold_lines"),
        F.when(many, F.array_min("bold")).alias("bold_first"), F.when(many, F.array_max("bold")).alias("bold_last"), T.class_count(text, SRC_REF).alias("src_refs"),
    )


def first_level_down(text: Column) -> tuple[Column, Column]:
    """The text with its H1 as H2, and how many there were."""
    h1 = r"(?m)^#(?=[^\S\n]+\S)"
    return F.regexp_replace(text, h1, "##"), T.class_count(text, h1)


def without(text: Column, pattern: str) -> Column:
    """Deletes what matches, and spaces behind it; between two ASCII characters one space stays, beside others none."""
    apart = F.regexp_replace(text, rf"(?<=[\x00-\x7F])(?:{pattern})[ \t]*(?=[\x00-\x7F])", " ")
    return F.regexp_replace(apart, rf"(?:{pattern})[ \t]*", "")


def backstage(docs: DataFrame) -> DataFrame:
    """doc_id, rule, hits: phrases of the process that are left."""
    return contract.rule_counts(docs, BACKSTAGE)


def leftovers(docs: DataFrame) -> DataFrame:
    """doc_id, line_no, finding, text: headings of self-declarations and lines of annotations that are left."""
    rows = L.lines(docs)
    finding = F.when(F.col("text").rlike(SELF_CLAIM_HEADING), "self_claim").when(F.col("text").rlike(ANNOTATION_LINE), "annotation")
    return rows.withColumn("finding", finding).where("finding is not null").select("doc_id", "line_no", "finding", F.trim("text").alias("text"))


def trailing_italic(docs: DataFrame) -> DataFrame:
    """doc_id, text: the first line in italics behind a text's last --- line, where there is one."""
    tail = F.regexp_extract("text", r"(?s)^(?:.*\n)?[^\S\n]*---[^\S\n]*\n(.*)$", 1)
    found = F.filter(F.transform(F.split(tail, "\n"), lambda r: F.regexp_replace(r, r"^\s+|\s+$", "")), lambda r: r.rlike(ITALIC_LINE))
    return docs.select("doc_id", F.get(found, F.lit(0)).alias("text")).where("text is not null")


def positional_words(docs: DataFrame, around: int = 15) -> DataFrame:
    """doc_id, line_no, at (from 1), word, context: words that point to a figure or table by its place."""
    rows = L.lines(docs).where(F.col("text").rlike(POSITIONAL))
    plain = F.transform(F.split("text", POSITIONAL), lambda p: F.length(p))
    before = F.transform(plain, lambda p, i: F.aggregate(F.slice(plain, F.lit(1), i + 1), F.lit(0), lambda a, x: a + x) + i * 2)
    found = rows.select("doc_id", "line_no", "text", F.posexplode(F.regexp_extract_all("text", F.lit(POSITIONAL), 0)).alias("i", "word"), before.alias("before"))
    at = F.get("before", F.col("i")) + 1
    context = F.substr("text", F.greatest(at - around, F.lit(1)), F.least(at - 1, F.lit(around)) + 2 + around)
    return found.select("doc_id", "line_no", at.alias("at"), "word", context.alias("context"))


def chapters(docs: DataFrame) -> DataFrame:
    """doc_id, chapter (counted from 1), is_last, lines (an array of texts, the head first): a row a chapter, cut from the text's own row. An appendix head ends a chapter."""

    def cut(lines: Column) -> Column:
        head = lambda x: x.rlike(CHAPTER_HEAD)
        bounds = F.array_compact(F.transform(lines, lambda x, i: F.when(x.startswith("#") & (head(x) | x.rlike(APPENDIX_HEAD)), F.struct(i.alias("at"), head(x).alias("is_head")))))

        def between(bounds: Column) -> Column:
            end = lambda j: F.coalesce(F.get(bounds, j + 1)["at"], F.size(lines))
            return F.filter(F.transform(bounds, lambda b, j: F.struct(b["is_head"].alias("is_head"), F.slice(lines, b["at"] + 1, end(j) - b["at"]).alias("lines"))), lambda c: c["is_head"])

        return T.let(bounds, between)

    number = lambda all_: F.transform(all_, lambda c, i: F.struct((i + 1).cast("long").alias("chapter"), (i + 1 == F.size(all_)).alias("is_last"), c["lines"].alias("lines")))
    return docs.select("doc_id", F.inline(T.let(T.let(F.split("text", "\n"), cut), number)))


def transitions(docs: DataFrame, letters: str = T.CJK) -> DataFrame:
    """doc_id, chapter, section, issue, found, required: how chapters close and sections follow each other.

    A chapter closes with two sentences, the last one with one: in its last closing block if it has one (issue
    thin_block), else in the last paragraph of its last section (issue thin_closing). Between two section heads there is a
    paragraph (issue no_transition; section: the first of the two). A paragraph holds a character of the class.

    A chapter is judged in its own row. Its lines are joined with marks between them, each a line end (which no line holds)
    and a letter, and split again: by section heads and blank lines into paragraphs, by starts and ends into blocks.
    """
    trimmed = F.transform("lines", lambda x: F.struct(x.alias("text"), F.trim(F.regexp_replace(x, r"(?U)^\s+|\s+$", "")).alias("s")))
    quoted = lambda x: F.trim(F.regexp_replace(x["s"], r"^>+", ""))
    # a block: its first line and the quoted lines that follow it without a gap
    start = lambda x: x["text"].startswith(">") & x["text"].rlike(CLOSING_BLOCK)
    in_blocks = lambda rows: F.array_join(F.transform(rows, lambda x: F.when(start(x), F.concat(F.lit("\nB"), quoted(x))).when(x["s"].startswith(">"), quoted(x)).otherwise("\nx")), "")
    in_sections = lambda rows: F.array_join(F.transform(rows, lambda x: F.when(x["text"].startswith("###") & x["text"].rlike(SECTION_HEAD), "\nS").when(x["s"] == "", "\nb").when(x["s"].rlike(L.NOT_BODY), "").otherwise(x["s"])), "")
    rows = chapters(docs).select("doc_id", "chapter", "is_last", T.let(trimmed, lambda rows: F.struct(F.split(in_blocks(rows), "\nB").alias("blocks"), F.split(in_sections(rows), "\nS").alias("sections"))).alias("c"))
    closing = lambda section: F.try_element_at(F.filter(F.split(section, "\nb"), lambda p: T.class_count(p, letters) > 0), F.lit(-1))
    block = F.when(F.size("c.blocks") > 1, F.get(F.split(F.element_at("c.blocks", -1), "\nx"), F.lit(0)))
    rows = rows.select("doc_id", "chapter", "is_last", block.alias("block_text"), F.transform("c.sections", closing).alias("closings"))
    said = F.coalesce("block_text", F.element_at("closings", -1))
    found = F.when(said.isNull(), 0).otherwise(F.size(T.sentences(said)))
    issue = lambda section, issue, found, required: F.struct(section.cast("long").alias("section"), issue.alias("issue"), found.alias("found"), required.alias("required"))
    thin = F.array(issue(F.size("closings") - 1, F.when(F.col("block_text").isNotNull(), "thin_block").otherwise("thin_closing"), found, F.when(F.col("is_last"), 1).otherwise(2)))
    gap = lambda c, i: F.when((i > 0) & (i < F.size("closings") - 1) & c.isNull(), issue(i, F.lit("no_transition"), F.lit(0), F.lit(1)))
    return rows.select("doc_id", "chapter", F.inline(F.concat(F.filter(thin, lambda x: x["found"] < x["required"]), F.array_compact(F.transform("closings", gap)))))


def empty_chapters(docs: DataFrame) -> DataFrame:
    """doc_id, chapter (counted from 1), title: H1 with no text below but headings, up to the next H1. Fenced lines are text.

    A text is judged in its own row: its lines as a string of one character each, cut at the H1.
    """
    mark = lambda x: F.when(L.is_heading(x, 1), "1").when((x["kind"] != "heading") & (F.trim(x["text"]) != ""), "x").otherwise("h")
    told = L.texts(docs).select("doc_id", F.filter("lines", lambda x: L.is_heading(x, 1)).alias("heads"), F.split(F.array_join(F.transform("lines", mark), ""), "1").alias("below"))
    title = lambda x: F.trim(F.regexp_replace(x["text"], r"^#\s+", ""))
    empty = lambda below: F.array_compact(F.transform("heads", lambda x, i: F.when(~F.contains(F.get(below, i + 1), F.lit("x")), F.struct((i + 1).cast("long").alias("chapter"), title(x).alias("title")))))
    return told.select("doc_id", F.inline(T.let(F.col("below"), empty)))


def with_bibliography(text: Column, bibliography: Column) -> tuple[Column, Column]:
    """The text with the bibliography before its first appendix, else at its end; and which of the two (before_appendix, end_of_document)."""
    section = F.concat(F.regexp_replace(bibliography, r"^\n+|\n+$", ""), F.lit("\n\n"))
    at = F.regexp_instr(text, F.lit(FIRST_APPENDIX))
    head = F.regexp_replace(F.when(at > 0, F.substr(text, F.lit(1), at - 1)).otherwise(text), r"\n+$(?!\n)", "")
    tail = F.when(at > 0, F.substr(text, at)).otherwise("")
    return F.concat(head, F.lit("\n\n"), section, tail), F.when(at > 0, "before_appendix").otherwise("end_of_document")


def source_totals(used: DataFrame, sources: DataFrame) -> DataFrame:
    """One row: cited (distinct sources), missing (of them, how many the index lacks). used: source_id."""
    found = used.select("source_id").distinct().join(sources.select("source_id").distinct().withColumn("known", F.lit(1)), "source_id", "left")
    return found.agg(F.count("*").alias("cited"), F.count_if(F.col("known").isNull()).alias("missing"))
