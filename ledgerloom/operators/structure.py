"""The structure of merged texts: captions and sources of tables, orphan figure lines, page breaks, statistics, titles
against an outline, parents of subsections, and terms in their preferred form.

texts: lines as lines.texts() gives them; a text is judged in its own row, so that nothing is shuffled for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import text as T
from ledgerloom.operators import drafts, figures, outlines
from ledgerloom.operators import lines as L
from ledgerloom.operators import references as R

#: A caption (with or without number), a source line, a line that looks like a figure reference.
CAPTION = r"^表(?:(\d{1,2})-(\d{1,2}))?(?:[ 　]+|[：:][ 　]*)(.+)$"
SOURCE = r"^(?:数据)?来源[：:]"
FIGURE_LINE = r"^图\d{1,2}-\d{1,2}(?:[：:]|[ 　]).{0,80}$"
#: Headings that an outline locks (unmatched ones count as warnings, in strict mode as errors), and such that may be new.
LOCKED, FREE = ("chapter", "section"), ("subsection",)


def _inner(text: Column, mark: str) -> Column:
    """What a line wholly in bold (**) or italics (*) holds; null for others."""
    m = mark.replace("*", r"\*")
    found = F.regexp_extract(F.trim(text), rf"^{m}([^*]+){m}$", 1)
    return F.when(found != "", F.trim(found))


def _solid() -> Column:
    return F.filter("lines", lambda x: x["kind"] != "blank")


def _kind(lines: Column, at: Column) -> Column:
    """Kind of the line at a place; blank beyond the ends."""
    return F.coalesce(F.get(lines, at)["kind"], F.lit("blank"))


def _tables(solid: Column) -> Column:
    """Runs of table lines: first_line, last_line, cap (the bold line before), src (the line in italics behind). A blank line breaks a run, too."""
    near = lambda x, i, j: (_kind(solid, j) == "table") & (F.get(solid, j)["line_no"] - x["line_no"] == j - i)
    edge = lambda step: L.places(solid, lambda x, i: (x["kind"] == "table") & ~near(x, i, i + step))
    beside = lambda at, mark: F.when(_kind(solid, at) == "paragraph", _inner(F.get(solid, at)["text"], mark))
    run = lambda a, b: F.struct(F.get(solid, a)["line_no"].alias("first_line"), F.get(solid, b)["line_no"].alias("last_line"), beside(a - 1, "**").alias("cap"), beside(b + 1, "*").alias("src"))
    return T.let(edge(1), lambda ends: F.transform(edge(-1), lambda a, i: run(a, F.get(ends, i))))


def tables(texts: DataFrame) -> DataFrame:
    """doc_id, first_line, last_line, kind (body with a caption, else appendix), caption, number (as written), source: of every run of table lines. The caption is the bold line before it, the source the line in italics behind it; blank lines between do not count."""
    runs = texts.select("doc_id", F.inline(T.let(_solid(), _tables)))
    number = F.when(F.regexp_extract("cap", CAPTION, 1) != "", F.concat_ws("-", F.regexp_extract("cap", CAPTION, 1), F.regexp_extract("cap", CAPTION, 2)))
    has = F.coalesce(F.col("cap").rlike(CAPTION), F.lit(False))
    return runs.select(
        "doc_id", "first_line", "last_line", F.when(has, "body").otherwise("appendix").alias("kind"), F.when(has, F.regexp_extract("cap", CAPTION, 3)).alias("caption"),
        F.when(has, number).alias("number"), F.when(F.col("src").rlike(SOURCE), F.col("src")).alias("source"),
    )


def _orphan_captions(solid: Column) -> Column:
    """line_no, detail of bold caption lines that no table follows."""
    own = lambda x, i: (x["kind"] == "paragraph") & x["text"].contains("表") & (_kind(solid, i + 1) != "table") & _inner(x["text"], "**").rlike(CAPTION)
    return F.array_compact(F.transform(solid, lambda x, i: F.when(own(x, i), F.struct(x["line_no"].alias("line_no"), _inner(x["text"], "**").alias("detail")))))


def orphan_captions(texts: DataFrame) -> DataFrame:
    """doc_id, line_no, caption: bold caption lines that no table follows."""
    return texts.select("doc_id", F.inline(T.let(_solid(), _orphan_captions))).withColumnRenamed("detail", "caption")


def _orphan_figure_lines(solid: Column) -> Column:
    """line_no, detail of lines that look like a figure's reference, with no figure before or behind."""
    own = lambda x, i: (x["kind"] == "paragraph") & x["text"].contains("图") & F.trim(x["text"]).rlike(FIGURE_LINE) & (_kind(solid, i - 1) != "figure") & (_kind(solid, i + 1) != "figure")
    return F.array_compact(F.transform(solid, lambda x, i: F.when(own(x, i), F.struct(x["line_no"].alias("line_no"), F.trim(x["text"]).alias("detail")))))


def orphan_figure_lines(texts: DataFrame) -> DataFrame:
    """doc_id, line_no, text: lines that look like a figure's reference, with no figure before or behind; blank lines between do not count."""
    return texts.select("doc_id", F.inline(T.let(_solid(), _orphan_figure_lines))).withColumnRenamed("detail", "text")


def page_breaks(texts: DataFrame, appendix_breaks: bool = True) -> DataFrame:
    """doc_id, line_no (of the H2 behind it), origin (explicit: a rule stands before; auto: put in): where pages break.

    Pages break before H2 only: rules elsewhere, doubled ones, and those with nothing behind give none. Before the first H2
    that is neither front matter nor appendix the section break does it already, so none is put in there, and appendices get
    theirs if asked for. Before the first line of a text no page breaks.
    """
    appendix = lambda x: x["text"].rlike(r"^##\s*附录")
    first = F.get(F.filter("lines", lambda x: L.is_heading(x, 2) & ~appendix(x)), F.lit(0))["line_no"]

    def told(solid: Column) -> Column:
        explicit = lambda i: (i > 0) & (_kind(solid, i - 1) == "rule")
        h2 = lambda x, i: F.when(L.is_heading(x, 2) & (i > 0), F.struct(x["line_no"].alias("line_no"), explicit(i).alias("explicit"), appendix(x).alias("appendix")))
        return F.array_compact(F.transform(solid, h2))

    h2 = texts.select("doc_id", first.alias("first"), F.inline(T.let(_solid(), told)))
    auto = F.coalesce(F.col("line_no") != F.col("first"), F.lit(True)) & (~F.col("appendix") | F.lit(appendix_breaks))
    return h2.where(F.col("explicit") | auto).select("doc_id", "line_no", F.when(F.col("explicit"), "explicit").otherwise("auto").alias("origin"))


def statistics(texts: DataFrame) -> DataFrame:
    """doc_id, titles, chapters, sections (H1, H2, H3), figures, body_tables, appendix_tables, paragraphs (runs of paragraph lines): a row a text."""
    count = lambda match: F.size(F.filter("lines", match)).cast("long")
    level = lambda n: count(lambda x: L.is_heading(x, n))
    new = lambda lines: F.size(L.places(lines, lambda x, i: (x["kind"] == "paragraph") & ~((i > 0) & (_kind(lines, i - 1) == "paragraph")))).cast("long")
    body = F.filter("runs", lambda r: F.coalesce(r["cap"].rlike(CAPTION), F.lit(False)))
    counted = texts.where("lines is not null").select(
        "doc_id", level(1).alias("titles"), level(2).alias("chapters"), level(3).alias("sections"), count(lambda x: x["kind"] == "figure").alias("figures"),
        T.let(_solid(), _tables).alias("runs"), T.let(F.col("lines"), new).alias("paragraphs"),
    )
    return counted.select("doc_id", "titles", "chapters", "sections", "figures", F.size(body).cast("long").alias("body_tables"), (F.size("runs") - F.size(body)).cast("long").alias("appendix_tables"), "paragraphs")


def markdown_titles(docs: DataFrame) -> DataFrame:
    """doc_id, title (without its number), level (chapter, section, subsection): H2 to H4 outside fences, each title once, with the level it has last."""
    found = docs.select("doc_id", F.posexplode(F.split(T.without_fences(F.col("text")), "\n")).alias("at", "line")).where(F.col("line").rlike(r"^#{2,4}\s+\S"))
    depth = F.length(F.regexp_extract("line", "^#+", 0))
    bare = F.trim(F.regexp_replace("line", r"^#+", ""))
    title = F.when(depth == 2, outlines.without_number(bare)).otherwise(outlines.without_number(bare, outlines.SECTION_NUMBER))
    rows = found.select("doc_id", "at", title.alias("title"), F.element_at(F.array(F.lit("chapter"), F.lit("section"), F.lit("subsection")), depth - 1).alias("level")).where("title <> ''")
    return rows.groupBy("doc_id", "title").agg(F.max_by("level", "at").alias("level"))


def parents(subsections: DataFrame, sections: DataFrame) -> DataFrame:
    """Subsections with at (of their parent section; null for orphans): by number, else by title; the first that fits. subsections: doc_id, ordinal, title, parent, by_title (the parent is a title); sections: doc_id, ordinal, at, section_no, title."""
    s = sections.select("doc_id", "ordinal", "at", F.trim("section_no").alias("no"), F.trim("title").alias("name"))
    no = s.where("no <> ''").groupBy("doc_id", "ordinal", F.col("no").alias("key")).agg(F.min("at").alias("by_no"))
    name = s.where("name <> ''").groupBy("doc_id", "ordinal", F.col("name").alias("key")).agg(F.min("at").alias("by_name"))
    own = subsections.withColumn("key", F.trim("parent"))
    joined = own.join(no, ["doc_id", "ordinal", "key"], "left").join(name, ["doc_id", "ordinal", "key"], "left")
    at = F.when(F.col("by_title"), F.col("by_name")).otherwise(F.coalesce("by_no", "by_name"))
    return joined.select("doc_id", "ordinal", "title", "parent", at.alias("at"))


def overlay(headings: DataFrame, outline: DataFrame) -> DataFrame:
    """doc_id, line_no, title, kind, number, matched: headings take kind and number of the outline's entry of their title; others keep theirs. headings: doc_id, line_no, title, kind, number; outline: doc_id, title, kind, number."""
    first = outline.groupBy("doc_id", "title").agg(F.min(F.struct("number", "kind")).alias("o"))
    j = headings.join(first, ["doc_id", "title"], "left")
    return j.select("doc_id", "line_no", "title", F.coalesce("o.kind", "kind").alias("kind"), F.coalesce("o.number", "number").alias("number"), F.col("o").isNotNull().alias("matched"))


def unmatched(overlaid: DataFrame, strict: bool = False, samples: int = 5) -> DataFrame:
    """doc_id, kind, n, level, sample: headings that the outline lacks, by kind, with the first few titles. Locked kinds are warnings, in strict mode errors; subsections may be new; appendices are warnings."""
    rank = F.row_number().over(Window.partitionBy("doc_id", "kind").orderBy("line_no"))
    rows = overlaid.where(~F.col("matched") & F.col("kind").isin(*LOCKED, *FREE, "appendix")).withColumn("rank", rank)
    level = F.when(F.col("kind").isin(*FREE), "INFO").when(F.lit(strict) & F.col("kind").isin(*LOCKED), "ERROR").otherwise("WARNING")
    sample = F.transform(F.sort_array(F.collect_list(F.when(F.col("rank") <= samples, F.struct("rank", "title")))), lambda x: x["title"])
    return rows.groupBy("doc_id", "kind").agg(F.count("*").alias("n"), sample.alias("sample")).select("doc_id", "kind", "n", level.alias("level"), "sample")


def manifest(outline: DataFrame) -> DataFrame:
    """doc_id, chapters, sections, subsections, appendices: what an outline declares. outline: doc_id, kind."""
    kinds = {"chapters": "chapter", "sections": "section", "subsections": "subsection", "appendices": "appendix"}
    return outline.groupBy("doc_id").agg(*[F.count_if(F.col("kind") == k).alias(n) for n, k in kinds.items()])


def first_of(findings: DataFrame, by: str, order: list[Column], most: int) -> DataFrame:
    """The first rows of each group by an order: what a report shows of it."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return findings.withColumn("shown", rank).where(F.col("shown") <= most)


def strict_levels(level: Column, code: Column, spared: list[str]) -> Column:
    """In strict mode errors are fatal, but for the spared codes."""
    return F.when((level == "ERROR") & ~code.isin(spared), "FATAL").otherwise(level)




def validated(docs: DataFrame) -> DataFrame:
    """doc_id, check, detail: all that a merged text's own lines tell: captions without table, figure lines without figure, words that point by place, figures and tables mentioned or captioned without their partner, and numbers of figures and tables that leave a gap within their chapter."""
    # a text's own lines are asked in its row; what is counted by number meets in one shuffle each
    orphans = lambda f, name: F.transform(f, lambda x: F.struct(F.lit(name).alias("check"), x["detail"].alias("detail")))
    both = lambda solid: F.concat(orphans(_orphan_captions(solid), "orphan_caption"), orphans(_orphan_figure_lines(solid), "orphan_figure_line"))
    found = L.texts(docs).select("doc_id", F.inline(T.let(_solid(), both)))
    found = found.unionByName(drafts.positional_words(docs).select("doc_id", F.lit("positional").alias("check"), F.col("context").alias("detail")))
    said = figures.mention_findings(L.fenced_texts(docs).select("doc_id", F.inline("lines")).where(~F.col("in_fence")).select("doc_id", "line_no", "text"))
    found = found.unionByName(said.select("doc_id", F.col("finding").alias("check"), F.concat("kind", "no").alias("detail")))
    named = F.transform(F.filter(F.split("text", "\n"), lambda x: x.rlike(figures.CAPTION)), lambda x: F.struct(F.regexp_extract(x, figures.CAPTION, 1).alias("kind"), F.regexp_extract(x, figures.CAPTION, 2).alias("no")))
    keyed = lambda n: F.struct(n["kind"].alias("kind"), F.regexp_extract(n["no"], r"^(\d+)-", 1).alias("chapter"), F.regexp_extract(n["no"], r"-(\d+)$", 1).try_cast("int").alias("seq"))
    rows = docs.select("doc_id", F.inline(F.array_distinct(F.transform(named, keyed)))).select(F.struct("doc_id", "kind", "chapter").alias("by"), "seq")
    gaps = R.distinct_gaps(rows, "by", "seq")
    return found.unionByName(gaps.select("by.doc_id", F.lit("number_gap").alias("check"), F.concat("by.kind", "by.chapter", F.lit("-"), "seq").alias("detail")))
