"""Outlines: chapters and sections as rows, the structure gate, titles against headings, and drafts put in outline order.

chapters: doc_id, ordinal, chapter_no, title, is_appendix. sections: doc_id, ordinal (of the chapter), at, section_no, title.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import text as T
from ledgerloom.operators import references as R
from ledgerloom.sources import readers

#: What leads a chapter's and a section's title, and what an outline may look like, in its old and its new form.
CHAPTER_NUMBER = r"^\s*(?:第\s*[0-9一二三四五六七八九十百]+\s*章\s*[：:、.]?\s*|[0-9]+\s*[.、：:]\s*|[一二三四五六七八九十]+\s*[、.：:]\s*)"
SECTION_NUMBER = r"^\s*(?:[0-9]+(?:\.[0-9]+)+\s*[.、：:]?\s*|第\s*[0-9一二三四五六七八九十百]+\s*节\s*[：:、.]?\s*)"
_SECTION = "struct<section_no:string,section_title:string>"
_CHAPTER = f"struct<chapter_no:string,chapter_title:string,appendix_title:string,is_appendix:boolean,sections:array<{_SECTION}>>"
OUTLINE = f"struct<structure:struct<title:string,chapters:array<{_CHAPTER}>,frontmatter:array<{_CHAPTER}>,bodymatter:array<{_CHAPTER}>,appendix:array<{_CHAPTER}>>>"


def read(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """chapters and sections of the outlines in front matter; the old form (three regions) becomes the new one: one list, appendices lettered."""
    s = readers.yaml_blocks(docs, OUTLINE).select("doc_id", "data.structure.*")
    plain = lambda c: F.coalesce(F.filter(c, lambda x: x.isNotNull()), F.array().cast(f"array<{_CHAPTER}>"))
    title = lambda x: F.coalesce(x["chapter_title"], x["appendix_title"], F.lit(""))
    row = lambda no, x, app: F.struct(no.alias("chapter_no"), title(x).alias("title"), app.alias("is_appendix"), x["sections"].alias("sections"))
    new = F.transform(plain("chapters"), lambda x: row(x["chapter_no"], x, F.coalesce(x["is_appendix"], F.lit(False)) | F.coalesce(x["chapter_no"].rlike(r"^\p{L}"), F.lit(False))))
    body = F.transform(F.concat(plain("frontmatter"), plain("bodymatter")), lambda x, i: row((i + 1).cast("string"), x, F.lit(False)))
    letter = lambda i: F.when(i < 26, F.char((i + 65).cast("long"))).otherwise(F.concat(F.lit("APP"), i.cast("string")))
    old = F.concat(body, F.transform(plain("appendix"), lambda x, i: row(letter(i), x, F.lit(True))))
    rows = s.select("doc_id", F.posexplode(F.when(F.col("chapters").isNotNull(), new).otherwise(old)).alias("ordinal", "c"))
    chapters = rows.select("doc_id", "ordinal", "c.chapter_no", "c.title", "c.is_appendix")
    sections = rows.select("doc_id", "ordinal", F.posexplode("c.sections").alias("at", "s")).select("doc_id", "ordinal", "at", "s.section_no", F.col("s.section_title").alias("title"))
    return chapters, sections


def without_number(title: Column, pattern: str = CHAPTER_NUMBER) -> Column:
    """A title without its number."""
    return F.trim(F.regexp_replace(F.coalesce(title, F.lit("")), pattern, ""))


def title_gaps(chapters: DataFrame, headings: DataFrame) -> DataFrame:
    """doc_id, title, side: titles, without numbers, that only the outline (left) or only the text (right) has. headings: doc_id, title."""
    bare = lambda d: d.select("doc_id", without_number(F.col("title")).alias("title")).where("title <> ''").distinct()
    return R.difference(bare(chapters), bare(headings), "doc_id", "title")


def gate(docs: DataFrame, chapters: DataFrame, sections: DataFrame, headings: DataFrame, least_sections: int = 2) -> DataFrame:
    """doc_id, rule, level, hits, passed: one row a document and rule.

    S1: it has chapters. S2: each has a title. S3: each but an appendix has least_sections sections. S4: each section has a
    number and a title (a section lacking both counts twice). S5: outline and text have the same titles. S6: titles of sections hold no number.
    """
    blank = lambda c: (F.trim(F.coalesce(c, F.lit(""))) == "").cast("int")
    per_chapter = sections.groupBy("doc_id", "ordinal").agg(
        F.count("*").alias("n"), F.sum(blank(F.col("section_no")) + blank(F.col("title"))).alias("S4"),
        F.count_if((blank(F.col("title")) == 0) & (without_number(F.col("title"), SECTION_NUMBER) != F.trim("title"))).alias("S6"),
    )
    few = ~F.coalesce("is_appendix", F.lit(False)) & (F.coalesce("n", F.lit(0)) < least_sections)
    found = chapters.join(per_chapter, ["doc_id", "ordinal"], "left").groupBy("doc_id").agg(F.sum(blank(F.col("title"))).alias("S2"), F.count_if(few).alias("S3"), F.sum("S4").alias("S4"), F.sum("S6").alias("S6"), F.lit(0).alias("S1"))
    gaps = title_gaps(chapters, headings).groupBy("doc_id").agg(F.count("*").alias("S5"))
    wide = docs.select("doc_id").join(found, "doc_id", "left").join(gaps, "doc_id", "left").withColumn("S1", F.coalesce("S1", F.lit(1)))
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit("FATAL" if r < "S5" else "WARNING").alias("level"), F.coalesce(r, F.lit(0)).cast("long").alias("hits")) for r in ("S1", "S2", "S3", "S4", "S5", "S6")])
    return wide.select("doc_id", F.inline(rules)).withColumn("passed", F.col("hits") == 0)


def gate_verdicts(found: DataFrame, mode: str = "warn") -> DataFrame:
    """doc_id, s1_s4_passed, passed: strict stops at S1 to S4; warn only tells."""
    return found.groupBy("doc_id").agg(F.every(F.col("passed") | (F.col("level") != "FATAL")).alias("s1_s4_passed")).withColumn("passed", F.col("s1_s4_passed") | F.lit(mode != "strict"))


def merged(chapters: DataFrame, sections: DataFrame, drafts: DataFrame) -> DataFrame:
    """doc_id, text: drafts in the outline's order. drafts: doc_id, chapter_no, section_no (null: of the whole chapter), name, text.

    A section takes the draft of its number, else its chapter's; a draft is taken once a chapter; where there is none, a placeholder stands.
    """
    slots = chapters.select("doc_id", "ordinal", "chapter_no").join(sections.select("doc_id", "ordinal", "at", "section_no", "title"), ["doc_id", "ordinal"])
    keys = ["doc_id", "chapter_no", "section_no"]
    first = lambda d, k: d.groupBy(*k).agg(F.min_by(F.struct("name", "text"), "name").alias("hit"))
    own = first(drafts.where("section_no is not null"), keys).withColumnRenamed("hit", "own")
    whole = first(drafts.where("section_no is null"), keys[:2]).withColumnRenamed("hit", "whole")
    rows = slots.join(own, keys, "left").join(whole, keys[:2], "left").withColumn("hit", F.coalesce("own", "whole"))
    once = Window.partitionBy("doc_id", "ordinal", "hit.name").orderBy("at")
    rows = rows.withColumn("nth", F.row_number().over(once)).where("nth = 1 or hit is null")
    text = F.coalesce("hit.text", F.concat(F.lit("<!-- missing: "), F.coalesce("section_no", F.lit("?")), F.lit(" -->")))
    ordered = F.sort_array(F.collect_list(F.struct("ordinal", "at", text.alias("text"))))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n\n").alias("text"))


#: What stands for text in a skeleton, and its section for sources.
PLACEHOLDER, SOURCES = "> （待写作）", "## 参考文献"


def chapter_number(raw: Column) -> Column:
    """A chapter's number as a whole number: what stands before a dot; 0 where there is none."""
    return F.coalesce(F.regexp_extract(F.trim(F.coalesce(raw.cast("string"), F.lit(""))), r"^(-?\d+)(?:\.|$)", 1).try_cast("int"), F.lit(0))


def display_number(kind: Column, n1: Column, n2: Column, n3: Column, letter: Column) -> Column:
    """What a heading shows as its number, by kind: 第三章, 1.2, 1.2.3, 附录A; nothing for others."""
    return (
        F.when(kind == "chapter", F.concat(F.lit("第"), T.chinese_numeral(n1), F.lit("章"))).when(kind == "section", F.concat_ws(".", n1, n2))
        .when(kind == "subsection", F.concat_ws(".", n1, n2, n3)).when(kind == "appendix", F.concat(F.lit("附录"), letter)).otherwise("")
    )


def section_entries(chapters: DataFrame, sections: DataFrame) -> DataFrame:
    """sections, and for chapters without any one of their own number and title, so that their drafts are found."""
    none = chapters.join(sections.select("doc_id", "ordinal").distinct(), ["doc_id", "ordinal"], "left_anti")
    return sections.unionByName(none.select("doc_id", "ordinal", F.lit(0).alias("at"), F.col("chapter_no").alias("section_no"), "title"))


def skeleton(chapters: DataFrame, sections: DataFrame) -> DataFrame:
    """doc_id, text: outlines as Markdown with a placeholder below each section; chapters without sections say so, the section for sources stands before the appendices."""
    rank = lambda a, o, s, k: F.struct(a.alias("a"), o.alias("o"), s.alias("s"), k.alias("text"))
    app, note = F.coalesce("is_appendix", F.lit(False)), "> 本章在大纲中未声明任何节。"
    bare = without_number(F.col("title"))
    heads = chapters.join(sections.groupBy("doc_id", "ordinal").agg(F.count("*").alias("n")), ["doc_id", "ordinal"], "left")
    name = F.when(app, F.concat(F.lit("## 附录"), F.coalesce("chapter_no", F.lit("")), F.lit("："), bare)).otherwise(F.concat(F.lit("## "), F.when(bare == "", "(未命名章)").otherwise(bare)))
    body = F.when(app, F.concat(name, F.lit("\n\n" + PLACEHOLDER))).when(F.col("n").isNull(), F.concat(name, F.lit("\n\n" + note))).otherwise(name)
    parts = heads.select("doc_id", rank(app.cast("int") * 2, F.col("ordinal"), F.lit(-1), body).alias("p"))
    own = sections.join(chapters.select("doc_id", "ordinal", app.cast("int").alias("app")), ["doc_id", "ordinal"]).where(F.trim("title") != "")
    parts = parts.unionByName(own.select("doc_id", rank(F.col("app") * 2, F.col("ordinal"), F.col("at"), F.concat(F.lit("### "), without_number(F.col("title"), SECTION_NUMBER), F.lit("\n\n" + PLACEHOLDER))).alias("p")))
    parts = parts.unionByName(chapters.select("doc_id").distinct().select("doc_id", rank(F.lit(1), F.lit(0), F.lit(0), F.lit(SOURCES)).alias("p")))
    return parts.groupBy("doc_id").agg(F.concat(F.array_join(F.transform(F.sort_array(F.collect_list("p")), lambda p: p["text"]), "\n\n"), F.lit("\n")).alias("text"))


#: Numbers before headings, by their level: chapters and parts, sections, subsections, appendices.
HEADING_NUMBERS = {
    2: [
        r"^第\s*([一二三四五六七八九十百零两〇]{1,4})\s*(?:章|部分|篇|编)\s*[：:、．.]?\s*", r"^第\s*(\d{1,3})\s*(?:章|部分|篇|编)\s*[：:、．.]?\s*", r"^(\d{1,3})[.、．]\s*", r"^([一二三四五六七八九十〇]{1,3})[、．.]\s*",
        r"^附录\s*([A-Za-z]|[一二三四五六七八九十]{1,3})?\s*[：:、．.]?\s*",
    ],
    3: [r"^(\d{1,2})[.．](\d{1,2})[.、]?(?:[ 　]+|(?=[一-鿿（【《“「]))", r"^(\d{1,3})[.、．]\s+"],
    4: [r"^(\d{1,2})[.．](\d{1,2})[.．](\d{1,2})[.、]?(?:[ 　]+|(?=[一-鿿（【《“「]))", r"^(\d{1,2})[.．](\d{1,2})[.、]?\s+"],
}


def without_heading_number(title: Column, level: Column) -> Column:
    """A heading's text without the number that its level may have: the first pattern that fits is taken off."""
    out = title
    for n, patterns in HEADING_NUMBERS.items():
        taken = title
        for p in reversed(patterns):
            taken = F.when(title.rlike(p), F.regexp_replace(title, p, "")).otherwise(taken)
        out = F.when(level == n, F.trim(taken)).otherwise(out)
    return out


def flat_titles(chapters: DataFrame, sections: DataFrame, subsections: DataFrame) -> DataFrame:
    """doc_id, title (without its number), level: all titles of outlines, each once, with the level that it has last (appendices are chapters). subsections: doc_id, ordinal, at (of the section), title."""
    place = lambda a, b, c: F.struct(a.alias("a"), b.alias("b"), c.alias("c"))
    none = F.lit(-1)
    rows = chapters.select("doc_id", place(F.col("ordinal"), none, none).alias("p"), without_number(F.col("title")).alias("title"), F.lit("chapter").alias("level"))
    rows = rows.unionByName(sections.select("doc_id", place(F.col("ordinal"), F.col("at"), none).alias("p"), without_number(F.col("title"), SECTION_NUMBER).alias("title"), F.lit("section").alias("level")))
    rows = rows.unionByName(subsections.select("doc_id", place(F.col("ordinal"), F.col("at"), F.lit(0)).alias("p"), without_number(F.col("title"), SECTION_NUMBER).alias("title"), F.lit("subsection").alias("level")))
    return rows.where("title <> ''").groupBy("doc_id", "title").agg(F.max_by("level", "p").alias("level"))


def forbidden_words(texts: DataFrame, pattern: str) -> DataFrame:
    """doc_id, word: what a built text must not hold, each word once: the check of a skeleton on itself."""
    return texts.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(f"({pattern})"), 1))).alias("word"))
