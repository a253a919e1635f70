"""Documents as lines, blocks and paragraphs. Every row carries (doc_id, line_no): nothing relies on the order of partitions.

A document's lines are one window partition, so windows are bounded by the longest document. doc_id tells documents apart:
number rows first where ids repeat.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import text as T


def _order():  # noqa: ANN202
    return Window.partitionBy("doc_id").orderBy("line_no")


def _running():  # noqa: ANN202
    return _order().rowsBetween(Window.unboundedPreceding, 0)


#: How lines begin that are no body text: headings, quotes, table rows, figures.
NOT_BODY = r"^(#|>|\||!\[)"


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, line_no (from 1), text; a null text has no lines."""
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(F.col(text_col), "\n")).alias("at", "text")).select("doc_id", (F.col("at") + 1).alias("line_no"), "text")


def _inside(parts: Column) -> Column:
    """Of each line "f" where it is a closed fence's mark or lies between two. The marks cut a string of one character a line into segments; every other one lies inside."""
    marks = F.array_join(F.transform(parts, lambda p: F.when(F.trim(p).startswith("```"), "`").otherwise(".")), "")

    def told(segments: Column) -> Column:
        closed = F.size(segments) - 1 - (F.size(segments) - 1) % 2
        mark = lambda i: F.when(i == 0, "").when(i <= closed, "f").otherwise(".")
        between = lambda s, i: F.repeat(F.when((i % 2 == 1) & (i <= closed), "f").otherwise("."), F.length(s))
        return F.split(F.array_join(F.transform(segments, lambda s, i: F.concat(mark(i), between(s, i))), ""), "")

    return T.let(F.split(marks, "`"), told)


def fenced_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lines (line_no, text, in_fence): a row's lines as an array in the row itself, so nothing is shuffled; null for a null text."""
    text = F.col(text_col)

    def told(parts: Column) -> Column:
        inside = F.when(F.contains(text, F.lit("```")), _inside(parts))
        line = lambda on: lambda p, i: F.struct((i + 1).alias("line_no"), p.alias("text"), F.coalesce(F.get(on, i) == "f", F.lit(False)).alias("in_fence"))
        return T.let(inside, lambda on: F.transform(parts, line(on)))

    return docs.select(F.col(id_col).alias("doc_id"), T.let(F.split(text, "\n"), told).alias("lines"))


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lines (line_no, text, in_fence, kind, level of headings, else 0): a row's lines as an array in the row itself; null for a null text."""
    return fenced_texts(docs, id_col, text_col).select("doc_id", with_kinds(F.col("lines")).alias("lines"))


def with_kinds(lines: Column) -> Column:
    """Lines of fenced_texts() with their kinds and levels, as texts() gives them."""
    kind = lambda r: F.struct(r["line_no"].alias("line_no"), r["text"].alias("text"), r["in_fence"].alias("in_fence"), line_kind(r["text"], r["in_fence"]).alias("kind"))
    level = lambda r: F.when(r["kind"] == "heading", F.length(F.regexp_extract(r["text"], "^#+", 0))).otherwise(0)
    return F.transform(F.transform(lines, kind), lambda r: F.struct(*[r[c].alias(c) for c in ("line_no", "text", "in_fence", "kind")], level(r).alias("level")))


def is_heading(line: Column, level: int) -> Column:
    """Whether a line of texts() is a heading of this level."""
    return (line["kind"] == "heading") & (line["level"] == level)


def places(lines: Column, match: Callable[[Column, Column], Column]) -> Column:
    """Places (from 0) of the lines for which match(line, place) holds."""
    return F.array_compact(F.transform(lines, lambda x, i: F.when(match(x, i), i)))


def fenced(rows: DataFrame) -> DataFrame:
    """Adds in_fence: a ``` line or a line between a pair of them. A last fence without its partner protects nothing."""
    return fenced_marks(rows).drop("seen")


def fenced_marks(rows: DataFrame) -> DataFrame:
    """Adds in_fence, as fenced(), and seen: how many ``` lines there are up to each line. Both sums are frames of one window."""
    mark = F.trim("text").startswith("```")
    whole = _order().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumns({"seen": F.sum(mark.cast("int")).over(_running()), "__total": F.sum(mark.cast("int")).over(whole)})
    inside = (F.col("seen") <= F.col("__total") - F.col("__total") % 2) & ((F.col("seen") % 2 == 1) | mark) & (F.col("seen") > 0)
    return rows.withColumn("in_fence", inside).drop("__total")


def line_kind(text: Column, in_fence: Column) -> Column:
    """Kind of a line, by fixed priority: fence, blank, heading, rule, figure, table, list, ordered list, quote, paragraph."""
    s = F.trim(text)
    # a line is held against a pattern only if it begins as the pattern does; within an array, Spark leaves the loop of isin() by an exception
    begins = lambda marks: F.contains(F.lit(marks), F.substring(s, 1, 1))
    return (
        F.when(in_fence, "fence").when(s == "", "blank").when(text.startswith("#") & text.rlike(r"^#{1,6}\s+\S"), "heading").when(begins("-*_") & s.rlike(r"^(-{3,}|\*{3,}|_{3,})$"), "rule")
        .when(s.startswith("![") & s.rlike(r"^!\[[^\]]*\]\([^)]*\)$"), "figure").when(s.startswith("|"), "table").when(begins("-*+") & s.rlike(r"^[-*+]\s+\S"), "list")
        .when(begins("0123456789") & s.rlike(r"^\d+[.)]\s+\S"), "ordered").when(s.startswith(">"), "quote").otherwise("paragraph")
    )


def classified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, line_no, text, in_fence, kind, level (of headings, else 0): the lines of texts() as rows, without a shuffle."""
    return texts(docs, id_col, text_col).select("doc_id", F.inline("lines"))


def blocks(rows: DataFrame) -> DataFrame:
    """Neighbouring lines of one kind as blocks: doc_id, kind, first_line, last_line, n_lines. Headings, rules and figures stand alone; blanks end a block."""
    alone = F.col("kind").isin("heading", "rule", "figure")
    new = (F.coalesce(F.lag("kind").over(_order()), F.lit("")) != F.col("kind")) | alone
    numbered = rows.withColumn("block", F.sum(new.cast("int")).over(_running())).where("kind <> 'blank'")
    return numbered.groupBy("doc_id", "block").agg(F.first("kind").alias("kind"), F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"), F.count("*").alias("n_lines")).drop("block")


def paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", letters: str = T.CJK) -> DataFrame:
    """doc_id, paragraph (from 1), text, chars. A blank line ends a paragraph; headings, quotes, table rows and figures are skipped but end none;
    lines join without a separator; a paragraph without one character of the class is none."""
    rows = lines(docs.select(F.col(id_col).alias("doc_id"), T.without_fences(F.col(text_col)).alias("text")))
    s = F.trim(F.regexp_replace("text", r"(?U)^\s+|\s+$", ""))
    rows = rows.withColumn("text", s).withColumn("island", F.sum((F.col("text") == "").cast("int")).over(_running()))
    body = rows.where((F.col("text") != "") & ~F.col("text").rlike(NOT_BODY))
    joined = body.groupBy("doc_id", "island").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "").alias("text"))
    counted = joined.withColumn("chars", T.class_count(F.col("text"), letters)).where("chars > 0")
    return counted.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("island")).alias("paragraph"), "text", "chars")


def paragraph_stats(paras: DataFrame, by: str = "doc_id") -> DataFrame:
    """Distribution of paragraph lengths: count, mean (one decimal), p25, p50, p75, p90 (value at the floor index), over_600, under_150, ideal_range (150 to 400), longest."""
    grouped = paras.groupBy(by).agg(
        F.count("*").alias("count"), F.round(F.avg("chars"), 1).alias("mean"), F.sort_array(F.collect_list("chars")).alias("all"), F.count_if(F.col("chars") > 600).alias("over_600"),
        F.count_if(F.col("chars") < 150).alias("under_150"), F.count_if(F.col("chars").between(150, 400)).alias("ideal_range"), F.max("chars").alias("longest"),
    )
    return grouped.select(by, "count", "mean", *[T.median_rank(F.col("all"), p).alias(f"p{p}") for p in (25, 50, 75, 90)], "over_600", "under_150", "ideal_range", "longest")


def paragraph_percentiles(paras: DataFrame, by: str) -> DataFrame:
    """p25 to p90 of a large group, without gathering it: counts by length, running sums, and the first length that reaches the floor index."""
    counts = paras.groupBy(by, "chars").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(by).orderBy("chars").rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("n").over(Window.partitionBy(by))
    ranked = counts.select(by, "chars", "n", upto.alias("upto"), total.alias("total"))
    at = lambda p: F.min(F.when(F.col("upto") > F.least(F.col("total") - 1, F.floor(F.col("total") * p / 100)), F.col("chars"))).alias(f"p{p}")
    return ranked.groupBy(by).agg(F.first("total").alias("count"), *[at(p) for p in (25, 50, 75, 90)], F.max("chars").alias("longest"))


def body_chars(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", letters: str = T.CJK) -> DataFrame:
    """doc_id, chars, pages (800 characters each, one decimal): headings, quotes, tables, figures and fence marks do not count; what fences hold does."""
    rows = lines(docs, id_col, text_col).withColumn("s", F.trim("text"))
    counted = rows.select("doc_id", F.when(F.col("s").rlike(r"^(#|>|\||!\[|```)"), 0).otherwise(T.class_count(F.col("s"), letters)).alias("n"))
    return counted.groupBy("doc_id").agg(F.sum("n").cast("long").alias("chars")).withColumn("pages", F.round(F.col("chars") / 800, 1))


def density(paras: DataFrame, least: int = 300) -> DataFrame:
    """doc_id, chars, points (citations and numbers), chars_per_point, below: text without points, or with more characters a point than allowed."""
    per_doc = with_points(paras).groupBy("doc_id").agg(F.sum("chars").alias("chars"), F.sum("points").alias("points"))
    ratio = F.when(F.col("points") > 0, F.round(F.col("chars") / F.col("points"), 1))
    return per_doc.withColumn("chars_per_point", ratio).withColumn("below", ((F.col("points") == 0) & (F.col("chars") > 0)) | F.coalesce(F.col("chars_per_point") > least, F.lit(False)))


#: Citation marks like [1, 2], and numbers with decimals or a percent sign.
CITATION, NUMBER = r"\[[0-9]+(?:,\s*[0-9]+)*\]", r"[0-9]+(?:\.[0-9]+)?%?"


def with_points(paras: DataFrame) -> DataFrame:
    """Adds points: citations, and numbers outside them."""
    return paras.withColumn("points", T.class_count(F.col("text"), CITATION) + T.class_count(F.regexp_replace("text", CITATION, ""), NUMBER))


def no_data_runs(rows: DataFrame, threshold: int = 500, by: str = "doc_id", order: str = "paragraph") -> DataFrame:
    """Runs of rows without points whose characters reach the threshold: by, order (where it is first reached), running_chars. rows: by, order, chars, points."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    run = rows.withColumn("run", F.sum((F.col("points") > 0).cast("int")).over(w))
    inside = Window.partitionBy(by, "run").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    run = run.withColumn("running_chars", F.sum(F.when(F.col("points") > 0, 0).otherwise(F.col("chars"))).over(inside))
    before = F.lag("running_chars", 1, 0).over(Window.partitionBy(by, "run").orderBy(order))
    return run.withColumn("before", before).where((F.col("running_chars") >= threshold) & (F.col("before") < threshold)).select(by, order, "running_chars")


def runs_of(rows: DataFrame, by: str, order: str, match: Column, least: int = 3) -> DataFrame:
    """Runs of at least so many neighbouring rows that match: by, first, last, n. order: consecutive whole numbers."""
    hit = rows.where(match)
    island = F.col(order) - F.row_number().over(Window.partitionBy(by).orderBy(order))
    return hit.withColumn("island", island).groupBy(by, "island").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n")).where(F.col("n") >= least).drop("island")


#: Fixed value: how a metadata line begins.
METADATA = r"^\*{0,2}[^:：*]{1,12}\*{0,2}[:：]\s*\S"


def _is_metadata(text: Column, kind: Column, limit: str) -> Column:
    return kind.isin("paragraph", "quote") & F.trim(text).rlike(limit)


def _metadata_part(text: Column, part: int) -> Column:
    return F.trim(F.regexp_extract(F.regexp_replace(text, r"[*>]", ""), r"^\s*([^:：]+)[:：]\s*(.*)$", part))


def metadata_lines(rows: DataFrame, limit: str = METADATA) -> DataFrame:
    """Metadata lines (name: value): only behind the first H1, up to the first line that is neither blank nor metadata. rows: classified(). Gives doc_id, line_no, name, value."""
    doc = Window.partitionBy("doc_id")
    title = F.min(F.when((F.col("kind") == "heading") & (F.col("level") == 1), F.col("line_no"))).over(doc)
    rows = rows.withColumn("title", title).where(F.col("line_no") > F.col("title"))
    is_meta = _is_metadata(F.col("text"), F.col("kind"), limit)
    ends = F.coalesce(F.min(F.when(~is_meta & (F.col("kind") != "blank"), F.col("line_no"))).over(doc), F.lit(1 << 30))
    inside = rows.withColumn("ends", ends).where((F.col("line_no") < F.col("ends")) & is_meta)
    return inside.select("doc_id", "line_no", _metadata_part(F.col("text"), 1).alias("name"), _metadata_part(F.col("text"), 2).alias("value"))


def own_metadata(lines: Column) -> Column:
    """line_no, name, value: the metadata lines of a text, as metadata_lines(), from its lines as texts() gives them."""
    title = F.get(F.filter(lines, lambda x: is_heading(x, 1)), F.lit(0))["line_no"]
    told = lambda x: F.struct(x["line_no"].alias("line_no"), _metadata_part(x["text"], 1).alias("name"), _metadata_part(x["text"], 2).alias("value"))
    is_meta = lambda x: _is_metadata(x["text"], x["kind"], METADATA)

    def upto_the_end(below: Column) -> Column:
        ends = F.coalesce(F.get(F.filter(below, lambda x: ~is_meta(x) & (x["kind"] != "blank")), F.lit(0))["line_no"], F.lit(1 << 30))
        return T.let(ends, lambda ends: F.transform(F.filter(below, lambda x: (x["line_no"] < ends) & (x["kind"] != "blank")), told))

    return T.let(F.slice(lines, title + 1, F.size(lines)), upto_the_end)


def without_blocks(rows: DataFrame, heading: str) -> DataFrame:
    """Drops headings that match and all below them, up to the next heading of their level or above. rows: classified()."""
    is_heading = F.col("kind") == "heading"
    hit = is_heading & F.col("text").rlike(heading)
    # a hit drops all up to the next heading of its level or above: the next heading of each level or above, then the furthest end so far
    behind = _order().rowsBetween(1, Window.unboundedFollowing)
    ends = [F.coalesce(F.min(F.when(is_heading & (F.col("level") <= n), F.col("line_no"))).over(behind), F.lit(1 << 30)) for n in range(1, 7)]
    end = F.when(hit, F.element_at(F.array(*ends), F.greatest("level", F.lit(1))))
    dropped = F.coalesce(F.max("__end").over(_running()), F.lit(0))
    return rows.withColumn("__end", end).withColumn("__off", dropped).where(F.col("__off") <= F.col("line_no")).drop("__end", "__off")


def quotes(rows: DataFrame) -> DataFrame:
    """Straight double quotes outside fences become opening and closing ones in turn, over the whole document. rows: classified()."""
    n = F.when(F.col("in_fence"), 0).otherwise(F.coalesce(F.regexp_count("text", F.lit('"')), F.lit(0)))
    before = F.coalesce(F.sum(n).over(_order().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = F.split("text", '"')
    mark = lambda i: F.when((before + i) % 2 == 1, "“").otherwise("”")
    turned = F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(mark(i), p))), "")
    return rows.withColumn("turned", F.when(F.col("in_fence"), F.col("text")).otherwise(turned)).withColumn("text", F.col("turned")).drop("turned")


def demoted(rows: DataFrame, levels: int) -> DataFrame:
    """Headings so many levels down, level 6 at most, not in fences. rows: classified()."""
    to = F.least(F.col("level") + levels, F.lit(6))
    text = F.when(F.col("kind") == "heading", F.concat(F.repeat(F.lit("#"), to), F.regexp_replace("text", "^#+", ""))).otherwise(F.col("text"))
    return rows.withColumn("text", text).withColumn("level", F.when(F.col("kind") == "heading", to).otherwise(0))


def joined(rows: DataFrame, by: str = "doc_id", order: str = "line_no", separator: str = "\n") -> DataFrame:
    """Lines as texts again: by, text."""
    parts = F.transform(F.sort_array(F.collect_list(F.struct(order, "text"))), lambda x: x["text"])
    return rows.groupBy(by).agg(F.array_join(parts, separator, "").alias("text"))


def table_cells(rows: DataFrame) -> DataFrame:
    """Cells of pipe tables: doc_id, table (from 1), row, col, cell. A table is a run of pipe lines whose second is a separator. rows: classified()."""
    is_row = F.col("kind") == "table"
    new = is_row & (F.coalesce(F.lag("kind").over(_order()), F.lit("")) != "table")
    t = rows.withColumn("run", F.sum(new.cast("int")).over(_running())).where(is_row)
    t = t.withColumn("row", F.row_number().over(Window.partitionBy("doc_id", "run").orderBy("line_no")))
    separator = F.trim("text").rlike(r"^\|[\s:\-|]+\|$")
    t = t.withColumn("ok", F.max(((F.col("row") == 2) & separator).cast("int")).over(Window.partitionBy("doc_id", "run"))).where("ok = 1")
    t = t.withColumn("table", F.dense_rank().over(Window.partitionBy("doc_id").orderBy("run"))).where("row <> 2")
    inner = F.regexp_replace(F.regexp_replace(F.trim("text"), r"^\|", ""), r"\|$", "")
    cells = t.select("doc_id", "table", F.when(F.col("row") > 2, F.col("row") - 1).otherwise(F.col("row")).alias("row"), F.posexplode(F.split(inner, r"\|")).alias("at", "cell"))
    return cells.select("doc_id", "table", "row", (F.col("at") + 1).alias("col"), F.trim("cell").alias("cell"))
