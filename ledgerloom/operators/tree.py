"""Documents as trees of typed blocks, and the checks that hold a whole document against itself, in the document's own row.

A node has its first line's number, twice, plus one if it is a part of a block (an item of a list, a row of a table): list
and first item share a line. Parents: of a heading the last one of a smaller level before it; of a top item its list, of
an item further in the last one before it that is less far in; of a quote the last one before it in its run that is less
deep; of rows, caption and source their table; of all else the last heading. Neighbouring items of one sort are one list,
a change of sort among the top ones begins another.

The nearest row before with a smaller value (level, indentation, depth) is found by windows: each row asks once for each
smaller value of its run, which are fewer than the blanks, marks or signs that it begins with; so the rows are as many as
the characters of the text at most, and no list of a document is gathered.

The checks need no parents: each document is cut, in its own row, into pieces (paragraphs and quotes as blocks, other lines
one by one) and these into the runs of a chapter, a number or an element, by slices and sorted arrays; so each step takes
as long as the document, and only faults are shuffled, to be held against the files that are there.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import text as T
from ledgerloom.operators import findings as N
from ledgerloom.operators import lines as L
from ledgerloom.operators import structure as S
from ledgerloom.operators.ranks import table_of

#: How figures are written, how chapters and appendices are numbered (the first that fits), what mentions a figure or table.
FIGURE = r"^!\[([^\]]*)\]\((.+?)(?:\s+\"[^\"]*\")?\)$"
FIGURE_NUMBER = r"^图(\d{1,2})-(\d{1,2})(?:[ 　]+|[：:][ 　]*).+$"
CHAPTERS = [
    r"^第\s*([一二三四五六七八九十百零两〇]{1,4})\s*(?:章|部分|篇|编)", r"^第\s*(\d{1,3})\s*(?:章|部分|篇|编)",
    r"^(\d{1,3})[.、．]", r"^([一二三四五六七八九十〇]{1,3})[、．.]",
]
APPENDIX = r"^附录\s*([A-Za-z])?"
MENTION = r"[图表]\d{1,2}-\d{1,2}"
SHORT_TITLE = "页眉简称"
#: Kinds of pieces that may hold mentions, and the code of a figure without its file.
PROSE, NO_FILE = ("paragraph", "list", "ordered", "quote"), "E-IMG-01"
#: A character of each word that checks look for in prose: a line without any is not asked.
ASKED = "[图表密内]"


def under(rows: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """rows (order once each within by) with above: the order of the nearest row before, within by, that has a smaller value; null if there is none."""
    asked = rows.withColumn("__values", F.array_distinct(F.collect_set(value).over(Window.partitionBy(*by))))
    # an event for each row, at its own value, and a question for each smaller one; the last event before a question answers it
    smaller = F.transform(F.filter("__values", lambda v: v < F.col(value)), lambda v: F.struct(v.alias("less"), F.lit(False).alias("event")))
    own = F.array(F.struct(F.col(value).alias("less"), F.lit(True).alias("event")))
    each = asked.select(*rows.columns, F.explode(F.concat(own, smaller)).alias("__e"))
    rest = [c for c in rows.columns if c not in (*by, order)]  # questions do not carry what rows hold
    each = each.select(*by, order, *[F.when(F.col("__e.event"), F.col(c)).alias(c) for c in rest], F.col("__e.less").alias("__less"), F.col("__e.event").alias("__event"))
    last = F.max(F.when(F.col("__event"), F.col(order))).over(Window.partitionBy(*by, "__less").orderBy(order).rangeBetween(Window.unboundedPreceding, -1))
    told = F.max(F.when(~F.col("__event"), F.col("__last"))).over(Window.partitionBy(*by, order))
    return each.withColumn("__last", last).withColumn("above", told).where("__event").select(*rows.columns, "above")


def _untabbed(text: Column) -> Column:
    """A line whose tabs before its first other character count as four blanks."""
    indent = F.regexp_extract(text, r"^[\t ]*", 0)
    return F.when(F.contains(text, F.lit("\t")), F.concat(F.replace(indent, F.lit("\t"), F.lit("    ")), F.substr(text, F.length(indent) + 1))).otherwise(text)


def _quote_depth(s: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(s, r"^(?:>\s*)+", 0), r"\s", ""))


def _is_caption(text: Column) -> Column:
    return F.coalesce(S._inner(text, "**").rlike(S.CAPTION), F.lit(False))


def _is_source(text: Column) -> Column:
    return F.coalesce(S._inner(text, "*").rlike(S.SOURCE), F.lit(False))


def _kinds(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Lines that are not blank, with their kinds and what their neighbours tell: run and block (the first lines of theirs), heading (the last one before), of (the table of a caption or source)."""
    text = _untabbed(F.col("text"))
    # kinds are judged before the window: in one step with what follows, the code that Spark makes is too long to be compiled
    rows = L.fenced_marks(L.lines(docs, id_col, text_col).withColumn("kind", L.line_kind(text, F.lit(False))))
    rows = rows.withColumns({"text": text, "kind": F.when(F.col("in_fence"), "fence").otherwise(F.col("kind"))}).where("kind <> 'blank'")
    s = F.trim("text")
    depth = F.when(F.col("kind") == "heading", F.length(F.regexp_extract("text", "^#+", 0))).when(F.col("kind") == "quote", _quote_depth(s)).when(F.col("kind").isin("list", "ordered"), F.length(F.regexp_extract("text", "^ *", 0))).otherwise(0)
    starred = (F.col("kind") == "paragraph") & s.startswith("*")
    rows = rows.withColumns({
        "level": depth, "opens": (F.col("kind") == "fence") & s.startswith("```") & (F.col("seen") % 2 == 1),
        "__caption": starred & _is_caption(F.col("text")), "__source": starred & _is_source(F.col("text")),
    })
    # one window looks at the neighbours; blank lines between show as gaps of line_no
    order = Window.partitionBy("doc_id").orderBy("line_no")
    back = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({
        "__next": F.lead("kind").over(order), "__at": F.lead("line_no").over(order), "__before": F.lag("kind").over(order), "__far": F.lag("kind", 2).over(order), "__last": F.lag("line_no").over(order),
        "__level": F.lag("level").over(order), "__sourced": F.lag("__source").over(order), "heading": F.max(F.when(F.col("kind") == "heading", F.col("line_no"))).over(back),
    })
    none = F.lit("")
    caption, source = F.col("__caption") & (F.coalesce("__next", none) == "table"), F.col("__source") & (F.coalesce("__before", none) == "table")
    listed = lambda k: F.when(k == "ordered", "list").otherwise(k)
    # what the line before is: behind a caption comes its table, so only sources matter
    before = F.when(F.col("__sourced") & (F.coalesce("__far", none) == "table"), "source").otherwise(listed(F.col("__before")))
    rows = rows.withColumns({"kind": F.when(caption, "caption").when(source, "source").otherwise(F.col("kind")), "__before": before})
    first = F.coalesce(F.col("__last") != F.col("line_no") - 1, F.lit(True)) | (F.col("__before") != listed(F.col("kind"))) | F.col("kind").isin("heading", "rule", "figure", "caption", "source") | F.col("opens")
    rows = rows.withColumns({"__first": first, "__deeper": (F.col("kind") == "quote") & (F.col("__level") != F.col("level"))})
    begins = F.when(F.col("__first") | F.coalesce("__deeper", F.lit(False)), F.col("line_no"))
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"run": F.max(F.when(F.col("__first"), F.col("line_no"))).over(upto), "block": F.max(begins).over(upto), "__table": F.max(begins).over(back)})
    of = F.when(F.col("kind") == "caption", F.col("__at")).when(F.col("kind") == "source", F.col("__table"))
    return rows.select("doc_id", "line_no", "text", "kind", "level", "run", "block", "heading", of.alias("of"))


def _node(line: Column, part: int = 0) -> Column:
    return (line.cast("long") * 2 + part).alias("node")


def blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, node, parent, kind, level (of a heading; depth of a quote; columns that an item stands in), first_line, last_line, text: the tree of each document.

    Kinds: heading, paragraph, list and ordered (with item and ordered_item), quote, table (with row, caption, source),
    figure, rule, fence. Text: of a heading without its #, of items and quotes without their marks, of fences with their
    lines; lines of one block are joined by line ends; lists and tables have none of their own. A tab before a line counts as four blanks. Null and blank texts have no node.
    """
    rows = _kinds(docs, id_col, text_col)
    s = F.trim("text")
    bare = F.when(F.col("kind") == "heading", F.trim(F.regexp_replace(s, r"^#+", ""))).when(F.col("kind").isin("list", "ordered"), F.regexp_replace(s, r"^(?:[-*+]|\d+[.)])\s+", "")).when(F.col("kind") == "quote", F.regexp_replace(s, r"^(?:>\s*)+", "")).when(F.col("kind") == "fence", F.col("text")).otherwise(s)
    separator = (F.col("kind") == "table") & F.col("text").rlike(r"^\s*\|[\s:\-|]+\|\s*$")
    rows = table_of(rows.withColumns({"bare": bare, "separator": separator}).drop("text"))  # each kind of block reads it
    told = ["doc_id", "node", "parent", "kind", "level", "first_line", "last_line", "text"]
    parent = lambda c: (c.cast("long") * 2).alias("parent")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("kind") != "table", F.struct("line_no", "bare")))), lambda x: x["bare"]), "\n")
    own = lambda *kinds: rows.where(F.col("kind").isin(*kinds))
    whole = lambda r: r.groupBy("doc_id", F.col("block").alias("first_line")).agg(F.min("run").alias("run"), F.min("kind").alias("kind"), F.min("level").alias("level"), F.min("heading").alias("heading"), F.max("line_no").alias("last_line"), joined.alias("text"))

    # blocks of one line, and the parts of tables
    part = F.col("kind").isin("table", "caption", "source")
    single = own("figure", "rule", "caption", "source", "table").where("NOT separator").select(
        "doc_id", (F.col("line_no").cast("long") * 2 + part.cast("int")).alias("node"), parent(F.when(F.col("kind") == "table", F.col("block")).when(part, F.col("of")).otherwise(F.col("heading"))),
        F.when(F.col("kind") == "table", "row").otherwise(F.col("kind")).alias("kind"), "level", F.col("line_no").alias("first_line"), F.col("line_no").alias("last_line"), F.col("bare").alias("text"),
    )
    plain = whole(own("paragraph", "fence", "table")).select("doc_id", _node(F.col("first_line")), parent(F.col("heading")), "kind", "level", "first_line", "last_line", F.when(F.col("kind") != "table", F.col("text")).alias("text"))
    # headings are one run of their document
    ranked = whole(own("quote", "heading")).withColumn("run", F.when(F.col("kind") == "heading", 0).otherwise(F.col("run")))
    ranked = under(ranked, ["doc_id", "run"], "first_line", "level").withColumn("above", F.when(F.col("kind") == "heading", F.col("above")).otherwise(F.coalesce("above", "heading")))
    ranked = ranked.select("doc_id", _node(F.col("first_line")), parent(F.col("above")), "kind", "level", "first_line", "last_line", "text")

    items = under(own("list", "ordered").select("doc_id", "run", "line_no", "kind", "level", "heading", "bare"), ["doc_id", "run"], "line_no", "level")
    run = Window.partitionBy("doc_id", "run").orderBy("line_no")
    top = F.when(F.col("above").isNull(), F.col("kind"))
    earlier = F.last(top, ignorenulls=True).over(run.rowsBetween(Window.unboundedPreceding, -1))
    items = items.withColumn("of", F.max(F.when(top.isNotNull() & F.coalesce(earlier != F.col("kind"), F.lit(True)), F.col("line_no"))).over(run.rowsBetween(Window.unboundedPreceding, 0)))
    lists = items.groupBy("doc_id", "of").agg(F.min_by("kind", "line_no").alias("kind"), F.min_by("level", "line_no").alias("level"), F.min("heading").alias("heading"), F.max("line_no").alias("last_line"))
    lists = lists.select("doc_id", _node(F.col("of")), parent(F.col("heading")), "kind", "level", F.col("of").alias("first_line"), "last_line", F.lit(None).cast("string").alias("text"))
    in_list = items.select("doc_id", _node(F.col("line_no"), 1), F.when(F.col("above").isNull(), F.col("of").cast("long") * 2).otherwise(F.col("above").cast("long") * 2 + 1).alias("parent"), F.when(F.col("kind") == "list", "item").otherwise("ordered_item").alias("kind"), "level", F.col("line_no").alias("first_line"), F.col("line_no").alias("last_line"), F.col("bare").alias("text"))
    out = plain.select(*told)
    for more in (single, ranked, lists, in_list):
        out = out.unionByName(more.select(*told))
    return out


def _number(text: Column) -> Column:
    """A chapter's number as written, in digits or as a numeral."""
    out = F.lit(None).cast("int")
    for p in reversed(CHAPTERS):
        out = F.when(text.rlike(p), T.from_chinese_numeral(F.regexp_extract(text, p, 1))).otherwise(out)
    return out


def _pieces(lines: Column) -> Column:
    """line_no, kind, text, at, alone, letter, own: of a text's lines (fenced_texts()) what checks ask for.

    These are chapters' and appendices' heads, figures, captions, and prose with a word that a check may tell: paragraphs
    and quotes as blocks, all else by lines. text is trimmed, a head's is without its #. at: the line of the figure, or of
    the caption's table. alone: a line with no figure next to it. letter: of an appendix (empty if it has none), own: a chapter's own number.
    """
    tabbed = F.exists(lines, lambda x: F.contains(x["text"], F.lit("\t")))
    plain = F.when(tabbed, F.transform(lines, lambda x: F.struct(x["line_no"].alias("line_no"), _untabbed(x["text"]).alias("text"), x["in_fence"].alias("in_fence")))).otherwise(lines)
    kind = lambda x: F.struct(x["line_no"].alias("line_no"), F.when(x["in_fence"], "fence").otherwise(L.line_kind(x["text"], F.lit(False))).alias("kind"), F.trim(x["text"]).alias("s"))

    starred = lambda x: (x["kind"] == "paragraph") & x["s"].startswith("*")

    def finally_(solid: Column) -> Column:
        of = lambda i: F.coalesce(F.get(solid, i)["kind"], F.lit(""))
        as_ = lambda x, kind: F.struct(x["line_no"].alias("line_no"), F.lit(kind).alias("kind"), x["s"].alias("s"))
        told = lambda x, i: F.when(starred(x) & (of(i + 1) == "table") & _is_caption(x["s"]), as_(x, "caption")).when(starred(x) & (of(i - 1) == "table") & _is_source(x["s"]), as_(x, "source")).otherwise(x)
        return F.when(F.exists(solid, starred), F.transform(solid, told)).otherwise(solid)

    def gathered(rows: Column) -> Column:
        goes_on = lambda x, p: _one_of(x["kind"], "paragraph", "quote") & (p["kind"] == x["kind"]) & (p["line_no"] == x["line_no"] - 1) & ((x["kind"] == "paragraph") | (_quote_depth(p["s"]) == _quote_depth(x["s"])))
        starts = L.places(rows, lambda x, i: ~F.coalesce(goes_on(x, F.get(rows, i - 1)), F.lit(False)))
        asks = lambda x: ((x["kind"] == "heading") & x["s"].rlike(r"^##[^#]")) | _one_of(x["kind"], "figure", "caption") | (_one_of(x["kind"], *PROSE) & x["s"].rlike(ASKED))
        near = lambda i: F.coalesce(F.get(rows, i)["kind"] == "figure", F.lit(False))

        def piece(x: Column, n: Column, a: Column) -> Column:
            text = F.when(n > 1, F.array_join(F.transform(F.slice(rows, a + 1, n), lambda y: y["s"]), "\n")).when(x["kind"] == "heading", F.trim(F.regexp_replace(x["s"], "^#+", ""))).otherwise(x["s"])
            at = F.when(x["kind"] == "caption", F.get(rows, a + 1)["line_no"]).otherwise(x["line_no"])  # a caption's table begins with the next line
            alone = (x["kind"] == "paragraph") & (n == 1) & x["s"].rlike(S.FIGURE_LINE) & ~near(a - 1) & ~near(a + 1)
            return F.struct(x["line_no"].alias("line_no"), x["kind"].alias("kind"), text.alias("text"), at.alias("at"), alone.alias("alone"))

        def asked(a: Column, n: Column) -> Column:
            met = F.when(n == 1, asks(F.get(rows, a))).otherwise(F.exists(F.slice(rows, a + 1, n), asks))
            return F.when(met, piece(F.get(rows, a), n, a))

        return F.array_compact(T.let(starts, lambda starts: F.transform(starts, lambda a, j: asked(a, F.coalesce(F.get(starts, j + 1), F.size(rows)) - a))))

    def numbered(p: Column) -> Column:
        head = p["kind"] == "heading"
        app = head & p["text"].rlike(APPENDIX)
        fields = [p[c].alias(c) for c in ("line_no", "kind", "text", "at", "alone")]
        return F.struct(*fields, F.when(app, F.translate(F.regexp_extract(p["text"], APPENDIX, 1), ascii_lowercase, ascii_uppercase)).alias("letter"), F.when(head & ~app, _number(p["text"])).alias("own"))

    solid = F.filter(F.transform(plain, kind), lambda x: x["kind"] != "blank")
    return F.transform(T.let(T.let(solid, finally_), gathered), numbered)


def _one_of(kind: Column, *kinds: str) -> Column:
    """Whether a kind is one of some. Within an array, Spark leaves the loop of isin() by an exception, which takes longer than all else."""
    return reduce(or_, [kind == k for k in kinds])


def _cut(rows: Column, starts: Callable[[Column, Column], Column], f: Callable[[Column], Column]) -> Column:
    """f of each run of rows, in one array. A run begins at the first row and where starts(row, the row before) holds."""
    places = L.places(rows, lambda x, i: (i == 0) | starts(x, F.get(rows, i - 1)))
    run = lambda p: lambda a, j: f(F.slice(rows, a + 1, F.coalesce(F.get(p, j + 1), F.size(rows)) - a))
    return F.flatten(T.let(places, lambda p: F.transform(p, run(p))))


def _fault(code: Column | str, line: Column, element: Column, detail: Column | str) -> Column:
    lit = lambda c: F.lit(c) if isinstance(c, str) else c
    return F.struct(lit(code).alias("code"), line.cast("int").alias("line_no"), element.alias("element"), lit(detail).alias("detail"))


def _expected(number: Column, place: Column, code: Column | str, line: Column, element: Column) -> Column:
    """The fault of a number that is not the one of its place (from 0); else null."""
    return F.when(number != place + 1, _fault(code, line, element, F.concat(F.lit("expected "), place + 1)))


def _in_order(rows: Column, code: str) -> Column:
    """Faults of numbers (number, line_no, text; by line) that are not 1, 2, ... in their order, and of those that come again."""
    gaps = F.transform(rows, lambda r, i: _expected(r["number"], i, code, r["line_no"], r["text"]))
    again = lambda by: F.transform(by, lambda r, i: F.when((i > 0) & (F.get(by, i - 1)["number"] == r["number"]), _fault(code, r["line_no"], r["text"], "again")))
    return F.array_compact(F.concat(gaps, T.let(F.sort_array(rows), again)))


def _entity_faults(entities: Column) -> Column:
    """Faults of figures and captions (mark, x, y, line_no, chapter): numbers that leave a gap or come again within x, and those that stand in another chapter."""
    figure = lambda e, a: F.when(e["mark"] == "图", a).otherwise("W-TBL-02")

    def of_run(run: Column) -> Column:
        def told(e: Column, i: Column) -> Column:
            before = F.get(run, i - 1)
            return F.array_compact(F.array(
                _expected(e["y"], i, figure(e, "W-IMG-06"), e["line_no"], _element(e)),
                F.when((i > 0) & (before["y"] == e["y"]), _fault(figure(e, "W-IMG-05"), e["line_no"], _element(e), "again")),
                F.when(e["chapter"] != e["x"], _fault(figure(e, "W-IMG-04"), e["line_no"], _element(e), F.concat(F.lit("in chapter "), e["chapter"]))),
            ))

        return F.flatten(F.transform(run, told))

    return T.let(F.sort_array(entities), lambda rows: _cut(rows, lambda e, p: (e["mark"] != p["mark"]) | (e["x"] != p["x"]), of_run))


def _element(e: Column) -> Column:
    return F.concat(e["mark"], e["x"], F.lit("-"), e["y"])


def _mention_faults(entities: Column, mentions: Column) -> Column:
    """Faults of what is never mentioned, mentioned late, or mentioned without being there. mentions: element, line_no."""
    there = F.transform(entities, lambda e: F.struct(_element(e).alias("element"), F.lit(1).alias("said"), e["line_no"].alias("line_no")))
    said = F.transform(mentions, lambda m: F.struct(m["element"].alias("element"), F.lit(2).alias("said"), m["line_no"].alias("line_no")))

    def of_run(run: Column) -> Column:
        one, place = F.get(run, F.lit(0)), F.size(F.filter(run, lambda r: r["said"] == 1))

        def held(late: Column) -> Column:
            never = F.when(late.isNull(), _fault("W-REF-01", one["line_no"], one["element"], "never mentioned"))
            return F.array_compact(F.array(F.coalesce(never, F.when(late > one["line_no"], _fault("W-REF-02", one["line_no"], one["element"], F.concat(F.lit("first mentioned in line "), late))))))

        return F.when(one["said"] == 2, F.transform(run, lambda r: _fault("W-REF-03", r["line_no"], r["element"], "not there"))).otherwise(T.let(F.get(run, place)["line_no"], held))

    return T.let(F.sort_array(F.concat(there, said)), lambda rows: _cut(rows, lambda r, p: r["element"] != p["element"], of_run))


def _faults(pieces: Column) -> Column:
    """All faults of a text but those of its metadata, from its pieces; of each figure's file as if it were not there."""
    number = lambda c, p, i: F.regexp_extract(c, p, i).try_cast("int")
    first_app = F.get(F.filter(pieces, lambda p: p["letter"].isNotNull()), F.lit(0))["line_no"]

    def entities(run: Column) -> Column:
        # a run begins with the head that numbers its chapter
        def entity(p: Column, chapter: Column) -> Column:
            text = F.when(p["kind"] == "figure", F.regexp_extract(p["text"], FIGURE, 1)).otherwise(S._inner(p["text"], "**"))
            pattern = F.when(p["kind"] == "figure", F.struct(number(text, FIGURE_NUMBER, 1).alias("x"), number(text, FIGURE_NUMBER, 2).alias("y"))).otherwise(F.struct(number(text, S.CAPTION, 1).alias("x"), number(text, S.CAPTION, 2).alias("y")))
            return T.let(pattern, lambda n: F.when(n["x"].isNotNull(), F.struct(F.when(p["kind"] == "figure", "图").otherwise("表").alias("mark"), n["x"].alias("x"), n["y"].alias("y"), p["at"].alias("line_no"), chapter.alias("chapter"))))

        return T.let(F.get(run, F.lit(0))["own"], lambda chapter: F.array_compact(F.transform(run, lambda p: F.when(_one_of(p["kind"], "figure", "caption"), entity(p, chapter)))))

    def in_prose(upto: Column) -> Column:
        before = lambda p: upto.isNull() | (p["line_no"] < upto)
        prose = F.filter(pieces, lambda p: _one_of(p["kind"], *PROSE))
        words = lambda rows, has, pattern, f: F.flatten(F.transform(F.filter(rows, lambda p: p["text"].rlike(has)), lambda p: F.transform(F.regexp_extract_all(p["text"], F.lit(pattern), 0), lambda w: f(p, w))))
        element = lambda m: F.concat(F.substring(m, 1, 1), number(m, r"(\d+)-(\d+)", 1), F.lit("-"), number(m, r"(\d+)-(\d+)", 2))
        orphans = F.transform(F.filter(pieces, lambda p: p["alone"] & before(p)), lambda p: _fault("W-REF-03", p["line_no"], F.substring(p["text"], 1, 60), "no figure next to it"))

        def told(prose: Column) -> Column:
            body = F.filter(prose, before)
            mentions = words(body, "[图表]", MENTION, lambda p, m: F.struct(element(m).alias("element"), p["line_no"].alias("line_no")))
            places = words(body, "[图表]", r"(?<!以)[上下][图表]", lambda p, w: _fault("W-REF-04", p["line_no"], w, "points by place"))
            marks = words(prose, "[密内]", N.SECRECY_WEAK, lambda p, w: _fault("W-CLN-01", p["line_no"], w, "mark of secrecy"))
            both = T.let(_cut(pieces, lambda p, _: p["own"].isNotNull(), entities), lambda e: F.concat(_entity_faults(e), _mention_faults(e, mentions)))
            return F.concat(both, orphans, places, marks)

        return T.let(prose, told)

    figures = F.transform(F.filter(pieces, lambda p: p["kind"] == "figure"), lambda p: _fault(NO_FILE, p["line_no"], F.regexp_extract(p["text"], FIGURE, 2), "no file"))
    ranked = lambda match, n: F.transform(F.filter(pieces, match), lambda p: F.struct(n(p).alias("number"), p["line_no"].alias("line_no"), p["text"].alias("text")))
    chapters = ranked(lambda p: p["own"].isNotNull(), lambda p: p["own"])
    letters = ranked(lambda p: p["letter"] != "", lambda p: F.ascii(p["letter"]) - 64)
    return F.concat(figures, T.let(chapters, lambda r: _in_order(r, "W-HDR-01")), T.let(letters, lambda r: _in_order(r, "W-HDR-02")), T.let(first_app, in_prose))


def checked(docs: DataFrame, files: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, code, line_no, element, detail: what a whole document says of itself.

    E-IMG-01 a figure's file is none of files (doc_id, path; left out without files). W-IMG-06, W-IMG-05 and W-TBL-02
    numbers of figures and of tables with captions that leave a gap, or come again, within their chapter; W-IMG-04 and
    W-TBL-02 a number's chapter is not the one that it stands in. W-HDR-01, W-HDR-02 chapters' numbers and appendices' letters that
    are not in order, or come again. W-REF-01 never mentioned, W-REF-02 first mentioned behind its place, W-REF-03
    mentioned without being there (each mention), or a line like a figure's with no figure next to it, W-REF-04 words that
    point by place; mentions are in prose before the first appendix. W-CLN-01 weak marks of secrecy in prose. W-TTL-01 no
    short title among the metadata. line_no: the block's first line; null for W-TTL-01.
    """
    texts = L.fenced_texts(docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")))
    short = F.exists("lines", lambda x: F.contains(F.translate(x["text"], "*>", ""), F.lit(SHORT_TITLE)))  # else no line can be the short title's
    named = lambda lines: F.exists(L.own_metadata(lines), lambda m: (m["name"] == SHORT_TITLE) & (m["value"] != ""))
    given = F.when(short, T.let(L.with_kinds(F.col("lines")), named)).otherwise(False)
    title = F.array_compact(F.array(F.when(~given, _fault("W-TTL-01", F.lit(None), F.lit(SHORT_TITLE), "not given"))))
    faults = T.let(_pieces(F.col("lines")), _faults)
    found = texts.select("doc_id", F.inline(F.concat(faults, title)))
    if files is None:
        return found.where(F.col("code") != NO_FILE)
    path = F.when(F.col("code") == NO_FILE, F.col("element"))
    return found.withColumn("path", path).join(files.select("doc_id", "path"), ["doc_id", "path"], "left_anti").drop("path")
