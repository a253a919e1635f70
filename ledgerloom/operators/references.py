"""Citations, numbering, reconciliation, ledgers and graphs, as joins and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import text as T
from ledgerloom.operators import ranks

#: Reference marks of sources and of claims, and the marks of document types in bibliographies.
SRC_MARK, CL_MARK = r"\[SRC-[^\]\n]*\]", r"\[CL-[^\]\n]*\]"
TYPE_MARKS = {"journal": "J", "official": "EB/OL", "report": "R", "news": "N", "paper": "C", "book": "M", "M": "M", "J": "J", "R": "R", "C": "C", "N": "N", "EB/OL": "EB/OL"}
#: Bytes up to which forms and their keys are sent to every task.
SMALL = 8 << 20


def last_by_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows with one key the last by order; blank keys go."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.where(F.trim(F.coalesce(key, F.lit(""))) != "").withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def mentions(docs: DataFrame, id_col: str = "doc_id", mark: str = SRC_MARK, inner: str = r"(SRC-[0-9]+)") -> DataFrame:
    """doc_id, at, inside, source_id: each id within each mark, in the order of the text."""
    marks = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.regexp_extract_all("text", F.lit(mark), 0)).alias("at", "mark"))
    return marks.select("doc_id", "at", F.posexplode(F.regexp_extract_all("mark", F.lit(inner), 1)).alias("inside", "source_id"))


def numbers_by_first_use(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """key, number: numbers from 1 in the order of each key's first appearance, ranked by ranges."""
    first = rows.groupBy(key).agg(F.min(F.struct(*order)).alias("first"))
    return ranks.numbered(first.select(key, *[F.col("first").getField(c).alias(f"__o{i}") for i, c in enumerate(order)]), [*[f"__o{i}" for i in range(len(order))], key]).select(key, "number")


def with_numbers(docs: DataFrame, numbers: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """doc_id, text, removed: [SRC-1, SRC-2] becomes [1, 2] and claim marks go; double spaces are squeezed only where one went. Unknown ids drop out of a mark; a mark of unknown ids stays."""
    text = F.col("text")
    removed = T.class_count(text, CL_MARK)
    base = docs.select(F.col(id_col).alias("doc_id"), removed.alias("removed"), F.when(removed > 0, F.regexp_replace(F.regexp_replace(text, CL_MARK, ""), "  +", " ")).otherwise(text).alias("text"))
    parts = base.select("doc_id", "removed", F.split("text", SRC_MARK).alias("plain"), F.regexp_extract_all("text", F.lit(SRC_MARK), F.lit(0)).alias("marks"))
    each = parts.select("doc_id", F.posexplode("marks").alias("at", "mark")).select("doc_id", "at", "mark", F.posexplode_outer(F.regexp_extract_all("mark", F.lit(r"(SRC-[0-9]+)"), 1)).alias("inside", "source_id"))
    known = each.join(numbers, each["source_id"] == numbers["source_id"], "left").drop(numbers["source_id"])
    inner = F.transform(F.sort_array(F.collect_list(F.when(F.col("number").isNotNull(), F.struct("inside", "number")))), lambda x: x["number"].cast("string"))
    new = known.groupBy("doc_id", "at").agg(F.first("mark").alias("mark"), inner.alias("n")).withColumn("new", F.when(F.size("n") > 0, F.concat(F.lit("["), F.array_join("n", ", "), F.lit("]"))).otherwise(F.col("mark")))
    marks = new.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "new"))), lambda x: x["new"]).alias("new"))
    joined = parts.join(marks, "doc_id", "left")
    pieces = F.transform(F.col("plain"), lambda p, i: F.concat(p, F.coalesce(F.get("new", i), F.lit(""))))
    return joined.select("doc_id", F.array_join(pieces, "").alias("text"), "removed")


def bibliography(numbers: DataFrame, sources: DataFrame) -> DataFrame:
    """number, source_id, entry, missing: one entry a number; a source that the index lacks, or without title, gets a placeholder."""
    have = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    j = numbers.join(sources, "source_id", "left")
    kinds = F.create_map(*[F.lit(x) for pair in TYPE_MARKS.items() for x in pair])
    kind = F.coalesce(F.try_element_at(kinds, F.trim(F.coalesce("source_type", F.lit("M")))), F.lit("M"))
    url = F.when(have(F.col("url_or_path")) & (F.trim("source_type") == "EB/OL"), F.concat(F.lit(" "), F.trim("url_or_path"), F.lit(".")))
    entry = F.concat_ws(
        " ", F.concat(F.lit("["), F.col("number"), F.lit("]")), F.when(have(F.col("author_or_org")), F.concat(F.trim("author_or_org"), F.lit("."))), F.concat(F.trim("title"), F.lit("["), kind, F.lit("].")),
        F.when(have(F.col("publisher")), F.concat(F.trim("publisher"), F.lit(","))), F.when(have(F.col("publish_date")), F.concat(F.trim("publish_date"), F.lit("."))), url,
    )
    missing = ~have(F.col("title"))
    return j.select("number", "source_id", F.when(missing, F.concat(F.lit("["), F.col("number"), F.lit("] [source "), F.col("source_id"), F.lit(": no metadata]"))).otherwise(entry).alias("entry"), missing.alias("missing"))


def matched(rows: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """rows with the columns of index (one row a key), and missing: whether the index lacks the key."""
    held = index.withColumn("__held", F.lit(True))
    return rows.join(held, key, "left").withColumn("missing", F.col("__held").isNull()).drop("__held")


def known(rows: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """Rows whose key the index has, each once."""
    return rows.join(index.select(key), key, "left_semi")


def difference(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """Keys of one side only: the keys, side (left or right)."""
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    only = lambda x, y, side: x.join(y, list(keys), "left_anti").withColumn("side", F.lit(side))
    return only(a, b, "left").unionByName(only(b, a, "right"))


def nearest_before(rows: DataFrame, by: str, order: list[str], value: Column, name: str) -> DataFrame:
    """As-of: adds the last value that is not null up to each row."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(w))


def hierarchical_numbers(rows: DataFrame, by: str, order: list[str], level: str = "level") -> DataFrame:
    """Adds n1, n2, n3 (counters of levels 1 to 3, each reset by the level above) and number (1, 1.2, 1.2.3; level 0 is an appendix: A, B, ...)."""
    run = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    lv = F.col(level)
    upto = lambda n: F.sum((lv == n).cast("int")).over(run)
    rows = rows.withColumns({"n1": upto(1), "__n2": upto(2), "__n3": upto(3), "__n0": upto(0)})
    # a counter is reset by what it had reached where a level above stood last: all in the order of one sort
    since = lambda n, c: F.col(c) - F.coalesce(F.last(F.when(lv < n, F.col(c)), ignorenulls=True).over(run), F.lit(0))
    rows = rows.withColumns({"n2": since(2, "__n2"), "n3": since(3, "__n3")})
    letter = F.char(F.lit(64) + F.col("__n0"))
    number = F.when(lv == 0, letter).when(lv == 1, F.col("n1").cast("string")).when(lv == 2, F.concat_ws(".", "n1", "n2")).otherwise(F.concat_ws(".", "n1", "n2", "n3"))
    return rows.withColumn("number", number).drop("__n0", "__n2", "__n3")


def sequence_gaps(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Rows whose number is not its rank: by, value, expected."""
    ranked = rows.select(by, value, F.row_number().over(Window.partitionBy(by).orderBy(value)).alias("expected"))
    return ranked.where(F.col(value) != F.col("expected"))


def distinct_gaps(rows: DataFrame, by: str, value: str) -> DataFrame:
    """sequence_gaps() of the distinct rows, in one shuffle by the group: rows may repeat."""
    ranked = rows.select(by, value, F.dense_rank().over(Window.partitionBy(by).orderBy(value)).alias("expected"))
    return ranked.where(F.col(value) != F.col("expected")).distinct()


def duplicates(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > 1)


def _small(rows: DataFrame) -> DataFrame:
    """Rows of strings, marked for broadcast if they are few (counted first; Spark does not know the size of rows that come from Python)."""
    size = rows.agg(F.sum(sum(F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) + 50 for c in rows.columns))).first()[0]
    return F.broadcast(rows) if (size or 0) <= SMALL else rows


def banned_forms(docs: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, term_id, form: banned forms in body text. CJK forms as substrings, others between non-letters.

    A text fetches the forms that it may hold by a key: a CJK form's first CJK character with the one behind it, another
    form's longest run of Latin letters (which stands whole in the text, as no letter may be beside the form). Forms with
    neither are looked for in every text. Texts do not travel with their keys: the forms found by key meet them by id.
    """
    forms = terms.select("term_id", F.explode("banned_forms").alias("form")).where(F.col("form") != "")
    runs = F.regexp_extract_all("form", F.lit("[a-zA-Z]+"), 0)
    longest = F.aggregate(runs, F.lit(""), lambda a, x: F.when(F.length(x) > F.length(a), x).otherwise(a))
    forms = forms.withColumn("key", F.when(F.col("form").rlike(T.CJK), F.regexp_extract("form", f"(?s){T.CJK}.?", 0)).otherwise(longest))
    bodies = docs.select(F.col(id_col).alias("doc_id"), T.body_clean(F.col(text_col)).alias("body"))
    pairs = F.regexp_extract_all("body", F.lit(f"(?s)(?=({T.CJK}.?))"), 1)
    keys = F.concat(F.regexp_extract_all("body", F.lit("[a-zA-Z]+"), 0), pairs, F.transform(pairs, lambda x: F.substring(x, 1, 1)), F.array(F.lit("")))
    held = bodies.select("doc_id", F.explode(F.array_distinct(keys)).alias("key")).join(_small(forms.select("key").distinct()), "key", "left_semi").distinct()
    asked = held.join(_small(forms), "key").select(F.col("doc_id").alias("of"), "term_id", "form")
    safe = F.regexp_replace("form", r"([\\^$.|?*+()\[\]{}])", r"\\$1")
    found = F.when(F.col("form").rlike(T.CJK), F.contains("body", F.col("form"))).otherwise(F.regexp("body", F.concat(F.lit("(?<![a-zA-Z])"), safe, F.lit("(?![a-zA-Z])"))))
    return bodies.join(asked, bodies["doc_id"].eqNullSafe(asked["of"]) & found).select("doc_id", "term_id", "form")


def scope_covers(scope: Column, chapter: Column) -> Column:
    """Whether a free text scope (chapters 3, 5-7) covers a chapter; an unknown chapter or scope is covered."""
    pattern = F.lit(r"第\s*(\d+)\s*(?:[-–—至]\s*(\d+)\s*)?章")
    low, high = F.regexp_extract_all(scope, pattern, 1), F.regexp_extract_all(scope, pattern, 2)
    pairs = F.arrays_zip(low.alias("low"), high.alias("high"))
    inside = F.exists(pairs, lambda p: chapter.between(p["low"].cast("int"), F.coalesce(F.nullif(p["high"], F.lit("")), p["low"]).cast("int")))
    return chapter.isNull() | F.contains(scope, F.lit("全报告")) | (F.size(low) == 0) | inside


def acronyms(rows: DataFrame, whitelist: list[str]) -> DataFrame:
    """First use of each acronym (2 to 6 capitals, not before a slash) in a document: doc_id, acronym, line_no, explained (a bracket and two CJK characters within 30 characters). rows: doc_id, line_no, text of body lines."""
    found = rows.select("doc_id", "line_no", "text", F.posexplode(F.regexp_extract_all("text", F.lit(r"(?<![A-Za-z0-9])([A-Z]{2,6})(?![A-Za-z0-9/])"), 1)).alias("at", "acronym"))
    first = found.groupBy("doc_id", "acronym").agg(F.min(F.struct("line_no", "at", "text")).alias("f"))
    where = F.expr("regexp_instr(f.text, concat('(?<![A-Za-z0-9])', acronym, '(?![A-Za-z0-9/])'))")
    window = F.substr(F.col("f.text"), F.greatest(where - 30, F.lit(1)), F.length("acronym") + 60)
    explained = window.rlike(r"[（(]") & (T.class_count(window, T.CJK) >= 2)
    return first.where(~F.col("acronym").isin(whitelist)).select("doc_id", "acronym", F.col("f.line_no").alias("line_no"), explained.alias("explained"))


def event_id(*columns: str) -> Column:
    """Key of a ledger entry: SHA-1 of its fields, joined by |."""
    return F.sha1(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]))


def new_entries(entries: DataFrame, existing: DataFrame) -> DataFrame:
    """Entries that the ledger lacks, each once (columns event_id and any others)."""
    return entries.dropDuplicates(["event_id"]).join(existing.select("event_id").distinct(), "event_id", "left_anti")


def ledger_state(events: DataFrame, acks: DataFrame) -> DataFrame:
    """Latest entry of each event with acknowledged: set by the entry itself or by an acknowledgement. events: event_id, ts, level, acknowledged."""
    w = Window.partitionBy("event_id").orderBy(F.desc("ts"))
    latest = events.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    done = acks.select("event_id").distinct().withColumn("__ack", F.lit(True))
    return latest.join(done, "event_id", "left").withColumn("acknowledged", F.coalesce("acknowledged", F.lit(False)) | F.coalesce("__ack", F.lit(False))).drop("__ack")


def ledger_summary(state: DataFrame, significant: str = "significant") -> DataFrame:
    """One row: total, significant, open_significant, blocking."""
    is_open = (F.col("level") == significant) & ~F.col("acknowledged")
    return state.agg(F.count("*").alias("total"), F.count_if(F.col("level") == significant).alias("significant"), F.count_if(is_open).alias("open_significant"), (F.count_if(is_open) > 0).alias("blocking"))


def degrees(edges: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """node, out_degree, in_degree, degree."""
    ends = edges.select(F.col(source).alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionAll(edges.select(F.col(target).alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"), F.count("*").alias("degree"))


def components(edges: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """node, component (its least node): the least label travels along the edges, and then along labels, until none changes. Lineage is cut by checkpoint(), so set spark.checkpoint.dir."""
    both = edges.select(F.col(source).alias("a"), F.col(target).alias("b"))
    both = both.unionAll(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    state = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label")).checkpoint()
    while True:
        offered = both.join(state.select(F.col("a").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("offer"))
        near = state.join(offered, "a").select("a", F.least("label", "offer").alias("label"), F.col("label").alias("was"))
        jump = state.select(F.col("a").alias("label"), F.col("label").alias("next"))
        step = near.join(jump, "label", "left").select("a", F.least("label", "next").alias("label"), "was").checkpoint()
        state = step.select("a", "label")
        if step.where("label <> was").isEmpty():
            return state.select(F.col("a").alias("node"), F.col("label").alias("component"))


def ancestors(cells: DataFrame) -> DataFrame:
    """doc_id, id, ancestor, depth: all ancestors by parent, with their least depth. A cycle of parents ends where it brings no new ancestor."""
    ranks.shared_folder(cells.sparkSession)
    step = cells.select("doc_id", "id", F.col("parent").alias("ancestor")).where("ancestor is not null")
    parents = cells.select("doc_id", F.col("id").alias("ancestor"), F.col("parent").alias("next")).where("next is not null")
    found = step.distinct().withColumn("depth", F.lit(1)).checkpoint()
    last, depth = found, 1
    while True:
        depth += 1
        further = last.join(parents, ["doc_id", "ancestor"]).select("doc_id", "id", F.col("next").alias("ancestor")).distinct()
        last = further.join(found, ["doc_id", "id", "ancestor"], "left_anti").withColumn("depth", F.lit(depth)).checkpoint()
        if last.isEmpty():
            return found
        found = found.unionByName(last).checkpoint()


def severity_rollup(findings: DataFrame, by: str, ranks: dict[str, int]) -> DataFrame:
    """by, n, worst (the severity of the highest rank), exit_code (2 fatal, 1 error, 0 else)."""
    rank = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv]), F.col("level")), F.lit(0))
    g = findings.groupBy(by).agg(F.count("*").alias("n"), F.max(F.struct(rank.alias("rank"), "level")).alias("worst"))
    return g.select(by, "n", F.col("worst.level").alias("worst"), F.when(F.col("worst.level") == "FATAL", 2).when(F.col("worst.level") == "ERROR", 1).otherwise(0).alias("exit_code"))


#: Words of strong claims by category, what to write instead, and the marks of a source beside them.
STRONG = {
    "first": "首次|第一个|第一颗|第一次|率先|最先|最早|原创|首创",
    "most": "最大|最小|最高|最低|最快|最慢|最强|最弱|最优|最先进|领先",
    "ability": "完全自主|全自动|秒级|毫秒级|决定性|根本性|彻底",
    "quantity": "100%|百分之百|零失误|无一例外|全部|所有目标|任何目标",
}
WEAKER = {"首次": "据公开报道较早之一", "第一个": "较早的", "最大": "规模靠前的", "完全自主": "高度自动化", "全自动": "高度自动化", "秒级": "数秒级（据称）", "决定性": "关键的", "100%": "接近 100%"}
CITED = r"\[S\d+\]|\[C[AMOP]?\d+\]|\[SRC-\d+"


def strong_claims(rows: DataFrame, words: dict[str, str] = STRONG) -> DataFrame:
    """One row a match: doc_id, line_no, category, word, cited, is_heading, high_risk, suggestion. Quotes and fence marks are skipped; what fences hold is not. rows: doc_id, line_no, text."""
    s = F.trim("text")
    body = rows.where(~s.startswith("```") & ~s.startswith(">"))
    found = F.array(*[F.struct(F.lit(c).alias("category"), F.regexp_extract_all("text", F.lit(f"({p})"), 1).alias("words")) for c, p in words.items()])
    each = body.select("doc_id", "line_no", "text", F.inline(found)).select("doc_id", "line_no", "text", "category", F.explode("words").alias("word"))
    cited, heading = F.col("text").rlike(CITED), F.trim("text").startswith("#")
    weaker = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in WEAKER.items() for x in kv]), F.col("word")), F.lit("据称"))
    return each.select("doc_id", "line_no", "category", "word", cited.alias("cited"), heading.alias("is_heading"), (~cited & ~heading).alias("high_risk"), weaker.alias("suggestion"))
