"""Checks of audit reports: envelopes, expected dimensions, scores against them, verdicts and merged issues.

Scores are rows (chapter, dim_id, verdict, evidence), expectations (chapter, dim_id, mode, note) and hints (dim_id, severity,
block_hint, warn_hint). All checks are joins on those keys over any number of chapters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import text as T
from ledgerloom.operators import ranks
from ledgerloom.operators import references as R

#: The mark of an envelope (kind, nonce, agent), and the share of noise that passes.
MARK = r"(?mdU)^\[AGENT-OUTPUT-(START|END)(?::([0-9a-f]{6,16}))?\][ \t]*(\S+)?[ \t]*$"
PAYLOAD = r"(?mdsU)^\[AGENT-OUTPUT-START(?::[0-9a-f]{6,16})?\][ \t]*\S*[ \t]*$(.*)^\[AGENT-OUTPUT-END"
MOST_NOISE = 0.30
#: Severities from mild to grave.
SEVERITIES = ["low", "medium", "high", "critical"]


def envelopes(docs: DataFrame, agent: Column, nonce: Column | None = None) -> DataFrame:
    """doc_id, start_count, end_count, pairing_ok, agent_matched, nonce_matched, envelope_ok, payload, degrade_reason, noise_ratio, passed: one row a text, no shuffle.

    Right: one START, then one END, with the expected agent in both. Another nonce only gives a reason; without an expected
    one nonce_matched is null. Noise is measured on the payload, or on the whole text where there is none. Null is empty text.
    """
    text = F.coalesce("text", F.lit(""))
    part = lambda k: F.regexp_extract_all(text, F.lit(MARK), F.lit(k))
    rows = docs.select("doc_id", text.alias("__text"), part(1).alias("__kind"), part(2).alias("__nonce"), part(3).alias("__agent"), agent.alias("__want"), (F.lit(None).cast("string") if nonce is None else nonce).alias("__key"))
    count = lambda k: F.size(F.filter("__kind", lambda x: x == k))
    both = lambda c: F.get(c, F.lit(0)) == F.get(c, F.lit(1))
    pair = F.col("__kind") == F.array(F.lit("START"), F.lit("END"))
    rows = rows.withColumns({"start_count": count("START"), "end_count": count("END"), "pairing_ok": pair})
    named = pair & both("__agent") & (F.get("__agent", F.lit(0)) == F.col("__want"))
    keyed = F.when(pair & F.col("__key").isNotNull(), both("__nonce") & (F.get("__nonce", F.lit(0)) == F.lower("__key")))
    rows = rows.withColumns({"agent_matched": F.coalesce(named, F.lit(False)), "nonce_matched": keyed, "payload": F.when(pair, F.btrim(F.regexp_extract("__text", PAYLOAD, 1), F.lit("\n")))})
    reason = F.when(~F.col("nonce_matched"), F.when(F.get("__nonce", F.lit(0)) == "", "nonce_missing").otherwise("nonce_mismatch"))
    noise = F.round(T.noise_ratio(F.coalesce("payload", "__text")), 4)
    rows = rows.withColumns({"envelope_ok": F.col("pairing_ok") & F.col("agent_matched"), "degrade_reason": reason, "noise_ratio": noise})
    return rows.withColumn("passed", F.col("envelope_ok") & (F.col("noise_ratio") <= MOST_NOISE)).drop("__text", "__kind", "__nonce", "__agent", "__want", "__key")


#: Where the heading of a dimension begins, a part that begins with one, and its name.
DIM_HEADING, DIM_PART, DIM_NAME = r"(?md)^(?=###\s+\S+[ \t]*$)", r"^###\s+\S+[ \t]*(\n|$)", r"^###\s+(\S+)"


def expectations(docs: DataFrame, id_col: str = "chapter") -> DataFrame:
    """id, dim_id, mode (confirm or adjust), note, fault: one row a `### dimension` heading, judged by the first line below it that is not blank.

    fault: empty (no line), no_note (adjust without text), unknown (another line), duplicate (the dimension occurs before), else null.
    """
    parts = docs.select(F.col(id_col), F.posexplode(F.split("text", DIM_HEADING)).alias("at", "part")).where(F.col("part").rlike(DIM_PART))
    line = F.trim(F.regexp_extract("part", r"^###\s+\S+[ \t]*\s*([^\n]*)", 1))
    rows = parts.select(id_col, "at", F.regexp_extract("part", DIM_NAME, 1).alias("dim_id"), line.alias("line"))
    adjust = F.col("line").rlike(r"^adjust\s*[:：]")
    note = F.when(adjust, F.trim(F.regexp_replace("line", r"^adjust\s*[:：]\s*", "")))
    again = F.row_number().over(Window.partitionBy(id_col, "dim_id").orderBy("at")) > 1
    fault = F.when(F.col("line") == "", "empty").when(again, "duplicate").when(adjust & (note == ""), "no_note").when(~adjust & (F.col("line") != "confirm"), "unknown")
    return rows.select(id_col, "dim_id", F.when(F.col("line") == "confirm", "confirm").when(adjust, "adjust").alias("mode"), note.alias("note"), fault.alias("fault"))


def dimension_gaps(expected: DataFrame, scores: DataFrame, core: DataFrame) -> DataFrame:
    """chapter, dim_id, fault: missing (expected, not scored), extra (scored, not expected), missing_core (a core dimension that a chapter does not expect). core: dim_id."""
    a, b = expected.select("chapter", "dim_id").distinct(), scores.select("chapter", "dim_id").distinct()
    # the core dimensions, one row, ride with every chapter
    due = a.select("chapter").distinct().join(F.broadcast(core.agg(F.collect_set("dim_id").alias("dims"))), F.lit(True)).select("chapter", F.explode("dims").alias("dim_id"))
    gone = lambda left, right, fault: left.join(right, ["chapter", "dim_id"], "left_anti").withColumn("fault", F.lit(fault))
    return gone(a, b, "missing").unionByName(gone(b, a, "extra")).unionByName(gone(due, a, "missing_core"))


def restated(expected: DataFrame, scores: DataFrame, hints: DataFrame, least: float = 0.4) -> DataFrame:
    """chapter, dim_id, verdict, ratio, passed: how much of what should trigger a verdict (block or warn) its evidence says again. Without such a text: ratio null, not passed."""
    rows = scores.where(F.col("verdict").isin("block", "warn")).join(expected.select("chapter", "dim_id", "mode", "note"), ["chapter", "dim_id"], "left").join(hints.select("dim_id", "block_hint", "warn_hint"), "dim_id", "left")
    hint = F.coalesce(F.when(F.col("verdict") == "block", F.col("block_hint")).otherwise(F.col("warn_hint")), F.lit(""))
    reference = F.when(F.col("mode") == "adjust", F.concat_ws("\n", hint, F.coalesce("note", F.lit("")))).when(F.col("mode").isNotNull(), hint).otherwise("")
    ratio = F.when(F.trim(reference, F.lit(" \n")) != "", T.coverage(T.tokens(reference), T.tokens(F.coalesce("evidence", F.lit("")))))
    return rows.select("chapter", "dim_id", "verdict", F.round(ratio, 4).alias("ratio"), F.coalesce(ratio >= least, F.lit(False)).alias("passed"))


def verdict_rule(scores: DataFrame, hints: DataFrame, verdicts: DataFrame) -> DataFrame:
    """chapter, expected, actual, high_blocks, passed: any block of a dimension of high severity asks for REVISE, else PASS. verdicts: chapter, verdict."""
    high = scores.where("verdict = 'block'").join(hints.where("severity = 'high'").select("dim_id").distinct(), "dim_id", "left_semi")
    blocks = high.groupBy("chapter").agg(F.sort_array(F.collect_set("dim_id")).alias("high_blocks"))
    rows = verdicts.select("chapter", F.col("verdict").alias("actual")).join(blocks, "chapter", "left")
    expected = F.when(F.col("high_blocks").isNull(), "PASS").otherwise("REVISE")
    return rows.select("chapter", expected.alias("expected"), "actual", F.coalesce("high_blocks", F.array().cast("array<string>")).alias("high_blocks"), F.coalesce(expected == F.col("actual"), F.lit(False)).alias("passed"))


def overall(checks: DataFrame) -> DataFrame:
    """chapter, passed, failed_at: schema_a before schema_b before content. checks: chapter, stage, passed; a chapter passes if all its checks do."""
    order = F.array(F.lit("schema_a"), F.lit("schema_b"), F.lit("content"))
    failed = F.min(F.when(~F.col("passed"), F.array_position(order, F.col("stage"))))
    return checks.groupBy("chapter").agg(F.every("passed").alias("passed"), failed.alias("at")).select("chapter", "passed", F.when(F.col("at") > 0, F.get(order, (F.col("at") - 1).cast("int"))).alias("failed_at"))


def merged_issues(rows: DataFrame, severities: list[str] = SEVERITIES) -> DataFrame:
    """number, chapter, issue, severity, personas: one row a chapter and issue, with the gravest severity and how many personas raised it; numbered by severity, then chapter and issue, by ranges."""
    rank = F.array_position(F.array(*[F.lit(s) for s in severities]), F.col("severity"))
    one = rows.groupBy("chapter", "issue").agg(F.max(rank).alias("rank"), F.count_distinct("persona").alias("personas"))
    one = ranks.numbered(one, [F.desc("rank"), F.col("chapter"), F.col("issue")])
    return one.select("number", "chapter", "issue", F.when(F.col("rank") > 0, F.get(F.array(*[F.lit(s) for s in severities]), (F.col("rank") - 1).cast("int"))).alias("severity"), "personas")


def marker_faults(docs: DataFrame, constants: DataFrame) -> DataFrame:
    """doc_id, key, value, wanted, fault: linkage-const:key:value marks that differ from the constant (differs) or name none (unknown), and constants that no text marks (missing, doc_id null). constants: key, value."""
    found = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"linkage-const:[A-Za-z0-9_.-]+:[^\s>]+"), 0)).alias("m"))
    marks = found.select("doc_id", F.regexp_extract("m", r"linkage-const:([^:]+):(.*)", 1).alias("key"), F.regexp_extract("m", r"linkage-const:([^:]+):(.*)", 2).alias("value"))
    j = marks.join(constants.select("key", F.col("value").alias("wanted")), "key", "full_outer")
    fault = F.when(F.col("value").isNull(), "missing").when(F.col("wanted").isNull(), "unknown").when(F.col("value") != F.col("wanted"), "differs")
    return j.select("doc_id", "key", "value", "wanted", fault.alias("fault")).where("fault is not null")


#: The comment that opens a batch's file, and the numbers of the batches.
BATCH_MARK = r"phase=(\S+)\s+batch=(\d+)\s+chapter=(ch\d{2,3})\s+dims=(\d+)"
BATCHES = [1, 2, 3]


def _mark(*more: Column) -> Column:
    """phase, batch, chapter, dims of a text, and more columns, as a row to be generated: what is asked of it does not read the text again."""
    line = F.trim(F.regexp_extract("text", r"^\s*([^\n]*)", 1))
    mark = T.let(line, lambda x: F.when(x.startswith("<!--") & x.rlike(BATCH_MARK), x))
    part = lambda m, k: F.regexp_extract(m, BATCH_MARK, k)
    return F.inline(F.array(T.let(mark, lambda m: F.struct(part(m, 1).alias("phase"), part(m, 2).cast("int").alias("batch"), part(m, 3).alias("chapter"), part(m, 4).cast("int").alias("dims"), *more))))


def batch_marks(docs: DataFrame) -> DataFrame:
    """doc_id, phase, batch, chapter, dims: from the comment on a text's first line that is not blank; null without one."""
    return docs.select("doc_id", _mark())


def batch_faults(docs: DataFrame, chapters: DataFrame, grouping: DataFrame) -> DataFrame:
    """chapter, doc_id, fault, detail: why a chapter's batches cannot be merged; a chapter without rows can.

    no_mark, wrong_phase, other_chapter, unknown_batch, repeated_batch; unknown_dim (not in the grouping), wrong_count (as
    many dimensions as declared), missing_dim and extra_dim (the batch's own set), missing_batch (doc_id null). docs: doc_id,
    chapter (that it is handed in for), text; chapters: chapter; grouping: batch, dim_id.

    A text is judged in its own row, beside its batch's dimensions. Few chapters have many texts each, so no chapter's texts
    are sorted: the smallest doc_id of each batch is rolled up, and all other rows repeat it.
    """
    headings = F.transform(F.filter(F.split("text", DIM_HEADING), lambda p: p.rlike(DIM_PART)), lambda p: F.regexp_extract(p, DIM_NAME, 1))
    read = lambda *more: docs.select("doc_id", F.col("chapter").alias("due"), _mark(*more))
    fault = F.when(F.col("batch").isNull(), "no_mark").when(F.col("phase") != "A", "wrong_phase").when(F.col("chapter") != F.col("due"), "other_chapter").when(~F.col("batch").isin(BATCHES), "unknown_batch")
    marks = read(F.array_distinct(headings).alias("said")).withColumn("fault", fault)
    small = (grouping.agg(F.sum(F.octet_length(F.col("dim_id").cast("string")) + 50)).first()[0] or 0) <= R.SMALL
    sent = F.broadcast if small else lambda rows: rows
    sets = grouping.where(F.col("batch").isin(BATCHES)).groupBy("batch").agg(F.collect_set("dim_id").alias("want"))
    known = grouping.agg(F.collect_set("dim_id").alias("known"))
    beside = marks.join(sent(sets), "batch", "left").crossJoin(sent(known)).withColumn("want", F.coalesce("want", F.array().cast("array<string>")))
    each = lambda name, details: F.transform(details, lambda d: F.struct(F.lit(name).alias("fault"), d.cast("string").alias("detail")))
    wrong = F.when(F.size("said") != F.col("dims"), F.array(F.size("said"))).otherwise(F.array().cast("array<int>"))
    own = F.concat(
        each("unknown_dim", F.array_except("said", "known")), each("wrong_count", wrong), each("missing_dim", F.array_except("want", "said")),
        each("extra_dim", F.array_intersect(F.array_except("said", "want"), F.col("known"))),
    )
    faults = F.when(F.col("fault").isNotNull(), F.array(F.struct(F.col("fault").alias("fault"), F.col("batch").cast("string").alias("detail")))).otherwise(own)
    out = beside.select(F.col("due").alias("chapter"), "doc_id", F.inline(faults))
    good = read().where(fault.isNull()).select("doc_id", "due", "batch")
    first = good.groupBy("due", "batch").agg(F.min("doc_id").alias("first"))
    met = good.join(first, ["due", "batch"])
    is_first = F.col("doc_id").eqNullSafe(F.col("first"))
    # of rows that share the smallest doc_id, too, all but one repeat it
    copies = met.where(is_first).groupBy("due", "batch", "doc_id").agg(F.count("*").alias("n")).where("n > 1").select("due", "batch", "doc_id", F.explode(F.sequence(F.lit(2).cast("long"), F.col("n"))).alias("n")).drop("n")
    again = met.where(~is_first).select("due", "batch", "doc_id").unionByName(copies)
    out = out.unionByName(again.select(F.col("due").alias("chapter"), "doc_id", F.lit("repeated_batch").alias("fault"), F.col("batch").cast("string").alias("detail")))
    due = chapters.select(F.col("chapter").alias("due"), F.explode(F.array(*[F.lit(b) for b in BATCHES])).alias("batch"))
    gone = due.join(first, ["due", "batch"], "left_anti")
    return out.unionByName(gone.select(F.col("due").alias("chapter"), F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id"), F.lit("missing_batch").alias("fault"), F.col("batch").cast("string").alias("detail")))


#: What shows that a report has its scripts' output, and its verdict line.
OUTPUT_PATH, OUTPUT_FIELDS = r"chapter-reports[/\\]ch\d{2,3}-scripts\.json", r"```json|\b(?:C1_h1|C2_manual_number|C3_image_syntax|C4_table_caption|C5_banned|QS1_cjk_chars|QS2_figures|QS3_tables)\b"
VERDICT_LINE = r"(?m)^[^\S\n]*verdict[^\S\n]*=[^\S\n]*(?:PASS|REVISE)[^\S\n]*$"


def report_shape(docs: DataFrame) -> DataFrame:
    """doc_id, has_output (names its scripts' output and a field of it), one_verdict (exactly one verdict line)."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", (text.rlike(OUTPUT_PATH) & text.rlike(OUTPUT_FIELDS)).alias("has_output"), (T.class_count(text, VERDICT_LINE) == 1).alias("one_verdict"))


def chapter_of(phase_a: DataFrame, phase_b: DataFrame) -> DataFrame:
    """doc_id, fault: phase A files that hold no or several chapters (not_one), or another than phase B judges (differs). phase_a: doc_id, chapters (an array); phase_b: doc_id, chapter_id."""
    j = phase_a.join(phase_b, "doc_id", "left")
    fault = F.when(F.size("chapters") != 1, "not_one").when(~F.coalesce(F.get("chapters", F.lit(0)) == F.col("chapter_id"), F.lit(False)), "differs")
    return j.select("doc_id", fault.alias("fault")).where("fault is not null")
