"""Contract rules over report texts (C1 to C20): findings in long form, verdicts, and their roll-up.

Rules are counts of patterns; all of them are taken in one pass over the texts, without a shuffle (C13 alone needs the
figures' table: its findings are joined by doc_id). A text is a row of (doc_id, text); modes are arguments: merged (a final
text instead of a chapter draft) and stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import text as T
from ledgerloom.operators import lines as L

#: Patterns that a text must not hold.
BANNED = {
    "print_hint": r"建议印刷页数",
    "figure_placeholder": r"图表占位|\[此处插入图|\[图\d+-\d+：|图表占位符",
    "end_mark": r"全文完",
    "html_tag": r"(?i)</?(div|span|table|br|img|p)(?![A-Za-z0-9_])",
    "cover_line": r"(?m)^(编制单位|申报单位|编制日期)[:：]",
    "secrecy": r"绝密|机密|秘密|内部资料|(?<![\p{L}\p{N}_])内部(?![\p{L}\p{N}_])|涉密",
    "envelope_mark": r"\[AGENT-OUTPUT-(?:START|END)(?::[0-9a-f]{6,16})?\]",
    "quote_label": r"(?m)^>\s*\*\*本章(?:摘要|概览|要点|核心|概述|总结)\*\*",
}
#: Residue of word counts and self-declarations (counted, never blocking).
RESIDUE = {
    "about_chars": r"全文约\s*\d+\s*字",
    "chapter_chars": r"本章字数",
    "self_claim": r"写作者自声明",
    "gap_mark": r"素材缺口标记",
    "used_in_chapter": r"used_in_chapter",
    "card_id": r"引用的 card_id",
    "length_budget": r"(?m)^\s*>\s*\*\*篇幅预算\*\*",
}
#: Words of self-declarations.
SELF_CLAIM = {"understanding": r"理解陈述", "word_count": r"字数统计", "self_claim": r"写作者自声明"}
#: Manual numbers before a heading, the chapter heading of a merged text, a line that is all bold.
MANUAL_NUMBER = r"^#{2,4}\s+(?:第?\s*[0-9一二三四五六七八九十百]+[.、\s章节]|[0-9]+\.[0-9])"
CHAPTER_HEADING = r"^##\s+第\s*\d+\s*章[：:]\s*\S"
BOLD_LINE = r"^\*\*[^*]+\*\*\s*$"
BOLD_RUN = r"(?m)(?:^ *\*\*[^*\n]+\*\*[^\S\n]*(?:\n|\z)){3,}"
#: Reference marks.
NUMBER_REF, SLASH_REF, S_REF = r"\[\d+(?:,\s*\d+)*\]", r"\[SRC-\d+(?:/\d+)+\]", r"\[S-?\d+\]"
#: The rules that decide the overall verdict, and those that need more.
BLOCKING = ("C1", "C2", "C3", "C4", "C5", "C6", "C9", "C10", "C11", "C12", "C13", "C15")
SEVERITY = {"C1": "fatal", "C2": "fatal", "C3": "high", "C4": "high", "C5": "fatal", "C6": "fatal", "C7": "mid", "C8": "mid", "C9": "fatal", "C10": "fatal", "C11": "fatal", "C12": "fatal", "C13": "fatal", "C14": "warn", "C15": "fatal", "C16": "fatal", "C17": "fatal", "C18": "warn", "C19": "warn", "C20": "warn"}


def rule_counts(docs: DataFrame, rules: dict[str, str], id_col: str = "doc_id", text: Column | None = None) -> DataFrame:
    """doc_id, rule, hits: how often each pattern of a rule table occurs, where it does. One pass, no shuffle."""
    text = F.col("text") if text is None else text
    counted = docs.select(F.col(id_col).alias("doc_id"), *[T.class_count(text, p).alias(f"r{i}") for i, p in enumerate(rules.values())])
    pairs = F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"r{i}").alias("hits")) for i, r in enumerate(rules)])
    return counted.select("doc_id", F.inline(F.filter(pairs, lambda x: x["hits"] > 0)))


def bold_runs(docs: DataFrame) -> DataFrame:
    """Blocks of three or more all-bold lines in a row: doc_id, first, last, n."""
    return L.runs_of(L.lines(docs), "doc_id", "line_no", F.trim("text").rlike(BOLD_LINE))


def _count_lines(text: Column, pattern: str) -> Column:
    return T.class_count(text, "(?m)" + pattern)


def measures(docs: DataFrame, merged: bool, keep: tuple[str, ...] = ()) -> DataFrame:
    """What the rules judge: one row a text with all counts, and the columns to keep."""
    text = F.col("text")
    clean = T.without_fences(text)
    heads = [
        ("h1", _count_lines(clean, r"^#\s+\S")), ("manual", _count_lines(clean, MANUAL_NUMBER.replace(r"\s", r"[^\S\n]"))), ("containers", _count_lines(clean, CHAPTER_HEADING)), ("h2", _count_lines(clean, r"^##[^\S\n]+\S")),
        ("figures", T.class_count(clean, r"!\[图\s*\d+-\d+")), ("captions", T.class_count(clean, r"\*\*表\s*\d+-\d+")), ("tables", T.class_count(clean, r"(?m)^\|.*\|[^\S\n]*\n\|[\s:\-|]+\|[^\S\n]*$")),
        ("banned", sum((T.class_count(clean, p) for p in BANNED.values()), F.lit(0))), ("number_refs", T.class_count(clean, NUMBER_REF)), ("slash_refs", T.class_count(clean, SLASH_REF)), ("s_refs", T.class_count(clean, S_REF)),
        ("src", T.class_count(clean, r"\[SRC-")), ("residue", sum((T.class_count(clean, p) for p in RESIDUE.values()), F.lit(0))),
        ("bib_h2", _count_lines(clean, r"^##[^\S\n]+参考文献.*$")), ("bib_exact", _count_lines(clean, r"^##[^\S\n]+参考文献[^\S\n]*[:：]?[^\S\n]*$")), ("bib_low", _count_lines(clean, r"^#{3,6}[^\S\n]+参考文献")), ("bib_local", _count_lines(clean, r"^#{2,3}[^\S\n]+参考文献")),
        ("tiers", _count_lines(clean, r"^[^\S\n]*\[[ABCD]\]")), ("claims", T.class_count(clean, r"\[[A-Z]{1,3}\d{3}\]")), ("cl", T.class_count(clean, r"\[CL-")), ("self", sum((T.class_count(text, p) for p in SELF_CLAIM.values()), F.lit(0))),
        ("front", text.rlike(r"(?s)^---\s*\n.*?\n---").cast("long")), ("rules", _count_lines(clean, r"^---$")), ("bold", _count_lines(clean, r"^\*\*(?!表)[^*\n]{3,}\*\*[^\S\n]*$")),
    ]
    heads.append(("bold_runs", T.class_count(clean, BOLD_RUN)))
    out = docs.select("doc_id", *keep, *[c.cast("long").alias(n) for n, c in heads])
    # a merged text's chapter headings carry their numbers by rule
    return out.withColumn("manual", F.col("manual") - F.col("containers")) if merged else out


def _rules(merged: bool, stage: str, expect_figures: int | None) -> list[tuple[str, Column, Column]]:
    """Rule, hits, passed over measures(docs, False); a merged text's chapter headings carry their numbers by rule."""
    final, c, ok = merged and stage == "stage9", F.col, F.lit(True)
    manual = c("manual") - c("containers") if merged else c("manual")
    if final:
        bib = (c("bib_low") == 0) & ((c("bib_h2") == 0) | ((c("bib_h2") == 1) & (c("bib_exact") == 1)))
    else:
        bib = c("bib_local") == 0
    return [
        ("C1", c("h1"), c("h1") <= (1 if merged else 0)),
        ("C2", manual + c("bold_runs") + (F.lit(0) if merged else (c("h2") > 0).cast("long")), (manual == 0) & (c("bold_runs") == 0) & (ok if merged else c("h2") == 0)),
        ("C3", c("figures"), ok if expect_figures is None else c("figures") >= expect_figures),
        ("C4", c("tables"), c("captions") >= c("tables")),
        ("C5", c("banned"), c("banned") == 0),
        ("C6", c("slash_refs") + c("s_refs") + (F.lit(0) if final else c("number_refs")), (c("slash_refs") + c("s_refs") == 0) & (ok if final else c("number_refs") == 0)),
        ("C7", c("src"), c("src") == 0 if stage == "stage9" else ok),
        ("C8", c("residue"), ok),
        ("C9", c("bib_h2") + c("bib_low") if final else c("bib_local"), bib),
        ("C10", c("tiers"), c("tiers") == 0), ("C11", c("claims"), c("claims") == 0), ("C12", c("cl"), c("cl") == 0), ("C15", c("self"), c("self") == 0),
        ("C16", c("front"), c("front") == 1 if merged else ok),
        ("C19", c("rules"), ok if merged else c("rules") <= 1),
        ("C20", c("bold"), ok if merged else c("bold") < 3),
    ]


def passed(docs: DataFrame, rules: tuple[str, ...], keep: tuple[str, ...] = (), *, merged: bool = False, stage: str = "stage7") -> DataFrame:
    """doc_id, the columns to keep, and a column for each of the rules: whether the text passes. One row a text, no shuffle; what the rules do not ask for is not counted."""
    of = {r: p for r, _, p in _rules(merged, stage, None)}
    return measures(docs, False, keep).select("doc_id", *keep, *[of[r].alias(r) for r in rules])


def verdicts_by_mode(docs: DataFrame, modes: dict[str, dict], images: DataFrame | None = None) -> DataFrame:
    """doc_id, rule, severity, hits, passed, mode: the verdicts() of several modes (name: merged, stage, expect_figures) from one reading of the texts."""
    rows = []
    for mode, given in modes.items():
        merged, stage = given.get("merged", False), given.get("stage", "stage7")
        level = lambda r, stage=stage: "high" if r == "C7" and stage == "stage9" else SEVERITY[r]
        rows += [F.struct(F.lit(r).alias("rule"), F.lit(level(r)).alias("severity"), h.cast("long").alias("hits"), p.alias("passed"), F.lit(mode).alias("mode")) for r, h, p in _rules(merged, stage, given.get("expect_figures"))]
    out = measures(docs, False).select("doc_id", F.inline(F.array(*rows)))
    if images is None:
        return out
    lost = docs.select("doc_id").join(images.groupBy("doc_id").agg(F.count("*").alias("n")), "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).cast("long").alias("hits"), F.explode(F.array(*map(F.lit, modes))).alias("mode"))
    return out.unionByName(lost.select("doc_id", F.lit("C13").alias("rule"), F.lit(SEVERITY["C13"]).alias("severity"), "hits", (F.col("hits") == 0).alias("passed"), "mode"))


def verdicts(docs: DataFrame, *, merged: bool = False, stage: str = "stage7", expect_figures: int | None = None, images: DataFrame | None = None) -> DataFrame:
    """doc_id, rule, severity, hits, passed: one row a text and rule (C1 to C12, C15, C16, C19, C20; C13 if images, the findings of missing_images(), is given)."""
    return verdicts_by_mode(docs, {"": {"merged": merged, "stage": stage, "expect_figures": expect_figures}}, images).drop("mode")


def _deciding(merged: bool, stage: str) -> list[str]:
    return [*BLOCKING, *(["C7"] if stage == "stage9" else []), *(["C16"] if stage == "stage9" and merged else [])]


def overall_by_mode(found: DataFrame, modes: dict[str, dict]) -> DataFrame:
    """doc_id, mode, passed, fatal_rules: the overall() of each mode of verdicts_by_mode()."""
    decides = F.lit(False)
    for mode, given in modes.items():
        decides = decides | ((F.col("mode") == mode) & F.col("rule").isin(_deciding(given.get("merged", False), given.get("stage", "stage7"))))
    bad = F.sort_array(F.collect_set(F.when(~F.col("passed"), F.col("rule"))))
    return found.where(decides).groupBy("doc_id", "mode").agg(F.every("passed").alias("passed"), bad.alias("fatal_rules"))


def overall_of(docs: DataFrame, modes: dict[str, dict], images: DataFrame | None = None) -> DataFrame:
    """doc_id, mode, passed, fatal_rules: overall_by_mode() of the verdicts_by_mode(), without a row a rule. What a text fails is a number with a bit a rule, in each mode; rules that decide nothing are not counted. images: the findings of missing_images()."""
    rules = sorted({*BLOCKING, "C7", "C16"})
    bit = {r: 1 << i for i, r in enumerate(rules)}
    fails = []
    for mode, given in modes.items():
        merged, stage = given.get("merged", False), given.get("stage", "stage7")
        decides = _deciding(merged, stage)
        fails.append(sum((F.when(~p, bit[r]).otherwise(0) for r, _, p in _rules(merged, stage, given.get("expect_figures")) if r in decides), F.lit(0)).alias(mode))
    rows = measures(docs, False).select("doc_id", *fails)
    if images is not None:
        rows = rows.unionByName(images.select("doc_id", *[F.lit(bit["C13"]).alias(m) for m in modes]))
    met = rows.groupBy("doc_id").agg(*[F.bit_or(F.col(m)).alias(m) for m in modes])
    told = lambda m: F.filter(F.array(*[F.when(F.col(m).bitwiseAND(b) > 0, r) for r, b in bit.items()]), lambda r: r.isNotNull())
    return met.select("doc_id", F.inline(F.array(*[F.struct(F.lit(m).alias("mode"), (F.col(m) == 0).alias("passed"), told(m).alias("fatal_rules")) for m in modes])))


def overall(found: DataFrame, *, merged: bool = False, stage: str = "stage7") -> DataFrame:
    """doc_id, passed, fatal_rules: the verdict over the blocking rules (C7 joins them at stage9, C16 where merged, too)."""
    return overall_by_mode(found.withColumn("mode", F.lit("")), {"": {"merged": merged, "stage": stage}}).drop("mode")


def missing_images(docs: DataFrame, listed: DataFrame | None = None, on_disk: DataFrame | None = None) -> DataFrame:
    """C13: figures/ references that the path map or the folder lacks: doc_id, ref, reason. listed, on_disk: one column, file."""
    refs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"!\[[^\]]*\]\(figures/([^)]+)\)"), 1)).alias("ref"))
    parts = [refs.join(x.select(F.col("file").alias("ref")).distinct(), "ref", "left_anti").select("doc_id", "ref", F.lit(why).alias("reason")) for x, why in ((listed, "not in path map"), (on_disk, "no file")) if x is not None]
    if not parts:
        return refs.select("doc_id", "ref", F.lit("").alias("reason")).limit(0)
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def thin_chapters(claims: DataFrame, least: int = 3) -> DataFrame:
    """C14: chapters that the ledger has with fewer adopted claims than the floor: chapter, n."""
    adopted = claims.where((F.lower(F.trim("adopted")) == "true") & (F.trim("chapter") != ""))
    return adopted.groupBy(F.trim("chapter").alias("chapter")).agg(F.count("*").alias("n")).where(F.col("n") < least)


def cards_without_path(cards: DataFrame) -> DataFrame:
    """C17: cards whose card_file_path is blank."""
    return cards.where(F.trim(F.coalesce("card_file_path", F.lit(""))) == "").select("card_id")


def misplaced_paths(paths: DataFrame, col: str = "path") -> DataFrame:
    """C18: paths with a selfclaim or selfclaims folder."""
    return paths.where(F.arrays_overlap(F.split(col, "/"), F.array(F.lit("selfclaim"), F.lit("selfclaims"))))
