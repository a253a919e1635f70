"""The checklist of a delivery: thirteen items and one beside the third, of texts, rules, glossary, figures and ledger, as rows with a status of four values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators import contract, drafts, terms
from ledgerloom.operators import references as R

#: References that are left, references by number, the head of a bibliography, its entries.
SOURCES_LEFT, BY_NUMBER = r"\[SRC-\d+(?:\s*,\s*SRC-\d+)*\]", r"\[\d+(?:\s*,\s*\d+)*\]"
BIBLIOGRAPHY, ENTRY = r"(?m)^#{1,3}\s+参考文献\s*$", r"^\[(\d+)\]"
#: Items in their order, and the rules of the contract that some of them are.
ITEMS = ("01", "02", "03", "03b", "04", "05", "06", "07", "08", "09", "10", "11", "12", "13")
RULES = {"02": ("C6",), "04": ("C3", "C4"), "05": ("C5",), "08": ("C8",), "09": ("C9",)}
MANUAL = "manual_required"


def _numbers(found: Column) -> Column:
    """Digits as numbers are written: without leading zeros."""
    return F.transform(found, lambda x: F.regexp_replace(x, "^0+(?=.)", ""))


def references(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns to keep, status, missing (numbers that the text cites and its bibliography lacks), orphan (entries that it does not cite), again (entries that come twice), each in order: without a bibliography a text passes if it cites none by number."""
    parts = F.split(F.coalesce("text", F.lit("")), BIBLIOGRAPHY, 2)
    own = docs.select("doc_id", *keep, F.get(parts, F.lit(0)).alias("body"), F.get(parts, F.lit(1)).alias("tail"))
    cited = _numbers(F.flatten(F.transform(F.regexp_extract_all("body", F.lit(BY_NUMBER), 0), lambda b: F.regexp_extract_all(b, F.lit(r"\d+"), 0))))
    lines = F.transform(F.split("tail", "\n"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    entries = _numbers(F.transform(F.filter(lines, lambda x: x.rlike(ENTRY)), lambda x: F.regexp_extract(x, ENTRY, 1)))
    told = own.select("doc_id", *keep, F.array_distinct(cited).alias("cited"), entries.alias("entries"))
    order = lambda a: F.transform(F.array_sort(F.transform(a, lambda x: F.struct(F.length(x).alias("n"), x.alias("x")))), lambda s: s["x"])
    none = F.array().cast("array<string>")
    again = F.filter(F.array_distinct("entries"), lambda e: F.size(F.filter("entries", lambda x: x == e)) > 1)
    some = told.select("doc_id", *keep, F.col("entries").isNull().alias("bare"), "cited", order(F.array_except("cited", "entries")).alias("missing"), order(F.array_except(F.array_distinct("entries"), "cited")).alias("orphan"), order(again).alias("again"))
    bad = F.when(F.col("bare"), F.size("cited") > 0).otherwise(F.size("missing") + F.size("orphan") + F.size("again") > 0)
    return some.select("doc_id", *keep, F.when(bad, "fail").otherwise("pass").alias("status"), *[F.coalesce(c, none).alias(c) for c in ("missing", "orphan", "again")])


def checklist(docs: DataFrame, glossary: DataFrame | None = None, core: DataFrame | None = None, figures: DataFrame | None = None, ledger: DataFrame | None = None) -> DataFrame:
    """doc_id, item, status (pass, fail, skipped, manual_required): a row for each text (doc_id once each) and item.

    01 terms: no banned form (glossary: term_id, banned_forms) and each form of core (term_id, preferred_form) word for
    word; skipped without both. 02 to 09: rules of the contract over a merged text of the last stage, references left,
    bibliography against references, figures (with figures, the gate's doc_id and passed), marks and annotations left. 10 is
    told, never failed. 11 and 12 are for people. 13: nothing in the ledger (one row with blocking) is open; passes without one.
    """
    status = lambda ok: F.when(ok, "pass").otherwise("fail")
    text = F.coalesce("text", F.lit(""))
    # all that is judged from the text alone stays in its row
    own = docs.select("doc_id", "text", (~text.rlike(SOURCES_LEFT)).alias("t03"), (~text.rlike("(?m)" + drafts.SELF_CLAIM_HEADING)).alias("t06"), (~text.rlike("(?m)" + drafts.ANNOTATION_LINE)).alias("t07"))
    asked, told = tuple(r for rules in RULES.values() for r in rules), ("t03", "t06", "t07")
    judged = contract.passed(own, asked, ("text", *told), merged=True, stage="stage9")
    j = references(judged, (*told, *asked)).select("doc_id", *told, F.col("status").alias("t03b"), *[F.coalesce(reduce(lambda a, b: a & b, map(F.col, r)), F.lit(True)).alias(f"r{i}") for i, r in RULES.items()])
    if figures is not None:
        j = j.join(figures.select("doc_id", F.col("passed").alias("gate")), "doc_id", "left")
    bad = None
    if glossary is not None:
        bad = R.banned_forms(docs, glossary).select("doc_id")
    if core is not None:
        lost = terms.missing_terms(docs, core).select("doc_id")
        bad = lost if bad is None else bad.unionByName(lost)
    if bad is not None:
        j = j.join(bad.distinct().withColumn("bad", F.lit(True)), "doc_id", "left")
    blocking = bool(ledger is not None and (row := ledger.select("blocking").first()) and row["blocking"])
    of = {
        "01": F.lit("skipped") if bad is None else status(F.col("bad").isNull()), "03": status(F.col("t03")), "03b": F.col("t03b"), "06": status(F.col("t06")), "07": status(F.col("t07")), "10": F.lit("pass"), "11": F.lit(MANUAL), "12": F.lit(MANUAL), "13": F.lit("fail" if blocking else "pass"),
        **{i: status(F.coalesce(F.col(f"r{i}"), F.lit(True)) & (F.coalesce("gate", F.lit(False)) if i == "04" and figures is not None else F.lit(True))) for i in RULES},
    }
    return j.select("doc_id", F.inline(F.array(*[F.struct(F.lit(i).alias("item"), of[i].alias("status")) for i in ITEMS])))
