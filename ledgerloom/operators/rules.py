"""Settings by precedence and first matches over tables of rules, instead of chained cases: origins and rules are data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import text as T
from ledgerloom.operators import lines as L

#: Names of metadata in a text and their fields, how a version and its date are written, width of a short title.
FIELDS = {"副标题": "subtitle", "报告类型": "report_type", "编制机构": "organization", "版本": "version"}
VERSION = r"^(V[\d.]+)\s*[|｜]\s*(.+)$"
SHORT = 40
#: Origins of metadata: the first that gives a value counts.
ORIGINS = ("text", "cli", "yaml")
#: Rules up to which they are broadcast.
MOST_RULES = 20_000


def _asked(settings: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """Settings that count, with the rank of their origin."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("origin"))
    return settings.withColumns({"rank": rank, "value": F.trim("value")}).where("rank > 0 AND value <> ''")


def precedence(settings: DataFrame, order: tuple[str, ...] = ORIGINS) -> DataFrame:
    """doc_id, name, value, origin: of each name the value of the first origin that gives one; blank values give none, unknown origins are not asked. Of several values of one origin the smallest counts. settings: doc_id, name, value, origin."""
    best = _asked(settings, order).groupBy("doc_id", "name").agg(F.min(F.struct("rank", "value", "origin")).alias("b"))
    return best.select("doc_id", "name", "b.value", "b.origin")


def metadata(docs: DataFrame, settings: DataFrame, order: tuple[str, ...] = ORIGINS) -> DataFrame:
    """doc_id, title (the first H1), title_short, subtitle, report_type, organization, version, date: a row a document. A text's own lines below its title are the origin "text"; of a name that comes twice the last line counts. A version that names its date is split, else it stays whole. settings: doc_id, name (a field), value, origin."""
    # a text's own lines are read in its row; settings are rolled up by document at once, all names side by side
    heading = F.get(F.filter("lines", lambda x: L.is_heading(x, 1)), F.lit(0))["text"]
    told = L.texts(docs).select("doc_id", F.trim(F.regexp_replace(heading, "^#+", "")).alias("title"), L.own_metadata(F.col("lines")).alias("own"))
    rank = F.array_position(F.array(*map(F.lit, order)), F.lit("text"))
    last = lambda name: F.trim(F.try_element_at(F.filter("own", lambda m: m["name"] == name), F.lit(-1))["value"])
    said = lambda name: F.when((rank > 0) & (last(name) != ""), F.struct(rank.alias("rank"), last(name).alias("value")))
    told = told.select("doc_id", "title", *[said(name).alias(f"own_{f}") for name, f in FIELDS.items()])
    fields = (*FIELDS.values(), "title_short", "date")
    best = lambda f: F.min(F.when(F.col("name") == f, F.struct("rank", "value"))).alias(f"set_{f}")
    wide = _asked(settings, order).where(F.col("name").isin(*fields)).groupBy("doc_id").agg(*map(best, fields))
    chosen = lambda f: (F.least(f"own_{f}", f"set_{f}") if f in FIELDS.values() else F.col(f"set_{f}"))["value"]
    told = told.join(wide, "doc_id", "left").select("doc_id", "title", *[chosen(f).alias(f) for f in fields])
    split = F.col("version").rlike(VERSION)
    return told.select(
        "doc_id", "title", F.coalesce("title_short", T.half_width_cut(F.col("title"), SHORT)).alias("title_short"), "subtitle", "report_type", "organization",
        F.when(split, F.regexp_extract("version", VERSION, 1)).otherwise(F.col("version")).alias("version"), F.coalesce(F.when(split, F.trim(F.regexp_extract("version", VERSION, 2))), F.col("date")).alias("date"),
    )


def unknown_names(docs: DataFrame) -> DataFrame:
    """doc_id, line_no, name: metadata lines that no field has."""
    return L.metadata_lines(L.classified(docs)).where(~F.col("name").isin(*FIELDS)).select("doc_id", "line_no", "name")


def first_match(rows: DataFrame, rules: DataFrame, id_col: str, value_col: str, fallback: str) -> DataFrame:
    """id, value, rule: of each value (rows that share it are asked once) the first rule, by place, whose pattern it holds, in any case; else the fallback, as for null. rules: place (once each), pattern, rule.

    A pattern of letters, digits, blanks, - and _ alone is filed under its first three characters, and only values that
    hold these meet it; shorter ones and regular expressions are held against every value.
    """
    plain = F.col("pattern").rlike("^[A-Za-z0-9 _-]{3,}$")
    filed = rules.select("place", "rule", F.concat(F.lit("(?i)"), "pattern").alias("pattern"), F.when(plain, F.lower(F.substring("pattern", 1, 3))).otherwise("").alias("key"))
    filed = F.broadcast(filed) if filed.count() <= MOST_RULES else filed
    values = rows.select(F.col(value_col).alias("value")).where("value IS NOT NULL").distinct()
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length("value") - 2, F.lit(1))), lambda i: F.lower(F.substr("value", i, F.lit(3))))
    keyed = values.select("value", F.explode(F.array_distinct(F.concat(grams, F.array(F.lit(""))))).alias("key"))
    met = keyed.join(filed, "key").where(F.regexp("value", F.col("pattern"))).groupBy("value").agg(F.min_by("rule", "place").alias("rule"))
    own = rows.select(F.col(id_col).alias("id"), F.col(value_col).alias("value"))
    return own.join(met, "value", "left").select("id", "value", F.coalesce("rule", F.lit(fallback)).alias("rule"))
