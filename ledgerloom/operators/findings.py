"""Findings as tables: rules over fields, roll-ups by file and mode, and what reports show of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weak marks of secrecy, which are reported and block nothing.
SECRECY_WEAK = r"绝密|(?<!高度)机密|内部资料|内部参考|限内部使用|仅供内部|(?<!跨)密级"


def violations(rows: DataFrame, key: str, rules: list[tuple[str, str, object]]) -> DataFrame:
    """key, path, check: fields that break a rule (path, check, argument), each once; one pass, no shuffle.

    required: null. not_empty: no characters or elements. enum: none of the values. pattern: no match. min, max: a number
    beyond. min_length, max_length: of a string or array. Null breaks required alone.
    """

    def broken(c: Column, check: str, arg: object) -> Column:
        kind = rows.select(c).schema[0].dataType.simpleString()
        size = F.size(c) if kind.startswith(("array", "map")) else F.length(c)
        return {
            "required": lambda: c.isNull(), "not_empty": lambda: size == 0, "enum": lambda: ~c.isin(list(arg)), "pattern": lambda: ~c.rlike(str(arg)),
            "min": lambda: c < arg, "max": lambda: c > arg, "min_length": lambda: size < arg, "max_length": lambda: size > arg,
        }[check]()

    found = [F.when(broken(F.col(path), check, arg), F.struct(F.lit(path).alias("path"), F.lit(check).alias("check"))) for path, check, arg in rules]
    return rows.select(key, F.inline(F.array_compact(F.array(*found))))


def file_verdicts(files: DataFrame, found: DataFrame, mode: str = "block", strict: bool = False) -> DataFrame:
    """doc_id, errors, warnings, passed: one row a file. warn: all pass, errors count as warnings; block: errors fail, in strict mode warnings, too. found: doc_id, severity (error or warning)."""
    counts = found.groupBy("doc_id").agg(F.count_if(F.col("severity") == "error").alias("e"), F.count_if(F.col("severity") == "warning").alias("w"))
    j = files.select("doc_id").distinct().join(counts, "doc_id", "left").select("doc_id", F.coalesce("e", F.lit(0)).cast("long").alias("e"), F.coalesce("w", F.lit(0)).cast("long").alias("w"))
    if mode == "warn":
        return j.select("doc_id", F.lit(0).cast("long").alias("errors"), (F.col("e") + F.col("w")).alias("warnings"), F.lit(True).alias("passed"))
    return j.select("doc_id", F.col("e").alias("errors"), F.col("w").alias("warnings"), ((F.col("e") == 0) & ((F.col("w") == 0) | F.lit(not strict))).alias("passed"))


def run_summary(verdicts: DataFrame) -> DataFrame:
    """One row: files, passed_files, failed_files, errors, warnings, passed, exit_code."""
    row = verdicts.agg(F.count("*").alias("files"), F.count_if("passed").alias("passed_files"), F.count_if(~F.col("passed")).alias("failed_files"), F.coalesce(F.sum("errors"), F.lit(0)).alias("errors"), F.coalesce(F.sum("warnings"), F.lit(0)).alias("warnings"))
    return row.withColumn("passed", F.col("failed_files") == 0).withColumn("exit_code", F.when(F.col("failed_files") == 0, 0).otherwise(1))


def claim_totals(claims: DataFrame) -> DataFrame:
    """doc_id, category, n, high_risk: strong claims by document and category, by document (category null), by category (doc_id null), and all (both null)."""
    return claims.cube("doc_id", "category").agg(F.count("*").alias("n"), F.count_if("high_risk").alias("high_risk"))


def issue_totals(issues: DataFrame, samples: int = 3) -> DataFrame:
    """level, code, n, first_lines: issues by level and code, with the first lines that have them. issues: level, code, line_no."""
    rank = F.row_number().over(Window.partitionBy("level", "code").orderBy("line_no"))
    lines = F.sort_array(F.collect_list(F.when(F.col("rank") <= samples, F.col("line_no"))))
    return issues.withColumn("rank", rank).groupBy("level", "code").agg(F.count("*").alias("n"), lines.alias("first_lines"))


def zipped(left: DataFrame, right: DataFrame, by: str, order: str) -> DataFrame:
    """Rows of both sides of equal place within by: by, place (from 0), left, right (values of order); null where one side is shorter."""
    place = lambda d, name: d.select(by, F.col(order).alias(name), (F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1).alias("place"))
    return place(left, "left").join(place(right, "right"), [by, "place"], "full_outer").select(by, "place", "left", "right")


def by_number(rows: DataFrame, by: str, number: str) -> DataFrame:
    """rows with place (from 1): in the order of chapter and sequence of a number N-M, as numbers."""
    part = lambda i: F.regexp_extract(number, r"^(\d+)-(\d+)", i).try_cast("int")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(part(1), part(2), number)))


def delivery_items(docs: DataFrame, contract: DataFrame, figures: DataFrame, ledger: DataFrame) -> DataFrame:
    """doc_id, item, status: left_sources (no [SRC- is left), figure_numbers (C3 and C4 pass, and the figure gate), ledger (nothing open blocks). contract: doc_id, rule, passed; figures: doc_id, passed; ledger: one row with blocking."""
    status = lambda ok: F.when(ok, "pass").otherwise("fail")
    left = docs.select("doc_id", F.lit("left_sources").alias("item"), status(~F.contains(F.coalesce("text", F.lit("")), F.lit("[SRC-"))).alias("status"))
    rules = contract.where(F.col("rule").isin("C3", "C4")).groupBy("doc_id").agg(F.every("passed").alias("rules"))
    ok = F.coalesce("rules", F.lit(False)) & F.coalesce("gate", F.lit(False))
    numbers = docs.select("doc_id").join(rules, "doc_id", "left").join(figures.select("doc_id", F.col("passed").alias("gate")), "doc_id", "left").select("doc_id", F.lit("figure_numbers").alias("item"), status(ok).alias("status"))
    held = docs.select("doc_id").join(F.broadcast(ledger.select("blocking")), F.lit(True), "left").select("doc_id", F.lit("ledger").alias("item"), status(~F.coalesce("blocking", F.lit(False))).alias("status"))
    return left.unionByName(numbers).unionByName(held)


#: Marks of text within a line, in their priority, and what they hold.
_CODE, _BOLD, _ITALIC, _LINK, _SUPER = r"`[^`]+`", r"\*\*(?:[^*]|\*(?!\*))+\*\*", r"\*[^*]+\*", r"\[[^\]]+\]\([^)]+\)", r"\^[^^\s]+\^"
_RUN = f"{_CODE}|{_BOLD}|{_ITALIC}|{_LINK}|{_SUPER}"
RUN = "array<struct<text:string,bold:boolean,italic:boolean,code:boolean,superscript:boolean,url:string>>"


def inline_runs(text: Column) -> Column:
    """A line's runs as an array of (text, bold, italic, code, superscript, url): code before bold, italics, links and superscripts; marks within bold, italics and links are read, too; what has no partner stays as it is."""

    def run(t: Column, bold: Column, italic: Column, url: Column, kind: str | None = None) -> Column:
        flag = lambda k: F.lit(kind == k)
        return F.struct(t.alias("text"), bold.alias("bold"), italic.alias("italic"), flag("code").alias("code"), flag("super").alias("superscript"), url.alias("url"))

    def level(t: Column, bold: Column, italic: Column, url: Column, depth: int) -> Column:
        marks, plain = F.regexp_extract_all(t, F.lit(f"(?s){_RUN}"), 0), F.split(t, f"(?s){_RUN}")

        def read(m: Column) -> Column:
            inner = lambda n: F.substr(m, F.lit(n + 1), F.length(m) - 2 * n)
            name, to = F.regexp_extract(m, r"^\[([^\]]+)\]", 1), F.regexp_extract(m, r"\(([^)]+)\)$", 1)
            below = (lambda x, b, i, u: level(x, b, i, u, depth - 1)) if depth else (lambda x, b, i, u: F.array(run(x, b, i, u)))
            yes = F.lit(True)
            return (
                F.when(m.startswith("`"), F.array(run(inner(1), bold, italic, url, "code"))).when(m.startswith("**"), below(inner(2), yes, italic, url)).when(m.startswith("*"), below(inner(1), bold, yes, url))
                .when(m.startswith("["), below(name, bold, italic, to)).otherwise(F.array(run(inner(1), bold, italic, url, "super")))
            )

        between = F.transform(plain, lambda p: run(p, bold, italic, url))
        both = F.transform(plain, lambda p, i: F.concat(F.array(F.get(between, i)), F.coalesce(read(F.get(marks, i)), F.array().cast(RUN))))
        return F.filter(F.flatten(both), lambda r: r["text"] != "")

    no = F.lit(False)
    return level(text, no, no, F.lit(None).cast("string"), 1)
