"""Figures: sizes and resolutions, path maps against folders and texts, mentions against captions, and delivery checks.

files are rows (doc_id, file): what lies in the figure folder of a document. Names are compared without folders.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import text as T
from ledgerloom.operators import references as R

#: Widths (pixels) and resolutions (dots an inch) that figures are held to.
MIN_WIDTH, FULL_WIDTH, MIN_DPI, DPI_SLACK = 1102, 1654, 300.0, 0.5
#: Images of figures, their captions and mentions.
IMAGE = r"!\[图\s*(\d+-\d+)[^\]]*\]\(([^)]+)\)"
CAPTION = r"^\s*(?:!\[|\*{0,2})\s*([图表])\s*(\d+-\d+)"
MENTION = r"[图表]\s*\d+-\d+"


def gate_level(width: Column, dpi: Column) -> Column:
    """error: narrower than MIN_WIDTH, or a resolution below MIN_DPI by more than the slack; warning: one within the slack, or none; else ok."""
    low = (width < MIN_WIDTH) | (dpi < MIN_DPI - DPI_SLACK)
    return F.when(width.isNull() | low, "error").when(dpi.isNull() | (dpi < MIN_DPI), "warning").otherwise("ok")


def chart_passes(width: Column, dpi_x: Column, dpi_y: Column) -> Column:
    """Charts are held to the full resolution in both directions."""
    return F.coalesce((width >= MIN_WIDTH) & (dpi_x >= MIN_DPI) & (dpi_y >= MIN_DPI), F.lit(False))


def width_band(width: Column) -> Column:
    """warning below MIN_WIDTH, info below FULL_WIDTH, else ok; null is unknown."""
    return F.when(width < MIN_WIDTH, "warning").when(width < FULL_WIDTH, "info").when(width.isNotNull(), "ok")


def image_refs(docs: DataFrame) -> DataFrame:
    """doc_id, figure_no, file: images of figures in a text, each once."""
    found = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(IMAGE), 0)).alias("m"))
    return found.select("doc_id", F.regexp_extract("m", IMAGE, 1).alias("figure_no"), T.file_name(F.regexp_extract("m", IMAGE, 2)).alias("file")).distinct()


def path_findings(manifest: DataFrame, files: DataFrame, refs: DataFrame) -> DataFrame:
    """doc_id, figure_no, file, finding, level: a three-way reconciliation by name.

    manifest: doc_id, figure_no, file (what should be made; PNG alone counts). refs: image_refs(). declared_missing and
    ref_missing (FATAL): not in the folder. ref_undeclared (WARN): in the folder, but another than the figure's manifest
    names. Figures that the manifest lacks are not judged.
    """
    want = manifest.select("doc_id", "figure_no", T.file_name(F.col("file")).alias("file")).where(F.col("file").endswith(".png")).distinct().withColumn("declared", F.lit(True))
    known = manifest.select("doc_id", "figure_no").distinct()
    named = want.select("doc_id", "figure_no").distinct().withColumn("has_png", F.lit(True))
    used = refs.join(known, ["doc_id", "figure_no"], "left_semi").withColumn("used", F.lit(True))
    disk = files.select("doc_id", T.file_name(F.col("file")).alias("file")).distinct().withColumn("there", F.lit(True))
    rows = want.join(used, ["doc_id", "figure_no", "file"], "full_outer").join(disk, ["doc_id", "file"], "left").join(named, ["doc_id", "figure_no"], "left").fillna(False, ["declared", "used", "there", "has_png"])
    one = lambda f, lv: F.struct(F.lit(f).alias("finding"), F.lit(lv).alias("level"))
    some = F.array_compact(F.array(
        F.when(F.col("declared") & ~F.col("there"), one("declared_missing", "FATAL")), F.when(F.col("used") & ~F.col("there"), one("ref_missing", "FATAL")),
        F.when(F.col("used") & F.col("there") & F.col("has_png") & ~F.col("declared"), one("ref_undeclared", "WARN")),
    ))
    return rows.select("doc_id", "figure_no", "file", F.inline(some))


def upserted(entries: DataFrame, existing: DataFrame) -> DataFrame:
    """One row a figure_no: the latest of entries (by seq), else the existing one. Both have the same columns, seq among them; those of existing count as older."""
    both = entries.withColumn("__new", F.lit(1)).unionByName(existing.withColumn("__new", F.lit(0)))
    newest = Window.partitionBy("figure_no").orderBy(F.desc("__new"), F.desc("seq"))
    return both.withColumn("__n", F.row_number().over(newest)).where("__n = 1").drop("__n", "__new")


def entry_faults(entries: DataFrame, required: list[str]) -> DataFrame:
    """figure_no, fault: entries of a path map that lack a required field (its name), or whose markdown_ref holds none of their file's name (markdown_ref). entries: figure_no, drawio_png, markdown_ref and the required ones."""
    empty = [F.when(F.trim(F.coalesce(c, F.lit(""))) == "", F.lit(c)) for c in required]
    astray = F.when((F.col("drawio_png") != "") & ~F.contains(F.coalesce("markdown_ref", F.lit("")), T.file_name(F.col("drawio_png"))), F.lit("markdown_ref"))
    return entries.select("figure_no", F.explode(F.array_distinct(F.array_compact(F.array(*empty, astray)))).alias("fault"))


def mention_findings(rows: DataFrame) -> DataFrame:
    """doc_id, kind, no, finding: figures and tables mentioned without being there (no_entity), there but never mentioned (unmentioned), or first mentioned behind their caption (late). rows: doc_id, line_no, text.

    A line that starts with a caption or an image is the entity; mentions are in other lines.
    """
    named = rows.where(F.col("text").rlike(MENTION)).select("doc_id", "line_no", F.regexp_extract("text", CAPTION, 1).alias("own"), F.regexp_extract("text", CAPTION, 2).alias("own_no"), "text")
    mention = lambda m: F.struct(F.substring(m, 1, 1).alias("kind"), F.regexp_extract(m, r"\d+-\d+", 0).alias("no"))
    marks = F.when(F.col("own") == "", F.transform(F.regexp_extract_all("text", F.lit(MENTION), 0), mention)).otherwise(F.array(F.struct(F.col("own").alias("kind"), F.col("own_no").alias("no"))))
    marks = named.select("doc_id", "line_no", (F.col("own") != "").alias("is_entity"), F.inline(marks))
    # entities and mentions meet in one roll-up by number
    j = marks.groupBy("doc_id", "kind", "no").agg(F.min(F.when(F.col("is_entity"), F.col("line_no"))).alias("at"), F.min(F.when(~F.col("is_entity"), F.col("line_no"))).alias("first"))
    finding = F.when(F.col("at").isNull(), "no_entity").when(F.col("first").isNull(), "unmentioned").when(F.col("first") > F.col("at"), "late")
    return j.select("doc_id", "kind", "no", finding.alias("finding")).where("finding is not null")


def run_ids(outlines: DataFrame, drafts: DataFrame) -> DataFrame:
    """doc_id, run_id: twelve digits of the SHA-1 of the outline and its drafts' names in order. outlines: doc_id, text; drafts: doc_id, name."""
    names = drafts.groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_list("name")), "").alias("names"))
    return outlines.join(names, "doc_id", "left").select("doc_id", F.substring(F.sha1(F.concat(F.coalesce("text", F.lit("")), F.coalesce("names", F.lit("")))), 1, 12).alias("run_id"))


def unproven(delivered: DataFrame, provenance: DataFrame) -> DataFrame:
    """path: delivered files of which no run tells. provenance: delivery_paths (an array)."""
    return R.difference(delivered.select("path"), provenance.select(F.explode("delivery_paths").alias("path")), "path").where("side = 'left'").select("path")


def checklist(items: DataFrame) -> DataFrame:
    """doc_id, passed, failed, manual: the verdict over a delivery's items (doc_id, item, status). pass and skipped pass; manual_required never fails; failed lists the others."""
    bad = ~F.coalesce(F.col("status").isin("pass", "skipped", "manual_required"), F.lit(False))
    return items.groupBy("doc_id").agg((F.count_if(bad) == 0).alias("passed"), F.sort_array(F.collect_set(F.when(bad, F.col("item")))).alias("failed"), F.count_if(F.col("status") == "manual_required").alias("manual"))


#: A figure's number, marks of architecture figures, and how a text plans its figures.
NUMBER, ARCHITECTURE = r"\d+-\d+", "架构"
ARCHITECTURE_BLOCK = r"(?s)🏗️.*?核心架构图.*?\n(.*?)(?:\n\n|\n##|\z)"
PLAN_LINE = r"\*\*图表规划\*\*[：:]\s*([^\n]*)"


def plan_from_list(entries: DataFrame) -> DataFrame:
    """doc_id, figure_id, figure_no, title, type (architecture or data), priority, chapter: entries of a list under their usual names. entries: doc_id, and of figure_id or fig_id, title or fig_title, fig_type or type, figure_no, priority, chapter those that there are."""
    have = lambda *names: F.coalesce(*[F.nullif(F.col(n).cast("string"), F.lit("")) for n in names if n in entries.columns], F.lit(None).cast("string"))
    name, kind = F.coalesce(have("figure_id", "fig_id"), F.lit("?")), F.coalesce(have("fig_type", "type"), F.lit(""))
    number = F.coalesce(have("figure_no"), F.nullif(F.regexp_extract(name, NUMBER, 0), F.lit("")), name)
    type_ = F.when(F.contains(kind, F.lit(ARCHITECTURE)) | F.coalesce(have("type") == "architecture", F.lit(False)), "architecture").otherwise("data")
    return entries.select("doc_id", name.alias("figure_id"), number.alias("figure_no"), F.coalesce(have("title", "fig_title"), F.lit("")).alias("title"), type_.alias("type"), F.coalesce(have("priority"), F.lit("required")).alias("priority"), have("chapter").alias("chapter"))


def plan_from_text(docs: DataFrame) -> DataFrame:
    """doc_id, figure_no, title, type: what an outline's text plans, where it has no list: figures of its architecture block, then those of its plan lines, each number once; data figures have no number yet."""
    body = F.regexp_replace("text", r"(?s)^---.*?---", "")
    block = docs.select("doc_id", F.lit(0).alias("step"), F.posexplode(F.regexp_extract_all(F.regexp_extract(body, ARCHITECTURE_BLOCK, 1), F.lit(r"图\s*(\d+-\d+)"), 1)).alias("at", "figure_no"))
    lines = docs.select("doc_id", F.posexplode(F.regexp_extract_all(body, F.lit(PLAN_LINE), 1)).alias("line", "plan"))
    named = lines.select("doc_id", (F.col("line") + 1).alias("step"), F.posexplode(F.regexp_extract_all("plan", F.lit(r"架构图\s*(\d+-\d+)"), 1)).alias("at", "figure_no"))
    first = block.unionByName(named).groupBy("doc_id", "figure_no").agg(F.min("step").alias("step"))
    drawn = first.select("doc_id", "figure_no", F.concat(F.when(F.col("step") == 0, "核心架构图 ").otherwise("架构图 "), "figure_no").alias("title"), F.lit("architecture").alias("type"))
    data = lines.select("doc_id", F.explode(F.regexp_extract_all("plan", F.lit(r"数据图[：:]\s*(.*?)(?:$|。)"), 1)).alias("title"))
    return drawn.unionByName(data.select("doc_id", F.lit(None).cast("string").alias("figure_no"), F.trim("title").alias("title"), F.lit("data").alias("type")))


def file_checklist(plan: DataFrame, stage: str) -> DataFrame:
    """plan with extension: architecture figures are diagrams at stage6 and images later; data figures are due at stage9 only."""
    due = plan.where((F.col("type") == "architecture") | F.lit(stage == "stage9"))
    return due.withColumn("extension", F.when((F.col("type") == "architecture") & F.lit(stage == "stage6"), "drawio").otherwise("png"))


def found_files(due: DataFrame, files: DataFrame) -> DataFrame:
    """due with files (names, sorted), how (number, loose or null) and valid: files whose name holds the number and which have the extension; without any, PNG files whose name holds the number with another character, or none, for the dash. valid: no PNG of them fails. files: doc_id, file, fails."""
    f = files.select("doc_id", T.file_name(F.col("file")).alias("file"), F.coalesce("fails", F.lit(False)).alias("fails")).distinct()
    # a file is joined by the numbers that its name can stand for, not by looking through all names
    dashed = F.regexp_extract_all("file", F.lit(r"(?=((?<!\d)\d+-\d+(?!\d)))"), 1)
    pieces = F.regexp_extract_all("file", F.lit(r"(\d+)"), 1)
    loose = F.concat(F.transform(F.regexp_extract_all("file", F.lit(r"(?=((?<!\d)\d+[^\d]\d+(?!\d)))"), 1), lambda x: F.regexp_replace(x, r"[^\d]", "-")), F.flatten(F.transform(pieces, lambda x: F.when(F.length(x) >= 2, F.transform(F.sequence(F.lit(1), F.length(x) - 1), lambda i: F.concat_ws("-", F.substr(x, F.lit(1), i), F.substr(x, i + 1)))).otherwise(F.array().cast("array<string>")))))
    keyed = f.select("doc_id", "file", "fails", F.inline(F.array_distinct(F.concat(F.transform(dashed, lambda x: F.struct(x.alias("figure_no"), F.lit("number").alias("how"))), F.transform(loose, lambda x: F.struct(x.alias("figure_no"), F.lit("loose").alias("how")))))))
    keyed = keyed.withColumn("ending", F.lower(F.regexp_extract("file", r"\.([^.]+)$", 1)))
    met = due.select("doc_id", "figure_no", "extension").distinct().join(keyed, ["doc_id", "figure_no"]).where(((F.col("how") == "number") & (F.col("ending") == F.col("extension"))) | ((F.col("how") == "loose") & (F.col("ending") == "png")))
    best = met.groupBy("doc_id", "figure_no", "extension", "how").agg(F.sort_array(F.collect_set("file")).alias("files"), (F.count_if(F.col("fails") & (F.col("ending") == "png")) == 0).alias("valid"))
    best = best.groupBy("doc_id", "figure_no", "extension").agg(F.max_by(F.struct("files", "how", "valid"), "how").alias("b"))
    return due.join(best, ["doc_id", "figure_no", "extension"], "left").select(*[due[c] if c not in ("doc_id", "figure_no", "extension") else F.col(c) for c in due.columns], F.coalesce("b.files", F.array().cast("array<string>")).alias("files"), F.col("b.how").alias("how"), F.coalesce("b.valid", F.lit(False)).alias("valid"))


def gate_totals(found: DataFrame) -> DataFrame:
    """doc_id, total, found, missing, invalid (of the required), optional_missing, optional_invalid, passed (nothing required is missing or invalid)."""
    there, need = F.size("files") > 0, F.col("priority") == "required"
    rows = found.groupBy("doc_id").agg(
        F.count("*").alias("total"), F.count_if(there).alias("found"), F.count_if(need & ~there).alias("missing"), F.count_if(need & there & ~F.col("valid")).alias("invalid"),
        F.count_if(~need & ~there).alias("optional_missing"), F.count_if(~need & there & ~F.col("valid")).alias("optional_invalid"),
    )
    return rows.withColumn("passed", (F.col("missing") == 0) & (F.col("invalid") == 0))


def resolved_images(refs: DataFrame, files: DataFrame) -> DataFrame:
    """refs with file: the first candidate that exists: the path itself, below the text's folder, below the figure folder, then the same with %-signs decoded; .svg stands for the .png beside it. refs: doc_id, ref, text_dir, figure_dir; files: file."""
    png = lambda c: F.regexp_replace(c, r"(?i)\.svg$", ".png")
    name, decoded = png(F.col("ref")), png(F.try_url_decode(F.col("ref")))
    below = lambda d, c: F.concat_ws("/", d, c)
    ways = F.array(name, below("text_dir", name), below("figure_dir", T.file_name(name)), decoded, below("text_dir", decoded), below("figure_dir", T.file_name(decoded)))
    tried = refs.select("doc_id", "ref", F.posexplode(ways).alias("at", "file")).join(files.select("file"), "file", "left_semi")  # not made distinct first: so a name that many ask for is split over tasks
    first = tried.groupBy("doc_id", "ref").agg(F.min_by("file", "at").alias("file"))
    return refs.join(first, ["doc_id", "ref"], "left")


def off_palette(pixels: DataFrame, palette: list[str], near: int = 30, most: float = 0.02, sample: int = 2000, seed: int = 7) -> DataFrame:
    """doc_id, sampled, share (of pixels that are near no colour of the palette; white counts as near), passed: each image judged on a seeded sample of its pixels. pixels: doc_id, rgb (binary, three bytes a pixel)."""
    allowed = np.array([[int(h.lstrip("#")[i : i + 2], 16) for i in (0, 2, 4)] for h in palette], np.int64)

    def judge(images: pa.Array) -> pa.Array:
        out = []
        for x in images:
            p = np.frombuffer(x.as_py() or b"", np.uint8)
            p = p[: len(p) // 3 * 3].reshape(-1, 3).astype(np.int64)
            p = p[np.random.default_rng(seed).choice(len(p), min(sample, len(p)), replace=False)] if len(p) else p
            close = ((p[:, None, :] - allowed[None]) ** 2).sum(2).min(1, initial=1 << 40) < near * near
            out.append({"n": len(p), "bad": int((~close & ~(p == 255).all(1)).sum())})
        return pa.array(out, pa.struct([("n", pa.int64()), ("bad", pa.int64())]))

    rows = pixels.select("doc_id", F.arrow_udf(judge, "n long, bad long")("rgb").alias("j"))
    share = F.when(F.col("j.n") > 0, F.col("j.bad") / F.col("j.n"))
    return rows.select("doc_id", F.col("j.n").alias("sampled"), share.alias("share"), F.coalesce(share < most, F.lit(False)).alias("passed"))


#: What a delivered file's name must not hold, and its greatest length in the bytes of a double-byte code.
UNSAFE, STEM_BYTES = r'[<>:"/\\|?*]', 120


def delivery_stem(title: Column) -> Column:
    """A title as the stem of a file's name: unsafe characters are _, white space is one space, dots at the end go, it is cut to STEM_BYTES (a character beyond ASCII being two bytes), and an empty one is report."""
    trimmed = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(title, F.lit("")), UNSAFE, "_"), r"(?U)^\s+|\s+$", ""), r"\.+$", "")
    clean = F.regexp_replace(trimmed, r"(?U)\s+", " ")
    chars = F.split(clean, "")
    size = F.transform(chars, lambda c: F.when(c.rlike(r"^[\x00-\x7F]?$"), F.length(c)).otherwise(2))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("w"))
    fits = F.aggregate(size, start, lambda a, x: F.struct(F.when(a["w"] + x <= STEM_BYTES, a["n"] + 1).otherwise(a["n"]).alias("n"), F.when(a["w"] + x <= STEM_BYTES, a["w"] + x).otherwise(1 << 20).alias("w")))
    return F.when(clean == "", "report").otherwise(F.array_join(F.slice(chars, F.lit(1), fits["n"]), ""))


def index_tables(figures: DataFrame) -> DataFrame:
    """doc_id, text: the table of a document's figures, in the order of their numbers. figures: doc_id, figure_no, title, type, chapter."""
    cell = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    part = lambda i: F.regexp_extract("figure_no", r"^(\d+)-(\d+)", i).try_cast("int")
    row = F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in ("figure_no", "title", "type", "chapter")]), F.lit(" |"))
    rows = figures.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(part(1).alias("a"), part(2).alias("b"), cell("figure_no").alias("n"), row.alias("row")))).alias("rows"))
    head = F.lit("| 编号 | 标题 | 类型 | 所属章节 |\n|---|---|---|---|\n")
    return rows.select("doc_id", F.concat(head, F.array_join(F.transform("rows", lambda r: r["row"]), "\n")).alias("text"))
