"""Readers. All go through Spark's own sources, so any store that Spark reads will do."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as t

from ledgerloom.functions import text as T
from ledgerloom.operators.references import last_by_key

_s = lambda names: t.StructType([t.StructField(n, t.StringType()) for n in names.split()])
SOURCES = _s("source_id title language author_or_org publisher publish_date access_date url_or_path source_type credibility_level relevant_chapters local_path extraction_status notes adopted visibility")
CLAIMS = _s("claim_id claim_text source_file page_or_location claim_type verification_status evidence_sources confidence rewrite_suggestion risk_note adopted claim_nature chapter")
CARDS = _s("card_id card_type title chapter_ref evidence_packet_refs credibility_summary status used_in_chapter transcription_check card_file_path")
COLORS = _s("concept color_hex first_used_fig")
EVENTS = "event_id string, ts timestamp, stage string, component string, reason string, level string, fallback_used string, impact string, acknowledged boolean, record_type string"
PNG_MAGIC = "89504E470D0A1A0A"


def texts(spark: SparkSession, path: str, glob: str = "*.md") -> DataFrame:
    """path, doc_id (file name), text: BOM dropped, line ends unified, wrong bytes replaced (U+FFFD). Spark reads no row for an empty file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select("path", T.file_name(F.col("path")).alias("doc_id"), T.decoded(F.col("content")).alias("text"))


def encoding_report(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """doc_id, has_bom, crlf, lone_cr, valid: what a strict reader objects to; counts are of bytes."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    raw = F.decode("content", "ISO-8859-1")
    count = lambda p: F.regexp_count(raw, F.lit(p)).cast("long")
    return files.select(T.file_name(F.col("path")).alias("doc_id"), (F.hex(F.substring("content", 1, 3)) == "EFBBBF").alias("has_bom"), count("\r\n").alias("crlf"), count("\r(?!\n)").alias("lone_cr"), F.is_valid_utf8(F.col("content").cast("string")).alias("valid"))


def csv(spark: SparkSession, path: str, schema: t.StructType, required: tuple[str, ...] = ()) -> DataFrame:
    """A header-driven CSV in the columns of a schema: columns in another order are found by name, absent ones are empty, others are left out; a required one must be there."""
    raw = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)
    names = {c.strip().removeprefix("﻿"): c for c in raw.columns}
    if absent := [c for c in required if c not in names]:
        raise ValueError(f"{path}: no column {', '.join(absent)}")
    return raw.select(*[F.coalesce(F.col(f"`{names[f.name]}`"), F.lit("")).alias(f.name) if f.name in names else F.lit("").alias(f.name) for f in schema.fields])


def source_index(spark: SparkSession, path: str) -> DataFrame:
    """The source index, one row an id: the last one, in the order of the files' names; rows without id go."""
    rows = csv(spark, path, SOURCES, ("source_id", "title")).withColumn("__at", F.struct(F.input_file_name(), F.monotonically_increasing_id()))
    return last_by_key(rows, "source_id", "__at").drop("__at")


def claims(spark: SparkSession, path: str) -> DataFrame:
    return csv(spark, path, CLAIMS)


def cards(spark: SparkSession, path: str) -> DataFrame:
    """The card index; evidence_packet_refs as an array."""
    return csv(spark, path, CARDS).withColumn("evidence_packet_refs", F.filter(F.transform(F.split("evidence_packet_refs", ";"), F.trim), lambda x: x != ""))


def color_registry(spark: SparkSession, path: str, palette: list[str]) -> DataFrame:
    """The colour registry with in_palette."""
    return csv(spark, path, COLORS, ("concept", "color_hex", "first_used_fig")).withColumn("in_palette", F.upper(F.trim("color_hex")).isin([p.upper() for p in palette]))


def event_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Events and acknowledgements of a JSONL ledger; malformed lines are skipped."""
    rows = spark.read.schema(EVENTS).option("mode", "DROPMALFORMED").json(path).where("event_id is not null")
    is_ack = F.coalesce(F.col("record_type") == "acknowledgement", F.lit(False))
    return rows.where(~is_ack).drop("record_type"), rows.where(is_ack).select("event_id", "ts")


def path_map(spark: SparkSession, path: str) -> DataFrame:
    """A figure path map {figures: {no: {...}}} as rows: figure_no, title, type, chapter, drawio, drawio_png, drawio_svg, markdown_ref."""
    entry = "figure_no string, title string, type string, chapter string, files struct<drawio:string,drawio_png:string,drawio_svg:string>, markdown_ref string"
    raw = spark.read.schema(f"figures map<string, struct<{', '.join(x.strip().replace(' ', ':', 1) for x in entry.split(', '))}>>").option("multiLine", "true").json(path)
    rows = raw.select(F.explode("figures").alias("no", "e"))
    return rows.select(F.coalesce("e.figure_no", "no").alias("figure_no"), "e.title", "e.type", "e.chapter", "e.files.drawio", "e.files.drawio_png", "e.files.drawio_svg", "e.markdown_ref")


def png_sizes(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, valid, width, height from the first bytes of PNG files; no image library."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").load(path)
    number = lambda at: F.conv(F.hex(F.substring("content", at, 4)), 16, 10).cast("long")
    valid = (F.hex(F.substring("content", 1, 8)) == PNG_MAGIC) & (F.length("content") >= 33)
    return files.select(T.file_name(F.col("path")).alias("doc_id"), valid.alias("valid"), F.when(valid, number(17)).alias("width"), F.when(valid, number(21)).alias("height"))


def diagram_cells(spark: SparkSession, path: str) -> DataFrame:
    """Cells of diagram files, as text: doc_id, id, value, style, vertex, edge, parent, source, target, x, y, width, height, relative. A file that is no XML gives no cell."""
    geometry = t.StructType([t.StructField(f"_{n}", t.StringType()) for n in "x y width height relative as".split()])
    schema = t.StructType([t.StructField(f"_{n}", t.StringType()) for n in "id value style vertex edge parent source target".split()] + [t.StructField("mxGeometry", geometry)])
    rows = spark.read.format("xml").option("rowTag", "mxCell").option("mode", "DROPMALFORMED").schema(schema).load(path)
    flat = [F.col(f"_{n}").alias(n) for n in "id value style vertex edge parent source target".split()] + [F.col(f"mxGeometry._{n}").alias(n) for n in "x y width height relative".split()]
    return rows.select(T.file_name(F.input_file_name()).alias("doc_id"), *flat, F.col("mxGeometry").isNotNull().alias("has_geometry"))


def yaml_blocks(docs: DataFrame, schema: str, pattern: str = r"(?s)^---\s*\n(.*?)\n---") -> DataFrame:
    """doc_id, data (a struct of the schema; null where there is none or it cannot be read), from the block that a pattern finds."""
    return docs.select("doc_id", F.from_json(_yaml_to_json()(F.regexp_extract("text", pattern, 1)), schema).alias("data"))


#: Nesting up to which YAML goes to libyaml, whose stack has no guard.
YAML_DEPTH = 5000


def _yaml_to_json():  # noqa: ANN202
    @F.pandas_udf(t.StringType())
    def to_json(block: pd.Series) -> pd.Series:
        import json

        import yaml

        def loader(s: str) -> type:
            """libyaml, where it is and where nesting (bounded by brackets and the longest line) can't exhaust its stack."""
            depth = s.count("[") + s.count("{") + 2 * max(map(len, s.splitlines() or [""]))
            return getattr(yaml, "CSafeLoader", yaml.SafeLoader) if depth <= YAML_DEPTH else yaml.SafeLoader

        def one(s: str | None) -> str | None:
            try:
                return json.dumps(yaml.load(s, loader(s)), default=str, ensure_ascii=False) if s else None
            except (yaml.YAMLError, ValueError, TypeError, RecursionError):  # no YAML, no such date, a key that JSON lacks, too deep
                return None

        read = {s: one(s) for s in block.dropna().unique()}  # equal texts are read once a batch
        return pd.Series([read.get(s) for s in block], dtype=object)

    return to_json


def glossary(docs: DataFrame) -> DataFrame:
    """Terms of the last fenced YAML block of each text: doc_id, term_id, preferred_form, aliases, banned_forms, scope, category."""
    last = F.element_at(F.concat(F.array(F.lit("")), F.regexp_extract_all("text", F.lit(r"(?s)```ya?ml\s*\n(.*?)```"), 1)), -1)
    entry = "struct<term_id:string,preferred_form:string,aliases:array<string>,banned_forms:array<string>,definition:string,scope:string,category:string>"
    rows = docs.select("doc_id", F.from_json(_yaml_to_json()(last), f"array<{entry}>").alias("e"))
    return rows.select("doc_id", F.inline("e"))


#: Fields of an exemption, and the only check that has some.
EXEMPTION, EXEMPT_CHECK = "struct<file:string,check:string,cells:array<string>,reason:string>", "G2_overlap"


def exemptions(docs: DataFrame) -> DataFrame:
    """doc_id, file, check, cells, reason, rejected: entries of exemption files (YAML texts). rejected: fields (an entry lacks one), check (another check), else null. A text that cannot be read has no entry."""
    rows = docs.select("doc_id", F.from_json(_yaml_to_json()(F.col("text")), f"struct<exemptions:array<{EXEMPTION}>>").alias("e")).select("doc_id", F.inline("e.exemptions"))
    lack = (F.coalesce("file", F.lit("")) == "") | (F.coalesce("check", F.lit("")) == "") | (F.coalesce("reason", F.lit("")) == "") | (F.coalesce(F.size("cells"), F.lit(0)) <= 0)
    return rows.withColumn("rejected", F.when(lack, "fields").when(F.col("check") != EXEMPT_CHECK, "check"))


_DIMENSION = "struct<id:string,severity:string,what_to_look_for_hint:string,what_triggers_warn_hint:string,what_triggers_block_hint:string>"


def dimensions(docs: DataFrame) -> DataFrame:
    """doc_id, dim_id, severity, look_hint, warn_hint, block_hint, core: the dimensions of contracts (JSON texts), with the additional ones (not core)."""
    data = F.from_json("text", f"struct<dimensions:array<{_DIMENSION}>,proposal_extra:array<{_DIMENSION}>>")
    own = docs.select("doc_id", data.alias("c"))
    part = lambda c, core: own.select("doc_id", F.inline(F.coalesce(c, F.array().cast(f"array<{_DIMENSION}>")))).withColumn("core", F.lit(core))
    both = part(F.col("c.dimensions"), True).unionByName(part(F.col("c.proposal_extra"), False))
    hint = lambda c: F.coalesce(c, F.lit(""))
    return both.select("doc_id", F.col("id").alias("dim_id"), "severity", hint("what_to_look_for_hint").alias("look_hint"), hint("what_triggers_warn_hint").alias("warn_hint"), hint("what_triggers_block_hint").alias("block_hint"), "core")


def batch_grouping(docs: DataFrame) -> DataFrame:
    """doc_id, batch (the digit in its name), dim_id: how contracts (JSON texts) group dimensions into batches."""
    groups = F.from_json("text", "struct<batch_grouping:map<string,array<string>>>")["batch_grouping"]
    rows = docs.select("doc_id", F.explode(groups).alias("name", "dims"))
    return rows.select("doc_id", F.regexp_extract("name", r"(\d+)", 1).cast("int").alias("batch"), F.explode("dims").alias("dim_id"))


def json_constants(docs: DataFrame) -> DataFrame:
    """doc_id, key, value (as text): the fields of JSON objects; a text that is none gives no row."""
    return docs.select("doc_id", F.explode(F.from_json("text", "map<string,string>")).alias("key", "value"))


def layout_modes(docs: DataFrame) -> DataFrame:
    """doc_id, mode: the layout_mode of JSON texts; null where they have none or cannot be read."""
    return docs.select("doc_id", F.try_parse_json("text").cast("string").alias("j")).select("doc_id", F.get_json_object("j", "$.layout_mode").alias("mode"))


def declared_figures(docs: DataFrame) -> DataFrame:
    """doc_id, n: how many architecture figures front matter declares; 0 where it declares none or no number."""
    data = yaml_blocks(docs, "struct<core_architecture_figures:string>")
    return data.select("doc_id", F.coalesce(F.expr("try_cast(trim(data.core_architecture_figures) AS int)"), F.lit(0)).alias("n"))


def whitelisted(terms: DataFrame) -> DataFrame:
    """alias: of a glossary's aliases those in capital letters alone."""
    return terms.select(F.explode("aliases").alias("alias")).where(F.col("alias").rlike("^[A-Z]+$")).distinct()


def png_rgb(content: bytes | None) -> tuple[float | None, bytes | None]:
    """Resolution (dots an inch, of the narrower direction) and RGB bytes of a PNG of eight bits a channel, not interlaced; null for what others hold."""
    if not content or content[:8] != bytes.fromhex(PNG_MAGIC):
        return None, None
    at, head, dpi, table, data = 8, None, None, None, []
    while at + 8 <= len(content):
        n, kind = int.from_bytes(content[at : at + 4], "big"), content[at + 4 : at + 8]
        body = content[at + 8 : at + 8 + n]
        at += 12 + n
        if kind == b"IHDR":
            head = body
        elif kind == b"pHYs" and len(body) == 9 and body[8] == 1:
            dpi = min(int.from_bytes(body[:4], "big"), int.from_bytes(body[4:8], "big")) * 0.0254
        elif kind == b"PLTE":
            table = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            data.append(body)
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(head[9]) if head and len(head) == 13 else None
    if not channels or head[8] != 8 or head[12] or (head[9] == 3 and table is None):
        return dpi, None
    width, height = int.from_bytes(head[:4], "big"), int.from_bytes(head[4:8], "big")
    try:
        raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8)
    except zlib.error:
        return dpi, None
    if len(raw) != height * (width * channels + 1):
        return dpi, None
    rows = raw.reshape(height, -1)
    out, before = np.zeros((height, width, channels), np.uint8), np.zeros((width, channels), np.int64)
    for y in range(height):
        line = rows[y, 1:].reshape(width, channels).astype(np.int64)
        if rows[y, 0] == 1:
            line = np.cumsum(line, 0) & 255
        elif rows[y, 0] == 2:
            line = (line + before) & 255
        elif rows[y, 0] in (3, 4):
            left, corner = np.zeros(channels, np.int64), np.zeros(channels, np.int64)
            for x in range(width):
                up = before[x]
                if rows[y, 0] == 3:
                    guess = (left + up) >> 1
                else:
                    p = left + up - corner
                    a, b, c = abs(p - left), abs(p - up), abs(p - corner)
                    guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
                left, corner = (line[x] + guess) & 255, up
                line[x] = left
        out[y] = before = line
    rgb = table[out[:, :, 0].clip(max=len(table) - 1)] if head[9] == 3 else np.repeat(out[:, :, :1], 3, 2) if channels < 3 else out[:, :, :3]
    return dpi, rgb.tobytes()


def png_pixels(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, dpi, rgb (binary, three bytes a pixel): what figures.off_palette() and the resolution checks read."""

    def read(contents: pa.Array) -> pa.Array:
        got = [png_rgb(x.as_py()) for x in contents]
        return pa.StructArray.from_arrays([pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.binary())], names=["dpi", "rgb"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").load(path)
    rows = files.select(T.file_name(F.col("path")).alias("doc_id"), F.arrow_udf(read, "dpi double, rgb binary")("content").alias("p"))
    return rows.select("doc_id", "p.dpi", "p.rgb")


def encoding_faults(report: DataFrame) -> DataFrame:
    """doc_id, level, fault: findings of an encoding_report(): bytes that are not UTF-8 (FATAL), a byte order mark, CRLF and lone CR line ends (WARNING)."""
    one = lambda level, fault: F.struct(F.lit(level).alias("level"), F.lit(fault).alias("fault"))
    some = F.array(
        F.when(~F.col("valid"), one("FATAL", "not_utf8")), F.when(F.col("has_bom"), one("WARNING", "bom")), F.when(F.col("crlf") > 0, one("WARNING", "crlf")), F.when(F.col("lone_cr") > 0, one("WARNING", "lone_cr")),
    )
    return report.select("doc_id", F.inline(F.array_compact(some)))


def xml_faults(docs: DataFrame) -> DataFrame:
    """doc_id, fault: texts that are no XML, with what the parser says. Entities are not resolved."""

    def parse(texts: pa.Array) -> pa.Array:
        from xml.parsers import expat

        out = []
        for t in texts.to_pylist():
            try:
                expat.ParserCreate().Parse((t or "").encode(), True)
                out.append(None)
            except expat.ExpatError as e:
                out.append(str(e))
        return pa.array(out, pa.string())

    return docs.select("doc_id", F.arrow_udf(parse, "string")("text").alias("fault")).where("fault is not null")


def provenance(spark: SparkSession, path: str) -> DataFrame:
    """run_id, produced_by, merged_file, path: delivered files by run, from a JSONL ledger; malformed lines are skipped."""
    schema = "run_id string, produced_by string, merged_file string, delivery_paths array<string>, pipeline_steps array<string>"
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).where("run_id is not null")
    return rows.select("run_id", "produced_by", "merged_file", F.explode("delivery_paths").alias("path"))
