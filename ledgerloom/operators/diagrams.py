"""Checks of diagrams: geometry, overlaps, topology and labels. Cells come as readers.diagram_cells gives them, as text.

Every table is keyed by (doc_id, id), so a folder of diagrams is checked at once. Null or empty cells give no finding but
those that the rules name; repeated ids are the caller's to mend.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as t

from ledgerloom.functions import text as T
from ledgerloom.operators import references as R

#: What broken exports write for a number; styles that make a cell a container; ids of captions; words of another notation.
BAD_LITERALS = ["None", "nan", "NaN", "null", "NULL", "undefined", ""]
CONTAINER = "swimlane|group|container=1"
CAPTION_IDS = ["title", "note", "caption", "bottomNote"]
MERMAID = ["flowchart", "graph TD", "subgraph", "-->"]
#: Patterns of captions, references to figures and ids of ledgers.
CAPTION = r"^\s*(图\s*\d+\s*[-–—]\s*\d+|图注)"
FIGURE_REF = r"图\s*(\d+\s*[-–—]\s*\d+)"
CANVAS_ID = r"\[(?:SRC|G|T|S|A|C|CM|CO|CASE)-\d+\]"
#: Ink is taken as so much larger than the estimate, and an overlap thinner than this (pixels) is grey.
INFLATE, THICKNESS, LINE_HEIGHT, FONT_SIZE = 1.15, 3, 1.4, 16


def _number(raw: Column) -> Column:
    return F.when(raw.isin(BAD_LITERALS) | raw.rlike("[dDfF]$"), None).otherwise(raw).try_cast("double")


def geometry_faults(cells: DataFrame) -> DataFrame:
    """doc_id, id, attr, literal: vertices without geometry, or with a value that is no number. x and y may be missing, width and height may not."""
    judged = [F.struct(F.lit(a).alias("attr"), F.col(a).alias("literal"), (F.col(a).isNotNull() | F.lit(a in ("width", "height"))).alias("due"), _number(F.col(a)).isNull().alias("bad")) for a in ("x", "y", "width", "height")]
    none = F.array(F.struct(F.lit("mxGeometry").alias("attr"), F.lit(None).cast("string").alias("literal"), F.lit(True).alias("due"), F.lit(True).alias("bad")))
    rows = cells.where("vertex = '1'").select("doc_id", "id", F.explode(F.when(F.col("has_geometry"), F.array(*judged)).otherwise(none)).alias("g"))
    return rows.where("g.due and g.bad").select("doc_id", "id", "g.attr", "g.literal")


@F.pandas_udf(t.ArrayType(t.DoubleType()))
def line_widths(label: pd.Series) -> pd.Series:
    """Width of each line in font sizes: wide characters 1, ambiguous ones 0.85, others 0.55."""
    import unicodedata

    units = {"W": 1.0, "F": 1.0, "A": 0.85}
    return label.map(lambda s: [sum(units.get(unicodedata.east_asian_width(c), 0.55) for c in line) for line in (s or "").split("\n")])


def boxes(cells: DataFrame) -> DataFrame:
    """doc_id, id, x, y, x2, y2 (the cell) and ink_x, ink_y, ink_x2, ink_y2 (its text, or the cell where it has none), of vertices with valid geometry that lie on the canvas: neither labels of edges nor relative ones."""
    style, relative = F.coalesce("style", F.lit("")), F.coalesce("relative", F.lit("0"))
    on = cells.where((F.col("vertex") == "1") & ~style.contains("edgeLabel") & (relative != "1"))
    sound = on.join(geometry_faults(cells).select("doc_id", "id").distinct(), ["doc_id", "id"], "left_anti")
    size = F.regexp_extract(style, r"fontSize=(\d+)", 1)
    rows = sound.select(
        "doc_id", "id", *[F.coalesce(_number(F.col(a)), F.lit(0.0)).alias(a) for a in ("x", "y", "width", "height")], F.trim(T.html_text(F.col("value")), F.lit(" \n\t\r")).alias("label"),
        F.when(size == "", FONT_SIZE).otherwise(size.try_cast("int")).alias("font"), F.regexp_extract(style, r"(?<![a-zA-Z])align=(\w+)", 1).alias("align"),
    ).withColumn("ems", line_widths("label"))
    wide = F.array_max("ems") * F.col("font") * INFLATE
    lines = F.aggregate("ems", F.lit(0.0), lambda n, e: n + F.when(F.col("width") > 0, F.greatest(F.lit(1.0), F.ceil(e * F.col("font") / F.col("width")).cast("double"))).otherwise(1.0))
    has = F.col("label") != ""
    ink_w = F.when(has, F.least("width", wide)).otherwise(F.col("width"))
    ink_h = F.when(has, F.least(F.col("height"), lines * F.col("font") * LINE_HEIGHT * INFLATE)).otherwise(F.col("height"))
    rows = rows.withColumns({"ink_w": ink_w, "ink_h": ink_h})
    left = F.when(F.col("align") == "left", F.col("x")).when(F.col("align") == "right", F.col("x") + F.col("width") - F.col("ink_w")).otherwise(F.col("x") + (F.col("width") - F.col("ink_w")) / 2)
    top = F.col("y") + (F.col("height") - F.col("ink_h")) / 2
    rows = rows.withColumns({"x2": F.col("x") + F.col("width"), "y2": F.col("y") + F.col("height"), "ink_x": left, "ink_y": top})
    return rows.select("doc_id", "id", "x", "y", "x2", "y2", "ink_x", "ink_y", (F.col("ink_x") + F.col("ink_w")).alias("ink_x2"), (F.col("ink_y") + F.col("ink_h")).alias("ink_y2"))


def in_containers(cells: DataFrame) -> DataFrame:
    """doc_id, id: cells that are containers or lie in one, at any depth; their coordinates are not the canvas's."""
    marked = cells.where(F.coalesce("style", F.lit("")).rlike(CONTAINER)).select("doc_id", "id")
    below = R.ancestors(cells).join(marked.withColumnRenamed("id", "ancestor"), ["doc_id", "ancestor"], "left_semi").select("doc_id", "id")
    return marked.unionByName(below).distinct()


def overlaps(found: DataFrame, exempt: DataFrame | None = None, least_tile: float = 64.0, tiles: int = 32) -> DataFrame:
    """doc_id, a, b (a < b), ink_w, ink_h, severity: pairs of boxes that meet. error: their ink meets by THICKNESS or more both ways; else warning.

    Boxes are filed under the tiles that they touch, and joined by tile: no pair of far boxes is made. A pair is reported in
    the tile of its common corner alone. A tile's side is least_tile, or a share (1 of `tiles`) of the diagram's longest box,
    so that a box is filed under (tiles + 2) squared tiles at most. exempt: doc_id, id.
    """
    if exempt is not None:
        found = found.join(exempt.select("doc_id", "id").distinct(), ["doc_id", "id"], "left_anti")
    side = found.groupBy("doc_id").agg(F.greatest(F.lit(least_tile), F.max(F.greatest(F.col("x2") - F.col("x"), F.col("y2") - F.col("y"))) / tiles).alias("side"))
    at = lambda c: F.floor(c / F.col("side"))
    filed = found.join(side, "doc_id").withColumn("tx", F.explode(F.sequence(at(F.col("x")), at(F.col("x2"))))).withColumn("ty", F.explode(F.sequence(at(F.col("y")), at(F.col("y2")))))
    a, b, c = filed.alias("a"), filed.alias("b"), F.col
    corner = (c("a.tx") == F.floor(F.greatest("a.x", "b.x") / c("a.side"))) & (c("a.ty") == F.floor(F.greatest("a.y", "b.y") / c("a.side")))
    meet = (c("a.x") < c("b.x2")) & (c("b.x") < c("a.x2")) & (c("a.y") < c("b.y2")) & (c("b.y") < c("a.y2"))
    same = (c("a.doc_id") == c("b.doc_id")) & (c("a.tx") == c("b.tx")) & (c("a.ty") == c("b.ty")) & (c("a.id") < c("b.id"))
    pairs = a.join(b, same & meet & corner).select(
        "a.doc_id", c("a.id").alias("a"), c("b.id").alias("b"),
        *[(F.least(f"a.ink_{d}2", f"b.ink_{d}2") - F.greatest(f"a.ink_{d}", f"b.ink_{d}")).alias(f"o{d}") for d in "xy"],
    )
    inked = (c("ox") > 0) & (c("oy") > 0)
    return pairs.select("doc_id", "a", "b", F.when(inked, c("ox")).otherwise(0.0).alias("ink_w"), F.when(inked, c("oy")).otherwise(0.0).alias("ink_h"), F.when(inked & (F.least("ox", "oy") >= THICKNESS), "error").otherwise("warning").alias("severity"))


def topology(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices (doc_id, id) and edges (doc_id, source, target) of which both ends are vertices."""
    nodes = cells.where("vertex = '1'").select("doc_id", "id").distinct()
    edges = cells.where("edge = '1' and source <> '' and target <> ''").select("doc_id", "source", "target")
    for end in ("source", "target"):
        edges = edges.join(nodes.withColumnRenamed("id", end), ["doc_id", end], "left_semi")
    return nodes, edges.select("doc_id", "source", "target")


def mode_verdicts(nodes: DataFrame, edges: DataFrame, modes: DataFrame) -> DataFrame:
    """doc_id, mode, n_vertex, n_edge, verdict (null: the edges fit the mode). modes: doc_id, mode.

    flow: no graph that both forks and joins. star: one hub, with at least 3 edges and twice as many as any other node.
    grid, quadrant: no connected part of over a third of the nodes. Set spark.checkpoint.dir: parts are found by iteration.
    """
    key = lambda c: F.struct("doc_id", F.col(c).alias("id"))
    linked = edges.select("doc_id", key("source").alias("source"), key("target").alias("target"))
    degree = R.degrees(linked)
    by_doc = degree.groupBy(F.col("node.doc_id").alias("doc_id"))
    shape = by_doc.agg(F.max("out_degree").alias("most_out"), F.max("in_degree").alias("most_in"), F.max("degree").alias("most"))
    ranked = degree.select(F.col("node.doc_id").alias("doc_id"), "degree").join(shape.select("doc_id", "most"), "doc_id")
    hubs = ranked.groupBy("doc_id").agg(F.count_if(F.col("degree") == F.col("most")).alias("hubs"), F.max(F.when(F.col("degree") < F.col("most"), F.col("degree"))).alias("second"))
    gridded = modes.where(F.col("mode").isin("grid", "quadrant")).select("doc_id")
    parts = R.components(linked.join(gridded, "doc_id", "left_semi").select("source", "target"))
    part = parts.groupBy(F.col("component")).count().groupBy(F.col("component.doc_id").alias("doc_id")).agg(F.max("count").alias("part"))
    sizes = modes.select("doc_id", "mode").join(nodes.groupBy("doc_id").agg(F.count("*").alias("n_vertex")), "doc_id", "left").join(edges.groupBy("doc_id").agg(F.count("*").alias("n_edge")), "doc_id", "left")
    rows = sizes.join(shape, "doc_id", "left").join(hubs, "doc_id", "left").join(part, "doc_id", "left").fillna(0, ["n_vertex", "n_edge", "second", "part"])
    is_mode = lambda *m: F.col("mode").isin(*m)
    verdict = (
        F.when(is_mode("flow") & (F.col("most_out") > 1) & (F.col("most_in") > 1), "FLOW_RECONVERGENT")
        .when(is_mode("star") & (F.col("n_edge") == 0), "STAR_NO_EDGES")
        .when(is_mode("star") & (F.col("hubs") != 1), "STAR_NO_UNIQUE_HUB")
        .when(is_mode("star") & (F.col("most") < F.greatest(F.lit(3), F.col("second") * 2)), "STAR_HUB_NOT_DOMINANT")
        .when(is_mode("grid", "quadrant") & (F.col("part") * 3 > F.col("n_vertex")), F.format_string("GRID_HAS_CONNECTED_STRUCTURE(%d/%d)", "part", "n_vertex"))
        .when(~is_mode("flow", "star", "grid", "quadrant"), F.format_string("UNKNOWN_MODE(%s)", "mode"))
    )
    return rows.select("doc_id", "mode", "n_vertex", "n_edge", verdict.alias("verdict"))


def label_findings(cells: DataFrame) -> DataFrame:
    """doc_id, id, rule, hit: captions drawn into the canvas, words of another notation, the first reference to another figure, and ids of ledgers. One pass, no shuffle.

    A diagram's own figure number leads its doc_id (3-1-name); references to itself are no findings.
    """
    raw, plain = F.coalesce("value", F.lit("")), T.html_text(F.col("value"))
    unescaped = T.unescaped(raw)
    first = F.regexp_extract(plain, FIGURE_REF, 0)
    dashed = lambda c: F.regexp_replace(F.trim(c), r"\s*[-–—]\s*", "-")
    own = F.regexp_extract("doc_id", r"^(\d+-\d+)", 1)
    one = lambda rule, hit: F.struct(F.lit(rule).alias("rule"), hit.alias("hit"))
    some = F.array(
        F.when(F.col("id").isin(CAPTION_IDS) | raw.rlike(CAPTION), one("caption", F.substring(raw, 1, 40))),
        *[F.when(F.contains(unescaped, F.lit(k)), one("notation", F.lit(k))) for k in MERMAID],
        F.when((first != "") & (dashed(F.regexp_extract(plain, FIGURE_REF, 1)) != own), one("figure", first)),
    )
    ids = F.transform(F.regexp_extract_all(plain, F.lit(CANVAS_ID), 0), lambda h: one("ledger", h))
    return cells.select("doc_id", "id", F.inline(F.concat(F.array_compact(some), ids)))
