"""Queries over nested documents and block trees that the given tables make; the SQL beside each query computes the answer from the same tables or texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import delivery, rules, schemas, terms, tree
from ledgerloom.plans.registry import dealt, query, table

#: An order with its lines.
ORDER = {
    "type": "object", "required": ["order", "status", "lines"], "additionalProperties": False,
    "properties": {"order": {"type": "integer", "minimum": 1}, "status": {"enum": ["O", "F"]}, "priority": {"type": "string", "pattern": "^[1-4]-[A-Z]+$"}, "lines": {"type": "array", "minItems": 1, "items": {"$ref": "#/$defs/line"}}},
    "$defs": {
        "line": {
            "type": "object", "required": ["no"], "additionalProperties": False, "if": {"properties": {"flag": {"const": "R"}}, "required": ["flag"]}, "then": {"required": ["reason"]},
            "properties": {"no": {"type": "integer", "maximum": 6}, "part": {"type": "integer"}, "quantity": {"type": "number", "exclusiveMaximum": 49}, "flag": {"type": "string"}, "reason": {"type": ["string", "null"]}},
        }
    },
}


@query(
    r"""
WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS i FROM lineitem SEMI JOIN orders ON o_orderkey = l_orderkey)
SELECT o_orderkey AS doc_id, 'order' AS path, o_orderkey || ' is less than the minimum of 1' AS message, 'minimum' AS keyword FROM orders WHERE o_orderkey < 1
UNION ALL SELECT o_orderkey, 'status', '''' || o_orderstatus || ''' is not one of [''O'', ''F'']', 'enum' FROM orders WHERE o_orderstatus NOT IN ('O', 'F')
UNION ALL SELECT o_orderkey, 'priority', '''' || o_orderpriority || ''' does not match ''^[1-4]-[A-Z]+$''', 'pattern' FROM orders WHERE NOT regexp_matches(o_orderpriority, '^[1-4]-[A-Z]+$')
UNION ALL SELECT o_orderkey, 'lines', '[] should be non-empty', 'minItems' FROM orders ANTI JOIN lineitem ON o_orderkey = l_orderkey
UNION ALL SELECT l_orderkey, 'lines.' || i || '.no', l_linenumber || ' is greater than the maximum of 6', 'maximum' FROM l WHERE l_linenumber > 6
UNION ALL SELECT l_orderkey, 'lines.' || i || '.quantity', l_quantity::BIGINT || ' is greater than or equal to the maximum of 49', 'exclusiveMaximum' FROM l WHERE l_quantity >= 49
UNION ALL SELECT l_orderkey, 'lines.' || i, '''reason'' is a required property', 'required' FROM l WHERE l_returnflag = 'R' AND l_discount < 0.05
UNION ALL SELECT l_orderkey, 'lines.' || i, 'Additional properties are not allowed (''note'' was unexpected)', 'additionalProperties' FROM l WHERE l_tax > 0.07
"""
)
def order_schema_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of orders as nested documents, lines in the order of their numbers."""
    lines = table(spark, sf_dir, "lineitem")
    line = F.struct(F.col("l_linenumber").alias("no"), F.col("l_partkey").alias("part"), F.col("l_quantity").cast("long").alias("quantity"), F.col("l_returnflag").alias("flag"), F.when(F.col("l_discount") >= 0.05, "sale").alias("reason"), F.when(F.col("l_tax") > 0.07, "taxed").alias("note"))
    keyed = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", line.alias("line")))).alias("all"))
    orders = table(spark, sf_dir, "orders").join(keyed, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    text = F.to_json(F.struct(F.col("o_orderkey").alias("order"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.coalesce(F.col("all.line"), F.array()).alias("lines")))
    return schemas.schema_faults(orders.select(F.col("o_orderkey").alias("doc_id"), text.alias("text")), ORDER)


#: An event; its properties are a JSON text of their own.
EVENT = {
    "type": "object", "required": ["id", "type", "value", "props"],
    "properties": {"id": {"type": "integer"}, "type": {"type": "string", "not": {"const": "error"}}, "value": {"type": "number", "maximum": 100}, "props": {"type": "object", "minProperties": 1, "propertyNames": {"enum": ["k"]}, "additionalProperties": {"type": "integer", "maximum": 89, "anyOf": [{"minimum": 5}, {"multipleOf": 2}]}}},
}


@query(
    r"""
WITH e AS (SELECT event_id, event_type, value, (props->>'$.k')::BIGINT AS k FROM events)
SELECT event_id AS doc_id, 'props.k' AS path, k || ' is greater than the maximum of 89' AS message, 'maximum' AS keyword FROM e WHERE k > 89
UNION ALL SELECT event_id, 'props.k', k || ' is not valid under any of the given schemas', 'anyOf' FROM e WHERE k < 5 AND k % 2 = 1
UNION ALL SELECT event_id, 'type', '''error'' should not be valid under {''const'': ''error''}', 'not' FROM e WHERE event_type = 'error'
UNION ALL SELECT event_id, 'value', round(value)::BIGINT || ' is greater than the maximum of 100', 'maximum' FROM e WHERE round(value) > 100
"""
)
def event_schema_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of events, with the JSON of their properties put in as it is."""
    text = F.concat(F.lit('{"id":'), F.col("event_id"), F.lit(',"type":'), F.to_json(F.array("event_type")), F.lit(',"value":'), F.round("value").cast("long"), F.lit(',"props":'), F.col("props"), F.lit("}"))
    text = F.replace(F.replace(text, F.lit('"type":["'), F.lit('"type":"')), F.lit('"],"value"'), F.lit('","value"'))
    return schemas.schema_faults(table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), text.alias("text")), EVENT)


#: A conversation: it begins with a system's or a user's turn, and no turn is too long.
CONVERSATION = {
    "type": "object", "required": ["turns"],
    "properties": {"turns": {"type": "array", "maxItems": 6, "prefixItems": [{"properties": {"role": {"enum": ["system", "user"]}}}], "items": {"properties": {"role": {"const": "assistant"}}}, "allOf": [{"items": {"required": ["role", "text"], "properties": {"text": {"type": "string", "minLength": 30, "maxLength": 1000}}}}]}},
}


@query(
    r"""
WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations WHERE conv_id IS NOT NULL),
f AS (SELECT conv_id, (CASE WHEN i = 0 THEN role IS NOT NULL AND role NOT IN ('system', 'user') ELSE role IS NOT NULL AND role <> 'assistant' END)::INT + (role IS NULL)::INT + (text IS NULL)::INT
  + coalesce((length(text) < 30 OR length(text) > 1000)::INT, 0) + (i = 0 AND n > 6)::INT AS n FROM t)
SELECT conv_id AS doc_id, sum(n) = 0 AS valid, sum(n)::BIGINT AS error_count FROM f GROUP BY conv_id
"""
)
def conversation_schema_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of conversations as documents of turns."""
    turns = table(spark, sf_dir, "conversations").where("conv_id IS NOT NULL").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    docs = turns.select(F.col("conv_id").alias("doc_id"), F.to_json(F.struct(F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))).alias("text"))
    return schemas.schema_verdicts(docs, CONVERSATION).select("doc_id", "valid", "error_count")


#: A document of each order, a block of each of its lines; SQL that Spark and DuckDB both read. Its columns: n, p, s, q (numbers), f (a letter).
_PIECE = """CASE p % 9 WHEN 0 THEN concat('## 第', n, '章 P', p) WHEN 1 THEN concat('![图', q % 4 + 1, '-', s % 3 + 1, ' t', p, '](figures/f', p % 50, '.png)')
WHEN 2 THEN concat('**表', q % 4 + 1, '-', s % 3 + 1, ' c', p, '**', chr(10), chr(10), '| a | ', p, ' |', chr(10), '|---|---|', chr(10), '| 1 | 2 |', chr(10), chr(10), '*来源：s', s, '*')
WHEN 3 THEN concat('见图', q % 4 + 1, '-', s % 3 + 1, '与表', n % 4 + 1, '-', p % 3 + 1, '。') WHEN 4 THEN concat('- one 机密', chr(10), '  - two 表', q % 4 + 1, '-', s % 3 + 1, chr(10), '    1. three', chr(10), '  - four', chr(10), '1. five')
WHEN 5 THEN concat('> 如上图', chr(10), '>> deep ', s, chr(10), '> 以下表') WHEN 6 THEN concat('## 附录 ', f, ' x', p) WHEN 7 THEN concat('图', q % 4 + 1, '-', s % 3 + 1, '：line ', p)
ELSE concat('### H', p, chr(10), 'para ', s, chr(10), 'more', chr(10), '```', chr(10), '# code', chr(10), '```') END"""
_PIECE = f"concat({_PIECE}, CASE WHEN s % 2 = 0 THEN chr(10) ELSE '' END)"
_HEAD = "concat('# T', k, CASE WHEN k % 3 = 0 THEN concat(chr(10), '**页眉简称**：K', k) ELSE '' END)"


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS k", "l_linenumber AS n", "l_partkey AS p", "l_suppkey AS s", "int(l_quantity) AS q", "l_returnflag AS f", "l_extendedprice AS x")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_ = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "p", "s", "q", "x", F.expr(_PIECE).alias("t")))), lambda t: t["t"]), "\n")
    return _parts(spark, sf_dir).groupBy("k").agg(all_.alias("t")).select(F.col("k").alias("doc_id"), F.concat(F.expr(_HEAD), F.lit("\n"), "t").alias("text"))


_DOCUMENTS = f"""
t AS (SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS p, l_suppkey AS s, l_quantity::INTEGER AS q, l_returnflag AS f, l_extendedprice AS x FROM lineitem),
d AS (SELECT k AS doc_id, concat({_HEAD}, chr(10), string_agg({_PIECE}, chr(10) ORDER BY n, p, s, q, x)) AS text FROM t GROUP BY k)"""
_LINES = r"""
l0 AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1)::INTEGER AS line_no FROM d),
l1 AS (SELECT *, trim(text) AS s, sum(starts_with(trim(text), '```')::INT) OVER w AS seen FROM l0 WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
l2 AS (SELECT *, CASE WHEN seen % 2 = 1 OR starts_with(s, '```') THEN 'fence' WHEN s = '' THEN NULL WHEN regexp_matches(text, '^#{1,6}\s+\S') THEN 'heading' WHEN regexp_matches(s, '^!\[[^\]]*\]\([^)]*\)$') THEN 'figure'
  WHEN starts_with(s, '|') THEN 'table' WHEN regexp_matches(s, '^[-*+]\s+\S') THEN 'list' WHEN regexp_matches(s, '^\d+[.)]\s+\S') THEN 'ordered' WHEN starts_with(s, '>') THEN 'quote' ELSE 'paragraph' END AS kind0 FROM l1),
l3 AS (SELECT *, first_value(kind0 IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS ahead, last_value(kind0 IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS back FROM l2),
l4 AS (SELECT doc_id, line_no, text, s, seen, CASE WHEN kind0 = 'paragraph' AND ahead = 'table' AND starts_with(s, '**表') THEN 'caption' WHEN kind0 = 'paragraph' AND back = 'table' AND starts_with(s, '*来源') THEN 'source' ELSE kind0 END AS kind,
  CASE kind0 WHEN 'heading' THEN length(regexp_extract(s, '^#+')) WHEN 'quote' THEN length(regexp_extract(s, '^>+')) WHEN 'list' THEN length(text) - length(ltrim(text)) WHEN 'ordered' THEN length(text) - length(ltrim(text)) ELSE 0 END::INTEGER AS level FROM l3),
l5 AS (SELECT *, CASE WHEN kind = 'ordered' THEN 'list' ELSE kind END AS sort FROM l4),
l6 AS (SELECT *, sort IS DISTINCT FROM lag(sort) OVER w OR kind IN ('heading', 'figure', 'caption', 'source') OR (starts_with(s, '```') AND seen % 2 = 1) AS first, kind = 'quote' AND lag(level) OVER w IS DISTINCT FROM level AS deeper FROM l5 WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
l7 AS (SELECT *, max(CASE WHEN first THEN line_no END) OVER w AS run, max(CASE WHEN first OR deeper THEN line_no END) OVER w AS block, max(CASE WHEN kind = 'heading' THEN line_no END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS heading FROM l6 WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
l AS (SELECT *, CASE kind WHEN 'heading' THEN trim(ltrim(s, '#')) WHEN 'quote' THEN trim(ltrim(s, '> ')) WHEN 'list' THEN s[3:] WHEN 'ordered' THEN s[4:] WHEN 'fence' THEN text ELSE s END AS bare FROM l7 WHERE kind IS NOT NULL),
b AS (SELECT doc_id, block AS line, any_value(kind) AS kind, min(level) AS level, min(run) AS run, min(heading) AS heading, max(line_no) AS last, string_agg(bare, chr(10) ORDER BY line_no) AS text FROM l GROUP BY doc_id, block),
i0 AS (SELECT doc_id, run, line_no AS line, kind, level, heading, bare, (SELECT max(o.line_no) FROM l o WHERE o.doc_id = l.doc_id AND o.run = l.run AND o.line_no < l.line_no AND o.level < l.level) AS above FROM l WHERE kind IN ('list', 'ordered')),
i1 AS (SELECT *, above IS NULL AND kind IS DISTINCT FROM last_value(CASE WHEN above IS NULL THEN kind END IGNORE NULLS) OVER (PARTITION BY doc_id, run ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS begins FROM i0),
i AS (SELECT *, max(CASE WHEN begins THEN line END) OVER (PARTITION BY doc_id, run ORDER BY line) AS of FROM i1),
tree AS (
SELECT doc_id, line * 2 AS node, heading * 2 AS parent, kind, level, line AS first_line, last AS last_line, CASE WHEN kind <> 'table' THEN text END AS text FROM b WHERE kind IN ('paragraph', 'figure', 'fence', 'table')
UNION ALL SELECT doc_id, line * 2, 2 * (SELECT max(o.line) FROM b o WHERE o.doc_id = b.doc_id AND o.kind = 'heading' AND o.line < b.line AND o.level < b.level), kind, level, line, last, text FROM b WHERE kind = 'heading'
UNION ALL SELECT doc_id, line * 2, 2 * coalesce((SELECT max(o.line) FROM b o WHERE o.doc_id = b.doc_id AND o.run = b.run AND o.line < b.line AND o.level < b.level), heading), kind, level, line, last, text FROM b WHERE kind = 'quote'
UNION ALL SELECT doc_id, line_no * 2 + 1, block * 2, 'row', 0, line_no, line_no, bare FROM l WHERE kind = 'table' AND NOT regexp_matches(s, '^\|[\s:\-|]+\|$')
UNION ALL SELECT doc_id, line * 2 + 1, 2 * (SELECT min(o.line) FROM b o WHERE o.doc_id = b.doc_id AND o.kind = 'table' AND o.line > b.line), kind, 0, line, line, text FROM b WHERE kind = 'caption'
UNION ALL SELECT doc_id, line * 2 + 1, 2 * (SELECT max(o.line) FROM b o WHERE o.doc_id = b.doc_id AND o.kind = 'table' AND o.line < b.line), kind, 0, line, line, text FROM b WHERE kind = 'source'
UNION ALL SELECT doc_id, of * 2, min(heading) * 2, arg_min(kind, line), arg_min(level, line), of, max(line), NULL FROM i GROUP BY doc_id, of
UNION ALL SELECT doc_id, line * 2 + 1, CASE WHEN above IS NULL THEN of * 2 ELSE above * 2 + 1 END, CASE kind WHEN 'list' THEN 'item' ELSE 'ordered_item' END, level, line, line, bare FROM i)"""


@query(f"WITH {_DOCUMENTS}, {_LINES} SELECT doc_id, node::BIGINT AS node, parent::BIGINT AS parent, kind, level, first_line, last_line, text FROM tree")
def block_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree of typed blocks of each order's document."""
    return tree.blocks(_documents(spark, sf_dir))


@query(
    f"WITH {_DOCUMENTS}, {_LINES}" + r""",
h AS (SELECT *, CASE WHEN kind = 'heading' AND level = 2 AND NOT starts_with(text, '附录') THEN nullif(regexp_extract(text, '^第(\d+)章', 1), '')::INTEGER END AS own, kind = 'heading' AND level = 2 AND starts_with(text, '附录') AS app FROM tree),
c AS (SELECT *, last_value(own IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY node) AS chapter, bool_or(app) OVER (PARTITION BY doc_id ORDER BY node) AS appendix FROM h),
e0 AS (SELECT doc_id, first_line, chapter, '图' AS kind, regexp_extract(text, '图(\d+)-(\d+)', 1)::INTEGER AS x, regexp_extract(text, '图(\d+)-(\d+)', 2)::INTEGER AS y FROM c WHERE kind = 'figure'
  UNION ALL SELECT c.doc_id, c.first_line, c.chapter, '表', regexp_extract(k.text, '表(\d+)-(\d+)', 1)::INTEGER, regexp_extract(k.text, '表(\d+)-(\d+)', 2)::INTEGER FROM c JOIN tree k ON k.doc_id = c.doc_id AND k.parent = c.node AND k.kind = 'caption'),
e AS (SELECT *, kind || x || '-' || y AS element, row_number() OVER (PARTITION BY doc_id, kind, x ORDER BY y, first_line) AS place, row_number() OVER (PARTITION BY doc_id, kind, x, y ORDER BY first_line) AS nth FROM e0),
g AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY first_line) AS place, row_number() OVER (PARTITION BY doc_id, own ORDER BY first_line) AS nth FROM c WHERE own IS NOT NULL),
a AS (SELECT *, ascii(text[4:4]) - 64 AS letter, row_number() OVER (PARTITION BY doc_id ORDER BY first_line) AS place, row_number() OVER (PARTITION BY doc_id, text[4:4] ORDER BY first_line) AS nth FROM c WHERE app),
m AS (SELECT doc_id, first_line, unnest(regexp_extract_all(text, '[图表]\d+-\d+')) AS element FROM c WHERE kind IN ('paragraph', 'item', 'ordered_item', 'quote') AND NOT appendix),
n AS (SELECT doc_id, element, min(first_line) AS said FROM m GROUP BY doc_id, element),
u AS (SELECT doc_id, element, min(first_line) AS first_line FROM e GROUP BY doc_id, element),
o AS (SELECT *, lag(kind) OVER w AS back, lead(kind) OVER w AS ahead FROM c WHERE kind NOT IN ('row', 'item', 'ordered_item', 'caption', 'source') WINDOW w AS (PARTITION BY doc_id ORDER BY node))
SELECT doc_id, 'E-IMG-01' AS code, first_line AS line_no, regexp_extract(text, '\((.*)\)', 1) AS element, 'no file' AS detail FROM c WHERE kind = 'figure' AND regexp_extract(text, 'f(\d+)\.png', 1)::INTEGER % 5 = 0
UNION ALL SELECT doc_id, CASE kind WHEN '图' THEN 'W-IMG-06' ELSE 'W-TBL-02' END, first_line, element, 'expected ' || place FROM e WHERE y <> place
UNION ALL SELECT doc_id, CASE kind WHEN '图' THEN 'W-IMG-05' ELSE 'W-TBL-02' END, first_line, element, 'again' FROM e WHERE nth > 1
UNION ALL SELECT doc_id, CASE kind WHEN '图' THEN 'W-IMG-04' ELSE 'W-TBL-02' END, first_line, element, 'in chapter ' || chapter FROM e WHERE chapter <> x
UNION ALL SELECT doc_id, 'W-HDR-01', first_line, text, 'expected ' || place FROM g WHERE own <> place UNION ALL SELECT doc_id, 'W-HDR-01', first_line, text, 'again' FROM g WHERE nth > 1
UNION ALL SELECT doc_id, 'W-HDR-02', first_line, text, 'expected ' || place FROM a WHERE letter <> place UNION ALL SELECT doc_id, 'W-HDR-02', first_line, text, 'again' FROM a WHERE nth > 1
UNION ALL SELECT u.doc_id, CASE WHEN said IS NULL THEN 'W-REF-01' ELSE 'W-REF-02' END, first_line, element, CASE WHEN said IS NULL THEN 'never mentioned' ELSE 'first mentioned in line ' || said END FROM u LEFT JOIN n USING (doc_id, element) WHERE said IS NULL OR said > first_line
UNION ALL SELECT doc_id, 'W-REF-03', first_line, element, 'not there' FROM m ANTI JOIN u USING (doc_id, element)
UNION ALL SELECT doc_id, 'W-REF-03', first_line, text, 'no figure next to it' FROM o WHERE kind = 'paragraph' AND NOT appendix AND regexp_full_match(text, '图\d{1,2}-\d{1,2}[：:].{0,80}') AND coalesce(back, '') <> 'figure' AND coalesce(ahead, '') <> 'figure'
UNION ALL SELECT doc_id, 'W-REF-04', first_line, '上图', 'points by place' FROM (SELECT doc_id, first_line, unnest(regexp_extract_all(text, '如上图')) FROM c WHERE kind = 'quote' AND NOT appendix)
UNION ALL SELECT doc_id, 'W-CLN-01', first_line, '机密', 'mark of secrecy' FROM c WHERE kind = 'item' AND contains(text, '机密')
UNION ALL SELECT doc_id, 'W-TTL-01', NULL, '页眉简称', 'not given' FROM d WHERE NOT contains(text, '页眉简称')
"""
)
def document_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All checks of whole documents; the files of every fifth figure are missing."""
    # a path lies within one block, so the files are told by the blocks and no document is put together for them
    blocks = _parts(spark, sf_dir).select(F.col("k").alias("doc_id"), F.expr(_PIECE).alias("text"))
    figures = blocks.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"figures/f\d+\.png"), 0)).alias("path"))
    return tree.checked(_documents(spark, sf_dir), figures.where(F.regexp_extract("path", r"(\d+)\.png", 1).cast("int") % 5 != 0))


#: Forms from the first turns of every tenth conversation, each with a sign too many in its middle.
_FORM = "concat(substr(text, 4, 7), '#', substr(text, 11, 7 + conv_id % 9))"


@query(
    rf"""
WITH body AS (SELECT conv_id || '-' || turn AS doc_id, trim(regexp_replace(min(text), '\s+', ' ', 'g')) AS body FROM conversations GROUP BY conv_id, turn),
form AS (SELECT conv_id AS term_id, min(trim({_FORM})) AS form FROM conversations WHERE turn = 0 AND conv_id % 10 = 0 GROUP BY conv_id),
gram AS (SELECT term_id, form, length(form) AS long, list_distinct(list_transform(range(1, length(form) - 1), lambda i: substr(form, i, 3))) AS grams FROM form WHERE length(form) >= {terms.LONG}),
pair AS (SELECT doc_id, term_id, body, long, length(body) AS n, grams FROM body, gram WHERE len(list_filter(grams, lambda g: contains(body, g))) / len(grams) >= {terms.LEAST}),
size AS (SELECT *, unnest(range(greatest(3, long // 2), least(n, 2 * long) + 1, 3)) AS size FROM pair),
win AS (SELECT *, unnest(range(0, n - size + 1, size // 3)) AS start FROM size),
share AS (SELECT doc_id, term_id, size, start, substr(body, start + 1, size) AS near, len(list_filter(grams, lambda g: contains(substr(body, start + 1, size), g))) / len(grams) AS share FROM win),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, term_id ORDER BY (share > {terms.SURE})::INT DESC, CASE WHEN share > {terms.SURE} THEN 0 ELSE -share END, size, start) AS nth FROM share WHERE share >= {terms.LEAST})
SELECT doc_id, term_id, near, share FROM best WHERE nth = 1
"""
)
def near_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windows of turns that come near to forms taken from some of them."""
    turns = table(spark, sf_dir, "conversations")
    each = turns.groupBy("conv_id", "turn").agg(F.min("text").alias("text")).select(F.concat("conv_id", F.lit("-"), "turn").alias("doc_id"), "text")
    forms = turns.where("turn = 0 AND conv_id % 10 = 0").groupBy(F.col("conv_id").alias("term_id")).agg(F.expr(f"min(trim({_FORM}))").alias("preferred_form"))
    return terms.near_terms(each, forms)


#: Rules for parts, the first that fits counts.
_RULES = [(1, r"brand#1\d .*promo", "a"), (2, "blue widget", "b"), (3, "large ", "c"), (4, r"^cold (rod|bolt)", "d"), (5, "e", "e5"), (6, "ECONOMY", "f"), (9, "widget", "g")]


@query(
    "WITH v AS (SELECT p_partkey AS id, p_name || ' ' || p_brand || ' ' || p_type AS value FROM part) SELECT id, value, CASE "
    + " ".join(f"WHEN regexp_matches(value, '(?i){p}') THEN '{r}'" for _, p, r in _RULES)
    + " ELSE 'none' END AS rule FROM v"
)
def rule_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rule that each part's name, brand and type meet."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("value"))
    return rules.first_match(parts, spark.createDataFrame(_RULES, "place long, pattern string, rule string"), "id", "value", "none")


_META = """concat('# Report of ', o_orderpriority, ' order ', o_orderkey, chr(10), chr(10), CASE WHEN o_orderkey % 3 = 0 THEN concat('**副标题**：', o_orderpriority, chr(10)) ELSE '' END, CASE WHEN o_orderkey % 5 < 2 THEN concat('**版本**：V1.', o_orderkey % 7, CASE WHEN o_orderkey % 5 = 0 THEN ' | 2024年' ELSE '' END, chr(10)) ELSE '' END,
CASE WHEN o_orderkey % 4 = 0 THEN 'body' ELSE '' END, chr(10), '**编制机构**：C', o_custkey, chr(10), '**编制机构**：D', o_custkey % 9)"""


@query(
    rf"""
WITH d AS (SELECT *, string_split({_META}, chr(10)) AS l FROM orders), u AS (SELECT o_orderkey, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM d),
w AS (SELECT *, min(CASE WHEN i > 1 AND line <> '' AND NOT starts_with(line, '**') THEN i END) OVER (PARTITION BY o_orderkey) AS stop FROM u),
m AS (SELECT o_orderkey, regexp_extract(line, '^\*\*([^*]+)\*\*：(.*)$', 1) AS name, arg_max(regexp_extract(line, '^\*\*([^*]+)\*\*：(.*)$', 2), i) AS value FROM w WHERE i > 1 AND starts_with(line, '**') AND i < coalesce(stop, 1000) GROUP BY ALL),
n AS (SELECT o_orderkey, max(value) FILTER (name = '副标题') AS subtitle, max(value) FILTER (name = '版本') AS version, max(value) FILTER (name = '编制机构') AS organization FROM m GROUP BY o_orderkey),
v AS (SELECT orders.*, subtitle, organization, coalesce(version, CASE WHEN o_orderstatus = 'O' THEN 'V9' END) AS version FROM orders LEFT JOIN n USING (o_orderkey))
SELECT o_orderkey AS doc_id, 'Report of ' || o_orderpriority || ' order ' || o_orderkey AS title, substr('Report of ' || o_orderpriority || ' order ' || o_orderkey, 1, 40) AS title_short, coalesce(subtitle, CASE WHEN o_orderstatus = 'F' THEN 'cli' WHEN o_orderkey % 2 = 0 THEN 'yaml' END) AS subtitle,
o_orderstatus AS report_type, organization, regexp_extract(version, '^[^ |]+') AS version, nullif(regexp_extract(version, '\| (.*)$', 1), '') AS date FROM v
"""
)
def metadata_by_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata of reports: their own lines before options, options before defaults."""
    orders = dealt(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_custkey", "o_orderstatus"), "o_orderkey")
    given = orders.select(F.col("o_orderkey").alias("doc_id"), F.inline(F.array_compact(F.array(*[F.when(F.expr(c), F.struct(F.lit(n).alias("name"), F.expr(v).alias("value"), F.lit(o).alias("origin"))) for c, n, v, o in (
        ("o_orderstatus = 'F'", "subtitle", "'cli'", "cli"), ("o_orderkey % 2 = 0", "subtitle", "'yaml'", "yaml"), ("true", "report_type", "o_orderstatus", "yaml"), ("o_orderstatus = 'O'", "version", "'V9'", "cli"), ("true", "organization", "'other'", "nobody"), ("true", "organization", "' '", "cli"),
    )]))))
    return rules.metadata(orders.select(F.col("o_orderkey").alias("doc_id"), F.expr(_META).alias("text")), given)


#: A delivery of each order: what its lines cite, leave and mark, and a bibliography of some of them.
_CITED = """CASE p % 8 WHEN 0 THEN concat('as [', n, ', ', s % 4 + 1, '] shows') WHEN 1 THEN concat('see [0', n, ']') WHEN 2 THEN concat('left [SRC-', p, ']') WHEN 3 THEN '> [红队 R1 seen]' WHEN 4 THEN '### 写作者自声明' WHEN 5 THEN concat('old [S', p % 90 + 10, ']') WHEN 6 THEN 'closed loop' ELSE 'plain words' END"""
_ENTRIES = """concat('[', n, '] source ', s)"""


@query(
    rf"""
WITH t AS (SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS p, l_suppkey AS s FROM lineitem),
d AS (SELECT k, concat('# T', chr(10), string_agg({_CITED}, chr(10) ORDER BY n, p, s), CASE WHEN k % 3 > 0 THEN concat(chr(10), '## 参考文献', chr(10), string_agg({_ENTRIES}, chr(10) ORDER BY n, p, s)) ELSE '' END) AS text FROM t GROUP BY k),
h AS (SELECT k, text, string_split(text, '## 参考文献') AS halves FROM d),
c AS (SELECT k, text, len(halves) > 1 AS has, list_distinct(list_transform(flatten(list_transform(regexp_extract_all(halves[1], '\[\d+(, \d+)*\]'), lambda b: regexp_extract_all(b, '\d+'))), lambda x: x::INTEGER)) AS cited,
  list_transform(regexp_extract_all(coalesce(halves[2], ''), '\[(\d+)\]', 1), lambda x: x::INTEGER) AS entries FROM h),
s AS (SELECT k, contains(text, '[SRC-') AS src, regexp_matches(text, '\[S\d+\]') AS old, contains(text, '自声明') AS self, contains(text, '> [红队') AS red, contains(text, 'closed loop') AS term,
  CASE WHEN NOT has THEN len(cited) > 0 ELSE len(list_distinct(entries)) < len(entries) OR len(list_filter(cited, lambda x: NOT list_contains(entries, x))) > 0 OR len(list_filter(entries, lambda x: NOT list_contains(cited, x))) > 0 END AS refs FROM c)
SELECT k AS doc_id, item, CASE WHEN item IN ('11', '12') THEN 'manual_required' WHEN (item = '01' AND term) OR (item = '02' AND old) OR (item = '03' AND src) OR (item = '03b' AND refs) OR (item = '04' AND k % 7 = 0) OR (item = '06' AND self) OR (item = '07' AND red)
  OR (item = '13' AND (SELECT count(*) > 0 FROM events WHERE event_type = 'error')) THEN 'fail' ELSE 'pass' END AS status
FROM s, (SELECT unnest({list(delivery.ITEMS)}) AS item)
"""
)
def delivery_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All items of each delivery; the gate fails every seventh, and the ledger is open where an error is."""
    lines = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS k", "l_linenumber AS n", "l_partkey AS p", "l_suppkey AS s")
    all_ = lines.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("n", "p", "s", F.expr(_CITED).alias("t"), F.expr(_ENTRIES).alias("e")))).alias("all"))
    joined = lambda c: F.array_join(F.transform("all", lambda x: x[c]), "\n")
    docs = all_.select(F.col("k").alias("doc_id"), F.concat(F.lit("# T\n"), joined("t"), F.when(F.col("k") % 3 > 0, F.concat(F.lit("\n## 参考文献\n"), joined("e"))).otherwise("")).alias("text"))
    glossary = spark.createDataFrame([("T1", ["closed loop"])], "term_id string, banned_forms array<string>")
    ledger = table(spark, sf_dir, "events").agg((F.count_if(F.col("event_type") == "error") > 0).alias("blocking"))
    return delivery.checklist(docs, glossary, None, docs.select("doc_id", (F.col("doc_id") % 7 != 0).alias("passed")), ledger)
