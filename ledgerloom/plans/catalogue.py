"""The queries by name, and the DuckDB SQL that each is held against.

The driver's tables hold no Markdown, so character classes are parameters (letters instead of CJK), a line stands for a
paragraph, and Markdown is built from rows where a rule needs it, in the same way on both sides. What counts as
significant, acknowledged and so on in the events table is a convention of these queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import text as T
from ledgerloom.operators import audits, contract, diagrams, figures, outlines, overlap
from ledgerloom.operators import lines as L
from ledgerloom.operators import ranks
from ledgerloom.operators import references as R
from ledgerloom.plans import reports, validation
from ledgerloom.plans.registry import ORACLE_SQL, QUERIES, dealt, query, table

__all__ = ["ORACLE_SQL", "QUERIES", "reports", "validation"]
#: A class that Java and RE2 read alike, for the invented prose of the tables.
WORDS = "[a-z]"


_CLEAN = r"regexp_replace(regexp_replace(regexp_replace(text, '\[[^\n]*?\]', '', 'g'), '[#>*`_|]', '', 'g'), '\s+', '', 'g')"
_PAIRS = rf"""
WITH r AS (SELECT doc_id, {_CLEAN} AS c FROM documents), b AS (SELECT item_id, {_CLEAN} AS c FROM benchmark),
rg AS (SELECT doc_id, p, substr(c, p, 12) AS g FROM (SELECT doc_id, c, unnest(range(1, length(c) - 10)) AS p FROM r WHERE length(c) >= 12)),
bg AS (SELECT item_id, p, substr(c, p, 12) AS g FROM (SELECT item_id, c, unnest(range(1, length(c) - 10)) AS p FROM b WHERE length(c) >= 12)),
h AS (SELECT item_id, doc_id, bg.p AS p, rg.p - bg.p AS d FROM rg JOIN bg USING (g)),
i AS (SELECT *, p - row_number() OVER (PARTITION BY item_id, doc_id, d ORDER BY p) AS i FROM h),
run AS (SELECT item_id, doc_id, min(p) AS p, count(*) + 11 AS chars FROM i GROUP BY item_id, doc_id, d, i),
best AS (SELECT item_id, doc_id, max(chars) AS chars, arg_max(p, chars * 1000000 - p) AS p FROM run GROUP BY item_id, doc_id),
f AS (SELECT item_id, doc_id, chars, substr(c, p, chars) AS fragment FROM best JOIN b USING (item_id))
"""
_KIND = """CASE WHEN length(regexp_replace(fragment, '[^A-Za-z]', '', 'g')) / chars > 0.3 THEN 'latin' WHEN length(regexp_replace(fragment, '[^0-9]', '', 'g')) / chars > 0.3 THEN 'digits' END"""


def _overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.longest(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), card_id="item_id", report_id="doc_id")


@query(_PAIRS + f"SELECT item_id, doc_id, chars::BIGINT AS chars, fragment, {_KIND} AS kind FROM f WHERE chars >= 46")
def overlap_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest common run of each benchmark passage and document, of 46 characters or more, and why it may be shared."""
    return _overlaps(spark, sf_dir).where(F.col("chars") >= overlap.HIT_CHARS)


@query(_PAIRS + f"SELECT doc_id, count(*) AS overlaps, count(*) FILTER (chars >= 46) AS hits, count(*) FILTER (chars >= 46 AND {_KIND} IS NULL) AS own_hits, count(*) FILTER (chars >= 46 AND {_KIND} IS NULL) >= 2 AS blocked FROM f GROUP BY doc_id")
def overlap_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.summary(_overlaps(spark, sf_dir), "doc_id")


_LINES = "SELECT doc_id, unnest(range(1, len(l) + 1)) AS line_no, unnest(l) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)"


@query(f"SELECT doc_id, line_no::INTEGER AS line_no, md5(text) AS digest, length(text)::INTEGER AS chars FROM ({_LINES})")
def line_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.lines(table(spark, sf_dir, "documents")).select("doc_id", "line_no", F.md5("text").alias("digest"), F.length("text").alias("chars"))


@query("SELECT doc_id, length(regexp_replace(text, '[^A-Za-z]', '', 'g'))::BIGINT AS latin, length(regexp_replace(text, '[^0-9]', '', 'g'))::BIGINT AS digits, length(regexp_replace(text, '[^一-鿿]', '', 'g'))::BIGINT AS cjk, length(regexp_replace(text, '[^�]', '', 'g')) / length(text) AS noise FROM documents")
def char_class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", T.class_count(t, "[A-Za-z]").alias("latin"), T.class_count(t, "[0-9]").alias("digits"), T.class_count(t, T.CJK).alias("cjk"), T.noise_ratio(t).alias("noise"))


_PARAS = rf"""WITH l AS ({_LINES}), p AS (SELECT doc_id, line_no, trim(text) AS text, length(regexp_replace(trim(text), '[^a-z]', '', 'g')) AS chars FROM l WHERE trim(text) <> '' AND NOT regexp_matches(trim(text), '^(#|>|\||!\[)'))"""


def _line_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line that holds a letter is a paragraph here: the texts have no blank lines."""
    rows = L.lines(table(spark, sf_dir, "documents")).withColumn("text", F.trim("text")).where((F.col("text") != "") & ~F.col("text").rlike(L.NOT_BODY))
    return rows.select("doc_id", F.col("line_no").alias("paragraph"), "text", T.class_count(F.col("text"), WORDS).alias("chars"))


@query(
    _PARAS + """, c AS (SELECT lang, chars, row_number() OVER (PARTITION BY lang ORDER BY chars) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM p JOIN documents USING (doc_id))
SELECT lang, any_value(n) AS count, """ + ", ".join(f"max(chars) FILTER (i = least(n - 1, n * {q} // 100))::BIGINT AS p{q}" for q in (25, 50, 75, 90)) + ", max(chars)::BIGINT AS longest FROM c GROUP BY lang"
)
def paragraph_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return L.paragraph_percentiles(_line_paragraphs(spark, sf_dir).join(docs, "doc_id"), "lang")


@query(
    """WITH p AS (SELECT doc_id, length(regexp_replace(regexp_replace(text, '\\n', '', 'g'), '[^a-z]', '', 'g')) AS chars FROM documents)
SELECT doc_id, 1::BIGINT AS count, round(chars, 1)::DOUBLE AS mean, chars AS p25, chars AS p50, chars AS p75, chars AS p90, (chars > 600)::BIGINT AS over_600, (chars < 150)::BIGINT AS under_150, (chars BETWEEN 150 AND 400)::BIGINT AS ideal_range, chars AS longest FROM p WHERE chars > 0"""
)
def paragraph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    paras = L.paragraphs(table(spark, sf_dir, "documents"), letters=WORDS)
    return L.paragraph_stats(paras)


_POINTS = r"len(regexp_extract_all(text, '\[[0-9]+(?:,\s*[0-9]+)*\]')) + len(regexp_extract_all(regexp_replace(text, '\[[0-9]+(?:,\s*[0-9]+)*\]', '', 'g'), '[0-9]+(?:\.[0-9]+)?%?'))"


@query(
    _PARAS + f""", d AS (SELECT doc_id, sum(chars)::BIGINT AS chars, sum({_POINTS})::BIGINT AS points FROM p GROUP BY doc_id)
SELECT doc_id, chars, points, CASE WHEN points > 0 THEN round(chars / points, 1) END AS chars_per_point, (points = 0 AND chars > 0) OR coalesce(CASE WHEN points > 0 THEN round(chars / points, 1) END > 300, false) AS below FROM d"""
)
def density_below_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.density(_line_paragraphs(spark, sf_dir))


@query(
    _PARAS + f""", q AS (SELECT doc_id, line_no, chars, {_POINTS} AS points FROM p),
r AS (SELECT *, sum((points > 0)::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS run FROM q),
s AS (SELECT *, sum(CASE WHEN points > 0 THEN 0 ELSE chars END) OVER (PARTITION BY doc_id, run ORDER BY line_no) AS running_chars FROM r),
u AS (SELECT *, lag(running_chars, 1, 0) OVER (PARTITION BY doc_id, run ORDER BY line_no) AS before FROM s)
SELECT doc_id, line_no::INTEGER AS paragraph, running_chars::BIGINT AS running_chars FROM u WHERE running_chars >= 500 AND before < 500"""
)
def no_data_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.no_data_runs(L.with_points(_line_paragraphs(spark, sf_dir)))


@query(
    """WITH e AS (SELECT *, event_id - row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS i FROM events)
SELECT event_type, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM e GROUP BY event_type, i HAVING count(*) >= 3"""
)
def consecutive_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.runs_of(table(spark, sf_dir, "events"), "event_type", "event_id", F.lit(True))


@query(
    """WITH o AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 6 THEN 0 WHEN l_linenumber % 4 = 1 THEN 1 WHEN min(l_partkey) % 2 = 0 THEN 2 ELSE 3 END AS level FROM lineitem GROUP BY l_orderkey, l_linenumber),
a AS (SELECT *, sum((level = 1)::INT) OVER w AS n1, sum((level <= 1)::INT) OVER w AS top, sum((level = 0)::INT) OVER w AS n0 FROM o WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber)),
b AS (SELECT *, sum((level = 2)::INT) OVER (PARTITION BY l_orderkey, top ORDER BY l_linenumber) AS n2 FROM a), c AS (SELECT *, sum((level = 3)::INT) OVER (PARTITION BY l_orderkey, top, n2 ORDER BY l_linenumber) AS n3 FROM b)
SELECT l_orderkey, l_linenumber, CASE level WHEN 0 THEN chr(64 + n0::INT) WHEN 1 THEN n1 || '' WHEN 2 THEN n1 || '.' || n2 ELSE n1 || '.' || n2 || '.' || n3 END AS number FROM c"""
)
def hierarchical_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as outlines, their lines as chapters, sections, subsections and an appendix."""
    n = F.col("l_linenumber")
    level = F.when(n == 6, 0).when(n % 4 == 1, 1).when(F.col("part") % 2 == 0, 2).otherwise(3)
    # dealt by order once, for the lines' groups and for the numbers
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").repartition("l_orderkey").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("part"))
    rows = lines.select("l_orderkey", "l_linenumber", level.alias("level"))
    return R.hierarchical_numbers(rows, "l_orderkey", ["l_linenumber"]).select("l_orderkey", "l_linenumber", "number")


@query("SELECT l_orderkey, n::INTEGER AS n, expected::INTEGER AS expected FROM (SELECT l_orderkey, n, row_number() OVER (PARTITION BY l_orderkey ORDER BY n) AS expected FROM (SELECT l_orderkey, l_linenumber + (l_quantity > 40)::INT * 10 AS n FROM lineitem)) WHERE n <> expected")
def sequence_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as numbered figures, of which large ones have a number ten too high."""
    n = F.col("l_linenumber") + F.when(F.col("l_quantity") > 40, 10).otherwise(0)
    return R.sequence_gaps(table(spark, sf_dir, "lineitem").select("l_orderkey", n.cast("int").alias("n")), "l_orderkey", "n")


@query("SELECT user_id, (row_number() OVER (ORDER BY ts, event_id, user_id))::INTEGER AS number FROM (SELECT user_id, min(ts) AS ts, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id)")
def first_appearance_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.numbers_by_first_use(table(spark, sf_dir, "events"), "user_id", "ts", "event_id")


@query("SELECT doc_id, 'left' AS side FROM documents ANTI JOIN labels USING (doc_id) UNION ALL SELECT DISTINCT doc_id, 'right' FROM labels ANTI JOIN documents USING (doc_id)")
def missing_and_orphan_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.difference(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT doc_id, lang, source FROM documents SEMI JOIN labels USING (doc_id)")
def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.known(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "lang", "source")


@query("SELECT d.doc_id, d.source, coalesce(quality, -1) AS quality, l.doc_id IS NULL AS missing FROM documents d LEFT JOIN labels l USING (doc_id)")
def left_with_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = R.matched(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    return j.select("doc_id", "source", F.coalesce("quality", F.lit(-1)).alias("quality"), "missing")


@query("SELECT o_orderkey, o_custkey, last_value(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS last_f FROM orders")
def asof_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's nearest finished order of its customer, up to itself."""
    found = R.nearest_before(table(spark, sf_dir, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey")), "last_f")
    return found.select("o_orderkey", "o_custkey", "last_f")


@query("SELECT a.l_orderkey, a.l_linenumber AS a, b.l_linenumber AS b FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber AND a.l_partkey < b.l_partkey + b.l_quantity AND b.l_partkey < a.l_partkey + a.l_quantity")
def overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order whose intervals (part number, quantity wide) overlap: a theta join within a key, never across all."""
    li = table(spark, sf_dir, "lineitem")
    a, b = li.alias("a"), li.alias("b")
    c = F.col
    on = (c("a.l_orderkey") == c("b.l_orderkey")) & (c("a.l_linenumber") < c("b.l_linenumber")) & (c("a.l_partkey") < c("b.l_partkey") + c("b.l_quantity")) & (c("b.l_partkey") < c("a.l_partkey") + c("a.l_quantity"))
    return a.join(b, on).select("a.l_orderkey", c("a.l_linenumber").alias("a"), c("b.l_linenumber").alias("b"))


#: Terms whose banned forms are looked for: our own, in the invented prose.
TERMS = [("T1", ["the", "tion"]), ("T2", ["ing"]), ("T3", ["que", "de"])]


@query(
    r"""WITH b AS (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '\[([^\]]+)\]\([^\n]*?\)', '\1', 'g'), '`[^`]+`', '', 'g'), '\s+', ' ', 'g')) AS body FROM documents),
t AS (SELECT * FROM (VALUES ('T1', 'the'), ('T1', 'tion'), ('T2', 'ing'), ('T3', 'que'), ('T3', 'de')) v(term_id, form))
SELECT doc_id, term_id, form FROM b JOIN t ON regexp_matches(body, '(^|[^a-zA-Z])' || form || '([^a-zA-Z]|$)')"""
)
def banned_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.banned_forms(table(spark, sf_dir, "documents"), spark.createDataFrame(TERMS, "term_id string, banned_forms array<string>"))


@query(
    """WITH a AS (SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 1 END AS line_no, chr((65 + o_orderkey % 7)::INT) || 'BC' AS acronym, o_orderkey % 5 = 0 AND o_orderkey % 2 = 0 AS explained FROM orders)
SELECT doc_id, acronym, line_no::INTEGER AS line_no, explained FROM a WHERE acronym <> 'DBC'"""
)
def acronym_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An acronym an order, in its first or second line and again in the third, with a bracket, with CJK characters, or both (which explains it)."""
    k, o = F.col("o_orderkey"), table(spark, sf_dir, "orders")
    name = F.concat(F.char(F.lit(65) + k % 7), F.lit("BC"))
    used = F.concat(F.lit("use of "), name, F.when(k % 5 == 0, F.concat(F.lit(" ("), F.when(k % 2 == 0, "方法").otherwise("so"), F.lit(")"))).otherwise(F.when(k % 2 == 0, " 方法").otherwise(" so")))
    text = F.concat(F.when(k % 3 == 0, F.concat(F.lit("no X9 here\n"), used)).otherwise(used), F.lit("\nand "), name, F.lit("/T again（方法）"))
    return R.acronyms(L.lines(o.select(k.alias("doc_id"), text.alias("text"))), ["ID", "DBC"])


@query("SELECT md5(text) AS digest, count(*) AS n FROM documents GROUP BY md5(text) HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.duplicates(table(spark, sf_dir, "documents").select(F.md5("text").alias("digest")), "digest")


_TOKENS = "list_distinct(list_filter(list_transform(regexp_extract_all({0}, '[A-Za-z][A-Za-z0-9_.]*|[0-9]+'), lambda x: lower(x)), lambda x: length(x) >= 2))"


@query(
    _PAIRS + f"""SELECT item_id, doc_id, CASE WHEN len(a) = 0 THEN 1.0 ELSE len(list_intersect(a, b)) / len(a) END AS ratio FROM (
SELECT f.item_id, f.doc_id, {_TOKENS.format("b.text")} AS a, {_TOKENS.format("d.text")} AS b FROM f JOIN benchmark b USING (item_id) JOIN documents d USING (doc_id) WHERE chars >= 46)"""
)
def token_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of a passage's vocabulary the documents that overlap with it have."""
    pairs = overlap_hits(spark, sf_dir).select("item_id", "doc_id")
    items = table(spark, sf_dir, "benchmark").select("item_id", T.tokens(F.col("text")).alias("a"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").join(pairs.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", T.tokens(F.col("text")).alias("b"))
    return pairs.join(items, "item_id").join(docs, "doc_id").select("item_id", "doc_id", T.coverage(F.col("a"), F.col("b")).alias("ratio"))


@query(
    """WITH e AS (SELECT user_id, max(ts) AS ts FROM events WHERE event_type = 'error' GROUP BY user_id), a AS (SELECT DISTINCT events.user_id FROM events JOIN e USING (user_id) WHERE event_type = 'click' AND events.ts > e.ts)
SELECT user_id, ts, a.user_id IS NOT NULL AS acknowledged FROM e LEFT JOIN a USING (user_id)"""
)
def ledger_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's latest error is acknowledged by a later click."""
    e = table(spark, sf_dir, "events")
    errors = e.where("event_type = 'error'").select(F.col("user_id").alias("event_id"), "ts", F.lit("significant").alias("level"), F.lit(False).alias("acknowledged"))
    last = errors.groupBy(F.col("event_id").alias("user_id")).agg(F.max("ts").alias("last"))
    acks = e.where("event_type = 'click'").join(last, "user_id").where(F.col("ts") > F.col("last")).select(F.col("user_id").alias("event_id"))
    return R.ledger_state(errors.dropDuplicates(["event_id", "ts"]), acks).select(F.col("event_id").alias("user_id"), "ts", "acknowledged")


@query(
    """WITH f AS (SELECT source, CASE WHEN toxic = 1 THEN 'FATAL' WHEN quality = 0 THEN 'ERROR' ELSE 'INFO' END AS level FROM labels JOIN documents USING (doc_id)),
g AS (SELECT source, count(*) AS n, max(CASE level WHEN 'FATAL' THEN 3 WHEN 'ERROR' THEN 2 ELSE 0 END) AS r FROM f GROUP BY source)
SELECT source, n, CASE r WHEN 3 THEN 'FATAL' WHEN 2 THEN 'ERROR' ELSE 'INFO' END AS worst, (CASE r WHEN 3 THEN 2 WHEN 2 THEN 1 ELSE 0 END)::INTEGER AS exit_code FROM g"""
)
def severity_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.when(F.col("toxic") == 1, "FATAL").when(F.col("quality") == 0, "ERROR").otherwise("INFO")
    found = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id").select("source", level.alias("level"))
    return R.severity_rollup(found, "source", {"FATAL": 3, "ERROR": 2, "WARNING": 1})


@query("SELECT o_custkey::VARCHAR AS chapter, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey HAVING count(*) < 6")
def chapter_claim_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as chapters, orders as claims, of which the finished ones are adopted: chapters below the floor."""
    claims = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("chapter"), F.when(F.col("o_orderstatus") == "F", " True").otherwise("false").alias("adopted"))
    return contract.thin_chapters(claims, 6)


@query(
    """WITH e AS (SELECT DISTINCT 'p' || l_partkey AS s, 's' || l_suppkey AS t FROM lineitem), x AS (SELECT s AS node, 1 AS o, 0 AS i FROM e UNION ALL SELECT t, 0, 1 FROM e)
SELECT node, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree, count(*) AS degree FROM x GROUP BY node"""
)
def degree_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("source"), F.concat(F.lit("s"), "l_suppkey").alias("target")).distinct()
    return R.degrees(edges)


@query(
    """WITH RECURSIVE e AS (SELECT DISTINCT o_custkey AS a, CASE WHEN o_custkey % 5 < 2 THEN o_custkey + 7 ELSE o_custkey END AS b FROM orders), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(a, b) AS (SELECT a, b FROM u UNION SELECT r.a, u.b FROM r JOIN u ON r.b = u.a)
SELECT least(a, min(b)) AS component, a AS node FROM r GROUP BY a"""
)
def component_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers, two of five tied to the one seven further on, the others to themselves: chains, as components by their least node."""
    ranks.shared_folder(spark)
    far = F.when(F.col("o_custkey") % 5 < 2, F.col("o_custkey") + 7).otherwise(F.col("o_custkey"))
    edges = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("source"), far.alias("target")).distinct()
    return R.components(edges).select("component", "node")


#: Entities of pages; the last one is read last, so that what it leaves is no entity.
_ENTITIES = {"&nbsp;": "\xa0", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&copy;": "©", "&middot;": "·", "&amp;": "&"}


@query(
    r"""SELECT page_id, md5(replace(replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '<br\s*/?>', chr(10), 'gi'), '</(div|p|li)\s*>', chr(10), 'gi'), '<[^>]+>', '', 'g'),
'&nbsp;', chr(160)), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&apos;', chr(39)), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')) AS digest FROM pages"""
)
def html_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of pages; of entities those that the SQL names, each with its semicolon."""
    return table(spark, sf_dir, "pages").select("page_id", F.md5(T.html_text(F.col("html"), _ENTITIES)).alias("digest"))


@query(
    """WITH d AS (SELECT o_orderkey AS doc_id, 'A [SRC-' || (o_custkey % 40) || '] b [SRC-' || (o_custkey % 7) || ', SRC-' || (o_orderkey % 9) || '] c [CL-1]  d' AS text, o_custkey % 40 AS x, o_custkey % 7 AS y, o_orderkey % 9 AS z FROM orders),
m AS (SELECT doc_id, 0 AS place, 0 AS inner_place, x AS s FROM d UNION ALL SELECT doc_id, 1, 0, y FROM d UNION ALL SELECT doc_id, 1, 1, z FROM d),
n AS (SELECT s, row_number() OVER (ORDER BY min(struct_pack(a := doc_id, b := place, c := inner_place)), s) AS k FROM m GROUP BY s)
SELECT doc_id, 'A [' || a.k || '] b [' || b.k || ', ' || c.k || '] c d' AS text, 1::BIGINT AS removed FROM d JOIN n a ON a.s = x JOIN n b ON b.s = y JOIN n c ON c.s = z"""
)
def cite_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source marks become numbers by first use; claim marks go."""
    k = lambda c, m: (F.col(c) % m).cast("string")
    docs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("A [SRC-"), k("o_custkey", 40), F.lit("] b [SRC-"), k("o_custkey", 7), F.lit(", SRC-"), k("o_orderkey", 9), F.lit("] c [CL-1]  d")).alias("text"))
    numbers = R.numbers_by_first_use(R.mentions(docs), "source_id", "doc_id", "at", "inside")
    return R.with_numbers(docs, numbers)


@query("SELECT conv_id, md5(string_agg(text, chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id")
def merge_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.joined(table(spark, sf_dir, "conversations"), "conv_id", "turn").select("conv_id", F.md5("text").alias("digest"))


@query("SELECT DISTINCT sha1(event_type || '|' || user_id) AS event_id FROM events WHERE event_id >= 100 EXCEPT SELECT sha1(event_type || '|' || user_id) FROM events WHERE event_id < 100")
def ledger_idempotent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of later events that the ledger of the first hundred lacks, each once."""
    e = table(spark, sf_dir, "events")
    keyed = lambda df: df.select(R.event_id("event_type", "user_id").alias("event_id"))
    return R.new_entries(keyed(e.where("event_id >= 100")), keyed(e.where("event_id < 100")))


#: Which parts a draft built from an order has (k: its key); every rule of the contract holds for some drafts and fails for others.
_PARTS = [
    ("k % 2 = 0", "---\nx: 1\n---\n"), ("k % 3 = 0", "# T\n"), ("k % 6 = 0", "# U\n"), ("k % 5 = 0", "### 1. I\n"), ("k % 7 = 0", "## 第 1 章：A\n"), ("k % 11 < 5", "![图1-1 x](figures/a.png)\n"), ("k % 22 < 5", "![图1-2 x](figures/b.png)\n"),
    ("k % 26 = 0", "**表1-1 c**\n"), ("k % 13 = 0", "|a|\n|---|\n"), ("k % 17 = 0", "全文完\n"), ("k % 19 = 0", "[3]\n"), ("k % 23 = 0", "[SRC-1/2]\n"), ("k % 29 = 0", "[S12]\n"), ("k % 31 = 0", "[SRC-4]\n"), ("k % 37 = 0", "本章字数\n"),
    ("k % 16 = 1", "## 参考文献\n"), ("k % 12 = 1", "### 参考文献\n"), ("k % 4 = 0", "[A] t\n"), ("k % 9 = 0", "[AB123]\n"), ("k % 8 = 0", "[CL-9]\n"), ("k % 10 = 0", "理解陈述\n"), ("k % 15 = 0", "**bb1x**\n**bb2x**\n**bb3x**\n"),
]
_I = lambda c: f"({c})::BIGINT"
_H = {
    "C1": f"{_I('k % 3 = 0')} + {_I('k % 6 = 0')}", "M": _I("k % 5 = 0"), "C": _I("k % 7 = 0"), "R": _I("k % 15 = 0"), "H2": f"{_I('k % 7 = 0')} + {_I('k % 16 = 1')}", "C3": f"{_I('k % 11 < 5')} + {_I('k % 22 < 5')}", "C4": _I("k % 13 = 0"), "C5": _I("k % 17 = 0"), "N": _I("k % 19 = 0"),
    "S": f"{_I('k % 23 = 0')} + {_I('k % 29 = 0')}", "C7": f"{_I('k % 23 = 0')} + {_I('k % 31 = 0')}", "C8": _I("k % 37 = 0"), "B2": _I("k % 16 = 1"), "B3": _I("k % 12 = 1"), "C10": _I("k % 4 = 0"), "C11": _I("k % 9 = 0"), "C12": _I("k % 8 = 0"), "C15": _I("k % 10 = 0"), "C16": _I("k % 2 = 0"), "C19": f"{_I('k % 2 = 0')} * 2", "C20": f"{_I('k % 15 = 0')} * 3",
}
#: Images that the folder of a draft lacks: b.png lies in none.
_C13 = _I("k % 22 < 5")


def _verdict_sql(mode: str) -> str:
    merged, final = mode != "draft", mode == "final"
    h = _H
    c2 = f"{h['M']} + {h['R']}" + ("" if merged else f" + ({h['H2']} > 0)::BIGINT")
    rules = [
        ("C1", "fatal", h["C1"], f"{h['C1']} <= {int(merged)}"), ("C2", "fatal", c2 if merged else f"{h['C']} + {c2}", f"{h['M']} = 0 AND {h['R']} = 0" + ("" if merged else f" AND {h['H2']} = 0")), ("C3", "high", h["C3"], f"{h['C3']} >= 1" if merged else "true"), ("C4", "high", h["C4"], f"{_I('k % 26 = 0')} >= {h['C4']}"),
        ("C5", "fatal", h["C5"], f"{h['C5']} = 0"), ("C6", "fatal", h["S"] if final else f"{h['S']} + {h['N']}", f"{h['S']} = 0" + ("" if final else f" AND {h['N']} = 0")), ("C7", "high" if final else "mid", h["C7"], f"{h['C7']} = 0" if final else "true"), ("C8", "mid", h["C8"], "true"),
        ("C9", "fatal", f"{h['B2']} + {h['B3']}", f"{h['B3']} = 0" if final else f"{h['B2']} + {h['B3']} = 0"), ("C10", "fatal", h["C10"], f"{h['C10']} = 0"), ("C11", "fatal", h["C11"], f"{h['C11']} = 0"), ("C12", "fatal", h["C12"], f"{h['C12']} = 0"), ("C15", "fatal", h["C15"], f"{h['C15']} = 0"),
        ("C16", "fatal", h["C16"], f"{h['C16']} = 1" if merged else "true"), ("C19", "warn", h["C19"], "true" if merged else f"{h['C19']} <= 1"), ("C20", "warn", h["C20"], "true" if merged else f"{h['C20']} < 3"), ("C13", "fatal", _C13, f"{_C13} = 0"),
    ]
    return " UNION ALL ".join(f"SELECT k AS doc_id, '{mode}' AS mode, '{r}' AS rule, '{s}' AS severity, {n} AS hits, {p} AS passed FROM d" for r, s, n, p in rules)


_VERDICTS = "WITH d AS (SELECT o_orderkey AS k FROM orders), v AS (" + " UNION ALL ".join(_verdict_sql(m) for m in ("draft", "merged", "final")) + ")"
_MODES = {"draft": {}, "merged": {"merged": True, "expect_figures": 1}, "final": {"merged": True, "stage": "stage9", "expect_figures": 1}}


def _drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dealt(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")), "k")
    return rows.select(F.col("k").alias("doc_id"), F.concat(*[F.when(F.expr(c), part).otherwise("") for c, part in _PARTS]).alias("text"))


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _drafts(spark, sf_dir)
    lost = contract.missing_images(docs, on_disk=spark.createDataFrame([("a.png",)], "file string"))
    return contract.verdicts_by_mode(docs, _MODES, lost)


@query(_VERDICTS + " SELECT doc_id, mode, rule, severity, hits::BIGINT AS hits, passed FROM v")
def contract_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract rules over drafts built from orders: as chapters, as merged texts, and in their last stage."""
    return _verdicts(spark, sf_dir)


_FATAL = ", ".join(f"'{r}'" for r in contract.BLOCKING)


@query(_VERDICTS + f" SELECT doc_id, mode, bool_and(passed) AS passed, count(*) FILTER (NOT passed) AS n_fatal FROM v WHERE rule IN ({_FATAL}) OR (mode = 'final' AND rule IN ('C7', 'C16')) GROUP BY ALL")
def contract_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _drafts(spark, sf_dir)
    lost = contract.missing_images(docs, on_disk=spark.createDataFrame([("a.png",)], "file string"))
    found = contract.overall_of(docs, _MODES, lost)
    return found.select("doc_id", "mode", "passed", F.size("fatal_rules").cast("long").alias("n_fatal"))


#: Words of strong claims in the invented prose.
STRONG = {"whole": "the|die|les", "part": "ing|tion"}


@query(
    f"""WITH l AS ({_LINES}), s AS (SELECT doc_id, line_no, 'whole' AS category, unnest(regexp_extract_all(text, 'the|die|les')) AS word, text FROM l UNION ALL SELECT doc_id, line_no, 'part', unnest(regexp_extract_all(text, 'ing|tion')), text FROM l)
SELECT doc_id, category, word, count(*) AS n, count(*) FILTER (NOT regexp_matches(text, '\\[S[0-9]+\\]|\\[C[AMOP]?[0-9]+\\]|\\[SRC-[0-9]+') AND NOT starts_with(trim(text), '#')) AS high_risk FROM s
WHERE NOT starts_with(trim(text), '```') AND NOT starts_with(trim(text), '>') GROUP BY ALL"""
)
def strong_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.strong_claims(L.lines(table(spark, sf_dir, "documents")), STRONG)
    return found.groupBy("doc_id", "category", "word").agg(F.count("*").alias("n"), F.count_if("high_risk").alias("high_risk"))


@query("SELECT custkey::BIGINT AS custkey, name, version::BIGINT AS version FROM (SELECT o_custkey AS custkey, o_orderpriority AS name, o_orderkey AS version, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS k FROM orders) WHERE k = 1")
def latest_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("key"), F.col("o_orderpriority").alias("name"), F.col("o_orderkey").cast("long").alias("version"))
    return R.last_by_key(rows, "key", "version").select(F.col("key").cast("long").alias("custkey"), "name", "version")


#: Boxes of a diagram from the lines of an order, on both sides.
_BOXES = "SELECT l_orderkey AS doc_id, l_linenumber::VARCHAR AS id, (l_partkey % 97)::DOUBLE AS x, (l_suppkey % 31)::DOUBLE AS y, (l_partkey % 97 + l_quantity)::DOUBLE AS x2, (l_suppkey % 31 + l_quantity % 17 + 1)::DOUBLE AS y2 FROM lineitem"


@query(
    f"""WITH b AS ({_BOXES}) SELECT a.doc_id, a.id AS a, b.id AS b, CASE WHEN least(least(a.x2, b.x2) - greatest(a.x, b.x), least(a.y2, b.y2) - greatest(a.y, b.y)) >= 3 THEN 'error' ELSE 'warning' END AS severity
FROM b a JOIN b ON a.doc_id = b.doc_id AND a.id < b.id AND a.x < b.x2 AND b.x < a.x2 AND a.y < b.y2 AND b.y < a.y2"""
)
def box_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of a diagram that meet, found by the tiles that they share."""
    return diagrams.overlaps(diagrams.boxes(_cells(spark, sf_dir))).select("doc_id", "a", "b", "severity")


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = lambda c: F.col(c).cast("string") if isinstance(c, str) else c.cast("string")
    none = F.lit(None).cast("string")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), s("l_linenumber").alias("id"), none.alias("value"), none.alias("style"), F.lit("1").alias("vertex"), none.alias("relative"),
        s(F.col("l_partkey") % 97).alias("x"), s(F.col("l_suppkey") % 31).alias("y"), s(F.col("l_quantity")).alias("width"), s(F.col("l_quantity") % 17 + 1).alias("height"), F.lit(True).alias("has_geometry"),
    )


@query(
    """WITH e AS (SELECT DISTINCT l_suppkey % 10 AS doc_id, 'p' || (l_partkey % 50) AS s, 's' || l_suppkey AS t FROM lineitem), n AS (SELECT doc_id, s AS id FROM e UNION SELECT doc_id, t FROM e),
g AS (SELECT doc_id, node, sum(o) AS o, sum(i) AS i, sum(o + i) AS k FROM (SELECT doc_id, s AS node, 1 AS o, 0 AS i FROM e UNION ALL SELECT doc_id, t, 0, 1 FROM e) GROUP BY ALL),
d AS (SELECT doc_id, max(o) AS o, max(i) AS i, max(k) AS top, count(*) AS n FROM g GROUP BY doc_id),
h AS (SELECT doc_id, count(*) FILTER (k = top) AS hubs, coalesce(max(k) FILTER (k < top), 0) AS second FROM g JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, n AS n_vertex, (SELECT count(*) FROM e WHERE e.doc_id = d.doc_id) AS n_edge, CASE WHEN d.doc_id % 2 = 0 THEN CASE WHEN d.o > 1 AND d.i > 1 THEN 'FLOW_RECONVERGENT' END WHEN hubs <> 1 THEN 'STAR_NO_UNIQUE_HUB' WHEN top < greatest(3, 2 * second) THEN 'STAR_HUB_NOT_DOMINANT' END AS verdict
FROM d JOIN h USING (doc_id)"""
)
def graph_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graphs of parts and suppliers, every other one meant as a flow, the rest as stars."""
    ranks.shared_folder(spark)
    e = table(spark, sf_dir, "lineitem")
    e = e.select((F.col("l_suppkey") % 10).alias("doc_id"), F.concat(F.lit("p"), F.col("l_partkey") % 50).alias("source"), F.concat(F.lit("s"), "l_suppkey").alias("target")).distinct()
    n = e.select("doc_id", F.col("source").alias("id")).union(e.select("doc_id", "target")).distinct()
    modes = e.select("doc_id").distinct().withColumn("mode", F.when(F.col("doc_id") % 2 == 0, "flow").otherwise("star"))
    return diagrams.mode_verdicts(n, e, modes).select("doc_id", "n_vertex", "n_edge", "verdict")


@query(
    """WITH c AS (SELECT conv_id || '-' || turn AS doc_id, conv_id, turn, role, coalesce(text, '') AS text FROM conversations), k AS (SELECT *, conv_id % 3 <> 0 AS paired, turn % 2 = 0 AS keyed FROM c)
SELECT doc_id, paired AS pairing_ok, paired AND role = 'user' AS envelope_ok, CASE WHEN NOT paired THEN 'none' WHEN keyed THEN 'true' ELSE 'false' END AS nonce_matched, CASE WHEN paired THEN md5(trim(text, chr(10))) END AS payload, CASE WHEN paired AND NOT keyed THEN 'nonce_missing' END AS degrade_reason FROM k"""
)
def envelope_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations in envelopes of their role; every third conversation's lack the end, odd turns lack the nonce."""
    key = F.when(F.col("turn") % 2 == 0, ":abc123").otherwise("")
    mark = lambda kind: F.concat(F.lit(f"[AGENT-OUTPUT-{kind}"), key, F.lit("] "), "role")
    text = F.concat(mark("START"), F.lit("\n"), F.coalesce("text", F.lit("")), F.when(F.col("conv_id") % 3 != 0, F.concat(F.lit("\n"), mark("END"))).otherwise(""))
    docs = table(spark, sf_dir, "conversations").select(F.concat("conv_id", F.lit("-"), "turn").alias("doc_id"), text.alias("text"))
    found = audits.envelopes(docs, F.lit("user"), F.lit("ABC123"))
    return found.select("doc_id", "pairing_ok", "envelope_ok", F.coalesce(F.col("nonce_matched").cast("string"), F.lit("none")).alias("nonce_matched"), F.md5("payload").alias("payload"), "degrade_reason")


_SCORES = "SELECT o_custkey AS chapter, 'd' || (o_orderkey % 9) AS dim_id, max(CASE WHEN o_orderkey % 4 = 0 THEN 'block' WHEN o_orderkey % 4 = 1 THEN 'pass' ELSE 'warn' END) AS verdict FROM orders GROUP BY ALL"


@query(
    f"""WITH s AS ({_SCORES}), e AS (SELECT DISTINCT o_custkey AS chapter, 'd' || (o_orderkey % 8) AS dim_id FROM orders), core AS (SELECT 'd' || unnest(range(3)) AS dim_id)
SELECT chapter, dim_id, 'missing' AS fault FROM e ANTI JOIN s USING (chapter, dim_id) UNION ALL SELECT chapter, dim_id, 'extra' FROM s ANTI JOIN e USING (chapter, dim_id)
UNION ALL SELECT chapter, dim_id, 'missing_core' FROM (SELECT chapter, core.dim_id FROM (SELECT DISTINCT chapter FROM e), core) ANTI JOIN e USING (chapter, dim_id)"""
)
def dimension_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("chapter"), F.concat(F.lit("d"), F.col("o_orderkey") % 8).alias("dim_id"))
    return audits.dimension_gaps(expected, _scores(spark, sf_dir), spark.createDataFrame([(f"d{i}",) for i in range(3)], "dim_id string"))


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    verdict = F.when(k % 4 == 0, "block").when(k % 4 == 1, "pass").otherwise("warn")
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("chapter"), F.concat(F.lit("d"), k % 9).alias("dim_id")).agg(F.max(verdict).alias("verdict"))


@query(
    f"""WITH s AS ({_SCORES}), v AS (SELECT DISTINCT o_custkey AS chapter, CASE WHEN o_custkey % 2 = 0 THEN 'PASS' ELSE 'REVISE' END AS actual FROM orders), h AS (SELECT chapter, string_agg(dim_id, ',' ORDER BY dim_id) AS high_blocks FROM s WHERE verdict = 'block' AND dim_id < 'd5' GROUP BY chapter)
SELECT chapter, CASE WHEN high_blocks IS NULL THEN 'PASS' ELSE 'REVISE' END AS expected, actual, coalesce(high_blocks, '') AS high_blocks, (high_blocks IS NULL) = (actual = 'PASS') AS passed FROM v LEFT JOIN h USING (chapter)"""
)
def audit_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    hints = spark.createDataFrame([(f"d{i}", "high" if i < 5 else "low") for i in range(9)], "dim_id string, severity string")
    actual = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("chapter"), F.when(F.col("o_custkey") % 2 == 0, "PASS").otherwise("REVISE").alias("verdict")).distinct()
    return audits.verdict_rule(_scores(spark, sf_dir), hints, actual).withColumn("high_blocks", F.array_join("high_blocks", ","))


@query(
    """WITH i AS (SELECT o_custkey AS chapter, o_orderstatus AS issue, max(CASE o_orderpriority[1] WHEN '1' THEN 4 WHEN '2' THEN 3 WHEN '3' THEN 2 ELSE 1 END) AS r, count(DISTINCT o_orderkey % 3) AS personas FROM orders GROUP BY ALL)
SELECT (row_number() OVER (ORDER BY r DESC, chapter, issue))::INTEGER AS number, chapter, issue, ['low', 'medium', 'high', 'critical'][r] AS severity, personas FROM i"""
)
def merged_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.substring("o_orderpriority", 1, 1)
    severity = F.when(first == "1", "critical").when(first == "2", "high").when(first == "3", "medium").otherwise("low")
    raised = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("chapter"), F.col("o_orderstatus").alias("issue"), severity.alias("severity"), (F.col("o_orderkey") % 3).alias("persona"))
    return audits.merged_issues(raised)


@query(
    """WITH c AS (SELECT r_regionkey AS doc_id, n_nationkey AS ordinal, CASE WHEN n_nationkey % 6 = 5 THEN '' ELSE '第' || n_nationkey || '章 ' || n_name END AS title FROM nation JOIN region ON n_regionkey = r_regionkey),
s AS (SELECT n_regionkey AS doc_id, n_nationkey AS ordinal, CASE WHEN s_suppkey % 7 = 0 THEN '' ELSE 'x' END AS no, CASE WHEN s_suppkey % 5 = 0 THEN '1.' || s_suppkey || ' ' || s_name ELSE s_name END AS title, s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey),
p AS (SELECT doc_id, ordinal, count(*) AS n, sum((no = '')::INT) AS s4, sum((s_suppkey % 5 = 0)::INT) AS s6 FROM s GROUP BY ALL), g AS (SELECT doc_id, count(*) AS s5 FROM c WHERE ordinal % 6 <> 5 AND ordinal % 4 = 0 GROUP BY doc_id),
w AS (SELECT doc_id, 0 AS s1, sum((title = '')::INT) AS s2, sum((coalesce(n, 0) < 2)::INT) AS s3, coalesce(sum(s4), 0) AS s4, coalesce(sum(s6), 0) AS s6 FROM c LEFT JOIN p USING (doc_id, ordinal) GROUP BY doc_id)
SELECT doc_id, rule, level, hits::BIGINT AS hits, hits = 0 AS passed FROM (SELECT doc_id, unnest(['S1', 'S2', 'S3', 'S4', 'S5', 'S6']) AS rule, unnest(['FATAL', 'FATAL', 'FATAL', 'FATAL', 'WARNING', 'WARNING']) AS level, unnest([s1, s2, s3, s4, coalesce(s5, 0), s6]) AS hits FROM w LEFT JOIN g USING (doc_id))"""
)
def outline_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as outlines, their nations as chapters (every sixth without title), suppliers as sections; every fourth nation is no heading."""
    n, k = table(spark, sf_dir, "nation"), F.col("s_suppkey")
    docs = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("doc_id"))
    title = F.when(F.col("n_nationkey") % 6 == 5, "").otherwise(F.concat(F.lit("第"), "n_nationkey", F.lit("章 "), "n_name"))
    chapters = n.select(F.col("n_regionkey").alias("doc_id"), F.col("n_nationkey").alias("ordinal"), title.alias("title"), F.lit(False).alias("is_appendix"))
    sections = table(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("n_regionkey").alias("doc_id"), F.col("n_nationkey").alias("ordinal"), F.when(k % 7 == 0, "").otherwise("x").alias("section_no"), F.when(k % 5 == 0, F.concat(F.lit("1."), k, F.lit(" "), "s_name")).otherwise(F.col("s_name")).alias("title"),
    )
    headings = n.where("n_nationkey % 4 <> 0 and n_nationkey % 6 <> 5").select(F.col("n_regionkey").alias("doc_id"), F.col("n_name").alias("title"))
    return outlines.gate(docs, chapters, sections, headings)


@query(
    """WITH m AS (SELECT o_custkey AS doc_id, o_orderkey || '.png' AS file, o_orderkey % 5 AS d, o_orderkey % 3 AS u, o_orderkey AS k FROM orders)
SELECT doc_id, k || '-1' AS figure_no, file, 'declared_missing' AS finding, 'FATAL' AS level FROM m WHERE d = 0 UNION ALL SELECT doc_id, k || '-1', file, 'ref_missing', 'FATAL' FROM m WHERE d = 0 AND u = 0 UNION ALL SELECT doc_id, k || '-1', 'x' || file, 'ref_missing', 'FATAL' FROM m WHERE u = 1 AND d <> 1 UNION ALL SELECT doc_id, k || '-1', 'x' || file, 'ref_undeclared', 'WARN' FROM m WHERE u = 1 AND d = 1"""
)
def figure_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest, folder and text of each customer's figures: every fifth is not in the folder, every third is named otherwise in the text."""
    k, o = F.col("o_orderkey"), table(spark, sf_dir, "orders")
    doc, no, file = F.col("o_custkey").alias("doc_id"), F.concat(k.cast("string"), F.lit("-1")).alias("figure_no"), F.concat(k.cast("string"), F.lit(".png"))
    other = F.concat(F.lit("x"), file)
    disk = o.where("o_orderkey % 5 <> 0").select(doc, file.alias("file")).union(o.where("o_orderkey % 5 = 1").select(doc, other))
    text = F.concat(F.lit("![图"), k, F.lit("-1 t](figures/"), F.when(k % 3 == 1, other).otherwise(file), F.lit(")"))
    refs = figures.image_refs(o.where("o_orderkey % 3 < 2").select(doc, text.alias("text")))
    return figures.path_findings(o.select(doc, no, F.concat(F.lit("out/"), file).alias("file")), disk, refs)


@query("SELECT o_custkey AS doc_id, substr(sha1(o_custkey || string_agg(name, '' ORDER BY name)), 1, 12) AS run_id FROM (SELECT o_custkey, 'ch' || o_orderkey AS name FROM orders) GROUP BY o_custkey")
def run_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return figures.run_ids(o.select(F.col("o_custkey").alias("doc_id"), F.col("o_custkey").cast("string").alias("text")).distinct(), o.select(F.col("o_custkey").alias("doc_id"), F.concat(F.lit("ch"), "o_orderkey").alias("name")))


@query("SELECT source AS doc_id, count(*) FILTER (s = 'fail') = 0 AS passed, count(DISTINCT lang) FILTER (s = 'fail') AS n_failed, count(*) FILTER (s = 'manual_required') AS manual FROM (SELECT source, coalesce(lang, '?') AS lang, CASE WHEN quality = 1 THEN 'pass' WHEN toxic = 1 THEN 'fail' ELSE 'manual_required' END AS s FROM labels JOIN documents USING (doc_id)) GROUP BY source")
def delivery_checklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("quality") == 1, "pass").when(F.col("toxic") == 1, "fail").otherwise("manual_required")
    items = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id").select(F.col("source").alias("doc_id"), F.coalesce("lang", F.lit("?")).alias("item"), status.alias("status"))
    return figures.checklist(items).select("doc_id", "passed", F.size("failed").cast("long").alias("n_failed"), "manual")
