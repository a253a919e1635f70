"""The queries of this subpackage, each over its whole table, and DuckDB SQL for those that SQL can express.

Each query takes (spark, sf_dir) and gets its rows through its operator; the digest columns are derived here. Four have
no SQL and are tested in tests/llm: op1 (an iterative partition) by its law and digests, op6 (a trained model) by held-out
accuracy and a plain version of its features, training step and temperature, op7 and op8 (a tokenizer's ids) against the
library.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import decontamination, language_id, mixing, packing, sharding, similarity_join, spelling, substring_dedup, suffix_dedup, token_alignment, token_files, topk_search, url_filter
from ledgerloom.llm._common import scratch

SHARDS = 24
#: Queries of op5: one vec_id of so many.
EACH = 50


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    docs = table(spark, sf_dir, "documents")
    text = F.col("text")
    rows = docs.select("doc_id", (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), F.xxhash64(text, F.reverse(text)).alias("key"), text.isNotNull().alias("has"))
    rows = rows.select("doc_id", "size", "text_crc32", F.when(F.col("has"), F.array("key")).alias("links"))
    placed = sharding.balanced_shards(rows, SHARDS, links_col="links")
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict."""
    rules = [url_filter.host_rule(*r) for r in url_filter.HOST_RULES] + [url_filter.word_rule(w) for w in url_filter.BLOCK_WORDS] + url_filter.filter_rules(url_filter.FILTERS)
    return url_filter.judge(table(spark, sf_dir, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id, n_links."""
    return similarity_join.near_duplicates(table(spark, sf_dir, "documents"))


def op5_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score."""
    vectors = table(spark, sf_dir, "embeddings")
    return topk_search.top_k(vectors, vectors.where(F.col("vec_id") % EACH == 0), 5)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs, ~language_id.held_out("doc_id"))
    return language_id.predict(docs, model).select("doc_id", language_id.held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, as read back from the files."""
    out = scratch(spark, "token-files")
    token_files.write_token_files(table(spark, sf_dir, "documents"), out, tokenizer_path(), special=True)
    return token_files.read_token_files(spark, out).select("doc_id", "start", "n_tokens", "ids_crc32")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), special=True)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    kept = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    kept = suffix_dedup.remove_repeated_bytes(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2(F.col("kept_bytes"), 256).alias("kept_sha256"))


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken."""
    return mixing.taken(mixing.plan(table(spark, sf_dir, "documents"))).select("doc_id", "size", "source_size", "target", "taken")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """word, form, root, n, n_near, form_n."""
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    found = token_alignment.alignment(table(spark, sf_dir, "documents"), tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))
    return found.drop("groups")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_sharding, op2_decontamination, op3_url_filter, op4_ngram_jaccard_join, op5_topk_search, op6_language_id, op7_token_files, op8_packing, op9_substring_dedup, op10_suffix_dedup, op11_mixing, op12_spelling_variants, op13_token_alignment)
}

_PLAIN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP2 = rf"""
WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce(regexp_extract_all({_LOWER}, '{_PLAIN}'), []) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '{_PLAIN}') AS w FROM benchmark WHERE text IS NOT NULL),
item AS (SELECT DISTINCT item_id, array_to_string(list_slice(w, i, i + 9), ' ') AS g, least(len(w), 10) AS size
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM item),
gram AS (SELECT row_id, i, size, array_to_string(list_slice(w, i, i + size - 1), ' ') AS g
  FROM (SELECT row_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)),
hit AS (SELECT gram.row_id, gram.i, gram.size, item.item_id FROM gram JOIN item USING (g, size)),
place AS (SELECT row_id, count(DISTINCT p) AS n_hit FROM (SELECT row_id, unnest(range(i, i + size)) AS p FROM hit) GROUP BY row_id),
own AS (SELECT row_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
  FROM (SELECT DISTINCT row_id, item_id::VARCHAR AS item_id FROM hit) GROUP BY row_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN place USING (row_id) LEFT JOIN own USING (row_id)
"""

_FITS = "(h.host = '{host}' OR ends_with(h.host, '.{host}')) AND starts_with(h.path, '{path}')"
_OP3 = (
    """
WITH u AS (SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT h.*, CASE """
    + " ".join(f"WHEN {_FITS.format(host=h, path=p)} THEN '{h}{p}'" for h, p, _ in sorted(url_filter.HOST_RULES, key=lambda r: -len(r[0] + r[1])))
    + """ END AS rule, regexp_matches(host || chr(10) || path, '(?i)(^|[^A-Za-z0-9])("""
    + "|".join(url_filter.BLOCK_WORDS)
    + """)([^A-Za-z0-9]|$)') AS word,
  coalesce(regexp_matches(url, '(?is)^[a-z][a-z0-9+.-]*://([^/?#]*\\.)?(ads|tracker)\\.|/banner/|[^A-Za-z0-9_.%-]popup([^A-Za-z0-9_.%-]|$)'), false) AS listed,
  coalesce(regexp_matches(url, '(?is)^[a-z][a-z0-9+.-]*://([^/?#]*\\.)?example\\.org([^A-Za-z0-9_.%-]|$).*/about/'), false) AS spared FROM h)
SELECT page_id, host, path, rule, CASE """
    + " ".join(f"WHEN rule = '{h}{p}' THEN '{v}'" for h, p, v in url_filter.HOST_RULES)
    + """ WHEN spared THEN 'allow' WHEN word OR listed THEN 'block' ELSE 'allow' END AS verdict FROM r
"""
)

_OP4 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, text, regexp_extract_all({_LOWER}, '{_PLAIN}') AS w FROM documents WHERE text IS NOT NULL),
t AS (SELECT text, any_value(w) AS w, count(*) AS copies, min(doc_id) AS low FROM d GROUP BY text),
s AS (SELECT DISTINCT low, array_to_string(list_slice(w, i, i + 4), ' ') AS g
  FROM (SELECT low, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM t WHERE len(w) > 0)),
n AS (SELECT low, count(*) AS n FROM s GROUP BY low),
pair AS (SELECT a.low AS a, b.low AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.low <> b.low GROUP BY a.low, b.low),
link AS (SELECT a, b FROM pair JOIN n x ON x.low = a JOIN n y ON y.low = b WHERE 5 * common >= 4 * (x.n + y.n - common)),
reach(a, b) AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
class AS (SELECT a AS low, least(a, min(b)) AS class_id FROM reach GROUP BY a),
many AS (SELECT a AS low, sum(copies) AS others FROM link JOIN t ON t.low = b GROUP BY a)
SELECT documents.doc_id, CASE WHEN text IS NULL THEN documents.doc_id ELSE coalesce(class_id, t.low) END AS class_id,
  CASE WHEN text IS NULL THEN 0 ELSE copies - 1 + coalesce(others, 0) END::BIGINT AS n_links
FROM documents LEFT JOIN t USING (text) LEFT JOIN class ON class.low = t.low LEFT JOIN many ON many.low = t.low
"""

_OP5 = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % {EACH} = 0)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""

_OP9 = r"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id NULLS LAST, text NULLS LAST) AS row_id, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
g AS (SELECT row_id, i, array_to_string(list_slice(w, i, i + 19), ' ') AS g FROM (SELECT row_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
again AS (SELECT row_id, i FROM g QUALIFY row_number() OVER (PARTITION BY g ORDER BY row_id, i) > 1),
gone AS (SELECT DISTINCT row_id, unnest(range(i, i + 20)) AS p FROM again),
word AS (SELECT row_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d WHERE len(w) > 0),
kept AS (SELECT row_id, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n FROM word ANTI JOIN gone USING (row_id, p) GROUP BY row_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (row_id)
"""

#: Bytes as pairs of hex digits, so that places are bytes.
_OP10 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
g AS (SELECT doc_id, i, hash(substr(h, 2 * i + 1, 100)) AS g FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS i FROM d WHERE length(h) >= 100)),
again AS (SELECT doc_id, i FROM g QUALIFY min(doc_id) OVER (PARTITION BY g) < doc_id),
part AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS k
  FROM (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS fresh FROM again)),
span AS (SELECT doc_id, k, min(i) AS a, max(i) + 50 AS b FROM part GROUP BY doc_id, k),
piece AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM span),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head, max(b) AS last, sum(b - a) AS n_removed, count(*) AS n_spans
  FROM piece JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(head || substr(h, 2 * last + 1), h))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

#: One step of a permutation changes x and its mirror if the larger one's hash says so; the level is the first one that no further source exceeds.
_OP11 = rf"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS number FROM d GROUP BY source),
w AS (SELECT *, {list(mixing.WEIGHTS)}[number % {len(mixing.WEIGHTS)} + 1] AS weight, {mixing.MOST} * size AS most FROM s),
o AS (SELECT *, most / weight AS r, sum(size) OVER () - coalesce(sum(most) OVER (ORDER BY most / weight, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS num,
  sum(weight) OVER (ORDER BY most / weight, number ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS den FROM w),
level AS (SELECT num::BIGINT AS num, den::BIGINT AS den FROM o WHERE num * weight < most * den ORDER BY r, number LIMIT 1),
t AS (SELECT number, source, size, CASE WHEN den IS NULL OR most * den <= num * weight THEN most::DOUBLE ELSE num * weight / den END AS target,
  CASE WHEN den IS NULL OR most * den <= num * weight THEN most ELSE (2 * num * weight + den) // (2 * den) END AS words FROM w LEFT JOIN level ON true),
turn AS (SELECT number, turn, size // {mixing.BLOCK} AS whole, CASE WHEN (turn + 1) * size <= words THEN size ELSE words % size END AS words
  FROM (SELECT *, unnest(range((words + size - 1) // size)) AS turn FROM t WHERE size > 0)),
slot AS (SELECT *, unnest(range((words + {mixing.BLOCK} - 1) // {mixing.BLOCK})) AS j FROM turn),
key AS (SELECT number, turn, round, ('0x' || substr(md5('mix:' || number || ':' || turn || ':' || round), 1, 15))::BIGINT AS key FROM turn, range({mixing.ROUNDS}) AS r(round)),
step AS (SELECT number, turn, j, j AS x, whole, 0 AS round FROM slot WHERE j < whole
  UNION ALL SELECT number, turn, j, CASE WHEN substr(md5(key || ':' || greatest(x, other)), 1, 1) < '8' THEN other ELSE x END, whole, round + 1
  FROM (SELECT step.*, key, ((key - x) % whole + whole) % whole AS other FROM step JOIN key USING (number, turn, round))),
block AS (SELECT number, coalesce(x, whole) AS block, least({mixing.BLOCK}, words - j * {mixing.BLOCK}) AS words
  FROM slot LEFT JOIN (SELECT number, turn, j, x FROM step WHERE round = {mixing.ROUNDS}) USING (number, turn, j)),
own AS (SELECT d.*, number, t.size AS source_size, target, row_number() OVER () AS id,
  coalesce(sum(d.size) OVER (PARTITION BY number ORDER BY doc_id NULLS LAST, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
piece AS (SELECT id, number, start, size, unnest(range(start // {mixing.BLOCK}, (start + size + {mixing.BLOCK} - 1) // {mixing.BLOCK})) AS block FROM own),
sums AS (SELECT id, sum(greatest(least(start + size - block * {mixing.BLOCK}, words) - greatest(start - block * {mixing.BLOCK}, 0), 0)) AS taken FROM piece JOIN block USING (number, block) GROUP BY id)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM own LEFT JOIN sums USING (id)
"""

def _crc_table() -> list[int]:
    """What each byte does to a CRC-32, from its polynomial."""
    out = list(range(256))
    for _ in range(8):
        out = [(c >> 1) ^ (0xEDB88320 if c & 1 else 0) for c in out]
    return out


#: Near words by their forms with one code point left out: of one length if they leave out the same place, else if the longer one becomes the shorter.
_OP12 = f"""
WITH RECURSIVE r AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
c AS (SELECT doc_id, run, count(*) AS n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS h FROM r GROUP BY doc_id, run),
k AS (SELECT run, n, xor(list_reduce(list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT),
  lambda a, b: xor(a >> 8, {_crc_table()}[(xor(a, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) AS crc FROM c),
e AS (SELECT CASE WHEN crc % {spelling.EACH} = 0 THEN left(run, crc % length(run)) || substr(run, crc % length(run) + 2) ELSE run END AS word, n FROM k),
v AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM e WHERE length(word) >= {spelling.LONG} GROUP BY word HAVING sum(n) >= {spelling.OFTEN}),
p AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
near AS (SELECT a.word, b.word AS other, b.n FROM p a JOIN p b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word AND length(a.word) = length(b.word)
  UNION SELECT p.word, v.word, v.n FROM p JOIN v ON p.rest = v.word UNION SELECT v.word, p.word, p.n FROM p JOIN v ON p.rest = v.word),
best AS (SELECT word, count(*) AS n_near, arg_min(other, (-n, other)) AS form, max(n) AS form_n FROM near GROUP BY word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 2 * v.n THEN form END AS form, CASE WHEN form_n >= 2 * v.n THEN form_n END AS form_n FROM v LEFT JOIN best USING (word)),
way(word, root) AS (SELECT word, word FROM f UNION ALL SELECT way.word, f.form FROM way JOIN f ON way.root = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, way.root, f.n, f.n_near, f.form_n FROM f JOIN way USING (word) JOIN f l ON l.word = way.root WHERE l.form IS NULL
"""

ORACLE_SQL = {"op2_decontamination": _OP2, "op3_url_filter": _OP3, "op4_ngram_jaccard_join": _OP4, "op5_topk_search": _OP5, "op9_substring_dedup": _OP9, "op10_suffix_dedup": _OP10, "op11_mixing": _OP11, "op12_spelling_variants": _OP12}
