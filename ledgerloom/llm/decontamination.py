"""Benchmark decontamination by a prefix-filtered set join, in DataFrame functions only.

Words are runs of letters, digits and characters beyond ASCII, after A-Z became a-z. An item's windows are its runs of
10 words; a shorter item is one window. A window must lie in a document whole, so its necessary prefix is one shingle:
its rarest, by the corpus-wide counts of the item shingles. Documents are searched for these only; a hit is kept if the
window, laid around it, begins and ends within the document (positional and length bounds), and then compared word by
word. Counts and search run over all documents. Item tables are broadcast only if they are measured to be small;
beyond that, plain joins on the shingle and on the document do the same.

Cases: null or empty text has no words and no hit; a null item text has no window; rows that share an id and text have
equal results, one row each; a null id stays null; an empty benchmark leaves all clean; extra columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm._columns import named
from ledgerloom.llm._common import written

#: What separates words, after lower-casing.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of an item table up to which it is broadcast.
BROADCAST_BYTES = 16 << 20


def words(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.coalesce(F.array_remove(F.split(F.translate(text, UPPER, LOWER), SEPARATORS), ""), F.array().cast("array<string>"))


def item_windows(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> tuple[DataFrame, DataFrame]:
    """The distinct windows, as a table: wid, w (words), size; and which items have them: item_id, wid."""
    own = benchmark.select(F.col(item_col).alias("item_id"), words(F.col(text_col)).alias("all")).where(F.size("all") > 0)
    at = own.select("item_id", "all", F.explode(F.sequence(F.lit(0), F.greatest(F.size("all") - window, F.lit(0)))).alias("at"))
    each = written(at.select("item_id", F.slice("all", F.col("at") + 1, window).alias("w")).distinct(), "item-windows")
    windows = written(each.select("w").distinct().select(F.monotonically_increasing_id().alias("wid"), "w", F.size("w").alias("size")), "windows")
    return windows, written(each.join(windows, "w").select("item_id", "wid"), "items")


def _bounded(df: DataFrame, most: int) -> DataFrame:
    """df, to be broadcast if it measures at most so many bytes."""
    size = df.select(F.sum(F.length(F.to_json(F.struct("*")))).alias("n")).first()["n"] or 0
    return F.broadcast(df) if size <= most else df


def word_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, mark (tells texts of one id apart), words, n; written once and read by each step."""
    text = F.col(text_col)
    return written(docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("mark"), words(text).alias("words")).withColumn("n", F.size("words")), "words")


def occurrences(table: DataFrame, windows: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Where windows (wid, w, size) occur: id, mark, start, size, wid."""
    shingle = windows.select("wid", "size", F.posexplode("w").alias("at", "token"))
    vocabulary = _bounded(shingle.select("token").distinct(), broadcast_bytes)
    # a table of its own, so that a word of many windows joins one row, and Spark can split its windows
    counts = written(table.select(F.explode("words").alias("token")).join(vocabulary, "token", "left_semi").groupBy("token").count(), "counts")
    # a shingle that no document has cannot be found, and neither can its window
    rarity = shingle.join(_bounded(counts, broadcast_bytes), "token", "left").groupBy("wid").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("count"), "token", "at")).alias("rarest"))
    prefix = written(rarity.where("rarest.count > 0").join(windows, "wid").select(F.col("rarest.token").alias("token"), F.col("rarest.at").alias("at"), "wid", "w", "size"), "prefix")
    start, fits = F.col("pos") - F.col("at"), (F.col("pos") >= F.col("at")) & (F.col("pos") - F.col("at") + F.col("size") <= F.col("n"))
    small = prefix.select(F.sum(F.length(F.to_json(F.struct("*")))).alias("b")).first()["b"] or 0
    if small <= broadcast_bytes:
        found = table.select("id", "mark", "n", "words", F.posexplode("words").alias("pos", "token")).join(F.broadcast(prefix), "token").where(fits)
        return found.where(F.slice("words", start + 1, F.col("size")) == F.col("w")).select("id", "mark", start.alias("start"), "size", "wid")
    found = table.select("id", "mark", "n", F.posexplode("words").alias("pos", "token")).join(prefix.drop("w"), "token").where(fits)
    candidates = found.select("id", "mark", start.alias("start"), "size", "wid").alias("c")
    whole = table.select("id", "mark", "words").dropDuplicates(["id", "mark"]).alias("t")
    joined = candidates.join(whole, F.col("c.id").eqNullSafe(F.col("t.id")) & F.col("c.mark").eqNullSafe(F.col("t.mark"))).join(windows.select("wid", "w"), "wid")
    return joined.where(F.slice("words", F.col("start") + 1, F.col("size")) == F.col("w")).select("c.id", "c.mark", "start", "size", "wid")


def contamination(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Of each document: doc_id, mark, n_words, n_hit (words inside an occurrence), item_ids (as sorted strings), contaminated."""
    table = word_table(docs, id_col, text_col)
    windows, by_item = item_windows(benchmark, item_col, item_text_col, window)
    hits = written(occurrences(table, windows, broadcast_bytes).distinct(), "hits")
    places = hits.select("id", "mark", "start", "size").distinct()
    each = places.select("id", "mark", F.explode(F.sequence("start", F.col("start") + F.col("size") - 1)).alias("pos")).distinct()
    n_hit = each.groupBy("id", "mark").agg(F.count("*").alias("n_hit"))
    items = hits.select("id", "mark", "wid").distinct().join(_bounded(by_item, broadcast_bytes), "wid").groupBy("id", "mark").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    t, h, i = table.select("id", "mark", "n").alias("t"), n_hit.alias("h"), items.alias("i")
    same = lambda x: F.col("t.id").eqNullSafe(F.col(f"{x}.id")) & F.col("t.mark").eqNullSafe(F.col(f"{x}.mark"))
    return t.join(h, same("h"), "left").join(i, same("i"), "left").select(
        F.col("t.id").alias("doc_id"), F.col("t.mark").alias("mark"), F.col("t.n").cast("long").alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("item_ids"), F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how: object) -> DataFrame:
    """The documents that hold no window of an item, with all their columns."""
    found = contamination(docs, benchmark, id_col=id_col, text_col=text_col, **how).where("contaminated")
    gone = written(found.select("doc_id", "mark").distinct(), "contaminated").alias("gone")
    own = docs.select(F.struct(*map(named, docs.columns)).alias("d")).alias("own")  # whatever the names of its columns are
    id_, text = F.col("own.d").getField(id_col), F.col("own.d").getField(text_col)
    kept = own.join(gone, id_.eqNullSafe(F.col("gone.doc_id")) & F.xxhash64(text).eqNullSafe(F.col("gone.mark")), "left_anti")
    return kept.select(*[F.col("d").getField(c).alias(c) for c in docs.columns])
