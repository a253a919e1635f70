"""Grouping of spelling variants: words one edit apart, by an even-partition pigeonhole join, in DataFrame functions.

A word of length L is cut into two segments, of L // 2 and of the other code points. One edit lies in one of them, so a
near word of the same length holds the other segment at its place, and a near word that is one longer holds the first
one at its place or the second one a place further. Index entries are a word's segments with its length; probes are the
same substrings of words of that length, and the shifted ones of words that are one longer. Entries that meet are
candidates; they are deduplicated, and each is verified to be one edit apart.

A segment that many words share would list all pairs of them. Where a segment's words make more than LIMIT pairs, they
are not paired: the part that was left open is cut in two by the same rule, which leaves two smaller groups that agree in
three quarters of their letters, and so on, down to a single open letter. So no pair is lost, and no group lists more
than LIMIT pairs but those that agree in all letters but one (of which there are as many as letters).

From each word, forms lead to ever more frequent words, at least twice as frequent each; the last ones are found by
doubling the steps, so the rounds are as few as the logarithm of the longest way.

Cases: null or empty text has no words; a null id counts as no text before the colon; repeated rows count as often as
they come; among near words of equal frequency the smallest in code-point order is the form; runs of any length are words;
no documents, no rows; further columns, whatever their names, are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm._columns import looked_up, named
from ledgerloom.llm._common import written

#: Letters of a run, and what of them is lower-cased.
RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: One of so many (document, run) loses a code point.
EACH = 97
#: Code points and occurrences from which a result is a word.
LONG, OFTEN = 5, 3
#: Pairs up to which the words of a segment are paired.
LIMIT = 10_000
#: Code points up to which words are compared by their edit distance.
SHORT = 64
KEY = ["size", "low", "high", "known"]


def lowered(run: Column) -> Column:
    """A-Z in lower case, all else as it is; runs of ASCII take the quick way."""
    return F.when(F.octet_length(run) == F.length(run), F.lower(run)).otherwise(F.translate(run, UPPER, LOWER))


def vocabulary(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", long: int = LONG, often: int = OFTEN) -> DataFrame:
    """word, n: all words of all texts."""
    runs = docs.select(F.coalesce(named(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(named(text_col), F.lit(RUN), F.lit(0))).alias("run"))
    each = runs.select("id", lowered(F.col("run")).alias("run")).withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    without = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(F.col("h") % EACH == 0, without).otherwise(F.col("run"))
    return each.select(word.alias("word")).where(F.length("word") >= long).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= often)


def _keyed(entries: DataFrame) -> DataFrame:
    """Adds what an entry must share: all of the word but its open part, which is one longer in a longer word."""
    end = F.col("high") + F.when(F.col("longer"), 1).otherwise(0)
    return entries.withColumn("known", F.concat(F.substring("word", F.lit(1), F.col("low")), F.substring("word", end + 1, F.length("word"))))


def _halved(entries: DataFrame) -> DataFrame:
    """Each entry twice: the open part's first half is shared and its second half open, and the other way round."""
    mid = F.expr("low + (high - low) div 2")
    part = F.explode(F.array(F.struct(mid.alias("low"), F.col("high").alias("high")), F.struct(F.col("low").alias("low"), mid.alias("high")))).alias("part")
    return _keyed(entries.select("word", "n", "longer", "size", part).select("word", "n", "longer", "size", "part.low", "part.high"))


def _met(entries: DataFrame) -> DataFrame:
    """Pairs of index entries, and of index entries and longer words, that share a key."""
    index, all_ = entries.where(~F.col("longer")).alias("i"), entries.alias("p")
    on = [F.col(f"i.{c}") == F.col(f"p.{c}") for c in KEY] + [F.col("p.longer") | (F.col("p.word") > F.col("i.word"))]
    return index.join(all_, on).select(F.col("i.word").alias("a"), F.col("i.n").alias("a_n"), F.col("p.word").alias("b"), F.col("p.n").alias("b_n"))


def candidates(words: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Pairs (a, a_n, b, b_n) of words that share a segment, each once; all pairs that are one edit apart are among them."""
    length = F.length("word")
    whole = words.select("word", "n", F.explode(F.array(F.lit(False), F.lit(True))).alias("longer"))
    size = length - F.when(F.col("longer"), 1).otherwise(0)
    entries, found = _halved(whole.select("word", "n", "longer", size.alias("size"), F.lit(0).alias("low"), size.alias("high"))), []
    while True:
        entries = written(entries, "segments")
        n = entries.groupBy(*KEY).agg(F.sum(F.when(F.col("longer"), 0).otherwise(1)).alias("own"), F.sum(F.when(F.col("longer"), 1).otherwise(0)).alias("more"))
        hot = written(n.where((F.col("high") - F.col("low") > 1) & (F.col("own") * (F.col("own") - 1) / 2 + F.col("own") * F.col("more") > limit)).select(*KEY, F.lit(True).alias("hot")), "hot-segments")
        if hot.isEmpty():
            found.append(_met(entries))
            break
        told = written(looked_up(entries, hot, KEY, "left"), "told-segments")
        found.append(_met(told.where("hot IS NULL")))
        entries = _halved(told.where("hot"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct()


def one_edit(a: Column, b: Column) -> Column:
    """Whether b, as long as a or one longer, is one inserted or replaced code point away. Long words are compared behind what they share in front, which halving finds, as the distance takes the square of their lengths."""
    steps = F.sequence(F.lit(1), F.ceil(F.log2(F.length(a) + 2)).cast("int"))
    first = F.struct(F.lit(0).alias("low"), F.length(a).alias("high"))

    def closer(s: Column, _: Column) -> Column:
        mid = F.floor((s["low"] + s["high"] + 1) / 2).cast("int")
        same = F.substring(a, F.lit(1), mid) == F.substring(b, F.lit(1), mid)
        return F.struct(F.when(same, mid).otherwise(s["low"]).alias("low"), F.when(same, s["high"]).otherwise(mid - 1).alias("high"))

    shared = F.aggregate(steps, first, closer, lambda s: s["low"])
    behind = F.element_at(F.transform(F.array(shared), lambda n: F.when(F.length(a) == F.length(b), (a != b) & (F.substring(a, n + 2, F.length(a)) == F.substring(b, n + 2, F.length(b)))).otherwise(F.substring(a, n + 1, F.length(a)) == F.substring(b, n + 2, F.length(b)))), 1)
    return F.when(F.length(a) > SHORT, behind).otherwise(F.levenshtein(a, b, 1) == 1)


def near(words: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Pairs (a, a_n, b, b_n) of words that are one inserted, deleted or replaced code point apart, each once."""
    return candidates(words, limit).where(one_edit(F.col("a"), F.col("b")))


def _roots(forms: DataFrame) -> DataFrame:
    """word, root: where forms lead to in the end."""
    ways = written(forms.select("word", F.col("form").alias("to")), "ways")
    while True:
        ahead = ways.select(F.col("word").alias("to"), F.col("to").alias("further"))
        jumped = written(looked_up(ways, ahead, ["to"], "left"), "ways")
        if jumped.where("further IS NOT NULL").isEmpty():
            return ways.select("word", F.col("to").alias("root"))
        ways = jumped.select("word", F.coalesce("further", "to").alias("to"))


def variants(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", long: int = LONG, often: int = OFTEN, limit: int = LIMIT) -> DataFrame:
    """word, form, root, n, n_near, form_n of each word."""
    words = written(vocabulary(docs, id_col=id_col, text_col=text_col, long=long, often=often), "vocabulary")
    pairs = written(near(words, limit), "near-words")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("b_n").alias("other_n")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("a_n").alias("other_n")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    told = words.join(best, "word", "left").withColumn("form", F.when(-F.col("best.less") >= 2 * F.col("n"), F.col("best.other")))
    told = written(told.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form", F.when(F.col("form").isNotNull(), -F.col("best.less")).alias("form_n")), "forms")
    roots = _roots(told.where("form IS NOT NULL"))
    return told.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
