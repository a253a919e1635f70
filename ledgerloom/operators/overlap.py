"""Verbatim overlap between short cards and long reports: the longest common run of characters, from n-grams on.

Both sides are cleaned, their character n-grams (12) joined by equality, and hits grouped by diagonal (report position
minus card position). Neighbouring hits on a diagonal are one run; a run of k hits is k + n - 1 characters long. So the
longest run is exact, also where the first occurrence of an n-gram is not the best one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import text as T

N = 12
#: Characters of a run that count as a hit, and hits that block.
HIT_CHARS, BLOCK_HITS = 46, 2


def grams(docs: DataFrame, id_col: str, n: int = N) -> DataFrame:
    """id, pos (from 0), gram (its characters)."""
    found = F.posexplode(F.regexp_extract_all("clean", F.lit(f"(?s)(?=(.{{{n}}}))"), 1)).alias("pos", "gram")
    return docs.select(F.col(id_col).alias("id"), found)


def runs(cards: DataFrame, reports: DataFrame, *, card_id: str, report_id: str, text_col: str = "text", n: int = N) -> DataFrame:
    """card_id, report_id, card_pos, report_pos, chars: maximal common runs of at least n characters.

    Only report n-grams that some card has survive the semi-join, so what is shuffled follows the hits. The card table is
    broadcast by Spark itself where it is small.
    """
    c = cards.select(card_id, T.overlap_clean(F.col(text_col)).alias("clean")).where(F.length("clean") >= n)
    r = reports.select(report_id, T.overlap_clean(F.col(text_col)).alias("clean")).where(F.length("clean") >= n)
    cg = grams(c, card_id, n).select(F.col("id").alias("c"), F.col("pos").alias("cp"), "gram")
    rg = grams(r, report_id, n).select(F.col("id").alias("r"), F.col("pos").alias("rp"), "gram")
    hit = rg.join(cg, "gram").select("c", "r", "cp", (F.col("rp") - F.col("cp")).alias("d"))
    island = F.col("cp") - F.row_number().over(Window.partitionBy("c", "r", "d").orderBy("cp"))
    found = hit.withColumn("i", island).groupBy("c", "r", "d", "i").agg(F.min("cp").alias("card_pos"), (F.count("*") + (n - 1)).alias("chars"))
    return found.select(F.col("c").alias(card_id), F.col("r").alias(report_id), "card_pos", (F.col("card_pos") + F.col("d")).alias("report_pos"), "chars")


def longest(cards: DataFrame, reports: DataFrame, *, card_id: str, report_id: str, text_col: str = "text", n: int = N) -> DataFrame:
    """card_id, report_id, chars, fragment, kind: the longest common run of each pair that shares an n-gram (ties: the first in the card)."""
    found = runs(cards, reports, card_id=card_id, report_id=report_id, text_col=text_col, n=n)
    best = found.groupBy(card_id, report_id).agg(F.max(F.struct("chars", (-F.col("card_pos")).alias("before"))).alias("b"))
    clean = cards.select(card_id, T.overlap_clean(F.col(text_col)).alias("clean"))
    out = best.join(clean, card_id).select(card_id, report_id, F.col("b.chars").alias("chars"), F.substr("clean", F.lit(1) - F.col("b.before"), F.col("b.chars").cast("int")).alias("fragment"))
    return out.withColumn("kind", T.fragment_kind(F.col("fragment")))


def summary(pairs: DataFrame, report_id: str, hit_chars: int = HIT_CHARS, block: int = BLOCK_HITS) -> DataFrame:
    """report_id, overlaps, hits (of hit_chars or more), own_hits (not proprietary), blocked."""
    is_hit = F.col("chars") >= hit_chars
    own = F.count_if(is_hit & F.col("kind").isNull())
    return pairs.groupBy(report_id).agg(F.count("*").alias("overlaps"), F.count_if(is_hit).alias("hits"), own.alias("own_hits"), (own >= block).alias("blocked"))
