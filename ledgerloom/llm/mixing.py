"""Mixing sources to target weights, in DataFrame functions only.

The words of each source, its documents one behind the other, are packed into blocks of a fixed length (the last one is
shorter). Sources in code-point order, null last, have the weights 5, 2, 1, 5, ... and share as many words as there are;
no source gets more than three times its own, and what it cannot take is shared by the others by weight. A source's share
is a row of slots: its blocks in a pseudorandom order, all of them once before any is taken again, in another order. Only
the last slot is cut, so that the share is met to a word and no document is taken more than three times. All slots are
dealt over output shards of equal size by one pseudorandom permutation. So the counts by source of a shard are
multinomial draws, given that over all shards they sum up to the shares: independent draws would miss these by their
spread and could ask a source for more than it has. Slots and blocks meet in a join by block index.

Permutations are swap-or-not shuffles of the index, so no row is sorted for them, and reruns agree.

Running sums over documents are taken by ranges (rows of a hot source lie in many), so no task sees a source whole; the
tables of ranges and of sources hold a row for each. Texts move only where the mix itself is asked for (mixed()).

Cases: null or empty text has no words and is never taken; a null source is a source, the last one; a source without words
has the target 0; null ids come last in their source; equal rows are documents of their own; no documents, no rows; the
mix of no words is empty; further columns, whatever their names, are left out.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm._columns import looked_up, named
from ledgerloom.llm._common import written

#: Fixed value: a word.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
#: A source's target is at most so many times its size.
MOST = 3
#: Words of a block, blocks of an output shard, steps of a permutation, slots that one row is exploded into.
BLOCK, SHARD, ROUNDS, CHUNK = 512, 1024, 16, 1024


class Mix(NamedTuple):
    """rows: source, id, size, number (of the source), start (its first word in the source), and words if asked for. sources: number, source, size, weight, target, words (to take), before (slots of earlier sources). slots: their number over all sources."""

    rows: DataFrame
    sources: DataFrame
    slots: int
    block: int
    seed: str


def _running(table: DataFrame, value: str, order: list[Column], before: str) -> DataFrame:
    """Adds the sum of value over all rows before each, by part and order: within a part by window, over the parts by their sums, of which there are as many as parts."""
    sums = table.groupBy("part").agg(F.sum(value).alias("own"))
    earlier = sums.select("part", F.coalesce(F.sum("own").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    here = F.sum(value).over(Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return looked_up(table, earlier, ["part"]).withColumn(before, (F.col("earlier") + F.coalesce(here, F.lit(0))).cast("long")).drop("earlier")


def _level(sources: DataFrame, weights: tuple[int, ...]) -> tuple[int, int]:
    """Words for each unit of weight, as a fraction, once no source is above its most. Each round raises the level by what the sources found above it cannot take."""
    first = sources.agg(F.sum("size").alias("n"), F.sum("weight").alias("w")).first()
    total, level = first["n"] or 0, (first["n"] or 0, first["w"] or 1)
    while True:
        full = _full(*level, weights)
        got = sources.agg(F.sum(F.when(full, F.col("most")).otherwise(0)).alias("held"), F.sum(F.when(full, 0).otherwise(F.col("weight"))).alias("w")).first()
        if not got["w"] or (total - got["held"], got["w"]) == level:
            return level
        level = total - got["held"], got["w"]


def _by_weight(values: dict[int, int | float]) -> Column:
    out = F.lit(None)
    for w, v in values.items():
        out = F.when(F.col("weight") == w, F.lit(v)).otherwise(out)
    return out


def _full(num: int, den: int, weights: tuple[int, ...]) -> Column:
    """Whether a source's share at this level is its most, or above."""
    return F.col("most") <= _by_weight({w: num * w // den for w in weights})


def plan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, block: int = BLOCK, seed: str = "mix", texts: bool = False) -> Mix:
    """Places of all documents in their sources, and what each source gives. texts: keep the words, for mixed()."""
    text = named(text_col)
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    # written, so that texts are read once and the salt, which parts equal rows only, stays the same if a task runs again
    own = written(docs.select(named(source_col).alias("source"), named(id_col).alias("id"), size.alias("size"), F.xxhash64(text).alias("mark"), *([F.coalesce(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.array().cast("array<string>")).alias("words")] if texts else [])), "sizes")
    within = [F.col("id").asc_nulls_last(), F.col("size"), F.col("mark"), F.col("salt")]
    ranges = own.withColumn("salt", F.monotonically_increasing_id()).repartitionByRange(F.col("source").asc_nulls_last(), *within)
    ranged = written(ranges.withColumn("part", F.spark_partition_id()), "ranges")
    pieces = ranged.groupBy("part", "source").agg(F.sum("size").alias("own"))
    gone = F.sum("own").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    pieces = pieces.withColumn("earlier", F.coalesce(gone, F.lit(0)))
    by_source = pieces.groupBy("source").agg(F.sum("own").alias("size"), F.min("part").alias("part")).withColumn("one", F.lit(1))
    sources = _running(by_source, "one", [F.col("source").asc_nulls_last()], "number")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("number") % len(weights) + 1).cast("int"))
    sources = written(sources.select("source", "size", "part", "number", weight.cast("long").alias("weight"), (F.col("size") * most).alias("most")), "sources")
    num, den = _level(sources, weights)
    full, tail = _full(num, den, weights), F.when(F.col("size") % block > 0, 1).otherwise(0)
    sources = sources.withColumns({"target": F.when(full, F.col("most").cast("double")).otherwise(_by_weight({w: num * w / den for w in weights})), "words": F.when(full, F.col("most")).otherwise(_by_weight({w: (2 * num * w + den) // (2 * den) for w in weights}))})
    sources = sources.withColumns({"blocks": (F.floor(F.col("size") / block) + tail).cast("long"), "whole": F.expr("if(size > 0, words div size, 0)"), "rest": F.expr("if(size > 0, words % size, 0)")})
    sources = _running(sources.withColumn("slots", (F.col("whole") * F.col("blocks") + F.ceil(F.col("rest") / block)).cast("long")), "slots", [F.col("source").asc_nulls_last()], "before")
    start = F.col("earlier") + F.coalesce(F.sum("size").over(Window.partitionBy("part", "source").orderBy(*within).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = looked_up(ranged, pieces.select("part", "source", "earlier"), ["part", "source"]).withColumn("start", start)
    rows = looked_up(at.drop("part", "earlier", "mark", "salt"), sources.select("source", "number", F.col("size").alias("source_size"), "target"), ["source"])
    return Mix(rows, sources, sources.agg(F.sum("slots").alias("n")).first()["n"] or 0, block, seed)


def keys_of(*parts: object) -> Column:
    """The round keys of a permutation: the first 60 bits of MD5 of what it is for and the round."""
    told = lambda r: F.concat_ws(":", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts], r)
    return F.transform(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), lambda r: F.conv(F.substring(F.md5(told(r)), 1, 15), 16, 10).cast("long"))


def permuted(x: Column, n: Column, keys: Column) -> Column:
    """Where x (0 to n - 1) lies in a pseudorandom order: in each round, x and its mirror at the key change places if a bit of the larger one's hash says so."""

    def swapped(x: Column, key: Column) -> Column:
        other = F.pmod(key - x, n)
        bit = F.substring(F.md5(F.concat_ws(":", key, F.greatest(x, other))), 1, 1) < "8"
        return F.when(bit, other).otherwise(x)

    return F.aggregate(keys, x.cast("long"), swapped)


def slots(mix: Mix, shard: int = SHARD) -> DataFrame:
    """Every slot of the mix: shard, slot, number (of the source), block, words (that it takes from the block's beginning)."""
    size, rest = F.col("size"), F.col("rest")
    each = mix.sources.where("slots > 0").select("number", "size", "blocks", "before", F.explode(F.expr("sequence(0, if(rest > 0, whole, whole - 1))")).alias("turn"), "whole", "rest")
    each = each.withColumns({"n": F.when(F.col("turn") < F.col("whole"), F.col("blocks")).otherwise(F.ceil(rest / mix.block)).cast("long"), "words": F.when(F.col("turn") < F.col("whole"), size).otherwise(rest), "keys": keys_of(mix.seed, F.col("number"), F.col("turn"))})
    chunks = each.withColumn("low", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(CHUNK).cast("long")))).repartition(-(-mix.slots // (16 * CHUNK)) or 1, "number", "turn", "low")
    one = chunks.withColumn("j", F.explode(F.sequence("low", F.least(F.col("low") + CHUNK, F.col("n")) - 1)))
    full = F.expr(f"size div {mix.block}")
    block = F.when(F.col("j") < full, permuted(F.col("j"), full, F.col("keys"))).otherwise(full)
    keys = F.array(*[F.lit(int(hashlib.md5(f"{mix.seed}:all:{r}".encode()).hexdigest()[:15], 16)) for r in range(ROUNDS)])
    place = permuted(F.col("before") + F.col("turn") * F.col("blocks") + F.col("j"), F.lit(max(1, mix.slots)).cast("long"), keys)
    taken = F.least(F.lit(mix.block), F.col("words") - F.col("j") * mix.block)
    out = one.select(place.alias("place"), "number", block.alias("block"), taken.cast("long").alias("words"))
    return out.select(F.expr(f"place div {shard}").alias("shard"), (F.col("place") % shard).alias("slot"), "number", "block", "words")


def shard_counts(mix: Mix, shard: int = SHARD) -> DataFrame:
    """How many slots of each output shard each source fills: shard, number, n."""
    return slots(mix, shard).groupBy("shard", "number").agg(F.count("*").alias("n"))


def spans(mix: Mix) -> DataFrame:
    """Which words of which blocks documents fill: the columns of rows, block, low and high (places in the block)."""
    b, start, end = mix.block, F.col("start"), F.col("start") + F.col("size")
    each = mix.rows.where("size > 0").withColumn("block", F.explode(F.sequence(F.expr(f"start div {b}"), F.expr(f"(start + size - 1) div {b}"))))
    return each.withColumns({"low": F.greatest(start - F.col("block") * b, F.lit(0)), "high": F.least(end - F.col("block") * b, F.lit(b))})


def taken(mix: Mix) -> DataFrame:
    """Of each document: doc_id, source, size, source_size, target, taken."""
    keys = ["number", "start", "id", "source", "size", "source_size", "target"]
    n = F.greatest(F.least(F.col("high"), F.coalesce("words", F.lit(0))) - F.col("low"), F.lit(0))
    joined = spans(mix).select(*keys, "block", "low", "high").join(slots(mix).select("number", "block", "words").hint("merge"), ["number", "block"], "left")
    some = joined.groupBy(*keys).agg(F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("taken"))
    none = mix.rows.where("size = 0").select(*keys, F.lit(0).cast("long").alias("taken"))
    return some.unionByName(none).select(F.col("id").alias("doc_id"), "source", "size", "source_size", "target", "taken")


def mixed(mix: Mix, shard: int = SHARD) -> DataFrame:
    """The mix itself: shard, slot, source, block, words (an array, in the order of the source). plan() must have kept texts."""
    own = spans(mix).select("number", "source", "block", "low", F.expr(f"slice(words, int(block * {mix.block} + low - start) + 1, int(high - low))").alias("part"))
    blocks = own.groupBy("number", "source", "block").agg(F.sort_array(F.collect_list(F.struct("low", "part"))).alias("parts"))
    joined = slots(mix, shard).hint("merge").join(blocks.select("number", "source", "block", F.flatten("parts.part").alias("all")), ["number", "block"])
    return joined.select("shard", "slot", "source", "block", F.slice("all", F.lit(1), F.col("words").cast("int")).alias("words"))
