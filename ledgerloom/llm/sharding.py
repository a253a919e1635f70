"""Sharding by balanced label propagation.

Documents that share a link key are neighbours (a document may have several keys). They start in shards by a hash of
their row; then, round after round, joins count each document's neighbours by shard, and it asks to move to the shard
that holds the most of them. Moves are granted in the order of their gain, as far as the quota of linked documents a
shard (its even share of all rows) allows after the moves out of it. At the end every shard is filled or trimmed to its
exact share: unlinked documents, whose moves cut no link, go first. So row counts differ by one at most, and links are
cut only where a group is larger than the room.

A key is never gathered in one task: neighbours are counted by (key, shard), so a key has as many rows as there are
shards, and its documents meet those by a join that Spark can split. Grants are decided on counts by (from, to, gain
step, slice), whose number is bounded whatever the corpus.

Cases: a document without keys, or whose keys nobody shares, has no neighbours; null keys link nothing; repeated rows
are documents of their own; a null id stays null; fewer rows than shards leave shards empty; an empty table gives no
rows. Extra columns pass; columns named shard or slot are replaced.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm._common import written

#: Rounds at most; it ends before, when hardly any document moves.
ROUNDS = 12
#: Moves of one gain are granted in slices of their documents.
SLICES = 16
GAIN_STEPS = 40
#: Rows of a shard that are ranked in one task.
RANKED = 50_000


def quotas(n: int, shards: int) -> np.ndarray:
    """Even shares: they differ by one at most."""
    return np.array([n // shards + (s < n % shards) for s in range(shards)], np.int64)


def grants(asked: list[tuple[int, int, int, int, int]], load: np.ndarray, quota: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Which of the asked moves (from, to, gain step, slice, documents) are granted: by gain, and so that no shard ends above its quota.

    All are granted at first; as long as a shard would hold too many, its least gains are refused, and those stay where
    they were, which may fill another one.
    """
    if not asked:
        return []
    a = np.array(asked, np.int64)
    a = a[np.lexsort((a[:, 0], a[:, 3], -a[:, 2]))]
    ok = np.ones(len(a), bool)
    shards = len(load)
    into = [np.flatnonzero(a[:, 1] == s) for s in range(shards)]
    while True:
        moved_in = np.bincount(a[ok, 1], a[ok, 4], shards)
        moved_out = np.bincount(a[ok, 0], a[ok, 4], shards)
        over = np.flatnonzero((load + moved_in - moved_out > quota) & (moved_in > 0))
        if not len(over):
            return [tuple(x) for x in a[ok, :4].tolist()]
        for s in over:
            room = quota[s] - load[s] + moved_out[s]
            own = into[s][ok[into[s]]]
            fits = np.cumsum(a[own, 4]) <= max(room, 0)
            ok[own[~fits]] = False


def _element(values: np.ndarray, at: Column) -> Column:
    """values[at], as an array literal of one number a shard."""
    return F.element_at(F.array(*[F.lit(int(v)) for v in values]), at + 1)


def propagate(linked: DataFrame, shards: int, quota: np.ndarray, rounds: int = ROUNDS) -> DataFrame:
    """linked: rid, key, shard (a document's rows share rid and shard). Returns rid, shard after the moves; a table."""
    state = written(linked, "linked")
    n = state.agg(F.count_distinct("rid").alias("n")).first()["n"]
    idle = 0
    for turn in range(rounds):
        one = state.groupBy("rid").agg(F.first("shard").alias("shard"))
        load = np.zeros(shards, np.int64)
        for r in one.groupBy("shard").count().collect():  # one row a shard
            load[r["shard"]] = r["count"]
        # summed by (key, shard) first: the partial counts of a key that many documents have are spread over the shards
        counted = state.groupBy("key", "shard").count().withColumnsRenamed({"shard": "to", "count": "n"}).repartition("key")
        own = F.col("to") == F.col("shard")
        near = state.join(counted, "key")
        if turn % 2:  # who was refused looks for another shard
            near = near.where(own | ~F.col("to").isin([int(s) for s in np.flatnonzero(load >= quota)]))
        near = near.groupBy("rid", "shard", "to").agg(F.sum("n").alias("n"), F.min("key").alias("key"))
        # in a tie the key decides, so that all documents of a group lean one way
        rank = F.struct("n", F.xxhash64("key", "to").alias("tie"), "to")
        best = near.groupBy("rid", "shard").agg(F.max(rank).alias("best"), F.max(F.when(own, F.col("n"))).alias("here"))
        wants = best.select("rid", "shard", F.col("best.to").alias("to"), (F.col("best.n") - F.col("here")).alias("gain")).where(F.col("to") != F.col("shard"))
        step = F.least(F.lit(GAIN_STEPS - 1), F.floor(F.log2(F.col("gain") + 1.0) * 2)).cast("int")
        wants = written(wants.select("rid", "shard", "to", step.alias("step"), F.pmod(F.xxhash64("rid"), F.lit(SLICES)).cast("int").alias("slice")), "wants")
        asked = [tuple(r) for r in wants.groupBy("shard", "to", "step", "slice").count().collect()]  # bounded by shards, steps and slices
        granted = grants(asked, load, quota)
        allowed = set(granted)
        idle = idle + 1 if sum(x[4] for x in asked if x[:4] in allowed) <= n // 1000 else 0
        if granted:
            given = state.sparkSession.createDataFrame(granted, "shard int, to int, step int, slice int")
            moves = wants.join(F.broadcast(given), ["shard", "to", "step", "slice"]).select("rid", F.col("to").alias("next"))
            state = written(state.join(moves, "rid", "left").select("rid", "key", F.coalesce("next", "shard").alias("shard")), "linked")
        if idle == 2 or not asked:
            break
    return written(state.groupBy("rid").agg(F.first("shard").alias("shard")), "labels")


def fill(rows: DataFrame, shards: int, quota: np.ndarray) -> DataFrame:
    """rows: rid, free (no link to cut), shard. Sets shard and slot so that every shard has its quota: what lies beyond it, free rows first, goes to shards with room."""
    n = int(quota.sum())
    salts = max(1, n // (shards * RANKED))
    salted = written(rows.withColumn("salt", F.pmod(F.xxhash64("rid"), F.lit(salts)).cast("int")), "salted")
    counts = salted.groupBy("shard", "free", "salt").count()
    before = Window.partitionBy("shard").orderBy("free", "salt").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("shard", "free", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    have = np.zeros(shards, np.int64)
    for r in counts.groupBy("shard").agg(F.sum("count").alias("n")).collect():  # one row a shard
        have[r["shard"]] = r["n"]
    extra, room = np.maximum(have - quota, 0), np.maximum(quota - have, 0)
    extra_before, room_end = np.cumsum(extra) - extra, np.cumsum(room)
    own = Window.partitionBy("shard", "free", "salt").orderBy("rid")
    ranked = salted.withColumn("own", F.row_number().over(own)).join(base, ["shard", "free", "salt"]).select("rid", "shard", (F.col("own") - 1 + F.col("base")).alias("rank"))
    shard = F.col("shard")
    left_over = F.col("rank") - _element(quota, shard)
    place = F.when(left_over >= 0, left_over + _element(extra_before, shard))  # among all that must go
    to = sum(((place >= int(x)).cast("int") for x in room_end[1:]), (place >= int(room_end[0])).cast("int"))
    ranked = ranked.select("rid", "shard", "rank", place.alias("place"), to.alias("to"))
    slot = F.col("place") - _element(room_end - room, F.col("to")) + _element(np.minimum(have, quota), F.col("to"))
    moved = F.col("place").isNotNull()
    return ranked.select("rid", F.when(moved, F.col("to")).otherwise(shard).alias("shard"), F.when(moved, slot).otherwise(F.col("rank")).cast("long").alias("slot"))


def balanced_shards(docs: DataFrame, shards: int, *, links_col: str = "links", rounds: int = ROUNDS) -> DataFrame:
    """All columns of docs but links_col (an array of link keys, longs), and shard (0 to shards - 1), slot (gapless from 0 in each shard)."""
    keep = [c for c in docs.columns if c != links_col]
    numbered = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)], F.col(links_col).alias("links"), F.monotonically_increasing_id().alias("rid"))
    table = written(numbered, "documents")
    quota = quotas(table.count(), shards)
    pairs = table.select("rid", F.explode(F.array_distinct("links")).alias("key")).where("key is not null")
    # a table of its own, so that Spark can split a key that many documents have
    shared = written(pairs.groupBy("key").count().where(F.col("count") > 1).select("key"), "shared")
    start = F.pmod(F.xxhash64("rid", F.lit(1)), F.lit(shards)).cast("int")
    labels = propagate(pairs.join(shared, "key", "left_semi").select("rid", "key", start.alias("shard")), shards, quota, rounds)
    rows = table.select("rid").join(labels, "rid", "left").select("rid", F.col("shard").isNull().alias("free"), F.coalesce("shard", start).alias("shard"))
    placed = fill(rows, shards, quota).alias("p")
    names = [*keep, *[x for x in ("shard", "slot") if x not in keep]]
    out = table.join(placed, "rid")
    columns = [F.col(f"c{i}").alias(c) for i, c in enumerate(keep) if c not in ("shard", "slot")]
    return out.select(*columns, F.col("p.shard").alias("shard"), F.col("p.slot").alias("slot")).select(*[f"`{x}`" for x in names])
