"""Exact top-k search by inner product with ball trees.

Vectors lie in shards by a hash of their id. Each shard builds a ball tree, whose inner nodes and leaves are balls; an
upper bound of a query's inner product with any vector of a node is q.c + |q| r. Every query goes down by itself: of the
nodes it has met it opens the one with the highest bound, an inner node for its two children, a leaf for its vectors, and
it ends when no bound reaches its kth score. That score is shared: shards are searched in rounds of growing size (1, then
GROWTH times as many as before), and each round starts from the kth scores of all rounds before it, so later shards answer
only with vectors that can still enter. The query set, as it is stated, goes to each shard in blocks; a task takes a
bounded number of blocks.

Scores are integers: components are floor(scale * x). They are exact while |q||v| stays below 2^53 (checked; beyond, the
products are taken in whole numbers, up to 2^63). Bounds are widened by their rounding error, so pruning loses nothing.

Cases: vectors that are null or empty, or hold null or non-finite components, take no part, neither as query nor as
candidate; neither do rows without id; a query skips the rows of its own id; ties go to the smaller id; of rows that
share an id each is a candidate, and a repeated query row is one query (the smallest vector); vectors of another
dimension than the query's are no candidates for it; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm._common import groups, tidy, written

LEAF = 128
SHARD_ROWS = 8192
BLOCK = 512
#: Blocks of queries that a task takes; how many times as many shards a round has as all before it.
TASK_BLOCKS = 32
GROWTH = 3
RESULT = "dim int, query_id long, vec_id long, score long"
_EXACT = float(1 << 53)


def whole_components(vector: Column, scale: int) -> Column:
    """floor(scale * x) of all components; null if the vector takes no part."""
    ok = F.size(vector) > 0
    ok = ok & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(ok, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


class BallTree:
    """Balls of centre and radius, the root first. left, right: children of an inner node, -1 in a leaf; a leaf has the vectors order[low:high], at most LEAF."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors.astype(np.float64)
        centre, radius, left, right, low, high, order = [], [], [], [], [], [], []
        todo = [(np.arange(len(vectors)), -1, False)]
        at = 0
        while todo:
            own, parent, is_right = todo.pop()
            node, x = len(centre), self.vectors[own]
            if parent >= 0:
                (right if is_right else left)[parent] = node
            away = x - (c := x.mean(0))
            norm = np.sqrt(np.einsum("ij,ij->i", away, away))
            centre.append(c)
            radius.append(norm.max(initial=0.0))
            left.append(-1)
            right.append(-1)
            low.append(at)
            if len(own) <= LEAF:
                order.append(own)
                at += len(own)
            else:
                far = x[norm.argmax()]
                other = x[np.linalg.norm(x - far, axis=1).argmax()]
                by = np.argsort(x @ (other - far), kind="stable")  # half and half, so that equal vectors split, too
                half = len(by) // 2
                todo += [(own[by[half:]], node, True), (own[by[:half]], node, False)]
            high.append(at)
        self.centre, self.radius = np.array(centre), np.array(radius)
        self.left, self.right, self.low, self.high = (np.array(x, np.int64) for x in (left, right, low, high))
        self.order = np.concatenate(order)
        self.reach = np.linalg.norm(self.centre, axis=1) + self.radius

    def bounds(self, queries: np.ndarray, norm: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Upper bound of each query's inner product with the vectors of its node."""
        slack = norm * self.reach[node] * 1e-9 + 1e-6
        return np.einsum("ij,ij->i", queries, self.centre[node]) + norm * self.radius[node] + slack


def search(tree: BallTree, ids: np.ndarray, exact: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Row of the query, id and score of at most k vectors a query that reach its least score, ties to smaller ids; and how many nodes were opened."""
    q = queries.astype(np.float64)
    norm = np.linalg.norm(q, axis=1)
    whole = norm.max(initial=0) * tree.reach[0] >= _EXACT
    row, name, score = (np.zeros(0, np.int64) for _ in range(3))
    least, opened = least.copy(), 0
    bound = np.full((len(q), len(tree.centre)), -np.inf)  # of the nodes that a query has met and not opened
    bound[:, 0] = tree.bounds(q, norm, np.zeros(len(q), np.int64))
    active = np.arange(len(q))
    while len(active):
        node = bound[active].argmax(1)
        best = bound[active, node]
        go = (best > -np.inf) & (best >= least[active])
        active, node = active[go], node[go]
        bound[active, node] = -np.inf
        opened += len(active)
        inner = tree.left[node] >= 0
        rows = active[inner]
        for child in (tree.left[node[inner]], tree.right[node[inner]]):
            b = tree.bounds(q[rows], norm[rows], child)
            ok = b >= least[rows]
            bound[rows[ok], child[ok]] = b[ok]
        rows, leaf = active[~inner], node[~inner]
        by = np.argsort(leaf, kind="stable")
        rows, leaf = rows[by], leaf[by]
        found = []
        for a, c in zip(*groups(leaf), strict=True):
            own, some = tree.order[tree.low[leaf[a]] : tree.high[leaf[a]]], rows[a:c]
            got = queries[some] @ exact[own].T if whole else np.rint(q[some] @ tree.vectors[own].T).astype(np.int64)
            i, j = np.nonzero((got >= least[some][:, None]) & (ids[own][None, :] != query_ids[some][:, None]))
            found.append((some[i], ids[own[j]], got[i, j]))
        if found:
            more = [np.concatenate(x) for x in zip(*found, strict=True)]
            row, name, score = np.append(row, more[0]), np.append(name, more[1]), np.append(score, more[2])
            by = np.lexsort((name, -score, row))
            row, name, score = row[by], name[by], score[by]
            at, to = groups(row)
            rank = np.arange(len(row)) - np.repeat(at, to - at)
            kth = rank == k - 1
            least[row[kth]] = np.maximum(least[row[kth]], score[kth])
            row, name, score = row[rank < k], name[rank < k], score[rank < k]
    ok = score >= least[row]
    return row[ok], name[ok], score[ok], opened


def _answers(vectors: pa.Table, blocks: pa.Table, k: int) -> pa.Table:
    """A shard's answers to all blocks of queries."""
    out: list[pa.Table] = []
    tidy()
    if len(vectors) and len(blocks):
        dim = vectors["dim"][0].as_py()
        ids = vectors["vec_id"].to_numpy()
        exact = vectors["v"].combine_chunks().flatten().to_numpy().reshape(len(ids), dim)
        tree = BallTree(exact)
        for names, least, packed in zip(blocks["ids"], blocks["least"], blocks["v"], strict=True):
            names, least = np.frombuffer(names.as_py(), np.int64), np.frombuffer(least.as_py(), np.float64)
            queries = np.frombuffer(packed.as_py(), np.int64).reshape(len(names), dim)
            row, name, score, _ = search(tree, ids, exact, queries, names, least, k)
            out.append(pa.table({"dim": pa.array(np.full(len(row), dim, np.int32)), "query_id": names[row], "vec_id": name, "score": score}))
    return pa.concat_tables(out) if out else pa.table({"dim": pa.array([], pa.int32()), "query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, *, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: of every query the k best vectors, all if there are fewer."""
    pick = lambda df: df.select(F.col(id_col).cast("long").alias("vec_id"), whole_components(F.col(vector_col), scale).alias("v")).where("vec_id is not null and v is not null").withColumn("dim", F.size("v"))
    table = written(pick(vectors), "vectors")
    shards = max(1, -(-table.count() // shard_rows))
    table = table.withColumn("shard", F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).cast("int"))
    asked = pick(queries).groupBy("vec_id").agg(F.min_by(F.struct("v", "dim"), F.struct("v")).alias("q")).select("vec_id", "q.v", "q.dim")
    asked = written(asked, "queries")
    n_blocks = max(1, -(-asked.count() // BLOCK))

    def pack(rows: pa.Table) -> pa.Table:
        v = rows["v"].combine_chunks().flatten().to_numpy()
        return pa.table({"dim": rows["dim"].slice(0, 1), "block": rows["block"].slice(0, 1), "ids": [rows["vec_id"].to_numpy().tobytes()], "least": [rows["least"].to_numpy().tobytes()], "v": [v.tobytes()]})

    n_tasks = -(-n_blocks // TASK_BLOCKS)
    low = F.lit(float("-inf"))
    by_query = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    answer = lambda a, b: _answers(a, b, k)
    best: DataFrame | None = None
    first, many = 0, 1
    while first < shards:
        last = min(shards, first + many) - 1
        least = asked.withColumn("least", low)
        if best is not None:
            kth = best.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("s"))
            least = asked.join(kth, "vec_id", "left").select("vec_id", "v", "dim", F.coalesce("s", low).alias("least"))
        block = F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)).cast("int").alias("block")
        packed = least.select("vec_id", "v", "dim", "least", block).groupBy("dim", "block").applyInArrow(pack, "dim int, block int, ids binary, least binary, v binary")
        sent = packed.select("dim", "ids", "least", "v", F.floor(F.col("block") / TASK_BLOCKS).alias("task"), F.explode(F.sequence(F.lit(first), F.lit(last))).alias("shard"))
        held = table.where(F.col("shard").between(first, last)).withColumn("task", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_tasks - 1).cast("long"))))
        found = held.groupBy("shard", "dim", "task").cogroup(sent.groupBy("shard", "dim", "task")).applyInArrow(answer, RESULT).select("query_id", "vec_id", "score")
        if best is not None:
            found = found.unionAll(best.select("query_id", "vec_id", "score"))
        best = found.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        first, many = last + 1, GROWTH * (last + 1)
        if first < shards:
            best = written(best, "best")
    return best
