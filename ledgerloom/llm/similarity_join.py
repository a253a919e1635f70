"""N-gram Jaccard join with Bayesian candidate pruning.

Words are runs of letters, digits and characters beyond ASCII, after A-Z became a-z; a text's set holds its runs of five
words, or all its words as one if there are fewer. Two texts link if the Jaccard similarity of their sets is 0.8 or
more; equal texts link always.

1. Equal texts become one class representative with a count of its copies (by SHA-256 of the text).
2. Each representative has BANDS x ROWS MinHash values of eight bits. Representatives that agree in a whole band are
   candidates; at the threshold, a pair escapes all bands with a probability of about 3e-6.
3. Candidates that share a band take the least of them as home; a home with many shingles is dealt over blocks. A pair
   of blocks is a tile, and a representative is sent only to the tiles in which it has a candidate. So every pair is
   judged in one tile, large groups are spread, and no pair becomes a row. A task holds one tile at a time.
4. In a tile, MinHash values are compared some at a time. With a uniform prior, the posterior probability that the
   similarity reaches the threshold follows from the matches so far; a pair for which it falls below TOLERANCE is
   dropped. All others are verified exactly on their whole sets, of words that are told apart by their bytes.
5. A tile returns each representative's number of links and one edge to a root, not the pairs. Classes are the connected
   components of these edges, found by joins that pass the least label on until nothing changes. A class that most rows
   have is one row on one side of these joins, so Spark's handling of skewed joins splits the other side.

Cases: null text links nothing; texts without words link only to equal texts; copies count as links of each other;
repeated rows are documents of their own, so they link; rows without id belong to classes, too, and a class whose ids
are all null has a null id; an empty table gives no rows. Extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm._columns import named
from ledgerloom.llm._common import PLAIN_WORDS, U64, flat_text, groups, lower_ascii, mix, numbered, numbered_rows, order_id, powers, prefix_hash, slices, small_batches, split_words, tidy, written

THRESHOLD = 0.8
SHINGLE = 5
BANDS, ROWS = 32, 5
#: Posterior probability below which a pair is dropped.
TOLERANCE = 1e-6
#: MinHash values that are compared at a time.
STEP = 32
#: Shingles of a block, and of the tiles of one task.
BLOCK_SHINGLES = 1 << 18
TASK_SHINGLES = 1 << 20
_SALTS = np.random.default_rng(5).integers(1, 1 << 32, (2, BANDS * ROWS), dtype=np.int64).astype(np.uint32) | np.array([[0], [1]], np.uint32)
#: Shingles on which the hash functions work at a time, so that they stay in the processor's cache.
_CACHED = 1 << 14


def shingles(buf: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the texts' runs of words (repeated ones, too), and the n + 1 offsets of the texts in them."""
    _, _, word, bounds = split_words(lower_ascii(buf), offsets, PLAIN_WORDS)
    sums = prefix_hash(word)
    n = np.diff(bounds)
    count = np.where(n >= size, n - size + 1, (n > 0).astype(np.int64))
    out = np.concatenate([[0], np.cumsum(count)])
    start = np.repeat(bounds[:-1] - out[:-1], count) + np.arange(int(out[-1]))
    length = np.repeat(np.minimum(n, size), count)
    _, down = powers(len(sums))
    return mix((sums[start + length] - sums[start]) * down[start]), out


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The texts' distinct runs of words as numbers, the same for equal runs only, and the n + 1 offsets of the texts in them."""
    low = lower_ascii(buf)
    starts, ends, h, bounds = split_words(low, offsets, PLAIN_WORDS)
    word = numbered(low, starts, ends - starts, h) + 1
    n = np.diff(bounds)
    lack = np.where((n > 0) & (n < size), size - n, 0)  # a text of fewer words is filled up with a word that no text has
    word = np.insert(word, np.repeat(bounds[1:], lack), 0)
    at = bounds + np.concatenate([[0], np.cumsum(lack)])
    count = np.maximum(np.diff(at) - size + 1, 0)
    out = np.concatenate([[0], np.cumsum(count)])
    number = numbered_rows(word, np.repeat(at[:-1] - out[:-1], count) + np.arange(int(out[-1])), size)
    sets = [np.unique(number[a:b]) for a, b in zip(out[:-1].tolist(), out[1:].tolist(), strict=True)]
    return np.concatenate(sets) if sets else number, np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int64)


def signatures(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """MinHash values of eight bits: a row a text. bounds: of texts that all have shingles."""
    n, k = len(bounds) - 1, _SALTS.shape[1]
    least = np.full((k, n), 0xFFFFFFFF, np.uint32)
    low = (values >> U64(32)).astype(np.uint32)
    for a in range(0, len(low), _CACHED):
        x = low[a : a + _CACHED]
        first, last = int(np.searchsorted(bounds, a, "right")) - 1, int(np.searchsorted(bounds, a + len(x), "left"))
        at = np.maximum(bounds[first:last] - a, 0)
        for i in range(k):
            h = np.minimum.reduceat((x ^ _SALTS[0, i]) * _SALTS[1, i], at)
            np.minimum(least[i, first:last], h, out=least[i, first:last])
    mixed = (least ^ (least >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return np.ascontiguousarray((mixed >> np.uint32(24)).astype(np.uint8).T)


def needed_matches(values: int, step: int, threshold: float, tolerance: float) -> list[tuple[int, int]]:
    """(compared values, matches needed): with fewer, the posterior probability of the threshold is below the tolerance.

    A value of eight bits also matches by chance. With a uniform prior the posterior is a beta distribution, whose tail
    is a binomial sum.
    """
    t = threshold + (1 - threshold) / 256
    out = []
    for n in range(step, values + 1, step):
        tail, m = 0.0, -1
        while tail < tolerance:  # P(similarity >= t | m of n) = P(Bin(n + 1, t) <= m)
            m += 1
            tail += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append((n, m))
    return out


def links_of(i: int, others: np.ndarray, sig: np.ndarray, sets: np.ndarray, bounds: np.ndarray, mark: np.ndarray, needed: list[tuple[int, int]], threshold: float) -> np.ndarray:
    """Which of the others link with text i. sets: distinct shingle numbers of all texts; mark: one for each shingle, all False."""
    size = bounds[others + 1] - bounds[others]
    own = bounds[i + 1] - bounds[i]
    others = others[(size >= own * threshold - 1e-9) & (own >= size * threshold - 1e-9)]
    same, done = np.zeros(len(others), np.int64), 0
    for n, least in needed:
        if not len(others):
            return others
        same += (sig[others, done:n] == sig[i, done:n]).sum(1)
        ok = same >= least
        others, same, done = others[ok], same[ok], n
    if not len(others):
        return others
    mark[sets[bounds[i] : bounds[i + 1]]] = True
    size = bounds[others + 1] - bounds[others]
    at = np.cumsum(size) - size
    common = np.add.reduceat(mark[sets[np.repeat(bounds[others] - at, size) + np.arange(int(size.sum()))]], at, dtype=np.int64)
    mark[sets[bounds[i] : bounds[i + 1]]] = False
    return others[common >= threshold * (own + size - common) - 1e-9]


def judge_tile(n: int, left: np.ndarray, right: np.ndarray, copies: np.ndarray, sig: np.ndarray, sets: np.ndarray, bounds: np.ndarray, needed: list[tuple[int, int]], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Of each text of a tile the documents that it links with, and the root of its component there. left, right: the sides that texts are on."""
    total, root = np.zeros(n, np.int64), np.arange(n)
    mark = np.zeros(int(sets.max(initial=0)) + 1, bool)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return int(x)

    one_block = bool((left & right).all())
    rights = np.flatnonzero(right)
    for i in np.flatnonzero(left).tolist():
        got = links_of(i, rights[rights > i] if one_block else rights, sig, sets, bounds, mark, needed, threshold)
        if not len(got):
            continue
        total[i] += copies[got].sum()
        total[got] += copies[i]
        a = find(i)
        for j in np.unique(root[got]).tolist():
            b = find(j)
            if a != b:
                a, b = min(a, b), max(a, b)
                root[b] = a
    return total, np.array([find(i) for i in range(n)], np.int64)


def signature(text: Column, size: int) -> Column:
    """Number of shingles (n) and MinHash values (sig; null without words) of each text."""

    def sign(texts: pa.Array) -> pa.Array:
        buf, off = flat_text(texts)
        counts, sigs = [], []
        for i, j in slices(off):
            values, bounds = shingles(buf[off[i] : off[j]], off[i : j + 1] - off[i], size)
            count = np.diff(bounds)
            has = np.flatnonzero(count)
            rows = signatures(values, np.append(bounds[:-1][has], bounds[-1])) if len(has) else np.zeros((0, BANDS * ROWS), np.uint8)
            sig: list[bytes | None] = [None] * (j - i)
            for k, r in zip(has.tolist(), rows, strict=True):
                sig[k] = r.tobytes()
            counts.append(count)
            sigs += sig
        tidy()
        return pa.StructArray.from_arrays([pa.array(np.concatenate(counts) if counts else np.zeros(0, np.int64), pa.int64()), pa.array(sigs, pa.binary())], names=["n", "sig"])

    return F.arrow_udf(sign, "n long, sig binary")(text)


def _components(edges: DataFrame) -> DataFrame:
    """edges: key, root (a key, too). Returns key, label: equal for the keys of a component. Labels shrink until none changes."""
    state = written(edges.groupBy("key").agg(F.min("root").alias("label")), "labels")
    edges = written(edges.join(edges.groupBy("key").count().where(F.col("count") > 1).select("key"), "key", "left_semi"), "edges")
    if edges.isEmpty():
        return state
    while True:
        # a root's label is the least of its keys' labels; a key takes the least of its roots' labels, and then the label of its label
        known = edges.join(state, "key").groupBy("root").agg(F.min("label").alias("least"))
        offered = edges.join(known, "root").groupBy("key").agg(F.min("least").alias("least"))
        step = written(state.join(offered, "key", "left").join(known.select(F.col("root").alias("label"), F.col("least").alias("jump")), "label", "left").select("key", "label", F.least("label", "least", "jump").alias("next")), "labels")
        changed = not step.where("next < label").isEmpty()
        after = step.groupBy("label").agg(F.min("next").alias("lower"))  # a label that shrank anywhere shrinks everywhere
        state = written(step.join(after, "label").select("key", F.least("next", "lower").alias("label")), "labels")
        if not changed:
            return state


def judge_tiles(batches: Iterator[pa.RecordBatch], size: int, threshold: float, needed: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    """Tiles, whose rows lie together, one at a time: key, links, root of every text that links."""

    def judged(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        sets, bounds = shingle_sets(*flat_text(rows["text"]), size)
        sig = np.frombuffer(b"".join(rows["sig"].to_pylist()), np.uint8).reshape(len(rows), -1)
        total, root = judge_tile(len(rows), rows["is_left"].to_numpy(), rows["is_right"].to_numpy(), rows["copies"].to_numpy(), sig, sets, bounds, needed, threshold)
        del sets, sig
        tidy()
        some = np.flatnonzero(total)
        key = rows["key"].combine_chunks()
        return pa.RecordBatch.from_arrays([key.take(pa.array(some)), pa.array(total[some]), key.take(pa.array(root[some]))], names=["key", "links", "root"])

    held: list[pa.RecordBatch] = []
    tile: tuple[int, int] | None = None
    for batch in batches:
        a, b = batch.column("a").to_numpy(), batch.column("b").to_numpy()
        for i, j in zip(*groups(a, b), strict=True):
            if held and (a[i], b[i]) != tile:
                yield judged(pa.Table.from_batches(held))
                held = []
            tile = (a[i], b[i])
            held.append(batch.slice(i, j - i))
    if held:
        yield judged(pa.Table.from_batches(held))


def classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, size: int = SHINGLE, tolerance: float = TOLERANCE, keep: bool = False) -> tuple[DataFrame, DataFrame]:
    """A table of all rows (row, key of the text, doc_id, text, n, sig, and with keep their columns as d), and of each key: key, class (a key), class_id, n_links."""
    small_batches(docs.sparkSession)
    text = F.col(text_col)
    slim = docs.select(F.monotonically_increasing_id().alias("row"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("key"), F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), *[F.struct(*[named(c) for c in docs.columns if c != text_col]).alias("d")] * (keep and len(docs.columns) > 1))
    signed = written(slim.withColumn("s", signature(F.col("text"), size)).select(*slim.columns, "s.n", "s.sig"), "signed")
    whole = signed.where("key is not null")
    one = whole.groupBy("key").agg(F.count("*").alias("copies"), F.min("doc_id").alias("low"), F.min("row").alias("row"))
    reps = written(one.join(whole.select("row", "n", "sig"), "row"), "reps")

    # bands that at least two representatives share
    band = F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring(F.col("sig"), i * ROWS + 1, F.lit(ROWS))))).alias("band")
    banded = reps.where("sig is not null").select("key", F.xxhash64("key").alias("name"), band)
    common = banded.groupBy("band").agg(F.count("*").alias("many"), F.min("name").alias("home")).where("many > 1")
    shared = written(banded.join(common.select("band", "home"), "band").select("band", "key", "home"), "shared")
    homes = shared.groupBy("key").agg(F.min("home").alias("home")).join(reps.select("key", "n"), "key")
    blocks = homes.groupBy("home").agg(F.greatest(F.ceil(F.sum("n") / BLOCK_SHINGLES), F.lit(1)).alias("blocks"))
    placed = homes.join(blocks, "home").select("key", F.xxhash64("home", F.pmod(F.xxhash64("key", F.lit(3)), F.col("blocks"))).alias("block"))
    members = written(shared.select("band", "key").join(placed, "key"), "members")
    there = members.groupBy("band", "block").agg(F.count("*").alias("many"))
    # a band that one block holds alone is one tile there; a representative meets a block for one of its bands at most
    met = members.join(there.withColumnRenamed("block", "other"), "band").where((F.col("block") != F.col("other")) | (F.col("many") > 1))
    jobs = met.select("key", "block", "other").distinct().select("key", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), (F.col("block") <= F.col("other")).alias("is_left"), (F.col("block") >= F.col("other")).alias("is_right"))
    jobs = written(jobs.join(reps.select("key", "row", "n", "copies", "sig"), "key"), "jobs")

    tasks = int(max(1, -(-(jobs.agg(F.sum("n").alias("n")).first()["n"] or 0) // TASK_SHINGLES)))
    needed = needed_matches(BANDS * ROWS, STEP, threshold, tolerance)
    sent = jobs.join(whole.select("row", "text"), "row").select("a", "b", "key", "is_left", "is_right", "copies", "sig", "text")
    dealt = sent.repartition(tasks, "a", "b").sortWithinPartitions("a", "b", "key")
    found = written(dealt.mapInArrow(lambda x: judge_tiles(x, size, threshold, needed), "key binary, links long, root binary"), "links")
    total = found.groupBy("key").agg(F.sum("links").alias("links"))
    labels = _components(found.select("key", "root"))
    lows = reps.select("key", "low").join(labels, "key").groupBy("label").agg(F.min("low").alias("class_low"))
    by_key = reps.select("key", "copies", "low").join(total, "key", "left").join(labels.join(lows, "label").select("key", "label", "class_low"), "key", "left")
    by_key = by_key.select("key", F.coalesce("label", "key").alias("class"), F.coalesce("class_low", "low").alias("class_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    return signed, by_key


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how: object) -> DataFrame:
    """doc_id, class_id (least id of the class), n_links (documents that the document itself links with): one row a document."""
    signed, by_key = classes(docs, id_col=id_col, text_col=text_col, **how)
    found = signed.select("doc_id", "key").join(by_key, "key").select("doc_id", "class_id", "n_links")
    return found.unionAll(signed.where("key is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links")))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how: object) -> DataFrame:
    """One document of each class, with all its columns: the one of the least id (null comes last). Documents with null text stay."""
    signed, by_key = classes(docs, id_col=id_col, text_col=text_col, keep=True, **how)
    # the first row of each key, then of each class
    own = signed.where("key is not null").groupBy("key").agg(F.min(F.struct(order_id("doc_id").alias("id"), "row")).alias("first"))
    first = own.join(by_key.select("key", "class"), "key").groupBy("class").agg(F.min("first")["row"].alias("row")).select("row")
    kept = signed.join(first.unionAll(signed.where("key is null").select("row")), "row", "left_semi")
    return kept.select(*[F.col("text").alias(c) if c == text_col else F.col("d").getField(c).alias(c) for c in docs.columns])
