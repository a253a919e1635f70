"""Token-ID shard files with a minimal perfect hash index.

Each shard holds the documents of a range of ids, in ascending id order, as raw little-endian ids (16 bits where the
vocabulary allows, else 32). A shard file is header, index, keys, offsets and payload. The index is a minimal perfect
hash: levels of bit arrays, in each of which the keys that collide go on to the next; a key's slot is the rank of its
bit. The slot's 32-bit fingerprint turns foreign keys away (one in 2^32 passes, and the key itself is compared), and its
row gives the place in the payload, so that a keyed read needs a constant number of probes. Shards are cut by bytes of
text, whatever ids the rows have; their table says which keys a shard holds from and to, so a keyed read opens the
shards that can hold its keys only, and of these it reads the index and the documents asked for.

Cases: null or empty text has the end ids only; rows that share an id lie next to each other, ordered by text
(see over_ranges()), and a keyed read returns all of them; rows without id come last and have no
key; an empty table writes no shard. Extra columns are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm._common import LAST_ID, U64, WITHIN, flat_text, groups, mix, over_ranges, put_file, scratch, tidy
from ledgerloom.llm._tokens import encoder

MAGIC = b"LLTOKEN1"
#: Bits of a level for each key that reaches it.
SPREAD = 1.5
MANIFEST = "shard long, n_rows long, n_tokens long, n_bytes long, low long, high long"


def _level_hash(keys: np.ndarray, level: int) -> np.ndarray:
    return mix(keys.view(U64) + U64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys.view(U64) ^ U64(0xA5A5A5A5A5A5A5A5)) >> U64(32)).astype(np.uint32)


def build_mph(keys: np.ndarray) -> list[np.ndarray]:
    """The levels' bit arrays, as 64-bit words, for distinct int64 keys."""
    levels, left = [], keys
    while len(left):
        bits = -(-int(len(left) * SPREAD + 1) // 64) * 64
        at = (_level_hash(left, len(levels)) % U64(bits)).astype(np.int64)
        alone = np.bincount(at, minlength=bits) == 1
        levels.append(np.packbits(alone, bitorder="little").view("<u8"))
        left = left[~alone[at]]
    return levels


def slot_of(levels: list[np.ndarray], keys: np.ndarray) -> np.ndarray:
    """The slot of each key, below the number of keys; -1 for a key that no level holds."""
    slot = np.full(len(keys), -1, np.int64)
    open_, base = np.arange(len(keys)), 0
    for n, words in enumerate(levels):
        ones = np.bitwise_count(words).astype(np.int64)
        rank = np.cumsum(ones) - ones
        if len(open_):
            at = (_level_hash(keys[open_], n) % U64(len(words) * 64)).astype(np.int64)
            bit = (at & 63).astype(U64)
            word = words[at >> 6]
            here = (word >> bit) & U64(1) == 1
            below = np.bitwise_count(word & ((U64(1) << bit) - U64(1))).astype(np.int64)
            slot[open_[here]] = base + (rank[at >> 6] + below)[here]
            open_ = open_[~here]
        base += int(ones.sum())
    return slot


def pack_shard(keys: np.ndarray, n_null: int, ids: np.ndarray, bounds: np.ndarray) -> bytes:
    """A shard file. keys: of all rows, ascending; the last n_null rows have none."""
    keyed = keys[: len(keys) - n_null]
    first, _ = groups(keyed)
    own = keyed[first]
    levels = build_mph(own)
    slot = slot_of(levels, own)
    marks, rows = np.zeros(len(own), "<u4"), np.zeros(len(own), "<u4")
    marks[slot], rows[slot] = fingerprints(own), first
    head = np.array([len(keys), n_null, len(own), ids.dtype.itemsize, len(levels), *(len(x) for x in levels)], "<i8")
    return b"".join([MAGIC, head.tobytes(), *(x.tobytes() for x in levels), marks.tobytes(), rows.tobytes(), keys.astype("<i8").tobytes(), bounds.astype("<i8").tobytes(), np.ascontiguousarray(ids, f"<u{ids.dtype.itemsize}").tobytes()])


class Shard:
    """A shard file's index, keys and offsets, and the way to its ids. file: a random access file, of which only what is asked for is read."""

    def __init__(self, file: pa.NativeFile):
        self.file, at = file, 8
        if file.read_at(8, 0) != MAGIC:
            raise ValueError("not a token shard")

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            x = np.frombuffer(file.read_at(n * np.dtype(kind).itemsize, at), kind)
            at += x.nbytes
            return x

        n, self.n_null, own, self.width, n_levels = take("<i8", 5).tolist()
        self.levels = [take("<u8", m) for m in take("<i8", n_levels).tolist()]
        self.marks, self.rows, self.keys, self.bounds = take("<u4", own), take("<u4", own), take("<i8", n), take("<i8", n + 1)
        self.payload = at

    def first_rows(self, keys: np.ndarray) -> np.ndarray:
        """The first row of each key by the index; -1 where the shard doesn't hold it."""
        slot = slot_of(self.levels, keys)
        row = np.full(len(keys), -1, np.int64)
        if len(self.marks):
            ok = (slot >= 0) & (self.marks[slot.clip(min=0)] == fingerprints(keys))
            row[ok] = self.rows[slot[ok]]
            row[ok & (self.keys[row.clip(min=0)] != keys)] = -1
        return row

    def ids(self, row: int, to: int | None = None) -> np.ndarray:
        """The ids of a row, or of the rows up to another."""
        a, b = self.bounds[row].item(), self.bounds[row + 1 if to is None else to].item()
        return np.frombuffer(self.file.read_at((b - a) * self.width, self.payload + a * self.width), f"<u{self.width}")


def write_token_files(docs: DataFrame, out_dir: str, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", end_ids: tuple[int, ...] = (0,), shard_bytes: int = 8 << 20, special: bool = False) -> DataFrame:
    """Encodes whole texts, writes shard files of about shard_bytes of text to out_dir/shards and their table to out_dir/manifest; returns that table.

    special: whether special tokens that a text spells out become their ids, as is the library's default; else they are plain text.

    A shard is written under a name of its attempt and then renamed, so a task that runs twice leaves one file.
    """
    ends = list(end_ids)

    def write(shard: int, rows: pa.Table) -> dict:
        ids, bounds = encoder(tokenizer, special).encode(*flat_text(rows["text"]), ends)
        keys, n_null = rows["id"].combine_chunks().fill_null(LAST_ID).to_numpy(), rows["id"].null_count
        data = pack_shard(keys, n_null, ids, bounds)
        put_file(f"{out_dir}/shards", f"{shard:016d}.tok", data)
        low, high = (int(keys[0]), int(keys[len(keys) - n_null - 1])) if len(keys) > n_null else (None, None)
        return {"shard": shard, "n_rows": len(keys), "n_tokens": len(ids), "n_bytes": len(data), "low": low, "high": high}

    over_ranges(docs, id_col, text_col, (), shard_bytes, write, MANIFEST).write.parquet(f"{out_dir}/manifest")
    return _manifest(docs.sparkSession, out_dir)


def _manifest(spark: SparkSession, out_dir: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{out_dir}/manifest")


def _shard(out_dir: str, shard: int) -> Shard:
    store, path = fs.FileSystem.from_uri(f"{out_dir}/shards")
    return Shard(store.open_input_file(f"{path}/{shard:016d}.tok"))


def read_token_files(spark: SparkSession, out_dir: str, *, with_ids: bool = False) -> DataFrame:
    """Every row from the files: doc_id, shard, start (ids before it in the whole set), n_tokens, ids_crc32, and the ids if asked for.

    Rows are found by key through the index, not by their place.
    """
    schema = "doc_id long, shard long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    # starts in two steps: of the partitions that wrote shards, then of the shards of each
    shards, group = _manifest(spark, out_dir), F.shiftright("shard", WITHIN)
    part = shards.groupBy(group.alias("part")).agg(F.sum("n_tokens").alias("n"))
    part = part.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    own = F.sum("n_tokens").over(Window.partitionBy(group).orderBy("shard")) - F.col("n_tokens")
    numbered = shards.select("shard", "n_tokens", own.alias("own"), group.alias("part")).join(part, "part").select("shard", (F.col("own") + F.col("before")).alias("base"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                s = _shard(out_dir, shard)
                keyed = s.keys[: len(s.keys) - s.n_null]
                row = s.first_rows(keyed)
                if (row < 0).any():
                    raise ValueError(f"shard {shard}: the index misses a key")
                head, to = groups(keyed)
                row = np.concatenate([row + np.arange(len(keyed)) - np.repeat(head, to - head), np.arange(len(keyed), len(s.keys))])
                ids, wide = s.ids(0, len(s.keys)), [s.bounds[r : r + 2].tolist() for r in row.tolist()]
                out = {
                    "doc_id": pa.array(s.keys[row], mask=np.arange(len(row)) >= len(keyed)), "shard": pa.array(np.full(len(row), shard, np.int64)),
                    "start": pa.array(base + s.bounds[row]), "n_tokens": pa.array(s.bounds[row + 1] - s.bounds[row]), "ids_crc32": pa.array([zlib.crc32(ids[x:y].astype("<u4")) for x, y in wide], pa.int64()),
                }
                if with_ids:
                    out["ids"] = pa.array([ids[x:y].astype(np.int32) for x, y in wide], pa.list_(pa.int32()))
                del s, ids
                tidy()
                yield pa.RecordBatch.from_pydict(out)

    return numbered.mapInArrow(read, schema)


def lookup(spark: SparkSession, out_dir: str, keys: DataFrame, key_col: str = "doc_id") -> DataFrame:
    """The ids of the asked keys (doc_id, ids). Keys are put in ranges beside the table of shards, and each range of keys opens the shards that can hold one of it. Unknown and null keys return nothing."""
    asked = keys.select(F.col(key_col).cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    # shards and keys in one order: a key's first shard is the last one that starts at or before it, and the next ones while they start with it
    lows = _manifest(spark, out_dir).where("low is not null").select(F.col("low").alias("k"), F.lit(0).alias("kind"), "shard", "high")
    both = lows.unionAll(asked.select("doc_id", F.lit(1), F.lit(None).cast("long"), F.lit(None).cast("long")))
    order = [F.col("k"), F.col("kind"), F.col("shard")]
    table = both.repartitionByRange(F.col("k")).sortWithinPartitions(*order)
    path = scratch(spark, "lookup")
    table.withColumn("p", F.spark_partition_id()).write.parquet(path)
    table = spark.read.parquet(path)
    # what a partition's keys may find in those before: the last shards that start there (one row a partition)
    last = table.where("kind = 0").groupBy("p").agg(F.max("shard").alias("shard"))
    before = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    carried = table.select("p").distinct().join(last, "p", "left").select("p", F.max("shard").over(before).alias("carried"))
    held = Window.partitionBy("p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    spot = table.withColumn("own", F.max(F.when(F.col("kind") == 0, F.col("shard"))).over(held)).join(carried, "p").where("kind = 1")
    spot = spot.select(F.col("k").alias("doc_id"), F.coalesce("own", "carried").alias("shard")).where("shard is not null")
    # an id whose rows were parted lies in several shards
    more = _manifest(spark, out_dir).select("low", "high", F.col("shard").alias("other"))
    at_edge = more.join(asked, F.col("high") == F.col("doc_id")).select("doc_id", "other").unionAll(more.join(asked, F.col("low") == F.col("doc_id")).select("doc_id", "other"))
    pairs = spot.unionAll(at_edge.select("doc_id", F.col("other").alias("shard"))).distinct()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, shard = b.column(0).to_numpy(), b.column(1).to_numpy()
            for a, c in zip(*groups(shard), strict=True):
                s, out_key, out_ids = _shard(out_dir, int(shard[a])), [], []
                for k, r in zip(key[a:c].tolist(), s.first_rows(key[a:c]).tolist(), strict=True):
                    while 0 <= r < len(s.keys) - s.n_null and s.keys[r] == k:
                        out_key.append(k)
                        out_ids.append(s.ids(r).astype(np.int32))
                        r += 1
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(out_key, pa.int64()), "ids": pa.array(out_ids, pa.list_(pa.int32()))})

    return pairs.repartition("shard").sortWithinPartitions("shard", "doc_id").mapInArrow(read, "doc_id long, ids array<int>")
