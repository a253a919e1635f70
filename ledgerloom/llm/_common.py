"""Helpers of the operators: shared scratch tables, Arrow slices, vectorised word and fingerprint arrays."""

from __future__ import annotations

import ctypes
import ctypes.util
import hashlib
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes of text that one numpy step works on, unless a single text is longer.
CHUNK_BYTES = 1 << 20
#: Bytes of an Arrow batch that goes to a Python worker, unless a single row is longer.
BATCH_BYTES = 4 << 20
#: Bytes of text in a partition that is put in order, and those that a task packs into blocks for these at a time.
PARTITION_BYTES = 16 << 20
PACKED_BYTES = 16 << 20
#: A range's number has its partition above these bits.
WITHIN = 32
#: Strings beyond so many bytes are hashed one by one.
LONG_STRING = 512
#: Bytes that are gathered at a time.
GATHERED = 256 << 10
LAST_ID = (1 << 63) - 1
U64 = np.uint64
_POWER = 0x9E3779B97F4A7C15
_INVERSE = pow(_POWER, -1, 1 << 64)
_MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], U64)
_libc = ctypes.CDLL(name) if (name := ctypes.util.find_library("c")) else None
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir). Only a session within one machine may go without that setting."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = base.get() if base.isDefined() else None
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-ledgerloom-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: df as a table in the shared folder, read again. A lost executor costs no more than its own tasks."""
    spark = df.sparkSession
    df.write.option("compression", "zstd").parquet(path := scratch(spark, name))
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches to Python workers are bounded by bytes, too, as texts can be long."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def tidy() -> None:
    """Gives free memory back to the system: a Python worker lives on after its task, beside those of the next stages."""
    pa.default_memory_pool().release_unused()
    if _libc is not None and hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


def order_id(id_col: str) -> Column:
    """The document id for ordering: null comes last."""
    return F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID))


def put_file(folder: str, name: str, data: bytes) -> None:
    """Writes a file whole: under a name of this attempt first, so a task that runs twice leaves one file (its data are the same)."""
    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    own = f"{path}/_{uuid.uuid4().hex}"
    with store.open_output_stream(own) as f:
        f.write(data)
    if store.get_file_info(f"{path}/{name}").type == fs.FileType.File:
        store.delete_file(own)
    else:
        store.move(own, f"{path}/{name}")


def packed(t: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(t.combine_chunks())
    return sink.getvalue().to_pybytes()


def unpacked(block: pa.Scalar | bytes) -> pa.Table:
    return pa.ipc.open_stream(block.as_buffer() if isinstance(block, pa.Scalar) else block).read_all()


def _bounds(slim: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Keys (id, hash of the text) at which partitions of about PARTITION_BYTES begin, but the first; equal ones where equal rows fill several.

    Keys and sizes alone are put in order. What reaches the driver is a key for each half of a partition, 24 bytes for
    some 8 MB of text.
    """
    narrow = slim.select(order_id("id").alias("id"), F.xxhash64("text").alias("mark"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"))
    total = narrow.agg(F.sum("size").alias("n")).first()["n"] or 0
    if total <= PARTITION_BYTES:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    half = PARTITION_BYTES // 2

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = 0, None
        for b in batches:
            if not len(b):
                continue
            ids, marks, gone = b.column("id").to_numpy(), b.column("mark").to_numpy(), held + np.cumsum(b.column("size").to_numpy())
            at = np.flatnonzero(np.diff(gone // half, prepend=held // half))
            before = (gone - b.column("size").to_numpy())[at]
            done = held // half * half if last is None else last
            yield pa.RecordBatch.from_pydict({"id": pa.array(ids[at]), "mark": pa.array(marks[at]), "size": pa.array(np.diff(before, prepend=done))})
            last = int(before[-1]) if len(at) else done
            held, end = int(gone[-1]), (int(ids[-1]), int(marks[-1]))
        if held:  # behind the last key of this task
            yield pa.RecordBatch.from_pydict({"id": pa.array([end[0]]), "mark": pa.array([min(end[1] + 1, LAST_ID)]), "size": pa.array([held - last])})

    ordered = narrow.repartitionByRange(max(1, -(-total // (4 * PARTITION_BYTES))), "id", "mark").sortWithinPartitions("id", "mark")
    found = ordered.mapInArrow(cut, "id long, mark long, size long").toArrow()
    ids, marks, sizes = (found[c].to_numpy() for c in ("id", "mark", "size"))
    by, held, taken = np.lexsort((marks, ids)), 0, []
    for i in by.tolist():
        held += int(sizes[i])
        if held >= PARTITION_BYTES:
            taken.append(i)
            held = 0
    return ids[taken], marks[taken]


def _partition(ids: np.ndarray, marks: np.ndarray, bounds: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The partition of each row; equal rows that fill several are dealt over these in turn."""
    lo, hi = np.searchsorted(bounds[0], ids), np.searchsorted(bounds[0], ids, "right")
    for i in np.unique(lo[lo < hi]).tolist():
        rows, own = np.flatnonzero((lo == i) & (hi > i)), bounds[1][i : int(np.searchsorted(bounds[0], bounds[0][i], "right"))]
        first, last = np.searchsorted(own, marks[rows]), np.searchsorted(own, marks[rows], "right")
        lo[rows] = i + last - np.where(last > first, np.arange(len(rows)) % np.maximum(last - first, 1), 0)
    return lo


def over_ranges(docs: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...], target: int, work: Callable[[int, pa.Table], dict], schema: str) -> DataFrame:
    """The rows of work(number, rows) for every range of documents, about target bytes of text each. rows: id, text, and the kept columns as k0, k1, ...; numbers rise over all ranges.

    Documents are in the order of their ids, rows without id last. Rows of one id lie side by side, by their texts; only
    if they fill several partitions, by a hash of these first. Ranges are cut by bytes, so none grows with the rows of one
    id or text. Texts travel once, in compressed blocks, to partitions of about PARTITION_BYTES.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)])
    small_batches(docs.sparkSession)
    bounds = _bounds(slim)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def blocks(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            part = _partition(t["key"].to_numpy(), t["mark"].to_numpy(), bounds)
            by = np.argsort(part, kind="stable")
            t, part = t.drop_columns(["key", "mark"]).take(pa.array(by)), part[by]
            at, to = groups(part)
            return pa.RecordBatch.from_pydict({"part": pa.array(part[at]), "block": pa.array([packed(t.slice(a, b - a)) for a, b in zip(at.tolist(), to.tolist(), strict=True)], pa.binary())})

        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.nbytes
            if size > PACKED_BYTES:
                yield blocks(held)
                held, size = [], 0
                tidy()
        if held:
            yield blocks(held)
            tidy()

    def cut(key: tuple, rows: pa.Table) -> pa.Table:
        part, out = key[0].as_py(), []
        t = pa.concat_tables([unpacked(x) for x in rows["block"]])
        del rows
        t = t.take(pc.sort_indices(t, [("id", "ascending"), ("text", "ascending")], null_placement="at_end")).combine_chunks()
        tidy()
        gone = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(t["text"]), 0).to_numpy().astype(np.int64) + 16)])
        for i, j in slices(gone, target):
            out.append(work((part << WITHIN) + len(out), t.slice(i, j - i)))
            tidy()
        return pa.Table.from_pylist(out, wanted)

    keyed = slim.select(*slim.columns, order_id("id").alias("key"), F.xxhash64("text").alias("mark"))
    sent = keyed.mapInArrow(send, "part long, block binary")
    wanted = pa.schema([pa.field(f.name, {"long": pa.int64(), "bigint": pa.int64()}[f.dataType.simpleString()]) for f in StructType.fromDDL(schema).fields])
    return sent.groupBy("part").applyInArrow(cut, schema)


def flat_text(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and their n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n, (_, offs, data) = len(column), column.buffers()
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return buf, off - off[0]


def slices(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most so many bytes, or of one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of the hash base, and of its inverse, modulo 2^64."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_POWER, _INVERSE)):
            p = np.full(n + n // 4, base, U64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values."""
    out = x >> U64(30)
    out ^= x
    out *= U64(0xBF58476D1CE4E5B9)
    part = out >> U64(27)
    out ^= part
    out *= U64(0x94D049BB133111EB)
    np.right_shift(out, U64(31), out=part)
    out ^= part
    return out


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Running sums from which span_hash() takes the hash of any span."""
    up, _ = powers(len(values) + 1)
    out = np.zeros(len(values) + 1, U64)
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of values[start:end]; equal spans have equal hashes wherever they lie."""
    _, down = powers(len(sums))
    return (sums[end] - sums[start]) * down[start]


def loads(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number, the first byte lowest; zeros behind the end."""
    wide = np.concatenate([buf, np.zeros(8, np.uint8)])
    return np.ndarray(len(buf) + 1, "<u8", wide, strides=(1,))


def steps(size: int) -> list[int]:
    """Places at which loads of eight bytes cover a string of so many bytes."""
    return [*range(0, size - 7, 8), *([size - 8] if size % 8 else [])] if size >= 8 else [0]


def string_hash(buf: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte strings. Of strings of at most eight bytes and one size, only equal ones share a hash."""
    at8 = loads(buf)
    h = mix(sizes.astype(U64) * U64(_POWER))
    todo, at, left = np.arange(len(starts)), starts, sizes
    if len(sizes) and int(sizes.max()) > LONG_STRING:
        huge = sizes > LONG_STRING
        for i in np.flatnonzero(huge).tolist():
            h[i] = int.from_bytes(hashlib.blake2b(buf[starts[i] : starts[i] + sizes[i]].tobytes(), digest_size=8).digest(), "little")
        todo, at, left = todo[~huge], at[~huge], left[~huge]
    while len(todo):
        h[todo] = mix(h[todo] + (at8[at] & _MASKS[np.minimum(left, 8)]))
        more = left > 8
        todo, at, left = todo[more], at[more] + 8, left[more] - 8
    return h


def differ(buf: np.ndarray, starts: np.ndarray, sizes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which strings are not equal, byte by byte, to string first[i], whose string_hash() they share."""
    out = sizes != sizes[first]
    check = np.flatnonzero(~out & (sizes > 8) & (first != np.arange(len(first))))
    ends = np.concatenate([[0], np.cumsum(sizes[check])])
    for i, j in slices(ends):
        some = check[i:j]
        no = gathered(buf, starts[some], sizes[some]) != gathered(buf, starts[first[some]], sizes[some])
        if no.any():
            out[some[np.unique(np.searchsorted(ends[i : j + 1] - ends[i], np.flatnonzero(no), "right") - 1)]] = True
    return out


def numbered(buf: np.ndarray, starts: np.ndarray, sizes: np.ndarray, hashes: np.ndarray | None = None) -> np.ndarray:
    """A number for each byte string, the same for equal strings only: hashes (by string_hash()) group them, their bytes decide."""
    hashes = string_hash(buf, starts, sizes) if hashes is None else hashes
    _, first, number = np.unique(hashes, return_index=True, return_inverse=True)
    odd = differ(buf, starts, sizes, first[number])
    if odd.any():
        names: dict[bytes, int] = {}
        for i in np.flatnonzero(np.isin(number, number[odd])).tolist():
            number[i] = names.setdefault(buf[starts[i] : starts[i] + sizes[i]].tobytes(), len(first) + len(names))
    return number


def numbered_rows(values: np.ndarray, start: np.ndarray, width: int) -> np.ndarray:
    """A number for each values[start : start + width], the same for equal ones only."""
    if not len(start):
        return np.zeros(0, np.int64)
    sums = prefix_hash(mix(values.astype(U64) + U64(1)))
    _, first, number = np.unique(span_hash(sums, start, start + width), return_index=True, return_inverse=True)
    other = start[first[number]]
    odd = np.zeros(len(start), bool)
    for i in range(width):
        odd |= values[start + i] != values[other + i]
    if odd.any():
        names: dict[bytes, int] = {}
        for i in np.flatnonzero(np.isin(number, number[odd])).tolist():
            number[i] = names.setdefault(values[start[i] : start[i] + width].tobytes(), len(first) + len(names))
    return number


def gathered(buf: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """buf[start : start + size] of all, one behind the other."""
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    out = np.empty(int(ends[-1]), buf.dtype)
    for i, j in slices(ends, GATHERED):
        shift = (starts[i:j] - ends[i:j]).astype(np.int64)
        at = np.repeat(shift, sizes[i:j])
        at += np.arange(ends[i], ends[j])
        np.take(buf, at, out=out[ends[i] : ends[j]], mode="clip")
    return out


def class_table(pattern_ranges: list[tuple[int, int]]) -> np.ndarray:
    """True for the bytes of words: all but those in the ranges."""
    t = np.ones(256, bool)
    for a, b in pattern_ranges:
        t[a : b + 1] = False
    return t


#: Words of letters, digits and everything beyond ASCII, after A-Z became a-z.
PLAIN_WORDS = class_table([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])
#: Words between white space.
SPACED_WORDS = class_table([(0x20, 0x20), (0x09, 0x0D)])


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    return np.where((buf >= 65) & (buf <= 90), buf + np.uint8(32), buf)


def split_words(buf: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word in buf, its 64-bit hash (see numbered() where words must be told apart), and the word offsets of each text."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(len(offsets), np.int64)
    w = table[buf]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    before = np.zeros(n, bool)
    before[1:] = w[:-1]
    starts = np.flatnonzero(w & (~before | first[:n]))
    after = np.zeros(n, bool)
    after[:-1] = w[1:]
    ends = np.flatnonzero(w & (~after | first[1:])) + 1
    return starts, ends, string_hash(buf, starts, ends - starts), np.searchsorted(starts, offsets)


def groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last + 1 of each stretch of equal rows of sorted keys."""
    n = len(keys[0])
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.ones(n, bool)
    new[1:] = False
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    at = np.flatnonzero(new)
    return at, np.append(at[1:], n)
