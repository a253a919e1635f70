"""Repeated windows of a corpus: what substring and suffix-array dedup share.

A text is a row of units (words or bytes). Of the grams of k units in a window of W, the one with the smallest hash is
the window's anchor; equal windows have equal anchors. Neighbouring windows with one anchor make a run, and the units
that a run covers are its span. Documents lie in ranges in the order of their ids (see _common.over_ranges), so "an earlier
document" is one in a smaller range, or an earlier one of the same range.

1. Every range sends its distinct anchors to buckets, which answer with those that several ranges have. Anchors are
   hashes: they only choose what is compared, so hashes that meet by chance cost work and change no result.
2. Every range sends the spans of its shared anchors to the buckets, equal spans once, byte by byte. A bucket tells spans
   apart by their bytes. A span that a smaller range has, too, repeats whole; the windows of the others are compared
   with those of the smaller ranges, by their bytes or words (compare), and what repeats goes back to the range.
3. Each range marks what it was told and what repeats within itself (finish).

A range's documents are a compressed file in the shared folder, which each step reads, so texts are shuffled once. Nothing
is gathered beyond a range or a bucket, and a passage that a range holds many times is sent once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm._common import SPACED_WORDS, U64, flat_text, gathered, groups, loads, mix, numbered, over_ranges, packed, prefix_hash, put_file, scratch, span_hash, split_words, steps, string_hash, tidy, unpacked, written

_NONE = np.zeros(0, U64)
_ODD = np.random.default_rng(9).integers(1, 1 << 62, 64, dtype=np.int64).astype(U64) * U64(2) + U64(1)


@dataclass
class Text:
    """Some documents: their units as bytes, one behind the other, where each unit starts (None: units are bytes), its hash, and the documents' bounds in units."""

    buf: np.ndarray
    at: np.ndarray | None
    units: np.ndarray
    bounds: np.ndarray

    def bytes_of(self, first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and size in bytes of n units from first on."""
        if self.at is None:
            return first, n
        return self.at[first], self.at[first + n] - self.at[first]


def words_of(buf: np.ndarray, offsets: np.ndarray) -> Text:
    """Words of the texts, a space behind each: so equal bytes are equal rows of words."""
    starts, ends, h, bounds = split_words(buf, offsets, SPACED_WORDS)
    size = ends - starts + 1
    at = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    body = gathered(np.append(buf, np.uint8(32)), starts, size)
    body[at[1:] - 1] = 32
    return Text(body, at, h, bounds)


def bytes_of(buf: np.ndarray, offsets: np.ndarray) -> Text:
    return Text(buf, None, buf, offsets)


@dataclass(frozen=True)
class Kind:
    """Units, window and gram, and the bytes of a range. compare(spans of a bucket, their ranges) tells which windows of a span a smaller range has, too."""

    units: Callable[[np.ndarray, np.ndarray], Text]
    window: int
    gram: int
    range_bytes: int
    compare: Callable[[Text, np.ndarray, Kind], np.ndarray] | None = None


@dataclass
class Runs:
    """The runs of some documents: first and last window start, anchor; and the hash of every gram."""

    first: np.ndarray
    last: np.ndarray
    anchor: np.ndarray
    grams: np.ndarray


def gram_hashes(t: Text, gram: int) -> np.ndarray:
    n = len(t.units) - gram + 1
    if t.at is None:
        at8, h = np.array(loads(t.buf)), np.full(n, gram, U64)
        for k, i in enumerate(steps(gram)):
            x = at8[i : i + n]
            h += (x if gram >= 8 else x & U64((1 << 8 * gram) - 1)) * _ODD[k % len(_ODD)]
        return mix(h)
    place = np.arange(n)
    return mix(span_hash(prefix_hash(t.units), place, place + gram))


def runs_of(t: Text, kind: Kind) -> Runs:
    n, w = len(t.units), kind.window
    if n < w:
        none = np.zeros(0, np.int64)
        return Runs(none, none, _NONE, _NONE)
    grams = gram_hashes(t, kind.gram)
    width, size, least = w - kind.gram + 1, 1, grams
    while size * 2 <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    m = n - w + 1
    least = np.minimum(least[:m], least[width - size : width - size + m])
    lengths = np.diff(t.bounds)
    ok = np.zeros(n + 1, np.int8)  # +1 where a document's windows begin, -1 behind its last
    long = np.flatnonzero(lengths >= w)
    np.add.at(ok, t.bounds[:-1][long], 1)
    np.add.at(ok, t.bounds[1:][long] - w + 1, -1)
    valid = np.cumsum(ok[:m], dtype=np.int8) > 0
    new = np.ones(m, bool)
    new[1:] = least[1:] != least[:-1]
    new[t.bounds[:-1][long]] = True
    first = np.flatnonzero(new & valid)
    stop = np.zeros(m, bool)
    stop[:-1] = new[1:] | ~valid[1:]
    stop[-1] = True
    last = np.flatnonzero(stop & valid)
    return Runs(first, last, least[first], grams)


def among(x: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of x are in the sorted keys, by binary search."""
    if not len(keys):
        return np.zeros(len(x), bool)
    return keys[np.searchsorted(keys, x).clip(max=len(keys) - 1)] == x


def stretches(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first, first + 1, ... n of them each, one behind the other."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def each_window(runs: Runs, which: np.ndarray) -> np.ndarray:
    """Starts of the windows of the runs that are marked."""
    first, last = runs.first[which], runs.last[which]
    return stretches(first, last - first + 1)


def covered(starts: np.ndarray, window: int | np.ndarray, n: int) -> np.ndarray:
    """Units that windows at these starts cover."""
    change = np.bincount(starts, minlength=n + 1) - np.bincount(starts + window, minlength=n + 1)
    return np.cumsum(change[:n]) > 0


@dataclass
class Spans:
    """The distinct spans of a range's shared anchors, by bucket and anchor. own: of each run that has a shared anchor the span's number."""

    runs: np.ndarray
    own: np.ndarray
    bucket: np.ndarray
    anchor: np.ndarray
    start: np.ndarray  # in bytes
    size: np.ndarray


def spans_of(t: Text, runs: Runs, shared: np.ndarray, kind: Kind, buckets: int) -> Spans:
    which = np.flatnonzero(among(runs.anchor, shared))
    start, size = t.bytes_of(runs.first[which], runs.last[which] - runs.first[which] + kind.window)
    number = numbered(t.buf, start, size)
    _, at, own = np.unique(number, return_index=True, return_inverse=True)
    anchor = runs.anchor[which[at]]
    bucket = (anchor % U64(buckets)).astype(np.int64)
    by = np.lexsort((at, anchor, bucket))
    place = np.empty(len(by), np.int64)
    place[by] = np.arange(len(by))
    return Spans(which, place[own], bucket[by], anchor[by], start[at[by]], size[at[by]])


def squeezed(x: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(x).tobytes(), 1)


def unsqueezed(x: pa.Scalar, dtype: type) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(x.as_py()), dtype)


SENDS = "bucket long, part long, keys binary"
SPANS = "bucket long, part long, anchors binary, sizes binary, body binary"
#: What a range gets back. kind 0: a bit for each anchor that it sent to the bucket, set where other ranges have it. kind 1: numbers of spans (of all it sent to the bucket) that repeat whole. kind 2: number of a span, first and last window that repeats, and so on. body: the spans' bytes, if they are asked for.
REPLIES = "part long, kind int, bucket long, keys binary, sizes binary, body binary"
SHARED, WHOLE, PARTLY = 0, 1, 2


def by_bucket(anchors: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct anchors by bucket, and their buckets: the order in which a range sends them."""
    keys = np.unique(anchors)
    bucket = (keys % U64(buckets)).astype(np.int64)
    by = np.argsort(bucket, kind="stable")
    return keys[by], bucket[by]


def _sends(part: int, anchors: np.ndarray, buckets: int) -> pa.RecordBatch:
    """The distinct anchors by bucket. What the bucket tells is left out of them, and five bytes are enough."""
    keys, bucket = by_bucket(anchors, buckets)
    short = np.ascontiguousarray(keys >> U64(24)).view(np.uint8).reshape(-1, 8)[:, :5]
    at, to = groups(bucket)
    return pa.RecordBatch.from_pydict({"bucket": pa.array(bucket[at]), "part": pa.array(np.full(len(at), part, np.int64)), "keys": pa.array([short[a:b].tobytes() for a, b in zip(at.tolist(), to.tolist(), strict=True)], pa.binary())})


def _replies(rows: list[tuple]) -> pa.Table:
    names = ["part", "kind", "bucket", "keys", "sizes", "body"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    return pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def shared_anchors(key: tuple, rows: pa.Table) -> pa.Table:
    """A bucket's anchors that several ranges have, to each of them."""
    tidy()
    wide = []
    for x in rows["keys"]:
        five = np.frombuffer(x.as_py(), np.uint8).reshape(-1, 5)
        eight = np.zeros((len(five), 8), np.uint8)
        eight[:, :5] = five
        wide.append(eight.reshape(-1).view("<u8"))
    keys, part = np.concatenate(wide), np.repeat(rows["part"].to_numpy(), [len(x) for x in wide])
    by = np.argsort(keys, kind="stable")
    at, to = groups(keys[by])
    tell = np.zeros(len(keys), bool)
    tell[by] = np.repeat(np.maximum.reduceat(part[by], at) > np.minimum.reduceat(part[by], at), to - at)
    out, at = [], 0
    for p, x in zip(rows["part"].to_pylist(), wide, strict=True):
        some = tell[at : at + len(x)]
        at += len(x)
        if some.any():
            out.append((p, SHARED, key[0].as_py(), squeezed(np.packbits(some)), None, None))
    return _replies(out)


def shared_of(anchors: np.ndarray, replies: pa.Table, buckets: int) -> np.ndarray:
    """From a range's replies: which of its anchors others have, too; sorted."""
    keys, bucket = by_bucket(anchors, buckets)
    told = np.zeros(len(keys), bool)
    for r in replies.select(["kind", "bucket", "keys"]).to_pylist():
        if r["kind"] == SHARED:
            a, b = np.searchsorted(bucket, [r["bucket"], r["bucket"] + 1])
            told[a:b] = np.unpackbits(np.frombuffer(zstandard.decompress(r["keys"]), np.uint8), count=b - a).astype(bool)
    return np.sort(keys[told])


def spans_that_repeat(key: tuple, rows: pa.Table, kind: Kind, with_bytes: bool) -> pa.Table:
    """A bucket's answers to the ranges that sent spans."""
    tidy()
    anchors = [unsqueezed(x, np.uint32) for x in rows["anchors"]]
    n = np.array([len(x) for x in anchors])
    anchor, size = np.concatenate(anchors), np.concatenate([unsqueezed(x, np.uint32) for x in rows["sizes"]]).astype(np.int64)
    buf = np.concatenate([unsqueezed(x, np.uint8) for x in rows["body"]])
    names, sender = np.unique(rows["part"].to_numpy(), return_inverse=True)  # ranges in their order
    part = np.repeat(sender, n)
    start = np.cumsum(size) - size
    number = numbered(buf, start, size)
    by = np.lexsort((part, number))
    at, to = groups(number[by])
    low = np.repeat(part[by[at]], to - at)
    whole = np.zeros(len(part), bool)
    whole[by] = part[by] > low
    # spans that no smaller range has, and whose anchor has other spans elsewhere
    rest = np.flatnonzero(~whole)
    rest = rest[np.lexsort((part[rest], anchor[rest]))]
    at, to = groups(anchor[rest])
    other = np.repeat(np.maximum.reduceat(part[rest], at) > np.minimum.reduceat(part[rest], at), to - at) if len(rest) else np.zeros(0, bool)
    rest = rest[other]
    rest = rest[np.argsort(part[rest], kind="stable")]  # a range's spans lie together
    offsets = np.concatenate([[0], np.cumsum(size[rest])]).astype(np.int64)
    t = kind.units(gathered(buf, start[rest], size[rest]), offsets)
    windows = kind.compare(t, part[rest], kind)  # starts in t, ascending
    span = np.searchsorted(t.bounds, windows, "right") - 1
    new = np.append(True, (np.diff(windows) != 1) | (np.diff(span) != 0)) if len(windows) else np.zeros(0, bool)
    first = windows[new]
    last = windows[np.append(np.flatnonzero(new)[1:], len(windows)) - 1] if len(windows) else windows
    span = span[new]
    base = np.cumsum(n) - n
    out = []
    for k, name in enumerate(rows["part"].to_pylist()):
        some = np.flatnonzero(whole[base[k] : base[k] + n[k]])
        mine = (rest[span] >= base[k]) & (rest[span] < base[k] + n[k])
        if with_bytes:
            z = size[base[k] + some]
            a, b = t.bytes_of(first[mine], last[mine] - first[mine] + kind.window)
            if len(some) or mine.any():
                body = np.concatenate([gathered(buf, start[base[k] + some], z), gathered(t.buf, a, b)])
                out.append((name, WHOLE, key[0].as_py(), None, squeezed(np.concatenate([z, b]).astype(np.uint32)), squeezed(body)))
            continue
        if len(some):
            out.append((name, WHOLE, key[0].as_py(), squeezed(some.astype(np.uint32)), None, None))
        if mine.any():
            head = t.bounds[span[mine]]
            told = np.stack([rest[span[mine]] - base[k], first[mine] - head, last[mine] - head], 1)
            out.append((name, PARTLY, key[0].as_py(), squeezed(told.astype(np.uint32)), None, None))
    return _replies(out)


def repeats(docs: DataFrame, kind: Kind, finish: Callable[[pa.Table, pa.Table, int], pa.Table], schema: str, id_col: str, text_col: str, keep: list[str], with_bytes: bool = False) -> DataFrame:
    """Runs the three steps; finish(documents of a range, what it gets back, number of buckets) returns its rows. documents: id, text and kept columns as k0, k1, ..."""

    folder = scratch(docs.sparkSession, "blocks")

    def keep_block(part: int, rows: pa.Table) -> dict:
        put_file(folder, str(part), packed(rows))
        return {"part": part}

    def block(part: int) -> pa.Table:
        store, path = fs.FileSystem.from_uri(folder)
        with store.open_input_file(f"{path}/{part}") as f:
            return unpacked(f.read())

    parts = written(over_ranges(docs, id_col, text_col, tuple(keep), kind.range_bytes, keep_block, "part long"), "ranges")
    n_parts = parts.count()
    buckets = max(16, n_parts)
    # what a range gets back is small beside its documents, so the tasks are as many as ranges, not as the replies' bytes ask for
    tasks = max(1, min(n_parts, 10_000))
    parts = parts.repartition(tasks, "part")

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in b.column(0).to_pylist():
                runs = runs_of(kind.units(*flat_text(block(part)["text"])), kind)
                sent = _sends(part, runs.anchor, buckets)
                del runs
                tidy()
                yield sent

    shared = written(parts.mapInArrow(anchors, SENDS).groupBy("bucket").applyInArrow(shared_anchors, REPLIES), "shared")

    def ask(key: tuple, replies: pa.Table) -> pa.Table:
        out: list[tuple] = []
        tidy()
        t = kind.units(*flat_text(block(key[0].as_py())["text"]))
        runs = runs_of(t, kind)
        s = spans_of(t, runs, shared_of(runs.anchor, replies, buckets), kind, buckets)
        at, to = groups(s.bucket)
        for a, b in zip(at.tolist(), to.tolist(), strict=True):
            body = squeezed(gathered(t.buf, s.start[a:b], s.size[a:b]))
            out.append((int(s.bucket[a]), key[0].as_py(), squeezed(s.anchor[a:b].astype(np.uint32)), squeezed(s.size[a:b].astype(np.uint32)), body))
        del t, runs, s
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        return pa.table([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["bucket", "part", "anchors", "sizes", "body"])

    by_part = lambda df: df.groupBy("part")
    answer = lambda key, rows: spans_that_repeat(key, rows, kind, with_bytes)
    told = written(by_part(shared.repartition(tasks, "part")).applyInArrow(ask, SPANS).groupBy("bucket").applyInArrow(answer, REPLIES), "repeated")

    def last(key: tuple, rows: pa.Table, replies: pa.Table) -> pa.Table:
        tidy()
        return finish(block(key[0].as_py()), replies, buckets)

    return by_part(parts).cogroup(by_part((told if with_bytes else shared.unionAll(told)).repartition(tasks, "part"))).applyInArrow(last, schema)


def foreign_windows(t: Text, runs: Runs, replies: pa.Table, kind: Kind, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Window starts that smaller ranges have, too, as the buckets told; and the runs that repeat whole."""
    told = [r for r in replies.to_pylist() if r["kind"] != SHARED]
    if not told:
        return np.zeros(0, np.int64), np.zeros(len(runs.first), bool)
    s = spans_of(t, runs, shared_of(runs.anchor, replies, buckets), kind, buckets)
    whole = np.zeros(len(s.start), bool)
    parts = []
    for r in told:
        base, got = int(np.searchsorted(s.bucket, r["bucket"])), np.frombuffer(zstandard.decompress(r["keys"]), np.uint32).astype(np.int64)
        if r["kind"] == WHOLE:
            whole[base + got] = True
        else:
            parts.append(got.reshape(-1, 3) + [base, 0, 0])
    gone = np.zeros(len(runs.first), bool)
    gone[s.runs] = whole[s.own]
    out = [each_window(runs, gone)]
    if parts:
        some = np.concatenate(parts)  # each run of such a span has the told windows
        by = np.argsort(s.own, kind="stable")
        lo, hi = np.searchsorted(s.own[by], some[:, 0]), np.searchsorted(s.own[by], some[:, 0], "right")
        first = runs.first[s.runs[by[stretches(lo, hi - lo)]]]
        a, b = np.repeat(some[:, 1], hi - lo), np.repeat(some[:, 2], hi - lo)
        out.append(stretches(first + a, b - a + 1))
    return np.concatenate(out), gone


def same_windows(number: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Which windows a smaller range has, too. number: equal for equal windows."""
    by = np.lexsort((part, number))
    at, to = groups(number[by])
    out = np.zeros(len(by), bool)
    if len(by):
        out[by] = part[by] > np.repeat(part[by[at]], to - at)
    return out


def string_numbers(t: Text) -> np.ndarray:
    """A number for each word, the same for equal words only."""
    return numbered(t.buf, t.at[:-1], np.diff(t.at), string_hash(t.buf, t.at[:-1], np.diff(t.at)))
