"""Suffix-array dedup of byte strings.

A byte that a string of some bytes (50) covers which also starts in a document before goes. Documents lie in shards in
the order of their ids. Which places can matter at all is told by the anchors of their windows (see _repeats); all else is
told by bytes:

* Within a shard the suffixes of the candidate places are sorted by prefix doubling on the groups that are still unsorted
  (Larsson-Sadakane), common prefixes of neighbours are taken by Kasai's rule in parallel lanes, and suffixes that share
  a window are one class with its first document.
* Across shards, what shards share by their anchors meets in buckets. Equal spans are one there. The windows of the others
  are put in suffix order by shard, in the same way, and the shards' arrays are merged two by two: the windows of the
  later shard are searched in the array of the earlier one by binary search; those it has repeat, the others are
  inserted.

Cases: null or empty text has no bytes; each row is a document of its own, in the order of id, then text (see
_common.over_ranges), rows without id last; so of identical rows one stays. Matches never cross
documents, and a document never removes its own bytes. Kept bytes may be cut within a character, so they are binary. An
empty table gives no rows. Extra columns pass if asked for by name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import _repeats as R
from ledgerloom.llm._common import flat_text, groups, loads, steps

WINDOW = 50
LANE = 64


def packed(s: np.ndarray) -> np.ndarray:
    """The first eight bytes of each suffix as one number, in the order of the bytes, zeros behind the end."""
    return loads(s)[:-1].byteswap().astype(np.uint64)


def suffix_array(s: np.ndarray, depth: int, shard: np.ndarray | None = None) -> np.ndarray:
    """Suffixes of s in the order of their first bytes, depth of them at least; ties by place. Only groups that are not yet sorted are refined. shard (of each byte, ascending): the arrays of several shards, one behind the other."""
    n = len(s)
    key = packed(s)
    order = np.argsort(key, kind="stable")
    if shard is not None:
        order = order[np.argsort(shard[order], kind="stable")]
    rank = np.zeros(n + 1, np.int64)
    sorted_key = key[order]
    new = np.append(True, sorted_key[1:] != sorted_key[:-1]) if n else np.zeros(0, bool)
    if shard is not None:
        new[1:] |= np.diff(shard[order]) != 0
    start = np.flatnonzero(new)
    rank[order] = np.repeat(start, np.diff(np.append(start, n))) + 1  # a group's number is its first place; 0 is behind the end
    h = 8
    while h < depth:
        size = np.diff(np.append(start, n))
        wide = size > 1
        if not wide.any():
            break
        at = np.repeat(start[wide], size[wide]) + np.arange(int(size[wide].sum())) - np.repeat(np.cumsum(size[wide]) - size[wide], size[wide])
        own = order[at]
        both = (rank[own].astype(np.uint64) << np.uint64(32)) | rank[np.minimum(own + h, n)].astype(np.uint64)
        by = np.argsort(both, kind="stable")
        order[at], both = own[by], both[by]
        split = np.append(False, both[1:] != both[:-1])
        new[at[split]] = True
        start = np.flatnonzero(new)
        group = np.repeat(start, np.diff(np.append(start, n)))
        rank[order[at]] = group[at] + 1
        h *= 2
    return order


def common_prefixes(s: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Common prefix of each suffix and the one before it in the order, up to most.

    By Kasai's rule a suffix shares at least one byte less with its neighbour than the suffix that starts one byte before.
    Lanes of the text go side by side. The order is not refined beyond most, so after a prefix of most bytes the rule
    tells nothing, and the comparison starts anew, by eight bytes at a time.
    """
    n = len(s)
    if not n:
        return np.zeros(0, np.int64)
    key = packed(s)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    wide = np.concatenate([s.astype(np.int16), np.full(most + 1, -1, np.int16)])
    common = np.zeros(n, np.int64)
    lanes = np.arange(0, n, LANE)
    held = np.full(len(lanes), most)
    for step in range(LANE):
        at = lanes + step
        at = at[at < n]
        other = before[at]
        length = np.where(held[: len(at)] < most, np.maximum(held[: len(at)] - 1, 0), 0)
        length[other < 0] = 0
        go = np.flatnonzero((other >= 0) & (length < most))
        fast = go
        while len(fast):
            fast = fast[np.maximum(at[fast], other[fast]) + length[fast] + 8 <= n]
            fast = fast[key[at[fast] + length[fast]] == key[other[fast] + length[fast]]]
            length[fast] += 8
            fast = fast[length[fast] < most]
        length = np.minimum(length, most)
        go = go[length[go] < most]
        while len(go):
            a, b = at[go] + length[go], other[go] + length[go]
            go = go[(wide[a] == wide[b]) & (wide[a] >= 0)]
            length[go] += 1
            go = go[length[go] < most]
        common[at] = length
        held = length
    return common[order]


def earlier_in_shard(s: np.ndarray, doc: np.ndarray, start: np.ndarray, window: int) -> np.ndarray:
    """Which window starts in s have an equal window in a document before. doc: of each byte; start: places with a whole window of one document behind them."""
    order = suffix_array(s, window)
    common = common_prefixes(s, order, window)
    group = np.cumsum(common < window)
    is_start = np.zeros(len(s), bool)
    is_start[start] = True
    keep = is_start[order]
    place, group = order[keep], group[keep]
    if not len(place):
        return np.zeros(0, np.int64)
    at, to = groups(group)
    first = np.repeat(np.minimum.reduceat(doc[place], at), to - at)
    return place[doc[place] > first]


def _places(key: np.ndarray, window: int, asked: np.ndarray, held: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Binary search of each asked window in held[low:high], which is in the order of the windows: where it belongs, and whether it is there. key: packed() of the text."""
    at, shift = steps(window), np.uint64(max(0, 64 - 8 * window))

    def below(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether window a comes before b; whether both are equal."""
        out, open_ = np.zeros(len(a), bool), np.arange(len(a))
        for i in at:
            x, y = key[a[open_] + i] >> shift, key[b[open_] + i] >> shift
            out[open_] = x < y
            open_ = open_[x == y]
        same = np.zeros(len(a), bool)
        same[open_] = True
        return out, same

    low, high, end = low.copy(), high.copy(), high
    todo = np.flatnonzero(low < high)
    while len(todo):
        mid = (low[todo] + high[todo]) // 2
        less, _ = below(held[mid], asked[todo])
        low[todo] = np.where(less, mid + 1, low[todo])
        high[todo] = np.where(less, high[todo], mid)
        todo = todo[low[todo] < high[todo]]
    there = np.zeros(len(asked), bool)
    some = np.flatnonzero(low < end)
    there[some] = below(held[low[some]], asked[some])[1]
    return low, there


def merged(s: np.ndarray, place: np.ndarray, shard: np.ndarray, window: int) -> np.ndarray:
    """Which windows a smaller shard has, too. place: window starts in s, in suffix order by shard; shard: of each, from 0 on without gaps."""
    key = np.concatenate([packed(s), np.zeros(1, np.uint64)])
    gone, live, part = np.zeros(len(place), bool), np.arange(len(place)), shard.copy()
    while len(part) and part[-1] > 0:
        asks = np.flatnonzero(part & 1)
        low, high = np.searchsorted(part, part[asks] - 1), np.searchsorted(part, part[asks] - 1, "right")
        to, there = _places(key, window, place[live[asks]], place[live], low, high)
        gone[live[asks[there]]] = True
        rank = np.arange(len(live)) * 2 + 1
        rank[asks] = to * 2
        stays = np.ones(len(live), bool)
        stays[asks[there]] = False
        by = np.argsort(rank[stays], kind="stable")
        live, part = live[stays][by], part[stays][by] >> 1
    return gone


def compare(t: R.Text, part: np.ndarray, kind: R.Kind) -> np.ndarray:
    """Starts of the windows of a bucket's spans that a smaller shard has, too. part: of each span, ascending."""
    n = np.maximum(np.diff(t.bounds) - kind.window + 1, 0)
    start, owner = R.stretches(t.bounds[:-1], n), np.repeat(np.unique(part, return_inverse=True)[1], n)
    if not len(start):
        return start
    # windows whose hash one shard alone has need no place in the arrays
    h = R.gram_hashes(t, kind.window)[start]
    by = np.argsort(h, kind="stable")
    at, to = groups(h[by])
    several = np.zeros(len(by), bool)
    several[by] = np.repeat(np.maximum.reduceat(owner[by], at) > np.minimum.reduceat(owner[by], at), to - at)
    start, owner = start[several], owner[several]
    inside = np.flatnonzero(R.covered(start, kind.window, len(t.buf)))
    s, shard = t.buf[inside], np.repeat(np.arange(len(n)), np.diff(t.bounds))[inside]
    shard = np.unique(part, return_inverse=True)[1][shard]
    held = np.unique(owner)  # shards without such a window hold no place
    shard = np.searchsorted(held, shard)
    is_start = np.zeros(len(s), bool)
    is_start[np.searchsorted(inside, start)] = True
    order = suffix_array(s, kind.window, shard)
    place = order[is_start[order]]
    return np.sort(inside[place[merged(s, place, shard[place], kind.window)]])


BYTES = R.Kind(R.bytes_of, WINDOW, 16, 4 << 20, compare)


def _marks(text: pa.ChunkedArray, replies: pa.Table, kind: R.Kind, buckets: int) -> np.ndarray:
    """The bytes of a shard's documents that repeated windows cover."""
    t = kind.units(*flat_text(text))
    r = R.runs_of(t, kind)
    told, whole = R.foreign_windows(t, r, replies, kind, buckets)
    gone = [told]
    first, last, anchor = r.first[~whole], r.last[~whole], r.anchor[~whole]
    by = np.argsort(anchor, kind="stable")
    same = anchor[by[1:]] == anchor[by[:-1]]
    twice = np.zeros(len(by), bool)
    twice[by[1:]] |= same
    twice[by[:-1]] |= same
    first, last = first[twice], last[twice]
    if len(first):
        # the places that the candidate windows cover, one behind the other; a window never leaves its document
        inside = np.flatnonzero(R.covered(first, last - first + kind.window, len(t.buf)))
        start = np.searchsorted(inside, R.stretches(first, last - first + 1))
        doc = np.searchsorted(t.bounds, inside, "right") - 1
        gone.append(inside[earlier_in_shard(t.buf[inside], doc, start, kind.window)])
    return R.covered(np.concatenate(gone), kind.window, len(t.buf))


def remove_repeated_bytes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), window: int = WINDOW) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_bytes (binary), and the columns in keep."""
    kind = BYTES if window == WINDOW else R.Kind(R.bytes_of, window, max(1, window // 3), BYTES.range_bytes, compare)
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_bytes"]

    def finish(rows: pa.Table, replies: pa.Table, buckets: int) -> pa.Table:
        buf, off = flat_text(rows["text"])
        gone = _marks(rows["text"], replies, kind, buckets)
        head = gone.copy()
        head[1:] &= ~gone[:-1]
        edge = off[:-1][off[:-1] < len(buf)]
        head[edge] = gone[edge]
        total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[off])
        removed = total(gone)
        n = np.diff(off)
        kept = np.concatenate([[0], np.cumsum(n - removed)]).astype(np.int64)
        body = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(kept.tobytes()), pa.py_buffer(buf[~gone].tobytes())]).cast(pa.binary())
        return pa.table([rows["id"], pa.array(n), pa.array(removed), pa.array(total(head)), body, *[rows[f"k{i}"] for i in range(len(keep))]], names=[*names, *[f"k{i}" for i in range(len(keep))]])

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_bytes binary" + "".join(f", k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    out = R.repeats(docs, kind, finish, schema, id_col, text_col, list(keep))
    return out.select(*names, *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)])
