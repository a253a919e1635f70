"""Best-fit packing by a linear grouping scheme.

The plan is made on the histogram of piece lengths, which has at most as many rows as a sequence has tokens, whatever
the corpus. Lengths over an eighth of a sequence are large: in descending order they are cut into groups of equal
cardinality and rounded up to the longest of their group. Over these few sizes the mix of configurations is optimised
(column generation with a knapsack, rounded down). Then the actual pieces take their group's places. Sequences that
rounding left too empty are given back (of a few bounds the best one is taken), and their pieces, what no configuration
took, and the small ones go in descending length to the fullest sequence that still holds them. The plan is a list of runs:
pieces of one length, by rank, take consecutive sequences. Ranks come from counts by length and salt, so that a
length that a third of all pieces have is no single task.

Cases: null or empty text is a document of its end ids; repeated rows are documents of their own; a null id stays null;
an empty table gives no rows. Extra columns are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm._common import flat_text, slices, small_batches, tidy, written
from ledgerloom.llm._tokens import encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
GROUPS = 32
#: Tokens that a sequence of a configuration may leave empty: the bound with the fewest sequences is taken.
WASTES = (2048, 512, 256, 128, 64, 32, 16, 8, 4, 2, 1, 0)
#: Pieces of a length and salt that are ranked in one task.
RANKED = 100_000


def token_pieces(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_ids: tuple[int, ...] = (0,), special: bool = False) -> DataFrame:
    """The pieces of all documents (special: see write_token_files()): only documents over the capacity are cut, into pieces of the capacity after a first one that may be shorter."""
    ends = list(end_ids)
    small_batches(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text, off = flat_text(b.column(1))
            for i, j in slices(off):
                ids, bounds = encoder(tokenizer, special).encode(text[off[i] : off[j]], off[i : j + 1] - off[i], ends)
                n = np.diff(bounds)
                count = -(-n // capacity)
                doc = np.repeat(np.arange(len(n)), count)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
                short = (n - (count - 1) * capacity)[doc]
                start = np.where(piece == 0, 0, short + (piece - 1) * capacity)
                length = np.where(piece == 0, short, capacity)
                at = bounds[doc] + start
                wide = ids.astype("<u4")
                crc = [zlib.crc32(wide[a : a + m]) for a, m in zip(at.tolist(), length.tolist(), strict=True)]
                tidy()
                yield pa.RecordBatch.from_pydict({"doc_id": b.column(0).slice(i, j - i).take(pa.array(doc)), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, PIECES)


def _knapsack(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most worth that fits, and how many of each size it takes."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    low = int(sizes.min())
    for t in range(low, capacity + 1):
        best[t], last[t] = best[t - 1], last[t - 1] if last[t - 1] == -2 else -2
        fits = np.flatnonzero(sizes <= t)
        got = best[t - sizes[fits]] + worth[fits]
        k = int(got.argmax())
        if got[k] > best[t] + 1e-12:
            best[t], last[t] = got[k], fits[k]
    take, t = np.zeros(len(sizes), np.int64), capacity
    while t >= low:
        if last[t] < 0:
            t -= 1
        else:
            take[last[t]] += 1
            t -= int(sizes[last[t]])
    return float(best[capacity]), take


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Configurations of the sizes (how many of each) and how often each is used, rounded down: at most a sequence for each size is left out."""
    g = len(sizes)
    out: list[tuple[np.ndarray, int]] = []
    left = demand.astype(np.int64).copy()
    basis = np.diag(np.maximum(1, capacity // sizes)).astype(float)
    use = demand / np.diag(basis)
    for _ in range(20 * g):
        price = np.linalg.solve(basis.T, np.ones(g))
        worth, column = _knapsack(sizes, price, capacity)
        if worth <= 1 + 1e-7:
            break
        step = np.linalg.solve(basis, column.astype(float))
        ok = step > 1e-9
        ratio = np.where(ok, use / np.where(ok, step, 1), np.inf)
        k = int(ratio.argmin())
        use = use - ratio[k] * step
        use[k] = ratio[k]
        basis[:, k] = column
    for k in np.argsort(-use):
        column = np.round(basis[:, k]).astype(np.int64)
        with_any = column > 0
        n = int(min(np.floor(use[k] + 1e-9), (left[with_any] // column[with_any]).min())) if with_any.any() else 0
        if n > 0:
            out.append((column, n))
            left = left - n * column
    return out


Run = tuple[int, int, int]  # pieces of a length: length, first rank, count


def substituted(column: np.ndarray, n: int, groups: list[list[list[int]]]) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """Actual pieces in n sequences of a configuration: stretches of alike sequences, each with their number, the tokens used and the pieces (length and rank of the first of the stretch). Takes the pieces from their groups."""
    done: list[tuple[int, int, list[tuple[int, int]]]] = [(n, 0, [])]
    for k in np.flatnonzero(column):
        for _ in range(int(column[k])):
            todo, done = done, []
            for count, used, pieces in todo:
                at = 0
                while at < count:
                    r = groups[k][0]
                    t = min(count - at, r[2])
                    done.append((t, used + r[0], [*((x, rank + at) for x, rank in pieces), (r[0], r[1])]))
                    r[1] += t
                    r[2] -= t
                    at += t
                    if not r[2]:
                        groups[k].pop(0)
    return done


def best_fit(runs: list[Run], kept: list[tuple[int, int, list[tuple[int, int]]]], first: int, capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Rows of a plan (length, first rank, count, first sequence, slot) for kept stretches and, in descending length, for runs that go to the fullest sequence that holds them; and the number of sequences. Sequences are numbered from first on."""
    rows: list[tuple[int, int, int, int, int]] = []
    free: dict[int, list[tuple[int, int, int]]] = {}  # room: first sequence, count, slots taken
    mask, sequences = 0, first
    for count, used, pieces in kept:
        rows += [(x, rank, count, sequences, slot) for slot, (x, rank) in enumerate(pieces)]
        if used < capacity:
            free.setdefault(capacity - used, []).append((sequences, count, len(pieces)))
            mask |= 1 << (capacity - used)
        sequences += count
    for x, rank, left in sorted(runs, key=lambda r: (-r[0], r[1])):
        while left:
            if not mask >> x:
                n = -(-left // (capacity // x))
                free[capacity] = [(sequences, n, 0)]
                mask |= 1 << capacity
                sequences += n
            above = mask >> x
            room = x + (above & -above).bit_length() - 1
            start, count, slot = free[room].pop()
            t = min(left, count)
            if t < count:
                free[room].append((start + t, count - t, slot))
            if not free[room]:
                mask &= ~(1 << room)
            rows.append((x, rank, t, start, slot))
            if room > x:
                free.setdefault(room - x, []).append((start, t, slot + 1))
                mask |= 1 << (room - x)
            rank, left = rank + t, left - t
    return rows, sequences


def plan(histogram: dict[int, int], capacity: int, groups: int = GROUPS) -> np.ndarray:
    """Rows (length, first rank, count, first sequence, slot): pieces of a length, from a rank on, take consecutive sequences."""
    small = capacity // 8
    full = histogram.get(capacity, 0)
    lengths = sorted((x for x, n in histogram.items() if n and x < capacity), reverse=True)
    todo = [[x, 0, histogram[x]] for x in lengths if x > small]
    stretches, rest = [], [(x, 0, histogram[x]) for x in lengths if x <= small]
    if todo:
        total = sum(r[2] for r in todo)
        m = min(groups, total)
        sizes: list[int] = []
        merged: list[list[list[int]]] = []
        for n in [total * (i + 1) // m - total * i // m for i in range(m)]:
            own = []
            while n:
                t = min(n, todo[0][2])
                own.append([todo[0][0], todo[0][1], t])
                todo[0][1] += t
                todo[0][2] -= t
                n -= t
                if not todo[0][2]:
                    todo.pop(0)
            if sizes and sizes[-1] == own[0][0]:  # groups of one rounded size are one size
                merged[-1] += own
            else:
                sizes.append(own[0][0])
                merged.append(own)
        demand = np.array([sum(r[2] for r in own) for own in merged])
        for column, n in configurations(np.array(sizes), demand, capacity):
            stretches += substituted(column, n, merged)
        rest += [(x, rank, n) for own in merged for x, rank, n in own if n]
    best: tuple[list[tuple[int, int, int, int, int]], int] | None = None
    for waste in WASTES:
        # sequences that rounding left too empty are given back, and their pieces best-fitted with the rest
        kept = [s for s in stretches if capacity - s[1] <= waste]
        back = [(x, rank, s[0]) for s in stretches if capacity - s[1] > waste for x, rank in s[2]]
        found = best_fit(rest + back, kept, full, capacity)
        if best is None or found[1] < best[1]:
            best = found
    rows = best[0] + ([(capacity, 0, full, 0, 0)] if full else [])
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Adds sequence_id and offset to pieces (a table that is read more than once)."""
    counted = pieces.groupBy("length").count().collect()  # one row a length
    histogram = {r["length"]: r["count"] for r in counted}
    if histogram and max(histogram) > capacity:
        raise ValueError("a piece is longer than a sequence")
    runs = plan(histogram, capacity)
    keys, names = (runs[:, 0] << 44) + runs[:, 1], [*pieces.columns, "sequence_id", "slot"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            k = np.searchsorted(keys, (length << 44) + rank, "right") - 1
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(runs[k, 3] + rank - runs[k, 1]), pa.array(runs[k, 4])], names=names)

    salts = max(16, sum(histogram.values()) // RANKED)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = salted.groupBy("length", "salt").count().select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = salted.withColumn("rank", F.row_number().over(own)).join(base, ["length", "salt"]).select(*pieces.columns, (F.col("rank") - 1 + F.col("base")).alias("rank"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema.fields) + ", sequence_id long, slot long"
    inside = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    return ranked.mapInArrow(place, schema).withColumn("offset", F.sum("length").over(inside) - F.col("length")).drop("slot")


def pack_documents(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_ids: tuple[int, ...] = (0,), special: bool = False) -> DataFrame:
    """Encodes whole texts and packs their pieces: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(written(token_pieces(docs, tokenizer, id_col=id_col, text_col=text_col, capacity=capacity, end_ids=end_ids, special=special), "pieces"), capacity)
