"""Alignment of two tokenizers' ids: where both cut a text at the same byte, and which ids share the parts between.

A is a byte-level BPE (tokenizers), B a BPE with byte fallback (sentencepiece) that puts a space before the text; both see
a space and the text. In each Arrow batch, DuckDB holds the tokens of both as tables of byte intervals. An ASOF join finds
the B token that holds an A token's last byte: both end there, or B goes on. Running sums of the shared ends number the
groups, a range join puts B's tokens into them, and the id pairs of each group are counted. Each batch counts its pairs by
documents; Spark merges these partial counts, and joins them with the pairs of each document.

Texts are made of units that both tokenizers encode alike wherever they stand: a cut lies before a space that follows
something else than white space. A's pre-tokens never hold a space behind another character, and no piece of B does, which
its vocabulary tells (else a text is one unit). So a worker encodes and aligns each distinct unit once, as long as it keeps
it; units are told apart by their bytes.

Cases: null and empty texts, and texts of which either tokenizer's bytes differ from a space and the text (as with the
sign U+2581, which B takes for a space) have no tokens: zeros, and groups are the empty string. Equal rows count as
documents of their own; ids may be null or repeat, a row's own number tells rows apart. No documents, no rows; further
columns, whatever their names, are left out.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm._columns import looked_up, named
from ledgerloom.llm._common import CHUNK_BYTES, flat_text, gathered, groups, numbered, slices, small_batches, tidy, written

#: Fixed value: what B writes for a space.
SPACE = "▁"
#: Memory that DuckDB may take in a task.
DUCKDB_MEMORY = "800MB"
_SCHEMA = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, pairs array<struct<pair:bigint,m:bigint>>, counts array<struct<pair:bigint,n:bigint>>"
#: Bytes of units that a worker keeps, and units that are encoded at a time.
KEPT, JOINED = 8 << 20, 500
COUNTS = ("n_a", "n_b", "n_groups", "n_links")
_aligners: dict[tuple[str, str], Aligner] = {}

_UNIT_GROUPS = """
CREATE OR REPLACE TEMP TABLE ga AS
SELECT unit, id, start, coalesce(sum(cut) OVER (ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS g, stop
FROM (SELECT a.unit, a.id, a.start, a.stop, (a.stop = b.stop)::INTEGER AS cut FROM a ASOF JOIN b ON a.stop > b.start);
CREATE OR REPLACE TEMP TABLE gb AS
SELECT b.unit, b.id, b.start, s.g FROM b JOIN (SELECT g, min(start) AS start, max(stop) AS stop FROM ga GROUP BY g) s ON b.start >= s.start AND b.stop <= s.stop;
"""
_UNIT_COUNTS = """
SELECT unit, sum(x.n)::BIGINT AS n_a, sum(y.n)::BIGINT AS n_b, count(*) AS n_groups, sum(x.n * y.n)::BIGINT AS n_links
FROM (SELECT g, min(unit) AS unit, count(*) AS n FROM ga GROUP BY g) x JOIN (SELECT g, count(*) AS n FROM gb GROUP BY g) y USING (g) GROUP BY unit ORDER BY unit
"""
_UNIT_TOKENS = """
SELECT unit, g, side, id FROM (SELECT unit, g, 0 AS side, id, start FROM ga UNION ALL SELECT unit, g, 1, id, start FROM gb) ORDER BY g, side, start
"""
_UNIT_PAIRS = """
INSERT INTO unit_pairs SELECT unit, (x.id::BIGINT << 32) | y.id AS pair, sum(x.n * y.n)::BIGINT AS m
FROM (SELECT g, unit, id, count(*) AS n FROM ga GROUP BY g, unit, id) x JOIN (SELECT g, id, count(*) AS n FROM gb GROUP BY g, id) y USING (g) GROUP BY unit, pair
"""
_DOC_PAIRS = """
CREATE OR REPLACE TEMP TABLE doc_pairs AS
SELECT doc, pair, sum(times * m)::BIGINT AS m FROM (SELECT doc, unit, count(*) AS times FROM held GROUP BY doc, unit) JOIN unit_pairs USING (unit) GROUP BY doc, pair
"""


class Tokenizers:
    """Both tokenizers, and the bytes of their tokens."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        shown = _byte_letters()
        self.a_buf, self.a_at, self.a_size = _joined({i: bytes(shown[c] for c in t) if all(c in shown for c in t) else t.encode() for t, i in self.a.get_vocab().items()})
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_buf, self.b_at, self.b_size = _joined({i: bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)})
        self.by_unit = not any(SPACE in p.lstrip(SPACE) for p in pieces)

    def tokens(self, units: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of A and of B, and their number for each unit; of a unit that a tokenizer does not give back, none. Units that end in something else than white space are encoded many at a time."""
        size = np.array([len(u) for u in units], np.int64)
        alone = np.array([not self.by_unit or u[-1] <= 32 or u[-1] >= 0x80 for u in units], bool)
        order = np.concatenate([np.flatnonzero(~alone), np.flatnonzero(alone)])
        m, out = int((~alone).sum()), []
        for encode, spelt, at, width in ((self._a, self.a_buf, self.a_at, self.a_size), (self._b, self.b_buf, self.b_at, self.b_size)):
            ids, n = [], np.zeros(len(units), np.int64)
            runs = [order[i : min(i + JOINED, m)] for i in range(0, m, JOINED)]
            one = order[m:].tolist()
            for run, got in zip(runs, encode([b"".join(units[i] for i in r).decode() for r in runs]), strict=True):
                got, ends, stop = np.array(got, np.int64), np.cumsum(size[run]), np.cumsum(width[got])
                cut = np.searchsorted(stop, ends)
                if len(stop) and stop[-1] == ends[-1] and (stop[cut] == ends).all() and gathered(spelt, at[got], width[got]).tobytes() == b"".join(units[i] for i in run):
                    ids.append(got)
                    n[run] = np.diff(cut + 1, prepend=0)
                else:
                    one += run.tolist()
            kept = [i for r in runs for i in r.tolist() if n[i]]
            for i, got in zip(one, encode([units[i].decode() for i in one]), strict=True):
                got = np.array(got, np.int64)
                if gathered(spelt, at[got], width[got]).tobytes() == units[i]:
                    ids.append(got)
                    n[i] = len(got)
                    kept.append(i)
            flat, kept = np.concatenate([*ids, np.zeros(0, np.int64)]), np.array(kept, np.int64)
            first = np.zeros(len(units), np.int64)
            first[kept] = np.cumsum(n[kept]) - n[kept]
            out.append((gathered(flat, first, n), n))
        return out

    def _a(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.a.encode_batch_fast(texts, add_special_tokens=False)]

    def _b(self, texts: list[str]) -> list[list[int]]:
        return self.b.encode([t[1:] for t in texts], num_threads=1)


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level BPE writes for bytes: printable ones stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _joined(tokens: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all tokens, where each id's begin, and how many they are."""
    size = np.zeros(max(tokens) + 1, np.int64)
    size[list(tokens)] = [len(t) for t in tokens.values()]
    return np.frombuffer(b"".join(tokens[i] for i in sorted(tokens)), np.uint8), np.cumsum(size) - size, size


def unit_starts(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where units begin in texts that begin with a space each: there, and at each space behind something else than white space, unless nothing else follows in the text. What may be white space counts as such."""
    n = len(buf)
    space = buf == 32
    before = np.concatenate([np.zeros(3, np.uint8), buf])
    p1, p2, p3 = before[2 : n + 2], before[1 : n + 1], before[:n]
    white = (p1 <= 32) | ((p2 == 0xC2) & ((p1 == 0x85) | (p1 == 0xA0))) | ((p3 >= 0xE1) & (p3 <= 0xE3) & ((p2 == 0x80) | (p2 == 0x81) | (p2 == 0x9A)))
    start = space & ~white
    other = np.flatnonzero(~space)
    at = np.flatnonzero(start)
    ends = offsets[np.searchsorted(offsets, at, "right")]
    follows = np.searchsorted(other, at)
    ok = follows < len(other)
    ok[ok] = other[follows[ok]] < ends[ok]
    start[at[~ok]] = False
    start[offsets[:-1]] = True
    return np.flatnonzero(start)


class Aligner:
    """The units that a worker has aligned: in DuckDB their bytes and id pairs, here their counts and their groups as text. It forgets all beyond KEPT bytes of units."""

    def __init__(self, a_path: str, b_path: str):
        import duckdb

        self.both = Tokenizers(a_path, b_path)
        self.con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": DUCKDB_MEMORY, "temp_directory": ""})
        most = max(len(self.both.a_size), len(self.both.b_size))
        self.digits, self.digit_at, self.digit_size = _joined({i: b"%d," % i for i in range(most)})
        self._forget()

    def _forget(self) -> None:
        self.con.execute("CREATE OR REPLACE TABLE known (unit BIGINT, spelt BLOB); CREATE OR REPLACE TABLE unit_pairs (unit BIGINT, pair BIGINT, m BIGINT)")
        self.n, self.bytes, self.told = 0, 0, np.zeros(0, np.uint8)
        self.counts, self.told_size = np.zeros((len(COUNTS), 0), np.int64), np.zeros(0, np.int64)

    def numbers(self, units: pa.Array) -> np.ndarray:
        """The numbers of distinct units (by their bytes); new ones are aligned."""
        if self.bytes > KEPT:
            self._forget()
        asked = pa.table({"i": pa.array(range(len(units)), pa.int64()), "spelt": units})
        self.con.register("asked", asked)
        found = self.con.sql("SELECT i, unit FROM asked JOIN known USING (spelt)").to_arrow_table()
        out = np.full(len(units), -1, np.int64)
        out[found["i"].to_numpy()] = found["unit"].to_numpy()
        new = np.flatnonzero(out < 0)
        fresh = units.take(pa.array(new))
        sizes = pc.binary_length(fresh).to_numpy().astype(np.int64)
        out[new] = self.n + np.arange(len(new))
        for i, j in slices(np.concatenate([[0], np.cumsum(sizes)]), CHUNK_BYTES):
            self._align(fresh.slice(i, j - i))
        self.con.register("fresh", pa.table({"unit": pa.array(out[new]), "spelt": fresh}))
        self.con.execute("INSERT INTO known SELECT * FROM fresh")
        self.bytes += int(sizes.sum())
        return out

    def _align(self, fresh: pa.Array) -> None:
        (a, n_a), (b, n_b) = self.both.tokens(fresh.to_pylist())
        good = (n_a > 0) & (n_b > 0)
        for name, ids, n, width in (("a", a, n_a, self.both.a_size), ("b", b, n_b, self.both.b_size)):
            unit = np.repeat(np.arange(len(n)), n)
            ids, unit = ids[good[unit]], unit[good[unit]]
            stop = np.cumsum(width[ids])
            self.con.register(name, pa.table({"unit": unit + self.n, "id": ids, "start": stop - width[ids], "stop": stop}))
        self.con.execute(_UNIT_GROUPS)
        self.con.execute(_UNIT_PAIRS)
        sums = self.con.sql(_UNIT_COUNTS).to_arrow_table()
        told = self.con.sql(_UNIT_TOKENS).to_arrow_table()
        unit, g, side, ids = (told[c].to_numpy() for c in ("unit", "g", "side", "id"))
        text, ends = gathered(self.digits, self.digit_at[ids], self.digit_size[ids]), np.cumsum(self.digit_size[ids])
        if len(ids):
            last = np.append(g[1:] != g[:-1], True)
            text[ends[last] - 1] = ord(";")
            text[ends[:-1][(side[1:] != side[:-1]) & ~last[:-1]] - 1] = ord("|")
        counts = np.zeros((len(COUNTS), len(fresh)), np.int64)
        counts[:, sums["unit"].to_numpy() - self.n] = [sums[c].to_numpy() for c in COUNTS]
        self.told, self.told_size = np.concatenate([self.told, text]), np.concatenate([self.told_size, np.bincount(unit - self.n, self.digit_size[ids], len(fresh)).astype(np.int64)])
        self.counts, self.n = np.concatenate([self.counts, counts], axis=1), self.n + len(fresh)


def aligner(a_path: str, b_path: str) -> Aligner:
    """The worker's aligner."""
    if (a_path, b_path) not in _aligners:
        _aligners[a_path, b_path] = Aligner(a_path, b_path)
    return _aligners[a_path, b_path]


def _batch(own: Aligner, b: pa.RecordBatch, first: int, keep: bool) -> Iterator[pa.RecordBatch]:
    """A row for each document of a batch, and one row with the partial counts of id pairs."""
    n, wanted, con = len(b), _arrow_schema(), own.con
    buf, offsets = flat_text(b.column("text"))
    bad = np.diff(offsets) == 0
    buf, offsets = np.insert(buf, offsets[:-1], 32), offsets + np.arange(n + 1)  # a space before each text
    starts = unit_starts(buf, offsets) if own.both.by_unit else offsets[:-1]
    size = np.diff(np.append(starts, len(buf)))
    doc = np.searchsorted(offsets, starts, "right") - 1
    _, at, which = np.unique(numbered(buf, starts, size), return_index=True, return_inverse=True)
    spelt = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(size[at])]).astype(np.int32)), pa.py_buffer(gathered(buf, starts[at], size[at]))])
    unit = own.numbers(spelt)[which]
    bad[doc[own.counts[0][unit] == 0]] = True
    held = ~bad[doc]
    doc, unit = doc[held], unit[held]
    sums = {c: np.bincount(doc, own.counts[k][unit], n).astype(np.int64) for k, c in enumerate(COUNTS)}
    told_at = np.cumsum(own.told_size) - own.told_size
    digest, shown = [""] * n, [None] * n
    for i, j in zip(*(x.tolist() for x in groups(doc)), strict=True):
        whole = gathered(own.told, told_at[unit[i:j]], own.told_size[unit[i:j]])[:-1].tobytes()
        digest[doc[i]] = hashlib.sha256(whole).hexdigest()
        shown[doc[i]] = whole.decode() if keep else None
    con.register("held", pa.table({"doc": doc, "unit": unit}))
    con.execute(_DOC_PAIRS)
    lists = con.sql("SELECT doc, list(struct_pack(pair := pair, m := m) ORDER BY pair) AS pairs FROM doc_pairs GROUP BY doc ORDER BY doc").to_arrow_table()
    counts = con.sql("SELECT list(struct_pack(pair := pair, n := n)) AS counts FROM (SELECT pair, count(*) AS n FROM doc_pairs GROUP BY pair)").to_arrow_table()["counts"]
    for name in ("a", "b", "asked", "fresh", "held"):
        con.unregister(name)
    con.execute("DROP TABLE doc_pairs; DROP TABLE IF EXISTS ga; DROP TABLE IF EXISTS gb")
    where = np.full(n, -1, np.int64)
    where[lists["doc"].to_numpy()] = np.arange(len(lists))
    pairs = lists["pairs"].combine_chunks().take(pa.array(where, mask=where < 0)) if len(lists) else pa.nulls(n, wanted.field("pairs").type)
    rows = {"row": pa.array(first + np.arange(n)), "doc_id": b.column("doc_id"), **{c: pa.array(v) for c, v in sums.items()}, "groups_sha256": pa.array(digest), "groups": pa.array(shown, pa.string()), "pairs": pairs, "counts": pa.nulls(n, wanted.field("counts").type)}
    yield pa.RecordBatch.from_arrays([_cast(rows[f.name], f.type) for f in wanted], schema=wanted)
    if counts[0].is_valid:
        yield pa.RecordBatch.from_arrays([_cast(counts, f.type) if f.name == "counts" else pa.nulls(1, f.type) for f in wanted], schema=wanted)


def _cast(a: pa.Array | pa.ChunkedArray, to: pa.DataType) -> pa.Array:
    a = a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a
    return a if a.type == to else a.cast(to)


def _arrow_schema() -> pa.Schema:
    long, pair = pa.int64(), lambda x: pa.list_(pa.struct([("pair", pa.int64()), (x, pa.int64())]))
    return pa.schema([("row", long), ("doc_id", long), ("n_a", long), ("n_b", long), ("n_groups", long), ("n_links", long), ("groups_sha256", pa.string()), ("groups", pa.string()), ("pairs", pair("m")), ("counts", pair("n"))])


def aligned(docs: DataFrame, a_path: str, b_path: str, *, id_col: str = "doc_id", text_col: str = "text", keep_groups: bool = False) -> DataFrame:
    """A table, written: of each document its counts, its groups (their digest, and the text `a1,a2|b1;...` if kept) and its linked id pairs with their links (m); and rows with partial counts."""
    small_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, first = aligner(a_path, b_path), TaskContext.get().partitionId() << 33
        for b in batches:
            if len(b):
                yield from _batch(own, b, first, keep_groups)
                first += len(b)
                tidy()

    return written(docs.select(named(id_col).cast("long").alias("doc_id"), named(text_col).alias("text")).mapInArrow(work, _SCHEMA), "aligned")


def pair_counts(table: DataFrame) -> DataFrame:
    """pair (the id of A above 32 bits, that of B below), a, b, n (documents that hold it linked), best (whether no other pair of the same A id has more): the partial counts of all batches, merged."""
    n = written(table.where("counts IS NOT NULL").select(F.explode("counts").alias("c")).groupBy(F.col("c.pair").alias("pair")).agg(F.sum("c.n").alias("n")), "pair-counts")
    own = n.select("pair", F.shiftright("pair", 32).cast("int").alias("a"), F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("b"), "n")
    most = own.groupBy("a").agg(F.max("n").alias("most"))
    return own.join(most, "a").select("pair", "a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def alignment(docs: DataFrame, a_path: str, b_path: str, **how: object) -> DataFrame:
    """Of each document: doc_id, n_a, n_b, n_groups, n_links, n_best (links of which no other pair of their A id is in more documents), count_sum (documents that hold a link's pair, over all links), groups_sha256, groups."""
    table = aligned(docs, a_path, b_path, **how)
    counts = written(pair_counts(table).select("pair", "n", "best"), "alignment-counts")
    links = table.where("counts IS NULL").select("row", F.explode("pairs").alias("p")).select("row", "p.pair", "p.m")
    told = looked_up(links, counts, ["pair"]).groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("m")).otherwise(0)).alias("n_best"), F.sum(F.col("m") * F.col("n")).alias("count_sum"))
    own = table.where("counts IS NULL").drop("pairs", "counts").join(told, "row", "left")
    return own.select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).cast("long").alias("n_best"), F.coalesce("count_sum", F.lit(0)).cast("long").alias("count_sum"), "groups_sha256", "groups")
