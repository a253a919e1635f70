"""Mixing: targets by plain resharing, a plain version of the whole mix, odd rows, the laws of permutations and draws."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import mixing

SCHEMA = "doc_id long, text string, source string"
R = np.random.default_rng(11)


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def targets(sizes: list[int], weights: list[int]) -> list[float]:
    """Shares by weight; what is above three times a size goes to the others by weight, again and again."""
    out, left, free = [0.0] * len(sizes), float(sum(sizes)), set(range(len(sizes)))
    while left > 1e-9 and free:
        w = sum(weights[i] for i in free)
        for i in free:
            out[i] += left * weights[i] / w
        left = 0.0
        for i in list(free):
            if out[i] >= 3 * sizes[i]:
                left += out[i] - 3 * sizes[i]
                out[i] = 3 * sizes[i]
                free.discard(i)
    return out


def keys(*parts: object) -> list[int]:
    return [int(hashlib.md5(":".join(map(str, [*parts, r])).encode()).hexdigest()[:15], 16) for r in range(mixing.ROUNDS)]


def permuted(x: int, n: int, ks: list[int]) -> int:
    for k in ks:
        other = (k - x) % n
        if hashlib.md5(f"{k}:{max(x, other)}".encode()).hexdigest()[0] < "8":
            x = other
    return x


def plain(rows: list[tuple], block: int) -> list[tuple]:
    """(doc_id, size, source_size, target, taken) of all rows."""
    sources = sorted({r[2] for r in rows if r[2] is not None}) + ([None] if any(r[2] is None for r in rows) else [])
    own = [sorted((r for r in rows if r[2] == s), key=lambda r: (r[0] is None, r[0] or 0, len(words(r[1])))) for s in sources]
    sizes = [sum(len(words(r[1])) for r in x) for x in own]
    out = []
    for number, (docs, size, target) in enumerate(zip(own, sizes, targets(sizes, [(5, 2, 1)[i % 3] for i in range(len(own))]), strict=True)):
        times, full = Counter(), size // block
        todo, turn = int(np.floor(target + 0.5 + 1e-9)), 0
        while todo > 0:
            for j in range(-(-min(todo, size) // block)):
                b = permuted(j, full, keys("mix", number, turn)) if j < full else full
                for p in range(b * block, b * block + min(block, min(todo, size) - j * block)):
                    times[p] += 1
            todo, turn = todo - size, turn + 1
        at = 0
        for r in docs:
            n = len(words(r[1]))
            out.append((r[0], n, size, round(target, 6), sum(times[p] for p in range(at, at + n))))
            at += n
    return sorted(out, key=repr)


def got(docs: object, block: int) -> list[tuple]:
    return sorted(((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in mixing.taken(mixing.plan(docs, block=block)).collect()), key=repr)


def some_rows() -> list[tuple]:
    text = lambda n: " \t".join(f"w{x}" for x in R.integers(0, 50, n))
    rows = [(int(i), text(int(R.integers(0, 40))), ["hot", "b", "Z", "é", None][min(int(R.integers(0, 9)), 4)]) for i in range(120)]
    rows += [(None, text(7), "b"), (None, text(7), "b"), (5, None, "b"), (6, "", None), (7, " \n ", "none"), (8, text(900), "long"), (9, "one", "tiny")]
    return rows + [(3, "same words here", "hot")] * 5


@pytest.mark.parametrize("block", [3, 1000])
def test_equals_the_plain_version(spark, block) -> None:
    rows = some_rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = plain(rows, block)
    assert all(r[4] <= 3 * r[1] for r in want)
    assert got(df, block) == want
    assert block < 1000 or got(df.repartition(5, "text"), block) == want  # reruns agree, however rows come


def test_sources_meet_their_targets(spark) -> None:
    t = mixing.taken(mixing.plan(spark.createDataFrame(some_rows(), SCHEMA), block=16))
    for r in t.groupBy("source").agg(F.sum("taken").alias("n"), F.first("target").alias("target"), F.first("source_size").alias("size")).collect():
        assert abs(r["n"] - r["target"]) <= 0.5 and r["target"] <= 3 * r["size"]


def test_no_rows_no_words_and_clashing_names(spark) -> None:
    empty = spark.createDataFrame([], SCHEMA)
    assert got(empty, 8) == []
    assert mixing.slots(mixing.plan(empty)).count() == 0
    nothing = spark.createDataFrame([(1, None, "a"), (2, "", None)], SCHEMA)
    assert got(nothing, 8) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
    odd = spark.createDataFrame([(1, "x y", "a", 1, 2, 3, 4), (2, "z", "b", 1, 2, 3, 4)], "`a.b` long, `te``xt` string, `my source` string, number int, size int, part int, words int")
    r = mixing.taken(mixing.plan(odd, id_col="a.b", text_col="te`xt", source_col="my source")).collect()
    assert {(x["doc_id"], x["size"], x["source"]) for x in r} == {(1, 2, "a"), (2, 1, "b")}


def test_the_mix_holds_the_words_that_are_counted(spark) -> None:
    rows = some_rows()
    mix = mixing.plan(spark.createDataFrame(rows, SCHEMA), block=16, texts=True)
    out = mixing.mixed(mix, shard=4).collect()
    assert sorted((r["shard"], r["slot"]) for r in out) == [(i // 4, i % 4) for i in range(len(out))]  # gapless
    by_source, want = Counter(), Counter()
    for r in out:
        by_source[r["source"]] += len(r["words"])
    for r in mixing.taken(mix).collect():
        want[r["source"]] += r["taken"]
    assert by_source == +want
    known = {s: " ".join(w for r in sorted((r for r in rows if r[2] == s), key=lambda r: (r[0] is None, r[0] or 0, len(words(r[1])))) for w in words(r[1])) for s in by_source if s in ("long", "tiny")}
    for r in out:
        if r["source"] in known:
            assert " ".join(r["words"]) in known[r["source"]]


def test_permutations_are_permutations_and_move_things(spark) -> None:
    for n in (1, 2, 3, 100, 1024):
        x = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), mixing.keys_of("s", n)).alias("p"), "id").collect()
        assert sorted(r["p"] for r in x) == list(range(n))
        assert [r["p"] for r in x] == [permuted(r["id"], n, keys("s", n)) for r in x]
    assert sum(r["p"] == r["id"] for r in x) < 12


def test_counts_of_shards_are_multinomial_draws_given_their_sums(spark) -> None:
    rows = [(i, " ".join(["w"] * 40), f"s{i % 3}") for i in range(600)]
    mix = mixing.plan(spark.createDataFrame(rows, SCHEMA), block=8)
    n = {(r["shard"], r["number"]): r["n"] for r in mixing.shard_counts(mix, 50).collect()}
    whole = [s for s in range(mix.slots // 50)]
    for number, p in enumerate(np.array([5, 2, 1]) / 8):
        each = np.array([n.get((s, number), 0) for s in whole])
        assert abs(each.mean() - 50 * p) < 1.5
        assert 0.5 < each.var() / (50 * p * (1 - p)) < 1.7
