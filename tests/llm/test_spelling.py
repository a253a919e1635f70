"""Spelling variants against all pairs of words, over crowded segments, odd rows and ties."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter


from pyspark.sql import functions as F

from ledgerloom.llm import spelling


def near(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(docs: list[tuple], long: int = 5, often: int = 3) -> list[tuple]:
    count: Counter = Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            count[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 97 == 0 else w] += 1
    n = {w: c for w, c in count.items() if len(w) >= long and c >= often}
    by = {w: [v for v in n if near(v, w)] for w in n}
    form = {}
    for w, vs in by.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(by[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def got(df, **how) -> list[tuple]:
    return sorted(map(tuple, spelling.variants(df, **how).collect()))


def varied(rng: random.Random, w: str) -> str:
    i = rng.randrange(len(w) + 1)
    return rng.choice([w[:i] + rng.choice("abÀé") + w[i:], w[: i - 1] + w[i:] if i else w, w[: i - 1] + rng.choice("xyß") + w[i:] if i else w])


def test_equals_all_pairs(spark) -> None:
    rng = random.Random(12)
    base = ["".join(rng.choice("abcdeéÀ") for _ in range(rng.randint(4, 7))) for _ in range(40)]
    words = base + [varied(rng, rng.choice(base)) for _ in range(160)]
    words += [v for w in base[:8] for v in (w.upper(), w + w)] + ["aaaaa", "aaaaaa", "aaaaaaa", "baaaaa", "aaaaab"]
    docs = [(rng.choice([None, i]), " ".join(rng.choice(words) + rng.choice(["", ",", "-1", "×"]) for _ in range(60))) for i in range(60)]
    docs += [(1, None), (2, ""), (3, "12 ×÷ ..."), (4, "Zebras zebras ZEBRAS"), (4, "Zebras zebras ZEBRAS")]
    want = plain(docs)
    assert sum(r[1] is not None for r in want) > 20 and sum(r[2] not in (r[0], r[1]) for r in want) > 0
    assert got(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), limit=30) == want


def test_crowded_segments_lose_no_pair(spark) -> None:
    """All words share their first half, and many their last: each is cut until only one letter is open."""
    words = [f"prefix{a}{b}{c}" for a in "abcdefgh" for b in "abcdefgh" for c in "abcd"] + [f"prefix{a}{b}{c}x" for a in "abc" for b in "abc" for c in "abc"]
    df = spark.createDataFrame([(w, i + 1) for i, w in enumerate(words)], "word string, n long")
    pairs = {tuple(sorted((r["a"], r["b"]))) for r in spelling.near(df, limit=300).collect()}
    assert pairs == {tuple(sorted((v, w))) for i, v in enumerate(words) for w in words[:i] if near(v, w)}


def test_one_edit_of_long_words(spark) -> None:
    rng = random.Random(2)
    pairs = []
    for _ in range(200):
        a = "".join(rng.choice("ab") for _ in range(rng.randint(60, 90)))
        b = varied(rng, a) if rng.random() < 0.7 else varied(rng, varied(rng, a))
        pairs += [(a, b)] if len(a) <= len(b) <= len(a) + 1 else [(b, a)] if len(b) <= len(a) <= len(b) + 1 else []
    pairs += [("x" * 80, "x" * 80), ("x" * 80, "x" * 81)]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", spelling.one_edit(F.col("a"), F.col("b")).alias("ok")).collect()
    assert [r["ok"] for r in got] == [near(r["a"], r["b"]) for r in got] and 50 < sum(r["ok"] for r in got) < len(got) - 20


def test_ties_long_runs_names_and_no_rows(spark) -> None:
    assert got(spark.createDataFrame([], "doc_id long, text string")) == []
    long = "ab" * 4_000
    docs = [(i, f"{long} {long}x words words words wordz worda") for i in range(3)]
    df = spark.createDataFrame([(*d, 1, 2, 3) for d in docs], "`doc.id` long, `te``xt` string, word int, n int, size int")
    assert got(df, id_col="doc.id", text_col="te`xt") == plain(docs)
    ties = [(0, "baker " * 6 + "maker " * 6 + "faker " * 3)]
    assert got(spark.createDataFrame(ties, "doc_id long, text string")) == plain(ties)
    assert dict((r[0], r[1]) for r in plain(ties))["faker"] == "baker"
