"""The operators of the llm subpackage against brute force, SQL, round trips and held-out accuracy, on small fixtures with
nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import dataclasses
import hashlib
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerloom.llm import decontamination, language_id, packing, queries, sharding, similarity_join, substring_dedup, suffix_dedup, token_files, topk_search, url_filter

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
R = np.random.default_rng(3)
VOCABULARY = [a + b for a in "ba ce di fo gu lé".split() for b in "na ro st".split()]


def prose(n: int) -> str:
    return " ".join(R.choice(VOCABULARY, n))


def odd_rows() -> list[tuple]:
    base = [prose(60) for _ in range(6)]
    near = base[0].split()
    near[30] = "other"
    texts = [*base, base[0], base[0], " ".join(near), base[1] + " " + prose(30), None, "", "  ", "!!", "a", prose(3000), prose(25) + "\n" + base[2], base[3][:200], "x" * 500, "x" * 400]
    rows = [(i, t, "en" if i % 2 else "fr", "s", len(t or "")) for i, t in enumerate(texts)]
    return rows + [rows[0], (None, base[4], None, None, None), (3, "another text under a known id", None, None, None)]


@pytest.fixture(scope="module")
def rows() -> list[tuple]:
    return odd_rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_against_sql(spark, name) -> None:
    con = duckdb.connect()
    for t in "documents benchmark embeddings pages".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = queries.QUERIES[name](spark, SF)
    want = con.execute(queries.ORACLE_SQL[name])
    names = sorted(d[0] for d in want.description)
    assert sorted(got.columns) == names
    order = [d[0] for d in want.description]
    assert Counter(tuple(r[c] for c in names) for r in got.collect()) == Counter(tuple(r[order.index(c)] for c in names) for r in want.fetchall())


def in_order(rows: list[tuple]) -> list[tuple]:
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is None, (r[1] or "").encode()))


def test_sharding(spark, rows, docs, empty) -> None:
    keyed = docs.withColumn("links", F.when(F.col("text").isNotNull(), F.array(F.xxhash64("text")))).withColumn("shard", F.lit("clash"))
    got = sharding.balanced_shards(keyed, 4).collect()
    counts = Counter(r["shard"] for r in got)
    assert len(got) == len(rows) and max(counts.values()) - min(counts.values()) <= 1
    for s in range(4):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(counts[s]))
    copies = {}
    for r in got:
        copies.setdefault(r["text"], set()).add(r["shard"])
    assert all(len(v) == 1 for t, v in copies.items() if t is not None)
    assert sharding.balanced_shards(empty.withColumn("links", F.array(F.lit(1).cast("long"))), 4).count() == 0
    hot = spark.range(90).select(F.col("id").alias("doc_id"), F.array(F.when(F.col("id") < 60, F.lit(7)).otherwise(F.col("id") % 5 + 100).cast("long")).alias("links"))
    placed = sharding.balanced_shards(hot, 6).collect()
    assert set(Counter(r["shard"] for r in placed).values()) == {15}
    assert len({r["shard"] for r in placed if r["doc_id"] < 60}) <= 6


def test_grants_keep_quotas() -> None:
    load, quota = np.array([10, 10, 10]), np.array([10, 10, 10])
    assert len(sharding.grants([(0, 1, 5, 0, 4), (1, 0, 5, 0, 4)], load, quota)) == 2  # a swap fits full shards
    assert sharding.grants([(0, 1, 5, 0, 4)], load, quota) == []


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text: str | None) -> list[str]:
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


@pytest.mark.parametrize("most", [16 << 20, 0])
def test_decontamination(spark, rows, docs, empty, most) -> None:
    items = [(1, " ".join(rows[2][1].split()[5:30])), (2, "a"), (3, None), (4, ""), (10, rows[0][1])]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("clash"))
    windows = {i: {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))} for i, t in items if (w := plain_words(t))}
    want = []
    for i, t, *_ in rows:
        w, hit, found = plain_words(t), set(), set()
        for item, own in windows.items():
            for x in own:
                for k in range(len(w) - len(x) + 1):
                    if tuple(w[k : k + len(x)]) == x:
                        hit |= set(range(k, k + len(x)))
                        found.add(str(item))
        want.append((i, len(w), len(hit), tuple(sorted(found)), bool(hit)))
    got = decontamination.contamination(docs, bench, broadcast_bytes=most).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["item_ids"]), r["contaminated"]) for r in got) == Counter(want)
    assert decontamination.decontaminate(docs, bench).count() == sum(not x[-1] for x in want)
    assert decontamination.contamination(empty, bench).count() == 0
    assert decontamination.decontaminate(docs, bench.limit(0)).count() == len(rows)


def test_url_filter(spark) -> None:
    urls = ["http://a.example.com/de/x", "https://EXAMPLE.net/en/", "http://x.net/y", "http://w.org/fr/casino/1", "http://w.org/casino-1", "http://w.org/casinos", None, "", "nourl", "http://net?q", "http://www.example.net/en"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash"))
    rules = [url_filter.host_rule(*r) for r in url_filter.HOST_RULES] + [url_filter.word_rule(w) for w in url_filter.BLOCK_WORDS]
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judge(pages, rules).collect()}
    assert got == {0: ("example.com/de/", "block"), 1: ("example.net/en/", "allow"), 2: ("net/", "block"), 3: ("org/fr/", "allow"), 4: (None, "block"), 5: (None, "allow"), 6: (None, "allow"), 7: (None, "allow"), 8: (None, "allow"), 9: (None, "allow"), 10: ("net/", "block")}


def brute_classes(rows: list[tuple]) -> list[tuple]:
    sets = [frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if (w := plain_words(t)) else frozenset() for _, t, *_ in rows]
    n = len(rows)

    def linked(i: int, j: int) -> bool:
        if rows[i][1] is None or rows[j][1] is None:
            return False
        return rows[i][1] == rows[j][1] or bool(sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9)

    link = [{j for j in range(n) if j != i and linked(i, j)} for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in link[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((rows[i][0], min(ids) if ids else None, len(link[i])))
    return out


def test_similarity_join(spark, rows, docs, empty, monkeypatch) -> None:
    more = []
    base = prose(200).split()
    for i in range(40):  # a large group of near copies, over several blocks
        w = list(base)
        w[int(R.integers(200))] = f"n{i}"
        more.append((100 + i, " ".join(w), None, None, None))
    every = rows + more
    monkeypatch.setattr(similarity_join, "BLOCK_SHINGLES", 2000)
    monkeypatch.setattr(similarity_join, "TASK_SHINGLES", 3000)
    got = similarity_join.near_duplicates(spark.createDataFrame(every, SCHEMA).withColumn("key", F.lit("clash"))).collect()
    assert Counter(tuple(r) for r in got) == Counter(brute_classes(every))
    kept = similarity_join.keep_one(spark.createDataFrame(every, SCHEMA)).collect()
    classes = {}
    for (i, c, _), r in zip(brute_classes(every), every, strict=True):
        if r[1] is not None:
            classes.setdefault(c if c != 3 else r[1], r)
    assert len(kept) == len(classes) + sum(r[1] is None for r in every)
    assert similarity_join.near_duplicates(empty).count() == 0


def test_posterior_bounds_are_sound() -> None:
    for n, m in similarity_join.needed_matches(160, 32, 0.8, 1e-6):
        assert 0 < m < 0.8 * n


def test_topk(spark) -> None:
    v = [(i, [float(x) for x in R.normal(size=8)], "c") for i in range(300)] + [(300, None, "c"), (301, [], "c"), (302, [1.0, float("nan")], "c"), (7, [1.0] * 8, "c"), (303, [2.0] * 3, "c"), (304, [5.0] * 8, "c"), (305, [5.0] * 8, "c")]
    df = spark.createDataFrame(v, "vec_id long, embedding array<float>, score string")
    whole = [(i, np.floor(np.array(x, np.float32).astype(float) * 256).astype(int)) for i, x, _ in v if x and np.isfinite(x).all()]
    got = topk_search.top_k(df, df.where("vec_id % 50 = 0"), 5, shard_rows=40).collect()
    want = []
    for q, x in whole:
        if q % 50 == 0:
            best = sorted(((-int(x @ y), i) for i, y in whole if i != q and len(y) == len(x)))[:5]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert Counter(tuple(r) for r in got) == Counter(want)
    assert topk_search.top_k(df.limit(0), df.limit(0)).count() == 0


def test_language_id(spark, docs, empty) -> None:
    d = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    model = language_id.fit(d, ~language_id.held_out("doc_id"))
    p = language_id.predict(d, model, keep=("doc_id", "lang")).withColumn("held", language_id.held_out("doc_id")).where("held").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in p) / len(p) > 0.95
    assert all(0 <= r["score"] <= 1 for r in p)
    odd = {(r["doc_id"], r["lang_pred"]) for r in language_id.predict(docs, model).collect()}
    assert {(10, "und"), (11, "und"), (12, "und"), (13, "und")} <= odd
    assert language_id.fit(empty, F.lit(True)) is None and language_id.predict(empty, None).count() == 0


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    t.encode_special_tokens = True
    return t


def ids_of(tokenizer, text: str | None) -> np.ndarray:
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")


def test_token_files(spark, rows, docs, empty, tokenizer, tmp_path) -> None:
    more = rows + [(50, "it's  we'll 12 <|endoftext|> é漢字\n\t x ", None, None, None)]
    token_files.write_token_files(spark.createDataFrame(more, SCHEMA), f"file://{tmp_path}/a", queries.tokenizer_path(), shard_bytes=3000)
    got = sorted(token_files.read_token_files(spark, f"file://{tmp_path}/a").collect(), key=lambda r: r["start"])
    start = 0
    for r, (i, t, *_) in zip(got, in_order(more), strict=True):
        x = ids_of(tokenizer, t)
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i, start, len(x), zlib.crc32(x.tobytes()))
        start += len(x)
    found = token_files.lookup(spark, f"file://{tmp_path}/a", spark.createDataFrame([(0,), (50,), (999,), (None,)], "doc_id long")).collect()
    assert Counter(r["doc_id"] for r in found) == {0: 2, 50: 1}
    token_files.write_token_files(empty, f"file://{tmp_path}/b", queries.tokenizer_path())
    assert token_files.read_token_files(spark, f"file://{tmp_path}/b").count() == 0


def test_packing(spark, rows, docs, empty, tokenizer) -> None:
    got = packing.pack_documents(docs, queries.tokenizer_path(), capacity=256).collect()
    want = Counter()
    for i, t, *_ in rows:
        x = ids_of(tokenizer, t)
        n = -(-len(x) // 256)
        first = len(x) - (n - 1) * 256
        cuts = [0, *(first + k * 256 for k in range(n))]
        want.update((i, k, a, b - a, zlib.crc32(x[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    by: dict = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    assert len(by) <= -(-sum(r["length"] for r in got) // 256) * 1.25 + 1
    assert packing.pack_documents(empty, queries.tokenizer_path()).count() == 0


@pytest.mark.parametrize("range_bytes", [1500, 6 << 20])
def test_substring_dedup(spark, rows, docs, empty, monkeypatch, range_bytes) -> None:
    monkeypatch.setattr(substring_dedup, "WORDS", dataclasses.replace(substring_dedup.WORDS, range_bytes=range_bytes))
    every = rows + [(40, "r " * 70, None, None, None)]
    seen, want = set(), []
    marks = []
    for i, t, *_ in in_order(every):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = set()
        for k in range(len(w) - 19):
            g = tuple(w[k : k + 20])
            if g in seen:
                gone |= set(range(k, k + 20))
            seen.add(g)
        marks.append(gone)
        want.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    got = substring_dedup.remove_repeats(spark.createDataFrame(every, SCHEMA).withColumn("part", F.lit("clash"))).collect()
    assert Counter(tuple(r) for r in got) == Counter(want)
    assert substring_dedup.remove_repeats(empty).count() == 0


@pytest.mark.parametrize("range_bytes", [1500, 4 << 20])
def test_suffix_dedup(spark, rows, empty, monkeypatch, range_bytes) -> None:
    monkeypatch.setattr(suffix_dedup, "BYTES", dataclasses.replace(suffix_dedup.BYTES, range_bytes=range_bytes))
    seen: set[bytes] = set()
    want = []
    for i, t, *_ in in_order(rows):
        b = (t or "").encode()
        own = [b[k : k + 50] for k in range(len(b) - 49)]
        gone = np.zeros(len(b) + 1, bool)
        for k, g in enumerate(own):
            if g in seen:
                gone[k : k + 50] = True
        seen |= set(own)
        spans = int((gone[1:] < gone[:-1]).sum())
        want.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=False) if not g)).hexdigest()))
    got = suffix_dedup.remove_repeated_bytes(spark.createDataFrame(rows, SCHEMA)).collect()
    assert Counter((r[0], r[1], r[2], r[3], hashlib.sha256(r[4]).hexdigest()) for r in got) == Counter(want)
    assert suffix_dedup.remove_repeated_bytes(empty).count() == 0


def test_suffix_array_and_prefixes() -> None:
    s = np.frombuffer(b"banana bandana banana", np.uint8)
    order = suffix_dedup.suffix_array(s, 64)
    raw = s.tobytes()
    assert [raw[i:] for i in order] == sorted(raw[i:] for i in range(len(raw)))
    common = suffix_dedup.common_prefixes(s, order, 64)
    for k in range(1, len(raw)):
        a, b = raw[order[k - 1] :], raw[order[k] :]
        assert common[k] == next((j for j in range(min(len(a), len(b))) if a[j] != b[j]), min(len(a), len(b)))


def test_pipeline(spark, rows, tokenizer, tmp_path) -> None:
    """Every stage but the model against brute force on its own input."""
    texts = [prose(80) for _ in range(30)]
    data = [(i, t, "en" if i % 2 else "fr", "s", len(t)) for i, t in enumerate(texts)]
    data += [(30, texts[0], "en", "s", 1), (31, "123 456", "en", "s", 7), (32, None, "en", "s", None), (33, prose(10) + " " + " ".join(texts[1].split()[:60]) + " " + prose(30), "fr", "s", 9), (34, prose(20) + " " + " ".join(texts[2].split()[:10]) + " " + prose(9), "en", "s", 5)]
    spark.createDataFrame(data, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(texts[2].split()[:10]))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [len(corpus_pipeline.STAGES), corpus_pipeline.ORACLE_SQL] == [5, None]
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r["doc_id"] for r in got}
    assert ids == set(range(34)) - {2, 30, 31, 32}
    words = next(t for i, t, *_ in data if i == 33).split()
    x = ids_of(tokenizer, " ".join(words[:10] + words[70:]))
    assert sum(r["length"] for r in got if r["doc_id"] == 33) == len(x)
    assert sum(r["length"] for r in got if r["doc_id"] == 5) == len(ids_of(tokenizer, texts[5]))
