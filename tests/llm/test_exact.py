"""Results that hashes must not decide, hot ids, and the methods' own decisions."""

from __future__ import annotations

import dataclasses
import hashlib
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerloom.llm import _common, _repeats, language_id, packing, queries, sharding, similarity_join, substring_dedup, suffix_dedup, token_files, topk_search, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
R = np.random.default_rng(8)


def thue_morse(n: int) -> tuple[str, str]:
    """Two words of a and b whose sums of powers agree modulo 2^64 for every odd base."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.fixture(params=[1024, 4096])
def pair(request) -> tuple[str, str]:
    return thue_morse(request.param)


@pytest.fixture
def tokenizer() -> Tokenizer:
    return Tokenizer.from_file(queries.tokenizer_path())


def docs_of(spark, texts: list, more: str = "") -> object:
    return spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], SCHEMA).coalesce(1)


def test_long_words_keep_their_ids(spark, pair, tokenizer, tmp_path) -> None:
    want = {i: np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4") for i, t in enumerate(pair)}
    got = packing.pack_documents(docs_of(spark, list(pair)), queries.tokenizer_path(), capacity=1 << 14, special=True).collect()
    assert {r["doc_id"]: (r["length"], r["ids_crc32"]) for r in got} == {i: (len(x), zlib.crc32(x.tobytes())) for i, x in want.items()}
    out = f"file://{tmp_path}/t"
    token_files.write_token_files(docs_of(spark, list(pair)), out, queries.tokenizer_path(), special=True)
    assert {r["doc_id"]: r["ids_crc32"] for r in token_files.read_token_files(spark, out).collect()} == {i: zlib.crc32(x.tobytes()) for i, x in want.items()}


def test_long_words_do_not_link_or_repeat(spark, pair) -> None:
    a, b = pair
    docs = docs_of(spark, [f"{a} one two three four", f"{b} one two three four"])
    assert {(r["doc_id"], r["class_id"], r["n_links"]) for r in similarity_join.near_duplicates(docs).collect()} == {(0, 0, 0), (1, 1, 0)}
    rest = " ".join(f"w{i}" for i in range(24))
    got = {r["doc_id"]: r["n_removed"] for r in substring_dedup.remove_repeats(docs_of(spark, [f"{a} {a} " * 13, f"{b} {a} " * 13, f"{a} {rest}", f"{b} {rest}"])).collect()}
    # the second text shares windows with the first only if its words are taken for the same; the fourth repeats all but its first word
    words = [(f"{a} {a} " * 13).split(), (f"{b} {a} " * 13).split(), f"{a} {rest}".split(), f"{b} {rest}".split()]
    seen, want = set(), {}
    for i, w in enumerate(words):
        gone = set()
        for k in range(len(w) - 19):
            g = tuple(w[k : k + 20])
            if g in seen:
                gone |= set(range(k, k + 20))
            seen.add(g)
        want[i] = len(gone)
    assert got == want


def test_equal_hashes_do_not_make_equal_strings(monkeypatch) -> None:
    buf = np.frombuffer(b"first wordsecond onethird wordfirst word", np.uint8)
    starts, sizes = np.array([0, 10, 20, 30]), np.array([10, 10, 10, 10])
    got = _common.numbered(buf, starts, sizes, np.zeros(4, np.uint64))
    assert got[0] == got[3] and len(set(got.tolist())) == 3
    values = np.array([1, 2, 3, 1, 2, 4, 1, 2, 3])
    monkeypatch.setattr(_common, "span_hash", lambda sums, a, b: np.zeros(len(a), np.uint64))
    rows = _common.numbered_rows(values, np.array([0, 3, 6]), 3)
    assert rows[0] == rows[2] != rows[1]


def repeats_by_hand(rows: list[tuple]) -> Counter:
    seen, out = set(), Counter()
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        w = (t or "").split()
        gone = set()
        for k in range(len(w) - 19):
            g = tuple(w[k : k + 20])
            if g in seen:
                gone |= set(range(k, k + 20))
            seen.add(g)
        out[(i, len(w), len(gone))] += 1
    return out


def passages() -> list[tuple]:
    word = lambda n: [f"w{x}" for x in R.integers(0, 4000, n)]
    shared = [word(int(n)) for n in R.integers(25, 70, 12)]
    rows = []
    for i in range(80):
        t = word(30)
        for _ in range(int(R.integers(0, 4))):
            s = shared[int(R.integers(12))]
            a = int(R.integers(0, len(s) - 22))
            t += s[a : a + int(R.integers(22, len(s) - a + 1))] + word(int(R.integers(1, 9)))
        rows.append((i, " ".join(t)))
    return rows


def removed(spark, rows: list[tuple]) -> Counter:
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    return Counter((r["doc_id"], r["n_words"], r["n_removed"]) for r in got)


@pytest.mark.parametrize("range_bytes", [900, 4 << 20])
def test_the_automaton_decides(spark, monkeypatch, range_bytes) -> None:
    rows = passages()
    monkeypatch.setattr(substring_dedup, "WORDS", dataclasses.replace(substring_dedup.WORDS, range_bytes=range_bytes))
    monkeypatch.setattr(substring_dedup, "LETTERS", 600)  # several automata
    assert removed(spark, rows) == repeats_by_hand(rows)


def test_what_the_automaton_says_goes(monkeypatch) -> None:
    t = "a0 " + " ".join(f"p{i}" for i in range(22)) + " a1 " + " ".join(f"p{i}" for i in range(22))
    phrase = ("".join(f"p{i} " for i in range(21))).encode()
    replies = pa.table({"sizes": pa.array([_repeats.squeezed(np.array([len(phrase)], np.uint32))]), "body": pa.array([_repeats.squeezed(np.frombuffer(phrase, np.uint8))])})
    text = pa.chunked_array([pa.array([t])])
    gone = substring_dedup.repeated_words(text, replies, substring_dedup.WORDS)[1]
    assert np.flatnonzero(~gone).tolist() == [0, 22, 23]  # the last p21 goes with the shard's own windows
    nowhere = lambda codes, bounds, words, sizes: (np.zeros(0, np.int64), np.zeros(0, np.int64))
    monkeypatch.setattr(substring_dedup, "located", nowhere)
    assert not substring_dedup.repeated_words(text, replies, substring_dedup.WORDS)[1].any()
    everywhere = lambda codes, bounds, words, sizes: (np.arange(len(codes) - 19), np.full(len(codes) - 19, 20))
    monkeypatch.setattr(substring_dedup, "located", everywhere)
    assert substring_dedup.repeated_words(text, replies, substring_dedup.WORDS)[1].all()


def test_merge_of_suffix_arrays_decides(spark, monkeypatch) -> None:
    rows = passages()
    monkeypatch.setattr(suffix_dedup, "BYTES", dataclasses.replace(suffix_dedup.BYTES, range_bytes=900))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    total = lambda: docs.sparkSession and suffix_dedup.remove_repeated_bytes(docs).agg(F.sum("n_removed")).first()[0]
    seen: set[bytes] = set()
    want = 0
    for _, t in rows:
        b = t.encode()
        own = [b[k : k + 50] for k in range(len(b) - 49)]
        gone = np.zeros(len(b), bool)
        for k, g in enumerate(own):
            if g in seen:
                gone[k : k + 50] = True
        seen |= set(own)
        want += int(gone.sum())
    assert total() == want


def test_merge_finds_windows_of_smaller_shards() -> None:
    for _ in range(40):
        w = int(R.choice([5, 8, 11, 50]))
        base, spans, part = R.integers(97, 99, 300).astype(np.uint8), [], []
        for p in range(int(R.integers(1, 7))):
            for _ in range(int(R.integers(1, 4))):
                a, n = int(R.integers(0, 200)), w + int(R.integers(0, 30))
                x = base[a : a + n].copy()
                if R.random() < 0.5:
                    x[R.integers(len(x))] = 99
                spans.append(x)
                part.append(p * 3)
        off = np.concatenate([[0], np.cumsum([len(x) for x in spans])])
        got = suffix_dedup.compare(_repeats.bytes_of(np.concatenate(spans), off), np.array(part), _repeats.Kind(_repeats.bytes_of, w, 3, 100, suffix_dedup.compare)).tolist()
        low: dict[bytes, int] = {}
        for x, p in zip(spans, part, strict=True):
            for i in range(len(x) - w + 1):
                low.setdefault(x[i : i + w].tobytes(), p)
        assert got == [int(o) + i for x, p, o in zip(spans, part, off, strict=False) for i in range(len(x) - w + 1) if low[x[i : i + w].tobytes()] < p]


def test_rows_of_one_id_are_parted(spark, monkeypatch) -> None:
    """A third of the rows without id, a third of one id, many of them equal: partitions and ranges are bounded by bytes all the same."""
    monkeypatch.setattr(_common, "PARTITION_BYTES", 30_000)
    texts = [f"{i} " + "x" * int(n) if i % 2 else "same " * 400 for i, n in enumerate(R.integers(0, 4000, 300))]
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)

    def told(number: int, t: pa.Table) -> dict:
        ids = [x.as_py() for x in t["id"]]
        return {"part": number, "rows": len(ids), "bytes": sum(len(x.as_py()) + 16 for x in t["text"]), "low": min((i for i in ids if i is not None), default=None), "high": max((i for i in ids if i is not None), default=None)}

    got = sorted(_common.over_ranges(docs, "doc_id", "text", (), 10_000, told, "part long, rows long, bytes long, low long, high long").collect())
    assert sum(r["rows"] for r in got) == 300 and max(r["bytes"] for r in got) <= 10_000 and len({r["part"] >> _common.WITHIN for r in got}) > 10 and len(got) > 50
    known = [r for r in got if r["low"] is not None]
    assert got[: len(known)] == known and all(a["high"] <= b["low"] for a, b in zip(known[:-1], known[1:], strict=True))


def test_ids_of_rows_in_several_shards_are_found(spark, tmp_path, tokenizer) -> None:
    rows = [(7, f"text {i} " + "abc " * 30) for i in range(60)] + [(i, f"other {i}") for i in range(20, 60)] + [(None, "no id")] * 3
    out = f"file://{tmp_path}/k"
    token_files.write_token_files(spark.createDataFrame(rows, "doc_id long, text string"), out, queries.tokenizer_path(), shard_bytes=700)
    asked = spark.createDataFrame([(7,), (33,), (5,), (None,), (33,)], "doc_id long").withColumn("ids", F.lit("clash"))
    got = token_files.lookup(spark, out, asked).collect()
    want = Counter((i, tuple([*tokenizer.encode(t, add_special_tokens=False).ids, 0])) for i, t in rows if i in (7, 33))
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in got) == want


def test_tree_search_opens_few_nodes() -> None:
    centres = R.normal(size=(40, 16)) * 4000
    v = np.rint(np.repeat(centres, 100, 0) + R.normal(size=(4000, 16)) * 40).astype(np.int64)
    tree, ids = topk_search.BallTree(v), np.arange(len(v))
    queries_ = v[::97]
    row, name, score, opened = topk_search.search(tree, ids, v, queries_, ids[::97], np.full(len(queries_), -np.inf), 5)
    for r in range(len(queries_)):
        s = v @ queries_[r]
        best = sorted((-int(x), int(i)) for i, x in zip(ids, s, strict=True) if i != ids[::97][r])[:5]
        assert [(-a, b) for a, b in best] == list(zip(score[row == r].tolist(), name[row == r].tolist(), strict=True))
    assert opened < 0.5 * len(queries_) * len(tree.centre)
    leaf = tree.left < 0
    assert sorted(tree.order.tolist()) == list(range(4000)) and (tree.high - tree.low)[leaf].max() <= topk_search.LEAF
    for n in range(len(tree.centre)):
        own = tree.order[tree.low[n] : tree.high[n]]
        if leaf[n]:
            assert np.linalg.norm(v[own] - tree.centre[n], axis=1).max() <= tree.radius[n] + 1e-6


def test_top_k_of_few_large_and_odd_vectors(spark, monkeypatch) -> None:
    monkeypatch.setattr(topk_search, "BLOCK", 3)
    monkeypatch.setattr(topk_search, "TASK_BLOCKS", 1)
    big = 1.5e6  # scores beyond 2^53
    v = [(i, [big * float(x) for x in R.integers(-3, 4, 4)]) for i in range(30)] + [(None, [1.0] * 4), (3, [big] * 4), (3, [big] * 4)]
    df = spark.createDataFrame(v, "vec_id long, vector array<double>").withColumn("score", F.lit("clash"))
    whole = [(i, [int(np.floor(x * 256)) for x in y]) for i, y in v if i is not None]
    got = topk_search.top_k(df, df, 4, vector_col="vector", shard_rows=9).collect()
    asked: dict = {}
    for i, y in whole:
        asked[i] = min(asked.get(i, y), y)
    want = []
    for q, x in asked.items():
        best = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), i) for i, y in whole if i != q)[:4]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert Counter(tuple(r) for r in got) == Counter(want)
    few = topk_search.top_k(df.where("vec_id < 3"), df.where("vec_id = 1"), 5, vector_col="vector").collect()
    assert {r["vec_id"] for r in few} == {0, 2}


def best_fit_decreasing(lengths: list[int], capacity: int) -> int:
    rooms: list[int] = []
    for x in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= x]
        if fits:
            rooms[min(fits, key=lambda i: rooms[i])] -= x
        else:
            rooms.append(capacity - x)
    return len(rooms)


@pytest.mark.parametrize("kind", ["normal", "middle", "small", "few"])
def test_packing_is_near_best_fit(kind) -> None:
    n = 3000
    lengths = {"normal": np.exp(R.normal(6, 1, n)), "middle": R.integers(600, 1100, n), "small": R.integers(1, 300, n), "few": R.choice([700, 683, 1025, 342], n)}[kind]
    lengths = np.clip(lengths, 1, 2048).astype(int).tolist()
    rows = packing.plan(dict(Counter(lengths)), 2048)
    assert rows[:, 2].sum() == n
    load = Counter()
    for x, _, count, first, _ in rows.tolist():
        for s in range(first, first + count):
            load[s] += x
    assert max(load.values()) <= 2048 and sorted(load) == list(range(len(load)))
    assert len(load) <= best_fit_decreasing(lengths, 2048) * 1.005 + 1


def test_filter_lists(spark) -> None:
    lines = ["! comment", "", "||ads.example^", "|https://exact.org/|", "/promo/*.gif", "@@||ads.example/ok/", "/track[0-9]+/", "||Case.org/Ab$match-case", "*foo*bar", "plain"]
    rules = url_filter.filter_rules(lines) + url_filter.filter_rules([f"||host{i}.example^" for i in range(3000)])
    by = {r["rule"]: r["tokens"] for r in rules}
    assert by["||ads.example^"] == ["ads", "example"] and by["plain"] == [] and by["*foo*bar"] == [] and by["/track[0-9]+/"] == [] and "gif" not in by["/promo/*.gif"]
    with pytest.raises(ValueError):
        url_filter.filter_rule("||x^$third-party")
    urls = ["http://ads.example/x", "http://sub.ads.example:80/", "http://ads.example.org/", "http://badads.example/", "http://ads.example/ok/1", "https://exact.org/", "https://exact.org/a", "http://a.b/promo/x.gif", "http://a.b/promo/x.png", "http://a/track12", "http://a/track", "http://case.org/Ab", "http://Case.org/Abc", "http://a/foo/x/bar", "http://a/explain", "http://www.host17.example/", "http://host3000.example/", "http://u/" + "y" * 20000, None, "", "x", "http://ads.example/x"]
    want = ["block", "block", "allow", "allow", "allow", "block", "allow", "block", "allow", "block", "allow", "allow", "block", "block", "block", "block", "allow", "allow", "allow", "allow", "allow", "block"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("token", F.lit("clash"))
    for most in (16 << 20, 0):
        got = {r["page_id"]: r["verdict"] for r in url_filter.judge(pages, rules, broadcast_bytes=most).collect()}
        assert got == dict(enumerate(want))
    assert url_filter.judge(pages, []).where("verdict = 'allow'").count() == len(urls)
    assert url_filter.judge(pages.limit(0), rules).count() == 0


def test_training_step_and_temperature_by_hand() -> None:
    rows = [(np.array([0, 2]), np.array([3, 1]), "a", False), (np.array([1, 2]), np.array([1, 1]), "b", False), (np.array([0]), np.array([1]), "a", False)] * 4
    idf = np.array([1.0, 2.0, 1.5])
    model = language_id.train(rows, idf, epochs=2)
    z, n = [[0.0, 0.0] for _ in range(4)], [[0.0, 0.0] for _ in range(4)]

    def weight(i: int, k: int, l1: float = 0.02) -> float:
        if abs(z[i][k]) <= l1:
            return 0.0
        return -(z[i][k] - np.sign(z[i][k]) * l1) / ((1.0 + np.sqrt(n[i][k])) / 0.5 + 0.1)

    order = np.random.default_rng(7)
    for _ in range(2):
        for j in order.permutation(len(rows)).tolist():
            has, counts, label, _ = rows[j]
            x = {int(i): (1 + np.log(c)) * idf[i] for i, c in zip(has, counts, strict=True)}
            norm = np.sqrt(sum(v * v for v in x.values()))
            x = {i: v / norm for i, v in x.items()} | {3: 0.1}
            s = [sum(v * weight(i, k) for i, v in x.items()) for k in (0, 1)]
            e = [np.exp(v - max(s)) for v in s]
            before = {(i, k): weight(i, k) for i in x for k in (0, 1)}
            for i, v in x.items():
                for k in (0, 1):
                    g = v * (e[k] / sum(e) - (label == "ab"[k]))
                    sigma = (np.sqrt(n[i][k] + g * g) - np.sqrt(n[i][k])) / 0.5
                    z[i][k] += g - sigma * before[i, k]
                    n[i][k] += g * g
    assert np.allclose(model.weights, [[weight(i, k) for k in (0, 1)] for i in range(3)]) and np.allclose(model.bias, [0.1 * weight(3, k) for k in (0, 1)])
    language_id.calibrate(model, [r[:3] for r in rows] + [(np.array([0, 1]), np.array([1, 1]), "a")])
    c = model.calibration
    assert c["loss_after"] <= c["loss_before"] and 0.005 < model.temperature < 20


def test_features_by_hand() -> None:
    texts = ["Ünï code!", "", None, "aa", "漢字かな 12", "x" * 5000 + " the end"]
    for t, (has, counts, letters, _) in zip(texts, language_id.features(pa.array(texts)), strict=True):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in t or "")
        want = Counter()
        for n in (1, 2, 3):
            for i in range(len(low) - n + 1):
                cp = np.array([ord(c) for c in low[i : i + n]] + [0] * 3, np.uint32)
                want[int(language_id.gram_columns(cp, language_id.COLUMNS)[n - 1][1][0])] += 1
        assert dict(zip(has.tolist(), counts.tolist(), strict=True)) == dict(want) and letters == sum(c.isalpha() for c in t or "")


def test_calibrated_scores_spread(spark) -> None:
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fit(d, ~language_id.held_out("doc_id"))
    assert model.calibration["loss_after"] < model.calibration["loss_before"] and model.calibration["error_after"] < 0.1
    cut = d.where("lang is not null and length(text) > 200").withColumn("text", F.substring("text", 50, 12)).withColumn("lang_pred", F.lit("clash"))
    p = language_id.predict(cut, model, keep=("lang",)).collect()
    right, score = np.mean([r["lang"] == r["lang_pred"] for r in p]), np.mean([r["score"] for r in p])
    assert abs(right - score) < 0.12 and np.std([r["score"] for r in p]) > 0.05


def test_sharding_query(spark, tmp_path) -> None:
    texts = ["one", "one", None, "", "é漢", "x" * 10000] + [f"t{i % 30}" for i in range(90)]
    spark.createDataFrame([(i if i != 7 else None, t, None, None, None) for i, t in enumerate(texts)], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op1_sharding(spark, str(tmp_path)).collect()
    raw = lambda t: (t or "").encode()
    assert Counter((r["size"], r["text_crc32"]) for r in got) == Counter((len(raw(t)) + 8, zlib.crc32(raw(t))) for t in texts)
    counts = Counter(r["shard"] for r in got)
    assert set(counts) == set(range(24)) and max(counts.values()) - min(counts.values()) <= 1
    assert all(sorted(r["slot"] for r in got if r["shard"] == s) == list(range(counts[s])) for s in counts)
    assert {(r["law"], r["grown_shard"]) for r in got} == {("rows", None)}


def test_token_and_packing_queries_against_the_library(spark, tmp_path, tokenizer) -> None:
    texts = ["it's <|endoftext|> é", None, "", "a  b\n\n c", "word " * 3000, "word " * 3000]
    rows = [(i * 3, t, None, None, None) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).withColumn("length", F.lit("clash")).withColumn("shard", F.lit("clash")).write.parquet(f"{tmp_path}/documents.parquet")
    ids = {i: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for i, t, *_ in rows}
    start, want = 0, set()
    for i in sorted(ids):
        want.add((i, start, len(ids[i]), zlib.crc32(ids[i].tobytes())))
        start += len(ids[i])
    assert {tuple(r) for r in queries.op7_token_files(spark, str(tmp_path)).collect()} == want
    pieces = queries.op8_packing(spark, str(tmp_path)).collect()
    assert all(zlib.crc32(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for r in pieces)
    assert sum(r["length"] for r in pieces) == start
    by: dict = {}
    for r in pieces:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


def test_suffix_dedup_of_hot_and_clashing_rows(spark, monkeypatch) -> None:
    monkeypatch.setattr(suffix_dedup, "BYTES", dataclasses.replace(suffix_dedup.BYTES, range_bytes=700))
    text = "".join(chr(97 + int(x)) for x in R.integers(0, 26, 120))
    rows = [(i, f"{i:03d}{text}{i:03d}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("part", F.lit("clash")).withColumn("block", F.lit(b"clash"))
    got = {r["doc_id"]: r for r in suffix_dedup.remove_repeated_bytes(docs, keep=("part",)).collect()}
    seen: set[str] = set()
    for i, t in rows:
        own = [t[k : k + 50] for k in range(len(t) - 49)]
        gone = {p for k, g in enumerate(own) if g in seen for p in range(k, k + 50)}
        seen |= set(own)
        assert got[i]["n_removed"] == len(gone) and bytes(got[i]["kept_bytes"]).decode() == "".join(c for p, c in enumerate(t) if p not in gone)
    assert {r["part"] for r in got.values()} == {"clash"} and hashlib.sha256(bytes(got[0]["kept_bytes"])).hexdigest() == hashlib.sha256(rows[0][1].encode()).hexdigest()


def test_sharding_of_a_hot_key(spark) -> None:
    hot = spark.range(400).select(F.col("id").alias("doc_id"), F.array(F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.col("id") % 40 + 10).cast("long")).alias("links"), F.lit("clash").alias("shard"), F.lit("x").alias("slot")).repartition(20)
    got = sharding.balanced_shards(hot, 8).collect()
    assert set(Counter(r["shard"] for r in got).values()) == {50}
