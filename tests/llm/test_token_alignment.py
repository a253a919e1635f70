"""Alignment of two tokenizers against whole-text encoding by the libraries, over odd rows and made-up texts."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ledgerloom.llm import queries, token_alignment

A, B = queries.tokenizer_path(), queries.tokenizer_path("piece_bpe_32k.model")
BYTE_OF = {c: b for c, b in token_alignment._byte_letters().items()}
a_tok, b_tok = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
a_tok.encode_special_tokens = True


def groups_of(text: str | None) -> list[tuple[list[int], list[int]]]:
    """The groups of a whole text, none if it has no tokens."""
    if not text:
        return []
    want = (" " + text).encode()
    a, b = a_tok.encode(" " + text, add_special_tokens=False).ids, b_tok.encode(text)
    a_bytes = [bytes(BYTE_OF[c] for c in a_tok.id_to_token(i)) for i in a]
    b_bytes = [bytes([int(b_tok.id_to_piece(i)[1:-1], 16)]) if b_tok.is_byte(i) else b_tok.id_to_piece(i).replace("▁", " ").encode() for i in b]
    if b"".join(a_bytes) != want or b"".join(b_bytes) != want:
        return []
    a_end, b_end = np.cumsum([len(x) for x in a_bytes]).tolist(), np.cumsum([len(x) for x in b_bytes]).tolist()
    out, i, j = [], 0, 0
    for cut in sorted({*a_end} & {*b_end}):
        x, y = a_end.index(cut, i) + 1, b_end.index(cut, j) + 1
        out.append((a[i:x], b[j:y]))
        i, j = x, y
    return out


def plain(rows: list[tuple]) -> list[tuple]:
    every = [groups_of(t) for _, t in rows]
    links = [Counter((x, y) for a, b in gs for x in a for y in b) for gs in every]
    counts = Counter(p for c in links for p in c)
    most = defaultdict(int)
    for (a, _), n in counts.items():
        most[a] = max(most[a], n)
    out = []
    for (i, _), gs, c in zip(rows, every, links, strict=True):
        told = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in gs)
        out.append((i, sum(len(a) for a, _ in gs), sum(len(b) for _, b in gs), len(gs), sum(c.values()), sum(m for p, m in c.items() if counts[p] == most[p[0]]), sum(m * counts[p] for p, m in c.items()), hashlib.sha256(told.encode()).hexdigest() if gs else ""))
    return sorted(out, key=repr)


ODD = [
    None, "", " ", "  ", "a", " a", "a ", "a  ", "a  b", "a \n b", "a\n  b", "\n", "\t\tx  y\t z ", "it's we'll  'tis", "naïve café   x", "one  two 　three", "日本語のテキスト と English", "🙂🙂 a🙂b", "▁ sign", "sign ▁", "plain text again", "plain text again",
    "<|endoftext|> <s> </s> <unk> <0x41>", "x" * 3000, "ab " * 2000, "aé" * 500, "\u0000 zero", "é combined", "1234567 89", "ﬁ ligature Å", "a\u0085 b", "  a   b", "﻿ bom", "end\n",
]


def got(df: object, **how: object) -> list[tuple]:
    return sorted((tuple(r)[:8] for r in token_alignment.alignment(df, A, B, **how).collect()), key=repr)


def test_equals_whole_texts(spark) -> None:
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "no id here"), (None, "no id here"), (3, "again id 3")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(df.repartition(3)) == plain(rows)
    kept = {r["doc_id"]: r["groups"] for r in token_alignment.alignment(df, A, B, keep_groups=True).collect() if r["doc_id"] in (4, 2)}
    assert kept[4] == ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups_of("a"))


def test_empty_clashing_names_and_larger_tables(spark, monkeypatch) -> None:
    assert got(spark.createDataFrame([], "doc_id long, text string")) == []
    rows = [(1, "plain words here"), (2, "plain words there")]
    odd = spark.createDataFrame([(*r, 7, 8, 9) for r in rows], "`a.b` long, `te``xt` string, row int, pairs int, n int")
    monkeypatch.setattr(token_alignment, "looked_up", lambda r, t, on, how="inner": __import__("ledgerloom.llm._columns", fromlist=["x"]).looked_up(r, t, on, how, most=0))  # as with counts too large to be broadcast
    assert got(odd, id_col="a.b", text_col="te`xt") == plain(rows)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from(" \n\ta.'s1é▁日  \u0085🙂<>|"), max_size=30) | st.text(max_size=20), min_size=1, max_size=6))
def test_units_align_as_whole_texts(texts: list[str]) -> None:
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    b = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())})
    rows = [r for x in token_alignment._batch(token_alignment.aligner(A, B), b, 0, True) for r in x.to_pylist() if r["counts"] is None]
    for t, r in zip(texts, rows, strict=True):
        want = groups_of(t)
        assert r["groups"] == (";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in want) or None)
        assert {p["pair"]: p["m"] for p in r["pairs"] or []} == Counter((x << 32) | y for a, b in want for x in a for y in b)
