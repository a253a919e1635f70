"""The token queries against an untouched tokenizer, on texts that spell out an added token."""

from __future__ import annotations

import json
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from ledgerloom.llm import _tokens, queries

END = "<|endoftext|>"
TEXTS = ["plain one", f"a {END} b", END, f"{END}{END} x", None, "", "<|endoftext", "|> plain", f"it's{END}é漢字\n", "last  one", f"x{END}"]


@pytest.fixture(scope="module")
def want() -> dict[int, np.ndarray]:
    t = Tokenizer.from_file(queries.tokenizer_path())
    return {i: np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4") for i, x in enumerate(TEXTS)}


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory) -> str:
    d = str(tmp_path_factory.mktemp("special"))
    spark.createDataFrame([(i, x, "en", "s", 1) for i, x in enumerate(TEXTS)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    return d


def test_token_files_of_special_texts(spark, sf, want) -> None:
    start = 0
    for r in sorted(queries.op7_token_files(spark, sf).collect(), key=lambda r: r["doc_id"]):
        x = want[r["doc_id"]]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(x), zlib.crc32(x.tobytes()))
        start += len(x)
    assert start == sum(map(len, want.values()))


def test_packing_of_special_texts(spark, sf, want) -> None:
    for got in (queries.op8_packing(spark, sf), corpus_pipeline.pack(spark, queries.table(spark, sf, "documents"), sf)):
        assert {r["doc_id"]: (r["length"], r["ids_crc32"]) for r in got.collect()} == {i: (len(x), zlib.crc32(x.tobytes())) for i, x in want.items()}


def test_encoder_of_added_tokens_that_are_not_special(tmp_path) -> None:
    told = json.load(open(queries.tokenizer_path(), encoding="utf-8"))
    told["added_tokens"].append(dict(told["added_tokens"][0], id=50257, content="lo w", special=False))
    (path := tmp_path / "t.json").write_text(json.dumps(told), encoding="utf-8")
    texts = ["hello world", " lo", f"a {END} hello", " hello world"]
    raw = [x.encode() for x in texts]
    for special in (True, False):
        t = Tokenizer.from_file(str(path))
        t.encode_special_tokens = not special
        ids, bounds = _tokens.Encoder(str(path), special).encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), [])
        assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [t.encode(x, add_special_tokens=False).ids for x in texts]
