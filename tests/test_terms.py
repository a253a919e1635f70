"""Near forms of terms against a search through all windows."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest

from ledgerloom.operators import terms


@pytest.fixture(autouse=True)
def shared(spark, tmp_path) -> None:
    spark.sparkContext.setCheckpointDir(str(tmp_path / "shared"))


def nearest(form: str, body: str) -> tuple[str, float] | None:
    """The first window above 0.85, else the first of those that share most, if it is 0.6 or more."""
    grams = {form[i : i + 3] for i in range(len(form) - 2)}
    best, most = None, 0.0
    for size in range(max(3, len(form) // 2), min(len(body), 2 * len(form)) + 1, 3):
        for start in range(0, len(body) - size + 1, size // 3):
            near = body[start : start + size]
            share = len(grams & {near[i : i + 3] for i in range(size - 2)}) / len(grams)
            if share >= 0.6 and share > most:
                best, most = near, share
                if share > 0.85:
                    return best, most
    return (best, most) if best else None


def test_equals_a_search_through_all_windows(spark) -> None:
    rng = random.Random(6)
    text = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))
    forms = [text(rng.randint(4, 20), "abc") for _ in range(12)] + [text(rng.randint(4, 12), "自主协同") for _ in range(4)]
    docs = [text(rng.randint(0, 60), "abc") for _ in range(30)] + [text(rng.randint(0, 40), "自主协同") for _ in range(10)]
    for f in forms:  # near and nearly near ones
        cut = rng.randint(1, len(f) - 1)
        docs += [text(20, "xyz") + f[:cut] + "#" + f[cut:] + text(20, "xyz"), f[cut:] + "-" + f[:cut], f]
    got = {(r["doc_id"], r["term_id"]): (r["near"], r["share"]) for r in terms.near_terms(spark.createDataFrame(list(enumerate(docs)), "doc_id int, text string"), spark.createDataFrame(list(enumerate(forms)), "term_id int, preferred_form string")).collect()}
    want = {(i, j): n for i, d in enumerate(docs) for j, f in enumerate(forms) if (n := nearest(f, d))}
    assert len(want) > 100 and got == want


def test_odd_rows(spark) -> None:
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "ab"), (4, "the closed loop here")], "doc_id int, text string")
    glossary = spark.createDataFrame([("a", "closed  loop"), ("b", "abc"), ("c", None), ("d", " （x）"), ("e", "loop"), ("e", "loop")], "term_id string, preferred_form string")
    assert [(r["doc_id"], r["term_id"]) for r in terms.near_terms(docs, glossary).collect()] == [(4, "e")] or {(r["doc_id"], r["term_id"]) for r in terms.near_terms(docs, glossary).collect()} == {(4, "a"), (4, "e")}
    missing = {(r["doc_id"], r["term_id"]) for r in terms.missing_terms(docs, glossary, chunk=1).collect()}
    assert missing == {(d, t) for d in (2, 3) for t in "abe"} | {(4, "a"), (4, "b")}
    assert terms.missing_terms(docs, glossary.limit(0)).count() == 0 and terms.near_terms(docs.limit(0), glossary).count() == 0


def test_pieces_give_the_same_windows(monkeypatch) -> None:
    """Pairs and letters laid out at once bound the memory and decide nothing."""
    rng = random.Random(8)
    forms = ["".join(rng.choice("ab") for _ in range(rng.randint(4, 15))) for _ in range(20)]
    docs = ["".join(rng.choice("abc") for _ in range(n)) for n in (3, 5, 40, 300, 41, 3)]
    search = lambda: terms._search(pa.table({"doc_id": range(len(docs)), "body": docs}), pa.table({"term_id": range(len(forms)), "form": forms}), 0.6, 0.85).to_pylist()
    got = []
    for pairs, letters in ((1 << 20, 1 << 18), (7, 50), (1, 1)):
        monkeypatch.setattr(terms, "PAIRS", pairs)
        monkeypatch.setattr(terms, "LETTERS", letters)
        got.append({(r["doc_id"], r["term_id"]): (r["near"], r["share"]) for r in search()})
    assert got[0] == got[1] == got[2] == {(i, j): n for i, d in enumerate(docs) for j, f in enumerate(forms) if (n := nearest(f, d))}


def test_rare_grams_decide_nothing(monkeypatch) -> None:
    """Forms of all lengths, also with fewer 3-grams than are asked for first and with more than 64 of them, give the same windows however many of the rarest must come together."""
    rng = random.Random(9)
    text = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))
    long = [text(n, "abcdefgh") for n in (66, 67, 70, 140)]
    forms = [text(rng.randint(4, 8), "ab") for _ in range(15)] + long + ["aaaa", "abababab"]
    docs = [text(n, "ab") for n in (3, 4, 30, 200)] + [text(9, "ab") + f[: len(f) // 2] + "#" + f[len(f) // 2 + 3 :] + text(9, "ab") for f in long] + [long[0][:40] + long[1][:20], "aaaaaaaa"]
    want = {(i, j): n for i, d in enumerate(docs) for j, f in enumerate(forms) if (n := nearest(f, d))}
    assert sum(15 <= j < 19 for _, j in want) >= 4
    for rare, pairs, cells in ((5, 1 << 20, 1 << 24), (1, 9, 1), (2, 1 << 20, 300), (1000, 50, 1)):
        for name, value in (("RARE", rare), ("PAIRS", pairs), ("CELLS", cells)):
            monkeypatch.setattr(terms, name, value)
        got = terms._search(pa.table({"doc_id": range(len(docs)), "body": docs}), pa.table({"term_id": range(len(forms)), "form": forms}), 0.6, 0.85).to_pylist()
        assert {(r["doc_id"], r["term_id"]): (r["near"], r["share"]) for r in got} == want


def test_common_grams_lead_nowhere(monkeypatch) -> None:
    """Texts are full of what forms have in common, but only where a form's rare 3-grams come together are its pairs laid out: what is sorted does not grow with texts times forms."""
    forms = ["and the " + "".join(random.Random(i).sample("bcfgjklmpqrsuvwxyz", 12)) for i in range(200)]
    docs = ["and the " * 200 + f[8:] for f in forms[:20]]
    sizes, sort = [0], terms.np.sort
    monkeypatch.setattr(terms.np, "sort", lambda a, *k, **o: (sizes.append(len(a)), sort(a, *k, **o))[1])
    got = terms._search(pa.table({"doc_id": range(len(docs)), "body": docs}), pa.table({"term_id": range(len(forms)), "form": forms}), 0.6, 0.85)
    monkeypatch.undo()
    assert {(i, i) for i in range(20)} <= {(r["doc_id"], r["term_id"]) for r in got.to_pylist()}
    assert sum(sizes) < 20 * 1600 * 200 / 100  # a hundredth of places times forms


def test_plans_read_the_texts_once(spark) -> None:
    """One cogroup and no join holds for windows, and missing forms add theirs: the plan that the driver keeps stays small."""
    docs, glossary = spark.createDataFrame([(1, "the closed loo here")], "doc_id int, text string"), spark.createDataFrame([("a", "closed loop")], "term_id string, preferred_form string")
    joins = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Join ")
    assert joins(terms.near_terms(docs, glossary)) == 0 and joins(terms.missing_terms(docs, glossary)) == 2


def test_windows_are_not_sent_to_the_driver(spark) -> None:
    """However small they are, the windows meet the lacking forms in a merge join, not as a table that the driver collects."""
    docs, glossary = spark.createDataFrame([(1, "the closed loo here")], "doc_id int, text string"), spark.createDataFrame([("a", "closed loop")], "term_id string, preferred_form string")
    got = terms.missing_terms(docs, glossary)
    assert [tuple(r) for r in got.collect()] == [(1, "a", "closed loop", " closed loo")]
    assert got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("SortMergeJoin [doc_id") == 1
