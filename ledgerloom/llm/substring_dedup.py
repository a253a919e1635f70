"""Substring dedup by automata of repeated phrases.

A window of some words (20) whose sequence also starts earlier - in an earlier document, or earlier in its own - repeats,
and every word that a repeated window covers goes. Documents lie in shards in the order of their ids.

1. Recurring passages are confirmed corpus-wide, word by word (see _repeats): each shard gets back, as text, the passages
   of its own that an earlier shard has, too, each distinct one once, however often the shard holds it.
2. A shard compiles these phrases, and the phrases around which its own windows may recur, into Aho-Corasick automata
   (pyahocorasick, over word numbers), and streams all its documents through them to locate every occurrence. Only what
   an automaton finds goes: an occurrence of a confirmed passage goes whole; around a phrase of the shard's own the
   windows are compared word by word, and all but the first of equal ones go.

An automaton takes a bounded number of letters; a shard with more phrases compiles several, one after the other.

Cases: words are runs of anything but ASCII white space, unchanged; null or empty text has none; a text below the
window keeps all; each row is a document of its own, in the order of id, then text (see _common.over_ranges), rows
without id last; so of identical rows one stays. An empty table gives no rows. Extra columns pass if asked for by name.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import _repeats as R
from ledgerloom.llm._common import flat_text, gathered, numbered_rows

WINDOW = 20
#: Letters of an automaton.
LETTERS = 1_500_000


def compare(t: R.Text, part: np.ndarray, kind: R.Kind) -> np.ndarray:
    """Starts of the windows of a bucket's spans that a smaller shard has, too. part: of each span."""
    n = np.maximum(np.diff(t.bounds) - kind.window + 1, 0)
    start = R.stretches(t.bounds[:-1], n)
    return start[R.same_windows(numbered_rows(R.string_numbers(t), start, kind.window), np.repeat(part, n))]


WORDS = R.Kind(R.words_of, WINDOW, 8, 4 << 20, compare)


def spelled(codes: np.ndarray, base: int) -> np.ndarray:
    """Each word number as three letters, of an alphabet each. A node of an automaton looks through its children one by one, so few letters keep it fast, and three alphabets keep matches on word borders."""
    return np.stack([codes // (base * base), base + codes // base % base, 2 * base + codes % base], -1) + 1


def located(codes: np.ndarray, bounds: np.ndarray, words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every occurrence of the phrases in the documents: its first word, and its number of words.

    codes: word numbers of the documents; bounds: of the documents; words: the phrases' word numbers, one phrase of
    sizes[i] words behind the other. No occurrence crosses documents.
    """
    used = np.unique(words)
    code = np.where(R.among(codes, used), np.searchsorted(used, codes) + 1, 0)  # 0: a word of no phrase
    own = np.searchsorted(used, words) + 1
    base = int(np.ceil((len(used) + 1) ** (1 / 3))) + 1
    text = lambda x: x.astype("<u4").tobytes().decode("utf-32-le")
    inner = bounds[1:-1]
    stream = text(np.insert(spelled(code, base), inner, 0, axis=0))  # no phrase holds what stands between documents
    ends = np.cumsum(sizes)
    out = []
    cuts = np.searchsorted(ends, np.arange(LETTERS // 3, int(ends[-1]) + LETTERS // 3, LETTERS // 3), "right") if len(ends) else []
    done = 0
    for to in [int(x) for x in cuts]:
        to = max(to, done + 1) if done < len(sizes) else done
        if to == done:
            continue
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        letters = text(spelled(own[ends[done] - sizes[done] : ends[to - 1]], base))
        at = 0
        for n in sizes[done:to].tolist():
            automaton.add_word(letters[at : at + 3 * n], n)
            at += 3 * n
        automaton.make_automaton()
        out.append(np.fromiter(automaton.iter(stream), np.dtype([("end", np.int64), ("n", np.int64)])))
        done = to
    found = np.concatenate(out) if out else np.zeros(0, np.dtype([("end", np.int64), ("n", np.int64)]))
    start = (found["end"] + 1) // 3 - found["n"]
    return start - np.searchsorted(inner + np.arange(len(inner)), start, "right"), found["n"]


def repeated_words(text: pa.ChunkedArray, replies: pa.Table, kind: R.Kind) -> tuple[R.Text, np.ndarray]:
    """The words of a shard's documents, and a mark on those that repeated windows cover."""
    t = kind.units(*flat_text(text))
    n = len(t.units)
    told = [(R.unsqueezed(a, np.uint32).astype(np.int64), R.unsqueezed(b, np.uint8)) for a, b in zip(replies["sizes"], replies["body"], strict=True)]
    sizes = np.concatenate([x for x, _ in told] or [np.zeros(0, np.int64)])
    passages = R.words_of(np.concatenate([b for _, b in told] or [np.zeros(0, np.uint8)]), np.concatenate([[0], np.cumsum(sizes)]))
    both = R.Text(np.concatenate([t.buf, passages.buf]), np.concatenate([t.at, passages.at[1:] + len(t.buf)]), t.units, t.bounds)
    code = R.string_numbers(both)
    own, foreign = code[:n], code[n:]
    r = R.runs_of(t, kind)
    # phrases around which the shard's own windows may recur. By place, not by run: a periodic text repeats windows within one run
    places = np.sort(r.grams[R.among(r.grams, np.unique(r.anchor))])
    again = np.unique(places[1:][places[1:] == places[:-1]])
    at = np.flatnonzero(R.among(r.grams, again))
    _, first = np.unique(numbered_rows(own, at, kind.gram), return_index=True)
    at = at[first]
    words = np.concatenate([foreign, own[R.stretches(at, np.full(len(at), kind.gram))]])
    start, size = located(own, t.bounds, words, np.concatenate([np.diff(passages.bounds), np.full(len(at), kind.gram)]))
    whole = size >= kind.window
    gone = R.covered(start[whole], size[whole], n)
    found = np.zeros(n + 1, bool)
    found[start[~whole]] = True
    known = np.zeros(n, bool)  # windows that go already; equal ones of the shard are all among them
    known[R.stretches(start[whole], size[whole] - kind.window + 1)] = True
    run = R.among(r.anchor, again)
    window = R.each_window(r, run)
    reach = np.concatenate([[0], np.cumsum(found)])
    window = window[(reach[window + kind.window - kind.gram + 1] > reach[window]) & ~known[window]]
    number = numbered_rows(own, window, kind.window)
    order = np.argsort(number, kind="stable")  # stable: in the order of documents and starts
    later = np.zeros(len(number), bool)
    later[order[1:]] = number[order[1:]] == number[order[:-1]]
    return t, gone | R.covered(window[later], kind.window, n)


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), window: int = WINDOW, as_is: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text (the words that stay, joined by one space; as_is: the text itself where all stay), and the columns in keep."""
    kind = WORDS if window == WINDOW else R.Kind(R.words_of, window, max(1, window * 2 // 5), WORDS.range_bytes, compare)
    names = ["doc_id", "n_words", "n_removed", "kept_text"]

    def finish(rows: pa.Table, replies: pa.Table, buckets: int) -> pa.Table:
        t, gone = repeated_words(rows["text"], replies, kind)
        n = np.diff(t.bounds)
        removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[t.bounds])
        doc, stay = np.repeat(np.arange(len(rows)), n), np.flatnonzero(~gone)
        size = np.diff(t.at)[stay]
        size[np.append(doc[stay][1:] != doc[stay][:-1], True)[: len(stay)]] -= 1  # no space behind the last word of a document
        body = gathered(t.buf, t.at[stay], size)
        off = np.concatenate([[0], np.cumsum(np.bincount(doc[stay], size, minlength=len(rows)).astype(np.int64))])
        kept = pa.LargeStringArray.from_buffers(len(rows), pa.py_buffer(off.tobytes()), pa.py_buffer(body.tobytes())).cast(pa.string())
        if as_is:
            kept = pc.if_else(pa.array(removed > 0), kept, rows["text"])
        return pa.table([rows["id"], pa.array(n), pa.array(removed), kept, *[rows[f"k{i}"] for i in range(len(keep))]], names=[*names, *[f"k{i}" for i in range(len(keep))]])

    schema = "doc_id long, n_words long, n_removed long, kept_text string" + "".join(f", k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    out = R.repeats(docs, kind, finish, schema, id_col, text_col, list(keep), with_bytes=True)
    return out.select(*names, *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)])
