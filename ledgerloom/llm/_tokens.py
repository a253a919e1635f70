"""Token ids of many texts at once, with the tokenizers library.

Each distinct pre-token is encoded once by the library and kept in a bounded table of the worker; the ids of a text
are then gathered from it. The table is keyed by a hash, and the bytes of every pre-token are held against those it was
learned from; a text with one that differs goes to the library as a whole. This needs a byte-level BPE without
normaliser; other tokenizers encode whole texts. The table knows no added tokens, so a text that holds the content of
one goes to the library, too.
"""

from __future__ import annotations

import json
import os
import re
import sys
import unicodedata

import numpy as np

from ledgerloom.llm._common import U64, differ, gathered, slices, string_hash

#: Distinct pre-tokens that a worker keeps.
KEPT = 1_500_000
#: The white space of Unicode.
_SPACES = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_OTHER, _LETTER, _NUMBER, _SPACE = range(4)
_classes: list[np.ndarray] = []
_encoders: dict[tuple[str, bool], Encoder] = {}


def _class_of() -> np.ndarray:
    if not _classes:
        kind = {"L": _LETTER, "N": _NUMBER}
        t = np.array([kind.get(unicodedata.category(chr(i))[0], _OTHER) for i in range(sys.maxunicode + 1)], np.uint8)
        t[_SPACES] = _SPACE
        _classes.append(t)
    return _classes[0]


def pretokens(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte offsets at which the pre-tokens of the texts start: contractions, runs of letters, of digits or of others with one space before, white space."""
    lead = np.flatnonzero((buf & 0xC0) != 0x80)
    cp = np.frombuffer(buf.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    n = len(cp)
    kind = _class_of()[cp]
    bound = np.searchsorted(lead, offsets)
    edge = np.zeros(n + 1, bool)
    edge[bound] = True
    edge[n] = True
    run = edge.copy()
    run[1:n] |= kind[1:] != kind[:-1]
    space = kind == _SPACE
    start = run[:n] & space
    last = space[:-1] & ~space[1:] & ~edge[1:n]
    start[:-1] |= last
    spaced = np.zeros(n, bool)
    spaced[1:] = (cp[:-1] == 32) & ~edge[1:n]
    start |= run[:n] & ~space & ~spaced
    marks = np.flatnonzero((cp == 39) & start)
    if len(marks):
        padded = np.concatenate([cp, np.zeros(3, np.uint32)])
        stop = bound[np.searchsorted(bound, marks, "right").clip(max=len(bound) - 1)]
        one, two = padded[marks + 1], padded[marks + 2]
        short = np.isin(one, [ord(c) for c in "stmd"]) & (marks + 2 <= stop)
        long = np.zeros(len(marks), bool)
        for pair in ("re", "ve", "ll"):
            long |= (one == ord(pair[0])) & (two == ord(pair[1]))
        long &= marks + 3 <= stop
        for at, size in ((marks[short], 2), (marks[long], 3)):
            start[at + 1] = False
            at = at[at + size < n] + size
            start[at] = True
    return lead[start]


class Encoder:
    """Ids of texts by the tokenizer of a file; it lives in one worker. special: whether special tokens that a text spells out become their ids (the library's default) or are plain text."""

    def __init__(self, path: str, special: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        vocab = self.tokenizer.get_vocab()
        top = max(vocab.values()) + 1
        self.dtype = np.uint16 if top <= 1 << 16 else np.uint32
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        pre = told.get("pre_tokenizer") or {}
        self.by_pretoken = told.get("normalizer") is None and told.get("model", {}).get("type") == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        added = [t["content"] for t in told.get("added_tokens") or [] if t["content"] and (special or not t.get("special"))]
        # pre-tokens that are joined to be encoded must not spell an added token together
        self.by_pretoken = self.by_pretoken and not any(" " in t[1:] for t in added)
        self.added = [t.encode() for t in added]
        self.spelled = re.compile(b"(?=" + b"|".join(re.escape(t) for t in self.added) + b")")
        self.width = np.ones(top, np.int64)
        for token, i in vocab.items():
            self.width[i] = len(token)
        self._forget()

    def _forget(self) -> None:
        self.known, self.at, self.size, self.flat = np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, self.dtype)
        self.spelt, self.spelt_at, self.spelt_size = np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, keys: np.ndarray, strings: list[str]) -> None:
        """Encodes new pre-tokens. Those of a space and a run stay apart when joined, so they go many at a time."""
        if len(self.known) + len(keys) > KEPT:
            self._forget()
        spaced = np.array([len(s) > 1 and s[0] == " " and not s[1].isspace() for s in strings], bool)
        order = np.concatenate([np.flatnonzero(spaced), np.flatnonzero(~spaced)])
        m = int(spaced.sum())
        ids, sizes = [], []
        if m:
            some = [strings[i] for i in order[:m]]
            got = [x.ids for x in self.tokenizer.encode_batch_fast(["".join(some[j : j + 500]) for j in range(0, m, 500)], add_special_tokens=False)]
            joined = np.concatenate([np.array(x, self.dtype) for x in got])
            reach = np.concatenate([[0], np.cumsum(self.width[joined])])
            ends = np.cumsum([len(s.encode()) for s in some])
            cut = np.searchsorted(reach, ends)
            ids.append(joined)
            sizes.append(np.diff(cut, prepend=0))
        if m < len(strings):
            got = [x.ids for x in self.tokenizer.encode_batch_fast([strings[i] for i in order[m:]], add_special_tokens=False)]
            ids.append(np.array([y for x in got for y in x], self.dtype))
            sizes.append(np.array([len(x) for x in got], np.int64))
        size = np.concatenate(sizes)
        at = len(self.flat) + np.cumsum(size) - size
        known = np.concatenate([self.known, keys[order]])
        by = np.argsort(known, kind="stable")
        self.known, self.at, self.size = known[by], np.concatenate([self.at, at])[by], np.concatenate([self.size, size])[by]
        self.flat = np.concatenate([self.flat, *ids])
        raw = [strings[i].encode() for i in order.tolist()]
        spelt = np.array([len(x) for x in raw], np.int64)
        self.spelt_at = np.concatenate([self.spelt_at, len(self.spelt) + np.cumsum(spelt) - spelt])[by]
        self.spelt_size = np.concatenate([self.spelt_size, spelt])[by]
        self.spelt = np.concatenate([self.spelt, np.frombuffer(b"".join(raw), np.uint8)])

    def _some(self, buf: np.ndarray, offsets: np.ndarray, end: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Texts that hold an added token by the library, those between them by the table."""
        raw = buf.tobytes()
        if not self.by_pretoken:
            return self._whole(buf, offsets, end)
        if not any(t in raw for t in self.added):
            return self._gathered(buf, offsets, end)
        whole = np.zeros(len(offsets) - 1, bool)
        whole[np.searchsorted(offsets, [m.start() for m in self.spelled.finditer(raw)], "right") - 1] = True
        return self._mixed(buf, offsets, end, whole)

    def _mixed(self, buf: np.ndarray, offsets: np.ndarray, end: list[int], whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The marked texts by the library, those between them by the table."""
        cuts = np.concatenate([[0], np.flatnonzero(whole[1:] != whole[:-1]) + 1, [len(whole)]])
        ids, bounds, base = [], [np.zeros(1, np.int64)], 0
        for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            got, b = (self._whole if whole[i] else self._gathered)(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], end)
            ids.append(got)
            bounds.append(b[1:] + base)
            base += len(got)
        return np.concatenate(ids), np.concatenate(bounds)

    def _whole(self, buf: np.ndarray, offsets: np.ndarray, end: list[int]) -> tuple[np.ndarray, np.ndarray]:
        raw = buf.tobytes()
        got = [x.ids + end for x in self.tokenizer.encode_batch_fast([raw[a:b].decode() for a, b in zip(offsets[:-1], offsets[1:], strict=True)], add_special_tokens=False)]
        return np.array([y for x in got for y in x], self.dtype), np.concatenate([[0], np.cumsum([len(x) for x in got])])

    def _gathered(self, buf: np.ndarray, offsets: np.ndarray, end: list[int]) -> tuple[np.ndarray, np.ndarray]:
        n = len(offsets) - 1
        if not len(buf):
            return np.array(end * n, self.dtype), np.arange(n + 1) * len(end)
        start = pretokens(buf, offsets)
        stop = np.append(start[1:], len(buf))
        sizes = stop - start
        distinct, first, which = np.unique(string_hash(buf, start, sizes), return_index=True, return_inverse=True)
        odd = differ(buf, start, sizes, first[which])
        place = np.searchsorted(self.known, distinct).clip(max=max(0, len(self.known) - 1))
        new = np.flatnonzero(self.known[place] != distinct) if len(self.known) else np.arange(len(distinct))
        if len(self.known) + len(new) > KEPT:
            self._forget()
            new = np.arange(len(distinct))
        if len(new):
            raw = buf.tobytes()
            self._learn(distinct[new], [raw[a:b].decode() for a, b in zip(start[first[new]].tolist(), stop[first[new]].tolist(), strict=True)])
            place = np.searchsorted(self.known, distinct)
        odd |= self._unlike(buf, start[first], sizes[first], place)[which]
        if odd.any():
            whole = np.zeros(n, bool)
            whole[np.searchsorted(offsets, start[odd], "right") - 1] = True
            return self._mixed(buf, offsets, end, whole)
        size = self.size[place][which]
        head = np.searchsorted(start, offsets)
        gone = np.concatenate([[0], np.cumsum(size)])
        bounds = gone[head]
        total = int(gone[-1])
        ids = self.flat[np.repeat(self.at[place][which] - gone[:-1], size) + np.arange(total)]
        if end:
            ids = np.insert(ids, np.repeat(bounds[1:], len(end)), np.tile(np.array(end, self.dtype), n))
            bounds = bounds + np.arange(n + 1) * len(end)
        return ids, bounds

    def _unlike(self, buf: np.ndarray, start: np.ndarray, sizes: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Which pre-tokens are not those that the table holds at these places."""
        out = sizes != self.spelt_size[place]
        some = np.flatnonzero(~out)
        ends = np.cumsum(sizes[some])
        no = gathered(buf, start[some], sizes[some]) != gathered(self.spelt, self.spelt_at[place[some]], sizes[some])
        out[some[np.unique(np.searchsorted(ends, np.flatnonzero(no), "right"))]] = True
        return out

    def encode(self, buf: np.ndarray, offsets: np.ndarray, end: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each followed by the end ids, and the n + 1 offsets of the texts in them."""
        ids, bounds, base = [], [np.zeros(1, np.int64)], 0
        for i, j in slices(offsets):
            got, b = self._some(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], end)
            ids.append(got)
            bounds.append(b[1:] + base)
            base += len(got)
        return np.concatenate(ids) if ids else np.zeros(0, self.dtype), np.concatenate(bounds)


def encoder(path: str, special: bool = False) -> Encoder:
    """The worker's encoder for a file."""
    if (path, special) not in _encoders:
        _encoders[path, special] = Encoder(path, special)
    return _encoders[path, special]


