"""Near forms of terms: the window of a text that shares most of a form's character 3-grams.

Windows are from half to twice a form's length, in steps of three characters; those of one size begin a third of it apart.
No window is listed. A shared 3-gram at a place, up to where the same one comes before, counts for an interval of the
windows of each size; the ends of these intervals are events, and their running sum is how many different 3-grams the
windows between two events hold. Only places go there that have, within twice the form's length, as many different shared
3-grams as a window that is near must hold; and only where the rarest 3-grams of a form come together, the others are looked
at: a window that may lack m of them holds k of the rarest m + k. Texts are dealt over shards and forms over parts by their bytes; each shard meets each
part in one task, and neither is sent through the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from ledgerloom.functions import text as T

#: Characters from which a form is looked for, shares that are near and that are taken at once.
LONG, LEAST, SURE = 4, 0.6, 0.85
#: Bytes of texts in a shard and of forms in a part, letters of texts and pairs of a place and a form that are held as arrays at once, tasks at most.
SHARD_BYTES, FORM_BYTES, LETTERS, PAIRS, TASKS = 1 << 20, 256 << 10, 1 << 18, 1 << 19, 10_000
#: How many of a form's rarest 3-grams must come together before all are looked at, cells of a table of forms and 3-grams. They decide nothing.
RARE, CELLS = 5, 1 << 22


def forms_of(terms: DataFrame) -> DataFrame:
    """term_id, form: preferred forms without their bracketed parts; blank ones are none. Rows that share an id count once, by the smallest form."""
    base = F.trim(F.regexp_replace("preferred_form", r"\s*[\(（][^\)）]*[\)）]", ""))
    return terms.select("term_id", base.alias("form")).where("form <> ''").groupBy("term_id").agg(F.min("form").alias("form"))


def _hits(bodies: list[str], vocabulary: np.ndarray, gap: int) -> tuple[np.ndarray, ...]:
    """text, place, 3-gram, place of the same one before (else -1), place on one line on which texts lie gap apart: of each place that holds a 3-gram of the vocabulary."""
    codes = [np.frombuffer(b.encode("utf-32-le"), np.uint32).astype(np.int64) for b in bodies]
    text = np.repeat(np.arange(len(codes)), [len(c) - 2 for c in codes])
    place = np.concatenate([np.arange(len(c) - 2) for c in codes])
    keys = np.concatenate([(c[:-2] << 42) | (c[1:-1] << 21) | c[2:] for c in codes])
    gram = np.searchsorted(vocabulary, keys)
    met = vocabulary[np.minimum(gram, len(vocabulary) - 1)] == keys
    text, place, gram = text[met], place[met], gram[met]
    same = text * len(vocabulary) + gram
    order = np.argsort(same, kind="stable")
    before = np.full(len(same), -1)
    again = np.flatnonzero(same[order][1:] == same[order][:-1])
    before[order[again + 1]] = place[order[again]]
    begins = np.cumsum([0] + [len(c) + gap for c in codes])
    return text, place, gram, before, begins[text] + place


def _distinct(numbers: np.ndarray) -> np.ndarray:
    """Numbers sorted, each once. np.unique() hashes them first, which takes several times as long."""
    numbers = np.sort(numbers)
    return numbers[np.append(True, numbers[1:] != numbers[:-1])[: len(numbers)]]


def _rare(gram: np.ndarray, form: np.ndarray, of_gram: np.ndarray, n: np.ndarray, need: np.ndarray) -> np.ndarray:
    """Of each form the 3-grams that come least often, so many that a window with the form's need holds RARE of them (or all that it needs). form, of_gram: each form's 3-grams, by form."""
    seen = np.bincount(gram, minlength=of_gram.max() + 1)
    order = np.lexsort((seen[of_gram], form))
    rank = np.arange(len(form)) - (np.cumsum(n) - n)[form[order]]
    return order[rank < (n - need + np.minimum(need, RARE))[form[order]]]


def _joined(owner: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
    """Stretches of one owner that touch as one. owner, low: sorted; high rises with low."""
    begin = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (low[1:] > high[:-1]))[: len(owner)])
    return owner[begin], low[begin], high[np.append(begin[1:], len(owner))[: len(begin)] - 1]


def _met(line: np.ndarray, gram: np.ndarray, form: np.ndarray, of_gram: np.ndarray, least: int, long: np.ndarray) -> tuple[np.ndarray, ...]:
    """form, low, high: stretches of the line, each with all windows up to twice the form's length that begin with some hits of it, the least that there must be. form, of_gram: 3-grams that are asked for. Only so many pairs are laid out at once."""
    order = np.argsort(of_gram, kind="stable")
    own, of = np.unique(form[order], return_inverse=True)
    first, reach = np.searchsorted(of_gram[order], np.arange(gram.max() + 2)), 2 * long[own] - 3
    count = first[gram + 1] - first[gram]
    upto, out, a = np.concatenate([[0], np.cumsum(count)]), [], 0
    while a < len(gram):
        b = max(a + 1, int(np.searchsorted(upto, upto[a] + PAIRS, "right")) - 1)
        e = int(np.searchsorted(line, line[b - 1] + reach.max(), "right"))  # what windows from before b reach
        lane = int(line[e - 1] - line[a] + reach.max() + 1)
        kind = np.int32 if lane * len(own) < 1 << 31 else np.int64
        each = count[a:e]
        entry = np.arange(upto[e] - upto[a]) + np.repeat(first[gram[a:e]] - (upto[a:e] - upto[a]), each)
        pairs = np.sort((of * lane).astype(kind)[entry] + np.repeat((line[a:e] - line[a]).astype(kind), each))
        begin = np.flatnonzero(pairs[least - 1 :] - pairs[: max(0, len(pairs) - least + 1)] <= reach.max())
        at, last = pairs[begin].astype(np.int64), pairs[begin + least - 1].astype(np.int64)
        owner = at // lane
        told = last - at <= reach[owner]
        owner, at, last = owner[told], at[told], last[told]
        shift = line[a] - owner * lane
        out.append(_joined(own[owner], last + shift - reach[owner], at + shift + reach[owner]))
        a = b
    return tuple(np.concatenate([o[i] for o in out]) for i in range(3))


def _stretches(line: np.ndarray, gram: np.ndarray, form: np.ndarray, of_gram: np.ndarray, n: np.ndarray, need: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, ...]:
    """form, low, high: hits low to high - 1 of the text may hold windows near to the form, as the rarest 3-grams of the form come together there; no others do. Sorted, apart."""
    keep = _rare(gram, form, of_gram, n, need)
    least = np.minimum(need, RARE)
    kind = (least * 64 + np.floor(np.log2(long)).astype(np.int64))[form[keep]]  # forms of about one length are met together
    found = [_met(line, gram, form[keep[kind == k]], of_gram[keep[kind == k]], int(k) // 64, long) for k in np.unique(kind)]
    owner, low, high = (np.concatenate([f[i] for f in found]) for i in range(3))
    order = np.lexsort((low, owner))
    owner, low, high = _joined(owner[order], low[order], high[order])
    return owner, np.searchsorted(line, low), np.searchsorted(line, high, "right")


def _dense(owner: np.ndarray, at: np.ndarray, bit: np.ndarray, need: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """Which hits lie within reach of so many different ones of their owner as are needed. owner, at: sorted; bit: of the hit's 3-gram, 0 if its owner has too many for that (then equal ones count, too); need, reach: by hit."""
    n = len(owner)
    last = np.arange(n) + need - 1
    inside = np.minimum(last, n - 1)
    begin = np.flatnonzero((at[inside] - at <= reach) & (owner[inside] == owner) & (last < n))
    if not len(begin):
        return np.zeros(n, bool)
    lane = owner * (at.max() + reach.max() + 1) + at
    ends = np.searchsorted(lane, lane[begin] + reach[begin], "right")
    # the union of bits from begin to end: of two stretches of 2^k hits that overlap
    level = np.floor(np.log2(ends - begin)).astype(np.int64)
    union, unions = bit, np.zeros(len(begin), np.uint64)
    for k in range(int(level.max()) + 1):
        if k:
            union = np.append(union[: -(1 << k - 1)] | union[1 << k - 1 :], union[len(union) - (1 << k - 1) :])
        own = np.flatnonzero(level == k)
        unions[own] = union[begin[own]] | union[ends[own] - (1 << k)]
    told = (np.bitwise_count(unions) >= need[begin]) | (bit[begin] == 0)
    marks = np.bincount(begin[told], minlength=n + 1) - np.bincount(ends[told], minlength=n + 1)
    return np.cumsum(marks)[:-1] > 0


def _crowded(line: np.ndarray, gram: np.ndarray, form: np.ndarray, of_gram: np.ndarray, n: np.ndarray, need: np.ndarray, long: np.ndarray) -> np.ndarray:
    """form * hits + hit, sorted: hits of a form that lie, within twice its length, with as many different ones as a window that is near must hold."""
    owner, low, high = _stretches(line, gram, form, of_gram, n, need, long)
    width, rows = int(of_gram.max()) + 1, max(1, CELLS // (int(of_gram.max()) + 1))
    rank, starts = np.arange(len(form)) - (np.cumsum(n) - n)[form], np.searchsorted(form, np.arange(len(n) + 1))
    upto, out, a = np.concatenate([[0], np.cumsum(high - low)]), [np.zeros(0, np.int64)], 0
    bits = np.concatenate([[0], np.left_shift(np.uint64(1), np.arange(64, dtype=np.uint64)), [0]]).astype(np.uint64)
    while a < len(owner):
        b = max(a + 1, int(np.searchsorted(upto, upto[a] + PAIRS, "right")) - 1)
        b = min(b, int(np.searchsorted(owner, owner[a] + rows)))
        # the place (from 1) of each 3-gram in each of some forms; 65 in forms with more than 64
        held = slice(starts[owner[a]], starts[owner[b - 1] + 1])
        table = np.zeros((owner[b - 1] - owner[a] + 1) * width, np.uint8)
        table[(form[held] - owner[a]) * width + of_gram[held]] = np.where(n[form[held]] > 64, 65, rank[held] + 1)
        each = (high - low)[a:b]
        hit = np.arange(upto[b] - upto[a]) + np.repeat(low[a:b] - (upto[a:b] - upto[a]), each)
        place = table[np.repeat((owner[a:b] - owner[a]) * width, each) + gram[hit]]
        met = np.flatnonzero(place)
        of, hit, bit = np.repeat(np.arange(a, b), each)[met], hit[met], bits[place[met]]
        told = _dense(of, line[hit], bit, need[owner[of]], 2 * long[owner[of]] - 3)
        out.append(owner[of[told]] * len(gram) + hit[told])
        a = b
    return np.concatenate(out)  # stretches are sorted and apart


def _windows(pair: np.ndarray, place: np.ndarray, before: np.ndarray, n: np.ndarray, long: np.ndarray, of: np.ndarray, least: float, sure: float) -> tuple[np.ndarray, ...]:
    """size, start, share of each pair's window (share 0: none); n, long, of: by pair. Sizes come one after the other, without the pairs that are sure."""
    size, start, share = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64), np.zeros(len(n))
    sizes = np.maximum(3, long // 2)
    while len(pair):
        keep = (share[pair] <= sure) & (sizes[pair] <= np.minimum(n, 2 * long)[pair])
        pair, place, before = pair[keep], place[keep], before[keep]
        step = (sizes // 3)[pair]
        # windows s * step (s from 0) that hold this place and not the one before
        low = -(-np.maximum(np.maximum(before + 1, place + 3 - sizes[pair]), 0) // step)
        high = np.minimum(place // step, (n - sizes)[pair] // step)
        held = low <= high
        wide = int(n.max()) + 2
        events = np.concatenate([pair[held] * wide + low[held], pair[held] * wide + high[held] + 1])
        order = np.argsort(events, kind="stable")
        run = np.cumsum(np.repeat([1, -1], held.sum())[order])
        events = events[order]
        tells = np.append(events[1:] != events[:-1], True)[: len(events)]
        owner, s, part = events[tells] // wide, events[tells] % wide, run[tells] / of[events[tells] // wide]
        near = part >= least
        owner, s, part = owner[near], s[near], part[near]
        # a pair's best window of this size: the first above sure, else the first of the largest share
        best = np.lexsort((s, np.where(part > sure, 0, -part), part <= sure, owner))
        best = best[np.append(True, owner[best][1:] != owner[best][:-1])[: len(best)]]
        best = best[part[best] > share[owner[best]]]
        size[owner[best]], start[owner[best]], share[owner[best]] = sizes[owner[best]], s[best] * (sizes // 3)[owner[best]], part[best]
        sizes = sizes + 3
    return size, start, share


def _search(texts: pa.Table, forms: pa.Table, least: float, sure: float) -> pa.Table:
    """The windows of some texts near to some forms."""
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), [], np.zeros(0))]
    if forms.num_rows:
        long = np.array([len(f) for f in forms["form"].to_pylist()])
        codes = np.frombuffer("".join(forms["form"].to_pylist()).encode("utf-32-le"), np.uint32).astype(np.int64)
        owner = np.repeat(np.arange(len(long)), long)
        inside = owner[:-2] == owner[2:]
        keys = ((codes[:-2] << 42) | (codes[1:-1] << 21) | codes[2:])[inside]
        vocabulary = _distinct(keys)
        held = _distinct(owner[:-2][inside] * len(vocabulary) + np.searchsorted(vocabulary, keys))
        of_form, of_gram = held // len(vocabulary), held % len(vocabulary)
        of = np.bincount(of_form, minlength=len(long))
        need = np.ceil(of * least).astype(np.int64)
        need += (need / of < least).astype(np.int64) - ((need - 1) / of >= least)
        need = np.maximum(need, 1)
        bodies = texts["body"].to_pylist()
        a = 0
        while a < len(bodies):
            b, letters = a, 0
            while b < len(bodies) and (b == a or letters + len(bodies[b]) <= LETTERS):
                letters, b = letters + len(bodies[b]), b + 1
            text, place, gram, before, line = _hits(bodies[a:b], vocabulary, 2 * int(long.max()))
            met = _crowded(line, gram, of_form, of_gram, of, need, long) if len(gram) else np.zeros(0, np.int64)
            if len(met):
                form, hit = met // len(gram), met % len(gram)
                pairs, pair = np.unique(form * (b - a) + text[hit], return_inverse=True)
                form, text = pairs // (b - a), pairs % (b - a)
                n = np.array([len(t) for t in bodies[a:b]])[text]
                size, start, share = _windows(pair, place[hit], before[hit], n, long[form], of[form], least, sure)
                told = np.flatnonzero(share > 0)
                out.append((text[told] + a, form[told], [bodies[text[i] + a][start[i] : start[i] + size[i]] for i in told], share[told]))
            a = b
    text, form, share = (np.concatenate([o[i] for o in out]) for i in (0, 1, 3))
    near = pa.array([w for o in out for w in o[2]], pa.string())
    return pa.table({"doc_id": texts["doc_id"].take(text), "term_id": forms["term_id"].take(form), "near": near, "share": share})


def near_terms(docs: DataFrame, terms: DataFrame, least: float = LEAST, sure: float = SURE) -> DataFrame:
    """doc_id, term_id, near, share: of each text and form of at least LONG characters the window that shares at least so many of the form's 3-grams. Of windows by size, then place, the first one above sure is taken, else the first of those that share most. docs: doc_id (once each), text; terms: term_id, preferred_form."""
    spark = docs.sparkSession
    forms = forms_of(terms).where(F.length("form") >= LONG)
    bodies = docs.select("doc_id", T.body_clean(F.col("text")).alias("body")).where(F.length("body") >= 3)
    total = lambda rows, column: rows.agg(F.sum(F.octet_length(column))).first()[0] or 0
    parts = max(1, -(-total(forms, "form") // FORM_BYTES))
    shards = max(spark.sparkContext.defaultParallelism, -(-total(docs, "text") // SHARD_BYTES))
    # each shard of texts meets each part of the forms in a group of its own
    dealt = lambda rows, key, n, others, name: rows.withColumn(name, F.pmod(F.xxhash64(key), F.lit(n))).withColumn("beside", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(others - 1).cast("long"))))
    texts = dealt(bodies, "doc_id", shards, parts, "shard").select((F.col("shard") * parts + F.col("beside")).alias("group"), "doc_id", "body")
    sought = dealt(forms, "term_id", parts, shards, "part").select((F.col("beside") * parts + F.col("part")).alias("group"), "term_id", "form")
    tasks = min(4 * shards * parts, TASKS)  # more than groups, so that few groups share a task
    schema = StructType([docs.schema["doc_id"], terms.schema["term_id"], StructField("near", StringType()), StructField("share", DoubleType())])
    both = texts.repartition(tasks, "group").groupBy("group").cogroup(sought.repartition(tasks, "group").groupBy("group"))
    return both.applyInArrow(lambda t, f: _search(t, f, least, sure), schema)


def missing_terms(docs: DataFrame, terms: DataFrame, least: float = LEAST, chunk: int = 200) -> DataFrame:
    """doc_id, term_id, form, near: forms that a text lacks, with the window that comes near (near_terms()), else null.

    The answer has a row for each text and form but those that it holds, so each text is laid beside the whole glossary: so many forms at a time.
    """
    forms = forms_of(terms)
    n = -(-forms.count() // chunk)
    parts = forms.withColumn("part", F.pmod(F.xxhash64("term_id"), F.lit(max(1, n)))).groupBy("part").agg(F.collect_list(F.struct("term_id", "form")).alias("forms"))
    bodies = docs.select("doc_id", T.body_clean(F.col("text")).alias("body"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(1, n) - 1).cast("long"))).alias("part"))
    lacking = bodies.join(parts, "part").select("doc_id", F.inline(F.filter("forms", lambda t: ~F.contains("body", t["form"]))))
    # windows grow with the texts, however few bytes they take in a shuffle: none of them goes through the driver
    near = near_terms(docs, terms, least).select("doc_id", "term_id", "near").hint("merge")
    return lacking.join(near, ["doc_id", "term_id"], "left").select("doc_id", "term_id", "form", "near")
