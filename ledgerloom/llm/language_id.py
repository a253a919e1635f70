"""Language ID: sparse multinomial logistic regression on TF-IDF of character n-grams.

Features are the character n-grams (1 to 3) of the whole text in lower case, hashed to a fixed number of columns, with
sub-linear counts, inverse document frequencies over all documents to learn from, and unit length. The weights are
trained by follow-the-regularised-leader with elastic-net penalties, so most of them stay exactly zero, on a bounded
sample of labelled rows (TRAIN_ROWS, documented and a parameter: of each label the distinct rows with the smallest hash
of id and text, as many of one label as of another while it has more). A
temperature calibrates the scores: it minimises the log-loss on texts that were not trained on (one in CALIBRATE of the
sample), whole and in fragments of several lengths, and on fragments of two labels mixed, either of which is half right.
The log-loss and the calibration error on these, before and after, stay with the model.

The model also holds the trigrams of its languages: those that enough sample texts of any one label have. A text of at
least LONG letters, of whose trigrams more than FOREIGN are none of these, is in no learned language (in_language()).
Shorter texts show too few trigrams to tell, and texts in several learned languages have their trigrams from all of them.

Cases: null text, or text without a letter, is und with score 0; equal texts get equal predictions; rows with a null
label are not learned from but predicted; without anything to learn from all is und; repeated rows are predicted each;
an empty table gives no rows. Only text enters a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm._columns import named
from ledgerloom.llm._common import U64, flat_text, slices, small_batches, tidy, written

TRAIN_ROWS = 3000
#: Rows of the sample that calibrate instead of train: one in so many, by their hash.
CALIBRATE = 5
#: Characters of the fragments of a text that calibrates (0: all of it).
FRAGMENTS = (0, 400, 100, 40, 15, 6)
#: Bytes of text whose n-grams are laid out at a time.
SLICE = 256 << 10
COLUMNS = 1 << 14
GRAMS = (1, 2, 3)
#: Trigrams are told apart by this many values when their languages are asked for.
TRIGRAMS = 1 << 20
#: A trigram is of a language if one in so many of its sample texts has it, and at least one.
RARE = 500
#: Letters from which on a text can be foreign, and the share of trigrams of no learned language beyond which it is.
LONG, FOREIGN = 200, 0.5
UNKNOWN = "und"
_KEYS = [U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F), U64(0x165667B19E3779F9)]


@dataclass
class Model:
    labels: list[str]
    idf: np.ndarray
    weights: np.ndarray  # columns x labels
    bias: np.ndarray
    temperature: float = 1.0
    columns: int = field(default=COLUMNS)
    trigrams: np.ndarray | None = None  # of the learned languages, a bit each
    calibration: dict[str, float] = field(default_factory=dict)  # loss_before, loss_after, error_before, error_after


def held_out(id_col: str) -> Column:
    """Rows that are never learned from: crc32 of the id as text leaves 2 modulo 4. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def gram_hashes(cp: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """For each n the hash of the n-gram that starts at each code point."""
    h, out = np.zeros(len(cp), U64), []
    for n in GRAMS:
        h = (h[: max(0, len(cp) - n + 1)] ^ cp[n - 1 :].astype(U64)) * _KEYS[n % 3]
        h ^= h >> U64(29)
        out.append((n, h))
    return out


def gram_columns(cp: np.ndarray, columns: int) -> list[tuple[int, np.ndarray]]:
    return [(n, (h % U64(columns)).astype(np.int32)) for n, h in gram_hashes(cp)]


_pages, _lower, _letter = np.zeros(0x1100, bool), np.arange(0x110000, dtype=np.uint32), np.zeros(0x110000, bool)


def _known(cp: np.ndarray) -> None:
    """Fills the tables of lower case and letters for the pages of these code points. A code point at a time: lower case of a whole text could change lengths."""
    for page in np.flatnonzero((np.bincount(cp >> 8, minlength=len(_pages)) > 0) & ~_pages).tolist():
        for i in range(page << 8, (page + 1) << 8):
            c = chr(i)
            _letter[i] = c.isalpha()
            _lower[i] = ord(c.lower()) if len(c.lower()) == 1 else i
        _pages[page] = True


def features(text: pa.Array, columns: int = COLUMNS) -> Iterator[tuple[np.ndarray, np.ndarray, int, np.ndarray]]:
    """Of each text the columns it has, their counts, its number of letters, and its trigrams that hold a letter."""
    buf, off = flat_text(text)
    for i, j in slices(off, SLICE):
        raw = buf[off[i] : off[j]]
        lead = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[off[i : j + 1] - off[i]]
        cp = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        _known(cp)
        letter, low = _letter[cp], _lower[cp]
        letters = np.concatenate([[0], np.cumsum(letter)])[lead]
        hashes = gram_hashes(low)
        wide = (hashes[-1][1] % U64(TRIGRAMS)).astype(np.int32)
        grams = [(n, (h % U64(columns)).astype(np.int32)) for n, h in hashes]
        del hashes
        lettered = letter[:-2] | letter[1:-1] | letter[2:]
        for d in range(j - i):
            a, b = int(lead[d]), int(lead[d + 1])
            own = np.concatenate([c[a : max(a, b - n + 1)] for n, c in grams])
            if len(own) < columns // 4:
                has, counts = np.unique(own, return_counts=True)
            else:
                counts = np.bincount(own, minlength=columns)
                has = np.flatnonzero(counts)
                counts = counts[has]
            last = max(a, b - 2)
            yield has, counts, int(letters[d + 1] - letters[d]), wide[a:last][lettered[a:last]]


def tf_idf(has: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(counts)) * idf[has]
    return x / max(float(np.sqrt((x * x).sum())), 1e-12)


def leader(z: np.ndarray, n: np.ndarray, alpha: float, beta: float, l1: float, l2: float) -> np.ndarray:
    """Weights that follow the regularised leader, from the sums of gradients (z) and of their squares (n)."""
    return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))


def train(rows: list[tuple[np.ndarray, np.ndarray, str, bool]], idf: np.ndarray, *, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1, epochs: int = 3) -> Model:
    """Follow-the-regularised-leader, each column and label with its own rate. rows: columns, counts, label, and whether to spare the row for calibration; if a label has no other rows, none is spared."""
    labels = sorted({r[2] for r in rows})
    at = {x: i for i, x in enumerate(labels)}
    spare = {r[2] for r in rows if not r[3]} == set(labels)
    own = [(has, tf_idf(has, counts, idf), at[label]) for has, counts, label, held in rows if not (spare and held)]
    z, n = np.zeros((len(idf) + 1, len(labels))), np.zeros((len(idf) + 1, len(labels)))
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(own)).tolist():
            has, x, y = own[i]
            has, x = np.append(has, len(idf)), np.append(x, 0.1)  # the last column is the bias
            zs, ns = z[has], n[has]
            w = leader(zs, ns, alpha, beta, l1, l2)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1
            g = x[:, None] * p[None, :]
            sigma = (np.sqrt(ns + g * g) - np.sqrt(ns)) / alpha
            z[has], n[has] = zs + g - sigma * w, ns + g * g
    w = leader(z, n, alpha, beta, l1, l2)
    return Model(labels, idf, w[:-1], w[-1] * 0.1)


def probabilities(scores: np.ndarray, temperature: float) -> np.ndarray:
    s = scores / temperature
    p = np.exp(s - s.max(-1, keepdims=True))
    return p / p.sum(-1, keepdims=True)


def log_loss(scores: np.ndarray, truth: np.ndarray, temperature: float) -> float:
    """truth: the share of each label, a row a text."""
    return float(-(truth * np.log(np.maximum(probabilities(scores, temperature), 1e-300))).sum(1).mean())


def calibration_error(scores: np.ndarray, truth: np.ndarray, temperature: float, bins: int = 10) -> float:
    """Mean distance of score and accuracy over bins of the score, weighted by their texts."""
    p = probabilities(scores, temperature)
    top = p.argmax(1)
    score, right = p.max(1), truth[np.arange(len(p)), top]
    bin_ = np.minimum((score * bins).astype(int), bins - 1)
    n = np.bincount(bin_, minlength=bins)
    return float(np.abs(np.bincount(bin_, score, bins) - np.bincount(bin_, right, bins)).sum() / max(1, n.sum()))


def calibrate(model: Model, rows: list[tuple[np.ndarray, np.ndarray, str]]) -> None:
    """Sets the temperature. rows: as for train(), of texts and fragments that were not trained on."""
    at = {x: i for i, x in enumerate(model.labels)}
    rows = [r for r in rows if r[2] in at and len(r[0])]
    if not rows:
        return
    vectors = [(has, counts, np.eye(len(at))[at[label]]) for has, counts, label in rows]
    # every row with the next one of another label, as one text
    for (has, counts, own), (more, others, other) in zip(vectors[:-1], vectors[1:], strict=True):
        if (own != other).any():
            both = np.zeros(len(model.idf))
            np.add.at(both, has, counts / counts.sum())
            np.add.at(both, more, others / others.sum())
            used = np.flatnonzero(both)
            vectors.append((used, np.maximum(1, both[used] * min(counts.sum(), others.sum())), (own + other) / 2))
    scores = np.array([tf_idf(has, counts, model.idf) @ model.weights[has] + model.bias for has, counts, _ in vectors])
    truth = np.array([t for *_, t in vectors])
    model.temperature = float(min(np.geomspace(0.005, 20, 160), key=lambda t: log_loss(scores, truth, t)))
    model.calibration = {f"{name}_{when}": f(scores, truth, t) for when, t in (("before", 1.0), ("after", model.temperature)) for name, f in (("loss", log_loss), ("error", calibration_error))}


def language_trigrams(rows: list[tuple[str, np.ndarray]]) -> np.ndarray:
    """The trigrams that enough texts of a label have, a bit each. rows: label and distinct trigrams of each text."""
    known = np.zeros(TRIGRAMS, bool)
    for label in {r[0] for r in rows}:
        own = [x for y, x in rows if y == label]
        seen = np.zeros(TRIGRAMS, np.int32)
        for x in own:
            seen[x] += 1
        known |= seen >= max(1, len(own) / RARE)
    return np.packbits(known, bitorder="little")


def in_language(model: Model | None, letters: int, trigrams: np.ndarray) -> bool:
    """Whether a text may be in a learned language: not without a letter, nor if it is long and most of its trigrams are foreign. Without a model any letter will do."""
    if not letters or model is None or model.trigrams is None or letters < LONG or not len(trigrams):
        return letters > 0
    known = model.trigrams[trigrams >> 3] >> (trigrams & 7).astype(np.uint8) & 1
    return bool((known == 0).mean() <= FOREIGN)


def document_frequencies(docs: DataFrame, columns: int = COLUMNS) -> tuple[np.ndarray, int]:
    """In how many of all documents each column occurs, and their number. What reaches the driver is bounded by the columns."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(columns, np.int64), 0
        for b in batches:
            for has, *_ in features(b.column(0), columns):
                seen[has] += 1
                n += 1
            tidy()
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_pydict({"c": pa.array(np.append(at, -1)), "n": pa.array(np.append(seen[at], n))})

    out, total = np.zeros(columns), 0
    for r in docs.select("text").mapInArrow(count, "c long, n long").groupBy("c").agg(F.sum("n").alias("n")).toLocalIterator():
        if r["c"] < 0:
            total = r["n"]
        else:
            out[r["c"]] = r["n"]
    return out, total


def sample_keys(rows: DataFrame, most: int) -> DataFrame:
    """At most so many distinct (label, h): the first of every label by h, then the second of every label, and so on.

    Only about twice as many of a label as can be taken are ranked, so a label that most rows have is no single task.
    """
    sizes = rows.groupBy("label").agg(F.approx_count_distinct("h").alias("n"))
    place = (F.col("h").cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    low = rows.join(F.broadcast(sizes), "label").where(place * F.col("n") <= F.lit(2.0 * most + 100)).select("label", "h").distinct()
    ranked = low.withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy("h"))).where(F.col("rank") <= most)
    return ranked.orderBy("rank", F.xxhash64("label"), "label").limit(most).select("label", "h")


def fit(docs: DataFrame, learn: Column, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", train_rows: int = TRAIN_ROWS) -> Model | None:
    """A model from the rows of learn with text and label; None if there are none."""
    small_batches(docs.sparkSession)
    labelled = docs.where(learn & F.col(label_col).isNotNull() & F.col(text_col).isNotNull())
    seen, total = document_frequencies(labelled.select(F.col(text_col).alias("text")))
    if not total:
        return None
    idf = np.log((1 + total) / (1 + seen)) + 1
    own = labelled.select(F.xxhash64(F.col(id_col), F.col(text_col)).alias("h"), F.col(text_col).alias("text"), F.col(label_col).cast("string").alias("label"))
    chosen = written(sample_keys(own.select("label", "h"), train_rows), "sample")
    # keys first, so that only the sample's texts are sent; rows that are equal in id, text and label are one
    sample = own.join(F.broadcast(chosen), ["label", "h"], "left_semi").groupBy("label", "h").agg(F.first("text").alias("text")).select("h", "text", "label")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, text, label = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()
            parts = []  # row, fragment; of texts that calibrate all fragments, each from another place
            for i, t in enumerate(text):
                for size in FRAGMENTS if h[i] % CALIBRATE == 0 else (0,):
                    if not size or size < len(t):
                        start = (h[i] >> 7) % (len(t) - size + 1) if size else 0
                        parts.append((i, t[start : start + size] if size else t, size))
            got = list(features(pa.array([x for _, x, _ in parts], pa.string())))
            kept = [(h[i], label[i], size, g) for (i, _, size), g in zip(parts, got, strict=True)]
            yield pa.RecordBatch.from_pydict({
                "h": pa.array([x[0] for x in kept], pa.int64()), "label": pa.array([x[1] for x in kept], pa.string()), "size": pa.array([x[2] for x in kept], pa.int32()),
                "has": pa.array([x[3][0].astype(np.uint16).tobytes() for x in kept], pa.binary()), "counts": pa.array([np.minimum(x[3][1], 65535).astype(np.uint16).tobytes() for x in kept], pa.binary()),
                "trigrams": pa.array([b"" if x[2] else np.unique(x[3][3]).tobytes() for x in kept], pa.binary()),
            })

    rows = sample.mapInArrow(extract, "h long, label string, size int, has binary, counts binary, trigrams binary").toArrow().sort_by([("h", "ascending"), ("label", "ascending"), ("size", "ascending")])
    labels, sizes = rows["label"].to_pylist(), rows["size"].to_pylist()
    hold = [h % CALIBRATE == 0 for h in rows["h"].to_pylist()]
    parsed = [(np.frombuffer(a.as_buffer(), np.uint16).astype(np.int32), np.frombuffer(c.as_buffer(), np.uint16).astype(np.int32), y) for a, c, y in zip(rows["has"], rows["counts"], labels, strict=True)]
    whole = [i for i, size in enumerate(sizes) if not size and len(parsed[i][0])]
    if not whole:
        return None
    model = train([(*parsed[i], hold[i]) for i in whole], idf)
    calibrate(model, [x for x, held in zip(parsed, hold, strict=True) if held])
    trigrams = rows["trigrams"]
    model.trigrams = language_trigrams([(labels[i], np.frombuffer(trigrams[i].as_buffer(), np.int32)) for i, size in enumerate(sizes) if not size])
    return model


def _judge(model: Model | None, text: pa.Array) -> tuple[list[str], list[float], list[bool]]:
    labels, scores, stays = [], [], []
    for has, counts, letters, trigrams in features(text):
        stays.append(in_language(model, letters, trigrams))
        if model is None or not letters:
            labels.append(UNKNOWN)
            scores.append(0.0)
            continue
        p = probabilities(tf_idf(has, counts, model.idf) @ model.weights[has] + model.bias, model.temperature)
        k = int(p.argmax())
        labels.append(model.labels[k])
        scores.append(float(p[k]))
    return labels, scores, stays


def judged(text: Column, model: Model | None) -> Column:
    """label, score and stays (in_language()) of each whole text, as a struct. Only the text goes to the Python workers."""

    def run(texts: pa.Array) -> pa.Array:
        labels, scores, stays = _judge(model, texts)
        tidy()
        return pa.StructArray.from_arrays([pa.array(labels, pa.string()), pa.array(scores, pa.float64()), pa.array(stays, pa.bool_())], names=["label", "score", "stays"])

    return F.arrow_udf(run, "label string, score double, stays boolean")(text)


def predict(docs: DataFrame, model: Model | None, *, text_col: str = "text", label_out: str = "lang_pred", score_out: str = "score", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in keep, the label and the score of every whole text."""
    small_batches(docs.sparkSession)
    own = docs.select(judged(F.col(text_col), model).alias("j"), *[named(c).alias(f"k{i}") for i, c in enumerate(keep)])
    return own.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], F.col("j.label").alias(label_out), F.col("j.score").alias(score_out))


def in_learned_languages(docs: DataFrame, model: Model | None, *, text_col: str = "text", label_col: str | None = None, sure: float = 0.9) -> DataFrame:
    """The rows that in_language() keeps, with all their columns. label_col: where it is null, and the score is at least sure, it gets the label."""
    small_batches(docs.sparkSession)
    own = docs.select(judged(F.col(text_col), model).alias("j"), F.struct(*map(named, docs.columns)).alias("d")).where("j.stays")
    label = lambda c: F.coalesce(F.col("d").getField(c), F.when((F.col("j.score") >= sure) & (F.col("j.label") != UNKNOWN), F.col("j.label")))
    return own.select(*[(label(c) if c == label_col else F.col("d").getField(c)).alias(c) for c in docs.columns])
