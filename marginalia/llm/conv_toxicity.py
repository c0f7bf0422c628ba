"""Toxicity: a convolutional text classifier in numpy, with thresholds calibrated by language.

A word is the mean of hashed vectors: its own and those of its 3- to 5-character pieces, so inflected and unseen words get a vector. Filters of one,
two and three words slide over the text; the maximum of each filter over the whole text, past a ReLU, goes to a logistic
output. All is trained together by back-propagation: AdaGrad on the rows of the hash table that a step touches, Adam on
the rest, with dropout on the pooled maxima.

A fifth of the sample is kept for calibration. The language of a text is guessed from its words alone (naive Bayes over hashed words,
learned from the sample). For each language the threshold with the least errors on the kept rows, weighted to the classes' real
frequencies, a missed row counting ``MISSED`` times, becomes score 0.7; the other languages' rows count as ``BORROWED`` rows in all, so a
language with few rows takes a threshold near the common one. One slope for all makes scores of distances from the threshold.

Labels are learned only from rows whose crc32(doc_id as text) mod 3 is not 1. Fitting takes a bounded sample, on the driver: of each
class the ``sample`` labelled documents with the smallest hashes of doc_id, among texts of at most ``MOST_BYTES`` bytes (parameters).
Every document is scored, over its whole text. What goes to executors is a model of a fixed size (12 MB).

Nulls and ties: a null or empty text is scored as one without words. A null doc_id is not held out and never labelled. Labels that are
null, and documents labelled both ways as often, are not learned from. With no toxic row to learn from every score is 0,
with no other row 1. Repeated rows are each scored. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BUCKETS, SIZE, WIDTHS, FILTERS, PIECES = 1 << 17, 16, (1, 2, 3), 16, (3, 4, 5)
SAMPLE, MOST_BYTES, EPOCHS, LEAST_STEPS, STEP, DROPOUT = {0: 4000, 1: 2000}, 16_000, 8, 300, 64, 0.3
RATE_ROWS, RATE_DENSE, DECAY, SEED = 0.1, 0.003, 1e-5, 12
LANGUAGE_BUCKETS, MOST_LANGUAGES, LEAST_KEPT, MISSED, BORROWED, AT = 1 << 15, 16, 8, 2.0, 30, 0.7
CHUNK = 1 << 16  # tokens, or different words, that are worked on at once
GAP = max(WIDTHS) - 1  # empty words before each text

MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    x = (x ^ y) * MIX
    return x ^ (x >> np.uint64(29))


@dataclass
class Words:
    """Texts as places in a list of different words. Word 0 is the empty one."""

    token: np.ndarray
    starts: np.ndarray  # of each text in token; one more at the end
    piece: np.ndarray  # buckets of all words' pieces
    pieces: np.ndarray  # where each word's begin; one more at the end
    whole: np.ndarray  # a hash of each word


def words(texts: pa.Array) -> Words:
    """Lower-case runs of letters, marks and digits; runs over 32 characters are cut."""
    plain = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    plain = pc.replace_substring_regex(plain, r"[^\p{L}\p{M}\p{N}]+", " ")
    plain = pc.replace_substring_regex(plain, r"([\p{L}\p{M}\p{N}]{32})", r"\1 ")
    lists = pc.split_pattern(plain, " ")
    coded = pa.concat_arrays([pa.array([""], pa.large_string()), lists.flatten()]).dictionary_encode()
    starts = np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)))
    piece, pieces, whole = pieces_of(coded.dictionary.to_pylist())
    return Words(coded.indices.to_numpy()[1:].astype(np.int32), starts, piece, pieces, whole)


def pieces_of(vocabulary: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the pieces of each word, itself included, in order of words; where each word's begin; its own hash."""
    parts = [_pieces(vocabulary[a : a + CHUNK]) for a in range(0, len(vocabulary), CHUNK)]
    piece, n, whole = (np.concatenate(x) for x in zip(*parts, strict=True))
    return piece, np.append(0, np.cumsum(n)), whole


def _pieces(vocabulary: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As pieces_of, with the number of pieces of each word."""
    chars = np.frombuffer("".join(f"<{w}>" for w in vocabulary).encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
    lengths = np.array([len(w) + 2 for w in vocabulary], np.int64)
    ends = np.cumsum(lengths)
    end_of = np.repeat(ends, lengths)
    word_of = np.repeat(np.arange(len(lengths)), lengths)
    at, found = np.arange(len(chars)), []
    h = np.zeros(len(chars), np.uint64)
    for n in range(1, max(PIECES) + 1):
        fits = max(len(h) - n + 1, 0)
        h[:fits] = mixed(h[:fits], chars[n - 1 :])
        if n in PIECES:
            inside = at + n <= end_of
            found.append((word_of[inside], mixed(h[inside], np.full(int(inside.sum()), n, np.uint64))))
    whole = np.zeros(len(lengths), np.uint64)
    np.add.at(whole, word_of, mixed(chars, (at - (end_of - np.repeat(lengths, lengths))).astype(np.uint64) * MIX))
    real = np.flatnonzero(lengths > 2)
    whole = mixed(whole, np.full(len(whole), 77, np.uint64))
    found.append((real, whole[real]))
    owner = np.concatenate([w for w, _ in found])
    order = np.argsort(owner, kind="stable")
    bucket = (np.concatenate([x for _, x in found])[order] >> np.uint64(20)) % np.uint64(BUCKETS)
    return bucket.astype(np.int32), np.bincount(owner, minlength=len(lengths)), whole


def vectors(table: np.ndarray, piece: np.ndarray, pieces: np.ndarray) -> np.ndarray:
    """The mean of each word's pieces; 0 for the empty word."""
    out = np.zeros((len(pieces) - 1, table.shape[1]), table.dtype)
    n = np.diff(pieces)
    some = np.flatnonzero(n)
    for a in range(0, len(some), CHUNK):
        part = some[a : a + CHUNK]
        begin, end = pieces[part[0]], pieces[part[-1] + 1]
        out[part] = np.add.reduceat(table[piece[begin:end]], pieces[part] - begin) / n[part, None]
    return out


@dataclass
class Model:
    table: np.ndarray = field(default_factory=lambda: np.zeros((BUCKETS, SIZE), np.float32))
    filters: list[np.ndarray] = field(default_factory=list)  # (width, SIZE, FILTERS)
    bias: np.ndarray = field(default_factory=lambda: np.zeros(len(WIDTHS) * FILTERS, np.float32))
    out: np.ndarray = field(default_factory=lambda: np.zeros(len(WIDTHS) * FILTERS, np.float32))
    out_bias: float = 0.0
    constant: float | None = None  # the score of all, where there was nothing to tell apart
    languages: np.ndarray = field(default_factory=lambda: np.zeros((LANGUAGE_BUCKETS, 1), np.float32))  # log probabilities of hashed words
    thresholds: np.ndarray = field(default_factory=lambda: np.zeros(1))
    slope: float = 1.0

    def responses(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """Per text: pooled maxima before the bias, and log probabilities of languages."""
        n = len(w.starts) - 1
        v = vectors(self.table, w.piece, w.pieces)
        parts = [[v @ f[i] for i in range(len(f))] for f in self.filters]  # of each different word, once
        spoken = self.languages[(w.whole % np.uint64(LANGUAGE_BUCKETS)).astype(np.int64)]
        spoken[0] = 0
        pooled, language = np.full((n, len(WIDTHS) * FILTERS), -np.inf, np.float32), np.zeros((n, spoken.shape[1]))
        first = 0
        while first < n:  # runs of texts of about CHUNK tokens; a longer text is cut, with an overlap
            last = max(first + 1, int(np.searchsorted(w.starts, w.starts[first] + CHUNK, "right")) - 1)
            for a in range(w.starts[first], max(w.starts[last], w.starts[first] + 1), CHUNK):
                bounds = np.clip(w.starts[first : last + 1], a, min(a + CHUNK, w.starts[last])) - a
                mine, of = w.token[a : a + bounds[-1]], np.arange(first, last)
                lengths = np.diff(bounds)
                size = lengths + GAP
                begins = np.append(0, np.cumsum(size))[:-1]
                spread = np.zeros(size.sum() + GAP, np.int64)
                spread[np.arange(len(mine)) + np.repeat(begins + GAP - bounds[:-1], lengths)] = mine
                language[of] += np.add.reduceat(spoken[spread[: size.sum()]], begins)
                before = w.token[max(a - GAP, w.starts[first]) : a]  # inside a long text
                spread[GAP - len(before) : GAP] = before
                behind = w.token[a + bounds[-1] : min(a + bounds[-1] + GAP, w.starts[last])]
                spread[size.sum() : size.sum() + len(behind)] = behind
                for k, part in enumerate(parts):
                    r = part[0][spread].copy()
                    for i in range(1, len(part)):
                        r[:-i] += part[i][spread[i:]]
                    columns = slice(k * FILTERS, (k + 1) * FILTERS)
                    pooled[of, columns] = np.maximum(pooled[of, columns], np.maximum.reduceat(r[: size.sum()], begins))
            first = last
        return pooled, language

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        return np.maximum(pooled + self.bias, 0) @ self.out + self.out_bias

    def scores(self, texts: pa.Array) -> np.ndarray:
        if self.constant is not None or not len(texts):
            return np.full(len(texts), self.constant or 0.0)
        pooled, language = self.responses(words(texts))
        z = self.slope * (self.logits(pooled) - self.thresholds[language.argmax(1)]) + np.log(AT / (1 - AT))
        scores = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        return np.where(z >= np.log(AT / (1 - AT)), np.maximum(scores, AT), np.minimum(scores, np.nextafter(AT, 0)))


def gradients(model: Model, w: Words, texts: np.ndarray, y: np.ndarray, weight: np.ndarray, kept: np.ndarray) -> tuple[list, np.ndarray, np.ndarray]:
    """Of one step: of the dense parts, and of the table's rows (buckets, values). kept: which pooled maxima take part."""
    lengths = w.starts[texts + 1] - w.starts[texts]
    size = lengths + GAP
    begins = np.append(0, np.cumsum(size))
    spread = np.zeros(begins[-1] + GAP, np.int64)
    spread[np.arange(lengths.sum()) + np.repeat(begins[:-1] + GAP - np.append(0, np.cumsum(lengths))[:-1], lengths)] = w.token[np.arange(lengths.sum()) + np.repeat(w.starts[texts] - np.append(0, np.cumsum(lengths))[:-1], lengths)]
    different, place = np.unique(spread, return_inverse=True)
    n = w.pieces[different + 1] - w.pieces[different]
    pieces = np.append(0, np.cumsum(n))
    piece = w.piece[np.arange(pieces[-1]) + np.repeat(w.pieces[different] - pieces[:-1], n)]
    v = vectors(model.table, piece, pieces)
    pooled, where = [], []
    for f in model.filters:
        parts = [v @ f[i] for i in range(len(f))]
        r = parts[0][place].copy()
        for i in range(1, len(f)):
            r[:-i] += parts[i][place[i:]]
        top = np.array([a + r[a:b].argmax(0) for a, b in zip(begins[:-1], begins[1:], strict=True)])
        where.append(top)
        pooled.append(np.take_along_axis(r, top, 0))
    pooled = np.concatenate(pooled, 1) + model.bias
    active = np.maximum(pooled, 0) * kept
    p = 1 / (1 + np.exp(-np.clip(active @ model.out + model.out_bias, -30, 30)))
    d = ((p - y) * weight).astype(np.float32)
    back = d[:, None] * model.out * kept * (pooled > 0)
    dense = [back.sum(0), active.T @ d, np.float32(d.sum())]
    dv = np.zeros_like(v)
    for k, (f, top) in enumerate(zip(model.filters, where, strict=True)):
        own = back[:, k * FILTERS : (k + 1) * FILTERS]
        df = np.zeros_like(f)
        for i in range(len(f)):
            at = place[top + i]
            df[i] = np.einsum("tf,tfs->sf", own, v[at])
            np.add.at(dv, at.ravel(), (own[:, :, None] * f[i].T[None]).reshape(-1, f.shape[1]))
        dense.append(df)
    moved = np.flatnonzero(dv.any(1) & (n > 0))
    owner = np.repeat(np.arange(len(moved)), n[moved])
    rows = piece[np.arange(len(owner)) + np.repeat(pieces[moved] - np.append(0, np.cumsum(n[moved]))[:-1], n[moved])]
    buckets, inverse = np.unique(rows, return_inverse=True)
    values = np.zeros((len(buckets), v.shape[1]), np.float32)
    np.add.at(values, inverse, (dv[moved] / n[moved, None])[owner])
    return dense, buckets, values


def train(w: Words, chosen: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> Model:
    """chosen: the texts to learn from. The classes weigh the same."""
    rng = np.random.default_rng(seed)
    model = Model(table=rng.normal(0, 0.3, (BUCKETS, SIZE)).astype(np.float32))
    model.filters = [rng.normal(0, (2 / (k * SIZE)) ** 0.5, (k, SIZE, FILTERS)).astype(np.float32) for k in WIDTHS]
    model.out = rng.normal(0, 0.2, len(WIDTHS) * FILTERS).astype(np.float32)
    squares = np.full((BUCKETS, 1), 1e-3, np.float32)
    dense = [model.bias, model.out, np.zeros((), np.float32), *model.filters]
    first, second, t = [np.zeros_like(x) for x in dense], [np.zeros_like(x) for x in dense], 0
    share = y[chosen].mean()
    for _ in range(max(epochs, min(40, -(-LEAST_STEPS * STEP // len(chosen))))):  # more often through a small sample
        order = rng.permutation(chosen)
        for a in range(0, len(order), STEP):
            texts = order[a : a + STEP]
            kept = (rng.random((len(texts), len(model.out))) >= DROPOUT).astype(np.float32) / (1 - DROPOUT)
            weight = np.where(y[texts] == 1, 0.5 / share, 0.5 / (1 - share)) / len(texts)
            model.out_bias = float(dense[2])
            g, buckets, values = gradients(model, w, texts, y[texts], weight, kept)
            t += 1
            for i, x in enumerate(g):
                first[i] = 0.9 * first[i] + 0.1 * x
                second[i] = 0.999 * second[i] + 0.001 * x * x
                dense[i] -= RATE_DENSE * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.999**t)) + 1e-8) + DECAY * dense[i]
            squares[buckets] += (values * values).mean(1, keepdims=True) * len(texts) ** 2
            model.table[buckets] -= RATE_ROWS * len(texts) * values / np.sqrt(squares[buckets]) + DECAY * model.table[buckets]
    model.out_bias = float(dense[2])
    return model


def threshold(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """Half way between the two logits where the errors are least; above all if nothing is worth it."""
    order = np.argsort(-z, kind="stable")
    z, cost = z[order], (weight * np.where(y == 1, -MISSED, 1.0))[order]
    errors = np.append(0, np.cumsum(cost))  # of taking the first rows, against taking none
    apart = np.append(True, np.append(np.diff(z) != 0, True))  # equal logits fall on one side
    best = int(np.flatnonzero(apart)[errors[apart].argmin()])
    return float(z[0] + 1 if best == 0 else z[-1] - 1 if best == len(z) else (z[best - 1] + z[best]) / 2)


def calibrate(model: Model, pooled: np.ndarray, y: np.ndarray, guessed: np.ndarray, weight: np.ndarray) -> None:
    z = model.logits(pooled)
    model.thresholds = np.full(model.languages.shape[1], threshold(z, y, weight))
    for k in np.unique(guessed):
        model.thresholds[k] = threshold(z, y, weight * np.where(guessed == k, 1.0, BORROWED / len(z)))
    x = z - model.thresholds[guessed]
    slopes = np.exp(np.linspace(np.log(0.05), np.log(20), 120)) / max(float(np.std(x)), 1e-6)
    loss = [(weight * np.logaddexp(0, np.where(y == 1, -1, 1) * (s * x + np.log(AT / (1 - AT))))).sum() for s in slopes]
    model.slope = float(slopes[int(np.argmin(loss))])


def fold() -> Column:
    """crc32 of doc_id as text, modulo 3."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3


def fit(documents: DataFrame, labels: DataFrame, sample: dict[int, int] = SAMPLE, most_bytes: int = MOST_BYTES, epochs: int = EPOCHS) -> Model:
    """documents: doc_id, text, lang; labels: doc_id, toxic."""
    known = labels.where((fold() != 1) & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.avg(F.when(F.col("toxic") != 0, 1.0).otherwise(0.0)).alias("share")).where("share <> 0.5")
    short = documents.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= most_bytes)
    known = known.join(short.select("doc_id"), "doc_id", "left_semi").select("doc_id", (F.col("share") > 0.5).cast("int").alias("y"), F.xxhash64("doc_id", F.lit("toxic sample")).alias("place"))
    known = common.spool(known, "toxic-labels")
    total = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    if len(total) < 2:
        return Model(constant=float(next(iter(total), 0)))
    chosen = None
    for label, most in sample.items():
        part = known.where(F.col("y") == label).orderBy("place", "doc_id").limit(most)
        chosen = part if chosen is None else chosen.union(part)
    names = short.select("doc_id", "text", "lang").join(F.broadcast(common.spool(chosen, "toxic-sample")), "doc_id")  # as many rows as ``sample`` says
    rows = names.select("place", "doc_id", "y", "lang", "text").orderBy("place", "doc_id", "text").limit(2 * sum(sample.values())).toArrow()  # bounded in bytes too
    y = rows.column("y").to_numpy().astype(np.float32)
    w = words(rows.column("text").combine_chunks())
    kept = np.arange(len(y)) % 5 == 4
    if min(y[kept].sum(), (1 - y[kept]).sum()) < LEAST_KEPT:
        kept[:] = True  # too few to set any aside
        learn = np.arange(len(y))
    else:
        learn = np.flatnonzero(~kept)
    if len(set(y[learn])) < 2:
        return Model(constant=float(y[learn].mean() > 0.5))
    model = train(w, learn, y, epochs)
    model.languages = spoken(w, rows.column("lang").to_pylist())
    texts = rows.column("text").combine_chunks().filter(pa.array(kept))
    parts = [model.responses(words(texts.slice(a, 500))) for a in range(0, len(texts), 500)]
    pooled, language = (np.concatenate(x) for x in zip(*parts, strict=True))
    weight = np.where(y == 1, total[1] / max((y[kept] == 1).sum(), 1), total[0] / max((y[kept] == 0).sum(), 1)) / sum(total.values())
    calibrate(model, pooled, y[kept], language.argmax(1), weight[kept])
    return model


def spoken(w: Words, langs: Sequence[str | None]) -> np.ndarray:
    """Log probabilities of hashed words in each of the commonest languages of the sample."""
    names, n = np.unique([x for x in langs if x is not None] or [""], return_counts=True)
    names = sorted(names[np.argsort(-n, kind="stable")][:MOST_LANGUAGES].tolist())
    code = {x: i for i, x in enumerate(names)}
    of = np.repeat([code.get(x, -1) for x in langs], np.diff(w.starts))
    bucket = (w.whole % np.uint64(LANGUAGE_BUCKETS)).astype(np.int64)[w.token]
    used = (of >= 0) & (w.token > 0)
    counts = np.bincount(of[used] * LANGUAGE_BUCKETS + bucket[used], minlength=len(names) * LANGUAGE_BUCKETS).reshape(len(names), -1).T + 0.1
    return np.log(counts / counts.sum(0)).astype(np.float32)


def score(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted."""
    common.small_batches(documents.sparkSession, 5000)
    sent = documents.sparkSession.sparkContext.broadcast(model)  # a fixed size
    rows = documents.select("doc_id", F.coalesce(fold() == 1, F.lit(False)).alias("held_out"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = sent.value.scores(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(found, pa.float64()), pa.array(found >= AT).cast(pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(run, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = common.table(spark, sf_dir, "documents")
    return score(documents, fit(documents, common.table(spark, sf_dir, "labels")))
