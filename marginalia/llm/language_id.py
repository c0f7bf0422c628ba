"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams.

A text is lower-cased, every run of what is no letter becomes one space, and its 1- to 3-character n-grams are hashed to ``BUCKETS`` numbers,
counted, weighted by inverse document frequency and scaled to length 1. The model is trained one document at a time by
follow-the-regularised-leader with per-coordinate rates and an elastic-net penalty, which leaves most weights at 0; a
temperature, fitted on a fifth of the sample that training does not see, calibrates its probabilities.

Documents with crc32(doc_id) mod 4 = 2 are held out. Document frequencies are counted over all others with a language; the
weights are fitted on a bounded sample of these: about ``per_language``
rows of each language, by a hash of doc_id, of the ``most_languages`` commonest languages (both are parameters). Only its
n-gram counts and ``BUCKETS`` frequencies reach the driver. Executors get the rows of the model that are not 0. Every
document is predicted from its whole text, which is the only input.

Nulls and ties: a null text, or one without a letter, is "und" with score 0; so is every text if there is nothing to learn
from. A null doc_id is not held out and not learned from. The first of languages with equal probability, by name, is
taken. Repeated rows are each predicted. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BUCKETS, PER_LANGUAGE, MOST_LANGUAGES = 1 << 16, 1000, 200
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.05, 0.01, 2
PIECE = 1 << 18  # characters of a text that are counted at once

_is_letter = np.zeros(0x110000, np.uint8)  # 1: a letter, 2: none, 0: not looked up yet


def has_letter(text: str) -> bool:
    return next(filter(str.isalpha, text), None) is not None


def letters_only(text: str) -> np.ndarray:
    """Code points in lower case; every run of others is one space."""
    data = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")
    new = np.unique(data[_is_letter[data] == 0])
    _is_letter[new] = [1 if chr(c).isalpha() else 2 for c in new.tolist()]
    data = np.where(_is_letter[data] == 1, data, np.uint32(32))
    if len(data):
        space = data == 32
        data = data[np.concatenate([[True], ~(space[1:] & space[:-1])])]
    return data


def n_grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of 1 to 3 characters, and how often each occurs."""
    data, counts = letters_only(text), np.zeros(BUCKETS, np.int64)
    for start in range(0, len(data), PIECE):
        part = data[start : start + PIECE + 2].astype(np.uint64)
        value = np.zeros(len(part), np.uint64)
        for n in range(3):
            value = (value[: len(part) - n] << np.uint64(21)) | part[n:]
            own = value[:PIECE]  # n-grams that begin here
            mixed = (own + np.uint64((n + 1) << 61)) * np.uint64(0x9E3779B97F4A7C15)
            counts += np.bincount(((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(48)).astype(np.int64), minlength=BUCKETS)
    at = counts.nonzero()[0]
    return at, counts[at]


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # of the buckets in ``row``, by language
    temperature: float = 1.0
    row: np.ndarray | None = None  # the row of each bucket in weights; None: all buckets, in order

    def without_zeros(self) -> Model:
        """The same model with the buckets that have a weight only: what executors need."""
        kept = np.flatnonzero(self.weights.any(axis=1))
        row = np.full(BUCKETS, len(kept), np.int32)
        row[kept] = np.arange(len(kept))
        none = np.zeros((1, self.weights.shape[1]))
        return Model(self.languages, self.idf, np.concatenate([self.weights[kept], none]), self.temperature, row)

    def features(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        x = n * self.idf[at]
        length = np.sqrt((x * x).sum())
        return x / length if length else x

    def logits(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        return self.features(at, n) @ self.weights[at if self.row is None else self.row[at]]

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or text is None or not has_letter(text):
            return "und", 0.0
        p = softmax(self.logits(*n_grams(text)) / self.temperature)
        return self.languages[int(p.argmax())], float(p.max())


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(rows: list[tuple[np.ndarray, np.ndarray, str]], idf: np.ndarray, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2, epochs: int = EPOCHS) -> Model:
    """rows: buckets, counts, language. Every fifth row calibrates."""
    languages = sorted({r[2] for r in rows})
    kept, learn = rows[4::5], [r for i, r in enumerate(rows) if i % 5 != 4]
    model = Model(languages, idf, np.zeros((BUCKETS, len(languages))))
    z, n = np.zeros_like(model.weights), np.zeros_like(model.weights)
    inputs = [(at, model.features(at, c)[:, None], languages.index(lang)) for at, c, lang in learn]
    for _ in range(epochs):
        for at, x, y in inputs:
            zs, ns = z[at], n[at]
            w = np.where(np.abs(zs) <= l1, 0.0, -(zs - np.sign(zs) * l1) / ((beta + np.sqrt(ns)) / alpha + l2))
            p = softmax((x * w).sum(axis=0))
            p[y] -= 1
            g = x * p
            more = ns + g * g
            z[at] = zs + g - (np.sqrt(more) - np.sqrt(ns)) / alpha * w
            n[at] = more
    model.weights = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))
    if kept:
        logits = np.array([model.logits(at, c) for at, c, _ in kept])
        truth = np.array([languages.index(lang) for _, _, lang in kept])
        grid = np.exp(np.linspace(np.log(0.02), np.log(20), 200))
        loss = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(truth)), truth], 1e-12)).mean() for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
    return model


def fold() -> Column:
    """crc32 of doc_id as text, modulo 4."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4


def document_frequencies(documents: DataFrame) -> tuple[int, np.ndarray]:
    """How many texts with a letter there are, and how many of them have an n-gram of each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, counts = 0, np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for text in batch.column("text"):
                if (t := text.as_py()) and has_letter(t):
                    total += 1
                    counts[n_grams(t)[0]] += 1
        at = counts.nonzero()[0]
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(counts[at], total))], ["bucket", "n"])

    found = documents.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # BUCKETS + 1 rows at most
    at, n = found.column("bucket").to_numpy(), found.column("n").to_numpy()
    out = np.zeros(BUCKETS, np.int64)
    out[at[at >= 0]] = n[at >= 0]
    return int(n[at < 0].sum()), out


def fit(documents: DataFrame, per_language: int = PER_LANGUAGE, most_languages: int = MOST_LANGUAGES) -> Model:
    common.small_batches(documents.sparkSession)
    nothing = Model([], np.ones(BUCKETS), np.zeros((BUCKETS, 0)))
    known = documents.where((fold() != 2) & F.col("lang").isNotNull())
    counts = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_languages).collect()
    if not counts:
        return nothing
    draw = F.pmod(F.xxhash64("doc_id", F.lit("language sample")), F.lit(1 << 30)) / float(1 << 30)
    share = F.coalesce(*[F.when(F.col("lang") == r["lang"], F.lit(min(1.0, per_language / r["count"]))) for r in counts], F.lit(0.0))
    some = known.where(draw < share).select(F.xxhash64("doc_id", F.lit("order")).alias("place"), "lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, lang, *map(np.ndarray.tolist, n_grams(t))) for i, lang, t in zip(*(batch.column(c).to_pylist() for c in ("place", "lang", "text")), strict=True) if t and has_letter(t)]
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=kind)

    names = ["place", "lang", "at", "n"]
    kind = pa.schema(list(zip(names, [pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32())], strict=True)))
    counted = some.mapInArrow(count, "place long, lang string, at array<int>, n array<int>")
    # a bound on what comes here, even if many rows share a doc_id
    bounded = counted.orderBy("place", "lang").limit(2 * per_language * len(counts)).toArrow().to_batches()
    rows = [(np.array(at.as_py(), np.int64), np.array(n.as_py(), np.int64), lang.as_py()) for b in bounded for lang, at, n in zip(b.column("lang"), b.column("at"), b.column("n"), strict=True)]
    if not rows:
        return nothing
    total, df = document_frequencies(known)
    return train(rows, np.log((1 + total) / (1 + df)) + 1)


def predict(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred and score."""
    common.small_batches(documents.sparkSession)
    sent = documents.sparkSession.sparkContext.broadcast(model.without_zeros())  # BUCKETS x languages at most
    rows = documents.select("doc_id", F.coalesce(fold() == 2, F.lit(False)).alias("held_out"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sent.value.predict(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return rows.mapInArrow(run, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = common.table(spark, sf_dir, "documents")
    return predict(documents, fit(documents))
