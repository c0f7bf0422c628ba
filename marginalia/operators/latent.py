"""Vectors of texts: a truncated singular value decomposition of term weights, by random projection.

The matrix of texts by terms stays a table, with a row for each text. Where it has up to ``MOST_TERMS`` terms, the thin matrix over terms goes to every task: a
round is one pass over the texts, from which sums by term come back, and texts are never shuffled. With more terms the matrix is multiplied with
thin ones, held as rows with an array, by joins and sums; then what reaches the driver are products of thin matrices with themselves, (size + extra)
squared numbers, whatever the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.operators.similarity import matrix
from marginalia.sources import io

SIZE, EXTRA, ROUNDS, SEED = 16, 12, 4, "latent"
MOST_TERMS = 100_000


def _times(weights: DataFrame, thin: DataFrame, by: str, to: str, width: int) -> DataFrame:
    """The weights' matrix (or its transpose) with a thin one: rows (to, v) from rows (by, v)."""
    both = weights.join(thin, by)
    return io.written(both.groupBy(to).agg(F.array(*[F.sum(F.col("w") * F.col("v")[i]) for i in range(width)]).alias("v")), "latent")


def _gram(thin: DataFrame, width: int) -> np.ndarray:
    """The products of a thin matrix's columns: each task gives its own sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            if len(batch):
                x = matrix(batch.column("v"))
                total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], ["g"])

    found = thin.select("v").mapInArrow(run, "g array<double>").select(F.posexplode("g").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect()  # width^2 rows
    out = np.zeros(width * width)
    for r in found:
        out[r["i"]] = r["x"]
    return out.reshape(width, width)


def _turned(thin: DataFrame, name: str, by: np.ndarray) -> DataFrame:
    """Rows of a thin matrix times a small one."""
    kind = thin.schema[name].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("v")) @ by if len(batch) else np.zeros((0, by.shape[1]))
            yield pa.RecordBatch.from_arrays([batch.column(name), pa.array(list(x), pa.list_(pa.float64()))], [name, "v"])

    return thin.select(name, "v").mapInArrow(run, f"`{name}` {kind}, v array<double>")


def _scaled(gram: np.ndarray) -> np.ndarray:
    """What makes a thin matrix with these products of columns orthogonal."""
    values, vectors = np.linalg.eigh(gram)
    keep = values > max(values.max(initial=0.0), 1e-300) * 1e-12
    return vectors * np.where(keep, 1 / np.sqrt(np.where(keep, values, 1.0)), 0.0)


def _orthogonal(thin: DataFrame, name: str, width: int) -> DataFrame:
    return io.written(_turned(thin, name, _scaled(_gram(thin, width))), "latent")


def _rows(batch: pa.RecordBatch, terms: pa.Array, thin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch of texts (k, t, w): numbers of terms, weights, the text of each, and the texts times a thin matrix over terms."""
    at = pc.index_in(batch.column("t").flatten(), terms).to_numpy()
    w, n = batch.column("w").flatten().to_numpy(), batch.column("t").value_lengths().to_numpy()
    return at, w, np.repeat(np.arange(len(n)), n), np.add.reduceat(w[:, None] * thin[at], np.append(0, np.cumsum(n))[:-1])


def _pass(texts: DataFrame, terms: pa.Array, thin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """With y for the texts times a thin matrix over terms: y's products of columns, and the transposed texts times y. A task gives its own sums."""
    sent = texts.sparkSession.sparkContext.broadcast((terms, thin))
    width = thin.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, thin = sent.value
        total = np.zeros((len(terms) + width, width))
        for whole in batches:
            for a in range(0, len(whole), 2000):
                at, w, text, y = _rows(whole.slice(a, 2000), terms, thin)
                order = np.argsort(at, kind="stable")
                first = np.flatnonzero(np.diff(at[order], prepend=-1))
                total[at[order][first]] += np.add.reduceat((w[:, None] * y[text])[order], first)
                total[len(terms) :] += y.T @ y
        some = np.flatnonzero(total.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(list(total[some]), pa.list_(pa.float64()))], ["i", "v"])

    sums = texts.mapInArrow(run, "i long, v array<double>").groupBy("i").agg(F.array(*[F.sum(F.col("v")[j]) for j in range(width)]).alias("v")).toArrow()  # a row for each term
    total = np.zeros((len(terms) + width, width))
    if len(sums):
        total[sums.column("i").to_numpy()] = matrix(sums.column("v"))
    return total[len(terms) :], total[: len(terms)]


def _narrow(texts: DataFrame, start: pa.Table, size: int, rounds: int) -> tuple[DataFrame, np.ndarray]:
    """k and v of each text, and the singular values. start: t and v, the first thin matrix."""
    terms, thin = start.column("t").combine_chunks(), matrix(start.column("v"))
    gram, back = _pass(texts, terms, thin)
    for _ in range(rounds):
        thin = back @ _scaled(gram)
        gram, back = _pass(texts, terms, thin)
    turned = back @ _scaled(gram)
    values, vectors = np.linalg.eigh(turned.T @ turned)
    order = np.argsort(-values)[:size]
    singular = np.sqrt(np.maximum(values[order], 0.0))
    sent = texts.sparkSession.sparkContext.broadcast((terms, thin @ _scaled(gram) @ (vectors[:, order] * singular)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, len(whole), 2000):
                batch = whole.slice(a, 2000)
                yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(list(_rows(batch, *sent.value)[3]), pa.list_(pa.float64()))], ["k", "v"])

    kind = texts.schema["k"].dataType.simpleString()
    return texts.mapInArrow(run, f"k {kind}, v array<double>"), singular


def text_vectors(weights: DataFrame, key: str, term: str, weight: str, size: int = SIZE, extra: int = EXTRA, rounds: int = ROUNDS, seed: str = SEED) -> tuple[DataFrame, list[float]]:
    """key and vector (``size`` numbers; left singular vectors times singular values, largest first), and the singular values. weights: a row for each text
    and term; texts without a term have no vector. Where the matrix has a lower rank, the rest is 0. Rows with a null key, term or weight are left out.
    ``rounds`` more products sharpen the projection."""
    width = size + extra
    plain = weights.select(F.col(key).alias("k"), F.col(term).alias("t"), F.col(weight).cast("double").alias("w")).where("k is not null and t is not null and w is not null")
    # dealt by text: a text's terms are added and put together where they are
    each = plain.repartition("k").groupBy("k", "t").agg(F.sum("w").alias("w")).groupBy("k").agg(F.collect_list(F.struct("t", "w")).alias("l"))
    texts = io.written(each.select("k", F.col("l.t").alias("t"), F.col("l.w").alias("w")), "latent-texts")

    def normal(i: int):
        """A normal number for each term, by its hash."""
        u, v = ((F.pmod(F.xxhash64("t", F.lit(f"{seed}:{i}:{j}")), F.lit(1 << 40)) + 0.5) / float(1 << 40) for j in "uv")
        return F.sqrt(-2 * F.log(u)) * F.cos(2 * np.pi * v)

    thin = io.written(texts.select(F.explode("t").alias("t")).distinct().select("t", F.array(*[normal(i) for i in range(width)]).alias("v")), "latent-terms")
    if 0 < thin.count() <= MOST_TERMS:
        found, singular = _narrow(texts, thin.orderBy("t").toArrow(), size, rounds)
        return found.select(F.col("k").alias(key), F.col("v").alias("vector")), singular.tolist()
    w = texts.select("k", F.explode(F.arrays_zip("t", "w")).alias("x")).select("k", "x.t", "x.w")
    y = _times(w, thin, "t", "k", width)
    for _ in range(rounds):
        y = _times(w, _times(w, _orthogonal(y, "k", width), "k", "t", width), "t", "k", width)
    q = _orthogonal(y, "k", width)
    values, vectors = np.linalg.eigh(_gram(_times(w, q, "k", "t", width), width))
    order = np.argsort(-values)[:size]
    singular = np.sqrt(np.maximum(values[order], 0.0))
    found = _turned(q, "k", vectors[:, order] * singular)
    return found.select(F.col("k").alias(key), F.col("v").alias("vector")), singular.tolist()
