"""Token ids in ORC files.

Documents are range-partitioned and sorted by doc_id, encoded, and written as ORC: integer run-length encoding for the
ids, row indexes every ``row_stride`` rows, a Bloom filter on doc_id in every stripe. Readers take stripes in parallel;
a lookup by doc_id skips files, stripes and row groups by their statistics and Bloom filters (Spark's ORC pushdown).

Each file holds one range of doc_id. ``part`` is its rank, ``part_start`` counts the ids before a document inside the
file, so global offsets need only one total a file.

Nulls and ties: a null or empty text has the end id only; a null doc_id sorts first; rows with equal doc_id are ordered by
a hash of the text, then the text; identical rows are each written. An empty table gives an empty result. Columns other
than doc_id and text are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import compress
from operator import not_

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

END_ID = 1
OTHER_SCRIPTS = "\u0530"  # Latin, Greek and Cyrillic letters are below
PUNCTUATION = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


class WordIds:
    """Ids of white-space-free pieces of text, by their bytes; ids are kept as little-endian 32-bit integers.

    The tokenizer drops white space and never joins across it, so a text's ids are those of its pieces, one after the
    other. A piece with punctuation around ASCII letters or digits, or around letters that stay single letters in lower
    case, is looked up in three parts, since the tokenizer splits there too; all other pieces (with marks, other scripts
    or symbols, contractions, special tokens) are encoded by the library as they stand.
    What a batch of texts lacks is encoded together, parted by a special token, and kept until ``limit`` is reached.
    """

    PART = "<|endoftext|>"

    def __init__(self, tokenizer_path: str, limit: int = 800_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(tokenizer_path), limit
        self.known: dict[bytes, bytes] = {b"": b""}
        tokens = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size())]
        self.ends_word = np.array([t.endswith("</w>") for t in tokens])
        self.is_part = np.array([t == self.PART for t in tokens])

    def _encode(self, parts: list[bytes]) -> list[bytes]:
        out: list[bytes] = []
        for at in range(0, len(parts), 256):
            some = [p.decode() for p in parts[at : at + 256]]
            if not all(map(self._is_one, some)) or (made := self._cut(some, " ", self.ends_word)) is None:
                made = self._cut(some, self.PART, self.is_part)
            out += made
        return out

    @staticmethod
    def _is_one(part: str) -> bool:
        """Letters only, which the tokenizer takes as one word: the last of its ids, and no other, ends a word."""
        return part.isalpha()

    def _cut(self, parts: list[str], between: str, is_end: np.ndarray) -> list[bytes] | None:
        ids = np.array(self.tokenizer.encode_batch_fast([between.join(parts)], add_special_tokens=False)[0].ids, "<i4")
        ends, data = np.flatnonzero(is_end[ids]), ids.tobytes()
        if between == " ":
            if len(ends) != len(parts):
                return None
            cuts = [0, *(4 * (ends + 1)).tolist()]
            return [data[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        cuts = [-1, *ends.tolist(), len(ids)]
        return [data[4 * a + 4 : 4 * b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def _learn(self, missing: set[bytes]) -> None:
        """A lower-cased core is a piece too, and is kept as one."""
        known, plain, parted, special = self.known, set(), [], []
        letters = set()
        for piece in missing:
            if piece.isalpha():  # ASCII letters, as most pieces are
                low = piece.lower()
                letters.add(low)
                if low != piece:
                    parted.append((piece, b"", low, b""))
                continue
            core = piece.strip(PUNCTUATION)
            if b"<|" in piece:
                special.append(piece)
            elif not piece.isascii():
                text = core.decode()
                if core and (core == piece or b"'" not in piece) and text.isalpha() and text.lower().isalpha() and max(text) < OTHER_SCRIPTS:
                    letters.add(core)
                    if core != piece:
                        before, after = piece.split(core, 1)
                        plain.update((before, after))
                        parted.append((piece, before, core, after))
                else:
                    plain.add(piece)
            elif core == piece or not (core[:1].isalnum() and core[-1:].isalnum()) or b"'" in piece:
                low = piece.lower()
                plain.add(low)
                if low != piece:
                    parted.append((piece, b"", low, b""))
            else:
                before, after = piece.split(core, 1)
                low = core.lower()
                plain.update((before, after))
                (letters if low.isalpha() else plain).add(low)
                parted.append((piece, before, low, after))
        for some in (letters, plain):
            new = [x for x in some if x not in known]
            known.update(zip(new, self._encode(new), strict=True))
        for piece, before, core, after in parted:
            known[piece] = known[before] + known[core] + known[after]
        for piece in special:
            known[piece] = np.array(self.tokenizer.encode(piece.decode(), add_special_tokens=False).ids, "<i4").tobytes()

    def ids(self, texts: list[bytes]) -> list[bytes]:
        out = []
        for at in range(0, len(texts), 200):  # bounds what is split at once
            if len(self.known) > self.limit:
                self.known = {b"": b""}
            words = [t.split() for t in texts[at : at + 200]]
            ids = [list(map(self.known.get, w)) for w in words]
            short = [i for i, x in enumerate(ids) if None in x]
            self._learn({w for i in short for w in compress(words[i], map(not_, ids[i]))})
            for i in short:
                w, x = words[i], ids[i]
                for k in compress(range(len(x)), map(not_, x)):
                    x[k] = self.known[w[k]]
            out += map(b"".join, ids)
        return out


def word_ids(tokenizer_path: str) -> WordIds:
    """One for each Python worker: workers are used again, and so is what they have looked up."""
    return common.held(f"words of {tokenizer_path}", lambda: WordIds(tokenizer_path))


def encode(documents: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """doc_id, part, part_start, n_tokens, ids: in ascending doc_id order, part by part."""
    common.small_batches(documents.sparkSession)
    schema = f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, part int, part_start long, n_tokens int, ids array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, start = word_ids(tokenizer_path), TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<i4").tobytes()
        for batch in batches:
            ids = [x + end for x in words.ids(batch.column("text").cast(pa.binary()).to_pylist())]
            n = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
            ends = np.cumsum(n)
            values = pa.array(np.frombuffer(b"".join(ids), "<i4"), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(np.full(len(n), part, np.int32)),
                    pa.array(start + ends - n),
                    pa.array(n.astype(np.int32)),
                    pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), values),
                ],
                ["doc_id", "part", "part_start", "n_tokens", "ids"],
            )
            start += int(n.sum())

    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    tie = F.xxhash64("text")
    return rows.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie, "text").mapInArrow(run, schema)


def write_orc(encoded: DataFrame, path: str, stripe_bytes: int = 64 << 20, row_stride: int = 10_000) -> None:
    (
        encoded.write.option("compression", "zstd")
        .option("orc.stripe.size", stripe_bytes)
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", row_stride)
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .orc(path)
    )


def read_orc(spark: SparkSession, path: str, sums: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids. sums: ids_crc32 in place of ids."""
    rows = spark.read.orc(path)
    rows = checksums(rows) if sums else rows
    totals = spark.read.orc(path).groupBy("part").agg(F.sum("n_tokens").alias("n"))  # a row for each file
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    return rows.join(offsets, "part").select("doc_id", (F.col("before") + F.col("part_start")).alias("start"), F.col("n_tokens").cast("long").alias("n_tokens"), "ids_crc32" if sums else "ids")


def lookup(spark: SparkSession, path: str, doc_id: int) -> DataFrame:
    """One document's ids; file, stripe and row-group statistics and the Bloom filters prune the rest."""
    return spark.read.orc(path).where(F.col("doc_id") == doc_id).select("doc_id", "n_tokens", "ids")


def checksums(rows: DataFrame) -> DataFrame:
    """ids replaced by ids_crc32, of the ids as little-endian unsigned 32-bit integers."""
    kept = [c for c in rows.columns if c != "ids"]
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept) + ", ids_crc32 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            at = ids.offsets.to_numpy()
            data = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), "<i4")).cast("B")
            crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(crc, pa.int64())], [*kept, "ids_crc32"])

    return rows.mapInArrow(run, schema)


def tokens_to_orc(documents: DataFrame, tokenizer_path: str, path: str, sums: bool = False) -> DataFrame:
    """Encode, write, and what the files then hold."""
    write_orc(encode(documents, tokenizer_path), path)
    return read_orc(documents.sparkSession, path, sums)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = common.shared_dir(spark, "op3-orc")
    back = tokens_to_orc(common.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), path, sums=True)
    return back.select("doc_id", "start", "n_tokens", "ids_crc32")
