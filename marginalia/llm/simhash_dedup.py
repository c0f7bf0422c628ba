"""Near-duplicates: by SimHash with covering locality-sensitive hashing (``fingerprint_groups``, op10), and by the Jaccard
similarity of word shingles (``near_duplicates``, which ``deduplicate`` and the pipeline's stage go by).

A fingerprint has a bit for each of 64 positions, set where more than half of the shingle hashes have it. Two fingerprints
link at ``radius`` or fewer differing bits. Table v keeps the bits i with <m(i), v> = 1 over GF(2), where m(i) are non-zero
vectors of radius+1 bits and v runs over all non-zero vectors: for any radius positions there is a v orthogonal to
their vectors, so a pair within the radius agrees on what some table keeps. No pair is missed.

Copies never meet as pairs: equal fingerprints are one node. Buckets of two are compared as they are; larger ones are
cut into blocks of ``block`` members, every two blocks are compared in some task, and a task returns a star for each group
that it finds linked, not its pairs. Links are joined into components by alternating large-star and small-star steps.

``near_duplicates`` links texts whose sets of 5-word shingles have a Jaccard similarity of 80 % or more. Candidates are the pairs that covering LSH
finds within 3 bits of the SimHash of these shingles, none missed. Most pairs at 80 % are farther apart, so to these come pairs that agree on the 5
MinHash values of one of 32 bands and differ in at most 28 of 128 one-bit MinHash values; a pair at 80 % is missed by all bands
with probability (1 - 0.8^5)^32 = 3e-6, and by the bits with 2e-5, so recall is high and not certain. The candidates'
components bound the work: the shingle sets of each are compared exactly, all with all, in blocks as above.

Nulls and ties: a null or empty text, or one of white space only, has fingerprint 0 (in ``near_duplicates``, the one shingle of no words)
and links like any other; fewer words than a shingle has make one shingle. A null doc_id never is a component's id, unless all of its ids are null. Repeated
rows are each returned. An empty table gives an empty result. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

SEED = 42
BLOCK, SKETCH_BLOCK = 1024, 8192
PERCENT, WORDS, ROWS, BANDS, BITS = 80, 5, 5, 32, 28
_rng = np.random.default_rng(SEED)
TIMES, PLUS = (_rng.integers(0, 2**64, ROWS * BANDS, np.uint64) | np.uint64(1), _rng.integers(0, 2**64, ROWS * BANDS, np.uint64))
MIX = np.uint64(0x9E3779B97F4A7C15)


def covering_masks(radius: int = 3, bits: int = 64) -> list[int]:
    """2^(radius+1) - 1 masks; each keeps about half of the bits."""
    top = 2 ** (radius + 1) - 1
    vectors = [i % top + 1 for i in range(bits)]
    return [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2) for v in range(1, top + 1)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """Of each window of size words, or of all words if they are fewer."""
    import xxhash

    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], "<u8")
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - size + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[s:e], SEED) for s, e in zip(starts, ends[size - 1 :].tolist(), strict=True)], "<u8")


def fingerprint(text: bytes, size: int = 3) -> int:
    """Of UTF-8; A-Z are lower-cased, words are split at ASCII white space."""
    words = text.lower().split()  # bytes.lower() changes A-Z only
    if not words:
        return 0
    return signature(shingle_hashes(words, size))


def signature(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have."""
    # one count for each bit: over blocks, so that a very long text needs little memory
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):
        counts += np.unpackbits(hashes[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(documents: DataFrame, size: int = 3) -> DataFrame:
    """doc_id, key (of the text) and fp, the fingerprint as a signed long."""
    common.small_batches(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.as_py() or b"", size) for t in batch.column("text").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc_id", "key", "fp"])

    return documents.select("doc_id", common.text_key().alias("key"), "text").mapInArrow(run, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, key long, fp long")


def linked_stars(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """(smallest, other) for each group of fps that links join: all are compared with all, few rows are returned."""
    values = np.unique(fps)
    left, out = np.ones(len(values), bool), []
    bits = values.view(np.uint64)
    for i in range(len(values)):
        if not left[i]:
            continue
        left[i], front = False, [i]
        while front:
            near = left & (np.bitwise_count(bits ^ bits[front.pop()]) <= radius)
            found = np.flatnonzero(near)
            left[found] = False
            out += [(int(values[i]), int(values[j])) for j in found]
            front += found.tolist()
    return out


def links(nodes: DataFrame, radius: int = 3, block: int = BLOCK) -> DataFrame:
    """a < b: links enough to join every two fingerprints that differ in radius bits or fewer. nodes: distinct fp."""
    masks = covering_masks(radius)
    keys = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for i, m in enumerate(masks)])
    rows = nodes.select("fp", F.explode(keys).alias("k")).select("k.t", "k.key", "fp")
    buckets = common.spool(rows.groupBy("t", "key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"), "simhash-buckets")
    two = buckets.where(f"n = 2 and bit_count(a ^ b) <= {radius}").select("a", "b")
    large = rows.join(buckets.where("n > 2").select("t", "key", "n"), ["t", "key"])
    cut = large.withColumn("of", F.ceil(F.col("n") / block).cast("int")).withColumn("own", F.pmod(F.xxhash64("fp"), "of").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("of") - 1)).alias("other")
    cells = cut.select("t", "key", "fp", "own", other).select("t", "key", "fp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    cell = ["t", "key", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            now = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in [*cell, "fp"]], axis=1)
            rest = now if rest is None else np.concatenate([rest, now])
            cuts = np.flatnonzero((rest[1:, :4] != rest[:-1, :4]).any(axis=1)) + 1
            if len(cuts):
                done, rest = np.split(rest[:, 4], cuts)[:-1], rest[cuts[-1] :]
                yield found(done)
        if rest is not None and len(rest):
            yield found([rest[:, 4]])

    def found(groups: list[np.ndarray]) -> pa.RecordBatch:
        pairs = np.array([p for g in groups for p in linked_stars(g, radius)], np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    many = cells.repartition(*cell).sortWithinPartitions(*cell).mapInArrow(run, "a long, b long")
    return two.union(many).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for each node of edges (a, b) but the roots: root is the smallest node that it reaches.

    Large-star, then small-star, each as a minimum by node and a join with it, until nothing changes; every step is
    written, so joins at a hub start from plain scans and can be split.
    """
    now, before = common.spool(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"), None
    for _ in range(most_rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = common.spool(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        # every larger neighbour, and the node itself, point to the smallest one
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = common.spool(large.union(least.where("m < u").select("u", F.col("m").alias("v"))).distinct(), "large-star")
        least = common.spool(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = common.spool(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        sign = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if sign == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = sign
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def component_ids(rows: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """doc_id, key, fp and component_id of rows. nodes: fp and least, its smallest doc_id."""
    roots = components(edges)
    known = common.spool(nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "roots")
    ids = common.spool(known.groupBy("root").agg(F.min("least").alias("component_id")), "ids")
    named = common.spool(known.join(ids, "root").select("fp", "component_id"), "named")
    return rows.join(named, "fp").select("doc_id", "key", "fp", "component_id")


def fingerprint_groups(documents: DataFrame, size: int = 3, radius: int = 3, block: int = BLOCK) -> DataFrame:
    """doc_id, key, fp and component_id (the smallest doc_id of the component) for every row."""
    rows = common.spool(fingerprints(documents, size), "fingerprints")
    nodes = common.spool(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    return component_ids(rows, nodes, links(nodes.select("fp"), radius, block))


def minima(hashes: np.ndarray) -> np.ndarray:
    """The MinHash values; over blocks, so that a very long text needs little memory."""
    out = np.full(ROWS * BANDS, 2**64 - 1, np.uint64)
    for at in range(0, len(hashes), 1024):
        np.minimum(out, (TIMES[:, None] * hashes[at : at + 1024] + PLUS[:, None]).min(axis=1), out=out)
    return out


def sketches(documents: DataFrame, size: int = WORDS) -> DataFrame:
    """doc_id, key (of the text), fp (a hash of the words), sim (the SimHash of the shingles), s0 and s1 (one-bit MinHash values), bands (a hash of each)."""
    import xxhash

    common.small_batches(documents.sparkSession)
    names = ["doc_id", "key", "fp", "sim", "s0", "s1", "bands"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.held(None)
        for batch in batches:
            words = [(t.as_py() or b"").lower().split() for t in batch.column("text").cast(pa.binary())]
            fps = np.array([xxhash.xxh64_intdigest(b" ".join(w), SEED) for w in words], np.uint64)
            least, sims = np.empty((len(words), ROWS * BANDS), np.uint64), np.empty(len(words), np.uint64)
            for i, w in enumerate(words):
                hashes = shingle_hashes(w, size)
                least[i], sims[i] = minima(hashes), signature(hashes)
            bits = np.packbits((least[:, :128] * MIX >> np.uint64(63)).astype(bool), axis=1).view(np.int64)
            bands = (least.reshape(-1, BANDS, ROWS) * TIMES[:ROWS]).sum(axis=2, dtype=np.uint64).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(words) + 1, dtype=np.int32) * BANDS), pa.array(bands.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(fps.view(np.int64)), pa.array(sims.view(np.int64)), pa.array(bits[:, 0]), pa.array(bits[:, 1]), lists], names)

    return documents.select("doc_id", common.text_key().alias("key"), "text").mapInArrow(run, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, key long, fp long, sim long, s0 long, s1 long, bands array<bigint>")


def stars(fps: np.ndarray, near: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """(first, other) for each group that links join. near(i, others) tells which of others link to i."""
    left, out = np.ones(len(fps), bool), []
    for i in range(len(fps)):
        if not left[i]:
            continue
        left[i], front = False, [i]
        while front and len(rest := np.flatnonzero(left)):
            found = rest[near(front.pop(), rest)]
            left[found] = False
            out += [(int(fps[i]), int(fps[j])) for j in found]
            front += found.tolist()
    return out


def alike(fps: np.ndarray, bits: int = BITS) -> list[tuple[int, int]]:
    """Stars of rows (fp, s0, s1) that differ in at most so many bits."""
    s = np.ascontiguousarray(fps[:, 1:]).view(np.uint64)
    return stars(fps[:, 0], lambda i, rest: np.bitwise_count(s[rest] ^ s[i]).sum(axis=1, dtype=np.int64) <= bits)


def overlapping(fps: np.ndarray, sets: list[np.ndarray], percent: int = PERCENT) -> list[tuple[int, int]]:
    """Stars of sets whose Jaccard similarity is so many percent or more. As groups are found, only the rest is compared on."""
    sizes = np.array([len(x) for x in sets])
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1].reshape(-1).astype(np.int32)
    starts = np.cumsum(sizes) - sizes
    own_codes = [codes[a : a + n] for a, n in zip(starts.tolist(), sizes.tolist(), strict=True)]
    marked = np.zeros(codes.max() + 1, bool)
    held = np.arange(len(fps))  # whose codes are in codes, in order

    def near(i: int, rest: np.ndarray) -> np.ndarray:
        nonlocal codes, starts, held
        if 2 * len(rest) < len(held):
            held = rest
            codes = np.concatenate([own_codes[k] for k in held.tolist()])
            starts = np.cumsum(sizes[held]) - sizes[held]
        marked[own_codes[i]] = True
        shared = np.add.reduceat(marked[codes], starts, dtype=np.int64)[np.searchsorted(held, rest)]
        marked[own_codes[i]] = False
        return 100 * shared >= percent * (sizes[i] + sizes[rest] - shared)

    return stars(fps, near)


def in_cells(rows: DataFrame, group: list[str], carried: list[str], compare: Callable[[pa.Table], list[tuple[int, int]]], block: int) -> DataFrame:
    """a and b, from compare over the members of each group; above block members (n), over every two blocks of them."""
    cut = rows.withColumn("of", F.ceil(F.col("n") / block).cast("int")).withColumn("own", F.pmod(F.xxhash64("fp"), "of").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("of") - 1)).alias("other")
    cells = cut.select(*group, *carried, "own", other).select(*group, *carried, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    cell = [*group, "i", "j"]

    def found(groups: list[pa.Table]) -> pa.RecordBatch:
        pairs = np.array([p for g in groups if len(g) > 1 for p in compare(g)], np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            rest = now if rest is None else pa.concat_tables([rest, now])
            keys = np.stack([rest.column(c).to_numpy().astype(np.int64) for c in cell], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist()]
            if len(cuts) > 1:
                yield found([rest.slice(s, e - s) for s, e in zip(cuts, cuts[1:], strict=False)])
                rest = rest.slice(cuts[-1])
        if rest is not None and len(rest):
            yield found([rest])

    return cells.repartition(*cell).sortWithinPartitions(*cell).mapInArrow(run, "a long, b long")


def candidates(nodes: DataFrame, block: int = SKETCH_BLOCK) -> DataFrame:
    """a and b: links enough to join every two fp of a band whose bits are alike. nodes: distinct fp, with s0, s1, bands."""
    rows = nodes.select("fp", "s0", "s1", F.posexplode("bands").alias("t", "band"))
    # of two members, the exclusive or of s0 is what they differ in
    buckets = rows.groupBy("t", "band").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"), F.bit_xor("s0").alias("x0"), F.bit_xor("s1").alias("x1"))
    buckets = common.spool(buckets.where("n > 1"), "bands")
    two = buckets.where(f"n = 2 and bit_count(x0) + bit_count(x1) <= {BITS}").select("a", "b")
    large = rows.join(buckets.where("n > 2").select("t", "band", "n"), ["t", "band"])
    met = in_cells(large, ["t", "band"], ["fp", "s0", "s1"], lambda g: alike(np.stack([g.column(c).to_numpy() for c in ("fp", "s0", "s1")], axis=1)), block)
    return two.union(met).distinct()


def simhash_candidates(nodes: DataFrame, radius: int = 3, block: int = BLOCK) -> DataFrame:
    """a and b: links enough to join every two fp whose SimHash differs in ``radius`` bits or fewer, by covering LSH. nodes: distinct fp, with sim."""
    same = common.spool(nodes.groupBy("sim").agg(F.min("fp").alias("first")), "sims")
    equal = nodes.select("sim", "fp").join(same, "sim").where("fp <> first").select(F.col("first").alias("a"), F.col("fp").alias("b"))
    named = lambda c: same.select(F.col("sim").alias(c), F.col("first").alias(f"fp_{c}"))
    near = links(same.select(F.col("sim").alias("fp")), radius, block).join(named("a"), "a").join(named("b"), "b")
    return equal.union(near.select("fp_a", "fp_b"))


def near_duplicates(documents: DataFrame, size: int = WORDS, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """doc_id, key, fp and component_id for every row: components by exact Jaccard similarity of the candidates' shingles."""
    rows = common.spool(sketches(documents, size), "sketches")
    nodes = common.spool(rows.dropDuplicates(["fp"]), "sketch-nodes")
    near = components(simhash_candidates(nodes, block=block).union(candidates(nodes, block)))
    members = common.spool(near.select(F.col("node").alias("fp"), "root").union(near.select("root", "root").distinct()), "candidates")
    members = members.join(members.groupBy("root").agg(F.count("*").alias("n")), "root")
    chosen = common.spool(nodes.select("fp", F.col("doc_id").alias("d"), F.col("key").alias("k")).join(members, "fp"), "candidate-texts")
    texts = documents.select("doc_id", common.text_key().alias("key"), "text")
    texts = texts.join(chosen, texts["doc_id"].eqNullSafe(chosen["d"]) & (texts["key"] == chosen["k"])).select("root", "n", "fp", "text").dropDuplicates(["fp"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(shingle_hashes((t.as_py() or b"").lower().split(), size)).tobytes() for t in batch.column("text").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("root", "n", "fp")), pa.array(found, pa.binary())], ["root", "n", "fp", "shingles"])

    def compare(group: pa.Table) -> list[tuple[int, int]]:
        return overlapping(group.column("fp").to_numpy(), [np.frombuffer(x.as_py(), np.uint64) for x in group.column("shingles")], percent)

    shingled = texts.mapInArrow(sets, "root long, n long, fp long, shingles binary")
    edges = in_cells(shingled, ["root"], ["fp", "shingles"], compare, block)
    least = common.spool(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    return component_ids(rows.select("doc_id", "key", "fp"), least, edges)


def deduplicate(documents: DataFrame, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Of each component of similar texts the rows with its smallest doc_id stay, repeated rows once; one without any doc_id stays whole."""
    found = near_duplicates(documents, size, percent)
    gone = found.where("component_id is not null and not (doc_id <=> component_id)").select(F.col("doc_id").alias("_d"), F.col("key").alias("_k")).distinct()
    names = documents.columns
    key, copy = common.unused(names, "_key"), common.unused(names, "_copy")
    rows = documents.withColumn(key, common.text_key())
    kept = rows.join(gone, rows["doc_id"].eqNullSafe(gone["_d"]) & (rows[key] == gone["_k"]), "left_anti").select(*(rows[c] for c in names), rows[key])
    kept = kept.withColumn(copy, F.row_number().over(Window.partitionBy("doc_id", key).orderBy(F.lit(0))))
    return kept.where(F.col(copy) == 1).select(*names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprint_groups(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
