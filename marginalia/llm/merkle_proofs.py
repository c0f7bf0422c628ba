"""Merkle dataset manifest: every document's authentication path, by logarithmic Merkle traversal in aligned blocks.

Leaves are digests of rows, in order of doc_id by language. Each language's leaves are numbered through a range partitioning and the
sizes of its ranges, and cut into blocks of 2^``levels`` neighbours. The root of a block is a leaf of a tree above, which is
cut into blocks again, until one node is left; languages' subroots form one more such tree up to the root. So no task ever
holds more than a block, and each tree above is 2^levels times smaller than the one below.

Within a block one pass of treehash gives the first leaf's authentication path; then paths advance leaf by leaf: at each
height a treehash stack prepares the next node of the path, and 2 * levels - 1 steps a leaf go to the stack whose lowest node is
lowest, which keeps at most a few nodes a height. The path of the block's root in the trees above is shared by all of its leaves
and appended.

A path is a list, from the leaf up, of "L" or "R" and the digest of the sibling on the left or right, or "" where a node stands
alone at the end of its run. ``fold`` goes from a leaf along its path to the root it proves.

Nulls and ties: a null counts as "-" in a leaf; the null language is a language of its own, first in order; null ids
come first; rows with equal ids go by their leaves, and equal leaves, which are interchangeable, each get a place and a path.
A null id is never tampered with. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from . import common

LEVELS, FIELDS, EVERY = 8, ("doc_id", "source", "lang", "n_chars", "text"), 7


def leaf_digest(values: Sequence[Column]) -> Column:
    def part(value: Column) -> Column:
        value = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*map(part, values)), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    side = lambda x, s: F.when(x.startswith(s), F.substring(x, 2, 64)).otherwise("")
    return F.aggregate(path, leaf, lambda a, x: F.sha2(F.concat(side(x, "L"), a, side(x, "R")), 256))


def proof(path: Column) -> Column:
    """Digest of the siblings, from the leaf up."""
    return F.sha2(F.array_join(F.transform(path, lambda x: F.substring(x, 2, 64)), ""), 256)


def join(left: bytes | None, right: bytes | None) -> bytes | None:
    """The node above two; None is beyond the end."""
    return None if left is None else sha256(left + (right or b"")).hexdigest().encode()


class Stack:
    """Treehash: the node at ``height`` over the leaves from ``at`` on, one leaf or one hash a step."""

    __slots__ = ("height", "at", "nodes", "low")

    def __init__(self, height: int, at: int, size: int, node: bytes | None = None):
        self.height, self.at, self.nodes = height, at, []
        self.low = height
        if node is not None or at >= size:  # known, or beyond the end
            self.nodes, self.low = [(height, node)], math.inf

    def step(self, leaves: Sequence[bytes]) -> None:
        nodes = self.nodes
        if len(nodes) > 1 and nodes[-1][0] == nodes[-2][0]:
            (h, right), (_, left) = nodes.pop(), nodes.pop()
            nodes.append((h + 1, join(left, right)))
        else:
            nodes.append((0, leaves[self.at] if self.at < len(leaves) else None))
            self.at += 1
        top = nodes[-1][0]
        self.low = math.inf if top == self.height else top


def traverse(leaves: Sequence[bytes], levels: int) -> Iterator[list[bytes | None]]:
    """For each leaf, in order, the sibling at each height below ``levels``; None: it has none."""
    size = len(leaves)
    path: list[bytes | None] = [None] * levels
    stacks = [Stack(h, size, size) for h in range(levels)]
    first: list[tuple[int, bytes | None]] = []
    for i in range(1 << levels if levels else 0):  # treehash over the block, which keeps the first path and the nodes after it
        node, h = (leaves[i] if i < size else None), 0
        while True:
            index = i >> h
            if h < levels and index == 0:
                stacks[h] = Stack(h, 0, size, node)
            elif h < levels and index == 1:
                path[h] = node
            if not (first and first[-1][0] == h):
                break
            node, h = join(first.pop()[1], node), h + 1
        first.append((h, node))
        if i >= size and not i & (i - 1):
            break  # what follows is beyond the end
    for i in range(size):
        yield list(path)
        for h in range(levels):
            if (i + 1) & ((1 << h) - 1):
                break
            path[h] = stacks[h].nodes[0][1]
            stacks[h] = Stack(h, (i + 1 + (1 << h)) ^ (1 << h), size)
        lows = [s.low for s in stacks]
        for _ in range(2 * levels - 1):
            least = min(lows)
            if least == math.inf:
                break
            stack = stacks[k := lows.index(least)]
            stack.step(leaves)
            lows[k] = stack.low


def depth(total: int, levels: int) -> int:
    """Heights of a block in a sequence of ``total`` nodes."""
    return min(levels, (total - 1).bit_length())


def placed(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """rows (host first in order) with pos, from 0 in each host, and total, its size. Ranges are sorted, numbered and written; their
    sizes give each its offset."""
    schema = rows.select("*", F.lit(0).alias("part"), F.lit(0).cast("long").alias("place")).schema

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        host, n = None, 0
        for batch in batches:
            runs = pc.run_end_encode(batch.column("host"))
            places, begin = [], 0
            for value, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist(), strict=True):
                if value != host:
                    host, n = value, 0
                places.append(np.arange(n, n + end - begin))
                n, begin = n + end - begin, end
            place = pa.array(np.concatenate(places) if places else np.zeros(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, place], [*batch.schema.names, "place"])

    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    ranged = common.spool(sorted_rows.mapInArrow(number, schema), "merkle-ranged")
    sizes = ranged.groupBy("host", "part").agg(F.count("*").alias("n"))  # a few rows a range
    before = Window.partitionBy("host").orderBy("part")
    sizes = sizes.select("host", "part", (F.sum("n").over(before) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy("host")).alias("total"))
    return ranged.join(sizes, ["host", "part"]).withColumn("pos", F.col("before") + F.col("place")).drop("part", "place", "before")


def _block(levels: int) -> Column:
    return F.shiftright("pos", levels).alias("block")


def roots(nodes: DataFrame, levels: int) -> DataFrame:
    """host, pos, total, digest of the tree above: the root of each block."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        total = table.column("total")[0].as_py()
        row = [x.encode() for x in table.sort_by("pos").column("digest").to_pylist()]
        for _ in range(depth(total, levels)):
            row = [join(row[i], row[i + 1] if i + 1 < len(row) else None) for i in range(0, len(row), 2)]
        return pa.table({"host": [key[0].as_py()], "pos": [key[1].as_py()], "total": [-(-total >> levels)], "digest": [row[0].decode()]}, schema)

    schema = pa.schema([("host", pa.string()), ("pos", pa.int64()), ("total", pa.int64()), ("digest", pa.string())])
    return nodes.select("host", _block(levels), "pos", "total", "digest").groupBy("host", "block").applyInArrow(run, "host string, pos long, total long, digest string")


def paths(nodes: DataFrame, above: DataFrame, levels: int) -> DataFrame:
    """nodes' columns and path, up to where the paths of the tree above (host, pos, path) end."""
    names = nodes.columns

    def run(table: pa.Table, upper: pa.Table) -> pa.Table:
        table = table.select(names).sort_by("pos")
        if not len(table):
            return pa.table({**{c: table.column(c) for c in names}, "path": pa.array([], pa.list_(pa.string()))})
        height, rest = depth(table.column("total")[0].as_py(), levels), upper.column("path")[0].as_py()
        out = []
        for i, siblings in enumerate(traverse([x.encode() for x in table.column("digest").to_pylist()], height)):
            own = ["" if s is None else ("L" if i >> h & 1 else "R") + s.decode() for h, s in enumerate(siblings)]
            out.append(own + rest)
        return table.append_column("path", pa.array(out, pa.list_(pa.string())))

    schema = StructType([*nodes.schema.fields, StructField("path", ArrayType(StringType()))])
    left = nodes.select("*", _block(levels)).groupBy("host", "block")
    return left.cogroup(above.select("host", F.col("pos").alias("block"), "path").groupBy("host", "block")).applyInArrow(run, schema)


def trees(nodes: DataFrame, levels: int) -> tuple[list[DataFrame], DataFrame]:
    """The sequences from the leaves up that have more than a node in some host, and the last one: one node a host."""
    most, tiers = nodes.agg(F.max("total")).first()[0] or 0, []
    while most > 1:
        tiers.append(nodes)
        nodes = common.spool(roots(nodes, levels), "merkle-roots")
        most = -(-most >> levels)
    return tiers, nodes


def descend(tiers: list[DataFrame], above: DataFrame, levels: int) -> DataFrame:
    """Paths of the lowest sequence; above: host, pos 0 and path of each host's top node."""
    for i, nodes in reversed(list(enumerate(tiers))):
        above = paths(nodes, above, levels)
        if i:
            above = common.spool(above, "merkle-paths")
    return above


def manifest(documents: DataFrame, key: str = "doc_id", group: str = "lang", fields: Sequence[str] = FIELDS, levels: int = LEVELS, also: dict[str, Column] | None = None) -> DataFrame:
    """key, leaf, group, pos, path, subroot, root of every row, and the columns in ``also``."""
    also = also or {}
    host = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))  # in the order of group, null first
    leaves = documents.select(host.alias("host"), F.col(key).alias("key"), leaf_digest([F.col(c) for c in fields]).alias("digest"), *(c.alias(f"also_{n}") for n, c in also.items()))
    leaves = common.spool(leaves.withColumn("row", F.monotonically_increasing_id()), "merkle-leaves")
    nodes = common.spool(placed(leaves, ["host", "key", "digest", "row"]).drop("row"), "merkle-nodes")
    tiers, tops = trees(nodes, levels)
    subroots = placed(tops.select(F.lit("").alias("host"), F.col("host").alias("of"), "digest"), ["host", "of"])
    upper, top = trees(common.spool(subroots, "merkle-subroots"), levels)
    found = top.first()
    root = found["digest"] if found else None
    if upper:
        ends = descend(upper, top.select("host", "pos", F.array().cast("array<string>").alias("path")), levels)
        ends = common.spool(ends.select(F.col("of").alias("host"), F.col("digest").alias("subroot"), "path"), "merkle-ends")
    else:
        ends = tops.select("host", F.col("digest").alias("subroot"), F.array().cast("array<string>").alias("path"))
    start = ends.select("host", F.lit(0).cast("long").alias("pos"), "path")
    if tiers:
        out = descend(tiers, start, levels)
    else:  # a single leaf each
        out = nodes.join(start.drop("pos"), "host")
    out = out.join(ends.select("host", "subroot"), "host")
    shown = F.when(F.col("host") != "", F.substring("host", 2, 1 << 30)).alias(group)
    return out.select(F.col("key").alias(key), F.col("digest").alias("leaf"), shown, "pos", "path", "subroot", F.lit(root).cast("string").alias("root"), *(F.col(f"also_{n}").alias(n) for n in also))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = common.table(spark, sf_dir, "documents")
    more = (F.col("n_chars").cast("decimal(38,0)") + 1).cast("decimal(38,0)")
    forged = leaf_digest([more if c == "n_chars" else F.col(c) for c in FIELDS])
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % EVERY == 0
    rows = manifest(documents, also={"given": F.when(hit, forged)})
    rows = rows.withColumn("folded_root", fold(F.coalesce("given", "leaf"), F.col("path")))
    return rows.select("doc_id", "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def oracle(table: str = "documents", every: int = EVERY) -> str:
    """The same in DuckDB SQL: all nodes by level, siblings by their places."""
    part = lambda x: f"coalesce(strlen({x}::VARCHAR) || ':' || {x}::VARCHAR, '-')"
    leaf = lambda n: "sha256(" + " || ".join(part(n if c == "n_chars" else c) for c in FIELDS) + ")"
    shift = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END)"
    codes = "list_transform(string_split(doc_id::VARCHAR, ''), lambda d: ascii(d)::UBIGINT)"
    crc = f"xor(list_reduce(list_prepend(4294967295::UBIGINT, {codes}), lambda c, b: {shift}), 4294967295::UBIGINT)"
    tree = lambda name, leaves: f"""{name} AS (
  SELECT host, 0 AS level, pos, digest, count(*) OVER (PARTITION BY host) AS n FROM {leaves}
  UNION ALL
  SELECT host, level + 1, pos // 2, sha256(digest || coalesce(after, '')), (n + 1) // 2
  FROM (SELECT *, lead(digest) OVER (PARTITION BY host ORDER BY pos) AS after FROM {name} WHERE n > 1) WHERE pos % 2 = 0
)"""  # noqa: E731
    path = lambda name, leaves, nodes: f"""{name} AS (
  SELECT l.r, list(CASE WHEN s.digest IS NULL THEN '' WHEN (l.pos >> v.level) % 2 = 1 THEN 'L' || s.digest ELSE 'R' || s.digest END ORDER BY v.level) AS path
  FROM {leaves} l JOIN (SELECT DISTINCT host, level FROM {nodes} WHERE n > 1) v ON v.host = l.host
  LEFT JOIN {nodes} s ON s.host = l.host AND s.level = v.level AND s.pos = xor(l.pos >> v.level, 1) GROUP BY l.r
)"""  # noqa: E731
    return f"""
WITH RECURSIVE rows AS MATERIALIZED (
  SELECT row_number() OVER () AS r, coalesce('=' || lang, '') AS host, doc_id, {leaf("n_chars")} AS digest,
    CASE WHEN {crc} % {every} = 0 THEN {leaf("(n_chars::HUGEINT + 1)")} END AS given FROM {table}
), leaves AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY host ORDER BY doc_id NULLS FIRST, digest, r) - 1 AS pos FROM rows),
{tree("nodes", "leaves")},
tops AS MATERIALIZED (SELECT host AS r, '' AS host, digest, row_number() OVER (ORDER BY host) - 1 AS pos FROM nodes WHERE n = 1),
{tree("upper_nodes", "tops")},
{path("own", "leaves", "nodes")},
{path("shared", "tops", "upper_nodes")},
full_paths AS (
  SELECT l.doc_id, l.digest AS leaf, l.given, t.digest AS subroot, (SELECT digest FROM upper_nodes WHERE n = 1) AS root,
    list_concat(coalesce(own.path, []::VARCHAR[]), coalesce(shared.path, []::VARCHAR[])) AS path
  FROM leaves l LEFT JOIN own ON own.r = l.r JOIN tops t ON t.r = l.host LEFT JOIN shared ON shared.r = l.host
), folded AS (
  SELECT *, list_reduce(list_prepend(coalesce(given, leaf), path), lambda a, x:
    sha256(CASE WHEN x[1] = 'L' THEN x[2:] ELSE '' END || a || CASE WHEN x[1] = 'R' THEN x[2:] ELSE '' END)) AS folded_root FROM full_paths
)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda x: x[2:]), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM folded
"""


ORACLE_SQL = oracle()
