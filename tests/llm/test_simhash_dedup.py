import random
import re

import numpy as np
import xxhash

from marginalia.llm import simhash_dedup as sd

SCHEMA = "doc_id long, text string, fp string, component_id string"


def fp(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(values, ids, radius=3):
    root = list(range(len(values)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    values = np.array(values, np.uint64)
    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= radius):
            root[find(i)] = find(i + 1 + int(j))
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(d, least.get(find(i), d))
    return [least[find(i)] for i in range(len(values))]


def test_documents(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    values = [fp(t) for _, t in rows]
    want = {(i, f"{v:016x}", c) for (i, _), v, c in zip(rows, values, groups(values, [i for i, _ in rows]), strict=True)}
    assert {tuple(r) for r in sd.query(spark, sf).collect()} == want


def test_masks_cover_every_triple():
    masks = sd.covering_masks()
    assert len(masks) == 15 and all(any(not m >> i & 1 and not m >> j & 1 and not m >> k & 1 for m in masks) for i in range(64) for j in range(i) for k in range(j))
    assert all(28 <= m.bit_count() <= 36 for m in masks)


def test_dense_groups_in_small_blocks(spark):
    rng = random.Random(7)
    values = set()
    for centre in (rng.getrandbits(64) for _ in range(4)):
        for _ in range(300):
            values.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.choice((1, 2, 2, 5)))))
    values = sorted(values)
    nodes = spark.createDataFrame([(sd.signed(v),) for v in values], "fp long")
    roots = {r["node"]: r["root"] for r in sd.components(sd.links(nodes, block=50)).collect()}
    got = [roots.get(sd.signed(v), sd.signed(v)) for v in values]
    assert got == groups(values, [sd.signed(v) for v in values])


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7)], "a long, b long")
    roots = {r["node"]: r["root"] for r in sd.components(edges).collect()}
    assert all(roots.get(i, i) == 0 for i in range(201)) and roots[501] == 500


def test_edges(spark):
    rows = [(5, None), (3, ""), (4, " \n"), (1, "One"), (2, "one"), (None, "one"), (7, "a b c d " * 30_000), (8, "A B C D " * 30_000), (9, "É é"), (9, "É é"), (None, "quite alone here with many words")]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    got = sorted(((str(r["doc_id"]), r["component_id"]) for r in sd.near_duplicates(docs).collect()), key=str)
    assert got == sorted([("5", 3), ("3", 3), ("4", 3), ("1", 1), ("2", 1), ("None", 1), ("7", 7), ("8", 7), ("9", 9), ("9", 9), ("None", None)], key=str)
    kept = sd.deduplicate(docs)
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "3", "7", "9", "None"]
    assert sd.near_duplicates(docs.limit(0)).count() == 0


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def jaccard_groups(texts, ids):
    """Smallest id by brute force: pairs with 80 % or more of their 5-word shingles in common, joined."""
    sets, root, have = [shingles(t) for t in texts], list(range(len(texts))), {}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in enumerate(sets):
        seen = {}
        for w in s:
            for j in have.setdefault(w, []):
                seen[j] = seen.get(j, 0) + 1
            have[w].append(i)
        for j, n in seen.items():
            if 5 * n >= 4 * (len(s) + len(sets[j]) - n):
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(d, least.get(find(i), d))
    return [least[find(i)] for i in range(len(texts))]


def test_near_copies_by_jaccard(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    texts, passage = [], " ".join(word() for _ in range(40))
    for _ in range(60):
        base = [word() for _ in range(rng.choice((12, 60, 300)))]
        for _ in range(5):
            copy = list(base)
            for at in rng.sample(range(len(base)), rng.choice((0, 1, 1, 2, 5)) * len(base) // 100 + rng.choice((0, 1))):
                copy[at] = word()
            texts.append(" ".join(copy))
        texts.append(" ".join(base[: len(base) // 2]) + " " + passage)
    ids = list(range(len(texts)))
    want = jaccard_groups(texts, ids)
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in zip(ids, texts, strict=True)], SCHEMA)
    for block in (1024, 3):
        assert {r["doc_id"]: r["component_id"] for r in sd.near_duplicates(docs, block=block).collect()} == dict(zip(ids, want, strict=True))
    assert sorted(r["doc_id"] for r in sd.deduplicate(docs).collect()) == sorted(set(want))
    apart = {r["doc_id"]: r["component_id"] for r in sd.fingerprint_groups(docs).collect()}
    assert any(apart[i] != apart[c] for i, c in zip(ids, want, strict=True))  # what op10's radius does not join


def test_documents_by_jaccard(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf[:-3]}01/documents.parquet").collect()]
    ids, texts = zip(*rows, strict=True)
    got = {r["doc_id"]: r["component_id"] for r in sd.near_duplicates(spark.read.parquet(f"{sf[:-3]}01/documents.parquet")).collect()}
    assert got == dict(zip(ids, jaccard_groups(texts, ids), strict=True))
