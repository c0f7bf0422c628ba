r"""Personal data, and the terms that reveal it.

Base spans (email, ip, card, phone) come from patterns, each in one pass that stays linear on any text. The method then
asks which words give an entity away. Terms within ``near`` words of an entity in ``support`` different texts are asked about; for
these it counts, over the whole corpus, the texts with entity e, with term t, and with both wherever they stand, and takes

    disclosure = PMI(t; e) / IC(e) = log(n_te N / (n_t n_e)) / log(N / n_e)

the share of the entity's information that the term carries (1: whoever sees the term knows the entity). Terms at
``generalise`` or more become "<term>", at ``remove`` or more they go.
A disclosing term is found wherever it stands in a text that holds its entity, near it or not.

A term is a word without its edge punctuation and in lower case, that has a letter and two characters or more; words that
touch a base span are none. Only terms that stand near some entity are counted over all documents: a bit map of fixed size
tells the counting tasks which words may matter, and the exact counts are joined afterwards. All four counts are of
different texts: a second bit map tells which texts may have copies, and the terms of these are counted by text. Pairs are counted
in the same way, by a bit map of pairs. The occurrences of disclosing terms are found the same way: a bit map in the task, an exact join after it.

Nulls and ties: a null text is empty; rows with the same doc_id and text are the same text, and get the same spans. Equal
spans of two kinds stay both, in the order of kinds. An empty table gives an empty result. Other columns are ignored, or
passed through by ``sanitised``.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone", "term")
NEAR, SUPPORT, GENERALISE, REMOVE, BITS = 6, 3, 0.8, 0.95, 1 << 22

# The base kinds.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
NUMBERS = re.compile(r"[0-9][0-9 .-]*")  # holds any ip and card, and ends before what neither has
IP = re.compile(r"[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: What every base span has: an @, a + before a digit, or seven digits, dots, spaces and hyphens that begin and end with a digit.
MAY_HOLD = r"@|\+[0-9]|[0-9][0-9. -]{5}[0-9]"
EDGE = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local part, @ and domain. The local part is the whole run before an @, back to the last match."""
    done, before, at = 0, 0, text.find("@")
    while at >= 0:
        run = text[max(done, before) : at]
        start = at - (len(run) - len(run.rstrip(LOCAL)))
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        before = at + 1
        at = text.find("@", max(before, done))


def ips(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """In a run of digits, dots, spaces and hyphens: every sequence of digits and dots is tried once."""
    for part in re.compile(r"[0-9.]+").finditer(text, start, end):
        if part[0].count(".") >= 3:
            at = part.start()
            while (m := _next_ip(text, at, part.end())) is not None:
                if all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in m[0].split(".")):
                    yield m.start(), m.end()
                at = m.end()


def _next_ip(text: str, at: int, end: int):
    """The leftmost match starts at the first digit of a run of digits: other digits of it have the same sequel."""
    while at < end:
        if text[at] == ".":
            at += 1
            continue
        if m := IP.match(text, at, end):
            return m
        dot = text.find(".", at, end)
        if dot < 0:
            return None
        at = dot + 1
    return None


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end), by start, then kind."""
    found = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    for run in NUMBERS.finditer(text):
        start, end = run.span()
        if end - start < 7:
            continue
        found += [(s, 1, e) for s, e in ips(text, start, end)]
        if end - start >= 14:
            for m in CARD.finditer(text, start, end):
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    found.append((m.start(), 2, m.end()))
    at = text.find("+")
    while at >= 0:
        m = PHONE.match(text, at)
        if m and 10 <= sum(map(str.isdigit, m[0])) <= 15:
            found.append((at, 3, m.end()))
        at = text.find("+", m.end() if m else at + 1)
    return sorted(found)


def term_of(word: str) -> str:
    """A word as a term: lower case, without punctuation at its edges; empty if it is none."""
    term = word.strip(EDGE).lower()
    return term if len(term) >= 2 and any(map(str.isalpha, term)) else ""


def signed_hash(value: str) -> int:
    import xxhash

    x = xxhash.xxh64_intdigest(value)
    return x - (1 << 64) if x >> 63 else x


def entity_of(text: str, start: int, number: int, end: int) -> int:
    value = text[start:end]
    value = value.lower() if number == 0 else value if number == 1 else re.sub("[^0-9]", "", value)
    return signed_hash(f"{KINDS[number]}:{value}")


def free_words(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(start, end) of the words that touch no span. One sweep over both, which are in order of their starts."""
    out, k, reached = [], 0, 0
    for m in WORD.finditer(text):
        a, b = m.span()
        while k < len(spans) and spans[k][0] < b:
            reached = max(reached, spans[k][2])
            k += 1
        if reached <= a:
            out.append((a, b))
    return out


def term_span(text: str, start: int, end: int) -> tuple[int, int]:
    """Of a word without its edge punctuation."""
    word = text[start:end]
    start += len(word) - len(word.lstrip(EDGE))
    return start, start + len(word.strip(EDGE))


def neighbours(text: str, spans: list[tuple[int, int, int]], near: int = NEAR) -> set[tuple[int, int]]:
    """(entity, term) of the terms among the ``near`` free words before and after each span: linear in words and spans."""
    words, out = free_words(text, spans), set()
    starts, ends = [w[0] for w in words], [w[1] for w in words]
    terms = [term_of(text[a:b]) for a, b in words]
    hashes = [signed_hash(t) if t else None for t in terms]
    for start, number, end in spans:
        entity = entity_of(text, start, number, end)
        before, after = bisect_right(ends, start), bisect_left(starts, end)
        out |= {(entity, h) for h in hashes[max(0, before - near) : before] + hashes[after : after + near] if h is not None}
    return out


def find(documents: DataFrame) -> DataFrame:
    """doc_id, key (of the text), spans: array of (start, number, kind, end), entities, near: array of (e, t)."""
    common.small_batches(documents.sparkSession)
    rows = documents.select("doc_id", common.text_key().alias("key"), "text")
    schema = f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, key long, spans array<struct<start:int,number:int,kind:string,end:int>>, entities array<bigint>, near array<struct<e:bigint,t:bigint>>"
    span = pa.struct([("start", pa.int32()), ("number", pa.int32()), ("kind", pa.string()), ("end", pa.int32())])
    by = pa.struct([("e", pa.int64()), ("t", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, entities, near = [], [], []
            for text in batch.column("text").to_pylist():
                found = base_spans(text) if text else []
                spans.append([{"start": s, "number": k, "kind": KINDS[k], "end": e} for s, k, e in found])
                entities.append(list({entity_of(text, *x) for x in found}))
                near.append([{"e": e, "t": t} for e, t in neighbours(text, found)] if found else [])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(spans, pa.list_(span)), pa.array(entities, pa.list_(pa.int64())), pa.array(near, pa.list_(by))], ["doc_id", "key", "spans", "entities", "near"])

    return rows.mapInArrow(run, schema)


def term_counts(documents: DataFrame, chosen: bytes, copied: bytes, bits: int = BITS) -> DataFrame:
    """t and n: how many different texts have the term, for terms whose bit is set. copied: bits of the texts with copies, whose
    terms are sent in one row each and counted once for each text."""
    sent = documents.sparkSession.sparkContext.broadcast((chosen, copied))  # 2 bits / 8 bytes, whatever the input
    kinds = [pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int64()]
    names = ["key", "terms", "t", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_set, is_copied = (np.unpackbits(np.frombuffer(x, np.uint8), bitorder="little").view(bool) for x in sent.value)
        known: dict[bytes, int | None] = {}  # raw word -> term hash, None for what does not count
        counts: dict[int, int] = {}
        for batch in batches:
            keys = batch.column("key").to_pylist()
            by_text: dict[int, list[int]] = {}
            for key, text in zip(keys, batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                words = set((text or b"").split())
                for word in [w for w in words if w not in known]:
                    term = term_of(word.decode("utf-8", "replace"))
                    h = signed_hash(term) if term else None
                    known[word] = h if h is not None and is_set[h & (bits - 1)] else None
                terms = set(map(known.__getitem__, words)) - {None}
                if is_copied[key & (bits - 1)]:
                    by_text[key] = list(terms)
                else:
                    for h in terms:
                        counts[h] = counts.get(h, 0) + 1
            if by_text:
                yield made([list(by_text), list(by_text.values()), [None] * len(by_text), [None] * len(by_text)])
            if len(known) > 400_000:
                known.clear()
            if len(counts) > 200_000:
                yield flushed(counts)
                counts = {}
        if counts:
            yield flushed(counts)

    def made(columns: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    def flushed(counts: dict[int, int]) -> pa.RecordBatch:
        return made([[None] * len(counts), [None] * len(counts), list(counts), list(counts.values())])

    counted = common.spool(documents.select(common.text_key().alias("key"), "text").mapInArrow(run, "key long, terms array<bigint>, t long, n long"), "pii-term-counts")
    once = counted.where("key is not null").groupBy("key").agg(F.first("terms").alias("terms")).select(F.explode("terms").alias("t"), F.lit(1).cast("long").alias("n"))
    return counted.where("key is null").select("t", "n").unionAll(once).groupBy("t").agg(F.sum("n").alias("n"))


def pair_bit(e, t, bits: int = BITS):
    """The place of a pair in a bit map; for numbers or arrays of 64 bits."""
    with np.errstate(over="ignore"):
        x = np.uint64(e) * np.uint64(0x9E3779B97F4A7C15) ^ np.asarray(t, np.int64).view(np.uint64)
        return ((x * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(32)) & np.uint64(bits - 1)


def pair_map(pairs: DataFrame, bits: int = BITS) -> bytes:
    """bits / 8 bytes: which (e, t) may count. The places are made by tasks; at most ``bits`` of them come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            e, t = (batch.column(c).to_numpy().astype(np.int64) for c in ("e", "t"))
            yield pa.RecordBatch.from_arrays([pa.array(pair_bit(e.view(np.uint64), t, bits).astype(np.int64))], ["b"])

    at = pairs.select("e", "t").mapInArrow(run, "b long").distinct().toArrow().column("b").to_numpy()
    out = np.zeros(bits, bool)
    out[at] = True
    return np.packbits(out, bitorder="little").tobytes()


def pair_counts(documents: DataFrame, chosen: bytes, copied: bytes, bits: int = BITS) -> DataFrame:
    """e, t and n: in how many different texts both stand, for pairs whose bit is set."""
    sent = documents.sparkSession.sparkContext.broadcast((chosen, copied))  # 2 bits / 8 bytes, whatever the input
    both = pa.struct([("e", pa.int64()), ("t", pa.int64())])
    kinds = [pa.int64(), pa.list_(both), pa.int64(), pa.int64(), pa.int64()]
    names = ["key", "pairs", "e", "t", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_set, is_copied = (np.unpackbits(np.frombuffer(x, np.uint8), bitorder="little").view(bool) for x in sent.value)
        known: dict[str, int | None] = {}
        counts: dict[tuple[int, int], int] = {}
        for batch in batches:
            by_text: dict[int, list[dict]] = {}
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if key in by_text or not (entities := {entity_of(text, *x) for x in base_spans(text)}):
                    continue
                words = set(WORD.findall(text))
                for word in [w for w in words if w not in known]:
                    known[word] = signed_hash(term) if (term := term_of(word)) else None
                terms = np.array(list(set(map(known.__getitem__, words)) - {None}), np.int64)
                found = [(e, t) for e in entities for t in terms[is_set[pair_bit(np.int64(e).view(np.uint64), terms, bits)]].tolist()]
                if is_copied[key & (bits - 1)]:
                    by_text[key] = [{"e": e, "t": t} for e, t in found]
                else:
                    for x in found:
                        counts[x] = counts.get(x, 0) + 1
            if by_text:
                yield made([list(by_text), list(by_text.values()), *[[None] * len(by_text)] * 3])
            if len(known) > 400_000:
                known.clear()
            if len(counts) > 200_000:
                yield flushed(counts)
                counts = {}
        if counts:
            yield flushed(counts)

    def made(columns: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    def flushed(counts: dict[tuple[int, int], int]) -> pa.RecordBatch:
        return made([*[[None] * len(counts)] * 2, [e for e, _ in counts], [t for _, t in counts], list(counts.values())])

    rows = documents.where(F.rlike("text", F.lit(MAY_HOLD))).select(common.text_key().alias("key"), "text")
    counted = common.spool(rows.mapInArrow(run, "key long, pairs array<struct<e:bigint,t:bigint>>, e long, t long, n long"), "pii-pair-counts")
    once = counted.where("key is not null").groupBy("key").agg(F.first("pairs").alias("pairs")).select(F.explode("pairs").alias("x")).select("x.e", "x.t", F.lit(1).cast("long").alias("n"))
    return counted.where("key is null").select("e", "t", "n").unionAll(once).groupBy("e", "t").agg(F.sum("n").alias("n"))


def occurrences(documents: DataFrame, chosen: bytes, bits: int = BITS) -> DataFrame:
    """doc_id, key, t, start and end of every term whose bit is set, in the texts that may hold an entity."""
    sent = documents.sparkSession.sparkContext.broadcast(chosen)  # bits / 8 bytes, whatever the input
    names = ["doc_id", "key", "t", "start", "end"]
    schema = f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, key long, t long, start int, end int"
    rows = documents.where(F.rlike("text", F.lit(MAY_HOLD))).select("doc_id", common.text_key().alias("key"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_set = np.unpackbits(np.frombuffer(sent.value, np.uint8), bitorder="little").view(bool)
        known: dict[str, int | None] = {}
        for batch in batches:
            out: list[tuple] = []
            docs, keys = batch.column("doc_id"), batch.column("key").to_pylist()
            at: list[int] = []
            for i, text in enumerate(batch.column("text").to_pylist()):
                spans = base_spans(text)
                for a, b in free_words(text, spans) if spans else ():
                    word = text[a:b]
                    if word not in known:
                        h = signed_hash(term) if (term := term_of(word)) else None
                        known[word] = h if h is not None and is_set[h & (bits - 1)] else None
                    if (h := known[word]) is not None:
                        at.append(i)
                        out.append((keys[i], h, *term_span(text, a, b)))
            if len(known) > 400_000:
                known.clear()
            key, t, start, end = np.array(out, np.int64).reshape(-1, 4).T
            yield pa.RecordBatch.from_arrays([docs.take(pa.array(at, pa.int64())), pa.array(key), pa.array(t), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))], names)

    return rows.mapInArrow(run, schema)


def bit_map(terms: DataFrame, bits: int = BITS) -> bytes:
    """At most ``bits`` numbers come to the driver, and bits / 8 bytes go out."""
    at = terms.select(F.col("t").bitwiseAND(F.lit(bits - 1)).alias("b")).distinct().toArrow().column("b").to_numpy()
    out = np.zeros(bits, bool)
    out[at] = True
    return np.packbits(out, bitorder="little").tobytes()


def disclosures(documents: DataFrame, found: DataFrame, support: int = SUPPORT, generalise: float = GENERALISE) -> DataFrame:
    """e, t and disclosure, of pairs at the threshold or above. found: the written result of find()."""
    # copies of a text say nothing new: texts are counted, not rows
    near = found.select("key", F.explode("near").alias("x")).select("key", "x.e", "x.t").distinct()
    asked = common.spool(near.groupBy("e", "t").agg(F.count("*").alias("n")).where(F.col("n") >= support).select("e", "t"), "pii-asked")
    n_e = found.select("key", F.explode("entities").alias("e")).distinct().groupBy("e").agg(F.count("*").alias("n_e"))
    n_e = common.spool(n_e.where(F.col("n_e") >= support), "pii-entities")
    copies = common.spool(found.groupBy("key").agg(F.count("*").alias("n")), "pii-texts")
    total = copies.count()
    copied = bit_map(copies.where("n > 1").select(F.col("key").alias("t")))
    pairs = common.spool(pair_counts(documents, pair_map(asked), copied).join(asked, ["e", "t"], "left_semi").withColumnRenamed("n", "n_te"), "pii-pairs")
    n_t = common.spool(term_counts(documents, bit_map(asked), copied), "pii-terms").withColumnRenamed("n", "n_t")
    score = F.try_divide(F.log(F.col("n_te") * float(total) / (F.col("n_t") * F.col("n_e").cast("double"))), F.log(F.lit(float(total)) / F.col("n_e")))
    return pairs.join(n_e, "e").join(n_t, "t").select("e", "t", F.least(F.lit(1.0), score).alias("disclosure")).where(F.col("disclosure") >= generalise)


def detect(documents: DataFrame, support: int = SUPPORT, generalise: float = GENERALISE) -> DataFrame:
    """doc_id, key, base and all: arrays of (start, number, kind, end), and disclosed: array of (start, end, disclosure)."""
    found = common.spool(find(documents), "pii-found")
    told = common.spool(disclosures(documents, found, support, generalise), "pii-disclosures")
    seen = common.spool(occurrences(documents, bit_map(told)), "pii-occurrences")
    # each different (text, term) looks for the entities that the term discloses, and these for themselves in the text
    asked = seen.select("key", "t").distinct().join(told, "t")
    holds = found.select("key", F.explode("entities").alias("e")).distinct()
    given = common.spool(asked.join(holds, ["key", "e"]).groupBy("key", "t").agg(F.max("disclosure").alias("disclosure")), "pii-given")
    hits = seen.distinct().join(given, ["key", "t"]).select("doc_id", "key", "start", "end", "disclosure")
    terms = common.spool(hits.groupBy("doc_id", "key").agg(F.collect_list(F.struct("start", "end", "disclosure")).alias("disclosed")), "pii-terms-found")
    out = found.join(terms.withColumnRenamed("doc_id", "d").withColumnRenamed("key", "k"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")), "left")
    disclosed = F.coalesce("disclosed", F.expr("cast(array() as array<struct<start:int,end:int,disclosure:double>>)"))
    more = F.transform("disclosed", lambda x: F.struct(x["start"].alias("start"), F.lit(len(KINDS) - 1).alias("number"), F.lit("term").alias("kind"), x["end"].alias("end")))
    out = out.select("doc_id", "key", F.col("spans").alias("base"), F.array_sort(disclosed).alias("disclosed"))
    return out.select("doc_id", "key", "base", F.array_sort(F.concat("base", more)).alias("all"), "disclosed")


def sanitised(documents: DataFrame, remove: float = REMOVE, **options) -> DataFrame:
    """The documents, with <kind> in place of personal data and of generalised terms, and without removed terms."""
    names = documents.columns
    key, all_spans, all_told = (common.unused(names, x) for x in ("_key", "_spans", "_told"))
    spans = detect(documents, **options).where(F.size("all") > 0).dropDuplicates(["doc_id", "key"])
    spans = common.spool(spans.select(F.col("doc_id").alias("_d"), F.col("key").alias("_k"), F.col("all").alias("_all"), F.col("disclosed").alias("_disclosed")), "pii-spans")
    rows = documents.withColumn(key, common.text_key())
    same = rows["doc_id"].eqNullSafe(spans["_d"]) & (rows[key] == spans["_k"])
    rows = rows.join(spans, same, "left").select(*(rows[c] for c in names), spans["_all"].alias(all_spans), spans["_disclosed"].alias(all_told))

    def cleaned(text: str, spans: list[dict], told: list[dict]) -> str:
        out, at, gone = [], 0, {x["start"] for x in told if x["disclosure"] >= remove}
        for x in spans:
            if x["start"] < at:  # overlaps what is replaced already
                at = max(at, x["end"])
                continue
            out += [text[at : x["start"]], "" if x["kind"] == "term" and x["start"] in gone else f"<{x['kind']}>"]
            at = x["end"]
        return "".join([*out, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c) for c in names]
            at = names.index("text")
            texts = [cleaned(t, s, d) if s else t for t, s, d in zip(columns[at].to_pylist(), batch.column(all_spans).to_pylist(), batch.column(all_told).to_pylist(), strict=True)]
            columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(run, documents.schema)


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = detect(common.table(spark, sf_dir, "documents"))
    count = lambda i: F.size(F.filter("base", lambda x: x["number"] == i)).cast("long")
    return rows.select("doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:4])], F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("all")).alias("spans"))
