"""Benchmark decontamination by template canonicalisation.

Words are lower-cased, their edge punctuation goes, and numbers (also spelled ones), units and names become typed
placeholders (<num>, <unit>, <name>); neighbouring numbers, or names, are one. So a benchmark item and a copy of it with
other numbers, names or units have one template. Windows of ``size`` template words are hashed; the windows of documents
and items meet in a hash join. Each text is read in two ways:

* typed: a capital inside a sentence makes a name (Boston, McDonald, O'Brien, iPhone), and so do up to ``MOST_CAPITALS`` words in a row of
  capitals only (ESA, JAXA); more of these are no names but a text in capitals. This is what finds "New York" for "Boston".
* caseless: names of the item are known by its capitals, and its windows leave them open, for whatever word stands there;
  documents are hashed once for each pattern of open words that some item has. This finds copies in lower or upper case.
  Every place also has a window with nothing open, so a verbatim copy in any case is found however many names it has. Windows
  with more than ``MOST_OPEN`` open words say too little: there the closed window stands alone.

A document matches an item if, in one way of reading, the windows that they share cover ``coverage`` of the item and their
slots are consistent: each value of the item stands for one value of the document and the other way round, in
``consistent`` of the slots at least. Windows belong together if their shifts (document position - item position) are
neighbours, at most ``size`` apart, so words put in or left out don't part them.

Items with fewer than ``least`` template words are too short for this: a document has such an item if all of its words, the
numbers and names included, are a whole sentence or line (or several) of the document.

The items' windows never go to executors whole. A bit map of fixed size (``bits``) drops most document windows in the
reading task; it lets too many pass, never too few, and what passes is joined exactly, whatever the number of items.

Nulls and ties: null texts, and items without a word, match nothing; items with ``least`` to ``size`` words are one window
of their own length. Null or repeated ids stand for themselves: repeated documents each match,
repeated items give one row. Empty tables give an empty result. Other columns are ignored by ``contaminated`` and
passed through by ``decontaminate``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

SIZE, LEAST, COVERAGE, CONSISTENT, BITS, MOST_OPEN, MOST_CAPITALS = 8, 5, 0.8, 0.9, 1 << 22, 3, 3

#: Units of measure: symbols and words, and those that take the prefixes of the metric system.
PLAIN_UNITS = "inch inches foot feet yard yards mile miles mph kph ounce ounces oz pound pounds lb lbs ton tons tonnes second seconds sec minute minutes min hour hours hr hrs day days week weeks month months year years gallon gallons cent cents dollar dollars euro euros usd eur percent degree degrees celsius fahrenheit kelvin"
PREFIXES = "kilo mega giga tera centi milli micro nano".split()
METRIC = "meter metre gram litre liter watt volt joule ampere hertz byte pascal newton".split()
SYMBOLS = [p + u for p in ("", "k", "m", "c", "g") for u in ("m", "g", "l", "w", "v", "j", "hz", "b", "s")]
UNITS = frozenset([*PLAIN_UNITS.split(), *(x for x in SYMBOLS if len(x) > 1), "m", "g", "l", *(p + u + s for p in ["", *PREFIXES] for u in METRIC for s in ("", "s"))])
NUMBER_WORDS = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
    "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen".split()
)
NUMBER_BYTES, UNIT_BYTES = frozenset(x.encode() for x in NUMBER_WORDS), frozenset(x.encode() for x in UNITS)
EDGE = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_NUMBER = re.compile(rb"[$+-]*[0-9][0-9.,:/]*(?:st|nd|rd|th|%)?")
_MIXED = re.compile(rb"([0-9][0-9.,]*)([a-z]+)")
PLAIN, NUM, UNIT, NAME = range(4)
TYPED, CASELESS, WORDS = range(3)


def kind_of(word: bytes, inside: bool) -> int:
    """inside: not the first word of a sentence, where a capital says nothing."""
    bare = word.strip(EDGE)
    low = bare.lower()
    if _NUMBER.fullmatch(bare):
        return NUM
    if m := _MIXED.fullmatch(low):
        return NUM if m[2].decode() in UNITS else PLAIN
    text = low.decode("utf-8", "replace")
    if all(x in NUMBER_WORDS for x in text.split("-")):
        return NUM
    if text in UNITS:
        return UNIT
    text = bare.decode("utf-8", "replace")
    return NAME if inside and has_capital(text) else PLAIN


def has_capital(text: str) -> bool:
    """A capital among other letters: what is in capitals throughout is judged with its neighbours."""
    return len(text) > 1 and text[0].isalpha() and not text.isupper() and any(map(str.isupper, text))


def is_capitals(text: str) -> bool:
    """Two letters or more, all of them capitals; digits, dots and hyphens may stand between them."""
    return len(text) > 1 and text.isupper() and sum(map(str.isalpha, text)) > 1


class Numbers(dict):
    """A number for each different word, given when it is first asked for; new holds those that were."""

    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


#: Stands between lines: a byte that no UTF-8 text holds. It has no code in any reading.
LINE = b"\xff"


class Templates:
    """Template codes of words by their numbers: inside a sentence, at its start, without placeholders; and whether a word ends one."""

    SLOTS = {NUM: "<num>", UNIT: "<unit>", NAME: "<name>"}

    @staticmethod
    def code_of(kind: int) -> int:
        """The low bit of a slot is set."""
        import xxhash

        return xxhash.xxh64_intdigest(Templates.SLOTS[kind]) | 1

    def __init__(self, limit: int = 1_600_000):
        self.slot_codes = {kind: self.code_of(kind) for kind in self.SLOTS}
        self.limit, self.numbers = limit, Numbers()
        self.first, self.inner, self.words = (np.zeros(limit, np.uint64) for _ in range(3))
        self.last, self.capitals = np.zeros(limit, bool), np.zeros(limit, bool)

    def _learn(self, words: list[bytes]) -> None:
        """words: the last ones that got a number."""
        from xxhash import xxh64_intdigest as digest

        n = len(self.numbers) - len(words)
        while len(self.numbers) > len(self.first):  # one text with more words than the limit
            self.first, self.inner, self.words, self.last, self.capitals = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.inner, self.words, self.last, self.capitals))
        codes_of, name = self.slot_codes, self.slot_codes[NAME]
        first, inner, last, plain, capitals = [], [], [], [], []
        for word in words:
            if word.isalnum():
                last.append(False)
                bare = word
            else:
                last.append(word.rstrip(b"\"')]}")[-1:] in (b".", b"!", b"?"))
                bare = word.strip(EDGE) if word != LINE else b""
            if bare.isalpha():  # ASCII letters, as most words are: a number or a name only by the lists and its capital
                low = bare.lower()
                plain.append(digest(low) & ~1)
                code = codes_of[NUM] if low in NUMBER_BYTES else codes_of[UNIT] if low in UNIT_BYTES else plain[-1]
                first.append(code)
                loud = bare.isupper() and len(bare) > 1 and code == plain[-1]
                inner.append(name if low != bare and code == plain[-1] and len(bare) > 1 and not loud else code)
                capitals.append(loud)
                continue
            # 0 is left for words of punctuation only
            plain.append(digest(bare.decode("utf-8", "replace").casefold()) & ~1 if bare else 0)
            for inside, codes in ((False, first), (True, inner)):
                codes.append(codes_of.get(kind_of(word, inside), plain[-1]) if bare else 0)
            capitals.append(bool(bare) and first[-1] == plain[-1] and is_capitals(bare.decode("utf-8", "replace")))
        for have, new in ((self.first, first), (self.inner, inner), (self.words, plain), (self.last, last), (self.capitals, capitals)):
            have[n : n + len(words)] = new

    def look_up(self, words: list[bytes]) -> np.ndarray:
        if len(self.numbers) > self.limit // 2:
            self.numbers = Numbers()
        out = np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))
        if self.numbers.new:
            self._learn(self.numbers.new)
            self.numbers.new = []
        return out


def templates() -> Templates:
    """One for each Python worker."""
    return common.held("templates", Templates)


SLOT_NUM, SLOT_NAME = (np.uint64(Templates.code_of(k)) for k in (NUM, NAME))


class Reading:
    """Texts, one after the other, as template words in one of the three ways: their codes, the words that each of them stands for, and
    where each text begins (bounds; one more at the end)."""

    def __init__(self, words: list[bytes], codes: np.ndarray, breaks: np.ndarray, starts: np.ndarray):
        at = np.flatnonzero(codes)
        codes, self.breaks = codes[at], breaks[at]
        run = np.zeros(len(at), bool)
        for code in (SLOT_NUM, SLOT_NAME):
            slot = codes == code
            run[1:] |= slot[1:] & slot[:-1]
        first = np.searchsorted(at, starts)  # of each text
        run[first[first < len(at)]] = False
        self.all_words, self.at, self.begins = words, at, np.flatnonzero(~run)
        self.codes = codes[self.begins]
        self.bounds = np.append(np.searchsorted(self.begins, first), len(self.codes))

    def value(self, i: int) -> str:
        end = self.begins[i + 1] if i + 1 < len(self.begins) else len(self.at)
        return " ".join(self.all_words[j].strip(EDGE).decode("utf-8", "replace").casefold() for j in self.at[self.begins[i] : end])

    def values(self, start: int, size: int, open_: int) -> list[str | None]:
        """What stands in the slots and open words of a window, by place; None elsewhere."""
        return [self.value(start + j) if open_ >> j & 1 or self.codes[start + j] & np.uint64(1) else None for j in range(size)]

    def inside(self, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Of the windows that begin at these places those that lie in one text, and its number."""
        text = np.searchsorted(self.bounds, at, "right") - 1
        good = at + size <= self.bounds[text + 1]
        return at[good], text[good]


def readings(texts: list[bytes], amid: bool = False, literal: bool = True) -> tuple[Reading, Reading, Reading | None, np.ndarray]:
    """Typed, caseless, and by words alone; and where the caseless one has names. amid: as if each text stood within a sentence."""
    words, starts = [], []
    for text in texts:
        starts.append(len(words))
        words += text.replace(b"\n", b" \xff ").split()
    known = templates()
    numbers, begins, starts = known.look_up(words), np.zeros(len(words) + 1, bool), np.array(starts, np.int64)
    begins[1:-1] |= known.last[numbers[:-1]]
    begins[1:] |= numbers == known.numbers[LINE] if LINE in known.numbers else False
    opening = np.zeros(len(words) + 1, bool)
    opening[starts] = True
    begins |= opening
    breaks, opening = begins[:-1].copy(), opening[:-1]
    begins = begins[:-1] & ~opening if amid else begins[:-1]
    first, inner = known.first[numbers], known.inner[numbers]
    seen = np.where(begins, first, inner)
    loud = known.capitals[numbers]
    if loud.any():  # a few in a row are names, at the start of a sentence too
        run = np.cumsum(np.append(False, loud[1:] != loud[:-1]) | opening)
        seen[loud & (np.bincount(run)[run] <= MOST_CAPITALS)] = SLOT_NAME
    typed = Reading(words, seen, breaks, starts)
    caseless = Reading(words, first, breaks, starts)
    is_name = (seen == SLOT_NAME)[caseless.at[caseless.begins]]
    return typed, caseless, Reading(words, known.words[numbers], breaks, starts) if literal else None, is_name


_MIX = np.uint64(0x9E3779B97F4A7C15)
_FACTORS = np.random.default_rng(7).integers(0, 2**64, 64, np.uint64) | np.uint64(1)


def window_hashes(codes: np.ndarray, size: int, open_: int = 0, reading: int = TYPED) -> np.ndarray:
    """Of every size codes in a row, without the open ones (bits): signed 64 bits."""
    return next(all_hashes(codes, [(size, open_)], reading))[2]


def all_hashes(codes: np.ndarray, patterns: list[tuple[int, int]], reading: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """window_hashes of several patterns (size, open): what an open word would add is taken off the sum of all."""
    sums: dict[int, np.ndarray] = {}
    for size, open_ in patterns:
        n = max(len(codes) - size + 1, 0)
        if size not in sums:
            sums[size] = np.zeros(n, np.uint64)
            for k in range(size):
                sums[size] += codes[k : k + n] * _FACTORS[k]
        out = sums[size] + np.uint64((reading << 40) + (size << 20) + open_)
        for k in range(size):
            if open_ >> k & 1:
                out -= codes[k : k + n] * _FACTORS[k]
        out = (out ^ (out >> np.uint64(31))) * _MIX
        yield size, open_, (out ^ (out >> np.uint64(29))).view(np.int64)


def sentence_hash(codes: np.ndarray) -> int:
    """Of all the words of a short item, or of a run of sentences."""
    import xxhash

    return int(np.array([xxhash.xxh64_intdigest(codes.tobytes(), WORDS)], np.uint64).view(np.int64)[0])


def item_windows(items: DataFrame, size: int = SIZE, least: int = LEAST, most_open: int = MOST_OPEN) -> DataFrame:
    """item_id, reading, at, n_words, k (window length), open, h, slots."""
    names = ["item_id", "reading", "at", "n_words", "k", "open", "h", "slots"]
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string())]
    schema = f"item_id {items.schema['item_id'].dataType.simpleString()}, reading int, at int, n_words int, k int, open int, h long, slots array<string>"

    def windows(text: bytes) -> Iterator[tuple]:
        for amid in (False, True):  # a document may quote the item after words of its own
            typed, caseless, words, is_name = readings([text], amid)
            n = len(typed.codes)
            if n < least:
                if len(words.codes) and not amid:
                    k = len(words.codes)
                    yield WORDS, 0, k, k, 0, sentence_hash(words.codes), [None] * k
                continue
            for i, h in enumerate(window_hashes(typed.codes, min(size, n)).tolist()):
                yield TYPED, i, n, min(size, n), 0, h, typed.values(i, min(size, n), 0)
            if not amid:
                n = len(caseless.codes)
                k = min(size, n)
                opens = np.zeros(max(n - k + 1, 0), np.int64)
                for j in range(k):
                    opens |= is_name[j : j + len(opens)].astype(np.int64) << j
                for i, h in enumerate(window_hashes(caseless.codes, k, 0, CASELESS).tolist()):
                    yield CASELESS, i, n, k, 0, h, caseless.values(i, k, 0)
                for open_ in np.unique(opens[opens > 0]).tolist():
                    if open_.bit_count() <= min(most_open, k // 2):
                        hashes = window_hashes(caseless.codes, k, open_, CASELESS)
                        for i in np.flatnonzero(opens == open_).tolist():
                            yield CASELESS, i, n, k, open_, int(hashes[i]), caseless.values(i, k, open_)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                rows += [(item, *w) for w in {(w[0], w[1], w[5]): w for w in windows(text or b"")}.values()]
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=pa.schema([(names[0], batch.schema.field("item_id").type), *zip(names[1:], kinds, strict=True)]))

    return items.select("item_id", "text").mapInArrow(run, schema)


def parts(texts: list[bytes | None], size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs of texts with about ``size`` bytes, which are read at once."""
    a = n = 0
    for i, text in enumerate(texts):
        n += len(text or b"")
        if n >= size or i + 1 == len(texts):
            yield a, i + 1
            a, n = i + 1, 0


def document_windows(documents: DataFrame, patterns: list[tuple[int, int, int]], chosen: bytes, bits: int = BITS) -> DataFrame:
    """doc_id, key, at, h, ours of the windows whose bit is set in chosen. patterns: reading, k and open of the items' windows."""
    common.small_batches(documents.sparkSession)
    rows = documents.select("doc_id", common.text_key().alias("key"), F.col("text").cast("binary").alias("text"))
    names = ["doc_id", "key", "at", "h", "ours"]
    schema = f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, key long, at int, h long, ours array<string>"
    sent = documents.sparkSession.sparkContext.broadcast(chosen)  # bits / 8 bytes, whatever the number of items
    by_reading = {r: [(k, o) for x, k, o in patterns if x == r] for r in (TYPED, CASELESS)}
    short = sorted(k for x, k, _ in patterns if x == WORDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_set = np.unpackbits(np.frombuffer(sent.value, np.uint8), bitorder="little").view(bool)
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.string())]
        for batch in batches:
            out = []
            docs, keys, texts = (batch.column(c).to_pylist() for c in ("doc_id", "key", "text"))
            for a, b in parts(texts):
                typed, caseless, words, _ = readings([t or b"" for t in texts[a:b]], literal=bool(short))
                for number, reading in ((TYPED, typed), (CASELESS, caseless)):
                    for k, open_, hashes in all_hashes(reading.codes, by_reading[number], number):
                        hits, owners = reading.inside(np.flatnonzero(is_set[hashes & (bits - 1)]), k)
                        for i, t in zip(hits.tolist(), owners.tolist(), strict=True):
                            out.append((docs[a + t], keys[a + t], i - int(reading.bounds[t]), int(hashes[i]), reading.values(i, k, open_)))
                if short:
                    is_edge = np.append(words.breaks[words.begins], True)
                    is_edge[words.bounds] = True
                    edges = np.flatnonzero(is_edge)
                    for k in short:
                        hits, owners = words.inside(edges[edges + k <= len(words.codes)], k)
                        for i, t in zip(hits.tolist(), owners.tolist(), strict=True):
                            if is_edge[i + k] and is_set[(h := sentence_hash(words.codes[i : i + k])) & (bits - 1)]:
                                out.append((docs[a + t], keys[a + t], i - int(words.bounds[t]), h, [None] * k))
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], schema=pa.schema([("doc_id", batch.schema.field("doc_id").type), *zip(names[1:], kinds, strict=True)]))

    return rows.mapInArrow(run, schema)


def bit_map(windows: DataFrame, bits: int = BITS) -> bytes:
    """A bit for each hash, modulo bits: at most ``bits`` numbers come to the driver, and bits / 8 bytes go out."""
    at = windows.select((F.col("h").bitwiseAND(F.lit(bits - 1))).alias("b")).distinct().toArrow().column("b").to_numpy()
    out = np.zeros(bits, bool)
    out[at] = True
    return np.packbits(out, bitorder="little").tobytes()


def contaminated(documents: DataFrame, items: DataFrame, size: int = SIZE, least: int = LEAST, coverage: float = COVERAGE, consistent: float = CONSISTENT) -> DataFrame:
    """doc_id, key (of the text), item_id, n_covered and n_item_words (template words), n_slots, n_consistent."""
    # repeated items are one
    wanted = common.spool(item_windows(items, size, least).distinct(), "item-windows")
    patterns = sorted(tuple(r) for r in wanted.select("reading", "k", "open").distinct().collect())  # of windows: a bound set by size; and lengths of short items
    found = document_windows(documents, patterns, bit_map(wanted))
    mine = wanted.select("item_id", "reading", F.col("at").alias("item_at"), "n_words", "k", "h", F.col("slots").alias("theirs"))
    met = common.spool(found.join(mine, "h").withColumn("shift", F.col("at") - F.col("item_at")), "window-matches")
    # an alignment: one document, one item, one way of reading, and shifts that are neighbours
    pair = ["doc_id", "key", "item_id", "reading"]
    shifts = met.select(*pair, "shift").distinct()
    ordered = Window.partitionBy(*pair).orderBy("shift")
    apart = F.coalesce(F.col("shift") - F.lag("shift").over(ordered) > size, F.lit(False))
    shifts = shifts.withColumn("apart", apart.cast("int")).withColumn("group", F.sum("apart").over(ordered)).drop("apart")
    left, right = met.alias("m"), shifts.alias("s")
    met = left.join(right, [F.col(f"m.{c}").eqNullSafe(F.col(f"s.{c}")) for c in [*pair, "shift"]]).select("m.*", "s.group")
    alignment = [*pair, "group"]
    words = met.select(*alignment, "n_words", F.posexplode(F.arrays_zip("theirs", "ours")).alias("j", "slot"), "item_at")
    # each word of the item once
    words = words.groupBy(*alignment, (F.col("item_at") + F.col("j")).alias("word")).agg(F.max("n_words").alias("n_words"), F.min("slot.theirs").alias("theirs"), F.min("slot.ours").alias("ours"))
    votes = words.groupBy(*alignment, "theirs", "ours").agg(F.count("*").alias("n"), F.max("n_words").alias("n_words"))
    # of each value the commonest partner counts, both ways
    here = F.row_number().over(Window.partitionBy(*alignment, "theirs").orderBy(F.desc("n"), "ours"))
    there = F.row_number().over(Window.partitionBy(*alignment, "ours").orderBy(F.desc("n"), "theirs"))
    best = votes.withColumn("best", (here == 1) & (there == 1))
    slot = F.col("theirs").isNotNull()
    out = best.groupBy(*alignment).agg(
        F.sum("n").alias("n_covered"),
        F.max("n_words").alias("n_item_words"),
        F.coalesce(F.sum(F.when(slot, F.col("n"))), F.lit(0)).alias("n_slots"),
        F.coalesce(F.sum(F.when(slot & F.col("best"), F.col("n"))), F.lit(0)).alias("n_consistent"),
    )
    good = (F.col("n_covered") >= coverage * F.col("n_item_words")) & (F.col("n_consistent") >= consistent * F.col("n_slots"))
    return out.where(good).groupBy("doc_id", "key", "item_id").agg(F.max(F.struct("n_covered", "n_consistent", "n_slots", "n_item_words")).alias("m")).select("doc_id", "key", "item_id", "m.n_covered", "m.n_item_words", "m.n_slots", "m.n_consistent")


def decontaminate(documents: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents that match no item; columns as they came."""
    gone = contaminated(documents, items, **options).select(F.col("doc_id").alias("_d"), F.col("key").alias("_k")).distinct()
    gone = common.spool(gone, "contaminated")
    key = common.unused(documents.columns, "_key")
    rows = documents.withColumn(key, common.text_key())
    return rows.join(gone, rows["doc_id"].eqNullSafe(gone["_d"]) & (rows[key] == gone["_k"]), "left_anti").select(*(rows[c] for c in documents.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark")).drop("key")
