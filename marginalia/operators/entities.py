"""Named entities: an averaged perceptron over words, shapes and their neighbours, decoded by Viterbi.

Labels come from rules (titles before persons, endings of organisations and laws, months, currencies, quoted titles): they mark a bounded
sample of texts, from which a tagger learns what else such spans look like. Its features are hashed, so a model has a fixed
size; sentences are decoded together, position by position, in Arrow batches. Every text is tagged whole: what is cut at
``LONGEST`` words is a sentence, never a text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SAMPLE, MOST_BYTES, PLAIN, EPOCHS, LEAST_STEPS, STEP, BUCKETS, LONGEST = 2000, 20_000, 8000, 6, 1200, 32, 1 << 17, 100
TOKEN = re.compile(r"[^\W_]+(?:[’'.&-][^\W_]+)*|[^\w\s]|_")
ENDS = frozenset(".!?")

#: A capitalised word, and a run of them.
NAME = r"[^\W\d_a-zà-öø-ÿ][\w’'&-]*"
RUN = rf"{NAME}(?: {NAME})*"
MONTHS = "January February March April May June July August September October November December".split()
#: What marks a span, in order of precedence; the group named s is the span.
RULES: tuple[tuple[str, str], ...] = (
    ("WORK", r"[\"“](?P<s>[^\W\d_a-z][^\"”\n]{3,80})[\"”]"),
    ("LAW", rf"\b(?P<s>(?:{NAME} )*(?:License|Licence|Act|Treaty|Convention|Constitution|Amendment)(?:,? [Vv]ersion [0-9.]*[0-9]| [0-9.]*[0-9])?|CC BY(?:-[A-Z]{{2}})*(?: [0-9.]*[0-9])?)(?!\w)"),
    ("ORG", rf"\b(?P<s>(?:{NAME} )+(?:University|College|Institute|School|Company|Corporation|Inc|Ltd|Foundation|Agency|Ministry|Council|Committee|Association|Union|Bank|Party|Press))\b"),
    ("PERSON", rf"\b(?:Mr|Mrs|Ms|Dr|Prof|Professor|President|Sir|Saint|Judge|Captain)\.? (?P<s>{RUN})"),
    ("DATE", rf"\b(?P<s>(?:[0-3]?[0-9] )?(?:{'|'.join(MONTHS)})(?: [0-3]?[0-9](?:st|nd|rd|th)?)?(?:,? [12][0-9]{{3}})?|[12][0-9]{{3}}-[01][0-9]-[0-3][0-9])\b"),
    ("MONEY", r"(?P<s>[$€£] ?[0-9]+(?:[,.][0-9]+)*)"),
    ("PERCENT", r"(?P<s>[0-9]+(?:[.,][0-9]+)*(?: ?%| percent\b))"),
    ("PLACE", rf"(?<=[a-z,;] )(?:in|near|from|at|to|of) (?P<s>(?!(?:{'|'.join(MONTHS)})\b){RUN})"),
    ("CARDINAL", r"(?<![\w.:/@+-])(?P<s>[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+(?:\.[0-9]+)?)(?![.:/@-]?[\w%])"),
)
_RULES = [(label, re.compile(p)) for label, p in RULES]
LABELS = [label for label, _ in RULES]
TAGS = ["O", *(f"{p}-{label}" for label in LABELS for p in "BI")]
T = len(TAGS)
#: An inside needs a beginning or an inside of its label before it; the last row is the start of a sentence.
ALLOWED = np.array([[to % 2 == 1 or to == 0 or frm in (to, to - 1) for to in range(T)] for frm in [*range(T), -9]])


def rule_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, label), by start, without overlaps: earlier rules win."""
    taken, out = np.zeros(len(text) + 1, bool), []
    for label, pattern in _RULES:
        for m in pattern.finditer(text):
            a, b = m.span("s")
            if not taken[a:b].any():
                taken[a:b] = True
                out.append((a, b, label))
    return sorted(out)


def sentences(text: str) -> list[list[tuple[int, int]]]:
    """Spans of the tokens of each sentence: it ends with . ! ? or a line, or after LONGEST tokens."""
    out, now, last = [], [], 0
    for m in TOKEN.finditer(text):
        a, b = m.span()
        if now and (len(now) >= LONGEST or "\n" in text[last:a]):
            out.append(now)
            now = []
        now.append((a, b))
        last = b
        if m[0] in ENDS:
            out.append(now)
            now = []
    return [*out, now] if now else out


def shape(word: str) -> str:
    """X for capitals, x for letters, 9 for digits, others as they are; of a run two are kept."""
    kinds = "".join("X" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else c for c in word[:24])
    return re.sub(r"(.)\1{2,}", r"\1\1", kinds)


MIX = np.uint64(0x9E3779B97F4A7C15)
SALTS = (np.arange(1, 14, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


HELD = 1 << 17  # words whose hashes a worker keeps
_hashes: dict[str, tuple[int, ...]] = {}


def hashes(words: Sequence[str]) -> np.ndarray:
    """(word, 4): hashes of each different word, of its shape, head and tail; of the edge in the last row. Words come again in other texts: they are kept."""
    from pandas.util import hash_array

    hashed = lambda values: hash_array(np.array([*values, "<edge>"], object), categorize=False)
    if len(_hashes) > HELD:
        _hashes.clear()
    new = [w for w in words if w not in _hashes]
    found = np.stack([hashed(w.lower() for w in new), hashed(map(shape, new)), hashed(w[:3] for w in new), hashed(w[-3:].lower() for w in new)], 1)
    _hashes.update(zip(new, map(tuple, found.tolist()), strict=False))
    return np.concatenate([np.array([_hashes[w] for w in words], np.uint64).reshape(-1, 4), found[-1:]])


def features(words: Sequence[Sequence[str]]) -> np.ndarray:
    """(token, feature) buckets of all tokens of some sentences, one after the other."""
    lengths = np.array([len(s) for s in words], np.int64)
    flat = [w for s in words for w in s]
    known = {w: i for i, w in enumerate(dict.fromkeys(flat))}
    unique = list(known)
    low, form, head, tail = hashes(unique).T
    n, edge = len(flat), len(unique)
    # two edges around every sentence, so that a neighbour of its first word is no word of the one before
    place = np.arange(n) + 2 * np.repeat(np.arange(len(lengths)), lengths) + 2
    row = np.full(n + 2 * len(lengths) + 2, edge, np.int64)
    row[place] = np.fromiter(map(known.__getitem__, flat), np.int64, n)
    at = lambda x, k: x[row[place + k]]
    columns = [at(low, 0), at(form, 0), at(head, 0), at(tail, 0), at(low, -1), at(low, 1), at(form, -1), at(form, 1), at(form, -1) * MIX ^ at(form, 0), at(form, 0) * MIX ^ at(form, 1), at(low, -1) * MIX ^ at(form, 0), at(low, -2) * MIX ^ at(form, 0), np.zeros(n, np.uint64)]
    mixed = [(c ^ s) * MIX for c, s in zip(columns, SALTS, strict=True)]
    return np.stack([(m >> np.uint64(40)) % np.uint64(BUCKETS) for m in mixed], 1).astype(np.int32)


def viterbi(emissions: np.ndarray, moves: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
    """The best tags of each sentence. emissions: all tokens by tag; moves: from (the last row: the start) by to. Sentences are decoded side by
    side, longest first, so that at each position the ones still running stand in front."""
    starts = np.append(0, np.cumsum(lengths))[:-1]
    order = np.argsort(-lengths, kind="stable")
    moves = np.where(ALLOWED, moves, -1e9)
    n = int(lengths.max(initial=0))
    best, back = np.zeros((len(lengths), T)), np.zeros((n, len(lengths), T), np.int8)
    for i in range(n):
        running = order[: int((lengths[order] > i).sum())]
        here = emissions[starts[running] + i]
        if i == 0:
            best[: len(running)] = moves[T] + here
            continue
        paths = best[: len(running), :, None] + moves[None, :T]
        back[i, : len(running)] = top = paths.argmax(1)
        best[: len(running)] = np.take_along_axis(paths, top[:, None], 1)[:, 0] + here
    # back from the last position: a sentence joins in where it ends
    now, tags, ranked = best.argmax(1), np.zeros((len(lengths), n), np.int64), lengths[order]
    for i in range(n - 1, -1, -1):
        running = int((ranked > i).sum())
        tags[:running, i] = now[:running]
        if i:
            now[:running] = back[i, np.arange(running), now[:running]]
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(lengths)
    for k, s in enumerate(order.tolist()):
        out[s] = tags[k, : lengths[s]]
    return out


@dataclass
class Tagger:
    weights: np.ndarray  # (BUCKETS, T)
    moves: np.ndarray  # (T + 1, T)

    def decode(self, words: Sequence[Sequence[str]]) -> list[np.ndarray]:
        f = features(words)
        emissions = self.weights[f].sum(1) if len(f) else np.zeros((0, T))
        return viterbi(emissions, self.moves, np.array([len(s) for s in words], np.int64))

    def spans(self, texts: Sequence[str | None], together: int = 1024) -> list[list[tuple[int, int, str]]]:
        """Of each text (start, end, label). Sentences are decoded so many together."""
        cut = [(i, s) for i, t in enumerate(texts) if t for s in sentences(t)]
        out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
        for a in range(0, len(cut), together):
            part = cut[a : a + together]
            for (i, s), tags in zip(part, self.decode([[texts[i][x:y] for x, y in s] for i, s in part]), strict=True):
                out[i] += joined(s, tags)
        return out


def joined(places: Sequence[tuple[int, int]], tags: np.ndarray) -> list[tuple[int, int, str]]:
    out = []
    for (a, b), t in zip(places, tags.tolist(), strict=True):
        if t and t % 2:
            out.append([a, b, LABELS[(t - 1) // 2]])
        elif t:
            out[-1][1] = b
    return [tuple(x) for x in out]


def gold(text: str, cut: Sequence[Sequence[tuple[int, int]]]) -> list[np.ndarray]:
    """Tags of the tokens by the rules' spans."""
    spans, out, k = rule_spans(text), [], 0
    for sentence in cut:
        tags, within = np.zeros(len(sentence), np.int64), -1
        for i, (a, b) in enumerate(sentence):
            while k < len(spans) and spans[k][1] <= a:
                k += 1
            if k < len(spans) and a >= spans[k][0] and b <= spans[k][1]:
                tags[i] = 1 + 2 * LABELS.index(spans[k][2]) + (within == k)
                within = k
            else:
                within = -1
        out.append(tags)
    return out


def train(words: Sequence[Sequence[str]], tags: Sequence[np.ndarray], epochs: int = EPOCHS, seed: int = 3) -> Tagger:
    """Averaged perceptron: where the best tags are wrong, the right ones gain and they lose; the mean of all states counts."""
    rng = np.random.default_rng(seed)
    w, m = np.zeros((BUCKETS, T), np.float32), np.zeros((T + 1, T))
    wa, ma, time = np.zeros_like(w), np.zeros_like(m), 1
    epochs = max(epochs, min(30, -(-LEAST_STEPS * STEP // max(1, len(words)))))  # more often through a small sample
    for epoch in range(epochs):
        order, wrong = rng.permutation(len(words)), 0
        for a in range(0, len(order), STEP):
            mine = order[a : a + STEP]
            f = features([words[i] for i in mine])
            lengths = np.array([len(words[i]) for i in mine], np.int64)
            found = np.concatenate(viterbi(w[f].sum(1), m, lengths))
            right = np.concatenate([tags[i] for i in mine])
            starts = np.append(0, np.cumsum(lengths))[:-1]
            before = lambda x: np.where(np.isin(np.arange(len(x)), starts), T, np.append(T, x[:-1]))
            off = np.flatnonzero(found != right)
            wrong += len(off)
            step = 1.0 / max(1, len(off)) ** 0.5  # many errors at once don't overshoot
            for t, sign in ((right, step), (found, -step)):
                at = (f[off].ravel(), np.repeat(t[off], f.shape[1]))
                np.add.at(w, at, sign)
                np.add.at(wa, at, sign * time)
                np.add.at(m, (before(t), t), sign)
                np.add.at(ma, (before(t), t), sign * time)
            time += 1
        if not wrong:  # nor would there be in the epochs left
            time += (epochs - 1 - epoch) * -(-len(words) // STEP)
            break
    return Tagger((w - wa / time).astype(np.float32), m - ma / time)


def fit(rows: DataFrame, key: str, text: str = "text", sample: int = SAMPLE, most_bytes: int = MOST_BYTES) -> Tagger:
    """A tagger from the ``sample`` rows with the smallest hashes of key, of at most ``most_bytes`` bytes each (both parameters). Of
    sentences without a span at most ``PLAIN`` are learned from, evenly."""
    some = rows.where(F.col(text).isNotNull() & (F.octet_length(text) <= most_bytes)).select(F.xxhash64(F.col(key)).alias("place"), F.col(text).alias("text"))
    texts = [r["text"] for r in some.orderBy("place", "text").limit(sample).collect()]
    return learn(texts)


def learn(texts: Sequence[str]) -> Tagger:
    with_span, without = [], []
    for t in texts:
        cut = sentences(t)
        for s, tags in zip(cut, gold(t, cut), strict=True):
            (with_span if tags.any() else without).append(([t[a:b] for a, b in s], tags))
    step = max(1, len(without) // PLAIN)
    chosen = with_span + without[::step]
    return train([w for w, _ in chosen], [t for _, t in chosen]) if with_span else Tagger(np.zeros((BUCKETS, T), np.float32), np.zeros((T + 1, T)))


def tag(rows: DataFrame, tagger: Tagger, key: str, text: str = "text") -> DataFrame:
    """key, start, end, label, entity: a row for each span of every text. A null text has none."""
    sent = rows.sparkSession.sparkContext.broadcast(tagger)  # a fixed size
    kind = rows.schema[key].dataType.simpleString()
    names = ["key", "start", "end", "label", "entity"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 200):
                part = batch.slice(a, 200)
                texts = part.column("text").to_pylist()
                found = [(i, *s) for i, spans in enumerate(sent.value.spans(texts)) for s in spans]
                keys = part.column("key").take(pa.array([i for i, *_ in found], pa.int64()))
                ends = [pa.array([f[k] for f in found], pa.int32()) for k in (1, 2)]
                entity = pa.array([texts[i][x:y] for i, x, y, _ in found], pa.string())
                yield pa.RecordBatch.from_arrays([keys, *ends, pa.array([f[3] for f in found], pa.string()), entity], names)

    return rows.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, start int, end int, label string, entity string").withColumnRenamed("key", key)


def top(tagged: DataFrame, k: int = 10) -> DataFrame:
    """label, place, entity and n: the k commonest entities of each label, ties by entity. Counts are made before anything is ranked."""
    n = tagged.groupBy("label", "entity").agg(F.count("*").alias("n"))
    ranked = n.withColumn("place", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("n"), "entity")))
    return ranked.where(F.col("place") <= k).select("label", "place", "entity", "n")
