"""Valence of a text: words with a strength, changed by what stands around them, as one score between -1 and 1.

The rules are those of the published valence-aware rules for short texts: words before a word strengthen or weaken it, the less
the farther away; a negation within three words turns it; capitals among small letters add to it; after "but" words count more, before it
less; exclamation and question marks add to the whole. Texts are read in Arrow batches, each once, in one pass over its words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Strengths of the published rules.
BOOST, CAPITALS, NEGATED, ALPHA = 0.293, 0.733, -0.74, 15.0
FADING = (1.0, 0.95, 0.9)
BEFORE_BUT, AFTER_BUT, MARK, MOST_MARKS, QUESTION, MOST_QUESTION = 0.5, 1.5, 0.292, 4, 0.18, 0.96

STRONGER = frozenset("absolutely amazingly awfully completely considerably deeply enormously entirely especially exceptionally extremely fully greatly highly hugely incredibly intensely majorly more most particularly purely quite really remarkably so substantially thoroughly totally tremendously unbelievably unusually utterly very".split())
WEAKER = frozenset("almost barely hardly less little marginally occasionally partly scarcely slightly somewhat".split())
NEGATIONS = frozenset("cannot never neither nobody none nor not nothing nowhere without hardly rarely seldom despite ain't aren't can't couldn't didn't doesn't don't hadn't hasn't haven't isn't shouldn't wasn't weren't won't wouldn't".split())

#: A small table of this library's own: any mapping of words to strengths (-4 to 4) can stand in for it.
VALENCE: Mapping[str, float] = {
    w: v
    for v, words in (
        (3.0, "adore amazing awesome brilliant delighted ecstatic excellent fantastic incredible love loved magnificent outstanding perfect thrilled wonderful"),
        (2.0, "beautiful caring cheerful confident enjoy enjoyed excited friend glad good grateful great happy helpful hope hopeful impressive inspired inspiring joy kind pleased proud respect strong success support supported thank thanks trust win"),
        (1.2, "agree calm clear comfortable easy fair fine fresh interested interesting like liked nice okay positive safe useful welcome well"),
        (-1.2, "bored boring confused confusing difficult doubt dull hard lost odd poor problem sorry strange tired unclear uncertain weak"),
        (-2.0, "afraid alone angry annoyed anxious bad blame crying damage disappointed enemy fail failed failure fear hurt lonely mad pain sad scared shame stress stressed struggle struggling suffer suffering unfair upset worried worry wrong"),
        (-3.0, "abuse awful cruel dead death despair destroy devastated disgusting dread evil furious genocide hate hated hopeless horrible killed murder panic racism suicide terrible terrified terror violence war worthless"),
    )
    for w in words.split()
}
_EDGE = "\"“”‘’()[]{}<>*_.,;:!?-"


def scores(text: str | None, valence: Mapping[str, float] = VALENCE) -> tuple[float, float, float, float]:
    """compound, and the shares of positive, negative and neutral words; all neutral for a text without words."""
    raw = [w for w in ((x.strip(_EDGE) or x) for x in (text or "").split()) if len(w) > 1]
    low = [w.lower() for w in raw]
    loud = [w.isupper() for w in raw]
    mixed = any(loud) and not all(loud)
    found = []
    for i, w in enumerate(low):
        v = valence.get(w, 0.0)
        if w in STRONGER or w in WEAKER or not v:
            found.append(0.0)
            continue
        sign = 1.0 if v > 0 else -1.0
        if mixed and loud[i]:
            v += sign * CAPITALS
        for back, fade in enumerate(FADING, 1):
            if i < back:
                break
            before = low[i - back]
            if before not in valence:
                step = BOOST if before in STRONGER else -BOOST if before in WEAKER else 0.0
                if step and mixed and loud[i - back]:
                    step += math.copysign(CAPITALS, step)
                v += sign * step * fade
                if before in NEGATIONS or before.endswith("n't"):
                    v *= NEGATED
        found.append(v)
    if "but" in low:
        at = low.index("but")
        found = [v * (BEFORE_BUT if i < at else AFTER_BUT if i > at else 1.0) for i, v in enumerate(found)]
    if not found:
        return 0.0, 0.0, 0.0, 1.0 if text else 0.0
    questions = (text or "").count("?")
    marks = min((text or "").count("!"), MOST_MARKS) * MARK + (0.0 if questions < 2 else questions * QUESTION if questions <= 3 else MOST_QUESTION)
    total = sum(found)
    total += math.copysign(marks, total) if total else 0.0
    up, down = sum(v + 1 for v in found if v > 0), sum(v - 1 for v in found if v < 0)
    if up > abs(down):
        up += marks
    elif up < abs(down):
        down -= marks
    neutral = sum(1 for v in found if v == 0)
    everything = up - down + neutral
    return max(-1.0, min(1.0, total / math.sqrt(total * total + ALPHA))), up / everything, -down / everything, neutral / everything


def valence_scores(rows: DataFrame, key: str, text: str = "text", valence: Mapping[str, float] = VALENCE) -> DataFrame:
    """key, compound, positive, negative, neutral of every text. A null or empty text has no share of anything."""
    kind = rows.schema[key].dataType.simpleString()
    sent = rows.sparkSession.sparkContext.broadcast(dict(valence))  # a table of words: some thousands

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scores(t, sent.value) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), *(pa.array([f[i] for f in found], pa.float64()) for i in range(4))], ["key", *NAMES])

    out = rows.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, " + ", ".join(f"{c} double" for c in NAMES))
    return out.withColumnRenamed("key", key)


NAMES = ("compound", "positive", "negative", "neutral")

#: What makes a bad feeling one about the topic: analysis, connection, evidence, reflection and structural critique.
ENGAGED = r"(?i)\b(because|therefore|however|for example|evidence|according to|connects? to|reminds? me|i (?:think|realized?|learned|wonder)|oppress|coloni|systemic|inequal|injustice|exploit|marginal)"


def registers(rows: DataFrame, key: str, kind: str, text: str = "text", valence: Mapping[str, float] = VALENCE, engaged: str = ENGAGED) -> DataFrame:
    """key and register of every text by its valence (see ``sentiment.register``); uploads without a word are left out. Keys are unique. kind: how it was handed in."""
    from marginalia.functions import text as T
    from marginalia.operators import sentiment
    from marginalia.sources import io

    t = F.coalesce(F.col(text), F.lit(""))
    facts = rows.select(F.col(key).alias("key"), T.word_count(F.col(text)).alias("n_words"), F.rlike(t, F.lit(engaged)).alias("engaged"), F.lower(t).contains("my ").alias("mine"), F.col(kind).alias("kind"))
    felt = valence_scores(rows.select(F.col(key).alias("key"), F.col(text).alias("text")), "key", "text", valence)
    both = io.join_same(facts.where(~sentiment.no_text(F.col("n_words"), F.col("kind"))), felt, ["key"])
    register = sentiment.register(*map(F.col, ("n_words", "compound", "positive", "neutral", "engaged", "mine")))
    return both.select(F.col("key").alias(key), register.alias("register"), "compound")
