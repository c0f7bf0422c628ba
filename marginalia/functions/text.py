"""Column functions over texts. Everything stays on the JVM, but for the counts of words in ``gibberish_reason``."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words too common to count, for term statistics (English).
STOPWORDS = frozenset("the and that for was with this are from have has had not but you they his her she him its our who what when which will would there their been were can all".split())
#: Last words that leave a sentence open.
TRAILING = ("and", "but", "that", "because", "with", "or", "so", "when", "if", "the", "a", "an")
#: Phrases that say a text is unfinished.
UNFINISHED = ("i had more", "ran out of", "didn't finish", "will finish later", "more to say")
EDGE_PUNCTUATION = ".,!?;:'\"()-[]{}"


def strip_html(text: Column, into: str = " ") -> Column:
    """Tags become ``into``: a space keeps words apart, an empty string joins them."""
    return F.regexp_replace(text, "<[^>]+>", into)


def clean_text(text: Column) -> Column:
    """Entities decoded, tags out, white space collapsed."""
    for entity, plain in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return F.trim(F.regexp_replace(strip_html(text), "[ \t\n\r\f]+", " "))


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^ \t\n\r\f]+"), F.lit(0))


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^ \t\n\r\f]+")).cast("long")


def tokens(text: Column, stop: Iterable[str] = STOPWORDS) -> Column:
    """Lower-case runs of three letters a-z or more, without stop words; repeats stay."""
    found = F.regexp_extract_all(F.lower(F.coalesce(strip_html(text), F.lit(""))), F.lit("[a-z]{3,}"), F.lit(0))
    stop = sorted(stop)
    return F.filter(found, lambda t: ~t.isin(stop)) if stop else found


def sentences(text: Column) -> Column:
    """Pieces between sentence ends that have a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "[.!?]+"), lambda s: F.length(F.trim(s)) > 0)


def hits(text: Column, pattern: str) -> Column:
    return F.regexp_count(F.lower(F.coalesce(text, F.lit(""))), F.lit(pattern)).cast("long")


def whole_words(pattern: str) -> str:
    """The pattern where no letter, digit or underscore of any script goes on, case aside."""
    return rf"(?iu)(?<![\p{{L}}\p{{N}}_])(?:{pattern})(?![\p{{L}}\p{{N}}_])"


def excerpt(text: Column, pattern: str, around: int = 30) -> Column:
    """The first match, case aside, with ``around`` characters on each side; null without a match. Positions are of
    characters, whatever their script."""
    pattern = f"(?iu){pattern}"
    at = F.length(F.element_at(F.split(text, pattern, 2), 1)) + 1
    start = F.greatest(F.lit(1), at - around)
    long = F.length(F.regexp_extract(text, pattern, 0))
    return F.when(F.rlike(text, F.lit(pattern)), F.substring(text, start, at - start + long + around))


def truncation_signals(text: Column, n_words: Column, median_words: Column) -> Column:
    """Array of what speaks for a text that was cut off. Linear in the text."""
    end = F.substring_index(F.rtrim(F.translate(text, "\t\n\r\f", "    ")), " ", -1)
    last_three = F.right(F.rtrim(F.regexp_replace(F.right(text, F.lit(64)), "[ \t\n\r\f]+", " ")), F.lit(3))
    last = F.regexp_replace(F.lower(end), "[.,;:]+$", "")
    unfinished = F.rlike(text, F.lit("(?i)" + "|".join(p.replace(" ", r"[ \t\n\r\f]+") for p in UNFINISHED)))
    return F.array_compact(
        F.array(
            F.when(~F.rlike(last_three, F.lit(r"[.?!\"')\]]")), "no_terminal_punct"),
            F.when(last.isin(*TRAILING), "trailing_conjunction"),
            F.when(unfinished, "explicit_incomplete"),
            F.when((median_words > 0) & (n_words < median_words * 0.5), "below_median"),
        )
    )


def is_truncated(signals: Column) -> Column:
    has = lambda x: F.array_contains(signals, x)
    return has("explicit_incomplete") | (has("no_terminal_punct") & (has("trailing_conjunction") | has("below_median")))


#: What the gibberish rules go by.
PLACEHOLDERS = r"lorem\s+ipsum|dolor\s+sit\s+amet|consectetur\s+adipiscing"
KEY_ROWS = ("qwertyuiop", "asdfghjkl", "zxcvbnm")
VOWELS = "aeiouyáéíóúàèìòùäëïöü"
FOLDED_PUNCTUATION = ".,!?;:'\"()-"
LEAST_WORDS, KEY_RUN, MASHED, VOWELLESS, ONE_WORD, FEW_WORDS = 15, 5, 0.4, 0.5, 0.4, 0.12


def key_walk(length: int = KEY_RUN) -> str:
    """A pattern for ``length`` keys in a row, each the same as or next to the one before it."""
    def after(row: str, i: int, n: int) -> str:
        if n == 0:
            return ""
        near = row[max(0, i - 1) : i + 2]
        return "[" + near + "]" if n == 1 else "(?:" + "|".join(row[j] + after(row, j, n - 1) for j in range(max(0, i - 1), min(len(row), i + 2))) + ")"

    return "|".join(row[i] + after(row, i, length - 1) for row in KEY_ROWS for i in range(len(row)))


def gibberish_reason(rows: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key and reason why a text is no language: placeholder text, keyboard walks, words without vowels, or repetition; null
    if none. Texts under 15 words are not judged. Words are counted, and judged, once for each different one of a text, where the text is: nothing is shuffled."""
    kind = rows.schema[key].dataType.simpleString()
    names = [key, "placeholder", "n", "bare", "mashed", "vowelless", "most", "different"]
    word, walk, vowel = re.compile(r"[^ \t\n\r\f]+"), re.compile(key_walk()), re.compile(f"[{VOWELS}]")

    def counts(low: str | None) -> tuple[int, ...]:
        times, folded, bare, mashed, vowelless = Counter(word.findall(low or "")), Counter(), 0, 0, 0
        for w, n in times.items():
            folded[w.strip(FOLDED_PUNCTUATION)] += n
            b = w.strip(EDGE_PUNCTUATION)
            if len(b) >= 3:
                bare += n
                mashed += n if walk.search(b) else 0
                vowelless += 0 if vowel.search(b) else n
        return times.total(), bare, mashed, vowelless, max(folded.values(), default=0), len(folded)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([counts(t.as_py()) for t in batch.column(2)], np.int64).reshape(-1, 6)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(found[:, i]) for i in range(6))], names)

    sums = rows.select(key, F.rlike(text, F.lit("(?i)" + PLACEHOLDERS)).alias("placeholder"), F.lower(text)).mapInArrow(run, f"`{key}` {kind}, placeholder boolean, " + ", ".join(f"{c} long" for c in names[2:]))
    n, bare = F.col("n"), F.col("bare")
    reason = (
        F.when((n < LEAST_WORDS) | n.isNull(), F.lit(None))
        .when(F.col("placeholder"), "lorem_ipsum")
        .when((bare > 0) & (F.col("mashed") > MASHED * bare), "keyboard_mash")
        .when((bare > 10) & (F.col("vowelless") > VOWELLESS * bare), "keyboard_mash")
        .when((n > 20) & (F.col("most") > ONE_WORD * n), "repetition_spam")
        .when((n > 30) & (F.col("different") < FEW_WORDS * n), "repetition_spam")
    )
    return sums.select(key, reason.alias("reason"))


def iso_timestamp(text: Column) -> Column:
    """ISO 8601, with Z or an offset; null if it can't be read."""
    return F.try_to_timestamp(F.regexp_replace(text, "Z$", "+00:00"))


def head_and_tail(text: Column, head: int = 10, tail: int = 10) -> Column:
    """A short text as it is (its words, one space between), a long one by its first and last words."""
    w = words(text)
    first, last = F.array_join(F.slice(w, 1, head), " "), F.array_join(F.slice(w, F.greatest(F.size(w) - tail + 1, F.lit(1)), tail), " ")
    return F.when(F.size(w) <= head + tail, F.array_join(w, " ")).otherwise(F.concat(first, F.lit(" ... "), last))
