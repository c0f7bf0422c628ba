"""URL filters: rules, and a character language-model ratio for what no rule decides.

Two variable-order Markov models, of accepted and of rejected URLs, give each character the probability interpolated
over all contexts of up to ``order`` characters that were seen ``least`` times (Witten-Bell weights: the more kinds of
characters followed a context, the more goes to the shorter one). The difference of the two log-likelihoods by
character is calibrated by a logistic curve on URLs kept out of training; above 0.5 a URL is allowed.

The models count every different URL that a rule decides, but a fifth by hash that is kept for calibration: contexts and what
followed them are summed by 64-bit hashes in Spark, so they grow with the input. What goes to executors does not: the
counts are folded into ``SLOTS`` numbers a class and table, where hashes that fall together add up. Calibration takes the ``sample`` kept URLs of each
class with the smallest hashes (a bounded sample). Every URL is judged, whole.

Nulls and ties: a null URL, or one without "://", has an empty host and path; a null one is scored as empty (difference 0).
If only one class has examples, its verdict holds for all that no rule decides; with none at all it is block. Repeated
rows are each judged. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

ORDER, LEAST, SAMPLE, SLOTS = 5, 2, 5000, 1 << 21
START, END, ALPHABET = 2, 3, 256

#: Host, path, verdict.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as host and path together, and its verdict."""
    rule = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


MIX = np.uint64(0x9E3779B97F4A7C15)


def characters(urls: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all urls, each between START and END, and where each url starts."""
    parts = [np.frombuffer(u.encode("utf-32-le", "replace"), "<u4") for u in urls]
    starts = np.cumsum([0, *(len(x) + 2 for x in parts)])
    out = np.full(starts[-1], START, np.uint64)
    for x, a, b in zip(parts, starts[:-1], starts[1:], strict=True):
        out[a + 1 : b - 1] = x
        out[b - 1] = END
    return out, starts[:-1]


def mixed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    x = (x ^ y) * MIX
    return x ^ (x >> np.uint64(29))


def contexts(chars: np.ndarray, starts: np.ndarray, order: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length of context, shortest first: the places of characters that have it, its hash, and with the character."""
    at = np.arange(len(chars))
    inside = at - np.repeat(starts, np.diff(np.append(starts, len(chars))))
    h = np.zeros(len(chars), np.uint64)
    for k in range(order + 1):
        places = np.flatnonzero(inside >= max(k, 1))
        if k:  # one character further back
            h[places] = mixed(h[places], chars[places - k] + np.uint64(k << 32))
        yield places, h[places], mixed(h[places] + np.uint64(1), chars[places] + np.uint64(1 << 40))


def counted(urls: DataFrame, order: int = ORDER, least: int = LEAST) -> DataFrame:
    """accepted, kind (0: context, 1: context and character), h, n and, of contexts, kinds. urls: text, accepted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            accepted = batch.column("accepted").to_numpy(zero_copy_only=False).astype(bool)
            texts = np.array(batch.column("text").to_pylist(), object)
            for yes in (True, False):
                if not len(mine := texts[accepted == yes].tolist()):
                    continue
                for _, context, pair in contexts(*characters(mine), order):
                    found, first, n = np.unique(pair, return_index=True, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), yes)), pa.array(context[first].view(np.int64)), pa.array(found.view(np.int64)), pa.array(n)], ["accepted", "context", "pair", "n"])

    pairs = urls.select("text", "accepted").mapInArrow(run, "accepted boolean, context long, pair long, n long").groupBy("accepted", "context", "pair").agg(F.sum("n").alias("n"))
    pairs = common.spool(pairs, "url-pairs")
    seen = common.spool(pairs.groupBy("accepted", "context").agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).where(F.col("n") >= least), "url-contexts")
    kept = pairs.join(seen.select("accepted", "context"), ["accepted", "context"], "left_semi")
    return seen.select("accepted", F.lit(0).alias("kind"), F.col("context").alias("h"), "n", "kinds").union(kept.select("accepted", F.lit(1), "pair", "n", F.lit(0)))


class Markov:
    """Counts by slot: of contexts, of the kinds of characters that followed, of contexts with a character; for two classes."""

    def __init__(self, counts: DataFrame, order: int = ORDER, slots: int = SLOTS):
        folded = counts.groupBy("accepted", "kind", F.col("h").bitwiseAND(F.lit(slots - 1)).alias("slot")).agg(F.sum("n").alias("n"), F.sum("kinds").alias("kinds")).toArrow()  # 4 x slots rows at most
        self.order, self.slots = order, slots
        self.n, self.kinds, self.pairs = (np.zeros((2, slots), np.float32) for _ in range(3))
        column = lambda c: folded.column(c).to_numpy()
        accepted, kind, slot = column("accepted").astype(np.int64), column("kind"), column("slot")
        for wanted, values, name in ((0, self.n, "n"), (0, self.kinds, "kinds"), (1, self.pairs, "n")):
            rows = kind == wanted
            values[accepted[rows], slot[rows]] = column(name)[rows]

    def log_likelihoods(self, urls: Sequence[str]) -> np.ndarray:
        """Of each url under the rejected and the accepted class."""
        if not len(urls):
            return np.zeros((2, 0))
        chars, starts = characters(urls)
        p = np.full((2, len(chars)), 1 / ALPHABET)
        going = np.ones((2, len(chars)), bool)  # false: a context is not kept, nor is any longer one
        last = np.uint64(self.slots - 1)
        for places, context, pair in contexts(chars, starts, self.order):
            a, b = (context & last).astype(np.int64), (pair & last).astype(np.int64)
            for c in (0, 1):
                n, kinds, followed = self.n[c, a], self.kinds[c, a], self.pairs[c, b]
                going[c, places] &= n > 0
                better = (np.minimum(followed, n) + kinds * p[c, places]) / np.maximum(n + kinds, 1)
                p[c, places] = np.where(going[c, places], better, p[c, places])
        p[:, starts] = 1.0  # nobody asks for START
        return np.add.reduceat(np.log(p), starts, axis=1)

    def differences(self, urls: Sequence[str]) -> np.ndarray:
        """By character, the end included; 0 for an empty url."""
        rejected, accepted = self.log_likelihoods(urls)
        lengths = np.array([len(u) for u in urls], np.int64)
        return np.where(lengths > 0, (accepted - rejected) / (lengths + 1), 0.0)


def calibrate(x: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and offset of a logistic curve, by Newton steps with a small ridge; the classes weigh the same."""
    scale = max(float(np.std(x)), 1e-9)
    a, b, x = 0.0, 0.0, x / scale
    weight = np.where(y, 0.5 / max(y.sum(), 1), 0.5 / max((~y).sum(), 1))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = weight * (p - y)
        h = weight * p * (1 - p)
        m = np.array([[(h * x * x).sum() + 1e-3, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-3]])
        step = np.linalg.solve(m, [(g * x).sum() + 1e-3 * a, g.sum() + 1e-3 * b])
        a, b = a - step[0], b - step[1]
    return a / scale, b


def fit(labelled: DataFrame, sample: int = SAMPLE, order: int = ORDER) -> tuple[Markov | None, float, float]:
    """labelled: text, accepted. All different texts but a fifth, by hash, train the models; of the others a sample calibrates."""
    texts = common.spool(labelled.distinct(), "url-labelled")
    fifth = F.pmod(F.xxhash64("text"), F.lit(5))
    order_by = F.xxhash64("text", F.lit("calibration"))
    picked = [texts.where((F.col("accepted") == F.lit(v)) & (fifth == 4)).orderBy(order_by, "text").limit(sample).collect() for v in (True, False)]
    there = {r["accepted"] for r in texts.select("accepted").distinct().collect()}
    if len(there) < 2:
        return None, 0.0, 1.0 if True in there else -1.0
    train = texts.where(fifth != 4)
    if train.select("accepted").distinct().count() < 2:  # a handful of texts: they train and calibrate
        train = texts
    model = Markov(counted(train, order), order)
    for i, v in enumerate((True, False)):
        picked[i] = picked[i] or texts.where(F.col("accepted") == F.lit(v)).orderBy(order_by, "text").limit(sample).collect()
    kept = [r for part in picked for r in part]
    return model, *calibrate(model.differences([r["text"] for r in kept]), np.array([r["accepted"] for r in kept]))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, sample: int = SAMPLE) -> DataFrame:
    """page_id, host, path, rule, verdict and score (the method's probability; null where a rule decides)."""
    common.small_batches(pages.sparkSession, 5000)
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"), F.coalesce("url", F.lit("")).alias("text"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"), F.regexp_replace("text", "^[^:/?#]*://", "").alias("text"))
    model, slope, offset = fit(rows.where("ruled is not null").select("text", (F.col("ruled") == "allow").alias("accepted")), sample)
    sent = pages.sparkSession.sparkContext.broadcast((model, slope, offset))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, slope, offset = sent.value
        for batch in batches:
            open_ = np.flatnonzero(batch.column("ruled").is_null().to_numpy(zero_copy_only=False))
            texts = batch.column("text").take(pa.array(open_)).to_pylist()
            scores = np.full(len(batch), np.nan)
            for a in range(0, len(texts), 500):
                z = slope * (model.differences(texts[a : a + 500]) if model else 0.0) + offset
                scores[open_[a : a + 500]] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            score = pa.array(scores, pa.float64(), from_pandas=True)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), score], [*names, "score"])

    names = ["page_id", "host", "path", "rule", "ruled"]
    schema = f"page_id {pages.schema['page_id'].dataType.simpleString()}, host string, path string, rule string, ruled string, score double"
    scored = rows.mapInArrow(run, schema)
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("score") > 0.5, "allow").otherwise("block")).alias("verdict"), "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.table(spark, sf_dir, "pages"))
