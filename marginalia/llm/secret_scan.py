r"""Secret scans by a trigram inverted index. DataFrame functions only on the executors.

Each rule is a regular expression. ``trigram_query`` derives from it which trigrams any match must hold, as an OR of ANDs.
The index has a posting (trigram, doc_id, text key) for each trigram that some rule asks for; postings are intersected for
each AND by a bit mask over (rule, clause, document), and only documents that meet a rule's query are verified with its
expression. Rules without a mandatory trigram, like runs of hex digits, scan every text. Texts are read twice; only the
candidates' texts can be shuffled, since what has none of the trigrams is left out where it is read.

Positions of all matches come from the lengths of the matches and of the pieces between them, by a running sum over the
matches of a text. Matches are leftmost and do not overlap; those whose group is too short are dropped.

Nulls and ties: a null text is empty; rows with the same doc_id (null included) and text are the same document and get the
same spans. Repeated rows are each returned. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0  # the group that must have ``least`` characters
    least: int = 1
    any_case: bool = False


# The base kinds.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
# Public formats of keys and tokens.
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("live_key", r"[sr]k_live_[A-Za-z0-9]{16,}"),
    Rule("url_login", r"://[A-Za-z0-9._~%-]+:[A-Za-z0-9._~%!$&*+=-]+@"),
)
RULES = BASE + MORE

MOST_ENDS = 16  # different strings kept for one run of literals


#: Escaped letters that stand for a kind of character, or a place, and not for themselves.
CLASSES, PLACES = set("dDwWsS"), set("bBAZ")


def parse(pattern: str, at: int = 0) -> tuple[list[list[tuple]], int]:
    """The alternatives of a regular expression, up to its end or closing bracket: lists of (what, least, most), where what
    is a set of characters, a list of alternatives, or None (something else)."""
    out: list[list[tuple]] = [[]]
    while at < len(pattern) and pattern[at] != ")":
        c, at = pattern[at], at + 1
        what: object
        if c == "|":
            out.append([])
            continue
        if c in "^$":
            continue
        if c == "(":
            if pattern[at : at + 2] == "?:":
                at += 2
            elif pattern[at : at + 1] == "?":
                raise ValueError(f"not known: {pattern[at - 1 : at + 3]}")
            what, at = parse(pattern, at)
            at += 1
        elif c == "[":
            end = at + 1 + (pattern[at] == "^")
            while pattern[end] != "]":
                end += 1 + (pattern[end] == "\\")
            inner, at = pattern[at:end], end + 1
            what = None if inner[0] == "^" or "\\" in inner or "-" in inner[1:-1] else set(inner)
        elif c == "\\":
            c, at = pattern[at], at + 1
            if c in PLACES:
                continue
            if c == "x":
                c, at = chr(int(pattern[at : at + 2], 16)), at + 2
                what = {c}
            else:
                what = None if c in CLASSES else {c}
        else:
            what = None if c == "." else {c}
        least, most = 1, 1
        if at < len(pattern) and pattern[at] in "?*+{":
            if pattern[at] == "{":
                end = pattern.index("}", at)
                low, _, high = pattern[at + 1 : end].partition(",")
                least, most, at = int(low), int(high or low) if high or "," not in pattern[at:end] else 1 << 30, end + 1
            else:
                least, most = {"?": (0, 1), "*": (0, 1 << 30), "+": (1, 1 << 30)}[pattern[at]]
                at += 1
            at += pattern[at : at + 1] in ("?", "+")  # lazy or possessive
        out[-1].append((what, least, most))
    return out, at


def trigram_query(pattern: str) -> frozenset[frozenset[str]]:
    """Clauses of lower-cased trigrams: a text with a match holds all of some clause. Empty: no trigram is mandatory."""
    runs: list[set[str]] = []  # of literal strings, one of each set is in a match

    def simple(parts: list[tuple]) -> bool:
        return all(isinstance(what, set) and len(what) == 1 and most - least <= 1 and most < 9 for what, least, most in parts)

    def walk(parts: list[tuple], ends: set[str]) -> set[str]:
        for what, least, most in parts:
            if isinstance(what, set) and (least, most) == (1, 1) and len(what) * len(ends) <= MOST_ENDS:
                ends = {e + c for e in ends for c in what}
            elif isinstance(what, set) and len(what) == 1 and most < 9 and most - least <= 1 and (most - least + 1) * len(ends) <= MOST_ENDS:
                ends = {e + c * n for e in ends for c in what for n in range(least, most + 1)}
            elif isinstance(what, list) and (least, most) == (1, 1) and all(map(simple, what)):
                ends = {x for part in what for x in walk(part, ends)}
            else:  # anything else ends the run
                runs.append(ends)
                ends = {""}
        return ends

    alternatives, _ = parse(pattern)
    if len(alternatives) > 1:
        alternatives = [[(alternatives, 1, 1)]]
    runs.append(walk(alternatives[0], {""}))
    clauses: set[frozenset[str]] = {frozenset()}
    for run in runs:
        options = {frozenset(s[i : i + 3].lower() for i in range(len(s) - 2)) for s in run}
        if frozenset() in options:
            continue  # some way through has no trigram here, so none is mandatory
        clauses = {a | b for a in clauses for b in options}
    return frozenset() if frozenset() in clauses else frozenset(clauses)


def postings(read: DataFrame) -> DataFrame:
    """The index: (trigram, doc_id, key). read: the result of first_pass."""
    return read.select("doc_id", "key", F.explode("trigrams").alias("trigram"))


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """doc_id, key and kinds: the rules whose trigram query the document meets."""
    asked = [(r.kind, k, t, 1 << i, (1 << len(c)) - 1) for r in rules for k, c in enumerate(sorted(map(sorted, trigram_query(r.pattern)))) for i, t in enumerate(c)]
    query = index.sparkSession.createDataFrame(asked, "kind string, clause int, trigram string, bit long, need long")
    # the query table has a few rows for each rule, whatever the input
    met = index.join(F.broadcast(query), "trigram").groupBy("doc_id", "key", "kind", "clause").agg(F.bit_or("bit").alias("has"), F.max("need").alias("need")).where("has = need")
    return met.groupBy("doc_id", "key").agg(F.collect_set("kind").alias("kinds"))


def lengths(rule: Rule, number: int, check: Column) -> Column:
    """Array of (number, i, before, long, group): lengths of the piece before match i, of the match and of its group; null without a match."""
    pattern = F.lit(("(?i)" if rule.any_case else "") + rule.pattern)
    all_of = lambda group: F.transform(F.regexp_extract_all("text", pattern, F.lit(group)), F.length)
    pieces = F.transform(F.split("text", pattern, -1), F.length)
    found = F.arrays_zip(pieces.alias("before"), all_of(0).alias("long"), all_of(rule.group).alias("group"))
    rows = F.transform(found, lambda x, i: F.struct(F.lit(number).alias("number"), i.alias("i"), x["before"].alias("before"), x["long"].alias("long"), x["group"].alias("group")))
    # most texts end at rlike, whatever the rule; the piece after the last match has no match
    return F.when(check & F.rlike("text", pattern), F.filter(rows, lambda x: x["long"].isNotNull()))


def together(found: list[Column]) -> Column:
    """One array of all that is not null; null if nothing is there."""
    none = F.expr("cast(array() as array<struct<number:int,i:int,before:int,long:int,group:int>>)")
    out = F.concat(*[F.coalesce(x, none) for x in found]) if found else none
    return F.when(F.size(out) > 0, out)


def first_pass(documents: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """doc_id, key, trigrams (of those that rules ask for) and free: the matches of rules without a mandatory one."""
    asked = {r.kind: trigram_query(r.pattern) for r in rules}
    wanted = sorted({t for q in asked.values() for c in q for t in c})
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select("doc_id", common.text_key().alias("key"), "text", F.lower("text").alias("low"))
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in wanted])) if wanted else F.array().cast("array<string>")
    free = together([lengths(r, i, F.lit(True)) for i, r in enumerate(rules) if not asked[r.kind]])
    return rows.select("doc_id", "key", held.alias("trigrams"), free.alias("free"))


def second_pass(documents: DataFrame, meets: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """doc_id, key and bound: the matches of the other rules in their candidates."""
    low = F.lower("text")
    meets_some = F.lit(False)
    for r in rules:
        for clause in sorted(map(sorted, trigram_query(r.pattern))):
            holds = F.lit(True)
            for t in clause:
                holds = holds & F.contains(low, F.lit(t))
            meets_some = meets_some | holds
    # others can't be candidates, and need not be shuffled
    texts = documents.where(meets_some).select("doc_id", common.text_key().alias("key"), "text")
    meets = meets.select(F.col("doc_id").alias("d"), F.col("key").alias("k"), "kinds")
    rows = texts.join(meets, texts["doc_id"].eqNullSafe(meets["d"]) & (texts["key"] == meets["k"])).select("doc_id", "key", "text", "kinds")
    bound = together([lengths(r, i, F.array_contains("kinds", r.kind)) for i, r in enumerate(rules) if trigram_query(r.pattern)])
    return rows.select("doc_id", "key", bound.alias("bound")).where("bound is not null")


def scan(documents: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and found: array of (start, number, kind, end), by start, then rule."""
    read = common.spool(first_pass(documents, rules), "secret-index")
    meets = common.spool(candidates(postings(read), rules), "secret-candidates")
    bound = second_pass(documents, meets, rules)
    matches = read.where("free is not null").select("doc_id", "key", F.col("free").alias("x")).union(bound.select("doc_id", "key", "bound"))
    # repeated rows once: their matches are the same, so the lengths are counted once for each rule and number
    each = common.spool(matches.select("doc_id", "key", F.explode("x").alias("x")).select("doc_id", "key", "x.*").distinct(), "secret-matches")
    upto = Window.partitionBy("doc_id", "key", "number").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("before") + F.col("long")).over(upto).cast("int")
    table = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.least).alias("least")) for r in rules])
    placed = each.withColumn("end", end).withColumn("rule", F.get(table, "number")).where("group >= rule.least")
    span = F.struct((F.col("end") - F.col("long")).alias("start"), "number", F.col("rule.kind").alias("kind"), "end")
    spans = placed.groupBy(F.col("doc_id").alias("d"), F.col("key").alias("k")).agg(F.array_sort(F.collect_list(span)).alias("found"))
    spans = common.spool(spans, "secret-spans")
    out = read.join(spans, read["doc_id"].eqNullSafe(spans["d"]) & (read["key"] == spans["k"]), "left")
    none = F.expr("cast(array() as array<struct<start:int,number:int,kind:string,end:int>>)")
    return out.select("doc_id", F.coalesce("found", none).alias("found"))


def written(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan(common.table(spark, sf_dir, "documents"))
    count = lambda i: F.size(F.filter("found", lambda x: x["number"] == i)).cast("long")
    return rows.select(
        "doc_id",
        *[count(i).alias(f"n_{r.kind}") for i, r in enumerate(BASE)],
        F.sha2(written(F.filter("found", lambda x: x["number"] < len(BASE))), 256).alias("base_sha256"),
        written(F.col("found")).alias("spans"),
    )
