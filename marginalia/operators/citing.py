"""References in texts: what kinds a text cites, what a class cites, and how sound a reference looks without the network.

The patterns are made of named parts: a name begins with a capital letter, of any script; authors are names joined by "and" or
"&", perhaps with "et al."; a year has four digits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.sources import io

NAME = r"\p{Lu}[\p{L}'’-]+"
AUTHORS = rf"{NAME}(?: (?:and|&) {NAME})*(?: et al\.?)?"
YEAR = r"[12][0-9]{3}"
ADDRESS = r"https?://[^\s<>\"()\[\]]+"
DOI = r"(?<![0-9.])10\.[0-9]{4,9}/[^\s<>\"\[\],;]+"
SAYS = "says?|states?|argues?|claims?|writes?|notes?|mentions?|discusses?|explains?|describes?|shows?|points? out"
ACCORDING = rf"(?:according to|as (?:[\p{{L}}]+ ){{0,2}}(?:{SAYS})) +([^.,;]{{4,60}}?)(?=[.,;]| that\b|$)"
READING = rf"(?:reading|text|article|book|chapter|author|source|document) (?:{SAYS})"
QUOTES = ('"([^"]{11,80})"', "“([^“”]{11,80})”", "‘([^‘’]{11,80})’")
#: Punctuation that ends a sentence and no address.
TAIL = r"[.,;:!?)]+\z"
KINDS = ("url", "doi", "author_year", "according_to", "reading", "quoted_title")


def all_of(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def host_of(address: Column) -> Column:
    return F.lower(F.regexp_extract(address, r"^[^:]+://([^/?#:]*)", 1))


def is_skipped(address: Column, hosts: tuple[str, ...], suffixes: tuple[str, ...]) -> Column:
    """The host is one of hosts, or one of suffixes or below it."""
    host = host_of(address)
    out = host.isin(*hosts) if hosts else F.lit(False)
    for s in suffixes:
        out = out | (host == s) | host.endswith(f".{s}")
    return out


@io.keyed("key")
def cited(rows: DataFrame, key: str, text: str = "text", skip_hosts: tuple[str, ...] = ("localhost", "127.0.0.1"), skip_suffixes: tuple[str, ...] = (), kinds: tuple[str, ...] = KINDS, quotes: tuple[str, ...] = QUOTES) -> DataFrame:
    """key, kind, reference: what each text cites, each once (case aside). Kinds: url, doi, author_year (also the name before a
    year in brackets), according_to, reading (the course's own, unnamed), quoted_title (of eleven characters, from a capital on, in ``quotes``);
    ``kinds`` says which of them are asked for."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")
    bracket = F.transform(all_of(t, rf"\({AUTHORS},? {YEAR}[a-z]?\)"), lambda x: F.concat(F.regexp_extract(x, rf"^\(({AUTHORS}),? {YEAR}", 1), F.lit(" ("), F.regexp_extract(x, f"({YEAR})[a-z]?\\)$", 1), F.lit(")")))
    inline = F.transform(all_of(t, rf"{AUTHORS} \({YEAR}[a-z]?\)"), lambda x: F.regexp_replace(x, r"[a-z]\)$", ")"))
    trimmed = lambda x: F.regexp_replace(x, TAIL, "")
    stripped = lambda x: F.regexp_replace(x, r"^\p{Zs}+|\p{Zs}+\z", "")
    found = {
        "url": F.filter(F.transform(all_of(t, ADDRESS), trimmed), lambda x: ~is_skipped(x, skip_hosts, skip_suffixes)),
        "doi": F.transform(all_of(t, DOI), lambda x: F.concat(F.lit("https://doi.org/"), trimmed(x))),
        "author_year": F.concat(bracket, inline),
        "according_to": F.transform(all_of(t, f"(?i){ACCORDING}", 1), F.trim),
        "reading": F.transform(F.slice(all_of(t, f"(?i){READING}"), 1, 1), lambda _: F.lit("[course reading]")),
        "quoted_title": F.filter(F.transform(F.concat(*[all_of(t, q, 1) for q in quotes]), stripped), lambda x: (F.length(x) > 10) & F.rlike(x, F.lit(r"^\p{Lu}"))),
    }
    as_kind = lambda k: lambda x: F.struct(F.lit(k).alias("kind"), x.alias("reference"))
    each = rows.select(key, F.explode(F.flatten(F.array(*[F.transform(v, as_kind(k)) for k, v in found.items() if k in kinds]))).alias("c"))
    return each.groupBy(key, "c.kind", F.lower("c.reference").alias("_low")).agg(F.min("c.reference").alias("reference")).select(key, "kind", "reference")


#: Kinds that name no source.
GENERIC = ("according_to", "reading")


@io.keyed("key")
def report(rows: DataFrame, found: DataFrame, key: str, k: int = 10) -> tuple[DataFrame, DataFrame]:
    """The k references that most texts cite (case aside), and one row: texts with and without a reference, specific and generic references."""
    top = found.groupBy("kind", F.lower("reference").alias("reference")).agg(F.count_distinct(key).alias("n_rows")).orderBy(F.desc("n_rows"), "kind", "reference").limit(k)
    by_row = found.groupBy(key).agg(F.count_if(~F.col("kind").isin(*GENERIC)).alias("specific"), F.count_if(F.col("kind").isin(*GENERIC)).alias("generic"))
    counts = rows.select(key).join(by_row, key, "left").agg(F.count("specific").alias("n_with"), F.count_if(F.col("specific").isNull()).alias("n_without"), F.coalesce(F.sum("specific"), F.lit(0)).alias("n_specific"), F.coalesce(F.sum("generic"), F.lit(0)).alias("n_generic"))
    return top, counts


def positions(text: Column, pattern: str) -> Column:
    """Array of (at, raw), zero-based: from the pieces between the matches, whose lengths add up."""
    raw, pieces = all_of(text, pattern), F.split(text, pattern, -1)
    none = F.expr("cast(array() as array<struct<at:int,raw:string>>)")
    start = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def step(a: Column, x: Column) -> Column:
        begin = a["at"] + F.length(x["p"])
        return F.struct((begin + F.length(x["m"])).alias("at"), F.concat(a["out"], F.array(F.struct(begin.alias("at"), x["m"].alias("raw")))).alias("out"))

    return F.when(F.size(raw) > 0, F.aggregate(F.arrays_zip(F.slice(pieces, 1, F.greatest(F.size(raw), F.lit(0))).alias("p"), raw.alias("m")), start, step, lambda s: s["out"])).otherwise(none)


@io.keyed("key")
def citations_in_detail(rows: DataFrame, key: str, text: str = "text", near: int = 200) -> DataFrame:
    """key, kind, raw, at, authors, year, doi, url: author-year citations, each with the first DOI and address within ``near`` characters; DOIs and
    addresses near none stand for themselves. Citations are few in a text: a text's are compared with each other in one row."""
    t = F.coalesce(text, F.lit(""))
    cut = rows.select(key, positions(t, rf"\({AUTHORS},? *{YEAR}[a-z]?\)|{AUTHORS} *\({YEAR}[a-z]?\)").alias("c"), positions(t, rf"(?:doi: *|https?://doi\.org/)?{DOI}").alias("d"), F.filter(positions(t, ADDRESS), lambda x: ~F.contains(x["raw"], F.lit("doi.org"))).alias("u"))
    close = lambda a, b: F.abs(a["at"] - b["at"]) < near
    first = lambda c, others: F.get(F.filter(others, lambda x: close(c, x)), F.lit(0))["raw"]
    alone = lambda name: F.filter(name, lambda x: ~F.exists("c", lambda c: close(c, x)))
    bare_doi = lambda x: F.regexp_extract(x, f"({DOI})", 1)
    kind = "struct<kind:string,raw:string,at:int,authors:array<string>,year:string,doi:string,url:string>"
    none = F.lit(None).cast("string")
    no_authors = F.array().cast("array<string>")
    authors = lambda x: F.split(F.regexp_replace(F.regexp_extract(x, f"({AUTHORS})", 1), r" et al\.?$", ""), " (?:and|&) ")
    full = F.transform("c", lambda c: F.struct(F.lit("author_year").alias("kind"), c["raw"].alias("raw"), c["at"].alias("at"), authors(c["raw"]).alias("authors"), F.regexp_extract(c["raw"], f"({YEAR}[a-z]?)", 1).alias("year"), bare_doi(first(c, F.col("d"))).alias("doi"), first(c, F.col("u")).alias("url")))
    dois = F.transform(alone("d"), lambda x: F.struct(F.lit("doi").alias("kind"), x["raw"].alias("raw"), x["at"].alias("at"), no_authors.alias("authors"), none.alias("year"), bare_doi(x["raw"]).alias("doi"), none.alias("url")))
    urls = F.transform(alone("u"), lambda x: F.struct(F.lit("url").alias("kind"), x["raw"].alias("raw"), x["at"].alias("at"), no_authors.alias("authors"), none.alias("year"), none.alias("doi"), x["raw"].alias("url")))
    return cut.select(key, F.explode(F.concat(*[x.cast(f"array<{kind}>") for x in (full, dois, urls)])).alias("x")).select(key, "x.*")


#: Names and years that made-up references often have.
COMMON_NAMES, USUAL_YEARS = ("smith", "jones", "johnson", "williams"), (2018, 2022)


def plausibility(authors: Column, year: Column) -> tuple[Column, Column]:
    """confidence (low from two issues on, else medium) and the issues of a reference, without a look at the network."""
    number = F.left(year, F.lit(4)).try_cast("int")
    issues = F.array_compact(
        F.array(
            F.when(F.exists(F.coalesce(authors, F.array().cast("array<string>")), lambda a: F.lower(a).isin(*COMMON_NAMES)), "common_name"),
            F.when(number.between(*USUAL_YEARS), "usual_year"),
            F.when(year.isNotNull() & number.isNull(), "bad_year"),
            F.when(F.coalesce(F.size(authors), F.lit(0)) <= 0, "no_authors"),
            F.when(year.isNull(), "no_year"),
        )
    )
    return F.when(F.size(issues) >= 2, "low").otherwise("medium"), issues


#: Claims that lean on somebody who is not named.
VAGUE = {
    "studies": "studies (?:show|have shown|indicate|suggest)",
    "research": "research (?:shows|indicates|suggests)",
    "experts": "(?:expert|scientist|researcher)s? (?:say|believe|argue)",
    "according": "according to (?:experts?|research|studies)",
    "proven": "it (?:has been|is widely) (?:proven|established|accepted)",
}


def vague(text: Column) -> Column:
    """Array of the kinds of vague attribution that a text has."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")
    return F.array_compact(F.array(*[F.when(F.rlike(t, F.lit(f"(?i){p}")), F.lit(k)) for k, p in VAGUE.items()]))


def citation_concern(n_citations: Column, n_suspicious: Column, n_vague: Column) -> Column:
    return F.when(n_suspicious > 0, "high").when((n_vague >= 3) | ((n_citations == 0) & (n_vague > 0)), "elevated").when(n_vague >= 1, "moderate").otherwise("low")
