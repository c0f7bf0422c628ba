"""Queries over texts: counts, terms, lexicons, structure, quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.operators import lexicon, structure
from marginalia.sources import io

from .bindings import N_WORDS, SUBMISSIONS, query, submissions

#: A lexicon that the invented prose hits: frequent words of its languages.
LEXICON = {"the": "the", "and": "and", "that": "that ", "und": "und", "los": "los "}
HIT = {n: f"len(regexp_extract_all(lower(coalesce(text, '')), '{p}'))" for n, p in LEXICON.items()}
STOP = ", ".join(f"'{w}'" for w in sorted(T.STOPWORDS))
TOKENS = rf"list_filter(regexp_extract_all(lower(regexp_replace(coalesce(text, ''), '<[^>]+>', ' ', 'g')), '[a-z]{{3,}}'), lambda t: t NOT IN ({STOP}))"


@query("s2_submission_scan", "SELECT doc_id, coalesce(lang, 'Student ' || doc_id) AS name, n_chars FROM documents WHERE length(trim(text)) > 0")
def submission_scan(spark, sf_dir):
    rows = io.table(spark, sf_dir, "documents")
    return rows.where(F.length(F.trim("text")) > 0).select("doc_id", F.coalesce("lang", F.concat(F.lit("Student "), "doc_id")).alias("name"), "n_chars")


@query("s7_html_text", r"""SELECT page_id, trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(html, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '<[^>]+>', ' ', 'g'), '[ \t\n\r\f]+', ' ', 'g')) AS body FROM pages""")
def html_text(spark, sf_dir):
    return io.table(spark, sf_dir, "pages").select("page_id", T.clean_text(F.col("html")).alias("body"))


@query("r1_strip_html_modes", r"""SELECT page_id, len(regexp_extract_all(regexp_replace(html, '<[^>]+>', ' ', 'g'), '[^ \t\n\r\f]+')) AS n_spaced, len(regexp_extract_all(regexp_replace(html, '<[^>]+>', '', 'g'), '[^ \t\n\r\f]+')) AS n_joined, len(regexp_extract_all(html, '[^ \t\n\r\f]+')) AS n_raw FROM pages""")
def strip_modes(spark, sf_dir):
    html = F.col("html")
    return io.table(spark, sf_dir, "pages").select("page_id", T.word_count(T.strip_html(html)).alias("n_spaced"), T.word_count(T.strip_html(html, "")).alias("n_joined"), T.word_count(html).alias("n_raw"))


@query("r4_tokens", rf"SELECT doc_id, len({TOKENS}) AS n_tokens, len(list_distinct({TOKENS})) AS n_types FROM documents")
def token_counts(spark, sf_dir):
    rows = io.table(spark, sf_dir, "documents").select("doc_id", T.tokens(F.col("text")).alias("t"))
    return rows.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_types"))


@query("a4_submission_stats", f"WITH {SUBMISSIONS} SELECT source, count(*) AS n, avg(score) AS mean_words, quantile_cont(score, 0.5) AS median_words, min(n_words) AS min_words, max(n_words) AS max_words FROM subs GROUP BY source")
def submission_stats(spark, sf_dir):
    s = submissions(spark, sf_dir)
    return s.groupBy("source").agg(F.count("*").alias("n"), F.avg("score").alias("mean_words"), F.percentile("score", 0.5).alias("median_words"), F.min("n_words").alias("min_words"), F.max("n_words").alias("max_words"))


@query("a4_format_histogram", "SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL")
def format_histogram(spark, sf_dir):
    return io.table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))


@query("a6_word_frequency", rf"SELECT term, count(*) AS n FROM (SELECT unnest({TOKENS}) AS term FROM documents) GROUP BY term ORDER BY n DESC, term LIMIT 30")
def word_frequency(spark, sf_dir):
    return lexicon.word_frequency(io.table(spark, sf_dir, "documents"))


WEIGHTS = rf"""
tok AS (SELECT source, doc_id, unnest({TOKENS}) AS term FROM documents),
tf AS (SELECT source, doc_id, term, count(*) AS tf FROM tok GROUP BY ALL),
n AS (SELECT source, count(*) AS n_rows FROM documents GROUP BY source),
terms AS (SELECT source, term, sum(tf) AS total, count(*) AS df, any_value(n_rows) AS n_rows FROM tf JOIN n USING (source) GROUP BY source, term),
kept AS (SELECT source, term, ln((1.0::DOUBLE + n_rows) / (1.0::DOUBLE + df)) + 1 AS idf FROM (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY total DESC, term) AS rank FROM terms WHERE df >= 2 AND df <= 0.9::DOUBLE * n_rows) WHERE rank <= 500),
w AS (SELECT source, doc_id, term, tf * idf AS w FROM tf JOIN kept USING (source, term)),
weights AS (SELECT source, doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY source, doc_id)) AS weight FROM w)"""


@query("a7_tfidf_terms", f"""WITH {WEIGHTS}, mean AS (SELECT source, term, sum(weight) / any_value(n_rows) AS score FROM weights JOIN n USING (source) GROUP BY source, term)
SELECT source, term, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY round(score, 9) DESC, term DESC) AS r FROM mean) WHERE r <= 20""")
def tfidf_terms(spark, sf_dir):
    return lexicon.top_terms(io.table(spark, sf_dir, "documents"), "doc_id", "source").withColumn("score", F.round("score", 6))


@query("a9_keyword_hits", "WITH h AS (" + " UNION ALL ".join(f"SELECT doc_id, '{n}' AS pattern, {x} AS n FROM documents" for n, x in HIT.items()) + ") SELECT pattern, sum(n)::BIGINT AS n_matches, count(DISTINCT doc_id) AS n_rows FROM h WHERE n > 0 GROUP BY pattern")
def keyword_hits(spark, sf_dir):
    return lexicon.keyword_hits(io.table(spark, sf_dir, "documents"), "doc_id", LEXICON).drop("examples")


@query("r6_pattern_counts", "SELECT doc_id, " + ", ".join(f"{x} AS hits_{n}" for n, x in HIT.items()) + " FROM documents")
def pattern_counts(spark, sf_dir):
    return lexicon.hit_columns(io.table(spark, sf_dir, "documents"), LEXICON).select("doc_id", *[f"hits_{n}" for n in LEXICON])


@query("r7_context_excerpt", r"""WITH x AS (SELECT doc_id, text, instr(lower(text), 'that ') AS pos FROM documents)
SELECT doc_id, substr(text, greatest(1, pos - 30), pos - greatest(1, pos - 30) + 5 + 30) AS excerpt FROM x WHERE pos > 0""")
def context_excerpt(spark, sf_dir):
    return io.table(spark, sf_dir, "documents").select("doc_id", T.excerpt(F.col("text"), "that ").alias("excerpt")).where("excerpt is not null")


LAST = r"regexp_replace(lower(list_extract(string_split(trim(regexp_replace(text, '[ \t\n\r\f]+', ' ', 'g')), ' '), -1)), '[.,;:]+$', '')"


@query("r8_truncation", rf"""WITH {SUBMISSIONS}, m AS (SELECT source, quantile_cont(score, 0.5) AS median FROM subs GROUP BY source),
f AS (SELECT doc_id, NOT regexp_matches(right(trim(regexp_replace(text, '[ \t\n\r\f]+', ' ', 'g')), 3), '[.?!"'')\]]') AS a,
 {LAST} IN ({", ".join(f"'{w}'" for w in T.TRAILING)}) AS b,
 {" OR ".join("contains(lower(trim(regexp_replace(text, '[ ]+', ' ', 'g'))), '" + p.replace("'", "''") + "')" for p in T.UNFINISHED)} AS c,
 median > 0 AND n_words < median * 0.5::DOUBLE AS d FROM subs JOIN m USING (source))
SELECT doc_id, (a::INT + b::INT + c::INT + d::INT)::BIGINT AS n_signals, c OR (a AND (b OR d)) AS truncated FROM f""")
def truncation(spark, sf_dir):
    # signals that need no median first: texts are read once
    zero = F.lit(0.0)
    s = submissions(spark, sf_dir)
    s = io.written(s.select("doc_id", "source", "n_words", T.truncation_signals(F.col("text"), F.col("n_words"), zero).alias("s")), "truncation")
    medians = s.groupBy("source").agg(F.percentile("n_words", 0.5).alias("median"))
    below = F.when((F.col("median") > 0) & (F.col("n_words") < F.col("median") * 0.5), F.lit("below_median"))
    out = io.join_same(s, medians, ["source"]).select("doc_id", F.array_compact(F.concat("s", F.array(below))).alias("s"))
    return out.select("doc_id", F.size("s").cast("long").alias("n_signals"), T.is_truncated(F.col("s")).alias("truncated"))


FOLD = "trim(w, '" + T.FOLDED_PUNCTUATION.replace("'", "''") + "')"
BARE = "trim(w, '" + T.EDGE_PUNCTUATION.replace("'", "''") + "')"


@query("r9_gibberish", rf"""WITH x AS (SELECT doc_id, text, regexp_extract_all(lower(coalesce(text, '')), '[^ \t\n\r\f]+') AS words FROM documents),
e AS (SELECT doc_id, unnest(words) AS w FROM x), c AS (SELECT doc_id, {FOLD} AS folded, count(*) AS times FROM e GROUP BY ALL), m AS (SELECT doc_id, max(times) AS most, count(*) AS different FROM c GROUP BY doc_id),
b AS (SELECT doc_id, count(*) AS bare, count(*) FILTER (regexp_matches({BARE}, '{T.key_walk()}')) AS mashed, count(*) FILTER (NOT regexp_matches({BARE}, '[{T.VOWELS}]')) AS vowelless FROM e WHERE length({BARE}) >= 3 GROUP BY doc_id)
SELECT x.doc_id, CASE WHEN len(words) < 15 THEN NULL WHEN regexp_matches(text, '(?i){T.PLACEHOLDERS}') THEN 'lorem_ipsum' WHEN bare > 0 AND mashed > 0.4::DOUBLE * bare THEN 'keyboard_mash' WHEN bare > 10 AND vowelless > 0.5::DOUBLE * bare THEN 'keyboard_mash'
 WHEN len(words) > 20 AND most > 0.4::DOUBLE * len(words) THEN 'repetition_spam' WHEN len(words) > 30 AND different < 0.12::DOUBLE * len(words) THEN 'repetition_spam' END AS reason FROM x LEFT JOIN m USING (doc_id) LEFT JOIN b USING (doc_id)""")
def gibberish(spark, sf_dir):
    return T.gibberish_reason(io.table(spark, sf_dir, "documents"), "doc_id")


@query("r19_artifacts", r"""SELECT *, n_headers >= 3 OR n_list_items >= 10 OR n_bold >= 5 OR n_entities > 0 OR n_markdown >= 2 AS looks_pasted FROM (
SELECT page_id, len(regexp_extract_all(html, '<h[1-6]')) AS n_headers, len(regexp_extract_all(html, '<li')) AS n_list_items, len(regexp_extract_all(html, '<(?:strong|b)>')) AS n_bold,
  len(regexp_extract_all(html, '&[a-z]+;')) AS n_entities, len(regexp_extract_all(html, '\*\*')) AS n_markdown FROM pages)""")
def pasted(spark, sf_dir):
    return structure.artifacts(io.table(spark, sf_dir, "pages"), "page_id", "html")


@query("r18_unicode_marks", r"SELECT doc_id, len(regexp_extract_all(text, '[\x{200b}-\x{200d}\x{2060}\x{feff}]')) AS n_zero_width, len(regexp_extract_all(text, '[\x{a0}\x{2000}-\x{200a}\x{202f}\x{3000}]')) AS n_odd_spaces, len(regexp_extract_all(text, '[\x{430}-\x{44f}]')) AS n_cyrillic FROM documents")
def unicode_marks(spark, sf_dir):
    return structure.unicode_marks(io.table(spark, sf_dir, "documents"), "doc_id")


SENTENCES = r"list_filter(list_transform(string_split_regex(coalesce(text, ''), '[.!?]+'), lambda s: regexp_extract_all(s, '[^ \t\n\r\f]+')), lambda s: len(s) > 0)"


@query("r31_sentence_features", rf"""WITH x AS (SELECT doc_id, text, {SENTENCES} AS s, regexp_extract_all(text, '[^ \t\n\r\f]+') AS w FROM documents), y AS (SELECT *, list_transform(s, lambda a: len(a)::DOUBLE) AS n FROM x)
SELECT doc_id, len(s) AS n_sentences, CASE WHEN len(s) >= 5 THEN round(sqrt(greatest(0, list_sum(list_transform(n, lambda a: a * a)) / len(n) - pow(list_sum(n) / len(n), 2))) / (list_sum(n) / len(n)), 6) END AS length_cv,
 CASE WHEN len(s) >= 5 THEN round(len(list_distinct(list_transform(s, lambda a: lower(a[1]))))::DOUBLE / len(s), 6) END AS starter_diversity,
 CASE WHEN len(w) > 0 THEN round(100.0::DOUBLE * (length(text) - length(replace(text, ',', ''))) / len(w), 6) END AS commas_per_100_words,
 CASE WHEN len(w) > 0 THEN round(list_sum(list_transform(w, lambda a: length(a)))::DOUBLE / len(w), 6) END AS avg_word_length FROM y""")
def sentence_features(spark, sf_dir):
    out = structure.sentence_features(io.table(spark, sf_dir, "documents"), "doc_id")
    return out.withColumns({c: F.round(c, 6) for c in ("length_cv", "starter_diversity", "commas_per_100_words", "avg_word_length")})


@query("r29_section_balance", r"""WITH x AS (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda s: len(regexp_extract_all(s, '[^ \t\n\r\f]+'))::DOUBLE), lambda n: n > 0) AS n FROM documents),
y AS (SELECT doc_id, len(n) AS n_sections, CASE WHEN len(n) >= 3 THEN sqrt(greatest(0, list_sum(list_transform(n, lambda a: a * a)) / len(n) - pow(list_sum(n) / len(n), 2))) / (list_sum(n) / len(n)) END AS cv FROM x)
SELECT doc_id, n_sections, round(cv, 6) AS section_cv, coalesce(cv < 0.25, false) AS is_balanced FROM y""")
def section_balance(spark, sf_dir):
    return structure.section_balance(io.table(spark, sf_dir, "documents"), "doc_id").withColumn("section_cv", F.round("section_cv", 6))


@query("v4_prompt_similarity", rf"""WITH mine AS (SELECT DISTINCT doc_id, unnest({TOKENS}) AS term FROM documents), theirs AS (SELECT DISTINCT item_id, unnest({TOKENS}) AS term FROM benchmark), k AS (SELECT item_id, count(*) AS n FROM theirs GROUP BY 1)
SELECT doc_id, item_id, count(*) AS n_shared, count(*)::DOUBLE / any_value(k.n) AS containment FROM mine JOIN theirs USING (term) JOIN k USING (item_id) GROUP BY doc_id, item_id HAVING count(*) >= 3""")
def prompt_similarity(spark, sf_dir):
    return lexicon.prompt_similarity(io.table(spark, sf_dir, "documents"), "doc_id", io.table(spark, sf_dir, "benchmark"), "item_id", least=3)


@query("a13_shared_references", r"""SELECT reference, count(*) AS n_rows FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[A-Z][a-z]{9,}')) AS reference FROM documents) GROUP BY reference HAVING count(*) >= 2 ORDER BY n_rows DESC, reference LIMIT 20""")
def shared_references(spark, sf_dir):
    rows = io.table(spark, sf_dir, "documents").select("doc_id", F.regexp_extract_all("text", F.lit("[A-Z][a-z]{9,}"), F.lit(0)).alias("found"))
    return lexicon.shared_terms(rows, "doc_id", "found")


@query("a10_register_distribution", f"""WITH x AS (SELECT source, {N_WORDS} AS n, ({HIT["the"]} - {HIT["and"]})::DOUBLE / greatest(1, {N_WORDS}) AS c FROM documents)
SELECT source, CASE WHEN n < 50 AND abs(c) < 0.2::DOUBLE THEN 'perfunctory' WHEN c >= 0.03::DOUBLE THEN 'passionate' WHEN c <= -0.03::DOUBLE THEN 'urgent' WHEN abs(c) < 0.015::DOUBLE THEN 'analytical' ELSE 'reflective' END AS register, count(*) AS n FROM x GROUP BY ALL""")
def register_distribution(spark, sf_dir):
    n = T.word_count(F.col("text"))
    c = (T.hits(F.col("text"), "the") - T.hits(F.col("text"), "and")).cast("double") / F.greatest(F.lit(1), n)
    x = io.table(spark, sf_dir, "documents").select("source", n.alias("n"), c.alias("c"))
    register = F.when((F.col("n") < 50) & (F.abs("c") < 0.2), "perfunctory").when(F.col("c") >= 0.03, "passionate").when(F.col("c") <= -0.03, "urgent").when(F.abs("c") < 0.015, "analytical").otherwise("reflective")
    return x.groupBy("source", register.alias("register")).agg(F.count("*").alias("n"))
