"""Queries over documents and pages: signals, gates, normalisation, redaction, funnel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.operators import cleaning as C
from lakeloom.operators import quality as Q
from lakeloom.operators import text as X
from lakeloom.session import table

_STOPS = "CASE lang " + " ".join(
    f"WHEN '{k}' THEN [{', '.join(repr(w) for w in v)}]" for k, v in Q.STOPWORDS.items()
) + f" ELSE [{', '.join(repr(w) for w in Q.ENGLISH_STOPWORDS)}] END"

SIGNALS_SQL = rf"""
b AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+') AS w,
    list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l,
    {_STOPS} AS s
  FROM documents
), q AS (
  SELECT doc_id, lang, source, text, len(w) AS n_words,
    coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    len(list_filter(w, lambda x: NOT regexp_matches(x, '[\p{{L}}\p{{N}}]'))) AS symbol_words,
    len(l) AS n_lines,
    CASE WHEN len(l) >= 3 THEN len(list_filter(l, lambda x: right(x, 1) IN ('.', '!', '?', '।'))) END AS terminal_lines,
    CASE WHEN len(l) >= 3 THEN len(l) - len(list_distinct(l)) END AS duplicate_lines,
    len(list_filter(w[1:250], lambda x: list_contains(s, lower(regexp_replace(x, '^[.,!?।"''()]+|[.,!?।"''()]+$', '', 'g'))))) AS stopword_hits
  FROM b
), v AS (
  SELECT *, CASE WHEN n_words < 20 THEN 'too_short'
    WHEN NOT (word_chars / n_words BETWEEN 1.5 AND 15.0) THEN 'mean_word_len_out_of_range'
    WHEN symbol_words / n_words > 0.12 THEN 'symbol_word_ratio_too_high'
    WHEN duplicate_lines / n_lines > 0.35 THEN 'duplicate_line_wall'
    WHEN stopword_hits < 2 THEN 'too_few_stopwords' END AS fail_reason
  FROM q
)"""


def _signals(spark: SparkSession, sf: str) -> DataFrame:
    return Q.with_signals(table(spark, sf, "documents")).withColumn("fail_reason", Q.fail_reason())


_SIGNAL_COLUMNS = ("doc_id", "n_words", "word_chars", "symbol_words", "n_lines", "terminal_lines", "duplicate_lines", "stopword_hits")


def doc_quality_signals(spark, sf):
    return _signals(spark, sf).select(*_SIGNAL_COLUMNS)


def quality_fail_reasons(spark, sf):
    return _signals(spark, sf).groupBy(F.coalesce("fail_reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("docs"))


def quality_by_lang(spark, sf):
    return _signals(spark, sf).groupBy("lang").agg(
        F.count(F.lit(1)).alias("docs"), F.count_if(F.col("fail_reason").isNull()).alias("kept"), F.sum("n_words").alias("words"),
    )


def quality_features(spark, sf):
    d = _signals(spark, sf)
    return d.select(
        "doc_id", "n_words",
        F.coalesce(F.try_divide(F.col("terminal_lines").cast("double"), F.col("n_lines").cast("double")), F.lit(1.0)).alias("terminal_ratio"),
        F.coalesce(F.try_divide(F.col("duplicate_lines").cast("double"), F.col("n_lines").cast("double")), F.lit(0.0)).alias("duplicate_ratio"),
    )


def label_confusion(spark, sf):
    d = _signals(spark, sf).join(table(spark, sf, "labels"), "doc_id")
    return Q.confusion(d, F.col("quality"), F.col("fail_reason").isNull().cast("int"))


def label_join_missing(spark, sf):
    """Labels without a document, after every third is renamed to one that is not there."""
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    labels = table(spark, sf, "labels").withColumn("doc_id", F.when(F.col("doc_id") % 3 == 0, -F.col("doc_id") - 1).otherwise(F.col("doc_id")))
    return labels.join(docs, "doc_id", "left").agg(
        F.count(F.lit(1)).alias("labels"), F.count_if(F.col("lang").isNull()).alias("missing"),
    )


#: Letters of the Latin blocks up to U+024F.
LATIN = "[A-Za-zªºÀ-ÖØ-öø-ɏ]"


def quality_median_tier(spark, sf):
    """Composite score per document and a split at the upper median of its language; long documents go to a lane of their own.

    The median is found by counting rows per score, so that no language is sorted in one task.
    """
    from pyspark.sql import Window

    t = F.coalesce(F.col("text"), F.lit(""))
    d = table(spark, sf, "documents").select("doc_id", "lang", F.length(t).alias("n"), (F.regexp_count(t, F.lit("\n")) + 1).alias("lines"),
                                             F.regexp_count(t, F.lit(r"\p{L}")).alias("letters"), F.regexp_count(t, F.lit(LATIN)).alias("latin"))
    d = d.filter("letters > 0").select("doc_id", "lang", Q.quality_score(F.col("latin") / F.col("letters"), F.col("n"), F.col("lines")).alias("score"), (F.col("n") >= Q.LONG_CHARS).alias("long"))
    per = d.groupBy("lang", "score").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("lang")
    per = per.withColumn("upto", F.sum("n").over(w.orderBy("score"))).withColumn("all", F.sum("n").over(w))
    median = per.filter(F.col("upto") > F.floor(F.col("all") / 2)).groupBy("lang").agg(F.min("score").alias("median"))
    both = d.join(median.withColumnRenamed("lang", "_l"), F.col("lang").eqNullSafe(F.col("_l")))
    lane = F.when(F.col("long"), "long_context").otherwise(F.coalesce("lang", F.lit("none")))
    return both.select("doc_id", "score", F.when(F.col("score") >= F.col("median"), "verified").otherwise("unverified").alias("tier"), lane.alias("lane"))


def lang_script_profile(spark, sf):
    d = table(spark, sf, "documents")
    letters, latin, marked = (F.regexp_count("text", F.lit(p)) for p in (r"\p{L}", "[A-Za-z]", "[À-ÖØ-öø-ÿ]"))
    return d.groupBy("lang").agg(F.sum(letters).alias("letters"), F.sum(latin).alias("ascii_letters"), F.sum(marked).alias("marked_letters"))


_DETECT = {"fr": "éèêçàù", "de": "äöüß", "es": "óíñáú"}
_ISO3 = {"en": "eng", "fr": "fra", "de": "deu", "es": "spa"}


def detected_language(text):
    """The language with most function words and letters of its own in the whole text; ties go to the first of en, fr, de, es."""
    words = X.letter_runs(F.lower(text))
    hits = F.transform(words, lambda w: F.array(*[w.isin(*Q.STOPWORDS[k]).cast("int") for k in _ISO3]))

    def best(totals):
        each = [F.get(totals, F.lit(i)) + (F.regexp_count(text, F.lit(f"[{_DETECT[k]}]")) if k in _DETECT else F.lit(0)) for i, k in enumerate(_ISO3)]
        top = F.greatest(*each)
        found = F.when(each[0] == top, "en")
        for k, v in list(zip(_ISO3, each, strict=True))[1:]:
            found = found.when(v == top, k)
        return found

    zero = F.array(*[F.lit(0)] * len(_ISO3))
    return X.let(F.aggregate(hits, zero, lambda a, x: F.zip_with(a, x, lambda p, q: p + q)), best)


def langid_mismatch(spark, sf):
    """Detected language against the claimed one; short texts are kept unjudged."""
    d = table(spark, sf, "documents").select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("t"))
    iso = F.create_map(*[F.lit(x) for kv in _ISO3.items() for x in kv])
    d = d.withColumn("found", detected_language(F.col("t")))
    d = d.withColumn("detected", F.coalesce(iso[F.col("found")], F.col("found"))).withColumn("claimed", F.coalesce(iso[F.col("lang")], F.col("lang")))
    status = F.when(F.length("t") < 40, "too_short_to_judge_kept").when(F.col("detected") == F.col("claimed"), "match").otherwise("mismatch")
    return d.groupBy("claimed", "detected", status.alias("status")).agg(F.count(F.lit(1)).alias("docs"))


def _detect_sql():
    def score(k):
        words = f"len(list_filter(w, lambda x: list_contains([{', '.join(map(repr, Q.STOPWORDS[k]))}], x)))"
        return words + (f" + len(regexp_extract_all(t, '[{_DETECT[k]}]'))" if k in _DETECT else "")

    each = ", ".join(f"{score(k)} AS {k}" for k in _ISO3)
    m = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _ISO3.items())
    return rf"""
WITH b AS (SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{M}}\p{{N}}]+') AS w FROM documents),
s AS (SELECT lang, t, {each} FROM b),
f AS (SELECT *, CASE greatest(en, fr, de, es) WHEN en THEN 'en' WHEN fr THEN 'fr' WHEN de THEN 'de' ELSE 'es' END AS found FROM s),
i AS (SELECT t, CASE found {m} ELSE found END AS detected, CASE lang {m} ELSE lang END AS claimed FROM f)
SELECT claimed, detected, CASE WHEN length(t) < 40 THEN 'too_short_to_judge_kept' WHEN detected = claimed THEN 'match' ELSE 'mismatch' END AS status,
  count(*) AS docs FROM i GROUP BY ALL"""


def faithful_units_by_lang(spark, sf):
    d = table(spark, sf, "documents")
    return d.groupBy("lang").agg(
        F.sum(X.faithful_units(F.col("text"))).alias("units"), F.sum(F.regexp_count("text", F.lit(r"[\p{L}\p{M}\p{N}]+"))).alias("words"),
    )


def word_count_hist(spark, sf):
    n = F.size(X.space_words(F.coalesce("text", F.lit(""))))
    return table(spark, sf, "documents").groupBy(F.floor(n / 100).cast("long").alias("bucket")).agg(F.count(F.lit(1)).alias("docs"))


def glued_words(spark, sf):
    return table(spark, sf, "documents").groupBy("lang").agg(
        F.sum(F.regexp_count("text", F.lit(r"[\p{L}\p{M}]+(?:['’-][\p{L}\p{M}]+)?"))).alias("glued"),
    )


_NOISY = "concat('﻿', text, '​­  x‍', '\u0001', '\n\n\n\n end  ')"
_NOISY_SQL = "chr(65279) || text || chr(8203) || chr(173) || '  x' || chr(8205) || chr(1) || chr(57344) || chr(10) || chr(10) || chr(10) || chr(10) || ' end  '"


def noise_inventory(spark, sf):
    d = table(spark, sf, "documents").select(F.expr(_NOISY).alias("t"), "lang")
    counts = C.noise_counts(F.col("t"))
    one = d.select("lang", F.explode(F.create_map(*[x for k, v in counts.items() for x in (F.lit(k), v)])).alias("noise", "n"))
    return one.filter("n > 0").groupBy("lang", "noise").agg(F.sum("n").alias("n"))


def whitespace_normalized_hash(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.expr(_NOISY).alias("t"))
    clean = C.collapse_space(C.strip_noise(F.col("t")))
    return d.select("doc_id", X.content_hash(clean).alias("hash"), F.length(clean).alias("n_chars"), F.regexp_count("t", F.lit(C.JOINERS)).alias("joiners"))


_STRIP_SQL = r"regexp_replace(regexp_replace(translate(t, '" + "".join(map(chr, C.NOISE)) + r"', ''), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{9f}]', '', 'g'), '[\x{E000}-\x{F8FF}]', '', 'g')"
_SPACE_SQL = r"regexp_replace(regexp_replace(regexp_replace(CLEAN, '[ \t\x{a0}]{2,}', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^[ \t\n\r]+|[ \t\n\r]+$', '', 'g')"


def char_shrink(spark, sf):
    d = table(spark, sf, "documents").select("lang", F.coalesce("text", F.lit("")).alias("t"))
    after = C.collapse_space(F.col("t"))
    return d.groupBy("lang").agg(F.sum(F.length("t")).alias("before"), F.sum(F.length(after)).alias("after"))


def canonical_hash(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit("\r\né\r")).alias("t"))
    return d.select("doc_id", X.content_hash(X.canonical(F.col("t"))).alias("hash"))


def framed_hash(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("s"), F.coalesce("text", F.lit("")).alias("t"))
    return d.select("doc_id", X.hash_parts(F.col("s"), F.col("t")).alias("hash"))


_TURNS = "concat(if(conv_id % 2 = 0, '[USER] ', '<|im_start|>assistant '), text, if(turn % 2 = 0, ' <|im_end|>', ' <|endoftext|> ### Human: x </bot>'))"


def ghost_unify(spark, sf):
    d = table(spark, sf, "conversations").filter("text is not null").select("conv_id", "turn", F.expr(_TURNS).alias("t"))
    return d.select("conv_id", "turn", C.ghost_marks(F.col("t")).alias("marks"), F.sha2(C.unify_ghost_marks(F.col("t")), 256).alias("hash"))


def _ghost_sql():
    t = "t"
    for _, pattern, replacement in C.ghost_rules():
        t = f"regexp_replace({t}, '{pattern}', '{replacement}', 'g')"
    marks = " + ".join(f"len(regexp_extract_all(t, '{p}'))" for p in C.GHOST_MARKS)
    return f"""WITH d AS (SELECT conv_id, turn, CASE WHEN conv_id % 2 = 0 THEN '[USER] ' ELSE '<|im_start|>assistant ' END || text ||
  CASE WHEN turn % 2 = 0 THEN ' <|im_end|>' ELSE ' <|endoftext|> ### Human: x </bot>' END AS t FROM conversations WHERE text IS NOT NULL)
SELECT conv_id, turn, {marks} AS marks, sha256({t}) AS hash FROM d"""


def html_tag_counts(spark, sf):
    d = table(spark, sf, "pages")
    return d.select("page_id", F.regexp_count("html", F.lit(C.TAG)).alias("tags"), F.regexp_count("html", F.lit(C.ENTITY)).alias("entities"),
                    F.sha2(C.strip_tags(F.col("html")), 256).alias("stripped"))


def html_strip_boilerplate(spark, sf):
    t = F.concat_ws("\n", F.lit("Home"), F.col("html"), F.lit(" Privacy Policy "), F.lit("Terms of Use"), F.lit("read more!"))
    d = table(spark, sf, "pages").filter("html is not null").select("page_id", t.alias("t"))
    return d.select("page_id", C.boilerplate_lines(F.col("t")).alias("dropped"), F.sha2(C.drop_boilerplate_lines(F.col("t")), 256).alias("hash"))


def page_visible_text(spark, sf):
    d = table(spark, sf, "pages").filter("html is not null").select("page_id", C.visible_text(F.col("html")).alias("t"), F.length("html").alias("n"))
    return d.select("page_id", F.sha2("t", 256).alias("hash"), F.length("t").alias("visible"), (F.col("n") - F.length("t")).alias("gap"))


def link_absolutize(spark, sf):
    d = table(spark, sf, "pages").filter("html is not null").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), F.lit(1))).alias("href"))
    return d.groupBy("page_id", C.absolute_link(F.col("href"), F.lit("wiki.example")).alias("link")).agg(F.count(F.lit(1)).alias("n"))


def page_title_lang(spark, sf):
    d = table(spark, sf, "pages").filter("html is not null")
    one = d.select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("html", 'lang="([a-z]*)"', 1).alias("lang"))
    return one.groupBy("lang").agg(F.count(F.lit(1)).alias("pages"), F.count(F.nullif("title", F.lit(""))).alias("titled"), F.min("title").alias("first_title"))


def markdown_tidy(spark, sf):
    d = table(spark, sf, "documents").filter("text is not null").select("doc_id", F.concat(F.col("text"), F.lit(" a  \n\n\n\n\n\nb \t")).alias("t"))
    return d.select("doc_id", F.sha2(C.tidy_markdown(F.col("t")), 256).alias("hash"))


def markup_outside_code(spark, sf):
    d = table(spark, sf, "pages").filter("html is not null").select("page_id", F.concat(F.col("html"), F.lit("\n```\n<b>  x</b>\n```\n`<i>` <|im_start|>")).alias("t"))
    out = C.collapse_space_outside_code(C.unescape_entities(C.strip_markup_outside_code(F.col("t"))))
    return d.select("page_id", out.alias("clean"), F.length(out).alias("n_chars"))


def _pii_text():
    return F.concat(F.coalesce(F.col("text"), F.lit("")), F.when(F.col("doc_id") % 5 == 0, F.lit(" call +91 9876543210 or ravi@example.co.in ")).otherwise(F.lit("")))


def pii_counts_by_type(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", _pii_text().alias("t"))
    counts = C.rule_counts(F.col("t"), C.PII_RULES)
    one = d.select("doc_id", F.explode(F.create_map(*[x for k, v in counts.items() for x in (F.lit(k), v)])).alias("kind", "n"))
    return one.groupBy("kind").agg(F.sum("n").alias("found"), F.count_if(F.col("n") > 0).alias("docs"))


def pii_redacted_hash(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", _pii_text().alias("t"))
    clean = C.apply_rules(F.col("t"), C.PII_RULES)
    return d.select("doc_id", F.sha2(clean, 256).alias("hash"), (clean != F.col("t")).alias("changed"))


def admission_pii(spark, sf):
    t = F.concat(F.coalesce(F.col("text"), F.lit("")), F.lit(" 4321 8765 2109 ABCDE1234F 2007-2008 2008-2009 192.168.10.44 "))
    d = table(spark, sf, "documents").select("doc_id", t.alias("t"))
    return d.select("doc_id", *[v.alias(k) for k, v in C.rule_counts(F.col("t"), C.ADMISSION_PII_RULES).items()], C.apply_rules(F.col("t"), C.ADMISSION_PII_RULES).alias("clean"))


def pii_coverage(spark, sf):
    n = F.length(F.coalesce("text", F.lit("")))
    return table(spark, sf, "documents").agg(F.sum(F.least(n, F.lit(1000))).alias("scanned"), F.sum(n).alias("chars"), F.count_if(n > 1000).alias("longer"))


_LICENSES = ("mit", "MIT", "gpl-3.0", "CC-BY-4.0", "", "proprietary", "apache-2.0")


def license_gate(spark, sf):
    name = F.element_at(F.array(*map(F.lit, _LICENSES)), (F.col("doc_id") % 7 + 1).cast("int"))
    d = table(spark, sf, "documents").select(name.alias("license"), F.length("text").alias("n"))
    return d.groupBy("license", C.license_status(F.col("license")).alias("status")).agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("chars"))


#: Documents of a leaf of the manifest's hash tree.
LEAF_DOCS = 256


def source_manifest(spark, sf):
    """Counts per source and a hash over its documents in order: hashes of leaves of ids, and the hash of those.

    A leaf covers a range of doc_ids, so that what is gathered is bounded per leaf and 64 bytes a leaf above it.
    """
    d = table(spark, sf, "documents").select("doc_id", "source", F.coalesce("text", F.lit("")).alias("t"))
    one = d.select("source", "doc_id", F.size(X.space_words(F.col("t"))).alias("words"), F.length("t").alias("chars"), F.sha2("t", 256).alias("h"))
    tree = lambda what, order: F.sha2(F.expr(f"listagg({what}, '') within group (order by {order})"), 256)
    counts = [F.sum("docs").alias("docs"), F.sum("words").alias("words"), F.sum("chars").alias("chars")]
    leaf = one.groupBy("source", F.floor(F.col("doc_id") / LEAF_DOCS).alias("leaf")).agg(
        F.count(F.lit(1)).alias("docs"), F.sum("words").alias("words"), F.sum("chars").alias("chars"), tree("h", "doc_id").alias("h"))
    branch = leaf.groupBy("source", F.floor(F.col("leaf") / LEAF_DOCS).alias("branch")).agg(*counts, tree("h", "leaf").alias("h"))
    return branch.groupBy("source").agg(*counts, tree("h", "branch").alias("content_hash"))


def lang_breakdown_map(spark, sf):
    counts = table(spark, sf, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("source").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("lang", "n"))))).alias("langs"))


def corpus_manifest(spark, sf):
    name = F.element_at(F.array(*map(F.lit, _LICENSES)), (F.substring("source", 4, 9).cast("int") % 7 + 1))
    d = table(spark, sf, "documents").select(name.alias("license"), F.size(X.space_words(F.coalesce("text", F.lit("")))).alias("words"), "source")
    d = d.withColumn("ships", C.license_status(F.col("license")) == "CLEAN")
    return d.agg(
        F.count(F.lit(1)).alias("docs"), F.sum("words").alias("words"), F.sum(F.when(~F.col("ships"), F.col("words")).otherwise(0)).alias("blocked_words"),
        F.countDistinct(F.when(~F.col("ships"), F.col("source"))).alias("blocked_sources"), F.bool_and("ships").alias("all_ship"),
    )


def clean_funnel(spark, sf):
    """Rows that each stage of cleaning leaves: quality, exact dedup, decontamination.

    Signals are made once; what follows reads an id, a hash and a verdict a document.
    """
    from lakeloom.operators.dedup import contaminated, need_checkpoint_folder

    docs = _signals(spark, sf)
    need_checkpoint_folder(docs)
    facts = docs.select("doc_id", F.sha2("text", 256).alias("h"), F.col("fail_reason").isNull().alias("good")).checkpoint()
    first = facts.filter("good").groupBy("h").agg(F.min("doc_id").alias("doc_id"))
    bad = contaminated(table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "benchmark"), 10, 2).select("doc_id", F.lit(True).alias("bad"))
    kept = first.join(bad, "doc_id", "left").agg(F.count(F.lit(1)).alias("first"), F.count_if(F.col("bad").isNull()).alias("clean"))
    counts = facts.agg(F.count(F.lit(1)).alias("input"), F.count_if("good").alias("quality")).join(kept, how="cross")  # one row each
    stages = [("input", "input"), ("quality", "quality"), ("exact_dedup", "first"), ("decontaminate", "clean")]
    rows = F.array(*[F.struct(F.lit(i).alias("step"), F.lit(n).alias("stage"), F.col(c).alias("docs")) for i, (n, c) in enumerate(stages)])
    return counts.select(F.explode(rows).alias("r")).select("r.*")


_GRAMS = r"CASE WHEN len(w) >= @n THEN list_distinct(list_transform(range(1, len(w) - (@n - 2)), lambda i: array_to_string(list_slice(w, i, i + @n - 1), ' '))) ELSE [] END"
FUNNEL_SQL = rf"""WITH {SIGNALS_SQL}, good AS (SELECT * FROM v WHERE fail_reason IS NULL),
first AS (SELECT min(doc_id) AS doc_id FROM good GROUP BY text),
bench AS (SELECT DISTINCT unnest({_GRAMS.replace('@n', '10')}) AS g FROM (SELECT regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+') AS w FROM benchmark)),
dg AS (SELECT doc_id, unnest({_GRAMS.replace('@n', '10')}) AS g FROM (SELECT doc_id, regexp_extract_all(text, '[^ \t\n\x0B\f\r]+') AS w FROM good)),
bad AS (SELECT doc_id FROM dg JOIN bench USING (g) GROUP BY doc_id HAVING count(*) >= 2)
SELECT 0 AS step, 'input' AS stage, (SELECT count(*) FROM documents) AS docs UNION ALL
SELECT 1, 'quality', (SELECT count(*) FROM good) UNION ALL
SELECT 2, 'exact_dedup', (SELECT count(*) FROM first) UNION ALL
SELECT 3, 'decontaminate', (SELECT count(*) FROM first WHERE doc_id NOT IN (SELECT doc_id FROM bad))"""

_PII_SQL = "coalesce(text, '') || CASE WHEN doc_id % 5 = 0 THEN ' call +91 9876543210 or ravi@example.co.in ' ELSE '' END"


def _pii_steps():
    t, found = "t", []
    for name, pattern, replacement in C.PII_RULES:
        found.append((name, f"len(regexp_extract_all({t}, '{pattern}'))"))
        t = f"regexp_replace({t}, '{pattern}', '{replacement}', 'g')"
    return found, t


_PII_COUNTS, _PII_CLEAN = _pii_steps()
_STATUS_SQL = (
    "CASE WHEN coalesce(license, '') = '' THEN 'BLOCKED_MISSING' WHEN license IN " + str(C.COPYLEFT_LICENSES)
    + " THEN 'BLOCKED_COPYLEFT' WHEN lower(license) IN " + str(C.ALLOWED_LICENSES) + " THEN 'CLEAN' ELSE 'BLOCKED_UNKNOWN' END"
)

QUERIES = {
    "clean_funnel": (clean_funnel, FUNNEL_SQL),
    "doc_quality_signals": (doc_quality_signals, f"WITH {SIGNALS_SQL} SELECT {', '.join(_SIGNAL_COLUMNS)} FROM q"),
    "quality_fail_reasons": (quality_fail_reasons, f"WITH {SIGNALS_SQL} SELECT coalesce(fail_reason, 'kept') AS reason, count(*) AS docs FROM v GROUP BY 1"),
    "quality_by_lang": (quality_by_lang, f"WITH {SIGNALS_SQL} SELECT lang, count(*) AS docs, count(*) FILTER (fail_reason IS NULL) AS kept, sum(n_words)::BIGINT AS words FROM v GROUP BY lang"),
    "quality_features": (quality_features, f"WITH {SIGNALS_SQL} SELECT doc_id, n_words, coalesce(terminal_lines / nullif(n_lines, 0), 1.0) AS terminal_ratio, coalesce(duplicate_lines / nullif(n_lines, 0), 0.0) AS duplicate_ratio FROM v"),
    "quality_median_tier": (quality_median_tier, r"""WITH d AS (SELECT doc_id, lang, length(coalesce(text, '')) AS n, length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) + 1 AS lines,
  len(regexp_extract_all(coalesce(text, ''), '\p{L}')) AS letters, len(regexp_extract_all(coalesce(text, ''), '[A-Za-zªºÀ-ÖØ-öø-ɏ]')) AS latin FROM documents),
s AS (SELECT doc_id, lang, n, round((latin / letters) * (0.5::DOUBLE + 0.3::DOUBLE * least(1.0::DOUBLE, n / 800.0::DOUBLE) + 0.2::DOUBLE * least(1.0::DOUBLE, n / lines / 200.0::DOUBLE)), 6) AS score FROM d WHERE letters > 0),
m AS (SELECT lang, score AS median FROM (SELECT lang, score, row_number() OVER (PARTITION BY lang ORDER BY score) AS rn, count(*) OVER (PARTITION BY lang) AS c FROM s) WHERE rn = c // 2 + 1)
SELECT doc_id, score, CASE WHEN score >= median THEN 'verified' ELSE 'unverified' END AS tier, CASE WHEN n >= 2400 THEN 'long_context' ELSE coalesce(s.lang, 'none') END AS lane
FROM s JOIN m ON s.lang IS NOT DISTINCT FROM m.lang"""),
    "label_confusion": (label_confusion, f"""WITH {SIGNALS_SQL}, j AS (SELECT quality AS t, (fail_reason IS NULL)::INT AS g FROM v JOIN labels USING (doc_id)),
c AS (SELECT count(*) FILTER (t = 1 AND g = 1) AS tp, count(*) FILTER (t = 0 AND g = 1) AS fp, count(*) FILTER (t = 1 AND g = 0) AS fn, count(*) FILTER (t = 0 AND g = 0) AS tn FROM j)
SELECT *, (tp + tn) / nullif(tp + fp + fn + tn, 0) AS accuracy, tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall, 2 * tp / nullif(2 * tp + fp + fn, 0) AS f1 FROM c"""),
    "label_join_missing": (label_join_missing, "SELECT count(*) AS labels, count(*) FILTER (lang IS NULL) AS missing FROM (SELECT CASE WHEN doc_id % 3 = 0 THEN -doc_id - 1 ELSE doc_id END AS doc_id FROM labels) LEFT JOIN documents USING (doc_id)"),
    "lang_script_profile": (lang_script_profile, r"SELECT lang, sum(len(regexp_extract_all(text, '\p{L}')))::BIGINT AS letters, sum(len(regexp_extract_all(text, '[A-Za-z]')))::BIGINT AS ascii_letters, sum(len(regexp_extract_all(text, '[À-ÖØ-öø-ÿ]')))::BIGINT AS marked_letters FROM documents GROUP BY lang"),
    "langid_mismatch": (langid_mismatch, _detect_sql()),
    "faithful_units_by_lang": (faithful_units_by_lang, r"SELECT lang, sum(len(regexp_extract_all(text, '[\p{L}\p{M}\p{N}]+|[^\s\p{L}\p{M}\p{N}]')))::BIGINT AS units, sum(len(regexp_extract_all(text, '[\p{L}\p{M}\p{N}]+')))::BIGINT AS words FROM documents GROUP BY lang"),
    "word_count_hist": (word_count_hist, r"SELECT len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+')) // 100 AS bucket, count(*) AS docs FROM documents GROUP BY 1"),
    "glued_words": (glued_words, r"SELECT lang, sum(len(regexp_extract_all(text, '[\p{L}\p{M}]+(?:[''’-][\p{L}\p{M}]+)?')))::BIGINT AS glued FROM documents GROUP BY lang"),
    "noise_inventory": (noise_inventory, f"WITH d AS (SELECT lang, {_NOISY_SQL} AS t FROM documents), n AS (" + " UNION ALL ".join(f"SELECT lang, '{n}' AS noise, length(t) - length(replace(t, chr({cp}), '')) AS n FROM d" for cp, n in C.NOISE.items()) + ") SELECT lang, noise, sum(n)::BIGINT AS n FROM n WHERE n > 0 GROUP BY ALL"),
    "whitespace_normalized_hash": (whitespace_normalized_hash, f"WITH d AS (SELECT doc_id, {_NOISY_SQL} AS t FROM documents), c AS (SELECT doc_id, t, {_SPACE_SQL.replace('CLEAN', _STRIP_SQL)} AS c FROM d) SELECT doc_id, sha256(c) AS hash, length(c) AS n_chars, len(regexp_extract_all(t, '[\\x{{200C}}\\x{{200D}}]')) AS joiners FROM c"),
    "char_shrink": (char_shrink, f"WITH d AS (SELECT lang, coalesce(text, '') AS t FROM documents) SELECT lang, sum(length(t))::BIGINT AS before, sum(length({_SPACE_SQL.replace('CLEAN', 't')}))::BIGINT AS after FROM d GROUP BY lang"),
    "canonical_hash": (canonical_hash, r"SELECT doc_id, sha256(nfc_normalize(regexp_replace(coalesce(text, '') || chr(13) || chr(10) || 'e' || chr(769) || chr(13), '\r\n?', chr(10), 'g'))) AS hash FROM documents"),
    "framed_hash": (framed_hash, "SELECT doc_id, sha256(strlen(coalesce(source, '')) || chr(31) || coalesce(source, '') || chr(30) || strlen(coalesce(text, '')) || chr(31) || coalesce(text, '') || chr(30)) AS hash FROM documents"),
    "ghost_unify": (ghost_unify, _ghost_sql()),
    "html_tag_counts": (html_tag_counts, f"SELECT page_id, len(regexp_extract_all(html, '{C.TAG}')) AS tags, len(regexp_extract_all(html, '{C.ENTITY}')) AS entities, sha256(regexp_replace(html, '{C.TAG}', ' ', 'g')) AS stripped FROM pages"),
    "html_strip_boilerplate": (html_strip_boilerplate, f"""WITH d AS (SELECT page_id, string_split('Home' || chr(10) || html || chr(10) || ' Privacy Policy ' || chr(10) || 'Terms of Use' || chr(10) || 'read more!', chr(10)) AS l FROM pages WHERE html IS NOT NULL)
SELECT page_id, len(list_filter(l, lambda x: regexp_matches(trim(x), '(?i){C.BOILERPLATE}'))) AS dropped, sha256(array_to_string(list_filter(l, lambda x: NOT regexp_matches(trim(x), '(?i){C.BOILERPLATE}')), chr(10))) AS hash FROM d"""),
    "page_visible_text": (page_visible_text, r"""WITH d AS (SELECT page_id, length(html) AS n, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>', '', 'g'), '(?is)<style.*?</style>', '', 'g'), '(?is)<!--.*?-->|<meta[^>]*>', '', 'g'), '(?s)<[^>]*>', ' ', 'g'), '[ \t\n\r]+', ' ', 'g')) AS t FROM pages WHERE html IS NOT NULL)
SELECT page_id, sha256(t) AS hash, length(t) AS visible, n - length(t) AS gap FROM d"""),
    "link_absolutize": (link_absolutize, """WITH d AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages WHERE html IS NOT NULL)
SELECT page_id, CASE WHEN href LIKE '//%' THEN 'https:' || href WHEN href LIKE './%' THEN 'https://wiki.example/' || substr(href, 3) WHEN href LIKE '/%' THEN 'https://wiki.example' || href ELSE href END AS link, count(*) AS n FROM d GROUP BY ALL"""),
    "page_title_lang": (page_title_lang, """WITH d AS (SELECT regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, 'lang="([a-z]*)"', 1) AS lang FROM pages WHERE html IS NOT NULL)
SELECT lang, count(*) AS pages, count(nullif(title, '')) AS titled, min(title) AS first_title FROM d GROUP BY lang"""),
    "markdown_tidy": (markdown_tidy, r"""SELECT doc_id, sha256(regexp_replace(regexp_replace(replace(text || chr(160) || 'a  ' || repeat(chr(10), 6) || 'b ' || chr(9), chr(160), ' '), '(?m)[ \t]+$', '', 'g'), '\n{4,}', repeat(chr(10), 3), 'g')) AS hash FROM documents WHERE text IS NOT NULL"""),
    "markup_outside_code": (markup_outside_code, None),
    "pii_counts_by_type": (pii_counts_by_type, f"WITH d AS (SELECT {_PII_SQL} AS t FROM documents), n AS (" + " UNION ALL ".join(f"SELECT '{k}' AS kind, {v} AS n FROM d" for k, v in _PII_COUNTS) + ") SELECT kind, sum(n)::BIGINT AS found, count(*) FILTER (n > 0) AS docs FROM n GROUP BY kind"),
    "pii_redacted_hash": (pii_redacted_hash, f"WITH d AS (SELECT doc_id, {_PII_SQL} AS t FROM documents) SELECT doc_id, sha256({_PII_CLEAN}) AS hash, {_PII_CLEAN} <> t AS changed FROM d"),
    "admission_pii": (admission_pii, None),
    "pii_coverage": (pii_coverage, "SELECT sum(least(length(coalesce(text, '')), 1000))::BIGINT AS scanned, sum(length(coalesce(text, '')))::BIGINT AS chars, count(*) FILTER (length(coalesce(text, '')) > 1000) AS longer FROM documents"),
    "license_gate": (license_gate, f"WITH d AS (SELECT {list(_LICENSES)}[doc_id % 7 + 1] AS license, length(text) AS n FROM documents) SELECT license, {_STATUS_SQL} AS status, count(*) AS docs, sum(n)::BIGINT AS chars FROM d GROUP BY ALL"),
    "source_manifest": (source_manifest, r"""WITH d AS (SELECT source, doc_id, len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+')) AS words, length(coalesce(text, '')) AS chars, sha256(coalesce(text, '')) AS h FROM documents),
l AS (SELECT source, doc_id // 256 AS leaf, count(*) AS docs, sum(words) AS words, sum(chars) AS chars, sha256(string_agg(h, '' ORDER BY doc_id)) AS h FROM d GROUP BY ALL),
b AS (SELECT source, leaf // 256 AS branch, sum(docs) AS docs, sum(words) AS words, sum(chars) AS chars, sha256(string_agg(h, '' ORDER BY leaf)) AS h FROM l GROUP BY ALL)
SELECT source, sum(docs)::BIGINT AS docs, sum(words)::BIGINT AS words, sum(chars)::BIGINT AS chars, sha256(string_agg(h, '' ORDER BY branch)) AS content_hash FROM b GROUP BY source"""),
    "lang_breakdown_map": (lang_breakdown_map, """WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL) SELECT source, '{' || string_agg('"' || lang || '":' || n, ',' ORDER BY lang) || '}' AS langs FROM c GROUP BY source"""),
    "corpus_manifest": (corpus_manifest, rf"WITH d AS (SELECT {list(_LICENSES)}[substr(source, 4)::INT % 7 + 1] AS license, len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+')) AS words, source FROM documents), s AS (SELECT *, {_STATUS_SQL} = 'CLEAN' AS ships FROM d) SELECT count(*) AS docs, sum(words)::BIGINT AS words, sum(CASE WHEN ships THEN 0 ELSE words END)::BIGINT AS blocked_words, count(DISTINCT CASE WHEN NOT ships THEN source END) AS blocked_sources, bool_and(ships) AS all_ship FROM s"),
}
