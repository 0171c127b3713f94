"""Queries on scripts, names and function words, and on tokenizers trained in other ways."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeloom.functions import vectors as V
from lakeloom.operators import cleaning as C
from lakeloom.operators import quality as Q
from lakeloom.operators import text as X
from lakeloom.operators import tokenizer as K
from lakeloom.session import table

#: Sentences put behind the texts, by doc_id, so that other scripts occur.
PLANTED = ("నేను రాజు మరియు రాజేష్ ఇంటి నుండి వెంకటేష్ తో", "ನಾನು ಮನೆಯಲ್ಲಿ ಪುಸ್ತಕಗಳು ಮತ್ತು", "मैं घर में किताब और", "the house of a friend and", "అమ్మ చిన్ని బాబు కోసం శ్రీనివాస్ ఇల్లు")
#: Letter ranges by script.
RANGES = {"Devanagari": (0x0900, 0x097F), "Telugu": (0x0C00, 0x0C7F), "Kannada": (0x0C80, 0x0CFF), "Latin": (0x0041, 0x024F)}


def _planted(spark, sf):
    extra = F.element_at(F.array(*map(F.lit, PLANTED)), (F.col("doc_id") % len(PLANTED) + 1).cast("int"))
    return table(spark, sf, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit(" "), extra).alias("t"), extra.alias("extra"))


def script_purity(spark, sf):
    """Letters of each script's range, of all letters; marks are no letters."""
    d = _planted(spark, sf)
    each = [F.regexp_count("t", F.lit(f"[\\x{{{a:04X}}}-\\x{{{z:04X}}}&&\\p{{L}}]")).alias(name.lower()) for name, (a, z) in RANGES.items()]
    return d.select("doc_id", F.regexp_count("t", F.lit(r"\p{L}")).alias("letters"), *each)


def script_scheme(spark, sf):
    """Words by the script of their first character that is in a known Indic block."""
    d = _planted(spark, sf).select(F.explode(X.space_words(F.col("t"))).alias("w"))
    first = F.regexp_extract("w", r"([\x{0900}-\x{097F}\x{0C00}-\x{0CFF}])", 1)
    scheme = F.when(first == "", None).when(first < "\u0980", "DEVANAGARI").when(first < "\u0c80", "TELUGU").otherwise("KANNADA")
    return d.groupBy(scheme.alias("scheme")).agg(F.count(F.lit(1)).alias("words"))


def gazetteer_redaction(spark, sf):
    """Listed names found and replaced, the longest first, told apart as sure and as also being common words."""
    d = _planted(spark, sf).select("doc_id", "t", C.names_found(F.col("t")).alias("names"))
    doubtful = F.size(F.filter("names", lambda n: n.isin(*C.AMBIGUOUS_NAMES)))
    return d.select("doc_id", (F.size("names") - doubtful).alias("sure"), doubtful.alias("doubtful"), F.sha2(C.redact_names(F.col("t")), 256).alias("hash"))


def script_stopwords(spark, sf):
    """Function words of the list that the text's script chooses: Telugu if any Telugu letter stands in it, else Latin."""
    d = _planted(spark, sf).select("doc_id", "t", X.space_words(F.col("t")).alias("w"))
    script = F.when(F.col("t").rlike(r"[\x{0C00}-\x{0C7F}]"), "telugu").otherwise("latin")
    hits = lambda name: F.size(F.filter("w", lambda w: w.isin(*Q.STOPWORDS_BY_SCRIPT[name])))
    return d.select("doc_id", script.alias("script"), F.when(script == "telugu", hits("telugu")).otherwise(hits("latin")).alias("hits"))


def bpe_largest_tie(spark, sf):
    """Pieces after 50, 100 and 200 merges whose ties go to the largest pair: of all words and of distinct ones."""
    counts = K.pretoken_counts(table(spark, sf, "documents"))
    table_ = K.train_merges(counts, 200, ties="largest")
    out = None
    for n in (50, 100, 200):
        size = F.size(K.piece_udf(table_[:n])("token"))
        one = counts.select("freq", size.alias("n")).agg(F.sum(F.col("freq") * F.col("n")).alias("weighted"), F.sum("n").alias("distinct")).select(F.lit(n).alias("merges"), "weighted", "distinct")
        out = one if out is None else out.unionByName(one)
    return out


def bpe_graphemes(spark, sf):
    """Pieces per script when merging starts from user-perceived characters."""
    d = _planted(spark, sf).select(F.explode(X.pretokens(F.lower("t"))).alias("token"))
    counts = d.groupBy("token").agg(F.count(F.lit(1)).alias("freq"))
    pieces = F.size(K.piece_udf(K.train_merges(counts, 200, units="grapheme"), "grapheme")("token"))
    indic = F.col("token").rlike(r"[\x{0900}-\x{0CFF}]")
    return counts.select(indic.alias("indic"), "freq", pieces.alias("n")).groupBy("indic").agg(F.sum("freq").alias("words"), F.sum(F.col("freq") * F.col("n")).alias("pieces"))


def faithful_vocabulary(spark, sf):
    """Ids of a vocabulary of 1,000 by kind, trained with Spanish texts counted three times: bytes, letters, merges."""
    d = table(spark, sf, "documents").select("text", F.when(F.col("lang") == "es", 3).otherwise(1).alias("weight"))
    t = K.freeze(K.reversible_counts(d, weight="weight"), vocabulary=1000)
    kinds = [("byte", 256), ("letter", len(t.alphabet)), ("merge", len(t.ids) - len(t.alphabet))]
    return spark.createDataFrame(kinds, "kind string, ids long")


def profile_grid(spark, sf):
    """Pieces per pre-token of four profiles: moved to one script or not, endings split off or not."""
    d = _planted(spark, sf).select(F.explode(X.pretokens(F.lower("extra"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("freq"))
    out = None
    for transliterate in (False, True):
        for suffixes in (False, True):
            cut = F.pandas_udf(lambda words, a=transliterate, b=suffixes: words.map(lambda w: V.profiled(w, a, b)), T.ArrayType(T.StringType()))
            parts = d.select("freq", F.explode(cut("token")).alias("token")).groupBy("token").agg(F.sum("freq").alias("freq"))
            pieces = F.size(K.piece_udf(K.train_merges(parts, 40))("token"))
            one = parts.agg(F.count(F.lit(1)).alias("types"), F.sum("freq").alias("pretokens"), F.sum(F.col("freq") * pieces).alias("pieces"))
            one = one.select(F.lit(transliterate).alias("transliterate"), F.lit(suffixes).alias("suffixes"), "types", "pretokens", "pieces")
            out = one if out is None else out.unionByName(one)
    return out


def dedicated_fertility(spark, sf):
    """Pieces per word when each language trains a vocabulary of its own, by size and least pair count."""
    d = table(spark, sf, "documents").filter("lang is not null")
    out = None
    for lang in ("en", "fr", "de", "es"):
        mine = d.filter(F.col("lang") == lang)
        counts = K.pretoken_counts(mine)
        for least in (2, 50):
            merges = K.train_merges(counts, 200, min_freq=least)
            for size in (50, 200):
                one = K.fertility(mine, merges[:size]).select("lang", F.lit(least).alias("least"), F.lit(size).alias("size"), "words", "pieces")
                out = one if out is None else out.unionByName(one)
    return out


_PLANTED = f"p AS (SELECT doc_id, coalesce(text, '') || ' ' || {list(PLANTED)}[doc_id % {len(PLANTED)} + 1] AS t FROM documents)"
_LETTER = "len(list_filter(regexp_extract_all(t, '\\p{{L}}'), lambda c: unicode(c) BETWEEN {} AND {}))".format
_SPLIT = r"regexp_extract_all(t, '[^ \t\n\x0B\f\r]+')"

QUERIES = {
    "script_purity": (script_purity, f"WITH {_PLANTED} SELECT doc_id, len(regexp_extract_all(t, '\\p{{L}}')) AS letters, " + ", ".join(f"{_LETTER(a, z)} AS {n.lower()}" for n, (a, z) in RANGES.items()) + " FROM p"),
    "script_scheme": (script_scheme, rf"WITH {_PLANTED}, w AS (SELECT unnest({_SPLIT}) AS w FROM p), f AS (SELECT regexp_extract(w, '([\x{{0900}}-\x{{097F}}\x{{0C00}}-\x{{0CFF}}])', 1) AS c FROM w) SELECT CASE WHEN c = '' THEN NULL WHEN unicode(c) < 2432 THEN 'DEVANAGARI' WHEN unicode(c) < 3200 THEN 'TELUGU' ELSE 'KANNADA' END AS scheme, count(*) AS words FROM f GROUP BY 1"),
    "gazetteer_redaction": (gazetteer_redaction, f"WITH {_PLANTED}, n AS (SELECT doc_id, t, regexp_extract_all(t, '{C.name_pattern()}') AS n FROM p) SELECT doc_id, len(list_filter(n, lambda x: x NOT IN {C.AMBIGUOUS_NAMES})) AS sure, len(list_filter(n, lambda x: x IN {C.AMBIGUOUS_NAMES})) AS doubtful, sha256(regexp_replace(t, '{C.name_pattern()}', '{C.NAME_MARK}', 'g')) AS hash FROM n"),
    "script_stopwords": (script_stopwords, rf"WITH {_PLANTED}, w AS (SELECT doc_id, {_SPLIT} AS w, CASE WHEN regexp_matches(t, '[\x{{0C00}}-\x{{0C7F}}]') THEN 'telugu' ELSE 'latin' END AS script FROM p) SELECT doc_id, script, CASE script WHEN 'telugu' THEN len(list_filter(w, lambda x: x IN {Q.TELUGU_STOPWORDS})) ELSE len(list_filter(w, lambda x: x IN {Q.ENGLISH_STOPWORDS})) END AS hits FROM w"),
    "bpe_largest_tie": (bpe_largest_tie, None),
    "bpe_graphemes": (bpe_graphemes, None),
    "faithful_vocabulary": (faithful_vocabulary, None),
    "profile_grid": (profile_grid, None),
    "dedicated_fertility": (dedicated_fertility, None),
}
