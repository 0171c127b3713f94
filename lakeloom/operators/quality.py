"""Quality signals, the ordered cascade of checks, and classifier evaluation."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeloom.operators import text as X

# Function words of prose.
ENGLISH_STOPWORDS = (
    "the", "a", "an", "and", "or", "but", "if", "then", "of", "to", "in", "on", "for", "with", "as", "by", "at", "from", "is", "are",
    "was", "were", "be", "been", "it", "this", "that", "these", "those", "you", "we", "they", "he", "she", "i", "not", "no", "can",
    "will", "would", "should", "could", "have", "has", "had", "do", "does", "did", "so", "than", "there", "here", "what", "which",
    "who", "how", "when", "where", "why", "all", "some", "any", "each",
)
FRENCH_STOPWORDS = ("le", "la", "les", "de", "des", "du", "et", "en", "un", "une", "que", "est", "pas", "pour", "dans", "au", "ou", "qui")
GERMAN_STOPWORDS = ("der", "die", "das", "und", "in", "den", "des", "zu", "ist", "nicht", "ein", "eine", "mit", "auf", "für", "von", "sich", "auch")
SPANISH_STOPWORDS = ("el", "la", "los", "las", "de", "y", "en", "un", "una", "que", "es", "no", "por", "con", "para", "del", "se", "su")
TELUGU_STOPWORDS = (
    "మరియు", "ఈ", "ఆ", "ఒక", "కూడా", "కాదు", "ఉంది", "లో", "కి", "కు", "నుండి", "తో", "కోసం", "కానీ", "అయితే", "వారు", "అతను", "ఆమె", "నేను",
    "మీరు", "మనం", "ఏమి", "ఎలా", "ఎప్పుడు", "ఎక్కడ", "ఎవరు", "అన్ని", "కొన్ని", "చాలా", "ఇది", "అది", "వద్ద", "పైన", "కింద", "మధ్య",
    "తర్వాత", "ముందు", "కాబట్టి", "కేవలం", "కనుక", "కూడా.",
)
STOPWORDS = {"en": ENGLISH_STOPWORDS, "fr": FRENCH_STOPWORDS, "de": GERMAN_STOPWORDS, "es": SPANISH_STOPWORDS}
STOPWORDS_BY_SCRIPT = {"telugu": TELUGU_STOPWORDS, "latin": ENGLISH_STOPWORDS}
TERMINAL = (".", "!", "?", "।")
STRIPPED = ".,!?।\"'()"
# Bounds of the cascade.
MIN_WORDS, MIN_MEAN_LENGTH, MAX_MEAN_LENGTH = 20, 1.5, 15.0
MAX_SYMBOL_RATIO, MAX_DUPLICATE_LINES, MIN_STOPWORDS, STOPWORD_WINDOW = 0.12, 0.35, 2, 250


# Weights and scales of the composite score, and the length from which a document is long.
SCORE_BASE, SCORE_LENGTH, SCORE_DENSITY, FULL_CHARS, FULL_LINE, LONG_CHARS = 0.5, 0.3, 0.2, 800.0, 200.0, 2400


def quality_score(purity: Column, chars: Column, lines: Column) -> Column:
    """Share of letters in the expected script, weighted by how long the text and its lines are; six decimals."""
    length = F.least(F.lit(1.0), chars / FULL_CHARS)
    density = F.least(F.lit(1.0), chars / lines / FULL_LINE)
    return F.round(purity * (F.lit(SCORE_BASE) + F.lit(SCORE_LENGTH) * length + F.lit(SCORE_DENSITY) * density), 6)


#: A word with a letter or digit, from its start: counted in one pass over the text.
WORDY = r"(?<![^ \t\n\x0B\f\r])[^ \t\n\x0B\f\r\p{L}\p{N}]*+[\p{L}\p{N}][^ \t\n\x0B\f\r]*+"


def stopword_list(lang: Column) -> Column:
    """The language's function words, English where it has none."""
    chosen = F.when(F.lit(False), F.array(F.lit("")))
    for name, words in STOPWORDS.items():
        chosen = chosen.when(lang == name, F.array(*map(F.lit, words)))
    return chosen.otherwise(F.array(*map(F.lit, ENGLISH_STOPWORDS)))


def with_signals(df: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """df with n_words, word_chars, symbol_words, n_lines, terminal_lines, duplicate_lines, stopword_hits.

    All are integers; ratios are left to the reader of the columns. Null text counts as empty.
    """
    step = df.withColumn("_t", F.coalesce(F.col(text), F.lit("")))
    step = step.withColumns({"_w": X.space_words(F.col("_t")), "_l": X.lines(F.col("_t"))})
    hits = F.filter(
        F.slice("_w", 1, STOPWORD_WINDOW), lambda w: F.array_contains(F.col("_s"), F.lower(F.regexp_replace(w, f"^[{STRIPPED}]+|[{STRIPPED}]+$", "")))
    )
    many = F.size("_l") >= 3
    return step.withColumn("_s", stopword_list(F.col(lang))).withColumns({
        "n_words": F.size("_w").cast("long"),
        "word_chars": F.aggregate("_w", F.lit(0).cast("long"), lambda a, w: a + F.length(w)),
        "symbol_words": (F.size("_w") - F.regexp_count("_t", F.lit(WORDY))).cast("long"),
        "n_lines": F.size("_l").cast("long"),
        "terminal_lines": F.when(many, F.size(F.filter("_l", lambda x: F.right(x, F.lit(1)).isin(*TERMINAL)))).cast("long"),
        "duplicate_lines": F.when(many, F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
        "stopword_hits": F.size(hits).cast("long"),
    }).drop("_t", "_w", "_l", "_s")


def fail_reason() -> Column:
    """The first check that a row with signals fails, or null."""
    mean = F.col("word_chars") / F.col("n_words")
    return (
        F.when(F.col("n_words") < MIN_WORDS, "too_short")
        .when(~mean.between(MIN_MEAN_LENGTH, MAX_MEAN_LENGTH), "mean_word_len_out_of_range")
        .when(F.col("symbol_words") / F.col("n_words") > MAX_SYMBOL_RATIO, "symbol_word_ratio_too_high")
        .when(F.col("duplicate_lines") / F.col("n_lines") > MAX_DUPLICATE_LINES, "duplicate_line_wall")
        .when(F.col("stopword_hits") < MIN_STOPWORDS, "too_few_stopwords")
    )


@F.pandas_udf(T.DoubleType())
def compression_ratio(text: pd.Series) -> pd.Series:
    """Bytes at zlib level 6 over UTF-8 bytes."""
    def ratio(t):
        raw = (t or "").encode("utf-8")
        return len(zlib.compress(raw, 6)) / max(len(raw), 1)

    return text.map(ratio)


def confusion(df: DataFrame, truth: Column, guess: Column) -> DataFrame:
    """One row of true and false positives and negatives, and the exact ratios built from them."""
    count = lambda c: F.count_if(c).cast("long")
    one = df.select(truth.alias("t"), guess.alias("g")).agg(
        count((F.col("t") == 1) & (F.col("g") == 1)).alias("tp"), count((F.col("t") == 0) & (F.col("g") == 1)).alias("fp"),
        count((F.col("t") == 1) & (F.col("g") == 0)).alias("fn"), count((F.col("t") == 0) & (F.col("g") == 0)).alias("tn"),
    )
    total = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    ratio = lambda a, b: F.try_divide(a.cast("double"), b.cast("double"))
    return one.withColumns({
        "accuracy": ratio(F.col("tp") + F.col("tn"), total),
        "precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")),
        "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn")),
        "f1": ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")),
    })


def fit_quality_model(df: DataFrame, features: list[str], label: str = "quality", bad_weight: float = 3.0):
    """Logistic regression on feature columns, the rarer bad class weighted; gives the fitted pipeline."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    weighted = df.withColumn("_weight", F.when(F.col(label) == 0, bad_weight).otherwise(1.0))
    stages = [
        VectorAssembler(inputCols=features, outputCol="_raw", handleInvalid="keep"),
        StandardScaler(inputCol="_raw", outputCol="_features", withMean=True),
        LogisticRegression(featuresCol="_features", labelCol=label, weightCol="_weight", maxIter=50, standardization=False, predictionCol="_prediction", rawPredictionCol="_score", probabilityCol="_p"),
    ]
    return Pipeline(stages=stages).fit(weighted)


def score_quality(model, df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """df with p_good and is_good."""
    from pyspark.ml.functions import vector_to_array

    scored = model.transform(df).withColumn("p_good", vector_to_array("_p")[1])
    return scored.withColumn("is_good", F.col("p_good") >= threshold).drop("_raw", "_features", "_score", "_p", "_prediction")
