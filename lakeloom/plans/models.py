"""Queries that fit or apply a model, or need kernels that SQL has not: rows are checked by tests."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lakeloom.functions import vectors as V
from lakeloom.operators import quality as Q
from lakeloom.session import table

FEATURES = ["n_words", "mean_length", "symbol_ratio", "terminal_ratio", "duplicate_ratio", "stopword_hits", "compression_ratio"]


def _features(spark, sf):
    d = Q.with_signals(table(spark, sf, "documents")).filter("n_words > 0")
    ratio = lambda a, b, none: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(none))
    return d.withColumns({
        "mean_length": ratio("word_chars", "n_words", 0.0), "symbol_ratio": ratio("symbol_words", "n_words", 0.0), "terminal_ratio": ratio("terminal_lines", "n_lines", 1.0),
        "duplicate_ratio": ratio("duplicate_lines", "n_lines", 0.0), "compression_ratio": Q.compression_ratio("text"),
    })


def quality_split(spark, sf):
    """Labelled documents in two parts: of each label, in seeded order, four fifths to train, the rest to test."""
    d = table(spark, sf, "labels").select("doc_id", "quality").join(table(spark, sf, "documents").select("doc_id"), "doc_id")
    w = Window.partitionBy("quality")
    rn = F.row_number().over(w.orderBy(F.sha2(F.concat(F.lit("split|"), F.col("doc_id").cast("string")), 256)))
    d = d.withColumn("rn", rn).withColumn("n", F.count(F.lit(1)).over(w))
    return d.select("doc_id", "quality", F.when(F.col("rn") * 5 <= F.col("n") * 4, "train").otherwise("test").alias("part"))


def quality_model_scores(spark, sf):
    """A model fitted on all labelled documents, applied to all documents."""
    d = _features(spark, sf)
    model = Q.fit_quality_model(d.join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id"), FEATURES)
    return Q.score_quality(model, d).select("doc_id", "p_good", "is_good")


def quality_model_evaluation(spark, sf):
    """How a model fitted on the training part of the split judges the rest."""
    d = _features(spark, sf).join(quality_split(spark, sf), "doc_id")
    model = Q.fit_quality_model(d.filter("part = 'train'"), FEATURES)
    return Q.confusion(Q.score_quality(model, d.filter("part = 'test'")), F.col("quality"), F.col("is_good").cast("int"))


def compression_proxy(spark, sf):
    d = _features(spark, sf)
    return d.withColumn("reason", Q.fail_reason()).groupBy(F.col("compression_ratio").between(0.25, 0.85).alias("proxy_ok"), F.col("reason").isNull().alias("kept")).agg(F.count(F.lit(1)).alias("docs"))


def holographic_roundtrip(spark, sf):
    """Embeddings bound to a role and unbound again; the largest error per label."""
    role = F.array(*[F.lit(float(x)) for x in V.unit_role(5, 64)])
    e = table(spark, sf, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("v"))
    back = e.select("label", "v", V.unbind(V.bind("v", role), role).alias("b"))
    worst = F.aggregate(F.zip_with("v", "b", lambda x, y: F.abs(x - y)), F.lit(0.0), lambda a, x: F.greatest(a, x))
    return back.groupBy("label").agg(F.max(worst).alias("worst"))


def grapheme_counts(spark, sf):
    d = table(spark, sf, "documents").select("lang", V.graphemes(F.coalesce("text", F.lit(""))).alias("g"), F.length(F.coalesce("text", F.lit(""))).alias("n"))
    return d.groupBy("lang").agg(F.sum(F.size("g")).alias("graphemes"), F.sum("n").alias("code_points"))


QUERIES = {
    "quality_split": (quality_split, "WITH r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY sha256('split|' || doc_id)) AS rn, count(*) OVER (PARTITION BY quality) AS n FROM labels JOIN documents USING (doc_id)) SELECT doc_id, quality, CASE WHEN rn * 5 <= n * 4 THEN 'train' ELSE 'test' END AS part FROM r"),
    "quality_model_scores": (quality_model_scores, None),
    "quality_model_evaluation": (quality_model_evaluation, None),
    "compression_proxy": (compression_proxy, None),
    "holographic_roundtrip": (holographic_roundtrip, None),
    "grapheme_counts": (grapheme_counts, r"SELECT lang, sum(length_grapheme(coalesce(text, '')))::BIGINT AS graphemes, sum(length(coalesce(text, '')))::BIGINT AS code_points FROM documents GROUP BY lang"),
}
