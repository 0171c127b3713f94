"""Small fixtures shared by the tests of this folder."""

from pyspark.sql import types as T

DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
])


def documents(spark, texts, lang="en", source="s"):
    rows = [(i, t, lang, source, None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCUMENTS)


def saved(df, folder, name="documents"):
    """Write df as the table of a test input folder; gives the folder."""
    df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)
