"""File sources with explicit schemas: JSON lines with a torn tail, text corpora, pages of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOCUMENT = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])


class TornFileError(ValueError):
    """A line other than the last of a file is not valid JSON."""


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType = DOCUMENT, tolerate_torn_tail: bool = False) -> DataFrame:
    """Rows of JSON-lines files; blank lines are skipped.

    A line that is not valid JSON fails the read, unless a torn tail is tolerated: then the last
    line of a file may be cut off and is left out, and any other bad line still fails.
    """
    if not tolerate_torn_tail:
        return spark.read.schema(schema).json(path, mode="FAILFAST")
    # A file's lines lie in blocks that tasks read in order; the last line is the last of the file's last block.
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), place.alias("place")).filter(F.trim("value") != "")
    parsed = lines.withColumn("row", F.from_json("value", T.StructType([*schema.fields, T.StructField("_bad", T.StringType())]), {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"}))
    bad = parsed.filter("row._bad is not null").groupBy("file").agg(F.min("place").alias("bad_at"))
    last = lines.groupBy("file").agg(F.max("place").alias("last_at"))
    if not bad.join(last, "file").filter("bad_at < last_at").isEmpty():
        raise TornFileError(path)
    return parsed.filter("row._bad is null").select(*[F.col(f"row.{f.name}").alias(f.name) for f in schema.fields])


def has_torn_tail(spark: SparkSession, path: str) -> DataFrame:
    """(file, torn): whether a file ends without a line end."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.col("_metadata.file_path").alias("file"), (~F.col("value").endswith("\n") & (F.col("value") != "")).alias("torn"))


def scan_artifacts(spark: SparkSession, folders: list[str], pattern: str = "*.jsonl") -> DataFrame:
    """(file, n_lines, n_bytes) of the files of a pattern in folders, of which any may be missing or empty."""
    schema = "file string, n_lines long, n_bytes long"
    out = spark.createDataFrame([], schema)
    hadoop = spark._jsc.hadoopConfiguration()
    for folder in folders:
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{pattern}")
        found = at.getFileSystem(hadoop).globStatus(at)
        if found is None or not len(found):
            continue
        lines = spark.read.text(f"{folder}/{pattern}").select(F.col("_metadata.file_path").alias("file"), F.octet_length("value").alias("b"))
        sizes = spark.createDataFrame([(f.getPath().toString(), f.getLen()) for f in found], "path string, n_bytes long")  # names of a folder's files
        name = F.element_at(F.split("path", "/"), -1)
        counts = lines.groupBy(F.element_at(F.split("file", "/"), -1).alias("file")).agg(F.count(F.lit(1)).alias("n_lines"))
        out = out.unionByName(sizes.select(name.alias("file"), "n_bytes").join(counts, "file", "left").select("file", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), "n_bytes"))
    return out


def seed_results(spark: SparkSession, folder: str, stem: str, schema: str) -> DataFrame:
    """Rows of the JSON results <stem>_seed<number>.json of a folder, each with its seed."""
    rows = spark.read.schema(schema).json(f"{folder}/{stem}_seed*.json", multiLine=True)
    return rows.withColumn("seed", F.regexp_extract(F.col("_metadata.file_path"), r"_seed(\d+)\.json$", 1).cast("long"))


def stream_jsonl(spark: SparkSession, folder: str, schema: T.StructType = DOCUMENT) -> DataFrame:
    return spark.readStream.schema(schema).json(folder)


def read_tree_hash(spark: SparkSession, path: str) -> DataFrame:
    """One hash over the names and contents of a folder's files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    one = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("h"))
    return one.agg(F.count(F.lit(1)).alias("files"), F.sha2(F.expr("listagg(concat(name, ':', h), '\n') within group (order by name, h)"), 256).alias("hash"))


def blank_line_documents(df: DataFrame, least: int = 120) -> DataFrame:
    """Paragraphs of text files as documents; short ones and == headers == are left out."""
    parts = df.select(F.posexplode(F.split("value", r"\n[ \t]*\n")).alias("k", "part")).withColumn("part", F.trim("part"))
    return parts.filter((F.length("part") >= least) & ~F.col("part").rlike("^==.*==$"))


def python_units(source: str) -> list[str]:
    """Top-level functions, classes and decorated units of a source text, in order."""
    import re

    starts = [m.start() for m in re.finditer(r"(?m)^(?:def |class |async def |@\w)", source)]
    units, at = [], 0
    while at < len(starts):
        stop = at + 1
        while source[starts[stop - 1]] == "@" and stop < len(starts):
            stop += 1
        end = starts[stop] if stop < len(starts) else len(source)
        units.append(source[starts[at] : end].rstrip())
        at = stop
    return units
