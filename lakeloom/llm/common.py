"""Shared folder, lineage cuts and small helpers of the llm operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    Only a local master without that setting gets a temporary folder of its own; on a cluster an
    unset folder is an error, as a machine-local one would lose data.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="lakeloom-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/lakeloom-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, what: str) -> str:
    """A path for a table of this application; all of them lie in one folder of the shared one."""
    return f"{_folder(spark)}/{what}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def clean_up(spark: SparkSession) -> None:
    """Delete every table that operators of this application have written; their results must not be read after it."""
    remove(spark, _folder(spark))


def written(df: DataFrame, what: str, path: str | None = None, codec: str = "snappy") -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here and lost executors cost nothing.

    Tables stay until `clean_up`, as results read them; rounds of a loop give a path and remove it.
    """
    spark = df.sparkSession
    path = path or new_path(spark, what)
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """The wanted column names, each with as many underscores before it as keep it apart from df's, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def row_keyed(df: DataFrame, row_col: str = "_row") -> DataFrame:
    """df with a column that is not null, differs from row to row and grows with doc_id (null last).

    Where doc_id itself is so, it is the key. Otherwise rows are sorted by doc_id, digest of the text
    and the other columns, and written with their place in that order; the last term only spreads
    equal rows over tasks. The new column must be a free name of df.
    """
    row = F.col("doc_id").cast("long")
    counts = df.select(row.alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    if counts.filter("n > 1 or id is null").isEmpty():
        return df.withColumn(row_col, row)
    others = [F.col(f"`{f.name}`") for f in df.schema.fields if f.name not in ("doc_id", "text") and f.dataType.typeName() not in ("map", "variant")]
    ordered = df.orderBy(row.asc_nulls_last(), F.sha2(F.col("text"), 256), *others, F.monotonically_increasing_id())
    return written(ordered.withColumn(row_col, F.monotonically_increasing_id()), "rows")


def rows_of(df: DataFrame, decide) -> DataFrame:
    """The rows of df that `decide` keeps, with df's columns.

    decide(docs) gets (doc_id, text), doc_id being a key of each row as `row_keyed` makes it, and
    gives a frame whose column doc_id holds the keys to keep. Rows are so decided one by one, also
    where doc_id is null or repeated.
    """
    row, kept = free_names(df, "_row", "_kept")
    rows = row_keyed(df, row)
    keep = decide(rows.select(F.col(row).alias("doc_id"), "text")).select(F.col("doc_id").alias(kept)).distinct()
    return rows.join(keep, rows[row] == keep[kept], "left_semi").select(*[rows[f"`{c}`"] for c in df.columns])


#: Bits of a set over hashed keys: 4 MB, whatever the input.
FILTER_BITS = 1 << 25
#: Tasks among which a hot key is dealt, and the share of all rows (1 in HOT_KEYS) above which a key is hot.
SALTS, HOT_KEYS = 32, 500


def in_bit_set(rows: DataFrame, keys: DataFrame, key: str, flag: str = "in_set") -> DataFrame:
    """rows with a column `flag`: false only where rows.key is in no row of keys.key (long).

    The set has FILTER_BITS bits however large the input is, so it may be broadcast. It keeps rows
    out of the exact join that must follow; where it is nearly full it keeps fewer out.
    """
    slot, bucket, at, bits, byte = free_names(rows, "_slot", "_bucket", "_at", "_bits", "_byte")
    number = (F.pmod(F.xxhash64(key), F.lit(FILTER_BITS)) + 1).alias(slot)
    sets = keys.select(number).groupBy(F.bitmap_bucket_number(slot).alias(bucket)).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias(bits))
    placed = rows.withColumn(slot, number).withColumn(bucket, F.bitmap_bucket_number(slot)).withColumn(at, F.bitmap_bit_position(slot).cast("int"))
    value = F.conv(F.hex(F.substring(F.col(bits), (F.floor(F.col(at) / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = placed.join(F.broadcast(sets), bucket, "left").withColumn(byte, F.coalesce(value, F.lit(0)))
    return hit.select(*[F.col(f"`{c}`") for c in rows.columns], F.expr(f"(shiftright({byte}, {at} % 8) & 1) = 1").alias(flag))


def dealt_join(many: DataFrame, one: DataFrame, key: str, spread: str, counts: DataFrame, total: int, how: str = "inner") -> DataFrame:
    """many join one on key, where `one` has a row per key and a key of `many` may hold most of its rows.

    counts is (key, n) of `many`, total its rows. Keys with more than total / HOT_KEYS rows, of which
    there are fewer than HOT_KEYS, are broadcast; their rows are dealt by `spread` among SALTS tasks.
    """
    hot = F.broadcast(counts.filter(F.col("n") > max(1, total // HOT_KEYS)).select(key, F.lit(True).alias("_hot")))
    left = many.join(hot, key, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).otherwise(0)).drop("_hot")
    salts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    right = one.join(hot, key, "left").withColumn("_salt", F.explode(salts)).drop("_hot")
    return left.join(right.hint("merge"), [key, "_salt"], how).drop("_salt")


def map_texts(df: DataFrame, work, made: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns `keep` unchanged, and what `work` makes of each text, in Arrow batches.

    work(list of str or None) gives a dict of column name -> list or Arrow array; `made` is those
    columns' DDL. Kept columns pass through Arrow untouched, so that null or large ids stay as they
    are. A batch holds at most as many rows as spark.sql.execution.arrow.maxRecordsPerBatch.
    """
    from pyspark.sql import types as T

    out = T.StructType([df.schema[c] for c in keep] + list(T._parse_datatype_string(made).fields))
    kept = len(keep)
    # A text that is kept too is sent once.
    at_text = keep.index(text_col) if text_col in keep else kept

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(out)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):  # bounds what Python holds of long texts
                part = batch.slice(at, 512)
                new = work(part.column(at_text).to_pylist())
                columns = [part.column(i) for i in range(kept)]
                columns += [
                    x if isinstance(x, pa.Array) else pa.array(x, type=schema.field(name).type)
                    for name, x in ((f.name, new[f.name]) for f in out.fields[kept:])
                ]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    sent = [df[c] for c in keep] + ([df[text_col].alias("_text")] if at_text == kept else [])
    return df.select(*sent).mapInArrow(run, out)
