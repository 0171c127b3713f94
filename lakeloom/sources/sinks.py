"""Sinks: immutable shards with manifests, JSON lines in canonical order, append-only ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.operators import cleaning as C


class ShardConflictError(ValueError):
    """A shard exists with other content, or holds rows that must never be trained on."""


def write_jsonl(df: DataFrame, path: str, order: str = "doc_id") -> None:
    """JSON lines with sorted keys, nulls kept, rows ordered by a unique column."""
    row = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    df.orderBy(order).select(row.alias("value")).write.text(path)


def shard_manifest(df: DataFrame) -> DataFrame:
    """(shard, docs, tokens, content_hash): a hash over the shard's ordered document hashes."""
    one = df.select("shard", "doc_id", F.size("tokens").alias("n"), F.sha2(F.concat_ws(",", "doc_id", F.col("tokens").cast("array<string>")), 256).alias("h"))
    return one.groupBy("shard").agg(
        F.count(F.lit(1)).alias("docs"), F.sum("n").alias("tokens"), F.sha2(F.expr("listagg(h, '') within group (order by doc_id)"), 256).alias("content_hash"),
    )


def write_shards(df: DataFrame, path: str) -> DataFrame:
    """Add the shards of df (shard, doc_id, tokens, never_train) that are not there yet; gives the manifest.

    A shard that exists with the same content is left alone; other content, or any row marked
    never_train, is refused before anything is written.
    """
    spark = df.sparkSession
    if not df.filter("never_train").isEmpty():
        raise ShardConflictError("never_train rows cannot be sharded")
    new = shard_manifest(df)
    known = read_manifest(spark, path)
    if known is None:
        fresh = new
    else:
        old = known.select(F.col("shard").alias("_s"), F.col("content_hash").alias("_h"))
        both = new.join(old, F.col("shard") == F.col("_s"), "left")
        if not both.filter("_h <> content_hash").isEmpty():
            raise ShardConflictError("a shard exists with other content")
        fresh = both.filter("_h is null").drop("_s", "_h")
    fresh = fresh.persist()
    df.join(fresh.select("shard"), "shard", "left_semi").select("shard", "doc_id", "tokens").write.mode("append").partitionBy("shard").parquet(f"{path}/shards")
    fresh.write.mode("append").parquet(f"{path}/manifest")
    fresh.unpersist()
    return read_manifest(spark, path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame | None:
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(f"{path}/manifest")
    except AnalysisException:
        return None


def verify_shards(spark: SparkSession, path: str) -> DataFrame:
    """Shards whose stored content no longer matches the manifest."""
    now = shard_manifest(spark.read.parquet(f"{path}/shards").select(F.col("shard").cast("string").alias("shard"), "doc_id", "tokens"))
    then = read_manifest(spark, path).select(F.col("shard").cast("string").alias("_s"), F.col("content_hash").alias("_h"))
    return then.join(now, F.col("shard") == F.col("_s"), "left").filter(~F.col("content_hash").eqNullSafe(F.col("_h"))).select(F.col("_s").alias("shard"))


MANIFEST_FIELDS = ("shard", "docs", "tokens", "license", "language", "content_hash")


def admission_reasons(manifest: DataFrame) -> DataFrame:
    """manifest with the array of reasons against a shard: missing fields, licences, no documents."""
    reasons = [F.when(F.col(c).isNull(), F.lit(f"missing_{c}")) for c in MANIFEST_FIELDS]
    parts = F.split(F.regexp_replace(F.coalesce("license", F.lit("")), "^MIXED:", ""), r"\+")
    blocked = F.exists(parts, lambda p: C.license_status(p) != "CLEAN")
    reasons += [F.when(F.col("license").isNotNull() & blocked, F.lit("license_blocked")), F.when(F.col("docs") <= 0, F.lit("no_documents"))]
    out = manifest.withColumn("reasons", F.array_compact(F.array(*reasons)))
    return out.withColumn("admitted", F.size("reasons") == 0)


def append_once(df: DataFrame, batch_id: int, path: str) -> None:
    """Append a micro-batch under its id; a batch that is written again replaces itself."""
    df.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def truncate_ledger(spark: SparkSession, path: str, target: str, below: int) -> None:
    """A copy of a ledger with the offsets below a bound: the state to resume from."""
    spark.read.parquet(path).filter(F.col("offset") < below).write.parquet(target)


def write_schedule(steps: DataFrame, path: str) -> None:
    """A compiled schedule beside an index of where each phase starts, stops and how many tokens it asks for."""
    steps.write.mode("overwrite").parquet(f"{path}/schedule")
    index = steps.groupBy("phase").agg(F.min("step").alias("first"), F.max("step").alias("last"), F.sum("tokens").alias("tokens"))
    index.coalesce(1).write.mode("overwrite").json(f"{path}/index")


def write_traces(rows: DataFrame, windows: list[tuple[int, int]], most: int, path: str) -> DataFrame:
    """Rows whose step lies in a window, at most `most` a window by offset, as a trace; gives aggregates over all rows.

    What a trace leaves out is left out of it alone: the aggregates are always complete.
    """
    from pyspark.sql import Window

    ranges = rows.sparkSession.createDataFrame([(i, a, z) for i, (a, z) in enumerate(windows)], "k int, low long, high long")
    hit = rows.join(F.broadcast(ranges), (F.col("low") <= F.col("step")) & (F.col("step") < F.col("high")))  # a row a window
    rn = F.row_number().over(Window.partitionBy("k").orderBy("offset"))
    hit.withColumn("rn", rn).filter(F.col("rn") <= most).drop("low", "high", "rn").write.mode("overwrite").partitionBy("k").parquet(path)
    return rows.groupBy("lane").agg(F.count(F.lit(1)).alias("n"), F.sum("loss").alias("loss"))


def export_vocabulary(spark: SparkSession, tokens: list[tuple[int, str, str]], path: str) -> None:
    """(id, kind, token) rows as JSON lines and, one token a line in order of id, as text."""
    df = spark.createDataFrame(tokens, "id long, kind string, token string").coalesce(1).sortWithinPartitions("id")
    df.write.mode("overwrite").json(f"{path}/json")
    df.select(F.regexp_replace("token", "\n", "\\\\n").alias("value")).write.mode("overwrite").text(f"{path}/text")


def save_checkpoint(state: DataFrame, step: int, path: str, keep: int = 3, pinned: tuple[int, ...] = ()) -> list[int]:
    """Save a state under its step with the hash of its rows; of the others the newest `keep` and pinned ones stay. Gives the steps that are there.

    A step is listed only once its marker file is written, so that a half-written one is never loaded.
    """
    spark = state.sparkSession
    state.write.mode("overwrite").parquet(f"{path}/step={step}/state")
    spark.createDataFrame([(step, state_hash(spark.read.parquet(f"{path}/step={step}/state")))], "step long, hash string").coalesce(1).write.mode("overwrite").json(f"{path}/step={step}/marker")
    steps = list_checkpoints(spark, path)
    stay = {*steps[-keep:], *pinned}
    folder = spark._jvm.org.apache.hadoop.fs.Path
    for old in steps:
        if old not in stay:
            at = folder(f"{path}/step={old}")
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return [s for s in steps if s in stay]


def state_hash(state: DataFrame) -> str:
    """A hash over all rows in any order: the sum of their hashes, and their number."""
    row = F.xxhash64(*[F.col(c).cast("string") for c in sorted(state.columns)])
    total = state.agg(F.sum(row.cast("decimal(38,0)")).alias("s"), F.count(F.lit(1)).alias("n")).first()
    return f"{total.s}:{total.n}"


def list_checkpoints(spark: SparkSession, path: str) -> list[int]:
    """Steps whose marker is complete, in order."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/step=*/marker/_SUCCESS")
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at) or []
    return sorted(int(f.getPath().getParent().getParent().getName().split("=")[1]) for f in found)


def load_checkpoint(spark: SparkSession, path: str, step: int | None = None) -> DataFrame:
    """The state of a step, or of the latest; a state that does not match its hash is refused."""
    step = list_checkpoints(spark, path)[-1] if step is None else step
    state = spark.read.parquet(f"{path}/step={step}/state")
    if spark.read.schema("step long, hash string").json(f"{path}/step={step}/marker").first().hash != state_hash(state):
        raise ShardConflictError(f"checkpoint {step} does not match its hash")
    return state
