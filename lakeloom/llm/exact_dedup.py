"""Exact dedup with cuckoo-filter indexes over digests of normalised texts.

Each map task puts its rows' digests into a cuckoo index and gives one partial group per digest;
the partial groups are dealt by digest, and an index per partition merges them. A group of any size
so reaches the second step as at most one row per task and flush. A fingerprint hit counts only
after the stored key in that bucket (the SHA-256 and length of the normalised text) is compared.
`LiveTexts` keeps such an index between runs: texts come in, and withdrawn documents go out of it.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dealt_join, documents, new_path, remove, rows_of, written

NAME = "op6_exact_dedup"

#: The characters deleted before comparison: space and U+0009 to U+000D.
WHITE = " \t\n\x0b\x0c\r"
#: A task gives out its groups when its index holds this many digests.
FLUSH_KEYS = 200_000
_NO_ID = 2**63 - 1

ORACLE_SQL = r"""
WITH n AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
), g AS (
  SELECT norm, count(*) AS group_size, first(doc_id ORDER BY length(t) DESC, doc_id) AS keep_id
  FROM n GROUP BY norm
)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.norm) AS text_sha256
FROM n JOIN g USING (norm)
"""


class CuckooIndex:
    """A cuckoo filter with four slots a bucket whose slots also hold their keys and values.

    Keys are digests of at least 16 bytes. A lookup compares 16-bit fingerprints in two buckets and
    then the stored keys. When an insertion finds no free slot after a bounded number of moves, the
    table doubles and is filled anew from the stored keys.
    """

    SLOTS, MOVES = 4, 200

    def __init__(self, buckets: int = 1024):
        self._mask = buckets - 1
        if buckets & self._mask:
            raise ValueError("buckets must be a power of two")
        self._marks: list[list[int]] = [[] for _ in range(buckets)]
        self._stored: list[list[tuple[bytes, object]]] = [[] for _ in range(buckets)]
        self._size = 0

    def __len__(self) -> int:
        return self._size

    def __iter__(self) -> Iterator[tuple[bytes, object]]:
        for bucket in self._stored:
            yield from bucket

    def _mark(self, key: bytes) -> int:
        return int.from_bytes(key[8:10], "little") or 1

    def _home(self, key: bytes) -> int:
        return int.from_bytes(key[:8], "little") & self._mask

    def _other(self, bucket: int, mark: int) -> int:
        return (bucket ^ (mark * 0x5BD1E995)) & self._mask

    def _find(self, key: bytes) -> tuple[int, int] | None:
        mark, home = self._mark(key), self._home(key)
        for bucket in (home, self._other(home, mark)):
            for slot, seen in enumerate(self._marks[bucket]):
                if seen == mark and self._stored[bucket][slot][0] == key:
                    return bucket, slot
        return None

    def get(self, key: bytes) -> object | None:
        at = self._find(key)
        return None if at is None else self._stored[at[0]][at[1]][1]

    def delete(self, key: bytes) -> bool:
        """Remove a live key; whether it was there."""
        at = self._find(key)
        if at is None:
            return False
        del self._marks[at[0]][at[1]], self._stored[at[0]][at[1]]
        self._size -= 1
        return True

    def insert(self, key: bytes, value: object) -> None:
        """Add a key that is not in the index."""
        entry, mark, bucket = (key, value), self._mark(key), self._home(key)
        self._size += 1
        for move in range(self.MOVES):
            for b in (bucket, self._other(bucket, mark)):
                if len(self._marks[b]) < self.SLOTS:
                    self._marks[b].append(mark)
                    self._stored[b].append(entry)
                    return
            bucket = self._other(bucket, mark)
            slot = move % self.SLOTS
            mark, self._marks[bucket][slot] = self._marks[bucket][slot], mark
            entry, self._stored[bucket][slot] = self._stored[bucket][slot], entry
        self._grow(entry)

    def _grow(self, left_over: tuple[bytes, object]) -> None:
        entries = [*self, left_over]
        self.__init__(2 * (self._mask + 1))
        for key, value in entries:
            self.insert(key, value)


def normalised(text: Column) -> Column:
    """The text without the characters of WHITE; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), WHITE, "")


def _merge(index: CuckooIndex, key: bytes, chars: int, owner: int, rows: int) -> None:
    known = index.get(key)
    if known is None:
        index.insert(key, (chars, owner, rows))
    elif (-chars, owner) < (-known[0], known[1]):  # the former owner's digest goes, the new one's is live
        index.delete(key)
        index.insert(key, (chars, owner, rows + known[2]))
    else:
        index.delete(key)
        index.insert(key, (known[0], known[1], rows + known[2]))


_PARTIAL = "digest binary, chars long, owner long, n_rows long"


def _batches(columns: list[list], schema):
    """Record batches of bounded length."""
    import pyarrow as pa

    for at in range(0, len(columns[0]), 10_000):
        yield pa.RecordBatch.from_arrays([pa.array(c[at : at + 10_000], f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _indexed(ordered: bool, flush: int):
    """A mapInArrow function that merges rows (digest, chars, owner, n_rows) in cuckoo indexes of about `flush` keys.

    If rows come in order of digest, a full index is given out before a digest that it lacks, so
    that each digest is given out once; otherwise whenever it is full.
    """

    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("digest", pa.binary()), ("chars", pa.int64()), ("owner", pa.int64()), ("n_rows", pa.int64())])
        index = CuckooIndex()

        def given():
            rows = list(index)
            return _batches([[k for k, _ in rows], *([v[i] for _, v in rows] for i in range(3))], schema)

        for batch in batches:
            for key, chars, owner, rows in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if len(index) >= flush and (not ordered or index.get(key) is None):
                    yield from given()
                    index = CuckooIndex()
                _merge(index, key, chars, owner, rows)
        yield from given()

    return run


def duplicate_groups(keyed: DataFrame) -> DataFrame:
    """(digest, chars, owner, n_rows) per digest, from rows of the same columns with n_rows 1."""
    partial = keyed.select("digest", "chars", "owner", "n_rows").mapInArrow(_indexed(False, FLUSH_KEYS), _PARTIAL)
    return partial.repartition("digest").sortWithinPartitions("digest").mapInArrow(_indexed(True, FLUSH_KEYS), _PARTIAL)


def keyed_rows(df: DataFrame) -> DataFrame:
    """(doc_id, digest, chars, owner, n_rows): digest of SHA-256 and length of the normalised text."""
    norm = normalised(F.col("text"))
    return df.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.concat(F.unhex(F.sha2(norm, 256)), F.unhex(F.lpad(F.hex(F.length(norm).cast("long")), 8, "0"))).alias("digest"),
        F.length(F.coalesce(F.col("text"), F.lit(""))).cast("long").alias("chars"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("owner"),
        F.lit(1).cast("long").alias("n_rows"),
    )


def exact_dedup(df: DataFrame) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without white space; null counts as empty. The row with the most
    code points stays, then the smallest doc_id, null last; of rows repeated with the same doc_id
    and length all count as kept. An empty table gives no rows; other columns are ignored.
    """
    # Texts are hashed once; what follows reads ids and digests.
    rows = written(keyed_rows(df), "digests")
    groups = written(duplicate_groups(rows).select("digest", F.col("owner").alias("keeper"), F.col("n_rows").alias("group_size")), "digest-groups")
    keep = F.nullif(F.col("keeper"), F.lit(_NO_ID))
    counts = groups.select("digest", F.col("group_size").alias("n"))
    return dealt_join(rows, groups, "digest", "owner", counts, rows.count()).select(
        "doc_id",
        keep.alias("keep_id"),
        "group_size",
        (F.col("owner") == F.col("keeper")).alias("kept"),
        F.lower(F.hex(F.substring("digest", 1, 32))).alias("text_sha256"),
    )


def kept_documents(df: DataFrame) -> DataFrame:
    """The rows of df that stay, one of each text, with all columns of df.

    Rows are decided one by one: of rows repeated with the same doc_id and text one stays, rows with
    the same doc_id and other texts do not share their fate, nor do rows whose doc_id is null.
    """
    return rows_of(df, lambda docs: exact_dedup(docs).filter("kept"))


class LiveTexts:
    """The digests of texts that are live, kept between runs as a table (digest, owner) in a folder.

    A text is live while the document that brought it is: `add` admits documents whose text is not
    live yet, `withdraw` deletes the digests of documents that leave, so that their texts may come
    in again. Each call reads the last generation of the table and writes the next one whole; a call
    that fails leaves the last one as it was.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self._spark, self.path = spark, path or new_path(spark, "live-texts")
        self._generation: str | None = None

    @property
    def live(self) -> DataFrame:
        """(digest, owner) of every live text."""
        if self._generation is None:
            return self._spark.createDataFrame([], "digest binary, owner long")
        return self._spark.read.schema("digest binary, owner long").parquet(self._generation)

    def add(self, df: DataFrame) -> DataFrame:
        """(doc_id, admitted) per row of df: of equal texts the one that `exact_dedup` keeps, if its text is not live."""
        rows = keyed_rows(df)
        first = duplicate_groups(rows).select("digest", "owner")
        done = self._apply(first.select("digest", "owner", F.lit(2).alias("step"))).filter("step = 2")
        new = done.select(F.col("digest").alias("_d"), F.col("owner").alias("_o"))
        won = (F.col("digest") == F.col("_d")) & (F.col("owner") == F.col("_o"))
        return rows.join(new, won, "left").select("doc_id", F.col("_d").isNotNull().alias("admitted"))

    def withdraw(self, df: DataFrame) -> DataFrame:
        """(doc_id) of the rows (doc_id, text) of df that were live; their digests are deleted."""
        done = self._apply(keyed_rows(df).select("digest", "owner", F.lit(1).alias("step")).distinct())
        return done.filter("step = 1").select(F.nullif("owner", F.lit(_NO_ID)).alias("doc_id"))

    def _apply(self, steps: DataFrame) -> DataFrame:
        """Deletions (step 1), then insertions (2), each with its digest's live entry (0) in one index; what took effect."""
        flush = FLUSH_KEYS

        def run(batches):
            import pyarrow as pa

            schema = pa.schema([("digest", pa.binary()), ("owner", pa.int64()), ("step", pa.int32())])
            index, told = CuckooIndex(), []

            def given():
                rows = [(k, v, 0) for k, v in index] + told
                return _batches([[r[i] for r in rows] for i in range(3)], schema)

            for batch in batches:
                for key, owner, step in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    known = index.get(key)
                    if len(index) + len(told) >= flush and known is None and step != 1:
                        yield from given()
                        index, told = CuckooIndex(), []
                    if step == 1 and known == owner:
                        index.delete(key)
                        told.append((key, owner, 1))
                    elif step != 1 and known is None:
                        index.insert(key, owner)
                        if step == 2:
                            told.append((key, owner, 2))
            yield from given()

        asked = self.live.select("digest", "owner", F.lit(0).alias("step")).unionByName(steps)
        dealt = asked.repartition("digest").sortWithinPartitions("digest", "step", "owner")
        done = written(dealt.mapInArrow(run, "digest binary, owner long, step int"), "live-steps")
        before, self._generation = self._generation, f"{self.path}/{new_path(self._spark, 'generation').rsplit('-', 1)[1]}"
        done.filter("step = 0").select("digest", "owner").write.parquet(self._generation)
        if before is not None:
            remove(self._spark, before)
        return done


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))
