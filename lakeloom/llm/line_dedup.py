"""Line dedup over content-defined chunks, in SQL functions alone.

A rolling hash over the hashes of the last lines makes a line a boundary, so that a passage has the
same boundaries wherever it stands. A chunk runs from a boundary to the next one, both included, and
so has at least two lines; neighbours share a line. Chunks are first counted by a hash; the texts of
chunks whose hash repeats anywhere are then compared byte for byte. Of equal chunks all but the
first, by doc_id and position, are removed, and with them the neighbouring lines up to the next
boundary for as long as they equal the first one's neighbours: the head and the tail of a passage,
which no chunk of it covers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dealt_join, documents, free_names, in_bit_set, written

NAME = "op5_line_dedup"

#: Of DIVISOR rests of the rolling hash, CUTS make a line a boundary; the lines that the hash covers.
DIVISOR, CUTS, WINDOW = 8, 7, 2
_PRIME = 31
_INK = r"[^\x20\x09-\x0D]"

ORACLE_SQL = r"""
WITH l AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), h AS (
  SELECT doc_id, ls, list_transform(ls, lambda x: ('0x' || substr(md5(x), 1, 8))::BIGINT) AS hs FROM l
), c AS (
  SELECT doc_id, ls, list_filter(range(1, len(ls) + 1), lambda i: regexp_matches(list_extract(ls, i), '[^\x20\x09-\x0D]')
    AND (i = 1 OR i = len(ls) OR (list_extract(hs, i) + 31 * list_extract(hs, i - 1)) % 8 < 7)) AS b FROM h
), k AS (
  SELECT doc_id, ls, b, unnest(range(1, len(b))) AS n FROM c
), s AS (
  SELECT doc_id, ls, list_extract(b, n) AS f, list_extract(b, n + 1) AS l,
         CASE WHEN n > 1 THEN list_extract(b, n - 1) ELSE 1 END AS low, CASE WHEN n + 2 <= len(b) THEN list_extract(b, n + 2) ELSE len(ls) END AS high FROM k
), e AS (
  SELECT doc_id, f, l, array_to_string(list_slice(ls, f, l), chr(10)) AS t,
         CASE WHEN low < f THEN list_reverse(list_slice(ls, low, f - 1)) ELSE [] END AS before,
         CASE WHEN high > l THEN list_slice(ls, l + 1, high) ELSE [] END AS after FROM s
), r AS (
  SELECT *, row_number() OVER w AS place, first_value(before) OVER w AS kb, first_value(after) OVER w AS ka FROM e
  WINDOW w AS (PARTITION BY t ORDER BY doc_id, f)
), g AS (
  SELECT doc_id, f, l, least(len(before), len(kb)) AS nb, least(len(after), len(ka)) AS na,
         list_min(list_filter(range(1, least(len(before), len(kb)) + 1), lambda j: list_extract(before, j) <> list_extract(kb, j))) AS b1,
         list_min(list_filter(range(1, least(len(after), len(ka)) + 1), lambda j: list_extract(after, j) <> list_extract(ka, j))) AS a1
  FROM r WHERE place > 1
), x AS (
  SELECT doc_id, count(*) AS removed_chunks, list_distinct(flatten(list(range(f - coalesce(b1 - 1, nb), l + coalesce(a1 - 1, na) + 1)))) AS gone
  FROM g GROUP BY doc_id
)
SELECT c.doc_id, len(c.ls) AS n_lines, greatest(len(c.b) - 1, 0) AS n_chunks, coalesce(x.removed_chunks, 0) AS removed_chunks,
       coalesce(len(x.gone), 0) AS removed_lines,
       sha256(array_to_string(list_transform(list_filter(range(1, len(c.ls) + 1), lambda i: NOT list_contains(coalesce(x.gone, []), i)), lambda i: list_extract(c.ls, i)), chr(10))) AS text_sha256
FROM c LEFT JOIN x USING (doc_id)
"""


def _let(value: Column, body) -> Column:
    """body(value) with value computed once a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 8), 16, 10).cast("long")


def boundaries(lines: Column, divisor: int = DIVISOR, cuts: int = CUTS, window: int = WINDOW) -> Column:
    """Numbers, from 0, of the boundary lines: lines that are not all white space, and are the first, the last or where the rolling hash says so."""
    n = F.size(lines)

    def chosen(hashes: Column) -> Column:
        def cut(i: Column) -> Column:
            rolled = sum((F.get(hashes, i - j) * _PRIME**j for j in range(window)), F.lit(0).cast("long"))
            ends = (i == 0) | (i == n - 1) | ((i >= window - 1) & (F.pmod(rolled, F.lit(divisor)) < cuts))
            return ends & F.get(lines, i).rlike(_INK)

        return F.filter(F.sequence(F.lit(0), n - 1), cut)

    return _let(F.transform(lines, line_hash), chosen)


def chunk_spans(lines: Column) -> Column:
    """array<struct<first, last, low, high>>: lines of each chunk, and the boundaries before and after it, or the text's ends."""
    def spans(b: Column) -> Column:
        return F.transform(F.slice(b, F.lit(1), F.greatest(F.size(b) - 1, F.lit(0))), lambda first, j: F.struct(
            first.alias("first"), F.get(b, j + 1).alias("last"), F.when(j > 0, F.get(b, j - 1)).otherwise(0).alias("low"),
            F.coalesce(F.get(b, j + 2), F.size(lines) - 1).alias("high"),
        ))

    return _let(boundaries(lines), spans)


def _text(lines: Column, first: Column, last: Column) -> Column:
    return F.array_join(F.slice(lines, first + 1, last - first + 1), "\n")


def _signs(lines: Column) -> Column:
    """128 bits of hash per line."""
    return F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(x, F.lit(1)).alias("b")))


def _equal_run(one: Column, two: Column) -> Column:
    """How many leading elements of two arrays are equal."""
    n = F.least(F.size(one), F.size(two))
    numbers = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.expr("cast(array() as array<int>)"))
    return F.coalesce(F.array_min(F.filter(numbers, lambda i: F.get(one, i) != F.get(two, i))), n)


def _keys(df: DataFrame) -> DataFrame:
    """(id, tag, own, ls): doc_id, a hash of the text, a hash of both, and the lines."""
    tag = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    rows = df.select(F.col("doc_id").cast("long").alias("id"), tag.alias("tag"), lines_of(F.col("text")).alias("ls"))
    return rows.withColumn("own", F.xxhash64("id", "tag"))


def _same() -> Column:
    return F.col("id").eqNullSafe(F.col("id2")) & (F.col("tag") == F.col("tag2"))


def removable_lines(df: DataFrame) -> DataFrame:
    """(id, tag, own, chunks, lines): per row with any, how many chunks and which lines to remove."""
    rows = _keys(df)
    # Pass 1: places and hashes only. A 64-bit hash suffices, as texts are compared below.
    places = rows.select("id", "tag", "own", "ls", F.explode(chunk_spans(F.col("ls"))).alias("s")).select(
        "id", "tag", "own", "s", F.xxhash64(_text(F.col("ls"), F.col("s.first"), F.col("s.last"))).alias("h"),
    )
    places = written(places, "line-chunks")
    # Written, so that the join below has a shuffle of its own; a hot chunk is dealt among tasks.
    repeated = written(places.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "line-repeats")
    asked = dealt_join(places, repeated.select("h"), "h", "own", repeated, places.count())
    asked = written(asked.groupBy("id", "tag", "own").agg(F.collect_set("s").alias("asked")), "line-asked")
    # Pass 2: texts of repeated chunks and signs of their neighbours; only rows that have any are shuffled.
    named = asked.select(F.col("id").alias("id2"), F.col("tag").alias("tag2"), "asked")
    texts = in_bit_set(rows, asked, "own").filter("in_set").join(named, _same()).select("id", "tag", "own", "ls", F.explode("asked").alias("s"))
    first, last, low, high = (F.col(f"s.{c}") for c in ("first", "last", "low", "high"))
    texts = texts.select(
        "id", "tag", "own", first.alias("first"), last.alias("last"), _text(F.col("ls"), first, last).alias("t"),
        _signs(F.reverse(F.slice("ls", low + 1, first - low))).alias("before"), _signs(F.slice("ls", last + 2, high - last)).alias("after"),
    )
    texts = written(texts.withColumn("digest", F.sha2("t", 256)), "line-texts")
    place = ["no_id", "id", "first", "tag", "last"]
    whole = F.struct(F.col("id").isNull().alias("no_id"), *place[1:], "before", "after")
    keepers = texts.groupBy("t").agg(F.min(whole).alias("keep"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    keepers = written(keepers.select(F.sha2("t", 256).alias("digest"), "n", "keep"), "line-keepers")
    met = dealt_join(texts.drop("t"), keepers.select("digest", "keep"), "digest", "own", keepers.select("digest", "n"), texts.count())
    own_place = F.struct(F.col("id").isNull().alias("no_id"), *place[1:])
    gone = met.filter(~own_place.eqNullSafe(F.struct(*[F.col(f"keep.{c}").alias(c) for c in place])))
    gone = gone.select("id", "tag", "own", "first", "last", F.sequence(
        F.col("first") - _equal_run(F.col("before"), F.col("keep.before")), F.col("last") + _equal_run(F.col("after"), F.col("keep.after"))
    ).alias("lines")).dropDuplicates(["id", "tag", "first", "last"])
    gone = gone.groupBy("id", "tag", "own").agg(F.count(F.lit(1)).alias("chunks"), F.array_distinct(F.flatten(F.collect_list("lines"))).alias("lines"))
    return written(gone, "line-gone")


def dedup_lines(df: DataFrame) -> DataFrame:
    """df with text cleaned, and columns n_lines, n_chunks, removed_chunks, removed_lines added (existing ones replaced).

    Lines end at U+000A. Of equal chunks the first by doc_id (null last) and position stays. Every
    removed line equals one that stands earlier, so that one copy of each stays. Neighbours of equal
    chunks are compared by 128 bits of hash a line, chunks by their bytes. Null counts as empty
    text: one empty line and no chunk. Rows repeated with the same doc_id and text count as one
    document and are cleaned alike. An empty table gives no rows; columns of any name are kept.
    """
    names = ("n_lines", "n_chunks", "removed_chunks", "removed_lines")
    gone = removable_lines(df)
    base = df.drop(*names)
    id_, tag, own, ls, gone_lines, chunks, in_set, id2, tag2 = free_names(base, "_id", "_tag", "_own", "_ls", "_gone", "_chunks", "_in_set", "_id2", "_tag2")
    keyed = base.withColumns({id_: F.col("doc_id").cast("long"), tag: F.xxhash64(F.coalesce(F.col("text"), F.lit("")))})
    keyed = keyed.withColumn(own, F.xxhash64(id_, tag))
    flagged = in_bit_set(keyed, gone.select(F.col("own").alias(own)), own, in_set)
    none = F.expr("cast(array() as array<int>)")
    whole = flagged.filter(~F.col(in_set)).withColumns({gone_lines: none, chunks: F.lit(0).cast("long")})
    found = gone.select(F.col("id").alias(id2), F.col("tag").alias(tag2), F.col("lines").alias(gone_lines), F.col("chunks").alias(chunks))
    cut = flagged.filter(F.col(in_set))
    cut = cut.join(found, cut[id_].eqNullSafe(found[id2]) & (cut[tag] == found[tag2]), "left").drop(id2, tag2)
    cut = cut.withColumns({gone_lines: F.coalesce(F.col(gone_lines), none), chunks: F.coalesce(F.col(chunks), F.lit(0).cast("long"))})
    both = whole.unionByName(cut).withColumn(ls, lines_of(F.col("text")))
    n = F.size(F.col(ls))
    kept = F.array_except(F.sequence(F.lit(0), n - 1), F.col(gone_lines))
    clean = F.array_join(F.transform(kept, lambda i: F.get(F.col(ls), i)), "\n")
    clean = F.when(F.size(F.col(gone_lines)) == 0, F.coalesce(F.col("text"), F.lit(""))).otherwise(clean)
    others = [F.col(f"`{c}`") for c in base.columns if c != "text"]
    out = both.select(
        *others, clean.alias("text"), n.cast("long").alias("n_lines"), F.greatest(F.size(boundaries(F.col(ls))) - 1, F.lit(0)).cast("long").alias("n_chunks"),
        F.col(chunks).alias("removed_chunks"), F.size(F.col(gone_lines)).cast("long").alias("removed_lines"),
    )
    return out.select(*[F.col(f"`{c}`") for c in base.columns], *names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_chunks", "removed_chunks", "removed_lines", F.sha2("text", 256).alias("text_sha256"))
