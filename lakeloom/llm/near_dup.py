"""N-gram Jaccard join with Bayesian pruning of MinHash comparisons.

1. Documents of equal word sequences form a class; its first row represents it, so that copies are
   never compared.
2. Representatives get MinHash signatures over word shingles. Those that agree in a band of the
   signature share a bucket; candidates are the pairs of a bucket, each taken in the first band that
   the two share. Buckets of equal members are compared once. Only ids and band hashes are shuffled.
3. Signature and shingle hashes of a document that shares a bucket are made once and go to each of
   its buckets, at most BANDS rows a document. A large bucket is dealt by hash to blocks of bounded
   bytes; pairs of blocks meet as packed rows. Signatures are compared a few values at a time, and a
   pair is dropped when the posterior probability that its similarity reaches the threshold falls
   below a tolerance. The pairs that remain are verified on their full sets of 64-bit shingle hashes.
4. A block gives out each document's number of links and a spanning forest of its links, never the
   pairs themselves; components of the forests are the near-duplicate groups.
"""

from __future__ import annotations

import functools
import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dealt_join, documents, in_bit_set, map_texts, new_path, remove, row_keyed, rows_of, written

NAME = "op1_ngram_jaccard_join"

SHINGLE_WORDS, THRESHOLD = 5, 0.8
#: Bands of a signature and values of a band: a pair at the threshold shares no band once in 40,000.
BANDS, BAND_ROWS = 20, 4
#: Values compared before each pruning decision, and the posterior probability below which a pair is dropped.
STEP, TOLERANCE = 8, 1e-6
#: Bytes of signatures and shingle hashes of a block.
BLOCK_BYTES = 8 << 20

ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), c AS (
  SELECT doc_id, w, min(doc_id) OVER (PARTITION BY w) AS class_id FROM w
), s AS (
  SELECT doc_id AS id, list_distinct(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')) END) AS g
  FROM c WHERE doc_id = class_id AND len(w) > 0
), e AS (SELECT id, len(g) AS n, unnest(g) AS g FROM s
), p AS (
  SELECT a.id AS a, b.id AS b FROM e a JOIN e b ON a.g = b.g AND a.id <> b.id AND least(a.n, b.n) >= 0.8 * greatest(a.n, b.n)
  GROUP BY a.id, b.id, a.n, b.n HAVING count(*) >= 0.8 * (a.n + b.n - count(*))
), r AS (
  SELECT DISTINCT a AS id, a AS reach FROM p
  UNION
  SELECT r.id, p.b FROM r JOIN p ON p.a = r.reach
), g AS (SELECT id, min(reach) AS group_id FROM r GROUP BY id
), l AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT c.doc_id, c.class_id, coalesce(l.n, 0) AS n_links, coalesce(g.group_id, c.class_id) AS group_id
FROM c LEFT JOIN l ON l.a = c.class_id LEFT JOIN g ON g.id = c.class_id
"""


def words(text: str | None) -> list[str]:
    """Lower-cased runs of characters other than space and U+0009 to U+000D."""
    text = (text or "").lower()
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


_word_hashes: dict[str, int] = {}


def shingle_hashes(tokens: list[str], size: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles; a shorter text is one shingle, no words are none."""
    import xxhash

    if not tokens:
        return np.empty(0, np.uint64)
    if len(tokens) < size:
        return np.array([xxhash.xxh3_64_intdigest(" ".join(tokens))], np.uint64)
    known = _word_hashes
    if len(known) > 150_000:
        known.clear()
    h = np.empty(len(tokens), np.uint64)
    for i, w in enumerate(tokens):
        v = known.get(w)
        if v is None:
            v = known[w] = xxhash.xxh3_64_intdigest(w)
        h[i] = v
    total = np.zeros(len(tokens) - size + 1, np.uint64)
    for j in range(size):
        total = total * np.uint64(0x9E3779B97F4A7C15) + h[j : len(h) - size + 1 + j]
        total ^= total >> np.uint64(29)
    return np.unique(total * np.uint64(0xBF58476D1CE4E5B9))


@functools.cache
def _permutations(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240501)
    return rng.integers(1, 2**63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, count, dtype=np.uint64)


def signature(shingles: np.ndarray, count: int = BANDS * BAND_ROWS) -> np.ndarray:
    """MinHash values (32 bits each) of a non-empty shingle set."""
    a, b = _permutations(count)
    out = np.full(count, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(shingles), 4096):
        part = shingles[at : at + 4096]
        out = np.minimum(out, ((part[:, None] * a + b) >> np.uint64(32)).min(0).astype(np.uint32))
    return out


def _bands(sig: np.ndarray) -> list[int]:
    """One signed 64-bit hash per band."""
    h = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in sig.reshape(BANDS, BAND_ROWS).T.astype(np.uint64):
        h = (h ^ row) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
    return h.view(np.int64).tolist()


@functools.cache
def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE, count: int = BANDS * BAND_ROWS, step: int = STEP) -> tuple[tuple[int, int], ...]:
    """(values compared, fewest matches) at which a pair stays.

    With a uniform prior, m matches among n values leave P(similarity >= t) = P(Beta(m + 1, n - m + 1) >= t),
    which is the binomial sum over k <= m of C(n + 1, k) t^k (1 - t)^(n + 1 - k).
    """
    out = []
    for n in range(step, count + 1, step):
        total, m = 0.0, 0
        for m in range(n + 1):
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= tolerance:
                break
        out.append((n, m))
    return tuple(out)


def pruned_pairs(sig: np.ndarray, other: np.ndarray | None, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, band: int | None = None):
    """Per row i of sig that has any, (i, the rows of other that pruning leaves): later rows of sig itself if other is None.

    With `band`, a pair that agrees in an earlier band is left to that band's bucket.
    """
    same = other is None
    other = sig if same else other
    plan = least_matches(threshold, tolerance, sig.shape[1])
    for i in range(len(sig)):
        rest = np.arange(i + 1 if same else 0, len(other))
        matches, before = np.zeros(len(rest), np.int64), 0
        for n, least in plan:
            if not len(rest):
                break
            equal = other[rest, before:n] == sig[i, before:n]
            matches += equal.sum(1)
            stay = matches >= least
            if band is not None and before < band * BAND_ROWS:
                whole = equal.reshape(len(rest), -1, BAND_ROWS).all(2)
                stay &= ~whole[:, : band - before // BAND_ROWS].any(1)
            rest, matches, before = rest[stay], matches[stay], n
        if len(rest):
            yield i, rest


class Block:
    """Documents in order of id: signatures, and shingle hashes end to end."""

    def __init__(self, ids: np.ndarray, sigs: np.ndarray, sets: list[np.ndarray]):
        order = np.argsort(ids, kind="stable")
        self.ids, self.sigs = ids[order], sigs[order]
        sets = [sets[i] for i in order.tolist()]
        self.sizes = np.array([len(x) for x in sets], np.int64)
        self.flat = np.concatenate(sets) if sets else np.empty(0, np.uint64)

    def pack(self) -> bytes:
        return b"".join([len(self.ids).to_bytes(8, "little"), self.ids.tobytes(), self.sizes.tobytes(), self.sigs.tobytes(), self.flat.tobytes()])

    @classmethod
    def unpack(cls, data: bytes) -> Block:
        n = int.from_bytes(data[:8], "little")
        block = cls.__new__(cls)
        block.ids, block.sizes = np.frombuffer(data, np.int64, n, 8), np.frombuffer(data, np.int64, n, 8 + 8 * n)
        at = 8 + 16 * n
        block.sigs = np.frombuffer(data, np.uint32, n * BANDS * BAND_ROWS, at).reshape(n, BANDS * BAND_ROWS)
        block.flat = np.frombuffer(data, np.uint64, -1, at + block.sigs.nbytes)
        return block


def links_of(one: Block, two: Block | None, threshold: float, tolerance: float, band: int | None) -> tuple[list[int], list[int], list[int]]:
    """(ids with a link, their numbers of links, the smallest id that links of this block connect to each)."""
    second = one if two is None else two
    ids = one.ids if two is None else np.concatenate([one.ids, two.ids])
    shift = 0 if two is None else len(one.ids)
    sizes = one.sizes if two is None else np.concatenate([one.sizes, two.sizes])
    ends = sizes.cumsum()
    starts = ends - sizes
    # Shingles as numbers, so that a document is a row of marks.
    known, flat = np.unique(one.flat if two is None else np.concatenate([one.flat, two.flat]), return_inverse=True)
    mark = np.zeros(len(known), bool)
    rank = np.argsort(np.argsort(ids))
    links, label = np.zeros(len(ids), np.int64), rank.copy()
    for i, rest in pruned_pairs(one.sigs, None if two is None else second.sigs, threshold, tolerance, band):
        js = rest + shift
        own = flat[starts[i] : ends[i]]
        mark[own] = True
        low, high = int(js[0]), int(js[-1]) + 1
        if 2 * len(js) >= high - low:  # most of a stretch: count all of it
            shared = np.add.reduceat(mark[flat[starts[low] : ends[high - 1]]].astype(np.int64), starts[low:high] - starts[low])[js - low]
        else:
            shared = np.array([np.count_nonzero(mark[flat[starts[j] : ends[j]]]) for j in js.tolist()])
        mark[own] = False
        js = js[shared >= threshold * (sizes[i] + sizes[js] - shared)]
        if not len(js):
            continue
        links[i] += len(js)
        links[js] += 1
        met = np.unique(np.append(label[js], label[i]))
        if len(met) > 1:
            label[np.isin(label, met[1:])] = met[0]
    used = np.flatnonzero(links)
    by_rank = np.sort(ids)
    return ids[used].tolist(), links[used].tolist(), by_rank[label[used]].tolist()


def connected(edges: DataFrame) -> DataFrame:
    """(id, root) for every id of edges (a, b): root is the smallest id that is connected to it.

    Rounds of large-star and small-star steps, each written to the shared folder, the one before
    removed; neighbourhoods are folded by partial aggregation and joins that deal a hot node's
    edges among tasks, never gathered in one task.
    """
    spark = edges.sparkSession

    def both(e: DataFrame) -> DataFrame:
        return e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    path = new_path(spark, "edges")
    edges = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges", path)
    while True:
        # Large star: link every larger neighbour, and the node, to the smallest of the neighbourhood.
        near, total = both(edges), 2 * edges.count()
        low = near.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"), F.count(F.lit(1)).alias("n"))
        met = dealt_join(near.filter("b > a"), low.select("a", "low"), "a", "b", low.select("a", "n"), total)
        large = met.select(F.col("b").alias("a"), F.col("low").alias("b")).filter("a <> b").distinct()
        # Small star: link every smaller neighbour, and the node, to the smallest of them.
        least = large.groupBy("a").agg(F.min("b").alias("low"), F.count(F.lit(1)).alias("n"))
        small = dealt_join(large, least.select("a", "low"), "a", "b", least.select("a", "n"), total)
        small = small.select(F.explode(F.array(F.struct("a", F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))).alias("e")).select("e.a", "e.b")
        before, path = path, new_path(spark, "edges")
        after = written(small.filter("a <> b").distinct(), "edges", path)
        remove(spark, before)
        # Settled: no edge starts where another ends, and every node has one edge.
        one = after.groupBy("a").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        open_ends = after.join(after.select(F.col("b").alias("a")).distinct(), "a", "left_semi")
        if one.isEmpty() and open_ends.isEmpty():
            break
        edges = after
    roots = after.select("b").distinct().select(F.col("b").alias("id"), F.col("b").alias("root"))
    return after.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(roots)


_LINKS = "id long, links long, root long, band long, k int, block int, packed binary"


def _rows(found, band=None, k=None, block=None, packed=None):
    """A batch of links, and with `packed` a last row that holds the block itself."""
    import pyarrow as pa

    ids, links, roots = found
    n, more = len(ids), packed is not None
    tail = [None] * n
    columns = [
        pa.array(ids + [None] * more, pa.int64()), pa.array(links + [None] * more, pa.int64()), pa.array(roots + [None] * more, pa.int64()),
        pa.array(tail + [band] * more, pa.int64()), pa.array(tail + [k] * more, pa.int32()), pa.array(tail + [block] * more, pa.int32()),
        pa.array(tail + [packed] * more, pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["id", "links", "root", "band", "k", "block", "packed"])


def _within(threshold: float, tolerance: float):
    """Links in each block of rows (band, k, blocks, block, id, sig, shingles) that come in order of band and block."""

    def finish(key, held):
        band, block, k, blocks = key
        ids = np.array([h[0] for h in held], np.int64)
        sigs = np.stack([np.frombuffer(h[1], np.uint32) for h in held])
        one = Block(ids, sigs, [np.frombuffer(h[2], np.uint64) for h in held])
        found = links_of(one, None, threshold, tolerance, k) if len(held) > 1 else ([], [], [])
        return _rows(found, band, k, block, one.pack() if blocks > 1 else None)

    def run(batches):
        key, held = None, []
        for batch in batches:
            for band, k, blocks, block, *doc in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != (band, block, k, blocks):
                    if held:
                        yield finish(key, held)
                    key, held = (band, block, k, blocks), []
                held.append(doc)
        if held:
            yield finish(key, held)

    return run


def _across(threshold: float, tolerance: float):
    """Links between the two packed blocks of a unit."""

    def run(key, table):
        import pyarrow as pa

        one, two = (Block.unpack(x.as_py()) for x in table.column("packed"))
        found = links_of(one, two, threshold, tolerance, table.column("k")[0].as_py())
        return pa.Table.from_batches([_rows(found)])

    return run


def linked(payload: DataFrame, dealt: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """(id, links, root) of every block, from (id, sig, shingles) and (id, band, k, blocks, block)."""
    places = dealt.groupBy("id").agg(F.collect_list(F.struct("band", "k", "blocks", "block")).alias("places"))  # BANDS at most
    rows = payload.join(places.hint("merge"), "id").select("id", "sig", "shingles", F.explode("places").alias("p"))
    rows = rows.select("p.band", "p.k", "p.blocks", "p.block", "id", "sig", "shingles").repartition("band", "block")
    rows = rows.sortWithinPartitions("band", "block", "id")
    inner = written(rows.mapInArrow(_within(threshold, tolerance), _LINKS), "links")
    out = inner.filter("id is not null").select("id", "links", "root")
    packed = inner.filter("packed is not null").select("band", "k", "block", "packed")
    if packed.isEmpty():
        return out
    # A pair of blocks is one unit; a block is one row, so that rows grow with blocks, not documents.
    blocks = packed.select("band", "block").groupBy("band").agg(F.collect_list("block").alias("all"))
    units = packed.join(blocks, "band").withColumn("with", F.explode("all")).filter("with <> block").select(
        "band", "k", "packed", F.least("block", "with").alias("first"), F.greatest("block", "with").alias("second")
    )
    crossed = written(units.groupBy("band", "first", "second").applyInArrow(_across(threshold, tolerance), _LINKS).select("id", "links", "root"), "links")
    return out.unionByName(crossed)


def near_duplicates(df: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """One row per input row: doc_id, class_id, n_links, group_id.

    class_id is the smallest doc_id of the same lower-cased word sequence, n_links the number of
    other classes whose shingle sets reach the threshold with this one, group_id the smallest
    class_id that links connect. Texts without words (null, empty, white space) are one class
    without links; texts below five words are one shingle. Rows are documents of their own also
    where they share a doc_id or have none: null counts as the largest doc_id, and a class or group
    whose rows all lack one has a null class_id or group_id. Repeated rows are of one class. An
    empty table gives no rows; other columns are ignored.
    """

    def sketch(texts: list[str | None]) -> dict[str, list]:
        import xxhash

        out: dict[str, list] = {"class_key": [], "size": [], "bands": []}
        for text in texts:
            tokens = words(text)
            out["class_key"].append(xxhash.xxh3_128_digest(" ".join(tokens)))
            shingles = shingle_hashes(tokens)
            out["size"].append(len(shingles))
            out["bands"].append(_bands(signature(shingles)) if len(shingles) else [])
        return out

    def measure(texts: list[str | None]) -> dict[str, list]:
        sets = [shingle_hashes(words(t)) for t in texts]
        return {"sig": [signature(s).tobytes() for s in sets], "shingles": [s.tobytes() for s in sets]}

    rows = row_keyed(df.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "id")
    sketched = written(map_texts(rows, sketch, "class_key binary, size long, bands array<long>", keep=("id", "doc_id")), "sketches")
    # Folded before it is joined: a class of any number of copies is one row a task.
    first = F.min(F.struct("id", "doc_id", "size", "bands")).alias("first")
    classes = written(sketched.groupBy("class_key").agg(first, F.count(F.lit(1)).alias("n")).select("class_key", "n", "first.*"), "classes")
    banded = classes.select("id", "size", F.posexplode("bands").alias("k", "band"))
    # Of buckets with the same members, told by their number and two 64-bit sums, the first band's stays.
    members = [F.bit_xor(F.xxhash64("id", F.lit(seed))).alias(f"sum{seed}") for seed in (1, 2)]
    buckets = banded.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("k"), F.sum("size").alias("size"), *members).filter("n > 1")
    buckets = buckets.groupBy("n", "sum1", "sum2").agg(F.min(F.struct("k", "band", "size")).alias("b")).select("n", "b.*")
    per_doc = 4 * BANDS * BAND_ROWS + 16
    buckets = written(buckets.select("band", "k", "n", F.ceil((8 * F.col("size") + per_doc * F.col("n")) / BLOCK_BYTES).cast("int").alias("blocks")), "buckets")
    total = buckets.agg(F.sum("n")).first()[0] or 0
    dealt = dealt_join(banded.select("id", "band"), buckets.select("band", "k", "blocks"), "band", "id", buckets.select("band", "n"), total)
    dealt = written(dealt.withColumn("block", F.pmod(F.xxhash64("id", F.lit(7)), F.col("blocks")).cast("int")), "dealt")
    asked = in_bit_set(rows.select("id", "text"), dealt, "id").filter("in_set")
    payload = map_texts(asked, measure, "sig binary, shingles binary", keep=("id",))
    compared = linked(payload, dealt, threshold, tolerance)
    links = compared.groupBy("id").agg(F.sum("links").alias("links"))
    groups = connected(compared.select(F.col("id").alias("a"), F.col("root").alias("b")))
    found = written(links.join(groups, "id", "left").select("id", "links", F.coalesce("root", "id").alias("root")), "found")
    # The doc_id of each root, then the facts of each class, then of each row; a hot root or class is dealt.
    roots = classes.select(F.col("id").alias("root"), F.col("doc_id").alias("group_id"))
    counts = found.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    named = dealt_join(found, roots, "root", "id", counts, found.count()).select("id", "links", "group_id")
    facts = classes.select("class_key", "id", F.col("doc_id").alias("class_id")).join(named.withColumn("linked", F.lit(True)), "id", "left").select(
        "class_key", "class_id", F.coalesce("links", F.lit(0).cast("long")).alias("n_links"),
        F.when(F.col("linked"), F.col("group_id")).otherwise(F.col("class_id")).alias("group_id"),
    )
    rows = sketched.select("class_key", "id", "doc_id")
    return dealt_join(rows, facts, "class_key", "id", classes.select("class_key", "n"), sketched.count()).select("doc_id", "class_id", "n_links", "group_id")


def one_of_each_group(df: DataFrame) -> DataFrame:
    """The rows of df that represent their near-duplicate group; texts without words are a group too.

    A group's first row by doc_id (null last) stays. Rows that share a doc_id, rows whose doc_id is
    null and repeated rows are documents of their own, of which one of a group stays. Columns of any
    name are kept as they are; an empty table gives no rows.
    """
    return rows_of(df, lambda docs: near_duplicates(docs).filter("doc_id = group_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
