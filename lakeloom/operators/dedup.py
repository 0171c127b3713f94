"""Duplicate detection, survivor selection and benchmark contamination.

Near duplicates survive as the lexicographically first maximal independent set of the candidate
graph: a document goes when a surviving smaller one is adjacent to it.
"""

from __future__ import annotations

import functools
import hashlib
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeloom.operators import text as X

#: 31-bit prime of the permutations; products of hash (28 bits) and coefficient stay within 64 bits.
PRIME = 2147483647


def exact_duplicates(df: DataFrame, text: str = "text", within: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, *within, duplicate_of): the first doc_id of the same text, null for that one itself."""
    w = Window.partitionBy(*within, F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    first = F.min("doc_id").over(w)
    return df.select("doc_id", *within, F.when(first < F.col("doc_id"), first).alias("duplicate_of"))


def coefficients(count: int) -> list[tuple[int, int]]:
    """Affine coefficients (a, b) of the permutations, from a linear congruential rule."""
    out, x = [], 12345
    for _ in range(count):
        x = (1103515245 * x + 12345) % 2**31
        a = x | 1
        x = (1103515245 * x + 12345) % 2**31
        out.append((a, x))
    return out


def shingle_hash(shingle: Column) -> Column:
    """28 bits of MD5, equal in any engine that has MD5."""
    return F.conv(F.substring(F.md5(shingle.cast("binary")), 1, 7), 16, 10).cast("long")


def minhash(shingles: Column, count: int) -> Column:
    """Signature of a shingle array; each shingle is hashed once."""
    hashes = F.transform(shingles, shingle_hash)

    def permuted(h: Column, a: int, b: int) -> Column:
        return F.transform(h, lambda v: (v * F.lit(a) + F.lit(b)) % F.lit(PRIME))

    return X.let(hashes, lambda h: F.array(*[F.array_min(permuted(h, a, b)) for a, b in coefficients(count)]))


def bands(signature: Column, rows: int, count: int) -> Column:
    """array<struct<band, key>> of a signature."""
    return F.array(*[F.struct(F.lit(i).alias("band"), F.array_join(F.slice(signature, i * rows + 1, rows).cast("array<string>"), "-").alias("key")) for i in range(count)])


def estimate(a: Column, b: Column, count: int) -> Column:
    """Share of equal signature slots, as a count of slots."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e))


# Modulus, and what the coefficients of permutation i are hashed from.
MERSENNE, PERMUTATION_SEED = 2**61 - 1, "minhash-perm\x1f{}"


@functools.cache
def _mersenne_coefficients(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns (a, b) of the affine permutations: an odd and any number below the modulus, from one digest each."""
    digests = [hashlib.sha256(PERMUTATION_SEED.format(i).encode()).digest() for i in range(count)]
    pairs = [((int.from_bytes(d[:8], "big") | 1) % MERSENNE, int.from_bytes(d[8:16], "big") % MERSENNE) for d in digests]
    return tuple(np.array(column, np.uint64)[:, None] for column in zip(*pairs, strict=True))


def _reduced(x: np.ndarray) -> np.ndarray:
    p = np.uint64(MERSENNE)
    x = (x & p) + (x >> np.uint64(61))
    return np.where(x >= p, x - p, x)


def mersenne_minhash(hashes: np.ndarray, count: int) -> np.ndarray:
    """Least (a h + b) mod 2^61 - 1 of each permutation over hashes below the modulus, in 64-bit arithmetic.

    Both factors are cut at 31 bits; powers of two above 2^61 fold back, as 2^61 is 1 here.
    """
    a, b = _mersenne_coefficients(count)
    cut, low31, low30 = np.uint64(31), np.uint64(2**31 - 1), np.uint64(2**30 - 1)
    best = np.full(count, MERSENNE, np.uint64)
    for at in range(0, len(hashes), 4096):
        h = hashes[None, at : at + 4096]
        middle = (a >> cut) * (h & low31) + (a & low31) * (h >> cut)
        product = ((a >> cut) * (h >> cut) << np.uint64(1)) + (middle >> np.uint64(30)) + ((middle & low30) << cut) + (a & low31) * (h & low31)
        best = np.minimum(best, _reduced(_reduced(product) + b).min(1))
    return best


@functools.cache
def _scaled_coefficients(count: int) -> tuple[list, list, np.ndarray, np.ndarray, np.ndarray]:
    """(a, b) as numbers, and as 64-bit fractions of the modulus: of 2^31 a, of a and, raised by 2^34, of b."""
    a, b = ([int(x) for x in column[:, 0]] for column in _mersenne_coefficients(count))
    fractions = [[((x << 31) % MERSENNE << 64) // MERSENNE for x in a], [(x << 64) // MERSENNE for x in a], [((x << 64) // MERSENNE + 2**34) % 2**64 for x in b]]
    return a, b, *[np.array(column, np.uint64)[:, None] for column in fractions]


def fast_minhash(hashes: np.ndarray, count: int) -> np.ndarray:
    """The values of `mersenne_minhash`, from 64-bit fractions that tell which hash is the least.

    A fraction is at most 2^32 below its true place (raised by 2^34, so that none wraps below 0). Where
    another comes within 2^33 of the least, or the least may have wrapped, the exact values decide.
    """
    a, b, high, low, raised = _scaled_coefficients(count)
    least, at, near = np.full(count, 2**64 - 1, np.uint64), np.zeros(count, np.int64), np.zeros(count, bool)
    for start in range(0, len(hashes), 512):
        h = hashes[None, start : start + 512]
        x = high * (h >> np.uint64(31))
        x += low * (h & np.uint64(2**31 - 1))
        x += raised
        place = x.argmin(1)
        own = x[np.arange(count), place]
        x -= own[:, None]
        within = (x < np.uint64(2**33)).sum(1) > 1
        new = own < least
        gap = np.where(new, least - own, own - least)
        near |= within | (gap < np.uint64(2**33)) & (start > 0)
        at, least = np.where(new, place + start, at), np.minimum(least, own)
    if near.any() or (least < np.uint64(2**34)).any():
        return mersenne_minhash(hashes, count)
    return np.array([(x * h + y) % MERSENNE for x, y, h in zip(a, b, hashes[at].tolist(), strict=True)], np.uint64)


def _hashes(shingles) -> np.ndarray:
    digests = b"".join([hashlib.sha256(x.encode()).digest()[:8] for x in shingles])
    return np.frombuffer(digests, ">u8").astype(np.uint64) % np.uint64(MERSENNE)


def _signature(shingles, count: int) -> np.ndarray:
    return fast_minhash(_hashes(shingles), count).astype(np.int64)


_WORD = re.compile(r"[^ \t\n\x0B\f\r]+")


def _word_runs(text: str | None, size: int) -> set[str]:
    w = _WORD.findall(text or "")
    return {" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))}


def _pair_keys(slots: np.ndarray) -> np.ndarray:
    """A 64-bit key for each two slots side by side, with their place."""
    odd = np.uint64(0x9E3779B97F4A7C15)
    keys = (slots[::2] * odd ^ slots[::2] >> np.uint64(29)) + slots[1::2] + np.arange(len(slots) // 2, dtype=np.uint64)
    keys = (keys ^ keys >> np.uint64(32)) * odd
    return keys ^ keys >> np.uint64(29)


def word_sketch_udf(count: int, size: int = 5):
    """A column function text -> longs: its number of distinct runs of words, the lowest bits of its signature's slots (64 a long), their second bits, a key for each two slots."""
    @F.pandas_udf(T.ArrayType(T.LongType()))
    def sketch(text: pd.Series) -> pd.Series:
        bit = np.uint64(1) << np.arange(64, dtype=np.uint64)

        def one(t):
            runs = _word_runs(t, size)
            slots = fast_minhash(_hashes(runs), count)
            low, second = ((((slots >> np.uint64(i)) & np.uint64(1)).reshape(-1, 64) * bit).sum(1, dtype=np.uint64) for i in (0, 1))
            return np.concatenate([[np.uint64(len(runs))], low, second, _pair_keys(slots)]).astype(np.uint64).view(np.int64)

        return text.map(one)

    return sketch


#: Longs of a bit map of a set of word runs.
MAP_LONGS = 16


def word_map_udf(count: int, size: int = 5):
    """A column function text -> longs: its number of distinct runs of words, a map with a bit for each of them (one of 64 * MAP_LONGS, some have the same), a key for each two slots of its signature."""
    @F.pandas_udf(T.ArrayType(T.LongType()))
    def mapped(text: pd.Series) -> pd.Series:
        def one(t):
            hashes = _hashes(_word_runs(t, size))
            bits = np.zeros(64 * MAP_LONGS, np.uint8)
            bits[(hashes % np.uint64(len(bits))).astype(np.int64)] = 1
            return np.concatenate([[np.uint64(len(hashes))], np.packbits(bits).view(np.uint64), _pair_keys(fast_minhash(hashes, count))]).astype(np.uint64).view(np.int64)

        return text.map(one)

    return mapped


def shared_runs_udf(size: int = 5):
    """A column function (text, text) -> struct<shared, total>: sizes of intersection and union of their distinct runs of words."""
    @F.pandas_udf("shared int, total int")
    def compared(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        runs = functools.lru_cache(16)(lambda t: _word_runs(t, size))  # a join on b leaves equal texts together

        def one(x, y):
            x, y = runs(x), runs(y)
            shared = len(x & y)
            return shared, len(x) + len(y) - shared

        return pd.DataFrame([one(x, y) for x, y in zip(a, b, strict=True)], columns=["shared", "total"], dtype="int32")

    return compared


#: Of 128 slots of two signatures, as many may differ in their two low bits. At a similarity of 13 in 16 or more, a slot's do
#: with a probability of 9 in 64 at most, and those of more than 54 slots with one below 1e-12.
UNEQUAL_SLOTS = 54


def near_word_pairs(docs: DataFrame, among: DataFrame, share: tuple[int, int] = (13, 16), size: int = 5) -> DataFrame:
    """(a, b, shared, total): pairs a < b of docs (doc_id, text), both in `among` (doc_id), whose sets of distinct word runs
    have a similarity of share[0] / share[1], 13 in 16 at least.

    Pairs share two of 128 slots side by side. Rows of 56 bytes a document and band meet; sizes and low bits of
    the slots leave few pairs, whose texts are compared as they are. Texts are shuffled in no other place.
    """
    part, whole = share
    if part * 16 < whole * 13:
        raise ValueError("the bits of signatures tell similarities of 13 in 16 or more")
    need_checkpoint_folder(docs)
    sketches = docs.select("doc_id", word_sketch_udf(128, size)("text").alias("k")).join(among, "doc_id", "left_semi").checkpoint()
    keyed = sketches.select("doc_id", F.col("k")[0].alias("n"), *[F.col("k")[1 + i].alias(f"w{i}") for i in range(4)], F.explode(F.slice("k", 6, 64)).alias("key"))
    a, b = keyed.alias("a"), keyed.alias("b")
    sizes = F.least("a.n", "b.n") * whole >= F.greatest("a.n", "b.n") * part
    unequal = [F.col(f"a.w{i}").bitwiseXOR(F.col(f"b.w{i}")) for i in range(4)]
    bits = F.bit_count(unequal[0].bitwiseOR(unequal[2])) + F.bit_count(unequal[1].bitwiseOR(unequal[3])) <= UNEQUAL_SLOTS
    met = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.doc_id") < F.col("b.doc_id")) & sizes & bits)
    pairs = met.select(F.col("a.doc_id").alias("a"), F.col("b.doc_id").alias("b")).distinct().checkpoint()
    texts = pairs.join(docs.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a").join(docs.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")
    found = texts.select("a", "b", shared_runs_udf(size)("ta", "tb").alias("c")).select("a", "b", "c.*")
    return found.filter(F.col("shared").cast("long") * whole >= F.col("total").cast("long") * part)


#: Lists of neighbours hold ids that are equal above so many bits: a long a pair, and a bound for a row.
LIST_BITS = 16


def _listed(pairs: DataFrame, by: tuple[str, ...], other: str) -> DataFrame:
    """(*by, others): distinct pairs as lists, which take a fifth of the space."""
    return pairs.groupBy(*by, F.shiftright(other, LIST_BITS).alias("_range")).agg(F.collect_set(other).alias("others")).drop("_range")


#: Word runs of a block in which the texts of candidate pairs are compared, about.
BLOCK_RUNS = 65536


def _counted_in_blocks(size: int):
    """Batches sorted by block, texts (others null) before lists of neighbours: the pairs with `shared` and `total` of their distinct runs of words."""
    def counted(batches):
        block, sets = None, {}
        for batch in batches:
            found = []
            for at, a, others, text in zip(*[batch.column(c).to_pylist() for c in ("block", "a", "others", "text")], strict=True):
                if at != block:
                    block, sets = at, {}
                if others is None:
                    sets.setdefault(a, []).append(_word_runs(text, size))
                    continue
                for b in others:
                    for x in sets[a]:  # several if a doc_id is repeated
                        for y in sets[b]:
                            shared = len(x & y)
                            found.append((a, b, shared, len(x) + len(y) - shared))
            columns = list(zip(*found, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b", "shared", "total"])

    return counted


def compared_in_blocks(lists: DataFrame, docs: DataFrame, sizes: DataFrame, size: int = 5) -> DataFrame:
    """(a, b, shared, total): pairs a < b, from lists (a, others), with the sizes of intersection and union of their texts' (doc_id, text) distinct word runs.

    A document is at home with its smallest neighbour or itself; homes are dealt to blocks by their documents' runs (sizes: doc_id, n). Each two blocks with
    pairs meet once with the texts that these pairs ask for, so that a group of copies sends a text a few times, not once a pair.
    """
    need_checkpoint_folder(docs)
    homes = lists.select(F.explode("others").alias("n"), "a").unionByName(lists.select(F.col("a").alias("n"), "a")).groupBy("n").agg(F.min("a").alias("home"))
    homes = homes.join(sizes.groupBy(F.col("doc_id").alias("n")).agg(F.sum("n").alias("runs")), "n")
    blocks = F.ceil(F.sum("runs").over(Window.partitionBy("home")) / BLOCK_RUNS)
    homes = homes.select("n", F.xxhash64("home", F.pmod(F.xxhash64("n"), blocks)).alias("at")).checkpoint()
    both = lists.join(homes.select(F.col("n").alias("a"), F.col("at").alias("of_a")), "a").select("a", "of_a", F.explode("others").alias("b"))
    both = both.join(homes.select(F.col("n").alias("b"), F.col("at").alias("of_b")), "b")
    dealt = _listed(both.select(F.xxhash64(F.least("of_a", "of_b"), F.greatest("of_a", "of_b")).alias("block"), "a", "b"), ("block", "a"), "b").checkpoint()
    asked = dealt.select("block", F.explode(F.array_union("others", F.array("a"))).alias("doc_id")).distinct()
    texts = docs.join(asked, "doc_id").select("block", F.col("doc_id").alias("a"), F.lit(None).cast("array<long>").alias("others"), "text")
    rows = texts.unionByName(dealt.withColumn("text", F.lit(None).cast("string"))).repartition("block").sortWithinPartitions("block", F.col("others").isNotNull())
    return rows.mapInArrow(_counted_in_blocks(size), "a long, b long, shared long, total long")


def wide_word_pairs(docs: DataFrame, among: DataFrame, share: tuple[int, int], size: int = 5) -> DataFrame:
    """(a, b, shared, total): pairs a < b of docs (doc_id, text), both in `among` (doc_id), that share two of 128 slots side by side
    and whose sets of distinct word runs have a similarity of share[0] / share[1].

    Keys of one document are dropped first. Documents go to the smallest one of each of their keys, once for all keys in which
    that one is the smallest, and meet there with a size and a map of bits: what two sets share is at most the bits that both
    maps have and the runs that found their bit taken in either, so no pair at the threshold is lost.
    """
    part, whole = share
    need_checkpoint_folder(docs)
    sketches = docs.select("doc_id", word_map_udf(128, size)("text").alias("k")).join(among, "doc_id", "left_semi").checkpoint()
    words = [f"w{i}" for i in range(MAP_LONGS)]
    maps = sketches.select("doc_id", F.col("k")[0].alias("n"), *[F.col("k")[1 + i].alias(w) for i, w in enumerate(words)])
    maps = maps.withColumn("taken", F.col("n") - sum(F.bit_count(w) for w in words))
    keys = sketches.select("doc_id", F.explode(F.slice("k", MAP_LONGS + 2, 64)).alias("key"))
    same = Window.partitionBy("key")
    met = keys.select("doc_id", "key", F.min("doc_id").over(same).alias("least"), F.count(F.lit(1)).over(same).alias("docs")).filter("docs > 1")
    grouped = met.groupBy("least", "doc_id").agg(F.collect_list("key").alias("keys")).join(maps, "doc_id")
    a, b = grouped.alias("a"), grouped.alias("b")
    most = F.least("a.taken", "b.taken") + sum(F.bit_count(F.col(f"a.{w}").bitwiseAND(F.col(f"b.{w}"))) for w in words)
    sizes = F.least("a.n", "b.n") * whole >= F.greatest("a.n", "b.n") * part
    near = sizes & (most * (whole + part) >= (F.col("a.n") + F.col("b.n")) * part) & F.arrays_overlap("a.keys", "b.keys")
    joined = a.join(b, (F.col("a.least") == F.col("b.least")) & (F.col("a.doc_id") < F.col("b.doc_id")) & near)
    lists = _listed(joined.select(F.col("a.doc_id").alias("a"), F.col("b.doc_id").alias("b")), ("a",), "b").checkpoint()
    return compared_in_blocks(lists, docs, maps.select("doc_id", "n"), size).filter(F.col("shared") * whole >= F.col("total") * part)


def word_minhash_udf(count: int, size: int = 5):
    """A column function text -> signature over its distinct runs of `size` words; a shorter text is one run."""
    @F.pandas_udf(T.ArrayType(T.LongType()))
    def signature(text: pd.Series) -> pd.Series:
        return text.map(lambda t: _signature(_word_runs(t, size), count))

    return signature


def char_minhash_udf(count: int, size: int = 5):
    """A column function text -> signature over its runs of `size` characters, in canonical form with white space collapsed; null without any."""
    import unicodedata

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def signature(text: pd.Series) -> pd.Series:
        def one(t):
            t = " ".join(unicodedata.normalize("NFC", (t or "").replace("\r\n", "\n").replace("\r", "\n")).split())
            return _signature({t[i : i + size] for i in range(max(1, len(t) - size + 1))}, count) if t else None

        return text.map(one)

    return signature


def band_pairs(df: DataFrame, rows: int, count: int) -> DataFrame:
    """Distinct pairs a < b of doc_ids whose signatures share a band. df: doc_id, sig.

    A band is joined with itself; exact copies should be removed before, as a group of n equal
    signatures has n (n - 1) / 2 pairs.
    """
    keyed = df.select("doc_id", F.explode(bands(F.col("sig"), rows, count)).alias("k")).select("doc_id", "k.band", "k.key")
    left, right = keyed.withColumnRenamed("doc_id", "a"), keyed.withColumnRenamed("doc_id", "b")
    return left.join(right, ["band", "key"]).filter("a < b").select("a", "b").distinct()


def need_checkpoint_folder(df: DataFrame) -> None:
    """Only a local master without a checkpoint folder gets a temporary one."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        import tempfile

        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="lakeloom-"))


def survivors(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(doc_id, removed_by): the survivors have null, the others their smallest surviving neighbour.

    In each round, every open node without an open smaller neighbour is kept and its open neighbours
    go, until no edge is open; the rounds needed grow with the longest chain of ever larger neighbours.
    State is written to the checkpoint folder in each round.
    """
    need_checkpoint_folder(nodes)
    edges = edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().checkpoint()
    open_edges, gone, rounds = edges, None, 0
    while not open_edges.isEmpty():
        low = open_edges.select(F.col("a").alias("n")).distinct()
        free = low.join(open_edges.select(F.col("b").alias("n")).distinct(), "n", "left_anti").checkpoint()
        hit = open_edges.join(free, F.col("a") == F.col("n"), "left_semi").select(F.col("b").alias("n")).distinct().checkpoint()
        gone, rounds = hit if gone is None else gone.unionByName(hit), rounds + 1
        if rounds % 20 == 0:  # keeps the plan short
            gone = gone.coalesce(8).checkpoint()
        touched = free.unionByName(hit)
        open_edges = open_edges.join(touched, F.col("a") == F.col("n"), "left_anti").join(touched, F.col("b") == F.col("n"), "left_anti").checkpoint()
    if gone is None:
        return nodes.select("doc_id", F.lit(None).cast("long").alias("removed_by"))
    gone = gone.distinct()
    alive = edges.join(gone, F.col("a") == F.col("n"), "left_anti")
    by = alive.join(gone, F.col("b") == F.col("n")).groupBy(F.col("b").alias("doc_id")).agg(F.min("a").alias("removed_by"))
    return nodes.select("doc_id").join(by, "doc_id", "left")


def removed_counts(nodes: DataFrame, pairs: DataFrame, thresholds: tuple[int, ...]) -> DataFrame:
    """(threshold, removed): how many of nodes (doc_id) greedy selection removes at each threshold, in hundredths, of pairs (a, b, shared, total), a < b.

    Pairs stand in lists by the thresholds that they reach, a bit for each. In each round, a node that is not settled at
    all thresholds goes at those where a smaller neighbour is kept and is kept where all smaller neighbours are gone; the
    rounds grow with the longest chain of ever larger neighbours. State is written to the checkpoint folder in each round.
    """
    need_checkpoint_folder(nodes)
    every, rounds = (1 << len(thresholds)) - 1, 0
    reached = sum(F.when(F.col("shared") * 100 >= F.col("total") * t, F.lit(1 << i)).otherwise(F.lit(0)) for i, t in enumerate(thresholds))
    edges = _listed(pairs.filter("a < b").select("a", "b", reached.cast("long").alias("at")).filter("at <> 0"), ("b", "at"), "a").checkpoint()
    firsts = edges.select(F.explode("others").alias("a")).distinct().join(edges.select(F.col("b").alias("a")), "a", "left_anti")
    settled = firsts.select(F.col("a").alias("n"), F.lit(every).cast("long").alias("kept"), F.lit(0).cast("long").alias("gone")).checkpoint()
    state = settled
    while not edges.isEmpty():
        seen = edges.select("b", "at", F.explode("others").alias("a")).join(state.withColumnRenamed("n", "a"), "a", "left")
        kept, gone = (F.coalesce(c, F.lit(0).cast("long")) for c in ("kept", "gone"))
        after = seen.groupBy(F.col("b").alias("n")).agg(F.bit_or(F.col("at").bitwiseAND(kept)).alias("gone"), F.bit_or(F.col("at").bitwiseAND(F.bitwise_not(gone))).alias("held"))
        after = after.select("n", F.bitwise_not("held").bitwiseAND(F.lit(every).cast("long")).alias("kept"), "gone").checkpoint()
        done = after.filter(F.col("kept").bitwiseOR(F.col("gone")) == every)
        settled, rounds = settled.unionByName(done), rounds + 1
        if rounds % 20 == 0:  # keeps the plan short
            settled = settled.coalesce(8).checkpoint()
        edges = edges.join(done.select(F.col("n").alias("b")), "b", "left_anti").checkpoint()
        state = settled.unionByName(after.join(done, "n", "left_anti"))
    bits = F.array(*[F.struct(F.lit(t).alias("threshold"), F.lit(1 << i).cast("long").alias("bit")) for i, t in enumerate(thresholds)])
    each = nodes.join(settled.filter("gone <> 0").withColumnRenamed("n", "doc_id"), "doc_id").groupBy("gone").agg(F.count(F.lit(1)).alias("docs"))
    counts = each.select("docs", F.explode(F.filter(bits, lambda x: x["bit"].bitwiseAND(F.col("gone")) != 0)).alias("x")).groupBy("x.threshold").agg(F.sum("docs").alias("removed"))
    table = nodes.sparkSession.createDataFrame([(t,) for t in thresholds], "threshold int")
    return table.join(counts, "threshold", "left").select("threshold", F.coalesce("removed", F.lit(0).cast("long")).alias("removed"))


#: Held-out n-grams up to this number are broadcast as 64-bit hashes; beyond it the join is shuffled.
BROADCAST_GRAMS = 1_000_000


def gram_hashes(words: Column, size: int) -> Column:
    """Distinct 64-bit hashes of a word array's n-grams, from the words where they lie; shorter arrays have none."""
    def build(w: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(0), F.size(w) - size), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(size)]))
        return F.when(F.size(w) >= size, F.array_distinct(grams)).otherwise(F.expr("cast(array() as array<bigint>)"))

    return X.let(words, build)


def known_hashes(held_out: DataFrame, hashes: Column) -> DataFrame:
    """(h): the distinct hashes, marked for broadcast if their number allows it."""
    wanted = held_out.select(F.explode(hashes).alias("h")).distinct()
    return F.broadcast(wanted) if wanted.limit(BROADCAST_GRAMS + 1).count() <= BROADCAST_GRAMS else wanted


def contaminated(docs: DataFrame, held_out: DataFrame, size: int, least: int, lower: bool = False) -> DataFrame:
    """(doc_id, hits): documents that share at least `least` distinct word n-grams with held-out texts.

    N-grams meet as 64-bit hashes; the few documents with enough of them are compared by the n-grams themselves.
    """
    def split(t: Column) -> Column:
        t = F.coalesce(t, F.lit(""))
        return X.space_words(F.lower(t) if lower else t)

    hashes = gram_hashes(split(F.col("text")), size)
    found = docs.select("doc_id", F.explode(hashes).alias("h")).join(known_hashes(held_out, hashes), "h", "left_semi")
    likely = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).select("doc_id")
    grams = F.explode(X.word_shingles(split(F.col("text")), size, "none")).alias("g")
    have = docs.join(likely, "doc_id", "left_semi").select("doc_id", grams)
    return have.join(held_out.select(grams).distinct(), "g", "left_semi").groupBy("doc_id").agg(F.count(F.lit(1)).alias("hits")).filter(F.col("hits") >= least)
