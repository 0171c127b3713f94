"""Mixing sources to target weights by Sainte-Lague apportionment.

Sources get targets from weights, held at a multiple of their size. The mix is cut into blocks of
equal word counts; sources receive blocks by highest quotient target / (2 n + 1), and each source's
blocks are apportioned in the same way to its shards by shard size, over a tree of bounded fan-out
when shards are many. Words that no whole block covers make one short block of a source. A shard's
documents stand end to end in a seeded order and are cut into blocks; its quota takes whole passes
over the blocks and then those of lowest seeded hash.
"""

from __future__ import annotations

import heapq
import math
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import dealt_join, documents, free_names, row_keyed, written

NAME = "op8_mix_sources"
ORACLE_SQL = None  # apportionment by quotients is iterative; tests compare with a step-by-step version

#: Weights of the sources in code-point order (null last), repeating.
WEIGHTS = (5, 2, 1)
#: No source's target and no document's share exceeds this multiple of its size.
MAX_REPEATS = 3
#: Words of a block.
BLOCK_WORDS = 16
#: Words of a shard, and the nodes among which one task apportions words.
SHARD_WORDS, FAN = 20_000, 1024
SEED = "mix-1"


def word_count(text: Column) -> Column:
    """Number of runs of characters other than space and U+0009 to U+000D; null gives 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def sainte_lague(claims: list[float], caps: list[int], blocks: int) -> list[int]:
    """Integer quotas by highest quotients claim / (2 n + 1), ties to the earlier, none above its cap.

    Claims rounded at a common divisor are the quotas of an apportionment of nearly as many blocks;
    the divisor is taken anew while caps leave more blocks over than there are claims, and single
    blocks are then added by highest or taken back by lowest quotient.
    """
    exact = [Fraction(c) for c in claims]
    scale = math.lcm(*(c.denominator for c in exact)) if exact else 1
    whole = [int(c * scale) for c in exact]
    blocks = min(blocks, sum(cap for c, cap in zip(whole, caps, strict=True) if c))
    quotas, open_at, left = [0] * len(whole), [i for i, c in enumerate(whole) if c and caps[i] > 0], blocks
    while open_at and left > 0:
        total = sum(whole[i] for i in open_at)
        for i in open_at:
            quotas[i] = min(caps[i], (2 * whole[i] * left + total) // (2 * total))
        held = [i for i in open_at if quotas[i] == caps[i]]
        if not held or sum(quotas[i] for i in open_at) >= left - len(open_at):
            break
        left -= sum(caps[i] for i in held)
        gone = set(held)
        open_at = [i for i in open_at if i not in gone]
    left = blocks - sum(quotas)
    more = [(Fraction(-whole[i], 2 * quotas[i] + 1), i) for i in range(len(whole)) if whole[i] and quotas[i] < caps[i]] if left > 0 else []
    heapq.heapify(more)
    for _ in range(max(0, left)):
        _, i = heapq.heappop(more)
        quotas[i] += 1
        if quotas[i] < caps[i]:
            heapq.heappush(more, (Fraction(-whole[i], 2 * quotas[i] + 1), i))
    less = [(Fraction(whole[i], 2 * quotas[i] - 1), -i) for i in range(len(whole)) if quotas[i]] if left < 0 else []
    heapq.heapify(less)
    for _ in range(max(0, -left)):
        _, i = heapq.heappop(less)
        i = -i
        quotas[i] -= 1
        if quotas[i]:
            heapq.heappush(less, (Fraction(whole[i], 2 * quotas[i] - 1), -i))
    return quotas


def deal_words(words: int, sizes: list[int], block: int = BLOCK_WORDS, repeats: int = MAX_REPEATS) -> list[int]:
    """`words` over nodes of these sizes: whole blocks by Sainte-Lague, the rest by highest next quotient with room."""
    quotas = sainte_lague([float(s) for s in sizes], [repeats * s // block for s in sizes], words // block)
    out = [q * block for q in quotas]
    left = min(words, repeats * sum(sizes)) - sum(out)
    for i in sorted(range(len(sizes)), key=lambda i: (Fraction(-sizes[i], 2 * quotas[i] + 1), i)) if left else ():
        more = min(left, repeats * sizes[i] - out[i])
        out[i] += more
        left -= more
    return out


def water_fill(sizes: list[int], weights: list[int], repeats: int = MAX_REPEATS) -> list[float]:
    """Targets in proportion to weights that share the sum of sizes, each at most repeats * its size."""
    total, open_at = sum(sizes), [i for i, s in enumerate(sizes) if s]
    targets = [0.0] * len(sizes)
    left = Fraction(total)
    while open_at:
        share = left / sum(weights[i] for i in open_at)
        full = [i for i in open_at if share * weights[i] > repeats * sizes[i]]
        if not full:
            for i in open_at:
                targets[i] = float(share * weights[i])
            break
        for i in full:
            targets[i] = float(repeats * sizes[i])
            left -= repeats * sizes[i]
        held = set(full)
        open_at = [i for i in open_at if i not in held]
    return targets


def _source_plan(weights: tuple[int, ...], block: int, repeats: int):
    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        order = sorted(range(len(pdf)), key=lambda i: (pd.isna(pdf["source"].iloc[i]), pdf["source"].iloc[i] or ""))
        pdf = pdf.iloc[order].reset_index(drop=True)
        sizes = [int(x) for x in pdf["source_size"]]
        targets = water_fill(sizes, [weights[i % len(weights)] for i in range(len(sizes))], repeats)
        quotas = sainte_lague(targets, [repeats * s // block for s in sizes], sum(sizes) // block)
        # What a source's blocks leave of its target, or exceed it by, is one short block.
        short = [max(1 - block, min(block - 1, round(t) - q * block)) for q, t in zip(quotas, targets, strict=True)]
        words = [min(repeats * s, q * block + more) for q, more, s in zip(quotas, short, sizes, strict=True)]
        return pd.DataFrame({"src": pdf["src"], "n": pdf["n"], "source_size": sizes, "target": targets, "quota": quotas, "words": words})

    return plan


def _deal(block: int, repeats: int):
    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node").reset_index(drop=True)
        pdf["words"] = deal_words(int(pdf["words"].iloc[0]) if len(pdf) else 0, [int(x) for x in pdf["node_size"]], block, repeats)
        return pdf[["src", "node", "node_size", "words"]]

    return plan


def shard_quotas(shards: DataFrame, plan: DataFrame, most: int, block: int = BLOCK_WORDS, repeats: int = MAX_REPEATS) -> DataFrame:
    """(src, shard, shard_size, words) from (src, shard, shard_size) and (src, words); no source has over `most` shards.

    A node's words are dealt to at most FAN nodes under it, level by level down to the shards.
    """
    levels = 1
    while FAN**levels < most:
        levels += 1
    above = plan.select("src", F.lit(0).cast("long").alias("parent"), "words")
    for level in reversed(range(levels)):
        nodes = shards.groupBy("src", F.floor(F.col("shard") / F.lit(FAN**level)).alias("node")).agg(F.sum("shard_size").alias("node_size"))
        nodes = nodes.withColumn("parent", F.floor(F.col("node") / F.lit(FAN))).join(above, ["src", "parent"])
        dealt = nodes.groupBy("src", "parent").applyInPandas(_deal(block, repeats), "src string, node long, node_size long, words long")
        above = dealt.select("src", F.col("node").alias("parent"), "words")
    return dealt.select("src", F.col("node").alias("shard"), F.col("node_size").alias("shard_size"), "words")


def _block_hash(seed: str, number: Column) -> Column:
    return F.xxhash64(F.lit(seed), F.col("src"), F.col("shard"), number.cast("long"))


def block_choice(quotas: DataFrame, block: int = BLOCK_WORDS, seed: str = SEED) -> DataFrame:
    """quotas with passes (whole ones over the shard), and the last chosen block: its hash, number and words taken.

    Blocks stand in order of (hash, number); those before the last chosen one are taken whole. A
    shard without a part of a pass has a null last block. One row a shard, of SHARD_WORDS / block
    hashes, or as many as its largest document has blocks.
    """
    size, n = F.col("shard_size"), F.ceil(F.col("shard_size") / F.lit(block)).cast("int")
    step = quotas.withColumn("passes", F.floor(F.col("words") / F.greatest(size, F.lit(1)))).withColumn("rest", F.col("words") - F.col("passes") * size)
    blocks = F.transform(F.sequence(F.lit(0), n - 1), lambda b: F.struct(_block_hash(seed, b).alias("h"), b.alias("b")))
    step = step.withColumn("order", F.when(F.col("rest") > 0, F.array_sort(blocks)))
    short = size - F.lit(block) * (n - 1)
    whole = F.ceil(F.col("rest") / F.lit(block)).cast("int")
    step = step.withColumn("whole", whole).withColumn("short_at", F.array_position(F.transform("order", lambda x: x["b"]), n - 1).cast("int"))
    # Words of the first `whole` blocks, of which one may be the shard's short last one.
    reach = F.lit(block) * F.col("whole") - F.when(F.col("short_at") <= F.col("whole"), F.lit(block) - short).otherwise(0)
    chosen = F.when(reach >= F.col("rest"), F.col("whole")).otherwise(F.col("whole") + 1)
    step = step.withColumn("chosen", chosen).withColumn("last", F.get("order", F.col("chosen") - 1))
    covered = F.lit(block) * F.col("chosen") - F.when(F.col("short_at") <= F.col("chosen"), F.lit(block) - short).otherwise(0)
    length = F.when(F.col("last.b") == n - 1, short).otherwise(F.lit(block))
    return step.select("src", "shard", "passes", F.col("last.h").alias("last_hash"), F.col("last.b").alias("last_block"), (length - (covered - F.col("rest"))).alias("last_words"))


def mix_sources(
    df: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = MAX_REPEATS, block: int = BLOCK_WORDS, seed: str = SEED,
    row_col: str | None = None,
) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken, and the column row_col if one is named.

    A source's taken words are its blocks and a short one, which together are its target, rounded. Rows without words have size and taken 0; a null
    source is a source of its own, the last. Rows that share a doc_id, or have none, are documents
    of their own and get the words of their own blocks; rows repeated whole are dealt words one
    after the other, so that which of them gets more is not defined. An empty table gives no rows;
    columns besides doc_id, source, text and row_col are ignored. Results depend on those and the
    seed alone, not on partitioning.
    """
    # Only ids and counts are shuffled; a source of any weight is spread over its shards.
    more = [] if row_col is None else [F.col(f"`{row_col}`").alias("row")]
    keys = [F.col("doc_id").cast("long"), F.xxhash64("text"), *([] if row_col is None else [F.col(f"`{row_col}`")])]
    src = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n"))
    rows = df.select(
        F.col("doc_id").cast("long").alias("doc_id"), src.alias("src"), F.col("source").cast("string").alias("source"),
        word_count(F.col("text")).alias("size"), F.xxhash64(F.lit(seed), *keys).alias("draw"), *more,
    )
    rows = written(rows, "mix-rows")
    sources = rows.groupBy("src").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    plan = written(sources.groupBy().applyInPandas(
        _source_plan(weights, block, repeats), "src string, n long, source_size long, target double, quota long, words long"
    ), "mix-plan")
    most = max(1, -(-(plan.agg(F.max("source_size")).first()[0] or 0) // SHARD_WORDS))
    facts = plan.select("src", "source_size", "target")
    planned = dealt_join(rows.drop("source"), facts, "src", "draw", plan.select("src", "n"), rows.count())
    spread = F.greatest(F.lit(1), F.ceil(F.col("source_size") / SHARD_WORDS))
    planned = planned.withColumn("shard", F.pmod(F.col("draw"), spread))
    shards = planned.groupBy("src", "shard").agg(F.sum("size").alias("shard_size"))
    choice = block_choice(shard_quotas(shards, plan, most, block, repeats), block, seed)
    dealt = planned.join(choice.hint("merge"), ["src", "shard"])
    order = Window.partitionBy("src", "shard").orderBy("draw", "doc_id", "size", *(["row"] if more else [])).rowsBetween(Window.unboundedPreceding, 0)
    dealt = dealt.withColumn("end", F.sum("size").over(order)).withColumn("start", F.col("end") - F.col("size"))

    def part(total: Column, b: Column) -> Column:
        h = _block_hash(seed, b)
        before = (h < F.col("last_hash")) | ((h == F.col("last_hash")) & (b < F.col("last_block")))
        stop = b * block + F.when(before, F.lit(block)).when(b == F.col("last_block"), F.col("last_words")).otherwise(0)
        return total + F.greatest(F.lit(0).cast("long"), F.least(F.col("end"), stop) - F.greatest(F.col("start"), b * block))

    numbers = F.sequence(F.floor(F.col("start") / block), F.floor((F.col("end") - 1) / block))
    partly = F.when(F.col("last_hash").isNull() | (F.col("size") == 0), F.lit(0).cast("long")).otherwise(F.aggregate(numbers, F.lit(0).cast("long"), part))
    out = dealt.select("doc_id", "size", "source_size", "target", (F.col("passes") * F.col("size") + partly).cast("long").alias("taken"), *(["row"] if more else []))
    return out if row_col is None else out.withColumnRenamed("row", row_col)


def mixed_documents(df: DataFrame) -> DataFrame:
    """The documents of the mix with df's columns: each as often as the words taken from it fill it, rounded half up.

    Rows that share a doc_id, or have none, stand for themselves: each in the copies of its own
    words; documents without words are in no mix. Columns of any name are kept as they are; an empty
    table gives no rows.
    """
    row, copies, copy = free_names(df, "_row", "_copies", "_copy")
    rows = row_keyed(df, row)
    taken = mix_sources(rows, row_col=row).filter("taken > 0").select(
        F.col(row).alias("taken_row"), F.floor(F.col("taken") / F.col("size") + F.lit(0.5)).cast("int").alias(copies)
    ).filter(F.col(copies) > 0).withColumnRenamed("taken_row", row)
    out = rows.join(taken, row)
    return out.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*[F.col(f"`{c}`") for c in df.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir))
