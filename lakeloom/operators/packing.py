"""Sequence packing: closed forms over prefix sums by ranges of doc_id, and bin kernels per lane.

Input rows are documents (lane, doc_id, n) with n tokens. Segments are rows
(lane, seq, doc_id, doc_start, doc_end, seq_start, seq_end); ranges are half open.
"""

from __future__ import annotations

import bisect

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.operators import series as S

SEGMENT = "lane string, seq long, doc_id long, doc_start long, doc_end long, seq_start long, seq_end long"
_COLUMNS = [c.split(" ")[0] for c in SEGMENT.split(", ")]


def _numbered(docs: DataFrame, pieces) -> DataFrame:
    """One row per piece k of each document, with its number `seq` in the lane, by doc_id."""
    counted = S.running_total(docs.withColumn("pieces", pieces.cast("long")), "doc_id", "pieces", "upto", by=("lane",))
    each = counted.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)))
    return each.withColumn("seq", F.col("upto") - F.col("pieces") + F.col("k"))


def pad_only(docs: DataFrame, size: int) -> DataFrame:
    """Every document alone, in pieces of at most `size`."""
    pieces = _numbered(docs.filter("n > 0"), F.floor((F.col("n") - 1) / size) + 1)
    start = F.col("k") * size
    end = F.least("n", start + size)
    return pieces.select("lane", "seq", "doc_id", start.alias("doc_start"), end.alias("doc_end"), F.lit(0).cast("long").alias("seq_start"), (end - start).alias("seq_end"))


def concat_chop(docs: DataFrame, size: int) -> DataFrame:
    """A lane's documents as one stream by doc_id, cut at every multiple of `size`."""
    placed = S.running_total(docs.filter("n > 0"), "doc_id", "n", "hi", by=("lane",)).withColumn("lo", F.col("hi") - F.col("n"))
    cut = placed.withColumn("seq", F.explode(F.sequence(F.floor(F.col("lo") / size), F.floor((F.col("hi") - 1) / size))))
    start, end = F.greatest("lo", F.col("seq") * size), F.least("hi", (F.col("seq") + 1) * size)
    return cut.select(
        "lane", "seq", "doc_id", (start - F.col("lo")).alias("doc_start"), (end - F.col("lo")).alias("doc_end"),
        (start - F.col("seq") * size).alias("seq_start"), (end - F.col("seq") * size).alias("seq_end"),
    )


def long_context(docs: DataFrame, size: int) -> DataFrame:
    """Full windows of documents that have at least one; rests are left out."""
    pieces = _numbered(docs.filter(F.col("n") >= size), F.floor(F.col("n") / size))
    return pieces.select(
        "lane", "seq", "doc_id", (F.col("k") * size).alias("doc_start"), ((F.col("k") + 1) * size).alias("doc_end"),
        F.lit(0).cast("long").alias("seq_start"), F.lit(size).cast("long").alias("seq_end"),
    )


def _pieces(pdf: pd.DataFrame, size: int) -> list[tuple[int, int, int]]:
    out = []
    for doc, n in zip(pdf["doc_id"].tolist(), pdf["n"].tolist(), strict=True):
        out += [(doc, a, min(n, a + size)) for a in range(0, n, size)]
    return out


def _rows(lane: str, placed: list[tuple[int, int, int, int, int]]) -> pd.DataFrame:
    return pd.DataFrame([(lane, seq, doc, a, z, at, at + z - a) for seq, doc, a, z, at in placed], columns=_COLUMNS)


class _Rooms:
    """Room left in numbered sequences, of which the first with enough is found in logarithmic time."""

    def __init__(self):
        self._leaves, self._most, self.count = 1, [0, 0], 0

    def _set(self, i: int, room: int) -> None:
        at = self._leaves + i
        self._most[at] = room
        while at > 1:
            at >>= 1
            self._most[at] = max(self._most[2 * at], self._most[2 * at + 1])

    def first_with(self, need: int) -> int | None:
        if self._most[1] < need:
            return None
        at = 1
        while at < self._leaves:
            at = 2 * at if self._most[2 * at] >= need else 2 * at + 1
        return at - self._leaves

    def open(self, room: int) -> int:
        if self.count == self._leaves:
            rooms = self._most[self._leaves :]
            self._leaves *= 2
            self._most = [0] * self._leaves + rooms + [0] * len(rooms)
            for at in range(self._leaves - 1, 0, -1):
                self._most[at] = max(self._most[2 * at], self._most[2 * at + 1])
        self._set(self.count, room)
        self.count += 1
        return self.count - 1

    def room(self, i: int) -> int:
        return self._most[self._leaves + i]

    def take(self, i: int, need: int) -> None:
        self._set(i, self.room(i) - need)


def first_fit(docs: DataFrame, size: int) -> DataFrame:
    """Pieces in order of doc_id, each into the first open sequence with room. One task per lane."""
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        rooms, placed = _Rooms(), []
        for doc, a, z in _pieces(pdf.sort_values("doc_id"), size):
            seq = rooms.first_with(z - a)
            if seq is None:
                seq = rooms.open(size)
            placed.append((seq, doc, a, z, size - rooms.room(seq)))
            rooms.take(seq, z - a)
        return _rows(pdf["lane"].iloc[0], placed)

    return docs.groupBy("lane").applyInPandas(pack, SEGMENT)


def best_fit(docs: DataFrame, size: int) -> DataFrame:
    """Pieces from the longest, each into the fullest sequence that has room, lowest number on ties."""
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        slack: list[tuple[int, int]] = []  # (room, sequence), sorted
        placed, count = [], 0
        for doc, a, z in sorted(_pieces(pdf, size), key=lambda p: (p[1] - p[2], p[0], p[1])):
            need = z - a
            i = bisect.bisect_left(slack, (need, -1))
            if i == len(slack):
                room, seq, count = size, count, count + 1
            else:
                room, seq = slack.pop(i)
            placed.append((seq, doc, a, z, size - room))
            if room > need:
                bisect.insort(slack, (room - need, seq))
        return _rows(pdf["lane"].iloc[0], placed)

    return docs.groupBy("lane").applyInPandas(pack, SEGMENT)


POLICIES = {"pad_only": pad_only, "concat_chop": concat_chop, "long_context": long_context, "first_fit": first_fit, "best_fit": best_fit}


def utilization(segments: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """Per lane: sequences, real tokens, pads, tokens offered and covered, crossings of document borders."""
    per_seq = segments.groupBy("lane", "seq").agg(F.sum(F.col("seq_end") - F.col("seq_start")).alias("real"), (F.count(F.lit(1)) - 1).alias("crossings"))
    filled = per_seq.groupBy("lane").agg(F.count(F.lit(1)).alias("sequences"), F.sum("real").alias("real_tokens"), F.sum("crossings").alias("crossings"))
    spans = segments.select("lane", "doc_id", "doc_start", "doc_end").distinct()
    covered = spans.groupBy("lane").agg(F.sum(F.col("doc_end") - F.col("doc_start")).alias("covered"))
    offered = docs.groupBy("lane").agg(F.sum("n").alias("offered"))
    out = offered.join(filled, "lane", "left").join(covered, "lane", "left").na.fill(0)
    return out.withColumn("pad_tokens", F.col("sequences") * size - F.col("real_tokens"))


def reset_shards(docs: DataFrame, target: int) -> DataFrame:
    """(lane, doc_id, shard): a shard is closed once it has reached `target` tokens. One task per lane."""
    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id")
        shards, shard, held = [], 0, 0
        for n in pdf["n"].tolist():
            shards.append(shard)
            held += n
            if held >= target:
                shard, held = shard + 1, 0
        return pd.DataFrame({"lane": pdf["lane"], "doc_id": pdf["doc_id"], "shard": shards})

    return docs.groupBy("lane").applyInPandas(assign, "lane string, doc_id long, shard long")
