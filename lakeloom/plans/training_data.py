"""Queries on budgets, splits, tokenizers, packing, batches and chat layout."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lakeloom.operators import packing as P
from lakeloom.operators import series as S
from lakeloom.operators import text as X
from lakeloom.operators import tokenizer as K
from lakeloom.session import table

SIZE = 256


def _docs(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", "source", F.col("lang").alias("lane"), F.size(X.space_words(F.coalesce("text", F.lit("")))).cast("long").alias("n"), "text", "lang")


def _lanes(spark, sf):
    return _docs(spark, sf).select("lane", "doc_id", "n")


def token_budget_slice(spark, sf):
    """Documents from row 50 on, up to and with the one that reaches 20,000 tokens of its language."""
    d = S.running_total(_docs(spark, sf).filter("doc_id >= 50 and n > 0"), "doc_id", "n", "cum", by=("lane",))
    return d.filter(F.col("cum") - F.col("n") < 20000).select("lane", "doc_id", "n", "cum")


def per_source_budget(spark, sf):
    d = S.running_total(_docs(spark, sf).filter("n > 0"), "doc_id", "n", "cum", by=("source",))
    return d.filter(F.col("cum") - F.col("n") < 3000).groupBy("source").agg(
        F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.count(F.lit(1)).alias("docs"), F.sum("n").alias("tokens"),
    )


def heldout_after_train(spark, sf):
    last = per_source_budget(spark, sf).select("source", "last_id")
    d = _docs(spark, sf).join(last, "source").filter("doc_id > last_id").withColumn("rn", F.row_number().over(Window.partitionBy("source").orderBy("doc_id")))
    return d.filter("rn <= 3").select("source", "doc_id", "n")


def lane_docs_cap(spark, sf):
    d = _docs(spark, sf).withColumn("rn", F.row_number().over(Window.partitionBy("lane").orderBy("doc_id")))
    return d.filter("rn <= 7").select("lane", "doc_id", "rn")


def blank_line_documents(spark, sf):
    t = F.regexp_replace(F.col("text"), r"\. ", ".\n\n")
    parts = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split(t, r"\n[ \t]*\n")).alias("k", "part"))
    return parts.filter((F.length(F.trim("part")) >= 120) & ~F.trim("part").rlike("^==.*==$")).select("doc_id", F.col("k").cast("long").alias("k"), F.sha2(F.trim("part"), 256).alias("hash"))


def seeded_split(spark, sf):
    """Per lane in seeded order: a twelfth (at least one) for eval, as many for validation, the rest to train."""
    key = F.sha2(F.concat_ws("|", F.lit("seed-7"), F.col("doc_id").cast("string")), 256)
    w = Window.partitionBy("lane")
    d = _lanes(spark, sf).withColumn("rn", F.row_number().over(w.orderBy(key))).withColumn("part", F.greatest(F.lit(1), F.floor(F.count(F.lit(1)).over(w) / 12)))
    split = F.when(F.col("rn") <= F.col("part"), "eval").when(F.col("rn") <= 2 * F.col("part"), "validation").otherwise("train")
    return d.select("doc_id", "lane", split.alias("split"))


def seeded_uniform(spark, sf):
    """The deterministic counter generator: 52 bits of a hash as a fraction, in millionths."""
    u = X.seeded_fraction(F.lit("s"), F.col("doc_id").cast("string"))
    return _docs(spark, sf).select("doc_id", F.floor(u * 1000000).cast("long").alias("u"))


def pretoken_freq_topk(spark, sf):
    return K.pretoken_counts(table(spark, sf, "documents")).orderBy(F.desc("freq"), "token").limit(50)


def pair_freq_topk(spark, sf):
    return K.pair_counts(K.pretoken_counts(table(spark, sf, "documents"))).orderBy(F.desc("freq"), "pair").limit(50)


def one_bpe_merge(spark, sf):
    """The pre-tokens whose piece count the first merge changes."""
    counts = K.pretoken_counts(table(spark, sf, "documents"))
    best = K.pair_counts(counts).orderBy(F.desc("freq"), "pair").limit(1).select("pair")
    # one row
    hit = counts.join(F.broadcast(best), F.col("token").contains(F.col("pair")))
    after = F.length("token") - (F.length("token") - F.length(F.replace(F.col("token"), F.col("pair"), F.lit("")))) / 2
    return hit.select("token", "freq", after.cast("long").alias("pieces"))


def vocabulary_topk(spark, sf):
    """Ids by falling count and then alphabet, id 0 kept for unknown words."""
    c = table(spark, sf, "documents").select(F.explode(X.letter_runs(F.lower("text"))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    top = c.orderBy(F.desc("n"), "w").limit(100)
    return top.select("w", "n", F.row_number().over(Window.orderBy(F.desc("n"), "w")).cast("long").alias("id"))


def bpe_train_encode(spark, sf):
    counts = K.pretoken_counts(table(spark, sf, "documents"))
    pieces = K.piece_udf(K.train_merges(counts, 300))
    return counts.select("token", "freq", pieces("token").alias("pieces"))


def fertility_by_lang(spark, sf):
    d = table(spark, sf, "documents")
    return K.fertility(d, K.train_merges(K.pretoken_counts(d), 300))


def fertility_sweep(spark, sf):
    d = table(spark, sf, "documents")
    merges = K.train_merges(K.pretoken_counts(d), 400)
    out = None
    for n in (100, 200, 400):
        one = K.fertility(d, merges[:n]).withColumn("merges", F.lit(n))
        out = one if out is None else out.unionByName(one)
    return out


def shard_floor(spark, sf):
    d = S.running_total(_lanes(spark, sf), "doc_id", "n", "cum", by=("lane",))
    return d.select("lane", "doc_id", F.floor((F.col("cum") - F.col("n")) / 5000).alias("shard"))


def shard_reset(spark, sf):
    return P.reset_shards(_lanes(spark, sf), 5000)


def pack_pad_only(spark, sf):
    return P.pad_only(_lanes(spark, sf), SIZE)


def pack_concat_chop(spark, sf):
    return P.concat_chop(_lanes(spark, sf), SIZE)


def pack_long_context(spark, sf):
    return P.long_context(_lanes(spark, sf), SIZE)


def pack_greedy(spark, sf):
    return P.first_fit(_lanes(spark, sf), SIZE)


def pack_best_fit(spark, sf):
    return P.best_fit(_lanes(spark, sf), SIZE)


def pack_utilization(spark, sf):
    d, out = _lanes(spark, sf), None
    for name in ("pad_only", "concat_chop", "long_context"):
        one = P.utilization(P.POLICIES[name](d, SIZE), d, SIZE).withColumn("policy", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def pack_ranking(spark, sf):
    """All policies by falling effective yield: fill times coverage."""
    d, out = _lanes(spark, sf), None
    for name, pack in P.POLICIES.items():
        one = P.utilization(pack(d, SIZE), d, SIZE).agg(*[F.sum(c).alias(c) for c in ("sequences", "real_tokens", "covered", "offered")]).withColumn("policy", F.lit(name))
        out = one if out is None else out.unionByName(one)
    fill = F.col("real_tokens") / (F.col("sequences") * SIZE)
    return out.withColumn("yield", fill * F.least(F.lit(1.0), F.col("covered") / F.col("offered"))).orderBy(F.desc("yield"), "policy")


def rank_partition(spark, sf):
    """Rows dealt to 4 ranks in turn, in microbatches of 8."""
    d = S.running_total(_lanes(spark, sf).withColumn("one", F.lit(1).cast("long")), "doc_id", "one", "upto", by=("lane",))
    rn = F.col("upto") - 1
    return d.select("lane", "doc_id", (rn % 4).cast("long").alias("rank"), F.floor(rn / 4 / 8).alias("microbatch"), (F.floor(rn / 4) % 8).alias("slot"))


def rank_disjoint(spark, sf):
    return rank_partition(spark, sf).groupBy("doc_id").agg(F.countDistinct("rank").alias("ranks")).groupBy("ranks").agg(F.count(F.lit(1)).alias("docs"))


def cyclic_pool(spark, sf):
    """Draws 0..99 of each lane's pool: which document, in which epoch."""
    w = Window.partitionBy("lane")
    pool = _lanes(spark, sf).withColumn("pos", F.row_number().over(w.orderBy("doc_id")) - 1).withColumn("size", F.count(F.lit(1)).over(w))
    draws = spark.range(100).select(F.col("id").alias("k"))
    # draws: 100 rows
    return pool.filter("pos < 100").join(F.broadcast(draws), F.col("k") % F.col("size") == F.col("pos")).select("lane", "k", "doc_id", F.floor(F.col("k") / F.col("size")).alias("epoch"))


def token_windows(spark, sf):
    """Hashes of consecutive windows of 9 words."""
    d = table(spark, sf, "documents").select("doc_id", X.space_words(F.col("text")).alias("w"))
    win = d.filter(F.size("w") >= 9).select("doc_id", "w", F.explode(F.sequence(F.lit(0), (F.floor(F.size("w") / 9) - 1).cast("int"))).alias("k"))
    return win.select("doc_id", F.col("k").cast("long").alias("k"), F.sha2(F.array_join(F.slice("w", F.col("k") * 9 + 1, F.lit(9)), " "), 256).alias("hash"))


def chat_flatten(spark, sf):
    """Conversations as one text, turns in order."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.concat(F.lit("<|"), "role", F.lit("|>"), F.coalesce("text", F.lit("")), F.lit("\n")).alias("t"))
    return c.groupBy("conv_id").agg(F.sha2(F.expr("listagg(t, '') within group (order by turn)"), 256).alias("hash"), F.sum(F.length("t")).alias("n_chars"))


def chat_role_spans(spark, sf):
    c = table(spark, sf, "conversations").withColumn("n", F.length(F.concat(F.lit("<|"), "role", F.lit("|>"), F.coalesce("text", F.lit("")), F.lit("\n"))).cast("long"))
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum("n").over(w)
    return c.select("conv_id", "turn", "role", (end - F.col("n")).alias("start"), end.alias("end"))


def loss_bearing_share(spark, sf):
    """Characters that carry loss: assistant turns alone."""
    n = F.length(F.coalesce("text", F.lit(""))).cast("long")
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.sum(F.when(F.col("role") == "assistant", n).otherwise(0)).alias("bearing"), F.sum(n).alias("total"))


def loss_mask_positions(spark, sf):
    """Per packed sequence: loss-bearing positions, where a segment's last token carries none."""
    seg = P.concat_chop(_lanes(spark, sf), SIZE)
    return seg.groupBy("lane", "seq").agg(F.sum(F.col("seq_end") - F.col("seq_start") - 1).alias("bearing"), F.count(F.lit(1)).alias("segments"))


_L = r"l AS (SELECT doc_id, source, lang AS lane, text, len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+')) AS n FROM documents)"
_PAD = f"p AS (SELECT lane, doc_id, n, k, k * {SIZE} AS s, least(n, (k + 1) * {SIZE}) AS e FROM (SELECT *, unnest(range(0, (n - 1) // {SIZE} + 1)) AS k FROM l WHERE n > 0))"
_CHOP = f"o AS (SELECT lane, doc_id, n, sum(n) OVER (PARTITION BY lane ORDER BY doc_id)::BIGINT AS hi FROM l WHERE n > 0), c AS (SELECT *, hi - n AS lo, unnest(range((hi - n) // {SIZE}, (hi - 1) // {SIZE} + 1)) AS seq FROM o)"
PAD_SQL = f"SELECT lane, row_number() OVER (PARTITION BY lane ORDER BY doc_id, k) - 1 AS seq, doc_id, s AS doc_start, e AS doc_end, 0::BIGINT AS seq_start, e - s AS seq_end FROM p"
CHOP_SQL = f"SELECT lane, seq, doc_id, greatest(lo, seq * {SIZE}) - lo AS doc_start, least(hi, (seq + 1) * {SIZE}) - lo AS doc_end, greatest(lo, seq * {SIZE}) - seq * {SIZE} AS seq_start, least(hi, (seq + 1) * {SIZE}) - seq * {SIZE} AS seq_end FROM c"
LONG_SQL = f"SELECT lane, row_number() OVER (PARTITION BY lane ORDER BY doc_id, k) - 1 AS seq, doc_id, k * {SIZE} AS doc_start, (k + 1) * {SIZE} AS doc_end, 0::BIGINT AS seq_start, {SIZE}::BIGINT AS seq_end FROM (SELECT *, unnest(range(0, n // {SIZE})) AS k FROM l WHERE n >= {SIZE})"
_PRE = r"t AS MATERIALIZED (SELECT token, count(*) AS freq FROM (SELECT unnest(regexp_extract_all(lower(text), '[\p{L}\p{M}]+|\p{Nd}+|\S')) AS token FROM documents) GROUP BY token)"
_PAIRS = "pr AS (SELECT substr(token, i, 2) AS pair, sum(freq)::BIGINT AS freq FROM (SELECT token, freq, unnest(range(1, length(token))) AS i FROM t WHERE length(token) > 1) GROUP BY 1)"
_TURN = "'<|' || role || '|>' || coalesce(text, '') || chr(10)"


def _util(name, sql):
    return f"""SELECT lane, '{name}' AS policy, offered, coalesce(sequences, 0) AS sequences, coalesce(real_tokens, 0) AS real_tokens, coalesce(crossings, 0) AS crossings, coalesce(covered, 0) AS covered,
  coalesce(sequences, 0) * {SIZE} - coalesce(real_tokens, 0) AS pad_tokens
FROM (SELECT lane, sum(n)::BIGINT AS offered FROM l GROUP BY lane) LEFT JOIN (SELECT lane, count(*) AS sequences, sum(r)::BIGINT AS real_tokens, sum(x)::BIGINT AS crossings FROM
  (SELECT lane, seq, sum(seq_end - seq_start) AS r, count(*) - 1 AS x FROM ({sql}) GROUP BY ALL) GROUP BY lane) USING (lane)
LEFT JOIN (SELECT lane, sum(doc_end - doc_start)::BIGINT AS covered FROM (SELECT DISTINCT lane, doc_id, doc_start, doc_end FROM ({sql})) GROUP BY lane) USING (lane)"""


QUERIES = {
    "token_budget_slice": (token_budget_slice, f"WITH {_L}, c AS (SELECT lane, doc_id, n, sum(n) OVER (PARTITION BY lane ORDER BY doc_id)::BIGINT AS cum FROM l WHERE doc_id >= 50 AND n > 0) SELECT * FROM c WHERE cum - n < 20000"),
    "per_source_budget": (per_source_budget, f"WITH {_L}, c AS (SELECT source, doc_id, n, sum(n) OVER (PARTITION BY source ORDER BY doc_id) AS cum FROM l WHERE n > 0) SELECT source, min(doc_id) AS first_id, max(doc_id) AS last_id, count(*) AS docs, sum(n)::BIGINT AS tokens FROM c WHERE cum - n < 3000 GROUP BY source"),
    "heldout_after_train": (heldout_after_train, f"WITH {_L}, c AS (SELECT source, doc_id, n, sum(n) OVER (PARTITION BY source ORDER BY doc_id) AS cum FROM l WHERE n > 0), m AS (SELECT source, max(doc_id) AS last_id FROM c WHERE cum - n < 3000 GROUP BY source) SELECT source, doc_id, n FROM l JOIN m USING (source) WHERE doc_id > last_id QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 3"),
    "lane_docs_cap": (lane_docs_cap, f"WITH {_L} SELECT lane, doc_id, row_number() OVER (PARTITION BY lane ORDER BY doc_id)::INT AS rn FROM l QUALIFY rn <= 7"),
    "blank_line_documents": (blank_line_documents, r"WITH s AS (SELECT doc_id, string_split_regex(replace(text, '. ', '.' || chr(10) || chr(10)), '\n[ \t]*\n') AS p FROM documents), e AS (SELECT doc_id, k, trim(p[k + 1]) AS part FROM s, unnest(range(0, len(p))) u(k)) SELECT doc_id, k, sha256(part) AS hash FROM e WHERE length(part) >= 120 AND NOT regexp_matches(part, '^==.*==$')"),
    "seeded_split": (seeded_split, f"WITH {_L}, r AS (SELECT doc_id, lane, row_number() OVER (PARTITION BY lane ORDER BY sha256('seed-7|' || doc_id)) AS rn, greatest(1, count(*) OVER (PARTITION BY lane) // 12) AS part FROM l) SELECT doc_id, lane, CASE WHEN rn <= part THEN 'eval' WHEN rn <= 2 * part THEN 'validation' ELSE 'train' END AS split FROM r"),
    "seeded_uniform": (seeded_uniform, "SELECT doc_id, floor((('0x' || substr(sha256('s|' || doc_id), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE) * 1000000)::BIGINT AS u FROM documents"),
    "pretoken_freq_topk": (pretoken_freq_topk, f"WITH {_PRE} SELECT * FROM t ORDER BY freq DESC, token LIMIT 50"),
    "pair_freq_topk": (pair_freq_topk, f"WITH {_PRE}, {_PAIRS} SELECT * FROM pr ORDER BY freq DESC, pair LIMIT 50"),
    "one_bpe_merge": (one_bpe_merge, f"WITH {_PRE}, {_PAIRS}, b AS MATERIALIZED (SELECT pair FROM pr ORDER BY freq DESC, pair LIMIT 1) SELECT token, freq, length(token) - (length(token) - length(replace(token, (SELECT pair FROM b), ''))) // 2 AS pieces FROM t WHERE contains(token, (SELECT pair FROM b))"),
    "vocabulary_topk": (vocabulary_topk, r"WITH c AS (SELECT w, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+')) AS w FROM documents) GROUP BY w) SELECT w, n, row_number() OVER (ORDER BY n DESC, w) AS id FROM c ORDER BY n DESC, w LIMIT 100"),
    "bpe_train_encode": (bpe_train_encode, None),
    "fertility_by_lang": (fertility_by_lang, None),
    "fertility_sweep": (fertility_sweep, None),
    "shard_floor": (shard_floor, f"WITH {_L} SELECT lane, doc_id, ((sum(n) OVER (PARTITION BY lane ORDER BY doc_id))::BIGINT - n) // 5000 AS shard FROM l"),
    "shard_reset": (shard_reset, f"""WITH RECURSIVE {_L}, o AS (SELECT lane, doc_id, n, row_number() OVER (PARTITION BY lane ORDER BY doc_id) AS i FROM l),
r AS (SELECT lane, doc_id, i, 0::BIGINT AS shard, n AS held FROM o WHERE i = 1 UNION ALL SELECT o.lane, o.doc_id, o.i, CASE WHEN held >= 5000 THEN shard + 1 ELSE shard END, CASE WHEN held >= 5000 THEN o.n ELSE held + o.n END FROM r JOIN o ON o.lane IS NOT DISTINCT FROM r.lane AND o.i = r.i + 1)
SELECT lane, doc_id, shard FROM r"""),
    "pack_pad_only": (pack_pad_only, f"WITH {_L}, {_PAD} {PAD_SQL}"),
    "pack_concat_chop": (pack_concat_chop, f"WITH {_L}, {_CHOP} {CHOP_SQL}"),
    "pack_long_context": (pack_long_context, f"WITH {_L} {LONG_SQL}"),
    "pack_greedy": (pack_greedy, None),
    "pack_best_fit": (pack_best_fit, None),
    "pack_utilization": (pack_utilization, f"WITH {_L}, {_PAD}, {_CHOP} {_util('pad_only', PAD_SQL)} UNION ALL {_util('concat_chop', CHOP_SQL)} UNION ALL {_util('long_context', LONG_SQL)}"),
    "pack_ranking": (pack_ranking, None),
    "rank_partition": (rank_partition, f"WITH {_L}, r AS (SELECT lane, doc_id, row_number() OVER (PARTITION BY lane ORDER BY doc_id) - 1 AS i FROM l) SELECT lane, doc_id, i % 4 AS rank, i // 4 // 8 AS microbatch, (i // 4) % 8 AS slot FROM r"),
    "rank_disjoint": (rank_disjoint, f"WITH {_L}, r AS (SELECT doc_id, (row_number() OVER (PARTITION BY lane ORDER BY doc_id) - 1) % 4 AS rank FROM l), d AS (SELECT doc_id, count(DISTINCT rank) AS ranks FROM r GROUP BY doc_id) SELECT ranks, count(*) AS docs FROM d GROUP BY ranks"),
    "cyclic_pool": (cyclic_pool, f"WITH {_L}, p AS (SELECT lane, doc_id, row_number() OVER (PARTITION BY lane ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY lane) AS size FROM l) SELECT lane, k, doc_id, k // size AS epoch FROM p JOIN range(100) r(k) ON k % size = pos"),
    "token_windows": (token_windows, r"WITH w AS (SELECT doc_id, regexp_extract_all(text, '[^ \t\n\x0B\f\r]+') AS w FROM documents) SELECT doc_id, k, sha256(array_to_string(w[k * 9 + 1 : k * 9 + 9], ' ')) AS hash FROM w, unnest(range(0, len(w) // 9)) u(k)"),
    "chat_flatten": (chat_flatten, f"SELECT conv_id, sha256(string_agg({_TURN}, '' ORDER BY turn)) AS hash, sum(length({_TURN}))::BIGINT AS n_chars FROM conversations GROUP BY conv_id"),
    "chat_role_spans": (chat_role_spans, f"WITH c AS (SELECT conv_id, turn, role, length({_TURN}) AS n, sum(length({_TURN})) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS e FROM conversations) SELECT conv_id, turn, role, e - n AS start, e AS \"end\" FROM c"),
    "loss_bearing_share": (loss_bearing_share, "SELECT conv_id, sum(CASE WHEN role = 'assistant' THEN length(coalesce(text, '')) ELSE 0 END)::BIGINT AS bearing, sum(length(coalesce(text, '')))::BIGINT AS total FROM conversations GROUP BY conv_id"),
    "loss_mask_positions": (loss_mask_positions, f"WITH {_L}, {_CHOP} SELECT lane, seq, sum(seq_end - seq_start - 1)::BIGINT AS bearing, count(*) AS segments FROM ({CHOP_SQL}) GROUP BY ALL"),
}
