"""Queries on catalogues, costs, batches, probes and decision rules, and further tokenizer variants."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from lakeloom.functions import markup as M
from lakeloom.operators import text as X
from lakeloom.operators import tokenizer as K
from lakeloom.plans.planning import micro
from lakeloom.session import table


def catalogue_violations(spark, sf):
    """part as a catalogue: one row per broken rule."""
    p = table(spark, sf, "part")
    repeated = p.groupBy("p_name").agg(F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("key")).filter("n > 1").select("key", F.lit("repeated_name").alias("rule"))
    cheap = p.filter("p_retailprice < 905").select(F.col("p_partkey").alias("key"), F.lit("price_too_low").alias("rule"))
    size = p.filter("p_size > 48").select(F.col("p_partkey").alias("key"), F.lit("size_out_of_range").alias("rule"))
    return repeated.unionByName(cheap).unionByName(size)


def catalogue_missing_ids(spark, sf):
    """Required ids that the catalogue has not, and declared values that differ from the authority's."""
    need = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("key")).distinct()
    have = table(spark, sf, "part").filter("p_partkey % 11 <> 0").select(F.col("p_partkey").alias("key"))
    return need.join(have, "key", "left_anti")


def declared_versus_authority(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM").alias("declared"))
    ship = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.date_format(F.min("l_shipdate"), "yyyy-MM").alias("authority"))
    return o.join(ship, F.col("o_orderkey") == F.col("l_orderkey")).filter("declared <> authority").groupBy("declared").agg(F.count(F.lit(1)).alias("n"))


def citation_table(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_brand", "p_name", F.row_number().over(Window.partitionBy("p_brand").orderBy("p_name", "p_partkey")).alias("n"))


def run_rates(spark, sf):
    """Rates of a run from its counters, in millionths: an event is a step of 64 positions, value is milliseconds."""
    e = table(spark, sf, "events").select("event_type", F.round(F.col("value") * 100).cast("long").alias("ms"), (F.col("event_id") % 64).alias("pad"))
    t = e.groupBy("event_type").agg(F.count(F.lit(1)).alias("steps"), F.sum("ms").alias("ms"), F.sum("pad").alias("pad"))
    return t.select("event_type", "steps", micro(F.col("steps") * 64 / F.col("ms")).alias("raw_rate"), micro((F.col("steps") * 64 - F.col("pad")) / F.col("ms")).alias("useful_rate"), micro(F.col("pad") / (F.col("steps") * 64)).alias("pad_share"))


def run_costs(spark, sf):
    """Cost of lanes at 250 a machine hour, the share wasted on padding, and a projection to a trillion tokens."""
    e = table(spark, sf, "events").select("event_type", F.round(F.col("value") * 100).cast("long").alias("ms"), (F.col("event_id") % 64).alias("pad"))
    t = e.groupBy("event_type").agg(F.count(F.lit(1)).alias("steps"), F.sum("ms").alias("ms"), F.sum("pad").alias("pad"))
    cost = F.col("ms") / 3600000 * 250
    return t.select("event_type", micro(cost).alias("cost"), micro(cost * F.col("pad") / (F.col("steps") * 64)).alias("wasted"), F.floor(F.col("ms") * 1000000 / (F.col("steps") * 64 - F.col("pad"))).alias("ms_per_million"))


def flops_and_hours(spark, sf):
    """Training cost 6 N D at 40 % of a machine's peak, for model and token sizes."""
    n = spark.createDataFrame([(1,), (7,), (40,)], "billions long").join(spark.range(1, 5).select((F.col("id") * 1000).alias("tokens")), how="cross")
    zetta = F.col("billions") * F.col("tokens") * 6
    return n.select("billions", "tokens", zetta.alias("exaflops"), F.floor(zetta * 1000 / (F.lit(4) * 36)).alias("hours"))


def batch_hashes(spark, sf):
    """Identity of a microbatch by its documents, and of its content by their texts."""
    d = table(spark, sf, "documents").select(F.floor(F.col("doc_id") / 16).alias("batch"), "doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))
    return d.groupBy("batch").agg(
        F.sha2(F.expr("listagg(cast(doc_id as string), ',') within group (order by doc_id)"), 256).alias("batch_id"), F.sha2(F.expr("listagg(h, '') within group (order by doc_id)"), 256).alias("content"),
    )


def probe_means(spark, sf):
    """The overall mean weighs tokens, a lane's mean weighs samples."""
    d = table(spark, sf, "documents").select(F.col("lang").alias("lane"), F.length("text").alias("n"), (F.length("text") * (F.col("doc_id") % 9)).alias("loss")).filter("n > 0")
    lane = d.groupBy("lane").agg(F.sum("loss").alias("s"), F.sum("n").alias("t"), F.sum(F.floor(F.col("loss") * 1000 / F.col("n"))).alias("m"), F.count(F.lit(1)).alias("k"))
    return lane.select("lane", micro(F.col("s") / F.col("t")).alias("token_mean"), micro(F.col("m") / F.col("k") / 1000).alias("sample_mean"))


def step_metrics(spark, sf):
    e = table(spark, sf, "events").select(F.floor(F.col("event_id") / 10).alias("step"), (F.col("event_id") % 7 + 1).alias("n"), F.round(F.col("value") * 100).cast("long").alias("loss"))
    t = e.groupBy("step").agg(F.sum(F.col("loss") * F.col("n")).alias("s"), F.sum("n").alias("n"))
    return t.select("step", "n", micro(F.exp(F.least(F.col("s") / F.col("n") / 10000, F.lit(700.0)))).alias("perplexity"))


def bits_per_byte(spark, sf):
    e = table(spark, sf, "events").groupBy("event_type").agg(F.sum(F.round(F.col("value") * 100).cast("long")).alias("s"), F.count(F.lit(1)).alias("n"))
    return e.select("event_type", micro(F.col("s") / F.col("n") / 10000 / math.log(2)).alias("bpb"))


def schedule_probes(spark, sf):
    """Nine evenly spaced steps of a schedule with their three heaviest lanes."""
    from lakeloom.plans.planning import _lanes

    points = spark.range(1, 10).select((F.col("id") * 100).alias("step"))
    d = points.join(_lanes(spark), how="cross").withColumn("w", F.col("weight") * F.when((F.col("step") > 800) & F.col("protected"), 5).otherwise(1))
    return d.withColumn("rank", F.row_number().over(Window.partitionBy("step").orderBy(F.desc("w"), "lane"))).filter("rank <= 3").select("step", "lane", "w", "rank")


def verified_alternation(spark, sf):
    """Draws that hold a verified share of a half while both pools last, then take what is left."""
    d = table(spark, sf, "documents").filter("lang <> 'en'").select("doc_id", (F.col("doc_id") % 3 > 0).alias("verified"))
    rn = F.row_number().over(Window.partitionBy("verified").orderBy("doc_id"))
    d = d.withColumn("rn", rn)
    sizes = d.groupBy().agg(F.count_if("verified").alias("v"), F.count_if(~F.col("verified")).alias("u"))
    pos = F.when(F.col("rn") <= F.least("v", "u"), F.col("rn") * 2 - F.when(F.col("verified"), 1).otherwise(0)).otherwise(F.col("rn") + F.least("v", "u"))
    return d.join(sizes, how="cross").select("doc_id", "verified", pos.cast("long").alias("draw"))


def decision_rules(spark, sf):
    """Rules fixed before a run, as predicates over its measures."""
    m = table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("s"))
    rules = F.array(F.struct(F.lit("enough_rows").alias("rule"), (F.col("n") >= 200).alias("holds")), F.struct(F.lit("mean_below_50").alias("rule"), (F.col("s") < F.col("n") * 5000).alias("holds")))
    return m.select("event_type", F.explode(rules).alias("r")).select("event_type", "r.rule", "r.holds")


def captions_tables(spark, sf):
    extra = '<table class="wikitable"><caption>C</caption><tr><td>a &amp; b<td class="navbox">no</table><figcaption>F</figcaption><p>x'
    return table(spark, sf, "pages").select("page_id", M.captions_and_tables(F.concat(F.coalesce("html", F.lit("")), F.lit(extra))).alias("text"))


def sentence_chunk_sizes(spark, sf):
    d = table(spark, sf, "documents").select("lang", F.explode(M.chunk_udf(400)("text")).alias("c"))
    return d.groupBy("lang").agg(F.count(F.lit(1)).alias("chunks"), F.max(F.length("c")).alias("longest"))


def tokenizer_roundtrip(spark, sf):
    """Documents that a frozen tokenizer encodes and decodes exactly."""
    from pyspark.sql import types as T

    d = table(spark, sf, "documents")
    dumped = K.freeze(K.pretoken_counts(d), 200).dump()

    cached: dict[str, K.FrozenTokenizer] = {}

    def load():  # once a worker and query
        if not cached:
            cached[""] = K.FrozenTokenizer.load(dumped)
        return cached[""]

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def encode(text):
        t = load()
        return text.map(lambda x: t.encode(x or ""))

    @F.pandas_udf(T.StringType())
    def decode(ids):
        t = load()
        return ids.map(lambda x: t.decode(list(x)))

    one = d.select("lang", F.coalesce("text", F.lit("")).alias("t")).withColumn("ids", encode("t")).withColumn("exact", decode("ids") == F.col("t"))
    return one.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), F.count_if("exact").alias("exact"), F.sum(F.size("ids")).alias("tokens"))


def vocabulary_plan(spark, sf):
    """Vocabulary sizes per language with even fertility under one cap."""
    d = table(spark, sf, "documents")
    merges = K.train_merges(K.pretoken_counts(d), 400)
    options = []
    for n in (50, 100, 200, 400):
        options += [(r.lang, n, r.pieces / r.words) for r in K.fertility(d, merges[:n]).collect() if r.lang is not None]
    plan = K.plan_vocabularies(options, 1000)
    return spark.createDataFrame([(x, v, r) for x, (v, r) in sorted(plan.items())], "lang string, vocabulary long, pieces_per_word double")


def fertility_score(spark, sf):
    """Thousand over the spread of characters per word between languages, from counts."""
    d = table(spark, sf, "documents").select("lang", X.space_words(F.coalesce("text", F.lit(""))).alias("w"))
    c = d.groupBy("lang").agg(F.sum(F.aggregate("w", F.lit(0).cast("long"), lambda a, x: a + F.length(x))).alias("chars"), F.sum(F.size("w")).alias("words"))
    r = c.select((F.col("chars") / F.col("words")).alias("r"))
    return r.agg(micro(F.max("r") - F.min("r")).alias("spread"), micro(1000 / F.nullif(F.max("r") - F.min("r"), F.lit(0.0))).alias("score"))


def capacity_curve(spark, sf):
    """Chance that the right one of m items scores highest at signal d: the integral of phi(x - d) Phi(x)^(m - 1)."""
    from pyspark.sql import types as T

    @F.pandas_udf(T.DoubleType())
    def normal_cdf(x):
        return x.map(lambda v: 0.5 * (1 + math.erf(v / math.sqrt(2))))

    x = spark.range(-800, 1601).select((F.col("id") / 100).alias("x")).withColumn("cdf", normal_cdf("x"))
    cases = spark.createDataFrame([(m, d) for m in (8, 64, 512) for d in range(1, 7)], "m long, d long")
    # 18 cases
    phi = F.exp(-(F.col("x") - F.col("d")) * (F.col("x") - F.col("d")) / 2) / math.sqrt(2 * math.pi)
    return x.join(F.broadcast(cases), how="cross").groupBy("m", "d").agg(F.sum(phi * F.pow("cdf", F.col("m") - 1) * 0.01).alias("p"))


def bpe_weight_grid(spark, sf):
    """Fertility per language when one language's counts are weighted in training."""
    d = table(spark, sf, "documents")
    counts = d.select("lang", F.explode(X.pretokens(F.lower("text"))).alias("token")).groupBy("lang", "token").agg(F.count(F.lit(1)).alias("freq"))
    out = None
    for weight in (1, 4):
        freq = F.col("freq") * F.when(F.col("lang") == "es", weight).otherwise(1)
        merges = K.train_merges(counts.groupBy("token").agg(F.sum(freq).alias("freq")), 150)
        one = K.fertility(d, merges).withColumn("weight", F.lit(weight))
        out = one if out is None else out.unionByName(one)
    return out


def title_normalised(spark, sf):
    """Titles compared without case, punctuation and runs of white space."""
    t = F.trim(F.regexp_replace(F.regexp_replace(F.lower("p_name"), "[^a-z0-9 ]", " "), " +", " "))
    return table(spark, sf, "part").select("p_partkey", t.alias("title"))


_E = "round(value * 100)::BIGINT"
_M = "round(({}) * 1000000)::BIGINT".format
_RUN = f"t AS (SELECT event_type, count(*) AS steps, sum({_E})::BIGINT AS ms, sum(event_id % 64)::BIGINT AS pad FROM events GROUP BY 1)"
_FLOP = "SELECT b AS billions, t * 1000 AS tokens, b * t * 6000 AS exaflops, b * t * 6000 * 1000 // 144 AS hours FROM (VALUES (1::BIGINT), (7), (40)) n(b), range(1, 5) r(t)"


def _probe_sql():
    from lakeloom.plans.planning import _LANE_SQL

    return f"WITH {_LANE_SQL}, d AS (SELECT s * 100 AS step, lane, weight * CASE WHEN s > 8 AND protected THEN 5 ELSE 1 END AS w FROM lanes, range(1, 10) r(s)) SELECT step, lane, w, row_number() OVER (PARTITION BY step ORDER BY w DESC, lane)::INT AS rank FROM d QUALIFY rank <= 3"


QUERIES = {
    "catalogue_violations": (catalogue_violations, "SELECT min(p_partkey) AS key, 'repeated_name' AS rule FROM part GROUP BY p_name HAVING count(*) > 1 UNION ALL SELECT p_partkey, 'price_too_low' FROM part WHERE p_retailprice < 905 UNION ALL SELECT p_partkey, 'size_out_of_range' FROM part WHERE p_size > 48"),
    "catalogue_missing_ids": (catalogue_missing_ids, "SELECT DISTINCT l_partkey AS key FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 11 <> 0)"),
    "declared_versus_authority": (declared_versus_authority, "WITH s AS (SELECT l_orderkey, strftime(min(l_shipdate), '%Y-%m') AS authority FROM lineitem GROUP BY 1) SELECT strftime(o_orderdate, '%Y-%m') AS declared, count(*) AS n FROM orders JOIN s ON o_orderkey = l_orderkey WHERE strftime(o_orderdate, '%Y-%m') <> authority GROUP BY 1"),
    "citation_table": (citation_table, "SELECT p_brand, p_name, row_number() OVER (PARTITION BY p_brand ORDER BY p_name, p_partkey)::INT AS n FROM part"),
    "run_rates": (run_rates, f"WITH {_RUN} SELECT event_type, steps, {_M('steps * 64 / ms')} AS raw_rate, {_M('(steps * 64 - pad) / ms')} AS useful_rate, {_M('pad / (steps * 64)')} AS pad_share FROM t"),
    "run_costs": (run_costs, f"WITH {_RUN} SELECT event_type, {_M('ms / 3600000 * 250')} AS cost, {_M('ms / 3600000 * 250 * pad / (steps * 64)')} AS wasted, ms * 1000000 // (steps * 64 - pad) AS ms_per_million FROM t"),
    "flops_and_hours": (flops_and_hours, _FLOP),
    "batch_hashes": (batch_hashes, "SELECT doc_id // 16 AS batch, sha256(string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id)) AS batch_id, sha256(string_agg(sha256(coalesce(text, '')), '' ORDER BY doc_id)) AS content FROM documents GROUP BY 1"),
    "probe_means": (probe_means, f"WITH d AS (SELECT lang AS lane, length(text) AS n, length(text) * (doc_id % 9) AS loss FROM documents WHERE length(text) > 0) SELECT lane, {_M('sum(loss) / sum(n)')} AS token_mean, {_M('sum(loss * 1000 // n) / count(*) / 1000')} AS sample_mean FROM d GROUP BY lane"),
    "step_metrics": (step_metrics, f"WITH e AS (SELECT event_id // 10 AS step, event_id % 7 + 1 AS n, {_E} AS loss FROM events) SELECT step, sum(n)::BIGINT AS n, {_M('exp(least(sum(loss * n) / sum(n) / 10000, 700))')} AS perplexity FROM e GROUP BY step"),
    "bits_per_byte": (bits_per_byte, f"SELECT event_type, {_M(f'sum({_E}) / count(*) / 10000 / ln(2)')} AS bpb FROM events GROUP BY 1"),
    "schedule_probes": (schedule_probes, _probe_sql()),
    "verified_alternation": (verified_alternation, "WITH d AS (SELECT doc_id, doc_id % 3 > 0 AS verified FROM documents WHERE lang <> 'en'), r AS (SELECT *, row_number() OVER (PARTITION BY verified ORDER BY doc_id) AS rn, least(count(*) FILTER (verified) OVER (), count(*) FILTER (NOT verified) OVER ()) AS k FROM d) SELECT doc_id, verified, CASE WHEN rn <= k THEN rn * 2 - CASE WHEN verified THEN 1 ELSE 0 END ELSE rn + k END AS draw FROM r"),
    "decision_rules": (decision_rules, f"WITH m AS (SELECT event_type, count(*) AS n, sum({_E}) AS s FROM events GROUP BY 1) SELECT event_type, 'enough_rows' AS rule, n >= 200 AS holds FROM m UNION ALL SELECT event_type, 'mean_below_50', s < n * 5000 FROM m"),
    "captions_tables": (captions_tables, None),
    "sentence_chunk_sizes": (sentence_chunk_sizes, None),
    "tokenizer_roundtrip": (tokenizer_roundtrip, None),
    "vocabulary_plan": (vocabulary_plan, None),
    "capacity_curve": (capacity_curve, None),
    "bpe_weight_grid": (bpe_weight_grid, None),
    "title_normalised": (title_normalised, "SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g')) AS title FROM part"),
    "fertility_score": (fertility_score, rf"WITH w AS (SELECT lang, regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+') AS w FROM documents), r AS (SELECT sum(list_sum(list_transform(w, lambda x: length(x)))) / sum(len(w)) AS r FROM w GROUP BY lang) SELECT {_M('max(r) - min(r)')} AS spread, {_M('1000 / nullif(max(r) - min(r), 0)')} AS score FROM r"),
}
