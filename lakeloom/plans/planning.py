"""Queries on token budgets, schedules and the closed-form maths of models: generated rows, exact results.

Real-valued results are given in whole millionths, so that engines agree on them.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from lakeloom.session import table

# Decay of repeated data, passes allowed, lanes with (weight %, floor %, supply in millions of tokens, protected).
DECAY, EPOCH_CAP = 15.387, 4
LANES = (("web", 62, 0.0, 900, False), ("code", 16, 0.0, 120, False), ("indic", 8, 3.0, 9, True), ("multiling", 5, 0.0, 40, False), ("reasoning", 5, 0.0, 8, False), ("agentic", 2, 1.0, 3, True), ("longctx", 2, 1.5, 30, True))
PHASES = (("warm", 0, 200), ("main", 200, 800), ("anneal", 800, 1000))


def micro(c: Column) -> Column:
    return F.round(c * 1000000).cast("long")


def _lanes(spark):
    return spark.createDataFrame([(a, b, c, d, e) for a, b, c, d, e in LANES], "lane string, weight long, floor double, supply long, protected boolean")


_LANE_SQL = "lanes(lane, weight, floor, supply, protected) AS (VALUES " + ", ".join(f"('{a}', {b}::BIGINT, {c}::DOUBLE, {d}::BIGINT, {str(e).lower()})" for a, b, c, d, e in LANES) + ")"


def effective_tokens(unique: Column, epochs: Column) -> Column:
    """Value of `epochs` passes over unique tokens, each further pass worth less."""
    return F.when(unique <= 0, 0.0).otherwise(unique * (1 + DECAY * (1 - F.exp(-F.greatest(F.lit(0.0), epochs - 1) / DECAY))))


def effective_token_curve(spark, sf):
    d = spark.range(1, 41).select("id", (F.col("id") / 4).alias("e"))
    return d.select("id", micro(effective_tokens(F.lit(100), F.col("e"))).alias("effective"))


def scarcity_policy(spark, sf):
    """How each lane covers its demand of a budget of 500 million tokens."""
    d = _lanes(spark).withColumn("demand", F.col("weight") * 5)
    need = F.col("demand") / F.col("supply")
    policy = F.when(F.col("supply") <= 0, "reduce_share").when(need <= 1, "none").when(need <= EPOCH_CAP, "repeat").when(F.col("protected"), "repeat_over_cap").otherwise("defer_to_later_stage")
    served = F.when((need <= EPOCH_CAP) | F.col("protected"), F.col("demand")).otherwise(F.col("supply") * EPOCH_CAP)
    return d.select("lane", "demand", "supply", policy.alias("policy"), served.alias("served"), (F.col("demand") - served).alias("shortfall"),
                    micro(effective_tokens(F.col("supply"), F.least(need, F.when(F.col("protected"), need).otherwise(F.lit(float(EPOCH_CAP)))))).alias("effective"))


def sweep_budgets(spark, sf):
    """Budgets from 100 to 1,500 million: which lanes fall short."""
    b = spark.range(1, 16).select((F.col("id") * 100).alias("budget"))
    d = b.join(_lanes(spark), how="cross").withColumn("demand", F.floor(F.col("budget") * F.col("weight") / 100))
    return d.groupBy("budget").agg(F.count_if(F.col("demand") > F.col("supply") * EPOCH_CAP).alias("short_lanes"), F.sum(F.greatest(F.lit(0), F.col("demand") - F.col("supply") * EPOCH_CAP)).alias("shortfall"))


def lane_share_plan(spark, sf):
    phases = spark.createDataFrame(list(PHASES), "phase string, lo long, hi long")
    boost = F.when((F.col("phase") == "anneal") & F.col("protected"), 3).otherwise(1)
    return _lanes(spark).join(phases, how="cross").groupBy("lane").agg(F.sum(F.col("weight") * boost * (F.col("hi") - F.col("lo"))).alias("share"))


def arm_shares(spark, sf):
    """Ablation arms: one lane without its share, which the others take in proportion."""
    arms = _lanes(spark).select(F.col("lane").alias("arm"))
    d = arms.join(_lanes(spark), how="cross").withColumn("w", F.when(F.col("arm") == F.col("lane"), 0).otherwise(F.col("weight")))
    total = d.groupBy("arm").agg(F.sum("w").alias("t"))
    return d.join(total, "arm").select("arm", "lane", micro(F.col("w") / F.col("t")).alias("share"))


def tier_waterfall(spark, sf):
    """Demand served by lanes in order of weight, each up to its supply."""
    from pyspark.sql import Window

    w = Window.orderBy(F.desc("weight"), "lane").rowsBetween(Window.unboundedPreceding, -1)  # a handful of lanes
    d = _lanes(spark).withColumn("before", F.coalesce(F.sum("supply").over(w), F.lit(0)))
    return d.select("lane", F.greatest(F.lit(0), F.least(F.col("supply"), F.lit(1050) - F.col("before"))).alias("served"))


def crossfade_schedule(spark, sf):
    """Weight of the protected lanes per step: 13 % in a phase, 30 % in the last, blended over 50 steps."""
    s = spark.range(0, 1000, 5).select(F.col("id").alias("step"))
    blend = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("step") - 800 + 50) / 50))
    return s.select("step", F.expr("case when step < 200 then 'warm' when step < 800 then 'main' else 'anneal' end").alias("phase"), micro(0.13 + 0.17 * blend).alias("weight"))


def lr_schedule(spark, sf):
    """Warm-up and cosine decay; warm-up, hold and linear decay; inverse square root."""
    s = spark.range(1, 1001, 9).select(F.col("id").alias("step"))
    t = (F.col("step") - 100) / 900
    return s.select(
        "step",
        micro(F.when(F.col("step") <= 100, F.col("step") / 100).otherwise(0.1 + 0.45 * (1 + F.cos(t * math.pi)))).alias("cosine"),
        micro(F.when(F.col("step") <= 100, F.col("step") / 100).when(F.col("step") <= 800, 1.0).otherwise((1000 - F.col("step")) / 200)).alias("hold"),
        micro(F.when(F.col("step") <= 100, F.col("step") / 100).otherwise(10 / F.sqrt("step"))).alias("root"),
    )


def stage_bounds(spark, sf):
    """Steps of stages by rounded weights, the last takes the rest."""
    from pyspark.sql import Window

    d = spark.createDataFrame([(0, 0.155), (1, 0.335), (2, 0.51)], "stage int, weight double").withColumn("n", F.greatest(F.lit(1), F.bround(F.col("weight") * 1003).cast("long")))
    hi = F.sum("n").over(Window.orderBy("stage").rowsBetween(Window.unboundedPreceding, 0))
    return d.select("stage", (hi - F.col("n")).alias("lo"), F.when(F.col("stage") == 2, 1003).otherwise(hi).alias("hi"))


def apportion_rows(weights: dict[str, float], floors: dict[str, float], steps: int, per_step: int) -> list[tuple[int, str, int, str]]:
    """(step, lane, quota, reason): whole draws per step, what rounding leaves is carried to later steps.

    A lane is due when its carried claim is largest; lanes behind their floor come first.
    """
    owed, given, out = dict.fromkeys(weights, 0.0), dict.fromkeys(weights, 0), []
    for step in range(steps):
        quota: dict[tuple[str, str], int] = {}
        for lane, w in weights.items():
            owed[lane] += w * per_step
        for _ in range(per_step):
            done = sum(given.values()) + 1
            behind = [x for x in sorted(floors) if given[x] < math.floor(floors[x] * done)]
            lane = behind[0] if behind else max(sorted(owed), key=lambda x: owed[x])
            owed[lane] -= 1
            given[lane] += 1
            key = (lane, "floor" if behind else "share")
            quota[key] = quota.get(key, 0) + 1
        out += [(step, lane, n, why) for (lane, why), n in sorted(quota.items())]
    return out


def apportion_schedule(spark, sf):
    rows = apportion_rows({a: b / 100 for a, b, *_ in LANES}, {a: c / 100 for a, _, c, *_ in LANES if c}, 200, 6)
    return spark.createDataFrame(rows, "step long, lane string, quota long, reason string")


def _positions(spark, n=32):
    i = spark.range(n).select(F.col("id").alias("i"))
    return i.join(spark.range(n).select(F.col("id").alias("j")), how="cross")


_PATTERNS = {
    "causal": "j <= i", "strided": "j <= i AND (i - j) % 4 = 0", "window": "j <= i AND i - j < 8", "window_sink": "j <= i AND (i - j < 8 OR j < 2)",
    "blocks": "j <= i AND (i // 8 = j // 8 OR j % 8 = 7)",
}


def mask_patterns_density(spark, sf):
    """Visible pairs of each attention pattern over 32 positions."""
    d = _positions(spark)
    return d.agg(*[F.count_if(F.expr(p.replace("//", "div"))).alias(k) for k, p in _PATTERNS.items()])


def softmax_entropy(spark, sf):
    """Entropy of causal rows of a small score matrix, in bits."""
    from pyspark.sql import Window

    w = Window.partitionBy("i")
    d = _positions(spark, 12).filter("j <= i").withColumn("s", ((F.col("i") * 7 + F.col("j") * 3) % 5).cast("double"))
    d = d.withColumn("e", F.exp(F.col("s") - F.max("s").over(w)))
    d = d.withColumn("p", F.col("e") / F.sum("e").over(w))
    return d.groupBy("i").agg(micro(-F.sum(F.col("p") * F.log2("p"))).alias("entropy"), micro(F.sum("p")).alias("total"))


def attention_topk(spark, sf):
    from pyspark.sql import Window

    d = _positions(spark, 16).filter("j <= i").withColumn("s", (F.col("i") * 11 + F.col("j") * 5) % 13)
    return d.withColumn("rank", F.row_number().over(Window.partitionBy("i").orderBy(F.desc("s"), "j"))).filter("rank <= 3").select("i", "j", "s", "rank")


def matmul_long_form(spark, sf):
    """Product of two generated matrices in long form."""
    a = _positions(spark, 12).select(F.col("i"), F.col("j").alias("k"), (F.col("i") + 2 * F.col("j")).alias("a"))
    b = _positions(spark, 12).select(F.col("i").alias("k"), F.col("j"), (F.col("i") * F.col("j") % 7).alias("b"))
    return a.join(b, "k").groupBy("i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("v"))


def rope_invariance(spark, sf):
    """Rotated dot products depend on the distance of positions alone."""
    d = _positions(spark, 16).filter("j <= i").withColumn("f", F.explode(F.array(*[F.lit(10000.0 ** (-k / 4)) for k in range(4)])))
    dot = F.cos(F.col("i") * F.col("f")) * F.cos(F.col("j") * F.col("f")) + F.sin(F.col("i") * F.col("f")) * F.sin(F.col("j") * F.col("f"))
    return d.groupBy("i", "j").agg(micro(F.sum(dot)).alias("v")).groupBy((F.col("i") - F.col("j")).alias("distance")).agg((F.max("v") - F.min("v") <= 1).alias("same"), F.count(F.lit(1)).alias("n"))


def alibi_slopes(spark, sf):
    return spark.range(1, 17).select(F.col("id").alias("head"), micro(F.pow(F.lit(2.0), -F.col("id") / 2)).alias("slope"))


def kv_cache_bytes(spark, sf):
    """Cache bytes for 32 layers of 32 heads of 128 values at two bytes, by scheme and length."""
    schemes = spark.createDataFrame([("mha", 32), ("gqa", 8), ("mqa", 1)], "scheme string, heads long")
    lens = spark.range(0, 6).select((F.lit(1024) * F.pow(F.lit(2), F.col("id")).cast("long")).alias("n"))
    return schemes.join(lens, how="cross").select("scheme", "n", (F.col("heads") * 128 * 32 * 2 * 2 * F.col("n")).alias("bytes"))


PRIMES = (11, 13, 17, 19)


def _crt_terms() -> list[int]:
    m = functools.reduce(lambda a, b: a * b, PRIMES)
    return [m // p * pow(m // p, -1, p) for p in PRIMES]


def crt_roundtrip(spark, sf):
    """Numbers from their residues, and sums of residues as residues of sums."""
    m = functools.reduce(lambda a, b: a * b, PRIMES)
    d = spark.range(0, m, 7).select("id")
    decoded = functools.reduce(lambda a, b: a + b, [F.pmod("id", F.lit(p)) * F.lit(t) for p, t in zip(PRIMES, _crt_terms(), strict=True)])
    shifted = functools.reduce(lambda a, b: a & b, [F.pmod(F.pmod("id", F.lit(p)) + 5, F.lit(p)) == F.pmod(F.col("id") + 5, F.lit(p)) for p in PRIMES])
    return d.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.pmod(decoded, F.lit(m)) == F.col("id")).alias("exact"), F.count_if(shifted).alias("shift_ok"))


def discrete_log_products(spark, sf):
    """Products modulo 19 by adding logarithms to the primitive root 2."""
    logs = [(pow(2, k, 19), k) for k in range(18)]
    t = spark.createDataFrame(logs, "v long, k long")
    a, b = t.select(F.col("v").alias("a"), F.col("k").alias("ka")), t.select(F.col("v").alias("b"), F.col("k").alias("kb"))
    power = F.element_at(F.array(*[F.lit(pow(2, k, 19)) for k in range(18)]), ((F.col("ka") + F.col("kb")) % 18 + 1).cast("int"))
    return a.join(b, how="cross").agg(F.count(F.lit(1)).alias("pairs"), F.count_if(power == F.col("a") * F.col("b") % 19).alias("right"))


def digit_sum_counter(spark, sf):
    d = spark.range(1000, 10000).select(F.aggregate(F.transform(F.split(F.col("id").cast("string"), ""), lambda c: c.cast("int")), F.lit(0), lambda a, c: a + F.coalesce(c, F.lit(0))).alias("s"))
    return d.groupBy("s").agg(F.count(F.lit(1)).alias("n"))


def reversed_digits(spark, sf):
    d = spark.range(0, 5000, 13).select("id", F.posexplode(F.split(F.reverse(F.col("id").cast("string")), "")).alias("place", "digit"))
    return d.filter("digit <> ''").groupBy("id").agg(F.sum(F.col("digit").cast("long") * F.pow(F.lit(10), F.col("place")).cast("long")).alias("value"), F.count(F.lit(1)).alias("places"))


def byte_word_code(spark, sf):
    """Byte and position codes of words, each of weight one over the root of the length; cut at 32 bytes."""
    d = table(spark, sf, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{M}\p{N}]+"), F.lit(0))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).filter("n >= 20")
    h = d.select("w", F.hex(F.encode("w", "UTF-8")).alias("h"))
    size = F.least(F.lit(32), (F.length("h") / 2).cast("int"))
    rows = h.select("w", "h", size.alias("size"), F.explode(F.sequence(F.lit(0), size - 1)).alias("i"))
    code = F.col("i") * 256 + F.conv(F.substring("h", F.col("i") * 2 + 1, F.lit(2)), 16, 10).cast("int")
    return rows.select("w", code.cast("long").alias("code"), micro(1 / F.sqrt("size")).alias("weight"))


def perplexity_by_length(spark, sf):
    """exp of mean loss by bucket of word length; losses are a fixed function of the word."""
    d = table(spark, sf, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{M}\p{N}]+"), F.lit(0))).alias("w")).select(F.least(F.floor(F.length("w") / 4), F.lit(3)).alias("bucket"), (F.length("w") % 5).alias("loss"))
    return d.groupBy("bucket").agg(F.sum("loss").alias("s"), F.count(F.lit(1)).alias("n")).select("bucket", "n", micro(F.exp(F.least(F.col("s") / F.col("n"), F.lit(700.0)))).alias("perplexity"))


def _crt_sql():
    m = functools.reduce(lambda a, b: a * b, PRIMES)
    dec = " + ".join(f"(id % {p}) * {t}" for p, t in zip(PRIMES, _crt_terms(), strict=True))
    ok = " AND ".join(f"((id % {p}) + 5) % {p} = (id + 5) % {p}" for p in PRIMES)
    return f"SELECT count(*) AS n, count(*) FILTER (({dec}) % {m} = id) AS exact, count(*) FILTER ({ok}) AS shift_ok FROM range(0, {m}, 7) r(id)"


def _m(x):
    return f"round(({x}) * 1000000)::BIGINT"


_IJ = "p AS (SELECT i, j FROM range(32) a(i), range(32) b(j))"
_LR_T = f"((step - 100) / 900 * {math.pi}::DOUBLE)"
QUERIES = {
    "effective_token_curve": (effective_token_curve, f"SELECT id, {_m(f'100 * (1 + {DECAY}::DOUBLE * (1 - exp(-greatest(0, id / 4 - 1) / {DECAY}::DOUBLE)))')} AS effective FROM range(1, 41) r(id)"),
    "scarcity_policy": (scarcity_policy, f"""WITH {_LANE_SQL}, d AS (SELECT *, weight * 5 AS demand, weight * 5 / supply AS need FROM lanes), s AS (SELECT *, CASE WHEN need <= {EPOCH_CAP} OR protected THEN demand ELSE supply * {EPOCH_CAP} END AS served, CASE WHEN protected THEN need ELSE least(need, {EPOCH_CAP}) END AS ep FROM d)
SELECT lane, demand, supply, CASE WHEN supply <= 0 THEN 'reduce_share' WHEN need <= 1 THEN 'none' WHEN need <= {EPOCH_CAP} THEN 'repeat' WHEN protected THEN 'repeat_over_cap' ELSE 'defer_to_later_stage' END AS policy, served, demand - served AS shortfall,
  {_m(f'supply * (1 + {DECAY}::DOUBLE * (1 - exp(-greatest(0, ep - 1) / {DECAY}::DOUBLE)))')} AS effective FROM s"""),
    "sweep_budgets": (sweep_budgets, f"WITH {_LANE_SQL}, d AS (SELECT b * 100 AS budget, b * 100 * weight // 100 AS demand, supply FROM lanes, range(1, 16) r(b)) SELECT budget, count(*) FILTER (demand > supply * {EPOCH_CAP}) AS short_lanes, sum(greatest(0, demand - supply * {EPOCH_CAP}))::BIGINT AS shortfall FROM d GROUP BY budget"),
    "lane_share_plan": (lane_share_plan, f"WITH {_LANE_SQL} SELECT lane, weight * (800 + 200 * CASE WHEN protected THEN 3 ELSE 1 END) AS share FROM lanes"),
    "arm_shares": (arm_shares, f"WITH {_LANE_SQL} SELECT a.lane AS arm, l.lane, {_m('CASE WHEN a.lane = l.lane THEN 0 ELSE l.weight END / (100 - a.weight)')} AS share FROM lanes a, lanes l"),
    "tier_waterfall": (tier_waterfall, f"WITH {_LANE_SQL}, b AS (SELECT lane, supply, coalesce(sum(supply) OVER (ORDER BY weight DESC, lane ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS b FROM lanes) SELECT lane, greatest(0, least(supply, 1050 - b)) AS served FROM b"),
    "crossfade_schedule": (crossfade_schedule, f"SELECT step, CASE WHEN step < 200 THEN 'warm' WHEN step < 800 THEN 'main' ELSE 'anneal' END AS phase, {_m('0.13::DOUBLE + 0.17::DOUBLE * greatest(0.0::DOUBLE, least(1.0::DOUBLE, (step - 800 + 50) / 50))')} AS weight FROM range(0, 1000, 5) r(step)"),
    "lr_schedule": (lr_schedule, f"SELECT step, {_m(f'CASE WHEN step <= 100 THEN step / 100 ELSE 0.1::DOUBLE + 0.45::DOUBLE * (1 + cos({_LR_T})) END')} AS cosine, {_m('CASE WHEN step <= 100 THEN step / 100 WHEN step <= 800 THEN 1.0::DOUBLE ELSE (1000 - step) / 200 END')} AS hold, {_m('CASE WHEN step <= 100 THEN step / 100 ELSE 10 / sqrt(step) END')} AS root FROM range(1, 1001, 9) r(step)"),
    "stage_bounds": (stage_bounds, "WITH d(stage, weight) AS (VALUES (0, 0.155::DOUBLE), (1, 0.335::DOUBLE), (2, 0.51::DOUBLE)), n AS (SELECT stage, greatest(1, round_even(weight * 1003, 0)::BIGINT) AS n FROM d), h AS (SELECT stage, n, sum(n) OVER (ORDER BY stage)::BIGINT AS hi FROM n) SELECT stage, hi - n AS lo, CASE WHEN stage = 2 THEN 1003 ELSE hi END AS hi FROM h"),
    "apportion_schedule": (apportion_schedule, None),
    "mask_patterns_density": (mask_patterns_density, f"WITH {_IJ} SELECT " + ", ".join(f"count(*) FILTER ({p}) AS {k}" for k, p in _PATTERNS.items()) + " FROM p"),
    "softmax_entropy": (softmax_entropy, f"WITH p AS (SELECT i, ((i * 7 + j * 3) % 5)::DOUBLE AS s FROM range(12) a(i), range(12) b(j) WHERE j <= i), e AS (SELECT i, exp(s - max(s) OVER (PARTITION BY i)) AS e FROM p), q AS (SELECT i, e / sum(e) OVER (PARTITION BY i) AS p FROM e) SELECT i, {_m('-sum(p * log2(p))')} AS entropy, {_m('sum(p)')} AS total FROM q GROUP BY i"),
    "attention_topk": (attention_topk, "SELECT i, j, (i * 11 + j * 5) % 13 AS s, row_number() OVER (PARTITION BY i ORDER BY (i * 11 + j * 5) % 13 DESC, j)::INT AS rank FROM range(16) a(i), range(16) b(j) WHERE j <= i QUALIFY rank <= 3"),
    "matmul_long_form": (matmul_long_form, "SELECT i, j, sum((i + 2 * k) * (k * j % 7))::BIGINT AS v FROM range(12) a(i), range(12) b(j), range(12) c(k) GROUP BY i, j"),
    "rope_invariance": (rope_invariance, "SELECT d AS distance, true AS same, 16 - d AS n FROM range(16) r(d)"),
    "alibi_slopes": (alibi_slopes, f"SELECT id AS head, {_m('pow(2.0::DOUBLE, -id / 2)')} AS slope FROM range(1, 17) r(id)"),
    "kv_cache_bytes": (kv_cache_bytes, "WITH s(scheme, heads) AS (VALUES ('mha', 32), ('gqa', 8), ('mqa', 1)) SELECT scheme, n, heads::BIGINT * 128 * 32 * 2 * 2 * n AS bytes FROM s, (SELECT 1024::BIGINT * (1 << i) AS n FROM range(6) r(i))"),
    "crt_roundtrip": (crt_roundtrip, _crt_sql()),
    "discrete_log_products": (discrete_log_products, "SELECT 324::BIGINT AS pairs, 324::BIGINT AS right"),
    "digit_sum_counter": (digit_sum_counter, "SELECT (id // 1000 + id // 100 % 10 + id // 10 % 10 + id % 10)::INT AS s, count(*) AS n FROM range(1000, 10000) r(id) GROUP BY 1"),
    "reversed_digits": (reversed_digits, "SELECT id, id AS value, length(id::VARCHAR) AS places FROM range(0, 5000, 13) r(id)"),
    "byte_word_code": (byte_word_code, rf"WITH w AS (SELECT w FROM (SELECT unnest(regexp_extract_all(text, '[\p{{L}}\p{{M}}\p{{N}}]+')) AS w FROM documents) GROUP BY w HAVING count(*) >= 20), h AS (SELECT w, hex(encode(w)) AS h, least(32, strlen(w)) AS size FROM w) SELECT w, i * 256 + ('0x' || substr(h, i * 2 + 1, 2))::BIGINT AS code, {_m('1 / sqrt(size)')} AS weight FROM h, unnest(range(0, size)) u(i)"),
    "perplexity_by_length": (perplexity_by_length, rf"WITH w AS (SELECT unnest(regexp_extract_all(text, '[\p{{L}}\p{{M}}\p{{N}}]+')) AS w FROM documents), b AS (SELECT least(length(w) // 4, 3) AS bucket, length(w) % 5 AS loss FROM w) SELECT bucket, count(*) AS n, {_m('exp(least(sum(loss) / count(*), 700))')} AS perplexity FROM b GROUP BY bucket"),
}
