"""Queries on ledgers, logs and selection, over events and embeddings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lakeloom.operators import series as S
from lakeloom.session import table

LANES = ("error", "click", "view", "purchase", "signup")


def _ledger(spark, sf):
    """events as a ledger: offset, step of 10 rows, rank, batch id, lane, shard, loss in hundredths."""
    e = table(spark, sf, "events")
    return e.select(
        F.col("event_id").alias("offset"), F.floor(F.col("event_id") / 10).alias("step"), (F.col("event_id") % 2).alias("rank"),
        F.col("user_id").alias("shard"), F.col("event_type").alias("lane"), F.round(F.col("value") * 100).cast("long").alias("loss"),
    )


_LEDGER = "l AS (SELECT event_id AS \"offset\", event_id // 10 AS step, event_id % 2 AS rank, user_id AS shard, event_type AS lane, round(value * 100)::BIGINT AS loss FROM events)"


def ledger_integrity(spark, sf):
    """Gaps, repeats and holes after every 97th row is dropped and every 101st doubled."""
    d = _ledger(spark, sf)
    broken = d.filter("offset % 97 <> 5").unionByName(d.filter("offset % 101 = 0"))
    last = broken.agg(F.max("offset").alias("m"), F.count(F.lit(1)).alias("rows"), F.countDistinct("offset").alias("distinct_offsets"), F.countDistinct("step").alias("steps"))
    repeats = broken.groupBy("offset").agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") > 1).alias("repeated"))
    return last.join(repeats, how="cross").select("rows", "distinct_offsets", "steps", "repeated", (F.col("m") + 1 - F.col("distinct_offsets")).alias("missing"))


def missing_steps(spark, sf):
    """Expected steps that no row has."""
    d = _ledger(spark, sf).filter("step % 13 <> 4")
    # one row: the ledger's last step
    expected = d.agg(F.max("step").alias("m")).select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("m"))).alias("step"))
    return expected.join(d.select("step").distinct(), "step", "left_anti")


def replay_diff(spark, sf):
    """Original and replayed rows compared by offset, null-safe, five fields."""
    a = _ledger(spark, sf)
    b = a.withColumn("loss", F.when(F.col("offset") % 50 == 0, F.col("loss") + 1).otherwise(F.col("loss"))).filter("offset % 333 <> 7").withColumn("offset", F.when(F.col("offset") == 3, F.lit(-1)).otherwise(F.col("offset")))
    names = ("step", "rank", "shard", "lane", "loss")
    right = b.select(F.col("offset").alias("o"), *[F.col(n).alias(f"r_{n}") for n in names])
    j = a.join(right, F.col("offset") == F.col("o"), "full_outer")
    same = F.lit(True)
    for n in names:
        same = same & F.col(n).eqNullSafe(F.col(f"r_{n}"))
    verdict = F.when(F.col("o").isNull(), "only_original").when(F.col("offset").isNull(), "only_replay").when(same, "equal").otherwise("differs")
    return j.groupBy(verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("rows"))


def audit_window(spark, sf):
    """Shards that trained losses 10,000 to 60,000 of the running total."""
    d = S.running_total(_ledger(spark, sf).groupBy("step").agg(F.sum("loss").alias("n")), "step", "n", "hi").withColumn("lo", F.col("hi") - F.col("n"))
    steps = d.filter((F.col("lo") < 60000) & (F.col("hi") > 10000)).select("step")
    return _ledger(spark, sf).join(steps, "step").groupBy("shard").agg(F.countDistinct("step").alias("steps"))


def exposure_window(spark, sf):
    return _ledger(spark, sf).groupBy("shard").agg(F.min("step").alias("first_step"), F.max("step").alias("last_step"), F.count(F.lit(1)).alias("rows"))


def exposure_asof(spark, sf):
    """Probe loss right before a shard's first exposure and right after its last; both must exist and differ."""
    probes = _ledger(spark, sf).filter("step % 25 = 0").groupBy("step").agg(F.sum("loss").alias("loss")).withColumnRenamed("step", "probe")
    e = exposure_window(spark, sf).select("shard", (F.col("first_step") + 30).alias("first_step"), (F.col("last_step") - 60).alias("last_step"))
    before = S.as_of(e.select("shard", "first_step"), probes, "first_step", "probe", "loss").select("shard", F.col("found").alias("before_step"), F.col("value").alias("b"))
    after = S.as_of(e.select("shard", "last_step"), probes, "last_step", "probe", "loss", forward=True).select("shard", F.col("found").alias("after_step"), F.col("value").alias("a"))
    return before.join(after, "shard").filter("before_step <> after_step").select("shard", "before_step", "after_step", (F.col("a") - F.col("b")).alias("delta"))


def learning_aggregates(spark, sf):
    return _ledger(spark, sf).groupBy("lane").agg(
        F.count(F.lit(1)).alias("n"), F.sum("loss").alias("total"), F.max("loss").alias("worst"), F.count_if(F.col("loss") > 600).alias("over_six"),
        F.min_by("loss", "offset").alias("first_loss"), F.max_by("loss", "offset").alias("last_loss"),
    )


def usefulness_classes(spark, sf):
    mean = F.col("total") / F.col("n") / 1000
    kind = F.when(mean <= 0.5, "broken").when(mean <= 1.2, "learned").when(mean < 2.0, "neutral").otherwise("useful")
    return _ledger(spark, sf).groupBy("shard").agg(F.sum("loss").alias("total"), F.count(F.lit(1)).alias("n")).groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("shards"))


def floor_windows(spark, sf):
    """Sliding windows of 20 steps in which a lane has fewer than 30 rows; incomplete windows are left out."""
    d = _ledger(spark, sf)
    steps = d.select("step").distinct()
    grid = steps.join(d.select("lane").distinct(), how="cross")  # dense grid: steps by a handful of lanes
    full = grid.join(d.groupBy("step", "lane").agg(F.count(F.lit(1)).alias("n")), ["step", "lane"], "left").na.fill(0, ["n"])
    w = Window.partitionBy("lane").orderBy("step").rowsBetween(0, 19)
    out = full.withColumn("got", F.sum("n").over(w)).withColumn("rows", F.count(F.lit(1)).over(w)).filter("rows = 20 and got < 30")
    return out.groupBy("lane").agg(F.count(F.lit(1)).alias("windows"), F.min("step").alias("first_step"), F.min("got").alias("lowest"))


def _series(spark, sf):
    return _ledger(spark, sf).groupBy("step").agg(F.sum("loss").alias("loss"))


_SERIES = f"WITH {_LEDGER}, s AS (SELECT step, sum(loss)::BIGINT AS loss FROM l GROUP BY step)"


def lag_deltas(spark, sf):
    d = S.with_previous(_series(spark, sf), "step", "loss").withColumn("delta", F.col("loss") - F.col("previous"))
    return d.filter("delta is not null").orderBy(F.desc("delta"), "step").limit(8).select("step", "loss", "delta")


def cume_percentile(spark, sf):
    w = Window.partitionBy("lane").orderBy("loss")
    return _ledger(spark, sf).select("offset", "lane", (F.cume_dist().over(w) * 100).alias("pct"))


def spike_zscore(spark, sf):
    """Robust z of each step: distance from the trailing median of 50 steps over 1.4826 times their median deviation.

    The window leaves the step itself out; the first step is its own window, and no deviation counts as 1e-9.
    """
    d = S.with_trailing(_series(spark, sf), "step", "loss", 50).withColumn("local", F.when(F.size("trail") > 0, F.col("trail")).otherwise(F.array("loss")))
    d = d.withColumn("med", S.median(F.col("local")))
    d = d.withColumn("mad", S.median(F.transform("local", lambda x: F.abs(x - F.col("med")))))
    z = (F.col("loss") - F.col("med")) / (F.lit(1.4826) * F.when(F.col("mad") == 0, F.lit(1e-9)).otherwise(F.col("mad")))
    return d.select("step", "med", "mad", (z > 6).alias("spike"))


def early_late_health(spark, sf):
    w = Window.partitionBy("lane")
    d = _ledger(spark, sf).withColumn("rn", F.row_number().over(w.orderBy("offset"))).withColumn("n", F.count(F.lit(1)).over(w)).withColumn("k", F.greatest(F.lit(1), F.floor(F.col("n") / 3)))
    return d.filter("n >= 3").groupBy("lane").agg(
        F.sum(F.when(F.col("rn") <= F.col("k"), F.col("loss")).otherwise(0)).alias("early"), F.sum(F.when(F.col("rn") > F.col("n") - F.col("k"), F.col("loss")).otherwise(0)).alias("late"), F.max("k").alias("k"),
    )


def step_sessions(spark, sf):
    """Segments of a log: a new one starts where the step does not rise."""
    d = S.with_previous(_ledger(spark, sf).select("offset", (F.col("step") % 37).alias("step")), "offset", "step")
    d = S.running_total(d.withColumn("starts", F.when(F.col("step") < F.col("previous"), 1).otherwise(0).cast("long")), "offset", "starts", "seg")
    return d.groupBy("seg").agg(F.min("offset").alias("first_offset"), F.count(F.lit(1)).alias("rows"), F.max("step").alias("last_step"))


def nearest_rank_quantiles(spark, sf):
    w = Window.partitionBy("lane")
    d = _ledger(spark, sf).withColumn("rn", F.row_number().over(w.orderBy("loss", "offset"))).withColumn("n", F.count(F.lit(1)).over(w))
    pick = lambda q: F.max(F.when(F.col("rn") == F.floor(F.lit(q) * (F.col("n") - 1) / 10) + 1, F.col("loss")))
    return d.groupBy("lane").agg(pick(1).alias("p10"), pick(5).alias("p50"), pick(9).alias("p90"))


def checkpoint_retention(spark, sf):
    rn = F.row_number().over(Window.partitionBy("rank").orderBy(F.desc("step")))
    d = _ledger(spark, sf).filter("step % 100 = 0").select("rank", "step").distinct()
    return d.withColumn("rn", rn).filter("rn <= 3 or step = 200").select("rank", "step")


def lane_share_drift(spark, sf):
    d = _ledger(spark, sf).groupBy("lane").agg(F.count(F.lit(1)).alias("n"))
    total = d.agg(F.sum("n").alias("t"))
    plan = spark.createDataFrame([("click", 40), ("view", 30), ("absent", 30)], "lane string, planned long")
    j = d.join(plan, "lane", "full_outer").join(total, how="cross")
    return j.select("lane", (F.coalesce("n", F.lit(0)) * 100 - F.coalesce("planned", F.lit(0)) * F.col("t")).alias("drift"))


def branch_fork_compare(spark, sf):
    d = _ledger(spark, sf)
    child = d.withColumn("shard", F.when(F.col("step") >= 300, (F.col("shard") + 1)).otherwise(F.col("shard")))
    f = lambda x: x.groupBy("step").agg(F.sum(F.col("shard") * (F.col("rank") + 1)).alias("mark"))
    return f(d).withColumnRenamed("mark", "a").join(f(child).withColumnRenamed("mark", "b"), "step").agg(
        F.count(F.lit(1)).alias("steps"), F.count_if(F.col("a") == F.col("b")).alias("same"), F.min(F.when(F.col("a") != F.col("b"), F.col("step"))).alias("fork_step"),
    )


def evidence_checks(spark, sf):
    """Named checks that hold or not, each derived from a table."""
    d = _ledger(spark, sf)
    checks = {
        "offsets_dense": d.agg((F.max("offset") + 1 == F.count(F.lit(1))).alias("ok")), "offsets_unique": d.agg((F.countDistinct("offset") == F.count(F.lit(1))).alias("ok")),
        "five_lanes": d.agg((F.countDistinct("lane") == 5).alias("ok")), "losses_positive": d.agg((F.min("loss") > 0).alias("ok")), "one_rank": d.agg((F.countDistinct("rank") == 1).alias("ok")),
    }
    out = None
    for name, df in checks.items():
        one = df.select(F.lit(name).alias("check"), "ok")
        out = one if out is None else out.unionByName(one)
    return out


def _scored(spark, sf):
    """Embeddings with a score: thousandths of the sum of all values."""
    e = table(spark, sf, "embeddings")
    s = F.aggregate("embedding", F.lit(0).cast("long"), lambda a, x: a + F.floor(x.cast("double") * 1000).cast("long"))
    return e.select("vec_id", F.col("label").alias("lane"), s.alias("score"))


_SCORED = "s AS (SELECT vec_id, label AS lane, list_sum(list_transform(embedding, lambda x: floor(x::DOUBLE * 1000)::BIGINT))::BIGINT AS score FROM embeddings)"
#: The lane that keeps a floor: its candidates stay whatever their score.
PROTECTED_LANE = 3


def opus_select(spark, sf):
    """Per lane the top tenth (half-even, at least one) is accepted; of the others a protected lane's are kept by override,
    negative scores wait for a later stage and the rest are rejected below the cutoff."""
    w = Window.partitionBy("lane")
    d = _scored(spark, sf).withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), "vec_id"))).withColumn("k", F.greatest(F.lit(1), F.bround(F.count(F.lit(1)).over(w) * F.lit(0.1)).cast("int")))
    status = F.when(F.col("rank") <= F.col("k"), "accepted").when(F.col("lane") == PROTECTED_LANE, "protected_override").when(F.col("score") < 0, "deferred").otherwise("rejected")
    reason = F.when(status == "deferred", "stage_mismatch").when(status == "rejected", "below_threshold")
    return d.select("vec_id", "lane", "score", "rank", status.alias("status"), reason.alias("reason"))


_SELECT = f"{_SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY lane ORDER BY score DESC, vec_id)::INT AS rank, greatest(1, round_even(count(*) OVER (PARTITION BY lane) * 0.1::DOUBLE, 0)::INT) AS k FROM s), o AS (SELECT vec_id, lane, score, rank, CASE WHEN rank <= k THEN 'accepted' WHEN lane = {PROTECTED_LANE} THEN 'protected_override' WHEN score < 0 THEN 'deferred' ELSE 'rejected' END AS status, CASE WHEN rank <= k OR lane = {PROTECTED_LANE} THEN NULL WHEN score < 0 THEN 'stage_mismatch' ELSE 'below_threshold' END AS reason FROM r)"


def selector_summary_grouping_sets(spark, sf):
    d = opus_select(spark, sf)
    sets = [[F.col("status")], [F.col("reason")], [F.col("lane"), F.col("status")]]
    return d.groupingSets(sets, "status", "reason", "lane").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("total"))


def selector_round_stats(spark, sf):
    return opus_select(spark, sf).groupBy("lane").agg(
        F.count(F.lit(1)).alias("candidates"), F.max("score").alias("best"), F.min("score").alias("worst"), F.sum(F.when(F.col("status") == "accepted", F.col("score"))).alias("accepted_total"),
    )


def _dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


#: Query vectors of a block, and rows that one task compares with it at once.
QUERY_BLOCK, ROW_BLOCK = 512, 20_000


def embedding_cosine_topk(spark, sf):
    """For every 100th vector, its five nearest others by cosine, in millionths.

    Queries are packed to blocks and rows dealt to as many; a pair of blocks is one unit, which gives
    out five rows a query, so that what is shuffled after it is bounded by the queries.
    """
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    q = e.filter("vec_id % 100 = 0")
    queries, rows = q.count(), e.count()
    blocks, parts = max(1, -(-queries // QUERY_BLOCK)), max(1, -(-rows // ROW_BLOCK))
    mine = q.select(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "vec_id", "v")
    theirs = e.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int").alias("part"), "vec_id", "v")

    def nearest(left, right):
        import numpy as np
        import pandas as pd

        if not len(left) or not len(right):
            return pd.DataFrame({"q": [], "vec_id": [], "cos": []}).astype("int64")
        a, b = np.stack(left["v"].to_numpy()), np.stack(right["v"].to_numpy())
        norm = np.sqrt((a * a).sum(1))[:, None] * np.sqrt((b * b).sum(1))[None]
        cos = np.where(norm > 0, np.einsum("ij,kj->ik", a, b) / np.where(norm > 0, norm, 1), 0.0)
        cos = np.floor(np.abs(cos) * 1e6 + 0.5).astype(np.int64) * np.sign(cos).astype(np.int64)
        ids, own = right["vec_id"].to_numpy(), left["vec_id"].to_numpy()
        out = []
        for i, one in enumerate(own):
            order = np.lexsort((ids, -cos[i]))
            out += [(one, ids[j], cos[i, j]) for j in order[:6] if ids[j] != one][:5]
        return pd.DataFrame(out, columns=["q", "vec_id", "cos"])

    found = mine.groupBy("block", "part").cogroup(theirs.groupBy("block", "part")).applyInPandas(nearest, "q long, vec_id long, cos long")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("cos"), "vec_id"))).filter("rank <= 5")


def label_centroids(spark, sf):
    e = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("i", "v"))
    return e.groupBy("label", F.col("i").cast("long").alias("i")).agg(F.sum(F.floor(F.col("v").cast("double") * 1000000).cast("long")).alias("total"), F.count(F.lit(1)).alias("n"))


def tumbling_events(spark, sf):
    e = table(spark, sf, "events")
    return e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n")


def sliding_events(spark, sf):
    e = table(spark, sf, "events")
    return e.groupBy(F.window("ts", "6 hours", "2 hours").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users")).select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("start"), "n", "users")


def session_events(spark, sf):
    e = table(spark, sf, "events")
    return e.groupBy("user_id", F.session_window("ts", "12 hours").alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


def json_props(spark, sf):
    e = table(spark, sf, "events").select("event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))
    return e.groupBy("event_type").agg(F.sum("k").alias("total"), F.count("k").alias("present"), F.max("k").alias("top"))


QUERIES = {
    "ledger_integrity": (ledger_integrity, f"WITH {_LEDGER}, b AS (SELECT * FROM l WHERE \"offset\" % 97 <> 5 UNION ALL SELECT * FROM l WHERE \"offset\" % 101 = 0) SELECT count(*) AS rows, count(DISTINCT \"offset\") AS distinct_offsets, count(DISTINCT step) AS steps, (SELECT count(*) FROM (SELECT \"offset\" FROM b GROUP BY 1 HAVING count(*) > 1)) AS repeated, max(\"offset\") + 1 - count(DISTINCT \"offset\") AS missing FROM b"),
    "missing_steps": (missing_steps, f"WITH {_LEDGER}, d AS (SELECT step FROM l WHERE step % 13 <> 4) SELECT s AS step FROM range(0, (SELECT max(step) + 1 FROM d)) r(s) WHERE s NOT IN (SELECT step FROM d)"),
    "replay_diff": (replay_diff, f"""WITH {_LEDGER}, b AS (SELECT CASE WHEN "offset" = 3 THEN -1 ELSE "offset" END AS o, step AS r_step, rank AS r_rank, shard AS r_shard, lane AS r_lane, CASE WHEN "offset" % 50 = 0 THEN loss + 1 ELSE loss END AS r_loss FROM l WHERE "offset" % 333 <> 7)
SELECT CASE WHEN o IS NULL THEN 'only_original' WHEN "offset" IS NULL THEN 'only_replay' WHEN step IS NOT DISTINCT FROM r_step AND rank IS NOT DISTINCT FROM r_rank AND shard IS NOT DISTINCT FROM r_shard AND lane IS NOT DISTINCT FROM r_lane AND loss IS NOT DISTINCT FROM r_loss THEN 'equal' ELSE 'differs' END AS verdict, count(*) AS rows FROM l FULL JOIN b ON "offset" = o GROUP BY 1"""),
    "audit_window": (audit_window, f"{_SERIES}, c AS (SELECT step, loss AS n, sum(loss) OVER (ORDER BY step) AS hi FROM s) SELECT shard, count(DISTINCT step) AS steps FROM l WHERE step IN (SELECT step FROM c WHERE hi - n < 60000 AND hi > 10000) GROUP BY shard"),
    "exposure_window": (exposure_window, f"WITH {_LEDGER} SELECT shard, min(step) AS first_step, max(step) AS last_step, count(*) AS rows FROM l GROUP BY shard"),
    "exposure_asof": (exposure_asof, f"""{_SERIES}, p AS (SELECT step AS probe, loss FROM s WHERE step % 25 = 0), e AS (SELECT shard, min(step) + 30 AS f, max(step) - 60 AS t FROM l GROUP BY shard),
b AS (SELECT shard, max(probe) FILTER (probe <= f) AS b, min(probe) FILTER (probe >= t) AS a FROM e, p GROUP BY shard) SELECT shard, b AS before_step, a AS after_step, y.loss - x.loss AS delta FROM b JOIN p x ON x.probe = b JOIN p y ON y.probe = a WHERE a <> b"""),
    "learning_aggregates": (learning_aggregates, f"WITH {_LEDGER} SELECT lane, count(*) AS n, sum(loss)::BIGINT AS total, max(loss) AS worst, count(*) FILTER (loss > 600) AS over_six, arg_min(loss, \"offset\") AS first_loss, arg_max(loss, \"offset\") AS last_loss FROM l GROUP BY lane"),
    "usefulness_classes": (usefulness_classes, f"WITH {_LEDGER}, g AS (SELECT shard, sum(loss) / count(*) / 1000 AS m FROM l GROUP BY shard) SELECT CASE WHEN m <= 0.5 THEN 'broken' WHEN m <= 1.2 THEN 'learned' WHEN m < 2.0 THEN 'neutral' ELSE 'useful' END AS kind, count(*) AS shards FROM g GROUP BY 1"),
    "floor_windows": (floor_windows, f"""WITH {_LEDGER}, g AS (SELECT step, lane FROM (SELECT DISTINCT step FROM l), (SELECT DISTINCT lane FROM l)), n AS (SELECT g.step, g.lane, count(l.step) AS n FROM g LEFT JOIN l ON l.step = g.step AND l.lane = g.lane GROUP BY ALL),
w AS (SELECT lane, step, sum(n) OVER x AS got, count(*) OVER x AS rows FROM n WINDOW x AS (PARTITION BY lane ORDER BY step ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)) SELECT lane, count(*) AS windows, min(step) AS first_step, min(got)::BIGINT AS lowest FROM w WHERE rows = 20 AND got < 30 GROUP BY lane"""),
    "lag_deltas": (lag_deltas, f"{_SERIES}, d AS (SELECT step, loss, loss - lag(loss) OVER (ORDER BY step) AS delta FROM s) SELECT * FROM d WHERE delta IS NOT NULL ORDER BY delta DESC, step LIMIT 8"),
    "cume_percentile": (cume_percentile, f"WITH {_LEDGER} SELECT \"offset\", lane, cume_dist() OVER (PARTITION BY lane ORDER BY loss) * 100 AS pct FROM l"),
    "spike_zscore": (spike_zscore, f"""{_SERIES}, t AS (SELECT step, loss, list(loss) OVER (ORDER BY step ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING) AS p FROM s),
l2 AS (SELECT step, loss, CASE WHEN coalesce(len(p), 0) > 0 THEN p ELSE [loss] END AS p FROM t), m AS (SELECT *, list_median(p)::DOUBLE AS med FROM l2), d AS (SELECT *, list_median(list_transform(p, lambda x: abs(x - med)))::DOUBLE AS mad FROM m)
SELECT step, med, mad, (loss - med) / (1.4826::DOUBLE * CASE WHEN mad = 0 THEN 1e-9::DOUBLE ELSE mad END) > 6 AS spike FROM d"""),
    "early_late_health": (early_late_health, f"WITH {_LEDGER}, r AS (SELECT lane, loss, row_number() OVER (PARTITION BY lane ORDER BY \"offset\") AS rn, count(*) OVER (PARTITION BY lane) AS n FROM l), k AS (SELECT *, greatest(1, n // 3) AS k FROM r WHERE n >= 3) SELECT lane, sum(CASE WHEN rn <= k THEN loss ELSE 0 END)::BIGINT AS early, sum(CASE WHEN rn > n - k THEN loss ELSE 0 END)::BIGINT AS late, max(k) AS k FROM k GROUP BY lane"),
    "step_sessions": (step_sessions, f"WITH {_LEDGER}, d AS (SELECT \"offset\" AS o, step % 37 AS step FROM l), g AS (SELECT o, step, CASE WHEN step < lag(step) OVER (ORDER BY o) THEN 1 ELSE 0 END AS f FROM d), s AS (SELECT o, step, sum(f) OVER (ORDER BY o)::BIGINT AS seg FROM g) SELECT seg, min(o) AS first_offset, count(*) AS rows, max(step) AS last_step FROM s GROUP BY seg"),
    "nearest_rank_quantiles": (nearest_rank_quantiles, f"WITH {_LEDGER}, r AS (SELECT lane, loss, row_number() OVER (PARTITION BY lane ORDER BY loss, \"offset\") AS rn, count(*) OVER (PARTITION BY lane) AS n FROM l) SELECT lane, " + ", ".join(f"max(CASE WHEN rn = {q} * (n - 1) // 10 + 1 THEN loss END) AS p{q}0" for q in (1, 5, 9)) + " FROM r GROUP BY lane"),
    "checkpoint_retention": (checkpoint_retention, f"WITH {_LEDGER}, d AS (SELECT DISTINCT rank, step FROM l WHERE step % 100 = 0) SELECT rank, step FROM d QUALIFY row_number() OVER (PARTITION BY rank ORDER BY step DESC) <= 3 OR step = 200"),
    "lane_share_drift": (lane_share_drift, f"WITH {_LEDGER}, d AS (SELECT lane, count(*) AS n FROM l GROUP BY lane), p(lane, planned) AS (VALUES ('click', 40), ('view', 30), ('absent', 30)) SELECT lane, coalesce(n, 0) * 100 - coalesce(planned, 0) * (SELECT sum(n) FROM d)::BIGINT AS drift FROM d FULL JOIN p USING (lane)"),
    "branch_fork_compare": (branch_fork_compare, f"WITH {_LEDGER}, a AS (SELECT step, sum(shard * (rank + 1)) AS a, sum(CASE WHEN step >= 300 THEN shard + 1 ELSE shard END * (rank + 1)) AS b FROM l GROUP BY step) SELECT count(*) AS steps, count(*) FILTER (a = b) AS same, min(CASE WHEN a <> b THEN step END) AS fork_step FROM a"),
    "evidence_checks": (evidence_checks, f"WITH {_LEDGER} SELECT 'offsets_dense' AS \"check\", max(\"offset\") + 1 = count(*) AS ok FROM l UNION ALL SELECT 'offsets_unique', count(DISTINCT \"offset\") = count(*) FROM l UNION ALL SELECT 'five_lanes', count(DISTINCT lane) = 5 FROM l UNION ALL SELECT 'losses_positive', min(loss) > 0 FROM l UNION ALL SELECT 'one_rank', count(DISTINCT rank) = 1 FROM l"),
    "opus_select": (opus_select, f"WITH {_SELECT} SELECT * FROM o"),
    "selector_summary_grouping_sets": (selector_summary_grouping_sets, f"WITH {_SELECT} SELECT status, reason, lane, count(*) AS n, sum(score)::BIGINT AS total FROM o GROUP BY GROUPING SETS ((status), (reason), (lane, status))"),
    "selector_round_stats": (selector_round_stats, f"WITH {_SELECT} SELECT lane, count(*) AS candidates, max(score) AS best, min(score) AS worst, sum(CASE WHEN status = 'accepted' THEN score END)::BIGINT AS accepted_total FROM o GROUP BY lane"),
    "embedding_cosine_topk": (embedding_cosine_topk, "WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), j AS (SELECT q.vec_id AS q, e.vec_id, round(list_cosine_similarity(q.v, e.v) * 1000000)::BIGINT AS cos FROM e q JOIN e ON q.vec_id <> e.vec_id WHERE q.vec_id % 100 = 0) SELECT q, vec_id, cos, row_number() OVER (PARTITION BY q ORDER BY cos DESC, vec_id)::INT AS rank FROM j QUALIFY rank <= 5"),
    "label_centroids": (label_centroids, "SELECT label, i, sum(floor(embedding[i + 1]::DOUBLE * 1000000)::BIGINT)::BIGINT AS total, count(*) AS n FROM embeddings, range(64) r(i) GROUP BY ALL"),
    "tumbling_events": (tumbling_events, "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n FROM events GROUP BY ALL"),
    "sliding_events": (sliding_events, "WITH w AS (SELECT time_bucket(INTERVAL 2 HOUR, ts) - i * INTERVAL 2 HOUR AS s, user_id FROM events, range(3) r(i)) SELECT strftime(s, '%Y-%m-%d %H:%M') AS start, count(*) AS n, count(DISTINCT user_id) AS users FROM w GROUP BY s"),
    "session_events": (session_events, "WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 12 HOUR THEN 1 ELSE 0 END AS f FROM events), s AS (SELECT user_id, ts, sum(f) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, k"),
    "json_props": (json_props, "SELECT event_type, sum(k)::BIGINT AS total, count(k) AS present, max(k) AS top FROM (SELECT event_type, json_extract_string(props, '$.k')::BIGINT AS k FROM events) GROUP BY event_type"),
}
