"""Queries on curricula: ladders, reserves, supply by lane, decisions and their evidence, policies, recovery."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lakeloom.operators import packing as P
from lakeloom.operators import series as S
from lakeloom.operators import text as X
from lakeloom.plans.ledgers import _LEDGER, _SERIES, _ledger, _series
from lakeloom.plans.planning import micro
from lakeloom.session import table

#: (phase, from this share of all steps in thousandths, to below it).
PHASES = (("A", 0, 400), ("B", 400, 700), ("C", 700, 900), ("D", 900, 1001))
#: (phase, sequence length, percent of its steps).
LADDER = (("A", 64, 100), ("B", 64, 60), ("B", 128, 40), ("C", 128, 50), ("C", 256, 50), ("D", 256, 70), ("D", 512, 30))
#: (band, percent in each phase).
DIFFICULTY = (("easy", 50, 35, 20, 10), ("medium", 35, 40, 45, 40), ("hard", 15, 25, 35, 50))
#: Pieces per word by language, by source where one differs, and for the rest; in hundredths.
FERTILITY, SOURCE_FERTILITY, OTHER_FERTILITY = (("en", 130), ("fr", 150)), (("src1", 210), ("src4", 95)), 180
WANTED_LANES = ("en", "fr", "de", "es", "code")
#: Policy of a lane, sequence length, and the policy that takes over where the first packs nothing.
LANE_POLICY, POLICY_SIZES, FALLBACK = (("en", "concat_chop"), ("fr", "pad_only"), ("de", "long_context"), ("es", "long_context")), {"es": 1 << 20}, "concat_chop"
SIZE = 256


def _values(rows, names):
    """A literal table as SQL."""
    return f"(VALUES {', '.join(str(r if len(r) > 1 else f'({r[0]!r})') for r in rows)}) v({names})"


def _bounds():
    """Ladder rows with the percent at which each starts and stops in its phase."""
    out, at = [], {}
    for phase, size, share in LADDER:
        low = at.get(phase, 0)
        at[phase] = low + share
        out.append((phase, size, low, low + share))
    return out


def seq_len_schedule(spark, sf):
    """Phase and sequence length of every step: a range join with the phases, then one with the phase's ladder."""
    last = _ledger(spark, sf).agg((F.max("step") + 1).alias("total"))
    s = _ledger(spark, sf).select("step").distinct().join(last, how="cross")  # one row
    # literal tables of a few rows
    phases = F.broadcast(spark.createDataFrame(list(PHASES), "phase string, low long, high long"))
    ladder = F.broadcast(spark.createDataFrame(_bounds(), "phase string, seq_len long, first long, stop long"))
    at = F.col("step") * 1000
    s = s.join(phases, (F.col("low") * F.col("total") <= at) & (at < F.col("high") * F.col("total")))
    pick = F.pmod(at, F.col("total") * 100)
    return s.join(ladder, "phase").filter((F.col("first") * F.col("total") <= pick) & (pick < F.col("stop") * F.col("total"))).select("step", "phase", "seq_len")


def band_checks(spark, sf):
    """Whether the shares of difficulty bands come to a hundred in each phase."""
    d = spark.createDataFrame(list(DIFFICULTY), "band string, A long, B long, C long, D long")
    long = d.select("band", F.explode(F.create_map(*[x for p in "ABCD" for x in (F.lit(p), F.col(p))])).alias("phase", "share"))
    return long.groupBy("phase").agg(F.sum("share").alias("total"), (F.sum("share") == 100).alias("holds"))


def anneal_reserve(spark, sf):
    """A tenth of all sources, at least one, in seeded order from those without a document labelled bad."""
    d = table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    s = d.groupBy("source").agg(F.min(F.coalesce("quality", F.lit(1))).alias("worst"))
    n = s.agg(F.greatest(F.lit(1), F.bround(F.count(F.lit(1)) * 0.1).cast("int")).alias("n"))
    rn = F.row_number().over(Window.orderBy(F.sha2(F.concat(F.lit("seed-7|anneal|"), "source"), 256)))
    # a row per eligible source; n is one row
    return s.filter("worst = 1").withColumn("rn", rn).join(n, how="cross").filter("rn <= n").select("source", "rn")


def tier_sets(spark, sf):
    """A source is verified if all its labelled documents are good, null if none is labelled."""
    d = table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    g = d.groupBy("source").agg(F.count("quality").alias("labelled"), F.bool_and(F.col("quality") == 1).alias("good"))
    return g.select("source", F.when(F.col("labelled") == 0, None).when(F.col("good"), "verified").otherwise("unverified").alias("tier"))


def supply_by_lane(spark, sf):
    """Words of each wanted lane turned into tokens by the source's fertility, else its language's, else the default; empty lanes too."""
    d = table(spark, sf, "documents").select("lang", "source", F.size(X.space_words(F.coalesce("text", F.lit("")))).alias("words")).groupBy("lang", "source").agg(F.sum("words").alias("words"))
    by_lang = F.broadcast(spark.createDataFrame(list(FERTILITY), "lang string, f long"))  # literal tables
    by_source = F.broadcast(spark.createDataFrame(list(SOURCE_FERTILITY), "source string, own long"))
    lanes = F.broadcast(spark.createDataFrame([(x,) for x in WANTED_LANES], "lane string"))
    t = d.join(by_source, "source", "left").join(by_lang, "lang", "left").select("lang", (F.col("words") * F.coalesce("own", "f", F.lit(OTHER_FERTILITY))).alias("t"))
    supply = t.groupBy(F.col("lang").alias("lane")).agg(F.sum("t").alias("t"))
    return lanes.join(supply, "lane", "left").select("lane", F.floor(F.coalesce("t", F.lit(0)) / 100).alias("tokens"))


def anneal_supply(spark, sf):
    """Whether a lane's good words cover a tenth of all of its words."""
    d = table(spark, sf, "documents").select("doc_id", "lang", F.size(X.space_words(F.coalesce("text", F.lit("")))).alias("n")).join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    g = d.groupBy("lang").agg(F.sum(F.when(F.col("quality") == 1, F.col("n")).otherwise(0)).alias("eligible"), F.sum("n").alias("all"))
    return g.select("lang", "eligible", F.floor(F.col("all") / 10).alias("demand"), (F.col("eligible") >= F.floor(F.col("all") / 10)).alias("covered"))


def fertility_vs_baseline(spark, sf):
    """Characters per word of two profiles, with and without punctuation, side by side per language."""
    d = table(spark, sf, "documents").select("lang", F.coalesce("text", F.lit("")).alias("t"))
    base = d.groupBy("lang").agg(micro(F.sum(F.length(F.regexp_replace("t", r"[ \t\n\x0B\f\r]+", ""))) / F.sum(F.size(X.space_words(F.col("t"))))).alias("baseline"))
    plain = d.groupBy("lang").agg(micro(F.sum(F.aggregate(X.letter_runs(F.col("t")), F.lit(0), lambda a, x: a + F.length(x))) / F.sum(F.size(X.letter_runs(F.col("t"))))).alias("profile"))
    return plain.join(base, plain["lang"].eqNullSafe(base["lang"])).select(plain["lang"], "baseline", "profile", (F.col("profile") < F.col("baseline")).alias("lower"))


def lane_sources(spark, sf):
    """Sources of each lane, in order."""
    d = table(spark, sf, "documents").filter("lang is not null and source is not null").select("lang", "source").distinct()
    return d.groupBy("lang").agg(F.array_join(F.sort_array(F.collect_list("source")), ",").alias("sources"))  # a row a source


def weight_blend(spark, sf):
    """Shares by documents and by characters blended at a quarter; a lane that one side lacks weighs nothing there."""
    d = table(spark, sf, "documents").select("lang", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n"))
    a = d.filter("lang <> 'es'").groupBy("lang").agg(F.count(F.lit(1)).alias("w"))
    b = d.filter("lang <> 'de'").groupBy("lang").agg(F.sum("n").alias("w"))
    share = lambda x: x.join(x.agg(F.sum("w").alias("t")), how="cross").select("lang", (F.col("w") / F.col("t")).alias("w"))
    both = share(a).join(share(b).withColumnRenamed("w", "v"), "lang", "full_outer")
    return both.select("lang", micro(F.coalesce("w", F.lit(0.0)) * 0.75 + F.coalesce("v", F.lit(0.0)) * 0.25).alias("weight"))


def decision_alignment(spark, sf):
    """Mean alignment of each step's shards: the step's list of shards joined to what is known of each shard."""
    d = _ledger(spark, sf).groupBy("step").agg(F.collect_set("shard").alias("shards"))  # ten rows a step
    shards = _ledger(spark, sf).groupBy("shard").agg(F.floor(F.sum("loss") / F.count(F.lit(1))).alias("alignment"))
    return d.select("step", F.explode("shards").alias("shard")).join(shards, "shard").groupBy("step").agg(F.count(F.lit(1)).alias("shards"), F.sum("alignment").alias("alignment"))


def decisions_before_spike(spark, sf):
    """The last eight steps up to the steepest rise of loss."""
    d = S.with_previous(_series(spark, sf), "step", "loss").withColumn("delta", F.col("loss") - F.col("previous")).filter("delta is not null")
    spike = d.orderBy(F.desc("delta"), "step").limit(1).select(F.col("step").alias("spike"))
    at = _series(spark, sf).join(F.broadcast(spike), F.col("step") <= F.col("spike"))  # one row
    return at.orderBy(F.desc("step")).limit(8).select("step", "loss", "spike")


def seed_spread(spark, sf):
    """Mean, sample deviation and range of the means of five seeds."""
    e = table(spark, sf, "events").groupBy("event_type", (F.col("event_id") % 5).alias("seed")).agg((F.sum(F.round(F.col("value") * 100).cast("long")) / F.count(F.lit(1))).alias("m"))
    return e.groupBy("event_type").agg(micro(F.avg("m")).alias("mean"), F.round(F.stddev_samp("m"), 6).alias("deviation"), micro(F.max("m") - F.min("m")).alias("range"))


def accuracy_by_length(spark, sf):
    """Share of right answers by number of digits: a cast of the last two digits stands in for a model."""
    e = table(spark, sf, "events").select(F.length(F.col("event_id").cast("string")).cast("long").alias("digits"), ((F.col("event_id") * 7) % 10 == F.col("user_id") % 10).alias("right"))
    return e.groupBy("digits").agg(F.count(F.lit(1)).alias("n"), F.count_if("right").alias("right"))


def probe_pair_cosine(spark, sf):
    """Mean cosine of vectors and their neighbours by id."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    p = e.filter("vec_id % 2 = 0").select((F.col("vec_id") + 1).alias("vec_id"), F.col("v").alias("w")).join(e, "vec_id")
    return p.agg(F.count(F.lit(1)).alias("pairs"), F.round(F.avg(dot("v", "w") / F.sqrt(dot("v", "v") * dot("w", "w"))), 9).alias("cosine"))


def centroid_alignment(spark, sf):
    """Candidates ranked by cosine to the centroid of label 0, which stands in for a proxy gradient; the best tenth is accepted."""
    e = table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    mean = e.filter("label = 0").select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.sum(F.floor(F.col("x") * 1000000).cast("long")).alias("x"))
    proxy = mean.agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"].cast("double")).alias("p"))  # one row, a value a dimension
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    scored = e.join(F.broadcast(proxy), how="cross").select("vec_id", "label", F.round(dot("v", "p") / F.sqrt(dot("v", "v") * dot("p", "p")), 6).alias("score"))
    w = Window.partitionBy("label")
    r = scored.withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), "vec_id"))).withColumn("k", F.greatest(F.lit(1), F.bround(F.count(F.lit(1)).over(w) * 0.1).cast("int")))
    return r.select("vec_id", "label", "score", "rank", (F.col("rank") <= F.col("k")).alias("accepted"))


def lane_policies(spark, sf):
    """Each lane packed by its policy; one that packs nothing falls back."""
    d = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("lane"), F.size(X.space_words(F.coalesce("text", F.lit("")))).cast("long").alias("n"))
    out = None
    for lane, policy in LANE_POLICY:
        mine, size = d.filter(F.col("lane") == lane), POLICY_SIZES.get(lane, SIZE)
        first = P.POLICIES[policy](mine, size).withColumn("policy", F.lit(policy)).withColumn("fallback_from", F.lit(None).cast("string"))
        if policy == "long_context":
            # The second policy's rows stand only where the first has none: a count of one row.
            none = first.agg(F.count(F.lit(1)).alias("c")).filter("c = 0").select(F.lit(lane).alias("lane"))
            second = P.POLICIES[FALLBACK](mine, size).join(none, "lane", "left_semi").withColumn("policy", F.lit(FALLBACK)).withColumn("fallback_from", F.lit(policy))
            first = first.unionByName(second)
        out = first if out is None else out.unionByName(first)
    return out.groupBy("lane", "policy", "fallback_from").agg(F.countDistinct("seq").alias("sequences"), F.sum(F.col("seq_end") - F.col("seq_start")).alias("real_tokens"))


def link_crawl(spark, sf):
    """Pages in order of id, stubs of at most 200 visible characters skipped, until 100,000 characters are read."""
    from lakeloom.operators import cleaning as C

    d = table(spark, sf, "pages").filter("html is not null").select("page_id", F.length(C.visible_text(F.col("html"))).cast("long").alias("n")).filter("n > 200")
    return S.running_total(d, "page_id", "n", "read").filter(F.col("read") - F.col("n") < 100000).select("page_id", "n", "read")


def split_violations(spark, sf):
    """Rows of a corpus whose split and training flag contradict: held-out texts that may be trained, and the reverse."""
    d = table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 12 == 0, "eval").when(F.col("doc_id") % 12 == 1, "validation").otherwise("train").alias("split"), (F.col("doc_id") % 12 == 0).alias("never_train"))
    rule = F.when((F.col("split") != "train") & ~F.col("never_train"), "held_out_may_train").when((F.col("split") == "train") & F.col("never_train"), "train_refused")
    return d.groupBy("split", rule.alias("violation")).agg(F.count(F.lit(1)).alias("docs"))


def registry_summary(spark, sf):
    """Firewall verdicts by split."""
    from lakeloom.plans.duplicates import firewall_verdicts
    from lakeloom.plans.training_data import seeded_split

    return firewall_verdicts(spark, sf).join(seeded_split(spark, sf), "doc_id").groupBy("split", "verdict").agg(F.count(F.lit(1)).alias("docs"))


def trace_windows(spark, sf):
    """Rows whose step lies in one of three windows, each with its number, and how many rows there are in all."""
    windows = F.broadcast(spark.createDataFrame([(0, 0, 40), (1, 300, 360), (2, 350, 380)], "k long, low long, high long"))  # three rows
    hit = _ledger(spark, sf).join(windows, (F.col("low") <= F.col("step")) & (F.col("step") < F.col("high")))
    return hit.groupBy("k").agg(F.count(F.lit(1)).alias("rows"), F.sum("loss").alias("loss"))


def resume_check(spark, sf):
    """A run taken up at step 300: cursors per lane as the ledger stood there, the rest served anew, and both runs compared row by row."""
    d = _ledger(spark, sf)
    cursor = d.filter("step < 300").groupBy("lane").agg(F.count(F.lit(1)).alias("cursor"))
    w = Window.partitionBy("lane").orderBy("offset")
    served = d.withColumn("place", F.row_number().over(w))
    anew = d.filter("step >= 300").withColumn("k", F.row_number().over(w)).join(cursor, "lane", "left").select("offset", (F.col("k") + F.coalesce("cursor", F.lit(0))).alias("again"))
    both = served.join(anew, "offset", "left")
    verdict = F.when(F.col("again").isNull(), "before_checkpoint").when(F.col("again") == F.col("place"), "equal").otherwise("differs")
    return both.groupBy("lane", verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("rows"))


def fork_branch(spark, sf):
    """A branch forked at step 300: rows before it are shared, later ones get the branch's own order of shards."""
    d = _ledger(spark, sf)
    child = d.withColumn("branch", F.lit("child")).withColumn("shard", F.when(F.col("step") >= 300, F.col("shard") + 1).otherwise(F.col("shard")))
    both = d.withColumn("branch", F.lit("main")).unionByName(child)
    return both.groupBy("branch", (F.col("step") < 300).alias("shared")).agg(F.count(F.lit(1)).alias("rows"), F.sum("shard").alias("shards"), F.max("step").alias("last_step"))


def checkpoint_hashes(spark, sf):
    """States whose stored hash does not match them, after every fortieth state is changed."""
    d = _ledger(spark, sf).groupBy("step").agg(F.sum("loss").alias("loss"), F.max("offset").alias("last"))
    body = lambda loss: F.concat_ws("|", F.col("step").cast("string"), loss.cast("string"), F.col("last").cast("string"))
    d = d.select("step", F.sha2(body(F.col("loss")), 256).alias("stored"), F.when(F.col("step") % 40 == 0, F.col("loss") + 1).otherwise(F.col("loss")).alias("loss"), "last")
    return d.filter(F.sha2(body(F.col("loss")), 256) != F.col("stored")).select("step", "last")


_N = r"len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+'))"
_LAB = "d AS (SELECT doc_id, source, lang, text, quality FROM documents LEFT JOIN labels USING (doc_id))"
_DOT = "list_dot_product({}, {})".format


def _policy_sql():
    from lakeloom.plans import training_data as T

    parts = []
    for lane, policy in LANE_POLICY:
        size = POLICY_SIZES.get(lane, SIZE)
        chop = f"SELECT '{lane}' AS lane, '{FALLBACK}' AS policy, {{}} AS fallback_from, unnest(range(lo // {size}, (hi - 1) // {size} + 1)) AS seq, lo, hi, {size} AS size FROM (SELECT sum(n) OVER (ORDER BY doc_id)::BIGINT AS hi, (sum(n) OVER (ORDER BY doc_id))::BIGINT - n AS lo FROM l WHERE lane = '{lane}' AND n > 0)"
        if policy == "concat_chop":
            parts.append(f"SELECT lane, policy, fallback_from, count(DISTINCT seq) AS sequences, sum(least(hi, (seq + 1) * size) - greatest(lo, seq * size))::BIGINT AS real_tokens FROM ({chop.format('NULL::VARCHAR')}) GROUP BY ALL")
        elif policy == "pad_only":
            parts.append(f"SELECT '{lane}', '{policy}', NULL, sum((n - 1) // {size} + 1)::BIGINT, sum(n)::BIGINT FROM l WHERE lane = '{lane}' AND n > 0")
        else:
            parts.append(f"SELECT '{lane}', '{policy}', NULL, sum(n // {size})::BIGINT, sum(n // {size})::BIGINT * {size} FROM l WHERE lane = '{lane}' HAVING sum(n // {size}) > 0")
            parts.append(f"SELECT lane, policy, fallback_from, count(DISTINCT seq), sum(least(hi, (seq + 1) * size) - greatest(lo, seq * size))::BIGINT FROM ({chop.format(repr(policy))}) WHERE (SELECT coalesce(sum(n // {size}), 0) FROM l WHERE lane = '{lane}') = 0 GROUP BY ALL")
    return f"WITH {T._L} " + " UNION ALL ".join(parts)


def _registry_sql():
    from lakeloom.plans import duplicates, training_data

    return f"SELECT split, verdict, count(*) AS docs FROM ({duplicates.QUERIES['firewall_verdicts'][1]}) JOIN ({training_data.QUERIES['seeded_split'][1]}) USING (doc_id) GROUP BY ALL"


_VISIBLE = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>', '', 'g'), '(?is)<style.*?</style>', '', 'g'), '(?is)<!--.*?-->|<meta[^>]*>', '', 'g'), '(?s)<[^>]*>', ' ', 'g'), '[ \t\n\r]+', ' ', 'g'))"

QUERIES = {
    "seq_len_schedule": (seq_len_schedule, f"WITH {_LEDGER}, s AS (SELECT DISTINCT step, (SELECT max(step) + 1 FROM l) AS total FROM l), p AS (SELECT * FROM {_values(PHASES, 'phase, low, high')}), b AS (SELECT * FROM {_values(_bounds(), 'phase, seq_len, first, stop')}) SELECT step, p.phase, seq_len::BIGINT AS seq_len FROM s JOIN p ON low * total <= step * 1000 AND step * 1000 < high * total JOIN b ON b.phase = p.phase AND first * total <= step * 1000 % (total * 100) AND step * 1000 % (total * 100) < stop * total"),
    "band_checks": (band_checks, f"WITH b AS (SELECT * FROM {_values(DIFFICULTY, 'band, A, B, C, D')}), u AS (SELECT unnest(['A', 'B', 'C', 'D']) AS phase, unnest([A, B, C, D]) AS share FROM b) SELECT phase, sum(share)::BIGINT AS total, sum(share) = 100 AS holds FROM u GROUP BY phase"),
    "anneal_reserve": (anneal_reserve, f"WITH {_LAB}, s AS (SELECT source, min(coalesce(quality, 1)) AS worst FROM d GROUP BY source), r AS (SELECT source, row_number() OVER (ORDER BY sha256('seed-7|anneal|' || source))::INT AS rn FROM s WHERE worst = 1) SELECT source, rn FROM r WHERE rn <= greatest(1, round_even((SELECT count(*) FROM s) * 0.1::DOUBLE, 0))"),
    "tier_sets": (tier_sets, f"WITH {_LAB} SELECT source, CASE WHEN count(quality) = 0 THEN NULL WHEN bool_and(quality = 1) THEN 'verified' ELSE 'unverified' END AS tier FROM d GROUP BY source"),
    "supply_by_lane": (supply_by_lane, f"WITH t AS (SELECT lang, sum({_N} * coalesce(own, f, {OTHER_FERTILITY})) AS t FROM documents d LEFT JOIN {_values(SOURCE_FERTILITY, 'src, own').replace(' v(', ' vs(')} ON src = d.source LEFT JOIN {_values(FERTILITY, 'lg, f')} ON lg = d.lang GROUP BY lang) SELECT lane, (coalesce(t, 0) // 100)::BIGINT AS tokens FROM {_values([(x,) for x in WANTED_LANES], 'lane')} LEFT JOIN t ON lang = lane"),
    "anneal_supply": (anneal_supply, f"WITH {_LAB}, g AS (SELECT lang, sum(CASE WHEN quality = 1 THEN {_N} ELSE 0 END)::BIGINT AS eligible, sum({_N})::BIGINT // 10 AS demand FROM d GROUP BY lang) SELECT lang, eligible, demand, eligible >= demand AS covered FROM g"),
    "fertility_vs_baseline": (fertility_vs_baseline, rf"""WITH d AS (SELECT lang, coalesce(text, '') AS text FROM documents), r AS (SELECT lang, round(sum(length(regexp_replace(text, '[ \t\n\x0B\f\r]+', '', 'g'))) / sum({_N}) * 1000000)::BIGINT AS baseline,
  round(sum(list_sum(list_transform(regexp_extract_all(text, '[\p{{L}}\p{{M}}\p{{N}}]+'), lambda x: length(x)))) / sum(len(regexp_extract_all(text, '[\p{{L}}\p{{M}}\p{{N}}]+'))) * 1000000)::BIGINT AS profile FROM d GROUP BY lang) SELECT *, profile < baseline AS lower FROM r"""),
    "lane_sources": (lane_sources, "SELECT lang, string_agg(source, ',' ORDER BY source) AS sources FROM (SELECT DISTINCT lang, source FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL) GROUP BY lang"),
    "weight_blend": (weight_blend, "WITH a AS (SELECT lang, count(*) / sum(count(*)) OVER () AS w FROM documents WHERE lang <> 'es' GROUP BY lang), b AS (SELECT lang, sum(length(coalesce(text, ''))) / sum(sum(length(coalesce(text, '')))) OVER () AS v FROM documents WHERE lang <> 'de' GROUP BY lang) SELECT lang, round((coalesce(w, 0) * 0.75::DOUBLE + coalesce(v, 0) * 0.25::DOUBLE) * 1000000)::BIGINT AS weight FROM a FULL JOIN b USING (lang)"),
    "decision_alignment": (decision_alignment, f"WITH {_LEDGER}, s AS (SELECT shard, sum(loss)::BIGINT // count(*) AS alignment FROM l GROUP BY shard) SELECT step, count(*) AS shards, sum(alignment)::BIGINT AS alignment FROM (SELECT DISTINCT step, shard FROM l) JOIN s USING (shard) GROUP BY step"),
    "decisions_before_spike": (decisions_before_spike, f"{_SERIES}, d AS (SELECT step, loss - lag(loss) OVER (ORDER BY step) AS delta FROM s), k AS (SELECT step AS spike FROM d WHERE delta IS NOT NULL ORDER BY delta DESC, step LIMIT 1) SELECT step, loss, spike FROM s, k WHERE step <= spike ORDER BY step DESC LIMIT 8"),
    "seed_spread": (seed_spread, "WITH e AS (SELECT event_type, event_id % 5 AS seed, sum(round(value * 100)::BIGINT) / count(*) AS m FROM events GROUP BY ALL) SELECT event_type, round(avg(m) * 1000000)::BIGINT AS mean, round(stddev_samp(m), 6) AS deviation, round((max(m) - min(m)) * 1000000)::BIGINT AS range FROM e GROUP BY event_type"),
    "accuracy_by_length": (accuracy_by_length, "SELECT length(event_id::VARCHAR) AS digits, count(*) AS n, count(*) FILTER (event_id * 7 % 10 = user_id % 10) AS right FROM events GROUP BY 1"),
    "probe_pair_cosine": (probe_pair_cosine, f"WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) SELECT count(*) AS pairs, round(avg({_DOT('a.v', 'b.v')} / sqrt({_DOT('a.v', 'a.v')} * {_DOT('b.v', 'b.v')})), 9) AS cosine FROM e a JOIN e b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 2 = 0"),
    "centroid_alignment": (centroid_alignment, f"WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), m AS (SELECT i, sum(floor(v[i + 1] * 1000000)::BIGINT)::DOUBLE AS x FROM e, range(64) r(i) WHERE label = 0 GROUP BY i), p AS (SELECT list(x ORDER BY i) AS p FROM m), s AS (SELECT vec_id, label, round({_DOT('v', 'p')} / sqrt({_DOT('v', 'v')} * {_DOT('p', 'p')}), 6) AS score FROM e, p), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id)::INT AS rank, greatest(1, round_even(count(*) OVER (PARTITION BY label) * 0.1::DOUBLE, 0)) AS k FROM s) SELECT vec_id, label, score, rank, rank <= k AS accepted FROM r"),
    "lane_policies": (lane_policies, _policy_sql()),
    "link_crawl": (link_crawl, f"WITH d AS (SELECT page_id, length({_VISIBLE}) AS n FROM pages WHERE html IS NOT NULL), r AS (SELECT page_id, n, sum(n) OVER (ORDER BY page_id)::BIGINT AS read FROM d WHERE n > 200) SELECT * FROM r WHERE read - n < 100000"),
    "split_violations": (split_violations, "WITH d AS (SELECT CASE doc_id % 12 WHEN 0 THEN 'eval' WHEN 1 THEN 'validation' ELSE 'train' END AS split, doc_id % 12 = 0 AS never_train FROM documents) SELECT split, CASE WHEN split <> 'train' AND NOT never_train THEN 'held_out_may_train' WHEN split = 'train' AND never_train THEN 'train_refused' END AS violation, count(*) AS docs FROM d GROUP BY ALL"),
    "registry_summary": (registry_summary, _registry_sql()),
    "trace_windows": (trace_windows, f"WITH {_LEDGER} SELECT k::BIGINT AS k, count(*) AS rows, sum(loss)::BIGINT AS loss FROM l JOIN (VALUES (0, 0, 40), (1, 300, 360), (2, 350, 380)) v(k, low, high) ON low <= step AND step < high GROUP BY k"),
    "resume_check": (resume_check, f"WITH {_LEDGER}, r AS (SELECT *, row_number() OVER (PARTITION BY lane ORDER BY \"offset\") AS place FROM l), c AS (SELECT lane, count(*) AS cursor FROM l WHERE step < 300 GROUP BY lane), a AS (SELECT \"offset\" AS o, row_number() OVER (PARTITION BY l.lane ORDER BY \"offset\") + coalesce(cursor, 0) AS again FROM l LEFT JOIN c ON c.lane = l.lane WHERE step >= 300) SELECT lane, CASE WHEN again IS NULL THEN 'before_checkpoint' WHEN again = place THEN 'equal' ELSE 'differs' END AS verdict, count(*) AS rows FROM r LEFT JOIN a ON o = \"offset\" GROUP BY ALL"),
    "fork_branch": (fork_branch, f"WITH {_LEDGER}, b AS (SELECT 'main' AS branch, step, shard FROM l UNION ALL SELECT 'child', step, CASE WHEN step >= 300 THEN shard + 1 ELSE shard END FROM l) SELECT branch, step < 300 AS shared, count(*) AS rows, sum(shard)::BIGINT AS shards, max(step) AS last_step FROM b GROUP BY ALL"),
    "checkpoint_hashes": (checkpoint_hashes, f"WITH {_LEDGER} SELECT step, max(\"offset\") AS last FROM l WHERE step % 40 = 0 GROUP BY step"),
}
