"""Queries on evidence, costs, compiled schedules, text assembly and token statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeloom.functions import markup as M
from lakeloom.functions import vectors as V
from lakeloom.operators import cleaning as C
from lakeloom.operators import packing as P
from lakeloom.operators import text as X
from lakeloom.operators import tokenizer as K
from lakeloom.plans import curriculum as U
from lakeloom.plans import training_data as D
from lakeloom.plans.ledgers import _LEDGER, _ledger
from lakeloom.plans.planning import micro
from lakeloom.session import table

SIZE = 256
#: Percent of each lane in each phase; the first tenth of a phase blends from the one before.
MIX = {"A": {"en": 60, "fr": 20, "de": 20}, "B": {"en": 40, "fr": 25, "de": 25, "es": 10}, "C": {"en": 30, "fr": 25, "de": 25, "es": 20}, "D": {"en": 20, "es": 80}}
SAMPLES = 8
REQUIRED_EVENTS = ("signup", "purchase", "error")


def long_context_lengths(spark, sf):
    """Documents long enough for three quarters of a sequence, and the rest, per lane."""
    return D._lanes(spark, sf).groupBy("lane", (F.col("n") * 4 >= SIZE * 3).alias("fits")).agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("tokens"))


def evidence_nine(spark, sf):
    """Nine checks that hold or not, each a fact of a table."""
    l, docs = _ledger(spark, sf), table(spark, sf, "documents")
    split = D.seeded_split(spark, sf)
    one = l.agg(
        (F.max("offset") + 1 == F.count(F.lit(1))).alias("offsets_dense"), (F.countDistinct("offset") == F.count(F.lit(1))).alias("offsets_unique"),
        (F.max("step") - F.min("step") + 1 == F.countDistinct("step")).alias("steps_contiguous"), (F.min("loss") >= 0).alias("losses_not_negative"), (F.countDistinct("lane") >= 5).alias("lanes_complete"),
    )
    two = docs.agg((F.countDistinct("doc_id") == F.count(F.lit(1))).alias("documents_unique"), (F.count("text") == F.count(F.lit(1))).alias("texts_present"))
    parts = split.groupBy("doc_id").agg(F.countDistinct("split").alias("k")).agg((F.max("k") == 1).alias("splits_disjoint"))
    missing = table(spark, sf, "labels").join(docs.select("doc_id"), "doc_id", "left_anti").agg((F.count(F.lit(1)) == 0).alias("labels_resolve"))
    row = one.join(two, how="cross").join(parts, how="cross").join(missing, how="cross")  # one row each
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("check"), F.col(c).alias("ok")) for c in row.columns])).alias("r")).select("r.*")


def unknown_rate(spark, sf):
    """Words outside the thousand most frequent ones, and distinct words, per language."""
    w = table(spark, sf, "documents").select("lang", F.explode(X.letter_runs(F.lower("text"))).alias("w")).groupBy("lang", "w").agg(F.count(F.lit(1)).alias("n"))
    top = w.groupBy("w").agg(F.sum("n").alias("t")).orderBy(F.desc("t"), "w").limit(1000).select("w", F.lit(True).alias("known"))
    d = w.join(F.broadcast(top), "w", "left")  # a thousand rows
    return d.groupBy("lang").agg(F.sum("n").alias("words"), F.sum(F.when(F.col("known").isNull(), F.col("n")).otherwise(0)).alias("unknown"), F.count(F.lit(1)).alias("distinct_words"))


def fertility_penalty(spark, sf):
    """Units per word by language: their spread, a thousand over it, and the penalty of one language above 1.2."""
    d = table(spark, sf, "documents").select("lang", F.coalesce("text", F.lit("")).alias("t"))
    r = d.groupBy("lang").agg((F.sum(X.faithful_units(F.col("t"))) / F.sum(F.size(X.space_words(F.col("t"))))).alias("r"))
    return r.agg(micro(F.max("r") - F.min("r")).alias("spread"), micro(1000 / F.nullif(F.max("r") - F.min("r"), F.lit(0.0))).alias("score"),
                 micro(F.exp(F.greatest(F.lit(0.0), F.max(F.when(F.col("lang") == "es", F.col("r"))) / 1.2 - 1))).alias("penalty"))


def ending_statistics(spark, sf):
    """Texts that end a sentence and those that do not: how many, and their mean length."""
    t = F.coalesce(F.col("text"), F.lit(""))
    d = table(spark, sf, "documents").select(F.rtrim(t).rlike("[.!?]$").alias("ended"), F.length(t).alias("n"))
    return d.groupBy("ended").agg(F.count(F.lit(1)).alias("docs"), micro(F.avg("n")).alias("mean_chars"))


def loss_improvement(spark, sf):
    l = _ledger(spark, sf).groupBy("lane").agg(F.min_by("loss", "offset").alias("first"), F.max_by("loss", "offset").alias("last"))
    return l.select("lane", "first", "last", (F.col("first") - F.col("last")).alias("improvement"))


def cost_projection(spark, sf):
    """Per lane: cost so far at a rate a second, what a crash now would lose since the last hundredth step, and a projection to ten times the steps."""
    l = _ledger(spark, sf)
    g = l.groupBy("lane").agg(F.countDistinct("step").alias("steps"), F.sum("loss").alias("ms"), F.sum(F.when(F.col("step") % 100 >= 50, F.col("loss")).otherwise(0)).alias("risk"))
    return g.select("lane", micro(F.col("ms") / 1000 * 0.07).alias("cost"), micro(F.col("risk") / 1000 * 0.07).alias("at_risk"), micro(F.col("ms") / F.col("steps") * 10000 / 1000 * 0.07).alias("projected"))


def packing_savings(spark, sf):
    """Pads that streams save against one document a sequence, per lane."""
    d = D._lanes(spark, sf)
    a, b = (P.utilization(P.POLICIES[p](d, SIZE), d, SIZE).select("lane", F.col("pad_tokens").alias(p)) for p in ("pad_only", "concat_chop"))
    return a.join(b, a["lane"].eqNullSafe(b["lane"])).select(a["lane"], "pad_only", "concat_chop", (F.col("pad_only") - F.col("concat_chop")).alias("saved"))


def base_unit_counts(spark, sf):
    """Bytes, code points and distinct code points per language."""
    t = F.coalesce(F.col("text"), F.lit(""))
    d = table(spark, sf, "documents").select("lang", F.octet_length(t).alias("b"), F.length(t).alias("c"), F.array_distinct(F.split(t, "")).alias("u"))
    sums = d.groupBy("lang").agg(F.sum("b").alias("bytes"), F.sum("c").alias("chars"))
    kinds = d.select("lang", F.explode("u").alias("u")).filter("u <> ''").groupBy("lang").agg(F.countDistinct("u").alias("alphabet"))
    return sums.join(kinds, sums["lang"].eqNullSafe(kinds["lang"])).select(sums["lang"], "bytes", "chars", "alphabet")


def reversible_pretokens(spark, sf):
    """Reversible pre-tokens per document, and whether they give the text back."""
    @F.pandas_udf("n long, exact boolean")
    def cut(texts):
        import pandas as pd

        found = [K.reversible_pretokens(t) for t in texts]
        return pd.DataFrame({"n": [len(x) for x in found], "exact": [K.restore_text(x) == t for x, t in zip(found, texts, strict=True)]})

    return table(spark, sf, "documents").select("doc_id", cut(F.coalesce("text", F.lit(""))).alias("r")).select("doc_id", "r.*")


def suffix_script_words(spark, sf):
    """Planted words, cut before a known ending and moved to the pivot script."""
    from lakeloom.plans.scripts import _planted

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def cut(words):
        return words.map(lambda w: V.profiled(w, True, True))

    w = _planted(spark, sf).select(F.explode(X.pretokens(F.col("extra"))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    return w.select("w", "n", cut("w").alias("p")).select("w", "n", F.array_join("p", "+").alias("parts"))


def role_tokens(spark, sf):
    """Conversations between begin and end marks, each turn's ids under its role: ids in all and by role."""
    docs = table(spark, sf, "conversations")
    dumped = K.freeze(K.reversible_counts(docs.select(F.coalesce("text", F.lit("")).alias("text"))), 150).dump()
    cached = {}

    def load():
        if "t" not in cached:
            cached["t"] = K.FrozenTokenizer.load(dumped)
        return cached["t"]

    @F.pandas_udf("n long, roles map<string,long>")
    def encode(turns):
        import collections

        import pandas as pd

        found = [load().encode_turns([(t["role"], t["text"]) for t in x]) for x in turns]
        return pd.DataFrame({"n": [len(i) for i, _ in found], "roles": [dict(collections.Counter(r)) for _, r in found]})

    one = docs.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text")))).alias("t"))
    return one.select("conv_id", encode("t").alias("r")).select("conv_id", "r.n", F.explode("r.roles").alias("role", "ids"))


def merge_step(spark, sf):
    """Symbols of every pre-token that the best pair changes, after it is merged from left to right."""
    counts = K.pretoken_counts(table(spark, sf, "documents"))
    best = K.pair_counts(counts).orderBy(F.desc("freq"), "pair").limit(1).select("pair")
    hit = counts.join(F.broadcast(best), F.col("token").contains(F.col("pair")))  # one row
    spaced = F.array_join(F.split("token", ""), " ")
    merged = F.replace(spaced, F.concat(F.substring("pair", 1, 1), F.lit(" "), F.substring("pair", 2, 1)), F.col("pair"))
    return hit.select("token", "freq", merged.alias("symbols"))


def page_texts(spark, sf):
    """Pages with captions and tables behind their visible text: sizes of both, and a hash."""
    extra = '<table class="wikitable"><caption>C</caption><tr><td>a &amp; b</table><figcaption>F</figcaption>'
    html = F.concat(F.coalesce("html", F.lit("")), F.lit(extra))
    d = table(spark, sf, "pages").select("page_id", html.alias("h")).select("page_id", C.visible_text(F.col("h")).alias("v"), M.captions_and_tables(F.col("h")).alias("c"))
    return d.select("page_id", F.length("v").alias("visible"), F.length("c").alias("captions"), F.sha2(F.concat_ws("\n", "v", "c"), 256).alias("hash"))


def probe_set(spark, sf):
    """Validation documents of each lane as one stream, its first three sequences."""
    v = D._lanes(spark, sf).join(D.seeded_split(spark, sf).filter("split = 'validation'").select("doc_id"), "doc_id", "left_semi")
    return P.concat_chop(v, SIZE).filter("seq < 3").select("lane", "seq", "doc_id", "seq_start", "seq_end")


def exact_match_scores(spark, sf):
    """Products modulo 97 by sums of discrete logarithms against plain ones, by operand kind: how often they agree."""
    logs, x = {}, 1
    for k in range(96):
        logs[x] = k
        x = x * 5 % 97
    power = F.create_map(*[F.lit(v) for item, k in logs.items() for v in (k, item)])
    log = F.create_map(*[F.lit(v) for item, k in logs.items() for v in (item, k)])
    e = table(spark, sf, "events").select((F.col("event_id") % 96 + 1).cast("int").alias("a"), (F.col("user_id") % 96 + 1).cast("int").alias("b"))
    got = power[((log[F.col("a")] + log[F.col("b")]) % 96).cast("int")]
    kind = F.when((F.col("a") % 2 == 0) & (F.col("b") % 2 == 0), "even").otherwise("mixed")
    return e.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.count_if(got == F.col("a") * F.col("b") % 97).alias("right"))


def shift_roles(spark, sf):
    """Vectors bound to the role of place p, which turns them p places round: the first values of each, in millionths."""
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), (F.col("vec_id") % 64).cast("int").alias("p"))
    turned = F.concat(F.slice("v", F.lit(65) - F.col("p"), F.greatest(F.col("p"), F.lit(0))), F.slice("v", F.lit(1), F.lit(64) - F.col("p")))
    return e.select("vec_id", F.col("p").cast("long").alias("p"), F.array_join(F.transform(F.slice(turned, 1, 4), lambda x: F.floor(x * 1000000).cast("long").cast("string")), ",").alias("first"))


def word_code_seeds(spark, sf):
    """Mean and sample deviation over five seeds of two measures per configuration."""
    c = F.round(F.col("value") * 100).cast("long")
    e = table(spark, sf, "events").groupBy("event_type", (F.col("event_id") % 5).alias("seed")).agg((F.sum(c) / F.count(F.lit(1))).alias("loss"), (F.sum(F.col("user_id") % 10) / F.count(F.lit(1))).alias("cosine"))
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("seeds"), micro(F.avg("loss")).alias("loss_mean"), F.round(F.stddev_samp("loss"), 6).alias("loss_deviation"), micro(F.avg("cosine")).alias("cosine_mean"), F.round(F.stddev_samp("cosine"), 6).alias("cosine_deviation"))


def research_evidence(spark, sf):
    """Per configuration whether all five seeds ran and whether its mean is under a bound fixed before."""
    c = F.round(F.col("value") * 100).cast("long")
    g = table(spark, sf, "events").groupBy("event_type").agg(F.countDistinct(F.col("event_id") % 5).alias("seeds"), F.sum(c).alias("s"), F.count(F.lit(1)).alias("n"))
    rows = F.array(F.struct(F.lit("all_seeds").alias("check"), (F.col("seeds") == 5).alias("ok")), F.struct(F.lit("mean_under_bound").alias("check"), (F.col("s") < F.col("n") * 2500).alias("ok")))
    return g.select("event_type", F.explode(rows).alias("r")).select("event_type", "r.*")


def missing_events(spark, sf):
    """Days of the log on which a required event did not occur."""
    e = table(spark, sf, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").distinct()
    need = e.select("day").distinct().select("day", F.explode(F.array(*map(F.lit, REQUIRED_EVENTS))).alias("event_type"))
    return need.join(e, ["day", "event_type"], "left_anti")


def _mix_rows():
    lanes = sorted({x for m in MIX.values() for x in m})
    names = list(MIX)
    return [(p, lane, MIX[names[max(0, i - 1)]].get(lane, 0), MIX[p].get(lane, 0)) for i, p in enumerate(names) for lane in lanes]


def compiled_schedule(spark, sf):
    """The plan of every step: sequence length, weight of each lane in hundredths of a percent, and tokens.

    In the first tenth of a phase a lane's weight moves linearly from what it was in the phase before.
    """
    s = U.seq_len_schedule(spark, sf)
    w = Window.partitionBy("phase")
    s = s.withColumn("first", F.min("step").over(w)).withColumn("warm", F.greatest(F.lit(1), F.floor((F.max("step").over(w) - F.col("first") + 1) / 10)))
    mix = F.broadcast(spark.createDataFrame(_mix_rows(), "phase string, lane string, before long, after long"))  # a row a phase and lane
    t = F.least(F.col("step") - F.col("first") + 1, F.col("warm"))
    weight = F.floor((F.col("before") * (F.col("warm") - t) + F.col("after") * t) * 100 / F.col("warm"))
    d = s.join(mix, "phase").select("step", "phase", "seq_len", "lane", weight.alias("weight"))
    return d.filter("weight > 0").withColumn("tokens", F.floor(F.col("seq_len") * SAMPLES * F.col("weight") / 10000))


def demand_by_phase(spark, sf):
    """Tokens that the schedule asks of each lane and phase against the lane's words, and whether they must be repeated."""
    need = compiled_schedule(spark, sf).groupBy("phase", "lane").agg(F.sum("tokens").alias("demand"))
    have = D._lanes(spark, sf).groupBy("lane").agg(F.sum("n").alias("supply"))
    return need.join(have, "lane", "left").select("phase", "lane", "demand", F.coalesce("supply", F.lit(0)).alias("supply"), (F.col("demand") > F.coalesce("supply", F.lit(0))).alias("repeats"))


def arm_validation(spark, sf):
    """Arms as changes of the last phase's mix: whether shares still come to a hundred and no floor is broken."""
    mix = spark.createDataFrame([(k, v) for k, v in MIX["C"].items()], "lane string, share long")
    arms = spark.createDataFrame([("base", "en", 0), ("no_es", "es", -20), ("more_fr", "fr", 10), ("swap", "de", -25)], "arm string, changed string, by long")
    d = mix.join(F.broadcast(arms), how="cross").withColumn("share", F.col("share") + F.when(F.col("lane") == F.col("changed"), F.col("by")).otherwise(0))  # literal rows
    return d.groupBy("arm").agg(F.sum("share").alias("total"), (F.sum("share") == 100).alias("valid"), F.count_if((F.col("lane") == "es") & (F.col("share") < 10)).alias("floors_broken"))


def scenario_flags(spark, sf):
    """Budgets of several sizes over the lanes' supply: what is short, as flags instead of errors."""
    have = D._lanes(spark, sf).filter("lane is not null").groupBy("lane").agg(F.sum("n").alias("supply"))
    budgets = F.broadcast(spark.createDataFrame([(b,) for b in (10_000, 100_000, 1_000_000, 10_000_000)], "budget long"))  # four rows
    d = have.join(budgets, how="cross").withColumn("demand", F.floor(F.col("budget") / 4))
    return d.select("budget", "lane", "supply", "demand", F.when(F.col("demand") <= F.col("supply"), "ok").when(F.col("demand") <= F.col("supply") * 4, "repeat").otherwise("infeasible").alias("verdict"))


def span_load(spark, sf):
    """Spans of five words asked for by document and place, loaded from stored words."""
    d = table(spark, sf, "documents").select("doc_id", X.space_words(F.col("text")).alias("w"))
    return d.select("doc_id", (F.col("doc_id") % 7).alias("start"), F.array_join(F.slice("w", (F.col("doc_id") % 7 + 1).cast("int"), F.lit(5)), " ").alias("span"))


def byte_stream(spark, sf):
    """Texts as streams of bytes with blank lines between, in leaves of 64 ids: bytes and hash of each."""
    d = table(spark, sf, "documents").select("lang", "doc_id", F.floor(F.col("doc_id") / 64).alias("leaf"), F.coalesce("text", F.lit("")).alias("t"))
    g = d.groupBy("lang", "leaf").agg(F.expr("listagg(t, '\n\n') within group (order by doc_id)").alias("s"))
    return g.select("lang", "leaf", F.octet_length("s").cast("long").alias("bytes"), F.sha2(F.encode("s", "UTF-8"), 256).alias("hash"))


def training_text(spark, sf):
    """Documents with the first conversation of their number behind them, the addition at most 300 characters."""
    extra = table(spark, sf, "conversations").filter("turn = 0").select(F.col("conv_id").alias("doc_id"), F.substring(F.coalesce("text", F.lit("")), 1, 300).alias("x"))
    d = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t")).join(extra, "doc_id", "left")
    text = F.when(F.col("x").isNull(), F.col("t")).otherwise(F.concat_ws("\n", "t", "x"))
    return d.select("doc_id", F.length(text).alias("n_chars"), F.sha2(text, 256).alias("hash"))


def long_words(spark, sf):
    """Seeded words of more than 32 characters: compounds of known words, and random letters."""
    letters = lambda tag, n: F.translate(F.substring(F.sha2(F.concat(F.lit(tag), F.col("id").cast("string")), 256), 1, n), "0123456789", "ghijklmnop")
    parts = ("counter", "revolution", "inter", "national", "electro", "magnetism", "micro", "biological")
    part = lambda k: F.element_at(F.array(*map(F.lit, parts)), (F.pmod(F.floor(F.col("id") / 8**k), F.lit(8)) + 1).cast("int"))
    d = spark.range(200).select("id", F.concat(*[part(k) for k in range(3)], letters("c", 30)).alias("compound"), letters("r", 40).alias("random"))
    return d.select("id", "compound", "random", F.length("compound").cast("long").alias("n"))


_W = r"len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+'))"
_SPLIT = D.QUERIES["seeded_split"][1]
_VAL = f"{D._L}, sp AS (SELECT doc_id AS d, split FROM ({_SPLIT})), v AS (SELECT lane, doc_id, n FROM l JOIN sp ON d = doc_id WHERE split = 'validation' AND n > 0)"
_SCHED = U.QUERIES["seq_len_schedule"][1]
_MIXV = ", ".join(map(str, _mix_rows()))
_COMPILED = f"""s0 AS ({_SCHED}), s1 AS (SELECT *, min(step) OVER (PARTITION BY phase) AS f, greatest(1, (max(step) OVER (PARTITION BY phase) - min(step) OVER (PARTITION BY phase) + 1) // 10) AS warm FROM s0),
s2 AS (SELECT s1.step, s1.phase, seq_len, lane, (before * (warm - least(step - f + 1, warm)) + after * least(step - f + 1, warm)) * 100 // warm AS weight FROM s1 JOIN (VALUES {_MIXV}) m(phase, lane, before, after) ON m.phase = s1.phase),
cs AS (SELECT *, (seq_len * {SAMPLES} * weight // 10000)::BIGINT AS tokens FROM s2 WHERE weight > 0)"""
_E100 = "round(value * 100)::BIGINT"
_PARTS = "['counter', 'revolution', 'inter', 'national', 'electro', 'magnetism', 'micro', 'biological']"
_HEX = "translate(substr(sha256('{}' || id), 1, {}), '0123456789', 'ghijklmnop')".format

QUERIES = {
    "long_context_lengths": (long_context_lengths, f"WITH {D._L} SELECT lane, n * 4 >= {SIZE} * 3 AS fits, count(*) AS docs, sum(n)::BIGINT AS tokens FROM l GROUP BY ALL"),
    "evidence_nine": (evidence_nine, f"""WITH {_LEDGER}, a AS (SELECT max("offset") + 1 = count(*) AS offsets_dense, count(DISTINCT "offset") = count(*) AS offsets_unique, max(step) - min(step) + 1 = count(DISTINCT step) AS steps_contiguous, min(loss) >= 0 AS losses_not_negative, count(DISTINCT lane) >= 5 AS lanes_complete FROM l),
b AS (SELECT count(DISTINCT doc_id) = count(*) AS documents_unique, count(text) = count(*) AS texts_present FROM documents), c AS (SELECT max(k) = 1 AS splits_disjoint FROM (SELECT count(DISTINCT split) AS k FROM ({_SPLIT}) GROUP BY doc_id)), d AS (SELECT count(*) = 0 AS labels_resolve FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents))
SELECT "check", ok FROM (UNPIVOT (SELECT * FROM a, b, c, d) ON COLUMNS(*) INTO NAME "check" VALUE ok)"""),
    "unknown_rate": (unknown_rate, r"WITH w AS (SELECT lang, w, count(*) AS n FROM (SELECT lang, unnest(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+')) AS w FROM documents) GROUP BY ALL), k AS (SELECT w FROM w GROUP BY w ORDER BY sum(n) DESC, w LIMIT 1000) SELECT lang, sum(n)::BIGINT AS words, sum(CASE WHEN w IN (SELECT w FROM k) THEN 0 ELSE n END)::BIGINT AS unknown, count(*) AS distinct_words FROM w GROUP BY lang"),
    "fertility_penalty": (fertility_penalty, rf"WITH r AS (SELECT lang, sum(len(regexp_extract_all(coalesce(text, ''), '[\p{{L}}\p{{M}}\p{{N}}]+|[^\s\p{{L}}\p{{M}}\p{{N}}]'))) / sum({_W}) AS r FROM documents GROUP BY lang) SELECT round((max(r) - min(r)) * 1000000)::BIGINT AS spread, round(1000 / nullif(max(r) - min(r), 0) * 1000000)::BIGINT AS score, round(exp(greatest(0, max(r) FILTER (lang = 'es') / 1.2::DOUBLE - 1)) * 1000000)::BIGINT AS penalty FROM r"),
    "ending_statistics": (ending_statistics, "SELECT regexp_matches(rtrim(coalesce(text, ''), ' '), '[.!?]$') AS ended, count(*) AS docs, round(avg(length(coalesce(text, ''))) * 1000000)::BIGINT AS mean_chars FROM documents GROUP BY 1"),
    "loss_improvement": (loss_improvement, f'WITH {_LEDGER} SELECT lane, arg_min(loss, "offset") AS first, arg_max(loss, "offset") AS last, arg_min(loss, "offset") - arg_max(loss, "offset") AS improvement FROM l GROUP BY lane'),
    "cost_projection": (cost_projection, f"WITH {_LEDGER}, g AS (SELECT lane, count(DISTINCT step) AS steps, sum(loss) AS ms, sum(CASE WHEN step % 100 >= 50 THEN loss ELSE 0 END) AS risk FROM l GROUP BY lane) SELECT lane, round(ms / 1000 * 0.07::DOUBLE * 1000000)::BIGINT AS cost, round(risk / 1000 * 0.07::DOUBLE * 1000000)::BIGINT AS at_risk, round(ms / steps * 10000 / 1000 * 0.07::DOUBLE * 1000000)::BIGINT AS projected FROM g"),
    "packing_savings": (packing_savings, f"WITH {D._L}, a AS (SELECT lane, sum(((n - 1) // {SIZE} + 1) * {SIZE} - n)::BIGINT AS pad_only, (((sum(n) - 1) // {SIZE} + 1) * {SIZE} - sum(n))::BIGINT AS concat_chop FROM l WHERE n > 0 GROUP BY lane) SELECT *, pad_only - concat_chop AS saved FROM a"),
    "base_unit_counts": (base_unit_counts, "WITH c AS (SELECT lang, sum(strlen(coalesce(text, '')))::BIGINT AS bytes, sum(length(coalesce(text, '')))::BIGINT AS chars FROM documents GROUP BY lang), u AS (SELECT lang AS g, count(DISTINCT u) AS alphabet FROM (SELECT lang, unnest(list_distinct(string_split(coalesce(text, ''), ''))) AS u FROM documents) WHERE u <> '' GROUP BY lang) SELECT lang, bytes, chars, alphabet FROM c JOIN u ON lang IS NOT DISTINCT FROM g"),
    "reversible_pretokens": (reversible_pretokens, None),
    "suffix_script_words": (suffix_script_words, None),
    "role_tokens": (role_tokens, None),
    "merge_step": (merge_step, f"WITH {D._PRE}, {D._PAIRS}, b AS MATERIALIZED (SELECT pair FROM pr ORDER BY freq DESC, pair LIMIT 1) SELECT token, freq, replace(array_to_string(string_split(token, ''), ' '), (SELECT substr(pair, 1, 1) || ' ' || substr(pair, 2, 1) FROM b), (SELECT pair FROM b)) AS symbols FROM t WHERE contains(token, (SELECT pair FROM b))"),
    "page_texts": (page_texts, None),
    "probe_set": (probe_set, f"WITH {_VAL}, {D._CHOP.replace('FROM l WHERE n > 0', 'FROM v')} SELECT lane, seq, doc_id, seq_start, seq_end FROM ({D.CHOP_SQL}) WHERE seq < 3"),
    "exact_match_scores": (exact_match_scores, "SELECT CASE WHEN (event_id % 96 + 1) % 2 = 0 AND (user_id % 96 + 1) % 2 = 0 THEN 'even' ELSE 'mixed' END AS kind, count(*) AS n, count(*) AS right FROM events GROUP BY 1"),
    "shift_roles": (shift_roles, "WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, vec_id % 64 AS p FROM embeddings) SELECT vec_id, p, array_to_string(list_transform(range(4), lambda i: floor(v[(i - p + 64) % 64 + 1] * 1000000)::BIGINT), ',') AS first FROM e"),
    "word_code_seeds": (word_code_seeds, f"WITH e AS (SELECT event_type, event_id % 5 AS seed, sum({_E100}) / count(*) AS loss, sum(user_id % 10) / count(*) AS cosine FROM events GROUP BY ALL) SELECT event_type, count(*) AS seeds, round(avg(loss) * 1000000)::BIGINT AS loss_mean, round(stddev_samp(loss), 6) AS loss_deviation, round(avg(cosine) * 1000000)::BIGINT AS cosine_mean, round(stddev_samp(cosine), 6) AS cosine_deviation FROM e GROUP BY event_type"),
    "research_evidence": (research_evidence, f"WITH g AS (SELECT event_type, count(DISTINCT event_id % 5) AS seeds, sum({_E100}) AS s, count(*) AS n FROM events GROUP BY 1) SELECT event_type, 'all_seeds' AS \"check\", seeds = 5 AS ok FROM g UNION ALL SELECT event_type, 'mean_under_bound', s < n * 2500 FROM g"),
    "missing_events": (missing_events, f"WITH e AS (SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS day, event_type FROM events), n AS (SELECT day, unnest({list(REQUIRED_EVENTS)}) AS event_type FROM (SELECT DISTINCT day FROM e)) SELECT day, event_type FROM n WHERE (day, event_type) NOT IN (SELECT day, event_type FROM e)"),
    "compiled_schedule": (compiled_schedule, f"WITH {_COMPILED} SELECT step, phase, seq_len, lane, weight, tokens FROM cs"),
    "demand_by_phase": (demand_by_phase, f"WITH {_COMPILED}, {D._L.replace('l AS', 'dl AS')}, h AS (SELECT lane, sum(n)::BIGINT AS supply FROM dl GROUP BY lane), n AS (SELECT phase, lane, sum(tokens)::BIGINT AS demand FROM cs GROUP BY ALL) SELECT phase, n.lane, demand, coalesce(supply, 0) AS supply, demand > coalesce(supply, 0) AS repeats FROM n LEFT JOIN h ON h.lane = n.lane"),
    "arm_validation": (arm_validation, "WITH m(lane, share) AS (VALUES ('en', 30), ('fr', 25), ('de', 25), ('es', 20)), a(arm, changed, b) AS (VALUES ('base', 'en', 0), ('no_es', 'es', -20), ('more_fr', 'fr', 10), ('swap', 'de', -25)), d AS (SELECT arm, lane, share + CASE WHEN lane = changed THEN b ELSE 0 END AS share FROM m, a) SELECT arm, sum(share)::BIGINT AS total, sum(share) = 100 AS valid, count(*) FILTER (lane = 'es' AND share < 10) AS floors_broken FROM d GROUP BY arm"),
    "scenario_flags": (scenario_flags, f"WITH {D._L}, h AS (SELECT lane, sum(n)::BIGINT AS supply FROM l WHERE lane IS NOT NULL GROUP BY lane), b(budget) AS (VALUES (10000::BIGINT), (100000), (1000000), (10000000)) SELECT budget, lane, supply, budget // 4 AS demand, CASE WHEN budget // 4 <= supply THEN 'ok' WHEN budget // 4 <= supply * 4 THEN 'repeat' ELSE 'infeasible' END AS verdict FROM h, b"),
    "span_load": (span_load, r"SELECT doc_id, doc_id % 7 AS start, array_to_string(regexp_extract_all(text, '[^ \t\n\x0B\f\r]+')[doc_id % 7 + 1 : doc_id % 7 + 5], ' ') AS span FROM documents"),
    "byte_stream": (byte_stream, "SELECT lang, leaf, strlen(s) AS bytes, sha256(s) AS hash FROM (SELECT lang, doc_id // 64 AS leaf, string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY doc_id) AS s FROM documents GROUP BY ALL)"),
    "training_text": (training_text, "WITH x AS (SELECT conv_id, substr(coalesce(text, ''), 1, 300) AS x FROM conversations WHERE turn = 0), d AS (SELECT doc_id, CASE WHEN x IS NULL THEN coalesce(text, '') ELSE coalesce(text, '') || chr(10) || x END AS t FROM documents LEFT JOIN x ON conv_id = doc_id) SELECT doc_id, length(t) AS n_chars, sha256(t) AS hash FROM d"),
    "long_words": (long_words, f"WITH d AS (SELECT id, {_PARTS}[id % 8 + 1] || {_PARTS}[id // 8 % 8 + 1] || {_PARTS}[id // 64 % 8 + 1] || {_HEX('c', 30)} AS compound, {_HEX('r', 40)} AS random FROM range(200) r(id)) SELECT id, compound, random, length(compound) AS n FROM d"),
}
