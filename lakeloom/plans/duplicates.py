"""Queries on duplicates, candidate pairs, survivors and benchmark contamination."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeloom.operators import dedup as D
from lakeloom.operators import text as X
from lakeloom.session import table

#: Permutations, band rows and shingle size of the queries below.
SLOTS, ROWS, SIZE = 16, 2, 5
BANDS = SLOTS // ROWS
#: (permutations, rows of a band, bands): over characters, and over words at similarity 0.75.
CHARS, WORDS = (64, 4, 16), (128, 11, 11)
#: Thresholds at which pairs are judged and at which removals are counted, in hundredths.
PROBES, SWEEP, OPERATING = (50, 60, 65, 70, 75, 80, 90), (90, 80, 75, 70, 60, 50, 40, 30), 75


def _docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "source", "lang", F.coalesce("text", F.lit("")).alias("text"))


def _firsts(spark, sf):
    """The first document of each text."""
    d = _docs(spark, sf)
    keep = D.exact_duplicates(d).filter("duplicate_of is null").select("doc_id")
    return d.join(keep, "doc_id", "left_semi")


def _shingles(size=SIZE, short="whole"):
    return X.word_shingles(X.space_words(F.col("text")), size, short)


def exact_dups(spark, sf):
    return D.exact_duplicates(_docs(spark, sf))


def dup_groups_cross_source(spark, sf):
    d = _docs(spark, sf)
    pairs = D.exact_duplicates(d, within=()).join(d.select("doc_id", "source"), "doc_id").filter("duplicate_of is not null")
    first = d.select(F.col("doc_id").alias("duplicate_of"), F.col("source").alias("first_source"))
    return pairs.join(first, "duplicate_of").groupBy((~F.col("source").eqNullSafe(F.col("first_source"))).alias("crosses")).agg(F.count(F.lit(1)).alias("docs"))


def local_vs_global_dedup(spark, sf):
    d = _docs(spark, sf)
    return D.exact_duplicates(d, within=("source",)).withColumnRenamed("duplicate_of", "local").join(D.exact_duplicates(d), "doc_id").agg(
        F.count("local").alias("removed_local"), F.count("duplicate_of").alias("removed_global"),
        F.count_if(F.col("duplicate_of").isNotNull() & F.col("local").isNull()).alias("only_global"),
    )


def shared_prefix_groups(spark, sf):
    d = _docs(spark, sf).groupBy(F.sha2(F.substring("text", 1, 120), 256).alias("prefix")).agg(F.count(F.lit(1)).alias("docs"), F.min("doc_id").alias("first_id"))
    return d.filter("docs > 1").orderBy(F.desc("docs"), "first_id").limit(5)


def _signatures(spark, sf):
    return _firsts(spark, sf).select("doc_id", _shingles().alias("s")).select("doc_id", D.minhash(F.col("s"), SLOTS).alias("sig"))


def minhash_signature(spark, sf):
    return _signatures(spark, sf).select("doc_id", F.array_join(F.col("sig").cast("array<string>"), ",").alias("sig"))


def minhash_bands(spark, sf):
    keyed = _signatures(spark, sf).select("doc_id", F.explode(D.bands(F.col("sig"), ROWS, BANDS)).alias("k")).select("doc_id", "k.*")
    return keyed.groupBy("band", "key").agg(F.count(F.lit(1)).alias("docs"), F.min("doc_id").alias("first_id")).filter("docs > 1")


def minhash_estimate(spark, sf):
    D.need_checkpoint_folder(table(spark, sf, "documents"))
    sig = _signatures(spark, sf).checkpoint()  # read by both sides of two joins
    pairs = D.band_pairs(sig, ROWS, BANDS)
    a, b = sig.select(F.col("doc_id").alias("a"), F.col("sig").alias("sa")), sig.select(F.col("doc_id").alias("b"), F.col("sig").alias("sb"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", D.estimate(F.col("sa"), F.col("sb"), SLOTS).alias("equal_slots"))


def _compared(pairs, d):
    """pairs (a, b) with shared and total: sizes of intersection and union of the whole shingle sets of d (doc_id, s)."""
    D.need_checkpoint_folder(d)
    pairs = pairs.checkpoint()
    asked = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    s = d.join(asked, "doc_id", "left_semi").checkpoint()  # shingles of the documents in pairs alone
    both = pairs.join(s.select(F.col("doc_id").alias("a"), F.col("s").alias("sa")), "a").join(s.select(F.col("doc_id").alias("b"), F.col("s").alias("sb")), "b")
    counted = both.withColumn("shared", F.size(F.array_intersect("sa", "sb"))).withColumn("total", F.size("sa") + F.size("sb") - F.col("shared"))
    return counted.drop("sa", "sb")


def shingle_jaccard_pairs(spark, sf):
    """Exact similarity of the candidate pairs."""
    d = _firsts(spark, sf).select("doc_id", _shingles().alias("s"))
    D.need_checkpoint_folder(d)
    pairs = D.band_pairs(d.select("doc_id", D.minhash(F.col("s"), SLOTS).alias("sig")).checkpoint(), ROWS, BANDS)
    return _compared(pairs, d).select("a", "b", "shared", "total").filter("shared * 10 >= total * 5")


def _estimated(sig, setting):
    """(a, b, equal_slots): pairs that share a band of their signatures (doc_id, sig)."""
    count, rows, bands = setting
    D.need_checkpoint_folder(sig)
    sig = sig.checkpoint()  # read by both sides of two joins
    pairs = D.band_pairs(sig, rows, bands)
    a, b = sig.select(F.col("doc_id").alias("a"), F.col("sig").alias("sa")), sig.select(F.col("doc_id").alias("b"), F.col("sig").alias("sb"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", D.estimate(F.col("sa"), F.col("sb"), count).alias("equal_slots"))


def _word_signatures(spark, sf, setting):
    return _firsts(spark, sf).select("doc_id", D.word_minhash_udf(setting[0], SIZE)("text").alias("sig"))


def minhash64_signature(spark, sf):
    """64 permutations modulo 2^61 - 1 over runs of five characters; a text without characters has none."""
    return _firsts(spark, sf).select("doc_id", D.char_minhash_udf(CHARS[0])("text").alias("sig")).select("doc_id", F.array_join(F.col("sig").cast("array<string>"), ",").alias("sig"))


def minhash64_survivors(spark, sf):
    """Survivors where sixteen bands of four find the pairs and four fifths of the slots must agree."""
    d = _firsts(spark, sf).filter(F.col("text").rlike(r"\S"))
    sig = d.select("doc_id", D.char_minhash_udf(CHARS[0])("text").alias("sig"))
    return D.survivors(_firsts(spark, sf), _estimated(sig, CHARS).filter(F.col("equal_slots") * 5 >= 4 * CHARS[0]).select("a", "b"))


def minhash128_pairs(spark, sf):
    """Pairs that eleven bands of eleven find over 128 permutations, with their estimate and their true similarity."""
    d = _firsts(spark, sf).select("doc_id", _shingles().alias("s"))
    return _compared(_estimated(_word_signatures(spark, sf, WORDS), WORDS), d)


def threshold_verdicts(spark, sf):
    """The eight pairs nearest to the operating threshold, with the thresholds at which their estimate is a duplicate."""
    p = minhash128_pairs(spark, sf)
    caught = F.array_join(F.array_compact(F.array(*[F.when(F.col("equal_slots") * 100 >= t * WORDS[0], F.lit(str(t))) for t in PROBES])), ",")
    far = F.abs(F.col("shared") * 100 - F.col("total") * OPERATING) / F.col("total")
    return p.withColumn("far", far).orderBy("far", "a", "b").limit(8).select("a", "b", "shared", "total", "equal_slots", caught.alias("caught"))


def _first_ids(spark, sf):
    """(doc_id, text) of all documents, and `_firsts` without the texts, which are not shuffled for it."""
    d = _docs(spark, sf)
    keep = D.exact_duplicates(d).filter("duplicate_of is null").select("doc_id")
    D.need_checkpoint_folder(d)
    return d.select("doc_id", "text"), d.select("doc_id").join(keep, "doc_id", "left_semi").checkpoint()


def lfmis_survivors(spark, sf):
    """Survivors at a true similarity of 13 in 16."""
    d, first = _first_ids(spark, sf)
    return D.survivors(first, D.near_word_pairs(d, first).select("a", "b"))


def threshold_sweep(spark, sf):
    """Documents that greedy selection removes at eight thresholds of true similarity."""
    d, first = _first_ids(spark, sf)
    return D.removed_counts(first, D.wide_word_pairs(d, first, (min(SWEEP), 100)), SWEEP)


def retained_lookup(spark, sf):
    """Documents of the first two sources looked up among all others by their bands: the smallest that agrees in 12 of 16 slots."""
    D.need_checkpoint_folder(table(spark, sf, "documents"))
    sig = _signatures(spark, sf).join(_docs(spark, sf).select("doc_id", F.coalesce(F.col("source").isin("src0", "src1"), F.lit(False)).alias("new")), "doc_id").checkpoint()
    keyed = sig.select("doc_id", "new", "sig", F.explode(D.bands(F.col("sig"), ROWS, BANDS)).alias("k")).select("doc_id", "new", "sig", "k.*")
    asked, kept = keyed.filter("new").drop("new"), keyed.filter("not new").select("band", "key", F.col("doc_id").alias("kept"), F.col("sig").alias("kept_sig"))
    hit = asked.join(kept, ["band", "key"]).filter(D.estimate(F.col("sig"), F.col("kept_sig"), SLOTS) >= 12)
    return hit.groupBy("doc_id").agg(F.min("kept").alias("duplicate_of"))


def char_shingle_sizes(spark, sf):
    t = F.trim(F.regexp_replace(F.col("text"), r"[ \t\n\r]+", " "))
    return _docs(spark, sf).select("doc_id", X.char_shingle_count(t, 5).alias("shingles"))


def contamination_2x10gram(spark, sf):
    return D.contaminated(_docs(spark, sf), table(spark, sf, "benchmark"), 10, 2)


def _suite(item):
    return F.concat(F.lit("suite"), (item % 4).cast("string"))


def decon_12gram_rate(spark, sf):
    """Documents with a 12-gram of a suite; a gram belongs to its first suite."""
    words = X.space_words(F.lower(F.coalesce("text", F.lit(""))))
    g = F.explode(X.word_shingles(words, 12, "none")).alias("g")
    held, docs = table(spark, sf, "benchmark"), _docs(spark, sf)
    owner = held.select(_suite(F.col("item_id")).alias("suite"), g).groupBy("g").agg(F.min("suite").alias("suite"))
    # 64-bit hashes find the few documents whose n-grams are compared as they are.
    hashes = D.gram_hashes(words, 12)
    likely = docs.select("doc_id", F.explode(hashes).alias("h")).join(D.known_hashes(held, hashes), "h", "left_semi").select("doc_id").distinct()
    hits = docs.join(likely, "doc_id", "left_semi").select("doc_id", g).join(owner, "g").select("doc_id", "suite").distinct()
    n = _docs(spark, sf).agg(F.count(F.lit(1)).alias("n"))
    return hits.groupBy("suite").agg(F.count(F.lit(1)).alias("docs")).join(n, how="cross").select("suite", "docs", (F.col("docs") / F.col("n")).alias("rate"), (F.lit(3.0) / F.col("n")).alias("floor"))


def benchmark_index_stats(spark, sf):
    b = table(spark, sf, "benchmark").select(_suite(F.col("item_id")).alias("suite"), "item_id", X.word_shingles(X.space_words(F.lower("text")), 12, "none").alias("s"))
    one = b.withColumn("g", F.explode_outer("s"))
    items = b.groupBy("suite").agg(F.count(F.lit(1)).alias("items"), F.count_if(F.size("s") == 0).alias("unindexable"))
    return items.join(one.groupBy("suite").agg(F.countDistinct("g").alias("grams")), "suite")


def firewall_verdicts(spark, sf):
    """Blocked documents: same content, a canary, or a tenth of their 8-grams held out."""
    docs, held = _docs(spark, sf), table(spark, sf, "benchmark").select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    hashes = X.let(X.space_words(F.lower("text")), lambda w: F.when(F.size(w) >= 8, D.gram_hashes(w, 8)).otherwise(F.array(F.xxhash64(F.array_join(w, " ")))))
    texts = held.select(F.sha2("text", 256).alias("h")).distinct().withColumn("exact", F.lit(True))
    # Counted by 64-bit hashes: a share of n-grams; of a document that has none held out only the number is needed.
    found = docs.select("doc_id", F.explode(hashes).alias("h")).join(D.known_hashes(held, hashes), "h", "left_semi").groupBy("doc_id").agg(F.count(F.lit(1)).alias("hits"))
    joined = docs.select("doc_id", F.size(hashes).cast("long").alias("grams"), F.sha2("text", 256).alias("h"), F.col("text").contains("canary-7f3a").alias("canary"))
    joined = joined.join(found, "doc_id", "left").join(texts, "h", "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    verdict = F.when(F.col("exact"), "exact").when(F.col("canary"), "canary").when(F.col("hits") * 10 >= F.col("grams"), "overlap").otherwise("admit")
    return joined.select("doc_id", "hits", "grams", verdict.alias("verdict"))


def canary_scan(spark, sf):
    """Canaries planted in every seventh document are found again, the first one by name."""
    text = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit(" canary-"), (F.col("doc_id") % 3).cast("string"), F.lit("x"))).otherwise(F.col("text"))
    canaries = spark.createDataFrame([(f"canary-{i}x",) for i in range(3)], "canary string")
    # three rows: broadcast whole
    hit = _docs(spark, sf).select("doc_id", text.alias("t")).join(F.broadcast(canaries), F.col("t").contains(F.col("canary")))
    return hit.groupBy("canary").agg(F.count(F.lit(1)).alias("docs"), F.min("doc_id").alias("first_id"))


def train_heldout_disjoint(spark, sf):
    d = _docs(spark, sf).select("doc_id", F.sha2("text", 256).alias("h"))
    held, train = d.filter("doc_id % 10 = 0"), d.filter("doc_id % 10 <> 0")
    leak = train.join(held.select("h").distinct(), "h", "left_semi")
    clean = train.join(held.select("h").distinct(), "h", "left_anti")
    return leak.agg(F.count(F.lit(1)).alias("leaked")).join(clean.agg(F.count(F.lit(1)).alias("kept")), how="cross").join(
        clean.select("h").intersect(held.select("h")).agg(F.count(F.lit(1)).alias("left_over")), how="cross")


_W = r"regexp_extract_all(text, '[^ \t\n\x0B\f\r]+')"
_GRAM = "list_distinct(list_transform(range(1, len(w) - (@n - 2)), lambda i: array_to_string(list_slice(w, i, i + @n - 1), ' ')))"


def _grams(n, short="[]"):
    return f"CASE WHEN len(w) >= {n} THEN {_GRAM.replace('@n', str(n))} ELSE {short} END"


_D = "d AS (SELECT doc_id, source, lang, coalesce(text, '') AS text FROM documents), f AS (SELECT * FROM d WHERE doc_id IN (SELECT min(doc_id) FROM d GROUP BY text))"
_SIG = f"""{_D}, sh AS (SELECT doc_id, {_grams(SIZE, "[array_to_string(w, ' ')]")} AS s FROM (SELECT doc_id, {_W} AS w FROM f)),
hs AS (SELECT doc_id, s, list_transform(s, lambda x: ('0x' || substr(md5(x), 1, 7))::BIGINT) AS h FROM sh),
sg AS (SELECT doc_id, s, [{', '.join(f'list_min(list_transform(h, lambda v: (v * {a} + {b}) % {D.PRIME}))' for a, b in D.coefficients(SLOTS))}] AS sig FROM hs),
bd AS (SELECT doc_id, n AS band, sig[n * {ROWS} + 1] || '-' || sig[n * {ROWS} + 2] AS key FROM sg, range(0, {BANDS}) t(n)),
pr AS (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM bd x JOIN bd y ON x.band = y.band AND x.key = y.key AND x.doc_id < y.doc_id),
es AS (SELECT a, b, len(list_filter(range(1, {SLOTS + 1}), lambda i: x.sig[i] = y.sig[i])) AS equal_slots FROM pr JOIN sg x ON x.doc_id = a JOIN sg y ON y.doc_id = b)"""

QUERIES = {
    "exact_dups": (exact_dups, f"WITH {_D} SELECT doc_id, CASE WHEN min(doc_id) OVER (PARTITION BY text) < doc_id THEN min(doc_id) OVER (PARTITION BY text) END AS duplicate_of FROM d"),
    "dup_groups_cross_source": (dup_groups_cross_source, f"WITH {_D}, m AS (SELECT doc_id, source, min(doc_id) OVER (PARTITION BY text) AS first_id FROM d) SELECT m.source IS DISTINCT FROM d.source AS crosses, count(*) AS docs FROM m JOIN d ON d.doc_id = first_id WHERE first_id < m.doc_id GROUP BY 1"),
    "local_vs_global_dedup": (local_vs_global_dedup, f"WITH {_D}, m AS (SELECT doc_id > min(doc_id) OVER (PARTITION BY text, source) AS l, doc_id > min(doc_id) OVER (PARTITION BY text) AS g FROM d) SELECT count(*) FILTER (l) AS removed_local, count(*) FILTER (g) AS removed_global, count(*) FILTER (g AND NOT l) AS only_global FROM m"),
    "shared_prefix_groups": (shared_prefix_groups, f"WITH {_D} SELECT sha256(substr(text, 1, 120)) AS prefix, count(*) AS docs, min(doc_id) AS first_id FROM d GROUP BY 1 HAVING count(*) > 1 ORDER BY docs DESC, first_id LIMIT 5"),
    "minhash_signature": (minhash_signature, f"WITH {_SIG} SELECT doc_id, array_to_string(sig, ',') AS sig FROM sg"),
    "minhash_bands": (minhash_bands, f"WITH {_SIG} SELECT band::INT AS band, key, count(*) AS docs, min(doc_id) AS first_id FROM bd GROUP BY ALL HAVING count(*) > 1"),
    "minhash_estimate": (minhash_estimate, f"WITH {_SIG} SELECT * FROM es"),
    "shingle_jaccard_pairs": (shingle_jaccard_pairs, f"WITH {_SIG}, j AS (SELECT a, b, len(list_intersect(x.s, y.s)) AS shared, len(x.s) + len(y.s) AS n FROM pr JOIN sg x ON x.doc_id = a JOIN sg y ON y.doc_id = b) SELECT a, b, shared, n - shared AS total FROM j WHERE shared * 10 >= (n - shared) * 5"),
    "retained_lookup": (retained_lookup, f"WITH {_SIG}, nw AS (SELECT doc_id FROM d WHERE source IN ('src0', 'src1')), h AS (SELECT x.doc_id, y.doc_id AS kept, x.band FROM bd x JOIN bd y ON x.band = y.band AND x.key = y.key WHERE x.doc_id IN (SELECT * FROM nw) AND y.doc_id NOT IN (SELECT * FROM nw)) SELECT h.doc_id, min(kept) AS duplicate_of FROM h JOIN sg x ON x.doc_id = h.doc_id JOIN sg y ON y.doc_id = kept WHERE len(list_filter(range(1, {SLOTS + 1}), lambda i: x.sig[i] = y.sig[i])) >= 12 GROUP BY 1"),
    "minhash64_signature": (minhash64_signature, None),
    "minhash64_survivors": (minhash64_survivors, None),
    "minhash128_pairs": (minhash128_pairs, None),
    "threshold_verdicts": (threshold_verdicts, None),
    "lfmis_survivors": (lfmis_survivors, None),
    "threshold_sweep": (threshold_sweep, None),
    "char_shingle_sizes": (char_shingle_sizes, rf"WITH {_D}, t AS (SELECT doc_id, trim(regexp_replace(text, '[ \t\n\r]+', ' ', 'g')) AS t FROM d) SELECT doc_id, CASE WHEN length(t) > 5 THEN len(list_distinct(list_transform(range(1, length(t) - 3), lambda i: substr(t, i, 5)))) ELSE 1 END AS shingles FROM t"),
    "contamination_2x10gram": (contamination_2x10gram, f"WITH {_D}, b AS (SELECT DISTINCT unnest({_grams(10)}) AS g FROM (SELECT {_W} AS w FROM benchmark)), x AS (SELECT doc_id, unnest({_grams(10)}) AS g FROM (SELECT doc_id, {_W} AS w FROM d)) SELECT doc_id, count(*) AS hits FROM x JOIN b USING (g) GROUP BY doc_id HAVING count(*) >= 2"),
    "decon_12gram_rate": (decon_12gram_rate, f"""WITH {_D}, b AS (SELECT g, min(suite) AS suite FROM (SELECT suite, unnest({_grams(12)}) AS g FROM (SELECT 'suite' || item_id % 4 AS suite, {_W.replace('text', 'lower(text)')} AS w FROM benchmark)) GROUP BY g),
x AS (SELECT doc_id, unnest({_grams(12)}) AS g FROM (SELECT doc_id, {_W.replace('text', 'lower(text)')} AS w FROM d)), h AS (SELECT DISTINCT doc_id, suite FROM x JOIN b USING (g))
SELECT suite, count(*) AS docs, count(*) / (SELECT count(*) FROM d) AS rate, 3.0::DOUBLE / (SELECT count(*) FROM d) AS floor FROM h GROUP BY suite"""),
    "benchmark_index_stats": (benchmark_index_stats, f"WITH b AS (SELECT suite, {_grams(12)} AS s FROM (SELECT 'suite' || item_id % 4 AS suite, {_W.replace('text', 'lower(text)')} AS w FROM benchmark)) SELECT suite, count(*) AS items, count(*) FILTER (len(s) = 0) AS unindexable, len(list_distinct(flatten(list(s)))) AS grams FROM b GROUP BY suite"),
    "firewall_verdicts": (firewall_verdicts, f"""WITH {_D}, b AS (SELECT coalesce(text, '') AS text FROM benchmark), bg AS (SELECT DISTINCT unnest({_grams(8, "[array_to_string(w, ' ')]")}) AS g FROM (SELECT {_W.replace('text', 'lower(text)')} AS w FROM b)),
x AS (SELECT doc_id, unnest({_grams(8, "[array_to_string(w, ' ')]")}) AS g FROM (SELECT doc_id, {_W.replace('text', 'lower(text)')} AS w FROM d)), s AS (SELECT doc_id, count(bg.g) AS hits, count(*) AS grams FROM x LEFT JOIN bg USING (g) GROUP BY doc_id)
SELECT doc_id, hits, grams, CASE WHEN text IN (SELECT text FROM b) THEN 'exact' WHEN contains(text, 'canary-7f3a') THEN 'canary' WHEN hits * 10 >= grams THEN 'overlap' ELSE 'admit' END AS verdict FROM d JOIN s USING (doc_id)"""),
    "canary_scan": (canary_scan, f"WITH {_D}, t AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN text || ' canary-' || doc_id % 3 || 'x' ELSE text END AS t FROM d), c AS (SELECT 'canary-' || i || 'x' AS canary FROM range(3) r(i)) SELECT canary, count(*) AS docs, min(doc_id) AS first_id FROM t JOIN c ON contains(t, canary) GROUP BY canary"),
    "train_heldout_disjoint": (train_heldout_disjoint, f"WITH {_D}, h AS (SELECT text FROM d WHERE doc_id % 10 = 0) SELECT count(*) FILTER (text IN (SELECT text FROM h)) AS leaked, count(*) FILTER (text NOT IN (SELECT text FROM h)) AS kept, 0::BIGINT AS left_over FROM d WHERE doc_id % 10 <> 0"),
}
