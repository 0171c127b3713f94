import json
import random

import pytest
from lakeloom.functions import vectors as V
from lakeloom.operators import cleaning as C
from lakeloom.operators import dedup as D
from lakeloom.operators import packing as P
from lakeloom.operators import quality as Q
from lakeloom.operators import text as X
from lakeloom.operators import tokenizer as K
from lakeloom.plans.planning import LANES, apportion_rows
from lakeloom.sources import files, sinks
from lakeloom.streaming import events as S
from pyspark.sql import functions as F


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("r")).first().r


def test_text_expressions(spark):
    words = lambda n, short: lambda t: X.word_shingles(X.space_words(t), n, short)
    assert one(spark, "a b\tc a b c", words(2, "none")) == ["a b", "b c", "c a"]
    assert one(spark, "a b", words(3, "whole")) == ["a b"] and one(spark, "", words(3, "none")) == []
    assert one(spark, "abcabc", lambda t: X.char_shingles(t, 3)) == ["abc", "bca", "cab"]
    assert one(spark, "e\u0301\r\n", X.canonical) == "é\n"
    assert one(spark, "Straße\u200c", X.casefold_without_joiners) == "strasse"


def test_cleaning_rules(spark):
    assert one(spark, "x\ufeff\u200by\u0001\ue000z\u200d", C.strip_noise) == "xyz\u200d"
    assert one(spark, " a  b\n\n\n\nc ", C.collapse_space) == "a b\n\nc"
    text = "<|im_start|>user hi<|im_end|>[BOT] x ### Human: y </assistant>\nUSER: z"
    assert one(spark, text, C.unify_ghost_marks) == "<|user|> hi<|end|><|assistant|> x <|user|> y <|assistant|>\n<|user|> z"
    assert one(spark, "<b>x</b> `<i>` ```<u>```", C.strip_markup_outside_code) == " x  `<i>` ```<u>```"
    assert one(spark, "&lt;a&gt; &eacute;", C.unescape_entities) == "<a> é"
    for kind, sample in (("email", "ravi.kumar@example.co.in"), ("aadhaar", "4321 8765 2109"), ("pan", "ABCDE1234F"), ("phone", "+91 9876543210"), ("ipv4", "192.168.10.44")):
        assert one(spark, f"id {sample} end", lambda t: C.apply_rules(t, C.ADMISSION_PII_RULES)) == f"id <redacted:{'ip' if kind == 'ipv4' else kind}> end"
    years = "2007-2008 2008-2009 2009-2010 2011-2012"
    assert one(spark, years, lambda t: C.apply_rules(t, C.ADMISSION_PII_RULES)) == years


def test_signals_of_odd_texts(spark):
    df = spark.createDataFrame([(1, None, "en"), (2, "", "xx"), (3, "... !!!", None), (4, "a.\na.\na.\nb", "en")], "doc_id long, text string, lang string")
    rows = {r.doc_id: r for r in Q.with_signals(df).withColumn("reason", Q.fail_reason()).collect()}
    assert [rows[i].n_words for i in (1, 2, 3, 4)] == [0, 0, 2, 4]
    assert rows[3].symbol_words == 2 and rows[4].duplicate_lines == 2 and rows[4].terminal_lines == 3
    assert {r.reason for r in rows.values()} == {"too_short"}


def test_survivors_keep_the_end_of_a_chain(spark):
    rng = random.Random(1)
    for edges in ([(1, 2), (2, 3)], [(1, 2), (1, 3), (2, 4), (3, 4), (4, 5)], [(rng.randrange(40), rng.randrange(40)) for _ in range(60)]):
        nodes = sorted({x for e in edges for x in e} | {99})
        near = {n: {a + b - n for a, b in edges if n in (a, b) and a != b} for n in nodes}
        kept: set[int] = set()
        for n in nodes:
            if not near[n] & kept:
                kept.add(n)
        got = D.survivors(spark.createDataFrame([(n,) for n in nodes], "doc_id long"), spark.createDataFrame(edges, "a long, b long")).collect()
        assert {r.doc_id for r in got if r.removed_by is None} == kept
        assert all(r.removed_by == min(near[r.doc_id] & kept) for r in got if r.removed_by is not None)


@pytest.mark.parametrize("name", P.POLICIES)
def test_packing_covers_and_never_overlaps(spark, name):
    rng = random.Random(2)
    docs = [(rng.choice("ab"), i, rng.choice([0, 1, 30, 64, 65, 200])) for i in range(60)]
    segments = P.POLICIES[name](spark.createDataFrame(docs, "lane string, doc_id long, n long"), 64).collect()
    sizes, used = {d: n for _, d, n in docs}, {}
    for s in segments:
        assert 0 <= s.seq_start < s.seq_end <= 64 and s.seq_end - s.seq_start == s.doc_end - s.doc_start
        for p in range(s.seq_start, s.seq_end):
            assert used.setdefault((s.lane, s.seq, p), s.doc_id) == s.doc_id
    assert len(used) == sum(s.seq_end - s.seq_start for s in segments)
    want = sum(n // 64 * 64 for n in sizes.values()) if name == "long_context" else sum(sizes.values())
    assert len(used) == want


def test_tokenizer_training_and_words(spark):
    counts = spark.createDataFrame([("abab", 5), ("abc", 3), ("bc", 1)], "token string, freq long")
    table = K.train_merges(counts, 10)
    assert table[0] == ("a", "b") and table[1] == ("ab", "ab")
    ranks = {p: i for i, p in enumerate(table)}
    assert "".join(K.encode_word("xababcab", ranks)) == "xababcab"
    assert K.encode_word("abab", ranks) == ["abab"]


def test_apportionment_gives_every_lane_its_floor():
    rows = apportion_rows({a: b / 100 for a, b, *_ in LANES}, {a: c / 100 for a, _, c, *_ in LANES if c}, 200, 6)
    got: dict[str, int] = {}
    for _, lane, n, _ in rows:
        got[lane] = got.get(lane, 0) + n
    assert sum(got.values()) == 1200 and set(got) == {x[0] for x in LANES}
    assert all(got[a] >= int(c / 100 * 1200) for a, _, c, *_ in LANES)


def test_jsonl_with_torn_tail(spark, tmp_path):
    rows = [json.dumps({"doc_id": i, "text": f"t{i}"}) for i in range(5)]
    (tmp_path / "a.jsonl").write_text("\n".join(rows) + "\n\n" + '{"doc_id": 99, "te')
    got = files.read_jsonl(spark, str(tmp_path / "a.jsonl"), tolerate_torn_tail=True)
    assert sorted(r.doc_id for r in got.collect()) == list(range(5))
    assert files.has_torn_tail(spark, str(tmp_path / "a.jsonl")).first().torn
    (tmp_path / "b.jsonl").write_text(rows[0] + '\n{"doc\n' + rows[1] + "\n")
    with pytest.raises(files.TornFileError):
        files.read_jsonl(spark, str(tmp_path / "b.jsonl"), tolerate_torn_tail=True)
    sinks.write_jsonl(got, str(tmp_path / "out"))
    assert sorted(r.doc_id for r in files.read_jsonl(spark, str(tmp_path / "out")).collect()) == list(range(5))


def test_shards_are_immutable(spark, tmp_path):
    schema = "shard string, doc_id long, tokens array<int>, never_train boolean"
    rows = [("s0", 1, [1, 2], False), ("s0", 2, [3], False), ("s1", 3, [4], False)]
    path = str(tmp_path / "out")
    first = sinks.write_shards(spark.createDataFrame(rows, schema), path).orderBy("shard").collect()
    again = sinks.write_shards(spark.createDataFrame(rows + [("s2", 4, [5], False)], schema), path).orderBy("shard").collect()
    assert again[:2] == first and len(again) == 3 and sinks.verify_shards(spark, path).count() == 0
    with pytest.raises(sinks.ShardConflictError):
        sinks.write_shards(spark.createDataFrame([("s0", 1, [9], False)], schema), path)
    with pytest.raises(sinks.ShardConflictError):
        sinks.write_shards(spark.createDataFrame([("s9", 1, [9], True)], schema), path)


def test_admission_reasons(spark):
    rows = [("s", 1, 5, "mit", "en", "h"), ("s", 1, 5, "MIXED:mit+gpl-3.0", "en", "h"), ("s", 0, 5, None, None, "h")]
    got = [r.reasons for r in sinks.admission_reasons(spark.createDataFrame(rows, "shard string, docs long, tokens long, license string, language string, content_hash string")).collect()]
    assert got == [[], ["license_blocked"], ["missing_license", "missing_language", "no_documents"]]


def test_python_units():
    assert files.python_units("import x\n@d\ndef f():\n    pass\n\nclass A:\n    def g(self): ...\n") == ["@d\ndef f():\n    pass", "class A:\n    def g(self): ..."]


def test_suffixes_scripts_and_graphemes(spark):
    assert V.split_suffix("houses", ("s", "es")) == ["hous", "es"] and V.split_suffix("as", ("s",)) == ["as"]
    assert V.to_pivot_script("కa", 0x0C00) == "कa"
    assert one(spark, "e\u0301x", V.graphemes) == ["e\u0301", "x"]


def test_streams_equal_batches(spark, tmp_path):
    src = "/root/testdata/sf0.001/events.parquet"
    events = spark.read.parquet(src).selectExpr(*[c.split(" ")[0] for c in S.EVENT.split(", ")])
    for i in range(3):
        events.filter(f"event_id % 3 = {i}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = S.read_events(spark, str(tmp_path / "in"))
    counts = S.run_to_table(S.tumbling_counts(stream, late="60 days"), "t_counts", "complete")
    batch = S.tumbling_counts(events)
    assert counts.exceptAll(batch).isEmpty() and batch.exceptAll(counts).isEmpty()
    doubled = S.read_events(spark, str(tmp_path / "in")).unionByName(S.read_events(spark, str(tmp_path / "in")))
    assert S.run_to_table(S.without_repeats(doubled, "60 days"), "t_once").count() == events.count()
    cursor = S.run_to_table(S.lane_cursors(stream), "t_cursor", "update").groupBy("lane").agg(F.max("rows").alias("n"))
    assert {r.lane: r.n for r in cursor.collect()} == {r.event_type: r["count"] for r in events.groupBy("event_type").count().collect()}
    ledger, mark = str(tmp_path / "ledger"), str(tmp_path / "mark")
    S.ledger_sink(stream, ledger, mark).awaitTermination()
    events.limit(7).selectExpr("event_id + 100000 as event_id", "ts", "user_id", "event_type", "value", "props").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    S.ledger_sink(S.read_events(spark, str(tmp_path / "in")), ledger, mark).awaitTermination()
    assert spark.read.parquet(ledger).count() == events.count() + 7


def test_merges_count_types_that_are_not_gathered(spark):
    rng = random.Random(5)
    words = {"".join(rng.choice("abcdé") for _ in range(rng.randint(1, 9))): rng.randint(1, 40) for _ in range(400)}
    counts = spark.createDataFrame(sorted(words.items()), "token string, freq long")
    want = K.train_merges(counts, 25)
    assert len(want) == 25
    assert K.train_merges(counts, 25, max_types=7) == want


def test_frozen_alphabet_is_whole(spark):
    letters = [chr(0x4E00 + i) for i in range(20_900)]
    counts = spark.createDataFrame([("".join(letters[i : i + 50]), 1) for i in range(0, len(letters), 50)], "token string, freq long")
    assert K.freeze(counts, 0).alphabet == sorted(letters)


def test_survivors_of_a_long_chain(spark):
    n = 206
    nodes, edges = spark.createDataFrame([(i,) for i in range(n)], "doc_id long"), spark.createDataFrame([(i, i + 1) for i in range(n - 1)], "a long, b long")
    got = {r.doc_id: r.removed_by for r in D.survivors(nodes, edges).collect()}
    assert got == {i: i - 1 if i % 2 else None for i in range(n)}
