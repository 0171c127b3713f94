import hashlib
import random

import duckdb
from docs import documents, saved
from lakeloom.llm import exact_dedup as op
from pyspark.sql import functions as F


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault("".join(c for c in (t or "") if c not in op.WHITE), []).append((-len(t or ""), i))
    return {
        i: (min(g)[1], len(g), i == min(g)[1], hashlib.sha256(k.encode()).hexdigest())
        for k, g in groups.items() for _, i in g
    }


def test_matches_brute_force_and_sql(spark, tmp_path):
    rng = random.Random(1)
    texts = [rng.choice(["a b", "ab", " ab\t", "é é", "éé", "", None, " ", "\x0b", "x" * 40_000, "a b"]) for _ in range(400)]
    folder = saved(documents(spark, texts).repartition(5), tmp_path)
    got = op.query(spark, folder)
    rows = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got.collect()}
    assert rows == brute(list(enumerate(texts)))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{folder}/documents.parquet/*.parquet'")
    sql = con.execute(f"select doc_id, keep_id, group_size, kept, text_sha256 from ({op.ORACLE_SQL})").fetchall()
    assert {r[0]: tuple(r[1:]) for r in sql} == rows


def test_index_inserts_deletes_and_grows():
    index, live = op.CuckooIndex(4), {}
    rng = random.Random(3)
    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(3000)]
    for _ in range(12_000):
        key = rng.choice(keys)
        if key in live:
            assert index.get(key) == live[key]
            assert index.delete(key)
            del live[key]
        else:
            assert index.get(key) is None and not index.delete(key)
            live[key] = rng.random()
            index.insert(key, live[key])
    assert dict(index) == live and len(index) == len(live)


def test_flush_empty_null_id_and_extra_columns(spark, monkeypatch):
    monkeypatch.setattr(op, "FLUSH_KEYS", 2)
    df = documents(spark, ["a", "b", "a ", "c", "b", "a"]).withColumn("digest", F.lit(1)).withColumn("keep_id", F.lit(2))
    assert {(r.doc_id, r.keep_id) for r in op.exact_dedup(df).collect()} == {(0, 2), (1, 1), (2, 2), (3, 3), (4, 1), (5, 2)}
    assert sorted(r.doc_id for r in op.kept_documents(df).collect()) == [1, 2, 3]
    nulls = df.withColumn("doc_id", F.lit(None).cast("long"))
    assert {r.keep_id for r in op.exact_dedup(nulls).collect()} == {None}
    assert op.exact_dedup(documents(spark, [])).count() == 0


def test_repeated_ids_and_clashing_columns(spark):
    names = ["_kept_id", "_row", "_kept", "digest", "owner", "keeper", "n", "_salt", "CHARS"]
    rows = [(1, "abc"), (1, "x"), (7, "x  "), (None, "q"), (None, "r"), (None, "r"), (8, "abc"), (8, "abc")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", *[f"'mine' as `{n}`" for n in names])
    kept = op.kept_documents(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == [(0, "q"), (0, "r"), (1, "abc"), (7, "x  ")]
    assert {tuple(r)[2:] for r in kept.collect()} == {("mine",) * len(names)}
    got = sorted(((r.doc_id or 0), r.keep_id, r.group_size, r.kept) for r in op.exact_dedup(df).collect() if r.doc_id == 1)
    assert got == [(1, 1, 3, True), (1, 7, 2, False)]


def test_live_texts_add_and_withdraw(spark, monkeypatch):
    monkeypatch.setattr(op, "FLUSH_KEYS", 3)
    index, rng, live = op.LiveTexts(spark), random.Random(4), {}
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    for turn in range(3):
        rows = [(100 * turn + i, f"t {rng.randrange(15)}") for i in range(20)]
        first = {}
        for i, t in rows:
            first.setdefault(t.replace(" ", ""), i)
        want = {i for t, i in first.items() if t not in live}
        got = {r.doc_id for r in index.add(frame(rows)).collect() if r.admitted}
        assert got == want
        live |= {t: i for t, i in first.items() if i in want}
        leaving = rng.sample(sorted(live), 4)
        gone = index.withdraw(frame([(live[t], t) for t in leaving] + [(-1, leaving[0]), (None, None)]))
        assert {r.doc_id for r in gone.collect()} == {live.pop(t) for t in leaving}
        assert {r.owner for r in index.live.collect()} == set(live.values())
    assert index.add(frame([])).count() == 0
