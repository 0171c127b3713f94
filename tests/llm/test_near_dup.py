import random

import duckdb
import numpy as np
from docs import documents, saved
from lakeloom.llm import near_dup as op


def texts(n=25, copies=9, seed=1):
    rng = random.Random(seed)
    found = []
    for _ in range(n):
        base = [f"w{rng.randint(0, 3000)}" for _ in range(rng.randint(3, 160))]
        for _ in range(rng.randint(1, copies)):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                t[rng.randrange(len(t))] = f"x{rng.randint(0, 9999)}"
            found.append(rng.choice([" ", "\n", "  "]).join(t))
    return found + [None, "", " \t", "one two", "One  two", "one two three"]


def brute(data):
    tokens = [tuple(op.words(t)) for t in data]
    classes = {}
    for i, t in enumerate(tokens):
        classes.setdefault(t, i)
    sets = {i: {t[k : k + 5] for k in range(len(t) - 4)} if len(t) >= 5 else {t} for t, i in classes.items() if t}
    links = {i: {j for j in sets if j != i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])} for i in sets}
    group = {}
    for i in classes.values():
        seen, todo = {i}, [i]
        while todo:
            new = links.get(todo.pop(), set()) - seen
            seen |= new
            todo += new
        group[i] = min(seen)
    return {i: (classes[t], len(links.get(classes[t], ())), group[classes[t]]) for i, t in enumerate(tokens)}


def test_matches_brute_force_and_sql(spark, tmp_path):
    data = texts()
    folder = saved(documents(spark, data).repartition(3), tmp_path)
    rows = op.query(spark, folder).collect()
    got = {r.doc_id: (r.class_id, r.n_links, r.group_id) for r in rows}
    assert len(rows) == len(data) and got == brute(data)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{folder}/documents.parquet/*.parquet'")
    sql = con.execute(f"select doc_id, class_id, n_links, group_id from ({op.ORACLE_SQL})").fetchall()
    assert {r[0]: r[1:] for r in sql} == got
    kept = sorted(r.doc_id for r in op.one_of_each_group(documents(spark, data)).collect())
    assert kept == sorted({g for _, _, g in got.values()})


def test_blocks_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(op, "BLOCK_BYTES", 6000)
    data = texts(6, 30, 3)
    got = {r.doc_id: (r.class_id, r.n_links, r.group_id) for r in op.near_duplicates(documents(spark, data)).collect()}
    assert got == brute(data)


def test_components_of_paths_and_stars(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + k) for k in range(1, 40)] + [(200, 201), (201, 202), (202, 200), (5, 5)]
    rng.shuffle(edges)
    got = {r.id: r.root for r in op.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{100 + k: 100 for k in range(40)}, 200: 200, 201: 200, 202: 200}
    assert op.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pruning_keeps_similar_pairs():
    assert all(m <= n for n, m in op.least_matches())
    rng = np.random.default_rng(5)
    lost = kept = 0
    for _ in range(150):
        base = rng.integers(0, 2**63, 400, dtype=np.uint64)
        other = np.concatenate([base[: 400 - 40], rng.integers(0, 2**63, 40, dtype=np.uint64)])
        a, b = np.unique(base), np.unique(other)
        assert len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b))
        sig = np.stack([op.signature(a), op.signature(b), op.signature(rng.integers(0, 2**63, 400, dtype=np.uint64))])
        found = {(i, j) for i, rest in op.pruned_pairs(sig, None) for j in rest.tolist()}
        lost += (0, 1) not in found
        kept += len(found) > 1
    assert lost == 0 and kept == 0


def near(text):
    return text.replace("w7 ", "other ")


A, B = (" ".join(f"{c}{i}" if c == "v" else f"w{i}" for i in range(80)) for c in "wv")


def test_repeated_and_null_ids(spark):
    assert op.near_duplicates(documents(spark, [])).count() == 0
    df = documents(spark, ["a b c d e f", "a b c d e f"]).selectExpr("cast(null as long) doc_id", "text", "1 as id", "2 as root")
    assert {tuple(r) for r in op.near_duplicates(df).collect()} == {(None, None, 0, None)}
    # two texts under one doc_id: both of their links are found
    rows = [(1, A), (1, B), (3, B.replace("v7 ", "other ")), (4, near(A))]
    got = sorted(tuple(r) for r in op.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 1, 1, 1), (1, 1, 1, 1), (3, 3, 1, 1), (4, 4, 1, 1)]
    # of rows without an id, the one that resembles nothing stays
    df = spark.createDataFrame([(None, A), (None, B), (3, near(A))], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.text) for r in op.one_of_each_group(df).collect()) == sorted([(0, B), (3, near(A))])
    # repeated rows are one group
    df = spark.createDataFrame([(5, A), (5, A), (None, A), (None, None), (6, "")], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in op.one_of_each_group(df).collect()) == [(5, A), (6, "")]


def test_clashing_columns_and_long_texts(spark):
    long = " ".join(f"z{i}" for i in range(60_000))
    names = ["id", "_row", "_kept", "band", "k", "size", "class_key", "ROOT", "_salt", "_hot", "in_set", "_slot"]
    df = documents(spark, [A, near(A), long, long + " end", None]).selectExpr("doc_id", "text", *[f"'mine' as `{n}`" for n in names])
    assert sorted(tuple(r)[1:] for r in op.near_duplicates(df).collect()) == [(0, 1, 0), (1, 1, 0), (2, 1, 2), (3, 1, 2), (4, 0, 4)]
    kept = op.one_of_each_group(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [0, 2, 4]
    assert all(tuple(r)[2:] == ("mine",) * len(names) for r in kept.collect())


def test_rows_grow_with_the_group_not_its_square(spark, monkeypatch):
    rng, made = random.Random(3), {}
    base = [f"w{i}" for i in range(140)]
    inner = op.written

    def spy(df, what, path=None):
        out = inner(df, what, path)
        made[what] = made.get(what, 0) + out.count()
        return out

    monkeypatch.setattr(op, "written", spy)
    for n in (150, 300):
        data = []
        for i in range(n):
            t = list(base)
            t[rng.randrange(140)] = f"n{i}"
            data.append(" ".join(t))
        made.clear()
        got = {r.doc_id: (r.class_id, r.n_links, r.group_id) for r in op.near_duplicates(documents(spark, data)).collect()}
        assert got == brute(data) and min(links for _, links, _ in got.values()) > n / 2
        assert made["dealt"] <= op.BANDS * n and made["links"] <= op.BANDS * n
