import hashlib
import random
import re

import duckdb
from docs import documents, saved
from lakeloom.llm import line_dedup as op


INK = re.compile("[^ \t\n\x0b\x0c\r]")


def bounds(lines):
    h = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in lines]
    return [i for i, x in enumerate(lines) if INK.search(x) and (i in (0, len(lines) - 1) or (h[i] + 31 * h[i - 1]) % 8 < 7)]


def brute(texts):
    """Chunks in order of document and place; a later one goes with the neighbours that equal the first one's."""
    seen, out = {}, {}
    for i, t in enumerate(texts):
        lines = (t or "").split("\n")
        b, gone, chunks = bounds(lines), set(), 0
        for k in range(len(b) - 1):
            f, z = b[k], b[k + 1]
            text = "\n".join(lines[f : z + 1])
            before = lines[b[k - 1] if k else 0 : f][::-1]
            after = lines[z + 1 : (b[k + 2] if k + 2 < len(b) else len(lines) - 1) + 1]
            if text not in seen:
                seen[text] = before, after
                continue
            chunks += 1
            for near, step, at in ((before, -1, f), (after, 1, z)):
                kept = seen[text][near is after]
                for x, y in zip(near, kept):
                    if x != y:
                        break
                    at += step
                    gone.add(at)
            gone |= set(range(f, z + 1))
        out[i] = (len(lines), max(0, len(b) - 1), chunks, len(gone), "\n".join(x for j, x in enumerate(lines) if j not in gone))
    return out


def texts():
    rng = random.Random(4)
    passage = [f"passage line {k} of many words" for k in range(12)]
    found = []
    for _ in range(150):
        own = [rng.choice(["", " ", "x", f"line {rng.randint(0, 60)}", f"own {rng.random()}"]) for _ in range(rng.randint(0, 12))]
        at = rng.randint(0, len(own))
        found.append("\n".join(own[:at] + (passage if rng.random() < 0.5 else []) + own[at:]))
    return found + [None, "", "\n\n\n", "a\n" * 3000, found[0], found[0]]


def test_matches_brute_force_and_sql(spark, tmp_path):
    data = texts()
    folder = saved(documents(spark, data).repartition(3), tmp_path)
    got = {r.doc_id: r for r in op.query(spark, folder).collect()}
    want = brute(data)
    for i, w in want.items():
        r = got[i]
        assert (r.n_lines, r.n_chunks, r.removed_chunks, r.removed_lines, r.text_sha256) == (*w[:4], hashlib.sha256(w[4].encode()).hexdigest()), i
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{folder}/documents.parquet/*.parquet'")
    sql = con.execute(f"select doc_id, n_lines, n_chunks, removed_chunks, removed_lines, text_sha256 from ({op.ORACLE_SQL})").fetchall()
    assert {r[0]: r for r in sql} == {i: tuple(r) for i, r in got.items()}


def test_shifted_passage_is_found(spark):
    passage = "\n".join(f"shared sentence number {k} with words" for k in range(30))
    out = {r.doc_id: r for r in op.dedup_lines(documents(spark, ["a\n" + passage, "b\nc\nd\n" + passage + "\ne"])).collect()}
    assert out[0].removed_lines == 0 and out[1].removed_lines == 30
    assert out[1].text == "b\nc\nd\ne"


def test_every_line_stays_somewhere():
    rng = random.Random(12)
    for _ in range(300):
        data = ["\n".join(rng.choice("abcd") for _ in range(rng.randint(0, 14))) for _ in range(6)]
        left = {x for *_, t in brute(data).values() for x in t.split("\n")}
        assert {x for t in data for x in t.split("\n") if x} <= left


def test_plan_empty_nulls_and_clashes(spark):
    names = ["gone", "_id", "_tag", "_own", "_ls", "_gone", "_chunks", "in_set", "_IN_SET", "id2", "tag2", "_slot", "_bits", "s", "h"]
    df = documents(spark, texts()).selectExpr("*", *[f"'mine' as `{n}`" for n in names], "2 as n_lines")
    out = op.dedup_lines(df)
    assert not re.search("Python|Arrow|Pandas", out._jdf.queryExecution().executedPlan().toString())
    got = out.collect()
    assert len(got) == df.count() and out.columns[: len(df.columns) - 1] == df.columns[:-1]
    assert all(r[n] == "mine" for r in got for n in names)
    assert {r.doc_id: r.text for r in got} == {i: w[4] for i, w in brute(texts()).items()}
    assert op.dedup_lines(documents(spark, [])).count() == 0
    nulls = documents(spark, ["p q\nr s\nt u\nv w\n" * 9] * 3).selectExpr("cast(null as long) doc_id", "text")
    assert len({r.text for r in op.dedup_lines(nulls).collect()}) == 1


def test_repeated_ids_with_other_texts(spark):
    shared = "\n".join(f"line {k} of a passage that repeats" for k in range(8))
    rows = [(1, shared + "\nx"), (1, "y\n" + shared), (1, "y\n" + shared), (None, shared), (None, None)]
    got = sorted((r.doc_id or 9, r.text) for r in op.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert sum("line 3" in t for _, t in got) in (1, 2) and len(got) == 5
    assert (9, "") in got


def test_recall_on_short_passages_is_as_stated():
    """The shares of the README, by the rule that test_matches_brute_force_and_sql checks."""
    rng = random.Random(1)
    for n, share in ((2, 68), (3, 93), (4, 98), (6, 100), (10, 100)):
        gone = 0
        for k in range(1000):
            passage = [f"passage {k} line {j} {rng.random()}" for j in range(n)]
            own = [[f"own {rng.random()}" for _ in range(rng.randint(1, 6))] for _ in range(4)]
            gone += brute(["\n".join(own[0] + passage + own[1]), "\n".join(own[2] + passage + own[3])])[1][3]
        assert abs(gone / (10 * n) - share) < 3, n
