import random
import re

import duckdb
from docs import documents, saved
from lakeloom.llm import license_scan as op

BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def brute(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered)
    places, labels = [], set()
    for k, label in BASE.items():
        k = k.split()
        for i in range(len(w)):
            if w[i : i + len(k)] == k:
                places.append(i)
                labels.add(label)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def random_text(rng):
    parts = ["GNU", "gnu", "General", "public", "license", "LICENSE.", "apache", "Licence", "mit", "MIT-license", "cc", "by", "CC-BY", "nc", "é", "İ", "K", "x",
             "version 3", "All rights reserved", "licensed under the GNU General Public License, version 3.", "gnu affero general public license", "\n", "cc_by"]
    return rng.choice([" ", "-", "\n"]).join(rng.choice(parts) for _ in range(rng.randint(0, 25)))


def test_matches_brute_force_and_sql(spark, tmp_path):
    rng = random.Random(3)
    texts = [random_text(rng) for _ in range(600)] + [None, "", "mit license " * 20_000]
    folder = saved(documents(spark, texts), tmp_path)
    got = {r.doc_id: r for r in op.query(spark, folder).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(t), (t or "")[:200]
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) or not r.base_labels
        assert 0 <= r.score <= 1
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{folder}/documents.parquet/*.parquet'")
    sql = con.execute(f"select * from ({op.ORACLE_SQL}) order by doc_id").fetchall()
    assert sql == [tuple(got[i]) for i in range(len(texts))]
    assert "gpl-3.0" in {x for r in got.values() for x in r.labels.split(",")}


def noisy(rng, text, share):
    """A licence text in capitals and with marks, some of its words replaced."""
    return " ".join(("other" if rng.random() < share else w.upper() if rng.random() < 0.3 else w) + rng.choice(["", ",", ".", "\n"]) for w in text.split())


def plain_labels(text):
    """Labels by trying every word as a start of every template."""
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered)
    found = set()
    for t in op.TEMPLATES:
        body = (t.text or t.key).split()
        for start in range(-len(body), len(w)):
            stands = [0 <= start + j < len(w) and w[start + j] == x for j, x in enumerate(body)]
            spots = [op._offset(body, p.split()) for p in (t.key, *t.must)]
            if all(all(stands[a : a + len(p.split())]) for a, p in zip(spots, (t.key, *t.must))) and sum(stands) >= (op.COVERAGE if t.text else 1) * len(body):
                found.add(t.label)
                break
    return ",".join(sorted(found))


def test_licence_texts(spark):
    rng = random.Random(11)
    full = [t for t in op.TEMPLATES if t.text]
    texts = [f"Copyright (c) 2020 {i}\n" + noisy(rng, t.text, rng.choice([0, 0, 0.05, 0.3])) + " more " + random_text(rng) for t in full for i in range(12)]
    texts += [f"{t.text} {u.text}" for t in full for u in full[:4]]
    got = {r.doc_id: r.labels for r in op.license_scan(documents(spark, texts)).collect()}
    assert got == {i: plain_labels(t) for i, t in enumerate(texts)}
    assert {t.label for t in full} <= {x for v in got.values() for x in v.split(",")}


def test_postings_hold_the_rarest_words():
    index = op.postings(["mit license", "gnu general public license"], {"mit": 5, "license": 90, "gnu": 7, "general": 3, "public": 40})
    assert index == {"mit": [(0, 0, 0)], "license": [(0, 1, 1)], "general": [(1, 1, 0)], "gnu": [(1, 0, 1)]}


def test_places_repeat_within_long_texts(spark):
    texts = ["apache license " * 30_000, "licensed under the apache license version 2 0 " * 5_000, "word " * 300_000 + "cc by"]
    got = {r.doc_id: r for r in op.license_scan(documents(spark, texts)).collect()}
    assert [(got[i].n_base, got[i].labels) for i in range(3)] == [(30_000, "apache"), (5_000, "apache,apache-2.0"), (1, "cc-by")]


def test_no_python_in_the_plan_empty_repeated_and_clashing(spark):
    names = ["w", "hits", "found", "at", "starts", "agreed", "n_words", "LABELS"]
    df = documents(spark, ["cc by"]).selectExpr("*", *[f"'mine' as `{n}`" for n in names])
    out = op.license_scan(df)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
    assert out.first().n_base == 1
    assert op.license_scan(documents(spark, [])).count() == 0
    rows = [(1, "MIT license"), (1, "MIT license"), (1, "x"), (None, "cc-by"), (None, None)]
    got = sorted((r.doc_id or 0, r.n_words, r.labels) for r in op.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, 0, ""), (0, 2, "cc-by"), (1, 1, ""), (1, 2, "mit"), (1, 2, "mit")]
