import itertools
import random
import re

import pytest
from lakeloom.functions import markup as M
from lakeloom.operators import tokenizer as K


def test_frozen_tokenizer_is_exact():
    t = K.FrozenTokenizer([("t", "h"), ("th", "e"), ("▁", "the")], list("abcdeth ▁"))
    for text in ("the the  cat", "1,234.5 é🙂日本", "नमस्ते\n\tx", "a▁b\\m \\", "", "  "):
        assert t.decode(t.encode(text)) == text
    assert K.FrozenTokenizer.load(t.dump()).encode("the the") == t.encode("the the")
    with pytest.raises(ValueError):
        K.FrozenTokenizer.load(t.dump().replace("th", "ht", 1))
    ids, roles = t.encode_turns([("user", "the"), ("assistant", "cat")])
    assert (ids[0], ids[-1]) == (t.BOS, t.EOS) and len(ids) == len(roles) and roles[1] == "user" and roles[-2] == "assistant"


def test_vocabulary_plan_matches_brute_force():
    rng = random.Random(3)
    for _ in range(60):
        options = [(x, v, round(rng.uniform(1, 3), 2)) for x in "abc" for v in (10, 20, 40, 80)]
        best = None
        for pick in itertools.product(*[[(v, r) for y, v, r in options if y == x] for x in "abc"]):
            total, spread = sum(v for v, _ in pick), max(r for _, r in pick) - min(r for _, r in pick)
            if total <= 120 and (best is None or (spread, total) < best):
                best = (spread, total)
        got = K.plan_vocabularies(options, 120)
        if best is None:
            assert got == {}
        else:
            rs = [r for _, r in got.values()]
            assert abs(max(rs) - min(rs) - best[0]) < 1e-9 and sum(v for v, _ in got.values()) <= 120


def test_captions_tables_and_chunks():
    parser = M.CaptionsAndTables()
    parser.feed('<p>no<table class="x wikitable"><caption>C</caption><tr><td>a &amp; b<br>c<td class="navbox">n<b>o</b></td></table><figcaption>F</figcaption><script>s</script>z')
    assert parser.parts == ["C", "a & b", "c", "F"]
    assert M.sentence_chunks("One. Two! Three? " + "x" * 30 + ".", 12) == ["One. Two!", "Three?", "x" * 30 + "."]
    assert M.sentence_chunks("", 10) == []


def test_survivors_are_decided_on_whole_shingle_sets(spark, tmp_path):
    import random

    from lakeloom.plans import duplicates

    rng, texts = random.Random(9), []
    for k in range(60):
        words = [f"w{k}x{j}" for j in range(60)]
        other = list(words)
        for at in rng.sample(range(60), k % 4):
            other[at] = f"new{k}x{at}"
        texts += [" ".join(words), " ".join(other) + " end"]
    rows = [(i, t, "s", "en") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")

    def grams(t):
        w = t.split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    want = {}
    for i in range(0, len(texts), 2):
        a, b = grams(texts[i]), grams(texts[i + 1])
        want |= {i: None, i + 1: i if len(a & b) * 16 >= len(a | b) * 13 else None}
    assert 10 < sum(v is not None for v in want.values()) < 50
    assert {r.doc_id: r.removed_by for r in duplicates.lfmis_survivors(spark, str(tmp_path)).collect()} == want


def test_positions_in_spans_are_counted_without_a_row_each(spark, tmp_path):
    """Ties in turn, null turns, roles and conversations as in the SQL; a turn of many words makes no row for each of them."""
    import duckdb

    from lakeloom.plans import layout

    rows = [(1, 0, "user", "a b c"), (1, 1, "user", "d e"), (1, 1, "tool", "f g h i"), (1, None, "user", "j"), (1, 2, None, "k l"), (1, 3, "user", None), (1, 4, "user", " "),
            (None, 0, "user", "lost"), (2, 0, "system", "w " * 70_000), (2, 1, "user", "x y")]
    folder = str(tmp_path)
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{folder}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{folder}/conversations.parquet/*.parquet'")
    found = layout.positions_in_spans(spark, folder)
    key = lambda r: (r[0], str(r[1]))
    want = con.execute(layout.QUERIES["positions_in_spans"][1]).fetchall()
    assert sorted((tuple(r[c] for c in ("conv_id", "role", "positions", "total")) for r in found.collect()), key=key) == sorted(want, key=key)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan


def test_character_shingles_are_counted_in_linear_time(spark, tmp_path):
    """All scripts, more characters than fit a key, short texts and nulls; a text of a million characters is counted at once."""
    import random
    import time

    from lakeloom.plans import duplicates

    rng = random.Random(4)
    texts = ["", " ", None, "abcde", "abcdef", " a \t b\n\nc \r d ", "aaaaaaaaa", "\u3000ab\u00a0cde ", "\U0001f600" * 9 + "\U0001f601", "\u0915\u093f" * 30]
    texts += ["".join(chr(rng.choice((97, 98, 0xE9, 0x4E00, 0x1F600)) + rng.randint(0, 2)) for _ in range(3000)), "".join(chr(0x4E00 + rng.randint(0, 9000)) for _ in range(40_000)) * 2]
    texts.append("".join(rng.choices("abcd ", k=1_000_000)))
    folder = str(tmp_path)
    spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{folder}/documents.parquet")

    def plain(t):
        t = re.sub("[ \t\n\r]+", " ", t or "").strip(" ")
        return len({t[i : i + 5] for i in range(len(t) - 4)}) if len(t) > 5 else 1

    began = time.time()
    assert {r.doc_id: r.shingles for r in duplicates.char_shingle_sizes(spark, folder).collect()} == {i: plain(t) for i, t in enumerate(texts)}
    assert time.time() - began < 60


def test_fast_signatures_are_the_exact_ones():
    import numpy as np

    from lakeloom.operators import dedup as D

    rng, top = np.random.default_rng(3), D.MERSENNE
    for n in (1, 2, 511, 512, 513, 1025, 1500):
        h = rng.integers(0, top, n).astype(np.uint64)
        assert (D.fast_minhash(h, 128) == D.mersenne_minhash(h, 128)).all()
    for h in ([0], [top - 1, 0, 1], [5, 5, 5]):
        h = np.array(h, np.uint64)
        assert (D.fast_minhash(h, 64) == D.mersenne_minhash(h, 64)).all()


def test_survivors_of_a_text_shared_in_part_move_few_rows(spark, tmp_path):
    """1,500 documents whose first fifth is the same meet in many bands; before, each pair of them was written with both shingle sets."""
    import os
    import random

    from lakeloom.plans import duplicates

    rng = random.Random(2)
    texts = [" ".join([f"h{i}" for i in range(20)] + [f"d{k}x{j}" for j in range(80)]) for k in range(1500)]
    texts += [t + " end" for t in rng.sample(texts, 50)] + ["one", "one two", ""]
    rows = [(i, t, "s", "en") for i, t in enumerate(texts)] + [(None, "no id", "s", "en")]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    base = {t: i for i, t in reversed(list(enumerate(texts[:1500])))}
    before = spark.sparkContext._jsc.sc().getCheckpointDir()
    spark.sparkContext.setCheckpointDir(str(tmp_path / "state"))
    try:
        got = {r.doc_id: r.removed_by for r in duplicates.lfmis_survivors(spark, str(tmp_path)).collect()}
    finally:
        if before.isDefined():
            spark.sparkContext.setCheckpointDir(os.path.dirname(before.get()))
    assert got == {i: base[t[:-4]] if t.endswith(" end") else None for i, t in enumerate(texts)}
    assert sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(tmp_path / "state") for f in names) < 4_000_000


def test_sweep_of_texts_shared_in_part_moves_few_rows(spark, tmp_path, monkeypatch):
    """As above, at eight thresholds; before, each pair that shares a band was written and joined with both shingle arrays. Groups larger than a block, chains and a repeated doc_id."""
    import os
    import random

    from lakeloom.operators import dedup as D
    from lakeloom.plans import duplicates

    monkeypatch.setattr(D, "BLOCK_RUNS", 1000)
    rng = random.Random(5)
    texts = {" ".join([f"h{i}" for i in range(20)] + [f"d{k}x{j}" for j in range(80)]): None for k in range(1000)}
    for g in range(8):  # near versions: of one text, or each of the one before it
        base = [f"g{g}x{j}" for j in range(60)]
        for k in range(90 if g == 0 else 12):
            t = list(base)
            for _ in range(rng.randint(0, 3)):
                t[rng.randrange(60)] = f"new{g}x{rng.randint(0, 99)}"
            base = t if g % 2 else base
            texts[" ".join(t)] = g
    groups = texts | {"one": None, "one two": None, "": None}
    texts = rng.sample(list(groups), len(groups))
    rows = [(i, t, "s", "en") for i, t in enumerate(texts)] + [(None, "no id", "s", "en"), (len(texts), texts[3], "s", "en")]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    runs = [D._word_runs(t, 5) for t in texts]
    near = [[i for i, t in enumerate(texts) if groups[t] == g] for g in range(8)]
    keys = {i: D._pair_keys(D.fast_minhash(D._hashes(runs[i]), 128)) for group in near for i in group}
    pairs = [(min(i, j), max(i, j)) for group in near for i in group for j in group if i < j and (keys[i] == keys[j]).any()]
    want = {}
    for t in duplicates.SWEEP:
        smaller, gone = {}, set()
        for a, b in pairs:
            if len(runs[a] & runs[b]) * 100 >= len(runs[a] | runs[b]) * t:
                smaller.setdefault(b, []).append(a)
        for b in sorted(smaller):
            if any(a not in gone for a in smaller[b]):
                gone.add(b)
        want[t] = len(gone)
    assert want[30] > want[90] > 0
    before = spark.sparkContext._jsc.sc().getCheckpointDir()
    spark.sparkContext.setCheckpointDir(str(tmp_path / "state"))
    try:
        found = duplicates.threshold_sweep(spark, str(tmp_path))
        assert {r.threshold: r.removed for r in found.collect()} == want
    finally:
        if before.isDefined():
            spark.sparkContext.setCheckpointDir(os.path.dirname(before.get()))
    assert found.dtypes == [("threshold", "int"), ("removed", "bigint")]
    assert sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(tmp_path / "state") for f in names) < 3_000_000


def test_wide_pairs_are_those_of_plain_sets(spark):
    """Sizes from one run to more than the bit map has bits, at the threshold and just below it; repeated doc_ids."""
    from lakeloom.operators import dedup as D

    rows = []
    for n in (5, 6, 9, 40, 300, 1500, 4000):
        base = [f"b{n}x{j}" for j in range(n)]
        for part in (0.0, 0.3, 0.45, 0.461, 0.462, 0.6, 0.9):  # of runs shared: 6 in 13 are a similarity of 0.3
            cut = round((n - 4) * part) + 4
            rows.append((len(rows), " ".join(base[:cut] + [f"o{part}x{n}x{j}" for j in range(n - cut)])))
    rows += [(3, " ".join(f"b40x{j}" for j in range(30))), (len(rows), None), (len(rows) + 1, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [(i, s := D._word_runs(t, 5), D._pair_keys(D.fast_minhash(D._hashes(s), 128))) for i, t in rows]
    want = {(a, b, len(x & y), len(x | y)) for a, x, k in sets for b, y, h in sets if a < b and (k == h).any() and len(x & y) * 10 >= len(x | y) * 3}
    assert len(want) > 30
    got = [tuple(r) for r in D.wide_word_pairs(docs, docs.select("doc_id"), (3, 10)).collect()]
    assert set(got) == want
