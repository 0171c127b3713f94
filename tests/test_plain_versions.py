"""Queries that SQL cannot express, or not in time, against plain loops over the same tables."""

import hashlib
import math
import os
import random
import re
import unicodedata
from collections import Counter

import duckdb
import pytest
import regex
from lakeloom.functions import vectors as V
from lakeloom.operators import dedup as D
from lakeloom.operators import packing as P
from lakeloom.operators import tokenizer as K
from lakeloom.plans import catalog, duplicates, scripts

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def documents():
    return duckdb.sql(f"select doc_id, coalesce(text, '') as text, lang, source from '{DIR}/documents.parquet' order by doc_id").fetchall()


def run(spark, name):
    return catalog.queries()[name](spark, DIR).collect()


def firsts(documents):
    seen = {}
    for i, t, *_ in documents:
        seen.setdefault(t, i)
    return {i: t for t, i in seen.items()}


def minhash(shingles, count):
    p = 2**61 - 1
    hashes = [int.from_bytes(hashlib.sha256(s.encode()).digest()[:8], "big") % p for s in shingles]
    out = []
    for i in range(count):
        d = hashlib.sha256(f"minhash-perm\x1f{i}".encode()).digest()
        a, b = (int.from_bytes(d[:8], "big") | 1) % p, int.from_bytes(d[8:16], "big") % p
        out.append(min((a * h + b) % p for h in hashes))
    return out


def char_shingles(text):
    t = " ".join(unicodedata.normalize("NFC", text.replace("\r\n", "\n").replace("\r", "\n")).split())
    return {t} if 0 < len(t) <= 5 else {t[i : i + 5] for i in range(len(t) - 4)}


def word_shingles(text):
    w = re.findall(r"[^ \t\n\x0b\f\r]+", text)
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def greedy(nodes, edges):
    """Nodes in order; one goes if a kept smaller one is its neighbour."""
    near, by = {}, {}
    for a, b in edges:
        near.setdefault(max(a, b), set()).add(min(a, b))
    for n in sorted(nodes):
        kept = [m for m in near.get(n, ()) if by.get(m) is None]
        by[n] = min(kept) if kept else None
    return by


def banded(sigs, rows, bands):
    found = {}
    for i, s in sigs.items():
        for b in range(bands):
            found.setdefault((b, *s[b * rows : (b + 1) * rows]), []).append(i)
    return {(a, b) for group in found.values() for a in group for b in group if a < b}


def test_minhash_over_characters(spark, documents):
    texts = {i: t for i, t in firsts(documents).items() if i < 12}
    got = {r.doc_id: r.sig for r in run(spark, "minhash64_signature")}
    assert set(got) == set(firsts(documents))
    for i, t in texts.items():
        s = char_shingles(t)
        assert got[i] == (",".join(map(str, minhash(s, 64))) if s else None)


def near_texts(n=120, seed=4):
    rng, out = random.Random(seed), []
    while len(out) < n:
        base = [f"w{rng.randint(0, 900)}" for _ in range(rng.randint(1, 50))]
        for _ in range(rng.randint(1, 4)):
            t = list(base)
            for _ in range(rng.randint(0, 3)):
                t[rng.randrange(len(t))] = f"x{rng.randint(0, 99)}"
            out.append(" ".join(t))
    return out[:n] + ["", " ", "one"]


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    texts = near_texts()
    folder = str(tmp_path_factory.mktemp("near"))
    rows = [(i, t, "en", f"src{i % 3}") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{folder}/documents.parquet")
    return folder, firsts(rows)


def test_survivors_over_characters(spark, small):
    folder, texts = small
    sigs = {i: minhash(char_shingles(t), 64) for i, t in texts.items() if t.strip()}
    edges = [(a, b) for a, b in banded(sigs, 4, 16) if sum(x == y for x, y in zip(sigs[a], sigs[b])) * 5 >= 4 * 64]
    assert len(edges) > 20
    assert {r.doc_id: r.removed_by for r in duplicates.minhash64_survivors(spark, folder).collect()} == greedy(texts, edges)


def test_pairs_verdicts_and_sweep(spark, small):
    folder, texts = small
    sets = {i: word_shingles(t) for i, t in texts.items()}
    sigs = {i: minhash(s, 128) for i, s in sets.items()}
    pairs = {}
    for a, b in banded(sigs, 11, 11):
        shared = len(sets[a] & sets[b])
        pairs[a, b] = (sum(x == y for x, y in zip(sigs[a], sigs[b])), shared, len(sets[a] | sets[b]))
    got = {(r.a, r.b): (r.equal_slots, r.shared, r.total) for r in duplicates.minhash128_pairs(spark, folder).collect()}
    assert got == pairs and len(pairs) > 4
    near = sorted(pairs, key=lambda p: (abs(pairs[p][1] * 100 - pairs[p][2] * 75) / pairs[p][2], p))[:8]
    verdicts = [((r.a, r.b), r.caught) for r in duplicates.threshold_verdicts(spark, folder).collect()]
    assert verdicts == [(p, ",".join(str(t) for t in (50, 60, 65, 70, 75, 80, 90) if pairs[p][0] * 100 >= t * 128)) for p in near]
    wide = {p: (len(sets[p[0]] & sets[p[1]]), len(sets[p[0]] | sets[p[1]])) for p in banded(sigs, 2, 64)}
    want = {t: sum(v is not None for v in greedy(texts, [p for p, (s, n) in wide.items() if s * 100 >= n * t]).values()) for t in (90, 80, 75, 70, 60, 50, 40, 30)}
    assert {r.threshold: r.removed for r in duplicates.threshold_sweep(spark, folder).collect()} == want


def plain_merges(counts, merges, units=list, largest=False, least=2):
    words = {w: units(w) for w in counts}
    table = []
    while len(table) < merges:
        pairs = Counter()
        for w, s in words.items():
            for p in zip(s, s[1:]):
                pairs[p] += counts[w]
        if not pairs:
            break
        best = max(pairs, key=lambda p: (pairs[p], p)) if largest else min(pairs, key=lambda p: (-pairs[p], p))
        if pairs[best] < least:
            break
        table.append(best)
        for w, s in words.items():
            out, i = [], 0
            while i < len(s):
                if tuple(s[i : i + 2]) == best:
                    out.append(s[i] + s[i + 1])
                    i += 2
                else:
                    out.append(s[i])
                    i += 1
            words[w] = out
    return table, {w: len(s) for w, s in words.items()}


@pytest.mark.parametrize(("units", "ties"), [("char", "smallest"), ("char", "largest"), ("grapheme", "smallest")])
def test_merges_match_plain_training(spark, units, ties):
    rng = random.Random(f"{units}{ties}")
    for _ in range(3):
        alphabet = rng.choice(["ab", "abcde", ["క్", "ష", "ి", "a"]])
        counts = {"".join(rng.choice(alphabet) for _ in range(rng.randint(1, 9))): rng.randint(1, 6) for _ in range(60)}
        df = spark.createDataFrame(list(counts.items()), "token string, freq long")
        cut = list if units == "char" else (lambda w: regex.findall(r"\X", w))
        want, _ = plain_merges(counts, 40, cut, ties == "largest")
        assert K.train_merges(df, 40, units=units, ties=ties) == want
        assert K.train_merges(df, 40, units=units, ties=ties, max_types=20) == want


def pretokens(text):
    return regex.findall(r"[\p{L}\p{M}]+|\p{Nd}+|\S", text.lower())


def test_fertility_queries(spark, documents):
    by_lang = {}
    for _, t, lang, _ in documents:
        by_lang.setdefault(lang, Counter()).update(pretokens(t))
    total = sum(by_lang.values(), Counter())

    def ratio(table, counts):
        ranks = {p: i for i, p in enumerate(table)}
        return sum(counts.values()), sum(n * len(K.encode_word(w, ranks)) for w, n in counts.items())

    merges, _ = plain_merges(total, 400)
    assert {r.lang: (r.words, r.pieces) for r in run(spark, "fertility_by_lang")} == {x: ratio(merges[:300], c) for x, c in by_lang.items()}
    assert {(r.lang, r.merges): (r.words, r.pieces) for r in run(spark, "fertility_sweep")} == {(x, n): ratio(merges[:n], c) for x, c in by_lang.items() for n in (100, 200, 400)}
    assert {r.token: r.pieces for r in run(spark, "bpe_train_encode")} == {w: K.encode_word(w, {p: i for i, p in enumerate(merges[:300])}) for w in total}
    grid = {}
    for weight in (1, 4):
        weighted = sum((Counter({w: n * (weight if x == "es" else 1) for w, n in c.items()}) for x, c in by_lang.items()), Counter())
        table, _ = plain_merges(weighted, 150)
        grid |= {(x, weight): ratio(table, c) for x, c in by_lang.items()}
    assert {(r.lang, r.weight): (r.words, r.pieces) for r in run(spark, "bpe_weight_grid")} == grid
    largest, _ = plain_merges(total, 200, largest=True)
    want = {n: (ratio(largest[:n], total)[1], ratio(largest[:n], Counter(dict.fromkeys(total, 1)))[1]) for n in (50, 100, 200)}
    assert {r.merges: (r.weighted, r.distinct) for r in run(spark, "bpe_largest_tie")} == want
    own = {}
    for lang in ("en", "fr", "de", "es"):
        for least in (2, 50):
            table, _ = plain_merges(by_lang.get(lang, Counter()), 200, least=least)
            own |= {(lang, least, n): ratio(table[:n], by_lang[lang]) for n in (50, 200) if lang in by_lang}
    assert {(r.lang, r.least, r.size): (r.words, r.pieces) for r in run(spark, "dedicated_fertility")} == own


def test_other_units_and_profiles(spark, documents):
    planted = [t + " " + scripts.PLANTED[i % 5] for i, t, *_ in documents]
    counts = sum((Counter(pretokens(t)) for t in planted), Counter())
    _, sizes = plain_merges(counts, 200, lambda w: regex.findall(r"\X", w))
    want = {}
    for w, n in counts.items():
        key = bool(re.search("[ऀ-೿]", w))
        a, b = want.get(key, (0, 0))
        want[key] = (a + n, b + n * sizes[w])
    assert {r.indic: (r.words, r.pieces) for r in run(spark, "bpe_graphemes")} == want
    extras = sum((Counter(pretokens(scripts.PLANTED[i % 5])) for i, *_ in documents), Counter())
    grid = {}
    for a in (False, True):
        for b in (False, True):
            parts = Counter()
            for w, n in extras.items():
                for x in V.profiled(w, a, b):
                    parts[x] += n
            _, sizes = plain_merges(parts, 40)
            grid[a, b] = (len(parts), sum(parts.values()), sum(n * sizes[w] for w, n in parts.items()))
    assert {(r.transliterate, r.suffixes): (r.types, r.pretokens, r.pieces) for r in run(spark, "profile_grid")} == grid
    assert V.profiled("ఇంటిలో", False, True) == ["ఇంటి", "లో"] and V.profiled("ఇల్లు", True, False) == ["इल्लु"]


def test_faithful_vocabulary(spark, documents):
    kinds = {r.kind: r.ids for r in run(spark, "faithful_vocabulary")}
    counts = Counter()
    for _, t, lang, _ in documents:
        for w in K.reversible_pretokens(t):
            counts[w] += 3 if lang == "es" else 1
    letters = set("".join(counts))
    table, _ = plain_merges(counts, 1000 - 256 - len(letters))
    assert kinds == {"byte": 256, "letter": len(letters), "merge": len({a + b for a, b in table})}


def plain_pack(docs, size, best):
    """First fit in order of id, or best fit from the longest piece, by looking at every sequence."""
    pieces = [(d, a, min(n, a + size)) for d, n in sorted(docs) for a in range(0, n, size)]
    if best:
        pieces.sort(key=lambda p: (p[1] - p[2], p[0], p[1]))
    room, out = [], []
    for d, a, z in pieces:
        fits = [i for i, r in enumerate(room) if r >= z - a]
        i = (min(fits, key=lambda i: (room[i], i)) if best else fits[0]) if fits else len(room)
        if i == len(room):
            room.append(size)
        out.append((i, d, a, z, size - room[i], size - room[i] + z - a))
        room[i] -= z - a
    return sorted(out)


def test_fitting_orders_and_ranking(spark, documents):
    rng, lanes = random.Random(5), {}
    rows = [(rng.choice("ab"), i, rng.choice([0, 1, 5, 30, 63, 64, 65, 200])) for i in range(300)]
    for lane, i, n in rows:
        lanes.setdefault(lane, []).append((i, n))
    df = spark.createDataFrame(rows, "lane string, doc_id long, n long")
    for pack, best in ((P.first_fit, False), (P.best_fit, True)):
        got = {}
        for r in pack(df, 64).collect():
            got.setdefault(r.lane, []).append(tuple(r)[1:])
        assert {k: sorted(v) for k, v in got.items()} == {k: plain_pack(v, 64, best) for k, v in lanes.items()}
    lanes, size = {}, 256
    for i, t, lang, _ in documents:
        lanes.setdefault(lang, []).append((i, len(re.findall(r"[^ \t\n\x0b\f\r]+", t))))
    for name, best in (("first_fit", False), ("best_fit", True)):
        row = next(r for r in run(spark, "pack_ranking") if r.policy == name)
        packed = [plain_pack(v, size, best) for v in lanes.values()]
        real = sum(z - a for p in packed for _, _, a, z, *_ in p)
        sequences = sum(len({s for s, *_ in p}) for p in packed)
        assert (row.sequences, row.real_tokens) == (sequences, real) and math.isclose(row["yield"], real / (sequences * size))


def test_admission_counts_and_compression(spark, documents):
    import zlib

    from lakeloom.operators import cleaning as C

    got = {r.doc_id: r for r in run(spark, "admission_pii")}
    for i, t, *_ in documents:
        t += " 4321 8765 2109 ABCDE1234F 2007-2008 2008-2009 192.168.10.44 "
        clean = t
        for name, pattern, mark in C.ADMISSION_PII_RULES:
            found = re.findall(pattern, clean, re.ASCII)
            clean = re.sub(pattern, mark, clean, flags=re.ASCII)
            assert got[i][name] == len(found), (i, name)
        assert got[i].clean == clean
    ratios = {i: len(zlib.compress(t.encode(), 6)) / max(1, len(t.encode())) for i, t, *_ in documents}
    rows = run(spark, "compression_proxy")
    names = rows[0].__fields__
    assert "doc_id" not in names or all(math.isclose(next(v for v in r if isinstance(v, float)), ratios[r.doc_id], rel_tol=1e-9, abs_tol=1e-6) for r in rows)


def test_capacity_curve(spark):
    def phi(x):
        return 0.5 * (1 + math.erf(x / math.sqrt(2)))

    for r in run(spark, "capacity_curve"):
        want = sum(math.exp(-((k / 100 - r.d) ** 2) / 2) / math.sqrt(2 * math.pi) * phi(k / 100) ** (r.m - 1) * 0.01 for k in range(-800, 1601))
        assert abs(r.p - want) < 1e-9


def test_kernel_arithmetic():
    import numpy as np

    rng = np.random.default_rng(3)
    h = rng.integers(0, 2**61 - 1, 5000, dtype=np.uint64)
    a, b = D._mersenne_coefficients(8)
    got = D.mersenne_minhash(h, 8).tolist()
    assert got == [min((int(x) * int(v) + int(y)) % (2**61 - 1) for v in h) for x, y in zip(a[:, 0], b[:, 0])]


def test_chunks_and_round_trips(spark, documents):
    from lakeloom.functions import markup as M

    chunks = {}
    for _, t, lang, _ in documents:
        for c in M.sentence_chunks(t, 400):
            n, longest = chunks.get(lang, (0, 0))
            chunks[lang] = (n + 1, max(longest, len(c)))
    assert {r.lang: (r.chunks, r.longest) for r in run(spark, "sentence_chunk_sizes")} == chunks
    assert all(r.docs == r.exact and r.tokens > 0 for r in run(spark, "tokenizer_roundtrip"))
    assert all(r.worst < 1e-9 for r in run(spark, "holographic_roundtrip"))


def test_quality_model(spark, documents):
    labels = dict(duckdb.sql(f"select doc_id, quality from '{DIR}/labels.parquet'").fetchall())
    rows = {r.doc_id: r for r in run(spark, "quality_model_scores")}
    assert set(rows) == {i for i, *_ in documents} and all(0 <= r.p_good <= 1 and r.is_good == (r.p_good >= 0.5) for r in rows.values())
    good = [rows[i].p_good for i, q in labels.items() if q == 1 and i in rows]
    bad = [rows[i].p_good for i, q in labels.items() if q == 0 and i in rows]
    assert sum(good) / len(good) > sum(bad) / len(bad)
    report = run(spark, "quality_model_evaluation")[0]
    split = {r.doc_id: r for r in run(spark, "quality_split")}
    assert report.tp + report.fp + report.fn + report.tn == sum(r.part == "test" for r in split.values())


def test_reversible_pretokens_and_parts(spark, documents):
    from lakeloom.functions import vectors as V

    got = {r.doc_id: (r.n, r.exact) for r in run(spark, "reversible_pretokens")}
    assert got == {i: (len(K.reversible_pretokens(t)), True) for i, t, *_ in documents}
    words = Counter(w for i, *_ in documents for w in regex.findall(r"[\p{L}\p{M}]+|\p{Nd}+|\S", scripts.PLANTED[i % 5]))
    assert {r.w: (r.n, r.parts) for r in run(spark, "suffix_script_words")} == {w: (n, "+".join(V.profiled(w, True, True))) for w, n in words.items()}


def test_role_tokens_and_page_texts(spark):
    turns = duckdb.sql(f"select conv_id, turn, role, coalesce(text, '') from '{DIR}/conversations.parquet' order by 1, 2").fetchall()
    counts = Counter(w for *_, t in turns for w in K.reversible_pretokens(t))
    table, _ = plain_merges(counts, 150)
    t = K.FrozenTokenizer(table, sorted(set("".join(counts))))
    want = {}
    for conv in {c for c, *_ in turns}:
        ids, roles = t.encode_turns([(r, x) for c, _, r, x in turns if c == conv])
        want |= {(conv, role): (len(ids), n) for role, n in Counter(roles).items()}
    assert {(r.conv_id, r.role): (r.n, r.ids) for r in run(spark, "role_tokens")} == want
    rows = run(spark, "page_texts")
    assert rows and all(r.captions >= len("C a & b F") - 4 and r.visible >= 0 for r in rows)


def test_artifacts_seeds_and_sinks(spark, tmp_path):
    import json

    from lakeloom.sources import files, sinks

    for name, lines in (("a", 3), ("b", 0)):
        (tmp_path / f"{name}.jsonl").write_text("{}\n" * lines)
    got = files.scan_artifacts(spark, [str(tmp_path), str(tmp_path / "absent")]).collect()
    assert sorted(tuple(r) for r in got) == [("a.jsonl", 3, 9), ("b.jsonl", 0, 0)]
    for seed in (3, 11):
        (tmp_path / f"run_seed{seed}.json").write_text(json.dumps({"loss": seed / 2}, indent=1))
    assert sorted(tuple(r) for r in files.seed_results(spark, str(tmp_path), "run", "loss double").collect()) == [(1.5, 3), (5.5, 11)]
    steps = spark.createDataFrame([(s, "AB"[s > 4], 10) for s in range(10)], "step long, phase string, tokens long")
    sinks.write_schedule(steps, f"{tmp_path}/plan")
    assert {r.phase: (r.first, r.last, r.tokens) for r in spark.read.json(f"{tmp_path}/plan/index").collect()} == {"A": (0, 4, 50), "B": (5, 9, 50)}
    rows = spark.createDataFrame([(i, i // 2, "l", 1) for i in range(40)], "offset long, step long, lane string, loss long")
    whole = sinks.write_traces(rows, [(0, 5), (3, 19)], 6, f"{tmp_path}/trace").first()
    assert (whole.n, whole.loss) == (40, 40)
    assert Counter(r.k for r in spark.read.parquet(f"{tmp_path}/trace").collect()) == {0: 6, 1: 6}
    sinks.export_vocabulary(spark, [(1, "letter", "a"), (0, "byte", "x\ny")], f"{tmp_path}/vocabulary")
    assert [r.value for r in spark.read.text(f"{tmp_path}/vocabulary/text").collect()] == ["x\\ny", "a"]
    for step in (10, 20, 30, 40):
        stay = sinks.save_checkpoint(rows.filter(f"step < {step}"), step, f"{tmp_path}/run", keep=2, pinned=(10,))
    assert stay == [10, 30, 40] == sinks.list_checkpoints(spark, f"{tmp_path}/run")
    assert sinks.load_checkpoint(spark, f"{tmp_path}/run").count() == 40 and sinks.load_checkpoint(spark, f"{tmp_path}/run", 10).count() == 20
    rows.filter("step < 3").write.mode("append").parquet(f"{tmp_path}/run/step=30/state")
    with pytest.raises(sinks.ShardConflictError):
        sinks.load_checkpoint(spark, f"{tmp_path}/run", 30)
