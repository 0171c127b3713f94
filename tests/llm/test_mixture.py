import random
import struct

import xxhash
from docs import DOCUMENTS, saved
from lakeloom.llm import mixture as op


def slow(claims, caps, blocks):
    quotas = [0] * len(claims)
    for _ in range(min(blocks, sum(caps))):
        best = max((i for i in range(len(claims)) if quotas[i] < caps[i] and claims[i]), key=lambda i: (claims[i] / (2 * quotas[i] + 1), -i), default=None)
        if best is None:
            break
        quotas[best] += 1
    return quotas


def test_quotas_match_step_by_step():
    rng = random.Random(2)
    for _ in range(300):
        n = rng.randint(1, 9)
        claims = [float(rng.choice([0, 1, 2, 5, 5, 40, 300])) for _ in range(n)]
        caps = [rng.choice([0, 1, 3, 50, 1000]) for _ in range(n)]
        blocks = rng.randint(0, 200)
        usable = [c if q else 0 for c, q in zip(claims, caps, strict=True)]
        assert op.sainte_lague(usable, [c if u else 0 for c, u in zip(caps, usable, strict=True)], blocks) == slow(usable, [c if u else 0 for c, u in zip(caps, usable, strict=True)], blocks)


def test_targets_stop_at_the_cap():
    targets = op.water_fill([10, 1000, 0, 500], [5, 2, 1, 5])
    assert targets[0] == 30 and targets[2] == 0
    assert abs(sum(targets) - 1510) < 1e-6 and all(t <= 3 * s for t, s in zip(targets, [10, 1000, 0, 500], strict=True))
    assert abs(targets[1] / targets[3] - 2 / 5) < 1e-9


def rows(rng):
    out = []
    for i in range(1500):
        source = rng.choice([None, "a", "b", "b", "b", "b", "c", "tiny" if i < 3 else "d"])
        text = rng.choice([None, "", " \n", "w " * rng.randint(1, 60), "x"])
        out.append((i, text, "en", source, 0))
    return out


def test_query(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(op, "SHARD_WORDS", 500)
    data = rows(random.Random(4))
    folder = saved(spark.createDataFrame(data, DOCUMENTS), tmp_path)
    got = {r.doc_id: r for r in op.query(spark, folder).collect()}
    again = {r.doc_id: r for r in op.mix_sources(spark.createDataFrame(data, DOCUMENTS).repartition(7)).collect()}
    assert got == again and len(got) == len(data)
    sizes = {i: len((t or "").split()) for i, t, *_ in data}
    by = {}
    for i, _, _, s, _ in data:
        by.setdefault(s, []).append(i)
    names = sorted((s for s in by if s is not None)) + [None]
    want = op.water_fill([sum(sizes[i] for i in by[s]) for s in names], [op.WEIGHTS[k % 3] for k in range(len(names))])
    for s, target in zip(names, want, strict=True):
        taken = sum(got[i].taken for i in by[s])
        assert abs(taken - target) <= 1, (s, taken, target)
        for i in by[s]:
            assert got[i].size == sizes[i] and 0 <= got[i].taken <= 3 * sizes[i]
            assert abs(got[i].target - target) < 1e-6 and got[i].source_size == sum(sizes[j] for j in by[s])


def chain(*values):
    """Hash of a row of strings and longs, each value's hash seeding the next."""
    h = 42
    for v in values:
        if v is not None:
            h = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else struct.pack("<q", v), h)
    return h - (h >> 63 << 64)


def by_tree(words, sizes, level):
    """Words per shard number, dealt to the nodes of a level and then under each of them."""
    if level < 0:
        return dict.fromkeys(sizes, words)
    nodes = {}
    for shard, size in sizes.items():
        nodes.setdefault(shard // op.FAN**level, {})[shard] = size
    parts, out = [nodes[n] for n in sorted(nodes)], {}
    for part, given in zip(parts, op.deal_words(words, [sum(p.values()) for p in parts]), strict=True):
        out |= by_tree(given, part, level - 1)
    return out


def brute(data, keyed=False):
    """Words taken per row: words listed one by one, blocks of them in order of hash; with `keyed` doc_id is a row key too."""
    sizes = [len((t or "").split()) for _, t, *_ in data]
    names = sorted({s for *_, s, _ in data if s is not None}) + [None] * any(s is None for *_, s, _ in data)
    own = {s: [k for k, r in enumerate(data) if r[3] == s] for s in names}
    total = [sum(sizes[k] for k in own[s]) for s in names]
    targets = op.water_fill(total, [op.WEIGHTS[k % 3] for k in range(len(names))])
    quotas = slow(targets, [3 * t // 16 for t in total], sum(total) // 16)
    levels = next(n for n in range(1, 9) if op.FAN**n >= -(-max(total) // op.SHARD_WORDS))
    taken = [0] * len(data)
    for s, size, target, quota in zip(names, total, targets, quotas, strict=True):
        src = "n" if s is None else "s" + s
        count = max(1, -(-size // op.SHARD_WORDS))
        shards = {}
        for k in own[s]:
            text = data[k][1]
            draw = chain(op.SEED, data[k][0], None if text is None else chain(text), data[k][0] if keyed else None)
            shards.setdefault(draw % count, []).append((draw, data[k][0] if data[k][0] is not None else -1, sizes[k], k))
        numbers = sorted(shards)
        lists = [[k for *_, n, k in sorted(shards[h]) for _ in range(n)] for h in numbers]
        words = min(3 * size, quota * 16 + max(-15, min(15, round(target) - quota * 16)))
        quota_of = by_tree(words, {h: len(x) for h, x in zip(numbers, lists, strict=True)}, levels - 1)
        for h, listed in zip(numbers, lists, strict=True):
            given = quota_of[h]
            blocks = [listed[b : b + 16] for b in range(0, len(listed), 16)]
            order = sorted(range(len(blocks)), key=lambda b: (chain(op.SEED, src, h, b), b))
            seen = listed * (given // max(1, len(listed))) + [k for b in order for k in blocks[b]][: given % max(1, len(listed))]
            for k in seen:
                taken[k] += 1
    return [(i, n, t) for (i, *_), n, t in zip(data, sizes, taken, strict=True)]


def test_taken_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(op, "SHARD_WORDS", 300)
    monkeypatch.setattr(op, "FAN", 4)
    data = rows(random.Random(9)) + [(1, "other text", "en", "b", 0), (None, "one two", "en", "c", 0), (None, "three", "en", None, 0)]
    got = [(r.doc_id, r.size, r.taken) for r in op.mix_sources(spark.createDataFrame(data, DOCUMENTS).repartition(5)).collect()]
    key = lambda r: [(x is not None, x) for x in r]
    assert sorted(got, key=key) == sorted(brute(data), key=key)


def test_words_dealt_to_nodes():
    rng = random.Random(6)
    for _ in range(300):
        sizes = [rng.choice([0, 1, 3, 17, 400]) for _ in range(rng.randint(1, 12))]
        words = rng.randint(0, 3 * sum(sizes) + 5)
        out = op.deal_words(words, sizes)
        assert sum(out) == min(words, 3 * sum(sizes)) and all(0 <= w <= 3 * s for w, s in zip(out, sizes, strict=True))


def test_small_corpora(spark):
    for text, want in (("a b c d e f g", 7), ("x", 1), (None, 0), ("", 0)):
        df = spark.createDataFrame([(1, text, "en", "s", 0)], DOCUMENTS)
        assert [(r.size, r.taken) for r in op.mix_sources(df).collect()] == [(want, want)]
        assert op.mixed_documents(df).count() == (want > 0)


def test_documents_repeated_ids_and_clashing_columns(spark):
    df = spark.createDataFrame(rows(random.Random(8)), DOCUMENTS)
    out = op.mixed_documents(df)
    assert out.columns == df.columns and out.count() > 0
    assert op.mix_sources(df.limit(0)).count() == 0 and op.mixed_documents(df.limit(0)).count() == 0
    names = ["size", "target", "shard", "_id", "_copies", "_COPY", "_row", "row", "src", "taken", "end", "words", "_salt"]
    clash = df.selectExpr("*", *[f"'mine' as `{n}`" for n in names])
    assert op.mix_sources(clash).count() == 1500
    mixed = op.mixed_documents(clash)
    assert mixed.columns == clash.columns and {tuple(r)[5:] for r in mixed.collect()} == {("mine",) * len(names)}
    # two equal rows, two rows without an id, and one id with two texts: each in its own copies
    some = [(1, "a " * 60, "en", "s", 0), (1, "a " * 60, "en", "s", 0), (None, "b " * 60, "en", "s", 0), (None, "c " * 60, "en", "s", 0), (2, "d " * 60, "en", "s", 0), (2, "e " * 60, "en", "s", 0)]
    df = spark.createDataFrame(some, DOCUMENTS)
    assert sorted((r.doc_id or 0, r.text) for r in op.mixed_documents(df).collect()) == sorted((i or 0, t) for i, t, *_ in some)
    assert sum(r.taken for r in op.mix_sources(df).collect()) == 360
