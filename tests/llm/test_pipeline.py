import hashlib
import random
from collections import Counter

import corpus_pipeline
import numpy as np
from docs import DOCUMENTS, saved
from lakeloom.llm import bpe, common, exact_dedup, langid, mixture, near_dup
from test_langid import SYLLABLES
from test_mixture import brute as brute_mix
from test_near_dup import brute as brute_near
from tokenizers import Tokenizer


def rows():
    rng = random.Random(6)
    out = []
    for i in range(260):
        lang = rng.choice(list(SYLLABLES))
        text = " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(20, 90)))
        if i % 9 == 1:
            text = out[-1][1] + " "
        if i % 11 == 2:
            text = out[-1][1] + " tail"
        out.append((i, text, lang, f"s{i % 4}", len(text)))
    return out + [(900, None, None, None, None), (901, "", "aa", "s1", 0), (902, "12 34", None, "s2", 5)]


def recognised(net, text):
    """Whether the network is sure of the language: every window and position one by one."""
    if not any(c.isalpha() for c in text or ""):
        return False
    p, data, total, weight = net.params, text.encode(), 0, 0
    starts = list(range(0, len(data) - langid.WINDOW + 1, langid.WINDOW)) or [0]
    if len(data) > langid.WINDOW and len(data) % langid.WINDOW:
        starts.append(len(data) - langid.WINDOW)
    for start in starts:
        window = data[start : start + langid.WINDOW].ljust(langid.WINDOW, b"\0")
        x = [p["embed"][b] for b in window]
        hidden = []
        for w in langid.WIDTHS:
            each = [np.concatenate(x[at : at + w]) @ p[f"conv{w}"] for at in range(len(x) - w + 1)]
            hidden.append(np.maximum(np.max(each, axis=0) + p[f"bias{w}"], 0))
        z = np.exp((z := np.concatenate(hidden) @ p["out"] + p["out_bias"]) - z.max())
        used = sum(b > 0 for b in window)
        total, weight = total + used * z / z.sum(), weight + used
    return (total / weight).max() >= langid.MIN_SCORE


def taken_of(docs):
    """What the mix takes from each row, as its stage keys rows."""
    return mixture.mix_sources(common.row_keyed(docs, "_row"), row_col="_row").collect()


def brute(kept):
    """The dedup stages by plain loops."""
    groups = {}
    for r in kept:
        groups.setdefault("".join(c for c in r[1] if c not in exact_dedup.WHITE), []).append((-len(r[1]), r[0], r))
    kept = sorted(min(g)[2] for g in groups.values())
    near = brute_near([r[1] for r in kept])
    return [kept[i] for i in sorted({g for _, _, g in near.values()})]


def test_stages_and_run_match_brute_force(spark, tmp_path):
    data = rows()
    folder = saved(spark.createDataFrame(data, DOCUMENTS), tmp_path)
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        path = f"{tmp_path}/{name}"
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        seen[name] = docs
        assert name == "bpe" or docs.columns == DOCUMENTS.fieldNames()
    first = {r.doc_id for r in seen["language_id"].collect()}
    assert not first & {900, 901, 902} and len(first) >= 255
    net = langid.train(spark.read.parquet(f"{folder}/documents.parquet"))
    assert first == {r[0] for r in data if recognised(net, r[1])}
    want = brute([r for r in data if r[0] in first])
    assert sorted(r.doc_id for r in seen["near_dup"].collect()) == sorted(r[0] for r in want)
    copies = Counter(r.doc_id for r in seen["mix_sources"].collect())
    assert copies == +Counter({i: int(taken / size + 0.5) for i, size, taken in brute_mix(want, keyed=True)})
    library, texts = Tokenizer.from_file(bpe.default_path()), {r[0]: r[1] for r in data}
    for r in seen["bpe"].collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert sorted(map(tuple, corpus_pipeline.run(spark, folder).collect())) == sorted(map(tuple, seen["bpe"].collect()))


def test_empty_table(spark, tmp_path):
    folder = saved(spark.createDataFrame([], DOCUMENTS), tmp_path)
    assert corpus_pipeline.run(spark, folder).count() == 0
    assert langid.MIN_SCORE < 1 and near_dup.THRESHOLD == 0.8


def test_null_and_repeated_ids(spark, tmp_path):
    data = [r for r in rows() if r[0] < 120]
    # a tenth without doc_id, another tenth with the doc_id of a row of another text, some rows three times
    data = [(None if r[0] % 10 == 3 else r[0] - 1 if r[0] % 10 == 5 else r[0], *r[1:]) for r in data]
    data += [r for r in data[::15] for _ in range(2)]
    folder = saved(spark.createDataFrame(data, DOCUMENTS).repartition(3), tmp_path)
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        path = f"{tmp_path}/{name}"
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        seen[name] = docs

    def order(r):
        return r[0] is None, r[0] or 0, hashlib.sha256(r[1].encode()).hexdigest()

    groups = {}
    for r in seen["language_id"].collect():
        groups.setdefault("".join(c for c in r[1] if c not in exact_dedup.WHITE), []).append((-len(r[1]), order(r), tuple(r)))
    kept = sorted((min(g)[2] for g in groups.values()), key=order)
    assert Counter(map(tuple, seen["exact_dedup"].collect())) == Counter(kept)
    near = brute_near([r[1] for r in kept])
    want = [kept[i] for i in sorted({g for _, _, g in near.values()})]
    assert Counter(map(tuple, seen["near_dup"].collect())) == Counter(want)
    assert sum(r[0] is None for r in want) > 5 and max(Counter(r[0] for r in want if r[0] is not None).values()) > 1
    copies = Counter()
    for r in taken_of(seen["near_dup"]):
        copies[r.doc_id, r.size] += int(r.taken / r.size + 0.5)
    mixed = [tuple(r) for r in seen["mix_sources"].collect()]
    assert Counter((r[0], len(r[1].split())) for r in mixed) == +copies and set(mixed) <= set(want)
    assert any(r[0] is None for r in mixed)
    tokenizer = bpe.tokenizer()
    digests = Counter(hashlib.sha256(" ".join(map(str, tokenizer.encode(r[1]))).encode()).hexdigest() for r in mixed)
    assert Counter(r.ids_sha256 for r in corpus_pipeline.run(spark, folder).collect()) == digests
