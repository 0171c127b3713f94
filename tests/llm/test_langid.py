import random
import zlib

import numpy as np
from docs import DOCUMENTS, saved
from lakeloom.llm import langid as op

SYLLABLES = {"aa": ["the", "ing", "and", "th", "er"], "bb": ["der", "sch", "ung", "ich", "ei"], "cc": ["ción", "que", "ado", "ñ", "os"]}


def rows(n=600):
    rng = random.Random(1)
    out = []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        text = " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(3, 120)))
        out.append((i, text, lang if i % 10 else None, "s", 0))
    return out


def test_held_out_accuracy_and_contract(spark, tmp_path):
    data = rows()
    long_text = " ".join(t for _, t, lang, *_ in data if lang == "aa") * 5
    data += [(900, None, "aa", "s", 0), (901, "", None, "s", 0), (902, "123 !?", "bb", "s", 0), (903, long_text, None, "s", 0)]
    folder = saved(spark.createDataFrame(data, DOCUMENTS), tmp_path)
    got = {r.doc_id: r for r in op.query(spark, folder).collect()}
    assert len(got) == len(data)
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1
    assert [got[i].lang_pred for i in (900, 901, 902, 903)] == ["und", "und", "und", "aa"]
    labelled = [(i, lang) for i, _, lang, *_ in data[:600] if lang and got[i].held_out]
    assert np.mean([got[i].lang_pred == lang for i, lang in labelled]) >= 0.97


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    net = op.ByteConvNet(["a", "b", "c"], 1)
    net.params = {k: v.astype(np.float64) for k, v in net.params.items()}
    x, y = rng.integers(0, 256, (5, 24), dtype=np.uint8), np.array([0, 1, 2, 1, 0])

    def loss():
        return -np.log(net.probabilities(x)[np.arange(5), y]).mean()

    for k, g in net._gradients(x, y).items():
        flat = np.abs(g).ravel().argmax()
        at = np.unravel_index(flat, g.shape)
        net.params[k][at] += 1e-6
        up = loss()
        net.params[k][at] -= 2e-6
        down = loss()
        net.params[k][at] += 1e-6
        assert abs((up - down) / 2e-6 - g[at]) < 1e-4, k


def plain_probabilities(net, window):
    """The forward pass written as loops over filters, positions and bytes."""
    p = {k: v.tolist() for k, v in net.params.items()}
    hidden = []
    for w in op.WIDTHS:
        for f in range(op.FILTERS):
            best = max(
                sum(p["embed"][window[at + j]][e] * p[f"conv{w}"][j * op.EMBED + e][f] for j in range(w) for e in range(op.EMBED))
                for at in range(len(window) - w + 1)
            )
            hidden.append(max(0.0, best + p[f"bias{w}"][f]))
    z = [sum(h * p["out"][i][c] for i, h in enumerate(hidden)) + p["out_bias"][c] for c in range(len(net.classes))]
    e = [np.exp(x - max(z)) for x in z]
    return [x / sum(e) for x in e]


def test_predictions_match_plain_loops():
    net, rng = op.ByteConvNet(["a", "b", "c"], 4), np.random.default_rng(1)
    texts = ["ab", "été " * 9, "x" * 192, "lorem ipsum " * 40]
    for text, (lang, score) in zip(texts, net.predict_texts(texts), strict=True):
        total, weight = np.zeros(3), 0
        for window in op.windows(text.encode()).tolist():
            used = sum(b > 0 for b in window)
            total += used * np.array(plain_probabilities(net, window))
            weight += used
        share = total / weight
        assert lang == net.classes[int(share.argmax())] and abs(score - share.max()) < 1e-5
    x = rng.integers(1, 256, (6, op.WINDOW), dtype=np.uint8)
    assert np.allclose(net.probabilities(x), [plain_probabilities(net, w) for w in x.tolist()], atol=1e-5)


def test_rare_languages_are_learned_and_samples_bounded(spark):
    data = [(i, "the and " * 9, "aa", "s", 0) for i in range(400)] + [(500 + i, "ción que " * 9, "cc", "s", 0) for i in range(8)]
    data += [(7, "the and " * 9, "aa", "s", 0)] * 30
    df = spark.createDataFrame(data, DOCUMENTS)
    assert op.train(df, rows=12).classes == ["aa", "cc"]


def test_repeated_null_and_clashing(spark):
    names = ["lang_pred", "SCORE", "_text", "_k0", "_pred", "held_out"]
    rows = [(1, "abc def"), (1, "abc def"), (None, "abc"), (None, None), (2, "..")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' as lang", *[f"'mine' as `{n}`" for n in names])
    net = op.train(df)
    got = sorted((r.doc_id or 0, r.lang_pred) for r in op.identify(df, net).collect())
    assert got == [(0, "en"), (0, "und"), (1, "en"), (1, "en"), (2, "und")]
    kept = op.recognised(df)
    assert kept.columns == df.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 1]
    assert op.recognised(df.limit(0)).count() == 0


def test_windows_cover_and_empty_tables(spark):
    data = bytes(range(1, 201)) * 3
    w = op.windows(data)
    assert w[:-1].tobytes() + data[-(len(data) % op.WINDOW) :] == data
    assert w[-1].tobytes() == data[-op.WINDOW :]
    df = spark.createDataFrame([], DOCUMENTS)
    assert op.identify(df, op.train(df)).count() == 0
    unlabelled = spark.createDataFrame([(1, "abc", None, None, 3)], DOCUMENTS)
    assert op.identify(unlabelled, op.train(unlabelled)).first().lang_pred == "und"
