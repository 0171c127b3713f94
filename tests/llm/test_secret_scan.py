import hashlib
import random
import re
import warnings

from docs import documents, saved
from lakeloom.llm import secret_scan as op

ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute(text):
    text = text or ""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return [f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(spans)]


def random_text(rng):
    parts = ["password", "PassWD", "secret", "ſecret", "toKen", "api_key", "APIKEY", '"', "'", " ", "  ", ":", "=", "AKIA", "deadbeef", "0123456789abcdef",
             "ABCDEFGHIJKLMN", "é", "🙂", "\n", "x", "ghp_" + "a" * 36, "xoxb-1234567890", "eyJhbGciOiJI.eyJzdWIiOiIx.SflKxwRJSMeK", "-----BEGIN RSA PRIVATE KEY-----"]
    return "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))


def test_base_spans_match_brute_force(spark, tmp_path):
    rng = random.Random(5)
    texts = [random_text(rng) for _ in range(1500)] + [None, "", "token=" + "a" * 100_000]
    got = {r.doc_id: r for r in op.query(spark, saved(documents(spark, texts), tmp_path)).collect()}
    kinds = {"assign", "access", "hex"}
    for i, text in enumerate(texts):
        want = brute(text)
        assert got[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        spans = [s for s in got[i].spans.split(",") if s]
        assert [s for s in spans if s.split(":")[0] in kinds] == want
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(s.startswith(k) for s in want) for k in ("assign", "access", "hex"))


def test_index_loses_no_match():
    rng = random.Random(6)
    texts = [random_text(rng) for _ in range(3000)]
    scanner = op.Scanner()
    found = scanner.scan(texts)
    for n, rule in enumerate(op.RULES):
        plain = [[(m.start(), m.end()) for m in re.finditer(rule.pattern, t, re.A) if m.end(rule.group) - m.start(rule.group) >= rule.least] for t in texts]
        assert plain == [[(a, b) for a, k, b in f if k == n] for f in found], rule.kind
        assert any(plain) or rule.kind in ("google", "stripe")


def test_queries_of_rules():
    queries = dict(zip((r.kind for r in op.RULES), op.Scanner().queries, strict=True))
    assert queries["hex"] is None
    assert queries["access"] == (frozenset({b"aki", b"kia"}),)
    assert frozenset({b"tok", b"oke", b"ken"}) in {frozenset(g for g in a if g.isalpha()) for a in queries["assign"]}
    assert op.trigram_query("ab?c") is None and op.trigram_query("(abc|x)y*") is None


def admits(query, text):
    return query is None or any(needed <= op.grams(op.folded(text)) for needed in query)


def test_known_losses_are_gone():
    assert admits(op.trigram_query("(?:ab|a|b){6}"), "zz bbbbbb zz")
    scanner = op.Scanner((op.Rule("greek", "ΑΒΣ"), op.Rule("kelvin", "(?u:(?i:key))x")))
    assert scanner.scan(["x ΑΒΣ y", "\u212aEYx", "αβς"]) == [[(2, 0, 5)], [(0, 1, 4)], []]


def random_rule(rng, depth=0):
    kind = rng.randrange(11 if depth < 3 else 4)
    if kind < 3:
        return "".join(rng.choice("abkKBé\u212aΣ_") for _ in range(rng.randint(1, 4)))
    if kind == 3:
        return rng.choice(["[ab]", "[a-c]", "[^a]", ".", "\\w", "[kK]", "\\b", "[A-Fa-f0-9]"])
    inner = random_rule(rng, depth + 1)
    if kind == 4:
        return f"(?:{inner}|{random_rule(rng, depth + 1)}|{random_rule(rng, depth + 1)})"
    if kind == 5:
        low = rng.randint(0, 6)
        return f"(?:{inner}){{{low},{low + rng.randint(0, 3)}}}"
    if kind == 6:
        return f"(?:{inner})" + rng.choice(["?", "*", "+", "*?", "+?", "{3}", "{2,}"])
    if kind == 7:
        return f"(?i:{inner})"
    if kind == 8:
        return f"({inner})" + rng.choice(["", "(?=a)", "(?!b)", "(?<=a)"])
    return inner + random_rule(rng, depth + 1)


def test_random_rules_lose_no_match():
    rng, found, asked = random.Random(17), 0, 0
    for _ in range(10_000):
        rule = random_rule(rng)
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            pattern = re.compile(rule, re.ASCII)
            query = op.trigram_query(rule)
        asked += query is not None
        for _ in range(4):
            text = "".join(rng.choice("aabbkKABcé\u212aΣς_ ") for _ in range(rng.randint(0, 18)))
            if pattern.search(text):
                found += 1
                assert admits(query, text), (rule, text)
    assert found > 3000 and asked > 2000


def test_postings_are_the_texts_own_trigrams(monkeypatch):
    monkeypatch.setattr(op, "BLOCK_BYTES", 64)
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcé \0") for _ in range(rng.choice([0, 1, 2, 3, 9, 400]))) for _ in range(300)]
    asked = set(op.grams("abcab cabéa".encode())) | {b"aaa"}
    index = op.TrigramIndex(asked)
    postings = index.postings(texts)
    for g in asked:
        assert index.rows((frozenset({g}),), postings) == [i for i, t in enumerate(texts) if g in t.encode()]


def test_empty_repeated_and_clashing(spark):
    assert op.secret_scan(documents(spark, [])).count() == 0
    rows = [(1, "token=" + "a" * 12), (1, "token=" + "a" * 12), (None, "AKIA" + "B" * 16), (None, None), (1, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'mine' as spans", "'mine' as n_hex", "'mine' as _text")
    got = sorted((r.doc_id or 0, r.n_assign, r.n_access, r.spans) for r in op.secret_scan(df).collect())
    assert got == [(0, 0, 0, ""), (0, 0, 1, "access:0:20"), (1, 0, 0, ""), (1, 1, 0, "assign:0:18"), (1, 1, 0, "assign:0:18")]
