import hashlib
import random

import pytest
from docs import documents, saved
from lakeloom.llm import bpe
from tokenizers import Tokenizer


@pytest.fixture(scope="module")
def pair():
    path = bpe.default_path()
    return bpe.tokenizer(path), Tokenizer.from_file(path)


def same(pair, text):
    mine, library = pair
    ids = library.encode(text, add_special_tokens=False).ids
    assert mine.encode(text).tolist() == ids, text[:80]
    assert mine.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_random_words_and_marks(pair):
    rng = random.Random(7)
    for alphabet in ("abeinst", "abcdeé ßÉÀİΣς'sre</w>0123日本́ \t\n\x1c\x85🙂ſK"):
        for _ in range(3000):
            same(pair, "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 50))))


def test_every_low_code_point_and_specials(pair):
    for cp in range(0x400):
        same(pair, f"a{chr(cp)}b1{chr(cp)} '{chr(cp)}")
    same(pair, "x<|startoftext|> y<|endoftext|><|endoftext|>z")


def test_long_word_is_linear(pair):
    same(pair, "the" * 30_000)
    same(pair, "a" * 30_000)


def test_query_matches_library(spark, tmp_path, pair):
    texts = ["Hello, World's end", None, "", " \n", "é" * 50, "Hello, World's end", "x" * 5000]
    df = documents(spark, texts)
    got = {r.doc_id: r for r in bpe.query(spark, saved(df, tmp_path)).collect()}
    for i, text in enumerate(texts):
        ids = pair[1].encode(text or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(pair[1].decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_encode_then_decode_documents(spark, pair):
    df = documents(spark, ["one two", None, ""]).withColumnRenamed("doc_id", "ids")
    coded = bpe.encode_documents(df.withColumnRenamed("ids", "doc_id"))
    back = {r.doc_id: r.text for r in bpe.decode_documents(coded).collect()}
    assert back == {0: "one</w> two</w>", 1: "", 2: ""}
    assert bpe.encode_documents(documents(spark, [])).count() == 0


def test_repeated_rows_null_ids_and_clashing_columns(spark):
    names = ["_text", "ids", "n_tokens", "DECODED_SHA256"]
    rows = [(1, "one two"), (1, "one two"), (1, "three"), (None, "one two"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", *[f"'mine' as `{n}`" for n in names])
    got = sorted((r.doc_id or 0, r.n_tokens, r.utf8_bytes) for r in bpe.bpe_digests(df).collect())
    assert got == [(0, 0, 0), (0, 2, 7), (1, 1, 5), (1, 2, 7), (1, 2, 7)]


def test_small_caches_and_gathers_give_the_same(pair, monkeypatch):
    for name in ("CACHE_WORDS", "TABLE_PAIRS", "GATHER"):
        monkeypatch.setattr(bpe, name, 3)
    rng = random.Random(8)
    same(pair, " ".join("".join(rng.choice("abeinsté") for _ in range(rng.randint(1, 9))) for _ in range(500)))


def test_changed_offsets_change_what_is_decoded(pair):
    ids = pair[0].encode("some words")
    table = pair[0]._strings
    kept = table.offsets.copy()
    try:
        table.offsets[ids[0] + 1] -= 2
        assert pair[0].decode(ids) != pair[1].decode(ids.tolist(), skip_special_tokens=False)
    finally:
        table.offsets[:] = kept
