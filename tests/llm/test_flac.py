import hashlib
import random
import zlib

import numpy as np
import pytest
from docs import documents, saved
from lakeloom.llm import flac as op


def payloads():
    rng = np.random.default_rng(0)
    found = [rng.integers(0, 256, int(rng.integers(1, 3000)), dtype=np.uint8).tobytes() for _ in range(30)]
    found += [bytes(rng.integers(100, 104, 1152, dtype=np.uint8)), b"\0" * 5000, b"\xff" * 577, b"ab" * 96]
    found.append((np.sin(np.arange(6000) / 9) * 100 + 128).astype(np.uint8).tobytes())
    found += [op.payload_of("the quick brown fox " * k) for k in (0, 1, 30, 200)]
    return found


def as_bytes(x):
    return (x[0] + 128).astype(np.uint8).tobytes()


def test_round_trip_in_lanes_and_by_the_plain_reader():
    made = payloads()
    medias = op.encode(made)
    assert [as_bytes(x) for x in op.decode(medias)] == made
    for m, p in zip(medias, made, strict=True):
        assert as_bytes(op._decode_unindexed(op.Stream(m))) == p
    assert op.encode(made[5:6]) == medias[5:6]  # a stream does not depend on its neighbours
    kinds = {op.Stream(m).data[op.Stream(m).header(op.Stream(m).first)[3]] >> 1 for m in medias}
    assert {0, 1} <= kinds and any(8 <= k <= 12 for k in kinds) and any(k >= 32 for k in kinds)


def test_seeking():
    made = payloads()
    medias = op.encode(made)
    rng = random.Random(1)
    for _ in range(20):
        spans = []
        for p in made:
            a = rng.randrange(len(p))
            spans.append((a, rng.randint(a + 1, len(p))))
        assert [as_bytes(x) for x in op.read_samples(medias, spans)] == [p[a:z] for p, (a, z) in zip(made, spans, strict=True)]


def test_broken_streams_are_found():
    media = op.encode([op.payload_of("some words that are stored " * 40)])[0]
    first = op.Stream(media).first
    rng = random.Random(2)
    for _ in range(60):
        at = rng.randrange(first, len(media))
        broken = bytearray(media)
        broken[at] ^= 1 << rng.randrange(8)
        with pytest.raises(op.FlacError):
            op.decode([bytes(broken)])
    with pytest.raises(op.FlacError):
        op.decode([media[: len(media) - 5]])


def bits_of(*fields):
    text = "".join(f"{v & (1 << n) - 1:0{n}b}" if n else "" for v, n in fields)
    return int(text.ljust(-(-len(text) // 8) * 8, "0"), 2).to_bytes(-(-len(text) // 8), "big")


def test_stereo_escape_and_wasted_bits_by_hand():
    # mid/side frame of two samples, 16 bits: mid verbatim with one wasted bit, side in an escaped partition
    mid, side = [10, -6], [3, -5]
    body = bits_of((0, 1), (1, 6), (1, 1), (1, 1), *((v >> 1, 15) for v in mid), (0, 1), (8, 6), (0, 1), (0, 2), (0, 4), (15, 4), (6, 5), *((v, 6) for v in side))
    x, size = op._plain_frame(body, 2, 10, 16)
    assert size == len(body)
    assert x.tolist() == [[((m << 1 | s & 1) + s) >> 1 for m, s in zip(mid, side)], [((m << 1 | s & 1) - s) >> 1 for m, s in zip(mid, side)]]


def test_query_blocks_and_empty(spark, tmp_path):
    texts = ["a b c", None, "", "é🙂" * 3000, "a b c", "x" * 192, "y" * 193]
    df = documents(spark, texts)
    got = {r.doc_id: r for r in op.query(spark, saved(df, tmp_path)).collect()}
    for i, t in enumerate(texts):
        p = op.payload_of(t)
        r = got[i]
        assert len(p) % 192 == 0 and p.rstrip(b" ") == (t or "").encode()
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
    assert got[0][1:] == got[4][1:] and got[1][1:] == got[2][1:]
    blocks = op.pcm_blocks(op.store_media(df)).collect()
    for r in blocks:
        assert [b.sample_offset for b in r.blocks] == list(range(0, len(op.payload_of(texts[r.doc_id])), op.BLOCK))
        assert bytes(np.frombuffer(b"".join(bytes(b.pcm) for b in r.blocks), np.uint8) ^ 0x80) == op.payload_of(texts[r.doc_id])
    assert op.media_digests(documents(spark, [])).count() == 0


def test_stream_of_another_encoder():
    # the one-sample stereo stream of RFC 9639, appendix D.1
    media = bytes.fromhex(
        "664c614380000022100010000000" "0f00000f0ac442f0000000013e84b41807dc690307586a3dad1a2e0f" "fff869180000bf0358fd03128baa9a"
    )
    stream = op.Stream(media)
    assert (stream.rate, stream.channels, stream.bits, stream.samples, stream.indexed) == (44100, 2, 16, 1, False)
    assert op.decode([media])[0].tolist() == [[25588], [10416]]
    with pytest.raises(op.FlacError):
        op.decode([media[:-3] + b"\0" + media[-2:]])


def test_stored_column_repeated_null_and_clashing(spark):
    rows = [(1, "abc"), (1, "abc"), (None, "abc"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'mine' as media", "'mine' as n_bytes", "'mine' as _text")
    got = sorted((r.doc_id or 0, r.n_bytes, r.payload_bytes) for r in op.media_digests(df).collect())
    assert got == [(0, 0, 192), (0, 3, 192), (1, 3, 192), (1, 3, 192)]
    stored = op.store_media(df.limit(1)).selectExpr("doc_id", "n_bytes", "cast(null as binary) as media")
    assert op.described(stored).first().media_bytes is None
