import glob
import gzip
import hashlib
import random
import zlib

import duckdb
import pytest
from docs import saved
from lakeloom.llm import warc as op

SCHEMA = "page_id long, url string, html string"


def rows(n=300):
    rng = random.Random(9)
    big = ["a" * 1000, "é" * 500, "é" * 499, "b" * 5000]
    return [
        (i, rng.choice([f"http://www.ex{i % 7}.example.com/p/{i}?q=1#x", None, "", "::::", "HTTPS://Ex.org:8080/A\tb", "same.org"]), rng.choice([*big, None, "", "x", f"<p>{i}"]))
        for i in range(n)
    ]


def test_round_trip_matches_sql(spark, tmp_path):
    data = rows()
    folder = saved(spark.createDataFrame(data, SCHEMA).repartition(3), tmp_path, "pages")
    got = sorted(tuple(r) for r in op.query(spark, folder).collect())
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{folder}/pages.parquet/*.parquet'")
    assert got == sorted(con.execute(op.ORACLE_SQL).fetchall())
    assert {r[3] for r in got} == {"response", "revisit"}


def test_lookup_goes_through_both_levels(spark, tmp_path):
    data = rows(120)
    archive = op.Archive.write(spark.createDataFrame(data, SCHEMA), f"{tmp_path}/a", 3000, 7, 3)
    top = archive.top()
    assert 120 / 21 <= len(top) <= 120 / 21 + 8 and top == sorted(top)
    assert archive.missing().count() == 0
    for url in ("same.org", "http://ex3.example.com/p/3?q=1", "http://nowhere.example/", ""):
        want = sorted(i for i, u, _ in data if op.url_key(u) == op.url_key(url))
        found = archive.lookup(url)
        assert sorted(int(r["x-page-id"]) for r in found) == want
        for r in found:
            if r["warc-type"] == "response":
                assert r["payload"] == (data[int(r["x-page-id"])][2] or "").encode()


def members(path):
    data = open(path, "rb").read()
    while data:
        d = zlib.decompressobj(31)
        yield op.parse_record(d.decompress(data))
        data = d.unused_data


def test_files_are_plain_warc_with_unique_ids(spark, tmp_path):
    data = rows(90)
    op.Archive.write(spark.createDataFrame(data, SCHEMA).repartition(2), f"{tmp_path}/a", 3000)
    ids, kinds = [], []
    for path in glob.glob(f"{tmp_path}/a/records/*.warc.gz"):
        found = list(members(path))
        assert found[0]["warc-type"] == "warcinfo" and found[0]["warc-filename"] == path.rsplit("/", 1)[1]
        ids += [r["warc-record-id"] for r in found]
        kinds += [r["warc-type"] for r in found[1:]]
        for r in found[1:]:
            if r["warc-type"] == "revisit":
                assert r["warc-refers-to-target-uri"] == op._one_line(data[int(r["x-refers-to-page-id"])][1] or "")
    assert len(kinds) == 90 and len(set(ids)) == len(ids)


def test_result_comes_from_the_index(spark, tmp_path):
    pages = spark.createDataFrame(rows(60), SCHEMA)
    archive = op.Archive.write(pages, f"{tmp_path}/a", 3000, 7, 3)
    whole = sorted(map(str, archive.captures(pages).collect()))
    assert len(whole) == 60
    first = archive.top()[0]
    block = op.CaptureIndex(f"{archive.path}/index", [])._read_page(first[1:])[0][1]
    path = f"{tmp_path}/a/index/{block[0]}"
    data = open(path, "rb").read()
    lines = zlib.decompress(data[block[1] : block[1] + block[2]]).split(b"\n")

    def with_block(lines):
        made = zlib.compress(b"\n".join(lines), 9)
        with open(path, "wb") as f:
            f.write(data[: block[1]] + made.ljust(block[2], b"\0") + data[block[1] + block[2] :])

    # a line that points to another record gives that record; one that is gone is an error
    with_block([lines[0].split(b"\t")[0] + b"\t" + lines[1].split(b"\t", 1)[1], *lines[1:]])
    assert sorted(map(str, archive.captures(pages).collect())) != whole
    with_block(lines[1:])
    with pytest.raises(Exception, match="no capture"):
        archive.captures(pages).collect()


def test_bit_set_collisions_change_nothing(spark, monkeypatch, tmp_path):
    from lakeloom.llm import common

    pages = spark.createDataFrame(rows(200), SCHEMA)
    want = sorted(map(str, op.warc_round_trip(pages, f"{tmp_path}/a").drop("url").collect()))
    monkeypatch.setattr(common, "FILTER_BITS", 64)
    assert sorted(map(str, op.warc_round_trip(pages, f"{tmp_path}/b").drop("url").collect())) == want


def test_records_and_keys():
    digest = hashlib.sha1(b"<p>").hexdigest()
    record = op.parse_record(gzip.decompress(op.record_member("f:0", "2024-01-01T00:00:00Z", 3, "http://a/\r\nX: y", b"<p>", digest, 3)))
    assert record["payload"] == b"<p>" and "x" not in record
    assert op.url_key("https://www.A.example.com:443/B?c#d") == "com,example,a)/b?c"
    assert op.url_key("a.org") < op.url_key("b.a.org") < op.url_key("b.org")


def test_empty_nulls_and_repeats(spark, tmp_path):
    df = spark.createDataFrame([], SCHEMA)
    assert op.warc_round_trip(df).count() == 0
    data = [(1, "u", "z" * 2000), (1, "u", "z" * 2000), (None, None, "z" * 2000), (5, "v", "z" * 2000)]
    got = op.warc_round_trip(spark.createDataFrame(data, SCHEMA).selectExpr("*", "1 as digest", "2 as top", "3 as file", "4 as KEY", "5 as own"))
    assert sorted((r.page_id or 0, r.record_type, r.refers_to) for r in got.collect()) == [(0, "response", None), (1, "revisit", 5), (1, "revisit", 5), (5, "response", None)]


def test_repeated_page_ids_keep_their_payloads(spark, tmp_path):
    a, b, c = "a" * 1500, "b" * 1500, "c" * 1500
    data = [(1, "u", a), (1, "u", b), (2, "v", a), (2, "w", c), (None, "n", c), (None, "n", b), (3, None, None), (3, None, "")]
    df = spark.createDataFrame(data, SCHEMA)
    archive = op.Archive.write(df, f"{tmp_path}/a")
    got = sorted(((r.page_id or 0), r.payload_digest, r.record_type, r.refers_to or 0) for r in archive.captures(df).collect())
    sha = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    assert got == sorted([
        (1, sha(a), "revisit", 2), (1, sha(b), "response", 0), (2, sha(a), "response", 0), (2, sha(c), "response", 0),
        (0, sha(c), "response", 0), (0, sha(b), "response", 0), (3, sha(""), "response", 0), (3, sha(""), "response", 0),
    ])
    stored = {r["payload"] for path in glob.glob(f"{tmp_path}/a/records/*") for r in members(path) if r["warc-type"] == "response"}
    assert {x.encode() for x in (a, b, c)} <= stored
