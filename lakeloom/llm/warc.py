"""WARC archives with a two-level capture index.

Pages become WARC/1.1 records, each a gzip member of its own, in files of a few megabytes in the
shared folder. The capture index sorts lines "reversed-host key and page, file, offset, length" into
compressed blocks; index files hold blocks and, after them, pages of a sparse directory with each
block's first key; a second, sparser level has one entry a directory page. A search bisects the
upper level, a directory page and a block, and then reads byte ranges of the record files. Files are
reached through pyarrow's file systems (local or mounted folders, hdfs, s3, gs).
"""

from __future__ import annotations

import base64
import bisect
import datetime
import functools
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from functools import partial
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dealt_join, in_bit_set, new_path, written

NAME = "op9_warc_capture_index"

#: Payloads of at least so many bytes are stored once; equal ones become revisit records.
REVISIT_BYTES = 1000
#: A record file is closed when it has reached this size.
SEGMENT_BYTES = 4 << 20
#: Lines of a block of the capture index, and blocks of a directory page: one entry of the upper level.
BLOCK_LINES, PAGE_BLOCKS = 1000, 1000
#: Neighbouring records are read at once up to this size.
READ_BYTES = 1 << 20

ORACLE_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), m AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS top FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < top THEN top END AS refers_to
FROM m
"""


def url_key(url: str | None) -> str:
    """The sort key of a URL: its host's labels reversed, then path and query, lower-cased.

    Scheme, user, default port, a leading www label and the fragment do not count. Null, empty and
    malformed URLs keep a key of their own text.
    """
    url = (url or "").strip()
    try:
        parts = urlsplit(url if "://" in url else f"http://{url}")
        host, port = (parts.hostname or "").rstrip("."), parts.port
    except ValueError:
        return "~)" + url.lower()
    labels = host.split(".")
    if len(labels) > 2 and labels[0] == "www":
        labels = labels[1:]
    shown = ",".join(reversed(labels)) + (f":{port}" if port not in (None, 80, 443) else "")
    tail = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return f"{shown}){tail}".lower()


def _one_line(text: str) -> str:
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in text)


def _one_line(text: str) -> str:
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in text)


def capture_key(url: str | None, page_id: int | None) -> str:
    """What index lines are sorted by: the URL's key without spaces and controls, a space, the page."""
    key = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url_key(url))
    return f"{key} {'' if page_id is None else page_id}"


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _member(head: list[tuple[str, object]], body: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{name}: {value}" for name, value in head), f"WARC-Block-Digest: {_sha1(body)}", f"Content-Length: {len(body)}"]
    return gzip.compress("\r\n".join(lines).encode("utf-8") + b"\r\n\r\n" + body + b"\r\n\r\n", 3, mtime=0)


def info_member(name: str, date: str) -> bytes:
    """The warcinfo record that starts a file."""
    head = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"), ("WARC-Date", date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")]
    return _member(head, b"software: lakeloom\r\nformat: WARC File Format 1.1\r\n")


def record_member(
    place: str, date: str, page_id: int | None, url: str | None, payload: bytes | None, digest: str, size: int,
    refers_to: int | None = None, refers_url: str | None = None,
) -> bytes:
    """One record; a revisit has no payload and says whose payload it shares, and its length. `place` makes its id unique."""
    revisit = payload is None
    head = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, place)}>"), ("WARC-Date", date),
        ("WARC-Target-URI", _one_line(url or "")), ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()),
        ("Content-Type", "application/http; msgtype=response"), ("X-Page-Id", "" if page_id is None else page_id), ("X-Payload-Length", size),
    ]
    if revisit:
        head += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To-Target-URI", _one_line(refers_url or "")), ("WARC-Refers-To-Date", date), ("X-Refers-To-Page-Id", refers_to),
        ]
    return _member(head, b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (payload or b""))


def parse_record(data: bytes) -> dict[str, object]:
    """Headers (lower-cased names), and the payload behind the HTTP head; lengths and digests are verified."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields: dict[str, object] = {}
    for line in lines[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    body = rest[: int(fields["content-length"])]
    if rest[int(fields["content-length"]) :] != b"\r\n\r\n":
        raise ValueError("record ends early")
    if fields["warc-block-digest"] != _sha1(body):
        raise ValueError(f"block digest of {fields['warc-record-id']} does not match")
    fields["payload"] = body.partition(b"\r\n\r\n")[2]
    if fields["warc-type"] == "response" and fields["warc-payload-digest"] != _sha1(fields["payload"]):
        raise ValueError(f"payload digest of {fields['warc-record-id']} does not match")
    return fields


def _file_system(folder: str):
    """pyarrow's file system of a folder, and the folder's path in it."""
    from pyarrow import fs

    if ":" not in folder.split("/", 1)[0]:
        return fs.LocalFileSystem(), folder
    folder = re.sub(r"^s3[an]://", "s3://", re.sub(r"^file:/+", "file:///", folder))
    return fs.FileSystem.from_uri(folder)


def with_referrals(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, digest, payload_bytes, refers_to, refers_url) per row of pages; html is null in revisits.

    refers_to is the largest page_id of equal long payloads, for the others. Rows are told apart by
    page_id and payload together. No payload is shuffled but of rows that a bit set of fixed size
    takes for revisits wrongly; those few (all, if the set is full) meet the exact list of them.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    keyed = keyed.withColumns({"digest": F.sha1(F.encode("html", "UTF-8")), "payload_bytes": F.octet_length("html").cast("long")})
    # Without a page_id the key has a part less; digests have 40 digits, so that keys cannot meet by chance.
    keyed = keyed.withColumn("content", F.concat_ws(":", "digest", "payload_bytes")).withColumn("own", F.xxhash64(F.concat_ws(":", "page_id", "content")))
    facts = written(keyed.select("page_id", "url", "digest", "payload_bytes", "content", "own"), "page-facts")
    long = facts.filter(F.col("payload_bytes") >= REVISIT_BYTES)
    # Digests are counted before anything is joined: a payload of any number of copies is one row a task.
    shared = written(
        long.groupBy("content").agg(F.max(F.struct("page_id", "url")).alias("top"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "shared-payloads"
    )
    met = dealt_join(long, shared.select("content", F.col("top.page_id").alias("refers_to"), F.col("top.url").alias("refers_url")), "content", "own", shared.select("content", "n"), facts.count())
    revisits = written(met.filter("page_id < refers_to"), "revisits")
    # Responses that the bit set takes for revisits: told by the same 64-bit key and then by all that makes it.
    same = ["own", "content", "page_id"]
    known = revisits.select(*(F.col(c).alias(f"r_{c}") for c in same)).distinct()
    match = (F.col("own") == F.col("r_own")) & (F.col("content") == F.col("r_content")) & F.col("page_id").eqNullSafe(F.col("r_page_id"))
    wrong = written(in_bit_set(facts, revisits, "own").filter("in_set").select(*same).distinct().join(known, match, "left_anti"), "not-revisits")
    out = ["page_id", "url", "html", "digest", "payload_bytes", "refers_to", "refers_url"]
    none = [F.lit(None).cast("long").alias("refers_to"), F.lit(None).cast("string").alias("refers_url")]
    plain = in_bit_set(keyed, revisits, "own").filter(~F.col("in_set")).select(*out[:5], *none)
    found = plain.unionByName(revisits.withColumn("html", F.lit(None).cast("string")).select(*out))
    if wrong.isEmpty():
        return found
    listed = wrong.select(*(F.col(c).alias(f"r_{c}") for c in same))
    again = in_bit_set(keyed, wrong, "own").filter("in_set").join(listed.hint("merge"), match, "left_semi")
    return found.unionByName(again.select(*out[:5], *none))


_ENTRIES = "key string, page_id long, file string, offset long, length long"


def _write_records(batches, folder: str, limit: int, date: str) -> Iterator:
    """Record files of this task; what is given out are the places of their records."""
    import pyarrow as pa
    from pyspark import TaskContext

    system, root = _file_system(folder)
    # A retried task writes other files; only those whose entries are committed are ever read.
    stem = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
    entries: list[tuple] = []
    count, out, name, at = 0, None, "", 0
    schema = pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])

    def given():
        return pa.RecordBatch.from_arrays([pa.array([e[i] for e in entries], f.type) for i, f in enumerate(schema)], schema=schema)

    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            for page_id, url, html, digest, size, refers_to, refers_url in zip(*(c.to_pylist() for c in batch.slice(start, 256).columns), strict=True):
                if out is None:
                    name = f"{stem}-{count:05d}.warc.gz"
                    out = system.open_output_stream(f"{root}/{name}", compression=None)
                    first = info_member(name, date)
                    out.write(first)
                    at, count = len(first), count + 1
                payload = None if html is None else html.encode("utf-8")
                member = record_member(f"{name}:{at}", date, page_id, url, payload, digest, size, refers_to, refers_url)
                out.write(member)
                entries.append((capture_key(url, page_id), page_id, name, at, len(member)))
                at += len(member)
                if at >= limit:
                    out.close()
                    out = None
                    yield given()
                    entries = []
    if out is not None:
        out.close()
        yield given()


_TOP = "first_key string, last_key string, file string, offset long, length long, n_lines long"


def _write_index(batches, folder: str, block_lines: int, page_blocks: int) -> Iterator:
    """An index file of this task from sorted rows (key, file, offset, length); what is given out is its upper level."""
    import pyarrow as pa
    from pyspark import TaskContext

    system, root = _file_system(folder)
    name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.idx"
    out, at = None, 0
    lines: list[str] = []
    page: list[tuple[str, str, int, int, int]] = []  # first key, last key, offset, length, lines of a block
    top: list[tuple] = []

    def put(text: list[str]) -> tuple[int, int]:
        nonlocal at, out
        if out is None:
            out = system.open_output_stream(f"{root}/{name}", compression=None)
        data = zlib.compress("\n".join(text).encode("utf-8"), 6)
        out.write(data)
        at += len(data)
        return at - len(data), len(data)

    def close_block():
        nonlocal lines
        page.append((lines[0].split("\t", 1)[0], lines[-1].split("\t", 1)[0], *put(lines), len(lines)))
        lines = []

    def close_page():
        nonlocal page
        place = put([f"{first}\t{offset}\t{length}" for first, _, offset, length, _ in page])
        top.append((page[0][0], page[-1][1], name, *place, sum(p[4] for p in page)))
        page = []

    for batch in batches:
        for key, file, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            lines.append(f"{key}\t{file}\t{offset}\t{length}")
            if len(lines) == block_lines:
                close_block()
                if len(page) == page_blocks:
                    close_page()
    if lines:
        close_block()
    if page:
        close_page()
    if out is not None:
        out.close()
        yield pa.RecordBatch.from_arrays(
            [pa.array([t[i] for t in top], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()))],
            names=["first_key", "last_key", "file", "offset", "length", "n_lines"],
        )


class CaptureIndex:
    """Searches in an index folder, from its upper level: (first_key, file, offset, length) in order of keys."""

    def __init__(self, folder: str, top: Iterable[tuple[str, str, int, int]]):
        self._system, self._root = _file_system(folder)
        self._top = [(first.encode("utf-8"), (file, offset, length)) for first, file, offset, length in top]
        self._files: dict[str, object] = {}
        self._page = functools.lru_cache(4)(self._read_page)
        self._block = functools.lru_cache(4)(self._read_block)

    def _read(self, file: str, offset: int, length: int) -> list[bytes]:
        if file not in self._files:
            for old in self._files.values():
                old.close()
            self._files = {file: self._system.open_input_file(f"{self._root}/{file}")}
        return zlib.decompress(self._files[file].read_at(length, offset)).split(b"\n")

    def _read_page(self, place: tuple[str, int, int]) -> list[tuple[bytes, tuple[str, int, int]]]:
        parts = [line.split(b"\t") for line in self._read(*place)]
        return [(p[0], (place[0], int(p[1]), int(p[2]))) for p in parts]

    def _read_block(self, place: tuple[str, int, int]) -> list[list[bytes]]:
        return [line.split(b"\t") for line in self._read(*place)]

    @staticmethod
    def _span(entries: list[tuple], low: bytes, high: bytes) -> Iterator:
        """The places of the parts that can hold keys from low to below high: from the part before the first at low on."""
        at = max(0, bisect.bisect_left(entries, low, key=lambda e: e[0]) - 1)
        while at < len(entries) and (entries[at][0] < high):
            yield entries[at][1]
            at += 1

    def search(self, low: bytes, high: bytes) -> Iterator[tuple[str, str, int, int]]:
        """(key, file, offset, length) of the lines with low <= key < high."""
        for page in self._span(self._top, low, high):
            for block in self._span(self._page(page), low, high):
                lines = self._block(block)
                at = bisect.bisect_left(lines, low, key=lambda x: x[0])
                while at < len(lines) and lines[at][0] < high:
                    key, file, offset, length = lines[at]
                    yield key.decode("utf-8"), file.decode("utf-8"), int(offset), int(length)
                    at += 1


def _search_keys(batches, folder: str, top: list[tuple]) -> Iterator:
    """The places (file, offset, length) of keys that come in order; a key without a line is an error."""
    import pyarrow as pa

    index, found = CaptureIndex(folder, top), []

    def given():
        columns = [pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, names=["file", "offset", "length"])

    for batch in batches:
        for key in batch.column(0).to_pylist():
            low, seen = key.encode("utf-8"), False
            for _, *place in index.search(low, low + b"\0"):
                seen = True
                found.append(place)
                if len(found) >= 10_000:  # a key may have any number of lines
                    yield given()
                    found.clear()
            if not seen:
                raise ValueError(f"the index has no capture of {key}")
    yield given()


_RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def _read_records(batches, folder: str) -> Iterator:
    """Facts of the records at (file, offset, length), which come in order of place; neighbours are read at once."""
    import pyarrow as pa

    system, root = _file_system(folder)
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
    name, handle = None, None
    for batch in batches:
        rows, places = [], list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
        i = 0
        while i < len(places):
            file, start, length = places[i]
            j, stop = i + 1, start + length
            while j < len(places) and places[j][0] == file and start <= places[j][1] <= stop and stop - start < READ_BYTES:
                stop = max(stop, places[j][1] + places[j][2])
                j += 1
            if file != name:
                if handle is not None:
                    handle.close()
                name, handle = file, system.open_input_file(f"{root}/{file}")
            data = handle.read_at(stop - start, start)
            for _, offset, size in places[i:j]:
                rows.append(_facts(parse_record(zlib.decompress(data[offset - start : offset - start + size], 31))))
            i = j
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=[n.split()[0] for n in _RECORDS.split(", ")])


def _facts(record: dict[str, object]) -> tuple:
    digest = base64.b32decode(str(record["warc-payload-digest"]).removeprefix("sha1:")).hex()
    number = lambda name: int(record[name]) if record.get(name) else None
    size = len(record["payload"]) if record["warc-type"] == "response" else int(record["x-payload-length"])
    return number("x-page-id"), size, digest, record["warc-type"], number("x-refers-to-page-id"), record["warc-target-uri"]


class Archive:
    """A written archive: record files, index files and the tables of what tasks have committed, in one folder."""

    def __init__(self, spark: SparkSession, path: str):
        self._spark, self.path = spark, path

    @property
    def entries(self) -> DataFrame:
        """(key, page_id, file, offset, length) as the tasks wrote the records."""
        return self._spark.read.schema(_ENTRIES).parquet(f"{self.path}/entries")

    @classmethod
    def write(
        cls, pages: DataFrame, path: str | None = None, segment_bytes: int = SEGMENT_BYTES, block_lines: int = BLOCK_LINES, page_blocks: int = PAGE_BLOCKS,
    ) -> Archive:
        """Write every page as a record and index the records."""
        spark = pages.sparkSession
        archive = cls(spark, path or new_path(spark, "warc"))
        for folder in ("records", "index"):
            system, root = _file_system(f"{archive.path}/{folder}")
            system.create_dir(root, recursive=True)
        date = datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
        work = partial(_write_records, folder=f"{archive.path}/records", limit=segment_bytes, date=date)
        with_referrals(pages).mapInArrow(work, _ENTRIES).write.parquet(f"{archive.path}/entries")
        # Equal keys of any number are spread over ranges by the further columns.
        ordered = ["key", "file", "offset"]
        ranged = archive.entries.select("key", "file", "offset", "length").repartitionByRange(*ordered).sortWithinPartitions(*ordered)
        index = partial(_write_index, folder=f"{archive.path}/index", block_lines=block_lines, page_blocks=page_blocks)
        ranged.mapInArrow(index, _TOP).write.parquet(f"{archive.path}/top")
        return archive

    def top(self) -> list[tuple[str, str, int, int]]:
        """The upper level: one small entry per BLOCK_LINES * PAGE_BLOCKS captures and per index file."""
        rows = self._spark.read.schema(_TOP).parquet(f"{self.path}/top").select("first_key", "file", "offset", "length").collect()
        return sorted((tuple(r) for r in rows), key=lambda r: (r[0].encode("utf-8"), r[1], r[2]))

    def lookup(self, url: str) -> list[dict[str, object]]:
        """The parsed records of a URL."""
        low = capture_key(url, None).encode("utf-8")
        found = list(CaptureIndex(f"{self.path}/index", self.top()).search(low, low[:-1] + b"!"))
        system, root = _file_system(f"{self.path}/records")
        records = []
        for _, file, offset, length in found:
            with system.open_input_file(f"{root}/{file}") as f:
                records.append(parse_record(zlib.decompress(f.read_at(length, offset), 31)))
        return records

    def captures(self, pages: DataFrame) -> DataFrame:
        """The records of the given pages (page_id, url), found through the index and read by byte range.

        (page_id, payload_bytes, payload_digest, record_type, refers_to, url). Keys are sorted, so
        that a task's searches walk through few blocks; only keys and places are shuffled. A page
        without a capture is an error.
        """

        def keys(batches):
            import pyarrow as pa

            for batch in batches:
                made = [capture_key(u, i) for i, u in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(made, pa.string())], names=["key"])

        asked = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")).mapInArrow(keys, "key string")
        ranged = asked.distinct().repartitionByRange("key").sortWithinPartitions("key")
        search = partial(_search_keys, folder=f"{self.path}/index", top=self.top())
        places = ranged.mapInArrow(search, "file string, offset long, length long").repartition("file").sortWithinPartitions("file", "offset")
        return places.mapInArrow(partial(_read_records, folder=f"{self.path}/records"), _RECORDS)

    def index_lines(self) -> DataFrame:
        """(key, file, offset, length) of all lines of all index blocks."""
        folder = f"{self.path}/index"

        def unpack(batches):
            import pyarrow as pa

            for batch in batches:
                for place in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    index = CaptureIndex(folder, [])
                    for _, block in index._read_page(place):
                        lines = [[x.decode("utf-8") for x in line] for line in index._read_block(block)]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([x[0] for x in lines]), pa.array([x[1] for x in lines]), pa.array([int(x[2]) for x in lines]), pa.array([int(x[3]) for x in lines])],
                            names=["key", "file", "offset", "length"],
                        )

        top = self._spark.read.schema(_TOP).parquet(f"{self.path}/top")
        return top.select("file", "offset", "length").mapInArrow(unpack, "key string, file string, offset long, length long")

    def missing(self) -> DataFrame:
        """(key, file, offset, length) that only the record files or only the index has."""
        own, listed = self.entries.select("key", "file", "offset", "length"), self.index_lines()
        return own.exceptAll(listed).unionByName(listed.exceptAll(own))


def warc_round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write all pages (page_id, url, html) as WARC and read them back through the capture index.

    Per row: page_id, payload_bytes, payload_digest, record_type, refers_to and url. Null html
    counts as empty; null and malformed URLs are kept as text. Rows that share a page_id, or have
    none, are records of their own, decided by their own payloads; a null page_id is never a
    revisit, and of rows repeated whole all are of one kind. An empty table gives no rows; other
    columns are ignored.
    """
    return Archive.write(pages, path).captures(pages)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet")).drop("url")
