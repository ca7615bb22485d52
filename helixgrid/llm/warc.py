"""Deterministic sharded WARC writer and reader.

Records are dealt into shards by ranges of their integer id. The ranges follow from an exact histogram of payload bytes
over stretches of the id range (heavy ones are divided again), so they depend on the rows alone, not on how they lay on the cluster. A
shard is written in order of id: each record is a gzip member of its own, and a file is rolled once its compressed size
reaches `roll_bytes`; unless given, that is a part of `ROLL_PARTS` of all payload bytes, between `LEAST_ROLL` and
`MOST_ROLL`. Headers and digests are made anew from the payload; record ids are derived from page id and
digest, the date is a parameter. So equal input gives equal bytes.

Commit: a file is written under a temporary name that no other attempt uses, and moved to its final name when complete;
a repeated attempt moves the same bytes there. The list of files with sizes and checksums is written as Parquet by
Spark's own commit; then temporary files that killed attempts left are removed. Readers open what the manifest lists,
and nothing else: a task reads files of about `READ_BYTES` together, or one larger file.

Of records with equal payloads of at least `least_bytes`, the one with the largest id is the response; the others are
revisits without payload that refer to it. Digests are grouped with partial maxima and joined, without payloads, to
the ids that repeat them; what that gives are marks, which meet their pages in the shard. Payloads are shuffled once.

Defined cases: a null html is an empty payload; a null or empty url gives no WARC-Target-URI, and bytes that a header
can't hold are percent-encoded; rows that repeat an id are written each, and where they repeat the largest id of their
payload all are responses; a null id is below all others and is written with an empty X-Page-Id; other columns are
dropped; an empty table gives an empty manifest and no record. The html column is read twice: for digests, and to be
written.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixgrid.llm.session import cut, prepare

LEAST_ROLL, MOST_ROLL, ROLL_PARTS = 1 << 20, 1 << 30, 1 << 16
READ_BYTES = 1 << 20
SHARD_BYTES = 16 << 20
BINS = 4_096
MOST_SHARDS = 4_096  # beyond, shards grow; files still roll
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL name space of RFC 4122


def base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'page:{page_id}:{digest}')}>"


def _header(fields: list[tuple[str, str]]) -> bytes:
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in fields) + b"\r\n"


def _target(url: str | None) -> str:
    return quote(url or "", safe="".join(chr(c) for c in range(0x21, 0x7F)))


def make_record(page_id: int | None, url: str | None, payload: bytes, digest: bytes, length: int, refers: tuple[int | None, str | None] | None, date: str = DATE) -> bytes:
    """A response with its payload, or a revisit without; ends with two line breaks."""
    name = base32(digest)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http if refers else http + payload
    fields = [("WARC-Type", "revisit" if refers else "response"), ("WARC-Record-ID", record_id(page_id, name)), ("WARC-Date", date)]
    if _target(url):
        fields.append(("WARC-Target-URI", _target(url)))
    if refers:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers[0], name)), ("X-Refers-To-Page-Id", str(refers[0]))]
        if _target(refers[1]):
            fields.append(("WARC-Refers-To-Target-URI", _target(refers[1])))
    fields += [("WARC-Payload-Digest", f"sha1:{name}"), ("WARC-Block-Digest", f"sha1:{base32(hashlib.sha1(block).digest())}"), ("X-Page-Id", "" if page_id is None else str(page_id)), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return _header(fields) + block + b"\r\n\r\n"


def warcinfo(name: str, date: str = DATE) -> bytes:
    body = b"software: helixgrid\r\nformat: WARC File Format 1.1\r\n"
    return _header([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(_SPACE, name)}>"), ("WARC-Date", date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields"), ("Content-Length", str(len(body)))]) + body + b"\r\n\r\n"


def member(record: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(record) + z.flush()


class _File:
    """One output file: temporary until close()."""

    def __init__(self, store: fs.FileSystem, folder: str, shard: int, part: int, date: str) -> None:
        self.name = f"shard-{shard:06d}-{part:05d}.warc.gz"
        self.store, self.folder, self.shard = store, folder, shard
        self.temporary = f"{folder}/.{self.name}.{uuid.uuid4().hex}.tmp"
        self.out = store.open_output_stream(self.temporary, compression=None)
        self.size, self.records, self.sum = 0, 0, hashlib.sha256()
        self.put(member(warcinfo(self.name, date)))

    def put(self, data: bytes) -> None:
        self.out.write(data)
        self.sum.update(data)
        self.size += len(data)

    def close(self) -> tuple[str, int, int, int, str]:
        self.out.close()
        self.store.move(self.temporary, f"{self.folder}/{self.name}")
        return self.name, self.shard, self.records, self.size, self.sum.hexdigest()


MANIFEST = "file string, shard int, records long, bytes long, sha256 string"


def _place(at: str, starts: list[int]) -> Column:
    """How many of the ascending starts are at most the column `at`, less one: binary search in one array, which the plan holds as a literal."""
    array = f"cast(split('{','.join(map(str, starts))}', ',') as array<bigint>)"
    middle = "int((s.lo + s.hi) div 2)"
    step = f"if(s.hi - s.lo <= 1, s, if({at} < {array}[{middle}], named_struct('lo', s.lo, 'hi', {middle}), named_struct('lo', {middle}, 'hi', s.hi)))"
    return F.expr(f"aggregate(sequence(1, {max(1, len(starts).bit_length())}), named_struct('lo', 0, 'hi', {len(starts)}), (s, i) -> {step}, s -> s.lo)")


def _shards(rows: DataFrame, shard_bytes: int) -> list[int]:
    """The first id of each shard. rows: id, length. Stretches of ids that are too heavy are divided again, exactly, until a shard holds about shard_bytes or a single id."""
    lo, hi = rows.agg(F.min("id"), F.max("id")).first()
    if lo is None:
        return [0]
    light: list[tuple[int, int]] = []
    heavy, bins = [(lo, hi + 1)], BINS
    while heavy:
        edges = sorted({x for cell in heavy for x in cell})
        index = {x: i for i, x in enumerate(edges)}
        width = {index[a]: (b - a - 1) // bins + 1 for a, b in heavy}
        listed = lambda values: F.expr(f"cast(split('{','.join(map(str, values))}', ',') as array<bigint>)")
        within = rows.filter((F.col("id") >= edges[0]) & (F.col("id") < edges[-1])).withColumn("cell", _place("id", edges)).withColumn("width", F.element_at(listed([width.get(i, 0) for i in range(len(edges))]), F.col("cell") + 1)).filter("width > 0")
        start = F.element_at(listed(edges), F.col("cell") + 1)
        sizes = within.groupBy("cell", F.floor((F.col("id") - start) / F.col("width")).cast("int").alias("bin")).agg(F.sum("length").alias("n")).collect()  # at most `bins` rows for each heavy stretch
        heavy = []
        for cell, b, n in sizes:
            a, w = edges[cell], width[cell]
            if n > shard_bytes and w > 1:
                heavy.append((a + b * w, a + (b + 1) * w))
            else:
                light.append((a + b * w, n))
        heavy, bins = sorted(heavy), 64
    out, held = [lo], 0
    for a, n in sorted(light):
        if held and held + n > shard_bytes:
            out.append(a)
            held = 0
        held += n
    return out


def write(pages: DataFrame, folder: str, roll_bytes: int | None = None, shard_bytes: int = SHARD_BYTES, least_bytes: int = 0, date: str = DATE, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes the archives and their manifest below `folder` (a URI all executors can write), and returns the manifest."""
    spark = prepare(pages.sparkSession)
    own = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"))
    hashed = own.select("*", F.octet_length("payload").cast("long").alias("length"), F.unhex(F.sha1("payload")).alias("digest"))
    small = cut(hashed.select("id", "url", "digest", "length"))
    repeated = (
        small.filter(F.col("length") >= least_bytes).groupBy("digest", "length")
        .agg(F.max("id").alias("response"), F.max(F.struct("id", "url"))["url"].alias("response_url"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1 and response is not null").select(F.col("digest").alias("_d"), F.col("length").alias("_l"), "response", "response_url")
    )
    total = small.agg(F.sum("length")).first()[0] or 0
    roll = roll_bytes or min(max(total // ROLL_PARTS, LEAST_ROLL), MOST_ROLL)
    starts = _shards(small, max(shard_bytes, total // MOST_SHARDS))
    shard = F.when(F.col("id").isNull(), 0).otherwise(_place("id", starts)).cast("int").alias("shard")
    # a revisit is told by a mark that is sorted before its page, so payloads are dealt out once and joined to nothing
    marks = small.select("id", "digest", "length").distinct().join(repeated, (F.col("digest") == F.col("_d")) & (F.col("length") == F.col("_l"))).filter(~F.col("id").eqNullSafe(F.col("response")))
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    mark_rows = marks.select(shard, "id", F.lit(0).alias("kind"), none("string", "url"), none("binary", "payload"), "digest", "length", "response", "response_url")
    page_rows = hashed.select(shard, "id", F.lit(1).alias("kind"), "url", "payload", "digest", "length", none("long", "response"), none("string", "response_url"))
    dealt = page_rows.unionByName(mark_rows).repartitionByRange(len(starts), "shard").sortWithinPartitions("shard", "id", "digest", "kind", "url")
    store, path = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
    store.create_dir(path)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there, where = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        there.create_dir(where)
        now, part, done, mark = None, 0, [], None
        names = ("shard", "id", "kind", "url", "payload", "digest", "length", "response", "response_url")
        for b in batches:
            for s, page, kind, url, payload, digest, length, response, response_url in zip(*(b.column(c) for c in names), strict=True):
                s, which = s.as_py(), (page.as_py(), digest.as_py())
                if kind.as_py() == 0:
                    mark = (which, (response.as_py(), response_url.as_py()))
                    continue
                if now is not None and (s != now.shard or now.size >= roll):
                    part = part + 1 if s == now.shard else 0
                    done.append(now.close())
                    now = None
                elif now is None:
                    part = 0
                if now is None:
                    now = _File(there, where, s, part, date)
                refers = mark[1] if mark is not None and mark[0] == which else None
                now.put(member(make_record(page.as_py(), url.as_py(), payload.as_py(), digest.as_py(), length.as_py(), refers, date)))
                now.records += 1
            if done:
                yield _manifest(done)
                done = []
        if now is not None:
            yield _manifest([now.close()])

    dealt.mapInArrow(put, MANIFEST).write.mode("overwrite").parquet(f"{folder}/manifest")
    for left in store.get_file_info(fs.FileSelector(path)):
        if left.type == fs.FileType.File and left.base_name.startswith(".shard-") and left.base_name.endswith(".tmp"):
            store.delete_file(left.path)
    return spark.read.parquet(f"{folder}/manifest")


def _manifest(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["file", "shard", "records", "bytes", "sha256"])


def members(stream) -> Iterator[bytes]:
    """The uncompressed gzip members of a stream, one at a time."""
    z, out, data = zlib.decompressobj(31), [], b""
    while True:
        data = data or stream.read(1 << 20)
        if not data:
            if out:
                raise ValueError("a gzip member is cut off")
            return
        out.append(z.decompress(data))
        data = z.unused_data
        if z.eof:
            yield b"".join(out)
            z, out = zlib.decompressobj(31), []


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block; digests and length are checked."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if len(block) != int(fields["Content-Length"]) or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    if "WARC-Block-Digest" in fields and fields["WARC-Block-Digest"] != f"sha1:{base32(hashlib.sha1(block).digest())}":
        raise ValueError("a block's digest is wrong")
    return fields, block


RECORDS = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The response and revisit records of the files that the manifest lists. A revisit's payload is null; its length and digest are those it refers to."""
    prepare(spark)
    manifest = spark.read.parquet(f"{folder}/manifest")
    n, size = manifest.agg(F.count(F.lit(1)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    tasks = max(1, min(n, -(-size // READ_BYTES), MOST_SHARDS))

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there, where = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        for b in batches:
            for name in b.column(0).to_pylist():
                out, held = [], 0
                with there.open_input_stream(f"{where}/{name}", compression=None) as stream:
                    for record in members(stream):
                        fields, block = parse_record(record)
                        if fields["WARC-Type"] not in ("response", "revisit"):
                            continue
                        http, _, payload = block.partition(b"\r\n\r\n")
                        length = int(http.rsplit(b"Content-Length: ", 1)[1].split(b"\r\n")[0])
                        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        again = fields["WARC-Type"] == "revisit"
                        if not again and (len(payload) != length or base32(hashlib.sha1(payload).digest()) != digest):
                            raise ValueError("a payload's digest is wrong")
                        page = fields["X-Page-Id"]
                        out.append((int(page) if page else None, fields.get("WARC-Target-URI"), None if again else payload, length, digest, fields["WARC-Type"], int(fields["X-Refers-To-Page-Id"]) if again else None))
                        held += len(payload)
                        if held >= 4 << 20:
                            yield _records(out)
                            out, held = [], 0
                if out:
                    yield _records(out)

    # one row per file; each is read where its row lies
    return manifest.select("file").repartitionByRange(tasks, "file").mapInArrow(get, RECORDS)


def _records(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64())
    names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


ORACLE_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY hex) AS top FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(hex, (i // 4) * 5 + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS INTEGER) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM g
"""
