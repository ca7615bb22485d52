import gzip
import hashlib
import os

from helixgrid.llm import warc
from tests.llm import sql

PAGES = [(i, f"http://h{i % 7}.test/{i}", "same" if i % 3 else f"<p>{i} é日</p>" * (i % 50)) for i in range(200)] + [
    (500, None, None), (501, "", ""), (502, "http://x/\r\nEvil: 1", "a\r\n\r\nWARC/1.1\r\n"), (-5, "http://é.test/ü ", "\r\n\r\n"), (10**12, "z", "long " * 50_000),
]


def write(spark, tmp_path, name, rows=PAGES, parts=3, **how):
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, payload string").repartition(parts)
    folder = f"{tmp_path}/{name}"
    return warc.write(df, folder, **how).collect(), folder


def test_round_trip_equals_sql(spark, tmp_path):
    files, folder = write(spark, tmp_path, "a", roll_bytes=4_000, shard_bytes=20_000)
    assert len(files) > 5 and len({f.shard for f in files}) > 2
    got = warc.read(spark, folder)
    assert sql.of(got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) == sql.rows(warc.ORACLE_SQL, pages=("page_id bigint, url varchar, html varchar", PAGES))
    text = {i: (t or "").encode() for i, _, t in PAGES}
    rows = got.collect()
    assert all(bytes(r.payload) == text[r.page_id] for r in rows if r.record_type == "response")
    assert sum(f.records for f in files) == len(PAGES) == len(rows)
    for f in files:
        data = open(f"{folder}/{f.file}", "rb").read()
        assert len(data) == f.bytes and hashlib.sha256(data).hexdigest() == f.sha256 and gzip.decompress(data).startswith(b"WARC/1.1\r\n")
    assert not [x for x in os.listdir(folder) if x.endswith(".tmp")]


def test_equal_rows_give_equal_bytes_and_stray_files_are_not_read(spark, tmp_path):
    a, folder = write(spark, tmp_path, "b", roll_bytes=4_000, shard_bytes=20_000)
    b, _ = write(spark, tmp_path, "c", list(reversed(PAGES)), 5, roll_bytes=4_000, shard_bytes=20_000)
    assert sorted(tuple(x) for x in a) == sorted(tuple(x) for x in b)
    open(f"{folder}/shard-000000-99999.warc.gz", "wb").write(b"junk")
    assert warc.read(spark, folder).count() == len(PAGES)


def test_defined_cases(spark, tmp_path):
    _, folder = write(spark, tmp_path, "d", [(1, "u", "x"), (1, "u", "x"), (None, "u", "x"), (None, None, "y"), (3, "u", "x" * 9)], least_bytes=1)
    got = sorted(((r.page_id, r.record_type, r.refers_to) for r in warc.read(spark, folder).collect()), key=str)
    assert got == sorted([(1, "response", None), (1, "response", None), (None, "revisit", 1), (None, "response", None), (3, "response", None)], key=str)
    _, folder = write(spark, tmp_path, "e", [(1, "u", "x"), (2, "u", "x")], least_bytes=2)
    assert {r.record_type for r in warc.read(spark, folder).collect()} == {"response"}
    df = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write(df, f"{tmp_path}/f")
    assert warc.read(spark, f"{tmp_path}/f").count() == 0


def test_files_roll_and_are_read_apart(spark, tmp_path):
    os.makedirs(f"{tmp_path}/g")
    open(f"{tmp_path}/g/.shard-000000-00000.warc.gz.killed.tmp", "wb").write(b"half")
    df = spark.createDataFrame([(i, "u", "".join(hashlib.sha512(f"{i}:{k}".encode()).hexdigest() for k in range(700))) for i in range(40)], "page_id long, url string, html string")
    files = warc.write(df, f"{tmp_path}/g").collect()
    assert len({f.shard for f in files}) < len(files) and not [x for x in os.listdir(f"{tmp_path}/g") if x.endswith(".tmp")]
    assert max(f.bytes for f in files) < warc.LEAST_ROLL + 100_000
    got = warc.read(spark, f"{tmp_path}/g")
    assert got.rdd.getNumPartitions() > 1 and got.count() == 40


def test_places_equal_a_plain_search(spark):
    starts = [-7, 0, 5, 6, 1000, 10**15]
    df = spark.createDataFrame([(x,) for x in (-7, -1, 0, 4, 5, 6, 999, 1000, 10**15, 10**18)], "id long")
    assert [r[0] for r in df.select(warc._place("id", starts)).collect()] == [0, 0, 1, 1, 2, 3, 3, 4, 5, 5]
    assert df.select(warc._place("id", [3])).distinct().collect()[0][0] == 0
