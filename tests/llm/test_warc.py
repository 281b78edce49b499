"""Archives written and read back, foreign archives, filters that reach the reader."""

import base64
import gzip
import hashlib
import io

from isoloom.llm import warc


def want(rows, least):
    first = {}
    for p, _, h in rows:
        b = (h or "").encode()
        if p is not None and len(b) >= least:
            first[b] = min(p, first.get(b, p))
    out = []
    for p, _, h in rows:
        b = (h or "").encode()
        other = first.get(b) if len(b) >= least and p != first.get(b) else None
        out.append((p, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if other is None else "revisit", other))
    return sorted(out, key=str)


def test_round_trip(spark, tmp_path):
    rows = [(5, "http://a/", "<p>é</p>"), (3, None, "<p>é</p>"), (9, "u\r\nX: y", None), (8, "v", ""), (7, "w", "x" * 300_000), (2, "w", "WARC/1.1\r\n\r\nWARC-Type: response\r\n\r\n"), (3, None, "<p>é</p>")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, refers_to string")
    for least in (0, 5):
        path = f"file://{tmp_path}/w{least}"
        warc.write_pages(pages, path, least)
        assert sorted(map(tuple, warc.read_pages(spark, path).collect()), key=str) == want(rows, least)
    responses = spark.read.format("warc").load(path).where("record_type = 'response' and target_uri = 'w'")
    assert sorted(len(r.payload) for r in responses.collect()) == [len(rows[5][2]), 300_000]
    assert "record_type" in responses._jdf.queryExecution().toString()
    assert spark.read.format("warc").schema("record_id string").load(path).count() == len(rows)


def test_foreign_archives(spark, tmp_path):
    def record(kind, body):
        return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:{kind}>\r\nContent-Type: application/{'http' if kind == 'response' else 'warc-fields'}\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"

    records = [record("warcinfo", b"software: x"), record("response", b"HTTP/1.1 200 OK\r\nX: y\r\n\r\nhello"), record("metadata", b"z" * 3_000_000), record("response", b"HTTP/1.1 200 OK\r\n\r\nagain")]
    (tmp_path / "a.warc").write_bytes(b"".join(records))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    (tmp_path / "c.warc.gz").write_bytes(gzip.compress(b"".join(records)))
    warc.register(spark)
    for name in ("a.warc", "b.warc.gz", "c.warc.gz"):
        all_ = spark.read.format("warc").load(f"file://{tmp_path}/{name}")
        assert sorted(r.record_type for r in all_.collect()) == ["metadata", "response", "response", "warcinfo"]
        assert sorted(bytes(r.payload) for r in all_.where("record_type = 'response'").collect()) == [b"again", b"hello"]
    assert spark.read.format("warc").load(f"file://{tmp_path}").count() == 12


def test_records_across_reads():
    bodies = [b"a" * k for k in range(0, 90, 7)]
    plain = [warc.record(k, "u", b, warc.digest(b), None, "1970-01-01T00:00:00Z") for k, b in enumerate(bodies)]
    for data in (b"".join(plain), b"".join(map(warc.member, plain)), b"".join(map(gzip.compress, plain))):
        for step in (1, 2, 3, 5, 64, 1 << 20):
            got = [(head["warc-record-id"], block() if k % 2 else None) for k, (head, block) in enumerate(warc._Stream(io.BytesIO(data), step))]
            assert [h for h, _ in got] == [f"<urn:page:{k}>" for k in range(len(bodies))]
            assert [b.partition(b"\r\n\r\n")[2] for _, b in got if b is not None] == bodies[1::2]


def test_empty(spark, tmp_path):
    warc.write_pages(spark.createDataFrame([], "page_id long, url string, html string"), f"file://{tmp_path}/e")
    assert warc.read_pages(spark, f"file://{tmp_path}/e").count() == 0


def test_appended_archives_stay_and_overwritten_go(spark, tmp_path):
    path = f"file://{tmp_path}/a"
    kind = "page_id long, url string, html string"
    warc.write_pages(spark.createDataFrame([(1, "a", "x"), (2, "b", "x")], kind), path)
    warc.write_pages(spark.createDataFrame([(3, "c", "y")], kind), path)
    assert sorted((r.page_id, r.record_type) for r in warc.read_pages(spark, path).collect()) == [(1, "response"), (2, "revisit"), (3, "response")]
    rows = spark.createDataFrame([(9, "d", "z", hashlib.sha1(b"z").hexdigest(), None)], "page_id long, url string, html string, payload_sha1 string, refers_to long")
    rows.write.format("warc").mode("overwrite").save(path)
    assert [r.page_id for r in warc.read_pages(spark, path).collect()] == [9]
    assert len(list((tmp_path / "a").glob("*.warc.gz"))) == 1
    dated = spark.read.format("warc").load(path).where("date = '1970-01-01T00:00:00Z' and content_type like 'application/http%'")
    assert dated.count() == 1 and spark.read.format("warc").load(path).where("date = '2000'").count() == 0


def test_paths(spark, tmp_path):
    assert warc.qualified(spark, f"{tmp_path}/p") == f"file:{tmp_path}/p" and warc.qualified(spark, "s3a://b/p") == "s3a://b/p"
    system, path = warc._filesystem(f"file:{tmp_path}/p")
    assert path == f"{tmp_path}/p" and system.type_name == "local"
    assert warc._filesystem("s3a://bucket/p?region=us-east-1")[1] == "bucket/p"


def test_one_member_for_a_whole_archive_is_streamed():
    plain = [warc.record(k, "u", bytes([k]) * 200_000, "x", None, "d") for k in range(20)]
    stream = warc._Stream(io.BytesIO(gzip.compress(b"".join(plain)) + b"".join(plain[:2])), 1 << 12)
    got = [block()[-1] for _, block in stream]
    assert got == [*range(20), 0, 1] and len(stream.data) < 1 << 20
