import hashlib
import io

from mereling.llm import scratch, warc

PAGES = [
    (1, "http://a/b c\r\nd", "x" * 2000), (2, None, "x" * 2000), (3, "http://é", "x" * 2000), (4, "u", "short"), (5, "u", "short"), (6, "", None), (7, "v", ""), (None, "w", "y" * 1500), (8, "w", "y" * 1500),
    (9, "w", "é" * 500), (10, "w", "é" * 500), (11, "z", "long " * 200_000), (12, "w", "a\r\n\r\nb" * 300), (12, "w", "a\r\n\r\nb" * 300),
]
SCHEMA = "page_id long, url string, html string, record_type string, payload string"


def brute():
    best = {}
    for i, _, h in PAGES:
        if i is not None:
            best[h or ""] = max(best.get(h or "", i), i)
    out = []
    for i, _, h in PAGES:
        raw = (h or "").encode()
        other = len(raw) >= 1000 and best[h or ""] != i
        out.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if other else "response", best[h or ""] if other else None))
    return sorted(out, key=repr)


def test_round_trip(spark):
    df = spark.createDataFrame([(*p, "t", "q") for p in PAGES], SCHEMA)
    got = warc.round_trip(df, scratch.new_path(spark, "warc"))
    assert sorted(map(tuple, got.collect()), key=repr) == brute()


def test_ids_of_other_types(spark):
    rows = [("a b\r\n:é", "x" * 1500), ("z", "x" * 1500), ("", "y"), (None, "y")]
    df = spark.createDataFrame([(i, "http://u", h) for i, h in rows], "page_id string, url string, html string")
    got = sorted(((r.page_id, r.record_type, r.refers_to) for r in warc.round_trip(df, scratch.new_path(spark, "warc")).collect()), key=repr)
    assert got == sorted([("a b\r\n:é", "revisit", "z"), ("z", "response", None), (None, "response", None), (None, "response", None)], key=repr)


def test_source_pushes_filters_down(spark):
    warc.register(spark)
    path = scratch.new_path(spark, "warc")
    warc.to_records(spark.createDataFrame([(*p, "t", "q") for p in PAGES], SCHEMA)).write.format("warc").mode("append").save(path)
    df = spark.read.format("warc").load(path)
    assert df.where("record_type = 'revisit'").count() == sum(r[3] == "revisit" for r in brute())
    one = df.where("record_id = 'urn:page:11'").collect()
    assert len(one) == 1 and bytes(one[0].payload) == b"long " * 200_000
    assert df.where("target_uri = 'http://é'").count() == 1 and df.where("target_uri like 'http://a/b c%'").count() == 1
    assert df.where("payload_bytes > 1000000 or record_id is null").count() == 0
    assert spark.read.format("warc").option("payload", "false").load(path).where("payload is not null").count() == 0
    reader = warc.WarcReader({"path": path})
    from pyspark.sql.datasource import EqualTo, StringContains

    assert list(reader.pushFilters([EqualTo(("record_type",), "revisit"), StringContains(("target_uri",), "a")])) == [StringContains(("target_uri",), "a")]


def test_foreign_archives():
    """Plain records, and gzip members without a size."""
    import gzip

    head = lambda kind, body: f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:x>\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"
    records = [head("warcinfo", b"i" * 9000), head("resource", b"body"), head("response", b"z" * 3_000_000), head("metadata", b"")]
    for raw in (b"".join(records), b"".join(map(gzip.compress, records))):
        got = list(warc.records(io.BytesIO(raw), lambda f: f["record_type"] != "warcinfo"))
        assert [(r["record_type"], len(r["payload"])) for r in got] == [("resource", 4), ("response", 3_000_000), ("metadata", 0)]


class Counting(io.BytesIO):
    """Counts the bytes that are read."""

    count = 0

    def read(self, n=-1):
        data = super().read(n)
        self.count += len(data)
        return data


def test_unwanted_members_are_stepped_over():
    import os

    body = lambda k: os.urandom(3_000_000) if k % 2 else b"small"
    record = lambda k, b: {"record_type": "resource" if k % 2 else "response", "record_id": f"urn:{k}", "warc_date": "x", "target_uri": None, "payload_digest": "0", "refers_to": None, "content_length": len(b)}
    bodies = [body(k) for k in range(10)]
    raw = b"".join(warc.member(warc.header(record(k, b)).replace(b"application/http;msgtype=response", b"text/plain") + b + b"\r\n\r\n") for k, b in enumerate(bodies))
    file = Counting(raw)
    got = list(warc.records(file, lambda f: f["record_type"] == "response"))
    assert [r["payload"] for r in got] == [b"small"] * 5 and file.count < 11 * warc.AHEAD < len(raw) / 5
    file = Counting(raw)
    assert [r["payload"] for r in warc.records(file, lambda f: f["record_type"] == "resource")] == bodies[1::2]


def test_unwanted_payloads_are_not_kept():
    """Members of other writers don't tell their size: their unwanted payloads are inflated into nothing."""
    import gzip
    import tracemalloc

    head = lambda kind, body: f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:x>\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"
    raw = gzip.compress(head("response", b"z" * 40_000_000)) + gzip.compress(head("resource", b"body"))
    for wanted, payload in ((lambda f: f["record_type"] == "resource", True), (lambda f: True, False)):
        tracemalloc.start()
        got = list(warc.records(io.BytesIO(raw), wanted, payload))
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert got[-1]["payload"] == (b"body" if payload else None) and most < 12_000_000


def test_records_cut_at_every_place(monkeypatch):
    """Short reads and inflating steps don't change what is found."""
    import gzip

    head = lambda body: b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: %d\r\n\r\n" % len(body) + body + b"\r\n\r\n"
    bodies = [b"", b"a" * 5, bytes(range(256)) * 3, b"\r\n\r\n"]
    for ahead in (1, 7, 100):
        monkeypatch.setattr(warc, "AHEAD", ahead)
        monkeypatch.setattr(warc, "HEAD", ahead)
        for pack in (lambda x: x, gzip.compress, warc.member):
            raw = b"".join(pack(head(b)) for b in bodies)
            assert [r["payload"] for r in warc.records(io.BytesIO(raw), lambda f: True)] == bodies
            assert [r["content_length"] for r in warc.records(io.BytesIO(raw), lambda f: f["content_length"] > 4, payload=False)] == [5, 768]


def test_empty(spark):
    assert warc.round_trip(spark.createDataFrame([], SCHEMA), scratch.new_path(spark, "warc")).count() == 0
