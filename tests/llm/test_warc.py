import gzip
import hashlib
import io
import os

from convq.llm import warc

SCHEMA = "page_id bigint, url string, html string"
LONG = "<p>" + "ä\r\n\r\nWARC/1.1\r\n" * 100
ROWS = [
    (1, "http://a.example/x?y=1", "small"), (2, "http://b.example", "small"), (3, "http://a.example/long", LONG), (9, "https://c.example/", LONG),
    (5, None, LONG), (None, "http://n.example/", LONG), (7, "http://bad.example/a b\r\nX: y", None), (8, "", ""), (4, "u", "é" * 499), (6, "u", "é" * 499),
    (10, "http://r.example/", "r" * 2000), (10, "http://r.example/", "r" * 2000), (11, "http://big.example/", "b" * 3_000_000),
]


def round_trip(spark, df, path, **options):
    warc.write_archives(df, path, **options)
    return warc.assemble(warc.read_records(spark, path))


def test_round_trip(spark, table, tmp_path):
    path = str(tmp_path / "warc")
    got = round_trip(spark, table([(*r, 1) for r in ROWS], SCHEMA + ", n int"), path, records_per_file=6).collect()
    assert len(got) == len(ROWS)
    seen = sorted(((r["page_id"], r["response"]["record_type"], r["response"]["payload_digest"], r["response"]["refers_to"]) for r in got), key=str)
    want = []
    for page, _, html in ROWS:
        revisit = html == LONG and page != 9
        digest = hashlib.sha1((html or "").encode()).hexdigest()
        want.append((page, "revisit" if revisit else "response", digest, "9" if revisit else None))
    assert seen == sorted(want, key=str)
    for r in got:
        payload = [h or "" for p, _, h in ROWS if p == r["page_id"]][0].encode()
        assert r["response"]["payload_bytes"] == len(payload)
        assert r["response"]["payload"] == (payload if r["response"]["record_type"] == "response" else None)
        assert r["request"]["head"].startswith("GET ") and r["metadata"]["fields"].startswith("page_id: ")
        assert r["request"]["uri"] == r["response"]["uri"]


def test_files_are_plain_warc(table, tmp_path):
    path = str(tmp_path / "warc")
    warc.write_archives(table(ROWS[:3], SCHEMA, 1), path)
    files = [f for f in os.listdir(path) if f.endswith(".gz")]
    records = [x for f in files for x in warc.parse(io.BytesIO(gzip.open(f"{path}/{f}").read()))]
    kinds = sorted(h["warc-type"] for h, _ in records)
    assert kinds == ["metadata"] * 3 + ["request"] * 3 + ["response"] * 3
    ids = {h["warc-record-id"] for h, _ in records}
    assert len(ids) == 9
    assert all(h["warc-concurrent-to"] in ids for h, _ in records if h["warc-type"] != "response")


def test_uncompressed_files_and_lone_records(spark, tmp_path):
    block = b"HTTP/1.1 200 OK\r\n\r\nhi"
    record = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:1>\r\nContent-Length: %d\r\n\r\n" % len(block)
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:0>\r\nContent-Length: 2\r\n\r\nok\r\n\r\n"
    (tmp_path / "one.warc").write_bytes(info + record + block + b"\r\n\r\n")
    (row,) = warc.assemble(warc.read_records(spark, str(tmp_path))).collect()
    assert row["response"]["payload"] == b"hi" and row["page_id"] is None and row["request"] is None


def test_empty(spark, table, tmp_path):
    assert round_trip(spark, table([], SCHEMA), str(tmp_path / "warc")).count() == 0
