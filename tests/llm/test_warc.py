import gzip
import hashlib

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualNullSafe, EqualTo, GreaterThan, In

from colkit.llm import warc
from colkit.llm.common import new_path

BIG = "<p>héllo</p>" * 50
ROWS = [
    (5, "http://a.example/x", BIG), (3, "http://b.example/\nodd line", BIG), (9, None, BIG), (1, "u", "short"), (2, "u", "short"), (4, "u", None), (6, "u", ""),
    (None, "null id", BIG), (7, "u", BIG + "y"), (7, "u", BIG + "y"), (8, "u", "z" * 3_000_000),
]


def pages(spark):
    return spark.createDataFrame([(*r, "clash", b"clash") for r in ROWS], "page_id long, url string, html string, record_type string, payload binary").repartition(3)


def test_round_trip(spark):
    got = warc.round_trip(pages(spark)).collect()
    assert len(got) == len(ROWS)
    by = {}
    for r in got:
        by.setdefault(r["row_id"], []).append(r)
    digest = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    for i, url, html in ROWS:
        for r in by[i]:
            assert r["payload_digest"] == digest(html) and r["payload_length"] == len((html or "").encode())
            assert r["target_uri"] == (None if url is None else url.replace("\n", "%0A"))
            if r["record_type"] == "response":
                assert bytes(r["payload"]).decode() == (html or "")
    kinds = {i: {(r["record_type"], r["refers_to"]) for r in rs} for i, rs in by.items()}
    assert kinds[3] == {("response", None)} and kinds[5] == kinds[9] == kinds[None] == {("revisit", "3")}
    assert all(kinds[i] == {("response", None)} for i in (1, 2, 4, 6, 7, 8)) and len(by[7]) == 2


def test_empty_table(spark):
    assert warc.round_trip(pages(spark).where("page_id = 77")).count() == 0


def test_pushed_filters_skip_payloads(spark):
    path = new_path(spark, "warc-test")
    warc.archive_pages(pages(spark), path)
    df = warc.read_warc(spark, path)
    assert df.where("record_type = 'revisit'").count() == 3
    assert df.where(F.col("row_id").isin(1, 2)).count() == 2
    assert [bytes(r["payload"]) for r in df.where("target_uri = 'http://a.example/x' or row_id = 1").where("record_type = 'response'").collect()] == [b"short"]
    assert warc.read_warc(spark, path, payload=False).where("payload is not null").count() == 0


def test_the_reader_takes_predicates_on_headers():
    reader = warc.WarcReader({"path": "file:///nowhere"})
    taken = [EqualTo(("record_type",), "response"), In(("target_uri",), ("a", "b")), EqualNullSafe(("row_id",), "1")]
    left = [EqualTo(("payload",), b"x"), GreaterThan(("payload_length",), 5), EqualTo(("record_type", "inner"), "x")]
    assert list(reader.pushFilters([*taken, *left])) == left
    assert [name for name, _ in reader.tests] == ["record_type", "target_uri", "row_id"]


def test_payloads_that_a_query_does_not_want_are_not_inflated(spark, tmp_path):
    """A filter that reached the reader: the response's payload is damaged, which only a query for it notices."""
    kinds = ("response", "revisit", "response")
    rows = [{"row_id": k, "record_type": kind, "target_uri": "u", "payload_digest": "d", "payload": bytes([65 + k]) * 200_000 if kind == "response" else b"", "refers_to": None} for k, kind in enumerate(kinds)]
    members = [bytearray(warc.member(warc.record(r), 6)) for r in rows]
    members[0][-40] ^= 0xFF
    (tmp_path / "a.warc.gz").write_bytes(b"".join(members))
    df = warc.read_warc(spark, str(tmp_path))
    assert [r["row_id"] for r in df.where("record_type = 'revisit'").collect()] in ([1], ["1"])
    assert [bytes(r["payload"]) for r in df.where("row_id = 2").collect()] == [b"C" * 200_000]
    with pytest.raises(Exception):
        df.where("record_type = 'response'").select("payload").collect()


def test_wanted_records_are_decoded_and_others_are_not(tmp_path):
    data = b"".join(warc.member(warc.record({"row_id": k, "record_type": "response", "target_uri": "u", "payload_digest": "d", "payload": bytes([65 + k]) * 200_000, "refers_to": None}), 6) for k in range(3))
    # damage in an unwanted payload goes unnoticed: it is never inflated
    length = warc.Archive(open_bytes(tmp_path, data))._member_length(0)
    broken = bytearray(data)
    broken[length - 40] ^= 0xFF
    found = list(warc.Archive(open_bytes(tmp_path, bytes(broken))).records(lambda h: "block" if h["x-row-id"] == "1" else ""))
    assert len(found) == 1 and warc.http_payload(found[0][1])[0] == b"B" * 200_000


def open_bytes(tmp_path, data):
    path = tmp_path / "x.warc.gz"
    path.write_bytes(data)
    return path.open("rb")


def test_other_archives(spark, tmp_path):
    """Plain files, files of one gzip stream, members without lengths, folded headers, records that are not HTTP."""
    records = []
    for k in range(4):
        body = f"payload {k}\r\n\r\nmore".encode()
        records.append(f"WARC/1.0\r\nWARC-Type: {'warcinfo' if k == 0 else 'resource'}\r\nWARC-Record-ID: <urn:uuid:{k}>\r\nX-Folded: a\r\n b\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n")
    (tmp_path / "a.warc").write_bytes(b"".join(records))
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(b"".join(records)))
    (tmp_path / "c.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in records))
    (tmp_path / "empty.warc").write_bytes(b"")
    (tmp_path / "notes.txt").write_bytes(b"not an archive")
    df = warc.read_warc(spark, str(tmp_path))
    assert df.count() == 12
    got = df.where("record_type = 'resource' and record_id = 'urn:uuid:2'").collect()
    assert [bytes(r["payload"]) for r in got] == [b"payload 2\r\n\r\nmore"] * 3
    assert warc.read_warc(spark, str(tmp_path / "a.warc")).count() == 4
