import gzip
import io

import pytest

from tessera.llm import warc as W


def brute(rows):
    groups = {}
    for i, h in rows:
        groups.setdefault((h or "").encode(), []).append(i)
    out = []
    for i, h in rows:
        p = (h or "").encode()
        ids = [x for x in groups[p] if x is not None]
        first = min(ids) if ids else None
        revisit = len(p) >= 100 and first is not None and i != first
        out.append((i, len(p), W.digest(p), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


ROWS = [(5, "a" * 100), (3, "a" * 100), (9, "a" * 100), (1, "a" * 99), (2, "a" * 99), (4, None), (6, ""), (7, "é" * 50), (8, "é" * 50), (10, "WARC/1.1\r\n\r\nx" * 30), (11, "z" * 300_000), (12, "z" * 300_000), (None, "q" * 200), (13, "q" * 200), (14, "dup" * 50), (14, "dup" * 50), (None, "only" * 40)]


def pages(spark, rows):
    return spark.createDataFrame([(i, None if i == 3 else f"http://x/{i}\r\nEvil: 1", h, "x", 1) for i, h in rows], "page_id long, url string, html string, payload string, refers_to int")


@pytest.mark.parametrize("most", [1000, 0])
def test_round_trip(spark, monkeypatch, most):
    monkeypatch.setattr(W, "MOST_BROADCAST", most)
    got = sorted(map(tuple, W.round_trip(pages(spark, ROWS)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)
    assert got == brute(ROWS)
    assert W.round_trip(pages(spark, [])).collect() == []


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_filters_skip_payloads(spark, tmp_path, compression):
    W.register(spark)
    rows = [("response", f"<urn:page:{i}>", f"http://h{i % 2}/{i}", bytes([65 + i]) * (10_000 * i)) for i in range(6)] + [("revisit", "<urn:page:99>", "http://h0/1", None)]
    df = spark.createDataFrame(rows, "record_type string, record_id string, target_uri string, payload binary").coalesce(2)
    path = str(tmp_path / "a")
    df.write.format("warc").option("compression", compression).mode("append").save(path)
    back = spark.read.format("warc").load(path)
    assert back.count() == 7
    some = back.where("record_type = 'response' and target_uri like 'http://h1/%'")
    got = {r.record_id: bytes(r.payload) for r in some.select("record_id", "payload").collect()}
    assert got == {r[1]: r[3] for r in rows if "h1/" in r[2]}
    assert [r.record_id for r in back.where("record_id in ('<urn:page:99>', 'none')").collect()] == ["<urn:page:99>"]


def test_reader_applies_pushed_filters():
    from pyspark.sql import datasource as D
    from pyspark.sql.types import StructType

    reader = W.WarcReader(StructType.fromDDL(W.SCHEMA), {"path": "/x"})
    filters = [D.EqualTo(("record_type",), "response"), D.GreaterThan(("content_length",), 5)]
    assert list(reader.pushFilters(filters)) == filters[1:]
    assert reader._wanted({"warc-type": "response"}) and not reader._wanted({"warc-type": "revisit"}) and not reader._wanted({})


def test_plain_gzip_members_without_lengths():
    data = [W.record({"record_type": "response", "record_id": str(i)}, b"x" * (i * 9000)) for i in range(4)]
    raw = b"".join(gzip.compress(d) for d in data)
    seen = [(h["warc-record-id"], len(W._payload(body(), h)) if i % 2 else None) for i, (_, h, body) in enumerate(W._Zipped(io.BytesIO(raw), len(raw)))]
    assert seen == [("0", None), ("1", 9000), ("2", None), ("3", 27000)]
    raw = b"".join(data)
    seen = [(h["warc-record-id"], len(W._payload(body(), h)) if i % 2 else None) for i, (_, h, body) in enumerate(W._Plain(io.BytesIO(raw), len(raw)))]
    assert seen == [("0", None), ("1", 9000), ("2", None), ("3", 27000)]
