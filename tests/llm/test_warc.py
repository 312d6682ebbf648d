import pytest

from flowlens.llm import warc
from flowlens.llm.common import Scratch


def brute(rows, least=0):
    first = {}
    for i, _, h in rows:
        p = (h or "").encode()
        if i is not None and len(p) >= least:
            first[p] = min(first.get(p, i), i)
    out = []
    for i, _, h in rows:
        p = (h or "").encode()
        again = len(p) >= least and p in first and i != first[p]
        out.append((i, len(p), warc.digest(p), "revisit" if again else "response", first[p] if again else None))
    return sorted(out, key=str)


ROWS = [(5, "http://a", "<p>same é</p>"), (2, "http://b\r\nX: y", "<p>same é</p>"), (9, None, "<p>same é</p>"), (7, "u", None), (8, "u", ""), (1, "u", "x" * 100_000), (None, "u", "<p>same é</p>"), (11, "u", "own"), (11, "u", "own")]


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, least, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 500)
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string").selectExpr("*", "1 as first", "2 as size")
    out = warc.round_trip(df, least).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out), key=str) == brute(ROWS, least)
    texts = {r.page_id: r.html for r in out if r.record_type == "response"}
    assert texts[1] == "x" * 100_000 and texts[2] == "<p>same é</p>"
    assert warc.round_trip(df.limit(0)).count() == 0


def test_given_pages(spark):
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    out = warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out), key=str) == brute(rows)


def test_damage(spark):
    records = [warc.record(i, "u", b"payload %d" % i, None, False) for i in range(50)]
    good = warc.write_archive(records)
    assert list(warc.frames(good)) == records and warc.parse(records[3])[1] == b"payload 3"
    assert list(warc.frames(good, 7)) == records
    for bad in (good[:-3], good[4:], b"", good[:-20] + b"zzzz" + good[-16:]):
        with pytest.raises(ValueError):
            list(warc.frames(bad))
    for bad in (records[0][:-1], records[0].replace(b"payload 0", b"payload 1"), records[0].replace(b"WARC/1.1", b"HTTP/1.1"), records[0].replace(b"WARC-Date", b"Other"), records[0].replace(b"Content-Length: 9", b"Content-Length: 8")):
        with pytest.raises(ValueError):
            warc.parse(bad)
    assert Scratch(spark, "x").root
