import hashlib

import pytest

from roadpulse.llm import warc as wa
from roadpulse.llm.common import scratch


def plain(rows):
    out = []
    for k, page in rows:
        data = (page or "").encode()
        same = [j for j, p in rows if (p or "").encode() == data and j is not None]
        kept = max(same) if len(data) >= 1000 and len(same) > 1 and k is not None else k
        out.append((k, len(data), hashlib.sha1(data).hexdigest(), "response" if kept == k else "revisit",
                    None if kept == k else kept))
    return sorted(out, key=str)


def columns(df):
    return sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()], key=str)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    long_ = "é\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n" * 60
    rows = [(1, long_), (2, long_), (5, long_), (5, long_), (None, long_), (3, None), (4, ""), (6, "x" * 999), (7, "x" * 999),
            (8, "x" * 1000), (9, "x" * 1000), (10, "\r\n\r\n"), (11, "\r\n"), (12, "\x00\x85 z"), (None, "y"), (13, "y" * 300000)]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(k, f"http://a.example/{k}?q#f" if k != 7 else None, t, t, 1, "s") for k, t in rows],
                          "page_id long, url string, html string, body string, size long, sha string") \
        .write.parquet(f"{path}/pages.parquet")
    return path, rows


def test_query_round_trip(spark, sf):
    rows = [(r.page_id, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    assert columns(wa.op3_warc_transactions(spark, sf)) == plain(rows)


def test_odd_rows(spark, odd):
    path, rows = odd
    assert columns(wa.op3_warc_transactions(spark, path)) == plain(rows)


def test_payloads_come_back_whole_and_captures_are_complete(spark, odd):
    path, rows = odd
    pages = spark.read.parquet(f"{path}/pages.parquet")
    out = scratch(spark, "warc-test")
    wa.write_warc(wa.captures_to_records(pages), out, file_bytes=20_000)
    captures = wa.assemble(wa.read_warc(spark, out)).collect()
    assert sum(c.copies for c in captures) == len(rows)
    assert all(len(c.requests) == len(c.metadata) == 1 for c in captures)
    kept = {bytes(c.response.payload) for c in captures if c.response.type == "response"}
    assert kept == {(t or "").encode() for _, t in rows}
    assert all(c.response.declared_digest == c.response.payload_digest for c in captures if c.response.type == "response")


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert wa.op3_warc_transactions(spark, str(tmp_path)).count() == 0


def test_orphans_and_cut_records(spark):
    records = spark.createDataFrame(
        [("a", "request", "gone", None), ("b", "metadata", None, None), ("c", "response", None, None), ("d", "request", "c", None)],
        "record_id string, type string, concurrent_to string, refers_to string")
    got = {c.capture: (c.response is not None, len(c.requests), len(c.metadata)) for c in wa.assemble(records).collect()}
    assert got == {"gone": (False, 1, 0), "b": (False, 0, 1), "c": (True, 1, 0)}
    with pytest.raises(ValueError):
        list(wa.parse_records(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc"))
    with pytest.raises(ValueError):
        list(wa.parse_records(b"HTTP/1.1 200\r\n\r\n"))


def test_files_are_bounded_in_bytes(spark, tmp_path):
    pages = spark.range(60).selectExpr("id as page_id", "'http://a.example/' as url",
                                       "repeat(cast(id + 100 as string), if(id = 7, 300000, 6000)) as html").coalesce(2)
    wa.write_warc(wa.captures_to_records(pages), f"{tmp_path}/w", file_bytes=200_000)
    import glob
    import gzip
    sizes = [len(gzip.open(f).read()) for f in glob.glob(f"{tmp_path}/w/*.gz")]
    assert len(sizes) > 5 and sorted(sizes)[-2] <= 200_000 < max(sizes) < 910_000
    assert wa.read_warc(spark, f"{tmp_path}/w").count() == 180
