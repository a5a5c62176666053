import hashlib
import re

import pytest

from tonegauge.llm import warc_store as W
from tonegauge.llm.queries import ORACLE, op11_warc

SCHEMA = "page_id long, url string, html string, address string, n int, payload string"
LONG, OTHER = "<p>é&lt;</p>" * 200, "x" * W.SMALL
ROWS = [
    (1, "http://a/1", LONG), (5, "http://b/5?x=%41", LONG), (3, None, LONG), (2, "http://a/2\r\nX: y", "short"), (4, "", "short"), (6, "http://c", None),
    (7, "http://c", ""), (8, "u", OTHER), (9, "u", OTHER[:-1]), (9, "u", OTHER[:-1]), (None, "n", LONG), (None, "n", "z" * 5000), (10, "WARC/1.1\nWARC-Type: revisit", OTHER),
]


def make(spark, rows):
    return spark.createDataFrame([(*r, "clash", 0, "clash") for r in rows], SCHEMA).repartition(3)


def expected(rows):
    best = {}
    for i, _, html in rows:
        if i is not None:
            best[html or ""] = max(best.get(html or "", i), i)
    out = []
    for i, url, html in rows:
        data = (html or "").encode()
        first = best.get(html or "") if len(data) >= W.SMALL else None
        again = first is not None and i != first
        out.append((i, url, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("few", [1000, 3])
def test_round_trip(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(W, "_FEW", few)
    W.write(make(spark, ROWS), str(tmp_path / "a"))
    got = [(r.page_id, r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in W.read(spark, str(tmp_path / "a")).collect()]
    assert sorted(got, key=repr) == expected(ROWS)
    payloads = spark.read.parquet(str(tmp_path / "a/payloads")).collect()
    assert sorted(bytes(r.payload) for r in payloads) == sorted({(h or "").encode() for _, _, h in ROWS})
    whole = W.rebuild(spark, str(tmp_path / "a")).collect()
    assert sorted(bytes(r.payload) for r in whole) == sorted((h or "").encode() for _, _, h in ROWS)


def parse(data):
    """Records of a WARC file by their Content-Length alone."""
    while data:
        head, data = data.split(b"\r\n\r\n", 1)
        lines = head.decode().split("\r\n")
        assert lines[0] == "WARC/1.1"
        fields = dict(x.split(": ", 1) for x in lines[1:])
        n = int(fields["Content-Length"])
        block, end, data = data[:n], data[n: n + 4], data[n + 4:]
        assert end == b"\r\n\r\n"
        yield fields, block


def test_exported_files_are_warc(spark, tmp_path):
    W.write(make(spark, ROWS), str(tmp_path / "a"))
    W.export_files(spark, str(tmp_path / "a"), str(tmp_path / "out"))
    records = [r for f in (tmp_path / "out").glob("part-*") for r in parse(f.read_bytes())]
    assert len(records) == len(ROWS)
    for fields, block in records:
        http, body = block.split(b"\r\n\r\n", 1)
        if fields["WARC-Type"] == "response":
            assert fields["WARC-Payload-Digest"] == "sha1:" + hashlib.sha1(body).hexdigest()
            assert int(re.search(rb"Content-Length: (\d+)", http)[1]) == len(body)
        else:
            assert body == b"" and fields["WARC-Profile"] == W.PROFILE and fields["WARC-Refers-To"] in ("<urn:page:5>", "<urn:page:10>")


def test_damage_is_found(spark, tmp_path):
    W.write(make(spark, ROWS), str(tmp_path / "a"))
    payloads = spark.read.parquet(str(tmp_path / "a/payloads"))
    (tmp_path / "b").mkdir()
    spark.read.parquet(str(tmp_path / "a/records")).write.parquet(str(tmp_path / "b/records"))
    payloads.selectExpr("address", "concat(payload, X'00') AS payload").write.parquet(str(tmp_path / "b/payloads"))
    with pytest.raises(Exception, match="digest"):
        W.read(spark, str(tmp_path / "b")).collect()
    (tmp_path / "c").mkdir()
    spark.read.parquet(str(tmp_path / "a/records")).write.parquet(str(tmp_path / "c/records"))
    payloads.limit(2).write.parquet(str(tmp_path / "c/payloads"))
    with pytest.raises(Exception, match="header"):
        W.read(spark, str(tmp_path / "c")).collect()


def test_empty_table(spark):
    assert W.archived(make(spark, [])).collect() == []


def test_no_shuffle_holds_a_hot_payload(spark):
    """The light side of the join leaves out what the broadcast side holds."""
    left = spark.createDataFrame([("hot", i) for i in range(900)] + [(f"k{i}", i) for i in range(100)], "key string, v int")
    right = spark.createDataFrame([("hot", 1)] + [(f"k{i}", i) for i in range(50)], "key string, w int")
    rows = W.skewed_join(left, right, "key", left.groupBy("key").count().withColumnRenamed("count", "n"), 1000, "left")
    assert sorted((r.key, r.v, r.w) for r in rows.collect() if r.w is not None) == sorted(
        [("hot", i, 1) for i in range(900)] + [(f"k{i}", i, i) for i in range(50)])
    assert rows.count() == 1000


def test_query_against_sql(spark):
    import duckdb
    sf = "/root/testdata/sf0.001"
    duckdb.sql(f"CREATE OR REPLACE VIEW pages AS SELECT * FROM read_parquet('{sf}/pages.parquet')")
    want = duckdb.sql(ORACLE["op11_warc"]).fetchall()
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in op11_warc(spark, sf).collect()]
    assert sorted(got) == sorted(want)
