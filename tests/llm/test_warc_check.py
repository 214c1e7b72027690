"""Writing an archive fails if a digest stands for two payloads."""

from __future__ import annotations

import pytest

from ledgerloom.llm import warc

HELD = "digest string, payload binary, n long, sha1 string, other long"


def test_two_payloads_under_one_digest_fail_the_write(spark, tmp_path):
    rows = [("d", b"one", 3, "s1", 1), ("d", b"two", 3, "s2", 2), ("e", b"x", 1, "s3", 3)]
    with pytest.raises(Exception, match="two payloads under one digest"):
        warc.stored(spark.createDataFrame(rows, HELD)).write.parquet(str(tmp_path / "bad"))
    warc.stored(spark.createDataFrame(rows[1:] + rows[1:2], HELD)).write.parquet(str(tmp_path / "good"))
    assert spark.read.parquet(str(tmp_path / "good")).count() == 2


HOSTILE = ["http://x/\u0085WARC-Refers-To: <urn:page:77>", "http://x/\u2028WARC-Payload-Digest: sha1:AAAA", "http://x/\u2029a b%20\x00\x0c\r\nWARC-Type: revisit", "http://ü/日本?q=1&r=<2>", ""]


def test_urls_end_no_line(spark, tmp_path):
    rows = [(i, u, f"<p>{i}</p>") for i, u in enumerate(HOSTILE)]
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"), str(tmp_path / "w"))
    got = {r["page_id"]: r for r in warc.parsed(spark, str(tmp_path / "w")).collect()}
    assert {(r["record_type"], r["refers_to"], r["payload_bytes"]) for r in got.values()} == {("response", None, 8)} and set(got) == set(range(len(HOSTILE)))
    heads = {r["page_id"]: bytes(r["header"]).decode("ascii") for r in warc.headers(spark, str(tmp_path / "w")).collect()}
    assert "WARC-Target-URI: http://x/%C2%85WARC-Refers-To:%20<urn:page:77>\r\n" in heads[0]
    assert "WARC-Target-URI: http://%C3%BC/%E6%97%A5%E6%9C%AC?q=1&r=<2>\r\n" in heads[3]
    assert all(len(h.split("\r\n")) == len(heads[0].split("\r\n")) for h in heads.values())


def test_payloads_do_not_move_to_meet_their_headers(spark, tmp_path):
    rows = [(i, "u", f"<p>{i % 3}</p>") for i in range(9)]
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"), str(tmp_path / "w"))
    df = warc.records(spark, str(tmp_path / "w")).hint("merge")
    assert df.count() == 9
    plan = warc.headers(spark, str(tmp_path / "w")).join(warc.payloads(spark, str(tmp_path / "w")).hint("merge"), "digest")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_a_damaged_payload_fails_the_reading(spark, tmp_path):
    warc.write(spark.createDataFrame([(1, "u", "one"), (2, "u", "one")], "page_id long, url string, html string"), str(tmp_path / "w"))
    held = [(r["digest"], b"two", r["n"]) for r in warc.payloads(spark, str(tmp_path / "w")).collect()]
    buckets = next((tmp_path / "w" / "payloads").iterdir()).name
    warc._put(spark.createDataFrame(held, "digest string, payload binary, n long"), str(tmp_path / "v" / "payloads"), int(buckets))
    (tmp_path / "w" / "headers").rename(tmp_path / "v" / "headers")
    with pytest.raises(Exception, match="the archive is damaged"):
        warc.parsed(spark, str(tmp_path / "v")).collect()
