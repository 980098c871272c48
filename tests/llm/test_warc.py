import hashlib

import pytest

from pelagos.llm import warc


def _run(spark, tmp_path, rows, split=None):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, extra string")
    path = str(tmp_path / "a")
    warc.write_archives(pages.coalesce(1), path)
    if split:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        return warc.archived_pages(spark, path).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


FAKE = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"


@pytest.mark.parametrize("split", [None, "700", "64"])
def test_round_trip(spark, tmp_path, split):
    same = "x" * 150
    rows = [(1, "http://a", same), (2, None, same), (3, "http://b\r\nWARC/1.0\r\n", "x" * 50), (4, "u", "x" * 50), (5, "u", None), (6, "u", ""),
            (7, "u", FAKE * 20), (8, "u", "pre" + FAKE + "WARC/1.0\r\n"), (9, "u", "WARC/1.0\r\n"), (10, "u", "é" * 3000), (None, "u", same), (0, "u", "last\r\n\r\n")]
    got = {r["page_id"]: r for r in _run(spark, tmp_path, [(*r, "e") for r in rows], split)}
    assert len(got) == len(rows)
    for i, _, html in rows:
        body = (html or "").encode()
        r = got[str(i) if i is not None else None]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(body), hashlib.sha256(body).hexdigest()), i
        revisit = i in (2, None)
        assert (r["record_type"], r["refers_to"]) == (("revisit", "1") if revisit else ("response", None))


def test_empty_table(spark, tmp_path):
    assert _run(spark, tmp_path, []) == []


def test_repeated_rows(spark, tmp_path):
    got = _run(spark, tmp_path, [(4, "u", "y" * 200, "e")] * 2 + [(5, "u", "y" * 200, "e")])
    assert sorted((r["page_id"], r["record_type"]) for r in got) == [("4", "response"), ("4", "response"), ("5", "revisit")]
    assert {r["payload_bytes"] for r in got} == {200}
