"""WARC round trips, splits at every byte, members that are none, damage, odd tables."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import zlib

import pytest

from siteweave.llm import warc
from siteweave.sources import files

PAGES = "page_id bigint, url string, html string, payload int, record_type string, sha string, salt int"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "clash", "s", 2) for r in rows], PAGES)


def plain(rows, least=0):
    """What reading back must give, one page after the other."""
    first = {}
    for i, _, html in rows:
        first[html or ""] = min(first.get(html or "", (True, 0)), (i is None, i or 0))
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        none, at = first[html or ""]
        revisit = len(data) >= least and not none and at != i
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", at if revisit else None))
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


ROWS = [(5, "http://a/1", "<p>x</p>"), (2, "http://a/2", "<p>x</p>"), (9, "http://a/ é\n?q=%20", "<p>x</p>"), (3, None, None), (4, "http://b", ""), (7, "u", "long " * 400_000),
        (8, "http://c", "日本\x1f«\r\n\r\nWARC/1.1\r\n"), (None, "http://d", "<p>x</p>"), (None, "e", "alone"), (None, "f", "alone"), (2, "http://a/2", "<p>x</p>")]


@pytest.mark.parametrize(("least", "split", "archive"), [(0, 64 << 20, 1 << 30), (0, 100, 300), (6, 997, 1), (9, 1 << 12, 1 << 30)])
def test_round_trip(spark, tmp_path, least, split, archive):
    path = f"file://{tmp_path}/w"
    warc.write(table(spark, ROWS).repartition(3), path, least=least, archive_bytes=archive)
    back = warc.read(spark, path, split_bytes=split)
    assert got(back) == plain(ROWS, least) and got(warc.read(spark, path, split, payload=False)) == plain(ROWS, least)
    texts = {bytes(r.payload).decode() for r in back.where("record_type = 'response'").collect()}
    assert texts == {h or "" for _, _, h in ROWS}
    if least == 0:
        assert {r.url for r in back.collect()} >= {"http://a/1", None, "http://a/%20%C3%A9%0A?q=%20"}
        r = back.where("page_id = 9").first()
        assert (r.refers_to, r.refers_to_url) == (2, "http://a/2")


def test_archives_are_plain_gzip(spark, tmp_path):
    warc.write(table(spark, ROWS[:3]), str(tmp_path / "w"))
    names = [p for p, _ in files.files(str(tmp_path / "w"), ".warc.gz")]
    text = b"".join(gzip.open(p).read() for p in names)
    assert text.count(b"WARC/1.1\r\nWARC-Type: response") == 1 and text.count(b"WARC-Type: revisit") == 2 and text.count(b"WARC-Type: warcinfo") == len(names)
    assert (tmp_path / "w" / "_SUCCESS").exists() and not [p for p in (tmp_path / "w").iterdir() if p.name.startswith("_temporary")]


def archive(pages, level=6):
    data = b""
    for i, html in pages:
        digest = base64.b32encode(hashlib.sha1(html).digest()).decode()
        row = {"record_type": "response", "page_id": i, "url": "u", "payload": html, "payload_bytes": len(html), "payload_digest": digest}
        data += b"".join(warc.member(warc.record(row, "d"), level))
    return data


def test_every_split_owns_its_records_once():
    """Members stored without compression hold whole archives inside, which no split may take for its own records."""
    inner = archive([(100, b"inner"), (101, b"more")])
    data = archive([(1, b"a" * 50), (2, inner + b"tail"), (3, b""), (4, inner), (5, warc.MAGIC * 30)], level=0)
    starts = [at for at, _ in warc.records(io.BytesIO(data), len(data), 0, len(data))]
    assert len(starts) == 5
    for cut in range(0, len(data) + 1, 3):
        a = [at for at, _ in warc.records(io.BytesIO(data), len(data), 0, cut)]
        b = [at for at, _ in warc.records(io.BytesIO(data), len(data), cut, len(data))]
        assert a + b == starts, cut


def test_a_long_archive_inside_a_record_is_never_read_as_records():
    inner = archive([(100 + i, b"inner") for i in range(warc.AHEAD + 10)], level=0)
    data = archive([(1, b"a"), (2, inner), (3, b"b")], level=0)
    assert len(list(warc.records(io.BytesIO(data), len(data), 0, len(data)))) == 3
    cut = data.index(inner) + 5
    with pytest.raises(ValueError, match="splitBytes"):
        list(warc.records(io.BytesIO(data), len(data), 0, cut))


def test_damage_is_an_error():
    data = archive([(i, f"page {i} ".encode() * 50) for i in range(5)])
    starts = [at for at, _ in warc.records(io.BytesIO(data), len(data), 0, len(data))]
    for broken in (data[: starts[2] + 30] + b"\0" + data[starts[2] + 31:], data[:-5], data[: starts[3]] + b"xx" + data[starts[3]:]):
        with pytest.raises(ValueError, match="damaged"):
            list(warc.records(io.BytesIO(broken), len(broken), 0, len(broken)))
    raw = zlib.decompress(data[starts[1]: starts[2]], 31)
    with pytest.raises(ValueError, match="digest"):
        warc.page(raw.replace(b"page 1", b"page X", 1))
    with pytest.raises(ValueError, match="long"):
        warc.page(raw[:-4])


def test_empty(spark, tmp_path):
    warc.write(table(spark, []), str(tmp_path / "w"))
    assert got(warc.read(spark, str(tmp_path / "w"))) == []


def test_failed_job_leaves_nothing(spark, tmp_path):
    from pyspark.sql import functions as F

    spark.dataSource.register(warc.WarcSource)
    rows = warc.described(table(spark, ROWS)).withColumn("page_id", F.when(F.col("page_id") == 8, F.raise_error(F.lit("stop"))).otherwise(F.col("page_id")))
    with pytest.raises(Exception, match="stop"):
        rows.write.format("warc").mode("append").save(str(tmp_path / "w"))
    assert files.files(str(tmp_path / "w")) == [] and not list(tmp_path.glob("w/_temporary*"))
