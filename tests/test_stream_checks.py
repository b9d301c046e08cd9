"""The registered stream queries over a page table that is a folder of files, and over one file."""

import collections

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from checks import load

HTML = '<a href="/x">x</a><a href="https://facebook.com/y">y</a>'


@pytest.fixture(params=["folder", "file"])
def tables(request, tmp_path):
    def rows(first, urls):
        return pa.table({"page_id": pa.array(range(first, first + len(urls)), pa.int64()), "url": urls, "html": [HTML] * len(urls)})

    parts = [rows(0, ["https://a.com/1", "https://a.com/2"]), rows(2, ["https://a.com/1", "https://b.com/1"])]
    path = tmp_path / "pages.parquet"
    if request.param == "folder":
        path.mkdir()
        for i, part in enumerate(parts):
            pq.write_table(part, path / f"part-000{i}.parquet")
    else:
        pq.write_table(pa.concat_tables(parts), path)
    return str(tmp_path)


def test_running_link_counts(spark, tables):
    rows = load()["st2_running_link_counts"][0](spark, tables).collect()
    assert {(r.site_id, r.link_type): r.links for r in rows} == {
        ("a.com", "internal"): 3, ("a.com", "social"): 3, ("b.com", "internal"): 1, ("b.com", "social"): 1}


def test_each_url_once(spark, tables):
    rows = load()["st1_each_url_once"][0](spark, tables).collect()
    assert collections.Counter(r.url for r in rows) == {"https://a.com/1": 1, "https://a.com/2": 1, "https://b.com/1": 1}
