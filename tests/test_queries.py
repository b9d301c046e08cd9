"""A sample of the registered queries against DuckDB on the smallest tables; tools_check.py runs all."""

import duckdb
import pytest

import __spark_entry__ as entry
import tools_check

SAMPLE = ["src1_seeds", "pg2_pg3_text_and_words", "lk1_lk4_lk6_lk10_discovered_links", "lk18_stored_structure", "mp5_mp7_site_maps", "ct2_phones",
          "bz1_industry", "bz8_bz9_price_extremes", "mk3_videos", "md6_clean_text", "rc4_rc5_map_links", "rc15_rc16_address_parts", "dd1_unique_pages"]


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_reference_sql(spark, sf, name):
    db = duckdb.connect()
    for t in tools_check.TABLES:
        db.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    rel = db.sql(entry.oracle_sql()[name])
    cols = sorted(rel.columns)
    df = entry.queries()[name](spark, sf)
    assert sorted(df.columns) == cols
    order = [rel.columns.index(c) for c in cols]
    want = sorted(tuple(tools_check.canon(r[i]) for i in order) for r in rel.fetchall())
    got = sorted(tuple(map(tools_check.canon, r)) for r in df.select(*cols).collect())
    assert got == want


def test_every_reference_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
