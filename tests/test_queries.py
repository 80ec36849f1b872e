import pandas as pd
import pytest
from compare import rows_of_frame, rows_of_sql

from pagemill.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, name):
    assert rows_of_frame(catalogue.queries()[name](spark, sf_dir)) == rows_of_sql(catalogue.oracle_sql()[name], sf_dir)


def test_every_sql_has_a_query():
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_throttle_stream_equals_replay(spark, sf_dir):
    batch = {r["user_id"]: (r["delay"], r["concurrency"]) for r in catalogue.queries()["x9_throttle_replay"](spark, sf_dir).collect()}
    stream = {r["user_id"]: (r["delay"], r["concurrency"]) for r in catalogue.queries()["x9_stream_throttle"](spark, sf_dir).collect()}
    assert batch == stream


def test_chunks_hold_every_block(spark, sf_dir):
    blocks = catalogue.queries()["d10_html_blocks"](spark, sf_dir).filter("type != 'heading'")
    chunks = catalogue.queries()["d13_chunks"](spark, sf_dir)
    assert chunks.count() >= blocks.select("page_id").distinct().count()
    assert chunks.agg({"length": "max"}).first()[0] <= 6000


def test_numbers_like_years_are_no_editions(spark, tmp_path):
    rows = [(0, "https://a.org/en/2035"), (1, "https://a.org/en/7"), (4, "https://a.org/en/8/"), (9, "https://a.org/2031?x=1"), (12, "https://b.org")]
    pd.DataFrame([(*r, "") for r in rows], columns=["page_id", "url", "html"]).to_parquet(tmp_path / "pages.parquet")
    got = rows_of_frame(catalogue.queries()["w8_newest_edition"](spark, str(tmp_path)))
    assert got == rows_of_sql(catalogue.oracle_sql()["w8_newest_edition"], str(tmp_path)) and ("en", "a.org", "4", "2024") in got[1]


def test_name_match_keeps_every_row(spark, sf_dir):
    """Every supplier and customer is there, and its links are those of a plain comparison of rows."""
    rows = catalogue.queries()["j17_name_match"](spark, sf_dir).collect()
    sides = {k: [r for r in rows if r["side"] == k] for k in ("supplier", "customer")}
    assert [len(v) for v in sides.values()] == [spark.read.parquet(f"{sf_dir}/{t}.parquet").count() for t in sides]

    def match(x, y):
        x, y = set(x.split()), set(y.split())
        return x == y or (len(x) == 1 and x <= y) or (len(y) == 1 and y <= x)

    for r in sides["supplier"]:
        others = [o["name"] for o in sides["customer"] if match(r["name"], o["name"])]
        assert r["links"] == len(others) and r["matches"] == "; ".join(sorted(set(others)))
    assert sum(r["links"] for r in sides["supplier"]) == sum(r["links"] for r in sides["customer"]) > 0
