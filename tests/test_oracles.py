"""Every query with SQL against DuckDB on the smallest tables; the others run and keep their invariants."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

from scrubline.plans import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(SF_DIR):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF_DIR}/{f}'")
    return con


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return "nan" if math.isnan(v) else float(f"{float(v):.9g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_duckdb(name, spark, duck):
    df = QUERIES[name](spark, SF_DIR)
    want = duck.execute(ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    rows = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=repr)
    assert rows == sorted((tuple(plain(r[names.index(c)]) for c in order) for r in want.fetchall()), key=repr)


def test_pipeline_keeps_every_record(spark):
    out = QUERIES["clean_pipeline"](spark, SF_DIR).collect()
    assert len(out) == len({r["id"] for r in out}) == 150
    assert {r["route"] for r in out} <= {"done", "needs_review", "unsalvageable"}
    by = {r["id"]: r["group_id"] for r in out}
    assert all(by[g] == g for g in by.values())


def test_tickets_are_cleaned_by_their_configuration(spark):
    out = QUERIES["clean_tickets"](spark, SF_DIR).collect()
    names = {r["event_id"]: r["event_name"] for r in QUERIES["normalize_event_name"](spark, SF_DIR).collect()}
    assert {r["id"]: r["event_name"] for r in out} == names and len(out) == len(names)
    kinds = {r["product_id"]: r["ticket_category"] for r in QUERIES["categorize_product"](spark, SF_DIR).collect()}
    assert all(r["ticket_category"] == kinds[r["id"]] for r in out if r["id"] in kinds)
    by = {r["id"]: r["group_id"] for r in out}
    assert all(by[g] == g for g in by.values()) and len(set(by.values())) < len(by)


def test_report_adds_up(spark):
    assert sum(r["records"] for r in QUERIES["run_report"](spark, SF_DIR).collect()) == 150


def test_streams_equal_batches(spark):
    from pyspark.sql import functions as F

    from scrubline.operators import lookups
    from scrubline.streaming import feeds

    events = feeds.outcomes_of(spark.read.parquet(f"{SF_DIR}/events.parquet"))
    batch = {(r["domain"], r["url_host"]): r["trust_score"] for r in lookups.source_trust(events, ["ts", "event_id"]).collect()}
    stream = {(r["domain"], r["url_host"]): r["trust_score"] for r in QUERIES["stream_outcomes"](spark, SF_DIR).collect()}
    assert batch == stream
    counts = events.groupBy(F.to_date("ts").alias("d"), "gap_type").count().collect()
    want = {(r["d"], r["gap_type"]): r["count"] for r in counts}
    got = {(r["start"].date(), r["route"]): r["records"] for r in QUERIES["stream_route_counts"](spark, SF_DIR).collect()}
    assert got == want


def test_closest_country(spark):
    rows = {r["country"]: r for r in QUERIES["suggest_country"](spark, SF_DIR).collect()}
    assert rows["Canads"]["country_suggestion"] == "CA" and rows["Canads"]["country_code"] is None
    assert rows["Atlantis"]["country_suggestion"] is None


def test_resolution_sources(spark):
    assert {r["resolved_by"] for r in QUERIES["resolve_municipality"](spark, SF_DIR).collect()} <= {"cache", "boundary", "geocode", "review"}


def test_catalog_queries(spark):
    assert {r["column_name"] for r in QUERIES["discover_schema"](spark, SF_DIR).collect() if r["is_key"]} == {"o_orderkey", "c_custkey"}
    assert all(r["customer_there"] for r in QUERIES["table_exists"](spark, SF_DIR).collect())
    assert QUERIES["domain_config"](spark, SF_DIR).count() == 11
