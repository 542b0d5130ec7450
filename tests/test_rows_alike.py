"""Queries against their SQL over rows that the tables of the other tests don't hold."""

from __future__ import annotations

import duckdb

from watchgrid import catalog

SF = "/root/testdata/sf0.001"


def results(spark, folder, name):
    """Rows of a query and of its SQL over the events of a folder."""
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    got = catalog.QUERIES[name](spark, str(folder))
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({catalog.ORACLES[name]})")
    return sorted(map(repr, map(tuple, got.collect()))), sorted(map(repr, want.fetchall()))


def events(folder, sql):
    duckdb.sql(f"COPY ({sql.format(events=f"'{SF}/events.parquet'")}) TO '{folder}/events.parquet'")
    return folder


def test_counters_read_twice_at_one_moment(spark, tmp_path):
    """Rows of one time and id, a third of them twice or three times, have the sums up to all of them."""
    twice = "SELECT * FROM {events} UNION ALL SELECT * FROM {events} WHERE event_id % 3 = 0 UNION ALL SELECT * REPLACE ('click' AS event_type, value + 1 AS value) FROM {events} WHERE event_id % 6 = 0"
    got, want = results(spark, events(tmp_path, twice), "cpu_usage")
    assert got == want


def test_no_ticks_no_usage(spark, tmp_path):
    """Every fifth reading adds no ticks to long sums of hundredths, which must stay as they are."""
    still = "SELECT * REPLACE (event_id + i * 10000 AS event_id, user_id % 3 AS user_id, CASE WHEN event_id % 5 = 0 THEN 0 ELSE value END AS value) FROM {events}, range(20) r(i)"
    folder = str(events(tmp_path, still))
    got = catalog.QUERIES["cpu_usage"](spark, folder)
    none = spark.read.parquet(f"{folder}/events.parquet").where("value = 0").selectExpr("event_id AS id")
    assert none.count() > 3000 and got.join(none, "id").where("usage is not null").count() == 0


def test_cards_of_alerts_told_twice(spark, tmp_path):
    """Listings of one id were mixed into one."""
    got, want = results(spark, events(tmp_path, "SELECT * FROM {events} UNION ALL SELECT * FROM {events} WHERE event_id % 3 = 0"), "card_assertions")
    assert got == want
