"""Queries against their SQL on rows that the test tables hardly have."""

import datetime as dt

import pytest

import __spark_entry__


def both(spark, folder, name, tables):
    """Sorted rows of a query and of its SQL over small tables."""
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for table, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{table}.parquet")
        c.execute(f"create view {table} as select * from '{folder}/{table}.parquet/*.parquet'")
    got, want = __spark_entry__.queries()[name](spark, str(folder)).toPandas(), c.execute(__spark_entry__.oracle_sql()[name]).fetchdf()
    return tuple(sorted(map(repr, x[sorted(want.columns)].values.tolist())) for x in (got, want))


def test_seconds_around_the_limit(spark, tmp_path):
    limit = dt.datetime(2024, 1, 2)
    after = [-1_000_000, -500_001, -500_000, -499_999, -1, 0, 1, 499_999, 500_000, 999_999]
    # a user for each, so that no group hides another
    events = [(k, limit + dt.timedelta(microseconds=us), k, "click", 1.0, None) for k, us in enumerate(after)] + [(99, None, 99, "click", 1.0, None)]
    got, want = both(spark, tmp_path, "ev_even_seconds", {"events": (events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"), "customer": ([(1, 1)], "c_custkey long, c_nationkey int")})
    assert got == want and len(got) == 8


def test_words_that_share_a_separator(spark, tmp_path):
    texts = [
        "que que que que", "que,que,que,que", "que\nque que que", "que\nque que que que", "que\nque\nque que que", "ñqueñqueñ que que", "queñqueñqueñqueñque que que", "que€que que que", "que€€que€€que€€que", "que, que, que, que",
        "a que b.que.que c que", "que\U0001f600que que que", "que\U0001f600 que que que\n", "queque que que que", "the", "thé", "éthe\n", " que  que que que ", "que-que-que-que-que-que", "que-que-que-que-que-que-que", "-que- que -que-que-", "", None, "Que que que que", "que\0que que que",
    ]
    schema = "conv_id long, turn long, role string, text string"
    got, want = both(spark, tmp_path, "sc_conversations", {"conversations": ([(k, 0, "user", t) for k, t in enumerate(texts)], schema)})
    assert got == want and 5 < len(got) < len(texts)
