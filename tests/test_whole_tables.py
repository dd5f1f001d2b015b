"""Queries over whole tables cover every key of them."""

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
import __spark_entry__ as entry
from corvane.streaming.logs import next_state

DATA = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables are not here")


def test_all_document_files(spark):
    got = entry.registry.queries()["s08_document_files"](spark, DATA).select("doc_id").distinct()
    want = spark.read.parquet(f"{DATA}/documents.parquet").where(r"text rlike '[^ \\n]'").select("doc_id")
    assert want.where("doc_id >= 20").count() > 0 and want.exceptAll(got).count() == 0


def test_alarms_of_all_users(spark):
    events = spark.read.parquet(f"{DATA}/events.parquet").toPandas().sort_values(["user_id", "ts", "event_id"])
    want, state = set(), {}
    for r in events.itertuples():
        run, paused = state.get(r.user_id, (0, False))
        run, paused, event = next_state(run, paused, r.value, 30.0, 5.0, 2)
        state[r.user_id] = run, paused
        want |= {(r.user_id, r.event_id, event)} if event else set()
    assert any(user >= 20 for user, _, _ in want)
    assert set(map(tuple, entry.registry.queries()["t04_alarm_hysteresis"](spark, DATA).collect())) == want


def test_holm_whole_families(spark):
    families = {}
    for r in spark.read.parquet(f"{DATA}/customer.parquet").select("c_custkey", "c_mktsegment").collect():
        families.setdefault(r.c_mktsegment, []).append((r.c_custkey % 50 / 1000, r.c_custkey))
    want = {}
    for family in families.values():
        want |= {k: None for _, k in family if k % 7 == 0}
        tests, high = sorted(x for x in family if x[1] % 7), 0.0
        for i, (p, k) in enumerate(tests):
            high = max(high, min(1.0, (len(tests) - i) * p))
            want[k] = high
    got = {r.c_custkey: r.p_holm for r in entry.registry.queries()["w09_holm"](spark, DATA).collect()}
    assert len(want) > 200 and got == pytest.approx(want, abs=1e-8)


def test_category_order_of_all(spark):
    orders = spark.read.parquet(f"{DATA}/orders.parquet").select("o_orderstatus", "o_orderpriority", "o_orderkey").collect()
    want = [(k, p) for _, p, k in sorted(("POF".index(s), p, k) for s, p, k in orders)]
    assert {s for s, _, _ in orders} == set("POF")
    assert list(map(tuple, entry.registry.queries()["o01_category_order"](spark, DATA).collect())) == want


def test_claims_of_odd_lines(spark, tmp_path):
    import duckdb

    long = "\n".join(f"{k} claim {k}" for k in range(15))
    rows = [(1, "0 zero\n10 one 1\n  blank 2 \n \n3\n\u00a0\u3000wide\u2003\n\u00a0\nlast 5"), (2, long), (3, ""), (4, None), (5, "0\n1\ntab\t"), (6, "a\n\nb"), (6, "a\n\nb"), (7, long), (7, long), (None, "x 0")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = db.sql(entry.registry.oracle_sql()["l19_claims"]).fetchall()
    assert (1, 0, "0 zero") in want and (1, 4, "wide") in want and sum(k == 7 for k, _, _ in want) == 12
    got = entry.registry.queries()["l19_claims"](spark, str(tmp_path))
    assert got.dtypes == [("doc_id", "bigint"), ("i", "int"), ("claim", "string")]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
