"""Snapshots of mixed shapes, and the session store with its index."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from parlance.operators import sessions
from parlance.sources import schema, variants


def channel(i, kind=0, **more):
    return {"id": i, "type": kind, "name": f"n{i}"} | more


def test_channels_of_all_shapes(spark):
    rows = [
        ("array", [channel("1"), channel("2")]),
        ("nested", [[channel("3")], channel("4"), [], [{"channel": channel("5")}]]),
        ("map", {"a": channel("6"), "b": {"channel": channel("7", recipients=["u", "v"])}}),
        ("buckets", {"a": [{"channel": channel("8")}, {"channel": None, **channel("9")}], "b": [channel("10", permissions=1024)]}),
        ("odd", [None, 5, "x", {"name": "no id"}, channel(""), channel(0), channel("0"), {"channel": {"id": None}}, channel(11)]),
        ("empty", {}),
        ("scalar", 7),
    ]
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in rows] + [("broken", "{"), ("null", None)], "shape string, raw string")
    out = variants.channels_of(variants.parsed(df, "raw"), "raw").collect()
    own = {}
    for r in sorted(out, key=lambda r: tuple(r["place"])):
        own.setdefault(r["shape"], []).append(r["id"])
    assert own == {"array": ["1", "2"], "nested": ["3", "4", "5"], "map": ["6", "7"], "buckets": ["8", "9", "10"], "odd": ["0", "11"]}
    by_id = {r["id"]: r for r in out}
    assert by_id["7"]["recipients"] == ["u", "v"] and by_id["10"]["permissions"] == 1024 and by_id["1"]["type"] == 0


def test_private_channels_take_the_first_source(spark):
    group, direct = channel("g", schema.GROUP_DM), channel("d", schema.DM)
    rows = [("a", {"x": group, "y": direct}, {"z": channel("no")}, [channel("no")]), ("b", None, {"x": direct}, None), ("c", None, None, [group, direct]), ("d", None, None, {"x": group}), ("e", None, None, None)]
    df = spark.createDataFrame([(k, *(json.dumps(x) for x in v)) for k, *v in rows], "k string, mutable string, private string, all string")
    for c in ("mutable", "private", "all"):
        df = variants.parsed(df, c)
    out = variants.private_channels(df)
    assert sorted((r["k"], r["id"]) for r in out.collect()) == [("a", "d"), ("a", "g"), ("b", "d"), ("c", "g")]


def test_cached_messages_of_all_shapes(spark):
    one = lambda i: {"id": i, "content": f"m{i}", "author": {"id": "u"}}
    rows = [("wrapped", {"_array": [one("1"), one("2")], "ready": True}), ("array", [one("3"), None, 4]), ("map", {"x": one("5")}), ("none", None)]
    df = variants.parsed(spark.createDataFrame([(k, json.dumps(v)) for k, v in rows], "k string, raw string"), "raw")
    out = variants.messages_of(df, "raw", "id string, content string, author struct<id:string>").collect()
    assert sorted((r["k"], r["id"], r["author"]["id"]) for r in out) == [("array", "3", "u"), ("map", "5", "u"), ("wrapped", "1", "u"), ("wrapped", "2", "u")]


def session(spark, rows):
    return spark.createDataFrame([(i, c, t, [], 0, None, False) for i, c, t in rows], schema.SESSION)


def test_session_store(spark, tmp_path):
    store = sessions.SessionStore(spark, str(tmp_path / "s"), f"sessions_{uuid.uuid4().hex[:8]}", buckets=8)
    ids = lambda c: [(r["id"], r["title"]) for r in store.for_channel(c).collect()]
    assert ids("c1") == [] and store.epoch() == 0
    store.save(session(spark, [(f"s{i}", f"c{i % 20}", "one") for i in range(200)]), F.lit(10))
    store.delete(spark.createDataFrame([("s41",)], "id string"), 11)
    want = [(f"s{i}", "one") for i in range(1, 200, 20) if i != 41]
    assert sorted(ids("c1")) == sorted(want)
    assert store.compact() == 1 and sorted(ids("c1")) == sorted(want)
    # a lookup reads one bucket of the snapshot
    formatted = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    plan = lambda df: df._jdf.queryExecution().explainString(formatted)
    # the planner prunes buckets either way, but only tells so of scans by bucket
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    assert "SelectedBucketsCount: 1 out of 8" in plan(store.snapshot().where("channelId = 'c1'"))
    assert "SelectedBucketsCount: 8 out of 8" in plan(store.snapshot())
    looked = plan(store.for_channel("c1"))
    spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    assert "PushedFilters" in looked and "channelId" in looked
    # another session doesn't know the table yet
    spark.sql(f"DROP TABLE {store.name}_1")
    assert sorted(ids("c1")) == sorted(want) and spark.catalog.tableExists(f"{store.name}_1")
    # saves and deletes after a snapshot count, and so do those of a writer that was at the epoch before
    store.save(session(spark, [("s1", "c1", "two"), ("new", "c1", "three")]), 20)
    store.delete(spark.createDataFrame([("s21",)], "id string"), 21)
    sessions.append(sessions.stamped(session(spark, [("late", "c1", "four")]), 19), f"{store.path}/log/epoch=0")
    now = [("s1", "two"), ("new", "three"), ("late", "four")]
    want = [x for x in want if x[0] not in ("s1", "s21")]
    assert sorted(ids("c1")[:2]) == sorted(now[:2]) and ids("c1")[2] == now[2] and sorted(ids("c1")[3:]) == sorted(want)
    for epoch in (2, 3, 4):
        assert store.compact() == epoch
        assert sorted(ids("c1")) == sorted(now + want) and store.snapshot().count() == 200
    store.delete(spark.createDataFrame([("s1",), ("s1",), ("nobody",)], "id string"), 30)
    assert ("s1", "two") not in ids("c1") and store.versions().where("id = 'nobody'").count() == 1
    assert store.compact() == 5 and store.snapshot().where("id = 's1'").count() == 0
