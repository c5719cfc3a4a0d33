"""The search index against scans, and rows around a row without whole channels in one task."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from parlance.functions.values import contains
from parlance.operators import index as index_module, retrieve
from parlance.operators.index import TextIndex
from parlance.operators.search import SearchOptions, found, shown
from parlance.plans import tools
from parlance.sources.schema import MESSAGE
from parlance.sources.tables import read

DATA = "/root/testdata/sf0.001"


def texts(spark, path, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    own = TextIndex(spark, str(path), "doc_id", lambda: [F.col("text")], lambda q: contains(F.col("text"), q.strip()))
    return own, df


def test_queries_of_all_lengths(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice("abcÄß ñ日\n.%_") for _ in range(rng.randrange(0, 40)))) for i in range(400)]
    rows += [(400, None), (401, ""), (402, "x"), (403, "xy"), (None, "abc"), (404, "Ab\x00c")]
    own, df = texts(spark, tmp_path / "i", rows)
    assert own.add(df) == 0
    for q in ("a", "ab", "abc", "Äß", "日", "%_", "b a", " cÄ ", "x", "xy", "xyz", "ccc", "ab\x00", "", None, "a" * 50, "\n.", "ñ日\n"):
        want = sorted(i for i, t in rows if i is not None and (not (q or "").strip() or (t is not None and q.strip().lower() in t.lower())))
        assert sorted(r["doc_id"] for r in own.matching(q).collect()) == want, q


def test_rows_added_later_replace_their_keys(spark, tmp_path):
    own, df = texts(spark, tmp_path / "i", [(1, "first word"), (2, "second word"), (3, "third")])
    own.add(df)
    own.add(df.where("doc_id = 2").withColumn("text", F.lit("changed")).unionByName(spark.createDataFrame([(9, "a further word")], "doc_id long, text string")))
    ids = lambda q: sorted(r["doc_id"] for r in own.matching(q).collect())
    assert ids("word") == [1, 9] and ids("chang") == [2] and ids("") == [1, 2, 3, 9] and ids("wo") == [1, 9]
    assert own.segments() == [(0, 1), (1, 1)]
    # a segment without its line in the table of segments doesn't count
    df.write.parquet(f"{own.path}/rows/segment=7")
    assert ids("") == [1, 2, 3, 9]
    own.add(df.where("false"))
    assert ids("word") == [1, 9]


def test_many_rows_are_joined_and_buckets_meet(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index_module, "BUCKET", 16)
    rows = [(i, f"number {i} is {'even' if i % 2 == 0 else 'odd'}") for i in range(300)]
    own, df = texts(spark, tmp_path / "i", rows)
    own.add(df)
    want = sorted(i for i, t in rows if "r 1" in t)
    for fetch, ranges in ((4096, 200), (4096, 3), (5, 200)):
        monkeypatch.setattr(index_module, "FETCH", fetch)
        monkeypatch.setattr(index_module, "RANGES", ranges)
        assert sorted(r["doc_id"] for r in own.matching("r 1").collect()) == want
    lists = spark.read.parquet(f"{own.path}/postings/segment=0")
    assert lists.agg(F.max("n")).collect()[0][0] < 50 and lists.select("bucket").distinct().count() == 19


def test_lists_are_made_before_the_shuffle(spark, tmp_path, monkeypatch):
    """Lists of a chunk hold each key once a gram, as spelled out row by row; rows of one gram meet in lists, not as rows."""
    rng = random.Random(6)
    rows = [(i, "".join(rng.choice("aÄ日😀\n\x00") for _ in range(rng.randrange(0, 60)))) for i in range(500)]
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([i * 7 % 5 for i, _ in rows], pa.int32()), pa.array([t + "\x00\x00" for _, t in rows])], ["k", "b", "t"])
    want = {}
    for i, t in rows:
        for g in {(t + "\x00\x00")[j : j + 3] for j in range(len(t))}:
            want.setdefault((g, i * 7 % 5), set()).add(i)
    for size in (4 << 20, 700, 1):
        monkeypatch.setattr(index_module, "CHUNK", size)
        got, n = {}, 0
        for out in index_module._lists(iter([batch.slice(0, 200), batch.slice(200)])):
            for r in out.to_pylist():
                own = got.setdefault((r["gram"], r["bucket"]), set())
                assert len(set(r["keys"])) == len(r["keys"]) and not own & set(r["keys"])
                own.update(r["keys"])
                n += 1
        assert got == want and (size < 1000 or n < sum(map(len, want.values())) / 2)


def test_keys_as_text(spark, tmp_path):
    df = spark.createDataFrame([(f"k{i}", f"text {i}") for i in range(30)], "id string, text string")
    own = TextIndex(spark, str(tmp_path / "i"), "id", lambda: [F.col("text")], lambda q: contains(F.col("text"), q))
    own.add(df)
    assert sorted(r["id"] for r in own.matching("text 1").collect()) == sorted(f"k{i}" for i in (1, *range(10, 20)))


def _read_bytes(spark) -> int:
    """Bytes that tasks have read so far."""
    context = spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty(20_000)
    stages = context.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(i).inputBytes() for i in range(stages.size()))


def test_a_search_reads_a_small_share(spark, tmp_path):
    """Without vectored reads, whose bytes Spark doesn't count, and read-ahead, which small files are shorter than."""
    rng = random.Random(8)
    rows = [(i, " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(300)) + (" needle in hay" if i % 97 == 0 else "")) for i in range(2000)]
    own, df = texts(spark, tmp_path / "i", rows)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("parquet.hadoop.vectored.io.enabled", "false")
    ahead = conf.get("io.file.buffer.size")
    conf.set("io.file.buffer.size", "4096")
    try:
        own.add(df)
        size = own.spark.read.parquet(f"{own.path}/rows/segment=0").agg(F.sum(F.octet_length("text"))).collect()[0][0]
        before = _read_bytes(spark)
        assert own.rows().where(contains(F.col("text"), "needle in")).count() == 21
        scanned = _read_bytes(spark) - before
        before = _read_bytes(spark)
        assert own.matching("needle in").count() == 21
        read = _read_bytes(spark) - before
        assert read < scanned / 10 and scanned > size / 4, (read, scanned, size)
    finally:
        conf.unset("parquet.hadoop.vectored.io.enabled")
        conf.set("io.file.buffer.size", ahead)


@pytest.fixture(scope="module")
def messages(spark):
    rng = random.Random(1)
    rows = []
    for i in range(200):
        author = (f"u{i % 5}", f"name{i % 5}", "Shown" if i % 3 else None, None, None, False)
        files = [("a", "holiday.png", 1, "u", "u", "image/png", None, None, None)] if i % 7 == 0 else []
        rows.append((str(1000 + i), f"c{i % 3}", None, author, rng.choice(("plain talk", "a Question", "nothing")), f"2025-01-01T12:{i // 60:02d}:{i % 60:02d}Z", None, files, [], [], None, False))
    return spark.createDataFrame(rows, MESSAGE)


def test_shown_over_an_index_equals_the_scan(spark, tmp_path, messages):
    own = TextIndex(spark, str(tmp_path / "i"))
    own.add(messages)
    for options in (SearchOptions(content="QUEST"), SearchOptions(content="holiday", channel_id="c1"), SearchOptions(content="name3", sort_order="asc", offset=5), SearchOptions(content="sh", author_id="u1"), SearchOptions(content="absent", channel_id="c0"), SearchOptions(content="plain", channel_id="c0", min_id="9000")):
        want = [(r["id"], r["fallback"]) for r in shown(messages, options).collect()]
        assert [(r["id"], r["fallback"]) for r in shown(messages, options, own.matching(options.content)).collect()] == want
        assert found(own.matching(options.content), options).count() == found(messages, options).count()


def around_plainly(rows, targets, limit):
    out = set()
    for channel, target in targets:
        own = sorted((t, i) for c, t, i in rows if c == channel)
        at = next((n for n, (_, i) in enumerate(own) if i == target), None)
        if at is not None:
            out |= {(target, i) for _, i in own[max(at - limit // 2, 0) : at - limit // 2 + limit]}
    return out


@pytest.mark.parametrize("limit", [1, 4, 11, 80])
def test_around_on_a_hot_channel(spark, limit):
    """One channel holds nearly all rows, many of them at one time."""
    rng = random.Random(limit)
    rows = [("hot", rng.choice((5, 5, rng.randrange(100))), i) for i in range(3000)] + [("cold", i % 4, 5000 + i) for i in range(20)] + [(None, 1, 9000)]
    df = spark.createDataFrame(rows, "channel_id string, ts long, id long")
    targets = [("hot", i) for i in range(0, 3000, 211)] + [("cold", 5003), ("cold", 77), ("none", 5)]
    got = retrieve.around(df, spark.createDataFrame(targets, "channel_id string, id long"), limit)
    assert sorted(got.columns) == ["channel_id", "id", "target", "ts"]
    assert {(r["target"], r["id"]) for r in got.collect()} == around_plainly(rows, targets, min(limit, 50))
    assert got.count() == len(around_plainly(rows, targets, min(limit, 50)))


def test_around_with_a_limit_of_each_target(spark):
    rows = [("a", i, i) for i in range(60)]
    df = spark.createDataFrame(rows, "channel_id string, ts long, id long")
    targets = spark.createDataFrame([("a", 10, 3), ("a", 10, 3), ("a", 20, 99), ("a", 30, 0)], "channel_id string, id long, many int")
    got = retrieve.around(df, targets, "many").collect()
    assert sorted(r["id"] for r in got if r["target"] == 10) == [9, 10, 11] and len([r for r in got if r["target"] == 20]) == 45 and not [r for r in got if r["target"] == 30]


def test_no_task_numbers_a_whole_channel(spark):
    df = spark.range(4000).select(F.lit("hot").alias("c"), (F.col("id") % 7).alias("ts"), "id")
    out = retrieve.numbered(df, "c", ("ts", "id"))
    rows = out.orderBy("ts", "id").collect()
    assert [r["place"] for r in rows] == list(range(1, 4001))
    windows = [x for x in out._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Window [" in x]
    # one inside ranges of rows, one over a row a range
    assert len(windows) == 2 and sum("__parlance_range" in w for w in windows) == 1 and sum("_group" in w for w in windows) == 1
    # the ranges that are numbered are of like size
    sizes = [r["n"] for r in out.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 4000


def test_limits_of_calls():
    assert [retrieve.asked_limit(x, 20) for x in (None, 0, "", "7", 7.9, -1, 10**9, "x", [1])] == [20, 20, 20, 7, 7, 1, 50, 20, 20]


def test_groups_count_without_meeting(spark):
    out = retrieve.as_groups(read(spark, DATA, "pages").select("page_id", F.struct("page_id").alias("messages")))
    assert "SinglePartition" not in out.select("page_id", "group")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString() and out.first()["total"] == out.count()


def test_recent_tool_is_bounded(spark, messages):
    none = spark.createDataFrame([], "id string, type int, name string, guild_id string, permissions long, recipients array<string>, topic string")
    world = tools.Tables(messages, none, None, None)
    scope = {"channelId": "c0", "channelName": "c0", "isGuild": False, "isDM": False}
    for limit, rows in ((-1, 1), (10**9, 50), (0, 20), (3, 3)):
        assert f"({rows} messages)" in tools.fetch_recent_messages(world, scope, {"limit": limit})
