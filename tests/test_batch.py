"""Many calls, and many viewers' scopes, in one plan: the same as one after another."""

from __future__ import annotations

import json
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from parlance.operators import scope
from parlance.plans import batch, tools
from parlance.sources import schema

START = datetime(2025, 1, 1, tzinfo=timezone.utc)


def snowflake(when):
    return str((int(when.timestamp() * 1000) - schema.EPOCH_MS) << 22)


@pytest.fixture(scope="module")
def world(spark):
    rng = random.Random(6)
    users = [("u1", "alice", "Alice", None, None, False), ("u2", "bob", "", None, None, False), ("u3", "carol", None, None, None, False)]
    rows = []
    for i in range(260):
        when = START + timedelta(minutes=37 * i, seconds=i % 7)
        files = [("a", rng.choice(("x.PNG", "notes.pdf", "clip.mp4")), 1, "https://f", "p", rng.choice((None, "audio/ogg", "text/plain")), None, None, None)] if i % 4 == 0 else []
        embeds = [("Title Word", "rich", None, "https://e", None, None, None, None)] if i % 11 == 0 else []
        content = rng.choice(("plain talk", "a Question?", "see https://example.org/a", "word word WORD", "", None))
        mentions = [users[i % 3]] if i % 5 == 0 else []
        rows.append((snowflake(when), rng.choice(("1001", "1001", "1002", "gdm_a", "dm_alice")), "g", users[i % 3], content, when.strftime("%Y-%m-%dT%H:%M:%S.000Z"), None, files, embeds, mentions, None, i % 9 == 0))
    channels = [
        ("1001", 0, "general", None, "g", None, None, None), ("1002", 0, "", "t", "g", None, None, 1024), ("1003", 2, "voice", None, "g", None, None, 1024), ("1004", 5, "news", None, "g", None, None, 0), ("9999", 0, "far", None, "h", None, None, 1024),
        ("dm_alice", 1, None, None, None, ["me", "u1"], None, None), ("gdm_a", 3, None, None, None, ["u1", "u2", "zz"], None, None), ("gdm_b", 3, "b", None, None, ["u2"], None, None), ("dm_alone", 1, None, None, None, ["me"], None, None), ("odd", None, None, None, None, None, None, None),
    ]
    return tools.Tables(spark.createDataFrame(rows, schema.MESSAGE), spark.createDataFrame(channels, schema.CHANNEL), spark.createDataFrame(users, schema.USER), spark.createDataFrame([("g", "Guild", None, None)], schema.GUILD))


VIEWERS = [("me", c) for c in ("1001", "1002", "9999", "dm_alice", "gdm_a", "gdm_b", "dm_alone", "odd", "none")] + [(None, "dm_alice"), ("u1", "dm_alice")]


def test_scopes_of_many_viewers(spark, world):
    viewers = spark.createDataFrame([(i, v, c) for i, (v, c) in enumerate(VIEWERS)], "n int, viewer_id string, channel_id string")
    many = scope.resolved(viewers, world.channels, world.users, world.guilds)
    got = {r["n"]: r for r in many.collect()}
    reach = {}
    for r in scope.reachable(many, world.channels, "n").collect():
        reach.setdefault(r["n"], set()).add(r["channel_id"])
    targets = [r["id"] for r in world.channels.collect()] + ["none"]
    asked = many.crossJoin(spark.createDataFrame([(t,) for t in targets], "target string"))
    may = {(r["n"], r["target"]): r["allowed"] for r in scope.permitted(asked, world.channels, "target").collect()}
    for n, (viewer, channel) in enumerate(VIEWERS):
        one = scope.resolve(world.channels, world.users, world.guilds, channel, viewer)
        if one is None:
            assert n not in got
            continue
        assert {k: got[n][k] for k in one if k not in ("fail_open",)} == {k: v for k, v in one.items() if k != "fail_open"}
        want = {r["channel_id"] for r in scope.allowed(one, world.channels).collect()}
        assert reach[n] == want and {t for t in targets if may[n, t]} == want & set(targets)


CALLS = [
    ("1001", "search_messages", {"query": " WORD "}),
    ("1001", "search_messages", {"query": " WORD "}),
    ("1001", "search_messages", {"query": "word", "offset": 3, "sort_order": "asc"}),
    ("1001", "search_messages", {"query": "word", "offset": 500}),
    ("1001", "search_messages", {"query": "word", "sort_by": "relevance"}),
    ("1001", "search_messages", {"has": "image", "author_id": "u1"}),
    ("dm_alice", "search_messages", {"has": "sound", "channel_id": "gdm_a"}),
    ("gdm_a", "search_messages", {"has": "sticker"}),
    ("1002", "search_messages", {"date": "2025-01-03"}),
    ("1002", "search_messages", {"after_date": "2025-01-02T10:00:00Z", "before_date": "2025-01-04", "has": "file"}),
    ("1001", "search_messages", {"after_date": "no date", "before_date": "2024-01-01"}),
    ("1001", "search_messages", {"pinned": True}),
    ("1001", "search_messages", {"pinned": False, "mentions": "u2"}),
    ("1001", "search_messages", {"query": "nowhere", "has": "link"}),
    ("1001", "search_messages", {"query": "talk", "pinned": True, "mentions": "nobody"}),
    ("1001", "search_messages", {"channel_id": "9999"}),
    ("1001", "search_messages", {"channel_id": "1003"}),
    ("1001", "search_messages", {"query": "question", "all_in_scope": True}),
    ("dm_alice", "search_messages", {"all_in_scope": True, "query": "nowhere"}),
    ("1002", "fetch_recent_messages", {}),
    ("1001", "fetch_recent_messages", {"limit": 3, "channel_id": "1002"}),
    ("1001", "fetch_recent_messages", {"limit": -4}),
    ("9999", "fetch_recent_messages", {"limit": 1000}),
    ("gdm_a", "fetch_recent_messages", {"channel_id": "1001"}),
    ("1001", "fetch_surrounding_messages", {"message_id": "MID"}),
    ("1001", "fetch_surrounding_messages", {"message_id": "MID", "limit": 3}),
    ("1001", "fetch_surrounding_messages", {"message_id": "0"}),
    ("1002", "fetch_surrounding_messages", {}),
    ("1001", "fetch_recent_messages", "not json"),
]


def test_many_calls_equal_one_after_another(spark, world):
    some = world.messages.where("channel_id = '1001'").orderBy("id").collect()[40]["id"]
    rows = []
    for i, (channel, name, args) in enumerate(CALLS):
        rows.append((i, name, args if isinstance(args, str) else json.dumps(args).replace("MID", some), "me", channel))
    rows += [(900, "search_messages", "{}", "me", "none"), (901, "get_current_context", "{}", "me", "1001")]
    calls = spark.createDataFrame(rows, "call_id int, name string, arguments string, viewer_id string, channel_id string")
    got = {r["call_id"]: r["text"] for r in batch.answers(calls, world).collect()}
    assert got.pop(900) is None and 901 not in got and len(got) == len(CALLS)
    own = {}
    for i, name, args, viewer, channel in rows[: len(CALLS)]:
        if channel not in own:
            own[channel] = scope.resolve(world.channels, world.users, world.guilds, channel, viewer)
        assert got[i] == tools.call(name, args, world, own[channel]), (i, name, args)


def test_narrow_searches_meet_by_day(spark, world):
    calls = spark.createDataFrame([(i, "search_messages", json.dumps({"date": f"2025-01-0{i}"}), "me", "1001") for i in range(1, 6)], "call_id int, name string, arguments string, viewer_id string, channel_id string")
    own = batch._searches(batch.bound(calls, world))
    hits = batch.matches(own, own.select("search", F.col("asked").alias("channel_id")), world.messages)
    want = world.messages.where("channel_id = '1001' and timestamp >= '2025-01-01' and timestamp < '2025-01-06'").count()
    assert hits.count() == want > 0
    assert "_asked_day" in hits._jdf.queryExecution().optimizedPlan().toString()


def test_no_calls(spark, world):
    empty = spark.createDataFrame([], "call_id int, name string, arguments string, viewer_id string, channel_id string")
    assert batch.answers(empty, world).collect() == []
