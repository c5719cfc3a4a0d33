"""Predicates, retrieval, scope, directory, rendering, tools, sessions and streaming over small nested rows."""

from __future__ import annotations

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parlance.functions import ids, text
from parlance.functions.render import mention_block, message_text
from parlance.operators import citations, directory, predicates as P, retrieve, scope, search, sessions
from parlance.plans import tools
from parlance.sources import schema, tables
from parlance.streaming import fold


def user(i, name, shown=None, avatar=None):
    return (i, name, shown, avatar, None, False)


def attachment(name, kind=None, url="https://f/x"):
    return ("a", name, 1, url, url, kind, None, None, None)


def embed(title=None, kind=None, description=None, url=None, image=None):
    return (title, kind, description, url, None, None, image, None)


def message(i, author, at, content, attachments=(), embeds=(), channel="ch_general", guild=None, mentions=(), pinned=False):
    return (i, channel, guild, author, content, at, None, attachments and list(attachments), embeds and list(embeds), list(mentions), None, pinned)


ALICE, BOB, CHARLIE = user("user_1", "alice", "Alice"), user("user_2", "bob"), user("user_3", "charlie", "")


@pytest.fixture(scope="module")
def four(spark):
    rows = [
        message("101", ALICE, "2025-01-01T12:00:00.000Z", "see https://example.org/a now"),
        message("102", BOB, "2025-01-01T12:05:00.000Z", "the specification is here", [attachment("spec.pdf", "application/pdf")]),
        message("103", CHARLIE, "2025-01-01T12:10:00.000Z", "a screenshot", [attachment("screenshot.png", "image/png")]),
        message("104", ALICE, "2025-01-01T12:15:00.000Z", "plain text"),
    ]
    return spark.createDataFrame(rows, schema.MESSAGE)


def ids_of(df):
    return sorted(r["id"] for r in df.collect())


@pytest.mark.parametrize(
    ("criteria", "want"),
    [
        ({"has": "link"}, ["101"]),
        ({"has": "file"}, ["102", "103"]),
        ({"has": "image"}, ["103"]),
        ({"has": "sticker"}, ["101", "102", "103", "104"]),
        ({"query": "specification"}, ["102"]),
        ({"query": " SCREENSHOT.PNG "}, ["103"]),
        ({"query": "%"}, []),
        ({"author_id": "user_1"}, ["101", "104"]),
        ({"query": "", "has": "link"}, ["101"]),
        ({"during_date": "2025-01-01"}, ["101", "102", "103", "104"]),
        ({"after_date": "2025-01-01T12:05:00Z", "before_date": "2025-01-01T12:10:00Z"}, ["102", "103"]),
        ({"before_date": "2025-01-01"}, []),
        ({"after_date": "never"}, ["101", "102", "103", "104"]),
    ],
)
def test_local_filter(four, criteria, want):
    assert ids_of(P.LocalFilter(**criteria).apply(four)) == want


def test_bad_day_is_an_error(four):
    with pytest.raises(ValueError):
        P.LocalFilter(during_date="soon").apply(four)


def test_media_of_odd_rows(spark):
    rows = [
        message("1", ALICE, None, None, [attachment("", "video/mp4", "https://f/y.JPG")]),
        message("2", ALICE, None, "x", [attachment("A.PNG")]),
        message("3", ALICE, None, "x", [attachment("", None, "https://f/a.png?x=1")]),
        message("4", ALICE, None, "x", (), [embed(kind="video", image=("u", None, None, None))]),
        message("5", ALICE, None, "x", [attachment("s.flac")], [embed(url="")]),
        message("6", None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, schema.MESSAGE)
    got = {k: ids_of(df.where(P.has(k))) for k in ("image", "video", "sound", "embed", "link", "file")}
    assert got == {"image": ["1", "2", "4"], "video": ["1", "4"], "sound": ["5"], "embed": ["4", "5"], "link": [], "file": ["1", "2", "3", "5"]}
    assert ids_of(df.where(~P.has("link"))) == ["1", "2", "3", "4", "5", "6"]


def test_snowflake(spark):
    df = spark.sql("SELECT timestamp'2023-08-18 12:00:00' AS t UNION ALL SELECT timestamp'2014-01-01' UNION ALL SELECT NULL UNION ALL SELECT timestamp'2099-01-01'")
    out = [r[0] for r in df.select(ids.snowflake(F.col("t"))).collect()]
    assert out[1:3] == ["0", "0"] and int(out[3]) > 0
    back = spark.createDataFrame([(out[0],), ("x",)], "i string").select(F.unix_millis(ids.snowflake_time(F.col("i")))).collect()
    assert back[0][0] == 1692360000000 and back[1][0] is None


@settings(max_examples=50, deadline=None)
@given(st.integers(0, 2**40))
def test_id_at_is_monotone(ms):
    from datetime import datetime, timedelta, timezone

    when = (datetime(2015, 1, 1, tzinfo=timezone.utc) + timedelta(milliseconds=ms)).isoformat()
    assert abs((search.id_at(when) >> 22) - ms) <= 1 and search.id_at(when, last=True) >= search.id_at(when)


def test_render(four):
    lines = {r["id"]: r["t"] for r in four.select("id", message_text(F.lit("general")).alias("t")).collect()}
    assert lines["102"] == "[2025-01-01 12:05:00] [#general] bob (user_2) [ID:102]: the specification is here\n  [Attachment: spec.pdf (application/pdf) - https://f/x]"
    assert " charlie (user_3) " in lines["103"] and " Alice (user_1) " in lines["101"]


def test_render_embeds(spark):
    df = spark.createDataFrame([message("1", None, None, None, None, [embed("t", url="u"), embed()])], schema.MESSAGE)
    assert df.select(message_text()).collect()[0][0] == '[] Unknown () [ID:1]: \n  [Embed: "t" - u]'


def test_merge_recent_around(spark, four):
    edited = four.where("id = '104'").withColumn("content", F.lit("new"))
    out = {r["id"]: r["content"] for r in retrieve.merged([four, edited]).collect()}
    assert out["104"] == "new" and len(out) == 4
    assert retrieve.merged([retrieve.merged([four, edited]), edited]).count() == 4
    timed = four.withColumn("ts", F.try_to_timestamp("timestamp"))
    assert ids_of(retrieve.recent(timed, 2)) == ["103", "104"]
    assert len(ids_of(retrieve.recent(timed, 0))) == 4 and ids_of(retrieve.recent(timed, -1)) == ["102", "103", "104"]
    target = lambda i: spark.createDataFrame([("ch_general", i)], "channel_id string, id string")
    assert ids_of(retrieve.around(timed, target("101"), 2)) == ["101"]
    assert ids_of(retrieve.around(timed, target("102"), 3)) == ["101", "102", "103"]
    assert ids_of(retrieve.around(timed, target("9"), 3)) == []


def test_hits_and_groups(spark):
    df = spark.createDataFrame([(1, 0, False, "a"), (1, 1, True, "b"), (2, 0, None, "c"), (2, 1, None, "d")], "group_id int, pos int, hit boolean, id string")
    assert ids_of(retrieve.hits(df)) == ["b", "c"]


@pytest.fixture(scope="module")
def world(spark, four):
    channels = spark.createDataFrame(
        [
            ("1001", 0, "general", None, "g", None, None, None), ("1002", 0, "", "t", "g", None, None, 1024), ("1003", 2, "voice", None, "g", None, None, 1024), ("1004", 5, "news", None, "g", None, None, 0), ("9999", 0, "far", None, "h", None, None, 1024),
            ("dm_alice", 1, None, None, None, ["me", "user_1"], None, None), ("gdm_a", 3, None, None, None, ["user_1", "user_2", "zz"], None, None), ("gdm_b", 3, "b", None, None, ["user_2"], None, None),
        ],
        schema.CHANNEL,
    )
    users = spark.createDataFrame([ALICE, BOB, CHARLIE], schema.USER)
    guilds = spark.createDataFrame([("g", "Guild", None, None)], schema.GUILD)
    messages = four.withColumn("channel_id", F.lit("1001")).withColumn("guild_id", F.lit("g"))
    return tools.Tables(messages, channels, users, guilds)


def test_scope(world):
    own = scope.resolve(world.channels, world.users, world.guilds, "1001")
    assert own["isGuild"] and own["guildName"] == "Guild"
    assert {r[0] for r in scope.allowed(own, world.channels).collect()} == {"1001", "1002"}
    assert not scope.is_allowed("9999", own, world.channels) and scope.is_allowed("1002", own, world.channels)
    closed = own | {"fail_open": False}
    assert {r[0] for r in scope.accessible(world.channels, "g", closed["fail_open"]).select("id").collect()} == {"1002"}
    dm = scope.resolve(world.channels, world.users, world.guilds, "dm_alice", "me")
    assert dm["channelName"] == "@Alice" and {r[0] for r in scope.allowed(dm, world.channels).collect()} == {"dm_alice", "gdm_a"}
    group = scope.resolve(world.channels, world.users, world.guilds, "gdm_a")
    assert {r[0] for r in scope.allowed(group, world.channels).collect()} == {"gdm_a"}
    named = scope.mutual_groups(world.channels, world.users, "user_1").collect()[0]
    assert named["name"] == "Group (Alice, bob, zz)"
    assert scope.resolve(world.channels, world.users, world.guilds, "none") is None


def test_tools(world):
    own = scope.resolve(world.channels, world.users, world.guilds, "1001")
    ask = lambda name, **args: tools.call(name, json.dumps(args), world, own)
    assert ask("nothing") == "Error: Unknown tool nothing."
    assert "Access denied" in ask("search_messages", channel_id="9999") and "Access denied" in ask("fetch_recent_messages", channel_id="9999")
    found = ask("search_messages", query="specification")
    assert found.startswith("Found 1 matching messages (search index):") and "[#general]" in found
    assert ask("search_messages", query="nowhere") == 'No messages found matching search criteria (Query: "nowhere") in channel #general.'
    fallback = ask("search_messages", query="screenshot", pinned=True)
    assert fallback.startswith("Found 1 matching messages in channel history:")
    assert "(4 messages)" in ask("fetch_recent_messages")
    assert "(3 messages)" in ask("fetch_surrounding_messages", message_id="102", limit=3)
    assert ask("fetch_surrounding_messages", message_id="0") == "No surrounding messages found around message ID 0."
    assert json.loads(ask("list_available_channels"))["guild"]["name"] == "Guild"
    assert json.loads(tools.call("get_current_context", "not json", world, own))["channelId"] == "1001"


def test_search_options(world):
    got = lambda **k: ids_of(search.found(world.messages, search.SearchOptions(**k)))
    assert got(min_id="102", max_id="103") == ["102", "103"]
    assert got(guild_id="g", author_id="user_1") == ["101", "104"]
    assert got(during="unreadable") == ["101", "102", "103", "104"]
    assert got(pinned=False) == ["101", "102", "103", "104"] and got(pinned=True) == []
    assert [r["id"] for r in search.shown(world.messages, search.SearchOptions(sort_order="asc", offset=1)).collect()] == ["102", "103", "104"]


def test_directory(spark, world):
    first = spark.createDataFrame([("user_1", "al", None)], "id string, username string, global_name string")
    own = directory.gathered(first, world.users)
    assert {r["id"]: r["username"] for r in own.collect()}["user_1"] == "al"
    assert [r["id"] for r in directory.suggested(own, "b").collect()] == ["user_2"]
    assert [r["id"] for r in directory.suggested(own).collect()][0] == "user_1"
    many = spark.createDataFrame([(f"{i:02}", f"{'x' if i % 2 else ''}ann{i}") for i in range(20)], "id string, username string")
    names = [r["username"] for r in directory.suggested(directory.gathered(many), "ann").collect()]
    assert len(names) == 8 and all(n.startswith("ann") for n in names)
    prompts = spark.createDataFrame([(1, "<@!user_1> <@123> @bob @everyone @char <@123>")], "prompt_id int, text string")
    found = {r["id"] for r in directory.prompt_mentions(prompts, world.users).collect()}
    assert found == {"123", "user_2", "user_3"}
    lines = [r["line"] for r in mention_block(world.users).orderBy("id").collect()]
    assert lines[0] == '- Alice (@alice) (ID: "user_1")' and lines[1] == '- @bob (ID: "user_2")'
    members = spark.createDataFrame([("user_2", "Bobby"), ("zz", None)], "user_id string, nick string")
    assert {r["id"]: r["username"] for r in directory.members(members, world.users).collect()}["zz"] == "Member"


def test_citations(spark, world):
    rows = citations.cited(world.messages, world.channels, {"channelName": "s"})
    out = {r["messageId"]: r for r in rows.collect()}
    assert out["101"]["channelName"] == "general" and out["101"]["guildId"] == "g" and out["103"]["authorName"] == "charlie"
    blank = world.messages.where("id = '102'").withColumn("content", F.lit(""))
    assert citations.cited(blank, world.channels).collect()[0]["content"] == "[spec.pdf]"
    assert citations.once([rows, rows]).count() == 4


def test_text(spark):
    one = lambda c: spark.range(1).select(c).collect()[0][0]
    assert one(text.open_mention(F.lit("hi @al"))) == "al" and one(text.open_mention(F.lit("a@b c"))) is None
    assert one(text.insert_mention(F.lit("hi @al"), F.lit("7"))) == "hi <@7> "
    assert one(text.mentioned_names(F.lit("mail a@b.c <@12>"))) == ["b.c", "12"]
    assert one(ids.message_url_parts(F.lit("https://x.com/channels/@me/12/34")))["guild_id"] is None
    assert one(ids.message_url_parts(F.lit("app://-/channels/1/2/3")))["message_id"] == "3"
    assert one(ids.clean_base(F.lit("http://a//"))) == "http://a/"
    kinds = [one(text.block_kind(F.lit(x))) for x in ("# a", "### a", "> q", "- b", "* b", "1. n", "---", " *** ", "", "t")]
    assert kinds == ["h1", "h3", "quote", "bullet", "bullet", "number", "rule", "rule", "blank", "text"]
    assert {one(text.block_kind(F.lit(x))) for x in (">x", "+ a", "  - a", "___", "-----", " ", "#a", "1.n")} == {"text"}
    assert one(text.inline_tokens(F.lit("a **b** `c`"), "bold")) == ["b"]
    minute = 60000
    labels = [one(text.relative_time(F.lit(0).cast("long"), F.lit(m * minute).cast("long"))) for m in (0, 5, 120, 1500, 4500, 20000)]
    assert labels == ["Just now", "5m ago", "2h ago", "Yesterday", "3d ago", "Jan 1"]
    assert one(text.arguments(F.lit("{bad"), "k long"))["k"] is None


def test_sources(spark):
    buckets = spark.sql("SELECT map('a', array(struct(struct('1' AS id, 'x' AS name) AS channel), struct(struct(cast(null AS string) AS id, 'y' AS name) AS channel)), 'b', array(struct(struct('2' AS id, 'z' AS name) AS channel))) AS buckets")
    assert ids_of(tables.flatten_buckets(buckets)) == ["1", "2"]
    assert tables.Settings.layered({"a": 1, "b": 2}, {"a": None, "b": 3}).values == {"a": 1, "b": 3}
    assert tables.lookup(spark.range(3), "id", None).count() == 0 and tables.lookup(spark.range(3), "id", 2).count() == 1


def test_sessions(spark, tmp_path):
    path = str(tmp_path / "s")
    for version in (("1", "c", 10), ("1", "c", 20), ("2", "c", 15), ("3", "d", 30)):
        sessions.append(sessions.new_session(spark, *version), path)
    sessions.append(sessions.tombstones(spark.createDataFrame([("2",)], "id string"), 40), path)
    versions = spark.read.parquet(path)
    assert [(r["id"], r["updatedAt"]) for r in sessions.for_channel(versions, "c").collect()] == [("1", 20)]
    assert ids_of(sessions.current(versions)) == ["1", "3"]
    steps = spark.createDataFrame([("a", "x", None), ("b", "y", None)], "id string, type string, result string")
    new = spark.createDataFrame([("b", "done")], "id string, result string")
    assert {r["id"]: r["result"] for r in sessions.steps_replaced(steps, new).collect()} == {"a": None, "b": "done"}


def _lines():
    call = lambda i, **k: {"index": i, **({"id": k["id"]} if "id" in k else {}), "function": {x: k[x] for x in ("name", "arguments") if x in k}}
    frame = lambda **d: "data: " + json.dumps({"choices": [{"delta": d}]}) + "\n"
    return [
        ": comment\n", "\n", frame(content="Hel"), frame(content="lo"), frame(tool_calls=[call(0, id="c0", name="sear"), call(1, id="c1", name="fetch")]),
        "data: {broken\n", frame(tool_calls=[call(0, name="ch", arguments='{"q":')]), frame(tool_calls=[call(1, arguments="{}"), call(0, name="ch", arguments='"x"}')]), "data: [DONE]\n", 'data: {"choices": [{"delta": {"content": "lost"}}]}',
    ]


def test_stream_fold(spark, tmp_path):
    rows = [("s", i, x) for i, x in enumerate(_lines())]
    lines = spark.createDataFrame(rows, schema.FRAGMENT)
    parts = fold.deltas(fold.payloads(lines))
    assert fold.contents(parts).collect()[0]["content"] == "Hello"
    batch = {r["idx"]: (r["call_id"], r["name"], r["arguments"]) for r in fold.folded(fold.fragments(parts)).collect()}
    assert batch == {0: ("c0", "search", '{"q":"x"}'), 1: ("c1", "fetch", "{}")}
    source = str(tmp_path / "in")
    for row in rows:
        spark.createDataFrame([row], schema.FRAGMENT).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema.FRAGMENT).option("maxFilesPerTrigger", 4).parquet(source)
    seen = {}
    each = lambda df, _: seen.update({r["idx"]: (r["call_id"], r["name"], r["arguments"]) for r in df.collect()})
    fold.pushed(fold.folded_stream(fold.fragments(fold.deltas(fold.payloads(stream)))), each, "fold", str(tmp_path / "state")).awaitTermination()
    assert seen == batch


def test_routing_and_prompt(spark, world):
    assert search.routed(search.SearchOptions(channel_id="1001"), world.channels).guild_id == "g"
    assert search.routed(search.SearchOptions(channel_id="none"), world.channels).guild_id is None
    with pytest.raises(ValueError):
        search.routed(search.SearchOptions(), world.channels)
    turns = spark.createDataFrame([("s", i, r, f"t{i}") for i, r in enumerate(["user", "assistant", "system", "user", "tool", "assistant", "user", "assistant"])], "session_id string, pos int, role string, content string")
    own = scope.resolve(world.channels, world.users, world.guilds, "1001")
    out = tools.prompt_turns(turns, "Be brief.", "now", own, world.users.where("id = 'user_1'"))
    assert [c for _, c in out[1:]] == ["t3", "t5", "t6", "t7", "now"] and "#general" in out[0][1] and "(@alice)" in out[0][1]


def test_settings(spark, tmp_path):
    path = str(tmp_path / "settings")
    tables.save_settings(spark.createDataFrame([("a", "1")], "key string, value string"), path)
    layers = [spark.createDataFrame([("a", "0"), ("b", "2")], "key string, value string"), spark.read.parquet(path)]
    assert {r["key"]: r["value"] for r in tables.layered_settings(layers).collect()} == {"a": "1", "b": "2"}


def test_filters_commute(four):
    a, b = P.LocalFilter(has="file"), P.LocalFilter(author_id="user_2")
    assert ids_of(P.LocalFilter(has="file", author_id="user_2").apply(four)) == ids_of(b.apply(a.apply(four)))


def test_data_urls_and_query_strings(spark):
    files = spark.createDataFrame([("a", bytearray(b"x" * 200)), ("b", bytearray())], "path string, content binary")
    out = {r["path"]: r["data_url"] for r in tables.data_url(files).collect()}
    assert out["b"] == "data:image/png;base64," and len(out["a"]) == 22 + 268 and not any(c.isspace() for c in out["a"])
    assert ids.query_string({"a": "x y&z", "b": None, "c": "", "d": 5, "e": False}) == "a=x+y%26z&d=5&e=False"


@pytest.mark.parametrize(
    ("content", "want"),
    [
        (None, []),
        ("", []),
        ("a\n\n# b", [("text", "a"), ("blank", ""), ("h1", "b")]),
        ("x ```py\n# no\n``` y", [("text", "x "), ("code", "# no\n"), ("text", " y")]),
        ("```one line```", [("blank", ""), ("code", "one line"), ("blank", "")]),
        ("```\n```", [("blank", ""), ("code", ""), ("blank", "")]),
        ("a\n```open\n- b", [("text", "a"), ("text", "```open"), ("bullet", "b")]),
        ("```", [("code", "")]),
        ("3. c ", [("number", "c ")]),
        ("```a```b```", [("blank", ""), ("code", "a"), ("text", "b```")]),
    ],
)
def test_blocks(spark, content, want):
    rows = spark.createDataFrame([(content,)], "c string").select(text.blocks(F.col("c")).alias("b")).collect()[0]["b"]
    assert [(r["kind"], r["text"]) for r in rows] == want
