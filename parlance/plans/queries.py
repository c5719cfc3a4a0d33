"""Queries over the driver's tables, named by the ids of the operator inventory, and their SQL.

The driver's tables hold no chat history, so each query applies its operator to an analogous table: conversations as
messages (conversation: channel, role: author), events as timed messages, region, nation and customer as guild, channel
and user, lineitem and part as attachments of orders, page URLs as links, documents as a keyword corpus.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.functions import ids as I
from parlance.functions import text as X
from parlance.functions.render import message_line, message_text, stamp
from parlance.functions.values import contains, or_else
from parlance.operators import predicates as P
from parlance.operators import retrieve as R
from parlance.operators.sessions import current, for_channel
from parlance.sources.shared import own_folder
from parlance.sources.tables import conversation_messages, event_messages, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _same(name: str, make):
    """A query under another name."""

    def again(spark: SparkSession, sf_dir: str) -> DataFrame:
        return make(spark, sf_dir)

    again.__name__ = name
    return again


def query(sql: str | None = None):
    def register(make):
        QUERIES[make.__name__] = make
        if sql:
            ORACLES[make.__name__] = sql
        return make

    return register


_TURNS = "SELECT conv_id * 1000 + turn AS id, conv_id AS channel_id, turn, role AS author_id, coalesce(nullif(role, ''), 'Unknown') AS author_name, text AS content FROM conversations"
_LINE = "'[] [#' || channel_id || '] ' || author_name || ' (' || coalesce(author_id, '') || ') [ID:' || id || ']: ' || coalesce(content, '')"


def _chat(spark, sf_dir):
    """Conversations as messages and channels: those with a system turn are text channels of guild 1, others of guild 2."""
    none = F.lit(None).cast("string")
    turns = conversation_messages(spark, sf_dir)
    author = F.struct(F.col("author_id").alias("id"), F.col("author_name").alias("username"), none.alias("globalName"))
    files = F.lit(None).cast("array<struct<filename:string,content_type:string,url:string>>").alias("attachments")
    embeds = F.lit(None).cast("array<struct<title:string,description:string,url:string,type:string,image:string,thumbnail:string>>").alias("embeds")
    messages = turns.select(F.col("id").cast("string").alias("id"), F.col("channel_id").cast("string").alias("channel_id"), none.alias("guild_id"), author.alias("author"), "content", none.alias("timestamp"), files, embeds, F.lit(False).alias("pinned"))
    system = F.bool_or(F.coalesce(F.col("author_id") == "system", F.lit(False)))
    channels = turns.groupBy(F.col("channel_id").cast("string").alias("id")).agg(F.when(system, "1").otherwise("2").alias("guild_id"))
    return messages, channels.select("id", "id", "guild_id", F.lit(0).alias("type"), none.alias("topic"), F.lit(1024).cast("long").alias("permissions")).toDF("id", "name", "guild_id", "type", "topic", "permissions")


_SYSTEM = "SELECT conv_id FROM conversations WHERE role = 'system'"


@query(f"""
SELECT id, channel_id, content, {_LINE} AS line FROM ({_TURNS})
WHERE channel_id IN ({_SYSTEM}) AND (contains(lower(content), 'le') OR contains(lower(author_name), 'le'))
ORDER BY id DESC LIMIT 15""")
def tvf3_search_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: all channels that a guild's scope allows, searched for a keyword; the newest 15, rendered."""
    from parlance.operators.scope import allowed, restrict
    from parlance.operators.search import SearchOptions, shown

    messages, channels = _chat(spark, sf_dir)
    scope = {"channelId": "-1", "isGuild": True, "guildId": "1"}
    rows = shown(restrict(messages, allowed(scope, channels)), SearchOptions(content=" LE "))
    line = message_text(F.col("channel_id"))
    return rows.select(F.col("id").cast("long").alias("id"), F.col("channel_id").cast("long").alias("channel_id"), "content", line.alias("line"))


tvf3_search_system_scope = query(ORACLES["tvf3_search_messages"])(_same("tvf3_search_system_scope", tvf3_search_messages))


@query("""
SELECT event_id AS id, true AS fallback FROM (SELECT event_id, ts, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS rn FROM events WHERE event_type = 'click')
WHERE rn <= 50 AND event_id % 2 = 0 ORDER BY ts DESC, id DESC LIMIT 10""")
def tvf3_fallback(spark, sf_dir):
    """A search whose ids rule out every match, so that it falls back to the newest rows of the channel."""
    from parlance.operators.search import SearchOptions, shown

    none = F.lit(None).cast("string")
    own = read(spark, sf_dir, "events")
    parity = F.when(F.col("event_id") % 2 == 0, "even").otherwise("odd")
    files = F.lit(None).cast("array<struct<filename:string,content_type:string,url:string>>").alias("attachments")
    embeds = F.lit(None).cast("array<struct<title:string,description:string,url:string>>").alias("embeds")
    messages = own.select(F.lpad(F.col("event_id").cast("string"), 12, "0").alias("id"), F.col("event_type").alias("channel_id"), F.struct(parity.alias("id"), none.alias("username"), none.alias("globalName")).alias("author"), F.col("props").alias("content"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"), files, embeds, F.lit(False).alias("pinned"))
    rows = shown(messages, SearchOptions(channel_id="click", author_id="even", min_id="9000000000000"))
    return rows.select(F.col("id").cast("long").alias("id"), "fallback")


_EDITED = "SELECT doc_id, CASE WHEN lang = 'de' THEN upper(text) || ' (edited)' ELSE text END AS text FROM documents"


@query(f"SELECT q AS query, doc_id FROM ({_EDITED}), (SELECT unnest(['license', 'LE', 'q', '(Edited)', 'no such run', 'tion of ']) AS q) WHERE contains(lower(text), lower(trim(q)))")
def src1_index_search(spark, sf_dir):
    """Documents in an index, those in German added once more as edited; searches of all lengths by posting lists."""
    from parlance.operators.index import TextIndex

    own = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    index = TextIndex(spark, own_folder(spark, "index"), "doc_id", lambda: [F.col("text")], lambda q: contains(F.col("text"), q.strip()))
    index.add(own)
    index.add(own.where("lang = 'de'").withColumn("text", F.concat(F.upper("text"), F.lit(" (edited)"))))
    asked = [index.matching(q).select(F.lit(q).alias("query"), "doc_id") for q in ("license", "LE", "q", "(Edited)", "no such run", "tion of ")]
    return reduce(DataFrame.unionByName, asked)


@query(ORACLES["tvf3_search_messages"])
def src1_index_shown(spark, sf_dir):
    """The flagship's search over an index of all messages."""
    from parlance.operators.index import TextIndex
    from parlance.operators.scope import allowed, restrict
    from parlance.operators.search import SearchOptions, shown

    messages, channels = _chat(spark, sf_dir)
    index = TextIndex(spark, own_folder(spark, "index"))
    index.add(messages)
    reach = allowed({"channelId": "-1", "isGuild": True, "guildId": "1"}, channels)
    options = SearchOptions(content=" LE ")
    rows = shown(restrict(messages, reach), options, restrict(index.matching(options.content), reach))
    return rows.select(F.col("id").cast("long").alias("id"), F.col("channel_id").cast("long").alias("channel_id"), "content", message_text(F.col("channel_id")).alias("line"))


@query("SELECT event_id, user_id FROM events WHERE user_id = 7")
def prd1_author(spark, sf_dir):
    return event_messages(spark, sf_dir).where(P.author(F.col("user_id"), 7)).select("event_id", "user_id")


@query("SELECT event_id, user_id FROM events WHERE cast(ts AS date) = DATE '2024-01-05'")
def prd2_during(spark, sf_dir):
    return event_messages(spark, sf_dir).where(P.during(F.col("ts"), "2024-01-05")).select("event_id", "user_id")


@query("SELECT event_id, user_id FROM events WHERE ts >= TIMESTAMP '2024-01-03 00:00:00' AND ts <= TIMESTAMP '2024-01-06 12:00:00'")
def prd3_4_range(spark, sf_dir):
    own = event_messages(spark, sf_dir)
    return own.where(P.after(F.col("ts"), "2024-01-03") & P.before(F.col("ts"), "2024-01-06T12:00:00Z") & P.after(F.col("ts"), "no date")).select("event_id", "user_id")


@query("SELECT page_id, url FROM pages WHERE regexp_matches(url, '(?i)https?://[^\\s]+')")
def prd5_link(spark, sf_dir):
    own = read(spark, sf_dir, "pages").withColumn("content", F.col("url")).withColumn("embeds", F.lit(None).cast("array<struct<url:string,title:string,description:string>>"))
    return own.where(P.has("link")).select("page_id", "url")


def _orders_with_parts(spark, sf_dir):
    """Orders with their parts as attachments (file name and type)."""
    parts = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_type", "p_brand")
    lines = read(spark, sf_dir, "lineitem").join(parts, "l_partkey")
    kind = F.concat(F.when(F.col("p_brand") == "Brand#1", "image/").when(F.col("p_brand") == "Brand#2", "video/").otherwise("other/"), F.lower("p_type"))
    item = F.struct(F.concat("p_name", F.when(F.col("l_partkey") % 5 == 0, ".PNG").when(F.col("l_partkey") % 5 == 1, ".mp3").otherwise(".txt")).alias("filename"), kind.alias("content_type"), F.lit(None).cast("string").alias("url"))
    return lines.groupBy("l_orderkey").agg(F.collect_list(item).alias("attachments")).withColumn("embeds", F.lit(None).cast("array<struct<image:string,thumbnail:string,type:string>>"))


_KIND = "CASE WHEN p_brand = 'Brand#1' THEN 'image/' WHEN p_brand = 'Brand#2' THEN 'video/' ELSE 'other/' END"
_NAME = "p_name || CASE WHEN l_partkey % 5 = 0 THEN '.PNG' WHEN l_partkey % 5 = 1 THEN '.mp3' ELSE '.txt' END"
_ITEMS = f"SELECT l_orderkey, {_KIND} AS kind, {_NAME} AS filename FROM lineitem JOIN part ON p_partkey = l_partkey"


@query(f"""
SELECT l_orderkey,
  bool_or(kind = 'image/' OR regexp_matches(filename, '(?i)\\.(png|jpg|jpeg|webp|gif|bmp|svg)$')) AS image,
  bool_or(kind = 'video/' OR regexp_matches(filename, '(?i)\\.(mp4|webm|mov|mkv|avi)$')) AS video,
  bool_or(regexp_matches(filename, '(?i)\\.(mp3|wav|ogg|m4a|flac|aac)$')) AS sound,
  true AS file, false AS embed, true AS sticker
FROM ({_ITEMS}) GROUP BY l_orderkey""")
def prd6_11_media(spark, sf_dir):
    own = _orders_with_parts(spark, sf_dir)
    return own.select("l_orderkey", *(P.has(k).alias(k) for k in ("image", "video", "sound", "file", "embed", "sticker")))


@query("SELECT conv_id, turn FROM conversations WHERE contains(lower(text), 'tion')")
def prd12_keyword(spark, sf_dir):
    return read(spark, sf_dir, "conversations").where(contains(F.col("text"), "TION")).select("conv_id", "turn")


@query("SELECT doc_id, lang FROM documents WHERE contains(lower(text), 'license')")
def prd12_documents(spark, sf_dir):
    return read(spark, sf_dir, "documents").where(contains(F.col("text"), "license")).select("doc_id", "lang")


_FLAKE = "greatest(((epoch_us(ts) // 1000) - 1420070400000) * 4194304, 0)"


@query(f"SELECT event_id, {_FLAKE} AS id FROM events WHERE {_FLAKE} >= (epoch_ms(TIMESTAMP '2024-01-05') - 1420070400000) * 4194304 AND {_FLAKE} < (epoch_ms(TIMESTAMP '2024-01-06') - 1420070400000) * 4194304")
def prd13_14_id_range(spark, sf_dir):
    own = event_messages(spark, sf_dir).withColumn("id", I.snowflake(F.col("ts")))
    return own.where(P.id_day(F.col("id"), "2024-01-05") & P.id_range(F.col("id"), "1", None)).select("event_id", F.col("id").cast("long").alias("id"))


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
def prd15_pinned(spark, sf_dir):
    own = read(spark, sf_dir, "orders")
    return own.where(P.pinned(F.col("o_orderstatus") == "F", True) & P.pinned(F.col("o_orderstatus") == "F", None)).select("o_orderkey", "o_orderstatus")


@query("SELECT DISTINCT l_orderkey FROM lineitem WHERE l_suppkey = 3")
def prd16_mentions(spark, sf_dir):
    own = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_suppkey").cast("string").alias("id"))).alias("mentions"))
    return own.where(P.mentions("3")).select("l_orderkey")


@query("SELECT p_partkey, p_size IN (0, 5, 11, 12, 15) AS text_channel, (p_size * 512) & 1024 <> 0 AS viewable FROM part")
def prd18_19_channels(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", P.text_channel(F.col("p_size")).alias("text_channel"), P.viewable(F.col("p_size").cast("long") * 512).alias("viewable"))


@query("SELECT DISTINCT l_orderkey FROM lineitem WHERE l_suppkey = 5 AND l_orderkey % 3 = 0")
def prd20_shared(spark, sf_dir):
    own = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.col("l_suppkey").cast("string")).alias("recipients"))
    own = own.withColumn("type", F.when(F.col("l_orderkey") % 3 == 0, 3).otherwise(1))
    return own.where(P.group_with("5")).select("l_orderkey")


@query("SELECT c_custkey, c_name FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'ASIA')")
def prd21_scope(spark, sf_dir):
    nations = read(spark, sf_dir, "nation").join(F.broadcast(read(spark, sf_dir, "region").where("r_name = 'ASIA'")), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("channel_id"))
    from parlance.operators.scope import restrict

    return restrict(read(spark, sf_dir, "customer").withColumnRenamed("c_nationkey", "channel_id"), nations).select("c_custkey", "c_name")


@query("SELECT s_suppkey, s_name FROM supplier WHERE contains(lower(s_name), '00001') OR s_suppkey = 1")
def prd23_mention_match(spark, sf_dir):
    own = read(spark, sf_dir, "supplier").select(F.col("s_suppkey"), "s_name", F.col("s_name").alias("username"), F.lit(None).cast("string").alias("globalName"), F.col("s_suppkey").cast("string").alias("id"))
    return own.where(P.mention_match("00001") | P.mention_match("1") & (F.col("id") == "1")).select("s_suppkey", "s_name")


@query("SELECT c_custkey, c_name, coalesce(n_name, 'channel') AS channel_name, r_name AS guild_name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey")
def join1_lookup(spark, sf_dir):
    nations = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return read(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", "c_name", or_else(F.col("n_name"), "channel").alias("channel_name"), F.col("r_name").alias("guild_name"))


@query("SELECT conv_id, string_agg(role, ', ' ORDER BY turn) AS names FROM conversations GROUP BY conv_id")
def join2_recipients(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("x"))
    return rows.select("conv_id", F.array_join(F.col("x.role"), ", ").alias("names"))


@query("""
SELECT id, any_value(content) AS content FROM (
  SELECT id, content || ' (edited)' AS content FROM ({t}) WHERE id % 2 = 0
  UNION ALL SELECT id, content FROM ({t}) WHERE id % 2 <> 0) GROUP BY id""".format(t=_TURNS))
def agg2_merge(spark, sf_dir):
    cached = conversation_messages(spark, sf_dir).select("id", "content")
    fetched = cached.where("id % 2 = 0").withColumn("content", F.concat("content", F.lit(" (edited)")))
    return R.merged([cached, fetched])


@query("""
SELECT id, username FROM (
  SELECT cast(c_custkey AS varchar) AS id, c_name AS username FROM customer
  UNION ALL SELECT cast(s_suppkey AS varchar), s_name FROM supplier WHERE s_suppkey NOT IN (SELECT c_custkey FROM customer))""")
def agg3_directory(spark, sf_dir):
    from parlance.operators.directory import gathered

    first = read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("username"))
    second = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("username"))
    return gathered(first, second).select("id", "username")


@query("""
SELECT id, username FROM (
  SELECT 'c' || c_custkey AS id, c_name AS username FROM customer UNION ALL SELECT 's' || s_suppkey, s_name FROM supplier)
WHERE contains(lower(username), '0002') ORDER BY CASE WHEN starts_with(lower(username), '0002') THEN 0 ELSE 1 END, username, id LIMIT 8""")
def top3_users(spark, sf_dir):
    from parlance.operators.directory import gathered, suggested

    first = read(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.col("c_name").alias("username"))
    second = read(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.col("s_name").alias("username"))
    return suggested(gathered(first, second), "0002").select("id", "username")


@query("SELECT conv_id, count(DISTINCT role) AS n_roles, count(*) AS n_turns FROM conversations GROUP BY conv_id")
def agg5_8_counts(spark, sf_dir):
    own = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_set("role").alias("roles"), F.count("*").alias("n_turns"))
    return own.select("conv_id", F.size("roles").cast("long").alias("n_roles"), "n_turns")


@query("SELECT conv_id, string_agg(text, '' ORDER BY turn) AS content FROM conversations GROUP BY conv_id")
def agg6_7_concat(spark, sf_dir):
    from parlance.streaming.fold import contents

    return contents(read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("stream_id"), F.col("turn").alias("seq"), F.col("text").alias("content"))).withColumnRenamed("stream_id", "conv_id")


@query("SELECT doc_id, n_chars, count(*) OVER () AS total FROM documents WHERE lang = 'en' ORDER BY n_chars DESC, doc_id LIMIT 10")
def agg1_counted(spark, sf_dir):
    own = read(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id", "n_chars")
    return R.counted(own, [F.desc("n_chars"), F.col("doc_id")], 10)


@query("SELECT DISTINCT conv_id FROM conversations WHERE role = 'system'")
def agg9_exists(spark, sf_dir):
    own = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.bool_or(F.col("role") == "system").alias("found"))
    return own.where("found").select("conv_id")


@query(f"SELECT id, channel_id FROM ({_TURNS}) QUALIFY row_number() OVER (PARTITION BY channel_id ORDER BY turn DESC, id DESC) <= 3")
def win2_recent(spark, sf_dir):
    return R.recent(conversation_messages(spark, sf_dir), 3, order=("turn", "id")).select("id", "channel_id")


@query(f"""
WITH n AS (SELECT *, row_number() OVER (PARTITION BY channel_id ORDER BY turn, id) AS rn FROM ({_TURNS}))
SELECT a.id, a.channel_id, b.id AS target FROM n a JOIN n b ON a.channel_id = b.channel_id AND b.turn = 3 AND a.rn BETWEEN b.rn - 2 AND b.rn + 1""")
def win1_around(spark, sf_dir):
    own = conversation_messages(spark, sf_dir)
    return R.around(own, own.where("turn = 3").select("channel_id", "id"), 4, order=("turn", "id")).select("id", "channel_id", "target")


def _lines(rows: DataFrame, *keys: str) -> DataFrame:
    """The rendered rows of each key, oldest first; callers keep few rows a key."""
    line = message_line(F.lit(None).cast("timestamp"), F.col("channel_id").cast("string"), F.col("author_name"), F.col("author_id"), F.col("id"), F.col("content"))
    told = F.sort_array(F.collect_list(F.struct("turn", "id", line.alias("line"))))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(told, lambda x: x["line"]), "\n").alias("text"))


@query(f"""
WITH n AS (SELECT *, row_number() OVER (PARTITION BY channel_id ORDER BY turn, id) AS rn FROM ({_TURNS})), a AS (
  SELECT a.*, b.id AS target FROM n a JOIN n b ON a.channel_id = b.channel_id AND b.turn = 2 AND a.rn BETWEEN b.rn - 1 AND b.rn + 1)
SELECT target, string_agg({_LINE}, chr(10) ORDER BY turn, id) AS text FROM a GROUP BY target""")
def tvf4_surrounding(spark, sf_dir):
    own = conversation_messages(spark, sf_dir)
    return _lines(R.around(own, own.where("turn = 2").select("channel_id", "id"), 3, order=("turn", "id")), "target")


@query(f"""
WITH n AS (SELECT *, row_number() OVER (PARTITION BY channel_id ORDER BY turn DESC, id DESC) AS rn FROM ({_TURNS}))
SELECT channel_id, string_agg({_LINE}, chr(10) ORDER BY turn, id) AS text FROM n WHERE rn <= 5 GROUP BY channel_id""")
def tvf5_recent(spark, sf_dir):
    return _lines(R.recent(conversation_messages(spark, sf_dir), 5, order=("turn", "id")), "channel_id")


@query("""
SELECT cast(n_nationkey AS varchar) AS id,
  CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE 'Group (' || string_agg(s_name, ', ' ORDER BY s_suppkey) || ')' END AS name,
  string_agg(s_name, '|' ORDER BY s_suppkey) AS recipients
FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey, n_name HAVING bool_or(s_suppkey = 7)""")
def prj4_mutual_groups(spark, sf_dir):
    """Suppliers of one nation as a group conversation; every other one has no name of its own."""
    from parlance.operators.scope import mutual_groups
    from parlance.sources.schema import GROUP_DM

    supplier = read(spark, sf_dir, "supplier")
    recipients = supplier.groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.sort_array(F.collect_list("s_suppkey")).cast("array<string>").alias("recipients"))
    groups = read(spark, sf_dir, "nation").join(recipients, "n_nationkey").select(F.col("n_nationkey").cast("string").alias("id"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).alias("name"), F.lit(GROUP_DM).alias("type"), "recipients")
    users = supplier.select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("username"), F.lit("").alias("globalName"))
    return mutual_groups(groups, users, "7").select("id", "name", F.array_join("recipientNames", "|").alias("recipients"))


@query("SELECT c_custkey AS channel_id, n_nationkey AS guild_id, coalesce(n_name, 'channel-' || c_custkey) AS guild_name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_regionkey <> 2")
def join6_channel_guild(spark, sf_dir):
    """Channels with their guild's row; channels of unknown guilds stay."""
    guilds = read(spark, sf_dir, "nation").where("n_regionkey <> 2").select(F.col("n_nationkey").alias("guild_id"), F.col("n_name").alias("name"))
    channels = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("channel_id"), F.col("c_nationkey").alias("home"))
    own = channels.join(guilds, F.col("home") == F.col("guild_id"), "left")
    return own.select("channel_id", "guild_id", or_else(F.col("name"), F.concat(F.lit("channel-"), "channel_id")).alias("guild_name"))


@query("SELECT event_id, ts FROM events ORDER BY ts, event_id LIMIT 100")
def top1_oldest(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", "ts").orderBy("ts", "event_id").limit(100)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50")
def top4_page(spark, sf_dir):
    return R.paged(read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.col("o_orderkey")], 50)


@query("SELECT * FROM (SELECT event_id, ts FROM events WHERE event_type = 'click' ORDER BY ts DESC, event_id DESC LIMIT 10)")
def top6_newest(spark, sf_dir):
    return R.newest_ascending(read(spark, sf_dir, "events").where("event_type = 'click'").select("event_id", "ts"), 10, ("ts", "event_id"))


@query("SELECT conv_id, turn, role FROM conversations WHERE role IN ('user', 'assistant') AND (conv_id, turn) IN (SELECT (conv_id, turn) FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn <= 6)")
def top7_history(spark, sf_dir):
    return R.history(read(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn")


@query("SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_custkey <> 5 UNION ALL SELECT 5, 'new'")
def set3_prepend(spark, sf_dir):
    from parlance.operators.sessions import prepended

    own = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    new = spark.createDataFrame([(5, "new")], "id long, name string")
    return prepended(own, new).drop("_part")


@query(f"SELECT event_id, cast({_FLAKE} AS varchar) AS id FROM events")
def scl1_snowflake(spark, sf_dir):
    return event_messages(spark, sf_dir).select("event_id", I.snowflake(F.col("ts")).alias("id"))


@query("SELECT event_id, epoch_us(ts) // 1000 AS ms FROM events")
def scl2_roundtrip(spark, sf_dir):
    return event_messages(spark, sf_dir).select("event_id", F.unix_millis(I.snowflake_time(I.snowflake(F.col("ts")))).alias("ms"))


@query("SELECT conv_id, turn, trim(lower(text)) AS low, upper(substring(text, 1, 1)) AS initial, starts_with(text, 'The') AS begins, ends_with(text, '.') AS ends, substring(text, 1, 30) AS title FROM conversations")
def scl3_5_strings(spark, sf_dir):
    own = read(spark, sf_dir, "conversations")
    return own.select("conv_id", "turn", F.trim(F.lower("text")).alias("low"), F.upper(F.substring("text", 1, 1)).alias("initial"), F.startswith("text", F.lit("The")).alias("begins"), F.endswith("text", F.lit(".")).alias("ends"), X.session_title(F.col("text")).alias("title"))


@query("SELECT conv_id, turn, len(string_split(text, chr(10))) AS n_lines, replace(text, chr(10), ' / ') AS flat FROM conversations")
def scl6_7_lines(spark, sf_dir):
    lines = F.split("text", "\n")
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(lines).cast("long").alias("n_lines"), F.array_join(lines, " / ").alias("flat"))


@query("SELECT event_id, cast(user_id AS varchar) AS ids, event_type AS names FROM events")
def scl9_10_mentions(spark, sf_dir):
    prompt = F.concat(F.lit("ask <@!"), "user_id", F.lit("> or @"), "event_type", F.lit(", not @everyone or <@!"), "user_id", F.lit(">"))
    own = read(spark, sf_dir, "events").withColumn("prompt", prompt)
    return own.select("event_id", F.array_join(X.mentioned_ids(F.col("prompt")), ",").alias("ids"), F.array_join(X.mentioned_names(F.col("prompt")), ",").alias("names"))


@query("SELECT event_id, event_type AS typed, 'hi <@' || user_id || '> ' AS inserted FROM events")
def scl11_open_mention(spark, sf_dir):
    own = read(spark, sf_dir, "events").withColumn("prompt", F.concat(F.lit("hi @"), "event_type"))
    return own.select("event_id", X.open_mention(F.col("prompt")).alias("typed"), F.concat(F.lit("hi "), F.substring(X.insert_mention(F.col("prompt"), F.col("user_id").cast("string")), 4, 100)).alias("inserted"))


@query("SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, regexp_replace(trim(url), '/$', '') AS base FROM pages")
def scl12_25_url(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", I.url_host(F.col("url")).alias("host"), I.clean_base(F.col("url")).alias("base"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN cast(o_custkey AS varchar) END AS guild_id, cast(o_custkey + 1 AS varchar) AS channel_id, cast(o_orderkey AS varchar) AS message_id FROM orders")
def scl12_13_message_url(spark, sf_dir):
    guild = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey").cast("string"))
    own = read(spark, sf_dir, "orders").withColumn("url", I.message_url("https://chat.com", guild, (F.col("o_custkey") + 1).cast("string"), F.col("o_orderkey").cast("string")))
    return own.withColumn("p", I.message_url_parts(F.col("url"))).select("o_orderkey", "p.guild_id", "p.channel_id", "p.message_id")


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS stamp, date_trunc('day', ts) AS day_start FROM events")
def scl14_15_times(spark, sf_dir):
    own = read(spark, sf_dir, "events")
    return own.select("event_id", stamp(F.col("ts")).alias("stamp"), F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day_start"))


@query("""
SELECT event_id, CASE WHEN m < 1 THEN 'Just now' WHEN m < 60 THEN m || 'm ago' WHEN m < 1440 THEN (m // 60) || 'h ago' WHEN m // 1440 = 1 THEN 'Yesterday'
  WHEN m // 1440 < 7 THEN (m // 1440) || 'd ago' ELSE strftime(ts, '%b %-d') END AS label
FROM (SELECT event_id, ts, cast(floor((epoch_ms(TIMESTAMP '2024-01-08') - epoch_us(ts) // 1000) / 60000) AS bigint) AS m FROM events)""")
def scl16_relative(spark, sf_dir):
    own = event_messages(spark, sf_dir)
    return own.select("event_id", X.relative_time(F.unix_millis("ts"), F.unix_millis(F.lit("2024-01-08").cast("timestamp"))).alias("label"))


@query("SELECT event_id, cast(json_extract_string(props, '$.k') AS bigint) AS k FROM events")
def scl20_json(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", X.arguments(F.col("props"), "k long")["k"].alias("k"))


@query("SELECT event_id, '{\"id\":' || event_id || ',\"type\":\"' || event_type || '\"}' AS j FROM events")
def scl21_to_json(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type"))).alias("j"))


@query("SELECT page_id, cast(len(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS bigint) AS n_links FROM pages")
def scl26_href_count(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", F.size(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).cast("long").alias("n_links"))


@query("""
SELECT kind, count(*) AS n FROM (SELECT CASE WHEN event_id % 5 = 0 THEN 'h2' WHEN event_id % 5 = 1 THEN 'bullet' WHEN event_id % 5 = 2 THEN 'quote' WHEN event_id % 5 = 3 THEN 'number' ELSE 'text' END AS kind FROM events) GROUP BY kind""")
def scl24_blocks(spark, sf_dir):
    k = F.col("event_id") % 5
    line = F.concat(F.when(k == 0, "## ").when(k == 1, "- ").when(k == 2, "> ").when(k == 3, "1. ").otherwise(""), "event_type")
    return read(spark, sf_dir, "events").select(X.block_kind(line).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


@query("""
WITH c AS (SELECT event_id, event_id % 4 AS k, event_type AS t FROM events)
SELECT event_id, 1 AS place, 'h2' AS kind, t AS text, NULL AS lang FROM c
UNION ALL SELECT event_id, 2, CASE WHEN k = 3 THEN 'text' ELSE 'quote' END, CASE WHEN k = 3 THEN '>' || t ELSE t END, NULL FROM c
UNION ALL SELECT event_id, 3, 'blank', '', NULL FROM c
UNION ALL SELECT event_id, 4, 'blank', '', NULL FROM c WHERE k < 2
UNION ALL SELECT event_id, 5, 'code', '# ' || t || chr(10) || '- x', 'py' FROM c WHERE k < 2
UNION ALL SELECT event_id, 6, 'blank', '', NULL FROM c WHERE k < 2
UNION ALL SELECT event_id, 7, 'number', t, NULL FROM c WHERE k < 2
UNION ALL SELECT event_id, 4, 'text', '```py', NULL FROM c WHERE k >= 2
UNION ALL SELECT event_id, 5, 'h1', t, NULL FROM c WHERE k >= 2
UNION ALL SELECT event_id, 6, 'bullet', 'x', NULL FROM c WHERE k >= 2
UNION ALL SELECT event_id, 7, 'text', '-----', NULL FROM c WHERE k >= 2""")
def scl24_fences(spark, sf_dir):
    """Messages with a block of code over several lines, closed or left open."""
    k, t = F.col("event_id") % 4, F.col("event_type")
    head = F.concat(F.lit("## "), t, F.when(k == 3, "\n>").otherwise("\n> "), t, F.lit("\n\n```py\n# "), t, F.lit("\n- x"))
    content = F.concat(head, F.when(k < 2, F.concat(F.lit("```\n12. "), t)).otherwise("\n-----"))
    rows = read(spark, sf_dir, "events").select("event_id", F.posexplode(X.blocks(content)).alias("pos", "b"))
    return rows.select("event_id", (F.col("pos") + 1).alias("place"), "b.kind", "b.text", "b.lang")


@query("SELECT event_id, event_type AS bold, cast(user_id AS varchar) AS code FROM events")
def scl23_inline(spark, sf_dir):
    own = read(spark, sf_dir, "events").withColumn("t", F.concat(F.lit("a **"), "event_type", F.lit("** by `"), "user_id", F.lit("`")))
    return own.select("event_id", F.array_join(X.inline_tokens(F.col("t"), "bold"), ",").alias("bold"), F.array_join(X.inline_tokens(F.col("t"), "code"), ",").alias("code"))


@query("SELECT event_id, '[' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '] [#' || event_type || '] u' || user_id || ' (' || user_id || ') [ID:' || event_id || ']: ' || coalesce(props, '') AS line FROM events")
def fmt1_format(spark, sf_dir):
    own = event_messages(spark, sf_dir)
    return own.select("event_id", message_line(F.col("ts"), F.col("event_type"), F.concat(F.lit("u"), "user_id"), F.col("user_id"), F.col("event_id"), F.col("props")).alias("line"))


@query("SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN role = 'assistant' THEN 0 ELSE 1 END, turn) = 1")
def prj8_hits(spark, sf_dir):
    own = read(spark, sf_dir, "conversations").withColumn("hit", F.col("role") == "assistant")
    return R.hits(own, "conv_id", "turn").select("conv_id", "turn", "role")


@query("SELECT n_nationkey, count(c_custkey) || CASE WHEN count(c_custkey) = 1 THEN ' channel' ELSE ' channels' END AS label FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey")
def prj10_label(spark, sf_dir):
    from parlance.operators.scope import label

    own = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "customer"), F.col("c_nationkey") == F.col("n_nationkey"), "left").groupBy("n_nationkey").agg(F.count("c_custkey").alias("n"))
    return own.select("n_nationkey", label(F.col("n"), "channel", "channels").alias("label"))


@query("""
WITH v AS (SELECT user_id AS id, epoch_us(ts) // 1000 AS t, event_type = 'purchase' AS gone, event_id FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY t DESC, gone DESC) AS rn FROM v)
SELECT id, t AS "updatedAt" FROM n WHERE rn = 1 AND NOT gone""")
def snk1_2_sessions(spark, sf_dir):
    own = event_messages(spark, sf_dir).select(F.col("user_id").alias("id"), F.unix_millis("ts").alias("updatedAt"), (F.col("event_type") == "purchase").alias("deleted"))
    return current(own).select("id", "updatedAt")


@query("SELECT conv_id AS id, max(turn) AS turn FROM conversations GROUP BY conv_id ORDER BY turn DESC, id LIMIT 60")
def src10_snk6_newest_of_all(spark, sf_dir):
    """All conversations as sessions of one channel, each turn a version; the newest ones as a log."""
    versions = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"), F.lit("all").alias("channelId"), F.col("turn").alias("updatedAt"), F.lit(False).alias("deleted"))
    log = for_channel(versions, "all").select("id", F.col("updatedAt").alias("time"), (-F.col("id")).alias("seq"))
    return R.newest_logs(log).select("id", F.col("time").alias("turn"))


src10_snk6_newest = query(ORACLES["src10_snk6_newest_of_all"])(_same("src10_snk6_newest", src10_snk6_newest_of_all))


@query("SELECT o_orderkey, o_orderstatus AS status FROM orders WHERE o_orderkey = 33")
def src5_lookup(spark, sf_dir):
    from parlance.sources.tables import lookup

    return lookup(read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status")), "o_orderkey", 33)


@query("SELECT 'n' AS key, cast(max(n_nationkey) AS varchar) AS value FROM nation UNION ALL SELECT 'r', cast(max(r_regionkey) AS varchar) FROM region")
def src11_settings(spark, sf_dir):
    from parlance.sources.tables import layered_settings

    base = spark.createDataFrame([("n", "0"), ("r", "0")], "key string, value string")
    first = read(spark, sf_dir, "nation").agg(F.max("n_nationkey").cast("string").alias("value")).select(F.lit("n").alias("key"), "value")
    second = read(spark, sf_dir, "region").agg(F.max("r_regionkey").cast("string").alias("value")).select(F.lit("r").alias("key"), "value")
    return layered_settings([base, first, second])


@query("SELECT conv_id, coalesce(string_agg(text, '' ORDER BY turn), '') AS content FROM conversations GROUP BY conv_id")
def str1_2_frames(spark, sf_dir):
    """Turns as streamed frames, decoded and joined again."""
    from parlance.streaming.fold import contents, deltas, payloads

    own = read(spark, sf_dir, "conversations")
    frame = F.to_json(F.struct(F.array(F.struct(F.struct(F.col("text").alias("content")).alias("delta"))).alias("choices")))
    lines = own.select(F.col("conv_id").alias("stream_id"), F.col("turn").alias("seq"), F.concat(F.lit("data: "), frame, F.lit("\n")).alias("line"))
    return contents(deltas(payloads(lines))).withColumnRenamed("stream_id", "conv_id")


@query("SELECT conv_id, coalesce(string_agg(text, '' ORDER BY turn), '') AS content FROM conversations GROUP BY conv_id")
def str1_chunks(spark, sf_dir):
    """Streamed answers as bytes, cut every 13 of them, inside lines and characters; joined, decoded and joined again."""
    from parlance.streaming.chunks import lines
    from parlance.streaming.fold import contents, deltas, payloads

    own = read(spark, sf_dir, "conversations")
    frame = F.to_json(F.struct(F.array(F.struct(F.struct(F.concat(F.lit("\u00e9"), "text").alias("content")).alias("delta"))).alias("choices")))
    line = F.struct("turn", F.concat(F.lit("data: "), frame, F.lit("\n: ping\n\n")).alias("line"))
    streams = own.groupBy(F.col("conv_id").alias("stream_id")).agg(F.sort_array(F.collect_list(line)).alias("x"))
    streams = streams.select(F.col("stream_id").cast("string").alias("stream_id"), F.encode(F.array_join("x.line", ""), "UTF-8").alias("bytes"))
    cut = streams.select("stream_id", "bytes", F.explode(F.sequence(F.lit(0), F.octet_length("bytes") - 1, F.lit(13))).alias("start"))
    chunks = cut.select("stream_id", F.col("start").cast("long").alias("start"), F.expr("substring(bytes, start + 1, 13)").alias("data"))
    parts = deltas(payloads(lines(chunks))).withColumn("content", F.substring("content", 2, 1 << 30))
    return contents(parts).select(F.col("stream_id").cast("long").alias("conv_id"), "content")


@query("SELECT user_id AS stream_id, cast(0 AS integer) AS idx, string_agg(event_type, '' ORDER BY event_id) AS arguments FROM events GROUP BY user_id")
def agg6_str3_fold(spark, sf_dir):
    from parlance.streaming.fold import folded

    own = read(spark, sf_dir, "events").select(F.col("user_id").alias("stream_id"), F.lit(0).alias("idx"), F.col("event_id").alias("seq"), F.lit("x").alias("call_id"), F.lit("f").alias("name"), F.col("event_type").alias("args"))
    return folded(own).select("stream_id", "idx", "arguments")


@query("SELECT conv_id, turn, role FROM conversations WHERE role IN ('tool_call', 'assistant', 'error') AND role <> 'user' AND role = 'assistant'")
def prd22_trace_steps(spark, sf_dir):
    kind = F.when(F.col("role") == "assistant", "tool_result").when(F.col("role") == "user", "thinking").otherwise("answer")
    return read(spark, sf_dir, "conversations").where(P.trace_step(kind)).select("conv_id", "turn", "role")


@query("SELECT n_nationkey AS id, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE 'channel-' || n_nationkey END AS name FROM nation WHERE n_regionkey = 1 AND n_nationkey % 3 <> 0")
def prj3_accessible(spark, sf_dir):
    from parlance.operators.scope import accessible

    key = F.col("n_nationkey")
    own = read(spark, sf_dir, "nation").select(key.cast("string").alias("id"), F.when(key % 2 == 0, F.col("n_name")).otherwise("").alias("name"), F.lit(None).cast("string").alias("topic"), F.col("n_regionkey").cast("string").alias("guild_id"), F.when(key % 3 == 0, 2).otherwise(0).alias("type"), F.lit(1024).cast("long").alias("permissions"))
    return accessible(own, "1").select(F.col("id").cast("int").alias("id"), "name")


@query("SELECT s_suppkey AS id, s_name AS username FROM supplier UNION ALL SELECT c_custkey, 'Member' FROM customer WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = c_custkey)")
def join3_all_members(spark, sf_dir):
    """All suppliers as members, and customers that are no suppliers as members without a user row."""
    from parlance.operators.directory import members

    own = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("username"))
    known = own.select(F.col("id").alias("user_id"))
    lost = read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("user_id")).join(known, "user_id", "left_anti")
    every = known.unionByName(lost).withColumn("nick", F.lit(None).cast("string"))
    return members(every, own).select(F.col("id").cast("long").alias("id"), "username")


join3_members = query(ORACLES["join3_all_members"])(_same("join3_members", join3_all_members))


@query("SELECT o_orderkey AS id, o_orderstatus AS name, l_quantity AS result FROM orders LEFT JOIN (SELECT l_orderkey, max(l_quantity) AS l_quantity FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey) ON l_orderkey = o_orderkey")
def join7_call_results(spark, sf_dir):
    from parlance.operators.sessions import calls_with_results

    calls = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("name"))
    results = read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("tool_call_id")).agg(F.max("l_quantity").alias("result"))
    return calls_with_results(calls, results)


@query("SELECT c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 7 = 0 THEN 'done' ELSE c_mktsegment END AS status FROM customer")
def join8_replaced_steps(spark, sf_dir):
    from parlance.operators.sessions import steps_replaced

    own = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("status"))
    return steps_replaced(own, own.where("id % 7 = 0").select("id", F.lit("done").alias("status")))


@query("SELECT s_suppkey AS id, '- ' || s_name || ' (@s' || s_suppkey || ') (ID: \"' || s_suppkey || '\")' AS line FROM supplier")
def fmt3_mention_block(spark, sf_dir):
    from parlance.functions.render import mention_block

    key = F.col("s_suppkey").cast("string")
    own = read(spark, sf_dir, "supplier").select(key.alias("id"), F.concat(F.lit("s"), key).alias("username"), F.col("s_name").alias("globalName"), F.lit(False).alias("bot"))
    return mention_block(own).select(F.col("id").cast("long").alias("id"), "line")


@query("SELECT event_id, strftime(ts, '%A, %B %-d, %Y') AS day_text, least(cast(floor(value) AS bigint), 50) AS clamped FROM events")
def scl17_18_numbers(spark, sf_dir):
    own = read(spark, sf_dir, "events")
    return own.select("event_id", F.date_format("ts", "EEEE, MMMM d, yyyy").alias("day_text"), F.least(F.floor("value"), F.lit(50).cast("long")).alias("clamped"))


@query("SELECT conv_id, turn, len(list_distinct(string_split(text, ' '))) AS n_distinct, string_split(text, ' ')[1] AS first_word FROM conversations")
def scl26_arrays(spark, sf_dir):
    parts = F.split("text", " ")
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(F.array_distinct(parts)).cast("long").alias("n_distinct"), F.element_at(parts, 1).alias("first_word"))


@query("SELECT n_name AS name, r_name AS guild FROM nation JOIN region ON r_regionkey = n_regionkey")
def src8_9_buckets(spark, sf_dir):
    """Channels of all guilds out of a map of arrays."""
    from parlance.sources.tables import flatten_buckets

    rows = read(spark, sf_dir, "nation").join(F.broadcast(read(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    entry = F.struct(F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("r_name").alias("guild")).alias("channel"))
    buckets = rows.groupBy("r_name").agg(F.collect_list(entry).alias("entries")).select(F.map_from_arrays(F.array("r_name"), F.array("entries")).alias("buckets"))
    return flatten_buckets(buckets).select("name", "guild")


@query("SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'Running: searching messages' WHEN role = 'assistant' THEN 'Done: searching messages' ELSE 'Failed: searching messages' END AS summary FROM conversations")
def prj11_step_summary(spark, sf_dir):
    from parlance.functions.render import step_summary

    status = F.when(F.col("role") == "user", "tool_call").when(F.col("role") == "assistant", "tool_result").otherwise("error")
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", step_summary(F.lit("search_messages"), status).alias("summary"))


@query("SELECT c_custkey AS id, coalesce(nullif(CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END, ''), 'User') AS username, c_custkey % 2 = 0 AS bot FROM customer")
def prj2_users(spark, sf_dir):
    from parlance.operators.directory import normalised

    key = F.col("c_custkey")
    own = read(spark, sf_dir, "customer").select(key.alias("id"), F.when(key % 3 == 0, "").otherwise(F.col("c_name")).alias("username"), F.when(key % 2 == 0, True).alias("bot"))
    return normalised(own).select(F.col("id").cast("long").alias("id"), "username", "bot")


@query("SELECT conv_id AS \"channelId\", conv_id * 1000 + turn AS \"messageId\", CASE WHEN text = '' THEN '' ELSE text END AS content, coalesce('conv' || conv_id, 'channel') AS \"channelName\" FROM conversations")
def prj1_agg4_citations(spark, sf_dir):
    """Citations of two overlapping results, each message once."""
    from parlance.operators.citations import cited, once

    turns = conversation_messages(spark, sf_dir)
    none = F.lit(None).cast("string")
    author = F.struct(F.col("author_id").alias("id"), F.col("author_name").alias("username"), none.alias("globalName"), none.alias("avatar"))
    messages = turns.select("id", "channel_id", none.alias("guild_id"), author.alias("author"), "content", none.alias("timestamp"), F.lit(None).cast("array<struct<filename:string,url:string>>").alias("attachments"))
    channels = turns.select(F.col("channel_id").alias("id")).distinct().select("id", F.concat(F.lit("conv"), "id").alias("name"), none.alias("guild_id"))
    rows = cited(messages, channels)
    return once([rows, rows.where(F.col("messageId") % 2 == 0)]).select("channelId", "messageId", "content", "channelName")


@query("""
WITH k AS (SELECT o_orderkey, o_custkey AS c, cast(o_orderkey % 6 AS bigint) AS f FROM orders)
SELECT o_orderkey, CASE WHEN f IN (0, 2, 4) THEN cast(c AS varchar) END AS guild_id, CASE WHEN f < 5 THEN cast(c + 1 AS varchar) END AS channel_id,
  CASE WHEN f IN (0, 1, 3, 4) THEN cast(o_orderkey AS varchar) END AS message_id FROM k""")
def scl12_families(spark, sf_dir):
    """All families of message URLs: web, without a guild, without host scheme and message, app with two ids, app with
    three, and another site."""
    key, channel, guild = F.col("o_orderkey").cast("string"), (F.col("o_custkey") + 1).cast("string"), F.col("o_custkey").cast("string")
    slash = lambda *x: F.concat_ws("/", *x)
    shapes = [F.concat(F.lit("HTTPS://www.Chat.com/channels/"), slash(guild, channel, key)), F.concat(F.lit("see https://chat.com/channels/@me/"), slash(channel, key)), F.concat(F.lit("chat.com/channels/"), slash(guild, channel)), F.concat(F.lit("chat://message/"), slash(channel, key)), F.concat(F.lit("CHAT://channels/"), slash(guild, channel, key)), F.concat(F.lit("https://chart.com/channels/"), slash(guild, channel, key))]
    own = read(spark, sf_dir, "orders").withColumn("p", I.message_url_parts(F.element_at(F.array(*shapes), (F.col("o_orderkey") % 6).cast("int") + 1), "chat.com", "chat"))
    return own.select("o_orderkey", "p.guild_id", "p.channel_id", "p.message_id")


@query("""
WITH e AS (SELECT event_id, user_id, event_type AS t, event_id % 3 AS k FROM events)
SELECT event_id, t AS bold, CASE WHEN k = 0 THEN '' ELSE 'is ' || t END AS italic, '**not** ' || t AS code, user_id || '|mailto:' || t AS link, 'x' AS strike FROM e""")
def scl23_precedence(spark, sf_dir):
    """Links of any target, marks inside code, and italics beside bold text."""
    t = F.col("event_type")
    text = F.concat(F.lit("`**not** "), t, F.lit("` **"), t, F.lit("** "), F.when(F.col("event_id") % 3 == 0, "").otherwise(F.concat(F.lit("*is "), t, F.lit("*"))), F.lit("["), "user_id", F.lit("](mailto:"), t, F.lit(") ~~x~~ * alone"))
    own = read(spark, sf_dir, "events").withColumn("tokens", X.inline(text))
    of = lambda kind: F.array_join(F.transform(F.filter("tokens", lambda x: x["kind"] == kind), lambda x: F.concat_ws("|", x["text"], x["href"])), ",")
    return own.select("event_id", *(of(kind).alias(kind) for kind in ("bold", "italic", "code", "link", "strike")))


@query("""
WITH e AS (SELECT event_id, user_id, cast(event_id % 2 AS integer) AS idx, event_type AS t,
    row_number() OVER (PARTITION BY user_id, event_id % 2 ORDER BY event_id) AS k FROM events)
SELECT user_id AS stream_id, idx, CASE WHEN idx = 0 THEN 'call_0' ELSE 'id' || max(event_id) END AS call_id,
  CASE WHEN count(*) > 1 THEN 'find_user' ELSE 'find' END AS name, string_agg(t, '' ORDER BY event_id) AS arguments FROM e GROUP BY user_id, idx""")
def agg6_str2_defaults(spark, sf_dir):
    """Frames with whole messages and deltas, without an index or an id, and names that come in parts or again."""
    from parlance.streaming.fold import deltas, folded, fragments, payloads

    from pyspark.sql import Window

    odd = F.col("event_id") % 2 == 1
    nth = F.row_number().over(Window.partitionBy("user_id", F.col("event_id") % 2).orderBy("event_id"))
    own = read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", odd.alias("odd"), nth.alias("k"))
    name = F.when(F.col("k") == 1, "find").when(F.col("k") == 2, "_user").when(F.col("k") == 3, "find_user")
    call = F.array(F.struct(F.when(F.col("odd"), 1).alias("index"), F.when(F.col("odd"), F.concat(F.lit("id"), "event_id")).alias("id"), F.struct(name.alias("name"), F.col("event_type").alias("arguments")).alias("function")))
    inner = F.struct(call.alias("tool_calls"))
    choice = F.when(F.col("k") % 2 == 0, F.to_json(F.struct(F.array(F.struct(inner.alias("message"))).alias("choices")))).otherwise(F.to_json(F.struct(F.array(F.struct(inner.alias("delta"))).alias("choices"))))
    lines = own.select(F.col("user_id").alias("stream_id"), F.col("event_id").alias("seq"), F.concat(F.lit("data: "), choice, F.lit("\n")).alias("line"))
    return folded(fragments(deltas(payloads(lines))))


@query("""
SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'Search messages ' || '"' || turn || '"' || CASE WHEN turn % 4 = 0 THEN ' [has:link]' ELSE '' END
  WHEN role = 'assistant' THEN 'Fetch context around message ' || turn ELSE 'Executing other' END AS title,
  CASE WHEN role = 'user' THEN chr(128269) WHEN role = 'assistant' THEN chr(128220) ELSE chr(9889) END AS icon,
  CASE WHEN role = 'system' THEN chr(10060) WHEN turn % 2 = 0 THEN chr(9989) ELSE chr(9203) END AS status FROM conversations""")
def prj11_step_titles(spark, sf_dir):
    from parlance.functions.render import status_icon, step_title, tool_icon

    turn = F.col("turn").cast("string")
    name = F.when(F.col("role") == "user", "search_messages").when(F.col("role") == "assistant", "fetch_surrounding_messages").otherwise("other")
    args = F.struct(turn.alias("query"), F.when(F.col("turn") % 4 == 0, "link").otherwise("").alias("has"), turn.alias("message_id"))
    kind = F.when(F.col("role") == "system", "error").otherwise("tool_call")
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", step_title(name, args, F.lit("")).alias("title"), tool_icon(name).alias("icon"), status_icon(kind, F.when(F.col("turn") % 2 == 0, "")).alias("status"))


def _parts(spark, sf_dir):
    """Parts as messages, each with a file, every third one with an embed."""
    none = F.lit(None).cast("string")
    key = F.col("p_partkey")
    file = F.struct(F.concat(F.col("p_name"), F.lit(".pdf")).alias("filename"), F.when(key % 2 == 0, "application/pdf").otherwise("").alias("content_type"), F.concat(F.lit("u/"), key).alias("url"))
    embed = F.struct(F.when(key % 9 == 0, F.col("p_type")).alias("title"), none.alias("description"), F.when(key % 9 == 3, "https://x.org").alias("url"))
    author = F.struct(F.col("p_size").cast("string").alias("id"), F.lit("").alias("username"), F.col("p_brand").alias("globalName"))
    return read(spark, sf_dir, "part").select(key.cast("string").alias("id"), F.lit("c").alias("channel_id"), author.alias("author"), F.when(key % 5 == 0, none).otherwise(F.col("p_type")).alias("content"), F.lit("2024-05-06T07:08:09.000Z").alias("timestamp"), F.array(file).alias("attachments"), F.when(key % 3 == 0, F.array(embed)).alias("embeds"))


@query("""
SELECT p_partkey AS id, '[2024-05-06 07:08:09] [#c] ' || p_brand || ' (' || p_size || ') [ID:' || p_partkey || ']: ' || CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_type END
  || chr(10) || '  [Attachment: ' || p_name || '.pdf (' || CASE WHEN p_partkey % 2 = 0 THEN 'application/pdf' ELSE 'file' END || ') - u/' || p_partkey || ']'
  || CASE WHEN p_partkey % 9 = 0 THEN chr(10) || '  [Embed: "' || p_type || '" - ]' WHEN p_partkey % 9 = 3 THEN chr(10) || '  [Embed: "" - https://x.org]' ELSE '' END AS line FROM part""")
def fmt1_message_text(spark, sf_dir):
    return _parts(spark, sf_dir).select(F.col("id").cast("int").cast("long").alias("id"), message_text(F.col("channel_id")).alias("line"))


@query("""
SELECT p_partkey AS id FROM part WHERE contains(lower(p_name), 'co') OR contains(lower(p_brand), 'co')
  OR (p_partkey % 5 <> 0 OR p_partkey % 9 = 0) AND contains(lower(p_type), 'co')""")
def prd12_everywhere(spark, sf_dir):
    """A keyword in content, file names, embeds and author names."""
    return _parts(spark, sf_dir).where(P.keyword(" Co")).select(F.col("id").cast("long").alias("id"))


@query("""
SELECT page_id, url AS first_url, cast(1 AS integer) AS size, (SELECT count(*) FROM pages) AS total FROM pages""")
def prj7_groups(spark, sf_dir):
    own = read(spark, sf_dir, "pages").select("page_id", F.struct("page_id", "url").alias("messages"))
    return R.as_groups(own).select("page_id", F.col("group")[0]["url"].alias("first_url"), F.size("group").alias("size"), "total")


@query("""
SELECT s.s_suppkey AS prompt_id, cast(s.s_suppkey + 1 AS varchar) AS id, coalesce(t.username, 'user_' || (s.s_suppkey + 1)) AS username
FROM supplier s LEFT JOIN (SELECT s_suppkey, 'sup' || s_suppkey || 'x' AS username FROM supplier) t ON t.s_suppkey = s.s_suppkey + 1
UNION ALL SELECT s_suppkey, cast(s_suppkey AS varchar), 'sup' || s_suppkey || 'x' FROM supplier""")
def prompt_mentions(spark, sf_dir):
    """Mentions by id (some unknown), by a whole name, and by a part of one."""
    from parlance.operators import directory

    key = F.col("s_suppkey").cast("string")
    supplier = read(spark, sf_dir, "supplier")
    none = F.lit(None).cast("string")
    users = supplier.select(key.alias("id"), F.concat(F.lit("sup"), key, F.lit("x")).alias("username"), none.alias("globalName"), none.alias("avatar"), none.alias("discriminator"), F.lit(False).alias("bot"))
    name = F.concat(F.when(F.col("s_suppkey") % 2 == 0, "Sup").otherwise("up"), key, F.lit("x"))
    prompts = supplier.select(F.col("s_suppkey").alias("prompt_id"), F.concat(F.lit("ask @"), name, F.lit(" and <@!"), (F.col("s_suppkey") + 1).cast("string"), F.lit("> @everyone")).alias("text"))
    return directory.prompt_mentions(prompts, users).select("prompt_id", "id", "username")


@query("""
SELECT c_custkey AS prompt_id, id, username FROM customer, (SELECT cast(s_suppkey AS varchar) AS id, 'b' || lpad(cast(s_suppkey AS varchar), 6, '0') AS username, lpad(cast(100000 - s_suppkey AS varchar), 6, '0') || 'z' AS shown FROM supplier)
WHERE contains(shown, lpad(cast(100000 - 1 - c_custkey % 10 AS varchar), 6, '0')) OR contains(username, lpad(cast(100000 - 1 - c_custkey % 10 AS varchar), 6, '0'))
QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY CASE WHEN starts_with(username, lpad(cast(100000 - 1 - c_custkey % 10 AS varchar), 6, '0')) OR starts_with(shown, lpad(cast(100000 - 1 - c_custkey % 10 AS varchar), 6, '0')) THEN 0 ELSE 1 END, username, id) = 1""")
def prompt_partial_mentions(spark, sf_dir):
    """Parts of global names, which count as much as those of user names do."""
    from parlance.operators import directory

    none = F.lit(None).cast("string")
    key = F.col("s_suppkey")
    users = read(spark, sf_dir, "supplier").select(key.cast("string").alias("id"), F.concat(F.lit("b"), F.lpad(key.cast("string"), 6, "0")).alias("username"), F.concat(F.lpad((100000 - key).cast("string"), 6, "0"), F.lit("z")).alias("globalName"), none.alias("avatar"), none.alias("discriminator"), F.lit(False).alias("bot"))
    part = F.lpad((99999 - F.col("c_custkey") % 10).cast("string"), 6, "0")
    prompts = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("prompt_id"), F.concat(F.lit("ask @"), part).alias("text"))
    return directory.prompt_mentions(prompts, users).select("prompt_id", "id", "username")


_PLAIN = "'[] ' || author_name || ' (' || coalesce(author_id, '') || ') [ID:' || id || ']: ' || coalesce(content, '')"


@query(f"""
WITH t AS ({_TURNS}), c AS (SELECT DISTINCT channel_id FROM t),
m AS (SELECT *, row_number() OVER (PARTITION BY channel_id ORDER BY id DESC) AS rn, count(*) OVER (PARTITION BY channel_id) AS total FROM t WHERE contains(lower(content), 'le') OR contains(lower(author_name), 'le')),
n AS (SELECT *, row_number() OVER (PARTITION BY channel_id ORDER BY id) AS rn, row_number() OVER (PARTITION BY channel_id ORDER BY id DESC) AS back FROM t),
s AS (SELECT channel_id, 'Found ' || any_value(total) || ' matching messages (search index):' || chr(10) || chr(10) || string_agg({_LINE}, chr(10) || chr(10) ORDER BY id DESC) AS text FROM m WHERE rn <= 15 GROUP BY channel_id),
r AS (SELECT channel_id, 'Recent messages in channel (' || count(*) || ' messages):' || chr(10) || chr(10) || string_agg({_PLAIN}, chr(10) ORDER BY id) AS text FROM n WHERE back <= 3 GROUP BY channel_id),
a AS (SELECT n.channel_id, 'Surrounding context around message ' || any_value(x.id) || ' (' || count(*) || ' messages):' || chr(10) || chr(10) || string_agg('[] ' || n.author_name || ' (' || coalesce(n.author_id, '') || ') [ID:' || n.id || ']: ' || coalesce(n.content, ''), chr(10) ORDER BY n.id) AS text
  FROM n JOIN n x ON x.channel_id = n.channel_id AND x.id = x.channel_id * 1000 + 1 AND n.rn BETWEEN x.rn - 1 AND x.rn + 1 GROUP BY n.channel_id)
SELECT 's' || c.channel_id AS call_id, coalesce(s.text, 'No messages found matching search criteria (Query: "LE") in channel #' || c.channel_id || '.') AS text FROM c LEFT JOIN s ON s.channel_id = c.channel_id
UNION ALL SELECT 'r' || channel_id, text FROM r
UNION ALL SELECT 'a' || c.channel_id, coalesce(a.text, 'No surrounding messages found around message ID ' || (c.channel_id * 1000 + 1) || '.') FROM c LEFT JOIN a ON a.channel_id = c.channel_id
UNION ALL SELECT 'd' || channel_id, 'Error: Access denied. Channel -7 is outside of allowed scope.' FROM c""")
def tvf3_5_calls(spark, sf_dir):
    """Four calls from each channel, all in one plan: a search, recent rows, rows around one, and one that is denied."""
    from parlance.plans.batch import answers
    from parlance.plans.tools import Tables

    messages, channels = _chat(spark, sf_dir)
    messages = messages.withColumn("mentions", F.lit(None).cast("array<struct<id:string>>"))
    channels = channels.withColumn("recipients", F.lit(None).cast("array<string>"))
    guilds = channels.select(F.col("guild_id").alias("id"), F.col("guild_id").alias("name")).distinct()
    users = messages.select(F.col("author.id").alias("id"), F.col("author.username").alias("username"), F.col("author.globalName").alias("globalName")).where("id is not null").distinct()
    around = F.concat(F.lit('{"message_id": "'), (F.col("id").cast("long") * 1000 + 1).cast("string"), F.lit('", "limit": 3}'))
    call = lambda kind, name, arguments: F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("name"), arguments.alias("arguments"))
    kinds = F.array(call("s", "search_messages", F.lit('{"query": "LE"}')), call("r", "fetch_recent_messages", F.lit('{"limit": "3"}')), call("a", "fetch_surrounding_messages", around), call("d", "search_messages", F.lit('{"channel_id": "-7"}')))
    calls = channels.select(F.col("id").alias("channel_id"), F.lit("me").alias("viewer_id"), F.inline(kinds)).withColumn("call_id", F.concat("kind", "channel_id"))
    return answers(calls.drop("kind"), Tables(messages, channels, users, guilds))


@query("""
SELECT c_custkey AS viewer, cast(n_nationkey AS varchar) AS channel_id FROM customer JOIN nation h ON h.n_nationkey = c_nationkey JOIN nation n ON n.n_regionkey = h.n_regionkey AND (n.n_nationkey % 3 <> 0 OR n.n_nationkey = h.n_nationkey)""".replace("cast(n_nationkey", "cast(n.n_nationkey"))
def prj9_scopes(spark, sf_dir):
    """The channels that each customer may read: their nation's, and of its region those with the view bit."""
    from parlance.operators.scope import reachable, resolved

    none = F.lit(None).cast("string")
    key = F.col("n_nationkey").cast("string")
    channels = read(spark, sf_dir, "nation").select(key.alias("id"), F.lit(0).alias("type"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("string").alias("guild_id"), F.lit(None).cast("array<string>").alias("recipients"), F.when(F.col("n_nationkey") % 3 == 0, 0).otherwise(1024).cast("long").alias("permissions"))
    guilds = read(spark, sf_dir, "region").select(F.col("r_regionkey").cast("string").alias("id"), F.col("r_name").alias("name"))
    viewers = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("viewer"), F.col("c_custkey").cast("string").alias("viewer_id"), F.col("c_nationkey").cast("string").alias("channel_id"))
    users = viewers.select(F.col("viewer_id").alias("id"), F.col("viewer_id").alias("username"), none.alias("globalName"))
    return reachable(resolved(viewers, channels, users, guilds), channels, "viewer")


@query("SELECT r_regionkey AS region, cast(n_nationkey AS varchar) AS id, n_name AS name, cast(n_nationkey % 5 AS integer) AS type FROM nation JOIN region ON r_regionkey = n_regionkey")
def src8_9_shapes(spark, sf_dir):
    """Each region's nations as a store's snapshot in JSON, in one of five shapes; all of them in one table."""
    from parlance.sources.variants import channels_of, parsed

    one = F.struct(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name"), (F.col("n_nationkey") % 5).alias("type"))
    rows = read(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(F.collect_list(one).alias("x"))
    wrapped = F.transform("x", lambda c: F.struct(c.alias("channel")))
    keys = F.transform("x", lambda c: F.concat(F.lit("k"), c["id"]))
    half = F.array(F.slice("x", 1, 2), F.slice("x", 3, 100))
    shapes = [F.to_json("x"), F.to_json(wrapped), F.to_json(half), F.to_json(F.map_from_arrays(keys, wrapped)), F.to_json(F.map_from_arrays(F.array(F.lit("a"), F.lit("b")), half))]
    raw = F.element_at(F.array(*shapes), F.col("region").cast("int") % 5 + 1)
    return channels_of(parsed(rows.select("region", raw.alias("raw")), "raw"), "raw").select("region", "id", "name", "type")


@query("""
WITH v AS (SELECT user_id % 3 AS channel, user_id AS id, event_id AS t, event_type = 'purchase' AS gone FROM events), n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY t DESC) AS rn FROM v)
SELECT id, t AS "updatedAt" FROM n WHERE rn = 1 AND NOT gone AND channel = 2""")
def src10_snk3_store(spark, sf_dir):
    """All events as saves and deletes of sessions, half of them in a snapshot by channel; one channel's sessions."""
    from parlance.operators.sessions import SessionStore, append
    from parlance.sources.schema import SESSION

    none = lambda kind: F.lit(None).cast(kind)
    own = read(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("id"), F.when(F.col("event_type") != "purchase", (F.col("user_id") % 3).cast("string")).alias("channelId"), F.lit("t").alias("title"), none(SESSION["messages"].dataType).alias("messages"), F.lit(0).cast("long").alias("createdAt"), F.col("event_id").alias("updatedAt"), (F.col("event_type") == "purchase").alias("deleted")
    )
    path = own_folder(spark, "sessions")
    store = SessionStore(spark, path, "sessions_" + path.rsplit("-", 1)[1], buckets=16)
    middle = own.agg(F.percentile_approx("updatedAt", 0.5)).collect()[0][0]
    append(own.where(F.col("updatedAt") <= middle), f"{path}/log/epoch=0")
    store.compact()
    append(own.where(F.col("updatedAt") > middle), f"{path}/log/epoch=1")
    return store.for_channel("2").select(F.col("id").cast("long").alias("id"), "updatedAt")


@query("SELECT c_custkey AS channel_id, n_name AS guild_name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_regionkey <> 2")
def join6_guild_names(spark, sf_dir):
    from parlance.operators.scope import with_guild

    guilds = read(spark, sf_dir, "nation").where("n_regionkey <> 2").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    channels = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("channel_id"), F.col("c_nationkey").alias("guild_id"))
    return with_guild(channels, guilds).select("channel_id", "guild_name")


@query("""
WITH s AS (
  SELECT cast(c_custkey AS varchar) AS id, c_name AS username, 0 AS p FROM customer WHERE c_nationkey < 5
  UNION ALL SELECT cast(s_suppkey AS varchar), s_name, 1 FROM supplier
  UNION ALL SELECT cast(o_custkey AS varchar), min(o_orderpriority), 2 FROM orders GROUP BY o_custkey
  UNION ALL SELECT cast(user_id AS varchar), 'Member', 3 FROM events GROUP BY user_id)
SELECT id, username FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY p) = 1""")
def agg3_four_sources(spark, sf_dir):
    """The directory out of recipients, authors, members without a user row, and all users."""
    from parlance.operators.directory import gathered, members

    text = lambda c: F.col(c).cast("string")
    recipients = read(spark, sf_dir, "customer").where("c_nationkey < 5").select(text("c_custkey").alias("id"), F.col("c_name").alias("username"))
    authors = read(spark, sf_dir, "supplier").select(text("s_suppkey").alias("id"), F.col("s_name").alias("username"))
    every = read(spark, sf_dir, "orders").groupBy(text("o_custkey").alias("id")).agg(F.min("o_orderpriority").alias("username"))
    lost = read(spark, sf_dir, "events").select(text("user_id").alias("user_id"), F.lit(None).cast("string").alias("nick")).distinct()
    unknown = members(lost, every.where("false"))
    return gathered(recipients, authors, every, unknown).select("id", "username")


@query("SELECT page_id, 'data:text/html;base64,' || base64(encode(html)) AS data_url FROM pages")
def src13_data_urls(spark, sf_dir):
    """Pages as binary files, turned into data URLs."""
    from parlance.sources.tables import data_url

    files = read(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("path"), F.encode("html", "UTF-8").alias("content"))
    return data_url(files, F.lit("text/html")).select(F.col("path").cast("long").alias("page_id"), "data_url")
