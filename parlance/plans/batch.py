"""Many tool calls in one plan: calls are rows, their JSON arguments become data, and messages meet them by joins.

``answers`` gives the text that ``tools.call`` gives for one call after another, for the tools that read messages. Calls
that ask for the same are answered once. Searches meet messages by channel; those within a span of at most ``DAYS`` days
by channel and day of the id, so a narrow search doesn't look through a channel. Matches are written as narrow rows
(search, channel, id, order): their number and the page to show both come from them. Newest rows are found once a
channel, rows around a message by ``retrieve.around``.

Unreadable dates don't filter, as in one call; where a search by such a date finds nothing, one call is an error, and
here its local search finds nothing either. Calls from unknown channels have a null text; calls of other tools no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions.ids import snowflake
from parlance.functions.render import message_text
from parlance.functions.values import or_else, some, truthy
from parlance.operators import predicates as P, retrieve, scope as scopes
from parlance.plans.tools import Tables
from parlance.sources.schema import FALLBACK_ROWS, PAGE_CAP, SHOWN_LOCAL, SHOWN_REMOTE
from parlance.sources.shared import own_folder, written

#: Days of a search up to which it meets messages by day.
DAYS = 31
_DAY = 86_400_000 << 22
_LOW = (1 << 22) - 1
_ARGS = "query string, channel_id string, author_id string, has string, date string, during_date string, after_date string, before_date string, pinned boolean, mentions string, sort_by string, sort_order string, offset string, all_in_scope boolean, message_id string, limit string"
#: Kinds of content that can be told; other ones don't filter.
_KINDS = ("link", "file", "image", "video", "sound", "embed")
_TIME = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]{1,6})?)?(Z|[+-][0-9]{2}:[0-9]{2})?)?$"
TOOLS = ("search_messages", "fetch_surrounding_messages", "fetch_recent_messages")


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _time(text: Column) -> Column:
    """A date or ISO time; null where it can't be read."""
    own = _trimmed(text)
    return F.when(own.rlike(_TIME), F.try_to_timestamp(own))


def _number(text: Column, default: int) -> Column:
    return F.coalesce(F.nullif(text.try_cast("double").cast("int"), F.lit(0)), F.lit(default))


def bound(calls: DataFrame, tables: Tables, fail_open: bool = True) -> DataFrame:
    """Calls (call_id, name, arguments, viewer_id, channel_id) with their scope, arguments (struct ``a``), the channel
    they ask for and whether they may."""
    own = scopes.resolved(calls.where(F.col("name").isin(*TOOLS)), tables.channels, tables.users, tables.guilds)
    own = own.withColumn("a", F.coalesce(F.from_json(F.coalesce("arguments", F.lit("{}")), _ARGS, {"mode": "PERMISSIVE"}), F.from_json(F.lit("{}"), _ARGS)))
    own = own.withColumns({"everywhere": F.coalesce(F.col("a.all_in_scope"), F.lit(False)) & (F.col("name") == TOOLS[0]), "asked": or_else(F.col("a.channel_id"), F.col("channelId"))})
    own = scopes.permitted(own, tables.channels, "asked", fail_open)
    return own.withColumn("allowed", F.col("allowed") | F.col("everywhere"))


def _searches(calls: DataFrame) -> DataFrame:
    """Calls with the criteria of their search as columns, and ``search``, which is the same for the same criteria."""
    day = F.when(truthy(F.col("a.date")) | truthy(F.col("a.during_date")), F.date_trunc("day", _time(or_else(F.col("a.date"), F.col("a.during_date")))))
    dated = truthy(F.col("a.date")) | truthy(F.col("a.during_date"))
    after, before = F.when(~dated, _time(F.col("a.after_date"))), F.when(~dated, _time(F.col("a.before_date")))
    first = lambda t: snowflake(t).cast("long")
    last = F.when(F.unix_millis(before) >= 1420070400000, first(before) + _LOW).otherwise(first(before))
    reach = F.when(F.col("everywhere"), F.to_json(F.struct("channelId", "isGuild", "guildId", "isDM", "otherUserId"))).otherwise(F.col("asked"))
    own = calls.withColumns(
        {
            "s_reach": reach,
            "s_query": F.lower(F.nullif(_trimmed(F.col("a.query")), F.lit(""))),
            "s_author": F.nullif(F.col("a.author_id"), F.lit("")),
            "s_has": F.when(F.col("a.has").isin(*_KINDS), F.col("a.has")),
            "s_mentions": F.nullif(F.col("a.mentions"), F.lit("")),
            "s_pinned": F.col("a.pinned"),
            "s_low": F.when(day.isNotNull(), first(day)).when(after.isNotNull(), first(after)),
            "s_high": F.when(day.isNotNull(), first(day + F.expr("interval 1 day")) - 1).when(before.isNotNull(), last),
            "s_dated": dated,
            "s_day": day,
            "s_after": _time(F.col("a.after_date")),
            "s_before": _time(F.col("a.before_date")),
            "s_relevance": F.coalesce(F.col("a.sort_by") == "relevance", F.lit(False)),
            "s_up": F.coalesce(F.col("a.sort_order") == "asc", F.lit(False)),
            "s_offset": F.greatest(_number(F.col("a.offset"), 0), F.lit(0)),
            "s_name": F.col("channelName"),
        }
    )
    names = [c for c in own.columns if c.startswith("s_")]
    return own.withColumn("search", F.md5(F.to_json(F.struct(*names), {"ignoreNullFields": "false"})))


def _texts() -> Column:
    """All lower-cased texts of a message that a keyword is looked for in."""
    many = lambda items, name: F.coalesce(F.transform(F.col(items), lambda x: x[name]), F.array().cast("array<string>"))
    one = F.array(F.col("content"), F.col("author.username"), F.col("author.globalName"))
    return F.transform(F.concat(one, many("attachments", "filename"), many("embeds", "title"), many("embeds", "description")), lambda x: F.lower(x))


def _common() -> Column:
    """What both kinds of search ask of a pair of a message and a search."""
    kind = F.lit(True)
    for k in _KINDS:
        kind = F.when(F.col("s_has") == k, P.has(k)).otherwise(kind)
    word = F.col("s_query").isNull() | some(_texts(), lambda t: F.contains(t, F.col("s_query")))
    return (F.col("s_author").isNull() | F.coalesce(F.col("author.id") == F.col("s_author"), F.lit(False))) & kind & word


def _score(text: Column, query: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.when(query.isNull(), F.lit(0)).otherwise((F.length(low) - F.length(F.replace(low, query, F.lit("")))) / F.greatest(F.length(query), F.lit(1))).cast("long")


def matches(searches: DataFrame, reach: DataFrame, messages: DataFrame) -> DataFrame:
    """search, channel_id, id and the order (o1, o2) of all matches. ``reach``: the channels of each search."""
    number = F.col("id").cast("long")
    fields = ["search", *(c for c in searches.columns if c.startswith("s_") and c not in ("s_name", "s_reach"))]
    asked = searches.select(*fields).join(reach, "search").withColumnRenamed("channel_id", "_channel")
    narrow = F.coalesce((F.col("s_high") >= F.col("s_low")) & (F.col("s_high") - F.col("s_low") <= DAYS * _DAY), F.lit(False))
    fits = (
        _common()
        & (F.col("s_low").isNull() | (number >= F.col("s_low")))
        & (F.col("s_high").isNull() | (number <= F.col("s_high")))
        & (F.col("s_pinned").isNull() | F.coalesce(F.col("pinned") == F.col("s_pinned"), F.lit(False)))
        & (F.col("s_mentions").isNull() | some(F.col("mentions"), lambda m: m["id"] == F.col("s_mentions")))
    )
    day = F.floor(number / _DAY).cast("long")
    days = F.sequence(F.floor(F.col("s_low") / _DAY).cast("long"), F.floor(F.col("s_high") / _DAY).cast("long"))
    by_day = messages.withColumn("_day", day).join(asked.where(narrow).select("*", F.explode(days).alias("_asked_day")), (F.col("channel_id") == F.col("_channel")) & (F.col("_day") == F.col("_asked_day")))
    by_channel = messages.join(asked.where(~narrow), F.col("channel_id") == F.col("_channel"))
    score = F.when(F.col("s_relevance"), -_score(F.col("content"), F.col("s_query"))).otherwise(F.lit(0).cast("long"))
    place = F.when(F.col("s_up") & ~F.col("s_relevance"), number).otherwise(-number)
    out = [df.where(fits).select("search", "channel_id", "id", score.alias("o1"), place.alias("o2")) for df in (by_day, by_channel)]
    return out[0].unionByName(out[1])


def _rendered(rows: DataFrame, keys: list[str], text: Column, order: list[str], between: str) -> DataFrame:
    """The texts of each key's few rows, in order, and their number."""
    item = F.struct(*order, text.alias("text"))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["text"]), between).alias("text"), F.count("*").alias("rows"))


def _found(calls: DataFrame, tables: Tables, fail_open: bool) -> DataFrame:
    """call_id and text of searches."""
    spark = calls.sparkSession
    path = own_folder(spark, "searches")
    own = written(_searches(calls.where((F.col("name") == TOOLS[0]) & F.col("allowed"))), f"{path}/calls")
    distinct = own.dropDuplicates(["search"])
    everywhere = scopes.reachable(distinct.where("everywhere"), tables.channels, "search", fail_open)
    reach = written(distinct.where("not everywhere").select("search", F.col("asked").alias("channel_id")).unionByName(everywhere), f"{path}/reach")
    hits = written(matches(distinct, reach, tables.messages), f"{path}/matches")
    totals = hits.groupBy("search").agg(F.count("*").alias("total"))
    most = own.agg(F.coalesce(F.max("s_offset"), F.lit(0)).alias("n")).collect()[0]["n"]
    offsets = distinct.select("search", "s_offset", "s_name")
    first = Window.partitionBy("search").orderBy("o1", "o2")
    page = hits.withColumn("place", F.row_number().over(first)).where(F.col("place") <= most + SHOWN_REMOTE)
    page = page.join(offsets, "search").where((F.col("place") > F.col("s_offset")) & (F.col("place") <= F.col("s_offset") + SHOWN_REMOTE))
    page = tables.messages.join(page.select("search", "s_name", "place", F.col("channel_id").alias("_channel"), F.col("id").alias("_id")), (F.col("channel_id") == F.col("_channel")) & (F.col("id") == F.col("_id")))
    names = tables.channels.select(F.col("id").alias("_named"), F.col("name").alias("_title"))
    line = message_text(F.coalesce(F.nullif("_title", F.lit("")), F.col("s_name")))
    titled = lambda rows: rows.join(names, F.col("channel_id") == F.col("_named"), "left")
    shown = written(_rendered(titled(page), ["search"], line, ["place"], "\n\n"), f"{path}/shown")
    # searches that show nothing look through the newest rows of their channels
    rest = distinct.join(shown.select("search"), "search", "left_anti")
    wanted = rest.select("search", *(c for c in rest.columns if c.startswith("s_"))).join(reach, "search").withColumnRenamed("channel_id", "_channel")
    timed = tables.messages.withColumn("ts", F.try_to_timestamp("timestamp")).join(wanted.select(F.col("_channel").alias("channel_id")).distinct(), "channel_id", "left_semi")
    newest = retrieve.recent(timed, FALLBACK_ROWS).join(wanted, F.col("channel_id") == F.col("_channel"))
    ts = F.col("ts")
    day = ~F.col("s_dated") | ((ts >= F.col("s_day")) & (ts < F.col("s_day") + F.expr("interval 1 day")))
    local = F.coalesce(day & (F.col("s_after").isNull() | (ts >= F.col("s_after"))) & (F.col("s_before").isNull() | (ts <= F.col("s_before"))), F.lit(False))
    last = Window.partitionBy("search").orderBy(F.desc("ts"), F.desc("id"))
    kept = newest.where(_common() & local).withColumn("_rank", F.row_number().over(last)).where(F.col("_rank") <= SHOWN_LOCAL)
    local = _rendered(titled(kept), ["search"], line, ["ts", "id"], "\n\n").select("search", F.col("text").alias("local_text"), F.col("rows").alias("local_rows"))
    out = own.join(totals, "search", "left").join(shown, "search", "left").join(local, "search", "left")
    total = F.coalesce("total", F.lit(0))
    told = F.concat(F.lit("Found "), total, F.lit(" matching messages (search index):\n\n"), F.col("text"))
    # an offset beyond all matches falls back, and still tells of them
    beyond = F.when(total > F.col("s_offset"), F.concat(F.lit("Found "), total, F.lit(" matching messages (search index):\n\n"), F.col("local_text"))).otherwise(F.concat(F.lit("Found "), F.least("local_rows", F.lit(SHOWN_LOCAL)), F.lit(" matching messages in channel history:\n\n"), F.col("local_text")))
    nothing = F.concat(F.lit("No messages found matching search criteria ("), _criteria(), F.lit(") in channel #"), F.col("channelName"), F.lit("."))
    return out.select("call_id", F.coalesce(told, beyond, nothing).alias("text"))


def _criteria() -> Column:
    """FMT2 over the arguments."""
    day = or_else(F.col("a.date"), F.col("a.during_date"))
    pairs = (("Query", F.col("a.query"), '"'), ("Has", F.col("a.has"), '"'), ("Date", day, ""), ("After", F.col("a.after_date"), ""), ("Before", F.col("a.before_date"), ""), ("Author ID", F.col("a.author_id"), ""))
    parts = F.array_compact(F.array(*(F.when(truthy(v), F.concat(F.lit(f"{k}: {q}"), v, F.lit(q))) for k, v, q in pairs)))
    return F.when(F.size(parts) > 0, F.array_join(parts, ", ")).otherwise("unspecified criteria")


def _limit(default: int) -> Column:
    return F.least(F.greatest(_number(F.col("a.limit"), default), F.lit(1)), F.lit(PAGE_CAP))


def _around(calls: DataFrame, tables: Tables) -> DataFrame:
    own = calls.where((F.col("name") == TOOLS[1]) & F.col("allowed")).select("call_id", "asked", F.col("a.message_id").alias("message"), _limit(10).alias("many"))
    timed = tables.messages.withColumn("ts", F.try_to_timestamp("timestamp"))
    rows = retrieve.around(timed, own.select(F.col("asked").alias("channel_id"), F.col("message").alias("id"), "many"), "many")
    texts = _rendered(rows, ["channel_id", "target", "many"], message_text(), ["ts", "id"], "\n").withColumnRenamed("many", "_many")
    out = own.join(texts, (F.col("asked") == F.col("channel_id")) & (F.col("message") == F.col("target")) & (F.col("many") == F.col("_many")), "left")
    named = F.coalesce("message", F.lit("None"))
    told = F.concat(F.lit("Surrounding context around message "), named, F.lit(" ("), F.col("rows"), F.lit(" messages):\n\n"), F.col("text"))
    return out.select("call_id", F.coalesce(told, F.concat(F.lit("No surrounding messages found around message ID "), named, F.lit("."))).alias("text"))


def _recent(calls: DataFrame, tables: Tables) -> DataFrame:
    own = calls.where((F.col("name") == TOOLS[2]) & F.col("allowed")).select("call_id", "asked", _limit(20).alias("many"))
    timed = tables.messages.withColumn("ts", F.try_to_timestamp("timestamp")).join(own.select(F.col("asked").alias("channel_id")).distinct(), "channel_id", "left_semi")
    newest = Window.partitionBy("channel_id").orderBy(F.desc("ts"), F.desc("id"))
    rows = timed.withColumn("_rank", F.row_number().over(newest)).where(F.col("_rank") <= PAGE_CAP)
    pairs = own.select(F.col("asked").alias("_asked"), F.col("many").alias("_many")).distinct()
    rows = rows.join(pairs, (F.col("channel_id") == F.col("_asked")) & (F.col("_rank") <= F.col("_many")))
    texts = _rendered(rows, ["_asked", "_many"], message_text(), ["ts", "id"], "\n")
    out = own.join(texts, (F.col("asked") == F.col("_asked")) & (F.col("many") == F.col("_many")), "left")
    told = F.concat(F.lit("Recent messages in channel ("), F.col("rows"), F.lit(" messages):\n\n"), F.col("text"))
    return out.select("call_id", F.coalesce(told, F.concat(F.lit("No recent messages found in channel "), F.col("asked"), F.lit("."))).alias("text"))


def answers(calls: DataFrame, tables: Tables, fail_open: bool = True) -> DataFrame:
    """call_id and text of calls (call_id, name, arguments, viewer_id, channel_id: where the viewer is)."""
    own = written(bound(calls, tables, fail_open), own_folder(calls.sparkSession, "calls"))
    denied = own.where(~F.col("allowed")).select("call_id", F.concat(F.lit("Error: Access denied. Channel "), F.col("asked"), F.lit(" is outside of allowed scope.")).alias("text"))
    unknown = calls.where(F.col("name").isin(*TOOLS)).join(own.select("call_id"), "call_id", "left_anti").select("call_id", F.lit(None).cast("string").alias("text"))
    out = denied.unionByName(unknown)
    for part in (_found(own, tables, fail_open), _around(own, tables), _recent(own, tables)):
        out = out.unionByName(part)
    return out
