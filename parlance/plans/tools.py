"""The tools as table functions, called by name with JSON arguments."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.functions.render import criteria, joined, mention_block, message_text
from parlance.operators import retrieve, scope as scopes
from parlance.operators.search import SearchOptions, found, shown
from parlance.sources.schema import SHOWN_LOCAL


@dataclass
class Tables:
    messages: DataFrame
    channels: DataFrame
    users: DataFrame
    guilds: DataFrame


def parsed(arguments: str | None) -> dict:
    """Arguments of a call; none where the text is no JSON object."""
    try:
        out = json.loads(arguments or "{}")
    except ValueError:
        return {}
    return out if isinstance(out, dict) else {}


def prompt_turns(history: DataFrame, system: str, prompt: str, scope: dict, users: DataFrame | None = None) -> list[tuple[str, str]]:
    """What an answer starts from: the system text with the scope and the mentioned users, the last turns of the
    session (columns session_id, pos, role, content), and the prompt."""
    kind = "Direct Message" if scope["isDM"] else "Group DM" if scope["isGroupDM"] else f"Guild ({scope['guildName'] or scope['guildId']})"
    text = f"{system}\n\n[Scope]: #{scope['channelName']} ({scope['channelId']}), {kind}"
    if users is not None:
        lines = [r["line"] for r in mention_block(users).orderBy("id").collect()]
        text += "\n\n[Mentioned]:\n" + "\n".join(lines) if lines else ""
    turns = [(r["role"], r["content"]) for r in retrieve.history(history).orderBy("pos").collect()]
    return [("system", text), *turns, ("user", prompt)]


def current_context(tables: Tables, scope: dict, args: dict) -> str:
    """TVF1."""
    return json.dumps({k: v for k, v in scope.items() if k != "fail_open"}, indent=2)


def available_channels(tables: Tables, scope: dict, args: dict) -> str:
    """TVF2: one shape for guilds, direct conversations and others."""
    if scope["isGuild"]:
        rows = scopes.accessible(tables.channels, scope["guildId"], scope.get("fail_open", True)).orderBy("id").collect()
        return json.dumps({"guild": {"id": scope["guildId"], "name": scope["guildName"]}, "channels": [r.asDict() for r in rows]}, indent=2)
    if scope["isDM"] and scope["otherUserId"]:
        rows = scopes.mutual_groups(tables.channels, tables.users, scope["otherUserId"]).orderBy("id").collect()
        return json.dumps({"dm": {"id": scope["channelId"], "name": scope["channelName"]}, "mutualGroups": [r.asDict() for r in rows]}, indent=2)
    return json.dumps({"channel": {"id": scope["channelId"], "name": scope["channelName"]}}, indent=2)


def _denied(channel_id: str) -> str:
    return f"Error: Access denied. Channel {channel_id} is outside of allowed scope."


def _named(rows: DataFrame, tables: Tables, scope: dict) -> DataFrame:
    """Rows with their own channel's name."""
    names = tables.channels.select(F.col("id").alias("channel_id"), F.col("name").alias("_channel"))
    return rows.join(names, "channel_id", "left").withColumn("_channel", F.coalesce(F.nullif("_channel", F.lit("")), F.lit(scope["channelName"])))


def search_messages(tables: Tables, scope: dict, args: dict) -> str:
    """TVF3. With ``all_in_scope`` every allowed channel is searched, not just one."""
    everywhere = bool(args.get("all_in_scope"))
    channel = args.get("channel_id") or scope["channelId"]
    if not everywhere and not scopes.is_allowed(channel, scope, tables.channels):
        return _denied(channel)
    options = SearchOptions(
        content=args.get("query"), channel_id=None if everywhere else channel, author_id=args.get("author_id"), has=args.get("has"), during=args.get("date") or args.get("during_date"), after=args.get("after_date"), before=args.get("before_date"), pinned=args.get("pinned"), mentions=args.get("mentions"), sort_by=args.get("sort_by") or "timestamp", sort_order=args.get("sort_order") or "desc", offset=args.get("offset") or 0
    )
    own = scopes.restrict(tables.messages, scopes.allowed(scope, tables.channels))
    # the number of all matches comes with the shown rows, by a scalar subquery
    total = found(own, options).agg(F.count("*").alias("total")).scalar()
    rows = _named(shown(own, options), tables, scope)
    text = joined(rows.withColumn("text", message_text(F.col("_channel"))), "text", [F.col("place")], "\n\n").withColumn("total", total).collect()[0]
    if text["rows"]:
        total = text["total"]
        if total > options.offset:
            return f"Found {total} matching messages (search index):\n\n{text['text']}"
        return f"Found {min(text['rows'], SHOWN_LOCAL)} matching messages in channel history:\n\n{text['text']}"
    what = criteria(options.content, options.has, options.during, options.after, options.before, options.author_id)
    return f"No messages found matching search criteria ({what or 'unspecified criteria'}) in channel #{scope['channelName']}."


def fetch_surrounding_messages(tables: Tables, scope: dict, args: dict) -> str:
    """TVF4."""
    channel, message = args.get("channel_id") or scope["channelId"], args.get("message_id")
    if not scopes.is_allowed(channel, scope, tables.channels):
        return _denied(channel)
    own = tables.messages.where(F.col("channel_id") == channel).withColumn("ts", F.try_to_timestamp("timestamp"))
    targets = own.where(F.col("id") == message).select("channel_id", "id")
    rows = retrieve.around(own, targets, retrieve.asked_limit(args.get("limit"), 10))
    text = joined(rows.withColumn("text", message_text()), "text", [F.col("ts"), F.col("id")], "\n").collect()[0]
    if not text["rows"]:
        return f"No surrounding messages found around message ID {message}."
    return f"Surrounding context around message {message} ({text['rows']} messages):\n\n{text['text']}"


def fetch_recent_messages(tables: Tables, scope: dict, args: dict) -> str:
    """TVF5."""
    channel = args.get("channel_id") or scope["channelId"]
    if not scopes.is_allowed(channel, scope, tables.channels):
        return _denied(channel)
    own = tables.messages.where(F.col("channel_id") == channel).withColumn("ts", F.try_to_timestamp("timestamp"))
    rows = retrieve.recent(own, retrieve.asked_limit(args.get("limit"), 20))
    text = joined(rows.withColumn("text", message_text()), "text", [F.col("ts"), F.col("id")], "\n").collect()[0]
    if not text["rows"]:
        return f"No recent messages found in channel {channel}."
    return f"Recent messages in channel ({text['rows']} messages):\n\n{text['text']}"


#: Calling an external model to look at an image is no table function, so that tool has no entry.
TOOLS = {
    "get_current_context": current_context,
    "list_available_channels": available_channels,
    "search_messages": search_messages,
    "fetch_surrounding_messages": fetch_surrounding_messages,
    "fetch_recent_messages": fetch_recent_messages,
}


def call(name: str, arguments: str | None, tables: Tables, scope: dict) -> str:
    tool = TOOLS.get(name)
    if tool is None:
        return f"Error: Unknown tool {name}."
    return tool(tables, scope, parsed(arguments))
