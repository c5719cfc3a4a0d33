"""Rows as text: messages, headers, mention blocks and steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions.values import or_else, truthy


def _text(x: Column) -> Column:
    return F.coalesce(x.cast("string"), F.lit(""))


def stamp(ts: Column) -> Column:
    """UTC time as text; the session's time zone is UTC."""
    return F.date_format(ts.cast("timestamp"), "yyyy-MM-dd HH:mm:ss")


def message_line(ts: Column, channel: Column, name: Column, author_id: Column, message_id: Column, content: Column) -> Column:
    """The first line of a rendered message; null parts are left empty."""
    where = F.when(truthy(channel), F.concat(F.lit(" [#"), channel, F.lit("]"))).otherwise("")
    return F.concat(F.lit("["), _text(stamp(ts)), F.lit("]"), where, F.lit(" "), name, F.lit(" ("), _text(author_id), F.lit(") [ID:"), _text(message_id), F.lit("]: "), _text(content))


def message_text(channel: Column | None = None) -> Column:
    """FMT1 over rows of the message schema: the line, then one for each attachment and each embed that says something."""
    author = F.col("author")
    line = message_line(F.try_to_timestamp("timestamp"), F.lit(None).cast("string") if channel is None else channel, or_else(author["globalName"], author["username"], "Unknown"), author["id"], F.col("id"), F.col("content"))
    attachments = F.transform(F.coalesce("attachments", F.array()), lambda a: F.concat(F.lit("\n  [Attachment: "), _text(a["filename"]), F.lit(" ("), or_else(a["content_type"], "file"), F.lit(") - "), _text(a["url"]), F.lit("]")))
    telling = F.filter(F.coalesce("embeds", F.array()), lambda e: truthy(e["title"]) | truthy(e["description"]) | truthy(e["url"]))
    embeds = F.transform(telling, lambda e: F.concat(F.lit('\n  [Embed: "'), _text(e["title"]), F.lit('" - '), _text(or_else(e["description"], e["url"], "")), F.lit("]")))
    return F.concat(line, F.array_join(attachments, ""), F.array_join(embeds, ""))


def joined(rows: DataFrame, text: str, order: list[Column], between: str) -> DataFrame:
    """SNK7: the texts of a small, limited result as one, in order."""
    return rows.select(F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order)), F.col(text).alias("text")).alias("x")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["text"]), between).alias("text"), F.count("*").alias("rows"))


def mention_block(users: DataFrame) -> DataFrame:
    """FMT3: one line for each mentioned user, with the name to show, the id, and a mark for bots."""
    name = F.when(truthy(F.col("globalName")), F.concat(F.col("globalName"), F.lit(" (@"), F.col("username"), F.lit(")"))).otherwise(F.concat(F.lit("@"), F.col("username")))
    mark = F.when(F.coalesce("bot", F.lit(False)), " [Bot]").otherwise("")
    return users.select("*", F.concat(F.lit("- "), name, F.lit(' (ID: "'), F.col("id"), F.lit('")'), mark).alias("line"))


def criteria(query: str | None = None, has: str | None = None, during: str | None = None, after: str | None = None, before: str | None = None, author_id: str | None = None) -> str:
    """FMT2: the criteria of a search that found nothing."""
    pairs = (("Query", query, '"'), ("Has", has, '"'), ("Date", during, ""), ("After", after, ""), ("Before", before, ""), ("Author ID", author_id, ""))
    return ", ".join(f"{k}: {q}{v}{q}" for k, v, q in pairs if v)


#: Marks of tools and of steps (fixed values).
TOOL_ICONS = {"search_messages": "\U0001f50d", "fetch_surrounding_messages": "\U0001f4dc", "fetch_recent_messages": "\U0001f4dc", "inspect_image": "\U0001f5bc\ufe0f", "list_available_channels": "\U0001f9ed", "get_current_context": "\U0001f9ed"}
OTHER_ICON, FAILED_ICON, DONE_ICON, WAITING_ICON = "\u26a1", "\u274c", "\u2705", "\u23f3"


def tool_icon(name: Column) -> Column:
    out = F.lit(OTHER_ICON)
    for tool, icon in TOOL_ICONS.items():
        out = F.when(name == tool, icon).otherwise(out)
    return out


def status_icon(kind: Column, result: Column) -> Column:
    """Of a step: failed, done (it has a result, be it empty), or waiting."""
    return F.when(kind == "error", FAILED_ICON).when(result.isNotNull(), DONE_ICON).otherwise(WAITING_ICON)


def step_title(name: Column, args: Column, content: Column, service: str = "messages") -> Column:
    """PRJ11: what a step does, with the arguments (struct of query, has, message_id) that say what for."""
    query = F.when(truthy(args["query"]), F.concat(F.lit('"'), args["query"], F.lit('"'))).otherwise("")
    kind = F.when(truthy(args["has"]), F.concat(F.lit(" [has:"), args["has"], F.lit("]"))).otherwise("")
    return (
        F.when(name == "search_messages", F.trim(F.concat(F.lit(f"Search {service} "), query, kind)))
        .when(name == "fetch_surrounding_messages", F.trim(F.concat(F.lit("Fetch context around message "), _text(args["message_id"]))))
        .when(name == "fetch_recent_messages", "Fetch recent channel messages")
        .when(name == "inspect_image", "Inspect image attachment")
        .when(name == "list_available_channels", "Discover available channel scopes")
        .otherwise(or_else(content, F.concat(F.lit("Executing "), or_else(name, "tool"))))
    )


def step_summary(name: Column, status: Column) -> Column:
    """PRJ11: what a tool does, or did, in words."""
    verb = F.when(status == "tool_call", "Running").when(status == "error", "Failed").otherwise("Done")
    what = (
        F.when(name == "get_current_context", "reading the context")
        .when(name == "list_available_channels", "listing channels")
        .when(name == "search_messages", "searching messages")
        .when(name == "fetch_surrounding_messages", "reading around a message")
        .when(name == "fetch_recent_messages", "reading recent messages")
        .when(name == "inspect_image", "looking at an image")
        .otherwise(name)
    )
    return F.concat(verb, F.lit(": "), what)
