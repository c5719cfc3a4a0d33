"""Citations: flattened references to messages, each message once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.functions.values import nonempty, or_else, truthy
from parlance.operators.retrieve import merged


def cited(messages: DataFrame, channels: DataFrame, scope: dict | None = None, channel_name: str | None = None, avatar_base: str = "https://cdn.example/avatars") -> DataFrame:
    """PRJ1 with JOIN1: a citation of each message. Names come from the argument, the channel, the scope, or 'channel'."""
    scope = scope or {}
    own = channels.select(F.col("id").alias("channel_id"), F.col("name").alias("_name"), F.col("guild_id").alias("_guild"))
    rows = messages.join(own, "channel_id", "left")
    guild = F.lit(scope.get("guildId") if scope.get("isGuild") else None).cast("string")
    avatar = F.when(truthy(F.col("author.avatar")), F.concat(F.lit(f"{avatar_base}/"), F.col("author.id"), F.lit("/"), F.col("author.avatar"), F.lit(".png")))
    first = F.when(nonempty(F.col("attachments")), F.concat(F.lit("["), F.coalesce(F.col("attachments")[0]["filename"], F.lit("")), F.lit("]"))).otherwise("")
    return rows.select(
        F.col("id").alias("messageId"),
        F.col("channel_id").alias("channelId"),
        or_else(F.col("guild_id"), F.col("_guild"), guild).alias("guildId"),
        or_else(F.lit(channel_name).cast("string"), F.col("_name"), F.lit(scope.get("channelName")).cast("string"), "channel").alias("channelName"),
        or_else(F.col("author.globalName"), F.col("author.username"), "User").alias("authorName"),
        avatar.alias("avatarUrl"),
        or_else(F.col("content"), first).alias("content"),
        "timestamp",
        F.transform("attachments", lambda a: a["url"]).alias("attachmentUrls"),
    )


def once(parts: list[DataFrame]) -> DataFrame:
    """AGG4: citations of several tool calls; the first one of a message stays."""
    return merged(parts, "messageId", last=False)
