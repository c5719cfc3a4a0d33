"""Which channels a viewer may search from where they are, and restriction to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions.values import or_else
from parlance.operators.predicates import group_with, text_channel, viewable
from parlance.sources.schema import DM, GROUP_DM


def accessible(channels: DataFrame, guild_id: str, fail_open: bool = True) -> DataFrame:
    """PRJ3 with PRD18 and PRD19: text channels of a guild that may be viewed: id, name, topic."""
    own = channels.where((F.col("guild_id") == guild_id) & text_channel(F.col("type")) & viewable(F.col("permissions"), fail_open))
    return own.select("id", or_else(F.col("name"), F.concat(F.lit("channel-"), F.col("id"))).alias("name"), "topic")


def mutual_groups(channels: DataFrame, users: DataFrame, user_id: str) -> DataFrame:
    """PRJ4: group conversations with a user: id, name, recipientNames (in the order of the recipients)."""
    named = users.select(F.col("id").alias("user_id"), or_else(F.col("globalName"), F.col("username"), F.col("id")).alias("user_name"))
    members = channels.where(group_with(user_id)).select("id", "name", F.posexplode("recipients").alias("pos", "user_id"))
    rows = members.join(named, "user_id", "left").groupBy("id", "name").agg(F.sort_array(F.collect_list(F.struct("pos", F.coalesce("user_name", "user_id").alias("name")))).alias("names"))
    names = F.col("names.name")
    return rows.select("id", or_else(F.col("name"), F.concat(F.lit("Group ("), F.array_join(names, ", "), F.lit(")"))).alias("name"), names.alias("recipientNames"))


def resolve(channels: DataFrame, users: DataFrame, guilds: DataFrame, channel_id: str, viewer_id: str | None = None, fail_open: bool = True) -> dict | None:
    """PRJ9: the scope of a channel; None for an unknown one. Reads single rows by id on the driver."""
    found = channels.where(F.col("id") == channel_id).limit(1).collect()
    if not found:
        return None
    own = found[0]
    scope = {"channelId": own["id"], "channelName": own["name"] or "channel", "channelType": own["type"], "isDM": own["type"] == DM, "isGroupDM": own["type"] == GROUP_DM, "isGuild": own["guild_id"] is not None, "guildId": own["guild_id"], "guildName": None, "otherUserId": None, "fail_open": fail_open}
    if scope["isGuild"]:
        guild = guilds.where(F.col("id") == own["guild_id"]).select("name").limit(1).collect()
        scope["guildName"] = guild[0]["name"] if guild else None
    elif scope["isDM"]:
        others = [x for x in own["recipients"] or [] if x != viewer_id]
        if others:
            scope["otherUserId"] = others[0]
            who = users.where(F.col("id") == others[0]).limit(1).collect()
            scope["channelName"] = "@" + ((who[0]["globalName"] or who[0]["username"]) if who else others[0])
    return scope


def allowed(scope: dict, channels: DataFrame) -> DataFrame:
    """PRD21: channel_id of every channel that the scope may read: its own, and those of its guild, or the groups that
    the other user of a direct conversation is in."""
    own = channels.sparkSession.createDataFrame([(scope["channelId"],)], "channel_id string")
    if scope.get("isGuild"):
        more = accessible(channels, scope["guildId"], scope.get("fail_open", True))
    elif scope.get("isDM") and scope.get("otherUserId"):
        more = channels.where(group_with(scope["otherUserId"]))
    else:
        return own
    return own.unionByName(more.select(F.col("id").alias("channel_id"))).distinct()


def with_guild(channels: DataFrame, guilds: DataFrame, guild: str = "guild_id") -> DataFrame:
    """JOIN6: channels with their guild's name (column ``guild_name``), null where the guild is unknown or none."""
    own = guilds.select(F.col("id").alias("_guild"), F.col("name").alias("guild_name"))
    return channels.join(own, F.col(guild) == F.col("_guild"), "left").drop("_guild")


def resolved(viewers: DataFrame, channels: DataFrame, users: DataFrame, guilds: DataFrame) -> DataFrame:
    """PRJ9 for many: viewers (viewer_id, channel_id and any others) with their channel's scope, as ``resolve`` has it
    for one, by joins on ids. Viewers of unknown channels have no row; ids of channels, users and guilds are unique."""
    own = channels.select(F.col("id").alias("channelId"), F.col("name").alias("_name"), F.col("type").alias("channelType"), F.col("guild_id").alias("guildId"), F.col("recipients").alias("_recipients"))
    rows = viewers.join(own, F.col("channel_id") == F.col("channelId"))
    rows = with_guild(rows, guilds, "guildId").withColumnRenamed("guild_name", "guildName")
    rows = rows.withColumns({"isDM": F.coalesce(F.col("channelType") == DM, F.lit(False)), "isGroupDM": F.coalesce(F.col("channelType") == GROUP_DM, F.lit(False)), "isGuild": F.col("guildId").isNotNull()})
    others = F.filter(F.coalesce("_recipients", F.array().cast("array<string>")), lambda x: F.coalesce(x != F.col("viewer_id"), F.lit(True)))
    rows = rows.withColumn("otherUserId", F.when(F.col("isDM") & ~F.col("isGuild"), F.get(others, F.lit(0))))
    rows = rows.join(users.select(F.col("id").alias("_user"), or_else(F.col("globalName"), F.col("username")).alias("_who")), F.col("otherUserId") == F.col("_user"), "left")
    name = F.when(F.col("otherUserId").isNotNull(), F.concat(F.lit("@"), F.coalesce("_who", "otherUserId"))).otherwise(or_else(F.col("_name"), "channel"))
    return rows.withColumn("channelName", name).drop("_name", "_recipients", "_guild", "_user", "_who")


def permitted(asked: DataFrame, channels: DataFrame, target: str, fail_open: bool = True) -> DataFrame:
    """PRD21 for many: rows with a scope, and whether it allows the channel of column ``target`` (column ``allowed``). One
    join on the target's id; a guild's channels are never listed out."""
    own = channels.select(F.col("id").alias("_id"), F.col("guild_id").alias("_guild"), (text_channel(F.col("type")) & viewable(F.col("permissions"), fail_open)).alias("_open"), F.when(F.col("type") == GROUP_DM, F.col("recipients")).alias("_members"))
    rows = asked.join(own, F.col(target) == F.col("_id"), "left")
    guild = F.col("isGuild") & (F.col("_guild") == F.col("guildId")) & F.col("_open")
    group = ~F.col("isGuild") & F.col("isDM") & F.array_contains("_members", F.col("otherUserId"))
    here = F.col(target) == F.col("channelId")
    return rows.withColumn("allowed", F.coalesce(here, F.lit(False)) | F.coalesce(guild, F.lit(False)) | F.coalesce(group, F.lit(False))).drop("_id", "_guild", "_open", "_members")


def reachable(scopes: DataFrame, channels: DataFrame, key: str, fail_open: bool = True) -> DataFrame:
    """``allowed`` for many: (key, channel_id) of every channel that a scope may read, each once."""
    own = scopes.select(key, F.col("channelId").alias("channel_id"))
    open_ = channels.where(text_channel(F.col("type")) & viewable(F.col("permissions"), fail_open)).select(F.col("guild_id").alias("guildId"), F.col("id").alias("channel_id"))
    guild = scopes.where("isGuild").select(key, "guildId").join(open_, "guildId").select(key, "channel_id")
    members = channels.where(F.col("type") == GROUP_DM).select(F.col("id").alias("channel_id"), F.explode(F.array_distinct("recipients")).alias("otherUserId"))
    group = scopes.where("isDM and not isGuild").select(key, "otherUserId").join(members, "otherUserId").select(key, "channel_id")
    return own.unionByName(guild).unionByName(group).distinct()


def restrict(messages: DataFrame, allowed_channels: DataFrame, channel: str = "channel_id") -> DataFrame:
    """JOIN4: a semi-join; Spark broadcasts the list where its measured size allows that."""
    return messages.join(allowed_channels.select(F.col("channel_id").alias(channel)), channel, "left_semi")


def is_allowed(channel_id: str, scope: dict, channels: DataFrame) -> bool:
    return channel_id == scope["channelId"] or not allowed(scope, channels).where(F.col("channel_id") == channel_id).isEmpty()


def label(counted: Column, one: str, many: str) -> Column:
    """PRJ10: a count with its word."""
    return F.concat(counted.cast("string"), F.lit(" "), F.when(counted == 1, one).otherwise(many))
