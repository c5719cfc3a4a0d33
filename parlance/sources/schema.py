"""Fixed schemas of the entities, and their constants."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v, True) for k, v in fields.items()])


_S, _L, _I, _B = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType()

USER = _struct(id=_S, username=_S, globalName=_S, avatar=_S, discriminator=_S, bot=_B)
ATTACHMENT = _struct(id=_S, filename=_S, size=_L, url=_S, proxy_url=_S, content_type=_S, width=_I, height=_I, description=_S)
IMAGE = _struct(url=_S, proxy_url=_S, width=_I, height=_I)
EMBED = _struct(title=_S, type=_S, description=_S, url=_S, timestamp=_S, color=_I, image=IMAGE, thumbnail=IMAGE)
MESSAGE = _struct(
    id=_S, channel_id=_S, guild_id=_S, author=USER, content=_S, timestamp=_S, edited_timestamp=_S, attachments=T.ArrayType(ATTACHMENT), embeds=T.ArrayType(EMBED), mentions=T.ArrayType(USER), hit=_B, pinned=_B
)
CHANNEL = _struct(id=_S, type=_I, name=_S, topic=_S, guild_id=_S, recipients=T.ArrayType(_S), ownerId=_S, permissions=_L)
GUILD = _struct(id=_S, name=_S, icon=_S, ownerId=_S)
SCOPE_CHANNEL = _struct(id=_S, name=_S, topic=_S)
CITATION = _struct(messageId=_S, channelId=_S, guildId=_S, channelName=_S, authorId=_S, authorName=_S, avatarUrl=_S, content=_S, timestamp=_S, attachmentUrls=T.ArrayType(_S))
TOOL_CALL = _struct(id=_S, name=_S, arguments=_S)
STEP = _struct(id=_S, type=_S, name=_S, args=_S, result=_S, timestamp=_L)
CHAT_MESSAGE = _struct(id=_S, role=_S, content=_S, timestamp=_L, steps=T.ArrayType(STEP), citations=T.ArrayType(CITATION))
SESSION = _struct(id=_S, channelId=_S, title=_S, messages=T.ArrayType(CHAT_MESSAGE), createdAt=_L, updatedAt=_L, deleted=_B)
FRAGMENT = _struct(stream_id=_S, seq=_L, line=_S)

#: Channel types, as the service numbers them (fixed values).
GUILD_TEXT, DM, GUILD_VOICE, GROUP_DM, GUILD_CATEGORY, GUILD_ANNOUNCEMENT = 0, 1, 2, 3, 4, 5
ANNOUNCEMENT_THREAD, PUBLIC_THREAD, PRIVATE_THREAD, GUILD_STAGE_VOICE, GUILD_DIRECTORY, GUILD_FORUM, GUILD_MEDIA = 10, 11, 12, 13, 14, 15, 16
TEXT_TYPES = (GUILD_TEXT, GUILD_ANNOUNCEMENT, PUBLIC_THREAD, PRIVATE_THREAD, GUILD_FORUM)
VIEW_CHANNEL = 1024
#: Limits of the tools (fixed values).
PAGE_CAP, SHOWN_REMOTE, SHOWN_LOCAL, FALLBACK_ROWS, SUGGESTED, HISTORY, LOG_ROWS = 50, 15, 10, 50, 8, 6, 60
EPOCH_MS = 1420070400000
EOF_MARK = "[DONE]"
