"""Predicates over messages and channels, as Column builders. Names follow the ids of the inventory (PRD1 to PRD23)."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions.ids import snowflake
from parlance.functions.values import contains, nonempty, or_else, some, truthy
from parlance.sources.schema import GROUP_DM, TEXT_TYPES, VIEW_CHANNEL

#: Extensions by kind of media (fixed values).
EXTENSIONS = {
    "image": ("png", "jpg", "jpeg", "webp", "gif", "bmp", "svg"),
    "video": ("mp4", "webm", "mov", "mkv", "avi"),
    "audio": ("mp3", "wav", "ogg", "m4a", "flac", "aac"),
}
_LINK = r"(?i)https?://[^\s]+"


def parse_time(text: str | None) -> datetime | None:
    """A date or ISO time as UTC; None where it can't be read."""
    try:
        when = datetime.fromisoformat((text or "").strip().replace("Z", "+00:00"))
    except ValueError:
        return None
    return when.replace(tzinfo=timezone.utc) if when.tzinfo is None else when


def _time(when: datetime) -> Column:
    return F.lit(when.astimezone(timezone.utc).strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp")


def author(column: Column, author_id: str | int) -> Column:
    """PRD1."""
    return F.coalesce(column == author_id, F.lit(False))


def during(ts: Column, day: str) -> Column:
    """PRD2: the UTC day of a time; a day that can't be read is an error."""
    when = parse_time(day)
    if when is None:
        raise ValueError(f"not a date: {day!r}")
    start = when.astimezone(timezone.utc).replace(hour=0, minute=0, second=0, microsecond=0)
    return (ts >= _time(start)) & (ts < _time(start) + F.expr("interval 1 day"))


def after(ts: Column, text: str | None) -> Column:
    """PRD3: inclusive; no filter where the date can't be read."""
    when = parse_time(text)
    return F.lit(True) if when is None else ts >= _time(when)


def before(ts: Column, text: str | None) -> Column:
    """PRD4: inclusive; a bare date is its midnight."""
    when = parse_time(text)
    return F.lit(True) if when is None else ts <= _time(when)


def _media(kind: str) -> Column:
    pattern = rf"(?i)\.({'|'.join(EXTENSIONS[kind])})$"
    return some(F.col("attachments"), lambda a: F.coalesce(a["content_type"].startswith(f"{kind}/"), F.lit(False)) | or_else(a["filename"], a["url"]).rlike(pattern))


def has(kind: str) -> Column:
    """PRD5 to PRD11 over attachments, embeds and content. A sticker can't be told locally, so it filters nothing."""
    embeds = F.col("embeds")
    if kind == "link":
        return F.coalesce(F.col("content").rlike(_LINK), F.lit(False)) | some(embeds, lambda e: truthy(e["url"]) | truthy(e["title"]) | truthy(e["description"]))
    if kind == "file":
        return nonempty(F.col("attachments"))
    if kind == "image":
        return _media("image") | some(embeds, lambda e: e["image"].isNotNull() | e["thumbnail"].isNotNull())
    if kind == "video":
        return _media("video") | some(embeds, lambda e: e["type"] == "video")
    if kind == "sound":
        return _media("audio")
    if kind == "embed":
        return nonempty(embeds)
    return F.lit(True)


def keyword(query: str) -> Column:
    """PRD12: a literal, case-insensitive substring of content, file names, embeds or the author's names."""
    q = query.strip()
    return (
        contains(F.col("content"), q)
        | some(F.col("attachments"), lambda a: contains(a["filename"], q))
        | some(F.col("embeds"), lambda e: contains(e["title"], q) | contains(e["description"], q))
        | contains(F.col("author.username"), q)
        | contains(F.col("author.globalName"), q)
    )


def id_range(column: Column, low: str | None = None, high: str | None = None) -> Column:
    """PRD13: ids between two bounds, both included; a missing bound doesn't filter."""
    out = F.lit(True)
    if low:
        out = out & (column.cast("long") >= int(low))
    if high:
        out = out & (column.cast("long") <= int(high))
    return out


def id_day(column: Column, day: str) -> Column:
    """PRD14: the ids of a UTC day, as a half-open range of numbers that reaches the scan."""
    when = parse_time(day)
    if when is None:
        return F.lit(True)
    start = when.astimezone(timezone.utc).replace(hour=0, minute=0, second=0, microsecond=0)
    own = column.cast("long")
    return (own >= snowflake(_time(start)).cast("long")) & (own < snowflake(_time(start) + F.expr("interval 1 day")).cast("long"))


def pinned(column: Column, value: bool | None) -> Column:
    """PRD15: three states; None doesn't filter."""
    return F.lit(True) if value is None else F.coalesce(column == value, F.lit(False))


def mentions(user_id: str) -> Column:
    """PRD16."""
    return some(F.col("mentions"), lambda m: m["id"] == user_id)


def text_channel(kind: Column) -> Column:
    """PRD18."""
    return F.coalesce(kind.isin(*TEXT_TYPES), F.lit(False))


def viewable(permissions: Column, fail_open: bool = True) -> Column:
    """PRD19: the view bit; unknown permissions count as allowed, or denied with ``fail_open=False``."""
    return F.coalesce(permissions.bitwiseAND(VIEW_CHANNEL) != 0, F.lit(fail_open))


def group_with(user_id: str) -> Column:
    """PRD20: group conversations that a user takes part in."""
    return (F.col("type") == GROUP_DM) & F.coalesce(F.array_contains("recipients", user_id), F.lit(False))


def trace_step(kind: Column) -> Column:
    """PRD22."""
    return F.coalesce(kind.isin("tool_call", "tool_result", "error"), F.lit(False))


def mention_match(query: str) -> Column:
    """PRD23 over users: part of a name, or the id."""
    q = query.strip().lower()
    return contains(F.col("username"), q) | contains(F.col("globalName"), q) | F.coalesce(F.col("id") == q, F.lit(False))


@dataclass
class LocalFilter:
    """Criteria that hold together; empty ones don't filter."""

    query: str | None = None
    has: str | None = None
    author_id: str | None = None
    during_date: str | None = None
    after_date: str | None = None
    before_date: str | None = None

    def column(self) -> Column:
        ts = F.col("ts")
        out = F.lit(True)
        if self.author_id:
            out = out & author(F.col("author.id"), self.author_id)
        if self.during_date:
            out = out & F.coalesce(during(ts, self.during_date), F.lit(False))
        if self.after_date:
            out = out & F.coalesce(after(ts, self.after_date), F.lit(False))
        if self.before_date:
            out = out & F.coalesce(before(ts, self.before_date), F.lit(False))
        if self.has:
            out = out & has(self.has)
        if (self.query or "").strip():
            out = out & keyword(self.query)
        return out

    def apply(self, messages: DataFrame) -> DataFrame:
        """``messages`` have the message schema, and may have ``ts``; otherwise it is read from ``timestamp``."""
        if "ts" in messages.columns:
            return messages.where(self.column())
        timed = messages.withColumn("ts", F.try_to_timestamp("timestamp"))
        return timed.where(self.column()).drop("ts")
