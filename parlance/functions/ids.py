"""Ids that encode time, and message URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parlance.sources.schema import EPOCH_MS

#: Milliseconds after which the shifted number leaves 64 bits (fixed value).
_LAST_MS = EPOCH_MS + (1 << 41) - 1


def snowflake(ts: Column) -> Column:
    """The least id of a timestamp, as a string; '0' for null and for times up to the epoch. Later times are clamped
    to the last one that fits 64 bits."""
    ms = F.unix_millis(ts.cast("timestamp"))
    ms = F.when(ms > _LAST_MS, F.lit(_LAST_MS).cast("long")).otherwise(ms)
    return F.coalesce(F.when(ms.isNotNull(), F.greatest(F.shiftleft(ms - EPOCH_MS, 22), F.lit(0).cast("long"))), F.lit(0).cast("long")).cast("string")


def snowflake_time(identifier: Column) -> Column:
    """The time of an id; null where it is no number."""
    number = F.try_cast(identifier, "long") if hasattr(F, "try_cast") else identifier.try_cast("long")
    return F.timestamp_millis(F.shiftright(number, 22) + F.lit(EPOCH_MS))


def day_bounds(day: str) -> tuple[Column, Column]:
    """Start of a UTC day and of the next one; null where the day can't be read."""
    start = F.date_trunc("day", F.try_to_timestamp(F.lit(day)))
    return start, start + F.expr("interval 1 day")


#: What follows the host or scheme of a message URL, by family; ids are what stands between slashes (fixed values).
_THREE = r"channels/([^/\s]+)/([^/\s]+)(?:/([^/\s]+))?"
_TWO = r"message/([^/\s]+)/([^/\s]+)"


def message_url_parts(url: Column, site: str | None = None, scheme: str | None = None) -> Column:
    """guild_id (null for @me), channel_id, message_id (null where it is left out) of a message URL; nulls where it is
    none. Families, the first that fits, whatever the case: the web site (``http`` may be missing; also hosts below it),
    a path, the app's scheme with channel and message, the scheme with all three. ``site`` and ``scheme``: any if None."""
    host = r"(?:[\w-]+\.)+[a-z]+" if site is None else r"(?:[\w-]+\.)*" + site.replace(".", r"\.")
    app = "[a-z]+" if scheme is None else scheme
    families = ((rf"(?:https?://)?{host}/{_THREE}", (1, 2, 3)), (rf"^/?{_THREE}", (1, 2, 3)), (rf"{app}://{_TWO}", (0, 1, 2)), (rf"{app}://-?/?{_THREE}", (1, 2, 3)))
    out = F.lit(None).cast("struct<guild_id:string,channel_id:string,message_id:string>")
    for pattern, groups in families[::-1]:
        found = "(?i)" + pattern
        part = [F.nullif(F.regexp_extract(url, found, i), F.lit("")) if i else F.lit(None).cast("string") for i in groups]
        out = F.when(url.rlike(found), F.struct(F.nullif(part[0], F.lit("@me")).alias("guild_id"), part[1].alias("channel_id"), part[2].alias("message_id"))).otherwise(out)
    none = F.lit(None).cast("string")
    return F.coalesce(out, F.struct(none.alias("guild_id"), none.alias("channel_id"), none.alias("message_id")))


def message_url(base: str, guild: Column, channel: Column, message: Column) -> Column:
    return F.concat(F.lit(f"{base.rstrip('/')}/channels/"), F.coalesce(F.nullif(guild, F.lit("")), F.lit("@me")), F.lit("/"), channel, F.when(F.coalesce(message, F.lit("")) != "", F.concat(F.lit("/"), message)).otherwise(""))


def url_host(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-z]+://([^/?#]+)", 1)


def clean_base(url: Column) -> Column:
    """Without one slash at the end."""
    return F.regexp_replace(F.trim(url), "/$", "")


def query_string(args: dict[str, object]) -> str:
    """Arguments that are set, as a query string."""
    from urllib.parse import urlencode

    return urlencode({k: v for k, v in args.items() if v is not None and v != ""})
