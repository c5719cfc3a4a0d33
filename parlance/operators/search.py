"""Message search: options become predicates that reach the scan; an empty result falls back to recent rows."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.operators import predicates as P
from parlance.operators.retrieve import recent, term_score
from parlance.sources.schema import FALLBACK_ROWS, SHOWN_LOCAL, SHOWN_REMOTE


@dataclass
class SearchOptions:
    content: str | None = None
    channel_id: str | None = None
    guild_id: str | None = None
    author_id: str | None = None
    has: str | None = None
    during: str | None = None
    after: str | None = None
    before: str | None = None
    min_id: str | None = None
    max_id: str | None = None
    pinned: bool | None = None
    mentions: str | None = None
    sort_by: str = "timestamp"
    sort_order: str = "desc"
    offset: int = 0

    def column(self) -> Column:
        """SRC1: all criteria. Dates become id ranges and override explicit bounds; a day overrides after and before.
        Unreadable dates don't filter here."""
        out = F.lit(True)
        number = F.col("id")
        if self.channel_id:
            out = out & (F.col("channel_id") == self.channel_id)
        if self.guild_id:
            out = out & (F.col("guild_id") == self.guild_id)
        if self.author_id:
            out = out & P.author(F.col("author.id"), self.author_id)
        if self.has:
            out = out & P.has(self.has)
        if (self.content or "").strip():
            out = out & P.keyword(self.content)
        if self.during:
            out = out & P.id_day(number, self.during)
        else:
            low = self.min_id if P.parse_time(self.after) is None else str(id_at(self.after))
            high = self.max_id if P.parse_time(self.before) is None else str(id_at(self.before, last=True))
            out = out & P.id_range(number, low, high)
        out = out & P.pinned(F.col("pinned"), self.pinned)
        if self.mentions:
            out = out & P.mentions(self.mentions)
        return out

    def order(self) -> list[Column]:
        way = F.desc if self.sort_order != "asc" else F.asc
        if self.sort_by == "relevance":
            return [term_score(F.col("content"), self.content or "").desc(), F.col("id").cast("long").desc()]
        return [way(F.col("id").cast("long"))]


def id_at(text: str, last: bool = False) -> int:
    """The first (or last) id of a time."""
    from parlance.sources.schema import EPOCH_MS

    ms = int(P.parse_time(text).timestamp() * 1000) - EPOCH_MS
    return max(0, ms << 22) + (((1 << 22) - 1) if last and ms >= 0 else 0)


def routed(options: SearchOptions, channels: DataFrame) -> SearchOptions:
    """PRD17: the guild of the options' channel where none is given; an error where neither is."""
    if options.guild_id or not options.channel_id:
        if not (options.guild_id or options.channel_id):
            raise ValueError("a search needs a channel or a guild")
        return options
    row = channels.where(F.col("id") == options.channel_id).select("guild_id").limit(1).collect()
    return replace(options, guild_id=row[0]["guild_id"] if row else None)


def found(messages: DataFrame, options: SearchOptions) -> DataFrame:
    return messages.where(options.column())


def shown(messages: DataFrame, options: SearchOptions, candidates: DataFrame | None = None) -> DataFrame:
    """What a search shows: matches in order (15 at most after the offset); where there is none, the newest matches (10
    at most, oldest first) among the 50 newest rows of the channel, by the local filter. Columns ``fallback`` and
    ``place`` tell which, and the order.

    The page is read at once, as it has 15 rows at most; only an empty one makes the fallback run. ``candidates`` are
    rows among which all matches are, such as those of an index; by default all messages are looked through."""
    matches = found(messages if candidates is None else candidates, options)
    page = matches.orderBy(*options.order()).offset(options.offset).limit(SHOWN_REMOTE)
    rows = page.collect()
    if rows:
        schema = T.StructType([*page.schema.fields, T.StructField("place", T.IntegerType()), T.StructField("fallback", T.BooleanType())])
        return messages.sparkSession.createDataFrame([(*r, i + 1, False) for i, r in enumerate(rows)], schema).orderBy("place")
    local = P.LocalFilter(options.content, options.has, options.author_id, options.during, options.after, options.before)
    timed = messages.where(F.col("channel_id") == options.channel_id) if options.channel_id else messages
    newest = recent(timed.withColumn("ts", F.try_to_timestamp("timestamp")), FALLBACK_ROWS)
    rest = newest.where(local.column()).orderBy(F.desc("ts"), F.desc("id")).limit(SHOWN_LOCAL)
    rest = rest.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("ts", "id"))).withColumn("fallback", F.lit(True))
    return rest.select(*page.columns, "place", "fallback").orderBy("place")
