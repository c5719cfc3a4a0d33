"""Merging, newest rows, rows around a row, groups and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.sources.schema import LOG_ROWS, PAGE_CAP
from parlance.sources.shared import own_folder, written


def clamp(limit: int) -> int:
    """TOP8."""
    return min(limit, PAGE_CAP)


def asked_limit(value: object, default: int) -> int:
    """A limit out of a call's arguments: between 1 and the page cap; the default where it is missing, 0 or no number."""
    try:
        number = int(value or 0) or default
    except (TypeError, ValueError):
        number = default
    return max(1, clamp(number))


def merged(parts: list[DataFrame], key: str = "id", last: bool = True, order: str | None = None) -> DataFrame:
    """SET1, SET2, AGG2 to AGG4: one row a key over several sources; the last (or first) source that has it wins, and
    inside a source the row of the greatest (or least) ``order``, of equals the one of the greatest (least) hash.

    Rows are combined on the map side; the union isn't sorted as a whole.
    """
    out = None
    for i, part in enumerate(parts):
        out = _ranked(part, i) if out is None else out.unionByName(_ranked(part, i), allowMissingColumns=True)
    names = [c for c in out.columns if c != _SOURCE]
    value = F.col(key)
    usable = value.isNotNull() & (value.cast("string") != "")
    place = F.struct(F.col(_SOURCE), *([F.col(order)] if order else []), F.xxhash64(*names))
    best = (F.max_by if last else F.min_by)(F.struct(*names), place)
    return out.where(usable).groupBy(F.col(key).alias(_SOURCE)).agg(best.alias("row")).select("row.*")


#: A column of ours beside those of a table.
_SOURCE = "__parlance_source"


def _ranked(part: DataFrame, place: int) -> DataFrame:
    return part.withColumn(_SOURCE, F.lit(place))


def recent(messages: DataFrame, limit: int = 25, channel: str = "channel_id", order: tuple[str, ...] = ("ts", "id")) -> DataFrame:
    """WIN2: the newest rows of each channel. ``limit`` 0 means all, as a slice from minus zero does; a negative one
    leaves out as many of the oldest. Spark limits each partition before the exchange (WindowGroupLimit)."""
    newest = Window.partitionBy(channel).orderBy(*(F.desc(c) for c in order))
    if limit > 0:
        return messages.withColumn("_rank", F.row_number().over(newest)).where(F.col("_rank") <= limit).drop("_rank")
    if limit == 0:
        return messages
    oldest = Window.partitionBy(channel).orderBy(*order)
    return messages.withColumn("_rank", F.row_number().over(oldest)).where(F.col("_rank") > -limit).drop("_rank")


def running(rows: DataFrame, group: str, order: tuple[str, ...], sums: dict[str, Column]) -> DataFrame:
    """Adds columns with the sums over the rows before a row in its group, in order, without ever bringing a group into
    one task: rows are dealt to ranges of (group, order) and written, summed up inside their range, and moved on by the
    sums of the group's ranges before. Only rows that are equal in the group and all of ``order`` have to share a range."""
    spark = rows.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = rows.withColumns({name: value.cast("long") for name, value in sums.items()})
    cut = cut.repartitionByRange(width, F.col(group), *(F.col(c) for c in order)).withColumn(_RANGE, F.spark_partition_id())
    cut = written(cut, own_folder(spark, "ranges"))
    whole = cut.groupBy(F.col(group).alias("_group"), F.col(_RANGE).alias("_range")).agg(*(F.sum(name).alias(f"_of_{name}") for name in sums))
    # one row for each range that a group reaches
    earlier = Window.partitionBy("_group").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.select("_group", "_range", *(F.coalesce(F.sum(f"_of_{name}").over(earlier), F.lit(0)).alias(f"_before_{name}") for name in sums))
    inside = Window.partitionBy(_RANGE, group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = cut.withColumns({name: F.coalesce(F.sum(name).over(inside), F.lit(0)) for name in sums})
    out = local.join(whole, (F.col(_RANGE) == F.col("_range")) & F.col(group).eqNullSafe(F.col("_group")))
    out = out.withColumns({name: F.col(name) + F.col(f"_before_{name}") for name in sums})
    return out.drop(_RANGE, "_group", "_range", *(f"_before_{name}" for name in sums))


def numbered(rows: DataFrame, group: str, order: tuple[str, ...], place: str = "place") -> DataFrame:
    """Numbers the rows of each group in order, from 1."""
    return running(rows, group, order, {place: F.lit(1)}).withColumn(place, F.col(place) + 1)


#: The range of a row, beside a table's own columns.
_RANGE = "__parlance_range"


def around(messages: DataFrame, targets: DataFrame, limit: int | str = 10, channel: str = "channel_id", key: str = "id", order: tuple[str, ...] = ("ts", "id")) -> DataFrame:
    """WIN1: up to ``limit`` (50 at most) rows around each target (channel, id): half of them before it, rounded down,
    then the target, then the rest. Absent targets give no rows. Column ``target`` names the target. ``limit`` may name a
    column of the targets, and each of them is then asked for once with each limit."""
    own = limit if isinstance(limit, str) else None
    many = F.least(F.col(own).cast("int"), F.lit(PAGE_CAP)) if own else F.lit(clamp(limit))
    wanted = targets.select(F.col(channel).alias("_channel"), F.col(key).alias("target"), many.alias("_many"), *([F.col(own)] if own else [])).distinct().where("_many > 0")
    # only channels with a target are numbered
    some = messages.join(wanted.select(F.col("_channel").alias(channel)).distinct(), channel, "left_semi")
    rows = numbered(some, channel, order, "_place")
    found = rows.select(F.col(channel).alias("_c"), F.col(key).alias("_k"), F.col("_place").alias("_at")).join(wanted, (F.col("_c") == F.col("_channel")) & (F.col("_k") == F.col("target")))
    # each target asks for at most PAGE_CAP numbers by an equi-join
    before = F.floor(F.col("_many") / 2)
    near = found.select("_channel", "target", *([own] if own else []), F.explode(F.sequence(F.col("_at") - before, F.col("_at") - before + F.col("_many") - 1)).alias("_asked"))
    return rows.join(near, (F.col(channel) == F.col("_channel")) & (F.col("_place") == F.col("_asked"))).drop("_channel", "_place", "_asked")


def hits(grouped: DataFrame, group: str = "group_id", place: str = "pos") -> DataFrame:
    """PRJ8: of each group the first hit, or else its first row."""
    best = Window.partitionBy(group).orderBy(F.coalesce("hit", F.lit(False)).desc(), place)
    return grouped.withColumn("_rank", F.row_number().over(best)).where("_rank = 1").drop("_rank")


def as_groups(items: DataFrame, column: str = "messages") -> DataFrame:
    """PRJ7: bare items as groups of one; the total is the reported one, or else the number of groups, counted by a
    scalar subquery, so the rows never meet."""
    reported = F.col("total_results") if "total_results" in items.columns else F.lit(None).cast("long")
    total = items.agg(F.count("*").alias("total")).scalar()
    return items.withColumn("group", F.array(column)).withColumn("total", F.coalesce(reported, total))


def counted(rows: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """AGG1: a top-k with the number of all matches beside it. Counted by a scalar subquery, so the rows never meet."""
    total = rows.agg(F.count("*").alias("total")).scalar()
    return rows.orderBy(*order).limit(limit).withColumn("total", total)


def paged(rows: DataFrame, order: list[Column], offset: int = 0, size: int = 25) -> DataFrame:
    """TOP4."""
    return rows.orderBy(*order).offset(offset).limit(size)


def newest_ascending(rows: DataFrame, limit: int, order: tuple[str, ...] = ("ts", "id")) -> DataFrame:
    """TOP6: the newest rows, oldest first."""
    return rows.orderBy(*(F.desc(c) for c in order)).limit(limit).orderBy(*order)


def history(turns: DataFrame, session: str = "session_id", order: str = "pos", limit: int = 6) -> DataFrame:
    """TOP7: the last turns of each session; only then are other roles left out."""
    last = F.row_number().over(Window.partitionBy(session).orderBy(F.desc(order)))
    return turns.withColumn("_rank", last).where(F.col("_rank") <= limit).where(F.col("role").isin("user", "assistant")).drop("_rank")


def newest_logs(log: DataFrame, limit: int = LOG_ROWS) -> DataFrame:
    """SNK6, TOP9."""
    return log.orderBy(F.desc("time"), F.desc("seq")).limit(limit)


def term_score(text: Column, query: str) -> Column:
    """A stand-in for the unknown relevance order: how often the query stands in the text."""
    low, q = F.lower(F.coalesce(text, F.lit(""))), query.strip().lower()
    return ((F.length(low) - F.length(F.replace(low, F.lit(q), F.lit("")))) / max(len(q), 1)).cast("long") if q else F.lit(0).cast("long")
