"""The session store: append, newest version, tombstones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parlance.sources.schema import SESSION


def new_session(spark: SparkSession, session_id: str, channel_id: str, now_ms: int, title: str = "New chat") -> DataFrame:
    """SNK4: one empty session; id and clock are arguments."""
    return spark.createDataFrame([(session_id, channel_id, title, [], now_ms, now_ms, False)], SESSION)


def stamped(sessions: DataFrame, now_ms: Column | int) -> DataFrame:
    """SNK1: a version to append, with its time."""
    return sessions.withColumn("updatedAt", (now_ms if isinstance(now_ms, Column) else F.lit(now_ms)).cast("long"))


def append(sessions: DataFrame, path: str) -> None:
    """SNK1, SNK3: versions are only ever appended; the newest one counts."""
    sessions.write.mode("append").parquet(path)


def tombstones(ids: DataFrame, now_ms: int) -> DataFrame:
    """SNK2: versions that delete sessions; deleting twice changes nothing."""
    spark = ids.sparkSession
    empty = spark.createDataFrame([], SESSION)
    return empty.unionByName(ids.select("id", F.lit(now_ms).cast("long").alias("updatedAt"), F.lit(True).alias("deleted")), allowMissingColumns=True)


def current(versions: DataFrame, key: str = "id") -> DataFrame:
    """The newest version of each session, without deleted ones. A delete wins over a save of the same time."""
    newest = Window.partitionBy(key).orderBy(F.desc("updatedAt"), F.coalesce("deleted", F.lit(False)).desc())
    return versions.withColumn("_rank", F.row_number().over(newest)).where("_rank = 1").drop("_rank").where(~F.coalesce("deleted", F.lit(False)))


def for_channel(versions: DataFrame, channel_id: str) -> DataFrame:
    """SRC10, TOP2: a channel's sessions, newest first. The channel filter is applied to versions first, so the scan
    reads few rows; a session never changes its channel."""
    gone = F.coalesce("deleted", F.lit(False))
    own = versions.where((F.col("channelId") == channel_id) | (F.col("channelId").isNull() & gone))
    return current(own).where(F.col("channelId") == channel_id).orderBy(F.desc("updatedAt"), "id")


def steps_replaced(steps: DataFrame, updates: DataFrame) -> DataFrame:
    """JOIN8: steps with the fields of their updates, by id."""
    changed = updates.select("id", *(F.col(c).alias(f"_{c}") for c in updates.columns if c != "id"))
    out = steps.join(changed, "id", "left")
    return out.select(*(F.coalesce(f"_{c}", c).alias(c) if f"_{c}" in out.columns else F.col(c) for c in steps.columns))


def calls_with_results(calls: DataFrame, results: DataFrame) -> DataFrame:
    """JOIN7: tool calls and their results, by call id."""
    return calls.join(results.withColumnRenamed("tool_call_id", "id"), "id", "left")


def prepended(items: DataFrame, item: DataFrame, key: str = "id") -> DataFrame:
    """SET3: an item before the others, without an older one of the same key."""
    return item.withColumn("_part", F.lit(0)).unionByName(items.join(item.select(key), key, "left_anti").withColumn("_part", F.lit(1)), allowMissingColumns=True)


class SessionStore:
    """SNK1 to SNK3 and SRC10 with a secondary index: a log of versions, and a snapshot of the newest ones as a table
    bucketed and sorted by channel, so that a channel's sessions are one bucket of it and what the log has since.

    ``save`` and ``delete`` append to the log of the present epoch. ``compact`` writes the next epoch's snapshot out of
    the last one and the logs of the last two epochs, then commits it with one row; a failed one leaves the store as it
    was. Reads take the logs of the last two epochs too, so a writer that was still at the epoch before loses nothing.
    """

    def __init__(self, spark: SparkSession, path: str, name: str, buckets: int = 64):
        self.spark, self.path, self.name, self.buckets = spark, path.rstrip("/"), name, buckets

    def _there(self, folder: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def epoch(self) -> int:
        if not self._there("epochs"):
            return 0
        return self.spark.read.schema("epoch int").parquet(f"{self.path}/epochs").agg(F.max("epoch")).collect()[0][0]

    def save(self, sessions: DataFrame, now_ms: Column | int) -> None:
        append(stamped(sessions, now_ms), f"{self.path}/log/epoch={self.epoch()}")

    def delete(self, ids: DataFrame, now_ms: int) -> None:
        append(tombstones(ids, now_ms), f"{self.path}/log/epoch={self.epoch()}")

    def snapshot(self) -> DataFrame | None:
        """The newest snapshot; a session whose catalog doesn't have it yet is told where it lies."""
        epoch = self.epoch()
        if not epoch:
            return None
        name, path = f"{self.name}_{epoch}", f"{self.path}/snapshots/{epoch}"
        if not self.spark.catalog.tableExists(name):
            fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.spark.read.parquet(path).schema)
            self.spark.sql(f"CREATE TABLE {name} ({fields}) USING parquet CLUSTERED BY (channelId) SORTED BY (channelId, updatedAt) INTO {self.buckets} BUCKETS LOCATION '{path}'")
        return self.spark.table(name)

    def log(self) -> DataFrame:
        """Versions since the last snapshot but one."""
        epoch = self.epoch()
        paths = [f"log/epoch={e}" for e in (epoch - 1, epoch) if e >= 0 and self._there(f"log/epoch={e}")]
        if not paths:
            return self.spark.createDataFrame([], SESSION)
        return self.spark.read.schema(SESSION).parquet(*(f"{self.path}/{p}" for p in paths))

    def versions(self) -> DataFrame:
        held = self.snapshot()
        return self.log() if held is None else held.unionByName(self.log())

    def for_channel(self, channel_id: str) -> DataFrame:
        """A channel's sessions, newest first: one bucket of the snapshot, and the log."""
        held = self.snapshot()
        own = self.log() if held is None else held.where(F.col("channelId") == channel_id).unionByName(self.log())
        return for_channel(own, channel_id)

    def compact(self) -> int:
        """The next epoch, whose snapshot has all that was saved and not deleted."""
        number = self.epoch() + 1
        rows = current(self.versions())
        rows.repartition(self.buckets, "channelId").write.mode("overwrite").bucketBy(self.buckets, "channelId").sortBy("channelId", "updatedAt").format("parquet").option("path", f"{self.path}/snapshots/{number}").saveAsTable(f"{self.name}_{number}")
        self.spark.range(1).select(F.lit(number).alias("epoch")).coalesce(1).write.mode("append").parquet(f"{self.path}/epochs")
        return number
