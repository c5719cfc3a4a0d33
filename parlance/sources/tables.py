"""Scans: Parquet tables, point lookups, and the driver's tables seen as messages, channels and users."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.functions.values import or_else


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lookup(dimension: DataFrame, key: str, value: str | int | None) -> DataFrame:
    """The row of one id; no row for a null or unknown id."""
    return dimension.where(F.lit(False)) if value is None else dimension.where(F.col(key) == value)


def flatten_buckets(buckets: DataFrame, column: str = "buckets") -> DataFrame:
    """Channels out of a map of arrays of {channel: struct}; entries without an id are skipped."""
    entries = F.flatten(F.map_values(F.col(column)))
    return buckets.select(F.explode(entries).alias("entry")).select("entry.channel.*").where("id is not null")


def data_url(files: DataFrame, kind: Column | None = None) -> DataFrame:
    """Rows of a binaryFile scan (path, content) as base64 data URLs."""
    kind = F.lit("image/png") if kind is None else kind
    encoded = F.regexp_replace(F.base64("content"), r"\s", "")
    return files.select("path", F.concat(F.lit("data:"), kind, F.lit(";base64,"), encoded).alias("data_url"))


@dataclass
class Settings:
    """Engine settings, from layers of key/value maps: later layers win, except where their value is null."""

    values: dict[str, object] = field(default_factory=dict)

    @classmethod
    def layered(cls, *layers: dict[str, object]) -> Settings:
        out: dict[str, object] = {}
        for layer in layers:
            out.update({k: v for k, v in layer.items() if v is not None})
        return cls(out)


def layered_settings(layers: list[DataFrame]) -> DataFrame:
    """key, value of several (key, value) tables; the last one that has a value wins."""
    out = None
    for i, layer in enumerate(layers):
        part = layer.where("value is not null").select("key", "value", F.lit(i).alias("layer"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("key").agg(F.max_by("value", "layer").alias("value"))


def save_settings(settings: DataFrame, path: str) -> None:
    """A layer of settings (key, value), replaced as a whole."""
    settings.select("key", "value").coalesce(1).write.mode("overwrite").parquet(path)


def conversation_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as messages: conversation is the channel, role the author; ids and times follow the turns."""
    own = read(spark, sf_dir, "conversations")
    number = F.col("conv_id") * 1000 + F.col("turn")
    return own.select(
        number.alias("id"),
        F.col("conv_id").alias("channel_id"),
        F.col("turn"),
        F.col("role").alias("author_id"),
        or_else(F.col("role"), "Unknown").alias("author_name"),
        F.col("text").alias("content"),
    )


def event_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as messages: the type is the channel, the user the author."""
    own = read(spark, sf_dir, "events")
    return own.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value", "props")
