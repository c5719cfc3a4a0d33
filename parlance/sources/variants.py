"""Store snapshots whose shape isn't known beforehand, as VARIANT columns: arrays, maps, maps of arrays, wrapped rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.sources.schema import GROUP_DM


def parsed(rows: DataFrame, column: str) -> DataFrame:
    """A column of JSON text as VARIANT; null where it can't be read."""
    return rows.withColumn(column, F.try_parse_json(column))


def is_array(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith("ARRAY"), F.lit(False))


def is_object(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))


def _field(value: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(value, path, kind)


def _present(value: Column) -> Column:
    """The value, or null for JSON's null."""
    return F.when(value.isNotNull() & ~F.is_variant_null(value), value)


def _elements(rows: DataFrame, raw: str, place: str) -> DataFrame:
    """A row for each element of an array or value of an object, in order; none for other values."""
    every = rows.sparkSession.tvf.variant_explode(F.col(raw).outer())
    return rows.lateralJoin(every).withColumnsRenamed({"pos": place, "value": "item"}).drop("key", raw)


def entries(rows: DataFrame, raw: str) -> DataFrame:
    """SRC9: the elements of an array or the values of an object, where those that are arrays themselves are taken apart
    once more. Column ``item`` has the element, ``place`` the order; ``raw`` goes."""
    first = _elements(rows, raw, "_a")
    single = first.where(~is_array(F.col("item"))).withColumn("_b", F.lit(0))
    nested = _elements(first.where(is_array(F.col("item"))).withColumnRenamed("item", "_nested"), "_nested", "_b")
    both = single.unionByName(nested.select(*single.columns))
    return both.withColumn("place", F.struct(F.col("_a").alias("a"), F.col("_b").alias("b"))).drop("_a", "_b")


def channels_of(rows: DataFrame, raw: str) -> DataFrame:
    """SRC8, SRC9: channels (id, type, name, topic, guild_id, recipients, ownerId, permissions) out of snapshots of any
    shape; an entry may wrap its channel in ``channel``. Entries without an id are skipped."""
    own = entries(rows, raw).withColumn("item", F.coalesce(_present(_field(F.col("item"), "$.channel", "variant")), F.col("item")))
    text = lambda name: _field(F.col("item"), f"$.{name}", "string").alias(name)
    kept = [c for c in own.columns if c not in ("item", "place")]
    number = lambda name, kind: _field(F.col("item"), f"$.{name}", kind).alias(name)
    falsy = F.col("id").isNull() | (F.col("id") == "") | (F.col("id").isin("0", "false") & ~F.schema_of_variant(_field(F.col("item"), "$.id", "variant")).startswith("STRING"))
    own = own.withColumn("id", text("id")).withColumn("told", ~falsy)
    out = own.select(*kept, "place", "told", "id", number("type", "int"), text("name"), text("topic"), text("guild_id"), _field(F.col("item"), "$.recipients", "array<string>").alias("recipients"), text("ownerId"), number("permissions", "bigint"))
    # a number 0 or false is no id, a text "0" is one
    return out.where("told").drop("told")


def private_channels(rows: DataFrame, mutable: str = "mutable", private: str = "private", every: str = "all") -> DataFrame:
    """SRC8: of three snapshots in a row the first that is there: a map of private channels, another one, or an array of
    all channels, of which only groups count."""
    own = rows.withColumn("_raw", F.coalesce(_present(F.col(mutable)), _present(F.col(private)), F.when(is_array(F.col(every)), F.col(every))))
    own = own.withColumn("_groups", _present(F.col(mutable)).isNull() & _present(F.col(private)).isNull()).drop(mutable, private, every)
    out = channels_of(own, "_raw")
    return out.where(~F.col("_groups") | (F.col("type") == GROUP_DM)).drop("_groups")


def messages_of(rows: DataFrame, raw: str, schema: str) -> DataFrame:
    """SRC4: cached messages out of snapshots: the first that fits of an array under ``_array``, an array, and the values
    of a map. ``schema``: the fields of a message, as the items of a struct."""
    wrapped = _field(F.col(raw), "$._array", "variant")
    own = _elements(rows.withColumn(raw, F.when(is_array(wrapped), wrapped).otherwise(F.col(raw))), raw, "place").where(is_object(F.col("item")))
    kept = [c for c in own.columns if c not in ("item", "place")]
    return own.select(*kept, "place", F.from_json(F.to_json("item"), schema).alias("message")).select(*kept, "place", "message.*")
