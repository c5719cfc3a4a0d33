"""Streamed answers: line frames are decoded, deltas parsed, and fragments folded by key; in batch and as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from parlance.sources.schema import EOF_MARK

_DELTA = """
choices array<struct<
  delta: struct<content: string, tool_calls: array<struct<index: int, id: string, function: struct<name: string, arguments: string>>>>,
  message: struct<content: string, tool_calls: array<struct<index: int, id: string, function: struct<name: string, arguments: string>>>>, text: string>>
"""


def payloads(lines: DataFrame) -> DataFrame:
    """STR1: data frames of ``lines`` (stream_id, seq, line). A line without its line feed at the end is unfinished."""
    full = lines.where(F.col("line").endswith("\n"))
    text = F.trim(F.regexp_replace("line", r"[\r\n]+$", ""))
    kept = full.withColumn("line", text).where((F.col("line") != "") & ~F.col("line").startswith(":") & F.col("line").startswith("data: "))
    return kept.select("stream_id", "seq", F.expr("substring(line, 7)").alias("data")).where(F.trim("data") != EOF_MARK)


def deltas(frames: DataFrame) -> DataFrame:
    """STR2: content and tool-call fragments of each frame; frames that can't be read are dropped."""
    parsed = frames.withColumn("x", F.from_json("data", _DELTA, {"mode": "PERMISSIVE"})["choices"][0]).where("x is not null")
    content = F.coalesce("x.delta.content", "x.message.content", "x.text")
    return parsed.select("stream_id", "seq", content.alias("content"), F.coalesce("x.delta.tool_calls", "x.message.tool_calls").alias("calls"))


def fragments(parts: DataFrame) -> DataFrame:
    """One row a tool-call fragment: stream_id, idx (0 where it is left out), seq, pos (in its frame), call_id, name, args."""
    own = parts.select("stream_id", "seq", F.posexplode("calls").alias("pos", "c"))
    return own.select("stream_id", F.coalesce("c.index", F.lit(0)).alias("idx"), "seq", "pos", F.col("c.id").alias("call_id"), F.col("c.function.name").alias("name"), F.col("c.function.arguments").alias("args"))


def _appended(held: Column, name: Column) -> Column:
    return F.when(F.contains(held, name), held).otherwise(F.concat(held, name))


def folded(parts: DataFrame) -> DataFrame:
    """AGG6: the calls that fragments make up, by index: the last id (or call_<idx>), names appended unless contained,
    arguments joined, in the order of frames and of fragments in a frame (``pos``, if there is one).
    A call's fragments meet in one group; they are as many as one answer has."""
    row = F.struct("seq", (F.col("pos") if "pos" in parts.columns else F.lit(0)).alias("pos"), F.coalesce("call_id", F.lit("")).alias("call_id"), F.coalesce("name", F.lit("")).alias("name"), F.coalesce("args", F.lit("")).alias("args"))
    rows = parts.groupBy("stream_id", "idx").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    ids = F.filter(F.transform("rows", lambda r: r["call_id"]), lambda x: x != "")
    return rows.select(
        "stream_id",
        "idx",
        F.coalesce(F.try_element_at(ids, F.lit(-1)), F.concat(F.lit("call_"), "idx")).alias("call_id"),
        F.aggregate("rows", F.lit(""), lambda s, r: _appended(s, r["name"])).alias("name"),
        F.array_join(F.transform("rows", lambda r: r["args"]), "").alias("arguments"),
    )


def contents(parts: DataFrame) -> DataFrame:
    """AGG7: the text of each answer, in order."""
    row = F.struct("seq", F.col("content").alias("text"))
    rows = parts.where("content is not null").groupBy("stream_id").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    return rows.select("stream_id", F.array_join(F.transform("rows", lambda r: r["text"]), "").alias("content"))


_FOLDED = "stream_id string, idx int, call_id string, name string, arguments string"
_STATE = "seqs array<long>, places array<int>, ids array<string>, names array<string>, args array<string>"


def _fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Fragments so far, by seq and place in the frame; those that come again are the same."""
    rows = {(s, p): (i, n, a) for s, p, i, n, a in zip(*state.get, strict=True)} if state.exists else {}
    for frame in frames:
        for s, p, i, n, a in zip(frame["seq"], frame["pos"], frame["call_id"], frame["name"], frame["args"], strict=True):
            rows[int(s), int(p)] = tuple("" if x is None or x != x else str(x) for x in (i, n, a))
    order = sorted(rows)
    ids, names, args = ([rows[s][k] for s in order] for k in range(3))
    state.update(([s for s, _ in order], [p for _, p in order], ids, names, args))
    name = ""
    for part in names:
        if part not in name:
            name += part
    yield pd.DataFrame([(key[0], int(key[1]), next((x for x in reversed(ids) if x), f"call_{int(key[1])}"), name, "".join(args))], columns=["stream_id", "idx", "call_id", "name", "arguments"])


def folded_stream(parts: DataFrame) -> DataFrame:
    """STR3: the same as a stream in update mode: each batch gives the calls that it changed, as they are by then."""
    own = parts.select(F.col("stream_id").cast("string"), F.col("idx").cast("int"), F.col("seq").cast("long"), (F.col("pos") if "pos" in parts.columns else F.lit(0)).cast("int").alias("pos"), "call_id", "name", "args")
    return own.groupBy("stream_id", "idx").applyInPandasWithState(_fold, _FOLDED, _STATE, "update", GroupStateTimeout.NoTimeout)


def pushed(stream: DataFrame, each, name: str, checkpoint: str, every: str | None = None):
    """STR4, STR8: every batch of changes goes to ``each(rows, batch_id)``, once over what is there or again and again
    (``every``: an interval such as ``1 second``); STR5: stop() on the query cancels it."""
    when = {"processingTime": every} if every else {"availableNow": True}
    return stream.writeStream.outputMode("update").queryName(name).option("checkpointLocation", checkpoint).foreachBatch(each).trigger(**when).start()
