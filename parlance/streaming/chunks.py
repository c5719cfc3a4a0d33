"""Streamed answers as bytes: chunks cut anywhere, in lines and characters too, joined again in batch and as a stream.

A chunk is a run of an answer's bytes: stream_id, start (the number of bytes before it), data. However a stream is cut,
the same lines come out: a line counts once its line feed is there, what follows the last one is unfinished. Bytes that
are no UTF-8 become U+FFFD. A chunk that comes again changes nothing; what stands after a gap waits for it (as a stream)
or doesn't count (in batch).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from parlance.operators.retrieve import running
from parlance.sources.schema import EOF_MARK

CHUNK = "stream_id string, start long, data binary"
#: Bytes as characters, one for one.
_BYTES = "ISO-8859-1"


def lines(chunks: DataFrame) -> DataFrame:
    """STR1 in batch: stream_id, seq (the number of the line), line with its line feed. Lines inside one chunk stay where
    they are; only the first and last piece of each chunk move, to the others of their line. Places come from running
    sums over ranges of chunks, so a stream of most chunks spreads over tasks."""
    length = F.octet_length(F.col("data"))
    own = chunks.where("data is not null and stream_id is not null").groupBy("stream_id", "start").agg(F.max_by("data", length).alias("data"))
    text = F.decode("data", _BYTES)
    own = running(own, "stream_id", ("start",), {"upto": length, "line": length - F.octet_length(F.encode(F.replace(text, F.lit("\n"), F.lit("")), _BYTES))})
    pieces = own.where("start = upto").select("stream_id", "start", "line", F.split(text, "\n", -1).alias("pieces"))
    rows = pieces.select("stream_id", "start", "line", (F.size("pieces") - 1).alias("last"), F.posexplode("pieces").alias("pos", "piece"))
    rows = rows.withColumn("line", F.col("line") + F.col("pos"))
    inner = (F.col("pos") > 0) & (F.col("pos") < F.col("last"))
    ended = F.col("pos") < F.col("last")
    whole = rows.where(inner).select("stream_id", F.col("line").alias("seq"), "piece")
    # at each chunk's ends: a line's pieces in order, of which one has a line feed after it
    parts = rows.where(~inner).groupBy("stream_id", "line").agg(F.sort_array(F.collect_list(F.struct("start", "piece"))).alias("x"), F.bool_or(ended).alias("ended"))
    joined = parts.where("ended").select("stream_id", F.col("line").alias("seq"), F.array_join(F.col("x.piece"), "").alias("piece"))
    return whole.unionByName(joined).select("stream_id", "seq", F.concat(utf8(F.encode("piece", _BYTES)), F.lit("\n")).alias("line"))


def utf8(data: Column) -> Column:
    return F.make_valid_utf8(data.cast("string"))


#: What the stream gives: the text so far (idx null), or a tool call so far; ``done`` with the end mark.
ANSWER = "stream_id string, idx int, call_id string, name string, text string, done boolean"


class Answer(StatefulProcessor):
    """STR3: joins a stream's chunks and folds its frames as they come. State is what the next chunk needs: the bytes
    after the last line feed, the text and calls so far, and chunks after a gap. The end mark, or ``ttl_ms`` without a
    chunk, leaves no state. A chunk costs its own bytes, and the call that it changes."""

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", "upto long, rest binary, timer long")
        self.text = handle.getListState("text", "part string")
        self.calls = handle.getMapState("calls", "idx int", "call_id string, name string")
        self.arguments = handle.getMapState("arguments", "idx int, n int", "part string")
        self.sizes = handle.getMapState("sizes", "idx int", "n int")
        self.waiting = handle.getMapState("waiting", "start long", "data binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        upto, rest, timer = self.place.get() if self.place.exists() else (0, b"", 0)
        rest = bytes(rest)
        came: dict[int, bytes] = {}
        for frame in rows:
            for start, data in zip(frame["start"], frame["data"], strict=True):
                if data is not None and start == start and int(start) + len(data) > upto and len(data) > len(came.get(int(start), b"")):
                    came[int(start)] = bytes(data)
        new = []
        if any(start <= upto for start in came):
            came = {start: bytes(data[0]) for (start,), data in self.waiting.iterator()} | came
            self.waiting.clear()
        while ready := [s for s in came if s <= upto]:
            start = min(ready)
            data = came.pop(start)[upto - start :]
            upto += len(data)
            new.append(data)
        for start, data in came.items():
            self.waiting.updateValue((start,), (data,))
        *full, rest = (rest + b"".join(new)).split(b"\n")
        said, changed, done = self._fold(full)
        out = self._changes(key[0], said, changed, done)
        if timer:
            self.handle.deleteTimer(timer)
        if done:
            self._forget()
        else:
            timer = timerValues.getCurrentProcessingTimeInMs() + self.ttl_ms if self.ttl_ms else 0
            self.place.update((upto, rest, timer))
            if timer:
                self.handle.registerTimer(timer)
        if out:
            yield pd.DataFrame(out, columns=["stream_id", "idx", "call_id", "name", "text", "done"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._forget()
        yield from ()

    def close(self) -> None:
        pass

    def _forget(self) -> None:
        for state in (self.place, self.text, self.calls, self.arguments, self.sizes, self.waiting):
            state.clear()

    def _fold(self, full: list[bytes]) -> tuple[list[str], set[int], bool]:
        """What new lines add: parts of the text, which calls changed, and whether the end mark came."""
        said: list[str] = []
        changed: set[int] = set()
        for line in full:
            delta = frame_of(line.decode("utf-8", "replace"))
            if delta == EOF_MARK:
                return said, changed, True
            if not isinstance(delta, dict):
                continue
            content = next((x for x in ((delta.get("delta") or {}).get("content"), (delta.get("message") or {}).get("content"), delta.get("text")) if x is not None), None)
            if content:
                said.append(str(content))
                self.text.appendValue((str(content),))
            calls = next((x for x in ((delta.get("delta") or {}).get("tool_calls"), (delta.get("message") or {}).get("tool_calls")) if x is not None), [])
            for call in calls if isinstance(calls, list) else []:
                if isinstance(call, dict):
                    changed.add(self._call(call))
        return said, changed, False

    def _call(self, call: dict) -> int:
        idx = int(call.get("index") or 0)
        function = call.get("function") or {}
        own, name = self.calls.getValue((idx,)) if self.calls.containsKey((idx,)) else ("", "")
        part = function.get("name") or ""
        self.calls.updateValue((idx,), (str(call.get("id") or own), name if part in name else name + part))
        if arguments := function.get("arguments"):
            n = self.sizes.getValue((idx,))[0] if self.sizes.containsKey((idx,)) else 0
            self.arguments.updateValue((idx, n), (str(arguments),))
            self.sizes.updateValue((idx,), (n + 1,))
        return idx

    def _changes(self, stream: str, said: list[str], changed: set[int], done: bool) -> list[tuple]:
        out = []
        if said or done:
            out.append((stream, None, None, None, "".join(x[0] for x in self.text.get()), done))
        every = sorted(i for (i,) in self.calls.keys()) if done else sorted(changed)
        for idx in every:
            own, name = self.calls.getValue((idx,))
            n = self.sizes.getValue((idx,))[0] if self.sizes.containsKey((idx,)) else 0
            out.append((stream, idx, own or f"call_{idx}", name, "".join(self.arguments.getValue((idx, i))[0] for i in range(n)), done))
        return out


def frame_of(line: str) -> dict | str | None:
    """The first choice of a line's frame, the end mark, or None for lines that hold neither."""
    line = line.strip()
    if not line.startswith("data: "):
        return None
    data = line[6:].strip()
    if data == EOF_MARK:
        return EOF_MARK
    try:
        choices = json.loads(data).get("choices")
        return choices[0] if isinstance(choices, list) and choices and isinstance(choices[0], dict) else None
    except (ValueError, AttributeError):
        return None


def answers(chunks: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """STR1 to STR3 as a stream in update mode: each batch gives the texts and calls that it changed, as they are by
    then. With ``ttl_ms`` a stream without chunks for so long is forgotten; that needs a repeating trigger, as Spark goes
    on with empty batches for the sake of timers. Needs the RocksDB state store."""
    own = chunks.where("stream_id is not null").select(F.col("stream_id").cast("string"), F.col("start").cast("long"), F.col("data").cast("binary"))
    return own.groupBy("stream_id").transformWithStateInPandas(Answer(ttl_ms), ANSWER, "Update", "ProcessingTime" if ttl_ms else "None")


class _Range(InputPartition):
    def __init__(self, name: str, start: int, end: int):
        super().__init__(None)
        self.name, self.start, self.end = name, start, end


class CaptureReader(DataSourceStreamReader):
    """Offsets are the bytes of each file that have been read; a batch reads what has come since, in ranges."""

    def __init__(self, path: str, most: int):
        self.path, self.most = path, most

    def _open(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        from pyarrow import fs

        system, folder = self._open()
        files = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        return {f.base_name: f.size for f in sorted(files, key=lambda f: f.base_name) if f.is_file and f.base_name.endswith(".sse")}

    def partitions(self, start: dict, end: dict) -> list[_Range]:
        return [_Range(name, a, min(a + self.most, upto)) for name, upto in end.items() for a in range(start.get(name, 0), upto, self.most)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        system, folder = self._open()
        with system.open_input_file(f"{folder}/{partition.name}") as file:
            file.seek(partition.start)
            yield partition.name.removesuffix(".sse"), partition.start, file.read(partition.end - partition.start)

    def commit(self, end: dict) -> None:
        pass


class Captures(DataSource):
    """SRC12: a folder of answers that are still being written, ``<stream_id>.sse`` each, as a stream of chunks.
    Options: ``path``, ``bytes`` (of a chunk at most). Register it with ``spark.dataSource.register(Captures)``."""

    @classmethod
    def name(cls) -> str:
        return "captures"

    def schema(self) -> str:
        return CHUNK

    def streamReader(self, schema) -> CaptureReader:
        return CaptureReader(self.options["path"].rstrip("/"), int(self.options.get("bytes", 1 << 20)))
