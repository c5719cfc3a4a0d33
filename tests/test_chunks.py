"""Streamed answers cut anywhere: the same lines, frames and folds in batch and as a stream."""

from __future__ import annotations

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from parlance.streaming import chunks as C, fold

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def frame(**delta):
    return "data: " + json.dumps({"choices": [{"delta": delta}]}, ensure_ascii=False) + "\n"


def call(index, call_id=None, name=None, arguments=None):
    return {"index": index, "id": call_id, "function": {"name": name, "arguments": arguments}}


ANSWER = (
    frame(content="Grüß")
    + ": comment\n\n"
    + frame(content=" 日本\U0001f600\n")
    + "data: {broken\n"
    + frame(tool_calls=[call(0, "c0", "sea"), call(1, None, "fetch", "{")])
    + "data: " + json.dumps({"choices": [{"text": "t"}]}) + "\r\n"
    + frame(tool_calls=[call(0, None, "rch", '{"q":'), call(1, "", "fetch", "}")])
    + "event: x\n"
    + frame(tool_calls=[call(0, None, None, '"é"}')])
    + frame(content="!")
)
TEXT, CALLS = "Grüß 日本\U0001f600\nt!", {0: ("c0", "search", '{"q":"é"}'), 1: ("call_1", "fetch", "{}")}


def cut(stream, data, rng, most):
    out, at = [], 0
    while at < len(data):
        n = rng.randrange(1, most + 1)
        out.append((stream, at, bytearray(data[at : at + n])))
        at += n
    return out


@pytest.mark.parametrize("most", [1, 5, 60, 5000])
def test_lines_of_any_cut(spark, most):
    rng = random.Random(most)
    data = (ANSWER + "data: unfinished").encode()
    rows = cut("a", data, rng, most) + cut("b", b"\n\nx\n", rng, 2) + cut("c", b"no end", rng, 3) + cut("d", b"\xff\xfe ok\n\xe6\x97\n", rng, 2)
    rows += rng.sample(rows, 3) + [("e", 0, bytearray(b"one\n")), ("e", 9, bytearray(b"after a gap\n")), ("f", 0, None), (None, 0, bytearray(b"x\n"))]
    rng.shuffle(rows)
    got = C.lines(spark.createDataFrame(rows, C.CHUNK)).collect()
    own = {s: [r["line"] for r in sorted(got, key=lambda r: r["seq"]) if r["stream_id"] == s] for s in "abcdef"}
    assert own == {"a": [x + "\n" for x in ANSWER.split("\n")[:-1]], "b": ["\n", "\n", "x\n"], "c": [], "d": ["�� ok\n", "�\n"], "e": ["one\n"], "f": []}
    assert [r["seq"] for r in sorted(got, key=lambda r: r["seq"]) if r["stream_id"] == "a"] == list(range(len(own["a"])))
    parts = fold.deltas(fold.payloads(C.lines(spark.createDataFrame(rows, C.CHUNK)).where("stream_id = 'a'")))
    assert fold.contents(parts).collect()[0]["content"] == TEXT
    assert {r["idx"]: (r["call_id"], r["name"], r["arguments"]) for r in fold.folded(fold.fragments(parts)).collect()} == CALLS


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def run(stream, name, checkpoint):
    """The last row of each text and call, and the state rows at the end."""
    seen, order = {}, []

    def each(df, _):
        for r in df.collect():
            seen[r["stream_id"], r["idx"]] = (r["call_id"], r["name"], r["text"], r["done"])
            order.append((r["stream_id"], r["idx"]))

    query = fold.pushed(stream, each, name, checkpoint)
    query.awaitTermination()
    return seen, query.lastProgress["stateOperators"][0]["numRowsTotal"], len(order)


def test_stream_of_chunks_equals_batch(spark, rocks, tmp_path):
    rng = random.Random(4)
    data = ANSWER.encode()
    rows = cut("a", data, rng, 40) + cut("open", data, rng, 90)
    rows += cut("ended", data + b"data: [DONE]\n", rng, 70)
    rng.shuffle(rows)
    rows += rows[:4]
    source = str(tmp_path / "in")
    for i in range(0, len(rows), 9):
        spark.createDataFrame(rows[i : i + 9], C.CHUNK).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(C.CHUNK).option("maxFilesPerTrigger", 2).parquet(source)
    seen, left, _ = run(C.answers(stream), "chunks", str(tmp_path / "state"))
    for s in ("a", "open", "ended"):
        assert seen[s, None][2:] == (TEXT, s == "ended")
        assert {i: seen[s, i][:3] for i in (0, 1)} == CALLS
    assert left > 0
    # streams that end leave nothing
    marks = [(s, len(data), bytearray(b"data: [DONE]\n")) for s in ("a", "open")]
    spark.createDataFrame(marks, C.CHUNK).coalesce(1).write.mode("append").parquet(source)
    seen, left, n = run(C.answers(stream), "chunks-on", str(tmp_path / "state"))
    assert left == 0 and n == 6 and all(x[3] for x in seen.values()) and seen["a", None][2] == TEXT


def test_a_silent_stream_is_forgotten(spark, rocks, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([("a", 0, bytearray(frame(content="x").encode())), ("b", 5, bytearray(b"after a gap"))], C.CHUNK).coalesce(1).write.parquet(source)
    seen = []
    query = fold.pushed(C.answers(spark.readStream.schema(C.CHUNK).parquet(source), ttl_ms=1500), lambda df, _: seen.extend(df.collect()), "silent", str(tmp_path / "state"), every="300 milliseconds")
    try:
        left = []
        for _ in range(150):
            time.sleep(0.2)
            if query.lastProgress and query.lastProgress["stateOperators"]:
                left.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
            if left and max(left) > 0 and left[-1] == 0:
                break
    finally:
        query.stop()
    assert [r["text"] for r in seen] == ["x"] and max(left) > 0 and left[-1] == 0


def test_captures_are_read_by_offsets(spark, rocks, tmp_path):
    spark.dataSource.register(C.Captures)
    folder = tmp_path / "captures"
    folder.mkdir()
    data = (ANSWER + "data: [DONE]\n").encode()
    (folder / "one.sse").write_bytes(data[:77])
    (folder / "two.sse").write_bytes(data)
    (folder / "note.txt").write_bytes(b"data: x\n")
    reader = C.CaptureReader(str(folder), 50)
    first = reader.latestOffset()
    assert first == {"one.sse": 77, "two.sse": len(data)} and reader.initialOffset() == {}
    assert [(p.name, p.start, p.end) for p in reader.partitions({"two.sse": len(data) - 60}, first)][:3] == [("one.sse", 0, 50), ("one.sse", 50, 77), ("two.sse", len(data) - 60, len(data) - 10)]
    stream = lambda: C.answers(spark.readStream.format("captures").option("path", str(folder)).option("bytes", "33").load())
    seen, left, _ = run(stream(), "captures", str(tmp_path / "state"))
    assert seen["two", None][2:] == (TEXT, True) and not seen.get(("one", None), (0, 0, 0, False))[3]
    with (folder / "one.sse").open("ab") as file:
        file.write(data[77:])
    seen, left, _ = run(stream(), "captures-on", str(tmp_path / "state"))
    assert seen["one", None][2:] == (TEXT, True) and {i: seen["one", i][:3] for i in (0, 1)} == CALLS and ("two", None) not in seen and left == 0


def test_an_empty_table_of_chunks(spark):
    assert C.lines(spark.createDataFrame([], C.CHUNK)).collect() == []
    assert C.frame_of("data: [DONE]") == "[DONE]" and C.frame_of("data: 5") is None and C.frame_of('data: {"choices": []}') is None and C.frame_of("x") is None
    assert spark.range(1).select(C.utf8(F.lit(b"a\xc3")).alias("x")).first()["x"] == "a�"
