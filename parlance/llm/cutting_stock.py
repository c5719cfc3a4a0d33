"""Packing documents into sequences as a cutting-stock problem, solved by column generation.

A document's ids (with the end id) are cut into pieces of ``SEQUENCE`` ids and a rest. The rests' lengths, rounded up to
``STEP``, make a histogram of at most ``SEQUENCE / STEP`` classes, whatever the number of documents: only that reaches
the driver. A linear program over patterns (how often each class stands in one sequence) is solved by a revised simplex;
a knapsack by dynamic programming over the duals prices new patterns, until none can save a thousandth. Patterns are
rounded down, and what is left of the histogram is filled first-fit, longest first. Documents are then ranked inside
their class (numbered in hashed buckets, so no class meets in one task) and each rank's place in the patterns is looked
up; offsets are running sums inside a sequence.

Defined cases: null or empty text is the end id alone; an empty table packs nothing; repeated rows and ids are packed
each; null ids stay null; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parlance.llm import tokens
from parlance.llm.common import Stash, partitions, parts, table, texts

SEQUENCE, STEP = 4096, 8
#: Words that a worker keeps in the pipeline.
STAGE_CACHE = 400_000
#: The saving at which no more patterns are sought, as a share of the sequences.
GAP = 1e-3
_END = np.array([tokens.END], "<u4").tobytes()


def pieces(docs: DataFrame, path: str | None = None, sequence: int = SEQUENCE, cache: int = tokens.CACHE) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of each piece."""
    path = path or tokens.default_path()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, keeps="tokens"):
            own, rows = [], []
            for i, ids in enumerate(tokens.encode(texts(batch, "text"), path, cache)):
                ids += _END
                n = len(ids) // 4
                for start in range(0, n, sequence):
                    part = ids[4 * start : 4 * (start + sequence)]
                    own.append(i)
                    rows.append((start, len(part) // 4, zlib.crc32(part), n))
            table_ = np.array(rows, np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own, pa.int64())), *map(pa.array, table_.T)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def best_patterns(value: np.ndarray, width: np.ndarray, room: int, most: int = 8) -> tuple[float, list[np.ndarray]]:
    """The unbounded knapsack: how often to take each class for the greatest value within the room.

    The table of the best values of all rooms also has the best pattern around each class; up to ``most`` of these are
    returned, the best first, with the greatest value.
    """
    best, took = np.zeros(room + 1), np.full(room + 1, -1)
    by_width = np.full(room + 1, -np.inf)
    np.maximum.at(by_width, width, value)
    back = np.zeros(room + 1)  # best, backwards: its last c numbers are best[c - 1] to best[0]
    for c in range(1, room + 1):
        got = back[room - c + 1 :] + by_width[1 : c + 1]
        j = got.argmax()
        if got[j] > best[c - 1] + 1e-12:
            best[c], took[c] = got[j], j + 1
        else:
            best[c] = best[c - 1]
        back[room - c] = best[c]
    used = np.maximum.accumulate(np.where(took > 0, np.arange(room + 1), 0))  # the room that the best pattern fills
    at = {int(w): i for i, w in enumerate(width)}
    around = value + best[room - width]
    out: dict[bytes, np.ndarray] = {}
    for j in np.argsort(-around, kind="stable"):
        if len(out) == most or around[j] <= 1:
            break
        pattern = np.zeros(len(width), np.int64)
        pattern[j] = 1
        c = used[room - width[j]]
        while c > 0:
            pattern[at[int(took[c])]] += 1
            c = used[c - took[c]]
        out.setdefault(pattern.tobytes(), pattern)
    return float(best[room]), list(out.values())


def linear_program(width: np.ndarray, demand: np.ndarray, room: int, gap: float = GAP) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (rows) and how often each is used, not yet whole: a revised simplex that prices columns by knapsack."""
    columns = np.diag(room // width).astype(float)
    inverse = np.diag(1.0 / np.diag(columns))
    level = inverse @ demand
    while True:
        duals = inverse.sum(0)
        worth, found = best_patterns(duals, width, room)
        if worth <= 1 + gap:  # no packing has fewer than level.sum() / worth sequences
            return columns.T.astype(np.int64), level
        for pattern in found:
            if duals @ pattern <= 1 + gap / 2:
                continue
            direction = inverse @ pattern
            ratio = np.where(direction > 1e-9, level / np.where(direction > 1e-9, direction, 1), np.inf)
            out = int(np.argmin(ratio))
            if not np.isfinite(ratio[out]):
                continue
            step = ratio[out]
            level = np.maximum(level - step * direction, 0)
            level[out] = step
            columns[:, out] = pattern
            pivot = inverse[out] / direction[out]
            rows, own = np.flatnonzero(np.abs(direction) > 1e-12), np.flatnonzero(pivot)
            inverse[np.ix_(rows, own)] -= np.outer(direction[rows], pivot[own])
            inverse[out] = pivot
            duals = inverse.sum(0)


def plan(width: np.ndarray, demand: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Patterns and whole numbers of sequences that hold all of the demand and no more."""
    if not len(width):
        return np.zeros((0, 0), np.int64), np.zeros(0, np.int64)
    patterns, level = linear_program(width, demand.astype(float), room)
    times = np.floor(level + 1e-9).astype(np.int64)
    left = demand - times @ patterns
    while (left < 0).any():  # rounding never asks for more than there is
        k = int(np.flatnonzero((patterns[:, np.argmin(left)] > 0) & (times > 0))[0])
        times[k] -= 1
        left = demand - times @ patterns
    # the rest: fill one sequence after another with the longest that fit
    order = np.argsort(-width, kind="stable")
    more: dict[tuple[int, ...], int] = {}
    while left.any():
        free, pattern = room, np.zeros(len(width), np.int64)
        for c in order:
            n = min(int(left[c]), free // int(width[c]))
            if n:
                pattern[c] = n
                free -= n * int(width[c])
        n = int((left[pattern > 0] // pattern[pattern > 0]).min())
        left = left - n * pattern
        more[tuple(pattern)] = more.get(tuple(pattern), 0) + n
    if more:
        patterns = np.concatenate([patterns, np.array(list(more), np.int64)])
        times = np.concatenate([times, np.array(list(more.values()), np.int64)])
    return patterns[times > 0], times[times > 0]


def places(width: np.ndarray, patterns: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Rows (class, first rank, first sequence, slot): where runs of ranks of a class go, by class and rank."""
    rows = []
    taken = np.zeros(len(width), np.int64)
    first = 0
    for pattern, n in zip(patterns, times, strict=True):
        slot = 0
        for c in np.argsort(-width, kind="stable"):
            for _ in range(int(pattern[c])):
                rows.append((c, taken[c], first, slot))
                taken[c] += n
                slot += 1
        first += n
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def ranked(cut: DataFrame, stash: Stash) -> DataFrame:
    """Pieces with their class and a gapless rank (from 0) inside it, numbered bucket by bucket."""
    spark = cut.sparkSession
    n = max(64, partitions(spark))
    keyed = cut.withColumn("class", F.ceil(F.col("length") / STEP).cast("int")).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start"), F.lit(n)).cast("int"))
    counts = keyed.groupBy("class", "bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("class").orderBy("bucket")) - F.col("n")
    counts = stash.put(counts.select("class", "bucket", before.alias("before")), "before")
    inside = F.row_number().over(Window.partitionBy("class", "bucket").orderBy("doc_id", "start", "ids_crc32")) - 1
    return keyed.withColumn("inside", inside).join(counts, ["class", "bucket"]).withColumn("rank", F.col("before") + F.col("inside")).drop("bucket", "before", "inside")


def packed(docs: DataFrame, path: str | None = None, cache: int = tokens.CACHE) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of each piece."""
    stash = Stash(docs.sparkSession)
    cut = stash.put(pieces(docs, path, cache=cache), "pieces")
    # at most SEQUENCE / STEP rows
    histogram = sorted((r["class"], r["n"]) for r in cut.groupBy(F.ceil(F.col("length") / STEP).cast("int").alias("class")).agg(F.count("*").alias("n")).collect())
    width = np.array([c for c, _ in histogram], np.int64)
    patterns, times = plan(width, np.array([n for _, n in histogram], np.int64), SEQUENCE // STEP)
    rows = places(width, patterns, times)
    far = np.int64(1) << np.int64(44)
    keys = width[rows[:, 0]] * far + rows[:, 1] if len(rows) else np.zeros(0, np.int64)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            rank = batch.column(batch.schema.get_field_index("rank")).to_numpy()
            kind = batch.column(batch.schema.get_field_index("class")).to_numpy().astype(np.int64)
            at = rows[np.searchsorted(keys, kind * far + rank, side="right") - 1]
            own = [batch.column(batch.schema.get_field_index(x)) for x in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(at[:, 2] + rank - at[:, 1]), pa.array(at[:, 3])], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "slot"])

    put = ranked(cut, stash).mapInArrow(place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, slot long")
    order = Window.partitionBy("sequence_id").orderBy("slot")
    return put.withColumn("offset", F.sum("length").over(order) - F.col("length")).drop("slot")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As ``packed``; workers keep fewer words, because they hold what earlier stages left them with, too."""
    return packed(docs, cache=STAGE_CACHE)
