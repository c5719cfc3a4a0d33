"""Quality rules: boosted trees over document statistics, with monotonic constraints.

Statistics are computed per whole text, vectorised over chunks. The trees are fitted on a bounded sample of labelled
documents (``sample`` rows at most, chosen by a hash of the id), flattened into numpy node arrays and applied to every
document inside the tasks that computed its statistics: one pass over the texts, no shuffle of them.

Defined cases: a null or empty text has no words, so all counts are 0 and it fails the base rule; a null id is kept as
null; repeated rows are judged each; other columns are ignored; without labels of both classes the trees are constant
and the verdict is the more frequent label (keep, if there is none).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm import gbt, words
from parlance.llm.common import parts, table, texts

#: Fixed values of the base rule.
SYMBOLS = b"#*$%&|<>"
MIN_WORDS, WINDOW, MAX_REPEAT_PERCENT = 20, 8, 30
#: Labelled documents that the trees are fitted on, at most.
SAMPLE = 6000
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SHARES = ("log_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share", "mark_share", "symbol_word_share", "echo_share", "distinct_share")
#: A document's chance of being kept may only fall with these.
MONOTONE = {SHARES.index(x): -1 for x in ("symbol_share", "dup_line_share", "repeat_share", "upper_share", "symbol_word_share", "echo_share")}

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True
_IS_MARK = np.zeros(256, bool)
_IS_MARK[list(b"!?.,;:")] = True


def _lines(text: bytes) -> tuple[int, int]:
    """Lines with a word, and those equal to an earlier one."""
    full = [x for x in text.split(b"\n") if x.strip()]
    return len(full), len(full) - len(set(full))


def statistics(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Counts (one column each of COUNTS) and shares (SHARES) of whole texts."""
    counts, shares = [], []
    for chunk in words.chunks(docs):
        b = chunk.bytes
        n = chunk.last - chunk.first
        hashes = chunk.hashes()
        n_words = np.diff(chunk.word_at)
        solid = ~chunk.space
        chars = chunk.per_text(solid & ((b & 0xC0) != 0x80))
        symbol = _IS_SYMBOL[b]
        n_symbols = chunk.per_text(symbol)
        lines = np.array([_lines(x) for x in docs[chunk.first : chunk.last]], np.int64).reshape(n, 2)
        owner = np.repeat(np.arange(n), n_words)
        hit = np.zeros(len(hashes), bool)
        window = words.windows(hashes, WINDOW)
        if len(window):
            whole = owner[: len(window)] == owner[WINDOW - 1 :]
            key = window[whole] ^ words.mix(owner[: len(window)][whole].astype(np.uint64) + np.uint64(7))
            _, back, times = np.unique(key, return_inverse=True, return_counts=True)
            again = np.zeros(len(hashes) + 1, np.int64)
            again[np.flatnonzero(whole)] = times[back] > 1
            total = np.concatenate([[0], np.cumsum(again[:-1])])
            j = np.arange(len(hashes))
            hit = total[j + 1] > total[np.maximum(j + 1 - WINDOW, 0)]
        repeat = chunk.per_text_words(hit)
        same = np.zeros(len(hashes), bool)
        if len(hashes) > 1:
            same[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
        key = hashes ^ words.mix(owner.astype(np.uint64) + np.uint64(11))
        fresh = np.bincount(owner[np.unique(key, return_index=True)[1]], minlength=n) if len(key) else np.zeros(n)
        bad_word = np.logical_or.reduceat(symbol, chunk.starts) if len(hashes) else np.zeros(0, bool)
        bytes_in = np.maximum(chunk.per_text(solid), 1)
        w = np.maximum(n_words, 1)
        counts.append(np.stack([n_words, chars, n_symbols, lines[:, 1], repeat], 1))
        shares.append(
            np.stack(
                [np.log1p(n_words), chars / w, n_symbols / bytes_in, lines[:, 1] / np.maximum(lines[:, 0], 1), repeat / w, chunk.per_text((b >= 65) & (b <= 90)) / bytes_in, chunk.per_text((b >= 48) & (b <= 57)) / bytes_in, chunk.per_text(_IS_MARK[b]) / bytes_in, chunk.per_text_words(bad_word) / w, chunk.per_text_words(same) / w, fresh / w], 1
            )
        )
    if not counts:
        return np.zeros((0, len(COUNTS)), np.int64), np.zeros((0, len(SHARES)))
    return np.concatenate(counts).astype(np.int64), np.concatenate(shares)


def base_failed(counts: np.ndarray) -> np.ndarray:
    n_words, repeat = counts[:, 0], counts[:, 4]
    return (n_words < MIN_WORDS) | (100 * repeat > MAX_REPEAT_PERCENT * n_words)


def _shares_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in parts(batches):
        _, shares = statistics(texts(batch, "text"))
        yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, shares.T)], ["quality", *SHARES])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> gbt.Trees:
    """Trees for P(quality = 1), from at most ``sample`` labelled rows: those whose hashed ids are smallest."""
    chosen = labels.where("doc_id is not null and quality in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").select("quality", "text")
    # limited once more: an id that repeats can't bring more rows
    frame = rows.mapInArrow(_shares_of, "quality double, " + ", ".join(f"{x} double" for x in SHARES)).orderBy(F.xxhash64(*SHARES), *SHARES, "quality").limit(sample).toPandas()
    frame = frame.sort_values(list(frame.columns)).reset_index(drop=True)  # the fit doesn't depend on the order of rows
    return gbt.fit(frame[list(SHARES)].to_numpy(float), frame["quality"].to_numpy(float), MONOTONE)


def apply(docs: DataFrame, trees: gbt.Trees) -> DataFrame:
    """Each document's id, counts, ``base_failed``, the trees' ``score`` (0 to 1) and ``kept``."""

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            counts, shares = statistics(texts(batch, "text"))
            failed = base_failed(counts)
            score = 1 / (1 + np.exp(-trees.margins(shares)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, counts.T), pa.array(failed), pa.array(score), pa.array(~failed & (score >= 0.5))], ["doc_id", *COUNTS, "base_failed", "score", "kept"])

    schema = "doc_id long, " + ", ".join(f"{x} long" for x in COUNTS) + ", base_failed boolean, score double, kept boolean"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(judged, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return apply(docs, fit(docs, table(spark, sf_dir, "labels")))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, with all their columns."""
    trees = fit(docs, table(spark, sf_dir, "labels"))
    names = docs.columns

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            counts, shares = statistics(texts(batch, "text"))
            yield batch.filter(pa.array(~base_failed(counts) & (trees.margins(shares) >= 0)))

    return docs.mapInArrow(kept, docs.schema).select(*names)
