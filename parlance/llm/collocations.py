"""Phrase collocations: sketch upper bounds choose candidates, Aho-Corasick automata count them exactly.

1. Sketch. Each shard (texts of one language, ``SHARD`` bytes of them) hashes its runs of one to ``longest`` words and
   sends each cell of the sketch once, with its count (``least`` at most) as packed bytes; blocks of cells are added up
   by Spark. A cell's sum is never below the count of a run in it, so runs that occur ``least`` times lie in heavy cells.
2. Candidates. The heavy cells become one bitmap of at most ``MOST_BITS`` bits, merged in segments by Spark and broadcast.
   It only ever lets more through, so its bound costs work, not results.
3. Count. Each shard compiles its runs in heavy cells into an automaton whose patterns are guarded by delimiters,
   and counts all overlapping matches in its texts. As the bitmap is the same everywhere, a run is counted in every shard
   where it occurs. Counts are added up by Spark, and only then come the thresholds.
4. Scores. Parts of a candidate are at least as frequent, so they are among the counted runs: joins by language and part.

A shard's memory is bounded by ``SHARD`` (one longer text makes a shard of its own); no list of candidates is ever held
whole. The work grows with the input alone.

Defined cases: null text is empty, null language is ``und``; a text without words adds nothing; repeated rows count
each; an empty table gives no rows; null ids and other columns play no part.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parlance.llm.common import Stash, parts, partitions, table
from parlance.llm.words import Chunk, chunks, lowered, mix, windows

LEAST, LONGEST, SHOWN = 10, 3, 2000
#: Percent of a candidate's occurrences that lie inside one longer candidate from which it is dropped.
INSIDE = 50
#: Bytes of text that are counted by one automaton.
SHARD = 8 << 20
#: Bits for each heavy cell, the positions that each cell sets, and the most bits of the bitmap (64 MB).
CELL_BITS, HASHES, MOST_BITS = 16, 2, 1 << 29
#: Bytes of one segment of the bitmap.
SEGMENT = 1 << 16
#: What ends a piece, and what stands between words (fixed values).
_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_GAPS = _ENDS.copy()
_GAPS[[0x20, 0x09]] = True


class Runs:
    """The lower-cased words of texts, the pieces that they stand in, and a text for scanning: every word is followed by
    a space, every piece preceded by a line feed and a space, so a run of words inside a piece, and nothing else, reads
    `` word word `` there."""

    def __init__(self, texts: list[bytes]):
        own = [self._of(chunk) for chunk in chunks(texts, _GAPS)]
        self.hashes, self.piece, first, last = (np.concatenate([o[i] for o in own] or [np.zeros(0, np.int64)]) for i in range(4))
        self.count = len(self.hashes)
        self.text = b"".join(o[4] for o in own)
        # numbers of pieces, and places, go on from chunk to chunk
        sizes = [len(o[0]) for o in own]
        shift = lambda values: np.repeat(np.cumsum(values) - values, sizes)
        if own:
            self.piece = self.piece + shift(np.array([o[5] for o in own]))
            at = shift(np.array([len(o[4]) for o in own]))
            first, last = first + at, last + at
        self.first, self.last = first, last

    @staticmethod
    def _of(chunk: Chunk) -> tuple:
        low = lowered(chunk.bytes)
        count = len(chunk.starts)
        ends = np.cumsum(_ENDS[chunk.bytes])
        if not count:
            return chunk.hashes(low), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), b"", int(ends[-1])
        # pieces are told apart by the ends before a word
        piece = ends[chunk.starts]
        lengths = chunk.ends - chunk.starts
        new = np.diff(piece, prepend=-1) != 0
        before = np.arange(count) + 2 * np.cumsum(new)
        first = np.cumsum(lengths) - lengths + before
        out = np.full(int(first[-1] + lengths[-1]) + 1, 0x20, np.uint8)
        letters = ~chunk.space
        out[np.arange(int(lengths.sum())) + np.repeat(before, lengths)] = low[letters]
        out[first[new] - 2] = 0x0A
        return chunk.hashes(low), piece, first, first + lengths, out.tobytes(), int(ends[-1])

    def runs(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of first words, and hashes, of all runs of ``size`` words inside a piece."""
        if self.count < size:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        inside = np.flatnonzero(self.piece[size - 1 :] == self.piece[: self.count - size + 1])
        return inside, mix(windows(self.hashes, size)[inside] + np.uint64(size))

    def pattern(self, first: int, size: int) -> str:
        return self.text[self.first[first] - 1 : self.last[first + size - 1] + 1].decode()


def shards(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[str, list[bytes]]]:
    """Texts of one language (columns lang, text), ``most`` bytes or one text at once."""
    held: dict[str, list[bytes]] = {}
    size: dict[str, int] = {}
    for batch in parts(batches):
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist(), strict=True):
            if size.get(lang, 0) and size[lang] + len(text) > most:
                yield lang, held.pop(lang)
                size[lang] = 0
            held.setdefault(lang, []).append(text)
            size[lang] = size.get(lang, 0) + len(text) + 1
            if sum(size.values()) > 2 * most:  # many languages: the largest one goes
                lang = max(size, key=size.get)
                yield lang, held.pop(lang)
                size[lang] = 0
    yield from held.items()


def _cells(lang: str, hashes: np.ndarray) -> np.ndarray:
    seed = int.from_bytes(lang.encode()[:64].ljust(8, b"\0")[:8], "little") ^ (len(lang) * 0x9E3779B97F4A7C15 & (2**64 - 1))
    return mix(hashes ^ np.uint64(seed))


def sketch(texts: DataFrame, least: int, longest: int, shard: int, blocks: int) -> DataFrame:
    """block, and packed bytes of its cells (40 bits less the block's, in order) and counts (``least`` at most), a row a
    shard."""
    bits = np.uint64(64 - (blocks.bit_length() - 1))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, own in shards(batches, shard):
            runs = Runs(own)
            cells, counts = np.unique(np.concatenate([_cells(lang, runs.runs(k)[1]) for k in range(1, longest + 1)]), return_counts=True)
            if not len(cells):
                continue
            block = (cells >> bits).astype(np.int64)
            cells = (cells >> (bits - np.uint64(32))).astype("<u4")
            counts = np.minimum(counts, least).astype(np.uint8)
            held, first = np.unique(block, return_index=True)
            last = np.append(first[1:], len(block))
            yield pa.record_batch([pa.array(held), pa.array([cells[a:b].tobytes() for a, b in zip(first, last, strict=True)], pa.binary()), pa.array([counts[a:b].tobytes() for a, b in zip(first, last, strict=True)], pa.binary())], names=["block", "cells", "counts"])

    return texts.mapInArrow(count, "block long, cells binary, counts binary")


def heavy(packed: DataFrame, least: int, width: int) -> DataFrame:
    """block and its cells of ``least`` or more, as packed bytes, with their number. One block is held at once."""

    def added(block: int, cells: list[bytes], counts: list[bytes]) -> tuple[int, bytes, int]:
        own = np.frombuffer(b"".join(cells), "<u4")
        order = np.argsort(own, kind="stable")
        own = own[order]
        first = np.flatnonzero(np.diff(own, prepend=np.uint32(0)) != 0) if len(own) else np.zeros(0, np.int64)
        if len(own) and (not len(first) or first[0] != 0):
            first = np.append(0, first)
        total = np.add.reduceat(np.frombuffer(b"".join(counts), np.uint8)[order].astype(np.int64), first)
        kept = own[first][total >= least]
        return block, kept.tobytes(), len(kept)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for block, own in itertools.groupby(rows, key=lambda r: r[0]):
            own = list(own)
            block, kept, n = added(block, [r[1] for r in own], [r[2] for r in own])
            yield pa.record_batch([pa.array([block]), pa.array([kept], pa.binary()), pa.array([n])], names=["block", "cells", "n"])

    return packed.repartition(width, "block").sortWithinPartitions("block").mapInArrow(add, "block long, cells binary, n long")


def _places(block: np.ndarray, cells: np.ndarray, bits: int) -> np.ndarray:
    """The bits that stand for cells of blocks."""
    own = mix((block.astype(np.uint64) << np.uint64(32)) | cells.astype(np.uint64))
    return np.concatenate([(own if i == 0 else mix(own + np.uint64(i))) & np.uint64(bits - 1) for i in range(HASHES)])


def bitmap(cells: DataFrame) -> np.ndarray:
    """Bytes of the bitmap of heavy cells; its segments are merged by Spark, and at most ``MOST_BITS`` come here."""
    total = cells.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).collect()[0]["n"]
    bits = min(MOST_BITS, 1 << max(16, (int(total) * CELL_BITS).bit_length()))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.frombuffer(own, "<u4")
                if not len(own):
                    continue
                at = np.unique(_places(np.full(len(own), block), own, bits))
                segment = (at // np.uint64(SEGMENT * 8)).astype(np.int64)
                held, first = np.unique(segment, return_index=True)
                last = np.append(first[1:], len(at))
                low = (at % np.uint64(SEGMENT * 8)).astype("<u4")
                yield pa.record_batch([pa.array(held), pa.array([low[a:b].tobytes() for a, b in zip(first, last, strict=True)], pa.binary())], names=["segment", "low"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for segment, own in itertools.groupby(rows, key=lambda r: r[0]):
            flags = np.zeros(SEGMENT * 8, np.uint8)
            for _, low in own:
                flags[np.frombuffer(low, "<u4")] = 1
            yield pa.record_batch([pa.array([segment]), pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary())], names=["segment", "bits"])

    width = min(partitions(cells.sparkSession), max(1, bits // (SEGMENT * 8)))
    merged = cells.mapInArrow(spread, "segment long, low binary").repartition(width, "segment").sortWithinPartitions("segment").mapInArrow(merge, "segment long, bits binary")
    out = np.zeros(max(bits // 8, SEGMENT), np.uint8)
    for row in merged.collect():
        out[row["segment"] * SEGMENT : (row["segment"] + 1) * SEGMENT] = np.frombuffer(row["bits"], np.uint8)
    return out[: bits // 8]


def _chosen(lang: str, runs: Runs, longest: int, bits: np.ndarray, blocks: int, every: bool = False) -> tuple[list[str], int]:
    """The patterns of a shard's runs whose cells are heavy, and how often such runs occur. One run of each hash is
    spelled out; with ``every`` all of them are."""
    shift = np.uint64(64 - (blocks.bit_length() - 1))
    out: set[str] = set()
    occur = 0
    for size in range(1, longest + 1):
        first, hashes = runs.runs(size)
        cells = _cells(lang, hashes)
        known = np.ones(len(cells), bool)
        for p in _places(cells >> shift, (cells >> (shift - np.uint64(32))).astype(np.uint32), len(bits) * 8).reshape(HASHES, -1):
            known &= (bits[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 > 0
        first, hashes = first[known], hashes[known]
        occur += len(first)
        out.update(runs.pattern(i, size) for i in (first if every else first[np.unique(hashes, return_index=True)[1]]).tolist())
    return sorted(out), occur


def _scan(patterns: list[str], text: str) -> np.ndarray:
    """How often each pattern occurs, overlaps included."""
    if not patterns:
        return np.zeros(0, np.int64)
    machine = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for i, pattern in enumerate(patterns):
        machine.add_word(pattern, i)
    machine.make_automaton()
    return np.bincount(np.fromiter((i for _, i in machine.iter(text)), np.int64), minlength=len(patterns))


def counted(texts: DataFrame, longest: int, shard: int, bits: np.ndarray, blocks: int) -> DataFrame:
    """lang, phrase, size in words and count, a row a shard and candidate; the null phrase has the count of all words."""
    shared = texts.sparkSession.sparkContext.broadcast(bits.tobytes())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(shared.value, np.uint8)
        for lang, own in shards(batches, shard):
            runs = Runs(own)
            if not runs.count:
                continue
            text = runs.text.decode()
            patterns, occur = _chosen(lang, runs, longest, known, blocks)
            total = _scan(patterns, text)
            if total.sum() != occur:  # two runs share a hash: spell out all
                patterns, _ = _chosen(lang, runs, longest, known, blocks, every=True)
                total = _scan(patterns, text)
            names = [None, *(p[1:-1] for p in patterns)]
            for a in range(0, len(names), 1 << 16):
                some = names[a : a + (1 << 16)]
                count = np.concatenate([[runs.count], total])[a : a + len(some)]
                yield pa.record_batch([pa.array([lang] * len(some), pa.string()), pa.array(some, pa.string()), pa.array([0 if x is None else x.count(" ") + 1 for x in some], pa.int32()), pa.array(count)], names=["lang", "phrase", "size", "count"])

    return texts.mapInArrow(scan, "lang string, phrase string, size int, count long")


def frequent(documents: DataFrame, stash: Stash, least: int = LEAST, longest: int = LONGEST, shard: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """lang, phrase, size, f of all runs of up to ``longest`` words with ``least`` or more occurrences, by language; and
    lang, n (all words)."""
    spark = documents.sparkSession
    texts = documents.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    width = partitions(spark)
    blocks = 1 << max(6, (4 * width - 1).bit_length())
    cells = stash.put(heavy(sketch(texts, least, longest, shard, blocks), least, width), "heavy")
    bits = bitmap(cells)
    counts = counted(texts, longest, shard, bits, blocks).groupBy("lang", "phrase", "size").agg(F.sum("count").alias("f"))
    counts = stash.put(counts.where((F.col("f") >= least) | F.col("phrase").isNull()), "counts")
    return counts.where("phrase is not null"), counts.where("phrase is null").select("lang", F.col("f").alias("n"))


def _part(phrase: Column, first: int, size: int) -> Column:
    return F.array_join(F.slice(F.split(phrase, " "), first, size), " ")


def scored(counts: DataFrame, longest: int = LONGEST, inside: int = INSIDE) -> DataFrame:
    """lang, phrase, a, l, r, score of the candidates that no longer one takes away. Numbers are exact: products have 38
    digits, so they hold up to 10**15 occurrences."""
    candidates = counts.where("size > 1")
    # the parts of a candidate at each cut, each asked for once
    sizes = [(k, size, side) for size in range(2, longest + 1) for k in range(1, size) for side in ("l", "r")]
    asked = F.array(*(F.when(F.col("size") == size, F.struct(F.lit(k).alias("cut"), F.lit(side).alias("side"), (_part(F.col("phrase"), 1, k) if side == "l" else _part(F.col("phrase"), k + 1, size - k)).alias("part"))) for k, size, side in sizes))
    wanted = candidates.select("lang", "phrase", F.col("f").alias("a"), F.inline(F.filter(asked, lambda x: x.isNotNull())))
    held = counts.select(F.col("lang").alias("_lang"), F.col("phrase").alias("part"), F.col("f").alias("_f"))
    wanted = wanted.join(held, (F.col("lang") == F.col("_lang")) & (wanted["part"] == held["part"]))
    of = lambda side: F.max(F.when(F.col("side") == side, F.col("_f")))
    cuts = wanted.groupBy("lang", "phrase", "a", "cut").agg(of("l").alias("l"), of("r").alias("r"))
    exact = lambda c: f"cast({c} as decimal(15,0))"
    cuts = cuts.withColumn("score", F.expr(f"(cast(1000000 as decimal(7,0)) * ({exact('a')} * {exact('a')})) div ({exact('l')} * {exact('r')})"))
    best = F.min(F.struct("score", "cut", "l", "r"))
    out = cuts.groupBy("lang", "phrase", "a").agg(best.alias("x")).select("lang", "phrase", "a", "x.l", "x.r", "x.score")
    # phrases inside a longer candidate, with the greatest count of one
    spans = [(first, k, size) for size in range(3, longest + 1) for k in range(2, size) for first in range(1, size - k + 2)]
    if not spans:
        return out
    within = F.array(*(F.when(F.col("size") == size, _part(F.col("phrase"), first, k)) for first, k, size in spans))
    longer = candidates.select("lang", F.col("f"), F.explode(F.filter(within, lambda x: x.isNotNull())).alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    out = out.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * inside))
    return out.drop("longer")


def mined(documents: DataFrame, stash: Stash, least: int = LEAST, longest: int = LONGEST, shown: int = SHOWN, shard: int = SHARD) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``shown`` of each language. Rows are limited in salted groups of a
    language before its groups meet."""
    counts, words = frequent(documents, stash, least, longest, shard)
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    own = scored(counts, longest).withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    own = own.withColumn("_rank", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).where(F.col("_rank") <= shown)
    own = own.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= shown)
    return own.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns."""
    return mined(table(spark, sf_dir, "documents"), Stash(spark))


#: All runs counted plainly.
ORACLE = f"""
WITH t AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM t
), n AS (
  SELECT lang, cast(sum(len(ws)) AS bigint) AS n FROM w GROUP BY lang
), g AS MATERIALIZED (
  SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase, count(*) AS f
  FROM w, (SELECT unnest(range(1, {LONGEST + 1})) AS k) z, unnest(range(1, greatest(len(ws) - k + 1, 0) + 1)) AS t(i) GROUP BY ALL HAVING count(*) >= {LEAST}
), c AS (
  SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM g WHERE k > 1
), s AS (
  SELECT c.lang, c.phrase, c.a, j AS cut, l.f AS l, r.f AS r, (cast(1000000 AS hugeint) * c.a * c.a) // (cast(l.f AS hugeint) * r.f) AS score
  FROM c, unnest(range(1, k)) AS t(j)
  JOIN g l ON l.lang = c.lang AND l.phrase = array_to_string(ws[1:j], ' ') JOIN g r ON r.lang = c.lang AND r.phrase = array_to_string(ws[j + 1:], ' ')
), b AS (
  SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), d AS (
  SELECT DISTINCT b.lang, b.phrase FROM b JOIN c ON c.lang = b.lang AND len(c.ws) = 3
    AND (b.phrase = c.ws[1] || ' ' || c.ws[2] OR b.phrase = c.ws[2] || ' ' || c.ws[3]) AND 100 * c.a >= {INSIDE} * b.a
), o AS (
  SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, encode(b.phrase)) AS rank
  FROM b WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.lang = b.lang AND d.phrase = b.phrase)
)
SELECT o.lang, rank, phrase, a, l, r, n.n, cast(score AS bigint) AS score FROM o JOIN n ON n.lang = o.lang WHERE rank <= {SHOWN}
"""
