"""Near-duplicate detection with HyperMinHash sketches, banding, and verification on full shingle sets.

A document's set is its distinct five-word shingles (A-Z lower-cased; the whole sequence where there are fewer words).
Each shingle falls into one of ``REGISTERS`` buckets, and a bucket keeps the leading-zero count and ``MANTISSA`` further
bits of its smallest hash; an empty bucket takes over another one's register, in an order that depends on the bucket
only. Bands of ``ROWS`` registers are the keys of candidate groups. At a similarity of 0.8 a pair misses all bands with a
chance of 1e-7, at 0.85 of 1e-10; the chance that unequal registers collide is part of ``estimate``.

1. ``sketches``: one pass over the texts. Documents with equal sets are one class (by a 128-bit digest), and the class's
   smallest id stands for it from here on, so thousands of copies cost no pairs.
2. Each band group's smallest id is its hub, found by a map-side combined aggregate. Every other member has one link to
   try per hub; it tries the hub that it shares most bands with, if the corrected estimate doesn't rule it out by far.
   Links are confirmed on full sets and components are merged.
3. What is left are band groups that hold more than one component. Their members are compared in blocks inside tasks:
   the product of two 0/1 matrices over shared shingles gives all exact intersections of a block, and only links that
   join components leave the task, so no pairs are emitted. Groups of any size are cut into blocks; none is capped.
4. Components over all links, by hooking and pointer jumping on a table.

Defined cases: null or empty texts, and texts of white space, have empty sets and are linked with nothing; a row without
an id has no component (null) and is kept; rows that share an id count as one document, linked if any of them is; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parlance.llm import words
from parlance.llm.common import Stash, parts, runs, table, texts

SHINGLE = 5
BANDS, ROWS = 40, 5
REGISTERS = BANDS * ROWS
#: Bits of a register: the leading-zero count takes the upper 6, the mantissa the lower 10.
MANTISSA = 10
#: Members of a block of a band group that is compared inside one task.
BLOCK = 512
#: Shared bands below which a hub is not tried first (0.8 ** 5 * 40 is 13 bands; 3 standard deviations less is 5).
FEW = 3
_NONE = np.uint16(0xFFFF)
#: For each bucket, the order in which it looks for a register to take over.
_ORDER = np.stack([np.random.default_rng(977 + i).permutation(REGISTERS) for i in range(REGISTERS)])
_ORDER = np.array([[i, *row[row != i]] for i, row in enumerate(_ORDER)])


def shingle_sets(docs: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text."""
    out = []
    for chunk in words.chunks(docs):
        hashes = chunk.hashes(words.lowered(chunk.bytes))
        runs = words.windows(hashes, SHINGLE)
        for first, last in zip(chunk.word_at[:-1].tolist(), chunk.word_at[1:].tolist(), strict=True):
            if last - first >= SHINGLE:
                out.append(np.unique(runs[first : last - SHINGLE + 1]))
            elif last > first:
                whole = words.windows(hashes[first:last], last - first)
                out.append(words.mix(whole + np.uint64(last - first)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def registers(shingles: np.ndarray) -> np.ndarray:
    """The compressed registers of one set; all empty for an empty set."""
    out = np.full(REGISTERS, _NONE, np.uint16)
    if not len(shingles):
        return out
    h = words.mix(shingles ^ np.uint64(0x5851F42D4C957F2D))
    bucket = ((h >> np.uint64(32)) * np.uint64(REGISTERS) >> np.uint64(32)).astype(np.int64)
    rest = words.mix(h + np.uint64(0x14057B7EF767814F))
    order = np.argsort(rest, kind="stable")
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    seen, at = np.unique(bucket[order], return_index=True)
    least[seen] = rest[order][at]
    zeros = np.minimum(63 - np.floor(np.log2(np.maximum((least[seen] >> np.uint64(11)).astype(np.float64), 0.5))).astype(np.int64) - 11, 62)
    mantissa = (least[seen] << np.minimum(zeros + 1, 63).astype(np.uint64)) >> np.uint64(64 - MANTISSA)
    out[seen] = (zeros.astype(np.uint16) << np.uint16(MANTISSA)) | mantissa.astype(np.uint16)
    if len(seen) < REGISTERS:
        full = out != _NONE
        empty = np.flatnonzero(~full)
        donors = _ORDER[empty]
        out[empty] = out[donors[np.arange(len(empty)), np.argmax(full[donors], axis=1)]]
    return out


def band_keys(regs: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band of each row of registers."""
    x = regs.reshape(-1, BANDS, ROWS).astype(np.uint64)
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), x.shape[:2]).copy()
    for r in range(ROWS):
        out = words.mix(out ^ x[:, :, r]) + np.uint64(r)
    return out.view(np.int64)


#: The chance that two registers of different minima agree: equal zero counts (about 1 in 3) and mantissas.
COLLISION = 2.0**-MANTISSA / 3


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard similarity of rows of registers, corrected for collisions."""
    return np.maximum(0.0, ((a == b).mean(-1) - COLLISION) / (1 - COLLISION))


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in parts(batches):
        sets = shingle_sets(texts(batch, "text"))
        regs = np.stack([registers(x) for x in sets]) if sets else np.zeros((0, REGISTERS), np.uint16)
        digests = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None for x in sets]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array([x.tobytes() for x in regs], pa.binary())], ["doc_id", "n_shingles", "digest", "registers"])


def sketches(docs: DataFrame) -> DataFrame:
    return _plain(docs).mapInArrow(_sketched, "doc_id long, n_shingles long, digest binary, registers binary")


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in parts(batches):
        regs = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, REGISTERS)
        keys = band_keys(regs)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), BANDS)), pa.array(keys.ravel()), pa.array(np.tile(np.arange(BANDS, dtype=np.int32), len(keys)))], ["id", "key", "band"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in parts(batches):
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in shingle_sets(texts(batch, "text"))], pa.binary())], ["id", "items"])


def _likely(percent: int):
    """Keeps tried links whose corrected estimate is within 5 standard deviations of the threshold."""
    s = percent / 100
    least = s - 5 * (s * (1 - s) / REGISTERS) ** 0.5

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, REGISTERS) for i in (2, 3))
            yield batch.filter(pa.array(estimate(a, b) >= least)).select(["a", "b"])

    return keep


def _confirmed(percent: int):
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = 0
                if 100 * min(len(p), len(q)) >= percent * max(len(p), len(q)):
                    both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(both > 0 and 100 * both >= percent * (len(p) + len(q) - both))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    return confirm


def _products(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Exact intersection sizes of all sets of two blocks: a product of 0/1 matrices over shingles in both blocks."""
    both = np.intersect1d(np.unique(np.concatenate(left)), np.unique(np.concatenate(right)))
    out = np.zeros((len(left), len(right)), np.int64)
    for first in range(0, len(both), 4096):
        part = both[first : first + 4096]
        sides = []
        for block in (left, right):
            m = np.zeros((len(block), len(part)), np.float32)
            for i, x in enumerate(block):
                at = np.searchsorted(part, x)
                at[at == len(part)] = 0
                m[i, at[part[at] == x]] = 1
            sides.append(m)
        out += np.rint(sides[0] @ sides[1].T).astype(np.int64)
    return out


def _compared(percent: int):
    """Links between different components in one pair of blocks: one at most for each two components."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: set[tuple[int, int]] = set()
        for rows in runs(batches, 3):
            _, first, second = rows[0][:3]
            # side, id, component, set; rows that share an id may have several sets
            own = sorted({r[3:7] for r in rows})
            left, right = ([r for r in own if r[0] == side] for side in (first, second))
            if not left or not right:
                continue
            sets = [[np.frombuffer(r[3], np.uint64) for r in block] for block in (left, right)]
            comps = [np.array([r[2] for r in block]) for block in (left, right)]
            apart = comps[0][:, None] != comps[1][None, :]
            if not apart.any():
                continue
            both = _products(*sets)
            sizes = [np.array([len(x) for x in s]) for s in sets]
            union = sizes[0][:, None] + sizes[1][None, :] - both
            linked: set[tuple[int, int]] = set()
            for i, j in zip(*np.nonzero((100 * both >= percent * union) & (both > 0) & apart), strict=True):
                pair = (int(min(comps[0][i], comps[1][j])), int(max(comps[0][i], comps[1][j])))
                if pair not in linked:
                    linked.add(pair)
                    found.add((left[i][1], right[j][1]))
        yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in sorted(found)], pa.int64()) for k in (0, 1)], ["a", "b"])

    return compare


#: Ids (8 bytes each) that are broadcast at most; beyond that, texts are shuffled to them.
FEW_IDS = 2_000_000
#: Ids of more rows than this are joined apart, by a broadcast of their own labels; there are ``FEW_HOT`` at most.
HOT, FEW_HOT = 128, 500_000


def _with_label(rows: DataFrame, labels: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """``rows`` with the label (component) of the id in ``key``. The rows of a hot id stay where they are."""
    own = labels.select(F.col("id").alias(key), "component")
    few = own.join(F.broadcast(hot), key, "left_semi")
    return rows.join(F.broadcast(few), key).unionByName(rows.join(F.broadcast(hot), key, "left_anti").join(own, key))


def components(edges: DataFrame, stash: Stash, name: str) -> DataFrame:
    """id, component (the smallest id reachable) of every id in ``edges`` (a, b).

    Each round takes the smallest label among neighbours, then jumps to that label's label; tables are cut each time.
    The jump joins one row a label, not one an id, and ids of many neighbours are joined apart, so neither a hub nor a
    large component meets in one task.
    """
    both = stash.put(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), f"{name}-edges")
    hot = max(HOT, both.count() // FEW_HOT)
    hubs = stash.put(both.groupBy("b").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("b"), f"{name}-hubs")
    labels = stash.put(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("near")).select("id", F.least("id", "near").alias("component")), f"{name}-0")
    turn = 0
    while True:
        turn += 1
        near = _with_label(both, labels, "b", hubs).groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        step = stash.put(labels.join(near, "id").select("id", F.col("component").alias("old"), F.least("component", "near").alias("component")), f"{name}-{turn}")
        own = step.select(F.col("id").alias("component"), F.col("component").alias("far")).where("far < component")
        jumps = stash.put(step.select("component").distinct().join(own, "component"), f"{name}-jumps-{turn}")
        count = jumps.count()
        labels = step.select("id", "component")
        if count:
            far = F.broadcast(jumps) if count <= FEW_IDS else jumps
            labels = labels.join(far, "component", "left").select("id", F.coalesce("far", "component").alias("component"))
        stash.drop(f"{name}-{turn - 2}", f"{name}-jumps-{turn - 2}")
        if not count and not step.where("old <> component").limit(1).count():
            stash.drop(f"{name}-edges")
            return labels


def _sets_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The sets of some documents (ids: a written table). Texts only move where the ids are too many to broadcast."""
    ids = F.broadcast(ids) if ids.count() <= FEW_IDS else ids
    return _plain(docs).withColumnRenamed("doc_id", "id").join(ids, "id", "left_semi").select("id", "text").mapInArrow(_sets, "id long, items binary")


def deduplicated(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id and kept; links where 100 * intersection >= percent * union."""
    stash = Stash(docs.sparkSession)
    sketched = stash.put(sketches(docs), "sketches")
    usable = sketched.where("doc_id is not null and digest is not null")
    # a class's documents have equal sets, hence equal registers
    classes = stash.put(usable.groupBy("digest").agg(F.min("doc_id").alias("id"), F.first("registers").alias("registers")), "classes")
    banded = stash.put(classes.select("id", "registers").mapInArrow(_banded, "id long, key long, band int"), "bands")
    groups = stash.put(banded.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("last")).where("hub <> last").drop("last"), "groups")
    members = stash.put(banded.join(groups, "key"), "members")
    stash.drop("bands")
    tried = members.where("id <> hub").groupBy("id", "hub").agg(F.count("*").alias("shared")).groupBy("id").agg(F.max(F.struct("shared", -F.col("hub"))).alias("best"))
    tried = tried.where(F.col("best.shared") >= FEW).select(F.col("id").alias("a"), (-F.col("best.col2")).alias("b"))
    regs = classes.select("id", "registers")
    likely = tried.join(regs.select(F.col("id").alias("a"), F.col("registers").alias("ra")), "a").join(regs.select(F.col("id").alias("b"), F.col("registers").alias("rb")), "b").select("a", "b", "ra", "rb")
    likely = stash.put(likely.mapInArrow(_likely(percent), "a long, b long"), "likely")
    ends = stash.put(likely.select(F.col("a").alias("id")).union(likely.select("b")).distinct(), "ends")
    sets = stash.put(_sets_of(docs, ends), "sets")
    pairs = likely.join(sets.select(F.col("id").alias("a"), F.col("items").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("items").alias("y")), "b").select("a", "b", "x", "y")
    # ids that stand for two classes at once (rows that share an id) are one document
    found = stash.put(pairs.mapInArrow(_confirmed(percent), "a long, b long").distinct(), "found")
    stash.drop("sets", "likely")
    first = components(found, stash, "first")
    # band groups that still hold more than one component
    labelled = stash.put(members.select("key", "band", "id").join(first, "id", "left").withColumn("component", F.coalesce("component", "id")), "labelled")
    stash.drop("members")
    open_groups = stash.put(labelled.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key"), "open")
    rest = stash.put(labelled.join(open_groups, "key"), "rest")
    more = _between(docs, rest, regs, percent, stash)
    joined = more.select("a", "b").union(first.select(F.col("id").alias("a"), F.col("component").alias("b")))
    final = components(joined, stash, "final")
    stash.drop("labelled", "rest", "open", "found", "groups")
    member = sketched.select("doc_id", "n_shingles", "digest").join(classes.select("digest", "id"), "digest", "left")
    return (
        member.join(final, "id", "left")
        .withColumn("component_id", F.coalesce("component", "id", "doc_id"))
        .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"), F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
    )


def _near(percent: int):
    """Members of a pair of blocks that may have a link to another component, by registers. A pair only counts in the
    first band that it shares, so it is looked at once."""
    s = percent / 100
    least = s - 5 * (s * (1 - s) / REGISTERS) ** 0.5

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, bands, ids = [], [], []
        for rows in runs(batches, 3):
            key, first, second = rows[0][:3]
            band = rows[0][6]
            left, right = ([r for r in rows if r[3] == side] for side in (first, second))
            if not left or not right:
                continue
            a, b = (np.frombuffer(b"".join(r[7] for r in block), np.uint16).reshape(-1, REGISTERS) for block in (left, right))
            kinds = np.array([r[5] for r in right])
            close = np.zeros(len(right), bool)
            kept = set()
            for i, row in enumerate(left):
                apart = kinds != row[5]
                if not apart.any():
                    continue
                same = b == a[i]
                own = apart & (np.maximum(0.0, (same.mean(1) - COLLISION) / (1 - COLLISION)) >= least)
                if own.any():
                    own &= same.reshape(-1, BANDS, ROWS).all(2).argmax(1) == band
                if own.any():
                    kept.add(row[4])
                    close |= own
            kept.update(right[j][4] for j in np.flatnonzero(close))
            for x in sorted(kept):
                keys.append(key)
                bands.append(band)
                ids.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(bands, pa.int32()), pa.array(ids, pa.int64())], ["key", "band", "id"])

    return near


def _blocks(rest: DataFrame) -> DataFrame:
    """Members dealt to pairs of blocks of their group: key, one, two, side, id, component, band.

    A group's largest component needs no comparison inside itself: its blocks only meet those of the other members, so
    its rows are dealt once for each block of others, however large the component is.
    """
    sizes = rest.groupBy("key", "component").agg(F.count("*").alias("n"))
    sizes = sizes.groupBy("key").agg(F.max(F.struct("n", "component")).alias("most"), F.sum("n").alias("members"))
    sizes = sizes.select("key", F.col("most.component").alias("main"), *(F.greatest(F.lit(1), F.ceil(n / BLOCK)).cast("int").alias(x) for x, n in (("few", F.col("members") - F.col("most.n")), ("many", F.col("most.n")))))
    inside, place = F.col("component") == F.col("main"), F.xxhash64("id")
    side = F.when(inside, F.col("few") + F.pmod(place, "many")).otherwise(F.pmod(place, "few")).cast("int")
    met = F.when(inside, F.col("few")).otherwise(F.col("few") + F.col("many"))
    others = F.transform(F.sequence(F.lit(0), met - 1), lambda j: F.struct(F.least("side", j).alias("one"), F.greatest("side", j).alias("two")))
    dealt = rest.join(sizes, "key").withColumn("side", side).withColumn("pair", F.explode(others))
    return dealt.select("key", "pair.one", "pair.two", "side", "id", "component", "band")


def _between(docs: DataFrame, rest: DataFrame, regs: DataFrame, percent: int, stash: Stash) -> DataFrame:
    """Links between components inside open band groups (key, band, id, component)."""
    block = ("key", "one", "two")
    # dealt after each join: a broadcast or a split of skewed partitions would leave a block's rows in several tasks
    sketched = _blocks(rest).join(regs, "id").select(*block, "side", "id", "component", "band", "registers").repartition(*block).sortWithinPartitions(*block)
    close = stash.put(sketched.mapInArrow(_near(percent), "key long, band int, id long").distinct(), "close")
    left = stash.put(rest.join(close, ["key", "band", "id"]), "left")
    few = stash.put(close.select("id").distinct(), "close-ids")
    sets = stash.put(_sets_of(docs, few), "close-sets")
    dealt = _blocks(left).join(sets, "id").select(*block, "side", "id", "component", "items").repartition(*block).sortWithinPartitions(*block)
    out = stash.put(dealt.mapInArrow(_compared(percent), "a long, b long").distinct(), "between")
    stash.drop("close", "left", "close-ids", "close-sets")
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents"), 85)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (similarity 0.8 or more), with all columns.

    Only ids move: documents that go are few enough to broadcast, or else joined. Of the rows of an id that repeats, one
    of each text stays (the one of the smallest hash over its columns), as different texts are different documents.
    """
    stash = Stash(spark)
    number = F.col("doc_id").cast("long")
    # an id goes if none of its rows stays
    gone = stash.put(deduplicated(docs, 80).groupBy(F.col("doc_id").alias("_gone")).agg(F.bool_or("kept").alias("kept")).where("not kept").select("_gone"), "gone")
    several = stash.put(docs.where("doc_id is not null").groupBy(number.alias("_id")).agg(F.count("*").alias("n")).where("n > 1").select("_id"), "several")
    few = lambda ids: F.broadcast(ids) if ids.count() <= FEW_IDS else ids
    left = docs.join(few(gone), number == F.col("_gone"), "left_anti")
    if several.isEmpty():
        return left
    several = few(several)
    once = left.join(several, number == F.col("_id"), "left_anti")
    rank = F.row_number().over(Window.partitionBy("doc_id", F.xxhash64("text")).orderBy(F.xxhash64(*docs.columns)))
    more = left.join(several, number == F.col("_id"), "left_semi").select(F.struct(*docs.columns).alias("row"), "doc_id", "text", rank.alias("rank"))
    return once.unionByName(more.where("rank = 1").select("row.*"))
