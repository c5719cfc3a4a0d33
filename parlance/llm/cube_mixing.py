"""Mixing sources to target weights by the cube method of balanced sampling.

Each source's share of all words is set by weight, at most ``MOST`` times its own words (the excess is reshared). A
document is taken ``floor(m)`` times for ``m = target / source size``, and once more with inclusion probability
``m - floor(m)``. Which documents those are is decided by the cube method: probabilities walk through the null space of
the balancing constraints (the number of documents and of words, per source) until they are 0 or 1, so that both totals
stay as they are. The walk runs in groups of a source's documents, dealt by a hash of the id; each group
leaves ``LEFT`` open probabilities, which meet in the next level's groups (``GROUPS`` documents each). After these
levels the landing problem of each source is one small group: it walks on until ``LEFT`` documents are open, and of all
ways to round those the one with the smallest error in words, then in documents, is taken. All choices are hashed, so
reruns agree.

Units are ids: repeated rows of an id (within a source) are taken equally often. Defined cases: null text has size 0; a
null source is a source of its own, last in order; a null id is one unit per source; an empty table gives an empty
result; sources of no words have target 0; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parlance.llm.common import Stash, size_column, table

#: Fixed values of the mix: weights of the sources by code point, repeating, and the most often that a source repeats.
WEIGHTS = (5, 2, 1)
MOST = 3
#: Units of a group at each level before the landing (their number grows with the source), and units left open by each.
GROUPS, LEFT = (512, 4096, 4096), 14
_OPEN = 1e-9


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words) of each row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size_column("text").alias("size"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source, source_size, target. One row a source meets in the windows.

    Sources in order of ``cap / weight`` reach their caps first, as the level of words per weight rises; the level is
    what is left of all words for the weight that is left, at the first source that it doesn't fill.
    """
    own = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights)).cast("int") + 1).cast("double")
    own = own.withColumn("weight", weight).withColumn("cap", F.col("source_size").cast("double") * MOST).withColumn("full_at", F.col("cap") / F.col("weight"))
    order = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    own = own.withColumn("level", level)
    final = F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "level"))).over(everything)["level"]
    return own.withColumn("final", final).select("source", "source_size", F.least("cap", F.coalesce(F.col("final") * F.col("weight"), F.col("cap"))).alias("target"))


def _draw(seed: int) -> float:
    """A number in [0, 1) from a seed, evenly spread."""
    x = (seed * 0x9E3779B97F4A7C15 + 0xD1B54A32D192ED03) & 0xFFFFFFFFFFFFFFFF
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & 0xFFFFFFFFFFFFFFFF
    return ((x ^ (x >> 31)) >> 11) / 2**53


def walk(chance: list[float], size: list[float], seed: int) -> list[float]:
    """Moves chances through the null space of (1, size) until at most LEFT are open: the first ones stay as they are,
    and at most two of the others.

    Three open units always have a move that keeps both totals; its two longest steps are drawn so that each unit's
    expected chance stays as it is.
    """
    chance = list(chance)
    held: list[int] = []
    waiting = LEFT - 2
    for i, p in enumerate(chance):
        if not _OPEN < p < 1 - _OPEN:
            chance[i] = float(round(p))
            continue
        if waiting:
            waiting -= 1
            continue
        held.append(i)
        if len(held) < 3:
            continue
        a, b, c = (size[k] for k in held)
        move = (c - b, a - c, b - a) if a != b or b != c else (1.0, -1.0, 0.0)
        up = min(((1 - chance[k]) / m if m > 0 else -chance[k] / m) for k, m in zip(held, move, strict=True) if m)
        down = min((chance[k] / m if m > 0 else (chance[k] - 1) / m) for k, m in zip(held, move, strict=True) if m)
        seed += 1
        step = up if _draw(seed) * (up + down) < down else -down
        kept = []
        for k, m in zip(held, move, strict=True):
            chance[k] = min(1.0, max(0.0, chance[k] + step * m))
            if _OPEN < chance[k] < 1 - _OPEN:
                kept.append(k)
            else:
                chance[k] = float(round(chance[k]))
        held = kept
    return chance


def land(chance: list[float], size: list[float], seed: int) -> list[float]:
    """Rounds what a walk leaves open, by the smallest error in words, then in documents."""
    chance = walk(chance, size, seed)
    left = [i for i, p in enumerate(chance) if 0 < p < 1]
    ways = (np.arange(1 << len(left))[:, None] >> np.arange(len(left)) & 1).astype(float)
    p, w = np.array([chance[i] for i in left]), np.array([size[i] for i in left])
    off = np.abs((ways - p) @ w) if left else np.zeros(1)
    best = np.lexsort((np.abs((ways - p).sum(1)), np.round(off, 6)))[0]
    for j, i in enumerate(left):
        chance[i] = float(ways[best, j])
    return chance


def _flight(level: int):
    move = land if level == len(GROUPS) else walk

    def fly(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["place", "doc_id", "size"], kind="stable")
        seed = int(frame["place"].iloc[0]) * 31 + level * 1_000_003 + int(frame["group"].iloc[0])
        return frame.assign(chance=move(frame["chance"].tolist(), frame["size"].astype(float).tolist(), seed)).drop(columns=["group"])

    return fly


def copies(sizes: DataFrame, stash: Stash, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """doc_id, source, source_size, target, copies of each unit (doc_id, source)."""
    goal = stash.put(targets(sizes, weights), "targets")
    units = sizes.groupBy("doc_id", "source").agg(F.sum("size").alias("size"))
    same = F.col("u.source").eqNullSafe(F.col("g.source"))
    counts = units.groupBy("source").agg(F.count("*").alias("units"))
    goal = stash.put(goal.alias("u").join(counts.alias("g"), same).select("u.*", "units"), "goals")
    often = F.least(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)), F.lit(float(MOST)))
    rows = units.alias("u").join(goal.alias("g"), same).select("u.*", "source_size", "target", "units", often.alias("often"))
    chance = F.col("often") - F.floor("often")
    chance = F.when(chance > 1 - _OPEN, 1.0).when(chance < _OPEN, 0.0).otherwise(chance)
    rows = rows.withColumn("whole", F.floor("often").cast("int")).withColumn("chance", chance).withColumn("place", F.xxhash64("doc_id", "source")).drop("often")
    schema = rows.schema
    left, done = rows, []
    share = 1.0  # of the units that are still open, at most (but LEFT for each group)
    for level in range(len(GROUPS) + 1):
        n = F.lit(1) if level == len(GROUPS) else F.greatest(F.lit(1), F.ceil(F.col("units") * share / GROUPS[level]))
        dealt = left.withColumn("group", F.pmod(F.xxhash64("place", F.lit(level)), n.cast("long")))
        flown = stash.put(dealt.groupBy("source", "group").applyInPandas(_flight(level), schema), f"level-{level}")
        closed = F.col("chance").isin(0.0, 1.0)
        done.append(flown.where(closed))
        left = flown.where(~closed)
        share *= LEFT / GROUPS[min(level, len(GROUPS) - 1)]
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("doc_id", "source", "source_size", "target", (F.col("whole") + F.col("chance")).cast("int").alias("copies"))


def mixed(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken (words, repeats counted) of each row."""
    stash = Stash(docs.sparkSession)
    sizes = stash.put(sized(docs), "sizes")
    often = copies(sizes, stash)
    same = F.col("s.doc_id").eqNullSafe(F.col("c.doc_id")) & F.col("s.source").eqNullSafe(F.col("c.source"))
    return sizes.alias("s").join(often.alias("c"), same).select("s.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, with all its columns.

    Nearly every document has a row of copies, so these are never broadcast: texts are shuffled once, at any size.
    """
    stash = Stash(spark)
    often = stash.put(copies(stash.put(sized(docs), "sizes"), stash).where("copies > 0").select("doc_id", "source", "copies"), "copies")
    same = F.col("d.doc_id").cast("long").eqNullSafe(F.col("c.doc_id")) & F.col("d.source").eqNullSafe(F.col("c.source"))
    taken = docs.alias("d").join(often.hint("merge").alias("c"), same).select(F.struct("d.*").alias("row"), F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return taken.select("row.*")
