"""Document fingerprints: a homomorphic multiset hash over paragraphs (lines), in DataFrame expressions only.

Each paragraph is hashed to a wide vector, and a document's fingerprint is the sum of its paragraphs' vectors, lane by
lane, modulo a power of two. The order of paragraphs doesn't matter, and a paragraph is inserted into a stored
fingerprint, or deleted from it, by adding or subtracting its vector (``inserted``, ``deleted``). A vector has two parts:

* ``DENSE`` lanes modulo 2**32, from seeded hashes of the whole paragraph: they decide equality.
* ``SKETCH`` lanes: each word with the word before it in the paragraph adds 1 or -1 to one lane. The cosine of two
  such parts, in full, estimates how many of their word pairs two documents share: the likeness. They are printed
  modulo 2**16.

Documents meet the next ones by one shuffle of the texts into ranges of ids (``SLOTS`` a partition, cut at quantiles);
the highest document of each range is also sent to the range above it. All sums, and the likeness to the next
document, are found inside that shuffle's partitions; the lines that a document and its edited text share are hashed
once. Rows whose ids repeat, or are null, are counted by text first and take their own way, so a hot id is combined
before it moves.

Defined cases: null text counts as empty; an empty text has no paragraphs and a zero fingerprint, alike (1.0) only to
another one; repeated rows each get their row, and where ids repeat the next document is the one of the next id whose
text has the smallest SHA-256; the next document of a row without an id is empty; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parlance.llm.common import Stash, partitions, table

DENSE, SKETCH = 16, 128
#: Ranges of ids for each shuffle partition.
SLOTS = 8
#: Repeated ids (8 bytes each) that are broadcast at most; beyond that both sides are shuffled.
FEW_IDS = 2_000_000
_SPACES = r"[\x20\x09-\x0D]+"
_MOD = 1 << 32
#: A code is lane << 36, whose sum it belongs to << 34, value + 1.
OWN, EDITED, BOTH = 0, 1, 2


def dense_vector(paragraph: Column) -> Column:
    """The dense lanes of one paragraph."""
    seeded = F.transform(F.sequence(F.lit(0), F.lit(DENSE // 2 - 1)), lambda i: F.xxhash64(i, paragraph))
    return F.flatten(F.transform(seeded, lambda h: F.array(h.bitwiseAND(_MOD - 1), F.shiftrightunsigned(h, 32))))


def dense_sum(paragraphs: Column) -> Column:
    """The sum of the dense lanes over paragraphs."""
    zero = F.array_repeat(F.lit(0).cast("long"), DENSE)
    return F.aggregate(paragraphs, zero, lambda total, p: F.zip_with(total, dense_vector(p), lambda a, b: (a + b) % _MOD))


def _code(lane: Column, whose: int, value: Column) -> Column:
    return F.shiftleft(lane.cast("long"), 36) + F.lit((whose << 34) + 1) + value


def _pairs(paragraph: Column, whose: int) -> Column:
    """A code for each word of a paragraph with the word before it, and a null."""
    own = F.split(paragraph, _SPACES)

    def code(word: Column, before: Column) -> Column:
        h = F.xxhash64(before, word)
        return F.when(word.isNotNull(), _code(h.bitwiseAND(SKETCH - 1), whose, F.shiftright(h, 20).bitwiseAND(1) * 2 - 1))

    return F.zip_with(own, F.concat(F.array(F.lit("")), own), code)


def codes(paragraphs: Column, whose: int) -> Column:
    """All that paragraphs add to the lanes of a sum."""
    dense = F.transform(dense_sum(paragraphs), lambda x, i: _code(i + SKETCH, whose, x))
    return F.concat(F.flatten(F.transform(paragraphs, lambda p: _pairs(p, whose))), dense)


def lines(text: Column) -> Column:
    """The paragraphs of a text, none of an empty one."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, "\n"))


def vectors(rows: DataFrame, *keys: str) -> DataFrame:
    """keys, n_chars, edited_sha, dense, sketch, edited_dense, edited_sketch of rows (keys, text, head).

    The edited text is the text with its last half replaced by as much of ``head``. Keys are distinct, and nothing is
    shuffled where rows are dealt by some of them already.
    """
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    none = F.array().cast("array<string>")
    cut = rows.select(*keys, "text", n.alias("n"), F.col("text").substr(F.lit(1), n - half).alias("kept"), F.coalesce(F.col("head").substr(F.lit(1), half), F.lit("")).alias("head"))
    # whole lines before the cut are in both texts; the rest of each text follows them
    cut = cut.withColumn("tail", F.substring_index("kept", "\n", -1)).withColumn("upto", F.char_length("kept") - F.char_length("tail"))
    common = F.when(F.col("upto") > 0, F.split(F.col("kept").substr(F.lit(1), F.col("upto") - 1), "\n")).otherwise(none)
    rest = F.when(F.col("n") == 0, none).otherwise(F.split(F.col("text").substr(F.col("upto") + 1, F.col("n")), "\n"))
    edited_rest = F.when((F.col("n") == 0) & (F.col("head") == ""), none).otherwise(F.split(F.concat("tail", "head"), "\n"))
    every = F.transform(F.sequence(F.lit(0), F.lit(SKETCH - 1)), lambda lane: _code(lane, OWN, F.lit(0)))  # so no lane is missing
    added = F.concat(every, codes(common, BOTH), codes(rest, OWN), codes(edited_rest, EDITED))
    # the hash is taken below the explode, once a row
    cut = cut.select(*keys, F.col("n").cast("long").alias("n_chars"), F.unhex(F.sha2(F.concat("kept", "head"), 256)).alias("edited_sha"), added.alias("codes"))
    keys = (*keys, "n_chars", "edited_sha")
    parts = cut.select(*keys, F.explode("codes").alias("code"))
    whose, value = F.shiftright("code", 34).bitwiseAND(3), F.col("code").bitwiseAND((1 << 34) - 1) - 1
    total = lambda other: F.sum(F.when(whose != other, value).otherwise(0))
    lanes = parts.where("code is not null").groupBy(*keys, F.shiftright("code", 36).alias("lane")).agg(total(EDITED).alias("own"), total(OWN).alias("edited"))
    lanes = lanes.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("lane", "own", "edited"))).alias("lanes"))
    dense = lambda x: F.transform(F.slice("lanes", SKETCH + 1, DENSE), lambda lane: F.pmod(lane[x], F.lit(_MOD)))
    sketch = lambda x: F.transform(F.slice("lanes", 1, SKETCH), lambda lane: lane[x].cast("int"))
    return lanes.select(*keys, dense("own").alias("dense"), sketch("own").alias("sketch"), dense("edited").alias("edited_dense"), sketch("edited").alias("edited_sketch"))


def cosine(a: Column, b: Column) -> Column:
    """Likeness of two sketches, 0 to 1; 0 if one is zero."""
    total = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("long") * q), F.lit(0).cast("long"), lambda s, v: s + v)
    norm = F.sqrt(total(a, a).cast("double") * total(b, b))
    return F.when(norm > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), total(a, b) / norm))).otherwise(F.lit(0.0))


def _hexed(lanes: Column, bits: int) -> Column:
    return F.array_join(F.transform(lanes, lambda x: F.lpad(F.lower(F.hex(F.pmod(x.cast("long"), F.lit(1 << bits)))), bits // 4, "0")), "")


def printed(dense: Column, sketch: Column) -> Column:
    return F.concat(_hexed(dense, 32), F.lit("-"), _hexed(sketch, 16))


def _lanes_of(fingerprint: Column) -> tuple[Column, Column]:
    """Dense and sketch lanes of a printed fingerprint."""

    def read(text: Column, width: int, count: int) -> Column:
        at = F.sequence(F.lit(0), F.lit(count - 1))
        return F.transform(at, lambda i: F.conv(text.substr(i * width + 1, F.lit(width)), 16, 10).cast("long"))

    return read(F.substring_index(fingerprint, "-", 1), 8, DENSE), read(F.substring_index(fingerprint, "-", -1), 4, SKETCH)


def _changed(fingerprint: Column, paragraph: Column, sign: int) -> Column:
    dense, sketch = _lanes_of(fingerprint)
    own = F.filter(_pairs(paragraph, OWN), lambda c: c.isNotNull())
    lane = lambda i: F.aggregate(F.filter(own, lambda c: F.shiftright(c, 36) == i), F.lit(0).cast("long"), lambda s, c: s + c.bitwiseAND((1 << 34) - 1) - 1)
    more = F.transform(F.sequence(F.lit(0), F.lit(SKETCH - 1)), lane)
    add = lambda a, b: a + b * sign
    return printed(F.zip_with(dense, dense_vector(paragraph), add), F.zip_with(sketch, more, add))


def inserted(fingerprint: Column, paragraph: Column) -> Column:
    """A printed fingerprint with one more paragraph."""
    return _changed(fingerprint, paragraph, 1)


def deleted(fingerprint: Column, paragraph: Column) -> Column:
    """A printed fingerprint without one of its paragraphs."""
    return _changed(fingerprint, paragraph, -1)


def _slot(identifier: Column, bounds: list[int]) -> Column:
    """How many bounds lie below an id: looked up among every ``step``-th bound, then in the run of bounds behind it."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    number = lambda values: F.expr(f"array({', '.join(f'{b}L' for b in values)})")
    below = lambda values: F.size(F.filter(values, lambda b: b < identifier))
    first = below(number(bounds[::step])) * step
    return F.when(first == 0, 0).otherwise(first - step + below(F.slice(number(bounds), first - step + 1, step)))


def _ranges(ids: DataFrame, count: int) -> tuple[list[int], list[tuple[int, int]], int]:
    """Bounds of ranges of ids, for the highest id of each range the range above it (above the last: the first), and how
    many ids are null."""
    cuts = [i / count for i in range(1, count)]
    found = ids.agg(F.percentile_approx("id", cuts, 20 * count).alias("q"), F.count_if(F.col("id").isNull()).alias("lost")).first()
    bounds, ids = sorted(set(found["q"] or [])), ids.where("id is not null")
    tops = sorted((r["slot"], r["top"]) for r in ids.groupBy(_slot(F.col("id"), bounds).alias("slot")).agg(F.max("id").alias("top")).collect())  # one row a range
    return bounds, [(top, tops[(i + 1) % len(tops)][0]) for i, (_, top) in enumerate(tops)], found["lost"]


def _results(rows: DataFrame) -> DataFrame:
    """Rows of the query from vectors and those of the next document (``other``; null: an empty one)."""
    alike = lambda d, v, e, w: F.when(d == e, F.lit(1.0)).otherwise(cosine(v, w))
    zero = F.array_repeat(F.lit(0).cast("long"), DENSE)
    return rows.select(
        F.col("id").alias("doc_id"),
        "n_chars",
        F.lower(F.hex("edited_sha")).alias("edited_sha256"),
        printed(F.col("dense"), F.col("sketch")).alias("fingerprint"),
        printed(F.col("edited_dense"), F.col("edited_sketch")).alias("edited_fingerprint"),
        alike(F.col("dense"), F.col("sketch"), F.col("edited_dense"), F.col("edited_sketch")).alias("near_edited"),
        F.when(F.col("other").isNull(), F.when(F.col("dense") == zero, 1.0).otherwise(0.0)).otherwise(alike(F.col("dense"), F.col("sketch"), F.col("other.dense"), F.col("other.sketch"))).alias("near_next"),
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next; see the module."""
    spark = docs.sparkSession
    stash = Stash(spark)
    n = partitions(spark)
    own = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    known = own.where("id is not null")
    repeated = stash.put(known.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"), "repeated")
    more = repeated.count()
    several = F.broadcast(repeated) if more <= FEW_IDS else repeated
    bounds, above, missing = _ranges(own.select("id"), SLOTS * n)
    length = F.char_length("text")
    rows = (known.join(several, "id", "left_anti") if more else known).select("id", "text", length.alias("longest"), F.lit(True).alias("single"))
    if more:
        least = known.join(several, "id", "left_semi").groupBy("id").agg(F.min(F.struct(F.unhex(F.sha2("text", 256)).alias("sha"), "text")).alias("first"), F.max(length).alias("longest"))
        rows = rows.unionByName(least.select("id", "first.text", "longest", F.lit(False).alias("single")))
    guests = F.broadcast(spark.createDataFrame(above, "id long, above int"))  # SLOTS rows a partition
    here = F.struct(_slot(F.col("id"), bounds).alias("slot"), F.lit(1).alias("place"))
    there = F.struct(F.col("above").alias("slot"), F.lit(0).alias("place"))
    dealt = rows.join(guests, "id", "left").select("id", "text", "longest", "single", F.explode(F.when(F.col("above").isNull(), F.array(here)).otherwise(F.array(here, there))).alias("at"))
    # dealt by number: what follows is several times as large as the texts, which AQE can't know when it merges partitions
    dealt = dealt.select("id", "text", "longest", "single", "at.slot", "at.place").repartition(n, "slot")
    order = Window.partitionBy("slot").orderBy("place", "id")
    next_text = F.lag("text").over(order)
    near = dealt.withColumn("head", next_text.substr(F.lit(1), F.floor(F.col("longest") / 2).cast("int")))
    near = near.withColumn("given", F.when(~F.col("single"), F.col("head")))
    made = vectors(near, "slot", "place", "id", "single", "given").withColumn("other", F.lag(F.struct("dense", "sketch")).over(order))
    out = _results(made.where("place = 1 and single"))
    if more:
        firsts = stash.put(made.where("place = 1 and not single").select("id", F.col("given").alias("head"), "other"), "firsts")
        counted = known.join(several, "id", "left_semi").groupBy("id", "text").agg(F.count("*").cast("int").alias("times"))
        headed = counted.join(firsts.select("id", "head"), "id").withColumn("key", F.unhex(F.sha2("text", 256)))
        again = vectors(headed.repartition(n, "id", "key"), "id", "key", "times").join(firsts.select("id", "other"), "id")
        out = out.unionByName(_results(again.withColumn("_", F.explode(F.sequence(F.lit(1), "times")))))
    if not missing:
        return out
    counted = own.where("id is null").groupBy("text").agg(F.count("*").cast("int").alias("times"))
    again = counted.select(F.lit(None).cast("long").alias("id"), "text", "times", F.lit("").alias("head"), F.unhex(F.sha2("text", 256)).alias("key")).repartition(n, "key")
    again = vectors(again, "id", "key", "times").withColumn("other", F.lit(None).cast("struct<dense:array<long>,sketch:array<int>>"))
    return out.unionByName(_results(again.withColumn("_", F.explode(F.sequence(F.lit(1), "times")))))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
