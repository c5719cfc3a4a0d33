"""Benchmark decontamination by winnowing, in DataFrame expressions only.

Words are lower-cased runs of letters, digits and all beyond ASCII. Each run of ``GRAM`` words is hashed, and of every
``SPAN - GRAM + 1`` neighbouring hashes the smallest is kept (of equal ones the rightmost). A run of ``SPAN`` words that
a document shares with a benchmark item holds that many hashes, so both keep the same one at the same place: every
shared run of ``SPAN`` words has a common fingerprint. Items of fewer words have one window, the whole item, found by
its longest word.

Documents are read once. Their fingerprints are first looked up in a literal table of the items' (``SLOTS`` bytes a
window), then those that are left, with the words around them, are joined to a broadcast of the items' fingerprints
(hash, length, offset: at most one a window). Both are bounded by ``BLOCK_BYTES`` of item windows: larger benchmarks are taken
in blocks. What is left is extended to the windows around it and compared with the items' windows by their words, so
hashes never decide. Windows of equal words are one row whatever the number of items that hold them; only documents'
found windows meet the items. Texts are never shuffled.

Defined cases: null and empty texts have no words; a null item id makes hits but is not listed; items whose ids repeat
are listed once; repeated rows of documents each get their row, rows that share an id but not the text are told apart;
empty tables on either side give no hits, or no rows; other columns are ignored; a document's hits are held together, as
its text is.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm.common import Stash, table

SPAN, GRAM = 10, 5
#: Bytes of distinct item windows whose fingerprints are broadcast at once.
BLOCK_BYTES = 32 << 20
#: Rows of (window, item) that may be broadcast.
ITEM_ROWS = 1 << 20
#: Bytes of the table for each item window; of other fingerprints fewer than one in ``SLOTS`` pass it.
SLOTS = 16
#: Everything in ASCII but digits and letters ends a word; after lower-casing no A-Z is left.
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ENDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Places take the low bits of a fingerprint, from the top down, so that of equal hashes the rightmost is smallest.
_PLACE = (1 << 31) - 1


def words_of(text: Column) -> Column:
    """The words of a text, in order; none for null. ASCII texts are lower-cased as a whole, others letter by letter."""
    text = F.coalesce(text, F.lit(""))
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.array_remove(F.split(low, _ENDS), "")


def _hashed(rows: DataFrame) -> DataFrame:
    """With the number of words and the hash of each."""
    return rows.select("*", F.size("words").alias("n"), F.transform("words", lambda w: F.xxhash64(w)).alias("h"))


def _numbers(first: int, last: Column) -> Column:
    """``first`` up to ``last``; none where that is less."""
    return F.when(last >= first, F.sequence(F.lit(first), last)).otherwise(F.array().cast("array<int>"))


def _grams(n: Column, h: Column, gram: int) -> Column:
    """Fingerprints of all runs of ``gram`` words: 33 bits of hash, then the place."""
    run = lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(gram)))
    return F.transform(_numbers(0, n - gram), lambda i: F.shiftleft(run(i), 31) + (F.lit(_PLACE).cast("long") - i))


def _least(grams: Column, i: Column, many: int) -> Column:
    return F.least(*(F.get(grams, i + j) for j in range(many))) if many > 1 else F.get(grams, i)


def _hash(print_: Column) -> Column:
    return F.shiftright(print_, 31)


def _place(print_: Column) -> Column:
    return (F.lit(_PLACE).cast("long") - print_.bitwiseAND(F.lit(_PLACE).cast("long"))).cast("int")


def item_windows(items: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """item_id, window (its words), the hash by which it is found, the length in words, and the offset of what is
    hashed from the window's start. One row for each place of an item."""
    many = span - gram + 1
    own = _hashed(items.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("words"))).where("n > 0")
    own = own.withColumn("grams", _grams(F.col("n"), F.col("h"), gram))
    wide = own.where(F.col("n") >= span).select("item_id", "words", "grams", F.explode(F.sequence(F.lit(0), F.col("n") - span)).alias("at"))
    print_ = _least(F.col("grams"), F.col("at"), many)
    wide = wide.select("item_id", F.array_join(F.slice("words", F.col("at") + 1, span), " ").alias("window"), _hash(print_).alias("hash"), F.lit(span).alias("length"), (_place(print_) - F.col("at")).alias("offset"))
    longest = F.array_max(F.transform("words", lambda w, i: F.struct(F.length(w).alias("size"), (-i).alias("at"))))
    short = own.where(F.col("n") < span).withColumn("offset", -longest["at"])
    short = short.select("item_id", F.array_join("words", " ").alias("window"), F.get("h", F.col("offset")).alias("hash"), F.col("n").alias("length"), "offset")
    return wide.unionByName(short)


def _known(windows: DataFrame, count: int) -> bytes:
    """A byte table with ones at the windows' hashes, for one block of windows."""
    size = 1 << max(10, (count * SLOTS).bit_length())
    out = bytearray(size)
    for row in windows.select("hash").distinct().toLocalIterator():
        out[row["hash"] & (size - 1)] = 1
    return bytes(out)


def _prints(span: int, gram: int, short: bool, slots: bytes) -> Column:
    """A document's fingerprints that the table ``slots`` has, with the words around them: hash, place, the number of the
    first word around, the words. ``short``: whether there are items that are found by one word."""
    n, h, grams, own = F.col("n"), F.col("h"), F.col("grams"), F.col("words")
    many = span - gram + 1
    in_table = F.lit(slots)

    def known(x: Column) -> Column:
        return F.substr(in_table, x.bitwiseAND(F.lit(len(slots) - 1).cast("long")).cast("int") + 1, F.lit(1)) == F.lit(b"\x01")

    def around(hashed: Column, place: Column, before: int, words: int) -> Column:
        first = F.greatest(place - before, F.lit(0))
        return F.struct(hashed.alias("hash"), place.alias("place"), first.alias("first"), F.array_join(F.slice(own, first + 1, words), " ").alias("around"))

    kept = F.array_distinct(F.transform(_numbers(0, n - span), lambda i: _least(grams, i, many)))
    kept = F.filter(kept, lambda x: known(_hash(x)))
    out = F.transform(kept, lambda x: around(_hash(x), _place(x), many - 1, 2 * span - gram))
    if not short:
        return out
    places = F.filter(_numbers(0, n - 1), lambda i: known(F.get(h, i)))
    return F.concat(out, F.transform(places, lambda i: around(F.get(h, i), i, span - 2, 2 * span - 3)))


def hits(documents: DataFrame, items: DataFrame, stash: Stash, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, hits (distinct windows as word numbers [start, end), in order), n_hit (words inside any), and
    items (ids as strings, in order) of each document."""
    found = stash.put(item_windows(items, span, gram), "item-windows")
    distinct = found.groupBy("window").agg(F.first("hash").alias("hash"), F.first("length").alias("length"), F.first("offset").alias("offset"))
    windows = stash.put(distinct.withColumn("number", F.monotonically_increasing_id()), "windows")
    held = stash.put(found.where("item_id is not null").select("window", "item_id").distinct().join(windows.select("window", "number"), "window").select("number", "item_id"), "window-items")
    size = windows.agg(F.count("*").alias("windows"), F.coalesce(F.sum(F.octet_length("window") + 64), F.lit(0)).alias("bytes"), F.coalesce(F.bool_or(F.col("length") < span), F.lit(False)).alias("short")).collect()[0]

    text = F.coalesce(F.col("text"), F.lit(""))
    own = documents.select("doc_id", F.struct(F.xxhash64(text).alias("a"), F.octet_length(text).alias("b")).alias("key"), words_of(F.col("text")).alias("words"))
    own = _hashed(own)
    own = own.withColumn("grams", _grams(F.col("n"), F.col("h"), gram))
    # the first entry stands for the document itself
    none = F.struct(F.lit(None).cast("long").alias("hash"), F.lit(None).cast("int").alias("place"), F.lit(None).cast("int").alias("first"), F.lit(None).cast("string").alias("around"))
    blocks = max(1, -(-int(size["bytes"]) // BLOCK_BYTES))
    pieces = []
    for block in range(blocks):
        some = windows.where(F.pmod(F.xxhash64("window"), F.lit(blocks)) == block)
        prints = _prints(span, gram, size["short"], _known(some, size["windows"] // blocks))
        prints = F.concat(F.array(none), prints) if block == 0 else prints
        rows = own.select("doc_id", "key", "n", F.inline(prints))
        anchors = some.select("hash", "length", "offset").distinct()
        rows = rows.join(F.broadcast(anchors), "hash", "left").where("hash is null or length is not null")
        start = F.col("place") - F.col("offset")
        inside = F.slice(F.split("around", " "), F.greatest(start - F.col("first"), F.lit(0)) + 1, F.greatest("length", F.lit(1)))
        fits = (start >= 0) & (start + F.col("length") <= F.col("n"))
        rows = rows.where(F.col("hash").isNull() | fits).select("doc_id", "key", "n", start.alias("start"), (start + F.col("length")).alias("end"), F.when(F.col("hash").isNotNull(), F.array_join(inside, " ")).alias("window"))
        rows = rows.join(F.broadcast(some.select("window", "number")), "window", "left").where("window is null or number is not null")
        pieces.append(rows.select("doc_id", "key", "n", "start", "end", "number"))
    rows = reduce(DataFrame.unionByName, pieces)
    place = F.when(F.col("number").isNotNull(), F.struct("start", "end"))
    whole = rows.groupBy("doc_id", "key").agg(
        F.max("n").cast("long").alias("n_words"), F.count_if(F.col("number").isNull()).alias("copies"), F.sort_array(F.collect_set(place)).alias("hits"), F.collect_set("number").alias("numbers")
    )
    covered = F.aggregate(
        "hits",
        F.struct(F.lit(0).cast("long").alias("hit"), F.lit(0).alias("upto")),
        lambda s, x: F.struct((s["hit"] + F.greatest(x["end"] - F.greatest(x["start"], s["upto"]), F.lit(0))).alias("hit"), F.greatest(s["upto"], x["end"]).alias("upto")),
        lambda s: s["hit"],
    )
    whole = whole.select("doc_id", "key", "n_words", "copies", "hits", covered.alias("n_hit"), F.explode_outer("numbers").alias("number"))
    few = held.count() <= ITEM_ROWS
    whole = whole.join(F.broadcast(held) if few else held, "number", "left")
    one = lambda c: F.first(c).alias(c)
    whole = whole.groupBy("doc_id", "key").agg(one("n_words"), one("copies"), one("hits"), one("n_hit"), F.sort_array(F.collect_set("item_id")).alias("items"))
    return whole.select("doc_id", "n_words", "hits", "n_hit", "items", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("_copy")).drop("_copy")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns."""
    rows = hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), Stash(spark))
    return rows.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
#: Every window of the documents against every window of the items, by their words.
ORACLE = f"""
WITH b AS (SELECT cast(item_id AS varchar) AS item_id, {_WORDS} AS ws FROM benchmark), iw AS (
  SELECT DISTINCT item_id, least(len(ws), {SPAN}) AS size, array_to_string(ws[i:i + least(len(ws), {SPAN}) - 1], ' ') AS win
  FROM b, unnest(range(1, greatest(len(ws) - {SPAN - 1}, 1) + 1)) AS t(i) WHERE len(ws) > 0
), d AS (SELECT doc_id, {_WORDS} AS ws FROM documents), dw AS (
  SELECT doc_id, i, size, array_to_string(ws[i:i + size - 1], ' ') AS win
  FROM d, (SELECT DISTINCT size FROM iw) z, unnest(range(1, greatest(len(ws) - size + 1, 0) + 1)) AS t(i)
), h AS (
  SELECT doc_id, i, dw.size, item_id FROM dw JOIN iw ON iw.win = dw.win AND iw.size = dw.size
), p AS (
  SELECT doc_id, count(DISTINCT j) AS n FROM h, unnest(range(i, i + size)) AS t(j) GROUP BY doc_id
), s AS (
  SELECT doc_id, count(DISTINCT item_id) AS n, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM h GROUP BY doc_id
)
SELECT d.doc_id, cast(len(ws) AS bigint) AS n_words, coalesce(p.n, 0) AS n_hit, coalesce(s.n, 0) AS n_items, sha256(coalesce(s.ids, '')) AS items_sha256, coalesce(p.n, 0) > 0 AS contaminated
FROM d LEFT JOIN p ON p.doc_id = d.doc_id LEFT JOIN s ON s.doc_id = d.doc_id
"""
