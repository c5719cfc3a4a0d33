"""A persistent index for literal, case-insensitive search: posting lists of three-character runs.

Rows are added in segments. A segment holds

* ``rows``: the rows in order of their keys, in small Parquet pages, so that a lookup of few keys reads few pages;
* ``postings``: for each run of three characters (gram) and bucket of keys the sorted keys of the rows that hold it. A
  bucket has about ``BUCKET`` rows, so no list grows with the table. Lists lie in ``PARTS`` folders by the gram's hash,
  sorted by gram, so a lookup of a gram reads one folder and few of its row groups;
* a line in ``segments``, written last: a segment without it doesn't count, so a failed write leaves no trace.

A search reads the counts of its grams, takes the ``GRAMS`` rarest, intersects their lists bucket by bucket, rarest
first, and checks the literal text of the rows that are left. So hashes and grams never decide. Where few rows are left
(``FETCH``) they are read by ranges of keys that reach the scan; more of them are joined by key. Every field is followed
by two marks, so each of its characters begins a gram, and a query of one or two characters finds the grams that begin
with it.

A row that is added again replaces the one of its key in earlier segments. Rows without a key are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from parlance.operators.predicates import keyword

#: Rows of a bucket, folders of posting lists, grams of a query that are intersected.
BUCKET, PARTS, GRAMS = 1 << 16, 32, 4
#: Rows that are read by ranges of their keys, and ranges at most.
FETCH, RANGES = 4096, 200
#: Bytes of text that a page of rows is meant to hold, and lists in a page of postings.
PAGE, LISTS = 4096, 16
#: Bytes of text whose lists are made at once; one longer text makes a longer chunk of its own.
CHUNK = 4 << 20
#: What keeps lookups small: no dictionaries, which are read as a whole; keys as differences; short bounds of pages;
#: pages that are cut as soon as they are full.
_LAYOUT = {"parquet.enable.dictionary": "false", "parquet.writer.version": "PARQUET_2_0", "parquet.columnindex.truncate.length": "8", "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "16", "parquet.block.size": str(32 << 20)}
_MARK = "\x00"
_KEY, _SEGMENT = "__key", "__segment"


def message_fields() -> list[Column]:
    """What a keyword is looked for in: content, file names, embeds and the author's names; arrays as one text each."""
    many = lambda items, name: F.array_join(F.transform(F.col(items), lambda x: x[name]), _MARK * 2)
    return [F.col("content"), many("attachments", "filename"), many("embeds", "title"), many("embeds", "description"), F.col("author.username"), F.col("author.globalName")]


def grams_of(text: str) -> list[str]:
    """The runs of three characters of a query, each once."""
    return list(dict.fromkeys(text[i : i + 3] for i in range(len(text) - 2)))


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys by gram and bucket of a few rows at a time (key, bucket, text): each key once a row's distinct gram."""
    for batch in batches:
        column = batch.column(2).cast(pa.large_binary())
        size = np.diff(np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, 8 * column.offset)) if len(column) else np.zeros(0, np.int64)
        group = np.cumsum(size) // CHUNK
        edges = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(size)]]).tolist()
        for first, last in zip(edges[:-1], edges[1:], strict=True):
            if first < last:
                yield _listed(batch.column(0).slice(first, last - first), batch.column(1).slice(first, last - first).to_numpy(), column.slice(first, last - first))


def _listed(keys: pa.Array, bucket: np.ndarray, column: pa.Array) -> pa.RecordBatch:
    order = np.argsort(bucket, kind="stable")
    own = [x.decode("utf-8", "replace") for x in column.take(pa.array(order)).to_pylist()]
    chars = np.frombuffer("".join(own).encode("utf-32-le"), "<u4")
    row = np.repeat(np.arange(len(own)), np.array([len(x) for x in own], np.int64))
    used = np.zeros(0x110000, bool)
    used[chars] = True
    letters = np.flatnonzero(used)
    rank = (np.cumsum(used) - 1)[chars]  # numbers of characters, so that a gram and a row fit into 64 bits
    base = max(1, len(letters))
    gram = ((rank[:-2] * base + rank[1:-1]) * base + rank[2:])[row[:-2] == row[2:]]
    row = row[:-2][row[:-2] == row[2:]]
    kinds = None
    if base**3 * len(own) >= 1 << 62:
        kinds, gram = np.unique(gram, return_inverse=True)
    gram, row = np.divmod(np.unique(gram * len(own) + row), len(own))
    at = bucket[order][row]
    begins = np.flatnonzero(np.concatenate([[True], (gram[1:] != gram[:-1]) | (at[1:] != at[:-1])])) if len(gram) else np.zeros(0, np.int64)
    number, which = np.unique(gram[begins], return_inverse=True)
    number = number if kinds is None else kinds[number]
    spelled = letters[np.stack([number // (base * base), number // base % base, number % base], 1)].astype("<u4").tobytes().decode("utf-32-le")
    grams = pa.array([spelled[i : i + 3] for i in range(0, len(spelled), 3)], pa.string())
    lists = pa.ListArray.from_arrays(pa.array(np.append(begins, len(gram)), pa.int32()), keys.take(pa.array(order[row])))
    return pa.RecordBatch.from_arrays([grams.take(pa.array(which)), pa.array(at[begins], pa.int32()), lists], ["gram", "bucket", "keys"])


class TextIndex:
    """``fields``: the texts that are searched, over rows as they are added; ``literal``: the check of a row against a
    query, which has to hold only where a field has the query in it, whatever the case."""

    def __init__(self, spark: SparkSession, path: str, key: str = "id", fields: Callable[[], list[Column]] = message_fields, literal: Callable[[str], Column] = keyword):
        self.spark, self.path, self.key, self.fields, self.literal = spark, path.rstrip("/"), key, fields, literal

    def segments(self) -> list[tuple[int, int]]:
        """Number and buckets of each complete segment."""
        table = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/segments")
        if not table.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(table):
            return []
        rows = self.spark.read.schema("segment int, buckets int").parquet(f"{self.path}/segments").collect()
        return sorted((r["segment"], r["buckets"]) for r in rows)

    def add(self, rows: DataFrame) -> int:
        """A further segment; its number."""
        number = max((s for s, _ in self.segments()), default=-1) + 1
        own = rows.where(F.col(self.key).isNotNull())
        text = F.lower(F.concat(*(F.concat(F.coalesce(f.cast("string"), F.lit("")), F.lit(_MARK * 2)) for f in self.fields())))
        size = own.agg(F.count("*").alias("n"), F.coalesce(F.avg(F.octet_length(text)), F.lit(1.0)).alias("bytes")).collect()[0]
        buckets = max(1, -(-size["n"] // BUCKET))
        page = max(1, int(PAGE // max(size["bytes"], 1)))
        width = max(1, int(size["n"] * size["bytes"]) >> 27)
        ordered = own.repartitionByRange(width, self.key).sortWithinPartitions(self.key)
        ordered.write.options(**_LAYOUT).option("parquet.page.row.count.limit", page).mode("overwrite").parquet(f"{self.path}/rows/segment={number}")
        bucket = F.pmod(F.xxhash64(self.key), F.lit(buckets)).cast("int")
        found = own.select(F.col(self.key).alias(_KEY), bucket.alias("bucket"), text.alias("text"))
        some = found.mapInArrow(_lists, StructType([StructField("gram", StringType()), StructField("bucket", IntegerType()), StructField("keys", ArrayType(found.schema[_KEY].dataType))]))
        lists = some.groupBy("gram", "bucket").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("keys")))).alias("keys"))
        lists = lists.select("gram", "bucket", F.size("keys").cast("long").alias("n"), "keys", F.pmod(F.xxhash64("gram"), F.lit(PARTS)).cast("int").alias("part"))
        lists = lists.repartition("part").sortWithinPartitions("part", "gram", "bucket")
        lists.write.options(**_LAYOUT).option("parquet.page.row.count.limit", LISTS).mode("overwrite").partitionBy("part").parquet(f"{self.path}/postings/segment={number}")
        self.spark.range(1).select(F.lit(number).cast("int").alias("segment"), F.lit(buckets).cast("int").alias("buckets")).coalesce(1).write.mode("append").parquet(f"{self.path}/segments")
        return number

    def _read(self, table: str) -> DataFrame:
        done = [s for s, _ in self.segments()]
        return self.spark.read.option("basePath", f"{self.path}/{table}").parquet(*(f"{self.path}/{table}/segment={s}" for s in done)).withColumnRenamed("segment", _SEGMENT)

    def rows(self) -> DataFrame:
        """All rows, as last added."""
        return self._newest(self._read("rows"))

    def _newest(self, rows: DataFrame) -> DataFrame:
        if len(self.segments()) > 1:
            last = rows.groupBy(F.col(self.key).alias(_KEY)).agg(F.max(_SEGMENT).alias("_last"))
            rows = rows.join(last, (F.col(self.key) == F.col(_KEY)) & (F.col(_SEGMENT) == F.col("_last"))).drop(_KEY, "_last")
        return rows.drop(_SEGMENT)

    def candidates(self, query: str) -> DataFrame:
        """Keys (column ``__key``, each once a segment) of all rows that may hold a query of any length but none."""
        q = query.strip().lower()
        lists = self._read("postings")
        if len(q) < 3:
            return lists.where(F.col("gram").startswith(q)).select(F.explode("keys").alias(_KEY)).distinct()
        wanted = grams_of(q)
        parts = self.spark.createDataFrame([(g,) for g in wanted], "gram string").select("gram", F.pmod(F.xxhash64("gram"), F.lit(PARTS)).cast("int").alias("part")).collect()
        part = {r["gram"]: r["part"] for r in parts}
        some = lists.where(F.col("part").isin(sorted(set(part.values()))) & F.col("gram").isin(wanted))
        counts = {r["gram"]: r["n"] for r in some.groupBy("gram").agg(F.sum("n").alias("n")).collect()}
        if len(counts) < len(wanted):  # a gram that no row has
            return lists.where(F.lit(False)).select(F.explode("keys").alias(_KEY))
        rarest = sorted(wanted, key=lambda g: (counts[g], g))[:GRAMS]
        own = [lists.where((F.col("part") == part[g]) & (F.col("gram") == g)).select(_SEGMENT, "bucket", F.col("keys").alias(f"keys{i}")) for i, g in enumerate(rarest)]
        met = reduce(lambda a, b: a.join(b, [_SEGMENT, "bucket"]), own)
        return met.select(F.explode(reduce(F.array_intersect, [F.col(f"keys{i}") for i in range(len(own))])).alias(_KEY)).distinct()

    def matching(self, query: str | None) -> DataFrame:
        """The rows that hold a query; all rows for an empty one."""
        if not (query or "").strip() or not self.segments():
            return self.rows()
        found = self.candidates(query)
        few = found.limit(FETCH + 1).collect()
        rows = self._read("rows")
        if len(few) <= FETCH:
            keys = sorted(r[_KEY] for r in few)
            rows = rows.where(self._near(keys) if keys else F.lit(False))
        else:
            rows = rows.join(found, F.col(self.key) == F.col(_KEY), "left_semi")
        return self._newest(rows).where(self.literal(query))

    def _near(self, keys: list) -> Column:
        """Ranges of keys, ``RANGES`` at most, that hold all ``keys`` and as few others as may be: neighbours meet where
        the gap between them is small. Keys that are no numbers are cut into even runs."""
        cuts = range(1, len(keys))
        if len(keys) > RANGES:
            if isinstance(keys[0], int):
                cuts = sorted(sorted(cuts, key=lambda i: keys[i - 1] - keys[i])[: RANGES - 1])
            else:
                cuts = [len(keys) * i // RANGES for i in range(1, RANGES)]
        edges = [0, *cuts, len(keys)]
        tests = [(F.col(self.key) >= keys[a]) & (F.col(self.key) <= keys[b - 1]) if b - a > 1 else F.col(self.key) == keys[a] for a, b in zip(edges[:-1], edges[1:], strict=True)]
        while len(tests) > 1:  # a balanced tree of alternatives
            tests = [tests[i] | tests[i + 1] if i + 1 < len(tests) else tests[i] for i in range(0, len(tests), 2)]
        return tests[0]
