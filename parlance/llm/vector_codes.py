"""Vector code compression: product codes in integers, with segment-mean lower bounds before exact distances.

A vector's components become integers and are cut into ``PARTS`` equal consecutive parts; each part is written as the
index of the nearest of ``ENTRIES`` codebook entries. Entries are filtered from coarse to fine: for each block of a part
the difference of means and the difference of residual norms bound the squared distance from below,

    |x - c|^2 >= size * (mean x - mean c)^2 + (|residual x| - |residual c|)^2,

first with the whole part as one block, then with two and four. An entry goes only where its bound, less a margin for
rounding, is above the exact distance to the entry of the least coarse bound; what is left gets exact integer distances.
So the filter never changes a result (``assign`` is tested against plain distances).

Each round of ``fit`` is one Spark job over all vectors: tasks add up their parts by entry, and only these sums
(``PARTS * ENTRIES`` entries, whatever the table's size) come to the driver. Integers are written once, as bytes, to
the shared folder.

Defined cases: vectors that are null, or hold null or non-finite components, are dropped; a vector whose length differs
from the one of the smallest id takes no part, and has a null code and error; lengths that ``PARTS`` doesn't divide are
filled up with zeros; integers are held within the bound that keeps every squared distance in 64 bits (``bound``:
components up to 46340 for 64 of them); equal ids are ordered by the bytes of their integers, null ids come last; fewer
than ``ENTRIES`` vectors make as many entries; an empty table gives no rows; without a column ``label`` all labels are
null; other columns are ignored. Sums of errors that leave 64 bits are null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.llm.common import Stash, parts, table

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Blocks of a part, from coarse to fine.
BLOCKS = (1, 2, 4)
#: Relative margin for rounding of the bounds, far above the error of double precision.
MARGIN = 2.0**-40
#: Vectors that are looked at together.
ROWS = 2048
_MOST = np.iinfo(np.int64).max


@dataclass
class Codebooks:
    """``entries``: integers by part, entry and place in the part; ``dims``: the length of vectors."""

    entries: np.ndarray
    dims: int

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.reshape(-1).tolist())).encode()).hexdigest()


def bound(dims: int) -> int:
    """The largest integer component for which the squared distance of two vectors fits 64 bits."""
    return isqrt(_MOST // max(dims, 1)) // 2


def integers(column: pa.Array) -> tuple[np.ndarray, list[bytes]]:
    """Which rows of a column of lists are kept, and the kept ones' integers as little-endian 32-bit numbers."""
    column = column.cast(pa.large_list(pa.float64()))
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten()
    values = pc.fill_null(flat, np.nan).to_numpy(zero_copy_only=False)
    at = np.concatenate([[0], np.cumsum(lengths)])
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    keep = column.is_valid().to_numpy(zero_copy_only=False) & (bad[at[1:]] == bad[at[:-1]])
    out = []
    for i in np.flatnonzero(keep):
        most = bound(int(lengths[i]))
        out.append(np.clip(np.floor(values[at[i] : at[i + 1]] * SCALE), -most, most).astype("<i4").tobytes())
    return keep, out


def whole(vectors: DataFrame) -> DataFrame:
    """vec_id, label, dims and the integers (bytes) of all kept rows."""
    label = F.col("label") if "label" in vectors.columns else F.lit(None).cast("int").alias("label")
    own = vectors.select("vec_id", label, "embedding")
    schema = T.StructType([own.schema["vec_id"], own.schema["label"], T.StructField("dims", T.IntegerType()), T.StructField("ints", T.BinaryType())])

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            keep, ints = integers(batch.column(2))
            kept = batch.filter(pa.array(keep))
            yield pa.record_batch([kept.column(0), kept.column(1), pa.array([len(x) // 4 for x in ints], pa.int32()), pa.array(ints, pa.binary())], names=schema.names)

    return own.mapInArrow(convert, schema)


def cut(ints: list[bytes], dims: int) -> np.ndarray:
    """Integers by vector, part and place; filled up with zeros to equal parts."""
    width = -(-dims // PARTS)
    out = np.zeros((len(ints), PARTS * width), np.int64)
    if dims:
        out[:, :dims] = np.frombuffer(b"".join(ints), "<i4").reshape(len(ints), dims)
    return out.reshape(len(ints), PARTS, width)


def _shapes(x: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes, means and residual norms of each row's blocks."""
    edges = [round(i * x.shape[1] / blocks) for i in range(blocks + 1)]
    cuts = [x[:, a:b].astype(np.float64) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    means = np.stack([c.mean(1) for c in cuts], 1)
    rest = np.stack([np.sqrt(np.square(c - m[:, None]).sum(1)) for c, m in zip(cuts, means.T, strict=True)], 1)
    return np.diff(edges).astype(np.float64), means, rest


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest entry of each row (ties to the lower index), its squared distance, and how many exact distances
    it took."""
    n, width = x.shape
    if not n or not width:
        return np.zeros(n, np.int64), np.zeros(n, np.int64), 0
    # a bound may be off by rounding; the margin grows with the squares that it is made of
    margin = MARGIN * (np.square(x.astype(np.float64)).sum(1)[:, None] + np.square(entries.astype(np.float64)).sum(1)[None])
    rows = picked = best = None
    for blocks in BLOCKS:
        if blocks > 1 and blocks * 2 > width:
            break
        size, mean, rest = _shapes(x, blocks)
        _, entry_mean, entry_rest = _shapes(entries, blocks)
        if rows is None:
            low = size[0] * np.square(mean - entry_mean.T) + np.square(rest - entry_rest.T)
            best = np.square(x - entries[low.argmin(1)]).sum(1)
            rows, picked = np.nonzero(low - margin <= best[:, None])
        else:
            low = (size * np.square(mean[rows] - entry_mean[picked]) + np.square(rest[rows] - entry_rest[picked])).sum(1)
            stays = low - margin[rows, picked] <= best[rows]
            rows, picked = rows[stays], picked[stays]
    exact = np.full((n, len(entries)), _MOST)
    exact[rows, picked] = np.square(x[rows] - entries[picked]).sum(1)
    chosen = exact.argmin(1)
    return chosen, exact[np.arange(n), chosen], n + len(rows)


def assign(x: np.ndarray, books: Codebooks) -> tuple[np.ndarray, np.ndarray]:
    """Indexes by vector and part, and the squared distances of the parts."""
    found = [nearest(x[:, p], books.entries[p]) for p in range(PARTS)]
    return np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)


def _sums(own: DataFrame, books: Codebooks) -> DataFrame:
    """By slot (part and entry) and place: the sum of the components; at place -1 the number of parts."""
    width = books.entries.shape[2]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((PARTS * ENTRIES, width), np.int64)
        count = np.zeros(PARTS * ENTRIES, np.int64)
        for batch in parts(batches, ROWS):
            x = cut(batch.column(0).to_pylist(), books.dims)
            slots, _ = assign(x, books)
            slots = (slots + np.arange(PARTS) * ENTRIES).reshape(-1)
            count += np.bincount(slots, minlength=PARTS * ENTRIES)
            order = np.argsort(slots, kind="stable")
            held, first = np.unique(slots[order], return_index=True)
            if width and len(held):
                total[held] += np.add.reduceat(x.reshape(-1, width)[order], first, axis=0)
        used = np.flatnonzero(count)
        both = np.concatenate([count[used, None], total[used]], 1)
        yield pa.record_batch([pa.array(np.repeat(used, width + 1)), pa.array(np.tile(np.arange(-1, width), len(used))), pa.array(both.reshape(-1))], names=["slot", "place", "total"])

    own = own.select("ints").mapInArrow(add, "slot long, place long, total long")
    # sums over tasks may pass 64 bits
    return own.groupBy("slot", "place").agg(F.sum(F.col("total").cast("decimal(19,0)")).alias("total"))


def fit(ints: DataFrame, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks over rows of ``whole``: the vectors of the smallest ids, moved to their parts' means in each round."""
    order = [F.col("vec_id").asc_nulls_last(), F.col("ints")]
    first = ints.orderBy(*order).limit(1).collect()
    if not first:
        return Codebooks(np.zeros((PARTS, 0, 0), np.int64), 0)
    dims = first[0]["dims"]
    own = ints.where(F.col("dims") == dims)
    seeds = own.orderBy(*order).limit(ENTRIES).collect()
    books = Codebooks(cut([bytes(r["ints"]) for r in seeds], dims).transpose(1, 0, 2), dims)
    width = books.entries.shape[2]
    for _ in range(rounds):
        entries = books.entries.copy()
        sums = {(r["slot"], r["place"]): int(r["total"]) for r in _sums(own, books).collect()}
        for p in range(PARTS):
            for e in range(entries.shape[1]):
                slot = p * ENTRIES + e
                if count := sums.get((slot, -1)):
                    entries[p, e] = [sums[slot, i] // count for i in range(width)]
        books = Codebooks(entries, dims)
    return books


def encoded(ints: DataFrame, books: Codebooks) -> DataFrame:
    """vec_id, label, code (two hex digits a part) and error of each row of ``whole``."""
    schema = T.StructType([ints.schema["vec_id"], ints.schema["label"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, ROWS):
            codes, errors = [None] * batch.num_rows, [None] * batch.num_rows
            fits = np.flatnonzero(batch.column(2).to_numpy(zero_copy_only=False) == books.dims)
            ints = batch.column(3).take(pa.array(fits)).to_pylist()
            slots, far = assign(cut(ints, books.dims), books)
            for i, row, error in zip(fits, slots.astype(np.uint8), far.sum(1), strict=True):
                codes[i], errors[i] = row.tobytes().hex(), int(error)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(codes, pa.string()), pa.array(errors, pa.int64())], names=schema.names)

    return ints.select("vec_id", "label", "dims", "ints").mapInArrow(write, schema)


def apply(vectors: DataFrame, stash: Stash) -> tuple[DataFrame, Codebooks]:
    """Codes of a table (vec_id, embedding, label if there is one), and the codebooks fitted on all of it."""
    ints = stash.put(whole(vectors), "ints")
    books = fit(ints)
    return stash.put(encoded(ints, books), "codes"), books


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns. The sums by label are written first, so that Spark knows their size before it joins."""
    stash = Stash(spark)
    codes, books = apply(table(spark, sf_dir, "embeddings"), stash)
    total = F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long")
    by_label = stash.put(codes.groupBy("label").agg(total.alias("label_error")), "labels").withColumnRenamed("label", "_label")
    rows = codes.join(by_label, F.col("label").eqNullSafe(F.col("_label")), "left")
    return rows.select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def oracle(rounds: int = ROUNDS) -> str:
    """The same rows in SQL, by plain distances, for vectors of one length with unique ids."""
    steps = [f"""
x AS MATERIALIZED (
  SELECT vec_id, label, (i - 1) // (d // {PARTS}) AS p, (i - 1) % (d // {PARTS}) AS i, cast(floor({SCALE} * cast(v AS double)) AS bigint) AS v
  FROM (SELECT vec_id, label, len(embedding) AS d, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0)
), seed AS (
  SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM (SELECT DISTINCT vec_id FROM x ORDER BY vec_id LIMIT {ENTRIES})
), b0 AS MATERIALIZED (SELECT p, e, i, v FROM x JOIN seed USING (vec_id))"""]
    for r in range(rounds + 1):
        steps.append(f"""
a{r} AS MATERIALIZED (
  SELECT vec_id, p, min(far) AS far FROM (
    SELECT x.vec_id, x.p, b.e, sum(cast((x.v - b.v) * (x.v - b.v) AS hugeint)) * {ENTRIES} + b.e AS far FROM x JOIN b{r} b ON b.p = x.p AND b.i = x.i GROUP BY x.vec_id, x.p, b.e)
  GROUP BY vec_id, p)""")
        if r < rounds:
            steps.append(f"""
b{r + 1} AS MATERIALIZED (
  SELECT b.p, b.e, b.i, coalesce((s.t - ((s.t % s.n) + s.n) % s.n) // s.n, b.v) AS v FROM b{r} b LEFT JOIN (
    SELECT x.p, a.far % {ENTRIES} AS e, x.i, sum(x.v) AS t, count(*) AS n FROM x JOIN a{r} a ON a.vec_id = x.vec_id AND a.p = x.p GROUP BY ALL) s
  ON s.p = b.p AND s.e = b.e AND s.i = b.i)""")
    return "WITH " + ",".join(steps) + f""",
c AS (SELECT vec_id, string_agg(printf('%02x', cast(far % {ENTRIES} AS bigint)), '' ORDER BY p) AS code, cast(sum(far // {ENTRIES}) AS bigint) AS error FROM a{rounds} GROUP BY vec_id),
k AS (SELECT sha256(string_agg(cast(cast(v AS bigint) AS varchar), ',' ORDER BY p, e, i)) AS h FROM b{rounds})
SELECT c.vec_id, code, error, cast(sum(error) OVER (PARTITION BY l.label) AS bigint) AS label_error, k.h AS codebooks_sha256
FROM c JOIN (SELECT DISTINCT vec_id, label FROM x) l USING (vec_id), k"""
