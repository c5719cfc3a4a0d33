"""Token ids in binary blocks, compressed by Re-Pair grammars.

Documents are ordered by id (range partitions, sorted inside), encoded, closed with the end id, and laid into blocks of
about ``BLOCK`` ids. In each block pairs of symbols are replaced by nonterminals, many pairs a round, until no pair is so
frequent that its rule would pay for itself in bits (``least_count``); no pair crosses a document's end, so each document
is a run of symbols of its own. A block holds its grammar, the expansion length of each nonterminal and the place of each
document, so one document, or a part of it, is decoded without the others (``decode_one``).

Blocks are rows of a Parquet table: Spark's writer commits them, whichever executors are lost. ``write`` puts them into a
folder of the caller's, where they stay, or into a scratch folder. Layout of a block, all little-endian: ``RPG2``, six
uint32 (documents, first nonterminal, rules, symbols, bits of a symbol, bytes of an expansion length), then doc ids
(int64), null flags of ids (uint8), ids of each document (uint32), symbols of each document (uint32), expansion lengths,
rules (two symbols each) and symbols, these two packed by bits.

Defined cases: null or empty text is the end id alone; rows without an id come first; repeated rows and ids each have
their own place (equal ids in the order of their texts' SHA-256); an empty table writes no blocks; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parlance.llm import tokens
from parlance.llm.common import Stash, partitions, parts, table, texts

MAGIC = b"RPG2"
#: Ids of a block (the last document may exceed it).
BLOCK = 1 << 20
_END = np.array([tokens.END], "<u4").tobytes()
_ODD = 7046029254386353131


def least_count(symbols: int) -> int:
    """How often a pair has to stand for its rule to pay: a place saves the bits of a symbol, a rule takes those of two
    and 16 of its expansion length."""
    bits = max(1, symbols.bit_length())
    return (2 * bits + 16) // bits + 1


def compress(ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Symbols, symbols of each document, rules (pairs), and the first nonterminal.

    A round replaces each pair where it is more frequent than the pairs that overlap it (of equals the greater one), if
    enough such places are left for the rule to pay, or it has a rule already. Counts are of hash buckets at first, exact
    once these find no more; the end is reached when no pair pays by exact counts. A place whose pair is rare is only looked
    at again once a new symbol stands in it: what is missed by that is below a thousandth of a block of texts.
    """
    base = int(ids.max()) + 1 if len(ids) else 1
    # places are linked, so that what is replaced leaves a gap and no round costs more than the places it looks at
    seq = np.append(ids.astype(np.int64), 0)
    after, before = np.arange(1, len(seq) + 1), np.arange(-1, len(seq) - 1)
    gone, last = np.zeros(len(seq), bool), np.zeros(len(seq), bool)
    gone[-1] = True
    last[np.append(np.cumsum(lengths) - 1, len(seq) - 1)] = True
    live = ~last  # where a pair begins that may be frequent
    place = np.flatnonzero(live)
    rules: list[np.ndarray] = []  # pairs as one number each
    known, number = np.zeros(0, np.int64), np.zeros(0, np.int64)  # the same in order, and which rule each is
    exact, turn = False, 0

    def find(keys: np.ndarray) -> np.ndarray:
        """The rule of each pair, or -1."""
        if not len(known):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        return np.where(known[at] == keys, number[at], -1)

    while len(place):
        made = len(known)
        least = least_count(base + made)
        follower = after[place]
        key = seq[place]
        key <<= 32
        key |= seq[follower]
        beside = place[1:] == follower[:-1]
        # in a run of one symbol every other pair counts, from the left
        odd = np.flatnonzero(beside & (key[1:] == key[:-1])) + 1
        if len(odd):
            begins = np.flatnonzero(np.diff(odd, prepend=-1) != 1)
            odd = odd[(np.arange(len(odd)) - np.repeat(begins, np.diff(begins, append=len(odd)))) & 1 == 0]
        if exact:
            _, slot = np.unique(key, return_inverse=True)
            most = int(slot.max()) + 1
        else:
            turn += 1  # other buckets each round
            factor, most = np.int64((_ODD * (2 * turn + 1) + (1 << 63)) % (1 << 64) - (1 << 63)), 1 << max(10, len(key).bit_length())
            slot = key * factor
            slot >>= 40
            slot &= most - 1
        counts = np.bincount(slot, minlength=most).astype(np.int32)
        np.subtract.at(counts, slot[odd], 1)
        often = counts[slot]
        low = often < least
        low[odd] = False
        often[odd] = 0
        rare = np.flatnonzero(low)
        old = rare
        if not exact:  # only where the bucket has a pair with a rule can there be one
            ruled = np.zeros(most, bool)
            ruled[((known * factor) >> 40) & (most - 1)] = True
            old = rare[ruled[slot[rare]]]
        old = old[find(key[old]) >= 0]
        often[old] = least  # a rule that is there already costs nothing more
        low[old] = False
        rare = np.flatnonzero(low)
        right = beside & ((often[:-1] < often[1:]) | (often[:-1] == often[1:]) & (key[:-1] < key[1:]))
        best = often >= least
        best[:-1] &= ~right
        best[1:] &= right | ~beside
        # one pair of each slot has its turn; others of the same bucket wait for the next round
        hot = counts >= least
        hot[slot[old]] = True
        hot = np.flatnonzero(hot)
        narrow = np.zeros(most, np.int32)
        narrow[hot] = np.arange(len(hot))
        best = np.flatnonzero(best)
        at, slot, key = place[best], narrow[slot[best]], key[best]
        pair_of = np.zeros(len(hot), np.int64)
        pair_of[slot] = key
        own = np.flatnonzero(pair_of[slot] == key)
        at, slot = at[own], slot[own]
        times = np.bincount(slot, minlength=len(hot))
        used = np.flatnonzero(times)
        pairs, times = pair_of[used], times[used]
        had = find(pairs)
        pays = (times >= least) | (had >= 0)
        if not pays.any():
            if exact:
                break
            exact = True
            continue
        live[place[rare]] = False
        new = pays & (had < 0)
        had[new] = made + np.arange(new.sum())
        had[~pays] = -1
        symbol = np.full(len(hot), -1)
        symbol[used] = had
        rule = symbol[slot]
        kept = rule >= 0
        at = at[kept]
        seq[at] = base + rule[kept]
        second = after[at]
        after[at] = after[second]
        before[after[at]] = at
        last[at], gone[second], live[second] = last[second], True, False
        live[at] = ~last[at]
        earlier = before[at]
        live[earlier] = ~last[earlier]  # before the first place stands the last one, which is an end
        if len(place) * 8 > len(seq):
            place = np.flatnonzero(live)
        else:  # few places are put in order faster than all are looked through
            place = np.sort(np.concatenate([place[live[place]], earlier[live[earlier]]]))
            place = place[np.diff(place, prepend=-1) != 0]
        if new.any():
            pairs = pairs[new]
            rules.append(pairs)
            order = np.argsort(pairs)
            into = np.searchsorted(known, pairs[order])
            known, number = np.insert(known, into, pairs[order]), np.insert(number, into, made + order)
    rules = np.concatenate([np.zeros(0, np.int64), *rules])
    seq, ends = seq[~gone], np.flatnonzero(last[~gone]) + 1
    return seq, np.diff(ends, prepend=0), np.stack([rules >> 32, rules & 0xFFFFFFFF], 1), base


def to_bits(numbers: np.ndarray, bits: int) -> bytes:
    """Numbers of ``bits`` bits each, one after another, the highest bit first."""
    return np.packbits(np.unpackbits(numbers.astype(">u4").view(np.uint8)).reshape(-1, 32)[:, 32 - bits :]).tobytes()


def from_bits(raw: np.ndarray, bits: int, first: int, count: int) -> np.ndarray:
    """Numbers ``first`` to ``first + count`` of packed bytes; no others are read."""
    begin, end = first * bits, (first + count) * bits
    flat = np.unpackbits(raw[begin // 8 : (end + 7) // 8])[begin % 8 : begin % 8 + count * bits]
    wide = np.zeros((count, 32), np.uint8)
    wide[:, 32 - bits :] = flat.reshape(count, bits)
    return np.packbits(wide).view(">u4").astype(np.int64)


def expansions(rules: np.ndarray, base: int) -> np.ndarray:
    """How many ids each nonterminal stands for. Rules only use symbols before their own."""
    out = np.zeros(len(rules), np.int64)
    done = 0
    while done < len(rules):
        ready = (rules[done:] < base + done).all(1)
        n = len(ready) if ready.all() else int(np.argmin(ready))
        part = rules[done : done + n]
        out[done : done + n] = np.where(part < base, 1, out[np.maximum(part - base, 0)]).sum(1)
        done += n
    return out


def expand(symbols: np.ndarray, rules: np.ndarray, base: int, wide: np.ndarray | None = None) -> np.ndarray:
    """The ids that symbols stand for (``wide``: the rules' expansion lengths)."""
    wide = expansions(rules, base) if wide is None else wide.astype(np.int64)
    if len(symbols) * 4 < len(rules):  # few of them: level by level
        while (deep := symbols >= base).any():
            at = np.cumsum(1 + deep) - 1 - deep
            out = np.empty(len(symbols) + int(deep.sum()), np.int64)
            out[at] = symbols
            own = rules[symbols[deep] - base]
            out[at[deep]], out[at[deep] + 1] = own[:, 0], own[:, 1]
            symbols = out
        return symbols
    if not len(rules):
        return symbols
    # every rule once, those that stand for fewest ids first, laid out in that order; then all symbols by one lookup
    order = np.argsort(wide, kind="stable")
    ends = np.cumsum(wide[order])
    first = np.empty(len(wide), np.int64)
    first[order] = ends - wide[order]
    flat = np.zeros(ends[-1], np.int64)

    def spelled(symbols: np.ndarray) -> np.ndarray:
        deep = symbols >= base
        rule = np.where(deep, symbols - base, 0)
        n = np.where(deep, wide[rule], 1)
        out = flat[_runs(first[rule], n)]
        out[(np.cumsum(n) - n)[~deep]] = symbols[~deep]
        return out

    begin = 0
    for end in [*(np.flatnonzero(np.diff(wide[order])) + 1).tolist(), len(order)]:
        flat[first[order[begin]] : ends[end - 1]] = spelled(rules[order[begin:end]].ravel())
        begin = end
    return spelled(symbols)


def _runs(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Numbers from each ``first`` on, ``count`` of each."""
    total = np.cumsum(count)
    return np.arange(total[-1] if len(total) else 0) + np.repeat(first - (total - count), count)


def pack(doc_ids: list[int | None], ids: list[bytes]) -> bytes:
    """A block of documents and their ids (end ids included)."""
    lengths = np.array([len(x) // 4 for x in ids], np.int64)
    seq, spans, rules, base = compress(np.frombuffer(b"".join(ids), "<u4"), lengths)
    bits = max(1, (base + len(rules) - 1).bit_length())
    wide = expansions(rules, base)
    width = 2 if not len(wide) or wide.max() < 1 << 16 else 4
    head = struct.pack("<4s6I", MAGIC, len(ids), base, len(rules), len(seq), bits, width)
    parts = (np.array([x or 0 for x in doc_ids], "<i8"), np.array([x is None for x in doc_ids], "u1"), lengths.astype("<u4"), spans.astype("<u4"), wide.astype(f"<u{width}"))
    return head + b"".join(x.tobytes() for x in parts) + to_bits(rules.ravel(), bits) + to_bits(seq, bits)


class Block:
    """A block as read back."""

    def __init__(self, raw: bytes):
        magic, n, self.base, n_rules, self.n_symbols, self.bits, width = struct.unpack_from("<4s6I", raw)
        if magic != MAGIC:
            raise ValueError("not a block of token ids")
        at = 28
        parts = []
        for kind, count in (("<i8", n), ("u1", n), ("<u4", n), ("<u4", n), (f"<u{width}", n_rules), ("u1", (2 * n_rules * self.bits + 7) // 8), ("u1", (self.n_symbols * self.bits + 7) // 8)):
            parts.append(np.frombuffer(raw, kind, count, at))
            at += parts[-1].nbytes
        ids, nulls, self.lengths, spans, self.expansions, rules, self.packed = parts
        self.doc_ids = [None if null else int(i) for i, null in zip(ids, nulls, strict=True)]
        self.rules = from_bits(rules, self.bits, 0, 2 * n_rules).reshape(-1, 2)
        self.ends = np.cumsum(spans, dtype=np.int64)

    def symbols(self, first: int, last: int) -> np.ndarray:
        return from_bits(self.packed, self.bits, first, last - first)

    def decode(self) -> list[bytes]:
        """Ids of all documents, as little-endian 32-bit."""
        raw = expand(self.symbols(0, self.n_symbols), self.rules, self.base, self.expansions).astype("<u4").tobytes()
        ends = (np.cumsum(self.lengths, dtype=np.int64) * 4).tolist()
        return [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def decode_one(self, i: int, first: int = 0, count: int | None = None) -> np.ndarray:
        """Ids ``first`` to ``first + count`` of document ``i``: only the symbols that hold them are expanded."""
        own = self.symbols(int(self.ends[i - 1]) if i else 0, int(self.ends[i]))
        wide = np.where(own < self.base, 1, self.expansions[np.maximum(own - self.base, 0)].astype(np.int64) if len(self.rules) else 1)
        ends = np.cumsum(wide, dtype=np.int64)
        last = int(ends[-1]) if count is None else min(first + count, int(ends[-1]))
        lo, hi = np.searchsorted(ends, first, side="right"), np.searchsorted(ends, last, side="left") + 1
        skipped = int(ends[lo - 1]) if lo else 0
        return expand(own[lo:hi], self.rules, self.base, self.expansions)[first - skipped : last - skipped]


def write(docs: DataFrame, stash: Stash, name: str = "blocks", path: str | None = None, folder: str | None = None) -> DataFrame:
    """Blocks of all documents, as read back: shard, block, before (ids of the shard before it), n_ids, payload. They are
    files in ``folder``, where they stay, or in a scratch table."""
    path = path or tokens.default_path()

    def laid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int | None, bytes]] = []
        size = before = number = 0

        def close() -> pa.RecordBatch:
            nonlocal held, size, before, number
            out = pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([number], pa.int64()), pa.array([before], pa.int64()), pa.array([size], pa.int64()), pa.array([pack([i for i, _ in held], [x for _, x in held])], pa.binary())], ["shard", "block", "before", "n_ids", "payload"])
            before, number, held, size = before + size, number + 1, [], 0
            return out

        shard = None
        for batch in parts(batches, keeps="tokens"):
            if batch.num_rows:
                shard = batch.column(2)[0].as_py()
            for i, ids in zip(batch.column(0).to_pylist(), tokens.encode(texts(batch, "text"), path), strict=True):
                held.append((i, ids + _END))
                size += len(ids) // 4 + 1
                if size >= BLOCK:
                    yield close()
        if held:
            yield close()

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # equal ids, and rows without one, are spread over ranges by the hash of their text
    place = (F.col("doc_id").asc_nulls_first(), F.unhex(F.sha2("text", 256)))
    ranged = own.repartitionByRange(partitions(docs.sparkSession), *place).sortWithinPartitions(*place)
    blocks = ranged.withColumn("shard", F.spark_partition_id().cast("long")).mapInArrow(laid, "shard long, block long, before long, n_ids long, payload binary")
    if folder is None:
        return stash.put(blocks, name)
    blocks.write.mode("overwrite").parquet(folder)
    return docs.sparkSession.read.schema(blocks.schema).parquet(folder)


def read(blocks: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, decoded from its block."""
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))  # one row a partition: that bounds the window and the broadcast
    shards = shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("shard_start"))

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            for start, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                block = Block(raw.as_py())
                own = block.decode()
                counts = block.lengths.astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(block.doc_ids, pa.int64()), pa.array(start + np.cumsum(counts) - counts), pa.array(counts), pa.array([zlib.crc32(x) for x in own], pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    at = blocks.join(F.broadcast(shards), "shard").select((F.col("shard_start") + F.col("before")).alias("start"), "payload")
    return at.mapInArrow(decoded, "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(write(table(spark, sf_dir, "documents"), Stash(spark)))
