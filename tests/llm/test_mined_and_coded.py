"""Collocations, winnowing and vector codes against brute force, and over odd rows."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from parlance.llm import collocations, queries, vector_codes, winnowing
from parlance.llm.common import Stash

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("name", ["op11_collocations", "op12_winnowing", "op13_vector_codes"])
def test_equals_its_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    own = queries.QUERIES[name](spark, DATA)
    names = sorted(own.columns)
    want = duck.sql(f"SELECT {', '.join(names)} FROM ({queries.ORACLES[name]})").fetchall()
    assert sorted(map(str, (tuple(r) for r in own.select(*names).collect()))) == sorted(map(str, want))


# collocations


def mined_plainly(rows, least, longest, shown):
    counts, words = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            own = re.findall(r"[^\x20\x09]+", piece)
            words[lang] += len(own)
            for k in range(1, longest + 1):
                for i in range(len(own) - k + 1):
                    counts[lang, tuple(own[i : i + k])] += 1
    often = {k: f for k, f in counts.items() if f >= least and len(k[1]) > 1}
    out = collections.defaultdict(list)
    for (lang, phrase), a in often.items():
        if any(o == lang and len(p) > len(phrase) and 100 * f >= 50 * a and any(p[i : i + len(phrase)] == phrase for i in range(len(p))) for (o, p), f in often.items()):
            continue
        cuts = []
        for k in range(1, len(phrase)):
            left, right = counts[lang, phrase[:k]], counts[lang, phrase[k:]]
            cuts.append((1000000 * a * a // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        out[lang].append((-score, -a, " ".join(phrase).encode(), left, right))
    return sorted((lang, i + 1, x[2].decode(), -x[1], x[3], x[4], words[lang], -x[0]) for lang, own in out.items() for i, x in enumerate(sorted(own)[:shown]))


def test_collocations_by_brute_force(spark):
    rng = random.Random(5)
    vocabulary = ["a", "A", "b", "c", "dé", "DÉ", "e-f", "ß", "x y", "the"]
    rows = []
    for i in range(300):
        text = "".join(rng.choice(vocabulary) + rng.choice((" ", "  ", "\t", " ", ". ", ",", "\n", "\r", "\x0b", "!")) for _ in range(rng.randrange(0, 60)))
        rows.append((i, rng.choice(("en", "und", None, "de")), None if i % 50 == 0 else text))
    rows += [(999, "en", "a a a a a a a a a a a a a"), (None, "", "only once here")]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(5)
    for least, longest, shown in ((10, 3, 2000), (4, 4, 25)):
        got = sorted(tuple(r) for r in collocations.mined(docs, Stash(spark), least, longest, shown, shard=700).collect())
        assert got == mined_plainly([r[1:] for r in rows], least, longest, shown)


def test_runs_read_as_patterns():
    runs = collocations.Runs([b"One two,three", b"", b" \t. ", b"four  FIVE\tsix. seven"])
    assert runs.text == b"\n one two \n three \n four five six \n seven "
    assert [runs.pattern(i, 2) for i in runs.runs(2)[0]] == [" one two ", " four five ", " five six "]
    assert collocations.Runs([]).count == 0 and collocations.Runs([b""]).runs(1)[0].tolist() == []


def test_shards_over_chunks_and_hash_clashes(monkeypatch):
    """Chunks of a shard are put together; where hashes clash, all runs are spelled out."""
    text = " ".join(f"w{i % 37} x{i % 11}" for i in range(4000)).encode()
    monkeypatch.setattr("parlance.llm.words.CHUNK", 64)
    runs = collocations.Runs([text[:9000], text[9000:], b"alone"])
    whole = runs.text.decode()
    assert runs.count == len(text.split()) + 1 and [runs.pattern(i, 1).strip() for i in range(runs.count)] == whole.split()
    bits = np.full(1 << 10, 255, np.uint8)
    patterns, occur = collocations._chosen("en", runs, 3, bits, 64)
    total = collocations._scan(patterns, whole)
    assert total.sum() == occur == sum(len(runs.runs(k)[0]) for k in (1, 2, 3))
    runs.hashes = runs.hashes % np.uint64(5)
    fewer, occur = collocations._chosen("en", runs, 3, bits, 64)
    every, _ = collocations._chosen("en", runs, 3, bits, 64, every=True)
    assert collocations._scan(fewer, whole).sum() < occur and every == patterns


def test_bitmap_has_all_heavy_cells(spark):
    docs = spark.createDataFrame([(i, "en", "p q r s " * 3 + f"u{i}") for i in range(40)], "doc_id long, lang string, text string")
    texts = docs.select("lang", "text")
    cells = collocations.heavy(collocations.sketch(texts, 10, 3, 500, 64), 10, 3)
    runs = collocations.Runs([b"p q r s " * 3])
    bits = collocations.bitmap(cells)
    patterns, _ = collocations._chosen("en", runs, 3, bits, 64)
    assert {" p ", " q r ", " s p q "} <= set(patterns)
    rare, _ = collocations._chosen("en", collocations.Runs([" ".join(f"u{i}" for i in range(40)).encode()]), 1, bits, 64)
    assert len(rare) < 10


# winnowing


def hit_plainly(docs, items, span=10):
    out = []
    grams = collections.defaultdict(set)
    for item, text in items:
        own = WORD.findall((text or "").translate(LOWER))
        size = min(len(own), span)
        for i in range(len(own) - size + 1 if own else 0):
            grams[tuple(own[i : i + size])].add(item)
    for doc, text in docs:
        own = WORD.findall((text or "").translate(LOWER))
        hit, ids = set(), set()
        for size in range(1, span + 1):
            for i in range(len(own) - size + 1):
                if tuple(own[i : i + size]) in grams:
                    hit |= set(range(i, i + size))
                    ids |= grams[tuple(own[i : i + size])]
        ids = sorted(str(x) for x in ids if x is not None)
        out.append((doc, len(own), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), len(hit) > 0))
    return sorted(out, key=str)


def planted(seed, short=True):
    rng = random.Random(seed)
    words = ["a", "b", "The", "the", "É", "é", "x1", "日本", "q"]
    text = lambda n: "".join(rng.choice(words) + rng.choice((" ", ", ", "\n", "-", "\x7f")) for _ in range(n))
    items = [(i, text(rng.randrange(10, 40))) for i in range(12)]
    items += [(100, items[0][1]), (3, items[5][1]), (None, text(15)), (50, None), (51, " ,;")]
    items += [(200 + n, text(n)) for n in (4, 6, 7, 9)] * short
    docs = [(i, text(rng.randrange(0, 80))) for i in range(40)]
    for i in range(30):
        own = rng.choice(items)[1] or ""
        a = rng.randrange(0, max(len(own) // 2, 1))
        docs.append((100 + i, text(rng.randrange(0, 30)) + own[a : a + rng.randrange(10, 200)] + text(rng.randrange(0, 30))))
    return docs + [(7, docs[0][1]), (7, docs[0][1]), (None, items[1][1]), (300, None), (301, ""), (302, "a " * 3000)], items


@pytest.mark.parametrize("short", [True, False])
def test_hits_by_brute_force(spark, monkeypatch, short):
    docs, items = planted(8, short)
    want = hit_plainly(docs, items)
    df = spark.createDataFrame([(*d, f"x{i}", i) for i, d in enumerate(docs)], "doc_id long, text string, number string, n long").repartition(3)
    other = spark.createDataFrame(items, "item_id long, text string")
    for most in (winnowing.BLOCK_BYTES, 4000):  # in one block and in several
        monkeypatch.setattr(winnowing, "BLOCK_BYTES", most)
        rows = winnowing.hits(df, other, Stash(spark)).collect()
        got = [(r["doc_id"], r["n_words"], r["n_hit"], len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), r["n_hit"] > 0) for r in rows]
        assert sorted(got, key=str) == want
        for r in rows:
            assert len({w for a, b in r["hits"] for w in range(a, b)}) == r["n_hit"]


def test_every_shared_span_has_a_common_fingerprint():
    """What the method promises, on hashes alone: runs of ten words keep the same place on both sides."""
    rng = random.Random(2)

    def kept(own):
        grams = [hash(tuple(own[i : i + 5])) for i in range(len(own) - 4)]
        return {min(range(i, i + 6), key=lambda j: (grams[j], -j)) for i in range(len(grams) - 5)}

    for _ in range(200):
        shared = [rng.randrange(3) for _ in range(10)]
        left, right = ([rng.randrange(3) for _ in range(rng.randrange(20))] for _ in range(2))
        x, y = left + shared + right, right + shared + left
        assert {p - len(left) for p in kept(x)} & {p - len(right) for p in kept(y)} & set(range(6))


def test_winnowing_over_odd_rows(spark, odd, none):
    items = spark.createDataFrame([(1, "One two three four five six seven eight. A second line"), (2, "lone"), (3, "word " * 12)], "item_id long, text string")
    rows = winnowing.hits(odd, items, Stash(spark)).collect()
    assert len(rows) == odd.count()
    by_id = collections.defaultdict(list)
    for r in rows:
        by_id[r["doc_id"]].append((r["n_words"], r["n_hit"], r["items"]))
    assert by_id[8] == [(1, 1, ["2"])] and by_id[9] == [(30000, 30000, ["3"])] and by_id[3] == by_id[2] == [(0, 0, [])]
    assert len(by_id[5]) == 2 and by_id[5][0] == (19, 11, ["1"]) == by_id[5][1]
    assert winnowing.hits(none, items, Stash(spark)).collect() == []
    empty = winnowing.hits(odd, items.where("false"), Stash(spark)).collect()
    assert len(empty) == len(rows) and not any(r["n_hit"] for r in empty)


# vector codes


@pytest.mark.parametrize("width", [1, 2, 3, 8, 13])
def test_nearest_equals_plain_distances(width):
    rng = np.random.default_rng(width)
    for scale in (3, 2000, 2**27):
        x, c = rng.integers(-scale, scale + 1, (700, width)), rng.integers(-scale, scale + 1, (16, width))
        c[5] = c[9]
        x[:50] = c[rng.integers(0, 16, 50)]
        far = ((x[:, None].astype(object) - c[None].astype(object)) ** 2).sum(2)
        chosen, exact, _ = vector_codes.nearest(x, c)
        assert chosen.tolist() == [min(range(16), key=lambda e, f=f: (f[e], e)) for f in far]
        assert exact.tolist() == far.min(1).tolist()


def test_bounds_leave_few_exact_distances():
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 400, (16, 8))
    x = np.floor(centres[rng.integers(0, 16, 4000)] + rng.normal(0, 80, (4000, 8))).astype(np.int64)
    _, _, took = vector_codes.nearest(x, np.floor(centres).astype(np.int64))
    assert took < 4000 * 16 / 2


def coded_plainly(rows):
    """Product codes by Python integers; rows of (vec_id, vector, label) with unique ids."""
    kept = sorted((i, [math.floor(4096 * float(np.float32(v))) for v in x], label) for i, x, label in rows if x is not None and all(v is not None and math.isfinite(v) for v in x))
    width = len(kept[0][1]) // 8
    cut = lambda x, p: x[p * width : (p + 1) * width]
    books = [[cut(x, p) for _, x, _ in kept[:16]] for p in range(8)]
    far = lambda a, b: sum((u - v) ** 2 for u, v in zip(a, b, strict=True))
    near = lambda x, p: min((far(cut(x, p), e), i) for i, e in enumerate(books[p]))
    for _ in range(6):
        found = [[near(x, p)[1] for _, x, _ in kept] for p in range(8)]
        for p in range(8):
            for e in range(len(books[p])):
                own = [cut(x, p) for (_, x, _), f in zip(kept, found[p], strict=True) if f == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    out = {i: ("".join(f"{near(x, p)[1]:02x}" for p in range(8)), sum(near(x, p)[0] for p in range(8))) for i, x, _ in kept}
    return out, hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()


def test_codes_by_brute_force(spark):
    rng = np.random.default_rng(9)
    rows = [(i, (rng.normal(0, 1, 24) + (i % 5)).astype(np.float32).tolist(), None if i % 7 == 0 else i % 3) for i in range(120)]
    rows += [(500, None, 1), (501, [float("nan")] * 24, 1), (502, [None] * 24, 2), (503, [float("inf")] * 24, None), (504, [0.5] * 23 + [None], 0)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, code string").repartition(4)
    codes, books = vector_codes.apply(df, Stash(spark))
    want, digest = coded_plainly(rows)
    assert {r["vec_id"]: (r["code"], r["error"]) for r in codes.collect()} == want and books.digest() == digest


def test_codes_over_odd_tables(spark, tmp_path):
    schema = "vec_id long, embedding array<float>, label int, error long, dims int"
    rows = [(1, [1.0, 2.0, 3.0], 1, 0, 0), (1, [1.0, 2.0, 3.0], 1, 0, 0), (None, [4.0, 5.0, 6.0], None, 0, 0), (2, [1.0], None, 0, 0), (3, [], 2, 0, 0), (4, [3e38, -3e38, 0.0], 2, 0, 0)]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/embeddings.parquet")
    out = {(r["vec_id"], r["code"] is None): r for r in vector_codes.query(spark, str(tmp_path)).collect()}
    assert sorted((k[0] is None, k[0] or 0, k[1]) for k in out) == [(False, 1, False), (False, 2, True), (False, 3, True), (False, 4, False), (True, 0, False)]
    assert out[1, False]["error"] == 0 and out[None, False]["error"] == 0 and out[2, True]["error"] is None
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none/embeddings.parquet")
    assert vector_codes.query(spark, f"{tmp_path}/none").collect() == []


def test_integers_are_floors():
    keep, ints = vector_codes.integers(pa.array([[0.0, -0.0001, 1 / 4096, -1 / 4096], None, [1.0, None], [float("nan")], []], pa.list_(pa.float32())))
    assert keep.tolist() == [True, False, False, False, True]
    assert np.frombuffer(ints[0], "<i4").tolist() == [0, -1, 1, -1] and ints[1] == b""
