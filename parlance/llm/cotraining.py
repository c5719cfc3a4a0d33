"""Quality classifier by co-training: a text view and a metadata view teach each other.

Both views are logistic models. The text view reads hashed byte pairs and a few word statistics of the whole text; the
metadata view reads source, language and length columns, never the text. They are fitted on a bounded sample of labelled
documents (``labelled`` at most, chosen by hashed id), a quarter of which is held out. In each of ``ROUNDS`` rounds both
views score all documents without a label, in one pass that keeps only ids and scores; of those that a view is sure of,
``NAMED`` a class that it has not named before (the smallest hashed ids, so of all kinds) become training rows of the
other view; together they never weigh more than half of the labelled rows. How sure a view has to be is measured on the
held-out rows (``bar``). The exchange ends early where nobody is named, or where ``JUDGED`` held-out rows or more fare worse
after a round, which is then not taken. Each view is calibrated on the held-out rows, and the calibrated log-odds are added (less the
prior, which both hold). All documents are scored in one pass without a shuffle.

Defined cases: a null or empty text has a zero text view, null metadata are a value of their own; null ids stay null;
repeated rows are scored each; without labels of both classes the score is the label share (keep, if there is none).
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm import words
from parlance.llm.common import Stash, parts, table, texts

#: Labelled rows that are read for fitting, at most.
LABELLED = 4000
ROUNDS = 3
#: Documents of each class that a view names in a round, at most, and the precision that it should have there.
NAMED, SURE = 200, 0.95
#: Held-out rows that a round's loss has to be measured on, at least; with fewer of them every round is taken.
JUDGED = 30
#: Held-out rows that a bar has to be measured on, at least.
MEASURED = 8
PAIRS, META = 512, 64


def text_view(docs: list[bytes]) -> np.ndarray:
    """Relative frequencies (square roots) of hashed byte pairs, the share of words that repeat the word before, and
    that of words seen already in runs of three."""
    out = []
    for chunk in words.chunks(docs):
        b = chunk.bytes.astype(np.int64)
        n = chunk.last - chunk.first
        lengths = np.diff(chunk.text_at)
        owner = np.repeat(np.arange(n), lengths)
        pair = ((b[:-1] * 257 + b[1:]) * 40503 >> 7) % PAIRS
        inside = owner[:-1] == owner[1:]
        counts = np.bincount(owner[:-1][inside] * PAIRS + pair[inside], minlength=n * PAIRS).reshape(n, PAIRS)
        view = np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1))
        hashes = chunk.hashes()
        of = np.repeat(np.arange(n), np.diff(chunk.word_at))
        echo = np.zeros(len(hashes), bool)
        if len(hashes) > 1:
            echo[1:] = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])
        again = np.zeros(len(hashes), bool)
        run = words.windows(hashes, 3)
        if len(run):
            key = run ^ words.mix(of[2:].astype(np.uint64) + np.uint64(3))
            again[2:] = True
            again[2:][np.unique(key, return_index=True)[1]] = False
        w = np.maximum(np.diff(chunk.word_at), 1)[:, None]
        extra = np.stack([chunk.per_text_words(echo), chunk.per_text_words(again)], 1) / w
        out.append(np.concatenate([view, extra, extra > 0.3], 1).astype(np.float32))
    return np.concatenate(out) if out else np.zeros((0, PAIRS + 4), np.float32)


def meta_view(batch: pa.RecordBatch) -> np.ndarray:
    """Hashed source and language, each with the length class, and the length itself."""
    n = batch.num_rows
    view = np.zeros((n, META + 2), np.float32)
    source, lang, chars = (batch.column(batch.schema.get_field_index(x)).to_pylist() for x in ("source", "lang", "n_chars"))
    for i, (s, g, c) in enumerate(zip(source, lang, chars, strict=True)):
        size = max(0, c or 0)
        for x in (f"s{s}", f"l{g}", f"l{g} {size.bit_length()}"):
            view[i, zlib.crc32(x.encode()) % META] = 1
        view[i, META] = np.log1p(size) / 10
        view[i, META + 1] = c is None
    return view


@dataclass
class Linear:
    weights: np.ndarray
    bias: float

    def odds(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights + self.bias


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float = 3e-2, steps: int = 150) -> Linear:
    """Weighted logistic regression by accelerated gradient steps; deterministic."""
    mean = x.mean(0) if len(x) else np.zeros(x.shape[1])
    scale = x.std(0) + 0.02
    z = np.concatenate([(x - mean) / scale, np.ones((len(x), 1))], 1).astype(np.float64)
    w = np.zeros(z.shape[1])
    look = w.copy()
    weight = weight / max(weight.sum(), 1e-9)
    step = 1.0 / (0.25 * float(np.linalg.norm(z * np.sqrt(weight)[:, None], 2)) ** 2 + l2) if len(x) else 1.0
    for k in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ look, -30, 30)))
        grad = z.T @ (weight * (p - y)) + l2 * np.append(look[:-1], 0)
        new = look - step * grad
        look = new + k / (k + 3) * (new - w)
        w = new
    return Linear(w[:-1] / scale, float(w[-1] - (w[:-1] * mean / scale).sum()))


def _calibrated(odds: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt scaling: slope (never negative) and intercept of the odds on held-out labels."""
    a, b = 1.0, 0.0
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * odds + b, -30, 30)))
        g = np.array([((p - target) * odds).sum() + 1e-3 * (a - 1), (p - target).sum()])
        r = p * (1 - p) + 1e-9
        h = np.array([[(r * odds * odds).sum() + 1e-3, (r * odds).sum()], [(r * odds).sum(), r.sum() + 1e-6]])
        move = np.linalg.solve(h, g)
        size = min(1.0, 2.0 / (np.abs(move).max() + 1e-12))
        a, b = a - size * move[0], b - size * move[1]
    return max(a, 0.0), b


@dataclass
class Model:
    views: tuple[Linear, Linear] | None
    scales: tuple[tuple[float, float], tuple[float, float]]
    prior: float

    def scores(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated P(quality = 1) by text, by metadata, and by both."""
        prior = np.full(len(text), self.prior)
        if self.views is None:
            flat = 1 / (1 + np.exp(-prior))
            return flat, flat, flat
        odds = [a * view.odds(x.astype(np.float64)) + b for view, (a, b), x in zip(self.views, self.scales, (text, meta), strict=True)]
        sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))
        return sigmoid(odds[0]), sigmoid(odds[1]), sigmoid(odds[0] + odds[1] - prior)


def bar(p: np.ndarray, y: np.ndarray) -> float:
    """The least score at which a view's precision on held-out rows (``y``: whether they are of the class) is ``SURE``;
    where it never is, at which it has half of the errors of naming at random; infinite where it has not even that."""
    if not len(p):
        return np.inf
    order = np.argsort(-p, kind="stable")
    share = y.mean()
    n = np.arange(1, len(p) + 1)
    precision = (np.cumsum(y[order]) + share) / (n + 1)
    whole = np.append(p[order][:-1] > p[order][1:], True) & (n >= MEASURED)  # never between equal scores
    for need in (SURE, (1 + share) / 2):
        found = np.flatnonzero(whole & (precision >= need))
        if len(found):
            return float(p[order][found[-1]])
    return np.inf


@dataclass
class Named:
    """Documents that each view names: ids, views and labels; for view v, what it has named goes to the other one."""

    ids: list[int]
    text: np.ndarray
    meta: np.ndarray
    view: np.ndarray
    label: np.ndarray


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def cotrain(text: np.ndarray, meta: np.ndarray, y: np.ndarray, name: Callable[[Judges], Named], rounds: int = ROUNDS) -> tuple[Model, list[int]]:
    """The model from labelled rows (y: 1 or 0) and how many rows each view has been told by the other.

    ``name`` gives the documents that the judges of a round are sure of. A quarter of the rows is held out.
    """
    share = (y.sum() + 1.0) / (len(y) + 1.5)
    prior = float(np.log(share / max(1 - share, 1e-6)))
    held = np.arange(0, len(y), 4)
    train = np.setdiff1d(np.arange(len(y)), held)
    if any(len(np.unique(y[x])) < 2 for x in (held, train)):
        return Model(None, ((1, 0), (1, 0)), prior if len(y) else 1.0), [0, 0]
    views = [text, meta]
    taken: tuple = ()
    told: list[dict[int, tuple[np.ndarray, float]]] = [{}, {}]  # of each view: its row of a document, and the label
    for turn in range(rounds + 1):
        models = []
        for v, x in enumerate(views):
            more = list(told[v].values())
            rows = np.concatenate([x[train], np.array([r for r, _ in more]).reshape(-1, x.shape[1])])
            label = np.concatenate([y[train], [k for _, k in more]])
            # what was named weighs half as much as the labelled rows at most, however many rounds name it
            weight = np.concatenate([np.ones(len(train)), np.full(len(more), 0.5 * min(1.0, len(train) / max(len(more), 1)))])
            for k in (0, 1):  # whatever was named, the classes weigh as they do among the labelled rows
                weight[label == k] *= (y[train] == k).mean() / weight[label == k].sum()
            models.append(logistic(rows, label, weight))
        scales = tuple(_calibrated(m.odds(x[held]), y[held]) for m, x in zip(models, views, strict=True))
        # a round after which the held-out rows fare worse is not taken and ends the exchange, if they are enough to tell
        both = _sigmoid(sum(a * m.odds(x[held]) + b for m, x, (a, b) in zip(models, views, scales, strict=True)) - prior)
        loss = -np.log(np.clip(np.where(y[held] == 1, both, 1 - both), 1e-9, 1))
        if taken and len(held) >= JUDGED and loss.mean() > taken[0].mean():
            break
        taken = (loss, models, scales)
        if turn == rounds:
            break
        chances = [_sigmoid(a * m.odds(x[held]) + b) for m, x, (a, b) in zip(models, views, scales, strict=True)]
        bars = tuple((bar(1 - p, y[held] == 0), bar(p, y[held] == 1)) for p in chances)
        found = name(Judges((models[0], models[1]), scales, bars, (frozenset(told[1]), frozenset(told[0]))))
        if not found.ids:  # nobody new: another round would be the same
            break
        for i, t, m, v, k in zip(found.ids, found.text, found.meta, found.view, found.label, strict=True):
            told[1 - v].setdefault(i, ((m, t)[v], float(k)))  # view 0 is the text
    _, models, scales = taken
    return Model((models[0], models[1]), scales, prior), [len(x) for x in told]


@dataclass
class Judges:
    """Both views in a round, their calibration, and how sure each has to be of class 0 and 1 to name a document."""

    views: tuple[Linear, Linear]
    scales: tuple[tuple[float, float], tuple[float, float]]
    bars: tuple[tuple[float, float], tuple[float, float]]
    #: Documents that each view has named before; it names them no more.
    before: tuple[frozenset[int], frozenset[int]] = (frozenset(), frozenset())

    def says(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        """Rows x views: 1 or 0 where a view is sure, else -1."""
        out = np.full((len(text), 2), -1, np.int8)
        for v, x in enumerate((text, meta)):
            a, b = self.scales[v]
            p = _sigmoid(a * self.views[v].odds(x.astype(np.float64)) + b)
            out[(1 - p >= self.bars[v][0]) & (p < 0.5), v] = 0
            out[(p >= self.bars[v][1]) & (p >= 0.5), v] = 1
        return out


def _views(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return text_view(texts(batch, "text")), meta_view(batch)


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in parts(batches):
        text, meta = _views(batch)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x.tobytes() for x in text], pa.binary()), pa.array([x.tobytes() for x in meta], pa.binary())], ["doc_id", "y", "text", "meta"])


def columns(docs: DataFrame) -> DataFrame:
    """The columns that the views read; those that are missing count as null."""
    has = set(docs.columns)
    kinds = {"doc_id": "long", "text": "string", "source": "string", "lang": "string", "n_chars": "long"}
    return docs.select(*((F.col(x) if x in has else F.lit(None)).cast(k).alias(x) for x, k in kinds.items()))


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, rounds: int = ROUNDS) -> Model:
    return fitted(docs, labels, labelled, rounds)[0]


def fitted(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, rounds: int = ROUNDS) -> tuple[Model, list[int]]:
    """The model, and how many documents each view has been told by the other."""
    stash = Stash(docs.sparkSession)
    own = columns(docs).where("doc_id is not null")
    good = labels.where("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.col("quality").cast("double")).alias("y"))
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    stack = lambda frame, c, n: np.frombuffer(b"".join(frame[c]), np.float32).reshape(len(frame), n)

    def read(chosen: DataFrame, most: int):
        """Rows of few ids (doc_id, y) with both views, ``most`` at most: an id that repeats can't bring more."""
        rows = own.join(F.broadcast(chosen), "doc_id").select("doc_id", "y", "text", "source", "lang", "n_chars")
        rows = rows.mapInArrow(_sampled, "doc_id long, y double, text binary, meta binary").orderBy(*order, "text", "meta").limit(most)
        frame = rows.toPandas()
        return frame, stack(frame, "text", PAIRS + 4), stack(frame, "meta", META + 2)

    ids = own.select("doc_id").distinct()
    frame, text, meta = read(ids.join(good, "doc_id").orderBy(*order).limit(labelled), labelled)
    turn = 0

    def name(judges: Judges) -> Named:
        nonlocal turn
        turn += 1

        def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in parts(batches):
                said = judges.says(*_views(batch))
                kept = (said >= 0).any(1)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(kept)), *(pa.array(said[kept, v]) for v in (0, 1))], ["doc_id", "by_text", "by_meta"])

        said = stash.put(own.mapInArrow(judged, "doc_id long, by_text byte, by_meta byte").join(good.select("doc_id"), "doc_id", "left_anti"), f"said-{turn}")
        some = []
        for v, column in enumerate(("by_text", "by_meta")):
            # at most NAMED ids a class and round
            before = F.broadcast(docs.sparkSession.createDataFrame([(i,) for i in sorted(judges.before[v])], "doc_id long"))
            for k in (0, 1):
                fresh = said.where(F.col(column) == k).select("doc_id").distinct().join(before, "doc_id", "left_anti")
                some += [(r["doc_id"], v, k) for r in fresh.orderBy(*order).limit(NAMED).collect()]
        stash.drop(f"said-{turn}")
        if not some:
            return Named([], text[:0], meta[:0], np.zeros(0, int), np.zeros(0, int))
        wanted = docs.sparkSession.createDataFrame([(i,) for i in sorted({i for i, _, _ in some})], "doc_id long").withColumn("y", F.lit(None).cast("double"))
        rows, t, m = read(wanted, 8 * NAMED)
        at = {i: j for j, i in reversed(list(enumerate(rows["doc_id"])))}
        some = [x for x in some if x[0] in at]
        where = [at[i] for i, _, _ in some]
        return Named([i for i, _, _ in some], t[where], m[where], np.array([v for _, v, _ in some], int), np.array([k for _, _, k in some], int))

    return cotrain(text, meta, frame["y"].to_numpy(float), name, rounds)


def apply(docs: DataFrame, model: Model) -> DataFrame:
    """Each document's id, the calibrated scores of both views and together, and ``kept`` (together at least 0.5)."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            text, meta, both = model.scores(*_views(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (text, meta, both, both >= 0.5))], ["doc_id", "text_score", "meta_score", "score", "kept"])

    return columns(docs).mapInArrow(scored, "doc_id long, text_score double, meta_score double, score double, kept boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return apply(docs, fit(docs, table(spark, sf_dir, "labels")))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps, with all their columns."""
    model = fit(docs, table(spark, sf_dir, "labels"))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            yield batch.filter(pa.array(model.scores(*_views(batch))[2] >= 0.5))

    return docs.mapInArrow(kept, docs.schema)
