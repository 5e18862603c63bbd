"""Quality classifier by co-training: one view reads the text, the other the document's metadata; each teaches the other."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from timeweave.llm.common import map_rows, small_batches, written
from timeweave.llm.textbatch import WHITE, spans_sum, texts, words

#: Labelled documents that a fit learns from at most, about, drawn by a hash of doc_id, and documents that a view may label in a round.
MAX_LABELLED, MAX_LENT = 4000, 400
#: Rounds of co-training; share of the unlabelled documents that a view may label in the first round, in the second twice that, and so on.
ROUNDS, SHARE = 5, 0.05
#: A view lends a label from the logit beyond which it is right in that share of at least so many held-out documents.
PRECISION, WITNESSES = 0.95, 10
#: What a lent label counts, where a true one counts 1.
WORTH = 0.25
#: Documents of lower combined probability are rejected.
THRESHOLD = 0.5
BUCKETS, SOURCES, LANGS = 1024, 64, 16
N_TEXT, N_META = BUCKETS + 3, SOURCES + LANGS + 6
PAIR = (np.random.default_rng(3).integers(0, BUCKETS, 65536)).astype(np.int64)


def text_view(column: pa.Array) -> np.ndarray:
    """One row per text: square roots of the shares of its hashed byte pairs, share of words that repeat the word before,
    share that repeat the one before that, and whether there is any word."""
    out = np.zeros((len(column), N_TEXT), np.float32)
    for t in texts(column):
        n, docs = len(t.data), t.hi - t.lo
        if not n:
            continue
        pair = PAIR[(t.data[:-1].astype(np.int64) << 8) | t.data[1:]]
        doc = np.repeat(np.arange(docs), np.diff(t.bounds))
        within = doc[:-1] == doc[1:]  # a text's last byte and the next one's first are no pair
        count = np.bincount((doc[:-1] * BUCKETS + pair)[within], minlength=docs * BUCKETS).reshape(docs, BUCKETS)
        out[t.lo : t.hi, :BUCKETS] = np.sqrt(count / np.maximum(count.sum(axis=1, keepdims=True), 1))
        w = words(t, WHITE_OFF)
        many = np.maximum(np.diff(w.first), 1)
        for lag in (1, 2):
            same = np.zeros(len(w.hash))
            same[lag:] = (w.hash[lag:] == w.hash[:-lag]) & (w.doc[lag:] == w.doc[:-lag])
            out[t.lo : t.hi, BUCKETS + lag - 1] = spans_sum(same, w.first) / many
        out[t.lo : t.hi, BUCKETS + 2] = np.diff(w.first) > 0
    return out


WHITE_OFF = ~WHITE


def _bucket(value: str | None, n: int) -> int:
    return 0 if value is None else 1 + zlib.crc32(value.encode()) % (n - 1)


def meta_view(text: pa.Array, lang: pa.Array, source: pa.Array, n_chars: pa.Array) -> np.ndarray:
    """One row per document: hashed language and source (bucket 0: null), and its layout: logarithms of n_chars, lines, bytes
    per line, words per line, bytes per character, and whether n_chars is null."""
    n = len(text)
    out = np.zeros((n, N_META), np.float32)
    for column, at, size in ((source, 0, SOURCES), (lang, SOURCES, LANGS)):
        coded = column.dictionary_encode()
        values = [_bucket(v, size) for v in coded.dictionary.to_pylist()] or [0]
        index = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        out[np.arange(n), at + np.where(index < 0, 0, np.array(values)[index])] = 1
    at = SOURCES + LANGS
    chars = pc.fill_null(n_chars.cast(pa.float64()), 0).to_numpy(zero_copy_only=False)
    chars = np.maximum(chars, 0)
    out[:, at] = np.log1p(chars)
    out[:, at + 5] = n_chars.is_null().to_numpy(zero_copy_only=False)
    for t in texts(text):
        size = np.diff(t.bounds)
        line = np.concatenate([[0], np.cumsum(t.data == 10)])
        lines = line[t.bounds[1:]] - line[t.bounds[:-1]] + 1
        space = np.concatenate([[0], np.cumsum(WHITE[t.data])])
        gaps = space[t.bounds[1:]] - space[t.bounds[:-1]] + 1
        rest = np.concatenate([[0], np.cumsum((t.data & 0xC0) == 0x80)])
        real = np.maximum(size - (rest[t.bounds[1:]] - rest[t.bounds[:-1]]), 1)
        out[t.lo : t.hi, at + 1] = np.log(lines)
        out[t.lo : t.hi, at + 2] = np.log1p(size / lines)
        out[t.lo : t.hi, at + 3] = np.log(gaps / lines)
        out[t.lo : t.hi, at + 4] = size / real
    return out


@dataclass
class View:
    """Logistic regression with its calibration: logit = slope * (scaled x . weights + bias) + shift."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ (self.weights / self.scale) + self.bias

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.slope * self.raw(x) + self.shift, -30, 30)


@dataclass
class Model:
    text: View
    meta: View
    weights: tuple[float, float, float]  # of the views' logits, and a shift

    def probability(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the text view, of the metadata view, and of both."""
        a, b = self.text.logit(text), self.meta.logit(meta)
        return sigmoid(a), sigmoid(b), sigmoid(self.weights[0] * a + self.weights[1] * b + self.weights[2])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def logistic(x: np.ndarray, y: np.ndarray, worth: np.ndarray, ridge: float = 1e-3, steps: int = 150) -> View:
    """Ridge logistic regression by accelerated gradient steps on standardised columns. worth: the rows' weights, 1 at most."""
    part = (worth / worth.sum()).astype(np.float32)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = ((x - mean) / scale).astype(np.float32)
    v = np.random.default_rng(0).normal(size=z.shape[1]).astype(np.float32)
    for _ in range(12):  # largest eigenvalue, for the step
        v = z.T @ (z @ v)
        v /= np.linalg.norm(v) + 1e-12
    step = 1 / (0.25 * float(np.linalg.norm(z @ v) ** 2) * float(part.max()) + 0.25 + ridge)
    w = ahead = np.zeros(z.shape[1] + 1, np.float32)
    for k in range(steps):
        error = (sigmoid(z @ ahead[:-1] + ahead[-1]) - y) * part
        g = np.r_[z.T @ error.astype(np.float32) + ridge * ahead[:-1], error.sum()].astype(np.float32)
        new = ahead - step * g
        ahead = new + k / (k + 3) * (new - w)
        w = new
    return View(mean.astype(np.float64), scale.astype(np.float64), w[:-1].astype(np.float64), float(w[-1]))


def calibrated(view: View, x: np.ndarray, y: np.ndarray) -> View:
    """Platt's slope and shift on held-out rows, by Newton steps with smoothed targets."""
    f = view.raw(x)
    good, bad = y.sum(), (1 - y).sum()
    target = np.where(y > 0.5, (good + 1) / (good + 2), 1 / (bad + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = sigmoid(a * f + b)
        d, h = p - target, p * (1 - p)
        g = np.array([(d * f).sum() + 1e-3 * (a - 1), d.sum()])
        m = np.array([[(h * f * f).sum() + 1e-3, (h * f).sum()], [(h * f).sum(), h.sum() + 1e-3]])
        move = np.clip(np.linalg.solve(m, g), -1, 1)
        a, b = a - move[0], b - move[1]
        if np.abs(move).max() < 1e-6:
            break
    view.slope, view.shift = max(a, 1e-3), b
    return view


def loss(view: View, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The logistic loss of a calibrated view for each row."""
    return np.logaddexp(0, np.where(y > 0.5, -1, 1) * view.logit(x))


def least_logits(view: View, x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """For bad and for good: the size of the logit from which the view may lend that label, by its precision on held-out rows; inf: never."""
    logit, out = view.logit(x), []
    for label in (0.0, 1.0):
        sure = logit if label else -logit
        order = np.argsort(-sure, kind="stable")
        right = np.cumsum(y[order] == label)
        n = np.arange(1, len(order) + 1)
        ok = np.flatnonzero(((right + 1) / (n + 2) >= PRECISION - 1 / (n + 2)) & (n >= WITNESSES) & (sure[order] > 0))
        out.append(float(sure[order[ok[-1]]]) if len(ok) else np.inf)
    return out[0], out[1]


def co_train(text: np.ndarray, meta: np.ndarray, y: np.ndarray, fold: np.ndarray, rounds: int = ROUNDS) -> Model | None:
    """y: 1 good, 0 bad, -1 unlabelled. fold: rows whose hash makes them the quarter for calibration, if labelled.

    As `fit`, over arrays. None if the rows to learn from or those to calibrate by lack a class.
    """
    held, learn, pool = (y >= 0) & fold, (y >= 0) & ~fold, np.flatnonzero(y < 0)
    x = (text, meta)

    def lend(views: list[View], least: list[tuple[float, float]], share: float, times: int) -> list[Lent]:
        out = []
        for k in (0, 1):
            logit = views[k].logit(x[k][pool])
            for label, part in ((0, 1 - share), (1, share)):
                sure = logit if label else -logit
                rows = np.flatnonzero(sure >= least[k][label])
                rows = pool[rows[np.argsort(-sure[rows], kind="stable")][: max(1, int(len(pool) * SHARE * times * part))]]
                out.append(Lent(1 - k, float(label), x[1 - k][rows]))
        return out

    return taught((text[learn], meta[learn]), y[learn], (text[held], meta[held]), y[held], lend, rounds)


class Lent(NamedTuple):
    """Rows that the other view labels for `view`."""

    view: int
    label: float
    rows: np.ndarray


def taught(x: tuple, y: np.ndarray, held_x: tuple, held_y: np.ndarray, lend: Callable, rounds: int) -> Model | None:
    """The model of labelled rows of both views, calibrated by held ones, and of what `lend` gives.

    In each round, lend is asked for what the views as they are label for each other: it gets the views, the logits from which each
    may lend each label, the share of good rows, and the number of the round. Labels lent before are not kept: those the lender is no longer sure
    of are gone. A view that learned from lent labels takes the old one's place if its loss on the held rows is less by more than a standard
    error; once neither's is, the rounds end. None if the rows to learn from or those to calibrate by lack a class.
    """
    if any(not len(v) or not 0 < v.sum() < len(v) for v in (y, held_y)):
        return None

    def learned(k: int, lent: list[Lent]) -> View:
        rows = np.concatenate([x[k], *(g.rows for g in lent)])
        labels = np.concatenate([y, *(np.full(len(g.rows), g.label) for g in lent)])
        worth = np.concatenate([np.ones(len(y)), np.full(len(rows) - len(y), WORTH)])
        return calibrated(logistic(rows, labels, worth), held_x[k], held_y)

    views = [learned(k, []) for k in (0, 1)]
    losses = [loss(views[k], held_x[k], held_y) for k in (0, 1)]
    for r in range(rounds):
        least = [least_logits(views[k], held_x[k], held_y) for k in (0, 1)]
        given = [g for g in lend(views, least, float(y.mean()), r + 1) if len(g.rows)] if np.isfinite(least).any() else []
        better = False
        for k in {g.view for g in given}:
            view = learned(k, [g for g in given if g.view == k])
            now = loss(view, held_x[k], held_y)
            gain = losses[k] - now
            if gain.mean() > gain.std() / np.sqrt(len(gain)):
                views[k], losses[k], better = view, now, True
        if not better:
            break
    return Model(views[0], views[1], combined(views[0].logit(held_x[0]), views[1].logit(held_x[1]), held_y))


def combined(a: np.ndarray, b: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Weights of two calibrated logits and a shift, fitted to held-out rows; none is negative.

    The pull, of the weight of one row, is towards what would be right for views that are independent given the class: the sum of both less the prior."""
    aim = np.array([1.0, 1.0, -np.log(y.sum() / (1 - y).sum())])
    z, w = np.stack([a, b, np.ones(len(a))], axis=1), aim.copy()
    free = np.ones(3, bool)
    for _ in range(200):
        p = sigmoid(z @ w)
        g = z.T @ (p - y) + (w - aim)
        free[:2] = (w[:2] > 0) | (g[:2] < 0)  # a weight at 0 that would fall stays there
        h = (z.T * (p * (1 - p))) @ z + np.eye(3)
        move = np.zeros(3)
        move[free] = np.clip(np.linalg.solve(h[np.ix_(free, free)], g[free]), -1, 1)
        w = w - move
        w[:2] = np.maximum(w[:2], 0)
        if np.abs(move).max() < 1e-6:
            break
    return float(w[0]), float(w[1]), float(w[2])


def _columns(docs: DataFrame) -> DataFrame:
    def column(name: str, kind: str):
        return (F.col(name) if name in docs.columns else F.lit(None)).cast(kind).alias(name)

    return small_batches(docs).select(column("doc_id", "long"), column("text", "string"), column("lang", "string"), column("source", "string"), column("n_chars", "double"))


def _views(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, text, lang, source, n_chars, other = batch.columns
        x = text_view(text).astype(np.float16)
        m = meta_view(text, lang, source, n_chars)
        yield pa.RecordBatch.from_arrays([ids, other, pa.array([r.tobytes() for r in x], pa.binary()), pa.array([r.tobytes() for r in m], pa.binary())], ["doc_id", "other", "x", "m"])


def _arrays(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(b"".join(rows["x"].to_pylist()), np.float16).reshape(-1, N_TEXT).astype(np.float32)
    return x, np.frombuffer(b"".join(rows["m"].to_pylist()), np.float32).reshape(-1, N_META)


def _keyed(docs: DataFrame) -> DataFrame:
    """The columns and a key of what is in them: equal documents, which have equal views, share one."""
    return _columns(docs).withColumn("key", F.xxhash64("doc_id", "text", "lang", "source", "n_chars"))


def _sure(views: list[View], least: list[tuple[float, float]]):
    """A row for each document and view that may lend it a label: its key with the label (2 * view + label), and the logit's size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, key, places, *columns = batch.columns
            for lo in range(0, batch.num_rows, 1024):
                piece = [c.slice(lo, 1024) for c in columns]
                for k, view in enumerate((text_view, meta_view)):
                    if not np.isfinite(least[k]).any():
                        continue
                    logit = views[k].logit(view(piece[0]) if view is text_view else view(*piece))
                    good = logit > 0
                    at = np.flatnonzero(np.abs(logit) >= np.where(good, least[k][1], least[k][0]))
                    take = pa.array(at + lo)
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(take), key.take(take), places.take(take), pa.array((2 * k + good[at]).astype(np.int32)), pa.array(np.abs(logit[at]))],
                        ["doc_id", "key", "place", "label", "sure"],
                    )

    return run


def surest(docs: DataFrame, known: DataFrame, views: list[View], least: list[tuple[float, float]], most: list[int]) -> dict[int, list[int]]:
    """Keys of the documents without a label that each view is surest of, for each label (2 * view + label), `most` of that label at most.

    Every document is scored; least: the logits from which a view may lend. Sources and languages take turns: the surest of each
    before the second of any.
    """
    rows = _keyed(docs).select("doc_id", "key", F.xxhash64("source", "lang").alias("place"), "text", "lang", "source", "n_chars")
    scored = rows.mapInArrow(_sure(views, least), "doc_id long, key long, place long, label int, sure double")
    free = scored.join(known.select("doc_id"), "doc_id", "left_anti")
    turn = F.row_number().over(W.partitionBy("label", "place").orderBy(F.desc("sure"), "key"))
    first = free.withColumn("turn", turn).filter(F.col("turn") <= max(most))
    rank = F.row_number().over(W.partitionBy("label").orderBy("turn", F.desc("sure"), "key"))
    out: dict[int, list[int]] = {}
    for r in first.withColumn("rank", rank).filter(F.col("rank") <= max(most)).orderBy("label", "rank").select("label", "key", "rank").collect():
        if r["rank"] <= most[r.label]:
            out.setdefault(r.label, []).append(r.key)
    return out


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, max_lent: int = MAX_LENT, rounds: int = ROUNDS) -> Model | None:
    """The model of a bounded sample of the labelled documents, drawn by a hash of doc_id, and of all documents without a label.

    In each round both views score every unlabelled document and label those they are surest of for each other: only beyond the logit at
    which held-out documents show that they are right, max_lent and SHARE of them at most in the first round (k times that in round k), in the classes' proportions.
    See `taught` for what becomes of lent labels. Null ids and labels other than 0 and 1 are left out, as are documents
    whose labels disagree; those count as unlabelled, and so do documents without an id. Labelled documents that aren't drawn
    take no part. None: too few labels of a class.
    """
    known = labels.filter("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).filter("quality = other")
    known = written(known.select("doc_id", F.col("quality").cast("long").alias("quality")), "quality-labels")
    n_known, n_docs = known.count(), docs.count()
    if not n_known or not n_docs:
        return None
    draw = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = known.filter(draw < max_labelled / n_known)  # about max_labelled rows: small whatever the input
    sample = _columns(docs).join(F.broadcast(chosen), "doc_id")
    wide = "doc_id long, other long, x binary, m binary"
    rows = written(sample.select("doc_id", "text", "lang", "source", "n_chars", "quality").mapInArrow(_views, wide), "quality-sample").toArrow().sort_by([("doc_id", "ascending")])
    if not rows.num_rows:
        return None
    x = _arrays(rows)
    y = rows["other"].cast(pa.float64()).to_numpy()
    fold = np.array([zlib.crc32(b"fold%d" % i) % 4 == 0 for i in rows["doc_id"].to_pylist()])
    n_pool = max(n_docs - n_known, 1)

    def lend(views: list[View], least: list[tuple[float, float]], share: float, times: int) -> list[Lent]:
        room = min(max_lent, n_pool * SHARE) * times
        keys = surest(docs, known, views, least, [max(1, int(room * s)) for s in (1 - share, share)] * 2)
        picked = docs.sparkSession.createDataFrame([(k,) for k in sorted({k for v in keys.values() for k in v})], "key long")
        found = _keyed(docs).join(F.broadcast(picked), "key").select("doc_id", "text", "lang", "source", "n_chars", "key")
        rows = found.dropDuplicates(["key"]).mapInArrow(_views, wide).toArrow()
        both, at = _arrays(rows), {k: i for i, k in enumerate(rows["other"].to_pylist())}
        return [Lent(1 - label // 2, float(label % 2), both[1 - label // 2][[at[key] for key in dict.fromkeys(chosen_keys)]]) for label, chosen_keys in sorted(keys.items())]

    return taught((x[0][~fold], x[1][~fold]), y[~fold], (x[0][fold], x[1][fold]), y[fold], lend, rounds)


SCHEMA = "doc_id long, p_text double, p_meta double, quality_score double, keep boolean"


def _score_arrays(model: Model | None, text, lang, source, n_chars) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(text)
    if model is None:
        return np.ones(n), np.ones(n), np.ones(n)
    done = [np.zeros((0,))] * 0
    for lo in range(0, n, 1024):
        s = slice(lo, min(lo + 1024, n))
        piece = [c.slice(s.start, s.stop - s.start) for c in (text, lang, source, n_chars)]
        done.append(np.stack(model.probability(text_view(piece[0]), meta_view(*piece))))
    p = np.concatenate(done, axis=1) if done else np.zeros((3, 0))
    return p[0], p[1], p[2]


def score(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, p_text, p_meta, quality_score (both views) and keep, for every row of docs.

    docs: doc_id and text, and lang, source, n_chars where it has them; missing columns and nulls are a value of their own.
    A null or empty text is scored by its metadata and as a text without words. model None keeps everything with score 1.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, p = _score_arrays(model, *batch.columns[1:])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(a), pa.array(b), pa.array(p), pa.array(p >= threshold)], [c.split()[0] for c in SCHEMA.split(", ")])

    return _columns(docs).mapInArrow(run, SCHEMA)


def keep_good(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that `score` keeps, with all their columns, in one pass without a join."""
    names = docs.columns
    kinds = {"text": pa.string(), "lang": pa.string(), "source": pa.string(), "n_chars": pa.float64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            views = [batch.column(names.index(c)).cast(k) if c in names else pa.nulls(batch.num_rows, k) for c, k in kinds.items()]
            p = _score_arrays(model, *views)[2]
            yield batch.filter(pa.array(p >= threshold))

    return map_rows(docs, run)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`score` of all documents by a model fitted to the labelled ones among them."""
    return score(docs, fit(docs, labels))


def query(spark, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
