"""Quality rules: gradient-boosted trees over document statistics, flattened into node arrays, monotone in chosen statistics."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timeweave.llm.common import small_batches, written
from timeweave.llm.textbatch import ALNUM, WHITE, U, mixed, spans_sum, texts, words

#: Labelled documents that a fit reads at most, about, drawn by a hash of doc_id.
MAX_LABELLED = 8000
TREES, DEPTH, BINS, RATE, RIDGE = 80, 4, 32, 0.15, 2.0
THRESHOLD = 0.5

DIGIT, UPPER, LOWER_CASE, SYMBOL, ENDING = (np.zeros(256, bool) for _ in range(5))
DIGIT[48:58] = UPPER[65:91] = LOWER_CASE[97:123] = True
SYMBOL[[*b"#$%&*<>{}|\\^~_=+@!"]] = True
ENDING[[*b".!?\"':;)"]] = True
NOT_WHITE = ~WHITE
LETTER = ALNUM & ~DIGIT

STATISTICS = (
    "log_words", "mean_word_bytes", "longest_word", "letter_share", "digit_share", "upper_share", "symbol_share", "distinct_words", "top_word", "repeats_last_words",
    "repeated_lines", "ended_lines", "log_lines", "words_per_line", "wordless", "repeated_pairs", "repeated_fives", "log_bytes_per_line", "white_share",
)
#: Quality never rises with these.
FALLING = ("symbol_share", "repeats_last_words", "repeated_lines", "wordless", "repeated_pairs", "repeated_fives")


def _repeats(hashes: np.ndarray, doc: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text: different values, occurrences of the most frequent, occurrences of values that occur more than once."""
    if not len(hashes):
        none = np.zeros(docs)
        return none, none, none
    order = np.lexsort((hashes, doc))
    h, d = hashes[order], doc[order]
    first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])])
    n, owner = np.diff(np.r_[first, len(h)]), d[first]
    top = np.zeros(docs)
    np.maximum.at(top, owner, n)
    return np.bincount(owner, minlength=docs).astype(float), top, np.bincount(owner, n * (n > 1), minlength=docs)


def _sequences(w, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each n words of a text, and its text."""
    if len(w.hash) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = w.hash[: len(w.hash) - n + 1].copy()
    for k in range(1, n):
        h = mixed(h * U(0x9E3779B97F4A7C15) + w.hash[k : len(w.hash) - n + 1 + k])
    whole = w.doc[: len(h)] == w.doc[n - 1 :]
    return h[whole], w.doc[: len(h)][whole]


def statistics(column: pa.Array) -> np.ndarray:
    """STATISTICS of each text, one row each; all are 0 for null and empty texts."""
    out = np.zeros((len(column), len(STATISTICS)))
    for t in texts(column):
        data, docs = t.data, t.hi - t.lo
        size = np.diff(t.bounds)
        bytes_ = np.maximum(size, 1)

        def share(mask: np.ndarray) -> np.ndarray:
            return spans_sum(mask[data], t.bounds)

        w = words(t, NOT_WHITE)
        n = np.diff(w.first)
        some = np.maximum(n, 1)
        length = w.end - w.start
        longest = np.zeros(docs)
        np.maximum.at(longest, w.doc, length)
        letters = np.concatenate([[0], np.cumsum(LETTER[data])])
        last = np.zeros(len(w.hash))
        for lag in (1, 2):
            last[lag:] = np.maximum(last[lag:], (w.hash[lag:] == w.hash[:-lag]) & (w.doc[lag:] == w.doc[:-lag]))
        line = words(t, np.arange(256) != 10)
        lines = np.diff(line.first)
        many = np.maximum(lines, 1)
        ended = ENDING[data[np.maximum(line.end - 1, 0)]] if len(line.end) else np.zeros(0)
        different, top, _ = _repeats(w.hash, w.doc, docs)
        repeated_lines = _repeats(line.hash, line.doc, docs)[2]
        pairs, fives = _sequences(w, 2), _sequences(w, 5)
        upper, lower = share(UPPER), share(LOWER_CASE)
        columns = (
            np.log1p(n), spans_sum(length, w.first) / some, np.log1p(longest), share(LETTER) / bytes_, share(DIGIT) / bytes_, upper / np.maximum(upper + lower, 1), share(SYMBOL) / bytes_, different / some, top / some, spans_sum(last, w.first) / some,
            repeated_lines / many, spans_sum(ended, line.first) / many, np.log1p(lines), np.log1p(n / many), spans_sum(letters[w.end] == letters[w.start], w.first) / some,
            _repeats(*pairs, docs)[2] / np.maximum(n - 1, 1), _repeats(*fives, docs)[2] / np.maximum(n - 4, 1), np.log1p(size / many), share(WHITE) / bytes_,
        )
        out[t.lo : t.hi] = np.stack(columns, axis=1)
    return out


class Trees(NamedTuple):
    """Complete binary trees as arrays (tree, node): node k has children 2k+1 and 2k+2; value belongs to the last level.

    A row goes right if its statistic is greater than the threshold; a node that isn't split has an infinite one.
    """

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    base: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        """The logit of each row, all trees at once, level by level."""
        trees, inner = self.feature.shape
        tree, row = np.arange(trees), np.arange(len(x))[:, None]
        node = np.zeros((len(x), trees), np.int64)
        for _ in range(int(np.log2(inner + 1))):
            node = 2 * node + 1 + (x[row, self.feature[tree, node]] > self.threshold[tree, node])
        return self.base + self.value[tree, node - inner].sum(axis=1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -40, 40)))


def _edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Thresholds of each column: quantiles of its different values, BINS - 1 at most."""
    out = []
    for column in x.T:
        values = np.unique(column)
        middle = (values[1:] + values[:-1]) / 2
        middle = middle[middle < values[1:]] if len(middle) else middle
        out.append(np.unique(middle[np.linspace(0, len(middle) - 1, bins - 1).astype(int)]) if len(middle) > bins - 1 else middle)
    return out


def boost(x: np.ndarray, y: np.ndarray, signs: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> Trees:
    """Logistic boosting by second-order gains on histograms. signs: per column -1 (never rising), 1 (never falling) or 0.

    A split on a constrained column must order its children's values; both subtrees are then held on their sides of the
    middle between them, so that the whole tree, and the sum of the trees, is monotone.
    """
    edges = _edges(x, BINS)
    binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)])  # c <= edge k: bin k or lower
    inner, leaves = (1 << depth) - 1, 1 << depth
    feature, threshold, value = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    rate_of = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(rate_of / (1 - rate_of)))
    f = np.full(len(y), base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-f))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(len(y), np.int64)  # within the level
        low, high = np.full(1, -np.inf), np.full(1, np.inf)
        for level in range(depth):
            width = 1 << level
            best = np.zeros(width)
            choice = np.full((width, 2), -1)
            halves = np.zeros((width, 2))
            total_g, total_h = np.bincount(node, g, width), np.bincount(node, h, width)
            whole = total_g**2 / (total_h + RIDGE)
            for k, e in enumerate(edges):
                if not len(e):
                    continue
                at = node * BINS + binned[k]
                gl = np.cumsum(np.bincount(at, g, width * BINS).reshape(width, BINS), axis=1)[:, : len(e)]
                hl = np.cumsum(np.bincount(at, h, width * BINS).reshape(width, BINS), axis=1)[:, : len(e)]
                gr, hr = total_g[:, None] - gl, total_h[:, None] - hl
                a = np.clip(-gl / (hl + RIDGE), low[:, None], high[:, None])
                b = np.clip(-gr / (hr + RIDGE), low[:, None], high[:, None])
                gain = -2 * gl * a - (hl + RIDGE) * a**2 - 2 * gr * b - (hr + RIDGE) * b**2 - whole[:, None]
                gain[(hl < 1) | (hr < 1) | (signs[k] * (b - a) < 0)] = 0
                top = gain.argmax(axis=1)
                better = gain[np.arange(width), top] > best + 1e-9
                best[better] = gain[np.arange(width), top][better]
                choice[better, 0], choice[better, 1] = k, top[better]
                halves[better] = np.stack([a, b], axis=2)[np.arange(width), top][better]
            next_low, next_high = np.repeat(low, 2), np.repeat(high, 2)
            right = np.zeros(len(y), np.int64)
            for j in range(width):
                k, cut = choice[j]
                if k < 0:
                    continue
                feature[t, width - 1 + j], threshold[t, width - 1 + j] = k, edges[k][cut]
                rows = node == j
                right[rows] = binned[k][rows] > cut
                if signs[k]:
                    middle = halves[j].mean()
                    if signs[k] > 0:
                        next_high[2 * j], next_low[2 * j + 1] = min(next_high[2 * j], middle), max(next_low[2 * j + 1], middle)
                    else:
                        next_low[2 * j], next_high[2 * j + 1] = max(next_low[2 * j], middle), min(next_high[2 * j + 1], middle)
            node, low, high = 2 * node + right, next_low, next_high
        leaf = np.clip(-np.bincount(node, g, leaves) / (np.bincount(node, h, leaves) + RIDGE), low, high)
        leaf = np.where(np.isfinite(leaf), leaf, 0.0)
        value[t] = rate * leaf
        f = f + value[t][node]
    return Trees(feature, threshold, value, base)


def _narrow(docs: DataFrame) -> DataFrame:
    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Trees | None:
    """The trees of a bounded sample of labelled documents, drawn by a hash of doc_id.

    Null ids and labels other than 0 and 1 are left out, as are documents whose labels disagree. None: a class is missing.
    """
    known = labels.filter("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).filter("quality = other")
    known = written(known.select(F.col("doc_id").alias("tw_id"), F.col("quality").cast("double").alias("quality")), "rule-labels")
    n = known.count()
    draw = F.pmod(F.xxhash64("tw_id", F.lit(29)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = known.filter(draw < max_labelled / max(n, 1))  # about max_labelled rows whatever the input
    sample = _narrow(docs).join(F.broadcast(chosen), F.col("doc_id") == F.col("tw_id")).select("doc_id", "text", "quality")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = statistics(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "quality", "x"])

    rows = written(sample.mapInArrow(run, "doc_id long, quality double, x binary"), "rule-sample").toArrow().sort_by([("doc_id", "ascending"), ("x", "ascending")])
    y = rows["quality"].to_numpy()
    if not len(y) or y.min() == y.max():
        return None
    x = np.frombuffer(b"".join(rows["x"].to_pylist())).reshape(len(y), -1)
    return boost(x, y, np.array([-1 if s in FALLING else 0 for s in STATISTICS]))


SCHEMA = ", ".join(["doc_id long", "quality_score double", "keep boolean", *(f"{s} double" for s in STATISTICS)])


def score(docs: DataFrame, trees: Trees | None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, quality_score (probability of good quality), keep, and the STATISTICS, for every row of docs.

    docs: needs doc_id and text; other columns aren't read. Null and empty texts have statistics of 0 and are scored by them.
    Null ids stay null; equal rows are scored each. trees None keeps everything with score 1. An empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = statistics(batch.column(1))
            p = np.ones(len(x)) if trees is None else np.concatenate([np.zeros(0), *(trees.probability(x[lo : lo + 1024]) for lo in range(0, len(x), 1024))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array(p >= threshold), *(pa.array(np.ascontiguousarray(c)) for c in x.T)], [c.split()[0] for c in SCHEMA.split(", ")])

    return _narrow(docs).mapInArrow(run, SCHEMA)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
