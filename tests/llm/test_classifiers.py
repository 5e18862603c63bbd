import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from timeweave.llm import quality as Q
from timeweave.llm import rules as R


@pytest.fixture(scope="module")
def held_out(spark):
    """Documents with labels: a part to fit on, a part that isn't looked at until the end."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    test = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    return docs, labels.filter(~test), {r.doc_id: r.quality for r in labels.filter(test).collect()}


def accuracies(rows, truth):
    good = [r.keep for r in rows if truth.get(r.doc_id) == 1]
    bad = [not r.keep for r in rows if truth.get(r.doc_id) == 0]
    return np.mean(good), np.mean(bad)


def test_co_training_on_held_out_documents(held_out):
    docs, labels, truth = held_out
    rows = Q.classify(docs, labels).collect()
    good, bad = accuracies(rows, truth)
    plain = Q.score(docs, Q.fit(docs, labels, rounds=0)).collect()
    assert len(rows) == docs.count() and good >= 0.97 and bad >= accuracies(plain, truth)[1] and good >= accuracies(plain, truth)[0] - 0.01
    assert all(0 <= r.quality_score <= 1 and r.keep == (r.quality_score >= Q.THRESHOLD) for r in rows)


@pytest.fixture(scope="module")
def arrays():
    """Both views, labels (-1: none) and ids of the documents of sf0.1."""
    import pyarrow.parquet as pq

    d = pq.read_table("/root/testdata/sf0.1/documents.parquet").combine_chunks()
    labels = pq.read_table("/root/testdata/sf0.1/labels.parquet").to_pydict()
    known = dict(zip(labels["doc_id"], labels["quality"]))
    text, lang, source, n_chars = (d[c].combine_chunks() for c in ("text", "lang", "source", "n_chars"))
    text, lang, source, n_chars = (c.chunk(0) if hasattr(c, "chunk") else c for c in (text, lang, source, n_chars))
    ids = d["doc_id"].to_pylist()
    return Q.text_view(text), Q.meta_view(text, lang, source, n_chars), np.array([known.get(i, -1) for i in ids], float), ids


def split(ids, name, parts):
    import zlib

    return np.array([zlib.crc32(b"%s%d" % (name, i)) % parts for i in ids])


@pytest.mark.parametrize("part", range(4))
def test_rounds_do_no_harm_with_many_labels(arrays, part):
    """A quarter of the labels held out: at least 97 % of the bad documents are rejected, with rounds as without."""
    text, meta, y, ids = arrays
    test = (split(ids, b"test", 4) == part) & (y >= 0)
    got = []
    for rounds in (0, Q.ROUNDS):
        model = Q.co_train(text, meta, np.where(test, -1, y), split(ids, b"fold", 4) == 0, rounds=rounds)
        p = model.probability(text[test], meta[test])[2]
        got.append((np.mean(p[y[test] == 0] < 0.5), np.mean(p[y[test] == 1] >= 0.5)))
    assert got[1][0] >= 0.97 and got[1][1] >= 0.985 and got[1][0] >= got[0][0] - 0.01 and got[1][1] >= got[0][1] - 0.01


def test_both_views_count_with_few_labels(arrays):
    """Of a tenth of the labels: both views together reject more bad documents than the text alone, and rounds take nothing away."""
    text, meta, y, ids = arrays
    both, alone, before, weights = [], [], [], []
    for k in range(4):
        known = (y >= 0) & (split(ids, b"pick%d-" % k, 1 << 32) < (1 << 32) // 10)
        test = (y >= 0) & ~known
        bad = y[test] == 0
        model, plain = (Q.co_train(text, meta, np.where(known, y, -1), split(ids, b"fold", 4) == 0, rounds=r) for r in (Q.ROUNDS, 0))
        weights.append(model.weights[1])
        p = model.probability(text[test], meta[test])
        both.append(np.mean(p[2][bad] < 0.5))
        alone.append(np.mean(p[0][bad] < 0.5))
        before.append(np.mean(plain.probability(text[test], meta[test])[2][bad] < 0.5))
    print("metadata weights", weights)
    assert sum(w > 0 for w in weights) >= 2 and np.mean(both) >= np.mean(alone) + 0.05 and np.mean(both) >= np.mean(before) - 0.005


def test_labels_are_lent_where_held_out_documents_say_so():
    """A view that is right above 2 and guesses below lends good from 2 on, and never bad."""
    view = Q.View(np.zeros(1), np.ones(1), np.ones(1), 0.0)
    x = np.linspace(-4, 4, 400)[:, None]
    y = np.where(x[:, 0] > 2, 1.0, np.arange(400) % 2)
    bad, good = Q.least_logits(view, x, y)
    assert bad == np.inf and 1.5 < good <= 2.1
    assert Q.least_logits(view, x[:5], y[:5]) == (np.inf, np.inf)


def naive_scores(model, text, meta):
    """The model's answer, a document and a column at a time."""
    out = []
    for t, m in zip(text, meta):
        logits = []
        for view, row in ((model.text, t), (model.meta, m)):
            raw = view.bias
            for value, mean, scale, weight in zip(row, view.mean, view.scale, view.weights):
                raw += (value - mean) / scale * weight
            logits.append(min(30, max(-30, view.slope * raw + view.shift)))
        out.append(1 / (1 + np.exp(-(model.weights[0] * logits[0] + model.weights[1] * logits[1] + model.weights[2]))))
    return out


def naive_text(text):
    """The text view by its definition, from the bytes of one text."""
    data = text.encode()
    row = np.zeros(Q.N_TEXT)
    for a, b in zip(data, data[1:]):
        row[Q.PAIR[a << 8 | b]] += 1
    if len(data) > 1:
        row = np.sqrt(row / row.sum())
    words = re.findall(rb"[^ \t\n\r\f\v]+", data)
    for lag in (1, 2):
        row[Q.BUCKETS + lag - 1] = sum(words[i] == words[i - lag] for i in range(lag, len(words))) / max(1, len(words))
    row[Q.BUCKETS + 2] = bool(words)
    return row


def test_query_against_one_document_at_a_time(spark, sf_dir):
    """Every score of the query, from texts by a loop over bytes, words and columns."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = Q.fit(docs, labels)
    rows = docs.select("doc_id", "text", "lang", "source", "n_chars").toArrow().slice(0, 60).combine_chunks()
    text, lang, source, n_chars = (rows[c].combine_chunks() for c in ("text", "lang", "source", "n_chars"))
    text, lang, source, n_chars = (c.chunk(0) if hasattr(c, "chunk") else c for c in (text, lang, source, n_chars))
    got = {r.doc_id: r.quality_score for r in Q.score(docs, model).collect()}
    want = naive_scores(model, [naive_text(t.as_py()) for t in text], Q.meta_view(text, lang, source, n_chars))
    assert [got[i] for i in rows["doc_id"].to_pylist()] == pytest.approx(want, abs=2e-3)


def test_rules_on_held_out_documents(held_out):
    docs, labels, truth = held_out
    rows = R.score(docs, R.fit(docs, labels)).collect()
    good, bad = accuracies(rows, truth)
    assert len(rows) == docs.count() and good >= 0.97 and bad >= 0.8


def test_views_teach_each_other():
    """With few labels, pseudo-labels of the other view add to what a view knows."""
    rng = np.random.default_rng(0)
    n = 1200
    y = rng.integers(0, 2, n).astype(float)
    text = (rng.normal(size=(n, Q.N_TEXT)) * 0.5).astype(np.float32)
    meta = (rng.normal(size=(n, Q.N_META)) * 0.5).astype(np.float32)
    text[:, :20] += 0.3 * (2 * y - 1)[:, None]
    meta[:, :3] += 1.5 * (2 * y - 1)[:, None]
    known = np.where(np.arange(n) < 60, y, -1)
    fold = np.arange(n) % 3 == 0
    right = lambda m: ((m.probability(text, meta)[0] > 0.5) == y)[60:].mean()
    assert right(Q.co_train(text, meta, known, fold)) > right(Q.co_train(text, meta, known, fold, rounds=0)) + 0.02
    assert Q.co_train(text, meta, np.where(known == 1, 1.0, -1.0), fold) is None


def test_every_unlabelled_document_may_be_lent(docs_of, spark):
    """Of many documents of a hot source and five of a small one, the small one's are lent too; labelled ones never are."""
    rows = [(k, f"text {k} of it", "hot") for k in range(9000)] + [(9000 + k, f"other {k}", "small") for k in range(5)]
    docs = docs_of(rows)
    known = spark.createDataFrame([(k, 1) for k in range(3000)] + [(9000, 1)], "doc_id long, quality long")
    views = [Q.View(np.zeros(n), np.ones(n), np.zeros(n), 5.0) for n in (Q.N_TEXT, Q.N_META)]
    keys = {r.key: r.doc_id for r in Q._keyed(docs).select("key", "doc_id").collect()}
    got = Q.surest(docs, known, views, [(3.0, 3.0)] * 2, [10, 20, 10, 20])
    assert sorted(got) == [1, 3] and all(len(v) == 20 for v in got.values())
    for v in got.values():
        ids = {keys[k] for k in v}
        assert {9001, 9002, 9003, 9004} <= ids and not ids & {9000, *range(3000)}
    assert sorted(Q.surest(docs, known, views, [(3.0, np.inf), (3.0, 3.0)], [10, 20, 10, 20])) == [3]


def test_quality_of_odd_rows(docs_of, spark):
    docs = docs_of([(1, "a b c"), (1, "a b c"), (None, "x"), (2, None), (3, ""), (4, "word " * 100_000)], quality=F.lit(5), P_TEXT=F.lit(1)).withColumn("a.b", F.lit(1))
    rows = [(k, k % 2, 0) for k in range(1, 5)] + [(None, 1, 0), (1, 0, 0), (2, 7, None)]
    labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    for model in (None, Q.fit(docs, labels)):
        got = Q.score(docs, model).collect()
        assert sorted((r.doc_id or 0) for r in got) == [0, 1, 1, 2, 3, 4]
        assert Q.keep_good(docs, model).columns == docs.columns
    assert Q.keep_good(docs, None).count() == 6 and Q.classify(docs.limit(0), labels).count() == 0 and Q.fit(docs, labels.limit(0)) is None


def naive(text):
    words = text.split()
    pairs = [tuple(words[i : i + 2]) for i in range(len(words) - 1)]
    lines = [x for x in text.split("\n") if x]
    return {
        "log_words": np.log1p(len(words)), "mean_word_bytes": np.mean([len(w.encode()) for w in words]), "longest_word": np.log1p(max(len(w.encode()) for w in words)), "distinct_words": len(set(words)) / len(words),
        "top_word": max(words.count(w) for w in words) / len(words), "repeated_pairs": sum(pairs.count(p) > 1 for p in pairs) / max(1, len(pairs)), "repeated_lines": sum(lines.count(x) > 1 for x in lines) / len(lines),
        "repeats_last_words": sum(i > 0 and words[i] == words[i - 1] or i > 1 and words[i] == words[i - 2] for i in range(len(words))) / len(words),
        "ended_lines": sum(x[-1] in ".!?\"':;)" for x in lines) / len(lines), "log_lines": np.log1p(len(lines)), "symbol_share": sum(c in "#$%&*<>{}|\\^~_=+@!" for c in text) / len(text.encode()), "wordless": sum(not any(c.isalpha() for c in w) for w in words) / len(words),
    }


def test_statistics_by_their_definition():
    texts = ["One two two three.\nOne two two three.\nend", "x", "été 12 ### été\n\n12 ab cd ab cd ab", "a b a b a b a b a b"]
    got = R.statistics(pa.array(texts + [None, ""]))
    for t, row in zip(texts, got):
        for name, value in naive(t).items():
            assert row[R.STATISTICS.index(name)] == pytest.approx(value), (t, name)
    assert not got[4:].any()


def walk(trees, t, row):
    node = 0
    while node < trees.feature.shape[1]:
        node = 2 * node + (2 if row[trees.feature[t, node]] > trees.threshold[t, node] else 1)
    return trees.value[t, node - trees.feature.shape[1]]


def test_trees_flattened_and_monotone():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(800, 5))
    y = (np.sin(2 * x[:, 0]) - x[:, 1] + x[:, 2] * x[:, 3] + rng.normal(size=800) * 0.4 > 0).astype(float)
    signs = np.array([0, -1, 0, 0, 1])
    trees = R.boost(x, y, signs, trees=40)
    assert ((trees.probability(x) >= 0.5) == y).mean() > 0.9
    for row in x[:40]:
        assert trees.raw(row[None])[0] == pytest.approx(trees.base + sum(walk(trees, t, row) for t in range(40)))
    for k in (1, 4):
        for row in x[:60]:
            line = np.repeat(row[None], 50, axis=0)
            line[:, k] = np.linspace(-4, 4, 50)
            assert (signs[k] * np.diff(trees.raw(line)) >= -1e-12).all()


def test_rules_of_odd_rows(docs_of, spark):
    docs = docs_of([(1, "a b c"), (1, "a b c"), (None, "x"), (2, None), (3, ""), (4, "word " * 100_000)], quality_score=F.lit(5), TW_ID=F.lit(1))
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (4, 1), (None, 1), (3, 1)], "doc_id long, quality int")
    for trees in (None, R.fit(docs, labels)):
        got = R.score(docs, trees).collect()
        assert sorted((r.doc_id or 0) for r in got) == [0, 1, 1, 2, 3, 4]
    assert R.fit(docs, labels.limit(0)) is None and R.score(docs.limit(0), None).count() == 0
