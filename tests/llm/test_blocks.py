import numpy as np
import pytest
from pyspark.sql import functions as F

from timeweave.llm import blocks as B


def test_blocks_of_a_page():
    page = '<html><head><title>no</title><script>var t="</p><p>no";</script><style>p{}</style></head><body><!-- <p>no --><nav><ul><li><a href="/x">Home</a><li>Two</ul></nav><p>One <b>bold<br>line &amp; more<p>Next</div><article class="post x"><h1>T</h1>loose<!-- unclosed'
    got = [(b.text, "/".join(n for n, _ in reversed(b.path)), b.linked) for b in B.blocks(page)]
    assert got == [("Home", "html/body/nav/ul/li", 4), ("Two", "html/body/nav/ul/li", 0), ("One bold line & more", "html/body/p", 0), ("Next", "html/body/p", 0), ("T", "html/body/article/h1", 0), ("loose", "html/body/article", 0)]


def test_labels_and_vectors_know_the_whole_path():
    """However deep a block is; the header of an article is content, that of the page isn't; a self-closed svg ends where it does."""
    label = lambda page: [B.distant_label(b) for b in B.blocks(page)]
    assert label("<article>" + "<div>" * 5000 + "text") == [1] and label("<nav>" + "<div>" * 50 + "text") == [0] and label("<div>text") == [-1]
    assert label("<header>site</header><article><header><h1>Title</h1></header><p>x</p><footer>by</footer></article>") == [0, 1, 1, 0]
    assert [b.text for b in B.blocks('<p>a <svg class="i" /> b</p><p>c</p><svg><path/></svg>d')] == ["a b", "c", "d"]
    deep = [B.path_vector(B.blocks(f"<{top}>" + "<div>" * 9 + "text")[0].within) for top in ("article", "nav")]
    assert not np.allclose(*deep)
    hidden = [B.path_vector(B.blocks(f"<{top}>" + "<div>" * 9 + "text")[0].within, True) for top in ("article", "nav")]
    assert np.allclose(*hidden)


def test_many_blocks_in_deep_nesting():
    page = B.blocks("".join(f"<div><p>block {k}</p>" for k in range(20_000)))
    assert len(page) == 20_000 and np.isfinite(B.features([page], {}, B.word_table())).all()


def naive_probabilities(model, x):
    """Both directions, a block and a gate at a time."""
    s = lambda v: 1 / (1 + np.exp(-v))
    z, n = (x - model.mean) / model.scale, B.HIDDEN
    logits = np.full(len(x), float(model.p["ob"][0]))
    for d, order in (("f", range(len(x))), ("r", range(len(x) - 1, -1, -1))):
        h = c = np.zeros(n)
        for t in order:
            a = z[t] @ model.p[f"{d}x"] + h @ model.p[f"{d}h"] + model.p[f"{d}b"]
            i, f, o, g = s(a[:n]), s(a[n : 2 * n]), s(a[2 * n : 3 * n]), np.tanh(a[3 * n :])
            c = f * c + i * g
            h = o * np.tanh(c)
            logits[t] += h @ model.p[f"o{d}"]
    return s(logits)


def test_query_against_a_naive_forward_pass(spark, sf_dir):
    """The texts that the query extracts, from probabilities of pages one by one."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    model = B.fit(pages)
    got = {r.page_id: r for r in B.extract(pages, model).collect()}
    for r in pages.collect():
        page = B.blocks(r.html)
        p = naive_probabilities(model, B.features([page], {}, B.word_table()).astype(np.float64))
        assert B.probabilities(model, B.features([page], {}, B.word_table()), np.array([len(page)])) == pytest.approx(p, abs=1e-4)
        if np.abs(p - B.THRESHOLD).min() > 1e-3:
            assert got[r.page_id].text == "\n".join(b.text for b, q in zip(page, p) if q >= B.THRESHOLD) and got[r.page_id].n_blocks == len(page)


@pytest.mark.parametrize("page", ["", "<", "<p", "<p <p>", '<a href="x>y', "</p></div>", "<div>" * 3000 + "deep", "a < b > c", "<!--", "<script>", "&#xFFFFFFFF; &bogus;", "\x00"])
def test_odd_pages(page):
    B.blocks(page)


def test_gradients():
    """Of both directions of time, against differences."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(5, 3, 6)).astype(np.float64)
    wx, wh, b = (rng.normal(size=s) * 0.3 for s in ((6, 4 * B.HIDDEN), (B.HIDDEN, 4 * B.HIDDEN), (4 * B.HIDDEN,)))
    v = rng.normal(size=(5, 3, B.HIDDEN))
    loss = lambda: float((B._pass(x, wx, wh, b) * v).sum())
    kept = []
    B._pass(x, wx, wh, b, kept)
    grads = B._back(x, wx, wh, kept, v)
    for w, g in zip((wx, wh, b), grads):
        for _ in range(6):
            at = tuple(rng.integers(0, n) for n in w.shape)
            old = w[at]
            w[at] = old + 1e-2
            up = loss()
            w[at] = old - 1e-2
            down = loss()
            w[at] = old
            assert (up - down) / 2e-2 == pytest.approx(g[at], abs=0.02, rel=0.02)


def test_extraction_on_pages_that_were_not_fitted_on(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    fitted, held = pages.filter("page_id % 2 = 0"), pages.filter("page_id % 2 = 1")
    model = B.fit(fitted)
    right = total = 0
    table, cache = B.word_table(), {}
    for r in held.collect():
        page = B.blocks(r.html)
        for hide in (False, True):
            p = B.probabilities(model, B.features([page], cache, table, hide), np.array([len(page)]))
            for b, q in zip(page, p):
                right += (q >= 0.5) == (B.distant_label(b) == 1)
                total += 1
    assert right / total > 0.97
    texts = {r.page_id: r.text for r in B.extract(held, model).collect()}
    assert len(texts) == held.count() and all("track(" not in t for t in texts.values())
    assert B.label_blocks(held, model).filter("is_content").count() > held.count()


def test_nulls_repeats_and_other_columns(spark):
    pages = spark.createDataFrame([(1, "<p>a</p>"), (1, "<p>a</p>"), (None, "<p>b</p>"), (2, None), (3, "")], "page_id long, html string").withColumn("text", F.lit("x")).withColumn("N_BLOCKS", F.lit(9))
    got = sorted((r.page_id or 0, r.n_blocks, r.n_content, r.text) for r in B.extract(pages, None).collect())
    assert got == [(0, 1, 1, "b"), (1, 1, 1, "a"), (1, 1, 1, "a"), (2, 0, 0, ""), (3, 0, 0, "")]
    assert B.fit(pages) is None and B.fit(pages.limit(0)) is None and B.extract(pages.limit(0), None).count() == 0


def test_very_long_page(spark):
    page = "<body>" + "".join(f"<p>block {k} of many words.</p>" for k in range(30_000))
    got = B.extract(spark.createDataFrame([(1, page)], "page_id long, html string"), None).first()
    assert got.n_blocks == 30_000 and got.text.endswith("block 29999 of many words.")
