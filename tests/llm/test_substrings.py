import numpy as np
import pytest
from pyspark.sql import functions as F

from timeweave.llm import substrings as S


def brute(rows, window):
    """doc_id, start, end, longest, from every window of every length."""
    docs = [(i, t.split()) for i, t in rows if i is not None and t]
    hits, length = {}, window
    while True:
        seen = {}
        for d, (_, w) in enumerate(docs):
            for k in range(len(w) - length + 1):
                seen.setdefault(tuple(w[k : k + length]), []).append((d, k))
        found = [p for ps in seen.values() if len(ps) > 1 for p in ps]
        if not found:
            break
        hits[length] = found
        length *= 2
    out = set()
    for d, (i, _) in enumerate(docs):
        at = sorted(k for x, k in hits.get(window, []) if x == d)
        spans = []
        for k in at:
            if spans and k <= spans[-1][1]:
                spans[-1][1] = k + window
            else:
                spans.append([k, k + window])
        for a, b in spans:
            out.add((i, a, b, max(n for n, ps in hits.items() if any(x == d and a <= k and k + n <= b for x, k in ps))))
    return out


def got(docs, window):
    return {tuple(r) for r in S.repeated_spans(docs, window).select("doc_id", "start_word", "end_word", "longest").collect()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_every_window(docs_of, seed):
    rng = np.random.default_rng(seed)
    words = [f"w{k}" for k in range(60)]
    texts = [[words[i] for i in rng.integers(0, 60, rng.integers(0, 80))] for _ in range(60)]
    for _ in range(40):
        a, b = rng.integers(0, 60, 2)
        n = int(rng.integers(1, 50))
        at, to = (int(rng.integers(0, len(texts[x]) + 1)) for x in (a, b))
        texts[b][to:to] = texts[a][at : at + n]
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    assert got(docs_of(rows), 6) == brute(rows, 6)


def test_copies_nulls_and_rows_of_one_id(docs_of, prose):
    a, b, c = prose(1, 300), prose(2, 120), prose(3, 90)
    rows = [(1, a), (2, a), (3, a), (4, a + " " + c), (5, b), (5, b), (6, c), (6, prose(4, 60)), (7, None), (8, ""), (9, "short"), (None, a), (10, "x " * 400)]
    docs = docs_of(rows, key=F.lit("clash"), PLACES=F.lit(1), tw_id=F.lit(2))
    assert got(docs, 50) == brute(rows, 50)
    assert got(docs.limit(0), 50) == set()
    with pytest.raises(ValueError):
        S.repeated_spans(docs, 7)


def test_many_copies_and_a_very_long_text(docs_of, prose):
    passage, long = prose(5, 60), prose(6, 60_000)
    rows = [(k, f"{prose(100 + k, 30)} {passage} {prose(500 + k, 30)}") for k in range(300)] + [(999, f"{long} {passage}")]
    want = brute(rows, 50)  # by chance, a word before or after may repeat as well
    assert len(want) == 301 and got(docs_of(rows), 50) == want
