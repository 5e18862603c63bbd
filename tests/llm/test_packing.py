import numpy as np
import pytest
from pyspark.sql import functions as F

from timeweave.llm import packing as P


def naive_bins(lengths, capacity):
    rooms, out = [], []
    for n in lengths:
        fits = [(r, k) for k, r in enumerate(rooms) if r >= n]
        k = min(fits)[1] if fits else len(rooms)
        if not fits:
            rooms.append(capacity)
        rooms[k] -= n
        out.append(k)
    return out


def optimum(lengths, capacity):
    """The fewest bins, by trying everything."""
    best = [len(lengths)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(rooms)
            return
        for k in range(len(rooms)):
            if rooms[k] >= lengths[i] and rooms[k] not in rooms[:k]:
                rooms[k] -= lengths[i]
                go(i + 1, rooms)
                rooms[k] += lengths[i]
        rooms.append(capacity - lengths[i])
        go(i + 1, rooms)
        rooms.pop()

    go(0, [])
    return best[0]


def test_best_fit_and_bound():
    rng = np.random.default_rng(4)
    for k in range(60):
        lengths = np.sort(rng.integers(1, 21, rng.integers(1, 9)))[::-1]
        assert P.best_fit_decreasing(lengths, 20).tolist() == naive_bins(lengths.tolist(), 20)
        assert P.lower_bound(lengths, 20) <= optimum(lengths.tolist(), 20)
    big = np.sort(rng.integers(1, 101, 700))[::-1]
    assert P.best_fit_decreasing(big, 100).tolist() == naive_bins(big.tolist(), 100)
    assert P.lower_bound(np.array([51] * 7), 100) == 7  # more than the sum says


def test_bound_tries_every_threshold():
    lognormal = np.random.default_rng(1).lognormal(np.log(1200), 0.3, 20_000).astype(int).clip(1, 2048)
    uniform = np.random.default_rng(1).integers(700, 1501, 20_000)
    for x in (lognormal, uniform):
        best = max(np.where(x > 2048 - e, 2048, x)[x >= e].sum() for e in range(1, 1025))
        assert P.lower_bound(x, 2048) >= -(-int(best) // 2048)
    assert P.best_fit_decreasing(np.sort(lognormal)[::-1], 2048).max() + 1 == P.lower_bound(lognormal, 2048)


def test_every_piece_is_packed_once(docs_of):
    rows = [(k, " ".join(["w"] * n)) for k, n in enumerate([5, 5, 0, 23, 10, 7, 3, 1, 9, 9, 4] * 5)] + [(None, "a b"), (3, "x y z"), (99, None)]
    docs = docs_of(rows, bin=F.lit(1), n=F.lit("x"), TW_S=F.lit(2))
    got = P.pack(docs, capacity=10, shard=20).collect()
    assert sum(r.length for r in got) == sum(len((t or "").split()) for _, t in rows)
    fill, places = {}, {}
    for r in got:
        assert 0 < r.length <= 10 and r.start == 10 * r.piece
        fill[r.shard, r.bin] = fill.get((r.shard, r.bin), 0) + r.length
        places.setdefault((r.shard, r.bin), []).append(r.place)
    assert max(fill.values()) <= 10 and all(sorted(p) == list(range(len(p))) for p in places.values())
    per = {}
    for s, b in fill:
        per[s] = per.get(s, 0) + 1
    assert all(r.shard_bins == per[r.shard] and r.lower_bound <= r.shard_bins and r.certified == (r.shard_bins == r.lower_bound) for r in got)


def test_exchange_saves_bins(spark):
    """Lengths of which best-fit decreasing leaves gaps in every small shard: exchanging pieces takes fewer bins, and loses none."""
    rng = np.random.default_rng(303)
    lengths = rng.choice([5, 12, 7, 8], 600).tolist()
    docs = spark.createDataFrame([(k, "", "en", "s", n) for k, n in enumerate(lengths)], "doc_id long, text string, lang string, source string, n_chars long")
    packed = [P.pack(docs, 22, F.col("n_chars"), 30, r).cache() for r in (0, 3)]
    bins = [df.select("shard", "bin").distinct().count() for df in packed]
    assert bins[1] < bins[0] and bins[1] >= P.lower_bound(np.array(lengths), 22)
    assert all(sorted((r.doc_id, r.length) for r in df.collect()) == list(enumerate(lengths)) for df in packed)
    assert max(r.fill for r in packed[1].groupBy("shard", "bin").agg(F.sum("length").alias("fill")).collect()) <= 22


def test_rows_that_nothing_tells_apart_are_spread(docs_of):
    """Without an id, or copies of one document: not all in one shard."""
    for same in (None, 7):
        got = P.pack(docs_of([(same, "a b c d")] * 3000), capacity=10, shard=100).groupBy("shard").agg(F.count("*").alias("n")).collect()
        assert len(got) >= 25 and max(r.n for r in got) < 200 and sum(r.n for r in got) == 3000


def test_nothing_to_pack(docs_of):
    assert P.pack(docs_of([])).count() == 0 and P.pack(docs_of([None, "", " \n"])).count() == 0
    with pytest.raises(ValueError):
        P.pack(docs_of([]), capacity=0)
