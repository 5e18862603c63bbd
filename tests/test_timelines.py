"""Vectors traced by hand, and random cases against definitions said point by point."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from timeweave.functions.numbers import equal_parts, smoothing
from timeweave.operators import intervals as iv
from timeweave.operators import retime as rt
from timeweave.plans import timelines

INF = float("inf")


def flags(spark, values, name="flag"):
    return spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], f"rec int, idx int, {name} boolean")


def changes(spark, rows, rec=1):
    return spark.createDataFrame([(rec, *map(float, r)) for r in rows], "rec int, beg double, fin double, multi double")


def frames(spark, durations):
    return spark.createDataFrame([(1, i, float(d)) for i, d in enumerate(durations)], "rec int, frame int, src double")


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.mark.parametrize("values, want", [([1, 1, 0, 0, 1, 1], [(0, 2), (4, 6)]), ([0, 0, 0], []), ([1, 1, 1], [(0, 3)]), ([], []), ([None, 1, None], [(1, 2)])])
def test_islands(spark, values, want):
    assert rows(iv.islands(flags(spark, [None if v is None else bool(v) for v in values])), "beg", "fin") == want


@pytest.mark.parametrize("total, limit, want", [(10, 4, [3, 3, 4]), (11, 4, [3, 4, 4]), (3, 4, [3]), (0, 4, [0])])
def test_equal_parts(total, limit, want):
    assert equal_parts(total, limit).tolist() == want


def test_smoothing_weights():
    assert smoothing(5) == [0.25, 0.75, 1.0, 0.75, 0.25]


def test_combine_vector(spark):
    got = iv.combine(changes(spark, [(2, 4, 0)]), changes(spark, [(0, 3, 0.5), (3, 6, 0.5)]))
    assert rows(got, "beg", "fin", "multi") == [(0, 2, 0.5), (2, 4, 0), (4, 6, 0.5)]


def test_combine_is_pointwise(spark):
    rng = random.Random(3)
    prim, supp, want = [], [], {}
    for rec in range(60):
        def disjoint():
            ends = sorted(rng.sample(range(40), 2 * rng.randint(0, 5)))
            return [(rec, float(a), float(b) if rng.random() < 0.95 or k < len(ends) - 2 else INF, rng.choice([0.0, 0.5, 2.0])) for k, (a, b) in enumerate(zip(ends[::2], ends[1::2]))]
        p, s = disjoint(), disjoint()
        prim += p
        supp += s
        at = lambda x, rows: next((m for _, a, b, m in rows if a <= x < b), None)
        for x in range(45):
            m = at(x + 0.5, p)
            want[rec, x] = m if m is not None else at(x + 0.5, s)
    schema = "rec int, beg double, fin double, multi double"
    got = iv.combine(spark.createDataFrame(prim, schema), spark.createDataFrame(supp, schema))
    assert iv.violations(got).count() == 0
    out = {k: None for k in want}
    for r in got.collect():
        for x in range(45):
            if r.beg <= x + 0.5 < r.fin:
                assert out[r.rec, x] is None
                out[r.rec, x] = r.multi
    assert out == want


def test_combine_with_nothing(spark):
    some, none = changes(spark, [(1, 2, 0)]), changes(spark, [])
    assert rows(iv.combine(some, none), "beg", "fin") == rows(iv.combine(none, some), "beg", "fin") == [(1, 2)]


def test_priorities_are_pointwise(spark):
    """Four methods, some touching: at each point the first that covers it counts, and a piece is split by none that comes after it."""
    rng = random.Random(5)
    methods, want = [[] for _ in range(4)], {}
    for rec in range(40):
        for m in methods:
            ends = sorted(rng.sample(range(30), 2 * rng.randint(0, 6)))
            m += [(rec, float(a), float(b), rng.choice([0.0, 0.5, 2.0])) for a, b in zip(ends[::2], ends[1::2])]
        point = [next(((k, a, x) for k, m in enumerate(methods) for r, a, b, x in m if r == rec and a <= t < b), None) for t in range(31)]
        begun = [t for t in range(31) if point[t] and (not t or point[t] != point[t - 1])]
        want |= {(rec, t): (next(u for u in range(t, 32) if u == 31 or point[u] != point[t]), point[t][2]) for t in begun}
    got = iv.combine_by_priority([spark.createDataFrame(m, "rec int, beg double, fin double, multi double") for m in methods])
    assert {(r.rec, r.beg): (r.fin, r.multi) for r in got.collect()} == want


def test_priorities_take_one_sweep(spark, sf_dir):
    """One scan and exchange of the events, one sort of them and one of the ends, whatever the number of methods."""
    plan = timelines.combine_priority_fold(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert (plan.count("FileScan"), plan.count("Exchange hash"), plan.count("- Sort [")) == (1, 1, 2)


def test_violations(spark):
    got = iv.violations(changes(spark, [(0, 2, 0), (1, 3, 0), (5, 4, 0), (-1, 0, 0), (6, INF, 0)]))
    assert rows(got, "beg") == [(-1,), (0,), (5,)]


def test_retime_in_seconds_keeps_what_is_not_touched(spark):
    """24000/1001 frames a second: no duration is rounded; a frame that is cut, by one change or by two that meet, is 0 exactly."""
    d = 1001 / 24000
    n = 2400
    none = rt.retime(frames(spark, [d] * n), changes(spark, [(5000.0, 6000.0, 0.0)]))
    assert {r.dst for r in none.collect()} == {d}
    ends = [0.0]
    for _ in range(n):
        ends.append(ends[-1] + d)
    middle = (ends[40] + ends[41]) / 2
    cut = rt.retime(frames(spark, [d] * n), changes(spark, [(ends[10], ends[20], 0.0), (ends[40], middle, 0.0), (middle, ends[41], 0.0), (ends[50], float("inf"), 0.5)]))
    got = [r.dst for r in cut.orderBy("frame").collect()]
    assert got[:10] == [d] * 10 and got[10:20] == [0.0] * 10 and got[20:40] == [d] * 20 and got[40] == 0.0 and got[41:50] == [d] * 9 and got[50:] == [d / 2] * (n - 50)


def test_retime_against_a_loop(spark):
    """Random frames and changes, several of which lie within a frame, against each frame's overlaps added up."""
    rng = np.random.default_rng(7)
    for _ in range(4):
        sizes = rng.exponential(1, 40).tolist()
        at = np.sort(rng.uniform(0, sum(sizes) * 1.1, 60))
        given = [(float(a), float(b), float(rng.choice([0, 0.5, 2]))) for a, b in zip(at[::2], at[1::2])]
        got = [r.dst for r in rt.retime(frames(spark, sizes), changes(spark, given)).orderBy("frame").collect()]
        end = np.cumsum(sizes)
        want = [s + sum((max(min(e, f) - max(e - s, b), 0)) * (m - 1) for b, f, m in given) for s, e in zip(sizes, end)]
        assert got == pytest.approx(want, abs=1e-9)
        assert all(g == s for g, s, e in zip(got, sizes, end) if not any(b < e and f > e - s for b, f, _ in given))


def test_retime_vector(spark):
    got = rt.retime(frames(spark, [1, 1, 1, 1]), changes(spark, [(0.5, 2, 0.5)]))
    assert rows(got, "frame", "dst") == [(0, 0.75), (1, 0.5), (2, 1), (3, 1)]


def test_trim_tail_vector(spark):
    ch = changes(spark, [(1.5, INF, 0)])
    got = rt.trim_tail(rt.retime(frames(spark, [1, 1, 1, 1]), ch), ch)
    assert rows(got, "frame", "dst") == [(0, 1), (1, 0.5)]


def test_frame_durations_vector(spark):
    packets = spark.createDataFrame([(1, 5), (1, 2), (1, 3), (1, 3), (1, None), (1, -1), (2, 0), (2, 4), (3, 7), (3, 7)], "rec int, pts long")
    got = rt.frame_durations(packets)
    assert rows(got, "rec", "frame", "src") == [(1, 0, 2), (1, 1, 1), (1, 2, 2), (1, 3, 1.5), (2, 0, 4), (2, 1, 4)]


def constrained(durations, least):
    """The rule frame by frame."""
    out, pending = list(durations), None
    for i, d in enumerate(durations):
        if d <= 0 or d >= least:
            continue
        if pending is None:
            pending = i
            continue
        out[pending] += d
        out[i] = 0
        if out[pending] >= least:
            out[i] = out[pending] - least
            out[pending] = least
            pending = i if out[i] else None
    if pending is not None:
        out[pending] = round(out[pending] / least) * least
    return out


def test_limit_fps(spark):
    assert constrained([20, 20, 20, 70, 20], 50) == [50, 0, 50, 70, 0]
    rng = random.Random(5)
    cases = [[20, 20, 20, 70, 20], [25, 25, 25], [25]] + [[rng.choice([0, 5, 10, 20, 49, 50, 51, 80]) for _ in range(rng.randint(1, 20))] for _ in range(80)]
    df = spark.createDataFrame([(k, i, float(d)) for k, c in enumerate(cases) for i, d in enumerate(c)], "rec int, frame int, dst double")
    got = {(r.rec, r.frame): r.dst for r in rt.limit_fps(df, 50).collect()}
    assert got == {(k, i): d for k, c in enumerate(cases) for i, d in enumerate(constrained(c, 50))}


def test_pad_ranges_vector(spark):
    known = spark.createDataFrame([(1, i, 300) for i in range(6)], "rec int, frame int, src_n long")
    ranges = spark.createDataFrame([(1, 2, 3)], "rec int, beg int, fin int")
    assert rows(rt.pad_ranges(known, ranges, 512), "new_beg", "new_fin") == [(0, 5)]


def test_close_open_leaves_no_short_run(spark):
    rng = random.Random(1)
    values = [rng.random() < 0.6 for _ in range(300)]
    got = [r.flag for r in iv.close_open(flags(spark, values), 4).orderBy("idx").collect()]
    runs, start = [], 0
    for i in range(1, 301):
        if i == 300 or got[i] != got[start]:
            runs.append(i - start)
            start = i
    assert min(runs) >= 4
    assert [r.flag for r in iv.close_open(flags(spark, [True, False]), 6).orderBy("idx").collect()] == [False, False]


def test_silence_tail_vector(spark):
    red, sil = range(8, 40), [*range(10, 20), *range(30, 38)]
    df = spark.createDataFrame([(1, i, i not in sil, i not in red) for i in range(45)], "rec int, idx int, sound boolean, flag boolean")
    got = iv.first_overlap_tail(df, 2)
    assert [i for i, f in rows(got, "idx", "flag") if f and i in red] == [18, 19]


def test_split_range_and_workspaces(spark):
    sizes = np.array([100] * 40)
    parts = rt.split_range(sizes, 1000)
    assert parts == [(0, 10), (10, 20), (20, 30), (30, 40)]
    known = spark.createDataFrame([(1, i, 100) for i in range(60)], "rec int, frame int, src_n long")
    got = rt.plan_workspaces(known, spark.createDataFrame([(1, 5, 45)], "rec int, beg int, fin int"), limit=1000, pad=250).orderBy("ws").collect()
    assert [(r.beg, r.fin, r.left_fin, r.right_beg, r.encode_left, r.encode_right, r.has_next) for r in got] == [
        (5, 18, 8, 15, True, False, True), (12, 28, 15, 25, False, False, True), (22, 38, 25, 35, False, False, True), (32, 45, 35, 42, False, True, False)]


def test_noise_is_not_edited(spark):
    df = spark.createDataFrame([(1, 0, 10, 9), (1, 1, 10, 10), (1, 2, 10, 0), (1, 3, 10, 5)], "rec int, frame int, src_n long, dst_n long")
    assert rows(rt.tolerate_noise(df), "frame", "src_n", "dst_n", "edited") == [(0, 10, 10, False), (1, 10, 10, False), (2, 0, 0, True), (3, 10, 5, True)]
    assert rows(rt.trim_neighbours(rt.tolerate_noise(df)), "frame", "n") == [(0, 10), (1, 10), (2, 0), (3, 5)]


def test_empty_inputs(spark):
    none = changes(spark, [])
    assert rt.retime(frames(spark, []), none).count() == 0
    assert rows(rt.retime(frames(spark, [1]), none), "dst") == [(1,)]
    assert iv.merged(spark.createDataFrame([], "rec int, beg int, fin int")).count() == 0
