"""Retiming: what timeline changes do to the durations of a recording's frames, down to samples and workspaces."""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from timeweave.functions.numbers import equal_parts
from timeweave.operators.intervals import as_of, merged, with_runs

#: Samples: padding of a workspace, its greatest size, the greatest silent frame, and of a cross-fade.
PAD, WORKSPACE, SILENT_FRAME, FADE = 512, 512 + 1000 * 1024 + 512, 10 * 1024, 64


def valid_packets(packets: DataFrame, pts: str = "pts") -> DataFrame:
    """Packets with a time stamp that isn't negative."""
    return packets.filter(F.col(pts) >= 0)


def seconds(ticks: Column, time_base: Fraction) -> Column:
    return ticks * time_base.numerator / time_base.denominator


def frame_durations(packets: DataFrame, by: str = "rec", pts: str = "pts") -> DataFrame:
    """by, frame, src, virtual: durations between the distinct time stamps of a recording, in their unit.

    The last frame gets the mean of the others. If the first stamp isn't 0, a virtual frame from 0 to it comes first.
    Recordings with fewer than two different stamps have none.
    """
    distinct = valid_packets(packets, pts).select(by, F.col(pts).alias("pts")).repartition(by).distinct()
    w, whole = W.partitionBy(by).orderBy("pts"), W.partitionBy(by)
    gap = F.lead("pts").over(w) - F.col("pts")
    timed = distinct.withColumn("n", F.count("*").over(whole)).filter("n > 1").withColumn("gap", gap)
    timed = timed.withColumn("src", F.coalesce(F.col("gap").cast("double"), F.avg("gap").over(whole)))
    timed = timed.withColumn("rn", F.row_number().over(w)).withColumn("first", F.min("pts").over(whole))
    shift = (F.col("first") > 0).cast("int")
    own = F.struct((F.col("rn") - 1 + shift).alias("frame"), F.col("src"), F.lit(False).alias("virtual"))
    before = F.struct(F.lit(0).alias("frame"), F.col("pts").cast("double").alias("src"), F.lit(True).alias("virtual"))
    return timed.select(by, F.inline(F.when((F.col("rn") == 1) & (F.col("first") > 0), F.array(before, own)).otherwise(F.array(own))))


def bounds(frames: DataFrame, by: str = "rec", dur: str = "src") -> DataFrame:
    """frames with fr_end and fr_beg, where each ends and begins: a frame begins at the very number at which the one before ends."""
    w = W.partitionBy(by).orderBy("frame")
    return frames.withColumn("fr_end", F.sum(dur).over(w)).withColumn("fr_beg", F.coalesce(F.lag("fr_end").over(w), F.lit(0.0)))


def retime(frames: DataFrame, changes: DataFrame, by: str = "rec") -> DataFrame:
    """frames (by, frame, src) with fr_beg, fr_end and dst, the duration after the changes (by, beg, fin, multi; disjoint).

    The change before each frame's end is looked up in one sorted pass per recording, and that before its beginning is what the
    frame before found: no frame is paired with a change, and a long change costs no more than a short one. In any unit, a frame
    that no change touches keeps src as it is, and one that a change covers lasts src * multi. What several changes
    leave of a frame counts as 0 where it is less than doubles can tell from the frame's place.
    """
    w = W.partitionBy(by).orderBy("beg")
    known = changes.filter(F.col("beg") < F.col("fin")).withColumn("whole", (F.col("fin") - F.col("beg")) * (F.col("multi") - 1))
    known = known.withColumn("before", F.coalesce(F.sum("whole").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))).withColumn("n", F.row_number().over(w))
    timed = bounds(frames, by)
    at = as_of(timed, known, by, F.col("fr_end"), F.col("beg").cast("double"), F.struct("beg", "fin", "multi", "whole", "before", "n"), "tw_c")
    at = at.withColumn("tw_p", F.lag("tw_c").over(W.partitionBy(by).orderBy("frame")))
    c, p, beg, end, src = F.col("tw_c"), F.col("tw_p"), F.col("fr_beg"), F.col("fr_end"), F.col("src")
    earlier = F.coalesce(p["n"], F.lit(0))
    rest = lambda x: x["multi"] - 1
    covered = lambda x: (x["beg"] <= beg) & (x["fin"] >= end)
    before = F.when(p["fin"] > beg, (F.least(p["fin"], end) - beg) * rest(p)).otherwise(0.0)
    between = F.when(c["n"] > earlier + 1, c["before"] - F.coalesce(p["before"] + p["whole"], F.lit(0.0))).otherwise(0.0)
    last = F.when(c["n"] > earlier, (F.least(c["fin"], end) - F.greatest(c["beg"], beg)) * rest(c)).otherwise(0.0)
    left = src + F.coalesce(before, F.lit(0.0)) + between + last
    counted = F.when(F.abs(left) <= F.abs(end) * 2.0**-48, 0.0).otherwise(left)
    over = F.coalesce(p["fin"] <= beg, F.lit(True))  # what came before the frame has ended
    untouched = over & (c.isNull() | (c["n"] == earlier) | ((c["n"] == earlier + 1) & (c["beg"] >= end)))
    dst = F.when(untouched, src).when(covered(c), src * c["multi"]).when(covered(p), src * p["multi"]).otherwise(counted)
    return at.withColumn("dst", dst).drop("tw_c", "tw_p")


def trim_tail(retimed: DataFrame, changes: DataFrame, by: str = "rec") -> DataFrame:
    """Retimed frames before the first that is cut by a change that reaches the end of its recording."""
    whole = W.partitionBy(by)
    ends = retimed.groupBy(by).agg(F.max("fr_end").alias("tw_end"))
    tail = changes.filter(F.col("beg") < F.col("fin")).join(ends, by).filter((F.col("fin") >= F.col("tw_end")) & (F.col("beg") < F.col("tw_end"))).groupBy(by).agg(F.min("beg").alias("tw_tail"))
    df = retimed.join(tail, by, "left")
    cutoff = F.min(F.when((F.col("dst") == 0) & (F.col("fr_end") > F.col("tw_tail")), F.col("frame"))).over(whole)
    return df.withColumn("tw_cut", cutoff).filter("tw_cut IS NULL OR frame < tw_cut").drop("tw_cut", "tw_tail")


def output_times(frames: DataFrame, by: str = "rec", dur: str = "dst") -> DataFrame:
    """by, frame, pts of the frames that are left: those of no duration are dropped."""
    before = F.coalesce(F.sum(dur).over(W.partitionBy(by).orderBy("frame").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    return frames.withColumn("pts", before).filter(F.col(dur) > 0).select(by, "frame", "pts")


def limit_fps(frames: DataFrame, least: int, by: str = "rec", dur: str = "dst") -> DataFrame:
    """Durations in whole ticks so that no frame lasts from 1 to least - 1 of them.

    Short frames are gathered in the first of them; once it is full, the surplus opens the current one; what is left at the
    end is rounded to 0 or `least`, half to even. Longer frames stay and don't interrupt. As the short frames' running sum
    passes a multiple of `least` exactly where one is full, windows say it all.
    """
    w, whole = W.partitionBy(by).orderBy("frame"), W.partitionBy(by)
    d = F.col(dur).cast("long")
    short = (d > 0) & (d < least)
    df = frames.withColumn("tw_d", F.when(short, d).otherwise(0)).withColumn("tw_c", F.sum("tw_d").over(w)).withColumn("tw_all", F.sum("tw_d").over(whole))
    before = F.col("tw_c") - F.col("tw_d")
    fresh, crossing = before % least == 0, (F.floor(F.col("tw_c") / least) > F.floor(before / least)) & (F.col("tw_c") % least > 0)
    block = F.when(fresh, F.floor(before / least)).when(crossing, F.floor(F.col("tw_c") / least))
    full = F.floor(F.col("tw_all") / least) > block
    last = F.bround((F.col("tw_all") % least) / F.lit(least)) * least
    value = F.when(short, F.when(block.isNull(), 0).when(full, least).otherwise(last)).otherwise(d)
    return df.withColumn(dur, value.cast("long")).drop("tw_d", "tw_c", "tw_all")


def samples(frames: DataFrame, rate: int, per_second: int, by: str = "rec") -> DataFrame:
    """frames with src_n and dst_n, samples between the ends: those of src are cut off, those of dst rounded half to even."""
    w = W.partitionBy(by).orderBy("frame")
    src, dst = F.sum("src").over(w) * rate / per_second, F.sum("dst").over(w) * rate / per_second
    df = frames.withColumn("tw_s", src.cast("long")).withColumn("tw_d", F.bround(dst).cast("long"))
    for name, end in (("src_n", "tw_s"), ("dst_n", "tw_d")):
        df = df.withColumn(name, F.col(end) - F.coalesce(F.lag(end).over(w), F.lit(0)))
    return df.drop("tw_s", "tw_d")


def tolerate_noise(frames: DataFrame, by: str = "rec") -> DataFrame:
    """frames with `edited` and dst_n: runs whose src_n and dst_n differ by one sample at most in all aren't edited.

    Frames that are deleted (dst_n 0) have src_n 0 from here on."""
    df = with_runs(frames.withColumn("edited", F.col("src_n") != F.col("dst_n")), by, "frame", "edited", "tw_run")
    run = W.partitionBy(by, "tw_run")
    noise = F.abs(F.sum("src_n").over(run) - F.sum("dst_n").over(run)) <= 1
    df = df.withColumn("tw_noise", noise).withColumn("dst_n", F.when(F.col("tw_noise"), F.col("src_n")).otherwise(F.col("dst_n")))
    df = df.withColumn("edited", F.col("edited") & ~F.col("tw_noise"))
    return df.withColumn("src_n", F.when(F.col("dst_n") == 0, F.lit(0)).otherwise(F.col("src_n"))).drop("tw_run", "tw_noise")


def _cumulated(frames: DataFrame, by: str, n: str) -> DataFrame:
    """frames with tw_b and tw_e: samples before each, and up to its end."""
    return frames.withColumn("tw_e", F.sum(n).over(W.partitionBy(by).orderBy("frame"))).withColumn("tw_b", F.col("tw_e") - F.col(n))


def _padded(frames: DataFrame, edges: DataFrame, pad: int, by: str) -> DataFrame:
    """edges (by, beg, fin, lo, hi: samples before and up to the end of each range) with new_beg and new_fin.

    The padding reaches back to the last frame with tw_b <= lo - pad, and on to the last with tw_b < hi + pad: both are looked up
    in one sorted pass, a probe for the latter standing before equal frames, one for the former after them."""
    probe = lambda at, kind: F.struct(at.cast("long").alias("tw_at"), F.lit(kind).alias("tw_kind"))
    probes = edges.select(F.col(by).alias("tw_by"), "beg", "fin", F.inline(F.array(probe(F.col("lo") - pad, 2), probe(F.col("hi") + pad, 0))))
    points = frames.select(F.col(by).alias("tw_by"), F.col("tw_b").cast("long").alias("tw_at"), F.lit(1).alias("tw_kind"), "frame")
    w = W.partitionBy("tw_by").orderBy("tw_at", "tw_kind", "frame").rowsBetween(W.unboundedPreceding, W.currentRow)
    found = points.unionByName(probes, allowMissingColumns=True).withColumn("tw_f", F.last("frame", True).over(w)).filter("tw_kind <> 1")
    new_beg, new_fin = F.max(F.when(F.col("tw_kind") == 2, F.col("tw_f"))), F.max(F.when(F.col("tw_kind") == 0, F.col("tw_f"))) + 1
    grouped = found.groupBy("tw_by", "beg", "fin").agg(F.coalesce(new_beg, F.lit(0)).alias("new_beg"), new_fin.alias("new_fin"))
    return grouped.select(F.col("tw_by").alias(by), "beg", "fin", "new_beg", "new_fin")


def pad_ranges(frames: DataFrame, ranges: DataFrame, pad: int = PAD, by: str = "rec", n: str = "src_n") -> DataFrame:
    """by, beg, fin, new_beg, new_fin: ranges of frames widened frame by frame until `pad` samples are added, or the end is reached."""
    known = _cumulated(frames.select(by, "frame", n), by, n)
    start = known.select(F.col(by).alias("tw_x"), F.col("frame").alias("tw_f1"), F.col("tw_b").alias("lo"))
    end = known.select(F.col(by).alias("tw_y"), F.col("frame").alias("tw_f2"), F.col("tw_e").alias("hi"))
    edges = ranges.join(start, (F.col(by) == F.col("tw_x")) & (F.col("beg") == F.col("tw_f1"))).join(end, (F.col(by) == F.col("tw_y")) & (F.col("fin") - 1 == F.col("tw_f2")))
    return _padded(known, edges.select(by, "beg", "fin", "lo", "hi"), pad, by)


def edited_ranges(frames: DataFrame, pad: int = PAD, by: str = "rec") -> DataFrame:
    """by, beg, fin, new_beg, new_fin: the runs of edited frames, and how far their padding reaches."""
    known = _cumulated(frames.select(by, "frame", "src_n", "edited"), by, "src_n")
    runs = with_runs(known, by, "frame", "edited", "tw_run").filter("edited").groupBy(by, "tw_run").agg(F.min("frame").alias("beg"), (F.max("frame") + 1).alias("fin"), F.min("tw_b").alias("lo"), F.max("tw_e").alias("hi"))
    return _padded(known, runs.drop("tw_run"), pad, by)


def padded_edits(frames: DataFrame, pad: int = PAD, by: str = "rec") -> DataFrame:
    """by, beg, fin: the edited runs with their padding, made one where they meet."""
    return merged(edited_ranges(frames, pad, by).select(by, F.col("new_beg").alias("beg"), F.col("new_fin").alias("fin")), by)


def split_range(sizes: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """A range of frames in parts of about equal size, so many as `limit` asks for: each ends with the frame that fills it."""
    targets = equal_parts(int(sizes.sum()), limit)
    if len(targets) == 1:
        return [(0, len(sizes))]
    ends, out, start = np.cumsum(sizes), [], 0
    for target in targets:
        done = ends[start - 1] if start else 0
        stop = min(int(np.searchsorted(ends, done + target, "left")), len(sizes) - 1) + 1
        out.append((start, max(stop, start + 1)))
        start = out[-1][1]
        if start >= len(sizes):
            break
    return out


def _inwards(sizes: np.ndarray, lo: int, hi: int, pad: int, left: bool) -> int:
    """Where a padding within the range ends (its first frame inside, seen from the edge)."""
    part = np.cumsum(sizes[lo:hi] if left else sizes[lo:hi][::-1])
    k = min(int(np.searchsorted(part, pad, "left")), hi - lo - 1) + 1
    return lo + k if left else hi - k


def _outwards(sizes: np.ndarray, edge: int, pad: int, left: bool) -> int:
    part = np.cumsum(sizes[:edge][::-1] if left else sizes[edge:])
    if not len(part):
        return edge
    k = min(int(np.searchsorted(part, pad, "left")), len(part) - 1) + 1
    return edge - k if left else edge + k


PLAN = "ws int, beg int, fin int, left_fin int, right_beg int, encode_left boolean, encode_right boolean, has_next boolean"


def plan_workspaces(frames: DataFrame, ranges: DataFrame, by: str = "rec", limit: int = WORKSPACE, pad: int = PAD) -> DataFrame:
    """by, ws, beg, fin, left_fin, right_beg, encode_left, encode_right, has_next: the workspaces of each range of frames.

    A range of more than `limit` samples is split. The outer paddings of a range lie within it and are encoded; between parts,
    paddings reach into the neighbour and aren't. [beg, left_fin) and [right_beg, fin) are the paddings. The split starts anew
    after each overshoot, which windows can't say; only recordings that are edited come here.
    """
    kind = frames.schema[by].dataType.simpleString()
    left = frames.select(by, F.col("frame").alias("a"), F.col("src_n").cast("long").alias("b"), F.lit(0).alias("kind"))
    right = ranges.select(by, F.col("beg").alias("a"), F.col("fin").cast("long").alias("b"), F.lit(1).alias("kind"))
    edited = right.select(by).distinct()

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[pdf["kind"] == 0].sort_values("a")
        sizes = own["b"].to_numpy(np.int64)
        rows = []
        for lo, hi in pdf[pdf["kind"] == 1].sort_values("a")[["a", "b"]].itertuples(index=False):
            parts = split_range(sizes[lo:hi], limit)
            for k, (a, b) in enumerate(parts):
                a, b, first, last = a + lo, b + lo, k == 0, k == len(parts) - 1
                x = _inwards(sizes, a, b, pad, True) if first else _outwards(sizes, a, pad, True)
                y = _inwards(sizes, a, b, pad, False) if last else _outwards(sizes, b, pad, False)
                rows.append((key[0], len(rows), min(a, x), max(b, y), max(a, x), min(b, y), first, last, not last))
        return pd.DataFrame(rows, columns=[by, *(c.split()[0] for c in PLAN.split(", "))])

    return left.join(edited, by, "left_semi").unionByName(right).groupBy(by).applyInPandas(run, f"{by} {kind}, {PLAN}")


def trim_neighbours(frames: DataFrame, by: str = "rec") -> DataFrame:
    """frames with n: samples to read. Next to deleted frames (dst_n 0) the speed stays, and what is too much is cut off."""
    w = W.partitionBy(by).orderBy("frame")
    gone = F.col("dst_n") == 0
    near = F.coalesce(F.lag("tw_gone").over(w), F.lit(False)) | F.coalesce(F.lead("tw_gone").over(w), F.lit(False))
    df = frames.withColumn("tw_gone", gone)
    value = F.when(gone, 0).when(near, F.least("src_n", "dst_n")).otherwise(F.col("src_n"))
    return df.withColumn("n", value.cast("long")).drop("tw_gone")


def split_evenly(df: DataFrame, size: str, limit: int) -> DataFrame:
    """df with part and part_size: a size in the fewest parts of `limit` at most, as equal as whole numbers can be."""
    n = F.col(size).cast("long")
    k = F.greatest(F.ceil(n / limit), F.lit(1))
    out = df.withColumn("tw_k", k).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tw_k") - 1)))
    i, k = F.col("part"), F.col("tw_k")
    return out.withColumn("part_size", F.expr(f"((part + 1) * CAST({size} AS BIGINT)) DIV tw_k - (part * CAST({size} AS BIGINT)) DIV tw_k")).drop("tw_k")


def summary(frames: DataFrame, by: str = "rec") -> DataFrame:
    """Per recording: frames, those that are left, durations before and after, and whether nothing is left."""
    return frames.groupBy(by).agg(F.count("*").alias("n_frames"), F.count(F.when(F.col("dst") > 0, 1)).alias("n_kept"), F.sum("src").alias("src"), F.sum("dst").alias("dst"), (F.max("dst") <= 0).alias("is_empty"))
