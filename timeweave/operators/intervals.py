"""Interval algebra per recording: runs of flags, morphology, overlays and as-of lookups, each in one exchange by recording."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def run_number(by: str, idx: str, value: Column) -> Column:
    """A number for each maximal run of equal values in order of idx; needs `lagged` columns no join, just a window."""
    return F.sum(value.cast("int")).over(W.partitionBy(by).orderBy(idx))


def islands(df: DataFrame, by: str = "rec", idx: str = "idx", flag: str = "flag") -> DataFrame:
    """by, beg, fin: maximal runs [beg, fin) of true flags. idx counts without gaps; a null flag is false."""
    k = F.col(idx) - F.row_number().over(W.partitionBy(by).orderBy(idx))
    return df.filter(F.col(flag)).select(by, idx, k.alias("tw_k")).groupBy(by, "tw_k").agg(F.min(idx).alias("beg"), (F.max(idx) + 1).alias("fin")).drop("tw_k")


def min_runs(runs: DataFrame, least: int) -> DataFrame:
    """Runs of at least that length."""
    return runs.filter(F.col("fin") - F.col("beg") >= least)


def with_runs(df: DataFrame, by: str, idx: str, flag: str, run: str) -> DataFrame:
    """df with the number of the run of equal flags that each row is in."""
    changed = F.col(flag) != F.lag(flag).over(W.partitionBy(by).orderBy(idx))
    df = df.withColumn("tw_change", F.coalesce(changed, F.lit(True)))
    return df.withColumn(run, run_number(by, idx, F.col("tw_change"))).drop("tw_change")


def _without_short(df: DataFrame, by: str, idx: str, flag: str, least: int, value: bool) -> DataFrame:
    """Flags with the runs of `value` that are shorter than `least` turned over."""
    df = with_runs(df, by, idx, flag, "tw_run")
    size = F.count(F.lit(1)).over(W.partitionBy(by, "tw_run"))
    short = (size < least) & (F.col(flag) == value)
    return df.withColumn(flag, F.when(short, F.lit(not value)).otherwise(F.col(flag))).drop("tw_run")


def close_open(df: DataFrame, least: int, by: str = "rec", idx: str = "idx", flag: str = "flag") -> DataFrame:
    """Runs of false shorter than `least` become true, then runs of true shorter than that become false. A null flag is false.

    Both passes share one exchange by recording."""
    df = df.withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))
    return _without_short(_without_short(df, by, idx, flag, least, False), by, idx, flag, least, True)


def run_seconds(runs: DataFrame, hop: int, rate: int, multi: float, by: str = "rec") -> DataFrame:
    """Runs of frames as changes in seconds."""
    return runs.select(by, (F.col("beg") * hop / rate).alias("beg"), (F.col("fin") * hop / rate).alias("fin"), F.lit(float(multi)).alias("multi"))


def violations(changes: DataFrame, by: str = "rec") -> DataFrame:
    """Changes that break 0 <= beg < fin <= the next one's beg, or have a null in them."""
    following = F.lead("beg").over(W.partitionBy(by).orderBy("beg", "fin"))
    good = (F.col("beg") >= 0) & (F.col("beg") < F.col("fin")) & (following.isNull() | (F.col("fin") <= following))
    return changes.withColumn("tw_good", F.coalesce(good, F.lit(False))).filter("NOT tw_good").drop("tw_good")


def combine(primary: DataFrame, supplement: DataFrame, by: str = "rec") -> DataFrame:
    """by, beg, fin, multi: all of primary, and of supplement what primary leaves uncovered. Each side must be disjoint in itself."""
    return combine_by_priority([primary, supplement], by)


def combine_by_priority(methods: Sequence[DataFrame], by: str = "rec") -> DataFrame:
    """The changes of several methods, the first having priority."""
    ranked = [m.select(by, "beg", "fin", "multi", F.lit(k).alias("tw_rank")) for k, m in enumerate(methods)]
    return by_rank(reduce(DataFrame.unionByName, ranked), len(ranked), by, "tw_rank")


def by_rank(changes: DataFrame, ranks: int, by: str = "rec", rank: str = "rank") -> DataFrame:
    """by, beg, fin, multi: of changes whose rank is 0 to ranks - 1, what none of a lower rank covers. Those of one rank must be
    disjoint; empty ones are left out.

    One sweep over the ends of all: they are sorted once per recording, however many intervals overlap and however many ranks
    there are, and nothing is joined. Where the change that counts becomes another, a piece ends.
    """
    begin = F.struct(F.col("beg").alias("tw_at"), F.lit(1).alias("tw_open"), F.col("beg").alias("tw_beg"), F.col("multi").cast("double").alias("tw_multi"))
    end = F.struct(F.col("fin").alias("tw_at"), F.lit(0).alias("tw_open"), F.lit(None).cast("double").alias("tw_beg"), F.lit(None).cast("double").alias("tw_multi"))
    ends = changes.filter(F.col("beg") < F.col("fin")).select(by, F.col(rank).alias("tw_rank"), F.inline(F.array(begin, end)))
    w = W.partitionBy(by).orderBy("tw_at", "tw_open")
    so_far = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    last = [F.last(F.when(F.col("tw_rank") == k, F.struct("tw_open", "tw_beg", "tw_multi")), True).over(so_far).alias(f"tw_{k}") for k in range(ranks)]
    counts = F.coalesce(*(F.when(F.col(f"tw_{k}.tw_open") == 1, F.struct(F.lit(k).alias("rank"), F.col(f"tw_{k}.tw_beg").alias("beg"), F.col(f"tw_{k}.tw_multi").alias("multi"))) for k in range(ranks)))
    swept = ends.select(by, "tw_at", "tw_open", F.lead("tw_at").over(w).alias("tw_next"), *last).filter("tw_next IS NULL OR tw_at < tw_next")
    steps = swept.select(by, "tw_at", "tw_open", counts.alias("tw_now")).withColumn("tw_before", F.lag("tw_now").over(w)).filter("NOT (tw_now <=> tw_before)")
    return steps.select(by, F.col("tw_at").alias("beg"), F.lead("tw_at").over(w).alias("fin"), "tw_now").filter("tw_now IS NOT NULL").select(by, "beg", "fin", F.col("tw_now.multi").alias("multi"))


def row_columns(columns: Sequence[str], by: str) -> list[Column]:
    """The columns of tw_row, the recording taken from tw_by: so it is known to be what the rows are partitioned by."""
    return [F.col("tw_by").alias(by) if c == by else F.col("tw_row")[c].alias(c) for c in columns]


def as_of(left: DataFrame, right: DataFrame, by: str, left_at: Column, right_at: Column, value: Column, name: str, backwards: bool = False) -> DataFrame:
    """left with `name`: value of the right row of greatest right_at <= left_at (least >= left_at if backwards), or null.

    Both sides are sorted together in one exchange by recording; nothing is joined. Of equal right_at the greatest value counts
    (the least if backwards).
    """
    columns = left.columns
    l = left.select(F.col(by).alias("tw_by"), left_at.alias("tw_at"), F.lit(1).alias("tw_kind"), F.struct(*(F.col(c) for c in columns)).alias("tw_row"))
    r = right.select(F.col(by).alias("tw_by"), right_at.alias("tw_at"), F.lit(0).alias("tw_kind"), value.alias("tw_value"))
    both = l.unionByName(r, allowMissingColumns=True)
    at, kind, v = F.col("tw_at"), F.col("tw_kind"), F.col("tw_value")
    order = (at.desc(), kind, v.desc()) if backwards else (at, kind, v)
    w = W.partitionBy("tw_by").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return both.withColumn(name, F.last("tw_value", True).over(w)).filter("tw_kind = 1").select(*row_columns(columns, by), name)


def merged(ranges: DataFrame, by: str = "rec") -> DataFrame:
    """by, beg, fin: overlapping or touching ranges made one."""
    w = W.partitionBy(by).orderBy("beg", "fin")
    reach = F.max("fin").over(w.rowsBetween(W.unboundedPreceding, -1))
    opened = ranges.withColumn("tw_new", F.coalesce(F.col("beg") > reach, F.lit(True)).cast("int"))
    grouped = opened.withColumn("tw_g", F.sum("tw_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return grouped.groupBy(by, "tw_g").agg(F.min("beg").alias("beg"), F.max("fin").alias("fin")).drop("tw_g")


def first_overlap_tail(df: DataFrame, keep: int, by: str = "rec", idx: str = "idx", sound: str = "sound", flag: str = "flag") -> DataFrame:
    """Of each run of false flags, the first stretch without sound in it keeps its last `keep` frames, if it is longer than that.

    Stretches of silence are the runs of false `sound`; both kinds of run are numbered in one exchange by recording."""
    df = with_runs(with_runs(df, by, idx, flag, "tw_red"), by, idx, sound, "tw_sil")
    silent = ~F.col(sound)
    in_red = W.partitionBy(by, "tw_red")
    first = F.min(F.when(silent, F.col("tw_sil"))).over(in_red)
    df = df.withColumn("tw_common", ~F.col(flag) & silent & (F.col("tw_sil") == first))
    size, end = F.sum(F.col("tw_common").cast("int")).over(in_red), F.max(F.when(F.col("tw_common"), F.col(idx) + 1)).over(in_red)
    restored = F.col("tw_common") & (size > keep) & (F.col(idx) >= end - keep)
    return df.withColumn("tw_restored", F.coalesce(restored, F.lit(False))).withColumn(flag, F.col(flag) | F.col("tw_restored")).drop("tw_red", "tw_sil", "tw_common", "tw_restored")
