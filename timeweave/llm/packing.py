"""Best-fit packing of documents into bins of a fixed length, with a lower bound that certifies the number of bins."""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timeweave.llm.common import with_words, written

CAPACITY = 2048
#: Pieces that are packed together by one task.
SHARD = 50_000
#: Shards whose bins may be too many exchange pieces in groups of so many.
FAN_IN = 8
ROUNDS = 3
SCHEMA = "doc_id long, piece long, start long, length long, shard long, bin int, place int, shard_bins int, lower_bound int"


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each piece; lengths must be in decreasing order. Each goes to the fullest bin that it fits, the oldest of those."""
    bins = np.empty(len(lengths), np.int64)
    rooms: list[int] = []  # the different rooms of open bins, ascending
    held: dict[int, list[int]] = {}  # room -> its bins, the oldest last
    n = 0
    for i, size in enumerate(lengths.tolist()):
        k = bisect_left(rooms, size)
        if k == len(rooms):
            at, room = n, capacity
            n += 1
        else:
            room = rooms[k]
            at = held[room].pop()
            if not held[room]:
                del held[room]
                rooms.pop(k)
        bins[i] = at
        room -= size
        if room:
            if room in held:
                same = held[room]
                same.insert(_place(same, at), at)
            else:
                insort(rooms, room)
                held[room] = [at]
    return bins


def _place(same: list[int], at: int) -> int:
    """Where `at` goes in a descending list."""
    lo, hi = 0, len(same)
    while lo < hi:
        mid = (lo + hi) // 2
        if same[mid] > at:
            lo = mid + 1
        else:
            hi = mid
    return lo


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs, by dual feasible functions.

    Such a function f keeps every set of pieces that fits a bin within a bin, so ceil(sum(f(lengths)) / f(capacity)) is a
    bound. Tried: the identity; the staircases u(k) of Fekete and Schepers, that round x*(k+1)/capacity down unless it is
    whole, k up to 20; and the threshold functions U(e), which drop pieces under e and count those over capacity - e as
    full. Thresholds are all the different lengths up to half a bin: between two of them U(e) says no
    more than at the longer, and beyond the longest no more than u(1).
    """
    x = np.asarray(lengths, np.int64)
    x = x[x > 0]
    if not len(x):
        return 0
    best = -(-int(x.sum()) // capacity)
    for k in range(1, 21):
        scaled = x * (k + 1)
        whole = scaled % capacity == 0
        value = np.where(whole, x * k, (scaled // capacity) * capacity)  # times capacity * k
        best = max(best, -(-int(value.sum()) // (capacity * k)))
    size, count = np.unique(x, return_counts=True)
    total = np.concatenate([[0], np.cumsum(size * count)])
    number = np.concatenate([[0], np.cumsum(count)])
    steps = size[size * 2 <= capacity]
    if len(steps):
        low, high = np.searchsorted(size, steps, "left"), np.searchsorted(size, capacity - steps, "right")
        weight = total[high] - total[low] + capacity * (number[-1] - number[high])
        best = max(best, -(-int(weight.max()) // capacity))
    return best


def pack_group(pdf: pd.DataFrame, capacity: int, shard: int) -> pd.DataFrame:
    """Pieces of one shard with their bin, place in it, the shard's bins and its lower bound. Ties go by doc_id, then piece."""
    pdf = pdf.sort_values(["length", "doc_id", "piece", "start"], ascending=[False, True, True, True], kind="stable", na_position="first").reset_index(drop=True)
    lengths = pdf["length"].to_numpy(np.int64)
    bins = best_fit_decreasing(lengths, capacity)
    order = np.argsort(bins, kind="stable")
    opens = np.r_[True, bins[order][1:] != bins[order][:-1]]
    place = np.empty(len(bins), np.int64)
    since = np.arange(len(bins)) - np.maximum.accumulate(np.where(opens, np.arange(len(bins)), 0))
    place[order] = since
    return pdf.assign(shard=shard, bin=bins.astype(np.int32), place=place.astype(np.int32), shard_bins=np.int32(bins.max() + 1), lower_bound=np.int32(lower_bound(lengths, capacity)))[[c.split()[0] for c in SCHEMA.split(", ")]]


def _first(capacity: int):
    def run(key, pdf):
        return pack_group(pdf, capacity, int(key[0]))

    return run


def _exchange(capacity: int, base: int):
    """Packs the pieces of several shards' bins that aren't full anew; keeps the old bins unless there are fewer new ones."""

    def run(key, pdf):
        old = len(pdf[["shard", "bin"]].drop_duplicates())
        new = pack_group(pdf, capacity, base + int(key[0]))
        if int(new["shard_bins"].iloc[0]) < old:
            return new
        return pdf[list(new.columns)]

    return run


def pieces(docs: DataFrame, capacity: int, length: Column | None = None) -> DataFrame:
    """doc_id, piece, start and length: each document cut at multiples of the capacity. Documents without length have none."""
    n = F.col("n")
    lengths = with_words(docs, "doc_id", "long") if length is None else docs.select(F.col("doc_id").cast("long").alias("doc_id"), length.cast("long").alias("n"))
    return (
        lengths.filter(n > 0)
        .select("doc_id", n, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / capacity))).alias("piece"))
        .select("doc_id", "piece", (F.col("piece") * capacity).alias("start"), F.least(F.lit(capacity).cast("long"), n - F.col("piece") * capacity).alias("length"))
    )


def pack(docs: DataFrame, capacity: int = CAPACITY, length: Column | None = None, shard: int = SHARD, rounds: int = ROUNDS) -> DataFrame:
    """Every piece of every document with the bin that holds it.

    docs: needs doc_id, and text unless `length` (tokens of a document; by default its whitespace-separated words) is given.
    Result: doc_id, piece, start (of the piece within its document), length, shard and bin (together they name a bin), place
    (the piece's rank in the bin), shard_bins, lower_bound and certified: whether the shard's number of bins is proven least.

    Pieces are spread over shards by a hash, those that nothing tells apart one by one, and each shard is packed best-fit decreasing. The lower bound of dual feasible
    functions certifies it, or shows a gap; shards with gaps, FAN_IN at a time, exchange the pieces of their bins that aren't
    full and pack those again, up to `rounds` times. A full bin needs no company: shard_bins and lower_bound of rows that
    stay behind are brought up to date for the bins that are left in their shard.

    A document longer than the capacity is cut. Null and empty texts have no piece. A null doc_id is packed like any other;
    equal rows are separate documents. Columns other than those named aren't read. An empty table gives an empty one.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    cut = written(pieces(docs, capacity, length), "pack-pieces")
    shards = max(1, -(-cut.count() // shard))
    # pieces that nothing tells apart, as of rows without an id or the copies of a document, are numbered: each has a shard of its own
    alike = cut.groupBy("doc_id", "piece", "start", "length").agg(F.count("*").alias("tw_n")).withColumn("tw_k", F.explode(F.sequence(F.lit(1).cast("long"), "tw_n")))
    keyed = alike.withColumn("tw_s", F.pmod(F.xxhash64("doc_id", "piece", "length", "tw_k"), F.lit(shards))).drop("tw_n", "tw_k")
    packed = written(keyed.groupBy("tw_s").applyInPandas(_first(capacity), SCHEMA), "pack-0")
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    for r in range(1, rounds + 1):
        open_shards = packed.filter(F.col("shard_bins") > F.col("lower_bound")).select("shard").distinct()
        n = open_shards.count()
        if n < 2:
            break
        groups = -(-n // FAN_IN)
        fill = packed.join(open_shards, "shard", "left_semi").groupBy("shard", "bin").agg(F.sum("length").alias("tw_fill"))
        loose = fill.filter(F.col("tw_fill") < capacity).select("shard", "bin")
        moved = packed.join(loose, ["shard", "bin"], "left_semi").withColumn("tw_g", F.pmod(F.xxhash64("shard", F.lit(r)), F.lit(groups)))
        again = moved.groupBy("tw_g").applyInPandas(_exchange(capacity, r << 40), SCHEMA)
        rest = packed.join(loose, ["shard", "bin"], "left_anti")
        packed = written(_recounted(rest.unionByName(again), capacity), f"pack-{r}")
    return packed.select(*names, (F.col("shard_bins") == F.col("lower_bound")).alias("certified"))


def _recounted(packed: DataFrame, capacity: int) -> DataFrame:
    """shard_bins and lower_bound of what is in each shard now."""

    def run(key, pdf):
        return pdf.assign(shard_bins=np.int32(pdf["bin"].nunique()), lower_bound=np.int32(lower_bound(pdf["length"].to_numpy(), capacity)))

    return packed.groupBy("shard").applyInPandas(run, SCHEMA)


def query(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
