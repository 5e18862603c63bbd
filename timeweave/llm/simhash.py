"""SimHash near-duplicates: fingerprints split into blocks that close pairs must share, joined on blocks, verified by Hamming distance."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from timeweave.llm.common import fresh, parts, small_batches, written
from timeweave.llm.textbatch import ALNUM, U, mixed, texts, words

BITS = 256
#: Documents are near duplicates up to this Hamming distance.
DISTANCE = 26
#: Bits of a block at least; members of a bucket by chance, as a power of 2, from which blocks are made wider.
NARROW, CROWD = 16, 5
#: Bytes of records in a part of the join. Buckets of more than ROWS records are salted; they are found in a sample of about SAMPLE
#: fingerprints, in which they occur SEEN times at least.
PART_BYTES, ROWS, SAMPLE, SEEN = 1 << 25, 1 << 18, 1 << 16, 16
#: Buckets up to this size are compared all at once.
SMALL = 24
LANES = [U(x) for x in (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0, 0x082EFA98EC4E6C89)]


class Blocks(NamedTuple):
    """The bits of each block (block, bit); a pair within the distance agrees on all bits of at least one."""

    masks: np.ndarray
    bits: int  # of the narrowest


def pigeonhole(groups: int, distance: int, bits: int = BITS) -> Blocks:
    """Blocks that every pair of fingerprints within `distance` shares one of.

    The bits fall into groups; of so many different bits, one group has at most e = distance // groups. Within a group each bit has
    a vector of e + 1 binary digits, and each block, one per vector but 0, has the bits whose product with its vector is odd. The vectors
    of e bits leave a direction that is at right angles to all of them: its block has none of these bits.
    """
    wide = distance // groups + 1
    digits = lambda v: v[:, None] >> np.arange(wide) & 1
    vectors = digits(np.arange(1, 1 << wide))
    rng = np.random.default_rng(11)
    order, out = rng.permutation(bits), []
    for g in range(groups):
        own = order[bits * g // groups : bits * (g + 1) // groups]
        tried = [(vectors @ vectors[rng.permutation(len(vectors))[np.arange(len(own)) % len(vectors)]].T) % 2 == 1 for _ in range(100)]
        masks = np.zeros((len(vectors), bits), bool)
        masks[:, own] = max(tried, key=lambda m: m.sum(axis=1).min())  # the narrowest block decides
        out.append(masks)
    masks = np.concatenate(out)
    return Blocks(masks, int(masks.sum(axis=1).min()))


def blocks_for(n: int, distance: int = DISTANCE) -> Blocks:
    """For n fingerprints: the fewest blocks that are wide enough. All choices find the same pairs, at different costs."""
    best = None
    for groups in range(1, distance + 2):
        if 1 << distance // groups > 256:  # thousands of blocks
            continue
        count = groups * ((1 << distance // groups + 1) - 1)
        bits = BITS / groups * (1 << distance // groups) / ((1 << distance // groups + 1) - 1)
        enough = bits >= max(NARROW, math.log2(max(n, 2)) - CROWD)
        rank = (not enough, count if enough else -bits)
        if best is None or rank < best[0]:
            best = (rank, groups)
    return pigeonhole(best[1], distance)


def fingerprints(data: np.ndarray, weights: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """One row of four 64-bit words for each document, from the hashes of its different words and their weights; starts: where each begins."""
    out = np.zeros((len(starts), BITS // 64), np.uint64)
    ends = np.r_[starts[1:], len(data)]
    lo = 0
    while lo < len(starts):  # a few thousand words at once, whose bits fit the cache
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + 4096, "right")))
        piece, w = data[starts[lo] : ends[hi - 1]], weights[starts[lo] : ends[hi - 1]]
        at = starts[lo:hi] - starts[lo]
        whole = np.add.reduceat(w, at)[:, None]
        for lane, salt in enumerate(LANES):
            bits = np.unpackbits(mixed(piece ^ salt).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            sums = np.add.reduceat(bits * w[:, None], at, axis=0)
            out[lo:hi, lane] = np.packbits(2 * sums >= whole, axis=1, bitorder="little").view(np.uint64)[:, 0]
        lo = hi
    return out


def word_weights(count: np.ndarray) -> np.ndarray:
    """log2(1 + count) in 32nds, as whole numbers: sums don't depend on the order of the words."""
    return np.rint(32 * np.log2(1.0 + count)).astype(np.int32)


def text_fingerprints(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have words, and their fingerprints. Words: runs of ASCII letters, digits and characters beyond ASCII, in lower case."""
    rows, prints = [], []
    lowered = pc.utf8_lower(column)
    for t in texts(lowered):
        w = words(t, ALNUM)
        if len(w.hash):
            order = np.lexsort((w.hash, w.doc))
            h, d = w.hash[order], w.doc[order]
            new = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])])
            count = np.diff(np.r_[new, len(h)])
            h, d = h[new], d[new]
            starts = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
            rows.append(d[starts] + t.lo)
            prints.append(fingerprints(h, word_weights(count), starts))
    if not rows:
        return np.zeros(0, np.int64), np.zeros((0, BITS // 64), np.uint64)
    return np.concatenate(rows), np.concatenate(prints)


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, prints = text_fingerprints(batch.column(1))
        if len(rows):
            kept = pa.array(rows)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(kept), batch.column(2).take(kept), *(pa.array(prints[:, k].view(np.int64)) for k in range(BITS // 64))], ["doc_id", "said", *LONGS])


LONGS = ["f0", "f1", "f2", "f3"]


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id, said (a hash of the text) and f0..f3, the 256 bits, of each row that has an id and a word."""
    text = F.col("text").cast("string")
    narrow = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("said")).filter("doc_id IS NOT NULL AND text IS NOT NULL")
    return narrow.mapInArrow(_fingerprint_batches, "doc_id long, said long, f0 long, f1 long, f2 long, f3 long")


def block_keys(prints: np.ndarray, blocks: Blocks) -> np.ndarray:
    """A 64-bit key for each row and block: the block's number and its bits, mixed."""
    wide = np.packbits(blocks.masks, axis=1, bitorder="little").view(np.uint64)
    out = np.empty((len(prints), len(wide)), np.uint64)
    for k, mask in enumerate(wide):
        h = np.full(len(prints), k + 1, np.uint64)
        for lane in range(BITS // 64):
            if mask[lane]:
                h = mixed(h * U(0x9E3779B97F4A7C15) + (prints[:, lane] & mask[lane]))
        out[:, k] = h
    return out


class Hot(NamedTuple):
    """Keys of crowded buckets in order, with the number of cells that each is split into and a member's id and fingerprint."""

    keys: np.ndarray
    cells: np.ndarray
    leader: np.ndarray
    prints: np.ndarray


def _matrix(batch: pa.RecordBatch, first: int = 1) -> np.ndarray:
    return np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(first, first + 4)], axis=1).view(np.uint64)


def crowded(nodes: DataFrame, blocks: Blocks, n: int, rows: int = ROWS) -> Hot | None:
    """The keys that more than about `rows` of the n nodes have, counted in a bounded sample; a cell of one holds about that many.

    At most SAMPLE * blocks / SEEN keys, whatever n."""
    if n <= rows:
        return None
    one_in = max(1, n // SAMPLE)
    sample = nodes.filter(F.pmod(F.xxhash64("node", F.lit(5)), F.lit(one_in)) == 0).select("node", *LONGS)

    def keys_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(block_keys(_matrix(batch), blocks).ravel().view(np.int64))], ["key"])

    least = max(2, min(SEEN, rows // one_in), -(-rows // one_in))
    counts = sample.mapInArrow(keys_of, "key long").groupBy("key").agg(F.count("*").alias("c")).filter(F.col("c") >= least).toArrow()
    if not counts.num_rows:
        return None
    many = np.sort(counts["key"].to_numpy())

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = block_keys(_matrix(batch), blocks).view(np.int64)
            row, column = np.nonzero(np.isin(keys, many))
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(keys[row, column]), *(c.take(at) for c in batch.columns)], ["key", "node", *LONGS])

    wide = "key long, node long, f0 long, f1 long, f2 long, f3 long"
    found = sample.mapInArrow(members, wide).groupBy("key").agg(F.count("*").alias("c"), F.min(F.struct("node", *LONGS)).alias("m"))
    t = found.select("key", "c", "m.*").toArrow()
    keys = t["key"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    prints = np.stack([t[c].to_numpy() for c in LONGS], axis=1).view(np.uint64)
    return Hot(keys[order], -(-t["c"].to_numpy()[order] * one_in // rows), t["node"].to_numpy()[order], prints[order])


def _cells(keys: np.ndarray, row: np.ndarray, ids: np.ndarray, prints: np.ndarray, hot: Hot, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and rows, crowded buckets split into cells. A row near the bucket's leader goes to one cell; the leader and the others
    go to all. So two rows meet unless both are near the leader, who connects them."""
    at = np.minimum(np.searchsorted(hot.keys, keys), len(hot.keys) - 1)
    hit = np.flatnonzero(hot.keys[at] == keys)
    if not len(hit):
        return keys, row
    at, who = at[hit], row[hit]
    near = (np.bitwise_count(prints[who] ^ hot.prints[at]).sum(axis=1, dtype=np.int64) <= distance) & (ids[who] != hot.leader[at])
    one = mixed(keys[hit] ^ mixed(ids[who].view(np.uint64))) % hot.cells[at].astype(np.uint64)
    times = np.where(near, 1, hot.cells[at])
    again = np.repeat(np.arange(len(hit)), times)
    number = np.arange(len(again)) - np.repeat(np.cumsum(times) - times, times)
    cell = np.where(near[again], one[again].astype(np.int64), number)
    rest = np.ones(len(keys), bool)
    rest[hit] = False
    return np.r_[keys[rest], mixed(keys[hit][again] + U(0x9E3779B97F4A7C15) * (cell.astype(np.uint64) + U(1)))], np.r_[row[rest], who[again]]


def _spread(blocks: Blocks, n_parts: int, hot: Hot | None, distance: int):
    """Packs (key, id, fingerprint) of all blocks by the part that a key belongs to, in order of the keys: a row per part instead of one per key."""
    size = (1 << 64) // n_parts + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                piece = batch.slice(lo, 4096)
                ids, prints = piece.column(0).to_numpy(zero_copy_only=False), _matrix(piece)
                keys = block_keys(prints, blocks)
                row = np.repeat(np.arange(len(ids)), keys.shape[1])
                keys = keys.ravel()
                if hot:
                    keys, row = _cells(keys, row, ids, prints, hot, distance)
                order = np.argsort(keys)
                keys, row = keys[order], row[order]
                edge = np.searchsorted(keys // U(size), np.arange(n_parts + 1, dtype=np.uint64))
                record = np.empty((len(keys), 6), np.uint64)
                record[:, 0], record[:, 1], record[:, 2:] = keys, ids.view(np.uint64)[row], prints[row]
                full = np.flatnonzero(edge[1:] > edge[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array([record[edge[p] : edge[p + 1]].tobytes() for p in full], pa.binary())], ["part", "blob"])

    return run


def _find(parent: dict[int, int], x: int) -> int:
    root = x
    while parent.get(root, root) != root:
        root = parent[root]
    while parent.get(x, x) != x:
        parent[x], x = root, parent[x]
    return root


def _union(parent: dict[int, int], a: int, b: int) -> None:
    a, b = _find(parent, a), _find(parent, b)
    if a != b:
        parent[max(a, b)] = min(a, b)


def bucket_links(ids: np.ndarray, prints: np.ndarray, distance: int, parent: dict[int, int]) -> None:
    """Unites the members of one bucket that are within `distance`, so that what is connected by such pairs is connected.

    A few leaders absorb members near them, which needs no pair of absorbed ones. All members outside of the largest cluster
    are then compared with every member, in blocks, so that no close pair between clusters is lost.
    """
    left = np.arange(len(ids))
    cluster = np.full(len(ids), -1)
    for k in range(8):
        if not len(left):
            break
        near = np.bitwise_count(prints[left] ^ prints[left[0]]).sum(axis=1, dtype=np.int64) <= distance
        cluster[left[near]] = k
        for x in ids[left[near]][1:].tolist():
            _union(parent, int(ids[left[0]]), x)
        left = left[~near]
    largest = np.bincount(cluster[cluster >= 0]).argmax()
    outside = np.flatnonzero(cluster != largest)
    step = max(1, (1 << 20) // len(ids))
    for lo in range(0, len(outside), step):
        rows = outside[lo : lo + step]
        near = np.zeros((len(rows), len(ids)), np.uint16)
        for lane in range(prints.shape[1]):
            near += np.bitwise_count(prints[rows, lane][:, None] ^ prints[None, :, lane])
        for a, b in zip(*np.nonzero(near <= distance)):
            if rows[a] != b:
                _union(parent, int(ids[rows[a]]), int(ids[b]))


def part_edges(records: np.ndarray, distance: int) -> np.ndarray:
    """Edges (id, lowest id it is connected with) of all buckets of a part. records: rows of key, id, fingerprint."""
    records = records[np.argsort(records[:, 0], kind="stable")]
    keys = records[:, 0]
    bounds = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
    size = np.diff(bounds)
    ids, prints = records[:, 1].view(np.int64), records[:, 2:]
    parent: dict[int, int] = {}
    left = np.repeat(np.where(size <= SMALL, bounds[1:], 0), size) - np.arange(len(keys))  # rows of the bucket from this one on
    first, pairs = np.flatnonzero(left > 1), []
    for ahead in range(1, SMALL):
        first = first[left[first] > ahead]
        if not len(first):
            break
        near = np.zeros(len(first), np.uint16)
        for lane in range(prints.shape[1]):
            near += np.bitwise_count(prints[first, lane] ^ prints[first + ahead, lane])
        close = first[near <= distance]
        pairs.append(np.sort(np.stack([ids[close], ids[close + ahead]], axis=1), axis=1))
    if pairs:
        for a, b in np.unique(np.concatenate(pairs), axis=0).tolist():
            _union(parent, a, b)
    for k in np.flatnonzero(size > SMALL):
        span = slice(bounds[k], bounds[k + 1])
        bucket_links(ids[span], prints[span], distance, parent)
    return np.array([(x, _find(parent, x)) for x in list(parent)], np.int64).reshape(-1, 2)


def _linked(distance: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        records = np.frombuffer(b"".join(pdf["blob"]), np.uint64).reshape(-1, 6)
        edges = part_edges(records, distance)
        edges = edges[edges[:, 0] != edges[:, 1]]
        return pd.DataFrame({"u": edges[:, 0], "v": edges[:, 1]})

    return run


def components(edges: DataFrame) -> DataFrame:
    """u, root: the lowest id connected with u, for each u of the edges (u, v) that isn't its own root.

    Alternating large-star and small-star steps (Kiveris et al., 2014): each is one shuffle of the edges; the number of
    steps grows with the logarithm of the longest path. Every step's table is written.
    """
    e = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "cc")
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = F.least(F.min("v").over(W.partitionBy("u")), F.col("u"))
        large = both.withColumn("m", low).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        m = F.min("v").over(W.partitionBy("u"))
        small = large.withColumn("m", m)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        e = written(small, "cc")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.when(F.col("v") == F.col("u"), 1))).first()
        if now == before:
            return e.select("u", F.col("v").alias("root"))
        before = now


def classes(docs: DataFrame, distance: int = DISTANCE, rows: int = ROWS) -> DataFrame:
    """doc_id, said (a hash of the text) and group, the same number for texts that pairs within `distance` connect, of every row with
    an id and a word. rows: see ROWS."""
    prints = written(fingerprint(docs), "simhash")
    nodes = written(prints.select(*LONGS).distinct().withColumn("node", F.monotonically_increasing_id()), "simhash-nodes")
    n = nodes.count()
    blocks = blocks_for(n, distance)
    n_parts = max(parts(docs.sparkSession), -(-n * len(blocks.masks) * 48 // PART_BYTES))
    spread = nodes.select("node", *LONGS).mapInArrow(_spread(blocks, n_parts, crowded(nodes, blocks, n, rows), distance), "part int, blob binary")
    edges = written(spread.repartition(n_parts, "part").groupBy("part").applyInPandas(_linked(distance), "u long, v long"), "simhash-edges")
    roots = components(edges).withColumnRenamed("u", "node")
    grouped = nodes.join(roots, "node", "left").select(*LONGS, F.coalesce("root", "node").alias("group"))
    return prints.join(grouped, LONGS).select("doc_id", "said", "group")


def near_duplicates(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """doc_id and duplicate_of, the lowest doc_id of its group, for each document that isn't the first of its group.

    docs: needs doc_id and text. The fingerprint has 256 bits: for each, the majority over the text's different words (in lower case, without
    punctuation) of that bit of the word's hash, a word weighing the logarithm of one more than its number. Equal fingerprints are joined to one. The others are
    split into blocks so that any two within `distance` share one (see `pigeonhole`), fingerprints that share a block are
    compared in full, and a group is what pairs within `distance` connect: no such pair is missed, and none beyond counts.

    Documents without a word (null, empty, punctuation alone) or without an id are in no group. Rows that share a doc_id are one
    document, in the group with the lowest doc_id of those that its texts are in. Other columns aren't read. An empty
    table gives an empty one.
    """
    own = written(classes(docs, distance), "simhash-classes")
    first = own.groupBy("group").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    joined = own.join(first, "group").groupBy("doc_id").agg(F.min("first").alias("duplicate_of"))
    return joined.filter("duplicate_of < doc_id")


def drop_near_duplicates(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """docs with one row of each group of near duplicates: of the lowest doc_id in it, and of its texts in the group that of the lowest hash.

    Rows of one doc_id whose texts are in different groups are judged apart. Of rows that repeat a doc_id and its text, one stays:
    that of the lowest hash of all columns. Rows in no group stay as they are, repeated or not; so do all rows without an id or
    a word. All columns are kept. Rows are shuffled once, by id and hash of the text, against those to drop (hash join, no sort).
    """
    own = written(classes(docs, distance), "simhash-classes")
    best = own.groupBy("group").agg(F.min(F.struct("doc_id", "said")).alias("best"), F.count("*").alias("n")).filter("n > 1")
    each = own.join(best, "group").groupBy("doc_id", "said").agg(F.count("*").alias("n"), F.max(F.col("best") == F.struct("doc_id", "said")).alias("stays"))
    each = written(each.filter("n > 1 OR NOT stays").select(F.col("doc_id").alias("tw_id"), F.col("said").alias("tw_said"), "stays"), "simhash-gone")
    same = (docs["doc_id"].cast("long") == each["tw_id"]) & (F.xxhash64(docs["text"].cast("string")) == each["tw_said"])
    kept = docs.join(each.hint("shuffle_hash"), same, "left_anti")
    repeated = each.filter("stays")
    if repeated.isEmpty():
        return kept
    rank, said = fresh(docs, "tw_rank"), fresh(docs, "tw_text")
    several = docs.join(repeated.hint("shuffle_hash"), same, "left_semi").withColumn(said, F.xxhash64(F.col("text").cast("string")))
    order = F.xxhash64(*(F.to_json(F.struct(F.col(f"`{c}`"))) for c in docs.columns))
    once = several.withColumn(rank, F.row_number().over(W.partitionBy(F.col("doc_id").cast("long"), said).orderBy(order))).filter(F.col(rank) == 1)
    return kept.unionByName(once.drop(rank, said))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
