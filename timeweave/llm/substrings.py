"""Substring dedup by level-wise doubling: windows that repeat at one length alone are extended to twice that length."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timeweave.llm.common import discard, input_bytes, parts, small_batches, written
from timeweave.llm.textbatch import U, WHITE, mixed, powers, texts, words

#: Words of the shortest repeated passage that is reported, an even number; the first level has windows of half as many.
WINDOW = 50
STEP, STEP_INV = 0xD1342543DE82EF95, pow(0xD1342543DE82EF95, -1, 1 << 64)
NOT_WHITE = ~WHITE
#: Entries that a task gathers before it packs them.
GATHER = 1 << 19
#: Bytes of input for each part of an exchange, where the session's number of partitions gives more.
PART_BYTES = 1 << 24
#: A window at a place of a document (key: hash of its words; id). times: 2 if more rows than one are this document's copies.
ENTRY = np.dtype([("hash", "<u8"), ("key", "<u8"), ("id", "<i8"), ("at", "<i4"), ("times", "u1")])


def window_hashes(h: np.ndarray, length: int) -> np.ndarray:
    """A hash of h[i:i+length] for each i that has so many words after it, ends of documents aside."""
    n = len(h)
    if n < length:
        return np.zeros(0, np.uint64)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(h * powers(STEP, n), out=total[1:])
    return mixed((total[length:] - total[:-length]) * powers(STEP_INV, n)[: n - length + 1])


def sliding_argmin(x: np.ndarray, width: int) -> np.ndarray:
    """Where the least of x[i:i+width] is (the leftmost of equal ones), by doubling the width."""
    if len(x) < width:
        return np.zeros(0, np.int64)
    best = np.arange(len(x))
    have = 1
    while have < width:
        add = min(have, width - have)
        left, right = best[: len(best) - add], best[add:]
        best = np.where(x[right] < x[left], right, left)
        have += add
    return best


def document_keys(t, w) -> np.ndarray:
    """A hash of each text's words: with the id, it tells rows of one id with different texts apart."""
    total = np.zeros(len(w.hash) + 1, np.uint64)
    np.cumsum(w.hash * powers(STEP, max(len(w.hash), 1))[: len(w.hash)], out=total[1:])
    if not len(w.hash):
        return np.zeros(len(t.bounds) - 1, np.uint64)
    return mixed((total[w.first[1:]] - total[w.first[:-1]]) * powers(STEP_INV, len(w.hash) + 1)[w.first[:-1]] + np.diff(w.first).astype(np.uint64))


def anchors(w, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window that lies in one document: where it starts, and where the least of its half-long windows starts.

    The choice depends on the window's words alone: equal windows have their anchor at the same place within them.
    """
    half = window // 2
    starts = np.arange(max(len(w.hash) - window + 1, 0))
    starts = starts[w.doc[starts] == w.doc[starts + window - 1]] if len(starts) else starts
    least = sliding_argmin(window_hashes(w.hash, half), half + 1)
    return starts, least[starts] if len(starts) else starts


PACKED = "part int, blob binary"
NONE = pd.DataFrame({"part": np.zeros(0, np.int32), "blob": []})


def to_bytes(e: np.ndarray) -> bytes:
    """Column by column, places as differences: what repeats is next to each other, for the shuffle's compression."""
    return b"".join((np.int64(len(e)).tobytes(), e["hash"].tobytes(), e["key"].tobytes(), e["id"].tobytes(), np.diff(e["at"], prepend=np.int32(0)).tobytes(), e["times"].tobytes()))


def from_bytes(blobs) -> np.ndarray:
    sizes = [int.from_bytes(b[:8], "little") for b in blobs]
    out = np.empty(sum(sizes), ENTRY)
    lo = 0
    for b, n in zip(blobs, sizes):
        part = out[lo : lo + n]
        part["hash"] = np.frombuffer(b, np.uint64, n, 8)
        part["key"] = np.frombuffer(b, np.uint64, n, 8 + 8 * n)
        part["id"] = np.frombuffer(b, np.int64, n, 8 + 16 * n)
        part["at"] = np.cumsum(np.frombuffer(b, np.int32, n, 8 + 24 * n), dtype=np.int32)
        part["times"] = np.frombuffer(b, np.uint8, n, 8 + 28 * n)
        lo += n
    return out


def packed(entries: np.ndarray, n_parts: int, by: str = "hash") -> tuple[np.ndarray, list[bytes]]:
    """Entries as one binary value per part that their hash, or document, belongs to."""
    part = (mixed(entries[by] ^ U(0x5851F42D4C957F2D)) % U(n_parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    entries = entries[order]
    edge = np.searchsorted(part[order], np.arange(n_parts + 1))
    full = np.flatnonzero(edge[1:] > edge[:-1])
    return full.astype(np.int32), [to_bytes(entries[edge[p] : edge[p + 1]]) for p in full]


def _frame(entries: np.ndarray, n_parts: int, by: str = "hash") -> pd.DataFrame:
    if not len(entries):
        return NONE
    part, blob = packed(entries, n_parts, by)
    return pd.DataFrame({"part": part, "blob": blob})


def _entries(hashes, keys, ids, at, times) -> np.ndarray:
    out = np.empty(len(hashes), ENTRY)
    out["hash"], out["key"], out["id"], out["at"], out["times"] = hashes, keys, ids, at, times
    return out


def _gathered(pieces: Iterator[np.ndarray], n_parts: int) -> Iterator[pa.RecordBatch]:
    """Packs entries once there are many."""
    held: list[np.ndarray] = []
    n = 0
    for e in pieces:
        held.append(e)
        n += len(e)
        if n >= GATHER:
            part, blob = packed(np.concatenate(held), n_parts)
            held, n = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(blob, pa.binary())], ["part", "blob"])
    if n:
        part, blob = packed(np.concatenate(held), n_parts)
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(blob, pa.binary())], ["part", "blob"])


#: times of a document's first entry, besides its number of copies
FIRST = 128


def _anchor_batches(window: int, n_parts: int):
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for t in texts(batch.column(1)):
                w = words(t, NOT_WHITE)
                _, least = anchors(w, window)
                if len(least):
                    at = np.unique(least)
                    doc = w.doc[at]
                    first = np.r_[True, doc[1:] != doc[:-1]]
                    yield _entries(window_hashes(w.hash, window // 2)[at], document_keys(t, w)[doc], ids[t.lo + doc], at - w.first[doc], 1 + FIRST * first)

    return lambda batches: _gathered(pieces(batches), n_parts)


def _bounds(*columns: np.ndarray) -> np.ndarray:
    """Where rows begin that differ from the row before in any of the columns."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def repeated(entries: np.ndarray) -> np.ndarray:
    """Those of the entries whose hash occurs at least twice, copies counted."""
    e = entries[np.argsort(entries["hash"], kind="stable")]
    if not len(e):
        return e
    first = np.flatnonzero(_bounds(e["hash"]))
    total = np.add.reduceat(e["times"].astype(np.int64), first)
    return e[np.repeat(total > 1, np.diff(np.r_[first, len(e)]))]


HITS = "id long, key long, copy_of long, times int, places binary"


def _repeated_anchors(pdf: pd.DataFrame) -> pd.DataFrame:
    """Anchors that repeat, of the first document (lowest id) of each set of copies, with the number of copies, 2 at most;
    and, for each other copy, once, whose copy it is. The copies' own windows need no comparison: they are the first's."""
    e = from_bytes(pdf["blob"])
    e = e[np.lexsort((e["id"], e["at"], e["key"], e["hash"]))]
    is_first, e["times"] = e["times"] >= FIRST, e["times"] & 127
    group = np.flatnonzero(_bounds(e["hash"], e["key"], e["at"]))
    size = np.diff(np.r_[group, len(e)])
    owner = np.repeat(e["id"][group], size)
    copies = is_first & (e["id"] != owner)
    rep = e[group]
    rep["times"] = np.minimum(size, 2)
    rep = repeated(rep)
    rep = rep[np.lexsort((rep["at"], rep["key"], rep["id"]))]
    new = np.flatnonzero(_bounds(rep["id"], rep["key"])) if len(rep) else np.zeros(0, np.int64)
    ends = np.r_[new[1:], len(rep)] if len(rep) else new
    at = np.ascontiguousarray(rep["at"])
    hits = pd.DataFrame({"id": rep["id"][new], "key": rep["key"][new].view(np.int64), "copy_of": pd.array([None] * len(new), "Int64"), "times": rep["times"][new].astype(np.int32), "places": [at[a:b].tobytes() for a, b in zip(new, ends)]})
    twins = pd.DataFrame({"id": e["id"][copies], "key": e["key"][copies].view(np.int64), "copy_of": pd.array(owner[copies], "Int64"), "times": np.int32(0), "places": [None] * int(copies.sum())})
    if not len(twins):
        return hits
    return pd.concat([hits, twins], ignore_index=True) if len(hits) else twins


def _candidate_batches(window: int, n_parts: int):
    """Hashes of the windows whose anchor repeats; the other windows can't."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            places = batch.column(2)
            for t in texts(batch.column(1)):
                w = words(t, NOT_WHITE)
                starts, least = anchors(w, window)
                if not len(starts):
                    continue
                keys = document_keys(t, w)
                hit = np.zeros(len(w.hash), bool)
                times = np.zeros(t.hi - t.lo, np.uint8)
                for d in range(t.hi - t.lo):
                    for found in places[t.lo + d].as_py():
                        if np.array(found["key"], np.int64).view(np.uint64) == keys[d]:
                            hit[w.first[d] + np.frombuffer(found["places"], np.int32)] = True
                            times[d] = max(times[d], found["times"])
                starts = starts[hit[least]]
                if len(starts):
                    doc = w.doc[starts]
                    yield _entries(window_hashes(w.hash, window)[starts], keys[doc], ids[t.lo + doc], starts - w.first[doc], times[doc])

    return lambda batches: _gathered(pieces(batches), n_parts)


def _survivors(n_parts: int):
    """Repeated windows, packed by document, each document's together in order of place: most of it compresses to nothing."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        e = repeated(from_bytes(pdf["blob"]))
        return _frame(e[np.lexsort((e["at"], e["id"], e["key"]))], n_parts, "key")

    return run


def by_document(pdf: pd.DataFrame) -> np.ndarray:
    """A part's entries in order of document and place, each once."""
    e = from_bytes(pdf["blob"])
    e = e[np.lexsort((e["at"], e["key"], e["id"]))]
    return e[_bounds(e["id"], e["key"], e["at"])]


STEP_ROWS = "part int, blob binary, doc_id long, key long, start_word long, end_word long"


def _step(length: int, n_parts: int):
    """Of a part's documents: windows of twice the length whose halves both repeat, packed by hash (part, blob); and the spans
    (start, end) of overlapping or touching windows, which have no part."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        e = by_document(pdf)
        at, new = e["at"].astype(np.int64), _bounds(e["id"], e["key"])
        place = np.cumsum(new).astype(np.int64) * (1 << 32) + at
        second = np.searchsorted(place, place + length)
        ok = second < len(place)
        ok[ok] = place[second[ok]] == (place + length)[ok]
        a, b = e[ok], e[second[ok]]
        doubled = _frame(_entries(mixed(a["hash"] * U(STEP) + b["hash"]), a["key"], a["id"], a["at"], a["times"]), n_parts)
        new[1:] |= at[1:] > at[:-1] + length
        first = np.flatnonzero(new)
        last = np.r_[first[1:], len(e)] - 1
        spans = pd.DataFrame({"part": pd.array([None] * len(first), "Int32"), "blob": [None] * len(first), "doc_id": pd.array(e["id"][first], "Int64"), "key": pd.array(e["key"][first].view(np.int64), "Int64"), "start_word": pd.array(at[first], "Int64"), "end_word": pd.array(at[last] + length, "Int64")})
        none = pd.array([None] * len(doubled), "Int64")
        whole = pd.DataFrame({"part": pd.array(doubled["part"], "Int32"), "blob": doubled["blob"].to_numpy(object), "doc_id": none, "key": none, "start_word": none, "end_word": none})
        return pd.concat([f for f in (spans, whole) if len(f)], ignore_index=True) if len(spans) or len(whole) else spans

    return run


def repeated_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, start_word, end_word (half-open, whitespace-separated words), longest: each stretch of a document that is covered
    by windows of `window` words that occur at least twice in the corpus, at any places; longest is the greatest length
    window * 2**k at which a window within the stretch repeats.

    docs: needs doc_id and text. The levels: (1) windows of window/2 words, of which each longer window contains one that its
    words alone choose (a minimizer); those that don't repeat rule out all windows they were chosen for; (2) the windows of
    `window` words that are left are counted; (3) two repeated windows that follow each other make one of twice the
    length, which is counted, and so on until none repeats. Every window is compared; the hashes have 64 bits.

    Equal rows are occurrences of their own, so a repeated row's windows repeat, and are reported once. Rows of one id with
    different texts are each reported. Rows without an id are left out, as are null, empty and shorter texts.
    Other columns aren't read. An empty table gives an empty one.
    """
    if window < 2 or window % 2:
        raise ValueError("window must be even")
    spark = docs.sparkSession
    n = max(parts(spark), input_bytes(docs) // PART_BYTES)
    narrow = small_batches(docs).select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).filter("id IS NOT NULL AND text IS NOT NULL")
    found = written(narrow.mapInArrow(_anchor_batches(window, n), PACKED).groupBy("part").applyInPandas(_repeated_anchors, HITS), "substring-anchors")
    hits = found.filter("copy_of IS NULL").groupBy(F.col("id").alias("tw_id")).agg(F.collect_list(F.struct("key", "times", "places")).alias("places"))
    joined = narrow.join(hits.hint("shuffle_hash"), F.col("id") == F.col("tw_id")).select("id", "text", "places")
    level = written(joined.mapInArrow(_candidate_batches(window, n), PACKED).groupBy("part").applyInPandas(_survivors(n), PACKED), "substring-level")
    length, spans = window, []
    while not level.isEmpty():
        step = written(level.groupBy("part").applyInPandas(_step(length, n), STEP_ROWS), "substring-step")
        spans.append(written(step.filter("part IS NULL").select("doc_id", "key", "start_word", "end_word", F.lit(length).cast("long").alias("length")), "substring-spans"))
        following = written(step.filter("part IS NOT NULL").select("part", "blob").groupBy("part").applyInPandas(_survivors(n), PACKED), "substring-level")
        discard(level)
        discard(step)
        level, length = following, length * 2
    if not spans:
        return spark.createDataFrame([], "doc_id long, start_word long, end_word long, longest long")
    base = spans[0].select("doc_id", "key", "start_word", "end_word")
    if len(spans) == 1:
        own = base.withColumn("longest", F.lit(window).cast("long"))
    else:
        per = functools.reduce(DataFrame.unionByName, spans[1:]).groupBy("doc_id", "key").agg(F.collect_list(F.struct("start_word", "end_word", "length")).alias("l"))
        inside = F.filter("l", lambda x: (x["start_word"] >= F.col("start_word")) & (x["end_word"] <= F.col("end_word")))
        best = F.array_max(F.transform(inside, lambda x: x["length"]))
        own = base.join(per, ["doc_id", "key"], "left").select("doc_id", "key", "start_word", "end_word", F.coalesce(best, F.lit(window).cast("long")).alias("longest"))
    twins = found.filter("copy_of IS NOT NULL").select("id", F.col("copy_of").alias("doc_id"), "key").distinct()
    theirs = own.join(twins, ["doc_id", "key"]).select(F.col("id").alias("doc_id"), "start_word", "end_word", "longest")
    return own.select("doc_id", "start_word", "end_word", "longest").unionByName(theirs).distinct()


def query(spark, sf_dir: str) -> DataFrame:
    return repeated_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql(window: int = WINDOW, levels: int = 10) -> str:
    """All windows of every level, counted by their MD5: what doubling leads to, said outright."""
    each = " UNION ALL ".join(f"SELECT doc_id, r, i, {window << k} AS len, md5(array_to_string(w[i:i + {(window << k) - 1}], ' ')) AS h FROM (SELECT doc_id, r, w, unnest(range(1, len(w) - {(window << k) - 2})) AS i FROM d WHERE len(w) >= {window << k})" for k in range(levels))
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(text, '[ \\t\\n\\r\\f\\x0B]+'), lambda w: w <> '') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
x AS ({each}),
rep AS (SELECT doc_id, r, i, len FROM (SELECT *, count(*) OVER (PARTITION BY len, h) AS n FROM x) WHERE n > 1),
b AS (SELECT *, CASE WHEN i > lag(i) OVER (PARTITION BY r ORDER BY i) + {window} OR lag(i) OVER (PARTITION BY r ORDER BY i) IS NULL THEN 1 ELSE 0 END AS opens FROM rep WHERE len = {window}),
g AS (SELECT *, sum(opens) OVER (PARTITION BY r ORDER BY i) AS g FROM b),
s AS (SELECT doc_id, r, min(i) - 1 AS s, max(i) - 1 + {window} AS e FROM g GROUP BY doc_id, r, g)
SELECT DISTINCT s.doc_id, s.s::BIGINT AS start_word, s.e::BIGINT AS end_word, max(rep.len)::BIGINT AS longest
FROM s JOIN rep ON rep.r = s.r AND rep.i - 1 >= s.s AND rep.i - 1 + rep.len <= s.e GROUP BY s.r, s.doc_id, s.s, s.e
"""


SQL = _sql()
