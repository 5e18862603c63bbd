"""Terms of texts, found and counted on the byte buffers of Arrow batches: a few nanoseconds a byte, where a regular expression and a row for each term take many."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that terms consist of: ASCII letters and digits, and all bytes of characters beyond ASCII; of these, U+00A0 is taken out by `counted`.
TERM_BYTE = np.array([b > 127 or chr(b).isalnum() for b in range(256)])
#: Bytes of text that are worked on at once; a longer text is worked on alone.
CHUNK = 1 << 22
#: Rows of a batch that is handed on, and of a vocabulary that is summed up in memory.
ROWS, HELD = 1 << 16, 1 << 21


def counted(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]]:
    """The terms of lower-case texts, as salience.terms finds them: row, code, number of times and the terms by code, in pieces of about CHUNK bytes. A null has none."""
    column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if pa.types.is_large_string(column.type) else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + CHUNK, "right")) - 1)
        text, bounds = whole[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        inside = TERM_BYTE[text]
        blank = np.flatnonzero((text[:-1] == 0xC2) & (text[1:] == 0xA0))
        inside[blank] = inside[blank + 1] = False
        begins = np.ones(len(text) + 1, bool)
        np.logical_not(inside[:-1], out=begins[1 : len(text)])
        begins[bounds] = True
        begins = begins[:-1] & inside
        first = np.append(np.flatnonzero(begins[inside]), np.count_nonzero(inside)).astype(np.int32)
        found = pa.StringArray.from_buffers(len(first) - 1, pa.py_buffer(first), pa.py_buffer(text[inside])).dictionary_encode()
        said = np.diff(np.searchsorted(np.flatnonzero(begins), bounds))
        n = max(1, len(found.dictionary))
        key, times = np.unique(np.repeat(np.arange(lo, hi), said) * n + found.indices.to_numpy(), return_counts=True)
        yield key // n, key % n, times, found.dictionary
        lo = hi


def vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows tw_split, text: tw_split, term, n, the rows of the split that have the term; a term may come more than once, with parts of its n."""

    def summed() -> pa.Table:
        return pa.concat_tables(kept).group_by(["tw_split", "term"]).aggregate([("n", "sum")]).rename_columns(["tw_split", "term", "n"])

    kept, held, least = [], 0, ROWS
    for batch in batches:
        split = batch.column(0).to_numpy().astype(np.int64)
        for row, code, _, terms in counted(batch.column(1)):
            key, n = np.unique(split[row] * max(1, len(terms)) + code, return_counts=True)
            kept.append(pa.table([pa.array(key // max(1, len(terms)), pa.int32()), terms.take(pa.array(key % max(1, len(terms)))), pa.array(n, pa.int64())], ["tw_split", "term", "n"]))
            held += len(n)
            if held > least:
                kept = [summed()]
                held, least = len(kept[0]), 2 * len(kept[0]) + ROWS
                if held > HELD:
                    yield from kept[0].to_batches(ROWS)
                    kept, held, least = [], 0, ROWS
    if kept:
        yield from summed().to_batches(ROWS)


class _Split:
    """The vocabulary of a split, and the document whose rows may not have ended yet."""

    def __init__(self) -> None:
        self.parts: list[pa.Array] = []
        self.idfs: list[np.ndarray] = []
        self.terms: pa.Array | None = None
        self.idf = np.zeros(0)
        self.ids: pa.Array | None = None
        self.code = self.times = np.zeros(0, np.int64)

    def learn(self, terms: pa.Array, idf: pa.Array) -> None:
        self.parts.append(terms)
        self.idfs.append(idf.to_numpy())

    def say(self, ids: pa.Array, texts: pa.Array) -> Iterator[pa.RecordBatch]:
        """Scores of the documents that end in these rows, which are sorted by id."""
        if self.terms is None:
            self.terms, self.idf = pa.concat_arrays(self.parts or [pa.array([], texts.type)]), np.concatenate([self.idf, *self.idfs])
            self.parts, self.idfs = [], []
        for row, code, times, terms in counted(texts):
            if len(row):
                known = pc.index_in(terms.cast(self.terms.type), value_set=self.terms)
                if known.null_count:
                    raise ValueError("a text has terms that it didn't have when the vocabulary was made")
                having, row = np.unique(row, return_inverse=True)
                yield from self._add(ids.take(pa.array(having)), row, known.to_numpy().astype(np.int64)[code], times)

    def end(self) -> Iterator[pa.RecordBatch]:
        if self.ids is not None:
            yield from self._scored(self.ids, np.zeros(len(self.code), np.int64), self.code, self.times)

    def _add(self, ids: pa.Array, row: np.ndarray, code: np.ndarray, times: np.ndarray) -> Iterator[pa.RecordBatch]:
        if self.ids is not None:
            ids, row = pa.concat_arrays([self.ids, ids]), np.concatenate([np.zeros(len(self.code), np.int64), row + 1])
            code, times = np.concatenate([self.code, code]), np.concatenate([self.times, times])
        same = ids.dictionary_encode(null_encoding="encode").indices.to_numpy()
        doc = np.append(0, np.cumsum(same[1:] != same[:-1]))
        last, row = int(doc[-1]), doc[row]
        if last + 1 < len(ids):  # rows of one id are one document
            key, at = np.unique(row * len(self.terms) + code, return_inverse=True)
            row, code, times = key // len(self.terms), key % len(self.terms), np.bincount(at, times, len(key)).astype(np.int64)
        ended = int(np.searchsorted(row, last))
        self.ids, self.code, self.times = ids[-1:], code[ended:], times[ended:]
        yield from self._scored(ids.take(pa.array(np.flatnonzero(np.diff(doc, prepend=-1)))), row[:ended], code[:ended], times[:ended])

    def _scored(self, ids: pa.Array, doc: np.ndarray, code: np.ndarray, times: np.ndarray) -> Iterator[pa.RecordBatch]:
        w = times * self.idf[code]
        norm = np.sqrt(np.bincount(doc, w * w, len(ids)))[doc]
        score = np.divide(w, norm, out=np.zeros(len(w)), where=norm > 0)
        for k in range(0, len(doc), ROWS):
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(doc[k : k + ROWS])), self.terms.take(pa.array(code[k : k + ROWS])), pa.array(score[k : k + ROWS])], ["id", "term", "score"])


def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows tw_split, tw_idf, id, text, those of a split together, its terms (with their idf) first, then its documents (without) sorted by id: id, term, score."""
    split, at = _Split(), None
    for batch in batches:
        which, known = batch.column(0).to_numpy(), batch.column(1).is_valid().to_numpy(zero_copy_only=False)
        edges = np.flatnonzero((which[1:] != which[:-1]) | (known[1:] != known[:-1])) + 1
        for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(which)]):
            if hi > lo:
                if at != which[lo]:
                    yield from split.end()
                    split, at = _Split(), which[lo]
                piece = batch.slice(lo, hi - lo)
                if known[lo]:
                    split.learn(piece.column(3), piece.column(1))
                else:
                    yield from split.say(piece.column(2), piece.column(3))
    yield from split.end()
