"""Timed tokens of transcripts: cleaning, offsets, sentences, words from characters, and the changes that labels ask for."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from timeweave.functions.partitions import spread
from timeweave.operators.intervals import row_columns, run_number, with_runs

#: Seconds without speech after which a sentence ends.
SILENCE = 3.0
BREAKS = r"[ \t\n\r\f\x0B\x{00A0}\x{2028}\x{2029}\x{0085}]"


def clean(text: Column) -> Column:
    """text without [..] and (..), trimmed, with each run of white space as one space."""
    bare = F.regexp_replace(text, r"(\[[^\]]*\])|(\([^)]*\))", "")
    return F.trim(F.regexp_replace(bare, f"{BREAKS}+", " "))


def cues(df: DataFrame, text: str = "text") -> DataFrame:
    """Rows with their text cleaned; those without any text left are dropped, as are nulls."""
    return df.withColumn(text, clean(F.col(text))).filter(F.length(text) > 0)


def offsets(tokens: DataFrame, by: str = "rec") -> DataFrame:
    """tokens with start_pos: where each begins in the text that they make with one separator between them."""
    before = W.partitionBy(by).orderBy("idx").rowsBetween(W.unboundedPreceding, -1)
    return tokens.withColumn("start_pos", F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)).cast("long"))


def sentence_ends(tokens: DataFrame, by: str = "rec") -> DataFrame:
    """by, end_char: where a sentence ends in the text of the tokens (with start_pos): after . ? or ! before white space."""
    pieces = F.regexp_extract_all(F.concat("text", F.lit(" ")), F.lit(r"(?s)(.*?[.?!]+[ \t\n\r\f\x0B])"), F.lit(1))
    each = tokens.select(by, "start_pos", F.posexplode(pieces).alias("tw_k", "piece"))
    past = F.sum(F.length("piece")).over(W.partitionBy(by, "start_pos").orderBy("tw_k"))
    return each.select(by, (F.col("start_pos") + past - 1).alias("end_char"))


def assign_sentences(tokens: DataFrame, ends: DataFrame, by: str = "rec") -> DataFrame:
    """tokens with sent_id: of the sentence, counted from 0 without empty ones, that each token's start lies in.

    ends: by, end_char. Both are sorted together; a token after n ends is in the n-th sentence. A long token may leave
    sentences empty: those have no number.
    """
    columns = tokens.columns
    rows = tokens.select(F.col(by).alias("tw_by"), F.col("start_pos").alias("tw_at"), F.lit(1).alias("tw_kind"), F.struct(*columns).alias("tw_row"))
    marks = ends.select(F.col(by).alias("tw_by"), F.col("end_char").cast("long").alias("tw_at"), F.lit(0).alias("tw_kind"))
    both = rows.unionByName(marks, allowMissingColumns=True)
    w = W.partitionBy("tw_by").orderBy("tw_at", "tw_kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    counted = both.withColumn("tw_n", F.sum(1 - F.col("tw_kind")).over(w)).filter("tw_kind = 1")
    dense = F.dense_rank().over(W.partitionBy("tw_by").orderBy("tw_n")) - 1
    return counted.withColumn("sent_id", dense).select(*row_columns(columns, by), "sent_id")


def split_by_silence(tokens: DataFrame, silence: float = SILENCE, by: str = "rec", within: str | None = None) -> DataFrame:
    """tokens with sent_id, that also changes where more than `silence` lies between a token's start and the end of the one before.

    within: a column of sentence numbers that are to be split further."""
    w = W.partitionBy(by).orderBy("idx")
    new = F.col("start_time") - F.lag("end_time").over(w) > silence
    if within:
        new = new | (F.col(within) != F.lag(within).over(w))
    marked = tokens.withColumn("tw_new", F.coalesce(new, F.lit(False)))
    return marked.withColumn("sent_id", run_number(by, "idx", F.col("tw_new"))).drop("tw_new")


def sentences(tokens: DataFrame, silence: float = SILENCE, by: str = "rec") -> DataFrame:
    """tokens with start_pos and sent_id, by punctuation and by silence.

    A token opens a sentence if the one before it has an end of a sentence in it: what assign_sentences finds from sentence_ends,
    as every end in a token lies before the next token's start. So all is told in one order, and one sort does."""
    w = W.partitionBy(by).orderBy("idx")
    ended = F.concat("text", F.lit(" ")).rlike(r"[.?!][ \t\n\r\f\x0B]")
    new = F.coalesce(F.lag(ended).over(w), F.lit(False)) | F.coalesce(F.col("start_time") - F.lag("end_time").over(w) > silence, F.lit(False))
    marked = offsets(tokens, by).withColumn("tw_new", new)
    return marked.withColumn("sent_id", run_number(by, "idx", F.col("tw_new"))).drop("tw_new")


def separate_sentences(tokens: DataFrame, by: str = "rec") -> DataFrame:
    """tokens (with sent_id) whose text has the separator after it: a space, and a full stop before it where a sentence ends without
    a mark. A comma there becomes the full stop. The last sentence stays, and the last token has no separator."""
    w = W.partitionBy(by).orderBy("idx")
    following = F.lead("sent_id").over(w)
    spaced = F.when(following.isNull(), F.col("text")).otherwise(F.concat("text", F.lit(" ")))
    ends = following.isNotNull() & (following != F.col("sent_id"))
    marked = F.col("tw_s").rlike(r"[.?!] $")
    fixed = F.when(F.col("tw_ends") & ~marked, F.concat(F.regexp_replace("tw_s", r",? $", ""), F.lit(". "))).otherwise(F.col("tw_s"))
    return tokens.withColumn("tw_s", spaced).withColumn("tw_ends", ends).withColumn("text", fixed).drop("tw_s", "tw_ends")


def joined_text(tokens: DataFrame, by: str = "rec", separator: str = "") -> DataFrame:
    """by, text: the tokens' texts in order of idx."""
    rows = F.array_sort(F.collect_list(F.struct("idx", "text")))
    return tokens.groupBy(by).agg(F.array_join(F.transform(rows, lambda r: r["text"]), separator).alias("text"))


def words_of_characters(characters: DataFrame, by: str = "rec") -> DataFrame:
    """by, word_id, text, start_time, end_time from characters (by, idx, ch, start_time).

    A space ends an open word, at its own time; one that finds no open word is the first character of the next. So spaces
    in a row take turns, and which is which follows from their place in the run. The last word ends as much after the last
    character as that came after the one before (at it, if it is alone).
    """
    w = W.partitionBy(by).orderBy("idx")
    df = with_runs(characters.withColumn("tw_space", F.col("ch") == " "), by, "idx", "tw_space", "tw_run")
    place = F.row_number().over(W.partitionBy(by, "tw_run").orderBy("idx"))
    df = df.withColumn("tw_place", place + F.when(F.col("tw_run") == 1, 1).otherwise(0))  # a run at the start finds no open word
    df = df.withColumn("tw_sep", F.col("tw_space") & (F.col("tw_place") % 2 == 1))
    before = w.rowsBetween(W.unboundedPreceding, -1)
    df = df.withColumn("word_id", F.coalesce(F.sum(F.col("tw_sep").cast("int")).over(before), F.lit(0)).cast("int"))
    last = F.col("start_time") + F.coalesce(F.col("start_time") - F.lag("start_time").over(w), F.lit(0.0))
    df = df.withColumn("tw_end", F.when(F.col("tw_sep") | F.lead("idx").over(w).isNull(), F.when(F.col("tw_sep"), F.col("start_time")).otherwise(last)))
    rows = F.array_sort(F.collect_list(F.when(~F.col("tw_sep"), F.struct("idx", "ch"))))
    made = df.groupBy(by, "word_id").agg(F.array_join(F.transform(rows, lambda r: r["ch"]), "").alias("text"), F.min(F.when(~F.col("tw_sep"), F.col("start_time"))).alias("start_time"), F.max("tw_end").alias("end_time"))
    return made.filter("start_time IS NOT NULL")


def _split(texts: pa.Array) -> tuple[np.ndarray, ...]:
    """Words of texts as bytes: row, number in it, text, first character, the separator's (or the last) character, whether one ended it."""
    texts = texts.cast(pa.string())
    if not len(texts) or texts.buffers()[2] is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    at, filled = np.arange(len(data)), np.flatnonzero(np.diff(ends))
    opens = np.zeros(len(data) + 1, bool)
    opens[ends[:-1][filled]] = True
    space = data == 32
    run = np.maximum.accumulate(np.where(space & (opens[:-1] | ~np.concatenate([[False], space[:-1]])), at, 0))
    ends_word = space & ((at - run + opens[run]) % 2 == 0)  # a run at the start of a text finds no open word
    char = np.cumsum((data & 0xC0) != 0x80) - 1
    begin = np.flatnonzero(opens[:-1] | np.concatenate([[False], ends_word[:-1]]))
    row = np.searchsorted(ends[:-1][filled], begin, "right") - 1
    stop = np.minimum(np.append(np.flatnonzero(ends_word), len(data))[np.searchsorted(np.flatnonzero(ends_word), begin)], ends[1:][filled][row])
    closed = stop < ends[1:][filled][row]
    start = char[ends[:-1][filled]][row]
    offsets = np.append(0, np.cumsum(stop - begin)).astype(np.int32)
    words = pa.StringArray.from_buffers(len(begin), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data[~ends_word].tobytes()))
    number = np.arange(len(row)) - np.searchsorted(row, row, "left")
    return filled[row], number, words, char[begin] - start, char[np.where(closed, stop, stop - 1)] - start, closed


def words_of_texts(texts: DataFrame, at: Callable[[Column], Column], by: str = "rec", text: str = "text") -> DataFrame:
    """What words_of_characters makes of recordings whose characters lie in one text each; at: a character's time, by its idx.

    Each text is split where it lies: there is no row for a character, no exchange and no sort."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                row, number, words, first, end, closed = _split(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(number.astype(np.int32)), words, pa.array(first), pa.array(end), pa.array(closed)], [by, "word_id", "text", "tw_first", "tw_end", "tw_closed"])

    kind = texts.schema[by].dataType.simpleString()
    split = spread(texts.select(by, F.col(text).alias("text"))).mapInArrow(run, f"`{by}` {kind}, word_id int, text string, tw_first long, tw_end long, tw_closed boolean")
    end = F.col("tw_end")
    last = at(end) + F.when(end > 0, at(end) - at(end - 1)).otherwise(0.0)
    return split.select(by, "word_id", "text", at(F.col("tw_first")).alias("start_time"), F.when(F.col("tw_closed"), at(end)).otherwise(last).alias("end_time"))


def changes_of_tokens(tokens: DataFrame, multi: float = 0.0, by: str = "rec") -> DataFrame:
    """by, beg, fin, multi: what lies around tokens whose label is 0 or false.

    A run of such tokens is cut from the end of the token before it (or 0) to the start of the one after it (or infinity). If
    anything is cut, so are the head up to the first token and the tail after the last. Empty intervals aren't returned.
    """
    w, whole = W.partitionBy(by).orderBy("idx"), W.partitionBy(by)
    df = tokens.withColumn("tw_cut", ~F.coalesce(F.col("label").cast("boolean"), F.lit(False)))
    df = df.withColumn("tw_prev", F.lag("end_time").over(w)).withColumn("tw_next", F.lead("start_time").over(w)).withColumn("tw_any", F.max("tw_cut").over(whole))
    df = with_runs(df.withColumn("tw_first", F.lag("idx").over(w).isNull()).withColumn("tw_last", F.lead("idx").over(w).isNull()), by, "idx", "tw_cut", "tw_run")
    runs = df.filter("tw_any").groupBy(by, "tw_run").agg(F.first("tw_cut").alias("cut"), F.min_by("tw_prev", "idx").alias("beg"), F.max_by("tw_next", "idx").alias("fin"), F.max("tw_first").alias("first"), F.max("tw_last").alias("last"), F.min("start_time").alias("s"), F.max_by("end_time", "idx").alias("e"))
    infinity = F.lit(float("inf"))
    cut = F.array(F.struct(F.coalesce("beg", F.lit(0.0)).alias("beg"), F.coalesce("fin", infinity).alias("fin")))
    head = F.when(F.col("first"), F.array(F.struct(F.lit(0.0).alias("beg"), F.col("s").alias("fin")))).otherwise(F.array().cast("array<struct<beg:double,fin:double>>"))
    tail = F.when(F.col("last"), F.array(F.struct(F.col("e").alias("beg"), infinity.alias("fin")))).otherwise(F.array().cast("array<struct<beg:double,fin:double>>"))
    return runs.select(by, F.inline(F.when(F.col("cut"), cut).otherwise(F.concat(head, tail)))).filter("beg < fin").withColumn("multi", F.lit(float(multi)))
