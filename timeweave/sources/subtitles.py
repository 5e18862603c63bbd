"""Subtitle files: WebVTT cues as timed tokens, and readers by file name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from timeweave.operators.tokens import cues

Reader = Callable[[DataFrame], DataFrame]
#: Readers by file suffix; of several for one suffix the first counts.
READERS: list[tuple[str, str, Reader]] = []
CLOCK = r"(?:(\d+):)?(\d\d):(\d\d)[.](\d\d\d)"


def reader(name: str, *suffixes: str) -> Callable[[Reader], Reader]:
    """Registers a reader: a function of (path, content) rows that returns path, idx, text, start_time, end_time."""

    def register(read: Reader) -> Reader:
        READERS.extend((suffix.lower(), name, read) for suffix in suffixes)
        return read

    return register


def milliseconds(clock: Column) -> Column:
    """Of a time like 01:02:03.456 or 02:03.456; null for anything else."""
    part = [F.regexp_extract(clock, f"^{CLOCK}$", k) for k in (1, 2, 3, 4)]
    total = (F.when(part[0] == "", 0).otherwise(part[0].cast("long")) * 3600 + part[1].cast("long") * 60 + part[2].cast("long")) * 1000 + part[3].cast("long")
    return F.when(clock.rlike(f"^{CLOCK}$"), total)


@reader("webvtt", ".vtt")
def webvtt(files: DataFrame) -> DataFrame:
    """path, idx, text, start_time, end_time (seconds) from path and content: one token per cue, cleaned; empty ones are dropped.

    Cue numbers, settings, notes and styles are skipped, as are cues that don't end after their start. Null content has none."""
    block = files.select("path", F.posexplode(F.split(F.regexp_replace("content", "\r\n?", "\n"), "\n{2,}")).alias("place", "block"))
    timing = r"(?:^|\n)([0-9:.]+)[ \t]+-->[ \t]+([0-9:.]+)[^\n]*\n"
    timed = block.filter(F.col("block").rlike(timing)).select(
        "path", "place", milliseconds(F.regexp_extract("block", timing, 1)).alias("a"), milliseconds(F.regexp_extract("block", timing, 2)).alias("b"),
        F.regexp_extract("block", r"(?s)-->[^\n]*\n(.*)$", 1).alias("text"),
    )
    kept = cues(timed.filter("a < b").withColumn("text", F.regexp_replace("text", r"</?[a-zA-Z0-9:.][^<>]*>", "")))
    idx = F.row_number().over(W.partitionBy("path").orderBy("place")) - 1
    return kept.select("path", idx.alias("idx"), "text", (F.col("a") / 1000).alias("start_time"), (F.col("b") / 1000).alias("end_time"))


@reader("plain", ".txt", ".text")
def plain(files: DataFrame) -> DataFrame:
    """One token per line that isn't empty, a second each."""
    line = files.select("path", F.posexplode(F.split("content", "\r?\n")).alias("place", "text"))
    kept = cues(line)
    idx = (F.row_number().over(W.partitionBy("path").orderBy("place")) - 1).alias("idx")
    kept = kept.select("path", idx, "text")
    return kept.withColumn("start_time", F.col("idx").cast("double")).withColumn("end_time", F.col("idx") + 1.0)


def suffix(path: Column) -> Column:
    """.vtt of a/b.VTT?x=1; empty if there is none."""
    name = F.regexp_extract(F.regexp_replace(path, r"[?#].*$", ""), r"([^/]*)$", 1)
    return F.lower(F.regexp_extract(name, r"([.][^.]*)$", 1))


def reader_names(spark: SparkSession) -> DataFrame:
    """suffix, reader, priority."""
    return spark.createDataFrame([(s, n, k) for k, (s, n, _) in enumerate(READERS)], "suffix string, reader string, priority int")


def dispatch(files: DataFrame, path: str = "path") -> DataFrame:
    """files with the reader of each: the first registered one for its suffix; null if there is none."""
    known = reader_names(files.sparkSession).groupBy("suffix").agg(F.min_by("reader", "priority").alias("reader"))
    return files.withColumn("tw_suffix", suffix(F.col(path))).join(F.broadcast(known), F.col("tw_suffix") == F.col("suffix"), "left").drop("tw_suffix", "suffix")


def read_subtitles(spark: SparkSession, *paths: str) -> DataFrame:
    """The tokens of all files that have a reader."""
    files = spark.read.text(list(paths), wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    return read_contents(files)


def read_contents(files: DataFrame) -> DataFrame:
    named = dispatch(files)
    out = None
    for name, read in {n: r for _, n, r in reversed(READERS)}.items():
        one = read(named.filter(F.col("reader") == name).select("path", "content"))
        out = one if out is None else out.unionByName(one)
    return out
