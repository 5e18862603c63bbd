"""Lists of recordings to fetch: URL lists, playlists, subtitles that are on offer, stages and what slow transfers look like."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RETRIES, PATIENCE, LATE, SLOWEST = 6, 3.0, 15.0, 0.1 * 1024 * 1024
INFO = "webpage_url string, entries array<struct<webpage_url:string,subtitles:map<string,array<struct<ext:string>>>>>, subtitles map<string,array<struct<ext:string>>>"


def read_urls(spark: SparkSession, *paths: str) -> DataFrame:
    """url: one per line; blank lines are skipped."""
    return lines(spark.read.text(list(paths)).withColumnRenamed("value", "url"))


def lines(df: DataFrame, url: str = "url") -> DataFrame:
    return df.select(F.trim(url).alias("url")).filter("url <> ''")


def write_urls(df: DataFrame, path: str) -> None:
    df.select("url").write.mode("overwrite").text(path)


def expand(infos: DataFrame) -> DataFrame:
    """webpage_url and subtitles of each entry of a playlist, or of what is no playlist itself. A null row (a failed look-up) has none."""
    own = F.struct(F.col("webpage_url"), F.col("subtitles"))
    some = F.when(F.coalesce(F.size("entries"), F.lit(0)) > 0, F.col("entries")).otherwise(F.array(own))
    return infos.filter("webpage_url IS NOT NULL OR size(entries) > 0").select(F.inline(some))


def offers_subtitles(subtitles: Column, lang: str, ext: str = "vtt") -> Column:
    """Whether there are such subtitles; every recording will do for lang 'none'."""
    if lang == "none":
        return F.lit(True)
    return F.coalesce(F.exists(F.element_at(subtitles, lang), lambda s: s["ext"] == ext), F.lit(False))


def valid_urls(infos: DataFrame, lang: str) -> DataFrame:
    """url: distinct ones of recordings that have subtitles in the language."""
    return expand(infos).filter(offers_subtitles(F.col("subtitles"), lang)).select(F.col("webpage_url").alias("url")).filter("url IS NOT NULL").distinct()


def stages(urls: DataFrame, subtitles: DataFrame | None, recordings: DataFrame) -> DataFrame:
    """url, stage: 'subtitles' for those tried, 'recording' for those whose subtitles came, 'done' for those that came whole.

    subtitles, recordings: the urls that each stage fetched (empty ones don't count); subtitles None: that stage isn't wanted.
    """
    wanted = urls.select("url").filter("url <> ''").distinct()
    ready = wanted if subtitles is None else wanted.join(subtitles.select("url").filter("url <> ''").distinct(), "url", "left_semi")
    done = ready.join(recordings.select("url").filter("url <> ''").distinct(), "url", "left_semi")
    out = [(wanted, "subtitles")] * (subtitles is not None) + [(ready, "recording"), (done, "done")]
    tables = [df.withColumn("stage", F.lit(name)) for df, name in out]
    first, *rest = tables
    for t in rest:
        first = first.unionByName(t)
    return first


def slow_transfers(log: DataFrame, by: str = "rec", slowest: float = SLOWEST, patience: float = PATIENCE, late: float = LATE) -> DataFrame:
    """log (by, idx, elapsed, eta, speed) with slow: nothing faster than `slowest` for more than `patience` seconds, and more than
    `late` to go. A null speed is 0."""
    w = W.partitionBy(by).orderBy("idx").rowsBetween(W.unboundedPreceding, W.currentRow)
    good = F.max(F.when(F.coalesce("speed", F.lit(0.0)) > slowest, F.col("elapsed"))).over(w)
    slow = (F.col("elapsed") - F.coalesce(good, F.lit(0.0)) > patience) & (F.col("eta") > late)
    return log.withColumn("slow", F.coalesce(slow, F.lit(False)))


def given_up(attempts: DataFrame, by: str = "url", retries: int = RETRIES) -> DataFrame:
    """url of those that failed more than `retries` times, slow transfers included, and never came."""
    return attempts.groupBy(by).agg(F.count(F.when(~F.col("ok"), 1)).alias("failed"), F.max("ok").alias("ok")).filter((F.col("failed") > retries) & ~F.col("ok")).select(by)


def output_path(folder: str, title: Column, id_: Column, kind: str, ext: Column) -> Column:
    """folder/title-id/kind.ext"""
    return F.concat(F.lit(folder.rstrip("/") + "/"), title, F.lit("-"), id_, F.lit(f"/{kind}."), ext)


def worst_format(audio_only: Column) -> Column:
    return F.when(audio_only, "worstaudio").otherwise("worst")


def unique_names(names: DataFrame, taken: DataFrame | None = None, name: str = "name", order: str = "id") -> DataFrame:
    """names with unique_name: 'a', 'a (1)', 'a (2)' for equal names in that order, skipping those in `taken` (name)."""
    rank = F.row_number().over(W.partitionBy(name).orderBy(order)) - 1
    ranked = names.withColumn("tw_k", rank)
    made = lambda k: F.when(k == 0, F.col(name)).otherwise(F.concat(F.col(name), F.lit(" ("), k.cast("string"), F.lit(")")))
    if taken is None:
        return ranked.withColumn("unique_name", made(F.col("tw_k"))).drop("tw_k")
    used = taken.select(F.col("name").alias("tw_t")).distinct()
    base = used.select(F.regexp_replace("tw_t", r" \(\d+\)$", "").alias("tw_b"), "tw_t").unionByName(used.select(F.col("tw_t").alias("tw_b"), "tw_t")).distinct()
    number = F.when(F.col("tw_t") == F.col("tw_b"), 0).otherwise(F.regexp_extract("tw_t", r" \((\d+)\)$", 1).cast("int"))
    per = base.withColumn("tw_n", number).groupBy("tw_b").agg(F.array_sort(F.collect_set("tw_n")).alias("tw_used"))
    joined = ranked.join(per, F.col(name) == F.col("tw_b"), "left").withColumn("tw_used", F.coalesce("tw_used", F.array().cast("array<int>")))
    # the (k+1)-th free number lies within the first k + 1 + |used|
    free = F.array_except(F.sequence(F.lit(0), F.col("tw_k") + F.size("tw_used")), F.col("tw_used"))
    return joined.withColumn("unique_name", made(F.get(free, F.col("tw_k")))).drop("tw_k", "tw_b", "tw_used")


def inspect(urls: DataFrame, fetch: Callable[[str], str | None], n_tasks: int | None = None) -> DataFrame:
    """INFO of each url by a function that returns it as JSON; what fails is a null row. Tasks do it side by side."""
    @F.pandas_udf("string")
    def look(batch: pd.Series) -> pd.Series:
        def one(url):
            try:
                return fetch(url)
            except Exception:  # noqa: BLE001 - whatever a look-up raises, the others go on
                return None

        return batch.map(one)

    spread = urls.repartition(n_tasks) if n_tasks else urls
    return spread.select(F.from_json(look("url"), INFO).alias("i")).select("i.*")
