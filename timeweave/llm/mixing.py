"""Mixing sources to target weights."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timeweave.llm.common import N_WORDS_SQL, fresh, with_words, written

#: A table of rates is broadcast up to so many sources; beyond, documents and rates are joined by a shuffle.
BROADCAST_SOURCES = 100_000
SEED = "mix-1"


def source_rates(docs: DataFrame, weights: Mapping[str, float] | None = None, tokens: Column | None = None) -> DataFrame:
    """One row per source: source, n_docs, n_tokens and rate, the number of times that its documents are to be repeated.

    A source's share of the tokens after mixing is its weight over the sum of the weights of the sources that have tokens;
    the expected number of tokens stays that of the input. Without `weights` all sources weigh the same; sources that
    `weights` lacks weigh 0. A null source is a source of its own (weight key None). The rate of a source without any token
    is 1, as its documents don't bear on the mix. If no source that has tokens has a weight, every rate is 0.
    Weights must not be negative.
    """
    if weights is not None and any(w < 0 for w in weights.values()):
        raise ValueError("weights must not be negative")
    counted = with_words(docs, "source", "string") if tokens is None else docs.select(F.col("source").cast("string").alias("source"), tokens.alias("n"))
    per = counted.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_tokens"))
    if weights is None:
        weight = F.lit(1.0)
    else:
        weight = F.lit(0.0)
        for name, w in weights.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(name)), float(w)).otherwise(weight)
    per = written(per.withColumn("weight", F.when(F.col("n_tokens") > 0, weight).otherwise(0.0)), "mix-sources")
    total = per.agg(F.sum("n_tokens").alias("all_tokens"), F.sum("weight").alias("all_weight"))  # one row
    rate = F.when(F.col("n_tokens") == 0, 1.0).when(F.col("all_weight") == 0, 0.0).otherwise(F.col("all_tokens") * F.col("weight") / F.expr("nullif(all_weight * n_tokens, 0)"))
    return per.crossJoin(F.broadcast(total)).select("source", "n_docs", "n_tokens", rate.alias("rate"))


def draw(doc_id: str, seed: str) -> Column:
    """A number in [0, 1) that depends on the document's id and the seed alone; the same in every engine that has MD5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))), 1, 8), 16, 10).cast("double") / float(1 << 32)


def mix(docs: DataFrame, weights: Mapping[str, float] | None = None, seed: str = SEED, copy: str | None = None) -> DataFrame:
    """Each document floor(rate) times, and once more if its hash-seeded draw is below the rate's fraction.

    docs: needs doc_id, source and text; other columns go along, whatever their names. copy: a column to number a
    document's copies from 0. Equal rows get equal draws, since those depend on doc_id alone; rows with a null doc_id
    share one. Null and empty texts count 0 tokens (see source_rates). An empty table gives an empty one.
    """
    rates = source_rates(docs, weights)
    src, rate, k = fresh(docs, "mix_source"), fresh(docs, "mix_rate"), fresh(docs, copy or "mix_copy")
    if copy and k != copy:
        raise ValueError(f"docs already has a column {copy}")
    rates = written(rates.select(F.col("source").alias(src), F.col("rate").alias(rate)), "mix-rates")
    if rates.count() <= BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    times = F.floor(F.col(rate)) + (draw("doc_id", seed) < F.col(rate) - F.floor(F.col(rate))).cast("long")
    joined = docs.join(rates, docs["source"].cast("string").eqNullSafe(F.col(src)), "left")
    out = joined.withColumn(k, F.explode(F.when(times > 0, F.sequence(F.lit(0).cast("long"), times - 1)).otherwise(F.array().cast("array<bigint>"))))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns), *([F.col(k)] if copy else []))


def query(spark, sf_dir: str) -> DataFrame:
    """Equal shares for all sources, over the documents' whole texts."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"), copy="copy").select("doc_id", "source", "lang", "n_chars", "text", "copy")


SQL = f"""
WITH d AS (SELECT *, {N_WORDS_SQL} AS n FROM documents),
per AS (SELECT source, sum(n)::BIGINT AS n_tokens FROM d GROUP BY source),
t AS (SELECT sum(n_tokens)::BIGINT AS all_tokens, sum(CASE WHEN n_tokens > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS all_weight FROM per),
r AS (SELECT source, CASE WHEN n_tokens = 0 THEN 1.0::DOUBLE ELSE (all_tokens * 1.0::DOUBLE) / (all_weight * n_tokens) END AS rate FROM per, t),
x AS (SELECT d.*, floor(rate)::BIGINT + CASE WHEN ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END AS times
      FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, source, lang, n_chars, text, unnest(range(0, times))::BIGINT AS copy FROM x WHERE times > 0
"""
