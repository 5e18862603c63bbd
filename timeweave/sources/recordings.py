"""Recordings: raw PCM files as blocks of samples, stream metadata, scripts, and a corpus model that is kept."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timeweave.operators.salience import adjusted_script, document_frequencies

FORMATS = {"f32le": ("<f4", 1.0), "s16le": ("<i2", 1.0)}
BLOCK = 1 << 16
PCM = "path string, channel int, block int, samples array<float>"


def read_pcm(spark: SparkSession, *paths: str, form: str = "f32le", channels: int = 1, planar: bool = False, mono: bool = False, block: int = BLOCK) -> DataFrame:
    """path, channel, block, samples of raw files, `block` samples a row: never one row per sample.

    planar: the channels follow each other instead of taking turns. mono: their mean is one channel. Trailing bytes that make no
    sample of every channel are ignored; an empty file has no rows.
    """
    files = spark.read.format("binaryFile").load(list(paths)).select("path", "content")
    kind, _ = FORMATS[form]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                raw = np.frombuffer(content, kind, len(content) // np.dtype(kind).itemsize)
                raw = raw[: len(raw) // channels * channels]
                signal = (raw.reshape(channels, -1) if planar else raw.reshape(-1, channels).T).astype(np.float32)
                if mono:
                    signal = signal.mean(axis=0, keepdims=True)
                for lo in range(0, signal.shape[1], block):
                    part = signal[:, lo : lo + block]
                    yield pd.DataFrame({"path": path, "channel": np.arange(len(part), dtype=np.int32), "block": np.int32(lo // block), "samples": list(part)})

    return files.mapInPandas(run, PCM)


def stream_info(blocks: DataFrame, rate: int) -> DataFrame:
    """path, sample_rate, channels, n_samples, seconds."""
    per = blocks.groupBy("path", "channel").agg(F.sum(F.size("samples")).alias("n"))
    return per.groupBy("path").agg(F.lit(rate).alias("sample_rate"), F.count("*").cast("int").alias("channels"), F.max("n").alias("n_samples"), (F.max("n") / rate).alias("seconds"))


def channel(blocks: DataFrame, number: int | None = None) -> DataFrame:
    """One channel's blocks, the first unless another is named."""
    return blocks.filter(F.col("channel") == (number or 0))


def resample(signal: np.ndarray, rate: int, to: int) -> np.ndarray:
    """A channel at another rate, by linear interpolation."""
    n = int(len(signal) * to / rate)
    return np.interp(np.arange(n) * rate / to, np.arange(len(signal)), signal) if n else signal[:0]


def read_script(spark: SparkSession, *paths: str) -> DataFrame:
    """path and text of script files, adjusted for comparison."""
    return spark.read.text(list(paths), wholetext=True).select(F.col("_metadata.file_path").alias("path"), adjusted_script(F.col("value")).alias("text"))


def cache_dir(spark: SparkSession, *below: str) -> str:
    """A place for kept files: under spark.timeweave.home, or spark.checkpoint.dir where that is unset. It can't be left with '..'.

    Where neither is set, a local session gets a temporary folder; a cluster gets an error, since its machines share none."""
    context = spark.sparkContext
    conf = context.getConf()
    root = conf.get("spark.timeweave.home") or conf.get("spark.checkpoint.dir")
    if not root:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="timeweave-")
    for part in below:
        if part in ("", ".", "..") or "/" in part or "\\" in part:
            raise ValueError(f"{part!r} leads out of the cache")
    return "/".join([root.rstrip("/"), *below])


def corpus_model(spark: SparkSession, corpus: DataFrame, path: str, text: str = "text") -> tuple[DataFrame, int]:
    """term, df of a corpus and its number of documents, made once and kept at path: read from there if both files exist."""
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    exists = lambda p: fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p))
    if not (exists(f"{path}/terms/_SUCCESS") and exists(f"{path}/size/_SUCCESS")):
        document_frequencies(corpus, text).write.mode("overwrite").parquet(f"{path}/terms")
        corpus.agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{path}/size")
    return spark.read.parquet(f"{path}/terms"), spark.read.parquet(f"{path}/size").first()["n"]
