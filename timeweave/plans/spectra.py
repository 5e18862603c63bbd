"""Queries over embeddings as spectra: a label is a recording, its vectors in order are frames, their values magnitudes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from timeweave.functions.numbers import smoothing
from timeweave.operators import signal as sg


AMPLITUDE, POINTS, SHORTEST, TAIL, REDUNDANCY = 7.0, 56, 3, 2, 0.065


def frames(spark: SparkSession, d: str) -> DataFrame:
    """rec, vec_id, idx, mag: values lifted by 0.6."""
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    idx = F.row_number().over(W.partitionBy("label").orderBy("vec_id")) - 1
    return e.select(F.col("label").alias("rec"), "vec_id", idx.alias("idx"), F.transform("embedding", lambda v: v.cast("double") + 0.6).alias("mag"))


M = "m AS (SELECT label AS rec, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS idx, embedding FROM embeddings), b AS (SELECT rec, vec_id, idx, unnest(range(0, len(embedding))) AS bin, unnest(embedding)::DOUBLE + 0.6::DOUBLE AS v FROM m)"
WEIGHTS = smoothing(5)


def softmax_sql(source: str) -> str:
    return f"p AS (SELECT rec, vec_id, idx, bin, exp(v - m) / sum(exp(v - m)) OVER (PARTITION BY vec_id) AS p FROM (SELECT *, max(v) OVER (PARTITION BY vec_id) AS m FROM {source}))"


KL = "k AS (SELECT a.rec, a.vec_id, a.idx, coalesce(sum(CASE WHEN q.p > 0 THEN q.p * ln(q.p / a.p) ELSE 0 END), 0) AS kl FROM p a LEFT JOIN p q ON q.rec = a.rec AND q.idx = a.idx - 1 AND q.bin = a.bin GROUP BY a.rec, a.vec_id, a.idx)"


def taps(column: str, order: str, normal: bool) -> str:
    total = sum(WEIGHTS) if normal else 1.0
    return " + ".join(f"{w / total!r}::DOUBLE * " + (f"{column}" if k == 2 else f"coalesce({'lag' if k < 2 else 'lead'}({column}, {abs(k - 2)}) OVER ({order}), 0)") for k, w in enumerate(WEIGHTS))


SMOOTH = f"s1 AS (SELECT rec, vec_id, idx, bin, {taps('v', 'PARTITION BY rec, bin ORDER BY idx', True)} AS v FROM b), s2 AS (SELECT rec, vec_id, idx, bin, {taps('v', 'PARTITION BY rec, idx ORDER BY bin', True)} AS v FROM s1), s3 AS (SELECT rec, vec_id, idx, bin, v * {sg.PEAK} / max(v) OVER (PARTITION BY rec) AS v FROM s2)"


def morph(source: str, flag: str, out: str) -> str:
    """CTEs that close and open a flag of (rec, vec_id, idx, ...)."""
    return f"""{out}0 AS (SELECT *, sum(CASE WHEN pf IS DISTINCT FROM {flag} THEN 1 ELSE 0 END) OVER (PARTITION BY rec ORDER BY idx) AS run FROM (SELECT *, lag({flag}) OVER (PARTITION BY rec ORDER BY idx) AS pf FROM {source})),
{out}1 AS (SELECT * EXCLUDE ({flag}, run, pf), {flag} OR count(*) OVER (PARTITION BY rec, run) < {SHORTEST} AS {flag} FROM {out}0),
{out}2 AS (SELECT *, sum(CASE WHEN pf IS DISTINCT FROM {flag} THEN 1 ELSE 0 END) OVER (PARTITION BY rec ORDER BY idx) AS run FROM (SELECT *, lag({flag}) OVER (PARTITION BY rec ORDER BY idx) AS pf FROM {out}1)),
{out} AS (SELECT * EXCLUDE ({flag}, run, pf), {flag} AND count(*) OVER (PARTITION BY rec, run) >= {SHORTEST} AS {flag} FROM {out}2)"""


SOUND = f"{M}, {SMOOTH}, so AS (SELECT rec, vec_id, idx, count(*) FILTER (v > {AMPLITUDE}) > {POINTS} AS sound FROM s3 GROUP BY rec, vec_id, idx), {morph('so', 'sound', 'sm')}"
KEPT = f"""{SOUND}, {softmax_sql('s3')}, {KL}, rr AS (SELECT rec, vec_id, idx, {taps('kl', 'PARTITION BY rec ORDER BY idx', False)} AS r FROM k),
kk AS (SELECT sm.rec, sm.vec_id, sm.idx, sm.sound, round(rr.r, 9) >= {REDUNDANCY} AND sm.sound AS keep FROM sm JOIN rr ON rr.vec_id = sm.vec_id), {morph('kk', 'keep', 'km')}"""


def isle(flag: str, name: str, source: str = "km") -> str:
    return f"{name} AS (SELECT rec, min(idx) AS beg, max(idx) + 1 AS fin FROM (SELECT rec, idx, idx - row_number() OVER (PARTITION BY rec ORDER BY idx) AS k FROM {source} WHERE NOT {flag}) GROUP BY rec, k)"


TAILED = f"""{KEPT}, {isle('keep', 'red')}, {isle('sound', 'sil')},
hit AS (SELECT red.rec, greatest(red.beg, sil.beg) AS cb, least(red.fin, sil.fin) AS ce, row_number() OVER (PARTITION BY red.rec, red.beg ORDER BY sil.beg) AS k FROM red JOIN sil ON sil.rec = red.rec AND sil.beg < red.fin AND sil.fin > red.beg),
kt AS (SELECT km.rec, km.vec_id, km.idx, km.sound, km.keep OR EXISTS (SELECT 1 FROM hit WHERE hit.rec = km.rec AND hit.k = 1 AND ce - cb > {TAIL} AND km.idx >= ce - {TAIL} AND km.idx < ce) AS keep FROM km)"""


def scaled(s, d):
    return sg.scaled(sg.smoothed_spectrum(frames(s, d)))


def kept(s, d, tail):
    return sg.kept_frames(scaled(s, d), amplitude=AMPLITUDE, points=POINTS, shortest=SHORTEST, tail=tail, redundancy=REDUNDANCY)


def softmax_frames(s, d):
    return sg.with_softmax(frames(s, d)).select("vec_id", F.posexplode("p").alias("bin", "p")).select("vec_id", F.col("bin").cast("long").alias("bin"), F.round("p", 9).alias("p"))


def adjacent_kl(s, d):
    return sg.adjacent_divergence(sg.with_softmax(frames(s, d))).select("vec_id", F.round("kl", 9).alias("kl"))


def smooth_redundancy(s, d):
    return sg.smoothed(sg.adjacent_divergence(sg.with_softmax(frames(s, d))), "kl", "r").select("vec_id", F.round("r", 9).alias("r"))


def spectrogram_smooth(s, d):
    return scaled(s, d).select("vec_id", F.posexplode("mag").alias("bin", "v")).select("vec_id", F.col("bin").cast("long").alias("bin"), F.round("v", 6).alias("v"))


def loudness(s, d):
    f = frames(s, d)
    top = F.max(F.array_max("mag")).over(W.partitionBy("rec"))
    return f.select("vec_id", F.round(top, 6).alias("top"), F.size(F.filter("mag", lambda v: v > 0.6)).cast("long").alias("n_bins"))


def sound_frames(s, d):
    return sg.sound(scaled(s, d), amplitude=AMPLITUDE, points=POINTS, shortest=SHORTEST).select("vec_id", "sound")


def redundant_frames(s, d):
    return kept(s, d, None).select("vec_id", "keep")


def silence_tail(s, d):
    return kept(s, d, TAIL).select("vec_id", "keep")


def redundant_changes(s, d):
    return sg.redundant_changes(kept(s, d, TAIL))


def blocks(s, d):
    """Each label's vectors joined to a signal, a vector a block."""
    return frames(s, d).select("rec", F.col("idx").alias("block"), F.transform("mag", lambda v: v - 0.6).alias("samples"))


def stft(s, d):
    return sg.stft(blocks(s, d)).select(F.col("rec").alias("label"), "idx", F.transform("mag", lambda v: F.round(v, 9)).alias("mag"))


def wsola(s, d):
    return sg.change_speed(blocks(s, d), 1.5).select(F.col("rec").alias("label"), F.transform("samples", lambda v: F.round(v, 9)).alias("samples"))


def crossfade(s, d):
    """Each label's signal with its first fifth cut out of the middle and the cut faded."""
    import numpy as np
    import pandas as pd

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [np.asarray(x, float) for x in pdf.sort_values("block")["samples"]]
        src = np.array([len(x) for x in parts])
        dst = src.copy()
        dst[2 * len(src) // 5 : 3 * len(src) // 5] = 0
        made = sg.edited_signal(np.concatenate(parts)[None], src, dst)[0]
        return pd.DataFrame({"label": [key[0]], "samples": [made]})

    return blocks(s, d).groupBy("rec").applyInPandas(run, "label int, samples array<double>")


QUERIES = {
    "softmax_frames": (softmax_frames, f"WITH {M}, {softmax_sql('b')} SELECT vec_id, bin, round(p, 9) AS p FROM p"),
    "adjacent_kl": (adjacent_kl, f"WITH {M}, {softmax_sql('b')}, {KL} SELECT vec_id, round(kl, 9) AS kl FROM k"),
    "smooth_redundancy": (smooth_redundancy, f"WITH {M}, {softmax_sql('b')}, {KL} SELECT vec_id, round({taps('kl', 'PARTITION BY rec ORDER BY idx', False)}, 9) AS r FROM k"),
    "spectrogram_smooth": (spectrogram_smooth, f"WITH {M}, {SMOOTH} SELECT vec_id, bin, round(v, 6) AS v FROM s3"),
    "loudness": (loudness, f"WITH {M} SELECT DISTINCT vec_id, round(max(v) OVER (PARTITION BY rec), 6) AS top, count(*) FILTER (v > 0.6) OVER (PARTITION BY vec_id) AS n_bins FROM b"),
    "sound_frames": (sound_frames, f"WITH {SOUND} SELECT vec_id, sound FROM sm"),
    "redundant_frames": (redundant_frames, f"WITH {KEPT} SELECT vec_id, keep FROM km"),
    "silence_tail": (silence_tail, f"WITH {TAILED} SELECT vec_id, keep FROM kt"),
    "redundant_changes": (redundant_changes, f"WITH {TAILED}, {isle('keep', 'cut', 'kt')} SELECT rec, beg * {sg.HOP} / {sg.RATE}::DOUBLE AS beg, fin * {sg.HOP} / {sg.RATE}::DOUBLE AS fin, 0.0::DOUBLE AS multi FROM cut"),
    "stft": (stft, None),
    "wsola": (wsola, None),
    "crossfade": (crossfade, None),
}
