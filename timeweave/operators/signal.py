"""Signals: spectra of recordings frame by frame, how much a frame differs from the one before, sound, and time-scale changes."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from timeweave.functions.numbers import hamming, smoothing
from timeweave.operators.intervals import close_open, first_overlap_tail, islands, run_seconds

RATE, NFFT, HOP, POWER, PEAK = 16000, 256, 256, 0.2, 9.0
#: Samples on either side of a cut that are faded.
FADE = 64
#: A frame has sound if more than POINTS of its bins exceed AMPLITUDE; it is redundant below REDUNDANCY.
AMPLITUDE, POINTS, REDUNDANCY = 3.0, 15, 0.025
#: Frames of the shortest silence and the shortest sound: a tenth of a second.
SHORTEST = int(0.1 * RATE / HOP + 0.5)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once: used in a lambda as it is, Catalyst would put its expression into each turn."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def softmax(values: Column) -> Column:
    """exp(v - max) over its sum, of an array."""

    def shares(e: Column) -> Column:
        return let(F.aggregate(e, F.lit(0.0), lambda a, x: a + x), lambda total: F.transform(e, lambda v: v / total))

    return let(F.array_max(values), lambda top: let(F.transform(values, lambda v: F.exp(v - top)), shares))


def with_softmax(frames: DataFrame, mag: str = "mag") -> DataFrame:
    return frames.withColumn("p", softmax(F.col(mag)))


def adjacent_divergence(frames: DataFrame, by: str = "rec", p: str = "p") -> DataFrame:
    """frames with kl: the Kullback-Leibler divergence (natural logarithm) of the frame before from each; 0 for the first."""
    before = frames.withColumn("tw_q", F.lag(p).over(W.partitionBy(by).orderBy("idx")))
    parts = F.zip_with("tw_q", p, lambda q, r: F.when(q > 0, q * F.log(q / r)).otherwise(F.lit(0.0)))
    return before.withColumn("kl", F.coalesce(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x), F.lit(0.0))).drop("tw_q")


def smoothed(frames: DataFrame, column: str, out: str, by: str = "rec", taps: int = 5) -> DataFrame:
    """frames with `out`: the weighted sum of `taps` neighbours in time (raised cosine, not normalised); zero beyond the ends."""
    w, half = W.partitionBy(by).orderBy("idx"), taps // 2
    total = F.lit(0.0)
    for k, weight in enumerate(smoothing(taps)):
        at = k - half
        value = F.col(column) if at == 0 else (F.lag(column, -at) if at < 0 else F.lead(column, at)).over(w)
        total = total + F.lit(weight) * F.coalesce(value, F.lit(0.0))
    return frames.withColumn(out, total)


def _times(weight: float):
    return lambda v: v * weight


def smoothed_spectrum(frames: DataFrame, by: str = "rec", mag: str = "mag", taps: int = 5) -> DataFrame:
    """frames with mag smoothed in time and frequency by a normalised raised cosine each way; zero beyond the edges."""
    weights = smoothing(taps)
    weights = [x / sum(weights) for x in weights]
    w, half = W.partitionBy(by).orderBy("idx"), taps // 2
    total = None
    for k, weight in enumerate(weights):
        at = k - half
        value = F.col(mag) if at == 0 else (F.lag(mag, -at) if at < 0 else F.lead(mag, at)).over(w)
        value = F.coalesce(F.transform(value, _times(weight)), F.array_repeat(F.lit(0.0), F.size(mag)))
        total = value if total is None else F.zip_with(total, value, lambda a, b: a + b)

    def along(t: Column) -> Column:
        def at(i: Column) -> Column:
            out = F.lit(0.0)
            for k, weight in enumerate(weights):
                out = out + F.lit(weight) * F.coalesce(F.get(t, (i + (k - half)).cast("int")), F.lit(0.0))
            return out

        return F.when(F.size(t) > 0, F.transform(F.sequence(F.lit(0), F.size(t) - 1), at)).otherwise(t)

    return frames.withColumn(mag, let(total, along))


def scaled(frames: DataFrame, by: str = "rec", mag: str = "mag", peak: float = PEAK) -> DataFrame:
    """frames with mag scaled so that the recording's greatest value is `peak`; silence stays."""
    top = F.max(F.array_max(mag)).over(W.partitionBy(by))
    return frames.withColumn("tw_top", top).withColumn(mag, F.transform(mag, lambda v: F.when(F.col("tw_top") > 0, v * peak / F.col("tw_top")).otherwise(v))).drop("tw_top")


def has_sound(mag: Column, amplitude: float = AMPLITUDE, points: int = POINTS) -> Column:
    return F.size(F.filter(mag, lambda v: v > amplitude)) > points


def sound(frames: DataFrame, by: str = "rec", amplitude: float = AMPLITUDE, points: int = POINTS, shortest: int = SHORTEST) -> DataFrame:
    """frames with sound, short silences and short sounds turned over."""
    return close_open(frames.withColumn("sound", has_sound(F.col("mag"), amplitude, points)), shortest, by, "idx", "sound")


def kept_frames(frames: DataFrame, by: str = "rec", ratio: float = 1.0, amplitude: float = AMPLITUDE, points: int = POINTS, shortest: int = SHORTEST, tail: int | None = SHORTEST, redundancy: float = REDUNDANCY) -> DataFrame:
    """frames (by, idx, mag: scaled spectrum) with sound, r (how much each differs from its past) and keep.

    tail: frames of silence kept at the end of each redundant stretch's first silence; None: no such step. All windows share
    one exchange by recording."""
    df = smoothed(adjacent_divergence(with_softmax(sound(frames, by, amplitude, points, shortest)), by), "kl", "r", by)
    df = df.withColumn("keep", (F.round("r", 9) >= redundancy * ratio) & F.col("sound"))
    df = close_open(df, shortest, by, "idx", "keep")
    return df if tail is None else first_overlap_tail(df, tail, by, "idx", "sound", "keep")


def redundant_changes(kept: DataFrame, by: str = "rec", multi: float = 0.0, hop: int = HOP, rate: int = RATE) -> DataFrame:
    """The stretches that aren't kept as changes in seconds."""
    return run_seconds(islands(kept.withColumn("tw_not", ~F.col("keep")), by, "idx", "tw_not"), hop, rate, multi, by)


def spectrum(signal: np.ndarray, nfft: int = NFFT, hop: int = HOP, centre: bool = True, window: str = "hann", pad: str = "constant") -> np.ndarray:
    """Magnitudes (frame, bin) of the short-time Fourier transform. centre: frames lie around multiples of hop, the ends padded."""
    if centre:
        signal = np.pad(signal, nfft // 2, mode=pad) if len(signal) else signal
    if len(signal) < nfft:
        return np.zeros((0, nfft // 2 + 1))
    taper = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(nfft) / nfft) if window == "hann" else np.ones(nfft)
    frames = np.lib.stride_tricks.sliding_window_view(signal, nfft)[::hop]
    return np.abs(np.fft.rfft(frames * taper, axis=1))


def stft(blocks: DataFrame, by: str = "rec", nfft: int = NFFT, hop: int = HOP, power: float = 1.0, centre: bool = True) -> DataFrame:
    """by, idx, mag from blocks of samples (by, block, samples): one row per frame. A recording's samples are joined in order."""
    kind = blocks.schema[by].dataType.simpleString()

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        signal = np.concatenate([np.asarray(s, float) for s in pdf.sort_values("block")["samples"]])
        mags = spectrum(signal, nfft, hop, centre) ** power
        return pd.DataFrame({by: [key[0]] * len(mags), "idx": np.arange(len(mags), dtype=np.int32), "mag": list(mags)})

    return blocks.select(by, "block", "samples").groupBy(by).applyInPandas(run, f"{by} {kind}, idx int, mag array<double>")


def soften(signal: np.ndarray, point: int, length: int = FADE) -> np.ndarray:
    """The signal (channel, sample) faded out and in around a point by the complement of a Hamming window."""
    size = max(min(length, point, signal.shape[1] - point), 0)
    out = signal.copy()
    if size:
        out[:, point - size : point + size] *= 1 - hamming(2 * size)
    return out


def wsola(signal: np.ndarray, src: np.ndarray, dst: np.ndarray, window: int = 1024, hop: int = 256, tolerance: int = 512) -> np.ndarray:
    """The signal (channel, sample) with time changed so that sample src[k] comes at dst[k], and its pitch kept.

    Waveform-similarity overlap-add (Verhelst and Roelands, 1993): output frames are taken near the place that the map asks for,
    within `tolerance`, where they continue the frame before best by cross-correlation.
    """
    out_len = int(dst[-1]) + 1
    centres = np.arange(0, out_len + window // 2, hop)
    ask = np.round(np.interp(centres, dst, src)).astype(int)
    half = window // 2
    taper = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(window) / window)
    pad = half + tolerance + window + hop
    padded = np.pad(signal, ((0, 0), (pad, pad + hop)))
    mono = padded.mean(axis=0)
    out, weight = np.zeros((signal.shape[0], out_len + 2 * window)), np.zeros(out_len + 2 * window)
    shift = 0
    for k, (centre, want) in enumerate(zip(centres, ask)):
        at = want - half + pad
        if k:
            target = mono[last + hop : last + hop + window]
            span = mono[at - tolerance : at + tolerance + window]
            shift = int(np.argmax(np.correlate(span, target, "valid"))) - tolerance if target.any() and span.any() else 0
        last = min(max(at + shift, 0), padded.shape[1] - window - hop)
        out[:, centre : centre + window] += padded[:, last : last + window] * taper
        weight[centre : centre + window] += taper
    weight[weight < 1e-3] = 1
    return (out / weight)[:, half : half + out_len]


def change_speed(blocks: DataFrame, speed: float, by: str = "rec") -> DataFrame:
    """by, samples: each recording's samples (one channel, in blocks) at another speed and the same pitch."""
    kind = blocks.schema[by].dataType.simpleString()

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        signal = np.concatenate([np.asarray(s, float) for s in pdf.sort_values("block")["samples"]])
        n = max(1, round(len(signal) / speed))
        made = wsola(signal[None], np.array([0, len(signal) - 1]), np.array([0, n - 1]))[0] if len(signal) > 1 else signal
        return pd.DataFrame({by: [key[0]], "samples": [made]})

    return blocks.select(by, "block", "samples").groupBy(by).applyInPandas(run, f"{by} {kind}, samples array<double>")


def edited_signal(signal: np.ndarray, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """A workspace's samples (channel, sample) after its edit. src, dst: samples of its frames before and after.

    Deleted frames (dst 0) are left out; frames next to them keep their speed and are cut on the side towards them; the cuts are
    faded; the rest is stretched or squeezed.
    """
    ends = np.cumsum(src)
    pieces, kept_src, kept_dst, cuts = [], [], [], []
    gone = dst == 0
    for k in range(len(src)):
        if gone[k]:
            continue
        piece = signal[:, ends[k] - src[k] : ends[k]]
        after, before = k + 1 < len(src) and gone[k + 1], k > 0 and gone[k - 1]
        if dst[k] < src[k] and (after or before):
            piece = piece[:, : dst[k]] if after else piece[:, piece.shape[1] - dst[k] :]
        if before and kept_src:
            cuts.append(sum(kept_src))
        pieces.append(piece)
        kept_src.append(piece.shape[1])
        kept_dst.append(dst[k])
    if not pieces:
        return signal[:, :0]
    out = np.concatenate(pieces, axis=1).astype(float)
    for point in cuts:
        out = soften(out, point)
    if kept_src != kept_dst:
        a, b = np.r_[0, np.cumsum(kept_src)].astype(float), np.r_[0, np.cumsum(kept_dst)].astype(float)
        a[-1] -= 1
        b[-1] -= 1
        out = wsola(out, a, b)
    return out
