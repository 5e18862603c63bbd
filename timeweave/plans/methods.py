"""Analysis methods by name, and the whole way from recordings to an edit list."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timeweave.operators import intervals, retime, salience, signal, tokens


class Method(Protocol):
    """What a method gives: changes (rec, beg, fin, multi) of the recordings that it is handed."""

    def analyze(self, recordings: DataFrame) -> DataFrame: ...


METHODS: dict[str, Callable[..., Method]] = {}


def method(name: str) -> Callable:
    def register(cls):
        METHODS[name] = cls
        return cls

    return register


@method("spectrogram")
@dataclass
class Spectrogram:
    """Cuts what sounds like the moment before, and silence. recordings: rec, block, samples (one channel, at 16 kHz)."""

    th_ratio: float = 1.0
    dur_multi: float = 0.0
    silence_len: int = signal.SHORTEST

    def analyze(self, recordings: DataFrame) -> DataFrame:
        frames = signal.scaled(signal.smoothed_spectrum(signal.stft(recordings, power=signal.POWER)))
        return signal.redundant_changes(signal.kept_frames(frames, ratio=self.th_ratio, tail=self.silence_len), multi=self.dur_multi)


@method("tfidf")
@dataclass
class Tfidf:
    """Cuts sentences whose words say little. recordings: rec, idx, text, start_time, end_time; corpus: a table with text."""

    corpus: DataFrame
    sent_th_ratio: float = 1.0
    remove_sw: bool = False
    lemmatize: DataFrame | None = None

    def labels(self, recordings: DataFrame) -> DataFrame:
        """The tokens with sent_id, score and label."""
        said = tokens.sentences(recordings)
        model = salience.document_frequencies(self.corpus)
        n = self.corpus.count()
        tf = salience.term_frequencies(said, "rec")
        if self.remove_sw:
            tf = salience.without_stop_words(tf)
        if self.lemmatize is not None:
            tf = salience.lemmas(tf, self.lemmatize).groupBy("rec", "term").agg(F.sum("tf").alias("tf"))
        scores = salience.tfidf(tf, model, F.lit(n), "rec")
        marked = salience.labels(salience.sentence_scores(said, scores, "rec", self.remove_sw), self.sent_th_ratio, "rec")
        return said.join(marked, ["rec", "sent_id"])

    def analyze(self, recordings: DataFrame) -> DataFrame:
        return tokens.changes_of_tokens(self.labels(recordings))


def prepare(name: str, **params) -> Method:
    """The method of that name. An unknown one, or an unknown parameter, is an error."""
    if name not in METHODS:
        raise ValueError(f"no method {name}; there are {', '.join(METHODS)}")
    return METHODS[name](**params)


def direct(inputs: list[tuple[Method, DataFrame]], given: DataFrame | None = None) -> DataFrame:
    """rec, beg, fin, multi: what several methods ask for, the first having priority, after changes that are given."""
    found = [m.analyze(df) for m, df in inputs]
    return intervals.combine_by_priority(([given] if given is not None else []) + found)


def edit(packets: DataFrame, changes: DataFrame) -> DataFrame:
    """The plan of an edit, for whatever muxes media: rec, frame, src, dst and pts of the frames that are left."""
    timed = retime.trim_tail(retime.retime(retime.frame_durations(packets), changes), changes)
    return timed.join(retime.output_times(timed), ["rec", "frame"])
