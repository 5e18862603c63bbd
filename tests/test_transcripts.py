import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from timeweave.operators import salience as sa
from timeweave.operators import signal as sg
from timeweave.operators import terms
from timeweave.operators import tokens as tk
from timeweave.plans import methods, transcripts
from timeweave.sources import config, recordings, subtitles, urls

INF = float("inf")


def tokens(spark, rows):
    return spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], "rec int, idx int, text string, start_time double, end_time double, label double")


def test_cue_cleaning(spark):
    df = spark.createDataFrame([("  [noise] hi\n\n there (x) ",), ("(only) [this]",), (None,), ("a  b",)], "text string")
    assert [r.text for r in tk.cues(df).collect()] == ["hi there", "a b"]


@pytest.mark.parametrize("gap, want", [(3.0, [0, 0]), (3.1, [0, 1])])
def test_sentence_gap(spark, gap, want):
    df = tokens(spark, [("a", 0.0, 1.0, None), ("b", 1.0 + gap, 9.0, None)])
    assert [r.sent_id for r in tk.split_by_silence(df).orderBy("idx").collect()] == want


def test_separators(spark):
    df = tokens(spark, [("ok,", 0.0, 1.0, None), ("ok", 9.0, 10.0, None), ("ok?", 19.0, 20.0, None), ("last,", 29.0, 30.0, None)])
    got = tk.separate_sentences(tk.split_by_silence(df)).orderBy("idx").collect()
    assert [r.text for r in got] == ["ok. ", "ok. ", "ok? ", "last,"]


def test_sentences_by_punctuation(spark):
    df = tokens(spark, [("one", 0.0, 1.0, None), ("two. And. So", 1.0, 2.0, None), ("on", 2.0, 3.0, None), ("end.", 3.0, 4.0, None), ("x", 4.0, 5.0, None)])
    assert [r.sent_id for r in tk.sentences(df).orderBy("idx").collect()] == [0, 0, 1, 1, 2]


def test_sentences_are_those_of_the_join_in_one_sort(spark):
    """Ends at the end of a token, inside it, none, several, texts that are empty or null: as by offsets and ends; one exchange, one sort."""
    texts = ["a. b", "c", None, "", "d? ", "e!\n.f", "g...", ". ", "h", "i.j", "?"] * 3
    df = tokens(spark, [(t, float(k), k + 0.5, None) for k, t in enumerate(texts)])
    placed = tk.offsets(df)
    joined = tk.split_by_silence(tk.assign_sentences(placed, tk.sentence_ends(placed)).withColumnRenamed("sent_id", "by_end"), within="by_end")
    got = tk.sentences(df)
    assert [(r.idx, r.start_pos, r.sent_id) for r in got.orderBy("idx").collect()] == [(r.idx, r.start_pos, r.sent_id) for r in joined.orderBy("idx").collect()]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert (plan.count("Exchange hash"), plan.count("- Sort [")) == (1, 1)


def test_salient_sentences_are_sentence_scores(spark):
    words = "the a cat sat mat unknown dog".split()
    said = spark.createDataFrame([(r, k, k // 2, " ".join(words[(r * 5 + k * j) % 7] for j in range(1, 6)) if (r + k) % 4 else None) for r in range(6) for k in range(9)] + [(9, 0, 0, "unknown"), (10, 0, 0, "the the")], "rec int, idx int, sent_id int, text string")
    model = spark.createDataFrame([("the", 8), ("a", 5), ("cat", 2), ("sat", 3), ("mat", 1), ("dog", 2)], "term string, df long")
    want = sa.sentence_scores(said, sa.tfidf(sa.term_frequencies(said, "rec"), model, F.lit(8), "rec"), "rec")
    got = {(r.rec, r.sent_id): r.score for r in sa.salient_sentences(said, model, F.lit(8), "rec").collect()}
    assert got == pytest.approx({(r.rec, r.sent_id): r.score for r in want.collect()}) and len(got) == 32


ODD = ["The cat\u00a0SAT", "", None, "\u00c9t\u00e9 caf\u00e9-CAFE", "\u4e2d\u6587 the,the;THE", "!?", "a\u00a0\u00a0b", "x" * 300, "1 2 the 3", "end", "\u0130stanbul \u20ac5 \u00c2\u00a3", " \u00a0", "\U0001f600 \U0001f600cat"]


def test_corpus_tfidf_is_tfidf_of_the_joins(spark):
    """Rows of one id, and those without one, are one document, in pieces of any size; no row for a term of a document is made by Spark, exchanged or sorted."""
    rows = [(k % 29 if k % 13 else None, f"{ODD[k % 13]} w{k % 7} w{k % 50}" if k % 3 else ODD[k % 13]) for k in range(400)] + [(k, "the the") for k in range(1000, 1050)]
    df = spark.createDataFrame(rows, "rec long, text string")
    model = df.select(F.explode(F.array_distinct(sa.terms(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    assert sorted(map(tuple, sa.document_frequencies(df).collect())) == sorted(map(tuple, model.collect()))
    want = {(r.rec, r.term): r.score for r in sa.tfidf(sa.term_frequencies(df, "rec"), model, F.lit(450), "rec").collect()}
    got = sa.corpus_tfidf(df, "rec")
    plan = got._jdf.queryExecution().executedPlan().toString()
    made = got.collect()
    assert {(r.rec, r.term): r.score for r in made} == pytest.approx(want, abs=1e-12) and len(made) == len(want) > 400
    assert plan.count("Exchange hash") == 1 and "Generate" not in plan and "regexp" not in plan and "SortMergeJoin" not in plan


def test_terms_in_pieces(monkeypatch):
    """Batches, chunks and vocabularies that are cut anywhere give the same scores."""
    ids, texts = [None, None, 1, 1, 1, 2, 3, 3], ["a b", "b\u00a0c", "a a d", None, "d", "...", "e", "e f a"]
    whole = pa.record_batch([pa.array([0] * 8, pa.int32()), pa.array(texts)], ["tw_split", "text"])
    rows = lambda k: [whole.slice(i, k) for i in range(0, 8, k)]
    score = lambda k: [tuple(r.values()) for b in terms.scores(iter(known + docs(k))) for r in b.to_pylist()]
    found = pa.Table.from_batches(terms.vocabulary(iter(rows(8)))).to_pylist()
    known = [pa.record_batch([pa.array([0], pa.int32()), pa.array([math.log(8 / r["n"])]), pa.array([None], pa.int64()), pa.array([r["term"]])], list("sixt")) for r in found]
    docs = lambda k: [pa.record_batch([b.column(0), pa.nulls(len(b), pa.float64()), pa.array(ids, pa.int64())[i * k : i * k + k], b.column(1)], list("sixt")) for i, b in enumerate(rows(k))]
    want = score(8)
    assert sorted((str(i), t) for i, t, _ in want) == [("1", "a"), ("1", "d"), ("3", "a"), ("3", "e"), ("3", "f"), ("None", "a"), ("None", "b"), ("None", "c")]
    for name, least in (("CHUNK", 1), ("ROWS", 1), ("HELD", 1)):
        monkeypatch.setattr(terms, name, least)
        counts = {}
        for b in terms.vocabulary(iter(rows(3))):
            for r in b.to_pylist():
                counts[r["term"]] = counts.get(r["term"], 0) + r["n"]
        assert counts == {r["term"]: r["n"] for r in found} == {"a": 3, "b": 2, "c": 1, "d": 2, "e": 2, "f": 1}
        for k in (1, 3, 8):
            assert sorted(map(str, score(k))) == sorted(map(str, want))


@pytest.mark.parametrize("labels, want", [([1, 0, 1], [(0, 1), (2, 4), (5, INF)]), ([1, 1, 1], []), ([0, 1, 1], [(0, 2.5), (5, INF)]), ([0, 0, 0], [(0, INF)])])
def test_changes_of_tokens(spark, labels, want):
    times = [(1, 2), (2.5, 3), (4, 5)]
    df = tokens(spark, [("w", float(a), float(b), float(x)) for (a, b), x in zip(times, labels)])
    assert sorted((r.beg, r.fin) for r in tk.changes_of_tokens(df).collect()) == want


def test_words_of_characters(spark):
    text = " ab  c   d "
    df = spark.createDataFrame([(1, i, c, float(i)) for i, c in enumerate(text)], "rec int, idx int, ch string, start_time double")
    got = [(r.text, r.start_time, r.end_time) for r in tk.words_of_characters(df).orderBy("word_id").collect()]
    assert got == [(" ab", 0, 3), (" c", 4, 6), (" ", 7, 8), ("d", 9, 10)]


def test_words_of_texts(spark):
    """Without an exchange, as words_of_characters of the characters: spaces in a row, at both ends, texts of one character and beyond ASCII."""
    texts = [" ab  c   d ", "a", " ", "  ", "   ", "", None, "\u00e9t\u00e9 \U0001f600\u00a0x\n y", "no", "a b ", "x  ", " \u4e2d"]
    rows = [(r, i, ch, i * 60 / 1000) for r, t in enumerate(texts) for i, ch in enumerate(t or "")]
    want = tk.words_of_characters(spark.createDataFrame(rows, "rec int, idx int, ch string, start_time double"))
    got = tk.words_of_texts(spark.createDataFrame(list(enumerate(texts)), "rec int, text string").repartition(1), lambda idx: idx * 60 / 1000)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_chars_to_words_sorts_nothing(spark, sf_dir):
    plan = transcripts.chars_to_words(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hash" not in plan and "Sort" not in plan


def test_accuracy(spark):
    counts = lambda words: spark.createDataFrame([(1, w, words.count(w)) for w in sorted(set(words))], "rec int, word string, n long")
    got = sa.accuracy(counts("a a b".split()), counts("a b b c".split()), "rec").first().accuracy
    assert got == pytest.approx(25 / 36)


def test_adjusted_script(spark):
    assert spark.createDataFrame([('A,  b!\n"C"   d',)], "t string").select(sa.adjusted_script(F.col("t")).alias("t")).first().t == "a b c  d"


def test_webvtt(spark):
    content = "WEBVTT\n\nNOTE no\n\n1\n00:01.000 --> 00:02.500 align:start\n<v Ann>Hello\nthere</v>\n\n00:03.000 --> 00:03.000\nnever\n\n1:00:04.000 --> 1:00:05.250\n[music]\n\n01:00:06.000 --> 01:00:07.000\nlast\n"
    files = spark.createDataFrame([("a/b.VTT", content.replace("\n", "\r\n")), ("c.vtt", None), ("d.txt", "one\n\ntwo"), ("e.bin", "x")], "path string, content string")
    got = sorted((r.path, r.idx, r.text, r.start_time, r.end_time) for r in subtitles.read_contents(files).collect())
    assert got == [("a/b.VTT", 0, "Hello there", 1, 2.5), ("a/b.VTT", 1, "last", 3606, 3607), ("d.txt", 0, "one", 0, 1), ("d.txt", 1, "two", 1, 2)]


def test_spectrum_is_the_transform():
    rng = np.random.default_rng(0)
    x = rng.normal(size=1000)
    got = sg.spectrum(x, 64, 64)
    padded = np.pad(x, 32)
    for k in (0, 3, len(got) - 1):
        piece = padded[64 * k : 64 * k + 64] * [0.5 - 0.5 * math.cos(2 * math.pi * n / 64) for n in range(64)]
        want = [abs(sum(piece[n] * complex(math.cos(2 * math.pi * b * n / 64), -math.sin(2 * math.pi * b * n / 64)) for n in range(64))) for b in range(33)]
        assert np.allclose(got[k], want)
    assert sg.spectrum(np.zeros(0)).shape == (0, 129)


def test_wsola_keeps_pitch():
    t = np.arange(16000) / 16000
    out = sg.wsola(np.sin(2 * np.pi * 440 * t)[None], np.array([0, 15999]), np.array([0, 7999]))[0]
    assert len(out) == 8000
    peak = np.argmax(np.abs(np.fft.rfft(out[1000:7000]))) * 16000 / 6000
    assert abs(peak - 440) < 6


def test_edit_of_a_signal():
    signal = np.arange(1000, dtype=float)[None] + 1
    src, dst = np.array([200] * 5), np.array([200, 150, 0, 200, 200])
    out = sg.edited_signal(signal, src, dst)
    assert out.shape == (1, 750) and np.allclose(out[0, :280], signal[0, :280]) and np.allclose(out[0, 420:], signal[0, 670:])
    assert abs(out[0, 350]) < signal[0, 600]
    assert sg.edited_signal(signal, src, np.zeros(5, int)).shape == (1, 0)


def test_spectrogram_method_cuts_silence(spark, tmp_path):
    rng = np.random.default_rng(2)
    sound = lambda n: rng.normal(size=n) * np.repeat(rng.uniform(0.2, 1, n // 400 + 1), 400)[:n]
    signal = np.concatenate([sound(16000), np.zeros(16000), sound(16000)]).astype("<f4")
    (tmp_path / "a.pcm").write_bytes(signal.tobytes())
    blocks = recordings.read_pcm(spark, str(tmp_path / "a.pcm"), block=5000)
    assert recordings.stream_info(blocks, 16000).first().seconds == 3
    got = methods.prepare("spectrogram", th_ratio=0.0).analyze(blocks.withColumnRenamed("path", "rec")).collect()
    assert any(r.beg < 1.3 and r.fin > 1.7 for r in got) and all(0 <= r.beg < r.fin for r in got)


def test_tfidf_method_cuts_common_words(spark):
    corpus = spark.createDataFrame([("the cat",), ("the dog",), ("the quark gluon",), ("the end",)], "text string")
    df = tokens(spark, [("the the the.", 0.0, 1.0, None), ("quark gluon.", 1.0, 2.0, None)]).drop("label")
    got = methods.prepare("tfidf", corpus=corpus)
    assert [r.label for r in got.labels(df).orderBy("idx").collect()] == [0, 1]
    assert sorted((r.beg, r.fin) for r in methods.direct([(got, df)]).collect()) == [(0, 1), (2, INF)]
    with pytest.raises(ValueError):
        methods.prepare("unheard")


def test_pcm_channels(spark, tmp_path):
    (tmp_path / "x.pcm").write_bytes(np.array([1, 10, 2, 20, 3, 30, 7], "<i2").tobytes())
    got = recordings.read_pcm(spark, str(tmp_path / "x.pcm"), form="s16le", channels=2).orderBy("channel").collect()
    assert [r.samples for r in got] == [[1, 2, 3], [10, 20, 30]]
    assert recordings.read_pcm(spark, str(tmp_path / "x.pcm"), form="s16le", channels=2, mono=True).first().samples == [5.5, 11, 16.5]
    assert len(recordings.resample(np.zeros(100), 100, 50)) == 50


def test_corpus_model_is_kept(spark, tmp_path):
    path = str(tmp_path / "model")
    first = spark.createDataFrame([("a b",), ("a",)], "text string")
    terms, n = recordings.corpus_model(spark, first, path)
    again, m = recordings.corpus_model(spark, first.limit(0), path)
    assert n == m == 2 and sorted(map(tuple, again.collect())) == [("a", 2), ("b", 1)]
    with pytest.raises(ValueError):
        recordings.cache_dir(spark, "..")


def test_url_files(spark, tmp_path):
    (tmp_path / "in.txt").write_text("http://a\n\n  http://b \nhttp://a\n")
    read = urls.read_urls(spark, str(tmp_path / "in.txt"))
    assert read.count() == 3
    urls.write_urls(read.distinct(), str(tmp_path / "out"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == ["http://a", "http://b"]


def test_look_ups_that_fail_are_left_out(spark):
    def fetch(url):
        if url == "bad":
            raise OSError
        return '{"webpage_url": "%s", "subtitles": {"en": [{"ext": "vtt"}]}}' % url

    found = urls.inspect(spark.createDataFrame([("bad",), ("good",)], "url string"), fetch, 2)
    assert [r.url for r in urls.valid_urls(found, "en").collect()] == ["good"]
    assert urls.valid_urls(found, "fr").count() == 0 and urls.valid_urls(found, "none").count() == 1


def test_names_that_are_taken(spark):
    names = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "a")], "id int, name string")
    taken = spark.createDataFrame([("a",), ("a (2)",)], "name string")
    assert [r.unique_name for r in urls.unique_names(names, taken).orderBy("id").collect()] == ["a (1)", "a (3)", "b", "a (4)"]


def test_edit_command(spark, tmp_path):
    from timeweave import cli

    spark.createDataFrame([("r", k * 10) for k in range(5)], "rec string, pts long").write.parquet(str(tmp_path / "p"))
    (tmp_path / "c.json").write_text('{"timeline-changes": [[10, 20, 0], [25, Infinity, 0.5]]}')
    args = type("Args", (), {"packets": str(tmp_path / "p"), "config": str(tmp_path / "c.json"), "dst": str(tmp_path / "o")})
    cli.COMMANDS["edit"][1](spark, args)
    got = sorted((r.frame, r.dst, r.pts) for r in spark.read.parquet(str(tmp_path / "o")).collect())
    assert got == [(0, 10, 0), (2, 7.5, 10), (3, 5, 17.5), (4, 5, 22.5)]
