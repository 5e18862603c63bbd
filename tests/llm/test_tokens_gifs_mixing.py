import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from timeweave.llm import gifs as G
from timeweave.llm import mixing as M
from timeweave.llm import tokenids as T


@pytest.mark.parametrize("vocabulary, bits", [(1, 1), (2, 1), (3, 2), (256, 8), (257, 9), (50257, 16), (65537, 17), (1 << 31, 31)])
def test_bits_round_trip(vocabulary, bits):
    assert T.width(vocabulary) == bits
    rng = np.random.default_rng(bits)
    for n in (0, 1, 7, 8, 1023, 1024, 1025, 5000):
        ids = rng.integers(0, vocabulary, n)
        blob, at = T.pack(ids, bits, 64)
        assert len(blob) == at[-1] and np.array_equal(T.unpack(blob, n, bits, 64), ids)
        value = sum(int(v) << k * bits for k, v in enumerate(ids[:64].tolist()))  # the layout, said outright
        assert int.from_bytes(blob[: int(at[1])] if n else b"", "little") == value
        for a, b in ((0, 1), (n // 2, n // 2 + 70), (n - 1, n + 5)):
            assert np.array_equal(T.unpack(blob, n, bits, 64, a, b), ids[max(a, 0) : max(b, 0)])
    with pytest.raises(ValueError):
        T.pack(np.array([1 << bits]), bits)


def test_ids_of_long_white_space_are_the_plain_encoder_s(monkeypatch):
    """Runs that the plain encoder survives: split here or there, the ids are the same."""
    plain, whole = T.encoder(), T.whole_encoder()
    rng = np.random.default_rng(0)
    for run in (1 << 16, 70_001, 300_000):
        for white in (" ", "\n", "\t", "\u3000", " \n"):
            for before, after in (("", ""), ("x", "y"), ("it's", " 12"), ("x", "")):
                text = before + white * run + after
                assert whole(text) == plain.encode_ordinary(text)
    monkeypatch.setattr(T, "LONG_RUN", 3)
    short = T.whole_encoder()
    alphabet = list("ab'st 1#é漢 \n\t ")
    for _ in range(2000):
        text = "".join(rng.choice(alphabet, 40)) + " " * int(rng.integers(0, 6)) + "end"
        assert short(text) == plain.encode_ordinary(text)


def test_no_text_is_too_long(docs_of):
    """Through Spark: five million blanks, letters, words, and a few more that repeat one character."""
    texts = ["x" + " " * 5_000_000, " " * 5_000_000 + "x", "\n" * 2_000_000, "a" * 5_000_000, "word " * 1_000_000, "#" * 2_000_000]
    got = {r.doc_id: r for r in T.token_ids(docs_of(texts)).collect()}
    plain = T.encoder()
    for k in (3, 4, 5):
        ids = np.array(plain.encode_ordinary(texts[k]))
        assert got[k].n_tokens == len(ids) and np.array_equal(T.unpack(got[k].packed, len(ids), got[k].bits, got[k].block_size), ids)
    for k in (0, 1, 2):
        ids = T.unpack(got[k].packed, got[k].n_tokens, got[k].bits, got[k].block_size)
        assert plain.decode(ids.tolist()) == texts[k]


def test_token_ids_round_trip(docs_of, spark):
    texts = ["Hello, world!", "", None, "naïve café 日本語 <|endoftext|>", "x" * 5000, "word " * 30_000, "Hello, world!"]
    docs = docs_of([(k if k else None, t) for k, t in enumerate(texts)], bits=F.lit("clash"), PACKED=F.lit(1))
    packed = T.token_ids(docs)
    encode = T.encoder()
    want = {k if k else None: encode.encode_ordinary(t or "") for k, t in enumerate(texts)}
    rows = packed.collect()
    assert {r.doc_id: r.n_tokens for r in rows} == {k: len(v) for k, v in want.items()} and {r.bits for r in rows} == {16}
    assert {r.doc_id: r.ids for r in T.unpacked(packed).collect()} == want
    assert encode.decode(want[3]) == texts[3]
    assert T.token_ids(docs.limit(0)).count() == 0


def reference_frames(width, height, palette, frames):
    """Canvases pixel by pixel."""
    canvas = {(x, y): None for x in range(width) for y in range(height)}
    for f in frames:
        before = dict(canvas)
        colours = f.get("palette", palette)
        area = [(f.get("x", 0) + i, f.get("y", 0) + j) for j in range(len(f["index"])) for i in range(len(f["index"][0]))]
        for x, y in area:
            v = int(f["index"][y - f.get("y", 0)][x - f.get("x", 0)])
            if (x, y) in canvas and v != f.get("transparent", -1):
                canvas[x, y] = tuple(int(c) for c in colours[v])
        yield dict(canvas)
        if f.get("disposal") == 3:
            canvas = before
        elif f.get("disposal") == 2:
            canvas = {k: None if k in area else v for k, v in canvas.items()}


def test_decoding_against_pixels():
    rng = np.random.default_rng(7)
    for k in range(25):
        w, h, n = rng.integers(1, 24), rng.integers(1, 24), int(rng.choice([2, 3, 16, 200, 256]))
        palette, frames = rng.integers(0, 256, (n, 3)), []
        for _ in range(rng.integers(1, 6)):
            fw, fh = rng.integers(1, w + 1), rng.integers(1, h + 1)
            f = {"index": rng.integers(0, n, (fh, fw)), "x": int(rng.integers(0, w - fw + 2)), "y": int(rng.integers(0, h - fh + 1)), "delay": int(rng.integers(0, 50)), "disposal": int(rng.integers(0, 4)), "interlace": bool(rng.random() < 0.5)}
            if rng.random() < 0.5:
                f["transparent"] = int(rng.integers(0, n))
            if rng.random() < 0.3:
                f["palette"] = rng.integers(0, 256, (n, 3))
            frames.append(f)
        got = list(G.decode(G.encode(int(w), int(h), palette, frames)))
        assert len(got) == len(frames)
        clock = 0
        for f, g, want in zip(frames, got, reference_frames(w, h, palette, frames)):
            assert (g.start_ms, g.delay_ms) == (clock, 10 * f["delay"])
            clock += g.delay_ms
            for (x, y), c in want.items():
                assert (tuple(g.canvas[y, x, :3].tolist()) if g.canvas[y, x, 3] else None) == c
            hist = G.histograms(g.canvas)
            shown = [c for c in want.values() if c]
            for channel in range(3):
                assert hist[channel].tolist() == [sum(c[channel] * 8 // 256 == b for c in shown) for b in range(8)]


@pytest.mark.parametrize("size", range(2, 9))
def test_lzw_round_trip(size):
    rng = np.random.default_rng(size)
    for n in (1, 2, 300, 30_000):
        for top in (2, 1 << size):
            data = rng.integers(0, top, n).astype(np.uint8).tobytes()
            assert G.lzw_decode(G.lzw_encode(data, size), size, n) == data


def test_broken_and_missing_pictures(spark):
    whole = G.picture(np.arange(16.0))
    rows = [(1, whole), (1, whole), (2, None), (3, b""), (4, b"no gif at all"), (5, whole[:-30]), (None, whole), (6, whole[:13])]
    media = spark.createDataFrame([(i, None if m is None else bytearray(m)) for i, m in rows], "media_id long, media binary").withColumn("FRAME", F.lit(1)).withColumn("error", F.lit("x"))
    got = G.frames(media).collect()
    count = lambda i, bad: sum(r.media_id == i and (r.error is not None) == bad for r in got)
    assert (count(1, False), count(None, False), count(2, True), count(3, True), count(4, True), count(6, True)) == (6, 3, 1, 1, 1, 1)
    assert count(5, False) >= 2
    assert G.frames(media.limit(0)).count() == 0
    for cut in range(len(whole)):  # never crashes, however it is cut
        try:
            list(G.decode(whole[:cut]))
        except G.Broken:
            pass
    huge = bytearray(whole)
    huge[6:10] = b"\xff\xff\xff\xff"
    with pytest.raises(G.Broken):
        list(G.decode(bytes(huge)))


def test_vectors_as_pictures(spark):
    rows = [(1, [0.0, 0.5, 1.0, 0.25]), (2, None), (3, []), (4, [None, 1.0]), (5, [2.0])]
    got = G.frames(G.pictures(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))).collect()
    assert sorted((r.media_id, r.error is None) for r in got) == [(1, True)] * 3 + [(2, False), (3, False)] + [(4, True)] * 3 + [(5, True)] * 3


def test_mixing_by_the_rule(docs_of):
    rows = [(k, "w " * (k % 7), f"s{k % 3}" if k % 10 else None) for k in range(200)] + [(None, "a b", "s1"), (5, "a", "s2"), (5, "a", "s2"), (7, None, "empty")]
    docs = docs_of(rows, mix_rate=F.lit("clash"), MIX_SOURCE=F.lit(1))
    rates = {r.source: r.rate for r in M.source_rates(docs).collect()}
    tokens = {}
    for _, t, s in rows:
        tokens[s] = tokens.get(s, 0) + len((t or "").split())
    live = [s for s, n in tokens.items() if n]
    for s, n in tokens.items():
        assert rates[s] == pytest.approx(sum(tokens.values()) / len(live) / n if n else 1)
    want = []
    for i, t, s in rows:
        u = int(hashlib.md5(f"{M.SEED}:{'' if i is None else i}".encode()).hexdigest()[:8], 16) / 2**32
        times = int(rates[s]) + (u < rates[s] - int(rates[s]))
        want += [(i, t, s, k) for k in range(times)]
    got = M.mix(docs, copy="copy")
    assert got.columns == [*docs.columns, "copy"]
    key = lambda x: sorted(x, key=repr)
    assert key((r.doc_id, r.text, r.source, r.copy) for r in got.collect()) == key(want)


def test_weights(docs_of):
    docs = docs_of([(k, "a b c d", "x" if k < 30 else "y") for k in range(60)])
    rates = {r.source: r.rate for r in M.source_rates(docs, {"x": 3, "y": 1, "none": 5}).collect()}
    assert rates == {"x": pytest.approx(1.5), "y": pytest.approx(0.5)}
    assert M.mix(docs, {"y": 0.0}).count() == 0 and M.mix(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        M.mix(docs, {"x": -1})
    with pytest.raises(ValueError):
        M.mix(docs, copy="text")
