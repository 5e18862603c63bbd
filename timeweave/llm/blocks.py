"""HTML extraction: a bidirectional LSTM in numpy reads a page's text blocks in order and tells content from the rest."""

from __future__ import annotations

import html as entities
import io
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timeweave.llm.common import small_batches, written
from timeweave.llm.textbatch import WHITE, U, texts, words

#: Pages that a fit reads at most, about, drawn by a hash of page_id; blocks of a page that is used to fit.
MAX_FIT_PAGES, MAX_FIT_BLOCKS = 500, 400
#: Blocks of at least this probability are content.
THRESHOLD = 0.5
PATH, WORD, NUMERIC, HIDDEN = 32, 32, 8, 24
WIDTH = PATH + WORD + NUMERIC
BUCKETS = 4096
#: What an element's path vector takes over from the one around it.
FADE = 0.75
EPOCHS, PAGES_A_STEP, RATE = 14, 16, 0.01
#: Blocks, padding included, that go through the network at once.
CELLS = 1 << 14

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<svg\b[^>]*/>|<(script|style|noscript|template|svg|title|textarea)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-z][a-z0-9:-]*)((?:[^<>\"']|\"[^\"<]*\"|'[^'<]*'|[\"'])*+)>|<[!?][^>]*>",
    re.S | re.I,
)
CLASS = re.compile(r"\bclass\s*=\s*[\"']?\s*([\w-]+)", re.I)
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: Elements that say outright what they hold: they label the pages to fit on, and are hidden from half of these.
CONTENT, BOILERPLATE = frozenset(("article", "main")), frozenset(("nav", "footer", "aside", "header", "menu", "form"))
BOILERPLATE_CLASS = frozenset("ad ads advert advertisement banner breadcrumb cookie menu navbar newsletter promo share sidebar social sponsor".split())


class Element:
    """An open element within another one: name, class, and what they all say together, without a limit to their depth."""

    __slots__ = ("name", "kind", "around", "label", "vectors")

    def __init__(self, name: str, kind: str, around: Element | None) -> None:
        self.name, self.kind, self.around = name, kind, around
        inherited = -1 if around is None else around.label
        if kind in BOILERPLATE_CLASS or name in BOILERPLATE and not (name == "header" and inherited == 1):  # the header of an article is its title
            self.label = 0
        else:
            self.label = 1 if name in CONTENT else inherited
        self.vectors: list[np.ndarray | None] = [None, None]


class Block(NamedTuple):
    """A stretch of text without a block element in it, and the innermost of its open elements."""

    within: Element | None
    text: str
    linked: int

    @property
    def path(self) -> tuple[tuple[str, str], ...]:
        """All open elements outwards, each as (name, class)."""
        out, e = [], self.within
        while e is not None:
            out.append((e.name, e.kind))
            e = e.around
        return tuple(out)


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order. Comments, scripts, styles and the like have none; unclosed elements are closed as needed."""
    out: list[Block] = []
    stack: list[Element] = []
    opened: dict[str, int] = {}
    pieces: list[str] = []
    at = links = linked = 0

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join(entities.unescape("".join(pieces)).split())
            if text:
                out.append(Block(stack[-1] if stack else None, text, min(linked, len(text))))
            pieces.clear()
        linked = 0

    def close(name: str) -> None:
        while opened.get(name):
            top = stack.pop().name
            opened[top] -= 1
            if top == name:
                return

    def add(piece: str) -> None:
        nonlocal linked
        if piece and (pieces or not piece.isspace()):
            pieces.append(piece)
            if links:
                linked += len(piece.strip())

    for m in MARKUP.finditer(page):
        add(page[at : m.start()])
        at = m.end()
        name = m[3]
        if name is None:
            continue
        name = name.lower()
        if name in INLINE:
            if name == "a":
                links = 0 if m[2] else 1
            continue
        if name in VOID:
            if name == "br":
                add("\n")
            elif name == "hr":
                flush()
            continue
        flush()
        links = 0
        if m[2]:
            close(name)
            continue
        if name in CLOSES_P:
            if stack and stack[-1].name == "p":
                close("p")
        elif name in ("li", "tr", "td", "th", "dt", "dd", "option") and stack and stack[-1].name == name:
            close(name)
        if m[4].endswith("/"):
            continue
        kind = CLASS.search(m[4]) if m[4] else None
        stack.append(Element(name, kind[1].lower() if kind else "", stack[-1] if stack else None))
        opened[name] = opened.get(name, 0) + 1
    add(page[at:])
    flush()
    return out


def distant_label(block: Block) -> int:
    """1: within an element that says content, 0: within one that says otherwise (the innermost counts), -1: neither."""
    return -1 if block.within is None else block.within.label


def _signs(key: str, n: int) -> np.ndarray:
    bits = b"".join(zlib.crc32(key.encode(), salt).to_bytes(4, "little") for salt in range(-(-n // 32)))
    return np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(np.float32) * 2 - 1


def path_vector(within: Element | None, hide: bool = False, cache: dict | None = None) -> np.ndarray:
    """Signs hashed from an element's name and class, and FADE times those of what is around it, moved on by one place for each step
    outwards; hide: telling elements as plain div. Each element's is kept, so that the whole path costs one step."""
    cache = {} if cache is None else cache
    chain = []
    while within is not None and within.vectors[hide] is None:
        chain.append(within)
        within = within.around
    out = np.zeros(PATH, np.float32) if within is None else within.vectors[hide]
    for e in reversed(chain):
        name = "div" if hide and (e.name in CONTENT or e.name in BOILERPLATE) else e.name
        kind = "" if hide and e.kind in BOILERPLATE_CLASS else e.kind
        own = cache.get((name, kind))
        if own is None:
            if len(cache) > 20_000:
                cache.clear()
            own = cache[name, kind] = _signs(name, PATH) + (0.5 * _signs(f".{kind}", PATH) if kind else 0)
        out = e.vectors[hide] = (own + FADE * np.roll(out, 1)).astype(np.float32)
    return out


def word_table() -> np.ndarray:
    return np.random.default_rng(5).choice(np.array([-1, 1], np.float32), (BUCKETS, WORD))


def text_features(column: pa.Array, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word vectors (sums of the signs of lower-case words over the root of their number) and numbers of words, one row per block."""
    out, count = np.zeros((len(column), WORD), np.float32), np.zeros(len(column), np.int64)
    for t in texts(pc.utf8_lower(column)):
        w = words(t, ~WHITE)
        n = np.diff(w.first)
        count[t.lo : t.hi] = n
        full = np.flatnonzero(n > 0)
        if not len(full):
            continue
        rows = table[(w.hash & U(BUCKETS - 1)).astype(np.int64)]
        out[t.lo + full] = np.add.reduceat(rows, w.first[full], axis=0) / np.sqrt(n[full])[:, None]
    return out, count


def features(pages: list[list[Block]], cache: dict, table: np.ndarray, hide: bool = False) -> np.ndarray:
    """One row per block of the pages, one page after the other."""
    flat = [b for page in pages for b in page]
    out = np.zeros((len(flat), WIDTH), np.float32)
    if not flat:
        return out
    for k, b in enumerate(flat):
        out[k, :PATH] = path_vector(b.within, hide, cache)
    out[:, PATH : PATH + WORD], n = text_features(pa.array([b.text for b in flat], pa.string()), table)
    size = np.array([len(b.text) for b in flat], np.float32)
    at = PATH + WORD
    out[:, at] = np.log1p(n)
    out[:, at + 1] = np.log1p(size)
    out[:, at + 2] = np.array([b.linked for b in flat], np.float32) / np.maximum(size, 1)
    out[:, at + 3] = [b.text[-1] in ".!?…\"”" for b in flat]
    out[:, at + 4] = size / np.maximum(n, 1) / 10
    many = np.array([len(p) for p in pages])
    rank = np.concatenate([np.arange(m) for m in many]).astype(np.float32)
    left = np.repeat(many, many) - rank - 1
    out[:, at + 5], out[:, at + 6] = 1 / (1 + rank), 1 / (1 + left)
    out[:, at + 7] = rank / np.maximum(rank + left, 1)
    return out


class Model(NamedTuple):
    """Parameters by name: x, h and b of both directions (f, r), and the weights and bias of the answer; mean and scale of the input."""

    p: dict[str, np.ndarray]
    mean: np.ndarray
    scale: np.ndarray


def _padded(rows: np.ndarray, first: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers (time, page) of the chosen pages' blocks forwards and backwards, and which are real; padding is at the end."""
    n = (first[1:] - first[:-1])[chosen]
    t = np.arange(n.max())[:, None]
    real = t < n
    forward = np.where(real, first[chosen] + t, 0)
    return forward, np.where(real, first[chosen] + n - 1 - t, 0), real


def _pass(x: np.ndarray, wx: np.ndarray, wh: np.ndarray, b: np.ndarray, keep: list | None = None) -> np.ndarray:
    """The states h (time, page, HIDDEN) of one direction. Gates in, forget, out, then the candidate."""
    steps, pages, _ = x.shape
    z = (x.reshape(-1, x.shape[2]) @ wx + b).reshape(steps, pages, -1)
    h = c = np.zeros((pages, HIDDEN), np.float32)
    out = np.empty((steps, pages, HIDDEN), np.float32)
    n = 3 * HIDDEN
    for t in range(steps):
        a = z[t] + h @ wh
        a[:, :n] *= 0.5
        np.tanh(a, out=a)
        a[:, :n] = 0.5 * a[:, :n] + 0.5
        before = c
        c = a[:, HIDDEN : 2 * HIDDEN] * c + a[:, :HIDDEN] * a[:, n:]
        squashed = np.tanh(c)
        if keep is not None:
            keep.append((a, before, squashed, h))
        h = a[:, 2 * HIDDEN : n] * squashed
        out[t] = h
    return out


def _back(x: np.ndarray, wx: np.ndarray, wh: np.ndarray, kept: list, dh_all: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradients of wx, wh and b, backwards through time."""
    n = 3 * HIDDEN
    dz_all = np.empty((*dh_all.shape[:2], 4 * HIDDEN), np.float32)
    dwh = np.zeros_like(wh)
    dh = dc = np.zeros(dh_all.shape[1:], np.float32)
    for t in reversed(range(len(kept))):
        a, before, squashed, h = kept[t]
        i, f, o, g = a[:, :HIDDEN], a[:, HIDDEN : 2 * HIDDEN], a[:, 2 * HIDDEN : n], a[:, n:]
        dh = dh + dh_all[t]
        dc = dc + dh * o * (1 - squashed**2)
        dz = dz_all[t]
        dz[:, :HIDDEN] = dc * g * i * (1 - i)
        dz[:, HIDDEN : 2 * HIDDEN] = dc * before * f * (1 - f)
        dz[:, 2 * HIDDEN : n] = dh * squashed * o * (1 - o)
        dz[:, n:] = dc * i * (1 - g**2)
        dwh += h.T @ dz
        dh, dc = dz @ wh.T, dc * f
    flat = dz_all.reshape(-1, 4 * HIDDEN)
    return x.reshape(-1, x.shape[2]).T @ flat, dwh, flat.sum(axis=0)


def probabilities(model: Model, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Of each block, to be content. lengths: blocks of each page; pages of like length go through the network together."""
    out = np.zeros(len(x), np.float32)
    z = (x - model.mean) / model.scale
    first = np.r_[0, np.cumsum(lengths)]
    order = np.argsort(lengths, kind="stable")
    order = order[lengths[order] > 0][::-1]
    lo = 0
    p = model.p
    while lo < len(order):
        hi = lo + max(1, CELLS // int(lengths[order[lo]]))
        forward, backward, real = _padded(z, first, order[lo:hi])
        logit = _pass(z[forward], p["fx"], p["fh"], p["fb"]) @ p["of"] + p["ob"]
        other = _pass(z[backward], p["rx"], p["rh"], p["rb"]) @ p["or"]
        out[forward[real]] += logit[real]
        out[backward[real]] += other[real]
        lo = hi
    return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def train(sets: list[np.ndarray], y: np.ndarray, lengths: np.ndarray, epochs: int = EPOCHS) -> Model | None:
    """Adam on the logistic loss of labelled blocks (y 0 or 1, -1 without label), classes weighted alike.

    sets: the features as they are, and with the telling elements hidden; each step takes either, by a fixed draw.
    None if the labels lack a class.
    """
    if not ((y == 0).any() and (y == 1).any()):
        return None
    mean, scale = sets[0].mean(axis=0), sets[0].std(axis=0) + 0.1
    scaled = [((x - mean) / scale).astype(np.float32) for x in sets]
    rng = np.random.default_rng(2)
    p = {}
    for d in "fr":
        p[f"{d}x"] = rng.normal(0, WIDTH**-0.5, (WIDTH, 4 * HIDDEN)).astype(np.float32)
        p[f"{d}h"] = rng.normal(0, HIDDEN**-0.5, (HIDDEN, 4 * HIDDEN)).astype(np.float32)
        p[f"{d}b"] = np.r_[np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)].astype(np.float32)
        p[f"o{d}"] = rng.normal(0, HIDDEN**-0.5, HIDDEN).astype(np.float32)
    p["ob"] = np.zeros(1, np.float32)
    m, v = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}
    weight = np.where(y == 1, 0.5 / (y == 1).sum(), np.where(y == 0, 0.5 / (y == 0).sum(), 0)).astype(np.float32) * (y >= 0).sum()
    first, used, step = np.r_[0, np.cumsum(lengths)], np.flatnonzero(lengths > 0), 0
    for epoch in range(epochs):
        order = rng.permutation(used)
        order = order[np.argsort(lengths[order] // 8, kind="stable")]  # like lengths together, else in random order
        starts = rng.permutation(np.arange(0, len(order), PAGES_A_STEP))
        for lo in starts:
            z = scaled[int(rng.integers(len(scaled)))]
            forward, backward, real = _padded(z, first, order[lo : lo + PAGES_A_STEP])
            xs, states, kept = {"f": z[forward], "r": z[backward]}, {}, {"f": [], "r": []}
            for d in "fr":
                states[d] = _pass(xs[d], p[f"{d}x"], p[f"{d}h"], p[f"{d}b"], kept[d])
            logit = np.zeros(len(z), np.float32)
            logit[forward[real]] += (states["f"] @ p["of"])[real] + p["ob"]
            logit[backward[real]] += (states["r"] @ p["or"])[real]
            error = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - (y == 1)) * weight / max(real.sum(), 1)
            g = {"ob": np.array([error[forward[real]].sum()], np.float32)}
            for d, at in (("f", forward), ("r", backward)):
                e = np.where(real, error[at], 0).astype(np.float32)
                g[f"o{d}"] = np.einsum("tp,tph->h", e, states[d])
                g[f"{d}x"], g[f"{d}h"], g[f"{d}b"] = _back(xs[d], p[f"{d}x"], p[f"{d}h"], kept[d], e[:, :, None] * p[f"o{d}"])
            norm = np.sqrt(sum(float((a**2).sum()) for a in g.values()))
            step += 1
            rate = RATE * (1 - 0.9 * epoch / epochs)
            for k, a in g.items():
                a = a / max(1.0, norm)
                m[k] = 0.9 * m[k] + 0.1 * a
                v[k] = 0.99 * v[k] + 0.01 * a * a
                p[k] = (p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return Model(p, mean.astype(np.float32), scale.astype(np.float32))


def _narrow(pages: DataFrame) -> DataFrame:
    return small_batches(pages).select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html"))


def _fit_batches(max_blocks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        table = word_table()
        for batch in batches:
            for k in range(batch.num_rows):
                page = blocks(batch.column(1)[k].as_py() or "")
                if 0 < len(page) <= max_blocks:
                    x = [features([page], cache, table, hide).astype(np.float16).tobytes() for hide in (False, True)]
                    y = np.array([distant_label(b) for b in page], np.int8).tobytes()
                    yield pa.RecordBatch.from_arrays([batch.column(0)[k : k + 1], *(pa.array([v], pa.binary()) for v in (*x, y))], ["page_id", "x", "hidden", "y"])

    return run


def fit(pages: DataFrame, max_pages: int = MAX_FIT_PAGES, max_blocks: int = MAX_FIT_BLOCKS) -> Model | None:
    """The model of a bounded sample of pages, drawn by a hash of page_id, whose own elements (article, main, nav, footer and so on)
    label the blocks in them; pages of more than max_blocks blocks are left out of the sample, and scored like any other. In half of the steps those elements are hidden, so that the words and the context have to tell.

    Pages without an id aren't drawn. None: the sample has no labels of both kinds.
    """
    n = pages.count()
    draw = F.pmod(F.xxhash64("page_id", F.lit(23)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = _narrow(pages).filter("page_id IS NOT NULL").filter(draw < max_pages / max(n, 1))
    kept = written(chosen.mapInArrow(_fit_batches(max_blocks), "page_id long, x binary, hidden binary, y binary"), "block-sample")
    made = kept.coalesce(1).mapInArrow(_trained, "model binary").first()
    if made is None:
        return None
    with np.load(io.BytesIO(made["model"])) as arrays:
        return Model({k[2:]: arrays[k] for k in arrays.files if k.startswith("p_")}, arrays["mean"], arrays["scale"])


def _trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The model of the whole sample as one binary value, made by one task; the driver only keeps the parameters."""
    held = list(batches)
    if not sum(b.num_rows for b in held):
        return
    rows = pa.Table.from_batches(held).sort_by([("page_id", "ascending"), ("y", "ascending"), ("x", "ascending")])
    y = [np.frombuffer(v, np.int8) for v in rows["y"].to_pylist()]
    sets = [np.frombuffer(b"".join(rows[c].to_pylist()), np.float16).reshape(-1, WIDTH).astype(np.float32) for c in ("x", "hidden")]
    model = train(sets, np.concatenate(y), np.array([len(v) for v in y]))
    if model is not None:
        file = io.BytesIO()
        np.savez(file, mean=model.mean, scale=model.scale, **{f"p_{k}": v for k, v in model.p.items()})
        yield pa.RecordBatch.from_arrays([pa.array([file.getvalue()], pa.binary())], ["model"])


def _labelled(batch_html: pa.Array, model: Model | None, cache: dict, table: np.ndarray, hide: bool = False) -> Iterator[tuple[int, list[Block], np.ndarray]]:
    """Row, blocks and their probabilities of each page, in pieces of 128 pages."""
    for lo in range(0, len(batch_html), 128):
        pages = [blocks(v.as_py() or "") for v in batch_html[lo : lo + 128]]
        lengths = np.array([len(p) for p in pages], np.int64)
        p = np.ones(int(lengths.sum()), np.float32) if model is None else probabilities(model, features(pages, cache, table, hide), lengths)
        at = np.r_[0, np.cumsum(lengths)]
        for k, page in enumerate(pages):
            yield lo + k, page, p[at[k] : at[k + 1]]


BLOCKS = "page_id long, block long, path string, text string, probability double, is_content boolean"


def label_blocks(pages: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, block (from 0), path, text, probability and is_content of every block of every page.

    pages: needs page_id and html. Null and empty pages have no blocks. model None calls every block content.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        table = word_table()
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for row, page, p in _labelled(batch.column(1), model, cache, table):
                for k, b in enumerate(page):
                    for column, value in zip(out, (batch.column(0)[row].as_py(), k, "/".join(n for n, _ in reversed(b.path)), b.text, float(p[k]), bool(p[k] >= threshold))):
                        column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], [c.split()[0] for c in BLOCKS.split(", ")])

    return _narrow(pages).mapInArrow(run, BLOCKS)


PAGES = "page_id long, n_blocks long, n_content long, text string"


def extract(pages: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, n_blocks, n_content and text, the content blocks one to a line, for every row of pages.

    pages: needs page_id and html; other columns aren't read. A null or empty page, or one without content, has an empty text.
    Null ids stay null; equal rows are extracted each; the text of a page is read whole. An empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        table = word_table()
        for batch in batches:
            n, kept, text = [], [], []
            for _, page, p in _labelled(batch.column(1), model, cache, table):
                content = [b.text for b, q in zip(page, p) if q >= threshold]
                n.append(len(page))
                kept.append(len(content))
                text.append("\n".join(content))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(kept, pa.int64()), pa.array(text, pa.string())], [c.split()[0] for c in PAGES.split(", ")])

    return _narrow(pages).mapInArrow(run, PAGES)


def query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extract(pages, fit(pages))
