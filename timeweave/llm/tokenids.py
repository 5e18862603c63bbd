"""Token ids as fixed-width bits: each id takes the fewest bits that hold any id of the vocabulary."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timeweave.llm.common import small_batches

#: A rank file (a token in base64 and its id on each line) and how its tokenizer splits text.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Ids from 0 up to this one, not included; one more than the ranks, for an end mark.
VOCABULARY = 50257
#: Ids in a block; each block begins at a byte.
BLOCK = 1024
#: White space in a row from which the text is split here: the tokenizer's own splitter gives up beyond a million.
LONG_RUN = 1 << 16
SCHEMA = "doc_id long, n_tokens long, bits int, block_size int, block_offsets array<long>, packed binary"


def width(vocabulary: int) -> int:
    """The fewest bits that hold every id below `vocabulary`; 1 at least."""
    if vocabulary < 1:
        raise ValueError("the vocabulary is empty")
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int, block: int = BLOCK) -> tuple[bytes, np.ndarray]:
    """Ids as bits, the lowest first, and the byte at which each block of `block` ids begins, with the end as the last.

    An id that needs more bits, or is negative, is an error.
    """
    ids = np.asarray(ids, np.int64)
    if len(ids) and (ids.min() < 0 or int(ids.max()) >> bits):
        raise ValueError(f"an id doesn't fit {bits} bits")
    blocks = -(-len(ids) // block)
    per = -(-block * bits // 8)
    offsets = np.minimum(np.arange(blocks + 1, dtype=np.int64) * per, 0 if not blocks else (blocks - 1) * per + -(-(len(ids) - (blocks - 1) * block) * bits // 8))
    if not blocks:
        return b"", offsets
    if bits in (8, 16, 32) and per * 8 == block * bits:  # whole bytes: the same layout without shifting
        return ids.astype(f"<u{bits // 8}").tobytes(), offsets
    padded = np.zeros(blocks * block, np.uint32 if bits <= 32 else np.uint64)
    padded[: len(ids)] = ids
    digits = np.unpackbits(padded.view(np.uint8).reshape(len(padded), -1), axis=1, bitorder="little", count=bits)
    return np.packbits(digits.reshape(blocks, -1), axis=1, bitorder="little").tobytes()[: int(offsets[-1])], offsets


def unpack(packed: bytes, n: int, bits: int, block: int = BLOCK, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Ids start..stop of the n that are packed; only the bytes of the blocks that hold them are touched."""
    stop = n if stop is None else min(stop, n)
    start = max(start, 0)
    if start >= stop:
        return np.zeros(0, np.int64)
    per = -(-block * bits // 8)
    first, last = start // block, (stop - 1) // block
    raw = np.frombuffer(packed, np.uint8)[first * per : (last + 1) * per]
    raw = np.pad(raw, (0, (last - first + 1) * per - len(raw)))
    digits = np.unpackbits(raw.reshape(-1, per), axis=1, bitorder="little", count=block * bits).reshape(-1, bits)
    out = np.zeros((len(digits), 8), np.uint8)
    out[:, : -(-bits // 8)] = np.packbits(digits, axis=1, bitorder="little")
    return out.view("<i8")[:, 0][start - first * block : stop - first * block]


def encoder(ranks: str = RANKS, pattern: str = PATTERN):
    """The tokenizer of a rank file; special tokens' strings are ordinary text."""
    import tiktoken

    with open(ranks, "rb") as file:
        table = {base64.b64decode(token): int(i) for token, i in (line.split() for line in file if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def whole_encoder(ranks: str = RANKS, pattern: str = PATTERN):
    """A function from a text of any length to its ids, those of `encoder`.

    The tokenizer splits a text by a pattern that looks back over runs of white space and ends with a panic on very long ones.
    Texts with such a run are split by the same pattern here, and the pieces encoded one by one.
    """
    import regex

    own = encoder(ranks, pattern)
    splitter, run = regex.compile(pattern), regex.compile(r"\s{%d}" % LONG_RUN)

    def encode(text: str) -> list[int]:
        if len(text) < LONG_RUN or not run.search(text):
            return own.encode_ordinary(text)
        return [i for piece in splitter.finditer(text) for i in own._encode_single_piece(piece[0])]

    return encode


def _packed_batches(ranks: str, pattern: str, bits: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = None
        for batch in batches:
            encode = encode or whole_encoder(ranks, pattern)
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                counts, offsets, blobs = [], [], []
                for text in part.column(1):
                    ids = np.array(encode(text.as_py() or ""), np.int64)
                    blob, at = pack(ids, bits, block)
                    counts.append(len(ids))
                    offsets.append(at)
                    blobs.append(blob)
                n = part.num_rows
                ends = np.concatenate([[0], np.cumsum([len(o) for o in offsets])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(counts, pa.int64()), pa.array(np.full(n, bits, np.int32)), pa.array(np.full(n, block, np.int32)), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(offsets))), pa.array(blobs, pa.binary())],
                    ["doc_id", "n_tokens", "bits", "block_size", "block_offsets", "packed"],
                )

    return run


def token_ids(docs: DataFrame, ranks: str = RANKS, pattern: str = PATTERN, vocabulary: int = VOCABULARY, block: int = BLOCK) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, bits, block_size, block_offsets and packed, the ids of its whole text.

    docs: needs doc_id and text. ranks: the path of a rank file that every executor can read. Block k holds ids
    k*block_size up to (k+1)*block_size in bytes block_offsets[k] up to block_offsets[k+1]; `unpack` reads any range.
    A null text is as an empty one: no ids, no blocks, empty bytes. A text may be of any length and have any run of characters. Null ids stay null, equal rows are packed each.
    Other columns aren't read. An empty table gives an empty one.
    """
    narrow = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(_packed_batches(ranks, pattern, width(vocabulary), block), SCHEMA)


def unpacked(packed: DataFrame) -> DataFrame:
    """doc_id and ids (array) of what token_ids made."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            ids = [unpack(r["packed"], r["n_tokens"], r["bits"], r["block_size"]) for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int64()))], ["doc_id", "ids"])

    return packed.select("doc_id", "n_tokens", "bits", "block_size", "packed").mapInArrow(run, "doc_id long, ids array<long>")


def query(spark, sf_dir: str) -> DataFrame:
    return token_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"))
