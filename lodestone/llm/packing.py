"""Packing documents into sequences of a fixed window, by best-fit decreasing.

An overlong document is first cut into full windows, which are sequences of
their own; what remains of each document is a piece shorter than the window.
Pieces go, longest first, into the open window with the least sufficient
capacity. A segment tree indexed by remaining capacity (leaf c: how many open
windows have c tokens left) finds that window in log(window) steps.

Work is dealt out by a hash of the document over buckets of about
`per_bucket` pieces; each bucket is packed on its own, so a task's memory is
bounded and a lost task is made again alone. A bucket leaves about one window
unfilled, so padding stays below 1 / (per_bucket * mean piece / window).
"""

from __future__ import annotations

import functools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrays, materialize, pieces

WINDOW = 2048
#: Documents in one bucket, about.
PER_BUCKET = 1500
#: The id that ends a document.
END_ID = 1


#: How a ByteLevel pre-tokenizer with use_regex splits: fixed by the file's format.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: What a file must hold besides its vocabulary for tiktoken to give its ids.
_PLAIN = {"normalizer": None, "post_processor": None, "truncation": None, "padding": None}


@functools.lru_cache(2)
def _tokenizer(vocabulary: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary)


@functools.lru_cache(2)
def _encoder(vocabulary: str):
    """The vocabulary of a plain byte-level BPE tokenizers file, run by tiktoken; None for any other file.

    Both libraries split and merge alike here and give the same ids (the tests
    hold one against the other); tiktoken takes a quarter of the CPU time. The
    file's added tokens are recognised in texts, as tokenizers does.
    """
    import tiktoken

    with open(vocabulary, encoding="utf-8") as f:
        spec = json.load(f)
    split = spec["pre_tokenizer"] or {}
    level = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
    odd = any(spec.get(k) != v for k, v in _PLAIN.items()) or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"])
    if not level or odd or spec["model"]["type"] != "BPE":
        return None
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    to_byte = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(to_byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("file", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens=special)


def token_ids(text: str, vocabulary: str) -> list[int]:
    """The ids that tokenizers gives for the text.

    tiktoken's pattern backtracks over each run of white space and gives up on
    very long ones (about a million characters); such a text is left to
    tokenizers itself.
    """
    encoder = _encoder(vocabulary)
    if encoder is not None:
        try:
            return encoder.encode(text, allowed_special="all")
        except ValueError:
            pass
    return _tokenizer(vocabulary).encode(text, add_special_tokens=False).ids


class BestFit:
    """Open windows by remaining capacity, in a segment tree of counts."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.tree = [0] * (2 * self.size)
        self.open: list[list[tuple[int, int]]] = [[] for _ in range(window + 1)]

    def _add(self, capacity: int, by: int) -> None:
        k = self.size + capacity
        while k:
            self.tree[k] += by
            k >>= 1

    def put(self, capacity: int, sequence: int, offset: int) -> None:
        if capacity:
            self.open[capacity].append((sequence, offset))
            self._add(capacity, 1)

    def take(self, need: int) -> tuple[int, int, int] | None:
        """The window with the least capacity of at least need: (capacity, sequence, offset)."""
        tree, k = self.tree, self.size + need
        if not tree[k]:
            while k > 1 and (k & 1 or not tree[k + 1]):
                k >>= 1
            if k <= 1:
                return None
            k += 1
            while k < self.size:
                k = 2 * k if tree[2 * k] else 2 * k + 1
        capacity = k - self.size
        self._add(capacity, -1)
        return (capacity, *self.open[capacity].pop())


def best_fit(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Sequence and offset for each piece, and how many sequences; longest first, ties by position."""
    fit, sequences = BestFit(window), 0
    seq, off = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable"):
        n = int(lengths[i])
        got = fit.take(n)
        if got is None:
            got = (window, sequences, 0)
            sequences += 1
        capacity, seq[i], off[i] = got
        fit.put(capacity - n, int(seq[i]), int(off[i]) + n)
    return seq, off, sequences


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, row long"


def cut(docs: DataFrame, vocabulary: str, window: int = WINDOW) -> DataFrame:
    """Tokenise and cut: a row a piece; the ids themselves are reduced to their checksum at once.

    `row` tells apart repeated rows of one doc_id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "row")])
        for whole in batches:
            for b in pieces(whole):
                cols: list[list[int]] = [[] for _ in range(6)]
                for doc, text, row in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                    ids = np.array(token_ids(text or "", vocabulary) + [END_ID], "<u4")
                    for s in range(0, len(ids), window):
                        part = ids[s : s + window]
                        for c, v in zip(cols, (doc, s, len(part), zlib.crc32(part.tobytes()), len(ids), row), strict=True):
                            c.append(v)
                yield arrays(out, cols)

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return picked.withColumn("row", F.monotonically_increasing_id()).mapInArrow(run, PIECES)


PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, vocabulary: str, window: int = WINDOW, per_bucket: int = PER_BUCKET) -> DataFrame:
    """Place every piece of every document in a sequence.

    In: doc_id, text (further columns are not read). A null or empty text is
    one piece holding the end id; a null doc_id keeps its pieces; repeated
    rows are packed each; a text of any length is cut, long runs of one
    character included. An empty table gives no row. Out: see PACKED;
    sequence_id is unique, and pieces lie in a sequence without gaps from
    offset 0.
    """
    cuts = materialize(cut(docs, vocabulary, window), "pieces")
    buckets = max(1, -(-cuts.count() // per_bucket))

    def fill(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "row", "start"], kind="stable").reset_index(drop=True)
        seq, off, _ = best_fit(pdf["length"].to_numpy(), window)
        pdf["sequence_id"] = seq + (int(key[0]) << 32)
        pdf["offset"] = off
        return pdf[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]

    bucket = F.pmod(F.xxhash64("doc_id", "row", "start"), F.lit(buckets)).cast("long")
    return cuts.withColumn("bucket", bucket).groupBy("bucket").applyInPandas(fill, PACKED)
