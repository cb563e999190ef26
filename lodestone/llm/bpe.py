"""Byte-level BPE by a segment tree of pair ranks.

A pre-token of n bytes starts as n one-byte tokens. Leaf i of the tree holds
the rank of the pair (token at i, next live token), or NONE. The root is the
leftmost minimum, so one merge is: read the root, join the two tokens, and
update three leaves (the merged position, its live predecessor, and the
position that died), each along one path to the root.

Short pre-tokens are merged together: one two-dimensional array holds a tree
per pre-token and each step makes one merge in every tree that is still live.
Long ones take the scalar tree, which stays O(n log n) for any length.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrays, pieces

NONE = np.int64(2**62)
#: Pre-tokens of at most so many bytes are merged together.
SHORT = 64
#: Pre-tokens that a worker remembers; then it forgets all and starts anew.
REMEMBER = 400_000
#: Bytes of text whose new pre-tokens are merged together: more of them share each step.
PIECE = 8_000_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Codec:
    """Encoder and decoder for the ranks in a file of `base64 rank` lines, the rank being the id."""

    def __init__(self, path: str, pattern: str):
        self.ranks = load_ranks(path)
        self.pattern = regex.compile(pattern)
        self.byte_id = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        self.id_bits = max(self.ranks.values()).bit_length()
        pairs = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a << self.id_bits | b] = rank
        self.pair = pairs
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ranks = np.array([pairs[int(k)] for k in self.pair_keys], np.int64)
        self.text_to_bytes = {str(rank): token for token, rank in self.ranks.items()}
        self.known: dict[str, str] = {}

    # -- merging ---------------------------------------------------------

    def merge_one(self, data: bytes) -> list[int]:
        """The scalar tree, for any length."""
        n = len(data)
        if n < 2:
            return [int(self.byte_id[b]) for b in data]
        size = 1 << (n - 1).bit_length()
        shift, none, pair = size.bit_length(), int(NONE), self.pair
        ids = [int(self.byte_id[b]) for b in data]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        tree = [none] * (2 * size)
        bits = self.id_bits

        def key(i: int) -> int:
            j = after[i]
            if j >= n:
                return none
            r = pair.get(ids[i] << bits | ids[j])
            return none if r is None else r << shift | i

        for i in range(n - 1):
            tree[size + i] = key(i)
        for i in range(size - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])

        def put(i: int, value: int) -> None:
            k = size + i
            tree[k] = value
            k >>= 1
            while k:
                low = min(tree[2 * k], tree[2 * k + 1])
                if tree[k] == low:
                    break
                tree[k] = low
                k >>= 1

        while (top := tree[1]) != none:
            i = top & ((1 << shift) - 1)
            j = after[i]
            ids[i] = top >> shift
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            put(j, none)
            put(i, key(i))
            if before[i] >= 0:
                put(before[i], key(before[i]))
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = after[i]
        return out

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        k = a << self.id_bits | b
        at = np.searchsorted(self.pair_keys, k)
        at[at == len(self.pair_keys)] = 0
        return np.where(self.pair_keys[at] == k, self.pair_ranks[at], -1)

    def merge_many(self, words: list[bytes]) -> list[list[int]]:
        """One tree a word, of one size; words of 2 to SHORT bytes."""
        m, width = len(words), max(map(len, words))
        size = 1 << (width - 1).bit_length()
        length = np.array([len(w) for w in words])
        raw = np.frombuffer(b"".join(w.ljust(size, b"\0") for w in words), np.uint8).reshape(m, size)
        ids = self.byte_id[raw]
        at = np.arange(size)
        after = np.broadcast_to(at + 1, (m, size)).copy()
        before = np.broadcast_to(at - 1, (m, size)).copy()
        live = at[None, :] < length[:, None]
        tree = np.full((m, 2 * size), NONE)
        shift = size.bit_length()
        if size > 1:
            rank = self._rank(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(m, size - 1)
            ok = (rank >= 0) & live[:, 1:]
            tree[:, size : 2 * size - 1] = np.where(ok, rank << shift | at[:-1], NONE)
        k = size
        while k > 1:
            k >>= 1
            tree[:, k : 2 * k] = np.minimum(tree[:, 2 * k : 4 * k : 2], tree[:, 2 * k + 1 : 4 * k : 2])

        def put(row: np.ndarray, i: np.ndarray, value: np.ndarray) -> None:
            k = size + i
            tree[row, k] = value
            for _ in range(size.bit_length() - 1):
                k = k >> 1
                tree[row, k] = np.minimum(tree[row, 2 * k], tree[row, 2 * k + 1])

        def key(row: np.ndarray, i: np.ndarray) -> np.ndarray:
            j = after[row, i]
            inside = j < length[row]
            r = self._rank(ids[row, i], ids[row, np.where(inside, j, 0)])
            return np.where(inside & (r >= 0), r << shift | i, NONE)

        row = np.flatnonzero(tree[:, 1] != NONE)
        while len(row):
            top = tree[row, 1]
            i = top & ((1 << shift) - 1)
            j = after[row, i]
            ids[row, i] = top >> shift
            live[row, j] = False
            nxt = after[row, j]
            after[row, i] = nxt
            inside = nxt < length[row]
            before[row[inside], nxt[inside]] = i[inside]
            put(row, j, np.full(len(row), NONE))
            put(row, i, key(row, i))
            prev = before[row, i]
            has = prev >= 0
            put(row[has], prev[has], key(row[has], prev[has]))
            row = row[tree[row, 1] != NONE]
        flat, counts = ids[live].tolist(), live.sum(1).tolist()
        out, s = [], 0
        for c in counts:
            out.append(flat[s : s + c])
            s += c
        return out

    # -- texts -----------------------------------------------------------

    def learn(self, words: Iterable[str]) -> None:
        """Put what is new among words into `known`: word -> its ids, written with a space between."""
        if len(self.known) > REMEMBER:
            self.known.clear()
        groups: dict[int, list[tuple[str, bytes]]] = {}
        for w in words:
            if w in self.known:
                continue
            b = w.encode()
            whole = self.ranks.get(b)
            if whole is not None:
                self.known[w] = str(whole)
            elif len(b) > SHORT:
                self.known[w] = " ".join(map(str, self.merge_one(b)))
            else:
                groups.setdefault((len(b) - 1).bit_length(), []).append((w, b))
        for g in groups.values():
            for s in range(0, len(g), 20_000):
                part = g[s : s + 20_000]
                for (w, _), ids in zip(part, self.merge_many([b for _, b in part]), strict=True):
                    self.known[w] = " ".join(map(str, ids))

    def encode_texts(self, texts: list[str]) -> Iterator[str]:
        """A text -> its ids, written with a space between."""
        words = [self.pattern.findall(t) for t in texts]
        fresh: set[str] = set()
        for w in words:
            fresh.update(w)
        self.learn(fresh)
        get = self.known.__getitem__
        for w in words:
            yield " ".join(map(get, w))

    def decode(self, ids: str) -> bytes:
        return b"".join(map(self.text_to_bytes.__getitem__, ids.split(" "))) if ids else b""


@functools.lru_cache(4)
def codec(path: str, pattern: str) -> Codec:
    """One for each worker process, kept from task to task."""
    return Codec(path, pattern)


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode each text and decode the ids.

    In: doc_id, text (further columns are not read). Out: doc_id, n_tokens,
    ids_sha256 (decimal ids joined by one space), decoded_sha256 (the decoded
    bytes). A null or empty text has no token, and both digests are those of
    no bytes. Repeated rows each give a row; a null doc_id stays null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        out = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
        for whole in batches:
            for b in pieces(whole, PIECE):
                texts = [t or "" for t in b.column(1).to_pylist()]
                n, ids_sha, dec_sha = [], [], []
                for ids in c.encode_texts(texts):
                    n.append(ids.count(" ") + 1 if ids else 0)
                    ids_sha.append(hashlib.sha256(ids.encode()).hexdigest())
                    dec_sha.append(hashlib.sha256(c.decode(ids)).hexdigest())
                yield arrays(out, [b.column(0), n, ids_sha, dec_sha])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids array<int>: the ids of each text (none for a null or empty one)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        out = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
        for whole in batches:
            for b in pieces(whole):
                ids = [[int(x) for x in s.split(" ")] if s else [] for s in c.encode_texts([t or "" for t in b.column(1).to_pylist()])]
                yield arrays(out, [b.column(0), ids])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, text: the texts that `encode` took (a null array is an empty text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        out = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])
        for b in batches:
            yield arrays(out, [b.column(0), [c.decode(" ".join(map(str, x or []))).decode() for x in b.column(1).to_pylist()]])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
