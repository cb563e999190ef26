"""Quality rules: base rules on counts, then an isolation forest on rule statistics.

The forest's trees split at random, within the box of all labelled rows; a
document that few splits isolate lies where hardly any good one does. All
labelled rows count: the trees are drawn from the box alone, every good row is
counted in every tree, a node ends where less than one in `TREE_ROWS` of them
are left, and the threshold is the score that best parts all good from all bad
ones while it rejects at most `most_lost` of the good ones.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrays, discard, materialize, pieces

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\v\f\r"
TREES = 100
#: All good rows weigh as much as so many in a tree's nodes; a node of less than one isn't split.
TREE_ROWS = 256
#: Levels of a tree.
DEPTH = 12
#: Words in a block of which the distinct ones are counted.
BLOCK = 400
#: The share of the good labelled rows that the threshold may reject.
MOST_LOST = 0.002

_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_DIGITS = b"0123456789"
_MARKS = b"!?"
_PUNCT = b".,;:'\"()-"

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("mean_word", "symbol_share", "repeat_share", "upper_share", "mark_share", "digit_share", "punct_share", "distinct_share", "least_distinct")
COLUMNS = (*BASE, *FEATURES)


def repeated_words(words: list[bytes]) -> int:
    """Words in 3-word windows that the text holds twice or more."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    a = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    v = len(number)
    if v < 2_000_000:
        key = (a[:-2] * v + a[1:-1]) * v + a[2:]
    else:
        pair = np.unique(a[:-2] * v + a[1:-1], return_inverse=True)[1]
        key = pair * v + a[2:]
    order = np.argsort(key, kind="stable")
    s = key[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= twice
    return int(covered.sum())


def distinct_shares(words: list[bytes]) -> tuple[float, float]:
    """The mean and the least share of distinct words in blocks of `BLOCK` words that cover all of them.

    The last block reaches back over the one before, so that each has the same length; a shorter text is one block.
    """
    n = len(words)
    if n <= BLOCK:
        share = len(set(words)) / max(n, 1)
        return share, share
    starts = [*range(0, n - BLOCK, BLOCK), n - BLOCK]
    shares = [len(set(words[i : i + BLOCK])) / BLOCK for i in starts]
    return sum(shares) / len(shares), min(shares)


def statistics(text: str) -> list[float]:
    """The base counts and then the shares that the forest sees."""
    data = text.encode()
    words = data.split()
    n = len(words)
    chars = len(text) - (len(data) - len(data.translate(None, SPACES)))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    seen: set[bytes] = set()
    dup = 0
    for line in data.split(b"\n"):
        if line in seen:
            dup += 1
        elif line.strip(SPACES):
            seen.add(line)
    repeat = repeated_words(words)
    count = lambda of: len(data) - len(data.translate(None, of))
    m, c = max(n, 1), max(chars, 1)
    return [n, chars, symbols, dup, repeat, min(chars / m, 40.0), symbols / c, repeat / m, len(_UPPER.findall(text)) / c, count(_MARKS) / c, count(_DIGITS) / c, count(_PUNCT) / c, *distinct_shares(words)]


SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in BASE) + ", " + ", ".join(f"{c} double" for c in FEATURES)


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of each whole text (null: no words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.schema([("doc_id", pa.int64())] + [(c, pa.int64()) for c in BASE] + [(c, pa.float64()) for c in FEATURES])
        for whole in batches:
            for b in pieces(whole):
                rows = [statistics(t or "") for t in b.column(1).to_pylist()]
                yield arrays(out, [b.column(0), *map(list, zip(*rows, strict=True))])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


#: The mean depth of an unsuccessful search in a random tree of 0, 1, 2, ... keys.
_MEAN_PATH = np.array([0.0, 0.0] + [2 * sum(1 / k for k in range(1, n)) - 2 * (n - 1) / n for n in range(2, TREE_ROWS + 1)])


def _mean_path(n: np.ndarray | float) -> np.ndarray | float:
    """The mean depth of an unsuccessful search in a random tree of n keys; shares of a key lie between."""
    return np.interp(n, np.arange(len(_MEAN_PATH)), _MEAN_PATH)


@dataclass
class Cuts:
    """Full binary trees of random cuts, of `DEPTH` levels; node i has the children 2i + 1 and 2i + 2."""

    feature: np.ndarray
    cut: np.ndarray

    @classmethod
    def draw(cls, box: np.ndarray, trees: int = TREES, seed: int = 7) -> Cuts:
        """box: the least and greatest of each feature over all fitting rows.

        Cuts are drawn within the node's part of the box, not within the
        range of its rows: a feature in which all good rows agree still cuts
        off the empty side, and what falls there has a short path.
        """
        rng = np.random.default_rng(seed)
        low, high = (np.broadcast_to(x, (trees, 1, box.shape[1])).astype(float) for x in box)
        features, cuts = [], []
        for _ in range(DEPTH):
            f = np.where(high > low, rng.random(low.shape), -1.0).argmax(2)[:, :, None]
            a, b = np.take_along_axis(low, f, 2), np.take_along_axis(high, f, 2)
            c = a + rng.random(a.shape) * (b - a)
            features.append(f[:, :, 0])
            cuts.append(c[:, :, 0])
            mid_low, mid_high = low.copy(), high.copy()
            np.put_along_axis(mid_low, f, c, 2)
            np.put_along_axis(mid_high, f, c, 2)
            shape = (trees, 2 * low.shape[1], box.shape[1])
            low, high = np.stack([low, mid_low], 2).reshape(shape), np.stack([mid_high, high], 2).reshape(shape)
        return cls(np.concatenate(features, 1).astype(np.int8), np.concatenate(cuts, 1))

    def count(self, x: np.ndarray) -> np.ndarray:
        """How many rows of x fall below each node of the last level, by tree."""
        out, each = np.zeros((len(self.cut), 1 << DEPTH), np.int64), np.arange(len(x))
        for t in range(len(self.cut)):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[each, self.feature[t, at]] > self.cut[t, at])
            out[t] = np.bincount(at - ((1 << DEPTH) - 1), minlength=1 << DEPTH)
        return out


@dataclass
class Forest:
    """Trees in arrays: feature -1 marks a leaf, whose cut holds its depth plus the mean path below it; the right child follows the left one."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    scale: float

    @classmethod
    def of(cls, cuts: Cuts, counts: np.ndarray, rows: int = TREE_ROWS) -> Forest:
        """The trees of cuts, by the number of good rows below each node of the last level; together they weigh as much as `rows`."""
        levels = [counts]
        while levels[-1].shape[1] > 1:
            levels.append(levels[-1][:, 0::2] + levels[-1][:, 1::2])
        levels.reverse()
        weight = np.concatenate(levels, 1) * (rows / max(int(levels[0][0, 0]), 1))
        depth = np.repeat(np.arange(DEPTH + 1), 1 << np.arange(DEPTH + 1))
        trees, inner = len(counts), weight > 1
        inner[:, len(depth) // 2 :] = False
        held = np.ones_like(inner)
        held[:, 1:] = np.repeat(inner[:, : len(depth) // 2], 2, axis=1)
        most = int(held.sum(1).max())
        feature, cut, left = np.full((trees, most), -1, np.int32), np.zeros((trees, most)), np.zeros((trees, most), np.int32)
        for t in range(trees):
            nodes = np.flatnonzero(held[t])
            split = np.flatnonzero(inner[t, nodes])
            cut[t, : len(nodes)] = depth[nodes] + _mean_path(weight[t, nodes])
            feature[t, split], cut[t, split] = cuts.feature[t, nodes[split]], cuts.cut[t, nodes[split]]
            left[t, split] = np.searchsorted(nodes, 2 * nodes[split] + 1)
        return cls(feature, cut, left, float(_mean_path(float(rows))) or 1.0)

    @classmethod
    def grow(cls, x: np.ndarray, box: np.ndarray, trees: int = TREES, rows: int = TREE_ROWS, seed: int = 7) -> Forest:
        """Grow on all rows of x."""
        cuts = Cuts.draw(box, trees, seed)
        return cls.of(cuts, cuts.count(x), rows)

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 ** -(mean path / expected path): towards 1 for rows that few splits isolate."""
        total, each = np.zeros(len(x)), np.arange(len(x))
        for t in range(len(self.feature)):
            at = np.zeros(len(x), np.int32)
            while True:
                f = self.feature[t, at]
                inner = f >= 0
                if not inner.any():
                    break
                above = x[each, np.maximum(f, 0)] > self.cut[t, at]
                at = np.where(inner, self.left[t, at] + above, at)
            total += self.cut[t, at]
        return np.exp2(-total / len(self.feature) / self.scale)


@dataclass
class Judge:
    """A fitted forest with its threshold; a document is bad if its score is above it."""

    forest: Forest | None
    threshold: float


def _best(good: np.ndarray, n_good: int, bad: np.ndarray, least: np.ndarray, n_bad: int) -> float:
    """The threshold from the greatest scores of good rows (sorted), and for each of these scores the bad rows above it, up to the next one: their number and least score."""
    above_good = len(good) - np.searchsorted(good, good, "right")
    above_bad = np.cumsum(bad[::-1])[::-1]
    best = int(np.argmax(above_bad / max(n_bad, 1) - above_good / n_good))
    after = np.searchsorted(good, good[best], "right")
    following = min(good[after] if after < len(good) else np.inf, least[after - 1])
    return float((good[best] + following) / 2) if np.isfinite(following) else float(good[best] + 1e-9)


def calibrate(good: np.ndarray, bad: np.ndarray, most_lost: float = MOST_LOST) -> float:
    """The threshold that rejects most bad rows and at most that share of the good ones; among ties, midway."""
    if not len(good):
        return np.inf
    top = np.sort(good)[len(good) - 1 - int(most_lost * len(good)) :]
    at = np.searchsorted(top, bad, "left") - 1
    least = np.full(len(top), np.inf)
    np.minimum.at(least, at[at >= 0], bad[at >= 0])
    return _best(top, len(good), np.bincount(at[at >= 0], minlength=len(top)), least, len(bad))


def _scores(rows: DataFrame, forest: Forest) -> DataFrame:
    """good, score of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.schema([("good", pa.bool_()), ("score", pa.float64())])
        for b in batches:
            if b.num_rows:
                yield arrays(out, [b.column(0), forest.score(np.column_stack([c.to_numpy() for c in b.columns[1:]]))])

    return rows.select("good", *FEATURES).mapInArrow(run, "good boolean, score double")


def _counts(good: DataFrame, cuts: Cuts) -> np.ndarray:
    """How many of all good rows fall below each node of the last level, by tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.schema([("leaf", pa.int32()), ("n", pa.int64())])
        total = np.zeros(cuts.cut.shape[0] << DEPTH, np.int64)
        for b in batches:
            if b.num_rows:
                total += cuts.count(np.column_stack([c.to_numpy() for c in b.columns])).reshape(-1)
        at = np.flatnonzero(total)
        yield arrays(out, [at, total[at]])

    got = good.select(*FEATURES).mapInArrow(run, "leaf int, n long").groupBy("leaf").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(cuts.cut.shape[0] << DEPTH, np.int64)
    counts[got["leaf"].to_numpy()] = got["n"].to_numpy()
    return counts.reshape(cuts.cut.shape[0], -1)


def _threshold(scores: DataFrame, n_good: int, n_bad: int, most_lost: float = MOST_LOST) -> float:
    """What `calibrate` gives on all rows of good, score; the driver holds the scores of the good rows that may be lost."""
    top = np.sort(scores.where("good").orderBy(F.desc("score")).limit(1 + int(most_lost * n_good)).select("score").toArrow()["score"].to_numpy())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.schema([("at", pa.int64()), ("score", pa.float64())])
        for b in batches:
            yield arrays(out, [np.searchsorted(top, b.column(0).to_numpy(), "left") - 1, b.column(0)])

    found = scores.where("not good").select("score").mapInArrow(run, "at long, score double").where("at >= 0").groupBy("at").agg(F.count("*").alias("n"), F.min("score").alias("least")).toArrow()
    n, least = np.zeros(len(top), np.int64), np.full(len(top), np.inf)
    n[found["at"].to_numpy()], least[found["at"].to_numpy()] = found["n"].to_numpy(), found["least"].to_numpy()
    return _best(top, n_good, n, least, n_bad)


def fit(measured: DataFrame, labels: DataFrame) -> Judge:
    """Fit on all labelled rows of measured (what `measure` gives). Without good labelled rows there is no forest and it rejects none."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality is not null")
    marks = marks.groupBy("doc_id").agg((F.min("quality") > 0).alias("good"))
    one = measured.groupBy("doc_id").agg(F.min(F.struct(*COLUMNS)).alias("s")).join(marks, "doc_id").select("good", "s.*")
    rows = materialize(one.where("n_words >= 50 and 100 * n_repeat_words <= 50 * n_words").select("good", *FEATURES), "labelled")
    ends = [g(c).alias(f"{i}{c}") for i, g in enumerate((F.min, F.max)) for c in FEATURES]
    seen = rows.agg(F.count("*").alias("n"), F.count_if("good").alias("n_good"), *ends).first()
    n_good = seen["n_good"]
    if n_good < 2:
        discard(rows)
        return Judge(None, np.inf)
    cuts = Cuts.draw(np.array(seen[2:], float).reshape(2, len(FEATURES)))
    forest = Forest.of(cuts, _counts(rows.where("good"), cuts))
    scores = materialize(_scores(rows, forest), "scores")
    judge = Judge(forest, _threshold(scores, n_good, seen["n"] - n_good))
    discard(rows, scores)
    return judge


def _judged(judge: Judge, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Base counts, base_failed, kept and score of rows of statistics."""
    failed = (t[:, 0] < 50) | (100 * t[:, 4] > 50 * t[:, 0])
    score = judge.forest.score(t[:, len(BASE) :]) if judge.forest else np.zeros(len(t))
    return t[:, : len(BASE)].astype(np.int64), failed, ~failed & (score <= judge.threshold), score


VERDICT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, anomaly double"


def verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document row: the base counts, base_failed, kept, anomaly (the forest's score).

    In: doc_id, text; labels: doc_id, quality (0 or 1; rows with nulls are
    left out, repeated labels count as the least). A null text has no words
    and fails the base rules. Without good labelled rows the verdict is that
    of the base rules and anomaly is 0. Repeated rows each give a row.
    """
    measured = materialize(measure(docs), "measured")
    judge = fit(measured, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.schema([("doc_id", pa.int64())] + [(c, pa.int64()) for c in BASE] + [("base_failed", pa.bool_()), ("kept", pa.bool_()), ("anomaly", pa.float64())])
        for b in batches:
            if b.num_rows:
                counts, failed, kept, score = _judged(judge, np.column_stack([c.to_numpy() for c in b.columns[1:]]).astype(float))
                yield arrays(out, [b.column(0), *counts.T, failed, kept, score])

    return measured.mapInArrow(run, VERDICT)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns as they are.

    A null or empty text has no words and goes. Each of repeated rows stays or
    goes with the others. Further columns may have any name. Without a usable
    label only the base rules judge. docs is read twice.
    """
    measured = materialize(measure(docs), "measured")
    judge = fit(measured, labels)
    discard(measured)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in pieces(whole):
                t = np.array([statistics(x or "") for x in b.column(at).to_pylist()], float).reshape(b.num_rows, len(COLUMNS))
                yield b.filter(pa.array(_judged(judge, t)[2]))

    return docs.mapInArrow(run, docs.schema)
