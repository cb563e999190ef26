"""Language-model scores by a probabilistic suffix tree over words.

States are contexts of up to two words, of any words. A next word is kept in a
state if it was seen there at least `LEAST` times, whatever the size of the
corpus, and a context is a state if its kept next words (and the rest as one)
diverge from the next shorter context by more than their description costs.
Kept words are discounted; what is left of a state's mass goes to the next
shorter context, down to the root: single words with 0.5 added to each count.

Score = sum over tokens of log10 P(token | longest suffix state). As each
state backs off by a factor, this is the base score plus a sum of weights over
the word pairs and triples of a text and over its words as contexts. Weights
are a table, joined with the texts by hash, so the model may grow with the
corpus. Weights of the most frequent words, pairs and triples travel to the
workers and need no join (`HOT_SYMBOL`, `HOT_GRAM`: no score depends on them),
and a bitmap of fixed size (`GATE_BITS`) keeps most grams that have no weight
from being joined: it lets too many through, never too few.

Grams and keys are too many for a row each: tasks deal them to buckets by hash
and hand on one value a bucket (`_dealt`), which holds them column by column.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Gate, arrays, discard, materialize, pieces

#: Shares of all tokens from which words, and pairs and triples of such words, travel to the workers: at most the inverse of each.
HOT_SYMBOL = 2e-6
HOT_GRAM = 1e-6
#: Occurrences that a state's next word needs, at least.
LEAST = 3
DISCOUNT = 0.75
#: Parts of the rows that are scored one after the other, so that one part's keys are on disk at a time.
PARTS = 2
#: Distinct keys that a task counts before it hands them on.
HOLD = 150_000

END, OTHER, BEGIN, FIRST = 0, 1, 2, 3
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: With this seed xxh64 gives what Spark's xxhash64 does.
SPARK_SEED = 42
#: Hashes of words that a worker remembers.
_REMEMBER = 250_000
#: Training tokens for each bucket of grams, and of keys that are scored.
GRAM_TOKENS = 1 << 20
KEY_TOKENS = 1 << 21


class _Hashes(dict):
    """word -> its hash, made when first asked for."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > _REMEMBER:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, SPARK_SEED)
        return h


_known = _Hashes()


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_LOWER).split()


def _rows(docs: DataFrame) -> DataFrame:
    held = F.coalesce(F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 5 == 1, F.lit(False))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held.alias("held_out"))


def count_words(train: DataFrame) -> DataFrame:
    """word, n over all training texts; the end of a text isn't among them. Counted in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.schema([("word", pa.binary()), ("n", pa.int64())])
        count: Counter[bytes] = Counter()
        for whole in batches:
            for b in pieces(whole):
                for t in b.column(0).to_pylist():
                    count.update(words_of(t))
                if len(count) > HOLD:
                    yield arrays(out, [list(count), list(count.values())])
                    count = Counter()
        if count:
            yield arrays(out, [list(count), list(count.values())])

    return train.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _symbols(texts: list, ids: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' symbols in one array, BEGIN before and END after each; where each text starts."""
    parts, starts, at, get = [], [], 0, ids.get
    for t in texts:
        words = words_of(t)
        s = np.empty(len(words) + 2, np.int64)
        s[0], s[-1] = BEGIN, END
        s[1:-1] = [get(x, OTHER) for x in words]
        parts.append(s)
        starts.append(at)
        at += len(s)
    return (np.concatenate(parts) if parts else np.zeros(0, np.int64)), np.array(starts, np.int64)


def _hashes(texts: list) -> np.ndarray:
    """All texts' words as 64-bit hashes, BEGIN before and END after each: places as in `_symbols`."""
    out: list[int] = []
    for t in texts:
        out.append(BEGIN)
        out.extend(map(_known.__getitem__, words_of(t)))
        out.append(END)
    return np.array(out, np.uint64)


def _key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The key of a gram from that of its front and its last word's hash."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + b + np.uint64(0xD1B54A32D192ED03)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _buckets(tokens: int, each: int) -> int:
    return max(8, -(-tokens // each))


def _dealt(bucket: np.ndarray, columns: list[np.ndarray]) -> tuple[np.ndarray, list[bytes]]:
    """The buckets that occur, and what each gets of the columns (in their order): a column's values, then the next one's."""
    by = np.argsort(bucket.astype(np.uint16) if len(bucket) and bucket.max() < 1 << 16 else bucket, kind="stable")
    bucket, columns = bucket[by], [c[by] for c in columns]
    ends = np.flatnonzero(np.append(bucket[1:] != bucket[:-1], np.ones(min(len(bucket), 1), bool))) + 1
    at = np.append(0, ends)[:-1]
    return bucket[at].astype(np.int32), [b"".join(c[i:j].tobytes() for c in columns) for i, j in zip(at, ends, strict=True)]


def _columns(values: list[bytes], types: list) -> tuple[list[np.ndarray], np.ndarray]:
    """The columns of values that `_dealt` made, one after the other; how many rows each value has."""
    types = [np.dtype(t) for t in types]
    rows = [len(x) // sum(t.itemsize for t in types) for x in values]
    parts: list[list[np.ndarray]] = [[np.zeros(0, t)] for t in types]
    for x, n in zip(values, rows, strict=True):
        at = 0
        for t, part in zip(types, parts, strict=True):
            part.append(np.frombuffer(x, t, n, at))
            at += n * t.itemsize
    return [np.concatenate(x) for x in parts], np.array(rows, np.int64)


def _found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of wanted are among the sorted keys, and where."""
    if not len(keys):
        return np.zeros(len(wanted), bool), np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return keys[at] == wanted, at


@dataclass
class Tree:
    """Weights of the frequent words, pairs and triples; keys are sorted."""

    ids: dict[bytes, int]
    #: symbol -> how often it was seen
    count: np.ndarray
    #: symbol -> factor of its state (0: none)
    back: np.ndarray
    #: pairs -> what the second gains after the first; factor of the pair's own state
    pair_keys: np.ndarray
    pair_gain: np.ndarray
    pair_back: np.ndarray
    #: triples -> what the third gains after the others
    triple_keys: np.ndarray
    triple_gain: np.ndarray

    @property
    def m(self) -> int:
        return len(self.ids) + FIRST

    def known(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Which neighbouring pairs of s, and which triples, are in the tree, each with its places."""
        pairs = s[:-1] * self.m + s[1:]
        return *_found(self.pair_keys, pairs), *_found(self.triple_keys, pairs[:-1] * self.m + s[2:])

    def corrections(self, s: np.ndarray, known: tuple | None = None) -> np.ndarray:
        """For each symbol what the frequent grams add to its log10 probability; none for BEGIN."""
        total = np.zeros(len(s))
        pair, at2, triple, at3 = known or self.known(s)
        total[1:] = self.back[s[:-1]]
        total[1:][pair] += self.pair_gain[at2[pair]]
        total[2:][pair[:-1]] += self.pair_back[at2[:-1][pair[:-1]]]
        total[2:][triple] += self.triple_gain[at3[triple]]
        total[s == BEGIN] = 0
        return total


def _deal_grams(train: DataFrame, order: int, gate: Gate, buckets: int) -> DataFrame:
    """bucket, data (the words' hashes and the count) of the grams of `order` words; each task adds up what it holds.

    gate: has the grams that are a word shorter and frequent enough, for no other
    can be part of one.
    """
    shared = train.sparkSession.sparkContext.broadcast(gate)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.schema([("bucket", pa.int32()), ("data", pa.binary())])
        gate = shared.value
        held: list[np.ndarray] = []

        def merged() -> np.ndarray:
            g = np.concatenate(held, axis=1)
            _, first, at = np.unique(g[0], return_index=True, return_inverse=True)
            n = np.bincount(at, g[-1], len(first)).astype(np.uint64)
            return np.vstack([g[:-1, first], n])

        def handed(g: np.ndarray) -> pa.RecordBatch:
            # By the first word, so that it is written once when compressed.
            g = g[:, np.argsort(g[1])]
            return arrays(out, [*_dealt(g[0] % np.uint64(buckets), [*g[1:-1], g[-1].astype(np.uint32)])])

        for whole in batches:
            for b in pieces(whole):
                h = _hashes(b.column(0).to_pylist())
                shorter = h if order == 2 else _key(h[:-1], h[1:])
                last = h[order - 1 :]
                ok = gate.has(shorter)
                ok = ok[:-1] & ok[1:]
                # A gram doesn't reach over a text's end.
                for k in range(1, order):
                    ok &= h[k : len(h) - order + 1 + k] != BEGIN
                at = np.flatnonzero(ok)
                keys = _key(shorter[:-1][at], last[at])
                _, first, n = np.unique(keys, return_index=True, return_counts=True)
                held.append(np.vstack([keys[first], *[h[at[first] + k] for k in range(order)], n.astype(np.uint64)]))
                if sum(x.shape[1] for x in held) > 4 * HOLD:
                    held = [merged()]
                    if held[0].shape[1] > 2 * HOLD:
                        yield handed(held[0])
                        held = []
        if held:
            yield handed(merged())

    return train.select("text").mapInArrow(run, "bucket int, data binary")


def _count_grams(train: DataFrame, order: int, gate: Gate, buckets: int) -> DataFrame:
    """g0, g1(, g2), n of the grams of `order` words seen at least LEAST times, as hashes; their key, and that of what comes before (front) and without the first word (tail)."""
    names = [*[f"g{k}" for k in range(order)], "n", "key", "front", "tail"]

    def add(t: pa.Table) -> pa.Table:
        (*g, n), _ = _columns(t.column("data").to_pylist(), [np.uint64] * order + [np.uint32])
        key = _key(g[0] if order == 2 else _key(g[0], g[1]), g[-1])
        _, first, at = np.unique(key, return_index=True, return_inverse=True)
        n = np.bincount(at, n, len(first)).astype(np.int64)
        first, n = first[n >= LEAST], n[n >= LEAST]
        g = [x[first] for x in g]
        front = g[0] if order == 2 else _key(g[0], g[1])
        tail = g[1] if order == 2 else _key(g[1], g[2])
        return pa.table([pa.array(x.view(np.int64)) for x in (*g, n, key[first], front, tail)], names)

    return _deal_grams(train, order, gate, buckets).groupBy("bucket").applyInArrow(add, ", ".join(f"{x} long" for x in names))


def _states(grams: DataFrame) -> DataFrame:
    """front, all, back of the contexts whose divergence from the shorter one pays for their description.

    grams: front, n, all (times the context was seen), p (the shorter context's
    share of the next word), below (its probability in the model). The gain in
    nats is n(context) * KL, where the words not kept count as one; the cost
    half a log of the count for each kept one. back is the log10 of the factor
    by which the shorter context's probabilities of the other words are taken.
    """
    least = F.lit(1e-12)
    own = (F.col("n") - DISCOUNT) / F.col("all")
    g = grams.groupBy("front", "all").agg(
        F.count("*").alias("kinds"),
        F.sum("n").alias("kept"),
        F.sum("p").alias("p"),
        F.sum(F.col("n") * F.log(F.col("n") / F.col("all") / F.col("p"))).alias("gain"),
        F.sum(own).alias("own"),
        F.sum("below").alias("below"),
    )
    rest = F.col("all") - F.col("kept")
    more = F.when(rest > 0, rest * F.log(rest / F.col("all") / F.greatest(1 - F.col("p"), least))).otherwise(0.0)
    back = F.log10(F.greatest(1 - F.col("own"), least) / F.greatest(1 - F.col("below"), least))
    return g.where(F.col("gain") + more > 0.5 * F.col("kinds") * F.log("all")).select("front", back.alias("back"))


def _gains(grams: DataFrame, states: DataFrame) -> DataFrame:
    """grams with gain: what the kept word adds to the shorter context's log10 probability times the factor (0: no state)."""
    x = grams.join(states, "front", "left")
    is_state = F.col("back").isNotNull()
    own = (F.col("n") - DISCOUNT) / F.col("all")
    x = x.withColumn("prob", F.when(is_state, own).otherwise(F.col("below")))
    return x.withColumn("gain", F.when(is_state, F.log10(own) - F.log10("below") - F.col("back")).otherwise(0.0)).drop("back")


@dataclass
class Model:
    """Tables of weights: contexts of one word (key, back), pairs and triples (key, weight); the hot ones as a tree."""

    words: DataFrame
    grams: DataFrame
    tree: Tree


def learn(train: DataFrame, counts: DataFrame, total: int, distinct: int, ends: int) -> Model:
    """Learn the model. counts: word, n of the training texts; total and distinct with the end token."""
    spark = train.sparkSession
    z = total + 0.5 * (distinct + 1)

    marks = spark.createDataFrame([(BEGIN, ends), (END, ends)], "key long, all long")
    vocabulary = materialize(counts.where(F.col("n") >= LEAST).select(F.xxhash64("word").alias("key"), F.col("n").alias("all")).unionByName(marks), "vocabulary")
    pairs = materialize(_count_grams(train, 2, Gate(vocabulary), _buckets(total, GRAM_TOKENS)), "grams")
    of = vocabulary.select(F.col("key").alias("tail"), (F.col("all") / total).alias("p"), ((F.col("all") + 0.5) / z).alias("below"))
    two = pairs.join(vocabulary.withColumnRenamed("key", "front"), "front").join(of, "tail")
    one_word = materialize(_states(two), "states")
    two = materialize(_gains(two, one_word), "gains")
    triples = materialize(_count_grams(train, 3, Gate(pairs), _buckets(total, GRAM_TOKENS)), "grams")
    shorter = two.select(F.col("key").alias("tail"), (F.col("n") / F.col("all")).alias("p"), F.col("prob").alias("below"))
    three = triples.join(pairs.select(F.col("key").alias("front"), F.col("n").alias("all")), "front").join(shorter, "tail")
    two_words = materialize(_states(three), "states")
    three = materialize(_gains(three, two_words), "gains")
    gains = two
    two = two.join(two_words.withColumnRenamed("front", "key"), "key", "left").withColumn("back", F.coalesce("back", F.lit(0.0)))
    two = materialize(two.select("g0", "g1", "key", "n", "gain", "back"), "gains")
    weights = two.select("key", (F.col("gain") + F.col("back")).alias("weight")).union(three.select("key", F.col("gain").alias("weight")))
    grams = materialize(weights.where("weight != 0"), "weights")
    words = one_word.withColumnRenamed("front", "key")
    model = Model(words, grams, _hot(counts, total, words, two, three))
    discard(vocabulary, pairs, triples, two_words, gains, two, three)
    return model


def fit(train: DataFrame, counts: DataFrame, total: int, distinct: int, ends: int) -> Tree:
    """The frequent part of the model."""
    return learn(train, counts, total, distinct, ends).tree


def _hot(counts: DataFrame, total: int, words: DataFrame, two: DataFrame, three: DataFrame) -> Tree:
    """What the most frequent words, and pairs and triples of these, weigh: at most 1 / HOT_SYMBOL and 1 / HOT_GRAM of each."""
    frequent = counts.where(F.col("n") >= max(LEAST, HOT_SYMBOL * total)).orderBy(F.desc("n"), "word").select("word", "n", F.xxhash64("word").alias("h")).toArrow()
    ids = {w: FIRST + i for i, w in enumerate(frequent["word"].to_pylist())}
    m = len(ids) + FIRST
    count = np.concatenate([np.zeros(FIRST, np.int64), frequent["n"].to_numpy()])
    h = np.concatenate([np.array([END, BEGIN], np.int64), frequent["h"].to_numpy()])
    number = pa.table({"h": h, "id": np.concatenate([np.array([END, BEGIN], np.int64), np.arange(FIRST, m)])})
    symbols = F.broadcast(words.sparkSession.createDataFrame(number))
    back = np.zeros(m)
    states = words.join(symbols, F.col("key") == F.col("h")).select("id", "back").toArrow()
    back[states["id"].to_numpy()] = states["back"].to_numpy()

    def hot(grams: DataFrame, order: int, *values: str) -> list[np.ndarray]:
        x = grams.where(F.col("n") >= max(LEAST, HOT_GRAM * total))
        for k in range(order):
            x = x.join(symbols.select(F.col("h").alias(f"g{k}"), F.col("id").alias(f"s{k}")), f"g{k}")
        got = x.select(*[f"s{k}" for k in range(order)], *values).toArrow()
        key = np.zeros(got.num_rows, np.int64)
        for k in range(order):
            key = key * m + got[f"s{k}"].to_numpy()
        by = np.argsort(key)
        return [key[by], *[got[v].to_numpy()[by] for v in values]]

    return Tree(ids, count, back, *hot(two, 2, "gain", "back"), *hot(three, 3, "gain"))


_DOC = pa.struct([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("correction", pa.float64())])
_DEALT = pa.schema([("bucket", pa.int32()), ("row", pa.int64()), ("data", pa.binary()), ("doc", _DOC)])
DEALT = "bucket int, row long, data binary, doc struct<doc_id: long, held_out: boolean, n_tokens: long, known: long, base: double, correction: double>"


def _unjoined(h: np.ndarray, s: np.ndarray, known: tuple, gate: Gate) -> tuple[np.ndarray, np.ndarray]:
    """Places and keys of the words that aren't in the tree, and of pairs and triples that aren't but may have a weight."""
    two = _key(h[:-1], h[1:])
    three = _key(two[:-1], h[2:])
    inside = s[1:] != BEGIN
    rare = np.flatnonzero(s == OTHER)
    a = np.flatnonzero(inside & ~known[0] & gate.has(two))
    b = np.flatnonzero(inside[:-1] & inside[1:] & ~known[2] & gate.has(three))
    return np.concatenate([rare, a, b]), np.concatenate([h[rare], two[a], three[b]])


def _row_bucket(row: np.ndarray, buckets: int) -> np.ndarray:
    """Rows beside each other are brought together."""
    return (row >> 6) % buckets


def _score_pass(rows: DataFrame, tree: Tree, logs: dict, gate: Gate, buckets: int) -> DataFrame:
    """A row for each text, with what the tree knows of it, and for each bucket the keys that are to be joined (doc is null there) with their texts' rows, counted from `row`.

    The words that the tree doesn't know are taken for unseen ones at first.
    """
    shared = rows.sparkSession.sparkContext.broadcast((tree, logs, gate))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, logs, gate = shared.value
        root, known = logs["root"], logs["known"]
        for whole in batches:
            for b in pieces(whole):
                texts = b.column(1).to_pylist()
                s, starts = _symbols(texts, tree.ids)
                inner = s != BEGIN
                hot = tree.known(s)
                sums = [np.add.reduceat(x, starts) for x in (np.where(inner, root[s], 0.0), tree.corrections(s, hot), (known[s] & inner).astype(np.int64))]
                n_tokens = np.diff(np.append(starts, len(s))) - 1
                docs = pa.StructArray.from_arrays([b.column(0), b.column(2), pa.array(n_tokens), pa.array(sums[2]), pa.array(sums[0]), pa.array(sums[1])], fields=list(_DOC))
                row = b.column(3).to_numpy()
                yield arrays(_DEALT, [_row_bucket(row, buckets), row, pa.nulls(len(row), pa.binary()), docs])
                place, key = _unjoined(_hashes(texts), s, hot, gate)
                by = np.argsort(place)
                after = (row - row[0]).astype(np.uint32)[np.searchsorted(starts, place[by], "right") - 1]
                bucket, data = _dealt(key[by] % np.uint64(buckets), [after, key[by]])
                yield arrays(_DEALT, [bucket, np.full(len(bucket), row[0]), data, pa.nulls(len(bucket), _DOC)])

    return rows.withColumn("row", F.monotonically_increasing_id()).select("doc_id", "text", "held_out", "row").mapInArrow(run, DEALT)


def _deal_weights(weights: DataFrame, buckets: int) -> DataFrame:
    """bucket, data (key, gain, weight) of the weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.schema([("bucket", pa.int32()), ("data", pa.binary())])
        held: list[pa.RecordBatch] = []

        def handed() -> pa.RecordBatch:
            key, gain, weight = (np.concatenate([b.column(k).to_numpy() for b in held]) for k in range(3))
            key = key.view(np.uint64)
            return arrays(out, [*_dealt(key % np.uint64(buckets), [key, gain, weight])])

        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) > HOLD:
                yield handed()
                held = []
        if held:
            yield handed()

    return weights.select("key", "gain", "weight").mapInArrow(run, "bucket int, data binary")


def _weights(counts: DataFrame, model: Model | None, z: float, hot: float) -> DataFrame:
    """key, gain, weight: of the words that do not travel what they gain over an unseen one (more than 0), and their states' factors; of grams (gain 0) their weights."""
    words = counts.where(F.col("n") < hot).select(F.xxhash64("word").alias("key"), "n")
    gain = (F.log10((F.col("n") + 0.5) / F.lit(z)) - F.lit(float(np.log10(0.5 / z)))).alias("gain")
    if model is None:
        return words.select("key", gain, F.lit(0.0).alias("weight"))
    # Only words seen LEAST times can be states; the others need no join.
    often = words.where(F.col("n") >= LEAST).join(model.words, "key", "left").select("key", gain, F.coalesce("back", F.lit(0.0)).alias("weight"))
    seldom = words.where(F.col("n") < LEAST).select("key", gain, F.lit(0.0).alias("weight"))
    return often.union(seldom).union(model.grams.select("key", F.lit(0.0).alias("gain"), "weight"))


def _scored(rows: DataFrame, tree: Tree, logs: dict, gate: Gate, weights: DataFrame, buckets: int, total: int) -> DataFrame:
    """The scores of rows, as `score` gives them. weights: as `_deal_weights` deals them."""

    def look_up(left: pa.Table, right: pa.Table) -> pa.Table:
        """What the bucket's weights add to each text, dealt by the texts' rows; texts go on as they are."""
        texts = left.filter(left.column("doc").is_valid()).cast(_DEALT)
        asked = left.filter(left.column("doc").is_null())
        (key, gain, weight), _ = _columns(right.column("data").to_pylist(), [np.uint64, np.float64, np.float64])
        # Keys that meet count together.
        key, at = np.unique(key, return_inverse=True)
        known, gain, weight = (np.bincount(at, x, len(key)) for x in (gain > 0, gain, weight))
        (after, wanted), n = _columns(asked.column("data").to_pylist(), [np.uint32, np.uint64])
        found, at = _found(key, wanted)
        row, mine = np.unique((np.repeat(asked.column("row").to_numpy(), n) + after)[found], return_inverse=True)
        at = at[found]
        known, gain, weight = (np.bincount(mine, x[at], len(row)) for x in (known, gain, weight))
        bucket, data = _dealt(_row_bucket(row, buckets), [row, known.astype(np.uint32), gain, weight])
        sums = arrays(_DEALT, [bucket, np.zeros(len(bucket), np.int64), data, pa.nulls(len(bucket), _DOC)])
        return pa.concat_tables([texts, pa.Table.from_batches([sums])])

    def add(t: pa.Table) -> pa.Table:
        texts, sums = t.filter(t.column("doc").is_valid()), t.filter(t.column("doc").is_null())
        doc, row = texts.column("doc").combine_chunks(), texts.column("row").to_numpy()
        (of, *more), _ = _columns(sums.column("data").to_pylist(), [np.int64, np.uint32, np.float64, np.float64])
        by = np.argsort(row)
        at = by[np.searchsorted(row[by], of)] if len(of) else np.zeros(0, np.int64)
        known, gain, weight = (np.bincount(at, x, len(row)) for x in more)
        base = doc.field("base").to_numpy() + gain
        columns = {"doc_id": doc.field("doc_id"), "held_out": doc.field("held_out"), "n_tokens": doc.field("n_tokens"), "n_known": doc.field("known").to_numpy() + known.astype(np.int64)}
        return pa.table(columns | {"train_tokens": np.full(len(row), total, np.int64), "base_score": base, "score": base + doc.field("correction").to_numpy() + weight})

    # No bucket has a hot key: what is frequent has travelled.
    summed = _score_pass(rows, tree, logs, gate, buckets).groupBy("bucket").cogroup(weights.groupBy("bucket")).applyInArrow(look_up, DEALT)
    return summed.groupBy("bucket").applyInArrow(add, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row of docs.

    In: doc_id, text (further columns are not read). Training rows: crc32 of
    doc_id, written as text, is not 1 modulo 5 (a null doc_id trains too). A
    null or empty text holds the end token alone. Without any training row
    all counts are 0 and each token has probability 1. Repeated rows count, and
    are scored, each.
    """
    rows = _rows(docs)
    train = rows.where(~F.col("held_out"))
    counts = materialize(count_words(train), "words")
    s = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    ends = train.count()
    total, distinct = s["n"] + ends, s["v"] + (ends > 0)
    z = total + 0.5 * (distinct + 1)
    if total:
        model = learn(train, counts, total, distinct, ends)
        tree, gate = model.tree, Gate(model.grams)
    else:
        none, zero = np.zeros(0, np.int64), np.zeros(0)
        tree, gate, model = Tree({}, np.zeros(FIRST, np.int64), np.zeros(FIRST), none, zero, zero, none, zero), Gate(rows.sparkSession.createDataFrame([], "key long")), None
    uni = tree.count.copy()
    uni[END] = ends
    logs = {"root": np.log10((uni + 0.5) / z), "known": uni > 0}
    hot = max(LEAST, HOT_SYMBOL * total)
    buckets = _buckets(total, KEY_TOKENS)
    weights = materialize(_deal_weights(_weights(counts, model, z, hot), buckets), "weights")
    discard(counts, *([model.grams] if model else []))
    # By what a row holds: its place may differ from one reading to the next.
    parts = [materialize(_scored(rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)) == k), tree, logs, gate, weights, buckets, total), "scored") for k in range(PARTS)]
    discard(weights)
    return functools.reduce(DataFrame.unionByName, parts)
