"""Near duplicates by a chosen-path set-similarity join.

A document's set holds its distinct 5-word shingles. Equal sets are one class
from the start. Each of several independent trees branches the classes by a
selected minwise token, recursively: a node of at most `NODE` classes is
compared exhaustively on signatures; a larger one branches further, along
positions that a hash of the node selects (3/2 of them in the mean, so that a
pair at the threshold keeps 9/8 paths a level in the mean: a tree that has
the pair in one node of its first level keeps it to any depth with a chance
of 0.43 or more, and one of 12 trees does so in 99 of 100 cases).
Candidate pairs are confirmed on full sets.

A large group of near copies would stay together along every path, so a large
node is relieved of its dense points before it branches (`_relieve`): all its
classes are compared with a few leaders and confirmed against the most similar
one; leaders that are linked are one hub. The classes around a hub that holds
a good part of the node are one component already. They leave the node, after
a comparison with all other classes that are near enough to a leader to be
linked with one of them.

Most small nodes are sparse and hand on all their candidate pairs. A dense one
first hands on a maximum spanning forest of its candidates, so its output is
linear; after these links are confirmed and merged, its sets are brought
together and only pairs between different components are confirmed, the
likeliest first.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Gate, arrays, discard, materialize, pieces
from .components import components

WORDS = 5
#: A link needs 100 * intersection >= SIMILARITY * union.
SIMILARITY = 75
#: Minwise tokens in a signature.
SIGNATURE = 256
#: Independent trees. A pair at the threshold shares a tree's first token with probability 3/4.
TREES = 12
#: Classes in a node that is compared exhaustively.
NODE = 2048
#: Shingles of the sets that are confirmed together.
NODE_SHINGLES = 4_000_000
#: Levels of a tree; a node that is still larger is cut into blocks and all its block pairs are compared.
DEPTH = 40
#: Candidate pairs are those whose estimate lies above the threshold less so many standard errors.
SIGMAS = 4
#: A node with more candidate pairs than so many times its classes is dense.
DENSE = 4
#: Classes that all others of a large node are compared with before it branches.
LEADERS = 8
#: A hub leaves a large node if it holds at least one in so many of its classes; a smaller one branches on.
HUB = 16

_LEAST = int(SIGNATURE * (SIMILARITY / 100 - SIGMAS * (0.75 * 0.25 / SIGNATURE) ** 0.5))
#: Two sets that are linked with a third share half of their union; so the estimate of those that may be is no less than this.
_NEAR = int(SIGNATURE * (0.5 - SIGMAS * (0.25 / SIGNATURE) ** 0.5))
_SEED = np.random.default_rng(20240)
_MULTIPLY = (_SEED.integers(1, 2**32, SIGNATURE, dtype=np.uint64) | 1).astype(np.uint32)
_ADD = _SEED.integers(0, 2**32, SIGNATURE, dtype=np.uint64).astype(np.uint32)
_FIRST_MULTIPLY = (_SEED.integers(1, 2**32, TREES, dtype=np.uint64) | 1).astype(np.uint32)
_FIRST_ADD = _SEED.integers(0, 2**32, TREES, dtype=np.uint64).astype(np.uint32)
_MIX = (_SEED.integers(1, 2**63, WORDS + 1, dtype=np.uint64) * 2 + 1).astype(np.uint64)
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Hashes of words that a worker remembers.
_REMEMBER = 500_000
_known: dict[bytes, int] = {}


def _mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser: each bit of the input moves half the bits of the output."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str) -> np.ndarray:
    """The distinct 5-word shingles as sorted 64-bit hashes; fewer words make one shingle, none make none."""
    words = text.encode().translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(_known) > _REMEMBER:
        _known.clear()
    get = _known.get
    hashes = []
    for w in words:
        h = get(w)
        if h is None:
            h = _known[w] = xxhash.xxh3_64_intdigest(w)
        hashes.append(h)
    a = np.array(hashes, np.uint64)
    k = min(WORDS, len(a))
    n = len(a) - k + 1
    total = np.full(n, np.uint64(k)) * _MIX[WORDS]
    for i in range(k):
        total += _mixed(a[i : i + n] + _MIX[i]) * _MIX[i]
    return np.unique(_mixed(total))


def signature(s: np.ndarray) -> bytes:
    """Minwise tokens, 16 bits each: enough to compare two sets by."""
    x = (s >> np.uint64(32)).astype(np.uint32)
    low = np.full(SIGNATURE, 2**32 - 1, np.uint32)
    for i in range(0, len(x), 512):
        np.minimum(low, (_MULTIPLY[:, None] * x[i : i + 512] + _ADD[:, None]).min(1), out=low)
    return (low ^ (low >> np.uint32(16))).astype("<u2").tobytes()


def first_tokens(s: np.ndarray) -> bytes:
    """The whole minwise shingle of each tree's first position, 64 bits: enough to tell sets apart."""
    x = (s >> np.uint64(32)).astype(np.uint32)
    return s[(_FIRST_MULTIPLY[:, None] * x + _FIRST_ADD[:, None]).argmin(1)].tobytes()


SIGNED = "doc_id long, text_key long, n_shingles long, set_a long, set_b long, signature binary, first binary"


def signed(docs: DataFrame) -> DataFrame:
    """Set size, 128-bit hash of the set (null if empty) and signature of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        i = pa.int64()
        out = pa.schema([("doc_id", i), ("text_key", i), ("n_shingles", i), ("set_a", i), ("set_b", i), ("signature", pa.binary()), ("first", pa.binary())])
        for whole in batches:
            for b in pieces(whole):
                n, hi, lo, sig, first = [], [], [], [], []
                for text in b.column(1).to_pylist():
                    s = shingles(text or "")
                    n.append(len(s))
                    if len(s):
                        d = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), "<i8")
                        hi.append(int(d[0]))
                        lo.append(int(d[1]))
                        sig.append(signature(s))
                        first.append(first_tokens(s))
                    else:
                        hi.append(None)
                        lo.append(None)
                        sig.append(None)
                        first.append(None)
                yield arrays(out, [b.column(0), b.column(2), n, hi, lo, sig, first])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.withColumn("text_key", F.xxhash64(F.coalesce("text", F.lit("")))).mapInArrow(run, SIGNED)


# -- trees --------------------------------------------------------------------


def _child(node: np.ndarray, position: np.ndarray | int, token: np.ndarray) -> np.ndarray:
    # At least one dimension: arithmetic on arrays wraps round without a warning.
    return _mixed(_mixed(node + _MIX[:1] * (np.atleast_1d(position).astype(np.uint64) + np.uint64(1))) + token)


def _branch(nodes: np.ndarray, sigs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Children of (node, signature) rows: row numbers and child nodes.

    The positions depend on the node alone: one for sure, a second one in
    half of the nodes.
    """
    each = np.arange(len(nodes))
    one, two = _mixed(nodes), _mixed(nodes + _MIX[1])
    p1 = (one % np.uint64(SIGNATURE)).astype(int)
    more = np.flatnonzero((two >> np.uint64(40)) % np.uint64(2) == 0)
    p2 = (p1[more] + 1 + (two[more] % np.uint64(SIGNATURE - 1)).astype(int)) % SIGNATURE
    return np.concatenate([each, more]), np.concatenate([_child(nodes, p1, sigs[each, p1]), _child(nodes[more], p2, sigs[more, p2])])


def _roots(classes: DataFrame) -> DataFrame:
    """node, id of the first level: each tree branches all classes by one whole minwise shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.schema([("node", pa.int64()), ("id", pa.int64())])
        for b in batches:
            if b.num_rows:
                ids = b.column(0).to_numpy()
                tokens = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint64).reshape(len(ids), TREES)
                for tree in range(TREES):
                    yield arrays(out, [_child(np.full(len(ids), tree, np.uint64), SIGNATURE, tokens[:, tree]).view(np.int64), ids])

    return classes.select("id", "first").mapInArrow(run, "node long, id long")


def _descend(rows: DataFrame) -> DataFrame:
    """node, id, signature -> the children's node, id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.schema([("node", pa.int64()), ("id", pa.int64())])
        for b in batches:
            if b.num_rows:
                sigs = np.frombuffer(b"".join(b.column(2).to_pylist()), "<u2").reshape(b.num_rows, SIGNATURE).astype(np.uint64)
                r, child = _branch(b.column(0).to_numpy().view(np.uint64), sigs)
                yield arrays(out, [child.view(np.int64), b.column(1).to_numpy()[r]])

    return rows.select("node", "id", "signature").mapInArrow(run, "node long, id long")


def _blocks(rows: DataFrame, most: int) -> DataFrame:
    """node, id: nodes of a size above most as nodes of two blocks each, so that each pair shares one."""
    k = F.when(F.col("size") > most, F.ceil(F.col("size") * 2 / F.lit(most))).otherwise(1).cast("int")
    mine = F.pmod(F.xxhash64("id"), k).cast("int")
    each = rows.select("node", "id", mine.alias("i"), F.explode(F.sequence(F.lit(0), k - 1)).alias("j"))
    return each.select(F.xxhash64("node", F.least("i", "j"), F.greatest("i", "j")).alias("node"), "id")


def _chunk(count, most: int = NODE):
    """How many chunks of about `most` rows."""
    return F.ceil(count / F.lit(most)).cast("int")


def _stars(rows: DataFrame, classes: DataFrame, buckets: int) -> DataFrame:
    """node, id, tried, near for the classes of large nodes. rows: node, id, size.

    Up to `LEADERS` classes of a node, the same in every tree that has them
    together, are compared with all its classes. tried: the most similar
    leader if the two may be linked (of a leader: itself and all that may be).
    near: leaders that may be linked with something that this class is linked with.
    A node is worked on in chunks, to each of which its leaders travel.
    """
    members = rows.select("node", "id", _chunk(F.col("size")).alias("chunks")).withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    slot = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(LEADERS))
    first = members.groupBy("node", slot.alias("slot")).agg(F.min(F.struct(F.xxhash64("id", F.lit(2)).alias("by"), "id")).alias("one"), F.first("chunks").alias("chunks"))
    leaders = first.select("node", F.col("one.id").alias("id"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(True).alias("leads"))
    both = members.select("node", "id", "chunk", F.lit(False).alias("leads")).unionByName(leaders)
    full = both.join(classes.select("id", "n_shingles", "signature"), "id")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"node": [], "id": [], "tried": [], "near": []}
        for (node, _), g in pdf.groupby(["node", "chunk"], sort=False):
            lead, rest = g[g["leads"]], g[~g["leads"]]
            if rest.empty:
                continue
            names = lead["id"].to_numpy()
            sizes, theirs = rest["n_shingles"].to_numpy(), lead["n_shingles"].to_numpy()
            # One row at a time of the fewer: the leaders.
            agree = _agree(_tokens(lead["signature"]), _tokens(rest["signature"])).T.astype(np.int64)
            less, more = np.minimum(sizes[:, None], theirs), np.maximum(sizes[:, None], theirs)
            may = np.where(100 * less >= SIMILARITY * more, agree, 0)
            near = (agree >= _NEAR) & (100 * less >= (2 * SIMILARITY - 100) * more)
            best = may.argmax(1)
            for k, i in enumerate(rest["id"].tolist()):
                out["node"].append(node)
                out["id"].append(i)
                if (names == i).any():
                    out["tried"].append(names[may[k] >= _LEAST].tolist())
                else:
                    out["tried"].append([int(names[best[k]])] if may[k, best[k]] >= _LEAST else [])
                out["near"].append(names[near[k]].tolist())
        return pd.DataFrame(out)

    bucket = F.pmod(F.xxhash64("node", "chunk"), F.lit(buckets)).alias("bucket")
    return full.select(bucket, "node", "chunk", "id", "leads", "n_shingles", "signature").groupBy("bucket").applyInPandas(run, "node long, id long, tried array<long>, near array<long>")


def _hubs(links: DataFrame) -> DataFrame:
    """node, leader, hub: linked leaders of a node as one hub, named by the least. links: node, id, leader, both leaders."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        top = {i: i for i in pdf["id"].tolist()}
        for _ in top:
            for i, j in zip(pdf["id"].tolist(), pdf["leader"].tolist(), strict=True):
                top[i] = top[j] = min(top[i], top[j])
        return pd.DataFrame({"node": pdf["node"].iloc[0], "leader": list(top), "hub": list(top.values())})

    return links.groupBy("node").applyInPandas(run, "node long, leader long, hub long")


def _relieve(docs: DataFrame, rows: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Take the dense points out of large nodes. rows: node, id, size.

    Returns confirmed links (a, b), the nodes in which what leaves is compared
    with what is near to it (node, id, part), and what remains (node, id, left
    with the number that remains).
    """
    buckets = max(1, -(-rows.count() // 4096))
    stars = materialize(_stars(rows, classes, buckets), "stars")
    tried = stars.select("node", "id", F.explode("tried").alias("leader"))
    # Dealt by the class: what the few leaders hold travels to every bucket, each class to one.
    pairs = materialize(tried.where("id <> leader").select(F.col("id").alias("a"), F.col("leader").alias("b")).distinct().withColumn("node", F.xxhash64("a")), "tried")
    wanted = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    wanted = materialize(classes.select("id", "doc_id", "text_key").join(wanted, "id"), "wanted")
    sets = materialize(_sets(docs, wanted), "sets")
    sure = materialize(_confirm(pairs, sets), "links")
    discard(sets, wanted)
    same = tried.join(sure.select(F.col("a").alias("id"), F.col("b").alias("leader"), F.lit(True).alias("sure")), ["id", "leader"], "left")
    linked = same.where("sure or id = leader").select("node", "id", "leader")
    leads = linked.where("id = leader").select("node", F.col("id").alias("lead"))
    hubs = _hubs(linked.join(leads, (linked["node"] == leads["node"]) & (linked["id"] == leads["lead"]), "left_semi"))
    around = materialize(linked.join(hubs, ["node", "leader"]).groupBy("node", "id").agg(F.min("hub").alias("hub")), "around")
    size = rows.groupBy("node").agg(F.first("size").alias("size"))
    held = around.groupBy("node", "hub").agg(F.count("*").alias("held")).join(size, "node").where(F.col("held") * HUB >= F.col("size"))
    held = materialize(held, "hubs")
    leaving = materialize(around.join(held.select("node", "hub"), ["node", "hub"]), "leaving")
    # What is near to a leader of the hub, and not of the hub itself; two hubs are compared once.
    near = stars.select("node", "id", F.explode("near").alias("leader")).join(hubs, ["node", "leader"]).select("node", "id", "hub").distinct()
    near = near.join(held.select("node", "hub", "held"), ["node", "hub"]).join(leaving.select("node", "id", F.col("hub").alias("own")), ["node", "id"], "left")
    near = materialize(near.where("own is null or own > hub").select("node", "hub", "id", "held"), "near")
    beside = near.groupBy("node", "hub").agg(F.count("*").alias("beside"), F.first("held").alias("held"))
    i, j = _chunk(F.col("held")), _chunk(F.col("beside"))
    one = leaving.join(beside, ["node", "hub"]).select("node", "hub", "id", F.pmod(F.xxhash64("id"), i).alias("i"), F.explode(F.sequence(F.lit(0), j - 1)).alias("j"), F.lit(1).alias("part"))
    two = near.drop("held").join(beside, ["node", "hub"]).select("node", "hub", "id", F.explode(F.sequence(F.lit(0), i - 1)).alias("i"), F.pmod(F.xxhash64("id"), j).alias("j"), F.lit(2).alias("part"))
    both = one.select("node", "hub", "id", F.col("i").cast("long"), F.col("j").cast("long"), "part").union(two.select("node", "hub", "id", F.col("i").cast("long"), F.col("j").cast("long"), "part"))
    compared = materialize(both.select(F.xxhash64("node", "hub", "i", "j").alias("node"), "id", "part"), "beside")
    gone = held.groupBy("node").agg(F.sum("held").alias("gone"))
    rest = rows.join(leaving.select("node", "id"), ["node", "id"], "left_anti").join(gone, "node", "left")
    rest = materialize(rest.select("node", "id", (F.col("size") - F.coalesce("gone", F.lit(0))).alias("left")), "rest")
    return sure, compared, rest


def leaves(docs: DataFrame, classes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """node, id, part of all nodes to compare: with two classes or more, and small enough (or at the last level); links found on the way.

    part is 0, or tells two sides between which alone pairs are compared.
    """
    level = materialize(_roots(classes), "nodes")
    out, links = None, []
    for depth in range(DEPTH):
        size = level.groupBy("node").agg(F.count("*").alias("size")).where("size > 1")
        size = materialize(size, "sizes")
        last = depth == DEPTH - 1
        done = level.join(size.where(F.col("size") <= NODE), "node").select("node", "id")
        if last:
            done = done.union(_blocks(level.join(size.where(F.col("size") > NODE), "node"), NODE))
        done = done.withColumn("part", F.lit(0))
        large = size.where(F.col("size") > NODE)
        ends = last or not large.limit(1).count()
        if not ends:
            sure, compared, rest = _relieve(docs, level.join(large, "node"), classes)
            links.append(sure)
            done = done.union(compared).union(rest.where((F.col("left") > 1) & (F.col("left") <= NODE)).select("node", "id", F.lit(0).alias("part")))
        done = materialize(done, "leaves")
        out = done if out is None else out.unionByName(done)
        if ends:
            return out, links
        grown = rest.where(F.col("left") > NODE).join(classes.select("id", "signature"), "id").select("node", "id", "signature")
        level = materialize(_descend(grown), "nodes")
    return out, links


# -- comparing nodes ----------------------------------------------------------


def _tokens(signatures: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(signatures), "<u2").reshape(len(signatures), SIGNATURE)


def _agree(sigs: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Agreeing tokens of each row with each other row."""
    out = np.empty((len(sigs), len(others)), np.uint16)
    for i in range(len(sigs)):
        out[i] = np.count_nonzero(others == sigs[i], axis=1)
    return out


def _forest(agree: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a maximum spanning forest of the pairs that agree enough (Prim)."""
    n = len(agree)
    best, parent, out = np.full(n, -1, np.int32), np.zeros(n, np.int64), []
    done = np.zeros(n, bool)
    for _ in range(n):
        i = int(np.argmax(np.where(done, -2, best)))
        done[i] = True
        if best[i] >= _LEAST:
            out.append((int(parent[i]), i))
        row = agree[i].astype(np.int32)
        better = row > best
        best[better] = row[better]
        parent[better] = i
    return out


def _agreement(sigs: np.ndarray, sizes: np.ndarray, parts: np.ndarray | None = None) -> np.ndarray:
    """Agreeing tokens of each pair, 0 where the sizes alone rule out a link, or both are on one side."""
    if parts is not None and parts.any():
        one, two = np.flatnonzero(parts == 1), np.flatnonzero(parts == 2)
        agree = np.zeros((len(sigs), len(sigs)), np.uint16)
        agree[np.ix_(one, two)] = _agree(sigs[one], sigs[two])
        agree = np.maximum(agree, agree.T)
    else:
        agree = _agree(sigs, sigs)
    agree[100 * np.minimum(sizes[:, None], sizes) < SIMILARITY * np.maximum(sizes[:, None], sizes)] = 0
    np.fill_diagonal(agree, 0)
    return agree


def _node_pairs(sigs: np.ndarray, sizes: np.ndarray, parts: np.ndarray | None = None) -> tuple[list[tuple[int, int]], bool]:
    """Candidate pairs of one node and whether it is dense."""
    agree = _agreement(sigs, sizes, parts)
    a, b = np.nonzero(np.triu(agree >= _LEAST))
    if len(a) > DENSE * len(sigs):
        return _forest(agree), True
    return list(zip(a.tolist(), b.tolist(), strict=True)), False


def _linked(x: np.ndarray, y: np.ndarray) -> bool:
    both = np.concatenate([x, y])
    both.sort()
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * common >= SIMILARITY * (len(both) - common)


def _node_links(sigs: np.ndarray, sizes: np.ndarray, roots: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Confirmed links of one node that join different components; likely ones first, so that few pairs need confirming."""
    agree = _agreement(sigs, sizes)
    agree[roots[:, None] == roots] = 0
    a, b = np.nonzero(np.triu(agree >= _LEAST))
    parent = {r: r for r in roots.tolist()}

    def top(r: int) -> int:
        while parent[r] != r:
            parent[r] = r = parent[parent[r]]
        return r

    out = []
    for k in np.argsort(-agree[a, b].astype(np.int32), kind="stable"):
        i, j = int(a[k]), int(b[k])
        x, y = top(int(roots[i])), top(int(roots[j]))
        if x != y and _linked(sets[i], sets[j]):
            parent[x] = y
            out.append((i, j))
    return out


def _resolve(rows: DataFrame, buckets: int) -> DataFrame:
    """a, b of confirmed links between components. rows: node, id, n_shingles, signature, root, set."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = []
        for _, g in pdf.groupby("node", sort=False):
            g = g.sort_values("id")
            ids = g["id"].tolist()
            sigs = _tokens(g["signature"])
            sets = [np.frombuffer(x, np.uint64) for x in g["set"]]
            found += [(ids[i], ids[j]) for i, j in _node_links(sigs, g["n_shingles"].to_numpy(), g["root"].to_numpy(), sets)]
        return pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    bucket = F.pmod(F.col("node"), F.lit(buckets)).alias("bucket")
    return rows.select(bucket, "node", "id", "n_shingles", "signature", "root", "set").groupBy("bucket").applyInPandas(run, "a long, b long")


def _compare(rows: DataFrame, buckets: int) -> DataFrame:
    """a, b, node, dense of candidate pairs. rows: node, id, part, n_shingles, signature."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out_a, out_b, out_node, out_dense = [], [], [], []
        for node, g in pdf.groupby("node", sort=False):
            if len(g) < 2:
                continue
            g = g.sort_values("id")
            ids, sizes = g["id"].to_numpy(), g["n_shingles"].to_numpy()
            pairs, dense = _node_pairs(_tokens(g["signature"]), sizes, g["part"].to_numpy())
            for i, j in pairs:
                out_a.append(ids[i])
                out_b.append(ids[j])
                out_node.append(node)
                out_dense.append(dense)
        return pd.DataFrame({"a": np.array(out_a, np.int64), "b": np.array(out_b, np.int64), "node": np.array(out_node, np.int64), "dense": np.array(out_dense, bool)})

    bucket = F.pmod(F.col("node"), F.lit(buckets)).alias("bucket")
    return rows.select(bucket, "node", "id", "part", "n_shingles", "signature").groupBy("bucket").applyInPandas(run, "a long, b long, node long, dense boolean")


def _gated(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id, text, text_key of the rows of docs that a gate of the wanted ones lets through: all of these, and few others."""
    of = lambda x: F.xxhash64(x["doc_id"], x["text_key"])
    shared = docs.sparkSession.sparkContext.broadcast(Gate(wanted.select(of(wanted).alias("key"))))

    @F.pandas_udf("boolean")
    def let(key: pd.Series) -> pd.Series:
        return pd.Series(shared.value.has(key.to_numpy().view(np.uint64)))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("text_key", F.xxhash64(F.coalesce("text", F.lit(""))))
    return rows.where(let(of(rows)))


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """id, set (sorted 64-bit hashes) of the wanted classes, each from one row of docs. Only texts that may be wanted are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.schema([("id", pa.int64()), ("set", pa.binary())])
        for whole in batches:
            for b in pieces(whole):
                yield arrays(out, [b.column(0), [shingles(t or "").tobytes() for t in b.column(1).to_pylist()]])

    rows = _gated(docs, wanted)
    same = rows["doc_id"].eqNullSafe(wanted["doc_id"]) & (rows["text_key"] == wanted["text_key"])
    return rows.join(wanted.hint("shuffle_hash"), same).select("id", "text").mapInArrow(run, "id long, set binary").dropDuplicates(["id"])


def _confirm(pairs: DataFrame, sets: DataFrame, per_bucket: int = 3000) -> DataFrame:
    """a, b of the pairs that are linked on full sets.

    Pairs of a node are confirmed together, so that a set travels once for a
    node (not once for a pair); many small nodes share a bucket.
    """
    n = pairs.count()
    buckets = max(1, -(-n // per_bucket))
    pairs = pairs.withColumn("bucket", F.pmod(F.col("node"), F.lit(buckets)))
    needed = pairs.select("bucket", F.col("a").alias("id")).union(pairs.select("bucket", F.col("b").alias("id"))).distinct().join(sets, "id")

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        of = {i: np.frombuffer(s, np.uint64) for i, s in zip(right["id"], right["set"], strict=True)}
        keep = [_linked(of[a], of[b]) for a, b in zip(left["a"], left["b"], strict=True)]
        return left.loc[np.array(keep, bool), ["a", "b"]]

    needed = needed.select(F.col("bucket").alias("part"), "id", "set")
    return pairs.groupBy("bucket").cogroup(needed.groupBy("part")).applyInPandas(run, "a long, b long")


def classes_of(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The signed rows with their class id, and the classes: id, n_shingles, signature, doc_id and text_key of one row."""
    rows = materialize(signed(docs), "signed")
    # An id of a class is its set's hash; the two halves of 128 bits are folded for the columns that travel.
    rows = rows.withColumn("id", F.xxhash64("set_a", "set_b")).withColumn("id", F.when(F.col("n_shingles") > 0, F.col("id")))
    one = F.min(F.struct("doc_id", "text_key")).alias("one")
    classes = rows.where("id is not null").groupBy("id").agg(one, F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"), F.first("first").alias("first"))
    return rows, materialize(classes.select("id", "n_shingles", "signature", "first", "one.doc_id", "one.text_key"), "classes")


def links(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """a, b: confirmed links between classes that join them to their components."""
    leaf, found_before = leaves(docs, classes)
    total = leaf.count()
    buckets = max(1, -(-total // 4096))
    full = leaf.join(classes.select("id", "n_shingles", "signature"), "id")
    found = materialize(_compare(full, buckets), "pairs")
    pairs = materialize(found.groupBy("a", "b").agg(F.min("node").alias("node")), "distinct")
    ends = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    wanted = materialize(classes.select("id", "doc_id", "text_key").join(ends, "id"), "wanted")
    sets = materialize(_sets(docs, wanted), "sets")
    sure = functools.reduce(DataFrame.union, found_before, materialize(_confirm(pairs, sets), "links"))
    dense = materialize(found.where("dense").select("node").distinct(), "dense")
    if not dense.limit(1).count():
        return sure
    roots = components(sure)
    rest = leaf.select("node", "id").join(dense, "node").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    # What is left in a dense node matters only if it holds several components; it is cut so that its sets fit in memory.
    sized = rest.join(classes.select("id", "n_shingles"), "id")
    mixed = sized.groupBy("node").agg((F.min("root") != F.max("root")).alias("mixed"), F.sum("n_shingles").alias("size")).where("mixed").drop("mixed")
    cut = _blocks(rest.join(mixed, "node").select("node", "id", "size"), NODE_SHINGLES)
    cut = materialize(cut.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")), "rest")
    n = cut.join(classes.select("id", "n_shingles"), "id").agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    full = cut.join(classes.select("id", "n_shingles", "signature"), "id").join(sets, "id")
    return sure.union(materialize(_resolve(full, max(1, -(-n // NODE_SHINGLES))), "links"))


def _rooted(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, n_shingles, root of each row of docs; root is the component, null for an empty set."""
    rows, classes = classes_of(docs)
    roots = components(links(docs, classes))
    rows = rows.select("doc_id", "text_key", "n_shingles", "id").join(roots, "id", "left")
    return materialize(rows.select("doc_id", "text_key", "n_shingles", F.coalesce("root", "id").alias("root")), "rooted")


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs.

    In: doc_id, text (further columns are not read). A null or empty text has
    an empty set, is linked with nothing and is its own component. Rows with
    equal sets are one class, whatever their number. component_id is the
    least doc_id of the component, nulls aside; kept where it is the row's
    own. Repeated rows of one doc_id each give a row.
    """
    rows = _rooted(docs)
    least = rows.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("least"))
    component = F.coalesce("least", "doc_id")
    return rows.join(least, "root", "left").select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of docs for each component, that of its least doc_id, all columns unchanged.

    Rows without words are linked with nothing and all stay. A null doc_id
    stands only for a component that has no other. Of rows of the least doc_id
    with different texts the one whose text has the least hash stays; of wholly
    repeated rows, or those that differ in other columns alone, any one. docs is read twice.
    """
    rows = _rooted(docs.select("doc_id", "text"))
    own = rows.where("root is not null")
    first = own.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "text_key")).alias("one"))
    times = own.groupBy("doc_id", "text_key").agg(F.count("*").alias("times"))
    one = first.select(F.col("one.doc_id").alias("_doc"), F.col("one.text_key").alias("_text"))
    same = times["doc_id"].eqNullSafe(one["_doc"]) & (times["text_key"] == one["_text"])
    one = times.join(one, same).select("_doc", "_text", "times")
    bare = rows.where("root is null").select(F.col("doc_id").alias("_doc"), F.col("text_key").alias("_text"), F.lit(1).cast("long").alias("times")).distinct()
    kept = materialize(one.union(bare), "kept")
    keyed = docs.withColumn("_key", F.struct(F.col("doc_id").cast("long").alias("doc"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text")))

    def held(which: DataFrame) -> DataFrame:
        same = keyed["_key.doc"].eqNullSafe(which["_doc"]) & (keyed["_key.text"] == which["_text"])
        return keyed.join(which.hint("shuffle_hash"), same, "left_semi")

    more = kept.where("times > 1")
    out = held(kept.where("times = 1")).drop("_key")
    return out.unionByName(held(more).dropDuplicates(["_key"]).drop("_key")) if more.limit(1).count() else out
